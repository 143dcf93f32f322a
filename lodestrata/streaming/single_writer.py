"""One writer a key: append requests as a stream, decided one after the other against the head of their key.

Anyone may put requests (key, request_id, expected_id, at, ...) into the inbox; only the stream appends. Its state holds for
each key the head and the sequence number, and the numbers of its decided requests in parts of bounded size, so a key
with very many requests is not one value. A request that names another head than the one at its turn is stale, and one that was
decided before gives nothing. The log is written batch by batch under the batch's number, so a batch that is
run again after a crash replaces itself.
"""

from __future__ import annotations

from array import array

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PART = 512  # decided requests in one value of the state, about
DECISION = "request_id long, expected_id long, decision string, seq long"


class Decide(StatefulProcessor):
    """Appends a request if its expectation is the head of its key (none for the first), else calls it stale.

    Every call of the state is a round trip, so requests of a key are decided together: its head is read and written once a
    batch, and the numbers of decided requests lie in parts of about ``PART``, of which those that the batch hits are read.
    There are twice as many parts whenever they are full.
    """

    def init(self, handle) -> None:
        self.head = handle.getValueState("head", "id long, seq long, n_decided long, n_parts int")
        self.decided = handle.getMapState("decided", "part int", "ids binary")

    def handleInputRows(self, key, rows, timer_values):  # noqa: N802
        """The requests of one key in one batch, in the order of ``at`` and request_id; a batch bounds how many are held."""
        requests = sorted(((r["at"] is None, r["at"], r["request_id"], r["expected_id"]) for r in rows), key=lambda r: r[:3])
        head, seq, n, n_parts = self.head.get() or (None, 0, 0, 1)
        parts, changed, out = {}, set(), []
        for _, _, request, expected in requests:
            part = place(request, n_parts)
            if part not in parts:
                parts[part] = self._read(part) if n else set()
            if request in parts[part]:
                continue
            fits = expected == head
            if fits:
                head, seq = request, seq + 1
            parts[part].add(request)
            changed.add(part)
            out.append(Row(key=key[0], request_id=request, expected_id=expected, decision="append" if fits else "stale", seq=seq if fits else None))
        if out:
            wanted = n_parts
            while wanted * PART < n + len(out):
                wanted *= 2
            if wanted > n_parts:
                known = [i for k in range(n_parts) for i in (parts[k] if k in parts else self._read(k) if n else ())]
                parts = {}
                for i in known:
                    parts.setdefault(place(i, wanted), set()).add(i)
                changed = parts
            for part in changed:
                self.decided.updateValue((part,), (array("q", parts[part]).tobytes(),))
            self.head.update((head, seq, n + len(out), wanted))
        yield from out

    def _read(self, part: int) -> set[int]:
        found = self.decided.getValue((part,))
        return set(array("q", bytes(found[0]))) if found else set()

    def close(self) -> None:
        pass


def place(request: int, n_parts: int) -> int:
    """The part of a request's number; ``n_parts`` is a power of two."""
    return (request * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 32 & (n_parts - 1)


def decisions(requests: DataFrame, key: str) -> DataFrame:
    """A stream of requests (key, request_id long, expected_id long, at) to a stream of decisions (key, request_id, expected_id, decision, seq).

    The session needs the state store of ``ROCKSDB``. A null expectation expects an empty key; a null key is a key.
    """
    kind = requests.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), *T._parse_datatype_string(DECISION).fields])
    rows = requests.select(F.col(key).alias("key"), "request_id", "expected_id", "at")
    return rows.groupBy("key").transformWithState(Decide(), schema, "append", "none")


def run_writer(spark: SparkSession, inbox: str, schema: T.StructType, key: str, log: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """Decide all requests that are in the inbox and not decided yet, and append the decisions to the log.

    The checkpoint belongs to one writer: a second stream on it is refused by Spark while the first one runs. Batches take
    ``files_per_batch`` files, in the order in which they came.
    """
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        requests = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(inbox)

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

        query = decisions(requests, key).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """All decisions, with the number of the batch that made them."""
    return spark.read.parquet(log)


def heads(log: DataFrame) -> DataFrame:
    """(key, head_id, n_appended): the last appended request of each key."""
    return log.filter("decision = 'append'").groupBy("key").agg(F.max_by("request_id", "seq").alias("head_id"), F.max("seq").alias("n_appended"))


def publishable(expected: DataFrame, log: DataFrame) -> DataFrame:
    """Keys (key, head_id) that a publication may still name, guarded when it is made: the head has not moved on since.

    Returns (key, head_id, current_id, state): current, moved, or unknown without any appended request.
    """
    now = heads(log).select(F.col("key").alias("_key"), F.col("head_id").alias("current_id"))
    both = expected.join(now, F.col("key").eqNullSafe(F.col("_key")), "left")
    state = F.when(F.col("current_id").isNull(), "unknown").when(F.col("current_id") == F.col("head_id"), "current").otherwise("moved")
    return both.select("key", "head_id", "current_id", state.alias("state"))
