"""Content addressing: canonical text, SHA-256 identities and fingerprints of ordered groups."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.resumable import Sha256
from lodestrata.functions.stages import Stages


def sha256(value: Column) -> Column:
    """Lower-case hex SHA-256 of a string or binary."""
    return F.sha2(value, 256)


def composite_id(*parts: Column | str, sep: str = ":") -> Column:
    """Identity of several parts: SHA-256 of their text joined by ``sep``; a null part is a NUL, which no text is."""
    named = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("\0")) for p in named]), 256)


def canonical_struct(columns: list[str]) -> Column:
    """Compact JSON of known columns with sorted keys; null values are written."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


@F.pandas_udf(T.StringType())
def _canonical(texts):  # a JSON text of unknown shape: only here rows pass through Python, in Arrow batches
    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)
        except ValueError:
            return None

    return texts.map(one, na_action="ignore")


def canonical_json(text: Column) -> Column:
    """Sorted keys, no blanks, ASCII only; null for text that is not JSON."""
    return _canonical(text)


def row_digest(columns: list[str]) -> Column:
    """Digest of a row over named columns; null and the empty string differ."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]), 256)


RANGE_LINES = 1 << 21  # lines of a fingerprint that one task sorts and hashes
PIECE = "_group string, _range int, _block int, n_rows long, size long, data binary, state binary, fingerprint string"
LINK = "_group string, state binary, fingerprint string"


def ordered_fingerprint(df: DataFrame, group: list[str], order: list[str], digest: str) -> DataFrame:
    """Per group: rows and SHA-256 of ``id:digest`` lines in the order of ``order``.

    The definition is sequential, but no group is one task's: lines are dealt by ranges of group and order, sorted there, and
    a group that goes on in the next range hands over the state of its hash. A range hashes all its groups at once but the
    first, which may have begun before; that one is written in compressed blocks and hashed when the states before it are
    known. So a group takes as many jobs as it has ranges, groups at the same time, and a task has one range to hold and read.
    """
    line = F.coalesce(F.concat(F.concat_ws("-", *[F.col(f"_o{k}").cast("string") for k in range(len(order))]), F.lit(":"), F.col("_digest"), F.lit("\n")), F.lit(""))
    named = F.struct(*[F.col(c) for c in group])
    rows = df.select(F.to_json(named, {"ignoreNullFields": "false"}).alias("_group"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.col(digest).cast("string").alias("_digest"))
    keys = ["_group", *[f"_o{k}" for k in range(len(order))]]
    ranges = max(1, -(-rows.count() // RANGE_LINES))
    dealt = rows.repartitionByRange(ranges, *keys, line).withColumns({"_line": line, "_range": F.spark_partition_id()})
    pieces = dealt.sortWithinPartitions(*keys, "_line").select("_group", "_line", "_range").mapInArrow(_pieces, PIECE)
    pieces = _chained(pieces) if ranges > 1 else pieces.withColumn("_step", F.lit(0))
    found = pieces.groupBy("_group").agg(F.sum("n_rows").alias("n_rows"), F.max_by("fingerprint", F.when(F.col("fingerprint").isNotNull(), F.col("_step"))).alias("fingerprint"))
    kinds = T.StructType([df.schema[c] for c in group])
    return found.select(F.from_json("_group", kinds).alias("_g"), "n_rows", "fingerprint").select(*[F.col("_g")[c].alias(c) for c in group], "n_rows", "fingerprint")


def _pieces(batches):
    """What sorted lines (_group, _line, _range) of a range hold of each group: a hash, or blocks of text of the range's first group."""
    now, n, state, at_range, block = None, 0, None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        groups, lines, at_range = batch.column(0), batch.column(1).cast(pa.large_string()), batch.column(2)[0].as_py()
        ends = pc.run_end_encode(groups, run_end_type=pa.int64()).run_ends.to_pylist()
        data, at = lines.buffers()[2], np.frombuffer(lines.buffers()[1], np.int64)[lines.offset :]
        for lo, hi in zip([0, *ends], ends, strict=False):
            key = groups[lo].as_py()
            if key != now:
                if state is not None:
                    yield _row(PIECE, now, at_range, -1, n, None, None, state.state(), state.hexdigest())
                state = Sha256() if at_range == 0 or now is not None else None
                now, n = key, 0
            text = data.slice(int(at[lo]), int(at[hi] - at[lo])) if at[hi] > at[lo] else pa.py_buffer(b"")
            if state is None:
                yield _row(PIECE, now, at_range, block, hi - lo, text.size, pa.compress(text, codec="zstd", asbytes=True), None, None)
                block += 1
            else:
                n += hi - lo
                state.update(text)
    if state is not None:
        yield _row(PIECE, now, at_range, -1, n, None, None, state.state(), state.hexdigest())


def _chained(pieces: DataFrame) -> DataFrame:
    """(_group, _step, n_rows, fingerprint): rows of the pieces, and hashes of the first ranges of a group; that of its last step counts."""
    stages = Stages(pieces.sparkSession, "fingerprint")
    pieces.write.partitionBy("_range").parquet(f"{stages.path}/pieces")
    kinds = T._parse_datatype_string(PIECE)
    held = pieces.sparkSession.read.schema(kinds).parquet(f"{stages.path}/pieces").select(*kinds.names)
    own = held.filter("_block >= 0").groupBy("_group", "_range").agg(F.sum("n_rows").alias("n_rows"))
    hashed = held.filter("_block < 0").select("_group", "_range", "n_rows", "state", "fingerprint")
    known = hashed.select("_group", "_range", F.lit(True).alias("_hashed")).unionByName(own.select("_group", "_range", F.lit(False).alias("_hashed")))
    step = F.row_number().over(Window.partitionBy("_group").orderBy("_range")) - 1
    steps = {}  # a range has one piece in blocks, so this is a number for each range
    for r in known.withColumn("_step", step).filter("not _hashed").select("_range", "_step").collect():
        steps.setdefault(r._step, []).append(r._range)
    out = hashed.select("_group", F.lit(0).alias("_step"), "n_rows", "fingerprint")
    out = out.unionByName(own.select("_group", F.lit(0).alias("_step"), "n_rows", F.lit(None).cast("string").alias("fingerprint")))
    before = hashed.select("_group", "state")
    for k in sorted(steps):
        blocks = held.filter(F.col("_range").isin(steps[k])).filter("_block >= 0").select("_group", "_block", "size", "data", F.lit(None).cast("binary").alias("state"))
        if k:
            started = before.join(blocks.select("_group").distinct(), "_group", "left_semi")
            blocks = blocks.unionByName(started.select("_group", F.lit(-1).alias("_block"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("data"), "state"))
        linked = blocks.repartition(len(steps[k]), "_group").sortWithinPartitions("_group", "_block").mapInArrow(_link, LINK)
        linked = stages.keep(linked, f"link{k}")
        out = out.unionByName(linked.select("_group", F.lit(k).alias("_step"), F.lit(0).cast("long").alias("n_rows"), "fingerprint"))
        before = before.unionByName(linked.select("_group", "state")) if not k else linked.select("_group", "state")
    return out


def _link(batches):
    """States of groups after one more range: (_group, _block, size, data, state), sorted, the state before them first."""
    now, state, codec = None, None, pa.Codec("zstd")
    for batch in batches:
        for key, size, data, before in zip(batch.column(0), batch.column(2), batch.column(3), batch.column(4), strict=True):
            if key.as_py() != now:
                if state is not None:
                    yield _row(LINK, now, state.state(), state.hexdigest())
                now, state = key.as_py(), Sha256(before.as_py())
            if data.is_valid and size.as_py():
                state.update(codec.decompress(data.as_buffer(), size.as_py()))
    if state is not None:
        yield _row(LINK, now, state.state(), state.hexdigest())


def _row(kinds: str, *values) -> pa.RecordBatch:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    named = [field.split() for field in kinds.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], types[t]) for v, (_, t) in zip(values, named, strict=True)], names=[n for n, _ in named])


LIMBS = 4  # a SHA-256 is summed as four numbers of 64 bits
EMPTY_FINGERPRINT = hashlib.sha256("|".join(["0"] * (LIMBS + 1)).encode()).hexdigest()


def tree_fingerprint(df: DataFrame, group: list[str], digest: str) -> DataFrame:
    """Order-free identity of the multiset of digests of each group: n_rows and fingerprint, in bounded memory.

    The SHA-256 of each digest is summed limb by limb (map-side combined, in any order), and the sums are hashed with the
    number of rows. Repeated rows count; a null digest is a NUL, which no text is; nothing has ``EMPTY_FINGERPRINT``.
    """
    sha = F.sha2(F.coalesce(F.col(digest).cast("string"), F.lit("\0")), 256)
    width = 64 // LIMBS
    limb = lambda k: F.sum(F.conv(F.substring(sha, 1 + width * k, width), 16, 10).cast("decimal(20,0)"))
    sums = df.groupBy(*group).agg(F.count("*").alias("n_rows"), *[limb(k).alias(f"_limb{k}") for k in range(LIMBS)])
    text = F.concat_ws("|", F.col("n_rows").cast("string"), *[F.coalesce(F.col(f"_limb{k}"), F.lit(0)).cast("string") for k in range(LIMBS)])
    return sums.select(*group, "n_rows", F.sha2(text, 256).alias("fingerprint"))


def set_fingerprint(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per group: SHA-256 of the distinct values, sorted and comma-joined."""
    joined = F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",")
    out = F.sha2(joined, 256).alias("fingerprint")
    size = F.count_distinct(value).alias("n_values")
    return df.groupBy(*group).agg(size, out) if group else df.agg(size, out)
