"""The event log as a stream: each micro-batch appends what is new, nothing late is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestrata.operators.history import latest
from lodestrata.sources.sinks import append_new, exists


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stream of event files."""
    return spark.readStream.schema(schema).parquet(path)


def append_stream(events: DataFrame, log: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Append a stream to the log by key: replayed files and events change nothing. Runs what is available and ends.

    There is no watermark: an event that comes late is stored, and the state computed from the log shows it.
    """
    return events.writeStream.foreachBatch(lambda batch, _: append_new(batch, log, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_state(spark: SparkSession, log: str, key: list[str], order: list[str]) -> DataFrame:
    """The last event of each key of a stored log."""
    return latest(spark.read.parquet(log), key, order)


def running_state(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The same as a streaming aggregate, for update or complete mode."""
    return latest(events, key, order)


def late_flags(spark: SparkSession, log: str, key: list[str], resolved: str, occurred: str, at: str) -> DataFrame:
    """Keys whose resolution a later-dated occurrence puts in question, whenever it arrived."""
    if not exists(spark, log):
        raise ValueError("no event log")
    rows = spark.read.parquet(log)
    state = rows.groupBy(*key).agg(F.max(F.when(F.col("kind") == resolved, F.col(at))).alias("_r"), F.max(F.when(F.col("kind") == occurred, F.col(at))).alias("_o"))
    return state.filter("_r is not null").select(*key, F.coalesce(F.col("_o") > F.col("_r"), F.lit(False)).alias("needs_revisit"))
