"""Sinks: idempotent appends, sealed batches and content-addressed objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.history import new_rows, own_conflicts, replay_conflicts


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def append_new(incoming: DataFrame, path: str, key: list[str]) -> int:
    """Append the rows whose key is not stored. Returns rows written.

    A key that comes with two payloads, in the batch or against the store, is an error. The rows written are
    counted as they are written; the log is not read for it.
    """
    spark = incoming.sparkSession
    if own_conflicts(incoming, key).limit(1).count():
        raise ValueError("a key comes twice in a batch with different payloads")
    if not exists(spark, path):
        fresh = incoming.dropDuplicates(key)
    else:
        stored = spark.read.parquet(path)
        if replay_conflicts(incoming, stored, key).limit(1).count():
            raise ValueError("a stored key comes again with another payload")
        fresh = new_rows(incoming, stored, key)
    written = Observation()
    fresh.observe(written, F.count("*").alias("rows")).write.mode("append").parquet(path)
    return written.get["rows"]


def write_once(df: DataFrame, path: str) -> None:
    """Write a batch that must not exist."""
    df.write.mode("errorifexists").parquet(path)


def seal(batch: str, spark: SparkSession, manifest: DataFrame) -> None:
    """Publish a batch: its manifest is written once, beside it, when everything else is there."""
    manifest.write.mode("errorifexists").parquet(f"{batch}/_SEALED")


def is_sealed(batch: str, spark: SparkSession) -> bool:
    return exists(spark, f"{batch}/_SEALED/_SUCCESS")


def archive_objects(files: DataFrame, root: str) -> DataFrame:
    """Store contents by digest, each once, and return the manifest (path, sha256, bytes)."""
    spark = files.sparkSession
    objects = files.select("sha256", "bytes", "content").dropDuplicates(["sha256"])
    if exists(spark, f"{root}/objects"):
        objects = objects.join(spark.read.parquet(f"{root}/objects").select("sha256"), "sha256", "left_anti")
    objects.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("prefix").parquet(f"{root}/objects")
    return files.select("path", "sha256", "bytes")


def json_document(df: DataFrame, order: list[str]) -> DataFrame:
    """All rows as one JSON array in a fixed order; for reports whose size is bounded by design."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order])))
    return df.agg(F.to_json(rows).alias("document"))
