"""Tables kept between steps, in the folder that the session shares among driver and executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOCAL_DEFAULT = "spark.lodestrata.local.checkpoint"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get(LOCAL_DEFAULT, None)
        if not found:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="lodestrata-")
            spark.conf.set(LOCAL_DEFAULT, found)
    return found.rstrip("/")


class Scratch:
    """Writes tables below one fresh folder; a written table has no lineage and outlives lost executors."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back. Once it is written, the shuffle files behind it are dropped."""
        at = f"{self.path}/{name}"
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(at)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        """Remove a table that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
