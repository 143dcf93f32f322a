"""Tables written between the steps of an iterative job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL = "spark.lodestrata.stages"


class Stages:
    """Tables below one fresh folder of ``spark.checkpoint.dir``: a written table has no lineage and outlives executors.

    Only a local session without that setting gets a temporary folder.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL, None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="lodestrata-stages-")
            spark.conf.set(_LOCAL, root)
        self.path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; a name is used once."""
        df.write.mode("errorifexists").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(conf).delete(at, True)
