"""Intermediate tables in the cluster's shared folder, in place of checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

    A written table cuts lineage as a checkpoint does, but is compressed, can be
    read by column and survives the loss of any executor.  ``drop`` deletes a
    table that no later plan reads; what a returned DataFrame still reads is
    deleted when the application ends.  The setting must name a folder, except on a
    master that is one machine, whose temporary folder serves.
    """

    def __init__(self, spark: SparkSession, label: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="graphlake-")
        self.spark, self.root, self.n = spark, f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}", 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:02d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a DataFrame that reads it."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def keep_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """``keep``, and the number of rows, counted while they are written."""
        seen = Observation()
        out = self.keep(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        return out, seen.get["rows"]

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
