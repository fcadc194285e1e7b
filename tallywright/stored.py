"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A local session that names none gets a temporary folder; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tallywright-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors and the driver can read and write."""
    return f"{base_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it cuts the lineage and outlives a lost executor."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base_folder(df.sparkSession))
    return df.checkpoint()


class Stored:
    """A written table. Unlike a checkpoint it carries no estimates along, and it can be removed."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, new_folder(df.sparkSession, "stored")
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def remove(self) -> None:
        """Once nothing reads the table any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
