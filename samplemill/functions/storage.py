"""Reliable checkpoints in the folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where the session names none, a local master gets a local
    folder (tests); on a cluster that is an error, as executors share no local folder."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder or (folder := tempfile.mkdtemp(prefix="samplemill-")))
    return folder


class Rounds:
    """Tables of an iteration, each written as Parquet below the shared folder and read back, so that a round's plan starts
    anew and knows the table's true size (a checkpoint keeps the estimate of the plan that made it, which joins of every round
    multiply). Only the last two stay."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.n = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def stored(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        self.n += 1
        if self.n > 2:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.n - 3}")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)
        return self.spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
