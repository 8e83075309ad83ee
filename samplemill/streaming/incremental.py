"""Streams of predictions to tables of statistics that add up batch by batch.

A micro-batch is aggregated and written under its batch id, so a repeated batch replaces
itself and counts once; the totals are read at any time. Rows are never held as state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import col


def confusion_counts(pred: str, target: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.groupBy(col(pred).cast("string").alias("pred"), col(target).cast("string").alias("target")).agg(F.count("*").cast("double").alias("value")).select(F.concat_ws("/", "pred", "target").alias("name"), "value")


def loss_sums(loss: str) -> Callable[[DataFrame], DataFrame]:
    """The sum and number of losses that are not null."""
    both = F.explode(F.array(F.struct(F.lit("sum").alias("name"), F.coalesce("s", F.lit(0.0)).alias("value")), F.struct(F.lit("count").alias("name"), F.col("n").cast("double").alias("value")))).alias("x")
    return lambda df: df.agg(F.sum(col(loss).cast("double")).alias("s"), F.count(col(loss)).alias("n")).select(both).select("x.*")


def token_counts(tokens: str, ignore=None) -> Callable[[DataFrame], DataFrame]:
    size = F.size(F.filter(col(tokens), lambda t: t != F.lit(ignore)) if ignore is not None else col(tokens))
    both = F.explode(F.array(F.struct(F.lit("sequences").alias("name"), F.col("n").cast("double").alias("value")), F.struct(F.lit("tokens").alias("name"), F.coalesce("t", F.lit(0)).cast("double").alias("value")))).alias("x")
    return lambda df: df.agg(F.count("*").alias("n"), F.sum(F.greatest(size, F.lit(0))).alias("t")).select(both).select("x.*")


def accumulate(stream: DataFrame, statistics: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, **options) -> StreamingQuery:
    """Starts a query that writes each micro-batch's (name, value) rows to `folder`/batch=<id>."""

    def each(df: DataFrame, batch: int) -> None:
        statistics(df).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**options) if options else writer).start()


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """(name, value) over all batches so far."""
    return spark.read.schema("name string, value double, batch long").parquet(folder).groupBy("name").agg(F.sum("value").alias("value"))
