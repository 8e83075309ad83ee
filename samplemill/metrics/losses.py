"""Loss formulas that are plain aggregates, and what training reports need from tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, ratio, total
from .base import Metric, grouped, join_groups


def class_weights(label: str) -> Metric:
    """(*by, label, n, share, weight): the labels' shares, and weights that make all labels count alike (mean over rows: 1)."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        own = df.where(col(label).isNotNull()).groupBy(*map(col, by), col(label).alias("label")).agg(F.count("*").alias("n"))
        every = grouped(own, by).agg(F.sum("n").alias("all"), F.count("*").alias("labels"))
        return join_groups(own, every, by).select(*map(col, by), "label", "n", ratio(F.col("n"), F.col("all")).alias("share"), ratio(F.col("all"), F.col("n") * F.col("labels")).alias("weight"))

    return run


def binary_dice_loss(pred: str, target: str, eps: float = 1e-5) -> Column:
    """1 - (2 sum p t + eps) / (sum p + sum t + eps) of two vectors."""
    both = total(F.zip_with(col(pred), col(target), lambda p, t: p.cast("double") * t.cast("double")))
    return 1 - (2 * both + F.lit(eps)) / (total(col(pred)) + total(col(target)) + F.lit(eps))


def soft_cross_entropy(logits: str, target: str) -> Metric:
    """- sum t log softmax(logits) over all rows, over sum t."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        top = F.array_max(col(logits)).cast("double")
        rows = df.select(*map(col, by), col(logits).alias("x"), col(target).alias("t"), top.alias("top"))
        norm = F.col("top") + F.log(F.aggregate(F.col("x"), F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - F.col("top"))))
        rows = rows.withColumn("norm", norm)
        inner = total(F.zip_with("x", "t", lambda x, t: t.cast("double") * x.cast("double")))
        return grouped(rows, by).agg(ratio(F.sum(total(F.col("t")) * F.col("norm") - inner), F.sum(total(F.col("t")))).alias("soft_cross_entropy"))

    return run


def contrastive(key: str, feature: str, label: str, batch: str, temperature: float = 0.2) -> Metric:
    """The supervised contrastive loss of each batch (column `batch` in the result): cosine similarities over the
    temperature, soft cross-entropy against the mask of equal labels. Rows meet within a batch only, whose size its maker bounds."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        norm = F.sqrt(F.aggregate(col(feature), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        rows = df.select(*map(col, by), col(batch).alias("batch"), col(key).alias("k"), col(label).alias("y"), col(feature).alias("f"), F.greatest(norm, F.lit(1e-12)).alias("norm"))
        rows = rows.withColumn("f", F.transform("f", lambda x: x.cast("double") / F.col("norm"))).drop("norm")
        keys = [*by, "batch"]
        pairs = join_groups(rows, rows.select(*map(col, keys), F.col("y").alias("y2"), F.col("f").alias("f2")), keys)
        z = F.aggregate(F.zip_with("f", "f2", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / F.lit(float(temperature))
        same = (F.col("y") == F.col("y2")).cast("double")
        # one row per sample: similarities lie within +-1 / temperature, so their exponentials need no shift
        sample = pairs.select(*map(col, keys), "k", z.alias("z"), same.alias("t")).groupBy(*map(col, keys), "k").agg(F.log(F.sum(F.exp("z"))).alias("norm"), F.sum("t").alias("n"), F.sum(F.col("t") * F.col("z")).alias("hit"))
        return sample.groupBy(*map(col, keys)).agg(F.coalesce(ratio(F.sum(F.col("n") * F.col("norm") - F.col("hit")), F.sum("n")), F.lit(0.0)).alias("contrastive"))

    return run


def epoch_summary(epochs: DataFrame, falling: Sequence[str] = ()) -> DataFrame:
    """(name, best_epoch, best, last_epoch, last) from rows (epoch, name, value): the best value is the largest, the smallest for
    the names in `falling`; the earlier epoch wins a tie."""
    sign = F.when(F.col("name").isin(list(falling)), 1.0).otherwise(-1.0) if falling else F.lit(-1.0)
    rows = epochs.where("value is not null").select("name", "epoch", col("value").cast("double").alias("value"), (sign * col("value")).alias("cost"))
    best, last = F.min(F.struct("cost", "epoch", "value")), F.max(F.struct("epoch", "value"))
    return rows.groupBy("name").agg(best.alias("b"), last.alias("l")).select("name", F.col("b.epoch").alias("best_epoch"), F.col("b.value").alias("best"), F.col("l.epoch").alias("last_epoch"), F.col("l.value").alias("last"))
