"""Regression, correlation, survival, sequences and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, ratio
from ..functions.running import mid_ranks, numbered, running
from ..functions.storage import cut
from .base import Metric, grouped, join_groups


def pairs(df: DataFrame, pred: str, target: str, by: Sequence[str] = (), mask: str | None = None) -> DataFrame:
    """(*by, pred, target) of numbers, or of all elements of vectors; only where the mask is true."""
    if df.schema[pred].dataType.typeName() == "array":
        parts = {"p": pred, "t": target} | ({"m": mask} if mask else {})
        df = df.select(*map(col, by), F.explode(F.arrays_zip(*(col(c).alias(n) for n, c in parts.items()))).alias("x"))
        out = df.select(*map(col, by), F.col("x.p").cast("double").alias("pred"), F.col("x.t").cast("double").alias("target"), *([F.col("x.m").cast("boolean").alias("m")] if mask else []))
    else:
        out = df.select(*map(col, by), col(pred).cast("double").alias("pred"), col(target).cast("double").alias("target"), *([col(mask).cast("boolean").alias("m")] if mask else []))
    return out.where("m").drop("m") if mask else out


def errors(pred: str, target: str, mask: str | None = None) -> Metric:
    """mae, mse and rmse."""
    d = F.col("pred") - F.col("target")
    return lambda df, by=(): grouped(pairs(df, pred, target, by, mask), by).agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"))


def r2(pred: str, target: str, mask: str | None = None) -> Metric:
    """1 - squared errors over the targets' squared deviations."""
    d = F.col("pred") - F.col("target")
    return lambda df, by=(): grouped(pairs(df, pred, target, by, mask), by).agg((1 - ratio(F.sum(d * d), F.var_pop("target") * F.count("target"))).alias("r2"))


def pearson(pred: str, target: str, mask: str | None = None) -> Metric:
    """r and the number of pairs; functions.stats.pearson_p gives the p-value of these two numbers."""
    return lambda df, by=(): grouped(pairs(df, pred, target, by, mask), by).agg(F.corr("pred", "target").alias("r"), F.count("*").alias("n"))


def spearman(pred: str, target: str, mask: str | None = None) -> Metric:
    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        # equal pairs count as one row; ranks are taken from their known mean, (n + 1) / 2
        rows = pairs(df, pred, target, by, mask).dropna(subset=["pred", "target"])
        rows = cut(rows.groupBy(*map(col, by), "pred", "target").agg(F.count("*").alias("n")))
        size = grouped(rows, by).agg(F.sum("n").alias("all"))
        for c in ("pred", "target"):
            rows = join_groups(rows, mid_ranks(rows, c, by, "n").withColumnRenamed("rank", f"r_{c}"), [*by, c])
        mean = (F.col("all") + 1) / F.lit(2.0)
        a, b, n = F.col("r_pred") - mean, F.col("r_target") - mean, F.col("n")
        sums = grouped(join_groups(rows, size, by), by).agg(F.sum(n * a * b).alias("ab"), F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb"), F.sum("n").alias("n"))
        return sums.select(*map(col, by), ratio(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))).alias("rho"), "n")

    return run


def unique_values(key: str) -> Metric:
    """(*by, key, n)."""
    return lambda df, by=(): df.groupBy(*map(col, by), col(key)).agg(F.count("*").alias("n"))


def expected_bin(probabilities: str) -> Column:
    """sum k p_k."""
    return F.aggregate(F.transform(col(probabilities), lambda p, i: p.cast("double") * i), F.lit(0.0), lambda a, x: a + x)


def c_index(risk: str, time: str, observed: str | None = None, unit: int = 1, followup: float | None = None, higher_is_earlier: bool = True) -> Metric:
    """concordant (ties one half), comparable and c_index of pairs whose order is known: a seen event before a later time, or
    before a censored one at the same time.

    No pair is formed. Distinct times get places; at each binary digit of the place, rows with the same higher digits
    meet: seen events with a 0 in this digit against all rows with a 1, counted by running sums over the risk. Every
    pair of different times meets at exactly one digit, so a row is copied once per digit. Times are divided by `unit` and cut."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        seen = col(observed).cast("int") == 1 if observed else F.lit(True)
        if followup is not None:
            seen = seen & (col(time) <= F.lit(float(followup)))
        sign = 1 if higher_is_earlier else -1
        rows = df.select(*map(col, by), (F.lit(sign) * col(risk).cast("double")).alias("risk"), F.floor(col(time) / F.lit(float(unit))).cast("long").alias("time"), seen.alias("seen")).dropna(subset=["risk", "time"])
        rows = rows.groupBy(*map(col, by), "risk", "time", "seen").agg(F.count("*").alias("n"))
        rows = cut(rows)
        places = numbered(rows, "time", by)
        rows = join_groups(rows, places, [*by, "time"])
        digits = max(1, (places.agg(F.max("place")).first()[0] or 0).bit_length())
        digit = F.explode(F.sequence(F.lit(-1), F.lit(digits - 1))).alias("digit")
        rows = rows.select(*map(col, by), "risk", "seen", "place", "n", digit)
        same = F.col("digit") < 0
        bit = F.expr("case when digit >= 0 then (place div cast(power(2, digit) as bigint)) % 2 end")
        high = F.when(same, F.col("place")).otherwise(F.expr("place div cast(power(2, greatest(digit, 0) + 1) as bigint)"))
        left = F.when(F.col("seen") & (same | (bit == 0)), F.col("n")).otherwise(0)
        right = F.when(F.when(same, ~F.col("seen")).otherwise(bit == 1), F.col("n")).otherwise(0)
        sides = rows.select(*map(col, by), "digit", high.alias("high"), "risk", left.alias("l"), right.alias("r")).where("l + r > 0")
        keys = [*by, "digit", "high"]
        at = running(sides, "risk", ["l", "r"], keys)
        cell = grouped(at, keys).agg(F.sum(F.col("l") * (F.col("r_before") + F.col("r") / 2)).alias("c"), F.sum("l").alias("l"), F.sum("r").alias("r"))
        out = grouped(cell, by).agg(F.sum("c").alias("concordant"), F.sum(F.col("l") * F.col("r")).cast("double").alias("comparable"))
        return out.withColumn("c_index", ratio(F.col("concordant"), F.col("comparable")))

    return run


def perplexity(probabilities: str, targets: str, ignore: int | None = None) -> Metric:
    """exp of the mean of -log p[target] over all tokens that do not count as `ignore`; and their number."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        x = F.explode(F.arrays_zip(col(probabilities).alias("p"), col(targets).alias("t"))).alias("x")
        rows = df.select(*map(col, by), x).where(F.col("x.t").isNotNull() if ignore is None else F.col("x.t") != ignore)
        loss = -F.log(F.get(F.col("x.p"), F.col("x.t").cast("int")).cast("double"))
        return grouped(rows, by).agg(F.exp(F.sum(loss) / F.count("*")).alias("perplexity"), F.count("*").alias("tokens"))

    return run


def count_tokens(*tokens: str, ignore: int | None = None) -> Metric:
    """sequences and tokens (of all the columns) that are not `ignore`; results of parts add up."""

    def n(c):
        return F.size(F.filter(col(c), lambda t: t != F.lit(ignore)) if ignore is not None else col(c))

    return lambda df, by=(): grouped(df, by).agg(F.count("*").alias("sequences"), F.coalesce(F.sum(sum((F.greatest(n(c), F.lit(0)) for c in tokens), F.lit(0))), F.lit(0)).alias("tokens"))
