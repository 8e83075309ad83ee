"""The shape of a metric, and the wrappers that work on any metric."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.columns import col, uniform
from ..functions.running import numbered
from ..functions.storage import cut
from .bootstrap import draws

Metric = Callable[[DataFrame, Sequence[str]], DataFrame]


def grouped(df: DataFrame, by: Sequence[str]):
    return df.groupBy(*map(col, by))


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins on group columns, a null being a group like any other."""
    if not by:
        return left.join(right, F.lit(True), how)
    renamed = right.select(*(col(b).alias(f"__r_{i}") for i, b in enumerate(by)), *(col(c) for c in right.columns if c not in by))
    cond = F.lit(True)
    for i, b in enumerate(by):
        cond &= col(b).eqNullSafe(F.col(f"__r_{i}"))
    return left.join(renamed, cond, how).drop(*(f"__r_{i}" for i in range(len(by))))


def values(df: DataFrame, by: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in by]


def long(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(*by, name, value) from a metric's columns."""
    names = values(df, by)
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), col(n).cast("double").alias("value")) for n in names))).alias("p")
    return df.select(*map(col, by), pairs).select(*map(col, by), "p.name", "p.value")


def per_group(metric: Metric, group: str) -> Metric:
    """(*by, name, <group> as text, value): the metric of each group, and the mean, std (of the population) and
    median over the groups as the groups `mean`, `std`, `median`."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        own = long(metric(df, [*by, group]), [*by, group])
        stat = own.groupBy(*map(col, by), "name").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.median("value").alias("median"))
        stat = stat.select(*map(col, by), "name", F.explode(F.create_map(*(x for s in ("mean", "std", "median") for x in (F.lit(s), col(s))))).alias(group, "value"))
        return own.select(*map(col, by), "name", col(group).cast("string").alias(group), "value").unionByName(stat)

    return run


def leaving_out(metric: Metric, condition: Column) -> Metric:
    """The metric of the rows for which the condition is false."""
    return lambda df, by=(): metric(df.where(~condition), by)


def one_vs_rest(metric: Callable[[str, str], Metric], scores: Mapping[str, Column], target: str, weights: Mapping[str, float] | None = None) -> Metric:
    """metric(score, 0/1 target) for each class (in the order of the target's numbers), and `macro_avg`, over the
    classes with a value. Result (*by, class, the metric's columns)."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        rows = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), s.cast("double").alias("__score"), (col(target) == i).cast("int").alias("__target")) for i, (c, s) in enumerate(scores.items())))).alias("__c")
        wide = df.select("*", rows).select(*map(col, df.columns), "__c.*")
        own = metric("__score", "__target")(wide, [*by, "class"])
        names = values(own, [*by, "class"])
        w = F.lit(1.0)
        if weights:
            w = F.element_at(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v))))), F.col("class"))
        macro = grouped(own, by).agg(F.lit("macro_avg").alias("class"), *((F.sum(col(n) * w) / F.sum(F.when(col(n).isNotNull(), w))).alias(n) for n in names))
        return own.unionByName(macro.select(*own.columns))

    return run


def resampled(df: DataFrame, replicates: int, key: str, strata: Sequence[str], by: Sequence[str], seed: object) -> DataFrame:
    """`replicates` draws with replacement of as many rows, within each stratum of each group: column `replicate`, and in
    `__times` how often a row was drawn.

    Draw i of a stratum takes the row in place floor(n * u(seed, replicate, i)), places being by the key."""
    groups = list(dict.fromkeys([*by, *strata]))
    places = numbered(df, key, groups)
    places = cut(places)
    rows = join_groups(df, places, [*groups, key]).withColumnRenamed("place", "__place")
    sizes = places.groupBy(*map(col, groups)).agg(F.count("*").alias("__n"))
    drawn = join_groups(places, sizes, groups).select(*map(col, groups), "__n", "place", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    u = uniform(seed, F.col("replicate"), *map(col, strata), F.col("place"))
    drawn = drawn.select(*map(col, groups), "replicate", F.floor(u * F.col("__n")).cast("long").alias("__place"))
    # equal draws of one replicate become a weight before the join
    drawn = drawn.groupBy(*map(col, groups), "replicate", "__place").agg(F.count("*").alias("__times"))
    return join_groups(drawn, rows, [*groups, "__place"]).drop("__place")


def _drawn(df: DataFrame, replicates: int, key: str, cells: Sequence[str] | None, strata: Sequence[str], by: Sequence[str], seed: object) -> DataFrame:
    if cells is not None:
        return draws(df, replicates, cells, list(dict.fromkeys([*by, *strata])), strata, seed)
    return resampled(df, replicates, key, strata, by, seed)


def interval(metric: Callable[[str | None], Metric], key: str, strata: Sequence[str] = (), replicates: int = 10_000, seed: object = 1234, percent: float = 95, method: str = "percentile", cells: Sequence[str] | None = None) -> Metric:
    """(*by, name, org, mean, std, conf_lower, conf_upper) by stratified bootstrap; `metric` makes the metric for a
    column of weights, or for none. With `cells`, the columns that the metric reads, equal rows are drawn as
    multinomial counts, at a cost that does not grow with the rows.

    percentile: the values in places floor(r n) and floor((1 - r) n) of the sorted replicates; pivotal: 2 org
    minus these; normal: org +- z std."""
    r = (1 - percent / 100) / 2

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        df = cut(df)
        org = long(metric(None)(df, by), by).withColumnRenamed("value", "org")
        many = long(metric("__times")(_drawn(df, replicates, key, cells, strata, by, seed), [*by, "replicate"]), [*by, "replicate"])
        rows = many.groupBy(*map(col, by), "name").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.array_sort(F.collect_list("value")).alias("v"))
        out = join_groups(org, rows, [*by, "name"])
        n = F.size("v")
        low, high = F.get("v", F.floor(n * F.lit(r)).cast("int")), F.get("v", F.floor(n * F.lit(1 - r)).cast("int"))
        z = F.lit(stats.normal_quantile(1 - r))
        ends = {"percentile": (low, high), "pivotal": (2 * F.col("org") - high, 2 * F.col("org") - low), "normal": (F.col("org") - z * F.col("std"), F.col("org") + z * F.col("std"))}[method]
        return out.select(*map(col, by), "name", "org", "mean", "std", ends[0].alias("conf_lower"), ends[1].alias("conf_upper"))

    return run


def paired(test: Callable[[str | None], Metric], reference: Callable[[str | None], Metric], key: str, strata: Sequence[str] = (), replicates: int = 10_000, seed: object = 1234, margin: float = 0.0, relative: bool = False, cells: Sequence[str] | None = None) -> Metric:
    """(*by, name, replicates, p_superiority, p_noninferiority, p_equality): both metrics on the same draws; p = 1 -
    the share of replicates in which the difference is over the margin, over its negative, or within it."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        df = cut(df)
        rows, keys = cut(_drawn(df, replicates, key, cells, strata, by, seed)), [*by, "replicate"]
        a, b = long(test("__times")(rows, keys), keys), long(reference("__times")(rows, keys), keys).withColumnRenamed("value", "other")
        both = join_groups(a, b, [*keys, "name"])
        d, m = F.col("value") - F.col("other"), F.lit(float(margin)) * (F.abs("other") if relative else F.lit(1.0))
        n = F.count("*")
        return both.groupBy(*map(col, by), "name").agg(n.alias("replicates"), *((1 - F.count_if(c) / n).alias(k) for k, c in {"p_superiority": d > m, "p_noninferiority": d > -m, "p_equality": F.abs(d) < m}.items()))

    return run
