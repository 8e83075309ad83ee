"""Event logs to sequences: cleaning, cohorts, bins, vocabulary, trajectories."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, digitize, uniform
from ..functions.running import numbered, running
from ..functions.storage import cut
from ..metrics.base import join_groups
from ..sources.tables import indexed, look_up_in


def clean(df: DataFrame, parameter: str, value: str, least: dict[str, float]) -> DataFrame:
    """Rows whose value is at least its parameter's bound, if it has one."""
    bounds = F.create_map(*(F.lit(x) for k, v in least.items() for x in (k, float(v))))
    bound = F.element_at(bounds, col(parameter))
    return df.where(bound.isNull() | (col(value) >= bound))


def cohort(df: DataFrame, key: str, hour: Column, visit: Column, hours: int, visits: int) -> DataFrame:
    """Rows of keys with a largest hour and a number of distinct visits of at least so many."""
    good = df.groupBy(col(key).alias(key)).agg(F.max(hour).alias("h"), F.count_distinct(visit).alias("v")).where((F.col("h") >= hours) & (F.col("v") >= visits))
    return df.join(good.select(key), key, "left_semi")


def combine(df: DataFrame, key: str, static: dict[str, Column], time: str, fields: Sequence[str]) -> DataFrame:
    """(key, details map<string, double>, visits array<struct<time, fields>> in order)."""
    details = F.map_from_entries(F.array(*(F.struct(F.lit(n), c.cast("double")) for n, c in static.items())))
    visits = F.array_sort(F.collect_list(F.struct(col(time).alias("time"), *map(col, fields))))
    return df.groupBy(col(key).alias(key)).agg(details.alias("details"), visits.alias("visits"))


def bin_edges(df: DataFrame, parameter: str, value: str, bins: int, categorical: int) -> DataFrame:
    """(parameter, edges): percentiles at 0, 100 / bins, ... up to 100; of a parameter with under `categorical` distinct
    values, these plus one."""
    step = 100 / bins
    shares = [min(i * step, 100.0) / 100 for i in range(bins + 1)]
    x = F.when(~F.isnan(col(value).cast("double")), col(value).cast("double"))
    rows = df.select(col(parameter).alias("parameter"), x.alias("x"), F.lit(1).cast("long").alias("one"))
    # values with their places, so that no task holds a parameter's values
    at = cut(running(rows, "x", ["one"], ["parameter"]))
    size = at.groupBy("parameter").agg(F.count("*").alias("distinct"), F.sum("one").alias("all"))
    found = join_groups(at, size, ["parameter"])

    def nth(place: Column) -> Column:
        return F.max(F.when((F.col("one_before") <= place) & (place < F.col("one_before") + F.col("one")), F.col("x")))

    ends = [((F.col("all") - 1) * F.lit(s)) for s in shares]
    picked = found.groupBy("parameter").agg(
        F.first("distinct").alias("distinct"), *(nth(F.floor(p)).alias(f"lo{i}") for i, p in enumerate(ends)), *(nth(F.ceil(p)).alias(f"hi{i}") for i, p in enumerate(ends)), *(F.first(p - F.floor(p)).alias(f"f{i}") for i, p in enumerate(ends)),
        F.array_sort(F.collect_list(F.when(F.col("distinct") < categorical, F.col("x") + 1))).alias("own"),
    )
    edges = F.array(*(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"f{i}") for i in range(len(ends))))
    out = picked.select("parameter", F.when(F.col("distinct") < categorical, F.col("own")).otherwise(edges).alias("edges"))
    # a parameter without any value keeps its row
    return join_groups(df.select(col(parameter).alias("parameter")).distinct(), out, ["parameter"], "left")


def binned(df: DataFrame, edges: DataFrame, parameter: str, value: str, to: str) -> DataFrame:
    """<parameter>_<bin>, UNK without edges; the small table of edges is joined."""
    out = df.join(edges.withColumnRenamed("parameter", "__p"), col(parameter) == F.col("__p"), "left")
    return out.withColumn(to, F.when(F.col("edges").isNull(), "UNK").otherwise(F.concat(col(parameter), F.lit("_"), digitize(col(value), F.col("edges")).cast("string")))).drop("__p", "edges")


def sentences(df: DataFrame, key: str, time: str, token: str, order: str, end: str = "SEP") -> DataFrame:
    """(key, time, tokens): the tokens of each time in order, then `end`."""
    tokens = F.transform(F.array_sort(F.collect_list(F.struct(col(order).alias("o"), col(token).alias("t")))), lambda x: x["t"])
    return df.groupBy(col(key).alias(key), col(time).alias(time)).agg(F.concat(tokens, F.array(F.lit(end))).alias("tokens"))


def vocabulary(df: DataFrame, token: str, special: Sequence[str] = (), least: int = 1) -> DataFrame:
    """(token, id): the special ones first, then by falling count and rising token.

    Rows are sorted as a whole by Spark and numbered by their partitions' sizes, so that no task holds all words of a count."""
    counts = df.where(col(token).isNotNull() & ~col(token).isin(list(special))).groupBy(col(token).alias("token")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    ordered = cut(cut(counts).orderBy(F.desc("n"), "token"))
    rest = indexed(ordered, "__at").select("token", (F.col("__at") + len(special)).cast("long").alias("id"))
    if not special:
        return rest
    return df.sparkSession.createDataFrame([(t, i) for i, t in enumerate(special)], "token string, id long").unionByName(rest)


def translate(df: DataFrame, key: str, tokens: str, words: DataFrame, to: str, unknown: int) -> DataFrame:
    """Ids for a vector of tokens: exploded, looked up in the vocabulary (frequent tokens do not meet in one task) and
    gathered again."""
    long = df.select(col(key).alias("__k"), F.posexplode_outer(col(tokens)).alias("at", "token"))
    ids = look_up_in(long, words, ["token"]).groupBy("__k").agg(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.coalesce("id", F.lit(unknown)).alias("id"))))).alias("__x"))
    return df.join(ids, col(key) == F.col("__k")).withColumn(to, F.transform("__x", lambda x: x["id"])).drop("__k", "__x")


def fit(vector: Column, length: int, fill) -> Column:
    """Cut or padded on the right to `length`."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(fill), length)), 1, length)


def positions(vector: Column, separator) -> Column:
    """For each element, how many separators stand before it; one pass over a batch of vectors."""

    def run(flags: pa.Array) -> pa.Array:
        lens = pc.fill_null(pc.list_value_length(flags), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        hit = flags.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.cumsum(hit) - hit
        ends = np.append(0, np.cumsum(lens))
        first = np.repeat(np.append(before, 0)[ends[:-1]], lens)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(before - first), mask=flags.is_null())

    return F.arrow_udf(run, "array<long>")(F.transform(vector, lambda x: F.coalesce(x == F.lit(separator), F.lit(False))))


def trajectory(visits: DataFrame, key: str, time: str, tokens: str, length: int, first: Sequence[str] = ("CLS",)) -> DataFrame:
    """(key, trajectory, next): the latest visits before the last whose tokens, with the `first` ones, number under `length`,
    in order; `next`: the last visit's tokens."""
    back = Window.partitionBy(col(key)).orderBy(col(time).desc())
    rows = visits.withColumns({"__r": F.row_number().over(back), "__n": F.size(col(tokens))})
    rows = rows.withColumn("__sum", F.sum(F.when(F.col("__r") > 1, F.col("__n")).otherwise(0)).over(back.rowsBetween(Window.unboundedPreceding, 0)) + len(first))
    kept = F.flatten(F.transform(F.array_sort(F.collect_list(F.when((F.col("__r") > 1) & (F.col("__sum") < length), F.struct(col(time).alias("t"), col(tokens).alias("x"))))), lambda v: v["x"]))
    out = rows.groupBy(col(key).alias(key)).agg(kept.alias("k"), F.max(F.when(F.col("__r") == 1, col(tokens))).alias("next"))
    return out.select(col(key), F.concat(F.array(*map(F.lit, first)), "k").alias("trajectory"), "next")


def sampled_trajectory(visits: DataFrame, key: str, time: str, tokens: str, length: int, seed: object = None, static: str | None = None, in_all: bool = False, first: Sequence[str] = ("CLS",), static_end: str = "SEP_STATIC", pad: str = "PAD") -> DataFrame:
    """(key, tokens, next): a drawn range of a key's visits as one sequence of `length` tokens, and the tokens of the visit after it.

    With a seed the range begins in the first half of the visits but the last and ends in the second half, as drawn by the
    seed and the key; without one it is all but the last. Of its visits the latest stay that together have under
    `length` tokens. The tokens of the column `static` stand before every visit (in_all) or once at the
    beginning, before `static_end`. Keys of fewer than three visits are not drawn from."""
    order, back = Window.partitionBy(col(key)).orderBy(col(time)), Window.partitionBy(col(key)).orderBy(col(time).desc())
    rows = visits.withColumns({"__i": F.row_number().over(order) - 1, "__all": F.count("*").over(Window.partitionBy(col(key)))})
    half = F.greatest(F.floor((F.col("__all") - 1) / 2), F.lit(1))
    drawn = lambda name: F.lit(0) if seed is None else F.floor(uniform(f"{seed}/{name}", key) * half)
    rows = rows.withColumns({"__start": drawn("start"), "__stop": F.col("__all") - 1 - drawn("stop")})
    own = F.coalesce(col(static), F.array().cast("array<string>")) if static else F.array().cast("array<string>")
    rows = rows.withColumn("__v", F.concat(own, col(tokens)) if in_all else col(tokens))
    inside = (F.col("__i") >= F.col("__start")) & (F.col("__i") < F.col("__stop"))
    rows = rows.withColumns({"__in": inside, "__sum": F.sum(F.when(inside, F.size("__v")).otherwise(0)).over(back.rowsBetween(Window.unboundedPreceding, 0))})
    kept = F.array_sort(F.collect_list(F.when(F.col("__in") & (F.col("__sum") < length), F.struct(F.col("__i").alias("i"), F.col("__v").alias("x")))))
    out = rows.groupBy(col(key).alias(key)).agg(F.flatten(F.transform(kept, lambda v: v["x"])).alias("k"), F.max(F.when(F.col("__i") == F.col("__stop"), col(tokens))).alias("next"), F.first(own).alias("s"))
    head = F.array(*map(F.lit, first))
    head = head if in_all else F.concat(head, F.col("s"), F.array(F.lit(static_end)))
    return out.select(col(key), fit(F.concat(head, F.col("k")), length, pad).alias("tokens"), "next")


def multi_hot(tokens: Column, words: Sequence[str]) -> Column:
    return F.array(*(F.array_contains(tokens, w).cast("double") for w in words))


def visit_places(df: DataFrame, key: str, time: str) -> DataFrame:
    """Each row with its time's place among the key's distinct times."""
    return join_groups(df, numbered(df, time, [key]), [key, time])
