"""Running sums over a global order without a task that sees all rows.

Rows are first summed per distinct value of the order. Few distinct values are summed by one window; more of them are
dealt by a range sort into as many ranges as their number asks for: sums run within a range, and the
ranges' totals, a small table, carry them over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import col
from .storage import cut

#: Distinct values (over all groups) of one range; with no more than these, there is one.
RANGE_ROWS = 1 << 16


def running(df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(*by, order, each sum s, <s>_before: the sum over all smaller values of the order (larger, if descending)).

    One row per distinct value. Nulls of the order are left out."""
    by = list(by)
    rows = df.where(col(order).isNotNull()).groupBy(*map(col, [*by, order])).agg(*(F.sum(col(s)).alias(s) for s in sums))
    rows = cut(rows)
    ranges = -(-rows.count() // range_rows)
    zero = {s: F.lit(0).cast(t) for s, t in rows.dtypes if s in sums}
    down = (lambda c: col(c).desc()) if descending else col
    if ranges > 1:
        # the sort's own borders; a value lies in one range whatever its group
        rows = cut(rows.repartitionByRange(ranges, col(order)).withColumn("__range", F.spark_partition_id()))
    else:
        rows = rows.withColumn("__range", F.lit(0))
    inside = Window.partitionBy(*map(col, by), "__range").orderBy(down(order)).rowsBetween(Window.unboundedPreceding, -1)
    made = rows.withColumns({f"{s}_before": F.coalesce(F.sum(col(s)).over(inside), zero[s]) for s in sums})
    if ranges <= 1:
        return made.select(*map(col, [*by, order, *sums]), *(col(f"{s}_before") for s in sums))
    ahead = Window.partitionBy(*map(col, by)).orderBy(down("__range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(*map(col, by), "__range").agg(*(F.sum(col(s)).alias(f"__{s}") for s in sums))
    whole = whole.select(*(col(b).alias(f"__by_{i}") for i, b in enumerate(by)), F.col("__range").alias("__at"), *(F.coalesce(F.sum(f"__{s}").over(ahead), zero[s]).alias(f"__{s}") for s in sums))
    cond = F.col("__range") == F.col("__at")
    for i, b in enumerate(by):
        cond &= col(b).eqNullSafe(F.col(f"__by_{i}"))
    return made.join(whole, cond).select(*map(col, [*by, order, *sums]), *((col(f"{s}_before") + F.col(f"__{s}")).alias(f"{s}_before") for s in sums))


def numbered(df: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, order, place): places of the distinct values, from 0."""
    rows = df.select(*map(col, [*by, order])).distinct().withColumn("__one", F.lit(1).cast("long"))
    return running(rows, order, ["__one"], by).withColumnRenamed("__one_before", "place").drop("__one")


def placed(df: DataFrame, order: str, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, order, tie, place): places of the rows from 0, by the order and, where it is equal, by `tie`; rows
    equal in both share theirs."""
    rows = df.select(*map(col, [*by, order, tie])).distinct().withColumn("__one", F.lit(1).cast("long"))
    rows = cut(rows)
    start = running(rows, order, ["__one"], by).select(*map(col, [*by, order]), F.col("__one_before").alias("__start"))
    inside = Window.partitionBy(*map(col, [*by, order])).orderBy(col(tie))
    rows = rows.withColumn("__in", F.row_number().over(inside) - 1)
    cond = F.lit(True)
    for i, b in enumerate([*by, order]):
        cond &= col(b).eqNullSafe(F.col(f"__r_{i}"))
    start = start.select(*(col(b).alias(f"__r_{i}") for i, b in enumerate([*by, order])), "__start")
    # both sides lie by the order's values already; the planner must not take a table of all values for a small one
    return rows.join(start.hint("shuffle_hash"), cond).select(*map(col, [*by, order, tie]), (F.col("__start") + F.col("__in")).alias("place"))


def mid_ranks(df: DataFrame, order: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(*by, order, rank): mean ranks from 1, ties sharing theirs; a row may stand for as many as its weight says."""
    rows = df.select(*map(col, [*by, order]), (col(weight) if weight else F.lit(1)).cast("long").alias("__one"))
    made = running(rows, order, ["__one"], by)
    return made.select(*map(col, [*by, order]), (F.col("__one_before") + (F.col("__one") + 1) / F.lit(2.0)).alias("rank"))
