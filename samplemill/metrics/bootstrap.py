"""Bootstrap draws as counts: how often each cell of equal rows is drawn is multinomial, so a replicate costs cells, not rows.

A multinomial draw is a chain of exact binomial draws: the first cell's count given all draws, the second's given
those that are left, and so on. Cells of a stratum are dealt to chunks of bounded size, chunks to chunks of
chunks, up to one; counts are drawn from there down, so that neither a row nor a task holds all cells of a stratum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.columns import col
from ..functions.storage import cut

#: Cells of a chunk, and ranges of replicates that are drawn side by side.
CHUNK, RANGES = 256, 64
#: Standard deviations from the mode beyond which a binomial's tail is under the step of a 52-bit number.
WIDTH = 9.0


def binomial_cdf(n: int, p: float) -> tuple[int, np.ndarray]:
    """(low, P(X <= low), P(X <= low + 1), ...) of n draws with probability p, where it is not 0 or 1 to 52 bits."""
    sd, mode = np.sqrt(n * p * (1 - p)), int((n + 1) * p)
    reach = int(WIDTH * sd) + 64
    low, high = max(0, mode - reach), min(n, mode + reach)
    j = np.arange(low, high, dtype=np.float64)
    logs = np.append(0.0, np.cumsum(np.log((n - j) / (j + 1)) + np.log(p / (1 - p))))
    weights = np.exp(logs - logs.max())
    return low, np.cumsum(weights) / weights.sum()


def binomial(u: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """For each n and uniform number u the binomial count of n draws: how many counts' cumulative probabilities are at most u."""
    if p >= 1:
        return n.copy()
    out = np.zeros(len(n), np.int64)
    if p <= 0 or not len(n):
        return out
    order = np.argsort(n, kind="stable")
    sizes, heads = np.unique(n[order], return_index=True)
    for size, a, b in zip(sizes.tolist(), heads, np.append(heads[1:], len(n)), strict=True):
        if size:
            low, cdf = binomial_cdf(size, p)
            out[order[a:b]] = np.minimum(low + np.searchsorted(cdf, u[order[a:b]], side="right"), size)
    return out


def multinomial(seed: object, replicates: Sequence[int], totals: np.ndarray, names: Sequence[str], weights: Sequence[int]) -> np.ndarray:
    """(replicate, name) counts: each replicate's total is dealt to the names in proportion to their weights. A count's
    uniform number depends on the seed, the replicate and the name alone."""
    left, weight_left = np.array(totals, np.int64), int(sum(weights))
    out = np.zeros((len(replicates), len(names)), np.int64)
    for i, (name, w) in enumerate(zip(names, weights, strict=True)):
        some = np.flatnonzero(left)
        u = np.array([int(hashlib.md5(f"{seed}:{replicates[r]}:{name}".encode()).hexdigest()[:13], 16) / (1 << 52) for r in some])
        out[some, i] = binomial(u, left[some], w / weight_left)
        left, weight_left = left - out[:, i], weight_left - w
    return out


def _dealer(seed: object, names: Sequence[str], width: int, fields: Sequence[str]):
    """For a cogroup of replicates' totals and the children of one chunk: how often each replicate draws each child."""

    def deal(left, right):
        if not left.num_rows or not right.num_rows:
            kinds = [right.schema.field(f).type for f in fields[:width]] + [pa.int64()] + [right.schema.field(n).type for n in names] + [pa.int64()]
            return pa.table([pa.array([], k) for k in kinds], names=fields)
        right = right.take(pc.sort_indices(right, [(n, "ascending") for n in (*names, "__name")], null_placement="at_start"))
        got = multinomial(seed, left["replicate"].to_pylist(), left["__times"].to_numpy(), right["__name"].to_pylist(), right["__w"].to_pylist())
        replicate, child = np.nonzero(got)
        picked = right.take(pa.array(child))
        return pa.table([*(picked[f] for f in fields[:width]), left["replicate"].take(pa.array(replicate)), *(picked[n] for n in names), pa.array(got[replicate, child])], names=fields)

    return deal


def _name(columns: Sequence[str]) -> Column:
    return F.concat_ws(":", *(F.coalesce(col(c).cast("string"), F.lit("-")) for c in columns)) if columns else F.lit("")


def draws(df: DataFrame, replicates: int, cells: Sequence[str], groups: Sequence[str], strata: Sequence[str], seed: object) -> DataFrame:
    """(*groups, replicate, *cells, __times): `replicates` draws with replacement of as many rows as each group has, rows equal in
    `cells` counted together.

    `strata` are those of `groups` whose values enter the uniform numbers. Null cells and groups are values like others;
    an empty table gives no draws."""
    groups, cells = list(groups), [c for c in cells if c not in groups]
    rows = df.groupBy(*map(col, [*groups, *cells])).agg(F.count("*").alias("__w"))
    rows = cut(rows.withColumn("__name", _name([*strata, *cells])))
    sizes = cut(rows.groupBy(*map(col, groups)).agg(F.count("*").alias("__cells"), F.sum("__w").alias("__n")))
    most = sizes.agg(F.max("__cells")).first()[0]
    kinds = {f.name: f for f in rows.schema.fields}
    key = [kinds[g] for g in groups]

    def same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        """Joins on the groups, a null being a group like any other."""
        renamed = right.select(*(col(g).alias(f"__g_{i}") for i, g in enumerate(groups)), *(c for c in right.columns if c not in groups))
        on = F.lit(True)
        for i, g in enumerate(groups):
            on &= col(g).eqNullSafe(F.col(f"__g_{i}"))
        return left.join(renamed, on, how).drop(*(f"__g_{i}" for i in range(len(groups))))

    # levels[0] holds cells and their chunk, levels[1] chunks and theirs, ... until every group has one chunk
    chunks = F.ceil(F.col("__cells") / CHUNK).cast("long")
    at = F.pmod(F.xxhash64("__name", *map(col, cells)), chunks)
    levels = [same(rows, sizes.select(*map(col, groups), "__cells"), "inner").withColumn("__node", at).drop("__cells")]
    while most is not None and most > CHUNK:
        most = -(-most // CHUNK)
        below = levels[-1].groupBy(*map(col, groups), "__node").agg(F.sum("__w").alias("__w")).withColumnRenamed("__node", "__child")
        name = F.concat_ws(":", _name(strata), F.lit(f"chunk {len(levels)}"), F.col("__child"))
        levels.append(cut(below.withColumns({"__name": name, "__node": F.floor(F.col("__child") / CHUNK).cast("long")})))

    # aliased, so that the sides of the cogroup share no attributes
    now = sizes.select(*(col(g).alias(g) for g in groups), F.lit(0).cast("long").alias("__node"), F.col("__n").alias("__times"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long"))).alias("replicate"))
    for i in reversed(range(len(levels))):
        names = ["__child"] if i else cells
        out = StructType([*key, StructField("replicate", LongType()), *(StructField("__child", LongType()) if i else kinds[c] for c in names), StructField("__times", LongType())])
        now = now.withColumn("__range", F.col("replicate") % RANGES)
        wide = levels[i].withColumn("__range", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(RANGES, replicates) - 1).cast("long"))))
        by = [*groups, "__node", "__range"]

        now = now.groupBy(*map(col, by)).cogroup(wide.groupBy(*map(col, by))).applyInArrow(_dealer(seed, names, len(groups), out.names), out)
        if i:
            now = cut(now.withColumnRenamed("__child", "__node"))
    return now

