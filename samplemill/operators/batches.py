"""Rows to batches of vectors and back; padding and cropping."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, need
from .base import op


@op
def collate(df: DataFrame, batch: str, order: str, keys: Sequence[str] | None = None, skip: Sequence[str] = (), handlers: Mapping[str, Callable[[Column], Column]] | None = None, after: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """(batch, each key as a list in the order's order); nulls keep their places. A handler makes a key's value from its
    list; the steps in `after` see the whole batch table."""
    keys = [c for c in df.columns if c not in (batch, *skip)] if keys is None else list(keys)
    need(df, batch, order, *keys)
    rows = F.array_sort(F.collect_list(F.struct(col(order).alias("__o"), *(col(k).alias(f"k{i}") for i, k in enumerate(keys))))).alias("__r")
    out = df.groupBy(col(batch).alias(batch)).agg(rows)
    own = handlers or {}
    need(df, *own)
    out = out.select(col(batch), *(own.get(k, lambda v: v)(col("__r").getField(f"k{i}")).alias(k) for i, k in enumerate(keys)))
    for step in after:
        out = step(out)
    return out


@op
def uncollate(df: DataFrame, keys: Sequence[str], place: str = "place") -> DataFrame:
    """One row per element of the vectors `keys`; other columns repeat."""
    rest = [c for c in df.columns if c not in keys]
    zipped = F.posexplode(F.arrays_zip(*(col(k).alias(f"k{i}") for i, k in enumerate(keys)))).alias(place, "__x")
    return df.select(*map(col, rest), zipped).select(*map(col, rest), col(place).cast("long").alias(place), *(F.col("__x")[f"k{i}"].alias(k) for i, k in enumerate(keys)))


def padded(vector: Column, length: Column, fill) -> Column:
    """Padded on the right to `length`; a longer vector stays."""
    return F.concat(vector, F.array_repeat(F.lit(fill), F.greatest(length - F.size(vector), F.lit(0))))


@op
def pad_batch(df: DataFrame, key: str, fill=0, least: int = 0) -> DataFrame:
    """Every vector of a batch (a list of vectors) padded to the longest, or to `least`."""
    n = F.greatest(F.array_max(F.transform(col(key), lambda v: F.size(v))), F.lit(least))
    return df.withColumn(key, F.transform(col(key), lambda v: padded(v, n, fill)))


@op
def crop_padding(df: DataFrame, key: str, fill=0) -> DataFrame:
    """Every vector of a batch cut to the largest number of elements that are not padding."""
    n = F.array_max(F.transform(col(key), lambda v: F.size(F.filter(v, lambda x: x != F.lit(fill)))))
    return df.withColumn(key, F.transform(col(key), lambda v: F.slice(v, F.lit(1), n)))


@op
def crop_like(df: DataFrame, target: str, *keys: str) -> DataFrame:
    """Vectors of the batch's other keys cut to the length of the target's first."""
    n = F.size(F.get(col(target), F.lit(0)))
    return df.withColumns({k: F.transform(col(k), lambda v: F.slice(v, F.lit(1), n)) for k in keys})
