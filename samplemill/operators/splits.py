"""Folds and batches as pure functions of seed, id and place."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, uniform
from ..functions.running import numbered, placed
from ..functions.storage import cut
from ..metrics.base import join_groups


def part_of(place: Column, n: Column, parts: int) -> Column:
    """The part of a place when n things are cut into `parts`, the first n % parts of them one larger."""
    q, r = F.floor(n / parts), n % parts
    big = r * (q + 1)
    return F.when(place < big, F.floor(place / (q + 1))).otherwise(r + F.floor((place - big) / F.greatest(q, F.lit(1)))).cast("long")


def balanced_folds(df: DataFrame, key: str, balance: Sequence[str], folds: int, seed: object = 1357, excluded: DataFrame | None = None) -> DataFrame:
    """The rows with `fold`; rows of one `key` share theirs, and every combination of values that a key has is spread evenly.

    Keys of each combination are ordered by a hash and cut into parts. Excluded keys (a table of `key`) are left out."""
    if excluded is not None:
        df = df.join(excluded.select(col(key).alias(key)).distinct(), key, "left_anti")
    kind = F.concat_ws("|", *(F.array_join(F.array_sort(F.collect_set(F.coalesce(col(b).cast("string"), F.lit("null")))), ",") for b in balance))
    ids = df.groupBy(col(key).alias(key)).agg(kind.alias("__kind")).withColumn("__u", uniform(seed, key))
    # ties of the hash are broken by the key
    order = placed(ids, "__u", key, ["__kind"])
    ids = order.join(ids.groupBy("__kind").agg(F.count("*").alias("__n")), "__kind")
    return df.join(ids.select(col(key), part_of(F.col("place"), F.col("__n"), folds).alias("fold")), key)


def saved_folds(df: DataFrame, key: str, balance: Sequence[str], folds: int, path: str, seed: object = 1357, reset: bool = False) -> DataFrame:
    """As `balanced_folds`, the keys' folds being those stored at `path`. They are made and stored where there are none or with
    `reset`; stored folds that lack a key of the table stop the query."""
    spark = df.sparkSession
    try:
        stored = None if reset else spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    if stored is None:
        balanced_folds(df, key, balance, folds, seed).select(col(key), "fold").distinct().write.mode("overwrite").parquet(path)
        stored = spark.read.parquet(path)
    out = df.join(stored, key, "left")
    missing = F.concat(F.lit("no stored fold for "), col(key).cast("string"))
    return out.withColumn("fold", F.coalesce("fold", F.raise_error(missing).cast("long")))


def fold_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy("fold", *map(col, keys)).agg(F.count("*").alias("n"))


def kfold(df: DataFrame, key: str, folds: int, seed: object = 1234, shuffle: bool = True) -> DataFrame:
    """Contiguous parts of the hashed (or natural) order of the ids."""
    ids = cut(df.select(col(key).alias(key)).distinct().withColumn("__o", uniform(seed, key) if shuffle else col(key).cast("double")))
    order = placed(ids, "__o", key).select(col(key), part_of(F.col("place"), F.lit(ids.count()), folds).alias("fold"))
    return df.join(order, key)


def balanced_batches(df: DataFrame, key: str, label: str, per_class: Mapping[object, int], seed: object = 0, mode: str = "over") -> DataFrame:
    """(batch, slot, key, label): every batch has per_class[c] rows of class c.

    over: as many batches as the class that needs most; down: as the one that needs least. A class that runs out starts
    again in a new hashed order. Classes without a share are left out."""
    share = {c: k for c, k in per_class.items() if k > 0}
    sizes = {r[0]: r[1] for r in df.where(col(label).isin(list(share))).groupBy(col(label)).count().collect()}
    if not sizes:
        raise ValueError("no class has rows")
    need = {c: math.ceil(sizes[c] / share[c]) for c in sizes}
    batches = (max if mode == "over" else min)(need.values())
    epochs = {c: math.ceil(batches * share[c] / sizes[c]) for c in sizes}
    pick = lambda table: F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), col(label))
    rows = df.where(col(label).isin(list(sizes))).select(col(key), col(label)).withColumn("__epoch", F.explode(F.sequence(F.lit(0), (pick(epochs) - 1).cast("int"))))
    rows = rows.withColumn("__u", uniform(seed, F.col("__epoch"), col(key)))
    rows = placed(rows, "__u", key, [label, "__epoch"])
    at = F.col("__epoch") * pick(sizes) + F.col("place")
    out = rows.select(F.floor(at / pick(share)).cast("long").alias("batch"), (at % pick(share)).cast("long").alias("slot"), col(key), col(label))
    return out.where(F.col("batch") < batches)


def drawn_batches(df: DataFrame, key: str, label: str, weights: Mapping[object, float], batch: int, batches: int, seed: object = 0) -> DataFrame:
    """(batch, slot, key, label): each slot draws a class by weight and takes the class's next row in a hashed order,
    beginning again when it ends."""
    sizes = {r[0]: r[1] for r in df.groupBy(col(label)).count().collect() if weights.get(r[0], 0) > 0}
    classes = sorted(sizes)
    total = sum(weights[c] for c in classes)
    borders, at = [], 0.0
    for c in classes[:-1]:
        at += weights[c] / total
        borders.append(at)
    slots = df.sparkSession.range(batches * batch).select("id", uniform(f"{seed}/class", F.col("id")).alias("u"))
    named = slots.select("id", F.get(F.array(*map(F.lit, classes)), sum((F.when(F.col("u") >= b, 1).otherwise(0) for b in borders), F.lit(0))).alias(label))
    turn = join_groups(named, numbered(named, "id", [label]), [label, "id"]).withColumnRenamed("place", "turn")
    size = F.element_at(F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv)), col(label))
    rows = df.where(col(label).isin(classes)).select(col(key), col(label)).withColumn("__u", uniform(seed, key))
    rows = placed(rows, "__u", key, [label]).select(col(key), col(label), F.col("place").alias("turn"))
    got = join_groups(turn.withColumn("turn", F.col("turn") % size), rows, [label, "turn"])
    return got.select(F.floor(F.col("id") / batch).cast("long").alias("batch"), (F.col("id") % batch).alias("slot"), col(key), col(label))
