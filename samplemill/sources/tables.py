"""Reading, writing and aligning tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, need
from ..functions.storage import cut


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """A table by its suffix: csv, tsv, json, txt, orc or parquet (also for a folder without suffix)."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "parquet"
    if kind in ("csv", "tsv"):
        return spark.read.csv(path, **({"header": True, "inferSchema": True, "sep": "\t" if kind == "tsv" else ","} | options))
    if kind in ("json", "jsonl"):
        return spark.read.json(path, **options)
    if kind in ("txt", "md"):
        return spark.read.text(path, **options)
    if kind in ("parquet", "orc"):
        return getattr(spark.read, kind)(path, **options)
    raise ValueError(f"no reader for {path!r}")


def autodetect(spark: SparkSession, source: DataFrame | Sequence | str, column: str = "sample_desc") -> DataFrame:
    """Sample descriptors from a table as it is, a list of values, a text file of one a line (stripped), or any file that read_table() reads."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, str):
        if source.lower().rsplit(".", 1)[-1] in ("txt", "text"):
            return spark.read.text(source).select(F.trim("value").alias(column))
        return read_table(spark, source)
    values = list(source)
    return spark.createDataFrame([(v,) for v in values], [column]) if values else spark.createDataFrame([], f"{column} string")


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Writes by suffix as read_table reads; Spark's commit makes the output whole or absent."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "parquet"
    if kind in ("csv", "tsv"):
        df.write.csv(path, header=True, sep="\t" if kind == "tsv" else ",", mode=mode)
    elif kind in ("json", "jsonl"):
        df.write.json(path, mode=mode)
    elif kind in ("parquet", "orc"):
        getattr(df.write, kind)(path, mode=mode)
    else:
        raise ValueError(f"no writer for {path!r}")


def read_folder(spark: SparkSession, folder: str, suffix: str = "*.txt", sep: str = ",", key: str = "sample_id") -> DataFrame:
    """Many small delimited files with headers as one table; `key` is the file's name without suffix."""
    rows = spark.read.csv(f"{folder}/{suffix}", header=True, inferSchema=True, sep=sep)
    return rows.withColumn(key, F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1))


def indexed(df: DataFrame, key: str = "sample_id") -> DataFrame:
    """Ids 0, 1, ... in the table's order."""
    rows = df.select(F.struct(*map(col, df.columns)).alias("r"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    sizes = {r.p: r.n for r in rows.groupBy("p").agg(F.count("*").alias("n")).collect()}
    starts, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(at)
        at += sizes.get(p, 0)
    start = F.element_at(F.array(*map(F.lit, starts or [0])), F.col("p") + 1)
    return rows.select((start + F.col("m").bitwiseAND((1 << 33) - 1)).cast("long").alias(key), "r.*")


#: Keys at most that a table's rows are sent to all tasks for: each holds more than 1 / HOT_KEYS of the other side's rows.
HOT_KEYS = 10_000


def look_up_in(many: DataFrame, one: DataFrame, keys: Sequence[str], rows: int = 200_000) -> DataFrame:
    """Left join with a table of one row a key, whatever the keys' frequencies.

    A table that is counted to have few rows travels whole. Of a larger one the rows of hot keys do, of which
    there are HOT_KEYS at most by their definition; the other keys meet in a shuffle, in which none is hot."""
    if one.limit(rows + 1).count() <= rows:
        return many.join(F.broadcast(one), list(keys), "left")
    total = many.count()
    hot = many.groupBy(*map(col, keys)).agg(F.count("*").alias("__n")).where(F.col("__n") > total / HOT_KEYS).drop("__n")
    near = cut(hot.join(one, list(keys), "left").withColumn("__hot", F.lit(True)))
    marked = many.join(F.broadcast(near), list(keys), "left")
    own = [c for c in one.columns if c not in keys]
    # null keys find nothing, and are not shuffled to find it
    none = F.lit(False)
    for k in keys:
        none |= col(k).isNull()
    cold = marked.where(F.col("__hot").isNull() & ~none).drop("__hot", *own).join(one, list(keys), "left")
    return marked.where(F.col("__hot") | none).drop("__hot").unionByName(cold)


def projected(table: DataFrame, columns: Sequence[str] | None, rename: Mapping[str, str] | None) -> DataFrame:
    """Chooses columns by their old names, then renames."""
    if columns is not None:
        need(table, *columns)
        table = table.select(*map(col, columns))
    return table.withColumnsRenamed(dict(rename or {}))


def guarded(df: DataFrame, bad: Column, message: Column) -> DataFrame:
    """The rows of `df`; one that is `bad` stops the query with the message."""
    return df.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def lookup(samples: DataFrame, table: DataFrame, key: str = "data.sample_id", key_column: str = "sample_id", columns: Sequence[str] | None = None, rename: Mapping[str, str] | None = None, prefix: str | None = None, drop_key: bool = True, strict: bool = True) -> DataFrame:
    """Adds the table's row of the sample's key to each sample; `key_column` is the name after renaming.

    A key that the table lacks stops the query, unless not `strict`: then its columns are null.
    Spark chooses the join by the table's size."""
    table = projected(table, columns, rename)
    need(table, key_column)
    name = (lambda c: f"{prefix}.{c}") if prefix else (lambda c: c)
    right = table.select(col(key_column).alias("__key"), *(col(c).alias(name(c)) for c in table.columns if not (drop_key and c == key_column)), F.lit(True).alias("__found"))
    out = samples.drop(*(c for c in right.columns if c in samples.columns)).join(right, col(key) == F.col("__key"), "left")
    if strict:
        out = guarded(out, F.col("__found").isNull(), F.concat(F.lit("no row for key "), F.coalesce(col(key).cast("string"), F.lit("null"))))
    return out.drop("__key", "__found")


def lookup_many(samples: DataFrame, table: DataFrame, columns: Sequence[str], keys: int, key: str = "data.sample_id", key_column: str = "sample_id", separator: str = "@SEP@") -> DataFrame:
    """For ids that hold `keys` keys joined by the separator: the i-th key's row as <column>.<i>."""
    parts = F.split(col(key), F.lit("\\Q" + separator + "\\E"))
    long = samples.select(col(key).alias("__id"), F.posexplode(parts).alias("__at", "__part")).distinct()
    right = table.select(col(key_column).cast("string").alias("__part"), F.struct(*(col(c).alias(c) for c in columns)).alias("__row"), F.lit(True).alias("__found"))
    found = guarded(long.join(right, "__part", "left"), F.col("__found").isNull(), F.concat(F.lit("no row for key "), F.col("__part")))
    wide = found.groupBy("__id").agg(*(F.max(F.when(F.col("__at") == i, F.col("__row")[c])).alias(f"{c}.{i}") for i in range(keys) for c in columns))
    return samples.join(wide, col(key) == F.col("__id"), "left").drop("__id")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of ids that stand more than once."""
    return df.groupBy(col(key).alias(key)).agg(F.count("*").alias("n")).where("n > 1")


def union_folds(folds: Sequence[DataFrame], fold: str = "evaluator_fold") -> DataFrame:
    """One table of several folds' rows, each with its fold's number."""
    out = None
    for i, f in enumerate(folds):
        f = f.withColumn(fold, F.lit(i).cast("long"))
        out = f if out is None else out.unionByName(f)
    return out


def align(sources: Mapping[str, DataFrame], key: str, strict: bool = True) -> DataFrame:
    """Joins sources by id; their columns get the beginning `<source>.`.

    Strict: an id that a source lacks stops the query. Else its columns are null there. An id twice in one
    source stops the query in either case."""
    out = None
    for name, df in sources.items():
        rest = [c for c in df.columns if c != key]
        one = df.groupBy(col(key).alias(key)).agg(F.count("*").alias("__n"), *(F.first(col(c)).alias(f"{name}.{c}") for c in rest))
        one = guarded(one, F.col("__n") > 1, F.concat(F.lit(f"{name}: repeated id "), col(key).cast("string"))).drop("__n").withColumn(f"__in_{name}", F.lit(True))
        out = one if out is None else out.join(one, key, "full_outer")
    marks = [f"__in_{n}" for n in sources]
    if strict:
        missing = F.concat_ws(",", *(F.when(F.col(m).isNull(), F.lit(m[5:])) for m in marks))
        out = guarded(out, missing != "", F.concat(F.lit("id "), col(key).cast("string"), F.lit(" is missing in "), missing))
    return out.drop(*marks)


def restrict(df: DataFrame, ids: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """The rows with a listed id; strict: a listed id without a row stops the query."""
    ids = ids.select(col(key).alias(key)).distinct()
    if not strict:
        return df.join(ids, key, "left_semi")
    return guarded(ids.join(df.withColumn("__in", F.lit(True)), key, "left"), F.col("__in").isNull(), F.concat(F.lit("no row for id "), col(key).cast("string"))).drop("__in")


def missing_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return ids.select(col(key).alias(key)).distinct().join(df, key, "left_anti")


def merge_outer(left: DataFrame, right: DataFrame, on: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Full outer join, then rows without nulls in `required`."""
    out = left.join(right, list(on), "full_outer")
    return out.dropna("any", subset=list(required)) if required else out
