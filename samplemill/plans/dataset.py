"""Datasets: ids, a static pipeline that may be stored, and a dynamic one."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, need, uniform
from ..operators.control import ID, INITIAL
from .pipeline import Pipeline


def from_ids(ids: DataFrame, column: str) -> DataFrame:
    """Samples of explicit ids."""
    return ids.select(col(column).alias(ID), col(column).alias(INITIAL))


def from_count(spark: SparkSession, n: int) -> DataFrame:
    """Samples 0 to n - 1."""
    return spark.range(n).select(F.col("id").alias(ID), F.col("id").alias(INITIAL))


def sample_digest(samples: DataFrame, key: str = ID) -> str:
    """Columns, number of rows and a sum of the ids' hashes: two numbers reach the driver."""
    ids = F.xxhash64(col(key)) if key in samples.columns else F.xxhash64(*map(col, samples.columns))
    n, total = samples.agg(F.count("*"), F.coalesce(F.sum(ids.cast("decimal(38,0)")), F.lit(0))).first()
    return f"{','.join(f'{c} {t}' for c, t in samples.dtypes)}|{n}|{total}"


def get_multi(samples: DataFrame, items: DataFrame, keys: Sequence[str] | None = None, key: str = ID) -> DataFrame:
    """(i, the id, keys): the samples of `items` (i, item) in that order's numbers, with repeats; all keys if none are
    named. An item without a sample stops the query."""
    own = export(samples, keys, key)
    out = items.select("i", col("item").alias("__item")).join(own, F.col("__item") == col(key), "left")
    missing = F.concat(F.lit("no sample "), F.col("__item").cast("string"))
    return out.withColumn(key, F.when(col(key).isNotNull(), col(key)).otherwise(F.raise_error(missing))).drop("__item")


def with_final_ids(samples: DataFrame, ids: DataFrame, key: str = ID) -> DataFrame:
    """The samples whose ids are in a table of final ids, nothing being processed again."""
    return samples.join(ids.select(col(key).alias(key)).distinct(), key, "left_semi")


class Cache:
    """Tables of a pipeline's output in a shared folder, each with a manifest of the pipeline's fingerprint."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _manifest(self, name: str) -> dict | None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/manifest")
        if not path.getFileSystem(conf).exists(path):
            return None
        return json.loads(self.spark.read.text(f"{self._path(name)}/manifest").first()[0])

    def get(self, name: str, pipeline: Pipeline, samples: DataFrame, restart: bool = False) -> DataFrame:
        """The pipeline's output, read if it is stored, else made and stored. Another pipeline, or other samples (by their
        columns, number and ids), under the same name is an error, unless `restart` overwrites it."""
        had = self._manifest(name)
        digest = sample_digest(samples)
        if had and had["fingerprint"] != pipeline.fingerprint and not restart:
            raise ValueError(f"{name!r} holds the output of another pipeline: {had['steps']}")
        if had and had.get("samples") != digest and not restart:
            raise ValueError(f"{name!r} holds the output of other samples")
        at = f"{self._path(name)}/data"
        if not had or restart:
            pipeline(samples).write.mode("overwrite").parquet(at)
            text = json.dumps({"fingerprint": pipeline.fingerprint, "samples": digest, "steps": str(pipeline)})
            self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self._path(name)}/manifest")
        return self.spark.read.parquet(at)


class Growing:
    """A pipeline's output that grows with its samples: parts, each of the ids that were new when it was made.

    A part is written in three steps: output, initial ids, and a manifest last; a part without manifest does not count and
    is written again. Several folders can hold parts of one dataset: the first is written, the others are read only."""

    def __init__(self, spark: SparkSession, folder: str, *others: str, key: str = ID) -> None:
        self.spark, self.folders, self.key = spark, [f.rstrip("/") for f in (folder, *others)], key

    def _listed(self, folder: str) -> list[str]:
        """Names below a folder, by the file system that holds it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def parts(self) -> list[dict]:
        """The manifests of whole parts: folder, part, fingerprint, steps, columns, rows, ids."""
        out = []
        for folder in self.folders:
            numbers = sorted(int(n.split("=")[1]) for n in self._listed(f"{folder}/manifests") if n.startswith("part="))
            whole = [n for n in numbers if "_SUCCESS" in self._listed(f"{folder}/manifests/part={n}")]
            if whole:
                texts = self.spark.read.text([f"{folder}/manifests/part={n}" for n in whole]).collect()
                out += sorted((json.loads(t[0]) for t in texts), key=lambda m: m["part"])
        return out

    def _paths(self, kind: str) -> list[str]:
        return [f"{m['folder']}/{kind}/part={m['part']}" for m in self.parts()]

    def known(self) -> DataFrame | None:
        """The initial ids of all parts."""
        paths = self._paths("ids")
        return self.spark.read.parquet(*paths) if paths else None

    def read(self, part: int | None = None) -> DataFrame:
        """The output of all parts (or of the first folder's `part`)."""
        paths = self._paths("data") if part is None else [f"{self.folders[0]}/data/part={part}"]
        if not paths:
            raise ValueError(f"nothing is stored in {self.folders}")
        return self.spark.read.parquet(*paths)

    def add(self, pipeline: Pipeline, samples: DataFrame) -> dict | None:
        """Runs the pipeline for the samples whose ids no part has, and stores their output as a new part; its manifest, or nothing if
        no id is new. Another pipeline, or output of other columns, than the parts' is an error. Samples without id stop it."""
        had = self.parts()
        if had and had[0]["fingerprint"] != pipeline.fingerprint:
            raise ValueError(f"the parts hold the output of another pipeline: {had[0]['steps']}")
        samples = samples.withColumn(self.key, F.coalesce(col(self.key), F.raise_error(F.lit("a sample has no id")).cast(samples.schema[self.key].dataType)))
        known = self.known()
        new = samples if known is None else samples.join(known, self.key, "left_anti")
        folder = self.folders[0]
        part = max((m["part"] for m in had if m["folder"] == folder), default=-1) + 1
        new.select(col(self.key)).distinct().write.mode("overwrite").parquet(f"{folder}/ids/part={part}")
        ids = self.spark.read.parquet(f"{folder}/ids/part={part}")
        n = ids.count()
        if not n:
            return None
        # the stored ids decide, not a second look at what is known
        out = pipeline(samples.join(ids, self.key, "left_semi"))
        columns = [f"{c} {t}" for c, t in out.dtypes]
        if had and had[0]["columns"] != columns:
            raise ValueError(f"the parts have other columns: {had[0]['columns']}")
        out.write.mode("overwrite").parquet(f"{folder}/data/part={part}")
        rows = self.spark.read.parquet(f"{folder}/data/part={part}").count()
        made = {"folder": folder, "part": part, "fingerprint": pipeline.fingerprint, "steps": str(pipeline), "columns": columns, "rows": rows, "ids": n}
        self.spark.createDataFrame([(json.dumps(made),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifests/part={part}")
        return made

    def audit(self, pipeline: Pipeline, samples: DataFrame, share: float = 1.0, seed: object = 0) -> DataFrame:
        """(folder, part, checked, differing): the pipeline run again for a hashed share of each part's initial ids, compared with what the part
        holds; rows of one side only count as differing. Ids that two parts hold count in both."""
        out = None
        for m in self.parts():
            ids = self.spark.read.parquet(f"{m['folder']}/ids/part={m['part']}").where(uniform(seed, self.key) < F.lit(float(share)))
            stored = self.spark.read.parquet(f"{m['folder']}/data/part={m['part']}")
            # output rows belong to their initial id, which a step that splits samples keeps
            owner = INITIAL if INITIAL in stored.columns else self.key
            stored = stored.join(ids.select(col(self.key).alias("__id")), col(owner) == F.col("__id"), "left_semi")
            bad = differences(stored, pipeline(samples.join(ids, self.key, "left_semi"))).agg(F.count("*").alias("differing"))
            row = ids.agg(F.lit(m["folder"]).alias("folder"), F.lit(m["part"]).alias("part"), F.count("*").alias("checked")).join(bad)
            out = row if out is None else out.unionByName(row)
        if out is None:
            raise ValueError(f"nothing is stored in {self.folders}")
        return out


def differences(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of one side only, with `side`; NaN equals NaN. Empty when a cache is right."""
    fresh = fresh.select(*map(col, stored.columns))
    return stored.exceptAll(fresh).withColumn("side", F.lit("stored")).unionByName(fresh.exceptAll(stored).withColumn("side", F.lit("fresh")))


def audit(stored: DataFrame, pipeline: Pipeline, samples: DataFrame, share: float, seed: object = 0, key: str = ID) -> DataFrame:
    """Runs the pipeline again for a hashed share of the initial ids and compares."""
    lot = uniform(seed, INITIAL if INITIAL in samples.columns else key) < F.lit(float(share))
    kept = uniform(seed, INITIAL if INITIAL in stored.columns else key) < F.lit(float(share))
    return differences(stored.where(kept), pipeline(samples.where(lot)))


def export(df: DataFrame, keys: Sequence[str] | None = None, key: str = ID) -> DataFrame:
    """The id and the named key-paths (all, if none are named)."""
    keys = [c for c in df.columns if c != key] if keys is None else [k for k in keys if k != key]
    need(df, key, *keys)
    return Pipeline.without_undo(df.select(col(key), *map(col, keys)))


def subset(df: DataFrame, places: DataFrame, place: str = "data.place") -> DataFrame:
    """Samples by place with repeats: `places` has `at` (the place) and `i` (its position in the result)."""
    return places.join(df, F.col("at") == col(place))


def chunk_ranges(spark: SparkSession, n: int, size: int) -> DataFrame:
    """(start, end) of pieces of `size`."""
    return spark.range(0, n, size).select(F.col("id").alias("start"), F.least(F.col("id") + size, F.lit(n)).alias("end"))
