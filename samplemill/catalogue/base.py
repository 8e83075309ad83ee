"""Registration, and the tables that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col, softmax
from ..sources.tables import align

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers f(read), read being table name -> DataFrame, under f's name."""

    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles (all, if none are named) at `digits` places, without -0."""
    names = names or tuple(n for n, t in df.dtypes if t == "double")
    return df.withColumns({n: F.round(col(n), digits) + F.lit(0.0) for n in names})


def rounded_vector(name: str, digits: int = 6):
    return F.transform(col(name), lambda x: F.round(x.cast("double"), digits) + F.lit(0.0)).alias(name)


def predictions(read) -> DataFrame:
    """doc_id, lang, quality, toxic and two scores: labels and documents joined by id; scores are arithmetic on ids."""
    both = align({"l": read("labels"), "d": read("documents").select("doc_id", "lang").join(read("labels").select("doc_id"), "doc_id", "left_semi")}, "doc_id")
    rows = both.select("doc_id", col("d.lang").alias("lang"), col("l.quality").cast("long").alias("quality"), col("l.toxic").cast("long").alias("toxic"))
    return rows.withColumns({"p": ((F.col("doc_id") * 7919 + F.col("quality") * 311) % 1000).cast("double") / F.lit(1000.0), "p2": ((F.col("doc_id") * 104729 + F.col("quality") * 173) % 1000).cast("double") / F.lit(1000.0)})


S = "WITH s AS (SELECT l.doc_id, d.lang, CAST(quality AS BIGINT) quality, CAST(toxic AS BIGINT) toxic, CAST((l.doc_id*7919+quality*311)%1000 AS DOUBLE)/1000e0 p, CAST((l.doc_id*104729+quality*173)%1000 AS DOUBLE)/1000e0 p2 FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"


def class_probabilities(read) -> DataFrame:
    """vec_id, label and ten probabilities."""
    return read("embeddings").select("vec_id", F.col("label").cast("long").alias("label"), softmax(F.slice("embedding", 1, 10)).alias("probs"))


E = """WITH e0 AS (SELECT vec_id, CAST(label AS BIGINT) AS label, list_transform(embedding[1:10], lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding[1:10]) AS DOUBLE))) AS ex FROM embeddings),
e AS (SELECT vec_id, label, list_transform(ex, lambda x: x / list_sum(ex)) AS probs FROM e0)"""


def auc_sql(rows: str, score: str = "p", target: str = "y", by: str = "") -> str:
    """Area from mid-ranks over the relation `rows`."""
    part = f"PARTITION BY {by}" if by else ""
    tie = f"{by}, {score}" if by else score
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""SELECT {head}(sum(CASE WHEN y1 = 1 THEN r END) - sum(y1) * (sum(y1) + 1) / 2e0) / nullif(CAST(sum(y1) AS DOUBLE) * (count(*) - sum(y1)), 0) AS auc
FROM (SELECT *, CASE WHEN {target} = 1 THEN 1e0 ELSE 0e0 END AS y1, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER (PARTITION BY {tie}) - 1) / 2e0 AS r FROM {rows}){tail}"""


def uniform_sql(seed: str, *keys: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 13)) AS BIGINT) / 4503599627370496e0)"
