"""The corpus pipeline: toxic documents go, one document of each near-duplicate group
stays, repeated passages go, personal data is replaced, and what is left is packed.

Each stage takes (spark, docs, sf_dir), works on all rows of `docs` and keeps the columns of
documents (the last returns pieces in sequences). Extra columns are carried along under their own names.
Null texts count as empty. Rows without doc_id are judged by their text but never dropped as near
duplicates. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplemill.llm import minhash, packing, pii, suffix, toxicity
from samplemill.llm.spark_io import carry, cut, key_filter, within

#: Key of the surrogates: this one is for tests, as anyone can read it here; a corpus to be given away needs a secret one.
PII_KEY = b"a key for tests"
#: Similarity of near duplicates in hundredths, on sets of five words; op9_minhash's own contract is 85.
NEAR_PERCENT = 80


def _rewritten(docs: DataFrame, text, names: dict[str, str]) -> DataFrame:
    """doc_id, the new text and what was carried; n_chars follows the text."""
    columns = [F.col(n) if c != "n_chars" else F.length("text").cast(dict(docs.dtypes)[n]) for n, c in names.items()]
    return docs.select("doc_id", text.alias("text"), *names).select("doc_id", "text", *(v.alias(c) for v, c in zip(columns, names.values(), strict=True)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the segment model, fitted on the labelled ones, scores under 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near duplicates (a similarity of NEAR_PERCENT or more); a repeated row stays once."""
    key = F.xxhash64(docs["doc_id"].isNull(), docs["doc_id"], docs["text"])
    # rows that share one hash by chance differ in the other and are not taken for repeats
    again = F.xxhash64(F.lit("again"), docs["doc_id"].isNull(), docs["doc_id"], docs["text"])
    keyed = docs.withColumns({"__key": key, "__again": again})
    names = keyed.select(F.col("__key").alias("key"), docs["doc_id"])
    # equal rows are one; rows of one id with different texts are documents of their own
    classes = minhash.near_duplicates(keyed.where(docs["doc_id"].isNotNull()).select(F.col("__key").alias("doc_id"), "text"), percent=NEAR_PERCENT)
    members = cut(classes.select(F.col("doc_id").alias("key"), "component_id").distinct().join(names.distinct(), "key"))
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("m")).select("m.key")
    dropped = cut(members.select("key").join(first, "key", "left_anti"))
    repeated = names.groupBy("key").count().where("count > 1").select("key")
    # texts that neither repeat nor go are not moved
    some = within(key_filter(cut(dropped.unionByName(repeated).distinct())), F.col("__key"))
    keyed = keyed.withColumn("__some", some)
    moved = keyed.where("__some").join(dropped.withColumnRenamed("key", "__key"), "__key", "left_anti").dropDuplicates(["__key", "__again"])
    return keyed.where("not __some").select(*docs.columns).unionByName(moved.select(*docs.columns))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of suffix.LENGTH bytes and without the words of runs of more than 50 words that stand elsewhere too."""
    renamed, names = carry(docs)
    return _rewritten(suffix.deduplicate_words(renamed, keep=tuple(names), length=suffix.LENGTH), F.make_valid_utf8(F.col("kept").cast("string")), names)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with keyed surrogates in place of personal data."""
    renamed, names = carry(docs)
    return _rewritten(pii.replace(renamed, PII_KEY, keep=tuple(names)), F.col("text"), names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of several lengths."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeats),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
