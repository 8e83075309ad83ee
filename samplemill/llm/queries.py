"""The opN_ queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, bpe, licenses, lm, media, merkle, minhash, negatives, packing, pii, suffix, toxicity, warc


#: Key of the registered query only, which anyone can read here; real use brings a secret one.
TEST_KEY = b"a key for tests"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(read(spark, sf_dir, "documents")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace(read(spark, sf_dir, "documents"), TEST_KEY)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",")
    return out.select("doc_id", "text", "n_entities", kinds.alias("kinds"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(read(spark, sf_dir, "documents"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicate_both(read(spark, sf_dir, "documents"))


def op8_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where("doc_id % 100 = 0"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return merkle.proofs(merkle.manifest(docs, merkle.without_newlines(docs)))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).drop("intact")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.shifted_labels(negatives.usable(read(spark, sf_dir, "embeddings")))
    return negatives.mine(rows, F.col("id") % 100 == 0)


# bits of the id's decimal digits, the lowest of each byte first, go through the CRC's register
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: list_transform(range(8), lambda k: (ord(ch) >> CAST(k AS INTEGER)) & 1)))),
    lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


MERKLE = f"""WITH RECURSIVE l AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, {_leaf("text")} AS h, CASE WHEN {_CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS f FROM documents),
t AS (SELECT source, 0 AS lv, i, h, count(*) OVER (PARTITION BY source) AS n FROM l
  UNION ALL SELECT source, lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY source, lv, i // 3, n),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, lv AS top FROM t WHERE n = 1),
u AS (SELECT 0 AS lv, i, subroot AS h, count(*) OVER () AS n FROM s UNION ALL SELECT lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY lv, i // 3, n),
w AS (SELECT source, lv, i, h FROM t WHERE n > 1 UNION ALL SELECT s.source, s.top + u.lv, u.i, u.h FROM u CROSS JOIN s WHERE u.n > 1),
p AS (SELECT doc_id, l.source, l.i, 0 AS lv, l.f, '' AS proof, s.top, s.i AS si FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source
  UNION ALL SELECT doc_id, source, i, lv + 1, sha256(string_agg(CASE WHEN j = own THEN f ELSE h END, '' ORDER BY j)), proof || coalesce(string_agg(h, '' ORDER BY j) FILTER (WHERE j <> own), ''), top, si
  FROM (SELECT p.*, w.i AS j, w.h, CASE WHEN p.lv < top THEN p.i // CAST(pow(3, p.lv) AS BIGINT) ELSE si // CAST(pow(3, p.lv - top) AS BIGINT) END AS own FROM p JOIN w ON w.source IS NOT DISTINCT FROM p.source AND w.lv = p.lv
    AND w.i // 3 = CASE WHEN p.lv < top THEN p.i // CAST(pow(3, p.lv + 1) AS BIGINT) ELSE si // CAST(pow(3, p.lv - top + 1) AS BIGINT) END) GROUP BY doc_id, source, i, lv, f, proof, top, si),
r AS (SELECT h AS root, lv FROM u WHERE n = 1)
SELECT p.doc_id, l.h AS leaf, s.subroot, r.root, sha256(p.proof) AS proof_sha256, p.f AS folded_root, p.f = r.root AS verified
FROM p CROSS JOIN r JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN l ON l.source IS NOT DISTINCT FROM p.source AND l.i = p.i WHERE p.lv = p.top + r.lv"""


# 160 bits are eight times 20, which are four digits each
_BASE32 = "(SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31), 1), '' ORDER BY k) FROM (SELECT CAST(unnest(range(32)) AS INTEGER) AS k))"
WARC = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM p"""

NEGATIVES = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM n WHERE rank <= 5"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_packing, op3_licenses, op4_pii, op5_lm, op6_media, op7_suffix, op8_bm25, op9_minhash, op10_bpe, op11_merkle, op12_warc, op13_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle": MERKLE, "op12_warc": WARC, "op13_negatives": NEGATIVES}
