"""Queries of calibration by quantiles, tests, losses, mask forms, chained evaluations and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..metrics import classification as mc
from ..metrics import losses as ml
from ..metrics import masks as mm
from ..operators import batches as ob
from ..operators import tokens as tk
from ..plans.evaluator import Later, evaluate
from .base import E, S, class_probabilities, predictions, query, rounded
from .evaluation import C, classes


@query(f"""{E}, r AS (SELECT list_max(probs) AS conf, CASE WHEN list_position(probs, list_max(probs)) - 1 = label THEN 1e0 ELSE 0e0 END AS hit FROM e),
v AS (SELECT list_sort(list(conf)) AS v, count(*) AS n FROM r), q AS (SELECT i, n * i / 5e0 + 0.4e0 + 0.2e0 * i / 5e0 AS a, v, n FROM v, (SELECT unnest(range(6)) AS i)),
k AS (SELECT i, CAST(floor(greatest(1e0, least(a, n - 1))) AS BIGINT) AS k, a, v, n FROM q), d AS (SELECT i, (1e0 - greatest(0e0, least(a - k, 1e0))) * v[k] + greatest(0e0, least(a - k, 1e0)) * v[least(k + 1, n)] AS edge FROM k),
b AS (SELECT i AS bin, edge AS low, lead(edge) OVER (ORDER BY i) AS high FROM d)
SELECT CAST(bin AS BIGINT) AS bin, round(low, 6) AS low, round(high, 6) AS high, count(conf) AS n, round(avg(hit), 6) AS accuracy, round(avg(conf), 6) AS mean_confidence FROM b LEFT JOIN r ON conf >= low AND conf < high WHERE bin < 5 GROUP BY bin, low, high""")
def reliability_quantiles(read):
    return rounded(mc.reliability_quantiles("probs", "label", 5)(class_probabilities(read), []))


@query(f"""{C}, k AS (SELECT lang, count_if(pred = quality AND pred2 = quality) AS "both", count_if(pred = quality AND pred2 <> quality) AS only1, count_if(pred <> quality AND pred2 = quality) AS only2, count_if(pred <> quality AND pred2 <> quality) AS none FROM c GROUP BY lang),
t AS (SELECT lang, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS tail FROM (SELECT lang, CAST(only1 + only2 AS DOUBLE) AS n, CAST(unnest(range(CAST(least(only1, only2) + 1 AS BIGINT))) AS DOUBLE) AS i FROM k) GROUP BY lang)
SELECT k.*, CAST(least(only1, only2) AS DOUBLE) AS statistic, round(least(1e0, 2 * tail), 6) AS p_value FROM k JOIN t USING (lang)""")
def mcnemar_exact(read):
    rows = classes(read).withColumns({"ok1": F.col("pred") == F.col("quality"), "ok2": F.col("pred2") == F.col("quality")})
    return rounded(mc.mcnemar_test("ok1", "ok2")(rows, ["lang"]), "p_value")


@query("WITH n AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1) SELECT label, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share, round(sum(n) OVER () / CAST(n * count(*) OVER () AS DOUBLE), 6) AS weight FROM n")
def class_weights(read):
    return rounded(ml.class_weights("event_type")(read("events"), []))


V = "WITH v AS (SELECT vec_id, CAST(label AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


@query(f"""{V}, p AS (SELECT vec_id, list_transform(e, lambda x: abs(x)) AS p, list_transform(e, lambda x: CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END) AS t FROM v)
SELECT vec_id, round(1e0 - (2e0 * list_sum(list_transform(list_zip(p, t), lambda z: z[1] * z[2])) + 1e-5) / (list_sum(p) + list_sum(t) + 1e-5), 6) AS loss FROM p""")
def binary_dice_loss(read):
    rows = read("embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("p"), F.transform("embedding", lambda x: (x > 0).cast("int")).alias("t"))
    return rounded(rows.select("vec_id", ml.binary_dice_loss("p", "t").alias("loss")))


@query(f"""{V}, x AS (SELECT label, e[1:10] AS x, list_transform(range(10), lambda i: CASE WHEN i = label THEN 0.9e0 ELSE 0.1e0 END) AS t FROM v), l AS (SELECT *, ln(list_sum(list_transform(x, lambda y: exp(y)))) AS n FROM x)
SELECT round(sum(list_sum(list_transform(list_zip(x, t), lambda z: z[2] * (n - z[1])))) / sum(list_sum(t)), 6) AS soft_cross_entropy FROM l""")
def soft_cross_entropy(read):
    rows = read("embeddings").select(F.slice("embedding", 1, 10).alias("x"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 0.9).otherwise(0.1)).alias("t"))
    return rounded(ml.soft_cross_entropy("x", "t")(rows, []))


@query(f"""{V}, f AS (SELECT vec_id, vec_id // 16 AS batch, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS f FROM v),
z AS (SELECT a.batch, a.vec_id, list_sum(list_transform(list_zip(a.f, b.f), lambda q: q[1] * q[2])) / 0.2e0 AS z, CASE WHEN a.label = b.label THEN 1e0 ELSE 0e0 END AS t FROM f a JOIN f b ON a.batch = b.batch),
s AS (SELECT batch, vec_id, ln(sum(exp(z))) AS norm, sum(t) AS n, sum(t * z) AS hit FROM z GROUP BY 1, 2) SELECT CAST(batch AS BIGINT) AS batch, round(sum(n * norm - hit) / sum(n), 6) AS contrastive FROM s GROUP BY batch""")
def supervised_contrastive(read):
    rows = read("embeddings").withColumn("b", F.floor(F.col("vec_id") / 16).cast("long"))
    return rounded(ml.contrastive("vec_id", "embedding", "label", "b")(rows, []))


@query("""WITH e AS (SELECT CAST(l_linenumber AS BIGINT) AS epoch, l_returnflag AS name, avg(CAST(l_discount AS DOUBLE)) AS value FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE WHEN name = 'N' THEN value ELSE -value END, epoch) AS b, row_number() OVER (PARTITION BY name ORDER BY epoch DESC) AS l FROM e)
SELECT name, max(CASE WHEN b = 1 THEN epoch END) AS best_epoch, round(max(CASE WHEN b = 1 THEN value END), 6) AS best, max(CASE WHEN l = 1 THEN epoch END) AS last_epoch, round(max(CASE WHEN l = 1 THEN value END), 6) AS last FROM r GROUP BY name""")
def epoch_summary(read):
    rows = read("lineitem").groupBy(F.col("l_linenumber").cast("long").alias("epoch"), F.col("l_returnflag").alias("name")).agg(F.avg(F.col("l_discount").cast("double")).alias("value"))
    return rounded(ml.epoch_summary(rows, falling=["N"]))


BITS = "WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS p, list_transform(embedding, lambda x: CASE WHEN x > 0.05 THEN 1 ELSE 0 END) AS t FROM embeddings), s AS (SELECT vec_id, CAST(list_sum(list_transform(list_zip(p, t), lambda z: z[1] * z[2])) AS DOUBLE) AS b, list_sum(p) AS p, list_sum(t) AS t FROM b)"


@query(f"{BITS} SELECT vec_id, round(coalesce(b / nullif(p + t - b, 0), 0), 6) AS iou, round(coalesce(b / nullif(p, 0), 0), 6) AS crowd FROM s")
def rle_iou(read):
    level = lambda edge: F.transform("embedding", lambda x: (x > F.lit(edge).cast("float")).cast("int"))
    rows = read("embeddings").select("vec_id", mm.mask_rle(level(0.0)).alias("p"), mm.mask_rle(level(0.05)).alias("t"))
    rows = rows.select("vec_id", mm.rle_mask(F.col("p")).alias("p"), mm.rle_mask(F.col("t")).alias("t"))
    return rounded(rows.select("vec_id", mm.vector_iou(F.col("p"), F.col("t")).alias("iou"), mm.vector_iou(F.col("p"), F.col("t"), crowd=True).alias("crowd")))


@query("""WITH t AS (SELECT p_partkey, 2e0 + p_partkey % 5 AS x0, 1e0 + p_partkey % 3 AS y0, 9e0 AS x1, 8e0 - p_partkey % 2 AS y1 FROM part), c AS (SELECT *, unnest(range(100)) AS i FROM t)
SELECT p_partkey, CAST(sum(CASE WHEN (i % 10) + 0.5e0 > x0 AND (i % 10) + 0.5e0 < x1 AND (i // 10) + 0.5e0 > y0 AND (i // 10) + 0.5e0 < y1 THEN 1 ELSE 0 END) AS BIGINT) AS area FROM c GROUP BY p_partkey""")
def polygon_area(read):
    k = F.col("p_partkey")
    x0, y0, x1, y1 = F.lit(2.0) + k % 5, F.lit(1.0) + k % 3, F.lit(9.0), F.lit(8.0) - k % 2
    corners = F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))
    rows = read("part").select("p_partkey", corners.alias("c"))
    return rows.select("p_partkey", F.aggregate(mm.polygon_mask(F.col("c"), 10, 10), F.lit(0).cast("long"), lambda a, x: a + x).alias("area"))


@query(f"{S}, m AS (SELECT lang, avg(CAST(quality AS DOUBLE)) AS share FROM s GROUP BY lang), r AS (SELECT lang, 'base' AS metric, 'share' AS name, share AS value FROM m UNION ALL SELECT s.lang, 'above', 'accuracy', avg(CASE WHEN (p > 1e0 - share) = (quality = 1) THEN 1e0 ELSE 0e0 END) FROM s JOIN m USING (lang) GROUP BY s.lang) SELECT metric, lang, name, round(value, 6) AS value FROM r")
def evaluation_chain(read):
    share = lambda df, by: df.groupBy(*by).agg(F.avg(F.col("quality").cast("double")).alias("share"))
    above = Later(("base.share",), lambda x: lambda df, by: mc.accuracy("said", "quality")(df.withColumn("said", (F.col("turned") < x).cast("long")), by))
    return rounded(evaluate(predictions(read), {"base": share, "above": above}, ["lang"], before=[lambda df: df.withColumn("turned", F.lit(1.0) - F.col("p"))], after=[lambda out: out.where("value is not null")]))


@query("SELECT l_orderkey AS b, CAST(sum(l_quantity) AS DOUBLE) AS q, list(l_partkey ORDER BY l_linenumber, l_partkey) AS l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 2")
def collate_handlers(read):
    rows = read("lineitem").select(F.col("l_orderkey").alias("b"), F.struct("l_linenumber", "l_partkey").alias("o"), "l_partkey", F.col("l_quantity").cast("double").alias("q"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    after = [lambda df: df.withColumn("n", F.size("l_partkey").cast("long")), lambda df: df.where("n > 2")]
    return ob.collate("b", "o", ["l_partkey", "q"], handlers={"q": total}, after=after)(rows)


PARTS = "WITH w AS (SELECT kind, token, id FROM (SELECT 'name' AS kind, p_name AS token, CAST(p_partkey + p_partkey % 2 AS BIGINT) AS id FROM part UNION ALL SELECT 'kind', p_type, CAST(p_partkey AS BIGINT) FROM part UNION ALL SELECT k, '<SENTINEL_ID_' || CAST(i AS VARCHAR) || '>', CAST(i + CASE WHEN k = 'name' AND i > 2 THEN 1 ELSE 0 END AS BIGINT) FROM (SELECT unnest(['name', 'kind']) AS k), (SELECT unnest(range(5)) AS i)))"


def parts(read):
    p = read("part")
    key = F.col("p_partkey").cast("long")
    both = p.select(F.lit("name").alias("kind"), F.col("p_name").alias("token"), (key + key % 2).alias("id")).unionByName(p.select(F.lit("kind").alias("kind"), F.col("p_type").alias("token"), key.alias("id")))
    marks = p.sparkSession.range(5).select(F.explode(F.array(F.lit("name"), F.lit("kind"))).alias("kind"), F.concat(F.lit("<SENTINEL_ID_"), F.col("id").cast("string"), F.lit(">")).alias("token"), F.col("id").alias("i"))
    return both.unionByName(marks.select("kind", "token", (F.col("i") + F.when((F.col("kind") == "name") & (F.col("i") > 2), 1).otherwise(0)).alias("id")))


@query(f"""{PARTS} SELECT 'special' AS "check", count(*) AS bad FROM (SELECT token FROM w WHERE token LIKE '<SENTINEL%' GROUP BY token HAVING count(DISTINCT id) > 1 OR count(DISTINCT kind) < 2)
UNION ALL SELECT 'duplicate', count(*) FROM (SELECT kind, id FROM w GROUP BY 1, 2 HAVING count(DISTINCT token) > 1) UNION ALL SELECT 'collision', count(*) FROM (SELECT id FROM w WHERE token NOT LIKE '<SENTINEL%' GROUP BY 1 HAVING count(DISTINCT kind) > 1)""")
def diagnose_vocabularies(read):
    return tk.diagnose(parts(read), [f"<SENTINEL_ID_{i}>" for i in range(5)])


@query(f"{PARTS} SELECT 0 AS least, 4 AS most, max(id) AS max_id FROM w")
def sentinel_range(read):
    return tk.sentinels(parts(read))


@query(f"{PARTS} SELECT q.p_partkey, q.token, w.id FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'none' ELSE p_name END AS token FROM part) q LEFT JOIN (SELECT token, min(id) AS id FROM w WHERE kind = 'name' GROUP BY token) w ON w.token = q.token")
def token_to_id(read):
    rows = read("part").select("p_partkey", F.lit("name").alias("kind"), F.when(F.col("p_partkey") % 3 == 0, "none").otherwise(F.col("p_name")).alias("token"))
    words = parts(read).groupBy("kind", "token").agg(F.min("id").alias("id"))
    return tk.look_up(rows, words, "token", "id").select("p_partkey", "token", "id")
