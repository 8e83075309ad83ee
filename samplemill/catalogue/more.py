"""Queries of samplers, repeated and typed steps, vectors, masks, cross-validation and small texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import col, on_all, top_level
from ..metrics import classification as mc
from ..metrics import masks as mm
from ..operators import batches as ob
from ..operators import control as oc
from ..operators import events as ev
from ..operators import samples as so
from ..operators import tokens as tk
from ..operators.base import Op
from ..plans.crossval import PREDICTION, cross_validate, fold_report, group_folds
from ..plans.evaluator import with_interval
from ..plans.pipeline import described
from ..streaming import incremental as inc
from .base import S, predictions, query, rounded, rounded_vector, uniform_sql
from .evaluation import CURVE, MASK, masks, weighted
from .sequences import D, daily


def take(**values) -> Op:
    """A step that stores its parameters."""
    return Op("take", (), lambda df: df.withColumns(values))


def _u(place: str, key: str = "o_orderkey") -> str:
    return uniform_sql(f"5/.{place}", key)


@query(f"""SELECT o_orderkey, round(2 + {_u('a/u')} * 3, 6) AS a, CAST(-2 + floor({_u('b/u')} * 8) AS BIGINT) AS b, {_u('c/u')} <= 0.3e0 AS c, CASE WHEN {_u('d/u')} >= 0.75e0 THEN 'z' WHEN {_u('d/u')} >= 0.25e0 THEN 'y' ELSE 'x' END AS d,
[[1, 2, 3][1 + CAST({_u('e/0')} >= 1 / 3e0 AS INT) + CAST({_u('e/0')} >= 2 / 3e0 AS INT)], [1, 2, 3][1 + CAST({_u('e/1')} >= 1 / 3e0 AS INT) + CAST({_u('e/1')} >= 2 / 3e0 AS INT)]] AS e, round(1 + 0.5e0 * sqrt(-2 * ln(1 - {_u('f/0a')})) * cos({_u('f/0b')} * 6.283185307179586e0), 6) + 0e0 AS f FROM orders""")
def samplers(read):
    step = oc.sample(take, 5, "o_orderkey", a=oc.Uniform(2, 5), b=oc.RandInt(-2, 5), c=oc.RandBool(0.3), d=oc.Choice(("x", "y", "z"), (1.0, 2.0, 1.0)), e=oc.Choice((1, 2, 3), k=2), f=oc.Gaussian(1, 0.5))
    return rounded(step(read("orders").select("o_orderkey")), "a", "f")


@query(f"SELECT o_orderkey, [10, 20, 30, 40][1 + CAST({uniform_sql('6', 'o_orderkey')} >= 0.25e0 AS INT) + CAST({uniform_sql('6', 'o_orderkey')} >= 0.5e0 AS INT) + CAST({uniform_sql('6', 'o_orderkey')} >= 0.75e0 AS INT)] AS x FROM orders")
def random_choice(read):
    return oc.random_choice("x", [10, 20, 30, 40], 6, "o_orderkey")(read("orders").select("o_orderkey"))


@query("SELECT l_orderkey, l_linenumber, round((CAST(l_quantity AS DOUBLE) - 5) / 3, 6) AS a, round((CAST(l_discount AS DOUBLE) - 5) / 2, 6) + 0e0 AS b FROM lineitem")
def repeat_step(read):
    rows = read("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("a"), F.col("l_discount").cast("double").alias("b"))
    return rounded(oc.repeat(so.zscore, [{"key": "a"}, {"key": "b", "std": 2.0}], mean=5.0, std=3.0)(rows), "a", "b")


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 1 ELSE 0 END AS \"label.nation\", round(least(greatest(CAST(s_acctbal AS DOUBLE), 0), 5000) / 5000, 6) + 0e0 AS \"image.balance\", s_name AS other FROM supplier")
def steps_by_type(read):
    rows = read("supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("label.nation"), F.col("s_acctbal").cast("double").alias("image.balance"), F.col("s_name").alias("other"))
    detect = oc.Patterns({r"image\.": oc.DataType.IMAGE, r"label\.": oc.DataType.LABEL}, oc.DataType.UNKNOWN)
    detect.verify(rows.columns)
    steps = {oc.DataType.IMAGE: lambda c: so.apply(lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(5000.0)) / 5000, [c], c), oc.DataType.LABEL: lambda c: so.apply(lambda x: F.when(x == 3, 1).otherwise(0), [c], c)}
    return rounded(oc.by_type(steps, detect)(rows), "image.balance")


@query(f"SELECT vec_id, list_transform(range(64), lambda i: round(CAST(embedding[i + 1] AS DOUBLE) + 0.1e0 + 0.2e0 * sqrt(-2 * ln(1 - {uniform_sql('8/a', 'vec_id', 'i')})) * cos({uniform_sql('8/b', 'vec_id', 'i')} * 6.283185307179586e0), 6) + 0e0) AS embedding FROM embeddings")
def gaussian_noise(read):
    rows = so.cast("embedding", "float")(read("embeddings").select("vec_id", "embedding")).withColumn("embedding", F.col("embedding").cast("array<double>"))
    return oc.gaussian_noise("embedding", 0.1, 0.2, 8, "vec_id")(rows).select("vec_id", rounded_vector("embedding"))


@query("SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc((CAST(x AS DOUBLE) - list_min(embedding)) * 255 / (CAST(list_max(embedding) AS DOUBLE) - list_min(embedding))) AS INTEGER)) AS embedding FROM embeddings")
def to_bytes_range(read):
    return so.to_bytes_range("embedding")(read("embeddings").select("vec_id", "embedding"))


@query("""WITH s AS (SELECT vec_id, embedding, list_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS v FROM embeddings), p AS (SELECT *, v[1] AS a, v[63] + (v[64] - v[63]) * (63 * 0.99e0 - 62) AS b FROM s)
SELECT vec_id, list_transform(embedding, lambda x: round((least(greatest(CAST(x AS DOUBLE), a), b) - a) * (2 / (b - a)) - 1, 6) + 0e0) AS embedding FROM p""")
def normalise_percentile(read):
    return so.normalise_percentile("embedding", (-1.0, 1.0))(read("embeddings").select("vec_id", "embedding")).select("vec_id", rounded_vector("embedding"))


@query("""WITH r AS (SELECT vec_id, i, embedding[i * 8 + 1 : i * 8 + 8] AS r FROM embeddings, (SELECT unnest(range(8)) AS i)), s AS (SELECT vec_id, sum(list_sum(list_transform(r[1:4], lambda x: CAST(x AS DOUBLE)))) AS a, sum(list_sum(list_transform(r[5:8], lambda x: CAST(x AS DOUBLE)))) AS b FROM r GROUP BY 1)
SELECT vec_id, flatten(list(list_transform(CASE WHEN b > a THEN list_reverse(r) ELSE r END, lambda x: round(CAST(x AS DOUBLE), 6) + 0e0) ORDER BY i)) AS v FROM r JOIN s USING (vec_id) GROUP BY vec_id""")
def bright_side_left(read):
    out = so.chain(so.matrix("embedding", "m", 8), so.bright_side_left("m"))(read("embeddings"))
    return out.select("vec_id", F.flatten("m").alias("v")).select("vec_id", rounded_vector("v"))


@query("SELECT vec_id, list_transform(range(64), lambda k: round(CAST(embedding[(k % 8) * 8 + k // 8 + 1] AS DOUBLE), 6) + 0e0) AS v FROM embeddings")
def transposed(read):
    out = so.chain(so.matrix("embedding", "m", 8), so.transpose("m"))(read("embeddings"))
    return out.select("vec_id", F.flatten("m").alias("v")).select("vec_id", rounded_vector("v"))


@query("""WITH m AS (SELECT vec_id, vec_id % 50 AS image, list_transform(embedding, lambda x: CAST(x > 0 AS INT)) AS p, list_transform(embedding, lambda x: CAST(x > 0.05 AS INT)) AS t FROM embeddings),
i AS (SELECT a.image, a.vec_id, max(list_sum(list_transform(list_zip(a.t, b.p), lambda z: z[1] * z[2])) / CAST(nullif(CASE WHEN a.vec_id % 3 = 0 THEN list_sum(b.p) ELSE list_sum(list_transform(list_zip(a.t, b.p), lambda z: greatest(z[1], z[2]))) END, 0) AS DOUBLE)) AS iou FROM m a JOIN m b ON a.image = b.image AND b.vec_id % 2 = 0 GROUP BY 1, 2),
g AS (SELECT image, count_if(iou > 0.5e0) AS hit, count(*) AS t, avg(CASE WHEN iou > 0.5e0 THEN iou END) AS m FROM i GROUP BY 1), a AS (SELECT image, count(*) AS t FROM m GROUP BY 1), q AS (SELECT image, count(*) AS p FROM m WHERE vec_id % 2 = 0 GROUP BY 1)
SELECT round(avg(m), 6) AS mean_iou, round(avg(coalesce(hit, 0) / CAST(p AS DOUBLE)), 6) AS precision, round(avg(coalesce(hit, 0) / CAST(a.t AS DOUBLE)), 6) AS recall FROM a LEFT JOIN g USING (image) LEFT JOIN q USING (image)""")
def mask_detection(read):
    level = lambda edge: F.transform("embedding", lambda x: (x > F.lit(edge).cast("float")).cast("int"))
    rows = read("embeddings").withColumn("image", F.col("vec_id") % 50)
    preds = rows.where("vec_id % 2 = 0").select("image", level(0.0).alias("mask"))
    targets = rows.select("image", F.col("vec_id").alias("target_id"), level(0.05).alias("mask"), (F.col("vec_id") % 3 == 0).alias("crowd"))
    return rounded(mm.detection(preds, targets, 0.5, matches=mm.mask_matches))


@query(f"{CURVE} SELECT p AS threshold, round((nb + neg) / n_all, 6) AS fpr, round((pb + pos) / p_all, 6) AS tpr FROM c UNION ALL SELECT NULL, 0e0, 0e0")
def roc_points(read):
    return rounded(mc.roc_points("p", "quality", "w")(weighted(read), []), "fpr", "tpr")


@query(f"{D} SELECT event_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY day) - 1 AS BIGINT) AS place FROM v")
def visit_places(read):
    return ev.visit_places(daily(read), "user_id", "day").select("event_id", "place")


@query("SELECT doc_id, '<@TOKENIZER-TYPE=A@MAX-LEN=7@TRUNC-MODE=RAND>' || lang || '<@TOKENIZER-TYPE=B>' || source AS text, '<' || lang || '>' AS wrapped, lang AS unwrapped FROM documents")
def segment_texts(read):
    text = F.concat(F.lit("<@TOKENIZER-TYPE=A@MAX-LEN=7@TRUNC-MODE=RAND>"), "lang", F.lit("<@TOKENIZER-TYPE=B>"), "source")
    return read("documents").select("doc_id", tk.unparse(tk.parse(text)).alias("text"), tk.wrap(F.col("lang")).alias("wrapped"), tk.unwrap(tk.wrap(F.col("lang"))).alias("unwrapped"))


@query("SELECT l_returnflag AS flag, printf('%.3f [%.3f-%.3f]', avg(CAST(l_quantity AS DOUBLE)), min(CAST(l_quantity AS DOUBLE)), max(CAST(l_quantity AS DOUBLE))) AS cell FROM lineitem GROUP BY 1")
def interval_cells(read):
    q = F.col("l_quantity").cast("double")
    return read("lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.avg(q).alias("a"), F.min(q).alias("b"), F.max(q).alias("c")).select("flag", with_interval(F.col("a"), F.col("b"), F.col("c")).alias("cell"))


@query("SELECT 'loss' AS kind, 'sum' AS name, round(sum(CASE WHEN value >= 2 THEN value END), 4) AS value FROM events UNION ALL SELECT 'loss', 'count', CAST(count(CASE WHEN value >= 2 THEN value END) AS DOUBLE) FROM events UNION ALL SELECT 'tokens', 'sequences', CAST(count(*) AS DOUBLE) FROM documents UNION ALL SELECT 'tokens', 'tokens', CAST(sum(len(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS DOUBLE) FROM documents")
def epoch_statistics(read):
    losses = inc.loss_sums("v")(read("events").select(F.when(F.col("value") >= 2, F.col("value")).alias("v"))).select(F.lit("loss").alias("kind"), "name", "value")
    tokens = inc.token_counts("w", "")(read("documents").select(F.split("text", " ").alias("w"))).select(F.lit("tokens").alias("kind"), "name", F.col("value").cast("double").alias("value"))
    return rounded(losses.unionByName(tokens), digits=4)


@query('SELECT CAST(upper(CAST(n_nationkey AS VARCHAR)) AS VARCHAR) AS "nation.key", upper(n_name) AS "nation.name", upper(CAST(n_regionkey AS VARCHAR)) AS region, \'nation,region\' AS tops FROM nation')
def all_leaves(read):
    rows = read("nation").select(col("n_nationkey").alias("nation.key"), col("n_name").alias("nation.name"), col("n_regionkey").alias("region"))
    out = on_all(rows, lambda c: F.upper(c.cast("string")))
    return out.withColumn("tops", F.lit(",".join(top_level(rows))))


FOLDS = f"""{S}, r AS (SELECT *, 'g' || CAST(doc_id % 37 AS VARCHAR) AS grp FROM s), g AS (SELECT grp, row_number() OVER (ORDER BY {uniform_sql("9", "grp")}, grp) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM r WHERE doc_id % 5 <> 0)),
f AS (SELECT r.*, fold FROM r JOIN (SELECT grp, (SELECT max(k) FROM (SELECT unnest(range(4)) AS k) WHERE place >= k * (n // 4) + least(k, n % 4)) AS fold FROM g) USING (grp) WHERE doc_id % 5 <> 0),
k AS (SELECT unnest(range(4)) AS k), m AS (SELECT k, lang, avg(CAST(quality AS DOUBLE)) AS p FROM f, k WHERE fold <> k GROUP BY 1, 2), h AS (SELECT f.*, coalesce(m.p, 0.5e0) AS prediction FROM f LEFT JOIN m ON m.k = f.fold AND m.lang = f.lang),
t AS (SELECT r.doc_id, quality, avg(coalesce(m.p, 0.5e0)) AS prediction FROM r CROSS JOIN k LEFT JOIN m ON m.k = k.k AND m.lang = r.lang WHERE doc_id % 5 = 0 GROUP BY 1, 2)"""


@query(f"""{FOLDS} SELECT part, 'brier' AS name, round(avg(pow(prediction - quality, 2)), 6) AS value FROM (SELECT 'fold ' || fold AS part, prediction, quality FROM h UNION ALL SELECT 'held out', prediction, quality FROM h UNION ALL SELECT 'ensemble', prediction, quality FROM t) GROUP BY part""")
def cross_validation(read):
    def fit(rows):
        means = rows.groupBy("lang").agg(F.avg("quality").alias("m"))
        return lambda df: df.join(means, "lang", "left").withColumn(PREDICTION, F.coalesce("m", F.lit(0.5))).drop("m")

    rows = predictions(read).withColumn("grp", F.concat(F.lit("g"), F.col("doc_id") % 37))
    folds = group_folds(rows.where("doc_id % 5 != 0"), "grp", 4, 9)
    held, test = cross_validate(folds, 4, fit, rows.where("doc_id % 5 = 0"))
    brier = lambda df, by=(): df.agg(F.avg(F.pow(F.col(PREDICTION) - F.col("quality"), 2)).alias("brier"))
    return rounded(fold_report(held, brier, 4, test))


@query("""WITH d AS (SELECT * FROM documents ORDER BY doc_id LIMIT 25) SELECT CAST(doc_id AS VARCHAR) AS sample, 'lang' AS key, 'string' AS type, CAST(length(lang) AS BIGINT) AS length, lang AS content FROM d
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'n_chars', 'bigint', NULL, CAST(n_chars AS VARCHAR) FROM d UNION ALL SELECT CAST(doc_id AS VARCHAR), 'words', 'array<string>', len(string_split(source, 'r')), '[' || array_to_string(string_split(source, 'r'), ', ') || ']' FROM d UNION ALL SELECT CAST(doc_id AS VARCHAR), 'none', 'absent', NULL, NULL FROM d""")
def described_samples(read):
    rows = read("documents").select("doc_id", "lang", "n_chars", F.split("source", "r").alias("words"))
    return described(rows, "doc_id", ["lang", "n_chars", "words", "none"], 25)


@query("SELECT vec_id // 8 AS batch, list(list_transform(embedding[1:5], lambda x: round(CAST(x AS DOUBLE), 6) + 0e0) ORDER BY vec_id)[1] AS first, CAST(sum(5) AS BIGINT) AS elements FROM embeddings GROUP BY 1")
def crop_batch_like(read):
    rows = read("embeddings").select(F.floor(F.col("vec_id") / 8).cast("long").alias("batch"), "vec_id", "embedding")
    lists = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("l"))
    lists = lists.select("batch", F.transform("l", lambda x: F.slice(x["embedding"], 1, 5)).alias("a"), F.transform("l", lambda x: x["embedding"]).alias("b"))
    out = ob.crop_like("a", "b")(lists)
    return out.select("batch", F.get("b", F.lit(0)).alias("first"), F.size(F.flatten("b")).cast("long").alias("elements")).select("batch", rounded_vector("first"), "elements")


@query(f"{MASK}, d AS (SELECT label, avg(2 * b / (pp + tt)) AS dice FROM l GROUP BY label) SELECT round(sum(dice * CASE WHEN label = 1 THEN 0.25e0 ELSE 1.5e0 END) / count(*), 6) AS dice FROM d")
def mask_average(read):
    return rounded(mm.average(mm.mask_metric("dice", "vec_id", "p", "t"), "dice", {1: 0.25, 2: 1.5})(masks(read), []))


@query("SELECT n_nationkey, CAST(CAST(n_regionkey AS VARCHAR) AS BIGINT) AS region, CAST(CAST(n_nationkey AS VARCHAR) || '7' AS BIGINT) AS seven FROM nation")
def cast_like(read):
    rows = read("nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_regionkey").cast("string").alias("region"), F.concat(F.col("n_nationkey").cast("string"), F.lit("7")).alias("seven"))
    return so.cast_like(["region", "seven"], "n_nationkey")(rows)
