"""Queries of the metrics."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import col, softmax, uniform
from ..metrics import classification as mc
from ..metrics import masks as mm
from ..metrics import ranking as mk
from ..metrics import regression as mr
from ..metrics.base import interval, leaving_out, one_vs_rest, paired, per_group
from ..operators.samples import matrix
from ..plans.evaluator import evaluate, resolve
from .base import E, S, auc_sql, class_probabilities, predictions, query, rounded, rounded_vector, uniform_sql

GROUPS = f"""{S}, a AS ({auc_sql("s", "p", "quality", "lang")})
SELECT 'auc' AS name, lang, round(auc, 6) AS value FROM a UNION ALL SELECT 'auc', 'mean', round(avg(auc), 6) FROM a
UNION ALL SELECT 'auc', 'std', round(stddev_pop(auc), 6) FROM a UNION ALL SELECT 'auc', 'median', round(median(auc), 6) FROM a"""


@query(GROUPS)
def auc_group(read):
    return rounded(per_group(mc.auc("p", "quality"), "lang")(predictions(read)))


@query(f"{S}, f AS (SELECT *, CAST(doc_id % 2 AS BIGINT) AS evaluator_fold FROM s), a AS ({auc_sql('f', 'p', 'quality', 'evaluator_fold')}) SELECT 'auc' AS name, CAST(evaluator_fold AS VARCHAR) AS evaluator_fold, round(auc, 6) AS value FROM a UNION ALL SELECT 'auc', 'mean', round(avg(auc), 6) FROM a UNION ALL SELECT 'auc', 'std', round(stddev_pop(auc), 6) FROM a UNION ALL SELECT 'auc', 'median', round(median(auc), 6) FROM a")
def auc_fold_stats(read):
    rows = predictions(read)
    folds = resolve([rows.where(F.col("doc_id") % 2 == i) for i in (0, 1)], "doc_id")
    return rounded(per_group(mc.auc("p", "quality"), "evaluator_fold")(folds))


@query(f"{S}, a AS ({auc_sql('s', 'p', 'quality')}) SELECT round(auc, 6) AS auc FROM a")
def auc_binary(read):
    return rounded(mc.auc("p", "quality")(predictions(read), []))


CURVE = f"""{S}, g AS (SELECT p, sum(CASE WHEN quality = 1 THEN w ELSE 0e0 END) AS pos, sum(CASE WHEN quality = 1 THEN 0e0 ELSE w END) AS neg FROM (SELECT *, 1e0 + doc_id % 3 AS w FROM s) GROUP BY p),
c AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS nb, coalesce(sum(pos) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS pb,
sum(pos) OVER () AS p_all, sum(neg) OVER () AS n_all, row_number() OVER (ORDER BY p DESC) AS i, lead(pos) OVER (ORDER BY p DESC) AS np, lead(neg) OVER (ORDER BY p DESC) AS nn FROM g)"""


def weighted(read):
    return predictions(read).withColumn("w", F.lit(1.0) + F.col("doc_id") % 3)


@query(f"{CURVE} SELECT round(sum(pos * (n_all - nb - neg + neg / 2e0)) / (max(p_all) * max(n_all)), 6) AS auc FROM c")
def auc_weighted(read):
    return rounded(mc.auc("p", "quality", "w")(weighted(read), []))


@query(f"""{CURVE}, t AS (SELECT pb / p_all AS y0, pos / p_all AS dy, neg / n_all AS dx, greatest(least((nb + neg) / n_all, 0.2e0) - nb / n_all, 0e0) AS w FROM c)
SELECT round(0.5e0 * (1e0 + (sum(CASE WHEN dx > 0 THEN w * (y0 + dy * (w / dx) / 2e0) ELSE 0e0 END) - 0.02e0) / (0.2e0 - 0.02e0)), 6) AS auc FROM t""")
def auc_partial(read):
    return rounded(mc.auc_partial("p", "quality", 0.2, "w")(weighted(read), []))


@query(f"""{CURVE} SELECT round(sum(pos / p_all * ((pb + pos) / (pb + pos + nb + neg) + CASE WHEN pb + nb > 0 THEN pb / (pb + nb) ELSE 1e0 END) / 2e0), 6) AS auc_pr FROM c""")
def auc_pr(read):
    return rounded(mc.auc_pr("p", "quality", "w")(weighted(read), []))


@query(f"""{CURVE} SELECT p AS threshold, round((nb + neg) / n_all, 6) AS fpr, round((pb + pos) / p_all, 6) AS tpr FROM c WHERE i = 1 OR np IS NULL OR np <> pos OR nn <> neg UNION ALL SELECT NULL, 0e0, 0e0""")
def roc_curve(read):
    return rounded(mc.roc_curve("p", "quality", "w")(weighted(read), []), "fpr", "tpr")


@query(f"""{E}, x AS (SELECT CAST(c.k AS VARCHAR) AS class, probs[c.k + 1] AS p, CAST(label = c.k AS INT) AS y FROM e, (SELECT unnest(range(10)) AS k) c), a AS ({auc_sql("x", "p", "y", "class")})
SELECT class, round(auc, 6) AS auc FROM a UNION ALL SELECT 'macro_avg', round(avg(auc), 6) FROM a""")
def auc_one_vs_rest(read):
    scores = {str(k): F.get("probs", F.lit(k)) for k in range(10)}
    return rounded(one_vs_rest(lambda s, t: mc.auc(s, t), scores, "label")(class_probabilities(read), []))


LABELS = f"{S}, x AS (SELECT 0 AS label, p AS p, quality AS y FROM s UNION ALL SELECT 1, p2, toxic FROM s)"


def multilabel(read):
    return predictions(read).select(F.array("p", "p2").alias("ps"), F.array("quality", "toxic").alias("ts"))


@query(f"{LABELS}, a AS ({auc_sql('x')}) SELECT round(auc, 6) AS auc FROM a")
def auc_multilabel_micro(read):
    return rounded(mc.auc_multilabel("ps", "ts")(multilabel(read), []))


@query(f"{LABELS}, a AS ({auc_sql('x', by='label')}) SELECT round(avg(auc), 6) AS auc FROM a")
def auc_multilabel_macro(read):
    return rounded(mc.auc_multilabel("ps", "ts", "macro")(multilabel(read), []))


C = f"{S}, c AS (SELECT *, CAST(p > 0.5e0 AS BIGINT) AS pred, CAST(p2 > 0.5e0 AS BIGINT) AS pred2, 1e0 + doc_id % 3 AS w FROM s)"


def classes(read):
    return weighted(read).withColumns({"pred": (F.col("p") > 0.5).cast("long"), "pred2": (F.col("p2") > 0.5).cast("long")})


@query(f"{C} SELECT lang, round(sum(CASE WHEN pred = quality THEN w ELSE 0e0 END) / sum(w), 6) AS accuracy FROM c GROUP BY lang")
def accuracy_weighted(read):
    return rounded(mc.accuracy("pred", "quality", "w")(classes(read), ["lang"]))


@query(f"{C} SELECT round(avg(CASE WHEN pred = quality THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM c WHERE NOT (lang = 'en')")
def accuracy_filtered(read):
    return rounded(leaving_out(mc.accuracy("pred", "quality"), F.col("lang") == "en")(classes(read), []))


@query(f"""{C}, k AS (SELECT lang, sum(CASE WHEN pred = 1 AND quality = 1 THEN 1e0 ELSE 0e0 END) AS tp, sum(CASE WHEN pred <> 1 AND quality = 1 THEN 1e0 ELSE 0e0 END) AS fn, sum(CASE WHEN pred = 1 AND quality <> 1 THEN 1e0 ELSE 0e0 END) AS fp, sum(CASE WHEN pred <> 1 AND quality <> 1 THEN 1e0 ELSE 0e0 END) AS tn FROM c GROUP BY lang)
SELECT *, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(coalesce(tp / nullif(tp + fp, 0), 0e0), 6) AS precision, round(2e0 * tp / nullif(2e0 * tp + fp + fn, 0), 6) AS f1 FROM k""")
def confusion_metrics(read):
    return rounded(mc.confusion("pred", "quality")(classes(read), ["lang"]))


@query("SELECT CAST(quality AS BIGINT) AS target, count_if(toxic = 0) AS \"0\", count_if(toxic = 1) AS \"1\", count(*) AS total, round(100e0 * count_if(toxic = 0) / count(*), 6) AS \"0_percent\", round(100e0 * count_if(toxic = 1) / count(*), 6) AS \"1_percent\" FROM labels GROUP BY quality")
def confusion_matrix(read):
    return rounded(mc.confusion_matrix("toxic", "quality", [0, 1])(read("labels"), []).withColumn("target", F.col("target").cast("long")))


B = f"{E}, b AS (SELECT list_sum(list_transform(probs, lambda x, i: pow(x - CASE WHEN i - 1 = label THEN 1e0 ELSE 0e0 END, 2))) AS s FROM e)"


@query(f"{B} SELECT round(avg(s), 6) AS brier FROM b")
def brier(read):
    return rounded(mc.brier("probs", "label")(class_probabilities(read), []))


@query(f"{B} SELECT round(1e0 - (SELECT avg(s) FROM b) / (SELECT 1e0 - sum(pow(n / t, 2)) FROM (SELECT CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER () AS t FROM e GROUP BY label)), 6) AS brier_skill")
def brier_skill(read):
    return rounded(mc.brier_skill("probs", "label")(class_probabilities(read), []))


A = f"{E}, m AS (SELECT *, CAST(list_position(probs, list_max(probs)) - 1 AS BIGINT) AS pred FROM e)"


def argmaxed(read):
    return class_probabilities(read).withColumn("pred", mc.to_class("probs"))


@query(f"""{A}, g AS (SELECT CAST(count(*) AS DOUBLE) AS s, CAST(count_if(pred = label) AS DOUBLE) AS c FROM m), k AS (SELECT c.k, CAST((SELECT count(*) FROM m WHERE pred = c.k) AS DOUBLE) AS a, CAST((SELECT count(*) FROM m WHERE label = c.k) AS DOUBLE) AS b FROM (SELECT unnest(range(10)) AS k) c)
SELECT round(coalesce((max(c) * max(s) - sum(a * b)) / nullif(sqrt((pow(max(s), 2) - sum(a * a)) * (pow(max(s), 2) - sum(b * b))), 0), 0), 6) AS mcc FROM k, g""")
def mcc(read):
    return rounded(mc.matthews("pred", "label")(argmaxed(read), []))


@query(f"{A} SELECT round(avg(r), 6) AS balanced_accuracy FROM (SELECT avg(CASE WHEN pred = label THEN 1e0 ELSE 0e0 END) AS r FROM m GROUP BY label)")
def balanced_accuracy(read):
    return rounded(mc.balanced_accuracy("pred", "label")(argmaxed(read), []))


@query(f"{S} SELECT doc_id, CAST(p2 > 0.4e0 AS BIGINT) AS single, CAST(CASE WHEN p > 0.7e0 THEN 0 WHEN p2 > 0.6e0 THEN 1 ELSE -1 END AS BIGINT) AS listed, CAST(CASE WHEN p >= p2 THEN 0 ELSE 1 END AS BIGINT) AS top FROM s")
def apply_thresholds(read):
    rows = predictions(read).withColumn("v", F.array("p", "p2"))
    return rows.select("doc_id", mc.to_class("v", 0.4).alias("single"), mc.to_class("v", [(0, 0.7), (1, 0.6)]).alias("listed"), mc.to_class("v").alias("top"))


@query(f"{S} SELECT doc_id, round((CASE WHEN doc_id % 7 = 0 THEN p2 ELSE (p + p2) / 2e0 END), 6) AS mean, CAST(CASE WHEN a + b + c >= 2 THEN 1 ELSE 0 END AS BIGINT) AS vote FROM (SELECT *, CAST(p > 0.5e0 AS INT) a, CAST(p2 > 0.5e0 AS INT) b, CAST(toxic AS INT) c FROM s)")
def ensembles(read):
    rows = classes(read).withColumns({"v1": F.array(F.when(F.col("doc_id") % 7 != 0, F.col("p")).otherwise(F.lit(float("nan")))), "v2": F.array("p2")})
    return rounded(rows.select("doc_id", F.get(mc.ensemble_mean("v1", "v2"), F.lit(0)).alias("mean"), mc.ensemble_vote("pred", "pred2", "toxic").alias("vote")))


R = f"""{E}, r AS (SELECT list_max(probs) AS conf, CASE WHEN list_position(probs, list_max(probs)) - 1 = label THEN 1e0 ELSE 0e0 END AS hit FROM e),
q AS (SELECT CAST(floor(conf * 10) AS BIGINT) AS bin, count(*) AS n, avg(hit) AS accuracy, avg(conf) AS mean_confidence FROM r WHERE conf < 1 GROUP BY 1)"""


@query(f"{R} SELECT CAST(k AS BIGINT) AS bin, round(k / 10e0, 6) AS low, round((k + 1) / 10e0, 6) AS high, coalesce(n, 0) AS n, round(accuracy, 6) AS accuracy, round(mean_confidence, 6) AS mean_confidence FROM (SELECT unnest(range(10)) AS k) LEFT JOIN q ON q.bin = k")
def reliability(read):
    return rounded(mc.reliability("probs", "label")(class_probabilities(read), []))


@query(f"{R} SELECT round(sum(n * abs(accuracy - (bin + 1) / 10e0)) / (SELECT count(*) FROM r), 6) AS ece, round(max(abs(accuracy - (bin + 1) / 10e0)), 6) AS mce FROM q")
def ece_mce(read):
    return rounded(mc.calibration_error("probs", "label")(class_probabilities(read), []))


@query("""WITH t AS (SELECT vec_id, list_transform(embedding[1:10], lambda x: exp((CAST(x AS DOUBLE) - CAST(list_max(embedding[1:10]) AS DOUBLE)) / 0.8e0)) AS ex FROM embeddings) SELECT vec_id, list_transform(ex, lambda x: round(x / list_sum(ex), 6)) AS probs FROM t""")
def apply_temperature(read):
    return read("embeddings").select("vec_id", softmax(F.slice("embedding", 1, 10), 0.8).alias("probs")).select("vec_id", rounded_vector("probs"))


@query(f"""{S}, h AS (SELECT doc_id, quality AS y, p AS s1, p2 AS s2 FROM s), z AS (SELECT CAST(count_if(y = 1) AS DOUBLE) AS m, CAST(count_if(y = 0) AS DOUBLE) AS n FROM h),
k AS (SELECT a.doc_id AS i, b.doc_id AS j, CASE WHEN a.s1 > b.s1 THEN 1e0 WHEN a.s1 = b.s1 THEN 0.5e0 ELSE 0e0 END AS k1, CASE WHEN a.s2 > b.s2 THEN 1e0 WHEN a.s2 = b.s2 THEN 0.5e0 ELSE 0e0 END AS k2 FROM h a, h b WHERE a.y = 1 AND b.y = 0),
v10 AS (SELECT i, avg(k1) AS x1, avg(k2) AS x2 FROM k GROUP BY i), v01 AS (SELECT j, avg(k1) AS x1, avg(k2) AS x2 FROM k GROUP BY j),
c AS (SELECT (SELECT avg(x1) FROM v10) AS auc1, (SELECT avg(x2) FROM v10) AS auc2, (SELECT covar_samp(x1, x1) FROM v10) / m + (SELECT covar_samp(x1, x1) FROM v01) / n AS cov11, (SELECT covar_samp(x1, x2) FROM v10) / m + (SELECT covar_samp(x1, x2) FROM v01) / n AS cov12, (SELECT covar_samp(x2, x2) FROM v10) / m + (SELECT covar_samp(x2, x2) FROM v01) / n AS cov22 FROM z)
SELECT round(auc1, 6) AS auc1, round(auc2, 6) AS auc2, round(cov11, 9) AS cov11, round(cov12, 9) AS cov12, round(cov22, 9) AS cov22, round(abs(auc1 - auc2) / sqrt(cov11 + cov22 - 2 * cov12), 5) AS z FROM c""")
def delong(read):
    out = mc.delong("p", "p2", "quality")(predictions(read), []).drop("p_value")
    return rounded(rounded(rounded(out, "auc1", "auc2"), "cov11", "cov12", "cov22", digits=9), "z", digits=5)


@query(f'{C} SELECT lang, count_if(pred = quality AND pred2 = quality) AS "both", count_if(pred = quality AND pred2 <> quality) AS only1, count_if(pred <> quality AND pred2 = quality) AS only2, count_if(pred <> quality AND pred2 <> quality) AS none FROM c GROUP BY lang')
def mcnemar_counts(read):
    rows = classes(read).withColumns({"ok1": F.col("pred") == F.col("quality"), "ok2": F.col("pred2") == F.col("quality")})
    return mc.contingency("ok1", "ok2")(rows, ["lang"])


# a cell's count is the quantile of its binomial, given what the cells before it left
BOOT = f"""{C.replace("WITH", "WITH RECURSIVE", 1)}, g AS (SELECT quality, pred, pred2, w, row_number() OVER o AS i, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM (SELECT quality, pred, pred2, count(*) AS w FROM c GROUP BY ALL) WINDOW o AS (PARTITION BY quality ORDER BY pred, pred2)),
n AS (SELECT quality, CAST(sum(w) AS BIGINT) AS n FROM g GROUP BY quality),
m AS (SELECT quality, i, n, j, exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(w / rest) + (n - j) * ln(1 - w / rest)) AS p FROM (SELECT g.quality, i, w, CAST(rest AS DOUBLE) AS rest, unnest(range(n + 1)) AS n FROM g JOIN n USING (quality) WHERE w < rest) x, LATERAL (SELECT unnest(range(x.n + 1)) AS j)),
q AS (SELECT quality, i, n, list(p ORDER BY j) AS cdf FROM (SELECT quality, i, n, j, sum(p) OVER (PARTITION BY quality, i, n ORDER BY j) AS p FROM m) GROUP BY quality, i, n),
d AS (SELECT replicate, quality, CAST(0 AS BIGINT) AS i, n AS left_over, CAST(0 AS BIGINT) AS k, 0 AS hit, 0 AS hit2 FROM n, (SELECT unnest(range(10000)) AS replicate)
  UNION ALL SELECT replicate, quality, i, left_over - k, k, hit, hit2 FROM (SELECT d.replicate, d.quality, g.i, d.left_over, CASE WHEN q.cdf IS NULL THEN d.left_over ELSE least(len(list_filter(q.cdf, lambda x: x <= {uniform_sql("7", "d.replicate", "g.quality", "g.pred", "g.pred2")})), d.left_over) END AS k, CAST(g.pred = g.quality AS INT) AS hit, CAST(g.pred2 = g.quality AS INT) AS hit2
    FROM d JOIN g ON g.quality = d.quality AND g.i = d.i + 1 LEFT JOIN q ON q.quality = g.quality AND q.i = g.i AND q.n = d.left_over)),
b AS (SELECT replicate, sum(k * hit) / CAST(sum(k) AS DOUBLE) AS v, sum(k * hit2) / CAST(sum(k) AS DOUBLE) AS v2 FROM d GROUP BY replicate)"""


@query(f"{BOOT}, l AS (SELECT list_sort(list(v)) AS vs FROM b) SELECT 'accuracy' AS name, round((SELECT avg(CASE WHEN pred = quality THEN 1e0 ELSE 0e0 END) FROM c), 6) AS org, round((SELECT avg(v) FROM b), 6) AS mean, round((SELECT stddev_pop(v) FROM b), 6) AS std, round(vs[251], 6) AS conf_lower, round(vs[9751], 6) AS conf_upper FROM l")
def bootstrap_ci_accuracy(read):
    return rounded(interval(lambda w: mc.accuracy("pred", "quality", w), "doc_id", ["quality"], seed=7, cells=["pred", "pred2"])(classes(read), []))


def compared(read, margin: float, relative: bool):
    return rounded(paired(lambda w: mc.accuracy("pred", "quality", w), lambda w: mc.accuracy("pred2", "quality", w), "doc_id", ["quality"], seed=7, margin=margin, relative=relative, cells=["pred", "pred2"])(classes(read), []))


PAIRED = "SELECT 'accuracy' AS name, count(*) AS replicates, round(1 - count_if(v - v2 > {m}) / CAST(count(*) AS DOUBLE), 6) AS p_superiority, round(1 - count_if(v - v2 > -{m}) / CAST(count(*) AS DOUBLE), 6) AS p_noninferiority, round(1 - count_if(abs(v - v2) < {m}) / CAST(count(*) AS DOUBLE), 6) AS p_equality FROM b"


@query(f"{BOOT} {PAIRED.format(m='0.0213e0')}")
def paired_bootstrap(read):
    return compared(read, 0.0213, False)


@query(f"{BOOT} {PAIRED.format(m='(0.0437e0 * v2)')}")
def paired_bootstrap_relative(read):
    return compared(read, 0.0437, True)


@query(f"{C} SELECT metric, name, round(value, 6) AS value FROM (SELECT 'acc' AS metric, 'accuracy' AS name, avg(CASE WHEN pred = quality THEN 1e0 ELSE 0e0 END) AS value FROM c UNION ALL SELECT 'err', 'mae', avg(abs(p - quality)) FROM c UNION ALL SELECT 'err', 'mse', avg(pow(p - quality, 2)) FROM c UNION ALL SELECT 'err', 'rmse', sqrt(avg(pow(p - quality, 2))) FROM c)")
def evaluation_report(read):
    return rounded(evaluate(classes(read), {"acc": mc.accuracy("pred", "quality"), "err": mr.errors("p", "quality")}))


# -- regression, survival, sequences ----------------------------------------------------

L = "WITH v AS (SELECT l_returnflag AS g, CAST(l_quantity AS DOUBLE) * 1000e0 AS x, CAST(l_extendedprice AS DOUBLE) AS y, l_linenumber AS k FROM lineitem)"


def priced(read):
    return read("lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_quantity").cast("double") * F.lit(1000.0)).alias("x"), F.col("l_extendedprice").cast("double").alias("y"), (F.col("l_linenumber") != 2).alias("m"))


@query(f"{L} SELECT g, round(avg(abs(x - y)), 3) AS mae, round(avg(pow(x - y, 2)), 0) AS mse, round(sqrt(avg(pow(x - y, 2))), 3) AS rmse FROM v WHERE k <> 2 GROUP BY g")
def regression_errors_masked(read):
    return rounded(rounded(mr.errors("x", "y", "m")(priced(read), ["g"]), "mae", "rmse", digits=3), "mse", digits=0)


@query(f"{L} SELECT g, round(1e0 - sum(pow(x - y, 2)) / (var_pop(y) * count(*)), 6) AS r2 FROM v GROUP BY g")
def r2(read):
    return rounded(mr.r2("x", "y")(priced(read), ["g"]))


@query(f"{L} SELECT g, round(corr(x, y), 6) AS r, count(*) AS n FROM v GROUP BY g")
def pearson(read):
    return rounded(mr.pearson("x", "y")(priced(read), ["g"]))


@query(f"{L}, r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2e0 AS a, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2e0 AS b FROM v) SELECT g, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY g")
def spearman(read):
    return rounded(mr.spearman("x", "y")(priced(read), ["g"]))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def unique_values(read):
    return mr.unique_values("event_type")(read("events"), [])


T = """WITH c AS (SELECT c_custkey AS id, c_mktsegment AS g, CAST(c_acctbal AS DOUBLE) AS risk, CAST((c_custkey * 7919) % 97 AS BIGINT) AS t, (c_custkey % 3 <> 0) AS seen FROM customer),
d AS (SELECT g, risk, CAST(floor(t / 5e0) AS BIGINT) AS t, seen AND t <= 60 AS seen FROM c),
k AS (SELECT a.g, CASE WHEN a.risk > b.risk THEN 1e0 WHEN a.risk = b.risk THEN 0.5e0 ELSE 0e0 END AS v FROM d a JOIN d b ON a.g = b.g AND a.seen AND (a.t < b.t OR (a.t = b.t AND NOT b.seen)))"""


@query(f"{T} SELECT g, sum(v) AS concordant, CAST(count(*) AS DOUBLE) AS comparable, round(avg(v), 6) AS c_index FROM k GROUP BY g")
def c_index(read):
    rows = read("customer").select(F.col("c_mktsegment").alias("g"), F.col("c_acctbal").cast("double").alias("risk"), ((F.col("c_custkey") * 7919) % 97).cast("long").alias("t"), (F.col("c_custkey") % 3 != 0).alias("seen"))
    return rounded(mr.c_index("risk", "t", "seen", unit=5, followup=60)(rows, ["g"]))


@query(f"""{E}, d AS (SELECT list_sum(list_transform(probs, lambda x, i: x * (i - 1))) AS k, label AS t FROM e), j AS (SELECT CASE WHEN a.k < b.k THEN 1e0 WHEN a.k = b.k THEN 0.5e0 ELSE 0e0 END AS v FROM d a JOIN d b ON a.t < b.t)
SELECT sum(v) AS concordant, CAST(count(*) AS DOUBLE) AS comparable, round(avg(v), 6) AS c_index FROM j""")
def expected_c_index(read):
    rows = class_probabilities(read).withColumn("expected", mr.expected_bin("probs"))
    return rounded(mr.c_index("expected", "label", higher_is_earlier=False)(rows, []))


@query(f"{E} SELECT round(exp(avg(-ln(probs[label + 1]))), 6) AS perplexity, count(*) AS tokens FROM e WHERE label <> 3")
def perplexity(read):
    rows = class_probabilities(read).select(F.array("probs").alias("ps"), F.array("label").alias("ts"))
    return rounded(mr.perplexity("ps", "ts", ignore=3)(rows, []))


@query("WITH t AS (SELECT string_split(text, ' ') AS w FROM documents) SELECT count(*) AS sequences, CAST(sum(len(list_filter(w, lambda x: x <> ''))) AS BIGINT) AS tokens FROM t")
def count_tokens(read):
    return mr.count_tokens("w", ignore="")(read("documents").select(F.split("text", " ").alias("w")), [])


# -- masks and boxes --------------------------------------------------------------------

MASK = """WITH m AS (SELECT vec_id, unnest(range(64)) AS i, embedding FROM embeddings), c AS (SELECT vec_id, CASE WHEN embedding[i + 1] > 0.05 THEN 2 WHEN embedding[i + 1] > 0 THEN 1 ELSE 0 END AS p, CASE WHEN embedding[(i + 1) % 64 + 1] > 0.05 THEN 2 WHEN embedding[(i + 1) % 64 + 1] > 0 THEN 1 ELSE 0 END AS t FROM m),
l AS (SELECT vec_id, k AS label, CAST(count_if(p = k AND t = k) AS DOUBLE) AS b, CAST(count_if(p = k) AS DOUBLE) AS pp, CAST(count_if(t = k) AS DOUBLE) AS tt FROM c, (SELECT unnest([1, 2]) AS k) GROUP BY vec_id, k HAVING count_if(t = k) > 0)"""


def masks(read):
    level = lambda x: F.when(x > F.lit(0.05).cast("float"), 2).when(x > 0, 1).otherwise(0)
    turned = F.concat(F.slice("embedding", 2, 63), F.slice("embedding", 1, 1))
    return read("embeddings").select("vec_id", F.transform("embedding", level).alias("p"), F.transform(turned, level).alias("t"))


for _name, _sql in {"dice": "2 * b / (pp + tt)", "iou": "b / (pp + tt - b)", "overlap": "coalesce(b / nullif(least(pp, tt), 0), 0)", "pixel_accuracy": "b / tt"}.items():

    def _f(read, name=_name):
        out = mm.mask_metric(name, "vec_id", "p", "t")(masks(read), [])
        return rounded(out.withColumn("label", F.col("label").cast("long")))

    _f.__name__ = _name
    query(f"{MASK} SELECT CAST(label AS BIGINT) AS label, round(avg({_sql}), 6) AS {_name} FROM l GROUP BY label")(_f)


@query("""WITH r AS (SELECT vec_id, embedding AS e, unnest(range(8)) AS i FROM embeddings), a AS (SELECT vec_id, i, list_transform(e[i * 8 + 1 : i * 8 + 8], lambda x: CASE WHEN x > 0 THEN 1e0 ELSE 0e0 END) AS p, list_transform(e[(7 - i) * 8 + 1 : (7 - i) * 8 + 8], lambda x: CASE WHEN x > 0.05 THEN 1e0 ELSE 0e0 END) AS t FROM r),
d AS (SELECT x.vec_id, x.i, y.i AS j, sqrt(list_sum(list_transform(list_zip(x.p, y.t), lambda z: pow(z[1] - z[2], 2)))) AS d FROM a x JOIN a y ON x.vec_id = y.vec_id)
SELECT vec_id, round(greatest((SELECT max(m) FROM (SELECT min(d) AS m FROM d q WHERE q.vec_id = o.vec_id GROUP BY i)), (SELECT max(m) FROM (SELECT min(d) AS m FROM d q WHERE q.vec_id = o.vec_id GROUP BY j))), 6) AS distance FROM (SELECT DISTINCT vec_id FROM a) o""")
def hausdorff_rows(read):
    rows = matrix("embedding", "m", 8)(read("embeddings"))
    one = lambda edge: F.transform("m", lambda r: F.transform(r, lambda x: F.when(x > F.lit(edge).cast("float"), 1.0).otherwise(0.0)))
    rows = rows.select("vec_id", one(0.0).alias("p"), F.reverse(one(0.05)).alias("t"))
    return rounded(rows.select("vec_id", mm.hausdorff_rows("p", "t").alias("distance")))


BOX = """WITH b AS (SELECT l_orderkey AS image, l_linenumber AS n, CAST(l_partkey % 50 AS DOUBLE) AS x, CAST(l_suppkey % 50 AS DOUBLE) AS y, CAST(20 + l_linenumber AS DOUBLE) AS w, CAST(30 AS DOUBLE) AS h FROM lineitem),
i AS (SELECT t.image, t.n, coalesce(max(greatest(least(t.x + t.w, p.x + p.w) - greatest(t.x, p.x), 0) * greatest(least(t.y + t.h, p.y + p.h) - greatest(t.y, p.y), 0) / (t.w * t.h + p.w * p.h - greatest(least(t.x + t.w, p.x + p.w) - greatest(t.x, p.x), 0) * greatest(least(t.y + t.h, p.y + p.h) - greatest(t.y, p.y), 0))), 0) AS iou FROM b t LEFT JOIN b p ON p.image = t.image AND p.n % 2 = 0 WHERE t.n % 2 = 1 GROUP BY t.image, t.n),
g AS (SELECT image, count_if(iou > 0.3e0) AS hit, count(*) AS t, avg(CASE WHEN iou > 0.3e0 THEN iou END) AS m FROM i GROUP BY image), q AS (SELECT image, count(*) AS p FROM b WHERE n % 2 = 0 GROUP BY image)"""


@query(f"{BOX} SELECT round(avg(m), 6) AS mean_iou, round(avg(coalesce(hit, 0) / CAST(p AS DOUBLE)), 6) AS precision, round(avg(hit / CAST(t AS DOUBLE)), 6) AS recall FROM g FULL JOIN q ON q.image = g.image")
def box_detection(read):
    b = read("lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("target_id"), (F.col("l_partkey") % 50).cast("double").alias("x"), (F.col("l_suppkey") % 50).cast("double").alias("y"), (20 + F.col("l_linenumber")).cast("double").alias("w"), F.lit(30.0).alias("h"))
    return rounded(mm.detection(b.where("target_id % 2 = 0"), b.where("target_id % 2 = 1"), 0.3))


@query("WITH r AS (SELECT l_orderkey AS b, l_partkey AS item, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), k AS (SELECT b, item, row_number() OVER (PARTITION BY b ORDER BY q, item) AS rk FROM r), d AS (SELECT DISTINCT x.item AS low, y.item AS high FROM k x JOIN k y ON x.b = y.b AND x.rk < y.rk), s AS (SELECT high AS item, 1 AS s FROM d UNION ALL SELECT low, -1 FROM d) SELECT item, CAST(sum(s) AS BIGINT) AS score FROM s GROUP BY item")
def aggregate_pair_scores(read):
    lines = read("lineitem")
    n = lines.count()
    lines = lines.select(F.col("l_orderkey").alias("batch"), F.col("l_partkey").alias("item"), "l_quantity").repartition(mk.parts_of(n), "batch")
    rows = lines.groupBy("batch", "item").agg(F.max("l_quantity").alias("q"))
    return mk.pair_scores(rows.withColumn("rank", F.row_number().over(Window.partitionBy("batch").orderBy("q", "item"))), n)


BATCHED = f"""WITH i AS (SELECT p_partkey AS item, CAST(p_retailprice AS DOUBLE) AS v, count(*) OVER () AS n FROM part), d AS (SELECT item, v, r * round(n / 8) + floor({uniform_sql("5", "r", "item")} * round(n / 8)) AS batch FROM i, LATERAL (SELECT CAST(unnest(range(CAST(ceil(ceil(2 * i.n * log10(i.n)) / i.n) AS BIGINT))) AS BIGINT) AS r)),
k AS (SELECT batch, item, row_number() OVER (PARTITION BY batch ORDER BY v * (0.8e0 + 0.4e0 * {uniform_sql("noise", "CAST(batch AS BIGINT)", "item")}), item) AS p FROM d),
s AS (SELECT DISTINCT x.item AS high, y.item AS low FROM k x JOIN k y ON x.batch = y.batch AND x.p < y.p)
SELECT item, CAST(coalesce(sum(s), 0) AS BIGINT) AS score FROM i LEFT JOIN (SELECT high AS item, 1 AS s FROM s UNION ALL SELECT low, -1 FROM s) USING (item) GROUP BY item"""


def priced_parts(read):
    return read("part").select(F.col("p_partkey").alias("item"), F.col("p_retailprice").cast("double").alias("v"))


@query(BATCHED)
def aggregate_rankings(read):
    return mk.aggregate_rankings(priced_parts(read), lambda batch: F.col("v") * (F.lit(0.8) + F.lit(0.4) * uniform("noise", batch, "item")), seed=5)


WINS = """WITH RECURSIVE e AS (SELECT CAST(label AS BIGINT) AS label, embedding[1] AS a, (label + 1 + CAST(floor(abs(CAST(embedding[2] AS DOUBLE)) * 1000) AS BIGINT) % 8) % 10 AS other FROM embeddings),
w AS (SELECT CASE WHEN a > 0 THEN label ELSE other END AS winner, CASE WHEN a > 0 THEN other ELSE label END AS loser, count(*) AS n FROM e GROUP BY ALL), i AS (SELECT winner AS item FROM w UNION SELECT loser FROM w),
m AS (SELECT list(item ORDER BY item) AS items, list(won ORDER BY item) AS m, count(*) AS n FROM (SELECT x.item, list(CASE WHEN x.item = y.item THEN 0e0 ELSE coalesce(w.n, 0e0) END ORDER BY y.item) AS won FROM i x CROSS JOIN i y LEFT JOIN w ON winner = x.item AND loser = y.item GROUP BY x.item)),
r AS (SELECT 0 AS k, list_transform(items, lambda x: 1e0) AS t FROM m UNION ALL SELECT k + 1, list_transform(range(1, n + 1), lambda i: pow(s[i], 0.25e0) * pow((list_sum(list_transform(range(1, n + 1), lambda j: m[i][j] * s[j] / (s[i] + s[j]))) + 0.001e0 * (list_sum(s) - s[i])) / (list_sum(list_transform(range(1, n + 1), lambda j: m[j][i] / (s[i] + s[j]))) + 0.001e0 * (n - 1)), 0.75e0)) FROM (SELECT k, m, n, list_transform(t, lambda x: x * n / list_sum(t)) AS s FROM r, m WHERE k < 300))
SELECT unnest(items) AS item, round(unnest(list_transform(t, lambda x: x * n / list_sum(t))), 6) AS strength FROM r, m WHERE k = 300"""


@query(WINS)
def bradley_terry(read):
    e = read("embeddings").select(F.col("label").cast("long").alias("label"), F.element_at("embedding", 1).alias("a"), F.element_at("embedding", 2).cast("double").alias("b"))
    other = (F.col("label") + 1 + F.floor(F.abs("b") * 1000) % 8) % 10
    wins = e.select(F.when(F.col("a") > 0, F.col("label")).otherwise(other).alias("winner"), F.when(F.col("a") > 0, other).otherwise(F.col("label")).alias("loser"), F.lit(1).alias("n"))
    return rounded(mk.luce_spectral(wins))


def active_sql(rounds: int, games: int, seed: int, confidence: float) -> str:
    reach = repr(math.sqrt(math.log(2 / (1 - confidence)) / (2 * games))) + "e0"
    out = f"""WITH i AS (SELECT p_partkey AS item, CAST(p_retailprice AS DOUBLE) AS v FROM part), s0 AS (SELECT item, v, count(*) OVER () AS n, {uniform_sql(seed, "'start'", "item")} AS at0, 0e0 AS low, CAST(count(*) OVER () AS DOUBLE) AS high, 0 AS games FROM i)"""
    for r in range(rounds):
        out += f""", o{r} AS (SELECT *, least(CAST(floor(low) AS BIGINT), place) AS a, greatest(least(CAST(ceil(high) AS BIGINT), n) - 1, place) AS b FROM (SELECT *, row_number() OVER (ORDER BY at0, item) - 1 AS place FROM s{r})),
d{r} AS (SELECT item, v, CASE WHEN slot >= place THEN slot + 1 ELSE slot END AS place FROM (SELECT item, v, place, a + CAST(floor({uniform_sql(seed, str(r), "item", "k")} * (b - a)) AS BIGINT) AS slot FROM o{r}, (SELECT unnest(range({games})) AS k) WHERE b > a)),
w{r} AS (SELECT item, count_if(CASE WHEN {uniform_sql("noise", "other", "item")} < 0.1e0 THEN {uniform_sql("coin", "other", "item")} < 0.5e0 ELSE ov < v END) / {games}e0 AS share FROM (SELECT d.item, d.v, o.item AS other, o.v AS ov FROM d{r} d JOIN o{r} o USING (place)) GROUP BY item),
s{r + 1} AS (SELECT o.item, v, n, coalesce(a + (b - a + 1) * share, at0) AS at0, CASE WHEN share IS NULL THEN low ELSE greatest(a + (b - a + 1) * share - (b - a + 1) * {reach}, a) END AS low, CASE WHEN share IS NULL THEN high ELSE least(a + (b - a + 1) * share + (b - a + 1) * {reach}, b + 1e0) END AS high, games + CASE WHEN share IS NULL THEN 0 ELSE {games} END AS games FROM o{r} o LEFT JOIN w{r} w USING (item))"""
    return out + f" SELECT item, row_number() OVER (ORDER BY at0, item) - 1 AS place, round(low, 6) AS low, round(high, 6) AS high, CAST(games AS BIGINT) AS games FROM s{rounds}"


@query(active_sql(3, 32, 3, 0.95))
def active_ranking(read):
    noisy = lambda a, b: F.when(uniform("noise", a["item"], b["item"]) < 0.1, uniform("coin", a["item"], b["item"]) < 0.5).otherwise(a["v"] < b["v"])
    return rounded(mk.active_ranking(priced_parts(read), noisy, rounds=3, seed=3))


@query(f"{S} SELECT doc_id, round(p, 6) AS p FROM s WHERE p > 0.9e0")
def per_sample_filter(read):
    return predictions(read).where(col("p") > 0.9).select("doc_id", "p")
