"""Classification, calibration and comparison of classifiers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions import stats
from ..functions.columns import col, ratio
from ..functions.running import mid_ranks, running
from ..functions.storage import cut
from .base import Metric, grouped, join_groups


def scores(df: DataFrame, pred: str, target: str, by: Sequence[str], weight: str | None = None, positive: int = 1) -> DataFrame:
    """(*by, score, w, pos): one row per prediction."""
    w = col(weight).cast("double") if weight else F.lit(1.0)
    return df.select(*map(col, by), col(pred).cast("double").alias("score"), w.alias("w"), F.when(col(target) == positive, w).otherwise(0.0).alias("pos")).where("score is not null").withColumn("neg", F.col("w") - F.col("pos"))


def auc(pred: str, target: str, weight: str | None = None, positive: int = 1) -> Metric:
    """Area under the ROC curve, ties counting one half; null without both classes."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        at = running(scores(df, pred, target, by, weight, positive), "score", ["pos", "neg"], by)
        out = grouped(at, by).agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
        return out.select(*map(col, by), ratio(F.col("u"), F.col("p") * F.col("n")).alias("auc"))

    return run


def roc_points(pred: str, target: str, weight: str | None = None) -> Metric:
    """(*by, threshold, fpr, tpr) at every distinct score, and the origin with a null threshold."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        at = running(scores(df, pred, target, by, weight), "score", ["pos", "neg"], by, descending=True)
        whole = grouped(at, by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
        end = join_groups(at, whole, by)
        points = end.select(*map(col, by), F.col("score").alias("threshold"), ratio(F.col("neg_before") + F.col("neg"), F.col("n")).alias("fpr"), ratio(F.col("pos_before") + F.col("pos"), F.col("p")).alias("tpr"))
        return points.unionByName(whole.select(*map(col, by), F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))

    return run


def roc_curve(pred: str, target: str, weight: str | None = None) -> Metric:
    """The points of the curve without those between two equal steps; the first and last stay."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        at = running(scores(df, pred, target, by, weight), "score", ["pos", "neg"], by, descending=True)
        whole = grouped(at, by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.min("score").alias("last"))
        # the next step is looked up by place
        place = running(at.withColumn("one", F.lit(1).cast("long")), "score", ["one"], by, descending=True).select(*map(col, by), "score", F.col("one_before").alias("place"))
        steps = join_groups(at, place, [*by, "score"])
        nxt = steps.select(*map(col, by), (F.col("place") - 1).alias("place"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg"))
        both = join_groups(join_groups(steps, nxt, [*by, "place"], "left"), whole, by)
        turn = (F.col("place") == 0) | (F.col("score") == F.col("last")) | (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
        points = both.where(turn).select(*map(col, by), F.col("score").alias("threshold"), ratio(F.col("neg_before") + F.col("neg"), F.col("n")).alias("fpr"), ratio(F.col("pos_before") + F.col("pos"), F.col("p")).alias("tpr"))
        return points.unionByName(whole.select(*map(col, by), F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))

    return run


def auc_partial(pred: str, target: str, max_fpr: float, weight: str | None = None) -> Metric:
    """The area up to `max_fpr`, standardised so that chance is 1/2 and the best is 1."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        at = running(scores(df, pred, target, by, weight), "score", ["pos", "neg"], by, descending=True)
        rows = join_groups(at, grouped(at, by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")), by)
        x0, dx = ratio(F.col("neg_before"), F.col("n")), ratio(F.col("neg"), F.col("n"))
        y0, dy = ratio(F.col("pos_before"), F.col("p")), ratio(F.col("pos"), F.col("p"))
        width = F.greatest(F.least(x0 + dx, F.lit(float(max_fpr))) - x0, F.lit(0.0))
        area = F.when(dx > 0, width * (y0 + dy * (width / F.when(dx > 0, dx)) / 2)).otherwise(0.0)
        least, most = max_fpr**2 / 2, max_fpr
        return grouped(rows, by).agg((F.lit(0.5) * (1 + (F.sum(area) - least) / (most - least))).alias("auc"))

    return run


def auc_pr(pred: str, target: str, weight: str | None = None) -> Metric:
    """The trapezoid area under precision over recall, from (0, 1) on."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        at = running(scores(df, pred, target, by, weight), "score", ["pos", "neg"], by, descending=True)
        whole = grouped(at, by).agg(F.sum("pos").alias("p"))
        rows = join_groups(at, whole, by)
        tp, all_ = F.col("pos_before") + F.col("pos"), F.col("pos_before") + F.col("pos") + F.col("neg_before") + F.col("neg")
        before = F.when(F.col("pos_before") + F.col("neg_before") > 0, ratio(F.col("pos_before"), F.col("pos_before") + F.col("neg_before"))).otherwise(1.0)
        return grouped(rows, by).agg(F.sum(ratio(F.col("pos"), F.col("p")) * (ratio(tp, all_) + before) / 2).alias("auc_pr"))

    return run


def auc_multilabel(preds: str, targets: str, average: str = "micro") -> Metric:
    """Vectors of scores and 0/1 labels: pooled (micro), or the mean over the labels (macro) that have both classes."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        rows = df.select(*map(col, by), F.posexplode(F.arrays_zip(col(preds).alias("p"), col(targets).alias("t"))).alias("label", "x")).select(*map(col, by), "label", F.col("x.p").alias("score"), F.col("x.t").alias("target"))
        if average == "micro":
            return auc("score", "target")(rows, by)
        return grouped(auc("score", "target")(rows, [*by, "label"]), by).agg(F.avg("auc").alias("auc"))

    return run


def accuracy(pred: str, target: str, weight: str | None = None) -> Metric:
    w = col(weight).cast("double") if weight else F.lit(1.0)
    return lambda df, by=(): grouped(df, by).agg(ratio(F.sum(F.when(col(pred) == col(target), w).otherwise(0.0)), F.sum(w)).alias("accuracy"))


def confusion(pred: str, target: str, weight: str | None = None, positive: int = 1) -> Metric:
    """tp, fn, fp, tn (of predicted classes against one class) and what follows; precision is 0 without predictions."""
    w = col(weight).cast("double") if weight else F.lit(1.0)
    p, t = col(pred) == positive, col(target) == positive

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        cells = {"tp": p & t, "fn": ~p & t, "fp": p & ~t, "tn": ~p & ~t}
        out = grouped(df, by).agg(*(F.sum(F.when(c, w).otherwise(0.0)).alias(n) for n, c in cells.items()))
        tp, fn, fp, tn = map(F.col, cells)
        return out.withColumns({"sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "precision": F.coalesce(ratio(tp, tp + fp), F.lit(0.0)), "f1": ratio(2 * tp, 2 * tp + fp + fn)})

    return run


def confusion_matrix(pred: str, target: str, classes: Sequence) -> Metric:
    """(*by, target, one column per class, total, and each as a percentage of the row)."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        cells = [F.count_if(col(pred) == F.lit(c)).alias(str(c)) for c in classes]
        out = df.groupBy(*map(col, by), col(target).alias("target")).agg(*cells, F.count("*").alias("total"))
        return out.withColumns({f"{c}_percent": ratio(100 * col(str(c)), F.col("total")) for c in classes})

    return run


def brier(probabilities: str, target: str) -> Metric:
    """The mean over rows of sum_c (p_c - [target = c])^2."""
    squares = F.aggregate(F.transform(col(probabilities), lambda p, i: (p - F.when(i == col(target), 1.0).otherwise(0.0)) * (p - F.when(i == col(target), 1.0).otherwise(0.0))), F.lit(0.0), lambda a, x: a + x)
    return lambda df, by=(): grouped(df, by).agg(F.avg(squares).alias("brier"))


def brier_skill(probabilities: str, target: str) -> Metric:
    """1 - the Brier score over that of the classes' shares."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        counts = df.groupBy(*map(col, by), col(target).alias("__c")).agg(F.count("*").cast("double").alias("n"))
        base = grouped(counts, by).agg((1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("base"))
        return join_groups(brier(probabilities, target)(df, by), base, by).select(*map(col, by), (1 - ratio(F.col("brier"), F.col("base"))).alias("brier_skill"))

    return run


def matthews(pred: str, target: str) -> Metric:
    """The multi-class correlation; 0 where undefined."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        cells = df.groupBy(*map(col, by), col(pred).alias("p"), col(target).alias("t")).agg(F.count("*").cast("double").alias("n"))
        each = cells.select(*map(col, by), F.explode(F.array(F.struct(F.col("p").alias("c"), F.col("n").alias("a"), F.lit(0.0).alias("b")), F.struct(F.col("t").alias("c"), F.lit(0.0).alias("a"), F.col("n").alias("b")))).alias("x"), F.when(F.col("p") == F.col("t"), F.col("n")).otherwise(0.0).alias("hit"), F.col("n"))
        side = each.groupBy(*map(col, by), "x.c").agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b"), (F.sum("hit") / 2).alias("hit"))
        g = grouped(side, by).agg(F.sum("hit").alias("c"), F.sum("a").alias("s"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
        s2 = F.col("s") * F.col("s")
        return g.select(*map(col, by), F.coalesce(ratio(F.col("c") * F.col("s") - F.col("ab"), F.sqrt((s2 - F.col("aa")) * (s2 - F.col("bb")))), F.lit(0.0)).alias("mcc"))

    return run


def balanced_accuracy(pred: str, target: str) -> Metric:
    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        recall = df.groupBy(*map(col, by), col(target).alias("__t")).agg(F.avg((col(pred) == col(target)).cast("double")).alias("r"))
        return grouped(recall, by).agg(F.avg("r").alias("balanced_accuracy"))

    return run


def to_class(probabilities: str, operation_point: float | Sequence[tuple[int, float]] | None = None) -> Column:
    """The class of a vector: argmax; 1 if the second is over the point; or the first listed class over its own, else -1."""
    v = col(probabilities)
    if operation_point is None or operation_point == []:
        return fc.argmax(v)
    if isinstance(operation_point, (int, float)):
        return (F.get(v, F.lit(1)) > F.lit(float(operation_point))).cast("long")
    out = F
    for c, t in operation_point:
        out = out.when(F.get(v, F.lit(c)) > F.lit(float(t)), c)
    return out.otherwise(-1).cast("long")


def ensemble_mean(*preds: str) -> Column:
    """Element by element, the mean of the models' vectors without NaN and nulls."""
    parts = F.array(*map(col, preds))

    def at(i):
        x = F.filter(F.transform(parts, lambda v: F.get(v, i)), lambda y: y.isNotNull() & ~F.isnan(y))
        return ratio(fc.total(x), F.size(x))

    return F.transform(F.sequence(F.lit(0), F.array_max(F.transform(parts, F.size)) - 1), at)


def ensemble_vote(*preds: str) -> Column:
    """The class with the most votes, the smallest at a tie."""
    votes = F.array_sort(F.filter(F.array(*(col(p).cast("long") for p in preds)), lambda x: x.isNotNull()))
    tally = F.transform(F.array_distinct(votes), lambda c: F.struct((-F.size(F.filter(votes, lambda x: x == c))).alias("n"), c.alias("c")))
    return F.get(F.array_sort(tally), F.lit(0))["c"]


def confidence(df: DataFrame, probabilities: str, target: str, by: Sequence[str], bins: int) -> DataFrame:
    """(*by, bin, conf, hit): bins of equal width, left ends included; a confidence of 1 is in none."""
    top = F.array_max(col(probabilities)).cast("double")
    rows = df.select(*map(col, by), top.alias("conf"), (fc.argmax(col(probabilities)) == col(target)).cast("double").alias("hit"))
    return rows.withColumn("bin", F.when(F.col("conf") < 1, F.floor(F.col("conf") * bins).cast("long")))


def quantile_edges(rows: DataFrame, value: str, by: Sequence[str], quantiles: int) -> DataFrame:
    """(*by, edges): the quantiles at 0, 1 / n, ... 1 with plotting position 0.4 + 0.2 p, by places, so that no task holds all values."""
    at = cut(running(rows.select(*map(col, by), col(value).alias("x"), F.lit(1).cast("long").alias("one")), "x", ["one"], by))
    found = join_groups(at, grouped(at, by).agg(F.sum("one").alias("all")), by)
    picks = []
    for i in range(quantiles + 1):
        p = i / quantiles
        place = F.col("all") * F.lit(p) + F.lit(0.4 + 0.2 * p)
        k = F.floor(F.greatest(F.lit(1.0), F.least(place, F.col("all") - 1)))
        share = F.greatest(F.lit(0.0), F.least(place - k, F.lit(1.0)))
        for name, n in (("lo", k - 1), ("hi", F.least(k, F.col("all") - 1))):
            picks.append(F.max(F.when((F.col("one_before") <= n) & (n < F.col("one_before") + F.col("one")), F.col("x"))).alias(f"{name}{i}"))
        picks.append(F.first(share).alias(f"s{i}"))
    out = grouped(found, by).agg(*picks)
    return out.select(*map(col, by), F.array(*((1 - F.col(f"s{i}")) * F.col(f"lo{i}") + F.col(f"s{i}") * F.col(f"hi{i}") for i in range(quantiles + 1))).alias("edges"))


def reliability_quantiles(probabilities: str, target: str, quantiles: int = 10) -> Metric:
    """(*by, bin, low, high, n, accuracy, mean_confidence) of bins [low, high) between the confidences' quantiles."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        rows = cut(confidence(df, probabilities, target, by, 1).drop("bin"))
        edges = quantile_edges(rows, "conf", by, quantiles)
        placed = join_groups(rows, edges, by).withColumn("bin", (fc.digitize(F.col("conf"), F.col("edges")) - 1).cast("long")).where((F.col("bin") >= 0) & (F.col("bin") < quantiles))
        found = placed.groupBy(*map(col, by), "bin").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("conf").alias("mean_confidence"))
        every = edges.select(*map(col, by), "edges", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(quantiles - 1).cast("long"))).alias("bin"))
        out = join_groups(every, found, [*by, "bin"], "left")
        return out.select(*map(col, by), "bin", F.get("edges", F.col("bin").cast("int")).alias("low"), F.get("edges", F.col("bin").cast("int") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), "accuracy", "mean_confidence")

    return run


def reliability(probabilities: str, target: str, bins: int = 10) -> Metric:
    """(*by, bin, low, high, n, accuracy, mean_confidence) of all bins; empty ones have nulls."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        rows = confidence(df, probabilities, target, by, bins).where("bin is not null")
        found = rows.groupBy(*map(col, by), "bin").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("conf").alias("mean_confidence"))
        groups = df.select(*map(col, by)).distinct() if by else df.sparkSession.range(1).select()
        every = groups.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
        out = join_groups(every, found, [*by, "bin"], "left")
        return out.select(*map(col, by), "bin", (F.col("bin") / F.lit(float(bins))).alias("low"), ((F.col("bin") + 1) / F.lit(float(bins))).alias("high"), F.coalesce("n", F.lit(0)).alias("n"), "accuracy", "mean_confidence")

    return run


def calibration_error(probabilities: str, target: str, bins: int = 10) -> Metric:
    """ece and mce against the bins' upper ends."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        at = reliability(probabilities, target, bins)(df, by).where("n > 0")
        gap = F.abs(F.col("accuracy") - F.col("high"))
        return join_groups(grouped(at, by).agg(F.sum(F.col("n") * gap).alias("s"), F.max(gap).alias("mce")), grouped(df, by).agg(F.count("*").alias("all")), by).select(*map(col, by), ratio(F.col("s"), F.col("all")).alias("ece"), "mce")

    return run


def find_temperature(df: DataFrame, logits: str, target: str, steps: int = 40) -> float:
    """The temperature of the least negative log-likelihood, by golden section over its logarithm: two numbers
    reach the driver per step."""
    gold = (math.sqrt(5) - 1) / 2
    lo, hi = math.log(0.05), math.log(20.0)

    def loss(*xs: float) -> list[float]:
        return list(df.agg(*(F.avg(-F.log(F.greatest(F.get(fc.softmax(col(logits), math.exp(x)), col(target).cast("int")), F.lit(1e-300)))).alias(f"x{i}") for i, x in enumerate(xs))).first())

    a, b = hi - gold * (hi - lo), lo + gold * (hi - lo)
    fa, fb = loss(a, b)
    for _ in range(steps):
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - gold * (hi - lo)
            (fa,) = loss(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + gold * (hi - lo)
            (fb,) = loss(b)
    return math.exp((lo + hi) / 2)


def delong(pred1: str, pred2: str, target: str) -> Metric:
    """auc1, auc2, cov11, cov12, cov22, z and p_value of two correlated areas, from mid-ranks of distinct scores."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        rows = df.select(*map(col, by), (col(target) == 1).cast("int").alias("t"), *(col(p).cast("double").alias(f"s{i}") for i, p in enumerate((pred1, pred2), 1)))
        # equal rows count as one, with their number as weight
        rows = cut(rows.groupBy(*map(col, by), "t", "s1", "s2").agg(F.count("*").alias("w")))
        size = grouped(rows, by).agg(F.sum(F.col("t") * F.col("w")).cast("double").alias("m"), F.sum((1 - F.col("t")) * F.col("w")).cast("double").alias("n"))
        rows = join_groups(rows, size, by)
        for i in (1, 2):
            every = mid_ranks(rows, f"s{i}", by, "w").withColumnRenamed("rank", "r_all")
            own = mid_ranks(rows, f"s{i}", [*by, "t"], "w").withColumnRenamed("rank", "r_own")
            rows = join_groups(join_groups(rows, every, [*by, f"s{i}"]), own, [*by, "t", f"s{i}"])
            v = F.col("r_all") - F.col("r_own")
            rows = rows.withColumn(f"v{i}", F.when(F.col("t") == 1, ratio(v, F.col("n"))).otherwise(1 - ratio(v, F.col("m")))).drop("r_all", "r_own")
        rows = cut(rows)
        # the means first, so that the moments are taken around them
        means = rows.groupBy(*map(col, by), "t").agg(*((F.sum(F.col("w") * F.col(f"v{i}")) / F.sum("w")).alias(f"mean{i}") for i in (1, 2)))
        d = join_groups(rows, means, [*by, "t"]).withColumns({f"d{i}": F.col(f"v{i}") - F.col(f"mean{i}") for i in (1, 2)})

        def side(t: int, i: int, j: int) -> Column:
            n = F.first("m" if t else "n")
            return ratio(F.sum(F.when(F.col("t") == t, F.col("w") * F.col(f"d{i}") * F.col(f"d{j}"))), n - 1) / n

        cov = {f"cov{i}{j}": side(1, i, j) + side(0, i, j) for i, j in ((1, 1), (1, 2), (2, 2))}
        out = grouped(d, by).agg(*(F.max(F.when(F.col("t") == 1, F.col(f"mean{i}"))).alias(f"auc{i}") for i in (1, 2)), *(c.alias(k) for k, c in cov.items()))
        z = F.abs(F.col("auc1") - F.col("auc2")) / F.sqrt(F.col("cov11") + F.col("cov22") - 2 * F.col("cov12") + F.lit(1e-30))
        return out.withColumn("z", z).withColumn("p_value", p_value("normal", F.col("z")))

    return run


def p_value(kind: str, *numbers: Column) -> Column:
    """A p-value as a column of a table of results, which has a row a group: `normal` of z, `binomial` of two counts, `chi2` of a statistic
    with one degree of freedom, `pearson` of r and n."""
    f = {"normal": stats.two_sided_normal, "binomial": lambda a, b: stats.binomial_two_sided(int(min(a, b)), int(a + b)), "chi2": stats.chi2_one, "pearson": lambda r, n: stats.pearson_p(r, int(n))}[kind]

    def one(values: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or any(v is None or v != v for v in x) else f(*x) for x in values])

    return F.pandas_udf(one, "double")(F.array(*(n.cast("double") for n in numbers)))


def mcnemar_test(a: str, b: str, exact: bool = True) -> Metric:
    """both, only1, only2, none, statistic and p_value of two models' correctness."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        out = contingency(a, b)(df, by)
        x, y = F.col("only1").cast("double"), F.col("only2").cast("double")
        if exact:
            return out.withColumns({"statistic": F.least(x, y), "p_value": p_value("binomial", x, y)})
        s = F.coalesce(ratio((F.abs(x - y) - 1) * (F.abs(x - y) - 1), x + y), F.lit(0.0))
        return out.withColumns({"statistic": s, "p_value": p_value("chi2", s)})

    return run


def contingency(a: str, b: str) -> Metric:
    """both, only1, only2 and none of two booleans."""
    x, y = col(a).cast("boolean"), col(b).cast("boolean")
    return lambda df, by=(): grouped(df, by).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only1"), F.count_if(~x & y).alias("only2"), F.count_if(~x & ~y).alias("none"))
