"""Small fixtures for what SQL does not reach: ties, p-values, stored folds, caches, streams, resampling, rankings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from samplemill.functions.running import running
from samplemill.metrics import classification as mc
from samplemill.metrics import regression as mr
from samplemill.metrics.base import interval
from samplemill.operators import samples as so
from samplemill.operators import splits as sp
from samplemill.plans.dataset import Cache
from samplemill.plans.evaluator import evaluate
from samplemill.plans.pipeline import Pipeline
from samplemill.streaming import incremental


def test_equal_draws_are_ordered_by_key(spark, monkeypatch):
    monkeypatch.setattr(sp, "uniform", lambda seed, *keys: F.lit(0.5))
    rows = spark.range(23).select("id", (F.col("id") % 2).alias("label"))
    got = sp.balanced_batches(rows, "id", "label", {0: 3, 1: 3}, mode="down").collect()
    assert len(got) == len({(r.batch, r.slot, r.label) for r in got}) == 3 * 3 * 2 + 6
    folds = sp.balanced_folds(rows, "id", ["label"], 4).collect()
    assert sorted(r.fold for r in folds if r.label == 0) == [0] * 3 + [1] * 3 + [2] * 3 + [3] * 3
    assert {r.fold for r in sp.kfold(rows, "id", 5).collect()} == set(range(5))


def test_p_values(spark):
    rows = spark.createDataFrame([(1.959964, 3.0, 12.0, 0.5, 30), (None, 0.0, 0.0, None, 2)], "z double, a double, b double, r double, n int")
    got = rows.select(*(mc.p_value(k, *map(F.col, c)).alias(k) for k, c in {"normal": ["z"], "binomial": ["a", "b"], "pearson": ["r", "n"]}.items())).collect()
    assert got[0].normal == pytest.approx(0.05, abs=1e-6)
    assert got[0].binomial == pytest.approx(2 * sum(math.comb(15, k) for k in range(4)) / 2**15)
    assert got[0].pearson == pytest.approx(0.004902, abs=1e-5)
    assert got[1].normal is None and got[1].binomial == 1.0 and got[1].pearson is None
    chi = mc.mcnemar_test("x", "y", exact=False)(spark.createDataFrame([(True, False)] * 9 + [(False, True)], "x boolean, y boolean"), []).first()
    assert chi.statistic == pytest.approx(4.9) and chi.p_value == pytest.approx(0.02686, abs=1e-4)


def test_intervals_of_all_kinds_hold_the_estimate(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, int(rng.random() < 0.7), 1) for i in range(60)], "id int, hit int, one int")
    metric = lambda w: mc.accuracy("hit", "one", w)
    for method in ("percentile", "pivotal", "normal"):
        cells = interval(metric, "id", replicates=2000, method=method, cells=["hit", "one"])(rows).first()
        p = cells.org
        assert cells.conf_lower < p < cells.conf_upper
        assert cells.std == pytest.approx(math.sqrt(p * (1 - p) / 60), rel=0.1) and cells.mean == pytest.approx(p, abs=0.01)
    plain = interval(metric, "id", replicates=300)(rows).first()
    assert plain.std == pytest.approx(cells.std, rel=0.3)


def test_stored_folds_are_used_again_and_must_cover_the_keys(spark, tmp_path):
    path = str(tmp_path / "folds")
    rows = spark.range(40).select("id", (F.col("id") % 3).alias("k"))
    first = {r.id: r.fold for r in sp.saved_folds(rows, "id", ["k"], 4, path).collect()}
    assert {r.id: r.fold for r in sp.saved_folds(rows, "id", ["k"], 4, path, seed=9).collect()} == first
    assert {r.id: r.fold for r in sp.saved_folds(rows, "id", ["k"], 4, path, seed=9, reset=True).collect()} != first
    with pytest.raises(Exception, match="no stored fold for 40"):
        sp.saved_folds(spark.range(41).select("id", F.lit(0).alias("k")), "id", ["k"], 4, path).collect()


def test_a_cache_knows_its_samples(spark, tmp_path):
    cache, steps = Cache(spark, str(tmp_path)), Pipeline.of("p", so.set_value("x", 1))
    rows = spark.range(5).withColumnRenamed("id", "data.sample_id")
    assert cache.get("a", steps, rows).count() == cache.get("a", steps, rows).count() == 5
    with pytest.raises(ValueError, match="other samples"):
        cache.get("a", steps, rows.where("`data.sample_id` > 0"))
    with pytest.raises(ValueError, match="another pipeline"):
        cache.get("a", Pipeline.of("p", so.set_value("x", 2)), rows)


def test_a_repeated_micro_batch_counts_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "pred int, target int").write.parquet(source)
    for name in ("one", "two"):
        stream = spark.readStream.schema("pred int, target int").parquet(source)
        incremental.accumulate(stream, incremental.confusion_counts("pred", "target"), out, str(tmp_path / name), availableNow=True).awaitTermination()
    assert {r.name: r.value for r in incremental.totals(spark, out).collect()} == {"1/1": 1.0, "1/0": 1.0, "0/0": 1.0}


def test_empty_and_null_inputs(spark):
    none = spark.createDataFrame([], "p double, t int")
    assert evaluate(none, {"auc": mc.auc("p", "t"), "err": mr.errors("p", "t")}).where("value is not null").count() == 0
    nulls = spark.createDataFrame([(None, 1), (0.5, None), (0.2, 0), (0.9, 1)], "p double, t int")
    assert mr.spearman("p", "t")(nulls, []).first().n == 2


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_in_one_range_and_in_many(spark, descending):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 != 0, (F.col("id") * 37) % 101).alias("k"), F.col("id").alias("v"))
    one, many = ({(r.g, r.k): (r.v, r.v_before) for r in running(rows, "k", ["v"], ["g"], descending, n).collect()} for n in (10**6, 7))
    assert one == many and one
    plain = {}
    for r in rows.where("k is not null").collect():
        plain[r.g, r.k] = plain.get((r.g, r.k), 0) + r.v
    assert one == {(g, k): (v, sum(x for (h, j), x in plain.items() if h == g and (j > k if descending else j < k))) for (g, k), v in plain.items()}
