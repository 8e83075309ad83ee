"""Multinomial bootstrap draws against exact probabilities and plain resampling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from samplemill.metrics import bootstrap as bs
from samplemill.metrics import classification as mc
from samplemill.metrics.base import interval


@pytest.mark.parametrize("n,p", [(1, 0.5), (7, 0.2), (40, 0.9), (300, 0.013)])
def test_a_binomial_count_is_the_quantile(n, p):
    cdf = np.cumsum([math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(n + 1)])
    u = np.random.default_rng(n).random(500)
    assert bs.binomial(u, np.full(500, n), p).tolist() == [min(int((cdf <= x).sum()), n) for x in u]


def test_ends_of_the_range_and_large_counts():
    u = np.array([0.0, 0.25, 0.5, 0.75, 1 - 2.0**-52])
    assert bs.binomial(u, np.arange(5), 1.0).tolist() == [0, 1, 2, 3, 4]
    assert bs.binomial(u, np.arange(5), 0.0).tolist() == [0] * 5
    n = 10**10
    got = bs.binomial(u, np.full(5, n), 0.3)
    assert abs(got[2] - 0.3 * n) <= 1 and (np.diff(got) > 0).all() and got[0] >= 0 and got[4] <= n
    assert got[3] - 0.3 * n == pytest.approx(0.6744898 * math.sqrt(n * 0.21), rel=1e-3)


def test_many_cells_go_through_chunks_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(bs, "CHUNK", 8)
    rows = spark.range(700).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 50 != 0, F.col("id") % 300).alias("a"), F.lit("x").alias("s"))
    want = {(r.g, r.a): r["count"] for r in rows.groupBy("g", "a").count().collect()}
    got = bs.draws(rows, 60, ["a"], ["g", "s"], ["s"], 5).collect()
    total, times = {}, {}
    for r in got:
        total[r.g, r.replicate] = total.get((r.g, r.replicate), 0) + r["__times"]
        times[r.g, r.a] = times.get((r.g, r.a), 0) + r["__times"]
    assert len(got) == len({(r.g, r.replicate, r.a) for r in got}) and total == {(g, i): 350 for g in (0, 1) for i in range(60)}
    # about 60 draws of each row: Poisson with that mean
    z = np.array([(times.get(k, 0) - 60 * n) / math.sqrt(60 * n) for k, n in want.items()])
    assert set(times) <= set(want) and abs(z.mean()) < 0.05 and 0.8 < z.std() < 1.2 and abs(z).max() < 5


def test_interval_of_an_area_is_that_of_plain_draws(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(60) < 0.35).astype(int)
    score = np.round(y * 0.9 + rng.normal(0, 0.6, 60), 2)
    rows = spark.createDataFrame([(i, float(s), int(t)) for i, (s, t) in enumerate(zip(score, y))], "id int, score double, target int")
    got = interval(lambda w: mc.auc("score", "target", w), "id", ["target"], cells=["score", "target"])(rows).first()
    pos, neg = score[y == 1], score[y == 0]
    area = lambda a, b: ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))
    many = np.sort([area(rng.choice(pos, len(pos)), rng.choice(neg, len(neg))) for _ in range(10_000)])
    assert got.org == pytest.approx(area(pos, neg)) and got.mean == pytest.approx(many.mean(), abs=0.003) and got.std == pytest.approx(many.std(), rel=0.05)
    assert got.conf_lower == pytest.approx(many[250], abs=0.01) and got.conf_upper == pytest.approx(many[9750], abs=0.01)


def test_no_rows_no_draws(spark):
    assert bs.draws(spark.createDataFrame([], "g int, a int"), 5, ["a"], ["g"], [], 1).count() == 0
