import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from samplemill.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, id string, rank string, vector string"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, every=100, k=5, low=80):
    rows = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(x)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in rows:
        if i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for j, m, w in rows if j != i)
        for s, p, _ in [x for x in scored if x[2] == lab][:k]:
            fits = [(t, j) for t, j, m in scored if m != lab and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(fits[:k])]
    return sorted(out)


def mined(spark, rows, **more):
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)
    out = negatives.mine(negatives.shifted_labels(negatives.usable(table)), F.col("id") % 100 == 0, **more)
    return sorted(tuple(r[c] for c in COLUMNS) for r in out.collect())


@pytest.mark.parametrize("seed", range(3))
def test_ties_and_hot_labels(spark, seed):
    rng = np.random.default_rng(seed)
    ids = rng.permutation(4000)[:1500].tolist()
    # few distinct vectors, so that scores tie; one label holds most rows
    rows = [(i, int(rng.choice([0, 0, 0, 1, 2, 9])), np.round(rng.normal(0.2, 0.2, 6), [0, 1, 2][seed]).astype(np.float32).tolist()) for i in ids]
    want = brute(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, limit=100) == want


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, i % 3, [0.1 * (i % 11), 0.3, -0.2]) for i in range(1, 120)] + [(0, 1, [0.5, 0.5, 0.1]), (200, 2, [0.1, 0.9, 0.2])]
    bad = [(None, 1, [1.0, 1.0, 1.0]), (300, None, [1.0, 1.0, 1.0]), (400, 1, None), (500, 1, [nan, 1.0, 1.0]), (600, 1, [1.0, -inf, 1.0]), (700, 1, [1.0, None, 1.0])]
    assert mined(spark, good + bad) == brute(good) != []


def test_lengths_repeats_and_large_values(spark):
    rows = [(100, 1, [1e20, 1.0]), (101, 1, [1.0]), (102, 2, [1.0]), (103, 1, []), (104, 2, []), (105, 3, [0.5, 0.5, 9.0]), (102, 2, [1.0])]
    got = mined(spark, [r for r in rows if r[0] != 100] + [(200, 1, [2.0, 1.0])])
    assert got == brute([r for r in rows if r[0] != 100] + [(200, 1, [2.0, 1.0])])
    assert all(abs(r[4]) <= negatives.LONG for r in mined(spark, rows))


def test_large_components_are_exact(spark):
    a, b = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**20 + 1, 5.0], [0.0, 1.0]])
    assert negatives.scores(a, b).tolist() == [[(2**40 + 1) * (2**20 + 1) + 15, 3]]


def test_no_anchor_no_positive_no_row(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == [] and mined(spark, [(100, 1, [1.0]), (2, 3, [1.0])]) == []
    assert mined(spark, [(200, 1, [1.0]), (2, 1, [1.0])]) == []
