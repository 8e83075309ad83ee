import numpy as np
import pyarrow as pa
import pytest

from samplemill.llm import textvec as tv
from samplemill.llm import toxicity


def brute(x, base=0):
    """The definition: take the best contiguous run, then look left and right of it."""
    best = (0.0, 0, 0)
    for i in range(len(x)):
        total = 0.0
        for j in range(i, len(x)):
            total += x[j]
            if total > best[0] + 1e-9:
                best = (total, i, j)
    if best[0] <= 0:
        return []
    s, i, j = best
    return brute(x[:i], base) + [(base + i, base + j, s)] + brute(x[j + 1 :], base + j + 1)


@pytest.mark.parametrize("seed", range(20))
def test_segments_match_the_definition(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(-0.3, 2, rng.integers(1, 60))
    sums = np.append(0, np.cumsum(x))
    p = np.flatnonzero(x > 0)
    got = toxicity.segments(p.tolist(), sums[p + 1].tolist(), sums[p].tolist())
    want = brute(x.tolist())
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.96
    toxic = [r for r in rows if r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.85


def test_passages_lie_where_the_words_are():
    words = ["stupid" if i in (40, 42, 43) else f"w{i % 7}" for i in range(100)]
    data, offs = tv.byte_arrays(pa.array([" ".join(words)]))
    _, _, _, slots = toxicity._tokens(data, offs)
    m = toxicity.Model([np.zeros(1 << b, np.float32) for _, b in toxicity.LEVELS], [np.full(1 << b, 500, np.float32) for _, b in toxicity.LEVELS], 0.1)
    for k, s in enumerate(slots):
        m.toxic[k][:] = 50
        m.toxic[k][s[40]] = 500
    (_, _, _, found), = toxicity.passages(m, data, offs)
    text = " ".join(words)
    assert text[found[0][0] : found[0][1]] == " ".join(words[40:44])


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "you idiot", "c"), (5, "x" * 100000, "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, labels.limit(0)).collect())
