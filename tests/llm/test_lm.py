import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from samplemill.llm import lm


def brute(rows):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0end"] for _, t in rows]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows]
    c = Counter(x for t, k in zip(tokens, train) if k for x in t)
    n, v = sum(c.values()), len(c)
    return {i: (not k, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for (i, _), t, k in zip(rows, tokens, train)}


def check(df, rows):
    want = brute(rows)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        h, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    return got


@pytest.mark.parametrize("head", [1 << 17, 50])
def test_documents(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check(lm.score(docs), [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 1.06 * sum(r.base_score for r in held)


def test_edge_cases(spark):
    rows = [(0, None), (1, ""), (2, "  \n\t a"), (3, "The the THE tHe\n\n"), (4, "é" * 5000), (5, "a. B?\nc"), (6, "end")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, chunk string, word int")
    check(lm.score(docs), rows)
    assert lm.score(docs.limit(0)).count() == 0


def test_repeated_rows_and_null_ids_have_equal_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 1)
    rows = [(7, "one two three two")] * 3 + [(7, "four five")] + [(None, "one six six")] * 2 + [(9, "one one")]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 7
    for size, n in ((5, 3), (4, 2)):
        same = [r for r in got if r.n_tokens == size]
        assert len(same) == n and len({(r.n_known, round(r.score, 9), round(r.base_score, 9)) for r in same}) == 1


def test_blocks_and_spanning_prefixes_count_the_whole_vocabulary(spark):
    words = [f"ab{'x' * (i % 9)}{i}" for i in range(200)] * 2 + ["abx", "q"]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string").repartition(5)
    rows = lm.documents(docs).withColumn("train", lm.learned_from(lm.F.col("doc_id")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    blocks = lm.cut(lm._blocks(lm._vocabulary(rows, lm._cuts(rows, len(words))), 7))
    want = Counter(w for i, w in enumerate(words) if zlib.crc32(str(i).encode()) % 5 != 1)
    spanning, seen, n_blocks = lm._spanning(blocks), {}, 0
    for batch in blocks.toArrow().to_batches():
        for cls, data, offs, n in lm._unpacked(batch):
            n_blocks += 1
            e = lm.edges(data, offs, cls)
            counts = lm.so_far_counts(e, np.bincount(e.back, weights=n[e.owner], minlength=len(e.byte)), spanning)
            for i in range(len(cls)):
                text = bytes(data[offs[i] : offs[i + 1]])
                assert text.decode() not in seen and n[i] == want[text.decode()]
                seen[text.decode()] = int(cls[i])
                for j, edge in enumerate(e.back[e.owner == i]):
                    seen[text.decode(), j] = [(float(z[edge]), float(o[edge])) for z, o in counts]
    assert n_blocks > 10 and len([k for k in seen if isinstance(k, str)]) == len(set(words))
    plain = [(w.encode() + b"\xff", seen[w], want[w]) for w in set(words)]
    for w, cls, _ in plain:
        for j in range(len(w)):
            for b in range(8):
                found = [0, 0]
                for other, c, k in plain:
                    if c == cls and len(other) > j and other[:j] == w[:j] and other[j] >> (8 - b) == w[j] >> (8 - b):
                        found[other[j] >> (7 - b) & 1] += k
                assert seen[w[:-1].decode(), j][b] == tuple(found)


def test_probabilities_of_all_next_bytes_sum_to_one():
    rng = np.random.default_rng(1)
    m = lm.spelling_mixer()
    for t in m.tables:
        t[:] = rng.integers(0, 5, t.shape)
    m.refine[:] = rng.integers(0, 9, m.refine.shape)
    data = np.arange(256, dtype=np.uint8)
    e = lm.edges(data[:255], np.arange(256), np.full(255, 7))
    known = lm.so_far_counts(e, np.bincount(e.back, weights=rng.integers(0, 9, 255)[e.owner], minlength=len(e.byte)), (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)))
    first = np.zeros(len(e.byte))
    for j in range(8):
        node, bit = lm._bit(e.byte, j)
        first += m.frozen().log10(e.base, node, bit, np.minimum(e.place, 3), known[j])
    at_start = e.place == 0
    assert at_start.sum() == 255
    total = (10 ** first[at_start]).sum()
    assert 0.5 < total < 1 + 1e-9  # the byte FF, an end, is the one missing


def test_classes_and_shapes_sum_to_one():
    rng = np.random.default_rng(2)
    m = lm.flow_mixer()
    for t in m.tables:
        t[:] = rng.integers(0, 5, t.shape)
    m.refine[:] = rng.integers(0, 9, m.refine.shape)
    frozen = m.frozen()
    u = lm.units(np.frombuffer(b"of x", np.uint8), np.array([0, 4]))
    total = 0.0
    for cls in range(256):
        for shape in range(16):
            one = lm.Units(u.low, u.starts, u.ends, u.first, u.owner, u.word, np.array([u.cls[0], cls]), np.array([u.shape[0], shape]), np.zeros(2))
            total += 10 ** lm.flow_log10(frozen, one)[1]
    assert abs(total - 1) < 1e-6
