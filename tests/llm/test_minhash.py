import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from samplemill.llm import minhash
from samplemill.llm import textvec as tv

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, percent=85):
    sets = {}
    for i, t in rows:
        sets[i] = shingle_set(t)
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        both = defaultdict(int)
        for x in s:
            for j in where[x]:
                both[j] += 1
        for j, n in both.items():
            if j < i and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got(minhash.near_duplicates(docs)) == expected


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, "a b c"), (4, "A  b\tC"), (5, "a b"), (6, long), (7, long + " x"), (8, long.replace("w7 ", "Z ")), (9, " \n"), (10, "a b c")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, component_id string, kept string")
    assert got(minhash.near_duplicates(docs)) == brute(rows)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_large_group_over_block_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 20)
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 7)):
            words[k] = f"n{rng.integers(0, 1000)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(minhash.near_duplicates(docs)) == brute(rows)


def test_estimate_is_close_to_the_true_similarity():
    a = pa.array([" ".join(f"w{i}" for i in range(1000)), " ".join(f"w{i}" for i in range(100, 1100))])
    data, offs = tv.byte_arrays(a)
    _, _, first, hashes = tv.word_hashes(data, offs, tv.NOT_SPACE)
    packed = minhash.pack(minhash.minima(*tv.shingle_sets(hashes, first)))
    assert abs(minhash.estimate(packed[0], packed[1:])[0] - 896 / 1096) < 0.15


def _edited(*places):
    words = [f"w{i}" for i in range(600)]
    for p in places:
        words[p] = f"n{p}"
    return " ".join(words)


def _classes(n, links):
    union = minhash._Union(n)
    for a, b in links:
        union.join(a, b)
    return [min(j for j in range(n) if union.find(j) == union.find(i)) for i in range(n)]


def test_a_bridge_between_two_skipped_texts_is_found():
    """Text 1 is put off in one component and text 2 in another that outgrew it; only they link the two."""
    at = range(5, 600, 10)
    a, b, c = at[:5], at[5:13], at[13:15]
    texts = [_edited(), _edited(*a), _edited(*a, *b), _edited(*b, *c), _edited(*a, *b, 205)]
    every = np.ones(5, dtype=bool)
    assert _classes(5, minhash.block_links(np.arange(5), pa.array(texts), every, every, 85, 0.24)) == [0] * 5


def test_block_links_match_brute_force_on_overlapping_clusters():
    at, wrong = range(5, 600, 10), []
    for seed in range(120):
        rng = np.random.default_rng(seed)
        n, k = int(rng.integers(5, 25)), int(rng.integers(2, 5))
        edits = [set(rng.choice(60, int(rng.integers(0, 9)), replace=False)) for _ in range(k)]
        texts = [_edited(*(at[q] for q in set().union(*[x for x in edits if rng.random() < 0.5]) ^ set(rng.choice(60, int(rng.integers(0, 3)), replace=False)))) for _ in range(n)]
        every = np.ones(n, dtype=bool)
        if _classes(n, minhash.block_links(np.arange(n), pa.array(texts), every, every, 85, 0.24)) != [c for _, c in brute(list(enumerate(texts))).values()]:
            wrong.append(seed)
    assert wrong == []
