import hashlib
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from samplemill.llm import suffix


def brute(rows, length):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] += 1
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[:-1] & ~gone[1:]).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 400)), int(rng.integers(1, 5))
    s = rng.integers(97, 97 + k, n).astype(np.uint8)
    b = s.tobytes()
    sa = suffix.suffix_array(s)
    assert sa.tolist() == sorted(range(n), key=lambda i: b[i:])
    phi, plcp = suffix.common_prefixes(s, sa, n)
    for a, c in zip(sa, sa[1:]):
        x = 0
        while a + x < n and c + x < n and b[a + x] == b[c + x]:
            x += 1
        assert phi[c] == a and plcp[c] == x


@pytest.mark.parametrize("seed", range(12))
def test_whole_numbers_are_sorted_by_recursion(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, int(rng.integers(1, 40)), int(rng.integers(0, 300))).tolist()
    assert suffix.sort_suffixes(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_a_periodic_string_calls_the_sort_on_its_names_and_on_theirs(monkeypatch):
    own, sizes = suffix.sort_suffixes, []
    monkeypatch.setattr(suffix, "sort_suffixes", lambda names: (sizes.append(len(names)), own(names))[1])
    s = np.frombuffer(b"abaababaabaab" * 500, np.uint8)
    assert suffix.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tobytes())
    # each level is at most half of the one above, so that the work is linear
    assert len(sizes) >= 2 and all(2 * b <= a for a, b in zip([len(s), *sizes], sizes))


def test_equal_hashes_are_confirmed(monkeypatch):
    s = np.concatenate([np.random.default_rng(0).integers(97, 123, 300), [0xFF]] * 2).astype(np.uint8)
    s[340] = 65
    monkeypatch.setattr(suffix.tv, "span_hash", lambda sums, a, b: np.zeros(len(a), np.uint64))
    want = [i for i in range(len(s) - 49) if 0xFF not in s[i : i + 50] and s.tobytes().count(s[i : i + 50].tobytes()) > 1]
    assert set(np.flatnonzero(suffix.repeated_starts(s, 50)).tolist()) <= set(want)


def test_repeats_between_gaps():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 101, 3000).astype(np.uint8)
    s = np.concatenate([base[:1000], [0xFF], base[500:1600], [0xFF], base[:90], base[2000:], [0xFF]]).astype(np.uint8)
    b = s.tobytes()
    count = Counter(b[i : i + 50] for i in range(len(b) - 49))
    want = [i for i in range(len(b) - 49) if count[b[i : i + 50]] > 1 and b"\xff" not in b[i : i + 50]]
    assert np.flatnonzero(suffix.repeated_starts(s, 50)).tolist() == want


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(suffix.deduplicate(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], 400)


@pytest.mark.parametrize("block", [4096, 3])
def test_many_edited_copies(spark, monkeypatch, block):
    monkeypatch.setattr(suffix, "BLOCK", block)
    rng = np.random.default_rng(block)
    base = "".join(chr(97 + x) for x in rng.integers(0, 4, 900))
    rows = [(i, base[: rng.integers(0, 900)] + chr(65 + i % 20) * int(rng.integers(0, 3)) + base[rng.integers(0, 900) :]) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "é" * 300), (103, "a" * 130), (None, base), (None, base), (7, base[5:])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, k1 int").repartition(3)
    assert got(suffix.deduplicate(docs, length=60, anchor=24)) == brute(rows, 60)
    assert suffix.deduplicate(docs.limit(0)).count() == 0


def brute_words(rows, n):
    split = {i: [m for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for i, (_, t) in enumerate(rows)}
    count = Counter(tuple(m[0] for m in w[k : k + n]) for w in split.values() for k in range(len(w) - n + 1))
    out = []
    for i, (d, t) in enumerate(rows):
        b, w = (t or "").encode(), split[i]
        gone = [any(count[tuple(m[0] for m in w[x : x + n])] > 1 for x in range(max(0, k - n + 1), min(k, len(w) - n) + 1)) for k in range(len(w))]
        edges = [m.start() for m in w] + [len(b)]
        out.append((d, len(w), sum(gone), b[: edges[0]] + b"".join(b[edges[k] : edges[k + 1]] for k in range(len(w)) if not gone[k])))
    return sorted(out, key=str)


def got_words(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in df.collect()), key=str)


def test_runs_of_words_in_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got_words(suffix.deduplicate_words(docs)) == brute_words([(r.doc_id, r.text) for r in docs.collect()], 51)


@pytest.mark.parametrize("block", [4096, 3])
def test_runs_of_words_in_edited_copies(spark, monkeypatch, block):
    monkeypatch.setattr(suffix, "BLOCK", block)
    rng = np.random.default_rng(block)
    base = [f"{'äb'[x % 2]}{x}" for x in rng.integers(0, 6, 150)]
    joints = [" ", "\n", "  ", "\t "]
    rows = [(i, "".join(w + joints[rng.integers(0, 4)] for w in [*base[: rng.integers(0, 150)], f"X{i % 9}", *base[rng.integers(0, 150) :]])) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, "a " * 30), (None, " ".join(base)), (None, " ".join(base)), (7, " " + " ".join(base[5:]))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, k1 int").repartition(3)
    assert got_words(suffix.deduplicate_words(docs, words=12, anchor=5)) == brute_words(rows, 12)
    assert suffix.deduplicate_words(docs.limit(0)).count() == 0


def test_letters_of_scripts_without_spaces_are_words():
    data = np.frombuffer("ab 日本c\nไท é".encode(), np.uint8)
    starts, ends, _ = suffix.word_places(data, np.array([0, len(data)]))
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["ab", "日", "本", "c", "ไ", "ท", "é"]


def brute_both(rows, rules):
    """What deduplicate_both gives: strings of bytes, and runs of words with the white space between them."""
    raw = [(t or "").encode() for _, t in rows]
    split = []
    for b in raw:
        data = np.frombuffer(b, np.uint8)
        starts, ends, _ = suffix.word_places(data, np.array([0, len(b)]))
        split.append(list(zip(starts.tolist(), ends.tolist())))
    n = rules.words
    runs = [[b[w[k][0] : w[k + n - 1][1]] for k in range(len(w) - n + 1)] for b, w in zip(raw, split)]
    count = Counter(x for r in runs for x in r)
    texts = []
    for (d, _), b, w, r in zip(rows, raw, split, runs):
        gone = [any(count[r[x]] > 1 for x in range(max(0, k - n + 1), min(k, len(r) - 1) + 1)) for k in range(len(w))]
        edges = [a for a, _ in w] + [len(b)]
        texts.append((d, {p for k, g in enumerate(gone) if g for p in range(edges[k], edges[k + 1])}, len(w), sum(gone)))
    strings = Counter(b[i : i + rules.length] for b in raw for i in range(len(b) - rules.length + 1))
    out = []
    for (d, words, n_words, n_gone), b in zip(texts, raw):
        under = set()
        for i in range(len(b) - rules.length + 1):
            if strings[b[i : i + rules.length]] > 1:
                under.update(range(i, i + rules.length))
        out.append((d, n_words, n_gone, bytes(x for i, x in enumerate(b) if i not in under and i not in words).decode("utf-8", "replace")))
    return sorted(out, key=str)


def got_both(df):
    rows = df.collect()
    first = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str)
    return first, sorted(((r.doc_id, r.n_words, r.n_words_removed, r.text) for r in rows), key=str)


def test_both_rules_on_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got_both(suffix.deduplicate_both(docs)) == (brute(rows, 400), brute_both(rows, suffix.Rules()))


@pytest.mark.parametrize("seed", [1, 2])
def test_both_rules_on_edited_copies(spark, seed):
    rng = np.random.default_rng(seed)
    base = [f"{'äb日'[x % 3]}{x * 'c'}" for x in rng.integers(0, 6, 200)]
    solid = "".join(chr(97 + x) for x in rng.integers(0, 4, 400))
    joints = [" ", " ", " ", "\n", " " * 30]
    text = "".join(w + joints[rng.integers(0, 5)] for w in base)
    rows = [(i, text[: rng.integers(0, 900)] + f"X{i % 9}" + text[rng.integers(0, 900) :]) for i in range(30)]
    rows += [(40 + i, solid[: rng.integers(0, 400)] + chr(65 + i) + " " * int(rng.integers(0, 40)) + solid[rng.integers(0, 400) :]) for i in range(12)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, "a " * 60), (None, text), (None, text), (7, " " + text[5:]), (8, "é" * 90), (9, " " * 200)]
    rules = suffix.Rules(length=60, anchor=24, words=12, anchor_words=5)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, k1 int").repartition(3)
    assert got_both(suffix.deduplicate_both(docs, rules)) == (brute(rows, 60), brute_both(rows, rules))
    assert suffix.deduplicate_both(docs.limit(0)).count() == 0


def brute_words_and_strings(rows, n, length):
    """What deduplicate_words gives with a length: runs of words without their white space, and strings of bytes."""
    runs, out = brute_words(rows, n), []
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    split = [list(re.finditer(rb"[^\x20\x09-\x0D]+", b)) for b in raw]
    words = Counter(tuple(m[0] for m in w[k : k + n]) for w in split for k in range(len(w) - n + 1))
    for (d, _), b, w in zip(rows, raw, split, strict=True):
        stays = np.ones(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                stays[i : i + length] = False
        edges = [m.start() for m in w] + [len(b)]
        for k in range(len(w) - n + 1):
            if words[tuple(m[0] for m in w[k : k + n])] > 1:
                stays[edges[k] : edges[k + n]] = False
        out.append((d, next(x[1:3] for x in runs if x[0] == d), np.frombuffer(b, np.uint8)[stays].tobytes()))
    return sorted(((d, *counts, kept) for d, counts, kept in out), key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_runs_of_words_and_strings_together(spark, seed):
    rng = np.random.default_rng(seed)
    base = [f"{'äb'[x % 2]}{x * 'c'}" for x in rng.integers(0, 6, 200)]
    solid = "".join(chr(97 + x) for x in rng.integers(0, 4, 400))
    joints = [" ", " ", "\n", "  "]
    rows = [(i, "".join(w + joints[rng.integers(0, 4)] for w in [*base[: rng.integers(0, 150)], f"X{i % 9}", *base[rng.integers(0, 150) :]])) for i in range(20)]
    rows += [(40 + i, solid[: rng.integers(0, 400)] + chr(65 + i) + solid[rng.integers(0, 400) :]) for i in range(12)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, "a " * 60), (7, " " + " ".join(base[5:])), (104, "nothing of this stands elsewhere")]
    rows = [(i, t) for i, t in dict(rows).items()]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, k1 int").repartition(3)
    assert got_words(suffix.deduplicate_words(docs, words=12, anchor=5, length=60)) == brute_words_and_strings(rows, 12, 60)
    assert suffix.deduplicate_words(docs.limit(0), length=60).count() == 0


def test_texts_without_repeats_are_not_moved(spark):
    # all texts were moved to be cut, and those with repeats of bytes again by each reading of the words
    docs = spark.createDataFrame([(i, f"{i} stands alone " * 3) for i in range(40)] + [(50 + i, "the same " * 60) for i in range(2)], "doc_id long, text string")
    plan = suffix.deduplicate_words(docs, length=60)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and plan.split("Union")[1].count("Join") == 1


def test_memory_of_a_full_shard():
    # 224 MB of arrays and lists at a shard of 2 MB, 56 at half of one; each task of an executor has one
    rng = np.random.default_rng(0)
    text = " ".join(f"{'word' * (x % 3)}{x}" for x in rng.zipf(1.3, suffix.SHARD_BYTES // 4) % 5000).encode()[: suffix.SHARD_BYTES]
    s = np.frombuffer(text, np.uint8).copy()
    s[600::600] = suffix.GAP
    tracemalloc.start()
    suffix.repeated_starts(s, suffix.LENGTH)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(s) > suffix.SHARD_BYTES * 0.9 and peak < 120e6
