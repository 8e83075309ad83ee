import zlib
from hashlib import sha256

import numpy as np
import pytest

from samplemill.llm import merkle


def brute(rows):
    """{(place in the order of the result): columns} by walking whole lists."""
    h = lambda *x: sha256("".join(x).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def up(levels, at, own, proof):
        for nodes in levels[:-1]:
            run = range(at // 3 * 3, min(at // 3 * 3 + 3, len(nodes)))
            proof += [nodes[j] for j in run if j != at]
            own = h(*(own if j == at else nodes[j] for j in run))
            at //= 3
        return own

    leaf = lambda r, text: h(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))) for s in sources}
    trees = {s: tree([leaf(r, r["text"]) for r in groups[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        for j, r in enumerate(groups[s]):
            even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            shown = leaf(r, r["text"].replace("\n", "") if even and r["text"] is not None else r["text"])
            proof = []
            folded = up(top, i, up(trees[s], j, shown, proof), proof)
            out.append((r["doc_id"], trees[s][0][j], trees[s][-1][0], top[-1][0], h(*proof), folded, folded == top[-1][0], proof))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, block string, g string, path string"


def check(spark, rows, depth):
    docs = spark.createDataFrame([(*(r[c] for c in ("doc_id", "source", "lang", "n_chars", "text")), 1, "x", "y", None) for r in rows], SCHEMA)
    got = merkle.proofs(merkle.manifest(docs, merkle.without_newlines(docs), depth), whole=True).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("sizes,depth", [((1,), 1), ((1, 1, 1, 1), 1), ((9, 3, 10, 1, 28, 2), 1), ((81, 82, 1, 90, 243, 7, 1, 1, 1, 5), 2), ((400, 1, 27), 8)])
def test_any_shape_of_tree(spark, sizes, depth):
    rng = np.random.default_rng(sum(sizes))
    ids = rng.permutation(10 * sum(sizes)).tolist()
    rows = [{"doc_id": ids.pop(), "source": f"s{i}", "lang": "en", "n_chars": int(rng.integers(9)), "text": "a\n" * int(rng.integers(3))} for i, n in enumerate(sizes) for _ in range(n)]
    check(spark, rows, depth)


def test_nulls_repeats_and_long_texts(spark):
    row = {"doc_id": 5, "source": "b", "lang": "en", "n_chars": 3, "text": "x\ny"}
    rows = [row, row, row, row | {"text": "x\nz"}, row | {"doc_id": None}, row | {"doc_id": None}, row | {"source": None}, row | {"source": ""}, row | {"source": "é"}, row | {"source": "Z", "lang": None}]
    rows += [row | {"doc_id": i, "source": None, "n_chars": None, "text": [None, "", "\n", "w\n" * 300_000][i % 4]} for i in range(12)]
    check(spark, rows, 1)


def test_an_empty_table_has_no_leaves(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.proofs(merkle.manifest(docs)).count() == 0


def test_every_leaf_is_verified_as_it_stands(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = merkle.proofs(merkle.manifest(docs)).collect()
    assert len(rows) == 200 and all(r.verified for r in rows) and len({r.root for r in rows}) == 1
