import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from samplemill.llm import packing

OWN = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, texts, padding):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(texts)
    for d, pieces in docs.items():
        ids = np.array([*OWN.encode(texts[d] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
        assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    used = held = 0
    steps = defaultdict(dict)
    for s, pieces in sequences.items():
        pieces.sort(key=lambda r: r.offset)
        n = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]
        assert n <= pieces[0].window <= 4096 and len({(r.window, r.step_id) for r in pieces}) == 1
        steps[pieces[0].step_id][s] = pieces[0].window
        used += n
        held += n if n & (n - 1) == 0 else 4096
    for x in steps.values():
        assert len(set(x.values())) == 1 and sum(x.values()) <= packing.STEP_TOKENS
    assert held - used <= padding


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(packing.pack(docs).collect(), {r.doc_id: r.text for r in docs.collect()}, 0)


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: "a " * 20000, 4: "b " * 4095, 5: "c " * 4096, 6: "d"}
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in texts.items()], "doc_id long, text string, start int, window string").coalesce(1)
    check(packing.pack(docs).collect(), texts, 0)
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_packer_fills_every_window(seed, monkeypatch):
    monkeypatch.setattr(packing, "ROUND_TOKENS", 30_000)
    rng = np.random.default_rng(seed)
    packer, total = packing.Packer(3), 0
    for d in range(600):
        n = int(rng.integers(1, [40, 600, 3000, 9000, 5000, 700][seed]))
        total += n
        packer.add(d, rng.integers(0, 9, n).astype("<u4"))
    packer.pack(last=True)
    t = packer.take().to_pandas()
    assert t.length.sum() == total
    seq = t.groupby("sequence_id").agg(n=("length", "sum"), w=("window", "first"))
    assert (seq.n == seq.w).all()
