import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from samplemill.llm import bpe
from samplemill.llm import textvec as tv

PATH = public_tokenizers.path("word_bpe_49k.json")
OWN = Tokenizer.from_file(PATH)


def mine(texts):
    v = bpe.vocabulary(PATH)
    ids, at = v.encode(*tv.byte_arrays(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])], v.decode(ids, at).to_pylist()


def check(texts):
    ids, shown = mine(texts)
    for t, i, s in zip(texts, ids, shown):
        expected = OWN.encode(t or "", add_special_tokens=False).ids
        assert i == expected, t
        assert s == OWN.decode(expected, skip_special_tokens=False)


def test_shapes():
    check(["", None, " \n\t", "It's we'll they've 'tis %'s ''s 'sam x'd' 'RE", "Größe ÀÉÎ ß ÿ × ÷ 3½ İstanbul ΣΑΣ", "a<|startoftext|>b <|endoftext|>", "x|y <| z", "é 漢字 ​\x00\x1c\x85", "'", "'s", "a'", "12'34 'l 'v"])


def test_long_unsplit_texts():
    rng = random.Random(5)
    texts = ["a" * 5000, "ab" * 3000, "%" * 1000 + "x" * 700, "é" * 999]
    texts += ["".join(rng.choice("theandinero") for _ in range(n)) for n in (65, 128, 129, 1000, 20000)]
    texts += ["".join(rng.choice(["the", "ing", "tion", "eau", "!?", "é"]) for _ in range(n)) for n in (30, 200, 3000)]
    check(texts)


def test_leaf_of_two_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF", 2)
    monkeypatch.setattr(bpe, "WINDOW", 1)
    rng = random.Random(6)
    v = bpe.Vocabulary(PATH)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    assert v.encode_words(words) == [OWN.encode(w, add_special_tokens=False).ids for w in words]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6), st.lists(st.text(alphabet="aA's tTrReEé É1%\nß", max_size=30), max_size=6))
def test_any_text(one, two):
    check(one + two)


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.round_trip(docs).collect():
        ids = OWN.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(OWN.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    some = docs.limit(5)
    encoded = bpe.encode(some)
    assert {r.doc_id: r.text for r in bpe.decode(encoded).collect()} == {r.doc_id: OWN.decode(r.ids, skip_special_tokens=False) for r in encoded.collect()}
    clash = spark.createDataFrame([(1, None, 5, "x"), (1, None, 5, "x")], "doc_id long, text string, ids int, n_tokens string")
    assert [r.n_tokens for r in bpe.round_trip(clash).collect()] == [0, 0]
    assert bpe.round_trip(clash.limit(0)).count() == 0
