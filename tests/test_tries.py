"""Sub-tokenizers against greedy matching by hand, and injected values at their places."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samplemill.operators import tokens as tk
from samplemill.operators import tries as tr

WORDS = [("A", "a", 1), ("A", "ab", 2), ("A", "abcd", 3), ("A", "é", 4), ("A", "éa", 5), ("B", "a", 11), ("B", "bcd", 12), ("B", "😀", 13), ("A", "a", 9), ("A", "", 7)]


def greedy(kind, text, words=WORDS):
    out, at = [], 0
    while at < len(text):
        hits = [(len(t), -i) for k, t, i in words if k == kind and t and text.startswith(t, at)]
        n, i = max(hits, default=(1, 0))
        out.append(-i)
        at += n
    return out


def test_greedy_longest_matches():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcdé😀x"), int(rng.integers(0, 30)))) for _ in range(400)] + ["", "abcdabcabé", "x" * 3000]
    kinds = rng.choice(["A", "B"], len(texts)).tolist()
    ids, at = tr.Trie.of(WORDS).encode(kinds, pa.array(texts), 0)
    for k, t, a, b in zip(kinds, texts, at[:-1], at[1:]):
        assert ids[a:b].tolist() == greedy(k, t)
    with pytest.raises(ValueError, match="no vocabulary for kinds"):
        tr.Trie.of(WORDS).encode(["C"], pa.array(["a"]), 0)
    assert tr.Trie.of([("A", "", 1)]).encode(["A"], pa.array(["ab"]), 0)[0].tolist() == [0, 0]


def samples(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("segments", tk.parse(F.col("text")))


def test_cuts_windows_and_unknown_tokens(spark):
    words = spark.createDataFrame(WORDS, "kind string, token string, id int")
    texts = ["<@TOKENIZER-TYPE=A>abx", "<@TOKENIZER-TYPE=A@MAX-LEN=2>aéab<@TOKENIZER-TYPE=B@MAX-LEN=3@TRUNC-MODE=RAND>" + "abcd" * 10, None, "<@TOKENIZER-TYPE=A><@TOKENIZER-TYPE=B>a"]
    rows = samples(spark, texts)
    got = {r.id: r for r in tr.tokenise(rows, "id", "segments", words, 4, 99, 0).collect()}
    assert got[0].ids == [2, 0, 99, 99] and got[0].n_unknown == 1 and got[0].attention_mask == [True, True, False, False] and got[0].overflow == ""
    assert got[1].ids[:2] == [1, 5] and got[1].overflow == "A:3=>2|B:20=>3|OVERALL:5=>4|" and got[1].segment_sizes == [2, 3]
    assert got[2].ids == [99] * 4 and got[3].ids == [11, 99, 99, 99] and got[3].segment_sizes == [0, 1]
    whole = {r.id: r.ids for r in tr.tokenise(rows, "id", "segments", words, None, 99, 0).collect()}
    assert whole[1] in ([1, 5, 11, 12, 11], [1, 5, 12, 11, 12])
    with pytest.raises(Exception, match="1 unknown tokens in sample 0"):
        tr.tokenise(rows, "id", "segments", words, 4, 99, 0, on_unknown="raise").select("n_unknown").collect()
    with pytest.raises(ValueError, match="more than 3 tokens"):
        tr.trie(words, 3)


def test_values_lie_where_their_placeholders_do(spark):
    words = spark.createDataFrame([(k, t, i) for k in "AB" for t, i in ((tr.SCALAR_TOKEN, 1), (tr.EMBEDDING_TOKEN, 2))] + [("A", "a", 3), ("B", "b", 4)], "kind string, token string, id int")
    text = "<@TOKENIZER-TYPE=B>bb<@TOKENIZER-TYPE=EXTERNAL_EMBEDDINGS_FROM_DICT>m:{}:2<@TOKENIZER-TYPE=A>a<@TOKENIZER-TYPE=EXTERNAL_EMBEDDINGS_FROM_DICT>m:k<@TOKENIZER-TYPE=SCALARS_LITERALS>2.5, -1"
    rows = samples(spark, [text.format("k"), text.format("none")])
    vectors = spark.createDataFrame([("m", "k", 0, [1.0]), ("m", "k", 1, [2.0]), ("m", "k", 2, [3.0]), ("x", "k", 0, [9.0])], "model string, name string, at long, vector array<double>")
    held = tr.tokenise(rows.withColumn("held", tr.placeholders(F.col("segments"), "A")), "id", "held", words, 9, 0, 99)
    got = {r.id: r for r in tr.inject(held, "id", "segments", vectors).collect()}
    assert got[0].ids == got[1].ids == [4, 4, 2, 2, 3, 2, 1, 1, 0]
    assert got[0].embeddings == [None, None, [1.0], [2.0], None, [1.0], None, None, None] and got[1].embeddings == [None] * 5 + [[1.0]] + [None] * 3
    assert got[0].scalars == [-1000.0] * 6 + [2.5, -1.0, -1000.0] and [i for i, x in enumerate(got[0].scalars_valid) if x] == [6, 7]
    assert [(e.model, e.name, e.location, e.length) for e in got[1].external] == [("m", "none", 2, 2), ("m", "k", 5, 1)]
    short = tr.tokenise(rows.withColumn("held", tr.placeholders(F.col("segments"), "A")), "id", "held", words, 3, 0, 99)
    assert [r.embeddings for r in tr.inject(short, "id", "segments", vectors).orderBy("id").collect()] == [[None, None, [1.0]], [None] * 3]
    for bad in ("<@TOKENIZER-TYPE=SCALARS_LITERALS>1,x", "<@TOKENIZER-TYPE=SCALARS_FROM_DICT>nothing", "<@TOKENIZER-TYPE=EXTERNAL_EMBEDDINGS_FROM_DICT>m"):
        with pytest.raises(Exception, match="not numbers|no column|not model"):
            samples(spark, [bad]).select(tr.placeholders(F.col("segments"), "A")).collect()
