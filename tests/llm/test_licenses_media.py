import hashlib
import re
import struct
import zlib

import numpy as np
import pytest

from samplemill.llm import licenses, media

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places_match_brute_force(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += [None, "", "under the MIT license under the mit license", "xunder the mit license", "under the mit licenses", "cc-by-nc-sa cc by nc", "apache LICENSE, version 2", "apache license version 20", "é cc by ñ nc cc by nc", "cc by", "nc cc"] + ["z " * 50000 + "CC BY-NC"]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, labels string, n_words int")
    rows = licenses.digest(licenses.scan(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,labels,ok",
    [
        (b"MIT", ["mit"], True),
        (b"(MIT OR GPL-3.0-only) AND Apache-2.0 */", ["apache-2", "gpl-3", "mit"], True),
        (b"MIT OR GPL-3.0 AND GPL-2.0", ["gpl-2", "gpl-3", "mit"], True),
        (b"(MIT OR GPL-3.0) AND GPL-2.0", ["gpl-2", "gpl-3", "mit"], False),
        (b"GPL-2.0-or-later WITH Classpath-exception-2.0 and", ["gpl-2"], False),
        (b"MIT OR", ["mit"], True),
        (b"(MIT", [], False),
        (b")", [], False),
        (b"CC-BY-NC-4.0", ["cc-by-nc"], False),
    ],
)
def test_expressions(text, labels, ok):
    assert licenses.evaluate(licenses.parse(text)[0]) == (labels, ok)


def test_tags(spark):
    docs = spark.createDataFrame([(1, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC\nmore"), (2, "SPDX license identifier")], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert rows[1].expressions[0].labels == ["apache-2", "isc", "mit"] and rows[1].expressions[0].text == "(MIT OR Apache-2.0) AND ISC"
    assert rows[2].expressions == []


def test_media_round_trip(spark):
    texts = [None, "", "a", "é" * 288, "x" * 577, "y" * (576 * 16), "z" * (576 * 40 + 1), "a"]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.digest(docs).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[2][1:] == got[7][1:] and got[0][1:] == got[1][1:]
    stored = {r.doc_id: r.media for r in media.store(docs).collect()}
    assert all(hashlib.sha256(stored[i]).hexdigest() == got[i].media_sha256 and len(stored[i]) == got[i].media_bytes for i in stored)
    seen = {r.doc_id: r for r in media.inspect(media.store(docs)).collect()}
    assert seen[6].codec == "raw " and seen[6].n_samples == 41 and [r.end - r.start for r in seen[6].keyframes] == [576] * 3 and seen[6].duration == 41 * 576


def test_listed_sizes_wide_boxes_and_errors(spark):
    sizes = np.array([5, 0, 9, 4], dtype=">u4")
    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1) + media.box(b"avc1", bytes(70))), media.full(b"stts", struct.pack(">III", 1, 4, 100)), media.full(b"stsc", struct.pack(">IIII", 1, 1, 2, 1)), media.full(b"stsz", struct.pack(">II", 0, 4) + sizes.tobytes()), media.full(b"co64", struct.pack(">IQQ", 2, 40, 50)))
    mdhd = media.full(b"mdhd", struct.pack(">QQIQI", 0, 0, 90000, 400, 0), version=1)
    moov = media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl))))
    blob = struct.pack(">I4sQ", 1, b"mdat", 16 + 60) + bytes(60) + moov
    (t,) = media.read(blob)
    assert (t.codec, t.timescale, t.duration) == ("avc1", 90000, 400)
    assert t.offsets.tolist() == [40, 45, 50, 59] and t.sizes.tolist() == [5, 0, 9, 4] and t.keys.tolist() == [0, 1, 2, 3]
    rows = media.inspect(spark.createDataFrame([(1, bytearray(blob)), (2, None), (3, bytearray(blob[:-9])), (4, bytearray(b"junk"))], "doc_id long, media binary")).collect()
    assert [r.error is None for r in sorted(rows, key=lambda r: r.doc_id)] == [True, False, False, False]


def test_long_expressions_take_linear_time():
    raw = b" OR ".join([b"MIT"] * 30_000)
    postfix, read = licenses.parse(raw)
    assert read == len(raw) and len(postfix) == 59_999 and licenses.evaluate(postfix) == (["mit"], True)
    deep = b"(" * 20_000 + b"MIT" + b")" * 20_000 + b" AND GPL-2.0"
    assert licenses.evaluate(licenses.parse(deep)[0]) == (["gpl-2", "mit"], False) and licenses.parse(b"(" * 20_000) == ([], 0)


def hostile(duration=400, wide=True, offsets=(40, 50), sizes=(5, 5), runs=(1, 1, 1), deltas=(2, 100)):
    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1) + media.box(b"avc1", bytes(70))), media.full(b"stts", struct.pack(">III", 1, *deltas)), media.full(b"stsc", struct.pack(">IIII", 1, *runs)), media.full(b"stsz", struct.pack(">II2I", 0, 2, *sizes)), media.full(b"co64", struct.pack(">I2Q", 2, *offsets)))
    mdhd = media.full(b"mdhd", struct.pack(">QQIQI", 0, 0, 90000, duration, 0), version=1) if wide else media.full(b"mdhd", struct.pack(">IIIII", 0, 0, 90000, duration, 0))
    return struct.pack(">I4sQ", 1, b"mdat", 16 + 60) + bytes(60) + media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl))))


def test_numbers_that_no_column_holds_are_errors_of_their_row(spark):
    top = (1 << 64) - 1
    blobs = [hostile(), hostile(top), hostile((1 << 32) - 1, wide=False), hostile(1 << 63), hostile(offsets=(1 << 63, 50)), hostile(offsets=((1 << 63) - 1, 50)), hostile(offsets=(40, top)), hostile(sizes=(0xFFFFFFFF, 5)), hostile(runs=(1, 0xFFFFFFFF, 1)), hostile(deltas=(0xFFFFFFFF, 0xFFFFFFFF))]
    rows = {r.doc_id: r for r in media.inspect(spark.createDataFrame([(i, bytearray(b), "x") for i, b in enumerate(blobs)], "doc_id long, media binary, codec string")).collect()}
    assert [rows[i].error is None for i in range(len(blobs))] == [True] * 3 + [False] * 7
    assert rows[0].duration == 400 and rows[1].duration is rows[2].duration is None and rows[1].n_samples == 2
    assert media.inspect(spark.createDataFrame([], "doc_id long, media binary")).count() == 0
