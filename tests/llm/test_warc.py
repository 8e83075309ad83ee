import base64
import hashlib
import re

import numpy as np
import pytest

from samplemill.llm import warc

PAGES = "page_id long, url string, html string, digest string, size int, some boolean, top long"


@pytest.fixture
def tiny_splits(spark):
    """Splits of a few hundred bytes, so that headers and contents cross them."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "211")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def brute(data):
    """(offset, content, truncated) by walking one file from its start."""
    at, out = 0, []
    while data.startswith(b"WARC/", at) and (end := data.find(b"\n\r\n", at)) >= 0:
        found = re.search(rb"\ncontent-length:\s*(\d+)\s*\r?\n", data[at : end + 1], re.I)
        if not found:
            break
        x = end + 3
        y = x + int(found[1])
        out.append((at, data[x:y], len(data) < y))
        at = y + 4
    return out


def a_record(content, more=""):
    return b"WARC/1.0\r\nWARC-Type: resource\r\n" + more.encode() + b"Content-Length: %d\r\n\r\n" % len(content) + content + b"\r\n\r\n"


def files(rng):
    """Archives whose contents hold magic, whole records, empty lines and lengths that lead astray."""
    inner = a_record(b"inner\r\n\r\n")
    made = []
    for _ in range(5):
        out = b""
        for _ in range(int(rng.integers(1, 12))):
            parts = [inner, b"\n" + inner, b"\nWARC/1.0\r\nContent-Length: 3\r\n\r\n", b"\r\n\r\n", b"x" * int(rng.integers(500)), b"a line\n" * int(rng.integers(60)), b"\nWARC/1.0\r\ncontent-length: 99999999999\r\n\r\n", "ß\n".encode()]
            content = b"".join(parts[i] for i in rng.integers(0, len(parts), int(rng.integers(5))))
            out += a_record(content, "X-Note: " + "y" * int(rng.integers(300)) + "\r\nX-Note: 2\r\n")
        made.append(out)
    return [*made, b"", b"junk\n" * 100 + inner, made[0][:-300], made[1] + b"junk" + inner * 9, a_record(b"z\n" * 2000), made[2][:-2], b"WARC/1.0\r\nContent-Length: x\r\n\r\n" + inner, b"WARC/1.0\r\nno end: " + b"w" * 900]


@pytest.mark.parametrize("seed", [1, 2])
def test_records_of_split_archives(spark, tmp_path, tiny_splits, seed):
    data = files(np.random.default_rng(seed))
    for i, d in enumerate(data):
        (tmp_path / f"{i}.warc").write_bytes(d)
    rows = warc.read(spark, str(tmp_path)).collect()
    got = sorted((int(re.search(r"(\d+)\.warc$", r.file)[1]), r.offset, bytes(r.content), r.truncated) for r in rows)
    want = sorted((i, *r) for i, d in enumerate(data) for r in brute(d))
    # the writer's last newline may be missing from a file and then counts as there
    cut = lambda rows: [(i, o, c.rstrip(b"\n") if t else c, t) for i, o, c, t in rows]
    assert cut(got) == cut(want)
    assert all(r.header["content-length"].isdigit() and r.header["warc-type"] == "resource" for r in rows)


def check(spark, rows, least=0):
    pages = spark.createDataFrame([(*r, "x", 1, True, 7) for r in rows], PAGES)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, least).collect() if r.intact]
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        top = max(same, default=page) if len(raw) >= least else page
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if page == top else "revisit", None if page == top else top))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pages_come_back(spark, tiny_splits):
    magic = a_record(b"inner").decode()
    htmls = [None, "", "a", "same", "same", "same", magic, magic + magic, "é\r\n\r\nß" * 50, "same", "WARC/1.1\r\nContent-Length: 5\r\n\r\n", "long\n" * 3000]
    check(spark, [(i * 3, [None, "http://a b/\r\nX: y", "http://c"][i % 3], h) for i, h in enumerate(htmls)])


def test_short_payloads_are_no_revisits(spark):
    check(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], 3)


def test_null_and_repeated_ids(spark):
    check(spark, [(None, "u", "a"), (None, "u", "b"), (5, "u", "b"), (None, "u", "c"), (None, "u", "c"), (7, "u", "d"), (7, "v", "d"), (6, "u", "d"), (7, "u", "e")])


def test_a_hot_payload(spark):
    check(spark, [(i, "u", "hot" if i % 3 else f"p{i}") for i in range(9000)])


def test_an_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
