"""WARC archives: pages are written as records, and archives of any size are read back in splits.

A split knows no record's start but the file's own. So each task reports, for every line of its split that could
begin a record, where that record's successor would stand. Candidates are first chained within their split; what
enters a split from another is a far smaller table, along which pointer jumping from the files' starts finds the
one true entry of each split in a number of rounds that is the logarithm of a file's splits. Magic inside payloads
is a candidate that no chain reaches. A second reading walks each split from its entry; the pieces of a record
that crosses splits are put together by the place where its successor stands.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spark_io import BATCH_ROWS, arrow_stage, cut, join_heavy, key_filter, released, shared_folder, small_batches, within

#: How a record begins, ends its header and ends.
MAGIC, HEADER_END, TRAILER = b"WARC/", b"\n\r\n", b"\r\n\r\n"
LENGTH = b"content-length:"
#: Bytes of records gathered before a batch leaves a task.
OUT_BYTES = 1 << 22
DATE = "2000-01-01T00:00:00Z"
_NO_ID = "none"


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(kind: str, record_id: str, block: bytes, **fields: str | None) -> bytes:
    """A record without its last newline, which the writer of lines adds. Names of `fields` have _ for -; control
    characters and spaces of values are percent-encoded, so that a value stays one line."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>"]
    for name, value in fields.items():
        if value is not None:
            head.append(f"{name.replace('_', '-')}: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value))
    text = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"])
    return text.encode() + b"\r\n\r\n" + block + TRAILER[:-1]


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _page(page: int | None) -> str:
    return f"urn:page:{_NO_ID if page is None else page}"


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """One record per row of pages (page_id, url, html), in files below `path` (which must not exist).

    Of rows with equal payloads of at least `least` bytes those of the largest page_id are response records and the
    others revisit records that name it, without payload. A null html is an empty payload; rows without page_id never
    are the one that is named; repeated rows (equal id and payload) share their type; a null url leaves its field out.
    An empty table writes no record. Further columns are ignored. Payloads do not move: rows whose payload repeats
    meet the largest id by their digest, and only the payloads of the named rows are sent there."""
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("html", 256)), "size": F.octet_length("html").cast("long")})
    counts = cut(rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")))
    groups = counts.where("n > 1 and top is not null")
    shared = key_filter(groups.select(F.xxhash64("digest").alias("key")))
    rows = rows.withColumn("some", within(shared, F.xxhash64("digest")) & (F.col("size") >= least))
    # what the filter passes has a named row, which is itself where the payload does not repeat
    named = cut(counts.where(within(shared, F.xxhash64("digest"))).select("digest", "top"))
    tops = key_filter(named.select(F.xxhash64("digest", "top").alias("key")))
    own = rows.where("some").where(within(tops, F.xxhash64("digest", "page_id")))
    own = own.join(named.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("top")), "left_semi")
    full = rows.where("not some").unionByName(own).select("page_id", "url", "html")
    seen = rows.where("some").select("page_id", "url", "size", F.sha1("html").alias("sha1"), "digest")
    again = join_heavy(seen, groups, ["digest"], "n").where("page_id is null or page_id < top").drop("digest")

    def info() -> bytes:
        return record("warcinfo", f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, DATE)}", b"format: WARC File Format 1.1\r\n", WARC_Date=DATE, Content_Type="application/warc-fields")

    def written(make: Callable[[dict], bytes]):
        def each(it):
            first = True
            for batch in it:
                for a in range(0, batch.num_rows, 100):
                    out = [make(r) for r in batch.slice(a, 100).to_pylist()]
                    yield pa.record_batch([pa.array([info()] * first + out, pa.binary())], ["value"])
                    first = False

        return released(each)

    def response(r: dict) -> bytes:
        payload = r["html"].encode()
        return record("response", _page(r["page_id"]), _http(len(payload)) + payload, WARC_Date=DATE, WARC_Target_URI=r["url"], WARC_Payload_Digest="sha1:" + base32_sha1(hashlib.sha1(payload).hexdigest()), Content_Type="application/http;msgtype=response")

    def revisit(r: dict) -> bytes:
        return record(
            "revisit", _page(r["page_id"]), _http(r["size"]), WARC_Date=DATE, WARC_Target_URI=r["url"], WARC_Payload_Digest="sha1:" + base32_sha1(r["sha1"]), WARC_Refers_To=f"<{_page(r['top'])}>",
            WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", Content_Type="application/http;msgtype=response",
        )

    lines = full.mapInArrow(written(response), "value binary").unionByName(again.mapInArrow(written(revisit), "value binary"))
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def _header(raw: bytes) -> dict[str, str]:
    """A header's fields by lower-case name; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for line in raw.split(b"\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    return out


def _length(line: bytes) -> int | None:
    """The number of a Content-Length line; nothing where it is none."""
    digits = line[len(LENGTH) :].strip()
    return int(digits) if digits.isdigit() and len(digits) < 19 else None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the files: at (the file's hash), block (where its split begins), line (with its newline) and name (the file, on
    lines that may begin a record)."""
    value = F.col("value").cast("binary")
    name = F.when(F.startswith(value, F.lit(MAGIC)), F.col("_metadata.file_path"))
    return spark.read.option("lineSep", "\n").text(path).select(F.xxhash64("_metadata.file_path").alias("at"), F.col("_metadata.file_block_start").alias("block"), value.alias("line"), name.alias("name"))


def _runs(batch: pa.RecordBatch):
    """(file, block, first row, end row) of each stretch of a batch that is of one split."""
    at, block = (batch.column(c).to_numpy() for c in ("at", "block"))
    heads = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (block[1:] != block[:-1])))
    for a, b in zip(heads, np.append(heads[1:], len(at)), strict=True):
        yield int(at[a]), int(block[a]), int(a), int(b)


class _Survey:
    """What a split says of its candidates; places are counted from the split's first line."""

    def __init__(self, at: int, block: int) -> None:
        self.key, self.size = (at, block), 0
        self.starts: list[int] = []
        self.ends: list[int | None] = []
        self.lengths: list[int | None] = []
        self.open: list[int] = []
        self.head: list[int | None] = [None, None, None]  # the first header end, the length before it, its place

    def add(self, sizes: np.ndarray, marks: list[bytes | None]) -> None:
        ends = self.size + np.cumsum(sizes)
        for i in (i for i, m in enumerate(marks) if m is not None):
            end, mark = int(ends[i]), marks[i]
            if mark.startswith(MAGIC):
                self.open.append(len(self.starts))
                self.starts.append(end - int(sizes[i]))
                self.ends.append(None)
                self.lengths.append(None)
            elif mark == b"\r":
                for c in self.open:
                    self.ends[c] = end
                self.open = []
                if self.head[0] is None:
                    self.head[0] = end
            else:
                n = _length(mark)
                for c in self.open:
                    self.lengths[c] = n if self.lengths[c] is None else self.lengths[c]
                if self.head[0] is None and self.head[1] is None:
                    self.head[1:] = [n, end]
        self.size = int(ends[-1]) if len(ends) else self.size

    def row(self) -> tuple:
        return (*self.key, self.size, self.starts, self.ends, self.lengths, *self.head)


def survey(spark: SparkSession, path: str) -> DataFrame:
    """One row per split: at, block, base (the place of its first line), size, the candidates' starts, ends of header and lengths
    (null where the split ends first), and next_end, next_length: what the following splits complete."""
    small_batches(spark, 10_000)
    line = F.col("line")
    low = F.lower(F.substring(line, 1, len(LENGTH)).cast("string"))
    mark = F.when(F.startswith(line, F.lit(MAGIC)), F.lit(MAGIC)).when(line == F.lit(b"\r\n"), F.lit(b"\r")).when(low == LENGTH.decode(), F.substring(line, 1, 64))
    lines = _lines(spark, path).withColumn("line", F.concat("line", F.lit(b"\n"))).select("at", "block", F.octet_length("line").cast("long").alias("size"), mark.alias("mark"))
    names = ["at", "block", "size", "starts", "ends", "lengths", "head_end", "head_length", "head_at"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, *[pa.int64()] * 3]

    def each(it):
        now = None
        for batch in it:
            if not batch.num_rows:
                continue
            sizes, marks = batch.column("size").to_numpy(), batch.column("mark")
            for at, block, a, b in _runs(batch):
                if now is None or now.key != (at, block):
                    if now is not None:
                        yield packed(now)
                    now = _Survey(at, block)
                now.add(sizes[a:b], marks.slice(a, b - a).to_pylist())
        if now is not None:
            yield packed(now)

    def packed(s: _Survey) -> pa.RecordBatch:
        return pa.record_batch([pa.array([x], k) for x, k in zip(s.row(), kinds, strict=True)], names)

    rows = cut(lines.mapInArrow(released(each), "at long, block long, size long, starts array<long>, ends array<long>, lengths array<long>, head_end long, head_length long, head_at long"))
    file = Window.partitionBy("at").orderBy("block")
    after = file.rowsBetween(1, Window.unboundedFollowing)
    base = F.coalesce(F.sum("size").over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("base", base).withColumns({c: F.col(c) + F.col("base") for c in ("head_end", "head_at")})
    length = F.when(F.col("head_at").isNotNull(), F.struct("head_at", "head_length"))
    rows = rows.withColumns({"next_end": F.first("head_end", True).over(after), "n": F.first(length, True).over(after)})
    return rows.withColumn("next_length", F.when(F.col("n.head_at") < F.col("next_end"), F.col("n.head_length"))).drop("n", "head_end", "head_length", "head_at")


def chains(splits: DataFrame) -> DataFrame:
    """(at, block, start, exit) of each candidate: the place of the first successor's successor ... beyond its split, or where its
    chain breaks (null if a header has no end or length)."""

    def each(batch):
        for r in batch.to_pylist():
            starts = np.array(r["starts"], np.int64) + r["base"]
            ends = [r["next_end"] if e is None else e + r["base"] for e in r["ends"]]
            lengths = [r["next_length"] if n is None and e is None else n for n, e in zip(r["lengths"], r["ends"], strict=True)]
            good = np.array([e is not None and n is not None for e, n in zip(ends, lengths, strict=True)], bool)
            next_ = np.array([e + n + len(TRAILER) if ok else -1 for e, n, ok in zip(ends, lengths, good, strict=True)], np.int64)
            # pointer jumping within the split
            found = np.minimum(np.searchsorted(starts, next_), max(len(starts) - 1, 0))
            jump = np.where(good & (starts[found] == next_), found, np.arange(len(starts))) if len(starts) else found
            while len(jump) and (jump[jump] != jump).any():
                jump = jump[jump]
            out = next_[jump] if len(jump) else next_
            n = len(starts)
            yield pa.record_batch([pa.array([r["at"]] * n, pa.int64()), pa.array([r["block"]] * n, pa.int64()), pa.array(starts), pa.array(out, mask=out < 0)], ["at", "block", "start", "exit"])

    small_batches(splits.sparkSession, 16)
    return arrow_stage(splits.select("at", "block", "base", "starts", "ends", "lengths", "next_end", "next_length"), each, "at long, block long, start long, exit long")


def entries(links: DataFrame) -> DataFrame:
    """(at, block, start, exit): the candidate of each split at which the chain from its file's start enters it, from what chains() returns."""
    wanted = links.where("exit is not null").select("at", F.col("exit").alias("start")).distinct()
    wanted = wanted.unionByName(links.select("at").distinct().withColumn("start", F.lit(0).cast("long"))).distinct()
    nodes = cut(links.join(wanted, ["at", "start"], "left_semi"))
    there = nodes.select("at", F.col("start").alias("exit"))
    jumps = cut(nodes.where("exit is not null").select("at", "start", "exit").join(there, ["at", "exit"], "left_semi"))
    reached = nodes.where("start = 0").select("at", "start")
    while not jumps.isEmpty():
        # all within 2^k steps, then jumps of twice the length
        further = reached.join(jumps, ["at", "start"]).select("at", F.col("exit").alias("start"))
        reached = cut(reached.unionByName(further).distinct())
        jumps = cut(jumps.join(jumps.select("at", F.col("start").alias("exit"), F.col("exit").alias("e")), ["at", "exit"]).select("at", "start", F.col("e").alias("exit")))
    return nodes.join(reached, ["at", "start"], "left_semi").select("at", "block", "start", "exit")


def whole(header: dict[str, str], block: bytes, short: bool) -> tuple:
    return list(header.items()), block, short


WHOLE = "header map<string,string>, content binary, truncated boolean"
_TYPES = {"string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "long": pa.int64(), "map<string,string>": pa.map_(pa.string(), pa.string())}


def read(spark: SparkSession, path: str, make: Callable[[dict[str, str], bytes, bool], tuple] = whole, schema: str = WHOLE, small: bool = False) -> DataFrame:
    """(file, offset, what `make` returns) of every record of the archives below `path`, whatever the files' size and splits.

    make(header by lower-case names, content, truncated) gives the columns of `schema`; by default these three. A record
    whose file ends before its content does is truncated; one whose header does not end, and all that follows a place where
    no record begins as it should, is not returned. With `small`, made rows are kept in a checkpoint instead of being
    made again for the records that cross splits. Empty files have no records."""
    splits = survey(spark, path)
    splits = cut(splits)
    inside = entries(cut(chains(splits)))
    per = splits.select("at", "block", "base", "size").join(inside, ["at", "block"], "left")
    before = Window.partitionBy("at").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row a split, as many as the driver plans itself
    known = {(r.at, r.block): (r.base, r.start, r.exit, r.until or 0, r.base + r.size) for r in per.select("at", "block", "base", "size", "start", "exit", F.max("exit").over(before).alias("until")).collect()}
    crossing = any(until > base or (start is not None and (exit_ or 0) > end) for base, start, exit_, until, end in known.values())
    plan = spark.sparkContext.broadcast(known)
    names = [part.split()[0] for part in schema.replace(", ", ",").split(",") if " " in part]
    kinds = [_TYPES[part.split(" ", 1)[1]] for part in schema.split(", ")]
    fields = ["file", "offset", *names, "at", "until", "piece"]
    types = [pa.string(), pa.int64(), *kinds, pa.int64(), pa.int64(), pa.binary()]

    def cut_out(data, position: int) -> tuple[dict[str, str], int, int] | None:
        """(header, where the content begins, where it should end) of the record at a position, if its header ends."""
        end = data.find(HEADER_END, position)
        if end < 0:
            return None
        raw = bytes(data[position : end + 1])
        n = next((_length(x) for x in raw.split(b"\n")[1:] if x[: len(LENGTH)].lower() == LENGTH and _length(x) is not None), None)
        return None if n is None else (_header(raw), end + len(HEADER_END), end + len(HEADER_END) + n)

    def each(it):
        rows: list[tuple] = []
        held, key = 0, None
        data, place, file, done = bytearray(), 0, None, True

        def close():
            """A record that goes on in the next split, or that the file cuts short."""
            if key is not None and not done and data and known_[2] is not None:
                rows.append((file, place, *[None] * len(names), key[0], known_[2], bytes(data)))

        known_ = None
        for batch in it:
            if not batch.num_rows:
                continue
            lines, labels = batch.column("line"), batch.column("name")
            for at, block, a, b in _runs(batch):
                if key != (at, block):
                    close()
                    key, known_ = (at, block), plan.value[at, block]
                    data, place, done = bytearray(), known_[0], False
                    label = None
                label = label or next((x for x in labels.slice(a, b - a).to_pylist() if x), None)
                file = label
                if done:
                    continue
                data += b"".join(lines.slice(a, b - a).to_pylist())
                base, start, _, until, end = known_
                first = end if start is None else start
                if place < first:
                    # what belongs to a record of an earlier split, then what belongs to none
                    if place < until:
                        piece = bytes(data[: min(first, until) - place])
                        rows.append((None, place, *[None] * len(names), at, until, piece))
                        held += len(piece)
                    skip = min(len(data), first - place)
                    del data[:skip]
                    place += skip
                    if place < first:
                        continue
                position = 0
                while start is not None and len(data) - position >= len(MAGIC):
                    if not data.startswith(MAGIC, position):
                        done = True
                        break
                    got = cut_out(data, position)
                    if got is None or len(data) < got[2] + len(TRAILER):
                        break
                    header, x, y = got
                    rows.append((file, place + position, *make(header, bytes(data[x:y]), False), None, None, None))
                    held += y - position
                    position = y + len(TRAILER)
                del data[:position]
                place += position
                if held > OUT_BYTES:
                    yield made(rows)
                    rows, held = [], 0
        close()
        if rows:
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], fields)

    small_batches(spark, BATCH_ROWS)
    lines = _lines(spark, path).withColumn("line", F.concat("line", F.lit(b"\n")))
    parts = lines.mapInArrow(released(each), f"file string, offset long, {schema}, at long, until long, piece binary")
    if small:
        parts = cut(parts)
    out = parts.where("until is null").select("file", "offset", *names)
    if not crossing and not small:
        return out

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        data = b"".join(table["piece"].to_pylist())
        got, rows = cut_out(data, 0) if data.startswith(MAGIC) else None, []
        if got is not None:
            header, x, y = got
            rows.append((next((f for f in table["file"].to_pylist() if f), None), table["offset"][0].as_py(), *make(header, data[x:y], len(data) < y)))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * (2 + len(names)), types[: 2 + len(names)], strict=True)], ["file", "offset", *names])

    pieces = parts.where("until is not null").select("file", "offset", "at", "until", "piece")
    return out.unionByName(pieces.groupBy("at", "until").applyInArrow(join, f"file string, offset long, {schema}"))


def described(header: dict[str, str], block: bytes, short: bool) -> tuple:
    """A page record's type, ids, payload size and digest; of a revisit, as its header says them."""
    kind = header.get("warc-type")
    page, to = (header.get(name, "").strip("<>").removeprefix("urn:page:") for name in ("warc-record-id", "warc-refers-to"))
    head, _, payload = block.partition(b"\r\n\r\n")
    said = header.get("warc-payload-digest", "").removeprefix("sha1:")
    number = lambda s: int(s) if s.lstrip("-").isdigit() else None
    if kind == "revisit":
        size = _header(head).get("content-length", "")
        return number(page), number(size), said, kind, number(to), not short
    found = base32_sha1(hashlib.sha1(payload).hexdigest())
    return number(page), len(payload), found, kind, number(to), not short and found == said


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact) of every page, read back from archives in the shared
    folder; intact: the record is whole and its payload has the digest that its header names. See write() for nulls and ties."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
    rows = read(spark, path, described, schema, small=True)
    return rows.where("record_type in ('response', 'revisit')").drop("file", "offset")
