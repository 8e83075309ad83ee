"""ISO media containers: nested boxes are walked and sample tables decoded into
codec, duration and byte ranges, without decoding any payload.

`mux` writes a payload as one track of 8-bit samples; `read` takes any file with
a moov box: 32- and 64-bit box sizes, boxes to the end of the file, versions 0 and 1, stco
and co64, constant and listed sample sizes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .spark_io import arrow_stage, documents, small_batches

#: Bytes of a sample (a frame of as many 8-bit values), samples of a chunk, values per second.
FRAME, CHUNK_SAMPLES, RATE = 576, 16, 8000
#: What a 64-bit column holds, and the standard's mark of an unknown duration.
TOP, UNKNOWN = (1 << 63) - 1, (1 << 64) - 1
#: Boxes that hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), body)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
_HDLR = full(b"hdlr", struct.pack(">I4s12x", 0, b"soun") + b"sound\0")
_DINF = box(b"dinf", full(b"dref", struct.pack(">I", 1) + full(b"url ", b"", flags=1)))
_STSD = full(b"stsd", struct.pack(">I", 1) + box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16)))


def mux(payload: bytes) -> bytes:
    """A file of one sound track whose samples are the payload's frames of FRAME bytes; each chunk's first sample is a sync sample."""
    n = len(payload) // FRAME
    if n * FRAME != len(payload) or not n:
        raise ValueError(f"a payload is a positive multiple of {FRAME} bytes")
    chunks = -(-n // CHUNK_SAMPLES)
    duration = n * FRAME
    runs = [(1, CHUNK_SAMPLES, 1)] if n >= CHUNK_SAMPLES else []
    if n % CHUNK_SAMPLES:
        runs.append((chunks, n % CHUNK_SAMPLES, 1))
    sync = np.arange(0, n, CHUNK_SAMPLES, dtype=">u4") + 1

    def moov(base: int) -> bytes:
        places = base + np.arange(chunks, dtype=np.int64) * (CHUNK_SAMPLES * FRAME)
        wide = int(places[-1]) >> 32
        table = full(b"co64", struct.pack(">I", chunks) + places.astype(">u8").tobytes()) if wide else full(b"stco", struct.pack(">I", chunks) + places.astype(">u4").tobytes())
        stbl = box(
            b"stbl", _STSD, full(b"stts", struct.pack(">III", 1, n, FRAME)), full(b"stss", struct.pack(">I", chunks) + sync.astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)) + b"".join(struct.pack(">III", *r) for r in runs)), full(b"stsz", struct.pack(">II", FRAME, n)), table,
        )
        mvhd = full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, duration) + struct.pack(">IH10x", 0x10000, 0x100) + _MATRIX + bytes(24) + struct.pack(">I", 2))
        tkhd = full(b"tkhd", struct.pack(">IIIIIQHHHH", 0, 0, 1, 0, duration, 0, 0, 0, 0x100, 0) + _MATRIX + bytes(8), flags=3)
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, duration, 0x55C4, 0))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, _HDLR, box(b"minf", full(b"smhd", bytes(4)), _DINF, stbl))))

    size = len(moov(0))
    head = struct.pack(">I4s", 8 + len(payload), b"mdat") if len(payload) < (1 << 32) - 8 else struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload))
    return b"".join((_FTYP, moov(len(_FTYP) + size + len(head)), head, payload))


#: Depth of boxes in boxes beyond which a file is broken.
DEPTH = 32


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()):
    """(path, body start, end) of every box, depth first; boxes stand at most DEPTH deep."""
    end = len(data) if end is None else end
    if len(path) > DEPTH:
        raise ValueError(f"boxes stand more than {DEPTH} deep")
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError(f"box {kind!r} at {start} is cut short")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has a wrong size")
        yield (*path, kind), body, start + size
        if kind in CONTAINERS:
            yield from walk(data, body, start + size, (*path, kind))
        start += size


@dataclass
class Track:
    """A track's tables; offsets and sizes by sample, in bytes of the file. A duration that the file leaves unknown is None."""

    handler: str = ""
    codec: str = ""
    timescale: int = 1
    duration: int | None = 0
    offsets: np.ndarray | None = None
    sizes: np.ndarray | None = None
    keys: np.ndarray | None = None
    times: np.ndarray | None = None

    def ranges(self, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the samples, neighbours that touch merged."""
        a, b = self.offsets[samples], self.offsets[samples] + self.sizes[samples]
        new = np.append(True, a[1:] != b[:-1]) if len(a) else np.zeros(0, bool)
        return a[new], b[np.append(new[1:], True)] if len(a) else b


def _table(data: bytes, at: int, kind: str, columns: int = 1) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + 4)
    values = np.frombuffer(data, kind, n * columns, at + 8)
    if kind == ">u8" and n and int(values.max()) > TOP:
        raise ValueError("a table's number is over 63 bits")
    return values.astype(np.int64).reshape(n, columns)


def read(data: bytes) -> list[Track]:
    """The file's tracks; raises ValueError where boxes or tables are broken."""
    tracks: list[Track] = []
    t: dict = {}

    def close() -> None:
        if not t:
            return
        track, sizes = t["track"], t.get("sizes", np.zeros(0, np.int64))
        chunks, runs = t.get("chunks", np.zeros(0, np.int64)), t.get("runs", np.zeros((0, 3), np.int64))
        per = np.zeros(len(chunks), np.int64)
        borders = np.append(runs[:, 0], len(chunks) + 1)
        if len(runs) and (borders[0] != 1 or (np.diff(borders) < 0).any()):
            raise ValueError("the chunk runs are out of order")
        for count, a, b in zip(runs[:, 1], borders[:-1] - 1, borders[1:] - 1, strict=True):
            per[a:b] = count
        if per.sum() != len(sizes):
            raise ValueError("the chunk and size tables differ")
        before = np.append(0, np.cumsum(sizes))
        heads = np.append(0, np.cumsum(per))[:-1]
        track.sizes = sizes
        track.offsets = np.repeat(chunks - before[heads], per) + before[:-1] if len(sizes) else sizes
        if len(sizes) and (int(track.offsets.min()) < 0 or int(track.offsets.max()) > len(data) or (track.offsets + sizes).max() > len(data)):
            raise ValueError("samples lie beyond the file")
        keys = t.get("keys")
        track.keys = np.arange(len(sizes)) if keys is None else keys
        if len(track.keys) and (track.keys.min() < 0 or track.keys.max() >= len(sizes)):
            raise ValueError("a keyframe lies beyond the samples")
        deltas = t.get("deltas", np.zeros((0, 2), np.int64))
        if deltas[:, 0].sum() > len(sizes):
            raise ValueError("the time and size tables differ")
        track.times = np.append(0, np.cumsum(np.repeat(deltas[:, 1], deltas[:, 0])))
        tracks.append(track)
        t.clear()

    try:
        for path, at, _ in walk(data):
            kind = path[-1]
            if kind == b"trak":
                close()
                t["track"] = Track()
            elif not t:
                continue
            elif kind == b"mdhd":
                track = t["track"]
                track.timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)
                if UNKNOWN > duration > TOP:
                    raise ValueError("a duration is over 63 bits")
                track.duration = None if duration in (UNKNOWN if data[at] == 1 else UNKNOWN >> 32,) else duration
            elif kind == b"hdlr" and path[-2:] == (b"mdia", b"hdlr"):
                t["track"].handler = data[at + 8 : at + 12].decode("latin-1")
            elif kind == b"stsd":
                t["track"].codec = data[at + 12 : at + 16].decode("latin-1")
            elif kind == b"stts":
                t["deltas"] = _table(data, at, ">u4", 2)
            elif kind == b"stss":
                t["keys"] = _table(data, at, ">u4")[:, 0] - 1
            elif kind == b"stsc":
                t["runs"] = _table(data, at, ">u4", 3)
            elif kind == b"stsz":
                same, n = struct.unpack_from(">II", data, at + 4)
                if same * n > len(data):
                    raise ValueError("samples lie beyond the file")
                t["sizes"] = np.full(n, same, np.int64) if same else np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
            elif kind in (b"stco", b"co64"):
                t["chunks"] = _table(data, at, ">u4" if kind == b"stco" else ">u8")[:, 0]
        close()
    except (struct.error, IndexError, OverflowError) as e:
        raise ValueError(f"a box is cut short: {e}") from e
    return tracks


def inspect(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """(key, handler, codec, timescale, duration, n_samples, keyframes array<struct<start, end>>, error) per
    track of a binary column; a broken or null value gives one row with its error, numbers that no column holds
    included; a duration marked as unknown is null. Repeated rows are read as
    they stand; an empty table gives an empty result; further columns are ignored."""
    small_batches(media.sparkSession, 200)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def each(batch):
        rows: list[tuple] = []
        for name, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                tracks = read(blob or b"")
                if not tracks:
                    raise ValueError("no track")
                for t in tracks:
                    a, b = t.ranges(t.keys)
                    rows.append((name, t.handler, t.codec, t.timescale, t.duration, len(t.sizes), [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)], None))
            except ValueError as e:
                rows.append((name, None, None, None, None, None, [], str(e)))
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), kind, pa.string()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "handler", "codec", "timescale", "duration", "n_samples", "keyframes", "error"])

    return arrow_stage(media.select(media[key].cast("long").alias("doc_id"), media[column].cast("binary").alias("media")), each, "doc_id long, handler string, codec string, timescale long, duration long, n_samples long, keyframes array<struct<start:long,end:long>>, error string")


def pad(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary): every whole text as a file. Null texts count as empty, repeated rows are stored as
    they stand, an empty table gives an empty result; further columns are ignored."""

    def each(batch):
        for a, b, data, offs in tv.batches(batch.column(1)):
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([mux(pad(data[x:y].tobytes())) for x, y in zip(offs[:-1], offs[1:], strict=True)], pa.binary())], ["doc_id", "media"])

    return arrow_stage(documents(docs), each, "doc_id long, media binary")


def digest(docs: DataFrame) -> DataFrame:
    """Every text stored as a file, read back through its tables, and the file's features.

    Null and empty texts are one frame of 255s. Repeated rows are stored as they stand; an
    empty table gives an empty result; further columns are ignored."""

    def one(raw: bytes) -> tuple:
        media = mux(pad(raw))
        (track,) = read(media)
        a, b = track.ranges(np.arange(len(track.sizes)))
        payload = b"".join(media[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True))
        x, y = track.ranges(track.keys)
        keys = zlib.crc32(np.stack([x, y], axis=1).astype("<i8").tobytes())
        feature = f"{track.handler}/{track.codec.strip()} {track.duration}/{track.timescale}s {len(track.sizes)} samples {len(track.keys)} keyframes first {x[0]}-{y[0]} last {x[-1]}-{y[-1]} ranges {keys:08x}"
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def each(batch):
        for a, b, data, offs in tv.batches(batch.column(1)):
            rows = [one(data[x:y].tobytes()) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(0).slice(a, b - a), *(pa.array(c) for c in zip(*rows, strict=True))], names)

    return arrow_stage(documents(docs), each, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumn("tail_crc32", F.col("tail_crc32").cast("long"))
