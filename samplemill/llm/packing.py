"""Hierarchical packing of tokenised documents into windows of several lengths.

Documents are tokenised and packed in one pass over the table's own partitions,
so nothing is shuffled and a task holds one round of pieces. Whole windows of
the longest tier are cut from long documents at once. What is left of a document
goes to the tier of the shortest window that holds it. Tiers are packed from the
longest piece down: a window opens with the longest piece, its gap takes the
longest shorter-tier pieces that fit, and the last gap is closed by cutting a
piece. Windows are therefore full except at a partition's end, where the rest is
cut into the shorter windows. Sequences of one window length are dealt to step
groups of equal token counts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe
from . import textvec as tv
from .spark_io import documents, released

#: Window lengths, longest first.
WINDOWS = (4096, 2048, 1024, 512, 256)
#: Tokens gathered before tiers are packed.
ROUND_TOKENS = 1 << 19
#: Tokens of a step group.
STEP_TOKENS = 8 * 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, step_id long"
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_id")
#: Sequence and step ids of a partition begin at partition << _SHIFT.
_SHIFT = 33


class Packer:
    """Packs one partition's documents; `rows` holds what is finished."""

    def __init__(self, partition: int, windows: tuple[int, ...] = WINDOWS) -> None:
        self.windows, self.base = windows, partition << _SHIFT
        self.pool: list[tuple[int, int, int, int | None, int, np.ndarray]] = []  # length, order, start, doc_id, doc_tokens, ids
        self.order = self.sequences = self.steps = self.waiting = 0
        self.open_steps: dict[int, tuple[int, int]] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """ids: little-endian unsigned 32-bit, at least one."""
        top, n = self.windows[0], len(ids)
        whole = n - n % top
        for start in range(0, whole, top):
            self._emit([(top, 0, start, doc_id, n, ids[start : start + top])], top)
        if n > whole:
            self.order += 1
            self.pool.append((n - whole, self.order, whole, doc_id, n, ids[whole:]))
            self.waiting += n - whole
            if self.waiting >= ROUND_TOKENS:
                self.pack()

    def _tier(self, length: int) -> int:
        return next(w for w in reversed(self.windows) if w >= length)

    def _emit(self, pieces: list[tuple], window: int) -> None:
        sequence = self.base + self.sequences
        self.sequences += 1
        step, used = self.open_steps.get(window, (None, 0))
        if step is None or used + window > STEP_TOKENS:
            step, used = self.base + self.steps, 0
            self.steps += 1
        self.open_steps[window] = (step, used + window)
        offset = 0
        for length, _, start, doc_id, total, ids in pieces:
            self.rows.append((doc_id, start, length, zlib.crc32(ids.tobytes()), total, sequence, offset, window, step))
            offset += length

    def _cut(self, piece: tuple, at: int) -> tuple[tuple, tuple]:
        length, order, start, doc_id, total, ids = piece
        return (at, order, start, doc_id, total, ids[:at]), (length - at, order, start + at, doc_id, total, ids[at:])

    def pack(self, last: bool = False) -> None:
        """Packs the waiting pieces; but for the last time, about two windows' worth stays."""
        pool = sorted(self.pool, key=lambda p: p[:3])
        left = sum(p[0] for p in pool)
        floor = 0 if last else 2 * self.windows[0]
        while pool and left > floor:
            first = pool.pop()
            window = self._tier(first[0])
            if left < window:
                pool.append(first)
                break
            pieces, gap = [first], window - first[0]
            while gap:
                i = bisect_right(pool, gap, key=lambda p: p[0]) - 1
                if i >= 0:
                    piece = pool.pop(i)
                else:
                    piece, rest = self._cut(pool.pop(0), gap)
                    insort(pool, rest, key=lambda p: p[:3])
                pieces.append(piece)
                gap -= piece[0]
            self._emit(pieces, window)
            left -= window
        if last:
            pool.reverse()
            while pool:
                # under the shortest window, sequences at powers of two, so that nothing is padded however many partitions there are
                window = next((w for w in self.windows if w <= left), 1 << (left.bit_length() - 1))
                pieces, gap = [], window
                while gap:
                    piece = pool.pop(0)
                    if piece[0] > gap:
                        piece, rest = self._cut(piece, gap)
                        pool.insert(0, rest)
                    pieces.append(piece)
                    gap -= piece[0]
                    left -= piece[0]
                self._emit(pieces, window)
        # what waits no longer refers to whole documents or batches
        self.pool = [(*p[:5], p[5].copy()) for p in pool]
        self.waiting = sum(p[0] for p in self.pool)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(_FIELDS)
        self.rows = []
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], _FIELDS)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 2, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Pieces of every document in sequences; columns as in SCHEMA.

    A document's ids are those of the tokenizer at `path` without special tokens,
    then `end_id`; a null or empty text has `end_id` alone. Each id lies in
    exactly one piece. `window` is the length to which the piece's sequence is
    padded, which all fill: what is left of a partition under the shortest window goes to
    sequences at smaller powers of two. Sequence and step ids are distinct across partitions and the
    same when a task runs again, as its partition's rows come in the same order.
    Repeated rows are packed as they stand; an empty table gives no rows; further
    columns are ignored.
    """

    def each(it):
        packer = Packer(TaskContext.get().partitionId(), windows)
        v = bpe.vocabulary(path or bpe.default_path())
        for batch in it:
            names = batch.column(0).to_pylist()
            for a, b, data, offs in tv.batches(batch.column(1)):
                ids, at = v.encode(data, offs)
                n = len(at) - 1
                ids = np.insert(ids.astype("<u4"), at[1:], end_id)
                at = at + np.arange(n + 1)
                for i, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    packer.add(names[a + i], ids[x:y])
                packer.pool = [(*p[:5], p[5].copy()) if p[5].base is ids else p for p in packer.pool]
            if len(packer.rows) > 10_000:
                yield packer.take()
        packer.pack(last=True)
        yield packer.take()

    # a task loads the tokenizer anew (half a second): idle workers of an executor would each hold its tables
    return documents(docs).mapInArrow(released(each), SCHEMA)
