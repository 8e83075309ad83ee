"""Vectorised helpers that the text operators share: whole Arrow batches of
texts become numpy arrays of word places and 64-bit word hashes.

Nothing here knows about Spark; every function works on one bounded piece of a
batch, so a task's memory does not depend on the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in pieces of about so many bytes (a longer text is its own piece).
PIECE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space (20, 09-0D) ends.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words of digits, lower-case letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def byte_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `limit` bytes each."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        yield a, b
        a = b


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base & (1 << 64) - 1, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64, at least `size` of each."""
    return _powers(max(PIECE_BYTES, 1 << (size + 1).bit_length()) + 1)


def forget() -> None:
    """Drops the tables of powers, which are as long as the longest text so far."""
    _powers.cache_clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums of bytes times powers of the base; see `span_hash`."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal bytes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): places of maximal runs of `kind` bytes, none across
    texts; the words of text i are first[i] to first[i + 1]."""
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    inside = kind[data]
    edges = offs[(offs > 0) & (offs < len(data))]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `words`, of the lower-cased bytes, and each word's 64-bit hash."""
    low = LOWER[data]
    starts, ends, first = words(low, offs, kind)
    return starts, ends, first, span_hash(prefix_hash(low), starts, ends) if len(starts) else np.zeros(0, np.uint64)


def batches(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a column's pieces."""
    data, offs = byte_arrays(column)
    for a, b in pieces(offs, limit):
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def shingle_sets(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(set, offsets): per text its distinct `width`-word shingles as sorted 64-bit
    hashes; a text of fewer words has its whole sequence, an empty one nothing."""
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(n)), count)
    if not len(owner):
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    at = first[:-1][owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    have = np.minimum(width, n[owner])
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    total = have.astype(np.uint64)
    for k in range(width):
        total = total * np.uint64(0x9FB21C651E98DF25) + np.where(k < have, padded[at + k], np.uint64(0))
        total = total ^ (total >> np.uint64(32))
    total = mix(total)
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    keep = np.ones(len(total), dtype=bool)
    keep[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    total, owner = total[keep], owner[keep]
    return total, np.searchsorted(owner, np.arange(len(n) + 1))
