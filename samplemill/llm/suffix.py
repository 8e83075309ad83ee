"""Repeated passages by suffix arrays.

Every byte under a string of `length` bytes that starts anywhere else too is
found exactly, in four steps:

1. Each window of `length` bytes names the smallest hash among its 128-byte
   strings (an anchor); windows that name one anchor occurrence form one range.
   Equal windows name equal anchors, so only ranges under one anchor hash can
   hold equal windows.
2. Ranges whose bytes are equal as a whole repeat as a whole; of each such class one
   range stays. An anchor hash with one class is done with.
3. The ranges that are left under an anchor hash meet in a shard. A shard's
   suffix array is built by induced sorting: suffixes are classified, the leftmost-smaller
   substrings are sorted by induction and named, the string of names is sorted by induced sorting
   itself, and the array is induced from it, bucket by bucket. Permuted
   common prefixes then tell which windows start elsewhere too. An anchor hash with
   very many ranges is dealt over a grid of block pairs.
4. What repeats is gathered per document and cut out.

Runs of words are found by the same ranges, on texts whose words are replaced by codes of
CODE bytes each; a shard then compares the hashes of all windows of whole words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .spark_io import arrow_stage, cut, documents, join_heavy, key_filter, released, within

#: Bytes of the strings that repeat, and of an anchor.
LENGTH, ANCHOR = 400, 128
#: Bytes of a word's code; words of a run that repeats (more than 50); words of an anchor then.
CODE, RUN_WORDS, ANCHOR_WORDS = 6, 51, 16
#: Ranges of one anchor hash that a shard takes whole; bytes of a shard beyond which it takes no further hash.
BLOCK, SHARD_BYTES = 4096, 1 << 19
#: A byte that no UTF-8 text holds stands between a shard's ranges.
GAP = 0xFF
RANGES = "anchor long, whole long, k1 long, k2 long, span long, owned long, at int"


# -- suffix arrays ---------------------------------------------------------------


def _classify(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the empty suffix is the smallest."""
    n = len(s)
    step = np.ones(n, dtype=np.int8)
    step[:-1] = np.sign(s[:-1].astype(np.int32) - s[1:])
    decided = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(decided[::-1])[::-1]
    return step[nearest] < 0


def _induce(s: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The suffix array that seeds (leftmost-smaller suffixes, in order) induce."""
    n = len(s)
    sa = np.full(n, -1, dtype=np.int32)
    count = np.bincount(s, minlength=256)
    begin = np.append(0, np.cumsum(count))
    letters = np.flatnonzero(count).tolist()

    def put(items: np.ndarray, larger: bool, at: np.ndarray) -> None:
        """Places the predecessors of items at the buckets' open ends."""
        p = items[items > 0] - 1
        p = p[smaller[p] != larger]
        if not len(p):
            return
        k = s[p]
        order = np.argsort(k, kind="stable")
        p, k = p[order], k[order]
        many = np.bincount(k, minlength=256)
        rank = np.arange(len(p)) - (np.cumsum(many) - many)[k]
        if larger:
            sa[at[k] + rank] = p
            at += many
        else:
            sa[at[k] - 1 - rank] = p
            at -= many

    head = begin[:-1].copy()
    seed_at = np.searchsorted(s[seeds], np.arange(257))
    put(np.array([n], dtype=np.int64), True, head)
    for c in letters:
        done = int(begin[c])
        while done < head[c]:
            wave, done = sa[done : head[c]], int(head[c])
            put(wave, True, head)
        put(seeds[seed_at[c] : seed_at[c + 1]], True, head)
    tail = begin[1:].copy()
    for c in reversed(letters):
        done = int(begin[c + 1])
        while done > tail[c]:
            wave, done = sa[tail[c] : done][::-1], int(tail[c])
            put(wave, False, tail)
        put(sa[begin[c] : head[c]][::-1], False, tail)
    return sa


def sort_suffixes(s: np.ndarray) -> np.ndarray:
    """Suffix array of a string of whole numbers from 0, by induced sorting; the string of names calls this again, so that
    the work is linear. The empty suffix is the smallest."""
    s = np.asarray(s, dtype=np.int64)
    n = len(s)
    if n < 2:
        return np.arange(n)
    smaller = _classify(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    ends = np.cumsum(np.bincount(s))
    begins = np.append(0, ends[:-1])
    # for each suffix the bucket of the one before it, if that is larger (smaller) than this one; -1 otherwise and for places yet open
    larger_before, smaller_before = (np.append(np.append(-1, np.where(kind, s, -1)[:-1]), -1).tolist() for kind in (~smaller, smaller))

    def induce(seeds: np.ndarray) -> np.ndarray:
        """The suffix array that leftmost-smaller suffixes, in order, induce."""
        first = np.full(n, n)
        seeds = seeds[np.argsort(s[seeds], kind="stable")]
        kinds = s[seeds]
        first[ends[kinds] - np.searchsorted(kinds, kinds, side="right") + np.arange(len(seeds))] = seeds
        sa, at = first.tolist(), begins.tolist()
        # the empty suffix comes first and induces the last one
        sa[at[s[-1]]] = n - 1
        at[s[-1]] += 1
        for q in sa:
            c = larger_before[q]
            if c >= 0:
                i = at[c]
                sa[i] = q - 1
                at[c] = i + 1
        at = ends.tolist()
        for q in reversed(sa):
            c = smaller_before[q]
            if c >= 0:
                at[c] = i = at[c] - 1
                sa[i] = q - 1
        return np.array(sa)

    if not len(lms):
        return induce(lms)
    names, several = _names(s, lms, induce(lms))
    return induce(lms[sort_suffixes(names) if several else np.argsort(names)])


def _names(s: np.ndarray, lms: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, bool]:
    """(names of the leftmost-smaller places, whether some share one): equal for equal substrings up to and with the next such place;
    the last one's runs to the end, which nothing else does. `sa` has them in order of these substrings."""
    end = np.zeros(len(s), dtype=np.int64)
    end[lms] = np.append(lms[1:] + 1, len(s))
    ordered = sa[end[sa] > 0].astype(np.int64)
    a, b = ordered[:-1], ordered[1:]
    same = (end[a] - a == end[b] - b) & (a != lms[-1]) & (b != lms[-1])
    pair = np.flatnonzero(same)
    same[pair] = same_bytes(s, a[pair], b[pair], end[a[pair]] - a[pair])
    name = np.empty(len(s), dtype=np.int64)
    name[ordered] = np.append(0, np.cumsum(~same))
    return name[lms], bool(same.any())


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of bytes: the first level in waves of whole buckets, the string of names by sort_suffixes()."""
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    smaller = _classify(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) == 0:
        return _induce(s, smaller, lms)
    names, several = _names(s, lms, _induce(s, smaller, lms[np.argsort(s[lms], kind="stable")]))
    return _induce(s, smaller, lms[sort_suffixes(names) if several else np.argsort(names)])


def same_bytes(s: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether s[a:a + size] is s[b:b + size], byte by byte, for each pair."""
    before = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(before, size)
    bad = s[np.repeat(a, size) + step] != s[np.repeat(b, size) + step]
    wrong = np.append(0, np.cumsum(bad))
    return wrong[before + size] == wrong[before]


def common_prefixes(s: np.ndarray, sa: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): each suffix's predecessor in the array (-1: none) and their common
    prefix's length, up to cap. Only where the letters before differ is it searched for; elsewhere
    it is one less than at the place before."""
    n = len(s)
    phi = np.empty(n, dtype=np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (phi[1:] <= 0) | (phi[:-1] != phi[1:] - 1) | (s[:-1] != s[np.maximum(phi[1:], 1) - 1])
    at = np.flatnonzero(fresh & (phi >= 0))
    other = phi[at]
    room = np.minimum(n - np.maximum(at, other), cap + n)
    sums = tv.prefix_hash(s)
    low, step = np.zeros(len(at), dtype=np.int64), 1
    # doubling finds a power of two that fails, halving the length
    live = np.arange(len(at))
    size = np.zeros(len(at), dtype=np.int64)
    while len(live):
        ok = (room[live] >= step) & (tv.span_hash(sums, at[live], np.minimum(at[live] + step, n)) == tv.span_hash(sums, other[live], np.minimum(other[live] + step, n)))
        size[live] = np.where(ok, step, size[live])
        live = live[ok]
        step *= 2
    low = size.copy()
    half = size // 2
    while (half > 0).any():
        live = np.flatnonzero(half > 0)
        to = low[live] + half[live]
        ok = (room[live] >= to) & (tv.span_hash(sums, at[live], np.minimum(at[live] + to, n)) == tv.span_hash(sums, other[live], np.minimum(other[live] + to, n)))
        low[live] = np.where(ok, to, low[live])
        half //= 2
    plcp = np.zeros(n, dtype=np.int64)
    value = np.zeros(n, dtype=np.int64)
    value[at] = low
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    plcp = np.maximum(value[start] - (np.arange(n) - start), 0)
    plcp[phi < 0] = 0
    return phi, np.minimum(plcp, cap)


def repeated_starts(s: np.ndarray, length: int) -> np.ndarray:
    """True where s[i:i + length] holds no GAP and starts elsewhere in s too."""
    out = np.zeros(len(s), dtype=bool)
    if len(s) < 2:
        return out
    phi, plcp = common_prefixes(s, suffix_array(s), length)
    at = np.flatnonzero(plcp >= length)
    # prefixes were compared by hashes: stretches of places whose other place moves along are confirmed byte by byte
    new = np.append(True, (np.diff(at) != 1) | (np.diff(phi[at]) != 1))[: len(at)]
    head, run = np.flatnonzero(new), np.cumsum(new) - 1
    size = np.diff(np.append(head, len(at))) + length - 1
    before = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(before, size)
    wrong = np.append(0, np.cumsum(s[np.repeat(at[head], size) + step] != s[np.repeat(phi[at[head]], size) + step]))
    own = before[run] + np.arange(len(at)) - head[run]
    at = at[wrong[own + length] == wrong[own]]
    out[at] = out[phi[at]] = True
    gaps = np.append(0, np.cumsum(s == GAP))
    at = np.flatnonzero(out)
    out[at] = gaps[np.minimum(at + length, len(s))] == gaps[at]
    return out


def repeated_codes(s: np.ndarray, length: int) -> np.ndarray:
    """Starts of the words' codes (first bytes of 64 or more) where s[i:i + length] holds no GAP and
    starts elsewhere in s too, by the hashes of these strings."""
    at = np.flatnonzero((s >= 64) & (s != GAP))
    gaps = np.append(0, np.cumsum(s == GAP))
    at = at[at + length <= len(s)]
    at = at[gaps[at + length] == gaps[at]]
    _, same, count = np.unique(tv.span_hash(tv.prefix_hash(s), at, at + length), return_inverse=True, return_counts=True)
    return at[count[same] > 1]


# -- Spark steps ------------------------------------------------------------------


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and two join keys without nulls; only rows equal in id and text share them."""
    return documents(docs, *more).withColumns({"k1": F.xxhash64("text"), "k2": F.coalesce("doc_id", F.lit(-(1 << 63)))})


def window_ranges(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, unit: int = 1, only: Broadcast | None = None) -> DataFrame:
    """(anchor, whole, k1, k2, span, owned, at): the ranges of window starts by anchor, span being the end of their
    bytes times 2^32 plus the first; `owned` the last and the first start likewise; `at` the anchor's place (here 0); `whole` is the hash of their bytes.
    Windows and anchors start at multiples of `unit` bytes, which all lengths are too."""
    w = (length - anchor) // unit + 1

    def each(batch):
        k1, k2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        for a, b, data, offs in tv.batches(batch.column(1)):
            n = len(data)
            if n < length:
                continue
            sums = tv.prefix_hash(data)
            at = np.arange(0, n - anchor + 1, unit)
            h = tv.span_hash(sums, at, at + anchor)
            padded = np.full(-(-len(h) // w) * w, ~np.uint64(0))
            padded[: len(h)] = h
            block = padded.reshape(-1, w)
            to = np.minimum.accumulate(block, axis=1).ravel()
            back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
            least = np.minimum(back[: len(h) - w + 1], to[w - 1 : len(h)])
            owner = np.repeat(np.arange(b - a), np.diff(offs) // unit)[: (n - length) // unit + 1]
            starts = np.flatnonzero(np.arange(len(owner)) * unit + length <= offs[owner + 1])
            if not len(starts):
                continue
            v, d = least[starts], owner[starts]
            new = np.ones(len(starts), dtype=bool)
            # a window names the leftmost occurrence of its least hash: once that is passed, another range begins
            new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1]) | (h[starts[1:] - 1] == v[1:])
            first = np.flatnonzero(new)
            lo, hi = starts[first] * unit, starts[np.append(first[1:], len(starts)) - 1] * unit
            if only is not None:
                some = only.value.has(v[first].view(np.int64))
                first, lo, hi = first[some], lo[some], hi[some]
            whole = tv.span_hash(sums, lo, hi + length)
            d = d[first]
            yield pa.record_batch([pa.array(v[first].view(np.int64)), pa.array(whole.view(np.int64)), pa.array(k1[a + d]), pa.array(k2[a + d]), pa.array(lo - offs[d] + ((hi + length - offs[d]) << 32)), pa.array(lo - offs[d] + ((hi - offs[d]) << 32)), pa.array(np.zeros(len(d), np.int32))], ["anchor", "whole", "k1", "k2", "span", "owned", "at"])

    return arrow_stage(_keyed(docs), each, RANGES)


@dataclass(frozen=True)
class Rules:
    """Strings of `length` bytes and runs of `words` words that repeat byte by byte."""

    length: int = LENGTH
    anchor: int = ANCHOR
    words: int = RUN_WORDS
    anchor_words: int = ANCHOR_WORDS

    @property
    def gap(self) -> int:
        return (self.length - self.anchor) // 4

    @property
    def lead(self) -> int:
        """Bytes from a string's start to where its host may stand: whether a place is a start shows in so many bytes before it."""
        return self.gap + 4

    @property
    def host(self) -> int:
        return self.length - 2 * self.gap - 8

    @property
    def host_words(self) -> int:
        return self.words * 4 // 5


def starts_of(data: np.ndarray, offs: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, words' starts, words' ends, first word of each text): the words' starts, and every byte
    that no word's start stands within `gap` bytes before."""
    ws, we, first = word_places(data, offs)
    at = np.arange(len(data))
    is_word = np.zeros(len(data), dtype=bool)
    is_word[ws] = True
    last = np.maximum.accumulate(np.where(is_word, at, -gap - 1)) if len(data) else at
    dense = (at - last > gap) & (at - np.repeat(offs[:-1], np.diff(offs)) >= gap)
    return np.flatnonzero(is_word | dense), ws, we, first


def hosted_ranges(docs: DataFrame, rules: Rules, only: Broadcast | None = None) -> DataFrame:
    """As `window_ranges`, for both rules at once. Each string of bytes has a host, the first start (of
    `starts_of`) from `lead` bytes on, and each run of words its first word. A host stands for four fifths
    of the run's words, or the bytes that all its strings have, whichever is shorter, and names the smallest hash
    among the anchors in there: so many words, or bytes, from a start."""
    r = rules
    aw = max(r.anchor_words * 3 // 4, 1)

    def each(batch):
        k1, k2 = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        for a, _, data, offs in tv.batches(batch.column(1)):
            s, ws, we, first = starts_of(data, offs, r.gap)
            if not len(s):
                continue
            d = np.searchsorted(offs, s, side="right") - 1
            stop = offs[d + 1]
            nth = np.searchsorted(ws, s)
            far = np.int64(1) << 62

            def word_end(k, count):
                at = k + count - 1
                return np.where(at < first[d + 1], we[np.minimum(at, len(we) - 1)] if len(we) else far, far)

            gram = np.minimum(np.minimum(word_end(nth, aw), s + r.anchor), stop + 1)
            end = np.minimum(word_end(nth, r.host_words), s + r.host)
            sums = tv.prefix_hash(data)
            h = tv.span_hash(sums, s, np.minimum(gram, stop))
            to = np.searchsorted(gram, end, side="right") - 1
            at = np.arange(len(s))
            fine = np.flatnonzero((end <= stop) & (to >= at))
            if not len(fine):
                continue
            # place of the least hash between a host and its last anchor (the leftmost), by two overlapping powers of two
            size = to[fine] - fine + 1
            level = np.frexp(size.astype(np.float64))[1] - 1
            least, row = np.empty(len(fine), np.int64), at
            lower = lambda i, j: np.where(h[j] < h[i], j, i)
            for x in range(int(level.max()) + 1):
                mine = fine[level == x]
                least[level == x] = lower(row[mine], row[to[mine] - (1 << x) + 1])
                row = lower(row[: len(row) - (1 << x)], row[1 << x :]) if len(row) > 1 << x else row
            new = np.ones(len(fine), dtype=bool)
            new[1:] = (least[1:] != least[:-1]) | (d[fine[1:]] != d[fine[:-1]]) | (fine[1:] != fine[:-1] + 1)
            i = np.flatnonzero(new)
            x, z = fine[i], fine[np.append(i[1:], len(fine)) - 1]
            if only is not None:
                some = only.value.has(h[least[i]].view(np.int64))
                i, x, z = i[some], x[some], z[some]
            o = d[x]
            before = np.where((x > 0) & (d[np.maximum(x - 1, 0)] == o), s[np.maximum(x - 1, 0)] - r.lead + 1, 0)
            lo = np.maximum(before, offs[o])
            run = np.where(ws[np.minimum(nth[z], max(len(ws) - 1, 0))] == s[z], nth[z], nth[z] - 1) if len(ws) else nth[z]
            run = np.minimum(run, first[o + 1] - r.words)  # the last host may stand behind the text's last run
            run_at = run + r.words - 1
            run_end = np.where((run >= first[o]) & (run_at < first[o + 1]), we[np.minimum(run_at, max(len(we) - 1, 0))] if len(we) else 0, 0)
            hi = np.minimum(np.maximum(s[z] - r.lead + r.length, run_end + 1), offs[o + 1])
            whole = tv.span_hash(sums, lo, hi)
            base = offs[o]
            yield pa.record_batch([
                pa.array(h[least[i]].view(np.int64)), pa.array(whole.view(np.int64)), pa.array(k1[a + o]), pa.array(k2[a + o]),
                pa.array(lo - base + ((hi - base) << 32)), pa.array(s[x] - base + ((s[z] - base) << 32)), pa.array((s[least[i]] - base).astype(np.int32)),
            ], ["anchor", "whole", "k1", "k2", "span", "owned", "at"])

    return arrow_stage(_keyed(docs), each, RANGES)


def _may_repeat(data: np.ndarray, offs: np.ndarray, at: np.ndarray, rules: Rules) -> np.ndarray:
    """True for ranges that may share a string of `length` bytes with another: of the bytes around their anchors at least all but a
    step's, at one of the steps, are the same. `at` is the anchor's place in the range."""
    step = max((rules.length - rules.anchor) // 8, 1)
    sums, out = tv.prefix_hash(data), np.zeros(len(at), dtype=bool)
    for left in range(0, rules.length, step):
        a, b = offs[:-1] + at - left, offs[:-1] + at + max(rules.length - left - step, 1)
        some = np.flatnonzero((a >= offs[:-1]) & (b <= offs[1:]))
        _, same, count = np.unique(tv.span_hash(sums, a[some], b[some]), return_inverse=True, return_counts=True)
        out[some] |= count[same] > 1
    return out


def hosted_repeats(data: np.ndarray, offs: np.ndarray, lo: np.ndarray, x: np.ndarray, z: np.ndarray, at: np.ndarray, tail: np.ndarray, rules: Rules) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """[(range, start, end, kind)] of what repeats among ranges: strings of bytes (kind 1) and runs of words (2).
    Each place of a text counts once, in the range whose hosts own it. `tail` marks ranges that end their text."""
    out = []
    mine = np.flatnonzero(_may_repeat(data, offs, at - lo, rules))
    if len(mine):
        # what lies behind the last string that a range owns must not be found there again
        n = np.minimum(np.diff(offs)[mine], np.maximum(z[mine] - rules.lead - lo[mine] + rules.length, 0))
        head = np.append(0, np.cumsum(n + 1))[:-1]
        s = np.full(int((n + 1).sum()), GAP, dtype=np.uint8)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        s[np.repeat(head, n) + place] = data[np.repeat(offs[:-1][mine], n) + place]
        hit = np.flatnonzero(repeated_starts(s, rules.length))
        own = np.searchsorted(head, hit, side="right") - 1
        new = np.ones(len(hit), dtype=bool)
        new[1:] = (np.diff(hit) != 1) | (np.diff(own) != 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hit))[: len(first)] - 1
        o = mine[own[first]]
        start = hit[first] - head[own[first]] + lo[o]
        out.append((o, start, start + (hit[last] - hit[first]) + rules.length, 1))
    n = np.diff(offs)
    ws, we, word = word_places(data, offs)
    at = np.arange(len(ws))
    o = np.repeat(np.arange(len(n)), np.diff(word))
    whole = at + rules.words <= word[o + 1]
    at, o = at[whole], o[whole]
    a, b = ws[at] - offs[o] + lo[o], we[at + rules.words - 1] if len(at) else at
    fine = (a >= x[o]) & (a <= z[o]) & ((b < offs[o + 1]) | tail[o])
    o, a, b, at = o[fine], a[fine], b[fine], at[fine]
    if len(at):
        _, same, count = np.unique(tv.span_hash(tv.prefix_hash(data), ws[at], b), return_inverse=True, return_counts=True)
        some = count[same] > 1
        out.append((o[some], a[some], (b - offs[o] + lo[o])[some], 2))
    return out


def _shards(docs: DataFrame, wanted: DataFrame, search) -> DataFrame:
    """(k1, k2, start, end, kind) of repeats among the ranges `wanted` (anchor, i, j, own, k1, k2, span, owned, at);
    `search` finds them among a shard's (bytes, offsets, lo, first owned, last owned, anchor's place, whether a range ends its text)."""
    lists = cut(wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "i", "j", "own", "span", "owned", "at")).alias("ranges")))
    key = F.xxhash64("k1", "k2")
    rows = _keyed(docs).where(within(key_filter(lists.select(key.alias("key"))), key)).dropDuplicates(["k1", "k2"]).join(lists, ["k1", "k2"])
    rows = rows.select("k1", "k2", F.col("text").cast("binary").alias("text"), F.explode("ranges").alias("r"))
    lo, hi = F.col("r.span").bitwiseAND(0xFFFFFFFF).cast("int"), F.shiftright("r.span", 32).cast("int")
    ranges = rows.select("k1", "k2", "r.anchor", "r.i", "r.j", "r.owned", "r.at", lo.alias("lo"), (hi == F.octet_length("text")).alias("tail"), F.substring("text", lo + 1, hi - lo).alias("bytes"))

    def each(it):
        held: list[pa.RecordBatch] = []
        size, key = 0, None

        def finish():
            t = pa.Table.from_batches(held).combine_chunks()
            data, offs = tv.byte_arrays(t.column("bytes"))
            owned, k1, k2 = (t.column(c).to_numpy() for c in ("owned", "k1", "k2"))
            for o, start, end, kind in search(data, offs, t.column("lo").to_numpy().astype(np.int64), owned & 0xFFFFFFFF, owned >> 32, t.column("at").to_numpy().astype(np.int64), t.column("tail").to_numpy()):
                yield pa.record_batch([pa.array(k1[o]), pa.array(k2[o]), pa.array(start), pa.array(end), pa.array(np.full(len(o), kind, np.int32))], ["k1", "k2", "start", "end", "kind"])

        for batch in it:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("anchor", "i", "j")])
            ends = [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            a = 0
            for b in ends:
                now = tuple(keys[:, a])
                # two pairs of one anchor share ranges, which must not meet themselves
                if held and now != key and (size > SHARD_BYTES or now[0] == key[0]):
                    yield from finish()
                    held, size = [], 0
                key = now
                part = batch.slice(a, b - a)
                held.append(part)
                size += len(tv.byte_arrays(part.column("bytes"))[0])
                a = b
        if held:
            yield from finish()

    ordered = ranges.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return ordered.mapInArrow(released(each), "k1 long, k2 long, start long, end long, kind int")


def _window_search(length: int, unit: int):
    def search(data, offs, lo, x, z, at, tail):
        n = np.diff(offs)
        s = np.full(len(data) + len(n), GAP, dtype=np.uint8)
        head = offs[:-1] + np.arange(len(n))
        s[np.arange(len(data)) + np.repeat(np.arange(len(n)), n)] = data
        hit = np.flatnonzero(repeated_starts(s, length)) if unit == 1 else repeated_codes(s, length)
        own = np.searchsorted(head, hit, side="right") - 1
        new = np.ones(len(hit), dtype=bool)
        new[1:] = (np.diff(hit) != unit) | (np.diff(own) != 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(hit))[: len(first)] - 1
        o = own[first]
        start = hit[first] - head[o] + lo[o]
        return [(o, start, start + (hit[last] - hit[first]) + length, 1)]

    return search


def spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, unit: int = 1) -> DataFrame:
    """(k1, k2, spans array<struct<start, end, kind>>): the repeats of each text, not yet merged."""
    return _repeats(docs, lambda only: window_ranges(docs, length, anchor, unit, only), _window_search(length, unit))


def _repeats(docs: DataFrame, found: Callable[[Broadcast | None], DataFrame], search) -> DataFrame:
    """As `spans`, of ranges (whose anchors a filter may hold) and a search: ranges whose bytes are equal as
    a whole (kind 0) and what the search finds among the others that name the same anchor."""
    several = key_filter(cut(found(None).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")))
    ranges = cut(found(several))
    classes = cut(ranges.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "span", "owned", "at")).alias("one")))
    shape = classes.groupBy("anchor").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("least = 1 and m > 1")
    shape = cut(shape.select("anchor", "m", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int").alias("g")))
    open_ = join_heavy(classes, shape, ["anchor"], "m").withColumn("own", F.pmod(F.xxhash64("whole"), F.col("g")).cast("int"))
    open_ = open_.select("anchor", "own", "one.*", F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j")))).alias("p"))
    part = _shards(docs, open_.select("anchor", "p.i", "p.j", "own", "k1", "k2", "span", "owned", "at"), search)
    whole = join_heavy(ranges.select("anchor", "whole", "k1", "k2", "span"), classes.where("n > 1").select("anchor", "whole", "n"), ["anchor", "whole"], "n")
    whole = whole.select("k1", "k2", F.col("span").bitwiseAND(0xFFFFFFFF).alias("start"), F.shiftright("span", 32).alias("end"), F.lit(0).alias("kind"))
    return part.unionByName(whole).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans"))


def _merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of overlapping or touching [start, end) rows, in order."""
    spans = spans[:, :2]
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > top[:-1])
    return np.stack([spans[new, 0], top[np.append(np.flatnonzero(new)[1:], len(spans)) - 1]], axis=1)


def deduplicate(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary, removed array<struct<start, end>>, *keep)
    of every document.

    Each byte under a string of `length` bytes that also starts anywhere else, in this
    text or another, is removed; texts are judged as given, and rows equal in id and text are
    repeats of each other. Null and empty texts lose nothing, neither do texts under `length`
    bytes. An empty table gives an empty result; further columns are passed on only if named in `keep`."""
    rows = _keyed(docs, *keep).join(spans(docs, length, anchor), ["k1", "k2"], "left").select("doc_id", "text", "spans", *keep)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def each(batch):
        lists = batch.column(2)
        flat = lists.flatten()
        both = np.stack([flat.field("start").to_numpy(zero_copy_only=False), flat.field("end").to_numpy(zero_copy_only=False)], axis=1) if len(flat) else np.zeros((0, 2), np.int64)
        counts = np.array([x or 0 for x in lists.value_lengths().to_pylist()], dtype=np.int64)
        at = np.append(0, np.cumsum(counts))
        data, offs = tv.byte_arrays(batch.column(1))
        out: list[tuple] = []
        for i in range(batch.num_rows):
            text = data[offs[i] : offs[i + 1]]
            gone = _merged(both[at[i] : at[i + 1]])
            if len(gone):
                stays = np.ones(len(text), dtype=bool)
                for a, b in gone.tolist():
                    stays[a:b] = False
                kept = text[stays].tobytes()
            else:
                kept = text.tobytes()
            out.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in gone.tolist()]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), kind]
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)), *batch.columns[3:]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed", *keep])

    types = dict(docs.dtypes)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, removed array<struct<start:long,end:long>>"
    return arrow_stage(rows, each, ", ".join([schema, *(f"`{c}` {types[c]}" for c in keep)]))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """([start, end, kind] rows, first row of each list) of a column of spans."""
    flat = column.flatten()
    rows = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end", "kind")], axis=1) if len(flat) else np.zeros((0, 3), np.int64)
    return rows, np.append(0, np.cumsum([x or 0 for x in column.value_lengths().to_pylist()])).astype(np.int64)


def deduplicate_both(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, n_words, n_words_removed) of every document.

    The first five are those of `deduplicate` with the rules' length. A run of `rules.words` words (see `word_places`;
    here with the white space between them) that stands anywhere else too is a repeat as well: `text`
    is what stays without both, a run going with the white space behind it; characters cut in two become U+FFFD.
    Rows equal in id and text are repeats of each other. Null and empty texts lose nothing. An empty table
    gives an empty result; further columns are ignored."""
    found = _repeats(docs, lambda only: hosted_ranges(docs, rules, only), lambda *shard: hosted_repeats(*shard, rules))
    key = F.xxhash64("k1", "k2")
    found = cut(found)
    some = key_filter(found.select(key.alias("key")))
    keyed = _keyed(docs).withColumn("some", within(some, key))
    # texts without repeats stay where they are
    rows = keyed.where("some").join(found, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    rows = rows.unionByName(keyed.where("not some").select("doc_id", "text", F.lit(None).cast(found.schema["spans"].dataType).alias("spans")))

    def each(batch):
        both, at = _lists(batch.column(2))
        out: list[tuple] = []
        for a, b, data, offs in tv.batches(batch.column(1)):
            ws, we, first = word_places(data, offs)
            for i in range(b - a):
                text, mine = data[offs[i] : offs[i + 1]], both[at[a + i] : at[a + i + 1]]
                words = int(first[i + 1] - first[i])
                if not len(mine):
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), text.tobytes().decode("utf-8", "replace"), words, 0))
                    continue
                size, kind = mine[:, 1] - mine[:, 0], mine[:, 2]
                gone = _merged(mine[(kind == 1) | ((kind == 0) & (size >= rules.length))])
                stays = np.ones(len(text), dtype=bool)
                for x, y in gone.tolist():
                    stays[x:y] = False
                kept = text[stays].tobytes()
                begin, end = ws[first[i] : first[i + 1]] - offs[i], we[first[i] : first[i + 1]] - offs[i]
                inside = mine[kind != 1]
                lo = np.searchsorted(begin, inside[:, 0] + ((inside[:, 2] == 0) & (inside[:, 0] > 0)))
                hi = np.searchsorted(end, inside[:, 1] - ((inside[:, 2] == 0) & (inside[:, 1] < len(text))), side="right")
                runs = _merged(np.stack([lo, hi], axis=1)[hi - lo >= rules.words])
                edges = np.append(begin, len(text))
                for x, y in runs.tolist():
                    stays[edges[x] : edges[y]] = False
                removed = int((runs[:, 1] - runs[:, 0]).sum()) if len(runs) else 0
                out.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), text[stays].tobytes().decode("utf-8", "replace"), words, removed))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "n_words", "n_words_removed"])

    return arrow_stage(rows, each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, n_words long, n_words_removed long")


# -- runs of words ------------------------------------------------------------------


def word_places(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words: runs without white space; as scripts without spaces
    have none, every kana, ideograph and Thai or Lao letter is a word too."""
    if not len(data):
        return tv.words(data, offs, tv.NOT_SPACE)
    inside = tv.NOT_SPACE[data]
    alone = (data >= 0xE3) & (data <= 0xE9)
    alone[:-1] |= (data[:-1] == 0xE0) & (data[1:] >= 0xB8) & (data[1:] <= 0xBB)
    new = alone.copy()
    new[0] = new[offs[offs < len(data)]] = True
    new[1:] |= ~inside[:-1]
    new[3:] |= alone[:-3]
    starts = np.flatnonzero(inside & new)
    stop = ~inside | new
    ends = np.append(np.flatnonzero(stop), len(data))
    return starts, ends[np.searchsorted(ends, starts, side="right")], np.searchsorted(starts, offs)


def word_codes(column: pa.Array) -> pa.Array:
    """Each text as its words' codes: 36 bits of a word's hash, six to a byte; only a code's first byte is 64 or more."""
    out = []
    for a, b, data, offs in tv.batches(column):
        starts, ends, first = word_places(data, offs)
        h = tv.span_hash(tv.prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        codes = ((h[:, None] >> (np.arange(CODE, dtype=np.uint64) * np.uint64(6))) & np.uint64(63)).astype(np.uint8)
        codes[:, 0] += 64
        out.append(pa.Array.from_buffers(pa.large_string(), b - a, [None, pa.py_buffer((first * CODE).astype(np.int64)), pa.py_buffer(codes.tobytes())]))
    return pa.concat_arrays(out).cast(pa.string()) if out else pa.array([], pa.string())


def _both_repeats(docs: DataFrame, coded: DataFrame, length: int | None, unit_length: int, anchor: int) -> DataFrame:
    """(k1, k2, spans, wide) of the texts (by their own keys) that have runs of words, or repeats of `length` bytes. Only keys
    and places are joined here; `coded` has (doc_id, text, own), the words' codes and the key of the text itself."""
    found = cut(spans(coded.select("doc_id", "text"), unit_length, anchor, CODE))
    key = F.xxhash64("k1", "k2")
    names = _keyed(coded, "own").where(within(key_filter(found.select(key.alias("key"))), key)).select("k1", "k2", "own").distinct()
    runs = names.join(found, ["k1", "k2"]).select(F.col("own").alias("k1"), "k2", "spans")
    if length is None:
        return cut(runs.withColumn("wide", F.lit(None).cast(found.schema["spans"].dataType)))
    return cut(runs.join(spans(docs, length, min(ANCHOR, length // 2)).withColumnRenamed("spans", "wide"), ["k1", "k2"], "full"))


def deduplicate_words(docs: DataFrame, words: int = RUN_WORDS, anchor: int = ANCHOR_WORDS, keep: tuple[str, ...] = (), length: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept binary, *keep) of every document.

    Each word in a run of `words` words that also starts anywhere else, in this text or another,
    is removed with the white space up to the next word; words compare byte by byte, white
    space between them does not count. Rows equal in id and words are repeats of each other. With `length`,
    each byte under a string of so many bytes that also starts anywhere else goes too, as in `deduplicate`; both are judged on
    the texts as given. Null and empty texts lose nothing."""
    types = dict(docs.dtypes)
    more = [f"`{c}` {types[c]}" for c in keep]

    def code(batch):
        yield pa.record_batch([batch.column(0), batch.column(2), word_codes(batch.column(1))], ["doc_id", "own", "text"])

    coded = arrow_stage(documents(docs).withColumn("own", F.xxhash64("text")), code, "doc_id long, own long, text string")
    found = _both_repeats(docs, coded, length, words * CODE, anchor * CODE)
    key = F.xxhash64("k1", "k2")
    keyed = _keyed(docs, *keep).withColumn("__some", within(key_filter(found.select(key.alias("key"))), key))
    lists = [found.schema[c].dataType for c in ("spans", "wide")]
    # texts without repeats stay where they are
    rows = keyed.where("__some").join(found, ["k1", "k2"], "left").select("doc_id", "text", "spans", "wide", *keep)
    rows = rows.unionByName(keyed.where("not __some").select("doc_id", "text", *(F.lit(None).cast(t).alias(c) for c, t in zip(("spans", "wide"), lists, strict=True)), *keep))

    def each(batch):
        both, at = _lists(batch.column(2))
        both = both[:, :2] // CODE
        wide, wide_at = _lists(batch.column(3))
        out: list[tuple] = []
        for a, b, data, offs in tv.batches(batch.column(1)):
            starts, _, first = word_places(data, offs)
            for i in range(b - a):
                text, place = data[offs[i] : offs[i + 1]], starts[first[i] : first[i + 1]] - offs[i]
                gone = _merged(both[at[a + i] : at[a + i + 1]])
                cuts = _merged(wide[wide_at[a + i] : wide_at[a + i + 1]])
                if len(gone) or len(cuts):
                    place = np.append(place, len(text))
                    stays = np.ones(len(text), dtype=bool)
                    for x, y in [*((place[x], place[y]) for x, y in gone.tolist()), *cuts.tolist()]:
                        stays[x:y] = False
                    text = text[stays]
                out.append((int(first[i + 1] - first[i]), int((gone[:, 1] - gone[:, 0]).sum()) if len(gone) else 0, text.tobytes()))
        yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.binary()], strict=True)), *batch.columns[4:]], ["doc_id", "n_words", "n_removed", "kept", *keep])

    return arrow_stage(rows, each, ", ".join(["doc_id long, n_words long, n_removed long, kept binary", *more]))
