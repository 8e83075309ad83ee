"""Language-model scores by logistic context mixing.

A text is a stream of units: a word (possibly empty) and the white space or end that closes it.
A unit is coded as binary decisions, each predicted by several hashed contexts whose log-odds
a mixer adds with weights from a gate (how much evidence there is, and which decision it is); an
adaptive table then refines the mixed probability. There are two such models:

* `Flow` codes, text by text, each word's class (8 bits, a fixed function of its spelling) and its
  shape (4 bits: letter case and what closes it) in contexts of the words before: one class, two
  classes, the last two short words, the style of the last two dozen words. It learns online, in one
  pass over all training rows: predict, correct the weights, then count.
* `Spelling` codes a word's bytes given its class: contexts of the last one to five bytes and of the place, and the whole
  class and word so far. The latter are exact counts over the whole training vocabulary, which is a distributed
  table that grows with the corpus: the words stand sorted in blocks, so that all but the prefixes at a
  block's edges (the spanning ones, counted apart) are counted inside their block.

The vocabulary also holds the exact token counts of the base score. The most frequent words (a
bounded number) travel to all tasks; for the others each text sends a word's hash and its number to
the vocabulary and sums come back by text, keyed by content. Texts are not moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .spark_io import arrow_stage, cut, documents, released

#: Logarithms of the count tables' sizes: contexts of earlier words; last one to five bytes of the word, place.
FLOW_BITS, SPELLING_BITS = (18, 20, 20, 18), (16, 18, 19, 20, 20, 18)
#: Predictor whose counts are the gate's evidence.
FLOW_LEAD, SPELLING_LEAD = 1, len(SPELLING_BITS)
#: Count added to either bit (of the lead's counts), rate of learning, what it keeps of its curvature, largest step, gates (evidence x decision), buckets of the refining table.
SMOOTH, RATE, MEMORY, LARGEST, GATES, REFINE = (0.05, 0.02), 0.6, 0.99, 0.1, (14, 4), 33
#: Decisions of a step of learning, slots of a block of the tables that travels, words that travel to all tasks at most, distinct words a task of the scan holds, words of a block.
STEP, BLOCK, HEAD, HELD, BLOCK_WORDS = 1 << 13, 1 << 12, 1 << 17, 1 << 19, 1 << 17
END = 0xFF

# -- units -----------------------------------------------------------------------------

#: Kind of a word's last byte: letter, digit, stop, other.
ENDING = np.full(256, 3, dtype=np.int64)
ENDING[0x61:0x7B] = ENDING[0x80:] = 0
ENDING[0x30:0x3A] = 1
ENDING[list(b".,;:!?")] = 2
SHORT, SHORT_CLASSES, MODE_WORDS = 3, 159, 24


@dataclass
class Units:
    low: np.ndarray  # lower-cased bytes with end marks
    starts: np.ndarray  # of the word
    ends: np.ndarray  # place of what closes it
    first: np.ndarray  # first unit of each text, and the number of units
    owner: np.ndarray  # text of each unit
    word: np.ndarray  # 64-bit hash of the lower-cased word
    cls: np.ndarray
    shape: np.ndarray
    extra: np.ndarray  # log10 probability of what class, shape and lower-cased word leave open


def word_class(size: np.ndarray, head: np.ndarray, last: np.ndarray, word: np.ndarray, script: np.ndarray) -> np.ndarray:
    """0 for no word, 1 to 159 by hash for words of up to three bytes, 160 to 255 by script, ending, length and first byte."""
    long = 160 + script * 32 + ENDING[last] * 8 + np.searchsorted([7, 10, 15], size, side="right") * 2 + (ENDING[head] == 0)
    return np.where(size == 0, 0, np.where(size <= SHORT, 1 + (word % np.uint64(SHORT_CLASSES)).astype(np.int64), long))


def _counter(flags: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(flags))


def _counted(a: np.ndarray, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes of each word have flag a, and flag b."""
    both = _counter(a + (b.astype(np.int64) << 32))
    n = both[ends] - both[starts]
    return n & 0xFFFFFFFF, n >> 32


def units(data: np.ndarray, offs: np.ndarray) -> Units:
    n = len(offs) - 1
    full = np.insert(data, offs[1:], END)
    ends = np.flatnonzero(~tv.NOT_SPACE[full] | (full == END))
    starts = np.append(0, ends[:-1] + 1)
    first = np.searchsorted(starts, offs + np.arange(n + 1))
    low = tv.LOWER[full]
    word = tv.span_hash(tv.prefix_hash(low), starts, ends)
    size = ends - starts
    caps, letters = _counted(full != low, (low >= 97) & (low <= 122), starts, ends)
    begins = (full[starts] >= 65) & (full[starts] <= 90)
    case = np.where(caps == 0, 0, np.where((caps == 1) & begins, 1, np.where(caps == letters, 2, 3)))
    close = full[ends]
    close = np.where(close == 0x20, 0, np.where(close == 10, 1, np.where(close == END, 2, 3)))
    # tab, vertical tab, form feed or return; the case of each letter
    extra = np.where(close == 3, -np.log10(4), 0) - np.where(case == 3, letters * np.log10(2), 0)
    beyond, latin = _counted((low >= 0x80) & (low != END), low == 0xC3, starts, ends)
    script = np.where(beyond == 0, 0, np.where(latin > 0, 1, 2))
    cls = word_class(size, low[starts], low[np.maximum(ends - 1, starts)], word, script)
    return Units(low, starts, ends, first, np.repeat(np.arange(n), np.diff(first)), word, cls, case * 4 + close, extra)


def _before(x: np.ndarray, place: np.ndarray, k: int, fill: int) -> np.ndarray:
    """x of the unit k places before in the same text."""
    out = np.full(len(x), fill, dtype=np.int64)
    out[k:] = x[: max(len(x) - k, 0)]
    out[place < k] = fill
    return out


def flow_contexts(u: Units) -> tuple[list[np.ndarray], ...]:
    """Hashes of the contexts of each unit's class, and of its shape (which knows the class)."""
    m = len(u.cls)
    at = np.arange(m)
    begin = u.first[:-1][u.owner]
    place = at - begin
    p1, p2 = _before(u.cls, place, 1, 256), _before(u.cls, place, 2, 256)
    s1, s2 = _before(u.shape, place, 1, 16), _before(u.shape, place, 2, 16)
    short = (u.cls > 0) & (u.cls <= SHORT_CLASSES)
    seen = np.append(-1, np.maximum.accumulate(np.where(short, at, -1))[:-1])
    near = np.where(seen >= begin, u.cls[np.maximum(seen, 0)], 256)
    earlier = np.where(seen >= begin, seen[np.maximum(seen, 0)], -1)
    far = np.where(earlier >= begin, u.cls[np.maximum(earlier, 0)], 256)
    mode = np.zeros(m, dtype=np.int64)
    for flag in (u.cls >= 192, u.shape >= 8, (u.cls >= 160) & ((u.cls - 160) % 32 >= 24)):
        total = _counter(flag)
        recent = total[at] - total[np.maximum(at - MODE_WORDS, begin)]
        mode = mode * 4 + (recent > 0) + (recent > 3) + (recent > 9)
    mode = mode * 2 + (place == 0)
    keys = [p1, p1 * 512 + p2, (near * 512 + far) * 2 + ((seen == at - 1) & (place > 0)), mode * 32 + s1]
    shaped = [u.cls * 32 + s1, s1 * 32 + s2, (p1 * 512 + u.cls) * 32 + s1, (mode * 32 + s1) * 256 + u.cls]
    return tuple([_short(tv.mix(k.astype(np.uint64) + np.uint64((i + start) << 40))) for i, k in enumerate(some)] for start, some in ((1, keys), (17, shaped)))


def _short(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


# -- the mixer -------------------------------------------------------------------------


@dataclass
class Mixer:
    bits: tuple[int, ...]
    inputs: int
    lead: int
    tables: list[np.ndarray] = field(default_factory=list)  # [slot, 2] counts
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # [gate, input + 1]
    refine: np.ndarray = field(default_factory=lambda: np.zeros(0))  # [gate, bucket, 2]

    def __post_init__(self) -> None:
        if not self.tables:
            self.tables = [np.zeros((1 << b, 2), np.float32) for b in self.bits]
        if not self.weights.size:
            self.weights = np.full((GATES[0] * GATES[1], self.inputs + 1), 0.25)
            self.weights[:, -1] = 0
            self.refine = np.zeros((len(self.weights), REFINE, 2))

    def slots(self, base: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
        add = node.astype(np.uint32) * np.uint32(0x3D4D51CB)
        return [((h ^ add) & np.uint32((1 << b) - 1)).astype(np.intp) for h, b in zip(base, self.bits, strict=True)]

    def stretched(self, slots: list[np.ndarray], step: np.ndarray | int, known: tuple | None = None, left_out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(inputs, gate) for a decision: log-odds of each predictor's counts (`known`: counts that are no table's);
        with the true bits given as `left_out`, one occurrence of each is left out of its counts."""
        x = np.empty((self.inputs + 1, len(slots[0])), dtype=np.float32)
        pairs = [(n.real, n.imag) for n in (t.view(np.complex64)[:, 0].take(s) for t, s in zip(self.tables, slots, strict=True))] + ([known] if known else [])
        total = None
        for i, (zero, one) in enumerate(pairs):
            if left_out is not None:
                one, zero = np.maximum(one - left_out, 0), np.maximum(zero - (1 - left_out), 0)
            a = np.float32(SMOOTH[i == self.lead])
            np.log((one + a) / (zero + a), out=x[i])
            if i == self.lead:
                total = zero + one
        x[-1] = 0.3
        return x, _gate(total, step)

    def frozen(self) -> Frozen:
        """To score with: log-odds instead of counts."""
        tables = []
        for i, t in enumerate(self.tables):
            a = np.float32(SMOOTH[i == self.lead])
            tables.append(np.log((t[:, 1] + a) / (t[:, 0] + a)))
        n = self.refine.reshape(-1, 2)
        lead = _gate(self.tables[self.lead].sum(axis=1), 0) if self.lead < len(self.tables) else None
        return Frozen(self.bits, self.inputs, self.lead, tables, lead, np.ascontiguousarray(self.weights.T.astype(np.float32)), n[:, 1].astype(np.float32), n.sum(axis=1).astype(np.float32))

    def correct(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray | None, curve: np.ndarray) -> None:
        """Moves the gates' weights along the gradient over the curvature seen so far, and the refining table."""
        order = np.argsort(gate, kind="stable")
        x, bit, gate = x[:, order], bit[order], gate[order]
        size = np.bincount(gate, minlength=len(self.weights))
        used = np.flatnonzero(size)
        at = np.append(0, np.cumsum(size[used]))
        w = self.weights.astype(np.float32)
        z = np.concatenate([w[g] @ x[:, a:b] for g, a, b in zip(used, at[:-1], at[1:], strict=True)])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        err, bend = bit - p, p * (1 - p)
        if weight is not None:
            weight = weight[order].astype(np.float32)
            err, bend = err * weight, bend * weight
        err, squares = err.astype(np.float32), x * x
        for g, a, b in zip(used, at[:-1], at[1:], strict=True):
            curve[g] += squares[:, a:b] @ bend[a:b]
            self.weights[g] += np.clip(RATE * (x[:, a:b] @ err[a:b]) / (curve[g] + 1), -LARGEST, LARGEST)
        self.refine += np.bincount((gate.astype(np.int64) * REFINE + _bucket(z)) * 2 + bit, weights=weight, minlength=self.refine.size).reshape(self.refine.shape)

    def own(self) -> Mixer:
        """With weights of its own, to learn; the tables are shared."""
        return Mixer(self.bits, self.inputs, self.lead, self.tables, self.weights.copy(), self.refine.copy())


def _bucket(z: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(z * 2) + REFINE // 2, 0, REFINE - 1).astype(np.int32)


def _gate(total: np.ndarray, step: np.ndarray | int) -> np.ndarray:
    return np.minimum(np.log2(total + np.float32(1)), GATES[0] - 1).astype(np.uint8) * np.uint8(GATES[1]) + np.asarray(step, np.uint8)


@dataclass
class Frozen:
    bits: tuple[int, ...]
    inputs: int
    lead: int
    tables: list[np.ndarray]  # log-odds of each slot
    gates: np.ndarray | None  # gate of the lead's slots, for the first step; none where the lead's counts come along
    weights: np.ndarray  # [input + 1, gate]
    ones: np.ndarray  # the refining table
    all: np.ndarray

    def log10(self, base: list[np.ndarray], node: np.ndarray, bit: np.ndarray, step: np.ndarray | int, known: tuple | None = None) -> np.ndarray:
        """log10 probability of each bit."""
        add = node.astype(np.uint32) * np.uint32(0x3D4D51CB)
        slots = [((h ^ add) & np.uint32((1 << b) - 1)).astype(np.intp) for h, b in zip(base, self.bits, strict=True)]
        gate = (_gate(known[0] + known[1], step) if known else self.gates.take(slots[self.lead]) + np.uint8(step)).astype(np.intp)
        z = self.weights[-1].take(gate) * np.float32(0.3)
        for i, s in enumerate(slots):
            z += self.tables[i].take(s) * self.weights[i].take(gate)
        if known:
            a = np.float32(SMOOTH[1])
            z += np.log((known[1] + a) / (known[0] + a)) * self.weights[self.lead].take(gate)
        z = np.clip(z, -16, 16)
        # of the true bit, so that single precision holds small probabilities
        p = 1 / (1 + np.exp(np.where(bit == 1, -z, z)))
        at = gate * REFINE + _bucket(z)
        n, one = self.all.take(at), self.ones.take(at)
        refined = (np.where(bit == 1, one, n - one) + 4 * p) / (n + 4)
        return np.log10(np.clip((p + refined) * np.float32(0.5), np.float32(1e-7), np.float32(1 - 1e-7)))


def flow_mixer() -> Mixer:
    return Mixer(FLOW_BITS, len(FLOW_BITS), FLOW_LEAD)


def spelling_mixer() -> Mixer:
    return Mixer(SPELLING_BITS, len(SPELLING_BITS) + 1, SPELLING_LEAD)


def _decisions(u: Units):
    """(contexts, node, bit, gate's step, units) of the decisions: eight of each unit's class, whether its shape is the
    usual one (small letters, a blank), and up to four where it is not."""
    by_class, by_shape = flow_contexts(u)
    every = np.arange(len(u.cls))
    for j in range(8):
        yield by_class, 1 << j | (u.cls >> (8 - j)), u.cls >> (7 - j) & 1, 0 if j < 2 else 1 if j < 5 else 2, every
    yield by_shape, np.full(len(every), 16), (u.shape != 0).astype(np.int64), 3, every
    for j in range(4):
        # after three zeros the last bit is known
        some = np.flatnonzero(u.shape != 0 if j < 3 else u.shape > 1)
        shape = u.shape[some]
        yield [h[some] for h in by_shape], 1 << j | (shape >> (4 - j)), shape >> (3 - j) & 1, 3, some


def flow_learn(m: Mixer, u: Units, curve: np.ndarray) -> None:
    """Online steps over some units: predict from the counts so far, correct, then count. All
    is counted, and the weights of every decision are corrected."""
    decisions = list(_decisions(u))
    for a in range(0, len(u.cls), STEP):
        for base, node, bit, step, some in decisions:
            x, y = np.searchsorted(some, (a, a + STEP))
            if x == y:
                continue
            slots = m.slots([h[x:y] for h in base], node[x:y])
            b = bit[x:y]
            x, gate = m.stretched(slots, step)
            m.correct(x, gate, b, None, curve)
            for t, s in zip(m.tables, slots, strict=True):
                np.add.at(t.reshape(-1), s * 2 + b, np.float32(1))
        curve *= MEMORY


def flow_log10(m: Frozen, u: Units) -> np.ndarray:
    """log10 probability of every unit's class, shape and what they leave open, the word apart."""
    total = u.extra.copy()
    for base, node, bit, step, some in _decisions(u):
        # in pieces that fit a core's cache
        for a in range(0, len(some), STEP):
            total[some[a : a + STEP]] += m.log10([h[a : a + STEP] for h in base], node[a : a + STEP], bit[a : a + STEP], step)
    return total


# -- spelling --------------------------------------------------------------------------


@dataclass
class Edges:
    """The distinct (class, word so far, next byte) of some words; a word's end is a byte too."""

    byte: np.ndarray
    base: list[np.ndarray]  # contexts of the tables
    node: np.ndarray  # hash of class and word so far
    place: np.ndarray
    back: np.ndarray  # edge of each byte
    owner: np.ndarray  # word of each byte
    at: np.ndarray  # first byte of each word


def edges(data: np.ndarray, offs: np.ndarray, cls: np.ndarray) -> Edges:
    n = len(cls)
    full = np.insert(data, offs[1:], END)
    starts = offs[:-1] + np.arange(n)
    owner = np.repeat(np.arange(n), np.diff(offs) + 1)
    place = np.arange(len(full)) - starts[owner]
    kind = tv.mix(cls.astype(np.uint64) + np.uint64(1))[owner]
    h, base = tv.mix(np.where(cls <= SHORT_CLASSES, 0, cls // 32).astype(np.uint64))[owner], []
    for k in range(1, 6):
        back = np.zeros(len(full), np.uint64)
        back[k:] = full[:-k]
        h = tv.mix(h * np.uint64(257) + np.where(place >= k, back + np.uint64(1), np.uint64(0)))
        base.append(h)
    # the last byte, the place and the class's length
    base.append(tv.mix(base[0] + (np.minimum(place, 15) * 512 + np.where(cls <= SHORT_CLASSES, 0, cls)[owner] + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    node = tv.mix(tv.span_hash(tv.prefix_hash(full), starts[owner], np.arange(len(full))) + kind)
    _, one, back = np.unique(tv.mix(node * np.uint64(263) + full + np.uint64(1)), return_index=True, return_inverse=True)
    return Edges(full[one].astype(np.int64), [_short(h[one]) for h in base], node[one], place[one], back, owner, starts)


def so_far_counts(e: Edges, weight: np.ndarray, spanning: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight bits, how often (0, 1) followed each edge's class, word and bits so far.
    `spanning` holds nodes whose counts go beyond these words: (node sorted, byte, count)."""
    nodes, byte, count = spanning
    mine = np.unique(e.node)
    lo, hi = np.searchsorted(nodes, mine), np.searchsorted(nodes, mine, side="right")
    wide = mine[hi > lo]
    picks = np.concatenate([np.arange(a, b) for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True)]) if len(wide) else np.zeros(0, np.int64)
    inside = ~np.isin(e.node, wide)
    node, sym = np.concatenate([e.node, nodes[picks]]), np.concatenate([e.byte, byte[picks]])
    w = np.concatenate([np.where(inside, weight, 0), count[picks]])
    order = np.lexsort((sym, node))
    node, sym, w = node[order], sym[order], w[order]
    edge = np.append(False, node[1:] != node[:-1])
    out = []
    for j in range(8):
        high = sym >> (8 - j)
        group = np.cumsum(edge | np.append(False, high[1:] != high[:-1]))
        bit = sym >> (7 - j) & 1
        zero, one = (np.bincount(group, weights=w * (bit == b), minlength=group[-1] + 1 if len(group) else 0) for b in (0, 1))
        pair = []
        for total in (zero, one):
            wide_out = np.empty(len(order), np.float32)
            wide_out[order] = total[group]
            pair.append(wide_out[: len(e.byte)])
        out.append((pair[0], pair[1]))
    return out


def _bit(byte: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    return 1 << j | (byte >> (8 - j)), byte >> (7 - j) & 1


def spelling_count(m: Mixer, e: Edges, weight: np.ndarray) -> None:
    for j in range(8):
        node, bit = _bit(e.byte, j)
        for t, s in zip(m.tables, m.slots(e.base, node), strict=True):
            np.add.at(t.reshape(-1), s * 2 + bit, weight.astype(np.float32))


def spelling_learn(m: Mixer, e: Edges, weight: np.ndarray, known: list, curve: np.ndarray) -> None:
    order = np.argsort(e.node * np.uint64(0x9E3779B97F4A7C15), kind="stable")
    order = order[weight[order] > 0]
    for a in range(0, len(order), STEP):
        mine = order[a : a + STEP]
        base, place, w = [h[mine] for h in e.base], np.minimum(e.place[mine], GATES[1] - 1), weight[mine]
        for j in range(8):
            node, bit = _bit(e.byte[mine], j)
            x, gate = m.stretched(m.slots(base, node), place, tuple(k[mine] for k in known[j]), bit)
            m.correct(x, gate, bit, w, curve)
        curve *= MEMORY


def spelling_log10(m: Frozen, e: Edges, known: list) -> np.ndarray:
    """log10 probability of every word, given its class."""
    if not len(e.at):
        return np.zeros(0)
    total = np.zeros(len(e.byte))
    place = np.minimum(e.place, GATES[1] - 1)
    for j in range(8):
        node, bit = _bit(e.byte, j)
        total += m.log10(e.base, node, bit, place, known[j])
    return np.add.reduceat(total[e.back], e.at)


# -- tables that tasks fill and the driver sums -----------------------------------------

PARTS = "kind int, at int, places binary, counts binary"


def _sent(m: Mixer, curve: np.ndarray | None, counts: bool) -> Iterator[pa.RecordBatch]:
    """A task's counts, block by block without zeros, and what it learned."""
    rows = []
    for i, table in enumerate(m.tables if counts else []):
        for at in range(0, len(table), BLOCK):
            part = table[at : at + BLOCK].reshape(-1)
            some = np.flatnonzero(part)
            if len(some):
                rows.append((i, at, some.astype(np.uint16).tobytes(), part[some].tobytes()))
    if curve is not None and curve.any():
        # a few dozen KB from each task, averaged in two levels
        rows.append((-1, TaskContext.get().partitionId() % 64, b"", np.concatenate([(m.weights * curve).ravel(), curve.ravel(), m.refine.ravel()]).tobytes()))
    for a in range(0, len(rows), 64):
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 64], strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "at", "places", "counts"])


def _summed(m: Mixer, parts: DataFrame) -> Mixer:
    """A mixer with the sum of the tasks' counts and the mean of their weights by curvature; tables are of fixed size."""
    size = 2 * m.weights.size + m.refine.size

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = None, None
        for batch in it:
            key = key or (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
            for places, counts in zip(batch.column(2), batch.column(3), strict=True):
                if key[0] < 0:
                    total = (0 if total is None else total) + np.frombuffer(counts.as_buffer(), np.float64)
                else:
                    total = np.zeros(2 * BLOCK) if total is None else total
                    total[np.frombuffer(places.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.float32)
        if key is not None:
            raw = total.tobytes() if key[0] < 0 else total.astype(np.float32).tobytes()
            yield pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([b""], pa.binary()), pa.array([raw], pa.binary())], ["kind", "at", "places", "counts"])

    out, learned = m.own(), np.zeros(size)
    out.tables = [t.copy() for t in m.tables]
    for batch in parts.groupBy("kind", "at").applyInArrow(add, PARTS).toArrow().to_batches():
        for kind, at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if kind < 0:
                learned += np.frombuffer(raw.as_buffer(), np.float64)
            else:
                part = np.frombuffer(raw.as_buffer(), np.float32).reshape(-1, 2)[: len(out.tables[kind]) - at]
                out.tables[kind][at : at + len(part)] = part
    n = out.weights.size
    weighted, curve = learned[:n].reshape(out.weights.shape), learned[n : 2 * n].reshape(out.weights.shape)
    out.weights = np.where(curve > 0, weighted / np.maximum(curve, 1e-300), out.weights)
    out.refine = learned[2 * n :].reshape(out.refine.shape).copy()
    return out


# -- Spark steps -----------------------------------------------------------------------


def learned_from(doc_id):
    """False for the held-out rows: crc32 of the id as text leaves 1 when divided by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) != 1, F.lit(True))


def _binary(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """data[lo:hi] as binary values."""
    size = hi - lo
    at = np.append(0, np.cumsum(size))
    flat = data[np.repeat(lo - at[:-1], size) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])


#: Leading bytes of class and word by which the vocabulary is cut; texts that the cuts are found from at most.
CUT_BYTES, CUT_TEXTS = 24, 2_000


def _leading(cls: np.ndarray, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Class and first bytes of the words data[lo:hi], in the order of class and word."""
    out = np.zeros((len(cls), CUT_BYTES), dtype=np.uint8)
    out[:, 0] = cls
    for k in range(CUT_BYTES - 1):
        at = np.flatnonzero(hi - lo > k)
        out[at, k + 1] = data[lo[at] + k]
    return out.view(f"S{CUT_BYTES}").ravel()


def _cuts(rows: DataFrame, texts: int) -> np.ndarray:
    """Where the sorted vocabulary is cut into parts, from the words of a bounded sample of texts: it only balances tasks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each(batch):
        for _, _, data, offs in tv.batches(batch.column(1)):
            u = units(data, offs)
            _, one = np.unique(u.word, return_index=True)
            one = one[(u.cls[one] > 0) & (u.word[one] % np.uint64(8) == 0)]
            yield pa.record_batch([_binary(u.low, u.starts[one], u.ends[one]), pa.array(u.cls[one].astype(np.int32))], ["word", "class"])

    sample = rows.sample(min(1.0, CUT_TEXTS / max(texts, 1)), seed=1) if texts > CUT_TEXTS else rows
    t = arrow_stage(sample, each, "word binary, class int").distinct().toArrow()
    data, offs = tv.byte_arrays(t.column("word"))
    keys = np.sort(_leading(t.column("class").to_numpy(), data, offs[:-1], offs[1:]))
    return np.unique(keys[np.linspace(0, len(keys) - 1, parts + 1).astype(int)[1:-1]]) if len(keys) else keys


def _vocabulary(rows: DataFrame, cuts: np.ndarray) -> DataFrame:
    """(part, class, word, n): the lower-cased words of (doc_id, text, train) and how often training rows have
    them, summed within a task as far as HELD words allow."""

    def merge(held: list) -> tuple:
        words = pa.concat_arrays([h[1] for h in held])
        _, one, back = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=True)
        n = np.bincount(back, weights=np.concatenate([h[3] for h in held])).astype(np.int64)
        return np.concatenate([h[0] for h in held])[one], words.take(pa.array(one)), np.concatenate([h[2] for h in held])[one], n

    def sent(held: tuple) -> pa.RecordBatch:
        _, words, cls, n = held
        data, offs = tv.byte_arrays(words)
        part = np.searchsorted(cuts, _leading(cls, data, offs[:-1], offs[1:]), side="right")
        return pa.record_batch([pa.array(part.astype(np.int32)), pa.array(cls), words, pa.array(n)], ["part", "class", "word", "n"])

    def each(it):
        held, size = [], 0
        for batch in it:
            train = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, data, offs in tv.batches(batch.column(1)):
                u = units(data, offs)
                word, one, back = np.unique(u.word, return_index=True, return_inverse=True)
                n = np.bincount(back, weights=train[a:b][u.owner], minlength=len(word))
                some = u.cls[one] > 0
                at = one[some]
                held.append((word[some], _binary(u.low, u.starts[at], u.ends[at]), u.cls[at].astype(np.int32), n[some]))
                size += len(at)
            if size > HELD:
                held = [merge(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield sent(held[0])
                    held, size = [], 0
        if size:
            yield sent(merge(held))

    return rows.mapInArrow(released(each), "part int, class int, word binary, n long")


BLOCKS = "class binary, ends binary, bytes binary, n binary"


def _blocks(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The distinct words of (part, class, word, n), sorted and packed some ten thousand to a row."""

    def pack(cls, data, offs, n):
        at = np.append(0, offs[1:]).astype(np.int32)
        return pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (cls.astype(np.uint8), at, data, n.astype(np.int64))], ["class", "ends", "bytes", "n"])

    def each(it):
        held, size = [], 0

        def merged(last: bool):
            """(whole block, words that may go on)"""
            t = pa.Table.from_batches(held).combine_chunks()
            data, offs = tv.byte_arrays(t.column("word"))
            h = tv.span_hash(tv.prefix_hash(data), offs[:-1], offs[1:])
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            n = np.add.reduceat(t.column("n").to_numpy(), first)
            stay = len(first) if last else len(first) - 1
            word = t.column("word").combine_chunks().take(pa.array(first[:stay]))
            data, offs = tv.byte_arrays(word)
            rest = t.slice(int(first[stay])).to_batches() if stay < len(first) else []
            return (pack(t.column("class").to_numpy()[first[:stay]], data, offs, n[:stay]) if stay else None), rest

        for batch in it:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows + batch.column(1).nbytes // 16
            if size >= block_words:
                out, held = merged(False)
                if out is not None:
                    yield out
                size = sum(b.num_rows for b in held)
        if held:
            yield merged(True)[0]

    return rows.repartitionByRange("class", "word").sortWithinPartitions("class", "word").mapInArrow(released(each), BLOCKS)


def _unpacked(batch: pa.RecordBatch):
    """(classes, bytes, offsets, counts) of each block of a batch."""
    for c, o, b, n in zip(*(batch.column(i) for i in range(4)), strict=True):
        yield np.frombuffer(c.as_buffer(), np.uint8).astype(np.int64), np.frombuffer(b.as_buffer(), np.uint8), np.frombuffer(o.as_buffer(), np.int32).astype(np.int64), np.frombuffer(n.as_buffer(), np.int64)


def _edge_blocks(batch: pa.RecordBatch):
    for cls, data, offs, n in _unpacked(batch):
        e = edges(data, offs, cls)
        yield data, offs, n, e, np.bincount(e.back, weights=n[e.owner], minlength=len(e.byte))


def _spanning(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, byte, count) of the prefixes that words of two blocks share: those on the path of a block's first and
    last word, a few for each block of BLOCK_WORDS words."""

    def each(batch):
        for _, offs, _, e, weight in _edge_blocks(batch):
            path = np.unique(np.concatenate([e.node[e.back[e.owner == w]] for w in (0, len(offs) - 2)]))
            some = np.flatnonzero(np.isin(e.node, path))
            block = np.full(len(some), e.node[e.back[-1]].view(np.int64))
            yield pa.record_batch([pa.array(e.node[some].view(np.int64)), pa.array(e.byte[some]), pa.array(weight[some]), pa.array(block)], ["node", "byte", "n", "block"])

    rows = arrow_stage(blocks, each, "node long, byte long, n double, block long")
    rows = cut(rows.groupBy("node", "byte").agg(F.sum("n").alias("n"), F.min("block").alias("a"), F.max("block").alias("z")))
    wide = rows.groupBy("node").agg(F.min("a").alias("a"), F.max("z").alias("z")).where("a != z").select("node")
    t = rows.join(wide, "node").select("node", "byte", "n").toArrow()
    node = t.column("node").to_numpy().view(np.uint64)
    order = np.lexsort((t.column("byte").to_numpy(), node))
    return node[order], t.column("byte").to_numpy()[order], t.column("n").to_numpy()[order]


def fit_flow(rows: DataFrame) -> Mixer:
    """Learns from the rows (doc_id, text, train) marked train."""

    def each(it):
        m = flow_mixer()
        curve = np.zeros(m.weights.shape)
        for batch in it:
            for _, _, data, offs in tv.batches(batch.column(1)):
                flow_learn(m, units(data, offs), curve)
        yield from _sent(m, curve, True)

    return _summed(flow_mixer(), rows.where("train").mapInArrow(released(each), PARTS))


def fit_spelling(blocks: DataFrame, spanning) -> Mixer:
    """Counts, then learns the weights online with each occurrence left out of the counts that predict it."""
    sc = blocks.sparkSession.sparkContext

    def count(it):
        m = spelling_mixer()
        for batch in it:
            for *_, e, weight in _edge_blocks(batch):
                spelling_count(m, e, weight)
        yield from _sent(m, None, True)

    counted = _summed(spelling_mixer(), blocks.mapInArrow(released(count), PARTS))
    counted.weights = spelling_mixer().weights
    shared, wide = sc.broadcast(counted), sc.broadcast(spanning)

    def learn(it):
        m = shared.value.own()
        curve = np.zeros(m.weights.shape)
        for batch in it:
            for *_, e, weight in _edge_blocks(batch):
                known = so_far_counts(e, weight, wide.value)
                for _ in range(2):
                    spelling_learn(m, e, weight, known, curve)
        yield from _sent(m, curve, False)

    learned = _summed(counted, blocks.mapInArrow(released(learn), PARTS))
    shared.unpersist()
    return learned


def _values(blocks: DataFrame, spelling, wide, least: int, head: bool) -> DataFrame:
    """(word hash, c, lp) of the words that occur `least` times or more (head), or of all others."""

    def each(batch):
        for data, offs, n, e, weight in _edge_blocks(batch):
            some = np.flatnonzero((n >= least) == head)
            lp = spelling_log10(spelling.value, e, so_far_counts(e, weight, wide.value)) if len(some) else np.zeros(len(n))
            word = tv.span_hash(tv.prefix_hash(data), offs[:-1], offs[1:]) if len(n) else np.zeros(0, np.uint64)
            yield pa.record_batch([pa.array(word[some].view(np.int64)), pa.array(n[some]), pa.array(lp[some])], ["word", "c", "lp"])

    return arrow_stage(blocks, each, "word long, c long, lp double")


def _tally(blocks: DataFrame) -> tuple[int, int, int]:
    """(training words, distinct ones, least count of the words that travel)."""

    def each(batch):
        for *_, n in _unpacked(batch):
            level, size = np.unique(np.log2(n[n > 0]) * 4 // 1, return_counts=True)
            total = np.bincount(np.searchsorted(level, np.log2(n[n > 0]) * 4 // 1), weights=n[n > 0], minlength=len(level))
            yield pa.record_batch([pa.array(level.astype(np.int32)), pa.array(size), pa.array(total.astype(np.int64))], ["level", "size", "total"])

    rows = sorted(arrow_stage(blocks, each, "level int, size long, total long").groupBy("level").agg(F.sum("size"), F.sum("total")).collect(), reverse=True)
    kept, least = 0, 1 << 62
    for level, size, _ in rows:
        kept += size
        if kept > HEAD:
            break
        least = int(np.ceil(2 ** (level / 4)))
    return sum(r[2] for r in rows), sum(r[1] for r in rows), least


@dataclass
class Model:
    flow: Frozen
    head: tuple[np.ndarray, np.ndarray, np.ndarray]  # hash sorted, count, log10 probability of the spelling
    texts: int  # training rows
    tokens: int  # of training rows, ends with them
    denominator: float
    base: np.ndarray  # log10 of the head's smoothed shares

    def look_up(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the head's words, whether it is one)"""
        at = np.minimum(np.searchsorted(self.head[0], word), max(len(self.head[0]) - 1, 0))
        return at, self.head[0][at] == word if len(self.head[0]) else np.zeros(len(word), dtype=bool)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every document.

    base_score is the sum of the tokens' smoothed unigram log10 probabilities; score is the model's log10
    probability of the text's bytes and its end. Null and empty texts have one token, their end.
    Repeated rows count as often as they stand; a null id is learned from. An empty table gives an
    empty result; further columns are ignored. Words are told apart by 64-bit hashes."""
    sc = docs.sparkSession.sparkContext
    rows = documents(docs).withColumn("train", learned_from(F.col("doc_id")))
    texts, every = rows.agg(F.coalesce(F.sum(F.col("train").cast("long")), F.lit(0)), F.count("*")).first()
    blocks = cut(_blocks(_vocabulary(rows, _cuts(rows, every))))
    tokens, distinct, least = _tally(blocks)
    n, v = tokens + texts, distinct + (texts > 0)
    spanning = _spanning(blocks)
    spelling, wide = sc.broadcast(fit_spelling(blocks, spanning).frozen()), sc.broadcast(spanning)
    t = _values(blocks, spelling, wide, least, True).toArrow()
    word = t.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    head = (word[order], t.column("c").to_numpy()[order], t.column("lp").to_numpy()[order])
    denominator = float(np.log10(n + 0.5 * (v + 1)))
    model = sc.broadcast(Model(fit_flow(rows).frozen(), head, texts, n, denominator, np.log10(head[1] + 0.5) - denominator))

    def near(batch):
        """What a text's classes, shapes and most frequent words give, and its other words with their numbers."""
        m = model.value
        for a, b, data, offs in tv.batches(batch.column(1)):
            u = units(data, offs)
            at, have = m.look_up(u.word)
            have &= u.cls > 0
            value = flow_log10(m.flow, u)
            base = np.zeros(len(value))
            known = have.copy()
            if len(m.head[0]):
                value += np.where(have, m.head[2][at], 0)
                base = np.where(have, m.base[at], 0)
                known &= m.head[1][at] > 0
            f = u.first[:-1]
            total = lambda x: np.add.reduceat(x, f)
            many = total((u.cls > 0).astype(np.int64))
            far = np.flatnonzero((u.cls > 0) & ~have)
            order = far[np.lexsort((u.word[far], u.owner[far]))]
            w, o = u.word[order], u.owner[order]
            new = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (o[1:] != o[:-1]))) if len(order) else order
            lists = pa.array(np.append(0, np.cumsum(np.bincount(o[new], minlength=b - a))).astype(np.int32))
            pairs = pa.StructArray.from_arrays([pa.array(w[new].view(np.int64)), pa.array(np.diff(np.append(new, len(order))).astype(np.int32))], ["word", "n"])
            yield pa.record_batch([
                *(batch.column(i).slice(a, b - a) for i in (0, 2, 3, 4)), pa.array(many + 1), pa.array(total(known.astype(np.int64)) + (m.texts > 0)), pa.array(many - total(have.astype(np.int64))),
                pa.array(total(base) + np.log10(m.texts + 0.5) - m.denominator), pa.array(total(value)), pa.array(np.diff(offs)), pa.ListArray.from_arrays(lists, pairs),
            ], ["doc_id", "k1", "k2", "train", "n_tokens", "n_known", "m", "base_score", "score", "size", "far"])

    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k2"), "train")
    own = cut(arrow_stage(keyed, near, "doc_id long, k1 long, k2 long, train boolean, n_tokens long, n_known long, m long, base_score double, score double, size long, far array<struct<word:long,n:int>>"))
    pairs = own.select("k1", "k2", F.explode("far").alias("p")).select("k1", "k2", "p.word", "p.n")
    sums = pairs.join(_values(blocks, spelling, wide, least, False), "word").groupBy("k1", "k2").agg(
        F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("c") > 0).cast("int")).alias("known"),
        F.sum(F.col("n") * (F.log10(F.col("c") + 0.5) - denominator)).alias("base"), F.sum(F.col("n") * F.col("lp")).alias("value"),
    )
    # rows equal in id and text share a key: each takes its part of the sums
    part = F.coalesce(F.col("m") / F.col("all"), F.lit(0.0))
    total = F.col("score") + F.coalesce(F.col("value"), F.lit(0.0)) * part
    return own.drop("far").join(sums, ["k1", "k2"], "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.round(F.coalesce(F.col("known"), F.lit(0)) * part).cast("long")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce(F.col("base"), F.lit(0.0)) * part).alias("base_score"), total.alias("score"), (-total / float(np.log10(2)) / F.greatest("size", F.lit(1))).alias("bits_per_byte"),
    )
