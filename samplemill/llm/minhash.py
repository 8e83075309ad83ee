"""Near duplicates by b-bit MinHash, confirmed on full shingle sets.

1. Every text becomes its set of five-word shingles (64-bit hashes); one pass
   gives the set's size, a 128-bit hash of the whole set, 128 minima of which
   the low two bits are packed into four longs, and 25 band keys of five minima.
2. Texts with equal sets collapse to one representative, combined map-side.
3. Band buckets give stars (each member to the bucket's smallest id), never
   pairs; connected stars are the candidate groups, so every candidate pair lies
   inside one group.
4. A group's texts move once. Inside a task, packed signatures estimate the
   similarity (collision-corrected bit counts); what may reach the threshold is
   confirmed by exact intersections. A group beyond a block's size is dealt
   over a grid of block pairs, so no task holds more than two blocks. Only links
   that join two components leave a task.
5. Components of the links give every document its class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .spark_io import arrow_stage, components, cut, documents, join_heavy, released

MINIMA, BANDS, ROWS, BITS = 128, 25, 5, 2
#: A block of a candidate group: documents and shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 400_000
_MULTIPLIERS = tv.mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def minima(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """[text, MINIMA] 32-bit minima of the sets' multiply-shift hashes; all ones for empty sets."""
    out = np.full((len(offs) - 1, MINIMA), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(offs) > 0)
    if len(full):
        at = offs[:-1][full]
        for k in range(MINIMA):
            out[full, k] = np.minimum.reduceat(sets * _MULTIPLIERS[k], at) >> np.uint64(32)
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """[text, 4] unsigned longs of the minima's low two bits."""
    bits = (low & 3).astype(np.uint64).reshape(len(low), 4, 32)
    return np.bitwise_or.reduce(bits << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=2)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures: the share of equal two-bit values,
    corrected for the quarter of unequal minima whose low bits agree."""
    x = one ^ many
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=1)
    return (1 - differ / MINIMA - 2.0**-BITS) / (1 - 2.0**-BITS)


def shingles(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bands array<long>) of every document."""

    def each(batch: pa.RecordBatch):
        ids = batch.column(0)
        for a, b, data, offs in tv.batches(batch.column(1)):
            _, _, first, hashes = tv.word_hashes(data, offs, tv.NOT_SPACE)
            sets, at = tv.shingle_sets(hashes, first)
            low = minima(sets, at)
            sums = np.zeros((2, len(sets) + 1), np.uint64)
            np.cumsum(sets, out=sums[0, 1:])
            np.cumsum(tv.mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1, 1:])
            whole = (sums[:, at[1:]] - sums[:, at[:-1]]).view(np.int64)
            keys = np.zeros((b - a, BANDS), np.uint64)
            for k in range(BANDS):
                key = np.full(b - a, k + 1, np.uint64)
                for j in range(k * ROWS, k * ROWS + ROWS):
                    key = key * np.uint64(0x9FB21C651E98DF25) + low[:, j]
                    key ^= key >> np.uint64(29)
                keys[:, k] = tv.mix(key)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
            yield pa.record_batch([ids.slice(a, b - a), pa.array(np.diff(at)), pa.array(whole[0]), pa.array(whole[1]), lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return arrow_stage(documents(docs), each, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


class _Union:
    def __init__(self, n: int) -> None:
        self.up, self.size = list(range(n)), [1] * n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if self.size[x] < self.size[y]:
            x, y = y, x
        self.up[y] = x
        self.size[x] += self.size[y]
        return True


def block_links(ids: np.ndarray, texts: pa.Array, left: np.ndarray, right: np.ndarray, percent: int, margin: float) -> list[tuple[int, int]]:
    """Links that join components among the pairs (one text of `left`, one of `right`).

    All pairs across components are covered: a text is compared with the whole
    block, or put off while it lies in the largest component. As another component may
    become the largest, those put off outside the one that is largest at the end
    are compared then; two texts never compared lie in that one."""
    column, offs = tv.byte_arrays(texts)
    _, _, first, hashes = tv.word_hashes(column, offs, tv.NOT_SPACE)
    sets, at = tv.shingle_sets(hashes, first)
    size, n = np.diff(at), len(ids)
    packed = pack(minima(sets, at))
    _, codes = np.unique(sets, return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(codes, kind="stable")
    posting = owner[order]
    where = np.searchsorted(codes[order], np.arange(codes.max() + 2 if len(codes) else 1))
    union, out, later = _Union(n), [], []
    root, largest = np.arange(n), -1
    mode = np.bitwise_or.reduce(packed & packed[0], axis=0) if n else packed
    central = np.argsort(-estimate(mode, packed), kind="stable") if n else []

    def compare(x: int) -> None:
        nonlocal root, largest
        other = right if left[x] else left
        other = other | (right & left[x]) | (left & right[x])
        able = other & (root != root[x]) & (np.minimum(size, size[x]) * 100 >= percent * np.maximum(size, size[x]))
        able[able] = estimate(packed[x], packed[able]) >= percent / 100 - margin
        if not able.any():
            return
        mine = codes[at[x] : at[x + 1]]
        lengths = where[mine + 1] - where[mine]
        picks = np.repeat(where[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        both = np.bincount(posting[picks], minlength=n)
        near = np.flatnonzero(able & (100 * both >= percent * (size + size[x] - both)))
        for y in near:
            if union.join(int(x), int(y)):
                out.append((int(ids[x]), int(ids[y])))
        if len(near):
            root = np.array([union.find(i) for i in range(n)])
            largest = int(np.argmax(np.bincount(root)))

    for x in central:
        if size[x] and largest >= 0 and root[x] == largest:
            later.append(x)
        elif size[x]:
            compare(x)
    hub = largest
    for x in later:
        if root[x] != root[hub]:
            compare(x)
    return out


def links(docs: DataFrame, groups: DataFrame, percent: int = 85, margin: float = 0.24) -> DataFrame:
    """Confirmed links (a, b) inside groups (doc_id, group, n_shingles); enough of them to
    connect whatever is connected. A block's rows reach Python together, streamed in order."""
    shape = groups.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_DOCS)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES))).cast("int").alias("g"))
    placed = groups.join(shape, "group").withColumn("i", F.pmod(F.xxhash64("doc_id"), F.col("g")).cast("int"))
    placed = placed.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct("group", F.least("i", j).alias("i"), F.greatest("i", j).alias("j"), F.col("i").alias("own")))).alias("k"))
    rows = documents(docs).join(placed, "doc_id").select("doc_id", "text", "k.group", "k.i", "k.j", "k.own")

    def each(it):
        held, key = [], None

        def finish():
            t = pa.Table.from_batches(held).combine_chunks()
            own, i, j = (t.column(c).to_numpy() for c in ("own", "i", "j"))
            found = block_links(t.column("doc_id").to_numpy(), t.column("text"), own == i, own == j, percent, margin)
            return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in it:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("group", "i", "j")])
            ends = [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            a = 0
            for b in ends:
                now = tuple(keys[:, a])
                if held and now != key:
                    yield finish()
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
                a = b
        if held:
            yield finish()

    return rows.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(released(each), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): classes of documents whose shingle
    sets have 100 * intersection >= percent * union, directly or in steps.

    A null text counts as empty; an empty set links with nothing. Equal texts are
    one class; repeated doc_ids are treated as one document each. An empty table
    gives an empty result; further columns are ignored.
    """
    own = cut(shingles(docs))
    full = own.where("n_shingles > 0")
    sets = full.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    copies = cut(sets)
    reps = full.join(copies.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    buckets = reps.select("doc_id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a != z").select("bucket", "a")
    stars = buckets.join(shared, "bucket").select("a", F.col("doc_id").alias("b"))
    groups = components(stars).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "group")
    groups = cut(groups.join(copies.select(F.col("rep").alias("doc_id"), "n_shingles").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), "doc_id"))
    classes = components(links(docs, groups, percent))
    # a set with many copies is dealt out, and empty sets meet nothing
    sets = cut(copies.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", "n_shingles", "n", F.coalesce("component", "rep").alias("component_id")))
    named = join_heavy(full.drop("bands"), sets, ["set_a", "set_b", "n_shingles"], "n").select("doc_id", "n_shingles", "component_id")
    named = named.unionByName(own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return named.withColumn("kept", F.col("doc_id") == F.col("component_id"))
