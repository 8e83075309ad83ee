"""Hard-negative mining: per anchor, all rows are scored and sorted, and the negatives of each positive are read off
the sorted list between two limits.

Rows are packed into matrices of integers where they lie. Anchors, a stated set of queries, travel to the rows in
blocks of bounded size; a task scores a block against one matrix at a time, sorts each anchor's scores by falling
score and rising id, and keeps what may be among the first few of all rows. A first pass finds
the positives, a second one binary-searches each positive's limits in the sorted scores. Results of
tasks are merged by rank, so they are exact whatever the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_io import cut, released, small_batches

#: Rows of a packed matrix, bytes of a block of anchors that travels, and scores that a task holds at once.
MATRIX_ROWS, BLOCK_BYTES, SCORES = 8192, 1 << 23, 1 << 21
#: Integers that a double holds exactly, and what a long holds.
EXACT, LONG = float(1 << 53), (1 << 63) - 1
SCALE = 256
_PACKED = "n int, ids binary, labels binary, dims int, vectors binary"


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, vector of doubles) of the rows that take part: all three there, and every component finite, before and after
    scaling. Further columns are ignored."""
    v = rows[vector].cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(SCALE))) < F.lit(float("inf")))
    out = rows.select(rows[key].cast("long").alias("id"), rows[label].cast("long").alias("label"), v.alias("vector"))
    return out.where("id is not null and label is not null and vector is not null").where(F.forall("vector", fine))


def _floats(column: pa.Array) -> np.ndarray:
    """A matrix of floor(SCALE x); shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(column.flatten().to_numpy() * SCALE)
    return out


def packed(rows: DataFrame) -> DataFrame:
    """Matrices of up to MATRIX_ROWS rows each, sorted by id: n, ids, labels, dims and vectors (doubles, each an integer)."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                ids = batch.column("id").to_numpy()
                order = np.argsort(ids, kind="stable")
                v = _floats(batch.column("vector"))[order]
                values = [len(ids), ids[order].tobytes(), batch.column("label").to_numpy()[order].tobytes(), v.shape[1], v.tobytes()]
                yield pa.record_batch([pa.array([x], t) for x, t in zip(values, (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()), strict=True)], ["n", "ids", "labels", "dims", "vectors"])

    small_batches(rows.sparkSession, MATRIX_ROWS)
    return cut(rows.mapInArrow(released(each), _PACKED))


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of two matrices of integers (as doubles): in doubles where every partial sum fits one, else in Python's own
    integers, kept within a long's range."""
    d = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :d], rows[:, :d]
    if d and float(np.abs(a).max()) * float(np.abs(b).max()) * d >= EXACT:
        whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
        return np.clip(whole(a) @ whole(b).T, -LONG, LONG).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def _tables(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for r in batch.to_pylist():
        yield np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64), np.frombuffer(r["vectors"], np.float64).reshape(r["n"], r["dims"])


def _blocks(anchors: DataFrame, more: list[str], limit: int = BLOCK_BYTES) -> Iterator[dict[str, np.ndarray]]:
    """The anchors in blocks of at most `limit` bytes of vectors (one anchor at least), as arrays by column. A block's
    rows come from a checkpoint one partition at a time."""
    held, size = [], 0

    def block() -> dict[str, np.ndarray]:
        out = {c: np.array([r[c] for r in held], np.int64) for c in ("anchor", "id", "label")}
        out |= {c: [r[c] for r in held] for c in more}
        return out | {"vectors": _floats(pa.array([r["vector"] for r in held], pa.list_(pa.float64())))}

    for r in anchors.toLocalIterator():
        size += 8 * len(r["vector"])
        if held and size > limit:
            yield block()
            held, size = [], 8 * len(r["vector"])
        held.append(r)
    if held:
        yield block()


def _first(rows: DataFrame, k: int, score: str, tie: str, *by: str) -> DataFrame:
    """The first k rows of each group by falling score and rising tie, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _searched(matrices: DataFrame, block: dict[str, np.ndarray], find, schema: str) -> DataFrame:
    """find(place of the anchor in the block, scores, ids, labels) -> arrays, of each anchor and each partition's matrices.

    A partition's rows pass matrix by matrix; the scores of some anchors at a time are held."""
    shared = matrices.sparkSession.sparkContext.broadcast(block)
    names = [c.split()[0] for c in schema.split(", ")]

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in it:
            for ids, labels, vectors in _tables(batch):
                step = max(1, SCORES // max(len(ids), 1))
                for a in range(0, len(own["id"]), step):
                    s = scores(own["vectors"][a : a + step], vectors)
                    found = [x for i, row in enumerate(s) for x in find(own, a + i, row, ids, labels)]
                    if found:
                        yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names)

    return matrices.mapInArrow(released(each), schema)


def mine(rows: DataFrame, anchors: Column | None = None, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, limit: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): of each anchor and each of its first
    `positives` other rows of the same label the first `negatives` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    `rows` has id, label and vector, as from usable(); `anchors` is a condition on them (all rows if none is given). A score is the integer
    inner product of floor(256 x); higher scores come first, ties by smaller id. Other rows are those of another id; a
    repeated row counts as often as it stands, an anchor's too. Shorter vectors count as ending in zeros; scores
    beyond a long are its limit. Anchors without positives, positives without negatives and empty tables give no rows."""
    spark = rows.sparkSession
    matrices = packed(rows)
    small_batches(spark, 4)
    picked = rows if anchors is None else rows.where(anchors)
    picked = cut(picked.select(F.monotonically_increasing_id().alias("anchor"), "id", "label", "vector"))

    def nearest(own, i, score, ids, labels):
        same = np.flatnonzero((labels == own["label"][i]) & (ids != own["id"][i]))
        # the ids rise, so a stable sort by falling score is a sort by score and id
        first = same[np.lexsort((ids[same], -score[same]))[:positives]]
        if len(first):
            yield np.full(len(first), own["anchor"][i]), np.full(len(first), own["id"][i]), ids[first], score[first]

    def between(own, i, score, ids, labels):
        other = np.flatnonzero(labels != own["label"][i])
        other = other[np.lexsort((ids[other], -score[other]))]
        falling = -score[other]
        for place, (positive, ps) in enumerate(own["found"][i]):
            # 100 s <= high ps and low ps <= 100 s, in whole numbers
            top, bottom = high * ps // 100, -(-low * ps // 100)
            a = int(np.searchsorted(falling, -min(top, LONG), side="left"))
            b = min(int(np.searchsorted(falling, -max(bottom, -LONG), side="right")), a + negatives)
            if a < b:
                n = b - a
                yield np.full(n, own["anchor"][i]), np.full(n, place), np.full(n, own["id"][i]), np.full(n, positive), np.full(n, ps), ids[other[a:b]], score[other[a:b]]

    keys = "anchor long, anchor_id long"
    best = _union(_first(_searched(matrices, b, nearest, f"{keys}, positive_id long, positive_score long"), positives, "positive_score", "positive_id", "anchor") for b in _blocks(picked, [], limit))
    if best is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    found = best.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))), lambda x: F.struct(x["positive_id"], x["positive_score"])).alias("found"))
    with_positives = cut(picked.join(found, "anchor"))
    schema = "anchor long, place long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    out = _union(_first(_searched(matrices, b, between, schema), negatives, "negative_score", "negative_id", "anchor", "place") for b in _blocks(with_positives, ["found"], limit))
    if out is None:
        return mine(rows.limit(0))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _union(parts: Iterator[DataFrame]) -> DataFrame | None:
    """The parts' rows, each from its own checkpoint: a block of anchors is done before the next is fetched."""
    out = None
    for p in parts:
        p = cut(p)
        out = p if out is None else out.unionByName(p)
    return out


def shifted_labels(rows: DataFrame) -> DataFrame:
    """The label of every seventh id is the next of ten."""
    return rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
