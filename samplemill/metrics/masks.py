"""Segmentation masks and boxes. Masks are vectors (flatten nested ones first)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, ratio
from .base import Metric, grouped


def cells(df: DataFrame, key: str, pred: str, target: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(*by, key, label, both, p, t): weights of the cells of every label but 0, per mask."""
    parts = {"p": pred, "t": target} | ({"w": weight} if weight else {})
    x = F.explode(F.arrays_zip(*(col(c).alias(n) for n, c in parts.items()))).alias("x")
    one = df.select(*map(col, by), col(key), x).select(*map(col, by), col(key), F.col("x.p").cast("long").alias("p"), F.col("x.t").cast("long").alias("t"), (F.col("x.w").cast("double") if weight else F.lit(1.0)).alias("w"))
    # the pairs of labels are few, so most of the work is combined before the shuffle
    few = one.groupBy(*map(col, by), col(key), "p", "t").agg(F.sum("w").alias("w"))
    sides = F.explode(F.array(F.struct(F.col("t").alias("label"), F.when(F.col("p") == F.col("t"), F.col("w")).otherwise(0.0).alias("both"), F.lit(0.0).alias("p"), F.col("w").alias("t")), F.struct(F.col("p").alias("label"), F.lit(0.0).alias("both"), F.col("w").alias("p"), F.lit(0.0).alias("t")))).alias("s")
    out = few.select(*map(col, by), col(key), sides).select(*map(col, by), col(key), "s.*")
    return out.where("label != 0").groupBy(*map(col, by), col(key), "label").agg(F.sum("both").alias("both"), F.sum("p").alias("p"), F.sum("t").alias("t"))


FORMULAS = {
    "dice": lambda b, p, t: ratio(2 * b, p + t),
    "iou": lambda b, p, t: ratio(b, p + t - b),
    "overlap": lambda b, p, t: F.coalesce(ratio(b, F.least(p, t)), F.lit(0.0)),
    "pixel_accuracy": lambda b, p, t: ratio(b, t),
}


def mask_metric(name: str, key: str, pred: str, target: str, weight: str | None = None, any_label: bool = False) -> Metric:
    """(*by, label, <name>): the mean over masks whose target has the label. `any_label`: all labels but 0 count as one."""

    def run(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        if any_label:
            df = df.withColumns({c: F.transform(col(c), lambda x: (x.cast("double") != 0).cast("int")) for c in (pred, target)})
        rows = cells(df, key, pred, target, by, weight).where("t > 0")
        value = FORMULAS[name](F.col("both"), F.col("p"), F.col("t"))
        return rows.groupBy(*map(col, by), "label").agg(F.avg(value).alias(name))

    return run


def average(metric: Metric, name: str, weights: dict[int, float] | None = None) -> Metric:
    """The labels' values, weighted if told, over the number of labels."""
    w = F.element_at(F.create_map(*(F.lit(x) for k, v in weights.items() for x in (int(k), float(v)))), F.col("label").cast("int")) if weights else F.lit(1.0)
    return lambda df, by=(): grouped(metric(df, by), by).agg((F.sum(col(name) * w) / F.count("*")).alias(name))


def hausdorff_rows(pred: str, target: str) -> Column:
    """The symmetric Hausdorff distance of two matrices whose rows are points."""

    def distance(a, b):
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))

    def one_way(p, q):
        return F.array_max(F.transform(p, lambda a: F.array_min(F.transform(q, lambda b: distance(a, b)))))

    return F.greatest(one_way(col(pred), col(target)), one_way(col(target), col(pred)))


def _lists(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of vectors (null: 0), where each begins, and their elements (null: 0) end to end."""
    lens = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lens, np.append(0, np.cumsum(lens)), pc.fill_null(vectors.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _listed(lens: np.ndarray, values: np.ndarray, kind: pa.DataType, like: pa.Array) -> pa.Array:
    """The values in lists of these lengths; null where `like` is."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)), pa.int32()), pa.array(values, kind), mask=like.is_null())


def rle_mask(counts: Column) -> Column:
    """The 0/1 vector of run lengths, which begin with a run of 0."""

    def run(v: pa.Array) -> pa.Array:
        lens, at, n = _lists(v)
        odd = (np.arange(len(n)) - np.repeat(at[:-1], lens)) % 2
        n = np.maximum(n, 0)
        return _listed(np.diff(np.append(0, np.cumsum(n))[at]), np.repeat(odd, n), pa.int32(), v)

    return F.arrow_udf(run, "array<int>")(counts.cast("array<long>"))


def mask_rle(mask: Column) -> Column:
    """Run lengths of a 0/1 vector, beginning with those of 0 (which may be none)."""

    def run(v: pa.Array) -> pa.Array:
        lens, at, x = _lists(v)
        row = np.repeat(np.arange(len(lens)), lens)
        before = np.append(0, x[:-1])[: len(x)]
        before[at[:-1][lens > 0]] = 0
        # a run ends where the value changes, and at the vector's end
        change = np.flatnonzero(x != before)
        owner, edge = np.append(row[change], np.arange(len(lens))), np.append(change - at[row[change]], lens)
        order = np.argsort(owner, kind="stable")
        owner, edge = owner[order], edge[order]
        start = np.append(0, edge[:-1])[: len(edge)]
        start[np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])] = 0
        return _listed(np.bincount(owner, minlength=len(lens)), edge - start, pa.int64(), v)

    return F.arrow_udf(run, "array<long>")(mask.cast("array<int>"))


#: Tests of a cell against an edge that a task makes at once.
TESTS = 1 << 20


def polygon_mask(points: Column, height: int, width: int) -> Column:
    """The row-major 0/1 vector of the cells whose centre lies in a polygon (structs of x and y), by the even-odd rule."""
    cell = np.arange(height * width)
    x, y = cell % width + 0.5, cell // width + 0.5

    def run(v: pa.Array) -> pa.Array:
        lens = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, flat = np.append(0, np.cumsum(lens)), v.flatten()
        px, py = (pc.fill_null(pc.cast(flat.field(c), pa.float64()), float("nan")).to_numpy(zero_copy_only=False) for c in "xy")
        after = np.arange(1, len(px) + 1)
        after[at[1:][lens > 0] - 1] = at[:-1][lens > 0]
        out = np.zeros((len(v), len(cell)), np.int32)
        rows = np.flatnonzero(lens)
        # as many polygons at once as TESTS allows, at least one
        piece = (at[rows] * len(cell)) // TESTS
        for some in np.split(rows, np.flatnonzero(np.diff(piece)) + 1) if len(rows) else []:
            edge = np.arange(at[some[0]], at[some[-1] + 1])
            ax, ay, bx, by = (c[:, None] for c in (px[edge], py[edge], px[after[edge]], py[after[edge]]))
            with np.errstate(divide="ignore", invalid="ignore"):
                crossed = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            out[some] = np.add.reduceat(crossed, at[some] - edge[0], axis=0, dtype=np.int32) % 2
        return _listed(np.where(v.is_null().to_numpy(zero_copy_only=False), 0, len(cell)), out[v.is_valid().to_numpy(zero_copy_only=False)].ravel(), pa.int32(), v)

    return F.arrow_udf(run, "array<int>")(points)


def _iou(both: np.ndarray, a: np.ndarray, b: np.ndarray, crowd: np.ndarray | bool) -> np.ndarray:
    """From the sizes of the overlap and of two masks; 0 where nothing is to be divided by."""
    both = both.astype(np.float64)
    of = np.where(crowd, a, a + b - both)
    return np.divide(both, of, out=np.zeros(np.broadcast(both, of).shape), where=of != 0)


def vector_iou(a: Column, b: Column, crowd: bool = False) -> Column:
    """Of two 0/1 vectors of one length (else 0); against a crowd target, over the prediction's size alone."""

    def run(v: pa.Array, w: pa.Array) -> pa.Array:
        same = pc.fill_null(pc.equal(pc.list_value_length(v), pc.list_value_length(w)), False)
        out = np.zeros(len(v))
        lens, _, x = _lists(v.filter(same))
        y, row = _lists(w.filter(same))[2], np.repeat(np.arange(len(lens)), lens)
        total = lambda z: np.bincount(row, weights=z, minlength=len(lens))
        out[same.to_numpy(zero_copy_only=False)] = _iou(total(x * y), total(x), total(y), crowd)
        return pa.array(out)

    return F.arrow_udf(run, "double")(a.cast("array<int>"), b.cast("array<int>"))


def box_iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Of boxes (x, y, width, height) given as four columns each."""
    w = F.greatest(F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return ratio(w * h, a[2] * a[3] + b[2] * b[3] - w * h)


def box_matches(preds: DataFrame, targets: DataFrame, image: str = "image") -> DataFrame:
    """(image, target_id, iou): the best prediction of each target's image; boxes are x, y, w, h; predictions and
    targets meet per image only."""
    p = preds.select(col(image).alias("image"), *(F.col(c).cast("double").alias(f"p_{c}") for c in "xywh"))
    t = targets.select(col(image).alias("image"), "target_id", *(F.col(c).cast("double").alias(f"t_{c}") for c in "xywh"))
    iou = box_iou([F.col(f"p_{c}") for c in "xywh"], [F.col(f"t_{c}") for c in "xywh"])
    return t.join(p, "image", "left").groupBy("image", "target_id").agg(F.coalesce(F.max(iou), F.lit(0.0)).alias("iou"))


#: Elements of a block of masks, and rows of an Arrow batch of blocks.
BLOCK, BATCH = 1 << 15, 500


def _mask_blocks(rows: DataFrame, *held: str) -> DataFrame:
    """(image, n, rows): the masks of (image, mask, *held) by image and length n, in blocks of about BLOCK elements."""
    rows = rows.withColumn("n", F.size("mask"))
    size = rows.groupBy(F.col("image").alias("__i"), F.col("n").alias("__n")).agg(F.greatest(F.ceil(F.count("*") * F.first("n") / BLOCK), F.lit(1)).alias("__blocks"))
    dealt = rows.join(size, F.col("image").eqNullSafe(F.col("__i")) & F.col("n").eqNullSafe(F.col("__n")))
    dealt = dealt.withColumn("__at", F.pmod(F.xxhash64("mask", *held), F.col("__blocks")))
    return dealt.groupBy("image", "n", "__at").agg(F.collect_list(F.struct("mask", *held)).alias("rows")).select("image", "n", "rows")


def mask_matches(preds: DataFrame, targets: DataFrame, image: str = "image") -> DataFrame:
    """(image, target_id, iou): as box_matches, of 0/1 vectors `mask`; targets may have a boolean `crowd`, against which the overlap
    counts over the prediction's size alone.

    All pairs of an image count, so the work grows with its square: blocks of targets meet blocks of (distinct) predictions, one
    product of two small matrices each, dealt over all tasks."""
    preds.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    small = F.col("mask").cast("array<tinyint>").alias("mask")
    crowd = F.coalesce(F.col("crowd"), F.lit(False)) if "crowd" in targets.columns else F.lit(False)
    p = _mask_blocks(preds.select(col(image).alias("image"), small).where("mask is not null").distinct())
    t = _mask_blocks(targets.select(col(image).alias("image"), small, "target_id", crowd.alias("crowd")), "target_id", "crowd")
    one = lambda c, f: F.transform(c, lambda x: x[f])
    pairs = t.join(p.withColumnRenamed("rows", "p"), ["image", "n"], "left").repartition(F.col("image"), F.xxhash64("rows", "p"))

    def best(n: pa.Array, masks: pa.Array, crowd: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for i in range(len(n)):
            mine, size = masks[i].values, n[i].as_py()
            if not others[i].is_valid or not size:
                out.append(np.zeros(len(mine)))
                continue
            a, b = (pc.fill_null(v.values.flatten(), 0).to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float32) for v in (others[i], masks[i]))
            out.append(_iou(b @ a.T, a.sum(axis=1)[None, :], b.sum(axis=1)[:, None], crowd[i].values.to_numpy(zero_copy_only=False)[:, None]).max(axis=1))
        at = np.append(0, np.cumsum([len(x) for x in out]))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0)))

    found = pairs.select("image", one("rows", "target_id").alias("id"), F.arrow_udf(best, "array<double>")("n", one("rows", "mask"), one("rows", "crowd"), one("p", "mask")).alias("iou"))
    found = found.select("image", F.explode(F.arrays_zip("id", "iou")).alias("x")).select("image", F.col("x.id").alias("target_id"), F.col("x.iou").alias("iou"))
    return found.groupBy("image", "target_id").agg(F.max("iou").alias("iou"))


def detection(preds: DataFrame, targets: DataFrame, threshold: float, image: str = "image", matches: Callable[..., DataFrame] | None = None) -> DataFrame:
    """mean_iou of matched targets, precision and recall, each the mean over images that have it; of boxes, or of masks with
    matches=mask_matches."""
    best = (matches or box_matches)(preds, targets, image).groupBy("image").agg(F.count_if(F.col("iou") > threshold).alias("hit"), F.count("*").alias("t"), F.avg(F.when(F.col("iou") > threshold, F.col("iou"))).alias("mean"))
    size = preds.groupBy(col(image).alias("image")).agg(F.count("*").alias("p"))
    rows = best.join(size, "image", "full_outer")
    return rows.agg(F.avg("mean").alias("mean_iou"), F.avg(ratio(F.coalesce("hit", F.lit(0)), F.col("p"))).alias("precision"), F.avg(ratio(F.col("hit"), F.col("t"))).alias("recall"))

