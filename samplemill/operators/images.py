"""Steps on images and volumes: nested vectors of doubles, rows of one shape handled together as whole Arrow batches.

An image is an array of rows, a volume an array of images. A null, empty or ragged image gives a null. Random
transforms take their numbers as columns, drawn by the hashed samplers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, put, uniform
from .base import op

#: Standard deviations of the smoothing filter that are kept.
TRUNCATE = 4.0


# -- batches of nested vectors -----------------------------------------------------------


def stacks(column: pa.Array, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their values stacked) for each shape among a batch's nested lists; null, empty and ragged ones are left out."""
    sizes = lambda x: pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = sizes(column)
    shape, fine, level = [counts], column.is_valid().to_numpy(zero_copy_only=False), column.flatten()
    for _ in range(depth - 1):
        lens, some = sizes(level), counts > 0
        heads, below, wide = (np.cumsum(counts) - counts)[some], np.zeros_like(counts), np.zeros_like(counts)
        if len(heads):
            below[some], wide[some] = np.add.reduceat(lens, heads), np.maximum.reduceat(lens, heads)
            fine[some] &= np.minimum.reduceat(lens, heads) == wide[some]
        shape.append(wide)
        counts, level = below, level.flatten()
    values, starts = level.cast(pa.float64()).to_numpy(zero_copy_only=False), np.cumsum(counts) - counts
    shapes = np.stack(shape, axis=1)
    fine &= counts > 0
    for s in np.unique(shapes[fine], axis=0):
        rows = np.flatnonzero(fine & (shapes == s).all(axis=1))
        yield rows, values[starts[rows, None] + np.arange(s.prod())].reshape(len(rows), *s)


def nested(images: Sequence[np.ndarray | None], depth: int) -> pa.Array:
    """The images as nested lists."""
    there = [x for x in images if x is not None]
    out = pa.array(np.concatenate([x.ravel() for x in there]) if there else np.zeros(0))
    for d in range(depth - 1, 0, -1):
        lens = np.concatenate([np.full(math.prod(x.shape[:d]), x.shape[d]) for x in there]) if there else np.zeros(0, np.int64)
        out = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lens)), pa.int32()), out)
    ends = np.cumsum([0 if x is None else x.shape[0] for x in images])
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), out, mask=pa.array([x is None for x in images]))


def _each(df: DataFrame, key: str, to: str | None, depth: int, f: Callable[..., Sequence[np.ndarray]], *params: Column, made: int | None = None) -> DataFrame:
    """Puts f(stack, each parameter's values) as nested vectors of the same depth, or of `made`; a null parameter counts as a null image."""
    made = made or depth

    def run(*columns: pa.Array) -> pa.Array:
        images, values = columns[0], columns[1:]
        out: list[np.ndarray | None] = [None] * len(images)
        for rows, stack in stacks(images, depth):
            given = [v.cast(pa.float64()).to_numpy(zero_copy_only=False)[rows] for v in values]
            good = np.all([~np.isnan(g) for g in given], axis=0) if given else np.ones(len(rows), bool)
            if good.any():
                for i, x in zip(rows[good].tolist(), f(stack[good], *(g[good] for g in given)), strict=True):
                    out[i] = x
        return nested(out, made)

    kind = lambda d: "array<" * d + "double" + ">" * d
    return put(df, to or key, F.arrow_udf(run, kind(made))(col(key).cast(kind(depth)), *params))


# -- resizing ------------------------------------------------------------------------------


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Places beyond the ends turned back at the outermost elements."""
    if n == 1:
        return np.zeros_like(i)
    i = np.mod(i, 2 * (n - 1))
    return np.minimum(i, 2 * (n - 1) - i)


def taps(n: int, m: int, method: str = "linear", smooth: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights), each m x taps: how the m elements of a resized axis come from its n.

    nearest takes the element whose cell holds the new cell's middle; corners and corners-nearest lay the first and last
    elements of both axes on each other and weigh two neighbours, or take the nearer one. linear weighs the two elements around the
    middle, ends being mirrored; with `smooth`, a shrinking axis is first smoothed by a Gaussian of standard deviation
    (n / m - 1) / 2."""
    middle = (np.arange(m) + 0.5) * n / m
    if method == "nearest":
        return np.minimum(np.floor(middle), n - 1).astype(np.int64)[:, None], np.ones((m, 1))
    if method in ("corners", "corners-nearest"):
        place = np.arange(m) * (n - 1) / max(m - 1, 1)
        if method == "corners-nearest":
            return np.floor(place + 0.5).astype(np.int64)[:, None], np.ones((m, 1))
        at = np.minimum(np.floor(place), max(n - 2, 0)).astype(np.int64)
        return np.stack([at, np.minimum(at + 1, n - 1)], axis=1), np.stack([1 - place + at, place - at], axis=1)
    if method != "linear":
        raise ValueError(f"no resizing by {method!r}")
    at = np.floor(middle - 0.5)
    part = middle - 0.5 - at
    sigma = max(0.0, (n / m - 1) / 2) if smooth else 0.0
    reach = int(TRUNCATE * sigma + 0.5)
    bell = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2) if reach else np.ones(1)
    bell /= bell.sum()
    weights = np.zeros((m, 2 * reach + 2))
    # smoothing happens at the mirrored place of each of the two neighbours
    places = mirrored(np.stack([at, at + 1], axis=1).astype(np.int64), n)[:, :, None] + np.arange(-reach, reach + 1)
    weights = np.stack([1 - part, part], axis=1)[:, :, None] * bell
    return mirrored(places, n).reshape(m, -1), weights.reshape(m, -1)


def _resized(stack: np.ndarray, axis: int, m: int, method: str, smooth: bool) -> np.ndarray:
    """One axis of a stack of images, tap by tap."""
    places, weights = taps(stack.shape[axis], m, method, smooth)
    wide = [1] * stack.ndim
    wide[axis] = m
    out = 0.0
    for t in range(places.shape[1]):
        out = out + np.take(stack, places[:, t], axis=axis) * weights[:, t].reshape(wide)
    return out


@op(reads="key", writes="to|key")
def resize(df: DataFrame, key: str, shape: Sequence[int], to: str | None = None, method: str = "linear", smooth: bool = True) -> DataFrame:
    """The image (2 axes) or volume (3) in another shape, axis by axis; see taps()."""

    def run(stack):
        for axis, m in enumerate(shape):
            stack = _resized(stack, axis + 1, m, method, smooth) if stack.shape[axis + 1] != m else stack
        return stack

    return _each(df, key, to, len(shape), run)


@op(reads="key", writes="to|key")
def resize_and_pad(df: DataFrame, key: str, shape: tuple[int, int], padding: tuple[int, int] = (0, 0), to: str | None = None, fill: float = 0.0) -> DataFrame:
    """Shrinks an image that is larger than `shape`, keeping its proportions, and lays it in the middle of an image of `shape`
    with `padding` on both sides of each axis."""

    def run(stack):
        ratio = min(1.0, *(s / n for s, n in zip(shape, stack.shape[1:], strict=True)))
        inner = [int(n * ratio) for n in stack.shape[1:]]
        if 0 in inner:
            raise ValueError(f"an image of {stack.shape[1:]} does not shrink to {shape}")
        if ratio != 1:
            for axis, m in enumerate(inner):
                stack = _resized(stack, axis + 1, m, "linear", True)
        outer = [s + 2 * p for s, p in zip(shape, padding, strict=True)]
        a, b = ((o - i) // 2 for o, i in zip(outer, inner, strict=True))
        out = np.full((len(stack), *outer), float(fill))
        out[:, a : a + inner[0], b : b + inner[1]] = stack
        return out

    return _each(df, key, to, 2, run)


@op(reads="key", writes="to|key")
def crop_or_pad(df: DataFrame, key: str, shape: Sequence[int], move: Sequence[Column | float] | float = 0.5, to: str | None = None, fill: float = 0.0) -> DataFrame:
    """An image or volume cut to `shape`, or filled up at the ends of shorter axes. `move` says for each axis (or for all) where in
    the room that there is the cut begins: 0.5 is the middle."""
    moves = [move] * len(shape) if isinstance(move, (int, float, Column)) else list(move)

    def run(stack, *given):
        out = np.full((len(stack), *shape), float(fill))
        for i, image in enumerate(stack):
            starts = [round(float(g[i]) * max(n - m, 0)) for g, n, m in zip(given, image.shape, shape, strict=True)]
            part = image[tuple(slice(a, a + m) for a, m in zip(starts, shape, strict=True))]
            out[(i, *(slice(0, n) for n in part.shape))] = part
        return out

    return _each(df, key, to, len(shape), run, *map(_number, moves))


@op(reads="keys names", writes="keys")
def random_crop(df: DataFrame, keys: Sequence[str], axes: int, seed: object, *names: str, scale: tuple[float, float] | None = (0.4, 1.0), shape: Sequence[int] | None = None, fixed: Sequence[int] = ()) -> DataFrame:
    """The same random cut of several images or volumes of one shape: a drawn share of every axis, or `shape` if `scale` is None, at a
    drawn place. Axes in `fixed` stay whole. Draws depend on the seed and the columns `names`."""
    u = lambda place: uniform(f"{seed}/{place}", *names)

    def run(stack, share, *starts):
        size = np.stack([np.rint(share * n) if scale is not None else np.full(len(stack), m) for n, m in zip(stack.shape[1:], shape or stack.shape[1:], strict=True)], axis=1).astype(int)
        out = []
        for image, want, at in zip(stack, size.tolist(), zip(*starts, strict=True), strict=True):
            begin = [int(x * (n - m + 1)) for x, n, m in zip(at, image.shape, want, strict=True)]
            out.append(image[tuple(slice(None) if a in fixed else slice(b, b + m) for a, (b, m) in enumerate(zip(begin, want, strict=True)))])
        return out

    low, high = scale or (1.0, 1.0)
    drawn = F.lit(float(low)) + u("scale") * F.lit(float(high - low))
    for k in keys:
        df = _each(df, k, None, axes, run, drawn, *(u(a) for a in range(axes)))
    return df


@op(reads="keys names", writes="keys")
def random_flip(df: DataFrame, keys: Sequence[str], axes: int, seed: object, *names: str) -> DataFrame:
    """Several images or volumes turned over along the same drawn axes."""

    def turned(x: Column, axis: int) -> Column:
        x = x if axis + 1 == axes else F.transform(x, lambda y: turned(y, axis + 1))
        return F.when(uniform(f"{seed}/{axis}", *names) < 0.5, F.reverse(x)).otherwise(x)

    return df.withColumns({k: turned(col(k), 0) for k in keys})


@op(reads="key", writes="to|key")
def squeeze_axis(df: DataFrame, key: str, axis: int, to: str | None = None) -> DataFrame:
    """A volume of channels (4 axes) as an image of channels: spatial axis 1, 2 or 3 goes into the channels."""
    order = {1: (0, 1, 2, 3), 2: (0, 2, 1, 3), 3: (0, 3, 1, 2)}[axis]

    def run(stack):
        x = np.transpose(stack, [0, *(a + 1 for a in order)])
        return x.reshape(len(x), -1, *x.shape[3:])

    return _each(df, key, to, 4, run, made=3)


@op(reads="key", writes="to|key")
def unsqueeze_axis(df: DataFrame, key: str, axis: int, channels: int, to: str | None = None) -> DataFrame:
    """What squeeze_axis() has made of so many channels, as it was."""
    order = {1: (0, 1, 2, 3), 2: (0, 2, 1, 3), 3: (0, 2, 3, 1)}[axis]

    def run(stack):
        x = stack.reshape(len(stack), channels, -1, *stack.shape[2:])
        return np.transpose(x, [0, *(a + 1 for a in order)])

    return _each(df, key, to, 3, run, made=4)


@op(reads="key", writes="to|key")
def classes_apart(df: DataFrame, key: str, classes: int, axes: int = 2, to: str | None = None) -> DataFrame:
    """A mask of class numbers as one 0/1 mask for each class, the classes first."""

    def equal(x: Column, c: Column, axis: int) -> Column:
        return (x == c).cast("int") if axis == axes else F.transform(x, lambda y: equal(y, c, axis + 1))

    return put(df, to or key, F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: equal(col(key), c, 0)))


@op
def pick_slice(df: DataFrame, image: str, mask: str, at: str, drop_blank: bool = False) -> DataFrame:
    """Slice `at` (a column) of a volume and of its mask; with `drop_blank`, samples whose mask holds no class but in
    its first part are dropped."""
    df = df.withColumns({image: F.get(col(image), col(at)), mask: F.get(col(mask), col(at))})
    if not drop_blank:
        return df
    rest = F.flatten(F.slice(col(mask), F.lit(2), F.greatest(F.size(col(mask)) - 1, F.lit(0))))
    return df.where(F.coalesce(F.array_max(rest), F.lit(0)) >= 1)


@op
def copies(df: DataFrame, key: str, n: int, prefix: str = "crop_") -> DataFrame:
    """The key's value as `n` keys, each for a cut of its own; the key itself goes."""
    return df.withColumns({f"{prefix}{i}": col(key) for i in range(n)}).drop(key)


# -- affine maps ---------------------------------------------------------------------------


def _gathered(stack: np.ndarray, x: np.ndarray, y: np.ndarray, method: str, fill: float) -> np.ndarray:
    """Values of each image at its own points (x to the right, y down; a pixel's middle is at its place + 1/2); `fill` outside."""
    n, h, w = stack.shape
    row = np.arange(n)[:, None, None]
    inside = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    if method == "nearest":
        at = lambda v, top: np.clip(np.floor(v), 0, top - 1).astype(np.int64)
        return np.where(inside, stack[row, at(y, h), at(x, w)], fill)
    left, up = np.floor(x - 0.5), np.floor(y - 0.5)
    dx, dy = x - 0.5 - left, y - 0.5 - up
    at = lambda v, top: np.clip(v, 0, top - 1).astype(np.int64)
    above = stack[row, at(up, h), at(left, w)] * (1 - dx) + stack[row, at(up, h), at(left + 1, w)] * dx
    below = stack[row, at(up + 1, h), at(left, w)] * (1 - dx) + stack[row, at(up + 1, h), at(left + 1, w)] * dx
    return np.where(inside, above * (1 - dy) + below * dy, fill)


def _middles(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of the pixels' middles from the image's own."""
    return np.meshgrid(np.arange(w) + 0.5 - w / 2, np.arange(h) + 0.5 - h / 2)


def _number(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


@op(reads="key", writes="to|key")
def affine(df: DataFrame, key: str, to: str | None = None, rotate: Column | float = 0.0, translate: tuple = (0.0, 0.0), scale: Column | float = 1.0, shear: Column | float = 0.0, flip: tuple[bool, bool] = (False, False), method: str = "bilinear", fill: float = 0.0) -> DataFrame:
    """An image sheared, scaled and rotated around its middle (degrees, clockwise), then moved by `translate` (right, down), then
    turned over (top to bottom, left to right). Every number may be a column; each new pixel looks up where it comes from."""

    def run(stack, angle, right, down, size, slant):
        _, h, w = stack.shape
        x, y = _middles(h, w)
        wide = lambda v: v[:, None, None]
        x, y = x - wide(right), y - wide(down)
        c, s = wide(np.cos(np.radians(angle))), wide(np.sin(np.radians(angle)))
        # back through rotation, shear and scale
        u, v = c * x + s * y, c * y - s * x
        u = u + wide(np.tan(np.radians(slant))) * v
        out = _gathered(stack, u / wide(size) + w / 2, v / wide(size) + h / 2, method, fill)
        return out[:, :: -1 if flip[0] else 1, :: -1 if flip[1] else 1]

    return _each(df, key, to, 2, run, _number(rotate), *map(_number, translate), _number(scale), _number(shear))


@op(reads="key", writes="to|key")
def rotate_volume(df: DataFrame, key: str, to: str | None = None, z: Column | float = 0.0, y: Column | float = 0.0, x: Column | float = 0.0) -> DataFrame:
    """A volume (z, y, x) rotated around its axes by degrees, counter-clockwise in the plane of the other two: first around z,
    then x, then y. Voxels are taken from the nearest place; what comes from outside is 0."""

    def plane(stack, angle, axes):
        """Rotation in the plane of the last two of `axes`."""
        v = np.transpose(stack, [0, *(a + 1 for a in axes)])
        n, d, h, w = v.shape
        px, py = _middles(h, w)
        c, s = np.cos(np.radians(angle))[:, None, None], np.sin(np.radians(angle))[:, None, None]
        # places halfway between two voxels go to the even one
        u, t = np.rint(c * px - s * py + w / 2 - 0.5), np.rint(s * px + c * py + h / 2 - 0.5)
        u, t = (np.repeat(q, d, axis=0) + 0.5 for q in (u, t))
        out = _gathered(v.reshape(n * d, h, w), u, t, "nearest", 0.0).reshape(v.shape)
        return np.transpose(out, [0, *(i + 1 for i in np.argsort(axes))])

    def run(stack, az, ay, ax):
        for angle, axes in ((az, (0, 1, 2)), (ax, (2, 0, 1)), (ay, (1, 0, 2))):
            stack = plane(stack, angle, axes) if angle.any() else stack
        return stack

    return _each(df, key, to, 3, run, _number(z), _number(y), _number(x))


# -- connected components ------------------------------------------------------------------


def components(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels, first runs) of a stack of masks: cells that touch, also at corners, share a label; 0 is background. Labels
    of all masks are distinct, and ascend with a component's first cell.

    Runs of each row are found at once; runs of neighbouring rows that touch are joined by lowering each run's
    label to the least of its neighbours' and jumping, until nothing changes."""
    n, h, w = masks.shape
    padded = np.zeros((n * h, w + 2), np.int8)
    padded[:, 1:-1] = masks.reshape(n * h, w)
    edge = np.diff(padded, axis=1)
    row, start = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    labels = np.arange(len(row))
    # a run touches those of the row above from the first that ends at its start or later to the last that begins at its end or before
    line = w + 2
    first = np.searchsorted(row * line + end, (row - 1) * line + start, side="left")
    last = np.searchsorted(row * line + start, (row - 1) * line + end, side="right")
    count = np.where(row % h > 0, np.maximum(last - first, 0), 0)
    a = np.repeat(labels, count)
    b = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    while len(a):
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        for side in (a, b):
            np.minimum.at(new, labels[side], low)
            np.minimum.at(new, side, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == labels).all():
            break
        labels = new
    cells = np.zeros((n * h, w + 1), np.int64)
    np.add.at(cells, (row, start), labels + 1)
    np.add.at(cells, (row, end), -(labels + 1))
    return np.cumsum(cells, axis=1)[:, :w].reshape(n, h, w), row[np.unique(labels)] // h if len(row) else row


@op(reads="key", writes="to")
def biggest_box(df: DataFrame, key: str, to: str, threshold: float = 10.0, blocks: int = 30) -> DataFrame:
    """[top, left, bottom, right] (ends excluded) around the largest part of an image that is not dark.

    The image is cut into `blocks` x `blocks` blocks (what is over at the ends stays out, and so do the last row and column);
    blocks whose mean is over the threshold are cells of a mask, of whose components the one of most cells counts, the
    first of equals. One more block is left below and to the right. An image without such a block is its own box."""

    def run(column: pa.Array) -> pa.Array:
        out: list[list[int] | None] = [None] * len(column)
        for rows, stack in stacks(column, 2):
            n, h, w = stack.shape
            sums = np.zeros((n, h + 1, w + 1))
            sums[:, 1:, 1:] = stack.cumsum(axis=1).cumsum(axis=2)
            size = (h // blocks, w // blocks)
            a, b = (np.arange(blocks) * s for s in size)
            c, d = (np.minimum(x + s, k - 1) for x, s, k in zip((a, b), size, (h, w), strict=True))
            c, d = np.maximum(a, c), np.maximum(b, d)
            total = sums[:, c][:, :, d] - sums[:, a][:, :, d] - sums[:, c][:, :, b] + sums[:, a][:, :, b]
            area = (c - a)[:, None] * (d - b)
            labels, _ = components(np.where(area > 0, total / np.maximum(area, 1), -np.inf) > threshold)
            for i, mask in zip(rows.tolist(), labels, strict=True):
                found, cells = np.unique(mask[mask > 0], return_counts=True)
                if not len(found):
                    out[i] = [0, 0, h - 1, w - 1]
                    continue
                y, x = np.nonzero(mask == found[np.argmax(cells)])
                out[i] = [int(y.min()) * size[0], int(x.min()) * size[1], min((int(y.max()) + 2) * size[0], h - 1), min((int(x.max()) + 2) * size[1], w - 1)]
        return pa.array(out, pa.list_(pa.int64()))

    return put(df, to, F.arrow_udf(run, "array<long>")(col(key).cast("array<array<double>>")))


@op(reads="key box", writes="to|key")
def crop_to_box(df: DataFrame, key: str, box: str, to: str | None = None) -> DataFrame:
    """The part of an image within a box [top, left, bottom, right]."""
    top, left, bottom, right = (F.get(col(box), F.lit(i)).cast("int") for i in range(4))
    return put(df, to or key, F.transform(F.slice(col(key), top + 1, bottom - top), lambda r: F.slice(r, left + 1, right - left)))


# -- masked blocks -------------------------------------------------------------------------


@op(reads="key names", writes="to|key")
def mask_blocks(df: DataFrame, key: str, shape: Sequence[int], block: Sequence[int], seed: object, *names: str, share: float = 0.3, to: str | None = None, fill: float = 0.0) -> DataFrame:
    """An image or volume of `shape` with blocks that do not overlap set to `fill`: as many as hold `share` of its elements,
    rounded up, if there are so many.

    Blocks of whole size are numbered in order and permuted by a key of the seed and the columns `names`: those
    with the smallest hashes are masked, a draw without replacement that depends on the row alone."""
    if len(shape) != len(block):
        raise ValueError("one block length per axis")
    per = [s // b for s, b in zip(shape, block, strict=True)]
    n = math.prod(per)
    k = min(n, math.ceil(share * math.prod(shape) / math.prod(block)))
    if k == 0:
        return put(df, to or key, col(key))
    ranks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(uniform(seed, *names, i).alias("u"), i.alias("i")))
    # the hashes are made once and bound: the k-th smallest of them parts the blocks
    chosen = F.get(F.transform(F.array(ranks), lambda r: F.get(F.transform(F.array(F.get(F.array_sort(r), F.lit(k - 1))), lambda top: F.transform(r, lambda x: x <= top)), F.lit(0))), F.lit(0))

    def masked(x: Column, number: Column, inside: Column, axis: int, flags: Column) -> Column:
        if axis == len(shape):
            return F.when(inside & F.get(flags, number), F.lit(float(fill))).otherwise(x.cast("double"))
        return F.transform(x, lambda y, i: masked(y, number * per[axis] + F.least(F.floor(i / block[axis]).cast("int"), F.lit(per[axis] - 1)), inside & (i < per[axis] * block[axis]), axis + 1, flags))

    return put(df, to or key, F.get(F.transform(F.array(chosen), lambda flags: masked(col(key), F.lit(0), F.lit(True), 0, flags)), F.lit(0)))
