"""Steps on images against loops over single pixels."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samplemill.operators import images as im
from samplemill.operators.samples import Op


def run(spark, images, step: Op, depth=2):
    kind = "array<" * depth + "double" + ">" * depth
    rows = spark.createDataFrame([(i, x.tolist() if hasattr(x, "tolist") else x) for i, x in enumerate(images)], f"id int, m {kind}")
    return {r.id: r for r in step(rows).collect()}


def one_axis(v, m, smooth):
    """A resized line, element by element: mirrored ends, smoothing, then two neighbours."""
    n = len(v)
    at = lambda i: v[i] if 0 <= i < n else at(-i if i < 0 else 2 * (n - 1) - i) if n > 1 else v[0]
    sigma = max(0, (n / m - 1) / 2) if smooth else 0
    reach = int(4 * sigma + 0.5)
    bell = [math.exp(-(k**2) / (2 * sigma**2)) if reach else 1 for k in range(-reach, reach + 1)]
    soft = [sum(b * at(i + k) for b, k in zip(bell, range(-reach, reach + 1))) / sum(bell) for i in range(n)]
    v, out = soft, []
    for o in range(m):
        x = (o + 0.5) * n / m - 0.5
        i = math.floor(x)
        out.append((1 - x + i) * at2(v, i) + (x - i) * at2(v, i + 1))
    return out


def at2(v, i):
    n = len(v)
    return v[0] if n == 1 else v[i] if 0 <= i < n else at2(v, -i if i < 0 else 2 * (n - 1) - i)


@pytest.mark.parametrize("n,m", [(1, 4), (4, 1), (9, 3), (10, 4), (3, 10), (5, 5), (7, 6), (40, 3)])
@pytest.mark.parametrize("smooth", [True, False])
def test_taps_are_those_of_single_elements(n, m, smooth):
    v = np.random.default_rng(n * m).random(n)
    places, weights = im.taps(n, m, smooth=smooth)
    assert (v[places] * weights).sum(axis=1) == pytest.approx(one_axis(v, m, smooth)) and weights.sum(axis=1) == pytest.approx(1)


def test_resizing_images_of_many_shapes(spark):
    rng = np.random.default_rng(1)
    images = [rng.random((8, 6)), rng.random((3, 3)), None, [], [[1.0], [1.0, 2.0]], rng.random((8, 6)), [[]], rng.random((1, 1))]
    got = run(spark, images, im.resize("m", (4, 5), to="r"))
    for i, x in enumerate(images):
        if hasattr(x, "shape"):
            rows = np.array([one_axis(c, 4, x.shape[0] > 4) for c in x.T]).T
            assert np.array(got[i].r) == pytest.approx(np.array([one_axis(r, 5, x.shape[1] > 5) for r in rows]))
        else:
            assert got[i].r is None
    cube = rng.random((3, 4, 5))
    assert np.array(run(spark, [cube], im.resize("m", (3, 4, 5)), 3)[0].m) == pytest.approx(cube)
    assert np.array(run(spark, [cube], im.resize("m", (6, 2, 1), method="nearest"), 3)[0].m) == pytest.approx(cube[np.repeat(np.arange(3), 2)][:, [1, 3]][:, :, [2]])


def test_resize_and_pad(spark):
    wide, small = np.ones((4, 16)), np.arange(6.0).reshape(2, 3)
    got = run(spark, [wide, small], im.resize_and_pad("m", (8, 8), (1, 0), fill=-1))
    a, b = np.array(got[0].m), np.array(got[1].m)
    assert a.shape == b.shape == (10, 8)
    assert a[4:6] == pytest.approx(np.ones((2, 8))) and (a[:4] == -1).all() and (a[6:] == -1).all()
    assert (b[4:6, 2:5] == small).all() and (b == -1).sum() == 74


def test_affine_by_right_angles_and_whole_pixels(spark):
    x = np.arange(25.0).reshape(5, 5)
    turn = lambda **k: np.array(run(spark, [x], im.affine("m", **k))[0].m)
    assert turn(rotate=90) == pytest.approx(np.rot90(x, -1)) and turn(rotate=180) == pytest.approx(np.rot90(x, 2))
    assert turn(translate=(2, 1))[1:, 2:] == pytest.approx(x[:-1, :-2]) and (turn(translate=(2, 1))[0] == 0).all()
    assert turn(flip=(True, False)) == pytest.approx(x[::-1]) and turn(flip=(False, True)) == pytest.approx(x[:, ::-1])
    assert turn(scale=0.5, fill=-1)[0].tolist() == [-1] * 5 and turn(scale=5, method="nearest") == pytest.approx(12)
    slanted = turn(shear=45, method="nearest")
    assert slanted[2] == pytest.approx(x[2]) and slanted[0].tolist() == [0, 0, 0, 1, 2] or slanted[0].tolist() == [2, 3, 4, 0, 0]
    assert run(spark, [x], im.affine("m", rotate=F.lit(None).cast("double")))[0].m is None


def test_rotated_volumes(spark):
    v = np.random.default_rng(2).random((3, 3, 3))
    turn = lambda **k: np.array(run(spark, [v], im.rotate_volume("m", **k), 3)[0].m)
    assert turn(z=90) == pytest.approx(np.rot90(v, 1, (1, 2)))
    assert turn(x=90) == pytest.approx(np.rot90(v, 1, (0, 1))) and turn(y=90) == pytest.approx(np.rot90(v, 1, (0, 2)))
    assert turn(z=180, x=180, y=180) == pytest.approx(v)


def flood(mask):
    h, w = mask.shape
    seen, parts = np.zeros_like(mask, int), []
    for y in range(h):
        for x in range(w):
            if mask[y, x] and not seen[y, x]:
                stack, cells = [(y, x)], set()
                while stack:
                    a, b = stack.pop()
                    if 0 <= a < h and 0 <= b < w and mask[a, b] and not seen[a, b]:
                        seen[a, b] = len(parts) + 1
                        cells.add((a, b))
                        stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
                parts.append(cells)
    return parts


@pytest.mark.parametrize("share", [0.1, 0.3, 0.5, 0.8])
def test_components_are_those_of_flooding(share):
    masks = np.random.default_rng(int(share * 10)).random((60, 9, 11)) < share
    masks[0], masks[1] = False, True
    spiral = np.zeros((9, 11), bool)
    spiral[::2] = True
    spiral[1::4, -1] = spiral[3::4, 0] = True
    masks[2] = spiral
    labels, _ = im.components(masks)
    last = 0
    for mask, got in zip(masks, labels):
        assert (got > 0).tolist() == mask.tolist()
        parts = flood(mask)
        names = [{int(got[c]) for c in cells} for cells in parts]
        assert all(len(n) == 1 for n in names) and len(set.union(set(), *names)) == len(parts)
        order = [n.pop() for n in names]
        assert order == sorted(order) and (not order or order[0] > last)
        last = max(order, default=last)


def test_boxes(spark):
    x = np.zeros((40, 40))
    x[4:20, 6:30] = 50
    x[30:34, 2:6] = 200
    got = run(spark, [x, np.zeros((40, 40)), None], im.biggest_box("m", "box", blocks=10))
    assert got[0].box == [4, 4, 24, 36] and got[1].box == [0, 0, 39, 39] and got[2].box is None
    rows = im.crop_to_box("m", "box")(im.biggest_box("m", "box", blocks=10)(spark.createDataFrame([(x.tolist(),)], "m array<array<double>>")))
    assert np.array(rows.first().m).tolist() == x[4:24, 4:36].tolist()


def test_masked_blocks_do_not_overlap(spark):
    rows = spark.range(50).withColumn("m", F.array_repeat(F.array_repeat(F.array_repeat(F.lit(1.0), 5), 4), 6))
    hits = np.zeros((6, 4, 5))
    for r in im.mask_blocks("m", (6, 4, 5), (2, 2, 2), 3, "id", share=0.4)(rows).collect():
        m = np.array(r.m)
        blocks = m[:, :, :4].reshape(3, 2, 2, 2, 2, 2).transpose(0, 2, 4, 1, 3, 5).reshape(12, 8)
        assert (m[:, :, 4] == 1).all() and (blocks.min(axis=1) == blocks.max(axis=1)).all() and (blocks == 0).all(axis=1).sum() == 6
        hits += m == 0
    assert hits[:, :, :4].min() > 10 and hits.max() < 40
    whole = im.mask_blocks("m", (6, 4, 5), (2, 2, 2), 3, "id", share=1.0)(rows).first().m
    assert (np.array(whole)[:, :, :4] == 0).all() and im.mask_blocks("m", (6, 4, 5), (2, 2, 2), 3, "id", share=0.0)(rows).first().m == rows.first().m


def test_nested_and_stacked_are_inverse():
    images = [np.arange(6.0).reshape(1, 2, 3), None, np.arange(8.0).reshape(2, 2, 2)]
    column = im.nested(images, 3)
    assert column.to_pylist() == [None if x is None else x.tolist() for x in images]
    for part in (column, pa.concat_arrays([column, column]).slice(2, 3)):
        for rows, stack in im.stacks(part, 3):
            assert stack.tolist() == [part[i].as_py() for i in rows]


def test_crops_flips_and_squeezed_axes(spark):
    rng = np.random.default_rng(5)
    a, b = rng.random((5, 4)), rng.random((2, 7))
    got = run(spark, [a, b, None], im.crop_or_pad("m", (3, 5), (1.0, 0.0), fill=-2.0))
    assert np.array(got[0].m)[:, :4] == pytest.approx(a[2:]) and (np.array(got[0].m)[:, 4] == -2).all() and got[2].m is None
    assert np.array(got[1].m)[:2] == pytest.approx(b[:, :5]) and (np.array(got[1].m)[2] == -2).all()
    cubes = spark.createDataFrame([(i, rng.random((6, 5, 4)).tolist()) for i in range(30)], "id int, m array<array<array<double>>>").withColumn("s", F.col("m"))
    before = {r.id: np.array(r.m) for r in cubes.collect()}
    sizes = set()
    for r in im.random_crop(["m", "s"], 3, 1, "id", fixed=[0])(cubes).collect():
        m, whole = np.array(r.m), before[r.id]
        assert r.m == r.s and m.shape[0] == 6
        assert any((whole[:, y : y + m.shape[1], x : x + m.shape[2]] == m).all() for y in range(5) for x in range(4) if whole[:, y : y + m.shape[1], x : x + m.shape[2]].shape == m.shape)
        sizes.add(m.shape)
    assert len(sizes) > 2
    exact = im.random_crop(["m"], 3, 1, "id", scale=None, shape=(2, 2, 2))(cubes).collect()
    assert {np.array(r.m).shape for r in exact} == {(2, 2, 2)}
    flips = set()
    for r in im.random_flip(["m", "s"], 3, 2, "id")(cubes).collect():
        found = [axes for axes in ((), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)) if (np.flip(before[r.id], axes) == np.array(r.m)).all()]
        assert r.m == r.s and len(found) == 1
        flips.add(found[0])
    assert len(flips) > 4
    four = rng.random((2, 3, 4, 5))
    for axis, order in {1: (0, 1, 2, 3), 2: (0, 2, 1, 3), 3: (0, 3, 1, 2)}.items():
        rows = im.squeeze_axis("m", axis)(spark.createDataFrame([(four.tolist(),)], "m array<array<array<array<double>>>>"))
        assert np.array(rows.first().m) == pytest.approx(four.transpose(order).reshape(-1, *four.transpose(order).shape[2:]))
        assert np.array(im.unsqueeze_axis("m", axis, 2)(rows).first().m) == pytest.approx(four)
