"""Queries of the steps on images: embeddings as images of 8 x 8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import col, uniform
from ..operators import images as im
from ..operators.samples import matrix
from .base import query, rounded_vector, uniform_sql


def pictures(read):
    return matrix("embedding", "m", 8)(read("embeddings"))


def flat(df, key="m"):
    return df.select("vec_id", F.flatten(col(key)).alias("v")).select("vec_id", rounded_vector("v"))


CELL = "list_transform(range({n}), lambda k: round({value}, 6) + 0e0) AS v"


def pixel(y: str, x: str) -> str:
    return f"CAST(embedding[CAST({y} AS INTEGER) * 8 + CAST({x} AS INTEGER) + 1] AS DOUBLE)"


@query(f"SELECT vec_id, {CELL.format(n=60, value=pixel('least(floor((k // 12 + 0.5e0) * 8 / 5), 7)', 'least(floor((k % 12 + 0.5e0) * 8 / 12), 7)'))} FROM embeddings")
def resize_nearest(read):
    return flat(im.resize("m", (5, 12), method="nearest")(pictures(read)))


def _line(o: str, m: int) -> tuple[str, str, str]:
    """Both neighbours of a new place on an axis of 8, mirrored at the ends, and the second's weight."""
    at = f"(({o} + 0.5e0) * 8 / {m} - 0.5e0)"
    turned = lambda i: f"(CASE WHEN {i} < 0 THEN -({i}) WHEN {i} > 7 THEN 14 - ({i}) ELSE {i} END)"
    return turned(f"floor({at})"), turned(f"(floor({at}) + 1)"), f"({at} - floor({at}))"


_Y, _X = _line("(k // 12)", 5), _line("(k % 12)", 12)
LINEAR = " + ".join(f"{pixel(_Y[a], _X[b])} * {_Y[2] if a else f'(1 - {_Y[2]})'} * {_X[2] if b else f'(1 - {_X[2]})'}" for a in (0, 1) for b in (0, 1))


@query(f"SELECT vec_id, {CELL.format(n=60, value=LINEAR)} FROM embeddings")
def resize_linear(read):
    return flat(im.resize("m", (5, 12), smooth=False)(pictures(read)))


# standard deviation 1/2 from 8 to 4: two elements on either side
@query("""WITH g AS (SELECT vec_id, k, list_transform(range(8), lambda i: CAST(embedding[k * 8 + i + 1] AS DOUBLE)) AS r FROM embeddings, (SELECT unnest(range(8)) AS k)),
b AS (SELECT list_transform(range(-2, 3), lambda t: exp(-2e0 * t * t)) AS e), w AS (SELECT list_transform(e, lambda x: x / list_sum(e)) AS w FROM b),
s AS (SELECT vec_id, k, list_transform(range(8), lambda i: list_sum(list_transform(range(-2, 3), lambda t: w[t + 3] * r[CASE WHEN i + t < 0 THEN -(i + t) WHEN i + t > 7 THEN 14 - (i + t) ELSE i + t END + 1]))) AS r FROM g, w),
h AS (SELECT vec_id, list(list_transform(range(4), lambda o: (r[2 * o + 1] + r[2 * o + 2]) / 2) ORDER BY k) AS m FROM s GROUP BY vec_id),
t AS (SELECT vec_id, list_transform(range(8), lambda i: list_transform(range(4), lambda o: list_sum(list_transform(range(-2, 3), lambda t: w[t + 3] * m[CASE WHEN i + t < 0 THEN -(i + t) WHEN i + t > 7 THEN 14 - (i + t) ELSE i + t END + 1][o + 1])))) AS m FROM h, w)
SELECT vec_id, flatten(list_transform(range(4), lambda p: list_transform(range(4), lambda o: round((m[2 * p + 1][o + 1] + m[2 * p + 2][o + 1]) / 2, 6) + 0e0))) AS v FROM t""")
def resize_smooth(read):
    return flat(im.resize("m", (4, 4))(pictures(read)))


NUMBERS = {"angle": "({} - 0.5e0) * 90", "right": "({} - 0.5e0) * 4", "down": "({} - 0.5e0) * 4", "size": "0.8e0 + 0.4e0 * {}", "slant": "({} - 0.5e0) * 20"}
AFFINE = f"""WITH p AS (SELECT vec_id, embedding, {", ".join(f"{e.format(uniform_sql('11', f"'{n}'", 'vec_id'))} AS {n}" for n, e in NUMBERS.items())} FROM embeddings),
c AS (SELECT *, k % 8 + 0.5e0 - 4 - right_ AS x, k // 8 + 0.5e0 - 4 - down AS y, cos(radians(angle)) AS co, sin(radians(angle)) AS si FROM (SELECT * EXCLUDE ("right"), "right" AS right_, unnest(range(64)) AS k FROM p)),
u AS (SELECT *, (co * x + si * y + tan(radians(slant)) * (co * y - si * x)) / size + 4 AS sx, (co * y - si * x) / size + 4 AS sy FROM c),
n AS (SELECT *, floor(sx - 0.5e0) AS l, floor(sy - 0.5e0) AS t, sx - 0.5e0 - floor(sx - 0.5e0) AS dx, sy - 0.5e0 - floor(sy - 0.5e0) AS dy FROM u),
v AS (SELECT vec_id, k, CASE WHEN sx >= 0 AND sx < 8 AND sy >= 0 AND sy < 8 THEN {" + ".join(f"{pixel(f'least(greatest(t + {a}, 0), 7)', f'least(greatest(l + {b}, 0), 7)')} * {'dy' if a else '(1 - dy)'} * {'dx' if b else '(1 - dx)'}" for a in (0, 1) for b in (0, 1))} ELSE 0e0 END AS v FROM n)
SELECT vec_id, list(round(v, 6) + 0e0 ORDER BY k) AS v FROM v GROUP BY vec_id""".replace("AS right,", 'AS "right",')


@query(AFFINE)
def augment_affine(read):
    u = lambda n: uniform("11", F.lit(n), "vec_id")
    step = im.affine("m", rotate=(u("angle") - 0.5) * 90, translate=((u("right") - 0.5) * 4, (u("down") - 0.5) * 4), scale=F.lit(0.8) + F.lit(0.4) * u("size"), shear=(u("slant") - 0.5) * 20)
    return flat(step(pictures(read)))


@query("""WITH RECURSIVE b AS (SELECT vec_id, y, x, list_avg(flatten(list_transform(range(y * 2, least(y * 2 + 2, 7)), lambda i: list_transform(range(x * 2, least(x * 2 + 2, 7)), lambda j: CAST(embedding[i * 8 + j + 1] AS DOUBLE))))) > 0.02e0 AS fine FROM embeddings, (SELECT unnest(range(4)) AS y), (SELECT unnest(range(4)) AS x)),
r AS (SELECT vec_id, y * 4 + x AS a, y, x FROM b WHERE fine UNION SELECT r.vec_id, a, b.y, b.x FROM r JOIN b ON b.vec_id = r.vec_id AND b.fine AND abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1),
l AS (SELECT vec_id, y, x, min(a) AS label FROM r GROUP BY vec_id, y, x), g AS (SELECT vec_id, label, count(*) AS n, min(y) AS t, min(x) AS l, max(y) AS bt, max(x) AS rt FROM l GROUP BY vec_id, label QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, label) = 1)
SELECT e.vec_id, CASE WHEN g.n IS NULL THEN [0, 0, 7, 7] ELSE [t * 2, l * 2, least((bt + 2) * 2, 7), least((rt + 2) * 2, 7)] END AS box FROM embeddings e LEFT JOIN g USING (vec_id)""")
def biggest_box(read):
    return im.biggest_box("m", "box", threshold=0.02, blocks=4)(pictures(read)).select("vec_id", "box")


@query(f"""WITH r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY {uniform_sql("mask", "vec_id", "i")}, i) <= 4 AS hit FROM embeddings, (SELECT unnest(range(8)) AS i)), s AS (SELECT vec_id, list(hit ORDER BY i) AS hit FROM r GROUP BY vec_id)
SELECT vec_id, list_transform(range(64), lambda k: CASE WHEN k // 8 < 6 AND hit[CAST(k // 24 * 4 + k % 8 // 2 + 1 AS INTEGER)] THEN 0e0 ELSE round(CAST(embedding[k + 1] AS DOUBLE), 6) + 0e0 END) AS v FROM embeddings JOIN s USING (vec_id)""")
def mask_blocks(read):
    return flat(im.mask_blocks("m", (8, 8), (3, 2), "mask", "vec_id", share=0.3)(pictures(read)))


@query(f"SELECT vec_id, list_transform(range(60), lambda k: CASE WHEN k % 10 < 8 THEN round({pixel('(k // 10 + 1)', '(k % 10)')}, 6) + 0e0 ELSE -1e0 END) AS v FROM embeddings")
def crop_or_pad(read):
    return flat(im.crop_or_pad("m", (6, 10), 0.5, fill=-1.0)(pictures(read)))


_S, _R, _C = (uniform_sql(f"4/{p}", "vec_id") for p in ("scale", "0", "1"))


@query(f"""WITH s AS (SELECT vec_id, embedding, CAST(round_even((0.4e0 + {_S} * 0.6e0) * 8, 0) AS BIGINT) AS n FROM embeddings), a AS (SELECT *, CAST(floor({_R} * (8 - n + 1)) AS BIGINT) AS y, CAST(floor({_C} * (8 - n + 1)) AS BIGINT) AS x FROM s)
SELECT vec_id, list_transform(range(n * n), lambda k: round(CAST(embedding[CAST((y + k // n) * 8 + x + k % n + 1 AS INTEGER)] AS DOUBLE), 6) + 0e0) AS v FROM a""")
def random_crop(read):
    return flat(im.random_crop(["m"], 2, 4, "vec_id", scale=(0.4, 1.0))(pictures(read)))


@query(f"SELECT vec_id, list_transform(range(64), lambda k: round({pixel(f'(CASE WHEN {uniform_sql("7/0", "vec_id")} < 0.5e0 THEN 7 - k // 8 ELSE k // 8 END)', f'(CASE WHEN {uniform_sql("7/1", "vec_id")} < 0.5e0 THEN 7 - k % 8 ELSE k % 8 END)')}, 6) + 0e0) AS v FROM embeddings")
def random_flip(read):
    return flat(im.random_flip(["m"], 2, 7, "vec_id")(pictures(read)))


@query("SELECT vec_id, list_transform(range(64), lambda k: round(CAST(embedding[CAST(k // 32 * 32 + k % 4 // 1 % 4 * 0 + (k % 8 // 4) * 16 + (k % 32 // 8) * 1 * 4 + k % 4 + 1 AS INTEGER)] AS DOUBLE), 6) + 0e0) AS v, true AS back FROM embeddings")
def squeeze_axis(read):
    cut = lambda x, n: F.transform(F.sequence(F.lit(0), (F.size(x) / n).cast("int") - 1), lambda i: F.slice(x, i * n + 1, F.lit(n)))
    # 2 channels of 2 x 4 x 4
    rows = read("embeddings").select("vec_id", cut(cut(cut(F.col("embedding").cast("array<double>"), 4), 4), 2).alias("m"))
    out = im.unsqueeze_axis("q", 2, 2, to="b")(im.squeeze_axis("m", 2, to="q")(rows))
    return out.select("vec_id", F.flatten(F.flatten("q")).alias("v"), (F.col("b") == F.col("m")).alias("back")).select("vec_id", rounded_vector("v"), "back")


@query("SELECT vec_id, list_transform(range(192), lambda k: CAST(CASE WHEN embedding[k % 64 + 1] > 0.05 THEN 2 WHEN embedding[k % 64 + 1] > 0 THEN 1 ELSE 0 END = k // 64 AS INTEGER)) AS v FROM embeddings")
def classes_apart(read):
    level = lambda x: F.when(x > F.lit(0.05).cast("float"), 2).when(x > 0, 1).otherwise(0)
    rows = matrix("levels", "m", 8)(read("embeddings").select("vec_id", F.transform("embedding", level).alias("levels")))
    return im.classes_apart("m", 3)(rows).select("vec_id", F.flatten(F.flatten("m")).alias("v"))


@query("SELECT vec_id, list_transform(range(8), lambda k: round(CAST(embedding[(vec_id % 8) * 8 + k + 1] AS DOUBLE), 6) + 0e0) AS crop_0, list_transform(range(8), lambda k: round(CAST(embedding[(vec_id % 8) * 8 + k + 1] AS DOUBLE), 6) + 0e0) AS crop_1 FROM embeddings WHERE len(list_filter(range(4, 8), lambda j: embedding[(vec_id % 8) * 8 + j + 1] > 0.12)) > 0")
def pick_slice(read):
    # slices of one row; the mask's slice has two rows of four
    mask = F.transform("m", lambda r: F.transform(F.array(F.slice(r, 1, 4), F.slice(r, 5, 4)), lambda p: F.transform(p, lambda x: (x > F.lit(0.12).cast("float")).cast("int"))))
    rows = pictures(read).withColumns({"mask": mask, "at": (F.col("vec_id") % 8).cast("int")})
    out = im.copies("m", 2)(im.pick_slice("m", "mask", "at", drop_blank=True)(rows))
    return out.select("vec_id", rounded_vector("crop_0"), rounded_vector("crop_1"))


def _corner(o: str, m: int) -> tuple[str, str, str]:
    at = f"({o} * 7 / {m - 1}e0)"
    low = f"least(floor({at}), 6)"
    return low, f"({low} + 1)", f"({at} - {low})"


_YC, _XC = _corner("(k // 12)", 5), _corner("(k % 12)", 12)
CORNERS = " + ".join(f"{pixel(_YC[a], _XC[b])} * {_YC[2] if a else f'(1 - {_YC[2]})'} * {_XC[2] if b else f'(1 - {_XC[2]})'}" for a in (0, 1) for b in (0, 1))


@query(f"SELECT vec_id, {CELL.format(n=60, value=CORNERS)} FROM embeddings")
def zoom_linear(read):
    return flat(im.resize("m", (5, 12), method="corners")(pictures(read)))


@query(f"SELECT vec_id, {CELL.format(n=60, value=pixel('floor(k // 12 * 7 / 4e0 + 0.5e0)', 'floor(k % 12 * 7 / 11e0 + 0.5e0)'))} FROM embeddings")
def zoom_nearest(read):
    return flat(im.resize("m", (5, 12), method="corners-nearest")(pictures(read)))
