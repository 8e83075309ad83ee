"""Steps that choose, repeat, draw, split and drop."""

from __future__ import annotations

import enum
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, put, uniform
from ..functions.storage import cut
from .base import Op, op

ID, INITIAL = "data.sample_id", "data.initial_sample_id"
#: Good rows that are sent to all tasks when failed rows draw from them; more are joined where they lie.
FEW = 1024


def gated(df: DataFrame, step: Op, on: Column, undo: str | None = None) -> DataFrame:
    """The step's columns where `on` holds, the former ones elsewhere (null for new ones)."""
    before = df.withColumns({"__on": F.coalesce(on, F.lit(False)), "__old": F.struct(*(col(c).alias(c) for c in df.columns))})
    after = step(before)
    gone = [c for c in df.columns if c not in after.columns]
    if gone:
        raise ValueError(f"a gated step cannot drop columns: {gone}")
    new = [c for c in after.columns if c not in ("__on", "__old")]
    out = after.select(*(F.when(col("__on"), col(c)).otherwise(F.col("__old").getField(c) if c in df.columns else F.lit(None)).alias(c) for c in new), *([F.col("__on").alias(undo)] if undo else []))
    return out


@op
def when(df: DataFrame, step: Op, condition: str | bool | Column) -> DataFrame:
    """Applies the step to the samples that meet the condition (a column or a constant)."""
    if isinstance(condition, bool):
        return step(df) if condition else df
    return gated(df, step, col(condition) if isinstance(condition, str) else condition)


@op
def repeat(df: DataFrame, make: Callable[..., Op], per_step: Sequence[Mapping], **shared) -> DataFrame:
    """The step once per set of parameters; a step's own come first."""
    for own in per_step:
        df = make(**{**shared, **own})(df)
    return df


class Patterns:
    """The value of the first regular expression that matches a key-path from its beginning."""

    def __init__(self, values: Mapping[str, object], default: object = None) -> None:
        self.values, self.default = dict(values), default

    def __call__(self, path: str):
        return next((v for p, v in self.values.items() if re.match(p, path)), self.default)

    def verify(self, paths: Sequence[str]) -> None:
        lost = [p for p in paths if self(p) is None]
        if lost:
            raise ValueError(f"no pattern matches {lost}")

    def __repr__(self) -> str:
        return f"Patterns({self.values!r}, {self.default!r})"


class DataType(enum.Enum):
    UNKNOWN = 0
    IMAGE = 1
    SEGMENTATION = 2
    BOX = 3
    LABEL = 4


@op
def by_pattern(df: DataFrame, steps: Mapping[str, Callable[[str], Op] | None]) -> DataFrame:
    """For every column the step that its first matching pattern makes from its name."""
    find = Patterns(steps)
    for c in list(df.columns):
        make = find(c)
        if make is not None:
            df = make(c)(df)
    return df


@op
def by_type(df: DataFrame, steps: Mapping[DataType, Callable[[str], Op]], detect: Patterns) -> DataFrame:
    """As by_pattern, by the type that the key-path's name has."""
    for c in list(df.columns):
        make = steps.get(detect(c))
        if make is not None:
            df = make(c)(df)
    return df


# -- draws: pure functions of seed, sample id and place --------------------------------


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float

    def draw(self, u: Callable[[str], Column]) -> Column:
        return F.lit(float(self.low)) + u("u") * F.lit(float(self.high - self.low))


@dataclass(frozen=True)
class RandInt:
    """Both ends included."""

    low: int
    high: int

    def draw(self, u) -> Column:
        return (F.lit(self.low) + F.floor(u("u") * (self.high - self.low + 1))).cast("long")


@dataclass(frozen=True)
class RandBool:
    probability: float = 0.5

    def draw(self, u) -> Column:
        return u("u") <= F.lit(float(self.probability))


@dataclass(frozen=True)
class Choice:
    """One of `values`, or k of them with replacement."""

    values: tuple
    weights: tuple[float, ...] | None = None
    k: int = 0

    def draw(self, u) -> Column:
        options = F.array(*map(F.lit, self.values))
        share = [w / sum(self.weights) for w in self.weights] if self.weights else [1 / len(self.values)] * len(self.values)
        borders = [sum(share[: i + 1]) for i in range(len(share) - 1)]

        def one(x):
            return F.get(options, sum((F.when(x >= F.lit(b), 1).otherwise(0) for b in borders), F.lit(0)))

        return F.array(*(one(u(str(i))) for i in range(self.k))) if self.k else one(u("u"))


@dataclass(frozen=True)
class Gaussian:
    mean: float = 0.0
    std: float = 1.0
    size: int = 0

    def draw(self, u) -> Column:
        def one(i):
            return F.lit(float(self.mean)) + F.lit(float(self.std)) * F.sqrt(-2 * F.log(1 - u(f"{i}a"))) * F.cos(u(f"{i}b") * F.lit(6.283185307179586))

        return F.array(*(one(i) for i in range(self.size))) if self.size else one(0)


SAMPLERS = (Uniform, RandInt, RandBool, Choice, Gaussian)


def drawn(value, seed: object, key: str, place: str = ""):
    """`value` with every sampler in it, at any depth, replaced by a column."""
    if isinstance(value, SAMPLERS):
        return value.draw(lambda s: uniform(f"{seed}/{place}/{s}", key))
    if isinstance(value, Mapping):
        return {k: drawn(v, seed, key, f"{place}.{k}") for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return type(value)(drawn(v, seed, key, f"{place}.{i}") for i, v in enumerate(value))
    return value


@op
def rand_apply(df: DataFrame, step: Op, probability: float, seed: object, key: str = ID, undo: str | None = None) -> DataFrame:
    """Applies the step to a share of the samples; `undo` names a column that keeps the decision."""
    return gated(df, step, uniform(seed, key) <= F.lit(float(probability)), undo)


@op
def sample(df: DataFrame, make: Callable[..., Op], seed: object, key: str = ID, **kwargs) -> DataFrame:
    """The step with drawn parameters."""
    return make(**drawn(kwargs, seed, key))(df)


@op
def sample_and_repeat(df: DataFrame, make: Callable[..., Op], per_step: Sequence[Mapping], seed: object, key: str = ID, **kwargs) -> DataFrame:
    """One draw for all repeats."""
    shared = drawn(kwargs, seed, key)
    for own in per_step:
        df = make(**{**shared, **own})(df)
    return df


@op
def repeat_and_sample(df: DataFrame, make: Callable[..., Op], per_step: Sequence[Mapping], seed: object, key: str = ID, **kwargs) -> DataFrame:
    """A draw of its own for each repeat."""
    for i, own in enumerate(per_step):
        df = make(**{**drawn(kwargs, f"{seed}/{i}", key), **own})(df)
    return df


@op
def random_choice(df: DataFrame, to: str, values: Sequence, seed: object, key: str = ID) -> DataFrame:
    return put(df, to, Choice(tuple(values)).draw(lambda s: uniform(seed, key)))


@op
def crop_text(df: DataFrame, source: str, to: str, ratio: float, seed: object, side: str = "right", key: str = ID) -> DataFrame:
    """Drops int(length * u * ratio) characters on the left, right, or either (drawn); u is from [0, 1)."""
    n = F.floor(F.length(col(source)) * uniform(seed, key) * F.lit(float(ratio))).cast("int")
    left, right = F.substr(col(source), n + 1), F.substr(col(source), F.lit(1), F.length(col(source)) - n)
    both = F.when(uniform(f"{seed}/side", key) < 0.5, left).otherwise(right)
    return put(df, to, {"left": left, "right": right, "both": both}[side])


@op
def augment_one_hot(df: DataFrame, key: str, at: int | None = None, frozen: Sequence[int] = (), seed: object = 0, id_key: str = ID) -> DataFrame:
    """Sets class `at`; or moves the class by one, up or down by a drawn bit, unless it is frozen; never outside."""
    v = col(key)
    now = F.array_position(v, F.array_max(v)) - 1
    if at is None:
        step = F.when(uniform(seed, id_key) < 0.5, -1).otherwise(1)
        moved = F.when(now.isin(list(frozen)), now).otherwise(now + step) if frozen else now + step
        new = F.least(F.greatest(moved, F.lit(0)), F.size(v) - 1)
    else:
        new = F.least(F.greatest(F.lit(at), F.lit(0)), F.size(v) - 1)
    return put(df, key, F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda i: F.when(i == new, 1.0).otherwise(0.0)))


@op
def gaussian_noise(df: DataFrame, key: str, mean: float, std: float, seed: object, id_key: str = ID) -> DataFrame:
    def noise(x, i):
        u = [uniform(f"{seed}/{s}", col(id_key), i) for s in "ab"]
        return x + F.lit(float(mean)) + F.lit(float(std)) * F.sqrt(-2 * F.log(1 - u[0])) * F.cos(u[1] * F.lit(6.283185307179586))

    return put(df, key, F.transform(col(key), noise))


# -- one sample to many or none --------------------------------------------------------


@op
def split(df: DataFrame, pieces: Column | int, key: str = ID, piece: str = "data.piece") -> DataFrame:
    """One sample per element of an array (or per number below a count); its id is a struct of the old id and the place."""
    array = F.sequence(F.lit(0), F.lit(pieces - 1)) if isinstance(pieces, int) else pieces
    rest = [c for c in df.columns if c not in (key, piece, INITIAL)]
    initial = col(INITIAL) if INITIAL in df.columns else col(key)
    out = df.select(*map(col, rest), col(key).alias("__id"), initial.alias(INITIAL), F.posexplode(array).alias("__at", piece))
    return out.withColumn(key, F.struct(F.col("__id").alias("id"), F.col("__at").alias("at"))).drop("__id", "__at")


@op
def drop_if(df: DataFrame, condition: Column, siblings: bool = True) -> DataFrame:
    """Drops samples; of a split sample all pieces go if one does, unless `siblings` is False."""
    if siblings and INITIAL in df.columns:
        lost = df.where(F.coalesce(condition, F.lit(False))).select(col(INITIAL).alias("__lost")).distinct()
        return df.join(lost, col(INITIAL) == F.col("__lost"), "left_anti")
    return df.where(~F.coalesce(condition, F.lit(False)))


@op
def replace_failed(df: DataFrame, failed: Column, seed: object, key: str = ID, buckets: int | None = None) -> DataFrame:
    """Rows that failed get the values of a drawn good row; ids stay.

    Each good row is as likely as any other: good rows are numbered in the order of their keys, and a failed row draws a number.
    With `buckets`, good rows are dealt to so many by hash instead; a failed row takes the first good row of its drawn bucket or,
    if that is empty, of the next one that is not (one window over the small table of buckets, the last of which are followed by the first)."""
    rest = [c for c in df.columns if c != key]
    bad = F.coalesce(failed, F.lit(True))
    row = F.struct(*(col(c).alias(c) for c in rest))
    if buckets is None:
        # maps have no hash; rows of one key that differ in nothing else may change places
        tie = [col(c) for c, kind in df.dtypes if c != key and "map<" not in kind]
        # a sorted partition's rows have consecutive numbers below 2^33
        ring = cut(df.where(~bad).sort(col(key), F.xxhash64(F.lit(0), *tie)).select(F.monotonically_increasing_id().alias("n"), row.alias("row")))
        sizes = sorted(ring.groupBy(F.shiftright("n", 33).alias("part")).count().collect())
        starts = [(r[0], sum(x[1] for x in sizes[:i])) for i, r in enumerate(sizes)]
        total = sum(r[1] for r in sizes)
        before = df.sparkSession.createDataFrame(starts, "part long, before long")
        ring = ring.join(F.broadcast(before), F.shiftright("n", 33) == F.col("part")).select((F.col("before") + F.col("n").bitwiseAND(F.lit((1 << 33) - 1))).alias("at"), "row")
        # few good rows are many failed rows' own: they travel instead of them
        ring = F.broadcast(ring) if total <= FEW else ring
        target = F.floor(uniform(f"{seed}/bad", key) * F.lit(float(total))).cast("long")
    else:
        pick = F.min_by(row, F.struct(uniform(seed, key), col(key)))
        good = df.where(~bad).groupBy(F.floor(uniform(f"{seed}/good", key) * buckets).cast("int").alias("b")).agg(pick.alias("row"))
        at = df.sparkSession.range(2 * buckets).select(F.col("id").cast("int").alias("at"))
        ring = at.join(F.broadcast(good), F.col("at") % buckets == F.col("b"), "left")
        here = F.first("row", ignorenulls=True).over(Window.orderBy("at").rowsBetween(0, Window.unboundedFollowing))
        ring = F.broadcast(ring.select("at", here.alias("row")).where(F.col("at") < buckets).where("row is not null"))
        target = F.floor(uniform(f"{seed}/bad", key) * buckets).cast("int")
    fixed = df.where(bad).withColumn("__b", target).join(ring, F.col("__b") == F.col("at")).select(col(key), *(F.col("row").getField(c).alias(c) for c in rest))
    return df.where(~bad).unionByName(fixed)
