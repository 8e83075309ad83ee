"""Steps that set, recode and combine the columns of a sample."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import columns as fc
from ..functions.columns import col, need, put, under
from .base import Op, op


@op(writes="", hides=lambda *paths: lambda key: not any(key == p or key.startswith(p + ".") for p in paths))
def keep(df: DataFrame, *paths: str) -> DataFrame:
    """Only these key-paths and what is below them; the id goes too unless listed."""
    need(df, *paths)
    return df.select(*(col(c) for c in dict.fromkeys(c for p in paths for c in under(df, p))))


@op(writes="", hides=lambda *paths: lambda key: any(key == p or key.startswith(p + ".") for p in paths))
def delete(df: DataFrame, *paths: str) -> DataFrame:
    need(df, *paths)
    return df.drop(*(c for p in paths for c in under(df, p)))


@op(writes="key")
def set_value(df: DataFrame, key: str, value) -> DataFrame:
    return put(df, key, value if isinstance(value, Column) else F.lit(value))


@op(reads="key", writes="key")
def set_if_absent(df: DataFrame, key: str, value) -> DataFrame:
    """Only where the table has no such column; a null that is there stays."""
    return df if fc.has(df, key) else put(df, key, F.lit(value))


@op(reads="source", writes="to")
def copy(df: DataFrame, source: str, to: str) -> DataFrame:
    need(df, source)
    return df.withColumns({to + c[len(source) :]: col(c) for c in under(df, source)})


@op(reads="source", writes="to")
def recode(df: DataFrame, source: str, to: str, values: Mapping, strict: bool = True) -> DataFrame:
    """Looks the value up; an unknown one stops the query, or leaves `to` as it was."""
    need(df, source)
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    new = F.element_at(table, col(source))
    if strict:
        new = F.when(F.map_contains_key(table, col(source)), new).otherwise(F.raise_error(F.concat(F.lit("unknown value "), F.coalesce(col(source).cast("string"), F.lit("null")))))
    elif to in df.columns:
        new = F.coalesce(new, col(to))
    return put(df, to, new)


@op(reads="source", writes="to")
def one_hot(df: DataFrame, source: str, to: str, classes: int) -> DataFrame:
    return put(df, to, fc.one_hot(col(source), classes))


@op(reads="key", writes="key")
def from_one_hot(df: DataFrame, key: str, classes: int, verify: bool = True) -> DataFrame:
    """The place of the one; a vector of another length or that is not one-hot stops the query."""
    v = col(key)
    good = (F.size(v) == classes) & (F.array_max(v) == 1) & (F.array_min(v) == 0) & (fc.total(v) == 1)
    place = fc.argmax(v)
    return put(df, key, F.when(good | v.isNull(), place).otherwise(F.raise_error(F.lit("not a one-hot vector"))) if verify else place)


@op(reads="sources", writes="to")
def concat(df: DataFrame, sources: Sequence[str], to: str, axis: int = 0) -> DataFrame:
    """Vectors end to end, single values as vectors of one; axis 1 joins the rows of matrices."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [col(s) if isinstance(kinds[s], ArrayType) else F.array(col(s)) for s in sources]
    if axis == 0:
        return put(df, to, F.concat(*parts))
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda a, b: F.concat(a, b))
    return put(df, to, out)


@op(reads="key", writes="key")
def fill_nan(df: DataFrame, key: str, value) -> DataFrame:
    """Numbers that are NaN; in a column of text, gaps."""
    if isinstance(df.schema[key].dataType, StringType):
        return put(df, key, F.coalesce(col(key), F.lit(value)))
    return put(df, key, F.when(F.isnan(col(key)), F.lit(value)).otherwise(col(key)))


@op(reads="key", writes="key")
def zscore(df: DataFrame, key: str, mean: float, std: float) -> DataFrame:
    """(x - mean) / std, null where std is 0; element by element for a vector."""

    def f(x):
        return fc.ratio(x - F.lit(mean), F.lit(float(std)))

    return put(df, key, F.transform(col(key), f) if isinstance(df.schema[key].dataType, ArrayType) else f(col(key)))


@op(reads="source", writes="to|source")
def replace(df: DataFrame, source: str, find, by, to: str | None = None) -> DataFrame:
    """Equal elements of a vector, or parts of a text."""
    kind = df.schema[source].dataType
    if isinstance(kind, ArrayType):
        return put(df, to or source, F.transform(col(source), lambda x: F.when(x == F.lit(find), F.lit(by)).otherwise(x)))
    if isinstance(kind, StringType):
        return put(df, to or source, F.replace(col(source), F.lit(find), F.lit(by)))
    raise TypeError(f"{source} is neither a vector nor a text")


@op(reads="source", writes="to|source")
def replace_any(df: DataFrame, source: str, find: Sequence, by, to: str | None = None) -> DataFrame:
    """Any of several elements of a vector, or any of several characters of a text."""
    kind = df.schema[source].dataType
    if isinstance(kind, ArrayType):
        return put(df, to or source, F.transform(col(source), lambda x: F.when(x.isin(list(find)), F.lit(by)).otherwise(x)))
    if isinstance(kind, StringType):
        return put(df, to or source, F.regexp_replace(col(source), "[" + "".join(re.escape(c) for c in find) + "]", re.sub(r"([\\$])", r"\\\1", by)))
    raise TypeError(f"{source} is neither a vector nor a text")


#: Names of casts and Spark types.
CASTS = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean"}


@op(reads="keys", writes="keys")
def cast(df: DataFrame, keys: str | Sequence[str], to: str) -> DataFrame:
    """int, float, str, bool or a Spark type, also of a vector's elements; int cuts towards zero. bytes to list: `byte_list`."""
    kind = CASTS.get(to, to)
    keys = [keys] if isinstance(keys, str) else keys
    return df.withColumns({k: col(k).cast(f"array<{kind}>" if isinstance(df.schema[k].dataType, ArrayType) else kind) for k in keys})


@op(reads="keys like", writes="keys")
def cast_like(df: DataFrame, keys: str | Sequence[str], like: str) -> DataFrame:
    """The keys in the type of another key."""
    kind = df.schema[like].dataType
    return df.withColumns({k: col(k).cast(kind) for k in ([keys] if isinstance(keys, str) else keys)})


@op(reads="key", writes="key")
def byte_list(df: DataFrame, key: str) -> DataFrame:
    """The bytes of a binary value as numbers."""
    digits = F.hex(col(key))
    at = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return put(df, key, F.transform(at, lambda i: F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("bigint")))


@op(reads="inputs", writes="outputs")
def apply(df: DataFrame, function: Callable[..., Column], inputs: Sequence[str], outputs: str | Sequence[str]) -> DataFrame:
    """function(columns) -> a column, or a struct (or several columns) for several outputs."""
    need(df, *inputs)
    made = function(*map(col, inputs))
    if isinstance(outputs, str):
        return put(df, outputs, made)
    if isinstance(made, Column):
        made = [made[i] for i in outputs]
    return df.withColumns(dict(zip(outputs, made, strict=True)))


@op(reads="height weight", writes="to")
def bmi(df: DataFrame, height: str, weight: str, to: str) -> DataFrame:
    """10000 * weight / height^2 where both are there, else null."""
    h, w = col(height).cast("double"), col(weight).cast("double")
    return put(df, to, F.when(~F.isnan(h) & ~F.isnan(w), fc.ratio(w * 10000, h * h)))


@op
def categorise(df: DataFrame, name: str, value: str, to: str, bins: Mapping[str, Sequence[float]]) -> DataFrame:
    """<name>_<number of the name's edges at most the value>; UNK for a name without edges."""
    table = F.create_map(*(x for k, v in bins.items() for x in (F.lit(k), F.array(*(F.lit(float(e)) for e in v)))))
    edges = F.element_at(table, col(name))
    return put(df, to, F.when(edges.isNull(), "UNK").otherwise(F.concat(col(name), F.lit("_"), fc.digitize(col(value), edges).cast("string"))))


@op(reads="source", writes="to")
def encode_category(df: DataFrame, source: str, to: str, values: Sequence) -> DataFrame:
    """One-hot by place in `values`; an unknown value or null is all zeros."""
    return put(df, to, F.array(*(F.coalesce((col(source) == F.lit(v)).cast("double"), F.lit(0.0)) for v in values)))


@op(reads="source", writes="to")
def encode_age(df: DataFrame, source: str, to: str, step: int = 20, limit: int = 120) -> DataFrame:
    """One-hot of age // step; a last class for ages that are missing, not above 0 or not below `limit`."""
    n = limit // step
    at = F.when((col(source) > 0) & (col(source) < limit), F.floor(col(source) / step)).otherwise(n)
    return put(df, to, fc.one_hot(at, n + 1))


@op(reads="flags", writes="to")
def label_from_flags(df: DataFrame, flags: Sequence[str], to: str) -> DataFrame:
    """The place of the last flag above zero, else 0."""
    return put(df, to, F.coalesce(F.greatest(*(F.when(col(f) > 0, i).otherwise(0) for i, f in enumerate(flags))), F.lit(0)).cast("long"))


@op(reads="source", writes="to")
def scale_checked(df: DataFrame, source: str, to: str, low: float, high: float, unit: float) -> DataFrame:
    """value / unit within (low, high), else -1."""
    return put(df, to, F.when((col(source) > low) & (col(source) < high), col(source) / F.lit(float(unit))).otherwise(-1.0))


@op(reads="sources", writes="to")
def compose(df: DataFrame, to: str, pattern: str, *sources: str) -> DataFrame:
    """Text from other columns, as for file names made of ids: each {} is filled in turn."""
    texts, parts = pattern.split("{}"), []
    if len(texts) != len(sources) + 1:
        raise ValueError("as many {} as columns are needed")
    for i, t in enumerate(texts):
        parts += [F.lit(t), *([col(sources[i]).cast("string")] if i < len(sources) else [])]
    return put(df, to, F.concat(*parts))


@op(reads="key", writes="key")
def clip(df: DataFrame, key: str, low: float = -math.inf, high: float = math.inf) -> DataFrame:
    return put(df, key, F.transform(col(key), lambda x: F.least(F.greatest(x.cast("double"), F.lit(float(low))), F.lit(float(high)))))


@op(reads="key", writes="key")
def normalise_self(df: DataFrame, key: str, top: float = 1.0) -> DataFrame:
    """(x - min) / (max - min) * top; null elements where all are equal."""
    low, high = F.array_min(col(key)).cast("double"), F.array_max(col(key)).cast("double")
    return put(df, key, F.transform(col(key), lambda x: fc.ratio((x - low) * F.lit(float(top)), high - low)))


@op(reads="key top_key", writes="key")
def normalise_percentile(df: DataFrame, key: str, target: tuple[float, float] = (0.0, 1.0), low: float = 0.0, high: float = 99.0, top_key: str | None = None) -> DataFrame:
    """A vector cut to its percentiles `low` and `high` (between elements by their distance) and mapped onto the target range
    from its own range or, with `top_key`, from 0 to that column; null where that range is empty."""

    def at(v, q: float):
        place = (F.size(v) - 1) * F.lit(q / 100.0)
        below = F.get(v, F.floor(place).cast("int"))
        return below + (F.get(v, F.ceil(place).cast("int")) - below) * (place - F.floor(place))

    def mapped(v, a, b):
        cut = F.transform(v, lambda x: F.least(F.greatest(x, a), b))
        first, last = (a, b) if top_key is None else (F.lit(0.0), col(top_key).cast("double"))
        return F.when(last != first, F.transform(cut, lambda x: (x - first) * (F.lit(float(target[1] - target[0])) / (last - first)) + F.lit(float(target[0]))))

    v = F.filter(col(key).cast("array<double>"), lambda x: x.isNotNull())
    # percentiles are bound once, not for each element
    pair = F.get(F.transform(F.array(F.array_sort(v)), lambda s: F.struct(at(s, low).alias("a"), at(s, high).alias("b"))), F.lit(0))
    return put(df, key, F.get(F.transform(F.array(pair), lambda p: mapped(v, p["a"], p["b"])), F.lit(0)))


@op(reads="key", writes="key")
def to_range(df: DataFrame, key: str, source: tuple[float, float], target: tuple[float, float]) -> DataFrame:
    """The linear map of one range onto another."""
    (a, b), (c, d) = source, target
    return put(df, key, F.transform(col(key), lambda x: (x.cast("double") - F.lit(float(a))) * F.lit((d - c) / (b - a)) + F.lit(float(c))))


@op(reads="key", writes="key")
def to_bytes_range(df: DataFrame, key: str) -> DataFrame:
    """0 to 255 by the vector's own range, cut to whole numbers."""
    out = normalise_self(key, 255.0)(df)
    return put(out, key, F.transform(col(key), lambda x: x.cast("int")))


@op(reads="key", writes="key")
def augment_colour(df: DataFrame, key: str, add: float = 0.0, mul: float = 1.0, gamma: float = 1.0, contrast: float = 1.0) -> DataFrame:
    """Adds, multiplies, raises and stretches around the mean, in this order; each is cut to [0, 1]."""

    def cut(x):
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))

    v = F.transform(col(key), lambda x: cut(x.cast("double") + F.lit(add)))
    v = F.transform(v, lambda x: cut(x * F.lit(mul)))
    v = F.transform(v, lambda x: cut(F.pow(x, F.lit(gamma))))
    out = put(df, key, v)
    mean = fc.ratio(fc.total(col(key)), F.size(col(key)))
    return put(out, key, F.transform(col(key), lambda x: cut((x - mean) * F.lit(contrast) + mean)))


@op(reads="key", writes="key")
def pad_vector(df: DataFrame, key: str, left: int, right: int, fill: float = 0.0) -> DataFrame:
    return put(df, key, F.concat(F.array_repeat(F.lit(float(fill)), left), col(key).cast("array<double>"), F.array_repeat(F.lit(float(fill)), right)))


@op(reads="key", writes="key")
def select_slice(df: DataFrame, key: str, at: int) -> DataFrame:
    """Element `at` (from 0) of the first axis."""
    return put(df, key, F.get(col(key), F.lit(at)))


@op(reads="key", writes="key")
def crop(df: DataFrame, key: str, start: Sequence[int], length: Sequence[int]) -> DataFrame:
    """A block of a nested vector; one start and length per axis."""

    def cut(x, i):
        x = F.slice(x, start[i] + 1, length[i])
        return x if i + 1 == len(start) else F.transform(x, lambda y: cut(y, i + 1))

    return put(df, key, cut(col(key), 0))


@op(reads="key", writes="key")
def flip(df: DataFrame, key: str, axis: int = 0) -> DataFrame:
    def turn(x, i):
        return F.reverse(x) if i == 0 else F.transform(x, lambda y: turn(y, i - 1))

    return put(df, key, turn(col(key), axis))


@op(reads="key", writes="key")
def bright_side_left(df: DataFrame, key: str) -> DataFrame:
    """Turns each row of a matrix if its right half holds more than its left."""

    def side(first):
        half = (F.size(F.get(col(key), F.lit(0))) / 2).cast("int")
        return fc.total(F.flatten(F.transform(col(key), lambda r: F.slice(r, F.lit(1) if first else half + 1, half if first else F.size(r) - half))))

    return put(df, key, F.when(side(False) > side(True), F.transform(col(key), lambda r: F.reverse(r))).otherwise(col(key)))


@op(reads="source", writes="to")
def matrix(df: DataFrame, source: str, to: str, width: int) -> DataFrame:
    """A vector cut into rows of `width`."""
    rows = F.sequence(F.lit(0), (F.size(col(source)) / width).cast("int") - 1)
    return put(df, to, F.transform(rows, lambda i: F.slice(col(source), i * width + 1, F.lit(width))))


@op(reads="key", writes="key")
def transpose(df: DataFrame, key: str) -> DataFrame:
    """Swaps the first two axes."""
    places = F.sequence(F.lit(0), F.size(F.get(col(key), F.lit(0))) - 1)
    return put(df, key, F.transform(places, lambda i: F.transform(col(key), lambda r: F.get(r, i))))


def chain(*ops: Op) -> Op:
    """Several steps as one."""

    def run(df: DataFrame) -> DataFrame:
        for o in ops:
            df = o(df)
        return df

    return Op("chain", tuple((str(i), str(o)) for i, o in enumerate(ops)), run)
