"""Key-paths are flat, dotted column names; these helpers quote, find, nest and flatten them."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class KeyPathError(KeyError):
    """A key-path that a table does not have; names the closest ones."""


def col(path: str) -> Column:
    return F.col("`" + path.replace("`", "``") + "`")


def under(df: DataFrame, path: str) -> list[str]:
    """The column `path` and those below it, in table order."""
    return [c for c in df.columns if c == path or c.startswith(path + ".")]


def closest(df: DataFrame, path: str, n: int = 3) -> list[str]:
    """The most similar of all key-paths and their beginnings."""
    parts = {".".join(c.split(".")[: i + 1]) for c in df.columns for i in range(len(c.split(".")))}
    return difflib.get_close_matches(path, sorted(parts), n=n, cutoff=0)


def need(df: DataFrame, *paths: str) -> None:
    for p in paths:
        if not under(df, p):
            raise KeyPathError(f"no key-path {p!r}; closest: {closest(df, p)}")


def has(df: DataFrame, path: str) -> bool:
    return bool(under(df, path))


def top_level(df: DataFrame) -> list[str]:
    return list(dict.fromkeys(c.split(".")[0] for c in df.columns))


def sub_tree(df: DataFrame, path: str) -> DataFrame:
    """The columns below `path`, without that beginning."""
    need(df, path)
    return df.select(*(col(c).alias(c[len(path) + 1 :]) for c in under(df, path) if c != path))


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns as dotted columns, at every level."""

    def walk(kind: StructType, made: Column | None, name: str) -> Iterable[Column]:
        for f in kind.fields:
            at, full = (made.getField(f.name), f"{name}.{f.name}") if made is not None else (col(f.name), f.name)
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, at, full)
            else:
                yield at.alias(full)

    return df.select(*walk(df.schema, None, ""))


def nest(df: DataFrame) -> DataFrame:
    """Dotted columns as structs; a path that is a value and a beginning at once is an error."""
    tree: dict = {}
    for c in df.columns:
        *way, leaf = c.split(".")
        at = tree
        for step in way:
            at = at.setdefault(step, {})
            if not isinstance(at, dict):
                raise ValueError(f"{c!r} is below the value {step!r}")
        if leaf in at:
            raise ValueError(f"{c!r} is a value and a beginning")
        at[leaf] = col(c)

    def build(node) -> Column:
        return F.struct(*(build(v).alias(k) for k, v in node.items())) if isinstance(node, dict) else node

    return df.select(*(build(v).alias(k) for k, v in tree.items()))


def on_all(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return df.select(*(f(col(c)).alias(c) for c in df.columns))


def tree_text(df: DataFrame) -> str:
    """One line per step of the key-paths, indented with --- per level."""
    seen: dict[str, None] = {}
    for c in df.columns:
        way = c.split(".")
        for i in range(len(way)):
            seen.setdefault("\0".join(way[: i + 1]))
    return "\n".join("---" * s.count("\0") + s.split("\0")[-1] for s in seen)


def put(df: DataFrame, path: str, value: Column) -> DataFrame:
    return df.withColumn(path, value)


def uniform(seed: object, *keys: Column | str) -> Column:
    """A double in [0, 1), of 52 bits, that depends on the seed and the keys alone."""
    parts = [F.lit(str(seed)), *((col(k) if isinstance(k, str) else k).cast("string") for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def one_hot(value: Column, classes: int) -> Column:
    """Doubles, one per class; a negative class counts from the end, any other outside is an error."""
    at = F.when(value < 0, value + classes).otherwise(value)
    vector = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == at, 1.0).otherwise(0.0))
    return F.when((at < 0) | (at >= classes), F.raise_error(F.concat(F.lit("class out of range: "), value.cast("string")))).when(value.isNotNull(), vector)


def argmax(vector: Column) -> Column:
    """The first place of the largest element, from 0."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("long")


def digitize(value: Column, edges: Column) -> Column:
    """How many edges are at most the value."""
    return F.size(F.filter(edges, lambda e: e <= value)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return a.cast("double") / F.when(b != 0, b.cast("double"))


def round_signed(x: Column, digits: int) -> Column:
    """A double at so many places as C and SQL engines round it: x * 10^digits to the nearest whole number, ties away from 0, and back;
    what rounds to 0 keeps its sign (Spark's own round works on decimals, which have no -0)."""
    step = F.lit(10.0**digits)
    return F.signum(x) * F.round(F.abs(x * step)) / step


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double"))


def softmax(vector: Column, temperature: float = 1.0) -> Column:
    if not temperature > 0:
        raise ValueError("temperature must be above 0")
    # the maximum and the total are bound once, not computed anew for each element
    def shared(value: Column, use: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def scaled(top: Column) -> Column:
        return shared(F.transform(vector, lambda x: F.exp((x.cast("double") - top) / F.lit(float(temperature)))), lambda e: shared(total(e), lambda t: F.transform(e, lambda x: x / t)))

    return shared(F.array_max(vector).cast("double"), scaled)
