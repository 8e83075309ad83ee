"""Ordered steps over a table of samples."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import KeyPathError, col, under
from ..operators.attempts import stamped
from ..operators.base import UNDO, Op, remember


class StepError(RuntimeError):
    """Names the step that Spark could not plan."""


@dataclass
class Pipeline:
    """Steps with unique ids; a step that is named in `reversible` keeps the columns it overwrites."""

    name: str
    steps: list[tuple[str, Op]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._verify()

    def _verify(self) -> None:
        ids = [i for i, _ in self.steps]
        if len(ids) != len(set(ids)):
            raise ValueError(f"step ids repeat in {self.name}: {ids}")
        for i, o in self.steps:
            if not callable(o) or isinstance(o, type):
                raise TypeError(f"{self.name}.{i}: {o!r} is not a step; call its factory")

    @classmethod
    def of(cls, name: str, *ops: Op) -> Pipeline:
        return cls(name, [(f"{name}.{i}", o) for i, o in enumerate(ops)])

    def extend(self, *steps: tuple[str, Op]) -> None:
        self.steps += steps
        self._verify()

    def copy(self) -> Pipeline:
        return Pipeline(self.name, list(self.steps))

    def __call__(self, df: DataFrame, until: str | None = None, undo: Sequence[str] = ()) -> DataFrame:
        """Applies the steps, up to and without `until` if given; `undo`: ids whose steps can be reversed."""
        if until is not None and until not in dict(self.steps):
            raise KeyError(f"{self.name} has no step {until!r}")
        for i, o in self.steps:
            if i == until:
                break
            try:
                new = o(df)
                if i in undo:
                    both = remember(df, i, *(c for c in df.columns if not c.startswith(UNDO)))
                    new = o(both)
                new = stamped(new, f"{self.name}.{i}")
            except Exception as e:
                raise StepError(f"{self.name}.{i} ({o.name if isinstance(o, Op) else o}): {e}") from e
            df = new
        return df

    def slice(self, keys: Sequence[str], until: str | None = None) -> tuple[Pipeline, list[str] | None]:
        """The steps that the wanted keys need, and the key-paths that these need of the table before (None: all).

        From the last step back, a step that writes none of what is needed is left out; one that does makes what it
        reads needed. Steps that do not say what they write are kept, with all before them. A key that a step takes away is
        an error."""
        meet = lambda a, b: a == b or a.startswith(b + ".") or b.startswith(a + ".")
        steps = self.steps[: [i for i, _ in self.steps].index(until)] if until is not None else self.steps
        needed: set[str] | None = set(keys)
        kept: list[tuple[str, Op]] = []
        for i, o in reversed(steps):
            writes = o.writes if isinstance(o, Op) else None
            if writes is None or needed is None:
                needed = None
                kept.append((i, o))
                continue
            if o.hides is not None:
                gone = sorted(k for k in needed if o.hides(k))
                if gone:
                    raise KeyPathError(f"{self.name}.{i} takes away {gone}")
            elif any(meet(w, k) for w in writes for k in needed):
                kept.append((i, o))
                # what is written anew is no longer needed, unless only a part of it or more than it was wanted
                needed = None if o.reads is None else {k for k in needed if k not in writes} | set(o.reads)
        return Pipeline(self.name, kept[::-1]), None if needed is None else sorted(needed)

    def only(self, df: DataFrame, keys: Sequence[str], until: str | None = None) -> DataFrame:
        """The wanted keys of the samples, by the steps and columns that they need."""
        part, inputs = self.slice(keys, until)
        if inputs is not None:
            df = df.select(*(col(c) for c in df.columns if any(c in under(df, k) for k in inputs)))
        out = part(df)
        missing = [k for k in keys if not under(out, k)]
        if missing:
            raise KeyPathError(f"{self.name} does not make {missing}")
        return out.select(*(col(c) for k in keys for c in under(out, k)))

    def reverse(self, df: DataFrame, key: str, follow: str | None = None) -> DataFrame:
        """`key` as it was before the first reversible step that `follow` (or itself) went through."""
        follow = follow or key
        for i, _ in reversed(self.steps):
            kept = f"{UNDO}.{i}.{follow}"
            if kept in df.columns:
                df = df.withColumn(key, col(kept))
        return df

    @staticmethod
    def without_undo(df: DataFrame) -> DataFrame:
        return df.drop(*(c for c in df.columns if c.startswith(UNDO)))

    def __str__(self) -> str:
        return f"{self.name}: " + "; ".join(f"{i}={o}" for i, o in self.steps)

    @property
    def fingerprint(self) -> str:
        return hashlib.md5(str(self).encode()).hexdigest()


def described(df: DataFrame, sample: str, keys: Sequence[str] | None = None, samples: int | None = None) -> DataFrame:
    """(sample, key, type, length, content) of every key of samples, for a look at what a step makes: the length of texts, vectors
    and maps, and the content as text; of the first `samples` in the order of their ids, if so many are asked for."""
    keys = [c for c in df.columns if c != sample] if keys is None else list(keys)
    if samples is not None:
        df = df.orderBy(col(sample)).limit(samples)
    kinds = dict(df.dtypes)

    def length(k: str):
        if kinds[k].startswith(("array", "map")):
            return F.size(col(k)).cast("long")
        return F.length(col(k)).cast("long") if kinds[k] in ("string", "binary") else F.lit(None).cast("long")

    rows = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(kinds.get(k, "absent")).alias("type"), (length(k) if k in kinds else F.lit(None).cast("long")).alias("length"), (col(k).cast("string") if k in kinds else F.lit(None).cast("string")).alias("content")) for k in keys))
    return df.select(col(sample).cast("string").alias("sample"), F.explode(rows).alias("x")).select("sample", "x.*")


def summary(df: DataFrame) -> DataFrame:
    """(key, type, rows, nulls) of every column, in one pass."""
    one = df.agg(F.count("*").alias("n"), *(F.count_if(col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.lit(t).alias("type"), F.col("n").alias("rows"), F.col(f"n_{i}").alias("nulls")) for i, (c, t) in enumerate(df.dtypes)))).alias("x")
    return one.select(rows).select("x.*")
