"""What a step is."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame

from ..functions.columns import col

#: Columns that hold what a reversible step has overwritten.
UNDO = "__undo"


@dataclass(frozen=True)
class Op:
    """A named step with its parameters (they make up its fingerprint).

    A step that says which key-paths it reads and writes keeps the rows as they are and can be left out where nothing that it
    writes is wanted. `reads` None: any column; `writes` None: the step may do anything, and what stands before it is needed
    whole. `hides` says of a key-path whether the step takes it away."""

    name: str
    params: tuple[tuple[str, str], ...]
    run: Callable[[DataFrame], DataFrame] = field(compare=False, repr=False)
    reads: tuple[str, ...] | None = field(default=None, compare=False)
    writes: tuple[str, ...] | None = field(default=None, compare=False)
    hides: Callable[[str], bool] | None = field(default=None, compare=False, repr=False)

    def declared(self, reads: Sequence[str], writes: Sequence[str]) -> Op:
        """The step with what it reads and writes said by hand."""
        return replace(self, reads=tuple(reads), writes=tuple(writes))

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.run(df)

    def __str__(self) -> str:
        return f"{self.name}({', '.join(f'{k}={v}' for k, v in self.params)})"


def said(value: object) -> str:
    """A parameter as text that stays the same from run to run."""
    if isinstance(value, Column):
        return str(value)
    if callable(value) and not isinstance(value, Op):
        try:
            return inspect.getsource(value).strip()
        except (OSError, TypeError):
            return getattr(value, "__qualname__", repr(value))
    return str(value) if isinstance(value, Op) else repr(value)


def op(f: Callable[..., DataFrame] | None = None, *, reads: str = "", writes: str | None = None, hides: Callable[..., Callable[[str], bool]] | None = None):
    """Makes f(df, **parameters) a factory of steps.

    `reads` and `writes` name the parameters that hold key-paths, separated by spaces; to|key is the first of both that is given.
    A step with a Column among its parameters reads any column."""
    if f is None:
        return lambda g: op(g, reads=reads, writes=writes, hides=hides)

    @functools.wraps(f)
    def make(*args, **kwargs) -> Op:
        bound = inspect.signature(f).bind(None, *args, **kwargs)
        bound.apply_defaults()
        given = dict(list(bound.arguments.items())[1:])

        def paths(names: str) -> tuple[str, ...]:
            values = [next((given[n] for n in choice.split("|") if given[n] is not None), ()) for choice in names.split()]
            return tuple(p for v in values for p in ([v] if isinstance(v, str) else v))

        params = tuple((k, said(v)) for k, v in given.items())
        if writes is None:
            return Op(f.__name__, params, lambda df: f(df, *args, **kwargs))
        free = any(isinstance(x, Column) for v in given.values() for x in (v if isinstance(v, (tuple, list)) else [v]))
        return Op(f.__name__, params, lambda df: f(df, *args, **kwargs), None if free else paths(reads), paths(writes), hides and hides(*args, **kwargs))

    return make


def undo_name(op_id: str, key: str) -> str:
    return f"{UNDO}.{op_id}.{key}"


def remember(df: DataFrame, op_id: str | None, *keys: str) -> DataFrame:
    """Keeps the columns' values for a later reverse."""
    return df.withColumns({undo_name(op_id, k): col(k) for k in keys}) if op_id else df
