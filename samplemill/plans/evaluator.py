"""Evaluations: sources in, a long table of results out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..metrics.base import Metric, join_groups, long
from ..sources import tables


def resolve(data: DataFrame | Sequence[DataFrame] | Mapping[str, DataFrame], key: str, ids: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """One table from a table, a list of folds, or named sources (columns `<source>.<column>`), with one row per id."""
    if isinstance(data, Mapping):
        rows = tables.align(data, key, strict)
    else:
        rows = data if isinstance(data, DataFrame) else tables.union_folds(data)
        n = F.count("*").alias("__n")
        twice = rows.groupBy(col(key).alias("__id")).agg(n)
        bad = F.concat(F.lit("repeated id "), F.col("__id").cast("string"))
        rows = rows.join(tables.guarded(twice, F.col("__n") > 1, bad).select("__id"), col(key).eqNullSafe(F.col("__id"))).drop("__id")
    return tables.restrict(rows, ids, key, strict) if ids is not None else rows


@dataclass(frozen=True)
class Later:
    """A metric made from earlier results: `needs` names them as `<metric>.<name>`, `make` gets their numbers as columns."""

    needs: tuple[str, ...]
    make: Callable[..., Metric]


def evaluate(rows: DataFrame, metrics: Mapping[str, Metric | Later], by: Sequence[str] = (), before: Sequence[Callable[[DataFrame], DataFrame]] = (), after: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """(metric, *by, name, value): all metrics of one table, as one query.

    Steps in `before` work on the rows ahead of all metrics (results per sample are columns that they add), those in
    `after` on the table of results. A `Later` sees, in every group, the group's earlier results: they are joined to the rows."""
    for step in before:
        rows = step(rows)
    out = None
    for name, metric in metrics.items():
        if isinstance(metric, Later):
            missing = [n for n in metric.needs if n.split(".")[0] not in metrics or out is None]
            if missing:
                raise ValueError(f"metric {name!r} needs the earlier results {missing}")
            picked = out.groupBy(*map(col, by)).agg(*(F.max(F.when(F.concat_ws(".", "metric", "name") == n, F.col("value"))).alias(f"__need_{i}") for i, n in enumerate(metric.needs)))
            own = join_groups(rows, picked, by)
            made = metric.make(*(F.col(f"__need_{i}") for i in range(len(metric.needs))))(own, by)
        else:
            made = metric(rows, by)
        made = made if {"name", "value"} <= set(made.columns) else long(made, by)
        made = made.select(F.lit(name).alias("metric"), *map(col, by), *(col(c) for c in made.columns if c not in ("name", "value", *by)), "name", "value")
        out = made if out is None else out.unionByName(made, allowMissingColumns=True)
    for step in after:
        out = step(out)
    return out


def report(results: DataFrame, path: str) -> None:
    """Writes the results as CSV, without metrics whose name begins with an underscore."""
    results.where(~F.col("metric").startswith("_")).write.mode("overwrite").csv(path, header=True)


def markdown(rows: Sequence[Mapping], columns: Sequence[str]) -> str:
    """A small table of results (x [low-high] cells come ready) as text."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows])


def with_interval(value, low, high, digits: int = 3):
    """The text `x [low-high]` of three columns."""
    return F.format_string(f"%.{digits}f [%.{digits}f-%.{digits}f]", value, low, high)
