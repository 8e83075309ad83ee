"""Cross-validation: folds of whole groups, a model for each fold, their held-out predictions and their ensemble."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, uniform
from ..functions.running import placed
from ..functions.storage import cut
from ..metrics.base import Metric, long
from ..metrics.classification import ensemble_mean
from ..operators.splits import part_of

#: Column of a row's fold, and of predictions.
FOLD, PREDICTION = "fold", "prediction"


def group_folds(df: DataFrame, group: str, folds: int, seed: object = 1234) -> DataFrame:
    """Each row with its fold: contiguous parts of the groups in hashed order, so that all rows of a group share one. Null groups are
    a group like any other."""
    name = F.coalesce(col(group).cast("string"), F.lit("\0"))
    groups = cut(df.select(name.alias("__g")).distinct().withColumn("__o", uniform(seed, "__g")))
    order = placed(groups, "__o", "__g").select("__g", part_of(F.col("place"), F.lit(groups.count()), folds).alias(FOLD))
    return df.withColumn("__g", name).join(order, "__g").drop("__g")


def cross_validate(df: DataFrame, folds: int, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], test: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(held-out predictions of the rows of `df`, which have a fold, the ensemble's predictions of `test`).

    fit(rows) makes a model of all folds but one; the model adds the column `prediction`. Models are plans over their
    training rows, made one after the other; each predicts its fold's rows. The ensemble is the mean of the models'
    predictions, null ones left out."""
    held, wide, names = None, test, []
    for k in range(folds):
        model = fit(df.where(F.col(FOLD) != k))
        own = model(df.where(F.col(FOLD) == k))
        held = own if held is None else held.unionByName(own)
        if wide is not None:
            name = f"__model_{k}"
            wide = cut(model(wide).withColumn(PREDICTION, F.array(F.col(PREDICTION).cast("double"))).withColumnRenamed(PREDICTION, name))
            names.append(name)
    if wide is not None:
        wide = wide.withColumn(PREDICTION, F.get(ensemble_mean(*names), F.lit(0))).drop(*names)
    return held, wide


def fold_report(held: DataFrame, metric: Metric, folds: int, test: DataFrame | None = None) -> DataFrame:
    """(part, name, value): the metric of each fold, of all held-out rows, and of the ensemble on the test rows."""
    parts: Sequence[tuple[str, DataFrame]] = [(f"fold {k}", held.where(F.col(FOLD) == k)) for k in range(folds)] + [("held out", held)] + ([("ensemble", test)] if test is not None else [])
    out = None
    for name, rows in parts:
        made = long(metric(rows, [])).select(F.lit(name).alias("part"), "name", "value")
        out = made if out is None else out.unionByName(made)
    return out
