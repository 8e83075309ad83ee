"""Failures as values: a step that fails for a sample leaves the step's and the sample's name and a message in the row, later
steps pass the row by, and a policy settles it at the end."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, put, under
from .base import Op, op

#: Column of the first failure of a row: step, sample, message; null while there is none.
ERROR = "__error"
_KIND = "struct<step:string,sample:string,message:string>"


def _failed(df: DataFrame) -> Column:
    return col(ERROR).isNotNull() if ERROR in df.columns else F.lit(False)


def _note(df: DataFrame, message: Column, sample: Column) -> DataFrame:
    """Keeps a first failure's message; a later one does not replace it."""
    new = F.when(message.isNotNull(), F.struct(F.lit(None).cast("string").alias("step"), sample.cast("string").alias("sample"), message.alias("message"))).cast(_KIND)
    return df.withColumn(ERROR, F.coalesce(col(ERROR), new) if ERROR in df.columns else new)


def stamped(df: DataFrame, step: str) -> DataFrame:
    """Names the step of failures that have no name yet."""
    if ERROR not in df.columns:
        return df
    return df.withColumn(ERROR, F.when(col(ERROR).isNotNull() & col(f"{ERROR}").getField("step").isNull(), col(ERROR).withField("step", F.lit(step))).otherwise(col(ERROR)))


def checked(step: Op, bad: Column, message: Column, sample: str) -> Op:
    """`step` where it can work: rows for which `bad` holds get the message as their failure, and the step sees
    nulls there in what it reads (all columns but the sample's, if it does not say)."""

    def run(df: DataFrame) -> DataFrame:
        df = _note(df, F.when(~_failed(df) & F.coalesce(bad, F.lit(False)), message), col(sample))
        reads = [c for c in df.columns if c not in (sample, ERROR)] if step.reads is None else [c for r in step.reads for c in under(df, r)]
        # bound as columns of their own, so that a null is what the step sees
        own = {f"__own.{i}": col(c) for i, c in enumerate(reads)}
        seen = df.withColumns(own).withColumns({c: F.when(col(ERROR).isNull(), col(c)) for c in reads})
        out = step(seen)
        back = {c: F.when(col(ERROR).isNotNull(), col(f"__own.{i}")).otherwise(col(c)) for i, c in enumerate(reads) if c in out.columns and out.schema[c].dataType == df.schema[c].dataType}
        return out.withColumns(back).drop(*own)

    return Op(f"checked {step.name}", (*step.params, ("bad", str(bad))), run)


@op
def python_step(df: DataFrame, function: Callable, inputs: Sequence[str], to: str, kind: str, sample: str) -> DataFrame:
    """to = function(*inputs) as a Spark type, by Arrow batches; what it raises is the row's failure and leaves a null. Rows that
    have failed before are not given to it."""
    made = f"struct<value:{kind},message:string>"

    def run(*columns: pa.Array) -> pa.Array:
        skip, rows = columns[0].to_pylist(), zip(*(c.to_pylist() for c in columns[1:]), strict=True)
        values, messages = [], []
        for s, row in zip(skip, rows, strict=True):
            value, message = None, None
            if not s:
                try:
                    value = function(*row)
                except Exception as e:  # any failure of a step is a value here
                    message = f"{type(e).__name__}: {e}"
            values.append(value)
            messages.append(message)
        return pa.StructArray.from_arrays([pa.array(values, arrow), pa.array(messages, pa.string())], ["value", "message"])

    arrow = _arrow(kind)
    out = df.withColumn("__made", F.arrow_udf(run, made)(_failed(df), *map(col, inputs)))
    out = _note(out, F.col("__made.message"), col(sample))
    return put(out, to, F.col("__made.value")).drop("__made")


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def settle(df: DataFrame, policy: str = "raise", values: Mapping[str, object] | None = None) -> DataFrame:
    """What becomes of failed rows: raise (the query stops with the step, the sample and the message), drop, replace (the named
    keys get these values and the failure is gone) or keep (it stays as the column __error)."""
    if policy not in ("raise", "drop", "replace", "keep"):
        raise ValueError(f"no policy {policy!r}")
    if ERROR not in df.columns or policy == "keep":
        return df
    e = col(ERROR)
    if policy == "drop":
        return df.where(e.isNull()).drop(ERROR)
    if policy == "replace":
        return df.withColumns({k: F.when(e.isNotNull(), F.lit(v)).otherwise(col(k)) for k, v in (values or {}).items()}).drop(ERROR)
    said = F.concat(F.lit("step "), F.coalesce(e["step"], F.lit("?")), F.lit(", sample "), F.coalesce(e["sample"], F.lit("null")), F.lit(": "), e["message"])
    return df.where(F.when(e.isNotNull(), F.raise_error(said).cast("boolean")).otherwise(F.lit(True))).drop(ERROR)
