"""Naming an intermediate value inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Compute `value` once and use it several times.

    A column expression is a tree: mentioning a costly part twice doubles the
    work and, when nested, makes the plan explode. The value is put in a
    one-element array, so the lambda variable stands for it.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bind_sql(value: Column, body: str, name: str = "x") -> Column:
    """The same with the use written in SQL over `name`; suits long fixed expressions, which one call then builds."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), F.lit(0))


def kept(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet a condition on costly columns.

    Spark moves a plain filter below the columns it names, with their expressions written
    out once per mention. It does not move one past row ids, so each column is computed once.
    """
    return df.withColumn("__at", F.monotonically_increasing_id()).filter(condition & (F.col("__at") >= 0)).drop("__at")


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(value: str, body: str, name: str) -> str:
    """SQL that computes `value` once and uses it in `body` as `name`."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"
