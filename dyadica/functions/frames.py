"""Checks and choices on a DataFrame's columns, made when the plan is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """df; ValueError names the columns that it lacks."""
    if lacking := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"no columns {', '.join(lacking)}")
    return df


def first_available(df: DataFrame, *names: str) -> Column:
    """The first of these columns that df has; ValueError if it has none."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    raise ValueError(f"none of {', '.join(names)}")


def filter_if_any(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that fit condition, or all rows if none does."""
    fitting = df.where(condition)
    return df if fitting.isEmpty() else fitting


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """df without rows that lack any of columns (by default any at all)."""
    return df.na.drop(subset=list(columns) or None)


def rate(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0 or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows by name; columns that a frame lacks are null."""
    out, *rest = frames
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def guarded(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df; whatever reads it fails with message if condition isn't true of every row. Filters, so the check can't be pruned away."""
    return df.where(F.assert_true(condition, message).isNull())
