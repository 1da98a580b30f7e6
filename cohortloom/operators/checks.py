"""Data checks as frames of (check_name, expected, observed, ok)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A required check did not hold."""


def _row(df: DataFrame, name: str, expected: Column, observed: Column) -> DataFrame:
    return df.agg(observed.cast("bigint").alias("observed")).select(
        F.lit(name).alias("check_name"),
        expected.cast("bigint").alias("expected"),
        "observed",
        (F.col("observed") == expected).alias("ok"),
    )


def key_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Observed: number of keys held by more than one row."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return _row(repeated, name, F.lit(0), F.count(F.lit(1)))


def no_unmatched(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Observed: left rows without a partner."""
    return _row(left.join(right.select(*keys), keys, "left_anti"), name, F.lit(0), F.count(F.lit(1)))


def row_count(df: DataFrame, expected: int, name: str) -> DataFrame:
    return _row(df, name, F.lit(expected), F.count(F.lit(1)))


def distinct_count(df: DataFrame, column: str, expected: int, name: str) -> DataFrame:
    return _row(df, name, F.lit(expected), F.countDistinct(column))


def violations(df: DataFrame, valid: Column, name: str) -> DataFrame:
    """Observed: rows for which ``valid`` is false or null."""
    return _row(df, name, F.lit(0), F.count_if(~F.coalesce(valid, F.lit(False))))


def groups_present(df: DataFrame, group: str, required: list[str], name: str) -> DataFrame:
    """Observed: how many of the required groups have a row."""
    return _row(df.filter(F.col(group).isin(*required)), name, F.lit(len(required)), F.countDistinct(group))


def constant_value(df: DataFrame, column: str, value: object, name: str) -> DataFrame:
    return violations(df, F.col(column) == F.lit(value), name)


def same_members(left: DataFrame, right: DataFrame, column: str, name: str) -> DataFrame:
    """Set equality of two id columns. Observed: ids held by one side only."""
    a = left.select(column).distinct().withColumn("_l", F.lit(True))
    b = right.select(column).distinct().withColumn("_r", F.lit(True))
    return _row(
        a.join(b, column, "full_outer"), name, F.lit(0), F.count_if(F.col("_l").isNull() | F.col("_r").isNull())
    )


def combine(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def require(checks: DataFrame) -> None:
    """Raise when a check fails. One row per check reaches the driver, never data rows."""
    failed = checks.filter(~F.col("ok")).collect()
    if failed:
        raise CheckFailed("; ".join(f"{r.check_name}: expected {r.expected}, observed {r.observed}" for r in failed))


def require_known(value: object, allowed: set, what: str) -> None:
    if value not in allowed:
        raise ValueError(f"unknown {what}: {value!r}")


def require_between(value: float, low: float, high: float, what: str) -> None:
    if not low <= value <= high:
        raise ValueError(f"{what} must lie in [{low}, {high}], got {value!r}")
