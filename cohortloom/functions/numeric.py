"""Numeric expressions: safe ratios, rates, bounds and row-wise folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.functions.text import col


def number(c: Column | str) -> Column:
    """Double, or null where the text is not a number."""
    return col(c).try_cast("double")


def whole(c: Column | str) -> Column:
    return col(c).try_cast("bigint")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Plain ratio; null where the denominator is zero."""
    return F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))


def ratio_or_zero(numerator: Column | str, denominator: Column | str) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def per_million(numerator: Column | str, denominator: Column | str) -> Column:
    """Rate per million; zero where the denominator is zero."""
    return F.coalesce(
        F.try_divide(col(numerator).cast("double") * F.lit(1_000_000.0), col(denominator).cast("double")), F.lit(0.0)
    )


def rounded(c: Column | str, digits: int) -> Column:
    """Double rounded as the SQL statements do it: the scaled value goes to a whole number, halves away from zero.

    ``F.round`` goes by the decimal digits: 41/640 prints as 0.0640625 and is taken up, but scales to 64062.49999999999.
    """
    scale = F.lit(10.0**digits)
    return F.round(col(c) * scale) / scale


def holds(condition: Column) -> Column:
    """Null never passes a test (an empty subgroup has no prevalence)."""
    return F.coalesce(condition, F.lit(False))


def within(c: Column | str, low: float | None, high: float | None) -> Column:
    """Inclusive bounds; an open bound is None."""
    tests = []
    if low is not None:
        tests.append(col(c) >= F.lit(low))
    if high is not None:
        tests.append(col(c) <= F.lit(high))
    return holds(all_true(*tests)) if tests else F.lit(True)


def all_true(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def overlap_length(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Shared length of two half-open intervals."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(end_a, end_b) - F.greatest(start_a, start_b))


_SMALL_LOG_FACTORIALS = 10


def log_factorial(n: Column) -> Column:
    """ln(n!): a small table up to 9, Stirling's series above (error below 1e-12)."""
    import math

    table = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(_SMALL_LOG_FACTORIALS)])
    x = F.greatest(n, F.lit(1)).cast("double")
    inverse = F.lit(1.0) / x
    square = inverse * inverse
    series = (
        x * F.ln(x)
        - x
        + F.lit(0.5) * F.ln(F.lit(2 * math.pi) * x)
        + inverse * (F.lit(1 / 12) - square * (F.lit(1 / 360) - square * (F.lit(1 / 1260) - square * F.lit(1 / 1680))))
    )
    return F.when(n < _SMALL_LOG_FACTORIALS, F.get(table, n.cast("int"))).otherwise(series)
