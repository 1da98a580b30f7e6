"""Order statistics per group that never sort a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 1 << 16


def value_histogram(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Rows (or summed weight) per (keys, value); nulls are left out. Merged map-side."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(size.alias("_n"))


def value_bucket(value: Column, steps: int = STEPS) -> Column:
    """Monotone bucket of a number: ``steps`` equal parts of every power-of-two range."""
    size = F.abs(value.cast("double"))
    power = F.floor(F.log2(F.greatest(size, F.lit(1e-300))))
    part = F.floor(size / F.pow(F.lit(2.0), power.cast("double")) * steps)
    bucket = (power + 1100).cast("bigint") * steps + part.cast("bigint") - steps
    return F.when(size < 1e-300, F.lit(0).cast("bigint")).when(value < 0, -bucket).otherwise(bucket)


def _upto(keys: list[str], order: Column) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def ranked_values(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """Values at the lower and upper middle ranks of each group, as (keys, n, low, high).

    Level one: distinct values fall into fine value buckets and only bucket totals are cumulated.
    Level two: only the one or two buckets that hold the middle ranks are sorted.
    """
    tagged = histogram.withColumn("_bucket", value_bucket(F.col("_v")))
    totals = tagged.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_bn"))
    low_rank = F.floor((F.col("_total") + 1) / 2).cast("bigint")
    high_rank = F.floor((F.col("_total") + 2) / 2).cast("bigint")
    wanted = (
        totals.withColumn("_before", F.sum("_bn").over(_upto(keys, F.asc("_bucket"))) - F.col("_bn"))
        .withColumn("_total", F.sum("_bn").over(Window.partitionBy(*keys)))
        .filter((F.col("_before") < high_rank) & (F.col("_before") + F.col("_bn") >= low_rank))
        .drop("_bn")
    )
    inside = _upto([*keys, "_bucket"], F.asc("_v"))
    ranked = tagged.join(wanted, [*keys, "_bucket"]).withColumn("_run", F.sum("_n").over(inside) + F.col("_before"))
    return ranked.groupBy(*keys).agg(
        F.max("_total").alias("n"),
        F.min(F.when(F.col("_run") >= low_rank, F.col("_v"))).alias("low"),
        F.min(F.when(F.col("_run") >= high_rank, F.col("_v"))).alias("high"),
    )


def lower_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact lower median: the value at rank (n + 1) div 2."""
    return ranked_values(value_histogram(df, keys, value), keys).select(*keys, F.col("low").alias(name))


def middle_median(
    df: DataFrame, keys: list[str], value: str, name: str = "median", weight: str | None = None
) -> DataFrame:
    """Exact median; the mean of the two middle values when n is even. A row may count ``weight`` times."""
    middle = (F.col("low").cast("double") + F.col("high").cast("double")) / 2.0
    return ranked_values(value_histogram(df, keys, value, weight), keys).select(*keys, middle.alias(name))


def half_mass_length(df: DataFrame, keys: list[str], length: str, name: str = "n50") -> DataFrame:
    """N50: the largest length at which the descending running sum reaches half the total.

    Works on distinct lengths with counts; only the value bucket that crosses the half is sorted.
    """
    mass = F.col("_v") * F.col("_n")
    tagged = value_histogram(df, keys, length).withColumn("_bucket", value_bucket(F.col("_v")))
    totals = tagged.groupBy(*keys, "_bucket").agg(F.sum(mass).alias("_mass"))
    crossing = (
        totals.withColumn("_above", F.sum("_mass").over(_upto(keys, F.desc("_bucket"))) - F.col("_mass"))
        .withColumn("_whole", F.sum("_mass").over(Window.partitionBy(*keys)))
        .filter((F.col("_above") * 2 < F.col("_whole")) & ((F.col("_above") + F.col("_mass")) * 2 >= F.col("_whole")))
        .drop("_mass")
    )
    down = _upto([*keys, "_bucket"], F.desc("_v"))
    return (
        tagged.join(crossing, [*keys, "_bucket"])
        .withColumn("_run", F.sum(mass).over(down) + F.col("_above"))
        .filter(F.col("_run") * 2 >= F.col("_whole"))
        .groupBy(*keys)
        .agg(F.max("_v").alias(name))
    )
