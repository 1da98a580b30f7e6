"""The first n rows of every key, or of a whole table, without a sort of the key.

The n-th row is found by counting, digit by digit: rows of a key are counted by their first digit (merged map-side, one
row per key and digit), the digit in which the n-th row lies is kept with what is still needed of it, and only its rows are
counted by the next digit. Rows before the cut are taken as they stream by; only the rows of the last digit's cut are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators.skew import bucket_of, carry_before, join_unique

#: Hexadecimal figures of the row hash that make one digit, so that a digit has 65,536 values.
DIGIT_FIGURES = 4


def row_digits(ties: Column, digits: int = 2) -> list[Column]:
    """BIGINT digits of the MD5 of a text or binary column, most significant first: a stable order of rows."""
    return [F.conv(F.substring(F.md5(ties.cast("binary")), 1 + DIGIT_FIGURES * i, DIGIT_FIGURES), 16, 10).cast("bigint") for i in range(digits)]


def first_n_per_key(df: DataFrame, keys: list[str], n: int, digits: list[Column], order: list[Column]) -> DataFrame:
    """The first ``n`` rows of every key by ``digits`` (BIGINT, ascending, null last) and then by ``order``.

    A key with at most n rows keeps all. A digit must have few values per key (say, 65,536), and the rows of a key that
    agree in all digits must fit a task: they alone are ordered, so digits of a hash belong at the end. Rows equal in
    digits and ``order`` are alike, and any of them is taken. Rows with a null key are not limited.
    """
    if n < 1:
        return df.filter(F.lit(False))
    names = [f"_digit{i}" for i in range(len(digits))]
    last = F.lit((1 << 63) - 1)
    marked = df.withColumns({name: F.coalesce(d.cast("bigint"), last) for name, d in zip(names, digits, strict=True)})
    cut = None
    for i, name in enumerate(names):
        still = marked.select(*keys, *names[: i + 1])
        if cut is not None:
            inside = [F.col(d) == F.col(f"_cut{d}") for d in names[:i]]
            joined = join_unique(still, cut, keys, "inner")
            still = joined.filter(_all(inside)).select(*keys, name)
        counts = still.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_n"))
        upto = Window.partitionBy(*keys).orderBy(name)
        placed = counts.withColumn("_upto", F.sum("_n").over(upto))
        if cut is None:
            placed = placed.withColumn("_need", F.lit(n).cast("bigint"))
        else:
            placed = placed.join(cut, keys)
        here = placed.filter((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
        need = (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need")
        cut = here.select(*keys, *[f"_cut{d}" for d in names[:i]], F.col(name).alias(f"_cut{name}"), need)
    joined = join_unique(marked, cut, keys)
    before = F.lit(False)
    for name in reversed(names):
        before = (F.col(name) < F.col(f"_cut{name}")) | ((F.col(name) == F.col(f"_cut{name}")) & before)
    on_cut = _all([F.col(name) == F.col(f"_cut{name}") for name in names])
    sure = joined.filter(F.col("_need").isNull() | before)
    rank = Window.partitionBy(*keys).orderBy(*order)
    edge = joined.filter(on_cut).withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= F.col("_need"))
    return sure.select(*df.columns).unionByName(edge.select(*df.columns))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def first_records(df: DataFrame, position: str, n: int, width: int = 1 << 16) -> DataFrame:
    """The first ``n`` rows in the order of a unique BIGINT position, dense or not, without a global sort.

    Rows are counted by stretches of ``width`` positions; the stretch that holds the n-th row bounds the filter, so a
    columnar reader leaves out the parts of files whose positions lie behind it, and only that stretch is ranked. Fewer
    than n rows are all returned; rows without a position are left out.
    """
    if n < 1:
        return df.filter(F.lit(False))
    marked = df.filter(F.col(position).isNotNull())
    sizes = marked.groupBy(F.lit(0).alias("_all"), bucket_of(F.col(position), width).alias("_span")).agg(F.count(F.lit(1)).alias("_n"))
    upto = sizes.join(carry_before(sizes, ["_all"], "_span", {"_before": ("sum", "_n")}), ["_all", "_span"]).select(
        "_span", F.coalesce("_before", F.lit(0).cast("bigint")).alias("_before")
    )
    ends = upto.filter(F.col("_before") < n).agg(F.max("_span").alias("stretch"), F.max("_before").alias("before"))
    stretch, before = ends.select("stretch").scalar(), ends.select("before").scalar()
    low = stretch * F.lit(width)
    sure = marked.filter(F.col(position) < low)
    rank = Window.partitionBy(F.lit(0)).orderBy(position)
    edge = marked.filter((F.col(position) >= low) & (F.col(position) < low + width))
    edge = edge.withColumn("_rank", F.row_number().over(rank) + before).filter(F.col("_rank") <= n).drop("_rank")
    return sure.unionByName(edge)
