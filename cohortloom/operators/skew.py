"""Joins and ordered passes that stay balanced when one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import cut_lineage

SHIFT = 22


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join to a table with one row per key; columns of ``left`` first, then those that ``right`` adds.

    An equi-join in which adaptive execution splits partitions of ``left`` that a hot key makes large and copies the one
    ``right`` row to each piece, so no rank or share decides which key counts as hot. The split needs a shuffle right
    below the join on both sides; a hash of the keys as a further key asks for one where ``right`` is grouped by them
    already. ``how`` is ``left`` or ``inner``.
    """
    payload = [c for c in right.columns if c not in keys]
    spread = F.xxhash64(*[F.col(k) for k in keys])
    joined = left.withColumn("_spread", spread).join(right.withColumn("_spread", spread), [*keys, "_spread"], how)
    return joined.select(*left.columns, *payload)


def key_weights(df: DataFrame, keys: list[str], name: str = "_weight") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def bucket_of(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width)).cast("bigint")


def carry_before(
    buckets: DataFrame, keys: list[str], bucket: str, carries: dict[str, tuple[str, str]], descending: bool = False
) -> DataFrame:
    """For every (keys, bucket) row, fold the earlier buckets of the same keys: ``carries`` maps a name to (sum or max, column).

    ``buckets`` holds one row per bucket. Folds run inside stretches of 2**SHIFT bucket numbers, and over one row per
    stretch, so a task holds at most 2**SHIFT rows of one key however sparse the buckets are, and a key with most
    rows is dealt over its stretches. Null where nothing comes before.
    """
    folds = {"sum": F.sum, "max": F.max}
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    wide = [F.col(k) for k in keys] + [F.shiftright(F.col(bucket).cast("bigint"), SHIFT).alias("_stretch")]
    before = Window.partitionBy(*keys, "_stretch").orderBy(order(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.select(*wide, bucket, *[F.col(c).alias(f"_v_{n}") for n, (_, c) in carries.items()])
    inside = placed.select(*keys, "_stretch", bucket, *[folds[f](f"_v_{n}").over(before).alias(f"_in_{n}") for n, (f, _) in carries.items()])
    stretches = placed.groupBy(*keys, "_stretch").agg(*[folds[f](f"_v_{n}").alias(f"_v_{n}") for n, (f, _) in carries.items()])
    above = Window.partitionBy(*keys).orderBy(order("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.select(*keys, "_stretch", *[folds[f](f"_v_{n}").over(above).alias(f"_up_{n}") for n, (f, _) in carries.items()])

    def both(n: str, fold: str) -> Column:
        a, b = F.col(f"_in_{n}"), F.col(f"_up_{n}")
        return (F.coalesce(a + b, a, b) if fold == "sum" else F.greatest(a, b)).alias(n)

    return inside.join(carried, [*keys, "_stretch"]).select(*keys, bucket, *[both(n, f) for n, (f, _) in carries.items()])


def range_rank(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """1-based rank of every row inside its keys by any order, without one task per key.

    Rows are range-partitioned on (keys, order), so a key with most rows spans many partitions. The
    partition number is stored with a checkpoint (range bounds are sampled and must not move between
    passes); rows are numbered inside partitions and partition sizes are cumulated.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    )
    sizes = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = carry_before(sizes, keys, "_part", {"_offset": ("sum", "_n")})
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        ranged.join(offsets, [*keys, "_part"])
        .withColumn(name, F.row_number().over(inside) + F.coalesce("_offset", F.lit(0).cast("bigint")))
        .drop("_part", "_offset")
    )


def dense_position(
    df: DataFrame, keys: list[str], order: str, name: str = "position", width: int = 1 << 16
) -> DataFrame:
    """0-based position of each row inside its keys, by a unique BIGINT order column.

    Two passes: rows are numbered inside value buckets (at most ``width`` rows each, since the order
    column is unique), and bucket sizes are summed over earlier buckets.
    """
    tagged = df.withColumn("_bucket", bucket_of(F.col(order), width))
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = carry_before(sizes, keys, "_bucket", {"_offset": ("sum", "_n")})
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    return (
        tagged.join(offsets, [*keys, "_bucket"])
        .withColumn(name, F.row_number().over(inside) - 1 + F.coalesce("_offset", F.lit(0).cast("bigint")))
        .drop("_bucket", "_offset")
    )
