"""Half-open integer intervals: union, subtraction by precedence, ownership and overlap.

Containers are split into position buckets of a fixed width, so a container that holds most of the
intervals is processed by many tasks. What crosses a bucket border is carried by one row per bucket.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.numeric import overlap_length
from cohortloom.operators.skew import bucket_of, carry_before
from cohortloom.session import cut_lineage

WIDTH = 1 << 16


def _reach(df: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """Distinct starts with their furthest end, and the furthest end of everything before them.

    Equal starts are folded first (map-side), so a bucket holds at most ``width`` rows.
    """
    starts = (
        df.groupBy(*keys, F.col(start).alias("start"))
        .agg(F.max(end).alias("end"))
        .withColumn("_bucket", bucket_of(F.col("start"), width))
    )
    tops = starts.groupBy(*keys, "_bucket").agg(F.max("end").alias("_top"))
    carried = carry_before(tops, keys, "_bucket", {"_carry": ("max", "_top")})
    inside = Window.partitionBy(*keys, "_bucket").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return starts.join(carried, [*keys, "_bucket"]).withColumn(
        "_reached", F.greatest(F.max("end").over(inside), F.col("_carry"))
    )


def merge_intervals(
    df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = WIDTH
) -> DataFrame:
    """Union of overlapping or touching intervals as (keys, start, end)."""
    rows = _reach(df, keys, start, end, width)
    opens = F.col("_reached").isNull() | (F.col("start") > F.col("_reached"))
    flagged = rows.withColumn("_open", F.when(opens, F.col("start")))
    last_open = flagged.groupBy(*keys, "_bucket").agg(F.max("_open").alias("_last"))
    carried = carry_before(last_open, keys, "_bucket", {"_from": ("max", "_last")})
    inside = Window.partitionBy(*keys, "_bucket").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    island = F.coalesce(F.max("_open").over(inside), F.col("_from"))
    return (
        flagged.join(carried, [*keys, "_bucket"])
        .withColumn("_island", island)
        .groupBy(*keys, F.col("_island").alias("start"))
        .agg(F.max("end").alias("end"))
    )


def union_length(
    df: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = WIDTH
) -> DataFrame:
    """(keys, union_length): each row adds the part that nothing before it reached."""
    added = F.greatest(
        F.lit(0).cast("bigint"), F.col("end") - F.greatest(F.col("start"), F.coalesce("_reached", F.col("start")))
    )
    return _reach(df, keys, start, end, width).groupBy(*keys).agg(F.sum(added).alias("union_length"))


def covered_fraction(df: DataFrame, keys: list[str], start: str, end: str, width: int = WIDTH) -> DataFrame:
    """Union length, summed length and their ratio per key."""
    nominal = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("intervals"), F.sum(F.col(end) - F.col(start)).alias("nominal_length")
    )
    return nominal.join(union_length(df, keys, start, end, width), keys).withColumn(
        "unique_fraction", F.try_divide(F.col("union_length").cast("double"), F.col("nominal_length").cast("double"))
    )


def in_buckets(df: DataFrame, start: str, end: str, width: int, name: str = "_bucket") -> DataFrame:
    """One row per bucket an interval touches; empty intervals touch none."""
    touched = F.sequence(bucket_of(F.col(start), width), bucket_of(F.col(end) - 1, width))
    return df.filter(F.col(end) > F.col(start)).withColumn(name, F.explode(touched))


def own_by_precedence(
    df: DataFrame,
    keys: list[str],
    precedence: str,
    start: str = "start",
    end: str = "end",
    width: int = WIDTH,
) -> DataFrame:
    """Disjoint pieces (keys, precedence, start, end): each point belongs to the lowest covering precedence.

    Intervals of one precedence are merged first. Every bucket is then swept from left to right with the set of open
    intervals in the order of their precedence; a piece ends where its owner ends or a better one begins, so the work is
    n log n in the intervals of a bucket, however they nest, and a task holds the open ones only. Touching pieces of one owner
    are joined again. Rows with a null key or precedence own nothing. The merged intervals and the owned pieces are checkpointed, since each
    feeds more than one later pass.
    """
    merged = cut_lineage(merge_intervals(df, [*keys, precedence], start, end, width))
    clipped = in_buckets(merged, "start", "end", width).select(
        *keys,
        precedence,
        "_bucket",
        F.greatest(F.col("start"), F.col("_bucket") * width).alias("start"),
        F.least(F.col("end"), (F.col("_bucket") + 1) * width).alias("end"),
    )
    placed = clipped.repartition(*keys, "_bucket").sortWithinPartitions(*keys, "_bucket", "start")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clipped.drop("_bucket", "start", "end").schema.fields)
    owned = placed.mapInArrow(_sweep(keys, precedence), f"{schema}, cut bigint, cut_end bigint")
    return merge_intervals(cut_lineage(owned), [*keys, precedence], "cut", "cut_end", width)


def owned_pieces(intervals: Iterable[tuple[int, int, object]]) -> Iterator[tuple[object, int, int]]:
    """(owner, start, end) pieces of half-open (start, end, owner) intervals that come sorted by start; the least open owner holds a point."""
    open_: list[tuple[bool, object, int]] = []
    at, piece = None, None

    def run_to(limit: int | None) -> Iterator[tuple[object, int, int]]:
        nonlocal at, piece
        while open_ and (limit is None or at < limit):
            absent, owner, end = open_[0]
            owner = None if absent else owner
            if end <= at:
                heapq.heappop(open_)
                continue
            stop = end if limit is None else min(end, limit)
            if piece and piece[0] == owner and piece[2] == at:
                piece = (owner, piece[1], stop)
            else:
                if piece:
                    yield piece
                piece = (owner, at, stop)
            at = stop

    for start, end, owner in intervals:
        yield from run_to(start)
        at = start
        heapq.heappush(open_, (owner is None, 0 if owner is None else owner, end))
    yield from run_to(None)
    if piece:
        yield piece


def _sweep(keys: list[str], precedence: str):
    columns = [*keys, precedence, "_bucket", "start", "end"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, out = None, []

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip([*keys, precedence, "cut", "cut_end"], r, strict=True)) for r in out], schema=fields)

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal fields
            for batch in batches:
                if fields is None:
                    fields = pa.schema([batch.schema.field(c) for c in (*keys, precedence)] + [pa.field("cut", pa.int64()), pa.field("cut_end", pa.int64())])
                yield batch

        width = len(keys)
        for group, members in groupby(rows(noted()), key=lambda r: (*r[:width], r[width + 1])):
            for owner, low, high in owned_pieces((r[width + 2], r[width + 3], r[width]) for r in members):
                out.append((*group[:width], owner, low, high))
                if len(out) >= 10_000:
                    yield emit()
                    out = []
        if out:
            yield emit()

    return run


def subtract_intervals(
    df: DataFrame, covers: DataFrame, keys: list[str], start: str = "start", end: str = "end", width: int = WIDTH
) -> DataFrame:
    """Parts of the intervals that no cover touches, as (keys, start, end)."""
    both = covers.select(*keys, F.lit(0).alias("_side"), F.col(start).alias("start"), F.col(end).alias("end")).unionByName(
        df.select(*keys, F.lit(1).alias("_side"), F.col(start).alias("start"), F.col(end).alias("end"))
    )
    return own_by_precedence(both, keys, "_side", "start", "end", width).filter(F.col("_side") == 1).drop("_side")


def locate_points(
    points: DataFrame, owners: DataFrame, keys: list[str], point: str, columns: list[str], width: int = WIDTH
) -> DataFrame:
    """Attach the owning interval's columns to every point that an interval of ``owners`` holds.

    ``owners`` must be disjoint. Owners' starts and points are sorted together inside each bucket and the last start is carried
    forward, so the work is linear in both and no point meets more than one owner.
    """
    order = F.greatest(F.col("start"), F.col("_bucket") * width)
    starts = in_buckets(owners, "start", "end", width).select(
        *keys, "_bucket", order.alias("_at"), F.lit(0).alias("_kind"),
        F.struct(F.col("end").alias("_end"), *columns).alias("_owner"), F.lit(None).cast(points.select(F.struct("*")).schema[0].dataType).alias("_row"),
    )
    asked = points.select(
        *keys, bucket_of(F.col(point), width).alias("_bucket"), F.col(point).alias("_at"), F.lit(1).alias("_kind"),
        F.lit(None).cast(starts.schema["_owner"].dataType).alias("_owner"), F.struct(*points.columns).alias("_row"),
    )
    upto = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        starts.unionByName(asked)
        .withColumn("_owner", F.last("_owner", ignorenulls=True).over(upto))
        .filter((F.col("_kind") == 1) & (F.col("_at") < F.col("_owner._end")))
        .select("_row.*", *[F.col(f"_owner.{c}").alias(c) for c in columns])
    )


def overlapping_pairs(
    df: DataFrame,
    keys: list[str],
    id_col: str,
    start: str = "start",
    end: str = "end",
    width: int = WIDTH,
) -> DataFrame:
    """Unordered pairs of intervals of one key that share at least one point.

    Copies (equal start and end) are folded to one interval with its lowest id, so a row stands for
    ``pairs`` pairs; a folded interval of n copies also gives one row with itself for its n(n-1)/2
    inner pairs. Pairs meet inside position buckets, and only in the first bucket they share, so pairs
    that do not overlap are never formed and none is formed twice.
    """
    folded = df.groupBy(*keys, F.col(start).alias("start"), F.col(end).alias("end")).agg(
        F.min(id_col).alias("_id"), F.count(F.lit(1)).alias("_n")
    )
    spans = in_buckets(folded, "start", "end", width)

    def side(letter: str) -> DataFrame:
        names = {"_id": "id", "start": "start", "end": "end", "_n": "_n"}
        return spans.select(*keys, "_bucket", *[F.col(c).alias(f"{n}_{letter}") for c, n in names.items()])

    n_a, n_b = F.col("_n_a"), F.col("_n_b")
    inner = F.col("id_a") == F.col("id_b")
    return (
        side("a")
        .join(side("b"), [*keys, "_bucket"])
        .filter(
            ((F.col("id_a") < F.col("id_b")) | (inner & (n_a > 1)))
            & (F.col("start_a") < F.col("end_b"))
            & (F.col("start_b") < F.col("end_a"))
            & (F.col("_bucket") == bucket_of(F.greatest("start_a", "start_b"), width))
        )
        .withColumn("overlap", overlap_length(F.col("start_a"), F.col("end_a"), F.col("start_b"), F.col("end_b")))
        .withColumn(
            "overlap_fraction",
            F.try_divide(
                F.col("overlap").cast("double"),
                F.least(F.col("end_a") - F.col("start_a"), F.col("end_b") - F.col("start_b")).cast("double"),
            ),
        )
        .withColumn("pairs", F.when(inner, F.floor(n_a * (n_a - 1) / 2)).otherwise(n_a * n_b).cast("bigint"))
        .drop("_bucket", "_n_a", "_n_b")
    )


def overlap_summary(df: DataFrame, keys: list[str], pairs: DataFrame) -> DataFrame:
    """Per key: all unordered pairs, the overlapping ones, and mean and maximum overlap fraction.

    Pairs without overlap are counted as n(n-1)/2 minus the overlapping ones and add zero to the mean.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("intervals"))
    found = pairs.groupBy(*keys).agg(
        F.sum("pairs").alias("overlapping_pairs"),
        F.sum(F.col("overlap_fraction") * F.col("pairs")).alias("_sum"),
        F.min("overlap_fraction").alias("_min"),
        F.max("overlap_fraction").alias("_max"),
    )
    n = F.col("intervals")
    total = ((n * (n - 1)) / 2).cast("bigint")
    return (
        sizes.join(found, keys, "left")
        .withColumn("pairs", total)
        .withColumn("overlapping_pairs", F.coalesce("overlapping_pairs", F.lit(0).cast("bigint")))
        .withColumn("mean_overlap_fraction", F.try_divide(F.coalesce("_sum", F.lit(0.0)), F.col("pairs").cast("double")))
        .withColumn(
            "minimum_overlap_fraction",
            F.when(F.col("pairs") == 0, F.lit(None).cast("double"))
            .when(F.col("overlapping_pairs") < F.col("pairs"), F.lit(0.0))
            .otherwise(F.col("_min")),
        )
        .withColumn(
            "maximum_overlap_fraction", F.when(F.col("pairs") > 0, F.coalesce("_max", F.lit(0.0)))
        )
        .drop("_sum", "_min", "_max")
    )
