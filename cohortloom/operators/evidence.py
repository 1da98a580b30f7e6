"""Minority-evidence burden per sample and sequence summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.fixed_values import (
    BASE_NAMES,
    DEPTH_CAP,
    DROP_BITS,
    MIN_BASE_QUALITY,
    MIN_DEPTH,
    MIN_MAPPING_QUALITY,
    MIN_MINOR_COUNT,
    NARROW_SHARE,
    PROPER_PAIR_BIT,
    WIDE_SHARE,
)
from cohortloom.functions.evidence import base_counts, counted_symbols, second_largest
from cohortloom.functions.numeric import per_million, ratio, ratio_or_zero
from cohortloom.operators.choice import first_n_per_key, row_digits
from cohortloom.operators.intervals import merge_intervals
from cohortloom.operators.quantiles import half_mass_length
from cohortloom.session import cut_lineage


def keep_proper(df: DataFrame, flag: str) -> DataFrame:
    """Proper pairs only; secondary and supplementary rows dropped."""
    f = F.col(flag)
    return df.filter((f.bitwiseAND(F.lit(PROPER_PAIR_BIT)) == PROPER_PAIR_BIT) & (f.bitwiseAND(F.lit(DROP_BITS)) == 0))


def quality_rows(
    df: DataFrame, mapq: str, baseq: str, min_mapq: int = MIN_MAPPING_QUALITY, min_baseq: int = MIN_BASE_QUALITY
) -> DataFrame:
    """Evidence rows of sufficient quality (``capped_rows`` limits the depth)."""
    return df.filter((F.col(mapq) >= min_mapq) & (F.col(baseq) >= min_baseq))


def capped_rows(df: DataFrame, position_keys: list[str], quality: str, ties: Column, cap: int = DEPTH_CAP) -> DataFrame:
    """At most ``cap`` rows of every position: the best by integer quality, then by a stable hash of ``ties``.

    ``ties`` is a text that tells the rows of a position apart. A position with a third of the rows is not sorted: its
    rows are counted by quality and by hash range, and the cap falls into one of these.
    """
    return first_n_per_key(df, position_keys, cap, [-F.col(quality).cast("bigint"), *row_digits(ties, 1)], [F.md5(ties.cast("binary"))])


def decode_rows(df: DataFrame, ref: str = "ref", pile: str = "pile") -> DataFrame:
    """Add the counts of A, C, G, T and other reference bases as columns n_A .. n_other."""
    return base_counts(df.withColumn("_symbols", counted_symbols(pile)), ref, "_symbols").drop("_symbols")


def base_count_columns(df: DataFrame, position_keys: list[str], base: str, weight: Column | None = None) -> DataFrame:
    """Counts per position from long (position, base) rows, in the shape of ``decode_rows``."""
    w = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    zero = F.lit(0).cast("bigint")
    letter = F.upper(F.col(base))
    known = [F.sum(F.when(letter == b, w).otherwise(zero)).alias(f"n_{b}") for b in BASE_NAMES[:-1]]
    other = F.sum(F.when(letter.isin(*BASE_NAMES[:-1]), zero).otherwise(w)).alias("n_other")
    return df.groupBy(*position_keys).agg(*known, other)


def position_flags(
    counted: DataFrame,
    keys: list[str],
    min_depth: int = MIN_DEPTH,
    min_minor: int = MIN_MINOR_COUNT,
    wide: tuple[float, float] = WIDE_SHARE,
    narrow: tuple[float, float] = NARROW_SHARE,
) -> DataFrame:
    """Per position: depth, and whether it is callable (_c) and mixed at the wide (_w) and narrow (_n) share range."""
    counts = [F.col(f"n_{b}") for b in BASE_NAMES]
    depth = counts[0] + counts[1] + counts[2] + counts[3] + counts[4]
    minor = second_largest(*counts)
    share = ratio(minor, depth)
    callable_ = depth >= min_depth
    enough = callable_ & (minor >= min_minor)
    return counted.select(
        *keys,
        depth.alias("depth"),
        callable_.alias("_c"),
        F.coalesce(enough & share.between(*wide), F.lit(False)).alias("_w"),
        F.coalesce(enough & share.between(*narrow), F.lit(False)).alias("_n"),
    )


def depth_profile(
    counted: DataFrame,
    keys: list[str],
    min_depth: int = MIN_DEPTH,
    min_minor: int = MIN_MINOR_COUNT,
    wide: tuple[float, float] = WIDE_SHARE,
    narrow: tuple[float, float] = NARROW_SHARE,
) -> DataFrame:
    """Per (keys, depth): positions, callable positions and mixed positions at both share ranges.

    This is the only pass over the positions; depth takes few values, so partial sums stay small.
    """
    flags = position_flags(counted, keys, min_depth, min_minor, wide, narrow)
    return flags.groupBy(*keys, "depth").agg(
        F.count(F.lit(1)).alias("positions"),
        F.count_if("_c").alias("callable"),
        F.count_if("_w").alias("mixed_wide"),
        F.count_if("_n").alias("mixed_narrow"),
    )


def burden_from_profile(profile: DataFrame, keys: list[str]) -> DataFrame:
    """One metric row per key: totals, lower median of callable depth and the per-million rates."""
    upto = Window.partitionBy(*keys).orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(*keys)
    ranked = profile.withColumn("_run", F.sum("callable").over(upto)).withColumn("_all", F.sum("callable").over(every))
    middle = F.floor((F.col("_all") + 1) / 2)
    at_middle = (F.col("callable") > 0) & (F.col("_run") >= middle)
    return (
        ranked.groupBy(*keys)
        .agg(
            F.sum("positions").alias("total_positions"),
            F.sum("callable").alias("callable_positions"),
            F.coalesce(F.min(F.when(at_middle, F.col("depth"))), F.lit(0).cast("bigint")).alias("median_depth"),
            F.sum("mixed_wide").alias("mixed_wide"),
            F.sum("mixed_narrow").alias("mixed_narrow"),
        )
        .withColumn("wide_per_million", per_million("mixed_wide", "callable_positions"))
        .withColumn("narrow_per_million", per_million("mixed_narrow", "callable_positions"))
    )


def mixture_burden(counted: DataFrame, keys: list[str], **screen: object) -> DataFrame:
    """Mixture burden per sample and route from per-position base counts."""
    return burden_from_profile(depth_profile(counted, keys, **screen), keys)


def gc_count(sequence: Column) -> Column:
    """G and C of either case: bytes that are lost when a letter is cut out, which needs no walk over characters."""
    lost = [F.octet_length(sequence) - F.octet_length(F.replace(sequence, F.lit(x), F.lit(""))) for x in "GgCc"]
    return (lost[0] + lost[1] + lost[2] + lost[3]).cast("bigint")


def sequence_stats(
    df: DataFrame, keys: list[str], sequence: str = "seq", min_length: int = 0
) -> DataFrame:
    """Per key: total length, record count, N50, longest record and GC percent.

    Sequences are read once: their lengths and counts, two numbers a record, are stored for the totals and both passes of N50.
    """
    measured = df.select(*keys, F.length(sequence).cast("bigint").alias("_len"), gc_count(F.col(sequence)).alias("_gc"))
    rows = cut_lineage(measured).filter(F.col("_len") >= min_length)
    totals = rows.groupBy(*keys).agg(
        F.sum("_len").alias("total_length"),
        F.count(F.lit(1)).alias("records"),
        F.max("_len").alias("longest"),
        F.sum("_gc").alias("_gc_total"),
    )
    return (
        totals.join(half_mass_length(rows, keys, "_len", "n50"), keys)
        .withColumn("gc_percent", F.try_divide(F.col("_gc_total") * 100.0, F.col("total_length").cast("double")))
        .drop("_gc_total")
    )


def weighted_support(
    hits: DataFrame,
    queries: DataFrame,
    query: str,
    length: str,
    *,
    target: str,
    start: str,
    end: str,
    matches: str,
    block: str,
    ordinal: str,
    min_identity: float,
    min_fraction: float,
    min_length: int,
) -> DataFrame:
    """Match-weighted identity, covered fraction, best target and the keep flag for every query.

    Hits below the identity floor are dropped before any shuffle. Queries without a hit stay.
    """
    identity = ratio_or_zero(matches, block)
    good = hits.withColumn("_identity", identity).filter(F.col("_identity") >= min_identity)
    folded = good.groupBy(query).agg(
        F.sum(F.col("_identity") * F.col(matches)).alias("_weighted"),
        F.sum(matches).alias("_matches"),
        F.count(F.lit(1)).alias("supporting"),
        F.min_by(target, F.struct((-F.col(matches)).alias("m"), F.col(ordinal).alias("o"))).alias("best_target"),
    )
    covered = (
        merge_intervals(good, [query], start, end)
        .groupBy(query)
        .agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    )
    return (
        queries.select(query, F.col(length).cast("bigint").alias("length"))
        .join(folded, query, "left")
        .join(covered, query, "left")
        .select(
            query,
            "length",
            "best_target",
            F.try_divide("_weighted", F.col("_matches").cast("double")).alias("weighted_identity"),
            F.when(F.col("supporting").isNotNull(), ratio_or_zero("covered", "length")).alias("covered_fraction"),
            F.coalesce("supporting", F.lit(0).cast("bigint")).alias("supporting"),
        )
        .withColumn(
            "retained",
            F.coalesce(
                (F.col("length") >= min_length)
                & (F.col("supporting") > 0)
                & (F.col("covered_fraction") >= min_fraction),
                F.lit(False),
            ),
        )
    )
