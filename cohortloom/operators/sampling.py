"""Seeded windows, exact samples and two-source blends. Every choice is a stable hash, so any task
can be run again and gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.hashing import label_of, stable_number
from cohortloom.operators import checks
from cohortloom.operators.skew import join_unique
from cohortloom.session import cut_lineage

HASH_BITS = 60
CUT_BITS = 20


def source_totals(df: DataFrame, source: str) -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("total_source_rows"))


def window_manifest(totals: DataFrame, source: str, seeds: list[int], size: Column, label: str | None = None) -> DataFrame:
    """One window per (source, seed): a start in [0, total - size] taken from hash(source, seed).

    A source with fewer rows than the window is an error.
    """
    parts: list = [F.col(source), F.col("seed")]
    if label:
        parts.append(label)
    room = F.col("total_source_rows") - F.col("window_rows")
    return (
        totals.withColumn("seed", F.explode(F.array(*[F.lit(s).cast("bigint") for s in seeds])))
        .withColumn("window_rows", size.cast("bigint"))
        .withColumn(
            "window_start",
            F.when(room >= 0, F.pmod(stable_number(label_of(*parts)), room + 1)).otherwise(
                F.raise_error(F.concat(F.lit("source smaller than window: "), F.col(source).cast("string"))).cast("bigint")
            ),
        )
    )


def take_windows(df: DataFrame, manifest: DataFrame, source: str, position: str) -> DataFrame:
    """Rows whose position lies in a window of their source, once per window.

    The manifest has one row per (source, seed); it is folded to one row per source so that the join
    key is unique and hot sources are joined map-side.
    """
    folded = manifest.groupBy(source).agg(
        F.max("total_source_rows").alias("_weight"),
        F.collect_list(F.struct("seed", "window_start", "window_rows")).alias("_windows"),
    )
    joined = join_unique(df, folded.drop("_weight"), [source], how="inner")
    hit = F.filter(
        F.col("_windows"),
        lambda w: (F.col(position) >= w["window_start"]) & (F.col(position) < w["window_start"] + w["window_rows"]),
    )
    return (
        joined.withColumn("_w", F.explode(hit))
        .select(
            *df.columns,
            F.col("_w.seed").alias("seed"),
            (F.col(position) - F.col("_w.window_start")).alias("window_offset"),
        )
    )


def nested_tiers(windowed: DataFrame, depths: list[int], offset: str = "window_offset") -> DataFrame:
    """Depth tiers are prefixes of one window: a row is in every tier deeper than its offset."""
    tiers = F.array(*[F.lit(d).cast("bigint") for d in depths])
    return windowed.withColumn("depth", F.explode(F.filter(tiers, lambda d: d > F.col(offset))))


def deepest_need(plan: DataFrame, sources: list[str], depth: str, seed: str) -> DataFrame:
    """Largest depth each (source, seed) needs over all planned rows."""
    return (
        plan.withColumn("source", F.explode(F.array(*sources)))
        .groupBy("source", seed)
        .agg(F.max(depth).alias("maximum_rows"))
    )


def exact_sample(
    df: DataFrame, sizes: DataFrame, group: str, id_col: str, label: Column, size: str = "sample_rows"
) -> DataFrame:
    """Exactly ``size`` rows per group without replacement: those with the smallest label hash.

    ``sizes`` has one row per group. Hashes are cut into 2**20 ranges; range counts give the range in
    which the n-th smallest hash lies, so only that thin range is sorted. Nothing is gathered. The
    limits (one row per group) are checkpointed; ``df`` itself is read twice.
    Asking for more rows than a group has is an error.
    """
    hashed = df.withColumn("_h", stable_number(label)).withColumn(
        "_cut", F.shiftright("_h", HASH_BITS - CUT_BITS).cast("int")
    )
    counts = hashed.groupBy(group, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(group).orderBy("_cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(group)
    placed = (
        counts.withColumn("_total", F.sum("_n").over(every))
        .withColumn("_upto", F.sum("_n").over(upto))
        .join(sizes.select(group, F.col(size).cast("bigint").alias("_want")), group)
        .withColumn(
            "_want",
            F.when(F.col("_want") <= F.col("_total"), F.col("_want")).otherwise(
                F.raise_error(F.concat(F.lit("group smaller than sample: "), F.col(group).cast("string"))).cast("bigint")
            ),
        )
    )
    # The edge range is the first whose running count reaches the wanted size.
    edge_row = F.struct("_cut", (F.col("_want") - (F.col("_upto") - F.col("_n"))).alias("rest"))
    limits = cut_lineage(
        placed.groupBy(group)
        .agg(
            F.max("_total").alias("_weight"),
            F.min(F.when(F.col("_upto") >= F.col("_want"), edge_row)).alias("_edge_row"),
        )
        .select(group, "_weight", F.col("_edge_row._cut").alias("_edge"), F.col("_edge_row.rest").alias("_rest"))
    )
    bounded = join_unique(hashed, limits.drop("_weight"), [group], how="inner")
    sure = bounded.filter(F.col("_cut") < F.col("_edge"))
    ranked = Window.partitionBy(group).orderBy("_h", id_col)
    edge = (
        bounded.filter(F.col("_cut") == F.col("_edge"))
        .withColumn("_r", F.row_number().over(ranked))
        .filter(F.col("_r") <= F.col("_rest"))
    )
    return sure.select(*df.columns).unionByName(edge.select(*df.columns))


def without_sample(
    df: DataFrame, sizes: DataFrame, group: str, id_col: str, label: Column, size: str = "sample_rows"
) -> DataFrame:
    """The rows that ``exact_sample`` with the same arguments does not take."""
    chosen = exact_sample(df, sizes, group, id_col, label, size).select(group, id_col)
    return df.join(chosen, [group, id_col], "left_anti").select(*df.columns)


def blend_sizes(total: Column, percent: float) -> tuple[Column, Column]:
    """(major, minor) row counts: minor is rounded half to even, major is the rest."""
    checks.require_between(percent, 0, 50, "minor percent")
    minor = F.bround(total.cast("double") * F.lit(float(percent)) / F.lit(100.0)).cast("bigint")
    return total.cast("bigint") - minor, minor
