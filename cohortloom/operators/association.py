"""Presence/absence association between two groups of entities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortloom import fixed_values as fv
from cohortloom.functions.numeric import holds, ratio
from cohortloom.operators.skew import join_unique
from cohortloom.session import cut_lineage

def distinct_presence(df: DataFrame, feature: str, entity: str) -> DataFrame:
    return df.select(feature, entity).distinct()


def group_totals(panel: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """One row: entities per named group (a condition on the panel)."""
    return panel.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"{g}_total") for g, c in groups.items()])


def flag_entities(panel: DataFrame, groups: dict[str, Column], keep: list[str]) -> DataFrame:
    """One boolean column per group, with the kept columns."""
    return panel.select(*keep, *[F.coalesce(c, F.lit(False)).alias(f"_{g}") for g, c in groups.items()])


def counts_of_flagged(presence: DataFrame, totals: DataFrame, feature: str, groups: list[str]) -> DataFrame:
    """Counts, totals and prevalences per feature from distinct presence rows that carry group flags.

    Counts are merged map-side; totals are one-row scalar subqueries.
    """
    counted = presence.groupBy(feature).agg(
        F.count(F.lit(1)).alias("entities_present"), *[F.count_if(f"_{g}").alias(f"{g}_present") for g in groups]
    )
    counted = counted.withColumns({f"{g}_total": totals.select(f"{g}_total").scalar() for g in groups})
    return counted.withColumns({f"{g}_prevalence": ratio(f"{g}_present", f"{g}_total") for g in groups})


def presence_counts(
    presence: DataFrame, panel: DataFrame, feature: str, entity: str, groups: dict[str, Column]
) -> DataFrame:
    """Per feature: entities present in all and in each group, with group totals and prevalences.

    The panel has one row per entity, so the join keeps presence rows as they are. Group totals come
    from the panel alone.
    """
    joined = presence.join(flag_entities(panel, groups, [entity]), entity, "inner")
    return counts_of_flagged(joined, group_totals(panel, groups), feature, list(groups))


def signed_gap(first: str, second: str, second_expected: Column) -> Column:
    """Prevalence gap in the expected direction."""
    gap = F.col(second) - F.col(first)
    return F.when(second_expected, gap).otherwise(-gap)


def _log_factorials(n: np.ndarray) -> np.ndarray:
    """ln(n!) of whole numbers: summed logarithms up to 255, Stirling's series above."""
    small = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])
    x = np.maximum(n, 1).astype(np.float64)
    series = x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + (1 / 12 - (1 / 360 - 1 / (1260 * x * x)) / (x * x)) / x
    return np.where(n < 256, small[np.minimum(n, 255)], series)


def log_fisher_p(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, tolerance: float) -> np.ndarray:
    """Natural logarithm of the two-sided exact p of every table [[a, b], [c, d]].

    Terms are taken relative to the observed one, so nothing underflows. The observed tail is walked outward from the observed
    table; the other tail from its first term that is not above the observed one, found by bisection (terms
    fall away from the mode). A walk follows the ratio of neighbouring terms, 64 at a time, until
    the last term cannot change the sum any more. No array grows with the margins.
    """
    a, b, c, d = (x.astype(np.int64) for x in (a, b, c, d))
    r1, r2, c1 = a + b, c + d, a + c
    low, high = np.maximum(0, c1 - r2), np.minimum(r1, c1)
    mode = np.clip(((r1 + 1.0) * (c1 + 1.0) // (r1 + r2 + 2.0)).astype(np.int64), low, high)

    def height(k: np.ndarray) -> np.ndarray:
        return -(_log_factorials(k) + _log_factorials(r1 - k) + _log_factorials(c1 - k) + _log_factorials(r2 - c1 + k))

    def tail(start: np.ndarray, up: np.ndarray) -> np.ndarray:
        """Sum of the terms from ``start`` outward, the first taken as one."""
        total, term, k = np.ones(len(start)), np.ones(len(start)), start.astype(np.float64)
        live = np.arange(len(start))
        while len(live):
            at = k[live, None] + np.where(up[live], 1.0, -1.0)[:, None] * np.arange(64)
            rows, cols, rest = r1[live, None], c1[live, None], (r2 - c1)[live, None]
            onward = np.where(
                up[live, None], (rows - at) * (cols - at) / np.maximum((at + 1) * (rest + at + 1), 1.0),
                at * (rest + at) / np.maximum((rows - at + 1) * (cols - at + 1), 1.0),
            )
            terms = term[live, None] * np.cumprod(np.maximum(onward, 0.0), axis=1)
            total[live] += terms.sum(1)
            term[live] = terms[:, -1]
            k[live] += np.where(up[live], 64.0, -64.0)
            live = live[term[live] > total[live] * 1e-18]
        return total

    upper = a >= mode
    seen = height(a)
    limit = seen + math.log1p(tolerance)
    # the other side's nearest term not above the observed one lies between `out` (not above) and `into` (above)
    out, into = np.where(upper, low, high), mode.copy()
    other = (out != mode) & (height(out) <= limit)
    while True:
        open_ = other & (np.abs(into - out) > 1)
        if not open_.any():
            break
        middle = (out + into) // 2
        fits = height(middle) <= limit
        out = np.where(open_ & fits, middle, out)
        into = np.where(open_ & ~fits, middle, into)
    total = tail(a, upper) + np.where(other, np.exp(np.minimum(height(out) - seen, 1.0)) * tail(out, ~upper), 0.0)
    margins = _log_factorials(r1) + _log_factorials(r2) + _log_factorials(c1) + _log_factorials(r1 + r2 - c1) - _log_factorials(r1 + r2)
    every = height(mode) <= limit  # the observed term is as high as the mode: no term is above it
    return np.where(every, 0.0, np.minimum(margins + seen + np.log(total), 0.0))


def fisher_test(
    df: DataFrame, cells: tuple[str, str, str, str], tolerance: float = fv.FISHER_TIE_TOLERANCE
) -> DataFrame:
    """Add ``fisher_p`` (two-sided exact), ``fisher_log10_p`` and ``odds_ratio`` (sample) of the table [[a, b], [c, d]].

    p is the sum of all table probabilities not above the observed one, margins fixed; every such term counts. A p below
    the smallest double is 0 in ``fisher_p`` and kept in ``fisher_log10_p``. A zero margin gives p = 1 and an undefined (NaN)
    odds ratio; otherwise a zero b*c gives infinity.
    """
    a, b, c, d = (F.col(x).cast("bigint") for x in cells)

    def log10_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(log_fisher_p(*(x.to_numpy() for x in (a, b, c, d)), tolerance) / math.log(10))

    empty = (a + b == 0) | (c + d == 0) | (a + c == 0) | (b + d == 0)
    odds = (
        F.when(empty, F.lit(float("nan")))
        .when((b == 0) | (c == 0), F.lit(float("inf")))
        .otherwise(a.cast("double") * d.cast("double") / (b.cast("double") * c.cast("double")))
    )
    tested = df.withColumn("fisher_log10_p", F.pandas_udf(log10_p, DoubleType())(a, b, c, d))
    logged = F.when(empty, F.lit(0.0)).otherwise(F.col("fisher_log10_p"))
    return tested.withColumn("fisher_log10_p", logged).select(
        *df.columns, F.pow(F.lit(10.0), F.col("fisher_log10_p")).alias("fisher_p"), "fisher_log10_p", odds.alias("odds_ratio")
    )


def _p_bucket(p: Column) -> Column:
    """Monotone bucket of a p-value: 4096 linear steps above 1/64, 64 per octave below."""
    tiny = F.greatest(p, F.lit(1e-320))
    return F.when(p >= 1 / 64, F.floor(p * 4096)).otherwise(F.floor(F.log2(tiny) * 64) + 384 - 1).cast("int")


def bh_table(weighted: DataFrame, p: str, weight: str, q: str = "fdr") -> DataFrame:
    """(p, q) for every distinct p: Benjamini-Hochberg over all tests, ties sharing one q.

    The distinct values are stored once; ranks and running minima are taken inside p-ranges, and what crosses a range is carried by
    one row per range (at most 73,000 of them, whatever the number of tests).
    """
    distinct = cut_lineage(
        weighted.groupBy(F.col(p).alias("_p"))
        .agg(F.sum(weight).cast("bigint").alias("_w"))
        .withColumn("_bucket", _p_bucket(F.col("_p")))
    )
    by_p = Window.partitionBy("_bucket").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = distinct.withColumn("_rank", F.sum("_w").over(by_p))
    # within a range the least p * n / (before + rank) is needed for each count `before`; the counts come from the ranges
    ranges = distinct.groupBy("_bucket").agg(F.sum("_w").alias("_bw")).withColumn("_all", F.lit(0))
    upto = Window.partitionBy("_all").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("_all")
    offsets = ranges.select(
        "_bucket",
        F.coalesce(F.sum("_bw").over(upto), F.lit(0).cast("bigint")).alias("_before"),
        F.sum("_bw").over(every).alias("_n"),
    )
    raw = cut_lineage(
        ranked.join(F.broadcast(offsets), "_bucket").select(
            "_p", "_bucket", (F.col("_p") * F.col("_n").cast("double") / (F.col("_rank") + F.col("_before")).cast("double")).alias("_raw")
        )
    )
    after = Window.partitionBy("_all").orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    lows = raw.groupBy("_bucket").agg(F.min("_raw").alias("_low")).withColumn("_all", F.lit(0))
    later = lows.select("_bucket", F.min("_low").over(after).alias("_later"))
    down = Window.partitionBy("_bucket").orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.join(F.broadcast(later), "_bucket").select(
        F.col("_p").alias(p), F.least(F.lit(1.0), F.min("_raw").over(down), F.col("_later")).alias(q)
    )


def bh_fdr(df: DataFrame, p: str, id_col: str, q: str = "fdr") -> DataFrame:
    """Add the Benjamini-Hochberg q of every row."""
    values = df.groupBy(p).agg(F.count(F.lit(1)).alias("_rows"))
    return join_unique(df, bh_table(values, p, "_rows", q), [p], how="inner")


def fisher_fdr(df: DataFrame, cells: tuple[str, str, str, str], id_col: str) -> DataFrame:
    """Exact test and FDR per row. Each distinct 2x2 table is tested once, then joined back.

    ``df`` is read twice (for its tables and for the join back): pass a stored or checkpointed frame.
    The tested tables are checkpointed because ranking and joining both need them.
    """
    keys = list(cells)
    tables = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    tested = cut_lineage(fisher_test(tables, cells))
    adjusted = cut_lineage(join_unique(tested.drop("_rows"), bh_table(tested, "fisher_p", "_rows", "fdr"), ["fisher_p"], how="inner"))
    return join_unique(df, adjusted, keys, how="inner")


def direction_label(gap: Column, second: str, first: str, none: str, limit: float = fv.DIRECTION_GAP) -> Column:
    """Label by signed prevalence gap (second minus first)."""
    return F.when(gap >= limit, F.lit(second)).when(gap <= -limit, F.lit(first)).otherwise(F.lit(none))


def discovery_rule(fdr: Column, first: Column, second: Column) -> Column:
    """Significant, and high in one group while low in the other."""
    apart = ((second >= fv.DISCOVERY_HIGH) & (first <= fv.DISCOVERY_LOW)) | (
        (first >= fv.DISCOVERY_HIGH) & (second <= fv.DISCOVERY_LOW)
    )
    return holds((fdr <= fv.DISCOVERY_FDR) & apart)


def replication_rules(
    direction: Column,
    second_label: str,
    first_label: str,
    candidate: Column,
    first: Column,
    second: Column,
    first_routes: tuple[Column, Column],
    second_routes: tuple[Column, Column],
) -> tuple[Column, Column]:
    """(concordant in the second cohort, also consistent over both sub-routes).

    An empty subgroup has a null prevalence and so never passes.
    """
    high, low = fv.CONCORDANT_HIGH, fv.CONCORDANT_LOW

    def concordant(up: Column, down: Column) -> Column:
        return holds((up >= high) & (down <= low))

    def consistent(up: tuple[Column, Column], down: tuple[Column, Column], rule: tuple[float, float]) -> Column:
        return holds((up[0] >= rule[0]) & (up[1] >= rule[0]) & (down[0] <= rule[1]) & (down[1] <= rule[1]))

    same = (
        F.when(direction == second_label, concordant(second, first))
        .when(direction == first_label, concordant(first, second))
        .otherwise(F.lit(False))
    )
    routes = (
        F.when(direction == second_label, consistent(second_routes, first_routes, fv.ROUTE_RULES["second"]))
        .when(direction == first_label, consistent(first_routes, second_routes, fv.ROUTE_RULES["first"]))
        .otherwise(F.lit(False))
    )
    return candidate & same, candidate & same & routes


def stratum_counts(
    calls: DataFrame, block: list[str], stratum: str, first: Column, second: Column, present: Column
) -> DataFrame:
    """Per (block, stratum): totals and present counts of both groups, in one aggregation."""
    return calls.groupBy(*block, stratum).agg(
        F.count_if(first).alias("first_total"),
        F.count_if(first & present).alias("first_present"),
        F.count_if(second).alias("second_total"),
        F.count_if(second & present).alias("second_present"),
    )


def complete_strata(counts: DataFrame, stratum: str) -> DataFrame:
    """Strata that hold both groups; the blank stratum is left out."""
    return counts.filter((F.col(stratum) != "") & (F.col("first_total") > 0) & (F.col("second_total") > 0))


def stratum_gaps(counts: DataFrame, second_expected: Column) -> DataFrame:
    return (
        counts.withColumn("first_prevalence", ratio("first_present", "first_total"))
        .withColumn("second_prevalence", ratio("second_present", "second_total"))
        .withColumn("expected_gap", signed_gap("first_prevalence", "second_prevalence", second_expected))
        .withColumn("direction_concordant", holds(F.col("expected_gap") > 0))
    )


def chi_square_tail(statistic: Column, terms: int = 120) -> Column:
    """Upper tail of chi-square with one degree of freedom: erfc(sqrt(statistic / 2)) as a column expression.

    Below 4.5 by the series of the error function, whose terms are all positive; above by its continued fraction, which
    keeps the relative precision of small tails. Both are exact to about 13 digits. Null or negative statistics give NaN.
    """
    half = statistic.cast("double") / F.lit(2.0)
    z = F.sqrt(half)
    scaled = F.exp(-half) / F.lit(math.sqrt(math.pi))
    start = F.struct((z * 2).alias("term"), (z * 2).alias("total"))

    def add(acc: Column, n: Column) -> Column:
        term = acc["term"] * half * 2 / (n * 2 + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, add, lambda acc: acc["total"])
    below = F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), F.lit(0.0), lambda acc, k: (k / F.lit(2.0)) / (z + acc))
    tail = F.when(half < 2.25, F.lit(1.0) - scaled * series).otherwise(scaled / (z + below))
    return F.when(statistic >= 0, tail).otherwise(F.lit(float("nan")))


def mantel_haenszel(gaps: DataFrame, block: list[str], second_expected: Column) -> DataFrame:
    """Pooled odds ratio across strata with its 95% interval, test statistic and p-value.

    The expected group is the first row of each stratum table. A stratum with a zero cell has 0.5
    added to all four cells. Everything is a sum per block (Mantel-Haenszel estimate,
    Robins-Breslow-Greenland variance), and the p-value a column expression of it.
    """
    up, up_n = (
        F.when(second_expected, F.col(f"second_{x}")).otherwise(F.col(f"first_{x}")) for x in ("present", "total")
    )
    dn, dn_n = (
        F.when(second_expected, F.col(f"first_{x}")).otherwise(F.col(f"second_{x}")) for x in ("present", "total")
    )
    raw = gaps.select(
        *block,
        "expected_gap",
        up.cast("double").alias("_a"),
        (up_n - up).cast("double").alias("_b"),
        dn.cast("double").alias("_c"),
        (dn_n - dn).cast("double").alias("_d"),
    )
    zero = F.least("_a", "_b", "_c", "_d") == 0
    cells = raw.select(
        *block,
        "expected_gap",
        *[(F.col(x) + F.when(zero, F.lit(fv.ZERO_CELL_SHIFT)).otherwise(F.lit(0.0))).alias(x[1:]) for x in ("_a", "_b", "_c", "_d")],
    ).withColumn("n", F.col("a") + F.col("b") + F.col("c") + F.col("d"))
    a, b, c, d, n = (F.col(x) for x in "abcdn")
    ad, bc = a * d / n, b * c / n
    p_share, q_share = (a + d) / n, (b + c) / n
    sums = cells.groupBy(*block).agg(
        F.count(F.lit(1)).alias("strata"),
        F.count_if(F.col("expected_gap") != 0).alias("informative_strata"),
        F.count_if(F.col("expected_gap") > 0).alias("concordant_strata"),
        F.sum(ad).alias("_ad"),
        F.sum(bc).alias("_bc"),
        F.sum(a - (a + b) * (a + c) / n).alias("_diff"),
        F.sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))).alias("_var"),
        F.sum(p_share * ad).alias("_pr"),
        F.sum(p_share * bc + q_share * ad).alias("_ps_qr"),
        F.sum(q_share * bc).alias("_qs"),
    )
    half = F.lit(fv.CI_Z) * F.sqrt(
        F.try_divide("_pr", 2 * F.col("_ad") * F.col("_ad"))
        + F.try_divide("_ps_qr", 2 * F.col("_ad") * F.col("_bc"))
        + F.try_divide("_qs", 2 * F.col("_bc") * F.col("_bc"))
    )
    log_or = F.ln(F.try_divide("_ad", "_bc"))
    statistic = F.try_divide(F.col("_diff") * F.col("_diff"), "_var")
    return sums.select(
        *block,
        "strata",
        "informative_strata",
        "concordant_strata",
        F.try_divide("_ad", "_bc").alias("pooled_odds_ratio"),
        F.exp(log_or - half).alias("ci_lower"),
        F.exp(log_or + half).alias("ci_upper"),
        statistic.alias("statistic"),
    ).withColumn("p_value", chi_square_tail(F.col("statistic")))


def leave_one_out(counts: DataFrame, block: list[str], stratum: str, second_expected: Column) -> DataFrame:
    """Expected-direction gap per block with each non-blank stratum left out.

    Total minus own, from per-stratum counts: a stratum sees its block total, never the rows again.
    """
    names = ["first_total", "first_present", "second_total", "second_present"]
    totals = counts.groupBy(*block).agg(
        *[F.sum(n).alias(f"_{n}") for n in names]
    )
    joined = join_unique(counts.filter(F.col(stratum) != ""), totals, block, how="inner")
    rest = joined.select(*block, stratum, *[(F.col(f"_{n}") - F.col(n)).alias(n) for n in names])
    return stratum_gaps(rest, second_expected).select(
        *block,
        F.col(stratum).alias("omitted_stratum"),
        F.col("first_total").alias("remaining_first"),
        F.col("second_total").alias("remaining_second"),
        "expected_gap",
        F.col("direction_concordant").alias("direction_retained"),
    )


def robustness(left_out: DataFrame, block: list[str]) -> DataFrame:
    """Per block: omissions, whether all keep the direction, smallest and largest gap."""
    return left_out.groupBy(*block).agg(
        F.countDistinct("omitted_stratum").alias("omitted_strata"),
        F.bool_and("direction_retained").alias("all_retain_direction"),
        F.min("expected_gap").alias("minimum_gap"),
        F.max("expected_gap").alias("maximum_gap"),
    )


def attach_statistics(summary: DataFrame, keys: list[str], *statistics: DataFrame) -> DataFrame:
    """The summary with every statistics table joined on the keys; a block without statistics keeps nulls."""
    out = summary
    for table in statistics:
        out = out.join(table, keys, "left")
    return out


def two_panel_counts(
    calls: DataFrame, block: str, second: Column, first: Column, present: Column, strict: Column
) -> DataFrame:
    """Present and absent counts of both groups per block, on all entities and (``strict_``) on the strict panel."""
    cells = {
        "second_present": second & present, "second_absent": second & ~present,
        "first_present": first & present, "first_absent": first & ~present,
    }
    return calls.groupBy(block).agg(
        *[F.count_if(c).alias(n) for n, c in cells.items()], *[F.count_if(holds(strict) & c).alias(f"strict_{n}") for n, c in cells.items()]
    )
