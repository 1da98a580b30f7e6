"""Threshold calibration, sensitivity sweeps, condition roll-ups and the benchmark design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.functions.numeric import all_true, holds, ratio
from cohortloom.operators import checks
from cohortloom.operators.quantiles import middle_median


def with_parameters(df: DataFrame, values: list[float], name: str) -> DataFrame:
    """Every row once per parameter value; the short list is a literal, so there is no join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def control_threshold(
    controls: DataFrame, pair: str, burden: str, multiplier: float = fv.CONTROL_MULTIPLIER
) -> DataFrame:
    """One row: multiplier times the largest burden of the pure controls, and how many there are."""
    return controls.agg(
        (F.max(burden) * F.lit(multiplier)).alias("threshold"),
        F.count(F.lit(1)).alias("controls"),
        F.countDistinct(pair).alias("control_pairs"),
    )


def control_design_check(
    controls: DataFrame, pair: str, expected: dict[str, int], name: str = "pure controls"
) -> DataFrame:
    """One check row per expected pair: its number of control rows."""
    frames = [
        checks.row_count(controls.filter(F.col(pair) == key), n, f"{name}: {key}") for key, n in expected.items()
    ]
    return checks.combine(*frames)


def threshold_status(design: DataFrame, complete: str, provisional: str) -> Column:
    """Scalar label: complete when every design check holds, else provisional."""
    return F.when(design.agg(F.bool_and("ok")).scalar(), F.lit(complete)).otherwise(F.lit(provisional))


def flag_positive(df: DataFrame, primary: Column, auxiliary: Column, primary_limit: Column, auxiliary_limit: Column) -> DataFrame:
    """Strictly above either limit, and the combined flag."""
    return (
        df.withColumn("primary_positive", holds(primary > primary_limit))
        .withColumn("auxiliary_positive", holds(auxiliary > auxiliary_limit))
        .withColumn("combined_positive", F.col("primary_positive") | F.col("auxiliary_positive"))
    )


def rule_satisfied(rule: Column, primary: Column, auxiliary: Column) -> Column:
    """Does the observed call meet the named expectation? An unknown name is an error."""
    return (
        F.when(rule == fv.EXPECTED_RULES[0], ~primary & ~auxiliary)
        .when(rule == fv.EXPECTED_RULES[10], primary | auxiliary)
        .when(rule == fv.EXPECTED_RULES[20], primary)
        .otherwise(F.raise_error(F.concat(F.lit("unknown rule: "), F.coalesce(rule, F.lit("")))).cast("boolean"))
    )


def threshold_sweep_calls(
    samples: DataFrame,
    id_col: str,
    burdens: list[str],
    gates: list[str],
    decision: str,
    baseline: Column,
    multipliers: list[float],
) -> DataFrame:
    """One row per (multiplier, sample): threshold, worst burden, gate results and eligibility."""
    worst = F.greatest(*[F.col(b) for b in burdens]) if len(burdens) > 1 else F.col(burdens[0])
    rows = samples.select(
        id_col,
        *burdens,
        worst.alias("maximum_burden"),
        all_true(*[F.coalesce(F.col(g), F.lit(False)) for g in gates]).alias("other_gates"),
        F.col(decision).alias("frozen_decision"),
        baseline.alias("_baseline"),
    )
    return (
        with_parameters(rows, multipliers, "multiplier")
        .withColumn("threshold", F.col("_baseline") * F.col("multiplier"))
        .withColumn("burden_gate", holds(F.col("maximum_burden") <= F.col("threshold")))
        .withColumn("eligible", F.col("other_gates") & F.col("burden_gate"))
        .drop("_baseline")
    )


def threshold_sweep_summary(calls: DataFrame, prefix: str = fv.RESCUED_PREFIX) -> DataFrame:
    """Per multiplier: counts in and out, and whether the frozen result is reproduced exactly.

    Set equality is row-wise (a sample is eligible exactly when its frozen decision says so), so no
    id list is gathered. ``sweep_members`` gives the sorted ids as rows.
    """
    frozen = F.col("frozen_decision").startswith(prefix)
    return calls.groupBy("multiplier", "threshold").agg(
        F.count_if("eligible").alias("eligible_count"),
        F.count_if(~F.col("eligible")).alias("excluded_count"),
        F.bool_and(F.col("eligible") == frozen).alias("reproduces_frozen"),
    )


def sweep_members(calls: DataFrame, id_col: str) -> DataFrame:
    """Sorted membership lists in long form: (multiplier, eligible, id)."""
    return calls.select("multiplier", "eligible", id_col).orderBy("multiplier", "eligible", id_col)


def floor_sweep_calls(
    samples: DataFrame,
    floors: list[float],
    best: Column,
    first_score: Column,
    second_score: Column,
    first: str,
    second: str,
    outside: str,
) -> DataFrame:
    """One row per (floor, sample): assigned to the larger score when the best score reaches the floor.

    Equal scores go to the first group.
    """
    scored = samples.withColumn("_best", best).withColumn("_lead", first_score >= second_score)
    rows = with_parameters(scored, floors, "floor").withColumn("qualified", holds(F.col("_best") >= F.col("floor")))
    assigned = F.when(F.col("_lead"), F.lit(first)).otherwise(F.lit(second))
    return rows.withColumn(
        "assigned_group", F.when(F.col("qualified"), assigned).otherwise(F.lit(outside))
    ).drop("_best", "_lead")


def floor_sweep_blocks(
    calls: DataFrame, block_calls: DataFrame, id_col: str, block: str, present: str, expected: str, first: str, second: str
) -> DataFrame:
    """Per (floor, block): presence in the expected and the other group and whether direction holds."""
    joined = calls.filter("qualified").select(id_col, "floor", "assigned_group").join(block_calls, id_col)
    own = F.col("assigned_group") == F.col(expected)
    other = F.col("assigned_group") == F.when(F.col(expected) == first, F.lit(second)).otherwise(F.lit(first))
    hit = F.coalesce(F.col(present), F.lit(False))
    return (
        joined.groupBy("floor", block, expected)
        .agg(
            F.count_if(own & hit).alias("expected_present"),
            F.count_if(own).alias("expected_total"),
            F.count_if(other & hit).alias("other_present"),
            F.count_if(other).alias("other_total"),
        )
        .withColumn(
            "direction_retained",
            holds(ratio("expected_present", "expected_total") > ratio("other_present", "other_total")),
        )
    )


def floor_sweep_summary(calls: DataFrame, blocks: DataFrame, expected: str, qc: str, first: str, second: str) -> DataFrame:
    """Per floor: qualified counts, agreement with the expectation and whether every block keeps direction."""
    counts = calls.groupBy("floor").agg(
        F.count_if("qualified").alias("qualified_total"),
        F.count_if(F.col("assigned_group") == first).alias("qualified_first"),
        F.count_if(F.col("assigned_group") == second).alias("qualified_second"),
        F.count_if(F.col("qualified") & F.coalesce(F.col(qc), F.lit(False))).alias("qualified_qc_pass"),
        F.count_if(F.col("qualified") & (F.col("assigned_group") == F.col(expected))).alias("expected_concordant"),
    )
    kept = blocks.groupBy("floor").agg(F.bool_and("direction_retained").alias("all_directions_retained"))
    return counts.join(kept, "floor", "left").withColumn(
        "all_directions_retained", F.coalesce("all_directions_retained", F.lit(False))
    )


def condition_rollup(
    df: DataFrame, keys: list[str], depth: str, rates: dict[str, str], flags: dict[str, str]
) -> DataFrame:
    """Per condition: rows, exact median depth, mean/min/max of each rate and the share of each flag."""
    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for name, column in rates.items():
        aggregates += [
            F.avg(column).alias(f"{name}_mean"), F.min(column).alias(f"{name}_min"), F.max(column).alias(f"{name}_max")
        ]
    aggregates += [F.avg(F.col(c).cast("double")).alias(f"{n}_rate") for n, c in flags.items()]
    return df.groupBy(*keys).agg(*aggregates).join(middle_median(df, keys, depth, "median_depth"), keys)


def positive_counts(df: DataFrame, key: str, flags: list[str], burdens: list[str]) -> DataFrame:
    """Per fraction: conditions, positives of each flag and the range of each burden."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("conditions"),
        *[F.count_if(f).alias(f) for f in flags],
        *[a for b in burdens for a in (F.min(b).alias(f"{b}_min"), F.max(b).alias(f"{b}_max"))],
    )


def design_grid(pairs: DataFrame, seed: int = fv.DESIGN_SEED) -> DataFrame:
    """All planned conditions of a pair table (pair_id, left_source, right_source, pair_role, all_depths).

    Both directions of every pair; pairs marked ``all_depths`` get every depth and fraction, the
    others only the base condition. The parameter lists are literals, so nothing is joined.
    """
    base_percent, base_depth = fv.DESIGN_BASE
    roles = fv.DESIGN_ROLES
    cells = F.array(
        *[
            F.struct(F.lit(f).cast("bigint").alias("minor_percent"), F.lit(d).cast("bigint").alias("total_pairs"))
            for d in fv.DESIGN_DEPTHS
            for f in fv.DESIGN_FRACTIONS
        ]
    )
    directions = F.array(
        F.struct(F.col("left_source").alias("major"), F.col("right_source").alias("minor")),
        F.struct(F.col("right_source").alias("major"), F.col("left_source").alias("minor")),
    )
    is_base = (F.col("minor_percent") == base_percent) & (F.col("total_pairs") == base_depth)
    rule = F.when(F.col("minor_percent") == 0, F.lit(fv.EXPECTED_RULES[0])).when(
        F.col("minor_percent") == 10, F.lit(fv.EXPECTED_RULES[10])
    )
    return (
        pairs.withColumn("_d", F.explode(directions))
        .withColumn("_c", F.explode(cells))
        .select("pair_id", "pair_role", "all_depths", "_d.*", "_c.*")
        .filter(F.col("all_depths") | is_base)
        .withColumn("seed", F.lit(seed).cast("bigint"))
        .select(
            F.format_string(
                fv.CONDITION_NAME, "pair_id", "major", "minor", "minor_percent", "total_pairs", "seed"
            ).alias("condition_id"),
            "pair_id",
            "pair_role",
            "major",
            "minor",
            "minor_percent",
            "total_pairs",
            "seed",
            F.when(~F.col("all_depths"), F.lit(roles["base"]))
            .when(is_base, F.lit(roles["base_and_depth"]))
            .otherwise(F.lit(roles["depth"]))
            .alias("design_role"),
            rule.otherwise(F.lit(fv.EXPECTED_RULES[20])).alias("expected_rule"),
        )
    )


def choose_conditions(grid: DataFrame, pattern: str, verify: bool = True) -> DataFrame:
    """Conditions whose id matches a pattern; an empty choice is an error."""
    chosen = grid.filter(F.col("condition_id").rlike(pattern)) if pattern else grid
    if verify and chosen.isEmpty():
        raise ValueError("no condition selected")
    return chosen
