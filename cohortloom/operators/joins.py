"""Equi-joins with the guarantees the analysis relies on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators import checks
from cohortloom.operators.choice import first_records


def lookup_checks(left: DataFrame, right: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Checks of a strict lookup: right key unique, every left row matched."""
    return checks.combine(
        checks.key_unique(right, keys, f"{label}: right key unique"),
        checks.no_unmatched(left, right, keys, f"{label}: every row matched"),
    )


def strict_lookup(left: DataFrame, right: DataFrame, keys: list[str], label: str, verify: bool = True) -> DataFrame:
    """Many-to-one join in which a missing or repeated right key is an error."""
    if verify:
        checks.require(lookup_checks(left, right, keys, label))
    return left.join(right, keys, "inner")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], label: str, verify: bool = True) -> DataFrame:
    """Left join in which neither side may repeat a key."""
    if verify:
        checks.require(
            checks.combine(
                checks.key_unique(left, keys, f"{label}: left key unique"),
                checks.key_unique(right, keys, f"{label}: right key unique"),
            )
        )
    return left.join(right, keys, "left")


def lookup_or(left: DataFrame, right: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Left join; named columns take a default where there is no partner."""
    joined = left.join(right, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def keep_known(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join: rows with an unknown key are dropped."""
    return left.join(right, keys, "inner")


def membership_roles(full: DataFrame, chosen: DataFrame, key: str, inside: str, outside: str) -> DataFrame:
    """Label every row by whether its key is in the chosen set."""
    flags = chosen.select(key).distinct().withColumn("_in", F.lit(True))
    return (
        full.join(flags, key, "left")
        .withColumn("cohort_role", F.when(F.col("_in"), F.lit(inside)).otherwise(F.lit(outside)))
        .drop("_in")
    )


def completion_audit(manifest: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Status of every planned row: complete when a result row exists, else missing."""
    done = results.select(key).distinct().withColumn("_done", F.lit(True))
    return (
        manifest.select(key)
        .join(done, key, "left")
        .select(key, F.when(F.col("_done"), F.lit("complete")).otherwise(F.lit("missing")).alias("status"))
    )


def remaining_work(manifest: DataFrame, results: DataFrame, key: str) -> DataFrame:
    return manifest.join(results.select(key), key, "left_anti")


def mate_verdict(first_key: Column, second_key: Column) -> Column:
    return (
        F.when(first_key.isNull() | second_key.isNull(), F.lit("missing_mate"))
        .when(first_key != second_key, F.lit("key_mismatch"))
        .otherwise(F.lit("paired"))
    )


def pair_mates(first: DataFrame, second: DataFrame, keys: list[str], name_key: str) -> DataFrame:
    """Full join of two record lists on position, with the verdict for every position."""
    a = first.select(*keys, F.col(name_key).alias("first_key"))
    b = second.select(*keys, F.col(name_key).alias("second_key"))
    return a.join(b, keys, "full_outer").withColumn(
        "pair_status", mate_verdict(F.col("first_key"), F.col("second_key"))
    )


def first_pairs(first: DataFrame, second: DataFrame, position: str, name_key: str, n: int) -> DataFrame:
    """The first ``n`` record pairs of two mate lists in position order: (position, first_key, second_key).

    Each list is cut by counts of its positions, without a sort. Both lists give as many records as the shorter one has
    up to n; a list that ends before the other and before n is an error, and so are keys that differ at one position.
    """
    cut = [first_records(side.select(position, name_key), position, n) for side in (first, second)]
    paired = pair_mates(*cut, [position], name_key)
    status = F.col("pair_status")
    checked = F.when(status == "paired", F.col("first_key")).otherwise(
        F.raise_error(F.concat(status, F.lit(" at record "), F.col(position).cast("string"))).cast(first.schema[name_key].dataType)
    )
    return paired.select(position, checked.alias("first_key"), "second_key")


def evidence_rows(long: DataFrame, key: str, route: str, routes: list[str], metrics: list[str]) -> DataFrame:
    """One row per key with every metric of every route side by side.

    One aggregation instead of one self-join per route; ``routes`` is the known list of routes.
    """
    picks: list[Column] = [
        F.max(F.when(F.col(route) == r, F.col(m))).alias(f"{r}_{m}") for m in metrics for r in routes
    ]
    return long.groupBy(key).agg(*picks)
