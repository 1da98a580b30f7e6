"""One row per key, and the quality-first selection ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.text import text
from cohortloom import fixed_values as fv
from cohortloom.operators.skew import join_unique


def best_per_key(df: DataFrame, keys: list[str], score: str, ordinal: str, columns: list[str]) -> DataFrame:
    """Row with the highest score per key; the lowest ordinal wins ties.

    An aggregate, not a window: partial results are merged map-side, so a key that holds a third of
    the rows costs no more than any other.
    """
    best = F.min_by(F.struct(*columns), F.struct((-F.col(score)).alias("s"), F.col(ordinal).alias("o")))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def first_per_key(df: DataFrame, keys: list[str], ordinal: str, columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.min_by(c, ordinal).alias(c) for c in columns])


def last_per_key(df: DataFrame, keys: list[str], ordinal: str, columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max_by(c, ordinal).alias(c) for c in columns])


def failure_reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that are not met, joined by ';' in rule order."""
    return F.concat_ws(";", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])


def selection_ledger(
    df: DataFrame,
    id_col: str,
    pair_key: str,
    entity: str,
    score: str,
    reasons: str,
    ordinal: str,
) -> DataFrame:
    """Quality first, then one row per pair key, then one row per entity; a decision for every row.

    Rows with reasons never compete. Winners are the highest score, first row on ties; between pair
    winners of one entity a tie goes to the pair seen first. Two aggregations and two skew-safe
    joins; no window over a key.
    """
    passed = F.col(reasons) == ""
    entity_key = F.when(text(entity) != "", text(entity)).otherwise(
        F.concat(F.lit("no_entity:"), F.col(id_col).cast("string"))
    )
    rows = df.withColumn("_entity", entity_key)

    pairs = rows.groupBy(pair_key).agg(
        F.min_by(
            id_col, F.when(passed, F.struct((-F.col(score)).alias("s"), F.col(ordinal).alias("o")))
        ).alias("pair_winner"),
        F.min(F.when(passed, F.col(ordinal))).alias("_pair_first"),
    )
    rows = join_unique(rows, pairs, [pair_key])
    pair_selected = passed & (F.col(id_col) == F.col("pair_winner"))

    entities = rows.groupBy("_entity").agg(
        F.min_by(
            id_col, F.when(pair_selected, F.struct((-F.col(score)).alias("s"), F.col("_pair_first").alias("o")))
        ).alias("entity_winner"),
    )
    rows = join_unique(rows, entities, ["_entity"])
    in_pair = F.coalesce(pair_selected, F.lit(False))
    in_entity = F.coalesce(in_pair & (F.col(id_col) == F.col("entity_winner")), F.lit(False))
    decision = (
        F.when(~passed, F.lit(fv.SELECTION_DECISIONS["qc"]))
        .when(~in_pair, F.lit(fv.SELECTION_DECISIONS["pair"]))
        .when(~in_entity, F.lit(fv.SELECTION_DECISIONS["entity"]))
        .otherwise(F.lit(fv.SELECTION_DECISIONS["selected"]))
    )
    why = (
        F.when(~passed, F.col(reasons))
        .when(~in_pair, F.concat(F.lit(fv.SELECTION_REASONS["pair"]), text("pair_winner")))
        .when(~in_entity, F.concat(F.lit(fv.SELECTION_REASONS["entity"]), text("entity_winner")))
        .otherwise(F.lit(""))
    )
    return rows.select(
        *df.columns,
        passed.alias("qc_pass"),
        "pair_winner",
        "entity_winner",
        in_pair.alias("selected_after_pair"),
        in_entity.alias("selected_after_entity"),
        decision.alias("selection_decision"),
        why.alias("selection_reason"),
    )


def ledger_counts(ledger: DataFrame) -> DataFrame:
    """One-row run summary of a ledger."""
    return ledger.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("qc_pass").alias("qc_pass_rows"),
        F.count_if("selected_after_pair").alias("after_pair"),
        F.count_if("selected_after_entity").alias("after_entity"),
    )


def category_counts(df: DataFrame, column: str, ordinal: str) -> DataFrame:
    """Rows per category with the first place it was seen; order by (-n, first_seen) to report."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first_seen"))
