"""Ordered rules that label rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.functions.numeric import all_true, holds, within
from cohortloom.functions.text import list_has_any, text, truth

GATES = ("assembly", "route_concordance", "checkm2", "gunc", "minor_alleles", "type_anchor")


def rule_cascade(df: DataFrame, rules: list[tuple[Column, dict[str, str | Column]]], about: Column) -> DataFrame:
    """First rule that holds gives the output columns; a row without a rule is an error naming it."""
    names = list(rules[0][1])

    def packed(values: dict[str, str | Column]) -> Column:
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in ((n, values[n]) for n in names)])

    chain = None
    for condition, values in rules:
        hit = holds(condition)
        chain = F.when(hit, packed(values)) if chain is None else chain.when(hit, packed(values))
    shape = "struct<" + ",".join(f"{n}:string" for n in names) + ">"
    failed = F.from_json(F.raise_error(F.concat(F.lit("no rule for "), text(about))).cast("string"), shape)
    return df.withColumn("_rule", chain.otherwise(failed)).select(*df.columns, "_rule.*")


def route_gates(df: DataFrame, a: str, b: str, threshold: Column) -> DataFrame:
    """Six quality gates per sample from the metrics of two routes (columns '<route>_<metric>').

    Every bound is inclusive and must hold for the worse of the two routes.
    """
    bounds = fv.GATE_BOUNDS

    def low(metric: str) -> Column:
        return F.least(F.col(f"{a}_{metric}"), F.col(f"{b}_{metric}"))

    def high(metric: str) -> Column:
        return F.greatest(F.col(f"{a}_{metric}"), F.col(f"{b}_{metric}"))

    return df.withColumns(
        {
            "assembly_gate": all_true(
                within(low("size"), bounds["size"][0], None),
                within(high("size"), None, bounds["size"][1]),
                within(low("gc"), bounds["gc"][0], None),
                within(high("gc"), None, bounds["gc"][1]),
                within(high("contigs"), None, bounds["contigs"]),
                within(low("n50"), bounds["n50"], None),
            ),
            "route_concordance_gate": within(low("identity"), bounds["identity"], None)
            & within(low("fraction"), bounds["reciprocal_fraction"], None),
            "checkm2_gate": within(low("completeness"), bounds["completeness"], None)
            & within(high("contamination"), None, bounds["contamination"]),
            "gunc_gate": truth(f"{a}_gunc") & truth(f"{b}_gunc"),
            "minor_alleles_gate": holds(high("burden") <= threshold),
            "type_anchor_gate": holds(F.col(f"{a}_type_name") == F.col(f"{b}_type_name"))
            & within(low("type_identity"), bounds["type_identity"], None)
            & within(low("type_fraction"), bounds["type_fraction"], None),
        }
    )


def recovery_decision(same_anchor: Column) -> Column:
    """Decision from the six gates: all passed, else the first failing cause in fixed priority."""
    gate = {g: F.coalesce(F.col(f"{g}_gate"), F.lit(False)) for g in GATES}
    names = fv.RECOVERY_DECISIONS
    return (
        F.when(
            all_true(*gate.values()),
            F.when(holds(same_anchor), F.lit(names["same_anchor"])).otherwise(F.lit(names["other_anchor"])),
        )
        .when(~gate["minor_alleles"], F.lit(names["minor_alleles"]))
        .when(~gate["route_concordance"], F.lit(names["route_concordance"]))
        .when(~gate["assembly"] | ~gate["checkm2"] | ~gate["gunc"], F.lit(names["genome_qc"]))
        .otherwise(F.lit(names["type_anchor"]))
    )


def evidence_tier(
    supported: Column, membership: Column, core: list[str], secondary: str, names: dict[str, str]
) -> Column:
    """Tier of a feature; a secondary mark overrides core membership, which overrides plain support."""
    in_core = list_has_any(membership, core)
    return (
        F.when(text(membership).contains(secondary), F.lit(names["secondary"]))
        .when(supported & in_core, F.lit(names["core"]))
        .when(supported, F.lit(names["supported"]))
        .otherwise(F.lit(names["none"]))
    )


def context_consistency(
    panel: Column, nearest_label: Column, allowed: dict[str, list[str]], monophyletic: Column, names: dict[str, str]
) -> Column:
    """Does the nearest reference label fit the panel? A label that is not monophyletic overrides."""
    chain = F.when(monophyletic == "false", F.lit(names["not_monophyletic"]))
    for label, accepted in allowed.items():
        chain = chain.when((panel == label) & ~F.coalesce(nearest_label.isin(*accepted), F.lit(False)), F.lit(names["conflict"]))
    return chain.otherwise(F.lit(names["supported"]))


def strict_quality(source: Column, public: str, completeness: Column, contamination: Column, contigs: Column, n50: Column) -> Column:
    """Strict-quality inclusion of public entities; an absent metric excludes."""
    limits = fv.STRICT_QUALITY
    return all_true(
        holds(source == public),
        within(completeness, limits["completeness"], None),
        within(contamination, None, limits["contamination"]),
        within(contigs, None, limits["contigs"]),
        within(n50, limits["n50"], None),
    )


def analysis_labels(evidence: DataFrame) -> DataFrame:
    """Seven label columns per sample, first rule that holds; a sample without a rule, or a margin that is no number, is an error."""
    species, fine = F.col("best_public_reporting_species"), F.col("best_public_fine_label")
    group, anchor = F.col("best_type_broad_group"), F.lower("best_type_fine_label")
    close = F.col("type_distinct_fine_label_ani_margin").cast("double") < fv.LABEL_MARGIN
    genus = "Mycobacterium "
    conditions = {
        "colombiense": (species == genus + "colombiense") & (group == genus + "colombiense"),
        "avium_hominissuis": (species == genus + "avium") & fine.contains("hominissuis"),
        "avium": species == genus + "avium",
        "mp_mip": group == genus + "paraintracellulare",
        "chimaera": F.lower(fine).contains("chimaera"),
        "yongonense": anchor.contains("yongonense") & close,
        "tmi": group == genus + "intracellulare",
    }
    rules = [(holds(c), dict(zip(fv.LABEL_COLUMNS, fv.LABEL_TEXTS[name], strict=True))) for name, c in conditions.items()]
    return rule_cascade(evidence, rules, F.col("sample_id"))
