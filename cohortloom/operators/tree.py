"""Rooted-tree questions on a node table (panel, node, parent, branch_length, support, is_tip).

A tree is climbed by doubling: rung k of its ladder leads from a node to its ancestor 2**k hops up. Answers are folded over
all descendants or all ancestors of every node, one rung after another, so a tree of n nodes and height h takes log2(h) rounds of at
most n rows each; pairs of tips and ancestors are never listed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.text import count_of
from cohortloom.operators.skew import join_unique
from cohortloom.session import cut_lineage


@dataclass
class Ladder:
    """``rungs[k]``: (panel, node, up, length, hops) to the ancestor 2**k hops up; ``depth``: (panel, node, depth)."""

    rungs: list[DataFrame]
    depth: DataFrame


def ladder(nodes: DataFrame, max_rounds: int = 40) -> Ladder:
    """Rungs of every tree of the node table. A parent cycle, or a tree over 2**max_rounds high, is an error.

    Null branch lengths count as zero; a parent without a row of its own is a root.
    """
    linked = F.col("parent").isNotNull()
    reach = cut_lineage(
        nodes.select(
            "panel", "node", F.col("parent").alias("up"),
            F.when(linked, F.coalesce(F.col("branch_length").cast("double"), F.lit(0.0))).otherwise(0.0).alias("length"),
            linked.cast("bigint").alias("hops"),
        )
    )
    rungs: list[DataFrame] = []
    for _ in range(max_rounds):
        climbing = reach.filter("up is not null")
        if climbing.isEmpty():
            return Ladder(rungs, reach.select("panel", "node", F.col("hops").alias("depth")))
        rungs.append(climbing)
        above = reach.select(
            "panel", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("length").alias("_length"), F.col("hops").alias("_hops")
        )
        none = F.lit(0)
        grown = join_unique(climbing, above, ["panel", "up"]).select(
            "panel", "node", F.col("_up").alias("up"), (F.col("length") + F.coalesce("_length", none)).alias("length"),
            (F.col("hops") + F.coalesce("_hops", none)).alias("hops"),
        )
        reach = cut_lineage(grown.unionByName(reach.filter("up is null")))
    raise RuntimeError("parents form a cycle, or the tree is higher than the allowed rounds reach")


def over_descendants(
    rungs: list[DataFrame], start: DataFrame, value: str, moved: Column, merge: Callable[[str], Column], also: tuple[str, ...] = ()
) -> DataFrame:
    """Fold ``value`` of ``start`` (panel, node, *also, value) over every node and all nodes below it.

    ``moved`` is the value as seen one rung up (it may use ``length`` and ``hops``). Each node below is met once, so sums are exact.
    """
    keys = ["panel", "node", *also]
    current = start
    for rung in rungs:
        met = join_unique(current, rung, ["panel", "node"], how="inner").select(
            "panel", F.col("up").alias("node"), *also, moved.alias(value)
        )
        current = cut_lineage(current.unionByName(met).groupBy(*keys).agg(merge(value).alias(value)))
    return current


def over_ancestors(rungs: list[DataFrame], start: DataFrame, value: str, moved: Column, merge: Callable[[str], Column]) -> DataFrame:
    """Fold ``value`` of ``start`` (one row per panel and node) over every node and all nodes above it."""
    current = start
    for rung in rungs:
        above = current.select("panel", F.col("node").alias("up"), value)
        met = join_unique(rung, above, ["panel", "up"], how="inner").select("panel", "node", moved.alias(value))
        current = cut_lineage(current.unionByName(met).groupBy("panel", "node").agg(merge(value).alias(value)))
    return current


def nearest_tip(tree: Ladder, query_tips: DataFrame, reference_tips: DataFrame) -> DataFrame:
    """Nearest reference tip of every query tip by path length: (panel, tip, nearest_tip, path_length).

    Every node keeps its closest reference tip below, then takes the best over its ancestors. Branch lengths must
    not be negative. Ties go to the lowest reference ``ordinal``.
    """
    best = F.col("_best")
    start = reference_tips.groupBy("panel", "node").agg(
        F.min(F.struct(F.lit(0.0).alias("d"), F.col("ordinal").alias("o"), F.col("node").alias("t"))).alias("_best")
    )
    moved = F.struct((best["d"] + F.col("length")).alias("d"), best["o"].alias("o"), best["t"].alias("t"))
    below = over_descendants(tree.rungs, start, "_best", moved, F.min)
    found = over_ancestors(tree.rungs, below, "_best", moved, F.min)
    return found.join(query_tips.select("panel", "node"), ["panel", "node"], "left_semi").select(
        "panel", F.col("node").alias("tip"), best["t"].alias("nearest_tip"), best["d"].alias("path_length")
    )


def tips_below(tree: Ladder, tips: DataFrame, name: str) -> DataFrame:
    """(panel, ancestor, name): how many of the given tips stand at or below each node; nodes without any are absent."""
    start = tips.select("panel", "node").distinct().withColumn(name, F.lit(1).cast("bigint"))
    return over_descendants(tree.rungs, start, name, F.col(name), F.sum).withColumnRenamed("node", "ancestor")


def common_ancestors(tree: Ladder, labelled_tips: DataFrame, nodes: DataFrame) -> DataFrame:
    """Deepest node at or above every tip of a label: (panel, label, n_tips, ancestor, support).

    The tips of a label climb to the depth of its highest one, then together by the largest rungs that do not yet unite them; one more
    hop unites the rest. Nodes that have met are one row. Labels over several trees have no ancestor and no row.
    """
    label = ["panel", "label"]
    tips = labelled_tips.select("panel", "node", "label")
    sizes = tips.groupBy(*label).agg(F.count(F.lit(1)).alias("n_tips"))
    placed = join_unique(tips.distinct(), tree.depth, ["panel", "node"]).withColumn("depth", F.coalesce("depth", F.lit(0).cast("bigint")))
    highest = placed.groupBy(*label).agg(F.min("depth").alias("_top"))
    at = cut_lineage(join_unique(placed, highest, label).select(*label, "node", (F.col("depth") - F.col("_top")).alias("climb")))
    for k in reversed(range(len(tree.rungs))):
        up = tree.rungs[k].select("panel", "node", "up")
        bit = F.col("climb").bitwiseAND(1 << k) != 0
        climbed = join_unique(at.filter(bit), up, ["panel", "node"], how="inner").select(*label, F.col("up").alias("node"), "climb")
        at = cut_lineage(climbed.unionByName(at.filter(~bit)).distinct())
    at = cut_lineage(at.select(*label, "node").distinct())
    for rung in reversed(tree.rungs):
        seen = join_unique(at, rung.select("panel", "node", "up"), ["panel", "node"])
        apart = seen.groupBy(*label).agg((F.min("up") != F.max("up")).alias("_apart"))
        at = cut_lineage(
            join_unique(seen, apart, label).select(*label, F.when(F.col("_apart"), F.col("up")).otherwise(F.col("node")).alias("node")).distinct()
        )
    last = at if not tree.rungs else join_unique(at, tree.rungs[0].select("panel", "node", "up"), ["panel", "node"])
    up = F.col("up") if tree.rungs else F.lit(None).cast("string")
    one = F.min("node") == F.max("node")
    met = F.when(one, F.min("node")).when((F.count(up) == F.count("node")) & (F.min(up) == F.max(up)), F.min(up))
    found = last.groupBy(*label).agg(met.alias("ancestor")).filter("ancestor is not null")
    support = nodes.select("panel", F.col("node").alias("ancestor"), "support")
    return found.join(sizes, label).select(*label, "n_tips", "ancestor").join(support, ["panel", "ancestor"], "left")


def label_monophyly(tree: Ladder, labelled_tips: DataFrame, reference_tips: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per label: tips, testable, monophyletic among labelled tips, support, reference tips inside.

    A label with one tip is not testable.
    """
    ancestors = common_ancestors(tree, labelled_tips, nodes)
    inside_own = tips_below(tree, labelled_tips, "_labelled")
    inside_reference = tips_below(tree, reference_tips, "_reference")
    key = ["panel", "ancestor"]
    single = F.col("n_tips") == 1
    return (
        ancestors.join(inside_own, key, "left")
        .join(inside_reference, key, "left")
        .select(
            "panel",
            "label",
            "n_tips",
            (~single).alias("testable"),
            F.when(single, F.lit("not_applicable_singleton"))
            .when(F.col("_labelled") == F.col("n_tips"), F.lit("true"))
            .otherwise(F.lit("false"))
            .alias("monophyletic"),
            F.when(~single, F.col("ancestor")).alias("ancestor"),
            F.when(~single, F.col("support")).alias("support"),
            F.when(~single, F.coalesce("_reference", F.lit(0).cast("bigint"))).alias("reference_inside"),
        )
    )


def reference_labels_inside(tree: Ladder, ancestors: DataFrame, reference_tips: DataFrame) -> DataFrame:
    """Reference labels below each common ancestor with their counts, one row per label pair.

    Tips are counted at the nearest chosen ancestor above them; counts then climb the tree of the chosen ancestors alone.
    """
    targets = cut_lineage(ancestors.select("panel", F.col("ancestor").alias("node")).distinct())
    nearest = F.col("_near")
    start = targets.select("panel", "node", F.struct(F.lit(0).cast("bigint").alias("hops"), F.col("node").alias("target")).alias("_near"))
    moved = F.struct((nearest["hops"] + F.col("hops")).alias("hops"), nearest["target"].alias("target"))
    near = over_ancestors(tree.rungs, start, "_near", moved, F.min).select("panel", "node", nearest["target"].alias("target"))
    tips = reference_tips.select("panel", "node", F.col("label").alias("reference_label"))
    counted = (
        join_unique(tips, near, ["panel", "node"], how="inner")
        .groupBy("panel", F.col("target").alias("node"), "reference_label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    above = targets.select("panel", "node")
    if tree.rungs:
        above = above.join(tree.rungs[0].select("panel", "node", "up"), ["panel", "node"], "left")
        next_up = near.select("panel", F.col("node").alias("up"), F.col("target").alias("parent"))
        above = above.join(next_up, ["panel", "up"], "left")
    else:
        above = above.withColumn("parent", F.lit(None).cast("string"))
    chosen = ladder(above.select("panel", "node", "parent", F.lit(0.0).alias("branch_length")))
    summed = over_descendants(chosen.rungs, counted, "n", F.col("n"), F.sum, ("reference_label",))
    return ancestors.select("panel", "label", "ancestor").join(summed.withColumnRenamed("node", "ancestor"), ["panel", "ancestor"])


def alignment_shape(sequences: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Per key: records, width, whether all records share it, and missing or gap cells."""
    missing = count_of(F.upper(sequence), "N-")
    width = F.length(sequence).cast("bigint")
    return sequences.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        F.min(width).alias("width"),
        (F.min(width) == F.max(width)).alias("rectangular"),
        F.sum(missing).alias("missing_cells"),
    )


def panel_composition(records: DataFrame, panel: str, group: str, groups: list[str], width: str) -> DataFrame:
    """Records per panel, in all and per known group (``n_<group>``), and whether their widths agree."""
    return records.groupBy(panel).agg(
        F.count(F.lit(1)).alias("records"), *[F.count_if(F.col(group) == g).alias(f"n_{g}") for g in groups],
        (F.min(width) == F.max(width)).alias("rectangular"),
    )
