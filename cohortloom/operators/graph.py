"""Connected components of an edge table and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.modules import numbered_names
from cohortloom.operators.skew import join_unique
from cohortloom.session import cut_lineage


def _around(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.select("a", "b").unionByName(back)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round: neighbours of a node are re-hung on the smallest node in its reach.

    The large star moves greater neighbours, the small star moves the node and its smaller neighbours.
    The smallest neighbour is an aggregate and is joined back hot-key safe, so a hub is never gathered.
    """
    if large:
        rows = _around(edges)
    else:
        rows = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = rows.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("_m"))
    joined = join_unique(rows, lowest, ["a"], how="inner")
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(
            lowest.select("a", F.col("_m").alias("b"))
        )
    return moved.filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): the component is the smallest node id in it. Nodes without an edge are absent.

    Alternating large-star and small-star rounds (published; a logarithmic number of rounds). Each
    round is checkpointed to the shared folder, so lineage stays short and survives lost executors.
    """
    nodes = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    current = cut_lineage(
        nodes.filter(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
        .select("a", "b")
        .distinct()
    )
    mark = None
    for _ in range(max_rounds):
        current = cut_lineage(_star(_star(current, True), False))
        row = current.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
            F.bit_xor(F.xxhash64("b", F.lit(1), "a")).alias("y"),
        ).first()
        now = (row.n, row.x, row.y)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)


def component_summary(
    edges: DataFrame,
    labels: DataFrame,
    presence: DataFrame,
    feature: str,
    entity: str,
    direction: str,
    name_pattern: str = "%s_component_%02d",
) -> DataFrame:
    """Per component: name, features, complete entities, inner edges and the weakest edge values."""
    members = labels.select(F.col("node").alias(feature), "component")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("features"))
    inner = (
        edges.join(members.select(F.col(feature).alias("feature_a"), "component"), "feature_a")
        .groupBy("component")
        .agg(
            F.min(direction).alias(direction),
            F.count(F.lit(1)).alias("edges"),
            F.min("jaccard").alias("minimum_jaccard"),
            F.min("adjacency_fraction").alias("minimum_adjacency"),
        )
    )
    complete = (
        presence.select(feature, entity)
        .distinct()
        .join(members, feature)
        .groupBy("component", entity)
        .agg(F.count(F.lit(1)).alias("_have"))
        .join(sizes, "component")
        .groupBy("component")
        .agg(F.count_if(F.col("_have") == F.col("features")).alias("complete_entities"))
    )
    table = sizes.join(inner, "component").join(complete, "component", "left").withColumn(
        "complete_entities", F.coalesce("complete_entities", F.lit(0).cast("bigint"))
    )
    return numbered_names(table, direction, "features", "component", "component_name", name_pattern)


def component_members(labels: DataFrame, about: DataFrame, feature: str) -> DataFrame:
    """One row per member with what is known about it (one row of ``about`` per feature)."""
    return labels.select(F.col("node").alias(feature), "component").join(about, feature)
