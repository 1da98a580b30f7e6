"""Features that occur together and lie close together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.fixed_values import MAX_INTERVENING, MIN_ADJACENCY, MIN_JACCARD, MIN_PAIR_ENTITIES, SYNTENIC_MIN_FEATURES
from cohortloom.functions.numeric import ratio_or_zero
from cohortloom.operators.skew import bucket_of, carry_before, key_weights, range_rank, join_unique
from cohortloom.session import cut_lineage

SPAN_WIDTH = 1 << 12
PREFIX_PARTS = 4096
SPAN_WORDS = 8  # words of 64 entities in one row of a packed set


def set_signatures(presence: DataFrame, feature: str, entity: str, direction: str) -> DataFrame:
    """Per (direction, feature): size and a 128-bit order-free digest of its entity set.

    The digest is an aggregate (two XORs of 64-bit hashes, merged map-side), so a feature found in
    every entity never has its entities collected. ``presence`` must be distinct.
    """
    first, second = F.xxhash64(F.col(entity)), F.xxhash64(F.lit("second"), F.col(entity), F.lit("half"))
    return presence.groupBy(direction, feature).agg(
        F.count(F.lit(1)).alias("set_size"), F.bit_xor(first).alias("sig_a"), F.bit_xor(second).alias("sig_b")
    )


def identical_set_groups(
    presence: DataFrame, feature: str, entity: str, direction: str, min_features: int = 2
) -> DataFrame:
    """Features sharing one entity set inside a direction, as (direction, leader, feature, set_size).

    The leader is the group's first feature. Membership is confirmed exactly: a feature stays only if
    every one of its entities is an entity of the leader (sizes being equal), which is one comparison
    per member, not one per pair.
    """
    keys = [direction, "set_size", "sig_a", "sig_b"]
    signatures = set_signatures(presence, feature, entity, direction)
    groups = (
        signatures.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_weight"), F.min(feature).alias("leader"))
        .filter(F.col("_weight") >= min_features)
    )
    members = cut_lineage(
        join_unique(signatures, groups.drop("_weight"), keys, how="inner").select(
            direction, "leader", feature, "set_size"
        )
    )
    rows = presence.select(direction, feature, entity)
    leader_rows = rows.join(
        members.select(direction, F.col("leader").alias(feature)).distinct(), [direction, feature], "left_semi"
    ).select(direction, F.col(feature).alias("leader"), entity, F.lit(True).alias("_same"))
    confirmed = cut_lineage(
        join_unique(rows, members, [direction, feature], how="inner")
        .join(leader_rows, [direction, "leader", entity], "left")
        .groupBy(direction, "leader", feature)
        .agg(F.max("set_size").alias("set_size"), F.count("_same").alias("_shared"))
        .filter(F.col("_shared") == F.col("set_size"))
        .drop("_shared")
    )
    sizes = confirmed.groupBy(direction, "leader").agg(F.count(F.lit(1)).alias("features"))
    return confirmed.join(sizes.filter(F.col("features") >= min_features), [direction, "leader"])


def numbered_names(groups: DataFrame, direction: str, size: str, first: str, name: str, pattern: str) -> DataFrame:
    """Name groups by their number inside a direction, in order of (size descending, first id)."""
    ranked = range_rank(groups, [direction], [F.desc(size), F.asc(first)], "_rank")
    return ranked.withColumn(name, F.format_string(pattern, F.col(direction), F.col("_rank"))).drop("_rank")


def module_compactness(
    members: DataFrame,
    positions: DataFrame,
    module: str,
    feature: str,
    entity: str,
    position: str,
    slack: int = MAX_INTERVENING,
) -> DataFrame:
    """Per module: entities with every feature placed, how many are compact, fraction and widest span.

    A feature counts once per entity, at its lowest position; negative positions are unknown.
    """
    lowest = (
        positions.filter(F.col(position) >= 0).groupBy(feature, entity).agg(F.min(position).alias("_pos"))
    )
    sizes = members.groupBy(module).agg(F.countDistinct(feature).alias("features"))
    per_entity = (
        lowest.join(members.select(module, feature), feature)
        .groupBy(module, entity)
        .agg(F.count(F.lit(1)).alias("_placed"), (F.max("_pos") - F.min("_pos") + 1).alias("_span"))
        .join(sizes, module)
        .filter(F.col("_placed") == F.col("features"))
    )
    folded = per_entity.groupBy(module).agg(
        F.count(F.lit(1)).alias("complete_entities"),
        F.count_if(F.col("_span") <= F.col("features") + slack).alias("compact_entities"),
        F.max("_span").alias("maximum_span"),
    )
    zero = F.lit(0).cast("bigint")
    return (
        sizes.join(folded, module, "left")
        .withColumn("complete_entities", F.coalesce("complete_entities", zero))
        .withColumn("compact_entities", F.coalesce("compact_entities", zero))
        .withColumn("maximum_span", F.coalesce("maximum_span", zero))
        .withColumn("compact_fraction", ratio_or_zero("compact_entities", "complete_entities"))
    )


def module_cohorts(held: DataFrame, compactness: DataFrame, module: str, cohorts: dict[str, Column]) -> DataFrame:
    """Module table: entities in all and per cohort, compactness, and whether the module is syntenic.

    ``held`` has one row per (module, entity). Syntenic modules have enough features and are mostly compact.
    """
    counts = held.groupBy(module).agg(F.count(F.lit(1)).alias("entities"), *[F.count_if(c).alias(n) for n, c in cohorts.items()])
    syntenic = (F.col("features") >= SYNTENIC_MIN_FEATURES) & (F.col("compact_fraction") >= MIN_ADJACENCY)
    return counts.join(compactness, module).withColumn("syntenic", syntenic)


def covering_spans(
    hits: DataFrame,
    members: DataFrame,
    block: str,
    feature: str,
    entity: str,
    container: str,
    position: str,
    width: int = SPAN_WIDTH,
) -> DataFrame:
    """Shortest same-container window holding every feature of a block: (block, entity, minimum_span).

    For each point the window ending there starts at the earliest of the last-seen positions of the
    required features. Points are folded inside position buckets (at most ``width`` positions times
    the block's features); last-seen positions enter a bucket from one row per (bucket, feature).
    Containers that lack a feature give no row. The block's own points are checkpointed: several
    passes read them, and they are a small part of all hits.
    """
    place = [block, entity, container]
    ranked = members.select(block, feature).distinct().withColumn(
        "_slot", F.row_number().over(Window.partitionBy(block).orderBy(feature)) - 1
    )
    slots = ranked.groupBy(block).agg(F.count(F.lit(1)).alias("_need"))
    points = cut_lineage(
        hits.select(feature, entity, container, F.col(position).cast("bigint").alias("_pos"))
        .join(ranked, feature)
        .select(*place, "_pos", "_slot")
        .distinct()
        .withColumn("_bucket", bucket_of(F.col("_pos"), width))
    )
    complete = (
        points.groupBy(*place)
        .agg(F.countDistinct("_slot").alias("_have"))
        .join(slots, block)
        .filter(F.col("_have") == F.col("_need"))
        .select(*place, "_need")
    )
    buckets = (
        points.groupBy(*place, "_bucket", "_slot")
        .agg(F.max("_pos").alias("_top"))
        .join(complete, place)
    )
    grid = (
        buckets.select(*place, "_bucket", "_need").distinct()
        .withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_need").cast("int") - 1)))
    )
    tops = grid.join(buckets.drop("_need"), [*place, "_bucket", "_slot"], "left")
    carried = (
        carry_before(tops, [*place, "_slot"], "_bucket", {"_seen": ("max", "_top")})
        .groupBy(*place, "_bucket")
        .agg(F.array_sort(F.collect_list(F.struct("_slot", "_seen"))).alias("_carry"))
    )
    folded = points.groupBy(*place, "_bucket").agg(
        F.array_sort(F.collect_list(F.struct("_pos", "_slot"))).alias("_points")
    )

    def step(acc: Column, point: Column) -> Column:
        seen = F.transform(acc["seen"], lambda s, i: F.when(i == point["_slot"], point["_pos"]).otherwise(s))
        span = F.when(F.forall(seen, lambda s: s.isNotNull()), point["_pos"] - F.array_min(seen) + 1)
        return F.struct(seen.alias("seen"), F.least(acc["best"], span).alias("best"))

    begin = F.struct(
        F.transform("_carry", lambda c: c["_seen"]).alias("seen"), F.lit(None).cast("bigint").alias("best")
    )
    best = F.aggregate("_points", begin, step, lambda acc: acc["best"])
    return (
        folded.join(carried, [*place, "_bucket"])
        .withColumn("_best", best)
        .groupBy(block, entity)
        .agg(F.min("_best").alias("minimum_span"))
        .filter(F.col("minimum_span").isNotNull())
    )


def block_calls(
    blocks: DataFrame,
    members: DataFrame,
    hits: DataFrame,
    block: str,
    feature: str,
    entity: str,
    container: str,
    position: str,
    allowed: str,
) -> DataFrame:
    """One row per observed (block, entity): features seen, completeness, span and the call.

    An entity without any feature of a block has no row; ``block_totals`` counts it as absent.
    """
    need = members.groupBy(block).agg(F.countDistinct(feature).alias("required_features"))
    plan = blocks.select(block, F.col(allowed).cast("bigint").alias("maximum_allowed_span")).join(need, block)
    seen = (
        hits.join(members.select(block, feature).distinct(), feature)
        .groupBy(block, entity)
        .agg(F.countDistinct(feature).alias("observed_features"))
    )
    spans = covering_spans(hits, members, block, feature, entity, container, position)
    return (
        join_unique(seen, plan, [block], how="inner")
        .join(spans, [block, entity], "left")
        .withColumn("all_features_present", F.col("observed_features") == F.col("required_features"))
        .withColumn("one_container", F.col("minimum_span").isNotNull())
        .withColumn(
            "block_present", F.coalesce(F.col("minimum_span") <= F.col("maximum_allowed_span"), F.lit(False))
        )
    )


def block_grid(calls: DataFrame, blocks: DataFrame, members: DataFrame, entities: DataFrame, block: str, feature: str, entity: str, allowed: str, most: int = 10_000) -> DataFrame:
    """``block_calls`` with a row for every block and every entity: what was not observed is absent.

    The rows are blocks x entities by definition. The block list (name, required features, allowed span) is a literal
    that every entity is exploded by, so neither side is shuffled for the grid; more than ``most`` blocks are an error.
    """
    need = members.groupBy(block).agg(F.countDistinct(feature).alias("required_features"))
    listed = blocks.select(block, F.col(allowed).cast("bigint").alias("maximum_allowed_span")).distinct().join(need, block).limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError(f"more than {most} blocks: give their absences as counts by block_totals")
    schema = calls.schema
    kind = "struct<b:{},required_features:bigint,maximum_allowed_span:bigint>".format(schema[block].dataType.simpleString())
    literal = F.array(*[F.struct(F.lit(r[0]), F.lit(r[2]), F.lit(r[1])).cast(kind) for r in listed]) if listed else F.array().cast(f"array<{kind}>")
    grid = entities.select(entity).distinct().select(entity, F.explode(literal).alias("_b")).select(
        F.col("_b.b").alias(block), entity, "_b.required_features", "_b.maximum_allowed_span"
    )
    seen = calls.select(block, entity, "observed_features", "minimum_span", "all_features_present", "one_container", "block_present")
    absent = F.lit(False)
    return grid.join(seen, [block, entity], "left").withColumns(
        {"observed_features": F.coalesce("observed_features", F.lit(0).cast("bigint")), **{c: F.coalesce(c, absent) for c in ("all_features_present", "one_container", "block_present")}}
    )


def block_totals(blocks: DataFrame, calls: DataFrame, entities: DataFrame, block: str) -> DataFrame:
    """Per block: entities that hold it, that do not, and all; unobserved entities are absent."""
    counts = calls.groupBy(block).agg(F.count_if("block_present").alias("present"))
    total = entities.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    present = F.coalesce("present", F.lit(0).cast("bigint"))
    return blocks.select(block).distinct().join(counts, block, "left").select(
        block, present.alias("present"), (total - present).alias("absent"), total.alias("entities")
    )


def similar_pairs(
    presence: DataFrame,
    feature: str,
    entity: str,
    direction: str,
    min_shared: int = MIN_PAIR_ENTITIES,
    min_jaccard: float = MIN_JACCARD,
) -> DataFrame:
    """Feature pairs of one direction with enough shared entities and a high enough Jaccard index.

    Exact, by prefix filtering: with entities ordered from rare to common, two sets of sufficient
    overlap must share an entity among the first ``size - needed + 1`` of each, so only those few rare
    entities propose pairs; a size test drops pairs that cannot qualify; proposals are then counted
    exactly. Common entities, which would propose most pairs, lie outside the prefixes. The order is
    kept in steps and a prefix ends with a whole step, which only adds proposals, so no feature's
    entities are ever sorted in one task.

    Features with one and the same entity set are represented by their leader: the result holds the
    pairs between distinct sets, and one row (leader, copy) with ``identical`` true per further copy,
    never all pairs of copies. A copy's other pairs are those of its leader.
    """
    everything = presence.select(direction, feature, entity)
    copies = identical_set_groups(everything, feature, entity, direction).filter(F.col(feature) != F.col("leader"))
    rows = everything.join(copies.select(direction, feature), [direction, feature], "left_anti")
    common = key_weights(rows, [direction, entity]).withColumn(
        "_order",
        F.floor(F.log2(F.col("_weight").cast("double")) * 8).cast("bigint") * PREFIX_PARTS
        + F.pmod(F.xxhash64(entity), F.lit(PREFIX_PARTS)),
    )
    tagged = cut_lineage(join_unique(rows, common.drop("_weight"), [direction, entity], how="inner"))
    steps = tagged.groupBy(direction, feature, "_order").agg(F.count(F.lit(1)).alias("_n"))
    rare_first = Window.partitionBy(direction, feature).orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = F.greatest(F.lit(min_shared).cast("bigint"), F.ceil(F.col("_size") * F.lit(min_jaccard) - F.lit(1e-9)))
    leading = (
        steps.withColumn("_size", F.sum("_n").over(Window.partitionBy(direction, feature)))
        .withColumn("_before", F.sum("_n").over(rare_first) - F.col("_n"))
        .filter((F.col("_size") >= needed) & (F.col("_before") <= F.col("_size") - needed))
        .select(direction, feature, "_order", "_size")
    )
    prefix = tagged.join(leading, [direction, feature, "_order"])
    a = prefix.select(direction, entity, F.col(feature).alias("feature_a"), F.col("_size").alias("size_a"))
    b = prefix.select(direction, entity, F.col(feature).alias("feature_b"), F.col("_size").alias("size_b"))
    proposed = (
        a.join(b, [direction, entity])
        .filter(
            (F.col("feature_a") < F.col("feature_b"))
            & (F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(min_jaccard - 1e-9))
        )
        .select(direction, "feature_a", "feature_b", "size_a", "size_b")
        .distinct()
    )
    distinct_sets = (
        shared_counts(proposed, packed_sets(rows, entity_numbers(rows, entity), feature, entity, direction), feature, direction)
        .filter((F.col("shared") >= min_shared) & (F.col("jaccard") >= min_jaccard))
        .withColumn("identical", F.lit(False))
    )
    same = copies.filter(F.col("set_size") >= min_shared).select(
        direction, F.col("leader").alias("feature_a"), F.col(feature).alias("feature_b"), F.col("set_size").alias("size_a"),
        F.col("set_size").alias("size_b"), F.col("set_size").alias("shared"), F.lit(1.0).alias("jaccard"), F.lit(True).alias("identical"),
    )
    return distinct_sets.unionByName(same)


def packed_sets(rows: DataFrame, numbers: DataFrame, feature: str, entity: str, direction: str) -> DataFrame:
    """Every feature's entity set as bits: one row (direction, feature, _span, _w0 ..) per ``SPAN_WORDS`` words of 64 numbers.

    Bits are set by a map-side ``bit_or``, so a feature with most rows is packed before it is shuffled.
    """
    number = F.col("_number")
    word, bit = F.shiftright(number, 6).bitwiseAND(SPAN_WORDS - 1), number.bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    words = [F.coalesce(F.bit_or(F.when(word == k, one)), F.lit(0).cast("bigint")).alias(f"_w{k}") for k in range(SPAN_WORDS)]
    return (
        join_unique(rows.select(direction, feature, entity), numbers, [entity], how="inner")
        .groupBy(direction, feature, F.floor(number / (64 * SPAN_WORDS)).alias("_span"))
        .agg(*words)
    )


def entity_numbers(rows: DataFrame, entity: str) -> DataFrame:
    """(entity, _number): dense numbers from 0, common entities first, so that what most sets hold shares few words."""
    ranked = range_rank(key_weights(rows, [entity]), [], [F.desc("_weight"), F.asc(entity)], "_number")
    return cut_lineage(ranked.select(entity, (F.col("_number") - 1).cast("bigint").alias("_number")))


def common_members(pairs: DataFrame, packed: DataFrame, feature: str, direction: str, name: str) -> DataFrame:
    """Given pairs with the exact number of entities that both hold; pairs without any may be missing.

    The join has a row per pair and span of words that both sides use, not per entity.
    """
    words = [f"_w{k}" for k in range(SPAN_WORDS)]
    left = packed.select(direction, F.col(feature).alias("feature_a"), "_span", *words)
    right = packed.select(direction, F.col(feature).alias("feature_b"), "_span", *[F.col(w).alias(f"{w}b") for w in words])
    both = sum((F.bit_count(F.col(w).bitwiseAND(F.col(f"{w}b"))) for w in words), F.lit(0)).cast("bigint")
    return (
        pairs.join(left, [direction, "feature_a"])
        .join(right, [direction, "feature_b", "_span"])
        .groupBy(*pairs.columns)
        .agg(F.sum(both).alias(name))
    )


def shared_counts(pairs: DataFrame, packed: DataFrame, feature: str, direction: str) -> DataFrame:
    """Exact shared-entity count and Jaccard index of given pairs (with size_a, size_b)."""
    return common_members(pairs, packed, feature, direction, "shared").withColumn(
        "jaccard",
        F.col("shared").cast("double") / (F.col("size_a") + F.col("size_b") - F.col("shared")).cast("double"),
    )


def near_edges(
    placed: DataFrame,
    feature: str,
    entity: str,
    direction: str,
    position: str,
    max_distance: int = MAX_INTERVENING + 1,
    min_shared: int = MIN_PAIR_ENTITIES,
    min_jaccard: float = MIN_JACCARD,
    min_adjacency: float = MIN_ADJACENCY,
) -> DataFrame:
    """Edges between features that share entities and lie within ``max_distance`` in most of them.

    Works from proximity: an edge needs at least one entity in which the two features are close, so
    pairs are proposed by position buckets inside an entity, never by all features of an entity.
    Proposals are then held to the similarity and adjacency limits with exact counts. Negative
    positions are unknown: they count for presence, not for placement.
    """
    if min_adjacency <= 0:
        raise ValueError("the adjacency limit must be positive")
    rows = placed.select(direction, feature, entity).distinct()
    sizes = rows.groupBy(direction, feature).agg(F.count(F.lit(1)).alias("_size"))
    spots = (
        placed.filter(F.col(position) >= 0)
        .select(direction, feature, entity, F.col(position).cast("bigint").alias("_pos"))
        .distinct()
    )
    width = max_distance + 1
    a = spots.select(
        direction, entity, F.col(feature).alias("feature_a"), F.col("_pos").alias("_pa"),
        F.explode(F.array(*[bucket_of(F.col("_pos"), width) + k for k in (-1, 0, 1)])).alias("_bucket"),
    )
    b = spots.select(
        direction, entity, F.col(feature).alias("feature_b"), F.col("_pos").alias("_pb"),
        bucket_of(F.col("_pos"), width).alias("_bucket"),
    )
    close = (
        a.join(b, [direction, entity, "_bucket"])
        .filter((F.col("feature_a") < F.col("feature_b")) & (F.abs(F.col("_pa") - F.col("_pb")) <= max_distance))
        .select(direction, "feature_a", "feature_b", entity)
        .distinct()
        .groupBy(direction, "feature_a", "feature_b")
        .agg(F.count(F.lit(1)).alias("adjacent"))
    )
    size_a = sizes.select(direction, F.col(feature).alias("feature_a"), F.col("_size").alias("size_a"))
    size_b = sizes.select(direction, F.col(feature).alias("feature_b"), F.col("_size").alias("size_b"))
    proposed = (
        close.join(size_a, [direction, "feature_a"])
        .join(size_b, [direction, "feature_b"])
        .filter(F.least("size_a", "size_b") >= min_shared)
        .filter(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * F.lit(min_jaccard - 1e-9))
    )
    numbers = entity_numbers(rows, entity)
    packed = packed_sets(rows, numbers, feature, entity, direction)
    similar = shared_counts(proposed.drop("adjacent"), packed, feature, direction).filter(
        (F.col("shared") >= min_shared) & (F.col("jaccard") >= min_jaccard)
    )
    known = spots.select(direction, feature, entity).distinct()
    placed_both = common_members(
        similar.select(direction, "feature_a", "feature_b"), packed_sets(known, numbers, feature, entity, direction), feature, direction, "placed"
    )
    pair = [direction, "feature_a", "feature_b"]
    return (
        similar.join(close, pair)
        .join(placed_both, pair)
        .withColumn("adjacency_fraction", ratio_or_zero("adjacent", "placed"))
        .filter(F.col("adjacency_fraction") >= min_adjacency)
        .select(*pair, "shared", "jaccard", "placed", "adjacent", "adjacency_fraction")
    )
