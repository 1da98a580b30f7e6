"""Long and wide forms, metric summaries and column order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.quantiles import middle_median


def presence_matrix(
    entities: DataFrame, observed: DataFrame, entity: str, block: str, value: str, blocks: list[str]
) -> DataFrame:
    """0/1 column per known block for every entity; entities without a row get zeros."""
    wide = observed.groupBy(entity).agg(
        *[F.max(F.when(F.col(block) == b, F.col(value).cast("bigint"))).alias(b) for b in blocks]
    )
    joined = entities.join(wide, entity, "left")
    return joined.withColumns({b: F.coalesce(F.col(b), F.lit(0).cast("bigint")) for b in blocks})


def preferred_first(df: DataFrame, preferred: list[str]) -> DataFrame:
    return df.select(*preferred, *[c for c in df.columns if c not in preferred])


def long_metrics(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """One row per (ids, metric) with a value; blanks are left out."""
    return (
        df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
        .unpivot(ids, metrics, "metric", "value")
        .filter(F.col("value").isNotNull())
    )


def metric_summary(long: DataFrame, scope: str, group: str, groups: list[str]) -> DataFrame:
    """Per (scope, metric): n, median, minimum and maximum of each group, side by side."""
    keys = [scope, "metric", group]
    stats = (
        long.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))
        .join(middle_median(long, keys, "value"), keys)
    )
    names = ["n", "median", "minimum", "maximum"]
    wide = stats.groupBy(scope, "metric").agg(
        *[F.max(F.when(F.col(group) == g, F.col(s))).alias(f"{g}_{s}") for g in groups for s in names]
    )
    return wide.withColumns({f"{g}_n": F.coalesce(F.col(f"{g}_n"), F.lit(0).cast("bigint")) for g in groups})


def stack_sources(sources: dict[str, DataFrame], tag: str) -> DataFrame:
    """Append sources under one schema with a tag column."""
    frames = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def coordinate_order(df: DataFrame, container: str, position: str) -> DataFrame:
    """Rows range-partitioned by (container, position) and sorted inside partitions.

    Range bounds are sampled on both columns, so a container that holds most rows spans partitions.
    """
    return df.repartitionByRange(container, position).sortWithinPartitions(container, position)


def name_order(df: DataFrame, name: str) -> DataFrame:
    """Rows of one name together; names are record names, each held by a handful of rows."""
    return df.repartition(name).sortWithinPartitions(name)
