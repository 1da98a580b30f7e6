"""Mixture burden on a stream of evidence rows.

The only state is the depth profile: one row per (sample, route, depth), so state does not grow with
the number of positions. The lower median and the rates are taken from the stored profile by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cohortloom.operators.evidence import burden_from_profile, decode_rows, depth_profile
from cohortloom.sources.records import evidence_fields


def stream_profile(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Depth profile of evidence text lines (``value`` plus key columns) as a streaming aggregate."""
    return depth_profile(decode_rows(evidence_fields(lines)), keys)


def run_profile(profile: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Run over all available input; every batch replaces the stored profile.

    The profile is complete after each batch and replacing it is repeatable, so a batch that runs
    again after a failure leaves the same table.
    """

    def store(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(table_path)

    return (
        profile.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )


def burden_of_stored_profile(stored: DataFrame, keys: list[str]) -> DataFrame:
    return burden_from_profile(stored, keys)
