"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from cohortloom.session import ensure_checkpoint_dir


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder: cuts lineage and survives lost executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
