"""Stable hashes: the same text gives the same number in every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.functions.text import col


def stable_number(label: Column | str) -> Column:
    """First 60 bits of SHA-256 as a non-negative BIGINT."""
    digest = F.sha2(col(label).cast("string"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def label_of(*parts: Column | str | int) -> Column:
    """Parts joined with ':'; plain strings and numbers are taken as written."""
    return F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def spread(columns: list[str], buckets: int) -> Column:
    """A repeatable salt in [0, buckets) from row values."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(buckets)).cast("int")
