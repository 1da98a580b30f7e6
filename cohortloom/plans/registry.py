"""Registry of runnable analyses on the driver tables, each with its SQL statement where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortloom.session import share_code

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.session, self.folder = spark, sf_dir
        share_code(spark)

    def __getattr__(self, name: str) -> DataFrame:
        return self.session.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Register a function of ``Tables`` under a key."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
