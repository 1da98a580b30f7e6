import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def docs(spark):
    """The fixture corpus over several partitions, with extra columns whose names operators use inside."""
    from fixtures import SCHEMA, corpus
    from pyspark.sql import functions as F

    plain = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    return plain.withColumns({c: F.lit("x") for c in ("doc", "bytes", "_text", "b", "score", "item", "set_id", "lang", "source")})


@pytest.fixture(scope="session")
def empty(spark):
    from fixtures import SCHEMA

    return spark.createDataFrame([], SCHEMA)
