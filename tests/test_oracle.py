"""Every registered query against its SQL statement on whole tables."""

from __future__ import annotations

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from cohortloom.plans import ORACLES, QUERIES

NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, sf_dir, name):
    result = compare(spark, con, name, sf_dir, QUERIES, ORACLES)
    assert result["ok"], result["why"] or "no statement"


def test_entry(spark, sf_dir):
    if sf_dir.endswith("sf0.001"):
        assert entry.entry(spark).limit(1).count() == 1
