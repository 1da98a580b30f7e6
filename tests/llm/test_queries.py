"""Registered queries against their SQL, and the pipeline stage by stage, on the driver's smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, duck

from cohortloom.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    result = compare(spark, con, name, sf_dir, QUERIES, ORACLES)
    assert result["ok"], result["why"]


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLES) if n != "pipeline"))
def test_rows_without_sql(spark, sf_dir, name):
    table = "pages" if name.startswith("op6") else "documents"
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_held_out_accuracy(spark, sf_dir):
    rows = QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01").filter("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = rows.join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.93


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, ids = documents, {r.doc_id for r in documents.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == documents.columns and docs.dtypes == documents.dtypes
        from cohortloom.llm.stored import written

        docs = written(docs)
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) == docs.count(), name
        ids = left
    rates = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in rates.collect()} == ids
    assert 0.5 * documents.count() < len(ids) < documents.count()
