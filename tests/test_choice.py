"""First n rows of a key and of a table: hot keys, ties, sparse positions, and plans without a sort of the whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import choice, evidence, joins


def test_cap_of_a_hot_position(spark):
    """One position holds two thirds of the rows; qualities tie; the rest stays under the cap."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id") % 997).alias("pos"), (F.col("id") % 5).alias("q"), F.col("id").cast("string").alias("read")
    )
    got = evidence.capped_rows(rows, ["pos"], "q", F.col("read"), 4_500)
    import hashlib

    hot = [r for r in rows.collect() if r.pos == 7]
    want = sorted(hot, key=lambda r: (-r.q, hashlib.md5(r.read.encode()).hexdigest()))[:4_500]
    assert sorted(got.filter("pos = 7").collect()) == sorted(want)
    assert got.filter("pos <> 7").count() == rows.filter("pos <> 7").count()
    assert got.columns == rows.columns


@pytest.mark.parametrize("n", [0, 1, 3, 5, 100])
def test_first_n_with_ties_nulls_and_copies(spark, n):
    rows = [("a", 1, "x"), ("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z"), ("a", None, "w"), ("b", 5, "v"), (None, 1, "u"), (None, 2, "t")]
    df = spark.createDataFrame(rows, "k string, d bigint, t string").repartition(3)
    got = choice.first_n_per_key(df, ["k"], n, [F.col("d"), *choice.row_digits(F.col("t"))], [F.col("t")])
    per_key = {k: sum(r.k == k for r in got.collect()) for k in ("a", "b", None)}
    assert per_key == ({"a": 0, "b": 0, None: 0} if n == 0 else {"a": min(n, 5), "b": 1, None: 2})
    if n == 3:
        assert sorted(r.t for r in got.filter("k = 'a'").collect()) == ["x", "x", "y"]


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
@pytest.mark.parametrize("n", [0, 1, 50, 199, 1000])
def test_first_records(spark, n, width):
    rows = [(i * i * 31 - 500, str(i)) for i in range(200)] + [(None, "none")]
    df = spark.createDataFrame(rows, "p bigint, v string").repartition(5)
    got = choice.first_records(df, "p", n, width)
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] is not None)[:n]
    assert choice.first_records(df.filter("false"), "p", 5, width).count() == 0


def test_first_records_has_no_global_sort(spark, tmp_path):
    spark.range(100_000).select(F.col("id").alias("p"), (F.col("id") % 7).alias("v")).repartitionByRange(8, "p").sortWithinPartitions("p").write.parquet(f"{tmp_path}/t")
    plan = choice.first_records(spark.read.parquet(f"{tmp_path}/t"), "p", 10, 100)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "TakeOrdered" not in plan
    assert "LessThan(p" in plan or "(p#" in plan.split("DataFilters")[1]


def test_first_pairs_need_equal_lists(spark):
    first = spark.createDataFrame([(i, f"k{i}") for i in range(5)], "position bigint, key string")
    assert joins.first_pairs(first, first, "position", "key", 3).count() == 3
    assert joins.first_pairs(first, first, "position", "key", 30).count() == 5
    assert joins.first_pairs(first, first.filter("position < 4"), "position", "key", 4).count() == 4
    with pytest.raises(Exception, match="missing_mate at record 4"):
        joins.first_pairs(first, first.filter("position < 4"), "position", "key", 5).collect()
    other = first.withColumn("key", F.when(F.col("position") == 2, "other").otherwise(F.col("key")))
    with pytest.raises(Exception, match="key_mismatch at record 2"):
        joins.first_pairs(first, other, "position", "key", 5).collect()
