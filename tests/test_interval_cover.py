"""interval_cover on repeated rows, and on fractions that lie half-way between two roundings."""

from __future__ import annotations

from datetime import datetime, timedelta

from compare import rows_of
from pyspark.sql import functions as F

from cohortloom.functions.numeric import rounded
from cohortloom.plans import ORACLES, QUERIES

DAY = datetime(1995, 1, 2)


def lineitem(spark, folder, rows):
    """(supplier, first day, days) as shipments; the folder of the table."""
    shipped = [(k, DAY + timedelta(days=s), float(n)) for k, s, n in rows]
    spark.createDataFrame(shipped, "l_suppkey bigint, l_shipdate timestamp_ntz, l_quantity double").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_half_way_fractions_as_in_sql(spark, tmp_path):
    import duckdb

    halves = [(41, 640), (323, 640), (333, 640), (201, 3200), (41, 320), (3, 640)]
    rows = []
    for key, (union, nominal) in enumerate(halves):
        whole, rest = divmod(nominal, union)
        rows += [(key, 0, union)] * whole + [(key, 0, rest)] * (rest > 0)
    folder = lineitem(spark, tmp_path, rows)
    df = QUERIES["interval_cover"](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
    cursor = con.execute(ORACLES["interval_cover"])
    got, want = rows_of(df.columns, df.collect()), rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert len(got) == len(halves) and got == want


def test_rounded_as_in_sql(spark):
    """Every odd multiple of 1 / 2,000,000 is half-way at six digits."""
    import duckdb

    odd = spark.range(1, 2_000_000, 2).select("id", rounded(F.col("id") / 2_000_000.0, 6).alias("r"))
    mine = odd.agg(F.sum(F.round(F.col("r") * 1_000_000).cast("bigint") * (F.col("id") % 1009))).first()[0]
    sql = "select sum(round(round(k::bigint / 2000000::bigint, 6) * 1000000)::bigint * (k % 1009))::bigint from range(1, 2000000, 2) t(k)"
    assert mine == duckdb.connect().execute(sql).fetchall()[0][0]
    signed = spark.sql("select stack(4, -0.0640625d, 0.5d, null, double('inf')) as x").select(rounded("x", 6)).collect()
    assert [r[0] for r in signed] == [-0.064062, 0.5, None, float("inf")]


def test_repeated_rows_add_nothing(spark, tmp_path):
    """Sixty copies of each row: the days of a supplier are those of one copy, counted one by one."""
    once = [(k, (k * 37 + i * 29) % 400, 1 + (i * i + k) % 25) for k in range(20) for i in range(12)]
    df = QUERIES["interval_cover"](spark, lineitem(spark, tmp_path, once * 60))
    for r in df.collect():
        mine = [(s, n) for k, s, n in once if k == r.l_suppkey]
        assert r.intervals == 60 * len(mine) and r.nominal_length == 60 * sum(n for _, n in mine)
        assert r.union_length == len({d for s, n in mine for d in range(s, s + n)})
