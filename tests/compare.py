"""Run a registered query and its SQL statement side by side and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"f{value + 0.0:.6f}" if math.isfinite(value) else f"f{value}"
    if isinstance(value, int):
        return f"i{value}"
    return f"s{value}"


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str, queries, oracles) -> dict:
    started = time.time()
    df = queries[name](spark, sf_dir)
    got = df.collect()
    seconds = time.time() - started
    out = {"name": name, "rows": len(got), "seconds": round(seconds, 2), "ok": None, "why": ""}
    if name not in oracles:
        return out
    cursor = con.execute(oracles[name])
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    out["sql_seconds"] = round(time.time() - started - seconds, 2)
    if sorted(columns) != sorted(df.columns):
        return {**out, "ok": False, "why": f"columns {sorted(df.columns)} vs {sorted(columns)}"}
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    out["ok"] = a == b
    if not out["ok"]:
        sa, sb = set(a), set(b)
        out["why"] = (
            f"{sorted(columns)} rows {len(a)} vs {len(b)}; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}"
        )
    return out


def session():
    from cohortloom.session import build_session

    return build_session(
        "compare", spark__master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="12g", spark__log__level="ERROR",
    )


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = []
    for name in names:
        try:
            r = compare(spark, con, name, sf_dir, entry.queries(), entry.oracle_sql())
        except Exception as exc:  # noqa: BLE001
            r = {"name": name, "ok": False, "why": str(exc)[:1500], "rows": -1, "seconds": 0}
        print(r["name"], "ok" if r["ok"] else ("rows-only" if r["ok"] is None else "BAD"), r["rows"], r["seconds"], r.get("sql_seconds"), r["why"], flush=True)
        if r["ok"] is False:
            bad.append(name)
    print("BAD:", bad)
