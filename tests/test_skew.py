"""Results stay whole and exact when one key holds most rows; plans hold no cross join."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import association, graph, intervals, joins, quantiles, sampling, selection, skew
from cohortloom.operators import modules as mod
from cohortloom.functions.hashing import label_of


def hot_rows(n=3000, seed=5):
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}", rng.randrange(1000)) for i in range(n)]


def frame(spark, data=None):
    return spark.createDataFrame(data or hot_rows(), "id bigint, k string, v bigint")


def test_join_unique_equals_plain_join(spark):
    df = frame(spark)
    right = df.filter("k <> 'k7'").groupBy("k").agg(F.max("v").alias("top"))
    for how in ("left", "inner"):
        got = skew.join_unique(df, right, ["k"], how=how)
        want = df.join(right, "k", how).select("id", "k", "v", "top")
        assert got.columns == ["id", "k", "v", "top"]
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_join_unique_is_split_for_hot_keys(spark):
    """One key with a third of the rows and one a little under: adaptive execution deals both over several tasks."""
    names = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(90_000).repartition(8).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 4 == 1, "b").otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("k"))
        right = df.groupBy("k").agg(F.max("id").alias("top"))
        got = skew.join_unique(df, right, ["k"], how="inner").withColumn("task", F.spark_partition_id())
        sizes = [r["count"] for r in got.groupBy("task").count().collect()]
        assert sum(sizes) == 90_000 and max(sizes) < 90_000 / 4
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_dense_position(spark):
    df = frame(spark).withColumn("o", F.col("id") * 37 - 40000)
    got = skew.dense_position(df, ["k"], "o", width=64).collect()
    want = {}
    for r in sorted(got, key=lambda r: r.o):
        want.setdefault(r.k, []).append(r.position)
    assert all(v == list(range(len(v))) for v in want.values()) and len(got) == 3000


def test_range_rank(spark):
    df = frame(spark)
    got = skew.range_rank(df, ["k"], [F.desc("v"), F.asc("id")], "r").collect()
    want = {}
    for i, k, v in sorted(hot_rows(), key=lambda r: (r[1], -r[2], r[0])):
        want[i] = want.get(k, 0) + 1
        want[k] = want[i]
    assert len(got) == 3000 and all(want[r.id] == r.r for r in got)


@pytest.mark.parametrize("width", [7, 64, 4096])
def test_intervals_brute_force(spark, width):
    rng = random.Random(width)
    data = [("hot" if rng.random() < 0.5 else "b", rng.choice("xyz"), s, s + rng.randrange(1, 30)) for s in (rng.randrange(-200, 900) for _ in range(250))]
    df = spark.createDataFrame(data, "k string, p string, start bigint, end bigint")
    covered, owner = {}, {}
    for k, p, s, e in data:
        for x in range(s, e):
            covered.setdefault(k, set()).add(x)
            owner[(k, x)] = min(p, owner.get((k, x), "~"))
    got = {}
    for r in intervals.merge_intervals(df, ["k"], width=width).collect():
        points = set(range(r.start, r.end))
        assert not (points & got.setdefault(r.k, set())) and (r.start - 1) not in covered[r.k] and r.end not in covered[r.k]
        got[r.k] |= points
    assert got == covered
    assert {r.k: r.union_length for r in intervals.union_length(df, ["k"], width=width).collect()} == {k: len(v) for k, v in covered.items()}
    owned = {(r.k, x): r.p for r in intervals.own_by_precedence(df, ["k"], "p", width=width).collect() for x in range(r.start, r.end)}
    assert owned == owner


def test_overlap_pairs_brute_force(spark):
    rng = random.Random(11)
    data = [(i, "hot" if i % 3 else "b", s, s + rng.randrange(0, 25)) for i, s in ((i, rng.randrange(400)) for i in range(150))]
    df = spark.createDataFrame(data, "id bigint, k string, start bigint, end bigint")
    df = df.unionByName(spark.createDataFrame([(200 + i, "hot", 3, 9) for i in range(5)], df.schema))
    data += [(200 + i, "hot", 3, 9) for i in range(5)]
    want = {}
    for a in data:
        for b in data:
            if a[0] < b[0] and a[1] == b[1] and max(a[2], b[2]) < min(a[3], b[3]):
                key = (a[1], *sorted([a[2:], b[2:]]))
                want[key] = want.get(key, 0) + 1
    got = intervals.overlapping_pairs(df, ["k"], "id", width=16).collect()
    found = {(r.k, *sorted([(r.start_a, r.end_a), (r.start_b, r.end_b)])): r.pairs for r in got}
    assert found == want and len(got) == len(want)


def test_quantiles_brute_force(spark):
    df = frame(spark)
    data = {}
    for _, k, v in hot_rows():
        data.setdefault(k, []).append(v)
    for r in quantiles.lower_median(df, ["k"], "v").collect():
        assert r.median == sorted(data[r.k])[(len(data[r.k]) + 1) // 2 - 1]
    for r in quantiles.half_mass_length(df.withColumn("v", F.col("v") + 1), ["k"], "v").collect():
        ordered, run, half = sorted((v + 1 for v in data[r.k]), reverse=True), 0, (sum(data[r.k]) + len(data[r.k])) / 2
        for v in ordered:
            run += v
            if run >= half:
                break
        assert r.n50 == v


def test_exact_sample_brute_force(spark):
    df = frame(spark)
    sizes = sampling.source_totals(df, "k").select("k", F.floor(F.col("total_source_rows") / 3).alias("sample_rows"))
    got = sampling.exact_sample(df, sizes, "k", "id", label_of("s", F.col("id"))).collect()
    import hashlib

    groups = {}
    for i, k, _ in hot_rows():
        groups.setdefault(k, []).append((int(hashlib.sha256(f"s:{i}".encode()).hexdigest()[:15], 16), i))
    want = {i for members in groups.values() for _, i in sorted(members)[: len(members) // 3]}
    assert {r.id for r in got} == want and len(got) == len(want)
    too_many = sizes.withColumn("sample_rows", F.col("sample_rows") + 5000)
    with pytest.raises(Exception, match="group smaller than sample"):
        sampling.exact_sample(df, too_many, "k", "id", label_of("s", F.col("id"))).count()


@pytest.mark.parametrize("jaccard,shared", [(0.3, 2), (0.6, 1), (0.8, 3)])
def test_similar_pairs_brute_force(spark, jaccard, shared):
    rng = random.Random(2)
    sets = {f"f{i:02d}": {e for e in range(20) if rng.random() < (0.95 if e < 3 else 0.25)} for i in range(40)}
    sets["f00"] = sets["f02"] = sets["f06"] = set(range(10))
    data = [("d" if int(f[1:]) % 2 else "e", f, e) for f, s in sets.items() for e in s]
    df = spark.createDataFrame(data, "d string, f string, e bigint")
    want = {
        (a, b) for a in sets for b in sets
        if a < b and int(a[1:]) % 2 == int(b[1:]) % 2 and len(sets[a] & sets[b]) >= shared and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= jaccard
    }
    leader = {f: min(g for g in sets if sets[g] == sets[f] and int(g[1:]) % 2 == int(f[1:]) % 2) for f in sets}
    want = {(a, b) for a, b in want if leader[a] == a and leader[b] in (a, b)}
    got = mod.similar_pairs(df, "f", "e", "d", shared, jaccard).collect()
    assert {(r.feature_a, r.feature_b) for r in got} == want and len(got) == len(want)
    assert {(r.feature_a, r.feature_b) for r in got if r.identical} == {(leader[f], f) for f in sets if leader[f] != f and len(sets[f]) >= shared}


def test_near_edges_brute_force(spark):
    rng = random.Random(4)
    placed = {}
    for f in range(14):
        for e in range(12):
            if rng.random() < 0.8:
                placed[(f, e)] = [rng.choice([-1, f * 2 + rng.randrange(6)]) for _ in range(rng.randrange(1, 3))]
    data = [("d", f"f{f:02d}", e, p) for (f, e), ps in placed.items() for p in ps]
    df = spark.createDataFrame(data, "d string, f string, e bigint, p bigint")
    want = set()
    for a in range(14):
        for b in range(a + 1, 14):
            ea, eb = ({e for (f, e) in placed if f == x} for x in (a, b))
            both = ea & eb
            if len(both) < 3 or len(both) / len(ea | eb) < 0.5:
                continue
            valid = near = 0
            for e in both:
                pa, pb = ([p for p in placed[(x, e)] if p >= 0] for x in (a, b))
                if pa and pb:
                    valid += 1
                    near += min(abs(x - y) for x in pa for y in pb) <= 3
            if valid and near / valid >= 0.5:
                want.add((f"f{a:02d}", f"f{b:02d}", valid, near))
    got = {(r.feature_a, r.feature_b, r.placed, r.adjacent) for r in mod.near_edges(df, "f", "e", "d", "p", 3, 3, 0.5, 0.5).collect()}
    assert got == want and want


def test_identical_sets(spark):
    sets = {"a": {1, 2}, "b": {1, 2}, "c": {1}, "d": {2}, "e": {1, 2, 3}, "g": {1}}
    df = spark.createDataFrame([("x", f, e) for f, s in sets.items() for e in s], "d string, f string, e bigint")
    got = {(r.leader, r.f) for r in mod.identical_set_groups(df, "f", "e", "d").collect()}
    assert got == {("a", "a"), ("a", "b"), ("c", "c"), ("c", "g")}


def test_components_of_hub_and_chain(spark):
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1060)]
    got = graph.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").groupBy("component").count()
    assert sorted(tuple(r) for r in got.collect()) == [(0, 200), (1000, 61)]


def test_leave_one_out_equals_recount(spark):
    rng = random.Random(9)
    data = [("blk", "hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}", rng.random() < 0.5, rng.random() < 0.6) for _ in range(400)]
    data += [("blk", "", True, True)] * 5
    df = spark.createDataFrame(data, "b string, s string, first boolean, present boolean")
    counts = association.stratum_counts(df, ["b"], "s", F.col("first"), ~F.col("first"), F.col("present"))
    for r in association.leave_one_out(counts, ["b"], "s", F.lit(True)).collect():
        kept = [d for d in data if d[1] != r.omitted_stratum]
        one = [d[3] for d in kept if d[2]]
        two = [d[3] for d in kept if not d[2]]
        assert r.omitted_stratum != "" and (r.remaining_first, r.remaining_second) == (len(one), len(two))
        assert r.expected_gap == pytest.approx(sum(two) / len(two) - sum(one) / len(one))


def test_shuffled_input_gives_the_same_ledger(spark):
    rng = random.Random(1)
    data = [(i, f"p{rng.randrange(120)}", "hot" if rng.random() < 0.4 else f"e{rng.randrange(30)}", float(rng.randrange(5)), rng.choice(["", "", "bad"])) for i in range(600)]
    schema = "id bigint, pair string, entity string, score double, reasons string"

    def ledger(rows):
        df = spark.createDataFrame(rows, schema)
        return sorted(map(str, selection.selection_ledger(df, "id", "pair", "entity", "score", "reasons", "id").collect()))

    first = ledger(data)
    assert first == ledger(rng.sample(data, len(data))) and len(first) == 600


def test_strict_lookup_rejects(spark):
    left = spark.createDataFrame([(1,), (2,)], "k bigint")
    with pytest.raises(ValueError, match="every row matched"):
        joins.strict_lookup(left, spark.createDataFrame([(1, "a")], "k bigint, v string"), ["k"], "x")
    with pytest.raises(ValueError, match="right key unique"):
        joins.strict_lookup(left, spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k bigint, v string"), ["k"], "x")
    with pytest.raises(ValueError, match="left key unique"):
        joins.one_to_one(left.union(left), spark.createDataFrame([(1, "a")], "k bigint, v string"), ["k"], "x")


def test_plans_hold_no_cross_join(spark, sf_dir):
    from cohortloom.plans import QUERIES

    for name, fn in QUERIES.items():
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_evidence_row_counts_all_rows_of_a_supplier(spark, tmp_path):
    """A supplier of 150 good rows is counted whole."""
    from cohortloom.plans import QUERIES

    lines = spark.range(150).select(
        F.col("id").alias("l_orderkey"), F.lit(2).alias("l_linenumber"), F.lit(1).cast("bigint").alias("l_suppkey"), F.lit(30.0).alias("l_quantity"),
        F.lit(0.05).alias("l_discount"), F.when(F.col("id") < 90, F.lit("A")).otherwise(F.lit("R")).alias("l_returnflag"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select 1L s_suppkey, 5.0D s_acctbal, 3 s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("select 3 n_nationkey, 'X' n_name").write.parquet(f"{tmp_path}/nation.parquet")
    got = QUERIES["evidence_row"](spark, str(tmp_path)).collect()
    assert [(r.A_rows, r.R_rows, r.a_leads) for r in got] == [(90, 60, True)]
