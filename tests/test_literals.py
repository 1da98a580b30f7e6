"""Small hand-made cases whose results are known."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.functions import text as tx
from cohortloom.functions.numeric import log_factorial
from cohortloom.operators import association, checks, classify, evidence, graph, intervals, quantiles, sampling, selection, sweep
from cohortloom.operators import modules as mod


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


PILES = [
    ("G", "^].,$.,+2agA-1tT*<>", dict(G=4, A=1, T=1)),
    ("C", ".,+10acgtacgtacAAAAA", dict(C=2, A=5)),
    ("A", "+2^Ag", dict(G=1)),
    ("A", "^+A^^c+0G-tT", dict(A=1, C=1, G=1, T=2)),
    ("n", ".,a+5ac", dict(other=2, A=1)),
    ("A", "+60" + "c" * 60 + "gg", dict(G=2)),
    ("A", "-002ttT^", dict(T=1)),
    ("A", "+1+2acG", dict(A=1, C=1, G=1)),
    ("T", "", dict()),
]


def walk(ref, pile):
    """Independent character count used as brute force."""
    out, i = {}, 0
    while i < len(pile):
        ch = pile[i]
        if ch == "^":
            i += 2
        elif ch in "+-":
            j = i + 1
            while j < len(pile) and pile[j] in "0123456789":
                j += 1
            i = j + int(pile[i + 1 : j] or 0)
        else:
            base = ref.upper() if ch in ".," else ch.upper()
            if ch in ".," or base in "ACGT":
                key = base if base in "ACGT" else "other"
                out[key] = out.get(key, 0) + 1
            i += 1
    return out


def test_decode(spark):
    import random

    rng = random.Random(7)
    cases = [(r, p) for r, p, _ in PILES]
    cases += [(rng.choice("ACGTN"), "".join(rng.choice("ACGTacgtnN.,$^+-0123456789*<>") for _ in range(rng.randint(0, 60)))) for _ in range(400)]
    for ref, pile, want in PILES:
        assert walk(ref, pile) == want, pile
    df = spark.createDataFrame([(i, r, p) for i, (r, p) in enumerate(cases)], "i int, ref string, pile string")
    for r in evidence.decode_rows(df).collect():
        got = {b: r[f"n_{b}"] for b in fv.BASE_NAMES if r[f"n_{b}"]}
        assert got == walk(r.ref, r.pile), (r.ref, r.pile)


@pytest.mark.parametrize(
    "ref,counts,expected",
    [("G", [(15, 5), (14, 5), (45, 5), (20, 0)], (4, 3, 2, 1)), ("C", [(16, 4), (15, 5), (45, 5)], (3, 3, 2, 1))],
)
def test_burden(spark, ref, counts, expected):
    df = spark.createDataFrame([("s", "r", ref, "." * a + "A" * b) for a, b in counts], "sample string, route string, ref string, pile string")
    out = evidence.mixture_burden(evidence.decode_rows(df), ["sample", "route"]).first()
    assert (out.total_positions, out.callable_positions, out.mixed_wide, out.mixed_narrow) == expected
    assert out.narrow_per_million == pytest.approx(1e6 * expected[3] / expected[1])


def test_burden_without_callable_positions(spark):
    df = spark.createDataFrame([("s", "A", "..")], "sample string, ref string, pile string")
    out = evidence.mixture_burden(evidence.decode_rows(df), ["sample"]).first()
    assert (out.callable_positions, out.median_depth, out.narrow_per_million) == (0, 0, 0.0)


def test_intervals(spark):
    df = spark.createDataFrame([("k", 10, 20), ("k", 15, 30), ("k", 40, 50)], "k string, start bigint, end bigint")
    for width in (4, 16, 1 << 16):
        assert rows(intervals.merge_intervals(df, ["k"], width=width)) == [("k", 10, 30), ("k", 40, 50)]
        assert intervals.union_length(df, ["k"], width=width).first().union_length == 30
    whole = spark.createDataFrame([("k", 10, 30)], "k string, start bigint, end bigint")
    cover = spark.createDataFrame([("k", 0, 15), ("k", 20, 25)], "k string, start bigint, end bigint")
    for width in (4, 16, 1 << 16):
        assert rows(intervals.subtract_intervals(whole, cover, ["k"], width=width)) == [("k", 15, 20), ("k", 25, 30)]


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 5, 9), ("k", 10, 11)], "k string, start bigint, end bigint")
    assert rows(intervals.merge_intervals(df, ["k"], width=4)) == [("k", 0, 9), ("k", 10, 11)]


@pytest.mark.parametrize("lengths,expected", [([50, 30, 20], 50), ([40, 35, 25], 35), ([7], 7), ([5, 5, 5, 5], 5)])
def test_half_mass(spark, lengths, expected):
    df = spark.createDataFrame([("k", n) for n in lengths], "k string, n bigint")
    assert quantiles.half_mass_length(df, ["k"], "n").first().n50 == expected


def test_medians(spark):
    df = spark.createDataFrame([("k", v) for v in (1, 2, 3, 10)] + [("z", -4), ("z", 5), ("z", 0)], "k string, v bigint")
    assert rows(quantiles.lower_median(df, ["k"], "v")) == [("k", 2), ("z", 0)]
    assert rows(quantiles.middle_median(df, ["k"], "v")) == [("k", 2.5), ("z", 0.0)]


def test_value_buckets_are_monotone(spark):
    values = sorted([0.0, -1.5, 1.5, 1e-9, 2.0, 1.9999999, 4.0, 3.99999999999, 1e12, -1e12, 7.1, 7.2, -0.25, 0.25, 8.0, 7.999999999999999])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", quantiles.value_bucket(F.col("v")).alias("b"))
    buckets = [r.b for r in df.orderBy("v").collect()]
    assert buckets == sorted(buckets)


def test_log_factorial(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 5, 9, 10, 11, 50, 1000, 10**6)], "n bigint")
    for r in df.select("n", log_factorial(F.col("n")).alias("l")).collect():
        assert r.l == pytest.approx(math.lgamma(r.n + 1), abs=1e-9, rel=1e-12)


def test_fisher(spark):
    tables = [(3, 1, 1, 3), (5, 0, 0, 5), (0, 0, 3, 4), (10, 2, 3, 15), (1, 0, 7, 9), (60, 40, 30, 70)]
    df = spark.createDataFrame(tables, "a bigint, b bigint, c bigint, d bigint")

    def brute(a, b, c, d):
        r1, r2, c1 = a + b, c + d, a + c
        if 0 in (r1, r2, c1, b + d):
            return 1.0
        p = {k: math.comb(r1, k) * math.comb(r2, c1 - k) / math.comb(r1 + r2, c1) for k in range(max(0, c1 - r2), min(r1, c1) + 1)}
        return min(1.0, sum(v for v in p.values() if v <= p[a] * (1 + 1e-7)))

    for r in association.fisher_test(df, ("a", "b", "c", "d")).collect():
        assert r.fisher_p == pytest.approx(brute(r.a, r.b, r.c, r.d), abs=1e-10)
    first = {tuple(r)[:4]: r for r in association.fisher_test(df, ("a", "b", "c", "d")).collect()}
    assert first[(3, 1, 1, 3)].fisher_p == pytest.approx(0.4857142857)
    assert first[(3, 1, 1, 3)].odds_ratio == 9.0
    assert math.isinf(first[(5, 0, 0, 5)].odds_ratio)
    assert math.isnan(first[(0, 0, 3, 4)].odds_ratio)


def test_fisher_large_margins(spark):
    df = spark.createDataFrame([(500_300, 499_700, 499_500, 500_500), (900_000, 100_000, 100_000, 900_000)], "a bigint, b bigint, c bigint, d bigint")
    out = [r.fisher_p for r in association.fisher_test(df, ("a", "b", "c", "d")).orderBy("a").collect()]
    z = (500_300 - 499_900) / math.sqrt(1e6 * 1e6 * 999_800 * 1_000_200 / ((2e6) ** 2 * (2e6 - 1)))
    assert out[0] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=5e-3)
    assert out[1] == 0.0


def test_fisher_strong_and_skewed_tables(spark):
    """Tables far from their mean keep every term; log p is compared relatively, with exact fractions."""
    from fractions import Fraction

    tables = [(100, 0, 0, 9900), (60, 0, 0, 1_000_000), (0, 40, 900, 3), (7, 3, 50, 100_000), (30, 5, 400, 9000), (1, 999, 999, 1), (2, 8, 3, 7), (500, 500, 500, 500)]
    df = spark.createDataFrame(tables, "a bigint, b bigint, c bigint, d bigint")

    def exact(a, b, c, d):
        r1, r2, c1 = a + b, c + d, a + c
        here = math.comb(r1, a) * math.comb(r2, c1 - a)
        total, k = 0, max(0, c1 - r2)
        for k in range(max(0, c1 - r2), min(r1, c1) + 1):
            term = math.comb(r1, k) * math.comb(r2, c1 - k)
            total += term if term <= here * (1 + Fraction(1, 10**7)) else 0
        p = Fraction(total, math.comb(r1 + r2, c1))
        return (math.log(p.numerator) - math.log(p.denominator)) / math.log(10)

    for r in association.fisher_test(df, ("a", "b", "c", "d")).collect():
        assert r.fisher_log10_p == pytest.approx(exact(r.a, r.b, r.c, r.d), rel=1e-9, abs=1e-9)
    by = {tuple(r)[:4]: r.fisher_p for r in association.fisher_test(df, ("a", "b", "c", "d")).collect()}
    assert by[tables[0]] == pytest.approx(1.5335e-242, rel=1e-4) and by[tables[1]] == pytest.approx(8.306e-279, rel=1e-3)


def test_fdr(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate((0.01, 0.02, 0.03))], "i int, p double")
    assert [r.fdr for r in association.bh_fdr(df, "p", "i").orderBy("i").collect()] == pytest.approx([0.03] * 3)


def test_fdr_brute_force(spark):
    import random

    rng = random.Random(3)
    values = [rng.choice([1.0, 1e-12, 1e-300, rng.random(), round(rng.random(), 2), rng.random() ** 8]) for _ in range(500)]
    ranked = sorted(values)
    n, running, want = len(values), 1.0, {}
    for i in range(n - 1, -1, -1):
        running = min(running, ranked[i] * n / (i + 1))
        want[ranked[i]] = min(want.get(ranked[i], 1.0), running)
    out = association.bh_fdr(spark.createDataFrame(list(enumerate(values)), "i int, p double"), "p", "i").collect()
    assert len(out) == n
    for r in out:
        assert r.fdr == pytest.approx(want[r.p], rel=1e-12), r.p


def test_mantel_haenszel_single_stratum(spark):
    df = spark.createDataFrame([("b", "s", 20, 12, 30, 6)], "block string, s string, first_total bigint, first_present bigint, second_total bigint, second_present bigint")
    gaps = association.stratum_gaps(df, F.lit(False))
    out = association.mantel_haenszel(gaps, ["block"], F.lit(False)).first()
    assert out.pooled_odds_ratio == pytest.approx(12 * 24 / (8 * 6))
    expected = 20 * 18 / 50
    variance = 20 * 30 * 18 * 32 / (50 * 50 * 49)
    assert out.statistic == pytest.approx((12 - expected) ** 2 / variance)
    assert out.p_value == pytest.approx(math.erfc(math.sqrt(out.statistic / 2)))


def test_mantel_haenszel_public_admissions_table(spark):
    data = [(825, 512, 108, 89), (560, 353, 25, 17), (325, 120, 593, 202), (417, 138, 375, 131), (191, 53, 393, 94), (373, 22, 341, 24)]
    df = spark.createDataFrame(
        [("b", str(i), *r) for i, r in enumerate(data)],
        "block string, s string, first_total bigint, first_present bigint, second_total bigint, second_present bigint",
    )
    out = association.mantel_haenszel(association.stratum_gaps(df, F.lit(False)), ["block"], F.lit(False)).first()
    assert (out.pooled_odds_ratio, out.ci_lower, out.ci_upper, out.statistic) == pytest.approx((0.90470, 0.77191, 1.06033, 1.52461), abs=1e-4)


def test_zero_cell_gets_half(spark):
    df = spark.createDataFrame([("b", "s", 4, 4, 5, 1)], "block string, s string, first_total bigint, first_present bigint, second_total bigint, second_present bigint")
    out = association.mantel_haenszel(association.stratum_gaps(df, F.lit(False)), ["block"], F.lit(False)).first()
    assert out.pooled_odds_ratio == pytest.approx(4.5 * 4.5 / (0.5 * 1.5))


def test_empty_subgroup_never_replicates(spark):
    df = spark.createDataFrame([(0.9, 0.1, None, 0.9)], "second double, first double, route_a double, route_b double")
    same, routes = association.replication_rules(
        F.lit("second"), "second", "first", F.lit(True), F.col("first"), F.col("second"),
        (F.lit(0.1), F.lit(0.1)), (F.col("route_a"), F.col("route_b")),
    )
    assert tuple(df.select(same, routes).first()) == (True, False)


def test_direction_edges(spark):
    df = spark.createDataFrame([(0.60,), (-0.60,), (0.59,)], "g double")
    label = association.direction_label(F.col("g"), "second", "first", "none")
    assert [r[0] for r in df.select(label).collect()] == ["second", "first", "none"]


def test_cover_span(spark):
    hits = spark.createDataFrame([(f, "e", "c", p) for f, p in (("a", 1), ("b", 5), ("a", 6), ("c", 9), ("a", 11), ("b", 12))], "f string, e string, c string, p bigint")
    hits = hits.unionByName(spark.createDataFrame([("a", "e", "c2", 1), ("b", "e", "c2", 2), ("a", "x", "c", 3)], hits.schema))
    members = spark.createDataFrame([("blk", x) for x in "abc"], "b string, f string")
    for width in (1, 3, 64):
        assert rows(mod.covering_spans(hits, members, "b", "f", "e", "c", "p", width=width)) == [("blk", "e", 4)]


def test_selection_tie_takes_first(spark):
    df = spark.createDataFrame([("k", "x", 5.0, 2), ("k", "y", 5.0, 1), ("k", "z", 1.0, 0)], "k string, id string, s double, o bigint")
    assert selection.best_per_key(df, ["k"], "s", "o", ["id"]).first().id == "y"


def test_blend_counts(spark):
    major, minor = sampling.blend_sizes(F.lit(5), 50)
    assert tuple(spark.range(1).select(major, minor).first()) == (3, 2)
    with pytest.raises(ValueError):
        sampling.blend_sizes(F.lit(5), 51)


def test_window_larger_than_source_fails(spark):
    totals = spark.createDataFrame([("s", 3)], "source string, total_source_rows bigint")
    with pytest.raises(Exception, match="source smaller than window"):
        sampling.window_manifest(totals, "source", [1], F.lit(4)).collect()


def test_control_threshold(spark):
    data = [(pair, sites) for pair, sites in (("pairA", 18), ("pairB", 19)) for _ in range(6)]
    df = spark.createDataFrame(data, "pair string, sites bigint").withColumn("burden", F.col("sites") * 1e6 / 100000)
    assert sweep.control_threshold(df, "pair", "burden").first().threshold == 950.0
    checks.require(sweep.control_design_check(df, "pair", {"pairA": 6, "pairB": 6}))
    with pytest.raises(checks.CheckFailed):
        checks.require(sweep.control_design_check(df.limit(11), "pair", {"pairA": 6, "pairB": 6}))


def test_threshold_sweep(spark):
    data = [("pass_a", 8.0, 9.0, "rescued_interpretable"), ("pass_b", 25.0, 24.0, "rescued_interpretable"), ("fail_mixed", 120.0, 125.0, "excluded_residual_mixture")]
    df = spark.createDataFrame(data, "sample string, strict double, meta double, decision string").withColumn("gate", F.lit(True))
    calls = sweep.threshold_sweep_calls(df, "sample", ["strict", "meta"], ["gate"], "decision", F.lit(50.0 / 5), [2.0, 3.0, 10.0])
    assert calls.count() == 9
    out = rows(sweep.threshold_sweep_summary(calls), "multiplier")
    assert [r[-1] for r in out] == [False, True, True]
    assert [(r[2], r[3]) for r in out] == [(1, 2), (2, 1), (2, 1)]


def test_frozen_design(spark):
    pairs = spark.createDataFrame(
        [(p, left, right, role, deep) for p, left, right, role, deep in fv.DESIGN_PAIRS],
        "pair_id string, left_source string, right_source string, pair_role string, all_depths boolean",
    )
    grid = sweep.design_grid(pairs)
    r = grid.collect()
    assert len(r) == 40 and len({x.condition_id for x in r}) == 40
    assert sum(x.minor_percent == 10 and x.total_pairs == 2_000_000 for x in r) == 8
    assert sum(x.pair_id in ("pairA", "pairD") for x in r) == 36
    assert {x.total_pairs for x in r} == {1_000_000, 2_000_000, 4_000_000} and {x.seed for x in r} == {202}
    with pytest.raises(ValueError):
        sweep.choose_conditions(grid, "nothing_like_this")


def test_three_digits(spark):
    values = [304.5, 305.5, 2.675, 0.125, 1234.5, 9.995, 0.00012345, 0.000012345, 1e22, 123456.0, 0.5, 2.0, -12.25, 100.0, 999.5, 1.005, 88.25, 12.35, 0.0001]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in tx.add_three_digits(df, "v", "t").collect():
        assert r.t == f"{r.v:.3g}", r.v
    special = spark.createDataFrame([(float("inf"),), (float("nan"),), (0.0,)], "v double")
    assert [r.t for r in tx.add_three_digits(special, "v", "t").collect()] == ["Inf", "nan", "0"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("prot_12", "read1/2 extra", " TRUE "), ("plain", "@r", None)], "a string, h string, t string")
    c, i = tx.split_numeric_suffix("a")
    out = df.select(c, i, tx.mate_key("h"), tx.truth("t")).collect()
    assert tuple(out[0]) == ("prot", 12, "read1", True)
    assert tuple(out[1]) == ("plain", -1, "@r", False)


def test_cascade_without_rule_is_an_error(spark):
    df = spark.createDataFrame([("s1", 1), ("s2", 9)], "s string, v int")
    out = classify.rule_cascade(df, [(F.col("v") == 1, {"panel": "one"})], F.col("s"))
    with pytest.raises(Exception, match="no rule for s2"):
        out.collect()


def test_unknown_rule_is_an_error(spark):
    df = spark.createDataFrame([("odd", True)], "r string, p boolean")
    with pytest.raises(Exception, match="unknown rule"):
        df.select(sweep.rule_satisfied(F.col("r"), F.col("p"), F.col("p"))).collect()


def test_parameter_checks():
    with pytest.raises(ValueError):
        checks.require_known("pairZ", {"pairA"}, "pair")
    checks.require_known("pairA", {"pairA"}, "pair")
    with pytest.raises(ValueError):
        checks.require_between(60, 0, 50, "percent")


def test_components_do_not_depend_on_order(spark):
    edges = [("a", "b"), ("c", "b"), ("d", "e"), ("f", "e"), ("g", "h"), ("h", "c")]
    want = None
    for order in (edges, edges[::-1], [(y, x) for x, y in edges]):
        got = rows(graph.connected_components(spark.createDataFrame(order, "x string, y string"), "x", "y"))
        want = want or got
        assert got == want
    assert dict(want) == {"a": "a", "b": "a", "c": "a", "g": "a", "h": "a", "d": "d", "e": "d", "f": "d"}


def test_analysis_labels(spark):
    names = ["sample_id", "best_public_reporting_species", "best_public_fine_label", "best_type_broad_group", "best_type_fine_label", "type_distinct_fine_label_ani_margin"]
    m = "Mycobacterium "
    data = [
        ("1", m + "colombiense", "", m + "colombiense", "", "1.0", "M_colombiense"),
        ("2", m + "avium", m + "avium subsp. hominissuis", m + "timonense", "", "1.0", "M_avium_hominissuis_adjacent_public_context"),
        ("3", m + "avium", "x", m + "paraintracellulare", "", "1.0", "M_avium_public_group"),
        ("4", "x", "Chimaera", m + "paraintracellulare", "", "1.0", "MI_MP_MIP_lineage"),
        ("5", "x", "a Chimaera group", m + "intracellulare", "Yongonense", "0.1", "MI_chimaera_adjacent_lineage"),
        ("6", "x", "", m + "intracellulare", "Yongonense", "0.149", "MI_yongonense_chimaera_boundary"),
        ("7", "x", "", m + "intracellulare", "Yongonense", "0.15", "MI_TMI_lineage"),
    ]
    df = spark.createDataFrame([d[:6] for d in data], names)
    got = {r.sample_id: r for r in classify.analysis_labels(df).collect()}
    assert {k: v.provisional_genomic_lineage for k, v in got.items()} == {d[0]: d[6] for d in data}
    assert got["2"].boundary_note.startswith("nearest public genomes") and got["4"].figure_label == "MI: MP-MIP"
    with pytest.raises(Exception, match="no rule for 9"):
        classify.analysis_labels(spark.createDataFrame([("9", "x", "", "y", "", "1")], names)).collect()


def test_chi_square_tail_is_native(spark):
    """Against the library function over twelve orders of magnitude, at the border of the two forms and for odd values."""
    import math

    from cohortloom.operators.association import chi_square_tail

    values = [0.0, 1e-12, 1e-3, 0.5, 1.0, 3.84, 4.4999, 4.5, 4.5001, 10.0, 50.0, 300.0, 1400.0, 1e6]
    df = spark.createDataFrame([(v,) for v in values], "x double").withColumn("p", chi_square_tail(F.col("x")))
    for r in df.collect():
        assert r.p == pytest.approx(math.erfc(math.sqrt(r.x / 2)), rel=1e-11, abs=1e-300)
    odd = spark.createDataFrame([(None,), (-1.0,), (float("nan"),)], "x double").select(chi_square_tail(F.col("x")).alias("p"))
    assert all(math.isnan(r.p) for r in odd.collect())
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_symbols_without_indels(spark):
    """The one-pass form and the fold agree on read starts that own any character, also marks and line ends."""
    from cohortloom.functions.evidence import counted_symbols

    cases = [("^].,$", ".,$"), ("^^A^", "A"), ("A^", "A"), ("", ""), ("^\nA", "A"), ("^+A", "A"), ("A+1tG^-C", "AGC"), (None, None)]
    rows = spark.createDataFrame([(c[0],) for c in cases], "pile string").select("pile", counted_symbols("pile").alias("kept")).collect()
    assert [r.kept for r in rows] == [c[1] for c in cases]


def test_block_grid_has_absences(spark):
    from cohortloom.operators import modules

    blocks = spark.createDataFrame([("x", 5), ("y", 5)], "block string, allowed int")
    members = spark.createDataFrame([("x", "f"), ("x", "g"), ("y", "f")], "block string, feature string")
    hits = spark.createDataFrame([("f", "e1", "c", 1), ("g", "e1", "c", 3), ("f", "e2", "c", 9)], "feature string, entity string, container string, position bigint")
    entities = spark.createDataFrame([("e1",), ("e2",), ("e3",), ("e1",)], "entity string")
    calls = modules.block_calls(blocks, members, hits, "block", "feature", "entity", "container", "position", "allowed")
    grid = modules.block_grid(calls, blocks, members, entities, "block", "feature", "entity", "allowed")
    got = {(r.block, r.entity): (r.observed_features, r.minimum_span, r.block_present) for r in grid.collect()}
    assert got == {
        ("x", "e1"): (2, 3, True), ("x", "e2"): (1, None, False), ("x", "e3"): (0, None, False),
        ("y", "e1"): (1, 1, True), ("y", "e2"): (1, 1, True), ("y", "e3"): (0, None, False),
    }
    with pytest.raises(ValueError, match="more than 1 blocks"):
        modules.block_grid(calls, blocks, members, entities, "block", "feature", "entity", "allowed", most=1)
    assert modules.block_grid(calls, blocks.filter("false"), members, entities, "block", "feature", "entity", "allowed").count() == 0
