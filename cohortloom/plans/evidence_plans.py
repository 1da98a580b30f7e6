"""Minority-evidence screening: decode, burden, calibration, sweeps and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.operators import classify, evidence, joins, quantiles, sweep
from cohortloom.plans.registry import Tables, query


@query(
    "n50_by_source",
    r"""with d as (select source, doc_id, length(text)::bigint as len,
          length(regexp_replace(text, '[^GgCc]', '', 'g'))::bigint as gc from documents where length(text) >= 20),
    r as (select source, len, sum(len) over (partition by source order by len desc, doc_id rows unbounded preceding) as run,
          sum(len) over (partition by source) as tot from d),
    n as (select source, max(len) as n50 from r where run * 2 >= tot group by source)
    select d.source, sum(len)::bigint as total_length, count(*) as records, max(len) as longest, n.n50,
      round(100.0::double * sum(gc)::double / sum(len)::double, 6) as gc_percent
    from d join n using (source) group by d.source, n.n50""",
)
def n50_by_source(t: Tables) -> DataFrame:
    texts = t.documents.select("doc_id", "source", "text")
    return evidence.sequence_stats(texts, ["source"], "text", min_length=20).withColumn(
        "gc_percent", F.round("gc_percent", 6)
    )


@query(
    "histogram_median",
    """with r as (select l_suppkey, l_quantity::bigint as q, row_number() over (partition by l_suppkey order by l_quantity) as rn,
          count(*) over (partition by l_suppkey) as n from lineitem)
    select l_suppkey, max(q) filter (where rn = (n + 1) // 2)::bigint as median_quantity from r group by l_suppkey""",
)
def histogram_median(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_suppkey", F.col("l_quantity").cast("bigint").alias("q"))
    return quantiles.lower_median(rows, ["l_suppkey"], "q", "median_quantity")


def _pile_rows(t: Tables) -> DataFrame:
    """One evidence string per line, with read starts, read ends, indels and placeholders mixed in."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    letter = F.when(F.col("l_returnflag") == "A", F.lit("a")).when(F.col("l_returnflag") == "N", F.lit("T")).otherwise(F.lit("n"))
    pile = F.concat(
        F.lit("^]"), F.expr("repeat('.', cast(l_quantity as int))"), F.lit(",$"),
        F.when(n % 2 == 0, F.lit("+12acgtacgtacgt")).otherwise(F.lit("*<>")),
        F.expr("repeat(case l_returnflag when 'A' then 'a' when 'N' then 'T' else 'n' end, l_linenumber)"),
        F.when(n % 3 == 0, F.lit("-1tC")).otherwise(F.lit("^+")),
        F.when(n == 7, F.lit("+2^Ag")).otherwise(F.lit("^^")),
    )
    ref = F.when(F.col("l_linestatus") == "F", F.lit("g")).otherwise(F.lit("N"))
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_quantity", "l_returnflag")
    return lines.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", q.alias("q"), letter.alias("letter"),
        ref.alias("ref"), pile.alias("pile"),
    )


_COUNTS_SQL = """
with c as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linestatus,
    case when l_returnflag = 'A' then l_linenumber else 0 end::bigint as "n_A",
    case when l_linenumber % 3 = 0 then 1 else 0 end::bigint as "n_C",
    (case when l_linestatus = 'F' then l_quantity::bigint + 1 else 0 end + case when l_linenumber = 7 then 1 else 0 end)::bigint as "n_G",
    case when l_returnflag = 'N' then l_linenumber else 0 end::bigint as "n_T",
    case when l_linestatus <> 'F' then l_quantity::bigint + 1 else 0 end::bigint as n_other
  from lineitem)
"""


@query(
    "pileup_decode",
    _COUNTS_SQL + 'select l_orderkey, l_partkey, l_suppkey, l_linenumber, "n_A", "n_C", "n_G", "n_T", n_other from c',
)
def pileup_decode(t: Tables) -> DataFrame:
    return evidence.decode_rows(_pile_rows(t)).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "n_A", "n_C", "n_G", "n_T", "n_other"
    )


_BURDEN_SQL = """
, d as (select {keys}, depth, list_sort([a, c, g, t, o], 'desc')[2] as minor from {src}),
f as (select *, depth >= 20 as callable, depth >= 20 and minor >= 5 as enough from d),
r as (select *, row_number() over (partition by {keys} order by case when callable then 0 else 1 end, depth) as rn,
        sum(case when callable then 1 else 0 end) over (partition by {keys}) as n from f),
burden as (select {keys}, count(*) as total_positions, count(*) filter (where callable) as callable_positions,
   coalesce(max(depth) filter (where callable and rn = (n + 1) // 2), 0)::bigint as median_depth,
   count(*) filter (where enough and minor / depth between 0.10 and 0.90) as mixed_wide,
   count(*) filter (where enough and minor / depth between 0.20 and 0.80) as mixed_narrow from r group by {keys}),
burdens as (select *, case when callable_positions > 0 then mixed_wide * 1000000.0::double / callable_positions else 0.0::double end as wide_per_million,
   case when callable_positions > 0 then mixed_narrow * 1000000.0::double / callable_positions else 0.0::double end as narrow_per_million from burden)
"""

_PILE_BURDEN_SQL = (
    _COUNTS_SQL
    + ', x as (select l_suppkey as sample, l_linestatus as route, "n_A" as a, "n_C" as c, "n_G" as g, "n_T" as t, n_other as o, '
    '"n_A" + "n_C" + "n_G" + "n_T" + n_other as depth from c)'
    + _BURDEN_SQL.format(keys="sample, route", src="x")
)
_BURDEN_COLUMNS = (
    "total_positions, callable_positions, median_depth, mixed_wide, mixed_narrow, "
    "round(wide_per_million, 6) as wide_per_million, round(narrow_per_million, 6) as narrow_per_million"
)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.endswith("_per_million")})


@query("pileup_burden", _PILE_BURDEN_SQL + f"select sample, route, {_BURDEN_COLUMNS} from burdens")
def pileup_burden(t: Tables) -> DataFrame:
    """Evidence strings to one burden row per sample and route."""
    decoded = evidence.decode_rows(_pile_rows(t)).select(
        F.col("l_suppkey").alias("sample"), F.col("l_linestatus").alias("route"), *[f"n_{b}" for b in fv.BASE_NAMES]
    )
    return _rounded(evidence.mixture_burden(decoded, ["sample", "route"]))


def _brand_burden(t: Tables) -> DataFrame:
    base = F.when(F.col("l_linenumber") < 5, F.lit("a")).otherwise(
        F.when(F.col("l_returnflag") == "A", F.lit("A")).when(F.col("l_returnflag") == "N", F.lit("C")).otherwise(F.lit("x"))
    )
    rows = t.lineitem.select("l_partkey", F.col("l_linestatus").alias("route"), base.alias("base"))
    counted = evidence.base_count_columns(rows, ["l_partkey", "route"], "base")
    brands = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("sample"))
    return evidence.mixture_burden(
        joins.keep_known(counted, brands, ["l_partkey"]), ["sample", "route"], min_depth=12, min_minor=3
    )


_BRAND_SQL = (
    """
with b as (select l_partkey, l_linestatus as route, case when l_linenumber < 5 then 'A' when l_returnflag = 'A' then 'A'
      when l_returnflag = 'N' then 'C' else 'x' end as base from lineitem),
x as (select p_brand as sample, route, count(*) filter (where base = 'A') as a, count(*) filter (where base = 'C') as c, 0::bigint as g,
    0::bigint as t, count(*) filter (where base = 'x') as o, count(*) as depth from b join part on p_partkey = l_partkey group by l_partkey, p_brand, route)
"""
    + _BURDEN_SQL.format(keys="sample, route", src="x").replace(">= 20", ">= 12").replace("minor >= 5", "minor >= 3")
)


@query("minority_burden", _BRAND_SQL + f"select sample, route, {_BURDEN_COLUMNS} from burdens")
def minority_burden(t: Tables) -> DataFrame:
    return _rounded(_brand_burden(t))


_CONTROLS = ("Brand#1", "Brand#2")


@query(
    "control_threshold",
    _BRAND_SQL
    + """, ctl as (select max(narrow_per_million) * 1.25 as threshold, count(*) as controls, count(distinct sample) as control_pairs
        from burdens where sample in ('Brand#1', 'Brand#2'))
    select sample, route, round(wide_per_million, 6) as wide_per_million, round(narrow_per_million, 6) as narrow_per_million,
      round(threshold, 6) as threshold, narrow_per_million > threshold as primary_positive, wide_per_million > 250000 as auxiliary_positive,
      narrow_per_million > threshold or wide_per_million > 250000 as combined_positive, 'frozen' as threshold_status
    from burdens, ctl""",
)
def control_threshold(t: Tables) -> DataFrame:
    """Threshold from pure controls, its design check, and strict flags for every sample."""
    burdens = _brand_burden(t)
    controls = burdens.filter(F.col("sample").isin(*_CONTROLS))
    limit = sweep.control_threshold(controls, "sample", "narrow_per_million", multiplier=1.25)
    design = sweep.control_design_check(controls, "sample", {c: 2 for c in _CONTROLS})
    flagged = sweep.flag_positive(
        burdens.withColumn("threshold", limit.select("threshold").scalar()),
        F.col("narrow_per_million"), F.col("wide_per_million"), F.col("threshold"), F.lit(250000.0),
    )
    return _rounded(flagged.withColumn("threshold_status", sweep.threshold_status(design, "frozen", "provisional"))).select(
        "sample", "route", "wide_per_million", "narrow_per_million", F.round("threshold", 6).alias("threshold"),
        "primary_positive", "auxiliary_positive", "combined_positive", "threshold_status",
    )


_SWEEP_SQL = (
    _BRAND_SQL
    + """, base as (select max(narrow_per_million) / 5.0 as baseline from burdens),
w as (select sample, max(case when route = 'F' then narrow_per_million end) as "F_narrow", max(case when route = 'O' then narrow_per_million end) as "O_narrow",
   max(case when route = 'F' then callable_positions end) as fc, max(case when route = 'O' then callable_positions end) as oc from burdens group by sample),
s as (select sample, "F_narrow", "O_narrow", fc >= 40 as depth_gate, oc >= 40 as second_gate,
   case when greatest("F_narrow", "O_narrow") <= baseline * 4 and fc >= 40 and oc >= 40 then 'rescued_interpretable' else 'excluded' end as decision, baseline from w, base),
calls as (select multiplier, baseline * multiplier as threshold, sample, "F_narrow", "O_narrow", greatest("F_narrow", "O_narrow") as maximum_burden,
   depth_gate and second_gate as other_gates, decision as frozen_decision, greatest("F_narrow", "O_narrow") <= baseline * multiplier as burden_gate,
   depth_gate and second_gate and greatest("F_narrow", "O_narrow") <= baseline * multiplier as eligible
 from s, (select unnest([2.0, 3.0, 4.0, 5.0, 7.5, 10.0])::double as multiplier))
"""
)


def _sweep_calls(t: Tables) -> DataFrame:
    burdens = _brand_burden(t)
    wide = joins.evidence_rows(burdens, "sample", "route", ["F", "O"], ["narrow_per_million", "callable_positions"])
    baseline = burdens.agg((F.max("narrow_per_million") / fv.CONTROL_MULTIPLIER).alias("baseline")).scalar()
    samples = wide.select(
        "sample",
        F.col("F_narrow_per_million").alias("F_narrow"),
        F.col("O_narrow_per_million").alias("O_narrow"),
        (F.col("F_callable_positions") >= 40).alias("depth_gate"),
        (F.col("O_callable_positions") >= 40).alias("second_gate"),
        baseline.alias("baseline"),
    ).withColumn(
        "decision",
        F.when(
            (F.greatest("F_narrow", "O_narrow") <= F.col("baseline") * 4) & F.col("depth_gate") & F.col("second_gate"),
            F.lit(fv.RESCUED_PREFIX),
        ).otherwise(F.lit("excluded")),
    )
    return sweep.threshold_sweep_calls(
        samples, "sample", ["F_narrow", "O_narrow"], ["depth_gate", "second_gate"], "decision", F.col("baseline"),
        list(fv.SWEEP_MULTIPLIERS),
    )


@query(
    "sweep_calls",
    _SWEEP_SQL
    + """select multiplier, round(threshold, 6) as threshold, sample, round("F_narrow", 6) as "F_narrow", round("O_narrow", 6) as "O_narrow",
      round(maximum_burden, 6) as maximum_burden, other_gates, frozen_decision, burden_gate, eligible from calls""",
)
def sweep_calls(t: Tables) -> DataFrame:
    return _sweep_calls(t).withColumns({c: F.round(c, 6) for c in ("threshold", "F_narrow", "O_narrow", "maximum_burden")})


@query(
    "threshold_sweep",
    _SWEEP_SQL
    + """select multiplier, round(threshold, 6) as threshold, count(*) filter (where eligible) as eligible_count,
      count(*) filter (where not eligible) as excluded_count, bool_and(eligible = starts_with(frozen_decision, 'rescued_interpretable')) as reproduces_frozen
    from calls group by multiplier, threshold""",
)
def threshold_sweep(t: Tables) -> DataFrame:
    return sweep.threshold_sweep_summary(_sweep_calls(t)).withColumn("threshold", F.round("threshold", 6))


@query("sweep_members", _SWEEP_SQL + "select multiplier, eligible, sample from calls order by 1, 2, 3")
def sweep_members(t: Tables) -> DataFrame:
    return sweep.sweep_members(_sweep_calls(t), "sample")


_FLOOR_SQL = """
with c as (select c_custkey, (9700 + (c_custkey * 31 + c_nationkey * 7) % 300) / 100.0::double as s1, (9700 + (c_custkey * 17 + c_nationkey * 13) % 300) / 100.0::double as s2,
    case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'first_group' else 'second_group' end as expected, c_acctbal >= 0 as qc from customer),
calls as (select f as floor, c_custkey, greatest(s1, s2) >= f as qualified, case when greatest(s1, s2) < f then 'outside' when s1 >= s2 then 'first_group' else 'second_group' end as assigned_group, expected, qc
  from c, (select unnest([98.0, 98.5, 98.6, 99.0])::double as f)),
bc as (select c_custkey, b as block, case when b in ('F', 'O') then 'first_group' else 'second_group' end as block_group,
    (select count(*) from orders where o_custkey = c_custkey and o_orderstatus = b) >= 3 as present from customer, (select unnest(['F', 'O', 'P']) as b)),
blocks as (select floor, block, block_group, count(*) filter (where assigned_group = block_group and present) as expected_present,
    count(*) filter (where assigned_group = block_group) as expected_total, count(*) filter (where assigned_group <> block_group and present) as other_present,
    count(*) filter (where assigned_group <> block_group) as other_total
  from calls join bc using (c_custkey) where qualified group by 1, 2, 3),
directed as (select *, coalesce(expected_present / nullif(expected_total, 0) > other_present / nullif(other_total, 0), false) as direction_retained from blocks)
"""


def _floor_parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    samples = t.customer.select(
        "c_custkey",
        ((9700 + (key * 31 + nation * 7) % 300) / 100.0).alias("s1"),
        ((9700 + (key * 17 + nation * 13) % 300) / 100.0).alias("s2"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.lit("first_group")).otherwise(F.lit("second_group")).alias("expected"),
        (F.col("c_acctbal") >= 0).alias("qc"),
    )
    calls = sweep.floor_sweep_calls(
        samples, list(fv.MEMBERSHIP_FLOORS), F.greatest("s1", "s2"), F.col("s1"), F.col("s2"),
        "first_group", "second_group", "outside",
    )
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("block")).agg(
        (F.count(F.lit(1)) >= 3).alias("present")
    )
    grid = t.customer.select("c_custkey", F.explode(F.array(*[F.lit(b) for b in "FOP"])).alias("block"))
    block_calls = joins.lookup_or(grid, counts, ["c_custkey", "block"], {"present": False}).withColumn(
        "block_group", F.when(F.col("block").isin("F", "O"), F.lit("first_group")).otherwise(F.lit("second_group"))
    )
    blocks = sweep.floor_sweep_blocks(
        calls, block_calls, "c_custkey", "block", "present", "block_group", "first_group", "second_group"
    )
    return calls, blocks


@query(
    "floor_sweep_blocks",
    _FLOOR_SQL + "select floor, block, block_group, expected_present, expected_total, other_present, other_total, direction_retained from directed",
)
def floor_sweep_blocks(t: Tables) -> DataFrame:
    return _floor_parts(t)[1]


@query(
    "floor_sweep",
    _FLOOR_SQL
    + """select c.floor, count(*) filter (where qualified) as qualified_total, count(*) filter (where assigned_group = 'first_group') as qualified_first,
      count(*) filter (where assigned_group = 'second_group') as qualified_second, count(*) filter (where qualified and qc) as qualified_qc_pass,
      count(*) filter (where qualified and assigned_group = expected) as expected_concordant,
      (select bool_and(direction_retained) from directed d where d.floor = c.floor) as all_directions_retained
    from calls c group by c.floor""",
)
def floor_sweep(t: Tables) -> DataFrame:
    calls, blocks = _floor_parts(t)
    return sweep.floor_sweep_summary(calls, blocks, "expected", "qc", "first_group", "second_group")


_ROUTES_SQL = """
with m as (select l_suppkey, l_linestatus as r, (sum(l_quantity::bigint) * 700)::bigint as size,
    63.0 + sum(round(l_discount * 100)::bigint)::double / count(*)::double as gc, count(distinct l_partkey) as contigs,
    (max(round(l_extendedprice)::bigint) // 4)::bigint as n50,
    97.0 + sum(round(l_tax * 100)::bigint)::double / count(*)::double * 0.5 as identity,
    0.5 + count(distinct l_partkey)::double / count(*)::double * 0.4 as fraction,
    85.0 + sum(l_quantity::bigint)::double / count(*)::double / 5.0 as completeness,
    (count(*) % 7)::double as contamination, case when count(*) % 9 = 0 then ' False' else 'True ' end as gunc,
    count(*) filter (where l_returnflag = 'R') * 1000.0::double / count(*)::double as burden,
    case when max(l_quantity) >= 50 then 'top' else 'low' end as type_name,
    90.0 + count(distinct l_orderkey) % 12::double as type_identity, 0.45 + (count(*) % 5)::double / 10.0 as type_fraction,
    max(l_partkey) as accession
  from lineitem group by 1, 2),
w as (select f.l_suppkey, least(f.size, o.size) as size_low, greatest(f.size, o.size) as size_high, least(f.gc, o.gc) as gc_low, greatest(f.gc, o.gc) as gc_high,
   greatest(f.contigs, o.contigs) as contigs_high, least(f.n50, o.n50) as n50_low, least(f.identity, o.identity) as id_low, least(f.fraction, o.fraction) as fr_low,
   least(f.completeness, o.completeness) as comp_low, greatest(f.contamination, o.contamination) as cont_high, trim(f.gunc) = 'True' and trim(o.gunc) = 'True' as gunc_gate,
   greatest(f.burden, o.burden) as burden_high, f.type_name = o.type_name as same_name, least(f.type_identity, o.type_identity) as ti_low,
   least(f.type_fraction, o.type_fraction) as tf_low, f.accession = o.accession as same_anchor
  from (select * from m where r = 'F') f join (select * from m where r = 'O') o using (l_suppkey)),
lim as (select avg(burden_high) * 1.1 as threshold from w),
g as (select l_suppkey, size_low >= 4000000 and size_high <= 7500000 and gc_low >= 66.0 and gc_high <= 71.0 and contigs_high <= 500 and n50_low >= 20000 as assembly_gate,
   id_low >= 99.0 and fr_low >= 0.85 as route_concordance_gate, comp_low >= 90.0 and cont_high <= 5.0 as checkm2_gate, gunc_gate,
   burden_high <= threshold as minor_alleles_gate, same_name and ti_low >= 94.0 and tf_low >= 0.5 as type_anchor_gate, same_anchor, burden_high from w, lim)
"""


def _route_metrics(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    share = lambda c: c.cast("double") / n.cast("double")
    hundred = lambda c: F.sum(F.round(F.col(c) * 100).cast("bigint"))
    quantity = F.sum(F.col("l_quantity").cast("bigint"))
    parts, orders = F.countDistinct("l_partkey"), F.countDistinct("l_orderkey")
    return t.lineitem.groupBy("l_suppkey", F.col("l_linestatus").alias("route")).agg(
        (quantity * 700).alias("size"),
        (F.lit(63.0) + share(hundred("l_discount"))).alias("gc"),
        parts.alias("contigs"),
        F.floor(F.max(F.round("l_extendedprice").cast("bigint")) / 4).cast("bigint").alias("n50"),
        (F.lit(97.0) + share(hundred("l_tax")) * 0.5).alias("identity"),
        (F.lit(0.5) + share(parts) * 0.4).alias("fraction"),
        (F.lit(85.0) + share(quantity) / 5.0).alias("completeness"),
        (n % 7).cast("double").alias("contamination"),
        F.when(n % 9 == 0, F.lit(" False")).otherwise(F.lit("True ")).alias("gunc"),
        (F.count_if(F.col("l_returnflag") == "R") * 1000.0 / n.cast("double")).alias("burden"),
        F.when(F.max("l_quantity") >= 50, F.lit("top")).otherwise(F.lit("low")).alias("type_name"),
        (F.lit(90.0) + (orders % 12).cast("double")).alias("type_identity"),
        (F.lit(0.45) + (n % 5).cast("double") / 10.0).alias("type_fraction"),
        F.max("l_partkey").alias("accession"),
    )


@query(
    "qc_gates",
    _ROUTES_SQL
    + """select l_suppkey, assembly_gate, route_concordance_gate, checkm2_gate, gunc_gate, minor_alleles_gate, type_anchor_gate, round(burden_high, 6) as maximum_burden,
   case when assembly_gate and route_concordance_gate and checkm2_gate and gunc_gate and minor_alleles_gate and type_anchor_gate
          then case when same_anchor then 'rescued_interpretable' else 'rescued_interpretable_type_boundary_caution' end
        when not minor_alleles_gate then 'unrecoverable_residual_mac_mixture' when not route_concordance_gate then 'unrecoverable_route_discordance'
        when not assembly_gate or not checkm2_gate or not gunc_gate then 'unrecoverable_genome_qc' else 'unrecoverable_type_anchor_instability' end as decision
   from g""",
)
def qc_gates(t: Tables) -> DataFrame:
    """Metrics of two routes side by side, a threshold from all samples, six gates and the decision."""
    metrics = [c for c in _route_metrics(t).columns if c not in ("l_suppkey", "route")]
    wide = joins.evidence_rows(_route_metrics(t), "l_suppkey", "route", ["F", "O"], metrics)
    worst = F.greatest("F_burden", "O_burden")
    limit = wide.agg((F.avg(worst) * 1.1).alias("limit")).scalar()
    gated = classify.route_gates(wide, "F", "O", limit)
    return gated.select(
        "l_suppkey",
        *[f"{g}_gate" for g in classify.GATES],
        F.round(worst, 6).alias("maximum_burden"),
        classify.recovery_decision(F.col("F_accession") == F.col("O_accession")).alias("decision"),
    )


@query(
    "evidence_row",
    """with c as (select * from lineitem where (l_linenumber & 2) = 2 and (l_linenumber & 4) = 0 and l_quantity >= 20 and round(l_discount * 100) >= 2),
       m as (select l_suppkey, count(*) filter (where l_returnflag = 'A') as "A_rows", count(*) filter (where l_returnflag = 'R') as "R_rows",
          max(l_quantity) filter (where l_returnflag = 'A') as "A_top", max(l_quantity) filter (where l_returnflag = 'R') as "R_top" from c group by 1)
       select s.s_suppkey, nullif("A_rows", 0) as "A_rows", nullif("R_rows", 0) as "R_rows", "A_top", "R_top", n_name,
         coalesce("A_rows", 0) > coalesce("R_rows", 0) and s_acctbal > 0 as a_leads
       from supplier s join m on m.l_suppkey = s.s_suppkey join nation on n_nationkey = s_nationkey where "A_rows" + "R_rows" > 0""",
)
def evidence_row(t: Tables) -> DataFrame:
    """Bit filter, quality filter, then both routes side by side per supplier."""
    lines = t.lineitem.filter(
        (F.col("l_linenumber").bitwiseAND(F.lit(2)) == 2) & (F.col("l_linenumber").bitwiseAND(F.lit(4)) == 0)
    ).withColumn("base_quality", F.round(F.col("l_discount") * 100))
    kept = evidence.quality_rows(lines, "l_quantity", "base_quality", 20, 2)
    long = (
        kept.filter(F.col("l_returnflag").isin("A", "R"))
        .groupBy(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("l_quantity").alias("top"))
    )
    wide = joins.evidence_rows(long, "s_suppkey", "l_returnflag", ["A", "R"], ["rows", "top"])
    supplier = t.supplier.select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("n_nationkey"))
    zero = F.lit(0).cast("bigint")
    return (
        joins.keep_known(joins.keep_known(wide, supplier, ["s_suppkey"]), t.nation.select("n_nationkey", "n_name"), ["n_nationkey"])
        .withColumn("a_leads", (F.coalesce("A_rows", zero) > F.coalesce("R_rows", zero)) & (F.col("s_acctbal") > 0))
        .select("s_suppkey", "A_rows", "R_rows", "A_top", "R_top", "n_name", "a_leads")
    )


@query(
    "condition_rollup",
    """select l_returnflag, l_linestatus, l_linenumber::bigint as fraction, count(*) as rows, round(avg(l_tax), 6) as tax_mean, min(l_tax) as tax_min, max(l_tax) as tax_max,
         round(avg((l_discount > 0.05)::int), 6) as deep_rate, quantile_cont(l_quantity, 0.5) as median_depth from lineitem group by 1, 2, 3""",
)
def condition_rollup(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("bigint").alias("fraction"), "l_tax", "l_quantity",
        (F.col("l_discount") > 0.05).alias("deep"),
    )
    out = sweep.condition_rollup(
        rows, ["l_returnflag", "l_linestatus", "fraction"], "l_quantity", {"tax": "l_tax"}, {"deep": "deep"}
    )
    return out.withColumns({"tax_mean": F.round("tax_mean", 6), "deep_rate": F.round("deep_rate", 6)})


@query(
    "positive_counts",
    """select l_linenumber::bigint as fraction, count(*) as conditions, count(*) filter (where l_quantity > 40) as primary_positive,
         count(*) filter (where l_discount > 0.08) as auxiliary_positive, count(*) filter (where l_quantity > 40 or l_discount > 0.08) as combined_positive,
         count(*) filter (where case l_linenumber when 1 then not (l_quantity > 40 or l_discount > 0.08) when 2 then l_quantity > 40 or l_discount > 0.08 else l_quantity > 40 end) as rule_met,
         min(l_extendedprice) as l_extendedprice_min, max(l_extendedprice) as l_extendedprice_max from lineitem group by 1""",
)
def positive_counts(t: Tables) -> DataFrame:
    number = F.col("l_linenumber")
    rule = (
        F.when(number == 1, F.lit(fv.EXPECTED_RULES[0])).when(number == 2, F.lit(fv.EXPECTED_RULES[10])).otherwise(F.lit(fv.EXPECTED_RULES[20]))
    )
    rows = t.lineitem.select(number.cast("bigint").alias("fraction"), "l_quantity", "l_discount", "l_extendedprice", rule.alias("rule"))
    flagged = sweep.flag_positive(rows, F.col("l_quantity"), F.col("l_discount"), F.lit(40.0), F.lit(0.08)).withColumn(
        "rule_met", sweep.rule_satisfied(F.col("rule"), F.col("primary_positive"), F.col("auxiliary_positive"))
    )
    return sweep.positive_counts(
        flagged, "fraction", ["primary_positive", "auxiliary_positive", "combined_positive", "rule_met"], ["l_extendedprice"]
    )


@query(
    "weighted_hits",
    """with h as (select l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity::bigint as m, l_quantity::bigint + round(l_discount * 100)::bigint as b,
          (l_orderkey % 200)::bigint as s, (l_orderkey % 200 + l_quantity::bigint)::bigint as e from lineitem),
    g as (select * from h where m::double / b >= 0.90),
    f as (select l_partkey, sum(m::double / b * m) / sum(m) as weighted_identity, count(*) as supporting, arg_min(l_suppkey, (-m, l_orderkey, l_linenumber, l_suppkey)) as best_target from g group by 1),
    pts as (select distinct l_partkey, unnest(range(s, e)) as x from g),
    u as (select l_partkey, count(*) as covered from pts group by 1)
    select p.p_partkey as l_partkey, (p_size * 10)::bigint as length, best_target, round(weighted_identity, 6) as weighted_identity,
      case when supporting is not null then round(covered::double / (p_size * 10), 6) end as covered_fraction, coalesce(supporting, 0) as supporting,
      coalesce(p_size * 10 >= 100 and supporting > 0 and covered::double / (p_size * 10) >= 0.5, false) as retained
    from part p left join f on f.l_partkey = p.p_partkey left join u on u.l_partkey = p.p_partkey""",
)
def weighted_hits(t: Tables) -> DataFrame:
    quantity = F.col("l_quantity").cast("bigint")
    hits = t.lineitem.select(
        "l_partkey", "l_suppkey", quantity.alias("m"), (quantity + F.round(F.col("l_discount") * 100).cast("bigint")).alias("b"),
        (F.col("l_orderkey") % 200).alias("s"), (F.col("l_orderkey") % 200 + quantity).alias("e"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("place"),
    )
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 10).alias("length"))
    out = evidence.weighted_support(
        hits, parts, "l_partkey", "length", target="l_suppkey", start="s", end="e", matches="m", block="b", ordinal="place",
        min_identity=fv.MIN_ALIGN_IDENTITY, min_fraction=0.5, min_length=100,
    )
    return out.withColumns({c: F.round(c, 6) for c in ("weighted_identity", "covered_fraction")})
