"""Snapshot selection: flatten, score, flag, select, label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.functions import text as tx
from cohortloom.functions.numeric import number, whole, within
from cohortloom.operators import checks, classify, joins, selection
from cohortloom.plans.registry import Tables, query


def selection_score(source: Column, category: Column, is_type: Column, level: Column, completeness: Column, contamination: Column, n50: Column) -> Column:
    """Additive score of one record, rounded to the decimals it is compared at."""

    def points(c: Column, table: dict[str, float]) -> Column:
        chain = F
        for name, value in table.items():
            chain = chain.when(F.lower(c) == name.lower(), F.lit(value))
        return chain.otherwise(F.lit(0.0))

    return F.round(
        points(source, fv.SOURCE_POINTS)
        + points(category, fv.CATEGORY_POINTS)
        + F.when(is_type, F.lit(fv.TYPE_MATERIAL_POINTS)).otherwise(F.lit(0.0))
        + points(level, fv.LEVEL_POINTS)
        + completeness
        - F.lit(fv.CONTAMINATION_WEIGHT) * contamination
        + F.least(F.lit(fv.N50_POINTS_CAP), F.log10(F.greatest(F.lit(1), n50).cast("double")) * fv.N50_LOG_WEIGHT),
        fv.SCORE_DECIMALS,
    )


def snapshot_table(flat: DataFrame) -> DataFrame:
    """Typed, scored and flagged snapshot rows from the flattened text columns."""
    completeness = F.coalesce(number("checkm_completeness"), F.lit(fv.COMPLETENESS_WHEN_BLANK))
    contamination = F.coalesce(number("checkm_contamination"), F.lit(fv.CONTAMINATION_WHEN_BLANK))
    scored = flat.withColumns(
        {
            "fine_label": tx.token_label(
                "organism_name", fv.FINE_LABEL_TOKENS, tx.first_nonblank("reporting_species", "organism_name")
            ),
            "selection_score": selection_score(
                F.col("source_database"), F.col("refseq_category"), F.col("type_material") == "true",
                F.col("assembly_level"), completeness, contamination, F.col("contig_n50"),
            ),
        }
    )
    measured = {
        "genome_size": F.col("total_length"), "gc": F.col("gc_percent"), "contigs": F.col("number_of_contigs"),
        "n50": F.col("contig_n50"), "checkm_completeness": completeness, "checkm_contamination": contamination,
    }
    rules = {name: within(measured[name], *bounds) for name, bounds in fv.SNAPSHOT_BOUNDS.items()}
    return scored.withColumn("qc_failure_reasons", selection.failure_reasons(rules))


def snapshot_selection(flat: DataFrame) -> DataFrame:
    """Selection ledger of a snapshot: quality first, then pair, then sample."""
    return selection.selection_ledger(
        snapshot_table(flat), "assembly_accession", "pair_key", "biosample", "selection_score",
        "qc_failure_reasons", "ordinal",
    )


def _ledger(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    rows = t.documents.select(
        "doc_id",
        F.md5("text").alias("pair_key"),
        F.col("source").alias("entity"),
        "lang",
        F.round(
            F.when(F.col("lang") == "en", F.lit(100.0)).when(F.col("lang") == "de", F.lit(35.0)).otherwise(F.lit(0.0))
            + F.least(F.lit(fv.N50_POINTS_CAP), F.log10(F.greatest(F.lit(1), n).cast("double")) * fv.N50_LOG_WEIGHT),
            fv.SCORE_DECIMALS,
        ).alias("score"),
        selection.failure_reasons(
            {"length": within(n, 200, 15000), "lang": F.col("lang").isin("en", "de", "fr"), "tiny": within(n, 20, None)}
        ).alias("qc_failure_reasons"),
    )
    return selection.selection_ledger(rows, "doc_id", "pair_key", "entity", "score", "qc_failure_reasons", "doc_id")


_LEDGER_SQL = """
with d as (
  select doc_id, md5(text) as pair_key, source as entity, lang,
    round(case lang when 'en' then 100.0::double when 'de' then 35.0::double else 0.0::double end
      + least(20.0::double, log10(greatest(1, n_chars)::double) * 3.0::double), 6) as score,
    concat_ws(';', case when not (n_chars between 200 and 15000) then 'length' end,
      case when lang not in ('en','de','fr') then 'lang' end,
      case when n_chars < 20 then 'tiny' end) as qc_failure_reasons
  from documents),
q as (select *, row_number() over (partition by pair_key order by score desc, doc_id) as rn,
        min(doc_id) over (partition by pair_key) as pair_first
      from d where qc_failure_reasons = ''),
p as (select * from q where rn = 1),
e as (select *, row_number() over (partition by entity order by score desc, pair_first) as rn2 from p),
w as (
  select d.*, p.doc_id as pair_winner, e2.doc_id as entity_winner
  from d left join p on p.pair_key = d.pair_key
  left join (select * from e where rn2 = 1) e2 on e2.entity = d.entity),
f as (select *, qc_failure_reasons = '' as qc_pass,
        qc_failure_reasons = '' and coalesce(doc_id = pair_winner, false) as selected_after_pair from w),
ledger as (select *, selected_after_pair and coalesce(doc_id = entity_winner, false) as selected_after_entity from f),
final as (select doc_id, pair_key, entity, lang, score, qc_failure_reasons, qc_pass, pair_winner, entity_winner,
  selected_after_pair, selected_after_entity,
  case when not qc_pass then 'excluded_qc' when not selected_after_pair then 'excluded_paired_accession_dedup'
       when not selected_after_entity then 'excluded_biosample_dedup' else 'selected_qc_first' end as selection_decision,
  case when not qc_pass then qc_failure_reasons
       when not selected_after_pair then 'pair_winner=' || pair_winner
       when not selected_after_entity then 'biosample_winner=' || entity_winner else '' end as selection_reason
  from ledger)
"""


@query("sel_ledger", _LEDGER_SQL + "select * from final")
def sel_ledger(t: Tables) -> DataFrame:
    return _ledger(t)


@query(
    "sel_counts",
    _LEDGER_SQL
    + "select selection_decision, count(*) as n, min(doc_id) as first_seen from final group by all order by n desc, first_seen",
)
def sel_counts(t: Tables) -> DataFrame:
    return selection.category_counts(_ledger(t), "selection_decision", "doc_id").orderBy(F.desc("n"), "first_seen")


@query(
    "sel_summary",
    _LEDGER_SQL
    + """select count(*) as n_rows, count(*) filter (where qc_pass) as qc_pass_rows,
      count(*) filter (where selected_after_pair) as after_pair,
      count(*) filter (where selected_after_entity) as after_entity from final""",
)
def sel_summary(t: Tables) -> DataFrame:
    return selection.ledger_counts(_ledger(t))


@query(
    "json_flatten",
    """with e as (select event_id, user_id, event_type, value, props,
         coalesce(json_extract_string(props, '$.k'), '') as k,
         json_extract_string(props, '$.missing.deeper') as gone from events)
    select event_id, k as k_text, try_cast(k as double) as k_number, coalesce(gone, '') as missing_text,
      case when coalesce(gone,'') <> '' then gone when k <> '' then k else event_type end as first_value,
      case when event_type < k then event_type || '|' || k when event_type = k or k = '' then event_type
           else k || '|' || event_type end as pair_key,
      k as attribute_k, '' as attribute_none,
      coalesce(try_cast(k as bigint), 0) as k_or_zero from e""",
)
def json_flatten(t: Tables) -> DataFrame:
    shape = "struct<k:string,missing:struct<deeper:string>>"
    e = t.events.select("event_id", "event_type", F.from_json("props", shape).alias("p"))
    attributes = F.array(
        F.struct(F.lit("Type").alias("name"), F.col("event_type").alias("value")),
        F.struct(F.lit("K").alias("name"), F.col("p.k").alias("value")),
        F.struct(F.lit("k").alias("name"), F.lit("second").alias("value")),
    )
    return e.select(
        "event_id",
        tx.text("p.k").alias("k_text"),
        number("p.k").alias("k_number"),
        tx.text("p.missing.deeper").alias("missing_text"),
        tx.first_nonblank("p.missing.deeper", "p.k", "event_type").alias("first_value"),
        tx.pair_key("event_type", "p.k").alias("pair_key"),
        tx.attribute_value(attributes, "k").alias("attribute_k"),
        tx.attribute_value(attributes, "none").alias("attribute_none"),
        F.coalesce(whole("p.k"), F.lit(0).cast("bigint")).alias("k_or_zero"),
    )


@query(
    "classify_rules",
    """with p as (select p_partkey, p_name, p_brand, p_type, p_size, p_brand || ';' || p_type as membership,
         p_size >= 10 as supported from part)
    select p_partkey,
      case when contains(lower(p_name), 'ring') then 'round' when contains(lower(p_name), 'red') then 'colour'
           when contains(lower(p_name), 'small') then 'size' else p_type end as token_label,
      case when p_type = 'PROMO' and p_size > 25 then 'promo_large' when p_type = 'PROMO' then 'promo_small'
           when starts_with(p_brand, 'Brand#1') then 'first_brands' else 'other' end as panel,
      case when p_type = 'PROMO' and p_size > 25 then 'strong' when p_type = 'PROMO' then 'weak'
           when starts_with(p_brand, 'Brand#1') then p_brand else 'none' end as wording,
      case when contains(membership, 'LARGE') then 'secondary'
           when supported and p_brand in ('Brand#3','Brand#13') or supported and p_type = 'MEDIUM' then 'core'
           when supported then 'supported' else 'not_retained' end as tier
    from p""",
)
def classify_rules(t: Tables) -> DataFrame:
    p = t.part.select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size",
        F.concat_ws(";", "p_brand", "p_type").alias("membership"), (F.col("p_size") >= 10).alias("supported"),
    )
    promo = F.col("p_type") == "PROMO"
    rules = [
        (promo & (F.col("p_size") > 25), {"panel": "promo_large", "wording": "strong"}),
        (promo, {"panel": "promo_small", "wording": "weak"}),
        (F.col("p_brand").startswith("Brand#1"), {"panel": "first_brands", "wording": F.col("p_brand")}),
        (F.col("p_brand").isNotNull(), {"panel": "other", "wording": "none"}),
    ]
    tokens = (("ring", "round"), ("red", "colour"), ("small", "size"))
    names = {"secondary": "secondary", "core": "core", "supported": "supported", "none": "not_retained"}
    return classify.rule_cascade(p, rules, F.col("p_partkey")).select(
        "p_partkey",
        tx.token_label("p_name", tokens, F.col("p_type")).alias("token_label"),
        "panel",
        "wording",
        classify.evidence_tier(
            F.col("supported"), F.col("membership"), ["Brand#3", "Brand#13", "MEDIUM"], "LARGE", names
        ).alias("tier"),
    )


@query(
    "join_strict_checks",
    """select 'orders: key unique' as check_name, 0::bigint as expected,
         (select count(*) from (select o_orderkey from orders group by 1 having count(*) > 1))::bigint as observed, true as ok
       union all select 'customers: right key unique', 0, (select count(*) from (select c_custkey from customer group by 1 having count(*) > 1)), true
       union all select 'customers: every row matched', 0, (select count(*) from orders where o_custkey not in (select c_custkey from customer)), true
       union all select 'nations: right key unique', 0, (select count(*) from (select n_nationkey from nation group by 1 having count(*) > 1)), true
       union all select 'nations: every row matched', 0, (select count(*) from customer where c_nationkey not in (select n_nationkey from nation)), true
       union all select 'lines: key unique', 0, (select count(*) from (select l_orderkey, l_linenumber from lineitem group by 1,2 having count(*) > 1)),
         not exists (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
       union all select 'regions: rows', 5, (select count(*) from region), (select count(*) from region) = 5
       union all select 'orders: statuses', 3, (select count(distinct o_orderstatus) from orders), (select count(distinct o_orderstatus) from orders) = 3
       union all select 'orders: positive price', 0, (select count(*) from orders where not coalesce(o_totalprice > 0, false)),
         not exists (select 1 from orders where not coalesce(o_totalprice > 0, false))
       union all select 'segments present', 2, (select count(distinct c_mktsegment) from customer where c_mktsegment in ('BUILDING','MACHINERY')),
         (select count(distinct c_mktsegment) from customer where c_mktsegment in ('BUILDING','MACHINERY')) = 2
       union all select 'customers with orders', 0,
         (select count(*) from (select c_custkey from customer) c full join (select distinct o_custkey from orders) o on c.c_custkey = o.o_custkey
            where c.c_custkey is null or o.o_custkey is null),
         (select count(*) from (select c_custkey from customer) c full join (select distinct o_custkey from orders) o on c.c_custkey = o.o_custkey
            where c.c_custkey is null or o.o_custkey is null) = 0
       union all select 'flag is A', 0, (select count(*) from lineitem where l_returnflag <> 'A'), (select count(*) from lineitem where l_returnflag <> 'A') = 0""",
)
def join_strict_checks(t: Tables) -> DataFrame:
    orders, customer, nation = t.orders, t.customer, t.nation
    return checks.combine(
        checks.key_unique(orders, ["o_orderkey"], "orders: key unique"),
        joins.lookup_checks(
            orders.select(F.col("o_custkey").alias("c_custkey")), customer, ["c_custkey"], "customers"
        ),
        joins.lookup_checks(
            customer.select(F.col("c_nationkey").alias("n_nationkey")), nation, ["n_nationkey"], "nations"
        ),
        checks.key_unique(t.lineitem, ["l_orderkey", "l_linenumber"], "lines: key unique"),
        checks.row_count(t.region, 5, "regions: rows"),
        checks.distinct_count(orders, "o_orderstatus", 3, "orders: statuses"),
        checks.violations(orders, F.col("o_totalprice") > 0, "orders: positive price"),
        checks.groups_present(customer, "c_mktsegment", ["BUILDING", "MACHINERY"], "segments present"),
        checks.same_members(
            customer.select("c_custkey"), orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey",
            "customers with orders",
        ),
        checks.constant_value(t.lineitem, "l_returnflag", "A", "flag is A"),
    )


@query(
    "strict_lookup",
    """select o_orderkey, c_mktsegment, n_name, o_orderstatus from orders join customer on c_custkey = o_custkey
       join nation on n_nationkey = c_nationkey""",
)
def strict_lookup(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("c_custkey"))
    customer = t.customer.select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    joined = joins.strict_lookup(orders, customer, ["c_custkey"], "customers")
    return joins.strict_lookup(joined, t.nation.select("n_nationkey", "n_name"), ["n_nationkey"], "nations").select(
        "o_orderkey", "c_mktsegment", "n_name", "o_orderstatus"
    )


@query(
    "lookup_default",
    """select d.doc_id, coalesce(l.quality, -1)::bigint as quality, coalesce(l.toxic, 0)::bigint as toxic
       from documents d left join labels l on l.doc_id = d.doc_id""",
)
def lookup_default(t: Tables) -> DataFrame:
    labels = t.labels.select("doc_id", F.col("quality").cast("bigint"), F.col("toxic").cast("bigint"))
    return joins.lookup_or(t.documents.select("doc_id"), labels, ["doc_id"], {"quality": -1, "toxic": 0})


@query(
    "semi_anti",
    """select d.doc_id, d.lang, case when l.doc_id is not null then 'discovery' else 'evaluation' end as cohort_role
       from documents d left join (select distinct doc_id from labels) l on l.doc_id = d.doc_id
       union all
       select o_orderkey, o_orderstatus, 'no_lines' from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)
       union all
       select o_orderkey, o_orderstatus, 'returned' from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')""",
)
def semi_anti(t: Tables) -> DataFrame:
    roles = joins.membership_roles(
        t.documents.select("doc_id", "lang"), t.labels, "doc_id", "discovery", "evaluation"
    )
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    shape = lambda df, role: df.select(
        F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("lang"), F.lit(role).alias("cohort_role")
    )
    return roles.unionByName(shape(orders.join(lines, "o_orderkey", "left_anti"), "no_lines")).unionByName(
        shape(orders.join(lines.filter("l_returnflag = 'R'"), "o_orderkey", "left_semi"), "returned")
    )


@query(
    "last_first_row",
    """select user_id, arg_min(event_type, event_id) as first_type, arg_max(event_type, event_id) as last_type,
         arg_max(value, event_id) as last_value, arg_min(event_id, (-value, event_id)) as best_event
       from events group by user_id""",
)
def last_first_row(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_id", "event_type", "value")
    first = selection.first_per_key(e, ["user_id"], "event_id", ["event_type"]).withColumnRenamed("event_type", "first_type")
    last = selection.last_per_key(e, ["user_id"], "event_id", ["event_type", "value"]).select(
        "user_id", F.col("event_type").alias("last_type"), F.col("value").alias("last_value")
    )
    best = selection.best_per_key(e, ["user_id"], "value", "event_id", ["event_id"]).withColumnRenamed("event_id", "best_event")
    return first.join(last, "user_id").join(best, "user_id")


def _large_open(t: Tables) -> DataFrame:
    """Customers with a large pending order stand for finished results; the others are still to do."""
    return t.orders.filter("o_orderstatus = 'P' and o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))


@query(
    "completion_audit",
    """select c_custkey, case when exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and o_totalprice > 250000) then 'complete' else 'missing' end as status
       from customer""",
)
def completion_audit(t: Tables) -> DataFrame:
    results = _large_open(t)
    return joins.completion_audit(t.customer, results, "c_custkey")


@query(
    "remaining_work",
    "select c_custkey, c_mktsegment from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and o_totalprice > 250000)",
)
def remaining_work(t: Tables) -> DataFrame:
    results = _large_open(t)
    return joins.remaining_work(t.customer.select("c_custkey", "c_mktsegment"), results, "c_custkey")
