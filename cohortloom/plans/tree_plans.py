"""Tree questions, metric summaries and output order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.text import truth
from cohortloom.operators import classify, reshape, tree
from cohortloom.plans.registry import Tables, query

_TREE_SQL = """
with nat as (select n_nationkey, r_name as panel, 'n' || n_nationkey as node, 'r' || r_regionkey as parent, n_nationkey % 7 + 0.5 as len from nation join region on r_regionkey = n_regionkey),
q as (select panel, 'c' || c_custkey as tip, nat.node as nation, nat.len as nlen, 1.0 + (c_custkey * 37 % 1000) / 1000.0 as len, c_custkey as ordinal, 'g' || (c_custkey // 20) as label from customer join nat on n_nationkey = c_nationkey),
s as (select panel, 's' || s_suppkey as tip, nat.node as nation, nat.len as nlen, 1.0 + (s_suppkey * 53 % 1000) / 1000.0 as len, s_suppkey as ordinal from supplier join nat on n_nationkey = s_nationkey)
"""


def _tree(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, query tips, reference tips): customers and suppliers under nations under regions."""
    nation = t.nation.join(t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    none = F.lit(None).cast("string")
    roots = t.region.select(
        F.col("r_name").alias("panel"), F.concat(F.lit("r"), "r_regionkey").alias("node"), none.alias("parent"),
        F.lit(0.0).alias("branch_length"), F.lit(100.0).alias("support"), F.lit(False).alias("is_tip"),
    )
    inner = nation.select(
        F.col("r_name").alias("panel"), F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"),
        (F.col("n_nationkey") % 7 + 0.5).alias("branch_length"), (F.col("n_nationkey") + 60.0).alias("support"), F.lit(False).alias("is_tip"),
    )

    def tips(df: DataFrame, key: str, nation_key: str, letter: str, factor: int) -> DataFrame:
        return df.join(nation.select(F.col("n_nationkey").alias(nation_key), "r_name"), nation_key).select(
            F.col("r_name").alias("panel"), F.concat(F.lit(letter), key).alias("node"), F.concat(F.lit("n"), nation_key).alias("parent"),
            (F.lit(1.0) + (F.col(key) * factor % 1000) / 1000.0).alias("branch_length"), F.lit(None).cast("double").alias("support"),
            F.lit(True).alias("is_tip"), F.col(key).alias("ordinal"), F.concat(F.lit("g"), F.floor(F.col(key) / 20)).alias("label"),
        )

    query_tips = tips(t.customer, "c_custkey", "c_nationkey", "c", 37)
    reference = tips(t.supplier, "s_suppkey", "s_nationkey", "s", 53)
    columns = ["panel", "node", "parent", "branch_length", "support", "is_tip"]
    nodes = roots.unionByName(inner).unionByName(query_tips.select(columns)).unionByName(reference.select(columns))
    return nodes, query_tips, reference


@query(
    "tree_nearest",
    _TREE_SQL
    + """, d as (select q.panel, q.tip, s.tip as nearest_tip, s.ordinal, round(q.len + s.len + case when q.nation = s.nation then 0 else q.nlen + s.nlen end, 9)::double as path_length from q join s using (panel)),
    k as (select *, row_number() over (partition by panel, tip order by path_length, ordinal) as rn from d)
    select panel, tip, nearest_tip, round(path_length, 6) as path_length from k where rn = 1""",
)
def tree_nearest(t: Tables) -> DataFrame:
    nodes, query_tips, reference = _tree(t)
    return tree.nearest_tip(tree.ladder(nodes), query_tips, reference).withColumn("path_length", F.round("path_length", 6))


_MRCA_SQL = (
    _TREE_SQL
    + """, g as (select panel, label, count(*) as n_tips, count(distinct nation) as nn, min(nation) as nation, min(tip) as tip from q group by 1, 2),
m as (select g.*, case when n_tips = 1 then tip when nn = 1 then nation else 'r' || (select r_regionkey from region where r_name = g.panel) end as ancestor from g),
f as (select m.*, (select count(*) from q where q.panel = m.panel and (m.nn > 1 or q.nation = m.nation)) as labelled,
   (select count(*) from s where s.panel = m.panel and (m.nn > 1 or s.nation = m.nation)) as refs from m)
"""
)


@query(
    "tree_mrca",
    _MRCA_SQL
    + """select panel, label, n_tips, n_tips > 1 as testable, case when n_tips = 1 then 'not_applicable_singleton' when labelled = n_tips then 'true' else 'false' end as monophyletic,
      case when n_tips > 1 then ancestor end as ancestor, case when n_tips > 1 then case when nn > 1 then 100.0 else substr(nation, 2)::int + 60.0 end end::double as support,
      case when n_tips > 1 then refs end as reference_inside from f""",
)
def tree_mrca(t: Tables) -> DataFrame:
    nodes, query_tips, reference = _tree(t)
    return tree.label_monophyly(tree.ladder(nodes), query_tips, reference, nodes)


@query(
    "tree_labels_inside",
    _MRCA_SQL
    + """, sl as (select s.*, 'k' || (ordinal % 3) as reference_label from s)
    select m.panel, m.label, m.ancestor, sl.reference_label, count(*) as n from m join sl on sl.panel = m.panel and (m.nn > 1 or sl.nation = m.nation) where m.n_tips > 1 group by 1, 2, 3, 4""",
)
def tree_labels_inside(t: Tables) -> DataFrame:
    nodes, query_tips, reference = _tree(t)
    climbed = tree.ladder(nodes)
    shared = tree.common_ancestors(climbed, query_tips, nodes).filter("n_tips > 1")
    labelled = reference.withColumn("label", F.concat(F.lit("k"), F.col("ordinal") % 3))
    return tree.reference_labels_inside(climbed, shared, labelled)


@query(
    "alignment_shape",
    """select lang, count(*) as records, min(length(text)) as width, min(length(text)) = max(length(text)) as rectangular,
         sum(length(text) - length(regexp_replace(text, '[Nn-]', '', 'g')))::bigint as missing_cells from documents group by lang""",
)
def alignment_shape(t: Tables) -> DataFrame:
    return tree.alignment_shape(t.documents.select("lang", "text"), ["lang"], "text")


@query(
    "context_labels",
    """select c_custkey, c_mktsegment, case when c_acctbal < 0 then 'lineage_not_monophyletic' when c_mktsegment = 'BUILDING' and n_name not in ('NATION_1', 'NATION_2', 'NATION_3') then 'context_conflict'
         when c_mktsegment = 'MACHINERY' and n_name not in ('NATION_4') then 'context_conflict' else 'context_supported' end as consistency,
         c_acctbal >= 95 and c_custkey % 5 <= 2 and c_nationkey <= 20 and c_mktsegment = 'HOUSEHOLD' and c_acctbal * 100 >= 20000 as strict_include
       from customer join nation on n_nationkey = c_nationkey""",
)
def context_labels(t: Tables) -> DataFrame:
    names = {"not_monophyletic": "lineage_not_monophyletic", "conflict": "context_conflict", "supported": "context_supported"}
    rows = t.customer.join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    mono = F.when(F.col("c_acctbal") < 0, F.lit("false")).otherwise(F.lit("true"))
    allowed = {"BUILDING": ["NATION_1", "NATION_2", "NATION_3"], "MACHINERY": ["NATION_4"]}
    return rows.select(
        "c_custkey", "c_mktsegment",
        classify.context_consistency(F.col("c_mktsegment"), F.col("n_name"), allowed, mono, names).alias("consistency"),
        classify.strict_quality(
            F.col("c_mktsegment"), "HOUSEHOLD", F.col("c_acctbal"), F.col("c_custkey") % 5, F.col("c_nationkey"), F.col("c_acctbal") * 100
        ).alias("strict_include_raw"),
        (F.col("c_nationkey") <= 20).alias("near"),
    ).select("c_custkey", "c_mktsegment", "consistency", (F.col("strict_include_raw") & F.col("near")).alias("strict_include"))


_METRIC_SQL = """
with c as (select c_custkey, c_acctbal, (select count(*) from orders where o_custkey = c_custkey) as orders_n, c_nationkey::double as nation_key,
    case when starts_with(c_mktsegment, 'B') or starts_with(c_mktsegment, 'M') then 'direct' else 'recovered' end as grp from customer),
l as (select 'all' as scope, 'c_acctbal' as metric, c_acctbal as value, grp from c union all select 'all', 'orders_n', orders_n::double, grp from c
  union all select 'rich', 'c_acctbal', c_acctbal, grp from c where c_acctbal > 5000 union all select 'rich', 'orders_n', orders_n::double, grp from c where c_acctbal > 5000
  union all select 'rich', 'nation_key', case when nation_key > 2 then nation_key end, grp from c where c_acctbal > 5000)
select scope, metric, count(value) filter (where grp = 'direct') as direct_n, quantile_cont(value, 0.5) filter (where grp = 'direct') as direct_median, min(value) filter (where grp = 'direct') as direct_minimum,
  max(value) filter (where grp = 'direct') as direct_maximum, count(value) filter (where grp = 'recovered') as recovered_n, quantile_cont(value, 0.5) filter (where grp = 'recovered') as recovered_median,
  min(value) filter (where grp = 'recovered') as recovered_minimum, max(value) filter (where grp = 'recovered') as recovered_maximum from l where value is not null group by 1, 2
"""


@query("metric_summary", _METRIC_SQL)
def metric_summary(t: Tables) -> DataFrame:
    """Two scopes, the narrower one with an extra metric, summarised for two groups side by side."""
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders_n"))
    group = F.when(F.col("c_mktsegment").startswith("B") | F.col("c_mktsegment").startswith("M"), F.lit("direct")).otherwise(F.lit("recovered"))
    rows = t.customer.join(counts, "c_custkey", "left").select(
        "c_custkey", "c_acctbal", F.coalesce("orders_n", F.lit(0).cast("bigint")).alias("orders_n"),
        F.when(F.col("c_nationkey") > 2, F.col("c_nationkey").cast("double")).alias("nation_key"), group.alias("grp"),
    )
    long = reshape.stack_sources(
        {
            "all": reshape.long_metrics(rows, ["c_custkey", "grp"], ["c_acctbal", "orders_n"]),
            "rich": reshape.long_metrics(rows.filter("c_acctbal > 5000"), ["c_custkey", "grp"], ["c_acctbal", "orders_n", "nation_key"]),
        },
        "scope",
    )
    return reshape.metric_summary(long, "scope", "grp", ["direct", "recovered"])


@query(
    "ordered_output",
    """select * from (select 'supplier' as cohort_source, s_suppkey as id, s_name as name, format('{:.3f}', s_acctbal) as balance_text, s_acctbal >= 5000 as high from supplier
       union all select 'customer', c_custkey, c_name, format('{:.3f}', c_acctbal), c_acctbal >= 5000 from customer) order by high desc, cohort_source, id""",
)
def ordered_output(t: Tables) -> DataFrame:
    """Two sources under one schema with a tag, in a mixed-direction order that ends on the id."""
    supplier = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("b"))
    customer = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("b"))
    stacked = reshape.stack_sources({"supplier": supplier, "customer": customer}, "cohort_source")
    return stacked.select(
        "cohort_source", "id", "name", F.format_string("%.3f", "b").alias("balance_text"), (F.col("b") >= 5000).alias("high")
    ).orderBy(F.desc("high"), "cohort_source", "id")


@query(
    "truth_text",
    """select c_custkey, lower(trim(case c_custkey % 4 when 0 then ' TRUE ' when 1 then 'true' when 2 then 'False' else '1' end)) = 'true' as flag from customer""",
)
def truth_text(t: Tables) -> DataFrame:
    key = F.col("c_custkey") % 4
    word = F.when(key == 0, F.lit(" TRUE ")).when(key == 1, F.lit("true")).when(key == 2, F.lit("False")).otherwise(F.lit("1"))
    return t.customer.select("c_custkey", truth(word).alias("flag"))
