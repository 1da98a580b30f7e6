"""Block statistics, strict panel, module table, strict joins, record order and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.functions.hashing import label_of
from cohortloom.operators import association, classify, evidence, graph, joins, modules, reshape, sampling, tree
from cohortloom.plans import association_plans as ap
from cohortloom.plans import module_plans as mp
from cohortloom.plans import tree_plans as tp
from cohortloom.plans.file_plans import _folder
from cohortloom.plans.registry import ORACLES, Tables, query
from cohortloom.session import cut_lineage
from cohortloom.sources import records, sinks


def _within(sql: str, columns: str) -> str:
    return f"select {columns} from ({sql})"


@query(
    "block_statistics",
    f"""with b as (select block_id, count(*) as calls, count(*) filter (where present) as present from ({ap._CALLS_SQL} select * from calls) group by 1)
    select b.block_id, b.calls, b.present, m.strata, m.pooled_odds_ratio, m.p_value, r.omitted_strata, r.all_retain_direction, r.minimum_gap
    from b left join ({ORACLES["mh_strata"]}) m using (block_id) left join ({ORACLES["robustness"]}) r using (block_id)""",
)
def block_statistics(t: Tables) -> DataFrame:
    """Summary of every block with its pooled and left-out statistics attached on (block, direction)."""
    keys = ["block_id", "second_expected"]
    calls = ap._calls(t)
    summary = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.count_if("present").alias("present"))
    strata = cut_lineage(ap._strata(t))
    gaps = association.stratum_gaps(association.complete_strata(strata, "source"), F.col("second_expected"))
    pooled = association.mantel_haenszel(gaps, keys, F.col("second_expected"))
    left_out = association.leave_one_out(strata, keys, "source", F.col("second_expected"))
    attached = association.attach_statistics(summary, keys, pooled, association.robustness(left_out, keys))
    return attached.select(
        "block_id", "calls", "present", "strata", F.round("pooled_odds_ratio", 6).alias("pooled_odds_ratio"), F.round("p_value", 6).alias("p_value"),
        "omitted_strata", "all_retain_direction", F.round("minimum_gap", 6).alias("minimum_gap"),
    )


_STRICT = "n_chars >= 800 and doc_id % 7 <> 0"


@query(
    "strict_family",
    f"""with c as ({ap._CALLS_SQL} select calls.*, {_STRICT} as strict from calls join documents using (doc_id)),
g as (select block_id, count(*) filter (where lang = 'fr' and present) as a, count(*) filter (where lang = 'fr' and not present) as b,
    count(*) filter (where lang = 'en' and present) as c, count(*) filter (where lang = 'en' and not present) as d,
    count(*) filter (where strict and lang = 'fr' and present) as sa, count(*) filter (where strict and lang = 'fr' and not present) as sb,
    count(*) filter (where strict and lang = 'en' and present) as sc, count(*) filter (where strict and lang = 'en' and not present) as sd from c group by 1),
full_q as (with g1 as (select * from g), {ap._fisher_sql("g1", "a", "b", "c", "d")} select block_id, tab.log10_p, adj.q from g1 join tab using (a, b, c, d) join adj on adj.p = round(tab.p, 13)),
strict_q as (with g2 as (select block_id, sa, sb, sc, sd from g), {ap._fisher_sql("g2", "sa", "sb", "sc", "sd")}
    select block_id, tab.log10_p, adj.q from g2 join tab on tab.a = sa and tab.b = sb and tab.c = sc and tab.d = sd join adj on adj.p = round(tab.p, 13))
select g.block_id, a as present_second, sa as strict_present_second, c as present_first, sc as strict_present_first, round(f.log10_p, 4) as log10_p, round(f.q, 6) as fdr,
  round(s.log10_p, 4) as strict_log10_p, round(s.q, 6) as strict_fdr from g join full_q f using (block_id) join strict_q s using (block_id)""",
)
def strict_family(t: Tables) -> DataFrame:
    """Every block tested twice, on all entities and on those of strict quality, each family with its own FDR."""
    strict = t.documents.select("doc_id", ((F.col("n_chars") >= 800) & (F.col("doc_id") % 7 != 0)).alias("strict"))
    counts = cut_lineage(
        association.two_panel_counts(ap._calls(t).join(strict, "doc_id"), "block_id", ap._second(), ap._first(), F.col("present"), F.col("strict"))
    )
    names = ("second_present", "second_absent", "first_present", "first_absent")
    full = association.fisher_fdr(counts.select("block_id", *names), names, "block_id").select(
        "block_id", F.round("fisher_log10_p", 4).alias("log10_p"), F.round("fdr", 6).alias("fdr")
    )
    narrow = tuple(f"strict_{n}" for n in names)
    strict_tests = association.fisher_fdr(counts.select("block_id", *narrow), narrow, "block_id").select(
        "block_id", F.round("fisher_log10_p", 4).alias("strict_log10_p"), F.round("fdr", 6).alias("strict_fdr")
    )
    return counts.select(
        "block_id", F.col("second_present").alias("present_second"), F.col("strict_second_present").alias("strict_present_second"),
        F.col("first_present").alias("present_first"), F.col("strict_first_present").alias("strict_present_first"),
    ).join(full, "block_id").join(strict_tests, "block_id")


@query(
    "module_table",
    f"""with cmp as ({ORACLES["module_compactness"]}), mem as ({ORACLES["signature_modules"]}),
e as (select m.module, b.entity from (select distinct module, direction, leader from mem) m
   join (select distinct l_returnflag as direction, l_linestatus || lpad(l_quantity::int::varchar, 2, '0') as feature, l_suppkey % 40 as entity from lineitem) b on b.direction = m.direction and b.feature = m.leader)
select e.module, cmp.features, count(*) as entities, count(*) filter (where entity % 2 = 0) as first_cohort, count(*) filter (where entity % 2 = 1) as second_cohort,
   any_value(compact_fraction) as compact_fraction, any_value(cmp.features >= {fv.SYNTENIC_MIN_FEATURES} and compact_fraction >= {fv.MIN_ADJACENCY}) as syntenic from e join cmp using (module) group by 1, 2""",
)
def module_table(t: Tables) -> DataFrame:
    """Modules with the entities that hold them by cohort, their compact fraction, and whether they count as syntenic."""
    bands, members = mp._modules(t)
    entities = bands.select("direction", "feature", "entity").distinct()
    keyed = members.select("module", F.concat_ws("/", "direction", "feature").alias("feature"))
    placed = bands.select(F.concat_ws("/", "direction", "feature").alias("feature"), "entity", "position")
    compact = modules.module_compactness(keyed, placed, "module", "feature", "entity", "position", slack=60)
    cohorts = {"first_cohort": F.col("entity") % 2 == 0, "second_cohort": F.col("entity") % 2 == 1}
    leaders = members.filter(F.col("feature") == F.col("leader")).select("direction", "feature", "module")
    out = modules.module_cohorts(entities.join(leaders, ["direction", "feature"]), compact, "module", cohorts)
    return out.select("module", "features", "entities", *cohorts, F.round("compact_fraction", 6).alias("compact_fraction"), "syntenic")


_FLAGS = "case l_linenumber % 4 when 0 then 2 when 1 then 2 + 256 when 2 then 3 when 3 then 2 + 2048 end + case when l_quantity > 45 then 1 else 0 end"


@query(
    "proper_rows",
    f"""select l_orderkey, l_linenumber, l_partkey from lineitem where (({_FLAGS})::bigint & 2) = 2 and (({_FLAGS})::bigint & 2304) = 0""",
)
def proper_rows(t: Tables) -> DataFrame:
    """Proper, primary rows by their flag bits, in coordinate order."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.expr(_FLAGS).cast("bigint").alias("flag"))
    return reshape.coordinate_order(evidence.keep_proper(lines, "flag").drop("flag"), "l_partkey", "l_orderkey")


@query("name_ordered_rows", "select conv_id, turn, role from conversations")
def name_ordered_rows(t: Tables) -> DataFrame:
    """All turns of a conversation next to each other."""
    return reshape.name_order(t.conversations.select("conv_id", "turn", "role"), "conv_id")


_LABEL_EVIDENCE = {
    "best_public_reporting_species": ("'Mycobacterium ' || case doc_id % 5 when 0 then 'colombiense' when 1 then 'avium' else 'x' end"),
    "best_public_fine_label": "case doc_id % 3 when 0 then 'subsp. hominissuis' when 1 then 'a Chimaera group' else '' end",
    "best_type_broad_group": "'Mycobacterium ' || case when doc_id % 5 = 0 then 'colombiense' when doc_id % 4 = 0 then 'paraintracellulare' else 'intracellulare' end",
    "best_type_fine_label": "case when doc_id % 2 = 0 then 'Yongonense' else '' end",
    "type_distinct_fine_label_ani_margin": "cast((doc_id % 30) / 100.0 as varchar)",
}


def _label_sql() -> str:
    rules = {
        "colombiense": "s = 'Mycobacterium colombiense' and g = 'Mycobacterium colombiense'",
        "avium_hominissuis": "s = 'Mycobacterium avium' and contains(f, 'hominissuis')",
        "avium": "s = 'Mycobacterium avium'",
        "mp_mip": "g = 'Mycobacterium paraintracellulare'",
        "chimaera": "contains(lower(f), 'chimaera')",
        "yongonense": "contains(lower(a), 'yongonense') and m < 0.15",
        "tmi": "g = 'Mycobacterium intracellulare'",
    }
    cases = [
        "case " + " ".join(f"when {c} then '{fv.LABEL_TEXTS[r][k]}'" for r, c in rules.items()) + f" end as {name}"
        for k, name in enumerate(fv.LABEL_COLUMNS)
    ]
    e = _LABEL_EVIDENCE
    return f"""with e as (select doc_id, {e["best_public_reporting_species"]} as s, {e["best_public_fine_label"]} as f, {e["best_type_broad_group"]} as g,
      {e["best_type_fine_label"]} as a, (doc_id % 30) / 100.0 as m from documents) select doc_id as sample_id, {", ".join(cases)} from e"""


@query("analysis_labels", _label_sql())
def analysis_labels(t: Tables) -> DataFrame:
    """The seven label columns of every sample."""
    evidence_table = t.documents.select(
        F.col("doc_id").alias("sample_id"), *[F.expr(e.replace("varchar", "string")).alias(n) for n, e in _LABEL_EVIDENCE.items()]
    )
    return classify.analysis_labels(evidence_table).select("sample_id", *fv.LABEL_COLUMNS)


@query(
    "one_to_one",
    """with l as (select l_suppkey, count(*) as lines, sum(l_quantity)::bigint as quantity from lineitem group by 1)
    select s_suppkey, s_name, lines, quantity from supplier left join l on l_suppkey = s_suppkey""",
)
def one_to_one(t: Tables) -> DataFrame:
    """Every supplier with its totals; neither side may repeat a key."""
    totals = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity")
    )
    return joins.one_to_one(t.supplier.select("s_suppkey", "s_name"), totals, ["s_suppkey"], "supplier totals")


@query(
    "list_and_report",
    """select 'list' as kind, 'order' || o_orderkey as value from orders where o_orderstatus = 'P'
    union all select 'report', '- ' || l_returnflag || ': ' || count(*) from lineitem group by l_returnflag""",
)
def list_and_report(t: Tables) -> DataFrame:
    """A sorted id list and a report of counts, written as text and read again."""
    chosen = t.orders.filter("o_orderstatus = 'P'").select(F.concat(F.lit("order"), "o_orderkey").alias("id"))
    counts = t.lineitem.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    spark, path = _folder(chosen, "report")
    sinks.write_list(chosen, "id", f"{path}/list")
    sinks.write_report(sinks.report_lines(counts, "- %s: %d", ["l_returnflag", "n"], [F.desc("n")]), f"{path}/text")
    return spark.read.text(f"{path}/list").select(F.lit("list").alias("kind"), "value").unionByName(
        spark.read.text(f"{path}/text").select(F.lit("report").alias("kind"), "value")
    )


@query(
    "tree_file",
    tp._TREE_SQL
    + """, n as (select r_name as panel, false as is_tip, 0.0 as len from region union all select panel, false, len from nat union all select panel, true, len from q union all select panel, true, len from s)
    select panel, count(*) as nodes, count(*) filter (where is_tip) as tips, round(sum(len)::double, 6) as total_length from n group by 1""",
)
def tree_file(t: Tables) -> DataFrame:
    """Trees written as node tables, read again and measured."""
    nodes, _, _ = tp._tree(t)
    spark, path = _folder(nodes, "trees")
    nodes.write.parquet(path)
    return records.read_tree_nodes(spark, path).groupBy("panel").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if("is_tip").alias("tips"), F.round(F.sum("branch_length"), 6).alias("total_length")
    )


@query(
    "component_members",
    mp._COMPONENT_SQL
    + """, pn as (select direction, feature, count(distinct user_id) as size from pl group by 1, 2)
    select component, direction, node as feature, 'product of ' || direction as product, size from lab join pn on feature = node""",
)
def component_members(t: Tables) -> DataFrame:
    """Every member of every component with its direction, product and size."""
    hours = mp._hour_features(t)
    labels = graph.connected_components(mp._edges(t), "feature_a", "feature_b")
    about = hours.groupBy("direction", "feature").agg(F.countDistinct("user_id").alias("size")).withColumn(
        "product", F.concat(F.lit("product of "), "direction")
    )
    return graph.component_members(labels, about, "feature").select("component", "direction", "feature", "product", "size")


@query(
    "panel_composition",
    """select lang as panel, count(*) as records, count(*) filter (where l.quality = 1) as n_good, count(*) filter (where l.quality = 0) as n_poor,
      count(*) filter (where l.quality is null) as n_unlabelled, min(n_chars) = max(n_chars) as rectangular from documents left join labels l using (doc_id) group by 1""",
)
def panel_composition(t: Tables) -> DataFrame:
    """Composition of each panel by source beside the shape of its alignment."""
    labels = t.labels.select("doc_id", "quality")
    group = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").otherwise("unlabelled")
    rows = t.documents.select("doc_id", F.col("lang").alias("panel"), "n_chars").join(labels, "doc_id", "left").withColumn("group", group)
    return tree.panel_composition(rows, "panel", "group", ["good", "poor", "unlabelled"], "n_chars")


@query(
    "nested_outputs",
    ap._SCREEN_SQL
    + """, z as (select *, coalesce(concordant, false) and coalesce(routes, false) as robust from f)
    select 'all' as level, count(*) as features from z union all select 'candidate', count(*) filter (where candidate) from z
    union all select 'concordant', count(*) filter (where concordant) from z union all select 'route_robust', count(*) filter (where robust) from z""",
)
def nested_outputs(t: Tables) -> DataFrame:
    """The screen as four nested tables, each a filter of the one before, written and counted."""
    screened = ap._screened(t).select("word", "fisher_p", "fdr", "candidate", "concordant", "route_consistent")
    spark, path = _folder(screened, "nested")
    levels = sinks.write_nested(screened, path, {"candidate": "candidate", "concordant": "concordant", "route_robust": "route_consistent"})
    return reshape.stack_sources({name: spark.read.parquet(place) for name, place in levels.items()}, "level").groupBy("level").agg(
        F.count(F.lit(1)).alias("features")
    )


_HASH = "('0x' || substr(sha256({}), 1, 15))::bigint"


@query(
    "complement_sample",
    f"""with r as (select doc_id, lang, row_number() over (partition by lang order by {_HASH.format("'pick:' || doc_id")}, doc_id) as rn, count(*) over (partition by lang) as n from documents)
    select doc_id, lang from r where rn > n // 4""",
)
def complement_sample(t: Tables) -> DataFrame:
    """What a sample leaves: the same choice, excluded."""
    documents = t.documents.select("doc_id", "lang")
    sizes = sampling.source_totals(documents, "lang").select("lang", F.floor(F.col("total_source_rows") / 4).alias("sample_rows"))
    return sampling.without_sample(documents, sizes, "lang", "doc_id", label_of("pick", F.col("doc_id")))
