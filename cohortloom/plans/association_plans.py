"""Feature association: presence, exact test, FDR, replication, strata and held-out evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.hashing import label_of, stable_number
from cohortloom.functions.text import add_three_digits
from cohortloom.operators import association, joins
from cohortloom.plans.registry import Tables, query
from cohortloom.session import cut_lineage


def _first() -> Column:
    return F.col("lang") == "en"


def _second() -> Column:
    return F.col("lang") == "fr"


def _panel(t: Tables, documents: DataFrame) -> DataFrame:
    """Documents with cohort (labelled or not) and sub-route (parity of the source number)."""
    labelled = t.labels.select("doc_id").distinct().withColumn("public", F.lit(True))
    return documents.join(labelled, "doc_id", "left").withColumns(
        {
            "public": F.col("public").isNotNull(),
            "direct": F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 0,
        }
    )


def _word_counts(t: Tables, groups: dict[str, Column]) -> DataFrame:
    """Presence counts of every word over whole texts.

    A document's groups are settled before its words are unfolded, so exploded rows are never joined.
    """
    texts = t.documents.select("doc_id", "lang", "source", "text")
    flagged = association.flag_entities(_panel(t, texts), groups, ["text"])
    words = flagged.withColumn("word", F.explode(F.array_distinct(F.split("text", r"\s+")))).drop("text")
    totals = association.group_totals(_panel(t, t.documents.select("doc_id", "lang", "source")), groups)
    return association.counts_of_flagged(words, totals, "word", list(groups))


def _groups() -> dict[str, Column]:
    return {
        "public_first": F.col("public") & _first(),
        "public_second": F.col("public") & _second(),
        "local_first": ~F.col("public") & _first(),
        "local_second": ~F.col("public") & _second(),
        "local_first_direct": ~F.col("public") & _first() & F.col("direct"),
        "local_first_other": ~F.col("public") & _first() & ~F.col("direct"),
        "local_second_direct": ~F.col("public") & _second() & F.col("direct"),
        "local_second_other": ~F.col("public") & _second() & ~F.col("direct"),
    }

_PRESENCE_SQL = r"""
with panel as (select d.doc_id, lang, source, text, exists (select 1 from labels l where l.doc_id = d.doc_id) as public,
    regexp_extract(source, '(\d+)$', 1)::int % 2 = 0 as direct from documents d),
pres as (select distinct doc_id, unnest(string_split_regex(text, '\s+')) as word from documents),
j as (select word, lang, public, direct from pres join panel using (doc_id)),
cnt as (select word, count(*) as entities_present,
  count(*) filter (where public and lang = 'en') as public_first_present, count(*) filter (where public and lang = 'fr') as public_second_present,
  count(*) filter (where not public and lang = 'en') as local_first_present, count(*) filter (where not public and lang = 'fr') as local_second_present,
  count(*) filter (where not public and lang = 'en' and direct) as local_first_direct_present, count(*) filter (where not public and lang = 'en' and not direct) as local_first_other_present,
  count(*) filter (where not public and lang = 'fr' and direct) as local_second_direct_present, count(*) filter (where not public and lang = 'fr' and not direct) as local_second_other_present
  from j group by word),
tot as (select count(*) filter (where public and lang = 'en') as public_first_total, count(*) filter (where public and lang = 'fr') as public_second_total,
  count(*) filter (where not public and lang = 'en') as local_first_total, count(*) filter (where not public and lang = 'fr') as local_second_total,
  count(*) filter (where not public and lang = 'en' and direct) as local_first_direct_total, count(*) filter (where not public and lang = 'en' and not direct) as local_first_other_total,
  count(*) filter (where not public and lang = 'fr' and direct) as local_second_direct_total, count(*) filter (where not public and lang = 'fr' and not direct) as local_second_other_total
  from panel),
counts as (select * from cnt, tot)
"""


def _fisher_sql(source: str, a: str, b: str, c: str, d: str) -> str:
    """CTEs ``tab`` (a, b, c, d, p, odds) and ``adj`` (p, q) for the 2x2 tables of a source."""
    return f"""
tabs as (select {a} as a, {b} as b, {c} as c, {d} as d, count(*) as w from {source} group by 1, 2, 3, 4),
terms as (select a, b, c, d, w, k,
   lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1)
   - lgamma(k + 1) - lgamma(a + b - k + 1) - lgamma(a + c - k + 1) - lgamma(d - a + k + 1) as lp,
   lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1)
   - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) as lo
  from (select *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as k from tabs)),
tab as (select a, b, c, d, w, case when a + b = 0 or c + d = 0 or a + c = 0 or b + d = 0 then 1.0
     else least(1.0, sum(exp(lp)) filter (where lp <= lo + ln(1 + 1e-7))) end as p,
   case when a + b = 0 or c + d = 0 or a + c = 0 or b + d = 0 then 0.0
     else least(0.0, any_value(lo) / ln(10) + log10(sum(exp(least(lp - lo, 1.0))) filter (where lp <= lo + ln(1 + 1e-7)))) end as log10_p,
   case when a + b = 0 or c + d = 0 or a + c = 0 or b + d = 0 then 'nan'::double when b * c = 0 then 'inf'::double
     else (a * d)::double / (b * c)::double end as odds
  from terms group by a, b, c, d, w),
dp as (select round(p, 13) as p, sum(w) as w from tab group by 1),
rk as (select p, p * sum(w) over () / sum(w) over (order by p rows unbounded preceding) as raw from dp),
adj as (select p, least(1.0, min(raw) over (order by p desc rows unbounded preceding)) as q from rk)
"""


@query(
    "presence_counts",
    _PRESENCE_SQL
    + """select word, entities_present, public_first_present, public_second_present, local_first_present, local_second_present,
   public_first_total, public_second_total, round(public_first_present / public_first_total, 6) as public_first_prevalence,
   round(public_second_present / public_second_total, 6) as public_second_prevalence,
   round(public_second_present / public_second_total - public_first_present / public_first_total, 6) as gap from counts""",
)
def presence_counts(t: Tables) -> DataFrame:
    groups = {g: c for g, c in _groups().items() if g in ("public_first", "public_second", "local_first", "local_second")}
    counts = _word_counts(t, groups)
    return counts.select(
        "word", "entities_present", *[f"{g}_present" for g in groups], "public_first_total", "public_second_total",
        F.round("public_first_prevalence", 6).alias("public_first_prevalence"),
        F.round("public_second_prevalence", 6).alias("public_second_prevalence"),
        F.round(F.col("public_second_prevalence") - F.col("public_first_prevalence"), 6).alias("gap"),
    )


@query(
    "panel_presence",
    """with p as (select distinct l_partkey, l_suppkey from lineitem),
    tot as (select count(*) filter (where s_acctbal < 3000) as low_total, count(*) filter (where s_acctbal >= 6000) as high_total from supplier)
    select l_partkey, count(*) as entities_present, count(*) filter (where s_acctbal < 3000) as low_present, count(*) filter (where s_acctbal >= 6000) as high_present,
      any_value(low_total) as low_total, any_value(high_total) as high_total, round(count(*) filter (where s_acctbal < 3000) / any_value(low_total), 6) as low_prevalence,
      round(count(*) filter (where s_acctbal >= 6000) / any_value(high_total), 6) as high_prevalence
    from p join supplier on s_suppkey = l_suppkey, tot group by l_partkey""",
)
def panel_presence(t: Tables) -> DataFrame:
    """Presence counts from a stored (feature, entity) table joined to an entity panel."""
    presence = association.distinct_presence(t.lineitem, "l_partkey", "l_suppkey")
    panel = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    groups = {"low": F.col("s_acctbal") < 3000, "high": F.col("s_acctbal") >= 6000}
    out = association.presence_counts(presence, panel, "l_partkey", "l_suppkey", groups)
    return out.withColumns({f"{g}_prevalence": F.round(f"{g}_prevalence", 6) for g in groups})


def _tested(t: Tables) -> DataFrame:
    counts = cut_lineage(_word_counts(t, _groups()))
    cells = counts.withColumns(
        {
            "second_absent": F.col("public_second_total") - F.col("public_second_present"),
            "first_absent": F.col("public_first_total") - F.col("public_first_present"),
        }
    )
    return association.fisher_fdr(
        cells, ("public_second_present", "second_absent", "public_first_present", "first_absent"), "word"
    )


_SCREEN_SQL = (
    _PRESENCE_SQL
    + ", "
    + _fisher_sql(
        "counts", "public_second_present", "public_second_total - public_second_present", "public_first_present",
        "public_first_total - public_first_present",
    )
    + """, s as (select c.*, tab.p as fisher_p, tab.log10_p, tab.odds, adj.q as fdr,
    public_first_present / public_first_total as p1, public_second_present / public_second_total as p2,
    local_first_present / nullif(local_first_total, 0) as l1, local_second_present / nullif(local_second_total, 0) as l2,
    local_first_direct_present / nullif(local_first_direct_total, 0) as l1d, local_first_other_present / nullif(local_first_other_total, 0) as l1o,
    local_second_direct_present / nullif(local_second_direct_total, 0) as l2d, local_second_other_present / nullif(local_second_other_total, 0) as l2o
  from counts c join tab on tab.a = public_second_present and tab.c = public_first_present join adj on adj.p = round(tab.p, 13)),
r as (select *, case when p2 - p1 >= 0.60 then 'second_enriched' when p2 - p1 <= -0.60 then 'first_enriched' else 'not_strongly_associated' end as direction,
   fdr <= 0.01 and ((p2 >= 0.80 and p1 <= 0.20) or (p1 >= 0.80 and p2 <= 0.20)) as candidate from s),
f as (select *, candidate and coalesce(case direction when 'second_enriched' then l2 >= 0.75 and l1 <= 0.25 when 'first_enriched' then l1 >= 0.75 and l2 <= 0.25 else false end, false) as concordant,
   coalesce(case direction when 'second_enriched' then l2d >= 0.60 and l2o >= 0.60 and l1d <= 0.50 and l1o <= 0.50
        when 'first_enriched' then l1d >= 0.50 and l1o >= 0.50 and l2d <= 0.40 and l2o <= 0.40 else false end, false) as routes from r)
"""
)


def _screened(t: Tables) -> DataFrame:
    tested = _tested(t)
    first, second = F.col("public_first_prevalence"), F.col("public_second_prevalence")
    labelled = tested.withColumn(
        "direction",
        association.direction_label(second - first, "second_enriched", "first_enriched", "not_strongly_associated"),
    ).withColumn("candidate", association.discovery_rule(F.col("fdr"), first, second))
    concordant, consistent = association.replication_rules(
        F.col("direction"), "second_enriched", "first_enriched", F.col("candidate"),
        F.col("local_first_prevalence"), F.col("local_second_prevalence"),
        (F.col("local_first_direct_prevalence"), F.col("local_first_other_prevalence")),
        (F.col("local_second_direct_prevalence"), F.col("local_second_other_prevalence")),
    )
    return labelled.withColumn("concordant", concordant).withColumn("route_consistent", consistent)


@query(
    "fisher_fdr",
    _SCREEN_SQL
    + """select word, public_first_present, public_second_present, round(fisher_p, 6) as fisher_p, round(log10_p, 4) as fisher_log10_p, round(fdr, 6) as fdr,
    case when isfinite(odds) then round(odds, 6) end as odds_ratio,
    case when isinf(odds) then 'Inf' else format('{:.3g}', odds) end as odds_display, direction, candidate, concordant, concordant and routes as route_consistent from f""",
)
def fisher_fdr(t: Tables) -> DataFrame:
    """Association screen of every word: exact test, FDR, direction, candidate and replication flags."""
    odds = F.col("odds_ratio")
    finite = ~F.isnan(odds) & (odds != float("inf"))
    return add_three_digits(_screened(t), "odds_ratio", "odds_display").select(
        "word", "public_first_present", "public_second_present", F.round("fisher_p", 6).alias("fisher_p"), F.round("fisher_log10_p", 4).alias("fisher_log10_p"),
        F.round("fdr", 6).alias("fdr"), F.when(finite, F.round(odds, 6)).alias("odds_ratio"),
        "odds_display", "direction", "candidate", "concordant", "route_consistent",
    )


@query(
    "screen_summary",
    _SCREEN_SQL
    + """select count(*) as features, count(*) filter (where candidate) as candidates, count(*) filter (where concordant) as concordant,
      count(*) filter (where concordant and routes) as route_consistent, any_value(public_first_total) as public_first_total, any_value(public_second_total) as public_second_total from f""",
)
def screen_summary(t: Tables) -> DataFrame:
    return _screened(t).agg(
        F.count(F.lit(1)).alias("features"), F.count_if("candidate").alias("candidates"), F.count_if("concordant").alias("concordant"),
        F.count_if("route_consistent").alias("route_consistent"), F.max("public_first_total").alias("public_first_total"),
        F.max("public_second_total").alias("public_second_total"),
    )


_SIGNALS = {"first_of": "of", "first_in": "in", "first_the": "the", "second_le": "le", "second_de": "de", "first_weak": "|", "second_weak": "en"}
_CALLS_SQL = r"""
with sig as (select * from (values ('first_of', 'of'), ('first_in', 'in'), ('first_the', 'the'), ('second_le', 'le'), ('second_de', 'de'), ('first_weak', '|'), ('second_weak', 'en')) v(block_id, word)),
calls as (select block_id, starts_with(block_id, 'second_') as second_expected, doc_id, lang, source, list_contains(string_split_regex(text, '\s+'), word) as present
  from documents, sig where lang in ('en', 'fr'))
"""


def _flagged(documents: DataFrame) -> DataFrame:
    """Documents of either group with one small entry per signal; the texts end here, after one pass over their words."""
    known = F.array(*[F.lit(w) for w in _SIGNALS.values()])
    entries = [
        F.struct(F.lit(b).alias("block_id"), F.lit(b.startswith("second_")).alias("second_expected"), F.array_contains("found", w).alias("present"))
        for b, w in _SIGNALS.items()
    ]
    found = F.array_intersect(F.split("text", r"\s+"), known)
    texts = documents.filter(_first() | _second()).select("doc_id", "lang", "source", found.alias("found"))
    return texts.select("doc_id", "lang", "source", F.array(*entries).alias("_s"))


def _calls_of(flagged: DataFrame) -> DataFrame:
    """One row per (signal, document), absences included. The signal list is a literal."""
    return flagged.select("doc_id", "lang", "source", F.inline("_s"))


def _calls(t: Tables) -> DataFrame:
    return _calls_of(_flagged(t.documents))


@query(
    "heldout_eval",
    _CALLS_SQL
    + """, ev as (select * from calls where ('0x' || substr(sha256(doc_id::varchar), 1, 15))::bigint % 2 <> 0),
g as (select block_id, count(*) filter (where (lang = 'fr') = second_expected) as expected_total, count(*) filter (where (lang = 'fr') = second_expected and present) as expected_present,
   count(*) filter (where (lang = 'fr') <> second_expected) as opposite_total, count(*) filter (where (lang = 'fr') <> second_expected and present) as opposite_present from ev group by 1),
"""
    + _fisher_sql("g", "expected_present", "expected_total - expected_present", "opposite_present", "opposite_total - opposite_present")
    + """select block_id, case when starts_with(block_id, 'second_') then 'fr' else 'en' end as expected_group, 7::bigint as family_size, expected_present, expected_total, opposite_present, opposite_total,
   round(expected_present / expected_total - opposite_present / opposite_total, 6) as prevalence_difference, case when isinf(odds) then 'Inf' else format('{:.3g}', odds) end as odds_display,
   round(tab.p, 6) as fisher_p, round(tab.log10_p, 4) as fisher_log10_p, round(q, 6) as fdr
  from g join tab on a = expected_present and b = expected_total - expected_present and c = opposite_present and d = opposite_total - opposite_present join adj on adj.p = round(tab.p, 13)""",
)
def heldout_eval(t: Tables) -> DataFrame:
    """Discovery documents are set aside by a stable hash; the rest evaluates five fixed signals."""
    discovery = t.documents.select("doc_id").filter(stable_number(label_of(F.col("doc_id"))) % 2 == 0)
    calls = _calls_of(_flagged(t.documents.join(discovery, "doc_id", "left_anti")))
    expected = F.when(F.col("second_expected"), _second()).otherwise(_first())
    counts = calls.groupBy("block_id").agg(
        F.count_if(expected).alias("expected_total"), F.count_if(expected & F.col("present")).alias("expected_present"),
        F.count_if(~expected).alias("opposite_total"), F.count_if(~expected & F.col("present")).alias("opposite_present"),
    )
    cells = counts.withColumns(
        {
            "expected_absent": F.col("expected_total") - F.col("expected_present"),
            "opposite_absent": F.col("opposite_total") - F.col("opposite_present"),
        }
    )
    tested = association.fisher_fdr(
        cells, ("expected_present", "expected_absent", "opposite_present", "opposite_absent"), "block_id"
    )
    return add_three_digits(tested, "odds_ratio", "odds_display").select(
        "block_id",
        F.when(F.col("block_id").startswith("second_"), F.lit("fr")).otherwise(F.lit("en")).alias("expected_group"),
        F.lit(len(_SIGNALS)).cast("bigint").alias("family_size"),
        "expected_present", "expected_total", "opposite_present", "opposite_total",
        F.round(
            F.try_divide("expected_present", "expected_total") - F.try_divide("opposite_present", "opposite_total"), 6
        ).alias("prevalence_difference"),
        "odds_display",
        F.round("fisher_p", 6).alias("fisher_p"), F.round("fisher_log10_p", 4).alias("fisher_log10_p"),
        F.round("fdr", 6).alias("fdr"),
    )


@query(
    "heldout_roles",
    """select doc_id, lang, case when ('0x' || substr(sha256(doc_id::varchar), 1, 15))::bigint % 2 = 0 then 'discovery' else 'evaluation' end as cohort_role
       from documents where lang in ('en', 'fr')""",
)
def heldout_roles(t: Tables) -> DataFrame:
    full = t.documents.filter(_first() | _second()).select("doc_id", "lang")
    discovery = full.filter(stable_number(label_of(F.col("doc_id"))) % 2 == 0)
    return joins.membership_roles(full, discovery, "doc_id", "discovery", "evaluation")


_STRATA_SQL = (
    _CALLS_SQL
    + """, st as (select block_id, second_expected, source, count(*) filter (where lang = 'en') as n1, count(*) filter (where lang = 'en' and present) as x1,
   count(*) filter (where lang = 'fr') as n2, count(*) filter (where lang = 'fr' and present) as x2 from calls group by 1, 2, 3)
"""
)
_GAP_SQL = "case when second_expected then x2 / n2 - x1 / n1 else x1 / n1 - x2 / n2 end"


def _strata(t: Tables) -> DataFrame:
    return association.stratum_counts(
        _calls(t), ["block_id", "second_expected"], "source", _first(), _second(), F.col("present")
    )


@query(
    "stratum_gaps",
    _STRATA_SQL
    + f"""select block_id, source, x1 as first_present, n1 as first_total, x2 as second_present, n2 as second_total,
   round({_GAP_SQL}, 6) as expected_gap, {_GAP_SQL} > 0 as direction_concordant from st where n1 > 0 and n2 > 0 and source <> ''""",
)
def stratum_gaps(t: Tables) -> DataFrame:
    gaps = association.stratum_gaps(association.complete_strata(_strata(t), "source"), F.col("second_expected"))
    return gaps.select(
        "block_id", "source", "first_present", "first_total", "second_present", "second_total",
        F.round("expected_gap", 6).alias("expected_gap"), "direction_concordant",
    )


@query(
    "mh_strata",
    _STRATA_SQL
    + f""", u as (select block_id, {_GAP_SQL} as gap, (case when second_expected then x2 else x1 end)::double as a0, (case when second_expected then n2 - x2 else n1 - x1 end)::double as b0,
   (case when second_expected then x1 else x2 end)::double as c0, (case when second_expected then n1 - x1 else n2 - x2 end)::double as d0 from st where n1 > 0 and n2 > 0 and source <> ''),
 z as (select *, case when least(a0, b0, c0, d0) = 0 then 0.5 else 0.0 end::double as h from u),
 v as (select block_id, gap, a0 + h as a, b0 + h as b, c0 + h as c, d0 + h as d, a0 + b0 + c0 + d0 + 4 * h as n from z),
 s as (select block_id, count(*) as strata, count(*) filter (where gap <> 0) as informative_strata, count(*) filter (where gap > 0) as concordant_strata,
   sum(a*d/n) as r, sum(b*c/n) as t, sum(a - (a+b)*(a+c)/n) as df, sum((a+b)*(c+d)*(a+c)*(b+d)/(n*n*(n-1))) as va,
   sum((a+d)/n*a*d/n) as pr, sum((a+d)/n*b*c/n + (b+c)/n*a*d/n) as ps, sum((b+c)/n*b*c/n) as qs from v group by 1),
 w as (select *, 1.959963984540054 * sqrt(pr/(2*r*r) + ps/(2*r*t) + qs/(2*t*t)) as half, df*df/va as x, sqrt(df*df/va/2) as y from s),
 e as (select block_id, sum(exp((k*ln(2.0) + (2*k+1)*ln(y) - y*y) - (lgamma(2*k+2) - k*ln(2.0) - lgamma(k+1)))) as series from (select block_id, y, unnest(range(0, 400)) as k from w) group by block_id)
 select block_id, strata, informative_strata, concordant_strata, round(r/t, 6) as pooled_odds_ratio, round(exp(ln(r/t) - half), 6) as ci_lower, round(exp(ln(r/t) + half), 6) as ci_upper,
   round(x, 6) as statistic, case when x > 100 then 0.0::double else round(greatest(0.0, 1 - 2/sqrt(pi()) * series), 6) end as p_value from w join e using (block_id)""",
)
def mh_strata(t: Tables) -> DataFrame:
    gaps = association.stratum_gaps(association.complete_strata(_strata(t), "source"), F.col("second_expected"))
    pooled = association.mantel_haenszel(gaps, ["block_id"], F.col("second_expected"))
    names = ("pooled_odds_ratio", "ci_lower", "ci_upper", "statistic", "p_value")
    return pooled.withColumns({c: F.round(c, 6) for c in names})


_LOO_SQL = (
    _STRATA_SQL
    + f""", tt as (select block_id, sum(n1)::bigint as n1, sum(x1)::bigint as x1, sum(n2)::bigint as n2, sum(x2)::bigint as x2 from st group by 1),
 l as (select s.block_id, s.second_expected, s.source, t.n1 - s.n1 as n1, t.x1 - s.x1 as x1, t.n2 - s.n2 as n2, t.x2 - s.x2 as x2 from st s join tt t using (block_id) where source <> ''),
 o as (select block_id, source as omitted_stratum, n1 as remaining_first, n2 as remaining_second, {_GAP_SQL} as expected_gap from l)
"""
)


@query(
    "leave_one_out",
    _LOO_SQL
    + "select block_id, omitted_stratum, remaining_first, remaining_second, round(expected_gap, 6) as expected_gap, expected_gap > 0 as direction_retained from o",
)
def leave_one_out(t: Tables) -> DataFrame:
    out = association.leave_one_out(_strata(t), ["block_id", "second_expected"], "source", F.col("second_expected"))
    return out.drop("second_expected").withColumn("expected_gap", F.round("expected_gap", 6))


@query(
    "robustness",
    _LOO_SQL
    + """select block_id, count(distinct omitted_stratum) as omitted_strata, bool_and(expected_gap > 0) as all_retain_direction,
   round(min(expected_gap), 6) as minimum_gap, round(max(expected_gap), 6) as maximum_gap from o group by 1""",
)
def robustness(t: Tables) -> DataFrame:
    left_out = association.leave_one_out(_strata(t), ["block_id", "second_expected"], "source", F.col("second_expected"))
    return association.robustness(left_out, ["block_id"]).withColumns(
        {"minimum_gap": F.round("minimum_gap", 6), "maximum_gap": F.round("maximum_gap", 6)}
    )
