"""Seeded windows, exact samples, blends, the design grid and mate pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.functions import text as tx
from cohortloom.functions.hashing import label_of
from cohortloom.operators import intervals, joins, sampling, skew, sweep
from cohortloom.plans.registry import Tables, query
from cohortloom.session import cut_lineage

_SEEDS = [101, 202, 303]
_HASH = "('0x' || substr(sha256({0}), 1, 15))::bigint"

_WINDOW_SQL = f"""
with p as (select doc_id, source, row_number() over (partition by source order by doc_id) - 1 as position from documents),
tot as (select source, count(*) as total from p group by 1),
man as (select source, seed::bigint as seed, total as total_source_rows, (total // 2)::bigint as window_rows,
   {_HASH.format("source || ':' || seed || ':nested-depth-window'")} % (total - total // 2 + 1) as window_start from tot, (select unnest([101, 202, 303]) as seed))
"""


def _positions(t: Tables) -> DataFrame:
    return skew.dense_position(t.documents.select("doc_id", "source"), ["source"], "doc_id")


def _manifest(t: Tables) -> DataFrame:
    totals = sampling.source_totals(t.documents, "source")
    half = F.floor(F.col("total_source_rows") / 2)
    return sampling.window_manifest(totals, "source", _SEEDS, half, fv.NESTED_WINDOW_LABEL)


@query("window_manifest", _WINDOW_SQL + "select * from man")
def window_manifest(t: Tables) -> DataFrame:
    return _manifest(t)


@query(
    "seeded_window",
    _WINDOW_SQL
    + """select doc_id, p.source, position, seed, position - window_start as window_offset from p join man on man.source = p.source
      and position >= window_start and position < window_start + window_rows""",
)
def seeded_window(t: Tables) -> DataFrame:
    return sampling.take_windows(_positions(t), _manifest(t), "source", "position")


@query(
    "nested_tiers",
    _WINDOW_SQL
    + """select source, seed, d::bigint as depth, count(*) as rows, sum(doc_id)::bigint as id_sum from
      (select doc_id, p.source, seed, position - window_start as o from p join man on man.source = p.source and position >= window_start and position < window_start + window_rows),
      (select unnest([5, 10, 20]) as d) where o < d group by 1, 2, 3""",
)
def nested_tiers(t: Tables) -> DataFrame:
    windowed = sampling.take_windows(_positions(t), _manifest(t), "source", "position")
    return sampling.nested_tiers(windowed, [5, 10, 20]).groupBy("source", "seed", "depth").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("doc_id").alias("id_sum")
    )


@query(
    "window_union",
    _WINDOW_SQL
    + """, cov as (select distinct source, unnest(range(window_start, window_start + window_rows)) as x from man)
    select source, 3::bigint as intervals, (select sum(window_rows)::bigint from man m where m.source = cov.source) as nominal_length, count(*) as union_length,
      round(count(*)::double / (select sum(window_rows) from man m where m.source = cov.source), 6) as unique_fraction from cov group by source""",
)
def window_union(t: Tables) -> DataFrame:
    """Unique share of the overlapping technical windows of each source."""
    spans = _manifest(t).select("source", F.col("window_start").alias("start"), (F.col("window_start") + F.col("window_rows")).alias("end"))
    return intervals.covered_fraction(spans, ["source"], "start", "end").withColumn("unique_fraction", F.round("unique_fraction", 6))


@query(
    "union_pool",
    _WINDOW_SQL
    + f""", own as (select doc_id, p.source, position, min(seed) as owner from p join man on man.source = p.source and position >= window_start and position < window_start + window_rows group by 1, 2, 3),
    r as (select *, row_number() over (partition by source order by {_HASH.format("source || ':union_pool:404:' || doc_id")}, doc_id) as rn, count(*) over (partition by source) as n from own)
    select doc_id, source, position, owner from r where rn <= n // 2""",
)
def union_pool(t: Tables) -> DataFrame:
    """Half of the unique rows under all windows of a source, each owned by its earliest seed."""
    spans = _manifest(t).select("source", "seed", F.col("window_start").alias("start"), (F.col("window_start") + F.col("window_rows")).alias("end"))
    owners = intervals.own_by_precedence(spans, ["source"], "seed").withColumnRenamed("seed", "owner")
    held = cut_lineage(intervals.locate_points(_positions(t), owners, ["source"], "position", ["owner"]))
    sizes = sampling.source_totals(held, "source").select("source", F.floor(F.col("total_source_rows") / 2).alias("sample_rows"))
    return sampling.exact_sample(held, sizes, "source", "doc_id", label_of(F.col("source"), "union_pool", fv.POOL_SEED, F.col("doc_id")))


@query(
    "exact_sample",
    f"""with r as (select doc_id, lang, row_number() over (partition by lang order by {_HASH.format("'pick:' || doc_id")}, doc_id) as rn, count(*) over (partition by lang) as n from documents)
    select doc_id, lang from r where rn <= n // 4""",
)
def exact_sample(t: Tables) -> DataFrame:
    documents = t.documents.select("doc_id", "lang")
    sizes = sampling.source_totals(documents, "lang").select("lang", F.floor(F.col("total_source_rows") / 4).alias("sample_rows"))
    return sampling.exact_sample(documents, sizes, "lang", "doc_id", label_of("pick", F.col("doc_id")))


@query(
    "blend",
    f"""with t as (select count(*) as total from documents where lang = 'de'), m as (select round_even(total * 20 / 100.0, 0)::bigint as minor, total from t),
    r as (select doc_id, lang, row_number() over (partition by lang order by {_HASH.format("'blend:' || lang || ':' || doc_id")}, doc_id) as rn from documents where lang in ('en', 'de'))
    select doc_id, lang, case lang when 'en' then 'MAJOR_en' else 'MINOR_de' end as origin, '@' || case lang when 'en' then 'MAJOR_en' else 'MINOR_de' end || '|doc' || doc_id as record_name
    from r, m where rn <= case lang when 'en' then total - minor else minor end""",
)
def blend(t: Tables) -> DataFrame:
    """A mixture of two languages at 20 percent minor, exact counts, rows tagged by origin."""
    documents = t.documents.select("doc_id", "lang").filter(F.col("lang").isin("en", "de"))
    total = documents.agg(F.count_if(F.col("lang") == "de").alias("n")).select("n").scalar()
    major, minor = sampling.blend_sizes(total, 20)
    sizes = documents.select("lang").distinct().withColumn("sample_rows", F.when(F.col("lang") == "en", major).otherwise(minor))
    chosen = sampling.exact_sample(documents, sizes, "lang", "doc_id", label_of("blend", F.col("lang"), F.col("doc_id")))
    origin = F.when(F.col("lang") == "en", F.lit("MAJOR_en")).otherwise(F.lit("MINOR_de"))
    return chosen.withColumn("origin", origin).withColumn(
        "record_name", tx.prefixed_name(F.col("origin"), F.concat(F.lit("@doc"), F.col("doc_id")))
    )


_GRID_SQL = """
with pairs as (select s_name as pair_id, s_name as left_source, n_name as right_source, r_name as pair_role, s_suppkey % 2 = 0 as all_depths from supplier
    join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey),
dir as (select pair_id, pair_role, all_depths, left_source as major, right_source as minor from pairs union all select pair_id, pair_role, all_depths, right_source, left_source from pairs),
cells as (select f as minor_percent, d as total_pairs from (select unnest([0, 10, 20])::bigint as f), (select unnest([1000000, 2000000, 4000000])::bigint as d)),
grid as (select format('{}__{}_major__{}_minor__p{:02d}__n{}__s{}', pair_id, major, minor, minor_percent, total_pairs, 202) as condition_id, pair_id, pair_role, major, minor, minor_percent, total_pairs,
   202::bigint as seed, case when not all_depths then 'all_pair_10_percent' when minor_percent = 10 and total_pairs = 2000000 then 'all_pair_10_percent_and_depth_sensitivity' else 'depth_sensitivity' end as design_role,
   case minor_percent when 0 then 'combined_negative' when 10 then 'auxiliary_or_primary_positive' else 'primary_positive' end as expected_rule
  from dir, cells where all_depths or (minor_percent = 10 and total_pairs = 2000000))
"""


def _grid(t: Tables) -> DataFrame:
    regions = t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    nations = joins.keep_known(t.nation, regions, ["n_regionkey"]).select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    pairs = joins.keep_known(t.supplier, nations, ["s_nationkey"]).select(
        F.col("s_name").alias("pair_id"), F.col("s_name").alias("left_source"), F.col("n_name").alias("right_source"),
        F.col("r_name").alias("pair_role"), (F.col("s_suppkey") % 2 == 0).alias("all_depths"),
    )
    return sweep.design_grid(pairs)


@query("design_grid", _GRID_SQL + "select * from grid where regexp_matches(condition_id, '__p(10|20)__')")
def design_grid(t: Tables) -> DataFrame:
    return sweep.choose_conditions(_grid(t), "__p(10|20)__")


@query(
    "deepest_need",
    _GRID_SQL
    + "select source, seed, max(total_pairs) as maximum_rows from (select major as source, seed, total_pairs from grid union all select minor, seed, total_pairs from grid) group by 1, 2",
)
def deepest_need(t: Tables) -> DataFrame:
    return sampling.deepest_need(_grid(t), ["major", "minor"], "total_pairs", "seed")


@query(
    "pair_mates",
    """with u as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as position, 'c' || conv_id || '.' || (turn // 2) as k from conversations where role = 'user'),
    a as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as position, 'c' || conv_id || '.' || ((turn - 1) // 2 + case when conv_id % 5 = 0 then 1 else 0 end) as k from conversations where role = 'assistant')
    select conv_id, position, u.k as first_key, a.k as second_key, case when u.k is null or a.k is null then 'missing_mate' when u.k <> a.k then 'key_mismatch' else 'paired' end as pair_status
    from u full join a using (conv_id, position)""",
)
def pair_mates(t: Tables) -> DataFrame:
    """User and assistant turns paired by position and key, with a verdict for every position."""

    def side(role: str, shift: int, mate: int) -> DataFrame:
        rows = t.conversations.filter(F.col("role") == role).select("conv_id", "turn")
        wrong = F.when((F.col("conv_id") % 5 == 0) & F.lit(mate == 2), 1).otherwise(0)  # keys of another turn
        name = F.format_string(f"c%d.%d/{mate} extra", "conv_id", F.floor((F.col("turn") - shift) / 2) + wrong)
        return skew.dense_position(rows, ["conv_id"], "turn").withColumn("key", tx.mate_key(name))

    return joins.pair_mates(side("user", 0, 1), side("assistant", 1, 2), ["conv_id", "position"], "key")
