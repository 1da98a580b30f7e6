"""Interval analyses: union, subtraction, ownership and overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.numeric import rounded
from cohortloom.operators import intervals, quantiles
from cohortloom.plans.registry import Tables, query


def _shipments(t: Tables) -> DataFrame:
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return t.lineitem.select(
        "l_suppkey", start.alias("start"), (start + F.col("l_quantity").cast("bigint")).alias("end")
    )


_SHIPMENTS_SQL = """
with s as (select l_suppkey, date_diff('day', date '1970-01-01', l_shipdate::date)::bigint as s,
             (date_diff('day', date '1970-01-01', l_shipdate::date) + l_quantity::bigint)::bigint as e from lineitem),
m as (select *, max(e) over (partition by l_suppkey order by s, e rows between unbounded preceding and 1 preceding) as reached from s),
g as (select *, sum(case when reached is null or s > reached then 1 else 0 end)
        over (partition by l_suppkey order by s, e rows unbounded preceding) as island from m),
islands as (select l_suppkey, min(s) as "start", max(e) as "end" from g group by l_suppkey, island)
"""


@query("interval_union", _SHIPMENTS_SQL + 'select l_suppkey, "start", "end" from islands')
def interval_union(t: Tables) -> DataFrame:
    return intervals.merge_intervals(_shipments(t), ["l_suppkey"], width=512)


@query(
    "interval_cover",
    _SHIPMENTS_SQL
    + """select n.l_suppkey, n.intervals, n.nominal_length, u.union_length,
      round(u.union_length / n.nominal_length, 6) as unique_fraction
    from (select l_suppkey, count(*) as intervals, sum(e - s)::bigint as nominal_length from s group by 1) n
    join (select l_suppkey, sum("end" - "start")::bigint as union_length from islands group by 1) u using (l_suppkey)""",
)
def interval_cover(t: Tables) -> DataFrame:
    return intervals.covered_fraction(_shipments(t), ["l_suppkey"], "start", "end").withColumn(
        "unique_fraction", rounded("unique_fraction", 6)
    )


def minute_of(ts: str):
    """Whole minutes since 2024-01-01."""
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))
    return F.floor(seconds / 60).cast("bigint")


def _visits(t: Tables) -> DataFrame:
    start = minute_of("ts")
    return t.events.select(
        "event_id",
        "user_id",
        "event_type",
        start.alias("start"),
        (start + 60 + F.floor(F.col("value") * 10).cast("bigint")).alias("end"),
    )


_VISITS_SQL = """
with v as (select event_id, user_id, event_type,
    floor(date_diff('second', timestamp '2024-01-01', date_trunc('second', ts)) / 60)::bigint as s,
    (floor(date_diff('second', timestamp '2024-01-01', date_trunc('second', ts)) / 60) + 60 + floor(value * 10))::bigint as e
  from events),
"""
_PIECES_SQL = (
    _VISITS_SQL
    + """
cuts as (select distinct user_id, c from (select user_id, s as c from v union all select user_id, e from v)),
el as (select user_id, c, lead(c) over (partition by user_id order by c) as d from cuts),
own as (select el.user_id, el.c, el.d, min(v.event_type) as event_type from el join v
          on v.user_id = el.user_id and v.s <= el.c and el.c < v.e where el.d is not null group by 1,2,3),
j as (select *, lag(d) over (partition by user_id, event_type order by c) as pd from own),
k as (select *, sum(case when pd is null or pd < c then 1 else 0 end) over (partition by user_id, event_type order by c rows unbounded preceding) as isl from j),
pieces as (select user_id, event_type, min(c) as "start", max(d) as "end" from k group by user_id, event_type, isl)
"""
)


@query("interval_subtract", _PIECES_SQL + 'select user_id, event_type, "start", "end" from pieces')
def interval_subtract(t: Tables) -> DataFrame:
    """Each minute of a user belongs to the first event type that covers it."""
    return intervals.own_by_precedence(_visits(t), ["user_id"], "event_type", width=4096)


@query(
    "point_ownership",
    _PIECES_SQL
    + """select v.event_id, v.user_id, v.s as point, p.event_type as owner, p."start" as owner_start
      from v join pieces p on p.user_id = v.user_id and p."start" <= v.s and v.s < p."end" """,
)
def point_ownership(t: Tables) -> DataFrame:
    visits = _visits(t)
    owners = intervals.own_by_precedence(visits, ["user_id"], "event_type", width=4096).withColumns(
        {"owner": F.col("event_type"), "owner_start": F.col("start")}
    )
    points = visits.select("event_id", "user_id", F.col("start").alias("point"))
    return intervals.locate_points(points, owners, ["user_id"], "point", ["owner", "owner_start"], width=4096)


@query(
    "interval_minus",
    _VISITS_SQL
    + """
b as (select *, 1 as side from v where event_type = 'purchase' union all select *, 0 from v where event_type = 'error'),
cuts as (select distinct user_id, c from (select user_id, s as c from b union all select user_id, e from b)),
el as (select user_id, c, lead(c) over (partition by user_id order by c) as d from cuts),
own as (select el.user_id, c, d from el where d is not null
   and exists (select 1 from b where b.user_id = el.user_id and side = 1 and s <= c and c < e)
   and not exists (select 1 from b where b.user_id = el.user_id and side = 0 and s <= c and c < e)),
j as (select *, lag(d) over (partition by user_id order by c) as pd from own),
k as (select *, sum(case when pd is null or pd < c then 1 else 0 end) over (partition by user_id order by c rows unbounded preceding) as isl from j)
select user_id, min(c) as "start", max(d) as "end" from k group by user_id, isl""",
)
def interval_minus(t: Tables) -> DataFrame:
    visits = _visits(t)
    return intervals.subtract_intervals(
        visits.filter("event_type = 'purchase'"), visits.filter("event_type = 'error'"), ["user_id"], width=4096
    )


_PAIRS_SQL = (
    _VISITS_SQL.replace("with v as", "with v0 as")
    + """v as (select * from v0 union all select event_id + 1000000000, user_id, event_type, s, e from v0 where event_type = 'signup'),
p as (select a.user_id, a.event_type, a.event_id as id_a, b.event_id as id_b, a.s as start_a, a.e as end_a, b.s as start_b, b.e as end_b,
   least(a.e, b.e) - greatest(a.s, b.s) as overlap,
   (least(a.e, b.e) - greatest(a.s, b.s))::double / least(a.e - a.s, b.e - b.s) as overlap_fraction
 from v a join v b on a.user_id = b.user_id and a.event_type = b.event_type and a.event_id < b.event_id and a.s < b.e and b.s < a.e)
"""
)


def _doubled(t: Tables) -> DataFrame:
    """Visits, with every signup once more under another id, so that equal intervals occur."""
    visits = _visits(t)
    return visits.unionByName(visits.filter("event_type = 'signup'").withColumn("event_id", F.col("event_id") + 1000000000))


def _pairs(t: Tables) -> DataFrame:
    return intervals.overlapping_pairs(_doubled(t), ["user_id", "event_type"], "event_id", width=1024)


@query(
    "pairwise_overlap",
    _PAIRS_SQL
    + """select user_id, event_type, least(la.id, lb.id) as id_a, greatest(la.id, lb.id) as id_b,
   case when la.id <= lb.id then start_a else start_b end as start_a, case when la.id <= lb.id then end_a else end_b end as end_a,
   case when la.id <= lb.id then start_b else start_a end as start_b, case when la.id <= lb.id then end_b else end_a end as end_b,
   overlap, round(overlap_fraction, 6) as overlap_fraction, count(*) as pairs from p
   join (select user_id, event_type, s, e, min(event_id) as id from v group by 1, 2, 3, 4) la using (user_id, event_type)
   join (select user_id, event_type, s, e, min(event_id) as id from v group by 1, 2, 3, 4) lb using (user_id, event_type)
   where la.s = start_a and la.e = end_a and lb.s = start_b and lb.e = end_b group by all""",
)
def pairwise_overlap(t: Tables) -> DataFrame:
    return _pairs(t).withColumn("overlap_fraction", F.round("overlap_fraction", 6))


@query(
    "overlap_summary",
    _PAIRS_SQL
    + """, n as (select user_id, event_type, count(*) as intervals from v group by 1, 2),
f as (select user_id, event_type, count(*) as op, sum(overlap_fraction) as sf, min(overlap_fraction) as mn, max(overlap_fraction) as mx from p group by 1, 2)
select n.user_id, n.event_type, n.intervals, coalesce(op, 0) as overlapping_pairs, (n.intervals * (n.intervals - 1) // 2)::bigint as pairs,
  case when n.intervals > 1 then round(coalesce(sf, 0.0) / (n.intervals * (n.intervals - 1) // 2), 6) end as mean_overlap_fraction,
  case when n.intervals < 2 then null when coalesce(op, 0) < n.intervals * (n.intervals - 1) // 2 then 0.0::double else round(mn, 6) end as minimum_overlap_fraction,
  case when n.intervals > 1 then round(coalesce(mx, 0.0), 6) end as maximum_overlap_fraction
from n left join f using (user_id, event_type)""",
)
def overlap_summary(t: Tables) -> DataFrame:
    out = intervals.overlap_summary(_doubled(t), ["user_id", "event_type"], _pairs(t))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.endswith("_fraction")})


@query(
    "overlap_report",
    _PAIRS_SQL
    + """select event_type, count(*) as n, round(avg(overlap_fraction), 6) as mean, round(quantile_cont(overlap_fraction, 0.5), 6) as median,
      round(min(overlap_fraction), 6) as minimum, round(max(overlap_fraction), 6) as maximum from p group by event_type""",
)
def overlap_report(t: Tables) -> DataFrame:
    pairs = _pairs(t).select("event_type", "overlap_fraction", "pairs")
    stats = pairs.groupBy("event_type").agg(
        F.sum("pairs").alias("n"),
        F.try_divide(F.sum(F.col("overlap_fraction") * F.col("pairs")), F.sum("pairs")).alias("mean"),
        F.min("overlap_fraction").alias("minimum"),
        F.max("overlap_fraction").alias("maximum"),
    )
    out = stats.join(quantiles.middle_median(pairs, ["event_type"], "overlap_fraction", weight="pairs"), "event_type")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "minimum", "maximum")})
