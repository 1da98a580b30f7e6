"""Features that occur and lie together: modules, spans, similar pairs, edges and components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.text import joined_labels, split_numeric_suffix
from cohortloom.operators import graph, modules, reshape
from cohortloom.plans.interval_plans import minute_of
from cohortloom.plans.registry import Tables, query
from cohortloom.session import cut_lineage

_EVENT_SQL = """
with ev as (select event_id, user_id, event_type, floor(date_diff('second', timestamp '2024-01-01', date_trunc('second', ts)) / 60)::bigint as minute from events),
"""


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "event_type", minute_of("ts").alias("minute"))


@query(
    "presence_pivot",
    """with o as (select user_id, event_type, (count(*) >= 12)::int as present from events group by 1, 2)
    select c_custkey, c_mktsegment, coalesce(max(present) filter (where event_type = 'click'), 0)::bigint as click,
      coalesce(max(present) filter (where event_type = 'error'), 0)::bigint as error, coalesce(max(present) filter (where event_type = 'purchase'), 0)::bigint as purchase,
      coalesce(max(present) filter (where event_type = 'signup'), 0)::bigint as signup, coalesce(max(present) filter (where event_type = 'view'), 0)::bigint as view
    from customer left join o on o.user_id = c_custkey group by 1, 2""",
)
def presence_pivot(t: Tables) -> DataFrame:
    """0/1 matrix of entities by known blocks; entities without any event are rows of zeros."""
    observed = t.events.groupBy(F.col("user_id").alias("c_custkey"), "event_type").agg(
        (F.count(F.lit(1)) >= 12).alias("present")
    )
    entities = t.customer.select("c_custkey", "c_mktsegment")
    matrix = reshape.presence_matrix(entities, observed, "c_custkey", "event_type", "present", ["click", "error", "purchase", "signup", "view"])
    return reshape.preferred_first(matrix, ["c_mktsegment", "c_custkey"])


@query(
    "joined_labels",
    """select user_id, string_agg(distinct event_type, ';' order by event_type) as types from events group by user_id""",
)
def joined_labels_query(t: Tables) -> DataFrame:
    """Sorted, joined labels of a small vocabulary per key."""
    return t.events.groupBy("user_id").agg(joined_labels("event_type").alias("types"))


def _type_bands(t: Tables) -> DataFrame:
    """Coarse (direction, feature, entity) presence with many identical entity sets."""
    lines = t.lineitem.select(
        F.col("l_returnflag").alias("direction"),
        F.format_string("%s%02d", "l_linestatus", F.col("l_quantity").cast("int")).alias("feature"),
        F.col("l_suppkey").alias("entity"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("bigint").alias("position"),
    )
    return lines.withColumn("entity", F.col("entity") % 40)


_BANDS_SQL = """
with b as (select l_returnflag as direction, l_linestatus || lpad(l_quantity::int::varchar, 2, '0') as feature, l_suppkey % 40 as entity,
    date_diff('day', date '1992-01-01', l_shipdate::date)::bigint as position from lineitem),
sets as (select direction, feature, list(distinct entity order by entity) as members, count(distinct entity) as set_size from b group by 1, 2),
g as (select direction, members, set_size, count(*) as features, min(feature) as leader from sets group by 1, 2, 3 having count(*) >= 2),
n as (select *, direction || '_module_' || lpad(row_number() over (partition by direction order by features desc, leader)::varchar, 2, '0') as module from g),
mem as (select n.direction, n.module, n.leader, n.features, n.set_size, s.feature from n join sets s on s.direction = n.direction and s.members = n.members)
"""


def _modules(t: Tables) -> tuple[DataFrame, DataFrame]:
    bands = _type_bands(t)
    members = modules.identical_set_groups(bands.select("direction", "feature", "entity").distinct(), "feature", "entity", "direction")
    leaders = members.groupBy("direction", "leader").agg(F.max("features").alias("features"))
    named = modules.numbered_names(leaders, "direction", "features", "leader", "module", "%s_module_%02d")
    return bands, members.join(named.select("direction", "leader", "module"), ["direction", "leader"])


@query("signature_modules", _BANDS_SQL + "select direction, module, leader, features, set_size, feature from mem")
def signature_modules(t: Tables) -> DataFrame:
    """Members of every group of features with one and the same entity set."""
    return _modules(t)[1].select("direction", "module", "leader", "features", "set_size", "feature")


@query(
    "module_compactness",
    _BANDS_SQL
    + """, low as (select mem.module, mem.features, b.entity, b.feature, min(position) as pos from mem join b on b.direction = mem.direction and b.feature = mem.feature group by 1, 2, 3, 4),
e as (select module, features, entity, count(*) as placed, max(pos) - min(pos) + 1 as span from low group by 1, 2, 3),
z as (select * from e where placed = features)
select m.module, m.features, count(z.entity) as complete_entities, count(*) filter (where z.span <= m.features + 60) as compact_entities,
  coalesce(max(z.span), 0) as maximum_span, round(coalesce(count(*) filter (where z.span <= m.features + 60) / nullif(count(z.entity), 0), 0), 6) as compact_fraction
from (select distinct module, features from mem) m left join z on z.module = m.module group by 1, 2""",
)
def module_compactness(t: Tables) -> DataFrame:
    """How tightly the members of a module lie in each entity."""
    bands, members = _modules(t)
    keyed = members.select("module", F.concat_ws("/", "direction", "feature").alias("feature"))
    placed = bands.select(F.concat_ws("/", "direction", "feature").alias("feature"), "entity", "position")
    out = modules.module_compactness(keyed, placed, "module", "feature", "entity", "position", slack=60)
    return out.withColumn("compact_fraction", F.round("compact_fraction", 6))


_BLOCKS = {"trio": ["click", "purchase", "view"], "pair": ["error", "signup"], "single": ["view"]}


def _block_tables(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Curated blocks and their members are literals spread over the event types found in the data."""
    types = t.events.select("event_type").distinct()
    membership = F.array(
        *[F.struct(F.lit(b).alias("block"), F.lit(m).alias("m")) for b, ms in _BLOCKS.items() for m in ms]
    )
    members = (
        types.withColumn("_b", F.explode(membership))
        .filter(F.col("_b.m") == F.col("event_type"))
        .select(F.col("_b.block").alias("block"), F.col("event_type").alias("feature"))
    )
    blocks = members.select("block").distinct().withColumn("allowed", F.when(F.col("block") == "trio", 600).otherwise(240))
    e = _events(t)
    name = F.concat_ws("_", F.col("user_id"), F.format_string("w%d", F.floor(F.col("minute") / 10080)), F.col("minute"))
    container, index = split_numeric_suffix("name")
    hits = e.withColumn("name", name).select(
        F.col("event_type").alias("feature"), F.col("user_id").alias("entity"), container.alias("container"), index.alias("position")
    )
    return blocks, members, hits


_SPAN_SQL = (
    _EVENT_SQL
    + """h as (select user_id as entity, minute // 10080 as container, event_type as feature, minute as position from ev),
trio as (select a.entity, min(greatest(a.position, b.position, c.position) - least(a.position, b.position, c.position) + 1) as span
  from h a join h b using (entity, container) join h c using (entity, container) where a.feature = 'click' and b.feature = 'purchase' and c.feature = 'view' group by 1),
pair as (select a.entity, min(greatest(a.position, b.position) - least(a.position, b.position) + 1) as span
  from h a join h b using (entity, container) where a.feature = 'error' and b.feature = 'signup' group by 1),
spans as (select 'trio' as block, * from trio union all select 'pair', * from pair union all select 'single', entity, 1::bigint from h where feature = 'view' group by entity)
"""
)


@query("cover_span", _SPAN_SQL + "select block, entity, span as minimum_span from spans")
def cover_span(t: Tables) -> DataFrame:
    _, members, hits = _block_tables(t)
    return modules.covering_spans(hits, members, "block", "feature", "entity", "container", "position", width=2048)


_CALL_SQL = (
    _SPAN_SQL
    + """, bl as (select * from (values ('trio', 3, 600), ('pair', 2, 240), ('single', 1, 240)) v(block, need, allowed)),
mem as (select * from (values ('trio','click'), ('trio','purchase'), ('trio','view'), ('pair','error'), ('pair','signup'), ('single','view')) v(block, feature)),
seen as (select block, entity, count(distinct h.feature) as n from h join mem using (feature) group by 1, 2),
calls as (select bl.block, seen.entity, need::bigint as required_features, allowed::bigint as maximum_allowed_span, n as observed_features, s.span as minimum_span,
  n = need as all_features_present, s.span is not null as one_container, coalesce(s.span <= allowed, false) as block_present
from seen join bl on seen.block = bl.block left join spans s on s.block = bl.block and s.entity = seen.entity)
"""
)


def _block_calls(t: Tables) -> tuple[DataFrame, DataFrame]:
    blocks, members, hits = _block_tables(t)
    return blocks, modules.block_calls(blocks, members, hits, "block", "feature", "entity", "container", "position", "allowed")


@query("block_calls", _CALL_SQL + "select * from calls")
def block_calls(t: Tables) -> DataFrame:
    """Every block for every entity that shows any of its features."""
    return _block_calls(t)[1]


@query(
    "block_grid",
    _CALL_SQL
    + """select bl.block, u.user_id as entity, need::bigint as required_features, allowed::bigint as maximum_allowed_span, coalesce(observed_features, 0) as observed_features, minimum_span,
    coalesce(all_features_present, false) as all_features_present, coalesce(one_container, false) as one_container, coalesce(block_present, false) as block_present
    from bl cross join (select distinct user_id from events) u left join calls c on c.block = bl.block and c.entity = u.user_id""",
)
def block_grid(t: Tables) -> DataFrame:
    """Every block for every entity, absences as rows."""
    blocks, members, _ = _block_tables(t)
    return modules.block_grid(_block_calls(t)[1], blocks, members, t.events.select(F.col("user_id").alias("entity")), "block", "feature", "entity", "allowed")


@query(
    "block_totals",
    _CALL_SQL
    + """select bl.block, count(*) filter (where block_present) as present, (select count(*) from (select distinct user_id from events)) - count(*) filter (where block_present) as absent,
    (select count(*) from (select distinct user_id from events)) as entities from bl left join calls using (block) group by 1""",
)
def block_totals(t: Tables) -> DataFrame:
    """Present and absent entities of every block."""
    blocks, calls = _block_calls(t)
    return modules.block_totals(blocks, calls, t.events.select("user_id").distinct(), "block")


_HOURS_SQL = (
    _EVENT_SQL
    + """p0 as (select event_type as direction, event_type || '_' || lpad(((minute // 60) % 24)::varchar, 2, '0') as feature, user_id, (minute // 60)::bigint as position from ev),
pl as (select * from p0 union all select direction, feature || '_copy', user_id, position from p0 where feature like '%_07'),
pr as (select distinct direction, feature, user_id from pl),
sz as (select direction, feature, count(*) as n from pr group by 1, 2),
sh as (select a.direction, a.feature as feature_a, b.feature as feature_b, count(*) as shared from pr a join pr b on a.direction = b.direction and a.user_id = b.user_id and a.feature < b.feature group by 1, 2, 3),
sim as (select sh.*, x.n as size_a, y.n as size_b, shared::double / (x.n + y.n - shared) as jaccard from sh join sz x on x.feature = feature_a join sz y on y.feature = feature_b)
"""
)


def _hour_features(t: Tables) -> DataFrame:
    """Hours of the day by type as features; the seventh hour also goes by a second name, so identical sets occur."""
    hour = F.floor(F.col("minute") / 60).cast("bigint")
    name = F.format_string("%s_%02d", "event_type", hour % 24)
    names = F.when(hour % 24 == 7, F.array(name, F.concat(name, F.lit("_copy")))).otherwise(F.array(name))
    return _events(t).select(F.col("event_type").alias("direction"), F.explode(names).alias("feature"), "user_id", hour.alias("position"))


@query(
    "similar_pairs",
    _HOURS_SQL
    + """, st as (select direction, feature, list(user_id order by user_id) as us from pr group by 1, 2),
ld as (select direction, feature, min(feature) over (partition by direction, us) as leader from st)
select sim.direction, feature_a, feature_b, size_a, size_b, shared, round(jaccard, 6) as jaccard, shared = size_a and size_a = size_b as identical from sim
  join ld la on la.feature = feature_a join ld lb on lb.feature = feature_b
where shared >= 10 and jaccard >= 0.30 and la.leader = feature_a and (lb.leader = feature_b or lb.leader = feature_a)""",
)
def similar_pairs(t: Tables) -> DataFrame:
    presence = _hour_features(t).select("direction", "feature", "user_id").distinct()
    out = modules.similar_pairs(presence, "feature", "user_id", "direction", min_shared=10, min_jaccard=0.30)
    return out.withColumn("jaccard", F.round("jaccard", 6))


_EDGES_SQL = (
    _HOURS_SQL
    + """, ad as (select a.direction, a.feature as feature_a, b.feature as feature_b, a.user_id, min(abs(a.position - b.position)) as gap
    from pl a join pl b on a.direction = b.direction and a.user_id = b.user_id and a.feature < b.feature group by 1, 2, 3, 4),
edges as (select sim.direction, sim.feature_a, sim.feature_b, shared, jaccard, count(*) as placed, count(*) filter (where gap <= 60) as adjacent,
     count(*) filter (where gap <= 60)::double / count(*) as adjacency_fraction from sim join ad using (direction, feature_a, feature_b)
   where shared >= 10 and jaccard >= 0.28 group by 1, 2, 3, 4, 5 having count(*) filter (where gap <= 60)::double / count(*) >= 0.30)
"""
)


def _edges(t: Tables) -> DataFrame:
    edges = modules.near_edges(
        _hour_features(t), "feature", "user_id", "direction", "position", max_distance=60, min_shared=10, min_jaccard=0.28,
        min_adjacency=0.30,
    )
    return cut_lineage(edges)


@query(
    "near_edges",
    _EDGES_SQL
    + "select direction, feature_a, feature_b, shared, round(jaccard, 6) as jaccard, placed, adjacent, round(adjacency_fraction, 6) as adjacency_fraction from edges",
)
def near_edges(t: Tables) -> DataFrame:
    return _edges(t).withColumns(
        {"jaccard": F.round("jaccard", 6), "adjacency_fraction": F.round("adjacency_fraction", 6)}
    )


_COMPONENT_SQL = (
    _EDGES_SQL.replace("with ev as", "with recursive ev as", 1)
    + """, links as (select feature_a as a, feature_b as b from edges union all select feature_b, feature_a from edges),
walk(node, reach) as (select distinct a, a from links union select w.node, links.b from walk w join links on links.a = w.reach),
lab as (select node, min(reach) as component from walk group by 1)
"""
)


@query("components", _COMPONENT_SQL + "select node, component from lab")
def components(t: Tables) -> DataFrame:
    return graph.connected_components(_edges(t), "feature_a", "feature_b")


@query(
    "component_summary",
    _COMPONENT_SQL
    + """, szs as (select component, count(*) as features from lab group by 1),
inn as (select component, min(direction) as direction, count(*) as edges, min(jaccard) as minimum_jaccard, min(adjacency_fraction) as minimum_adjacency from edges join lab on node = feature_a group by 1),
cov as (select component, user_id, count(*) as have from pr join lab on node = feature group by 1, 2),
com as (select component, count(*) as complete_entities from cov join szs using (component) where have = features group by 1)
select component, features, direction, edges, round(minimum_jaccard, 6) as minimum_jaccard, round(minimum_adjacency, 6) as minimum_adjacency, coalesce(complete_entities, 0) as complete_entities,
  direction || '_component_' || lpad(row_number() over (partition by direction order by features desc, component)::varchar, 2, '0') as component_name
from szs join inn using (component) left join com using (component)""",
)
def component_summary(t: Tables) -> DataFrame:
    edges = _edges(t)
    labels = graph.connected_components(edges, "feature_a", "feature_b")
    presence = _hour_features(t).select("feature", "user_id")
    out = graph.component_summary(edges, labels, presence, "feature", "user_id", "direction")
    return out.withColumns({"minimum_jaccard": F.round("minimum_jaccard", 6), "minimum_adjacency": F.round("minimum_adjacency", 6)})
