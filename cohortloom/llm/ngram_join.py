"""N-gram Jaccard self-join by chosen paths.

A document is the set of its five-word shingles. A run of the join descends a random tree: at a node
every set picks those of its shingles whose node hash lies under 1 / (stop * size), and follows one child
per picked shingle, so two sets meet in a child only through a shared sampled shingle. After ``DEPTH``
levels the sets of one leaf form a bucket. Runs repeat until a pair at the threshold, one set inside the other
included, meets with the target probability (``runs_for``). Buckets are compared pair by pair on fixed-size minimum sketches; buckets
of more than ``BLOCK`` sets are compared as pairs of blocks in separate tasks. Sets joined by likely pairs
form candidate groups, and inside a group all pairs are verified exactly on the whole shingle sets (again in
blocks), so links that the sampled tree missed are found there too. No pair is written out: a task gives each
set its number of links; a task on one block gives one edge to the root of each set, a task on two blocks edges between
the roots of the two blocks only, so edges grow with the sets of a group and not with its pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import textops as tx
from cohortloom.llm.components import root_links
from cohortloom.operators.graph import connected_components
from cohortloom.session import cut_lineage

WIDTH, THRESHOLD, TARGET_RECALL = 5, 0.8, 0.999
DEPTH, BLOCK, BINS = 4, 512, 128
#: Likely pairs: estimated similarity this far below the threshold (four deviations of the sketch).
SLACK = 0.16


def runs_for(threshold: float, recall: float, depth: int = DEPTH) -> int:
    """Runs until two sets of similarity ``threshold`` share a leaf with probability ``recall``, whatever their sizes.

    A shingle is picked by both sets at the rate of the larger one. The larger set holds at least ``threshold`` of its
    shingles in common with the other, and just that if it contains the other, so a level has shared / (threshold *
    size) >= 1 common children.
    """
    meet = 1.0
    for _ in range(depth):
        meet = 1 - np.exp(-meet)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - meet)))


def leaves(h: np.ndarray, row: np.ndarray, sizes: np.ndarray, runs: int, stop: float, depth: int = DEPTH):
    """(row, leaf) pairs: the leaves that each set reaches. ``h`` is sorted by row."""
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    limit = (np.float64(2**63) / (stop * np.maximum(sizes, 1))).clip(0, 2**63 - 1).astype(np.uint64)
    rows_out, leaf_out = [], []
    for run in range(runs):
        seed = tx.mix(np.array([run + 1], dtype=np.uint64))[0]
        who = np.flatnonzero(sizes > 0)
        node = np.full(len(who), seed, dtype=np.uint64)
        for level in range(depth):
            if level == 0:
                item, at, token = None, seed, h
            else:
                count = sizes[who]
                item = np.repeat(np.arange(len(who)), count)
                first = np.concatenate([[0], np.cumsum(count)])[:-1]
                token = h[np.arange(len(item)) - first[item] + begin[who][item]]
                at = node[item]
            draw = (token ^ at) * np.uint64(0x9E3779B97F4A7C15)
            draw ^= draw >> np.uint64(29)
            draw *= np.uint64(0xBF58476D1CE4E5B9)
            draw >>= np.uint64(1)
            owner = row if item is None else who[item]
            hit = np.flatnonzero(draw < limit[owner])
            node = tx.mix((node[0] if item is None and len(node) else node[item[hit]] if item is not None else node[:0]) + tx.mix(token[hit]))
            who = owner[hit]
            if not len(who):
                break
        else:
            rows_out.append(who)
            leaf_out.append(node)
    if not rows_out:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(rows_out), np.concatenate(leaf_out)


def sketches(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """One byte of the least hash in each of ``BINS`` bins; 0 marks an empty bin."""
    low = np.full((rows, BINS), np.iinfo(np.uint64).max, dtype=np.uint64)
    spread = tx.mix(h + np.uint64(77))
    np.minimum.at(low, (row, (spread % np.uint64(BINS)).astype(np.int64)), spread)
    out = (low >> np.uint64(16)).astype(np.uint8) | np.uint8(1)
    out[low == np.iinfo(np.uint64).max] = 0
    return out


def _features(runs: int, stop: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in tx.slices(batch.column("text")):
                rows = end - first
                h, row = tx.shingle_sets(data, offsets, width)
                sizes = np.bincount(row, minlength=rows)
                key = np.zeros((rows, 2), dtype=np.uint64)
                np.add.at(key[:, 0], row, tx.mix(h))
                np.add.at(key[:, 1], row, tx.mix(h ^ np.uint64(0x5851F42D4C957F2D)))
                who, leaf = leaves(h, row, sizes, runs, stop)
                order = np.argsort(who, kind="stable")
                per_row = np.bincount(who, minlength=rows)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)), pa.array(leaf[order].view(np.int64))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(first, rows), batch.column("mark").slice(first, rows), tx.as_binary(key.view(np.uint8)), pa.array(sizes.astype(np.int64)),
                        tx.as_binary(sketches(h, row, rows)), lists,
                    ],
                    ["doc", "mark", "set_id", "size", "sketch", "leaves"],
                )

    return run


def _group_bounds(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def _likely(threshold: float):
    least = threshold - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tx.whole_groups(batches, "bucket"):
            keys = table.column("bucket").to_numpy()
            ids = table.column("set_id").to_pylist()
            side = table.column("side").to_numpy()
            size = table.column("size").to_numpy()
            raw = b"".join(table.column("sketch").to_pylist())
            sketch = np.frombuffer(raw, dtype=np.uint8).reshape(-1, BINS)
            out_a: list[bytes] = []
            out_b: list[bytes] = []
            bounds = _group_bounds(keys)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                n = hi - lo
                part, weight, where = sketch[lo:hi], size[lo:hi], side[lo:hi]
                found_a, found_b = [], []
                for i in range(n - 1):
                    other = np.arange(i + 1, n)
                    small, large = np.minimum(weight[i], weight[other]), np.maximum(weight[i], weight[other])
                    other = other[small >= threshold * large]
                    if len(other):
                        used = (part[other] | part[i]) != 0
                        same = ((part[other] == part[i]) & used).sum(1)
                        other = other[same >= least * used.sum(1)]
                        found_a.append(np.full(len(other), i))
                        found_b.append(other)
                if found_a:
                    for i, j in zip(*root_links(n, np.concatenate(found_a), np.concatenate(found_b), where), strict=True):
                        out_a.append(ids[lo + i])
                        out_b.append(ids[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["a", "b"])

    return run


def in_block_pairs(df: DataFrame, group: str, count: str, member: str, block: int = BLOCK) -> DataFrame:
    """Deal the members of every group to tasks so that each pair of members meets in exactly one.

    A group of up to ``block`` members is one task (side 2). A larger one is cut into g parts by a hash
    of the member; a task holds one part (side 2) or two different parts (sides 0 and 1).
    """
    g = F.ceil(F.col(count) / F.lit(block)).cast("int")
    parts = df.withColumn("_g", g).withColumn("_own", F.pmod(F.xxhash64(F.col(member)), F.col("_g")).cast("int"))
    dealt = parts.withColumn("_peer", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    low, high = F.least("_own", "_peer"), F.greatest("_own", "_peer")
    return dealt.select(
        F.xxhash64(F.col(group), low, high).alias("bucket"),
        F.when(F.col("_own") == F.col("_peer"), 2).when(F.col("_own") < F.col("_peer"), 0).otherwise(1).alias("side"),
        *[c for c in df.columns],
    )


def _verify(threshold: float, width: int):
    def sets_of(column) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for first, end, data, offsets in tx.slices(column):
            h, row = tx.shingle_sets(data, offsets, width)
            cuts = np.cumsum(np.bincount(row, minlength=end - first))[:-1]
            out += np.split(h, cuts)
        return out

    def shared(members: list[np.ndarray]) -> np.ndarray:
        """Matrix of intersection sizes; shingles held by one member or by all are not multiplied out."""
        n = len(members)
        tokens = np.concatenate(members)
        owner = np.repeat(np.arange(n), [len(m) for m in members])
        _, token, held = np.unique(tokens, return_inverse=True, return_counts=True)
        out = np.full((n, n), float(np.count_nonzero(held == n)), dtype=np.float32)
        use = (held > 1) & (held < n)
        rank = np.cumsum(use) - 1
        keep = use[token]
        token, owner = rank[token[keep]], owner[keep]
        for low in range(0, int(use.sum()), 16384):
            pick = (token >= low) & (token < low + 16384)
            grid = np.zeros((n, min(16384, int(use.sum()) - low)), dtype=np.float32)
            grid[owner[pick], token[pick] - low] = 1
            out += grid @ grid.T
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tx.whole_groups(batches, "bucket"):
            bounds = _group_bounds(table.column("bucket").to_numpy())
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                part = table.slice(lo, hi - lo)
                once = np.unique(np.array(part.column("set_id").to_pylist(), dtype=object), return_index=True)[1]
                part = part.take(pa.array(np.sort(once))) if len(once) < hi - lo else part  # repeated input rows
                ids = part.column("set_id").to_pylist()
                side, docs = part.column("side").to_numpy(), part.column("docs").to_numpy()
                members = sets_of(part.column("text"))
                both = shared(members)
                size = np.array([len(m) for m in members], dtype=np.float32)
                linked = both >= np.float32(threshold - 1e-6) * (size[:, None] + size[None, :] - both)
                np.fill_diagonal(linked, False)
                root = np.arange(len(ids))
                node, to = root_links(len(ids), *np.nonzero(linked), side)
                root[node] = to
                linked &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.binary()), pa.array([ids[i] for i in root], pa.binary()),
                        pa.array((linked @ docs).astype(np.int64)),
                    ],
                    ["set_id", "root", "links"],
                )

    return run


def near_duplicates(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH,
    target_recall: float = TARGET_RECALL,
) -> DataFrame:
    """(id_col, class_id, n_links) per document: its group and how many other documents it is linked with.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least ``threshold``; words are
    lower-cased ASCII letters, digits and non-ASCII characters. A class is what links connect, named by its
    smallest id. Documents with the same set are folded before the join and counted back afterwards. A text of
    one to four words is one shingle of all its words. Texts without words (null, empty, punctuation) have no link
    and are their own class. Rows without an id cannot be named and are left out. Rows repeated with the same
    id give one row; one id with different texts gives a row per text. Further columns are ignored.
    """
    found = _classes(documents, id_col, text_col, threshold, width, target_recall).select("doc", "set_id", "class_id", "n_links").distinct()
    return found.select(F.col("doc").alias(id_col), "class_id", "n_links")


def _classes(documents: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, width: int = WIDTH, target_recall: float = TARGET_RECALL) -> DataFrame:
    """(doc, mark, set_id, class_id, class_mark, n_links) per id and text hash; the class is named by its smallest id and text hash."""
    docs = tx.bounded_batches(
        documents.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("mark")).filter("doc is not null")
    )
    runs = runs_for(threshold, target_recall)
    features = cut_lineage(
        docs.mapInArrow(_features(runs, threshold, width), "doc bigint, mark bigint, set_id binary, size bigint, sketch binary, leaves array<bigint>")
    )
    members = features.filter("size > 0").select("doc", "mark", "set_id").distinct()
    sets = cut_lineage(
        features.filter("size > 0").groupBy("set_id").agg(
            F.min(F.struct("doc", "mark")).alias("first"), F.countDistinct("doc").alias("docs"), F.first("size").alias("size"), F.first("sketch").alias("sketch"),
            F.first("leaves").alias("leaves"),
        ).select("set_id", F.col("first.doc").alias("rep"), "first.mark", "docs", "size", "sketch", "leaves")
    )
    reached = sets.select("set_id", F.explode(F.array_distinct("leaves")).alias("leaf"))
    shared = reached.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = reached.join(shared, "leaf").join(sets.select("set_id", "size", "sketch"), "set_id")
    dealt = tx.grouped_rows(in_block_pairs(met, "leaf", "n", "set_id").select("bucket", "side", "set_id", "size", "sketch"), "bucket", "set_id")
    likely = dealt.mapInArrow(_likely(threshold), "a binary, b binary").distinct()
    groups = connected_components(likely, "a", "b").withColumnsRenamed({"node": "set_id", "component": "grp"})
    counts = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    chosen = groups.join(counts, "grp").join(sets.select("set_id", "rep", "mark", "docs"), "set_id")
    texts = chosen.join(docs.withColumnRenamed("doc", "rep"), ["rep", "mark"])
    pairs = tx.grouped_rows(in_block_pairs(texts, "grp", "n", "set_id").select("bucket", "side", "set_id", "docs", "text"), "bucket", "set_id")
    local = cut_lineage(pairs.mapInArrow(_verify(threshold, width), "set_id binary, root binary, links bigint"))
    links = local.groupBy("set_id").agg(F.sum("links").alias("links"))
    rooted = connected_components(local.filter("set_id <> root"), "set_id", "root").withColumnsRenamed({"node": "set_id", "component": "root"})
    named = (
        sets.select("set_id", "rep", "mark", "docs")
        .join(rooted, "set_id", "left")
        .join(links, "set_id", "left")
        .withColumn("root", F.coalesce("root", "set_id"))
    )
    ids = named.groupBy("root").agg(F.min(F.struct("rep", "mark")).alias("least"))
    per_set = named.join(ids, "root").select(
        "set_id", F.col("least.rep").alias("class_id"), F.col("least.mark").alias("class_mark"), (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).cast("bigint").alias("n_links")
    )
    found = members.join(per_set, "set_id").select("doc", "mark", "set_id", "class_id", "class_mark", "n_links")
    alone = features.filter("size = 0").select("doc", "mark", "set_id", F.col("doc").alias("class_id"), F.col("mark").alias("class_mark"), F.lit(0).cast("bigint").alias("n_links"))
    return found.unionByName(alone.distinct())


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with one of each class: the one whose id and text name it. Rows without an id stay; of rows repeated with id and text one stays."""
    doc, mark = F.col(id_col).cast("bigint"), F.xxhash64(F.col(text_col))
    gone = _classes(documents, id_col, text_col).filter("doc <> class_id or mark <> class_mark").select("doc", "mark")
    rows = documents.select(F.struct("*").alias("row"), doc.alias("doc"), mark.alias("mark"))  # whatever the given columns are called
    left = rows.join(gone, ["doc", "mark"], "left_anti")
    # only the repeated rows are shuffled with their texts
    often = cut_lineage(rows.select("doc", "mark").filter("doc is not null").groupBy("doc", "mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    once = left.join(often, ["doc", "mark"], "left_anti")
    return once.unionByName(left.join(often, ["doc", "mark"], "left_semi").dropDuplicates(["doc", "mark"])).select("row.*")


def oracle() -> str:
    """Exact classes and link counts by SQL: all sets that share a shingle are compared."""
    from cohortloom.llm.decontaminate import shingle_sql

    return f"""
with recursive d as materialized ({shingle_sql("documents", "doc_id")}),
n as materialized (select doc_id, count(*) as n from d group by 1),
p as materialized (
  select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as k from d x join d y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2) s
  join n na on na.doc_id = a join n nb on nb.doc_id = b where s.k >= 0.8 * (na.n + nb.n - s.k) - 1e-9),
r as (select doc_id as node, doc_id as root from documents union select p.b, r.root from r join p on p.a = r.node),
c as (select node, min(root) as class_id from r group by 1)
select doc_id, class_id, coalesce(l.k, 0)::bigint as n_links from documents join c on c.node = doc_id
left join (select a, count(*) as k from p group by 1) l on l.a = doc_id
"""
