"""Hard-negative mining by an inverted multi-index.

Vectors are turned into integers and dealt into shards by a hash of their row. A task holds one shard as an inverted multi-index:
a codebook of each half of the dimensions is fitted to the shard's own rows (k-means, a few rounds), and the rows that
share both codes form a cell. No row of a cell can score more against an anchor than the two halves' products with
their codewords plus anchor norm times radius (the codeword's farthest row). A multi-sequence heap visits the cells by
the sum of the two half bounds, largest first, so when the next cell's bound is below what is wanted, everything wanted has been
seen: the search stops on this certificate and is exact. Scores are exact integers, bounds are rounded outwards.

Two rounds: the best positives of each anchor over all shards, then the best negatives in the score window of each positive.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.stored import written
from cohortloom.llm.vectors import as_bigints, exact_kind, matrix_of, norms

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: The window of negative scores, in hundredths of the positive's score.
LOW, HIGH = 50, 95
#: Rows of a shard, anchors of a block, codewords of a half, k-means rounds, rows scored at once.
SHARD_ROWS, ANCHOR_ROWS, CODES, ROUNDS, STEP = 16384, 1024, 8, 6, 2048


def integer_rows(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vec, dims, mark) of the rows that take part, repeated rows once; vec is floor(scale * component)."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (
        df.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False)))
        .select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("bigint")).alias("vec"))
        .distinct()
        .withColumns({"dims": F.size("vec"), "mark": F.xxhash64("id", "label", "vec")})
    )


def _codebook(half: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """(codewords, code of each row) by k-means from evenly spaced rows; the same rows give the same codebook."""
    words = half[np.linspace(0, len(half) - 1, min(codes, len(half))).astype(np.int64)]
    code = np.zeros(len(half), dtype=np.int64)
    for turn in range(ROUNDS + 1):
        code = (np.square(words).sum(1) - 2 * (half @ words.T)).argmin(1)
        if turn == ROUNDS:
            break
        count = np.bincount(code, minlength=len(words))
        total = np.zeros_like(words)
        np.add.at(total, code, half)
        words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words)
    return words, code


class MultiIndex:
    """One shard: two half codebooks with radii, and the rows in the order of their cells."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, kind: type, codes: int = CODES):
        """``labels`` are numbers."""
        order = np.lexsort((labels, ids))
        vectors, ids, labels = vectors[order], ids[order], labels[order]
        middle = vectors.shape[1] // 2
        self.cut = (slice(0, middle), slice(middle, None))
        self.words, self.radius, code = [], [], []
        for part in self.cut:
            half = vectors[:, part].astype(np.float64)
            words, mine = _codebook(half, codes)
            radius = np.zeros(len(words))
            np.maximum.at(radius, mine, norms(half - words[mine]))
            self.words.append(words)
            self.radius.append(radius)
            code.append(mine)
        cell = code[0] * len(self.words[1]) + code[1]
        place = np.argsort(cell, kind="stable")
        self.vectors, self.ids, self.labels = vectors[place].astype(kind), ids[place], labels[place]
        self.start = np.searchsorted(cell[place], np.arange(len(self.words[0]) * len(self.words[1]) + 1)).tolist()

    def cells(self, anchor: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) by falling bounds: a heap over the two half lists, each sorted by its own bound."""
        bound, rank = [], []
        for part, words, radius in zip(self.cut, self.words, self.radius, strict=True):
            half = anchor[part].astype(np.float64)
            length = norms(half)
            reach = words @ half + length * radius
            reach += 1e-9 * (norms(words) * length + np.abs(reach)) + 1e-3
            order = np.argsort(-reach, kind="stable")
            bound.append(reach[order].tolist())
            rank.append(order.tolist())
        wide = len(rank[1])
        heap, reached = [(-(bound[0][0] + bound[1][0]), 0, 0)], [0] * len(rank[0])
        while heap:
            least, i, j = heapq.heappop(heap)
            yield -least, rank[0][i] * wide + rank[1][j]
            reached[i] = j + 1
            if j + 1 < wide and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (-(bound[0][i] + bound[1][j + 1]), i, j + 1))
            if i + 1 < len(rank[0]) and reached[i + 1] == j:
                heapq.heappush(heap, (-(bound[0][i + 1] + bound[1][j]), i + 1, j))

    def visit(self, anchor: np.ndarray, keep, done) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the visited rows that ``keep(ids, labels, scores)`` marks, until ``done(scores, bound)``.

        ``done`` is told the scores kept so far and the bound of all rows that were not scored, after every ``STEP`` rows.
        """
        ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.vectors.dtype)
        waiting: list[slice] = []
        rows = 0

        def score() -> None:
            nonlocal ids, scores
            found = np.concatenate([self.vectors[w] @ anchor for w in waiting])
            who = np.concatenate([self.ids[w] for w in waiting])
            good = np.flatnonzero(keep(who, np.concatenate([self.labels[w] for w in waiting]), found))
            ids, scores = np.concatenate([ids, who[good]]), np.concatenate([scores, found[good]])

        for bound, cell in self.cells(anchor):
            if rows >= STEP:
                score()
                waiting, rows = [], 0
                if done(scores, bound):
                    return ids, scores
            if self.start[cell] < self.start[cell + 1]:
                waiting.append(slice(self.start[cell], self.start[cell + 1]))
                rows += self.start[cell + 1] - self.start[cell]
        if rows:
            score()
        return ids, scores


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, ties by smaller ids."""
    if scores.dtype == object:
        order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
    else:
        order = np.lexsort((ids, -scores))[:k]
    return ids[order], as_bigints(scores[order])


def _task(per_anchor, by_label: bool):
    """cogrouped anchors and rows of one shard -> rows found for each anchor. ``by_label``: one index for each label."""

    def run(key, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(anchors) and len(rows):
            held, asked = matrix_of(rows["vec"]), matrix_of(anchors["vec"])
            kind = exact_kind(held, asked)
            names, labels = np.unique(rows["label"].to_numpy(dtype=object), return_inverse=True)
            number = {name: i for i, name in enumerate(names)}
            ids, asked = rows["id"].to_numpy(dtype=np.int64), asked.astype(kind)
            parts = [(anchors, asked, np.arange(len(ids)))]
            if by_label:
                mine = anchors["label"].map(number)
                parts = [(anchors[mine == i], asked[(mine == i).to_numpy()], np.flatnonzero(labels == i)) for i in sorted(mine.dropna().unique())]
            for some, vectors, of in parts:
                index = MultiIndex(held[of], ids[of], labels[of], kind)
                for vec, anchor in zip(vectors, some.drop(columns="vec").to_dict("records"), strict=True):
                    out += per_anchor(index, vec, anchor, number.get(anchor["label"], -1))
        return pd.DataFrame(out, columns=["mark", "anchor_id", "positive_id", "positive_score", "found_id", "found_score"])

    return run


def _positives(k: int):
    def per_anchor(index: MultiIndex, vec: np.ndarray, anchor: dict, label: int) -> list[tuple]:
        def done(scores: np.ndarray, bound: float) -> bool:
            return len(scores) >= k and float(np.partition(scores, len(scores) - k)[len(scores) - k]) > bound

        found = index.visit(vec, lambda ids, labels, scores: (ids != anchor["id"]) & (labels == label), done)
        ids, scores = _best(*found, k)
        return [(anchor["mark"], anchor["id"], 0, 0, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]

    return per_anchor


def _negatives(k: int):
    def per_anchor(index: MultiIndex, vec: np.ndarray, anchor: dict, label: int) -> list[tuple]:
        windows = [(w["low"], w["high"]) for w in anchor["wanted"]]
        least, most = min(low for low, _ in windows), max(high for _, high in windows)

        def done(scores: np.ndarray, bound: float) -> bool:
            for low, high in windows:
                if bound < low:
                    continue
                inside = scores[(scores >= low) & (scores <= high)]
                if len(inside) < k or float(np.partition(inside, len(inside) - k)[len(inside) - k]) <= bound:
                    return False
            return True

        ids, scores = index.visit(vec, lambda ids, labels, scores: (ids != anchor["id"]) & (labels != label) & (scores >= least) & (scores <= most), done)
        out = []
        for w in anchor["wanted"]:
            inside = (scores >= w["low"]) & (scores <= w["high"])
            found, value = _best(ids[inside], scores[inside], k)
            out += [(anchor["mark"], anchor["id"], w["positive_id"], w["positive_score"], i, s) for i, s in zip(found.tolist(), value.tolist(), strict=True)]
        return out

    return per_anchor


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("found_score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_hard_negatives(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = EVERY, scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, shard_rows: int = SHARD_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``. A row's score is its integer inner product with the anchor;
    higher ones come first, ties by smaller id. The positives of an anchor are the first rows of its label with another
    id; for each, the first rows of other labels whose score is 50 to 95 hundredths of the positive's are returned (a
    negative positive score leaves none, since then 50 hundredths are more than 95). Only vectors of the same number of
    dimensions meet. Rows with a null id, label or vector, or with a null or non-finite component, take no part.
    Repeated rows count once; rows that share an id with other vectors or labels each take part and, as anchors, have
    positives of their own. Scores beyond BIGINT become its largest or smallest value. An empty table gives no rows.

    Every row lies in one shard of about ``shard_rows`` and meets each block of ``anchor_rows`` anchors in one task;
    only the few best leave it. That is anchors x rows by definition, less what the certificates spare.
    """
    rows = written(integer_rows(df, id_col, vector_col, label_col, scale))
    n = rows.count()
    asking = rows.filter(F.col("id") % every == 0)
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asking.count() // anchor_rows))
    spread = lambda parts, salt: F.pmod(F.xxhash64(F.lit(salt), "mark"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    keys = ["dims", "shard", "block"]
    held = rows.withColumn("shard", spread(shards, 1)).withColumn("block", each(blocks))
    held = held.select(*[F.col(c).alias(c) for c in (*keys, "id", "label", "vec")])  # a side of its own: the cogroup takes no column twice
    found = "mark bigint, anchor_id bigint, positive_id bigint, positive_score bigint, found_id bigint, found_score bigint"

    def search(anchors: DataFrame, per_anchor, by_label: bool) -> DataFrame:
        dealt = anchors.withColumn("block", spread(blocks, 2)).withColumn("shard", each(shards))
        return dealt.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_task(per_anchor, by_label), found)

    best = _ranked(search(asking.select("dims", "id", "label", "vec", "mark"), _positives(positives), True), ["mark"], positives)
    score = F.col("found_score")
    twentieth = F.expr("found_score div 20")
    window = F.struct(
        F.col("found_id").alias("positive_id"), score.alias("positive_score"),
        F.expr("found_score div 2 + found_score % 2").alias("low"), (twentieth * 19 + F.expr("((found_score % 20) * 19) div 20")).alias("high"),
    )
    wanted = written(best.filter(score >= 0).groupBy("mark").agg(F.collect_list(window).alias("wanted")))  # at most ``positives`` each
    mined = search(asking.join(wanted, "mark").select("dims", "id", "label", "vec", "mark", "wanted"), _negatives(negatives), False)
    return _ranked(mined, ["mark", "positive_id"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("found_score").alias("negative_score")
    )


ORACLE = """
with v as materialized (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double)::bigint for x in embedding] as v
  from embeddings where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as materialized (select q.vec_id as anchor_id, q.label = c.label as same, c.vec_id, list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)])::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from (
  select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from p join s using (anchor_id) where not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score) where rank <= 3
"""
