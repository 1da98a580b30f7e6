"""Exact top-k by inner product: columnar branch and bound over dimension blocks.

Vectors are turned into integers and dealt into shards by a hash of their row. A shard lies in a task column by column.
For every query the inner products grow dimension block by dimension block; what the remaining dimensions can still add
is at most the product of the two remaining norms (Cauchy-Schwarz), so candidates whose sum plus that bound stays under
the k-th best lower bound are dropped and the survivors compacted before the next block. All sums are exact integers;
bounds are rounded outwards, so no tie is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.vectors import exact_kind, matrix_of

SCALE, K, EVERY = 256, 5, 50
SHARD_ROWS, QUERY_ROWS, DIM_BLOCK = 8192, 256, 16


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, vec): floor(scale * component) as BIGINT. Rows without id or vector, or with a null or non-finite component, are left out."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (
        df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
        .filter(F.coalesce(finite, F.lit(False)))
        .select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("bigint")).alias("vec"))
        .distinct()
    )


def best_of_shard(query: np.ndarray, query_id: int, columns: np.ndarray, ids: np.ndarray, rest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows of one shard for one query, ties to smaller ids.

    ``columns`` is dimensions x rows (BIGINT), ``rest`` the norms of what remains from each block on, rounded up.
    """
    dims = len(query)
    alive = np.flatnonzero(ids != query_id)
    total = np.zeros(len(alive), dtype=columns.dtype)
    for block, low in enumerate(range(0, dims, DIM_BLOCK)):
        part = columns[low : low + DIM_BLOCK]
        part = part if len(alive) == len(ids) else part[:, alive]
        total = total + query[low : low + DIM_BLOCK] @ part
        high = low + DIM_BLOCK
        if high < dims and len(alive) > k:
            tail = float(np.sqrt(np.square(query[high:].astype(np.float64)).sum())) * (1 + 1e-9) + 1
            reach = tail * rest[block + 1][alive]
            sums = total.astype(np.float64)
            floor = np.partition(sums - reach, len(alive) - k)[len(alive) - k]
            keep = sums + reach >= floor - 1e-6 * abs(floor) - 1
            alive, total = alive[keep], total[keep]
    if total.dtype == object:
        total = np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in total], dtype=object)
        order = np.array(sorted(range(len(alive)), key=lambda i: (-total[i], ids[alive][i]))[:k], dtype=np.int64)
    else:
        order = np.lexsort((ids[alive], -total))[:k]
    return ids[alive][order], total[order]


def _shard_search(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(queries) and len(rows):
            matrix, asked = matrix_of(rows["vec"]), matrix_of(queries["vec"])
            kind = exact_kind(matrix, asked)
            columns = np.ascontiguousarray(matrix.T).astype(kind)
            squares = np.square(matrix.T.astype(np.float64))
            rest = [np.sqrt(squares[low:].sum(0)) * (1 + 1e-9) + 1 for low in range(0, max(len(columns), 1), DIM_BLOCK)]
            ids = rows["id"].to_numpy(dtype=np.int64)
            for query_id, vec in zip(queries["id"], asked, strict=True):
                got, score = best_of_shard(vec.astype(kind), query_id, columns, ids, np.array(rest), k)
                out += [(int(query_id), int(i), int(s)) for i, s in zip(got, score, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def exact_top_k(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY, scale: int = SCALE,
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the largest integer inner product of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another id, of the same number
    of dimensions. Fewer than k candidates are all returned; a query without any has no row. Equal rows count once; rows
    sharing an id with different vectors are all candidates and (divisible ids) all ask, the best k over them are returned.
    Parts and scores beyond BIGINT are taken as its largest or smallest value. Null ids, null vectors and vectors with a null or non-finite component take no part. Work is queries x rows by
    definition: each shard of about ``shard_rows`` rows meets each block of queries in one task, on a key that both
    sides carry, and only k rows leave it.
    """
    vectors = integer_vectors(df, id_col, vector_col, scale).withColumn("dims", F.size("vec"))
    n = vectors.count()
    shards = max(1, -(-n // shard_rows))
    blocks = max(1, -(-n // (every * query_rows)))
    spread = lambda parts, salt: F.pmod(F.xxhash64(F.lit(salt), "id", "vec"), F.lit(parts)).cast("int")
    held = vectors.withColumn("shard", spread(shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = vectors.filter(F.col("id") % every == 0).withColumn("block", spread(blocks, 2)).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    keys = ["dims", "shard", "block"]
    local = (
        asked.select(*keys, "id", "vec").groupBy(*keys)
        .cogroup(held.select(*keys, "id", "vec").groupBy(*keys))
        .applyInPandas(_shard_search(k), "query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
with v as (select vec_id, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)])::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5
"""
