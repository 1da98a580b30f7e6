"""Hard negatives by the multi-index against brute force: ties, copies, odd rows, many dimensions, large parts."""

from __future__ import annotations

import numpy as np
import pytest

from cohortloom.llm import hard_negatives as hn
from cohortloom.llm.vectors import exact_kind

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, vec string, mark string, dims int, shard int"


def rows_of(seed: int, n: int, dims: int, scale: float = 1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dims)) * scale
    vectors = centre[rng.integers(0, 6, n)] + rng.normal(size=(n, dims)) * 0.4 * scale
    vectors[n // 2 : n // 2 + 5] = vectors[0]  # copies with other ids: ties
    return [(i, v.tolist(), int(i * 7 % 4), "x", "x", "x", 1, 1) for i, v in enumerate(vectors)]


def brute(rows, every, positives=5, negatives=3):
    good = {}
    for r in rows:
        i, v, label = r[:3]
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        good[(i, label, tuple(int(np.floor(256 * x)) for x in v))] = None
    out = []
    for i, label, v in good:
        if i % every:
            continue
        score = [(sum(a * b for a, b in zip(v, w)), j, k == label) for j, k, w in good if j != i and len(w) == len(v)]
        score.sort(key=lambda s: (-s[0], s[1]))
        for p, pid, _ in [s for s in score if s[2]][:positives]:
            inside = [s for s in score if not s[2] and 50 * p <= 100 * s[0] <= 95 * p][:negatives]
            out += [(i, pid, r + 1, nid, p, s) for r, (s, nid, _) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("dims,shard,scale", [(8, 37, 1.0), (3, 1000, 1.0), (1, 50, 1.0), (130, 100, 3e5), (4, 40, 2e5)])
def test_matches_brute_force(spark, dims, shard, scale):
    rows = rows_of(dims, 150, dims, scale)
    df = spark.createDataFrame(rows, SCHEMA)
    got = hn.mine_hard_negatives(df, every=10, shard_rows=shard, anchor_rows=6)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, 10)
    assert sorted(map(tuple, got.collect())) == want and want


def test_odd_rows(spark):
    rows = rows_of(5, 60, 4)
    rows += [rows[3], rows[10], (None, [1.0] * 4, 1, *rows[0][3:]), (100, None, 1, *rows[0][3:]), (110, [1.0, None, 2.0, 3.0], 1, *rows[0][3:])]
    rows += [(120, [1.0, float("nan"), 2.0, 3.0], 1, *rows[0][3:]), (130, [float("inf")] * 4, 1, *rows[0][3:]), (140, [1.0] * 4, None, *rows[0][3:])]
    rows += [(150, [], 1, *rows[0][3:]), (151, [], 1, *rows[0][3:]), (160, [2.0, 1.0], 1, *rows[0][3:]), (10, [0.5] * 4, 2, *rows[0][3:])]
    df = spark.createDataFrame(rows, SCHEMA)
    # zero-dimensional rows have score 0 with each other; their window holds 0 alone
    assert sorted(map(tuple, hn.mine_hard_negatives(df, every=10, shard_rows=20, anchor_rows=3).collect())) == brute(rows, 10)
    assert hn.mine_hard_negatives(df.filter("false")).count() == 0


def test_search_stops_on_its_certificate():
    rng = np.random.default_rng(2)
    centre = rng.integers(-3000, 3000, (12, 16))
    vectors = centre[rng.integers(0, 12, 4000)] + rng.integers(-20, 20, (4000, 16))
    index = hn.MultiIndex(vectors, np.arange(4000), np.zeros(4000, dtype=np.int64), np.float64)
    bounds = [b for b, _ in index.cells(vectors[7].astype(float))]
    assert bounds == sorted(bounds, reverse=True) and len(bounds) == 64
    for bound, cell in index.cells(vectors[7].astype(float)):
        part = index.vectors[index.start[cell] : index.start[cell + 1]]
        assert not len(part) or (part @ vectors[7]).max() <= bound
    seen, _ = index.visit(vectors[7].astype(float), lambda ids, labels, scores: ids >= 0, lambda s, bound: len(s) >= 5 and np.sort(s)[-5] > bound)
    assert 5 <= len(seen) < 4000


def test_number_types():
    assert exact_kind(np.full((2, 768), 145)) is np.float32
    assert exact_kind(np.full((2, 768), 1 << 20)) is np.float64
    assert exact_kind(np.full((2, 64), 1 << 26)) is np.int64
    assert exact_kind(np.full((2, 64), 1 << 30)) is object
    assert exact_kind(np.zeros((0, 4), dtype=np.int64)) is np.float32
