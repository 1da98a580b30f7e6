"""Ownership of points by the sweep: against point-by-point choice, with nested intervals, null owners and bucket borders."""

from __future__ import annotations

import random
import time

import pytest

from cohortloom.operators import intervals


def owners_by_point(rows):
    held = {}
    for start, end, owner in rows:
        for p in range(start, end):
            have = held.get(p, (True, 0, 0))
            mine = (owner is None, 0 if owner is None else owner, 1)
            if p not in held or mine < have:
                held[p] = mine
    return {p: None if o[0] else o[1] for p, o in held.items()}


@pytest.mark.parametrize("seed", range(5))
def test_pieces_match_points(seed):
    rng = random.Random(seed)
    rows = sorted((s, s + rng.randint(1, 30), rng.choice([None, *range(6)])) for s in (rng.randint(0, 150) for _ in range(rng.randint(0, 60))))
    rows.sort(key=lambda r: r[0])
    pieces = list(intervals.owned_pieces(rows))
    got = {p: o for o, a, b in pieces for p in range(a, b)}
    assert got == owners_by_point(rows)
    assert sum(b - a for _, a, b in pieces) == len(got)
    assert all(not (x[0] == y[0] and x[2] == y[1]) for x, y in zip(pieces, pieces[1:]))


@pytest.mark.parametrize("outer_wins", [True, False])
def test_nested_intervals_are_near_linear(outer_wins):
    """10,000 and 40,000 intervals around one point, each inside the one before."""
    seconds = []
    for n in (10_000, 40_000):
        rows = [(i, 2 * n + 1 - i, i if outer_wins else n - i) for i in range(n)]
        started = time.perf_counter()
        pieces = list(intervals.owned_pieces(rows))
        seconds.append(time.perf_counter() - started)
        assert len(pieces) == (1 if outer_wins else 2 * n - 1)
    assert seconds[1] < 12 * max(seconds[0], 0.01)


def test_owners_on_spark(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), s, s + rng.randint(0, 60), rng.choice([None, 1, 2, 3])) for s in (rng.randint(-100, 300) for _ in range(120))]
    rows += [("nest", i, 401 - i, 200 - i) for i in range(200)] + [(None, 5, 9, 1)]
    df = spark.createDataFrame(rows, "k string, start bigint, end bigint, who int").repartition(5)
    got = intervals.own_by_precedence(df, ["k"], "who", width=32).collect()
    for key in ("a", "b", "nest"):
        mine = {p: r.who for r in got if r.k == key for p in range(r.start, r.end)}
        assert mine == owners_by_point([(s, e, w) for k, s, e, w in rows if k == key and w is not None])
    assert intervals.own_by_precedence(df.filter("false"), ["k"], "who").count() == 0
