"""Pairs verified by packed sets, on sets that span many words, against Python sets."""

from __future__ import annotations

import random
from itertools import combinations

from cohortloom.operators import modules


def test_common_members_over_many_spans(spark):
    rng = random.Random(8)
    everyone = [f"e{i}" for i in range(1500)]
    sets = {f"f{k}": set(rng.sample(everyone, n)) for k, n in enumerate((1500, 900, 700, 64, 1, 30))}
    rows = spark.createDataFrame([("up", f, e) for f, s in sets.items() for e in s], "direction string, feature string, entity string")
    packed = modules.packed_sets(rows, modules.entity_numbers(rows, "entity"), "feature", "entity", "direction")
    assert packed.count() <= len(sets) * (1500 // (64 * modules.SPAN_WORDS) + 1)
    pairs = spark.createDataFrame([("up", a, b) for a, b in combinations(sorted(sets), 2)], "direction string, feature_a string, feature_b string")
    got = {(r.feature_a, r.feature_b): r.n for r in modules.common_members(pairs, packed, "feature", "direction", "n").collect()}
    want = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2)}
    assert {p: got.get(p, 0) for p in want} == want


def test_packed_sets_of_nothing(spark):
    empty = spark.createDataFrame([], "direction string, feature string, entity string")
    assert modules.packed_sets(empty, modules.entity_numbers(empty, "entity"), "feature", "entity", "direction").count() == 0
