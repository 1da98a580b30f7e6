"""Tree questions against a walk from node to node, on trees of every shape."""

from __future__ import annotations

import random

from cohortloom.operators import tree

SCHEMA = "panel string, node string, parent string, branch_length double, support double, is_tip boolean"


def grown(spark, trees: dict[str, dict[str, str | None]]):
    rows = [(p, n, up, None if up is None else len(n) % 3 + 0.5, float(len(n)), False) for p, parents in trees.items() for n, up in parents.items()]
    return spark.createDataFrame(rows, SCHEMA)


def shapes():
    rng = random.Random(5)
    bushy = {"n0": None, **{f"n{i}": f"n{rng.randrange(i)}" for i in range(1, 120)}}
    comb = {"n0": None, **{f"n{i}": f"n{max(0, i - rng.choice([1, 1, 1, 2]))}" for i in range(1, 120)}}
    star = {"n0": None, **{f"n{i}": "n0" for i in range(1, 60)}}
    forest = {f"n{i}": None if i % 40 == 0 else f"n{i // 40 * 40 + rng.randrange(i % 40)}" for i in range(120)}
    return {"bushy": bushy, "comb": comb, "star": star, "forest": forest, "single": {"n0": None}}


def path_up(parents, node):
    out = [node]
    while parents[out[-1]] is not None:
        out.append(parents[out[-1]])
    return out


def expected(parents, labels, references):
    """Ancestors by label, counts of reference labels below them, nearest references, all by walking up."""
    length = {n: 0.0 if up is None else len(n) % 3 + 0.5 for n, up in parents.items()}
    above = {}
    for n in parents:
        d, above[n] = 0.0, {}
        for a in path_up(parents, n):
            above[n][a] = d
            d += length[a]
    mrca = {}
    for label in sorted({x for x in labels.values()}):
        tips = [n for n, x in labels.items() if x == label]
        shared = [a for a in path_up(parents, tips[0]) if all(a in above[t] for t in tips)]
        if shared:
            mrca[label] = shared[0]
    inside = {}
    for label, a in mrca.items():
        for r, (_, kind) in references.items():
            if a in above[r]:
                inside[label, a, kind] = inside.get((label, a, kind), 0) + 1
    near = {}
    for n in labels:
        found = [(min(above[n][a] + above[r][a] for a in above[n] if a in above[r]), o, r) for r, (o, _) in references.items() if set(above[n]) & set(above[r])]
        if found:
            near[n] = min(found)
    return mrca, inside, near


def test_trees_of_every_shape(spark):
    """One panel per shape."""
    trees, labels, references = shapes(), {}, {}
    for name, parents in trees.items():
        rng, ids = random.Random(name), list(parents)
        labels[name] = {n: f"g{rng.randrange(8)}" for n in ids if rng.random() < 0.4 or len(ids) == 1}
        references[name] = {n: (i, f"k{i % 3}") for i, n in enumerate(ids) if rng.random() < 0.3 or len(ids) == 1}
    nodes = grown(spark, trees)
    query = spark.createDataFrame([(p, n, x) for p, held in labels.items() for n, x in held.items()], "panel string, node string, label string")
    refs = spark.createDataFrame(
        [(p, n, o, k) for p, held in references.items() for n, (o, k) in held.items()], "panel string, node string, ordinal int, label string"
    )
    climbed = tree.ladder(nodes)
    shared = tree.common_ancestors(climbed, query, nodes).cache()
    ancestors = {(r.panel, r.label): r.ancestor for r in shared.collect()}
    counts = {(r.panel, r.label, r.ancestor, r.reference_label): r.n for r in tree.reference_labels_inside(climbed, shared, refs).collect()}
    nearest = {(r.panel, r.tip): (r.path_length, r.nearest_tip) for r in tree.nearest_tip(climbed, query, refs).collect()}
    verdicts = {(r.panel, r.label): (r.n_tips, r.monophyletic) for r in tree.label_monophyly(climbed, query, refs, nodes).collect()}
    for p, parents in trees.items():
        mrca, inside, near = expected(parents, labels[p], references[p])
        assert {k[1]: v for k, v in ancestors.items() if k[0] == p} == mrca, p
        assert {k[1:]: v for k, v in counts.items() if k[0] == p} == inside, p
        assert {k[1]: v for k, v in nearest.items() if k[0] == p} == {n: (d, r) for n, (d, _, r) in near.items()}, p
        for label, a in mrca.items():
            held = [n for n in labels[p] if a in path_up(parents, n)]
            own = [n for n, x in labels[p].items() if x == label]
            assert verdicts[p, label] == (len(own), "not_applicable_singleton" if len(own) == 1 else "true" if len(held) == len(own) else "false")


def test_a_cycle_is_an_error(spark):
    nodes = grown(spark, {"p": {"a": "b", "b": "a"}})
    try:
        tree.ladder(nodes, max_rounds=3)
    except RuntimeError as error:
        assert "cycle" in str(error)
    else:
        raise AssertionError("a cycle passed")


def test_a_chain_of_100000_nodes(spark):
    """Height is no limit: every rung holds at most one row a node, where a closure would hold five billion."""
    n = 100_000
    nodes = spark.range(n).selectExpr(
        "'p' as panel", "cast(id as string) as node", "if(id = 0, null, cast(id - 1 as string)) as parent", "1.0d as branch_length", "0.0d as support", "id % 10 = 0 as is_tip"
    )
    climbed = tree.ladder(nodes)
    assert len(climbed.rungs) == 17 and max(r.count() for r in climbed.rungs) < n
    ends = spark.createDataFrame([("p", str(n - 1), "a"), ("p", "70000", "a"), ("p", "10", "b"), ("p", "99", "b")], "panel string, node string, label string")
    refs = spark.createDataFrame([("p", "100", 1), ("p", "70010", 2)], "panel string, node string, ordinal int")
    got = {r.tip: (r.nearest_tip, r.path_length) for r in tree.nearest_tip(climbed, ends, refs).collect()}
    assert got == {str(n - 1): ("70010", n - 1.0 - 70010), "70000": ("70010", 10.0), "10": ("100", 90.0), "99": ("100", 1.0)}
