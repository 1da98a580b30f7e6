"""Url rules and exact search against brute force; the pipeline's stages on driver tables."""

from __future__ import annotations

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import topk, url_filter

URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com/en/1", "http://www.example.com/en/x?a=b", "http://sub.example.com/en", "http://a.net/es/q#f",
    "http://a.net/fr/", "http://com/", "http://notcom", "ftp://x.Com?en", "http://x.org/en/5", "http://x.org/de/?u=1&v=2", "a://b://c.com/", "http://badexample.com/en/9",
    "http://é.org/ES/", "http://x.org/" + "long/" * 3000,
]


def brute_rule(url):
    text = url or ""
    at = text.find("://")
    rest = text[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = max((r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_url_rules(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "x"), (None, URLS[4], "x")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string, host string")).collect()
    assert len(got) == len(rows)
    want = sorted([(str(i), *map(str, brute_rule(u)[:3])) for i, u, _ in rows])
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in got) == want
    decided = {str(i): brute_rule(u)[3] for i, u, _ in rows}
    assert all(r.verdict == decided[str(r.page_id)] or decided[str(r.page_id)] is None and r.verdict in ("allow", "block") for r in got)
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(spark.createDataFrame([(1, "http://x.org/")], "page_id bigint, url string")).collect()} == {"allow"}


def test_mined_rules_match_brute_force(spark):
    rng = random.Random(4)
    rows = [([t for t in "abcdef" if rng.random() < 0.5], rng.choice(["allow", "block"])) for _ in range(200)]
    rows = [(t, "block" if {"a", "c"} <= set(t) else v) for t, v in rows]
    frame = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    rules = {(tuple(r.rule_tokens), r.verdict): (r.support, r.confidence) for r in url_filter.mine_rules(frame, 0.05, 0.6).collect()}
    every = {}
    for k in range(1, 5):
        for body in combinations("abcdef", k):
            held = [v for t, v in rows if set(body) <= set(t)]
            for verdict in ("allow", "block"):
                n = held.count(verdict)
                if n >= 0.05 * len(rows) and n / len(held) >= 0.6:
                    every[body, verdict] = (n / len(rows), n / len(held))
    pruned = {b: x for b, x in every.items() if not any((tuple(y for y in b[0] if y != out), b[1]) in every and every[tuple(y for y in b[0] if y != out), b[1]][1] >= x[1] for out in b[0])}
    assert set(rules) == set(pruned) and all(math.isclose(rules[b][1], x[1]) for b, x in pruned.items())
    urls = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(rows)], "key string, tokens array<string>")
    table = spark.createDataFrame([(list(b), v, s, c) for (b, v), (s, c) in rules.items()], "rule_tokens array<string>, verdict string, support double, confidence double")
    got = {r.key: (r.mined, list(r.mined_tokens)) for r in url_filter.match_rules(urls, table).collect()}
    for i, (t, _) in enumerate(rows):
        fits = [(-c, -s, -len(b), list(b), v) for (b, v), (s, c) in rules.items() if set(b) <= set(t)]
        assert got.get(str(i)) == ((min(fits)[4], min(fits)[3]) if fits else None)


def brute_top(rows, k=5, every=50):
    vectors = sorted({(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for q, a in vectors:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vectors if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [8192, 40])
def test_exact_top_k(spark, shard):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.25, 0.5, rng.random()]) for _ in range(40)]) for i in range(300)]
    rows += [(400, rows[0][1]), (401, rows[0][1]), rows[7], (402, None), (403, [None] * 40), (404, [float("nan")] * 40), (405, [float("inf")] * 40), (None, rows[1][1]), (450, [1.0]), (500, [2.0, 1.0]), (501, [1.0, 1e7]), (502, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({"dims": F.lit(1), "id": F.lit("x"), "shard": F.lit("y")})
    got = topk.exact_top_k(frame, shard_rows=shard, query_rows=2)
    assert sorted(map(tuple, got.collect())) == brute_top([(i, v) for i, v in rows])
    assert topk.exact_top_k(frame.filter("false")).count() == 0


def test_exact_top_k_large_components(spark):
    rows = [(i, [float(i) * 3e8, 1e9 - i, 5.0]) for i in range(60)]
    got = topk.exact_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), scale=1)
    want = []
    for q in (0, 50):
        exact = [(sum(math.floor(x) * math.floor(y) for x, y in zip(rows[q][1], v, strict=True)), i) for i, v in rows if i != q]
        scored = sorted((-min(max(s, -(1 << 63)), (1 << 63) - 1), i) for s, i in exact)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    assert sorted(map(tuple, got.collect())) == want


def test_rule_of_five_tokens_is_kept(spark):
    """Only all five tokens together reach the confidence; each shorter part stays below."""
    rows = [("abcde", "block")] * 100 + [("abcde".replace(out, ""), "allow") for out in "abcde" for _ in range(50)]
    frame = spark.createDataFrame([(list(t), v) for t, v in rows], "tokens array<string>, verdict string")
    rules = [(r.rule_tokens, r.verdict, r.confidence) for r in url_filter.mine_rules(frame).collect()]
    assert rules == [(list("abcde"), "block", 1.0)]


def test_words_of_one_shared_path_are_one_item(spark):
    """Thirty words that always stand together are mined as one item and any of them matches its rule."""
    path = [f"w{i:02d}" for i in range(30)]
    rows = [([*path, "x"], "block")] * 60 + [(path, "block")] * 60 + [(["y"], "allow")] * 80
    frame = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    rules = url_filter.mine_rules(frame).cache()
    got = {(tuple(r.rule_tokens), r.verdict): (r.confidence, [list(a) for a in r.alike]) for r in rules.collect()}
    assert got == {(("w00",), "block"): (1.0, [path]), (("x",), "block"): (1.0, [["x"]]), (("y",), "allow"): (1.0, [["y"]])}
    urls = spark.createDataFrame([("a", ["w17"]), ("b", ["z"]), ("c", ["y"]), ("d", [])], "key string, tokens array<string>")
    assert {(r.key, r.mined) for r in url_filter.match_rules(urls, rules).collect()} == {("a", "block"), ("c", "allow")}
