"""SimHash components against brute force over all pairs, and the covering code itself."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortloom.llm import simhash


def plain_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def plain_components(fps: list[int]) -> list[int]:
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_corpus_against_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    root = plain_components(fps)
    least: dict[int, int] = {}
    for r, k in zip(rows, root):
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = sorted((str(r.doc_id), f"{f:016x}", str(least.get(k))) for r, f, k in zip(rows, fps, root))
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got.collect()) == want


def test_hash_is_the_engines(spark):
    row = spark.createDataFrame([("three short words é",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row.h & (1 << 64) - 1 == xxhash.xxh64_intdigest("three short words é".encode(), 42)


def test_long_texts_in_pieces(monkeypatch):
    text = ("Some words\tRepeat  and others\n do " * 400 + "end é").encode()
    whole = simhash.fingerprint(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())
    assert simhash.fingerprint(b"A b") == plain_fingerprint("a  B") and simhash.fingerprint(b" \n") == simhash.fingerprint(None) == 0


def test_code_is_perfect_and_covers_every_close_pair():
    first, pattern, excess, _ = simhash._reach()
    assert (np.diff(first) > 0).all()
    inside = [int((excess[a:b] == 0).sum()) for a, b in zip(first[:-1], first[1:])]
    assert set(inside) == {1}  # every word has exactly one codeword within the radius
    rng = np.random.default_rng(1)
    fps = rng.integers(-(1 << 63), (1 << 63) - 1, 300)
    for x in fps:
        y = x
        for b in rng.choice(64, rng.integers(0, 4), replace=False).tolist():
            y = y ^ np.array(1 << b, dtype=np.uint64).view(np.int64)
        row, anchor, more = simhash.anchors(np.array([x, y], dtype=np.int64))
        a = dict(zip(anchor[row == 0].tolist(), more[row == 0].tolist()))
        b = dict(zip(anchor[row == 1].tolist(), more[row == 1].tolist()))
        assert any(a[k] <= 1 and b[k] <= 2 for k in a.keys() & b.keys())
        assert len(a) == int((row == 0).sum())


@pytest.mark.parametrize("part", [16, 100_000])
def test_dense_group_in_parts(spark, part):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    group = {centre ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(9) for b in range(9) for c in range(9)}
    far = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 40)]
    fps = sorted(group) + far
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    links = simhash.links(df, part)
    found = [tuple(r) for r in links.collect()]
    place = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 64
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(fps))] == plain_components([f & (1 << 64) - 1 for f in fps])


def test_empty_table(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
