"""Token alignment and its corpus-wide counts against whole-text encoding and plain counting."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from cohortloom.llm import token_align as ta


@pytest.fixture(scope="module")
def aligner():
    return ta.Aligner(*[open(f"{ta.FOLDER}/{n}", "rb").read() for n in (ta.FILE_A, ta.FILE_B)])


ODD = [
    "<|endoftext|> ok </s> <s> <unk>", "ﬁ Ａ", "a▁b c", "a\x00b c", "  lead  two  ", "x   　 y", "tab\t x", "don't they're I'm 's 't", "\n\n a b\n c",
    "😀 👩‍👩‍👧 日本 語 한국", "a ​ b", "\x1c x \x1f y", "};\r\n x", "a" * 500 + " b", " ", "a", "▁",
]


def plain(aligner, text):
    """(ids A, ids B, groups, links) of one text encoded whole, or None if it is not spelt."""
    if not text:
        return None
    ids_a, ids_b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    raw_a, raw_b = [aligner.bytes_a[i] for i in ids_a], [aligner.bytes_b[i] for i in ids_b]
    if not b"".join(raw_a) == (" " + text).encode() == b"".join(raw_b):
        return None
    ends_a, ends_b = {int(e): i for i, e in enumerate(np.cumsum([len(x) for x in raw_a]))}, {int(e): i for i, e in enumerate(np.cumsum([len(x) for x in raw_b]))}
    groups, links, i, j = [], [], 0, 0
    for e in sorted(ends_a.keys() & ends_b.keys()):
        a, b = ends_a[e], ends_b[e]
        groups.append(",".join(map(str, ids_a[i : a + 1])) + "|" + ",".join(map(str, ids_b[j : b + 1])))
        links.append((ids_a[a], ids_b[b]))
        i, j = a + 1, b + 1
    return len(ids_a), len(ids_b), groups, links


def expected(aligner, rows):
    found = [plain(aligner, t) for _, t in rows]
    count = Counter(p for f in found if f for p in f[3])
    most: dict[int, int] = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (doc, _), f in zip(rows, found):
        if not f:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        best = sum(count[p] == most[p[1]] for p in links)
        out.append((doc, n_a, n_b, len(groups), len(links), best, sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("records,fan", [(2_000_000, 256), (300, 2)])
def test_corpus_against_whole_texts(spark, docs, aligner, monkeypatch, records, fan):
    monkeypatch.setattr(ta, "RUN_RECORDS", records)  # closures carry the value to the workers
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    table = docs.unionByName(more, allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    got = ta.align_tokens(table, fan=fan)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(aligner, rows)


def test_words_do_not_depend_on_their_place(aligner, monkeypatch):
    monkeypatch.setattr(ta, "STRETCH", 3)
    monkeypatch.setattr(ta, "KEPT_WORDS", 10)
    for text in [*ODD, " ".join(ODD[2:8]), "one two  three four\nfive six seven don't eight"]:
        want = plain(aligner, text)
        parts = list(aligner.stretches(text))
        if want is None:
            assert parts[-1] is None
            continue
        aligned = [aligner.align(*p) for p in parts]
        assert b";".join(g for _, g in aligned).decode() == ";".join(want[2])
        assert [(int(p) % (1 << 20), int(p) >> 20) for x, _ in aligned for p in x] == want[3]


def test_heap_merge():
    rng = np.random.default_rng(1)
    runs = []
    for _ in range(9):
        keys, n = np.unique(rng.integers(0, 200, rng.integers(0, 80)), return_counts=True)
        runs.append((keys.astype(np.int64), n.astype(np.int64)))
    pairs, counts = ta.merge_runs(runs)
    want = Counter()
    for k, n in runs:
        want.update(dict(zip(k.tolist(), n.tolist())))
    assert dict(zip(pairs.tolist(), counts.tolist())) == want and (np.diff(pairs) > 0).all()
    for values in (np.zeros(0, dtype=np.int64), np.array([-5, 1 << 62, 0])):
        assert ta.unpack(ta.pack(values)).tolist() == values.tolist()


def test_empty_table(spark, empty):
    assert ta.align_tokens(empty).count() == 0
