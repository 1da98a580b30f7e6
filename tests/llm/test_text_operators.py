"""Operators on texts against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import time
import warnings
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from fixtures import SCHEMA, corpus

from cohortloom.llm import decontaminate, license_scan, line_dedup, lm_score, mixing, ngram_join, quality, suffix_dedup
from cohortloom.llm import textops as tx

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def words(text):
    return re.findall(tx.WORD_PATTERN, low(text))


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_words_and_shingles_as_by_pattern():
    texts = [t or "" for _, t in corpus()]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    hashes, row = tx.words(data, offsets)
    assert [int(tx.word_hash(w)) for t in texts for w in words(t)] == hashes.tolist()
    assert np.bincount(row, minlength=len(texts)).tolist() == [len(words(t)) for t in texts]
    _, row = tx.shingle_sets(data, offsets, 5)
    assert np.bincount(row, minlength=len(texts)).tolist() == [len(shingles(t)) for t in texts]


# line dedup


def brute_lines(rows, least):
    docs = sorted({(i if i is not None else -1, t): None for i, t in rows}, key=lambda r: r[0])
    lines, where = [], []
    for d, (_, t) in enumerate(docs):
        for i, x in enumerate((t or "").split("\n")):
            if x.strip(" "):
                lines.append((d, i, x, x.count(" ") + 1))
    gone = set()
    places = defaultdict(list)
    for a in range(len(lines)):
        for b in range(a, min(a + 40, len(lines))):
            if lines[b][0] != lines[a][0]:
                break
            run = lines[a : b + 1]
            if sum(x[3] for x in run) >= least:
                places[tuple(x[2] for x in run)].append((a, b))
    for found in places.values():
        for a, b in sorted(found)[1:]:
            gone.update((lines[k][0], lines[k][1]) for k in range(a, b + 1))
    out = {}
    for d, (i, t) in enumerate(docs):
        out[(i, t)] = "\n".join(x for k, x in enumerate((t or "").split("\n")) if (d, k) not in gone) if any(g[0] == d for g in gone) else t
    return out


def test_line_dedup(docs, empty):
    rows = [r for r in corpus() if r[0] != 7]  # ids shared by different texts are ordered by a hash
    want = brute_lines(rows, line_dedup.MIN_WORDS)
    frame = docs.filter("doc_id is null or doc_id <> 7")
    got = line_dedup.drop_repeated_lines(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        i = -1 if r.doc_id is None else r.doc_id
        assert r.text in {t for (k, _), t in want.items() if k == i}
    assert sum(r.lines_removed for r in got) > 20 and set(frame.columns) < set(got[0].asDict())
    assert line_dedup.drop_repeated_lines(empty).count() == 0


# suffix dedup


def brute_strings(rows, length):
    seen = Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        cover = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                cover[k] += 1
                cover[k + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [32, 1])
def test_suffix_dedup(docs, group, monkeypatch):
    """Both ways of settling contexts (sorted, counted) give the brute-force spans."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    got = suffix_dedup.drop_repeated_strings(docs).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == brute_strings(corpus(), suffix_dedup.LENGTH)


def test_suffix_dedup_odd_tables(spark, empty):
    assert suffix_dedup.drop_repeated_strings(empty).count() == 0
    rows = [(1, "ab" * 150), (2, "x" * 250 + "y"), (3, "q" * 199), (4, None)]
    got = suffix_dedup.drop_repeated_strings(spark.createDataFrame(rows, SCHEMA)).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == brute_strings(rows, suffix_dedup.LENGTH)


def test_suffix_mergesort_orders_like_python():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 2, 900).astype(np.uint8)
    suffix, group = np.concatenate([np.arange(0, 300), np.arange(300, 700)]), np.repeat([0, 1], [300, 400])
    got = suffix_dedup.Suffixes(data, 12).sorted_within(suffix, group)
    for part, own in ((got[:300], suffix[:300]), (got[300:], suffix[300:])):
        keys = [data[s : s + 12].tobytes() for s in part]
        assert keys == sorted(keys) and sorted(part) == sorted(own)


# language model


def test_lm_score(docs, empty):
    rows = corpus()
    got = lm_score.perplexity(lm_score.score_texts(docs, batch_text=20_000)).collect()
    tokens = {(i, t): [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), "<end>"] for i, t in rows}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    c = Counter(w for r in rows if not held[r[0]] for w in tokens[r])
    n, v = sum(c.values()), len(c)
    want = sorted(
        (str(i), held[i], len(tokens[i, t]), sum(c[w] > 0 for w in tokens[i, t]), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens[i, t]), 6))
        for i, t in rows
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.perplexity > 1 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm_score.score_texts(empty).count() == 0


def test_lm_probabilities_sum_to_one():
    """Over the vocabulary and the unknown word, in every restaurant."""
    rng = np.random.default_rng(0)
    item, ctx, n = np.repeat(np.arange(50), 4), np.tile([0, 9, 200, 255], 50), rng.integers(1, 30, 200)
    fine = np.bincount(ctx, weights=n, minlength=256)
    model = lm_score.Model(fine, n.sum(), 50, (0.5, 0.5, 0.5))
    *_, last = model.sweeps(item, ctx, n, 1, rng)
    tables, key, coarse, words, _ = last
    model.set_tables(np.bincount(ctx, weights=tables, minlength=256), np.bincount(key % 32, weights=coarse, minlength=32), words.sum())
    arrived = np.bincount(key // 32, weights=coarse)
    p_word = (arrived - 0.5 * words + model.word_back / 51) / model.word_all
    assert abs(p_word.sum() + model.unknown() - 1) < 1e-9


def _ids(held: bool) -> list[int]:
    return [i for i in range(1000) if (zlib.crc32(str(i).encode()) % 5 == 1) == held]


def test_lm_contexts_are_whole_words(spark):
    """Words that begin alike are told apart as the word before and as the word before that."""
    lines = ["the salt water", "the sand castle", "salt goes white", "sand goes brown"]
    train = [(i, lines[k % 4]) for k, i in enumerate(_ids(False)[:200])]
    asked = ["the salt water", "the salt castle", "salt goes white", "salt goes brown"]
    rows = train + list(zip(_ids(True), asked))
    got = {r.doc_id: r for r in lm_score.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), batch_text=500).collect()}
    seen, mixed, seen_far, mixed_far = (got[i].score for i in _ids(True)[:4])
    assert seen > mixed + 0.7 and seen_far > mixed_far + 0.7


def test_lm_score_by_hand(spark):
    """One training text of distinct words: each cell holds one customer at one table, so nothing is drawn."""
    known, new = _ids(False)[0], _ids(True)[0]
    got = {r.doc_id: r.score for r in lm_score.score_texts(spark.createDataFrame([(known, "a B c"), (new, "b x")], "doc_id bigint, text string")).collect()}
    d = 0.95
    word, unknown, back = (1 - d + (1 + 4 * d) / 5) / 5, (1 + 4 * d) / 25, (1 + d) / 2
    p = (1 - d) / 2 + back * word
    assert abs(got[known] - 4 * math.log10((1 - d) / 2 + back * p)) < 1e-5
    assert abs(got[new] - math.log10(back * back * word * back * unknown * word)) < 1e-5


def test_lm_cells_of_groups_and_buckets(monkeypatch):
    """Every pair of words before and word is counted once, however texts fall into groups and buckets."""
    rows = [t for _, t in corpus()]
    tokens = [["<s>", "<s>", *re.findall(r"[^\x20\x09-\x0D]+", low(t)), "<e>"] for t in rows]
    want = Counter(x for t in tokens for x in zip(t, t[1:], t[2:]))
    monkeypatch.setattr(lm_score.TaskContext, "get", lambda: type("C", (), {"partitionId": lambda self: 3})())
    monkeypatch.setattr(lm_score, "GROUP", 50)
    batch = pa.RecordBatch.from_pydict({"doc": pa.array(range(len(rows)), pa.int64()), "text": pa.array(rows, pa.string()), "held_out": [False] * len(rows)})
    found = pa.Table.from_batches(list(lm_score._messages(4, True)(iter([batch, batch])))).filter(pa.compute.field("kind") == 1)
    counts = []
    for p in range(4):
        part = found.filter(pa.compute.field("p") == p)
        if part.num_rows:
            counts += lm_score.Bucket(list(part.column("data"))).n.tolist()
    assert sorted(counts) == sorted(2 * n for n in want.values())


@pytest.mark.parametrize(("c", "a", "d"), [(2, 0.3, 0.5), (20, 0.5, 0.4), (60, 2.0, 0.8), (1500, 100.0, 0.8)])
def test_lm_seating_follows_its_weights(c, a, d):
    """Mean tables against the weights S(c, t) * a**t."""
    weight = np.full(c + 2, -np.inf)
    weight[0] = 0.0
    for i in range(c):
        t = np.arange(1, i + 2)
        after = np.full(c + 2, -np.inf)
        with np.errstate(divide="ignore"):
            after[1 : i + 2] = np.logaddexp(weight[: i + 1], np.log(np.maximum(i - d * t, 0.0)) + weight[1 : i + 2])
        weight = after
    t = np.arange(1, c + 1)
    weight = weight[1 : c + 1] + t * np.log(a)
    weight = np.exp(weight - weight.max())
    many = 10_000 if c < 100 else 400
    got = lm_score.seat(np.full(many, c), np.full(many, a), d, np.random.default_rng(0))
    assert abs(got.mean() / (weight @ t / weight.sum()) - 1) < 0.06


# quality


def test_quality_network(spark, docs, empty):
    rng = np.random.default_rng(0)
    plain = [(i, " ".join(rng.choice(["ra", "ton", "mil", "sta"], 40))) for i in range(300)]
    junk = [(i, t.replace(" ", "!! ")) for i, t in ((k + 300, plain[k][1]) for k in range(300))]
    frame = spark.createDataFrame(plain + junk, SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(600)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    net = quality.fit(frame, labels)
    got = quality.quality_scores(frame, net, ["doc_id"]).withColumn("h", quality.held_out("doc_id")).filter("h").collect()
    assert np.mean([(r.score >= 0.3) == (r.doc_id < 300) for r in got]) > 0.95
    odd = quality.quality_scores(docs.drop("score"), net, ["doc_id"]).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.quality_scores(empty, net, ["doc_id"]).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    none = quality.fit(frame, labels.filter("false"))
    assert {round(r.score, 3) for r in quality.quality_scores(frame, none, ["doc_id"]).collect()} == {0.5}


def test_quality_chunks_cover_the_text():
    """A mark at any place, the last byte of a long text included, reaches the pooled values."""
    net = quality.new_network()
    for size in (1, 7, 8, 9, 1000):
        base = quality.pooled(net, np.full(size, 97, dtype=np.uint8), np.array([0, size]))
        net_w = {**net, "W": np.abs(net["W"]), "E": np.zeros_like(net["E"])}
        net_w["E"][33] = 1
        for at in (0, size // 2, size - 1):
            text = np.full(size, 97, dtype=np.uint8)
            text[at] = 33
            assert (quality.pooled(net_w, text, np.array([0, size])) > 0).all()
        assert base.shape == (1, quality.FILTERS)


def test_quality_trains_on_whole_texts(spark):
    """What tells the classes apart stands in the middle of texts of several pieces."""
    rng = np.random.default_rng(3)
    plain = [" ".join(rng.choice(["ra", "ton", "mil"], 12000)) for _ in range(80)]
    rows = [(i, t if i % 2 else t[:20000] + "!!!! " * 20 + t[20000:]) for i, t in enumerate(plain)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, quality int")
    net = quality.fit(spark.createDataFrame(rows, SCHEMA), labels)
    for mark, good in (("", True), ("!!!! " * 20, False)):
        raw = np.frombuffer((plain[0][:3000] + mark + plain[0][3000:6000]).encode(), dtype=np.uint8)
        assert (quality.probability(net, raw, np.array([0, len(raw)]))[0] > 0.5) == good


def test_quality_winners_by_pieces(monkeypatch):
    net, rng = quality.new_network(), np.random.default_rng(4)
    texts = [rng.integers(0, 256, n).astype(np.uint8).tobytes() for n in (0, 1, 300, 7, 64, 65, 1000)]
    whole, at = quality.winners(net, texts)
    monkeypatch.setattr(quality, "PIECE_BYTES", 64)
    value, window = quality.winners(net, texts)
    assert np.allclose(value, whole, atol=1e-5) and (window == at).all()
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    pooled = quality.pooled(net, raw, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert np.allclose(np.maximum(value, 0), pooled, atol=1e-5)


# decontamination


def test_decontamination(spark, docs, empty):
    rows = corpus()
    items = [(1, rows[0][1]), (2, " ".join(rows[1][1].split(" ")[3:20])), (3, "one two"), (4, None), (5, "..."), (6, "nowhere at all is this seen"), (2, "second text of item"), (None, "one two")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {}
    for i, t in rows:
        for k, x in items:
            if i is None or k is None or not words(x):
                continue
            width = min(5, len(words(x)))
            w = words(t)
            have = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)}
            need = shingles(x)
            if len(need & have) >= 0.8 * len(need) - 1e-9:
                want[i, k] = max(want.get((i, k), 0), len(need & have) / len(need))
    for block in (20_000, 2):
        got = decontaminate.contained_items(docs, bench, item_block=block).collect()
        assert {(r.doc_id, r.item_id): r.containment for r in got} == want and len(got) == len(want)
    assert decontaminate.contained_items(empty, bench).count() == 0
    assert decontaminate.contained_items(docs, bench.filter("false")).count() == 0
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}


# n-gram join


def brute_classes(rows, threshold=0.8):
    once = sorted({(i, t or "") for i, t in rows if i is not None})
    sets = [shingles(t) for _, t in once]
    links = defaultdict(set)
    for a in range(len(once)):
        for b in range(len(once)):
            if a != b and sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b)
    out = []
    for a in range(len(once)):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out.append((once[a][0], min(once[b][0] for b in seen), len(links[a])))
    return sorted(out)


@pytest.mark.parametrize("block", [512, 2])
def test_ngram_join(docs, block, monkeypatch):
    """Whole groups in one task, and groups cut into blocks, give the brute-force classes and link counts."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join.in_block_pairs, "__defaults__", (block,))
    got = sorted(map(tuple, ngram_join.near_duplicates(docs).collect()))
    assert got == brute_classes(corpus())


def test_edges_of_a_large_group_do_not_follow_its_pairs_of_blocks(spark):
    """Near copies compared in 20 blocks: one edge a set and at most one a pair of blocks, and all are connected."""
    from cohortloom.operators.graph import connected_components

    rng = np.random.default_rng(4)
    base, n, block = rng.integers(1, 255, ngram_join.BINS), 1000, 50
    rows = []
    for i in range(n):
        sketch = base.copy()
        sketch[rng.integers(0, ngram_join.BINS, 3)] = 7
        rows.append((bytearray(i.to_bytes(4, "big")), 1, n, 200, bytearray(sketch.astype(np.uint8).tobytes())))
    met = spark.createDataFrame(rows, "set_id binary, leaf bigint, n bigint, size bigint, sketch binary")
    dealt = tx.grouped_rows(ngram_join.in_block_pairs(met, "leaf", "n", "set_id", block).select("bucket", "side", "set_id", "size", "sketch"), "bucket", "set_id")
    edges = dealt.mapInArrow(ngram_join._likely(0.8), "a binary, b binary").distinct()
    assert n - 1 <= edges.count() < 1.5 * n
    assert connected_components(edges, "a", "b").select("component").distinct().count() == 1


def test_ngram_join_odd_tables(spark, docs, empty):
    assert ngram_join.near_duplicates(empty).count() == 0
    kept = ngram_join.keep_one(docs)
    classes = {c for _, c, _ in brute_classes(corpus())}
    assert {r.doc_id for r in kept.collect()} == classes | {None} and kept.columns == docs.columns


def test_one_id_on_two_texts(spark):
    """A class loses all rows but one, and a text that shares its id with a dropped one stays."""
    x, y = "one two three four five six seven", "a text of its own that nothing else is like"
    rows = [(3, x), (3, x), (7, x), (7, y)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, ngram_join.keep_one(frame).collect())) == [(3, x), (7, y)]
    bench = spark.createDataFrame([(1, x)], "item_id bigint, text string")
    assert [tuple(r) for r in decontaminate.drop_contaminated(frame, bench).collect()] == [(7, y)]


def test_runs_reach_the_recall():
    assert ngram_join.runs_for(0.8, 0.99) > ngram_join.runs_for(0.8, 0.9) > 1


def test_contained_sets_at_the_threshold_meet():
    """Isolated pairs where one set is the other less a fifth of it: similarity 0.8, sizes as unequal as they can be."""
    rng = np.random.default_rng(11)
    pairs, large, small = 2000, 50, 40
    h = rng.integers(0, 1 << 63, (pairs, large)).astype(np.uint64)
    sizes = np.tile([large, small], pairs)
    both = np.concatenate([h, h[:, :small]], axis=1).ravel()
    runs = ngram_join.runs_for(ngram_join.THRESHOLD, ngram_join.TARGET_RECALL)
    who, leaf = ngram_join.leaves(both, np.repeat(np.arange(2 * pairs), sizes), sizes, runs, ngram_join.THRESHOLD)
    reached = set(zip(who.tolist(), leaf.tolist(), strict=True))
    met = {w // 2 for w, x in reached if w % 2 and (w - 1, x) in reached}
    assert len(met) >= 0.995 * pairs


# licenses


def test_license_scan(spark, docs, empty):
    mit = license_scan.TEMPLATES[0][1]
    rows = [
        *corpus(), (900, "x " + mit.upper() + " y"), (901, "Licensed under the GNU  General-Public License. MIT license! mit license"),
        (902, " ".join(mit.split()[:10]) + " zzz " + " ".join(mit.split()[11:])), (903, "the software and the license of this"),
    ]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for i, t in rows:
        w = words(t)
        places, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            found = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        want.append((str(i), len(w), len(places), str(min(places, default=None)), str(max(places, default=None)), ",".join(sorted(labels))))
    assert sorted((str(r[0]), r[1], r[2], str(r[3]), str(r[4]), r[5]) for r in got) == sorted(want)
    by_id = {r.doc_id: r for r in got}
    assert "mit" in by_id[900].labels.split(",") and by_id[900].score == 1.0
    assert "mit" in by_id[902].labels.split(",") and 0.9 < by_id[902].score < 1 and by_id[903].labels == ""
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in got)
    assert license_scan.scan_licenses(empty).count() == 0 and license_scan.scan_licenses(docs).count() == docs.count()


def test_suffix_automaton_statistics():
    automaton = license_scan.SuffixAutomaton()
    texts = [[1, 2, 1, 3, 2, 1], [3, 2, 1, 1, 2], [1, 2, 1, 3, 2, 1]]
    for k, t in enumerate(texts):
        automaton.add(t, k)
    probe = np.random.default_rng(5).integers(1, 5, 400).tolist()

    def held(run):
        return any(t[i : i + len(run)] == run for t in texts for i in range(len(t)))

    for i, (length, _) in enumerate(automaton.statistics(probe)):
        assert length == max(n for n in range(i + 2) if n == 0 or (n <= 6 and held(probe[i + 1 - n : i + 1])))


# mixing


def test_mixing(spark, docs, empty):
    rng = np.random.default_rng(0)
    kinds = {0: ["ra", "ton", "mil"], 1: ["ra%%%", "ton%%%"], 2: ["ra", "ton", "idiot"]}
    rows = [(i, " ".join(rng.choice(kinds[i % 3], 50))) for i in range(600)]
    frame = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 2)) for i in range(300)], "doc_id bigint, quality int, toxic int")
    got = mixing.mix_documents(frame, labels).collect()
    total = sum(r.n_tokens for r in got)
    for d in mixing.DOMAINS:
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) / total - mixing.TARGETS[d]) < 5e-3
    assert all(r.rate >= 0 for r in got) and max(r.rate for r in got if r.doc_id % 3 == 2) < 0.05
    assert mixing.mix_documents(docs, labels, keep=["doc_id", "source"]).count() == docs.count()
    assert mixing.mix_documents(empty, labels).count() == 0
    assert {r.rate for r in mixing.mix_documents(frame.limit(5), labels.filter("false")).collect()} and True


def test_mixing_trains_on_whole_texts(spark):
    """The passage that makes a text toxic counts where it stands in the middle of a long one."""
    rng = np.random.default_rng(2)
    plain = [" ".join(rng.choice(["ra", "ton", "mil"], 6000)) for _ in range(60)]
    rows = [(i, t if i % 2 else t[:11000] + " idiot " + t[11000:]) for i, t in enumerate(plain)]
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(60)], "doc_id bigint, quality int, toxic int")
    model = mixing.fit(spark.createDataFrame(rows, SCHEMA), labels)
    raw = b"ra ton idiot"
    assert mixing.posteriors(model, np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))[0][0, 2] > 0.9


def test_mixing_fills_its_sample_from_documents(spark):
    """Labelled ids without a document take no place in the bounded sample; another table can be trained on."""
    frame = spark.createDataFrame([(i, "ra ton" if i % 2 else "ra%%% mil") for i in range(20)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id bigint, quality int, toxic int")
    assert len(mixing.fit(frame, labels, rows=20)["buckets"]) and abs(mixing.fit(frame, labels, rows=20)["W"]).max() > 0.1
    good = frame.filter("doc_id % 2 = 1")
    got = mixing.mix_documents(good, labels, training=frame).collect()
    assert len(got) == 10 and min(r.p_high for r in got) > 0.9 and max(r.p_low for r in got) > 1e-6


def test_projected_gradient_meets_targets(spark):
    """Targets that force rates to zero are neared; those that do not are met in one step."""
    rows = [(100, 1.0, 0.0, 0.0), (80, 0.0, 0.9, 0.1), (50, 0.5, 0.5, 0.0), (0, 0.2, 0.2, 0.6), (60, 0.0, 0.1, 0.9)]
    frame = spark.createDataFrame(rows, "n bigint, a double, b double, c double")
    p, n = np.array([r[1:] for r in rows]), np.array([r[0] for r in rows])
    for aim, steps, near in (([0.5, 0.3, 0.2], 1, 1e-9), ([0.7, 0.3, 0.0], 60, 0.01)):
        history = mixing.solve_rates(frame, ["a", "b", "c"], "n", aim, steps=steps, tolerance=1e-12)
        got = {r.n: r.rate for r in mixing.with_rates(frame, ["a", "b", "c"], history).collect()}
        rate = np.array([got[x] for x in n])
        assert rate.min() >= 0
        assert np.abs((p * n[:, None]).T @ rate / n.sum() - aim).max() < near


def test_rates_near_a_target_out_of_reach(spark):
    """With a target out of reach, the totals come nearer than 3,000 plain steps on every row take them."""
    rng = np.random.default_rng(11)
    p = rng.dirichlet([2.0, 0.4, 0.4], 3000)
    n = rng.integers(1, 400, 3000)
    frame = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n bigint, a double, b double, c double")
    aim = np.array([0.9, 0.1, 0.0])
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        history = mixing.solve_rates(frame, ["a", "b", "c"], "n", aim.tolist())
    got = np.array([r.rate for r in mixing.with_rates(frame, ["a", "b", "c"], history).collect()])
    weight = n / n.sum()
    rate, slope = np.ones(len(n)), p @ np.linalg.inv((p * weight[:, None]).T @ p)
    for _ in range(3000):
        rate = np.maximum(0, rate - slope @ ((p * weight[:, None]).T @ rate - aim))
    off, best = (np.abs((p * weight[:, None]).T @ x - aim).max() for x in (got, rate))
    assert got.min() >= 0 and off < min(best, 1.5e-3)


def test_the_grid_of_posteriors_is_bounded_and_keeps_all_sums(spark):
    rng = np.random.default_rng(4)
    p, n = rng.dirichlet([0.5] * 3, 2000), rng.integers(0, 9, 2000)
    frame = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n bigint, a double, b double, c double")
    means, weights, gram = mixing.fold(frame, ["a", "b", "c"], "n", cells=100)
    assert len(weights) <= 100 and weights.sum() == n.sum()
    assert np.allclose((means * weights[:, None]).sum(0), (p * n[:, None]).sum(0)) and np.allclose(gram, (p * n[:, None]).T @ p)


def test_rates_that_miss_their_targets_are_reported(spark):
    rows = [(100, 0.8, 0.1, 0.1), (80, 0.3, 0.5, 0.2), (60, 0.2, 0.1, 0.7)]
    frame = spark.createDataFrame(rows, "n bigint, a double, b double, c double")
    with pytest.warns(UserWarning, match="off its target"):
        mixing.solve_rates(frame, ["a", "b", "c"], "n", [0.9, 0.1, 0.0], steps=2)


def test_given_columns_keep_their_values_whatever_their_names(spark):
    """Columns called like the operators' own come back as they were, from both document filters."""
    x = "one two three four five six seven eight nine ten"
    frame = spark.createDataFrame([(1, x, "a", "b", "c"), (2, x + " !", "d", "e", "f"), (3, "quite another text of several words here", "g", "h", "i")], "doc_id bigint, text string, _doc string, mark string, row string")
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns and sorted(map(tuple, kept.collect()))[0] == (1, x, "a", "b", "c") and kept.count() == 2
    bench = spark.createDataFrame([(1, "another text of several words")], "item_id bigint, text string")
    clean = decontaminate.drop_contaminated(frame.withColumnRenamed("mark", "_id_text"), bench)
    assert sorted(r["_id_text"] for r in clean.collect()) == ["b", "e"] and clean.columns[3] == "_id_text"


def test_conflicting_labels_have_an_order(spark):
    """The labels of one id in any order of rows train the same model."""
    texts = spark.createDataFrame([(i, f"text number {i} " + ("good words" if i % 2 else "bad words") * 5) for i in range(40)], "doc_id bigint, text string")
    rows = [(i, i % 2, 0) for i in range(40)] + [(3, 0, 1), (5, 0, 0), (None, 1, 0), (7, None, 0)]
    nets = []
    for order in (rows, rows[::-1]):
        labels = spark.createDataFrame(order, "doc_id bigint, quality int, toxic int").repartition(3)
        nets.append(quality.fit(texts, labels))
    assert all((nets[0][k] == nets[1][k]).all() for k in nets[0])


def test_license_spans_count_words():
    """What a span covers is a number of words, and a text of very many notices is chained in one pass."""
    import time

    words = {w: i for i, w in enumerate("permission is hereby granted free of charge to any person".split())}
    template = list(words.values())
    started = time.perf_counter()
    top = license_scan.chain([(20 * i, len(template)) for i in range(20_000)], (template + [99] * (20 - len(template))) * 20_000, template, 3)
    assert top[0] >= len(template) and time.perf_counter() - started < 20


def test_license_scan_of_whole_and_long_texts(spark):
    """Whole licence texts with changed words keep their label; thousands of notices in one text take time in proportion."""
    bsd = max((t for label, t in license_scan.TEMPLATES if label == "bsd"), key=len).split()
    changed = [w if i % 60 != 30 else "regents" for i, w in enumerate(bsd)]
    notice = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated. "
    rows = [(1, "intro " + " ".join(changed) + " outro"), (2, notice * 16_000), (3, " ".join(bsd[:40]))]
    start = time.monotonic()
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert time.monotonic() - start < 120
    assert got[1].labels == "bsd" and got[1].score == 1.0  # its opening sentence stands whole, the text only in part
    assert 0.9 * len(bsd) < max(s.covered for s in got[1].spans) < len(bsd)
    assert got[2].n_words == 16_000 * len(notice.split()) and len(got[2].spans) >= 16_000
    assert got[3].labels == "bsd" and got[3].score == 1.0  # its opening sentence stands whole
