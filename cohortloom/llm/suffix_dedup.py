"""Removal of repeated byte strings by a hash-compared suffix sort.

Every string of ``LENGTH`` bytes has an anchor, the leftmost least hash among its ``GRAM``-byte pieces. Equal strings have equal
anchors at equal places, so strings that start near one anchor (its context) need comparing with the contexts of equal
anchors only. Contexts that occur several times as a whole are settled by counting, contexts with an anchor of their
own are clean, and both need no sort. The remaining ones, where a repeated passage begins or ends, are sorted: all
their suffixes, by a bottom-up mergesort in which two suffixes are compared through their longest common extension,
found by binary search over prefix polynomial hashes. Neighbours that agree on ``LENGTH`` bytes are verified byte by byte.
Anchors with more than ``GROUP`` different contexts are not sorted in one task: stretches of ``BAND`` starts
at one distance from the anchor are counted by a 128-bit hash, merged map-side; only stretches that occur once, and one of
each that occurs more often, are opened into single strings, which are counted alike. That is exact for groups of any size.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import textops as tx
from cohortloom.llm.stored import written

LENGTH, GRAM, GROUP, BAND = 200, 80, 32, 16
_BLOCK, _OUTPUT = 1 << 20, 1 << 21
_PLACE = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, first start, last start, anchor hash, context hash) of every maximal run of starts with one anchor."""
    if len(data) < length:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z.view(np.uint64), z.view(np.uint64)
    prefix = tx.prefix_hashes(data)
    places = np.arange(len(data) - gram + 1)
    hashed = tx.mix(tx.span_hashes(prefix, places, places + gram))
    low = (hashed & ~_PLACE) | places.astype(np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    lengths = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(lengths)), lengths)
    start = np.arange(len(row)) + np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(lengths)])[:-1], lengths)
    at = (low[start] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, dtype=np.int64)
    last = np.concatenate([first[1:] - 1, [len(row) - 1]]) if len(first) else first
    begin, end, anchor = start[first], start[last], at[first]
    context = tx.mix(tx.span_hashes(prefix, begin, end + length) + tx.mix(((anchor - begin) * 1024 + (end - begin)).astype(np.uint64)))
    return row[first], begin, end, hashed[anchor], context


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, _, data, offsets in tx.slices(batch.column("bytes")):
            # a text longer than a block is cut into blocks of starts that overlap by one string
            blocks = [(0, data, offsets)] if len(data) <= 2 * _BLOCK else [
                (low, data[low : low + _BLOCK + LENGTH - 1], None) for low in range(0, len(data), _BLOCK)
            ]
            for shift, part, bounds in blocks:
                bounds = np.array([0, len(part)]) if bounds is None else bounds
                row, begin, end, anchor, context = anchors(part, bounds)
                local = begin - bounds[row] + shift
                pick = pa.array(first + row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").take(pick), batch.column("mark").take(pick), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)),
                        pa.array(local.astype(np.int64)), pa.array((end - begin).astype(np.int64)),
                    ],
                    ["doc", "mark", "anchor", "context", "start", "more"],
                )


class Suffixes:
    """Suffixes of a buffer, compared on up to ``length`` bytes through prefix hashes."""

    def __init__(self, data: np.ndarray, length: int = LENGTH) -> None:
        self.data, self.length = data, length
        self.prefix = tx.prefix_hashes(data)
        self.power = tx.powers(0x9E3779B97F4A7C15, len(data) + 1)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, by binary search on hash equality."""
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), self.length)
        head_a, head_b, pa_, pb = self.prefix[a], self.prefix[b], self.power[a], self.power[b]
        for _ in range(int(self.length).bit_length()):
            middle = (low + high + 1) >> 1
            same = (self.prefix[a + middle] - head_a) * pa_ == (self.prefix[b + middle] - head_b) * pb
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix a goes before suffix b; equal ones as ``ties`` says."""
        n = self.extension(a, b)
        end = n >= self.length
        n = np.where(end, 0, n)
        return np.where(end, ties, self.data[a + n] < self.data[b + n])

    def sorted_within(self, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Suffixes sorted inside each group (groups are contiguous) by bottom-up mergesort, all merges of a level at once."""
        out = suffix.copy()
        first = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
        begin = np.repeat(first, np.diff(np.concatenate([first, [len(group)]])))
        end = np.repeat(np.concatenate([first[1:], [len(group)]]), np.diff(np.concatenate([first, [len(group)]])))
        most, run, place = int((end - begin).max()), 1, np.arange(len(group))
        while run < most:
            inside = place - begin
            own = begin + inside // run * run
            left = inside // run % 2 == 0
            other = np.where(left, own + run, own - run)
            live = np.flatnonzero(other < end)
            low, high = other[live].copy(), np.minimum(other[live] + run, end[live])
            base = low.copy()
            busy = np.arange(len(live))
            while len(busy):
                middle = (low[busy] + high[busy]) >> 1
                # an element of the left run goes before equal ones of the right run
                passes = self.before(out[middle], out[live[busy]], ~left[live[busy]])
                low[busy] = np.where(passes, middle + 1, low[busy])
                high[busy] = np.where(passes, high[busy], middle)
                busy = busy[low[busy] < high[busy]]
            target = place.copy()
            target[live] = np.minimum(own[live], other[live]) + (live - own[live]) + (low - base)
            merged = np.empty_like(out)
            merged[target] = out
            out = merged
            run *= 2
        return out

    def equal_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), dtype=bool)
        for low in range(0, len(a), 20_000):
            i, j = a[low : low + 20_000, None], b[low : low + 20_000, None]
            at = np.arange(self.length)
            out[low : low + 20_000] = (self.data[i + at] == self.data[j + at]).all(1)
        return out


def repeated_starts(data: np.ndarray, suffix: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Mask over ``suffix``: another suffix of its group (contiguous) agrees on ``length`` bytes."""
    out = np.zeros(len(suffix), dtype=bool)
    if len(suffix) < 2:
        return out
    texts = Suffixes(data, length)
    order = texts.sorted_within(suffix, group)
    near = np.flatnonzero(group[1:] == group[:-1])
    near = near[texts.extension(order[near], order[near + 1]) >= length]
    sure = texts.equal_bytes(order[near], order[near + 1])
    hit = np.zeros(len(suffix), dtype=bool)
    hit[near[sure]] = hit[near[sure] + 1] = True
    by_place = np.argsort(suffix, kind="stable")
    out[by_place] = hit[np.argsort(order, kind="stable")]
    for g in np.unique(group[near[~sure]]):  # a hash collision: compare the group's strings themselves
        members = np.flatnonzero(group == g)
        raw = [data[s : s + length].tobytes() for s in suffix[members]]
        out[members] = [raw.count(x) > 1 for x in raw]
    return out


def _runs(doc, mark, key: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Rows (doc, mark, from, to) of the bytes covered by strings at consecutive starts of one key."""
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)])) if len(key) else np.zeros(0, dtype=np.int64)
    last = np.concatenate([first[1:] - 1, [len(key) - 1]]) if len(first) else first
    pick = pa.array(key[first])
    return pa.RecordBatch.from_arrays([doc.take(pick), mark.take(pick), pa.array(start[first]), pa.array(start[last] + LENGTH)], ["doc", "mark", "lo", "hi"])


def _sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in tx.whole_groups(batches, "anchor"):
        table = table.combine_chunks()
        anchor = table.column("anchor").to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
        low = 0
        while low < len(bounds) - 1:  # about 1000 contexts at once
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + 1000)) - 1)
            part = table.slice(bounds[low], bounds[high] - bounds[low])
            low = high
            data, offsets = tx.byte_column(part.column("piece"))
            n = part.column("more").to_numpy() + 1
            item = np.repeat(np.arange(part.num_rows), n)
            inner = np.arange(len(item)) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
            suffix = offsets[:-1][item] + inner
            shift = part.column("shift").to_numpy()[item] - inner  # bytes from the string's start to its anchor
            _, group = np.unique(part.column("anchor").to_numpy(), return_inverse=True)
            key = group[item] * 1024 + shift
            order = np.argsort(key, kind="stable")
            hit = np.zeros(len(item), dtype=bool)
            hit[order] = repeated_starts(data, suffix[order], key[order])
            yield _runs(part.column("doc").combine_chunks(), part.column("mark").combine_chunks(), item[hit], part.column("start").to_numpy()[item[hit]] + inner[hit])


def _opened(width: int):
    """Stretches of up to ``width`` starts of the contexts, cut where the distance to the anchor passes a multiple of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                item, start, more, shift, pieces, digest = [], [], [], [], [], []
                rows = zip(*(part.column(c).to_pylist() for c in ("piece", "start", "more", "shift")), strict=True)
                for k, (piece, begin, count, ahead) in enumerate(rows):
                    i = 0
                    while i <= count:
                        last = min(count, i + (ahead - i) % width)
                        stretch = piece[i : last + LENGTH]
                        item.append(k)
                        start.append(begin + i)
                        more.append(last - i)
                        shift.append(ahead - i)
                        pieces.append(stretch)
                        digest.append(xxhash.xxh3_128_digest(b"%d %d " % (ahead - i, last - i) + stretch))
                        i = last + 1
                pick = pa.array(item, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc").take(pick), part.column("mark").take(pick), pa.array(start, pa.int64()), pa.array(more, pa.int64()),
                        pa.array(shift, pa.int64()), pa.array(pieces, pa.binary()), pa.array(digest, pa.binary()),
                    ],
                    ["doc", "mark", "start", "more", "shift", "piece", "digest"],
                )

    return run


_OPENED = "doc bigint, mark bigint, start bigint, more bigint, shift bigint, piece binary, digest binary"


def _covered(rows: DataFrame) -> DataFrame:
    return rows.select("doc", "mark", F.col("start").alias("lo"), (F.col("start") + F.col("more") + LENGTH).alias("hi"))


def _merged(lo: np.ndarray, hi: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, row) of the unions of overlapping or touching spans of each row."""
    if not len(lo):
        return lo, hi, row
    order = np.lexsort((lo, row))
    lo, hi, row = lo[order], hi[order], row[order]
    wide = np.int64(max(int(hi.max()), 1) + 1)  # rows laid end to end, with a byte between them
    reach = np.maximum.accumulate(hi + row * wide)
    first = np.flatnonzero(np.concatenate([[True], lo[1:] + row[1:] * wide > reach[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(lo) - 1]])
    return lo[first], reach[last] - row[last] * wide, row[first]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of every text, in slices of about ``_OUTPUT`` bytes: one copy of a slice is made, its kept bytes."""
    for batch in batches:
        spans = batch.column("spans")
        for first, end, data, offsets in tx.slices(batch.column("bytes"), _OUTPUT):
            part = spans.slice(first, end - first)
            row = np.repeat(np.arange(end - first), pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))
            flat = part.flatten()
            lo, hi, row = _merged(flat.field("lo").to_numpy(), flat.field("hi").to_numpy(), row)
            edge = np.zeros(len(data) + 1, dtype=np.int8)  # merged spans of a text neither meet nor overlap
            np.add.at(edge, offsets[row] + lo, 1)
            np.add.at(edge, offsets[row] + hi, -1)
            keep = np.cumsum(edge[:-1], dtype=np.int8) == 0
            removed = np.bincount(row, weights=hi - lo, minlength=end - first).astype(np.int64)
            left = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)])
            kept = memoryview(data[keep])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").slice(first, end - first), pa.array(np.diff(offsets)), pa.array(removed),
                    pa.array(np.bincount(row, minlength=end - first).astype(np.int64)),
                    pa.array([hashlib.sha256(kept[i:j]).hexdigest() for i, j in itertools.pairwise(left.tolist())], pa.string()),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(kept)]).cast(pa.binary()),
                ],
                ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, mark, lo, hi): stretches of bytes to remove, overlapping, from rows (doc, mark, bytes)."""
    found = docs.mapInArrow(_anchor_rows, "doc bigint, mark bigint, anchor bigint, context bigint, start bigint, more bigint")
    shared = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("a"), F.max("context").alias("b")).filter("n > 1")
    met = written(found.join(shared.select("anchor", (F.col("a") == F.col("b")).alias("alike")), "anchor"))
    settled = met.filter("alike")
    open_ = met.filter("not alike")
    contexts = open_.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "mark", "start", "more")).alias("at"))
    twice = open_.join(contexts.filter("n > 1").select("anchor", "context"), ["anchor", "context"])
    whole = settled.drop("alike").unionByName(twice.drop("alike").select(*[c for c in settled.columns if c != "alike"]))
    covered = _covered(whole)
    sizes = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"))
    asked = contexts.join(sizes, "anchor").select("anchor", "m", "at.*")
    pieces = written(
        docs.join(asked, ["doc", "mark"])
        .select("doc", "mark", "anchor", "m", "start", "more", F.substring("bytes", F.col("start").cast("int") + 1, (F.col("more") + LENGTH).cast("int")).alias("piece"))
        .distinct()
    )
    placed = pieces.mapInArrow(_with_shift, "doc bigint, mark bigint, anchor bigint, m bigint, start bigint, more bigint, piece binary, shift bigint")
    spans = tx.grouped_rows(placed.filter(F.col("m") <= GROUP).drop("m"), "anchor").mapInArrow(_sort_groups, "doc bigint, mark bigint, lo bigint, hi bigint")
    stretches = placed.filter(F.col("m") > GROUP).mapInArrow(_opened(BAND), _OPENED)
    place = F.struct("doc", "mark", "start")
    counted = stretches.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    met = stretches.join(counted, "digest")
    strings = met.filter((F.col("n") == 1) | (place == F.col("first"))).select(*stretches.columns).mapInArrow(_opened(1), _OPENED)
    many = strings.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    return (
        covered.unionByName(spans).unionByName(_covered(met.filter("n > 1"))).unionByName(_covered(strings.join(many, "digest")))
    )


def _with_shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes from each context's first start to its anchor, found again from its own bytes."""
    for batch in batches:
        for first, end, data, offsets in tx.slices(batch.column("piece"), _OUTPUT):
            part = batch.slice(first, end - first)
            prefix = tx.prefix_hashes(data)
            shift = np.zeros(part.num_rows, dtype=np.int64)
            want = part.column("anchor").to_numpy().view(np.uint64)
            left = np.arange(part.num_rows)
            reach = np.diff(offsets) - GRAM
            for k in range(int(reach.max()) + 1):
                at = offsets[left] + k
                same = tx.mix(tx.span_hashes(prefix, at, at + GRAM)) == want[left]
                shift[left[same]] = k
                left = left[~same & (reach[left] > k)]
                if not len(left):
                    break
            columns = [part.column(c) for c in ("doc", "mark", "anchor", "m", "start", "more", "piece")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shift)], ["doc", "mark", "anchor", "m", "start", "more", "piece", "shift"])


def drop_repeated_strings(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` is binary.

    A byte is removed if a string of ``LENGTH`` bytes over it also starts anywhere else, in the same row or another; all
    occurrences are removed, judged on the input. Texts are UTF-8 bytes; null is empty. Rows repeated with the same id and
    text are different places of the same strings, so they lose all that a string covers. Null ids are documents like
    others. Further columns are ignored.
    """
    rows = tx.bounded_batches(documents.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("doc"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"),
    ), 8 << 20).withColumn("mark", F.xxhash64("bytes"))
    spans = repeated_spans(rows.select("doc", "mark", "bytes"))
    listed = spans.groupBy("doc", "mark").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return (
        rows.join(listed, ["doc", "mark"], "left").select("id", "bytes", "spans")
        .mapInArrow(_cut, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
        .withColumnRenamed("id", id_col)
    )
