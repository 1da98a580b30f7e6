"""Byte-level text helpers on Arrow batches: words, hashes and shingles as flat numpy arrays.

All hashes are 64-bit numbers modulo 2**64. Texts are handled in slices of about two million bytes, so
the memory of a task does not follow the size of its Arrow batch. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 2_000_000
BATCH_BYTES = 64 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, letters and every byte of a non-ASCII character (upper case is lowered first).
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
#: Bytes of whitespace-separated tokens.
TOKEN_BYTE = np.ones(256, dtype=bool)
TOKEN_BYTE[9:14] = TOKEN_BYTE[32] = False

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bounded_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """Keep the Arrow batches of very long texts small in bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return df


def mix(h: np.ndarray) -> np.ndarray:
    """A well spread bijection of 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        full[0] = 1
        have = _powers[base] = np.cumprod(full, dtype=np.uint64)
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * base**-i: the hash of any span follows from two of them."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_INVERSE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] per span; equal bytes give equal numbers wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(_BASE, len(prefix))[start]


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]] if len(column) else data[:0], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) in slices of about ``most`` bytes; a longer text is one slice."""
    data, offsets = byte_column(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        end = min(end, rows, first + 20_000)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of member bytes; no run crosses a text."""
    inside = member[data]
    lengths = np.diff(offsets)
    full = offsets[:-1][lengths > 0]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[full] = False
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[offsets[1:][lengths > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every lower-cased word."""
    start, end, row = spans(data, offsets, member)
    hashed = span_hashes(prefix_hashes(LOWER[data]), start, end)
    return mix(hashed ^ mix((end - start).astype(np.uint64))), row


def word_hash(word: str | bytes) -> np.uint64:
    """The hash that ``words`` gives to one lower-cased word."""
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, dtype=np.uint8)
    return words(raw, np.array([0, len(raw)]), np.ones(256, dtype=bool))[0][0]


def grams(hashes: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of ``width`` consecutive words of one text."""
    n = len(hashes) - width + 1
    if n <= 0:
        return hashes[:0], row[:0]
    total = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        total = mix(total * np.uint64(_BASE) + hashes[k : n + k])
    keep = row[:n] == row[width - 1 :]
    return total[keep], row[:n][keep]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, row), sorted by row and hash, of the word shingles of every text.

    A text of fewer words than ``width`` has one shingle of all its words; a text without words has none.
    """
    hashes, row = words(data, offsets)
    rows = len(offsets) - 1
    per_row = np.bincount(row, minlength=rows)
    parts = [grams(hashes, row, width)]
    for short in range(1, width):
        pick = per_row[row] == short
        if pick.any():
            parts.append(grams(hashes[pick], row[pick], short))
    h, r = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[fresh], r[fresh]


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of complete groups from batches that come sorted by a BIGINT key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(values != values[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def grouped_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of one key in one partition, next to each other."""
    return df.repartition(F.col(key)).sortWithinPartitions(key, *order)


def as_binary(values: np.ndarray) -> pa.Array:
    """A 2-d uint8 array as a binary column."""
    rows, width = values.shape
    flat = np.ascontiguousarray(values, dtype=np.uint8)
    offsets = np.arange(rows + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
