"""SimHash near-duplicates by anchor-point covering.

Fingerprints have 64 bits. The anchors are the words of a covering code: two copies of the perfect binary Golay code
side by side on the first 46 bits (covering radius 3 in each half, so every fingerprint has an anchor within 6 bits).
Two fingerprints at distance 3 or less have a point between them, one bit from the first and two from the second at most;
the anchor that covers this point lies within the covering radius plus one of the first and plus two of the second: the
threshold is shared between the two sides, which keeps the copies of a fingerprint near 60 where the whole threshold on
one side takes 300. So every fingerprint is replicated to all anchors in this reach, and the fingerprints of an anchor are
compared exactly on all 64 bits. Equal fingerprints are folded first; an anchor with many fingerprints is compared as
pairs of parts in separate tasks, which name their parts' roots only, so links do not grow with the number of parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import textops as tx
from cohortloom.llm.components import local_roots, root_links
from cohortloom.llm.stored import written
from cohortloom.operators.graph import connected_components
from cohortloom.operators.skew import join_unique

WIDTH, SEED, DISTANCE = 3, 42, 3
#: Bytes of a text that are cut into words at once, and fingerprints of one anchor that a task compares at once.
PIECE, PART = 1 << 20, 8192
#: Length and covering radius of the code, its generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1.
BITS, RADIUS, GENERATOR = 23, 3, 0b110001110101


def _counted(joined: bytes, ends: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in the hashes of the spans."""
    digest = xxhash.xxh64_intdigest
    count = np.zeros(64, dtype=np.int64)
    for low in range(0, len(begins), 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[low : low + (1 << 16)].tolist(), ends[low : low + (1 << 16)].tolist())], dtype="<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return count


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The unsigned fingerprint of one text; 0 for a null text or one without words. Long texts are read piece by piece."""
    raw = (text or b"").lower()
    count, total, held = np.zeros(64, dtype=np.int64), 0, []
    at = 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        have = held + raw[at:end].split()
        at = end
        if len(have) >= width:
            length = np.fromiter(map(len, have), dtype=np.int64, count=len(have))
            begin = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
            n = len(have) - width + 1
            count += _counted(b" ".join(have), (begin + length)[width - 1 :], begin[:n])
            total += n
            held = have[n:]
        else:
            held = have
    if not total and held:
        count, total = _counted(whole := b" ".join(held), np.array([len(whole)]), np.array([0])), 1
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py(), width) for t in text], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found)], ["doc", "fp"])

    return run


@cache
def _reach() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns up to the covering radius plus two, grouped by syndrome: (first of group, pattern, excess) and syndromes of bytes."""
    syndromes = np.zeros(1 << BITS, dtype=np.int16)
    single = []
    for bit in range(BITS):
        rest = 1 << bit
        for high in range(bit, 10, -1):
            if rest >> high & 1:
                rest ^= GENERATOR << (high - 11)
        single.append(rest)
        syndromes[1 << bit : 2 << bit] = syndromes[: 1 << bit] ^ np.int16(rest)
    weight = np.bitwise_count(np.arange(1 << BITS, dtype=np.uint32))
    pattern = np.flatnonzero(weight <= RADIUS + 2)
    order = np.lexsort((pattern, weight[pattern], syndromes[pattern]))
    pattern = pattern[order]
    first = np.searchsorted(syndromes[pattern], np.arange(2049))
    return first, pattern.astype(np.int64), np.maximum(weight[pattern].astype(np.int64) - RADIUS, 0), syndromes


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, excess) of every anchor within reach: ``excess`` bits (0 to 2) beyond the covering radius, both halves together."""
    first, pattern, excess, syndromes = _reach()
    mask = np.int64((1 << BITS) - 1)
    parts = [(fps & mask), ((fps >> np.int64(BITS)) & mask)]
    rows = np.arange(len(fps))
    row, anchor, total = rows, np.zeros(len(fps), dtype=np.int64), np.zeros(len(fps), dtype=np.int64)
    for i, part in enumerate(parts):
        group = syndromes[part[row]].astype(np.int64)
        many = first[group + 1] - first[group]
        owner = np.repeat(np.arange(len(row)), many)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[group], many)
        more = total[owner] + excess[at]
        keep = more <= DISTANCE - 1
        owner, at = owner[keep], at[keep]
        word = part[row[owner]] ^ pattern[at]
        row, total = row[owner], more[keep]
        anchor = anchor[owner] | (word << np.int64(BITS * i))
    return row, anchor, total


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy()
        for low in range(0, len(fps), 4096):
            part = fps[low : low + 4096]
            row, anchor, excess = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row]), pa.array(excess.astype(np.int8))], ["anchor", "fp", "excess"])


def _near(fps: np.ndarray, excess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at DISTANCE or less; one of the two lies within the covering radius plus one."""
    bits = fps.view(np.uint64)
    inner = np.flatnonzero(excess <= 1)
    found_a, found_b = [], []
    rows = max(1, (1 << 22) // max(len(bits), 1))
    for low in range(0, len(inner), rows):
        some = inner[low : low + rows]
        a, b = np.nonzero(np.bitwise_count(bits[some][:, None] ^ bits[None, :]) <= DISTANCE)
        found_a.append(some[a])
        found_b.append(b)
    if not found_a:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return a[a != b], b[a != b]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in tx.whole_groups(batches, "bucket"):
        keys, fps = table.column("bucket").to_numpy(), table.column("fp").to_numpy()
        side, excess = table.column("side").to_numpy(), table.column("excess").to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        bounds = np.concatenate([[0], change, [len(keys)]])
        out_a, out_b = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo > 1:
                a, b = root_links(hi - lo, *_near(fps[lo:hi], excess[lo:hi]), side[lo:hi])
                out_a.append(fps[lo:hi][a])
                out_b.append(fps[lo:hi][b])
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])


def links(fps: DataFrame, part: int = PART) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, BIGINT) that connect what distances of DISTANCE or less connect.

    An anchor's fingerprints are dealt into parts of about ``part``; a task compares one part, or two. The links of one
    part form a star, those of two parts join the roots of their stars, so no pair of a dense group is written out.
    """
    reached = fps.mapInArrow(_replicate, "anchor bigint, fp bigint, excess tinyint")
    sizes = reached.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.filter(F.col("n") > part)
    parts = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(part)).cast("int")
    dealt = (
        join_unique(reached, large, ["anchor"])
        .withColumn("_g", parts)
        .withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("_g")).cast("int"))
        .withColumn("_peer", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    )
    low, high = F.least("_own", "_peer"), F.greatest("_own", "_peer")
    tasks = dealt.select(
        F.xxhash64("anchor", low, high).alias("bucket"), "fp", "excess",
        F.when(F.col("_own") == F.col("_peer"), 2).when(F.col("_own") < F.col("_peer"), 0).otherwise(1).cast("tinyint").alias("side"),
    )
    return tx.grouped_rows(tasks, "bucket", "fp").mapInArrow(_compare, "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, part: int = PART) -> DataFrame:
    """(id_col, fingerprint, component_id) per row: sixteen hexadecimal digits, and the smallest id that links reach.

    Words are runs of bytes other than ASCII white space, with A to Z lower-cased; the shingles are ``width`` words
    joined by spaces, repeats counted. A text of fewer words is one shingle; a null, empty or blank text has fingerprint
    zero and is linked like any other. Rows repeated with their id are returned as often; an id with several texts has
    a row per text. A row without an id is linked too and names its component only if an id is reached (else null).
    An empty table gives no rows. Further columns are ignored.
    """
    docs = tx.bounded_batches(documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")))
    kind = docs.schema["doc"].dataType.simpleString()
    marked = written(docs.mapInArrow(_fingerprints(width), f"doc {kind}, fp bigint"))
    folded = marked.groupBy("fp").agg(F.min("doc").alias("least"))
    reached = connected_components(links(folded.select("fp"), part), "a", "b")
    rooted = folded.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return join_unique(marked, of_fp, ["fp"]).select(
        F.col("doc").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
