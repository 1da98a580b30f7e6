"""Benchmark decontamination: short test items found inside long documents by containment.

Items are cut into classes by the size of their shingle set. Of every item the least shingle hashes are kept (a
bottom-k MinHash sketch); k is the number of shingles that may be missing at the threshold, plus one, so a document
that holds the item must hold one of them and no contained item is lost. A document is looked up with all its shingles
in the sketches of the classes that fit its own size; each item it meets is verified exactly on both whole
shingle sets. The search needs no shuffle. Items come in blocks of ``ITEM_BLOCK``; each block is one pass over
the documents, so what a task holds does not grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import textops as tx

WIDTH, THRESHOLD, ITEM_BLOCK = 5, 0.8, 20_000


def _item_tables(rows: list, width: int, threshold: float) -> dict[int, dict]:
    """Per shingle width (shorter items have one shingle of all their words): sketches by size class, and whole sets."""
    out: dict[int, dict] = {}
    for row in rows:
        raw = np.frombuffer((row["text"] or "").encode(), dtype=np.uint8)
        hashes, _ = tx.words(raw, np.array([0, len(raw)]))
        if not len(hashes):
            continue
        own = min(width, len(hashes))
        found = np.unique(tx.grams(hashes, np.zeros(len(hashes), dtype=np.int64), own)[0])
        miss = len(found) - int(np.ceil(threshold * len(found) - 1e-9))
        table = out.setdefault(own, {"sets": {}, "probe": [], "item": []})
        table["sets"][row["item"]] = found
        table["probe"].append(found[: miss + 1])
        table["item"].append(np.full(miss + 1, row["item"]))
    for table in out.values():
        probe, item = np.concatenate(table["probe"]), np.concatenate(table["item"])
        size = np.array([len(table["sets"][i]) for i in item])
        classes = []
        for power in np.unique(np.floor(np.log2(size)).astype(int)):
            pick = np.floor(np.log2(size)).astype(int) == power
            order = np.argsort(probe[pick], kind="stable")
            classes.append((int(np.ceil(threshold * 2.0**power - 1e-9)), probe[pick][order], item[pick][order]))
        table["classes"] = classes
        table["bloom"] = np.zeros(1 << 20, dtype=bool)
        table["bloom"][(probe >> np.uint64(44)).astype(np.int64)] = True
    return out


def _search(tables: dict[int, dict], width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in tx.slices(batch.column("text")):
                hashes, word_row = tx.words(data, offsets)
                got: list[tuple[int, int, int, int]] = []
                for own, table in tables.items():
                    h, row = tx.grams(hashes, word_row, own)
                    near = np.flatnonzero(table["bloom"][(h >> np.uint64(44)).astype(np.int64)])
                    if not len(near):
                        continue
                    cuts = np.searchsorted(row, np.arange(end - first + 1))
                    size = np.diff(cuts)
                    pairs: set[tuple[int, int]] = set()
                    for least, probe, item in table["classes"]:
                        look = near[size[row[near]] >= least]
                        low = np.searchsorted(probe, h[look], side="left")
                        high = np.searchsorted(probe, h[look], side="right")
                        for k in np.flatnonzero(high > low):
                            doc = int(row[look[k]])
                            pairs.update((doc, int(i)) for i in item[low[k] : high[k]])
                    held: dict[int, np.ndarray] = {}
                    for doc, item in sorted(pairs):
                        if doc not in held:
                            held[doc] = np.unique(h[cuts[doc] : cuts[doc + 1]])
                        want = table["sets"][item]
                        both = int(np.isin(want, held[doc], assume_unique=True).sum())
                        if both >= threshold * len(want) - 1e-9:
                            got.append((first + doc, item, both, len(want)))
                if got:
                    rows, items, both, wanted = (np.array(x) for x in zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc").take(pa.array(rows)), pa.array(items, pa.int64()), pa.array(both, pa.int64()), pa.array(wanted, pa.int64())],
                        ["doc", "item", "shared", "wanted"],
                    )

    return run


def contained_items(
    documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """(id_col, item_col, shared, wanted, containment): every document that holds at least ``threshold`` of an item's shingles.

    Containment is the share of the item's distinct word shingles that occur anywhere in the document. An item of one to four
    words has one shingle, all its words in a row. Items and documents without words match nothing; null ids are not
    looked at. Repeated rows give one pair; an item id with several texts counts with each of them, the highest
    containment is returned. Further columns are ignored.
    """
    docs = tx.bounded_batches(documents.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).filter("doc is not null"))
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("text")).filter("item is not null").distinct()
    blocks = max(1, -(-items.count() // item_block))
    found = None
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        named = [{"item": k, "text": r["text"]} for k, r in enumerate(rows)]
        part = docs.mapInArrow(
            _search(_item_tables(named, width, threshold), width, threshold), "doc bigint, item bigint, shared bigint, wanted bigint"
        )
        ids = docs.sparkSession.createDataFrame([(k, r["item"]) for k, r in enumerate(rows)], "item bigint, item_id bigint")
        part = part.join(F.broadcast(ids), "item")
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct((F.col("shared") / F.col("wanted")).alias("containment"), "shared", "wanted"))
    return found.groupBy("doc", "item_id").agg(best.alias("b")).select(
        F.col("doc").alias(id_col), F.col("item_id").alias(item_col), "b.shared", "b.wanted", "b.containment"
    )


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that hold no benchmark item; rows without an id stay. Of one id with several texts, those without an item stay."""
    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col), F.col(text_col)))
    keyed = documents.select(F.struct("*").alias("row"), key.alias("key"), F.col(text_col).alias("text"))  # whatever the given columns are called
    found = contained_items(keyed.select("key", "text"), benchmark, "key", "text").select("key").distinct()
    return keyed.join(found, "key", "left_anti").select("row.*")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def shingle_sql(table: str, key: str) -> str:
    """SELECT of (key, shingle), distinct; short texts have one shingle of all words."""
    return f"""select distinct {key}, array_to_string(w[i:i+4], ' ') as g from (
      select {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from (select {key}, {_WORDS} as w from {table}) where len(w) > 0)"""


ORACLE = f"""
with q as ({shingle_sql("benchmark", "item_id")}), d as ({shingle_sql("documents", "doc_id")}),
n as (select item_id, count(*) as wanted from q group by 1)
select doc_id, item_id, count(*) as shared, any_value(wanted) as wanted, count(*) / any_value(wanted) as containment
from q join d using (g) join n using (item_id) group by 1, 2 having count(*) >= 0.8 * any_value(wanted) - 1e-9
"""
