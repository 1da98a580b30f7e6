"""Cross-tokenizer alignment: which tokens of two public tokenizers end at the same byte, counted over the whole corpus.

External spill counting. A task cuts its texts into tokens, folds the links of a document to records (pair, document,
links), and when it holds ``RUN_RECORDS`` of them sorts them by pair, B id first, and spills a run: one zstd block for each
radix of the B id. Runs are rows of a table in the shared folder. The pairs of up to ``FAN`` runs of one radix are merged
by a k-way heap into counted runs, and these again, until one run a radix holds every pair with its corpus-wide count;
in its B-major order the highest count of a B id is known when its last pair has passed. Counts and marks then stream
back down the same tree, each task answering the runs it had merged, and end as sums over the documents of a run.

Tokens are found word by word: a single space between two other characters than white space always starts a token in
both tokenizers (the pattern of A starts a match there; no piece of B holds a space behind another character,
which is checked when the vocabulary is loaded), so the text between two such places has the same tokens wherever it
stands, and those of frequent words are kept.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cohortloom.llm import textops as tx
from cohortloom.llm.stored import written
from cohortloom.operators.skew import range_rank

FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Records of a run, ways of a heap merge, radices of the B id, words of a stretch of text, and longest and number of kept words.
RUN_RECORDS, FAN, RADICES, STRETCH, WORD_CHARS, KEPT_WORDS = 2_000_000, 256, 16, 50_000, 64, 500_000
#: Places between words: one space with no white space beside it (more characters count as white space here than in the patterns of the tokenizers).
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_PAIR = np.int64(1) << np.int64(20)


class Aligner:
    """Both tokenizers and the tokens of words met before; loaded once in a task."""

    def __init__(self, file_a: bytes, file_b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_buffer(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        letters = _byte_letters()
        vocabulary = json.loads(file_a)["model"]["vocab"]
        self.bytes_a: dict[int, bytes] = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocabulary.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search(r"[^ ▁][ ▁]", p) for i, p in enumerate(pieces) if not self.b.is_control(i)):
            raise ValueError("a piece holds a space behind another character: texts cannot be cut at spaces")
        self.length_a = np.zeros(max(self.bytes_a) + 1, dtype=np.int64)
        self.length_a[list(self.bytes_a)] = [len(x) for x in self.bytes_a.values()]
        self.length_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        numbers = [str(i).encode() for i in range(max(len(self.length_a), len(self.length_b)))]
        self.digits = np.array([len(x) for x in numbers])
        self.decimal = np.frombuffer(b"".join(x.ljust(self.digits[-1] + 1) for x in numbers), dtype=np.uint8).reshape(len(numbers), -1)
        self.forget()

    def forget(self) -> None:
        """Words are numbered from 0; the ids of word i stand at start[i] : start[i + 1]."""
        self.known: dict[str, int] = {}
        self.ids_a, self.ids_b, self.start_a, self.start_b = array("i"), array("i"), array("q", [0]), array("q", [0])
        self.spelt = bytearray()

    def _add(self, words: list[str]) -> None:
        """Number new words. They are cut as one text; if that is not spelt, word by word."""
        ids_a, ids_b = self.a.encode(" " + " ".join(words), add_special_tokens=False).ids, self.b.encode(" ".join(words))
        raw = "".join([" " + w for w in words]).encode()
        spelt = b"".join([self.bytes_a[i] for i in ids_a]) == raw == b"".join([self.bytes_b[i] for i in ids_b])
        if not spelt and len(words) > 1:
            for word in words:
                self._add([word])
            return
        self.known.update(zip(words, range(len(self.spelt), len(self.spelt) + len(words)), strict=True))
        self.spelt.extend(bytes([spelt]) * len(words))
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        for ids, length, all_ids, start in ((ids_a, self.length_a, self.ids_a, self.start_a), (ids_b, self.length_b, self.ids_b, self.start_b)):
            ids = np.array(ids, dtype=np.int32)
            last = np.searchsorted(np.cumsum(length[ids]), ends) + 1 if spelt else np.array([len(ids)])
            start.frombytes((last + len(all_ids)).astype(np.int64).tobytes())
            all_ids.frombytes(ids.tobytes())

    def stretches(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """(ids of A, ids of B) of one stretch of the text after the other; None and no more if the tokens do not spell it."""
        words = BETWEEN.split(text)
        for low in range(0, len(words), STRETCH):
            if len(self.spelt) > KEPT_WORDS:
                self.forget()
            part = words[low : low + STRETCH]
            new = [w for w in dict.fromkeys(part) if w not in self.known]
            if new:
                self._add(new)
            number = np.fromiter(map(self.known.__getitem__, part), dtype=np.int64, count=len(part))
            whole = np.frombuffer(self.spelt, dtype=np.uint8)[number].all()
            ids = [_gather(np.frombuffer(i, dtype=np.int32), np.frombuffer(s, dtype=np.int64), number) for i, s in ((self.ids_a, self.start_a), (self.ids_b, self.start_b))]
            for w in new:
                if len(w) > WORD_CHARS:
                    del self.known[w]
            yield (ids[0], ids[1]) if whole else None
            if not whole:
                return

    def align(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, bytes]:
        """(pairs of tokens that end together, B id first; the groups as text) of one stretch."""
        end_a, end_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        near = np.searchsorted(end_b, end_a)
        last_a = np.flatnonzero(end_b[near] == end_a)
        last_b = near[last_a]
        # a group is written as its A tokens and then its B tokens, each followed by one separator
        in_a, in_b = np.searchsorted(last_a, np.arange(len(ids_a))), np.searchsorted(last_b, np.arange(len(ids_b)))
        at_a = np.arange(len(ids_a)) + np.concatenate([[0], last_b + 1])[in_a]
        at_b = np.arange(len(ids_b)) + (last_a + 1)[in_b]
        order = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        order[at_a], order[at_b] = ids_a, ids_b
        separator = np.full(len(order), ord(","), dtype=np.uint8)
        separator[at_a[last_a]], separator[at_b[last_b]] = ord("|"), ord(";")
        text, digits = self.decimal[order], self.digits[order]
        text[np.arange(len(order)), digits] = separator
        return ids_b[last_b].astype(np.int64) * _PAIR + ids_a[last_a], text[np.arange(text.shape[1]) <= digits[:, None]][:-1].tobytes()


def _gather(ids: np.ndarray, start: np.ndarray, number: np.ndarray) -> np.ndarray:
    first, many = start[number], start[number + 1] - start[number]
    return ids[np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)]


def _byte_letters() -> dict[str, int]:
    """The character that stands for each byte in the entries of a byte-level vocabulary: printable Latin-1 as itself, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


def pack(values: np.ndarray) -> bytes:
    """BIGINTs as one zstd block, byte planes side by side."""
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T) if len(values) else np.zeros(0, dtype=np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(block: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel() if len(raw) else np.zeros(0, dtype=np.int64)


def _steps(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=np.int64(0))


ROW = "kind tinyint, run bigint, radix int, {doc}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, sha string, at int, pairs binary, totals binary, docs binary, counts binary"


def _spill(files, schema: pa.Schema):
    """Rows of kind 0 (documents of a run, at their position) and of kind 1 (a run's block of one radix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files.value)
        run_no = TaskContext.get().partitionId() << 32
        held: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        rows: list[dict] = []
        records = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, weights, rows, records, run_no
            out = rows
            if held:
                pair = np.concatenate(held)
                links = np.concatenate(weights)
                doc = np.repeat(np.arange(len(held)), [len(h) for h in held])
                place = np.flatnonzero([r["n_links"] > 0 for r in rows])[doc]
                order = np.lexsort((place, pair))
                pair, links, place = pair[order], links[order], place[order]
                radix = (pair // _PAIR) % RADICES
                for part in range(RADICES):
                    pick = np.flatnonzero(radix == part)
                    if len(pick):
                        p = pair[pick]
                        first = np.flatnonzero(np.diff(p, prepend=np.int64(-1)))
                        out.append({
                            "kind": 1, "run": run_no, "radix": part, "pairs": pack(_steps(p[first])), "totals": pack(np.add.reduceat(links[pick], first)),
                            "docs": pack(place[pick]), "counts": pack(np.stack([links[pick], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(p))))]).ravel()),
                        })
            held, weights, rows, records, run_no = [], [], [], 0, run_no + 1
            yield pa.RecordBatch.from_pylist(out, schema=schema)

        for batch in batches:
            for doc, value in zip(batch.column("doc").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                raw = value.as_py() or b""
                try:
                    text = raw.decode()
                except UnicodeDecodeError:
                    text = ""
                row = {"kind": 0, "run": run_no, "doc": doc, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "sha": "", "at": len(rows)}
                sha, whole, found, n_a, n_b = hashlib.sha256(), bool(text), [], 0, 0
                for ids in aligner.stretches(text) if text else ():
                    if ids is None:
                        whole = False
                        break
                    pairs, written_groups = aligner.align(*ids)
                    n_a, n_b = n_a + len(ids[0]), n_b + len(ids[1])
                    sha.update(b";" + written_groups if found else written_groups)
                    found.append(np.unique(pairs, return_counts=True))
                if whole:
                    keys, links = found[0]
                    if len(found) > 1:
                        keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                        links = np.bincount(where, weights=np.concatenate([n for _, n in found])).astype(np.int64)
                    n = int(links.sum())
                    row.update(n_a=n_a, n_b=n_b, n_groups=n, n_links=n, sha=sha.hexdigest())
                    held.append(keys)
                    weights.append(links)
                    records += len(keys)
                rows.append(row)
                if records >= RUN_RECORDS or len(rows) >= 100_000:
                    yield from flush()
        if rows:
            yield from flush()

    return run


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, counts) of sorted runs by a k-way heap: the run with the least pair gives all its pairs up to the next run's least."""
    heap = [(int(p[0]), i, 0) for i, (p, _) in enumerate(runs) if len(p)]
    heapq.heapify(heap)
    out_p: list[int] = []
    out_n: list[int] = []
    lists = [(p.tolist(), n.tolist()) for p, n in runs]
    while heap:
        pair, i, at = heap[0]
        p, n = lists[i]
        if out_p and out_p[-1] == pair:
            out_n[-1] += n[at]
        else:
            out_p.append(pair)
            out_n.append(n[at])
        if at + 1 < len(p):
            heapq.heapreplace(heap, (p[at + 1], i, at + 1))
        else:
            heapq.heappop(heap)
    return np.array(out_p, dtype=np.int64), np.array(out_n, dtype=np.int64)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in tx.whole_groups(batches, "bucket"):
        keys = table.column("bucket").to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            part = table.slice(lo, hi - lo)
            pairs, counts = merge_runs([
                (np.cumsum(unpack(p)), unpack(n)) for p, n in zip(part.column("pairs").to_pylist(), part.column("totals").to_pylist(), strict=True)
            ])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column("radix")[0].as_py()], pa.int32()), pa.array([part.column("parent")[0].as_py()], pa.int64()), pa.array([pack(_steps(pairs))], pa.binary()), pa.array([pack(counts)], pa.binary())],
                ["radix", "run", "pairs", "totals"],
            )


def _maxima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of the top runs: the corpus-wide count of each pair, negative where it is the highest of its B id."""
    for batch in batches:
        for radix, run, p, n in zip(*[batch.column(c).to_pylist() for c in ("radix", "run", "pairs", "totals")], strict=True):
            pairs, counts = np.cumsum(unpack(p)), unpack(n)
            first = np.flatnonzero(np.diff(pairs // _PAIR, prepend=np.int64(-1)))
            best = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(pairs)))) if len(pairs) else counts
            yield pa.RecordBatch.from_arrays(
                [pa.array([radix], pa.int32()), pa.array([run], pa.int64()), pa.array([p], pa.binary()), pa.array([pack(np.where(counts == best, -counts, counts))], pa.binary())],
                ["radix", "run", "pairs", "answers"],
            )


def _stream_back(last: bool):
    """Answers for the runs that a parent merged; at the documents' own runs, their sums over the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, above, answers = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if row["answers"] is not None:
                    held, above, answers = row["bucket"], np.cumsum(unpack(row["above"])), unpack(row["answers"])
                    continue
                if row["bucket"] != held:
                    raise RuntimeError("a run came before its answers")
                pairs = np.cumsum(unpack(row["pairs"]))
                mine = answers[np.searchsorted(above, pairs)]
                if not last:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["radix"]], pa.int32()), pa.array([row["run"]], pa.int64()), pa.array([row["pairs"]], pa.binary()), pa.array([pack(mine)], pa.binary())],
                        ["radix", "run", "pairs", "answers"],
                    )
                    continue
                place = unpack(row["docs"])
                links, pair = unpack(row["counts"]).reshape(2, -1)
                value = mine[pair]
                top = int(place.max()) + 1
                best = np.zeros(top, dtype=np.int64)
                total = np.zeros(top, dtype=np.int64)
                np.add.at(best, place, np.where(value < 0, links, 0))
                np.add.at(total, place, links * np.abs(value))
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), row["run"])), pa.array(used.astype(np.int32)), pa.array(best[used]), pa.array(total[used])], ["run", "at", "n_best", "count_sum"]
                )

    return run


def align_tokens(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, file_a: str = FILE_A, file_b: str = FILE_B, fan: int = FAN,
) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of the documents.

    A text with a space before it is cut by both tokenizers without special tokens. Tokens that end at the same byte are
    linked; n_best counts the links whose id pair has the highest corpus-wide number of links of its B id, ties
    included, and count_sum adds these numbers over the links. A null or empty text, one that is not UTF-8, and
    one whose tokens of A or B do not spell it give zeros and an empty digest. Rows repeated with their id are counted and returned each;
    ids may be null. An empty table gives no rows. Further columns are ignored. The vocabulary files are read where the driver runs and
    sent to the tasks (some megabytes, whatever the corpus).
    """
    spark = documents.sparkSession
    files = []
    for name in (file_a, file_b):
        with open(os.path.join(folder, name), "rb") as f:
            files.append(f.read())
    shared = spark.sparkContext.broadcast(tuple(files))
    docs = tx.bounded_batches(documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")))
    field = f"doc {docs.schema['doc'].dataType.simpleString()}"
    spilled_schema = ROW.format(doc=field)
    schema = to_arrow_schema(spark.createDataFrame([], spilled_schema).schema)
    spilled = written(docs.mapInArrow(_spill(shared, schema), spilled_schema))
    levels = [spilled.filter("kind = 1").select("run", "radix", "pairs", "totals", "docs", "counts")]
    parents: list[DataFrame] = []
    while True:
        runs = levels[-1].select("run").distinct()
        ranked = range_rank(runs.withColumn("all", F.lit(1)), ["all"], [F.col("run")], "rank")
        parents.append(written(ranked.select("run", F.floor((F.col("rank") - 1) / F.lit(fan)).cast("bigint").alias("parent"))))
        groups = parents[-1].agg(F.countDistinct("parent").alias("n")).first().n
        below = levels[-1].select("run", "radix", "pairs", "totals").join(parents[-1], "run")
        keyed = tx.grouped_rows(below.select(F.xxhash64("radix", "parent").alias("bucket"), "radix", "parent", "pairs", "totals"), "bucket")
        levels.append(written(keyed.mapInArrow(_merge, "radix int, run bigint, pairs binary, totals binary")))
        if groups <= 1:
            break
    answers = levels[-1].mapInArrow(_maxima, "radix int, run bigint, pairs binary, answers binary")
    for depth in range(len(parents) - 1, -1, -1):
        asked = levels[depth].join(parents[depth], "run").select(
            F.xxhash64("radix", "parent").alias("bucket"), F.lit(1).alias("turn"), "radix", "run", "pairs", F.lit(None).cast("binary").alias("above"),
            F.lit(None).cast("binary").alias("answers"), *([F.col("docs"), F.col("counts")] if not depth else []),
        )
        given = answers.select(
            F.xxhash64("radix", "run").alias("bucket"), F.lit(0).alias("turn"), "radix", "run", F.lit(None).cast("binary").alias("pairs"), F.col("pairs").alias("above"), "answers",
        )
        told = tx.grouped_rows(asked.unionByName(given, allowMissingColumns=True), "bucket", "turn")
        if depth:
            answers = written(told.mapInArrow(_stream_back(False), "radix int, run bigint, pairs binary, answers binary"))
        else:
            answers = told.mapInArrow(_stream_back(True), "run bigint, at int, n_best bigint, count_sum bigint")
    sums = answers.groupBy("run", "at").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = spilled.filter("kind = 0").select("run", "at", "doc", "n_a", "n_b", "n_groups", "n_links", "sha")
    zero = F.lit(0).cast("bigint")
    return rows.join(sums, ["run", "at"], "left").select(
        F.col("doc").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
        F.col("sha").alias("groups_sha256"),
    )
