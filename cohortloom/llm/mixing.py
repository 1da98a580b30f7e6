"""Mixing to target weights: soft domain membership and projected-gradient rates.

Domains come from the labelled table: ``toxic``, ``low`` (quality 0) and ``high`` (quality 1). A softmax classifier on hashed words and
punctuation runs, trained on a bounded sample of labelled rows, gives every document a posterior over them. A document of n tokens
adds n * posterior to the domains' expected tokens when its rate is one. Rates are nonnegative and bring the expected
totals as near (in least squares) to the targets as they can, found from rate one by projected gradient descent. A step needs
the domain totals only; the rate of a document follows from the steps' residuals, so no rate is stored or shuffled and no
document reaches the driver. Spark sums all documents into a bounded grid of posteriors, on which most steps are taken; the totals are then
checked, and where needed mended by further steps, as sums over the documents themselves.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import textops as tx
from cohortloom.session import cut_lineage

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.9, "low": 0.1, "toxic": 0.0}
SAMPLE_ROWS, BUCKETS, FEATURES, EPOCHS = 4000, 1 << 18, 600, 300
STEPS, PATIENCE, EXACT_STEPS, TOLERANCE, CELLS = 1500, 200, 20, 1e-4, 50_000
_MARKS = tx.TOKEN_BYTE & ~tx.WORD_BYTE


def token_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, row) of every word and every run of punctuation, and the number of words per text."""
    hashes, row = tx.words(data, offsets)
    marks, mark_row = tx.words(data, offsets, _MARKS)
    count = np.bincount(row, minlength=len(offsets) - 1)
    return (np.concatenate([hashes, marks]) >> np.uint64(46)).astype(np.int64), np.concatenate([row, mark_row]), count


def train(row: np.ndarray, bucket: np.ndarray, domain: np.ndarray) -> dict[str, np.ndarray]:
    """Softmax regression on the presence of the ``FEATURES`` buckets that differ most between domains, balanced by class.

    ``row`` and ``bucket`` are the distinct buckets of the rows of ``domain``.
    """
    k = len(DOMAINS)
    size = np.bincount(domain, minlength=k).astype(np.float64)
    if np.count_nonzero(size) < 2:
        return {"buckets": np.zeros(0, dtype=np.int64), "W": np.zeros((0, k)), "b": np.log((size + 0.5) / (size.sum() + 0.5 * k))}
    seen = np.zeros((k, BUCKETS))
    np.add.at(seen, (domain[row], bucket), 1)
    rate = seen / np.maximum(size, 1)[:, None]
    overall = seen.sum(0) / size.sum()
    spread = (np.where(size[:, None] > 0, (rate - overall) ** 2, 0) * np.maximum(size, 1)[:, None]).sum(0) / (overall * (1 - overall) + 0.5 / size.sum())
    buckets = np.sort(np.argsort(-spread, kind="stable")[:FEATURES])
    at = np.searchsorted(buckets, bucket).clip(0, len(buckets) - 1)
    keep = buckets[at] == bucket
    x = np.zeros((len(domain), len(buckets)), dtype=np.float32)
    x[row[keep], at[keep]] = 1
    truth = np.eye(k, dtype=np.float32)[domain]
    weight = (len(domain) / (np.count_nonzero(size) * np.maximum(size, 1)) ** 1.0)[domain] ** 0.5
    weight = (weight / weight.mean())[:, None].astype(np.float32)
    w, b = np.zeros((len(buckets), k), dtype=np.float32), np.zeros(k, dtype=np.float32)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, EPOCHS + 1):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        slope = (p - truth) * weight / len(domain)
        g = x.T @ slope + 1e-4 * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        b -= 0.5 * slope.sum(0)
    b = np.where(size > 0, b, -30)
    return {"buckets": buckets, "W": w.astype(np.float64), "b": b.astype(np.float64)}


def posteriors(model: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x domains posteriors, words per text)."""
    bucket, row, count = token_rows(data, offsets)
    rows = len(offsets) - 1
    z = np.tile(model["b"], (rows, 1))
    if len(model["buckets"]):
        at = np.searchsorted(model["buckets"], bucket).clip(0, len(model["buckets"]) - 1)
        keep = model["buckets"][at] == bucket
        pair = np.unique(row[keep] * FEATURES + at[keep])
        np.add.at(z, pair // FEATURES, model["W"][pair % FEATURES])
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True), count


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row the distinct buckets of its whole text, four bytes each."""
    for batch in batches:
        for first, end, data, offsets in tx.slices(batch.column("text")):
            rows = end - first
            bucket, row, _ = token_rows(data, offsets)
            pair = np.unique(row * BUCKETS + bucket)
            bounds = (4 * np.searchsorted(pair, np.arange(rows + 1) * BUCKETS)).astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(bounds), pa.py_buffer((pair % BUCKETS).astype(np.int32).tobytes())])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(first, rows) for c in ("doc", "domain", "mark")], held], ["doc", "domain", "mark", "buckets"])


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Train on the whole texts of at most ``rows`` labelled documents, chosen by a hash of the id among those that ``documents`` holds.

    Rows with a null id or without a domain train nothing; of an id's differing labels toxic counts before low and low before high.
    """
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1)
    marked = labels.select(F.col(id_col).cast("bigint").alias("doc"), domain.alias("domain")).filter("doc is not null and domain is not null")
    here = documents.select(F.col(id_col).cast("bigint").alias("doc"))
    chosen = marked.groupBy("doc").agg(F.max("domain").alias("domain")).join(here, "doc", "left_semi").orderBy(F.xxhash64("doc"), "doc").limit(rows)
    texts = documents.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    found = tx.bounded_batches(texts.join(F.broadcast(chosen), "doc").withColumn("mark", F.xxhash64("text")))
    seen = found.mapInArrow(_presence, "doc bigint, domain int, mark bigint, buckets binary")
    taken = seen.orderBy(F.xxhash64("doc"), "doc", "mark").limit(rows).collect()
    buckets = [np.frombuffer(r["buckets"], dtype=np.int32) for r in taken]
    row = np.repeat(np.arange(len(taken)), [len(x) for x in buckets])
    return train(row, np.concatenate([*buckets, np.zeros(0, dtype=np.int32)]).astype(np.int64), np.array([r["domain"] for r in taken], dtype=np.int64))


def _masses(model: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [posteriors(model, data, offsets) for _, _, data, offsets in tx.slices(batch.column("_text"))]
            p = np.concatenate([x[0] for x in parts]) if parts else np.zeros((0, len(DOMAINS)))
            n = np.concatenate([x[1] for x in parts]) if parts else np.zeros(0)
            keep = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(n.astype(np.int64)), *[pa.array(p[:, k]) for k in range(len(DOMAINS))]],
                [*keep, "n_tokens", *[f"p_{d}" for d in DOMAINS]],
            )

    return run


def domain_posteriors(documents: DataFrame, model: dict[str, np.ndarray], keep: list[str], text_col: str = "text") -> DataFrame:
    chosen = tx.bounded_batches(documents.select(*keep, F.col(text_col).alias("_text")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_text")
    return chosen.mapInArrow(_masses(model), f"{fields}, n_tokens bigint, " + ", ".join(f"p_{d} double" for d in DOMAINS))


def fold(rows: DataFrame, columns: list[str], weight: str, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean posteriors, weights, weighted cross products) of the cells of a grid over the posteriors, summed over all rows.

    A cell is named by the largest posterior's place and the levels of the others, by their fourth roots: fine near zero,
    where a rate falls from one to nothing within a narrow range of a posterior. With m levels that is at most k * (m + 1)**(k - 1) cells, and m is the
    largest that keeps this within ``cells``, however many rows there are. Sums inside a cell are exact, so only
    what lies within a cell is unknown.
    """
    k = len(columns)
    levels = int((cells / k) ** (1 / max(k - 1, 1))) - 1
    largest = F.array_position(F.array(*columns), F.greatest(*columns)) if k > 1 else F.lit(1)
    keys = [F.when(largest == i + 1, -1).otherwise(F.floor(F.pow(F.col(c), F.lit(0.25)) * levels)).alias(f"k{i}") for i, c in enumerate(columns)]
    sums = [F.sum(F.col(weight) * F.col(c)).alias(f"s{i}") for i, c in enumerate(columns)]
    crossed = [F.sum(F.col(weight) * F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    got = rows.filter(F.col(weight) > 0).groupBy(*keys).agg(F.sum(weight).alias("n"), *sums, *crossed).collect()
    got.sort(key=lambda r: tuple(r[f"k{i}"] for i in range(k)))
    n = np.array([r["n"] for r in got], dtype=np.float64)
    means = np.array([[r[f"s{i}"] for i in range(k)] for r in got]).reshape(-1, k) / n[:, None]
    gram = np.array([[sum(r[f"g{min(i, j)}_{max(i, j)}"] for r in got) for j in range(k)] for i in range(k)])
    return means, n, gram


def solve_rates(rows: DataFrame, columns: list[str], weight: str, targets: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """Residual weights of the steps, for ``walk``, from rows of posteriors ``columns`` and token counts ``weight``.

    Steps are taken in the metric that weighs a document by its tokens, so rates follow the posteriors and not the lengths.
    Residuals are whitened by the domains' Gram matrix, which makes step length one safe and, while no rate meets zero,
    one step exact. From the second step on, steps carry momentum (the accelerated form of projected gradient descent).

    The first ``steps`` (at most) run on the folded posteriors of all rows. They end when no domain is off by more than
    half of ``tolerance`` of all tokens, or when ``PATIENCE`` steps have brought no domain nearer by a twentieth of it (targets may be out of reach of
    nonnegative rates). The totals are then summed over the rows themselves, and while they are off by more than ``tolerance`` beyond
    what the folded ones were, up to ``EXACT_STEPS`` more steps follow on all rows. A warning says how far off the totals stay, if they do.
    """
    k = len(columns)
    p, n, gram = fold(rows, columns, weight)
    total = float(n.sum())
    if not total:
        return []
    values, vectors = np.linalg.eigh(gram / total)
    inverse = vectors @ np.diag(np.where(values > values.max() * 1e-9, 1 / np.maximum(values, 1e-300), 0)) @ vectors.T
    aim = np.array(targets)
    history: list[list[float]] = []
    pace = 1.0

    def step(ahead: np.ndarray) -> None:
        nonlocal pace
        onward = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        history.append([*(inverse @ (ahead - aim)).tolist(), (pace - 1) / onward])
        pace = onward

    share = p * (n / total)[:, None]
    rate = point = np.ones(len(n))
    now = ahead = share.sum(0)
    offs = [float(np.abs(now - aim).max())]
    while len(history) < steps and offs[-1] > tolerance / 2 and (len(offs) <= PATIENCE or min(offs[:-PATIENCE]) - min(offs[-PATIENCE:]) > tolerance / 20):
        step(ahead)
        rate, point = _stepped(p, rate, point, history[-1])
        now, ahead = share.T @ rate, share.T @ point
        offs.append(float(np.abs(now - aim).max()))
    for extra in range(EXACT_STEPS + 1):
        sums_of = rows.select(weight, *columns).mapInArrow(_totals(history, weight, columns), "slot int, value double")
        got = {r["slot"]: r["value"] for r in sums_of.groupBy("slot").agg(F.sum("value").alias("value")).collect()}
        now, ahead = (np.array([got[base + i] for i in range(k)]) / total for base in (0, k))
        off = float(np.abs(now - aim).max())
        if off <= max(tolerance, offs[-1] + tolerance) or extra == EXACT_STEPS:
            break
        step(ahead)
    if off > tolerance:
        warnings.warn(f"after {len(history)} steps a domain is off its target by {off:.6f} of all tokens; more steps may bring it nearer", stacklevel=2)
    return history


def _stepped(p: np.ndarray, rate: np.ndarray, point: np.ndarray, taken: list[float]) -> tuple[np.ndarray, np.ndarray]:
    *h, momentum = taken
    onward = np.maximum(0.0, point - p @ np.array(h))
    return onward, onward + momentum * (onward - rate)


def walk(p: np.ndarray, history: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """(rates, points with momentum) of rows of posteriors after the recorded steps, from rate one."""
    rate = point = np.ones(len(p))
    for taken in history:
        rate, point = _stepped(p, rate, point, taken)
    return rate, point


def _posteriors(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1)


def _totals(history: list[list[float]], weight: str, columns: list[str]):
    """Domain totals of a partition at the rates and at the points with momentum, one row per slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(2 * len(columns))
        for batch in batches:
            p = _posteriors(batch, columns)
            mass = p * batch.column(weight).to_numpy(zero_copy_only=False)[:, None]
            out += np.concatenate([mass.T @ x for x in walk(p, history)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["slot", "value"])

    return run


def with_rates(rows: DataFrame, columns: list[str], history: list[list[float]]) -> DataFrame:
    """Rows with their ``rate``: max(0, point - posterior . residual), step by step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = walk(_posteriors(batch, columns), history)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, "rate"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, rate double")


def mix_documents(
    documents: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
    training: DataFrame | None = None,
) -> DataFrame:
    """The kept columns (the id by default), n_tokens, the posteriors p_high, p_low, p_toxic, and ``rate`` of every row.

    ``rate`` is how often the document should be drawn; sum(rate * n_tokens * posterior) over all rows meets
    each target's share of all tokens as nearly as nonnegative rates can; documents of one posterior have one rate. Texts without words (null, empty) are rated by their posterior too and add no tokens. A domain without
    labelled rows has posterior near zero. Without labels all domains are alike and rates stay near one. Repeated rows count
    as often as they occur; null ids are rated like others. The labelled texts come from ``training`` (by default ``documents``). Of kept columns named like an added one, the added one is returned.
    """
    added = {"n_tokens", "rate", *[f"p_{d}" for d in DOMAINS]}
    kept = [c for c in (keep or [id_col]) if c not in added]
    model = fit(documents if training is None else training, labels, id_col, text_col)
    columns = [f"p_{d}" for d in DOMAINS]
    rated = cut_lineage(domain_posteriors(documents, model, kept, text_col))
    history = solve_rates(rated, columns, "n_tokens", [targets[d] for d in DOMAINS])
    return with_rates(rated, columns, history)
