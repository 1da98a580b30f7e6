"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes between two pads. Each byte has a learned vector; filters of ``WINDOW`` bytes run over
chunks that overlap by half and cover the whole text. Every filter is max-pooled over all chunks, and a logistic
layer turns the pooled values into one probability. Only the chunk that won the pooling carries a gradient, so
training costs little more than scoring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import textops as tx

WINDOW, STRIDE, DIM, FILTERS = 16, 8, 4, 16
SAMPLE_ROWS, PIECE_BYTES, EPOCHS, BATCH, RATE, CUT = 3000, 1 << 20, 12, 64, 0.01, 0.3
PAD = 256


def new_network(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "E": rng.normal(0, 0.5, (257, DIM)).astype(np.float32),
        "W": rng.normal(0, 1 / np.sqrt(WINDOW * DIM), (WINDOW * DIM, FILTERS)).astype(np.float32),
        "c": np.zeros(FILTERS, dtype=np.float32),
        "v": rng.normal(0, 0.3, FILTERS).astype(np.float32),
        "b": np.zeros(1, dtype=np.float32),
    }


def laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes with every text padded to whole strides plus one, and the first stride of each text."""
    lengths = np.diff(offsets)
    strides = lengths // STRIDE + 2
    first = np.concatenate([[0], np.cumsum(strides)])
    codes = np.full(first[-1] * STRIDE, PAD, dtype=np.int16)
    shift = np.repeat(first[:-1] * STRIDE + 1 - offsets[:-1], lengths)
    codes[np.arange(len(data)) + shift] = data
    return codes, first


def _conv(net: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Filter values of every chunk: chunk j is strides j and j + 1; the last row of each text is void."""
    blocks = net["E"][codes].reshape(-1, STRIDE * DIM)
    half = STRIDE * DIM
    out = blocks @ net["W"][:half]
    out[:-1] += (blocks @ net["W"][half:])[1:]
    return out


def pooled(net: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    codes, first = laid_out(data, offsets)
    out = _conv(net, codes)
    out[first[1:] - 1] = -np.inf
    return np.maximum(np.maximum.reduceat(out, first[:-1], axis=0) + net["c"], 0)


def probability(net: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    z = pooled(net, data, offsets) @ net["v"] + net["b"][0]
    return 1 / (1 + np.exp(-z.astype(np.float64).clip(-30, 30)))


def winners(net: dict[str, np.ndarray], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(value, byte codes) of the chunk that wins each filter, over whole texts; ``PIECE_BYTES`` are convolved at a time."""
    value = np.full((len(texts), FILTERS), -np.inf, dtype=np.float32)
    window = np.full((len(texts), FILTERS, WINDOW), PAD, dtype=np.int16)
    ends = np.cumsum([len(t) for t in texts])
    low, most = 0, PIECE_BYTES // STRIDE
    while low < len(texts):
        done = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, done + PIECE_BYTES, side="right")))
        codes, first = laid_out(np.frombuffer(b"".join(texts[low:high]), dtype=np.uint8), np.concatenate([[0], ends[low:high] - done]))
        for start in range(0, first[-1], most):
            # one stride more than the piece has chunks: the last chunk ends there
            out = _conv(net, codes[start * STRIDE : (start + most + 1) * STRIDE])
            for t in range(np.searchsorted(first, start, side="right") - 1, min(np.searchsorted(first, start + most), high - low)):
                a, z = max(first[t], start), min(first[t + 1] - 1, start + most)
                if a < z:
                    best = out[a - start : z - start].argmax(0)
                    got = out[best + a - start, np.arange(FILTERS)]
                    better = got > value[low + t]
                    value[low + t, better] = got[better]
                    window[low + t, better] = codes[((best + a)[better] * STRIDE)[:, None] + np.arange(WINDOW)]
        low = high
    return value + net["c"], window


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the log loss. One class only, or no text, gives a network that answers the class share (0.5 if none)."""
    net = new_network(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    net["b"][0] = np.log(share / (1 - share))
    if len(set(labels.tolist())) < 2:
        net["v"][:] = 0
        return net
    m = {k: np.zeros_like(w) for k, w in net.items()}
    s = {k: np.zeros_like(w) for k, w in net.items()}
    rng, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for low in range(0, len(order), BATCH):
            pick = order[low : low + BATCH]
            value, window = winners(net, [texts[i] for i in pick])
            active = value > 0
            hidden = np.where(active, value, 0)
            p = 1 / (1 + np.exp(-(hidden @ net["v"] + net["b"][0]).clip(-30, 30)))
            slope = ((p - labels[pick]) / len(pick)).astype(np.float32)
            d_hidden = slope[:, None] * net["v"] * active
            seen = net["E"][window].reshape(len(pick), FILTERS, -1)
            grad = {
                "v": hidden.T @ slope, "b": slope.sum(keepdims=True), "c": d_hidden.sum(0),
                "W": np.einsum("bf,bfk->kf", d_hidden, seen), "E": np.zeros_like(net["E"]),
            }
            back = (d_hidden[:, :, None] * net["W"].T[None]).reshape(len(pick), FILTERS, WINDOW, DIM)
            np.add.at(grad["E"], window, back)
            step += 1
            rate = RATE * (1 - 0.7 * epoch / epochs)
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                net[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return {k: w.astype(np.float32) for k, w in net.items()}


def held_out(id_col: str, remainder: int = 0) -> Column:
    """Fold of an id: crc32 of its decimal text modulo 5. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == remainder, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Train on the whole texts of at most ``rows`` labelled documents outside the held-out fold, chosen by a hash of the id.

    Rows with a null id or label train nothing; of an id's differing labels the lowest counts.
    """
    marked = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), F.col(label_col).cast("int").alias("label"))
    chosen = marked.filter("doc is not null").filter(~held_out("doc")).groupBy("doc").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc"), "doc").limit(rows)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = documents.select(F.col(id_col).cast("bigint").alias("doc"), text.alias("text")).join(F.broadcast(chosen), "doc")
    taken = found.orderBy(F.xxhash64("doc"), "doc", "text").limit(rows).collect()
    return train([r["text"].encode() for r in taken], np.array([float(r["label"]) for r in taken]))


def _scores(net: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [probability(net, data, offsets) for _, _, data, offsets in tx.slices(batch.column("_text"), 1 << 19)]
            keep = [c for c in batch.schema.names if c != "_text"]
            score = pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], score], [*keep, "score"])

    return run


def quality_scores(documents: DataFrame, net: dict[str, np.ndarray], keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns and ``score`` (0 to 1) of every row. Null and empty texts are scored as two pads."""
    chosen = tx.bounded_batches(documents.select(*keep, F.col(text_col).alias("_text")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_text")
    return chosen.mapInArrow(_scores(net), f"{fields}, score double")


def keep_good(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """Documents whose score is at least ``cut``, with the columns they came with."""
    net = fit(documents, labels, id_col, text_col)
    own = documents.columns
    plain = documents.toDF(*[f"c{i}" for i in range(len(own))])
    scored = quality_scores(plain, net, plain.columns, f"c{own.index(text_col)}")
    return scored.filter(F.col("score") >= cut).drop("score").toDF(*own)
