"""LM scoring by a hierarchical Pitman-Yor model with Gibbs-sampled seating.

Restaurants form three levels above a uniform base over the training vocabulary and one unknown word: one for all words, one
per previous word and one per pair of previous words (a text starts after two start marks), told apart by 56-bit hashes of whole
words, so that their number follows the corpus. Counts come from all training texts. A customer either joins a table
of its word or opens one, which sends a customer to the parent (Chinese-restaurant seating). In a Gibbs sweep every customer is
taken from its table and seated again, level by level, given the parents' probabilities and the restaurant totals of the sweep
before. Predictive probabilities are averaged over ``SAMPLES`` sweeps.

Data flow: tokens go to buckets by a hash of the previous word, so a bucket holds whole restaurants of the two upper levels. It
seats them and sends the customers of the lowest level (the tables opened for each word) to ranges of word hashes, where the one
restaurant of all words is seated; each bucket gets back the probabilities of its words, seats again, and adds up the score of its
tokens per text; sums of a text meet at the end. Texts are not shuffled, but read and split into tokens twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import textops as tx
from cohortloom.llm.stored import written

#: Bytes of text in a bucket, tokens in a message's group (its words cubed are below 2**64), buckets that share a range of words.
BATCH_TEXT, GROUP, BUCKETS_A_RANGE = 10_000_000, 1_800_000, 8
FINE, COARSE, THETA, SAMPLES, HELD_OUT = 256, 32, 1.0, 2, 1
#: Customers of one word in one restaurant that are seated by one draw, and Gibbs passes over more of them.
DRAWN, PASSES = 1024, 4
_SHIFT = np.uint64(8)
END = tx.word_hash(b" end of text ") >> _SHIFT
START = tx.word_hash(b" start of text ") >> _SHIFT
_LONG = np.uint64(32)


def token_cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(56-bit word hash, row) of every token, two start marks before and the end after the words of each text, in order."""
    start, end, row = tx.spans(data, offsets, tx.TOKEN_BYTE)
    length = (end - start).astype(np.uint64)
    word = tx.mix(tx.span_hashes(tx.prefix_hashes(tx.LOWER[data]), start, end) ^ tx.mix(length)) >> _SHIFT
    rows = np.arange(len(offsets) - 1)
    tokens = np.full(len(word) + 3 * len(rows), START, dtype=np.uint64)
    owner = np.empty(len(tokens), dtype=np.int64)
    at = np.arange(len(word)) + 3 * row + 2
    last = np.searchsorted(row, rows, side="right") + 3 * rows + 2
    tokens[at], tokens[last] = word, END
    owner[at] = row
    for place in (last, last - (np.bincount(row, minlength=len(rows)) + 1), last - (np.bincount(row, minlength=len(rows)) + 2)):
        owner[place] = rows
    return tokens, owner


def pressed(*arrays: np.ndarray) -> bytes:
    """Arrays by planes of bytes, compressed."""
    raw = [np.array([len(arrays), *[x for a in arrays for x in (len(a), ord(a.dtype.char))]], dtype=np.int64).tobytes()]
    raw += [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"" for a in arrays]
    joined = b"".join(raw)
    return np.int64(len(joined)).tobytes() + pa.compress(joined, codec="zstd", asbytes=True)


def released(blob: pa.BinaryScalar) -> list[np.ndarray]:
    """The arrays of ``pressed``."""
    raw = blob.as_buffer()
    data = np.frombuffer(pa.decompress(raw.slice(8), int(np.frombuffer(raw, np.int64, 1)[0]), codec="zstd"), dtype=np.uint8)
    count = int(data[:8].view(np.int64)[0])
    sizes = data[8 : 8 + 16 * count].view(np.int64).reshape(-1, 2)
    out, at = [], 8 + 16 * count
    for length, kind in sizes.tolist():
        dtype = np.dtype(chr(kind))
        planes = data[at : at + length * dtype.itemsize].reshape(dtype.itemsize, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += length * dtype.itemsize
    return out


def steps_of(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def runs(ordered: np.ndarray) -> np.ndarray:
    """First places of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=np.int64)


def bounds(ordered: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the runs of equal values."""
    first = runs(ordered).tolist()
    return list(zip(first, [*first[1:], *([len(ordered)] if first else [])], strict=True))


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct small numbers and the place of each in them."""
    seen = np.zeros(int(codes.max()) + 1, dtype=bool)
    seen[codes] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.uint32) - np.uint32(1))[codes]


def _messages(buckets: int, with_texts: bool):
    """Rows (p, kind, g, data): kind 1 holds cells of bucket p, kind 2 the texts of group g.

    Cells are (word before, word, word before that), places in the message's list of word hashes, and their training count. With
    texts, also the count of all tokens of a cell and the text of each.
    """

    def cells(tokens: np.ndarray, owner: np.ndarray, train: np.ndarray, g: int):
        for lo in range(2, len(tokens), GROUP):
            hashes, place = np.unique(tokens[lo - 2 : lo + GROUP], return_inverse=True)
            place = place.astype(np.uint32)
            real = np.flatnonzero(tokens[lo : lo + GROUP] != START)
            bucket = (tx.mix(hashes) % np.uint64(buckets)).astype(np.uint32)[place[real + 1]]
            order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
            real, bucket = real[order], bucket[order]
            seen, rank = np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=np.uint64)
            for a, z in bounds(bucket):
                at = real[a:z]
                vwu = place[at + 1], place[at + 2], place[at]
                for x in vwu:
                    seen[x] = True
                used = np.flatnonzero(seen)
                rank[used] = np.arange(len(used), dtype=np.uint64)
                seen[used] = False
                v, w, u = (rank[x] for x in vwu)
                size = np.uint64(len(used))
                key, doc = (v * size + w) * size + u, owner[lo + at]
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[order]
                start = runs(key)
                n = np.add.reduceat(train[doc].astype(np.uint32), start, dtype=np.uint32)
                key = key[start]
                v, w, u = key // (size * size), key // size % size, key % size
                parts = [steps_of(hashes[used]), v.astype(np.uint32), w.astype(np.uint32), u.astype(np.uint32), n]
                if with_texts:
                    parts += [np.diff(start, append=len(doc)).astype(np.uint32), doc.astype(np.uint32)]
                yield int(bucket[a]), 1, g, pressed(*parts)

    def flush(held: list, g: int):
        tokens, owner, train, ids, null = (np.concatenate(x) for x in zip(*held, strict=True))
        yield from cells(tokens, owner, train, g)
        if with_texts:
            n = np.bincount(owner[tokens != START], minlength=len(ids))
            yield g % buckets, 2, g, pressed(ids, null, ~train, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        g = context.partitionId() << 32
        held, tokens, texts = [], 0, 0

        def rows(found):
            for p, kind, group, data in found:
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((p, pa.int64()), (kind, pa.int32()), (group, pa.int64()), (data, pa.binary()))], ["p", "kind", "g", "data"])

        for batch in batches:
            train = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            doc = batch.column("doc")
            ids, null = doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False)
            for first, end, data, offsets in tx.slices(batch.column("text")):
                found, owner = token_cells(data, offsets)
                held.append((found, owner + texts, train[first:end], ids[first:end], null[first:end]))
                tokens, texts = tokens + len(found), texts + end - first
                if tokens >= GROUP:
                    yield from rows(flush(held, g))
                    held, tokens, texts, g = [], 0, 0, g + 1
        if held:
            yield from rows(flush(held, g))

    return run


@lru_cache(4)
def seatings(discount: float) -> np.ndarray:
    """Log of the generalised Stirling numbers: the weight of c customers of one word at t tables, by [c, t]."""
    out = np.full((DRAWN + 1, DRAWN + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(DRAWN):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, :c + 1], np.log(np.maximum(c - discount * t, 0.0)) + out[c, 1 : c + 2])
    return out


def seat(n: np.ndarray, strength: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each word after seating its n customers; ``strength`` is (theta + d * tables) * P(parent).

    Given the strength, t tables have a weight of S(c, t) * strength**t: up to ``DRAWN`` customers of a word are seated together by a draw
    from these weights (a blocked Gibbs step), more of them by Gibbs passes over single customers, which aim at the same weights.
    """
    tables = np.minimum(n, 1)
    many = np.flatnonzero((n > 1) & (n <= DRAWN))
    many = many[np.argsort(n[many].astype(np.uint16), kind="stable")]
    for lo, hi in bounds(n[many]):
        c = int(n[many[lo]])
        t = np.arange(1, c + 1)
        for at in range(lo, hi, 1_000_000 // c):
            cell = many[at : min(hi, at + 1_000_000 // c)]
            weight = seatings(discount)[c, 1 : c + 1] + np.log(strength[cell])[:, None] * t
            weight -= weight.max(axis=1, keepdims=True)
            weight = np.cumsum(np.exp(weight, out=weight), axis=1)
            tables[cell] = 1 + (weight[:, :-1] < (rng.random(len(cell)) * weight[:, -1])[:, None]).sum(axis=1)
    large = np.flatnonzero(n > DRAWN)
    if len(large):
        tables[large] = reseated(n[large].astype(np.int64), strength[large], discount, rng)
    return tables


def reseated(c: np.ndarray, a: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of words of many customers. All sit at one table at first; each of ``PASSES`` Gibbs passes takes every customer from
    its table and seats it again, 1/32 of a word's customers at a time."""
    start = np.cumsum(c) - c
    total = int(c.sum())
    # a table is named by the customer who opened it, plus total for each pass
    table, size = np.zeros(total, dtype=np.int32 if (PASSES + 1) * total < 1 << 31 else np.int64), np.zeros((PASSES + 1) * total, dtype=np.int32)
    table[:], size[start] = np.repeat(start, c), c
    opened = np.ones(len(c), dtype=np.int64)

    def place(cell: np.ndarray, who: np.ndarray, first: np.ndarray, others: np.ndarray, shift: int, single: bool) -> None:
        """Seat customers among ``others`` of their word that stand from ``first`` on (going round); ``single``: one of each word."""
        weight = a[cell]
        new = rng.random(len(cell)) * (weight + np.maximum(others - discount * opened[cell], 1e-9)) < weight
        chosen = who + shift
        wait = np.flatnonzero(~new)
        base, many_more, others = start[cell[wait]], c[cell[wait]], others[wait]
        first = first[wait]
        while len(wait):
            j = first + (rng.random(len(wait)) * others).astype(np.int64)
            j -= np.where(j >= many_more, many_more, 0)
            at = table[base + j]
            ok = rng.random(len(wait)) * size[at] < size[at] - discount
            chosen[wait[ok]] = at[ok]
            again = ~ok
            wait, base, many_more, others, first = wait[again], base[again], many_more[again], others[again], first[again]
        table[who] = chosen
        if single:
            size[chosen] += 1
            opened[cell[new]] += 1
        else:
            np.add.at(size, chosen, np.int32(1))
            np.add.at(opened, cell[new], np.int64(1))

    def spread(active: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """(place in ``active``, number within it) of every customer of a round, and whether there is one of each word."""
        if not len(step) or step.max() == 1:
            return np.arange(len(active)), np.zeros(len(active), dtype=np.int64), True
        back = np.repeat(np.arange(len(active)), step)
        return back, np.arange(len(back)) - (np.cumsum(step) - step)[back], False

    for turn in range(1, PASSES + 1):
        done = np.zeros(len(c), dtype=np.int64)
        active = np.arange(len(c))
        while len(active):
            step = np.minimum(np.maximum(c[active] // 32, 1), c[active] - done[active])
            back, k, single = spread(active, step)
            cell = active[back]
            who = start[cell] + done[cell] + k
            left = table[who]
            if single:
                size[left] -= 1
                opened[cell[size[left] == 0]] -= 1
            else:
                np.subtract.at(size, left, np.int32(1))
                bare = size[left] == 0
                first = np.unique(left[bare], return_index=True)[1]
                np.subtract.at(opened, cell[bare][first], np.int64(1))
            done[active] += step
            place(cell, who, done[cell] % c[cell], (c[active] - step)[back], turn * total, single)
            active = active[done[active] < c[active]]
    return opened


def discount_of(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))


class Model:
    """Restaurants of the two upper levels: customers and tables, discounts, training tokens and vocabulary. ``parent`` names the
    restaurant below each of the upper ones; without it eight neighbours share one."""

    def __init__(self, fine_customers: np.ndarray, tokens: float, vocabulary: float, discounts: tuple[float, float, float], parent: np.ndarray | None = None) -> None:
        self.tokens, self.vocabulary, self.discounts = tokens, vocabulary, discounts
        self.fine_customers = fine_customers
        self.parent = np.arange(len(fine_customers)) // (FINE // COARSE) if parent is None else parent
        self.kinds = int(self.parent.max()) + 1
        self.set_tables(fine_customers * 0.7, self.below(fine_customers) * 0.4, tokens * 0.2)

    def below(self, fine: np.ndarray) -> np.ndarray:
        return np.bincount(self.parent, weights=fine, minlength=self.kinds)

    def set_tables(self, fine: np.ndarray, coarse: np.ndarray, words: float) -> None:
        d3, d2, d1 = self.discounts
        self.fine_back = THETA + d3 * fine
        self.coarse_back = THETA + d2 * coarse
        self.word_back = THETA + d1 * words
        self.fine_all, self.coarse_all, self.word_all = THETA + self.fine_customers, THETA + self.below(fine), THETA + coarse.sum()

    def unknown(self) -> float:
        return self.word_back / self.word_all / (self.vocabulary + 1)

    def sweeps(self, item: np.ndarray, ctx: np.ndarray, n: np.ndarray, count: int, rng: np.random.Generator, p_word: np.ndarray | None = None, pairs: tuple | None = None):
        """Yield (tables per fine cell, coarse keys, coarse tables, tables per word, P(word)) of each sweep, whose totals the model
        then holds. With ``p_word`` the restaurant of all words is seated elsewhere: its probabilities stay, its tables are None.
        ``pairs`` gives the coarse keys and each cell's place in them, where they are known."""
        d3, d2, d1 = self.discounts
        fixed, word_tables = p_word is not None, None
        if not fixed:
            words = int(item.max()) + 1 if len(item) else 0
            p_word = (np.bincount(item, weights=n, minlength=words) + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1))
        coarse_key, back = pairs or np.unique(item * self.kinds + self.parent[ctx], return_inverse=True)
        owner, kind = coarse_key // self.kinds, coarse_key % self.kinds
        p_coarse = p_word[owner]
        for _ in range(count):
            strength = p_coarse.astype(np.float32)[back]
            strength *= self.fine_back.astype(np.float32)[ctx]
            fine_tables = seat(n, strength, d3, rng)
            del strength
            customers = np.bincount(back, weights=fine_tables, minlength=len(coarse_key)).astype(np.int64)
            coarse_tables = seat(customers, self.coarse_back[kind] * p_word[owner], d2, rng)
            totals = np.bincount(ctx, weights=fine_tables, minlength=len(self.parent)), np.bincount(kind, weights=coarse_tables, minlength=self.kinds)
            if not fixed:
                arrived = np.bincount(owner, weights=coarse_tables, minlength=words).astype(np.int64)
                word_tables = seat(arrived, np.full(words, self.word_back / (self.vocabulary + 1)), d1, rng)
                self.set_tables(*totals, word_tables.sum())
                p_word = (arrived - d1 * word_tables + self.word_back / (self.vocabulary + 1)) / self.word_all
            else:
                self.set_tables(*totals, 0)
            p_coarse = (customers - d2 * coarse_tables + self.coarse_back[kind] * p_word[owner]) / self.coarse_all[kind]
            yield fine_tables, coarse_key, coarse_tables, word_tables, p_word


class Bucket:
    """Cells of one bucket from its messages: words, restaurants and training counts. ``back`` has the cell of each message's cells."""

    def __init__(self, messages: list[pa.BinaryScalar]) -> None:
        lists, codes, held, self.sizes = [], ([], [], []), [], []
        behind = 0
        for message in messages:
            steps, *vwu, n = released(message)[:5]
            lists.append(np.cumsum(steps, dtype=np.uint64))
            for code, x in zip(codes, vwu, strict=True):
                code.append(x + np.uint32(behind))
            held.append(n)
            self.sizes.append(len(n))
            behind += len(steps)
        hashes, place = np.unique(np.concatenate(lists), return_inverse=True)
        place = place.astype(np.uint32)

        v, w, u = (place[np.concatenate(code)] for code in codes)
        del lists, codes, place
        before, v = counted(v)
        used, w = counted(w)
        bits = [max(len(x) - 1, 1).bit_length() for x in (used, hashes)]
        if max(len(before) - 1, 1).bit_length() + sum(bits) <= 64:
            key = v.astype(np.uint64)
            for x, width in ((u, bits[1]), (w, bits[0])):
                key <<= np.uint64(width)
                key |= x
            order = np.argsort(key)
            del key, x
        else:
            order = np.lexsort((w, u, v))
        small = np.uint32 if len(order) < 1 << 32 else np.int64
        order = order.astype(small)
        v, u = v[order], u[order]
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
        del u
        self.parent = v[fresh].astype(np.int64)
        del v
        ctx, w = np.cumsum(fresh, dtype=small) - small(1), w[order]
        fresh[1:] |= w[1:] != w[:-1]
        self.words, self.word, self.ctx = hashes[used], w[fresh], ctx[fresh]
        del w, ctx
        self.back = np.empty(len(order), dtype=small)
        self.back[order] = np.cumsum(fresh, dtype=small) - small(1)
        self.n = np.add.reduceat(np.concatenate(held)[order], np.flatnonzero(fresh), dtype=np.int64)
        del order, held, fresh
        if self.n.max() < 1 << 31:
            self.n = self.n.astype(np.int32)
        self.kinds = len(before)
        self.pair, of_pair = np.unique(self.word * np.int64(self.kinds) + self.parent[self.ctx], return_inverse=True)
        self.of_pair = of_pair.astype(small)
        del of_pair
        self.count = np.bincount(self.word, weights=self.n, minlength=len(self.words)).astype(np.int64)
        self.customers = np.bincount(self.ctx, weights=self.n, minlength=len(self.parent))
        del self.word

    def holding(self) -> list[int]:
        """Cells of the two upper levels that hold one and two customers, each upper cell being one table."""
        pair = np.bincount(self.of_pair, weights=self.n > 0)
        return [int((x == k).sum()) for x in (self.n, pair) for k in (1, 2)]

    def sweeps(self, discounts: tuple[float, float, float], count: int, p_word: np.ndarray, rng: np.random.Generator):
        """(model, tables of each cell, tables of each pair of word and word before) of each sweep."""
        model = Model(self.customers, 0, 0, discounts, self.parent)
        for fine, _, coarse, *_ in model.sweeps(None, self.ctx, self.n, count, rng, p_word, (self.pair, self.of_pair)):
            yield model, fine, coarse

    def probabilities(self, discounts: tuple[float, float, float], p_word: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Predictive probability of every cell, averaged over the sweeps after one of burn-in."""
        d3, d2, _ = discounts
        word, kind = self.pair // self.kinds, self.pair % self.kinds
        out = np.zeros(len(self.n), dtype=np.float32)
        for sweep, (model, fine, coarse) in enumerate(self.sweeps(discounts, SAMPLES + 1, p_word, rng)):
            if sweep:
                p = np.bincount(self.of_pair, weights=fine, minlength=len(kind)) - d2 * coarse
                p = (p + model.coarse_back[kind] * p_word[word]) / model.coarse_all[kind]
                p = p[self.of_pair]
                p *= model.fine_back[self.ctx]
                p += self.n
                p -= d3 * fine
                p /= model.fine_all[self.ctx]
                out += p.astype(np.float32)
        return out / SAMPLES


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """One table per key from batches that come sorted by it."""
    for table in tx.whole_groups(batches, key):
        for a, z in bounds(table.column(key).to_numpy()):
            yield table.slice(a, z - a)


def _rng(*seed: int) -> np.random.Generator:
    return np.random.default_rng([int(x) for x in seed])


def _row(names: list[str], types: list[pa.DataType], *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)


def _requests(ranges: int):
    """(r, p, data) of the words of each bucket by ranges of word hashes: hashes, training counts and customers for the
    restaurant of all words, and the bucket's counts of cells of one and two customers with the first range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "p"):
            p = table.column("p")[0].as_py()
            bucket = Bucket(list(table.column("data")))
            holding = bucket.holding()
            discounts = (discount_of(*holding[:2]), discount_of(*holding[2:]), 0.5)
            # the chain starts from the bucket's own share of each word
            p_word = (bucket.count + 0.5) / (bucket.count.sum() + 0.5 * (len(bucket.count) + 1))
            (_, _, coarse), = bucket.sweeps(discounts, 1, p_word, _rng(p, 1))
            seats = np.bincount(bucket.pair // bucket.kinds, weights=coarse, minlength=len(bucket.words))
            at = bucket.words * np.uint64(ranges) // np.uint64(1 << 56) if ranges < 256 else (bucket.words >> np.uint64(24)) * np.uint64(ranges) >> _LONG
            for a, z in bounds(at):
                sums = np.array(holding if a == 0 else [0, 0, 0, 0], dtype=np.int64)
                data = pressed(steps_of(bucket.words[a:z]), bucket.count[a:z], seats[a:z].astype(np.int64), sums)
                yield _row(["r", "p", "data"], [pa.int64(), pa.int64(), pa.binary()], int(at[a]), p, data)

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per range of words: their training counts and customers, sums of the buckets' counts, and each bucket's places."""
    for table in _groups(batches, "r"):
        asked = [released(x) for x in table.column("data")]
        lists = [np.cumsum(x[0], dtype=np.uint64) for x in asked]
        hashes, back = np.unique(np.concatenate(lists), return_inverse=True)
        count, arrived = (np.bincount(back, weights=np.concatenate([x[k] for x in asked]), minlength=len(hashes)).astype(np.int64) for k in (1, 2))
        steps = np.concatenate([steps_of(x) for x in np.split(back, np.cumsum([len(x) for x in lists])[:-1])])
        data = pressed(count, arrived, np.sum([x[3] for x in asked], axis=0), table.column("p").to_numpy(), np.array([len(x) for x in lists]), steps.astype(np.int32))
        yield _row(["r", "data"], [pa.int64(), pa.binary()], table.column("r")[0].as_py(), data)


def _slots(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int64)), pa.array(values.astype(np.float64))], ["slot", "value"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training tokens, vocabulary, customers of all words, and cells that hold one and two customers, by level."""
    for batch in batches:
        for data in batch.column("data"):
            count, arrived, sums, *_ = released(data)
            yield _slots(np.array([count.sum(), (count > 0).sum(), arrived.sum(), *sums, (arrived == 1).sum(), (arrived == 2).sum()]))


def _seated(strength: float, discount: float):
    """Rows of ``_ranges`` with the tables of each word, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, data in zip(batch.column("r").to_pylist(), batch.column("data"), strict=True):
                count, arrived, _, *places = released(data)
                tables = seat(arrived, np.full(len(arrived), strength), discount, _rng(r, 2))
                yield _row(["r", "tables", "data"], [pa.int64(), pa.int64(), pa.binary()], r, int(tables.sum()), pressed(count, arrived, tables, *places))

    return run


def _answers(discount: float, customers: float, tables: float, vocabulary: float):
    """(p, kind 0, r, data) with training counts and probabilities of the words that each bucket asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, data in zip(batch.column("r"), batch.column("data"), strict=True):
                count, arrived, seats, buckets, sizes, steps = released(data)
                p_word = (arrived - discount * seats + (THETA + discount * tables) / (vocabulary + 1)) / (THETA + customers)
                ends = np.cumsum(sizes)
                for p, a, z in zip(buckets.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                    at = np.cumsum(steps[a:z], dtype=np.int64)
                    yield _row(["p", "kind", "g", "data"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()], p, 0, r.as_py(), pressed(count[at], p_word[at].astype(np.float32)))

    return run


def _partial(discounts: tuple[float, float, float], tokens: float, vocabulary: float):
    """(g, kind, data) with sums per text of a group: place, known tokens, base score and score; texts of kind 2 pass through."""
    out = ["g", "kind", "data"], [pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "p"):
            p = table.column("p")[0].as_py()
            kinds, groups, data = table.column("kind").to_pylist(), table.column("g").to_pylist(), list(table.column("data"))
            for kind, g, x in zip(kinds, groups, data, strict=True):
                if kind == 2:
                    yield _row(*out, g, 2, x.as_py())
            answers = [released(data[i]) for i in sorted((i for i, k in enumerate(kinds) if k == 0), key=groups.__getitem__)]
            asked = [i for i, k in enumerate(kinds) if k == 1]
            if not asked:
                continue
            bucket = Bucket([data[i] for i in asked])
            count, p_word = (np.concatenate([a[k] for a in answers]) for k in (0, 1))
            score = np.log10(bucket.probabilities(discounts, p_word.astype(np.float64), _rng(p, 3)))
            base = np.log10((count + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
            known, of_cell = count > 0, np.split(bucket.back, np.cumsum(bucket.sizes)[:-1])
            word = (bucket.pair // bucket.kinds).astype(np.uint32)[bucket.of_pair]
            del bucket
            for i, cells in zip(asked, of_cell, strict=True):
                *_, times, doc = released(data[i])
                cell = np.repeat(cells, times)
                texts, at = counted(doc)
                sums = [np.bincount(at, weights=x, minlength=len(texts)) for x in (known[word[cell]], base[word[cell]], score[cell])]
                yield _row(*out, groups[i], 1, pressed(steps_of(texts.astype(np.int32)), sums[0].astype(np.uint32), sums[1], sums[2].astype(np.float32)))

    return run


def _totals(tokens: float):
    """Rows of the texts of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, "g"):
            kinds, data = table.column("kind").to_pylist(), list(table.column("data"))
            ids, null, held, n = released(data[kinds.index(2)])
            known, base, score = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids)), np.zeros(len(ids))
            for kind, x in zip(kinds, data, strict=True):
                if kind == 1:
                    steps, *sums = released(x)
                    at = np.cumsum(steps, dtype=np.int64)
                    for whole, part in zip((known, base, score), sums, strict=True):
                        whole[at] += part
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=null), pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(ids), int(tokens))), pa.array(base), pa.array(score)],
                ["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return run


def score_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", remainder: int = HELD_OUT, batch_text: int = BATCH_TEXT) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are whitespace-separated words, A-Z lowered, and one end per text. Rows whose crc32(id as text) modulo 5 is
    ``remainder`` are held out of training. ``base_score`` is the add-half unigram score, ``score`` the model's log10 probability of
    the text; ``perplexity`` gives 10**(-score/n_tokens). A null text is empty: one end. A null id is trained on. Repeated rows are
    counted and scored as often as they occur. If nothing can be trained on, every token is unknown. Further columns are ignored.
    A bucket takes the tokens of about ``batch_text`` bytes of text.
    """
    from cohortloom.llm.quality import held_out

    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = tx.bounded_batches(documents.select(F.col(id_col).cast("bigint").alias("doc"), text.alias("text")), 16 << 20)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(size // batch_text) + 1
    ranges = -(-buckets // BUCKETS_A_RANGE)
    dealt = docs.withColumn("held_out", held_out("doc", remainder))
    message = "p bigint, kind int, g bigint, data binary"

    def gathered(rows: DataFrame, key: str, parts: int) -> DataFrame:
        return rows.repartition(parts, F.col(key)).sortWithinPartitions(key)

    asked = gathered(dealt.mapInArrow(_messages(buckets, False), message), "p", buckets).mapInArrow(_requests(ranges), "r bigint, p bigint, data binary")
    table = written(gathered(asked, "r", ranges).mapInArrow(_ranges, "r bigint, data binary"))

    got = table.mapInArrow(_sums, "slot bigint, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    sums = {r["slot"]: r["value"] for r in got}
    tokens, vocabulary, customers, *holding = (sums.get(k, 0.0) for k in range(9))
    discounts = tuple(discount_of(one, two) for one, two in zip(holding[::2], holding[1::2], strict=True))
    strength = (THETA + discounts[2] * 0.5 * customers) / (vocabulary + 1)
    seated = written(table.mapInArrow(_seated(strength, discounts[2]), "r bigint, tables bigint, data binary"))
    tables = seated.agg(F.sum("tables")).first()[0] or 0
    answers = seated.mapInArrow(_answers(discounts[2], customers, tables, vocabulary), message)
    both = dealt.mapInArrow(_messages(buckets, True), message).unionByName(answers)
    parts = gathered(both, "p", buckets).mapInArrow(_partial(discounts, tokens, vocabulary), "g bigint, kind int, data binary")
    return (
        tx.grouped_rows(parts, "g")
        .mapInArrow(_totals(tokens), "doc bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
        .withColumnRenamed("doc", id_col)
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """Scored rows with ``perplexity``, the inverse mean probability of a token."""
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
