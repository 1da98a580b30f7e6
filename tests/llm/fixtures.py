"""Small corpora with copies, near copies, repeated passages, odd and long texts."""

from __future__ import annotations

import random

WORDS = [a + b for a in ("ra", "to", "mi", "ken", "sol", "vé", "dur", "pla") for b in ("", "n", "sta", "mel", "ö", "kit", "ber", "do", "xa", "ul")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int | None, str | None]]:
    """(doc_id, text): ids count from 0; the last rows are null, empty, blank, short, repeated and long ones."""
    rng = random.Random(seed)
    passage = "\n".join(sentence(rng, 30) for _ in range(2))
    texts: list[str | None] = []
    for i in range(n):
        lines = [sentence(rng, rng.randint(3, 40)) for _ in range(rng.randint(2, 8))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        texts.append("\n".join(lines))
    for i in range(0, n, 6):
        words = texts[i].split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
        texts.append(texts[i])
    texts += [None, "", " \n\n ", "!!", "one two", "One two!", "ra " * 3000, "\n".join(sentence(rng, 25) for _ in range(300))]
    rows: list[tuple[int | None, str | None]] = list(enumerate(texts))
    return [*rows, rows[3], (7, "another text under the same id, with more than five words"), (None, "no id here " + passage)]


SCHEMA = "doc_id bigint, text string"
