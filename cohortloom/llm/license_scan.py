"""License scan: matching statistics against a generalised suffix automaton of license templates.

The automaton holds every run of words of every template and is built once per run from the template texts (a small
parameter). Each document streams through it: at every word the automaton gives the longest run, ending there, that some
template holds. Words that no template uses end every run, so only stretches of template words are walked. A long match is
then read against each template that shares a part of it, so a short notice inside a longer text is found too. Long matches
are then chained: matches of one template in rising order and with small gaps make one covered template span, and a
template counts when its spans cover enough of it.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import textops as tx

#: Phrase, label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Opening sentences of public license notices, then whole public license texts: label, words.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
     "distribute sublicense and or sell copies of the software"),
    ("mit", "licensed under the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
     "you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
     "published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
     "conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("public-domain", "this work is dedicated to the public domain under cc0 1 0 universal"),
    ("reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means "
     "without the prior written permission of the publisher"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
     "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
     "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
     "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited "
     "to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
     "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising "
     "from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
     "conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the "
     "following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
     "following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the "
     "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
     "specific prior written permission this software is provided by the copyright holders and contributors as is and any express or "
     "implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose "
     "are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special "
     "exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or "
     "profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort "
     "including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such "
     "damage"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
     "that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author "
     "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event "
     "shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss "
     "of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with "
     "the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
     "damages arising from the use of this software permission is granted to anyone to use this software for any purpose including "
     "commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this "
     "software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product "
     "an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly "
     "marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any "
     "source distribution"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
     "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in "
     "writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind "
     "either express or implied see the license for the specific language governing permissions and limitations under the license"),
)
MIN_MATCH, MAX_GAP, MIN_COVER = 4, 6, 0.6


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of small integers; a state keeps one end position of its runs."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [(-1, -1)]

    def _state(self, length: int, edges: dict[int, int], link: int, end: tuple[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.end[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int], number: int) -> None:
        last = 0
        for place, symbol in enumerate(sequence):
            p, q = last, self.next[last].get(symbol, -1)
            if q >= 0:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
                continue
            last = self._state(self.length[p] + 1, {}, 0, (number, place))
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)

    def statistics(self, sequence: list[int]) -> list[tuple[int, int]]:
        """(longest matched length, state) at every place of the sequence."""
        state = length = 0
        out = []
        for symbol in sequence:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state, length = self.next[state][symbol], length + 1
            out.append((length, state))
        return out


def build(templates=TEMPLATES) -> tuple[SuffixAutomaton, dict[str, int], list[list[int]]]:
    vocabulary: dict[str, int] = {}
    coded = [[vocabulary.setdefault(w, len(vocabulary)) for w in text.split()] for _, text in templates]
    automaton = SuffixAutomaton()
    for number, sequence in enumerate(coded):
        automaton.add(sequence, number)
    return automaton, vocabulary, coded


def maximal_matches(automaton: SuffixAutomaton, sequence: list[int], least: int = MIN_MATCH) -> list[tuple[int, int]]:
    """(start, length) of the matches that the next word does not continue and that are long enough."""
    stats = automaton.statistics(sequence)
    out = []
    for i, (length, _) in enumerate(stats):
        if length >= least and (i + 1 == len(stats) or stats[i + 1][0] != length + 1):
            out.append((i + 1 - length, length))
    return out


def chains(matches: list[tuple[int, int]], sequence: list[int], template: list[int], max_gap: int = MAX_GAP) -> list[tuple[int, int, int]]:
    """(words covered, start, end) of the best chains of matches inside one template that do not overlap in the document, by start.

    Matches are placed at every position where the template holds them; a chain rises in both the document and the template, and skips
    at most ``max_gap`` words of either between two matches.
    """
    placed = []
    for start, length in matches:
        run = sequence[start : start + length]
        placed += [(start, length, at) for at in range(len(template) - length + 1) if template[at : at + length] == run]
    best: list[tuple[int, int]] = []
    tops: dict[int, tuple[int, int, int]] = {}  # the best chain from each start
    for i, (start, length, at) in enumerate(placed):
        gain, begin = length, start
        for j in range(i - 1, -1, -1):
            (s, n, a), (g, b) = placed[j], best[j]
            if start - (s + n) > max_gap + len(template):
                break
            if 0 <= start - (s + n) <= max_gap and 0 <= at - (a + n) <= max_gap and g + length > gain:
                gain, begin = g + length, b
        best.append((gain, begin))
        if gain > tops.get(begin, (0, 0, 0))[0]:
            tops[begin] = (gain, begin, start + length)
    taken: list[tuple[int, int, int]] = []  # (start, end, covered), in order
    for gain, begin, end in sorted(tops.values(), key=lambda c: (-c[0], c[1])):
        at = bisect.bisect(taken, (begin, end, gain))
        if (at == 0 or taken[at - 1][1] <= begin) and (at == len(taken) or end <= taken[at][0]):
            taken.insert(at, (begin, end, gain))
    return [(gain, begin, end) for begin, end, gain in taken]


def chain(matches: list[tuple[int, int]], sequence: list[int], template: list[int], max_gap: int = MAX_GAP) -> tuple[int, int, int]:
    """(words covered, start, end) of the best of the chains, the earliest of equal ones; zeros without any."""
    return max(chains(matches, sequence, template, max_gap), key=lambda c: c[0], default=(0, 0, 0))


def _scan(phrases, templates):
    automaton, vocabulary, coded = build(templates)
    known = np.array([tx.word_hash(w) for w in vocabulary], dtype=np.uint64)
    order = np.argsort(known)
    known, code = known[order], np.array(list(vocabulary.values()), dtype=np.int64)[order]
    wanted = [(np.array([tx.word_hash(w) for w in phrase.split()], dtype=np.uint64), label) for phrase, label in phrases]
    own, holders = [], {}  # an automaton for each template, and the templates of every run of MIN_MATCH words
    for number, sequence in enumerate(coded):
        own.append(SuffixAutomaton())
        own[-1].add(sequence, number)
        for i in range(len(sequence) - MIN_MATCH + 1):
            holders.setdefault(tuple(sequence[i : i + MIN_MATCH]), set()).add(number)

    def inside(run: tuple[int, ...]) -> list[tuple[int, int, int]]:
        """(template, start, length) of what each template holds of a run that at least one of them holds whole."""
        numbers = set().union(*(holders.get(run[i : i + MIN_MATCH], ()) for i in range(len(run) - MIN_MATCH + 1)))
        return [(number, *match) for number in sorted(numbers) for match in maximal_matches(own[number], list(run))]

    def matched(ids: np.ndarray, inside) -> dict[int, list[tuple[int, int, int]]]:
        """Spans (first word, words covered, end) by template, of one document's word codes (-1 for unknown words)."""
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids >= 0).astype(np.int8), [0]])))
        found: dict[int, list[tuple[int, int]]] = {}
        for low, high in zip(edge[::2], edge[1::2], strict=True):
            if high - low < MIN_MATCH:
                continue
            sequence = ids[low:high].tolist()
            for start, length in maximal_matches(automaton, sequence):
                for number, ahead, part in inside(tuple(sequence[start : start + length])):
                    found.setdefault(number, []).append((int(low) + start + ahead, part))
        listed = ids.tolist() if found else []
        spans: dict[int, list[tuple[int, int, int]]] = {}
        for number, matches in found.items():
            gathered: list[list[tuple[int, int]]] = []
            for match in sorted(set(matches)):
                if gathered and match[0] - sum(gathered[-1][-1]) <= MAX_GAP:
                    gathered[-1].append(match)
                else:
                    gathered.append([match])
            for stretch in gathered:
                for covered, begin, end in chains(stretch, listed, coded[number]):
                    spans.setdefault(number, []).append((begin, covered, end))
        return spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = functools.lru_cache(maxsize=4096)(inside)  # runs recur
        for batch in batches:
            for first, end, data, offsets in tx.slices(batch.column("_text")):
                rows = end - first
                h, row = tx.words(data, offsets)
                cuts = np.searchsorted(row, np.arange(rows + 1))
                n_base = np.zeros(rows, dtype=np.int64)
                low, high = np.full(rows, np.iinfo(np.int64).max), np.full(rows, -1)
                base: list[set[str]] = [set() for _ in range(rows)]
                for hashes, label in wanted:
                    m = len(hashes)
                    ok = np.ones(max(len(h) - m + 1, 0), dtype=bool)
                    for k in range(m):
                        ok &= h[k : k + len(ok)] == hashes[k]
                    at = np.flatnonzero(ok)
                    at = at[row[at] == row[at + m - 1]]
                    np.add.at(n_base, row[at], 1)
                    np.minimum.at(low, row[at], at - cuts[row[at]])
                    np.maximum.at(high, row[at], at - cuts[row[at]])
                    for r in np.unique(row[at]):
                        base[r].add(label)
                spot = np.searchsorted(known, h).clip(0, len(known) - 1)
                ids = np.where(known[spot] == h, code[spot], -1)
                hit = ids >= 0
                runs = hit.copy()
                for k in range(1, MIN_MATCH):
                    runs[: len(runs) - k] &= hit[k:]
                    runs[len(runs) - k :] = False
                look = np.unique(row[runs])
                score, labels = np.zeros(rows), [set(x) for x in base]
                spans: list[list[dict]] = [[] for _ in range(rows)]
                for r in look:
                    for number, found in matched(ids[cuts[r] : cuts[r + 1]], kept).items():
                        for begin, covered, stop in found:
                            cover = covered / len(coded[number])
                            score[r] = max(score[r], cover)
                            spans[r].append({"template": number, "start": begin, "end": stop, "covered": int(covered)})
                            if cover >= MIN_COVER:
                                labels[r].add(templates[number][0])
                score = np.where(n_base > 0, 1.0, score).clip(0, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(first, rows), pa.array(np.diff(cuts).astype(np.int64)), pa.array(n_base),
                        pa.array(low, mask=n_base == 0), pa.array(high, mask=n_base == 0),
                        pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x)) for x in labels]), pa.array(score),
                        pa.array(spans, pa.list_(pa.struct([("template", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64())]))),
                    ],
                    ["doc", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return run


def scan_licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score, spans (template number, words start to end, words covered).

    ``labels`` adds to the phrase labels those of templates of which one chain covers at least ``MIN_COVER``; ``score`` is
    1 where a phrase stands, else the largest share of a template covered. Null and empty texts have no words, empty
    labels and score 0. Repeated rows and null ids are scanned like others. Further columns are ignored.
    """
    docs = tx.bounded_batches(documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("_text")))
    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(
        _scan(phrases, templates),
        f"doc {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
        "spans array<struct<template: bigint, start: bigint, end: bigint, covered: bigint>>",
    ).withColumnRenamed("doc", id_col)
