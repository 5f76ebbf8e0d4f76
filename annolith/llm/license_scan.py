"""License scans with a positional rare-token index.

The index holds, for each word of the licence templates and base phrases, its
postings (template, position) and its inverse document frequency, counted over
all documents.  A text is looked up by its own rarest licence words: in each stretch of
STRETCH words and for each template, the RARE words of it that have the highest IDF, so that no template's words crowd out another's.
Texts that lack too many of a template's words are left out for it.
Every occurrence p of such a word with posting (template, q)
votes for the start p - q; words may have been put in or left out, so starts are met in bins of a quarter of the template's
length, each vote counting in its own bin and the next.  Bins with votes of at least MIN_ANCHORS different words (fewer for
templates of few words) become candidates: the template is aligned with the words there (longest common subsequence).
(``exhaustive`` takes every bin of such texts instead: a check of what the votes leave out.)
A candidate stands if at least MIN_MATCH of the template's words are found in order and each of
its mandatory key phrases stands there in full.  Base phrases are anchored at their rarest word alone
and must match in full, so that every place is found.

Edge cases: null text has no words; repeated rows are each scanned; an empty
table gives no rows; other columns are ignored; a text with no licence has empty labels and score 0.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ragged, tidy
from .textvec import Slice, alphanumeric, folding, slices

STRETCH, RARE, MIN_ANCHORS, MIN_MATCH = 256, 16, 3, 0.8

# The phrases and labels of the contract.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Label, a licence's notice or text as lower-case words, and the key phrases that must stand in it (parted by semicolons).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    (
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in
        the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
        software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied
        including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright
        holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the
        software or the use or other dealings in the software""",
        "permission is hereby granted free of charge;without warranty of any kind",
    ),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "except in compliance with the license"),
    (
        "apache-2",
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license
        at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on
        an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and
        limitations under the license""",
        "apache license version 2;except in compliance with the license",
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    (
        "bsd-2",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of
        source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software
        is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of
        merchantability and fitness for a particular purpose are disclaimed""",
        "redistribution and use in source and binary forms;in binary form must reproduce the above copyright notice",
    ),
    (
        "bsd-3",
        """redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
        materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission""",
        "used to endorse or promote products derived from this software",
    ),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license"),
    (
        "gpl-3",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software
        foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any
        warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should
        have received a copy of the gnu general public license along with this program if not see http www gnu org licenses""",
        "terms of the gnu general public license;version 3 of the license",
    ),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    (
        "mpl-2",
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at
        http mozilla org mpl 2 0""",
        "mozilla public license v 2 0",
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "modify and or distribute this software for any purpose"),
    (
        "isc",
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and
        this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all
        implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages
        whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with
        the use or performance of this software""",
        "with or without fee is hereby granted;the author disclaims all warranties",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
]
_TABLE, _WORD = folding(lower=True), alphanumeric()


def _word_hashes(text: str) -> np.ndarray:
    (s,) = slices(pa.array([text]))
    begins, ends, _ = s.words(_WORD)
    return s.hashes(begins, ends, _TABLE)


class Index:
    """Postings of all licence words, with their inverse document frequency."""

    def __init__(self, idf: dict[str, float]):
        rank = lambda w: (-idf.get(w, math.inf), w)
        self.base = []
        for phrase, label in BASE.items():
            words = phrase.split()
            self.base.append((label, _word_hashes(phrase), words.index(min(words, key=rank))))
        names = vocabulary()
        hashes = np.array([_word_hashes(w)[0] for w in names])
        order = np.argsort(hashes)
        self.known, self.idf = hashes[order], np.array([idf.get(names[i], 0.0) for i in order])
        #: Which low bits of a hash may belong to a licence word: most words of a text end here.
        self.sieve = np.zeros(1 << 16, dtype=bool)
        self.sieve[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.templates = [(label, _word_hashes(text), [_word_hashes(k) for k in keys.split(";")]) for label, text, keys in TEMPLATES]
        sizes = [len(t) for _, t, _ in self.templates]
        word = np.searchsorted(self.known, np.concatenate([t for _, t, _ in self.templates]))
        by_word = np.argsort(word, kind="stable")
        #: Postings of word w: template and position at first[w] : first[w + 1].
        self.first = np.searchsorted(word[by_word], np.arange(len(self.known) + 1))
        self.template = np.repeat(np.arange(len(sizes)), sizes)[by_word]
        self.position = np.concatenate([np.arange(n) for n in sizes])[by_word]
        self.bin = np.array([max(2, n // 4) for n in sizes])
        #: Each word's templates, once each, at first_once[w] : first_once[w + 1], and how many different words of a template a text must hold.
        pairs = np.unique(word * len(sizes) + np.repeat(np.arange(len(sizes)), sizes))
        self.first_once, self.once = np.searchsorted(pairs // len(sizes), np.arange(len(self.known) + 1)), pairs % len(sizes)
        self.least = np.bincount(self.once, minlength=len(sizes)) - np.floor((1 - MIN_MATCH) * np.array(sizes) + 1e-9).astype(np.int64)
        self.need = np.array([min(MIN_ANCHORS, max(1, len(np.unique(t)) // 4)) for _, t, _ in self.templates])

    def licence_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers of the licence words there)."""
        at = np.flatnonzero(self.sieve[(words & np.uint64(0xFFFF)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.known, words[at]), len(self.known) - 1)
        hit = self.known[number] == words[at]
        return at[hit], number[hit]

    def possible(self, text: np.ndarray, number: np.ndarray, n_texts: int) -> np.ndarray:
        """[text, template]: whether a text holds enough of a template's different words anywhere; without them no alignment can reach MIN_MATCH."""
        held = np.unique(text * len(self.known) + number)
        owner, word = held // len(self.known), held % len(self.known)
        n = self.first_once[word + 1] - self.first_once[word]
        cells = np.repeat(owner, n) * len(self.least) + self.once[ragged(self.first_once[word], n)]
        return np.bincount(cells, minlength=n_texts * len(self.least)).reshape(n_texts, -1) >= self.least

    def postings(self, text: np.ndarray, number: np.ndarray, possible: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(occurrence, posting, template) of the occurrences of licence words and the templates that their texts may hold."""
        n = self.first[number + 1] - self.first[number]
        of, posting = np.repeat(np.arange(len(number)), n), ragged(self.first[number], n)
        template = self.template[posting]
        real = possible[text[of], template]
        return of[real], posting[real], template[real]

    def rarest(self, stretch: np.ndarray, template: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which postings (stretch of a text, template, word) are of the RARE rarest different words of their template in their stretch."""
        cell = stretch * len(self.templates) + template
        pairs, of = np.unique(cell * len(self.known) + number, return_inverse=True)
        cell, rarity = pairs // len(self.known), self.idf[pairs % len(self.known)]
        order = np.lexsort((-rarity, cell))
        new = np.concatenate([[True], cell[order][1:] != cell[order][:-1]])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        chosen = np.zeros(len(pairs), dtype=bool)
        chosen[order] = np.arange(len(order)) - begin < RARE
        return chosen[of]

    def candidates(self, text: np.ndarray, place: np.ndarray, number: np.ndarray, possible: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, template, bin) where enough different words vote for a start; occurrences come by text and place."""
        of, posting, template = self.postings(text, number, possible)
        if not len(of):
            return []
        stretch = np.cumsum(np.concatenate([[0], (text[1:] != text[:-1]) | (place[1:] // STRETCH != place[:-1] // STRETCH)]))
        rare = self.rarest(stretch[of], template, number[of])
        of, posting, template = of[rare], posting[rare], template[rare]
        bins = (place[of] - self.position[posting]) // self.bin[template] + 8  # a template has fewer than eight bins, so none is negative
        span, pair = int(bins.max()) + 1, text[of] * len(self.least) + template
        where = pair * span + bins
        votes = np.unique(np.concatenate([where, where - 1]) * len(self.known) + np.tile(number[of], 2))
        places, count = np.unique(votes // len(self.known), return_counts=True)
        pair, k = places // span, places % span - 8
        found = count >= self.need[pair % len(self.least)]
        return list(zip((pair[found] // len(self.least)).tolist(), (pair[found] % len(self.least)).tolist(), k[found].tolist(), strict=True))

    def every_bin(self, bounds: np.ndarray, possible: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, template, bin) of all bins of the texts that may hold a template."""
        return [(t, m, k) for t, m in np.argwhere(possible).tolist() for k in range(-1, int(bounds[t + 1] - bounds[t]) // int(self.bin[m]) + 1)]

    def aligned(self, words: np.ndarray, template: int) -> float:
        """Share of the template's words found in order among ``words``; 0 without its key phrases."""
        _, wanted, keys = self.templates[template]
        for key in keys:
            at = np.flatnonzero(words[: len(words) - len(key) + 1] == key[0]) if len(words) >= len(key) else []
            if not any((words[p : p + len(key)] == key).all() for p in at):
                return 0.0
        best = np.zeros(len(words) + 1, dtype=np.int64)  # longest common subsequence, one row for each word of the template
        for w in wanted:
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(words == w, best[:-1] + 1, 0)))
        return float(best[-1] / len(wanted))

    def scan(self, words: np.ndarray, bounds: np.ndarray, exhaustive: bool = False) -> list[tuple[int, str, int, float, bool]]:
        """(text, label, first word, share of the template's words, base phrase?) of all matches; words: hashes of all texts."""
        at, number = self.licence_words(words)
        here, text = words[at], np.searchsorted(bounds, at, side="right") - 1
        out = []
        for label, phrase, k in self.base:
            hit = here == phrase[k]
            start, owner = at[hit] - k, text[hit]
            fits = (start >= bounds[owner]) & (start + len(phrase) <= bounds[owner + 1])
            start, owner = start[fits], owner[fits]
            for j, h in enumerate(phrase):
                same = words[start + j] == h
                start, owner = start[same], owner[same]
            out += [(int(t), label, int(p - bounds[t]), 1.0, True) for p, t in zip(start, owner, strict=True)]
        if not len(at):
            return out
        possible = self.possible(text, number, len(bounds) - 1)
        some = possible.any(axis=1)[text]
        at, text, number = at[some], text[some], number[some]
        if not len(at):
            return out
        place = at - bounds[text]
        for t, template, k in self.every_bin(bounds, possible) if exhaustive else self.candidates(text, place, number, possible):
            size, bin_ = len(self.templates[template][1]), int(self.bin[template])
            low = max(0, k * bin_)  # a start lies in this bin or the next
            high = min(int(bounds[t + 1] - bounds[t]), (k + 2) * bin_ + size + size // 4)
            share = self.aligned(words[bounds[t] + low : bounds[t] + high], template)
            if share >= MIN_MATCH:
                out.append((t, self.templates[template][0], low, share, False))
        return out


def _scan_words(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    begins, ends, bounds = s.words(_WORD)
    return s.hashes(begins, ends, _TABLE), bounds


def vocabulary() -> list[str]:
    return sorted({w for p in BASE for w in p.split()} | {w for _, t, k in TEMPLATES for w in [*t.split(), *k.replace(";", " ").split()]})


def document_frequency(docs: DataFrame) -> dict[str, float]:
    """idf of the licence words over all documents."""
    names = vocabulary()
    hashes = np.array([_word_hashes(w)[0] for w in names])

    @tidy
    def count(batches):
        order = np.argsort(hashes)
        ranked = hashes[order]
        sieve = np.zeros(1 << 16, dtype=bool)
        sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        total, n = np.zeros(len(names), dtype=np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for s in slices(batch.column(0)):
                words, bounds = _scan_words(s)
                at = np.flatnonzero(sieve[(words & np.uint64(0xFFFF)).astype(np.int64)])
                place = np.minimum(np.searchsorted(ranked, words[at]), len(ranked) - 1)
                hit = ranked[place] == words[at]
                text = np.searchsorted(bounds, at[hit], side="right") - 1
                seen = np.unique(text * len(names) + place[hit])
                total += np.bincount(order[seen % len(names)], minlength=len(names))
        yield pa.RecordBatch.from_arrays([pa.array([*names, ""]), pa.array([*total.tolist(), n])], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # the licence vocabulary
    n = {r.word: r.n for r in rows}
    return {w: math.log((1 + n.get("", 0)) / (1 + n.get(w, 0))) for w in names}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(spark: SparkSession, docs: DataFrame, exhaustive: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (best share of a template's words, 1 for a base phrase)."""
    idf = document_frequency(docs)

    @tidy
    def run(batches):
        index = Index(idf)
        for batch in batches:
            for s in slices(batch.column(1)):
                words, bounds = _scan_words(s)
                n = s.n_texts
                base, first, last = np.zeros(n, dtype=np.int64), [None] * n, [None] * n
                base_labels, labels, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
                for t, label, at, share, is_base in index.scan(words, bounds, exhaustive):
                    labels[t].add(label)
                    score[t] = max(score[t], share)
                    if is_base:
                        base[t] += 1
                        base_labels[t].add(label)
                        first[t] = at if first[t] is None else min(first[t], at)
                        last[t] = at if last[t] is None else max(last[t], at)
                joined = lambda x: pa.array([",".join(sorted(y)) for y in x], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, n), pa.array(np.diff(bounds)), pa.array(base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), joined(base_labels), joined(labels), pa.array(score)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
