r"""Operator 9: licence scan by a generalised suffix automaton of licence tokens.

The automaton holds every run of words of all templates. A text is streamed through it word by word; at each word the matching statistic is the length
of the longest run that ends there and is in a template. Maximal runs of `LONG` words or more are anchors; anchors of one template chain
where they go on in both text and template, and the share of the template that the best chain covers is its coverage. A template of
which COVERED or more is found gives its label. The short base phrases are templates too: the automaton points to where they may end, and their words confirm.

Defined cases: a null or empty text has no words, no labels and score 0; case matters for other letters than A-Z only; places may overlap; repeated rows give
repeated results; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8
LONG, COVERED = 4, 0.5
#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Sentences by which licences are commonly declared, and the grants and notices of licences of their own; words only, in lower case.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd-2", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
]


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Automaton:
    """Generalised suffix automaton over word numbers; each state knows the places (template, end) of its runs."""

    def __init__(self, templates: list[list[bytes]]) -> None:
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [set()]
        for t, words in enumerate(templates):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, self.number.setdefault(w, len(self.number)))
                self.ends[last].add((t, i + 1))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, c: int) -> int:
        """The state that p leads to by c, as one whose longest run is that of p and c."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def statistics(self, numbers: list[int]) -> Iterator[tuple[int, int]]:
        """(state, matching statistic) after each word."""
        state = size = 0
        for c in numbers:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            else:
                size = 0
            yield state, size


@lru_cache(maxsize=4)
def _built(templates: tuple[tuple[str, str], ...], base: tuple[tuple[str, str], ...]) -> tuple[Automaton, list[list[bytes]], list[tuple[tuple[bytes, ...], str]]]:
    texts = [words_of(t) for _, t in templates] + [words_of(p) for p, _ in base]
    return Automaton(texts), texts, [(tuple(words_of(p)), label) for p, label in base]


def scan(text: str | None, templates=tuple(TEMPLATES), base=tuple(BASE.items())) -> tuple[int, list[int], set[str], dict[str, float], list[tuple[int, int, int]]]:
    """Number of words, starts of base phrases, their labels, coverage by label, and the spans (template, first, end) of the best chains."""
    machine, texts, phrases = _built(templates, base)
    words = words_of(text)
    numbers = np.fromiter((machine.number.get(w, -1) for w in words), np.int32, len(words))
    known = np.r_[False, numbers >= 0, False]
    edges = np.flatnonzero(known[1:] != known[:-1])
    shortest = min([LONG, *(len(p) for p, _ in phrases)])
    starts, base_labels, anchors = [], set(), {}
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if b - a < shortest:
            continue  # no run of known words is long enough here
        stats = list(machine.statistics(numbers[a:b].tolist()))
        for i, (state, size) in enumerate(stats):
            end = a + i + 1
            for phrase, label in phrases:
                if size >= len(phrase) and tuple(words[end - len(phrase) : end]) == phrase:
                    starts.append(end - len(phrase))
                    base_labels.add(label)
            if size >= LONG and (i + 1 == len(stats) or stats[i + 1][1] != size + 1):  # maximal
                while machine.length[machine.link[state]] >= size:
                    state = machine.link[state]
                for t, at in machine.ends[state]:
                    anchors.setdefault(t, []).append((end - size, end, at - size, at))
    coverage, spans = {}, []
    for t, found in anchors.items():
        if t >= len(templates):
            continue
        label, best, found, reach, from_ = templates[t][0], [], sorted(found), len(texts[t]), 0
        for x0, x1, y0, y1 in found:  # longest chain; a chain's gaps in the text are no longer than the template
            while x0 - found[from_][0] > 2 * reach:
                from_ += 1  # too far back for any later anchor
            value = (y1 - y0, x0)
            for j in range(from_, len(best)):
                _, px1, _, py1 = found[j]
                if px1 <= x0 <= px1 + reach and py1 <= y0:
                    value = max(value, (best[j][0] + y1 - y0, best[j][1]))
            best.append(value)
        top = max(range(len(found)), key=lambda i: best[i][0])
        share = best[top][0] / len(texts[t])
        coverage[label] = max(coverage.get(label, 0.0), share)
        if share >= COVERED:
            spans.append((t, best[top][1], found[top][1]))
    return len(words), starts, base_labels, coverage, sorted(spans)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, starts (of base phrases), base_labels, labels, score, spans (label, first word, end) for each row of docs (doc_id, text)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                n, starts, base, coverage, spans = scan(text)
                more = {label for label, share in coverage.items() if share >= COVERED}
                score = 1.0 if base else min(1.0, max(coverage.values(), default=0.0))
                out.append((i, n, starts, sorted(base), sorted(base | more), score, [{"label": TEMPLATES[t][0], "first": a, "end": b} for t, a, b in spans]))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "starts", "base_labels", "labels", "score", "spans"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_words long, starts array<long>, base_labels array<string>, labels array<string>, score double, spans array<struct<label:string,first:long,end:long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, schema)

