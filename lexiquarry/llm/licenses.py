"""Licence scans: matching statistics from a generalised suffix automaton, chained into template spans."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordbytes import ALNUM, LOWER, mix, slices, words

#: Shortest match that a chain takes, words between two matches of a chain at most, and the share of
#: a template that a chain must cover. A span that counts covers MIN_WORDS words, or a whole template.
MIN_MATCH, MAX_GAP, MIN_COVER, MIN_WORDS = 3, 16, 0.6, 5

# The phrases and labels of the base scan.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Notices as their publishers word them (templates of the scan).
TEMPLATES = (
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)


def tokens(text: str) -> np.ndarray:
    low = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return words(low, np.array([0, len(low)]), ALNUM)[2]


class SuffixAutomaton:
    """All substrings of several token sequences; one state for those that end at the same places."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, seq in enumerate(sequences):
            last = 0
            for at, token in enumerate(seq):
                last = self._extend(last, token)
                self.ends[last].add((number, at))
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):  # places go to suffixes
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.link) - 1

    def _split(self, p: int, token: int) -> int:
        """The state of p's longest string and token, cut off from a longer one where needed."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        now, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = now
            p = self.link[p]
        if p >= 0:
            self.link[now] = self._split(p, token)
        return now

    def statistics(self, seq: list[int]):
        """(state, length) of the longest known string that ends at each place."""
        s = n = 0
        for token in seq:
            while s and token not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if token in self.next[s]:
                s, n = self.next[s][token], n + 1
            yield s, n


def chain(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Chains (first word, last word, covered template words) of matches (text start, template start, words).

    A match continues a chain if it starts after its last match in both, MAX_GAP words after it at
    most; where the two overlap, the overlap counts once. Each match takes the best chain before
    it, and each chain is reported where it covers most.
    """
    matches = sorted(set(matches), key=lambda m: (m[0] + m[2], m))
    best: list[tuple[int, int, int]] = []  # covered, first word, index of the chain's start
    low = 0
    for i, (t, p, n) in enumerate(matches):
        own = (n, t, i)
        while low < i and matches[low][0] + matches[low][2] + MAX_GAP + n < t:
            low += 1
        for j in range(low, i):
            u, q, m = matches[j]
            skip = max(0, u + m - t, q + m - p)
            if u < t and q < p and skip < n and t + skip - (u + m) <= MAX_GAP and p + skip - (q + m) <= MAX_GAP:
                own = max(own, (best[j][0] + n - skip, best[j][1], best[j][2]), key=lambda b: b[0])
        best.append(own)
    top: dict[int, tuple[int, int, int]] = {}
    for (t, _, n), (covered, first, start) in zip(matches, best):
        if start not in top or covered > top[start][2]:
            top[start] = (first, t + n - 1, covered)
    return list(top.values())


def counted(spans: list[tuple]) -> list[tuple]:
    """Spans (label, first, last, share, covered words) that count.

    They cover MIN_WORDS words or a whole template, and share no more than half the words of the shorter one with a
    span of another label that covers a larger share of its template, or as large a share in more words: licences
    share much of their wording, and a notice is the one that it has most of. Equal ones all count.
    """
    fit = sorted((s for s in spans if s[4] >= MIN_WORDS or s[3] == 1.0), key=lambda s: (s[1], s[2]))
    lost = [False] * len(fit)
    active: list[int] = []
    for i, a in enumerate(fit):
        active = [j for j in active if fit[j][2] >= a[1]]
        for j in active:
            b = fit[j]
            common = min(a[2], b[2]) - a[1] + 1
            if a[0] != b[0] and 2 * common > min(a[2] - a[1], b[2] - b[1]) + 1:
                lost[i] |= a[3:] < b[3:]
                lost[j] |= b[3:] < a[3:]
        active.append(i)
    return [s for s, gone in zip(fit, lost) if not gone]


class LicenseIndex:
    """What a scan needs of base phrases and templates."""

    def __init__(self, base=BASE, templates=TEMPLATES):
        self.base = base
        texts = [p for p, _ in base] + [t for _, t in templates]
        self.labels = [x for _, x in base] + [x for x, _ in templates]
        hashed = [tokens(t) for t in texts]
        self.vocab = np.unique(np.concatenate(hashed))
        seqs = [np.searchsorted(self.vocab, h).tolist() for h in hashed]
        self.sizes = [len(s) for s in seqs]
        self.sa = SuffixAutomaton(seqs)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(mix(self.vocab) >> np.uint64(48)).astype(np.int64)] = True
        v = len(self.vocab)
        self.pairs = np.zeros((v, v), bool)
        self.whole = np.zeros((v, v), bool)
        for s in seqs:
            self.pairs[s[:-1], s[1:]] = True
            if len(s) == 2:
                self.whole[s[0], s[1]] = True
        # base phrases that are suffixes of a state's strings
        self.marks: list[tuple[int, ...]] = [()] * len(self.sa.link)
        own: dict[int, list[int]] = {}
        for k in range(len(base)):
            *_, (s, _) = self.sa.statistics(seqs[k])
            own.setdefault(s, []).append(k)
        for s in sorted(range(1, len(self.sa.link)), key=lambda s: self.sa.length[s]):
            self.marks[s] = (*own.get(s, ()), *self.marks[self.sa.link[s]])

    def runs(self, h: np.ndarray, bounds: np.ndarray):
        """(first, ids) of runs of words of which each two neighbours stand in some template so.

        Between runs no string of two words matches, so the automaton need not see the rest. Runs of
        two words are left out unless they are a whole phrase: no chain takes so short a match.
        """
        n = len(h)
        if n < 2:
            return
        ids = np.full(n, -1, np.int64)
        near = np.flatnonzero(self.maybe[(mix(h) >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocab, h[near]), len(self.vocab) - 1)
        hit = self.vocab[at] == h[near]
        ids[near[hit]] = at[hit]
        joined = np.zeros(n + 1, bool)  # joined[i]: words i - 1 and i
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        joined[both[self.pairs[ids[both], ids[both + 1]]] + 1] = True
        joined[bounds] = False
        first = np.flatnonzero(joined[1:] & ~joined[:-1])
        last = np.flatnonzero(joined[:-1] & ~joined[1:])
        keep = (last - first >= 2) | self.whole[ids[first], ids[first + 1]]
        for a, b in zip(first[keep].tolist(), last[keep].tolist()):
            yield a, ids[a : b + 1].tolist()

    def scan(self, buf: np.ndarray, off: np.ndarray):
        """For each text: (words, base places [(start, label)], spans [(label, first, last, share)])."""
        for n, base, spans in self.found(buf, off):
            yield n, base, sorted({s[:4] for s in spans})

    def found(self, buf: np.ndarray, off: np.ndarray):
        """As scan, with the words that a span covers as its fifth part."""
        _, _, h, bounds = words(LOWER[buf], off, ALNUM)
        texts = [(int(b - a), [], {}) for a, b in zip(bounds[:-1], bounds[1:])]
        for first, ids in self.runs(h, bounds):
            doc = int(np.searchsorted(bounds, first, "right")) - 1
            begin = first - int(bounds[doc])
            _, base, matches = texts[doc]
            stats = [*self.sa.statistics(ids), (0, 0)]
            for i, (s, n) in enumerate(stats[:-1]):
                for k in self.marks[s]:
                    if self.sizes[k] <= n:
                        base.append((begin + i - self.sizes[k] + 1, self.base[k][1]))
                if n >= MIN_MATCH and stats[i + 1][1] != n + 1:  # it doesn't go on to the right
                    for t, end in self.sa.ends[s]:
                        matches.setdefault(t, []).append((begin + i - n + 1, end - n + 1, n))
        for n, base, matches in texts:
            spans = []
            for t, found in matches.items():
                for a, b, covered in chain(found):
                    if t >= len(self.base) and covered >= MIN_COVER * self.sizes[t]:
                        spans.append((self.labels[t], a, b, min(1.0, covered / self.sizes[t]), covered))
            yield n, sorted(set(base)), sorted(set(spans))


@cache
def _index(base, templates) -> LicenseIndex:
    return LicenseIndex(base, templates)


SPANS = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))


def scan_licenses(docs: DataFrame, base=BASE, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices in every whole text.

    Words are runs of digits, letters and non-ASCII characters of the text with A-Z lower-cased.
    base: phrases counted at every place where their words stand one after the other. templates:
    spans whose chained matches cover MIN_COVER of a template, of which `counted` keeps those that name
    their licence. score: the largest covered share of a span, 1 for a base phrase, 0 without any. Null and empty texts have no words, no labels and score 0.
    Repeated rows are scanned each.
    """

    def run(batches):
        index = _index(base, templates)
        for batch in batches:
            rows = []
            for _, buf, off in slices(batch.column(1)):
                for n, places, spans in index.found(buf, off):
                    spans = sorted({s[:4] for s in counted(spans)})
                    labels = {x for _, x in places}
                    score = 1.0 if places else max((s[3] for s in spans), default=0.0)
                    rows.append((n, len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted(labels)), ",".join(sorted(labels | {s[0] for s in spans})), score, [dict(zip(("label", "first", "last", "share"), s)) for s in spans]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), SPANS)
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    out = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(run, f"{id_col} long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,share:double>>")
