"""License scan: a generalised suffix automaton of license texts, read along every document.

The automaton knows every run of words of the templates.  Reading a document gives, at each word,
the longest run of template words that ends there (matching statistics).  Base phrases are read
from the automaton's suffix links.  Maximal runs of ``LEAST`` words or more, or of all words of a
shorter template, are chained, in template order and with gaps of at most ``GAP`` words, into covered
spans (``find_spans``): a chain that covers half of its template, or ``ENOUGH`` words, is one; spans
of a template do not overlap, the better ones come first.  A run counts for the templates that hold
all of it, at each place where they do.  Where spans of different labels share over half the words
of the smaller one, only the one that covers more (then: the larger share) gives a label, so that a
family's notices, which share most of their words, are told apart.  score is the largest covered
share of any template or phrase.  The templates are fixed and small; the work is one pass over each
document's words.

Defined cases: null text is empty: no words, no labels, score 0; rows repeated score alike; an
empty table gives no rows.  Texts are cut nowhere; batches are read in bounded slices.
"""

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewindow.llm.tokens import Vocabulary, Words, slices

LEAST = 4
GAP = 8
ENOUGH = 20
# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices of public licenses.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights "
    "to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
    "the license you may obtain a copy of the license at",
    "apache-line": "licensed under the apache license version 2 0",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
    "license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-line": "this work is licensed under the gnu general public license version 3",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met",
    "bsd-conditions": "redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions "
    "and the following disclaimer in the documentation and or other materials provided with the distribution",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
    "public license as published by the free software foundation either version 2 1 of the license or at your option any "
    "later version",
    "agpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general "
    "public license as published by the free software foundation either version 3 of the license or at your option any "
    "later version",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
    "distributed with this file you can obtain one at",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify "
    "publish use compile sell or distribute this software either in source code form or as a compiled binary for any "
    "purpose commercial or non commercial and by any means",
    "zlib": "permission is granted to anyone to use this software for any purpose including commercial applications and to "
    "alter it and redistribute it freely subject to the following restrictions",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "reserved": "all rights reserved",
}
LABELS = {"apache-line": "apache", "gpl-line": "gpl", "bsd-conditions": "bsd"}
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)
SPANS = "doc_id long, template string, label string, first_word long, last_word long, covered_words long, share double, labels_text boolean"


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, texts):
        self.next, self.link, self.size, self.ends = [{}], [-1], [0], [{}]
        for number, words in enumerate(texts):
            last = 0
            for place, word in enumerate(words):
                last = self._add(last, word)
                self.ends[last].setdefault(number, set()).add(place)
        # A state's texts and places reach its suffixes: longer states first.
        for s in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            if self.link[s] > 0:
                for number, places in self.ends[s].items():
                    self.ends[self.link[s]].setdefault(number, set()).update(places)

    def _state(self, size, edges, link):
        self.next.append(edges), self.link.append(link), self.size.append(size), self.ends.append({})
        return len(self.size) - 1

    def _add(self, last, word):
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
        new = self._state(self.size[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p, word, q):
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.ends[copy] = {number: set(places) for number, places in self.ends[q].items()}
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def step(self, state, length, word):
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.size[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0

    def state_of(self, words):
        state = 0
        for word in words:
            state = self.next[state][word]
        return state


class Scanner:
    def __init__(self, base=None, templates=None):
        base, templates = base or BASE, templates or TEMPLATES
        split = lambda text: [w.encode() for w in text.split()]
        texts = {**{f"phrase {p}": split(p) for p in base}, **{n: split(t) for n, t in templates.items()}}
        self.vocabulary = Vocabulary(w for words in texts.values() for w in words)
        number = {w: i for i, w in enumerate(self.vocabulary.words)}
        self.texts = [[number[w] for w in words] for words in texts.values()]
        self.labels = [None] * len(base) + [LABELS.get(n, n) for n in templates]
        self.least = [min(LEAST, len(words)) for words in self.texts]
        self.shortest = min(n for n, label in zip(self.least, self.labels) if label is not None)
        self.automaton = Automaton(self.texts)
        # The phrases that end wherever a state's longest word run ends, by suffix links.
        own = {}
        for k, (phrase, label) in enumerate(base.items()):
            own.setdefault(self.automaton.state_of(self.texts[k]), []).append((len(self.texts[k]), label))
        self.phrases = []
        for state in range(len(self.automaton.size)):
            found, s = [], state
            while s > 0:
                found += own.get(s, [])
                s = self.automaton.link[s]
            self.phrases.append(found)

    def read(self, words, at: int, base, matches):
        """Read a run of known words that starts at word ``at``; both lists get what is found."""
        automaton, state, length = self.automaton, 0, 0
        for i, word in enumerate(words):
            before, held = state, length
            state, length = automaton.step(state, length, word)
            if held >= self.shortest and length <= held:
                self._match(before, held, at + i - 1, matches)
            for size, label in self.phrases[state]:
                if length >= size:
                    base.append((at + i - size + 1, label))
        if length >= self.shortest:
            self._match(state, length, at + len(words) - 1, matches)

    def _match(self, state, length, end, matches):
        for number, places in self.automaton.ends[state].items():
            if self.labels[number] is not None and length >= self.least[number]:
                found = matches.setdefault(number, [])
                found.extend((end - length + 1, place - length + 1, length) for place in places)

    def chains(self, number, matches):
        """(most words covered by any chain, spans) of a template; matches come in document order.

        A span is (first word, last word, covered words).  Chains are taken from the best end down;
        one that runs into words already taken ends there.
        """
        best, before, reach = [], [], GAP + len(self.texts[number])
        for i, (start, place, length) in enumerate(matches):
            gain, last = length, -1
            for j in range(i - 1, -1, -1):
                s, p, n = matches[j]
                if s + reach < start:
                    break  # matches are no longer than the template: none before can be near
                if s + n <= start <= s + n + GAP and p + n <= place <= p + n + GAP and best[j] + length > gain:
                    gain, last = best[j] + length, j
            best.append(gain), before.append(last)
        taken, spans = [False] * len(matches), []
        for i in sorted(range(len(matches)), key=lambda i: (-best[i], i)):
            at, words, first = i, 0, None
            while at >= 0 and not taken[at]:
                words, first = words + matches[at][2], at
                at = before[at] if not any(taken[before[at] + 1 : at]) else -1
            if words and self._enough(number, words):
                low, high = matches[first][0], matches[i][0] + matches[i][2] - 1
                spans.append((low, high, words))
                # Matches that touch the span: starts are in order, and none is longer than the template.
                j = bisect_left(matches, (low - len(self.texts[number]),))
                while j < len(matches) and matches[j][0] <= high:
                    taken[j] = taken[j] or matches[j][0] + matches[j][2] > low
                    j += 1
        return max(best, default=0), spans

    def _enough(self, number, words) -> bool:
        return 2 * words >= len(self.texts[number]) or words >= ENOUGH

    def spans(self, matches):
        """(largest share, spans) of a document: (number, first, last, covered, gives its label)."""
        score, found = 0.0, []
        for number, runs in matches.items():
            words, spans = self.chains(number, sorted(runs))
            score = max(score, words / len(self.texts[number]))
            found += [(number, *span) for span in spans]
        share = lambda x: x[3] / len(self.texts[x[0]])
        kept, out = Intervals(), []
        for span in sorted(found, key=lambda x: (-x[3], -share(x), x[1], x[0])):
            number, low, high, words = span
            clear = kept.add(low, high, self.labels[number])
            out.append((number, low, high, words, clear))
        return score, out

    def result(self, base, matches):
        base_labels = {label for _, label in base}
        share, spans = self.spans(matches)
        labels = base_labels | {self.labels[number] for number, *_, clear in spans if clear}
        return base_labels, labels, min(max(share, 1.0 if base else 0.0), 1.0)

    def scan(self, column):
        """Rows (n_words, n_base, first, last, base labels, labels, score) of a column of texts."""
        count, found = self.matches(column)
        out = []
        for text, n in enumerate(count.tolist()):
            base, matches = found.get(text, ((), {}))
            base_labels, labels, score = self.result(base, matches)
            places = [p for p, _ in base]
            joined_names = [",".join(sorted(x)) for x in (base_labels, labels)]
            out.append((n, len(base), min(places, default=None), max(places, default=None), *joined_names, score))
        return out

    def matches(self, column):
        """Words per text, and per text with any: base places and the runs of each template."""
        words = Words(column)
        known = self.vocabulary.find(words)
        count = np.diff(words.first)
        # Runs of two or more known words within a text; a single word is no phrase and no long match.
        joined = (known[1:] >= 0) & (known[:-1] >= 0) & (words.text[1:] == words.text[:-1]) if len(known) else np.zeros(0, bool)
        edge = np.diff(joined.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        found: dict = {}
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            text = int(words.text[a])
            base, matches = found.setdefault(text, ([], {}))
            self.read(known[a : b + 1].tolist(), a - int(words.first[text]), base, matches)
        return count, found


class Intervals:
    """Spans that give a label, kept in cells of ``WIDTH`` words so that a look-up is local."""

    WIDTH = 256

    def __init__(self):
        self.cells = {}

    def add(self, low, high, label) -> bool:
        """Keep the span unless one of another label shares over half the words of the smaller."""
        cells = range(low // self.WIDTH, high // self.WIDTH + 1)
        for a, b, other in {x for c in cells for x in self.cells.get(c, ())}:
            common = min(high, b) - max(low, a) + 1
            if other != label and 2 * common > min(high - low, b - a) + 1:
                return False
        for c in cells:
            self.cells.setdefault(c, []).append((low, high, label))
        return True


def _scan(batches):
    scanner = Scanner()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    for batch in batches:
        for part in slices(batch):
            rows = scanner.scan(part.column("text"))
            columns = [part.column("doc_id")] + [pa.array([r[i] for r in rows], kinds[i + 1]) for i in range(7)]
            yield pa.RecordBatch.from_arrays(columns, names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document; nothing is shuffled."""
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


def _find(batches):
    scanner = Scanner()
    names = list(TEMPLATES)
    for batch in batches:
        for part in slices(batch):
            ids, rows = part.column("doc_id").to_pylist(), []
            for text, (_, matches) in scanner.matches(part.column("text"))[1].items():
                for number, low, high, words, clear in sorted(scanner.spans(matches)[1], key=lambda x: x[1:]):
                    share = words / len(scanner.texts[number])
                    rows.append((ids[text], names[number - len(BASE)], scanner.labels[number], low, high, words, share, clear))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 3, pa.float64(), pa.bool_()]
            fields = [x.split()[0] for x in SPANS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], fields)


def find_spans(docs: DataFrame) -> DataFrame:
    """One row per covered template span: where it lies (words from 0), how many of its words the
    template covers, and whether it gives the document a label."""
    return docs.select("doc_id", "text").mapInArrow(_find, SPANS)
