"""Licence scans by a generalised suffix automaton over the words of licence templates.

The automaton accepts every run of words that occurs in a template or a phrase. A text is streamed through
it word by word: the state reached holds the longest run that ends there and occurs in a template (the
matching statistics). Where the next word does not continue a run at one of its places in the templates,
and the run is long enough, it is final there; runs that follow one another in a text and in a template are
chained into spans, and the share of a template's words that a chain covers is its score. A phrase stands wherever its own state is the
state reached or one of its suffixes, so the base phrases come out of the same pass.

Memory is bounded by the templates and by the gap that a chain may have, not by the length of a text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_RUN = 4  # words of a run that may belong to a span
MOST_GAP = 30  # words of a text between runs of one span
LEAST_SHARE = 0.6  # of a template's words, for its label
WINDOW = 1 << 20  # bytes that are split into words at once

# Phrases and labels of the contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices as they are published, word by word, with the labels of the method.
TEMPLATES = {
    "apache-2.0-line": ("apache-2.0", "licensed under the apache license version 2.0"),
    "apache-2.0": ("apache-2.0", """licensed under the apache license version 2.0 the license you may not use this file except in compliance
        with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0 unless required by applicable law
        or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of
        any kind either express or implied see the license for the specific language governing permissions and limitations under the license"""),
    "mit-line": ("mit", "released under the mit license"),
    "mit-line-2": ("mit", "licensed under the mit license"),
    "mit": ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files the software to deal in the software without restriction including without limitation the rights to use copy modify merge
        publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
        subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not
        limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or
        copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from
        out of or in connection with the software or the use or other dealings in the software"""),
    "gpl-3.0-line": ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    "gpl-2.0-line": ("gpl-2.0", "this work is licensed under the gnu general public license version 2"),
    "gpl": ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
        as published by the free software foundation either version 3 of the license or at your option any later version this program is
        distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or
        fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu
        general public license along with this program if not see http www.gnu.org licenses"""),
    "lgpl": ("lgpl", """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public
        license as published by the free software foundation either version 2.1 of the license or at your option any later version"""),
    "mpl-2.0": ("mpl-2.0", """this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not
        distributed with this file you can obtain one at http mozilla.org mpl 2.0"""),
    "bsd": ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following
        disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
        disclaimer in the documentation and or other materials provided with the distribution"""),
    "isc": ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
        that the above copyright notice and this permission notice appear in all copies"""),
    "unlicense": ("unlicense", "this is free and unencumbered software released into the public domain"),
    "cc-by-nc-4.0": ("cc-by-nc-4.0", "licensed under cc by nc 4.0"),
    "cc-by-sa-4.0": ("cc-by-sa-4.0", "licensed under cc by sa 4.0"),
    "cc-by-4.0": ("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "cc0": ("cc0", "released into the public domain under cc0 1.0 universal"),
}

# Everything that no word has becomes a blank; A-Z are lowered. Bytes of other characters are all above 0x7F.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a text in UTF-8."""
    return text.translate(_TABLE).split()


@dataclass
class Automaton:
    """Suffix automaton of several word sequences, with the places of each state's runs.

    ``ends[s]``: (sequence, position after the last word) of all places of the runs of state s.
    ``phrases[s]``: (phrase, words) of the phrases that end wherever state s is a suffix.
    """

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    follow: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])
    phrases: list[tuple[tuple[int, int], ...]] = field(default_factory=list)
    templates: list[tuple[str, str, int]] = field(default_factory=list)
    names: list[tuple[str, str]] = field(default_factory=list)
    _ending: dict = field(default_factory=dict)

    def _state(self, follow: dict[int, int], link: int, length: int) -> int:
        self.follow.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, last: int, c: int, q: int) -> int:
        """The state of the runs of ``q`` that are no longer than those of ``last`` and one word."""
        clone = self._state(dict(self.follow[q]), self.link[q], self.length[last] + 1)
        self.link[q] = clone
        while last != -1 and self.follow[last].get(c) == q:
            self.follow[last][c] = clone
            last = self.link[last]
        return clone

    def _append(self, last: int, c: int) -> int:
        q = self.follow[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        now, p = self._state({}, 0, self.length[last] + 1), last
        while p != -1 and c not in self.follow[p]:
            self.follow[p][c] = now
            p = self.link[p]
        if p != -1:
            q = self.follow[p][c]
            self.link[now] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return now

    def add(self, text: str) -> tuple[list[int], int]:
        """Insert a sequence; its word numbers and how many there are."""
        ids, last = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text.encode())], 0
        for c in ids:
            last = self._append(last, c)
        return ids, len(ids)

    def ending(self, state: int, c: int | None, least_run: int) -> list[tuple[int, int, int]]:
        """(template, end in it, most words) of the runs of a state and its suffixes that word ``c`` does not continue."""
        found = self._ending.get((state, c, least_run))
        if found is None:
            found, seen, s = [], set(), state
            while s > 0 and (s == state or self.length[s] >= least_run):
                onward = self.follow[s].get(c)
                goes_on = set(self.ends[onward]) if onward is not None else ()
                found += [(t, at, self.length[s]) for t, at in self.ends[s] if (t, at) not in seen and (t, at + 1) not in goes_on]
                seen.update(self.ends[s])
                s = self.link[s]
            self._ending[state, c, least_run] = found
        return found

    def walk(self, ids: list[int]):
        """The states of the prefixes of an inserted sequence."""
        s = 0
        for c in ids:
            s = self.follow[s][c]
            yield s


def build(templates: dict[str, tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> Automaton:
    """The automaton of templates (name to label and text) and phrases (text to label): some thousand states."""
    made = Automaton()
    sequences = [made.add(text)[0] for _, text in templates.values()]
    lookups = [made.add(text)[0] for text in phrases]
    made.templates = [(name, label, len(ids)) for (name, (label, _)), ids in zip(templates.items(), sequences, strict=True)]
    made.names = list(phrases.items())
    for t, ids in enumerate(sequences):
        for at, s in enumerate(made.walk(ids), 1):
            made.ends[s].append((t, at))
    by_length = sorted(range(1, len(made.length)), key=made.length.__getitem__, reverse=True)
    for s in by_length:  # a run ends wherever a longer one ends that it is a suffix of
        made.ends[made.link[s]] += made.ends[s]
    own: dict[int, list[tuple[int, int]]] = {}
    for p, ids in enumerate(lookups):
        *_, s = made.walk(ids)
        own.setdefault(s, []).append((p, len(ids)))
    made.phrases = [()] * len(made.length)
    for s in reversed(by_length):
        made.phrases[s] = tuple(own.get(s, ())) + made.phrases[made.link[s]]
    return made


class Chains:
    """Runs chained into spans while a text streams by.

    A run continues the chain of its template that covers most so far, ends before it in the text and in the
    template (overlapping words count once) and lies at most ``most_gap`` words back. A chain that covers
    ``least_share`` of its template is a span; of spans that overlap the one with the greater share stays, then
    the one that covers more, then the earlier one.
    """

    def __init__(self, automaton: Automaton, least_share: float, most_gap: int):
        self.automaton, self.least_share, self.most_gap = automaton, least_share, most_gap
        self.open: list[tuple[int, int, int, int, int]] = []  # template, first word, end in text, end in template, covered
        self.spans: list[tuple[int, int, int, float, int]] = []  # first word, end, covered, share, template
        self.best = 0.0

    def ended(self, end: int, length: int, runs: list[tuple[int, int, int]]) -> None:
        """The runs (template, end in it, most words) that end before word ``end`` of the text, of ``length`` words at most."""
        # Later runs begin no earlier, so chains that end too far before the first of these are finished.
        self.open = [c for c in self.open if c[2] + self.most_gap >= end - length]
        added = []
        for template, place, most in runs:
            size = min(length, most)
            begin, first, best = end - size, place - size, (template, end - size, end, place, size)
            for c in self.open:
                over = max(0, c[2] - begin, c[3] - first)
                if c[0] == template and over < size and c[2] + self.most_gap >= begin + over and c[4] + size - over > best[4]:
                    best = (template, c[1], end, place, c[4] + size - over)
            added.append(best)
            share = best[4] / self.automaton.templates[template][2]
            self.best = max(self.best, share)
            if share >= self.least_share:
                self._keep((best[1], end, best[4], share, template))
        self.open += added

    def _keep(self, span: tuple) -> None:
        rank = lambda x: (x[3], x[2])
        k = len(self.spans)
        while k and self.spans[k - 1][1] > span[0]:
            k -= 1
        if all(rank(x) < rank(span) for x in self.spans[k:]):
            self.spans[k:] = [span]


def scan_text(automaton: Automaton, text: bytes, least_run: int = LEAST_RUN, least_share: float = LEAST_SHARE, most_gap: int = MOST_GAP):
    """(words, places, spans, score) of a text in UTF-8.

    places: (first word, phrase) of every phrase; spans: (first word, end, covered words, share, template), words
    from 0; score: the greatest share of a template that a chain covers.
    """
    follow, link, lengths, phrases, known = automaton.follow, automaton.link, automaton.length, automaton.phrases, automaton.vocabulary.get
    chains, places = Chains(automaton, least_share, most_gap), []
    state = length = at = lo = 0
    while lo < len(text):
        hi = lo + WINDOW
        part = text[lo:hi].translate(_TABLE)
        while hi < len(text) and (cut := part.rfind(b" ")) < 0:  # a word longer than the window
            hi += WINDOW
            part = text[lo:hi].translate(_TABLE)
        if hi < len(text):
            hi, part = lo + cut + 1, part[:cut]
        for c in map(known, part.split()):
            if length >= least_run and (runs := automaton.ending(state, c, least_run)):
                chains.ended(at, length, runs)
            at += 1
            if c is None:
                state = length = 0
                continue
            while state and c not in follow[state]:
                state = link[state]
                length = lengths[state]
            if c not in follow[state]:
                continue
            state, length = follow[state][c], length + 1
            for p, size in phrases[state]:
                if length >= size:
                    places.append((at - size, p))
        lo = hi
    if length >= least_run:
        chains.ended(at, length, automaton.ending(state, None, least_run))
    return at, places, chains.spans, min(1.0, chains.best)


_FOUND = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label string, template string, first_word long, end_word long, covered long, share double>>"
)


def scan_licences(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Licences in the texts of ``docs`` (doc_id, text): one row a row, in one pass without a shuffle.

    doc_id, n_words, n_base (places of phrases), first_word and last_word (their least and greatest start, null
    without any), base_labels, labels (with those of spans), score (greatest covered share of a template, 0 to 1)
    and ``spans``. A null or empty text has no words and no labels; very long texts are streamed; repeated rows
    are answered each; equal shares of templates go to the first one; an empty table gives an empty table.
    Columns besides doc_id and text are not read, whatever their names.
    """
    automaton = build(templates, phrases)
    kept = docs.select("doc_id", "text")
    kind = kept.schema["doc_id"].dataType

    def run(batches):
        span_type = pa.list_(pa.struct([("label", pa.string()), ("template", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                n, places, spans, score = scan_text(automaton, text or b"")
                base, starts = {automaton.names[p][1] for _, p in places}, [s for s, _ in places]
                found = [
                    {"label": (t := automaton.templates[s[4]])[1], "template": t[0], "first_word": s[0], "end_word": s[1], "covered": s[2], "share": s[3]}
                    for s in spans
                ]
                labels = ",".join(sorted(base | {s["label"] for s in found}))
                rows.append((n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), labels, score, found))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span_type]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return kept.mapInArrow(run, f"doc_id {kind.simpleString()}, {_FOUND}")
