"""Licence scans by a positional rare-token index.

The index holds licence *templates*: characteristic notices and bodies of licences.
Every template word has an inverse document frequency over the templates and postings of
(template, position); no word is left out.

1. A template is possible in a file if enough of its positions hold words that the file
   has at all (fewer can't reach ``COVERAGE``).
2. The file's licence words are ranked by IDF and looked up from the highest on, until
   every possible template has ``RARE`` words looked up, or all that the file has.
3. Each occurrence at file position p of a template word at position t votes for the
   alignment p - t.  Where enough of a template's looked-up words agree (the postings'
   intersection by relative position, with a slack for inserted or missing words, wider
   for long templates), the template's words are matched around the best alignment of
   the neighbourhood, and its mandatory key phrases must all stand there.

Base labels are fixed phrases; they are found by place and never lost.

``score`` is the best coverage of a verified template, 1.0 if a base phrase stands
in the text, else 0.

Words are maximal runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII
characters.  Defined results: null and empty texts have no words, no label and
score 0, their places null; repeated rows give a row each; a null doc_id stays null;
an empty table gives no rows; a very long text is scanned whole; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label, notice, mandatory key phrases.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights cc0 public domain dedication", ("public domain",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("boost-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    (
        "bsd-2-clause",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        ("source code must retain", "binary form must reproduce"),
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission",
        ("endorse or promote products", "prior written permission"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies the software is provided as is and the author "
        "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no "
        "event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting "
        "from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
        "connection with the use or performance of this software",
        ("with or without fee", "author disclaims all warranties"),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
        "damages arising from the use of this software permission is granted to anyone to use this software for any purpose including "
        "commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this "
        "software must not be misrepresented you must not claim that you wrote the original software if you use this software in a "
        "product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must "
        "be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or "
        "altered from any source distribution",
        ("must not be misrepresented", "altered source versions"),
    ),
    (
        "unlicense",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled "
        "binary for any purpose commercial or non commercial and by any means",
        ("compiled binary", "by any means"),
    ),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential", ("unauthorized copying",)),
)

#: Words looked up for each possible template, of the highest IDF, at least.
RARE = 3
#: Words by which an alignment may be off: so many, or a share of the template's words if that is more.
SLACK, SLACK_SHARE = 2, 0.05
#: Share of a template's words that must stand in order.
COVERAGE = 0.8


@dataclass
class Index:
    """Words by id; their IDF and postings; templates as (label, ids, key phrases as ids)."""

    words: list[bytes]
    idf: np.ndarray
    templates: list[tuple[str, np.ndarray, list[list[int]]]]
    postings: list[list[tuple[int, int]]]
    phrases: list[tuple[str, list[int]]]

    @classmethod
    def build(cls, templates=TEMPLATES, phrases=PHRASES) -> Index:
        ids: dict[str, int] = {}
        number = lambda text: [ids.setdefault(w, len(ids)) for w in text.split()]
        parsed = [(label, np.array(number(notice)), [number(k) for k in keys]) for label, notice, keys in templates]
        based = [(label, number(phrase)) for phrase, label in phrases]
        postings: list[list[tuple[int, int]]] = [[] for _ in ids]
        for t, (_, words, _) in enumerate(parsed):
            for i, w in enumerate(words.tolist()):
                postings[w].append((t, i))
        df = np.array([max(1, len({t for t, _ in p})) for p in postings])
        return cls([w.encode() for w in ids], np.log(len(parsed) / df), parsed, postings, based)


def _runs(words: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Where the ids of ``phrase`` stand consecutively."""
    n = len(words) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    found = words[:n] == phrase[0]
    for k, w in enumerate(phrase[1:], 1):
        found &= words[k : n + k] == w
    return np.flatnonzero(found)


def verify(window: list[int], words: list[int], keys: list[list[int]]) -> float:
    """Share of the template's words that stand in order in a file's window; 0 without a key phrase."""
    for key in keys:
        if not any(window[i : i + len(key)] == key for i in range(len(window) - len(key) + 1)):
            return 0.0
    # longest common subsequence; both sides are about as short as the template
    row = [0] * (len(window) + 1)
    for w in words:
        before = 0
        for j, x in enumerate(window):
            before, row[j + 1] = row[j + 1], (before + 1 if w == x else max(row[j + 1], row[j]))
    return row[-1] / len(words)


class Scanner:
    def __init__(self, index: Index):
        self.index = index
        raw = b" ".join(index.words)
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _ = common.word_bounds(data != 32, np.array([0, len(data)]))
        hashes = common.word_hashes(data, starts, ends)
        self.sizes = ends - starts
        self.letters = np.zeros((len(starts), int(self.sizes.max())), np.uint8)
        for i, w in enumerate(index.words):
            self.letters[i, : len(w)] = np.frombuffer(w, np.uint8)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.low = np.zeros(1 << 16, dtype=bool)
        self.low[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        #: Positions of each template (rows) that hold each word.
        self.weights = np.stack([np.bincount(words, minlength=len(index.words)) / len(words) for _, words, _ in index.templates]).astype(np.float32)

    def word_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The index's id of every word, or -1: found by hash, compared as text."""
        hashes = common.word_hashes(data, starts, ends)
        out = np.full(len(hashes), -1, np.int32)
        some = np.flatnonzero(self.low[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.hashes, hashes[some])
        at[at == len(self.hashes)] = 0
        held = self.hashes[at] == hashes[some]
        some, at = some[held], at[held]
        ids = self.order[at]
        size = self.sizes
        same = size[ids] == ends[some] - starts[some]
        some, ids = some[same], ids[same]
        for j in range(int(size.max())):
            longer = np.flatnonzero(size[ids] > j)
            same = np.ones(len(ids), dtype=bool)
            same[longer] = data[starts[some[longer]] + j] == self.letters[ids[longer], j]
            some, ids = some[same], ids[same]
        out[some] = ids
        return out

    def labels(self, words: np.ndarray, possible: list[int]) -> tuple[set[str], float]:
        """(labels, best coverage) of a file's words, by the possible templates."""
        index = self.index
        held = np.flatnonzero(words >= 0)
        ids = words[held]
        ranked = np.unique(ids)
        ranked = ranked[np.argsort(-index.idf[ranked], kind="stable")].tolist()
        missing = {t: RARE for t in possible}
        votes: dict[int, dict[int, set[int]]] = {t: {} for t in possible}
        for w in ranked:
            mine = {t for t, _ in index.postings[w]} & votes.keys()
            if not any(missing[t] > 0 for t in mine):
                continue
            places = held[ids == w].tolist()
            for t, i in index.postings[w]:
                if t in votes:
                    for p in places:
                        votes[t].setdefault(p - i, set()).add(i)
            for t in mine:
                missing[t] -= 1
            if max(missing.values()) <= 0:
                break
        labels: set[str] = set()
        best = 0.0
        for t, by_align in votes.items():
            label, template, keys = index.templates[t]
            slack = max(SLACK, int(SLACK_SHARE * len(template)))
            needed = min(2, len(set(template.tolist())))
            aligns = np.array(sorted(by_align))
            support = [len(set().union(*(by_align[a] for a in aligns[np.searchsorted(aligns, x - slack) : np.searchsorted(aligns, x + slack, side="right")].tolist()))) for x in aligns.tolist()]
            tried: list[int] = []
            for k in np.argsort(-np.array(support), kind="stable").tolist():
                align = int(aligns[k])
                if support[k] < needed or any(abs(align - x) <= slack for x in tried):
                    continue
                tried.append(align)
                window = words[max(0, align - slack) : align + len(template) + slack].tolist()
                if (share := verify(window, template.tolist(), keys)) >= COVERAGE:
                    labels.add(label)
                    best = max(best, share)
        return labels, best

    def scan(self, data: np.ndarray, cuts: np.ndarray) -> list[tuple[int, list[int], set[str], set[str], float]]:
        """(words, starts of base places, base labels, all labels, score) of every text; ``data`` is lower-cased in A-Z."""
        index = self.index
        starts, ends, first = common.word_bounds(common.IS_ALNUM[data], cuts)
        words = self.word_ids(data, starts, ends)
        rows = len(cuts) - 1
        row = np.repeat(np.arange(rows), np.diff(first))
        places: list[list[int]] = [[] for _ in range(rows)]
        base: list[set[str]] = [set() for _ in range(rows)]
        for label, phrase in index.phrases:
            for i in _runs(words, phrase).tolist():
                r = row[i]
                if i + len(phrase) <= first[r + 1]:
                    places[r].append(i - int(first[r]))
                    base[r].add(label)
        # a word that a file has, by file
        held = np.flatnonzero(words >= 0)
        pairs = np.unique(row[held] * len(index.words) + words[held])
        has = np.zeros((rows, len(index.words)), np.float32)
        has[pairs // len(index.words), pairs % len(index.words)] = 1
        possible: dict[int, list[int]] = {}
        for r, t in zip(*np.nonzero(has @ self.weights.T >= COVERAGE - 1e-6)):
            possible.setdefault(int(r), []).append(int(t))
        out = []
        for r in range(rows):
            labels, score = (set(), 0.0) if r not in possible else self.labels(words[first[r] : first[r + 1]], possible[r])
            out.append((int(first[r + 1] - first[r]), places[r], base[r], base[r] | labels, 1.0 if base[r] else score))
        return out


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row; no shuffle.

    The index is as large as the templates, which don't grow with the corpus.
    """
    index = Index.build(templates, phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(index)
        for batch in batches:
            data, offsets = common.string_buffers(batch.column(1))
            for a, b in common.slices(offsets, 4 << 20):
                found = scanner.scan(common.lower_ascii(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([len(f[1]) for f in found], pa.int64()),
                        pa.array([min(f[1], default=None) for f in found], pa.int64()),
                        pa.array([max(f[1], default=None) for f in found], pa.int64()),
                        pa.array([",".join(sorted(f[2])) for f in found], pa.string()),
                        pa.array([",".join(sorted(f[3])) for f in found], pa.string()),
                        pa.array([f[4] for f in found], pa.float64()),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text")).mapInArrow(run, schema)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(common.read_table(spark, sf_dir, "documents"))
