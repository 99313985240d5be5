"""Operator 9, license scan by patience alignment.

A template aligns with a stretch of a text like this: common words at both ends are paired; of the
rest, words that occur once in the text and once in the template are anchors; the longest
increasing subsequence of the anchors is kept; each gap between neighbours is aligned in the same
way. The share of the template's words that are paired is its coverage.

A stretch is a window of the text, of SHORT_WINDOW or LONG_WINDOW template lengths, that begins at a
word of the template. How many words window and template share, each as often as both have it, bounds
the pairs from above; that count is taken for all windows at once, and those below the threshold are
not aligned. Of the others the one with the most pairs is reported; what lies before and after its
stretch is searched in the same way, so every notice of a text is found on its own.

Wording of whole paragraphs may differ up to the threshold, but phrases that tell a license from
its relatives (name, version, clauses) must be there word for word. Templates of less than WHOLE words
must be there whole, in a row. Of notices that overlap, the one with more paired words is reported, so
a text of three clauses is not one of two clauses as well.

Words are runs without white space, A-Z in lower case, without the marks around them; runs of marks
alone are no words. Null and empty texts have no notice. Each row of the input is scanned by itself;
equal rows give equal results, an empty table or no templates an empty one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, slices, table

COVERAGE = 0.8
#: Lengths of windows, in lengths of the template.
SHORT_WINDOW, LONG_WINDOW = 1.25, 2.0
#: Templates of fewer words must be there whole.
WHOLE = 16


@dataclass(frozen=True)
class Notice:
    """Wording that shows a license, and phrases of it that must be there as they are."""

    license: str
    text: str
    phrases: tuple[str, ...] = ()


_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as
    published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
    distribution."""

#: Granting paragraphs of common public licenses.
NOTICES = (
    Notice("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""", ("free of charge", "sublicense and/or sell")),
    Notice("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""", ("apache license version 2.0",)),
    *(Notice(f"{short}-{version}.{minor}", _GNU.format(name=name, version=f"{version}.{minor}" if minor else version), (f"gnu {name.lower()}", f"version {version}.{minor}" if minor else f"version {version}"))
      for short, name, version, minor in (("GPL", "General Public License", 2, 0), ("GPL", "General Public License", 3, 0), ("LGPL", "Lesser General Public License", 2, 1),
                                          ("LGPL", "Lesser General Public License", 3, 0), ("AGPL", "Affero General Public License", 3, 0))),
    Notice("BSD-2-Clause", _CONDITIONS, ("redistribution and use in source and binary forms",)),
    Notice("BSD-3-Clause", _CONDITIONS + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission.""", ("redistribution and use in source and binary forms", "neither the name", "endorse or promote products")),
    Notice("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""", ("with or without fee",)),
    Notice("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED", ("with or without fee is hereby granted the software",)),
    Notice("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this
        software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions:""", ("alter it and redistribute it freely",)),
    Notice("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software""", ("person or organization", "execute and transmit")),
    Notice("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", ("mozilla public license v 2.0",)),
    Notice("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
        which is available at http://www.eclipse.org/legal/epl-2.0""", ("eclipse public license 2.0",)),
    Notice("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""", ("free and unencumbered software",)),
    Notice("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived all copyright",)),
)

#: Names by which licenses are referred to; a line says that something is under one of them.
NAMES = {
    "MIT": ("the MIT License", "an MIT License", "the MIT licence"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache License 2.0"),
    "ISC": ("the ISC License",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "the Mozilla Public License, v. 2.0"),
    "EPL-2.0": ("the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0"),
    "Unlicense": ("the Unlicense",),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"),
    **{
        f"{short}-{version}": tuple(f"the GNU {kind}General Public License{sep}{number}" for sep in (", version ", " version ", " v") for number in dict.fromkeys((version, version.removesuffix(".0"))))
        for short, kind, versions in (("GPL", "", ("2.0", "3.0")), ("LGPL", "Lesser ", ("2.1", "3.0")), ("AGPL", "Affero ", ("3.0",))) for version in versions
    },
    **{
        f"CC-{code}-{version}": (f"CC {code} {version}", f"CC-{code}-{version}", f"a Creative Commons {name} {version} International License", f"the Creative Commons {name} {version} International License")
        for version in ("4.0",)
        for code, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
                           ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
    },
}
TEMPLATES = {
    **{n.license: n for n in NOTICES},
    **{f"{license} line {k}": Notice(license, f"under {name}") for license, names in NAMES.items() for k, name in enumerate(dict.fromkeys(" ".join(n.lower().replace(",", "").split()) for n in names))},
}

_MARKS = np.isin(np.arange(256), list(b".,;:!?\"'()[]{}<>*#|"))
_EDGES = _MARKS | np.isin(np.arange(256), list(b"/-_=~`%+"))


def bare_words(texts: pa.Array) -> Words:
    """Words without the marks around them; a word of marks alone keeps its last one. As operator 1 reads words."""
    words = Words(texts)
    for _ in range(4):
        long = words.ends - words.starts > 1
        words.ends = words.ends - (long & _MARKS[words.data[words.ends - 1]] if len(words) else 0)
        long = words.ends - words.starts > 1
        words.starts = words.starts + (long & _MARKS[words.data[words.starts]] if len(words) else 0)
    return words


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of a patience alignment, in order."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once = Counter(text[a:b])
        here = {w: i for i, w in enumerate(text[a:b], a) if once[w] == 1}
        there = Counter(template[c:d])
        anchors = [(here[w], j) for j, w in enumerate(template[c:d], c) if there[w] == 1 and w in here]
        chain = _increasing(anchors)
        if not chain:
            continue
        out += chain
        for (x, y), (u, v) in zip([(a - 1, c - 1), *chain], [*chain, (b, d)], strict=True):
            if u > x + 1 and v > y + 1:
                gaps.append((x + 1, u, y + 1, v))
    return sorted(out)


def _increasing(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose places in the text increase; anchors come in the template's order."""
    ends: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (i, _) in enumerate(anchors):
        pile = bisect_left(ends, i)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(ends):
            ends.append(i)
            at.append(k)
        else:
            ends[pile], at[pile] = i, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(anchors[k])
        k = before[k]
    return out[::-1]


class NoticeWords:
    """The words of texts without marks around them; hashes, byte ranges, and the first one of each text."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        self.data, self.spans = words.data, words.spans
        if len(words):  # the first and last byte of each word that is no mark
            place = np.flatnonzero(~_EDGES[words.data])
            a, b = np.searchsorted(place, words.starts), np.searchsorted(place, words.ends) - 1
            solid = a <= b
            starts, ends = place[a[solid]], place[b[solid]] + 1
        else:
            solid, starts, ends = np.zeros(0, bool), words.starts, words.ends
        words.starts, words.ends = starts, ends
        self.starts, self.ends = starts, ends
        self.first = np.concatenate([[0], np.cumsum(solid)])[words.first]
        self.hashes = words.hashes()


def words_of(text: str) -> list[int]:
    return NoticeWords(pa.array([text])).hashes.tolist()


class Template:
    """A notice as word hashes, and what a window must have of it."""

    def __init__(self, name: str, notice: Notice, coverage: float):
        self.name, self.license = name, notice.license
        self.words = words_of(" ".join(notice.text.split()))
        self.phrases = [np.array(words_of(p), np.uint64) for p in notice.phrases]
        self.whole = len(self.words) < WHOLE
        self.needed = len(self.words) if self.whole else int(np.ceil(coverage * len(self.words) - 1e-9))
        n = len(self.words)
        self.widths = [n] if self.whole else [int(SHORT_WINDOW * n), int(LONG_WINDOW * n)]
        self.counts = Counter(self.words)


def shared_words(word: np.ndarray, times: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """For the window of width words that begins at each place: words it shares with a template, each as often as both have it.

    word, at: the template's words in a text, and their places; times: how often the template has each.
    An occurrence counts in the windows that hold it unless they hold as many others before it.
    """
    n = len(word)
    order = np.argsort(word, kind="stable")
    begin = np.searchsorted(word[order], word[order])
    k = np.arange(n) - times[order]
    full = np.full(n, -1)
    full[order] = np.where(k >= begin, order[np.maximum(k, 0)], -1)
    low = np.maximum(np.searchsorted(at, at - width, "right"), full + 1)
    change = np.bincount(low, minlength=n + 1) - np.bincount(np.arange(n) + 1, minlength=n + 1)
    return np.cumsum(change)[:n]


def _runs(text: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Places where the phrase begins."""
    if len(text) < len(phrase):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(text[: len(text) - len(phrase) + 1] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[text[at + k] == phrase[k]]
    return at


def stretch(text: list[int], template: Template) -> tuple[int, int, int] | None:
    """Pairs, first and last word of the alignment with a window, if it shows the notice."""
    pairs = align(text, template.words)
    if len(pairs) < template.needed:
        return None
    first, last = pairs[0][0], pairs[-1][0]
    if template.whole:
        return (len(pairs), first, last) if last - first + 1 == len(pairs) else None
    inside = np.array(text[first : last + 1], np.uint64)
    return (len(pairs), first, last) if all(len(_runs(inside, p)) for p in template.phrases) else None


def stretches(text: np.ndarray, template: Template) -> list[tuple[int, int, int]]:
    """(pairs, first, last word) of every stretch of a text that shows the notice; see the module's text."""
    own = np.unique(np.array(template.words, np.uint64))
    times = np.array([template.counts[int(w)] for w in own])
    slot = np.minimum(np.searchsorted(own, text), len(own) - 1)
    hit = np.flatnonzero(own[slot] == text) if len(text) else np.zeros(0, np.int64)
    word, times = slot[hit], times[slot[hit]]
    runs = [(_runs(text, p), len(p)) for p in template.phrases]
    out, open_ = [], [(0, len(text))]
    while open_:
        low, high = open_.pop()
        a, b = np.searchsorted(hit, low), np.searchsorted(hit, high)
        windows = []
        for width in template.widths:
            count = shared_words(word[a:b], times[a:b], hit[a:b], width)
            some = np.flatnonzero(count >= template.needed)
            for at, n in runs:  # a window that holds each phrase
                begin = hit[a + some]
                at = at[(at >= low) & (at + n <= high)]
                next_ = np.searchsorted(at, begin)
                some = some[(next_ < len(at)) & (np.append(at, len(text) + width)[next_] + n <= np.minimum(begin + width, high))]
            windows += [(-int(count[k]), -int(hit[a + k]), width) for k in some]
        best: tuple[int, int, int] | None = None
        for count, at, width in sorted(windows):
            if best and -count <= best[0]:
                break
            found = stretch(text[-at : min(width - at, high)].tolist(), template)
            if found and (not best or found[0] > best[0]):
                best = (found[0], found[1] - at, found[2] - at)
        if best:
            out.append(best)
            open_ += [(low, best[1]), (best[2] + 1, high)]
    return sorted(out, key=lambda s: s[1])


def find_licenses(docs: DataFrame, keep: list[str] | None = None, text: str = "text", templates: dict[str, Notice] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row for each notice of each document: columns keep of docs, and

    license, template, license_coverage, start, end (code points of the stretch). Input columns of those
    names are replaced.
    """
    added = ["license", "template", "license_coverage", "start", "end"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    wording = dict(TEMPLATES if templates is None else templates)
    schema = T.StructType([T.StructField("row", T.StructType([docs.schema[c] for c in keep])), *[T.StructField(c, t) for c, t in zip(added, (T.StringType(), T.StringType(), T.DoubleType(), T.LongType(), T.LongType()), strict=True)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [t for t in (Template(n, notice, coverage) for n, notice in wording.items()) if t.words]
        if not made:
            return
        vocabulary = np.unique(np.array([w for t in made for w in t.words], np.uint64))
        #: how often each template has a word; words that it cannot do without
        weight, must = np.zeros((len(vocabulary), len(made)), np.float32), np.zeros((len(vocabulary), len(made)), np.float32)
        for k, t in enumerate(made):
            for w, n in t.counts.items():
                weight[np.searchsorted(vocabulary, np.uint64(w)), k] = n
            for w in t.words if t.whole else np.concatenate([*t.phrases, np.zeros(0, np.uint64)]):
                must[np.searchsorted(vocabulary, np.uint64(w)), k] = 1
        needed, musts = np.array([t.needed for t in made]), must.sum(0)
        for batch in batches:
            for part in slices(batch, "text"):
                words = NoticeWords(part.column(1))
                h, first = words.hashes, words.first
                place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[place] == h)
                doc = np.searchsorted(first, hit, "right") - 1
                has = np.zeros((part.num_rows, len(vocabulary)), np.float32)
                has[doc, place[hit]] = 1
                out = []
                for d in np.flatnonzero(has.any(axis=1)):
                    own = h[first[d] : first[d + 1]]
                    found = [(n, a, b, t) for t in map(made.__getitem__, np.flatnonzero((has[d] @ weight >= needed) & (has[d] @ must >= musts))) for n, a, b in stretches(own, t)]
                    kept: list[tuple[int, int, int, Template]] = []
                    for n, a, b, t in sorted(found, key=lambda f: (-f[0], f[1], f[3].name)):
                        if all(b < x or y < a for _, x, y, _ in kept):
                            kept.append((n, a, b, t))
                    for n, a, b, t in sorted(kept, key=lambda f: f[1]):
                        head = words.data[words.spans[d] : words.ends[first[d] + b]].tobytes()
                        out.append((d, t.license, t.name, n / len(t.words), len(head[: words.starts[first[d] + a] - words.spans[d]].decode()), len(head.decode())))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([o[0] for o in out], pa.int64())), *[pa.array([o[i] for o in out], t) for i, t in ((1, pa.string()), (2, pa.string()), (3, pa.float64()), (4, pa.int64()), (5, pa.int64()))]], names=["row", *added])

    found = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, schema)
    return found.select(*[F.col(f"row.`{c}`") for c in keep], *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
