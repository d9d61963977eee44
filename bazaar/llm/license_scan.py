"""Operator 3: license notices in texts by patience alignment.

Templates are short word lists, a parameter. A match of a template covers at
least ``min_coverage`` of its words, so it must hold at least one of any
(1 - min_coverage) of them (and one more): those that the training texts have
least often are its cues. One pass counts the templates' words, a second one
aligns each neighbourhood of a cue with the template: words that are unique
in both are anchors, the longest increasing run of anchors is kept, and the
gaps between them are aligned the same way; a gap without unique words falls
back to the longest common subsequence, which template lengths bound.

Notices differ from each other by a name, a version or one restriction, which
coverage alone does not see: a template names words that a match must hold and
words that it must not. Of matches that overlap, the one with most words stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm._tokens import U64, WORD, Words, slices
from bazaar.llm.decontamination import _frequencies, _in

class Template(NamedTuple):
    """A notice; words that every match holds, and words that none may hold (name, version, restrictions)."""

    text: str
    must: str = ""
    never: str = ""


_GPL_HEADER = """This program is free software: you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation, either version {} of the
        License, or (at your option) any later version."""
_LGPL_HEADER = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        {} General Public License as published by the Free Software Foundation; either version {} of the License, or
        (at your option) any later version."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution."""
_KIN = "lesser library affero"

# Public license notices.
TEMPLATES = {
    "MIT-notice": Template("Released under the MIT License.", "mit"),
    "BSD-notice": Template("Released under the BSD License.", "bsd"),
    "ISC-notice": Template("Released under the ISC License.", "isc"),
    "Apache-2.0-notice": Template("Licensed under the Apache License, Version 2.0.", "apache 2"),
    "MPL-2.0-notice": Template("Licensed under the Mozilla Public License, Version 2.0.", "mozilla 2"),
    "GPL-3.0-notice": Template("This work is licensed under the GNU General Public License, version 3.", "3", _KIN),
    "GPL-2.0-notice": Template("This work is licensed under the GNU General Public License, version 2.", "2", _KIN),
    "LGPL-3.0-notice": Template("This work is licensed under the GNU Lesser General Public License, version 3.",
                                "lesser 3"),
    "LGPL-2.1-notice": Template("This work is licensed under the GNU Lesser General Public License, version 2.1.",
                                "lesser 2 1"),
    "AGPL-3.0-notice": Template("This work is licensed under the GNU Affero General Public License, version 3.",
                                "affero 3"),
    "CC-BY-4.0-notice": Template("Licensed under CC BY 4.0.", "by 4", "nc sa nd"),
    "CC-BY-SA-4.0-notice": Template("Licensed under CC BY-SA 4.0.", "by sa 4", "nc nd"),
    "CC-BY-ND-4.0-notice": Template("Licensed under CC BY-ND 4.0.", "by nd 4", "nc sa"),
    "CC-BY-NC-4.0-notice": Template("Licensed under CC BY-NC 4.0.", "by nc 4", "sa nd"),
    "CC-BY-NC-SA-4.0-notice": Template("Licensed under CC BY-NC-SA 4.0.", "by nc sa 4", "nd"),
    "CC0-1.0-notice": Template("Released under CC0 1.0 Universal.", "cc0"),
    "MIT": Template("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software."""),
    "ISC": Template("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    "Apache-2.0-header": Template("""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
        file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied.""", "apache 2"),
    "MPL-2.0-header": Template("""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a
        copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
                               "mozilla 2"),
    "GPL-3.0-header": Template(_GPL_HEADER.format("3"), "3", _KIN),
    "GPL-2.0-header": Template(_GPL_HEADER.format("2"), "2", _KIN),
    "LGPL-3.0-header": Template(_LGPL_HEADER.format("Lesser", "3"), "lesser 3"),
    "LGPL-2.1-header": Template(_LGPL_HEADER.format("Lesser", "2.1"), "lesser 2 1"),
    "LGPL-2.0-header": Template(_LGPL_HEADER.format("Library", "2"), "library 2"),
    "BSD-2-Clause": Template(_BSD, "", "neither endorse"),
    "BSD-3-Clause": Template(_BSD + """ Neither the name of the copyright holder nor the names of its contributors may be
        used to endorse or promote products derived from this software without specific prior written permission.""",
                             "neither endorse"),
}


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence (patience piles)."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            last.append(i)
        else:
            tops[k], last[k] = v, i
        back.append(last[k - 1] if k else -1)
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _lcs(a: list, b: list, a0: int, b0: int) -> list[tuple[int, int]]:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((a0 + i, b0 + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list, b: list, a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Matched (place in a, place in b), increasing in both."""
    if not a or not b:
        return []
    ca, cb = Counter(a), Counter(b)
    where = {w: j for j, w in enumerate(b) if cb[w] == 1}
    anchors = [(i, where[w]) for i, w in enumerate(a) if ca[w] == 1 and w in where]
    if not anchors:
        return _lcs(a, b, a0, b0) if set(ca) & set(cb) else []
    kept = [anchors[k] for k in increasing([j for _, j in anchors])]
    out, i, j = [], 0, 0
    for x, y in [*kept, (len(a), len(b))]:
        out += patience(a[i:x], b[j:y], a0 + i, b0 + j)
        if x < len(a):
            out.append((a0 + x, b0 + y))
        i, j = x + 1, y + 1
    return out


def align(text: list, lo: int, hi: int, template: list, min_coverage: float) -> tuple[int, int, int] | None:
    """(start, end, words matched) of the template in text[lo:hi], or None. The
    match is trimmed to its densest part: stray words far from the rest do not count."""
    pairs = patience(text[lo:hi], template, lo, 0)
    need = min_coverage * len(template)
    while len(pairs) >= need:
        span = pairs[-1][0] - pairs[0][0] + 1
        if len(pairs) >= min_coverage * span:
            return pairs[0][0], pairs[-1][0] + 1, len(pairs)
        gaps = (pairs[1][0] - pairs[0][0], pairs[-1][0] - pairs[-2][0]) if len(pairs) > 1 else (0, 0)
        pairs = pairs[1:] if gaps[0] >= gaps[1] else pairs[:-1]
    return None


def _scan(templates: list[list[int]], cues: list[dict[int, list[int]]], must: list[set], never: list[set],
          min_coverage: float):
    every = np.unique(np.array([w for c in cues for w in c], np.int64).view(U64))

    def run(batches):
        words = Words(WORD)
        for b in batches:
            for lo, hi, data, offs in slices(b.column("text")):
                h, at = words.hashes(data, offs)
                hit = np.flatnonzero(_in(every, h))
                rows = []
                for d in np.unique(np.searchsorted(at, hit, "right") - 1):
                    text = h[at[d]:at[d + 1]].view(np.int64).tolist()
                    places = (hit[np.searchsorted(hit, at[d]):np.searchsorted(hit, at[d + 1])] - at[d]).tolist()
                    got: list[tuple[int, int, int, int]] = []
                    for t, (template, cue) in enumerate(zip(templates, cues, strict=True)):
                        slack = max(2, len(template) // 4)
                        starts = sorted({p - o for p in places for o in cue.get(text[p], ())})
                        k = 0
                        while k < len(starts):
                            last = k
                            while last + 1 < len(starts) and starts[last + 1] - starts[k] <= slack:
                                last += 1
                            # near places are one try; where that finds nothing, each is tried
                            # alone, last without the words around it, which may repeat the template's
                            alone = [(x, x, r) for r in (slack, 0) for x in range(k, last + 1)]
                            for i, j, around in [(k, last, slack), *alone]:
                                a = max(0, starts[i] - around)
                                z = min(len(text), starts[j] + len(template) + around)
                                if m := align(text, a, z, template, min_coverage):
                                    inside = set(text[m[0]:m[1]])
                                    if must[t] <= inside and not never[t] & inside:
                                        got.append((*m, t))
                                        break
                            k = last + 1
                    rows += [(int(d), t, s, e, n) for s, e, n, t in sorted(_apart(got, templates))]
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(lo, hi - lo).take(pa.array(cols[0], pa.int64())),
                     *(pa.array(c, pa.int64()) for c in cols[1:])], ["id", "t", "start", "end", "matched"])
    return run


def _apart(found: list[tuple[int, int, int, int]], templates: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """Of overlapping matches (start, end, words, template) the one with most words, then with the
    fullest template, the shorter one, the first."""
    out: list[tuple[int, int, int, int]] = []
    for m in sorted(set(found), key=lambda m: (-m[2], -m[2] / len(templates[m[3]]), m[1] - m[0], m[0], m[3])):
        if all(m[1] <= o[0] or m[0] >= o[1] for o in out):
            out.append(m)
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str | Template] | None = None, id_col: str = "doc_id",
                  text_col: str = "text", min_coverage: float = 0.8) -> DataFrame:
    """-> (doc_id, license, start, end, matched, coverage), one row per notice found.

    ``start`` and ``end`` are word places in the text [start, end), ``matched``
    the template words found there in order, ``coverage`` their share of the
    template, at least ``min_coverage``, as is their share of the words
    from start to end. Words are as in the decontamination operator.

    Matches do not overlap: the one with most matched words stays, then the one
    of the fuller template, the shorter one, the first one.

    Defined cases: NULL and empty texts hold nothing; texts of any length are
    scanned whole; rows that repeat an id or have a NULL id are scanned like
    any other. Templates without words find nothing. Other columns are not
    looked at. No match, no row.
    """
    spark = docs.sparkSession
    words = Words(WORD)
    def hashed(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return words.hashes(raw, np.array([0, len(raw)]))[0]

    listed, must, never = {}, [], []
    for name, t in sorted((templates or TEMPLATES).items()):
        t = t if isinstance(t, Template) else Template(t)
        if len(h := hashed(t.text)):
            listed[name] = h
            must.append(set(hashed(t.must).view(np.int64).tolist()))
            never.append(set(hashed(t.never).view(np.int64).tolist()))
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    vocabulary = np.unique(np.concatenate(list(listed.values()))) if listed else np.zeros(1, U64)
    counts = {r.term: r.n for r in src.select("text").mapInArrow(_frequencies(vocabulary), "term bigint, n bigint")
              .groupBy("term").agg(F.sum("n").alias("n")).collect()}  # at most one row per template word
    lists, cues = [], []
    for h in listed.values():
        w = h.view(np.int64).tolist()
        need = int(np.ceil(min_coverage * len(w)))
        rare = sorted(range(len(w)), key=lambda i: (counts.get(w[i], 0), i))[:len(w) - need + 1]
        cue: dict[int, list[int]] = {}
        for i in rare:
            cue.setdefault(w[i], []).append(i)
        lists.append(w)
        cues.append(cue)
    if not lists:
        return spark.createDataFrame([], "doc_id bigint, license string, start bigint, end bigint, matched bigint, "
                                         "coverage double")
    found = src.mapInArrow(_scan(lists, cues, must, never, min_coverage), "id bigint, t bigint, start bigint, end bigint, "
                                                              "matched bigint")
    pick = F.element_at(F.array(*[F.lit(n) for n in listed]), (F.col("t") + 1).cast("int"))
    size = F.element_at(F.array(*[F.lit(len(w)) for w in lists]), (F.col("t") + 1).cast("int"))
    return found.select(F.col("id").alias("doc_id"), pick.alias("license"), "start", "end", "matched",
                        (F.col("matched") / size).alias("coverage"))
