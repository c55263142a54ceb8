"""License scans by patience alignment of texts with templates.

Words that occur once in the text and once in the template are anchors; the
longest increasing run of anchors is kept, and the gaps between them are
aligned in the same way. Coverage is the share of the template's words that are
aligned within a stretch of the text about as long as the template. Gaps without
anchors stay unaligned; where that leaves too little, the stretch with the
longest common subsequence is taken instead.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NOT_ALNUM, release, row_steps, text_buffers, words_of

LEAST_COVERAGE = 0.8

# Public license notices.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-line": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience_align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j), increasing in both, with a[i] == b[j]."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_b: dict[int, int] = {}
        for j in range(b0, b1):
            in_b[b[j]] = -1 if b[j] in in_b else j
        in_a: dict[int, int] = {}
        for i in range(a0, a1):
            if in_b.get(a[i], -1) >= 0:
                in_a[a[i]] = -1 if a[i] in in_a else i
        anchors = sorted((i, in_b[w]) for w, i in in_a.items() if i >= 0)
        if not anchors:
            continue
        anchors = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += anchors
        stack += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def longest_common(a: list[int], b: list[int], width: int, at: list[int], least: int) -> tuple[int, int, int]:
    """Length of the longest common subsequence with ``b`` of any stretch of ``a`` whose places ``at`` span at most ``width``, if ``least`` or more (else 0), and its shortest such stretch's first and last index.

    Bit-parallel: a zero of ``open_`` is a word of ``b`` at which the subsequence grows.
    """
    bits: dict[int, int] = {}
    for j, w in enumerate(b):
        bits[w] = bits.get(w, 0) | 1 << j
    full, quota = (1 << len(b)) - 1, {w: x.bit_count() for w, x in bits.items()}
    best, held, end = (0, 0, 0), dict.fromkeys(bits, 0), 0
    bound = 0  # words of the stretch that the template holds too, each as often as it does
    for start in range(len(a)):
        while end < len(a) and at[end] - at[start] <= width:
            bound += held[a[end]] < quota[a[end]]
            held[a[end]] += 1
            end += 1
        if bound >= max(least, best[0]):
            open_, length, last = full, 0, start
            for i in range(start, end):
                u = open_ & bits[a[i]]
                open_ = (open_ + u | open_ - u) & full
                grown = len(b) - open_.bit_count()
                if grown > length:
                    length, last = grown, i
            if length >= least and (length, start - last) > (best[0], best[1] - best[2]):
                best = (length, start, last)
        held[a[start]] -= 1
        bound -= held[a[start]] < quota[a[start]]
    return best


class LicenseMatcher:
    def __init__(self, templates: dict[str, str], least: float = LEAST_COVERAGE):
        self.names, self.least = list(templates), least
        data, offsets = text_buffers(pa.array([templates[n] for n in self.names], pa.string()))
        hashes, _, _, rows = words_of(data, offsets, NOT_ALNUM)
        self.words, codes = np.unique(hashes, return_inverse=True)
        self.codes = [codes[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
        self.counts = np.stack([np.bincount(c, minlength=len(self.words)) for c in self.codes])
        self.needed = [int(np.ceil(least * len(c) - 1e-9)) for c in self.codes]

    def best_stretch(self, where: np.ndarray, code: np.ndarray, k: int) -> tuple[float, int, int]:
        """Coverage of template k in a text whose words ``code`` stand at ``where``, and its first and last word there.

        Around each occurrence of the text's rarest word of the template, a
        stretch as long as the template on both sides is aligned.
        """
        template = self.codes[k]
        mine = np.flatnonzero(self.counts[k][code])
        at, seq = where[mine], code[mine]
        seen = np.bincount(seq, minlength=len(self.words))
        missing = len(template) - self.needed[k]
        # all but ``missing`` of the template's words are there: so is one of its rarest that many and one
        order = sorted(set(template.tolist()), key=lambda w: (seen[w], w))
        rare, left = [], missing
        for w in order:
            rare.append(w)
            left -= int(self.counts[k][w])
            if left < 0:
                break
        spread = len(template) + len(template) // 2 + 4
        best, done = (0.0, 0, 0), -1
        for place in at[np.isin(seq, rare)]:
            if place <= done:
                continue
            a, b = np.searchsorted(at, place - spread), np.searchsorted(at, place + spread, "right")
            done = place + spread // 4
            if b - a < self.needed[k]:
                continue
            pairs = patience_align(seq[a:b].tolist(), template.tolist())
            places = at[a + np.array([i for i, _ in pairs], np.int64)] if pairs else np.zeros(0, np.int64)
            ends = np.searchsorted(places, places + spread, "right")
            if len(places):
                first = int((ends - np.arange(len(places))).argmax())
                share = (ends[first] - first) / len(template)
                if share > best[0]:
                    best = (float(share), int(places[first]), int(places[ends[first] - 1]))
                    if share >= 1:
                        break
        if best[0] >= self.least - 1e-9:
            return best
        length, first, last = longest_common(seq.tolist(), template.tolist(), spread, at.tolist(), self.needed[k])
        return (length / len(template), int(at[first]), int(at[last])) if length else best

    def stretches(self, where: np.ndarray, code: np.ndarray, k: int) -> Iterator[tuple[float, int, int]]:
        """All stretches of template k that cover enough of it: the best one, then those before and after it."""
        parts = [(where, code)]
        while parts:
            where, code = parts.pop()
            if np.minimum(np.bincount(code, minlength=len(self.words)), self.counts[k]).sum() < self.needed[k]:
                continue
            share, first, last = self.best_stretch(where, code, k)
            if share >= self.least - 1e-9:
                yield share, first, last
                a, b = np.searchsorted(where, first), np.searchsorted(where, last, "right")
                parts += [(where[:a], code[:a]), (where[b:], code[b:])]

    def match(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[list[tuple[str, float, int, int]]]:
        """For each row the licenses found: (name, coverage, first byte, past the last byte)."""
        hashes, starts, ends, rows = words_of(data, offsets, NOT_ALNUM)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        known = np.flatnonzero(self.words[at] == hashes)
        row = np.searchsorted(rows, known, "right") - 1
        counts = np.zeros((len(offsets) - 1, len(self.words)), np.int32)
        np.add.at(counts, (row, at[known]), 1)
        may = np.stack([np.minimum(counts, c).sum(1) >= n for c, n in zip(self.counts, self.needed, strict=True)], 1)
        cuts = np.searchsorted(row, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            found = []
            if may[i].any():
                where = known[cuts[i] : cuts[i + 1]]
                for k in np.flatnonzero(may[i]):
                    base = int(offsets[i] - offsets[0])
                    for share, first, last in self.stretches(where, at[where], int(k)):
                        found.append((self.names[k], round(share, 4), int(starts[first]) - base, int(ends[last]) - base))
            yield found


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """id_col and licenses: array of (name, coverage, start, end), best coverage first, of every row; a notice that recurs has an entry each time.

    start and end are bytes of the UTF-8 text. Words are runs of letters and
    digits, A-Z as a-z. Null and empty texts have no licenses; repeated rows
    give repeated rows; an empty table an empty one; other columns aren't read.
    One narrow scan, no shuffle. A row is aligned only with templates of which
    it holds enough words; that bound is exact.
    """
    chosen = TEMPLATES if templates is None else templates
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("name", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = LicenseMatcher(chosen, least)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            out = []
            for a, b in row_steps(offsets):
                for found in matcher.match(data, offsets[a : b + 1]):
                    out.append([dict(zip(("name", "coverage", "start", "end"), x, strict=True)) for x in sorted(found, key=lambda x: (-x[1], x[0], x[2]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(item))], ["id", "licenses"])
        release()

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"id {kind}, licenses array<struct<name:string,coverage:double,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def summarize(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """license and coverage of the best match (null without any), n_licenses and all names."""
    best = F.try_element_at("licenses", F.lit(1))
    return scanned.select(id_col, best["name"].alias("license"), best["coverage"].alias("coverage"), F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"))
