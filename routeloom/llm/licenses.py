"""License scans by patience alignment.

A text and a template are aligned on the words that both have exactly once: of these the longest increasing
subsequence are anchors, anchors grow over equal words on either side, and the gaps between them are aligned
again in the same way. Coverage is the share of the template's words that are aligned. Words that the template hasn't
don't count, however many they are; of those it has, a licence may be spread over `SPAN` times the template's length, or
any number. Long texts are aligned window by window, where the words there allow enough coverage.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .license_texts import TEXTS

#: Public licence notices (fixed values).
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "GPL-2.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "MIT name": "Licensed under the MIT License.",
    "BSD line": "Released under the BSD License.",
    "BSD name": "Licensed under the BSD License.",
    "MPL-2.0 line": "Mozilla Public License, version 2.0",
    "Unlicense line": "Released under the Unlicense.",
    "CC0-1.0 line": "Licensed under CC0 1.0.",
    "CC0-1.0 name": "CC0 1.0 Universal",
    "GPL-2.0 line": "GNU General Public License, version 2",
    "GPL-3.0 name": "GNU General Public License, version 3",
    "LGPL-2.1 line": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0 line": "GNU Lesser General Public License, version 3",
    "AGPL-3.0 line": "GNU Affero General Public License, version 3",
    "CC-BY-4.0 name": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 name": "Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-ND-4.0 line": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0 name": "Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-NC-4.0 name": "Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-NC-SA-4.0 line": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-4.0 name": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-NC-ND-4.0 line": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-4.0 name": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    **TEXTS,
}
COVERAGE = 0.8
SPAN = 4  # template lengths that a licence may take up in a text, of words that the template has; None: no limit
SHORT, NOTICE = 20, 200  # words: shorter templates must align whole; those between the two must agree in the telling words
BETWEEN = 2  # other words inside a short template's place
VERSION = frozenset(b"%d" % i for i in range(10))
FAMILY = frozenset([b"lesser", b"affero"])
OTHERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
SCHEMA = "doc_id long, n_words long, license string, coverage double, n_aligned int, start_word long, end_word long, licenses array<string>"


def words(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates."""
    return (text or "").encode("utf-8", "replace").translate(OTHERS).split()


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence that increases in both; `pairs` are in order of the first. Patience piles, then back."""
    tops, piles, back = [], [], []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        if k == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[k], piles[k] = b, i
        back.append(piles[k - 1] if k else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Aligned places of text `a` and template `b`."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1 == na.get(w, 0)}
        anchors = increasing([(i, at[w]) for i, w in enumerate(a[a0:a1], a0) if w in at])
        if not anchors:
            continue
        i, j = a0, b0
        for x, y in [*anchors, (a1, b1)]:
            if x < i or y < j:
                continue  # an anchor before it has grown over this one
            lo, up = x, y
            while lo > i and up > j and a[lo - 1] == b[up - 1]:  # an anchor grows back; so does a gap's end
                if (x, y) == (a1, b1):
                    break
                lo, up = lo - 1, up - 1
            if lo > i and up > j:
                todo.append((i, lo, j, up))
            while (x, y) != (a1, b1) and x < a1 and y < b1 and a[x] == b[y]:
                x, y = x + 1, y + 1
            out += zip(range(lo, x), range(up, y), strict=False)
            i, j = x, y
    return sorted(out)


def best(text: list[bytes], template: list[bytes], least: float, span: int | None = SPAN) -> list[tuple[int, int]]:
    """The alignment that covers most of the template, at its first place; [] below `least`.

    Only words that the template has are aligned, so any number of others may stand between. Windows of twice `span`
    template lengths of such words overlap by half, so an alignment over `span` lengths lies in one whole; with None
    the first window is the whole text. Where a window's alignment isn't full, perhaps because copies hide each
    other's words, its parts are aligned too.
    """
    need, known, m, top = least * len(template), set(template), len(template), []
    at = [i for i, w in enumerate(text) if w in known]
    if len(at) < need:
        return top
    own, step = [text[i] for i in at], len(at) if span is None else span * m
    todo = [(s, min(len(own), s + 2 * step)) for s in range((len(own) - 1) // step * step, -1, -step)]
    want = Counter(template)
    while todo and len(top) < m:
        lo, hi = todo.pop()
        part = own[lo:hi]
        if (Counter(part) & want).total() < max(len(top) + 1, need - 1e-9):
            continue
        found = align(part, template)
        if len(found) > max(len(top), need - 1e-9):
            top = [(at[lo + i], j) for i, j in found]
        if len(found) < m and hi - lo > m:
            size = max(m, (hi - lo) // 2)
            todo += [(s, s + size) for s in range(hi - size, lo - 1, -max(1, size // 2))]
    return top


def near(text: list[bytes], template: list[bytes], between: int = BETWEEN) -> list[tuple[int, int]]:
    """The first place where a short template aligns whole, with `between` other words inside at most; [] if nowhere.

    It is looked for around its word that the text has least often: the bare length first, so words repeated beside an
    occurrence can't hide it, then with room.
    """
    m, many = len(template), Counter(text)
    pivot = min(template, key=many.__getitem__)
    turns = [j for j, w in enumerate(template) if w == pivot]
    for p in (i for i, w in enumerate(text) if w == pivot):
        for room in (0, between):
            for j in turns:
                lo = max(0, p - j - room)
                found = align(text[lo : p - j + m + room], template)
                if len(found) == m and found[-1][0] - found[0][0] < m + between:
                    return [(lo + i, k) for i, k in found]
    return []


def tells_apart(text: list[bytes], template: list[bytes], found: list[tuple[int, int]]) -> bool:
    """Whether a notice that names a version agrees in all words that tell licences apart: numbers, lesser, library, affero."""
    if len(template) >= NOTICE or VERSION.isdisjoint(template):
        return True
    here, there = {i for i, _ in found}, {j for _, j in found}
    telling = VERSION | FAMILY
    if any(w in telling and j not in there for j, w in enumerate(template)):
        return False
    return not any(i not in here and (text[i] in telling or text[i] == b"library" and text[i - 1] == b"gnu") for i in range(found[0][0], found[-1][0] + 1))


def outer(hits: list[tuple]) -> list[tuple]:
    """Hits (coverage, words, start, end, name) without those that lie inside a larger hit of another licence."""
    return [h for h in hits if not any(o[1] > h[1] and o[2] <= h[2] and h[3] <= o[3] and o[4].split(" ")[0] != h[4].split(" ")[0] for o in hits)]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE, span: int | None = SPAN, between: int = BETWEEN) -> DataFrame:
    """For each row of `docs` (doc_id, text): its best licence (null: none), coverage, place, and all that reach `least`.

    Ties go to the template named first. Null and empty texts have no licence; repeated rows give repeated rows; other
    columns are not read. Whole texts of any length are scanned, window by window.
    A template is skipped only where its words in the text can't reach `least`. A licence may be spread over `span`
    template lengths of words that the template has, and over any number of others; None sets no limit. Templates under
    `SHORT` words must align whole with `between` other words inside at most, notices that name a version must agree in it, and a hit inside a larger one of another licence is
    part of that. No shuffle.
    """
    own = {k: words(t) for k, t in (templates or TEMPLATES).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {k: set(t) for k, t in own.items()}
        every = set().union(*sets.values())
        fewest = {k: len(sets[k]) if len(t) < SHORT else max(1, int(least * len(t)) - (len(t) - len(sets[k]))) for k, t in own.items()}
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                w = words(text)
                here = every.intersection(w)
                hits = []
                for k, t in own.items():
                    if len(here & sets[k]) < fewest[k]:
                        continue
                    found = (near(w, t, between) if t else []) if len(t) < SHORT else best(w, t, least, span)
                    if found and tells_apart(w, t, found):
                        hits.append((len(found) / len(t), len(found), found[0][0], found[-1][0] + 1, k))
                hits = outer(hits)
                top = max(hits, key=lambda h: h[:2], default=(0.0, 0, None, None, None))
                rows.append((len(w), top[4], top[0], top[1], top[2], top[3], [h[4] for h in hits]))
            yield pa.record_batch([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
