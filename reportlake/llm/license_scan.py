"""License scans: winnowed fingerprints pick candidates, banded alignment decides.

Templates are cut into k-grams of words; of every ``WINDOW`` consecutive k-grams
the one with the smallest hash is a fingerprint, and an inverted index leads
from fingerprints to template and position.  Texts are winnowed alike, so any
``GRAM + WINDOW - 1`` common words share a fingerprint.  Hits near one diagonal
of text against template are aligned within a band around it, which reports how
many of the template's words are matched and where.

The index holds the templates only, which are a fixed list; texts are read once
and nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reportlake.llm.kernels import U, Words, mix, sliding_min, text_blocks
from reportlake.llm.shared import documents_of, named_id

GRAM, WINDOW = 3, 3
#: Words by which an alignment may leave its diagonal; share of a template's words to report.
BAND, COVERAGE = 8, 0.7

# Public license notices.
TEMPLATES = {
    "Apache-2.0 reference": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "MIT reference": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "GPL-3.0 reference": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-NC-4.0 reference": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

RESULT = "doc long, license string, coverage double, matched long, start long, end long"


def _words(text: str) -> np.ndarray:
    buf = np.frombuffer(text.encode(), dtype=np.uint8)
    return Words(buf, np.array([0, len(buf)]), "alnum").hashes(buf, lower=True)


def winnow(hashes: np.ndarray, valid: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the fingerprints of a row of word hashes.

    ``valid`` marks k-gram starts within one text.  Texts too short for a whole
    window give their smallest k-gram.
    """
    n = len(hashes) - gram + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    value = np.zeros(n, dtype=U)
    for i in range(gram):
        value = mix(value + hashes[i : i + n])
    top = U(0xFFFFFFFFFFFFFFFF)
    value[~valid[:n]] = top
    padded = np.concatenate([np.full(window - 1, top), value, np.full(window - 1, top)])
    least = sliding_min(padded, window)
    chosen = np.zeros(n, dtype=bool)
    for shift in range(window):  # k-gram i is the least of the window that starts at i - shift
        chosen |= least[window - 1 - shift : window - 1 - shift + n] == value
    at = np.flatnonzero(chosen & valid[:n])
    return at, value[at]


def build_index(templates: dict[str, str]) -> tuple[list[str], list[np.ndarray], np.ndarray, np.ndarray]:
    """Names, word hashes, and the sorted fingerprints with ``template << 16 | position``."""
    names, words, keys, places = list(templates), [], [], []
    for t, text in enumerate(templates.values()):
        w = _words(text)
        words.append(w)
        at, value = winnow(w, np.ones(len(w), dtype=bool))
        keys.append(value)
        places.append((t << 16) | at)
    key, place = np.concatenate(keys), np.concatenate(places)
    order = np.argsort(key, kind="stable")
    return names, words, key[order], place[order]


def align(text: np.ndarray, template: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Local alignment within ``band`` of a diagonal: matched words, and their first and last position in ``text``.

    A match scores 2, a mismatch or a skipped word costs 1.
    """
    width = 2 * band + 1
    score = np.zeros(width + 2, dtype=np.int64)
    state = [(0, 0, 0)] * (width + 2)  # matched, first, last
    best, answer = 0, (0, 0, 0)
    for i, word in enumerate(template):
        now, held = np.zeros(width + 2, dtype=np.int64), [(0, 0, 0)] * (width + 2)
        for c in range(1, width + 1):
            j = i + diagonal + c - 1 - band
            if not 0 <= j < len(text):
                continue
            if text[j] == word:
                m, f, _ = state[c]
                now[c], held[c] = score[c] + 2, (m + 1, f if m else j, j)
            elif score[c] > 1:
                now[c], held[c] = score[c] - 1, state[c]
            if score[c + 1] - 1 > now[c]:  # the template's word is missing in the text
                now[c], held[c] = score[c + 1] - 1, state[c + 1]
            if now[c - 1] - 1 > now[c]:  # the text has one word more
                now[c], held[c] = now[c - 1] - 1, held[c - 1]
            if now[c] > best:
                best, answer = int(now[c]), held[c]
        score, state = now, held
    return answer


def _scan(templates: dict[str, str], coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words, keys, places = build_index(templates)
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            for i, _, buf, offs in text_blocks(batch):
                w = Words(buf, offs, "alnum")
                h = w.hashes(buf, lower=True)
                at = np.arange(len(h)) - w.first[w.doc]
                pos, value = winnow(h, at + GRAM <= w.count[w.doc])
                lo = np.searchsorted(keys, value)
                hi = np.searchsorted(keys, value, side="right")
                hit = np.flatnonzero(hi > lo)
                if not len(hit):
                    continue
                chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                seen: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for x in hit.tolist():
                    for y in range(lo[x], hi[x]):
                        t, p = int(places[y]) >> 16, int(places[y]) & 0xFFFF
                        seen.setdefault((int(w.doc[pos[x]]), t), []).append((int(pos[x]) - p, int(pos[x])))
                out = []
                for (row, t), hits in seen.items():
                    a, b = w.first[row], w.first[row + 1]
                    # Narrower for short templates, so that two places in a row keep apart.
                    done, band = -len(h) - 1, max(1, min(BAND, len(words[t]) // 3))
                    for diagonal, where in sorted(hits):
                        if diagonal <= done:  # within the band of one that was aligned
                            continue
                        lo_at, hi_at = max(int(a), diagonal - band), min(int(b), diagonal + len(words[t]) + band)
                        matched, first, last = align(h[lo_at:hi_at], words[t], diagonal - lo_at, band)
                        done = diagonal + band // 2
                        if matched >= coverage * len(words[t]):
                            first, last = first + lo_at, last + lo_at
                            start, end = chars[w.start[first]] - chars[offs[row]], chars[w.end[last]] - chars[offs[row]]
                            out.append((i + row, names[t], matched / len(words[t]), matched, int(start), int(end)))
                out = [(int(doc[row]), *rest) for row, *rest in sorted(_best(out))]
                columns = list(zip(*out, strict=True)) or [()] * 6
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "license", "coverage", "matched", "start", "end"]
                )

    return run


def _best(found: list[tuple]) -> list[tuple]:
    """Of overlapping reports of one license in one row of a block, the one with most matched words."""
    kept: list[tuple] = []
    spans: dict[tuple[int, str], list[tuple[int, int]]] = {}  # those kept, apart from each other, in order
    for f in sorted(found, key=lambda f: (f[0], f[1], -f[3], f[4])):
        own = spans.setdefault(f[:2], [])
        k = bisect(own, (f[4], f[5]))
        if (k and own[k - 1][1] > f[4]) or (k < len(own) and own[k][0] < f[5]):
            continue
        own.insert(k, (f[4], f[5]))
        kept.append(f)
    return kept


def scan(documents: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, coverage, matched, start, end``: one row per place where a template is matched.

    ``coverage`` is the matched share of the template's words (runs of letters
    and digits, case ignored); ``start`` and ``end`` are code points in the text,
    the end exclusive.  Texts without a match, null and empty ones give no row.
    Repeated rows give repeated reports; a null id stays null; an empty table
    gives an empty result; extra columns are ignored.
    """
    docs = documents_of(documents, id_col, text_col).select("doc", "text")
    out = docs.mapInArrow(_scan(templates or TEMPLATES, coverage), RESULT)
    return out.select(named_id().alias("doc_id"), *out.columns[1:])
