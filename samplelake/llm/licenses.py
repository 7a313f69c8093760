"""License notices in documents, found by patience alignment with templates.

Text and template are compared as lower-case words. Words that occur once in both are anchors;
the longest run of anchors in the same order in both is kept, and the gaps between are aligned in
the same way, with what is equal at their ends. Coverage is the share of the template's words
that are aligned.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from samplelake.llm.common import id_and_text, map_batches

COVERAGE = 0.8
_WORDS = re.compile(r"\w+")

_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met")
_BSD_2 = (f"{_BSD}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
          "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
          "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.")
_BSD_3 = (f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
          "promote products derived from this software without specific prior written permission.")
_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_GNU_VERSIONS = (("GPL", "2", "2.0"), ("GPL", "3", "3.0"), ("LGPL", "2.1", "2.1"), ("LGPL", "3", "3.0"), ("AGPL", "3", "3.0"))


def _gnu() -> list[tuple]:
    out = []
    for short, version, number in _GNU_VERSIONS:
        name, id_ = _GNU[short], f"{short}-{number}"
        telling = (name, f"version {version}")
        out += [
            (id_, f"This work is licensed under the {name}, version {version}", *telling),
            (id_, f"{name} Version {version}", f"{name} Version {version}"),
            (f"{id_}-or-later", f"it under the terms of the {name} as published by the Free Software Foundation, either version "
                                f"{version} of the License, or (at your option) any later version", *telling, "any later version"),
        ]
    return out


def _creative_commons() -> list[tuple]:
    long_ = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    out = []
    for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
        for version in ("2.0", "2.5", "3.0", "4.0"):
            id_, spelled = f"CC-{kind}-{version}", "-".join(long_[k] for k in kind.split("-"))
            scope = "International" if version == "4.0" else "Unported" if version == "3.0" else "Generic"
            name = f"Creative Commons {spelled} {version}"
            out += [(id_, f"Licensed under CC {kind} {version}", f"CC {kind} {version}"),
                    (id_, f"licensed under a {name} {scope} License", name)]
    return out


#: License, notice as the license asks for it or usual form or title, and the phrases
#: that tell it from others, which must be in the notice word for word.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License", "2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004", "Apache License", "Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License", "MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("ISC", "Released under the ISC License", "ISC"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("BSD", "Released under the BSD License", "BSD License"),
    ("BSD", _BSD),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License", "BSD 2-Clause"),
    ("BSD-2-Clause", _BSD_2),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License", "BSD 3-Clause"),
    ("BSD-3-Clause", _BSD_3, "may be used to endorse or promote"),
    *_gnu(),
    *(("MPL-" + v, f"subject to the terms of the Mozilla Public License, {w} {v}", "Mozilla Public License", v)
      for v, w in (("1.1", "Version"), ("2.0", "v."))),
    *(("MPL-" + v, f"Mozilla Public License Version {v}", "Mozilla Public License", f"Version {v}") for v in ("1.1", "2.0")),
    *_creative_commons(),
    ("CC0-1.0", "Released under CC0 1.0", "CC0 1.0"),
    ("CC0-1.0", "CC0 1.0 Universal", "CC0 1.0"),
    ("Unlicense", "Released under the Unlicense", "Unlicense"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved", "All rights reserved"),
)


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def _increasing(positions: Sequence[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    tails, at_tail, before = [], [], []
    for i, p in enumerate(positions):
        k = bisect_left(tails, p)
        tails[k : k + 1], at_tail[k : k + 1] = [p], [i]
        before.append(at_tail[k - 1] if k else -1)
    chain, i = [], at_tail[-1] if at_tail else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both."""
    pairs, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        i, j, k, m = gaps.pop()
        while i < j and k < m and a[i] == b[k]:
            pairs.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            pairs.append((j, m))
        if i == j or k == m:
            continue
        ours, theirs = Counter(a[i:j]), Counter(b[k:m])
        place = {w: at for at, w in enumerate(b[k:m], k) if theirs[w] == 1 and ours[w] == 1}
        anchors = [(at, place[w]) for at, w in enumerate(a[i:j], i) if w in place]
        chain = [anchors[x] for x in _increasing([p for _, p in anchors])]
        pairs += chain
        if chain:
            ends = [(i - 1, k - 1), *chain, (j, m)]
            gaps += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False)]
    return sorted(pairs)


@dataclass(frozen=True)
class Template:
    license_id: str
    words: tuple[str, ...]
    counts: tuple[tuple[str, int], ...]
    #: Phrases between blanks, and all their words.
    telling: tuple[str, ...] = ()
    told: frozenset[str] = frozenset()

    @staticmethod
    def of(license_id: str, text: str, *telling: str) -> Template:
        words, phrases = tuple(words_of(text)), [words_of(phrase) for phrase in telling]
        between = tuple(f" {' '.join(phrase)} " for phrase in phrases)
        return Template(license_id, words, tuple(Counter(words).items()), between, frozenset(w for p in phrases for w in p))

    def told_by(self, words: list[str]) -> bool:
        text = f" {' '.join(words)} "
        return all(phrase in text for phrase in self.telling)

    def find(self, words: list[str], have: set[str], coverage: float) -> list[tuple[int, int, float]]:
        """First and last word of each notice, and its coverage. Every stretch of one and a
        quarter times the template's words lies in one of the windows that are aligned; windows
        that hold too few of its words to reach ``coverage`` are passed over."""
        size = len(self.words)
        need = coverage * size
        if not size or not self.told <= have or sum(n for w, n in self.counts if w in have) < need:
            return []
        own = {w for w, _ in self.counts}
        sums = np.concatenate(([0], np.cumsum(np.fromiter((w in own for w in words), bool, len(words)))))
        step = max(1, size // 4)
        length = size + -(-size // 4) + step
        starts = np.arange(0, max(1, len(words) - size // 2), step)
        held = sums[np.minimum(starts + length, len(words))] - sums[starts]
        found = []
        for start in starts[held >= need].tolist():
            pairs = align(self.words, words[start : start + length])
            if len(pairs) >= need and self.told_by(words[start + pairs[0][1] : start + pairs[-1][1] + 1]):
                found.append((start + pairs[0][1], start + pairs[-1][1], len(pairs) / size))
        return _apart(found)


def _apart(found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Of overlapping stretches the one with the highest coverage, then the shortest and first."""
    kept: list[tuple[int, int, float]] = []
    for a, b, c in sorted(found, key=lambda x: (-x[2], x[1] - x[0], x[0])):
        if all(b < x or a > y for x, y, _ in kept):
            kept.append((a, b, c))
    return sorted(kept)


def _best(hits: list[tuple[Template, int, int, float]]) -> list[tuple[Template, int, int, float]]:
    """Of overlapping stretches of all templates the one with most aligned words, then the highest
    coverage, then the shortest and first."""
    kept: list[tuple[Template, int, int, float]] = []
    for hit in sorted(hits, key=lambda x: (-round(x[3] * len(x[0].words)), -x[3], x[2] - x[1], x[1], x[0].license_id)):
        if all(hit[2] < a or hit[1] > b for _, a, b, _ in kept):
            kept.append(hit)
    return kept


SCHEMA = "doc_id bigint, license_id string, start int, stop int, coverage double"


def notices(text: str | None, templates: Sequence[Template], coverage: float) -> list[tuple[str, int, int, float]]:
    """License, first and last code point (the last not included) and coverage of each notice."""
    words = words_of(text)
    have = set(words)
    hits = _best([(t, *hit) for t in templates for hit in t.find(words, have, coverage)])
    if not hits:
        return []
    spans = [m.span() for m in _WORDS.finditer(text.lower())]
    return sorted((t.license_id, spans[a][0], spans[b][1], c) for t, a, b, c in hits)


def scan(
    docs: DataFrame, templates: Sequence[tuple[str, ...]] = TEMPLATES, coverage: float = COVERAGE
) -> DataFrame:
    """``doc_id, license_id, start, stop, coverage`` of every notice that covers its template to
    at least ``coverage``; ``start`` and ``stop`` are code points of the lower-case text.

    Of templates that overlap the one with most aligned words is reported. Documents without a
    notice, null and empty texts give no row. Two templates of a license may both be found side
    by side. Repeated rows give repeated rows; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast([Template.of(*t) for t in templates])

    def work(batch: pa.RecordBatch) -> dict:
        rows = [
            (doc_id, *hit)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for hit in notices(text, shared.value, coverage)
        ]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        types = (("doc_id", pa.int64()), ("license_id", pa.string()), ("start", pa.int32()), ("stop", pa.int32()),
                 ("coverage", pa.float64()))
        return {n: pa.array(c, t) for (n, t), c in zip(types, columns, strict=True)}

    return map_batches(id_and_text(docs), work, SCHEMA)
