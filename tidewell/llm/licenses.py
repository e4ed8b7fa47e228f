"""License scans (operator 7) by conditional compression.

Candidate blocks are the stretches of a text that can hold a template at all: in
a window of twice the template's words, enough of its words are there. This
rules out nothing that could be confirmed. Each block is compressed by
zstandard alone and with every template as raw dictionary; templates are ranked
by how many bytes they save for each of their own. In that order each is
aligned with the block, word by word, and confirmed by its exact differences: at
least ``COVERED`` of its words are there, in order, no word that tells licences
apart differs, and the span itself, not the block, gets smaller by
``LEAST_GAIN``. A confirmed span is cut out, and what is left of the block is
searched again, until no template is confirmed; none is given up for its rank.

Defined cases: null and empty texts have no blocks; repeated rows repeat their
results; texts are read whole, however long. A block that no template confirms
gives no row, one with several notices a row for each. Of spans that overlap the
one that agrees most wins, then the template first in the list. An empty table
gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.textvec import pieces
from tidewell.storage import bound_batches

# Notices as the licences themselves ask for them, and short forms in common use.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
)

#: Licences by their SPDX tags and the names in which texts speak of them; fixed values.
TITLES: tuple[tuple[str, str], ...] = (
    ("MIT", "The MIT License"), ("Apache-2.0", "Apache License Version 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"),
    ("GPL-2.0", "GNU General Public License Version 2"), ("GPL-3.0", "GNU General Public License Version 3"), ("LGPL-2.1", "GNU Lesser General Public License Version 2.1"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3"), ("MPL-2.0", "Mozilla Public License Version 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"), ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
)
TAGS = tuple(dict.fromkeys(name for name, _ in TEMPLATES))
ALL = (*TEMPLATES, *TITLES, *((tag, f"SPDX-License-Identifier: {tag}") for tag in TAGS))

LEAST_GAIN, COVERED = 0.2, 0.8
#: What a word that a span lacks costs in words that it has besides: a span may grow so far before its gain falls below the least.
LACK = round(1 / LEAST_GAIN) - 1
#: Words that tell licences apart: they must be in a span as they are in the template. Numbers count where a licence is only named.
TELLING = frozenset("mit apache bsd isc gnu gpl lgpl agpl lesser library affero mozilla mpl cc cc0 unlicense creative commons attribution sharealike noncommercial noderivatives noderivs nc sa nd by zero public".split())
NAMED = 24
#: Words of ordinary prose, which say nothing of where a template may be.
COMMON = frozenset("a an and any are as at be by for from if in is it its may no not of on or out so that the this to under was with you".split())

_WORD = re.compile(r"[^\W_]+")
_CLOSE = re.compile(r"[^\w\s]*")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(maxsize=1)
def _compressors() -> tuple[zstandard.ZstdCompressor, list[zstandard.ZstdCompressor]]:
    def made(dictionary: zstandard.ZstdCompressionDict | None) -> zstandard.ZstdCompressor:
        shape = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=shape)

    raw = [zstandard.ZstdCompressionDict(" ".join(_words(t)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t in ALL]
    return made(None), [made(d) for d in raw]


class Template:
    """A template's words; those that can be told from prose, and how many of them a span needs at least."""

    def __init__(self, text: str):
        self.words = _words(text)
        self.counts = Counter(self.words)
        rare = [w for w in self.words if w not in COMMON]
        self.marks = frozenset(rare)
        self.least = math.ceil(COVERED * len(self.words)) - (len(self.words) - len(rare))
        telling = TELLING | {w for w in self.words if w[0].isdigit()} if len(self.words) <= NAMED or "gnu" in self.counts else TELLING
        self.telling = telling & self.marks | TELLING
        self.told = Counter(w for w in self.words if w in self.telling)

    def tells(self, words: list[str]) -> bool:
        """Whether the words hold what tells this licence apart, no more and no less."""
        return Counter(w for w in words if w in self.telling) == self.told


@lru_cache(maxsize=1)
def _templates() -> tuple[list[Template], dict[str, int], np.ndarray]:
    """The templates, a number for each word that marks one, and which templates it marks."""
    made = [Template(t) for _, t in ALL]
    number = {w: i for i, w in enumerate(sorted(set().union(*(t.marks for t in made))))}
    marks = np.zeros((len(number), len(made)), dtype=bool)
    for i, t in enumerate(made):
        marks[[number[w] for w in t.marks], i] = True
    return made, number, marks


def blocks_of(words: list[str]) -> list[tuple[int, int]]:
    """Ranges of words that may hold a template: any span that can be confirmed lies in one of them."""
    made, number, marks = _templates()
    known = np.array([number.get(w, -1) for w in words], dtype=np.int64)
    at = (known >= 0).nonzero()[0]
    if not len(at):
        return []
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    for i, t in enumerate(made):
        mine = at[marks[known[at], i]]
        if len(mine) >= t.least:
            reach = 2 * len(t.words)  # a longer span has more words besides than its gain allows
            near = mine[t.least - 1 :] - mine[: len(mine) - t.least + 1] < reach
            starts = mine[: len(mine) - t.least + 1][near]
            np.add.at(cover, np.maximum(starts - reach, 0), 1)
            np.add.at(cover, np.minimum(starts + 2 * reach, len(words)), -1)
    inside = np.cumsum(cover[:-1]) > 0
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return list(zip((edges == 1).nonzero()[0].tolist(), (edges == -1).nonzero()[0].tolist(), strict=True))


def _size(words: list[str], nth: int | None = None) -> int:
    """Bytes of the words compressed alone, or with a template as dictionary."""
    alone, given = _compressors()
    return len((alone if nth is None else given[nth]).compress(" ".join(words).encode()))


def _gain(words: list[str], nth: int) -> float:
    """How much smaller the template makes the words, relative to their size without it."""
    size = _size(words)
    return (size - _size(words, nth)) / size


def ranked(words: list[str]) -> list[int]:
    """All templates, by the bytes they save in a block for each byte that they have themselves."""
    alone = _size(words)
    saved = [(alone - _size(words, i)) / _size(t.words) for i, t in enumerate(_templates()[0])]
    return sorted(range(len(saved)), key=lambda i: (-saved[i], i))


def align(own: list[str], words: list[str]) -> list[tuple[int, int, int]]:
    """(start, end, words missing) of the cheapest span of ``words`` for ``own`` from each start, if enough is there.

    Costs are the least over all alignments, a row of the table at a time.
    """
    n = len(words)
    at = np.arange(n + 1, dtype=np.int64)
    cost, start, missing = np.zeros(n + 1, np.int64), at.copy(), np.zeros(n + 1, np.int64)
    number = {w: i for i, w in enumerate(dict.fromkeys(own))}
    ids = np.array([number.get(w, -1) for w in words], dtype=np.int64)
    for w in own:
        met = (ids == number[w]).nonzero()[0]
        met = met[cost[met] <= cost[met + 1] + LACK]
        cost_, start_, missing_ = cost + LACK, start.copy(), missing + 1
        cost_[met + 1], start_[met + 1], missing_[met + 1] = cost[met], start[met], missing[met]
        best = np.minimum.accumulate((cost_ - at) * (n + 1) + (n - at))
        of = n - best % (n + 1)
        cost, start, missing = cost_[of] + at - of, start_[of], missing_[of]
    found: dict[int, tuple[int, int, int]] = {}
    for end in (len(own) - missing >= COVERED * len(own)).nonzero()[0].tolist():
        key = int(start[end])
        if key not in found or cost[end] < found[key][0]:
            found[key] = (int(cost[end]), end, int(missing[end]))
    return [(a, b, lacks) for a, (_, b, lacks) in found.items() if a < b]


def _found(part: list[str], order: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """Spans of a block that a template confirms: (missing less common, besides, template, start, end, missing)."""
    made, held, out = _templates()[0], Counter(part), []
    for i in order:
        own = made[i]
        if sum(min(k, held[w]) for w, k in own.counts.items()) >= COVERED * len(own.words):
            for a, b, lacks in align(own.words, part):
                common = len(own.words) - lacks
                if b - a <= 2 * len(own.words) and own.tells(part[a:b]) and _gain(part[a:b], i) >= LEAST_GAIN:
                    out.append((lacks - common, b - a - common, i, a, b, lacks))
    return out


def identify(words: tuple[str, ...]) -> list[tuple[int, int, int, int, int]]:
    """Notices in a block: (start, end, template, words missing, words besides)."""
    todo, out = [(0, len(words))], []
    while todo:
        low, high = todo.pop()
        part = list(words[low:high])
        taken: list[tuple[int, int]] = []
        for _, more, i, a, b, lacks in sorted(_found(part, ranked(part))):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                out.append((low + a, low + b, i, lacks, more))
        if taken:
            edges = [0, *(x for span in sorted(taken) for x in span), len(part)]
            todo += [(low + a, low + b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
    return sorted(out)


_again = lru_cache(maxsize=4096)(identify)


def notices(text: str) -> list[tuple[int, int, str, float, int, int]]:
    """Span in code points, licence, relative gain, words missing and words besides of every notice in a text."""
    lower = text.lower()
    if len(lower) != len(text):  # some characters grow in lower case
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    words = _WORD.findall(lower)
    out: list = []
    places = None
    for a, b in blocks_of(words):
        for x, y, i, lacks, more in (_again if b - a < 2000 else identify)(tuple(words[a:b])):
            if places is None:
                places = [m.span() for m in _WORD.finditer(lower)]
            start, end = places[a + x][0], places[a + y - 1][1]
            out.append((start, _CLOSE.match(text, end).end(), ALL[i][0], round(_gain(words[a + x : a + y], i), 4), lacks, more))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows += [(doc, *found) for found in notices(text.as_py() or "")]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "block_start", "block_end", "license", "gain", "words_missing", "words_extra"])


def license_scan(docs: DataFrame) -> DataFrame:
    """A row for every confirmed notice: its span in code points, the licence and the differences."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, "doc_id bigint, block_start bigint, block_end bigint, license string, gain double, words_missing bigint, words_extra bigint")
