"""Finding license texts in documents by MinHash bands over overlapping windows.

Templates and documents are sequences of five-word shingles (``\\w+`` words in lower
case).  Templates are grouped by size into classes of at most L shingles, L a power of
two.  For each class a document is cut into blocks of L shingles, and every two adjacent
blocks are a window, so each stretch of L shingles lies in one window whole.  A template
of which at least 0.8 is in a window has a Jaccard similarity with it that is bounded
below by the class; the number of bands (of one MinHash each) follows from that bound and
the probability ``HIT`` with which such a window must share a band with its template.
Templates that share a band are compared exactly: the share of the template's distinct
shingles that the window holds must be at least 0.8.

MinHashes of blocks of L shingles are minima of those of half the length, so all classes
cost little more than the smallest.  Documents of any length are worked through in
pieces that overlap by the longest window.

Templates of one to four words have no shingle; they are matched exactly, as that many
words in a row.  ``SPDX-License-Identifier:`` lines are read as expressions, whatever
identifiers they name, and give a row ``spdx:`` and the identifier in lower case for each.

Defined results: null and empty texts have no match;
a document has one row per template, with the best share and the earliest place of it;
a text that holds another template, or that differs from one in less than a fifth of its
shingles, gives a row for that one too, and ``share`` tells them apart;
repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches, text_of
from .shingles import CACHE_ENTRIES, mixed

WORDS = re.compile(r"\w+")
WIDTH = 5
SHARE = (4, 5)
HIT = 0.9999
PIECE = 16_384
SPDX_ID = r"[A-Za-z0-9][A-Za-z0-9.+:-]*"
SPDX = re.compile(rf"(?i:SPDX-License-Identifier)\s*:\s*((?:\(\s*)*{SPDX_ID}(?:\s*\)|\s+(?:AND|OR|WITH)\s+(?:\(\s*)*{SPDX_ID})*)")

#: A small set of notices and statements; a parameter of the operator.  ``license_set`` has the full one.
TEMPLATES = {
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
}


class Hashes(dict):
    """Hashes of lower-case words as they are looked up; it starts anew when full."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHE_ENTRIES:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return found


def word_hashes(text: str | None, hashes: Hashes):
    """Hashes of the words of a text in order."""
    import numpy as np

    words = WORDS.findall(text.lower()) if text else []
    return np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles_of(words, width: int = WIDTH):
    """Hashes of the shingles of a text's word hashes in order."""
    import numpy as np

    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    h = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        h = mixed(h + words[k : n + k])
    return h


def spdx(text: str) -> dict[str, int]:
    """Identifiers of the SPDX lines of a text, with the first word of the first line of each."""
    out: dict[str, int] = {}
    place = done = 0
    for m in SPDX.finditer(text):
        # Words are counted from the last line on; one that goes on there is counted already.
        place += len(WORDS.findall(text[done : m.start()].lower())) - (done > 0 and WORDS.fullmatch(text[done - 1].lower()[-1]) is not None)
        done = m.start()
        for name in re.findall(SPDX_ID, m[1]):
            if name not in ("AND", "OR", "WITH"):
                out.setdefault(name.rstrip(".:-").lower(), place)
    return out


class Scanner:
    """Templates by classes, with their bands, and the scan of a text."""

    def __init__(self, templates: Mapping[str, str], hit: float = HIT):
        import numpy as np

        self.hashes = Hashes()
        words = {n: word_hashes(t, self.hashes) for n, t in templates.items()}
        if any(not len(w) for w in words.values()):
            raise ValueError("a template must have one word at least")
        self.short: dict[int, tuple[object, dict[int, list[str]]]] = {}
        for name in sorted(n for n, w in words.items() if len(w) < WIDTH):
            width = len(words[name])
            bits, found = self.short.setdefault(width, (np.zeros(65_536, dtype=bool), {}))
            value = int(shingles_of(words[name], width)[0])
            bits[value & 65_535] = True
            found.setdefault(value, []).append(name)
        self.names = sorted(n for n, w in words.items() if len(w) >= WIDTH)
        self.sets = [np.unique(shingles_of(words[n])) for n in self.names]
        up, down = SHARE
        classes: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            classes.setdefault(1 << max(0, len(words[self.names[t]]) - WIDTH).bit_length(), []).append(t)
        self.bands: dict[int, int] = {}
        for size, members in classes.items():
            window = size if size == 1 else 2 * size
            least = min(math.ceil(up * len(self.sets[t]) / down) / (window + len(self.sets[t]) - math.ceil(up * len(self.sets[t]) / down)) for t in members)
            self.bands[size] = 1 if least >= 1 else math.ceil(math.log(1 - hit) / math.log(1 - least))
        self.most = max(self.bands.values(), default=0)
        self.seeds = mixed(np.arange(1, self.most + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))
        self.odd = self.seeds | np.uint64(1)
        self.maps: dict[int, object] = {}
        self.finds: dict[int, dict[tuple[int, int], list[int]]] = {}
        for size, members in classes.items():
            bits, finds = np.zeros((self.bands[size], 65_536), dtype=bool), {}
            for t in members:
                for band, value in enumerate(self.ranks(self.sets[t], self.bands[size]).min(axis=1).tolist()):
                    bits[band, value & 65_535] = True
                    finds.setdefault((band, value), []).append(t)
            self.maps[size], self.finds[size] = bits, finds
        self.largest = max(self.bands, default=0)

    def ranks(self, h, bands: int):
        """32-bit ranks of shingles, one row per band."""
        import numpy as np

        return (((h[None, :] ^ self.seeds[:bands, None]) * self.odd[:bands, None]) >> np.uint64(32)).astype(np.uint32)

    def candidates(self, h) -> Iterator[tuple[int, int, int]]:
        """(template, start, end) of windows that share a band with a template."""
        import numpy as np

        ranks = self.ranks(h, self.most)
        size = 1
        while size <= self.largest:
            if size in self.bands:
                b = self.bands[size]
                if size == 1:
                    window = ranks[:b]
                else:
                    window = ranks[:b].copy()
                    window[:, :-1] = np.minimum(ranks[:b, :-1], ranks[:b, 1:])
                hits = np.take_along_axis(self.maps[size], (window & 65_535).astype(np.int64), axis=1)
                found = set()
                for band, w in zip(*np.nonzero(hits)):
                    for t in self.finds[size].get((int(band), int(window[band, w])), ()):
                        found.add((t, int(w)))
                for t, w in found:
                    yield t, w * size, min(len(h), (w + (1 if size == 1 else 2)) * size)
            need = max((b for s, b in self.bands.items() if s > size), default=0)
            ranks = ranks[:need]
            even = ranks[:, 0::2]
            odd = ranks[:, 1::2]
            halved = even.copy()
            halved[:, : odd.shape[1]] = np.minimum(even[:, : odd.shape[1]], odd)
            ranks = halved
            size *= 2

    def notices(self, words) -> dict[str, int]:
        """Templates of fewer than five words in a text, with their first places."""
        import numpy as np

        out: dict[str, int] = {}
        for width, (bits, found) in self.short.items():
            h = shingles_of(words, width)
            for place in np.flatnonzero(bits[(h & np.uint64(65_535)).astype(np.int64)]).tolist():
                for name in found.get(int(h[place]), ()):
                    out.setdefault(name, place)
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int]]:
        """(template, share, first word) for the templates that a text holds."""
        import numpy as np

        words = word_hashes(text, self.hashes)
        exact = spdx(text) if text and "spdx" in text.lower() else {}
        out = [(f"spdx:{name}", 1.0, place) for name, place in exact.items()]
        out += [(name, 1.0, place) for name, place in self.notices(words).items()]
        whole = shingles_of(words) if self.names else words[:0]
        up, down = SHARE
        best: dict[int, tuple[float, int]] = {}
        step = max(PIECE, 4 * self.largest) // max(1, self.largest) * max(1, self.largest)
        for at in range(0, max(1, len(whole)), step):
            h = whole[at : at + step + 2 * self.largest]
            if not len(h):
                break
            for t, a, z in self.candidates(h):
                inside = np.isin(h[a:z], self.sets[t])
                share = len(np.unique(h[a:z][inside])) / len(self.sets[t])
                if share * down >= up:
                    place = at + a + int(inside.argmax())
                    if t not in best or (-share, place) < (-best[t][0], best[t][1]):
                        best[t] = (share, place)
        return out + [(self.names[t], share, place) for t, (share, place) in sorted(best.items())]


@lru_cache(2)
def scanner_of(templates: tuple[tuple[str, str], ...]) -> Scanner:
    """One scanner for all tasks of a worker."""
    return Scanner(dict(templates))


def find_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """Rows of ``doc_id, license, share, first_word`` for all matches in all whole texts."""
    small_batches(docs.sparkSession)
    templates = tuple(sorted(templates.items()))

    def work(frames: Iterator) -> Iterator:
        import pandas as pd

        scanner = scanner_of(templates)
        for f in frames:
            rows = [(i, *m) for i, text in zip(f["doc_id"], f["text"]) for m in scanner.scan(text)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "license", "share", "first_word"])

    return map_rows(docs.select("doc_id", text_of(docs).alias("text")), work, ["doc_id"], license="string", share="double", first_word="long")
