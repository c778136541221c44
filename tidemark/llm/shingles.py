"""Word shingles as sorted arrays of 64-bit hashes, for several operators.

A word is a run without white space, in lower case and without ASCII punctuation at its
ends (a word of punctuation alone stays as it is).  A text of one to four words has one
shingle, of all its words; a text without words has none.
"""

from __future__ import annotations

import string

WIDTH = 5
CACHE_ENTRIES = 500_000
PUNCTUATION = string.punctuation


class WordHashes(dict):
    """Hashes of words as they are looked up; it starts anew when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_ENTRIES:
            self.clear()
        shown = word.decode("utf-8", "replace").lower()
        found = self[word] = xxhash.xxh3_64_intdigest((shown.strip(PUNCTUATION) or shown).encode())
        return found


def mixed(x):
    """A bijective mix of 64-bit numbers (two rounds of xor-shift and multiply)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def sequence(text: str | None, hashes: WordHashes):
    """Hashes of the shingles of a text in order, repeats included."""
    import numpy as np

    words = text.encode("utf-8", "replace").split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    width = min(WIDTH, n)
    h = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        h = mixed(h + w[k : n - width + 1 + k])
    return h


def shingle_set(text: str | None, hashes: WordHashes):
    """Distinct shingle hashes of a text, sorted."""
    import numpy as np

    return np.unique(sequence(text, hashes))
