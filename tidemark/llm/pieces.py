"""SentencePiece merge-type (BPE) encoding and decoding by backtracking.

The vocabulary file is read with the public library; encoding and decoding are done
here.  A sequence of pieces is the encoding of a text exactly if every two adjacent
pieces are *compatible*: merging the characters of the two, best piece first, ends in
these two pieces again.  So no merge queue over the text is needed.  The encoder takes
at each position the longest piece that an Aho-Corasick automaton found to start there
and that is compatible with the piece before; where none is, it goes back, and a bit
field remembers positions from which no way leads on.

Exact shortcuts, checked against the vocabulary when it is loaded:

* no piece holds a space mark after another character, so a text splits before runs of
  space marks,
* it also splits between a letter and a mark that no piece holds after a letter,
* a character that no piece holds never merges; it becomes bytes and splits the text.

Defined results: null and empty texts have no pieces, only the end id; the space mark
U+2581 in a text counts as a space, as in the library; lone surrogates can't come from
a Spark string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import file_bytes, map_rows, no_collector, small_batches, text_of

#: Cached encodings of short stretches in a worker: two generations of so many entries.
CACHE_ENTRIES = 250_000
CACHE_CHARS = 48
FITS_ENTRIES = 1_000_000
NONE = float("-inf")
MARK = "▁"


class PieceCodec:
    """Encoder and decoder for one merge-type vocabulary with bytes for unknown characters."""

    def __init__(self, model_file: str | bytes):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=file_bytes(model_file))
        n = lib.vocab_size()
        self.eos = lib.eos_id()
        self.names = [lib.id_to_piece(i) for i in range(n)]
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []
        for i, name in enumerate(self.names):
            if lib.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value] = i
                self.raw.append(bytes([value]))
            elif lib.is_control(i) or lib.is_unknown(i):
                self.raw.append(b"" if lib.is_control(i) else b" \xe2\x81\x87 ")
            else:
                self.ids[name] = i
                self.rank[name] = lib.get_score(i)
                self.raw.append(name.replace(MARK, " ").encode())
        singles = {c for name in self.ids for c in name}
        if any(MARK in name.lstrip(MARK) for name in self.ids) or any(c not in self.ids for c in singles):
            raise ValueError("this vocabulary has pieces that the exact splits do not allow for")
        self.singles = singles
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.automaton.add_word(name, (len(name) - 1, i))
        self.automaton.make_automaton()
        self.size = [len(name) for name in self.names]
        #: For each piece the longest piece that is a proper prefix of it, or -1.
        self.shorter = [-1] * n
        for name, i in self.ids.items():
            self.shorter[i] = next((self.ids[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in self.ids), -1)
        after_letter = {b for name in self.ids for a, b in zip(name, name[1:]) if a.isalpha()}
        marks = "".join(re.escape(c) for c in sorted(singles - after_letter - {MARK}) if not c.isalpha())
        line = "" if "\n" in singles else "\n"
        self.split = re.compile(f"{MARK}*[{marks}]*[^{MARK}{marks}{line}]+|{MARK}*[{marks}]+|{MARK}+" + "|\n" * bool(line))
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.cache: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def merge(self, text: str) -> list[str]:
        """Merge the characters of a short text, best piece first, the left one of equals."""
        parts = list(text)
        rank = self.rank.get
        scores = [rank(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > NONE:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = rank(parts[at - 1] + parts[at], NONE)
            if at < len(scores):
                scores[at] = rank(parts[at] + parts[at + 1], NONE)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether two adjacent pieces stay as they are when their characters are merged anew."""
        a, b = self.names[left], self.names[right]
        if len(self.fits) > FITS_ENTRIES:
            self.fits.clear()
        found = self.fits[left << 20 | right] = self.merge(a + b) == [a, b]
        return found

    def is_whole(self, piece: int) -> bool:
        """Whether the characters of a piece merge to that piece alone."""
        found = self.whole.get(piece)
        if found is None:
            found = self.whole[piece] = self.merge(self.names[piece]) == [self.names[piece]]
        return found

    def _known(self, text: str) -> list[int]:
        """Backtracking over a text of known characters only."""
        n = len(text)
        longest = [0] * n
        for end, (back, i) in self.automaton.iter(text):  # of one start, longer ones come later
            longest[end - back] = i
        piece, size, shorter, fits = longest[0], self.size, self.shorter, self.fits
        if size[piece] == n:
            if self.is_whole(piece):
                return [piece]
            piece = shorter[piece]
        failed = bytearray(n + 1)
        out: list[int] = []
        pos, prior = 0, -1
        while True:
            while piece >= 0:
                end = pos + size[piece]
                if not failed[end]:
                    if prior < 0:
                        break
                    fit = fits.get(prior << 20 | piece)
                    if fit or fit is None and self.compatible(prior, piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                if end == n:
                    return out
                pos, prior, piece = end, piece, longest[end]
            else:
                failed[pos] = 1
                if not out:
                    raise ValueError("no compatible sequence of pieces")
                piece = out.pop()
                pos -= size[piece]
                prior = out[-1] if out else -1
                piece = shorter[piece]

    def _stretch(self, text: str) -> list[int]:
        if self.singles.issuperset(text):
            return self._known(text)
        out: list[int] = []
        at = 0
        for k, c in enumerate(text):
            if c not in self.singles:
                if k > at:
                    out += self._known(text[at:k])
                out += [self.byte_ids[b] for b in c.encode("utf-8", "replace")]
                at = k + 1
        return out + self._known(text[at:]) if at < len(text) else out

    def stretch(self, text: str) -> list[int]:
        """Ids of a stretch between exact splits, from the cache if it is short."""
        found = self.older.get(text)
        if found is None:
            found = self._stretch(text)
        if len(text) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.older, self.cache = self.cache, {}
            self.cache[text] = found
        return found

    def encode(self, text: str | None, end: bool = True) -> list[int]:
        """Ids of a whole text, with the end id if ``end``."""
        out: list[int] = []
        if text:
            look, make = self.cache.get, self.stretch
            for part in self.split.findall(MARK + text.replace(" ", MARK)):
                out += look(part) or make(part)
        return [*out, self.eos] if end else out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids are silent, the first space goes, broken bytes show as U+FFFD."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode_documents(docs: DataFrame, model_file: str, end: bool = True) -> DataFrame:
    """Rows of ``doc_id, ids array<int>, decoded string`` for every whole text."""
    small_batches(docs.sparkSession)
    model = file_bytes(model_file)

    def work(frames: Iterator) -> Iterator:
        codec = PieceCodec(model)
        with no_collector():  # the caches hold many small lists and no cycles
            for f in frames:
                ids = [codec.encode(t, end) for t in f["text"]]
                yield f[["doc_id"]].assign(ids=ids, decoded=[codec.decode(x) for x in ids])

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    return map_rows(rows, work, ["doc_id"], ids="array<int>", decoded="string")


def digest_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """Per document the number of ids with the end id, and digests of the ids and of the decoded text.

    Null and empty texts encode to the end id alone; repeated rows give repeated results.
    """
    small_batches(docs.sparkSession)
    model = file_bytes(model_file)

    def work(frames: Iterator) -> Iterator:
        codec = PieceCodec(model)
        shown = [str(i) for i in range(len(codec.names))]
        sha = hashlib.sha256
        with no_collector():  # the caches hold many small lists and no cycles
            for f in frames:
                n, a, b = [], [], []
                for text in f["text"]:
                    ids = codec.encode(text)
                    n.append(len(ids))
                    a.append(sha(" ".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                    b.append(sha(codec.decode(ids).encode()).hexdigest())
                yield f[["doc_id"]].assign(n_tokens=n, ids_sha256=a, decoded_sha256=b)

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    return map_rows(rows, work, ["doc_id"], n_tokens="long", ids_sha256="string", decoded_sha256="string")
