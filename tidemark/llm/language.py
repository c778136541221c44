"""Language identification by unigram pieces, summed over all segmentations.

Each language has probabilities for the pieces of a fixed public vocabulary.  A word's
probability in a language is the sum over all ways to cut it into pieces, found by a
forward pass over the matches of an automaton; a text's is the product over its words.
Piece probabilities come from labelled training texts by expectation maximisation over
the same sums.  The score is the posterior of the predicted language with equal priors.

Training takes a bounded sample: for each language at most ``TRAIN_DOCS`` whole documents of at most ``TRAIN_CHARS`` characters together,
those with the smallest hashes of their ids, one text of each id; longer documents are not learned from.  Only rows below a bound
on the hash, which holds about twice the sample whatever the table's size, are brought
together.  Everything else sees all documents.

Defined results: texts that are null or have no letter are ``und`` with score 0, as is
every text if no language could be learned; documents without an id are not held out and
not trained on; equal posteriors go to the language first by code point; repeated rows
give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import file_bytes, map_rows, no_collector, schema, small_batches

LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
TRAIN_DOCS = 400
#: Characters of a language's training documents, together.
TRAIN_CHARS = 20_000_000
ROUNDS = 3
UNKNOWN = 1e-7
SMOOTH = 0.02
CACHE_ENTRIES = 300_000
CACHE_CHARS = 40
UND = "und"


def words(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


class Pieces:
    """The lower-case letter pieces of a vocabulary, for finding them in words."""

    def __init__(self, model_file: str | bytes):
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=file_bytes(model_file))
        names = {lib.id_to_piece(i) for i in range(lib.vocab_size()) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
        self.names = sorted(n for n in names if n == n.lower() and (n == MARK or LETTERS.fullmatch(n.removeprefix(MARK))))
        self.automaton = ahocorasick.Automaton()
        for k, n in enumerate(self.names):
            self.automaton.add_word(n, (len(n) - 1, k))
        self.automaton.make_automaton()

    def matches(self, word: str) -> list[list[tuple[int, int]]]:
        """For each end the (start, piece) that end there; -1 is a character of no piece."""
        text = MARK + word
        out: list[list[tuple[int, int]]] = [[] for _ in text]
        single = bytearray(len(text))
        for end, (back, k) in self.automaton.iter(text):
            out[end].append((end - back, k))
            if not back:
                single[end] = 1
        if 0 in single:
            for end, known in enumerate(single):
                if not known:
                    out[end].append((end, -1))
        return out


def expected(lattice: list[list[tuple[int, int]]], p: list[float]) -> Iterator[tuple[int, float]]:
    """Pieces of a word of any length with how often each is expected, by scaled passes.

    Sums are kept as mantissas with a binary exponent each, so that none underflows.
    """
    frexp, ldexp = math.frexp, math.ldexp
    size = len(lattice)

    def total(terms: list[tuple[float, int]]) -> tuple[float, int]:
        top = max((e for _, e in terms), default=0)
        m, e = frexp(sum(ldexp(x, y - top) for x, y in terms))
        return m, e + top

    ahead = [(1.0, 0)]
    for found in lattice:
        ahead.append(total([(ahead[start][0] * p[k], ahead[start][1]) for start, k in found]))
    into: list[list[tuple[float, int]]] = [[] for _ in range(size)]
    behind = [(1.0, 0)] * (size + 1)
    for end in range(size - 1, -1, -1):
        if end + 1 < size:
            behind[end + 1] = total(into[end + 1])
        b, e = behind[end + 1]
        for start, k in lattice[end]:
            into[start].append((b * p[k], e))
    whole, scale = ahead[size]
    for end, found in enumerate(lattice):
        b, e = behind[end + 1]
        for start, k in found:
            if k >= 0:
                a, f = ahead[start]
                yield k, ldexp(a * p[k] * b / whole, e + f - scale)


def learn(pieces: Pieces, counts: dict[str, int], rounds: int = ROUNDS) -> list[float]:
    """Piece probabilities from the word counts of one language, words of any length included."""
    n = len(pieces.names)
    lattices = [(pieces.matches(w), c) for w, c in counts.items() if len(w) <= CACHE_CHARS]
    long = [(pieces.matches(w), c) for w, c in counts.items() if len(w) > CACHE_CHARS]
    seen = [0.0] * n
    for lattice, c in lattices + long:
        for end, found in enumerate(lattice):
            for start, k in found:
                if k >= 0:
                    seen[k] += c * (end - start + 1)
    for _ in range(rounds):
        total = sum(seen) + SMOOTH * n
        p = [(x + SMOOTH) / total for x in seen] + [UNKNOWN]
        seen = [0.0] * n
        for lattice, c in lattices:
            size = len(lattice)
            ahead = [1.0] + [0.0] * size
            for end, found in enumerate(lattice):
                ahead[end + 1] = sum(ahead[start] * p[k] for start, k in found)
            behind = [0.0] * size + [1.0]
            for end in range(size - 1, -1, -1):
                b = behind[end + 1]
                for start, k in lattice[end]:
                    behind[start] += b * p[k]
            whole = ahead[size]
            if whole > 0:
                share = c / whole
                for end, found in enumerate(lattice):
                    b = behind[end + 1] * share
                    for start, k in found:
                        if k >= 0:
                            seen[k] += ahead[start] * p[k] * b
        for lattice, c in long:
            for k, x in expected(lattice, p):
                seen[k] += c * x
    total = sum(seen) + SMOOTH * n
    return [(x + SMOOTH) / total for x in seen]


class Scorer:
    """Log probabilities of words in all languages; short words are remembered."""

    def __init__(self, model_file: str | bytes, langs: list[str], tables: list[list[float]]):
        import numpy as np

        self.pieces = Pieces(model_file)
        self.langs = langs
        self.rows = [*zip(*tables), (UNKNOWN,) * len(langs)]
        self.each = range(len(langs))
        self.index: dict[str, int] = {}
        self.known = np.empty((CACHE_ENTRIES, len(langs)))

    def word(self, word: str) -> list[float]:
        ahead, scale = [[1.0] * len(self.langs)], [0.0] * len(self.langs)
        for end, found in enumerate(self.pieces.matches(word)):
            now = [0.0] * len(self.langs)
            for start, k in found:
                row, before = self.rows[k], ahead[start]
                for j in self.each:
                    now[j] += before[j] * row[j]
            ahead.append(now)
            if end % 16 == 15:  # keep the last positions near 1, so that long words don't vanish
                for j in self.each:
                    low = now[j]
                    scale[j] += math.log(low)
                    for earlier in ahead[-20:]:
                        earlier[j] /= low
        return [s + math.log(x) for s, x in zip(scale, ahead[-1])]

    def text(self, text: str | None):
        """Language and posterior."""
        import numpy as np

        found = words(text)
        if not self.langs or not any(c.isalpha() for w in found for c in w):  # numerals like ½ are no letters
            return UND, 0.0
        total = np.zeros(len(self.langs))
        if len(self.index) + len(found) > CACHE_ENTRIES:
            self.index.clear()
        look, at, rest = self.index, [], []
        for w in found:
            i = look.get(w)
            if i is None:
                if len(w) > CACHE_CHARS or len(look) >= CACHE_ENTRIES:
                    total += self.word(w)
                    continue
                i = look[w] = len(look)
                self.known[i] = self.word(w)
            at.append(i)
        total += self.known[at].sum(axis=0)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_counts(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> DataFrame:
    """Rows of ``lang, word, n`` over the training sample, documents that are not held out."""
    usable = docs.select(F.xxhash64("doc_id").alias("h"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held")).filter("lang is not null and text is not null and not held")
    usable = usable.filter(docs["doc_id"].isNotNull())
    near = F.lit(False)
    for lang, n in usable.groupBy("lang").agg(F.approx_count_distinct("h", 0.02)).collect():
        share = min(1.0, 2 * train_docs / max(1, n))
        near = near | ((F.col("lang") == F.lit(lang)) & (F.col("h") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))))
    found = usable.filter(near).groupBy("lang", "h").agg(F.min("text").alias("text")).withColumn("chars", F.length("text").cast("long"))
    first = Window.partitionBy("lang").orderBy("h")
    upto = F.sum("chars").over(first.rowsBetween(Window.unboundedPreceding, 0))
    sample = found.filter(F.col("chars") <= train_chars).withColumns({"place": F.row_number().over(first), "upto": upto}).filter((F.col("place") <= train_docs) & (F.col("upto") <= train_chars)).select("lang", "text")

    def count(frames: Iterator) -> Iterator:
        import pandas as pd

        found: dict[str, Counter] = {}
        for f in frames:
            for lang, text in zip(f["lang"], f["text"]):
                found.setdefault(lang, Counter()).update(words(text))
        for lang, c in found.items():
            yield pd.DataFrame({"lang": lang, "word": list(c), "n": list(c.values())})

    return sample.mapInPandas(count, schema(lang="string", word="string", n="long")).groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, model_file: str | bytes, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> tuple[list[str], list[list[float]]]:
    """Languages and their piece probabilities; each language is learned in a task of its own."""
    model = file_bytes(model_file)

    def of_language(key, f):
        import pandas as pd

        f = f.sort_values("word", kind="stable")
        return pd.DataFrame({"lang": [key[0]], "p": [learn(Pieces(model), dict(zip(f["word"], f["n"].tolist())))]})

    counts = training_counts(docs, train_docs, train_chars)
    found = counts.groupBy("lang").applyInPandas(of_language, schema(lang="string", p="array<double>")).collect()  # one row a language, one number a piece
    tables = {r["lang"]: list(r["p"]) for r in found}
    langs = sorted(tables)
    return langs, [tables[x] for x in langs]


def predict(docs: DataFrame, model_file: str) -> DataFrame:
    """Rows of ``doc_id, held_out, lang_pred, score`` for every whole text."""
    small_batches(docs.sparkSession)
    model = file_bytes(model_file)
    langs, tables = train(docs, model)

    def work(frames: Iterator) -> Iterator:
        scorer = Scorer(model, langs, tables)
        with no_collector():  # the cache holds many small objects and no cycles
            for f in frames:
                found = [scorer.text(t) for t in f["text"]]
                yield f[["doc_id", "held_out"]].assign(lang_pred=[x[0] for x in found], score=[x[1] for x in found])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return map_rows(rows, work, ["doc_id"], held_out="boolean", lang_pred="string", score="double")
