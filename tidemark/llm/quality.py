"""Quality rules with risk-controlled thresholds.

Each document gets five rates (symbols and exclamation marks per word, shares of repeated
lines, of words in repeated three-word windows, and of capitals).  Divided by fixed
units, the largest of them is its badness, and a cutoff on badness rejects.  Cutoffs are
chosen per stratum (the value of ``lang``) from labelled documents:

* all labelled documents that pass the base rule are counted by stratum, label and the
  cutoffs that would reject them,
* cutoffs are tested from the gentlest on, in fixed order, until one fails.  The test is
  exact: a cutoff passes if a binomial with the allowed rate of false rejections would
  give so few rejected good documents with probability at most ``RISK / strata``.  Fixed
  order needs no further correction inside a stratum, the division corrects for strata,
* of the cutoffs that passed, the one with the best share of bad documents caught minus
  good ones lost is used, the gentler one of equals.

With probability 1 - RISK, no stratum loses more than ALLOWED of its good documents to
these cutoffs.  A stratum with too few labels gets no cutoff and loses none.

Defined results: null and empty texts have no words and fail the base rule; a null
``lang`` is a stratum of its own; labels without a quality or without a document are
ignored; an id counts once in a stratum, however many labels and rows have it: as good if
any label says so, with the worst of its rows' badness; repeated rows are judged each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, map_rows, packed, small_batches, text_of, unpacked, words_of

MIN_WORDS = 50
#: Units of the five rates: symbols, repeated lines, repeated windows, capitals, exclamation marks.
UNITS = (0.1, 0.3, 0.2, 0.3, 0.1)
#: Cutoffs of badness, gentlest first.
CUTOFFS = tuple(8.0 * 2.0 ** (-k / 4) for k in range(32))
ALLOWED = 0.01
RISK = 0.05
SYMBOLS = "#*$%&|<>"


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that a text holds twice or more, the first included."""
    import numpy as np

    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    m = len(seen)
    pairs = ids[:-1] * m + ids[1:]
    if m >= 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    code = pairs[:-1] * m + ids[2:]
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    mark = np.zeros(n, dtype=bool)
    mark[:-2] |= again
    mark[1:-1] |= again
    mark[2:] |= again
    return int(mark.sum())


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    seen: set[str] = set()
    full = again = 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
            full += 1
        elif line.strip(SPACE_CHARS):
            seen.add(line)
            full += 1
    return again, full


def measures(text: str | None) -> tuple[int, int, int, int, int, bool, float]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, badness`` of a text."""
    import numpy as np

    text = text or ""
    words = words_of(text)
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, True, 0.0
    chars = len(text) - sum(map(text.count, SPACE_CHARS))
    symbols = sum(map(text.count, SYMBOLS))
    dup, lines = repeated_lines(text)
    repeats = repeated_words(words)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    capitals = int(((points >= 0x41) & (points <= 0x5A)).sum() + ((points >= 0xC0) & (points <= 0xDE)).sum())
    rates = (symbols / n, dup / max(1, lines), repeats / n, capitals / max(1, chars), text.count("!") / n)
    return n, chars, symbols, dup, repeats, n < MIN_WORDS or 100 * repeats > 50 * n, max(r / u for r, u in zip(rates, UNITS))


FIELDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "badness": "double"}


def measured(docs: DataFrame) -> DataFrame:
    """Rows of ``doc_id, lang`` and the measures of every whole text."""
    small_batches(docs.sparkSession)

    def work(frames: Iterator) -> Iterator:
        for f in frames:
            found = list(zip(*map(measures, f["text"]))) or [[]] * len(FIELDS)
            yield f[["doc_id", "lang"]].assign(**dict(zip(FIELDS, map(list, found))))

    return map_rows(docs.select("doc_id", "lang", text_of(docs).alias("text")), work, ["doc_id", "lang"], **FIELDS)


def binomial_at_most(x: int, n: int, p: float) -> float:
    """Probability of at most ``x`` of ``n``, as a regularised incomplete beta function (continued fraction)."""
    if x >= n:
        return 1.0
    a, b, z = n - x, x + 1, 1 - p
    if z > (a + 1) / (a + b + 2):
        return 1 - _beta_part(b, a, p)
    return _beta_part(a, b, z)


def _beta_part(a: float, b: float, z: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(z) + b * math.log1p(-z)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * z / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 10_000):
        even = m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return front * out


def choose(counts: dict, allowed: float = ALLOWED, risk: float = RISK) -> dict:
    """Cutoff per stratum from ``{stratum: (good by cutoffs, bad by cutoffs)}``; None where none is safe.

    The lists count documents by the number of cutoffs, from the gentlest, that spare them.
    """
    out = {}
    for stratum, (good, bad) in counts.items():
        n, m = sum(good), sum(bad)
        best, at = 0.0, None
        lost = caught = 0
        for k, cutoff in enumerate(CUTOFFS):
            lost, caught = lost + good[k], caught + bad[k]
            if not n or binomial_at_most(lost, n, allowed) > risk / len(counts):
                break
            gain = caught / max(1, m) - lost / n
            if gain > best + 1e-12:
                best, at = gain, cutoff
        out[stratum] = at
    return out


def fit(rates: DataFrame, labels: DataFrame, allowed: float = ALLOWED, risk: float = RISK) -> dict:
    """Cutoffs per stratum from all labelled documents."""
    spared = sum((F.when(F.col("badness") <= c, 1).otherwise(0) for c in CUTOFFS), F.lit(0))
    known = labels.select(F.col("doc_id").alias("tm_id"), F.col("quality").cast("int").alias("tm_good")).filter("tm_good in (0, 1)")
    known = known.groupBy("tm_id").agg(F.max("tm_good").alias("tm_good"))
    worst = rates.filter(~F.col("base_failed")).groupBy("doc_id", "lang").agg(F.max("badness").alias("badness"))
    joined = worst.join(known, F.col("doc_id") == F.col("tm_id"))
    counts: dict = {}
    for lang, good, k, n in joined.groupBy("lang", "tm_good", spared.alias("k")).count().collect():
        counts.setdefault(lang, ([0] * (len(CUTOFFS) + 1), [0] * (len(CUTOFFS) + 1)))[0 if good else 1][k] += n
    return choose(counts, allowed, risk)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document the base measures, ``base_failed``, ``kept``, ``badness`` and the ``cutoff`` in use."""
    rates = cut(measured(docs), "quality")
    cutoffs = fit(rates, labels)
    kind = docs.schema["lang"].dataType
    at = F.lit(None).cast("double")
    for lang, cutoff in cutoffs.items():
        if cutoff is not None:
            at = F.when(F.col("lang").eqNullSafe(F.lit(lang).cast(kind)), cutoff).otherwise(at)
    judged = rates.withColumn("cutoff", at)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("cutoff").isNull() | (F.col("badness") <= F.col("cutoff")))).alias("kept"), "badness", "cutoff")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    cutoffs = fit(cut(measured(docs), "quality"), labels)
    small_batches(docs.sparkSession)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            keep = []
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                *_, failed, badness = measures(text)
                cutoff = cutoffs.get(lang)
                keep.append(not failed and (cutoff is None or badness <= cutoff))
            yield b.filter(pa.array(keep, pa.bool_()))

    rows = packed(docs, "text", "lang")
    return rows.mapInArrow(work, rows.schema).select(*unpacked(docs.columns, "text", "lang"))
