"""Toxicity by classifiers learned from confirmed toxic texts and unlabelled ones.

A text's features are its words in lower case and their beginnings of three to seven
characters, hashed; a feature's value is the logarithm of one more than its occurrences.
Learned is from a bounded sample of documents that are not held out: texts that a label
calls toxic, and texts of any kind, whose labels aren't looked at.

* Features are screened first: over the whole sample, those are kept whose shares of toxic and
  of unlabelled texts differ most, by a two-sample z statistic.
* Linear classifiers are trained in numpy, each in a task of its own on its own part of the sample, by the
  non-negative risk estimator: with the class prior p, the risk of unlabelled texts as
  clean, less p times that of toxic ones as clean, is the risk of the clean ones; where it
  falls below zero, steps go the other way until it isn't.  The last half of the
  weights' path is averaged.
* The score of a whole text is the logistic function of the classifiers' mean.

Bounds: ``POSITIVES`` and ``UNLABELLED`` documents for each of ``MEMBERS`` classifiers, those with the
smallest hashes of their ids, and ``KEPT`` features; all texts are scored.  The class prior is the share of toxic ones among
the labelled documents that aren't held out, unless it is given.

Defined results: null and empty texts are scored, as texts without features; an id with
several labels is toxic if one says so, and one of its texts is learned from; labels without a document and
values other than 0 and 1 are ignored; documents without an id aren't held out and aren't learned from;
without a toxic example nothing is learned and all scores are 0; repeated rows give repeated results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_rows, schema, small_batches, text_of

MEMBERS = 3
POSITIVES, UNLABELLED = 1_000, 3_000
BITS = 18
KEPT = 4_096
#: Kept features are in so many toxic texts, and differ by so many standard errors.
LEAST_TEXTS, LEAST_Z = 3, 4.0
STEPS, RATE, RIDGE = 300, 0.05, 1e-5
SURE = 0.7
WORDS = re.compile(r"\w+")
BEGINNINGS = range(3, 8)
CACHE_ENTRIES, CACHE_CHARS = 300_000, 64


def word_features(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    names = {f"={word}", *(f"^{word[:k]}" for k in BEGINNINGS if k < len(word))}
    return sorted({zlib.crc32(n.encode("utf-8", "replace")) >> (32 - BITS) for n in names})


class Known(dict):
    """Features of words as they are looked up, by their places in ``kept`` if given; it starts anew when full."""

    def __init__(self, kept: list[int] | None = None):
        self.place = None if kept is None else {f: k for k, f in enumerate(kept)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(word_features(word))
        if self.place is not None:
            found = tuple(self.place[f] for f in found if f in self.place)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = found
        return found

    def counts(self, text: str | None) -> dict[int, int]:
        """Occurrences of the features of a text."""
        out: dict[int, int] = {}
        for word, n in Counter(WORDS.findall(text.lower())).items() if text else ():
            for f in self[word]:
                out[f] = out.get(f, 0) + n
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def confirmed(labels: DataFrame) -> DataFrame:
    """Rows of ``tm_id, tm_toxic`` for ids with a label that aren't held out."""
    rows = labels.select(F.col("doc_id").alias("tm_id"), F.col("toxic").cast("int").alias("tm_toxic"))
    return rows.filter("tm_id is not null and tm_toxic in (0, 1)").filter(~held_out(F.col("tm_id"))).groupBy("tm_id").agg(F.max("tm_toxic").alias("tm_toxic"))


def dealt(ids: DataFrame, each: int, members: int, toxic: bool) -> DataFrame:
    """At most ``each`` of the distinct ``tm_id`` for each member, those with the smallest hashes."""
    salt = F.lit("toxic" if toxic else "unlabelled")
    rows = ids.select("tm_id", F.xxhash64(F.col("tm_id").cast("string"), salt).alias("h"))
    n = rows.agg(F.approx_count_distinct("h", 0.02)).first()[0]
    # Only about twice the sample is brought together, whatever the table's size.
    share = min(1.0, 2 * each * members / max(1, n))
    near = rows.filter(F.col("h") <= min(2**63 - 1, int(share * 2**64) - 2**63)).distinct()
    member = near.withColumn("member", F.pmod(F.xxhash64("h"), F.lit(members)).cast("int"))
    place = F.row_number().over(Window.partitionBy("member").orderBy("h", "tm_id"))
    return member.withColumn("place", place).filter(F.col("place") <= each).select("tm_id", "member", F.lit(toxic).alias("toxic"))


def training_texts(docs: DataFrame, known: DataFrame, members: int = MEMBERS, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """Rows of ``tm_id, member, toxic, text``: the sample, one text of each id."""
    usable = docs.select(F.col("doc_id").alias("tm_id"), F.col("text").cast("string").alias("text")).filter("tm_id is not null and text is not null").filter(~held_out(F.col("tm_id")))
    ids = usable.select("tm_id")
    toxic = known.filter("tm_toxic = 1").select("tm_id").join(ids, "tm_id", "left_semi")
    chosen = dealt(toxic, positives, members, True).unionByName(dealt(ids, unlabelled, members, False))
    # At most members * (positives + unlabelled) rows.
    texts = usable.join(F.broadcast(chosen), "tm_id").groupBy("tm_id", "member", "toxic").agg(F.min("text").alias("text"))
    return cut(texts, "toxicity-sample")


def screened(texts: DataFrame, kept: int = KEPT) -> list[int]:
    """The features whose shares of toxic and of unlabelled texts differ most."""

    def work(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        known, found = Known(), np.zeros((2, 1 << BITS), dtype=np.int64)
        for f in frames:
            for toxic, text in zip(f["toxic"], f["text"]):
                at = np.fromiter(known.counts(text), dtype=np.int64)
                found[int(toxic), at] += 1
        at = np.flatnonzero(found.any(axis=0))
        yield pd.DataFrame({"feature": at, "unlabelled": found[0, at], "toxic": found[1, at]})

    n = dict(texts.groupBy("toxic").count().collect())
    p, u = float(n.get(True, 0)), float(n.get(False, 0))
    if not p or not u:
        return []
    counts = texts.select("toxic", "text").mapInPandas(work, schema(feature="long", unlabelled="long", toxic="long")).groupBy("feature").agg(F.sum("unlabelled").alias("a"), F.sum("toxic").alias("b"))
    both = (F.col("a") + F.col("b")) / F.lit(p + u)
    z = (F.col("b") / F.lit(p) - F.col("a") / F.lit(u)) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-12)) * F.lit(1 / p + 1 / u))
    best = counts.withColumn("z", F.abs(z)).filter((F.col("b") >= LEAST_TEXTS) & (F.col("z") >= LEAST_Z)).orderBy(F.col("z").desc(), "feature").limit(kept)
    return sorted(r["feature"] for r in best.collect())


class Texts:
    """Sparse feature values of texts."""

    def __init__(self, places: list, values: list):
        import numpy as np

        self.ends = np.cumsum([0, *map(len, places)])
        self.n = len(places)
        self.place = np.concatenate([np.asarray(p, dtype=np.int64) for p in places]) if self.n else np.empty(0, dtype=np.int64)
        self.value = np.concatenate([np.asarray(v, dtype=np.float64) for v in values]) if self.n else np.empty(0)
        self.owner = np.repeat(np.arange(self.n), np.diff(self.ends))

    def scores(self, weights, bias: float):
        import numpy as np

        return np.bincount(self.owner, weights=weights[self.place] * self.value, minlength=self.n) + bias

    def pull(self, by, size: int):
        """The sum of the texts' values, each text times ``by``."""
        import numpy as np

        return np.bincount(self.place, weights=self.value * by[self.owner], minlength=size)


def logistic(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def risk(toxic, unlabelled, prior: float) -> tuple[float, float]:
    """The risks of toxic and of clean texts from the scores of toxic and unlabelled ones (logistic loss)."""
    import numpy as np

    return prior * float(np.logaddexp(0, -toxic).mean()), float(np.logaddexp(0, unlabelled).mean()) - prior * float(np.logaddexp(0, toxic).mean())


def fit(toxic: Texts, unlabelled: Texts, size: int, prior: float, steps: int = STEPS):
    """Weights of the features, and last the bias."""
    import math

    import numpy as np

    w = np.zeros(size + 1)
    w[-1] = math.log(prior / (1 - prior))
    mean, square, path = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        g, h = toxic.scores(w[:-1], w[-1]), unlabelled.scores(w[:-1], w[-1])
        _, clean = risk(g, h, prior)
        by_toxic, by_unlabelled = -prior * logistic(g) / toxic.n, logistic(h) / unlabelled.n
        if clean >= 0:
            by_toxic = by_toxic - prior * logistic(-g) / toxic.n
        else:
            by_toxic, by_unlabelled = -by_toxic, -by_unlabelled
        slope = np.append(toxic.pull(by_toxic, size) + unlabelled.pull(by_unlabelled, size) + RIDGE * w[:-1], by_toxic.sum() + by_unlabelled.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope * slope
        w = w - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        if 2 * step > steps:
            path += w
    return path / max(1, steps - steps // 2)


def learn(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> tuple[list[int], list[float]] | None:
    """Kept features and their weights, the bias last; None without a toxic example."""
    known = confirmed(labels)
    if prior is None:
        share = known.agg(F.avg("tm_toxic")).first()[0]
        if not share:
            return None
        prior = min(0.9, max(0.001, share))
    texts = training_texts(docs, known)
    kept = screened(texts)
    if not kept:
        return None

    def places(frames: Iterator) -> Iterator:
        import math

        known = Known(kept)
        for f in frames:
            found = [sorted(known.counts(t).items()) for t in f["text"]]
            yield f[["tm_id", "member", "toxic"]].assign(place=[[k for k, _ in x] for x in found], value=[[math.log1p(n) for _, n in x] for x in found])

    def train(key, f):
        import pandas as pd

        f = f.sort_values("tm_id", kind="stable")
        toxic, rest = (Texts(list(p["place"]), list(p["value"])) for p in (f[f["toxic"]], f[~f["toxic"]]))
        return pd.DataFrame({"member": [key[0]], "weights": [fit(toxic, rest, len(kept), prior)]}) if toxic.n and rest.n else pd.DataFrame({"member": [], "weights": []})

    rows = map_rows(texts, places, ["tm_id", "member", "toxic"], place="array<int>", value="array<double>").withColumn("tm_id", F.col("tm_id").cast("string"))
    found = rows.groupBy("member").applyInPandas(train, schema(member="int", weights="array<double>")).orderBy("member").collect()  # MEMBERS rows of KEPT numbers
    return (kept, [sum(w) / len(found) for w in zip(*(r["weights"] for r in found))]) if found else None


def score(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> DataFrame:
    """Rows of ``doc_id, held_out, score, predicted`` for every whole text."""
    small_batches(docs.sparkSession)
    learned = learn(docs, labels, prior)

    def work(frames: Iterator) -> Iterator:
        import math

        known, (*weights, bias) = Known(learned[0]), learned[1]
        for f in frames:
            sums = [bias + sum(weights[k] * math.log1p(n) for k, n in sorted(known.counts(t).items())) for t in f["text"]]
            yield f[["doc_id"]].assign(score=[1 / (1 + math.exp(-max(-40.0, min(40.0, x)))) for x in sums])

    rows = docs.select("doc_id", text_of(docs).alias("text"))
    scored = map_rows(rows, work, ["doc_id"], score="double") if learned else rows.select("doc_id", F.lit(0.0).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= SURE).cast("int").alias("predicted"))
