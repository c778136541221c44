"""Printed labels to keys: equal, by their first words, or by a similar alias, found through an index of q-grams.

The similarity is twice the number of matched characters over the characters of both
texts, where the longest common part is matched first and then, in turn, what lies left and
right of it.  It is computed for survivors only:

* matched characters lie in at most one block more than there are unmatched characters, and
  a block of L characters has L - q + 1 q-grams.  So two texts that are similar enough share
  a number of q-grams that follows from their lengths; q is chosen for each alias so that it is one at least,
* q-grams are put in one order, rarest in the aliases first.  Texts that share ``o`` of
  their ``n`` q-grams share one of the first ``n - o + 1`` of both, so only these are joined,
* pairs whose lengths or whose counts of equal characters can't be enough go.

Nothing is cut off: every pair that is similar enough is found.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clean_label, normalised
from .lookups import lookup

#: Least similarity of a label and an alias, and least length of a label for it.
FUZZY, LEAST_CHARS = 0.86, 5
LONGEST_GRAM = 3


def similarity(a: Column, b: Column) -> Column:
    """Share of matched characters of two texts, null if one is null; for distinct pairs that bounds leave over."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return F.pandas_udf(ratio, "double")(a, b)


def least_total(n: Column, cutoff: float) -> Column:
    """The least length of two similar texts together, of which one has ``n`` characters."""
    return F.lit(2.0) * n / (2 - cutoff)


def gram_slope(q: int, cutoff: float) -> float:
    """How the least number of shared q-grams grows with the length of both texts, beyond ``1 - q`` at 0."""
    return cutoff / 2 - (1 - cutoff) * (q - 1)


def gram_length(n: Column, cutoff: float) -> Column:
    """The longest grams of which all texts similar to one of ``n`` characters share one; 1 is always right."""
    out = F.lit(1)
    for q in range(2, LONGEST_GRAM + 1):
        if gram_slope(q, cutoff) > 0:
            out = F.when(least_total(n, cutoff) * gram_slope(q, cutoff) >= q + 1e-6, q).otherwise(out)
    return out


def shared_grams(n: Column, q: Column, cutoff: float) -> Column:
    """The least number of shared grams, for the shortest partner."""
    slope = F.lit(0.0)
    for k in range(1, LONGEST_GRAM + 1):
        slope = F.when(q == k, gram_slope(k, cutoff)).otherwise(slope)
    return F.greatest(F.lit(1), F.ceil(least_total(n, cutoff) * slope - (q - 1) - 1e-6)).cast("int")


def all_grams(texts: DataFrame) -> DataFrame:
    """Rows of ``text, n, q, gram`` for texts of ``text, n, q``; a gram that a text holds again is another gram, with its number."""
    at = F.sequence(F.lit(1), F.greatest(F.col("n") - F.col("q") + 1, F.lit(1)))
    each = texts.filter(F.col("n") >= F.col("q")).select("text", "n", "q", F.explode(F.transform(at, lambda i: F.substring("text", i, F.col("q")))).alias("part"))
    counted = each.groupBy("text", "n", "q", "part").agg(F.count("*").alias("times"))
    return counted.select("text", "n", "q", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("times")), lambda k: F.concat(F.col("part"), F.lit("#"), k.cast("string")))).alias("gram"))


def first_grams(texts: DataFrame, df: DataFrame, cutoff: float) -> DataFrame:
    """Rows of ``text, n, q, gram`` with the rarest grams of each text, by ``df`` (``gram, q, df``), as many as similar texts share one of."""
    ranked = all_grams(texts).join(df, ["gram", "q"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("text", "q").orderBy("df", "gram"))
    least = F.col("n") - F.col("q") + 1 - shared_grams(F.col("n"), F.col("q"), cutoff) + 1
    return ranked.withColumn("place", place).filter(F.col("place") <= least).select("text", "n", "q", "gram")


def gram_counts(grams: DataFrame) -> DataFrame:
    return grams.groupBy("gram", "q").agg(F.count("*").alias("df"))


def common_chars(a: Column, b: Column) -> Column:
    """Characters that two texts have in common, each as often as both hold it."""
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.regexp_extract_all(a, F.lit("(?s)."), F.lit(0))), F.lit(0), lambda s, c: s + F.least(times(a, c), times(b, c)))


def similar_pairs(one: DataFrame, other: DataFrame, cutoff: float = FUZZY) -> DataFrame:
    """Rows of ``a, b, ratio`` with all pairs of distinct texts of ``one`` (column ``a``) and ``other`` (``b``) of at least ``cutoff``.

    ``one``, the smaller side, is indexed.  Texts without characters are similar to none.
    """
    known = one.select(F.col("a").alias("text")).filter("length(text) > 0").distinct().withColumn("n", F.length("text"))
    known = known.withColumn("q", gram_length(F.col("n"), cutoff))
    df = gram_counts(all_grams(known))
    index = first_grams(known, df, cutoff).select(F.col("text").alias("a"), "n", "q", "gram")
    asked = other.select(F.col("b").alias("text")).filter("length(text) > 0").distinct().withColumn("n", F.length("text"))
    asked = asked.withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(LONGEST_GRAM))))
    asked = first_grams(asked, df, cutoff).select(F.col("text").alias("b"), F.col("n").alias("m"), "q", "gram")
    total = F.col("n") + F.col("m")
    pairs = asked.join(index, ["q", "gram"]).filter(2.0 * F.least("n", "m") / total >= cutoff).select("a", "b", total.alias("total")).distinct()
    pairs = pairs.filter(2.0 * common_chars(F.col("a"), F.col("b")) / F.col("total") >= cutoff)
    return pairs.select("a", "b", similarity(F.col("a"), F.col("b")).alias("ratio")).filter(F.col("ratio") >= cutoff)


def match_labels(labels: DataFrame, aliases: DataFrame, fuzzy: bool = True, cutoff: float = FUZZY) -> DataFrame:
    """Distinct labels with ``key`` and ``match``: exact, longest first words (prefix), a similar alias (fuzzy), or none.

    ``aliases``: ``alias_norm, key``, one row an alias.  Of equally similar aliases the last by code point counts.
    """
    d = labels.select("label").distinct().withColumn("words", F.filter(F.split(clean_label(F.col("label")), r"\s+"), lambda x: x != ""))
    n = F.size("words")
    tries = F.transform(F.sequence(n, F.when(n > 0, 1).otherwise(n), F.when(n > 0, -1).otherwise(1)), lambda k: F.struct(k.alias("k"), normalised(F.array_join(F.slice(F.col("words"), 1, k), " ")).alias("alias_norm")))
    each = d.filter(n > 0).select("label", n.alias("n"), F.inline(tries))
    best = lookup(each, aliases, "alias_norm", "inner").groupBy("label").agg(F.max_by(F.struct("key", "k", "n"), "k").alias("b"))
    found = best.select("label", "b.key", F.when(F.col("b.k") == F.col("b.n"), "exact").otherwise("prefix").alias("match"))
    rest = d.join(found, "label", "left_anti").select("label")
    if fuzzy:
        asked = rest.withColumn("a", normalised(clean_label(F.col("label"))))
        long = asked.filter(F.length("a") >= LEAST_CHARS)
        # The alias is the first text of the pair: which of two equal parts is matched first depends on it.
        pairs = similar_pairs(aliases.select(F.col("alias_norm").alias("a")), long.select(F.col("a").alias("b")), cutoff)
        near = pairs.groupBy(F.col("b").alias("asked")).agg(F.max(F.struct("ratio", "a")).alias("p")).select("asked", F.col("p.a").alias("alias_norm"))
        near = lookup(near, aliases, "alias_norm", "inner").select(F.col("asked").alias("a"), "key")
        found = found.unionByName(asked.join(near, "a").select("label", "key", F.lit("fuzzy").alias("match")))
        rest = rest.join(found, "label", "left_anti")
    return found.unionByName(rest.select("label", F.lit(None).cast("string").alias("key"), F.lit("none").alias("match")))
