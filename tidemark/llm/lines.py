"""Dropping lines that repeat across documents, with DataFrame functions only.

Lines are exploded with their positions, their keys hashed (128 bits), and per hash the
smallest and the largest document are kept; a key is found in two documents if they
differ.  A join with the repeated keys alone gives the positions each document loses,
and the text is put together again from the stretches between lost positions.

A hot line costs one partial row per task when counted.  In the join with the repeated
keys it has one row on the other side, so its many rows can be split over tasks.

Defined results: null and empty texts are one empty line; rows with the same document
id are the same document when documents are counted, and rows without an id together
are one more document, which comes last; a document whose lines all go keeps an empty
text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, free_name, packed, text_of, unpacked

MIN_CHARS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEW_LINE = "\n"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.trim(line, F.lit(SPACE_CHARS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def split_lines(text: Column) -> Column:
    return F.split(text, NEW_LINE, -1)


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows of ``doc_id, mark, pos, h1, h2`` for lines whose key is long enough; ``mark`` is a hash of the text."""
    text = text_of(docs)
    lines = docs.select("doc_id", F.xxhash64(text).alias("mark"), F.posexplode(split_lines(text)).alias("pos", "line"))
    keys = lines.select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"))


def repeated_keys(lines: DataFrame) -> DataFrame:
    """Hashes found in two documents or more, with the smallest document as ``keeper``."""
    found = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("nameless"))
    return found.filter((F.col("keeper") != F.col("last")) | (F.col("nameless") & F.col("keeper").isNotNull())).select("h1", "h2", "keeper")


def lost_positions(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows of ``doc_id, mark, lost`` with the sorted positions of the lines that a document loses."""
    lines = keyed_lines(docs, min_chars)
    # As a table of its own, so that a hot key's rows on the other side can be split over tasks.
    repeated = cut(repeated_keys(lines), "lines-repeated")
    hits = lines.join(repeated, ["h1", "h2"]).filter(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("keeper")))
    return hits.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("lost"))


def _without(text: Column, lost: Column) -> Column:
    """The text without the lines at sorted positions, in time proportional to its length."""

    def rest(lines: Column) -> Column:
        edges = F.concat(F.array(F.lit(-1)), lost, F.array(F.size(lines)))
        gap = F.sequence(F.lit(1), F.size(lost) + 1)
        kept = F.transform(F.array(edges), lambda e: F.flatten(F.transform(gap, lambda i: F.slice(lines, F.get(e, i - 1) + 2, F.get(e, i) - F.get(e, i - 1) - 1))))
        return F.concat_ws(NEW_LINE, F.get(kept, F.lit(0)))

    return F.get(F.transform(F.array(split_lines(text)), rest), F.lit(0))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with all its columns, ``text`` without repeated lines, and ``tm_n_lines``, ``tm_n_dropped``.

    The two counts get underscores at their ends where ``docs`` has such columns.
    """
    lost = lost_positions(docs.select("doc_id", "text"), min_chars).select(F.col("doc_id").alias("tm_id"), F.col("mark").alias("tm_mark"), F.col("lost").alias("tm_lost"))
    own = packed(docs, "doc_id", "text")
    joined = own.join(lost, own["doc_id"].eqNullSafe(lost["tm_id"]) & (F.xxhash64(text_of(own)) == lost["tm_mark"]), "left")
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = F.when(F.col("tm_lost").isNull(), F.col("text")).otherwise(_without(whole, F.col("tm_lost")))
    counts = {"tm_n_lines": F.size(split_lines(whole)).cast("long"), "tm_n_dropped": F.coalesce(F.size("tm_lost"), F.lit(0)).cast("long")}
    columns = [kept.alias("text") if c == "text" else v for c, v in zip(docs.columns, unpacked(docs.columns, "doc_id", "text"))]
    return joined.select(*columns, *[v.alias(free_name(docs.columns, k)) for k, v in counts.items()])


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document ``n_lines`` before, ``n_dropped``, and the SHA-256 of the kept text."""
    kept = drop_repeated_lines(docs.select("doc_id", "text"), min_chars)
    return kept.select("doc_id", F.col("tm_n_lines").alias("n_lines"), F.greatest(F.col("tm_n_dropped"), F.lit(0)).alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
seen AS (
  SELECT k, min(doc_id) AS keeper, count(DISTINCT doc_id) AS n FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT keyed.*, coalesce(n >= 2 AND doc_id <> keeper, false) AS lost FROM keyed LEFT JOIN seen USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
