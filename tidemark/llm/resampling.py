"""Importance resampling towards a target's distribution of hashed n-grams.

Features are runs of one to ``most`` consecutive words, joined by one space; a feature's
bucket is the CRC-32 of its bytes, modulo the number of buckets.  No such string is ever
made: each word's CRC is computed once, and the CRCs of runs follow from them, as the CRC of
``A + B`` is that of ``A``, shifted by the length of ``B``, plus that of ``B``.  A shift by
2^j bytes is a 32 x 32 matrix over GF(2), kept as four tables of 256 entries, and a shift by
any length is the product of those of its binary digits.

Counts per bucket, over all raw and all target texts, give each bucket a gain, the
logarithm of the ratio of its smoothed shares.  A document's weight is the mean gain of its
features; with a Gumbel number made from its id it is the document's score, and the highest
scores are a draw without replacement in proportion to the weights.

Ranks need no task that sees all rows: a histogram of the scores (whole numbers of a limited
range) gives the least score that may be drawn, the rows from there on are sorted by ranges,
and a row's rank is its place in its range plus the rows of the earlier ranges.

Defined results: null and empty texts have no features and weight 0; rows without an id get
the Gumbel number of an empty id; of rows with equal score and id, in any order, each has a
rank of its own; an empty table gives no rows, and an empty target still gives gains.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_rows, schema, small_batches, text_of

BUCKETS = 10_000
MOST = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
POLYNOMIAL = 0xEDB88320
CACHE_ENTRIES, CACHE_BYTES = 300_000, 64


def shift_tables(digits: int = 32):
    """For each j the shift of a CRC by 2^j zero bytes: the sum of one entry for each of its four bytes."""
    import numpy as np

    column = []  # the matrix of one zero byte, by columns
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = c >> 1 ^ (POLYNOMIAL if c & 1 else 0)
        column.append(c)
    out = np.zeros((digits, 4, 256), dtype=np.uint32)
    for j in range(digits):
        for part in range(4):
            for value in range(1, 256):
                low = value & -value
                out[j, part, value] = out[j, part, value ^ low] ^ column[8 * part + low.bit_length() - 1]
        column = [int(times(out[j], np.array([c], dtype=np.uint32))[0]) for c in column]
    return out


def times(tables, crcs):
    """A matrix, as its four tables, times many CRCs."""
    return tables[0][crcs & 255] ^ tables[1][crcs >> 8 & 255] ^ tables[2][crcs >> 16 & 255] ^ tables[3][crcs >> 24]


class Features:
    """CRCs of words, remembered while short, and of the runs that they make."""

    def __init__(self, most: int = MOST):
        import numpy as np

        self.most = most
        self.known: dict[bytes, int] = {}
        if most > 1:
            self.shifts = shift_tables()
            self.space = np.uint32(zlib.crc32(b" "))

    def word(self, word: bytes) -> int:
        found = zlib.crc32(word)
        if len(word) <= CACHE_BYTES:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[word] = found
        return found

    def shifted(self, crcs, lengths):
        """CRCs of what they stand for with so many zero bytes behind."""
        import numpy as np

        crcs, j = crcs.copy(), 0
        while (lengths >> j).any():
            at = np.flatnonzero(lengths >> j & 1)
            crcs[at] = times(self.shifts[j], crcs[at])
            j += 1
        return crcs

    def of(self, text: str | None):
        """The number of words of a text, and the CRCs of all its features."""
        import numpy as np

        words = WORDS.findall(text.encode("utf-8", "replace").lower()) if text else []
        n, known = len(words), self.known
        single = np.fromiter((known[w] if w in known else self.word(w) for w in words), dtype=np.uint32, count=n)
        if self.most == 1 or n < 2:
            return n, single
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        spaced = self.shifted(np.full(n, self.space), lengths) ^ single  # a space and the word
        out, run = [single], single
        for k in range(1, min(self.most, n)):
            run = self.shifted(run[:-1], lengths[k:] + 1) ^ spaced[k:]
            out.append(run)
        return n, np.concatenate(out)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, most: int = MOST) -> DataFrame:
    """Rows of ``bucket, n`` over the column ``text`` of all rows."""
    small_batches(texts.sparkSession)

    def work(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        features, total = Features(most), np.zeros(buckets, dtype=np.int64)
        for f in frames:
            for text in f["text"]:
                total += np.bincount(features.of(text)[1] % np.uint32(buckets), minlength=buckets)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": found, "n": total[found]})

    parts = texts.select(text_of(texts).alias("text")).mapInPandas(work, schema(bucket="long", n="long"))
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket, from counts of raw and target features."""
    import numpy as np

    counts = np.zeros((2, buckets), dtype=np.int64)
    for side, found in enumerate((raw, target)):
        for r in found.collect():  # as many rows as buckets
            counts[side, r["bucket"]] = r["n"]
    s, t = counts.astype(np.float64)
    whole_s, whole_t = (float(int(c.sum()) + buckets) for c in counts)
    return np.floor(1000 * np.log((t + 1) * whole_s / ((s + 1) * whole_t))).astype(np.int64).tolist()


def weighed(docs: DataFrame, gain: list[int], most: int = MOST) -> DataFrame:
    """Rows of ``doc_id, n_words, n_features, weight``."""
    small_batches(docs.sparkSession)

    def work(frames: Iterator) -> Iterator:
        import numpy as np

        features, each, buckets = Features(most), np.array(gain, dtype=np.int64), np.uint32(len(gain))
        for f in frames:
            rows = []
            for text in f["text"]:
                n, crcs = features.of(text)
                rows.append((n, len(crcs), int(each[crcs % buckets].sum()) // len(crcs) if len(crcs) else 0))
            yield f[["doc_id"]].assign(**dict(zip(("n_words", "n_features", "weight"), map(list, zip(*rows) if rows else [[]] * 3))))

    return map_rows(docs.select("doc_id", text_of(docs).alias("text")), work, ["doc_id"], n_words="long", n_features="long", weight="long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times a Gumbel number made from an id, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def least_drawn(rows: DataFrame, n: int) -> int | None:
    """The score of the ``n``-th highest row; there are as many scores as whole numbers in their range."""
    scores = rows.groupBy("score").agg(F.count("*").alias("here"))
    upto = scores.withColumn("upto", F.sum("here").over(Window.orderBy(F.col("score").desc())))
    return upto.filter(F.col("upto") >= n).agg(F.max("score")).first()[0]


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most: int = MOST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Rows of ``doc_id, n_features, weight, score, rank`` for all documents; the rank is null where not drawn.

    Drawn are the highest scores among documents of ``least_words``, ``percent`` of a hundred of them.
    """
    gain = gains(bucket_counts(docs, buckets, most), bucket_counts(target, buckets, most), buckets)
    rows = weighed(docs, gain, most).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    # The row's number only keeps many rows of one id from being one range.
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "resampling-scores")
    shown = ["doc_id", "n_features", "weight", "score"]
    undrawn = F.lit(None).cast("long").alias("rank")
    able = rows.filter(F.col("n_words") >= least_words)
    n = percent * able.count() // 100
    if not n:
        return rows.select(*shown, undrawn)
    least = least_drawn(able, n)
    order = [F.col("score").desc(), "doc_id", "n_features", "row"]
    dealt = able.filter(F.col("score") >= least).repartitionByRange(*order).sortWithinPartitions(*order)
    # The lower 33 bits of the running number count a partition's rows.
    placed = cut(dealt.select(*shown, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")), "resampling-ranges")
    sizes = placed.groupBy("part").agg(F.count("*").alias("here"))
    before = F.coalesce(F.sum("here").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each partition of a shuffle.
    starts = F.broadcast(sizes.select("part", before.alias("before")))
    rank = F.col("before") + F.col("place") + 1
    ranked = placed.join(starts, "part").select(*shown, F.when(rank <= n, rank).alias("rank"))
    rest = rows.filter((F.col("n_words") < least_words) | (F.col("score") < least))
    return ranked.unionByName(rest.select(*shown, undrawn))


ORACLE = r"""
WITH bytes AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
texts AS (SELECT 1 AS raw, doc_id AS id, text FROM documents UNION ALL SELECT 0, item_id, text FROM benchmark),
words AS (
  SELECT raw, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
hexed AS (SELECT w, hex(w) AS h FROM (SELECT DISTINCT w FROM words)),
numbers AS (
  SELECT w, list_transform(range(1, length(h), 2), lambda k: (instr('123456789ABCDEF', h[k]) * 16 + instr('123456789ABCDEF', h[k + 1]))::BIGINT) AS b FROM hexed),
buckets AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM numbers, bytes),
features AS (SELECT raw, id, bucket FROM words JOIN buckets USING (w)),
counts AS (SELECT bucket, sum(raw)::BIGINT AS s, sum(1 - raw)::BIGINT AS t FROM features GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::BIGINT AS s_all, coalesce(sum(t), 0)::BIGINT AS t_all FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM counts, totals),
weights AS (
  SELECT id, count(*) AS n, sum(gain)::BIGINT AS total FROM features JOIN gains USING (bucket) WHERE raw = 1 GROUP BY id),
weighed AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features,
         coalesce((total - ((total % n) + n) % n) // n, 0)::BIGINT AS weight,
         ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT AS h
  FROM documents LEFT JOIN weights ON doc_id = id),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM weighed),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS able FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * able // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
