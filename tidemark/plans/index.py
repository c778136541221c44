"""A lasting index of chunks for BM25: postings by term in parts, so that questions read only the parts and terms of theirs.

Three tables lie under one path: ``postings`` (``term, id, tf, dl``) and ``terms`` (``term, df``), both in ``part`` folders by a hash of the term
and sorted by it, and ``sizes``, one row with the number of chunks and their mean length.  A filter on a few terms prunes the
folders, and in their files the row groups that don't hold them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import tokens
from . import retrieval as R

PARTS = 64
POSTING, TERM = "id {}, term string, tf bigint, dl int, part int", "term string, df bigint, part int"


def part_of(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


@dataclass
class Index:
    """The tables of an index, read back."""

    postings: DataFrame
    terms: DataFrame
    sizes: DataFrame
    parts: int


def write(chunks: DataFrame, path: str, parts: int = PARTS) -> Index:
    """Index chunks of ``id, text`` under a path where nothing is yet."""
    spark = chunks.sparkSession
    posts = R.postings(chunks).withColumn("part", part_of(F.col("term"), parts))
    # A frequent term's postings may be many, so a part is dealt to several tasks by id.
    dealt = posts.repartition("part", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("part", "term", "id")
    dealt.write.partitionBy("part").parquet(f"{path}/postings")
    kind = chunks.schema["id"].dataType.simpleString()
    made = spark.read.schema(POSTING.format(kind)).parquet(f"{path}/postings")
    made.groupBy("part", "term").agg(F.count("*").alias("df")).repartition("part").sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{path}/terms")
    lengths = chunks.select(F.size(tokens(F.col("text"))).alias("dl"))
    lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.lit(parts).alias("parts"), F.lit(kind).alias("kind")).write.parquet(f"{path}/sizes")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> Index:
    sizes = spark.read.parquet(f"{path}/sizes")
    one = sizes.first()
    tables = [spark.read.schema(kind).parquet(f"{path}/{name}") for name, kind in (("postings", POSTING.format(one["kind"])), ("terms", TERM))]
    return Index(*tables, sizes.select("n", "avgdl"), one["parts"])


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """``qid, id, score`` of all chunks that hold a term of a query of ``qid, term, weight``."""
    asked = queries.select("term").distinct()
    some = [r["term"] for r in asked.limit(R.BROADCAST_TERMS + 1).collect()]
    if len(some) <= R.BROADCAST_TERMS:
        parts = sorted(r["part"] for r in asked.select(part_of(F.col("term"), index.parts).alias("part")).distinct().collect())
        own = lambda t: t.filter(F.col("part").isin(parts) & F.col("term").isin(some))
    else:
        own = lambda t: t.join(asked, "term")
    return R.weigh(own(index.postings).select("id", "term", "tf", "dl"), own(index.terms).select("term", "df"), index.sizes, queries)
