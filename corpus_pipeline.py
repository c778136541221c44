"""A training corpus from ``documents``: judged, deduplicated, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet
and read again as the next stage's ``docs``.  All but the last return the columns of
``documents``, and extra columns unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import copies, lines, mixing, pieces, quality
from tidemark.llm.common import cut, table
from tidemark.llm.queries import piece_model


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or their stratum's cutoff go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the first document only; ``n_chars`` follows the text."""
    kept = lines.drop_repeated_lines(docs).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return kept
    n = F.when(F.col("n_chars").isNotNull(), F.char_length("text")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumn("n_chars", n)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return copies.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, up to three times."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as pieces: their number, and digests of the ids and of the decoded text."""
    return pieces.digest_documents(docs, piece_model())


STAGES = [
    ("3 quality rules", quality_rules),
    ("6 line dedup", line_dedup),
    ("4 near copies", near_copies),
    ("8 mixing", mix),
    ("10 sentencepiece", encode),
]

#: The first, third and last stage can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{k + 1}")
    return docs
