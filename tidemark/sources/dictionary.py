"""The analyte dictionary as a table that grows by versions.

A row is an analyte's entry from its version on; ``retired`` takes the analyte out.  ``place`` is the
entry's rank: of analytes that share an alias, the one of the lowest place has it.  The table is the caller's, of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import normalised
from ..operators.labels import match_labels
from ..operators.lookups import lookup

SCHEMA = (
    "analyte string, version int, retired boolean, place long, display string, aliases array<string>, unit string,"
    "low double, high double, valence int, system string, plain string"
)
ENTRY = ["place", "display", "aliases", "unit", "low", "high", "valence", "system", "plain"]


def as_of(log: DataFrame, version: int | None = None) -> DataFrame:
    """One row for each analyte known at a version (the newest without one): its last entry up to there."""
    seen = log.filter("analyte is not null") if version is None else log.filter(F.col("analyte").isNotNull() & (F.col("version") <= version))
    last = seen.groupBy("analyte").agg(F.max_by(F.struct("retired", *ENTRY), "version").alias("e"))
    return last.filter(~F.coalesce("e.retired", F.lit(False))).select("analyte", *[f"e.{c}" for c in ENTRY])


def alias_index(entries: DataFrame) -> DataFrame:
    """Rows of ``alias_norm, key``: display names and aliases, squashed, with the analyte of the lowest place."""
    names = F.concat(F.array("display"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = entries.select("analyte", "place", F.explode(names).alias("name")).withColumn("alias_norm", normalised(F.col("name")))
    return each.filter("alias_norm <> ''").groupBy("alias_norm").agg(F.min_by("analyte", F.struct("place", "analyte")).alias("key"))


def described(rows: DataFrame, entries: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of their analytes' entries, null for unknown ones."""
    return lookup(rows, entries.select("analyte", *columns), "analyte")


def alias_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``alias_norm, was, key`` where two indexes name different analytes; null where one has no such alias."""
    both = old.withColumnRenamed("key", "was").join(new, "alias_norm", "full")
    return both.filter(~F.col("was").eqNullSafe(F.col("key")))


def rederive(rows: DataFrame, log: DataFrame, version: int, fuzzy: bool = True) -> DataFrame:
    """``rows`` (``raw_test, analyte, display, dictionary_version``, and more) brought to a version of the dictionary.

    Rows of that version or a later one stay.  Of the others each different printed name is matched anew, once;
    where that gives another analyte, analyte and display name change.  A name that nothing matches keeps its analyte.
    """
    entries = as_of(log, version)
    stale = F.coalesce(F.col("dictionary_version") < version, F.lit(True))
    names = rows.filter(stale).select(F.col("raw_test").alias("label")).distinct()
    found = match_labels(names, alias_index(entries), fuzzy).filter("key is not null")
    found = lookup(found.select("label", F.col("key").alias("analyte")), entries.select("analyte", "display"), "analyte", "inner")
    found = found.select(F.col("label").alias("raw_test"), F.col("analyte").alias("tm_analyte"), F.col("display").alias("tm_display"))
    j = lookup(rows, found, "raw_test")
    moved = stale & F.col("tm_analyte").isNotNull() & ~F.col("tm_analyte").eqNullSafe(F.col("analyte"))
    new = {"analyte": F.when(moved, F.col("tm_analyte")).otherwise(F.col("analyte")), "display": F.when(moved, F.col("tm_display")).otherwise(F.col("display")), "dictionary_version": F.when(stale, F.lit(version)).otherwise(F.col("dictionary_version"))}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])
