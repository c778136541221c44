"""Scans of texts and pages for leaks, addresses and required parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.exprs import degenerate_digits

#: Rule and pattern; a match is never put out.
LEAKS = [("labelled-id", V.LABELLED_ID), ("phone", V.PHONE), ("e-mail", V.E_MAIL), ("birth-date", V.BIRTH_DATE)]


def leaks(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per text and rule the line of the first match and the number of matches."""
    parts = []
    for rule, pattern in LEAKS:
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
        if rule == "phone":
            found = F.filter(found, lambda x: ~degenerate_digits(x))
        if rule == "e-mail":
            found = F.filter(found, lambda x: ~F.contains(x, F.lit("@example.")))
        parts.append(F.struct(F.lit(rule).alias("rule"), F.size(found).alias("n"), F.get(found, F.lit(0)).alias("first")))
    rows = docs.select(key, text, F.inline(F.array(*parts))).filter("n > 0")
    before = F.substring(F.col(text), F.lit(1), F.instr(F.col(text), F.col("first")))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return rows.select(key, "rule", F.col("n").cast("long").alias("n"), line.cast("long").alias("first_line"))


def strip_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")


def attribute(html: Column, name: str) -> Column:
    """All values of an attribute."""
    return F.regexp_extract_all(html, F.lit(rf'{name}="([^"]*)"'), F.lit(1))


def external(urls: Column) -> Column:
    """Addresses outside this machine."""
    return F.filter(urls, lambda u: u.rlike("^https?://") & ~u.rlike(r"^https?://(?:localhost|127\.0\.0\.1)"))


def missing_parts(pages: DataFrame, key: str, html: str, required: list[str]) -> DataFrame:
    """Required elements a page lacks."""
    want = F.explode(F.array_except(F.array(*[F.lit(x) for x in required]), F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1)), lambda t: F.lower(t)))))
    return pages.select(key, want.alias("missing"))


def banned_paths(paths: Column, suffixes: list[str], prefixes: list[str]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | F.endswith(F.lower(paths), F.lit(s))
    for p in prefixes:
        out = out | F.startswith(paths, F.lit(p))
    return out


def claims(texts: DataFrame, facts: DataFrame, key: str, patterns: list[tuple[str, str]], tolerance: float = 0.05) -> DataFrame:
    """Numbers stated in texts against facts ``name, value``; rows that are off by more than the tolerance."""
    said = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_extract("text", p, 1).try_cast("double").alias("said")) for n, p in patterns]))
    rows = texts.select(key, said).filter("said is not null").join(facts, "name")
    return rows.filter(F.abs(F.col("said") - F.col("value")) > tolerance)
