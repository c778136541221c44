"""Sentences and labels as column expressions, and places on axes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import HEADLINE, WORSE_WHEN_FALLING, WORSE_WHEN_RISING
from .exprs import range_words

# Fixed values. Verbs of one subject and of several.
PLURAL = {"has": "have", "is": "are", "was": "were", "does": "do", "carries": "carry", "shows": "show", "remains": "remain", "appears": "appear", "sits": "sit", "looks": "look"}
#: So many names stand in a sentence at most; of more it tells the number.
NAMED = 4


def joined(names: Column) -> Column:
    """``a``, ``a and b`` or ``a, b and c``; empty without names."""
    front = F.array_join(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), ", ")
    return F.when(F.size(names) > 1, F.concat(front, F.lit(" and "), F.element_at(names, -1))).otherwise(F.coalesce(F.get(names, F.lit(0)), F.lit("")))


def plural(verb: Column) -> Column:
    out = verb
    for one, many in PLURAL.items():
        out = F.when(F.lower(verb) == one, many).otherwise(out)
    return out


def group_title(before: Column, after: Column, names: Column) -> Column:
    """One sentence for findings that differ in their names only.

    A single name and a short list in the middle of a sentence stand in it; names as its subject,
    and long lists, become their number with the verb in the plural.
    """
    rest = F.ltrim(after)
    verb = F.regexp_extract(rest, r"^(\S*)", 1)
    counted = F.concat(before, F.size(names).cast("string"), F.lit(" tests "), plural(verb), F.substring(rest, F.length(verb) + 1, F.length(rest)))
    as_number = (F.size(names) > 1) & ((F.trim(before) == "") | (F.size(names) > NAMED))
    return F.when(as_number, counted).otherwise(F.concat(before, joined(names), after))


def span(first: Column, last: Column, first_day: Column, last_day: Column) -> Column:
    """``04-07 Mar`` from times, or days by number if one of the times is missing."""
    days = F.when(first_day == last_day, F.format_string("day %d", first_day)).otherwise(F.format_string("days %d-%d", first_day, last_day))
    end = F.date_format(last, "dd MMM")
    start = F.when(F.month(first) == F.month(last), F.date_format(first, "dd")).otherwise(F.date_format(first, "dd MMM"))
    dated = F.when(F.to_date(first) == F.to_date(last), end).otherwise(F.concat(start, F.lit("-"), end))
    return F.when(first.isNull() | last.isNull(), days).otherwise(dated)


def day_label(at: Column, with_time: bool = False) -> Column:
    return F.date_format(at, "dd MMM HH:mm" if with_time else "dd MMM")


def short_day(day: Column) -> Column:
    return F.date_format(day, "d MMM")


def date_range(first: Column, last: Column) -> Column:
    """``4 to 11 March 2024``, with month and year twice only where they differ; empty without dates."""
    full = lambda d: F.date_format(d, "d MMMM yyyy")
    same = F.trunc(first, "month") == F.trunc(last, "month")
    start = F.when(same, F.date_format(first, "d")).otherwise(full(first))
    return F.when(first.isNull() | last.isNull(), "").when(first == last, full(first)).otherwise(F.concat(start, F.lit(" to "), full(last)))


def tooltip(value: Column, low: Column, high: Column, collected: Column, critical: Column, page: Column) -> Column:
    """Where a value is in its range, when it was taken, whether it is critical, and the page; missing parts are left out."""
    where = range_words(value, low, high)
    return F.concat_ws(
        " ",
        F.concat(F.upper(F.substring(where, 1, 1)), F.substring(where, 2, 100), F.lit(".")),
        F.concat(F.lit("Collected "), F.date_format(collected, "yyyy-MM-dd HH:mm"), F.lit(".")),
        F.when(critical, "Marked as critical by the laboratory."),
        F.concat(F.lit("From page "), page.cast("string"), F.lit(".")),
    )


def axis(least: Column, most: Column, low: Column, high: Column, pad: float = 0.06) -> Column:
    """``start, end`` of an axis that holds all values and the range, with a margin; 0 to 1 without any."""
    a, b = F.least(least, low, high), F.greatest(most, low, high)
    wide = F.when(a == b, F.greatest(F.abs(a) * 0.1, F.lit(0.5))).otherwise(b - a)
    margin = wide * pad
    return F.struct(F.coalesce(a - margin, F.lit(0.0)).alias("start"), F.coalesce(a + wide + margin, F.lit(1.0)).alias("end"))


def place(value: Column, start: Column, end: Column, left: float, right: float) -> Column:
    return left + F.try_divide(value - start, end - start) * (right - left)


def log_place(fold: Column, most: float, top: float, height: float) -> Column:
    """Height of a fold on a log scale from 1 (bottom) to ``most`` (top); folds below 1 are at the bottom."""
    return top + height * (1 - F.ln(F.greatest(fold, F.lit(1.0))) / F.ln(F.lit(most)))


def valence_of(analyte: Column) -> Column:
    """1 where a rise is bad, -1 where a fall is, null for all other analytes."""
    return F.when(analyte.isin(WORSE_WHEN_RISING), 1).when(analyte.isin(WORSE_WHEN_FALLING), -1)


def headline_key(analyte: Column, display: Column, headline: list[str] | None = None) -> Column:
    """To be ordered by: the leading analytes before all others, then by their names."""
    return F.struct((~analyte.isin(HEADLINE if headline is None else headline)).alias("later"), display.alias("display"))
