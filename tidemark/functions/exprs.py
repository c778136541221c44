"""Scalar functions as column expressions: parsing, ranges, folds, rounding, formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import STOP_WORDS


def nil(kind: str = "double") -> Column:
    return F.lit(None).cast(kind)


def fixed(x: Column, digits: int = 4) -> Column:
    """A double rounded half away from zero, so that sums in another order give the same.

    The scaled double is rounded, not its shortest decimal: engines agree on that.
    """
    power = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * power + 0.5) / power + 0.0


# --- ranges -----------------------------------------------------------------------------


def interpret(value: Column, low: Column, high: Column) -> Column:
    """H above, L below, N inside (bounds included), null without bounds."""
    return F.when(value.isNull() | (low.isNull() & high.isNull()), nil("string")).when(value > high, "H").when(value < low, "L").otherwise("N")


def in_range(value: Column, low: Column, high: Column) -> Column:
    """Inside the bounds that exist; null without any."""
    return F.when(low.isNull() & high.isNull(), nil("boolean")).otherwise(F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True)))


def fold_outside(value: Column, low: Column, high: Column) -> Column:
    """How many times outside: null for no bounds or a value of 0 or less, 1 inside."""
    return F.when(value.isNull() | (value <= 0) | (low.isNull() & high.isNull()), nil()).when((high > 0) & (value > high), F.try_divide(value, high)).when(value < low, F.try_divide(low, value)).otherwise(1.0)


def gauge_fold(value: Column, low: Column, high: Column) -> Column:
    """As :func:`fold_outside`, but 1 for values of 0 or less below the range."""
    return F.when(value.isNull() | (low.isNull() & high.isNull()), nil()).when((high > 0) & (value > high), F.try_divide(value, high)).when((value < low) & (value > 0), F.try_divide(low, value)).otherwise(1.0)


def heat_fold(value: Column, low: Column, high: Column, cap: float = 20.0) -> Column:
    """Capped fold for heat maps: 1 without bounds, bounds of 0 ignored."""
    up = F.when((high != 0) & (value > high), F.try_divide(value, high))
    down = F.when((low != 0) & (value < low) & (value > 0), F.try_divide(low, value))
    return F.when(value.isNotNull(), F.least(F.coalesce(up, down, F.lit(1.0)), F.lit(cap)))


def range_width(low: Column, high: Column, value: Column) -> Column:
    """High minus low, else the one upper bound, else the value, else 1."""
    return F.coalesce(F.nullif(high - low, F.lit(0.0)), F.nullif(F.abs(high), F.lit(0.0)), F.nullif(F.abs(value), F.lit(0.0)), F.lit(1.0))


def gauge_position(value: Column, low: Column, high: Column) -> Column:
    """Place on a gauge in percent: 30 to 70 in the range, on a log scale outside up to 16-fold."""
    inside = 30 + 40 * F.try_divide(value - low, high - low)
    fold = gauge_fold(value, low, high)
    out = 30 * F.least(F.log2(fold) / 4, F.lit(1.0))
    return F.when(low.isNull() | high.isNull() | value.isNull(), nil()).when(value > high, 70 + out).when(value < low, 30 - out).otherwise(inside)


def plausible(value: Column, low: Column, high: Column, env_low: Column, env_high: Column) -> Column:
    """Inside the envelope and within a factor of ten of the printed range."""
    return F.coalesce(value >= env_low, F.lit(True)) & F.coalesce(value <= env_high, F.lit(True)) & F.coalesce(value >= low / 10, F.lit(True)) & F.coalesce(value <= high * 10, F.lit(True))


def close(a: Column, b: Column, rel: float = 0.06) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9)) <= rel


def step_direction(before: Column, now: Column, noise: float = 0.03) -> Column:
    """-1, 0 or 1; 0 if the change is below the noise."""
    base = F.coalesce(F.nullif(F.abs(before), F.lit(0.0)), F.lit(1.0))
    return F.when(before.isNull() | now.isNull(), nil("int")).when(F.abs(now - before) < noise * base, 0).otherwise(F.sign(now - before).cast("int"))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    """Between two bounds; null stays null, where greatest and least would skip it."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def points(x: Column, low: float, high: float) -> Column:
    """1 below, 2 from ``low`` to ``high``, 3 above."""
    return F.when(x < low, 1).when(x > high, 3).when(x.isNotNull(), 2)


def range_label(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), F.concat_ws(" to ", short(low), short(high))).when(high.isNotNull(), F.concat(F.lit("up to "), short(high))).when(low.isNotNull(), F.concat(F.lit("from "), short(low))).otherwise("no range")


def short(x: Column) -> Column:
    """A number with up to three decimals, none from 1000 on, without trailing zeros."""
    text = F.format_string("%.3f", x)
    return F.when(F.abs(x) >= 1000, F.format_string("%.0f", x)).otherwise(F.regexp_replace(text, r"\.?0+$", ""))


def general(x: Column, signed: bool = False) -> Column:
    """A number with six significant digits and no trailing zeros, with an exponent below 1e-4 and from 1e6 on; ``signed`` shows a plus.

    A seventh digit of 5 that is the last one of the shortest decimal rounds up.
    """
    bare = lambda t: F.regexp_replace(t, r"\.?0+$", "")
    sci = F.format_string("%.5e", x)
    power = F.regexp_extract(sci, "e(.*)$", 1).try_cast("int")
    fixed_text = F.call_function("format_string", F.concat(F.lit("%."), (5 - power).cast("string"), F.lit("f")), x)
    text = F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).when(power == 5, F.format_string("%.0f", x))
    text = text.when(power.between(-4, 4), bare(fixed_text)).otherwise(F.concat(bare(F.regexp_extract(sci, "^(.*)e", 1)), F.regexp_extract(sci, "(e.*)$", 1)))
    return F.concat(F.when(x >= 0, "+").when(F.isnan(x), "+").otherwise(""), text) if signed else F.when(x.isNotNull(), text)


def signed_percent(x: Column) -> Column:
    """A number without decimals and with its sign; halves go to the even one."""
    return F.concat(F.when(x < 0, "-").otherwise("+"), F.bround(F.abs(x), 0).cast("decimal(38,0)").cast("string"))


def reference_sentence(low: Column, high: Column) -> Column:
    """Both bounds of a range, or one, as a sentence; empty without any."""
    both = F.concat(F.lit("Reference "), general(low), F.lit("-"), general(high), F.lit("."))
    return F.when(low.isNotNull() & high.isNotNull(), both).when(high.isNotNull(), F.concat(F.lit("Reference upper limit "), general(high), F.lit("."))).when(low.isNotNull(), F.concat(F.lit("Reference lower limit "), general(low), F.lit("."))).otherwise("")


def range_words(value: Column, low: Column, high: Column) -> Column:
    """Where a value is relative to its range, in a few words."""
    fold = gauge_fold(value, low, high)
    share = F.try_divide(value - low, high - low)
    above = F.when(fold < 1.15, "just above").otherwise(F.concat(F.format_string("%.1f", fold), F.lit(" times the upper limit")))
    below = F.when(fold < 1.15, "just below").when(fold >= 1.5, "well below").otherwise("below")
    inside = F.when(share.isNull(), "inside").when(share < 0.25, "inside, near the lower limit").when(share > 0.75, "inside, near the upper limit").otherwise("inside")
    return F.when(value.isNull() | (low.isNull() & high.isNull()), nil("string")).when(value > high, above).when(value < low, below).otherwise(inside)


def direction(valence: Column, delta: Column) -> Column:
    """better, worse, changed or flat; ``valence`` is +1 where a rise is bad."""
    return F.when(delta == 0, "flat").when(valence.isNull(), "changed").when(F.sign(delta) == valence, "worse").otherwise("better")


# --- text -------------------------------------------------------------------------------


def normalised(text: Column) -> Column:
    """Upper case letters and digits only."""
    return F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]", "")


def clean_label(text: Column) -> Column:
    """Without trailing punctuation and without a trailing specimen name."""
    bare = F.regexp_replace(F.trim(text), r"[,;:]+$", "")
    return F.trim(F.regexp_replace(bare, r"(?i),\s*(?:serum|plasma|blood)\s*$", ""))


NUMBER = r"-?[0-9]+(?:[.,][0-9]+)?"


def parse_value(text: Column) -> dict[str, Column]:
    """``number, flag, comparator`` of a printed result."""
    flag = F.regexp_extract(text, r"\(?(?:^|[^A-Za-z])\(?(CH|CL|H|L)\)?(?:[^A-Za-z]|$)", 1)
    bare = F.regexp_replace(text, r"\(?(?:CH|CL|H|L)\)?\s*$|[▲▼^]", " ")
    joined = F.regexp_replace(bare, r"(^|\s)-\s+([0-9])", "$1-$2")
    tokens = F.filter(F.split(F.trim(joined), r"\s+"), lambda t: t.rlike(f"^[<>]?{NUMBER}$"))
    first = F.get(tokens, F.lit(0))
    number = F.regexp_replace(F.regexp_replace(first, "^[<>]", ""), ",", ".")
    return {"number": number.try_cast("double"), "flag": F.nullif(flag, F.lit("")), "comparator": F.nullif(F.regexp_extract(first, "^([<>])", 1), F.lit(""))}


def parse_reference(text: Column) -> dict[str, Column]:
    """``low, high`` of a printed range: ``a - b``, else ``< x`` or ``> x``, else nothing."""
    a = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)\s*[-–]\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    b = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?)\s*[-–]\s*([0-9]+(?:\.[0-9]+)?)", 2).try_cast("double")
    pair = F.coalesce(a <= b, F.lit(False))
    below = F.regexp_extract(text, r"<\s*=?\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    above = F.regexp_extract(text, r">\s*=?\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return {"low": F.when(pair, a).when(below.isNull(), above), "high": F.when(pair, b).otherwise(below)}


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, without stop words and single characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def html_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def id_stem(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "^([A-Za-z]{2,4}[0-9]{7})", 1), F.lit(""))


def repair_id(text: Column) -> Column:
    """After the third character I is 1 and O is 0."""
    return F.concat(F.substring(text, 1, 3), F.translate(F.substring(text, 4, 1_000), "IO", "10"))


def parse_printed_time(text: Column) -> Column:
    """``dd/mm/yy[yy] hh:mm`` as timestamp; null where it isn't one."""
    got = [F.regexp_extract(text, r"([0-9]{1,2})[/.-]([0-9]{1,2})[/.-]([0-9]{4}|[0-9]{2})\s+([0-9]{1,2}):([0-9]{2})", k) for k in range(1, 6)]
    d, m, y, hh, mm = got
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    shown = F.concat(year, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"), F.lit(" "), F.lpad(hh, 2, "0"), F.lit(":"), mm, F.lit(":00"))
    return F.when(d != "", F.try_to_timestamp(shown, F.lit("yyyy-MM-dd HH:mm:ss")))


def degenerate_digits(text: Column) -> Column:
    """At most two distinct digits, or a run up or down by one."""
    digits = F.filter(F.split(text, ""), lambda c: c != "")
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(digits) - 1, F.lit(1))), lambda i: F.get(digits, i).cast("int") - F.get(digits, i - 1).cast("int"))
    return (F.size(F.array_distinct(digits)) <= 2) | F.forall(steps, lambda s: s == 1) | F.forall(steps, lambda s: s == -1)


def crop_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A box with 30 % more to the left, 45 % to the right and 0.6 of its height above and below, on the page."""
    left = F.greatest(F.lit(0), (x - 0.30 * width).cast("int"))
    right = F.least(width, (x + w + 0.45 * width).cast("int"))
    top = F.greatest(F.lit(0), (y - 0.6 * h).cast("int"))
    bottom = F.least(height, (y + h + 0.6 * h).cast("int"))
    return F.struct(left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height"))
