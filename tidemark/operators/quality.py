"""Voting between readings, gates, corrections and de-duplication.

A value may have three readings ``a, b, c``; a null reading abstains.  Ties go to a,
then b, then c.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import close, interpret, plausible
from .series import KEYS

ENVELOPE = (0.0, 300.0)
READINGS = ("a", "b", "c")


def readings() -> Column:
    return F.array_compact(F.array(*[F.col(r) for r in READINGS]))


def majority(a: Column, b: Column, c: Column) -> Column:
    """The value that two readings share, if any."""
    return F.when((a == b) | (a == c), a).when(b == c, b)


def vote(a: Column, b: Column, c: Column) -> Column:
    return F.coalesce(majority(a, b, c), a, b, c)


def choose(low: Column, high: Column, env_low: Column, env_high: Column) -> Column:
    """The majority if plausible, else the only plausible reading, else reading a, else the first."""
    a, b, c = (F.col(r) for r in READINGS)
    m = majority(a, b, c)
    fine = F.array_distinct(F.filter(readings(), lambda v: plausible(v, low, high, env_low, env_high)))
    return F.when(m.isNotNull() & plausible(m, low, high, env_low, env_high), m).when(F.size(fine) == 1, F.get(fine, F.lit(0))).otherwise(F.coalesce(a, b, c))


def ensemble_gate() -> Column:
    r = readings()
    n, d = F.size(r), F.size(F.array_distinct(r))
    return F.when(n == 0, "fail").when(d == 1, F.when(n >= 2, "pass").otherwise("weak")).when(majority(*[F.col(x) for x in READINGS]).isNotNull() & (n == 3), "weak").otherwise("fail")


def flag_gate() -> Column:
    i = interpret(F.col("value"), F.col("low"), F.col("high"))
    flag = F.right(F.col("printed_flag"), F.lit(1))
    return F.when(i.isNull(), "skip").when(flag.isNull(), F.when(i == "N", "pass").otherwise("weak")).when(flag == i, "pass").otherwise("fail")


def envelope_gate(low: float = ENVELOPE[0], high: float = ENVELOPE[1]) -> Column:
    return F.when(F.col("value").isNull(), "skip").when(F.col("value").between(low, high), "pass").otherwise("fail")


#: Name, inputs (the stated value first), expected value from the others.
Identity = tuple[str, list[str], Callable[..., Column]]
IDENTITIES: list[Identity] = [
    ("mcv", ["mcv", "pcv", "rbc"], lambda pcv, rbc: F.try_divide(pcv, rbc) * 10),
    ("mch", ["mch", "hb", "rbc"], lambda hb, rbc: F.try_divide(hb, rbc) * 10),
    ("mchc", ["mchc", "hb", "pcv"], lambda hb, pcv: F.try_divide(hb, pcv) * 100),
    ("bilirubin", ["bilirubin_total", "bilirubin_direct", "bilirubin_indirect"], lambda d, i: d + i),
    ("protein", ["protein_total", "albumin", "globulin"], lambda a, g: a + g),
    ("ag_ratio", ["ag_ratio", "albumin", "globulin"], lambda a, g: F.try_divide(a, g)),
    ("inr", ["inr", "pt", "pt_mnpt"], lambda pt, m: F.try_divide(pt, m)),
    ("nlr", ["nlr", "anc", "alc"], lambda n, l: F.try_divide(n, l)),
]


def identity_gate(samples: DataFrame, by: list[str], identities: list[Identity] = IDENTITIES, rel: float = 0.06) -> DataFrame:
    """Verdict per sample and participating analyte: fail if any of its identities fails, else the first's verdict.

    ``samples`` has ``by, analyte, value``; one conditional aggregation per sample, no self-join.
    """
    names = sorted({x for _, inputs, _ in identities for x in inputs})
    wide = samples.filter(F.col("analyte").isin(names)).groupBy(*by).agg(*[F.max(F.when(F.col("analyte") == x, F.col("value"))).alias(f"v_{x}") for x in names])
    checks = []
    for k, (name, (stated, *others), f) in enumerate(identities):
        want = f(*[F.col(f"v_{x}") for x in others])
        ok = close(F.col(f"v_{stated}"), want, rel)
        for who in (stated, *others):
            checks.append(F.struct(F.lit(who).alias("analyte"), F.lit(name).alias("identity"), F.lit(k).alias("place"), F.when(ok, "pass").when(~ok, "fail").alias("state")))
    rows = wide.select(*by, F.inline(F.array(*checks))).filter("state is not null")
    best = F.min_by(F.struct("state", "identity"), F.struct((F.col("state") != "fail").alias("fine"), "place"))
    return rows.groupBy(*by, "analyte").agg(best.alias("b")).select(*by, "analyte", "b.state", "b.identity")


def differential_gate(points: DataFrame, by: list[str], low: float = 97.0, high: float = 103.0, least: int = 4) -> DataFrame:
    """Sum of shares per sample, given at least ``least`` of them, attached to each."""
    w = Window.partitionBy(*by)
    total, n = F.sum("value").over(w), F.count("value").over(w)
    return points.withColumns({"total": total, "n": n}).filter(F.col("n") >= least).select(*by, "analyte", F.when(F.col("total").between(low, high), "pass").otherwise("fail").alias("state"))


def decimal_shift(obs: DataFrame) -> DataFrame:
    """Chosen values at least five times off their series' median, put right by the one reading near it.

    The exact median is taken before any correction; series below three values are left.
    """
    g = obs.groupBy(*KEYS).agg(F.median("value").alias("mid"), F.count("value").alias("n"))
    j = obs.join(g.filter("n >= 3 and mid <> 0"), KEYS)
    off = (F.col("value") >= 5 * F.col("mid")) | (F.col("value") <= F.col("mid") / 5)
    near = F.array_distinct(F.filter(readings(), lambda v: (v != F.col("value")) & (v / F.col("mid") > 0.33) & (v / F.col("mid") < 3)))
    return j.withColumn("near", near).filter(off & (F.size("near") == 1)).select(*KEYS, "seq", F.col("value").alias("was"), F.get("near", F.lit(0)).alias("value"), F.col("mid").alias("median"))


def dedupe_by_support(obs: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: unanimous readings first, then more readings, then not under review, then input order.

    ``conflicts`` counts the other rows whose value differs from the winner's.
    """
    r = readings()
    support = F.struct((F.size(F.array_distinct(r)) == 1).alias("u"), F.size(r).alias("n"), (flag_gate() != "fail").alias("ok"), (-F.col("seq")).alias("s"))
    best = obs.groupBy(*key).agg(F.max_by(F.struct("seq", "value"), support).alias("w"), F.count("*").alias("n_rows"), F.collect_set("value").alias("values"), F.count("value").alias("n_values"))
    return best.select(*key, F.col("w.seq").alias("seq"), F.col("w.value").alias("value"), "n_rows", F.size(F.array_remove("values", F.col("w.value"))).cast("long").alias("other_values"))


def dedupe_conflicts(obs: DataFrame, key: list[str]) -> DataFrame:
    """One row per key, as rows in input order meet: the better supported stays, the earlier one of equals.

    Support is that readings agree, their number, and that the row isn't under review.  Where the values differ, the one that stays is under review from
    then on, which counts in later meetings, and lists the other.  Rows: ``key, seq, value, needs_review, conflicts``
    with ``conflicts`` an array of ``seq, value``.
    """
    r = readings()
    none = F.array().cast("array<struct<seq:bigint,value:double>>")
    row = F.struct(F.col("seq").cast("long").alias("seq"), F.col("value").cast("double").alias("value"), ((F.size(F.array_distinct(r)) == 1) & (F.size(r) > 1)).alias("agree"), F.size(r).alias("n"), (flag_gate() == "fail").alias("review"), none.alias("conflicts"))

    def meet(best: Column, other: Column) -> Column:
        differ = F.coalesce(best["value"] != other["value"], F.lit(False))
        wins = F.struct(other["agree"], other["n"], ~other["review"]) > F.struct(best["agree"], best["n"], ~best["review"])
        lost = lambda x: F.when(differ, F.array(F.struct(x["seq"].alias("seq"), x["value"].alias("value")))).otherwise(none)
        kept = lambda x, more: F.struct(*[x[c].alias(c) for c in ("seq", "value", "agree", "n")], (x["review"] | differ).alias("review"), F.concat(x["conflicts"], more).alias("conflicts"))
        return F.when(wins, kept(other, lost(best))).otherwise(kept(best, lost(other)))

    rows = F.array_sort(F.collect_list(row))
    folded = obs.groupBy(*key).agg(rows.alias("rows")).withColumn("w", F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), F.get("rows", F.lit(0)), meet))
    return folded.select(*key, "w.seq", "w.value", F.col("w.review").alias("needs_review"), "w.conflicts")


def consensus_range(obs: DataFrame) -> DataFrame:
    """First range with a bound per analyte, in input order."""
    ranged = obs.filter("low is not null or high is not null")
    return ranged.groupBy("analyte").agg(F.min_by(F.struct("low", "high"), "seq").alias("r")).select("analyte", "r.low", "r.high")


def gated(obs: DataFrame) -> DataFrame:
    """All row-level gates, ``needs_review`` (any gate weak or failed), and the critical mark."""
    g = obs.withColumn("gates", F.create_map(F.lit("ensemble"), ensemble_gate(), F.lit("flag"), flag_gate(), F.lit("envelope"), envelope_gate()))
    crit = F.when(F.col("printed_flag") == "CH", "HH").when(F.col("printed_flag") == "CL", "LL")
    return g.withColumns({"needs_review": F.exists(F.map_values("gates"), lambda s: s.isin("weak", "fail")), "interpretation": F.coalesce(crit, F.col("interpretation")), "critical": crit.isNotNull()})


def detailed(state: Column, detail: Column) -> Column:
    return F.struct(state.alias("state"), detail.alias("detail"))


def ensemble_verdict() -> Column:
    """The ensemble gate with what the passes read."""
    r = readings()
    n, d = F.size(r), F.array_sort(F.array_distinct(r))
    listed = F.concat(F.lit("["), F.array_join(F.transform(d, lambda v: v.cast("string")), ", "), F.lit("]"))
    most = majority(*[F.col(x) for x in READINGS])
    text = F.when(n == 0, "no pass produced a value").when(F.size(d) == 1, F.when(n >= 2, "unanimous").otherwise("single pass only"))
    text = text.when(most.isNotNull() & (n == 3), F.concat(F.lit("majority "), most.cast("string"), F.lit(" of "), listed)).otherwise(F.concat(F.lit("no majority among "), listed))
    return detailed(ensemble_gate(), text)


def flag_verdict() -> Column:
    """The flag gate with what the page says and what the value reads."""
    i = interpret(F.col("value"), F.col("low"), F.col("high"))
    flag = F.col("printed_flag")
    text = F.when(F.col("value").isNull(), "no value").when(i.isNull(), "no usable reference range")
    text = text.when(flag.isNull() & (i == "N"), "no flag, value in range").when(flag.isNull(), F.concat(F.lit("no flag printed but value reads "), i))
    text = text.when(flag_gate() == "pass", F.concat(F.lit("flag "), flag, F.lit(" agrees"))).otherwise(F.concat(F.lit("page says "), flag, F.lit(" but value "), F.col("value").cast("string"), F.lit(" reads "), i))
    return detailed(flag_gate(), text)


def envelope_verdict(low: float = ENVELOPE[0], high: float = ENVELOPE[1]) -> Column:
    state = envelope_gate(low, high)
    return detailed(state, F.when(state == "skip", "no value").otherwise(F.concat(F.col("value").cast("string"), F.when(state == "pass", " is").otherwise(" isn't"), F.lit(f" within {low} to {high}"))))


def with_provenance(obs: DataFrame, samples: DataFrame, by: list[str], identities: list[Identity] = IDENTITIES) -> DataFrame:
    """Observations with ``interpretation``, ``critical``, ``needs_review`` and ``provenance``.

    ``provenance`` is a struct of ``page, ocr, gates, human_verified``, where ``ocr`` maps passes to readings and ``gates`` maps
    each gate that applies to its state and detail: ensemble, flag_consistency and envelope to every row, arithmetic and differential to
    rows whose sample (``by``) gives them a verdict on the analyte.  ``samples`` has ``by, analyte, value``, one row each.
    """
    sums = identity_gate(samples, by, identities).select(*by, "analyte", detailed(F.col("state"), F.concat(F.when(F.col("state") == "pass", "agrees with ").otherwise("breaks "), "identity")).alias("tm_sum"))
    shares = differential_gate(samples, by).select(*by, "analyte", detailed(F.col("state"), F.when(F.col("state") == "pass", "shares add up").otherwise("shares don't add up")).alias("tm_share"))
    verdicts = sums.join(shares, [*by, "analyte"], "full")
    o = obs.join(verdicts, [*by, "analyte"], "left")
    own = {"ensemble": ensemble_verdict(), "flag_consistency": flag_verdict(), "envelope": envelope_verdict(), "arithmetic": F.col("tm_sum"), "differential": F.col("tm_share")}
    gates = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("verdict")) for k, v in own.items()]), lambda e: e["verdict"].isNotNull()))
    ocr = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(r.upper()).alias("pass"), F.col(r).alias("value")) for r in READINGS]), lambda e: e["value"].isNotNull()))
    crit = F.when(F.col("printed_flag") == "CH", "HH").when(F.col("printed_flag") == "CL", "LL")
    verified = F.coalesce(F.col("human_verified"), F.lit(False))
    o = o.withColumn("provenance", F.struct(F.col("page"), ocr.alias("ocr"), gates.alias("gates"), verified.alias("human_verified")))
    review = F.exists(F.map_values("provenance.gates"), lambda g: g["state"].isin("weak", "fail"))
    return o.withColumns({"interpretation": F.coalesce(crit, interpret(F.col("value"), F.col("low"), F.col("high"))), "critical": crit.isNotNull(), "needs_review": review}).drop("tm_sum", "tm_share")


def agreement(obs: DataFrame) -> DataFrame:
    """Counts of unanimous, single, majority and conflicting readings, zero counts included."""
    r = readings()
    n, d = F.size(r), F.size(F.array_distinct(r))
    kind = F.when(n == 0, "conflict").when((d == 1) & (n == 1), "single").when(d == 1, "unanimous").when((d == 2) & (n == 3), "majority").otherwise("conflict")
    k = obs.select(kind.alias("k"))
    counts = k.agg(*[F.count_if(F.col("k") == x).alias(x) for x in ("unanimous", "single", "majority", "conflict")])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(x).alias("kind"), F.col(x).alias("n")) for x in ("unanimous", "single", "majority", "conflict")])))


def merge_passes(rows: DataFrame, by: list[str], passes: tuple[str, ...] = ("A", "B", "C")) -> DataFrame:
    """Long rows ``by, pass, value, text`` as one row per key; text from the first pass that has one."""
    ordered = F.array_position(F.array(*[F.lit(p) for p in passes]), F.col("pass"))
    filled = F.when(F.coalesce(F.col("text"), F.lit("")) != "", ordered)
    return rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("pass", "value"))).alias("ocr"), F.min_by("text", filled).alias("text"))


def choose_unit(printed: Column, expected: Column, known: list[str], alike: Column | None = None) -> Column:
    """``unit`` and ``mismatch``: blank or equal units give the expected one, a known other unit is kept and marked."""
    squash = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    same = (F.trim(F.coalesce(printed, F.lit(""))) == "") | (squash(printed) == squash(expected)) | (alike if alike is not None else F.lit(False))
    other = ~same & printed.isin(known)
    return F.struct(F.when(other, printed).otherwise(expected).alias("unit"), other.alias("mismatch"))

