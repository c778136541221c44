"""The ten rules as findings in words: headline, detail, evidence rows and audience; and findings that say the same, as one.

``points``: ``patient_id, analyte, day, value, collected, display, unit, low, high, valence, headline`` with one
row for each patient, analyte and day.  Rules over one series are windows over it.  Rules over several analytes read one
row for each patient, a map from analyte to its points of the last days, so all of them take one aggregation.

A finding is ``rule, severity, patient_id, analyte, headline, detail, evidence, audience``, where ``evidence`` is an array of
``day, value, analyte``, the last null in findings of one series, and ``analyte`` is null in findings of none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as X
from ..functions.exprs import general, in_range, reference_sentence, signed_percent, step_direction
from ..functions.words import group_title, span
from ..operators import series as S
from ..sources.dictionary import described

EVIDENCE = "array<struct<day:int,value:double,analyte:string>>"
SHAPE = ["rule", "severity", "patient_id", "analyte", "headline", "detail", "evidence", "audience"]
RANKS = ["critical", "high", "moderate", "info"]
MELD_JUMP = 3.0
KEYS = S.KEYS


def names(who: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in who])


def unit_text(unit: Column) -> Column:
    return F.when(F.coalesce(unit, F.lit("")) != "", F.concat(F.lit(" "), unit)).otherwise("")


def chain(points: Column, unit: Column) -> Column:
    return F.concat(F.array_join(F.transform(points, lambda p: general(p["value"])), " -> "), unit_text(unit))


def evidence(points: Column, analyte: Column | None = None) -> Column:
    of = F.lit(None).cast("string") if analyte is None else analyte
    return F.transform(points, lambda p: F.struct(p["day"].cast("int").alias("day"), p["value"].alias("value"), of.alias("analyte")))


def voice(direction: Column, valence: Column, worse: Column) -> tuple[Column, Column]:
    """Severity and audience of a move: worse for all, better for all as information, and neither for the doctor only."""
    bad = F.coalesce(direction == valence, F.lit(False))
    return F.when(bad, worse).otherwise("info"), F.when(valence.isNull(), names(X.DOCTOR)).otherwise(names(X.BOTH))


def point(*more: str) -> Column:
    return F.struct("day", "value", *more)


def runs(points: DataFrame) -> DataFrame:
    """Series that move one way for three points or more, and by a tenth in all, with the points of the run in order."""
    s = S.islands(points).withColumn("before", F.lag(F.struct("day", "value", "collected")).over(S.series()))
    g = s.filter("dir <> 0").groupBy(*KEYS, "island", "dir").agg(F.min_by("before", "day").alias("first"), F.max_by(F.struct("day", "value", "collected", "display", "unit", "low", "high", "valence"), "day").alias("last"), F.array_sort(F.collect_list(point())).alias("rest"))
    base = F.coalesce(F.nullif(F.abs("first.value"), F.lit(0.0)), F.lit(1.0))
    g = g.withColumns({"points": F.concat(F.array(F.struct("first.day", "first.value")), "rest"), "change": (F.col("last.value") - F.col("first.value")) / base})
    return g.filter((F.size("rest") >= S.RUN_STEPS) & (F.abs("change") >= S.RUN_NET)).drop("rest", "island")


def run_findings(found: DataFrame) -> DataFrame:
    up = F.col("dir") > 0
    severity, audience = voice(F.col("dir"), F.col("last.valence"), F.when(F.size("points") >= 5, "high").otherwise("moderate"))
    days = F.col("last.day") - F.col("first.day")
    better = F.coalesce(F.col("dir") == -F.col("last.valence"), F.lit(False))
    said = [F.col("last.display"), F.when(up, X.RISEN).otherwise(X.FALLEN), days]
    head = F.when(better, F.format_string(X.RUN_HEAD_BETTER, *said)).otherwise(F.format_string(X.RUN_HEAD, *said))
    when = span(F.col("first.collected"), F.col("last.collected"), F.col("first.day"), F.col("last.day"))
    detail = F.format_string(X.RUN_DETAIL, chain(F.col("points"), F.col("last.unit")), when, signed_percent(F.col("change") * 100), days, reference_sentence(F.col("last.low"), F.col("last.high")))
    return found.select(F.when(up, "rising-run").otherwise("falling-run").alias("rule"), severity.alias("severity"), *KEYS, head.alias("headline"), F.trim(detail).alias("detail"), evidence(F.col("points")).alias("evidence"), audience.alias("audience"))


def delta_findings(points: DataFrame, found: DataFrame) -> DataFrame:
    """The sharpest change from one day to the next of each series.

    It is of over half the value or over the width of the range.  A step between days of runs, of at most the value itself, is the runs' echo.
    """
    w = S.series()
    s = points.withColumn("before", F.lag(F.struct("day", "value", "collected")).over(w)).filter(F.col("day") - F.col("before.day") == 1)
    base = F.coalesce(F.nullif(F.abs("before.value"), F.lit(0.0)), F.lit(1.0))
    change = F.col("value") - F.col("before.value")
    s = s.withColumns({"change": change, "rel": F.abs(change) / base, "signed": change / base * 100, "wide": F.col("high") - F.col("low")})
    s = s.withColumns({"by_share": F.col("rel") > S.JUMP, "by_width": F.coalesce(F.abs("change") > F.col("wide"), F.lit(False))}).filter("by_share or by_width")
    in_runs = found.groupBy(*KEYS).agg(F.flatten(F.collect_list(F.transform("points", lambda p: p["day"]))).alias("run_days"))
    s = s.join(in_runs, KEYS, "left")
    echo = F.coalesce(F.array_contains("run_days", F.col("before.day")) & F.array_contains("run_days", F.col("day")), F.lit(False)) & (F.col("rel") <= 2 * S.JUMP)
    s = s.filter(~echo).groupBy(*KEYS).agg(F.max_by(F.struct(*[c for c in s.columns if c not in KEYS]), F.struct("rel", -F.col("day"))).alias("s")).select(*KEYS, "s.*")
    up = F.col("change") > 0
    severity, audience = voice(F.when(up, 1).otherwise(-1), F.col("valence"), F.when(F.col("by_share") & F.col("by_width"), "high").otherwise("moderate"))
    head = F.format_string(X.DELTA_HEAD, F.col("display"), F.when(up, X.ROSE).otherwise(X.FELL), F.when(F.col("by_share"), X.BY_SHARE).otherwise(X.BY_WIDTH))
    when = span(F.col("before.collected"), F.col("collected"), F.col("before.day"), F.col("day"))
    width = F.when(F.col("wide").isNotNull(), F.concat(F.lit(", range width "), general(F.col("wide")))).otherwise("")
    detail = F.concat(general(F.col("before.value")), F.lit(" -> "), general(F.col("value")), unit_text(F.col("unit")), F.lit(" ("), when, F.lit("); "), general(F.col("change"), signed=True), F.lit(" ("), signed_percent(F.col("signed")), F.lit("%)"), width, F.rtrim(F.concat(F.lit(". "), reference_sentence(F.col("low"), F.col("high")))))
    both = F.array(F.struct("before.day", "before.value"), point())
    return s.select(F.lit("delta-24h").alias("rule"), severity.alias("severity"), *KEYS, head.alias("headline"), detail.alias("detail"), evidence(both).alias("evidence"), audience.alias("audience"))


def crossing_findings(points: DataFrame) -> DataFrame:
    """Every step out of the range, the first one and relapses told apart, and every return."""
    w = S.series()
    s = points.withColumn("inside", in_range(F.col("value"), F.col("low"), F.col("high")))
    s = s.withColumn("before", F.lag(F.struct("day", "value", "collected", "inside")).over(w)).filter("inside <> before.inside")
    # Returns don't count, so the running number of exits is the same among the crossings alone.
    left = ~F.col("inside")
    s = s.withColumn("exits", F.sum(F.when(left, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.when(~left, F.format_string(X.RETURN_HEAD, F.col("display"))).when(F.col("exits") == 1, F.format_string(X.EXIT_HEAD, F.col("display"))).otherwise(F.format_string(X.EXIT_AGAIN_HEAD, F.col("display")))
    side = F.when(~left, "within reference").when(F.col("value") > F.col("high"), "above range").otherwise("below range")
    when = span(F.col("before.collected"), F.col("collected"), F.col("before.day"), F.col("day"))
    detail = F.concat(general(F.col("before.value")), F.lit(" -> "), general(F.col("value")), F.lit(" ("), side, F.lit(")"), unit_text(F.col("unit")), F.lit(" ("), when, F.lit("). "), reference_sentence(F.col("low"), F.col("high")))
    severity = F.when(~left, "info").when(F.col("headline"), "high").otherwise("moderate")
    both = F.array(F.struct("before.day", "before.value"), point())
    return s.select(F.when(left, "range-exit").otherwise("range-return").alias("rule"), severity.alias("severity"), *KEYS, head.alias("headline"), detail.alias("detail"), evidence(both).alias("evidence"), names(X.BOTH).alias("audience"))


def critical_findings(obs: DataFrame) -> DataFrame:
    """Series with a critical mark: critical while it is the last word, high once a later day has a reading."""
    o = obs.filter("value is not null")
    mark = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    crit = mark("printed_flag").isin(*S.CRITICAL) | mark("interpretation").isin(*S.CRITICAL)
    flag = F.coalesce(F.nullif(F.col("printed_flag"), F.lit("")), F.col("interpretation"))
    row = F.struct("day", "seq", "value", "display", "unit", "low", "high", flag.alias("flag"))
    g = o.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.when(crit, F.struct("day", "seq", "value")))).alias("marked"), F.max_by(row, F.when(crit, F.struct("day", "seq"))).alias("last"), F.max_by(F.struct("day", "value"), F.struct("day", "collected", -F.col("seq"))).alias("latest"))
    g = g.filter(F.size("marked") > 0)
    later = F.col("latest.day") > F.col("last.day")
    low, high = F.col("last.low"), F.col("last.high")
    bounds = F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit("; reference "), general(low), F.lit("-"), general(high), F.lit("."))).otherwise(".")
    days = F.array_join(F.transform("marked", lambda m: m["day"].cast("string")), ", ")
    told = F.concat(F.col("last.display"), F.lit(" "), general(F.col("last.value")), unit_text(F.col("last.unit")), F.lit(" flagged "), F.col("last.flag"), F.lit(" on day(s) "), days)
    resolved = F.concat(told, F.lit("; latest "), general(F.col("latest.value")), unit_text(F.col("last.unit")), F.lit(" on day "), F.col("latest.day").cast("string"), F.lit(" is unflagged"), bounds)
    name = F.lower("last.display")
    head = F.when(later, F.format_string(X.RESOLVED_HEAD, name)).otherwise(F.format_string(X.CRITICAL_HEAD, name))
    rows = F.transform("marked", lambda m: F.struct(m["day"].alias("day"), m["value"].alias("value")))
    rows = F.when(later, F.concat(rows, F.array("latest"))).otherwise(rows)
    return g.select(F.lit("critical-flag").alias("rule"), F.when(later, "high").otherwise("critical").alias("severity"), *KEYS, head.alias("headline"), F.when(later, resolved).otherwise(F.concat(told, bounds)).alias("detail"), evidence(rows).alias("evidence"), names(X.BOTH).alias("audience"))


def meld_findings(scores: DataFrame, least: float = MELD_JUMP) -> DataFrame:
    """The largest rise of a score within two days; ``scores`` is ``patient_id, day, score`` of complete ones."""
    s = S.score_escalation(scores, least)
    detail = F.format_string(X.MELD_DETAIL, general(F.col("p_score")), F.col("p_day"), general(F.col("score")), F.col("day"), general(F.col("score") - F.col("p_score")), F.col("day") - F.col("p_day"))
    both = F.array(F.struct(F.col("p_day").alias("day"), F.col("p_score").alias("value")), F.struct(F.col("day").alias("day"), F.col("score").alias("value")))
    return s.select(F.lit("meld-escalation").alias("rule"), F.lit("high").alias("severity"), "patient_id", F.lit(None).cast("string").alias("analyte"), F.lit(X.MELD_HEAD).alias("headline"), detail.alias("detail"), evidence(both).alias("evidence"), names(X.BOTH).alias("audience"))


def patient_tails(points: DataFrame, days: int = S.TREND_DAYS) -> DataFrame:
    """One row for each patient: ``tails``, a map from analyte to what its points of the record's last days do, and ``ends``, to its last point."""
    p = points.withColumn("record_end", F.max("day").over(Window.partitionBy("patient_id")))
    recent = F.col("day") > F.col("record_end") - days
    full = F.struct("day", "value", "collected", "display", "unit", "low", "high", "valence")
    g = p.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.when(recent, point()))).alias("points"), F.min_by(full, F.when(recent, F.col("day"))).alias("first"), F.max_by(full, "day").alias("last"))
    direction = F.when(F.size("points") >= 2, step_direction(F.col("first.value"), F.col("last.value"), S.NOISE)).otherwise(0)
    summary = F.concat(F.col("last.display"), F.lit(" "), general(F.col("first.value")), F.lit("->"), general(F.col("last.value")), unit_text(F.col("last.unit")))
    tail = F.struct("analyte", direction.alias("dir"), "points", "first", "last", summary.alias("summary"))
    return g.groupBy("patient_id").agg(F.map_from_entries(F.collect_list(F.struct("analyte", tail))).alias("tails"))


def tail(analyte: str) -> Column:
    return F.try_element_at(F.col("tails"), F.lit(analyte))


def measured(analytes) -> Column:
    """Tails of those analytes that have two points at least, in the given order."""
    return F.filter(F.array(*[tail(a) for a in analytes]), lambda t: t.isNotNull() & (F.size(t["points"]) >= 2))


def rows_of(tails: Column) -> Column:
    return F.flatten(F.transform(tails, lambda t: evidence(t["points"], t["analyte"])))


def parts_of(tails: Column) -> Column:
    return F.array_join(F.transform(tails, lambda t: t["summary"]), ", ")


def count(tails: Column, test) -> Column:
    return F.size(F.filter(tails, test))


def finding(rule, severity, analyte: str | None, headline, detail: Column, rows: Column, who: list[str]) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(text(rule).alias("rule"), text(severity).alias("severity"), F.lit(analyte).cast("string").alias("analyte"), text(headline).alias("headline"), detail.alias("detail"), rows.cast(EVIDENCE).alias("evidence"), names(who).alias("audience"))


def conjunction(rule: str, lead: str, wanted: dict[str, int], head: str, gloss: str, note: str = "") -> Column:
    """A finding where every analyte moves the wanted way, else null."""
    tails = F.array(*[tail(a) for a in wanted])
    fits = F.lit(True)
    for a, d in wanted.items():
        fits = fits & F.coalesce(tail(a)["dir"] == d, F.lit(False))
    ends = F.transform(F.flatten(F.transform(tails, lambda t: F.array(t["first"], t["last"]))), lambda e: F.struct(e["day"].alias("day"), e["collected"].alias("collected")))
    a, b = F.array_min(ends), F.array_max(ends)
    when = span(a["collected"], b["collected"], a["day"], b["day"])
    detail = F.trim(F.concat(F.lit(f"{gloss} over "), when, F.lit(": "), parts_of(tails), F.lit(f". {note}")))
    return F.when(fits, finding(rule, "high", lead, head, detail, rows_of(tails), X.BOTH))


def infection(markers: list[str] = X.INFECTION_MARKERS, lead: str = "procalcitonin") -> Column:
    """Three markers or more that rise, or fall while none rises, of three measured ones or more."""
    have = measured(markers)
    up, down = count(have, lambda t: t["dir"] > 0), count(have, lambda t: t["dir"] < 0)
    moving = F.filter(have, lambda t: t["dir"] != 0)
    told = lambda n, word: F.concat(n.cast("string"), F.lit(" of "), F.size(have).cast("string"), F.lit(f" infection markers {word}: "), parts_of(moving), F.lit("."))
    rises = finding("infection-cluster", F.when(up >= 4, "high").otherwise("moderate"), lead, X.INFECTION_HEAD, told(up, "rising"), rows_of(moving), X.BOTH)
    falls = finding("infection-improving", "info", lead, X.SETTLING_HEAD, told(down, "falling"), rows_of(moving), X.BOTH)
    return F.when(F.size(have) >= 3, F.when(up >= 3, rises).when((down >= 3) & (up == 0), falls))


def perfusion(marker: str = "lactate") -> Column:
    t = tail(marker)
    last = t["last"]
    when = span(t["first"]["collected"], last["collected"], t["first"]["day"], last["day"])
    detail = F.trim(F.concat(F.lit("Lactate "), chain(t["points"], last["unit"]), F.lit(" ("), when, F.lit("). "), reference_sentence(last["low"], last["high"])))
    severity = F.when(last["value"] > last["high"], "high").otherwise("moderate")
    return F.when(t["dir"] > 0, finding("perfusion", severity, marker, X.PERFUSION_HEAD, detail, evidence(t["points"]), X.BOTH))


def low_oxygen(marker: str = "abg_po2") -> Column:
    """A last value, of however old a day, below its range."""
    last = tail(marker)["last"]
    when = span(last["collected"], last["collected"], last["day"], last["day"])
    detail = F.concat(F.lit("pO2 "), general(last["value"]), unit_text(last["unit"]), F.lit(" ("), when, F.lit("). "), reference_sentence(last["low"], last["high"]))
    return F.when(last["value"] < last["low"], finding("low-oxygen", "moderate", marker, X.OXYGEN_HEAD, detail, evidence(F.array(F.struct(last["day"].alias("day"), last["value"].alias("value")))), X.BOTH))


def discordance(one: list[str] = X.INFECTION_MARKERS, other: list[str] = X.LIVER_MARKERS) -> Column:
    """Infection settles while the liver gets worse, or the other way round."""
    have, liver = measured(one), measured(other)
    up, down = count(have, lambda t: t["dir"] > 0), count(have, lambda t: t["dir"] < 0)
    worse = count(liver, lambda t: (t["dir"] != 0) & (t["dir"] == t["last"]["valence"]))
    better = count(liver, lambda t: (t["dir"] != 0) & (t["dir"] == -t["last"]["valence"]))
    rows = rows_of(F.concat(have, liver))
    first = finding("discordance", "moderate", None, X.LIVER_WORSE_HEAD, F.format_string(X.LIVER_WORSE_DETAIL, down, F.size(have), worse, F.size(liver)), rows, X.DOCTOR)
    second = finding("discordance", "moderate", None, X.LIVER_BETTER_HEAD, F.format_string(X.LIVER_BETTER_DETAIL, up, F.size(have), better, F.size(liver)), rows, X.DOCTOR)
    return F.when(F.size(have) >= 2, F.when((down >= 2) & (up == 0) & (worse >= 2), first).when((up >= 2) & (better >= 2) & (worse == 0), second))


def tail_rules() -> list[Column]:
    """The rules over a patient's tails; a caller may give others."""
    return [
        conjunction("synthetic-failure", "inr", X.FAILURE, X.FAILURE_HEAD, X.FAILURE_GLOSS),
        infection(),
        conjunction("renal-cluster", "creatinine", X.RENAL, X.RENAL_HEAD, X.RENAL_GLOSS, X.RENAL_NOTE),
        perfusion(),
        low_oxygen(),
        discordance(),
    ]


def tail_findings(points: DataFrame, rules: list[Column] | None = None) -> DataFrame:
    found = F.filter(F.array(*(tail_rules() if rules is None else rules)), lambda f: f.isNotNull())
    return patient_tails(points).select("patient_id", F.inline(found)).select(*SHAPE)


def findings(points: DataFrame, obs: DataFrame, scores: DataFrame, rules: list[Column] | None = None) -> DataFrame:
    """Findings of all ten rules."""
    found = runs(points)
    parts = [run_findings(found), delta_findings(points, found), crossing_findings(points), critical_findings(obs), meld_findings(scores), tail_findings(points, rules)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.withColumn("evidence", F.col("evidence").cast(EVIDENCE)))
    return out


def rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RANKS]), severity)


def ordered(found: DataFrame) -> DataFrame:
    """Findings with their ``place`` among the patient's: severity, rule, analyte, first day."""
    w = Window.partitionBy("patient_id").orderBy(rank(F.col("severity")), "rule", F.coalesce("analyte", F.lit("")), F.get("evidence", F.lit(0))["day"], "detail")
    return found.withColumn("place", F.row_number().over(w))


def grouped(found: DataFrame, entries: DataFrame) -> DataFrame:
    """A patient's findings of one severity whose headlines differ in the analyte's name only, as one.

    The name's place in the headline is found by position, in any case, and cut out.  Rows: ``patient_id, severity, title, n, items, place``,
    where ``items`` are label and detail in order of the label, and ``place`` goes by severity, number, and first finding.
    ``entries`` is the dictionary.
    """
    f = described(ordered(found), entries, ["display"]).withColumn("label", F.when(F.col("analyte").isNotNull(), F.coalesce("display", "analyte")).otherwise(""))
    at = F.when(F.col("label") != "", F.instr(F.lower("headline"), F.lower("label"))).otherwise(0)
    f = f.withColumn("at", at).withColumns({"before": F.when(F.col("at") > 0, F.substring("headline", F.lit(1), F.col("at") - 1)).otherwise(F.col("headline")), "after": F.when(F.col("at") > 0, F.substring("headline", F.col("at") + F.length("label"), F.length("headline")))})
    g = f.groupBy("patient_id", "severity", "before", "after").agg(F.min("place").alias("first"), F.min_by("headline", "place").alias("headline"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("label", "place", "detail"))).alias("sorted"))
    labels = F.filter(F.transform("sorted", lambda i: i["label"]), lambda x: x != "")
    title = F.when((F.col("n") >= 2) & F.col("after").isNotNull(), group_title(F.col("before"), F.col("after"), labels)).otherwise(F.col("headline"))
    w = Window.partitionBy("patient_id").orderBy(rank(F.col("severity")), F.col("n").desc(), "first")
    items = F.transform("sorted", lambda i: F.struct(i["label"].alias("label"), i["detail"].alias("detail")))
    return g.select("patient_id", "severity", title.alias("title"), "n", items.alias("items"), F.row_number().over(w).alias("place"))
