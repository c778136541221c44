"""Operators over series of observations: points per day, runs, jumps, crossings, trends, carries.

All windows are per patient and analyte; where input order decides, ``seq`` breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fixed, in_range, range_width, step_direction

KEYS = ["patient_id", "analyte"]
NOISE, RUN_STEPS, RUN_NET, JUMP, TREND_DAYS = 0.03, 2, 0.10, 0.5, 3


def series(*order: str):
    return Window.partitionBy(*KEYS).orderBy(*(order or ("day",)))


def last_of_day(obs: DataFrame, first_wins: bool = False) -> DataFrame:
    """One point per patient, analyte and day: the last reading; of ties the later row, or the first."""
    seq = -F.col("seq") if first_wins else F.col("seq")
    keep = [c for c in obs.columns if c not in (*KEYS, "day")]
    best = F.max_by(F.struct(*keep), F.struct(F.col("collected"), seq.alias("s")))
    return obs.filter("value is not null").groupBy(*KEYS, "day").agg(best.alias("o")).select(*KEYS, "day", "o.*")


def steps(points: DataFrame) -> DataFrame:
    """Points with the one before: ``p_value, p_day``, and the direction of the step."""
    w = series()
    return points.withColumns({"p_value": F.lag("value").over(w), "p_day": F.lag("day").over(w)}).withColumn("dir", step_direction(F.col("p_value"), F.col("value"), NOISE))


def islands(points: DataFrame) -> DataFrame:
    """Steps with ``island``, the number of their stretch of steps in one direction."""
    w = series()
    s = steps(points)
    turn = F.when(F.col("dir").eqNullSafe(F.lag("dir").over(w)), 0).otherwise(1)
    return s.withColumn("turn", turn).withColumn("island", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def monotonic_runs(points: DataFrame) -> DataFrame:
    """Maximal runs of at least three points in one direction with a net change of at least 10 %.

    Islands of equal step direction that isn't 0; a turning point belongs to both runs.
    """
    s = islands(points)
    runs = s.filter("dir <> 0").groupBy(*KEYS, "island", "dir").agg(F.count("*").alias("n"), F.min("p_day").alias("first_day"), F.max("day").alias("last_day"), F.min_by("p_value", "day").alias("first_value"), F.max_by("value", "day").alias("last_value"), F.first("valence").alias("valence"))
    base = F.coalesce(F.nullif(F.abs("first_value"), F.lit(0.0)), F.lit(1.0))
    net = F.abs(F.col("last_value") - F.col("first_value")) / base
    return runs.filter(F.col("n") >= RUN_STEPS).filter(net >= RUN_NET).select(*KEYS, "dir", (F.col("n") + 1).alias("points"), "first_day", "last_day", "first_value", "last_value", "valence")


def run_findings(points: DataFrame) -> DataFrame:
    """Runs as findings: worse is high from five points on, else moderate; better and neutral are info."""
    worse = F.col("dir") == F.col("valence")
    severity = F.when(worse & (F.col("points") >= 5), "high").when(worse, "moderate").otherwise("info")
    return monotonic_runs(points).select(F.when(F.col("dir") > 0, "rising-run").otherwise("falling-run").alias("rule"), severity.alias("severity"), *KEYS, "first_day", "last_day", "points", "first_value", "last_value")


def next_day_jumps(points: DataFrame) -> DataFrame:
    """The largest jump from one day to the next per series.

    A jump is a change of over 50 %, or of over the width of the range; it is an echo, and
    left out, if both days lie in one run and the change is at most 100 %.
    """
    s = steps(points).filter("day - p_day = 1")
    delta = F.col("value") - F.col("p_value")
    rel = F.abs(delta) / F.coalesce(F.nullif(F.abs("p_value"), F.lit(0.0)), F.lit(1.0))
    width = F.col("high") - F.col("low")
    by_rel, by_width = rel > JUMP, F.coalesce(F.abs(delta) > width, F.lit(False))
    s = s.withColumns({"rel": rel, "delta": delta, "both": by_rel & by_width}).filter(by_rel | by_width)
    r = monotonic_runs(points).select(F.col("patient_id").alias("rp"), F.col("analyte").alias("ra"), F.col("first_day").alias("rf"), F.col("last_day").alias("rl"))
    inside = (F.col("patient_id") == F.col("rp")) & (F.col("analyte") == F.col("ra")) & (F.col("p_day") >= F.col("rf")) & (F.col("day") <= F.col("rl")) & (F.col("rel") <= 1.0)
    s = s.join(r, inside, "left_anti")
    best = Window.partitionBy(*KEYS).orderBy(F.col("rel").desc(), "day")
    worse = F.sign("delta").cast("int") == F.col("valence")
    severity = F.when(worse & F.col("both"), "high").when(worse, "moderate").otherwise("info")
    return s.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select(*KEYS, "p_day", "day", "p_value", "value", severity.alias("severity"))


def range_crossings(points: DataFrame) -> DataFrame:
    """Steps out of the range (numbered per series) and back into it."""
    w = series()
    s = points.withColumn("inside", in_range(F.col("value"), F.col("low"), F.col("high"))).withColumn("was", F.lag("inside").over(w)).withColumn("p_day", F.lag("day").over(w))
    s = s.withColumn("exit", F.when(F.col("was") & ~F.col("inside"), 1).otherwise(0)).withColumn("ordinal", F.sum("exit").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.filter("inside <> was")
    kind = F.when(F.col("exit") == 1, "range-exit").otherwise("range-return")
    severity = F.when(F.col("exit") == 0, "info").when(F.col("system") == "A", "high").otherwise("moderate")
    return s.select(kind.alias("rule"), severity.alias("severity"), *KEYS, "p_day", "day", "value", F.when(F.col("exit") == 1, F.col("ordinal")).alias("ordinal"))


#: Marks of a critical value, printed or interpreted.
CRITICAL = ("CH", "CL", "HH", "LL")


def critical_flags(obs: DataFrame) -> DataFrame:
    """Series with a critical mark: critical while no later day exists, high afterwards.

    The mark is the printed flag or, where there is such a column, the interpretation, in any case and
    with white space around it. Rows without a value don't count, where there is a column of values.
    """
    clean = lambda c: F.upper(F.regexp_replace(c, r"^\s+|\s+$", ""))
    crit = F.lit(False)
    for c in ("printed_flag", "interpretation"):
        if c in obs.columns:
            crit = crit | F.coalesce(clean(F.col(c)).isin(*CRITICAL), F.lit(False))
    if "value" in obs.columns:
        obs = obs.filter("value is not null")
    g = obs.groupBy(*KEYS).agg(F.max("day").alias("latest"), F.max(F.when(crit, F.col("day"))).alias("flagged"), F.count_if(crit).alias("n_flags"))
    return g.filter("flagged is not null").select(F.when(F.col("latest") > F.col("flagged"), "high").otherwise("critical").alias("severity"), *KEYS, "flagged", "latest", "n_flags")


def score_escalation(scores: DataFrame, least: float, days: int = 2, first_wins: bool = False) -> DataFrame:
    """The largest rise of a score within ``days`` days per patient; ``patient_id, day, score``.

    Of equal rises that from the latest day, or from the first; of these, that to the latest day.
    A range frame over day numbers finds the earlier scores; no self-join.
    """
    w = Window.partitionBy("patient_id").orderBy("day").rangeBetween(-days, -1)
    sign = -1 if first_wins else 1
    rises = F.transform("earlier", lambda e: F.struct((F.col("score") - e["score"]).alias("rise"), (sign * e["day"]).alias("d"), e["score"].alias("p_score"), "day", "score"))
    s = scores.filter("patient_id is not null").withColumn("earlier", F.collect_list(F.struct("day", "score")).over(w)).select("patient_id", F.array_max(rises).alias("b")).filter(F.col("b.rise") >= least)
    return s.groupBy("patient_id").agg(F.max("b").alias("b")).select("patient_id", fixed(F.col("b.rise")).alias("rise"), (sign * F.col("b.d")).alias("p_day"), "b.day", fixed(F.col("b.p_score")).alias("p_score"), fixed(F.col("b.score")).alias("score"))


def trends(points: DataFrame, days: int = TREND_DAYS) -> DataFrame:
    """First against last point among the last ``days`` days of a patient's record; silent below two points."""
    last = F.max("day").over(Window.partitionBy("patient_id"))
    t = points.withColumn("record_end", last).filter(F.col("day") > F.col("record_end") - days)
    t = t.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min_by("value", "day").alias("first_value"), F.max_by("value", "day").alias("last_value"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.first("valence").alias("valence"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("system").alias("system"))
    return t.filter("n >= 2").withColumn("dir", step_direction(F.col("first_value"), F.col("last_value"), NOISE))


def conjunction(moves: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """Patients of whom every named analyte moves in the wanted direction (relational division)."""
    fits = F.lit(False)
    for analyte, d in wanted.items():
        fits = fits | ((F.col("analyte") == analyte) & (F.col("dir") == d))
    g = moves.filter(F.col("analyte").isin(list(wanted))).groupBy("patient_id").agg(F.count_if(fits).alias("n_fit"))
    return g.filter(F.col("n_fit") == len(wanted)).select("patient_id", F.lit(len(wanted)).cast("long").alias("n_members"))


def clusters(moves: DataFrame, members: list[str], least: int = 3) -> DataFrame:
    """Patients of whom at least ``least`` members were measured and moved together."""
    g = moves.filter(F.col("analyte").isin(members)).groupBy("patient_id").agg(F.count("*").alias("measured"), F.count_if(F.col("dir") > 0).alias("up"), F.count_if(F.col("dir") < 0).alias("down"))
    rule = F.when(F.col("up") >= least, "cluster").when((F.col("down") >= least) & (F.col("up") == 0), "improving")
    severity = F.when(F.col("up") >= 4, "high").when(F.col("up") >= least, "moderate").otherwise("info")
    return g.filter(F.col("measured") >= least).withColumn("rule", rule).filter("rule is not null").select("rule", severity.alias("severity"), "patient_id", "measured", "up", "down")


def discordance(moves: DataFrame, one: str, other: str, least: int = 1) -> DataFrame:
    """Patients of whom the two systems move against each other; ``least`` of the other got worse or better."""
    a, b = F.col("system") == one, F.col("system") == other
    worse, better = F.col("dir") == F.col("valence"), F.col("dir") == -F.col("valence")
    g = moves.groupBy("patient_id").agg(F.count_if(a).alias("measured"), F.count_if(a & (F.col("dir") > 0)).alias("up"), F.count_if(a & (F.col("dir") < 0)).alias("down"), F.count_if(b & worse).alias("worse"), F.count_if(b & better).alias("better"))
    first = (F.col("down") >= 2) & (F.col("up") == 0) & (F.col("worse") >= least)
    second = (F.col("up") >= 2) & (F.col("better") >= least) & (F.col("worse") == 0)
    return g.filter((F.col("measured") >= 2) & (first | second)).select("patient_id", F.when(first, "down-but-worse").otherwise("up-but-better").alias("kind"), "up", "down", "worse", "better")


def carried(points: DataFrame, max_days: int | None = 2) -> DataFrame:
    """The last value of each series on every day of the patient's record, at most ``max_days`` old."""
    days = points.select("patient_id", "day").distinct()
    spine = points.select(*KEYS).distinct().join(days, "patient_id")
    w = Window.partitionBy(*KEYS).orderBy("day").rangeBetween(Window.unboundedPreceding if max_days is None else -max_days, 0)
    full = spine.join(points.select(*KEYS, "day", "value"), [*KEYS, "day"], "left")
    last = F.last(F.when(F.col("value").isNotNull(), F.struct("value", "day")), ignorenulls=True).over(w)
    return full.withColumn("last", last).filter("last is not null").select(*KEYS, "day", F.col("last.value").alias("value"), F.col("last.day").alias("from_day"), (F.col("day") - F.col("last.day")).alias("days_old"))


def asof_backward(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Each left row with the value of the latest right row at or before it, per ``by``.

    One union and one window, so one shuffle; of right rows at one place the last by ``seq`` counts.
    """
    both = left.select(by, at, F.lit(1).alias("side"), F.struct(*left.columns).alias("row"), F.lit(None).cast(right.schema[value].dataType).alias("found"), F.lit(None).cast("long").alias("seq"))
    both = both.unionByName(right.select(by, at, F.lit(0).alias("side"), F.lit(None).cast(both.schema["row"].dataType).alias("row"), F.col(value).alias("found"), F.col("seq").cast("long")))
    w = Window.partitionBy(by).orderBy(at, "side", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last("found", ignorenulls=True).over(w)).filter("side = 1").select("row.*", F.col("found").alias(value))


def movement(points: DataFrame) -> DataFrame:
    """First against last of each series: percent and direction (flat below 5 %)."""
    g = points.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min_by("value", "day").alias("first_value"), F.max_by("value", "day").alias("last_value"), F.first("valence").alias("valence"))
    pct = (F.col("last_value") - F.col("first_value")) / F.abs("first_value") * 100
    g = g.filter("n >= 2 and first_value <> 0").withColumn("pct", pct)
    kind = F.when(F.abs("pct") < 5, "flat").when(F.col("valence").isNull(), "changed").when(F.sign("pct") == F.col("valence"), "worse").otherwise("better")
    return g.withColumn("direction", kind)


def per_day_changes(points: DataFrame) -> DataFrame:
    """Per patient and day: newly out of range, better, worse (changes of at least 5 %), against the last earlier day."""
    w = series()
    out = ~in_range(F.col("value"), F.col("low"), F.col("high"))
    s = points.withColumn("out", F.coalesce(out, F.lit(False))).withColumns({"was_out": F.lag("out").over(w), "before": F.lag("value").over(w)})
    rel = F.abs(F.col("value") - F.col("before")) / F.coalesce(F.nullif(F.abs("before"), F.lit(0.0)), F.lit(1.0))
    moved = F.coalesce(rel >= 0.05, F.lit(False)) & F.col("valence").isNotNull()
    bad = F.sign(F.col("value") - F.col("before")) == F.col("valence")
    fresh = F.col("out") & ~F.coalesce("was_out", F.lit(False))
    s = s.withColumns({"fresh": fresh, "worse": moved & bad, "better": moved & ~bad})
    return s.groupBy("patient_id", "day").agg(F.count_if("fresh").alias("newly_abnormal"), F.count_if("better").alias("improved"), F.count_if("worse").alias("worsened"), F.array_join(F.slice(F.array_sort(F.collect_list(F.when(F.col("fresh"), F.col("analyte")))), 1, 6), ",").alias("names"))


def last_step_counts(points: DataFrame) -> DataFrame:
    """Per patient the numbers of series whose last step is worse or better."""
    w = series()
    s = points.withColumn("delta", F.col("value") - F.lag("value").over(w)).groupBy(*KEYS).agg(F.max_by("delta", "day").alias("delta"), F.first("valence").alias("valence"))
    bad = F.sign("delta") == F.col("valence")
    return s.groupBy("patient_id").agg(F.count_if(bad & (F.col("delta") != 0)).alias("worse"), F.count_if(~bad & (F.col("delta") != 0)).alias("better"))


def matrix_stats(points: DataFrame) -> DataFrame:
    """Per series: n, number out of range, latest value, and change in widths of the range."""
    out = F.coalesce(~in_range(F.col("value"), F.col("low"), F.col("high")), F.lit(False))
    g = points.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if(out).alias("out_n"), F.max_by("value", "day").alias("latest"), F.min_by("value", "day").alias("first_value"), F.first("low").alias("low"), F.first("high").alias("high"))
    return g.select(*KEYS, "n", "out_n", "latest", fixed(F.abs(F.col("latest") - F.col("first_value")) / range_width(F.col("low"), F.col("high"), F.col("first_value"))).alias("magnitude"))


def flagged(value: Column, low: Column, high: Column) -> Column:
    return F.coalesce(~in_range(value, low, high), F.lit(False))
