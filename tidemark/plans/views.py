"""Dataset views: folds and burden of systems, pairs of series, matrices, glossary, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import fixed, fold_outside, heat_fold, in_range, range_label
from ..operators.series import KEYS, carried, movement, range_crossings, run_findings

SEVERITIES = ("critical", "high", "moderate", "info")


def severity_rank():
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))


def carried_folds(points: DataFrame) -> DataFrame:
    """Fold outside the range per patient, analyte and day, with values carried up to two days."""
    bounds = points.groupBy(*KEYS).agg(F.first("low").alias("low"), F.first("high").alias("high"), F.first("system").alias("system"))
    c = carried(points).join(bounds, KEYS)
    return c.withColumn("fold", fold_outside(F.col("value"), F.col("low"), F.col("high"))).filter("fold is not null")


def fold_tracks(points: DataFrame) -> DataFrame:
    """Tracks of folds of measured days; series of at least two points."""
    n = F.count("*").over(Window.partitionBy(*KEYS))
    p = points.withColumn("fold", fold_outside(F.col("value"), F.col("low"), F.col("high"))).filter("fold is not null").withColumn("n", n)
    return p.filter("n >= 2").select(*KEYS, "day", "fold")


def burden(points: DataFrame) -> DataFrame:
    """Mean fold per patient, system and day; how many tests, and how many measured that day."""
    return carried_folds(points).groupBy("patient_id", "system", "day").agg(fixed(F.avg("fold")).alias("mean_fold"), F.count("*").alias("n"), F.count_if(F.col("days_old") == 0).alias("fresh"), F.array_join(F.array_sort(F.collect_list("analyte")), ",").alias("tests"))


def system_state(points: DataFrame) -> DataFrame:
    """Burden of a system on its first and on its last day."""
    b = burden(points)
    return b.groupBy("patient_id", "system").agg(F.min_by("mean_fold", "day").alias("first_fold"), F.max_by("mean_fold", "day").alias("last_fold"), F.max("day").alias("last_day"))


def systems_by_fold(points: DataFrame) -> DataFrame:
    """Systems of each patient in order of their latest burden, the largest first; of equal ones by name."""
    w = Window.partitionBy("patient_id").orderBy(F.col("last_fold").desc(), "system")
    return system_state(points).select("patient_id", "system", "first_fold", "last_fold", F.row_number().over(w).alias("place"))


def directional_movers(points: DataFrame, top: int = 10) -> DataFrame:
    """The analytes of each patient that got worse or better by most, by percent; of equal ones by name."""
    w = Window.partitionBy("patient_id").orderBy(F.abs("pct").desc(), "analyte")
    m = movement(points).filter(F.col("direction").isin("worse", "better")).withColumn("place", F.row_number().over(w))
    return m.filter(F.col("place") <= top).select("patient_id", "analyte", fixed(F.col("pct")).alias("pct"), "direction", "place")


def couples(points: DataFrame, pairs: list[tuple[str, str]], least: int = 3) -> DataFrame:
    """Pairs of analytes on shared days, per patient with at least ``least`` of them.

    One conditional aggregation by day for all pairs, instead of self-joins.
    """
    names = sorted({x for p in pairs for x in p})
    wide = points.groupBy("patient_id", "day").agg(*[F.max(F.when(F.col("analyte") == x, F.col("value"))).alias(x) for x in names])
    rows = wide.select("patient_id", "day", F.inline(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(a).alias("first_value"), F.col(b).alias("second_value")) for a, b in pairs]))).filter("first_value is not null and second_value is not null")
    n = F.count("*").over(Window.partitionBy("patient_id", "first", "second"))
    return rows.withColumn("shared_days", n).filter(F.col("shared_days") >= least)


def correlations(points: DataFrame, names: list[str], least: int = 4) -> DataFrame:
    """Pearson's r of all pairs of analytes over all patients' shared days; constant series have none."""
    daily = points.groupBy("patient_id", "day").agg(*[F.max(F.when(F.col("analyte") == x, F.col("value"))).alias(x) for x in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    both = lambda a, b, c: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c))
    aggs = []
    for a, b in pairs:
        cov = F.covar_pop(both(a, b, a), both(a, b, b))
        spread = F.stddev_pop(both(a, b, a)) * F.stddev_pop(both(a, b, b))
        aggs += [F.try_divide(cov, F.nullif(spread, F.lit(0.0))).alias(f"r_{a}_{b}"), F.count(both(a, b, a)).alias(f"n_{a}_{b}")]
    wide = daily.agg(*aggs)
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"n_{a}_{b}").alias("n"), F.col(f"r_{a}_{b}").alias("r")) for a, b in pairs])))
    label = F.when(F.col("r") >= 0.3, "together").when(F.col("r") <= -0.3, "apart").otherwise("unrelated")
    return rows.filter((F.col("n") >= least) & F.col("r").isNotNull()).select("first", "second", "n", fixed(F.col("r")).alias("r"), label.alias("label"))


def compare_days(points: DataFrame, one: int, other: int) -> DataFrame:
    """Series measured on both days, with the change."""
    g = points.filter(F.col("day").isin(one, other)).groupBy(*KEYS).agg(F.max(F.when(F.col("day") == one, F.col("value"))).alias("before"), F.max(F.when(F.col("day") == other, F.col("value"))).alias("after"))
    return g.filter("before is not null and after is not null").withColumn("delta", fixed(F.col("after") - F.col("before")))


def heat_folds(points: DataFrame) -> DataFrame:
    return points.withColumn("fold", fixed(heat_fold(F.col("value"), F.col("low"), F.col("high")), 2))


def by_day(points: DataFrame, value: str = "value") -> DataFrame:
    """Series by day as rows, whatever the days are."""
    return points.select(*KEYS, "day", value)


def strips(points: DataFrame) -> DataFrame:
    """Number, least, median, largest and latest value of each series."""
    return points.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("value").alias("least"), fixed(F.median("value")).alias("middle"), F.max("value").alias("most"), F.max_by("value", "day").alias("latest"))


def glossary(points: DataFrame, obs: DataFrame) -> DataFrame:
    """Per analyte: number of points, patients, first, last, extremes, number outside, any critical flag."""
    outside = F.coalesce(~in_range(F.col("value"), F.col("low"), F.col("high")), F.lit(False))
    g = points.groupBy("analyte").agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("patients"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_if(outside).alias("n_outside"), range_label(F.first("low"), F.first("high")).alias("range"))
    c = obs.groupBy("analyte").agg(F.coalesce(F.bool_or(F.col("printed_flag").isin("CH", "CL")), F.lit(False)).alias("any_critical"))
    return g.join(c, "analyte")


def flowsheet(obs: DataFrame) -> DataFrame:
    """Every reading with the change from the one before and, where a day has several, its time."""
    w = Window.partitionBy(*KEYS).orderBy("collected", "seq")
    earlier = F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    several = F.count("*").over(Window.partitionBy(*KEYS, "day"))
    label = F.when(several > 1, F.date_format("collected", "yyyy-MM-dd HH:mm")).otherwise(F.date_format("collected", "yyyy-MM-dd"))
    return obs.select(*KEYS, "seq", label.alias("at"), "value", fixed(F.col("value") - earlier).alias("delta"))


def findings(points: DataFrame) -> DataFrame:
    """Findings of runs and crossings in one frame."""
    runs = run_findings(points).select("rule", "severity", *KEYS, F.col("first_day").alias("from_day"), F.col("last_day").alias("to_day"))
    crossings = range_crossings(points).select("rule", "severity", *KEYS, F.col("p_day").alias("from_day"), F.col("day").alias("to_day"))
    return runs.unionByName(crossings)


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The first findings by severity, rule, analyte, patient and day."""
    order = [severity_rank(), "rule", "analyte", "patient_id", "from_day"]
    w = Window.orderBy(*order)
    first = found.orderBy(*order).limit(top)
    return first.select(F.row_number().over(w).alias("place"), "severity", "rule", *KEYS, "from_day", "to_day")


def timeline(found: DataFrame, top: int = 18) -> DataFrame:
    """Findings of at least moderate severity by severity and first day, per patient."""
    w = Window.partitionBy("patient_id").orderBy(severity_rank(), "from_day", "rule", "analyte")
    return found.filter(severity_rank() <= 3).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top).select("patient_id", "place", "severity", "rule", "analyte", "from_day")


def top_movers(points: DataFrame, top: int = 40) -> DataFrame:
    m = movement(points)
    return m.orderBy(F.abs("pct").desc(), *KEYS).limit(top).select(*KEYS, fixed(F.col("pct")).alias("pct"), "direction")


def filter_observations(df: DataFrame, days=None, analytes=None, groups=None, abnormal=False, critical=False, text: str | None = None) -> DataFrame:
    """The conjunctive filter of an interactive page; a missing choice lets everything through."""
    if days:
        df = df.filter(F.col("day").isin(list(days)))
    if analytes:
        df = df.filter(F.col("analyte").isin(list(analytes)))
    if groups:
        df = df.filter(F.col("system").isin(list(groups)))
    if abnormal:
        df = df.filter(F.col("interpretation") != "N")
    if critical:
        df = df.filter(F.col("interpretation").isin("HH", "LL"))
    if text:
        df = df.filter(F.contains(F.lower("analyte"), F.lit(text.lower())))
    return df


def state_to_hash(state: dict) -> str:
    """A filter's state as the fragment of an address."""
    from urllib.parse import urlencode

    names = {"days": "d", "analytes": "a", "groups": "g", "abnormal": "ab", "critical": "cr", "text": "q"}
    return urlencode({names[k]: ",".join(map(str, v)) if isinstance(v, (list, tuple)) else int(v) if isinstance(v, bool) else v for k, v in state.items() if v})


def hash_to_state(fragment: str) -> dict:
    from urllib.parse import parse_qs

    got = {k: v[0] for k, v in parse_qs(fragment.lstrip("#")).items()}
    out: dict = {}
    if "d" in got:
        out["days"] = [int(x) for x in got["d"].split(",") if x.isdigit()]
    for k, name in (("a", "analytes"), ("g", "groups")):
        if k in got:
            out[name] = got[k].split(",")
    for k, name in (("ab", "abnormal"), ("cr", "critical")):
        if got.get(k) == "1":
            out[name] = True
    if "q" in got:
        out["text"] = got["q"]
    return out
