"""All scores of a patient on every day with a reading, from the day's last values and earlier ones.

Readings become one value for each patient, day and analyte by partial sums.  A second shuffle, of the days alone, brings a
patient together: a day's values are a map, and one window carries the last value and its day of each
analyte that may be carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scores as C

# Fixed values. What may be carried, for how many days, and how inputs and bands are called.
CARRIED = "bilirubin_total inr creatinine sodium albumin lactate".split()
CARRY_DAYS = 2
INPUTS = {"bilirubin": "bilirubin_total", "ascites": "ascites_grade", "encephalopathy": "encephalopathy_grade", "control": "pt_mnpt"}
GAS = {"sodium": "abg_sodium", "chloride": "abg_chloride", "bicarbonate": "abg_hco3"}
BANDS = {"under 10": "<=9", "40": ">=40", "plausible": "in-envelope", "implausible": "outside-envelope", "not severe": "non-severe"}
ASSUMPTION = "no renal replacement therapy in the prior week (not recorded in the lab data; confirm clinically)"
LACTATE_NOTE = "computed with blood-gas lactate (Lac), not a serum assay"
SCORES = "meld3 meld_na child_pugh aarc nlr anion_gap maddrey".split()


def day_values(obs: DataFrame) -> DataFrame:
    """``patient_id, day, collected, at``: the last value of each analyte of a day as a map, and the day's last time.

    Days all of whose readings lack a value are there, with an empty map.
    """
    last = F.max_by(F.when(F.col("value").isNotNull(), F.col("value")), F.when(F.col("value").isNotNull(), F.struct("collected", "seq")))
    each = obs.filter("day is not null").groupBy("patient_id", "day", "analyte").agg(last.alias("value"), F.max("collected").alias("collected")).repartition("patient_id")
    entry = F.when(F.col("analyte").isNotNull() & F.col("value").isNotNull(), F.struct("analyte", "value"))
    return each.groupBy("patient_id", "day").agg(F.max("collected").alias("collected"), F.map_from_entries(F.collect_list(entry)).alias("at"))


def carried_values(days: DataFrame, analytes: list[str] = CARRIED, most: int = CARRY_DAYS) -> DataFrame:
    """``days`` with ``vals``, in which missing ``analytes`` have their last value of at most ``most`` days, and ``carried_forward``."""
    w = Window.partitionBy("patient_id").orderBy("day").rangeBetween(-most, 0)
    own = lambda a: F.try_element_at(F.col("at"), F.lit(a))
    last = {f"tm_{i}": F.last(F.when(own(a).isNotNull(), F.struct(own(a).alias("value"), F.col("day").alias("from_day"))), ignorenulls=True).over(w) for i, a in enumerate(analytes)}
    d = days.select("*", *[c.alias(n) for n, c in last.items()])
    found = F.filter(F.array(*[F.struct(F.lit(a).alias("analyte"), F.col(n).alias("l")) for n, a in zip(last, analytes)]), lambda x: x["l"]["from_day"] < F.col("day"))
    d = d.withColumn("tm_found", found)
    vals = F.map_concat("at", F.map_from_entries(F.transform("tm_found", lambda x: F.struct(x["analyte"], x["l"]["value"]))))
    past = F.map_from_entries(F.transform("tm_found", lambda x: F.struct(x["analyte"], F.struct(x["l"]["from_day"].alias("from_day"), (F.col("day") - x["l"]["from_day"]).alias("days_old")))))
    return d.withColumns({"vals": vals, "carried_forward": past}).drop(*last, "tm_found")


def named(score: Column, inputs: dict[str, str], note: str | None = None, assumption: str | None = None) -> Column:
    """A score with the dictionary's names of its inputs, its band's name, notes and assumptions."""
    called = lambda names: lambda x: F.coalesce(F.try_element_at(F.create_map(*[F.lit(t) for pair in names.items() for t in pair]), x), x)
    texts = lambda t: F.array(F.lit(t)) if t else F.array().cast("array<string>")
    return F.struct(score["value"].alias("value"), score["complete"].alias("complete"), F.transform(score["missing"], called(inputs)).alias("missing"), called(BANDS)(score["band"]).alias("band"), texts(note).alias("notes"), texts(assumption).alias("assumptions"))


def daily_scores(obs: DataFrame, carried: list[str] = CARRIED, most: int = CARRY_DAYS) -> DataFrame:
    """``patient_id, day, collected, carried_forward`` and the seven scores, one row for each patient and day.

    Sex and dialysis are taken as male and none, and the result says the latter; bedside grades aren't laboratory values, so scores that
    need them are incomplete.  Only ``carried`` may come from an earlier day.
    """
    d = carried_values(day_values(obs), carried, most)
    v = lambda a: F.try_element_at(F.col("vals"), F.lit(a))
    no, grade = F.lit(False), F.lit(None).cast("string")
    b, i, cr, na, alb = (v(a) for a in ("bilirubin_total", "inr", "creatinine", "sodium", "albumin"))
    made = {
        "meld3": named(C.meld3(b, i, cr, na, alb, no, no), INPUTS, assumption=ASSUMPTION),
        "meld_na": named(C.meld_na(b, i, cr, na, no), INPUTS),
        "child_pugh": named(C.child_pugh(b, alb, i, grade, grade), INPUTS),
        "aarc": named(C.aarc(b, cr, i, v("lactate"), grade), INPUTS, note=LACTATE_NOTE),
        "nlr": named(C.nlr(v("anc"), v("alc")), INPUTS),
        "anion_gap": named(C.anion_gap(v("abg_sodium"), v("abg_chloride"), v("abg_hco3")), GAS),
        "maddrey": named(C.maddrey(v("pt"), v("pt_mnpt"), b), INPUTS),
    }
    return d.select("patient_id", "day", "collected", "carried_forward", *[c.alias(n) for n, c in made.items()])


def formula_cards(scores: DataFrame) -> DataFrame:
    """What each score is made of beside what it says on each patient's latest day: value, or what was missing, and notes."""
    last = scores.groupBy("patient_id").agg(F.max_by(F.struct("day", *SCORES), "day").alias("s"))
    cards = [F.struct(F.lit(n).alias("name"), F.lit(inputs).alias("inputs"), F.lit(scale).alias("scale"), *[F.col(f"s.{n}.{f}").alias(f) for f in ("complete", "value", "missing", "notes")]) for n, inputs, scale in C.FORMULAS]
    return last.select("patient_id", F.col("s.day").alias("day"), F.inline(F.array(*cards)))
