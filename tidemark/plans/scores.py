"""Composite scores as struct columns ``value, complete, missing, band``.

A score with missing inputs has no value; which inputs are missing is listed in the order
of declaration.  Inputs are never defaulted.  The scores are computational
demonstrations and not medical advice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.exprs import clamp, fixed, half_up, points


def result(value: Column, inputs: dict[str, Column], band: Column | None = None) -> Column:
    missing = F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in inputs.items()]))
    complete = F.size(missing) == 0
    return F.struct(F.when(complete, value).cast("double").alias("value"), complete.alias("complete"), missing.alias("missing"), F.when(complete, band if band is not None else F.lit("")).otherwise("").alias("band"))


def meld_band(v: Column) -> Column:
    return F.when(v >= 40, "40").when(v >= 30, "30-39").when(v >= 20, "20-29").when(v >= 10, "10-19").otherwise("under 10")


def meld3(bilirubin: Column, inr: Column, creatinine: Column, sodium: Column, albumin: Column, female: Column, dialysis: Column) -> Column:
    b, i = F.greatest(bilirubin, F.lit(1.0)), F.greatest(inr, F.lit(1.0))
    cr = F.when(dialysis, 3.0).otherwise(clamp(creatinine, 1.0, 3.0))
    na, alb = clamp(sodium, 125.0, 137.0), clamp(albumin, 1.5, 3.5)
    raw = 1.33 * F.when(female, 1).otherwise(0) + 4.56 * F.ln(b) + 0.82 * (137 - na) - 0.24 * (137 - na) * F.ln(b) + 9.09 * F.ln(i) + 11.14 * F.ln(cr) + 1.85 * (3.5 - alb) - 1.83 * (3.5 - alb) * F.ln(cr) + 6
    value = clamp(half_up(raw), 6, 40)
    return result(value, {"bilirubin": bilirubin, "inr": inr, "creatinine": creatinine, "sodium": sodium, "albumin": albumin, "female": female, "dialysis": dialysis}, meld_band(value))


def meld_na(bilirubin: Column, inr: Column, creatinine: Column, sodium: Column, dialysis: Column) -> Column:
    b, i = F.greatest(bilirubin, F.lit(1.0)), F.greatest(inr, F.lit(1.0))
    cr = F.when(dialysis, 4.0).otherwise(clamp(creatinine, 1.0, 4.0))
    na = clamp(sodium, 125.0, 137.0)
    first = F.floor((0.957 * F.ln(cr) + 0.378 * F.ln(b) + 1.12 * F.ln(i) + 0.643) * 100 + 0.5) / 10
    value = clamp(half_up(F.when(first > 11, first + 1.32 * (137 - na) - 0.033 * first * (137 - na)).otherwise(first)), 6, 40)
    return result(value, {"bilirubin": bilirubin, "inr": inr, "creatinine": creatinine, "sodium": sodium, "dialysis": dialysis}, meld_band(value))


GRADES = {"none": 1, "mild": 2, "slight": 2, "moderate": 3, "severe": 3}


def grade(text: Column, what: str, allowed: dict[str, int]) -> Column:
    """Points of a bedside grade; an unknown grade raises."""
    out = F.raise_error(F.concat(F.lit(f"unknown grade of {what}: "), text)).cast("int")
    for name, n in allowed.items():
        out = F.when(F.lower(text) == name, n).otherwise(out)
    return F.when(text.isNotNull(), out)


def child_pugh(bilirubin: Column, albumin: Column, inr: Column, ascites: Column, encephalopathy: Column) -> Column:
    alb = F.when(albumin > 3.5, 1).when(albumin < 2.8, 3).when(albumin.isNotNull(), 2)
    total = points(bilirubin, 2.0, 3.0) + alb + points(inr, 1.7, 2.3) + grade(ascites, "ascites", {"none": 1, "slight": 2, "moderate": 3}) + grade(encephalopathy, "encephalopathy", {"none": 1, "1-2": 2, "3-4": 3})
    return result(total, {"bilirubin": bilirubin, "albumin": albumin, "inr": inr, "ascites": ascites, "encephalopathy": encephalopathy}, F.when(total <= 6, "A").when(total <= 9, "B").otherwise("C"))


def aarc(bilirubin: Column, creatinine: Column, inr: Column, lactate: Column, encephalopathy: Column) -> Column:
    total = points(bilirubin, 15.0, 25.0) + points(creatinine, 0.7, 1.5) + points(inr, 1.8, 2.5) + points(lactate, 1.5, 2.5) + grade(encephalopathy, "encephalopathy", {"none": 1, "1-2": 2, "3-4": 3})
    return result(total, {"bilirubin": bilirubin, "creatinine": creatinine, "inr": inr, "lactate": lactate, "encephalopathy": encephalopathy}, F.when(total <= 7, "I").when(total <= 10, "II").otherwise("III"))


def nlr(anc: Column, alc: Column) -> Column:
    some = F.nullif(alc, F.lit(0.0))
    return result(fixed(anc / some, 2), {"anc": anc, "alc": some})


def anion_gap(sodium: Column, chloride: Column, bicarbonate: Column) -> Column:
    gap = fixed(sodium - (chloride + bicarbonate), 1)
    return result(gap, {"sodium": sodium, "chloride": chloride, "bicarbonate": bicarbonate}, F.when(gap.between(2, 26), "plausible").otherwise("implausible"))


def maddrey(pt: Column, control: Column, bilirubin: Column) -> Column:
    value = fixed(4.6 * (pt - control) + bilirubin, 1)
    return result(value, {"pt": pt, "control": control, "bilirubin": bilirubin}, F.when(value >= 32, "severe").otherwise("not severe"))


#: What each score is made of; for formula cards.
FORMULAS = [
    ("meld3", "bilirubin, inr, creatinine, sodium, albumin, female, dialysis", "6 to 40"),
    ("meld_na", "bilirubin, inr, creatinine, sodium, dialysis", "6 to 40"),
    ("child_pugh", "bilirubin, albumin, inr, ascites, encephalopathy", "5 to 15"),
    ("aarc", "bilirubin, creatinine, inr, lactate, encephalopathy", "5 to 15"),
    ("nlr", "anc, alc", "ratio"),
    ("anion_gap", "sodium, chloride, bicarbonate", "2 to 26"),
    ("maddrey", "pt, control, bilirubin", "32 or more is severe"),
]
