"""``events`` in the roles of laboratory values, described by a dictionary table.

Each type of event is four analytes, told apart by the number in its properties; eight users are one patient, so that
patients grow with the table and have most analytes on most days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import HEADLINE, WORSE_WHEN_FALLING, WORSE_WHEN_RISING
from ..functions.exprs import interpret
from . import dictionary as D
from .tables import FIRST_DAY, read

TYPES = "view click signup error purchase".split()
USERS = 8
#: Events on one page.
PAGE = 40
#: Analyte, display name, unit, range, system, and the scale on which an event's value is the analyte's: ``base + value / part``.
ROLES = [
    ("bilirubin_total", "Total bilirubin", "mg/dL", 0.2, 1.2, "liver", 0.0, 20.0),
    ("inr", "INR", "", 0.8, 1.2, "clotting", 0.8, 60.0),
    ("creatinine", "Creatinine", "mg/dL", 0.7, 1.3, "kidney", 0.4, 60.0),
    ("sodium", "Sodium", "mEq/L", 135.0, 145.0, "kidney", 120.0, 5.0),
    ("albumin", "Albumin", "g/dL", 3.5, 5.0, "liver", 2.0, 60.0),
    ("lactate", "Lactate", "mmol/L", 0.5, 2.0, "gas", 0.5, 30.0),
    ("urea", "Urea", "mg/dL", 15.0, 40.0, "kidney", 10.0, 2.0),
    ("procalcitonin", "Procalcitonin", "ng/mL", None, 0.5, "infection", 0.0, 50.0),
    ("crp", "CRP", "mg/L", None, 5.0, "infection", 0.0, 2.0),
    ("wbc", "White cells", "cells/cumm", 4000.0, 10000.0, "blood", 3000.0, 0.01),
    ("neutrophils_pct", "Neutrophils", "%", 40.0, 80.0, "blood", 30.0, 5.0),
    ("nlr", "Neutrophils to lymphocytes", "", 1.0, 3.0, "blood", 1.0, 20.0),
    ("abg_po2", "Oxygen pressure", "mmHg", 80.0, None, "gas", 40.0, 2.0),
    ("anc", "Absolute neutrophils", "cells/cumm", 2000.0, 7000.0, "blood", 1000.0, 0.025),
    ("alc", "Absolute lymphocytes", "cells/cumm", 1000.0, 3000.0, "blood", 300.0, 0.1),
    ("pt", "Prothrombin time", "s", 11.0, 13.5, "clotting", 10.0, 10.0),
    ("pt_mnpt", "Mean normal prothrombin time", "s", None, None, "clotting", 11.0, 100.0),
    ("abg_sodium", "Sodium of the blood gas", "mEq/L", 136.0, 146.0, "gas", 125.0, 10.0),
    ("abg_chloride", "Chloride of the blood gas", "mEq/L", 98.0, 107.0, "gas", 90.0, 10.0),
    ("abg_hco3", "Bicarbonate", "mEq/L", 22.0, 28.0, "gas", 15.0, 10.0),
]


def valence(analyte: str) -> int | None:
    return 1 if analyte in WORSE_WHEN_RISING else -1 if analyte in WORSE_WHEN_FALLING else None


def dictionary(spark: SparkSession) -> DataFrame:
    """The roles as a dictionary table of one version."""
    return spark.createDataFrame([(a, 1, False, k, display, [a.replace("_", " ")], unit, low, high, valence(a), system, f"{display} of a patient.") for k, (a, display, unit, low, high, system, _, _) in enumerate(ROLES)], D.SCHEMA)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an observation, with its analyte's entry."""
    e = read(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    place = (F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")) - 1) * 4 + k % 4
    of = lambda i, kind: F.get(F.array(*[F.lit(r[i]).cast(kind) for r in ROLES]), place.cast("int"))
    day = (F.datediff(F.to_date("ts"), F.to_date(F.lit(FIRST_DAY))) + 1).cast("int")
    o = e.select(F.floor(F.col("user_id") / USERS).cast("long").alias("patient_id"), of(0, "string").alias("analyte"), F.col("ts").alias("collected"), day.alias("day"), F.col("event_id").alias("seq"), (of(6, "double") + F.col("value") / of(7, "double")).alias("value"), k.alias("k"), F.floor(F.col("event_id") / PAGE).cast("long").alias("page"))
    o = D.described(o, D.as_of(dictionary(spark)), ["display", "unit", "low", "high", "valence", "system"])
    v, i = F.col("value"), F.col("interpretation")
    o = o.withColumn("interpretation", interpret(v, F.col("low"), F.col("high")))
    flag = F.when(F.col("k") % 5 == 0, None).when(v > 3 * F.col("high"), "CH").when(v < F.col("low") / 3, "CL").when(i.isin("H", "L"), i)
    return o.withColumns({"printed_flag": flag, "headline": F.col("analyte").isin(HEADLINE)})


def literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)


#: The same in DuckDB, and the last reading of each day.
ROLE_SQL = f"""
WITH RECURSIVE roles AS (
  SELECT * FROM (VALUES {", ".join("(" + ", ".join(literal(x) for x in (k, *r, valence(r[0]))) + ")" for k, r in enumerate(ROLES))})
    t(place, analyte, display, unit, low, high, system, base, part, valence)),
raw AS (
  SELECT user_id // {USERS} AS patient_id, ts AS collected, event_id AS seq, event_id // {PAGE} AS page, value AS v, (date_diff('day', DATE '{FIRST_DAY}', ts::DATE) + 1)::INT AS day,
         regexp_extract(props, '([0-9]+)', 1)::INT AS k, list_position({TYPES!r}, event_type) - 1 AS t FROM events),
valued AS (
  SELECT patient_id, collected, seq, page, day, k, analyte, display, unit, low::DOUBLE AS low, high::DOUBLE AS high, valence, system, base::DOUBLE + v / part::DOUBLE AS value
  FROM raw JOIN roles ON place = t * 4 + k % 4),
obs AS (
  SELECT *, CASE WHEN low IS NULL AND high IS NULL THEN NULL WHEN value > high THEN 'H' WHEN value < low THEN 'L' ELSE 'N' END AS interpretation,
         CASE WHEN k % 5 = 0 THEN NULL WHEN value > 3 * high THEN 'CH' WHEN value < low / 3 THEN 'CL' WHEN value > high THEN 'H' WHEN value < low THEN 'L' END AS printed_flag,
         analyte IN ({", ".join(repr(h) for h in HEADLINE)}) AS headline
  FROM valued),
points AS (
  SELECT patient_id, analyte, day, arg_max(value, (collected, seq)) AS value, max(collected) AS collected, any_value(display) AS display, any_value(unit) AS unit,
         any_value(low) AS low, any_value(high) AS high, any_value(valence) AS valence, any_value(headline) AS headline
  FROM obs GROUP BY ALL)
"""
