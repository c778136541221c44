"""Reading tables and presenting them as observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = "struct<low:double,high:double,text:string>"
#: One measured value of one analyte on one specimen, as a schema in DDL.
OBSERVATION = (
    "patient_id long, analyte string, display string, sample_id string, collected timestamp, day int, kind string,"
    f"value double, text string, unit string, reference {RANGE}, reference_text string, interpretation string,"
    "printed_flag string, critical boolean, needs_review boolean, page long, seq long,"
    "provenance struct<page:long,bbox:array<int>,crop:string,ocr:map<string,double>,"
    "gates:map<string,struct<state:string,detail:string>>,human_verified:boolean>"
)

FIRST_DAY = "2024-01-01"
#: Bounds, direction in which a rise is bad (+1) or good (-1), and system of each event type.
ANALYTES = [
    ("view", 10.0, 60.0, 1, "A"),
    ("click", 10.0, 60.0, -1, "A"),
    ("signup", None, 80.0, -1, "B"),
    ("error", 3.0, None, 1, "B"),
    ("purchase", None, None, None, "C"),
]
DICTIONARY = "analyte string, low double, high double, valence int, system string"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dictionary(spark: SparkSession) -> DataFrame:
    """The analyte dictionary; its size is fixed."""
    return spark.createDataFrame(ANALYTES, DICTIONARY)


def pick(analyte: Column, of: int, kind: str) -> Column:
    """A dictionary value as an expression, so that no join is needed for the fixed dictionary."""
    out = F.lit(None).cast(kind)
    for row in ANALYTES:
        if row[of] is not None:
            out = F.when(analyte == row[0], F.lit(row[of]).cast(kind)).otherwise(out)
    return out


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as observations: flat columns, three readings ``a, b, c`` per value."""
    e = read(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    o = e.select(F.col("user_id").alias("patient_id"), F.col("event_type").alias("analyte"), F.col("ts").alias("collected"), "value", F.col("event_id").alias("seq"), (F.datediff(F.to_date("ts"), F.to_date(F.lit(FIRST_DAY))) + 1).cast("int").alias("day"), k.alias("k"))
    o = o.withColumns({"low": pick(F.col("analyte"), 1, "double"), "high": pick(F.col("analyte"), 2, "double"), "valence": pick(F.col("analyte"), 3, "int"), "system": pick(F.col("analyte"), 4, "string")})
    o = o.withColumns({"a": F.col("value"), "b": F.when(F.col("k") % 7 == 0, F.col("value") * 10).otherwise(F.col("value")), "c": F.when(F.col("k") % 5 == 0, None).when(F.col("k") % 11 == 0, F.col("value") * 10).otherwise(F.col("value"))})
    from ..functions.exprs import interpret

    o = o.withColumn("interpretation", interpret(F.col("value"), F.col("low"), F.col("high")))
    i, v = F.col("interpretation"), F.col("value")
    flag = F.when(F.col("k") % 13 == 0, None).when(F.col("k") % 17 == 0, F.when(i == "H", "L").otherwise("H"))
    flag = flag.when(v > 3 * F.col("high"), "CH").when(v < F.col("low") / 3, "CL").when(i.isin("H", "L"), i)
    return o.withColumn("printed_flag", flag)


#: The same in DuckDB, as the start of a WITH clause.
OBS_SQL = """
WITH base AS (
  SELECT user_id AS patient_id, event_type AS analyte, ts AS collected, value, event_id AS seq,
         (date_diff('day', DATE '2024-01-01', ts::DATE) + 1)::INT AS day,
         regexp_extract(props, '([0-9]+)', 1)::INT AS k,
         CASE event_type WHEN 'view' THEN 10.0::DOUBLE WHEN 'click' THEN 10.0::DOUBLE WHEN 'error' THEN 3.0::DOUBLE END AS low,
         CASE event_type WHEN 'view' THEN 60.0::DOUBLE WHEN 'click' THEN 60.0::DOUBLE WHEN 'signup' THEN 80.0::DOUBLE END AS high,
         CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 WHEN 'signup' THEN -1 WHEN 'error' THEN 1 END AS valence,
         CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'A' WHEN 'signup' THEN 'B' WHEN 'error' THEN 'B' WHEN 'purchase' THEN 'C' END AS system
  FROM events),
read3 AS (
  SELECT *, value AS a, CASE WHEN k % 7 = 0 THEN value * 10 ELSE value END AS b,
         CASE WHEN k % 5 = 0 THEN NULL WHEN k % 11 = 0 THEN value * 10 ELSE value END AS c,
         CASE WHEN low IS NULL AND high IS NULL THEN NULL WHEN value > high THEN 'H' WHEN value < low THEN 'L' ELSE 'N' END AS interpretation
  FROM base),
obs AS (
  SELECT *, CASE WHEN k % 13 = 0 THEN NULL
                 WHEN k % 17 = 0 THEN CASE WHEN interpretation = 'H' THEN 'L' ELSE 'H' END
                 WHEN value > 3 * high THEN 'CH' WHEN value < low / 3 THEN 'CL'
                 WHEN interpretation IN ('H', 'L') THEN interpretation END AS printed_flag
  FROM read3)
"""

#: One point per patient, analyte and day: the day's last reading.
POINTS_SQL = OBS_SQL + """,
points AS (
  SELECT patient_id, analyte, day, arg_max(value, (collected, seq)) AS value, max(collected) AS collected,
         any_value(low) AS low, any_value(high) AS high, any_value(valence) AS valence, any_value(system) AS system
  FROM obs GROUP BY patient_id, analyte, day)
"""
