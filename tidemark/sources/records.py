"""Scans of JSON records and files with declared schemas, and the tables written back.

A path that doesn't exist is an empty table; records that don't fit their schema raise. A JSON
document is one record of one task, so large inputs come as many documents. Tables are written
beside the ones they were made from and never over them, so a lost executor or driver leaves
the table read as it was.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import OBSERVATION

READING = (
    "analyte string, display string, page int, unit string, reference_text string, printed_flag string, bbox array<int>,"
    "raw_test string, ocr map<string,double>, value double, sample_id string, collected string"
)
SAMPLE = "sample_id string, collected string, panel string, pages array<int>"
TIMES = "sample_id string, collected string, acknowledged string, reported string"
BAND = f"page int, {TIMES}"
MARK = "value double, on date, how string"
SHEET = "sheet int, analytes array<string>"


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of JSON documents, an array's elements one by one; none if there is no such path."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def raw_readings(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, f"observations array<struct<{READING}>>").select(F.inline("observations"))


def raw_samples(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, f"samples array<struct<{SAMPLE}>>").select(F.inline("samples"))


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """The observations of a finished dataset, in the fixed schema."""
    return json_rows(spark, path, f"observations array<struct<{OBSERVATION}>>").select(F.inline("observations"))


def bands(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, BAND)


def band_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Times of bands as people read them, a row per page."""
    rows = json_rows(spark, path, f"band_timestamps map<string,struct<{TIMES}>>").select(F.explode("band_timestamps").alias("page", "s"))
    return rows.select(F.col("page").cast("int").alias("page"), "s.*")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Verified values as ``key, value, on, how``."""
    return json_rows(spark, path, f"verified map<string,struct<{MARK}>>").select(F.explode("verified").alias("key", "s")).select("key", "s.*")


def sheet_analytes(spark: SparkSession, path: str) -> DataFrame:
    """What stands on each sheet for verification, as ``sheet, analyte``."""
    return json_rows(spark, path, SHEET).select("sheet", F.explode("analytes").alias("analyte"))


def texts(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """Whole files as ``path, content``."""
    found = spark.read.text(path, wholetext=True, pathGlobFilter=names, recursiveFileLookup=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def images(spark: SparkSession, path: str, names: str = "*.jpg", limit: int | None = None) -> DataFrame:
    """Files of images as ``path, length``, without their bytes; the first by path if a limit is given."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path).select("path", "length")
    return found if limit is None else found.orderBy("path").limit(limit)


def save(path: str, **tables: DataFrame) -> None:
    """Each table as Parquet in its folder under ``path``, which may not hold it yet."""
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{name}")


def key_of(page: Column, analyte: Column) -> Column:
    return F.concat_ws(":", page.cast("string"), analyte)


def upsert_ledger(old: DataFrame, targets: DataFrame, how: str, on: str) -> DataFrame:
    """The ledger with the values of ``targets`` (``page, analyte, value, seq``) marked as verified.

    A marked key replaces the old entry. Rows without a value, page or analyte mark nothing; of rows of
    one key the last by ``seq``, then the largest value, counts; of repeated old entries the latest.
    """
    usable = targets.filter("value is not null and page is not null and analyte is not null")
    last = F.max_by("value", F.struct("seq", "value"))
    new = usable.groupBy(key_of(F.col("page"), F.col("analyte")).alias("key")).agg(last.alias("value"))
    new = new.select("key", "value", F.lit(on).cast("date").alias("on"), F.lit(how).alias("how"), F.lit(1).alias("turn"))
    both = old.select("key", "value", "on", "how", F.lit(0).alias("turn")).unionByName(new)
    s = F.max(F.struct("turn", "on", "value", "how")).alias("s")
    return both.groupBy("key").agg(s).select("key", "s.value", "s.on", "s.how")


def read_again(obs: DataFrame, readings: DataFrame) -> DataFrame:
    """``obs`` with ``reading`` and whether a row was read again; of repeated readings of a ``seq`` the largest counts."""
    fresh = readings.groupBy(F.col("seq").alias("read_seq")).agg(F.max("reading").alias("reading"))
    return obs.join(fresh, F.col("seq") == F.col("read_seq"), "left").withColumn("was_read", F.col("read_seq").isNotNull()).drop("read_seq")


def update_pass(obs: DataFrame, readings: DataFrame, name: str = "C") -> DataFrame:
    """``obs`` with one pass of ``ocr`` replaced by new readings ``seq, reading``; rows that weren't read again stay."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    others = F.map_filter(F.coalesce("ocr", none), lambda k, _: k != name)
    with_new = F.map_concat(others, F.create_map(F.lit(name), F.col("reading")))
    return read_again(obs, readings).withColumn("ocr", F.when(F.col("was_read"), with_new).otherwise(F.col("ocr"))).drop("reading", "was_read")


def pass_tally(obs: DataFrame, readings: DataFrame) -> DataFrame:
    """How many values were read again, and how many of them agree, disagree and are blank, as one row."""
    r = read_again(obs, readings).filter("was_read")
    agrees = F.coalesce(F.abs(F.col("reading") - F.col("value")) < 1e-9, F.lit(False))
    blank = F.col("reading").isNull()
    return r.agg(F.count("*").alias("done"), F.count_if(agrees).alias("agree"), F.count_if(~agrees & ~blank).alias("disagree"), F.count_if(blank).alias("blank"))


def empty_pages(pages: DataFrame, obs: DataFrame) -> DataFrame:
    """Pages without any observation."""
    return pages.select("page").distinct().join(obs.select("page").distinct(), "page", "left_anti")


class Unverified(ValueError):
    """Values would be shown that nobody has verified."""


def check_verified(obs: DataFrame, verified: str = "provenance.human_verified", strict: bool = False) -> DataFrame:
    """Rows with a value that aren't verified; where ``strict``, any such row raises."""
    found = obs.filter(F.col("value").isNotNull() & ~F.coalesce(F.col(verified), F.lit(False)))
    if strict and (n := found.count()):
        raise Unverified(f"{n} shown values are not verified")
    return found
