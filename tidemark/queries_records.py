"""Queries over records written back, marks, sentences, labels and axes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixed_values as V
from .functions import exprs as X
from .functions import words as W
from .operators import quality as Q
from .operators import series as S
from .plans import checks as K
from .plans import layout as L
from .plans import views
from .queries_data import PRINTED_SQL, printed
from .queries_quality import FOLD_SQL
from .queries_series import points
from .sources import records as R
from .sources.tables import OBS_SQL, POINTS_SQL, observations, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- records ---------------------------------------------------------------------------------


@query("""WITH old AS (SELECT user_id || ':' || event_type AS key, arg_max(value, event_id) AS value FROM events WHERE event_id % 3 = 0 GROUP BY ALL),
new AS (SELECT user_id || ':' || event_type AS key, arg_max(value, event_id) AS value FROM events WHERE event_id % 5 = 0 AND event_id % 15 <> 0 AND value IS NOT NULL GROUP BY ALL)
SELECT key, CASE WHEN new.key IS NULL THEN old.value ELSE new.value END AS value, CASE WHEN new.key IS NULL THEN DATE '2024-01-01' ELSE DATE '2024-02-01' END AS "on",
CASE WHEN new.key IS NULL THEN 'first' ELSE 'second' END AS how FROM old FULL JOIN new USING (key)""")
def ledger_upsert(spark, sf_dir):
    o = observations(spark, sf_dir).select(F.col("patient_id").alias("page"), "analyte", "value", "seq")
    none = spark.createDataFrame([], "key string, value double, on date, how string")
    old = R.upsert_ledger(none, o.filter("seq % 3 = 0"), "first", "2024-01-01")
    targets = o.filter("seq % 5 = 0").withColumn("value", F.when(F.col("seq") % 15 != 0, F.col("value")))
    return R.upsert_ledger(old, targets, "second", "2024-02-01")


READ_AGAIN_SQL = "CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 5 = 0 THEN value * 2 ELSE value END"


def read_twice(spark, sf_dir):
    """Observations with three passes, and new readings of three in four."""
    o = observations(spark, sf_dir).select("seq", "value", F.create_map(F.lit("A"), "a", F.lit("B"), "b", F.lit("C"), "c").alias("ocr"))
    k = F.col("seq")
    return o, o.filter("seq % 4 <> 0").select("seq", F.when(k % 7 == 0, None).when(k % 5 == 0, F.col("value") * 2).otherwise(F.col("value")).alias("reading"))


@query(OBS_SQL + f"SELECT seq, a, b, CASE WHEN seq % 4 = 0 THEN c ELSE {READ_AGAIN_SQL} END AS c FROM obs")
def pass_update(spark, sf_dir):
    return R.update_pass(*read_twice(spark, sf_dir)).select("seq", *[F.col("ocr")[k].alias(k.lower()) for k in "ABC"])


@query(OBS_SQL + f""", r AS (SELECT value, {READ_AGAIN_SQL} AS reading FROM obs WHERE seq % 4 <> 0)
SELECT count(*) AS done, count(*) FILTER (abs(reading - value) < 1e-9) AS agree, count(*) FILTER (reading IS NOT NULL AND (abs(reading - value) < 1e-9) IS NOT TRUE) AS disagree,
count(*) FILTER (reading IS NULL) AS blank FROM r""")
def pass_tally(spark, sf_dir):
    return R.pass_tally(*read_twice(spark, sf_dir))


@query(OBS_SQL + "SELECT analyte, count(*) AS n FROM obs WHERE value IS NOT NULL AND seq % 3 <> 0 GROUP BY ALL")
def verification_pending(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("verified", F.col("seq") % 3 == 0)
    return R.check_verified(o, "verified").groupBy("analyte").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT user_id AS page FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL)")
def empty_pages(spark, sf_dir):
    o = observations(spark, sf_dir).withColumnRenamed("patient_id", "page")
    return R.empty_pages(o, o.filter("analyte = 'purchase'"))


# --- marks -----------------------------------------------------------------------------------

MARKED_SQL = OBS_SQL + """,
marked AS (SELECT patient_id, analyte, day, seq, system, CASE WHEN seq % 23 <> 0 THEN value END AS value, ' ' || lower(printed_flag) || ' ' AS printed_flag,
  CASE WHEN seq % 19 = 0 THEN 'HH' WHEN seq % 29 = 0 THEN 'LL' ELSE interpretation END AS interpretation FROM obs)
"""


def marked(spark, sf_dir):
    """Observations with marks in lower case and between spaces, interpretations HH and LL, and some without a value."""
    k = F.col("seq")
    o = observations(spark, sf_dir).withColumn("value", F.when(k % 23 != 0, F.col("value")))
    return o.withColumns({"printed_flag": F.concat(F.lit(" "), F.lower("printed_flag"), F.lit(" ")), "interpretation": F.when(k % 19 == 0, "HH").when(k % 29 == 0, "LL").otherwise(F.col("interpretation"))})


@query(MARKED_SQL + """, c AS (SELECT *, coalesce(upper(trim(printed_flag)) IN ('CH', 'CL', 'HH', 'LL'), false) OR coalesce(interpretation IN ('CH', 'CL', 'HH', 'LL'), false) AS crit FROM marked WHERE value IS NOT NULL),
g AS (SELECT patient_id, analyte, max(day) AS latest, max(day) FILTER (crit) AS flagged, count(*) FILTER (crit) AS n_flags FROM c GROUP BY ALL)
SELECT CASE WHEN latest > flagged THEN 'high' ELSE 'critical' END AS severity, * FROM g WHERE flagged IS NOT NULL""")
def critical_marks(spark, sf_dir):
    return S.critical_flags(marked(spark, sf_dir))


@query(MARKED_SQL + "SELECT seq, analyte, day FROM marked WHERE interpretation IN ('HH', 'LL') AND system = 'A'")
def critical_rows(spark, sf_dir):
    return views.filter_observations(marked(spark, sf_dir), groups=["A"], critical=True).select("seq", "analyte", "day")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 1 THEN 'IU/L' ELSE 'mg/dL' END AS unit, l_linenumber % 3 = 1 AS mismatch FROM lineitem")
def known_units(spark, sf_dir):
    k = F.col("l_linenumber") % 3
    u = Q.choose_unit(F.when(k == 0, "mg/dL").when(k == 1, "IU/L").otherwise("xyz"), F.lit("mg/dL"), V.KNOWN_UNITS)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", u.alias("u")).select("l_orderkey", "l_linenumber", "u.unit", "u.mismatch")


# --- fixed patterns ----------------------------------------------------------------------------


@query("""SELECT page_id, regexp_matches(p, '[.](pdf|jpg|jpeg|png|tif|tiff|webp|dcm|tsv|hocr)$') OR p LIKE 'data/%' OR p LIKE 'dist/%' AS banned
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'data/' || page_id WHEN 1 THEN 'a/' || page_id || '.png' WHEN 2 THEN 'a/data/' || page_id ELSE page_id || '.png.txt' END AS p FROM pages)""")
def tracked_paths(spark, sf_dir):
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    p = F.when(k == 0, F.concat(F.lit("data/"), i)).when(k == 1, F.concat(F.lit("a/"), i, F.lit(".PNG"))).when(k == 2, F.concat(F.lit("a/data/"), i)).otherwise(F.concat(i, F.lit(".png.txt")))
    return read(spark, sf_dir, "pages").select("page_id", K.banned_paths(p, V.BANNED_SUFFIXES, V.BANNED_PREFIXES).alias("banned"))


@query(PRINTED_SQL + """,
a AS (SELECT *, max(line) FILTER (k = 1) OVER (PARTITION BY page) AS anchor FROM rows),
b AS (SELECT *, last_value(CASE WHEN k = 2 THEN 1 WHEN k = 3 THEN 0 WHEN result <> '' THEN 0 END IGNORE NULLS) OVER (PARTITION BY page ORDER BY line ROWS UNBOUNDED PRECEDING) AS skip FROM a WHERE anchor IS NULL OR line > anchor)
SELECT page, line, test FROM b WHERE k NOT IN (2, 3) AND coalesce(skip, 0) = 0""")
def report_rows(spark, sf_dir):
    rows = printed(spark, sf_dir).withColumn("heading", F.when(F.col("test") == "Test Name", "Facility").otherwise(""))
    return L.content_rows(rows, F.col("heading").rlike(V.ANCHOR), F.col("test").rlike(V.PROSE), F.col("test").rlike(V.METHOD), F.col("result") != "").select("page", "line", "test")


# --- sentences and labels ------------------------------------------------------------------------

WORDS_SQL = f"""CASE WHEN low IS NULL AND high IS NULL THEN NULL
 WHEN value > high THEN CASE WHEN value / high < 1.15 THEN 'just above' ELSE printf('%.1f', floor(value / high * 10 + 0.5) / 10) || ' times the upper limit' END
 WHEN value < low THEN CASE WHEN ({FOLD_SQL}) < 1.15 THEN 'just below' WHEN ({FOLD_SQL}) >= 1.5 THEN 'well below' ELSE 'below' END
 WHEN (value - low) / nullif(high - low, 0) < 0.25 THEN 'inside, near the lower limit' WHEN (value - low) / nullif(high - low, 0) > 0.75 THEN 'inside, near the upper limit' ELSE 'inside' END"""


@query(OBS_SQL + f", w AS (SELECT *, {WORDS_SQL} AS words FROM obs)" + """
SELECT seq, concat_ws(' ', upper(words[1]) || words[2:] || '.', 'Collected ' || strftime(collected, '%Y-%m-%d %H:%M') || '.', CASE WHEN printed_flag IN ('CH', 'CL') THEN 'Marked as critical by the laboratory.' END,
'From page ' || CASE WHEN seq % 2 = 0 THEN patient_id END || '.') AS tip FROM w""")
def tooltips(spark, sf_dir):
    page = F.when(F.col("seq") % 2 == 0, F.col("patient_id"))
    tip = W.tooltip(F.col("value"), F.col("low"), F.col("high"), F.col("collected"), F.col("printed_flag").isin("CH", "CL"), page)
    return observations(spark, sf_dir).select("seq", tip.alias("tip"))


NAMES_SQL = "WITH g AS (SELECT n_regionkey, list_sort(list(n_name) FILTER (n_nationkey % 6 >= n_regionkey)) AS names FROM nation GROUP BY ALL), g2 AS (SELECT n_regionkey, coalesce(names, []) AS names, coalesce(len(names), 0) AS n FROM g),"
JOINED_SQL = "CASE WHEN n = 0 THEN '' WHEN n = 1 THEN names[1] ELSE array_to_string(names[1:n - 1], ', ') || ' and ' || names[n] END"


@query(NAMES_SQL + f""" t AS (SELECT *, {JOINED_SQL} AS joined FROM g2)
SELECT n_regionkey, joined, CASE WHEN n > 1 THEN n || ' tests have risen' ELSE joined || ' has risen' END AS subject, CASE WHEN n > 4 THEN 'We saw ' || n || ' tests are high' ELSE 'We saw ' || joined || ' is high' END AS inner_part FROM t""")
def group_titles(spark, sf_dir):
    names = F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 6 >= F.col("n_regionkey"), F.col("n_name"))))
    g = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(names.alias("names"))
    title = lambda before, after: W.group_title(F.lit(before), F.lit(after), F.col("names"))
    return g.select("n_regionkey", W.joined(F.col("names")).alias("joined"), title("", " has risen").alias("subject"), title("We saw ", " is high").alias("inner_part"))


@query(POINTS_SQL + """,
g AS (SELECT patient_id, analyte, min(day) AS f, max(day) AS l, min(collected) AS a, max(collected) AS b FROM points GROUP BY ALL)
SELECT patient_id, analyte, CASE WHEN patient_id % 5 = 0 THEN CASE WHEN f = l THEN 'day ' || f ELSE 'days ' || f || '-' || l END
 WHEN a::DATE = b::DATE THEN strftime(b, '%d %b') ELSE CASE WHEN month(a) = month(b) THEN strftime(a, '%d') ELSE strftime(a, '%d %b') END || '-' || strftime(b, '%d %b') END AS span,
strftime(a, '%d %b %H:%M') AS label, strftime(a, '%-d %b') AS short,
CASE WHEN a::DATE = b::DATE THEN strftime(a, '%-d %B %Y') WHEN date_trunc('month', a) = date_trunc('month', b) THEN strftime(a, '%-d') || ' to ' || strftime(b, '%-d %B %Y') ELSE strftime(a, '%-d %B %Y') || ' to ' || strftime(b, '%-d %B %Y') END AS dates FROM g""")
def span_labels(spark, sf_dir):
    g = points(spark, sf_dir).groupBy("patient_id", "analyte").agg(F.min("day").alias("f"), F.max("day").alias("l"), F.min("collected").alias("a"), F.max("collected").alias("b"))
    known = F.when(F.col("patient_id") % 5 != 0, F.col("a"))
    a, b = F.col("a"), F.col("b")
    return g.select("patient_id", "analyte", W.span(known, b, F.col("f"), F.col("l")).alias("span"), W.day_label(a, True).alias("label"), W.short_day(a).alias("short"), W.date_range(F.to_date(a), F.to_date(b)).alias("dates"))


# --- axes and order --------------------------------------------------------------------------------


@query(POINTS_SQL + """,
g AS (SELECT patient_id, analyte, least(min(value), any_value(low), any_value(high)) AS a, greatest(max(value), any_value(low), any_value(high)) AS b, arg_max(value, day) AS v FROM points GROUP BY ALL),
w AS (SELECT *, CASE WHEN a = b THEN greatest(abs(a) * 0.1, 0.5) ELSE b - a END AS wide FROM g)
SELECT patient_id, analyte, (a - wide * 0.06)::DECIMAL(18,4)::DOUBLE AS axis_start, (a + wide + wide * 0.06)::DECIMAL(18,4)::DOUBLE AS axis_end,
(40 + (v - (a - wide * 0.06)) / (wide * 1.12) * 560)::DECIMAL(18,4)::DOUBLE AS x FROM w""")
def axis_windows(spark, sf_dir):
    g = points(spark, sf_dir).groupBy("patient_id", "analyte").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.first("low").alias("low"), F.first("high").alias("high"), F.max_by("value", "day").alias("v"))
    g = g.withColumn("w", W.axis(F.col("least"), F.col("most"), F.col("low"), F.col("high")))
    return g.select("patient_id", "analyte", X.fixed(F.col("w.start")).alias("axis_start"), X.fixed(F.col("w.end")).alias("axis_end"), X.fixed(W.place(F.col("v"), F.col("w.start"), F.col("w.end"), 40.0, 600.0)).alias("x"))


@query(OBS_SQL + f"SELECT seq, (10 + 180 * (1 - ln(greatest({FOLD_SQL}, 1.0)) / ln(32.0)))::DECIMAL(18,4)::DOUBLE AS y FROM obs WHERE low IS NOT NULL OR high IS NOT NULL")
def log_places(spark, sf_dir):
    o = observations(spark, sf_dir).filter("low is not null or high is not null")
    return o.select("seq", X.fixed(W.log_place(X.fold_outside(F.col("value"), F.col("low"), F.col("high")), 32.0, 10.0, 180.0)).alias("y"))


NAMES = "albumin bilirubin_total urea inr crp sodium".split()


@query(f"""WITH a AS (SELECT DISTINCT ['{"', '".join(NAMES)}'][l_linenumber % 6 + 1] AS analyte FROM lineitem)
SELECT analyte, row_number() OVER (ORDER BY analyte NOT IN ('bilirubin_total', 'inr', 'creatinine', 'ammonia', 'platelets'), analyte)::INT AS place FROM a""")
def headline_first(spark, sf_dir):
    """Distinct analytes with the leading ones first; as many as the dictionary has."""
    names = F.array(*[F.lit(n) for n in NAMES])
    a = read(spark, sf_dir, "lineitem").select(F.get(names, F.col("l_linenumber") % 6).alias("analyte")).distinct()
    key = W.headline_key(F.col("analyte"), F.col("analyte"))
    return a.agg(F.sort_array(F.collect_list(key)).alias("k")).select(F.posexplode("k").alias("i", "k")).select(F.col("k.display").alias("analyte"), (F.col("i") + 1).alias("place"))


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 25 THEN 'flat' WHEN (l_linenumber % 6 IN (0, 5)) = (l_quantity < 25) THEN 'worse' ELSE 'better' END AS words FROM lineitem""")
def worse_or_better(spark, sf_dir):
    """Words for a change of known analytes; a rise is bad for all but albumin and sodium."""
    names = F.get(F.array(*[F.lit(n) for n in NAMES]), F.col("l_linenumber") % 6)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.direction(W.valence_of(names), F.col("l_quantity") - 25).alias("words"))
