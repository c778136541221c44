"""Queries over readings, gates, corrections and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import quality as Q
from .operators import series as S
from .plans import scores as C
from .queries_series import points
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


MAJ = "CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b END"
READ_SQL = OBS_SQL + f""",
reads AS (SELECT *, {MAJ} AS m, list_filter([a, b, c], lambda x: x IS NOT NULL) AS r FROM obs)
"""
ENSEMBLE = "CASE WHEN len(r) = 0 THEN 'fail' WHEN len(list_distinct(r)) = 1 THEN CASE WHEN len(r) >= 2 THEN 'pass' ELSE 'weak' END WHEN m IS NOT NULL AND len(r) = 3 THEN 'weak' ELSE 'fail' END"
FLAG = "CASE WHEN interpretation IS NULL THEN 'skip' WHEN printed_flag IS NULL THEN CASE WHEN interpretation = 'N' THEN 'pass' ELSE 'weak' END WHEN right(printed_flag, 1) = interpretation THEN 'pass' ELSE 'fail' END"
ENVELOPE = "CASE WHEN value IS NULL THEN 'skip' WHEN value BETWEEN 0.0 AND 300.0 THEN 'pass' ELSE 'fail' END"


@query(READ_SQL + "SELECT patient_id, analyte, seq, coalesce(m, a, b, c) AS voted FROM reads")
def majority_vote(spark, sf_dir):
    o = observations(spark, sf_dir)
    return o.select("patient_id", "analyte", "seq", Q.vote(F.col("a"), F.col("b"), F.col("c")).alias("voted"))


@query(READ_SQL + """,
p AS (SELECT *, list_distinct(list_filter(r, lambda v: v BETWEEN 0.0 AND 300.0 AND coalesce(v >= low / 10, true) AND coalesce(v <= high * 10, true))) AS fine FROM reads)
SELECT patient_id, analyte, seq, CASE WHEN m IS NOT NULL AND list_contains(fine, m) THEN m WHEN len(fine) = 1 THEN fine[1] ELSE coalesce(a, b, c) END AS chosen FROM p""")
def choose_value(spark, sf_dir):
    o = observations(spark, sf_dir)
    return o.select("patient_id", "analyte", "seq", Q.choose(F.col("low"), F.col("high"), F.lit(0.0), F.lit(300.0)).alias("chosen"))


@query(READ_SQL + f"SELECT {ENSEMBLE} AS state, count(*) AS n FROM reads GROUP BY ALL")
def ensemble_gate(spark, sf_dir):
    return observations(spark, sf_dir).select(Q.ensemble_gate().alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query(OBS_SQL + f"SELECT patient_id, analyte, seq, {FLAG} AS state FROM obs")
def flag_gate(spark, sf_dir):
    return observations(spark, sf_dir).select("patient_id", "analyte", "seq", Q.flag_gate().alias("state"))


@query(OBS_SQL + f"SELECT patient_id, analyte, seq, {ENVELOPE} AS state FROM obs")
def envelope_gate(spark, sf_dir):
    return observations(spark, sf_dir).select("patient_id", "analyte", "seq", Q.envelope_gate().alias("state"))


#: Event types in the roles of a blood count, so that the identities have inputs.
ROLES = {"view": "pcv", "click": "rbc", "signup": "mcv", "error": "hb", "purchase": "mch"}


@query(POINTS_SQL + """,
w AS (SELECT patient_id, day, max(value) FILTER (analyte = 'view') AS pcv, max(value) FILTER (analyte = 'click') AS rbc, max(value) FILTER (analyte = 'signup') AS mcv,
             max(value) FILTER (analyte = 'error') AS hb, max(value) FILTER (analyte = 'purchase') AS mch FROM points GROUP BY ALL),
v AS (SELECT *, pcv / nullif(rbc, 0) * 10 AS want_mcv, hb / nullif(rbc, 0) * 10 AS want_mch FROM w),
s AS (SELECT *, abs(mcv - want_mcv) / greatest(abs(mcv), abs(want_mcv), 1e-9) <= 0.06 AS ok_mcv, abs(mch - want_mch) / greatest(abs(mch), abs(want_mch), 1e-9) <= 0.06 AS ok_mch FROM v),
rows AS (
  SELECT patient_id, day, unnest(['mcv', 'pcv', 'rbc']) AS analyte, 'mcv' AS identity, 0 AS place, ok_mcv AS ok FROM s WHERE mcv IS NOT NULL AND want_mcv IS NOT NULL
  UNION ALL SELECT patient_id, day, unnest(['mch', 'hb', 'rbc']), 'mch', 1, ok_mch FROM s WHERE mch IS NOT NULL AND want_mch IS NOT NULL)
SELECT patient_id, day, analyte, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS state, identity
FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, day, analyte ORDER BY ok, place) AS rn FROM rows) WHERE rn = 1""")
def arithmetic_gate(spark, sf_dir):
    role = F.lit(None).cast("string")
    for event, name in ROLES.items():
        role = F.when(F.col("analyte") == event, name).otherwise(role)
    samples = points(spark, sf_dir).select("patient_id", "day", role.alias("analyte"), "value")
    return Q.identity_gate(samples, ["patient_id", "day"])


@query(POINTS_SQL + """, s AS (SELECT *, sum(value) OVER w AS total, count(value) OVER w AS n FROM points WINDOW w AS (PARTITION BY patient_id, day))
SELECT patient_id, day, analyte, CASE WHEN total BETWEEN 97 AND 103 THEN 'pass' ELSE 'fail' END AS state FROM s WHERE n >= 4""")
def differential_gate(spark, sf_dir):
    return Q.differential_gate(points(spark, sf_dir), ["patient_id", "day"])


@query(READ_SQL + f"""
SELECT patient_id, analyte, seq, ({ENSEMBLE}) IN ('weak', 'fail') OR ({FLAG}) IN ('weak', 'fail') OR ({ENVELOPE}) IN ('weak', 'fail') AS needs_review,
       CASE printed_flag WHEN 'CH' THEN 'HH' WHEN 'CL' THEN 'LL' ELSE interpretation END AS interpretation, coalesce(printed_flag IN ('CH', 'CL'), false) AS critical FROM reads""")
def gated_observations(spark, sf_dir):
    return Q.gated(observations(spark, sf_dir)).select("patient_id", "analyte", "seq", "needs_review", "interpretation", "critical")


LISTED = "'[' || array_to_string(list_sort(list_distinct(r)), ', ') || ']'"
PROVENANCE = ORACLE["arithmetic_gate"].replace("SELECT patient_id, day, analyte, CASE WHEN ok", ", identity_found AS (SELECT patient_id, day, analyte, CASE WHEN ok", 1) + """),
shares AS (SELECT *, sum(value) OVER w AS total, count(value) OVER w AS n_shares FROM points WINDOW w AS (PARTITION BY patient_id, day)),
share_found AS (SELECT patient_id, day, CASE analyte WHEN 'view' THEN 'pcv' WHEN 'click' THEN 'rbc' WHEN 'signup' THEN 'mcv' WHEN 'error' THEN 'hb' ELSE 'mch' END AS analyte, CASE WHEN total BETWEEN 97 AND 103 THEN 'pass' ELSE 'fail' END AS state FROM shares WHERE n_shares >= 4),
named AS (
  SELECT o.* REPLACE (CASE analyte WHEN 'view' THEN 'pcv' WHEN 'click' THEN 'rbc' WHEN 'signup' THEN 'mcv' WHEN 'error' THEN 'hb' ELSE 'mch' END AS analyte), list_filter([a, b, c], lambda x: x IS NOT NULL) AS r,
         CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b END AS m FROM obs o),
gated AS (
  SELECT n.*, """ + f"({ENSEMBLE}) AS s1, ({FLAG}) AS s2, ({ENVELOPE}) AS s3, " + """i.state AS s4, identity, f.state AS s5 FROM named n LEFT JOIN identity_found i USING (patient_id, day, analyte) LEFT JOIN share_found f USING (patient_id, day, analyte)),
told AS (
  SELECT *, CASE WHEN len(r) = 0 THEN 'no pass produced a value' WHEN len(list_distinct(r)) = 1 THEN CASE WHEN len(r) >= 2 THEN 'unanimous' ELSE 'single pass only' END
                 WHEN m IS NOT NULL AND len(r) = 3 THEN 'majority ' || m || ' of ' || """ + LISTED + " ELSE 'no majority among ' || " + LISTED + """ END AS d1,
         CASE WHEN value IS NULL THEN 'no value' WHEN interpretation IS NULL THEN 'no usable reference range' WHEN printed_flag IS NULL THEN CASE WHEN interpretation = 'N' THEN 'no flag, value in range' ELSE 'no flag printed but value reads ' || interpretation END
              WHEN s2 = 'pass' THEN 'flag ' || printed_flag || ' agrees' ELSE 'page says ' || printed_flag || ' but value ' || value || ' reads ' || interpretation END AS d2,
         CASE s3 WHEN 'skip' THEN 'no value' WHEN 'pass' THEN value || ' is within 0.0 to 300.0' ELSE value || ' isn''t within 0.0 to 300.0' END AS d3 FROM gated)
SELECT patient_id, analyte, seq, CASE printed_flag WHEN 'CH' THEN 'HH' WHEN 'CL' THEN 'LL' ELSE interpretation END AS interpretation, coalesce(printed_flag IN ('CH', 'CL'), false) AS critical,
       s1 IN ('weak', 'fail') OR s2 IN ('weak', 'fail') OR s3 IN ('weak', 'fail') OR coalesce(s4 = 'fail', false) OR coalesce(s5 = 'fail', false) AS needs_review,
       'arithmetic ' || s4 || ': ' || CASE s4 WHEN 'pass' THEN 'agrees with ' ELSE 'breaks ' END || identity AS arithmetic, 'differential ' || s5 || ': ' || CASE s5 WHEN 'pass' THEN 'shares add up' ELSE 'shares don''t add up' END AS differential,
       'ensemble ' || s1 || ': ' || d1 AS ensemble, 'envelope ' || s3 || ': ' || d3 AS envelope, 'flag_consistency ' || s2 || ': ' || d2 AS flag_consistency,
       seq // 40 AS page, k % 3 = 0 AS human_verified, concat_ws(' ', 'A=' || a, 'B=' || b, 'C=' || c) AS ocr FROM told"""


@query(PROVENANCE)
def provenance(spark, sf_dir):
    """Every observation with all that is known of how it was read: passes, gates with details, page, whether a person checked it."""
    role = F.lit(None).cast("string")
    for event, name in ROLES.items():
        role = F.when(F.col("analyte") == event, name).otherwise(role)
    o = observations(spark, sf_dir).withColumns({"analyte": role, "page": F.floor(F.col("seq") / 40).cast("long"), "human_verified": F.col("k") % 3 == 0})
    samples = points(spark, sf_dir).select("patient_id", "day", role.alias("analyte"), "value")
    p = Q.with_provenance(o, samples, ["patient_id", "day"])
    verdict = lambda g: F.concat(F.lit(f"{g} "), F.col("provenance.gates")[g]["state"], F.lit(": "), F.col("provenance.gates")[g]["detail"]).alias(g)
    ocr = F.array_join(F.transform(F.array_sort(F.map_entries("provenance.ocr")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    return p.select("patient_id", "analyte", "seq", "interpretation", "critical", "needs_review", *[verdict(g) for g in ("arithmetic", "differential", "ensemble", "envelope", "flag_consistency")], F.col("provenance.page").alias("page"), F.col("provenance.human_verified").alias("human_verified"), ocr.alias("ocr"))


@query(READ_SQL + f"""
SELECT 'ensemble' AS gate, {ENSEMBLE} AS state, count(*) AS n FROM reads GROUP BY ALL
UNION ALL SELECT 'flag', {FLAG}, count(*) FROM reads GROUP BY ALL UNION ALL SELECT 'envelope', {ENVELOPE}, count(*) FROM reads GROUP BY ALL""")
def gate_histogram(spark, sf_dir):
    return Q.gated(observations(spark, sf_dir)).select(F.explode("gates").alias("gate", "state")).groupBy("gate", "state").agg(F.count("*").alias("n"))


@query(READ_SQL + """,
k AS (SELECT CASE WHEN len(r) = 0 THEN 'conflict' WHEN len(list_distinct(r)) = 1 THEN CASE WHEN len(r) = 1 THEN 'single' ELSE 'unanimous' END
             WHEN len(list_distinct(r)) = 2 AND len(r) = 3 THEN 'majority' ELSE 'conflict' END AS kind FROM reads)
SELECT x.kind, count(k.kind) AS n FROM (VALUES ('unanimous'), ('single'), ('majority'), ('conflict')) x(kind) LEFT JOIN k USING (kind) GROUP BY x.kind""")
def agreement_histogram(spark, sf_dir):
    return Q.agreement(observations(spark, sf_dir))


@query(READ_SQL + f"""SELECT count(*) FILTER (value IS NOT NULL) AS charted, count(*) FILTER (k % 3 = 0) AS verified,
count(*) FILTER (({ENSEMBLE}) IN ('weak', 'fail') OR ({FLAG}) IN ('weak', 'fail') OR ({ENVELOPE}) IN ('weak', 'fail')) AS flagged, count(DISTINCT day) AS days FROM reads""")
def quality_counts(spark, sf_dir):
    g = Q.gated(observations(spark, sf_dir))
    return g.agg(F.count_if(F.col("value").isNotNull()).alias("charted"), F.count_if(F.col("k") % 3 == 0).alias("verified"), F.count_if("needs_review").alias("flagged"), F.count_distinct("day").alias("days"))


@query(READ_SQL + """,
taken AS (SELECT * REPLACE (coalesce(c, b) AS value) FROM reads),
g AS (SELECT patient_id, analyte, median(value) AS mid FROM taken GROUP BY ALL HAVING count(value) >= 3 AND median(value) <> 0),
j AS (SELECT taken.*, mid, list_distinct(list_filter(r, lambda v: v <> value AND v / mid > 0.33 AND v / mid < 3)) AS near FROM taken JOIN g USING (patient_id, analyte))
SELECT patient_id, analyte, seq, value AS was, near[1] AS value, mid AS median FROM j WHERE (value >= 5 * mid OR value <= mid / 5) AND len(near) = 1""")
def decimal_shift(spark, sf_dir):
    return Q.decimal_shift(observations(spark, sf_dir).withColumn("value", F.coalesce("c", "b")))


@query(OBS_SQL + f""",
s AS (SELECT *, list_filter([a, b, c], lambda x: x IS NOT NULL) AS r FROM obs),
t AS (SELECT *, len(list_distinct(r)) = 1 AS u, len(r) AS nr, ({FLAG}) <> 'fail' AS ok FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY patient_id, analyte, day ORDER BY u DESC, nr DESC, ok DESC, seq) AS rn, count(*) OVER (PARTITION BY patient_id, analyte, day) AS n_rows FROM t),
d AS (SELECT patient_id, analyte, day, list_distinct(list(value)) AS vals FROM obs GROUP BY ALL)
SELECT w.patient_id, w.analyte, w.day, seq, value, n_rows, len(list_filter(vals, lambda x: x <> value)) AS other_values FROM w JOIN d USING (patient_id, analyte, day) WHERE rn = 1""")
def dedupe_by_support(spark, sf_dir):
    return Q.dedupe_by_support(observations(spark, sf_dir), ["patient_id", "analyte", "day"])


@query(OBS_SQL + f""",
s AS (SELECT *, list_filter([a, b, c], lambda x: x IS NOT NULL) AS r FROM obs),
rows AS (
  SELECT patient_id, analyte, day, list({{'seq': seq, 'value': value, 'agree': len(list_distinct(r)) = 1 AND len(r) > 1, 'n': len(r), 'fine': ({FLAG}) <> 'fail', 'conflicts': []::STRUCT(seq BIGINT, value DOUBLE)[]}} ORDER BY seq) AS l FROM s GROUP BY ALL),
folded AS (
  SELECT patient_id, analyte, day, list_reduce(l, lambda x, y: CASE WHEN (y.agree, y.n, y.fine) > (x.agree, x.n, x.fine)
    THEN {{'seq': y.seq, 'value': y.value, 'agree': y.agree, 'n': y.n, 'fine': y.fine AND x.value = y.value, 'conflicts': CASE WHEN x.value <> y.value THEN [{{'seq': x.seq, 'value': x.value}}] ELSE [] END}}
    ELSE {{'seq': x.seq, 'value': x.value, 'agree': x.agree, 'n': x.n, 'fine': x.fine AND x.value = y.value, 'conflicts': list_concat(x.conflicts, CASE WHEN x.value <> y.value THEN [{{'seq': y.seq, 'value': y.value}}] ELSE [] END)}} END) AS w FROM rows)
SELECT patient_id, analyte, day, w.seq AS seq, w.value AS value, NOT w.fine AS needs_review, array_to_string(list_transform(w.conflicts, lambda c: c.seq || ':' || c.value), ';') AS conflicts FROM folded""")
def dedupe_conflicts(spark, sf_dir):
    """The reading of each day that stays, whether it is under review, and those that it met with other values."""
    d = Q.dedupe_conflicts(observations(spark, sf_dir), ["patient_id", "analyte", "day"])
    return d.withColumn("conflicts", F.array_join(F.transform("conflicts", lambda c: F.concat(c["seq"].cast("string"), F.lit(":"), c["value"].cast("string"))), ";"))


@query(OBS_SQL + "SELECT analyte, arg_min({'low': low, 'high': high}, seq).low AS low, arg_min({'low': low, 'high': high}, seq).high AS high FROM obs WHERE low IS NOT NULL OR high IS NOT NULL GROUP BY analyte")
def consensus_range(spark, sf_dir):
    return Q.consensus_range(observations(spark, sf_dir))


@query(OBS_SQL + ", ranged AS (SELECT analyte, any_value(low) AS l, any_value(high) AS h FROM obs GROUP BY analyte) SELECT patient_id, analyte, seq, coalesce(CASE WHEN k % 2 = 0 THEN low END, l) AS low, coalesce(CASE WHEN k % 2 = 0 THEN high END, h) AS high FROM obs JOIN ranged USING (analyte)")
def range_fallback(spark, sf_dir):
    o = observations(spark, sf_dir)
    own = o.withColumns({"low": F.when(F.col("k") % 2 == 0, F.col("low")), "high": F.when(F.col("k") % 2 == 0, F.col("high"))})
    c = Q.consensus_range(own).select("analyte", F.col("low").alias("c_low"), F.col("high").alias("c_high"))
    return own.join(c, "analyte", "left").select("patient_id", "analyte", "seq", F.coalesce("low", "c_low").alias("low"), F.coalesce("high", "c_high").alias("high"))


@query(OBS_SQL + "SELECT patient_id, analyte, seq, k % 3 = 0 AS human_verified FROM obs")
def ledger_flag(spark, sf_dir):
    o = observations(spark, sf_dir)
    ledger = o.filter("k % 3 = 0").select(F.concat_ws(":", "seq", "analyte").alias("key"), F.lit(True).alias("hit"))
    return o.withColumn("key", F.concat_ws(":", "seq", "analyte")).join(ledger, "key", "left").select("patient_id", "analyte", "seq", F.coalesce("hit", F.lit(False)).alias("human_verified"))


@query(OBS_SQL + "SELECT patient_id, analyte, seq FROM obs WHERE value IS NOT NULL AND k % 3 <> 0")
def unverified_anti(spark, sf_dir):
    o = observations(spark, sf_dir)
    ledger = o.filter("k % 3 = 0").select("seq", "analyte")
    return o.filter("value is not null").join(ledger, ["seq", "analyte"], "left_anti").select("patient_id", "analyte", "seq")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def coverage_anti(spark, sf_dir):
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(OBS_SQL + """SELECT patient_id, analyte, seq, map_from_entries(list_filter([{'k': 'A', 'v': a}, {'k': 'B', 'v': b}, {'k': 'C', 'v': c}], lambda x: x.v IS NOT NULL)) ['C'] AS c_read,
CASE WHEN k % 2 = 0 THEN 'a' || k ELSE 'b' || k END AS text FROM obs""")
def merge_passes(spark, sf_dir):
    o = observations(spark, sf_dir)
    stack = F.inline(F.array(*[F.struct(F.lit(p).alias("pass"), F.col(c).alias("value"), t.alias("text")) for p, c, t in (("A", "a", F.when(F.col("k") % 2 == 0, F.concat(F.lit("a"), F.col("k")))), ("B", "b", F.concat(F.lit("b"), F.col("k"))), ("C", "c", F.lit(None).cast("string")))]))
    long = o.select("patient_id", "analyte", "seq", stack).filter("value is not null or `pass` = 'A'")
    return Q.merge_passes(long, ["patient_id", "analyte", "seq"]).select("patient_id", "analyte", "seq", F.try_element_at("ocr", F.lit("C")).alias("c_read"), "text")


@query(OBS_SQL + """ SELECT patient_id, analyte, seq FROM obs WHERE len(list_distinct(list_filter([a, b, c], lambda x: x IS NOT NULL))) > 1""")
def disagreements(spark, sf_dir):
    return observations(spark, sf_dir).filter(F.size(F.array_distinct(Q.readings())) > 1).select("patient_id", "analyte", "seq")


UNITS = ["a", "r", "n"]


@query("""SELECT l_returnflag AS printed, count(*) AS n,
CASE WHEN l_returnflag = 'R' THEN 'r' WHEN l_returnflag = 'A' THEN 'A' ELSE 'r' END AS unit, l_returnflag = 'A' AS mismatch
FROM lineitem GROUP BY ALL""")
def unit_choice(spark, sf_dir):
    u = Q.choose_unit(F.col("l_returnflag"), F.lit("r"), ["A"])
    li = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("printed"), u.alias("u"))
    return li.groupBy("printed", F.col("u.unit").alias("unit"), F.col("u.mismatch").alias("mismatch")).agg(F.count("*").alias("n"))


# --- scores over daily points, brought into the inputs' ranges ---------------------------

WIDE_SQL = POINTS_SQL + """,
wide AS (SELECT patient_id, day, max(value) FILTER (analyte = 'view') / 20 AS b, max(value) FILTER (analyte = 'click') / 40 AS i, max(value) FILTER (analyte = 'signup') / 40 AS cr,
                120 + max(value) FILTER (analyte = 'error') / 5 AS na, max(value) FILTER (analyte = 'purchase') / 30 AS alb FROM points GROUP BY ALL)
"""


def wide(spark, sf_dir):
    at = lambda a: F.max(F.when(F.col("analyte") == a, F.col("value")))
    p = points(spark, sf_dir).groupBy("patient_id", "day").agg((at("view") / 20).alias("b"), (at("click") / 40).alias("i"), (at("signup") / 40).alias("cr"), (at("error") / 5 + 120).alias("na"), (at("purchase") / 30).alias("alb"))
    return p


def shown(score):
    return [score["value"].alias("value"), score["complete"].alias("complete"), F.array_join(score["missing"], ",").alias("missing"), score["band"].alias("band")]


MELD_BAND = "CASE WHEN NOT complete THEN '' WHEN v >= 40 THEN '40' WHEN v >= 30 THEN '30-39' WHEN v >= 20 THEN '20-29' WHEN v >= 10 THEN '10-19' ELSE 'under 10' END"
MISS = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"


def missing_sql(**names: str) -> str:
    return MISS.format(", ".join(f"CASE WHEN {c} IS NULL THEN '{n}' END" for n, c in names.items()))


@query(WIDE_SQL + f""",
x AS (SELECT *, greatest(b, 1.0) AS bb, greatest(i, 1.0) AS ii, greatest(least(cr, 3.0), 1.0) AS cc, greatest(least(na, 137.0), 125.0) AS nn, greatest(least(alb, 3.5), 1.5) AS aa FROM wide),
y AS (SELECT *, b IS NOT NULL AND i IS NOT NULL AND cr IS NOT NULL AND na IS NOT NULL AND alb IS NOT NULL AS complete,
  greatest(least(floor(4.56 * ln(bb) + 0.82 * (137 - nn) - 0.24 * (137 - nn) * ln(bb) + 9.09 * ln(ii) + 11.14 * ln(cc) + 1.85 * (3.5 - aa) - 1.83 * (3.5 - aa) * ln(cc) + 6 + 0.5), 40), 6)::DOUBLE AS v FROM x)
SELECT patient_id, day, CASE WHEN complete THEN v END AS value, complete, {missing_sql(bilirubin='b', inr='i', creatinine='cr', sodium='na', albumin='alb')} AS missing, {MELD_BAND} AS band FROM y""")
def meld3_daily(spark, sf_dir):
    w = wide(spark, sf_dir).withColumn("s", C.meld3(F.col("b"), F.col("i"), F.col("cr"), F.col("na"), F.col("alb"), F.lit(False), F.lit(False)))
    return w.select("patient_id", "day", *shown(F.col("s")))


@query(WIDE_SQL + f""",
x AS (SELECT *, greatest(least(cr, 4.0), 1.0) AS cc, greatest(least(na, 137.0), 125.0) AS nn FROM wide),
f AS (SELECT *, floor((0.957 * ln(cc) + 0.378 * ln(greatest(b, 1.0)) + 1.12 * ln(greatest(i, 1.0)) + 0.643) * 100 + 0.5) / 10 AS m FROM x),
y AS (SELECT *, b IS NOT NULL AND i IS NOT NULL AND cr IS NOT NULL AND na IS NOT NULL AS complete,
  greatest(least(floor(CASE WHEN m > 11 THEN m + 1.32 * (137 - nn) - 0.033 * m * (137 - nn) ELSE m END + 0.5), 40), 6)::DOUBLE AS v FROM f)
SELECT patient_id, day, CASE WHEN complete THEN v END AS value, complete, {missing_sql(bilirubin='b', inr='i', creatinine='cr', sodium='na')} AS missing, {MELD_BAND} AS band FROM y""")
def meld_na_daily(spark, sf_dir):
    w = wide(spark, sf_dir).withColumn("s", C.meld_na(F.col("b"), F.col("i"), F.col("cr"), F.col("na"), F.lit(False)))
    return w.select("patient_id", "day", *shown(F.col("s")))


def pts_sql(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN {x} < {lo} THEN 1 WHEN {x} > {hi} THEN 3 WHEN {x} IS NOT NULL THEN 2 END"


@query(WIDE_SQL + f""",
y AS (SELECT *, b IS NOT NULL AND alb IS NOT NULL AND i IS NOT NULL AS complete, {pts_sql('b', 2.0, 3.0)} + CASE WHEN alb > 3.5 THEN 1 WHEN alb < 2.8 THEN 3 WHEN alb IS NOT NULL THEN 2 END + {pts_sql('i', 1.7, 2.3)} + 2 AS v FROM wide)
SELECT patient_id, day, CASE WHEN complete THEN v::DOUBLE END AS value, complete, {missing_sql(bilirubin='b', albumin='alb', inr='i')} AS missing, CASE WHEN NOT complete THEN '' WHEN v <= 6 THEN 'A' WHEN v <= 9 THEN 'B' ELSE 'C' END AS band FROM y""")
def child_pugh_points(spark, sf_dir):
    w = wide(spark, sf_dir).withColumn("s", C.child_pugh(F.col("b"), F.col("alb"), F.col("i"), F.lit("none"), F.lit("none")))
    return w.select("patient_id", "day", *shown(F.col("s")))


@query(WIDE_SQL + f""",
y AS (SELECT *, b IS NOT NULL AND cr IS NOT NULL AND i IS NOT NULL AND alb IS NOT NULL AS complete, {pts_sql('b * 8', 15.0, 25.0)} + {pts_sql('cr', 0.7, 1.5)} + {pts_sql('i', 1.8, 2.5)} + {pts_sql('alb', 1.5, 2.5)} + 1 AS v FROM wide)
SELECT patient_id, day, CASE WHEN complete THEN v::DOUBLE END AS value, complete, {missing_sql(bilirubin='b', creatinine='cr', inr='i', lactate='alb')} AS missing, CASE WHEN NOT complete THEN '' WHEN v <= 7 THEN 'I' WHEN v <= 10 THEN 'II' ELSE 'III' END AS band FROM y""")
def aarc_points(spark, sf_dir):
    w = wide(spark, sf_dir).withColumn("s", C.aarc(F.col("b") * 8, F.col("cr"), F.col("i"), F.col("alb"), F.lit("none")))
    return w.select("patient_id", "day", *shown(F.col("s")))


@query(WIDE_SQL + f""",
y AS (SELECT *, na IS NOT NULL AND b IS NOT NULL AND i IS NOT NULL AS complete, (na - (b * 30 + i * 10))::DECIMAL(18,1)::DOUBLE AS v FROM wide)
SELECT patient_id, day, CASE WHEN complete THEN v END AS value, complete, {missing_sql(sodium='na', chloride='b', bicarbonate='i')} AS missing, CASE WHEN NOT complete THEN '' WHEN v BETWEEN 2 AND 26 THEN 'plausible' ELSE 'implausible' END AS band FROM y""")
def anion_gap_daily(spark, sf_dir):
    w = wide(spark, sf_dir).withColumn("s", C.anion_gap(F.col("na"), F.col("b") * 30, F.col("i") * 10))
    return w.select("patient_id", "day", *shown(F.col("s")))


@query(WIDE_SQL + f""",
y AS (SELECT *, i IS NOT NULL AND b IS NOT NULL AS complete, (4.6 * (i * 12 - 12.0) + b)::DECIMAL(18,1)::DOUBLE AS v FROM wide)
SELECT patient_id, day, CASE WHEN complete THEN v END AS value, complete, {missing_sql(pt='i', bilirubin='b')} AS missing, CASE WHEN NOT complete THEN '' WHEN v >= 32 THEN 'severe' ELSE 'not severe' END AS band FROM y""")
def maddrey_daily(spark, sf_dir):
    w = wide(spark, sf_dir).withColumn("s", C.maddrey(F.col("i") * 12, F.lit(12.0), F.col("b")))
    return w.select("patient_id", "day", *shown(F.col("s")))


@query(WIDE_SQL + f""",
y AS (SELECT *, b IS NOT NULL AND nullif(i, 0) IS NOT NULL AS complete, (b / nullif(i, 0))::DECIMAL(18,2)::DOUBLE AS v FROM wide)
SELECT patient_id, day, CASE WHEN complete THEN v END AS value, complete, {missing_sql(anc='b', alc='nullif(i, 0)')} AS missing, '' AS band FROM y""")
def nlr_daily(spark, sf_dir):
    w = wide(spark, sf_dir).withColumn("s", C.nlr(F.col("b"), F.col("i")))
    return w.select("patient_id", "day", *shown(F.col("s")))


CARRY2 = POINTS_SQL + """,
spine AS (SELECT s.patient_id, s.analyte, d.day FROM (SELECT DISTINCT patient_id, analyte FROM points) s JOIN (SELECT DISTINCT patient_id, day FROM points) d USING (patient_id)),
filled AS (SELECT s.*, p.value AS v, p.day AS vday FROM spine s LEFT JOIN points p USING (patient_id, analyte, day)),
carried AS (SELECT patient_id, analyte, day, last_value(v IGNORE NULLS) OVER w AS value, last_value(vday IGNORE NULLS) OVER w AS from_day
            FROM filled WINDOW w AS (PARTITION BY patient_id, analyte ORDER BY day RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)),
w AS (SELECT patient_id, day, max(value) FILTER (analyte = 'view') / 20 AS b, max(value) FILTER (analyte = 'click') / 40 AS i,
             count(*) FILTER (from_day < day) AS carried_forward FROM carried WHERE value IS NOT NULL GROUP BY ALL)
SELECT patient_id, day, b IS NOT NULL AND i IS NOT NULL AS complete, CASE WHEN b IS NOT NULL AND i IS NOT NULL THEN (4.6 * (i * 12 - 12.0) + b)::DECIMAL(18,1)::DOUBLE END AS value, carried_forward FROM w"""


@query(CARRY2)
def daily_scores_carried(spark, sf_dir):
    c = S.carried(points(spark, sf_dir))
    at = lambda a: F.max(F.when(F.col("analyte") == a, F.col("value")))
    w = c.groupBy("patient_id", "day").agg((at("view") / 20).alias("b"), (at("click") / 40).alias("i"), F.count_if(F.col("days_old") > 0).alias("carried_forward"))
    s = C.maddrey(F.col("i") * 12, F.lit(12.0), F.col("b"))
    return w.withColumn("s", s).select("patient_id", "day", "s.complete", "s.value", "carried_forward")


FOLD_SQL = "CASE WHEN low IS NULL AND high IS NULL THEN NULL WHEN high > 0 AND value > high THEN value / high WHEN value < low AND value > 0 THEN low / value ELSE 1.0::DOUBLE END"


@query(OBS_SQL + f"""SELECT seq, ({FOLD_SQL})::DECIMAL(18,4)::DOUBLE AS fold,
(CASE WHEN low IS NULL OR high IS NULL THEN NULL WHEN value > high THEN 70 + 30 * least(log2({FOLD_SQL}) / 4, 1.0) WHEN value < low THEN 30 - 30 * least(log2({FOLD_SQL}) / 4, 1.0)
 ELSE 30 + 40 * (value - low) / nullif(high - low, 0) END)::DECIMAL(18,4)::DOUBLE AS position FROM obs""")
def gauge_positions(spark, sf_dir):
    a = (F.col("value"), F.col("low"), F.col("high"))
    return observations(spark, sf_dir).select("seq", X.fixed(X.gauge_fold(*a)).alias("fold"), X.fixed(X.gauge_position(*a)).alias("position"))


@query(OBS_SQL + f"""SELECT seq, CASE WHEN low IS NULL AND high IS NULL THEN NULL
 WHEN value > high THEN CASE WHEN value / high < 1.15 THEN 'just above' ELSE 'above' END
 WHEN value < low THEN CASE WHEN ({FOLD_SQL}) < 1.15 THEN 'just below' WHEN ({FOLD_SQL}) >= 1.5 THEN 'well below' ELSE 'below' END
 WHEN (value - low) / nullif(high - low, 0) < 0.25 THEN 'inside, near the lower limit' WHEN (value - low) / nullif(high - low, 0) > 0.75 THEN 'inside, near the upper limit' ELSE 'inside' END AS words FROM obs""")
def range_words(spark, sf_dir):
    w = X.range_words(F.col("value"), F.col("low"), F.col("high"))
    return observations(spark, sf_dir).select("seq", F.when(F.endswith(w, F.lit("upper limit")) & F.contains(w, F.lit("times")), "above").otherwise(w).alias("words"))
