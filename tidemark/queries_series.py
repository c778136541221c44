"""Queries over series, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.exprs import fixed
from .operators import series as S
from .plans import rules as R
from .plans import views as V
from .sources.tables import ANALYTES, OBS_SQL, POINTS_SQL, observations, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_of_day(observations(spark, sf_dir)).select("patient_id", "analyte", "day", "value", "collected", "low", "high", "valence", "system")


DIRS_SQL = POINTS_SQL + """,
steps AS (SELECT *, lag(value) OVER w AS p_value, lag(day) OVER w AS p_day FROM points WINDOW w AS (PARTITION BY patient_id, analyte ORDER BY day)),
dirs AS (SELECT *, CASE WHEN p_value IS NULL THEN NULL WHEN abs(value - p_value) < 0.03 * coalesce(nullif(abs(p_value), 0), 1) THEN 0 ELSE sign(value - p_value)::INT END AS dir FROM steps)
"""
RUNS_SQL = DIRS_SQL + """,
turns AS (SELECT *, CASE WHEN dir IS NOT DISTINCT FROM lag(dir) OVER w THEN 0 ELSE 1 END AS turn FROM dirs WINDOW w AS (PARTITION BY patient_id, analyte ORDER BY day)),
islands AS (SELECT *, sum(turn) OVER (PARTITION BY patient_id, analyte ORDER BY day) AS island FROM turns),
runs AS (
  SELECT patient_id, analyte, dir, count(*) + 1 AS points, min(p_day) AS first_day, max(day) AS last_day,
         arg_min(p_value, day) AS first_value, arg_max(value, day) AS last_value, any_value(valence) AS valence
  FROM islands WHERE dir <> 0 GROUP BY patient_id, analyte, island, dir HAVING count(*) >= 2),
long_runs AS (SELECT * FROM runs WHERE abs(last_value - first_value) / coalesce(nullif(abs(first_value), 0), 1) >= 0.10),
run_found AS (
  SELECT CASE WHEN dir > 0 THEN 'rising-run' ELSE 'falling-run' END AS rule,
         CASE WHEN dir = valence AND points >= 5 THEN 'high' WHEN dir = valence THEN 'moderate' ELSE 'info' END AS severity,
         patient_id, analyte, first_day, last_day, points, first_value, last_value FROM long_runs)
"""
IN_RANGE_SQL = "CASE WHEN low IS NULL AND high IS NULL THEN NULL ELSE coalesce(value >= low, true) AND coalesce(value <= high, true) END"
CROSS_SQL = RUNS_SQL + f""",
ins AS (SELECT *, {IN_RANGE_SQL} AS inside FROM points),
was AS (SELECT *, lag(inside) OVER w AS was, lag(day) OVER w AS p_day FROM ins WINDOW w AS (PARTITION BY patient_id, analyte ORDER BY day)),
exits AS (SELECT *, (was AND NOT inside) IS TRUE AS gone FROM was),
numbered AS (SELECT *, sum(gone::INT) OVER (PARTITION BY patient_id, analyte ORDER BY day) AS n FROM exits),
crossings AS (
  SELECT CASE WHEN gone THEN 'range-exit' ELSE 'range-return' END AS rule,
         CASE WHEN NOT gone THEN 'info' WHEN system = 'A' THEN 'high' ELSE 'moderate' END AS severity,
         patient_id, analyte, p_day, day, value, CASE WHEN gone THEN n::BIGINT END AS ordinal
  FROM numbered WHERE inside <> was),
found AS (
  SELECT rule, severity, patient_id, analyte, first_day AS from_day, last_day AS to_day FROM run_found
  UNION ALL SELECT rule, severity, patient_id, analyte, p_day, day FROM crossings)
"""
RANK_SQL = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'moderate' THEN 3 ELSE 4 END"
MOVES_SQL = POINTS_SQL + """,
ends AS (SELECT *, max(day) OVER (PARTITION BY patient_id) AS record_end FROM points),
trend AS (
  SELECT patient_id, analyte, count(*) AS n, arg_min(value, day) AS first_value, arg_max(value, day) AS last_value,
         any_value(valence) AS valence, any_value(low) AS low, any_value(high) AS high, any_value(system) AS system
  FROM ends WHERE day > record_end - 3 GROUP BY patient_id, analyte HAVING count(*) >= 2),
moves AS (SELECT *, CASE WHEN abs(last_value - first_value) < 0.03 * coalesce(nullif(abs(first_value), 0), 1) THEN 0 ELSE sign(last_value - first_value)::INT END AS dir FROM trend)
"""


def carry_sql(days: int | None) -> str:
    frame = "UNBOUNDED PRECEDING" if days is None else f"{days} PRECEDING"
    return POINTS_SQL + f""",
spine AS (SELECT s.patient_id, s.analyte, d.day FROM (SELECT DISTINCT patient_id, analyte FROM points) s JOIN (SELECT DISTINCT patient_id, day FROM points) d USING (patient_id)),
filled AS (SELECT s.*, p.value AS v, p.day AS vday FROM spine s LEFT JOIN points p USING (patient_id, analyte, day)),
carried AS (
  SELECT patient_id, analyte, day, last_value(v IGNORE NULLS) OVER w AS value, last_value(vday IGNORE NULLS) OVER w AS from_day
  FROM filled WINDOW w AS (PARTITION BY patient_id, analyte ORDER BY day RANGE BETWEEN {frame} AND CURRENT ROW))
"""


FOLD = "CASE WHEN value IS NULL OR value <= 0 OR (low IS NULL AND high IS NULL) THEN NULL WHEN high > 0 AND value > high THEN value / high WHEN value < low THEN low / nullif(value, 0) ELSE 1.0::DOUBLE END"
BURDEN_SQL = carry_sql(2) + f""",
bounds AS (SELECT patient_id, analyte, any_value(low) AS low, any_value(high) AS high, any_value(system) AS system FROM points GROUP BY ALL),
folds AS (SELECT c.*, system, {FOLD} AS fold FROM carried c JOIN bounds USING (patient_id, analyte) WHERE value IS NOT NULL),
burden AS (
  SELECT patient_id, system, day, avg(fold)::DECIMAL(18,4)::DOUBLE AS mean_fold, count(*) AS n, count(*) FILTER (day = from_day) AS fresh,
         string_agg(analyte, ',' ORDER BY analyte) AS tests
  FROM folds WHERE fold IS NOT NULL GROUP BY patient_id, system, day)
"""


@query(OBS_SQL + "SELECT patient_id, analyte, day, arg_max(value, (collected, seq)) AS value, max(collected) AS collected FROM obs GROUP BY ALL")
def last_of_day(spark, sf_dir):
    return points(spark, sf_dir).select("patient_id", "analyte", "day", "value", "collected")


@query(OBS_SQL + "SELECT patient_id, analyte, day, arg_max(value, (collected, -seq)) AS value FROM obs GROUP BY ALL")
def last_of_day_first_row(spark, sf_dir):
    return S.last_of_day(observations(spark, sf_dir), first_wins=True).select("patient_id", "analyte", "day", "value")


@query(RUNS_SQL + "SELECT * FROM run_found")
def monotonic_runs(spark, sf_dir):
    return S.run_findings(points(spark, sf_dir))


@query(RUNS_SQL + """,
jumps AS (
  SELECT *, value - p_value AS delta, abs(value - p_value) / coalesce(nullif(abs(p_value), 0), 1) AS rel,
         coalesce(abs(value - p_value) > high - low, false) AS wide FROM dirs WHERE day - p_day = 1),
kept AS (
  SELECT * FROM jumps j WHERE (rel > 0.5 OR wide) AND NOT EXISTS (
    SELECT 1 FROM long_runs r WHERE r.patient_id = j.patient_id AND r.analyte = j.analyte AND j.p_day >= r.first_day AND j.day <= r.last_day AND j.rel <= 1.0)),
best AS (SELECT *, row_number() OVER (PARTITION BY patient_id, analyte ORDER BY rel DESC, day) AS rn FROM kept)
SELECT patient_id, analyte, p_day, day, p_value, value,
       CASE WHEN sign(delta) = valence AND rel > 0.5 AND wide THEN 'high' WHEN sign(delta) = valence THEN 'moderate' ELSE 'info' END AS severity
FROM best WHERE rn = 1""")
def delta_24h(spark, sf_dir):
    return S.next_day_jumps(points(spark, sf_dir))


@query(CROSS_SQL + "SELECT * FROM crossings")
def range_crossings(spark, sf_dir):
    return S.range_crossings(points(spark, sf_dir))


@query(OBS_SQL + """,
g AS (SELECT patient_id, analyte, max(day) AS latest, max(day) FILTER (printed_flag IN ('CH', 'CL')) AS flagged, count(*) FILTER (printed_flag IN ('CH', 'CL')) AS n_flags FROM obs GROUP BY ALL)
SELECT CASE WHEN latest > flagged THEN 'high' ELSE 'critical' END AS severity, patient_id, analyte, flagged, latest, n_flags FROM g WHERE flagged IS NOT NULL""")
def critical_flags(spark, sf_dir):
    return S.critical_flags(observations(spark, sf_dir))


@query(POINTS_SQL + """,
scores AS (SELECT patient_id, day, sum(value)::DECIMAL(18,4)::DOUBLE AS score FROM points GROUP BY ALL),
pairs AS (SELECT b.patient_id, b.score - a.score AS rise, a.day AS p_day, b.day, a.score AS p_score, b.score FROM scores a JOIN scores b ON a.patient_id = b.patient_id AND b.day - a.day BETWEEN 1 AND 2 WHERE b.score - a.score >= 100),
lowest AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY rise DESC, p_day, p_score DESC, day DESC) AS rn FROM pairs)
SELECT patient_id, rise::DECIMAL(18,4)::DOUBLE AS rise, p_day, day, p_score, score FROM lowest WHERE rn = 1""")
def score_escalation(spark, sf_dir):
    scores = points(spark, sf_dir).groupBy("patient_id", "day").agg(fixed(F.sum("value")).alias("score"))
    return S.score_escalation(scores, 100.0, first_wins=True)


@query(MOVES_SQL + "SELECT patient_id, analyte, n, first_value, last_value, dir FROM moves")
def trend_window(spark, sf_dir):
    return S.trends(points(spark, sf_dir)).select("patient_id", "analyte", "n", "first_value", "last_value", "dir")


@query(MOVES_SQL + """SELECT patient_id, 2::BIGINT AS n_members FROM moves WHERE analyte IN ('view', 'click') GROUP BY patient_id
HAVING count(*) FILTER ((analyte = 'view' AND dir = 1) OR (analyte = 'click' AND dir = -1)) = 2""")
def conjunction(spark, sf_dir):
    return S.conjunction(S.trends(points(spark, sf_dir)), {"view": 1, "click": -1})


@query(MOVES_SQL + """,
g AS (SELECT patient_id, count(*) AS measured, count(*) FILTER (dir > 0) AS up, count(*) FILTER (dir < 0) AS down FROM moves GROUP BY patient_id)
SELECT CASE WHEN up >= 3 THEN 'cluster' ELSE 'improving' END AS rule, CASE WHEN up >= 4 THEN 'high' WHEN up >= 3 THEN 'moderate' ELSE 'info' END AS severity, *
FROM g WHERE measured >= 3 AND (up >= 3 OR (down >= 3 AND up = 0))""")
def cluster(spark, sf_dir):
    return S.clusters(S.trends(points(spark, sf_dir)), ["view", "click", "signup", "error", "purchase"])


@query(MOVES_SQL + """,
g AS (SELECT patient_id, count(*) FILTER (system = 'A') AS measured, count(*) FILTER (system = 'A' AND dir > 0) AS up, count(*) FILTER (system = 'A' AND dir < 0) AS down,
             count(*) FILTER (system = 'B' AND dir = valence) AS worse, count(*) FILTER (system = 'B' AND dir = -valence) AS better FROM moves GROUP BY patient_id)
SELECT patient_id, CASE WHEN down >= 2 AND up = 0 AND worse >= 1 THEN 'down-but-worse' ELSE 'up-but-better' END AS kind, up, down, worse, better
FROM g WHERE measured >= 2 AND ((down >= 2 AND up = 0 AND worse >= 1) OR (up >= 2 AND better >= 1 AND worse = 0))""")
def discordance(spark, sf_dir):
    return S.discordance(S.trends(points(spark, sf_dir)), "A", "B")


@query(carry_sql(2) + "SELECT *, day - from_day AS days_old FROM carried WHERE value IS NOT NULL")
def carry_forward_bounded(spark, sf_dir):
    return S.carried(points(spark, sf_dir))


@query(carry_sql(None) + "SELECT *, day - from_day AS days_old FROM carried WHERE value IS NOT NULL")
def carry_forward_unbounded(spark, sf_dir):
    return S.carried(points(spark, sf_dir), None)


@query(OBS_SQL + """,
bands AS (SELECT patient_id, seq, value AS band FROM obs WHERE analyte = 'signup'),
rows AS (SELECT patient_id, seq, value FROM obs WHERE analyte = 'view')
SELECT r.patient_id, r.seq, r.value, b.band FROM rows r ASOF LEFT JOIN bands b ON r.patient_id = b.patient_id AND r.seq >= b.seq""")
def asof_forward_fill(spark, sf_dir):
    o = observations(spark, sf_dir)
    bands = o.filter("analyte = 'signup'").select("patient_id", F.col("seq").alias("page"), F.col("value").alias("band"), "seq")
    rows = o.filter("analyte = 'view'").select("patient_id", F.col("seq").alias("page"), "value")
    return S.asof_backward(rows, bands, "patient_id", "page", "band").withColumnRenamed("page", "seq")


MOVEMENT_SQL = POINTS_SQL + """,
g AS (SELECT patient_id, analyte, count(*) AS n, arg_min(value, day) AS first_value, arg_max(value, day) AS last_value, any_value(valence) AS valence FROM points GROUP BY ALL),
m AS (SELECT *, (last_value - first_value) / abs(first_value) * 100 AS pct FROM g WHERE n >= 2 AND first_value <> 0),
movement AS (SELECT *, CASE WHEN abs(pct) < 5 THEN 'flat' WHEN valence IS NULL THEN 'changed' WHEN sign(pct) = valence THEN 'worse' ELSE 'better' END AS direction FROM m)
"""


@query(MOVEMENT_SQL + "SELECT patient_id, analyte, n, first_value, last_value, direction FROM movement")
def movement(spark, sf_dir):
    return S.movement(points(spark, sf_dir)).select("patient_id", "analyte", "n", "first_value", "last_value", "direction")


@query(MOVEMENT_SQL + "SELECT d.direction, count(m.direction) AS n FROM (VALUES ('worse'), ('better'), ('flat'), ('changed')) d(direction) LEFT JOIN movement m USING (direction) GROUP BY d.direction")
def movement_tally(spark, sf_dir):
    kinds = ("worse", "better", "flat", "changed")
    one = S.movement(points(spark, sf_dir)).agg(*[F.count_if(F.col("direction") == k).alias(k) for k in kinds])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("direction"), F.col(k).alias("n")) for k in kinds])))


@query(MOVEMENT_SQL + """SELECT patient_id, analyte, pct::DECIMAL(18,4)::DOUBLE AS pct, direction, place FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY abs(pct) DESC, analyte)::INT AS place FROM movement WHERE direction IN ('worse', 'better')) WHERE place <= 10""")
def directional_movers(spark, sf_dir):
    """The ten analytes of each patient that got worse or better by most."""
    return V.directional_movers(points(spark, sf_dir))


@query(BURDEN_SQL + """, states AS (SELECT patient_id, system, arg_min(mean_fold, day) AS first_fold, arg_max(mean_fold, day) AS last_fold FROM burden GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY last_fold DESC, system)::INT AS place FROM states""")
def systems_by_fold(spark, sf_dir):
    """The systems of each patient, the one furthest from its range first."""
    return V.systems_by_fold(points(spark, sf_dir))


@query(MOVEMENT_SQL + "SELECT patient_id, analyte, pct::DECIMAL(18,4)::DOUBLE AS pct, direction FROM movement ORDER BY abs(pct) DESC, patient_id, analyte LIMIT 40")
def top_movers(spark, sf_dir):
    return V.top_movers(points(spark, sf_dir))


@query(POINTS_SQL + f""",
o AS (SELECT *, coalesce(NOT ({IN_RANGE_SQL}), false) AS gone FROM points),
l AS (SELECT *, lag(gone) OVER w AS was, lag(value) OVER w AS before FROM o WINDOW w AS (PARTITION BY patient_id, analyte ORDER BY day)),
f AS (SELECT *, gone AND NOT coalesce(was, false) AS fresh,
             coalesce(abs(value - before) / coalesce(nullif(abs(before), 0), 1) >= 0.05, false) AND valence IS NOT NULL AS moved, sign(value - before) = valence AS bad FROM l)
SELECT patient_id, day, count(*) FILTER (fresh) AS newly_abnormal, count(*) FILTER (moved AND NOT bad) AS improved, count(*) FILTER (moved AND bad) AS worsened,
       coalesce(array_to_string(list_sort(list(analyte) FILTER (fresh))[1:6], ','), '') AS names FROM f GROUP BY ALL""")
def per_day_changes(spark, sf_dir):
    return S.per_day_changes(points(spark, sf_dir))


@query(POINTS_SQL + """,
d AS (SELECT *, value - lag(value) OVER (PARTITION BY patient_id, analyte ORDER BY day) AS delta FROM points),
l AS (SELECT patient_id, analyte, arg_max(delta, day) AS delta, any_value(valence) AS valence FROM d GROUP BY ALL)
SELECT patient_id, count(*) FILTER (sign(delta) = valence AND delta <> 0) AS worse, count(*) FILTER (sign(delta) <> valence AND delta <> 0) AS better FROM l GROUP BY ALL""")
def last_step_counts(spark, sf_dir):
    return S.last_step_counts(points(spark, sf_dir))


@query(BURDEN_SQL + "SELECT * FROM burden")
def system_burden(spark, sf_dir):
    return V.burden(points(spark, sf_dir))


@query(BURDEN_SQL + "SELECT patient_id, system, arg_min(mean_fold, day) AS first_fold, arg_max(mean_fold, day) AS last_fold, max(day) AS last_day FROM burden GROUP BY ALL")
def system_state(spark, sf_dir):
    return V.system_state(points(spark, sf_dir))


@query(POINTS_SQL + f", t AS (SELECT *, {FOLD} AS fold FROM points), u AS (SELECT *, count(*) OVER (PARTITION BY patient_id, analyte) AS n FROM t WHERE fold IS NOT NULL) SELECT patient_id, analyte, day, fold FROM u WHERE n >= 2")
def fold_tracks(spark, sf_dir):
    return V.fold_tracks(points(spark, sf_dir))


PAIRS = [("view", "click"), ("signup", "error")]


@query(POINTS_SQL + """,
pairs AS (SELECT a.patient_id, a.day, a.analyte AS first, b.analyte AS second, a.value AS first_value, b.value AS second_value
          FROM points a JOIN points b USING (patient_id, day) WHERE (a.analyte = 'view' AND b.analyte = 'click') OR (a.analyte = 'signup' AND b.analyte = 'error'))
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY patient_id, first, second) AS shared_days FROM pairs) WHERE shared_days >= 3""")
def pair_couples(spark, sf_dir):
    return V.couples(points(spark, sf_dir), PAIRS)


@query(POINTS_SQL + """,
pairs AS (SELECT a.analyte AS first, b.analyte AS second, a.value AS x, b.value AS y FROM points a JOIN points b USING (patient_id, day) WHERE
          list_position(['view', 'click', 'signup', 'error', 'purchase'], a.analyte) < list_position(['view', 'click', 'signup', 'error', 'purchase'], b.analyte)),
r AS (SELECT first, second, count(*) AS n, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r FROM pairs GROUP BY ALL)
SELECT first, second, n, r::DECIMAL(18,4)::DOUBLE AS r, CASE WHEN r >= 0.3 THEN 'together' WHEN r <= -0.3 THEN 'apart' ELSE 'unrelated' END AS label FROM r WHERE n >= 4 AND r IS NOT NULL""")
def correlation_grid(spark, sf_dir):
    return V.correlations(points(spark, sf_dir), ["view", "click", "signup", "error", "purchase"])


@query(POINTS_SQL + """SELECT a.patient_id, a.analyte, a.value AS before, b.value AS after, (b.value - a.value)::DECIMAL(18,4)::DOUBLE AS delta
FROM points a JOIN points b USING (patient_id, analyte) WHERE a.day = 5 AND b.day = 20""")
def compare_days(spark, sf_dir):
    return V.compare_days(points(spark, sf_dir), 5, 20)


HEAT = "least(coalesce(CASE WHEN high <> 0 AND value > high THEN value / high END, CASE WHEN low <> 0 AND value < low AND value > 0 THEN low / value END, 1.0), 20.0)"


@query(POINTS_SQL + "SELECT patient_id, analyte, day, value FROM points")
def matrix_days(spark, sf_dir):
    """The matrix by rows of day and value, for tables of any number of days."""
    return V.by_day(points(spark, sf_dir))


@query(POINTS_SQL + f"SELECT patient_id, analyte, day, ({HEAT})::DECIMAL(18,2)::DOUBLE AS fold FROM points")
def heatmap_days(spark, sf_dir):
    """The heatmap by rows of day and fold, for tables of any number of days."""
    return V.by_day(V.heat_folds(points(spark, sf_dir)), "fold")


@query(POINTS_SQL + f""", o AS (SELECT *, coalesce(NOT ({IN_RANGE_SQL}), false) AS gone FROM points),
g AS (SELECT patient_id, analyte, count(*) AS n, count(*) FILTER (gone) AS out_n, arg_max(value, day) AS latest, arg_min(value, day) AS first_value, any_value(low) AS low, any_value(high) AS high FROM o GROUP BY ALL)
SELECT patient_id, analyte, n, out_n, latest, (abs(latest - first_value) / coalesce(nullif(high - low, 0), nullif(abs(high), 0), nullif(abs(first_value), 0), 1))::DECIMAL(18,4)::DOUBLE AS magnitude FROM g""")
def matrix_stats(spark, sf_dir):
    return S.matrix_stats(points(spark, sf_dir))


@query(POINTS_SQL + "SELECT patient_id, analyte, count(*) AS n, min(value) AS least, median(value)::DECIMAL(18,4)::DOUBLE AS middle, max(value) AS most, arg_max(value, day) AS latest FROM points GROUP BY ALL")
def series_strips(spark, sf_dir):
    return V.strips(points(spark, sf_dir))


@query(POINTS_SQL + f""",
o AS (SELECT *, coalesce(NOT ({IN_RANGE_SQL}), false) AS gone FROM points),
g AS (SELECT analyte, count(*) AS n, count(DISTINCT patient_id) AS patients, min(value) AS least, max(value) AS most, count(*) FILTER (gone) AS n_outside,
             CASE any_value(analyte) WHEN 'view' THEN '10 to 60' WHEN 'click' THEN '10 to 60' WHEN 'signup' THEN 'up to 80' WHEN 'error' THEN 'from 3' ELSE 'no range' END AS range FROM o GROUP BY analyte),
c AS (SELECT analyte, coalesce(bool_or(printed_flag IN ('CH', 'CL')), false) AS any_critical FROM obs GROUP BY analyte)
SELECT * FROM g JOIN c USING (analyte)""")
def glossary_stats(spark, sf_dir):
    return V.glossary(points(spark, sf_dir), observations(spark, sf_dir))


@query(OBS_SQL + """
SELECT patient_id, analyte, seq, CASE WHEN count(*) OVER (PARTITION BY patient_id, analyte, day) > 1 THEN strftime(collected, '%Y-%m-%d %H:%M') ELSE strftime(collected, '%Y-%m-%d') END AS at,
       value, (value - lag(value) OVER (PARTITION BY patient_id, analyte ORDER BY collected, seq))::DECIMAL(18,4)::DOUBLE AS delta FROM obs""")
def flowsheet(spark, sf_dir):
    return V.flowsheet(observations(spark, sf_dir))


@query(CROSS_SQL + """,
jumps AS (SELECT *, value - p_value AS delta, abs(value - p_value) / coalesce(nullif(abs(p_value), 0), 1) AS rel, coalesce(abs(value - p_value) > high - low, false) AS wide FROM dirs WHERE day - p_day = 1),
kept AS (SELECT * FROM jumps j WHERE (rel > 0.5 OR wide) AND NOT EXISTS (
  SELECT 1 FROM long_runs r WHERE r.patient_id = j.patient_id AND r.analyte = j.analyte AND j.p_day >= r.first_day AND j.day <= r.last_day AND j.rel <= 1.0)),
best AS (SELECT *, row_number() OVER (PARTITION BY patient_id, analyte ORDER BY rel DESC, day) AS rn FROM kept),
flags AS (SELECT patient_id, analyte, max(day) AS latest, max(day) FILTER (printed_flag IN ('CH', 'CL')) AS flagged FROM obs GROUP BY ALL)
SELECT * FROM found
UNION ALL SELECT 'delta-24h', CASE WHEN sign(delta) = valence AND rel > 0.5 AND wide THEN 'high' WHEN sign(delta) = valence THEN 'moderate' ELSE 'info' END, patient_id, analyte, p_day, day FROM best WHERE rn = 1
UNION ALL SELECT 'critical-flag', CASE WHEN latest > flagged THEN 'high' ELSE 'critical' END, patient_id, analyte, flagged, latest FROM flags WHERE flagged IS NOT NULL""")
def series_findings(spark, sf_dir):
    return R.series_findings(points(spark, sf_dir), observations(spark, sf_dir))


#: The ten rules, with the events' analytes in the roles of the markers.
NAMES = [a[0] for a in ANALYTES]
EVENT_MOVE_RULES = [partial(R.failure, wanted={"view": 1, "click": -1}), partial(R.renal, wanted={"signup": 1, "error": -1}), partial(R.infection, members=NAMES), partial(R.perfusion, rising="view"), partial(R.discordant, one=["view", "click"], other=["signup", "error"], least=1)]
EVENT_POINT_RULES = [partial(R.low_oxygen, low_of="error")]
ALL_SQL = CROSS_SQL + MOVES_SQL.removeprefix(POINTS_SQL) + """,
jumps AS (SELECT *, value - p_value AS delta, abs(value - p_value) / coalesce(nullif(abs(p_value), 0), 1) AS rel, coalesce(abs(value - p_value) > high - low, false) AS wide FROM dirs WHERE day - p_day = 1),
kept AS (SELECT * FROM jumps j WHERE (rel > 0.5 OR wide) AND NOT EXISTS (
  SELECT 1 FROM long_runs r WHERE r.patient_id = j.patient_id AND r.analyte = j.analyte AND j.p_day >= r.first_day AND j.day <= r.last_day AND j.rel <= 1.0)),
best AS (SELECT *, row_number() OVER (PARTITION BY patient_id, analyte ORDER BY rel DESC, day) AS rn FROM kept),
flags AS (SELECT patient_id, analyte, max(day) AS latest, max(day) FILTER (printed_flag IN ('CH', 'CL')) AS flagged FROM obs GROUP BY ALL),
scores AS (SELECT patient_id, day, sum(value)::DECIMAL(18,4)::DOUBLE AS score FROM points GROUP BY ALL),
pairs AS (SELECT b.patient_id, b.score - a.score AS rise, a.day AS p_day, b.day, a.score AS p_score FROM scores a JOIN scores b ON a.patient_id = b.patient_id AND b.day - a.day BETWEEN 1 AND 2 WHERE b.score - a.score >= 100),
risen AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY rise DESC, p_day, p_score DESC, day DESC) AS rn FROM pairs),
spans AS (SELECT patient_id, analyte, min(day) AS first_day, max(day) AS last_day FROM ends WHERE day > record_end - 3 GROUP BY ALL),
m AS (SELECT * FROM moves JOIN spans USING (patient_id, analyte)),
g AS (
  SELECT patient_id, min(first_day) AS from_day, max(last_day) AS to_day, count(*) AS measured, count(*) FILTER (dir > 0) AS up, count(*) FILTER (dir < 0) AS down,
         min(first_day) FILTER (dir <> 0) AS moved_from, max(last_day) FILTER (dir <> 0) AS moved_to,
         min(first_day) FILTER (analyte IN ('view', 'click')) AS a_from, max(last_day) FILTER (analyte IN ('view', 'click')) AS a_to,
         min(first_day) FILTER (analyte IN ('signup', 'error')) AS b_from, max(last_day) FILTER (analyte IN ('signup', 'error')) AS b_to,
         count(*) FILTER ((analyte = 'view' AND dir = 1) OR (analyte = 'click' AND dir = -1)) AS failing,
         count(*) FILTER ((analyte = 'signup' AND dir = 1) OR (analyte = 'error' AND dir = -1)) AS renal,
         count(*) FILTER (system = 'A') AS a_measured, count(*) FILTER (system = 'A' AND dir > 0) AS a_up, count(*) FILTER (system = 'A' AND dir < 0) AS a_down,
         count(*) FILTER (system = 'B' AND dir = valence) AS worse, count(*) FILTER (system = 'B' AND dir = -valence) AS better
  FROM m GROUP BY patient_id),
ends_of AS (SELECT *, row_number() OVER (PARTITION BY patient_id, analyte ORDER BY day DESC) AS rn FROM points WHERE analyte = 'error'),
everything AS (
  SELECT * FROM found
  UNION ALL SELECT 'delta-24h', CASE WHEN sign(delta) = valence AND rel > 0.5 AND wide THEN 'high' WHEN sign(delta) = valence THEN 'moderate' ELSE 'info' END, patient_id, analyte, p_day, day FROM best WHERE rn = 1
  UNION ALL SELECT 'critical-flag', CASE WHEN latest > flagged THEN 'high' ELSE 'critical' END, patient_id, analyte, flagged, latest FROM flags WHERE flagged IS NOT NULL
  UNION ALL SELECT 'meld-escalation', 'high', patient_id, NULL, p_day, day FROM risen WHERE rn = 1
  UNION ALL SELECT 'synthetic-failure', 'high', patient_id, NULL, a_from, a_to FROM g WHERE failing = 2
  UNION ALL SELECT 'renal-cluster', 'high', patient_id, NULL, b_from, b_to FROM g WHERE renal = 2
  UNION ALL SELECT CASE WHEN up >= 3 THEN 'infection-cluster' ELSE 'infection-improving' END, CASE WHEN up >= 4 THEN 'high' WHEN up >= 3 THEN 'moderate' ELSE 'info' END, patient_id, NULL, moved_from, moved_to
    FROM g WHERE measured >= 3 AND (up >= 3 OR (down >= 3 AND up = 0))
  UNION ALL SELECT 'perfusion', CASE WHEN last_value > high THEN 'high' ELSE 'moderate' END, patient_id, analyte, first_day, last_day FROM m WHERE analyte = 'view' AND dir > 0
  UNION ALL SELECT 'discordance', 'moderate', patient_id, NULL, least(a_from, b_from), greatest(a_to, b_to)
    FROM g WHERE a_measured >= 2 AND ((a_down >= 2 AND a_up = 0 AND worse >= 1) OR (a_up >= 2 AND better >= 1 AND worse = 0))
  UNION ALL SELECT 'low-oxygen', 'moderate', patient_id, analyte, day, day FROM ends_of WHERE rn = 1 AND value < low)
"""


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all ten rules, each part of which reads the points anew."""
    p = points(spark, sf_dir)
    scores = p.groupBy("patient_id", "day").agg(fixed(F.sum("value")).alias("score"))
    return R.all_findings(p, observations(spark, sf_dir), scores, EVENT_MOVE_RULES, EVENT_POINT_RULES, 100.0, first_wins=True)


@query(ALL_SQL + "SELECT * FROM everything")
def all_findings(spark, sf_dir):
    return everything(spark, sf_dir)


@query(ALL_SQL + "SELECT severity, count(*) AS n FROM everything GROUP BY ALL")
def all_severity_counts(spark, sf_dir):
    return everything(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))


@query(ALL_SQL + f"""SELECT row_number() OVER (ORDER BY {RANK_SQL}, rule, analyte NULLS FIRST, patient_id, from_day)::INT AS place, severity, rule, patient_id, analyte, from_day, to_day
FROM everything ORDER BY place LIMIT 200""")
def all_findings_ranked(spark, sf_dir):
    return V.ranked(everything(spark, sf_dir), 200)


@query(ALL_SQL + f"""SELECT * FROM (SELECT patient_id, row_number() OVER (PARTITION BY patient_id ORDER BY {RANK_SQL}, from_day, rule, analyte NULLS FIRST)::INT AS place, severity, rule, analyte, from_day
FROM everything WHERE {RANK_SQL} <= 3) WHERE place <= 18""")
def all_findings_timeline(spark, sf_dir):
    return V.timeline(everything(spark, sf_dir))


@query(ALL_SQL + "SELECT * FROM everything WHERE rule IN ('perfusion', 'low-oxygen')")
def trend_alarms(spark, sf_dir):
    """A marker that rises in the last days, and one whose last value, of however old a day, is below its range."""
    p = points(spark, sf_dir)
    return R.perfusion(S.trends(p), "view").unionByName(R.low_oxygen(p, "error"))


@query(ALL_SQL + """, heard AS (SELECT *, rule = 'discordance' OR rule IN ('rising-run', 'falling-run', 'delta-24h') AND analyte = 'purchase' AS doctor_only FROM everything)
SELECT rule, count(*) AS n FROM heard WHERE NOT doctor_only GROUP BY rule""")
def findings_for_family(spark, sf_dir):
    """Findings by rule that are for the family, too."""
    way = F.when(F.col("analyte") != "purchase", 1)
    return R.for_audience(everything(spark, sf_dir), "family", way).groupBy("rule").agg(F.count("*").alias("n"))


@query(OBS_SQL + "SELECT patient_id, analyte, seq, day, value FROM obs WHERE day IN (1, 2, 3, 4, 5) AND analyte IN ('view', 'click', 'error') AND system IN ('A') AND interpretation <> 'N' AND contains(lower(analyte), 'ie')")
def interactive_filter(spark, sf_dir):
    o = observations(spark, sf_dir)
    return V.filter_observations(o, days=[1, 2, 3, 4, 5], analytes=["view", "click", "error"], groups=["A"], abnormal=True, text="IE").select("patient_id", "analyte", "seq", "day", "value")


@query("""SELECT o_custkey, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice)::DECIMAL(18,2)::DOUBLE AS total, count(*) AS n,
arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_order FROM orders GROUP BY ALL""")
def orders_by_month(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", F.to_date(F.trunc("o_orderdate", "month")).alias("month")).agg(fixed(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest_order"))
