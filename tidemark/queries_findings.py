"""Queries over events in the roles of laboratory values: all scores of every day, findings in words, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixed_values as X
from .functions.exprs import general
from .functions.words import PLURAL
from .operators import series as S
from .plans import daily as C
from .plans import findings as W
from .plans.scores import FORMULAS
from .sources.dictionary import as_of
from .sources.roles import ROLE_SQL, dictionary, observations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


USED = [*C.CARRIED, "anc", "alc", "abg_sodium", "abg_chloride", "abg_hco3", "pt", "pt_mnpt"]
LACKS = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"


def lacks(*names: str) -> str:
    return LACKS.format(", ".join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n in names))


def cut_points(x: str, low: float, high: float) -> str:
    return f"CASE WHEN {x} < {low} THEN 1 WHEN {x} > {high} THEN 3 ELSE 2 END"


BAND = "CASE WHEN {0} IS NULL THEN '' WHEN {0} <= 9 THEN '<=9' WHEN {0} <= 19 THEN '10-19' WHEN {0} <= 29 THEN '20-29' WHEN {0} <= 39 THEN '30-39' ELSE '>=40' END"
SCORE_SQL = ROLE_SQL + f""",
own AS (SELECT patient_id, day, max(collected) AS collected, {", ".join(f"max(value) FILTER (analyte = '{a}') AS {a}" for a in USED)} FROM points GROUP BY ALL),
held AS (
  SELECT patient_id, day, collected, {", ".join(a for a in USED if a not in C.CARRIED)},
         {", ".join(f"last_value({a} IGNORE NULLS) OVER w AS {a}, last_value(CASE WHEN {a} IS NOT NULL THEN day END IGNORE NULLS) OVER w AS from_{a}" for a in C.CARRIED)}
  FROM own WINDOW w AS (PARTITION BY patient_id ORDER BY day RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)),
clamped AS (
  SELECT *, greatest(bilirubin_total, 1.0) AS bb, greatest(inr, 1.0) AS ii, greatest(least(creatinine, 3.0), 1.0) AS c3, greatest(least(creatinine, 4.0), 1.0) AS c4,
         greatest(least(sodium, 137.0), 125.0) AS nn, greatest(least(albumin, 3.5), 1.5) AS aa,
         bilirubin_total IS NOT NULL AND inr IS NOT NULL AND creatinine IS NOT NULL AND sodium IS NOT NULL AS four FROM held),
firsts AS (SELECT *, floor((0.957 * ln(c4) + 0.378 * ln(bb) + 1.12 * ln(ii) + 0.643) * 100 + 0.5) / 10 AS mi FROM clamped),
scored AS (
  SELECT *, CASE WHEN four AND albumin IS NOT NULL THEN greatest(least(floor(4.56 * ln(bb) + 0.82 * (137 - nn) - 0.24 * (137 - nn) * ln(bb) + 9.09 * ln(ii) + 11.14 * ln(c3) + 1.85 * (3.5 - aa) - 1.83 * (3.5 - aa) * ln(c3) + 6 + 0.5), 40), 6)::DOUBLE END AS meld3,
         CASE WHEN four THEN greatest(least(floor(CASE WHEN mi > 11 THEN mi + 1.32 * (137 - nn) - 0.033 * mi * (137 - nn) ELSE mi END + 0.5), 40), 6)::DOUBLE END AS meld_na,
         (anc / nullif(alc, 0))::DECIMAL(18,2)::DOUBLE AS nlr, (abg_sodium - (abg_chloride + abg_hco3))::DECIMAL(18,1)::DOUBLE AS anion_gap,
         (4.6 * (pt - pt_mnpt) + bilirubin_total)::DECIMAL(18,1)::DOUBLE AS maddrey
  FROM firsts)
"""


@query(SCORE_SQL + f"""
SELECT patient_id, day, collected, meld3, {BAND.format("meld3")} AS meld3_band, {lacks("bilirubin_total", "inr", "creatinine", "sodium", "albumin")} AS meld3_missing,
       meld_na, {BAND.format("meld_na")} AS meld_na_band, {lacks("bilirubin_total", "inr", "creatinine", "sodium")} AS meld_na_missing,
       concat_ws(',', nullif({lacks("bilirubin_total", "albumin", "inr")}, ''), 'ascites_grade', 'encephalopathy_grade') AS child_pugh_missing,
       concat_ws(',', nullif({lacks("bilirubin_total", "creatinine", "inr", "lactate")}, ''), 'encephalopathy_grade') AS aarc_missing,
       nlr, {lacks("anc", "alc")} AS nlr_missing, anion_gap, CASE WHEN anion_gap IS NULL THEN '' WHEN anion_gap BETWEEN 2 AND 26 THEN 'in-envelope' ELSE 'outside-envelope' END AS anion_gap_band,
       {lacks("abg_sodium", "abg_chloride", "abg_hco3")} AS anion_gap_missing, maddrey, CASE WHEN maddrey IS NULL THEN '' WHEN maddrey >= 32 THEN 'severe' ELSE 'non-severe' END AS maddrey_band,
       {lacks("pt", "pt_mnpt", "bilirubin_total")} AS maddrey_missing,
       array_to_string(list_sort(list_filter([{", ".join(f"CASE WHEN from_{a} < day THEN '{a} of day ' || from_{a} || ', ' || (day - from_{a}) || ' old' END" for a in C.CARRIED)}], lambda x: x IS NOT NULL)), '; ') AS carried
FROM scored""")
def daily_scores(spark, sf_dir):
    """All scores of all patients and days, with what was missing and what came from earlier days."""
    d = C.daily_scores(observations(spark, sf_dir))
    lack = lambda n: F.array_join(F.col(n)["missing"], ",").alias(f"{n}_missing")
    out = ["patient_id", "day", "collected"]
    for n in C.SCORES:
        out.append(lack(n))
        if n not in ("child_pugh", "aarc"):
            out.append(F.col(n)["value"].alias(n))
        if n in ("meld3", "meld_na", "anion_gap", "maddrey"):
            out.append(F.col(n)["band"].alias(f"{n}_band"))
    old = F.transform(F.map_entries("carried_forward"), lambda e: F.format_string("%s of day %d, %d old", e["key"], e["value"]["from_day"], e["value"]["days_old"]))
    return d.select(*out, F.array_join(F.array_sort(old), "; ").alias("carried"))


CARD_LACKS = {
    "meld3": lacks("bilirubin_total", "inr", "creatinine", "sodium", "albumin"),
    "meld_na": lacks("bilirubin_total", "inr", "creatinine", "sodium"),
    "child_pugh": f"""concat_ws(',', nullif({lacks("bilirubin_total", "albumin", "inr")}, ''), 'ascites_grade', 'encephalopathy_grade')""",
    "aarc": f"""concat_ws(',', nullif({lacks("bilirubin_total", "creatinine", "inr", "lactate")}, ''), 'encephalopathy_grade')""",
    "nlr": lacks("anc", "alc"),
    "anion_gap": lacks("abg_sodium", "abg_chloride", "abg_hco3"),
    "maddrey": lacks("pt", "pt_mnpt", "bilirubin_total"),
}


@query(SCORE_SQL + ", latest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY day DESC) = 1) " + " UNION ALL ".join(
    f"SELECT patient_id, day, '{n}' AS name, '{inputs}' AS inputs, '{scale}' AS scale, {'false' if n in ('child_pugh', 'aarc') else f'{n} IS NOT NULL'} AS complete, {'NULL::DOUBLE' if n in ('child_pugh', 'aarc') else n} AS value, {CARD_LACKS[n]} AS missing, '{C.LACTATE_NOTE if n == 'aarc' else ''}' AS notes FROM latest"
    for n, inputs, scale in FORMULAS))
def formula_cards(spark, sf_dir):
    """Each score's inputs and scale beside each patient's latest value, or what was missing for it."""
    c = C.formula_cards(C.daily_scores(observations(spark, sf_dir)))
    return c.withColumns({"missing": F.array_join("missing", ","), "notes": F.array_join("notes", ",")})


# --- findings in words --------------------------------------------------------------------------

def g(x: str) -> str:
    return f"format('{{:g}}', {x})"


def unit(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN ' ' || {x} ELSE '' END"


def when(a: str, b: str) -> str:
    return f"CASE WHEN {a}::DATE = {b}::DATE THEN strftime({b}, '%d %b') WHEN month({a}) = month({b}) THEN strftime({a}, '%d') || '-' || strftime({b}, '%d %b') ELSE strftime({a}, '%d %b') || '-' || strftime({b}, '%d %b') END"


def bounds(low: str, high: str) -> str:
    return f"CASE WHEN {low} IS NOT NULL AND {high} IS NOT NULL THEN 'Reference ' || {g(low)} || '-' || {g(high)} || '.' WHEN {high} IS NOT NULL THEN 'Reference upper limit ' || {g(high)} || '.' WHEN {low} IS NOT NULL THEN 'Reference lower limit ' || {g(low)} || '.' ELSE '' END"


def said(text: str, *parts: str) -> str:
    """A fixed sentence with its places filled."""
    out, rest = [], text.replace("%%", "\0").replace("%d", "%s").split("%s")
    for k, piece in enumerate(rest):
        literal = piece.replace("\0", "%").replace("'", "''")
        out.append(f"'{literal}'")
        if k < len(parts):
            out.append(f"({parts[k]})")
    return " || ".join(out)


def row(day: str, value: str, analyte: str = "''") -> str:
    return f"{day} || ':' || {g(value)} || CASE WHEN {analyte} <> '' THEN ':' || {analyte} ELSE '' END"


def quoted(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


def voice(direction: str, worse: str) -> str:
    return f"CASE WHEN {direction} = valence THEN {worse} ELSE 'info' END AS severity, patient_id, analyte"


WHO = "CASE WHEN valence IS NULL THEN 'doctor' ELSE 'doctor,family' END"


def tails(members, least: int = 2) -> str:
    """Lists over a patient's tails of ``members``, in their order."""
    return f"list_filter([{', '.join(f'm[{k!r}]' for k in members)}], lambda t: t IS NOT NULL AND t.n >= {least})"


def conjunction(rule: str, lead: str, wanted: dict, head: str, gloss: str, note: str = "") -> str:
    have = f"[{', '.join(f'm[{a!r}]' for a in wanted)}]"
    fits = " AND ".join(f"coalesce(m['{a}'].dir = {d}, false)" for a, d in wanted.items())
    a, b = f"list_min(list_transform({have}, lambda t: t.first_at))", f"list_max(list_transform({have}, lambda t: t.last_at))"
    detail = f"trim({said(gloss + ' over ')} || {when(a, b)} || ': ' || array_to_string(list_transform({have}, lambda t: t.summary), ', ') || {said('. ' + note)})"
    return f"SELECT '{rule}' AS rule, 'high' AS severity, patient_id, '{lead}' AS analyte, {said(head)} AS headline, {detail} AS detail, array_to_string(list_transform({have}, lambda t: t.rows), ';') AS evidence, 'doctor,family' AS audience FROM tailed WHERE {fits}"


HAVE, LIVER = tails(X.INFECTION_MARKERS), tails(X.LIVER_MARKERS)
WORD_SQL = SCORE_SQL + f""",
steps AS (SELECT *, lag(value) OVER w AS p_value, lag(day) OVER w AS p_day, lag(collected) OVER w AS p_at FROM points WINDOW w AS (PARTITION BY patient_id, analyte ORDER BY day)),
dirs AS (SELECT *, CASE WHEN p_value IS NULL THEN NULL WHEN abs(value - p_value) < 0.03 * coalesce(nullif(abs(p_value), 0), 1) THEN 0 ELSE sign(value - p_value)::INT END AS dir FROM steps),
turns AS (SELECT *, CASE WHEN dir IS NOT DISTINCT FROM lag(dir) OVER w THEN 0 ELSE 1 END AS turn FROM dirs WINDOW w AS (PARTITION BY patient_id, analyte ORDER BY day)),
islands AS (SELECT *, sum(turn) OVER (PARTITION BY patient_id, analyte ORDER BY day) AS island FROM turns),
run_all AS (
  SELECT patient_id, analyte, dir, count(*) AS n, arg_min({{'day': p_day, 'value': p_value, 'at': p_at}}, day) AS f, arg_max({{'day': day, 'value': value, 'at': collected, 'low': low, 'high': high, 'unit': unit, 'display': display}}, day) AS l,
         list({{'day': day, 'value': value}} ORDER BY day) AS rest, any_value(valence) AS valence
  FROM islands WHERE dir <> 0 GROUP BY patient_id, analyte, island, dir),
runs AS (SELECT *, list_prepend({{'day': f.day, 'value': f.value}}, rest) AS pts, (l.value - f.value) / coalesce(nullif(abs(f.value), 0), 1) AS change
         FROM run_all WHERE n >= 2 AND abs(l.value - f.value) / coalesce(nullif(abs(f.value), 0), 1) >= 0.10),
in_runs AS (SELECT patient_id, analyte, flatten(list(list_transform(pts, lambda p: p.day))) AS days FROM runs GROUP BY ALL),
jumps AS (SELECT s.*, value - p_value AS change, abs(value - p_value) / coalesce(nullif(abs(p_value), 0), 1) AS rel, (value - p_value) / coalesce(nullif(abs(p_value), 0), 1) * 100 AS pct,
                 high - low AS wide, coalesce(abs(value - p_value) > high - low, false) AS by_width, days FROM steps s LEFT JOIN in_runs USING (patient_id, analyte) WHERE day - p_day = 1),
sharp AS (SELECT * FROM jumps WHERE (rel > 0.5 OR by_width) AND NOT (coalesce(list_contains(days, p_day) AND list_contains(days, day), false) AND rel <= 1.0)
          QUALIFY row_number() OVER (PARTITION BY patient_id, analyte ORDER BY rel DESC, day) = 1),
sides AS (SELECT *, CASE WHEN low IS NULL AND high IS NULL THEN NULL ELSE NOT (coalesce(value < low, false) OR coalesce(value > high, false)) END AS inside FROM steps),
crossed AS (SELECT *, lag(inside) OVER (PARTITION BY patient_id, analyte ORDER BY day) AS was FROM sides QUALIFY inside <> was),
exits AS (SELECT *, count(*) FILTER (NOT inside) OVER (PARTITION BY patient_id, analyte ORDER BY day) AS nth FROM crossed),
marked AS (SELECT *, printed_flag IN ('CH', 'CL') AS crit FROM obs),
flags AS (
  SELECT patient_id, analyte, list({{'day': day, 'value': value}} ORDER BY day, seq) FILTER (crit) AS days, arg_max({{'day': day, 'value': value, 'flag': printed_flag, 'unit': unit, 'low': low, 'high': high, 'display': display}}, (day, seq)) FILTER (crit) AS l,
         arg_max({{'day': day, 'value': value}}, (day, collected, -seq)) AS latest
  FROM marked GROUP BY ALL HAVING count(*) FILTER (crit) > 0),
told AS (
  SELECT *, latest.day > l.day AS later, l.display || ' ' || {g('l.value')} || {unit('l.unit')} || ' flagged ' || l.flag || ' on day(s) ' || array_to_string(list_transform(days, lambda d: d.day), ', ') AS start,
         CASE WHEN l.low IS NOT NULL AND l.high IS NOT NULL THEN '; reference ' || {g('l.low')} || '-' || {g('l.high')} || '.' ELSE '.' END AS stop FROM flags),
climbs AS (
  SELECT b.patient_id, b.meld3 - a.meld3 AS rise, a.day AS p_day, a.meld3 AS p_score, b.day, b.meld3 AS score FROM scored a JOIN scored b ON a.patient_id = b.patient_id AND b.day - a.day BETWEEN 1 AND 2
  WHERE b.meld3 - a.meld3 >= 3 QUALIFY row_number() OVER (PARTITION BY b.patient_id ORDER BY b.meld3 - a.meld3 DESC, a.day DESC, a.meld3 DESC, b.day DESC) = 1),
recent AS (SELECT *, max(day) OVER (PARTITION BY patient_id) - 3 < day AS fresh FROM points),
series AS (
  SELECT patient_id, analyte, count(*) FILTER (fresh) AS n, arg_min({{'value': value, 'at': collected}}, day) FILTER (fresh) AS f, arg_max({{'day': day, 'value': value, 'at': collected, 'low': low, 'high': high, 'unit': unit, 'display': display}}, day) AS l,
         string_agg({g('value')}, ' -> ' ORDER BY day) FILTER (fresh) AS chain, string_agg({row('day', 'value', 'analyte')}, ';' ORDER BY day) FILTER (fresh) AS rows, string_agg({row('day', 'value')}, ';' ORDER BY day) FILTER (fresh) AS bare, any_value(valence) AS valence
  FROM recent GROUP BY ALL),
moving AS (SELECT *, CASE WHEN n < 2 THEN 0 WHEN abs(l.value - f.value) < 0.03 * coalesce(nullif(abs(f.value), 0), 1) THEN 0 ELSE sign(l.value - f.value)::INT END AS dir FROM series),
tailed AS (
  SELECT patient_id, map_from_entries(list({{'k': analyte, 'v': {{'n': n, 'dir': dir, 'first_at': f.at, 'last_at': l.at, 'chain': chain, 'rows': rows, 'bare': bare, 'valence': valence, 'l': l,
         'summary': l.display || ' ' || {g('f.value')} || '->' || {g('l.value')} || {unit('l.unit')}}}}})) AS m FROM moving GROUP BY ALL),
infected AS (SELECT patient_id, m, {HAVE} AS have, {LIVER} AS liver FROM tailed),
counted AS (
  SELECT *, len(have) AS n, len(list_filter(have, lambda t: t.dir > 0)) AS up, len(list_filter(have, lambda t: t.dir < 0)) AS down, list_filter(have, lambda t: t.dir <> 0) AS moved,
         len(list_filter(liver, lambda t: t.dir <> 0 AND t.dir = t.valence)) AS worse, len(list_filter(liver, lambda t: t.dir <> 0 AND t.dir = -t.valence)) AS better FROM infected),
found AS (
  SELECT CASE WHEN dir > 0 THEN 'rising-run' ELSE 'falling-run' END AS rule, {voice('dir', "CASE WHEN len(pts) >= 5 THEN 'high' ELSE 'moderate' END")},
         CASE WHEN dir = -valence THEN {said(X.RUN_HEAD_BETTER, 'l.display', f"CASE WHEN dir > 0 THEN '{X.RISEN}' ELSE '{X.FALLEN}' END", 'l.day - f.day')} ELSE {said(X.RUN_HEAD, 'l.display', f"CASE WHEN dir > 0 THEN '{X.RISEN}' ELSE '{X.FALLEN}' END", 'l.day - f.day')} END AS headline,
         trim({said(X.RUN_DETAIL, f"array_to_string(list_transform(pts, lambda p: {g('p.value')}), ' -> ') || {unit('l.unit')}", when('f.at', 'l.at'), "format('{:+.0f}', change * 100)", 'l.day - f.day', bounds('l.low', 'l.high'))}) AS detail,
         array_to_string(list_transform(pts, lambda p: {row('p.day', 'p.value')}), ';') AS evidence, {WHO} AS audience FROM runs
  UNION ALL
  SELECT 'delta-24h', {voice('sign(change)', "CASE WHEN rel > 0.5 AND by_width THEN 'high' ELSE 'moderate' END")},
         {said(X.DELTA_HEAD, 'display', f"CASE WHEN change > 0 THEN '{X.ROSE}' ELSE '{X.FELL}' END", f"CASE WHEN rel > 0.5 THEN '{X.BY_SHARE}' ELSE '{X.BY_WIDTH}' END")},
         {g('p_value')} || ' -> ' || {g('value')} || {unit('unit')} || ' (' || {when('p_at', 'collected')} || '); ' || format('{{:+g}}', change) || ' (' || format('{{:+.0f}}', pct) || '%)' || CASE WHEN wide IS NOT NULL THEN ', range width ' || {g('wide')} ELSE '' END || rtrim('. ' || {bounds('low', 'high')}),
         {row('p_day', 'p_value')} || ';' || {row('day', 'value')}, {WHO} FROM sharp
  UNION ALL
  SELECT CASE WHEN inside THEN 'range-return' ELSE 'range-exit' END, CASE WHEN inside THEN 'info' WHEN headline THEN 'high' ELSE 'moderate' END, patient_id, analyte,
         CASE WHEN inside THEN {said(X.RETURN_HEAD, 'display')} WHEN nth = 1 THEN {said(X.EXIT_HEAD, 'display')} ELSE {said(X.EXIT_AGAIN_HEAD, 'display')} END,
         {g('p_value')} || ' -> ' || {g('value')} || ' (' || CASE WHEN inside THEN 'within reference' WHEN value > high THEN 'above range' ELSE 'below range' END || ')' || {unit('unit')} || ' (' || {when('p_at', 'collected')} || '). ' || {bounds('low', 'high')},
         {row('p_day', 'p_value')} || ';' || {row('day', 'value')}, 'doctor,family' FROM exits
  UNION ALL
  SELECT 'critical-flag', CASE WHEN later THEN 'high' ELSE 'critical' END, patient_id, analyte, CASE WHEN later THEN {said(X.RESOLVED_HEAD, 'lower(l.display)')} ELSE {said(X.CRITICAL_HEAD, 'lower(l.display)')} END,
         start || CASE WHEN later THEN '; latest ' || {g('latest.value')} || {unit('l.unit')} || ' on day ' || latest.day || ' is unflagged' ELSE '' END || stop,
         array_to_string(list_transform(days, lambda d: {row('d.day', 'd.value')}), ';') || CASE WHEN later THEN ';' || {row('latest.day', 'latest.value')} ELSE '' END, 'doctor,family' FROM told
  UNION ALL
  SELECT 'meld-escalation', 'high', patient_id, NULL, {said(X.MELD_HEAD)}, {said(X.MELD_DETAIL, g('p_score'), 'p_day', g('score'), 'day', g('rise'), 'day - p_day')}, {row('p_day', 'p_score')} || ';' || {row('day', 'score')}, 'doctor,family' FROM climbs
  UNION ALL {conjunction('synthetic-failure', 'inr', X.FAILURE, X.FAILURE_HEAD, X.FAILURE_GLOSS)}
  UNION ALL {conjunction('renal-cluster', 'creatinine', X.RENAL, X.RENAL_HEAD, X.RENAL_GLOSS, X.RENAL_NOTE)}
  UNION ALL
  SELECT CASE WHEN up >= 3 THEN 'infection-cluster' ELSE 'infection-improving' END, CASE WHEN up >= 4 THEN 'high' WHEN up >= 3 THEN 'moderate' ELSE 'info' END, patient_id, 'procalcitonin',
         CASE WHEN up >= 3 THEN {said(X.INFECTION_HEAD)} ELSE {said(X.SETTLING_HEAD)} END,
         CASE WHEN up >= 3 THEN up || ' of ' || n || ' infection markers rising: ' ELSE down || ' of ' || n || ' infection markers falling: ' END || array_to_string(list_transform(moved, lambda t: t.summary), ', ') || '.',
         array_to_string(list_transform(moved, lambda t: t.rows), ';'), 'doctor,family' FROM counted WHERE n >= 3 AND (up >= 3 OR down >= 3 AND up = 0)
  UNION ALL
  SELECT 'perfusion', CASE WHEN m['lactate'].l.value > m['lactate'].l.high THEN 'high' ELSE 'moderate' END, patient_id, 'lactate', {said(X.PERFUSION_HEAD)},
         trim('Lactate ' || m['lactate'].chain || {unit("m['lactate'].l.unit")} || ' (' || {when("m['lactate'].first_at", "m['lactate'].last_at")} || '). ' || {bounds("m['lactate'].l.low", "m['lactate'].l.high")}), m['lactate'].bare, 'doctor,family' FROM tailed WHERE m['lactate'].dir > 0
  UNION ALL
  SELECT 'low-oxygen', 'moderate', patient_id, 'abg_po2', {said(X.OXYGEN_HEAD)}, 'pO2 ' || {g('l.value')} || {unit('l.unit')} || ' (' || {when('l.at', 'l.at')} || '). ' || {bounds('l.low', 'l.high')}, {row('l.day', 'l.value')}, 'doctor,family'
  FROM (SELECT patient_id, m['abg_po2'].l AS l FROM tailed) WHERE l.value < l.low
  UNION ALL
  SELECT 'discordance', 'moderate', patient_id, NULL, CASE WHEN down >= 2 AND up = 0 AND worse >= 2 THEN {said(X.LIVER_WORSE_HEAD)} ELSE {said(X.LIVER_BETTER_HEAD)} END,
         CASE WHEN down >= 2 AND up = 0 AND worse >= 2 THEN {said(X.LIVER_WORSE_DETAIL, 'down', 'n', 'worse', 'len(liver)')} ELSE {said(X.LIVER_BETTER_DETAIL, 'up', 'n', 'better', 'len(liver)')} END,
         array_to_string(list_transform(list_concat(have, liver), lambda t: t.rows), ';'), 'doctor'
  FROM counted WHERE n >= 2 AND (down >= 2 AND up = 0 AND worse >= 2 OR up >= 2 AND better >= 2 AND worse = 0))
"""


def points(spark, sf_dir):
    o = observations(spark, sf_dir)
    return S.last_of_day(o).select("patient_id", "analyte", "day", "value", "collected", "display", "unit", "low", "high", "valence", "headline")


def found(spark, sf_dir):
    o = observations(spark, sf_dir)
    meld = C.daily_scores(o).filter("meld3.complete").select("patient_id", "day", F.col("meld3.value").alias("score"))
    return W.findings(points(spark, sf_dir), o, meld)


def shown_rows():
    return F.array_join(F.transform("evidence", lambda e: F.concat(e["day"].cast("string"), F.lit(":"), general(e["value"]), F.when(e["analyte"].isNotNull(), F.concat(F.lit(":"), e["analyte"])).otherwise(""))), ";")


@query(WORD_SQL + "SELECT * FROM found")
def findings_in_words(spark, sf_dir):
    """Every finding of the ten rules with its sentence, detail, evidence and audience."""
    return found(spark, sf_dir).select("rule", "severity", "patient_id", "analyte", "headline", "detail", shown_rows().alias("evidence"), F.array_join("audience", ",").alias("audience"))


PLURAL_SQL = "CASE lower(verb) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in PLURAL.items()) + " ELSE verb END"
RANK = "list_position(['critical', 'high', 'moderate', 'info'], severity)"
GROUP_SQL = WORD_SQL + f""",
placed AS (
  SELECT found.*, coalesce(display, analyte, '') AS label, row_number() OVER (PARTITION BY patient_id ORDER BY {RANK}, rule, coalesce(analyte, ''), string_split(evidence, ':')[1]::INT, detail) AS place
  FROM found LEFT JOIN roles USING (analyte)),
cut AS (SELECT *, CASE WHEN label = '' THEN 0 ELSE strpos(lower(headline), lower(label)) END AS start FROM placed),
halves AS (SELECT *, CASE WHEN start > 0 THEN headline[:start - 1] ELSE headline END AS before, CASE WHEN start > 0 THEN headline[start + len(label):] END AS after FROM cut),
merged AS (
  SELECT patient_id, severity, before, after, count(*) AS n, min(place) AS first_place, arg_min(headline, place) AS headline, list(label ORDER BY label, place) AS labels,
         string_agg(label || '|' || detail, chr(10) ORDER BY label, place) AS items FROM halves GROUP BY ALL),
verbs AS (SELECT *, ltrim(after) AS rest, string_split(ltrim(after), ' ')[1] AS verb FROM merged),
titled AS (
  SELECT *, CASE WHEN n < 2 OR after IS NULL THEN headline
                 WHEN trim(before) = '' OR n > 4 THEN before || n || ' tests ' || {PLURAL_SQL} || rest[len(verb) + 1:]
                 ELSE before || array_to_string(labels[:-2], ', ') || ' and ' || labels[-1] || after END AS title FROM verbs)
"""


@query(GROUP_SQL + f"SELECT patient_id, severity, title, n, items, row_number() OVER (PARTITION BY patient_id ORDER BY {RANK}, n DESC, first_place)::INT AS place FROM titled")
def finding_groups(spark, sf_dir):
    """Findings that say the same of different analytes, as one sentence with its items."""
    f = W.grouped(found(spark, sf_dir), as_of(dictionary(spark)))
    items = F.array_join(F.transform("items", lambda i: F.concat_ws("|", i["label"], i["detail"])), "\n")
    return f.select("patient_id", "severity", "title", "n", items.alias("items"), "place")


@query(WORD_SQL + "SELECT audience, rule, severity, count(*) AS n FROM (SELECT unnest(string_split(audience, ',')) AS audience, rule, severity FROM found) GROUP BY ALL")
def findings_for(spark, sf_dir):
    """What each audience gets: findings by rule and severity."""
    f = found(spark, sf_dir).select(F.explode("audience").alias("audience"), "rule", "severity")
    return f.groupBy("audience", "rule", "severity").agg(F.count("*").alias("n"))
