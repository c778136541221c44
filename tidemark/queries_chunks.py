"""Queries over chunks of all kinds with their citations, and over whole questions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .fixed_values import EVERYDAY, EVERYDAY_TERMS, STOP_WORDS
from .plans import chunks as C
from .plans import daily, findings
from .plans import index as I
from .plans import retrieval as R
from .queries_findings import SCORE_SQL, WORD_SQL, bounds, found, g
from .sources.dictionary import as_of
from .sources.roles import dictionary, observations
from .sources.shared import new_path, written

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def measured(spark, sf_dir):
    """Observations with a kind; every twenty-fifth number is a result in words."""
    o = observations(spark, sf_dir)
    words = F.col("k") % 25 == 0
    return o.withColumns({"kind": F.when(words, "qualitative").otherwise("quantity"), "text": F.when(words, F.concat(F.lit("grade "), F.col("k"))), "value": F.when(~words, F.col("value"))})


def flat(chunks):
    """Chunks with their lists as texts."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return chunks.select("patient_id", "id", "kind", "text", text("analytes"), text("days"), text("dates"), text("pages"), "cites")


LISTS = """array_to_string(list_sort(list(DISTINCT day)), ',') AS days, array_to_string(list_sort(list(DISTINCT collected::DATE)), ',') AS dates, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages,
         array_to_string(list_transform(list_sort(list(DISTINCT {'p': page, 'd': collected::DATE})), lambda c: c.p || '@' || c.d), ' ') AS cites"""
VALUE_SQL = f""",
quantities AS (SELECT *, count(*) OVER (PARTITION BY patient_id, analyte, collected::DATE) > 1 AS several FROM obs WHERE k % 25 <> 0),
value_texts AS (
  SELECT patient_id, 'series:' || analyte AS id, 'series' AS kind,
         any_value(display) || ' (' || analyte || '), ' || any_value(system) || '. Values over time: ' || string_agg({g('value')} || ' (' || CASE WHEN several THEN strftime(collected, '%d %b %H:%M') ELSE strftime(collected, '%d %b') END || ')', ', ' ORDER BY collected, seq)
         || '. Units ' || CASE WHEN any_value(unit) <> '' THEN any_value(unit) ELSE 'none' END || '. ' || CASE WHEN any_value(low) IS NULL AND any_value(high) IS NULL THEN 'No range printed.' ELSE {bounds('any_value(low)', 'any_value(high)')} END
         || ' Flags: ' || coalesce(nullif(array_to_string(list_sort(list(DISTINCT interpretation) FILTER (interpretation IS NOT NULL)), ', '), ''), 'none') || '. ' || any_value(display) || ' of a patient.' AS text, analyte AS analytes, {LISTS}
  FROM quantities GROUP BY patient_id, analyte)
"""


@query(SCORE_SQL + VALUE_SQL + "SELECT * FROM value_texts")
def value_chunks(spark, sf_dir):
    """Every series in one text with its values."""
    return flat(C.value_chunks(measured(spark, sf_dir), as_of(dictionary(spark))))


def gap(name: str, missing: str, value: str | None) -> str:
    lack = f"'{name} not computed: missing ' || {missing}"
    return f"CASE WHEN {value} IS NOT NULL THEN '{name} = ' || {value} ELSE {lack} END" if value else lack


def lacking(names: list[str], always: str = "") -> str:
    return f"array_to_string(list_concat(list_filter([{', '.join(f'CASE WHEN {n} IS NULL THEN {n!r} END' for n in names)}], lambda x: x IS NOT NULL), {[a for a in always.split()]!r}::VARCHAR[]), ', ')"


@query(SCORE_SQL + f""",
said AS (
  SELECT patient_id, day, concat_ws('; ', {gap('aarc', lacking(['bilirubin_total', 'creatinine', 'inr', 'lactate'], 'encephalopathy_grade'), None)}, {gap('anion_gap', lacking(['abg_sodium', 'abg_chloride', 'abg_hco3']), 'anion_gap')},
         {gap('child_pugh', lacking(['bilirubin_total', 'albumin', 'inr'], 'ascites_grade encephalopathy_grade'), None)}, {gap('maddrey', lacking(['pt', 'pt_mnpt', 'bilirubin_total']), 'maddrey')},
         {gap('meld3', lacking(['bilirubin_total', 'inr', 'creatinine', 'sodium', 'albumin']), 'meld3')}, {gap('meld_na', lacking(['bilirubin_total', 'inr', 'creatinine', 'sodium']), 'meld_na')}, {gap('nlr', lacking(['anc', 'alc']), 'nlr')}) AS parts FROM scored),
cited AS (SELECT patient_id, day, {LISTS.replace("array_to_string(list_sort(list(DISTINCT day)), ',') AS days, ", "")} FROM obs GROUP BY ALL)
SELECT patient_id, 'score:' || day AS id, 'score' AS kind, 'Severity scores for day ' || day || ': ' || parts || '.' AS text, '' AS analytes, day::VARCHAR AS days, dates, pages, cites FROM said JOIN cited USING (patient_id, day)""")
def score_chunks(spark, sf_dir):
    """The scores of each day in words, cited by all that was measured on it."""
    o = observations(spark, sf_dir)
    d = daily.daily_scores(o)
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.struct(*[F.col(n)[f].alias(f) for f in ("value", "complete", "missing", "band")]).alias("score")) for n in daily.SCORES]))
    return flat(C.score_chunks(d.select("patient_id", "day", each), o))


PATTERN_SQL = f""",
numbered AS (
  SELECT found.*, row_number() OVER (PARTITION BY patient_id ORDER BY list_position(['critical', 'high', 'moderate', 'info'], severity), rule, coalesce(analyte, ''), string_split(evidence, ':')[1]::INT, detail) AS place,
         list_sort(list_distinct(list_transform(string_split(evidence, ';'), lambda e: string_split(e, ':')[1]::INT))) AS days FROM found),
spread AS (SELECT patient_id, place, analyte AS of_analyte, unnest(days) AS day FROM numbered),
pattern_cites AS (
  SELECT s.patient_id, s.place, {LISTS.replace("array_to_string(list_sort(list(DISTINCT day)), ',') AS days, ", "")} FROM spread s JOIN obs o ON o.patient_id = s.patient_id AND o.day = s.day AND coalesce(of_analyte = o.analyte, true) GROUP BY ALL),
pattern_texts AS (
  SELECT n.patient_id, 'pattern:' || rule || ':' || n.place AS id, 'pattern' AS kind, trim('Detected pattern (' || severity || '): ' || headline || ' ' || detail || ' Analyte: ' || coalesce(n.analyte, 'none') || '. ' || coalesce(display || ' of a patient.', '')) AS text,
         coalesce(n.analyte, '') AS analytes, array_to_string(days, ',') AS days, coalesce(dates, '') AS dates, coalesce(pages, '') AS pages, coalesce(cites, '') AS cites
  FROM numbered n LEFT JOIN pattern_cites USING (patient_id, place) LEFT JOIN roles ON roles.analyte = n.analyte)
"""


def patterns(spark, sf_dir):
    return C.finding_chunks(findings.ordered(found(spark, sf_dir)), observations(spark, sf_dir), as_of(dictionary(spark)))


@query(WORD_SQL + PATTERN_SQL + "SELECT * FROM pattern_texts")
def pattern_chunks(spark, sf_dir):
    """Every finding as a text, cited by what was measured of its analyte on its evidence days."""
    return flat(patterns(spark, sf_dir))


@query(SCORE_SQL + """
SELECT patient_id, 'qual:' || analyte || ':' || seq AS id, 'qualitative' AS kind, display || ' result: grade ' || k || '. Collected ' || strftime(collected, '%Y-%m-%d %H:%M') || ' (day ' || day || ').' AS text, analyte AS analytes,
       day::VARCHAR AS days, (collected::DATE)::VARCHAR AS dates, page::VARCHAR AS pages, page || '@' || collected::DATE AS cites FROM obs WHERE k % 25 = 0""")
def qualitative_chunks(spark, sf_dir):
    """Results in words."""
    return flat(C.qualitative_chunks(measured(spark, sf_dir)))


#: Whole questions; their words are everyday ones, the dictionary's, or in the texts themselves.
QUESTIONS = [
    (1, "Is the jaundice getting worse?"),
    (2, "How are the kidneys on day 12?"),
    (3, "Any sign of infection or fever since 5 January?"),
    (4, "Is there a bleeding risk?"),
    (5, "What about the oxygen pressure?"),
    (6, "Why is the patient so confused?"),
    (7, "Did the total bilirubin rise in one day?"),
    (8, "Anything on 2024-01-20?"),
]
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: len(t) > 1 AND NOT list_contains({STOP_SQL}, t))"


def pairs(words: dict[str, str]) -> str:
    return ", ".join(f"('{w}', '{t}')" for w, terms in words.items() for t in terms.split())


ASK_SQL = WORD_SQL + VALUE_SQL + PATTERN_SQL + f""",
texts AS (SELECT patient_id || '/' || id AS id, kind, text, days, dates FROM value_texts UNION ALL SELECT patient_id || '/' || id, kind, text, days, dates FROM pattern_texts),
questions AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}')" for i, t in QUESTIONS)}) q(qid, text)),
asked AS (SELECT DISTINCT qid, unnest({tokens('text')}) AS word FROM questions),
concept AS (SELECT DISTINCT unnest({tokens("replace(analyte, '_', ' ') || ' ' || display || ' ' || replace(analyte, '_', ' ') || ' ' || display || ' of a patient.'")}) AS word, analyte FROM roles),
known AS (
  SELECT word, analyte FROM concept WHERE word IN (SELECT word FROM concept GROUP BY word HAVING count(*) <= 8)
  UNION ALL SELECT * FROM (VALUES {pairs(EVERYDAY)}) e(word, analyte)),
meant AS (SELECT DISTINCT qid, analyte FROM asked JOIN known USING (word)),
terms AS (
  SELECT qid, term, max(weight) AS weight FROM (
    SELECT qid, word AS term, 1.0::DOUBLE AS weight FROM asked
    UNION ALL SELECT qid, unnest({tokens("replace(analyte, '_', ' ') || ' ' || coalesce(display, '')")}), 0.6 FROM meant LEFT JOIN roles USING (analyte)
    UNION ALL SELECT qid, t.term, 0.6 FROM asked JOIN (VALUES {pairs(EVERYDAY_TERMS)}) t(word, term) USING (word)) GROUP BY ALL),
tokened AS (SELECT id, {tokens('text')} AS t FROM texts),
postings AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tokened) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
sizes AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tokened),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
hits AS (SELECT qid, id, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))::DECIMAL(18,4)::DOUBLE AS score FROM postings JOIN terms USING (term) JOIN df USING (term), sizes GROUP BY ALL),
dated AS (
  SELECT DISTINCT 2 AS qid, id, kind FROM texts WHERE list_contains(string_split(days, ','), '12')
  UNION ALL SELECT DISTINCT 3, id, kind FROM texts WHERE regexp_matches(dates, '-01-05')
  UNION ALL SELECT DISTINCT 8, id, kind FROM texts WHERE regexp_matches(dates, '-01-20')),
raised AS (
  SELECT qid, id, CASE WHEN kind IS NULL THEN score ELSE coalesce(score, 0) * 2 + 2 END AS score FROM hits FULL JOIN dated USING (qid, id))
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS place FROM raised QUALIFY place <= 8
"""


@query(ASK_SQL)
def questions_asked(spark, sf_dir):
    """The best texts of all patients for whole questions, by an index: words, what they stand for, and the days they name."""
    entries = as_of(dictionary(spark))
    c = C.value_chunks(measured(spark, sf_dir), entries).unionByName(patterns(spark, sf_dir))
    c = written(c.select(F.concat_ws("/", F.col("patient_id").cast("string"), "id").alias("id"), "kind", "text", "days", "dates"), "chunks")
    index = I.write(c.select("id", "text"), new_path(spark, "chunk-index"))
    by_number = c.select("id", "kind", F.explode("days").alias("day"), F.lit(None).cast("date").alias("date"))
    by_date = c.select("id", "kind", F.lit(None).cast("int").alias("day"), F.explode("dates").alias("date"))
    return R.ask(spark.createDataFrame(QUESTIONS, "qid int, text string"), lambda q: I.scores(index, q), entries, by_number.unionByName(by_date))


@query(ASK_SQL[: ASK_SQL.index("tokened AS (")].rstrip().rstrip(",") + " SELECT qid, term, weight FROM terms")
def query_expansion(spark, sf_dir):
    """The weighted terms of the questions, over the analytes that were measured."""
    entries = as_of(dictionary(spark))
    seen = observations(spark, sf_dir).select("analyte").distinct()
    q = spark.createDataFrame(QUESTIONS, "qid int, text string").select("qid", F.explode(R.tokens(F.col("text"))).alias("term"))
    return R.expand(q, entries.join(seen, "analyte", "left_semi"))
