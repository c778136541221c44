"""Queries over texts, pages, layout and parsing, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixed_values as V
from .functions import exprs as X
from .plans import checks as K
from .plans import layout as L
from .plans import retrieval as R
from .sources.roles import ROLE_SQL
from .sources.roles import observations as measured_roles
from .sources.tables import OBS_SQL, observations, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- parsing of printed texts, made from line items ---------------------------------------

RANGES_SQL = """
WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_quantity::INT || ' - ' || (l_quantity::INT + l_linenumber) WHEN 1 THEN '< ' || l_quantity::INT
           WHEN 2 THEN '>' || l_quantity::INT || '.5' ELSE CASE WHEN l_quantity > 25 THEN (l_quantity::INT + 9) || ' - ' || l_quantity::INT ELSE '' END END AS text FROM lineitem),
p AS (SELECT *, TRY_CAST(regexp_extract(text, '([0-9]+(?:\\.[0-9]+)?)\\s*[-–]\\s*([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS a, TRY_CAST(regexp_extract(text, '([0-9]+(?:\\.[0-9]+)?)\\s*[-–]\\s*([0-9]+(?:\\.[0-9]+)?)', 2) AS DOUBLE) AS b,
             TRY_CAST(regexp_extract(text, '<\\s*=?\\s*([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS lt, TRY_CAST(regexp_extract(text, '>\\s*=?\\s*([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS gt FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN a <= b THEN a WHEN lt IS NULL THEN gt END AS low, CASE WHEN a <= b THEN b ELSE lt END AS high FROM p
"""


@query(RANGES_SQL)
def parse_reference(spark, sf_dir):
    q = F.col("l_quantity").cast("int")
    n = F.col("l_linenumber")
    text = F.when(n % 4 == 0, F.concat(q, F.lit(" - "), q + n)).when(n % 4 == 1, F.concat(F.lit("< "), q)).when(n % 4 == 2, F.concat(F.lit(">"), q, F.lit(".5"))).otherwise(F.when(q > 25, F.concat(q + 9, F.lit(" - "), q)).otherwise(""))
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"))
    return t.select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in X.parse_reference(F.col("text")).items()])


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 4 THEN NULL ELSE (CASE WHEN l_linenumber % 5 = 2 THEN -1 ELSE 1 END) * l_quantity::INT::DOUBLE END AS number,
CASE l_linenumber % 5 WHEN 0 THEN 'H' WHEN 1 THEN 'CL' END AS flag, CASE WHEN l_linenumber % 5 = 3 THEN '<' END AS comparator FROM lineitem""")
def parse_value(spark, sf_dir):
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 5
    text = F.when(n == 0, F.concat(q, F.lit(" H"))).when(n == 1, F.concat(q, F.lit(",0 (CL)"))).when(n == 2, F.concat(F.lit("- "), q)).when(n == 3, F.concat(F.lit("<"), q)).otherwise("not done")
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"))
    return t.select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in X.parse_value(F.col("text")).items()])


@query("""SELECT p_partkey, upper(regexp_replace(p_name || ' ' || p_brand, '[^\\p{L}\\p{N}]', '', 'g')) AS norm, trim(p_type) AS label FROM part""")
def normalised_labels(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", X.normalised(F.concat_ws(" ", "p_name", "p_brand")).alias("norm"), X.clean_label(F.concat(F.trim("p_type"), F.lit(", Serum;"))).alias("label"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE date_trunc('minute', o_orderdate) END AS at FROM orders""")
def parse_printed_time(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, "no date").otherwise(F.date_format("o_orderdate", "'Collected: 'dd/MM/yyyy HH:mm"))
    return o.select("o_orderkey", X.parse_printed_time(text).alias("at"))


@query("""WITH s AS (SELECT s_suppkey, 'LAB' || lpad((s_suppkey)::VARCHAR, 7, '0') AS id FROM supplier)
SELECT s_suppkey, id AS stem, CASE WHEN s_suppkey % 2 = 0 THEN id ELSE id END AS repaired FROM s""")
def sample_ids(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    idc = F.concat(F.lit("LAB"), F.lpad(F.col("s_suppkey").cast("string"), 7, "0"))
    return s.select("s_suppkey", X.id_stem(F.concat(idc, F.lit("-2"))).alias("stem"), X.repair_id(F.concat(F.substring(idc, 1, 3), F.translate(F.substring(idc, 4, 7), "01", "OI"))).alias("repaired"))


@query("""SELECT c_custkey, len(list_distinct(d)) <= 2 OR len(list_filter(s, lambda x: x <> 1)) = 0 OR len(list_filter(s, lambda x: x <> -1)) = 0 AS degenerate
FROM (SELECT *, list_transform(range(2, len(d) + 1), lambda i: d[i]::INT - d[i - 1]::INT) AS s FROM (SELECT c_custkey, string_split(CASE WHEN c_custkey % 3 = 0 THEN '123456789' ELSE (c_custkey * 7919)::VARCHAR END, '') AS d FROM customer))""")
def degenerate_digits(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 3 == 0, "123456789").otherwise((F.col("c_custkey") * 7919).cast("string"))
    return c.select("c_custkey", X.degenerate_digits(text).alias("degenerate"))


@query("""SELECT p_partkey, greatest(0, trunc(p_size * 10 - 0.3 * 1000)::INT) AS "left", greatest(0, trunc(p_size * 5 - 0.6 * 20)::INT) AS top,
least(1000, trunc(p_size * 10 + 50 + 0.45 * 1000)::INT) - greatest(0, trunc(p_size * 10 - 0.3 * 1000)::INT) AS width, least(1400, trunc(p_size * 5 + 20 + 0.6 * 20)::INT) - greatest(0, trunc(p_size * 5 - 0.6 * 20)::INT) AS height FROM part""")
def crop_boxes(spark, sf_dir):
    box = X.crop_box(F.col("p_size") * 10, F.col("p_size") * 5, F.lit(50), F.lit(20), F.lit(1000), F.lit(1400))
    return read(spark, sf_dir, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.*")


# --- retrieval ------------------------------------------------------------------------------

STOPS = ", ".join(f"'{w}'" for w in V.STOP_WORDS)
TERMS_SQL = f"""
WITH t AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda x: length(x) > 1 AND x NOT IN ({STOPS})) AS t FROM documents),
posts AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM t) GROUP BY id, term),
sizes AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t)
"""
ASKED = [(1, "thead"), (1, "ation"), (2, "tion"), (2, "ing"), (3, "der"), (3, "les")]
ASKED_SQL = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({q}, '{t}')" for q, t in ASKED) + ") a(qid, term))"


def chunks(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


@query(TERMS_SQL + "SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM posts GROUP BY term")
def term_stats(spark, sf_dir):
    return R.term_stats(R.postings(chunks(spark, sf_dir)))


@query(TERMS_SQL + f""", {ASKED_SQL},
hits AS (SELECT qid, posts.* FROM posts JOIN asked USING (term)),
df AS (SELECT term, count(DISTINCT id) AS df FROM hits GROUP BY term),
total AS (SELECT qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))::DECIMAL(18,4)::DOUBLE AS score FROM hits JOIN df USING (term), sizes GROUP BY qid, id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS place FROM total) WHERE place <= 8""")
def bm25_topk(spark, sf_dir):
    q = spark.createDataFrame(ASKED, "qid int, term string").withColumn("weight", F.lit(1.0))
    return R.bm25(chunks(spark, sf_dir), q)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 2 THEN least(month(o_orderdate) * 100 + day(o_orderdate), day(o_orderdate) * 100 + month(o_orderdate))
ELSE month(o_orderdate) * 100 + day(o_orderdate) END AS asked FROM orders""")
def date_mentions(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "'what about the 'd' 'MMMM'?'")).when(k == 1, F.date_format(d, "'compare 'MMM' 'd")).when(k == 2, F.date_format(d, "'on 'yyyy-MM-dd")).otherwise(F.date_format(d, "'seen 'dd/MM"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.get(R.mentioned_dates(text), F.lit(0)).cast("long").alias("asked"))


@query("""SELECT conv_id, string_agg(page || '@' || role, ' ' ORDER BY page, role) AS cites FROM (SELECT DISTINCT conv_id, turn // 2 AS page, role FROM conversations) GROUP BY conv_id""")
def citations(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("page"), F.col("role").alias("date"))
    return R.citations(c, "conv_id")


@query("""WITH c AS (SELECT conv_id % 5 AS qid, conv_id AS id, turn FROM conversations),
h AS (SELECT qid, id, count(*)::DOUBLE AS score FROM c WHERE turn = 1 AND id % 3 <> 0 GROUP BY ALL),
d AS (SELECT DISTINCT qid, id FROM c WHERE turn = 2 AND qid < 4)
SELECT qid, id, coalesce(score, 0) AS score FROM h ANTI JOIN d USING (qid, id)
UNION ALL SELECT qid, id, coalesce(score, 0) * 2 + CASE WHEN id % 2 = 0 THEN 3 ELSE 2 END FROM d LEFT JOIN h USING (qid, id)""")
def date_hits(spark, sf_dir):
    """The questions are 0 to 4, each over its own conversations; first turns hit by keyword, second turns by date, none for question 4."""
    c = read(spark, sf_dir, "conversations").select((F.col("conv_id") % 5).alias("qid"), F.col("conv_id").alias("id"), "turn")
    hits = c.filter("turn = 1 and id % 3 <> 0").groupBy("qid", "id").agg(F.count("*").cast("double").alias("score"))
    days = c.select("qid", "id", F.col("turn").alias("day"), F.when(F.col("id") % 2 == 0, "day").otherwise("series").alias("kind"))
    asked = days.select("qid").distinct().filter("qid < 4").withColumn("day", F.lit(2))
    own = R.date_hits(hits, days.drop("qid"), asked)
    return own.filter(F.col("id") % 5 == F.col("qid")).select("qid", "id", "score")


@query(OBS_SQL + """SELECT patient_id, analyte, analyte || ': ' || string_agg('day ' || day || ' #' || seq, '; ' ORDER BY day, seq) AS text FROM obs GROUP BY patient_id, analyte""")
def series_chunks(spark, sf_dir):
    o = observations(spark, sf_dir)
    items = F.transform(F.array_sort(F.collect_list(F.struct("day", "seq"))), lambda s: F.format_string("day %d #%d", s["day"], s["seq"]))
    return o.groupBy("patient_id", "analyte").agg(F.array_join(items, "; ").alias("t")).select("patient_id", "analyte", F.concat_ws(": ", "analyte", "t").alias("text"))


@query(OBS_SQL + """SELECT patient_id, day, 'day ' || day || ': ' || array_to_string(list_sort(list(DISTINCT analyte)), ', ') AS text, count(*) AS n FROM obs GROUP BY patient_id, day""")
def day_chunks(spark, sf_dir):
    o = observations(spark, sf_dir)
    g = o.groupBy("patient_id", "day").agg(F.array_join(F.array_sort(F.collect_set("analyte")), ", ").alias("t"), F.count("*").alias("n"))
    return g.select("patient_id", "day", F.concat(F.lit("day "), F.col("day"), F.lit(": "), F.col("t")).alias("text"), "n")


@query("""SELECT conv_id, arg_max(role, turn) AS last_role, count(*) AS turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id""")
def last_turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.count("*").alias("turns"), F.max("turn").alias("last_turn"))


# --- scans ------------------------------------------------------------------------------------

LEAK_SQL = f"""
WITH hits AS (
  SELECT doc_id, text, 'labelled-id' AS rule, regexp_extract_all(text, '{V.LABELLED_ID}', 1) AS found FROM documents
  UNION ALL SELECT doc_id, text, 'phone', list_filter(list_transform(list_filter(regexp_extract_all(text, '[0-9]+'), lambda d: len(d) BETWEEN 10 AND 13), lambda d: right(d, 10)), lambda x: NOT (len(list_distinct(string_split(x, ''))) <= 2 OR x IN ('0123456789', '9876543210'))) FROM documents
  UNION ALL SELECT doc_id, text, 'e-mail', list_filter(regexp_extract_all(text, '{V.E_MAIL}', 1), lambda x: NOT contains(x, '@example.')) FROM documents
  UNION ALL SELECT doc_id, text, 'birth-date', regexp_extract_all(text, '{V.BIRTH_DATE}', 1) FROM documents)
SELECT doc_id, rule, len(found)::BIGINT AS n, (length(p) - length(replace(p, chr(10), '')) + 1)::BIGINT AS first_line
FROM (SELECT *, substr(text, 1, strpos(text, found[1])) AS p FROM hits WHERE len(found) > 0)
"""


@query(LEAK_SQL)
def leak_scan(spark, sf_dir):
    return K.leaks(read(spark, sf_dir, "documents"), "doc_id")


@query("""SELECT page_id, len(list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda u: regexp_matches(u, '^https?://')))::BIGINT AS n_external, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::BIGINT AS n_links,
regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages""")
def url_extract(spark, sf_dir):
    links = K.attribute(F.col("html"), "href")
    return read(spark, sf_dir, "pages").select("page_id", F.size(K.external(links)).cast("long").alias("n_external"), F.size(links).cast("long").alias("n_links"), F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"))


@query("""SELECT page_id, length(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'))::BIGINT AS n, html LIKE '%<script%' AS had_script FROM pages""")
def html_strip(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.length(K.strip_scripts(F.col("html"))).cast("long").alias("n"), F.contains("html", F.lit("<script")).alias("had_script"))


@query("""SELECT page_id, unnest(list_filter(['nav', 'article', 'footer', 'table', 'form'], lambda x: NOT list_contains(list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda t: lower(t)), x))) AS missing FROM pages""")
def required_minus_found(spark, sf_dir):
    return K.missing_parts(read(spark, sf_dir, "pages"), "page_id", "html", ["nav", "article", "footer", "table", "form"])


@query("""SELECT item_id, replace(replace(replace(replace(text || '<b>&"x"</b>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS safe FROM benchmark""")
def html_escape(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", X.html_escape(F.concat("text", F.lit('<b>&"x"</b>'))).alias("safe"))


@query("""SELECT page_id, url LIKE 'http://%' OR lower(url) LIKE '%.pdf' AS banned FROM pages""")
def banned_paths(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", K.banned_paths(F.col("url"), [".pdf"], ["http://"]).alias("banned"))


@query("""SELECT c_custkey, name, said FROM (SELECT c_custkey, 'F' AS name, round(c_custkey / 10.0, 1)::DOUBLE AS said FROM customer) JOIN (SELECT 'F' AS name, 50.0 AS value) v USING (name) WHERE abs(said - value) > 0.05""")
def doc_claims(spark, sf_dir):
    texts = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("the level F was "), F.format_string("%.1f", F.col("c_custkey") / 10.0), F.lit(" then")).alias("text"))
    facts = spark.createDataFrame([("F", 50.0)], "name string, value double")
    return K.claims(texts, facts, "c_custkey", [("F", r"level F was ([0-9]+\.[0-9]+)")]).select("c_custkey", "name", "said")


# --- layout: pages of words made from events ---------------------------------------------

def page_words(spark, sf_dir):
    """Each user a page, each event a printed line of a test, a result and a unit."""
    e = read(spark, sf_dir, "events")
    top = F.col("event_id") * 40 + F.col("user_id") % 3
    cell = lambda i, text, left: F.struct((F.col("event_id") * 10 + i).alias("word_no"), text.cast("string").alias("text"), F.lit(left).alias("left"), (top + i).alias("top"), F.lit(60).alias("width"), F.lit(20).alias("height"))
    cells = F.array(cell(0, F.concat(F.lit("test"), F.col("event_id")), 100), cell(1, F.floor("value"), 400), cell(2, F.col("event_type"), 620))
    return e.select(F.col("user_id").alias("page"), F.inline(cells))


@query("""SELECT user_id AS page, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS line, 'test' || event_id AS test, floor(value)::BIGINT::VARCHAR AS result, event_type AS unit FROM events""")
def printed_rows(spark, sf_dir):
    return L.to_rows(L.group_lines(page_words(spark, sf_dir)), 1000).select("page", "line", "test", "result", "unit")


def printed(spark, sf_dir):
    """Events as printed lines; some are headings, remarks or the rest of a name."""
    e = read(spark, sf_dir, "events")
    k = (F.col("user_id") + F.col("event_id")) % 9
    test = F.when(k == 1, "Test Name").when(k == 2, "Note: see the remarks").when(k == 3, "Method: by hand").when(k == 5, "").otherwise(F.concat(F.lit("test"), F.col("event_type")))
    result = F.when(k.isin(1, 2, 3, 4, 5), "").otherwise(F.floor("value").cast("string"))
    unit = F.when(k == 5, "mg").when(k.isin(1, 2, 3, 4), "").otherwise("g")
    return e.select(F.col("user_id").alias("page"), F.col("event_id").alias("line"), k.alias("k"), test.alias("test"), result.alias("result"), unit.alias("unit"), F.lit("").alias("range"))


PRINTED_SQL = """
WITH printed AS (
  SELECT user_id AS page, event_id AS line, (user_id + event_id) % 9 AS k, 'test' || event_type AS part, floor(value)::BIGINT::VARCHAR AS q FROM events),
rows AS (
  SELECT page, line, k, CASE k WHEN 1 THEN 'Test Name' WHEN 2 THEN 'Note: see the remarks' WHEN 3 THEN 'Method: by hand' WHEN 5 THEN '' ELSE part END AS test,
         CASE WHEN k IN (1, 2, 3, 4, 5) THEN '' ELSE q END AS result, CASE WHEN k = 5 THEN 'mg' WHEN k IN (1, 2, 3, 4) THEN '' ELSE 'g' END AS unit FROM printed)
"""


@query(PRINTED_SQL + """,
a AS (SELECT *, max(line) FILTER (k = 1) OVER (PARTITION BY page) AS anchor FROM rows),
b AS (SELECT *, last_value(CASE WHEN k = 2 THEN 1 WHEN k = 3 THEN 0 WHEN result <> '' THEN 0 END IGNORE NULLS) OVER (PARTITION BY page ORDER BY line ROWS UNBOUNDED PRECEDING) AS skip FROM a WHERE anchor IS NULL OR line > anchor)
SELECT page, line, test FROM b WHERE k NOT IN (2, 3) AND coalesce(skip, 0) = 0""")
def content_rows(spark, sf_dir):
    prose, method = F.col("test").rlike("^(Note|Method):"), F.startswith("test", F.lit("Method"))
    return L.content_rows(printed(spark, sf_dir), F.col("test") == "Test Name", prose, method, F.col("result") != "").select("page", "line", "test")


@query(PRINTED_SQL + """,
s AS (SELECT *, CASE WHEN ((test <> '' AND result = '' AND unit = '') OR (test = '' AND result = '' AND unit <> '')) AND row_number() OVER (PARTITION BY page ORDER BY line) > 1 THEN 0 ELSE 1 END AS starts FROM rows),
e AS (SELECT *, sum(starts) OVER (PARTITION BY page ORDER BY line) AS entry FROM s)
SELECT page, entry::BIGINT AS entry, min(line) AS line, coalesce(string_agg(nullif(test, ''), ' ' ORDER BY line), '') AS test, coalesce(string_agg(nullif(result, ''), ' ' ORDER BY line), '') AS result, coalesce(string_agg(nullif(unit, ''), ' ' ORDER BY line), '') AS unit
FROM e GROUP BY page, entry""")
def merge_wrapped(spark, sf_dir):
    return L.merge_wrapped(printed(spark, sf_dir)).select("page", "entry", "line", "test", "result", "unit")


LUM_SQL = """
WITH lum AS (SELECT c_custkey AS page, y, CASE WHEN (y + c_custkey) % 97 < 12 THEN 120 + (y % 3) WHEN (y + c_custkey) % 97 BETWEEN 40 AND 43 THEN 100 ELSE 250 END AS lum
             FROM customer, (SELECT unnest(range(0, 400)) AS y)),
d AS (SELECT *, y - row_number() OVER (PARTITION BY page ORDER BY y) AS island FROM lum WHERE lum < 195 AND y >= 40),
runs AS (SELECT page, min(y) AS top, max(y) AS bottom, max(y) - min(y) + 1 AS tall FROM d GROUP BY page, island HAVING tall BETWEEN 4.8 AND 14 AND avg(lum) <= 160),
l AS (SELECT *, coalesce(lead(top) OVER w - bottom <= greatest(30, 3 * tall), false) AS link FROM runs WINDOW w AS (PARTITION BY page ORDER BY top)),
b AS (SELECT *, CASE WHEN coalesce(lag(link) OVER (PARTITION BY page ORDER BY top), false) THEN 0 ELSE 1 END AS begins FROM l),
c AS (SELECT *, sum(begins) OVER (PARTITION BY page ORDER BY top) AS chain FROM b),
p AS (SELECT *, row_number() OVER (PARTITION BY page, chain ORDER BY top) - 1 AS place FROM c)
"""


def luminance(spark, sf_dir):
    """Each customer a page of 400 rows of pixels."""
    y = F.col("y")
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(399))).alias("y"))
    k = (y + F.col("page")) % 97
    return rows.select("page", "y", F.when(k < 12, 120 + y % 3).when(k.between(40, 43), 100).otherwise(250).alias("lum"), F.lit(400).alias("height"))


@query(LUM_SQL + "SELECT page, top::INT AS top, bottom::INT AS bottom, tall::INT AS tall FROM runs")
def dark_runs(spark, sf_dir):
    return L.dark_runs(luminance(spark, sf_dir))


@query(LUM_SQL + "SELECT page, top::INT AS top, bottom::INT AS bottom, CASE WHEN place % 2 = 1 THEN 'sample' WHEN link THEN 'header' ELSE 'unknown' END AS kind FROM p")
def band_pairs(spark, sf_dir):
    return L.pair_bands(L.dark_runs(luminance(spark, sf_dir)))


def samples(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("seq"), F.to_date("o_orderdate").alias("date"))


@query("""
WITH s AS (SELECT o_custkey AS patient_id, o_orderkey AS seq, o_orderdate::DATE AS date FROM orders),
m AS (SELECT patient_id, date_trunc('month', date) AS month, count(*) AS n, min(seq) AS s FROM s GROUP BY ALL),
t AS (SELECT patient_id, arg_max(month, (n, -s)) AS month FROM m GROUP BY patient_id),
d AS (SELECT DISTINCT s.patient_id, date FROM s JOIN t ON s.patient_id = t.patient_id AND date_trunc('month', date) = month),
c AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY patient_id) AS many, CASE WHEN date_diff('day', lag(date) OVER w, date) > 2 THEN 1 ELSE 0 END AS cut FROM d WINDOW w AS (PARTITION BY patient_id ORDER BY date)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY patient_id ORDER BY date) AS island FROM c)
SELECT i.patient_id, min(date) AS first_date, max(date) AS last_date FROM i JOIN (SELECT patient_id, island FROM i WHERE place = many // 2) mid USING (patient_id, island) GROUP BY i.patient_id""")
def contiguous_window(spark, sf_dir):
    return L.date_window(samples(spark, sf_dir))


@query("""
WITH s AS (SELECT o_orderkey AS seq, 'LAB' || lpad((o_custkey)::VARCHAR, 7, '0') || '-' || o_orderkey AS sample_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS collected, o_custkey FROM orders),
t AS (SELECT o_custkey, arg_min(collected, seq) AS found FROM s WHERE collected IS NOT NULL GROUP BY o_custkey)
SELECT seq, sample_id, coalesce(collected, found) AS collected, collected IS NULL AND found IS NOT NULL AS repaired FROM s LEFT JOIN t USING (o_custkey)""")
def aliquot_repair(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    stem = F.concat(F.lit("LAB"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"))
    return L.repair_aliquots(o.select(F.col("o_orderkey").alias("seq"), F.concat_ws("-", stem, F.col("o_orderkey")).alias("sample_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("collected")))


@query("""SELECT o_orderkey AS page, CASE WHEN o_orderkey % 5 = 0 THEN 'fixed' ELSE o_orderstatus END AS sample_id, o_orderpriority AS reported, o_orderkey % 5 = 0 AS verified FROM orders""")
def band_overrides(spark, sf_dir):
    bands = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderstatus").alias("sample_id"), F.col("o_orderpriority").alias("reported"))
    hand = bands.filter("page % 5 = 0").select("page", F.lit("fixed").alias("sample_id"), F.lit(None).cast("string").alias("reported"))
    return L.override(bands, hand, ["sample_id", "reported"])


ALIASES = [("PROMO", "promo"), ("STANDARD", "standard"), ("SMALL", "small"), ("MEDIUM", "medium"), ("LARGE", "large"), ("ECONOMY", "economy")]


@query("""WITH l AS (SELECT DISTINCT p_type AS label FROM part)
SELECT label, CASE WHEN list_contains(['PROMO','STANDARD','SMALL','MEDIUM','LARGE','ECONOMY'], upper(regexp_replace(string_split(label, ' ')[1], '[^A-Za-z0-9]', '', 'g'))) THEN lower(string_split(label, ' ')[1]) END AS key,
CASE WHEN list_contains(['PROMO','STANDARD','SMALL','MEDIUM','LARGE','ECONOMY'], upper(regexp_replace(label, '[^A-Za-z0-9]', '', 'g'))) THEN 'exact' WHEN list_contains(['PROMO','STANDARD','SMALL','MEDIUM','LARGE','ECONOMY'], upper(string_split(label, ' ')[1])) THEN 'prefix' ELSE 'none' END AS match FROM l""")
def label_match(spark, sf_dir):
    labels = read(spark, sf_dir, "part").select(F.col("p_type").alias("label"))
    return L.match_labels(labels, spark.createDataFrame(ALIASES, "alias_norm string, key string"), fuzzy=False)


@query(ROLE_SQL + """,
counts AS (SELECT patient_id, analyte, min(seq) AS first, count(*) AS n FROM obs GROUP BY ALL),
lined AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY first) AS nth FROM counts),
walked AS (
  SELECT patient_id, analyte, nth, n, 0 AS sheet, n AS held FROM lined WHERE nth = 1
  UNION ALL SELECT l.patient_id, l.analyte, l.nth, l.n, CASE WHEN held >= 22 THEN sheet + 1 ELSE sheet END, CASE WHEN held >= 22 THEN l.n ELSE held + l.n END
  FROM walked w JOIN lined l ON l.patient_id = w.patient_id AND l.nth = w.nth + 1)
SELECT patient_id, sheet::BIGINT AS sheet, sum(n)::BIGINT AS n, count(*) AS analytes, min(seq) AS first_seq FROM walked JOIN (SELECT patient_id, analyte, min(seq) AS seq FROM obs GROUP BY ALL) USING (patient_id, analyte) GROUP BY ALL""")
def contact_sheets(spark, sf_dir):
    """Sheets of each patient: items, analytes, and the first item of each."""
    items = measured_roles(spark, sf_dir).select("patient_id", "seq", "analyte")
    return L.batches(items, by=("patient_id",)).groupBy("patient_id", "sheet").agg(F.count("*").alias("n"), F.count_distinct("analyte").alias("analytes"), F.min("seq").alias("first_seq"))


@query(f"""
WITH bands AS (
  SELECT o_orderkey, 'Sample .No: LAB' || lpad(o_custkey::VARCHAR, 7, '0') || 'A ' AS s, 'Colection Date ' || strftime(o_orderdate, '%d/%m/%Y %H:%M') || ' ~ ' AS c, 'ACKD  Date: ' || strftime(o_orderdate, '%d-%m-%Y 09:30') || ' ' AS a, 'Report Date ' || o_orderpriority AS r FROM orders),
texts AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN s || c || a || r WHEN 1 THEN c || s || r WHEN 2 THEN 'x ' || r || ' ' || a || s ELSE 'no labels ' || o_orderkey END AS t FROM bands),
places AS (
  SELECT o_orderkey, t, k, strpos(t, m) AS start, len(m) AS size FROM (
    SELECT o_orderkey, t, unnest({list(V.BAND_LABELS)!r}) AS k, unnest([{", ".join("regexp_extract(t, '" + p + "')" for p in V.BAND_LABELS.values())}]) AS m FROM texts) WHERE m <> ''),
cuts AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY o_orderkey ORDER BY start), len(t) + 1) AS stop FROM places)
SELECT o_orderkey, nullif(regexp_extract(any_value(t), '{V.SAMPLE_NO}', 1), '') AS sample_no, {", ".join(f"max(substr(t, start + size, stop - start - size)) FILTER (k = '{k}') AS {k}_text" for k in V.BAND_LABELS)}
FROM texts LEFT JOIN (SELECT o_orderkey, k, start, size, stop FROM cuts) USING (o_orderkey) GROUP BY o_orderkey""")
def band_fields(spark, sf_dir):
    """Headings cut at their labels, in whatever order and with whichever missing, and the sample's number."""
    o = read(spark, sf_dir, "orders")
    s, at = F.concat(F.lit("Sample .No: LAB"), F.lpad(F.col("o_custkey").cast("string"), 7, "0"), F.lit("A ")), F.col("o_orderdate")
    c, a, r = F.concat(F.lit("Colection Date "), F.date_format(at, "dd/MM/yyyy HH:mm"), F.lit(" ~ ")), F.concat(F.lit("ACKD  Date: "), F.date_format(at, "dd-MM-yyyy"), F.lit(" 09:30 ")), F.concat(F.lit("Report Date "), "o_orderpriority")
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(s, c, a, r)).when(k == 1, F.concat(c, s, r)).when(k == 2, F.concat(F.lit("x "), r, F.lit(" "), a, s)).otherwise(F.concat(F.lit("no labels "), F.col("o_orderkey").cast("string")))
    b = o.select("o_orderkey", text.alias("t")).withColumn("m", L.band_segments(F.col("t")))
    return b.select("o_orderkey", L.sample_no(F.col("t")).alias("sample_no"), *[F.try_element_at("m", F.lit(x)).alias(f"{x}_text") for x in V.BAND_LABELS])


@query("""
WITH s AS (SELECT o_custkey AS patient_id, o_orderkey AS seq, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE END AS date, o_orderkey % 10 = 0 AS human_verified FROM orders),
m AS (SELECT patient_id, date_trunc('month', date) AS month, count(*) AS n, min(seq) AS s FROM s WHERE date IS NOT NULL GROUP BY ALL),
t AS (SELECT patient_id, arg_max(month, (n, -s)) AS month FROM m GROUP BY patient_id),
d AS (SELECT DISTINCT s.patient_id, date FROM s JOIN t ON s.patient_id = t.patient_id AND date_trunc('month', date) = month),
c AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY patient_id) AS many, CASE WHEN date_diff('day', lag(date) OVER w, date) > 2 THEN 1 ELSE 0 END AS cut FROM d WINDOW w AS (PARTITION BY patient_id ORDER BY date)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY patient_id ORDER BY date) AS island FROM c),
w AS (SELECT i.patient_id, min(date) AS a, max(date) AS z FROM i JOIN (SELECT patient_id, island FROM i WHERE place = many // 2) mid USING (patient_id, island) GROUP BY i.patient_id),
j AS (SELECT s.*, NOT human_verified AND coalesce(date < a OR date > z, false) AS date_suspect FROM s LEFT JOIN w USING (patient_id))
SELECT patient_id, seq, CASE WHEN NOT date_suspect THEN date END AS date, human_verified, date_suspect FROM j""")
def dates_within_window(spark, sf_dir):
    """Dates outside of the patient's days, gone and marked unless a person read them."""
    s = samples(spark, sf_dir).withColumns({"date": F.when(F.col("seq") % 7 != 0, F.col("date")), "human_verified": F.col("seq") % 10 == 0})
    return L.within_window(s)
