"""Queries over a dictionary table with versions and over printed labels, with their SQL.

``part`` is the dictionary: each name of a part is an analyte.  ``lineitem`` holds what was printed, with the
damage of a reading that a line's number tells.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions.exprs import interpret
from .operators import labels as N
from .operators.quality import choose_unit
from .sources import dictionary as D
from .sources.tables import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def log(spark, sf_dir):
    """All versions: every name at 1; new ranges and names for some at 2; at 3 some are gone, and others take their aliases."""
    p = read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("place"), F.min_by(F.struct("p_brand", "p_type", "p_size"), "p_partkey").alias("p"))
    key, size = F.translate("name", " ", "_").alias("analyte"), F.col("p.p_size").cast("double")
    none = F.array().cast("array<string>")
    entry = lambda version, retired, display, aliases, low, high: [key, F.lit(version).alias("version"), F.lit(retired).alias("retired"), "place", display.alias("display"), aliases.alias("aliases"), F.col("p.p_brand").alias("unit"), low.alias("low"), high.alias("high"), F.when(F.col("place") % 3 == 0, 1).when(F.col("place") % 3 == 1, -1).alias("valence"), F.col("p.p_type").alias("system"), F.concat(F.lit("About "), F.col("name")).alias("plain")]
    first = p.select(entry(1, False, F.initcap("name"), F.array(F.concat(F.col("name"), F.lit(" level"))), size, size + 20))
    second = p.filter("place % 4 = 0").select(entry(2, False, F.upper("name"), F.array(F.concat(F.col("name"), F.lit(" level")), F.concat(F.lit("total "), F.col("name"))), size / 2, F.lit(None).cast("double")))
    gone = p.filter("place % 5 = 1").select(entry(3, True, F.initcap("name"), none, size, size))
    heir = p.filter("place % 5 = 2").select(entry(3, False, F.initcap("name"), F.array(F.concat(F.split("name", " ")[0], F.lit(" thing"))), size, size + 5))
    return first.unionByName(second).unionByName(gone).unionByName(heir)


LOG_SQL = """
WITH RECURSIVE p AS (
  SELECT p_name AS name, min(p_partkey) AS place, arg_min(p_brand, p_partkey) AS unit, arg_min(p_type, p_partkey) AS system, arg_min(p_size, p_partkey)::DOUBLE AS size FROM part GROUP BY p_name),
named AS (SELECT *, replace(name, ' ', '_') AS analyte, array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title,
                 CASE place % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 END AS valence FROM p),
log AS (
  SELECT analyte, 1 AS version, false AS retired, place, title AS display, [name || ' level'] AS aliases, unit, size AS low, size + 20 AS high, valence, system FROM named
  UNION ALL SELECT analyte, 2, false, place, upper(name), [name || ' level', 'total ' || name], unit, size / 2, NULL, valence, system FROM named WHERE place % 4 = 0
  UNION ALL SELECT analyte, 3, true, place, title, []::VARCHAR[], unit, size, size, valence, system FROM named WHERE place % 5 = 1
  UNION ALL SELECT analyte, 3, false, place, title, [string_split(name, ' ')[1] || ' thing'], unit, size, size + 5, valence, system FROM named WHERE place % 5 = 2),
known AS (
  SELECT ver, l.* FROM (VALUES (1), (2), (3)) v(ver), log l WHERE l.version <= ver
  QUALIFY row_number() OVER (PARTITION BY ver, analyte ORDER BY version DESC) = 1),
entries AS (SELECT * FROM known WHERE NOT retired),
names AS (SELECT ver, analyte, place, unnest(list_prepend(display, aliases)) AS name FROM entries),
alias AS (SELECT ver, regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') AS norm, arg_min(analyte, (place, analyte)) AS key FROM names GROUP BY ALL)
"""


@query(LOG_SQL + "SELECT ver AS version, analyte, display, array_to_string(aliases, '|') AS aliases, unit, low, high, valence, system FROM entries")
def dictionary_versions(spark, sf_dir):
    every = log(spark, sf_dir)
    out = [D.as_of(every, v).withColumn("version", F.lit(v)) for v in (1, 2, 3)]
    return out[0].unionByName(out[1]).unionByName(out[2]).select("version", "analyte", "display", F.array_join("aliases", "|").alias("aliases"), "unit", "low", "high", "valence", "system")


@query(LOG_SQL + """SELECT coalesce(a.norm, b.norm) AS alias_norm, a.key AS was, b.key AS key
FROM (SELECT * FROM alias WHERE ver = 1) a FULL JOIN (SELECT * FROM alias WHERE ver = 3) b ON a.norm = b.norm WHERE a.key IS DISTINCT FROM b.key""")
def alias_changes(spark, sf_dir):
    every = log(spark, sf_dir)
    return D.alias_changes(D.alias_index(D.as_of(every, 1)), D.alias_index(D.as_of(every, 3))).select("alias_norm", "was", "key")


@query(LOG_SQL + """
SELECT l_orderkey, l_linenumber, l_partkey, replace(p_name, ' ', '_') AS analyte, display, unit, system, low, high,
       CASE WHEN low IS NULL AND high IS NULL THEN NULL WHEN l_quantity > high THEN 'H' WHEN l_quantity < low THEN 'L' ELSE 'N' END AS interpretation
FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT * FROM entries WHERE ver = 3) e ON e.analyte = replace(p_name, ' ', '_')""")
def dictionary_join(spark, sf_dir):
    """Every line with its analyte's entry of the newest version."""
    analyte = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.translate("p_name", " ", "_").alias("analyte"))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(analyte, "l_partkey")
    j = D.described(rows, D.as_of(log(spark, sf_dir)), ["display", "unit", "system", "low", "high"])
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "analyte", "display", "unit", "system", "low", "high", interpret(F.col("l_quantity"), F.col("low"), F.col("high")).alias("interpretation"))


def printed_names(spark, sf_dir):
    """Lines with the name of their part as it was printed: whole, clipped, misread, with a word more, or another word."""
    name = F.upper("p_name")
    k = (F.col("l_linenumber") + F.col("l_orderkey")) % 9
    damaged = F.when(k == 0, name).when(k == 1, F.concat(F.lit(">"), F.substring(name, 2, 99))).when(k == 2, F.replace(name, F.lit("I"), F.lit("l1")))
    damaged = damaged.when(k == 3, F.concat(name, F.lit(" Serum ,"))).when(k == 4, F.concat(F.lit("S"), name)).when(k == 5, F.concat(F.lit("TOTAL "), name))
    damaged = damaged.when(k == 6, F.concat(F.split(name, " ")[1], F.lit(" "), F.split(name, " ")[0])).when(k == 7, F.concat(F.substring(name, 1, 3), F.lit(" thing"))).otherwise(F.concat(F.split(name, " ")[0], F.lit(" THlNG")))
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(p, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", damaged.alias("raw_test"))


PRINTED_SQL = """,
printed AS (
  SELECT l_orderkey, l_linenumber, l_partkey, upper(p_name) AS n, string_split(upper(p_name), ' ') AS w, (l_linenumber + l_orderkey) % 9 AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
raws AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE k WHEN 0 THEN n WHEN 1 THEN '>' || n[2:] WHEN 2 THEN replace(n, 'I', 'l1') WHEN 3 THEN n || ' Serum ,' WHEN 4 THEN 'S' || n WHEN 5 THEN 'TOTAL ' || n
         WHEN 6 THEN w[2] || ' ' || w[1] WHEN 7 THEN n[1:3] || ' thing' ELSE w[1] || ' THlNG' END AS raw_test FROM printed)
"""

#: The similarity of pairs of ``x, y`` in the rows of ``{pairs}``: the longest common part first, of equal ones the first in ``x``, then left and right of it.
RATIO_SQL = """,
parts AS (
  SELECT x, y, x AS a, y AS b, 0 AS m FROM {pairs}
  UNION ALL
  SELECT x, y, part.a, part.b, part.m FROM (
    SELECT x, y, unnest([{{'a': a[:strpos(a, s) - 1], 'b': b[:strpos(b, s) - 1], 'm': len(s)}}, {{'a': a[strpos(a, s) + len(s):], 'b': b[strpos(b, s) + len(s):], 'm': 0}}]) AS part FROM (
      SELECT *, list_filter(flatten(list_transform(range(least(len(a), len(b)), 0, -1), lambda n: list_transform(range(1, len(a) - n + 2), lambda i: a[i:i + n - 1]))), lambda t: contains(b, t))[1] AS s
      FROM parts WHERE a <> '' AND b <> '') WHERE s IS NOT NULL)),
ratios AS (SELECT x, y, 2.0::DOUBLE * sum(m) / (len(x) + len(y)) AS ratio FROM parts GROUP BY x, y)
"""

#: Labels of ``asked`` to the aliases of ``index``: exact, longest first words, most similar.
MATCH_SQL = """,
cleaned AS (
  SELECT DISTINCT raw_test AS label, trim(regexp_replace(regexp_replace(trim(raw_test), '[,;:]+$', ''), ',\\s*(serum|plasma|blood)\\s*$', '', 'i')) AS c FROM raws),
worded AS (SELECT *, list_filter(regexp_split_to_array(c, '\\s+'), lambda t: t <> '') AS w, regexp_replace(upper(c), '[^A-Z0-9]', '', 'g') AS norm FROM cleaned),
tries AS (SELECT label, len(w) AS n, unnest(range(1, len(w) + 1)) AS k, w FROM worded),
direct AS (
  SELECT label, key, CASE WHEN k = n THEN 'exact' ELSE 'prefix' END AS match FROM tries JOIN index ON index.norm = regexp_replace(upper(array_to_string(w[1:k], ' ')), '[^A-Z0-9]', '', 'g')
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY k DESC) = 1),
asked AS (SELECT DISTINCT norm FROM worded ANTI JOIN direct USING (label) WHERE len(norm) >= 5),
pairs AS (SELECT index.norm AS x, asked.norm AS y FROM index, asked WHERE 2.0::DOUBLE * least(len(index.norm), len(asked.norm)) / (len(index.norm) + len(asked.norm)) >= 0.86)
""" + RATIO_SQL.format(pairs="pairs") + """,
nearest AS (SELECT y, key FROM ratios JOIN index ON x = norm WHERE ratio >= 0.86 QUALIFY row_number() OVER (PARTITION BY y ORDER BY ratio DESC, x DESC) = 1),
matched AS (
  SELECT label, coalesce(direct.key, nearest.key) AS key, CASE WHEN direct.key IS NOT NULL THEN match WHEN nearest.key IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS match
  FROM worded LEFT JOIN direct USING (label) LEFT JOIN nearest ON y = norm AND direct.key IS NULL)
"""


@query(LOG_SQL + PRINTED_SQL + ", index AS (SELECT norm, key FROM alias WHERE ver = 3)" + MATCH_SQL + "SELECT label, key, match FROM matched")
def label_match_fuzzy(spark, sf_dir):
    """Every printed name with the analyte that it stands for, and how it was found."""
    return N.match_labels(printed_names(spark, sf_dir).select(F.col("raw_test").alias("label")), D.alias_index(D.as_of(log(spark, sf_dir))))


@query(LOG_SQL + PRINTED_SQL + ", index AS (SELECT norm, key FROM alias WHERE ver = 3)" + MATCH_SQL + """,
rows AS (SELECT l_orderkey, l_linenumber, raw_test, replace(p_name, ' ', '_') AS analyte, CASE WHEN l_orderkey % 4 = 0 THEN 3 ELSE 1 END AS was
         FROM raws JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, raw_test, CASE WHEN was = 3 THEN r.analyte ELSE coalesce(key, r.analyte) END AS analyte,
       CASE WHEN was = 1 AND key IS NOT NULL AND key <> r.analyte THEN e.display ELSE r.analyte END AS display, 3 AS dictionary_version
FROM rows r JOIN matched ON raw_test = label LEFT JOIN (SELECT * FROM entries WHERE ver = 3) e ON e.analyte = key""")
def rederived_rows(spark, sf_dir):
    """Lines whose analytes were found with an old dictionary, brought to the newest one; every fourth order was read with that already."""
    key = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.translate("p_name", " ", "_").alias("analyte"))
    rows = printed_names(spark, sf_dir).join(key, "l_partkey").select("l_orderkey", "l_linenumber", "raw_test", "analyte", F.col("analyte").alias("display"), F.when(F.col("l_orderkey") % 4 == 0, 3).otherwise(1).alias("dictionary_version"))
    return D.rederive(rows, log(spark, sf_dir), 3)


@query("""
WITH RECURSIVE units AS (
  SELECT DISTINCT p_brand AS y, CASE p_partkey % 6 WHEN 0 THEN p_brand WHEN 1 THEN replace(p_brand, 'nd#', 'rd*') WHEN 2 THEN replace(p_brand, '#', 'f') WHEN 3 THEN '' WHEN 4 THEN 'Brand#1' ELSE p_type END AS x, p_partkey FROM part),
distinct_units AS (SELECT DISTINCT x, y FROM units WHERE x <> '')""" + RATIO_SQL.format(pairs="distinct_units") + """
SELECT x AS printed, y AS expected, CASE WHEN x = '' OR lower(x) = lower(y) OR ratio >= 0.7 THEN y WHEN x IN ('Brand#1', 'SMALL') THEN x ELSE y END AS unit,
       NOT (x = '' OR lower(x) = lower(y) OR coalesce(ratio >= 0.7, false)) AND x IN ('Brand#1', 'SMALL') AS mismatch, count(*) AS n
FROM units LEFT JOIN ratios USING (x, y) GROUP BY ALL""")
def unit_similarity(spark, sf_dir):
    """Printed units against the expected ones: a similar one (0.7) is a misreading, a known other one is kept and marked."""
    k = F.col("p_partkey") % 6
    brand = F.col("p_brand")
    printed = F.when(k == 0, brand).when(k == 1, F.replace(brand, F.lit("nd#"), F.lit("rd*"))).when(k == 2, F.replace(brand, F.lit("#"), F.lit("f"))).when(k == 3, "").when(k == 4, "Brand#1").otherwise(F.col("p_type"))
    rows = read(spark, sf_dir, "part").select(printed.alias("printed"), brand.alias("expected")).groupBy("printed", "expected").agg(F.count("*").alias("n"))
    pairs = N.similar_pairs(rows.select(F.col("printed").alias("a")), rows.select(F.col("expected").alias("b")), 0.7)
    j = rows.join(pairs.select(F.col("a").alias("printed"), F.col("b").alias("expected"), "ratio"), ["printed", "expected"], "left")
    u = choose_unit(F.col("printed"), F.col("expected"), ["Brand#1", "SMALL"], F.col("ratio").isNotNull())
    return j.select("printed", "expected", u["unit"].alias("unit"), u["mismatch"].alias("mismatch"), "n")
