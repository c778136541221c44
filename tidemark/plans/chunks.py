"""Retrievable chunks of scores, findings and results in words, with the pages and dates they rest on.

Observations have at least ``patient_id, analyte, display, day, collected, kind, text, page``.  All kinds have one shape:
``patient_id, id, kind, text, analytes, days, dates, pages, cites``; lists are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import general, reference_sentence
from ..functions.words import day_label
from ..operators.lookups import lookup

SHAPE = ["patient_id", "id", "kind", "text", "analytes", "days", "dates", "pages", "cites"]


def seen(found: DataFrame, by: list[str]) -> DataFrame:
    """Dates, pages and ``page@date`` citations of the observations ``page, collected`` of each group."""
    date = F.to_date("collected")
    pairs = F.array_sort(F.collect_set(F.when(F.col("page").isNotNull() & date.isNotNull(), F.struct(F.col("page"), date.alias("date")))))
    texts = F.transform(pairs, lambda s: F.concat_ws("@", s["page"].cast("string"), s["date"].cast("string")))
    return found.groupBy(*by).agg(F.array_sort(F.collect_set(date)).alias("dates"), F.array_sort(F.collect_set("page")).alias("pages"), F.array_join(texts, " ").alias("cites"))


def chunked(df: DataFrame, cites: DataFrame, by: list[str]) -> DataFrame:
    """``df`` in the shape of chunks; what nothing was observed for has empty lists."""
    out = df.join(cites, by, "left")
    empty = {"dates": "array<date>", "pages": f"{out.schema['pages'].dataType.simpleString()}"}
    out = out.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in empty.items()} | {"cites": F.coalesce("cites", F.lit(""))})
    return out.select(*SHAPE)


def value_chunks(obs: DataFrame, entries: DataFrame) -> DataFrame:
    """One chunk per patient and analyte: all its values in order, its range, the laboratory's flags, and what the dictionary says of it.

    A value has its time where the day has several.  ``obs`` has ``value, unit, low, high, seq`` besides; ``entries`` is the dictionary.
    """
    w = Window.partitionBy("patient_id", "analyte").orderBy("collected", "seq")
    date = F.to_date("collected")
    several = F.coalesce(date == F.lag(date).over(w), F.lit(False)) | F.coalesce(date == F.lead(date).over(w), F.lit(False))
    o = obs.filter("kind = 'quantity' and value is not null").withColumn("several", several)
    said = F.concat(general(F.col("value")), F.lit(" ("), F.when(F.col("several"), day_label(F.col("collected"), True)).otherwise(day_label(F.col("collected"))), F.lit(")"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("collected", "seq", said.alias("said")))), lambda x: x["said"])
    first = F.min_by(F.struct("unit", "low", "high"), F.struct("collected", "seq"))
    cite = F.when(F.col("page").isNotNull() & date.isNotNull(), F.struct("page", date.alias("date")))
    cites = F.array_join(F.transform(F.array_sort(F.collect_set(cite)), lambda s: F.concat_ws("@", s["page"].cast("string"), s["date"].cast("string"))), " ")
    g = o.groupBy("patient_id", "analyte").agg(F.array_join(items, ", ").alias("said"), first.alias("f"), F.array_join(F.array_sort(F.collect_set("interpretation")), ", ").alias("flags"), F.array_sort(F.collect_set("day")).alias("days"), F.array_sort(F.collect_set(date)).alias("dates"), F.array_sort(F.collect_set("page")).alias("pages"), cites.alias("cites"))
    g = lookup(g, entries.select("analyte", "display", "system", "plain"), "analyte")
    none = lambda c, other: F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(other)
    text = F.concat(F.coalesce("display", "analyte"), F.lit(" ("), F.col("analyte"), F.lit("), "), F.coalesce("system", F.lit("other")), F.lit(". Values over time: "), F.col("said"), F.lit(". Units "), none(F.col("f.unit"), "none"), F.lit(". "), none(reference_sentence(F.col("f.low"), F.col("f.high")), "No range printed."), F.lit(" Flags: "), none(F.col("flags"), "none"), F.lit(". "), F.coalesce("plain", F.lit("")))
    return g.withColumns({"id": F.concat(F.lit("series:"), F.col("analyte")), "kind": F.lit("series"), "text": F.trim(text), "analytes": F.array("analyte")}).select(*SHAPE)


def finding_chunks(found: DataFrame, obs: DataFrame, entries: DataFrame) -> DataFrame:
    """One chunk per finding in words (``headline, detail, evidence, place``); cited by the observations of its evidence days,
    of its analyte if it has one, else of all (JOIN-15)."""
    f = lookup(found, entries.select("analyte", "plain"), "analyte")
    days = F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["day"])))
    text = F.concat(F.lit("Detected pattern ("), F.col("severity"), F.lit("): "), F.col("headline"), F.lit(" "), F.col("detail"), F.lit(" Analyte: "), F.coalesce("analyte", F.lit("none")), F.lit(". "), F.coalesce("plain", F.lit("")))
    f = f.withColumns({"id": F.format_string("pattern:%s:%d", "rule", "place"), "kind": F.lit("pattern"), "text": F.trim(text), "analytes": F.array_compact(F.array("analyte")), "days": days})
    spread = f.select("patient_id", "id", F.col("analyte").alias("of"), F.explode("days").alias("day"))
    hits = spread.join(obs.select("patient_id", "day", "analyte", "page", "collected"), ["patient_id", "day"]).filter("of is null or of = analyte")
    return chunked(f, seen(hits, ["patient_id", "id"]), ["patient_id", "id"])


def score_chunks(scores: DataFrame, obs: DataFrame) -> DataFrame:
    """One chunk per patient and day of ``patient_id, day, name, score`` (struct of a score), cited by all observations of the day (JOIN-14)."""
    s = F.col("score")
    gaps = F.coalesce(F.nullif(F.array_join(s["missing"], ", "), F.lit("")), F.lit("unrecorded inputs"))
    done = F.coalesce(s["complete"], F.lit(False)) & s["value"].isNotNull()
    part = F.when(done, F.concat("name", F.lit(" = "), s["value"].cast("string"))).otherwise(F.concat("name", F.lit(" not computed: missing "), gaps))
    items = F.transform(F.array_sort(F.collect_list(F.struct("name", part.alias("part")))), lambda x: x["part"])
    g = scores.groupBy("patient_id", "day").agg(F.array_join(items, "; ").alias("parts"))
    g = g.withColumns({"id": F.format_string("score:%d", "day"), "kind": F.lit("score"), "text": F.format_string("Severity scores for day %d: %s.", "day", "parts"), "analytes": F.array().cast("array<string>"), "days": F.array("day")})
    of_day = scores.select("patient_id", "day").distinct().join(obs, ["patient_id", "day"])
    return chunked(g, seen(of_day, ["patient_id", "day"]), ["patient_id", "day"])


def pattern_chunks(findings: DataFrame, obs: DataFrame) -> DataFrame:
    """One chunk per finding; cited by observations of its days, of its analyte if it has one, else of all (JOIN-15).

    The evidence of a finding are the days from its first to its last on which anything of it was observed.
    """
    name = F.concat_ws(":", F.lit("pattern"), "rule", F.coalesce("analyte", F.lit("")), F.col("from_day").cast("string"), F.col("to_day").cast("string"))
    f = findings.withColumns({"id": name, "kind": F.lit("pattern"), "analytes": F.array_compact(F.array("analyte"))})
    f = f.withColumn("text", F.concat(F.lit("Detected pattern ("), F.col("severity"), F.lit("): "), F.col("rule"), F.lit(". Analyte: "), F.coalesce("analyte", F.lit("none")), F.lit(".")))
    spread = f.filter("from_day is not null").select("patient_id", "id", F.col("analyte").alias("of"), F.explode(F.sequence("from_day", F.coalesce("to_day", "from_day"))).alias("day"))
    hits = spread.join(obs, ["patient_id", "day"]).filter("of is null or of = analyte")
    days = hits.groupBy("patient_id", "id").agg(F.array_sort(F.collect_set("day")).alias("days"))
    f = f.join(days, ["patient_id", "id"], "left").withColumn("days", F.coalesce("days", F.array().cast("array<int>")))
    return chunked(f, seen(hits, ["patient_id", "id"]), ["patient_id", "id"])


def qualitative_chunks(obs: DataFrame) -> DataFrame:
    """One chunk per result in words, which never becomes a number."""
    q = obs.filter("kind = 'qualitative'")
    date = F.to_date("collected")
    text = F.concat(F.coalesce("display", "analyte"), F.lit(" result: "), F.coalesce("text", F.lit("none")), F.lit(". Collected "), F.coalesce(F.date_format("collected", "yyyy-MM-dd HH:mm"), F.lit("unknown")), F.lit(" (day "), F.coalesce(F.col("day").cast("string"), F.lit("unknown")), F.lit(")."))
    lists = {"analytes": F.array("analyte"), "days": F.array_compact(F.array("day")), "dates": F.array_compact(F.array(date)), "pages": F.array_compact(F.array("page"))}
    cites = F.when(F.col("page").isNotNull() & date.isNotNull(), F.concat_ws("@", F.col("page").cast("string"), date.cast("string"))).otherwise("")
    return q.withColumns({"id": F.concat_ws(":", F.lit("qual"), "analyte", F.col("seq").cast("string")), "kind": F.lit("qualitative"), "text": text, "cites": cites} | lists).select(*SHAPE)
