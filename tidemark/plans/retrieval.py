"""Keyword retrieval: postings, BM25, expansion, dates in questions, citations, prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import EVERYDAY, EVERYDAY_TERMS
from ..functions.exprs import fixed, tokens
from ..operators.lookups import lookup

K1, B, TOP, FAN_OUT, EXPANDED = 1.5, 0.75, 8, 8, 0.6
#: So many different query terms at most are broadcast; more are joined by a shuffle of the tokens.
BROADCAST_TERMS = 10_000


def postings(chunks: DataFrame) -> DataFrame:
    """``id, term, tf, dl`` of chunks ``id, text``; the document length rides along with the terms."""
    t = chunks.select("id", tokens(F.col("text")).alias("t"))
    return t.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def term_stats(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


def bm25_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, id, score`` of all chunks that hold a term of a query of ``qid, term, weight``.

    The query terms are joined to the chunks' tokens before anything is grouped, so only their postings are shuffled.
    """
    terms = queries.select("term").distinct()
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    t = chunks.select("id", tokens(F.col("text")).alias("t"))
    sizes = t.select(F.size("t").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    found = t.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(terms, "term").groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    # Counted with tf and dl, so that both uses of the postings have the same columns and share one exchange.
    df = found.groupBy("term").agg(F.count_if((F.col("tf") > 0) & (F.col("dl") > 0)).alias("df"))
    return weigh(found, df, sizes, queries)


def weigh(found: DataFrame, df: DataFrame, sizes: DataFrame, queries: DataFrame) -> DataFrame:
    """BM25 ``qid, id, score`` from postings ``id, term, tf, dl``, ``term, df`` and the one row ``n, avgdl``, for queries ``qid, term, weight``."""
    scored = found.join(queries, "term").join(df, "term").crossJoin(F.broadcast(sizes))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("qid", "id").agg(fixed(F.sum(part)).alias("score"))


def best(scores: DataFrame, top: int = TOP) -> DataFrame:
    """The best chunks per query: score, then id."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return scores.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def bm25(chunks: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """The best chunks per query of ``qid, term, weight``."""
    return best(bm25_scores(chunks, queries), top)


def date_hits(hits: DataFrame, chunk_days: DataFrame, asked: DataFrame) -> DataFrame:
    """:func:`raised` for chunks of ``id, kind, day`` and the days ``qid, day`` asked for."""
    return raised(hits, chunk_days.join(asked, "day").select("qid", "id", "kind"))


def raised(hits: DataFrame, dated: DataFrame) -> DataFrame:
    """Scores with those of chunks ``dated`` (``qid, id, kind``) doubled, plus 3 for day chunks and 2 for others, also where no word of the question is in them."""
    days = dated.groupBy("qid", "id").agg(F.min("kind").alias("kind"))
    j = hits.join(days, ["qid", "id"], "full")
    plus = F.when(F.col("kind").isNull(), 0).when(F.col("kind") == "day", 3).otherwise(2)
    score = F.coalesce("score", F.lit(0.0)) * F.when(F.col("kind").isNull(), 1).otherwise(2) + plus
    return j.withColumn("score", score).drop("kind")


def everyday(spark, words: dict[str, str]) -> DataFrame:
    """A fixed table of words and what they stand for as ``word, term``."""
    return spark.createDataFrame([(w, t) for w, terms in words.items() for t in terms.split()], "word string, term string")


def concept_index(entries: DataFrame) -> DataFrame:
    """``word, analyte`` from dictionary entries of ``analyte, display, aliases, plain``: all their words stand for the analyte."""
    blob = F.concat_ws(" ", F.translate("analyte", "_", " "), "display", F.array_join("aliases", " "), "plain")
    return entries.select(F.explode(F.array_distinct(tokens(blob))).alias("word"), "analyte").distinct()


def expand(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Terms of ``qid, term`` with weight 1, and with less the words of the analytes that they stand for, as ``qid, term, weight``.

    A word stands for an analyte by the fixed everyday words, or by the dictionary's entries unless it is in more than
    ``FAN_OUT`` of them.  An analyte's words are those of its key and of its display name.
    """
    spark = queries.sparkSession
    asked = queries.select("qid", F.col("term").alias("word")).distinct()
    index = concept_index(entries)
    few = index.groupBy("word").agg(F.count("*").alias("fan")).filter(F.col("fan") <= FAN_OUT).select("word")
    known = index.join(few, "word").unionByName(everyday(spark, EVERYDAY).select("word", F.col("term").alias("analyte")))
    meant = asked.join(known, "word").select("qid", "analyte").distinct()
    named = lookup(meant, entries.select("analyte", "display"), "analyte")
    words = named.select("qid", F.explode(tokens(F.concat_ws(" ", F.translate("analyte", "_", " "), "display"))).alias("term"))
    words = words.unionByName(asked.join(everyday(spark, EVERYDAY_TERMS), "word").select("qid", "term"))
    every = queries.select("qid", "term", F.lit(1.0).alias("weight")).unionByName(words.withColumn("weight", F.lit(EXPANDED)))
    return every.groupBy("qid", "term").agg(F.max("weight").alias("weight"))


#: Fixed value: month names by their first three letters.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def mentioned_dates(text: Column) -> Column:
    """Days and months named in a question, as sorted distinct ``month * 100 + day``; the year is ignored.

    Two numbers with a slash or dash are day and month, also those inside an ISO date.
    """
    low = F.lower(text)
    month = "(" + "|".join(MONTHS) + ")[a-z]{0,6}"
    number = lambda name: F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("int")
    found = lambda pattern: F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
    part = lambda x, pattern: F.regexp_extract(x, pattern, 1)
    named = F.concat(
        F.transform(found(rf"\b[0-9]{{1,2}}(?:st|nd|rd|th)?[\s-]+{month}\b"), lambda x: number(part(x, month)) * 100 + part(x, "^([0-9]+)").cast("int")),
        F.transform(found(rf"\b{month}[\s-]+[0-9]{{1,2}}(?:st|nd|rd|th)?\b"), lambda x: number(part(x, month)) * 100 + part(x, "([0-9]+)(?:st|nd|rd|th)?$").cast("int")),
    )
    iso = F.transform(found(r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"), lambda x: F.substring(x, 6, 2).cast("int") * 100 + F.substring(x, 9, 2).cast("int"))
    pairs = F.transform(found(r"\b[0-9]{1,2}[/-][0-9]{1,2}\b"), lambda x: part(x, "([0-9]+)$").cast("int") * 100 + part(x, "^([0-9]+)").cast("int"))
    return F.array_sort(F.array_distinct(F.concat(named, iso, pairs)))


def mentioned_days(text: Column) -> Column:
    """Numbers of days that a question names as ``day N``."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"\bday\s*([0-9]{1,2})\b"), F.lit(1)), lambda x: x.cast("int"))))


def citations(rows: DataFrame, by: str) -> DataFrame:
    """Distinct (page, date) pairs per group, sorted, as text."""
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("page", "date"))), lambda s: F.concat_ws("@", s["page"].cast("string"), s["date"].cast("string"))), " ").alias("cites"))


def prompt(question: str, hits: list[tuple[str, str]]) -> list[dict]:
    """Messages for a model: what it may use, and the question."""
    sources = "\n".join(f"[{i}] {text}" for i, text in hits)
    return [{"role": "system", "content": "Answer from the numbered sources only and name them. Say so if they don't tell."}, {"role": "user", "content": f"Sources:\n{sources}\n\nQuestion: {question}"}]


def ask(questions: DataFrame, score: Callable[[DataFrame], DataFrame], entries: DataFrame | None = None, chunk_days: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """The best chunks for each question of ``qid, text``, as ``qid, id, score, place``.

    ``score`` gives ``qid, id, score`` for terms ``qid, term, weight``: :func:`bm25_scores` over chunks, or an index's.  Words are expanded by the dictionary's ``entries``.  Chunks of the days that a question names, by number
    or by date, are raised, also those without any of its words; ``chunk_days`` is ``id, kind, day, date``.
    """
    q = questions.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    q = q.withColumn("weight", F.lit(1.0)) if entries is None else expand(q, entries)
    hits = score(q)
    if chunk_days is not None:
        number = questions.select("qid", F.explode(mentioned_days(F.col("text"))).alias("day"))
        named = questions.select("qid", F.explode(mentioned_dates(F.col("text"))).alias("at"))
        found = chunk_days.join(number, "day").select("qid", "id", "kind")
        found = found.unionByName(chunk_days.withColumn("at", F.month("date") * 100 + F.dayofmonth("date")).join(named, "at").select("qid", "id", "kind"))
        hits = raised(hits, found)
    return best(hits, top)


def search(question: str, chunks: DataFrame, entries: DataFrame | None = None, chunk_days: DataFrame | None = None, top: int = TOP) -> DataFrame:
    """The best chunks for one question, as :func:`ask` finds them."""
    return ask(chunks.sparkSession.createDataFrame([(1, question)], "qid int, text string"), lambda q: bm25_scores(chunks, q), entries, chunk_days, top)


def answer(question: str, chunks: DataFrame, chat: Callable[[list[dict]], str], top: int = TOP, entries: DataFrame | None = None, chunk_days: DataFrame | None = None) -> dict:
    """Retrieve, ask the given model, and keep the sources if it fails; only ``top`` rows reach the driver."""
    found = search(question, chunks, entries, chunk_days, top).join(chunks, "id").orderBy("place").select("id", "text").collect()
    hits = [(str(r["id"]), r["text"]) for r in found]
    try:
        return {"ok": True, "text": chat(prompt(question, hits)), "sources": [i for i, _ in hits]}
    except Exception as e:  # the model is the caller's
        return {"ok": False, "text": "", "error": str(e), "sources": [i for i, _ in hits]}
