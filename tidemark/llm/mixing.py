"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source sends its documents in a shuffled order, again and again up to a limit of
passes.  A document's virtual finish time is the source's running word count after it,
divided by the source's target.  All sources' documents are put in order of that time
and the order is cut at the total budget, so every source ends near its target.

No source and no stretch of the order is one task's work: running sums are made of
sums per bucket of the shuffled order and sums within a bucket, with buckets sized by
the number of rows; the cut is looked for in ranges of virtual time and then within one
range.  Only a few numbers come to the driver.

Defined results: a null text has size 0; null is a source of its own, the last one; a
document of size 0 takes 0 words; a source of size 0 has target 0; repeated rows are
separate documents; rows without an id are shuffled by a hash of their texts; an empty
table gives no rows.  Rows equal in id and, without an id, in text are in one bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, packed, text_of, unpacked

PASSES = 3
WEIGHTS = (1, 2, 3)
ROWS_PER_BUCKET = 50_000
WIDE = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


@dataclass
class Mix:
    """What places a document in the mixed order."""

    sources: DataFrame  # tm_source, tm_rank, tm_total, tm_target
    before: DataFrame  # tm_source, tm_bucket, tm_before
    digits: int
    steps: int
    last_step: int | None  # the range of virtual time in which the budget ends
    last: tuple | None  # the last place in that range that the mix takes


def source_targets(sizes: DataFrame) -> DataFrame:
    """Sources with rank, weight, size and target.

    Targets are weight times a common level, stopped at ``PASSES`` times the size; the
    level follows from the sources in the order in which they stop.
    """
    total = F.sum("tm_total").over(Window.partitionBy())
    ranked = sizes.groupBy(F.col("tm_source")).agg(F.sum("tm_size").alias("tm_total")).withColumn("tm_rank", F.row_number().over(Window.orderBy(F.col("tm_source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("tm_rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("tm_weight", weight.cast("long")).withColumn("tm_all", total)
    stops = Window.orderBy(F.col("tm_total") * F.lit(math.lcm(*WEIGHTS)) / F.col("tm_weight"), "tm_rank")
    earlier = F.coalesce(F.sum(F.col("tm_total") * PASSES).over(stops.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.sum("tm_weight").over(stops.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("tm_left", F.col("tm_all") - earlier).withColumn("tm_later", later)
    stopped = F.col("tm_total").cast(WIDE) * PASSES * F.col("tm_later") <= F.col("tm_left").cast(WIDE) * F.col("tm_weight")
    # The first source that doesn't stop sets the level; what later rows compute is below it.
    level = F.max(F.when(~stopped, F.col("tm_left") / F.col("tm_later"))).over(Window.partitionBy())
    target = F.when(stopped, (F.col("tm_total") * PASSES).cast("double")).otherwise(F.col("tm_weight") * level)
    return ranked.withColumn("tm_target", target).select("tm_source", "tm_rank", "tm_total", "tm_target")


def _keys(docs: DataFrame, digits: int) -> list[Column]:
    shuffle = F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":mix"), docs["tm_mark"]))
    return [shuffle.alias("tm_key"), F.substring(shuffle, 1, digits).alias("tm_bucket")]


def _placed(rows: DataFrame, sources: DataFrame, before: DataFrame) -> DataFrame:
    """Rows with their source's numbers and with ``tm_run``, the running count of the first pass."""
    s = sources.select(F.col("tm_source").alias("tm_s"), "tm_rank", "tm_total", "tm_target")
    b = before.join(s, F.col("tm_source").eqNullSafe(F.col("tm_s"))).drop("tm_s").withColumnsRenamed({"tm_source": "tm_s", "tm_bucket": "tm_b"})
    joined = rows.join(b, F.col("tm_source").eqNullSafe(F.col("tm_s")) & (F.col("tm_bucket") == F.col("tm_b"))).drop("tm_s", "tm_b")
    within = Window.partitionBy("tm_rank", "tm_bucket").orderBy("tm_key", "doc_id", "tm_size").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("tm_run", F.col("tm_before") + F.sum("tm_size").over(within))


def _time(turn: Column) -> Column:
    """Virtual finish time of a document in pass ``turn``, counted from 0; null where the target is 0."""
    return F.try_divide((turn * F.col("tm_total") + F.col("tm_run")).cast("double"), F.col("tm_target"))


def _step(time: Column, steps: int) -> Column:
    return F.floor(F.least(time * steps, F.lit(float(steps + 1)))).cast("int")


def plan(docs: DataFrame) -> Mix:
    """Targets, running counts and the end of the mix, for ``doc_id, tm_source, tm_size, tm_mark``."""
    n = docs.count()
    digits = max(1, math.ceil(math.log(max(1, n / ROWS_PER_BUCKET), 16)))
    steps = max(16, math.ceil(PASSES * n / ROWS_PER_BUCKET))
    rows = docs.select("doc_id", "tm_source", "tm_size", *_keys(docs, digits))
    sources = cut(source_targets(rows), "mix-sources")
    sums = rows.groupBy("tm_source", "tm_bucket").agg(F.sum("tm_size").alias("tm_sum"))
    earlier = Window.partitionBy("tm_source").orderBy("tm_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(sums.select("tm_source", "tm_bucket", F.coalesce(F.sum("tm_sum").over(earlier), F.lit(0)).alias("tm_before")), "mix-buckets")
    placed = _placed(rows, sources, before)
    turns = F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))).alias("tm_turn")
    items = placed.filter("tm_size > 0 and tm_target > 0").select("doc_id", "tm_rank", "tm_total", "tm_target", "tm_size", "tm_key", "tm_run", turns).filter("tm_turn * tm_total + tm_run - tm_size < tm_target")
    items = cut(items.withColumn("tm_time", _time(F.col("tm_turn"))).withColumn("tm_step", _step(F.col("tm_time"), steps)).select("doc_id", "tm_rank", "tm_turn", "tm_size", "tm_key", "tm_time", "tm_step"), "mix-order")
    budget = sources.agg(F.sum("tm_total")).first()[0] or 0
    ranges = items.groupBy("tm_step").agg(F.sum("tm_size").alias("tm_sum")).withColumn("tm_upto", F.sum("tm_sum").over(Window.orderBy("tm_step")))
    end = ranges.filter(F.col("tm_upto") > budget).orderBy("tm_step").first()
    if end is None:
        return Mix(sources, before, digits, steps, None, None)
    place = ["tm_time", "tm_rank", "tm_turn", "tm_key", "doc_id", "tm_size"]
    order = Window.partitionBy("tm_step").orderBy(*place).rowsBetween(Window.unboundedPreceding, 0)
    inside = items.filter(F.col("tm_step") == end["tm_step"]).withColumn("tm_sum", F.sum("tm_size").over(order)).filter(F.col("tm_sum") <= budget - (end["tm_upto"] - end["tm_sum"]))
    last = inside.orderBy(F.col("tm_sum").desc()).select(*place).first()
    return Mix(sources, before, digits, steps, end["tm_step"], tuple(last) if last else None)


def place(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` (with ``tm_source``, ``tm_size`` and ``tm_mark``) and ``tm_turns``, the times the mix takes each."""
    placed = _placed(docs.select("*", *_keys(docs, mix.digits)), mix.sources, mix.before)

    def takes(turn: int) -> Column:
        time = _time(F.lit(turn))
        starts = (F.lit(turn) * F.col("tm_total") + F.col("tm_run") - F.col("tm_size")) < F.col("tm_target")
        if mix.last_step is None:
            return starts
        step = _step(time, mix.steps)
        inside = F.lit(False)
        if mix.last is not None:
            at, rank, its_turn, key, doc, size = mix.last
            tie = F.struct(F.col("tm_rank"), F.lit(turn), F.col("tm_key"), F.col("doc_id"), F.col("tm_size"))
            limit = F.struct(F.lit(rank), F.lit(its_turn), F.lit(key), F.lit(doc).cast(docs.schema["doc_id"].dataType), F.lit(size).cast("long"))
            inside = (time < at) | ((time == at) & (tie <= limit))
        return starts & ((step < mix.last_step) | ((step == mix.last_step) & inside))

    turns = sum((F.when(takes(k), 1).otherwise(0) for k in range(PASSES)), F.lit(0))
    return placed.withColumn("tm_turns", F.when((F.col("tm_size") > 0) & (F.col("tm_target") > 0), turns).otherwise(F.when(F.col("tm_size") == 0, 1).otherwise(0)))


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``tm_source``, ``tm_size``, and ``tm_mark``: what shuffles rows without an id, a hash of the text."""
    mark = F.when(docs["doc_id"].isNull(), F.hex(F.xxhash64(text_of(docs)))).otherwise("")
    return docs.select("*", docs["source"].alias("tm_source"), word_count(text_of(docs)).alias("tm_size"), mark.alias("tm_mark"))


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes from it."""
    small = cut(sized(docs.select("doc_id", "source", "text")).select("doc_id", "tm_source", "tm_size", "tm_mark"), "mix-sizes")
    placed = place(small, plan(small))
    return placed.select("doc_id", F.col("tm_size").alias("size"), F.col("tm_total").alias("source_size"), F.col("tm_target").alias("target"), (F.col("tm_turns") * F.col("tm_size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; documents of size 0 stay once."""
    own = ("doc_id", "source", "text")
    rows = sized(packed(docs, *own))
    small = cut(rows.select("doc_id", "tm_source", "tm_size", "tm_mark"), "mix-sizes")
    placed = place(rows, plan(small)).filter("tm_turns > 0")
    return placed.select(*own, "tm_rest", F.explode(F.sequence(F.lit(1), F.col("tm_turns")))).select(*unpacked(docs.columns, *own))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR || ':mix') AS k FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM docs GROUP BY source),
weighed AS (SELECT *, (rank - 1) % 3 + 1 AS weight, (sum(total) OVER ())::BIGINT AS everything FROM sizes),
stops AS (
  SELECT *, everything - coalesce(sum(3 * total) OVER (ORDER BY total * 6 / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS remaining,
         (sum(weight) OVER (ORDER BY total * 6 / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS later FROM weighed),
levels AS (SELECT *, 3 * total::HUGEINT * later <= remaining::HUGEINT * weight AS stopped FROM stops),
targets AS (
  SELECT source, rank, total, everything,
         CASE WHEN stopped THEN (3 * total)::DOUBLE
              ELSE weight * max(CASE WHEN NOT stopped THEN remaining::DOUBLE / later::DOUBLE END) OVER () END AS target
  FROM levels),
runs AS (
  SELECT docs.*, rank, total, everything, target,
         (sum(size) OVER (PARTITION BY rank ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS run
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source),
items AS (
  SELECT doc_id, rank, turn, size, k, everything, (turn * total + run)::DOUBLE / target AS finish
  FROM runs, (VALUES (0), (1), (2)) AS t(turn)
  WHERE size > 0 AND target > 0 AND turn * total + run - size < target),
ordered AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, turn, k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM items),
took AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM ordered WHERE upto <= everything GROUP BY doc_id)
SELECT runs.doc_id, size, total AS source_size, target, coalesce(taken, 0) AS taken FROM runs LEFT JOIN took USING (doc_id)
"""
