"""From words with boxes to printed lines, columns and observations; bands of pages; timelines.

``words``: ``page, word_no, text, left, top, width, height``; pixel work happens elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import BAND_LABELS, SAMPLE_NO
from ..functions.exprs import id_stem
from ..operators.labels import match_labels, similarity  # noqa: F401

OVERLAP = 0.6
#: Items on a sheet.
SHEET = 22
#: Fractions of the page width where the columns test, result and unit end.
COLUMNS = (("test", 0.29), ("result", 0.595), ("unit", 0.695))
DARK, TOP_SHARE, LEAST_SHARE, MOST_SHARE, MEAN_DARK = 195, 0.10, 0.012, 0.035, 160


def words_from_tsv(spark, path: str) -> DataFrame:
    """Words of tab-separated recogniser output; blank texts and negative confidences go."""
    kinds = "level int, page int, block int, par int, line_num int, word_no int, left int, top int, width int, height int, conf double, text string"
    t = spark.read.option("sep", "\t").option("quote", "").option("header", "true").schema(kinds).csv(path)
    return t.filter("conf >= 0 and trim(coalesce(text, '')) <> ''")


def group_lines(words: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """Words with ``line``: a word joins the first line whose first word it overlaps vertically by more than ``overlap`` of the lower of both.

    Pages are sorted by the top of their words and streamed.  A line whose first word ends above the next word's top can't
    be joined any more, so only the lines that reach that far down are held, in the order in which they began, which is that of their numbers.
    """

    def number(frames: Iterator) -> Iterator:
        page, lines, n = None, [], 0
        for f in frames:
            out = []
            for at, top, height in zip(f["tm_page"], f["top"], f["height"]):
                if at != page:
                    page, lines, n = at, [], 0
                lines = [x for x in lines if x[2] > top]
                for k, a, b in lines:
                    if min(top + height, b) - top > overlap * min(height, b - a):
                        out.append(k)
                        break
                else:
                    out.append(n)
                    lines.append((n, top, top + height))
                    n += 1
            yield f.drop(columns="tm_page").assign(line=out)

    from pyspark.sql import types as T

    keyed = words.withColumn("tm_page", F.coalesce(F.col("page").cast("string"), F.lit("")))
    streamed = keyed.repartition("tm_page").sortWithinPartitions("tm_page", "top", "left", "word_no")
    return streamed.mapInPandas(number, T.StructType([*words.schema.fields, T.StructField("line", T.LongType())]))


def to_rows(words: DataFrame, width: int) -> DataFrame:
    """One row per line with the texts of its columns, by the centres of the words."""
    centre = (F.col("left") + F.col("width") / 2) / width
    column = F.lit("range")
    for name, end in reversed(COLUMNS):
        column = F.when(centre < end, name).otherwise(column)
    w = words.withColumn("column", column)
    pick = lambda name: F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(F.col("column") == name, F.struct("left", "word_no", "text")))), lambda s: s["text"])).alias(name)
    return w.groupBy("page", "line").agg(*[pick(n) for n in ("test", "result", "unit", "range")])


def content_rows(rows: DataFrame, anchor: Column, prose: Column, method: Column, value: Column) -> DataFrame:
    """Rows below the last anchor of a page, without prose and what follows it up to the next value.

    A window over line order: prose that is not about a method starts skipping, a value row
    or prose about a method ends it.
    """
    by = Window.partitionBy("page")
    upto = by.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(prose & ~method, 1).when(prose & method, 0).when(value, 0)
    r = rows.withColumn("last_anchor", F.max(F.when(anchor, F.col("line"))).over(by)).filter("last_anchor is null or line > last_anchor")
    r = r.withColumn("skip", F.last(event, ignorenulls=True).over(upto))
    return r.filter(~prose & (F.coalesce("skip", F.lit(0)) == 0)).drop("last_anchor", "skip")


def merge_wrapped(rows: DataFrame) -> DataFrame:
    """A row with a test name only or a unit only goes on with the row before."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    only_test = ~blank("test") & blank("result") & blank("unit") & blank("range")
    only_unit = blank("test") & blank("result") & ~blank("unit") & blank("range")
    w = Window.partitionBy("page").orderBy("line")
    starts = F.when((only_test | only_unit) & (F.row_number().over(w) > 1), 0).otherwise(1)
    r = rows.withColumn("starts", starts).withColumn("entry", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    join = lambda c: F.trim(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.when(~blank(c), F.struct("line", c)))), lambda s: s[c]))).alias(c)
    return r.groupBy("page", "entry").agg(F.min("line").alias("line"), *[join(c) for c in ("test", "result", "unit", "range")])


def dark_runs(rows: DataFrame) -> DataFrame:
    """Dark horizontal strips of pages of ``page, y, lum, height``: islands of dark rows of the right height and darkness."""
    w = Window.partitionBy("page").orderBy("y")
    d = rows.filter((F.col("lum") < DARK) & (F.col("y") >= TOP_SHARE * F.col("height")))
    d = d.withColumn("island", F.col("y") - F.row_number().over(w))
    g = d.groupBy("page", "island").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.avg("lum").alias("mean"), F.first("height").alias("page_height")).withColumn("tall", F.col("bottom") - F.col("top") + 1)
    ok = (F.col("tall") >= LEAST_SHARE * F.col("page_height")) & (F.col("tall") <= MOST_SHARE * F.col("page_height")) & (F.col("mean") <= MEAN_DARK)
    return g.filter(ok).select("page", "top", "bottom", "tall")


def pair_bands(runs: DataFrame) -> DataFrame:
    """Strips as header, sample or unknown: two that follow closely are a pair, and a pair uses both.

    Greedy pairing comes down to the parity of the place within a chain of close strips.
    """
    w = Window.partitionBy("page").orderBy("top")
    link = F.coalesce(F.lead("top").over(w) - F.col("bottom") <= F.greatest(F.lit(30), 3 * F.col("tall")), F.lit(False))
    r = runs.withColumn("link", link).withColumn("begins", F.when(F.coalesce(F.lag("link").over(w), F.lit(False)), 0).otherwise(1)).withColumn("chain", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("page", "chain").orderBy("top")) - 1
    r = r.withColumn("place", place)
    return r.select("page", "top", "bottom", F.when(F.col("place") % 2 == 1, "sample").when(F.col("link"), "header").otherwise("unknown").alias("kind"))


def batches(items: DataFrame, size: int = SHEET, by: tuple[str, ...] = ()) -> DataFrame:
    """Items ``seq, analyte`` with the number of a ``sheet``, counted anew for each ``by``: a sheet closes at a change of analyte once it is full.

    What is walked through in order is one entry per analyte, the number of its items, so no task holds the items of a group.
    """
    counts = items.groupBy(*by, "analyte").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    walk = F.array_sort(F.collect_list(F.struct("first", "analyte", "n")))
    lists = counts.groupBy(*by).agg(walk.alias("walk"))
    none = F.array().cast("array<struct<analyte:string,sheet:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("sheet"), F.lit(0).cast("long").alias("held"), none.alias("out"))

    def step(s: Column, g: Column) -> Column:
        full = s["held"] >= size
        sheet = s["sheet"] + F.when(full, 1).otherwise(0)
        here = F.struct(g["analyte"].cast("string").alias("analyte"), sheet.alias("sheet"))
        return F.struct(sheet.alias("sheet"), (F.when(full, 0).otherwise(s["held"]) + g["n"]).alias("held"), F.concat(s["out"], F.array(here)).alias("out"))

    sheets = lists.select(*by, F.inline(F.aggregate("walk", start, step)["out"]))
    same = F.col("i.analyte").eqNullSafe(F.col("s.analyte"))
    for c in by:
        same = same & F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}"))
    return items.alias("i").join(sheets.alias("s"), same).select("i.*", "s.sheet")


def band_segments(text: Column, labels: dict[str, str] = BAND_LABELS) -> Column:
    """A heading's text as a map from label to what stands between it and the next label found, in whatever order they are.

    A label counts at its first place; those that aren't found are not in the map.
    """
    places = [F.struct(F.regexp_instr(text, F.lit(p)).alias("start"), F.length(F.regexp_substr(text, F.lit(p))).alias("size"), F.lit(k).alias("label")) for k, p in labels.items()]
    found = F.array_sort(F.filter(F.array(*places), lambda x: x["start"] > 0))
    ends = F.concat(F.slice(F.transform(found, lambda x: x["start"]), 2, len(labels)), F.array(F.length(text) + 1))
    return F.map_from_entries(F.zip_with(found, F.slice(ends, F.lit(1), F.greatest(F.size(found), F.lit(0))), lambda x, end: F.struct(x["label"], F.substring(text, x["start"] + x["size"], end - x["start"] - x["size"]))))


def sample_no(text: Column) -> Column:
    """The number after the first label, null without one."""
    return F.nullif(F.regexp_extract(text, SAMPLE_NO, 1), F.lit(""))


def within_window(samples: DataFrame, gap: int = 2) -> DataFrame:
    """Samples of ``patient_id, seq, date`` (and more) with dates outside the patient's window gone and ``date_suspect`` set.

    ``human_verified`` samples, where there is such a column, keep their dates.
    """
    w = date_window(samples.filter("date is not null"), gap)
    sure = F.coalesce(F.col("human_verified"), F.lit(False)) if "human_verified" in samples.columns else F.lit(False)
    out = ~sure & F.coalesce((F.col("date") < F.col("first_date")) | (F.col("date") > F.col("last_date")), F.lit(False))
    j = samples.join(w, "patient_id", "left").withColumn("date_suspect", out)
    return j.select(*[F.when(~F.col("date_suspect"), F.col("date")).alias("date") if c == "date" else F.col(c) for c in samples.columns], "date_suspect")


def override(bands: DataFrame, by_hand: DataFrame, fields: list[str]) -> DataFrame:
    """Bands with the fields that a person corrected."""
    o = by_hand.select("page", *[F.col(f).alias(f"o_{f}") for f in fields], F.lit(True).alias("verified"))
    j = bands.join(o, "page", "left")
    return j.select(*[F.coalesce(f"o_{c}", c).alias(c) if c in fields else F.col(c) for c in bands.columns], F.coalesce("verified", F.lit(False)).alias("verified"))


def date_window(samples: DataFrame, gap: int = 2) -> DataFrame:
    """First and last day of the contiguous days around the median day of the most frequent month.

    Of equally frequent months the one seen first counts.  Per ``patient_id``.
    """
    months = samples.groupBy("patient_id", F.trunc("date", "month").alias("month")).agg(F.count("*").alias("n"), F.min("seq").alias("s"))
    top = months.groupBy("patient_id").agg(F.max_by("month", F.struct("n", (-F.col("s")).alias("s"))).alias("month"))
    days = samples.join(top, "patient_id").filter(F.trunc("date", "month") == F.col("month")).select("patient_id", "date").distinct()
    w = Window.partitionBy("patient_id").orderBy("date")
    d = days.withColumns({"at": F.row_number().over(w) - 1, "many": F.count("*").over(Window.partitionBy("patient_id")), "cut": F.when(F.datediff("date", F.lag("date").over(w)) > gap, 1).otherwise(0)})
    d = d.withColumn("island", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    middle = F.max(F.when(F.col("at") == F.floor(F.col("many") / 2), F.col("island"))).over(Window.partitionBy("patient_id"))
    return d.withColumn("mid", middle).filter("island = mid").groupBy("patient_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def repair_aliquots(samples: DataFrame) -> DataFrame:
    """Undated samples take the date of the first trusted sample with the same stem of the id."""
    stem = id_stem(F.col("sample_id"))
    s = samples.withColumn("stem", stem)
    trusted = s.filter("collected is not null and stem is not null").groupBy("stem").agg(F.min_by("collected", "seq").alias("found"))
    return s.join(trusted, "stem", "left").select("seq", "sample_id", F.coalesce("collected", "found").alias("collected"), (F.col("collected").isNull() & F.col("found").isNotNull()).alias("repaired"))
