"""Near copies among very many repeated rows."""

from pyspark.sql import functions as F

from tidemark.llm import copies
from tidemark.llm.common import cut


def repeated(spark, n):
    words = " ".join(f"w{k}" for k in range(60))
    hot = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit(words).alias("text"))
    near = spark.createDataFrame([(None, words + " end"), (7, words.replace("w59", "other")), (8, "something else of a few words")], "doc_id long, text string")
    return hot.unionByName(near).repartition(8)


def test_repeated_rows_without_ids(spark):
    n = 100_000
    docs = repeated(spark, n)
    got = copies.near_copies(docs).groupBy("doc_id", "class_id", "n_links", "exact_id", "n_copies").count().collect()
    found = {tuple(r) for r in got}
    assert found == {(None, 7, n + 1, None, n, n), (None, 7, n + 1, None, 1, 1), (7, 7, n + 1, 7, 1, 1), (8, 8, 0, 8, 1, 1)}
    assert {r.doc_id for r in copies.keep_one(docs).collect()} == {7, 8}


def test_one_text_of_a_class_is_sent(spark):
    docs = repeated(spark, 3000)
    keys = cut(copies.keyed(docs, copies.runs_for()), "test")
    pick = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "mark")
    known = keys.groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min(pick).alias("pick")).withColumn("buckets", F.array(F.lit(1)))
    rows = copies.with_texts(docs, known).collect()
    assert len(rows) == 4 and sorted(r.copies for r in rows) == [1, 1, 1, 3000]
