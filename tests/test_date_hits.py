"""Chunks that match a question by date alone."""

from tidemark.plans import retrieval


def test_date_only_hits_join_the_keyword_hits(spark):
    hits = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0)], "qid int, id string, score double")
    days = spark.createDataFrame([("a", 5, "day"), ("c", 5, "day"), ("d", 5, "score"), ("b", 6, "day"), ("c", 5, "day")], "id string, day int, kind string")
    asked = spark.createDataFrame([(1, 5)], "qid int, day int")
    got = {(r.qid, r.id): r.score for r in retrieval.date_hits(hits, days, asked).collect()}
    assert got == {(1, "a"): 7.0, (1, "b"): 1.0, (1, "c"): 3.0, (1, "d"): 2.0}
    assert retrieval.date_hits(hits.limit(0), days, asked).count() == 3


def test_bm25_with_many_terms_is_the_same(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 9))) for i in range(60)], "id int, text string")
    queries = spark.createDataFrame([(q, f"w{(q * 3 + k) % 17}", 1.0) for q in range(5) for k in range(2)], "qid int, term string, weight double")
    small = sorted(map(tuple, retrieval.bm25(chunks, queries).collect()))
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, retrieval.bm25(chunks, queries).collect())) == small and small
