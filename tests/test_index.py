"""The lasting index against scores over the chunks themselves."""

import random
import re

import pytest

from tidemark.plans import index as I
from tidemark.plans import retrieval as R

WORDS = [f"word{k}" for k in range(60)]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(1)
    rows = [(str(i), " ".join(rng.choice(WORDS[: 5 + i % 55]) for _ in range(rng.randrange(0, 40)))) for i in range(300)] + [("none", None), ("empty", "")]
    return spark.createDataFrame(rows, "id string, text string")


def test_same_scores(spark, chunks, tmp_path, monkeypatch):
    made = I.write(chunks, f"file://{tmp_path}/index", parts=5)
    again = I.read(spark, f"file://{tmp_path}/index")
    q = spark.createDataFrame([(1, "word3", 1.0), (1, "word50", 0.6), (2, "word1", 1.0), (2, "nothing", 1.0)], "qid int, term string, weight double")
    want = sorted(map(tuple, R.bm25_scores(chunks, q).collect()))
    assert want and sorted(map(tuple, I.scores(made, q).collect())) == want == sorted(map(tuple, I.scores(again, q).collect()))
    monkeypatch.setattr(R, "BROADCAST_TERMS", 1)
    assert sorted(map(tuple, I.scores(again, q).collect())) == want
    assert made.sizes.first()["n"] == 302 and again.terms.filter("term = 'word3'").first()["df"] == chunks.filter("text rlike '\\\\bword3\\\\b'").count()


def test_reads_only_its_parts(spark, chunks, tmp_path):
    made = I.write(chunks, f"file://{tmp_path}/index", parts=8)
    q = spark.createDataFrame([(1, "word3", 1.0)], "qid int, term string, weight double")
    plan = I.scores(made, q)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan) and re.search(r"PushedFilters: \[[^\]]*term", plan)


def test_empty(spark, chunks, tmp_path):
    made = I.write(chunks.limit(0), f"file://{tmp_path}/index")
    q = spark.createDataFrame([(1, "word3", 1.0)], "qid int, term string, weight double")
    assert I.scores(made, q).count() == 0
