"""Vectors of single precision, and products beyond the largest double."""

import math

from pyspark.sql import functions as F

from tidemark.llm import neighbours


def test_products_beyond_the_largest_double(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 0.0]), (2, [-1e200, 3.0]), (3, [1.0, 1.0]), (4, [1e200, -1e300]), (20, [1e200, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 5).collect()}
    assert len(got) == 10
    inf = math.inf
    assert [got[0, k] for k in range(1, 6)] == [(1, inf), (4, inf), (20, inf), (3, 1e200 + 1.0), (2, -inf)]
    assert [got[20, k] for k in range(1, 6)] == [(0, inf), (1, inf), (3, 2e200), (2, -inf), (4, -inf)]


def test_single_precision_travels_as_it_is(spark):
    df = spark.createDataFrame([(0, [0.1, 0.2]), (1, [0.3, 0.7])], "vec_id long, embedding array<float>")
    assert dict(neighbours.usable(df, "vec_id", "embedding").dtypes)["v"] == "array<float>"
    one = df.filter("vec_id = 0").first().embedding, df.filter("vec_id = 1").first().embedding
    assert neighbours.nearest(df, F.col("vec_id") == 0, 5).first().score == one[0][0] * one[1][0] + one[0][1] * one[1][1]
