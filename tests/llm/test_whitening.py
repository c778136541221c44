"""Whitening against numpy over the same rows."""

import math
from collections import Counter

import numpy as np

from tidemark.llm import queries, whitening
from tidemark.llm.common import table

KIND = "vec_id long, embedding array<float>"


def check(rows, got, most=8):
    """Compare with a decomposition of the whole matrix."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in good], dtype=object)
    n = len(good)
    total = x.sum(axis=0)
    gap = n * x - total
    deviation = [int(sum(g * g for g in row)) for row in gap]
    centred = (x.astype(float) - np.array([int(s) / n for s in total]))
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    order = [k for k in range(len(v) - 1, -1, -1) if values[k] > 1e-12 * np.trace(v)][:most]
    want = {}
    for k, at in enumerate(order):
        want[k + 1] = (centred @ vectors[:, at] / math.sqrt(values[at]), values[at] / np.trace(v))
    assert len(got) == n * len(order)
    assert Counter((r.vec_id, r.component, r.deviation) for r in got) == Counter((i, k, d) for (i, _), d in zip(good, deviation) for k in want)
    for k, (white, share) in want.items():
        mine = sorted((r.vec_id is not None, r.vec_id or 0, r.whitened) for r in got if r.component == k)
        a = np.array([m[2] for m in mine])
        options = []
        for sign in (1, -1):
            theirs = sorted((i is not None, i or 0, sign * w) for (i, _), w in zip(good, white))
            options.append(np.abs(a - np.array([t[2] for t in theirs])).max())
        assert min(options) < 1e-6
        assert all(math.isclose(r.explained, share, rel_tol=1e-9) for r in got if r.component == k)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(rng.normal(size=(300, 12)) * np.linspace(0.1, 2, 12))]
    rows += [(None, rows[3][1]), rows[5], rows[5], (900, None), (901, []), (902, [1.0, None] * 6), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as n", "2 as x", "'a' as component", "0 as c0").repartition(3)
    check(rows, whitening.whiten(df).collect())
    pieces = whitening.whiten(df.filter("vec_id < 200")).collect()
    assert whitening.AT_ONCE > 78
    whole, n = whitening.whole(df, "vec_id", "embedding"), 303
    middle = whitening.centred(whole, [s / n for s in whitening.sums(whole, 12)[3]])
    assert np.array_equal(whitening.covariance(middle.coalesce(1), n, 12, 7), whitening.covariance(middle.coalesce(1), n, 12)) and pieces


def test_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, KIND)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0])] * 3)).count() == 0  # no variance
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)]
    got = whitening.whiten(frame(line)).collect()
    assert {r.component for r in got} == {1} and all(math.isclose(r.explained, 1) for r in got)
    check(line, got)
    two = [(i, [float(i), float(i * i % 7)]) for i in range(20)]
    other = whitening.whiten(frame(two + [(50, [1.0]), (51, [1.0, 2.0, 3.0])])).collect()
    check(two, other)
    assert whitening.whiten(frame([(1, [1e30, 1.0]), *two])).select("n").distinct().collect()[0][0] == 20


def test_large_entries_give_no_wrong_deviation(spark):
    rows = [(i, [float(2**40 * (-1) ** i), float(i)]) for i in range(30)]
    got = whitening.whiten(spark.createDataFrame(rows, KIND)).collect()
    assert got and all(r.deviation is None for r in got)
    small = [(i, [float(2**15 * (-1) ** i), float(i), float(i * i % 5), float(i % 3)]) for i in range(30)]
    assert not whitening.fits(30, -(2**25), 2**25, 4)
    check(small, whitening.whiten(spark.createDataFrame(small, KIND)).collect())


def test_whole_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    check(rows, queries.op13_whitening(spark, sf_dir).collect())
