"""Learning from toxic and unlabelled texts: the risk, its slope, the sample, odd rows and held-out texts."""

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import queries, toxicity
from tidemark.llm.common import table


def plain_counts(text):
    out = {}
    import re

    for w in re.findall(r"\w+", (text or "").lower()):
        for f in {zlib.crc32(n.encode()) >> 14 for n in [f"={w}"] + [f"^{w[:k]}" for k in range(3, 8) if k < len(w)]}:
            out[f] = out.get(f, 0) + 1
    return out


def test_counts():
    known = toxicity.Known()
    for text in [None, "", "One one two", "É " * 5 + "longer wordings " * 3, "x" * 500 + " y", "a_b-c 9"]:
        assert known.counts(text) == plain_counts(text)
    kept = sorted(plain_counts("one two"))
    some = toxicity.Known(kept)
    assert {kept[k]: n for k, n in some.counts("one two one three").items()} == {f: n for f, n in plain_counts("one two one three").items() if f in kept}


def sparse(rows):
    return toxicity.Texts([[k for k, v in enumerate(r) if v] for r in rows], [[v for v in r if v] for r in rows])


def plain_risk(w, toxic, rest, prior):
    loss = lambda z: np.log1p(np.exp(-z))
    g, h = toxic @ w[:-1] + w[-1], rest @ w[:-1] + w[-1]
    return prior * loss(g).mean(), loss(-h).mean() - prior * loss(-g).mean()


def test_risk_and_slope():
    rng = np.random.default_rng(1)
    toxic, rest = rng.integers(0, 3, (7, 5)).astype(float), rng.integers(0, 3, (11, 5)).astype(float)
    w, prior = rng.normal(size=6), 0.3
    a, b = sparse(toxic), sparse(rest)
    assert np.allclose(a.scores(w[:-1], w[-1]), toxic @ w[:-1] + w[-1])
    assert np.allclose(toxicity.risk(a.scores(w[:-1], w[-1]), b.scores(w[:-1], w[-1]), prior), plain_risk(w, toxic, rest, prior))
    by = rng.normal(size=7)
    assert np.allclose(a.pull(by, 5), toxic.T @ by)


def plain_fit(toxic, rest, prior, steps):
    """The same steps with slopes by differences of the plain risk."""
    size = toxic.shape[1]
    w = np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, s, path = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        up = plain_risk(w, toxic, rest, prior)[1] >= 0

        def objective(x, up=up):
            p, c = plain_risk(x, toxic, rest, prior)
            return p + c if up else -c

        slope = np.array([(objective(w + 1e-6 * e) - objective(w - 1e-6 * e)) / 2e-6 for e in np.eye(size + 1)])
        slope[:-1] += toxicity.RIDGE * w[:-1]
        m, s = 0.9 * m + 0.1 * slope, 0.999 * s + 0.001 * slope * slope
        w = w - toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        path += w if 2 * step > steps else 0
    return path / (steps - steps // 2)


@pytest.mark.parametrize("prior", [0.2, 0.5])
def test_fit_against_plain_steps(prior):
    rng = np.random.default_rng(3)
    toxic = np.c_[rng.integers(1, 3, 12), rng.integers(0, 2, (12, 2))].astype(float)
    rest = np.c_[rng.integers(0, 2, 20) * (rng.random(20) < 0.3), rng.integers(0, 2, (20, 2))].astype(float)
    got = toxicity.fit(sparse(toxic), sparse(rest), 3, prior, 60)
    assert np.allclose(got, plain_fit(toxic, rest, prior, 60), atol=2e-3)


def test_clean_risk_stays_at_zero():
    """Without the switch the estimated risk of clean texts would fall far below zero."""
    rng = np.random.default_rng(2)
    a, b = sparse(rng.integers(0, 2, (20, 60)).astype(float)), sparse(rng.integers(0, 2, (40, 60)).astype(float))
    w = toxicity.fit(a, b, 60, 0.3)
    assert toxicity.risk(a.scores(w[:-1], w[-1]), b.scores(w[:-1], w[-1]), 0.3)[1] > -0.3


def made(spark, n=1500, seed=1):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.15
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        for _ in range(4 if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["vileness", "vilely", "rotten"]))
        rows.append((i, " ".join(text)))
        if rng.random() < 0.5:
            labels.append((i, int(bad)))
    return rows, labels, spark


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_held_out_texts_and_odd_rows(spark):
    rows, labels, _ = made(spark)
    truth = {i: any(w in t for w in ("vile", "rotten")) for i, t in rows}
    odd = [(5000, None), (5001, ""), (None, "vilely vilely rotten vileness"), (5002, "plain " * 60_000), (5003, "vilely, rotten! " * 40_000), rows[9], rows[9]]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1 as score", "2 as member", "'a' as toxic", "3 as tm_id")
    marks = spark.createDataFrame([*labels, *labels[:5], (None, 1), (99_999, 1), (5001, None), (3, 7)], "doc_id long, toxic int").selectExpr("*", "1 as text")
    got = toxicity.score(docs, marks).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.predicted for r in got}
    known = [i for i in truth if held(i)]
    assert sum(by[i] == truth[i] for i in known) > 0.97 * len(known)
    assert by[5000] == by[5001] == by[5002] == 0 and by[5003] == by[None] == 1
    again = toxicity.score(docs.repartition(7), marks).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in again) == sorted((str(r.doc_id), round(r.score, 9)) for r in got)


def test_held_out_labels_are_not_looked_at(spark):
    rows, labels, _ = made(spark, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = lambda x: spark.createDataFrame(x, "doc_id long, toxic int")
    one = toxicity.score(docs, marks(labels)).collect()
    other = toxicity.score(docs, marks([(i, 1 - t if held(i) else t) for i, t in labels])).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, marks).collect()] == [0.0, 0.0]
    assert toxicity.score(docs, marks.limit(0)).count() == 2 and toxicity.score(docs.limit(0), marks).count() == 0


def test_sample_is_bounded_and_counts_an_id_once(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'t' as text")
    docs = docs.unionByName(spark.range(2000).selectExpr("6L as doc_id", "'t' as text"))
    known = toxicity.confirmed(spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic"))
    got = toxicity.training_texts(docs, known, members=2, positives=30, unlabelled=70).collect()
    assert len(got) == len({(r.tm_id, r.toxic) for r in got}) and not any(held(r.tm_id) for r in got)
    for member in (0, 1):
        for toxic, most in ((True, 30), (False, 70)):
            n = sum(r.member == member and r.toxic == toxic for r in got)
            assert 0.8 * most <= n <= most


def test_whole_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op12_toxicity(spark, sf).collect()}
    labels = [r for r in table(spark, sf, "labels").collect() if r.doc_id in got and held(r.doc_id)]
    bad = [got[r.doc_id].predicted for r in labels if r.toxic == 1]
    clean = [got[r.doc_id].predicted for r in labels if r.toxic == 0]
    assert len(got) == table(spark, sf, "documents").count() and sum(bad) >= 0.6 * len(bad) and sum(clean) <= 0.02 * len(clean)
