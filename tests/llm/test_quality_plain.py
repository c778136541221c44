"""Cutoffs and verdicts against plain binomial sums and plain loops."""

import math
import random
from collections import Counter

from tidemark.llm import quality

KINDS = "doc_id long, text string, lang string, source string"


def at_most(x, n, p):
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1))


def plain_cutoffs(rows, labels):
    """{stratum: cutoff} of (doc_id, lang, base_failed, badness) rows and (doc_id, quality) labels."""
    good = {}
    for i, q in labels:
        if i is not None and q in (0, 1):
            good[i] = max(q, good.get(i, 0))
    worst = {}
    for i, lang, failed, bad in rows:
        if not failed and i in good:
            worst[i, lang] = max(bad, worst.get((i, lang), bad))
    strata = {lang for _, lang in worst}
    out = {}
    for s in strata:
        fine = [b for (i, lang), b in worst.items() if lang == s and good[i]]
        poor = [b for (i, lang), b in worst.items() if lang == s and not good[i]]
        best, out[s] = 0.0, None
        for cutoff in quality.CUTOFFS:
            lost, caught = sum(b > cutoff for b in fine), sum(b > cutoff for b in poor)
            if not fine or at_most(lost, len(fine), quality.ALLOWED) > quality.RISK / len(strata):
                break
            gain = caught / max(1, len(poor)) - lost / len(fine)
            if gain > best + 1e-12:
                best, out[s] = gain, cutoff
    return out


def made(rng, n):
    rows, labels = [], []
    for i in range(n):
        poor = rng.random() < 0.3
        words = [rng.choice(["one", "Two", "three!" if poor else "three", "#x" if poor and rng.random() < 0.7 else "four", "five"]) + str(rng.randrange(60)) for _ in range(rng.randrange(30, 200))]
        rows.append((i, " ".join(words), rng.choice(["en", "en", "en", "de", None]), "s"))
        if rng.random() < 0.8:
            labels.append((i, int(not poor)))
    return rows, labels


def test_binomial_sums():
    for n in (1, 7, 120, 700):
        for x in {0, 1, n // 50, n // 2, n}:
            assert math.isclose(quality.binomial_at_most(x, n, 0.01), at_most(x, n, 0.01), rel_tol=1e-9)


def test_cutoffs_and_verdicts(spark):
    rng = random.Random(6)
    rows, labels = made(rng, 2500)
    odd = [(rows[3][0], rows[4][1], "en", "s"), rows[5], (9001, None, "en", "s"), (None, rows[0][1], "en", "s"), (9002, "", None, "s")]
    docs = spark.createDataFrame(rows + odd, KINDS)
    marks = spark.createDataFrame([*labels, labels[0], (labels[1][0], 1 - labels[1][1]), (None, 1), (99_999, 0), (5, None), (6, 7)], "doc_id long, quality int").selectExpr("*", "0 as toxic")
    rates = quality.measured(docs)
    plain = [(r.doc_id, r.lang, r.base_failed, r.badness) for r in rates.collect()]
    want = plain_cutoffs(plain, [tuple(r)[:2] for r in marks.collect()])
    assert quality.fit(rates, marks) == want and any(c is not None for c in want.values())
    kept = lambda lang, failed, bad: not failed and (want.get(lang) is None or bad <= want[lang])
    verdicts = Counter((i, kept(lang, failed, bad)) for i, lang, failed, bad in plain)
    assert Counter((r.doc_id, r.kept) for r in quality.quality_report(docs, marks).collect()) == verdicts
    assert Counter(r.doc_id for r in quality.keep_good(docs, marks).collect()) == Counter(i for (i, k), n in verdicts.items() if k for _ in range(n))
