"""Learning and scoring of languages against sums over all segmentations, written out."""

import math
import random

import pytest

from tidemark.llm import language
from tidemark.llm.queries import piece_model


@pytest.fixture(scope="module")
def pieces():
    return language.Pieces(piece_model())


def segmentations(pieces, word):
    """All ways to cut a word, as lists of piece numbers; -1 is a character that no piece holds alone."""
    place = {n: k for k, n in enumerate(pieces.names)}
    text = language.MARK + word

    def cuts(at):
        if at == len(text):
            yield []
        for end in range(at + 1, len(text) + 1):
            k = place.get(text[at:end], -1 if end == at + 1 else None)
            if k is not None:
                for rest in cuts(end):
                    yield [k, *rest]

    return list(cuts(0))


def probability(p, cut):
    return math.prod(language.UNKNOWN if k < 0 else p[k] for k in cut)


def plain_learn(pieces, counts, rounds):
    n = len(pieces.names)
    cuts = {w: segmentations(pieces, w) for w in counts}
    seen = [0.0] * n
    text = {w: language.MARK + w for w in counts}
    for w, c in counts.items():
        for k, name in enumerate(pieces.names):
            at = text[w].find(name)
            while at >= 0:
                seen[k] += c * len(name)
                at = text[w].find(name, at + 1)
    for _ in range(rounds):
        total = sum(seen) + language.SMOOTH * n
        p = [(x + language.SMOOTH) / total for x in seen]
        seen = [0.0] * n
        for w, c in counts.items():
            weights = [probability(p, cut) for cut in cuts[w]]
            for cut, x in zip(cuts[w], weights):
                for k in cut:
                    if k >= 0:
                        seen[k] += c * x / sum(weights)
    total = sum(seen) + language.SMOOTH * n
    return [(x + language.SMOOTH) / total for x in seen]


@pytest.mark.parametrize("rounds", [1, 3])
def test_learning_against_all_segmentations(pieces, rounds):
    counts = {"the": 5, "there": 2, "über": 3, "a": 1, "漢字": 1, "ing": 4, "strange": 1}
    got, want = language.learn(pieces, counts, rounds), plain_learn(pieces, counts, rounds)
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-12 and abs(sum(got) - 1) < 1e-9


def test_posteriors_against_all_segmentations(pieces):
    rng = random.Random(3)
    langs = {"de": {"der": 5, "und": 4, "über": 2}, "en": {"the": 6, "and": 4, "over": 2}, "fr": {"les": 5, "et": 4, "sur": 2}}
    tables = [language.learn(pieces, c) for c in langs.values()]
    scorer = language.Scorer(piece_model(), list(langs), tables)
    words = ["the", "und", "les", "over", "漢", "ing", "éa"]
    for _ in range(20):
        found = [rng.choice(words) for _ in range(rng.randrange(1, 6))]
        logs = [sum(math.log(sum(probability(p, cut) for cut in segmentations(pieces, w))) for w in found) for p in tables]
        best = max(range(3), key=lambda k: logs[k])
        lang, score = scorer.text(" ".join(found) + " 12 !")
        assert lang == list(langs)[best] and math.isclose(score, 1 / sum(math.exp(x - logs[best]) for x in logs), rel_tol=1e-9)


def test_training_in_tasks_is_learning(spark, pieces):
    docs = spark.createDataFrame([(i, "the over and" if i % 2 else "der und über", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    langs, tables = language.train(docs, piece_model())
    counts: dict = {}
    for r in language.training_counts(docs).collect():
        counts.setdefault(r.lang, {})[r.word] = r.n
    assert langs == ["de", "en"]
    for lang, table in zip(langs, tables):
        assert table == language.learn(pieces, dict(sorted(counts[lang].items())))
    assert language.train(docs.limit(0), piece_model()) == ([], [])
