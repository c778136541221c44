"""Training on long words."""

import pytest

from tidemark.llm import language, queries


def test_long_words_train():
    pieces = language.Pieces(queries.piece_model())
    word = "donaudampfschifffahrtsgesellschaftskapitaen"
    assert len(word) > language.CACHE_CHARS
    learned, nothing = language.learn(pieces, {word * 100: 5}), language.learn(pieces, {})
    assert max(learned) > 10 * max(nothing)


def test_scaled_passes_agree(monkeypatch):
    pieces = language.Pieces(queries.piece_model())
    counts = {"internationally": 3, "haus": 2, "q一z": 1, "schifffahrt": 4}
    want = language.learn(pieces, counts)
    monkeypatch.setattr(language, "CACHE_CHARS", 2)
    assert language.learn(pieces, counts) == pytest.approx(want, rel=1e-9)
