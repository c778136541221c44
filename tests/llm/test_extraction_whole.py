"""Sections, closing parts and further articles that belong to the text."""

from tidemark.llm.extraction import main_text

LONG = "This is a sentence of the article, with commas, and it goes on for a while so that it scores well. " * 4


def test_subjects_named_like_boilerplate():
    page = f"<article><p>{LONG}</p><section id='related-work'><p>{LONG}related end.</p></section><div id='social-effects'><p>{LONG}social end.</p></div><div class='related'><p>{LONG}list</p></div><div class='comment-list'><p>{LONG}reader</p></div><div id='share-this'>Share it.</div></article>"
    got = main_text(page)
    assert "related end." in got and "social end." in got
    assert "list" not in got and "reader" not in got and "Share it." not in got


def test_short_closing_sibling():
    close = "In the end it was all for the best, and nobody was harmed by any of the things that were told here."
    got = main_text(f"<body><div><div>{f'<p>{LONG}</p>' * 12}</div><section><span>{close}</span></section><div><a href='x'>More stories that you may like to read on this page, today.</a></div></div></body>")
    assert close in got and "More stories" not in got


def test_several_articles():
    got = main_text(f"<body><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}first.</p></article><article><p>{LONG}second.</p></article></body>")
    assert "first." in got and "second." in got
