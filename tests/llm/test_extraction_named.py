"""Named parts beside and inside articles, whatever their lengths."""

import random

import pytest

from tidemark.llm.extraction import main_text

LONG = "This is a sentence of the article, with commas, and it goes on for a while so that it scores well. " * 4
SHORT = "A short article, no more than a line."
MUCH = f"<p>{LONG}</p>" * 5


@pytest.mark.parametrize(
    "part",
    [
        f"<div class='cookie-notice'>{MUCH}</div>",
        f"<form><input name=mail>{MUCH}</form>",
        f"<div class=newsletter>{MUCH}</div>",
        f"<div class=sidebar>{MUCH}</div>",
        f"<div class='social-links'>{MUCH}</div>",
        f"<article class=comment>{MUCH}</article>",
        f"<article class='comment-body' id='div-comment-5'>{MUCH}</article>",
        f"<article class='related-post'>{MUCH}</article>",
        f"<div itemprop='comment'>{MUCH}</div>",
        f"<aside>{MUCH}</aside>",
    ],
)
def test_longer_named_part_goes(part):
    for page in (f"<article><p>{SHORT}</p></article>{part}", f"{part}<article><p>{SHORT}</p></article>", f"<div><p>{SHORT}</p></div>{part}", f"<article><p>{SHORT}</p>{part}</article>", f"<main><p>{SHORT}</p></main>{part}"):
        assert main_text(page) == SHORT


@pytest.mark.parametrize("tag", ["article", "main"])
def test_one_word_of_a_name_is_not_enough_inside(tag):
    inner = "<p class='share-price'>The price rose to 5.</p><section class='popup-shops'><p>They opened.</p></section><div id='related-work'>Work.</div><p class='ad-free'>None.</p>"
    got = main_text(f"<{tag}><p>{LONG}</p>{inner}</{tag}>")
    assert got == "\n\n".join([LONG.strip(), "The price rose to 5.", "They opened.", "Work.", "None."])
    links = "<div class='share-facebook'><a href=x>Share</a> <a href=y>Tweet</a></div><div class='related-stories'>More of them</div><div class='share-this'>Share it.</div>"
    assert main_text(f"<{tag}><p>{LONG}</p>{links}</{tag}>") == LONG.strip()


def test_layout_names_of_articles():
    for name in ("post sidebar-left category-notices tag-social", "has-comments", "entry banner-image"):
        assert main_text(f"<div>Home</div><article class='{name}'><p>{LONG}</p></article>") == LONG.strip()
    assert main_text(f"<div class='sidebar-right'><article><h1>Title</h1><p>{LONG}</p></article></div><p>Tail</p>") == f"Title\n\n{LONG.strip()}"


def test_short_parts_between_kept_ones():
    page = f"<body><section><p>{LONG}</p></section><div><p>Short.</p></div><div><a href=x>Next page of all pages</a></div><section><p>{LONG}</p></section><div>Off.</div></body>"
    assert main_text(page) == f"{LONG.strip()}\n\nShort.\n\n{LONG.strip()}"


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class=notice>Short text.</div>", "Short text."),
        ("<nav><a href=x>Home</a></nav><div class=widget><p>Only this.</p></div>", "Only this."),
        (f"<form><p>{SHORT}</p></form><div class=sidebar><p>Less.</p></div><footer><p>{LONG}</p></footer>", SHORT),
        ("<div class='cookie-banner'>We use cookies, you know.</div><nav>menu</nav>", ""),
        ("<nav><ul><li><a href=x>One link of the menu, and a long one</a></ul></nav>", ""),
        (f"<form id=f><div class=menu>Menu</div><p>{SHORT}</p></form>", SHORT),
        (f"<h1>Site</h1><form><nav>Menu</nav><p>{LONG}</p><footer>Foot</footer></form>", f"Site\n\n{LONG.strip()}"),
        (f"<footer><p>{LONG}</p></footer>", LONG.strip()),
    ],
)
def test_nothing_else_left(page, text):
    assert main_text(page) == text


def plain_page(rng):
    """A page of parts, each kept or dropped by its name, and the text that stays."""
    kept, parts = [], []
    for i in range(rng.randrange(2, 9)):
        text = f"Part {i} of it. " + "And some more, then. " * rng.randrange(0, 30)
        name = rng.choice([None, None, "text", "story-body", "comment", "newsletter", "cookie-notice", "sidebar", "related", "promo"])
        parts.append(f"<div{f' class={name!r}' if name else ''}><p>{text}</p></div>")
        if name in (None, "text", "story-body"):
            kept.append(text.strip())
    return parts, kept


@pytest.mark.parametrize("seed", range(80))
def test_named_parts_against_plain(seed):
    rng = random.Random(seed)
    parts, kept = plain_page(rng)
    tag = rng.choice(["article", "main"])
    got = main_text(f"<body><div>Home</div><{tag}><p>First.</p>{''.join(parts)}</{tag}><p>Last</p></body>")
    assert got == "\n\n".join(["First.", *kept])
