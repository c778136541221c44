"""The extraction against plain versions, on the given pages and on made ones."""

import html
import random
import re
import time
from html.parser import HTMLParser

import duckdb
import pytest

from tidemark.llm import extraction
from tidemark.llm.extraction import main_text

LONG = "This is a sentence of the article, with commas, and it goes on for a while so that it scores well. " * 4
BLOCK = "address|article|aside|blockquote|body|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text).strip(" ")


def article_of(page):
    """The text of a page's one article element by patterns alone."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    body = re.sub(r"<!--.*?-->|<(script|style)\b.*?</\1>", "", body, flags=re.S)
    body = re.sub(rf"</?(?:{BLOCK})\b[^>]*>", "\x00", body)
    body = re.sub(r"<br\b[^>]*>", " ", body)
    body = re.sub(r"<[^>]*>", "", body)
    return "\n\n".join(filter(None, (squeezed(html.unescape(x)) for x in body.split("\x00"))))


def test_given_pages_whole():
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html LIKE '%<article>%</article>%'").fetchall()
    assert len(rows) > 100
    for (page,) in rows:
        assert main_text(page) == article_of(page)


class Plain(HTMLParser):
    """Nested lists of [tag, kids] of a well-formed page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = ["html", []]
        self.open = [self.top]

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.open[-1][1].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][1].append(data)


def is_block(node):
    return isinstance(node, list) and re.fullmatch(BLOCK, node[0]) is not None


def chars(node, linked=False):
    """Characters of a part, or those inside links only, by full recursion."""
    if isinstance(node, str):
        return 0 if linked else len(squeezed(node))
    return sum(chars(k, linked and node[0] != "a") for k in node[1])


def inline(node):
    out = []
    for k in node[1]:
        if isinstance(k, str):
            out += [squeezed(k)] if squeezed(k) else []
        elif not is_block(k):
            out += inline(k)
    return out


def density(node):
    return chars(node, True) / max(1, chars(node))


def plain_points(node):
    """Points by summing over all paragraphs below, with their distance."""
    total = 0.0

    def paragraph(k):
        text = " ".join(inline(k))
        if k[0] not in ("p", "pre", "td", "blockquote", "li", "dd", "div", "section", "article", "main", "body") or len(text) < 25:
            return 0.0
        return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - density(k))

    def walk(k, level):
        nonlocal total
        passes = level + (0 if k[0] in ("div", "section", "article", "main", "body") else -1)
        if passes >= 0 and passes < 5:
            total += paragraph(k) / (passes + 1)
        for x in k[1]:
            if isinstance(x, list):
                walk(x, level + 1)

    walk(node, 0)
    return total


def made_page(rng):
    """A well-formed page without names: a body of nested containers and paragraphs."""

    def words(n):
        return " ".join(rng.choice(["alpha", "beta,", "gamma.", "delta &amp; epsilon", "zeta"]) for _ in range(n))

    def paragraph():
        inner = words(rng.randrange(1, 60))
        if rng.random() < 0.3:
            inner += f" <a>{words(rng.randrange(1, 20))}</a>"
        if rng.random() < 0.3:
            inner += f" <b>{words(3)}</b> tail"
        return f"<p>{inner}</p>"

    def part(level):
        kids = "".join(part(level + 1) if level < 3 and rng.random() < 0.4 else paragraph() for _ in range(rng.randrange(1, 5)))
        tag = rng.choice(["div", "section"])
        return f"<{tag}>{kids}</{tag}>"

    return f"<body>{''.join(part(0) for _ in range(rng.randrange(1, 4)))}</body>"


@pytest.mark.parametrize("seed", range(60))
def test_points_and_best_against_plain(seed):
    page = made_page(random.Random(seed))
    reader = Plain()
    reader.feed(page)
    plain, todo = [], [reader.top]
    while todo:
        node = todo.pop()
        plain.append(node)
        todo += [k for k in reversed(node[1]) if isinstance(k, list)]
    root = extraction.parse(page)
    extraction.strip(root)
    order = extraction.score(extraction.prune(root))
    assert [n.tag for n in order] == [n[0] for n in plain]
    for a, b in zip(order, plain):
        assert a.chars == chars(b) and a.linked == chars(b, True)
        assert a.points == pytest.approx(plain_points(b), abs=1e-9)
    best = max(range(len(plain)), key=lambda i: plain_points(plain[i]) * (1 - density(plain[i])))
    assert extraction.final(order[best]) == pytest.approx(max(map(extraction.final, order)), abs=1e-9)


@pytest.mark.parametrize("seed", range(60))
def test_planted_articles(seed):
    """Known articles between boilerplate come out whole, and nothing else does."""
    rng = random.Random(seed)
    article = [f"Part {i} begins, and {'it goes on, with one more clause, ' * rng.randrange(3, 9)}until it ends." for i in range(rng.randrange(3, 12))]
    links = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(8))
    before = [f"<nav><ul>{links}</ul></nav>", f"<div class='site-header'><ul>{links}</ul></div>", "<div class='cookie-banner'>We use cookies. They are good for you, and for us. Do you agree to that?</div>", "<div id='top-menu'>Home</div>"]
    after = ["<footer>&copy; Nobody, all rights reserved, in every country of the world, and elsewhere too.</footer>", "<div id='comments'><p>I liked that, a lot, and I will come again, with friends. Thank you.</p><p>So did I, and more than you.</p></div>", "<form><input><p>Leave a reply, please, and be so kind as to give your name too.</p></form>", f"<aside><p>About us. {LONG}</p></aside>", "<div class='ad'>Buy this.</div>"]
    body = "".join(f"<p>{x}</p>" for x in article)
    wrap = rng.choice(["<article>%s</article>", "<main>%s</main>", "<div>%s</div>", "<div class='wrapper has-sidebar'><div class='text'>%s</div></div>", "<form id='aspnetForm'><div>%s</div></form>", "<div class='widget'>%s</div>", "<div id='comments-policy-post'>%s</div>"])
    page = "".join(rng.sample(before, rng.randrange(5))) + wrap % body + "".join(rng.sample(after, rng.randrange(6)))
    if rng.random() < 0.5:
        page = f"<html><head><title>t</title><script>if (a < b) '<p>'</script></head><body>{page}</body></html>"
    assert main_text(page) == "\n\n".join(article)


@pytest.mark.parametrize("wrap", ["<form id=aspnetForm>%s</form>", "<div class='wrapper has-sidebar'>%s</div>", "<div class='no-sidebar'>%s</div>", "<div id='comments-policy-post'>%s</div>", "<nav>%s", "<head><title>t</title>%s"])
def test_wrappers_are_no_boilerplate(wrap):
    body = f"<p>{LONG}</p>" * 3
    assert main_text(wrap % body) == "\n\n".join([LONG.strip()] * 3)


def test_second_article_and_loose_text():
    two = f"<article><p>{LONG}</p></article><article><p>Short second one.</p></article><article><a href='x'>Only a link</a></article>"
    assert main_text(two) == f"{LONG.strip()}\n\nShort second one."
    loose = f"<body><div>Intro <b>in bold</b> and more.<div><p>{LONG}</p><p>{LONG}</p></div>Loose end.<a href='x'>Next</a><h2>Title</h2></div></body>"
    assert main_text(loose) == f"Intro in bold and more.\n\n{LONG.strip()}\n\n{LONG.strip()}\n\nLoose end.Next\n\nTitle"


def test_time_is_in_proportion_to_the_page():
    for page in ("<i>" * 40_000 + "<li></li>" * 40_000, "<b><div>" + "<i>" * 40_000 + "</b>" * 40_000, "<div class='ad-x'><p>" * 20_000 + LONG, "<div class='related-x'>" * 20_000 + LONG, "<p \"'" * 30_000 + LONG):
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 20


def test_ties_go_to_the_first():
    same = f"<div><p>{LONG}</p></div>"
    assert main_text(f"<body><section>{same}</section><section>{same}</section></body>") == "\n\n".join([LONG.strip()] * 2)
    root = extraction.parse(f"<body>{same}{same}</body>")
    order = extraction.score(root)
    body, first = order[1], order[2]  # half of each of two equal parts is as much as one of them
    assert extraction.final(body) == extraction.final(first) and max(order, key=extraction.final) is body
