"""Main text of web pages by scoring their trees.

The page becomes a tree in one pass (tags may be unclosed or misnested).  Scripts, styles
and other elements without text go at once.  Every paragraph passes points for its length
and its commas to its ancestors, halved and thirded on the way up; a container's points
are discounted by the share of its text inside links.  The best container is kept with
those of its siblings, and of its ancestors' siblings, that score like it or hold running
text, with all between them that isn't mostly links; an enclosing article or main element counts as the
container, and of several articles outside a main element all that aren't mostly links
are kept.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are told
by element, role, and words of class and id, and taken off before anything is scored:

* navigation, footers, asides, dialogs, hidden parts and reader comments always go, and
  so do forms, headers, and parts and articles with any other such name, however long they are;
  they only stay where they are wrappers of the page: a named part that holds a main
  element or an article with a first heading, a form that holds an article, a first heading, or the page's menu, header or footer,
* a name that has other words of its own (``related-work``, ``ad-free``) counts only where
  the part doesn't read like running text, and inside an article only where the part is mostly
  links; ``has-sidebar`` and its like are layout,
* if nothing but links is left of the page, the named part with most text comes back, of any
  length, or else the menu, footer or the like that has most running text; adverts, cookie
  notices and lists of links don't.

Text is put out by blocks: character references decoded, white space turned into one
space, blocks in page order joined by an empty line; nothing else is dropped or capped.
Time and memory are in proportion to the page.

Defined results: null and empty pages, and pages without text, give an empty text; of
containers with equal points the first one counts; repeated rows give repeated results.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, map_rows

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(SPACE_CLASS + "+")
HUMP = re.compile(r"([a-z])([A-Z])")
NAME_PART = re.compile(r"[a-z]+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SENTENCE = re.compile(r"[.!?。]")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: What a head may hold; anything else ends it.
IN_HEAD = set("base link meta noscript script style template title".split())
#: An opening tag ends open elements of the second set, up to an element of the third.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "caption"), ("table",)),
    "option": (("option",), ("select",)),
}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
TABLE_PARTS = set("table tbody thead tfoot tr td th caption".split())
#: Elements without text of the article.
ALWAYS = set("head noscript template svg math canvas button select datalist object audio video map script style textarea title xmp iframe noembed noframes".split())
ASIDE = set("nav footer aside dialog menu".split())
ROLES = set("navigation contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
WEAK_ROLES = set("banner form".split())
#: Words of class or id that mark a part as something other than the article.
COMMENTS = set("comment comments commentlist disqus replies reply respond".split())
NAMES = COMMENTS | set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookies consent footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion related rss share sharing shares sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription toolbar".split())
#: Page builders name parts of articles so, too.
WEAK_NAMES = set("widget widgets".split())
#: Words that say nothing of their own beside those.
NEUTRAL = set("all and by for in it me more my now of on our the this to us with you your area article articles bar block blog body bottom box button buttons container content count form icons inner item items label left link links list main module outer page panel post posts reader readers right section site slot space stories story text thread title top unit user users wrap wrapper zone".split())
#: First words of names that tell of a layout.
STATES = set("no has with without hide".split())
#: What reads like running text has so many characters and less than this share inside links.
RUNNING, DENSITY = 80, 0.25
#: Names of parts that never stand for a page.
NEVER = set("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs consent cookie cookies gdpr menu menus navbar pager pagination skip toolbar".split())
#: Names by which an article element is none of the page's own.
ARTICLE_NAMES = COMMENTS | set("ad ads advert adverts advertisement advertising newsletter promo promoted promotion related sponsor sponsored sponsors".split())
#: Elements of a whole page: a form that holds one is a wrapper.
LANDMARKS = set("main article h1 nav header footer".split())
SAFE = set("html body article main".split())
INLINE_NAMED = set("b i em strong span a".split())
PARAGRAPHS = set("p pre td blockquote li dd div section article main body".split())
LEAST = 25

KEEP, LIKELY, SURE = 0, 1, 2


class Node:
    """An element: ``worth`` is the running text it holds, ``chars`` and ``linked`` its characters, all and inside links."""

    __slots__ = ("tag", "attrs", "parent", "kids", "points", "chars", "linked", "sentence", "worth", "judged", "inside", "holds_main", "holds_page", "titled")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []
        self.points = self.worth = 0.0
        self.chars = self.linked = 0
        self.sentence = self.inside = self.holds_main = self.holds_page = self.titled = False
        self.judged = KEEP


def parse(page: str) -> Node:
    """The tree of a page; kids are nodes and texts with references decoded."""
    root = Node("html", "", None)
    open_nodes = [root]
    places: dict[str, list[int]] = {}  # of each tag's open elements in open_nodes
    block_places: list[int] = []

    def close(down_to: int) -> None:
        while len(open_nodes) > down_to:
            tag = open_nodes.pop().tag
            places[tag].pop()
            if tag in BLOCK:
                block_places.pop()

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def nearest(tags, stops) -> int:
        at = last(tags)
        return at if at > last(stops) else 0

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            text = references.unescape(page[at:start])
            if open_nodes[-1].tag == "head" and not text.isspace():
                close(len(open_nodes) - 1)
            open_nodes[-1].kids.append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            place = last((tag,))
            if place and tag != "body":
                barrier = last(("td", "th", "caption", "table")) if tag not in TABLE_PARTS else 0
                if tag not in BLOCK and block_places:
                    barrier = max(barrier, block_places[-1])
                if barrier <= place:
                    close(place)
            continue
        if tag == "html":
            continue
        if tag not in IN_HEAD and places.get("head"):
            close(places["head"][-1])
        if tag in BLOCK and places.get("p") and (p := nearest(("p",), ("td", "th", "button", "object", "table"))):
            close(p)
        if tag in ENDS and (old := nearest(*ENDS[tag])):
            while old > 1 and open_nodes[old - 1].tag in ENDS[tag][0]:
                old -= 1
            close(old)
        elif tag in HEADINGS and open_nodes[-1].tag in HEADINGS:
            close(len(open_nodes) - 1)
        node = Node(tag, m[3], open_nodes[-1])
        open_nodes[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
            if end and (gt := page.find(">", at)) >= 0:
                at = gt + 1
            elif end:
                at = n
        elif tag not in VOID and (tag in BLOCK or not m[3].rstrip().endswith("/")):
            places.setdefault(tag, []).append(len(open_nodes))
            if tag in BLOCK:
                block_places.append(len(open_nodes))
            open_nodes.append(node)
    return root


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}


def name_of(found: dict[str, str], names: set[str] = NAMES | WEAK_NAMES) -> tuple[int, int, set[str]]:
    """What class and id say: judgements by names alone and by names with words of their own, and all words."""
    alone, with_own, words = KEEP, KEEP, set()
    for token in (found.get("class", "") + " " + found.get("id", "")).split():
        parts = NAME_PART.findall(HUMP.sub(r"\1 \2", token).lower())
        words.update(parts)
        if "side" in parts and "bar" in parts:
            parts = ["sidebar"]
        named = [p for p in parts if p in names]
        if not named or parts[0] in STATES:
            continue
        telling = [p for p in parts if p not in NEUTRAL]
        head = telling[-1]
        if head not in names or head in WEAK_NAMES or named != telling:
            with_own = LIKELY
        else:
            alone = max(alone, SURE if head in COMMENTS and telling == named else LIKELY)
    return alone, with_own, words


def order_of(root: Node) -> list[Node]:
    """All nodes, parents first, in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in reversed(node.kids) if isinstance(k, Node)]
    return order


def strip(root: Node) -> None:
    """Take off elements that never hold text of the article."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.kids = [k for k in node.kids if isinstance(k, str) or k.tag not in ALWAYS]
        stack += [k for k in node.kids if isinstance(k, Node)]


def size(order: list[Node]) -> None:
    """Characters, characters inside links, and whether there is a sentence, for all nodes."""
    for node in reversed(order):
        node.chars = node.linked = 0
        node.sentence = node.holds_main = node.holds_page = node.titled = False
        for k in node.kids:
            if isinstance(k, str):
                node.chars += len(SPACE.sub(" ", k).strip())
                node.sentence = node.sentence or SENTENCE.search(k) is not None
            else:
                node.chars += k.chars
                node.linked += k.linked
                node.sentence = node.sentence or k.sentence
                node.titled = node.titled or k.titled or k.tag == "h1" and k.chars > 0
                node.holds_main = node.holds_main or k.holds_main or k.tag == "main" and k.chars > 0 or k.tag == "article" and k.titled
                node.holds_page = node.holds_page or k.holds_page or k.tag in LANDMARKS and k.chars > 0
        if node.tag == "a":
            node.linked = node.chars


def prose(node: Node) -> bool:
    """Whether a part reads like running text."""
    return node.chars >= RUNNING and node.linked < DENSITY * node.chars and node.sentence


def judge(node: Node) -> int:
    """How sure it is that a part is something other than the article, by what it is called."""
    if node.tag in ASIDE:
        return SURE
    if node.tag == "header":
        return KEEP if node.inside else LIKELY
    judged = LIKELY if node.tag == "form" else KEEP
    found = attributes(node.attrs)
    if not found:
        return judged
    if node.tag not in ("html", "body") and ("hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDING.search(found.get("style", "").lower())):
        return SURE
    role = found.get("role", "").lower()
    if role in ROLES or role in WEAK_ROLES:
        return SURE if role in ROLES else LIKELY
    if "comment" in found.get("itemprop", "").lower().split():
        return SURE
    if node.tag in HEADINGS or node.tag in SAFE and node.tag != "article":
        return judged
    alone, with_own, words = name_of(found, ARTICLE_NAMES) if node.tag == "article" else name_of(found)
    if node.inside and node.tag in INLINE_NAMED and not words & {"ad", "ads", "advert"}:
        return judged
    if with_own and not (share(node) > 0.5 if node.inside else prose(node)):
        alone = max(alone, with_own)
    return max(judged, alone)


def own_text(node: Node) -> str:
    """The text directly in a paragraph, empty where it is too short to count."""
    text = " ".join(inline_text(node)) if node.tag in PARAGRAPHS else ""
    return text if len(text) >= LEAST else ""


def share(node: Node) -> float:
    """The share of a part's text that is not inside links."""
    return 1 - node.linked / max(1, node.chars)


def prune(root: Node) -> Node:
    """Take parts off the tree that are something other than the article; the root of what is left."""
    order = order_of(root)
    size(order)
    for node in order:
        up = node.parent
        node.inside = node.tag in ("article", "main") or up is not None and up.inside
        node.judged = judge(node)
    for node in reversed(order):
        node.worth = len(own_text(node)) * share(node) + sum(k.worth for k in node.kids if isinstance(k, Node) and k.judged != SURE)
    taken: list[Node] = []

    def stays(node: Node) -> bool:
        if node.judged == KEEP or node.judged == LIKELY and (node.holds_main or node.tag == "form" and node.holds_page):
            return True
        taken.append(node)
        return False

    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "header" and node.inside:  # of an article: its headings are the article's
            node.kids = [k for k in node.kids if isinstance(k, Node) and (k.tag in HEADINGS or k.tag in ("hgroup", "div"))]
        node.kids = [k for k in node.kids if isinstance(k, str) or stays(k)]
        stack += [k for k in node.kids if isinstance(k, Node)]
    place = {id(k): i for i, k in enumerate(order)}
    size(order_of(root))
    for level in (LIKELY, SURE):
        if root.chars > root.linked:
            break
        able = [k for k in taken if k.judged == level and (k.worth > 0 if level == SURE else k.chars > k.linked) and not name_of(attributes(k.attrs))[2] & NEVER]
        if able:
            most = max(able, key=lambda k: (k.worth, k.chars - k.linked, -place[id(k)]))
            most.parent = None
            root = without_named(most)
    return root


def without_named(part: Node) -> Node:
    """A part that came back, without the named parts inside it, unless that leaves nothing."""
    order = order_of(part)
    held = {id(node): node.kids for node in order}
    for node in order:
        node.kids = [k for k in node.kids if isinstance(k, str) or k.judged == KEEP]
    size(order_of(part))
    if part.chars == part.linked:
        for node in order:
            node.kids = held[id(node)]
        size(order_of(part))
    return part


def score(root: Node) -> list[Node]:
    """Give all containers their points; all nodes, parents first."""
    order = order_of(root)
    size(order)
    for node in order:
        if not (text := own_text(node)):
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * share(node)
        up, level = node if node.tag in ("div", "section", "article", "main", "body") else node.parent, 1
        while up is not None and level <= 5:
            up.points += points / level
            up, level = up.parent, level + 1
    return order


def inline_text(node: Node) -> list[str]:
    """Texts directly in a block, through inline elements but not in blocks inside it."""
    out, stack = [], list(reversed(node.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            if text := SPACE.sub(" ", k).strip(" "):
                out.append(text)
        elif k.tag not in BLOCK:
            stack += reversed(k.kids)
    return out


def final(node: Node) -> float:
    return node.points * share(node)


def runs(kids: list) -> list[Node]:
    """Blocks of a list of kids, and what lies loose between two blocks as a paragraph."""
    out: list[Node] = []
    loose: Node | None = None
    for k in kids:
        if isinstance(k, Node) and k.tag in BLOCK:
            out.append(k)
            loose = None
            continue
        if loose is None:
            out.append(loose := Node("p", "", None))
        loose.kids.append(k)
        if isinstance(k, str):
            loose.chars += len(SPACE.sub(" ", k).strip())
        else:
            loose.chars += k.chars
            loose.linked += k.linked
    return out


def container(order: list[Node]) -> list[Node]:
    """The parts to keep, in page order."""
    best = max(order, key=final)  # the first of equals
    if best.points <= 0:
        return [next((n for tag in ("article", "main", "body") for n in order if n.tag == tag), order[0])]
    node = best
    while node is not None:
        if node.tag in ("article", "main"):
            best = node
        node = node.parent
    if best.tag == "article":  # all outermost articles of the page
        within: set[int] = set()
        for n in order:  # parents first
            if n.parent is not None and (n.parent.tag == "article" or id(n.parent) in within):
                within.add(id(n))
        return [n for n in order if n is best or n.tag == "article" and id(n) not in within and n.chars > 0 and share(n) > 0.5]
    least = max(10.0, final(best) * 0.2)
    kept, level = [best], 0
    while best.tag not in SAFE and best.parent is not None:
        parts = runs(best.parent.kids)
        own = next(i for i, k in enumerate(parts) if k is best or best in k.kids)
        good = [i for i, k in enumerate(parts) if i == own or final(k) >= least or k.tag in HEADINGS or k.points > 0 and prose(k) or not level and k.tag == "p" and k.chars > 0 and share(k) > 0.5]
        around: list[Node] = []
        for i in range(good[0], good[-1] + 1):
            if i == own:
                around += kept
            elif i in good or parts[i].chars > 0 and share(parts[i]) > 0.5:
                around.append(parts[i])
        kept, best, level = around, best.parent, level + 1
    return kept


def blocks(parts: list[Node]) -> list[str]:
    """Texts of the blocks in page order."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := SPACE.sub(" ", "".join(held)).strip(" "):
            out.append(text)
        held.clear()

    for part in parts:
        stack: list = [part]
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                held.append(k)
            elif k is None:
                flush()
            elif k.tag == "br":
                held.append(" ")
            elif k.tag in BLOCK:
                flush()
                stack.append(None)
                stack += reversed(k.kids)
            else:
                stack += reversed(k.kids)
        flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    strip(root)
    return "\n\n".join(blocks(container(score(prune(root)))))


def extract(pages: DataFrame) -> DataFrame:
    """Rows of ``page_id, url, text, n_chars`` for all pages."""

    def work(frames: Iterator) -> Iterator:
        for f in frames:
            texts = [main_text(h) for h in f["html"]]
            yield f[["page_id", "url"]].assign(text=texts, n_chars=list(map(len, texts)))

    return map_rows(pages.select("page_id", "url", F.col("html").cast("string").alias("html")), work, ["page_id", "url"], text="string", n_chars="long")
