"""Main text of web pages by tree scoring.

The page's tags become a tree as browsers build it in the main (void and raw-text elements, implied ends of p, li and
the like, unclosed and stray tags). Parts that are never main text (menus, forms, scripts; elements whose class, id or
role names an advert, a notice, comments) are left out; headings and inline elements aren't judged by name, nor, by its
id alone, a part of the article that holds a topic's text. Each paragraph gives points for its length and commas, all of
them to its parent half to its grandparent and a quarter to the one above; a container's points are discounted by its link density. The best
container's article is kept whole; without one, the container and what scores like it or reads like text beside it,
up to the main element or the ancestor with nearly all unlinked text. Their blocks are joined in page order.

Defined results: a null, empty or textless page gives an empty text; a tag cut off by the page's end is dropped;
character references are decoded as HTML decodes them; rows with equal page_id are extracted each by itself; an empty
table gives no rows; other columns are ignored. A worker handles one page at a time, so memory follows the longest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
DROPPED = RAW | frozenset("head nav header footer aside form button select option input label fieldset menu svg canvas object audio video dialog".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address hr details summary center".split())
#: Elements that a new one of the given kinds ends.
CLOSES_P = BLOCKS - {"html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd"} | {"li", "dt", "dd"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article section div main td th".split())
CONTAINERS = frozenset("body main article section div td blockquote".split())
#: Elements that get no points of their own: beside the best container they are judged by their links.
LISTED = frozenset("ul ol dl table pre h4 h5 h6 figure details".split())
#: Share of its parent's unlinked text at which an ancestor of the best container is kept.
NEARLY = 0.9

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
#: Words, alone or joined by - and _, of class, id or role values that mark what is not the article.
UNWANTED = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adbox|adslot|banner|promo|promoted|sponsor|sponsored|comments?|disqus|replies|respond|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|sidebar|widget|breadcrumbs?|nav|navbar|navigation|menu|toolbar|pagination|pager|footer|masthead|skip|complementary|contentinfo|dialog|search|rail|toc|tags?)(?:$|[\s_-])", re.I)
#: Of these, those that aren't a section's topic, as related-work is, even in an id inside the article.
NOT_TOPICS = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adbox|adslot|banner|promo|promoted|sponsor|sponsored|comments?|disqus|replies|respond|cookies?|consent|gdpr|newsletter|popup|modal|overlay|nav|navbar|navigation|sidebar|footer|masthead)(?:$|[\s_-])", re.I)
#: Elements whose names say nothing of the page's parts: headings and what stands within a line.
UNJUDGED = frozenset("h1 h2 h3 h4 h5 h6 a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: Characters of text with few links that make a section inside the article with such an id a part of it.
TOPIC = 80
WANTED = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text|hentry|page)(?:$|[\s_-])", re.I)
WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("bonus", "children", "commas", "doubtful", "dropped", "in_p", "inside", "links", "parent", "size", "tag", "score")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, bonus: int = 0):
        self.tag, self.parent, self.dropped, self.bonus = tag, parent, dropped, bonus
        self.children: list = []
        self.score = 0.0
        self.doubtful = False
        self.size = self.links = self.commas = 0
        self.in_p = tag == "p" or parent is not None and parent.in_p and tag not in SCOPE and tag != "li"
        self.inside = tag in ("article", "main") or parent is not None and parent.inside


def _marks(tag: str, attributes: str, inside: bool) -> tuple[bool, int, bool]:
    """Whether an element is left out for what it is, the points its names give, and whether its text decides (in an article)."""
    if tag in DROPPED:
        return True, 0, False
    bonus = {"article": 30, "main": 25, "section": 5, "blockquote": 3, "td": 3, "div": 5}.get(tag, 0)
    dropped = doubtful = False
    if attributes and tag not in ("html", "body"):
        for m in NAMED.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                dropped = True
            elif name in ("class", "id", "role"):
                if WANTED.search(value):
                    bonus += 25
                elif UNWANTED.search(value) and tag not in ("article", "main") and tag not in UNJUDGED:
                    if name == "id" and inside and not NOT_TOPICS.search(value):
                        doubtful = True
                    else:
                        dropped = True
    return dropped, bonus, doubtful


def tree(page: str) -> Node:
    root = Node("html", None)
    at, open_ = 0, root
    end = len(page)

    def text(piece: str, raw: bool = False) -> None:
        if piece and not open_.dropped:
            open_.children.append(piece if raw else html.unescape(piece))

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            text(m[1], raw=True)
            continue
        slash, tag = (m[2], m[3]) if m[3] else (m[5], m[6])
        if not tag or (m[3] is None and not m[0].endswith(">")):
            continue  # a comment, a declaration, a stray end, a tag cut off
        tag = tag.lower()
        if slash:
            node = open_
            while node is not None and node.tag != tag:
                if node.tag in ("table", "article", "main", "body") and tag not in ("body", "html", "main", "article", "div", "section", "table"):
                    node = None
                    break
                node = node.parent
            if node is not None and node.parent is not None:
                open_ = node.parent
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P and open_.in_p:
            node = open_
            while node is not None and node.tag != "p" and node.tag not in SCOPE and node.tag != "li":
                node = node.parent
            if node is not None and node.tag == "p":
                open_ = node.parent
        if tag in SAME:
            node = open_
            while node is not None and node.tag not in SAME[tag] and node.tag not in SCOPE:
                node = node.parent
            while node is not None and node.tag in SAME[tag]:
                open_ = node = node.parent
        attributes = m[4] or ""
        dropped, bonus, doubtful = _marks(tag, attributes, open_.inside and "id" in attributes.lower())
        node = Node(tag, open_, dropped or open_.dropped, bonus)
        node.doubtful = doubtful
        if not node.dropped:
            open_.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else (at if tag in ("title", "noscript", "template") else end)
        elif tag not in VOID:
            open_ = node
    return root


def scored(root: Node) -> Node:
    """Gives every container its points and returns the best; the root if no paragraph scores."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    candidates: dict[int, Node] = {}
    gone: set[Node] = set()
    for node in reversed(order):  # children before their parents
        own = "".join(c for c in node.children if isinstance(c, str))
        kids = [c for c in node.children if isinstance(c, Node)]
        if any(k.doubtful for k in kids):
            node.children = [c for c in node.children if isinstance(c, str) or not c.doubtful or (c.size > TOPIC and c.links < 0.25 * c.size)]
            gone.update(k for k in kids if k not in node.children)
            kids = [c for c in node.children if isinstance(c, Node)]
        node.size = len(own.strip()) + sum(k.size for k in kids)
        node.commas = own.count(",") + own.count("、") + own.count("，") + sum(k.commas for k in kids)
        node.links = node.size if node.tag == "a" else sum(k.links for k in kids)
    for node in order:  # parents before their children
        if gone and (node in gone or node.parent in gone):
            gone.add(node)
            continue
        # a paragraph: p, pre, td, li, or text that stands in a container itself
        own = node.size if node.tag in ("p", "pre", "td", "li", "blockquote", "h1", "h2", "h3") else sum(len(c.strip()) for c in node.children if isinstance(c, str)) if node.tag in CONTAINERS else 0
        if own < 1:
            continue
        points = (1 if own >= 25 else 0.2) + node.commas + min(own / 100, 3)
        target, share = (node if node.tag in CONTAINERS else node.parent), 1.0
        while target is not None and share > 0.2:
            if target.tag in CONTAINERS or target.tag == "html":
                target.score += points * share
                candidates[id(target)] = target
                share /= 2
            target = target.parent
    best, most = root, 0.0
    for node in candidates.values():
        score = (node.score + node.bonus) * (1 - node.links / max(node.size, 1))
        node.score = score
        if score > most:
            best, most = node, score
    return best


def _reads(x: Node | str, least: float) -> bool:
    """Whether what stands beside the best container is text of the page: by score, or as prose, lists and tables by link density."""
    if isinstance(x, str):
        return True
    if not x.size:
        return False
    density = x.links / x.size
    if x.tag in LISTED:
        return density < 0.5
    return (x.score >= least and density < 0.5) or (density < 0.25 if x.size > 80 else density == 0) or (x.tag in ("h1", "h2", "h3") and density < 0.3)


def kept(best: Node) -> list[Node | str]:
    """What is kept, in page order: the article around the best container, whole; without one, the best container and
    what reads like text beside it, up to the main element or the ancestor that holds nearly all unlinked text."""
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    articles = [x for x in above if x.tag == "article"]
    if articles:
        return articles[-1:]
    if best.tag == "main" or best.parent is None:
        return [best]
    top = next((k for k, x in enumerate(above) if x.tag == "main"), 0)
    if not top:
        top = max([1, *(k for k, x in enumerate(above[:-1]) if k and x.tag not in ("body", "html") and x.size - x.links >= NEARLY * (x.parent.size - x.parent.links))])
    path = set(map(id, above[:top]))
    least = max(10.0, best.score * 0.2)
    out, stack = [], [above[top]]
    while stack:
        x = stack.pop()
        if x is best:
            out.append(x)
        elif not isinstance(x, str) and (id(x) in path or x is above[top]):
            stack += reversed(x.children)
        elif _reads(x, least):
            out.append(x)
    return out


def blocks(nodes: list[Node | str]) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        line = WHITE.sub(" ", "".join(held)).strip()
        held.clear()
        if line:
            out.append(line)

    stack: list = [("end", None)]
    for x in reversed(nodes):
        stack.append(("node", x))
    while stack:
        kind, x = stack.pop()
        if kind == "end":
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.tag in BLOCKS:
            flush()
            stack.append(("end", None))
            stack += [("node", c) for c in reversed(x.children)]
        else:
            if x.tag == "br":
                held.append(" ")
            stack += [("node", c) for c in reversed(x.children)]
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(blocks(kept(scored(tree(page)))))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = C.small_batches(pages).select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long")
