"""Main text of web pages by composite text density.

A page becomes a tree of elements. Scripts, styles, forms, navigation, headers, footers, sidebars, notices, adverts
and comments, known by tag, role or the words of class and id, are taken off. Each remaining node has a density: its
characters outside links per tag outside links, raised by how much of it is no link. The node whose children have the
largest sum of densities is the core of the page; the smallest density on its path to the body is the threshold by
which the parts beside it are taken in, up to the enclosing article if there is one.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BLOCKS = CLOSES_P | frozenset("body html li dt dd tr td th thead tbody tfoot caption br option figcaption summary legend center title".split())
#: An element that starts ends an open one of these, no farther up than the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NEVER_TEXT = frozenset("head script style noscript template iframe svg canvas object audio video select textarea button datalist map".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad adbox ads adslot adsense adspace adunit adv advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies copyright disclaimer discussion disqus feedback footer form gdpr header login masthead menu modal "
    "nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion promoted rail reactions recommended related "
    "replies responses share sharing side sidebar sidenav signin signup social sponsor sponsored subscribe subscription toolbar topbar widget "
    "widgets".split()
)
#: Words that name parts of articles as well: such a node goes only if it is mostly links or short against the page.
UNSURE_WORDS = frozenset("alert copyright disclaimer discussion feedback notice notices promotion reactions responses social".split())
LINK_SHARE, SHORT_SHARE = 0.5, 0.05
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article main".split())
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "names", "role", "parent", "children", "size", "link_size", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, attrs=()):
        self.tag, self.parent, self.children = tag, parent, []
        a = dict(attrs)
        # each class and the id is one name, of one word or several
        self.names = [_WORD.findall(x) for x in f"{a.get('class') or ''} {a.get('id') or ''}".lower().split()] if "class" in a or "id" in a else []
        self.role = (a.get("role") or "").lower()


class Tree(HTMLParser):
    """A forgiving reader: unclosed and crossed elements end where their parent does.

    Open elements are a stack, and for each tag the places of the open ones: what a tag ends is found by place, without
    a walk to the root, however deeply a page nests.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.stack, self.places = [self.root], {}
        self.feed(html)
        self.close()

    @property
    def at(self) -> Node:
        return self.stack[-1]

    def _leave(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.places[self.stack.pop().tag].pop()

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return  # one root is both
        if tag in CLOSES_P:
            self._end({"p"}, {"td", "th", "li", "dd", "table", "button", "object"} | CONTENT)
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        if tag != "head" and self.at.tag == "head" and tag not in ("title", "meta", "link", "script", "style", "base", "noscript", "template"):
            self._leave(len(self.stack) - 1)
        node = Node(tag, self.at, attrs)
        self.at.children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.stack))
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag and tag not in VOID and len(self.stack) > 1:
            self._leave(len(self.stack) - 1)

    def handle_endtag(self, tag):
        if tag not in ("html", "body") and tag not in VOID:
            self._end({tag}, () if tag in CONTENT or tag in CLOSES_P and tag != "p" else {"td", "th", "li", "table"} | CONTENT, all_of=False)

    def handle_data(self, data):
        self.at.children.append(data)

    def _end(self, tags, barrier, all_of=True):
        """Leave the innermost open element of ``tags`` (with ``all_of`` each of them) inside of any of ``barrier``."""
        wall = max((p[-1] for b in barrier if b not in tags and (p := self.places.get(b))), default=0)
        inside = [p[bisect.bisect_right(p, wall) if all_of else -1] for t in tags if (p := self.places.get(t)) and p[-1] > wall]
        if inside:
            self._leave(min(inside) if all_of else max(inside))


def _walk(root: Node) -> list[Node]:
    """Nodes of a tree, parents first, without recursion: pages nest as deep as they like."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return out


def _measure_text(nodes: list[Node]) -> None:
    """size and link_size of every node: characters that can be text, and those of them inside links; one pass, leaves first."""
    for node in reversed(nodes):
        below = [c for c in node.children if not isinstance(c, str)]
        own = 0 if node.tag in NEVER_TEXT else sum(len(c) for c in node.children if isinstance(c, str))
        node.size = own + sum(c.size for c in below)
        node.link_size = node.size if node.tag == "a" else sum(c.link_size for c in below)


def _boilerplate(node: Node, page: int) -> bool:
    """Known by tag, role, or a name all of whose words are boilerplate; headings have names for their titles."""
    if node.tag in BOILERPLATE_TAGS or node.role in BOILERPLATE_ROLES:
        return True
    named = [x for x in node.names if x and BOILERPLATE_WORDS.issuperset(x)] if node.tag not in HEADINGS else []
    if not named or not all(UNSURE_WORDS.issuperset(x) for x in named):
        return bool(named)
    return node.size <= SHORT_SHARE * page or node.link_size > LINK_SHARE * node.size


def _holds(nodes: list[Node], page: int) -> set[int]:
    """Nodes that are never taken off: what holds a main element, the longest article or the page's first heading.

    A heading protects what holds it inside of an article or main, or where nothing around it is boilerplate: the
    title in a site's own header protects nothing.
    """
    articles = [n for n in nodes if n.tag == "article" and not _boilerplate(n, page)]
    targets = [n for n in nodes if n.tag == "main"] + ([max(articles, key=lambda n: n.size)] if articles else [])
    out: set[int] = set()
    for node in targets:
        while node is not None and id(node) not in out:
            out.add(id(node))
            node = node.parent
    for heading in [n for n in nodes if n.tag == "h1"][:1]:
        path, node = [heading], heading.parent
        while node is not None and node.tag not in CONTENT:
            path.append(node)
            node = node.parent
        if node is not None or not any(_boilerplate(n, page) for n in path):
            out.update(map(id, path))
    return out


def prune(root: Node) -> None:
    nodes = _walk(root)
    _measure_text(nodes)
    page = root.size
    keep = _holds(nodes, page)
    for node in nodes:
        node.children = [c for c in node.children if isinstance(c, str) or not (c.tag in NEVER_TEXT or id(c) not in keep and _boilerplate(c, page))]


def measure(root: Node) -> list[Node]:
    nodes = _walk(root)
    for node in reversed(nodes):
        own = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        below = [c for c in node.children if not isinstance(c, str)]
        node.chars = own + sum(c.chars for c in below)
        node.tags = len(below) + sum(c.tags for c in below)
        node.link_chars = node.chars if node.tag == "a" else sum(c.link_chars for c in below)
        node.link_tags = node.tags if node.tag == "a" else sum(c.link_tags + (c.tag == "a") for c in below)
    share = root.link_chars / max(1, root.chars)
    for node in nodes:
        plain, tags = node.chars - node.link_chars, max(1, node.tags - node.link_tags)
        if plain <= 0:
            node.density = 0.0
            continue
        # the composite factor: about 1 for running text, less the more of the text and tags are links
        ratio = node.chars / max(1, node.link_chars) * max(1, node.tags) / max(1, node.link_tags)
        base = node.chars / plain * node.link_chars + share * node.chars + math.e
        weight = math.log(ratio + math.e) / math.log(base + ratio + math.e)
        node.density = plain / tags * weight
    for node in nodes:
        node.total = sum(c.density for c in node.children if not isinstance(c, str))
    return nodes


def core(root: Node) -> Node:
    """The subtree that is the page's main text."""
    nodes = measure(root)
    best = max(nodes, key=lambda n: n.total)  # the first of equals stands highest
    if best.total <= 0:
        return root
    path, node = [best], best
    while node.parent is not None:
        node = node.parent
        path.append(node)
    threshold = min(n.density for n in path)
    for tag in ("article", "main"):
        top = next((n for n in reversed(path) if n.tag == tag), None)
        if top is not None:
            return top
    node = best
    while node.parent is not None:
        beside = [c for c in node.parent.children if c is not node]
        if not any((c.strip() if isinstance(c, str) else c.chars and (c.density >= threshold or c.tag in HEADINGS or c.tag == "p")) for c in beside):
            break
        node = node.parent
    return node


def text_of(node: Node) -> str:
    """The node's text: blocks in page order, white space as one space."""
    parts: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        if x.tag in BLOCKS:
            parts.append("\n")
            stack.append("\n")
        stack.extend(reversed(x.children))
    return " ".join("".join(parts).split())


def main_text(html: str | None) -> str:
    if not html or not html.strip():
        return ""
    root = Tree(html).root
    prune(root)
    return text_of(core(root))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points of text) for each row of ``pages``.

    Reads page_id, url and html; other columns are ignored. A null, empty or blank html, and a page with nothing but
    boilerplate, gives an empty text. Html is read whole, however long or deeply nested. Repeated rows give repeated
    results; an empty table gives no rows.
    """

    @F.pandas_udf("string")
    def main(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            yield pd.Series([main_text(h) for h in htmls], dtype=object)

    rows = pages.select("page_id", "url", main.asNondeterministic()(F.col("html").cast("string")).alias("text"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
