"""Main text of web pages by composite text density.

The page is parsed leniently into a tree; elements that are furniture by tag or role
(menus, side matter, footers, dialogs, forms) take no part. A form that wraps the page (it holds an
article or main, menus or footers, or over half of the text) is none. What a class or id marks, as a word of its
own, as reader comments (``COMMENTS``) or as an advert, notice or sharing bar (``MARKS``) goes too;
not an advert or notice that holds all articles and mains of the page. If no text stands outside such elements, the outermost
of them are no such thing, and those inside are looked at in the same way. Every node left
gets its characters C, tags T, link characters LC and link tags LT (all 1 at
least); its composite text density is

    C / T * ln(C / LC * T / LT) / ln(C / nLC * LC + LCb / Cb * C + e)

where nLC are characters outside links and b marks the body. A node's density
sum adds its children's densities, text in the node itself as a child of one tag. The node
with the largest sum is chosen; in a page with an ``article`` or ``main``, among those inside
one. The least density on its path to the body is the threshold.

The content is the chosen node's subtree (that of the container around it, if it is a paragraph or
list), with what stands beside its path. Up to the article or main around it, that is all but containers
that hold mostly links and don't reach the threshold; such containers in the subtree go as well. Without article or
main, the path goes up to the body and only containers whose density reaches the threshold, and whose sum the chosen
node's density, are taken, and headings and paragraphs that aren't mostly links; containers in the subtree that don't reach the threshold go if others do.

One narrow pass; the parser keeps its own stack and counts open tags, so deep, long or
broken pages take time in proportion to their length.

Defined results: a null or empty page, or one without text, gives an empty
text; broken or unclosed markup is closed where its parent ends, and an end tag that closes
nothing is left out; a head that isn't closed ends before what can't stand in one, and what
stands before or after the body belongs to it; of equal sums the first node in page order is chosen; repeated pages
are handled one by one; very long pages are taken whole; an empty table gives no rows; columns
that aren't named are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces, require

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style noscript template iframe object svg math canvas head title textarea select option button".split())
RAW = frozenset("script style textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE_TAGS = frozenset("nav aside footer form dialog menu".split())
#: What stands in a head; anything else ends it.
HEAD_TAGS = frozenset("title meta link base basefont bgsound style script noscript template".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Words of a class or id (between blanks) of reader comments, and of other things that an article may hold.
COMMENTS = frozenset("comments comment comment-list commentlist comments-area disqus_thread respond replies reader-comments".split())
MARKS = frozenset(
    "ad ads advert advertisement sponsored promo banner cookie-notice cookie-banner cookies consent notice popup modal overlay newsletter subscribe related share sharing social breadcrumb breadcrumbs sidebar navbar menu footer pagination pager".split()
)
CONTAINERS = frozenset("article main section div td center body".split())
#: A start tag that closes an open element of the same kind of slot (HTML's implied end tags).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S)
#: A tag with an open quotation mark ends at the next bracket.
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")
_CLOSE = {tag: re.compile(f"</{tag}(?=[\\s/>])|</{tag}\\Z", re.I) for tag in RAW}


class Node:
    __slots__ = ("tag", "parent", "children", "marked", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, marked: str = ""):
        self.tag, self.parent, self.marked = tag, parent, marked
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _marked(tag: str, attributes: str) -> str:
    """What an element is by its tag, role, class or id: furniture, comments, marked or nothing of these."""
    if tag == "form":
        return "form"
    if tag in FURNITURE_TAGS:
        return "furniture"
    if not attributes or "=" not in attributes:
        return ""
    named = ""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "role" and value in FURNITURE_ROLES or key == "aria-hidden" and value == "true":
            return "furniture"
        if key in ("class", "id"):
            words = set(value.split())
            if words & COMMENTS:
                named = "comments"
            elif words & MARKS:
                named = named or "marked"
    return named


def parse(html: str) -> Node:
    """The page's tree: text stands in it decoded."""
    root = Node("html", None)
    at, node, end, body = 0, root, len(html), False
    opened: Counter[str] = Counter()  # tags of the nodes from here up to the root

    def leave(to: Node) -> None:
        nonlocal node
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent

    while at < end:
        lt = html.find("<", at)
        if opened["head"] and not opened["noscript"] and not opened["template"] and html[at : lt if lt >= 0 else end].strip():
            leave(root)  # text
        if lt < 0:
            node.children.append(unescape(html[at:]))
            break
        m = _TOKEN.match(html, lt) or _BROKEN.match(html, lt)
        if m is None:  # a bare "<" is text
            node.children.append(unescape(html[at : lt + 1]))
            at = lt + 1
            continue
        if lt > at:
            node.children.append(unescape(html[at:lt]))
        at = m.end()
        if m.lastindex is None or m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                leave(up.parent)
            elif tag == "p":
                node.children.append(Node("p", node))
            continue
        if tag == "html" or tag == "body" and body:
            continue
        if tag == "body" or opened["head"] and tag not in HEAD_TAGS and not opened["noscript"] and not opened["template"]:
            leave(root)
        if tag in CLOSES:
            if any(opened[t] for t in CLOSES[tag]):
                up, to = node, node
                while up is not None and up.tag not in ("ul", "ol", "dl", "table", "article", "body"):
                    if up.tag in CLOSES[tag]:
                        to = up.parent or root
                        if tag != "tr" or up.tag == "tr":
                            break
                    up = up.parent
                leave(to)
        elif tag in BLOCK and opened["p"]:
            # A block ends an open paragraph, with the inline elements left open in it.
            up = node
            while up is not None and (up.tag == "p" or up.tag not in BLOCK):
                if up.tag == "p":
                    leave(up.parent or root)
                    break
                up = up.parent
        made = Node(tag, node, _marked(tag, m[3]))
        body = body or tag == "body"
        node.children.append(made)
        if tag in RAW:
            close = _CLOSE[tag].search(html, at)
            stop = close.start() if close else end
            made.children.append(html[at:stop])
            at = stop
        if tag in RAW or tag not in VOID and not m[3].rstrip().endswith("/"):
            node = made
            opened[tag] += 1
    return root


def _body(root: Node) -> Node:
    """The body, with all that stands beside it but the head."""
    body = next((c for c in root.children if isinstance(c, Node) and c.tag == "body"), None) or Node("body", root)
    at = root.children.index(body) if body in root.children else len(root.children)
    outside = lambda nodes: [c for c in nodes if isinstance(c, str) or c.tag != "head"]
    body.children = [*outside(root.children[:at]), *body.children, *outside(root.children[at + 1 :])]
    for c in body.children:
        if isinstance(c, Node):
            c.parent = body
    return body


def _ordered(root: Node) -> list[Node]:
    """All nodes that may hold text, parents first."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node) and c.tag not in SKIP)
    return out


def _length(texts: list[Node | str]) -> int:
    """Characters of the text that stands in a node itself."""
    return sum(len(_SPACE.sub(" ", c).strip()) for c in texts if isinstance(c, str))


def _sizes(nodes: list[Node]) -> dict[int, int]:
    """Characters of each node's subtree, by id."""
    size: dict[int, int] = {}
    for n in reversed(nodes):
        size[id(n)] = _length(n.children) + sum(size.get(id(c), 0) for c in n.children if isinstance(c, Node))
    return size


def _kept(nodes: list[Node], gone: set[int]) -> list[Node]:
    """``nodes`` without those in ``gone`` and what they hold; they leave the tree."""
    out = []
    for n in nodes:
        if id(n) in gone or id(n.parent) in gone:
            gone.add(id(n))
        else:
            out.append(n)
    for n in out:
        n.children = [c for c in n.children if isinstance(c, str) or id(c) not in gone]
    return out


def _without(nodes: list[Node], body: Node) -> list[Node]:
    """``nodes`` without furniture, the page's header, and what is marked as comments or no content."""
    size = _sizes(nodes)
    semantic: dict[int, int] = {}  # articles and mains in a node
    frame: dict[int, int] = {}  # furniture in a node
    inside: dict[int, bool] = {}  # an article or main is around it
    for n in nodes:
        inside[id(n)] = n is not body and (inside[id(n.parent)] or n.parent.tag in ("article", "main"))
    for n in reversed(nodes):
        below = [c for c in n.children if isinstance(c, Node)]
        semantic[id(n)] = (n.tag in ("article", "main")) + sum(semantic.get(id(c), 0) for c in below)
        frame[id(n)] = (n.marked == "furniture" or n.tag == "header" and not inside[id(n)]) + sum(frame.get(id(c), 0) for c in below)

    def furniture(n: Node) -> bool:
        if n.marked == "form":
            return not (semantic[id(n)] or frame[id(n)] or 2 * size[id(n)] > size[id(body)])
        return n.marked == "furniture" or n.tag == "header" and not inside[id(n)]

    nodes = _kept(nodes, {id(n) for n in nodes if n is not body and furniture(n)})
    pages = sum(n.tag in ("article", "main") for n in nodes)
    whole = lambda n: n.marked == "marked" and pages and semantic[id(n)] >= pages
    suspect = {id(n) for n in nodes if n.marked in ("marked", "comments") and n is not body and n.tag not in ("article", "main") and not whole(n)}
    size = _sizes(nodes)
    while suspect:
        outer: list[Node] = []  # suspects that no other one is around
        covered: set[int] = set()
        for n in nodes:
            if n is not body and id(n.parent) in covered:
                covered.add(id(n))
            elif id(n) in suspect:
                covered.add(id(n))
                outer.append(n)
        if sum(size[id(n)] for n in outer) < size[id(body)]:
            return _kept(nodes, suspect)
        suspect -= {id(n) for n in outer}
    return nodes


def _score(nodes: list[Node], body: Node) -> None:
    """Densities and their sums."""
    for n in reversed(nodes):
        n.chars = n.total = _length(n.children)
        for c in n.children:
            if isinstance(c, Node) and c.tag not in SKIP:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in nodes:
        c, t, lc, lt = n.chars, n.tags or 1, n.link_chars or 1, n.link_tags or 1
        if c:
            base = math.log(c / max(1, c - n.link_chars) * n.link_chars + share * c + math.e)
            n.density = c / t * math.log(max(1.0, c / lc * t / lt)) / base
    for n in nodes:
        n.total += sum(c.density for c in n.children if isinstance(c, Node) and c.tag not in SKIP)


def _chosen(nodes: list[Node], body: Node) -> tuple[Node, float, Node | None]:
    """The node of the largest sum, the threshold of its path to the body, and the article or main around it."""
    around: dict[int, Node | None] = {}
    for n in nodes:
        up = None if n is body else around[id(n.parent)]
        inner = n.tag == "article" or n.tag == "main" and (up is None or up.tag != "article")
        around[id(n)] = n if inner and (up is None or up.tag != "article") else up
    semantic = [n for n in nodes if n.chars and around[id(n)] is not None]
    best = max(semantic or nodes, key=lambda n: n.total)
    threshold, up = best.density, best
    while up is not body:
        up = up.parent
        threshold = min(threshold, up.density)
    return best, threshold, around[id(best)]


def _content(nodes: list[Node], body: Node) -> tuple[Node, set[int]]:
    """The element of the content, and ids of the nodes inside it that are none."""
    best, threshold, around = _chosen(nodes, body)
    gone: set[int] = set()
    top = best
    while top is not body and top is not around and top.tag not in CONTAINERS:
        top = top.parent
    links = lambda c: 2 * c.link_chars > c.chars
    if around is not None:
        return around, {id(n) for n in nodes if n is not around and n.tag in CONTAINERS and n.tag not in ("article", "main") and links(n) and n.density < threshold and n is not top}
    inner = [c for c in top.children if isinstance(c, Node) and c.tag in CONTAINERS]
    if any(c.density >= threshold for c in inner):
        gone.update(id(c) for c in inner if c.density < threshold)
    while top is not body:
        here, top = top, top.parent
        for c in top.children:
            if isinstance(c, str) or c is here or c.tag in SKIP:
                continue
            plain = c.tag in BLOCK and c.tag not in CONTAINERS and 2 * c.link_chars < c.chars and not any(isinstance(x, Node) and x.tag in CONTAINERS for x in c.children)
            if not (plain or c.density >= threshold and c.total >= best.density):
                gone.add(id(c))
    return top, gone


def main_blocks(html: str | None) -> list[str]:
    """The blocks of the main text, in page order."""
    if not html:
        return []
    body = _body(parse(html))
    nodes = _without(_ordered(body), body)
    _score(nodes, body)
    if not body.chars:
        return []
    return _blocks(*_content(nodes, body))


def _blocks(top: Node, gone: set[int]) -> list[str]:
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [top]
    while stack:
        n = stack.pop()
        if n is None:
            close()
        elif isinstance(n, str):
            held.append(n)
        elif n.tag in SKIP or id(n) in gone:
            continue
        elif n.tag in ("br", "hr", "img", "wbr"):
            if n.tag == "hr":
                close()
            elif n.tag == "br":
                held.append(" ")
        elif n.tag in BLOCK:
            close()
            stack.append(None)
            stack.extend(reversed(n.children))
        else:
            stack.extend(reversed(n.children))
    close()
    return out


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per page: page_id, the columns in ``keep``, text, n_chars (code points)."""
    require(pages, id_col, html_col, *keep)
    rows = pages.select(F.col(id_col).alias("page_id"), *[F.col(c) for c in keep], F.col(html_col).alias("html"))
    kept = rows.drop("html").schema
    names = [*kept.names, "text"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, batch.num_columns - 1, rows=256):
                texts = ["\n\n".join(main_blocks(h)) for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=names)

    found = rows.mapInArrow(task, kept.add("text", "string"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
