"""Main text of web pages by composite text density.

A forgiving parser builds the DOM (implied ends, void elements, raw text of scripts and styles, truncated pages). Parts
that the result never holds go first: elements that say by their kind, class, id or role that they are a menu, header,
footer, sidebar, notice, advert, form or the readers' comments. What is left is chosen by density alone: every node gets
its link-adjusted characters per tag (``density``) and the sum of its children's densities; the threshold is the least
density on the path from the body to the node of the greatest sum; below each node at or above the threshold the node of
the greatest sum is content. Content inside an ``article`` element stands for the whole of it (its heading may be outside
the subtree chosen).

Blocks are texts between block-level boundaries; ``br`` is white space. A null, empty or textless page gives an empty
text and 0 characters; repeated pages are rows of their own; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|select|object)\b[^>]*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:[^<>"']|"[^"]*"|'[^']*')*+)>"""
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/<>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>"
    r"|<[!?/a-zA-Z][^>]*\Z",
    re.S | re.I,
)
ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
DROPPED = frozenset("head nav header footer aside form button input dialog menu canvas audio video map label fieldset".split())
HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side-bar|aside|widgets?|footer\w*|header|masthead|topbar|toolbar|comments?|commentlist|disqus\w*|replies|respond"
    r"|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|signup|login|share|sharing|social\w*|related\w*|recommend\w*|pagination|pager|skip-link|search\w*|complementary|contentinfo|search|banner)(?:$|[\s_-])",
    re.I,
)
#: A start tag ends these open elements first.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("thead", "tbody", "tr"), "tbody": ("thead", "tbody", "tr"),
}
SCOPE = frozenset("table td th ul ol dl article section main div body html blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "parent", "kids", "drop", "chars", "tags", "link_chars", "link_tags", "density", "total", "best", "wanted")

    def __init__(self, tag: str, parent: "Node | None", drop: bool = False):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.kids: list = []
        self.wanted = False


def unwanted(tag: str, attrs: str) -> bool:
    if tag in DROPPED:
        return True
    if "=" not in attrs and "hidden" not in attrs:
        return False
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name in ("class", "id", "role") and tag not in ("html", "body", "article", "main") and HINT.search(value):
            return True
        elif name in ("class", "id") and tag == "article" and re.search(r"(?:^|[\s_-])(?:comment|reply|teaser|related|ad|promo)s?(?:$|[\s_-])", value, re.I):
            return True
    return False


def parse(html: str) -> Node:
    root = Node("html", None)
    at, here = 0, root
    for m in TOKEN.finditer(html):
        if m.start() > at:
            here.kids.append(html[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            if m["raw"]:
                here.kids.append(" ")
            continue
        tag = tag.lower()
        if m["close"] or m["close2"]:
            if tag == "br":
                here.kids.append(" ")
                continue
            n = here
            while n is not None and n.tag != tag:
                # An inline end tag can't close a block.
                n = None if tag not in BLOCK and n.tag in BLOCK else n.parent
            if n is not None and n.parent is not None:
                here = n.parent
            continue
        if tag in ("html", "body") and any(k for k in (here,) if k.tag == tag):
            continue
        if tag in BLOCK and tag != "hr":
            n = here
            while n.parent is not None and n.tag not in SCOPE:
                if n.tag == "p" or n.tag in HEADINGS and tag in HEADINGS:
                    here = n.parent
                    break
                n = n.parent
        if tag in ENDS:
            n = here
            while n.parent is not None:
                if n.tag in ENDS[tag]:
                    here = n.parent
                elif n.tag in ("ul", "ol", "dl", "table", "article", "main", "body"):
                    break
                n = n.parent
        attrs = m["attrs"] if m["attrs"] is not None else m["attrs2"] or ""
        if tag in VOID:
            if tag == "hr":
                here.kids.append(Node("hr", here))
            elif tag == "br":
                here.kids.append(" ")
            continue
        node = Node(tag, here, unwanted(tag, attrs))
        here.kids.append(node)
        if not attrs.endswith("/") or tag in BLOCK or tag == "a":
            here = node
    if at < len(html):
        here.kids.append(html[at:])
    return root


def nodes(root: Node) -> list[Node]:
    """Every kept node, parents first, without recursion."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if not n.drop:
            out.append(n)
            todo += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return out


def measure(order: list[Node]) -> None:
    for n in reversed(order):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len("".join(k.split()))
            elif not k.drop:
                n.chars += k.chars
                n.tags += k.tags + 1
                n.link_chars += k.chars if k.tag == "a" else k.link_chars
                n.link_tags += k.link_tags + (k.tag == "a")
    body = order[0]
    share = body.link_chars / max(body.chars, 1)
    for n in order:
        c, t, lc, lt = n.chars, max(n.tags, 1), n.link_chars if n.tag != "a" else n.chars, max(n.link_tags, 1)
        if c == 0:
            n.density = 0.0
            continue
        # The published base of the logarithm falls to 1 for small nodes without links; e**e in place of e keeps it at e or more.
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e**math.e)
        n.density = c / t * math.log(max(c / max(lc, 1) * t / lt, 1.0)) / math.log(base)
    for n in reversed(order):
        kids = [k for k in n.kids if isinstance(k, Node) and not k.drop]
        n.total = sum(k.density for k in kids)
        n.best = n
        for k in kids:
            if k.best.total > n.best.total:
                n.best = k.best


def choose(order: list[Node]) -> None:
    """Marks the content nodes."""
    top = order[0]
    path, n = [top.best.density], top.best
    while n is not top:
        n = n.parent
        path.append(n.density)
    threshold = min(path)
    for n in order:
        if n.density >= threshold and n.density > 0:
            n.best.wanted = True
    if not any(n.wanted for n in order):  # too little text for a density above 0
        top.wanted = True
    article = {}  # the outermost article element around each node, of those that are left
    for n in order:
        article[n] = article.get(n.parent) or (n if n.tag == "article" else None)
        if n.wanted and article[n]:
            article[n].wanted = True


def blocks(order_root: Node) -> list[str]:
    """Texts between block boundaries inside the wanted nodes, in page order."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                out.append(text)
            run.clear()

    todo: list = [(order_root, False, False)]
    while todo:
        n, inside, leaving = todo.pop()
        if leaving:
            close()
        elif isinstance(n, str):
            if inside:
                run.append(n)
        elif n.drop:
            if n.tag in BLOCK:
                close()
            else:
                run.append(" ") if inside and run else None
        else:
            begins = n.wanted and not inside
            inside = inside or n.wanted
            if n.tag in BLOCK or begins:
                close()
                todo.append((n, inside, True))
            todo += [(k, inside, False) for k in reversed(n.kids)]
    close()
    return out


def main_text(html: str) -> str:
    if not html:
        return ""
    root = parse(html)
    order = nodes(root)
    body = next((n for n in order if n.tag == "body"), root)
    if body is not root:
        order = nodes(body)
    measure(order)
    choose(order)
    return "\n\n".join(blocks(body))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars)."""

    def run(batches):
        for b in batches:
            texts = [main_text(h or "") for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
