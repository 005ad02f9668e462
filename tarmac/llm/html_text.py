"""Main-text extraction from HTML by composite text density.

For every DOM node: characters per tag, adjusted for links.  The density sum of a node is the sum of its children's
densities, own text counting as a child.  The node with the maximum density sum lies in the main text; the smallest
density on the path from it up to ``body``'s child is the threshold.  From that node the text's subtree widens to its parent as
long as everything beside the path is text too: as dense as the threshold, or a heading, paragraph or the like that
isn't made of links.  It widens to an article or main element around it in any case, and never past one.  Of what lies
beside the subtree, nodes as dense as the threshold belong to the text (not where an article or main element bounds
it); lists of links inside it don't.

Before densities are computed, nodes that can't be article text go: scripts, styles and hidden nodes; navigation,
footers, asides, readers' comments and nodes named exactly like furniture, unless they hold an article or main element;
forms, headers and nodes with a furniture word inside a longer class name, unless they hold such an element or most of
the page's characters outside links, as wrappers do.

Null pages count as empty; a page without text gives an empty string.  Pages of any length and depth are read whole.
Repeated rows are extracted alike.  A column of the result's name is replaced; other columns may have any name.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Element names of the HTML standard, and words of class and id attributes that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = frozenset(
    "script style head title noscript template iframe object embed svg math canvas audio video button select option textarea input label"
    " dialog".split()
)
ASIDES, WRAPPERS = frozenset("nav footer aside menu".split()), frozenset("form fieldset header".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs cookie cookies consent gdpr notice notices"
    " notification alert popup modal overlay nav navbar navigation menu footer masthead sidebar aside related recommended promo promotion"
    " sponsor sponsored share sharing social subscribe subscription newsletter signup login toolbar pagination pager skip copyright"
    " disclaimer topbar".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: With such a word a class name says something about its node's surroundings.
ABOUT = frozenset("has no with without enabled disabled count".split())
HEADERS = frozenset("header site-header page-header".split())
#: Blocks of running text.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure ul ol dl table hr br hgroup".split())
#: Share of link characters, and links, from which a node is a list of links.
LINKED, LINKS = 0.8, 2
#: End tags that an opening tag implies for open elements of the same parent.
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An implied end tag doesn't reach past these.
SCOPES = frozenset("ul ol dl table tbody thead tfoot tr td th article section div main body html blockquote figure".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?=/?[a-zA-Z!?])[^<]*\Z", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORDS = re.compile(r"[a-z0-9]+")
SPACES = re.compile(r"\s+")


#: What becomes of a node: stays, goes unless it holds most of the page or an article, unless an article, in any case.
STAYS, WEAK, STRONG, GOES = range(4)


class Node:
    __slots__ = ("tag", "children", "parent", "mark", "chars", "tags", "link_chars", "link_tags", "article", "density", "total")

    def __init__(self, tag: str, parent: Node | None, mark: int = STAYS):
        self.tag, self.parent, self.children, self.mark = tag, parent, [], mark
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.article = tag in ("article", "main")

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def is_links(self) -> bool:
        return self.link_tags >= LINKS and self.link_chars >= LINKED * self.chars


def mark_of(tag: str, attributes: str) -> int:
    if tag in DROPPED:
        return GOES
    mark = STRONG if tag in ASIDES else WEAK if tag in WRAPPERS else STAYS
    if not attributes or tag in ("body", "html", "article", "main"):
        return mark
    found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(attributes)}
    if re.search(r"(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub(" ", attributes), re.I) or found.get("aria-hidden") == "true":
        return GOES
    if re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
        return GOES
    if found.get("role", "").lower() in ROLES:
        mark = max(mark, WEAK if found["role"].lower() in ("form", "search", "banner") else STRONG)
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        words = WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if ABOUT.intersection(words):
            continue
        if COMMENTS.intersection(words) or name.lower() in FURNITURE:
            mark = max(mark, STRONG)
        elif FURNITURE.intersection(words) or name.lower() in HEADERS:
            mark = max(mark, WEAK)
    return mark


def parse(page: str) -> Node:
    """The DOM: nodes and strings as children; end tags that are missing or stray are tolerated."""
    root = here = Node("html", None)
    at = 0
    while (m := TOKEN.search(page, at)) is not None:
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                here = up.parent
            continue
        if tag in ("html", "body"):
            continue
        mark = mark_of(tag, m[3])
        if mark == WEAK and (tag == "header" or HEADERS.intersection(m[3].lower().split('"'))) and inside(here, ("article", "main", "section")):
            mark = STAYS
        if tag == "label" and not re.search(r"(?:^|\s)for\s*=", m[3], re.I) and inside(here, ("p", "li", "td", "dd")) and not inside(here, ("form", "fieldset")):
            mark = STAYS
        if tag in CLOSES_P:
            here = closed(here, {"p"}, root)
        if tag in SAME:
            here = closed(here, SAME[tag], root)
        node = Node(tag, here, mark)
        here.children.append(node)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path", "math"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if end is None:
                at = len(page)
            else:
                if mark != GOES:
                    node.children.append(page[at : end.start()])
                at = end.end()
            continue
        here = node
    if at < len(page):
        here.children.append(page[at:])
    return root


def inside(node: Node | None, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def closed(here: Node, tags: set[str], root: Node) -> Node:
    """``here`` after the implied end of an open element among ``tags``, if one is in scope."""
    up = here
    while up is not root and up.tag not in tags and up.tag not in SCOPES:
        up = up.parent
    if up is root or up.tag not in tags:
        return here
    return up.parent


def ordered(root: Node) -> list[Node]:
    """All nodes, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.nodes()
    return order


def count(order: list[Node]) -> None:
    """Characters, tags, link characters and link tags, and whether there's an article, from the leaves up."""
    for node in reversed(order):
        node.chars = sum(len(c) - c.count(" ") - c.count("\n") for c in node.children if isinstance(c, str))
        node.tags = node.link_chars = node.link_tags = 0
        for c in node.nodes():
            node.chars += c.chars
            node.tags += c.tags + 1
            node.link_chars += c.link_chars
            node.link_tags += c.link_tags + (c.tag == "a")
            node.article |= c.article
        if node.tag == "a":
            node.link_chars = node.chars


def without(order: list[Node], goes) -> None:
    for node in order:
        node.children = [c for c in node.children if isinstance(c, str) or not goes(c)]


def clear(root: Node) -> None:
    """Removes what can't be article text."""
    without(ordered(root), lambda c: c.mark == GOES)
    count(ordered(root))
    without(ordered(root), lambda c: c.mark == STRONG and not c.article)
    count(ordered(root))
    most = (root.chars - root.link_chars) / 2
    without(ordered(root), lambda c: c.mark == WEAK and not c.article and c.chars - c.link_chars <= most)


def density(chars: int, tags: int, link_chars: int, link_tags: int, base: float) -> float:
    if chars == link_chars:
        return 0.0
    # the base of the logarithm grows with the share of link characters, so that link lists become sparse
    base += chars / (chars - link_chars) * link_chars
    adjusted = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * math.log(max(adjusted, 1.0) + 1e-9) / max(math.log(base), 1.0)


def measure(root: Node) -> None:
    """Densities and density sums."""
    order = ordered(root)
    count(order)
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        if node.chars:
            node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share * node.chars + math.e)
    for node in order:
        own = node.chars - sum(c.chars for c in node.nodes())
        own = density(own, 0, 0, 0, share * own + math.e) if own and node.tag != "a" else 0.0
        node.total = own + sum(c.density for c in node.nodes())


def widened(best: Node, threshold: float) -> Node:
    """The subtree of the text that ``best`` lies in."""
    out, up = best, best
    while up is not None:
        if up.tag in ("article", "main"):
            out = up
        up = up.parent
    if out.tag in ("article", "main"):
        return out
    while out.parent is not None:
        up = out.parent
        beside = [c for c in up.nodes() if c is not out and c.chars]
        if not all(not c.is_links() and (c.density >= threshold or c.tag in TEXTUAL or c.tag not in BLOCKS) for c in beside):
            break
        out = up
    return out


def gather(node: Node, out: list[str], blocks: list[str], links: bool) -> None:
    """Texts of all blocks of the subtree in page order; ``out`` holds the open block's pieces.

    Lists of links are left out unless ``links``.
    """
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush(out, blocks)
        elif isinstance(x, str):
            out.append(x)
        elif x.tag in ("br", "hr"):
            out.append(" ")
        elif x.tag in BLOCKS and x.is_links() and x is not node and not links:
            flush(out, blocks)
        else:
            if x.tag in BLOCKS:
                flush(out, blocks)
                stack.append(None)
            stack += reversed(x.children)


def flush(out: list[str], blocks: list[str]) -> None:
    text = SPACES.sub(" ", entities.unescape("".join(out))).strip()
    if text:
        blocks.append(text)
    out.clear()


def main_text(page: str) -> str:
    root = parse(page)
    clear(root)
    measure(root)
    best = root
    for node in ordered(root):
        if node.total > best.total:
            best = node
    threshold, up = best.density, best
    while up is not root and up.parent is not root:
        up = up.parent
        threshold = min(threshold, up.density)
    best = widened(best, threshold)
    bounded = best.tag in ("article", "main")
    path, up = set(), best
    while up is not None:
        path.add(id(up))
        up = up.parent
    blocks: list[str] = []
    pending: list = [root]
    while pending:
        node = pending.pop()
        if node is not best and id(node) in path:
            # beside an article other articles of the page belong to its text, but teasers, lists and sections don't
            beside = lambda c: (c.tag == "article" if bounded else True) and c.chars and c.density >= threshold and not c.is_links()
            pending += reversed([c for c in node.nodes() if id(c) in path or beside(c)])
        else:
            out: list[str] = []
            # what an article lists is its own (its sources); menus in it are known by their elements and class names
            gather(node, out, blocks, inside(node, ("article",)))
            flush(out, blocks)
    return " ".join(blocks)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the HTML (all other columns kept)."""
    keep = [c for c in pages.columns if c not in (html_col, out_col)]
    schema = ", ".join([*[f"`{c}` {t}" for c, t in pages.dtypes if c in keep], f"`{out_col}` string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keep].assign(**{out_col: [main_text(x) for x in b["__html"]]})

    return pages.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(html_col), F.lit("")).alias("__html")).mapInPandas(run, schema)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every whole page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
