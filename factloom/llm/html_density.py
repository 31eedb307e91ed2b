"""Main-text extraction by composite text density.

A page becomes a tree (implied ends of paragraphs, list items, table cells and options; void and raw-text elements; unclosed
elements end with their parent; formatting elements are transparent).  What HTML itself declares not to be article text is not
in it: raw text, navigation, asides, footers, page headers, controls, media, hidden elements.

For every node: characters C, tags T, link characters LC and link tags LT of its subtree.  Its density is C / T adjusted
for links: times log((C / LC) * (T / LT)) to the base ln(C / nLC * LC + LCb / Cb * C + e), e at least, where nLC are characters outside
links and the index b means the body.  A node's body-path threshold is the least density on its path to the body, and
its density sum that of those children (and of its own text) that reach this threshold.  The subtree with the largest sum, the
deepest of equal ones, is the core, and its threshold decides about everything else:

* A core inside an article or main element grows to that element; then only other article elements that reach the
  threshold join it.
* Any other core grows over wrappers whose further children all reach the threshold with a density sum of at least one
  ``BESIDE``-th of the core's, are headings or hold one, or are text blocks with less text in links than outside, or lists
  of links between texts.  Elsewhere the largest-sum subtrees of nodes that reach threshold and sum join it: a notice or a
  footer is dense text, but its sum is small.  Of the body, or a wrapper of all its text, containers below the threshold
  go, unless they hold the h1.
* If the core has no h1, those before it beside its ancestors join it.

Priors only weigh densities: inside article and main they count ``PRIOR`` times; inside forms, landmark roles, articles
nested in articles, and elements of which a whole class or id says so (``comments``, ``ad-slot``; not ``article-header`` or
``share-price``) they count one ``PRIOR``-th.  Such elements go from the core too, those named for page furniture excepted; but one that holds
more than ``PRIOR`` times the text that is in none, or that the core lies in, is as any other.

Text of a block has its white space turned into single spaces; blocks are joined by one space in page order.

Defined results: null, empty and tagless inputs give their own text (null: empty); a page without a body is treated as one;
pages without any content give an empty text; a damaged end of a page ends all open elements; other columns are ignored; rows that
repeat an id are extracted each; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, require

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
INLINE = frozenset(
    "abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: An open element of the second kind ends when one of the first begins; it isn't looked for beyond the third kind.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: A paragraph outside these isn't ended from inside them.
P_SCOPES = frozenset("button table td th article section div".split())
LEFT_OUT = frozenset("nav aside footer button select input dialog canvas audio video object embed menu head datalist".split())
FORMS = frozenset("form fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Names of what stands inside articles without being part of them, of page furniture, and what may go with either in a name.
INSERTS = frozenset(
    "ad ads advert adverts advertisement comment comments disqus respond replies share sharing social related recommended newsletter subscribe cookie cookies consent promo sponsored sidebar".split()
)
FURNITURE = frozenset("banner breadcrumb breadcrumbs copyright disclaimer footer header login masthead menu nav navbar navigation notice pagination popup topbar toolbar widget".split())
JOINTS = frozenset("area bar block box buttons container inner item items left links list page posts right section site slot top bottom unit wrap wrapper".split())
KEEPS = frozenset("article main body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TEXT_BLOCKS = frozenset("p pre blockquote ul ol dl table figure address li dt dd details hr".split())
#: Weight of priors, and how much more text than all others a named element must hold to be the main part.
PRIOR = 4
#: Beside the core, a subtree's density sum must be at least one BESIDE-th of the core's.
BESIDE = 2

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_PART = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "kind", "in_p", "chars", "tags", "link_chars", "link_tags", "own", "density", "least", "total", "best", "best_node", "h1", "content", "dropped")

    def __init__(self, tag: str, parent: Node | None, kind: int = 0):
        self.tag, self.parent, self.children, self.kind = tag, parent, [], kind
        self.in_p = tag == "p" or (parent is not None and parent.in_p and tag not in P_SCOPES)  # whether a paragraph is open that may end here
        self.chars = self.tags = self.link_chars = self.link_tags = self.own = 0
        self.density = self.least = self.total = 0.0
        self.content, self.dropped, self.h1, self.best, self.best_node = False, False, False, -1.0, self

    def nodes(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str)]


OUT, INSERT, FURNISHING, MAIN = 1, 2, 3, 4


def _named(value: str) -> int:
    """Kind of element that a class or id names: a whole name, or all parts of it, must say so."""
    found = 0
    for name in value.split():
        parts = _PART.findall(name)
        if parts and all(p in INSERTS or p in FURNITURE or p in JOINTS for p in parts):
            if not INSERTS.isdisjoint(parts):
                return INSERT
            if not FURNITURE.isdisjoint(parts):
                found = FURNISHING
    return found


def _kind(tag: str, attributes: str, opened: dict[str, int]) -> int:
    """What the markup says about an element inside those opened: OUT if it is never article text, INSERT, FURNISHING, MAIN, or 0."""
    if tag in LEFT_OUT or tag in RAW:
        return OUT
    if tag == "header" and not any(opened.get(t) for t in ("article", "main", "section")):
        return OUT
    kind = MAIN if tag in ("article", "main") else INSERT if tag in FORMS else 0
    if tag == "article" and opened.get("article"):
        kind = INSERT
    if not attributes or attributes == "/":
        return kind
    for m in _ATTR.finditer(attributes):
        name = m[1].lower()
        value = (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return OUT if tag not in KEEPS else kind
        if tag in KEEPS or tag in HEADINGS:
            continue
        if name == "role":
            kind = MAIN if value in ("main", "article") else INSERT if value in ROLES else kind
        elif name in ("class", "id") and kind != INSERT:
            kind = _named(value) or kind
    return kind


def parse(source: str) -> Node:
    """The tree; texts are strings among the children."""
    root = node = Node("html", None)
    depth_out: list[str] = []  # open elements inside one that is left out
    opened = {"html": 1}  # how many elements of each tag are open

    def rise(to: Node) -> Node:
        at = node
        while at is not to:
            opened[at.tag] -= 1
            at = at.parent
        return to

    at, size = 0, len(source)
    while at < size:
        m = _TAG.search(source, at)
        stop = m.start() if m else size
        if stop > at and not depth_out:
            node.children.append(html.unescape(source[at:stop]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if depth_out:
                if tag in depth_out:
                    while depth_out.pop() != tag:
                        pass
                    continue
                if tag == "p" or tag not in ENDS_P | KEEPS or not opened.get(tag):
                    continue
                depth_out.clear()  # what is left out was never closed and ends with its parent
            if tag in INLINE or not opened.get(tag):
                continue
            up = node
            while up.parent and up.tag != tag:
                up = up.parent
            if up.parent:
                node = rise(up.parent)
            continue
        closed = m[3].endswith("/")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at) if not closed else None
            at = end.end() if end else (at if closed else size)
            continue
        if depth_out:
            if tag not in VOID and not closed:
                _close_implied(depth_out, tag)
                depth_out.append(tag)
            continue
        if tag in ENDS_P:
            node = rise(_close(node, {"p"}, P_SCOPES)) if node.in_p else node
        if tag in ENDS and any(opened.get(t) for t in ENDS[tag][0]):
            node = rise(_close(node, *ENDS[tag]))
        if tag == "html" or (tag == "body" and opened.get("body")):
            continue
        if tag == "br":
            node.children.append("\n")
            continue
        kind = _kind(tag, m[3], opened)
        if kind == OUT:
            if tag not in VOID and not closed:
                depth_out.append(tag)
            continue
        if tag in INLINE:  # formatting is no node: it would dilute the densities of what it formats
            continue
        child = Node(tag, node, kind)
        node.children.append(child)
        if tag not in VOID and not closed:
            node = child
            opened[tag] = opened.get(tag, 0) + 1
    return root


def _close(node: Node, ended: set[str], beyond: set[str]) -> Node:
    """The parent of the outermost open element of ``ended``, if one is open before any of ``beyond``."""
    up, found = node, None
    while up.parent and up.tag not in beyond:
        if up.tag in ended:
            found = up
        up = up.parent
    return found.parent if found else node


def _close_implied(stack: list[str], tag: str) -> None:
    ended, beyond = ({"p"}, {"div", "section"}) if tag in ENDS_P else ENDS.get(tag, ((), ()))
    for i in range(len(stack) - 1, 0, -1):
        if stack[i] in beyond:
            return
        if stack[i] in ended:
            del stack[i:]
            return


def _order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.nodes()))
    return out


def _within(node: Node | None, top: Node) -> bool:
    while node and node is not top:
        node = node.parent
    return node is top


def composite(chars: int, tags: int, link_chars: int, link_tags: int, body_ratio: float) -> float:
    """Characters a tag, adjusted for links."""
    if not chars:
        return 0.0
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_ratio * chars + math.e)
    return chars / t * math.log(max(chars / lc * (t / lt), 1.0)) / max(math.log(base), 1.0)


def count(body: Node) -> list[Node]:
    """Fills in characters, tags and links of every node; the nodes, in page order."""
    nodes = _order(body)
    for n in reversed(nodes):
        n.h1 = n.tag == "h1"
        for c in n.children:
            if isinstance(c, str):
                n.own += len("".join(c.split()))
            else:
                n.chars += c.chars
                n.tags += 1 + c.tags
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags + (c.tag == "a")
                n.h1 |= c.h1
        n.chars += n.own
        if n.tag == "a":
            n.link_chars = n.chars
    return nodes


def spare(nodes: list[Node]) -> None:
    """Takes the mark from elements that hold the page's main part, and from those around them."""
    inside: dict[Node, Node | None] = {}
    sizes: dict[Node | None, int] = {None: 0}
    for n in nodes:
        inside[n] = n if n.kind in (INSERT, FURNISHING) else inside.get(n.parent)
        linked = n.tag == "a"
        sizes[inside[n]] = sizes.get(inside[n], 0) + (0 if linked else n.own)
    node = max(sizes, key=lambda n: sizes[n])
    if sizes[node] > PRIOR * sizes[None]:  # comments can be longer than what they are about
        while node:
            node.kind = 0 if node.kind in (INSERT, FURNISHING) else node.kind
            node = node.parent


def measure(nodes: list[Node]) -> Node:
    """Fills in weighed densities, body-path thresholds and density sums; the deepest node with the largest sum."""
    body = nodes[0]
    ratio = body.link_chars / max(body.chars, 1)
    weight: dict[Node, float] = {}
    for n in nodes:
        above = weight.get(n.parent, 1.0)
        weight[n] = 1 / PRIOR if n.kind in (INSERT, FURNISHING) or above < 1 else PRIOR if n.kind == MAIN else above
        n.density = composite(n.chars, n.tags, n.link_chars, n.link_tags, ratio) * weight[n]
        n.least = n.density if n is body else min(n.density, n.parent.least)
    for n in reversed(nodes):
        inner = n.nodes()
        parts = [c.density for c in inner]
        if n.own or not inner:
            parts.append(composite(n.own, 1, n.own if n.tag == "a" else 0, 0, ratio) * weight[n])
        n.total = sum(x for x in parts if x >= n.least)
        n.best, n.best_node = n.total, n
        for c in inner:
            if c.best >= n.best and c.best > 0:
                n.best, n.best_node = c.best, c.best_node
    return body.best_node


def _dense(n: Node, threshold: float, core: Node | None) -> bool:
    """Whether a subtree reaches the threshold and, beside a core, holds a comparable sum of densities: a notice or a footer of plain text is dense, but little."""
    return n.density >= threshold and (core is None or n.tag in TEXT_BLOCKS or n.best * BESIDE >= core.best)


def _joining(nodes: list[Node], threshold: float, core: Node | None = None) -> list[bool]:
    """Which children of a wrapper belong to the text."""

    def joins(n: Node) -> bool:
        if not n.chars or n.tag in HEADINGS or n is core or _dense(n, threshold, core):
            return True
        if n.kind in (INSERT, FURNISHING):
            return False
        return (n.h1 or n.tag in TEXT_BLOCKS) and 2 * n.link_chars < n.chars

    found = [joins(n) for n in nodes]
    last = max((i for i, n in enumerate(nodes) if found[i] and n.chars), default=-1)
    begun = False
    for i, n in enumerate(nodes):  # a list of links may stand between texts
        begun |= n is core or n.density >= threshold > 0
        found[i] |= begun and i < last and n.tag in TEXT_BLOCKS and n.kind == 0
    return found


def select(nodes: list[Node]) -> None:
    """Marks content subtrees."""
    body = nodes[0]
    if not body.chars:
        return
    core = measure(nodes)
    threshold = core.least
    node = core
    while node is not body.parent:  # what the core lies in isn't beside the text
        node.kind = 0 if node.kind in (INSERT, FURNISHING) else node.kind
        node = node.parent
    around = [n for tag in ("article", "main") if (n := _enclosing(core, body, tag))]
    if around:
        core = around[0]
        core.content = True
        for n in nodes:
            if n.kind == MAIN and n.tag == "article" and n.density >= threshold and not _within(core, n) and not _within(n, core):
                n.content = True
    else:
        while core is not body and core.parent.chars < body.chars and all(_joining(core.parent.nodes(), threshold, core)):
            core = core.parent
        _elsewhere(body, core, threshold)
        if core.chars == body.chars:
            _screen(core, threshold)
        else:
            core.content = True
    for n in nodes:
        n.dropped = n.kind == INSERT
    if not core.h1:
        node = core
        while node is not body:
            up = node.parent
            for c in up.nodes():
                if c is node:
                    break
                if c.tag == "h1" and c.kind == 0:
                    c.content = True
            node = up


def _enclosing(node: Node, body: Node, tag: str) -> Node | None:
    """The innermost element of main text around a node: an article, or else what is main by tag or role."""
    while node is not body.parent:
        if node.kind == MAIN and (node.tag == "article") == (tag == "article"):
            return node
        node = node.parent
    return None


def _elsewhere(body: Node, core: Node, threshold: float) -> None:
    """Marks the largest-sum subtree inside every node outside the core that reaches the threshold."""
    above, node = set(), core
    while node is not None:
        above.add(node)
        node = node.parent
    stack = [body]
    while stack:
        n = stack.pop()
        if n is core or not n.chars:
            continue
        if _dense(n, threshold, core) and n not in above:
            n.best_node.content = True
            if n.best_node is n:
                continue
        stack.extend(n.nodes())


def _screen(core: Node, threshold: float) -> None:
    """Marks what belongs to the text in a core that holds all of the body's text."""
    while len(core.nodes()) == 1 and core.nodes()[0].chars == core.chars:
        core = core.nodes()[0]
    joining = _joining(core.nodes(), threshold)
    if all(joining):
        core.content = True
        return
    for c, joins in zip(core.nodes(), joining, strict=True):
        c.content = joins or c.h1
    core.children = [c if not isinstance(c, str) else _text(core, c) for c in core.children]


def _text(parent: Node, text: str) -> Node:
    node = Node("#text", parent)
    node.children, node.content = [text], True
    return node


def text_of(body: Node) -> str:
    """Text of the content, block by block."""
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    stack: list[tuple[object, bool]] = [(body, body.content)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            if inside:
                run.append(item)
        else:
            if item.dropped:
                end()
                continue
            inside = inside or item.content
            if item.tag not in ("a", "#text"):
                end()
                stack.append((None, False))
            stack.extend((c, inside) for c in reversed(item.children))
    end()
    return " ".join(blocks)


def extract(source: str | None) -> str:
    """Main text of a page."""
    if not source:
        return ""
    root = parse(source)
    nodes = count(next((n for n in _order(root) if n.tag == "body"), root))
    spare(nodes)
    select(nodes)
    return text_of(nodes[0])


def extract_pages(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points)."""
    require(pages, id_col, url_col, html_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(x.as_py()) for x in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(per_batch(run), "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
