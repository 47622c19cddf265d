"""Main text of web pages by tree scoring.

A page is read into a tree of block elements.  Subtrees that never hold the
article (menus, page headers and footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments, hidden parts) are left out by their element,
role, class or id.  Every paragraph earns a point, one for each comma and one
for each hundred characters up to three; its parent gets the points, the
parent's parent half of them, and so on.  A container's points are discounted by
its link density.  The best container is widened to the ``article`` or ``main``
element around it, and kept with those siblings that score a fifth of its
points, or are headings or link-free paragraphs.

The result is the blocks of what is kept, in page order: character references
decoded, runs of white space (line-break elements included) made one blank,
trimmed, empty blocks left out, joined by one line feed.

Cases: a null or empty page, or one without text, gives an empty text; text
outside any element is a block of the body; unclosed and stray tags are
repaired; a null id or url is kept; repeated rows are results of their own; an
empty table gives an empty result; other columns are left alone.
A quote without its pair doesn't hide the rest of a page: a tag that would need the
quotes after it to end does so at its first ">".
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+|[^>]*+)>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")

# Element names by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = frozenset("head nav footer aside form button select option optgroup input label fieldset menu dialog search object audio video canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored sponsors promo promos promoted "
    "promotion banner banners popup popups modal overlay cookie cookies consent gdpr notice notices alert alerts newsletter subscribe subscription "
    "signup signin login register paywall share sharing shares social related recommended recommendations breadcrumb breadcrumbs menu menus nav "
    "navbar navigation footer masthead toolbar pagination pager sidebar sidebars rail widget widgets comment comments commentlist discussion "
    "disqus respond reply replies feedback reactions skip copyright disclaimer".split()
)
#: An open element of the left set ends where one of the right set starts.
ENDS = {
    "p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]), "option": frozenset(["option", "optgroup"]),
}
ENDED = {tag: tuple(t for t, new in ENDS.items() if tag in new) for tag in BLOCK}
SCOPES = frozenset("ul ol dl table article section main body".split())


class Node:
    """A block element: its text pieces and child elements in page order."""

    __slots__ = ("tag", "parent", "parts", "points", "out", "depth", "size", "linked", "inside")

    def __init__(self, tag: str, parent: "Node | None", out: bool = False):
        self.tag, self.parent, self.out = tag, parent, out
        self.parts: list = []
        self.points = 0.0
        self.size = self.linked = 0
        self.depth = parent.depth + 1 if parent else 0
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)


def _left_out(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element never holds the article."""
    if tag in LEFT_OUT or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        # a nested article may be a reader's comment
        if not (attributes and tag == "article" and in_article):
            return False
    words: set[str] = set()
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        name, value = (name or bare).lower(), (a or b or c).lower()
        if name in ("class", "id"):
            words.update(re.split(r"[^a-z0-9]+", value))
            words.update(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()))
        elif name == "role" and value in ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return bool(words & WORDS) or ("header" in words and not in_article)


def tree(page: str) -> Node:
    """The page's block elements; text is kept as (text, in a link)."""
    root = Node("body", None)
    node = root
    stack: list[tuple[str, Node]] = []  # open elements with the block that each is in
    held: dict[str, int] = defaultdict(int)  # how many elements of a name are open
    at, n, last = 0, len(page), page.rfind(">")

    def close(i: int) -> Node:
        for t, _ in stack[i:]:
            held[t] -= 1
        block = stack[i][1]
        del stack[i:]
        return block

    while at < n:
        lt = page.find("<", at)
        m = _TAG.match(page, lt) if 0 <= lt < last or page.startswith("<!--", lt) else None
        if lt < 0 or m is None:
            stop = n if lt < 0 else lt + 1
            node.parts.append((page[at:stop], held["a"] > 0))
            at = stop
            continue
        if lt > at:
            node.parts.append((page[at:lt], held["a"] > 0))
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag or tag in ("html", "body"):
            continue
        if m.group(1):
            if tag in ("br", "p") and not held[tag]:
                node.parts.append((" ", False))
                continue
            for i in range(len(stack) - 1, -1, -1) if held[tag] else ():
                if stack[i][0] == tag:
                    node = close(i)
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK:
                    break  # a stray inline end tag doesn't close blocks
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            if tag == "br":
                node.parts.append((" ", False))
            elif tag == "hr":
                node.parts.append(None)
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, -1, -1) if any(map(held.get, ENDED[tag])) else ():
                t = stack[i][0]
                if tag in ENDS.get(t, ()):
                    node = close(i)
                    if t in ("p", "li", "dt", "dd", "option", "tr"):
                        break
                elif t in SCOPES and not (t == "table" and tag == t):
                    break
            child = Node(tag, node, node.out or _left_out(tag, m.group(3), node.inside))
            node.parts.append(child)
            stack.append((tag, node))
            held[tag] += 1
            node = child
        else:
            if tag in LEFT_OUT or (m.group(3) and _left_out(tag, m.group(3), True)):
                child = Node(tag, node, True)
                node.parts.append(child)
                stack.append((tag, node))
                node = child
            else:
                stack.append((tag, node))
            held[tag] += 1
    return root


def _walk(root: Node):
    """All nodes below and with root, parents first."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(p for p in reversed(node.parts) if isinstance(p, Node))


def _flat(text: str) -> str:
    return " ".join(html.unescape(text).split())


def score(root: Node) -> Node | None:
    """Pass points up the tree; the best container, None without any text."""
    nodes = [x for x in _walk(root) if not x.out]
    for node in nodes:
        own = "".join(p[0] for p in node.parts if isinstance(p, tuple))
        text = _flat(own)
        node.size = len(text)
        node.linked = len(_flat("".join(p[0] for p in node.parts if isinstance(p, tuple) and p[1])))
        if not text:
            continue
        if node.tag in HEADING:
            continue
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - node.linked / max(1, len(text)))
        share, up = 1.0, node.parent if node.tag in ("p", "li", "td", "th", "dd", "dt", "pre", "blockquote") and node.parent else node
        while up is not None and share > 1e-3:
            up.points += points * share
            share, up = share / 2, up.parent
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
    scored = [x for x in nodes if x.size]
    if not scored:
        return None
    return max(scored, key=lambda x: (x.points * (1 - x.linked / x.size), -x.depth))


def _blocks(node: Node, out: list[str]) -> None:
    """Texts of the node's blocks, in page order."""
    todo: list = [node]
    piece: list[str] = []

    def end():
        if piece:
            text = _flat("".join(piece))
            if text:
                out.append(text)
            piece.clear()

    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, tuple):
            piece.append(x[0])
        elif not x.out:
            end()
            todo.append(None)
            todo.extend(reversed(x.parts))
        elif x.tag in BLOCK:
            end()
    end()


def extract(page: str | None) -> str:
    """The main text of one page."""
    root = tree(page or "")
    best = score(root)
    if best is None:
        return ""
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    out: list[str] = []
    around = best.parent
    if around is None:
        _blocks(best, out)
        return "\n".join(out)
    least = 0.2 * best.points * (1 - best.linked / max(1, best.size))
    for x in around.parts:
        if x is best:
            _blocks(x, out)
        elif isinstance(x, Node) and not x.out and x.size:
            density = x.linked / x.size
            if x.points and x.points * (1 - density) >= least or x.tag in HEADING and density < 0.5 or x.tag == "p" and density == 0:
                _blocks(x, out)
    return "\n".join(out)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text."""
    rows = pages.select(pages[id_col].alias(id_col), pages[url_col].alias(url_col), pages[html_col].cast("string").alias("__html"))
    schema = T.StructType([rows.schema[id_col], rows.schema[url_col], T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                texts = [extract(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    return rows.mapInArrow(run, schema)
