"""Main text of web pages by composite text density.

A page becomes a tree. Elements that never belong to an article (menus, footers, forms, scripts, notices, adverts, reader
comments and the like, told by their tag, role or class) are left out, unless a marked one holds the article. Every node then gets a density: its characters for
each tag, less where they are link text. The subtree whose children have the largest sum of densities is the article; the
smallest density on its path up to the body is the threshold over which other parts are text as well.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes plaintext iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody"
    " td tfoot th thead tr ul".split()
)
LEFT_OUT = frozenset(
    "nav footer aside form script style noscript template iframe svg canvas object applet button select textarea input label"
    " dialog menu head title audio video map math xmp noembed noframes search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion promoted banner"
    " cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup"
    " sidebar sidenav navbar nav navigation menu topbar breadcrumb breadcrumbs masthead footer copyright comment comments"
    " commentlist disqus replies respond discussion share sharing social related recommended recommendations recirculation"
    " widget widgets toolbar login pagination pager tagcloud skip paywall toc disclaimer".split()
)
#: Elements that hold an article as a whole and are never left out for their class.
FRAMES = frozenset("html body main article".split())
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element: its name, children (nodes and texts in order), and counts of characters and tags, in links or not."""

    __slots__ = ("name", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "marked")

    def __init__(self, name: str):
        self.name, self.children = name, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.marked = False


def _closed_by(opened: str, name: str) -> bool:
    """Whether the start of ``name`` ends an open ``opened`` that has no end tag."""
    if opened == "p":
        return name in BLOCKS
    if opened in ("td", "th"):
        return name in ("td", "th", "tr", "tbody", "tfoot", "thead")
    if opened in ("dt", "dd"):
        return name in ("dt", "dd")
    if opened == "tr":
        return name in ("tr", "tbody", "tfoot", "thead")
    return opened == name and opened in ("li", "option")


#: An open element that an end tag or an implied end does not reach beyond.
_SCOPE = frozenset("html body table td th ul ol dl article section main div blockquote".split())


def _unwanted(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is left out for its tag; ``inside``: it lies in an article or main element."""
    return name in LEFT_OUT and name != "form" or name == "header" and not inside


def _marked(name: str, attributes: str) -> bool:
    """Whether an element is a form or its class, id or role speaks against it; ``prune`` looks at what it holds."""
    if name == "form":
        return True
    if name in FRAMES and name != "article" or "=" not in attributes:
        return False
    for kind, a, b, c in _ATTRIBUTE.findall(attributes):
        value = unescape(a or b or c)
        if kind.lower() == "role":
            if value.strip().lower() in ROLES:
                return True
        else:
            words = _SPLIT.split(_CAMEL.sub(" ", value).lower())
            if name == "article":
                # reader comments are often articles of their own
                if not {"comment", "comments", "reply"}.isdisjoint(words):
                    return True
            elif not WORDS.isdisjoint(words):
                return True
    return False


def parse(html: str) -> Node:
    """The tree below the page's root, without comments and what is left out."""
    root = Node("html")
    stack: list[tuple[str, Node | None]] = [("html", root)]
    skipping = 0  # how many of the open elements are left out
    lower: str | None = None
    at, end = 0, len(html)
    for_token = _TOKEN.search
    while at < end:
        found = for_token(html, at)
        start = found.start() if found else end
        if start > at and not skipping:
            stack[-1][1].children.append(html[at:start])
        if not found:
            break
        at = found.end()
        if found[1]:
            name = found[1].lower()
            if name == "br":
                if not skipping:
                    stack[-1][1].children.append(Node("br"))
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            # an inline end tag does not close the blocks around it
            if depth and (name in BLOCKS or not any(n in BLOCKS for n, _ in stack[depth + 1 :])):
                for _, node in stack[depth:]:
                    skipping -= node is None
                del stack[depth:]
        elif found[2] or found[4]:
            name, attributes = (found[2] or found[4]).lower(), found[3] or found[5] or ""
            if name in ("html", "body"):
                continue
            if name in BLOCKS or name in ("option",):
                for i in range(len(stack) - 1, 0, -1):
                    if _closed_by(stack[i][0], name):
                        for _, node in stack[i:]:
                            skipping -= node is None
                        del stack[i:]
                        break
                    if stack[i][0] in _SCOPE:
                        break
            inside = any(n in ("article", "main") for n, _ in stack)
            out, marked = _unwanted(name, attributes, inside), _marked(name, attributes)
            if name in RAW:
                if lower is None:
                    lower = html.lower() if len(html.lower()) == end else html
                close = lower.find(f"</{name}", at)
                if not out and not skipping:
                    node = Node(name)
                    node.marked = marked
                    node.children.append(html[at : close if close >= 0 else end])
                    stack[-1][1].children.append(node)
                at = end if close < 0 else (html.find(">", close) + 1 or end)
                continue
            if name in VOID or attributes.endswith("/") and name not in BLOCKS:
                if not skipping and name in ("br", "hr", "img", "wbr"):
                    stack[-1][1].children.append(Node(name))
                continue
            if name != "head" and stack[-1][0] == "head":
                # a body without its tag
                if name not in ("meta", "link", "base", "script", "style", "template", "noscript", "title"):
                    skipping -= stack.pop()[1] is None
            node = None if skipping or out else Node(name)
            if node:
                node.marked = marked
                stack[-1][1].children.append(node)
            else:
                skipping += 1
            stack.append((name, node))
    prune(root)
    return root


def prune(root: Node) -> None:
    """Takes out the marked elements, but none that holds an article, main or h1 element of its own.

    Of a page that has no such element, those around the subtree with the largest density sum stay too.
    """
    order, parents = [root], {}
    for node in order:
        for child in node.children:
            if isinstance(child, Node):
                parents[child] = node
                order.append(child)
    if not any(n.marked for n in order):
        return
    stay: set[Node] = set()
    anchors = [n for n in order if n.name in ("article", "main", "h1") and not n.marked]
    if not anchors:
        measure(root)
        anchors = [max((n for n in order), key=lambda n: n.total)]
        for n in order:
            n.chars = n.tags = n.link_chars = n.link_tags = 0
    for node in anchors:
        while node is not None and node not in stay:
            stay.add(node)
            node = parents.get(node)
    for node in order:
        if any(isinstance(c, Node) and c.marked and c not in stay for c in node.children):
            node.children = [c for c in node.children if isinstance(c, str) or not c.marked or c in stay]


def measure(root: Node) -> None:
    """Counts, densities and density sums of all nodes, children before parents."""
    order, todo = [], [(root, False)]
    while todo:
        node, linked = todo.pop()
        order.append((node, linked))
        todo.extend((c, linked or node.name == "a") for c in node.children if isinstance(c, Node))
    for node, linked in reversed(order):
        in_link = linked or node.name == "a"
        for child in node.children:
            if isinstance(child, Node):
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.name == "a")
            else:
                size = len(" ".join(unescape(child).split())) if "&" in child else len(" ".join(child.split()))
                node.chars += size
                node.link_chars += size * in_link
    ratio = root.link_chars / max(1, root.chars)
    for node, _ in order:
        if node.chars:
            # as in the formula of composite text density, counts of 0 under a fraction are taken as 1
            tags, links, anchors = max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
            free = max(1, node.chars - node.link_chars)
            base = log(node.chars / free * node.link_chars + ratio * node.chars + e)
            node.density = node.chars / tags * max(0.0, log(node.chars / links * tags / anchors)) / max(1.0, log(base))
    for node, _ in order:
        node.total = sum(c.density for c in node.children if isinstance(c, Node))


def select(root: Node) -> list[Node]:
    """The nodes that hold the main text, in page order.

    The subtree with the largest density sum is looked for inside article and main elements if the page has any with text,
    else everywhere. The smallest density on the way from it to the body is the threshold: parts beside the way that reach
    it belong to the article too. An outermost article or main element is one part, taken as a whole.
    """
    measure(root)
    parents: dict[Node, Node] = {}
    frames: list[Node] = []
    best, frame_of_best, todo = None, None, [(root, None)]
    while todo:
        node, frame = todo.pop()
        if frame is None and node.name in ("article", "main") and node.chars:
            frame = node
            frames.append(node)
        # a frame comes before any sum of densities, the first of equals before later ones
        if node.chars and (best is None or (frame is not None, node.total) > (frame_of_best is not None, best.total)):
            best, frame_of_best = node, frame
        for child in reversed(node.children):
            if isinstance(child, Node):
                parents[child] = node
                todo.append((child, frame))
    if best is None:
        return []
    way, threshold, node = {best}, best.density, best
    while node in parents:
        node = parents[node]
        way.add(node)
        threshold = min(threshold, node.density)
    if frames:
        return [f for f in frames if f is frame_of_best or f.density >= threshold]
    chosen: list[Node] = []
    branches = [root]
    while branches:
        node = branches.pop()
        if node is best or node not in way and node.chars and node.density >= threshold:
            chosen.append(node)
        elif node in way:
            if any(isinstance(c, str) and c.strip() for c in node.children):
                chosen.append(node)  # it has text of its own beside the densest part
            else:
                branches.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return chosen


def blocks_of(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order: references decoded, white space as one space, trimmed, none empty."""
    found, line = [], []

    def close() -> None:
        text = " ".join(unescape("".join(line)).split())
        if text:
            found.append(text)
        line.clear()

    for top in nodes:
        todo: list[Node | str | None] = [None, top, None]
        while todo:
            node = todo.pop()
            if node is None:
                close()
            elif isinstance(node, str):
                line.append(node)
            elif node.name == "br":
                line.append("\n")
            else:
                inner = list(reversed(node.children))
                todo.extend([None, *inner, None] if node.name in BLOCKS else inner)
    return found


def extract(html: str | None) -> str:
    """The main text of a page: its blocks joined by line feeds; '' if there is none or the page is null."""
    if not html:
        return ""
    return "\n".join(blocks_of(select(parse(html))))


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with main_text from the whole html, a column of that name being replaced. Rows keep their place."""

    @F.pandas_udf("string")
    def made(column: pd.Series) -> pd.Series:
        return pd.Series([extract(x) for x in column], dtype=object)

    return pages.withColumn("main_text", made(F.col(html)))
