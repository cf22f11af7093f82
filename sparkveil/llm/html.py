"""HTML extraction by tree scoring.

The page becomes a tree of elements. Paragraphs pass points for their length and commas to
their ancestors, halved at each level; a container's points are discounted by its link
density. The best container is kept, with siblings that score or read like it. Inside it,
parts that are no article (menus, forms, notices, comments and so on) are left out.

Defined results for odd input: null counts as the empty page and gives the empty text;
unclosed tags, comments and scripts run to the end of what encloses them; a tag whose quotes
don't pair ends at its first bracket, and one that never ends is text up to the next tag;
repeated rows are read on their own. Time is linear in the page, whatever its tags and quotes:
open elements stand on a stack with the depths of each tag, and a text that no bracket follows
is not searched for tags.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .text import Block, per_block

FIELDS = [("text", T.StringType()), ("n_chars", T.LongType())]

#: Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
P_SCOPE = ("table", "td", "th", "button")
RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
#: Parts that are never article text.
DROP = frozenset("nav header footer aside form button input dialog menu".split()) | RAW | {"head"}
DROP_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|foot|masthead|header|comments?|comment-?list|respond|reply|replies|disqus|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|widget|pagination|pager|toolbar|skip|legal|copyright|outbrain|taboola)(?:[\s_-]|$)",
    re.I,
)
LIKELY = re.compile(r"article|body|content|entry|main|page|post|story|text|blog", re.I)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*+)")
#: What follows a tag's name: quoted values may hold brackets.
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: The same where quotes don't pair in the page: a value holds no tag, so what is scanned once isn't scanned again.
STRICT_REST = re.compile(r"((?:[^<>\"']++|\"[^<\"]*+\"|'[^<']*+')*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?list|respond|reply|replies|disqus)(?:[\s_-]|$)", re.I)
SPACES = re.compile(r"\s+")
#: Character references whose number is written with leading zeros, and those past the last code point.
ZEROS, PAST = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#(?:[1-9][0-9]{7,}+|[xX][1-9a-fA-F][0-9a-fA-F]{6,}+);?")
LEAST_PARAGRAPH, SIBLING_SHARE = 25, 0.2


class Node:
    __slots__ = ("tag", "parent", "parts", "name", "drop", "unlikely", "points", "chars", "links")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent, self.parts = tag, parent, []
        self.points, self.chars, self.links = 0.0, 0, 0
        self.name, self.drop, self.unlikely = "", tag in DROP, False
        if attributes and not self.drop and parent is not None:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            self.name = f"{found.get('class', '')} {found.get('id', '')}"
            semantic = tag in ("html", "body", "article", "main")
            self.drop = found.get("role", "").lower() in DROP_ROLE or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            # by its name alone; may be the wrapper of the article all the same
            self.unlikely = not self.drop and not semantic and bool(UNLIKELY.search(self.name))
            self.drop = self.drop or self.unlikely


class Reader:
    """Tags of a page, each byte looked at a bounded number of times."""

    def __init__(self, html: str):
        self.html, self.rest, self.last = html, REST, html.rfind(">")

    def tag(self, lt: int) -> tuple[int, str, bool, str] | None:
        """(end, name, whether it closes, attributes) of what starts here; no name: a comment or
        declaration. None: no tag."""
        html, n = self.html, len(self.html)
        mark = html[lt + 1 : lt + 2]
        if mark in ("!", "?") and mark:
            comment = html.startswith("<!--", lt)
            end = html.find("-->", lt + 4) if comment else html.find(">", lt)
            return (n if end < 0 else end + (3 if comment else 1)), "", False, ""
        name = NAME.match(html, lt) if lt < self.last else None
        if name is None:
            return None
        m = self.rest.match(html, name.end())
        if m is None:
            # quotes don't pair: the tag ends at its first bracket
            self.rest = STRICT_REST
            m = self.rest.match(html, name.end())
        end = m.end() if m else html.find(">", name.end()) + 1
        return end, name[1].lower(), mark == "/", html[name.end() : end - 1]


class Opened:
    """The elements that are open, and the depths at which those of each tag stand."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.stack))
        self.stack.append(node)

    def depth(self, tags) -> int:
        """Depth of the innermost open element of these tags; 0: none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, depth: int) -> None:
        """Closes the element at this depth and all inside it."""
        while depth and len(self.stack) > depth:
            self.at[self.stack.pop().tag].pop()


def tree(html: str) -> Node:
    root = Node("root", None)
    opened, read = Opened(root), Reader(html)
    at, n = 0, len(html)
    while at < n:
        node = opened.stack[-1]
        lt = html.find("<", at)
        if lt < 0:
            node.parts.append(html[at:])
            break
        found = read.tag(lt)
        if found is None:
            to = html.find("<", lt + 1) if lt < read.last else n
            to = n if to < 0 else to
            node.parts.append(html[at:to])
            at = to
            continue
        if lt > at:
            node.parts.append(html[at:lt])
        at, tag, closes, attributes = found
        if not tag:
            continue
        if closes:
            opened.close(opened.depth((tag,)))
            continue
        if tag in CLOSES_P:
            _close(opened, ("p",), P_SCOPE)
        elif tag in SAME:
            _close(opened, SAME[tag], SCOPE[tag])
        node = opened.stack[-1]
        child = Node(tag, node, attributes)
        node.parts.append(child)
        if tag in VOID or attributes.endswith("/") and tag not in INLINE and tag not in CLOSES_P:
            continue
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            at = end.end() if end else n
            continue
        opened.push(child)
    return root


def _close(opened: Opened, tags, scope) -> None:
    """Closes the innermost open element of these tags unless a scope element stands inside it."""
    depth = opened.depth(tags)
    if depth > opened.depth(scope):
        opened.close(depth)


def restore(root: Node) -> None:
    """Takes back drops by name of what wraps the article (say "has-sidebar"): it holds an article
    or main element and more than half of all text. Comments are never taken back."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in node.parts if isinstance(x, Node) and (not x.drop or x.unlikely))
    if not any(x.unlikely for x in order):
        return
    size: dict[int, int] = {}
    marked: dict[int, bool] = {}
    for node in reversed(order):
        parts = [x for x in node.parts if isinstance(x, Node) and id(x) in size]
        size[id(node)] = sum(len(x.strip()) for x in node.parts if isinstance(x, str)) + sum(size[id(x)] for x in parts)
        marked[id(node)] = node.tag in ("article", "main") and not UNLIKELY.search(node.name) or any(marked[id(x)] for x in parts)
    for node in order:
        if node.unlikely and marked[id(node)] and 2 * size[id(node)] > size[id(root)] and not COMMENTS.search(node.name):
            node.drop = False


def score(root: Node) -> list[Node]:
    """Gives points to containers; returns all kept elements in page order, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in reversed(node.parts) if isinstance(x, Node) and not x.drop)
    text: dict[int, int] = {}
    commas: dict[int, int] = {}
    for node in reversed(order):
        own = [x for x in node.parts if isinstance(x, str)]
        size, comma = sum(len(x.strip()) for x in own), sum(x.count(",") for x in own)
        inline, inline_comma = size, comma
        links = 0
        for x in node.parts:
            if isinstance(x, Node) and not x.drop:
                size += x.chars
                links += x.links
                if x.tag in INLINE:
                    inline += text[id(x)]
                    inline_comma += commas[id(x)]
        node.chars, node.links = size, size if node.tag == "a" else links
        text[id(node)], commas[id(node)] = inline, inline_comma
        if node.tag not in INLINE and inline >= LEAST_PARAGRAPH:
            points = 1 + inline_comma + min(inline / 100, 3)
            up, share = (node if node.tag not in ("p", "pre", "td", "blockquote", "li", "h1", "h2", "h3", "h4", "h5", "h6") else node.parent), 1.0
            while up is not None and share > 0.1:
                up.points += points * share
                up, share = up.parent, share / 2
    return order


def density(node: Node) -> float:
    return node.links / node.chars if node.chars else 0.0


def decode(text: str) -> str:
    """Character references decoded, however long their numbers are."""
    return unescape(PAST.sub("\ufffd", ZEROS.sub(r"&#\1", text)) if "&#" in text else text)


def extract(html: str) -> str:
    root = tree(html)
    restore(root)
    order = score(root)
    named = [x for x in order if x.tag in ("article", "main") and x.chars]

    def rank(node: Node) -> float:
        bonus = 1.5 if LIKELY.search(node.name) else 1.0
        return node.points * bonus * (2 if node.tag in ("article", "main") else 1) * (1 - density(node))

    best = max(order, key=rank, default=None)
    if best is None or rank(best) <= 0:
        # no paragraph is long enough to score: a marked article, else the longest text with few links
        best = max(named, key=lambda x: x.chars * (1 - density(x)), default=None) or next((x for x in order if x.tag == "body"), root)
    chosen = [best]
    if best.parent is not None:
        chosen = []
        least = max(5.0, SIBLING_SHARE * rank(best))
        for x in best.parent.parts:
            if x is best:
                chosen.append(x)
            elif isinstance(x, Node) and not x.drop and x.tag not in INLINE and (rank(x) >= least or x.tag in ("p", "article") and x.chars > 80 and density(x) < 0.25):
                chosen.append(x)
    blocks: list[str] = []
    piece: list[str] = []

    def flush() -> None:
        line = SPACES.sub(" ", decode("".join(piece))).strip()
        piece.clear()
        if line:
            blocks.append(line)

    todo: list[Node | str | None] = list(reversed(chosen))  # None ends a block
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            piece.append(x)
        elif not x.drop:
            if x.tag in ("br", "hr") or x.tag not in INLINE:
                flush()
                todo.append(None)
            todo.extend(reversed(x.parts))
    flush()
    return " ".join(blocks)


def _columns(block: Block, *_):
    out = [extract(block.text(i)) for i in range(block.n)]
    return [out, [len(x) for x in out]], None


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """One row per page: the kept columns, the article's text and its code points."""
    return per_block(pages, list(keep), html_col, _columns, FIELDS)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
