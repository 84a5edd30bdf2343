"""Main text of HTML pages by scoring the tree.

A page is read into a tree of elements. Every paragraph earns points for its length
and its commas and passes them to its ancestors, less the further up; a container's
points are discounted by the share of its text that is in links. The best container
and those of its siblings that look like content are kept, without menus, headers,
footers, sidebars, notices, adverts, forms, scripts and reader comments. What only its
tag, class or id marks as one of these is kept after all if it holds most of the page's
long, link-poor paragraphs and little is left without it. Inside an article such a mark
only counts against what is short, link-heavy or form-like, or whose whole class or id
says what it is: a section called "search-algorithms" stays. Articles beside the best one
are kept if they pass the test for siblings.

Results for odd input: NULL, empty or text-less html gives empty text; of equal
scores the earlier container wins; unclosed, misnested and unknown elements are read
as browsers do, roughly; very long and very deep pages are read whole in time linear in
both; repeated rows get equal results; an empty table gives no rows. Other columns are
carried, not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions import col
from plurality.llm.batches import slices

# How elements behave.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd dt figcaption".split()) | HEADINGS
CONTAINERS = frozenset("article main section div body td blockquote center dl ul ol".split())
# Never content.
DROPPED = RAW | frozenset(
    "head button select option input noscript template svg math canvas object applet audio "
    "video map".split()
)
# Not content unless it holds most of the page.
DOUBTED = frozenset("nav header footer aside form label fieldset dialog menu".split())
# What an opening tag closes: the element, up to but without the stop.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Words in a class, id or role that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo "
    "promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs header masthead "
    "footer footnav sidebar sidebars aside widget widgets related recommended recommendations "
    "share sharing social cookie cookies consent gdpr notice notices alert alerts popup modal "
    "overlay newsletter subscribe subscription signup login search comment comments commentlist "
    "disqus replies respond form pagination pager toolbar skip copyright contentinfo "
    "complementary dialog outbrain taboola toc tags".split()
)
# Words that mark long paragraphs of others: these give way to any text beside them.
FOREIGN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors cookie cookies "
    "consent gdpr popup newsletter subscribe subscription comment comments commentlist disqus "
    "replies respond outbrain taboola copyright".split()
)
# Words that add nothing to a marking one: with them alone a name still marks.
NEUTRAL = frozenset(
    "box list left right top bottom block container wrapper wrap area bar item items link links "
    "button buttons inner outer panel module section group col column content page site global "
    "primary secondary small large mobile desktop sticky fixed row grid text icon icons title "
    "heading label body new center post posts article articles story stories more all user "
    "reader readers slot unit google policy message this us follow on your our the latest "
    "popular trending read result results".split()
)
CONTROLS = frozenset("input button select textarea".split())
# Rescue: characters of a long paragraph, links' share in it, how often the points left
# without a node must fit into its own, and characters that count as text beside it.
LONG_CHARS, MOST_LINKED, TIMES_REST, TEXT_BESIDE = 80, 0.25, 3.0, 100
_ROOTS = frozenset("html body article main".split()) | HEADINGS
_NEGATED = frozenset({"has", "with", "no", "without"})

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)"
    r"(?P<attrs>(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(
    r"(?P<name>[^\s=\"'/>]+)\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s\"'>]+))"
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WHITE = re.compile(r"\s+")


class Node:
    """An element: its tag, and texts and elements in page order."""

    __slots__ = ("tag", "dropped", "doubt", "hint", "parent", "children", "score", "chars", "linked")

    def __init__(
        self,
        tag: str,
        parent: Node | None,
        dropped: bool = False,
        doubt: int = 0,
        hint: bool = False,
    ):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        # 1: marked by tag, class, id or role; 2: marked as foreign. A hint: by one word
        # of a longer name only.
        self.doubt, self.hint = doubt, hint
        self.children: list[Node | str] = []
        self.score = 0.0
        self.chars = self.linked = 0


def parse(page: str) -> Node:
    """The element tree of a page; dropped elements stay as empty nodes, doubted ones whole."""
    root = here = Node("html", None)
    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        start = n if start < 0 else start
        if start > at and not here.dropped:
            here.children.append(html.unescape(page[at:start]))
        if start == n:
            break
        token = _TOKEN.match(page, start)
        if not token:
            if not here.dropped:
                here.children.append("<")
            at = start + 1
            continue
        at = token.end()
        if not token["tag"]:
            if token[0].startswith("<![CDATA[") and not here.dropped:
                here.children.append(token[0][9:-3])
            continue
        tag = token["tag"].lower()
        if token["end"]:
            here = _closed(here, tag)
            continue
        here = _made_room(here, tag)
        attrs = token["attrs"]
        hidden, doubt, hint = _marks(tag, attrs)
        node = Node(tag, here, here.dropped or tag in DROPPED or hidden, doubt, hint)
        here.children.append(node)
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = closing.end() if closing else n
        elif tag not in VOID and not (attrs.endswith("/") and tag not in BLOCKS):
            here = node
    return root


def _closed(here: Node, tag: str) -> Node:
    """Where parsing goes on behind a closing tag; a stray one is ignored."""
    node = here
    while node and node.tag != tag:
        # An inline closing tag does not reach across a block.
        if tag not in BLOCKS and node.tag in BLOCKS:
            return here
        node = node.parent
    if node is None or node.parent is None:
        return here
    return node.parent


def _made_room(here: Node, tag: str) -> Node:
    """Close what an opening tag implicitly ends."""
    if tag in BLOCKS:
        node = here
        while node and node.tag not in BLOCKS:
            node = node.parent
        if node and node.parent and (
            node.tag == "p" or node.tag in HEADINGS and tag in HEADINGS
        ):
            here = node.parent
    if tag in CLOSES:
        ends, stops = CLOSES[tag]
        node, last = here, None
        while node and node.tag not in stops:
            if node.tag in ends:
                last = node
            node = node.parent
        if last and last.parent:
            here = last.parent
    return here


def _marks(tag: str, attrs: str) -> tuple[bool, int, bool]:
    """Whether an element is hidden, its doubt, and whether that is a hint (see :class:`Node`)."""
    sure, hinted = int(tag in DOUBTED), 0
    if not attrs or attrs.isspace():
        return False, sure, False
    for m in _ATTR.finditer(attrs):
        name, value = m["name"].lower(), m["a"] or m["b"] or m["c"] or ""
        if name in ("class", "id", "role"):
            for token in value.split():
                doubt, whole = _token_doubt(token)
                if whole:
                    sure = max(sure, doubt)
                else:
                    hinted = max(hinted, doubt)
        elif name == "style" and _HIDDEN.search(value):
            return True, 0, False
        elif name == "aria-hidden" and value.lower() == "true":
            return True, 0, False
    if re.search(r"(?:^|\s)hidden(?:\s|$)", attrs):
        return True, 0, False
    if tag in _ROOTS:
        # An article within or beside the article may be a reader's comment.
        return False, 2 if tag == "article" and sure == 2 else 0, False
    return False, sure or hinted, not sure and hinted > 0


def _token_doubt(token: str) -> tuple[int, bool]:
    """The doubt that one class or id gives, and whether all of it says so."""
    words = [w.lower() for w in _WORD.findall(token)]
    marking = [
        w for before, w in zip(["", *words], words) if w in BOILERPLATE and before not in _NEGATED
    ]
    if not marking:
        return 0, False
    whole = all(w in BOILERPLATE or w in NEUTRAL or len(w) == 1 or w.isdigit() for w in words)
    return 2 if FOREIGN.intersection(marking) else 1, whole


def clear(order: list[Node]) -> None:
    """Take back doubts about what reads like the article's own text."""
    inside: set[int] = set()
    sizes: dict[int, list[int]] = {id(node): [0, 0, 0] for node in order}
    for node in order:
        if node.tag == "article" or id(node.parent) in inside:
            inside.add(id(node))
    for node in reversed(order):
        # Characters, those in links, and form controls.
        mine = sizes[id(node)]
        for child in node.children:
            if isinstance(child, str):
                mine[0] += len(child.strip())
            elif child.tag in CONTROLS:
                mine[2] += 1
            elif id(child) in sizes:
                below = sizes[id(child)]
                mine[0] += below[0]
                mine[1] += below[0] if child.tag == "a" else below[1]
                mine[2] += below[2]
        chars, linked, controls = mine
        if not node.doubt or controls or not chars or linked >= MOST_LINKED * chars:
            continue
        in_article = id(node.parent) in inside
        if node.hint:
            own = in_article or node.doubt == 1 and chars >= LONG_CHARS
        else:
            paragraph = node.tag in PARAGRAPHS and chars >= LONG_CHARS
            own = in_article and node.doubt == 1 and (paragraph or node.tag == "header")
        if own:
            node.doubt = 0


def settle(root: Node) -> None:
    """Drop doubted elements, except those that hold most of the page."""
    order = list(_nodes(root))
    if not any(node.doubt for node in order):
        return
    clear(order)
    # Per node: points of long paragraphs by their greatest doubt below it, its own
    # included; points and characters without links that nothing below it marks.
    points = {id(node): [0.0, 0.0, 0.0] for node in order}
    free = {id(node): [0.0, 0] for node in order}
    in_link: set[int] = set()
    for node in order:
        if node.tag == "a" or node.tag not in BLOCKS and id(node.parent) in in_link:
            in_link.add(id(node))
    for node in reversed(order):
        mine, beside = points[id(node)], free[id(node)]
        if id(node) not in in_link:
            beside[1] += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        text = "".join(_inline(node)).strip() if node.tag in BLOCKS or node is root else ""
        if text:
            link = _linked_inline(node) / len(text)
            worth = (1 + text.count(",") + min(3.0, len(text) / 100)) * max(0.0, 1 - link)
            beside[0] += worth
            if len(text) >= LONG_CHARS and link < MOST_LINKED:
                mine[0] += worth
        if node.doubt:
            mine[node.doubt] += sum(mine[: node.doubt])
            mine[: node.doubt] = [0.0] * node.doubt
        if node.parent:
            above = points[id(node.parent)]
            for i in range(3):
                above[i] += mine[i]
            if not node.doubt:
                free[id(node.parent)][0] += beside[0]
                free[id(node.parent)][1] += beside[1]
    rest, chars = free[id(root)]
    for most in (1, 2):
        if most == 2 and chars >= TEXT_BESIDE:
            break
        whole = sum(points[id(root)][: most + 1])
        stack = [root]
        while stack:
            node = stack.pop()
            if node.dropped:
                continue
            if node.doubt:
                held = sum(points[id(node)][: most + 1])
                if node.doubt > most or not held or held < max(TIMES_REST * rest, whole / 2):
                    continue
                node.doubt = 0
                rest += free[id(node)][0]
                chars += free[id(node)][1]
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    for node in order:
        node.dropped = node.dropped or node.doubt > 0


def _linked_inline(node: Node) -> int:
    """Characters in links of a block, without those of blocks inside it."""
    linked, stack = 0, [c for c in node.children if isinstance(c, Node)]
    while stack:
        child = stack.pop()
        if not child.dropped and child.tag not in BLOCKS:
            if child.tag == "a":
                linked += sum(len(t) for t in _inline(child))
            else:
                stack.extend(c for c in child.children if isinstance(c, Node))
    return linked


def score(root: Node) -> Node | None:
    """The best container, every node's points and text sizes being set."""
    order = list(_nodes(root))
    for node in reversed(order):
        for child in node.children:
            if isinstance(child, str):
                node.chars += len(child.strip())
            elif not child.dropped:
                node.chars += child.chars
                node.linked += child.chars if child.tag == "a" else child.linked
    # A paragraph's points go to its parent, half of them further up, and ever smaller
    # shares from there. A container's own text counts for itself.
    first: dict[int, float] = {}
    for node in order:
        if node.tag in PARAGRAPHS or any(
            isinstance(c, str) and c.strip() for c in node.children
        ):
            if (node.tag in BLOCKS or node is root) and node.chars:
                at = node if node.tag in CONTAINERS or not node.parent else node.parent
                first[id(at)] = first.get(id(at), 0.0) + _points(node)
    # One sweep from the leaves; until a node is reached its score is what came from below.
    for node in reversed(order):
        own = first.get(id(node), 0.0)
        if node.parent:
            node.parent.score += own / 2 + node.score * 0.7
        node.score += own
    best = None
    for node in order:
        if node.tag in CONTAINERS or node.tag == "html":
            points = node.score * (1 - _density(node))
            if points > 0 and (best is None or points > best[0]):
                best = (points, node)
    return best[1] if best else None


def _points(node: Node) -> float:
    """What a paragraph is worth."""
    own = "".join(_inline(node))
    return (1 + own.count(",") + min(3.0, len(own) / 100)) * (1 - _density(node))


def _inline(node: Node) -> Iterator[str]:
    """Text of a block without that of blocks inside it."""
    stack = list(reversed(node.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            yield child
        elif not child.dropped and child.tag not in BLOCKS:
            stack.extend(reversed(child.children))


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _nodes(root: Node) -> Iterator[Node]:
    """Elements that were not dropped, in page order."""
    stack = [root]
    while stack:
        node = stack.pop()
        if not node.dropped:
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


def _kept(best: Node) -> list[Node]:
    """The best container, or the article around it, and siblings that are content."""
    top, node = best, best
    while node:
        if node.tag in ("article", "main"):
            top = node
            if node.tag == "article":
                break
        node = node.parent
    if top.tag in ("main", "body", "html") or top.parent is None:
        return [top]
    least = max(2.0, 0.2 * top.score)
    return [
        c
        for c in top.parent.children
        if isinstance(c, Node)
        and not c.dropped
        and (c is top or (top.tag != "article" or c.tag == "article") and _belongs(c, least))
    ]


def _belongs(node: Node, least: float) -> bool:
    if node.tag in CONTAINERS:
        return node.score * (1 - _density(node)) >= least
    if node.tag in PARAGRAPHS or node.tag not in BLOCKS:
        return node.chars > 0 and _density(node) < 0.25
    return False


def blocks(nodes: list[Node]) -> Iterator[str]:
    """Texts of the blocks in page order, white space made one space."""
    parts: list[str] = []
    stack: list[Node | str | None] = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
            continue
        if item is None:
            text = _WHITE.sub(" ", "".join(parts)).strip()
            parts.clear()
            if text:
                yield text
            continue
        if item.dropped:
            continue
        if item.tag == "br":
            parts.append(" ")
        block = item.tag in BLOCKS
        # None marks a block's edge.
        if block:
            stack.append(None)
        stack.extend(reversed(item.children))
        if block:
            stack.append(None)
    text = _WHITE.sub(" ", "".join(parts)).strip()
    if text:
        yield text


def main_text(page: str | None) -> str:
    """The article of a page, one line per block."""
    if not page:
        return ""
    tree = parse(page)
    settle(tree)
    best = score(tree)
    return "\n".join(blocks(_kept(best))) if best else ""


def main_text_of(page: Column) -> Column:
    """:func:`main_text` as a column expression."""

    @F.arrow_udf("string")
    def extracted(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p) for part in slices(pages) for p in part], pa.string())

    return extracted(page)


def extract(
    pages: DataFrame, page: str = "html", page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``."""
    found = pages.select(
        col(page_id).alias("page_id"), col(url).alias("url"), main_text_of(col(page)).alias("text")
    )
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
