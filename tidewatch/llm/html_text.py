"""Main text of web pages by tree scoring.

Each page is parsed into a tree of elements. Paragraphs pass points for their length
and commas to their ancestors, fewer to farther ones; a container's points are
discounted by its share of linked text. The best container, or the whole article or main
that it stands in, and those siblings that also read as text are kept in page order;
their blocks are the page's text. Class, id and role name
furniture outside the text; inside it only containers are judged, by words that can't be
a section's name, and a box of links is dropped only if its words name furniture too.

Defined results: null or empty html, or a page without text outside its furniture, has
the empty text; unclosed, wrongly nested and truncated markup is repaired as browsers
do; repeated rows give one result each; extra columns are ignored. A page costs time in proportion to its length,
however its elements are nested.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML, and words that name page furniture in class, id or role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template iframe object svg math canvas form nav footer aside button input select textarea dialog menu audio video".split())
RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "template")
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
FURNITURE = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation navlinks menu menubar submenu breadcrumb breadcrumbs toc pager pagination sidebar sidebars aside rail widget widgets footer foot masthead header topbar toolbar comment comments commentlist respond disqus discussion replies reply share sharing social related recommended recommendations subscribe subscription newsletter signup login search hidden skip skiplink contentinfo complementary dialog".split()
)
#: Words that name furniture inside the text as well, on containers and lists: as any part of a token, as its first part, its last, or the whole token.
CLEAR = frozenset("adverts advertisement advertising adbox sponsored navbar navlinks menubar submenu breadcrumb breadcrumbs pager pagination sidebar sidebars masthead topbar toolbar commentlist disqus signup skiplink contentinfo popup".split())
FIRST = frozenset("advert cookie cookies gdpr promo comment comments newsletter".split())
LAST = frozenset("ad ads advert comment comments notice notices consent share sharing promo banner sponsor sponsors newsletter".split())
WHOLE = frozenset("promoted gdpr modal overlay nav menu toc widget widgets footer subscribe subscription login hidden skip complementary alert alerts alertdialog cookie cookies related recommended recommendations social replies respond ad-box ad-slot ad-unit ad-banner ad-container ad-wrapper".split())
#: First parts that name furniture only before such a last part: share-buttons, but not share-price; related-posts, but not related-work.
PAIRED, ENDS = frozenset("share sharing social related recommended reader user alert notice consent".split()), frozenset("buttons button bar links link tools box icons icon widget posts post articles stories news reads items list content comments area section wrapper container message banner".split())
#: Whole tokens that name an advert on a paragraph or a stretch of text.
ADVERTS, JUDGED_PROSE = frozenset("ad ads advert adverts advertisement".split()), frozenset("p span li".split())
CONTAINERS = frozenset("div section aside ul ol form".split())
#: Text whatever its class, but for an advert's: no other word of these elements' class, id or role is judged.
PROSE = HEADINGS | frozenset("p pre blockquote td th tr li dt dd figure figcaption caption".split())
BODY_WORDS = frozenset("article content main body post entry text story maincontent articlebody page".split())
TAG_POINTS = {"article": 10.0, "main": 8.0, "section": 2.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0}

#: Quotes only count where an attribute's value begins; a quote that is never closed is part of the value. A tag that the page ends in is dropped.
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)(?:>|(\Z))|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Points of an element that is removed.
GONE = -1e9


class Node:
    __slots__ = ("apart", "children", "commas", "doubt", "links", "name", "parent", "points", "size", "within", "words")

    def __init__(self, name: str, parent: Node | None, words: frozenset = frozenset()):
        self.name, self.parent, self.words = name, parent, words
        self.children: list[Node | str] = []
        self.points = self.size = self.links = 0.0
        self.commas = 0
        # doubt: furniture unless it stands in the text; apart: so is this node or one above it.
        # within: this node or one above it is an article or main.
        self.doubt = self.apart = self.within = False


def _furniture(name: str, attrs: str) -> tuple[bool, bool, frozenset]:
    """Whether an element is furniture anywhere, whether it is unless it stands in the text, and its words."""
    if name in DROPPED:
        return True, False, frozenset()
    if not attrs:
        return False, False, frozenset()
    got = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
    if re.search(r"\shidden(?=[\s/>]|$)", attrs) or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", "")):
        return True, False, frozenset()
    words: set[str] = set()
    tokens: set[str] = set()
    for key in ("class", "id", "role"):
        for token in got.get(key, "").split():
            tokens.add(token.lower())
            words |= {w.lower() for w in _WORD.findall(token)} | {token.lower()}
    named = words & FURNITURE and name not in PROSE and not (name in ("html", "body", "article", "main") or words & BODY_WORDS and not words & {"comment", "comments", "sidebar", "ad", "ads", "advert", "footer", "header", "nav", "menu", "share", "related", "form"})
    sure = name in CONTAINERS and any(map(_names_furniture, tokens)) or name in JUDGED_PROSE and bool(tokens & ADVERTS)
    return sure, bool(named and not sure), frozenset(words)


def _names_furniture(token: str) -> bool:
    parts = token.replace("_", "-").strip("-").split("-")
    return token in WHOLE or not CLEAR.isdisjoint(parts) or parts[0] in FIRST or parts[-1] in LAST or parts[0] in PAIRED and parts[-1] in ENDS and len(parts) > 1


def parse(page: str) -> Node:
    """Tree of the page without its furniture."""
    root = Node("#root", None)
    # the open elements from the root on, places in there by name, and those of blocks
    path, opened, blocks = [root], defaultdict(list), [0]
    at, lower = 0, None

    def close(names: tuple[str, ...], scopes: frozenset | set | None) -> None:
        """Closes the innermost of these elements, unless one of ``scopes`` (None: any other block) stands inside it."""
        found = max((opened[n][-1] for n in names if opened[n]), default=0)
        if scopes is None:
            k = len(blocks) - 1
            while k and path[blocks[k]].name in names:
                k -= 1
            inner = blocks[k]
        else:
            inner = max((opened[n][-1] for n in scopes if opened[n]), default=0)
        if found > inner:
            while len(path) > found:
                name = path.pop().name
                opened[name].pop()
                if name in BLOCKS:
                    blocks.pop()

    while at < len(page):
        found = _TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            path[-1].children.append(html.unescape(text))
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name or found[4] is not None:
            continue
        if found[1]:
            if name in BLOCKS or name not in VOID:
                close((name,), frozenset() if name in BLOCKS else None)
            continue
        gone, doubt, words = _furniture(name, found[3])
        if name in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{name}", at)
            at = len(page) if end < 0 else end
        if name in VOID:
            path[-1].children.append(Node(name, path[-1]))
            continue
        if name in BLOCKS:
            close(("p",), None)
        if name in CLOSES:
            for _ in range(2):
                close(tuple(CLOSES[name]), SCOPES[name])
        if name == "header" and not gone:
            gone = True
        node = Node(name, path[-1], words)
        node.doubt = doubt
        if gone:
            node.points = GONE
        path[-1].children.append(node)
        if not found[3].endswith("/") or name in BLOCKS:
            opened[name].append(len(path))
            if name in BLOCKS:
                blocks.append(len(path))
            path.append(node)
    return root


def _inside(node: Node, names: tuple[str, ...]) -> Node | None:
    found = None
    while node is not None:
        if node.name in names:
            found = node
        node = node.parent
    return found


def _measure(root: Node) -> list[Node]:
    """Sizes and linked sizes of all kept nodes, children first; headings and paragraphs of an article's own header are kept."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        up = node.parent
        node.within = node.name in ("article", "main") or up is not None and up.within
        node.apart = node.doubt or up is not None and up.apart
        order.append(node)
        if node.name == "header" and node.points == GONE:
            # an article's own: its headings and paragraphs
            node.points = 0.0
            node.children = [c for c in node.children if isinstance(c, Node) and c.name in HEADINGS | {"hgroup", "p"}]
        node.children = [" " if isinstance(c, Node) and c.points == GONE and not (c.name == "header" and node.within) else c for c in node.children]
        stack += [c for c in node.children if isinstance(c, Node)]
    order.reverse()
    for node in order:
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        inner = [c for c in node.children if isinstance(c, Node) and (node.apart or not c.doubt)]
        node.commas = sum(c.count(",") + c.count("，") for c in node.children if isinstance(c, str)) + sum(c.commas for c in inner)
        node.size = own + sum(c.size for c in inner)
        node.links = node.size if node.name == "a" else sum(c.links for c in inner)
    return order


def _text(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        else:
            stack += item.children[::-1]
    return "".join(out)


def _is_paragraph(node: Node) -> bool:
    if node.name in ("p", "pre", "blockquote", "td"):
        return True
    return node.name in BLOCKS and node.name not in HEADINGS | {"html", "ul", "ol"} and any(isinstance(c, str) and c.strip() for c in node.children)


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def _best(order: list[Node]) -> Node | None:
    for least in (25, 1):
        scored: dict[int, Node] = {}
        for node in order:
            if node.apart or not _is_paragraph(node) or node.size < least:
                continue
            points = 1 + node.commas + min(node.size / 100, 3)
            points *= 1 - _density(node)
            up, level = node.parent if node.name in ("p", "pre", "blockquote") else node, 0
            while up is not None and up.name not in ("#root", "html") and level < 4:
                if id(up) not in scored:
                    scored[id(up)] = up
                    up.points += TAG_POINTS.get(up.name, 0.0) + (25.0 if up.words & BODY_WORDS else 0.0)
                up.points += points / (1, 2, 6, 9)[level]
                up, level = up.parent, level + 1
        if scored:
            for node in scored.values():
                node.points *= 1 - _density(node)
            return max(scored.values(), key=lambda n: n.points)
    return None


def _keep(node: Node, inside: bool) -> bool:
    """False for a list, table or box of links; inside the text, only if its words name furniture too."""
    linked = node.name in ("ul", "ol", "dl", "div", "section", "table") and node.size and _density(node) > 0.5
    return not linked or inside and not node.words & FURNITURE


def _blocks(node: Node, out: list[list[str]], inside: bool) -> None:
    """Appends the node's text, a list of pieces for each block, without recursion: pages may be nested at any depth."""
    stack: list[tuple[Node | str | None, bool]] = [(c, inside) for c in reversed(node.children)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            out.append([])
        elif isinstance(item, str):
            out[-1].append(item)
        elif item.doubt and not inside or item.name == "br":
            out[-1].append(" ")
        elif item.name not in BLOCKS:
            stack += [(c, inside) for c in reversed(item.children)]
        else:
            out.append([])
            if _keep(item, inside):
                stack.append((None, inside))
                inside = inside or item.name == "article"
                stack += [(c, inside) for c in reversed(item.children)]


def _siblings(best: Node, anchor: Node) -> list[Node]:
    """The anchor and those of its siblings that also read as text, in page order."""
    least, chosen = max(10.0, 0.2 * best.points), []
    for n in anchor.parent.children if anchor.parent else [anchor]:
        if n is anchor:
            chosen.append(n)
        if n is anchor or not isinstance(n, Node) or n.doubt or not n.size:
            continue
        alike = n.points + (0.2 * best.points if n.words and n.words == best.words else 0) >= least
        prose = n.name == "p" and (n.size > 80 and _density(n) < 0.25 or _density(n) == 0 and re.search(r"[.!?](\s|$)", _text(n)) is not None)
        article = n.name == "article" and anchor.name == "article" and _density(n) <= 0.5
        if alike or prose or article or n.name in HEADINGS and _density(n) < 0.5:
            chosen.append(n)
    return chosen


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    best = _best(order)
    chosen = [root] if best is None else _siblings(best, _inside(best, ("article", "main")) or best)
    out: list[list[str]] = [[]]
    for node in chosen:
        out.append([])
        # In the whole body, or beside the articles of main, boxes may still be furniture.
        _blocks(node, out, node.name not in ("#root", "html", "body", "main") or node.name == "main" and _inside(best, ("article",)) is None)
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in out) if t)


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; each is read alone, so nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
