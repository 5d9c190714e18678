"""Main-text extraction from HTML by tree scoring.

Each paragraph gives points for its length and commas to its parent and half of them to its
grandparent; a container's points are discounted by its link density. The container with the most
points is kept, and beside it and beside each element around it all that is not link-dense; a main element
around it, or else an article, bounds what is kept, and articles and headings beside that article stay too.
The blocks are joined in page order.

Menus, headers, footers, sidebars, forms, scripts, styles and hidden parts are left out by their element, role
or attributes, and containers of reader comments by their name. Other names (class and id) only weigh: a
name that says nothing but noise (`ad`, `cookie-notice`, `share-buttons`, but not `share-price` or
`story related`) takes three quarters of a container's points, and the container goes unless it holds more
points of its own than all the rest of the page.

A null or empty html, or a page without text, gives an empty text. Broken markup is read as browsers
do where it matters here: unclosed elements end with their parents, a cut tag at the end is dropped.
Time grows with the length of a page, whatever its depth.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from dunlin.llm.common import bounded_batches, text_slices

# Element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea xmp noembed noframes title svg math".split())
SKIP = RAW | frozenset("nav header footer aside form button select option dialog menu canvas object audio video map head label fieldset input".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main body figcaption".split())
CLOSES_P = BLOCK | frozenset("hr nav header footer aside form fieldset menu dialog".split())
#: Words of names that stand for noise, and words that may stand beside them without changing that.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent notice notices newsletter subscribe subscription signup sidebar rail widget widgets "
    "menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar share sharing social related recommended popup modal overlay login gdpr skip".split()
)
COMMENTS = frozenset("comment comments commentlist disqus".split())
FILLER = frozenset("box bar block container wrapper wrap section area list item items links link button buttons icon icons inner outer left right top bottom site page main post posts article user reader slot unit panel group form thread content media policy more".split())
#: Words of names that stand for content.
CONTENT = frozenset("article body content entry main page post story text".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form note".split())
LONG = 25

TOKEN = re.compile(r"<!--(?:(?!-->).)*(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
WORD = re.compile(r"[a-z]+")


#: What ends an open element of a kind: the kind's elements, and those that bound the search for it.
KINDS = {"p": ("p", {"p"}, {"table", "td", "th", "button", "object"}), "li": ("li", {"li"}, {"ul", "ol", "menu"}), "dd": ("dd", {"dd", "dt"}, {"dl"}), "row": ("row", {"tr", "td", "th"}, {"table"}), "option": ("option", {"option"}, {"select"})}
KIND_OF = {"li": "li", "dd": "dd", "dt": "dd", "tr": "row", "td": "row", "th": "row", "option": "option"}
_IN_KIND = {tag: tuple(k for k, (_, own, bound) in KINDS.items() if tag in own or tag in bound) for tag in {t for _, own, bound in KINDS.values() for t in own | bound}}


class Node:
    __slots__ = ("tag", "parent", "children", "skip", "noise", "points", "link", "length", "near")

    def __init__(self, tag: str, parent: Node | None, skip: bool = False, noise: bool = False):
        self.tag, self.parent, self.skip, self.noise = tag, parent, skip, noise
        self.children: list = []
        self.points = self.link = self.length = 0.0
        # the nearest open element of each kind, or what bounds it
        near = parent.near if parent is not None else {}
        kinds = _IN_KIND.get(tag)
        self.near = near | dict.fromkeys(kinds, self) if kinds else near


def named(value: str) -> int:
    """What a class or id says: 2 reader comments, 1 noise, 0 nothing."""
    found = 0
    for token in value.split():
        words = set(WORD.findall(token))
        if words & COMMENTS and words <= COMMENTS | FILLER:
            return 2
        if words & NOISE and words <= NOISE | FILLER:
            found = 1
        elif words and words <= CONTENT:
            return 0
    return found


def judged(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is left out, and whether its name is noise."""
    if tag in SKIP:
        return True, False
    if not attributes or tag in ("body", "html"):
        return False, False
    low = attributes.lower()
    if not ("class" in low or "id" in low or "role" in low or "hidden" in low or "style" in low):
        return False, False
    noise = False
    for name, value in ATTRIBUTE.findall(low):
        value = value.strip("\"'")
        if name in ("class", "id"):
            says = named(value)
            if says == 2 and tag != "main":
                return True, False
            noise |= says == 1 and tag not in ("article", "main")
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
    return False, noise


def parse(html: str) -> list[Node]:
    """The nodes of a page, parents before children, the root first; what is left out keeps no strings."""
    root = Node("#root", None)
    nodes, cur, at, n = [root], root, 0, len(html)
    open_: dict[str, int] = {}

    def close_to(node: Node) -> Node:
        """Ends all open elements up to and including node."""
        inner = cur
        while True:
            open_[inner.tag] -= 1
            if inner is node:
                return node.parent
            inner = inner.parent

    while at < n:
        m = TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text and not cur.skip:
            cur.children.append(entities.unescape(text))
        if not m:
            break
        at = m.end()
        close = m[1]
        if close:
            close = close.lower()
            if open_.get(close):
                node = cur
                while node.tag != close:
                    node = node.parent
                cur = close_to(node)
            continue
        name = m[2] or m[5]
        if not name or (m[4] if m[2] else m[7]) != ">":
            continue  # a comment or declaration, or a tag cut off at the end
        tag, attributes = name.lower(), (m[3] if m[2] else m[6]) or ""
        if tag in CLOSES_P and (p := cur.near.get("p")) is not None and p.tag == "p":
            cur = close_to(p)
        kind = KIND_OF.get(tag)
        if kind:
            top = cur.near.get(kind)
            if top is not None and tag == "tr" and top.tag in ("td", "th"):
                row = top.parent.near.get(kind) if top.parent is not None else None
                top = row if row is not None and row.tag == "tr" else top
            if top is not None and top.tag in KINDS[kind][1] and not (top.tag == "tr" and tag in ("td", "th")):
                cur = close_to(top)
        skip, noise = judged(tag, attributes)
        node = Node(tag, cur, cur.skip or skip, noise)
        cur.children.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID and (not attributes.endswith("/") or tag in BLOCK or tag in SKIP or tag in ("a", "b", "i", "span", "p")):
            cur = node
            open_[tag] = open_.get(tag, 0) + 1
    return nodes


def blocks_of(node: Node) -> list[tuple[Node, str, int]]:
    """(container, text, characters in links) of every block below node, in page order."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    owners, links = [node], [0]

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            out.append((owners[-1], text, min(links[0], len(text))))
        parts.clear()
        links[0] = 0

    # an explicit stack, as nesting may be deep: (node, its next child, inside a link)
    stack = [[node, 0, node.tag == "a"]]
    while stack:
        top = stack[-1]
        cur, k, linked = top
        if k >= len(cur.children):
            stack.pop()
            if cur.tag in BLOCK and cur is not node:
                flush()
                owners.pop()
            continue
        top[1] += 1
        child = cur.children[k]
        if isinstance(child, str):
            parts.append(child)
            if linked:
                links[0] += len(child.strip())
        elif child.tag == "br":
            parts.append("\n")
        elif child.skip:
            if child.tag in CLOSES_P:
                flush()
            else:
                parts.append(" " if child.tag in ("button", "select", "input") else "")
        elif child.tag in VOID:
            if child.tag == "hr":
                flush()
        else:
            if child.tag in BLOCK:
                flush()
                owners.append(child)
            stack.append([child, 0, linked or child.tag == "a"])
    flush()
    return out


def measured(nodes: list[Node], weigh: bool = True) -> list[tuple[Node, str, int]]:
    """The page's blocks; lengths, links and points of all nodes are set."""
    blocks = blocks_of(nodes[0])
    for node in nodes:
        node.length = node.link = node.points = 0.0
    for owner, text, links in blocks:
        owner.length += len(text)
        owner.link += links
        if len(text) < LONG or owner.tag not in PARAGRAPH:
            continue
        points = 1.0 + text.count(",") + min(len(text) / 100.0, 3.0)
        # text that stands straight in a container counts for that container
        node = owner if owner.tag in ("div", "section", "article", "main", "body") else owner.parent
        for share in (1.0, 0.5):
            if node is None:
                break
            points *= 0.25 if node.noise and weigh else 1.0
            node.points += points * share
            node = node.parent
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.length += node.length
            node.parent.link += node.link
    return blocks


def score(node: Node) -> float:
    return node.points * (1.0 - node.link / max(node.length, 1.0))


def without_noise(nodes: list[Node]) -> None:
    """Leaves out containers with noisy names, but one that holds more text outside links than the rest of the page."""
    whole = nodes[0].length - nodes[0].link
    holds = {id(n) for n in nodes if n.tag in ("article", "main") and not n.skip}
    for n in reversed(nodes):
        if id(n) in holds and n.parent is not None:
            holds.add(id(n.parent))
    for n in nodes:
        if n.parent is not None and n.parent.skip:
            n.skip = True
        elif n.noise and id(n) not in holds and 2 * (n.length - n.link) <= whole:
            n.skip = True


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    nodes = parse(html)
    root = nodes[0]
    if not measured(nodes):
        return ""
    if any(n.noise for n in nodes):
        without_noise(nodes)
        measured(nodes)
    best = max((n for n in nodes if n.points), key=score, default=None)
    if best is None:
        best = next((n for n in nodes if n.tag in ("article", "main") and not n.skip), root)
    while best.tag not in BLOCK and best.parent is not None:
        best = best.parent
    if best.tag in ("ul", "ol", "dl", "table", "tbody", "tr", "blockquote", "p") and best.parent is not None:
        best = best.parent
    # a main element around the best container bounds the article, or else the article around it
    bound, node = best if best.tag in ("article", "main") else None, best.parent
    while node is not None:
        if node.tag == "main" or node.tag == "article" and bound is None:
            bound = node
        node = node.parent
    if bound is not None and bound.tag == "article" and bound.parent is not None:
        least, kept = max(3.0, 0.2 * score(bound)), []
        for sib in bound.parent.children:
            if isinstance(sib, str) or sib.skip:
                continue
            dense = sib.link / max(sib.length, 1.0)
            like = sib.tag == "article" and sib.length and dense < 0.5 or sib.tag in ("h1", "h2", "h3", "hgroup") and dense < 0.5
            if sib is bound or like or sib.points and score(sib) >= least or sib.tag == "p" and sib.length > 80 and dense < 0.25:
                kept.append(sib)
        return "\n".join(text for node in kept for _, text, _ in blocks_of(node))
    least, node, around = max(3.0, 0.2 * score(best)), best, set()
    while node is not bound and node.parent is not None:
        for sib in node.parent.children:
            if not isinstance(sib, str) and sib is not node and sib.link >= 0.5 * max(sib.length, 1.0) and score(sib) < least:
                sib.skip = True
        node = node.parent
        around.add(id(node))
    # text straight in an element around the best container is judged by itself
    return "\n".join(text for owner, text, links in blocks_of(node) if id(owner) not in around or links < 0.5 * len(text))


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every page row; a narrow map, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, html_col):
                texts = [extract(h) for h in batch.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, "url", html_col).mapInArrow(run, f"`{id_col}` {kind}, url string, text string, n_chars bigint")
