"""Main text of web pages by tree scoring.

Each paragraph passes points for its length and its commas to its ancestors, halved from level to level (whole to an
article or main element) and discounted by the share of its text that is in links. The container with most points is kept, with
those of its siblings that don't read like menus. Left out are elements that are no text by their tag or role. Words of class names and ids only
discount, by their share of the name's words that tell anything; an element whose name is mostly such words goes if its discounted points don't outweigh
all that is not under suspicion, and reader comments go beside any other text, however long they are. The text comes out by blocks.

Nulls and edges: a null or empty html, or one without main text, gives an empty text; malformed, cut off
and deeply nested markup is read as far as it goes; repeated rows and null ids are kept row by row.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.frames import arrow_type, emitted, rows_of

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)>|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW_TEXT = frozenset("script style title textarea xmp iframe noembed noframes".split())
RAW_END = {t: re.compile(f"</{t}", re.I | re.A) for t in RAW_TEXT}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
PARAGRAPH = frozenset("p pre td blockquote dd".split())
#: What an opening tag closes first, and where that search ends.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
BOILERPLATE_TAGS = frozenset("head script style title textarea xmp iframe noembed noframes noscript template svg canvas object nav header footer aside button select menu dialog".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words by which class names and ids speak of boilerplate.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner banners sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices "
    "sidebar sidebars aside comment comments commentlist disqus reply replies respond menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar share sharing "
    "social related recommended widget widgets popup modal overlay newsletter subscribe subscription signup login pagination pager paywall skip hidden adsbygoogle adsense".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words that tell where a thing stands or how it is shown, not what it is, and words after which a name tells of something else's absence or presence.

PLACE_WORDS = frozenset(
    "site page post posts entry article articles story stories global top bottom left right primary secondary upper lower inner outer area list section box bar block container wrapper wrap content "
    "item items link links form button buttons icons unit slot text body title thread reader user info module region column col main mobile desktop sticky fixed google you may like also more for".split()
)
NEIGHBOUR_WORDS = frozenset("with without has no not".split())
ARTICLE_WORDS = frozenset("comment comments reply replies ad ads advert sponsored related promo".split())
CONTENT = frozenset("article main".split())
PAGE = frozenset("#root html body".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
WORDS = re.compile(r"[a-z]+")
#: What the points of an element that is named as boilerplate throughout count for its ancestors, and the suspicion from which on an element may go.
DISCOUNT, MOSTLY = 0.25, 0.6


class Node:
    __slots__ = ("tag", "parent", "children", "boiler", "suspicion", "comments", "points", "held", "score", "n_text", "n_link")

    def __init__(self, tag: str, parent: Node | None, boiler: bool = False, suspicion: float = 0.0, comments: bool = False):
        self.tag, self.parent, self.boiler, self.suspicion, self.comments, self.children = tag, parent, boiler, suspicion, comments, []
        self.points, self.held, self.score, self.n_text, self.n_link = 0.0, 0.0, 0.0, 0, 0


def share_of(name: str, known: frozenset[str]) -> float:
    """The share of a class name's words that are known, of those that tell what a thing is."""
    words = WORDS.findall(name)
    if NEIGHBOUR_WORDS.intersection(words):
        return 0.0
    telling = [w for w in words if w in known or len(w) > 2 and w not in PLACE_WORDS]
    return sum(w in known for w in telling) / len(telling) if telling else 0.0


def judged(tag: str, attributes: str) -> tuple[bool, float, bool]:
    """Whether an element is boilerplate by its tag, role or hiding; how far its class names, id or tag make it suspect, from 0 to 1; and whether it is named as comments."""
    if tag in BOILERPLATE_TAGS:
        return True, 0.0, False
    suspicion = float(tag == "form")
    if not attributes.strip() or tag in PAGE or tag == "main":
        return False, suspicion, False
    found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
        return True, 0.0, False
    roles = BOILERPLATE_ROLES.intersection(found.get("role", "").split())
    known = ARTICLE_WORDS if tag == "article" else BOILERPLATE_WORDS
    comments = False
    for name in (found.get("class", "") + " " + found.get("id", "")).split():
        suspicion = max(suspicion, share_of(name, known))
        comments = comments or share_of(name, COMMENT_WORDS) >= MOSTLY
    return bool(roles - {"form"}), max(suspicion, float("form" in roles)), comments


def in_content(node: Node | None) -> bool:
    """Whether a node stands in an article or the main element."""
    while node is not None and node.tag not in CONTENT:
        node = node.parent
    return node is not None


def parsed(page: str) -> Node:
    """The tree of a page, with the boilerplate marked; white space and references are still as in the page."""
    root = Node("#root", None)
    here, at = root, 0
    while True:
        found = TAG.search(page, at)
        if found is None:
            rest = page[at:]
            if "<" in rest and re.search(r"<[/!?a-zA-Z][^>]*\Z", rest):  # cut off within a tag
                rest = rest[: rest.rindex("<")]
            if rest:
                here.children.append(rest)
            return root
        if found.start() > at:
            here.children.append(page[at : found.start()])
        at, tag = found.end(), (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            node = here
            while node is not None and node.tag != tag:
                if tag in INLINE and node.tag not in INLINE:
                    node = None
                    break
                node = node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        if tag not in INLINE:
            node = here
            while node.tag in INLINE:
                node = node.parent
            if node.tag == "p":
                here = node.parent
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            node, last = here, None
            while node is not None and node.tag not in stop:
                if node.tag in ends:
                    last = node
                node = node.parent
            if last is not None:
                here = last.parent
        if tag in VOID:
            here.children.append(Node(tag, here))
            continue
        boiler, suspicion, comments = judged(tag, found[3])
        if tag == "header" and in_content(here):
            boiler = False  # of an article's own header its headings stay
        if here.tag == "header" and tag not in HEADING and tag != "hgroup":
            boiler = True
        node = Node(tag, here, here.boiler or boiler, suspicion, comments)
        here.children.append(node)
        if tag in RAW_TEXT:
            end = RAW_END[tag].search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else len(page)
        elif not found[3].endswith("/"):
            here = node


def walked(root: Node) -> Iterator[Node]:
    """All nodes that are not boilerplate, parents first."""
    held = [root]
    while held:
        node = held.pop()
        if not node.boiler:
            yield node
            held += [c for c in reversed(node.children) if isinstance(c, Node)]


def measure(nodes: list[Node]) -> None:
    """n_text and n_link of each node: its characters that aren't white space, and those of them in links."""
    linked = {}
    for node in nodes:
        linked[node] = node.tag == "a" or (node.parent is not None and linked.get(node.parent, False))
        node.n_text = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        node.n_link = node.n_text if linked[node] else 0
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.n_text += node.n_text
            node.parent.n_link += node.n_link


def own_text(node: Node) -> str:
    """The text of a node and of the inline nodes in it."""
    held, found = list(reversed(node.children)), []
    while held:
        child = held.pop()
        if isinstance(child, str):
            found.append(child)
        elif child.tag in INLINE and not child.boiler:
            held += reversed(child.children)
    return " ".join(found)


def density(node: Node) -> float:
    return node.n_link / node.n_text if node.n_text else 0.0


def settle(nodes: list[Node]) -> None:
    """Elements that are named as boilerplate become it, with all that is in them, unless they hold the article or the main element, or their
    discounted points outweigh those of all that is not under suspicion; elements named as comments, if there is any other text and they don't hold the main element."""
    holds, holds_main = set(), set()
    for node in reversed(nodes):
        node.held += node.points
        up = node.parent
        if up is not None:
            up.held += node.held
            if node.tag in CONTENT and node.suspicion < MOSTLY or node in holds:
                holds.add(up)
            if node.tag == "main" or node in holds_main:
                holds_main.add(up)

    def accused(node: Node) -> bool:
        return node.suspicion >= MOSTLY and node not in (holds_main if node.comments else holds)

    under, rest = set(), nodes[0].held
    for node in nodes:  # parents first
        if node.parent in under:
            under.add(node)
        elif accused(node):
            under.add(node)
            rest -= node.held
    for node in nodes:
        goes = accused(node) and (rest > 1e-9 if node.comments else DISCOUNT * node.held <= rest)
        node.boiler = node.parent is not None and node.parent.boiler or goes


def main_nodes(root: Node) -> list[Node]:
    """The best container and those of its siblings that read like it, in page order."""
    nodes = list(walked(root))
    measure(nodes)
    for node in nodes:
        if node.tag in PARAGRAPH or node.tag not in INLINE and any(isinstance(c, str) and c.strip() for c in node.children):
            text = " ".join(own_text(node).split())
            node.points = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - density(node)) if text else 0.0
    settle(nodes)
    nodes = [n for n in nodes if not n.boiler]
    for node in nodes:
        up, points, whole = node.parent if node.tag in PARAGRAPH else node, node.points, node.points
        while up is not None and whole > 0:
            left = 1 - (1 - DISCOUNT) * up.suspicion
            points, whole = points * left, whole * left
            up.score += whole if up.tag in CONTENT else points
            up, points = up.parent, points / 2
    if not nodes:
        return []
    best = max(reversed(nodes), key=lambda n: n.score * (1 - density(n)))  # the innermost of equals
    if best.score <= 0:
        return [n for n in nodes if n.tag == "body"][:1] or [root]
    if best.tag == "main":
        inner = [n for n in nodes if n.tag == "article" and n.score >= 0.75 * best.score and within(n, best)]
        best = inner[-1] if inner else best
    if best.parent is None or best.tag in PAGE or best.tag == "main":
        return [best]
    if best.tag == "article":
        return [c for c in best.parent.children if c is best or isinstance(c, Node) and c.tag == "article" and not c.boiler and c.score >= 0.2 * best.score]
    least = 0.1 * best.score if best.parent.tag in PAGE else 0.0

    def joins(node: Node) -> bool:
        if node is best or node.tag in HEADING or node.score >= 0.2 * best.score:
            return True
        return node.n_text > 0 and density(node) < 0.25 and (node.tag in PARAGRAPH or node.score >= least)

    return [c for c in best.parent.children if isinstance(c, Node) and not c.boiler and joins(c)]


def within(node: Node, other: Node) -> bool:
    while node is not None and node is not other:
        node = node.parent
    return node is other


def is_menu(node: Node) -> bool:
    """A list of links straight in a page; what stands in a container is kept."""
    return node.tag in ("ul", "ol", "dl") and node.parent is not None and node.parent.tag in PAGE and density(node) > 0.7 and sum(isinstance(c, Node) for c in node.children) > 1


def main_text(page: str | None) -> str:
    """The main text of one page, a line for each block."""
    if not page:
        return ""
    blocks: list[list[str]] = [[]]
    held: list = list(reversed(main_nodes(parsed(page))))
    while held:
        node = held.pop()
        if isinstance(node, str):
            blocks[-1].append(node)
        elif node is None:
            blocks.append([])
        elif node.tag == "br" or node.tag == "wbr":
            blocks[-1].append(" " if node.tag == "br" else "")
        elif not node.boiler and not is_menu(node):
            inner = list(reversed(node.children))
            held += inner if node.tag in INLINE else [None, *inner, None]
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Per row: id, url, text and n_chars (code points)."""
    kind = pages.schema[id_col].dataType.simpleString()
    schema = pa.schema([("page_id", arrow_type(pages, id_col)), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((i, u, main_text(h)) for i, u, h in rows_of(batches, "page_id", "url", "html"))
        return emitted(((i, u, t, len(t)) for i, u, t in texts), schema, 512)

    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(extracted, f"page_id {kind}, url string, text string, n_chars long").withColumnsRenamed({"page_id": id_col, "url": url_col})


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from rollcall.llm.frames import table

    return extract_text(table(spark, sf_dir, "pages"))
