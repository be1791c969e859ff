"""Main-text extraction from HTML by tree scoring.

Each page is parsed into a small tree inside the task that reads it; nothing is
shuffled.  Every paragraph passes points for its length and its commas to its
ancestors, halved at each step and discounted by the links in it; the container
with the most points is kept, whole ``article`` or ``main`` elements before
parts of them, with those of its siblings that are text rather than links.

What never is the article goes before: elements that show no text, the tags of
menus, headers, footers, sidebars and forms, and elements whose class, id or
role marks such a thing.  A mark weighs more as the first or last part of a name
(``ad-slot``, ``post-comments``, not ``search-results-study``), beside words of
layout or of publishing, on a container rather than a paragraph, and where the
element's text is mostly links.  What contradicts a mark: a header inside the
article that isn't links, a menu in it that is a list of steps, and the
heading and most of the page's unlinked text, which make an element a wrapper,
whatever it is called.

Time is linear in the length of a page, also for unclosed quotes, stray end
tags and deep nesting.

Defined results: null, empty and tag-free pages give whatever text stands in
them (the empty string for none); a tag that never ends hides the rest of the
page, as in a browser; references are decoded in each piece of text, so none
arises across tags; repeated rows are extracted each for itself; an empty table
gives an empty one; other columns pass through, and a column named like the
result is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup, up to their end tag.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Elements whose content no reader of the page sees as text.
UNSHOWN = RAW - {"xmp"} | frozenset("head noscript template svg object audio video canvas select datalist button dialog".split())
#: Elements around the article, by their meaning.
AROUND = frozenset("nav header footer aside form menu".split())
BLOCKS = AROUND | frozenset(
    "address article blockquote body caption center dd details dialog div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 head hgroup hr html "
    "legend li main ol p pre search section summary table tbody td tfoot th thead title tr ul xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a name may mark without saying it as a whole.
CONTAINERS = frozenset("div section aside nav header footer form ul ol menu dl table tbody tr td fieldset details center iframe figure article".split())
#: Elements that pass their points on instead of being containers.
PARAGRAPHS = HEADINGS | frozenset("p pre xmp li td th dd dt blockquote figcaption caption summary".split())
#: What a start tag closes: the nearest of the first set, up to one of the second.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Words of names that mark what isn't the article, and reader comments, which never wrap it.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion banner banners nav navi navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar sidebars side aside complementary header masthead footer footers contentinfo colophon cookie cookies "
    "consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations search searchform pagination pager toolbar widget widgets form forms hidden skip".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Of these, words that are names of parts of pages, and hardly ever of what a text is about, whatever stands beside them.
MACHINE = COMMENTS - {"respond", "reply", "replies", "comment"} | frozenset(
    "ad ads advert adverts advertisement advertisements adsense adsbygoogle dfp sponsored taboola outbrain nav navi navbar navigation breadcrumb breadcrumbs "
    "sidebar sidebars footer footers colophon cookie cookies consent gdpr popup modal overlay newsletter subscribe signup pagination pager toolbar rail cta".split()
)
UNWANTED |= MACHINE - COMMENTS
#: Marks that say little beside words of publishing: an article has headers and sides of its own.
LOOSE = frozenset("header side aside search searchform form forms hidden skip complementary top".split())
#: Words of publishing that may stand beside a mark.
OBJECTS = frozenset(
    "post posts entry entries article articles story stories content contents news blog text body page pages slot unit message messages label holder space "
    "video videos product products topic topics read reading google mobile desktop sticky fixed title author count meta data js embed inline end after before "
    "privacy policy legal site email mail follow us".split()
)
#: Words that deny a mark beside them, and words of prose, which make a name a title.
DENIED = frozenset("has with no without".split())
PROSE = frozenset("a an and about for in of on or to versus".split())
#: Words that may stand beside them in a name.
NEUTRAL = frozenset(
    "site page global top bottom left right inner outer wrap wrapper container box block area bar list item items link links button buttons icon icons "
    "group row col column panel region section module primary secondary small large the user reader readers tools thread count 1 2 3 4".split()
)
#: Points that a container has from the start.
BONUS = {"article": 25.0, "main": 25.0}
#: A container beside the best one is kept from this share of its points on.
SIBLING_SHARE = 0.2
#: Share of linked characters from which on text beside the best container is a list of links.
LINKED = 1 / 3
#: Characters of a paragraph that is kept without being a sentence.
LONG = 80

_TAG = re.compile(r"/?[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^=>]*")
_SPACES = re.compile(r"\s*")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_ASKED = re.compile(r"class|id\b|role|hidden|style|open", re.I)
_UNDISPLAYED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?…。！？](?:\s|[\"'”’»)]|$)")


class Node:
    __slots__ = ("tag", "parent", "children", "score", "drop", "soft", "doubt", "comment", "holds", "blocky", "text", "links")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.score, self.text, self.links = 0.0, 0, 0
        #: Dropped for sure; dropped unless it wraps the page; that only if it is links; reader comments; has a heading, an article; has blocks in it.
        self.drop = self.soft = self.doubt = self.comment = self.holds = self.blocky = False


class Scanner:
    """Tags of a page, each character looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.none_after: dict[str, int] = {}

    def find(self, what: str, at: int) -> int:
        """``str.find`` that doesn't look again where it has found nothing."""
        if at >= self.none_after.get(what, len(self.page) + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none_after[what] = at
        return found

    def end_of_tag(self, at: int) -> int:
        """The place of the ``>`` of a tag whose attributes begin at ``at``; -1 if it never ends."""
        page, n = self.page, len(self.page)
        while True:
            at = _PLAIN.match(page, at).end()
            if at >= n:
                return -1
            if page[at] == ">":
                return at
            at = _SPACES.match(page, at + 1).end()
            if at < n and page[at] in "\"'":
                close = self.find(page[at], at + 1)
                at = close + 1 if close >= 0 else at + 1  # a quote that nothing closes is a character


def names(value: str) -> Iterator[list[str]]:
    """The parts of each name of a class, id or role, in lower case."""
    for name in value.split():
        if parts := [p.lower() for p in _PART.findall(name)]:
            yield parts


def weigh(node: Node, parts: list[str]) -> None:
    """Set what one name says of ``node``."""
    marks = [p for p in parts if p in UNWANTED or p in COMMENTS]
    if not marks or not DENIED.isdisjoint(parts) or parts[-1] == "free":
        return
    others = [p for p in parts if p not in UNWANTED and p not in COMMENTS and p not in NEUTRAL and not p.isdigit()]
    sure = not others
    if not sure and node.tag in CONTAINERS and PROSE.isdisjoint(parts):
        # words of layout and short prefixes of a maker's stand outside of what is named
        named = [p for p in parts if p in marks or not (p in NEUTRAL or p in OBJECTS or p == "main" or len(p) < 3)]
        ends = (named[0], named[-1])
        sure = any(p in MACHINE for p in ends) or "comment" in ends or (all(p in OBJECTS for p in others) and any(p not in LOOSE for p in marks))
        node.doubt = node.doubt or ends[0] in marks
    if sure:
        node.soft = True
        node.comment = node.comment or any(p in COMMENTS for p in marks)


def judge(node: Node, attributes: str) -> None:
    """Set what the tag and its attributes say of ``node``."""
    tag = node.tag
    node.drop = tag in UNSHOWN
    node.soft = tag in AROUND
    if not attributes or not _ASKED.search(attributes):
        return
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "open" and tag == "dialog":
            node.drop = False
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNDISPLAYED.search(value)):
            node.drop = True
        elif name in ("class", "id", "role"):
            for parts in names(value):
                weigh(node, parts)
    if tag in ("html", "body"):
        node.drop = node.soft = node.doubt = node.comment = False


def parse(page: str) -> list[Node]:
    """The elements of a page in the order of their start tags, the root first."""
    scan, end, at = Scanner(page), len(page), 0
    root = here = Node("#root", None)
    nodes, open_ = [root], Counter()

    def close(node: Node) -> None:
        nonlocal here
        while here is not node:
            open_[here.tag] -= 1
            here = here.parent
        open_[node.tag] -= 1
        here = node.parent

    def nearest(tags, limit) -> Node | None:
        node = here
        while node.parent and node.tag not in limit:
            if node.tag in tags:
                return node
            node = node.parent
        return None

    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            here.children.append(page[at:start])
        if start == end:
            break
        if page.startswith("<!--", start):
            stop = scan.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if page.startswith(("<!", "<?"), start):
            stop = scan.find(">", start)
            at = stop + 1 if stop >= 0 else end
            continue
        name = _TAG.match(page, start + 1)
        if not name:
            here.children.append("<")
            at = start + 1
            continue
        stop = scan.end_of_tag(name.end())
        if stop < 0:
            break
        attributes, at = page[name.end() : stop], stop + 1
        tag = name[0].lower()
        if tag[0] == "/":
            tag = tag[1:]
            if tag in ("br", "p") and not open_[tag]:
                if tag == "br":
                    here.children.append(Node("br", here))
            elif open_[tag]:
                node = here
                while node.tag != tag:
                    node = node.parent
                close(node)
            continue
        if tag in BLOCKS and open_["p"] and (node := nearest({"p"}, BLOCKS - {"p"})):
            close(node)
        if tag in CLOSES:
            tags, limit = CLOSES[tag]
            if any(open_[t] for t in tags) and (node := nearest(tags, limit)):
                close(node)
        node = Node(tag, here)
        judge(node, attributes)
        here.children.append(node)
        nodes.append(node)
        if tag in BLOCKS:
            here.blocky = True
        if tag in RAW:
            low = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if low:
                node.children.append(page[at : low.start()])
                stop = scan.find(">", low.end())
                at = stop + 1 if stop >= 0 else end
            else:
                node.children.append(page[at:])
                at = end
        elif tag not in VOID and not (attributes.endswith("/") and tag not in BLOCKS and tag != "a"):
            here = node
            open_[tag] += 1
    return nodes


def settle(nodes: list[Node]) -> None:
    """Decide which of the doubtful elements go: all but wrappers and the article's own headers and lists."""
    sizes: dict[Node, int] = {}
    linked_: dict[Node, int] = {}
    for node in reversed(nodes):  # children come after their parents
        size = sum(len(x) if isinstance(x, str) else sizes[x] for x in node.children)
        links = sum(linked_[x] for x in node.children if isinstance(x, Node))
        if node.tag == "a":
            size, links = 0, size + links
        sizes[node], linked_[node] = (0, 0) if node.drop or node.comment else (size, links)
        node.holds = not node.drop and (node.tag in ("h1", "article", "main") or any(isinstance(x, Node) and x.holds for x in node.children))
    much = lambda node: linked_[node] >= LINKED * (sizes[node] + linked_[node])
    inside: set[Node] = set()
    headers: list[Node] = []
    for node in nodes:
        if node.parent in inside or node.tag in ("article", "main"):
            inside.add(node)
        if node.doubt and not node.soft and not node.drop:
            node.drop = linked_[node] > 0 and much(node)
        if node.soft and not node.drop:
            most = 2 * sizes[node] > sizes[nodes[0]]
            wraps = most and not node.comment and (node.holds or (node.tag == "form" and any(isinstance(x, Node) and x.tag in BLOCKS for x in node.children)))
            within = node.parent in inside
            headed = any(isinstance(x, Node) and (x.tag in HEADINGS or x.tag == "hgroup" or x.holds) for x in node.children)
            own = within and (node.tag == "header" and (headed or (sizes[node] > 0 and not much(node))) or node.tag == "menu" and sizes[node] > 0 and not much(node))
            node.drop = not (wraps or own)
            if node.drop and node.holds and not node.comment and node.tag in ("header", "div", "section"):
                headers.append(node)
    keep_headline(nodes, headers)


def keep_headline(nodes: list[Node], headers: list[Node]) -> None:
    """The one h1 of a page may stand in a dropped header beside the article: it stays, without what is around it."""
    tops = [n for n in nodes if n.tag == "h1"]
    if len(tops) != 1 or not headers:
        return
    path, node = [], tops[0]
    while node is not None:
        path.append(node)
        node = node.parent
    out = [n for n in path if n.drop]
    if not out or any(n not in headers for n in out) or any(isinstance(x, Node) and x.tag == "a" for x in tops[0].children):
        return
    for node in path[1 : path.index(out[-1]) + 1]:
        node.drop = False
        for x in node.children:
            if isinstance(x, Node) and x not in path:
                x.drop = True
        node.children = [x for x in node.children if isinstance(x, Node)]


class Block:
    """A run of text between block borders: its container, text and link characters."""

    __slots__ = ("owner", "parts", "links")

    def __init__(self, owner: Node):
        self.owner, self.parts, self.links = owner, [], 0

    def text(self) -> str:
        return _SPACE.sub(" ", "".join(self.parts)).strip()


def blocks(root: Node) -> Iterator[Block]:
    """All blocks outside dropped parts, in page order; deep pages need no recursion."""
    block = Block(root)
    todo: list[tuple[Node | str | None, Node, bool]] = [(root, root, False)]
    while todo:
        x, owner, link = todo.pop()
        if x is None:
            if block.parts:
                yield block
            block = Block(owner)
        elif isinstance(x, str):
            found = entities.unescape(x) if "&" in x and owner.tag != "xmp" else x
            block.parts.append(found)
            if link:
                block.links += len(_SPACE.sub(" ", found).strip())
        elif x.drop:
            continue
        elif x.tag == "br":
            block.parts.append(" ")
        elif x.tag in BLOCKS:
            # text of the parent after this element is a block of the parent's own
            todo += [(None, owner, link), *((c, x, link) for c in reversed(x.children)), (None, x, link)]
        else:
            todo += [(c, owner, link or x.tag == "a") for c in reversed(x.children)]
    if block.parts:
        yield block


def linked(node: Node) -> bool:
    return node.links >= LINKED * max(1, node.text)


def beside(node: Node, following: Node | None, best: Node, near: bool) -> bool:
    """Whether ``node``, a sibling of what is kept, is text of the article; ``near``: of the container itself."""
    if not node.text or linked(node):
        return False
    if near or node.tag == "h1" or (node.holds and all(isinstance(x, Node) and (x.drop or x.holds) for x in node.children)) or node.score >= SIBLING_SHARE * best.score:
        return True
    if node.tag in HEADINGS:  # of the part that comes next
        return following is not None
    return node.tag in ("p", "pre", "blockquote", "figure") and (node.text >= LONG or node.links == 0 and bool(_SENTENCE.search(said(node))))


def said(node: Node) -> str:
    """The text of a small element."""
    return " ".join(b.text() for b in blocks(node))


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    nodes = parse(page)
    settle(nodes)
    found = [(b, t) for b in blocks(nodes[0]) if (t := b.text())]
    if not found:
        return ""
    scored: dict[Node, None] = {}
    for b, t in found:
        b.owner.text += len(t)
        b.owner.links += min(b.links, len(t))
        points = (1 + t.count(",") + min(len(t) / 100, 3)) * (1 - min(1.0, b.links / len(t)))
        node = b.owner
        if node.parent and (node.tag in PARAGRAPHS or not node.blocky):
            node = node.parent
        while node is not None and points > 0.01:
            if node not in scored:
                scored[node] = None
                node.score += BONUS.get(node.tag, 0.0)
            node.score += points
            points, node = points / 2, node.parent
    for node in reversed(nodes[1:]):
        if not node.drop:
            node.parent.text += node.text
            node.parent.links += node.links
    if not scored:  # nothing but links
        return ""
    best = max(scored, key=lambda n: n.score)  # the first of equals
    node, whole = best, None
    while node is not None:
        if node.tag == "article" or (node.tag == "main" and whole is None):
            whole = node
        node = node.parent
    container = whole or best
    keep = {container}
    node, near = container, True
    while node.parent is not None:
        parent = node.parent
        top = parent.tag in ("#root", "html", "body")
        following: Node | None = None
        for x in reversed(parent.children):
            if isinstance(x, Node) and not x.drop and x.tag in BLOCKS:
                if x is node:
                    following = x
                elif beside(x, following, best, near and not top):
                    keep.add(x)
                    following = x
                elif x.text:
                    following = None
        node, near = parent, False
    known: dict[Node, bool] = {}

    def kept(node: Node | None) -> bool:
        path = []
        while node is not None and node not in known and node not in keep:
            path.append(node)
            node = node.parent
        out = node is not None and (node in keep or known[node])
        for x in path:
            known[x] = out
        return out

    return "\n\n".join(t for b, t in found if kept(b.owner))


def extract_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of each whole page."""
    others = [c for c in pages.columns if c != "text"]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row"), F.col(f"`{html}`").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array(map(extract, batch["__html"].to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([batch["__row"], texts], ["__row", "text"])

    schema = rows.select("__row").schema.add("text", "string")
    return rows.mapInArrow(run, schema).select(*[F.col("__row")[c].alias(c) for c in others], "text")
