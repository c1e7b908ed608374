"""Main text of web pages: paragraphs score their ancestors; the best container's article and what belongs beside it, or else the page, is kept without what surrounds an article."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from walkrank.llm.scratch import bounded

#: Elements without text of the article. Fixed value.
DROPPED = frozenset("script style noscript template head title nav aside footer button select option textarea input label iframe object embed canvas svg audio video map dialog menu fieldset".split())
#: Elements whose end is not written. Fixed value.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup. Fixed value.
RAW = "script|style|textarea|title|noscript|iframe|noembed|xmp"
#: Elements of other kinds of markup, what in them holds HTML again, and what HTML ends them if it begins in them. Fixed value.
FOREIGN = frozenset("svg math".split())
POINTS = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Elements that begin and end a block. Fixed value.
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that hold a paragraph: their points go to what is above. Fixed value.
PARAGRAPH = frozenset("p pre td th blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption caption summary address".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element's start ends, up to an element that bounds it. Fixed value.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tr td th", "table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
#: Words in class, id and role of what surrounds an article, of what does so only outside of one, and of what is part of one in spite of them. Fixed value.
AROUND = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer footnav gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promoted promotion replies reply respond share sharing shoutbox sidebar sidebars signup skyscraper sponsor sponsored subscribe subscription toolbar tooltip topbar widget widgets contentinfo complementary alertdialog".split())
OUTSIDE = frozenset("byline header recommended related remark rss search skip social tags teaser alert".split())
ALWAYS = frozenset("comment comments commentlist disqus replies reply respond shoutbox cookie cookies consent gdpr advertisement sponsored".split())
WITHIN = frozenset("article body content main post entry story text blog".split())
#: Words of adverts: the only ones that count on what shows something in an article; and words of lists of links that may stand in one. Fixed value.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising promo promoted promotion sponsor sponsored skyscraper".split())
LISTS = frozenset("recommended related social teaser tags".split())
SHOWN = frozenset("figure picture table pre blockquote".split())
#: Names that say what a page or an article has or hasn't, not what an element is. Fixed value.
STATES = re.compile(r"^(?:no|not|has|with|without)(?=[-_A-Z])|[-_](?:open|opened|closed|enabled|disabled|allowed)$")
#: An element isn't dropped by its name if it holds more than so many times the text of all that stays without it.
WRAPS = 4

#: Characters of a block that gives points, and what its points are divided by for the element it is in and those above.
POINTED, LEVELS = 25, (1, 2, 6, 9, 12)

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>" + RAW + r")(?=[\s/>])(?P<rawattrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>(?P<content>.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*+)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("anchored", "children", "dropped", "inside", "kind", "length", "links", "linked", "parent", "prose", "score", "tag")

    def __init__(self, tag: str, parent: Node | None, kind: str = ""):
        self.tag, self.parent, self.dropped, self.kind = tag, parent, False, kind
        self.children: list[Node | str] = []
        self.prose = self.anchored = 0
        self.length = self.linked = self.links = 0
        self.score, self.inside = 0.0, False


def surrounds(tag: str, attrs: str, within: bool) -> str:
    """How an element is no part of an article, by its name, class, id, role and style: "never"; "named", unless it wraps nearly all text; "list", if it is little but links; or not at all."""
    if tag in DROPPED:
        return "never"
    if tag == "header" and not within:
        return "never"
    if tag == "form":
        return "named"
    if not attrs or tag in ("html", "body"):
        return ""
    found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attrs)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return "never"
    names = [n for k in ("class", "id", "role") for n in found.get(k, "").split() if not STATES.search(n)]
    whole = within and (tag in PARAGRAPH or tag in SHOWN)  # there a part of a name says little
    words = {w.lower() for n in names for w in ([n] if whole else NAME.findall(n))}
    if within and tag in SHOWN:
        words &= ADVERTS
    if words & ALWAYS:
        return "never"
    if tag in ("article", "main") or words & WITHIN:
        return ""
    if words & AROUND or (not within and words & OUTSIDE):
        return "named"
    return "list" if words & LISTS and tag not in PARAGRAPH and tag not in HEADING else ""


def settle(nodes: list[Node]) -> None:
    """Which elements are dropped: no name drops one that holds nearly all text of the page."""
    linked = set()
    for node in nodes:
        node.dropped = node.kind == "never" or (node.parent is not None and node.parent.dropped)
        if node.tag == "a" or node.parent in linked:
            linked.add(node)
        n = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.prose, node.anchored = (0, n) if node in linked else (n, 0)
    for node in reversed(nodes[1:]):
        if not node.dropped:
            node.parent.prose += node.prose
            node.parent.anchored += node.anchored
    wraps: set[Node] = set()
    while True:
        tops, free = [], nodes[0].prose
        for node in nodes[1:]:
            named = node.kind == "named" and node not in wraps
            own = named or (node.kind == "list" and node.anchored >= node.prose)
            if own and not node.parent.dropped:
                free -= node.prose
                if named:
                    tops.append(node)
            node.dropped = node.kind == "never" or own or node.parent.dropped
        most = max(tops, key=lambda node: node.prose, default=None)
        if most is None or most.prose <= WRAPS * free:
            return
        wraps.add(most)


def parse(page: str) -> list[Node]:
    """All elements, each after its parent. Ends without a start are left out, missing ends are understood."""
    root = Node("#root", None)
    nodes, at, pos = [root], root, 0
    open_tags: Counter[str] = Counter()  # of the elements from the root to here

    def leave(node: Node) -> Node:
        """Ends what is open down to an element's inside."""
        up = at
        while up is not node:
            open_tags[up.tag] -= 1
            up = up.parent
        return node

    while m := TOKEN.search(page, pos):
        if m.start() > pos:
            at.children.append(page[pos : m.start()])
        pos = m.end()
        tag = m["tag"] or m["tag2"]
        foreign = open_tags["svg"] + open_tags["math"] > 0
        if foreign and m["raw"] and m["rawattrs"].endswith("/"):
            pos = m.start("content")  # only there such an element may end itself
        if not tag:
            continue
        tag, attrs = tag.lower(), m["attrs"] or m["attrs2"] or ""
        if m["end"] or m["end2"]:
            if open_tags[tag] > 0:
                up, block = at, tag in BLOCK or tag in FOREIGN or tag == "template"
                while up.tag != tag and (block or up.tag not in BLOCK) and up.tag != "template":
                    up = up.parent
                if up.tag == tag:
                    at = leave(up.parent)
            continue
        while foreign and tag in BREAKS:
            up = at
            while up is not root and up.tag not in FOREIGN and up.tag not in POINTS:
                up = up.parent
            if up.tag not in FOREIGN:
                break
            at = leave(up.parent)
        if tag in BLOCK and open_tags["p"] > 0:
            up = at  # a block ends the paragraph that it begins in, with what is open in it
            while up is not root and up.tag not in BLOCK and up.tag != "template":
                up = up.parent
            if up.tag == "p":
                at = leave(up.parent)
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            up, top = at, None
            if any(open_tags[t] > 0 for t in ends):
                while up is not root and up.tag not in bounds and up.tag != "template":
                    top = up if up.tag in ends else top
                    up = up.parent
            if top is not None:
                at = leave(top.parent)
        if tag in ("html", "body") and open_tags[tag] > 0:
            continue
        node = Node(tag, at, surrounds(tag, attrs, open_tags["article"] + open_tags["main"] > 0))
        at.children.append(node)
        nodes.append(node)
        if tag not in VOID and (tag in BLOCK or not attrs.endswith("/")):
            at = node
            open_tags[tag] += 1
    if pos < len(page):
        at.children.append(page[pos:])
    settle(nodes)
    return nodes


def blocks(root: Node) -> list[tuple[str, Node]]:
    """The text of each block outside what surrounds an article, in page order, and the element that holds it."""
    out: list[tuple[str, Node]] = []
    buffer: list[str] = []
    owner = root

    def flush() -> None:
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append((text, owner))
            buffer.clear()

    stack: list[tuple[Node, int, Node, bool]] = [(root, 0, root, False)]
    while stack:
        node, i, holder, link = stack.pop()
        while i < len(node.children):
            child = node.children[i]
            i += 1
            if isinstance(child, str):
                if owner is not holder:
                    flush()
                    owner = holder
                buffer.append(child)
                n = len(child.strip())
                holder.length += n
                if link:
                    holder.linked += n
                continue
            if child.dropped:
                if child.tag in BLOCK:
                    flush()
                continue
            if child.tag in ("br", "wbr"):
                buffer.append(" " if child.tag == "br" else "")
                continue
            block = child.tag in BLOCK
            if block:
                flush()
            if child.tag == "a":
                holder.links += 1
            stack.append((node, i, holder, link))
            node, i, holder, link = child, 0, child if block else holder, link or child.tag == "a"
        if node.tag in BLOCK:
            flush()
    flush()
    return out


def whole_article(article: Node, nodes: list[Node], worth: Callable[[Node], float]) -> Node:
    """The element of an article and of what belongs to it beside it: a title before it, other articles, longer text."""
    titled = set()
    for node in nodes:
        if node.tag == "h1" and not node.dropped and node.length:
            while node is not None and node not in titled:
                titled.add(node)
                node = node.parent
    least = max(10.0, 0.2 * worth(article))
    region = node = article
    while node.tag not in ("body", "html") and node.parent is not None:
        before = True
        for other in node.parent.children:
            if other is node:
                before = False
            elif isinstance(other, Node) and not other.dropped and other.length:
                text = other.tag == "p" and other.length > 80 and other.linked < 0.25 * other.length
                if (before and (other.tag in HEADING or other in titled)) or other.tag == "article" or text or worth(other) >= least:
                    region = node.parent
        node = node.parent
    return region


def menus(nodes: list[Node], found: list[tuple[str, Node]], core: Node) -> set[Node]:
    """Elements of little but links before the first or after the last longer text, outside the core, that no heading introduces."""
    at = {node: i for i, node in enumerate(nodes)}
    prose = [at[owner] for text, owner in found if len(text) >= POINTED and owner.linked <= 0.66 * owner.length]
    if not prose:
        return set()
    last = list(range(len(nodes)))  # of an element, the place of the last element in it
    for i in range(len(nodes) - 1, 0, -1):
        up = at[nodes[i].parent]
        last[up] = max(last[up], last[i])
    introduced = set()
    heads = [0]  # before each element
    for node in nodes:
        heads.append(heads[-1] + (node.tag in HEADING and not node.dropped and node.length > 0))
        heading = False
        for child in node.children:
            if isinstance(child, str):
                heading = heading and not child.strip()
            elif not child.dropped:
                if heading:
                    introduced.add(child)
                heading = child.tag in HEADING
    kept = range(at[core], last[at[core]] + 1) if core.tag not in ("body", "html", "#root") else ()
    first, final = min(prose), max(prose)
    out = set()
    for i, node in enumerate(nodes):
        crowd = node.links >= 2 and node.linked > 0.66 * node.length and node.tag in ("ul", "ol", "dl", "div", "section", "table")
        if crowd and i not in kept and (last[i] < first or i > final) and node not in introduced and heads[last[i] + 1] == heads[i]:
            out.add(node)
    return out


def main_text(page: str) -> str:
    """The article's blocks, joined by an empty line; empty if there is no text."""
    nodes = parse(page)
    found = blocks(nodes[0])
    for node in reversed(nodes[1:]):
        for name in ("length", "linked", "links"):
            setattr(node.parent, name, getattr(node.parent, name) + getattr(node, name))
    scored: dict[Node, None] = {}
    for text, owner in found:
        if len(text) < POINTED:
            continue
        points = 1 + len(re.findall("[,،、，]", text)) + min(len(text) // 100, 3)
        up, level = owner.parent if owner.tag in PARAGRAPH and owner.parent else owner, 0
        while up is not None and up.tag != "#root" and level < len(LEVELS):
            up.score += points / LEVELS[level]
            scored[up] = None
            up, level = up.parent, level + 1

    def worth(node: Node) -> float:
        return node.score * (1 - node.linked / max(1, node.length))

    best = max(scored, key=worth, default=None)
    if best is None:  # nothing but short blocks: an article or main part, else all
        best = next((n for kind in ("article", "main", "body") for n in nodes if n.tag == kind and not n.dropped and n.length), nodes[0])
    up, article = best, None
    while up is not None and article is None:
        article, up = (up if up.tag in ("article", "main") else None), up.parent
    region = nodes[0] if article is None else whole_article(article, nodes, worth)
    unlike = menus(nodes, found, article or best)
    for node in nodes:
        node.inside = (node is region or (node.parent is not None and node.parent.inside)) and node not in unlike
    return "\n\n".join(text for text, owner in found if owner.inside)


def extract_text(frame: DataFrame, html_column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The rows with text, the main text of the whole html, and n_chars, its code points.

    Blocks of 25 characters or more give points to the five elements around
    them; that only chooses the container, and shorter blocks in it stay.
    Names of classes drop what surrounds an article, but no element that holds
    nearly all text.

    Null and empty html give an empty text; markup that breaks off or doesn't
    match is read as browsers do, nearly. One narrow pass without a shuffle:
    memory is that of one page's tree. Columns named text or n_chars are
    replaced; ``keep`` names those to return besides (all). Repeated rows each
    get their text; an empty table gives an empty result.
    """
    bounded(frame.sparkSession)
    keep = [c for c in (frame.columns if keep is None else keep) if c not in ("text", "n_chars")]
    source = frame.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html_column}`").alias("__html"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                texts = [main_text(page or "") for page in batch.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)
