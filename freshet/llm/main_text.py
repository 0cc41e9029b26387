"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.shared import small_batches, table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|select|title)\b(?>[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>",
    re.I | re.S,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_PUNCTUATION = ".,;:!?"

# How HTML elements nest, and the names that page furniture goes by.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "p": frozenset({"p"}), "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"}),
}
FURNITURE_TAGS = frozenset("head nav footer aside button dialog menu object canvas audio video map".split())
#: Elements that are furniture unless they hold the page's article.
DOUBTFUL_TAGS = frozenset("form label fieldset".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner billboard sponsor sponsored promo promotion navigation nav navbar menu breadcrumb breadcrumbs pagination pager toolbar"
    " sidebar aside widget footer header masthead topbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login search"
    " share sharing social related recommended recommendations comment comments reply replies discussion disqus respond form copyright legal skip contentinfo complementary".split()
)
#: Names that make furniture of an element even where another of its names says content.
STRONG_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsored promo comment comments reply replies related cookie cookies consent newsletter share sharing nav menu footer sidebar".split())
CONTENT_TAGS = frozenset({"article", "main"})
CONTENT_NAMES = frozenset("article main content post entry story body text".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are a piece of the content, never the one that holds it.
PIECES = HEADINGS | frozenset("p li pre blockquote ul ol table".split())


#: Elements that in an article are furniture by a strong name only.
CAPTIONED = HEADINGS | {"figure", "figcaption"}

#: An element of a doubtful tag or name that holds this share of the page's path weight is no furniture.
HELD = 0.8
#: A path whose fused ratio is below this share of the ratios' deviation is no content of its own.
SPREAD = 0.5


@dataclass
class Element:
    """An element of a page: its parent (-1: none), depth, tag, tag path, whether it or one around it is furniture, whether it says that it is content, the depth of the innermost one that says so, and the innermost element that may be furniture (-1: none)."""

    parent: int
    depth: int
    tag: str
    path: int
    furniture: bool
    content: bool
    content_depth: int
    doubt: int = -1


@dataclass
class Block:
    """A block of text: the element that it stands in (-1: none), its text and how much of it is links."""

    element: int
    text: str
    link_chars: int


@dataclass
class Page:
    """The elements and the text blocks of a page in order, and each tag path as (path of the parent, label)."""

    elements: list[Element]
    blocks: list[Block]
    paths: list[tuple[int, str]]


def _names(attrs: str) -> list[list[str]]:
    """The words of each class, id and role of an element: ``class="post sidebar-right"`` is [[post], [sidebar, right]]."""
    if "=" not in attrs:
        return []
    return [[w.lower() for w in _PART.findall(name)] for m in _NAMED.findall(attrs) for name in " ".join(m).split()]


def _furniture_names(names: list[list[str]]) -> set[str]:
    """The furniture names that an element is called by.

    ``has-sidebar`` and ``sidebar-right`` say how a page is laid out, and
    ``entry-header`` holds an article's title; neither counts.  A content name
    on the same element outweighs all but the strong names.
    """
    called = [set(w) for w in names if w and not FURNITURE_NAMES.isdisjoint(w) and w[0] not in ("has", "with", "no", "is") and w[-1] not in ("left", "right", "layout")]
    called = [w for w in called if not ("header" in w and w & CONTENT_NAMES)]
    content = any(w and not CONTENT_NAMES.isdisjoint(w) and FURNITURE_NAMES.isdisjoint(w) for w in names)
    found = {x for w in called for x in w if x in FURNITURE_NAMES}
    return found & STRONG_NAMES if content else found


def _is_hidden(attrs: str) -> bool:
    """Whether an element is not shown: by the attribute hidden, aria-hidden=true, or its style; names and other properties say nothing."""
    low = attrs.lower()
    if "hidden" not in low and "none" not in low:
        return False
    for m in _ATTRIBUTE.finditer(low):
        name, value = m[1], (m[2] or m[3] or m[4] or "").strip()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _UNSEEN.search(value)):
            return True
    return False


def _is_content(tag: str, names: list[list[str]]) -> bool:
    """Whether an element says that it is the content: article, main, or a name that ends so (``post-content``, but not ``text-center``)."""
    if tag in ("html", "body"):
        return False
    return tag in CONTENT_TAGS or any(w and w[-1] in CONTENT_NAMES and FURNITURE_NAMES.isdisjoint(w) for w in names)


def parse(page: str) -> Page:
    """The blocks of a page; inline elements do not break a block and take no part in its path.

    Elements know their parent and whether furniture is around them, and open
    tags are counted, so the work is in proportion to the page however deep it
    is nested.  A label in a paragraph outside any form is inline.  Elements of
    a strong name or a furniture tag are furniture; those of a doubtful tag or
    of another furniture name are in doubt.
    """
    out = Page([], [], [])
    named: dict[tuple[int, str], int] = {}
    stack: list[int] = []
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    links = link_depth = 0

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.blocks.append(Block(stack[-1] if stack else -1, text, min(links, len(text))))
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if text:
            parts.append(text)
            links += len(text) if link_depth else 0

    def close() -> str:
        tag = out.elements[stack.pop()].tag
        open_tags[tag] -= 1
        return tag

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            parts.append(" " if m["raw"] else "")
            continue
        if tag == "label":
            within = out.elements[stack[-1]].tag in PIECES if stack else False
            inline = not open_tags["label"] and (bool(m["end"]) or (within and not open_tags["form"]))
        else:
            inline = tag in INLINE
        if inline:
            if tag == "a":
                link_depth = max(0, link_depth + (-1 if m["end"] else 1))
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        if m["end"]:
            link_depth = 0
            while open_tags[tag] and close() != tag:
                pass
            continue
        if tag in VOID:
            continue
        closed = CLOSES.get(tag, frozenset({"p"}))
        while stack and out.elements[stack[-1]].tag in closed:
            close()
        attrs = m["attrs"]
        names = _names(attrs)
        parent, content, depth = stack[-1] if stack else -1, _is_content(tag, names), len(stack)
        around = out.elements[parent] if stack else Element(-1, -1, "", -1, False, False, -1)
        inside = any(open_tags[t] for t in CONTENT_TAGS)
        called = _furniture_names(names) if tag not in ("html", "body") else set()
        if tag in CAPTIONED and (inside or around.content_depth >= 0):
            called &= STRONG_NAMES
        if called and tag in CONTENT_TAGS:  # an article called by a furniture name is one only as a comment
            called &= {"comment", "comments", "reply", "replies"}
        furniture = tag in FURNITURE_TAGS or (tag == "header" and not inside) or bool(called & STRONG_NAMES) or _is_hidden(attrs)
        doubt = len(out.elements) if called or tag in DOUBTFUL_TAGS else around.doubt
        label = (around.path, ".".join([tag, *sorted({w for n in names for w in n})]))
        if label not in named:
            named[label] = len(out.paths)
            out.paths.append(label)
        stack.append(len(out.elements))
        open_tags[tag] += 1
        out.elements.append(Element(parent, depth, tag, named[label], furniture or around.furniture, content, depth if content else around.content_depth, doubt))
    add(page[at:])
    flush()
    return out


def path_weights(page: Page, blocks: list[Block]) -> tuple[list[float], list[float]]:
    """Two weights of each block's tag path: fused from smoothed ratios and thresholded, and from its own ratios alone.

    A path's ratios are text length (links left out) and punctuation for each of
    its blocks.  Smoothing takes half of the ratios of all blocks below the
    parent's path in, so that a path of a few short blocks is seen with those
    beside it.  The product of both is the weight, less for links; a path below
    a share of the weights' deviation has none, unless none is above.
    """
    key = lambda b: page.elements[b.element].path if b.element >= 0 else -1
    own: dict[int, list[float]] = defaultdict(lambda: [0.0] * 4)
    for b in blocks:
        for j, x in enumerate((1, len(b.text) - b.link_chars, sum(map(b.text.count, _PUNCTUATION)), len(b.text))):
            own[key(b)][j] += x
    below: dict[int, list[float]] = defaultdict(lambda: [0.0] * 4, {k: list(x) for k, x in own.items()})
    for path in range(len(page.paths) - 1, -1, -1):  # a path stands after its parent
        if path in below and (up := page.paths[path][0]) >= 0:
            for j, x in enumerate(below[path]):
                below[up][j] += x
    fused, plain = {}, {}
    for path, (n, size, marks, chars) in own.items():
        up = below[page.paths[path][0]] if path >= 0 and page.paths[path][0] >= 0 else own[path]
        text, punctuation = (size / n + up[1] / up[0]) / 2, (marks / n + up[2] / up[0]) / 2
        fused[path] = text * (1 + punctuation) * size / chars
        plain[path] = size / n * (1 + marks / n)
    weights = [fused[key(b)] for b in blocks]
    mean = sum(weights) / len(weights)
    least = min(SPREAD * math.sqrt(sum((w - mean) ** 2 for w in weights) / len(weights)), max(weights))
    return [w if w >= least else 0.0 for w in weights], [plain[key(b)] for b in blocks]


def without_furniture(page: Page) -> list[Block]:
    """The blocks outside furniture.

    An element in doubt is no furniture if it holds most of the weight of all
    paths outside plain furniture, has an element in it that says that it is
    content, or two blocks of prose at least, and no such element has text
    outside those in doubt.
    """
    elements = page.elements
    nodes = [b for b in page.blocks if b.element < 0 or not elements[b.element].furniture]
    doubt = [elements[b.element].doubt if b.element >= 0 else -1 for b in nodes]
    if max(doubt, default=-1) < 0:
        return nodes
    sure = [b for b, e in zip(nodes, doubt, strict=True) if e < 0]
    if any(b.element >= 0 and elements[b.element].content_depth >= 0 for b in sure):
        return sure
    weight, prose = defaultdict(float), Counter()
    for b, e, w in zip(nodes, doubt, path_weights(page, nodes)[0], strict=True):
        weight[e] += w
        inner = elements[b.element].content_depth if b.element >= 0 else -1
        said = e >= 0 and inner > elements[e].depth
        prose[e] += 2 if said else 2 * b.link_chars < len(b.text) and any(x in b.text for x in ".!?;")
    total = sum(weight.values())
    for e in range(len(elements) - 1, -1, -1):  # an element stands after the one around it
        up = elements[elements[e].parent].doubt if elements[e].parent >= 0 else -1
        if elements[e].doubt == e and up >= 0:
            weight[up] += weight[e]
            prose[up] += prose[e]
    held = {e for e in weight if e < 0 or (weight[e] >= HELD * total and prose[e] >= 2)}
    return [b for b, e in zip(nodes, doubt, strict=True) if e in held]


def main_text(page: str) -> str:
    """The article's blocks in page order, joined by one space.

    ``path_weights`` says which tag paths are content; furniture (by element or
    name) is none whatever its paths weigh, but a form or an element of a weak
    furniture name that holds most of the weight is none
    (``without_furniture``).  The element that holds the content
    paths' weight, from the root down the child with most of it, is the
    content's.  The way down ends at the first article, main or element with a
    content name.  From where it ended it goes back up to the outermost element
    whose other children hold blocks like the content (past a content element
    only other content elements count).  Below it every block is kept but for
    furniture and paths made of links, so that short paragraphs stay; where the
    content has no element of its own, only content paths stay.  Links inside an
    element that says that it is content stay where prose other than its main
    heading comes before them and prose follows, or where a colon announces them.
    """
    tree = parse(page)
    elements = tree.elements
    nodes = without_furniture(tree)
    if not nodes:
        return ""
    weights, plain = path_weights(tree, nodes)
    size: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for b in nodes:
        k = elements[b.element].path if b.element >= 0 else -1
        size[k][0] += len(b.text) - b.link_chars
        size[k][1] += len(b.text)
    lines = [(x := size[elements[b.element].path if b.element >= 0 else -1])[0] < 0.4 * x[1] for b in nodes]

    # the blocks of an element are neighbours: where they begin and end, and what they weigh
    first, last, weight = [len(nodes)] * len(elements), [0] * len(elements), [0.0] * len(elements)
    for i, b in enumerate(nodes):
        if b.element >= 0:
            e = b.element
            first[e], last[e], weight[e] = min(first[e], i), i + 1, weight[e] + weights[i]
    below: dict[int, list[int]] = defaultdict(list)
    for e in range(len(elements) - 1, -1, -1):  # an element stands after its parent
        up = elements[e].parent
        if last[e]:
            below[up].append(e)
            if up >= 0:
                first[up], last[up], weight[up] = min(first[up], first[e]), max(last[up], last[e]), weight[up] + weight[e]

    chain: list[int] = []
    at, total, own = -1, sum(weights), False
    while not own and below[at]:
        best = max(below[at], key=lambda e: (weight[e], -e))
        if weight[best] < 0.6 * total or elements[best].tag in PIECES:
            break
        chain.append(best)
        at, total, own = best, weight[best], elements[best].content
    span = lambda k: (first[chain[k]], last[chain[k]]) if k >= 0 else (0, len(nodes))
    a, z = span(len(chain) - 1)
    enough = 0.1 * sum(plain[a:z]) / (z - a)
    depth = len(chain)
    for up in range(len(chain)):
        page_level = up == 0 or elements[chain[up - 1]].tag in ("html", "body")
        (a, z), (kin_a, kin_z) = span(up - 1), span(up)

        def like(i: int) -> bool:
            e = nodes[i].element
            inner = elements[e] if e >= 0 else Element(-1, -1, "", -1, False, False, -1)
            heading = not own and not page_level and inner.depth >= up and inner.tag in HEADINGS  # noqa: B023
            return not lines[i] and (heading or (plain[i] >= enough and (not own or inner.content_depth >= up)))  # noqa: B023

        if any(like(i) for i in [*range(a, kin_a), *range(kin_z, z)]):
            depth = up
            break
    a, z = span(depth - 1)
    prose = [i for i in range(a, z) if not lines[i]]
    kept, before = [], -1
    for i in range(a, z):
        e = elements[nodes[i].element] if nodes[i].element >= 0 else None
        if not lines[i]:
            before = i
        elif not own or before < 0 or e is None or e.content_depth < 0:
            continue
        else:
            lead = nodes[before]
            titled = lead.element >= 0 and elements[lead.element].tag == "h1"
            if titled or not (i < prose[-1] or lead.text.endswith(":")):
                continue
        kept.append(i)
    kept = kept or list(range(a, z))
    if not depth or elements[chain[depth - 1]].tag in ("html", "body"):
        mean = sum(weights[i] for i in kept) / len(kept)
        spread = math.sqrt(sum((weights[i] - mean) ** 2 for i in kept) / len(kept))
        kept = [i for i in kept if weights[i] >= min(mean, spread) * 0.1]
    return " ".join(nodes[i].text for i in kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds text (the main text, empty if there is none) and n_chars (its code points) to every row.

    A null html is an empty page.  Repeated rows stay; input columns named like
    an added one are replaced.
    """

    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return column.map(lambda x: main_text(x) if x else "")

    return pages.withColumn("text", text(F.coalesce(F.col(html_col), F.lit("")))).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
