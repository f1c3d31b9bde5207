"""Main text of web pages by composite text density.

A tolerant tokenizer builds the element tree; scripts, styles and other non-text go at once, and
so do elements that name themselves as furniture (nav, header, footer, aside, form, ... or such
words in class, id or role; inside an <article> or <main> only names that nothing but furniture
bears), and hidden ones (hidden, aria-hidden="true", display: none).  A dropped element without end
tag ends where HTML implies it, or with what holds it.  For every element, C is its number of characters, T of tags, LC and
LT those in links; its composite density is

    C / T * log_b(C / LC * T / LT),   b = ln(C / (C - LC) * LC + LCb / Cb * C + e),

with body's LCb and Cb, and zeros taken as one.  An element's density sum is that of its children.
The element of the largest sum holds the main text; the smallest density on its path up to body
is the threshold, and other subtrees outside it that reach this threshold by their own largest
sum are kept too, unless links make up most of them.  Since the wanted text is the article with
its title, a selection inside an <article> (or <main>, where there is no article) widens to it and
the articles beside it, and one that holds articles (or <main>s) with most of its text narrows to
them; then nothing outside them is kept.  Where they hold half of it or less, the densities decide.

Blocks are the runs of text between block-level tags; white space inside becomes one space;
blocks stand in page order, joined by one newline.  Nothing else is dropped or capped.

Defined cases: null or empty html, or a page of furniture only, gives empty text; unclosed and
stray tags are closed or ignored; a page without body counts as one body; nested article elements
belong to the outermost; very deep nesting is walked without recursion; repeated rows are treated
alike; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<([/]?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*(?:>|\Z)", re.S)
_LAST_TAG = re.compile(r"</?[a-zA-Z][^<>]*\Z")
#: One whole attribute, so that names are never found inside other names or values.
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math select option object audio video canvas head button".split())
#: Of these, what is inside is text up to the end tag, not markup.
PLAIN = frozenset("script style textarea title iframe noembed noframes xmp".split())
FURNITURE = frozenset("nav header footer aside form dialog menu fieldset search".split())
#: What a head may hold; anything else ends it.
HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion|s)?|banner|sidebar|side|aside|nav|navbar|navigation|menu|breadcrumbs?|footer|header|masthead|"
    r"comments?|replies|reply|disqus|discussion|respond|notices?|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|"
    r"widget|toolbar|pagination|pager|skip|search|form|disclaimer|alert|toast|outbrain|taboola|teaser|legal|copyright|paywall|toc|contentinfo|complementary|dialog)(?:$|[\s_-]|\d)",
    re.I,
)

#: Inside an article, a word of class, id or role counts only if each of its parts is one of these,
#: and one of them is of the first kind, or of the second beside one of the third.
_INNER = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos sidebar nav navbar navigation breadcrumb breadcrumbs comments disqus cookies cookie consent gdpr "
    "popup modal newsletter subscribe signup login share sharing pagination pager paywall toolbar widget outbrain taboola toc contentinfo complementary".split()
)
_INNER_WEAK = frozenset("social related recommended reply replies respond comment banner search form menu skip teaser alert toast dialog".split())
_INNER_PARTS = frozenset("box bar block links link buttons button list posts post articles article stories items area container wrapper wrap widget slot unit section panel overlay form icons media module tools top bottom inline".split())


class Node:
    __slots__ = ("tag", "parent", "kids", "chars", "tags", "link_chars", "link_tags", "density", "sum", "in_link", "in_article")

    def __init__(self, tag, parent):
        self.tag, self.parent, self.kids = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.in_link = tag == "a" or (parent is not None and parent.in_link)
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)


def _inner(value: str) -> bool:
    """Whether class, id or role names furniture so clearly that it counts inside an article too."""
    for word in value.lower().split():
        parts = [x for x in re.split(r"[_-]+|\d+", word) if x]
        strong, weak, rest = (any(x in kind for x in parts) for kind in (_INNER, _INNER_WEAK, _INNER_PARTS))
        if (strong or weak and rest) and all(x in _INNER or x in _INNER_WEAK or x in _INNER_PARTS for x in parts):
            return True
    return False


def _furniture(tag: str, attrs: str, within: bool = False) -> bool:
    """Whether the element is dropped; within: it stands in an <article> or <main>."""
    if tag in FURNITURE:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id", "role") and (_inner(value) if within else _NAMES.search(value)):
            return True
        if name == "aria-label" and not within and _NAMES.search(value):
            return True
    return False


def _end_skip(skip: list[str], tag: str) -> bool:
    """Whether a start tag ends the outermost dropped element, whose end tag may be left out; inner ones are closed."""
    if skip[0] == "head" and len(skip) == 1 and tag not in HEAD:
        skip.clear()
        return True
    for x in range(len(skip) - 1, -1, -1):
        up = skip[x]
        if up in _SELF.get(tag, ()) or up == "p" and tag in ENDS_P:
            del skip[x:]
            return not skip
        if up in _STOPS.get(tag, ()) or up in BLOCKS or up in RAW:
            # what stands between li and li may be blocks, except those that hold lists or text of their own
            if tag not in _SELF or up in _STOPS[tag] or up in RAW or up in ("article", "div", "section"):
                return False
    return False


def parse(page: str) -> tuple[Node, list]:
    """The tree, and the stream of its text: (node, text) and (node, None) at block borders."""
    root = Node("html", None)
    node, pos, stream = root, 0, []
    skip: list[str] = []  # open elements since one whose content is dropped

    def text(chunk: str):
        if skip == ["head"] and chunk.strip():
            skip.clear()
        if chunk and not skip:
            chunk = _html.unescape(chunk)
            node.kids.append(chunk)
            stream.append((node, chunk))

    n = len(page)
    while pos < n:
        m = _TOKEN.search(page, pos)
        if m is None:
            cut = _LAST_TAG.search(page, pos)
            text(page[pos : cut.start() if cut else n])
            break
        text(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag, closing, attrs = m[2].lower(), bool(m[1]), m[3] or ""
        if skip:
            if closing:
                if tag in skip:
                    while skip and skip.pop() != tag:
                        pass
                else:
                    up, blocks = node, tag in BLOCKS or tag == "html"
                    if not blocks and any(x in BLOCKS for x in skip):
                        up = None  # an inline end tag does not close blocks
                    while up is not None and up.tag != tag:
                        up = up.parent if blocks or up.tag not in BLOCKS else None
                    if up is not None:  # an unclosed dropped element ends with what holds it
                        skip.clear()
                        node = up.parent or up
                        stream.append((node, None if blocks else ""))
                continue
            if _end_skip(skip, tag):
                pos = m.start()
                continue
            if tag not in VOID and not attrs.endswith("/"):
                if tag in PLAIN:
                    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
                    pos = end.end() if end else n
                else:
                    skip.append(tag)
            continue
        if closing:
            if tag in BLOCKS:
                stream.append((node, None))
            up = node
            while up is not None and up.tag != tag:
                if tag not in BLOCKS and up.tag in BLOCKS:
                    up = None  # an inline end tag does not close blocks
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        if tag in PLAIN:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else n
            continue
        if tag in ("html", "body"):
            if tag == "body":
                while node.parent is not None:
                    node = node.parent
                node = _child(node, "body")
            continue
        if tag == "br" or tag == "wbr":
            node.kids.append(Node(tag, node))
            if tag == "br":
                stream.append((node, " "))
            continue
        if tag in ENDS_P:
            up = node
            while up is not None and up.tag != "p" and (up.tag not in BLOCKS or up.tag == "p"):
                up = up.parent
            if up is not None and up.tag == "p":
                node = up.parent
        if tag in _SELF:
            up = node
            while up is not None and up.tag not in _SELF[tag] and up.tag not in _STOPS[tag] and up.tag not in ("body", "article", "div", "section"):
                up = up.parent
            if up is not None and up.tag in _SELF[tag]:
                node = up.parent
        if tag in BLOCKS:
            stream.append((node, None))
        if tag in VOID:
            node.kids.append(Node(tag, node))
        elif tag in RAW or _furniture(tag, attrs, node.in_article):
            if not attrs.endswith("/"):
                skip.append(tag)
            stream.append((node, None if tag in BLOCKS else ""))
        else:
            node = _child(node, tag)
            if attrs.endswith("/") and tag not in BLOCKS:
                node = node.parent
    return root, stream


def _child(parent: Node, tag: str) -> Node:
    node = Node(tag, parent)
    parent.kids.append(node)
    return node


def measure(root: Node) -> list[Node]:
    """All elements, each before what it holds, with their counts, densities and density sums."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    for node in reversed(order):
        own = sum(len("".join(k.split())) for k in node.kids if isinstance(k, str))
        node.chars += own
        if node.in_link:
            node.link_chars += own
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")
    whole = next((x for x in order if x.tag == "body"), root)
    ratio = whole.link_chars / max(whole.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
            inside = (c / max(lc, 1)) * (t / lt)
            node.density = c / t * (math.log(inside) / math.log(base) if base > 1 and inside > 0 else math.log(max(inside, 1)))
            if node.density < 0:
                node.density = 0.0
    for node in order:
        if node.parent is not None:
            node.parent.sum += node.density
    return order


def _inside(node: Node | None, chosen: set[int]) -> bool:
    while node is not None:
        if id(node) in chosen:
            return True
        node = node.parent
    return False


def select(order: list[Node]) -> list[Node]:
    """The subtrees that hold the main text."""
    body = next((x for x in order if x.tag == "body"), order[0])
    best = max(order, key=lambda x: x.sum if x.chars else -1.0)  # the first of equals
    if not best.chars:
        return []
    if best.sum <= 0:
        best = body
    for kind in ("article", "main"):
        up, found = best, None
        while up is not None:
            if up.tag == kind:
                found = up
            up = up.parent
        if found is not None:
            return [x for x in order if x.tag == kind and x.chars and x.parent is found.parent]
        inside, todo = [], [best]
        while todo:
            node = todo.pop()
            if node.tag == kind and node.chars:
                inside.append(node)
            else:
                todo.extend(k for k in node.kids if isinstance(k, Node))
        if 2 * sum(x.chars for x in inside) > best.chars:
            return inside
    if best in (body, order[0]):
        return [best]
    path, up = [best.density], best.parent
    while up is not None and up is not body.parent:
        path.append(up.density)
        up = up.parent
    threshold = min(path)
    chosen = [best]
    ids = {id(best)}
    todo = [k for k in body.kids if isinstance(k, Node)]
    while todo:
        node = todo.pop()
        if id(node) in ids:
            continue
        holds = best
        while holds is not None and holds is not node:
            holds = holds.parent
        if holds is node:
            todo.extend(k for k in node.kids if isinstance(k, Node))
        elif node.chars and (node.density >= threshold or re.fullmatch("h[1-3]", node.tag)) and node.link_chars * 2 < node.chars:
            ids.add(id(node))
            chosen.append(node)
    return chosen


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root, stream = parse(page)
    chosen = {id(x) for x in select(measure(root))}
    if not chosen:
        return ""
    known: dict[int, bool] = {}
    blocks, run = [], []

    def end():
        if run:
            line = " ".join("".join(run).split())
            run.clear()
            if line:
                blocks.append(line)

    for node, chunk in stream:
        if chunk is None:
            end()
            continue
        hit = known.get(id(node))
        if hit is None:
            hit = known[id(node)] = _inside(node, chosen)
        if hit:
            run.append(chunk)
        else:
            end()
    end()
    return "\n".join(blocks)


def _extract(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            texts = [extract(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
