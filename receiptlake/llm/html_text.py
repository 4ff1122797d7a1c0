"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf path of tags and
classes. For every path the length of its text, its punctuation and its linked
text are summed and divided by its blocks; that ratio is smoothed with the
ratios of the neighbouring blocks in page order, fused with the smoothed one,
and only then weighed by what tags, roles and class names of the path say:
menus, footers, adverts, comments and the like weigh little. The content root is
the article or main element with the most of it, or else the deepest element
that holds most of it; a page whose paragraphs are all in parts of little weight
has its root there. What weighs less than its root is no content, however long. All other
blocks of the root are, short ones and lists too; but under a root that is no
article or main element a part of it that is mostly links must reach a share of
the best path's ratio, hold a heading or lie between content.

Defined results: null, empty or text-free pages give an empty text; attributes
are read by HTML's rules, quoted or not; unclosed and crossing tags are closed
as browsers do in the simple cases, in time linear in the page; a page cut off
inside a tag or script loses that part; hidden elements are no text; repeated
rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of HTML elements and usual names of page parts.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "canvas")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math semantics mrow mi mn mo mtext ms mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced mstyle".split()
)
ASIDE = frozenset("nav header footer aside form button menu dialog fieldset".split())
NEVER = frozenset("head select option annotation annotation-xml".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer foot sidebar side aside widget widgets comment comments commentlist respond reply replies disqus cookie cookies consent notice "
    "notices notification alert gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations pagination pager search form legal copyright skip toolbar".split()
)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = frozenset("p li h1 h2 h3 td tr".split())
SCOPE = frozenset("ul ol dl table body article main section div".split())

_ATTRIBUTE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?)?"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|=|{_ATTRIBUTE})*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|[^\s>"'][^\s>]*+)?)?""")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
WITHOUT = re.compile(r"(?:no|with|without|has|have)[-_]")  # names that tell what stands in or beside an element, not what it is
#: Weights of paths through elements that are no content by their kind, or by a class name; shares of the best path's ratio, of a page's content and of its text; the share of links from which a part is mostly links.
ASIDE_WEIGHT, PART_WEIGHT = 0.05, 0.1
CONTENT_SHARE, ROOT_SHARE, PATH_SHARE, PROPER_SHARE, LINK_SHARE = 0.2, 0.6, 0.05, 0.01, 0.5


class Node:
    """An open or closed element: a link to its parent, and what it takes over from it."""

    __slots__ = ("block", "heading", "inline", "name", "number", "parent", "path", "scope", "weight")

    def __init__(self, parent, name: str, number: int, path: int, weight: float):
        self.parent, self.name, self.number, self.weight = parent, name, number, weight
        inline = name in INLINE
        self.block = parent.block if parent and inline else self
        self.path = parent.path if parent and inline else path
        self.heading = (parent is not None and parent.heading) or name in HEADINGS
        # open elements by name, since the last scope and since the last element that is not inline
        self.scope = parent.scope if parent and name not in SCOPE else {}
        self.inline = parent.inline if parent and inline else {}


class Block:
    __slots__ = ("linked", "node", "pieces")

    def __init__(self, node: Node):
        self.node, self.pieces, self.linked = node, [], 0


class Page:
    """The elements of a page in order, and its blocks of text."""

    def __init__(self, page: str):
        self.top = Node(None, "", 0, 0, 1.0)
        self.nodes, self.out, self.stack = [self.top], [], [self.top]
        self.paths: dict[tuple[int, str], int] = {}
        self.open: dict[str, int] = {}
        self.current: Block | None = None
        self.read(page)

    def put(self, text: str) -> None:
        if self.current is None:
            if not text.strip():
                return
            self.current = Block(self.stack[-1])
            self.out.append(self.current)
        self.current.pieces.append(text)
        if self.open.get("a"):
            self.current.linked += len(text.strip())

    def pop(self) -> str:
        node = self.stack.pop()
        self.open[node.name] -= 1
        node.parent.scope[node.name] -= 1
        if node.name in INLINE:
            node.inline[node.name] -= 1
        return node.name

    def pop_to(self, names) -> None:
        while self.pop() not in names:
            pass

    def push(self, name: str, attributes: str) -> None:
        top = self.stack[-1]
        if name not in INLINE:
            self.current = None
            if name in CLOSES_P and top.scope.get("p"):
                self.pop_to(("p",))
            same = SAME.get(name, ())
            if any(self.stack[-1].scope.get(n) for n in same):
                self.pop_to(same)
            top = self.stack[-1]
        a = {}
        for k, v in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
            a.setdefault(k.lower(), v.strip("\"'").lower())
        names = [c for c in (a.get("class", "") + " " + a.get("id", "")).split() if not WITHOUT.match(c)]
        weight = 1.0
        if name not in ("article", "main", "body", "html") and not PARTS.isdisjoint(re.split(r"[^a-z]+", " ".join(names))):
            weight = PART_WEIGHT
        own_header = name == "header" and (self.open.get("article") or self.open.get("main"))
        if name in ASIDE and not own_header or a.get("role") in ROLES:
            weight = ASIDE_WEIGHT
        if name in NEVER or "hidden" in a or a.get("aria-hidden") == "true":
            weight = 0.0
        if attributes.endswith("/") and name not in INLINE and not re.search(r"=\s*[^\s\"']*/\Z", attributes):
            return
        step = f"{name}.{a['class']}" if "class" in a else name
        path = top.path if name in INLINE else self.paths.setdefault((top.path, step), len(self.paths) + 1)
        node = Node(top, name, len(self.nodes), path, min(weight, top.weight))
        self.nodes.append(node)
        self.stack.append(node)
        self.open[name] = self.open.get(name, 0) + 1
        top.scope[name] = top.scope.get(name, 0) + 1
        if name in INLINE:
            node.inline[name] = node.inline.get(name, 0) + 1

    def read(self, page: str) -> None:
        at = 0
        while (start := page.find("<", at)) >= 0:
            m = TOKEN.match(page, start)
            if m is None:  # a sign, not a tag
                self.put(html.unescape(page[at : start + 1]))
                at = start + 1
                continue
            if start > at:
                self.put(html.unescape(page[at:start]))
            at = m.end()
            name = (m.group(2) or "").lower()
            if not name:
                if page.startswith("<![CDATA[", start):
                    self.put(m.group(0)[9:].removesuffix("]]>"))
            elif m.group(1):
                if name not in INLINE:
                    self.current = None
                if self.stack[-1].inline.get(name) if name in INLINE else self.open.get(name):
                    self.pop_to((name,))
            elif name in RAW:
                if not m.group(3).rstrip().endswith("/"):
                    at = re.compile(rf"</{name}(?:[\s/][^>]*)?>|\Z", re.I).search(page, at).end()
            elif name in ("br", "wbr"):
                if self.current is not None:
                    self.put(" " if name == "br" else "")
            elif name in VOID:
                if name == "hr":
                    self.current = None
            else:
                self.push(name, m.group(3))
        self.put(html.unescape(page[at:]))

    def blocks(self) -> list[tuple[Block, str]]:
        """Blocks with their text, in page order, but for hidden ones."""
        texts = [(b, " ".join("".join(b.pieces).split())) for b in self.out if b.node.weight]
        return [(b, t) for b, t in texts if t]


def path_ratios(found: list[tuple[Block, str]]) -> dict[int, float]:
    """The ratio of every path, smoothed, fused and then weighed."""
    sums: dict[int, list[float]] = {}
    weight: dict[int, float] = {}
    for b, t in found:
        s = sums.setdefault(b.node.path, [0.0, 0.0, 0.0, 0.0])
        weight[b.node.path] = max(weight.get(b.node.path, 0.0), b.node.block.weight)
        s[0] += 1
        s[1] += len(t)
        s[2] += len(PUNCTUATION.findall(t))
        s[3] += min(b.linked, len(t))
    ratio = {p: math.log1p(n_len / n) * (1 + math.log1p(n_punct / n)) * (1 - n_link / n_len) for p, (n, n_len, n_punct, n_link) in sums.items()}
    own = [ratio[b.node.path] for b, _ in found]
    smooth = dict.fromkeys(sums, 0.0)
    for i, (b, _) in enumerate(found):
        smooth[b.node.path] += sum(w * own[min(max(i + k - 1, 0), len(own) - 1)] for k, w in enumerate((0.25, 0.5, 0.25)))
    return {p: weight[p] * math.sqrt(max(0.0, ratio[p] * smooth[p] / sums[p][0])) for p in sums}


def main_text(page: str) -> str:
    parsed = Page(page)
    found = parsed.blocks()
    if not found:
        return ""
    fused = path_ratios(found)
    best, everything = max(fused[b.node.path] / b.node.block.weight for b, _ in found), sum(len(t) for _, t in found)
    own: dict[int, int] = {}
    for b, t in found:
        if b.node.block.weight == 1.0 and not b.node.heading:
            own[b.node.path] = own.get(b.node.path, 0) + len(t)
    # with proper paragraphs on the page, parts of little weight have no say in where its content is
    proper = any(fused[p] >= CONTENT_SHARE * best and n >= PROPER_SHARE * everything for p, n in own.items())
    held = [0.0] * len(parsed.nodes)
    for b, t in found:
        if b.node.block.weight == 1.0 or not proper:
            held[b.node.block.number] += fused[b.node.path] * len(t)
    total = sum(held)
    for node in reversed(parsed.nodes[1:]):
        held[node.parent.number] += held[node.number]
    roots = [n for n in parsed.nodes if n.name in ("article", "main") and held[n.number]]
    if roots:
        root = max(roots, key=lambda n: (held[n.number], n.number))
    else:
        root = max((n for n in parsed.nodes if held[n.number] >= ROOT_SHARE * total and n.name not in LEAVES and n.block is n), key=lambda n: n.number)
    # the part of the root that every element is in: a child of the root, or the root itself
    part: list[int | None] = [None] * len(parsed.nodes)
    for n in parsed.nodes:
        part[n.number] = n.number if n is root or n.parent is root else part[n.parent.number] if n.parent else None
    inside = [(b, t, part[b.node.block.number]) for b, t in found if part[b.node.block.number] is not None]
    length: dict[int, int] = {}
    lengths: dict[int, int] = {}
    linked: dict[int, int] = {}
    for b, t, k in inside:
        length[b.node.path] = length.get(b.node.path, 0) + len(t)
        lengths[k] = lengths.get(k, 0) + len(t)
        linked[k] = linked.get(k, 0) + min(b.linked, len(t))
    everything = sum(length.values())
    least = CONTENT_SHARE * max((fused[p] for p, n in length.items() if n >= PATH_SHARE * everything), default=0.0)
    weights = {k: 0.0 for k in lengths}
    for b, t, k in inside:
        weights[k] += fused[b.node.path] * len(t)

    full = [b.node.block.weight >= root.block.weight for b, _, _ in inside]
    content = [i for i, (b, _, _) in enumerate(inside) if full[i] and fused[b.node.path] >= least]

    def stays(i: int, b: Block, k: int) -> bool:
        if not full[i] or roots or linked[k] < LINK_SHARE * lengths[k]:
            return full[i]
        ratio = fused[b.node.path]
        between = ratio > 0 and content and content[0] < i < content[-1]
        return ratio >= least or between or b.node.heading or weights[k] >= least * lengths[k]

    return " ".join(t for i, (b, t, k) in enumerate(inside) if stays(i, b, k))


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text) for every row of pages."""

    def run(it):
        for batch in it:
            texts = [main_text(p.as_py() or "") for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
