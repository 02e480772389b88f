"""Operator 10: main text of web pages by wrapper induction.

Every page becomes a tree of block elements, in which runs of siblings with equal shape are one node (a list of any
length, an article of any number of paragraphs). For each host the most frequent tree is the reference; the trees of
its pages are aligned with it by simple tree matching (the dynamic program that finds the largest set of matched
nodes in order). What stands at an aligned node is compared over all pages of the host. Constant is, and so template:

* a text that ``share`` of the host's distinct pages have at one node (``constant``);
* a node whose texts are mostly links (``linked``);
* a node outside the host's data region if its texts recur on other pages, begin with the same two words, or are
  next to nothing beside the region (``outside``). The data region is the deepest container that holds nearly all of
  the host's varying text; the node that repeats the pages' titles is their headline and no template. A page with more
  text at such nodes than in the region is not what the wrapper describes, and keeps them.

Varying slots are content. Tags and classes only settle what the wrapper leaves open, or all where a host has too few
pages for one: elements that are named as navigation, advert, form, comment and the like go, and where a page has an
article or main element, content is what lies in it.

What is shuffled are (host, tree) and (host, node, hash of a text) counts, summed before the shuffle, so a host with a
third of all pages is no load for one task; distinct pages are counted exactly, from (host, node, hash of a text,
digest of a page). A wrapper is a row a host and of about a page's size: its texts are on ``share`` of the pages, its
nodes in the reference or on a hundredth of the pages. Wrappers are joined to the pages by broadcast while their rows
and bytes are under a checked bound, and by shuffle beyond.

Defined cases: null and empty html gives an empty text; pages without a usable host share the host ""; hosts with
fewer than ``least`` distinct pages have no wrapper; equal pages: a page's text is only template if pages that are not
copies of each other have it, so copies count once, among the pages that have a text as among all of the host;
repeated rows get equal results; ties between trees go to the greater text of the tree; broken markup is read as far
as it goes, and open elements end where the page or their parent ends; very long and deep pages take time in
proportion to their length; ids of any type come back as they are; an empty table gives none; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.llm.common import Scratch, map_texts, table

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics annotation".split()
)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SKIPPED = frozenset("nav footer aside form script style noscript template iframe svg button select option textarea input dialog menu head title".split())
# Words of class and id attributes that name what is no main text, and words that go with them.
NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside "
    "cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended newsletter subscribe "
    "subscription signup login widget toolbar pagination pager skip search".split()
)
BESIDE = frozenset("site page main top bottom left right global primary secondary box bar block wrapper wrap container list links inner outer area section panel form buttons items js mobile desktop".split())
READERS = frozenset("comment comments disqus reply replies respond".split())
BESIDE_READERS = BESIDE | frozenset("user users reader readers thread threads count title heading author meta content body text date time avatar feed header footer item entry wp div li id s form field".split())
TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>|</([a-zA-Z][^\s<>/]*)[^<>]*>|<([a-zA-Z][^\s<>/]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|([^<]+|<)", re.S
)
ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+|[0-9]+")


@dataclass(eq=False)
class Shape:
    """A label and the shapes of children. Equal shapes of one tree are one object; ``size`` counts nodes."""

    label: str
    children: tuple
    size: int


@dataclass(eq=False)
class Node:
    tag: str
    names: str = ""
    skipped: bool = False  # named as no main text, or in such an element
    parent: Node | None = None
    children: list = field(default_factory=list)  # nodes and (text, whether in a link)
    framed: bool = False  # in an article or main element, or one itself
    shape: Shape | None = None
    title: str = ""  # the page's, at the root


def parse(page: str | None) -> Node:
    """The tree of block elements; inline elements leave their text in the block."""
    root = Node("html")
    at, links, pos, page = root, 0, 0, page or ""
    low = None
    while (m := TOKEN.match(page, pos)) is not None:
        pos = m.end()
        end, start, attrs, text = m.group(1, 2, 3, 4)
        if text is not None:
            at.children.append((text, links > 0))
        elif start is not None:
            tag = start.lower()
            if tag in RAW:
                low = low or page.lower()
                stop = low.find(f"</{tag}", pos)
                if tag == "title" and not root.title:
                    root.title = flat(page[pos : len(page) if stop < 0 else stop])
                pos = len(page) if stop < 0 else max(pos, (page.find(">", stop) + 1) or len(page))
                continue
            if tag == "br" or tag == "hr":
                at.children.append((" ", False))
            if tag == "a":
                links = 1
            if tag in INLINE or tag in VOID or tag in ("html", "body", "tbody"):
                continue
            if tag in CLOSES_P:
                at = up_to(at, "p", CLOSES_P - {"p"})
            elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                at = up_to(at, tag, frozenset(("ul", "ol", "dl", "table", "menu")))
            names = ""
            if attrs:
                names = " ".join(x for a in ATTR.findall(attrs) for x in NAME.findall((a[1] or a[2] or a[3]).lower()))
            skipped = tag in SKIPPED or bool(attrs and named(attrs, tag, at)) or (tag == "header" and not at.framed)
            node = Node(tag, names, skipped or at.skipped, at, framed=at.framed or tag in ("article", "main"))
            at.children.append(node)
            if not attrs.rstrip().endswith("/"):
                at = node
        elif end is not None:
            tag = end.lower()
            if tag == "a":
                links = 0
            if tag in INLINE or tag in VOID:
                continue
            up = at
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                at, links = up.parent, 0
    return root


def flat(text: str) -> str:
    """Character references decoded, runs of white space as one space, trimmed."""
    return " ".join(html.unescape(text).split())


def named(attrs: str, tag: str, at: Node) -> bool:
    """Whether a class, id or role names what is no main text: all its words do, but for those that go with them.

    So ``site-header`` does, ``post-header`` and ``search-term`` do not; ``comment-list`` does, but ``comments-open``,
    ``has-comments`` and ``no-reply`` say something about an article. Articles and the main part are never named so,
    except an article within an article: that is how readers' comments are marked up.
    """
    own = tag == "main" or (tag == "article" and not within(at, "article"))
    for a in ATTR.findall(attrs) if not own else ():
        for value in (a[1] or a[2] or a[3]).lower().split():
            words = [w for w in NAME.findall(value) if w.isalpha()]
            if not READERS.isdisjoint(words) and all(w in READERS or w in BESIDE_READERS for w in words):
                return True
            if tag != "article" and not NAMES.isdisjoint(words) and all(w in NAMES or w in BESIDE for w in words):
                return True
    return False


def within(at: Node | None, tag: str) -> bool:
    while at is not None and at.tag != tag:
        at = at.parent
    return at is not None


def up_to(at: Node, tag: str, walls: frozenset) -> Node:
    """Above the nearest open ``tag``, unless a wall stands between; else where we are."""
    up = at
    while up is not None and up.tag != tag:
        if up.tag in walls:
            return at
        up = up.parent
    return at if up is None or up.parent is None else up.parent


# --- Trees and their matching ----------------------------------------------------------------------------------


def label(n: Node) -> str:
    return f"{n.tag}.{n.names.replace(' ', '.')}" if n.names else n.tag


def known(label: str, children: list[Shape], table: dict) -> Shape:
    """The shape in ``table`` with this label and these children."""
    key = label, tuple(children)
    if key not in table:
        table[key] = Shape(*key, 1 + sum(c.size for c in children))
    return table[key]


def shape(root: Node) -> Shape:
    """The tree of labels, equal neighbours once; built from the leaves, each node keeps its own."""
    table: dict = {}
    order = [root]
    for n in order:
        order.extend(c for c in n.children if isinstance(c, Node))
    for n in reversed(order):
        out: list[Shape] = []
        for c in n.children:
            if isinstance(c, Node) and (not out or out[-1] is not c.shape):
                out.append(c.shape)
        n.shape = known(label(n), out, table)
    return root.shape


def written(s: Shape) -> str:
    out, todo = [], [s]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        out.append(x.label)
        if x.children:
            todo.append(")")
            for c in reversed(x.children):
                todo += c, ","
            todo[-1] = "("
    return "".join(out)


def read_shape(text: str) -> Shape:
    table: dict = {}
    stack: list[list] = [["", []]]  # the open shapes: a label ends at the next comma or bracket after its children

    def close() -> None:
        name, children = stack.pop()
        stack[-1][1].append(known(name, children, table))

    for part in re.findall(r"[^(),]+|[(),]", text):
        if part not in "(),":
            stack.append([part, []])
        elif part != "(" and len(stack) > 1:
            close()
    while len(stack) > 1:
        close()
    return stack[0][1][0] if stack[0][1] else known("html", [], table)


def match(a: Shape, b: Shape, memo: dict) -> tuple[int, tuple]:
    """Simple tree matching: (matched nodes, matched pairs of child positions) of two trees with equal labels."""
    if a.label != b.label:
        return 0, ()
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        if (x, y) in memo:
            todo.pop()
            continue
        below = [(c, d) for c in x.children for d in y.children if c.label == d.label and (c, d) not in memo]
        if below:
            todo += below
            continue
        memo[todo.pop()] = matched_children(x, y, memo)
    return memo[a, b]


def matched_children(a: Shape, b: Shape, memo: dict) -> tuple[int, tuple]:
    """``match`` of two trees, of whose children all pairs with equal labels are in ``memo``."""
    rows = [[0] * (len(b.children) + 1)]
    for x in a.children:
        row = [0]
        for j, y in enumerate(b.children, 1):
            w = memo[x, y][0] if x.label == y.label else 0
            row.append(max(row[-1], rows[-1][j], rows[-1][j - 1] + w))
        rows.append(row)
    pairs, i, j = [], len(a.children), len(b.children)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return 1 + rows[-1][-1], tuple(reversed(pairs))


def alignment(page: str, reference: str) -> array:
    """Numbers of the nodes of a written tree, in its order: an aligned node has its partner's place in the reference,
    others a negative digest of their path, so of one length at any depth."""
    a, ref, memo, out = read_shape(page), read_shape(reference), {}, array("q")
    todo = [(a, ref if ref.label == a.label else None, 0 if ref.label == a.label else below_zero(a.label))]
    while todo:
        a, b, name = todo.pop()
        out.append(name)
        partner = dict(match(a, b, memo)[1]) if b is not None else {}
        places = [name + 1] if b is not None else []
        for c in b.children if b is not None else ():
            places.append(places[-1] + c.size)
        below = []
        for i, child in enumerate(a.children):
            j = partner.get(i)
            below.append((child, None, below_zero(f"{name}/{child.label}")) if j is None else (child, b.children[j], places[j]))
        todo += reversed(below)
    return out


def below_zero(text: str) -> int:
    return -1 - (digest(text) & 0x7FFFFFFFFFFFFFFF)


_aligned: dict[tuple[str, str], array] = {}


def aligned(page: str, reference: str) -> array:
    """``alignment``, remembered for trees of usual size; all is forgotten at a bound."""
    if len(page) > 4000:
        return alignment(page, reference)
    if (page, reference) not in _aligned:
        if len(_aligned) >= 5000:
            _aligned.clear()
        _aligned[page, reference] = alignment(page, reference)
    return _aligned[page, reference]


def blocks(root: Node) -> Iterator[tuple[int, Node, str, int]]:
    """(place in the written shape, block, its text, characters in links) in page order, once ``shape`` has run."""
    text, linked = [], 0
    todo = [[root, 0, iter([*root.children, None]), None, 1]]  # block, its place, what follows, last shape and its place
    while todo:
        top = todo[-1]
        n, at, rest, last, place = top
        for c in rest:
            if isinstance(c, tuple):
                text.append(c[0])
                linked += len(c[0]) * c[1]
                continue
            if text:
                if block := flat("".join(text)):
                    yield at, n, block, linked
                text, linked = [], 0
            if c is None:
                todo.pop()
            else:
                if c.shape is not last:
                    place = at + 1 if last is None else place + last.size
                    top[3:] = c.shape, place
                todo.append([c, place, iter([*c.children, None]), None, 0])
            break


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@dataclass(frozen=True)
class Wrapper:
    """What a host's pages have in common: see ``induce``."""

    reference: str
    constant: frozenset  # (node, digest of a text)
    linked: frozenset  # nodes
    outside: frozenset  # nodes
    first: int  # the data region: places in the reference from first to last
    last: int


def main_text(page: str | None, w: Wrapper | None) -> tuple[str, int]:
    """The main text of a page, and the number of blocks that the wrapper took out."""
    root = parse(page)
    tree = written(shape(root))
    found = list(blocks(root))
    template = [False] * len(found)
    if w is not None:
        to = aligned(tree, w.reference)
        nodes = [to[at] for at, _, _, _ in found]
        template = [v in w.linked or (v, digest(text)) in w.constant for v, (_, _, text, _) in zip(nodes, found, strict=True)]
        rest = [(v, len(text)) for v, gone, (_, _, text, _) in zip(nodes, template, found, strict=True) if not gone]
        if sum(n for v, n in rest if w.first <= v <= w.last) >= sum(n for v, n in rest if v in w.outside):
            template = [gone or v in w.outside for v, gone in zip(nodes, template, strict=True)]
    left = [(n, text) for gone, (_, n, text, _) in zip(template, found, strict=True) if not gone and not n.skipped]
    framed = any(n.framed for n, _ in left)
    return " ".join(text for n, text in left if n.framed or not framed), sum(template)


def region(reference: str, mass: dict[int, int], total: int, most: float = 0.85) -> tuple[int, int]:
    """(first, last) place of the deepest container in a written tree that holds ``most`` of the total mass."""
    at, place = read_shape(reference), 0
    sums = [0]
    for i in range(at.size):
        sums.append(sums[-1] + mass.get(i, 0))
    while True:
        child_place = place + 1
        for c in at.children:
            if c.children and sums[child_place + c.size] - sums[child_place] >= most * total > 0:
                at, place = c, child_place
                break
            child_place += c.size
        else:
            return place, place + at.size - 1


def outside_nodes(reference: str, stats: list[tuple], total: int) -> tuple[int, int, list[int]]:
    """The data region of a host and the nodes outside it that are template.

    ``stats``: (node, chars, times, again, lead, titled) of the reference's nodes over their varying, unlinked texts:
    characters, pages with a text, those whose text is on another page too, those that begin with the node's most
    common two words, those whose text is the page's title.
    """
    first, last = region(reference, {s[0]: s[1] for s in stats}, total)
    if first == 0:
        return first, last, []
    held = sum(s[1] for s in stats if first <= s[0] <= last)
    out = []
    for node, chars, times, again, lead, titled in stats:
        if first <= node <= last or 2 * titled > times:
            continue
        if 10 * again >= times or 10 * lead >= 8 * times or 20 * chars < held:
            out.append(node)
    return first, last, out


# --- Spark -----------------------------------------------------------------------------------------------------


def host_column() -> Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_column() -> Column:
    """The digest of a page, equal for its copies."""
    return F.xxhash64(F.coalesce("html", F.lit("")))


def induce(pages: DataFrame, scratch: Scratch, least: int = 5, share: float = 0.8, link_share: float = 0.6) -> DataFrame:
    """The wrapper of each host that has ``least`` distinct pages.

    host, reference, constant ("node\\thash" of texts), linked and outside (nodes), first and last (the data region).
    """
    pages = pages.select(host_column().alias("host"), page_column().alias("page"), "html")
    counted = map_texts(pages, ["html"], lambda hs: [[written(shape(parse(h))) for h in hs]], "tree string", ["host"]).groupBy("host", "tree").agg(F.count("*").alias("n"))
    references = counted.groupBy("host").agg(F.max(F.struct("n", "tree"))["tree"].alias("reference"))
    distinct = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("all"))
    references = scratch.save(references.join(distinct.where(F.col("all") >= least), "host"))

    def slots(pages: list, references: list) -> list[list]:
        rows: list[tuple] = []
        for row, (page, reference) in enumerate(zip(pages, references, strict=True)):
            root = parse(page)
            to = aligned(written(shape(root)), reference)
            rows += [(row, to[at], digest(text), digest(" ".join(text.split(" ", 2)[:2])), len(text), linked, int(text == root.title)) for at, _, text, linked in blocks(root)]
        return list(map(list, zip(*rows, strict=True))) if rows else [[]] * 7

    source = with_host(pages, references, "inner")
    seen = map_texts(source, ["html", "reference"], slots, "node long, text long, lead long, chars long, linked long, titled int", ["host", "page"])
    # Copies of a page, and a text twice in one page, count once.
    per_page = seen.groupBy("host", "node", "text", "page").agg(F.first("lead").alias("lead"), F.max("chars").alias("chars"), F.max("linked").alias("linked"), F.max("titled").alias("titled"))
    per_text = per_page.groupBy("host", "node", "text").agg(F.first("lead").alias("lead"), F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.sum("titled").alias("titled"))
    per_text = scratch.save(per_text)

    all_pages = references.select("host", "all")
    by_node = per_text.groupBy("host", "node").agg(F.sum("pages").alias("times"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    linked = scratch.save(by_node.where((F.col("linked") > link_share * F.col("chars")) & (F.col("times") >= least)).join(all_pages, "host").where(F.col("times") >= 0.01 * F.col("all")).select("host", "node"))
    judged = scratch.save(per_text.where(F.col("pages") >= least).join(all_pages, "host").where(F.col("pages") >= share * F.col("all")).select("host", "node", "text"))
    varying = per_text.join(judged, ["host", "node", "text"], "left_anti").join(linked, ["host", "node"], "left_anti")
    by_lead = varying.groupBy("host", "node", "lead").agg(
        F.sum("pages").alias("times"), F.sum(F.when(F.col("pages") > 1, F.col("pages")).otherwise(0)).alias("again"), F.sum(F.col("chars") - F.col("linked")).alias("chars"), F.sum("titled").alias("titled")
    )
    stats = by_lead.groupBy("host", "node").agg(F.sum("chars").alias("chars"), F.sum("times").alias("times"), F.sum("again").alias("again"), F.max("times").alias("lead"), F.sum("titled").alias("titled"))
    # Nodes of the reference are as many as a page has; what others hold only counts in the total.
    total = F.sum("chars").alias("total")
    stats = stats.groupBy("host").agg(total, F.array_sort(F.collect_list(F.when(F.col("node") >= 0, F.struct("node", "chars", "times", "again", "lead", "titled")))).alias("stats"))

    def decide(references: list, stats: list, totals: list) -> list[list]:
        out = [outside_nodes(r, [tuple(x.values()) for x in s or []], t or 0) for r, s, t in zip(references, stats, totals, strict=True)]
        return list(map(list, zip(*out, strict=True))) if out else [[]] * 3

    constant = judged.groupBy("host").agg(F.array_sort(F.collect_set(F.concat_ws("\t", F.col("node").cast("string"), F.col("text").cast("string")))).alias("constant"))
    links = linked.groupBy("host").agg(F.array_sort(F.collect_set("node")).alias("linked"))
    wrappers = references.join(constant, "host", "left").join(links, "host", "left").join(stats, "host", "left")
    return scratch.save(map_texts(wrappers, ["reference", "stats", "total"], decide, "first long, last long, outside array<bigint>", ["host", "reference", "constant", "linked"]))


def with_host(pages: DataFrame, by_host: DataFrame, how: str, most_rows: int = 20_000, most_bytes: int = 32 << 20) -> DataFrame:
    """``pages`` (host) with the columns of ``by_host``, which has been saved: broadcast while its rows and bytes, both
    counted, are few, shuffled beyond."""
    size = sum((F.coalesce(F.octet_length(f.name) if f.dataType.typeName() == "string" else 32 * F.size(f.name), F.lit(0)) for f in by_host.schema if f.dataType.typeName() in ("string", "array")), F.lit(0))
    rows, width = by_host.agg(F.count("*"), F.sum(size.cast("long"))).first()
    return pages.join(F.broadcast(by_host) if rows < most_rows and (width or 0) < most_bytes else by_host, "host", how)


def extract(pages: DataFrame, least: int = 5, share: float = 0.8) -> DataFrame:
    """page_id, url, text, n_chars of every page, and n_template, the number of blocks that the wrapper took out."""
    wrappers = induce(pages, Scratch(pages.sparkSession), least, share)

    def run(pages: list, references: list, *parts: list) -> list[list]:
        out = [main_text(h, None if r is None else wrapper(r, *(tuple(x) if isinstance(x, list) else x for x in p))) for h, r, *p in zip(pages, references, *parts, strict=True)]
        return [[t for t, _ in out], [len(t) for t, _ in out], [n for _, n in out]]

    source = with_host(pages.select("page_id", "url", "html", host_column().alias("host")), wrappers, "left")
    return map_texts(source, ["html", "reference", "constant", "linked", "outside", "first", "last"], run, "text string, n_chars long, n_template long", ["page_id", "url"])


@lru_cache(500)
def wrapper(reference: str, constant: tuple | None, linked: tuple | None, outside: tuple | None, first: int, last: int) -> Wrapper:
    texts = frozenset((int(n), int(h)) for n, _, h in (c.rpartition("\t") for c in constant or ()))
    return Wrapper(reference, texts, frozenset(linked or ()), frozenset(outside or ()), first, last)


def op10(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
