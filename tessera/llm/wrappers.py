"""HTML extraction by wrapper induction.

Pages of a host are DOM trees; simple tree matching (Yang, 1991) aligns them into the host's
template, a tree in which repeated siblings are one node. Each template node remembers the text most
of its pages held: constant nodes are template, varying slots are content. Templates are mergeable,
so every page takes part: the shapes of pages (elements and text hashes) are folded in groups of
``GROUP`` in the order of their content, then groups of partial templates, until a host has one; so
the result doesn't depend on partitions. Pages of one text count once, and a branch that few of a
group's pages have is left out, so that a template stays as small as the host's markup.

To extract, a page is aligned with its host's template; a block goes where its slot is constant and
holds that very text on this page. Any other text stays unless its place is marked as navigation,
header, footer, sidebar, notice, advert, form, script, style or reader comments (varying menus and
varying content can't be told apart by variation), and is read inside the article or main element
where the page has one, else on the whole page.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tessera.session import cut, cut_table

SALTS = 64  #: parts of a host's pages that may be read apart
GROUP = 512  #: shapes or templates that are folded into one at a time
LEAST_SHARE = 0.004  #: share of a group's pages below which a branch is left out of its template
BROADCAST_CHARS = 16 << 20  #: templates of at most so many characters in all are sent to every executor
CONSTANT_SHARE, UNSEEN = 0.7, 2  #: a text is constant at this share of a slot's pages, with so many unseen ones counted against it
DEPTH = 160  #: elements below this depth stand beside each other, as in browsers

#: fixed values: element classes of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea title".split())
UNSEEN_INLINE = RAW | {"button", "select", "canvas", "object"}  #: left out without ending the block that they stand in
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
NOISE_TAGS = frozenset("nav header footer aside form script style noscript template svg iframe textarea title head button select menu dialog object canvas".split())
NOISE_MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo sponsor sponsored cookie cookies consent gdpr notice notices alert comment comments disqus respond"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended footer header masthead newsletter subscribe subscription popup modal overlay"
    " skip pagination pager widget login signup search toolbar copyright disclaimer".split()
)
#: words that may stand beside a mark in one class name; any other word makes it a name of its own
PLACE_WORDS = frozenset(
    "a all area article bar block body bottom bottombar box btn button buttons center col column container content div entry field fixed global group holder home icon icons inner item items"
    " js layout left level link links list main mobile module outer page panel post posts primary reply replies right row secondary section site slot small span sub tertiary text thread top"
    " topbar ui unit user view wrap wrapper wrapping zone".split()
)
COMMENT_MARKS = frozenset("comment comments disqus respond".split())
HEADER_MARKS = frozenset("header masthead".split())
OWN_WORDS = frozenset("article entry post content main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

#: attribute values are quoted only after an equals sign
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+)?+|[^>=])*+)>",
    re.S,
)
_ATTR = re.compile(r"(?:\s|^|[\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME_PART = re.compile(r"[a-z]+")


class Node:
    """An element: its tag, whether a mark makes it noise, whether that is only a header mark, children in page order."""

    __slots__ = ("tag", "noise", "header", "kids")

    def __init__(self, tag: str, noise: bool, header: bool = False):
        self.tag, self.noise, self.header, self.kids = tag, noise, header, []


def _marks(attrs: str) -> tuple[set[str], bool]:
    """Marks in the class names and ids, and whether the role is one of noise.

    A name counts when all its words are marks or words of place: ``ad-slot``, ``comment-list``, not ``social-science``.
    """
    found: set[str] = set()
    role = False
    for name, a, b, c in _ATTR.findall(attrs):
        value = (a or b or c).lower()
        if name.lower() == "role":
            role = role or value.strip() in NOISE_ROLES
            continue
        for token in value.split():
            parts = set(_NAME_PART.findall(token))
            marks = parts & NOISE_MARKS
            if marks and parts - marks <= PLACE_WORDS and not (marks <= HEADER_MARKS and parts & OWN_WORDS):
                found |= marks
    return found, role


def element(tag: str, attrs: str) -> Node:
    if tag == "header":
        return Node(tag, True, True)
    if tag in NOISE_TAGS:
        return Node(tag, True)
    if not attrs or tag in ("html", "body"):
        return Node(tag, False)
    marks, role = _marks(attrs)
    if tag in ("article", "main"):
        return Node(tag, bool(marks & COMMENT_MARKS))
    return Node(tag, bool(marks) or role, bool(marks) and not role and marks <= HEADER_MARKS)


def _has_heading(node: Node) -> bool:
    return any(isinstance(k, Node) and (k.tag in HEADINGS or _has_heading(k)) for k in node.kids)


def _keep_titles(node: Node, inside: bool) -> None:
    """Headers of an article are no noise where they hold a heading: they are its title."""
    for kid in node.kids:
        if isinstance(kid, Node):
            if inside and kid.header and kid.noise and _has_heading(kid):
                kid.noise = False
            _keep_titles(kid, inside or (kid.tag in ("article", "main") and not kid.noise))


def parse(source: str) -> Node:
    """A forgiving DOM: unclosed elements end with their parents, block elements close open paragraphs.

    Below ``DEPTH`` elements are not nested any further; their text stays in order, and out where noise holds it.
    """
    root = Node("#root", False)
    stack = [root]
    into = [root]  # where the children of each open element go
    opened: dict[str, int] = {}
    at, size = 0, len(source)

    def close_from(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.tag] -= 1
        if any(place is not node and node.tag not in INLINE for node, place in zip(stack[depth:], into[depth:], strict=True)):
            into[depth].kids.append(Node("hr", False))  # a flattened block ends here
        del stack[depth:], into[depth:]

    while at < size:
        m = _TAG.search(source, at)
        if m is None:
            into[-1].kids.append(source[at:])
            break
        if m.start() > at:
            into[-1].kids.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close_from(depth)
                        break
            continue
        if tag in CLOSES_P:
            if opened.get("p"):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == "p":
                        close_from(depth)
                        break
                    if stack[depth].tag not in INLINE:
                        break
        elif tag in SAME_CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in SAME_CLOSES[tag]:
                    close_from(depth)
                    break
                if stack[depth].tag in SCOPES[tag]:
                    break
        node = element(tag, m[3])
        place = into[-1]
        place.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = end.end() if end else size
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
            deep = len(stack) > DEPTH
            into.append(place if deep and (place.noise or not node.noise) else node)
    _keep_titles(root, False)
    return root


# --- templates: nested lists [tag, noise, pages, text hash, pages that held it, text chars, kids] ---------------

TAG, MUTED, PAGES, HASH, SAME, CHARS, KIDS = range(7)


def _own_text(node: Node) -> str:
    """Text of a node and its inline children, in one string."""
    parts: list[str] = []
    for kid in node.kids:
        if isinstance(kid, str):
            parts.append(kid)
        elif kid.tag in INLINE:
            parts.append(_own_text(kid))
    return "".join(parts)


def shape(node: Node, slots: dict[int, list] | None = None, into: dict[int, tuple[list, list]] | None = None) -> list:
    """A page's tree as a one-page template: block elements only, repeated siblings folded.

    ``slots`` gets the slot of each element by id, ``into`` the slots that were folded and where they went.
    """
    text = " ".join(_own_text(node).split())
    kids: list[list] = []
    for kid in _blocks(node):
        _fold(kids, shape(kid, slots, into), into)
    slot = [node.tag, node.noise, 1, xxhash.xxh3_64_intdigest(text) >> 1 if text else 0, 1, len(text), kids]
    if slots is not None:
        slots[id(node)] = slot
    return slot


def _blocks(node: Node) -> Iterator[Node]:
    for kid in node.kids:
        if isinstance(kid, Node):
            if kid.tag in INLINE:
                yield from _blocks(kid)
            elif kid.tag not in VOID:
                yield kid


def _fold(kids: list[list], new: list, into: dict[int, tuple[list, list]] | None = None) -> None:
    """Append a sibling; a sibling of the last one's name becomes part of it."""
    if kids and kids[-1][TAG] == new[TAG] and kids[-1][MUTED] == new[MUTED]:
        last = kids[-1]
        last[HASH] = (last[HASH] * 31 + new[HASH]) & 0x7FFFFFFFFFFFFFFF
        last[CHARS] += new[CHARS]
        if into is not None:
            into[id(new)] = (last, new)  # new stays alive, so that its id does
        for kid in new[KIDS]:
            _fold(last[KIDS], kid, into)
    else:
        kids.append(new)


def tree_match(a: list, b: list, memo: dict) -> int:
    """Size of the largest order-preserving match of two trees with equal roots (simple tree matching)."""
    if a[TAG] != b[TAG] or a[MUTED] != b[MUTED]:
        return 0
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = (1 + _grid(a[KIDS], b[KIDS], memo)[-1][-1], a, b)
    return memo[key][0]


def _grid(xs: list, ys: list, memo: dict) -> list[list[int]]:
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        row, above = [0], rows[-1]
        for j, y in enumerate(ys):
            row.append(max(above[j + 1], row[j], above[j] + tree_match(x, y, memo)))
        rows.append(row)
    return rows


def aligned(xs: list, ys: list, memo: dict) -> list[tuple[int | None, int | None]]:
    """Pairs of matching siblings, in order; unmatched ones of either side stand alone."""
    if len(xs) == len(ys) and all(x[TAG] == y[TAG] and x[MUTED] == y[MUTED] for x, y in zip(xs, ys, strict=True)):
        return [(i, i) for i in range(len(xs))]
    grid = _grid(xs, ys, memo)
    i, j, out = len(xs), len(ys), []
    while i and j:
        gain = tree_match(xs[i - 1], ys[j - 1], memo)
        if gain and grid[i][j] == grid[i - 1][j - 1] + gain:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif grid[i][j] == grid[i - 1][j]:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    out += [(k, None) for k in range(i - 1, -1, -1)] + [(None, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def merge(a: list, b: list, memo: dict | None = None) -> list:
    """Template of the pages of both."""
    memo = {} if memo is None else memo
    kids = [(a[KIDS][i] if j is None else b[KIDS][j] if i is None else merge(a[KIDS][i], b[KIDS][j], memo)) for i, j in aligned(a[KIDS], b[KIDS], memo)]
    keep, other = (a, b) if (a[SAME], a[HASH]) >= (b[SAME], b[HASH]) else (b, a)
    same = keep[SAME] + (other[SAME] if keep[HASH] == other[HASH] else 0)
    return [a[TAG], a[MUTED], a[PAGES] + b[PAGES], keep[HASH], same, a[CHARS] + b[CHARS], kids]


def _constant(t: list) -> bool:
    return t[SAME] >= CONSTANT_SHARE * (t[PAGES] + UNSEEN)


def pruned(t: list, least: float) -> list:
    """The template without branches that fewer than ``least`` pages have."""
    t[KIDS] = [pruned(k, least) for k in t[KIDS] if k[PAGES] >= least]
    return t


def _boilerplate(page: Node, template: list | None) -> set[int]:
    """Ids of the elements whose slot holds, on this page, the constant text of its template node."""
    if template is None:
        return set()
    slots: dict[int, list] = {}
    into: dict[int, tuple[list, list]] = {}
    same: set[int] = set()
    memo: dict = {}

    def compare(slot: list, t: list) -> None:
        if slot[CHARS] and slot[HASH] == t[HASH] and _constant(t):
            same.add(id(slot))
        for i, j in aligned(slot[KIDS], t[KIDS], memo):
            if i is not None and j is not None:
                compare(slot[KIDS][i], t[KIDS][j])

    compare(shape(page, slots, into), template)
    found: set[int] = set()
    for element, slot in slots.items():
        while id(slot) in into:
            slot = into[id(slot)][0]
        if id(slot) in same:
            found.add(element)
    return found


def extract(page: Node, template: list | None) -> str:
    """Main text of a page under its host's template."""
    found: list[tuple[tuple[Node, ...], str]] = []  # (ancestors, block text)
    flat: list[str] = []
    boilerplate = _boilerplate(page, template)

    def close(path: tuple[Node, ...]) -> None:
        text = " ".join(entities.unescape("".join(flat)).split())
        flat.clear()
        if text:
            found.append((path, text))

    def walk(node: Node, path: tuple[Node, ...], drop: bool) -> None:
        """Text runs of a block and its inline children; blocks inside end the run."""
        for kid in node.kids:
            if isinstance(kid, str):
                if not drop:
                    flat.append(kid)
            elif kid.tag == "br":
                flat.append(" ")
            elif kid.tag in INLINE:
                if not kid.noise:
                    walk(kid, path, drop)
            elif kid.tag in VOID:
                close(path)
            elif kid.noise:
                if kid.tag not in UNSEEN_INLINE:
                    close(path)
            else:
                close(path)
                inside = (*path, kid)
                walk(kid, inside, id(kid) in boilerplate)
                close(inside)

    walk(page, (), False)
    close(())
    if not found:
        return ""
    marked = [t for p, t in found if any(n.tag in ("article", "main") for n in p)]
    return " ".join(marked or [t for _, t in found])


# --- Spark ----------------------------------------------------------------------------------------------------


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One-page templates, and a hash of all text of the page."""
    for batch in batches:
        rows = []
        for host, page in zip(batch["host"], batch["html"], strict=True):
            if page:
                tree = parse(page)
                text = " ".join(_all_text(tree).split())
                rows.append((host, xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63), json.dumps(shape(tree), separators=(",", ":"))))
        yield pd.DataFrame(rows, columns=["host", "content", "shape"])


def _all_text(node: Node) -> str:
    return "".join(k if isinstance(k, str) else f" {_all_text(k)} " for k in node.kids)


def _merge_group(host: str, shapes: pd.Series) -> pd.DataFrame:
    found = None
    for s in shapes.sort_values():
        found = json.loads(s) if found is None else merge(found, json.loads(s))
    if len(shapes) > 1:
        found = pruned(found, LEAST_SHARE * found[PAGES])
    return pd.DataFrame({"host": [host], "shape": [json.dumps(found, separators=(",", ":"))], "content": [xxhash.xxh3_64_intdigest(json.dumps(found)) - (1 << 63)]})


def host_templates(shapes: DataFrame, group: int = GROUP) -> DataFrame:
    """(host, template) from (host, content, shape) rows of every page."""
    now = shapes.groupBy("host", "content").agg(F.min("shape").alias("shape"))
    counts = cut(now.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
    most = counts.agg(F.max("n")).first()[0] or 0
    now = now.join(counts, "host")
    while True:
        # groups by content, of about `group` rows; a host of as many or fewer is one group
        salted = now.withColumn("salt", F.pmod(F.col("content"), F.ceil(F.col("n") / group).cast("long")))
        folded = salted.groupBy("host", "salt").applyInPandas(lambda k, g: _merge_group(k[0], g["shape"]).assign(n=-(-int(g["n"].iloc[0]) // group)), "host string, shape string, content long, n long")
        now = cut_table(folded)
        most = -(-most // group)
        if most <= 1:
            return now.select("host", F.col("shape").alias("template"))


def _texts(templates: dict[str, str] | None):
    """Extraction over (host, salt, template or null, page) rows; without ``templates`` a row with a template precedes its pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict = {}
        place, tree = None, None
        for batch in batches:
            rows = []
            for host, salt, template, page_id, url, page in zip(batch["host"], batch["salt"], batch["template"], batch["page_id"].astype("Int64"), batch["url"], batch["html"], strict=True):
                if templates is not None:
                    if host not in trees:
                        if len(trees) > 500:
                            trees.clear()
                        trees[host] = json.loads(templates[host]) if host in templates else None
                    tree = trees[host]
                elif (host, salt) != place:
                    place, tree = (host, salt), None
                if isinstance(template, str):
                    tree = json.loads(template)
                    continue
                rows.append((page_id, url, extract(parse(page), tree) if page else ""))
            out = pd.DataFrame(rows, columns=["page_id", "url", "text"])
            out["page_id"] = out["page_id"].astype("Int64")
            yield out

    return run


def extract_pages(pages: DataFrame, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null or empty html gives an empty text. A null or malformed url belongs to the host of empty
    name. Rows that repeat a page give a row each, and count once in the template. Markup of any
    depth is read. Other columns are not read. An empty table gives an empty result. Templates of up
    to ``broadcast_chars`` characters in all are sent to the pages; beyond that pages are shuffled to
    the template of their host, in up to ``SALTS`` parts a host, each with the template once.
    """
    held = pages.select(F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host"))
    held = held.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    shapes = cut_table(held.select("host", "html").mapInPandas(_shapes, "host string, content long, shape string"))
    templates = host_templates(shapes)
    rows = held.select("host", "salt", F.lit(None).cast("string").alias("template"), "page_id", "url", "html")
    size = templates.agg(F.sum(F.length("template") + F.length("host") + 50)).first()[0] or 0
    if size <= broadcast_chars:
        known = {r["host"]: r["template"] for r in templates.collect()}  # at most broadcast_chars
        found = rows.mapInPandas(_texts(known), "page_id long, url string, text string")
    else:
        parts = held.select("host", "salt").distinct()
        heads = parts.join(templates, "host").select("host", "salt", "template", *[F.lit(None).cast(t).alias(c) for c, t in (("page_id", "long"), ("url", "string"), ("html", "string"))])
        placed = rows.unionByName(heads).repartition("host", "salt").sortWithinPartitions("host", "salt", F.col("template").isNull())
        found = placed.mapInPandas(_texts(None), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
