"""Main text of web pages by wrapper induction.

Pages of one host are parsed into trees of blocks and aligned by simple tree matching with a
template that grows as pages are aligned. A template node (slot) whose text stays the same from
page to page belongs to the host's template; slots whose text varies hold content. Slots that by
their element, or by a class, id or role that names nothing else, are menus, headers, footers,
sidebars, notices, adverts, forms or reader comments are never content, whatever varies in them. A
name that also holds other words (``related-work``, ``job-search``) is weak evidence: the slot
goes where links make up half of its text over all pages. Of the rest, the subtree that holds most of
the varying text (an article or main element where there is one) is the main text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

GROUP = 64  # pages of a host that are aligned together, at most
PART, MOST_LARGE = 4, 100_000  # such groups in a part of a large host; large hosts up to which their list is broadcast
CONSTANT_PAGES, CONSTANT_SHARE, COPY_SHARE = 5, 0.6, 0.5
TABLE = 40_000  # cells of a matching of two lists of children

#: Elements of HTML by their part in the tree. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noframes noembed xmp svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img nobr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements, and words of class, id or role, that are not main text. Fixed values.
OUTSIDE = frozenset("head nav footer aside form script style title textarea noscript template iframe noframes noembed xmp svg math button select option input dialog object canvas audio video menu".split())
OUTSIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments disqus respond cookie cookies consent gdpr notice notices alert banner newsletter subscribe subscription signup login share sharing social related recommended popup modal masthead topbar toolbar pagination pager widget search complementary contentinfo".split())
#: Last words of compound names (``comment-list``, ``cookie-box``) that say no more than that it is a part of a page, and words of names for a layout. Fixed values.
PARTS = frozenset("area bar block body box bottom button buttons col column container content form group header icon icons inner item items left link links list message outer overlay pane panel post posts right row section slot stories title top unit widgets wrap wrapper".split())
LAYOUT = frozenset("has no with without hide full".split())
#: Words of compound names that say whose or where a part is, and outside words that are also what an article may be about. Fixed values.
PLACES = frozenset("article blog desktop global js left main mobile page post primary reader readers right secondary site sticky sub the user users wp your".split())
TOPICS = frozenset("alert related respond search share social".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
LINKED = 0.5

TAG = re.compile(r"""(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
PLAIN_TAG = re.compile(r"(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
COMMENT_END = re.compile("--!?>")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def named_outside(value: str, within_main: bool = False) -> bool | None:
    """Whether a class, id or role names a part that is not main text; None where a word in it only hints at that.

    A name tells where all of its words do: those of outside parts, of parts as such, of places and
    numbers. With any other word (``job-search``, ``fire-alert``) it hints, and so does one that may
    as well be a topic (``search``) within an article.
    """
    hint = False
    for name in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        outside = OUTSIDE_WORDS.intersection(words)
        if not outside or not LAYOUT.isdisjoint(words):
            continue
        plain = all(w in OUTSIDE_WORDS or w in PARTS or w in PLACES or w.isdigit() for w in words)
        if plain and not (within_main and outside <= TOPICS):
            return True
        hint = True
    return None if hint else False


class Node:
    """An element: ``label`` is its tag and class words; ``items`` its texts and elements in order."""

    __slots__ = ("tag", "label", "items", "outside", "hinted")

    def __init__(self, tag: str, attributes: str, within_main: bool):
        self.tag, self.items, self.hinted = tag, [], False
        words, named = (), False
        if attributes and "=" in attributes:
            values = [v.strip("\"'").lower() for _, v in ATTRIBUTE.findall(attributes)]
            words = tuple(sorted({w for v in values for w in re.split(r"[^a-z0-9]+", v) if w}))
            if words and tag not in ("html", "body", *MAIN) and not OUTSIDE_WORDS.isdisjoint(words):
                told = [named_outside(v, within_main) for v in values]
                named, self.hinted = True in told, None in told
        self.label = (tag, words)
        self.outside = tag in OUTSIDE or (tag == "header" and not within_main) or named


class Open:
    """The open elements of a page; where each tag was opened last is known, so no search walks down the stack."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks, self.main = [root], {}, [0], 0

    def last(self, tags) -> int:
        """The place of the innermost open element of some tags, or 0."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def push(self, node: Node) -> None:
        k = len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.tag, []).append(k)
        if node.tag not in INLINE:
            self.blocks.append(k)
        self.main += node.tag in MAIN

    def close(self, k: int) -> None:
        """Close the element at place ``k`` and all within it."""
        for node in reversed(self.stack[k:]):
            self.at[node.tag].pop()
            self.main -= node.tag in MAIN
        while self.blocks[-1] >= k:
            self.blocks.pop()
        del self.stack[k:]


def tokens(page: str) -> Iterator[tuple[str, str | None, str, str, int]]:
    """(text before, "/" or "", tag, attributes, end) of each tag, the last with tag None; send() a place to go on from.

    Linear: what no ``>`` follows is text, and after a tag whose quotes never close quotes count no more.
    """
    at, begin, last, quotes = 0, 0, page.rfind(">"), True
    while True:
        at = page.find("<", at)
        if at < 0 or at > last:
            # A comment or declaration that never ends hides the rest.
            hidden = at >= 0 and page.startswith(("<!", "<?"), at)
            yield page[begin : at if hidden else len(page)], "", None, "", len(page)
            return
        if page.startswith("<!--", at):
            m = COMMENT_END.search(page, at + 4)
            skip = m.end() if m else len(page)
        elif page.startswith(("<!", "<?"), at):
            skip = page.find(">", at) + 1 or len(page)
        else:
            m = TAG.match(page, at + 1) if quotes else None
            if not m and (m := PLAIN_TAG.match(page, at + 1)):
                quotes = False
            if not m:
                at += 1
                continue
            text, end = page[begin:at], m.end()
            at = begin = (yield text, m[1], m[2].lower(), m[3], end) or end
            continue
        if page[begin:at]:
            yield page[begin:at], "", "", "", skip
        at = begin = skip


def parse(page: str) -> Node:
    """The tree of a page, with the end tags that HTML lets authors leave out."""
    root = Node("#root", "", False)
    opened, found, go_on = Open(root), tokens(page), None
    while True:
        try:
            text, end, tag, attributes, at = found.send(go_on)
        except StopIteration:
            return root
        go_on = None
        if text:
            opened.stack[-1].items.append(" " if text.isspace() else html.unescape(text) if "&" in text else text)
        if not tag:
            continue
        if end:
            k = opened.last((tag,))
            # A stray end tag of an inline element closes no block.
            if k and not (tag in INLINE and opened.blocks[-1] > k):
                opened.close(k)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                stop = RAW_END[tag].search(page, at)
                go_on = stop.end() if stop else len(page)
            continue
        close, fence = SIBLINGS.get(tag, ((), ()))
        while close and (k := opened.last(close)) > opened.last(fence):
            opened.close(k)
            if tag != "tr":
                break
        if tag in CLOSES_P and opened.stack[opened.blocks[-1]].tag == "p":
            opened.close(opened.blocks[-1])
        node = Node(tag, attributes, opened.main > 0)
        opened.stack[-1].items.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            opened.push(node)


class Tree:
    """The block elements of a page; equal neighbours in structure are one repeated child."""

    __slots__ = ("label", "children", "outside", "hinted")

    def __init__(self, label: tuple, outside: bool, hinted: bool):
        self.label, self.outside, self.hinted, self.children = label, outside, hinted, []


def block_tree(root: Node) -> tuple[Tree, list[tuple[Tree, str, int]]]:
    """The tree of block elements, and all texts in page order with the block element that holds each and how much of it is linked."""
    top, order = Tree(root.label, root.outside, False), []
    pieces: list[str] = []
    linked = 0

    def flush(tree: Tree) -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            order.append((tree, text, min(linked, len(text))))
        linked = 0

    # (node, its tree, whether the tree is the node's own, items still to come, whether outside, whether in a link)
    stack = [(root, top, True, iter(root.items), root.outside, False)]
    while stack:
        node, tree, own, items, outside, link = stack[-1]
        for item in items:
            if isinstance(item, str):
                pieces.append(item)
                linked += len(item) if link else 0
            elif item.tag in INLINE and not item.outside:
                if item.tag in ("br", "img"):
                    pieces.append(" ")
                stack.append((item, tree, False, iter(item.items), outside, link or item.tag == "a"))
                break
            else:
                flush(tree)
                child = Tree(item.label, outside or item.outside, item.hinted)
                tree.children.append(child)
                stack.append((item, child, True, iter(item.items), child.outside, link))
                break
        else:
            stack.pop()
            if own:
                flush(tree)
    return top, order


class Slot:
    """A node of a host's template: how many pages have it and which texts they had there."""

    __slots__ = ("label", "children", "outside", "hinted", "values", "mass", "linked", "pages")

    def __init__(self, tree: Tree):
        self.label, self.outside, self.hinted, self.children = tree.label, tree.outside, tree.hinted, []
        self.values, self.mass, self.linked, self.pages = Counter(), 0, 0, 0


def collapsed(trees: list[Tree]) -> list[tuple[Tree, list[Tree]]]:
    """Children in order, neighbours of one label as one entry with all its members."""
    out: list[tuple[Tree, list[Tree]]] = []
    for t in trees:
        if out and out[-1][0].label == t.label:
            out[-1][1].append(t)
        else:
            out.append((t, [t]))
    return out


def matching(slots: list[Slot], trees: list[tuple[Tree, list[Tree]]], depth: int = 3) -> list[tuple[int, int]]:
    """Pairs (slot, tree) of the best order-preserving match of two lists of children, by simple tree matching.

    Equal labels at both ends are matched as they stand. What is left in between is matched by
    dynamic programming; where that would take more than ``TABLE`` cells, by the next equal label in order.
    """
    n, m = len(slots), len(trees)
    head = 0
    while head < min(n, m) and slots[head].label == trees[head][0].label:
        head += 1
    tail = 0
    while tail < min(n, m) - head and slots[n - 1 - tail].label == trees[m - 1 - tail][0].label:
        tail += 1
    pairs = [(k, k) for k in range(head)]
    ends = [(n - k, m - k) for k in range(tail, 0, -1)]
    n, m = n - head - tail, m - head - tail
    if not n or not m:
        return pairs + ends
    if n * m > TABLE:
        at = {}
        for i in range(head, head + n):
            at.setdefault(slots[i].label, []).append(i)
        least = head
        for j in range(head, head + m):
            places = at.get(trees[j][0].label, [])
            k = bisect_left(places, least)
            if k < len(places):
                pairs.append((places[k], j))
                least = places[k] + 1
        return pairs + ends
    weight = [[size_matched(s, t, depth) for t, _ in trees[head : head + m]] for s in slots[head : head + n]]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            w = weight[i][j]
            best[i][j] = max(best[i + 1][j], best[i][j + 1], w + best[i + 1][j + 1] if w else 0)
    i = j = 0
    while i < n and j < m:
        if weight[i][j] and best[i][j] == weight[i][j] + best[i + 1][j + 1]:
            pairs.append((head + i, head + j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return pairs + ends


def size_matched(slot: Slot, tree: Tree, depth: int) -> int:
    """How many nodes of two trees match, roots first, down to ``depth`` levels."""
    if slot.label != tree.label:
        return 0
    if not depth:
        return 1
    children = collapsed(tree.children)
    return 1 + sum(size_matched(slot.children[a], children[b][0], depth - 1) for a, b in matching(slot.children, children, depth - 1))


class Wrapper:
    """A template induced from pages of one host."""

    def __init__(self):
        self.root: Slot | None = None

    def align(self, top: Tree) -> dict[int, Slot]:
        """The slot of every block element of a page (by id); the template takes in what it lacks."""
        self.root = self.root or Slot(top)
        of, todo = {}, [(self.root, [top])]
        while todo:
            slot, members = todo.pop()
            slot.pages += 1
            for tree in members:
                of[id(tree)] = slot
            children = collapsed([c for t in members for c in t.children])
            pairs = dict((b, a) for a, b in matching(slot.children, children))
            before, after, at = slot.children, [], 0
            for k, (tree, group) in enumerate(children):
                if k in pairs:
                    after += before[at : pairs[k] + 1]
                    at = pairs[k] + 1
                else:
                    after.append(Slot(tree))
                todo.append((after[-1], group))
            slot.children = after + before[at:]
        return of

    def judge_hints(self) -> None:
        """Slots whose name only hints at it are outside where links make up half of their text, or where they hold none."""
        stack, order = [self.root], []
        while stack:
            s = stack.pop()
            order.append(s)
            stack += s.children
        totals: dict[int, tuple[int, int]] = {}
        for s in reversed(order):
            inner = [totals[id(c)] for c in s.children]
            totals[id(s)] = s.mass + sum(t[0] for t in inner), s.linked + sum(t[1] for t in inner)
            if s.hinted and totals[id(s)][1] >= LINKED * totals[id(s)][0]:
                s.outside = True

    def main_slot(self) -> Slot:
        """The slot that holds the main text: down from the root while one child holds most varying text."""
        varying: dict[int, int] = {}
        stack, order = [self.root], []
        while stack:
            s = stack.pop()
            order.append(s)
            stack += s.children
        explicit = None
        for s in reversed(order):
            own = 0 if s.outside else s.mass if len(s.values) > 1 or s.pages < CONSTANT_PAGES else 0
            varying[id(s)] = own + (0 if s.outside else sum(varying[id(c)] for c in s.children))
            if s.label[0] in MAIN and not s.outside and (explicit is None or varying[id(s)] >= varying[id(explicit)]):
                explicit = s
        if explicit is not None and varying[id(explicit)]:
            return explicit
        at = self.root
        while True:
            total = varying[id(at)]
            inner = [c for c in at.children if c.children and not c.outside and total and varying[id(c)] >= 0.6 * total]
            if not inner:
                return at
            at = inner[0]


def under_main(main: Slot) -> Iterator[Slot]:
    stack = [main]
    while stack:
        s = stack.pop()
        if not s.outside:
            yield s
            stack += s.children


def main_texts(pages: list[str | None]) -> list[str]:
    """The main text of each of some pages of one host, blocks joined by an empty line."""
    parsed, wrapper = [], Wrapper()
    for page in pages:
        if page is None or not page.strip():
            parsed.append(None)
            continue
        top, order = block_tree(parse(page))
        of = wrapper.align(top)
        for tree, text, linked in order:
            slot = of[id(tree)]
            slot.mass += len(text)
            slot.linked += linked
            if len(slot.values) < 4096:
                slot.values[hash(text)] += 1
        parsed.append((top, order, of))
    if wrapper.root is None:
        return [""] * len(pages)
    wrapper.judge_hints()
    main = wrapper.main_slot()
    under = {id(s) for s in under_main(main)}
    kept: list[list[tuple[int, str]] | None] = [
        None if p is None else [(id(p[2][id(t)]), text) for t, text, _ in p[1] if id(p[2][id(t)]) in under and not t.outside] for p in parsed
    ]
    # Blocks that most of the host's different pages repeat in one slot are template; copies of pages are no evidence.
    distinct = list({tuple(b): b for b in kept if b}.values())
    seen = Counter(x for b in distinct for x in set(b))
    enough = lambda n: n >= CONSTANT_PAGES and n >= CONSTANT_SHARE * len(distinct)
    # A heading within an article may recur (``Abstract``) and is its own all the same.
    headings = {id(s) for s in under_main(main) if s.label[0] in HEADINGS} if main.label[0] in MAIN else set()
    fixed = {x for x, n in seen.items() if enough(n) and x[0] not in headings}
    if fixed:
        witnesses = [b for b in distinct if sum(len(t) for s, t in b if (s, t) in fixed) <= COPY_SHARE * sum(len(t) for _, t in b)]
        again = Counter(x for b in witnesses for x in set(b) & fixed)
        fixed = {x for x in fixed if enough(again[x])}
    return ["" if b is None else "\n\n".join(t for s, t in b if (s, t) not in fixed) for b in kept]


def runs(batches: Iterator[pa.RecordBatch], group: int) -> Iterator[pa.Table]:
    """Rows (sorted by host and part) in runs of one host and part, whatever batches they come in.

    A run has ``group`` rows; the last two share what is left of a part, so that none is short
    but that of a part with no more.
    """
    held, of = None, None

    def rest() -> Iterator[pa.Table]:
        if held is not None and held.num_rows > group:
            half = (held.num_rows + 1) // 2
            yield held.slice(0, half)
            yield held.slice(half)
        elif held is not None and held.num_rows:
            yield held

    for batch in batches:
        keys, a = list(zip(batch.column("host").to_pylist(), batch.column("part").to_pylist(), strict=True)), 0
        while a < len(keys):
            b = a + 1
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            piece = pa.Table.from_batches([batch.slice(a, b - a)])
            if keys[a] != of:
                yield from rest()
                held, of = piece, keys[a]
            else:
                held = pa.concat_tables([held, piece])
            while held.num_rows >= 2 * group:
                yield held.slice(0, group)
                held = held.slice(group)
            a = b
    yield from rest()


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Pages of a host with more than ``PART`` runs of ``group`` are dealt by a hash of the row into
    parts of about that size (as no part of so many pages is left with a few), other hosts are one
    part. A part is in one task, in an order of its own, and up to ``group`` neighbours of it are
    aligned together, so texts do not depend on partitions or batches. Null or empty html gives an
    empty text and takes no place in a run; a null url counts as a host of its own.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), HOST, 1))
    blank = ~F.coalesce(F.col("html").rlike(r"\S"), F.lit(False))
    most = PART * group
    large = pages.where(~blank).groupBy(host.alias("host")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    large = written(large, "hosts")
    large = F.broadcast(large) if large.limit(MOST_LARGE + 1).count() <= MOST_LARGE else large
    rows = pages.select("page_id", "url", "html", host.alias("host"), blank.alias("blank"), F.xxhash64("page_id", "url", "html").alias("salt")).join(large, "host", "left")
    part = F.when(F.col("blank"), -1 - F.pmod("salt", F.lit(1024))).otherwise(F.pmod("salt", F.coalesce(F.ceil(F.col("n") / most), F.lit(1)).cast("long")))
    rows = rows.select("page_id", "url", "html", "host", part.alias("part"), "salt")
    rows = rows.repartition("host", "part").sortWithinPartitions("host", "part", "salt", "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, group):
            texts = main_texts(rows.column("html").to_pylist())
            ids, urls = rows.column("page_id").cast(pa.int64()).combine_chunks(), rows.column("url").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_wrapper_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of ``pages``; see :func:`extract`."""
    return extract(table(spark, sf_dir, "pages"))
