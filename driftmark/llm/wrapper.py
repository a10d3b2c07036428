"""Main text of web pages by wrapper induction.

Every page is parsed once to text blocks and a skeleton, the tree of its structural elements with runs of equal
siblings as one node. The commonest skeleton of a host is its wrapper; every other skeleton of the host is aligned
with it by simple tree matching. A wrapper node whose text hardly changes over the host's different pages is
template, one whose text varies is a slot. The container that holds most of the host's varying text is followed down
the wrapper; containers beside it that hold hardly any of it (menus, adverts, footers whose words change from page to
page) are no content, paragraphs and headings beside it are. What elements and names say (nav, footer, "sidebar") is
weighed only after that; it decides alone where a host has too few pages to compare. Trees are aligned once per host
and skeleton, and texts are counted by map-side combined aggregation, so that a host with a third of all pages is no
different from others.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Scratch

#: Elements without an end tag, elements whose text is never shown or never content, elements that part blocks
#: and words in class, id and role that mark what is not the article (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style noscript template iframe object svg canvas audio video textarea select button title".split())
#: Elements that may stand in a head; any other one ends a head that has no end tag.
IN_HEAD = frozenset("head base basefont bgsound link meta script style template title noscript".split())
APART = frozenset("nav footer aside form dialog menu".split())
BLOCKS = frozenset(
    "html body main article section nav header footer aside form dialog menu div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption "
    "thead tbody tfoot tr blockquote pre figure figcaption address fieldset details summary hr center hgroup search".split()
)
ENDS_P = BLOCKS - {"html", "body", "caption", "thead", "tbody", "tfoot", "tr"}
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice "
    "notices alert sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist "
    "disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay "
    "widget widgets toolbar pagination pager skip search contentinfo complementary copyright".split()
)
#: Words that may stand beside those in a name that marks a container by itself (fixed values).
BESIDE = frozenset("box block area wrap wrapper container slot unit list inner outer left right top bottom site global primary secondary section group bar".split())
HIDDEN = 2
#: Elements that only hold text: beside the main container they stay (fixed values).
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre figure figcaption ul ol dl table caption".split())
_WORDS = re.compile(r"[a-z]+")


class PageParser(HTMLParser):
    """Collects blocks as (node, apart, in main, text, characters in links, marks); apart: in a menu, footer or the like.

    A mark is a number of a container about the block whose name speaks against it: above 0 where a whole name is
    made of such words, below 0 where a name only contains one. It drops nothing yet.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[int, str]] = [(0, "page")]  # depth and label in page order, before folding
        self.stack: list[tuple[str, int, int, bool, tuple[int, ...]]] = [("page", 0, 0, False, ())]  # tag, node, apart, main, marks
        self.marked = 0
        self.unseen = 0
        self.links = 0
        self.part: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[int, int, bool, str, int, tuple[int, ...]]] = []

    def flush(self) -> None:
        text = " ".join("".join(self.part).split())
        if text:
            _, node, apart, main, marks = self.stack[-1]
            self.blocks.append((node, apart, main, text, self.linked, marks))
        self.part, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.stack[-1][0] == "head" and tag not in IN_HEAD:
            self.handle_endtag("head")
        if self.unseen:
            if tag in UNSEEN and tag not in VOID:
                self.stack.append((tag, *self.stack[-1][1:]))
                self.unseen += 1
            return
        if tag in UNSEEN:
            self.part.append(" ")
            self.stack.append((tag, *self.stack[-1][1:]))
            self.unseen = 1
            return
        if tag not in BLOCKS:
            if tag in ("br", "td", "th", "img"):
                self.part.append(" ")
            elif tag == "a":
                self.links += 1
            return
        if tag in ENDS_P:
            self._close({"p"}, {"td", "th", "article", "section", "div", "li", "body", "main", "blockquote"})
        if tag in ("li", "dt", "dd", "tr"):
            self._close({"li"} if tag == "li" else {"tr"} if tag == "tr" else {"dt", "dd"}, {"ul", "ol", "dl", "table", "menu", "div", "article"})
        self.flush()
        self.links = 0
        _, node, before, main, marks = self.stack[-1]
        got = {k: v or "" for k, v in attrs}
        # A header inside an article holds its headline; one outside is the page's.
        apart = tag in APART or (tag == "header" and not main)
        names = [_WORDS.findall(x) for x in " ".join((got.get("class", ""), got.get("id", ""), got.get("role", ""))).lower().split()]
        against = MARKS - {"header"} if main else MARKS
        weak = tag not in ("body", "html", "main") and any(not against.isdisjoint(x) for x in names)
        strong = weak and any(not against.isdisjoint(x) and against.union(BESIDE).issuperset(x) for x in names)
        if weak:
            self.marked += 1
            marks = (*marks, self.marked if strong else -self.marked)
        hidden = "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
        main = main or ((tag in ("article", "main") or got.get("role") == "main") and not before and not apart and not strong)
        if tag != "hr":
            self.nodes.append((self.nodes[node][0] + 1, tag + "." + ".".join(sorted(set(got.get("class", "").split()))) if got.get("class") else tag))
            self.stack.append((tag, len(self.nodes) - 1, HIDDEN if hidden else max(before, int(apart)), main, marks))

    def _close(self, tags: set[str], until: set[str]) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i][0]
            if tag in tags:
                self.flush()
                del self.stack[i:]
                self.links = 0
                return
            if tag in until:
                return

    def handle_endtag(self, tag: str) -> None:
        if self.unseen and tag not in UNSEEN:
            return
        if not self.unseen and tag not in BLOCKS:
            if tag == "a":
                self.links = max(0, self.links - 1)
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                gone = self.stack[i:]
                if self.unseen:
                    self.unseen -= sum(t in UNSEEN for t, *_ in gone)
                else:
                    self.flush()
                    self.links = 0
                del self.stack[i:]
                return
        if tag == "p" and not self.unseen:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] == "head" and data.strip():
            self.handle_endtag("head")
        if not self.unseen:
            self.part.append(data)
            if self.links:
                self.linked += len(data)


def _fold(nodes: list[tuple[int, str]]) -> tuple[list[tuple[int, str]], list[int]]:
    """The skeleton, with each run of equal sibling subtrees as one, and where each node went in it."""
    n = len(nodes)
    end = [n] * n
    open_: list[int] = []
    for i, (depth, _) in enumerate(nodes):
        while open_ and nodes[open_[-1]][0] >= depth:
            end[open_.pop()] = i
        open_.append(i)
    out: list[tuple[int, str]] = []
    place = [0] * n
    shape: list[int] = [0] * n  # hash of each subtree
    kids: list[list[int]] = [[] for _ in range(n)]
    stack: list[int] = []
    for i, (depth, _) in enumerate(nodes):
        while stack and nodes[stack[-1]][0] >= depth:
            stack.pop()
        if stack:
            kids[stack[-1]].append(i)
        stack.append(i)
    for i in range(n - 1, -1, -1):
        folded = [shape[k] for j, k in enumerate(kids[i]) if not j or shape[k] != shape[kids[i][j - 1]]]
        shape[i] = zlib.crc32(repr((nodes[i][1], folded)).encode()) | len(folded) << 32
    todo = [(0, -1)]
    like: dict[int, int] = {}
    while todo:
        i, twin = todo.pop()
        if twin >= 0:  # a repeat: its nodes go where its twin's went
            place[i] = place[twin]
        else:
            place[i] = len(out)
            out.append(nodes[i])
        mine: list[tuple[int, int]] = []
        for j, k in enumerate(kids[i]):
            if j and shape[k] == shape[kids[i][j - 1]]:
                like[k] = like.get(kids[i][j - 1], kids[i][j - 1])
                mine.append((k, like[k]))
            else:
                mine.append((k, -1))
        if twin >= 0:  # match the folded children of both, in order
            firsts = [k for j, k in enumerate(kids[twin]) if not j or shape[k] != shape[kids[twin][j - 1]]]
            at, mine = -1, []
            for j, k in enumerate(kids[i]):
                at += not j or shape[k] != shape[kids[i][j - 1]]
                mine.append((k, firsts[at]))
        todo += reversed(mine)
    return out, place


def parse_page(html: str | None) -> tuple[str, list[tuple[int, str, int, tuple[int, ...], bool, bool]]]:
    """(skeleton, shown blocks), blocks as (skeleton node, text, characters in links, marks, apart, in main)."""
    parser = PageParser()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    nodes, place = _fold(parser.nodes)
    skeleton = "\n".join(f"{d} {label}" for d, label in nodes)
    return skeleton, [(place[n], text, linked, marks, bool(apart), main) for n, apart, main, text, linked, marks in parser.blocks if apart < HIDDEN]


def main_text(blocks: list[dict], template: set[tuple[int, int]], repeating: set[int], outside: set[int] | None, tags: bool = True) -> str:
    """The text of the blocks that vary. Nodes in outside go, unless most of the page's text stands in
    them; there, and where outside is None (too few pages were compared), what stands in an article or main element, if
    there is one, is the text. Link-rich blocks go where their node repeats
    over pages. If tags, then what is apart goes as well, and marked containers, those with a weak mark if link-rich,
    unless they hold over half of what varies."""
    live = [b for b in blocks if (b["node"], b["said"]) not in template and not (b["rich"] and b["node"] in repeating)]
    if outside is not None:
        inner = [b for b in live if b["node"] not in outside]
        text = lambda rows: sum(len(b["text"]) - b["linked"] for b in rows if not (tags and b["apart"]))
        if 2 * text(inner) >= text(live):
            live = inner
        else:  # a page of another kind than the host's wrapper
            outside = None
    if tags:
        if outside is None and any(b["main"] and not b["apart"] for b in live):
            live = [b for b in live if b["main"]]
        live = [b for b in live if not b["apart"]]
    total = sum(len(b["text"]) for b in live)
    size: dict[int, list[int]] = {}
    for b in live if tags else ():
        for m in b["marks"]:
            held = size.setdefault(m, [0, 0])
            held[0] += len(b["text"])
            held[1] += b["linked"]
    gone = {m for m, (n, linked) in size.items() if 2 * n <= total and (m > 0 or 2 * linked > n)}
    return "\n\n".join(b["text"] for b in live if gone.isdisjoint(b["marks"]))


def children(tree: list[tuple[int, str]]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in tree]
    stack: list[int] = []
    for i, (depth, _) in enumerate(tree):
        while stack and tree[stack[-1]][0] >= depth:
            stack.pop()
        if stack:
            out[stack[-1]].append(i)
        stack.append(i)
    return out


class Shapes:
    """Numbers of subtrees, equal for equal ones; of each its label, its children's shapes and its size."""

    def __init__(self):
        self.number: dict[tuple[str, tuple[int, ...]], int] = {}
        self.of: list[tuple[str, tuple[int, ...], int]] = []

    def add(self, tree: list[tuple[int, str]], kids: list[list[int]]) -> list[int]:
        out = [0] * len(tree)
        for i in range(len(tree) - 1, -1, -1):
            key = tree[i][1], tuple(out[k] for k in kids[i])
            if key not in self.number:
                self.number[key] = len(self.of)
                self.of.append((*key, 1 + sum(self.of[s][2] for s in key[1])))
            out[i] = self.number[key]
        return out


def _grown_row(row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The next row of the matching's table: the best sums when one more child of the one side may be matched."""
    out = row.copy()
    np.maximum(out[1:], row[:-1] + weights, out=out[1:])
    return np.maximum.accumulate(out)


def _pairs(weights: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int]]:
    """The heaviest order-preserving matching of two child lists. Tables of over `most` cells are halved until they
    are small enough: forward sums of one half and backward sums of the other tell where the best matching crosses."""
    out, todo = [], [(0, weights.shape[0], 0, weights.shape[1])]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a > 1 and (b - a + 1) * (d - c + 1) > most:
            mid = (a + b) // 2
            fore, back = np.zeros(d - c + 1, np.int64), np.zeros(d - c + 1, np.int64)
            for i in range(a, mid):
                fore = _grown_row(fore, weights[i, c:d])
            for i in range(b - 1, mid - 1, -1):
                back = _grown_row(back, weights[i, c:d][::-1])
            cross = c + int(np.argmax(fore + back[::-1]))
            todo += [(a, mid, c, cross), (mid, b, cross, d)]
            continue
        grid = [np.zeros(d - c + 1, np.int64)]
        for i in range(a, b):
            grid.append(_grown_row(grid[-1], weights[i, c:d]))
        m, n = b - a, d - c
        while m and n:
            if grid[m][n] == grid[m - 1][n]:
                m -= 1
            elif grid[m][n] == grid[m][n - 1]:
                n -= 1
            else:
                m, n = m - 1, n - 1
                out.append((a + m, c + n))
    return out


def simple_tree_matching(a: list[tuple[int, str]], b: list[tuple[int, str]]) -> dict[int, int]:
    """The largest order- and ancestor-preserving matching of two trees with equal roots: nodes of a to nodes of b.

    Weights are kept by shape, so that repeated subtrees are matched once; no recursion, so that depth has no bound.
    """
    ka, kb, shapes = children(a), children(b), Shapes()
    sa, sb = shapes.add(a, ka), shapes.add(b, kb)
    memo: dict[tuple[int, int], int] = {}

    def weight(s: int, t: int) -> int | None:
        """Nodes in the best matching of two shapes; None: it is not known yet."""
        if shapes.of[s][0] != shapes.of[t][0]:
            return 0
        return shapes.of[s][2] if s == t else memo.get((s, t))

    def table(x: list[int] | tuple[int, ...], y: list[int] | tuple[int, ...]) -> np.ndarray:
        return np.array([[weight(s, t) for t in y] for s in x], np.int64).reshape(len(x), len(y))

    todo = [(sa[0], sb[0])] if a and b else []
    while todo:
        s, t = todo[-1]
        x, y = shapes.of[s][1], shapes.of[t][1]
        open_ = [] if weight(s, t) is not None else [(p, q) for p in set(x) for q in set(y) if weight(p, q) is None]
        if open_:
            todo += open_
            continue
        todo.pop()
        if weight(s, t) is None:
            row = np.zeros(len(y) + 1, np.int64)
            for weights in table(x, y):
                row = _grown_row(row, weights)
            memo[s, t] = 1 + int(row[-1])
    out: dict[int, int] = {}
    pairs = [(0, 0)] if a and b and weight(sa[0], sb[0]) else []
    while pairs:
        i, j = pairs.pop()
        out[i] = j
        x, y = ka[i], kb[j]
        if sa[i] == sb[j]:
            pairs += zip(x, y, strict=True)
        else:
            pairs += [(x[p], y[q]) for p, q in _pairs(table([sa[k] for k in x], [sb[k] for k in y]))]
    return out


def outside_main(wrapper: list[tuple[int, str]], text: dict[int, int], share: float = 0.5, little: float = 0.1) -> set[int]:
    """Wrapper nodes beside the main container. text: characters of varying text at each node. From the root down, a
    container with over `share` of its parent's text is followed; containers beside it with under `little` of its text
    are outside, with all below them."""
    kids, held = children(wrapper), [text.get(i, 0) for i in range(len(wrapper))]
    up = {k: i for i, below in enumerate(kids) for k in below}
    for i in range(len(wrapper) - 1, 0, -1):
        held[up[i]] += held[i]
    out: set[int] = set()
    node = 0
    while kids[node]:
        best = max(kids[node], key=lambda k: (held[k], -k))
        if held[best] <= share * held[node] or not kids[best]:
            break
        for k in kids[node]:
            if k != best and held[k] < little * held[best] and wrapper[k][1].split(".", 1)[0] not in TEXTUAL:
                todo = [k]
                while todo:
                    i = todo.pop()
                    out.add(i)
                    todo += kids[i]
        node = best
    return out


_FIELDS = {"node": pa.int32(), "said": pa.int64(), "text": pa.string(), "rich": pa.bool_(), "linked": pa.int32(), "marks": pa.list_(pa.int32()), "apart": pa.bool_(), "main": pa.bool_(), "new": pa.bool_()}
_BLOCK = pa.struct(list(_FIELDS.items()))
_BLOCKS = "blocks array<struct<node:int,said:bigint,text:string,rich:boolean,linked:int,marks:array<int>,apart:boolean,main:boolean,new:boolean>>"


def _said(blocks: list[tuple], main: bool) -> list[int]:
    """What is compared over pages. In a marked article a block can only be template with all of its node, so that a
    line that recurs between others stays; without one, each block stands for itself."""
    whole: dict[int, str] = {}
    if main:
        for node, text, *_ in blocks:
            whole[node] = f"{whole.get(node, '')}\n{text}"
    texts = (whole[node] if main else text for node, text, *_ in blocks)
    return [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little", signed=True) for t in texts]


def _parsed(tags: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            skeletons, blocks = [], []
            for html in batch.column(3).to_pylist():
                skeleton, found = parse_page(html)
                skeletons.append(skeleton)
                main = tags and any(m and not apart for *_, apart, m in found)
                page, seen = [], set()
                for (node, text, linked, marks, apart, inner), said in zip(found, _said(found, main), strict=True):
                    page.append(dict(zip(_FIELDS, (node, said, text, not main and 2 * linked > len(text), linked, marks, apart, inner, (node, said) not in seen), strict=True)))
                    seen.add((node, said))
                blocks.append(page)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(skeletons), pa.array(blocks, pa.list_(_BLOCK))], names=["page_id", "url", "host", "skeleton", "blocks"])

    return run


def _read(skeleton: str) -> list[tuple[int, str]]:
    return [(int(d), label) for d, label in (x.split(" ", 1) for x in skeleton.split("\n"))]


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, shape, skeleton, wrapper) to (host, shape, node, slot, own): the wrapper's node for each of the skeleton's;
    for a node that has none, that of the nearest node above it that has one, and own is false."""
    for batch in batches:
        hosts, shapes, nodes, slots, own = [], [], [], [], []
        for host, shape, skeleton, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a = _read(skeleton)
            found = {i: i for i in range(len(a))} if skeleton == wrapper else simple_tree_matching(a, _read(wrapper))
            up = {k: i for i, below in enumerate(children(a)) for k in below}
            near: list[int] = []
            for i in range(len(a)):
                near.append(found[i] if i in found else near[up[i]] if i in up else 0)
            hosts += [host] * len(a)
            shapes += [shape] * len(a)
            nodes += range(len(a))
            slots += near
            own += [i in found for i in range(len(a))]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
        columns = [pa.array(c, k) for c, k in zip((hosts, shapes, nodes, slots, own), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "shape", "node", "slot", "own"])


def _left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, wrapper, varying text of slots) to (host, outside)."""
    for batch in batches:
        out = [sorted(outside_main(_read(w), {x["slot"]: x["quiet"] for x in held or []})) for w, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["host", "outside"])


def _texts(tags: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, template, repeating, outside = (batch.column(i).to_pylist() for i in (2, 3, 4, 5))
            known = [{(t["node"], t["said"]) for t in x or []} for x in template]
            each = zip(blocks, known, repeating, outside, strict=True)
            texts = [main_text(b, t, set(r or []), None if o is None else set(o), tags) for b, t, r, o in each]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", constant: float = 0.8, least_pages: int = 5, tags: bool = True
) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    A block is template when at least `constant` of the host's different pages with its wrapper node, and
    `least_pages` of them, show the same text there. Containers beside the main one go where the host has `least_pages`
    different pages; where it has fewer, elements and names decide alone. tags: whether elements (nav, footer, article)
    and names count at all. Null or empty html and pages without content give an empty text. A null or
    unreadable url makes a host of its own kind. Repeated rows repeat their result; other columns are not read;
    an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "wrapper")
    host = F.coalesce(F.lower(F.try_parse_url(F.col(url_col).cast("string"), F.lit("HOST"))), F.lit(""))
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    parsed = picked.mapInArrow(_parsed(tags), f"page_id long, url string, host string, skeleton string, {_BLOCKS}")
    parsed = scratch.save(parsed.withColumn("shape", F.xxhash64("skeleton")), "parsed")

    shapes = parsed.groupBy("host", "shape").agg(F.count("*").alias("n"), F.min("skeleton").alias("skeleton"))
    shapes = scratch.save(shapes, "shapes")
    wrappers = shapes.groupBy("host").agg(F.max(F.struct("n", "skeleton")).alias("best")).select("host", F.col("best.skeleton").alias("wrapper"))
    wrappers = scratch.save(wrappers, "wrappers")
    near = shapes.join(wrappers, "host").select("host", "shape", "skeleton", "wrapper").mapInArrow(_aligned, "host string, shape long, node int, slot int, own boolean")
    near = scratch.save(near, "aligned")
    aligned = near.filter("own").drop("own")

    # Copies of a page count once: else a host of copies would be all template.
    against = "b.apart OR exists(b.marks, m -> m > 0)" if tags else "false"
    texts = F.expr(f"array_distinct(transform(blocks, b -> struct(b.node AS node, b.said AS said, b.rich AS rich, b.new AS new, if({against}, 0, length(b.text) - b.linked) AS quiet)))")
    shown = parsed.select("host", "shape", texts.alias("said")).groupBy("host", "shape", "said").agg(F.lit(1).alias("one"))
    shown = scratch.save(shown.select("host", "shape", "said"), "shown")
    pages_ = scratch.save(shown.groupBy("host", "shape").agg(F.count("*").alias("pages")), "pages")
    total = aligned.join(pages_, ["host", "shape"]).groupBy("host", "slot").agg(F.sum("pages").alias("all"))
    each = shown.select("host", "shape", F.explode("said").alias("x")).select("host", "shape", "x.*")
    each = each.groupBy("host", "shape", "node", "said").agg(F.sum(F.col("new").cast("long")).alias("n"), F.bool_or("rich").alias("rich"), F.sum("quiet").alias("quiet"))
    each = scratch.save(each, "each")
    counts = each.join(aligned, ["host", "shape", "node"]).groupBy("host", "slot", "said").agg(F.sum("n").alias("n"), F.bool_or("rich").alias("rich"), F.sum("quiet").alias("quiet"))
    counts = scratch.save(counts, "counts")
    # Slots most of whose link-rich showings say what another page of the host says there too.
    again = counts.filter("rich").groupBy("host", "slot").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("same")).filter("2 * same > n")
    fixed = counts.filter(F.col("n") >= least_pages).join(total, ["host", "slot"]).filter(F.col("n") >= constant * F.col("all"))
    fixed = scratch.save(fixed.select("host", "slot", "said"), "fixed")
    mark = F.collect_set(F.struct("node", "said")).alias("template")
    template = scratch.save(aligned.join(fixed, ["host", "slot"]).groupBy("host", "shape").agg(mark), "template")
    repeating = aligned.join(again.select("host", "slot"), ["host", "slot"]).groupBy("host", "shape").agg(F.collect_set("node").alias("repeating"))
    repeating = scratch.save(repeating, "repeating")

    # The main container, from what varies: one row per host, as long as its wrapper.
    varying = counts.join(fixed, ["host", "slot", "said"], "left_anti").groupBy("host", "slot").agg(F.sum("quiet").alias("quiet"))
    varying = varying.groupBy("host").agg(F.collect_list(F.struct("slot", "quiet")).alias("held"))
    enough = pages_.groupBy("host").agg(F.sum("pages").alias("pages")).filter(F.col("pages") >= least_pages).select("host")
    told = wrappers.join(enough, "host").join(varying, "host", "left").select("host", "wrapper", "held").mapInArrow(_left_out, "host string, outside array<int>")
    told = scratch.save(told, "outside")
    beside = near.join(told.select("host", F.explode("outside").alias("slot")), ["host", "slot"]).groupBy("host", "shape").agg(F.collect_set("node").alias("beside"))
    beside = scratch.save(beside, "beside")

    out = parsed.select("page_id", "url", "host", "shape", "blocks")
    for part in (template, repeating, beside):
        out = out.join(part, ["host", "shape"], "left")
    out = out.join(told.select("host", F.lit(True).alias("many")), "host", "left")
    outside = F.when(F.col("many"), F.coalesce("beside", F.array().cast("array<int>"))).alias("outside")
    out = out.select("page_id", "url", "blocks", "template", "repeating", outside).mapInArrow(_texts(tags), "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
