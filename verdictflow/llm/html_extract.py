"""Main text of web pages by minimum-cut labelling of their blocks.

A linear scan splits a page into blocks of text, each with the elements that it stands in.  A classifier gives every
block a signed score; positive scores are capacities from the source (content), negative ones to the sink
(boilerplate); tags and class names are features of it as density of words and links are.  Blocks that follow each
other, and neighbours under one parent, are joined by smoothness edges of the same order as the scores, so a short line
of an article stays with it and a long advert stays out; between blocks whose marks differ, edges are a tenth as strong.
The minimum cut, found by maximum flow, labels the blocks.  A block whose own capacity exceeds all of its edges is on
that side of every minimum cut, so it is settled first and its edges are handed to its neighbours as capacities; the
flow runs over what is left.

Edge cases: null and empty pages have an empty text; pages of any length are read whole, in one pass, whatever their
nesting; a tag or comment that never ends swallows the rest, as in browsers; repeated rows are extracted each; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

BLOCK_TAGS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no page text; the first ones' content is not even markup.
RAW_TAGS = set("script style textarea title xmp iframe noembed noframes".split())
SILENT_TAGS = RAW_TAGS | set("head noscript template select option optgroup button svg math object canvas audio video datalist map".split())
BOILERPLATE_TAGS = set("nav aside footer form menu dialog".split())
MAIN_TAGS = {"article", "main"}
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
BOILERPLATE_WORDS = set(
    "nav navbar navigation menu menubar sidebar aside footer foot header masthead topbar ad ads adv advert adverts advertisement advertising "
    "banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "comment comments commentlist disqus respond reply replies share sharing social related recommended breadcrumb breadcrumbs crumbs "
    "newsletter subscribe subscription signup login search searchform widget widgets toolbar copyright legal disclaimer pagination pager skip".split()
)
CONTENT_WORDS = set("article content post entry story main text body".split())
#: What an open tag closes by itself.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Inside of these, nothing outside is closed.
SCOPES = set("#root ul ol dl table tbody thead tfoot div article section main body form footer nav aside header blockquote".split())
CLOSABLE = {t: 1 << i for i, t in enumerate("p li dt dd tr td th".split())}
ENDED_BY = {t: CLOSABLE["p"] | sum(CLOSABLE[x] for x in CLOSES.get(t, ())) for t in BLOCK_TAGS}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

MARKED, INSIDE, OUTSIDE, CONTENT = 5.5, 0.9, 2.5, 2.5
NEXT_TO, SAME_PARENT, CONTRAST = 2.0, 1.5, 0.1


class Node:
    """An open element: its flags hold for all that stands in it."""

    __slots__ = ("tag", "parent", "silent", "boiler", "main", "content", "form", "ends")

    def __init__(self, tag: str, parent: Node | None, attributes: str) -> None:
        self.tag, self.parent = tag, parent
        self.ends = 0 if tag in SCOPES or not parent else parent.ends | CLOSABLE.get(tag, 0)  # what may be closed from here
        silent, boiler, main, content = (parent.silent, parent.boiler, parent.main, parent.content) if parent else (False, False, False, False)
        silent = silent or tag in SILENT_TAGS
        main = main or tag in MAIN_TAGS
        form = bool(parent and parent.form)
        if tag == "form":
            form = True
        elif tag in MAIN_TAGS:  # a form around the whole page is no form
            form = False
        boiler = boiler or (tag in BOILERPLATE_TAGS and tag != "form") or (tag == "header" and not main)
        if attributes and tag not in ("html", "body"):
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), a or b or c
                if name in ("class", "id"):
                    tokens = {x.lower() for x in TOKEN.findall(value)}
                    marks = tokens & BOILERPLATE_WORDS
                    if marks <= {"header", "head"} and (main or tokens & CONTENT_WORDS):
                        marks = set()  # an article's own head, which holds its title
                    boiler = boiler or (bool(marks) and not (tag in MAIN_TAGS and not tokens & {"comment", "comments", "reply", "ad", "ads"}))
                    content = content or bool(tokens & CONTENT_WORDS)
                elif name == "role":
                    boiler = boiler or value.lower() in BOILERPLATE_ROLES
                    main = main or value.lower() in ("main", "article")
                elif name == "style":
                    silent = silent or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                    silent = True
        self.silent, self.boiler, self.main, self.content, self.form = silent, boiler, main, content, form


class Block:
    __slots__ = ("text", "node", "linked", "marked")

    def __init__(self, text: str, node: Node, linked: float) -> None:
        self.text, self.node, self.linked, self.marked = text, node, linked, node.boiler or node.form


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order: text without markup, references decoded, white space single."""
    out: list[Block] = []
    parts: list[str] = []
    node = Node("#root", None, "")
    at, n, linked, links, tag_form = 0, len(page), 0, 0, TAG
    open_tags: Counter[str] = Counter()

    def leave(inner: Node, outer: Node) -> Node:
        while inner is not outer:
            open_tags[inner.tag] -= 1
            inner = inner.parent
        return outer

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, node, linked / max(1, len(text))))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not node.silent:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        say(page[at:lt])
        follows = page[lt + 1 : lt + 2]
        if follows == "!" or follows == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        if not (follows.isascii() and follows.isalpha()) and not (follows == "/" and page[lt + 2 : lt + 3].isalpha()):
            say("<")
            at = lt + 1
            continue
        m = tag_form.match(page, lt)
        if not m and tag_form is TAG:
            tag_form = PLAIN_TAG  # a quote that never ends: from here on, tags end at the first >
            m = tag_form.match(page, lt)
        if not m:
            break
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            if tag == "a":
                links = max(0, links - 1)
            if open_tags[tag] > 0:  # one that opens nothing closes nothing
                ended = node
                while ended.tag != tag:
                    ended = ended.parent
                node = leave(node, ended.parent)
            continue
        if tag in BLOCK_TAGS:
            flush()
            node = leave(node, closed_by(node, ENDED_BY[tag]))
        if tag == "br":
            say(" ")
        if tag in VOID_TAGS:
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag == "a":
            links = 1
        if not m[3].endswith("/") or tag in BLOCK_TAGS:
            node = Node(tag, node, m[3])
            open_tags[tag] += 1
    flush()
    return out


def closed_by(node: Node, ended: int) -> Node:
    """The element left open where a block starts: it ends an open paragraph, and items end items of their list."""
    at, found = node, node
    while at.ends & ended:
        if CLOSABLE.get(at.tag, 0) & ended:
            found = at.parent
        at = at.parent
    return found


def scores(blocks: list[Block]) -> list[float]:
    """Positive: content.  Every mark is one bounded feature beside density of words and links.

    What main elements are worth follows their share of the page's unlinked words: of teasers beside a body of text,
    they speak against a block.
    """
    words = [b.text.count(" ") + 1 for b in blocks]
    own = [0.0 if b.marked else w * (1 - min(1.0, b.linked)) for b, w in zip(blocks, words, strict=True)]
    has_main = any(b.node.main and not b.node.boiler for b in blocks)
    has_content = not has_main and any(b.node.content and not b.node.boiler for b in blocks)
    share = 2 * sum(o for o, b in zip(own, blocks, strict=True) if b.node.main) / (sum(own) or 1.0) - 1 if has_main else 0.0
    inside, outside = (INSIDE * share, -OUTSIDE * share) if share >= 0 else (OUTSIDE * share, -INSIDE * share)
    out = []
    for b, w in zip(blocks, words, strict=True):
        tag = b.node.tag
        s = -1.8 + 3.0 * min(w, 15) / 15 - 4.0 * b.linked + 0.6 * (b.text[-1:] in ".!?…\"”»") + 1.0 * (tag in ("p", "pre", "blockquote")) + 0.6 * (tag in ("li", "dt", "dd", "td", "th")) + 1.2 * (tag in ("h1", "h2")) - 3.0 * ("©" in b.text)
        if b.marked:
            s -= MARKED
        elif has_main:
            s += inside if b.node.main else outside
        elif has_content:
            s += CONTENT if b.node.content else -CONTENT
        out.append(s)
    return out


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], float]:
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}

    def join(i: int, j: int, c: float) -> None:
        a, b = blocks[i], blocks[j]
        alike = a.marked == b.marked and a.node.main == b.node.main
        edges[i, j] = edges.get((i, j), 0.0) + (c if alike else c * CONTRAST)

    for j, b in enumerate(blocks):
        if j:
            join(j - 1, j, NEXT_TO)
        parent = id(b.node.parent or b.node)
        if parent in last:
            join(last[parent], j, SAME_PARENT)
        last[parent] = j
    return edges


def minimum_cut(score: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """True where the node is on the source's side of the minimum cut nearest to the sink."""
    n = len(score)
    excess = list(score)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in edges.items():
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    side: list[bool | None] = [e > 0 if abs(e) > sum(c.values()) else None for e, c in zip(excess, near, strict=True)]
    for i in range(n):
        if side[i] is not None:
            for j, c in near[i].items():
                excess[j] += c if side[i] else -c
                del near[j][i]
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        flow = Flow(len(left) + 2)
        place = {i: k + 2 for k, i in enumerate(left)}
        for i in left:
            if excess[i] > 0:
                flow.edge(0, place[i], excess[i], 0.0)
            elif excess[i] < 0:
                flow.edge(place[i], 1, -excess[i], 0.0)
            for j, c in near[i].items():
                if i < j:
                    flow.edge(place[i], place[j], c, c)
        away = flow.cut()
        for i in left:
            side[i] = not away[place[i]]
    return [bool(x) for x in side]


class Flow:
    """Maximum flow by layered networks; node 0 is the source, 1 the sink."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.room: list[float] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, forth: float, back: float) -> None:
        for u, v, c in ((a, b, forth), (b, a, back)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(c)

    def layers(self, start: int, reverse: bool = False) -> list[int]:
        """Distance from start over edges with room; in reverse, to start.  -1: out of reach."""
        depth = [-1] * len(self.out)
        depth[start] = 0
        todo = deque([start])
        while todo:
            u = todo.popleft()
            for e in self.out[u]:
                v = self.to[e]
                if depth[v] < 0 and self.room[e ^ 1 if reverse else e] > 1e-9:
                    depth[v] = depth[u] + 1
                    todo.append(v)
        return depth

    def cut(self) -> list[bool]:
        """True for nodes that can still reach the sink once the flow is maximal."""
        while (depth := self.layers(0))[1] >= 0:
            at = [0] * len(self.out)
            path: list[int] = []
            u = 0
            while True:
                if u == 1:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path, u = [], 0
                    continue
                while at[u] < len(self.out[u]):
                    e = self.out[u][at[u]]
                    if self.room[e] > 1e-9 and depth[self.to[e]] == depth[u] + 1:
                        break
                    at[u] += 1
                else:
                    if u == 0:
                        break
                    back = path.pop()
                    u = self.to[back ^ 1]
                    at[u] += 1
                    continue
                path.append(e)
                u = self.to[e]
        reach = self.layers(1, reverse=True)
        return [d >= 0 for d in reach]


def extract(page: str) -> str:
    blocks = blocks_of(page)
    kept = minimum_cut(scores(blocks), smoothness(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def extract_table(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) to page_id, url, text, n_chars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [extract(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_table(table(spark, sf_dir, "pages"))


