"""Operator 6: main text of web pages by minimum-cut labelling.

A page is read as a sequence of text blocks (what stands between block-level tags), each with its chain of open elements.  Script,
style and other raw or hidden elements and comments give no blocks.  A classifier's cost of calling a block content or
boilerplate becomes its capacity to the sink and to the source; smoothness edges join neighbouring blocks, stronger the closer
they are in the document tree (elements that their chains share), and the first with the last child of one parent.  The maximum flow separates
content from boilerplate at the least total cost.

A block's text: character references decoded, white space (a line break counts as such) to one space, trimmed; empty blocks are none.  The main text joins the
content blocks in page order with an empty line between.  A null or empty page has an empty text.  Pages are independent rows, so
repeated ones give a row each and an empty table none; other columns are ignored.  Broken markup is read leniently: an end tag closes up to
its nearest open element, or nothing."""

from __future__ import annotations

import html as entities
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

# HTML element names by their role.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg annotation annotation-xml head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input math mrow mi mo mn ms mtext mfrac msqrt mroot msup msub msubsup munder mover munderover mmultiscripts mtable mtr mtd mstyle mspace mpadded menclose semantics annotation annotation-xml script style template svg".split())
BOILERPLATE = frozenset("nav header footer aside form button select option menu dialog fieldset legend".split())
CONTENT = frozenset("article main".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption td th li".split())
#: Elements whose open sibling a start tag closes.
CLOSES = {"p": "p", "li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}
#: Block-level elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HINTS_OUT = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|nav\w*|menu|breadcrumbs?|header|footer|sidebar|widget|related|recommend\w*|share|social|comments?|respond|replies|reply|pagination|pager|tags|toolbar|skip|search|copyright)(?:$|[\s_-])", re.I)
HINTS_IN = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text)(?:$|[\s_-])", re.I)

OPENING = re.compile(r"<(?:!--|!|\?|(/?)([a-zA-Z][^\s/>]*))")
SPECIAL = re.compile("[>\"']")
HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
SPACE = re.compile(r"\s+")

#: Costs of calling a block boilerplate (source side) or content (sink side), in tenths; smoothness between two neighbours.
SURE, HINTED, PRIOR_OUT, JOIN, JOIN_NEAR = 200, 60, 6, 4, 12


class Tags:
    """Tags of a page, in one pass: no place is looked at again after a search from it has failed."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in (">", '"', "'", "-->")}
        self.failed: set[int] = set()

    def find(self, c: str, at: int) -> int:
        return self.page.find(c, at) if at <= self.last[c] else -1

    def end(self, at: int) -> int:
        """Place of the > that ends a tag: outside quotation marks, else the first one; a mark that is never closed is a letter.  -1: none."""
        path, p = [], at
        while p <= self.last[">"]:
            s = SPECIAL.search(self.page, p).start()
            if self.page[s] == ">":
                return s
            if s in self.failed:
                break
            path.append(s)
            p = max(self.find(self.page[s], s + 1), s) + 1
        self.failed.update(path)
        return self.find(">", at)

    def next(self, at: int):
        """(start, end, closing, name, attributes) of the next tag, comment or declaration (name empty), or None."""
        while m := OPENING.search(self.page, at):
            start, at, name = m.start(), m.end(), m.group(2)
            if name:
                end = self.end(at)
                if end >= 0:
                    return start, end + 1, bool(m.group(1)), name.lower(), self.page[at:end]
            elif m.group() == "<!--":
                end = self.find("-->", at)
                short = next((len(x) for x in (">", "->") if self.page.startswith(x, at)), None)
                return start, end + 3 if end >= 0 else len(self.page) if short is None else at + short, False, "", ""
            else:
                end = self.find(">", at)
                if end >= 0:
                    return start, end + 1, False, "", ""
        return None


class Block:
    __slots__ = ("chain", "linked", "parts", "size", "text")

    def __init__(self, chain):
        self.chain, self.parts, self.linked, self.size, self.text = chain, [], 0, 0, ""


class Element:
    __slots__ = ("blocks", "depth", "hidden", "hint", "name", "parent")

    def __init__(self, name: str, attributes: str, parent):
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent else 0
        self.hint = " ".join(a or b or c for a, b, c in HINT.findall(attributes)) if attributes else ""
        self.hidden = bool(parent and parent.hidden) or name in RAW or bool(attributes and HIDDEN.search(attributes))

    def chain(self):
        e = self
        while e:
            yield e
            e = e.parent


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order."""
    out: list[Block] = []
    top = Element("", "", None)
    at, here, block, links, tags = 0, top, None, 0, Tags(page)

    def add(text: str) -> None:
        nonlocal block
        if here.hidden or not text:
            return
        if block is None:
            e = here
            while e.parent and e.name in INLINE:
                e = e.parent
            block = Block(e)
            out.append(block)
        block.parts.append(text)
        if links:
            block.linked += len(text)

    while True:
        tag = tags.next(at)
        add(page[at : tag[0]] if tag else page[at:])
        if not tag:
            break
        _, at, closing, name, attributes = tag
        if not name:
            continue
        inline = name in INLINE
        if name == "br":
            if block:
                block.parts.append("\n")
            continue
        if not inline:
            block = None
        if closing:
            e = here
            while e.parent and e.name != name:
                if inline and e.name not in INLINE:
                    break
                e = e.parent
            if e.parent and e.name == name:
                links = max(0, links - sum(x.name == "a" for x in _between(here, e)))
                here = e.parent
            continue
        if name in ENDS_P or name in CLOSES:
            e = here
            while e.parent and (e.name in INLINE or e.name == "p"):
                if e.name == "p" and (name in ENDS_P or name == "p"):
                    links = max(0, links - sum(x.name == "a" for x in _between(here, e)))
                    here = e.parent
                    break
                e = e.parent
            if name in CLOSES and name != "p" and CLOSES.get(here.name) == CLOSES[name]:
                here = here.parent
        if name in VOID or attributes.endswith("/") and name in INLINE | VOID:
            continue
        if name in RAW and name != "head":
            end = re.compile(rf"</{re.escape(name)}", re.I).search(page, at)
            at = (tags.find(">", end.end()) if end else -1) + 1 or len(page)
            continue
        if name == "body":
            while here.parent and here.name != "html":
                here = here.parent
        here = Element(name, attributes, here)
        links += name == "a"
    kept = []
    for b in out:
        raw = "".join(b.parts)
        b.text = SPACE.sub(" ", entities.unescape(raw)).strip()
        b.size = max(1, len(raw))
        if b.text:
            kept.append(b)
    return kept


def _between(low: Element, high: Element):
    while True:
        yield low
        if low is high:
            return
        low = low.parent


def costs(b: Block) -> tuple[int, int]:
    """Cost of calling the block boilerplate, and of calling it content."""
    keep, drop = 0, PRIOR_OUT
    for e in b.chain.chain():
        if e.name in BOILERPLATE and not (e.name == "header" and any(x.name in CONTENT for x in e.chain())):
            drop += SURE
        elif e.name in CONTENT:
            keep += HINTED
        if e.hint and e.name not in ("html", "body"):
            drop += 2 * HINTED if HINTS_OUT.search(e.hint) else 0
            keep += HINTED // 2 if HINTS_IN.search(e.hint) else 0
    if b.chain.name in PARAGRAPH:
        keep += 6 if b.chain.name != "li" else 2
    words = b.text.count(" ") + 1
    keep += min(40, words) + (4 if b.text[-1:] in ".!?…:»\"'”" else 0)
    drop += 40 * min(b.linked, b.size) // b.size + (6 if words < 4 else 0)
    return keep, drop


def smoothness(a: Block, b: Block) -> int:
    """Neighbours hold together more, the deeper their nearest common element is relative to them."""
    x, y = a.chain, b.chain
    far = 0
    while x is not y:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        far += 1
    return JOIN_NEAR if far <= 2 else max(0, JOIN - far + 3)


def least_cut(keep: list[int], drop: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels (True: content) of least total cost, by shortest augmenting paths; ``keep`` is cut where a block is
    boilerplate, ``drop`` where it is content, an edge where its ends differ."""
    n = len(keep)
    s, t = n, n + 1
    to, room, out = [], [], [[] for _ in range(n + 2)]

    def edge(a: int, b: int, c: int, back: int) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(c)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        both = min(keep[i], drop[i])  # flows straight through
        if keep[i] > both:
            edge(s, i, keep[i] - both, 0)
        elif drop[i] > both:
            edge(i, t, drop[i] - both, 0)
    for a, b, c in edges:
        if c:
            edge(a, b, c, c)
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if room[e] and to[e] not in level:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if t not in level:
            return [i in level for i in range(n)]
        nxt = [0] * (n + 2)
        path, x = [], s
        while True:  # depth-first along levels
            if x == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path, x = [], s
                continue
            while nxt[x] < len(out[x]):
                e = out[x][nxt[x]]
                if room[e] and level.get(to[e], -1) == level[x] + 1:
                    break
                nxt[x] += 1
            if nxt[x] < len(out[x]):
                path.append(out[x][nxt[x]])
                x = to[path[-1]]
            elif x == s:
                break
            else:
                e = path.pop()
                x = to[e ^ 1]
                nxt[x] += 1


def main_blocks(page: str) -> list[str]:
    blocks = blocks_of(page or "")
    if not blocks:
        return []
    pairs = [costs(b) for b in blocks]
    edges = [(i, i + 1, smoothness(a, b)) for i, (a, b) in enumerate(zip(blocks, blocks[1:], strict=False))]
    ends: dict[int, tuple[int, int]] = {}
    for i, b in enumerate(blocks):
        if b.chain.parent:
            first, _ = ends.get(id(b.chain.parent), (i, i))
            ends[id(b.chain.parent)] = first, i
    edges += [(a, b, JOIN) for a, b in ends.values() if b > a + 1]
    label = least_cut([k for k, _ in pairs], [d for _, d in pairs], edges)
    return [b.text for b, content in zip(blocks, label, strict=True) if content]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the number of content blocks of every page."""

    def run(batches):
        for b in batches:
            done = 0
            for _, some in steps([pa.RecordBatch.from_arrays([b.column(0), b.column(2)], ["id", "html"])]):
                found = [main_blocks(p) for p in some]
                texts = ["\n\n".join(f) for f in found]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(some)), b.column(1).slice(done, len(some)), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(len, found)), pa.int32())],
                                                 ["page_id", "url", "text", "n_chars", "n_blocks"])
                done += len(some)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks int")
