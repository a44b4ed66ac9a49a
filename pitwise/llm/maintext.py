"""Main text of web pages by a minimum cut.

A page is cut into blocks: runs of text between block-level tags. A linear classifier turns each
block's place and shape into log-odds of being content. Both labels' costs become capacities from
the source and to the sink; blocks that follow each other, or share a parent element, are tied by
smoothness edges that weaken with their distance in the tree. The maximum flow separates content
(source side) from boilerplate.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from pitwise.llm.common import pieces

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option "
    "p pre search section select summary table tbody td tfoot th thead tr ul caption title button textarea "
    "label".split()
)
#: Elements whose inside is no text of the page.
SILENT = frozenset("script style noscript template iframe object svg canvas math audio video head title".split())
RAW = frozenset("script style textarea title iframe noscript template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK_TAGS - {"option", "optgroup", "label", "button", "title", "head", "html", "body", "textarea", "select"}
#: A start tag ends these open elements, up to one of the fences.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
FURNITURE_TAGS = frozenset("nav footer aside form button select option textarea label fieldset legend menu dialog search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words in an element's id and class, by how much they speak against content.
STRONG_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr alert popup modal overlay newsletter subscribe subscription signup login signin menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar aside widget widgets footer foot masthead topbar share sharing "
    "related recommended recommendations trending pagination pager copyright hidden toolbar".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
WEAK_WORDS = frozenset("notice notices header social popular tags search form legal disclaimer rail skip teaser".split())
FURNITURE_WORDS = STRONG_WORDS | COMMENT_WORDS | WEAK_WORDS
#: After these a word tells what a page has, before those how it is set: not what the element is.
HAVING, SETTING = frozenset("has with without no".split()), frozenset("open closed enabled disabled on off".split())
CONTENT_WORDS = frozenset("article content main body post entry story text prose".split())
TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S
)
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>|\Z)")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Weights of the block classifier, in log-odds. None is beyond what the edges around a block may add
#: up to, so that neighbours can overrule any single feature.
BIAS, ARTICLE, CONTENT_NAME, ABOVE = -1.5, 4.0, 1.5, -1.0
TAGGED, STRONG, WEAK = -5.0, -5.0, -4.0
PROSE_TAG, LIST_ITEM, PER_DOUBLING, MOST_DOUBLINGS, LINKS, SENTENCE = 1.0, -0.5, 0.4, 6, -4.0, 0.7
#: Smoothness of neighbours in the same place, its reach in tree steps, how many steps are told apart, and
#: what a change of section leaves.
SMOOTH, REACH, STEPS, ACROSS = 3.0, 3.0, 12, 0.1
#: The part of a page's words from which on an element's name is that of the page's frame.
MOST = 0.5


class Node:
    """An element: what its tag and names say, and what is known once the page is read."""

    __slots__ = ("tag", "parent", "depth", "block", "tagged", "named", "comments", "content", "article", "link",
                 "words", "against", "above", "inside", "titled", "section")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if parent is None or tag in BLOCK_TAGS else parent.block
        self.tagged = self.named = 0.0
        self.comments = self.content = self.article = self.link = False
        self.words = 0


@dataclass
class Block:
    parent: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _names(value: str) -> set[str]:
    """The words of an id or a class that name its element."""
    found = set()
    for part in value.split():
        words = [w.lower() for w in TOKEN.findall(part)]
        for k, word in enumerate(words):
            before, after = words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else ""
            if before not in HAVING and after not in SETTING:
                found.add(word)
    return found


def _describe(node: Node, raw: str) -> None:
    """What the tag and its id, class and role say about an element."""
    node.article = node.tag in ("article", "main")
    node.tagged = TAGGED if node.tag in FURNITURE_TAGS or node.tag == "header" else 0.0
    node.link = node.tag == "a"
    if raw and node.tag not in ("html", "body") and not raw.isspace():
        for name, a, b, c in ATTRIBUTE.findall(raw):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                found = _names(value)
                if node.tag == "header":
                    found -= {"header", "masthead", "banner"}
                node.comments = node.comments or bool(found & COMMENT_WORDS)
                if found & (STRONG_WORDS | COMMENT_WORDS):
                    node.named = STRONG
                elif found & WEAK_WORDS:
                    node.named = min(node.named, WEAK)
                elif found & CONTENT_WORDS:
                    node.content = True
            elif name == "role":
                if value.lower() in FURNITURE_ROLES:
                    node.tagged = TAGGED
                node.article = node.article or value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                node.tagged = TAGGED
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                node.tagged = TAGGED


def _settle(nodes: list[Node], blocks: list["Block"]) -> None:
    """What an element's place says, once all words are counted; parents come before children.

    The name of an element that holds most of the page's words is that of a frame, unless it names
    comments. An article inside comments, teasers or other furniture is one of them, and a header
    inside an article belongs to it.
    """
    for block in blocks:
        block.parent.words += len(block.text.split())
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.words += node.words
    total = nodes[0].words
    for node in nodes:
        up = node.parent
        if up is None:
            node.against, node.above, node.inside, node.titled, node.section = 0.0, False, False, False, node
            continue
        named = node.named
        if node.words >= MOST * total and not node.comments and not node.article:
            named = 0.0
        own = min(named, node.tagged)
        if node.tag == "header" and up.inside:
            own = named
        article = node.article
        if article and (node.comments or named or up.against):
            article, own = False, min(own, up.against, STRONG)
        node.titled = up.titled or node.content
        if article:
            # a nested article stays in the first one; furniture above the first speaks a little
            node.inside, node.above, node.against = True, up.above or up.against < 0, 0.0
        else:
            node.inside, node.above, node.against = up.inside, up.above, min(up.against, own)
        node.section = node if own < 0 or article else up.section


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order. Broken markup is read as browsers do, as far as text goes."""
    root = Node("", None)
    stack, out, nodes = [root], [], [root]
    open_tags: Counter[str] = Counter()
    links = 0
    current: Block | None = None
    silent: Node | None = None

    def say(text: str) -> None:
        nonlocal current
        if silent is not None or not text:
            return
        if current is None:
            current = Block(stack[-1].block)
            out.append(current)
        current.parts.append(text)
        if links:
            current.linked += len(text.split())

    def pop_to(k: int) -> None:
        nonlocal silent, links
        for node in stack[k:]:
            open_tags[node.tag] -= 1
            links -= node.link
            if node is silent:
                silent = None
        del stack[k:]

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(entities.unescape(page[at:]))
            break
        if lt > at:
            say(entities.unescape(page[at:lt]))
        m = TAG.match(page, lt)
        if m is None:
            m = LOOSE_TAG.match(page, lt)
            if m is None:
                say("<")
                at = lt + 1
                continue
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCK_TAGS:
            current = None
        if m[1]:
            if open_tags[name]:
                pop_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == name))
            continue
        if name == "br":
            say("\n")
            continue
        if name in CLOSES_P and open_tags["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop_to(k)
                    break
                if stack[k].tag in ("table", "td", "th", "button", "div", "article", "section", "body"):
                    break
        if name in SIBLINGS:
            ends, fences = SIBLINGS[name]
            for k in range(len(stack) - 1, 0, -1) if any(open_tags[e] for e in ends) else ():
                if stack[k].tag in ends:
                    pop_to(k)
                    break
                if stack[k].tag in fences:
                    break
        if name == "body" and silent is not None:  # a head that was not closed
            pop_to(next(k for k, n in enumerate(stack) if n is silent))
        if name in VOID:
            continue
        node = Node(name, stack[-1])
        _describe(node, m[3])
        nodes.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            inner = page[at : close.start()] if close else page[at:]
            at = close.start() if close else end
            if name == "textarea":
                stack.append(node)
                open_tags[name] += 1
                say(entities.unescape(inner))
                pop_to(len(stack) - 1)
            if close:
                gt = page.find(">", close.end())
                at = gt + 1 if gt >= 0 else end
            continue
        if not m[3].rstrip().endswith("/") or name in BLOCK_TAGS:
            stack.append(node)
            open_tags[name] += 1
            links += node.link
            if name in SILENT and silent is None:
                silent = node
    found = []
    for block in out:
        block.text = " ".join("".join(block.parts).split())
        if block.text:
            found.append(block)
    _settle(nodes, found)
    return found


def log_odds(block: Block) -> float:
    """How much more likely a block is content than boilerplate."""
    words = block.text.split()
    z = BIAS + PER_DOUBLING * min(math.log2(1 + len(words)), MOST_DOUBLINGS)
    tag = block.parent.tag
    if tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"):
        z += PROSE_TAG
    elif tag in ("li", "td", "th", "dd", "dt"):
        z += LIST_ITEM
    z += LINKS * min(1.0, block.linked / len(words))
    if block.text[-1] in ".!?…:;\"”»。！？":
        z += SENTENCE
    if block.text[0] == "©":
        z += STRONG
    node = block.parent
    z += node.against + ABOVE * (node.inside and node.above)
    if not node.against:
        z += ARTICLE * node.inside + CONTENT_NAME * (node.titled and not node.inside)
    return z


def _distance(a: Node, b: Node) -> int:
    """Steps between two elements along the tree, ``STEPS`` at most."""
    steps = abs(a.depth - b.depth)
    if steps >= STEPS:
        return STEPS
    while a.depth > b.depth:
        a = a.parent
    while b.depth > a.depth:
        b = b.parent
    while a is not b and steps < STEPS:
        a, b, steps = a.parent, b.parent, steps + 2
    return min(steps, STEPS)


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between following blocks, and between blocks next to each other under one element."""
    out, last = [], {}
    for i, block in enumerate(blocks):
        ties = set()
        if i:
            ties.add(i - 1)
        up = block.parent.parent if block.parent.parent is not None else block.parent
        before = last.get(id(up))
        if before is not None:
            ties.add(before)
        last[id(up)] = i
        for j in ties:
            weight = SMOOTH * math.exp(-_distance(blocks[j].parent, block.parent) / REACH)
            if blocks[j].parent.section is not block.parent.section:
                weight *= ACROSS
            out.append((j, i, weight))
    return out


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of the minimum cut (Dinic's algorithm).

    A node's two terminal costs differ by its log-odds, so the smaller is sent straight through and
    only the difference is left as a capacity: from the source if positive, to the sink if not.
    """
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, c: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, z in enumerate(odds):
        if z > 0:
            arc(source, i, z, 0.0)
        elif z < 0:
            arc(i, sink, -z, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            # zero log-odds that no flow reaches are boilerplate
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if not path:
                    break
                a = to[path.pop() ^ 1]
                turn[a] += 1
                continue
            path.append(e)
            a = to[e]


def main_text(page: str | None) -> str:
    """The content blocks of one page, joined by line breaks; empty if there is none."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    kept = min_cut([log_odds(b) for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; ``n_chars`` counts code points.

    A null or empty page, or one of markup alone, has an empty text. Rows are independent: repeats
    give equal results and an empty table gives none. Nulls in page_id and url are kept; other
    columns are not read.
    """

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "html"):
                texts = [main_text(p) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long"
    )
