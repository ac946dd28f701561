"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks (runs of text between block-level tags). A fixed linear classifier gives each block log-odds
of being content from its number of words, alone and against the longest block not named as boilerplate, its share of link text, its
tag, and what the names, classes and ids of the elements around it say. These costs are the capacities to the two
terminals; smoothness edges join blocks that follow each other (the closer their elements are in the tree, the stronger)
and blocks of the same parent, weaker where only one of them lies in an element that is named as boilerplate. Maximum flow
finds the labelling of least total cost; what stays on the content side is the text. So a link alone in a paragraph stays
among the paragraphs around it, and a line of a few words goes with the menus around it, though each by itself would not.

Names count by whole words: a class or id says boilerplate if all its parts do or are neutral ("site-footer", "share-buttons"),
not if one of many does ("tag-news", "no-sidebar"). Attributes are read one by one, name and value, so that nothing in a title or in data
says anything. Inline elements that are hidden or named as boilerplate lose their text before blocks are judged, and what stands under a heading such as
"Comments" counts as named so.

The text of scripts, styles, templates, titles and comments of the markup is never a block.

A map over rows: nothing is shuffled. Defined cases: a null or empty page gives an empty text; broken markup is read as
far as it goes (an open tag closes with what holds it, an open script reaches to the end, of an svg, select or the like
without an end only the tag goes, a "<" that starts no tag is text); repeated rows give repeated rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

_ATTRS = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+"
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|title|iframe|textarea)(?=[\s/>])(?:" + _ATTRS + r">|[^>]*>).*?(?:</(?P=raw)(?:\s[^>]*)?>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9-]*)(?P<attrs>" + _ATTRS + r")>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
# Elements that are skipped with all that they hold, if they have an end.
SKIPPED = frozenset("template svg math object canvas select".split())
_CLOSED = re.compile(r"<[a-z]+(?=[\s/>])" + _ATTRS + r"(?<=/)>", re.I)  # a raw element inside such an element may be closed at once
# one attribute after the other, each with its whole name and its whole value; quoted text without a name is skipped
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
# Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What stands over readers' comments and links to other pages, with or without a number.
_HEADS_BOILERPLATE = re.compile(
    r"(?:\d+ )?(?:(?:reader |user |all |latest )?comments?|repl(?:y|ies)|responses?|leave a (?:comment|reply)|post a comment|join the (?:discussion|conversation)|discussion|"
    r"related(?: (?:articles?|posts?|stories|links|reading))?|you (?:may|might) also like|read (?:more|next)|more (?:from|in|like) .{1,40}|most (?:read|popular|shared)|popular (?:posts|articles|stories)|"
    r"share this(?: (?:article|post|story))?|follow us|advertisement|sponsored|newsletter|sign up|kommentare?|commentaires?|comentarios?)(?: ?\(\d+\)| \d+)?:?"
)
# Elements that end a block.
BLOCKS = frozenset(
    "html body article main section div nav aside header footer form ul ol dl dt dd li table thead tbody tfoot tr td th caption p h1 h2 h3 h4 h5 h6 "
    "blockquote pre figure figcaption fieldset legend dialog details summary address hr button label option menu center".split()
)
# Elements that hold boilerplate by their name (a header does outside articles).
AGAINST = frozenset("nav aside footer form menu dialog button label option fieldset legend".split())
# What the innermost element's name adds.
INNERMOST = {"p": 0.5, "h1": 0.8, "h2": 0.6, "h3": 0.6, "h4": 0.4, "blockquote": 0.5, "pre": 0.5, "li": -0.3, "td": -0.3, "th": -0.4, "dt": -0.2, "dd": 0.2, "figcaption": -0.3, "address": -1.0}
# Parts of class names, ids and roles that say boilerplate, say content, or say neither but go with others.
_PART_AGAINST = re.compile(
    r"nav|navs|navbar|navigation|menus?|footer|header|masthead|topbar|toolbar|sidebar|aside|complementary|contentinfo|ads?|advert\w*|adsense|adsbygoogle|adslot|banners?|promos?|promotion\w*|sponsor\w*|"
    r"cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|comments?|respond|disqus|repl(?:y|ies)|shares?|sharing|social|related|recommend\w*|breadcrumbs?|pager|pagination|subscri\w*|"
    r"newsletters?|login|signin|signup|search\w*|widgets?|tags?|tagcloud|taglist|copyright|legal|disclaimer|feedback|skip|skiplinks?"
)
_PART_FOR = re.compile(r"articles?|content|entry|story|posts?|main|text|prose|news")
_PART_NEUTRAL = re.compile(
    r"\d*|site|page|global|top|bottom|left|right|primary|secondary|upper|lower|mobile|desktop|user|reader|area|box|bar|section|block|group|list|lists|item|items|inner|outer|slot|unit|zone|panel|"
    r"links?|buttons?|form|icons?|message|policy|cloud|body|thread|feed|stories|title|heading|text|v|js|the|us|to|side|wrap|wrapper|container|holder|row|col|column"
)
_PART_WRAPS = re.compile(r"wrap|wrapper|container|layout")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    score: float
    path: tuple[int, ...]
    zone: int = 0  # the element named as boilerplate that it lies in, if any


@lru_cache(maxsize=100_000)
def says(name: str) -> int:
    """What a class name, id or role says: -1 for boilerplate, 1 for content, 0 for neither."""
    parts = [p.lower() for p in _PART.findall(name)]
    if _PART_AGAINST.fullmatch("".join(parts)):
        return -1
    against, for_ = (any(x.fullmatch(p) for p in parts) for x in (_PART_AGAINST, _PART_FOR))
    if against:
        known = all(x for x in (_PART_AGAINST.fullmatch(p) or _PART_NEUTRAL.fullmatch(p) or (_PART_FOR.fullmatch(p) and p != "news") for p in parts))
        return -1 if known and not (for_ and any(_PART_WRAPS.fullmatch(p) for p in parts)) else 0
    return int(for_)


def element_says(name: str, attrs: str, in_article: bool) -> int:
    """What an element says of the blocks in it: -1 for boilerplate, 1 for content, 0 for neither."""
    if name in AGAINST or (name == "header" and not in_article):
        return -1
    found = int(name in ("article", "main"))
    seen: set[str] = set()
    for m in _ATTRIBUTE.finditer(attrs) if attrs else ():
        key, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if key in seen:  # the first one of a name counts
            continue
        seen.add(key)
        if key in ("class", "id", "role"):
            each = [says(x) for x in value.split()]
            if -1 in each and not (name in ("body", "html", "article", "main") or (name == "header" and in_article)):
                return -1
            found = max([found, *each])
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value)):
            return -1
    return found


def block_score(words: int, longest: int, linked: float, tag: str, said: int) -> float:
    """The log-odds of being content of a block of so many words, in a page whose longest has so many."""
    text = min(2.5, 0.7 * math.log2(words + 1) - 1.8)
    return text + min(1.0, words / longest) - 3.0 * linked + INNERMOST.get(tag, 0.0) + (-5.0 if said < 0 else 0.3 * said)


def skipped_spans(page: str) -> dict[int, int]:
    """Start and end of each skipped element that is closed; elements of one name may hold each other."""
    spans: dict[int, int] = {}
    starts: dict[str, list[int]] = {name: [] for name in SKIPPED}
    at = 0
    while m := _MARKUP.search(page, at):
        at = m.end()
        if m["raw"] and (closed := _CLOSED.match(page, m.start())):
            at = closed.end()
        name = (m["name"] or "").lower()
        if name in SKIPPED:
            if m["close"]:
                if starts[name]:
                    spans[starts[name].pop()] = m.end()
            elif not m["attrs"].endswith("/"):
                starts[name].append(m.start())
    return spans


def page_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # name, what it says, its number, the number of what says boilerplate
    found: list[tuple[str, int, float, str, int, tuple[int, ...], int]] = []
    pieces: list[str] = []
    linked, links, count, articles = 0, 0, 0, 0
    skip: list | None = None  # an inline element named as boilerplate: its name, how many of that name are open, the depth it stands in

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                name, said, _, zone = stack[-1]
                found.append((text, text.count(" ") + 1, min(1.0, linked / len(text)), name, said, tuple(e[2] for e in stack), zone))
            pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if skip and len(stack) == skip[2]:
            return
        pieces.append(text)
        if links:
            linked += len(text.strip())

    at, spans = 0, None
    while m := _MARKUP.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            if m["raw"] and m["raw"].lower() in ("textarea", "iframe"):
                pieces.append(" ")
            continue
        name, closing = name.lower(), bool(m["close"])
        if name not in BLOCKS and name not in SKIPPED and name not in VOID and not m["attrs"].endswith("/"):
            if skip and name == skip[0]:
                skip[1] += -1 if closing else 1
                skip = skip if skip[1] else None
            elif not skip and not closing and m["attrs"] and element_says(name, m["attrs"], False) < 0:
                skip = [name, 1, len(stack)]
        if name in SKIPPED:
            if not closing:
                spans = skipped_spans(page) if spans is None else spans
                at = spans.get(m.start(), at)
            if name != "template":
                pieces.append(" ")
        elif name == "a":
            links = max(0, links - 1) if closing else links + 1
        elif name == "br":
            pieces.append(" ")
        elif name in BLOCKS:
            end_block()
            if closing:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
                if depth:
                    articles -= sum(e[0] in ("article", "main") for e in stack[depth:])
                    del stack[depth:]
                    skip = skip if skip and len(stack) >= skip[2] else None
            elif name != "hr":
                links = 0
                while len(stack) > 1 and (stack[-1][0] == "p" or re.fullmatch("h[1-6]", stack[-1][0]) or (stack[-1][0] == name and name in ("li", "td", "th", "tr", "dt", "dd", "option"))):
                    stack.pop()
                skip = skip if skip and len(stack) >= skip[2] else None
                count += 1
                said = -1 if skip else element_says(name, m["attrs"], articles > 0)
                zone = stack[-1][3] or (count if said < 0 else 0)
                stack.append((name, -1 if zone else max(said, stack[-1][1]), count, zone))
                articles += name in ("article", "main")
    if at < len(page):
        add(page[at:])
    end_block()
    found = under_headings(found)
    longest = max((x[1] for x in found if x[4] >= 0), default=1)  # of what is not named as boilerplate
    return [Block(text, block_score(words, longest, linked, name, said), path, zone) for text, words, linked, name, said, path, zone in found]


def under_headings(found: list[tuple[str, int, float, str, int, tuple[int, ...], int]]) -> list[tuple[str, int, float, str, int, tuple[int, ...], int]]:
    """The blocks, those under a heading that says boilerplate marked as such: to the next heading of its rank or the end of what holds it."""
    out, holder, rank, zone = [], None, "", 0
    for text, words, linked, tag, said, path, own in found:
        heading = re.fullmatch("h[1-6]", tag) is not None
        if holder is not None and (path[: len(holder)] != holder or (heading and tag <= rank and path[:-1] == holder)):
            holder = None
        if heading and holder is None and _HEADS_BOILERPLATE.fullmatch(text.lower()):
            holder, rank, zone = path[:-1], tag, own or path[-1]
        out.append((text, words, linked, tag, said, path, own) if holder is None else (text, words, linked, tag, -1, path, own or zone))
    return out


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges (i, j, weight) by adjacency and by nearness in the tree."""
    edges = []
    last: dict[int, int] = {}
    held = lambda i, j, weight: (i, j, weight if blocks[i].zone == blocks[j].zone else 0.25 * weight)
    for j, b in enumerate(blocks):
        if j:
            a = blocks[j - 1].path
            common = next((k for k, (x, y) in enumerate(zip(a, b.path, strict=False)) if x != y), min(len(a), len(b.path)))
            edges.append(held(j - 1, j, 2.4 / (1 + 0.5 * (len(a) + len(b.path) - 2 * common))))
        parent = b.path[-2] if len(b.path) > 1 else 0
        if parent in last and last[parent] != j - 1:
            edges.append(held(last[parent], j, 0.4))
        last[parent] = j
    return edges


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: log-odds are terminal capacities, edges cost their weight where labels differ.

    Maximum flow by blocking flows along shortest paths; afterwards the source side is what residual capacity reaches.
    """
    n = len(scores)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            join(source, i, s, 0.0)
        elif s < 0:
            join(i, sink, -s, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif path:
                level[a] = -1
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def main_text(page: str) -> str:
    """The content blocks of a page, joined by newlines."""
    blocks = page_blocks(page)
    if not blocks:
        return ""
    kept = min_cut([b.score for b in blocks], smoothness(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def _extract(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            texts = [main_text(page or "") for page in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
