"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into blocks of text, each with its place in the element tree. A block's costs of
being called content or boilerplate, from a small logistic classifier, are the capacities to the
two terminals. Blocks that follow one another, and blocks that follow one another under the same
parent, are joined by smoothness edges, the stronger the nearer they are in the tree. The classifier
is fitted to blocks whose place in the page says what they are (`fitted`); its costs are bounded, so
that edges and places weigh as much as they do. The labels
of least total cost are a minimum cut: blocks whose costs outweigh all their edges are settled
first, which is exact, and maximum flow separates the rest.

Pages are handled inside their rows; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict, deque
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscan.llm.tables import arrow_rows, whole

#: The same without quotes, for tags whose quotes are never closed.
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: Tags with quotes open to the end of the page that are looked for; from there on quotes are not read.
UNCLOSED = 16
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>""")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][^\s=/>"']*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Element names of HTML.
#: Their text is never shown or never prose.
HIDDEN = {"head", "script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select", "option", "textarea", "button", "datalist"}
#: Their content is not markup: it ends at their own closing tag only.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "html", "body", "head", "title", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "legend", "li", "main",
    "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "ul",
}
#: Opening one of these closes an open element of the given kinds, up to the nearest of the holders.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "body": ({"head"}, {"html"}),
}

#: Log-odds of content that an element gives to all in it.
ELEMENTS = {"nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "menu": -8.0, "dialog": -8.0, "search": -8.0, "header": -8.0, "address": -2.0, "fieldset": -4.0}
#: The same for roles.
ROLES = {"navigation": -8.0, "banner": -8.0, "contentinfo": -8.0, "complementary": -8.0, "search": -8.0, "menu": -8.0, "menubar": -8.0, "alert": -8.0, "dialog": -8.0, "alertdialog": -8.0, "form": -8.0, "toolbar": -8.0}
#: Words of class and id that name boilerplate wherever they stand.
NAMES = {
    "ad", "ads", "adv", "advert", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist",
    "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promoted", "replies", "sharing", "sidebar",
    "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
#: Words that may as well name a part of the article: inside it the block's own features decide.
DOUBTFUL = {"dialog", "disclaimer", "discussion", "form", "promotion", "recommended", "related", "reply", "search", "share", "tracking", "warning"}
HEADS = {"header", "masthead"}
NAMED = -8.0
#: Elements that hold the content: what was against it outside no longer counts.
MAIN, MAIN_ODDS = {"article", "main"}, 4.0
#: The classifier: weights of a block's own features before anything is fitted (`features`): always one, length, share
#: of links, ends like a sentence, heading, list item, paragraph or bare text.
WEIGHTS = (-1.2, 0.5, -4.0, 1.0, 0.6, -0.5, 0.4)
LINKS, LINKS_INSIDE = 2, -1.0  # inside the content a link says little
#: A block's own features never outweigh its standing in the main part.
BOUND = 3.5
#: How far fitted weights are held to the ones above, and what a fit reads at most.
HOLD, SAMPLE_PAGES, SAMPLE_CHARS, SAMPLE_BLOCKS = 0.1, 1_000, 200_000, 300
#: Smoothness: of neighbours in page order, and of followers under one parent.
NEXT, SIBLING = 1.0, 1.0


@dataclass(slots=True)
class Element:
    tag: str
    odds: float
    hidden: bool
    main: bool
    doubtful: bool
    number: int
    depth: int
    parent: Element | None


@dataclass(slots=True)
class Block:
    home: Element
    text: str
    linked: int
    odds: float = 0.0
    edges: dict[int, float] = field(default_factory=dict)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def _element(tag: str, raw: str, parent: Element, number: int) -> Element:
    odds, main, hidden, outside, doubtful = parent.odds, parent.main, parent.hidden or tag in HIDDEN, not parent.main, parent.doubtful
    if tag in MAIN:
        # Inside a nested article, such as a reader's comment, what speaks against it still counts.
        odds, main = (odds if main else max(odds, 0.0) + MAIN_ODDS), True
    elif tag != "header" or not main:
        odds += ELEMENTS.get(tag, 0.0)
    if raw.strip(" /\t\n\r\f"):
        given = _attributes(raw)
        odds += ROLES.get(given.get("role", "").lower(), 0.0)
        if given.get("role", "").lower() == "main" and not main:
            odds, main = max(odds, 0.0) + MAIN_ODDS, True
        hidden = hidden or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        names = {w.lower() for w in WORDS.findall(given.get("class", "") + " " + given.get("id", ""))}
        if not outside:
            names -= HEADS  # the head of an article is part of it
        if names & NAMES and tag not in ("html", "body") and (tag not in MAIN or not outside):
            odds += NAMED
        elif names & DOUBTFUL and tag not in ("html", "body") and (tag not in MAIN or not outside):
            odds, doubtful = odds + (NAMED if outside else -MAIN_ODDS), True
    return Element(tag, odds, hidden, main, doubtful, number, parent.depth + 1, parent)


def blocks(html: str) -> list[Block]:
    """The shown blocks of text in page order, in time that grows with the page's length."""
    here = root = Element("", 0.0, False, False, False, 0, 0, None)
    opened: defaultdict[str, list[Element]] = defaultdict(list)  # open elements by tag, the innermost last
    last_end, unclosed = html.rfind(">"), 0
    out: list[Block] = []
    texts: list[str] = []
    linked, in_link, number, at, end = 0, False, 0, 0, len(html)

    def close() -> None:
        nonlocal linked, texts
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                out.append(Block(here, text, min(linked, len(text))))
            texts, linked = [], 0

    def leave(outer: Element) -> None:
        """Closes what is open, up to and including the given element."""
        nonlocal here
        while True:
            left, here = here, here.parent
            opened[left.tag].pop()
            if left is outer:
                return

    while at < end:
        open_at = html.find("<", at)
        if open_at != at:
            stop = end if open_at < 0 else open_at
            if not here.hidden:
                text = html[at:stop]
                text = unescape(text) if "&" in text else text
                texts.append(text)
                if in_link:
                    linked += len(text.strip())
            at = stop
            continue
        if html.startswith("<!--", at):
            done = COMMENT_END.search(html, at + 4)
            at = done.end() if done else end
            continue
        if html.startswith(("<!", "<?"), at):
            done = html.find(">", at)
            at = done + 1 if done >= 0 else end
            continue
        found = None
        if at < last_end:
            found = TAG.match(html, at) if unclosed < UNCLOSED else None
            if not found and html[at + 1 : at + 3].lstrip("/")[:1].isalpha():
                unclosed += 1
                found = LOOSE_TAG.match(html, at)
        if not found:
            if not here.hidden:
                texts.append("<")
            at += 1
            continue
        at = found.end()
        closing, tag = found[1], found[2].lower()
        if tag not in BLOCK and tag not in HIDDEN and tag not in RAW:
            if tag == "br":
                texts.append(" ")
            elif tag == "a":
                in_link = not closing
            continue
        if closing:
            close()
            if opened[tag]:
                leave(opened[tag][-1])
            in_link = in_link and tag not in BLOCK
            continue
        if tag in BLOCK or tag in HIDDEN or tag in RAW:
            close()
        if tag == "hr" or tag in VOID:
            continue
        if tag in BLOCK and here.tag == "p":
            leave(here)
        kinds, holders = CLOSES.get(tag, ((), ()))
        if kinds:
            held = max((opened[h][-1].depth for h in holders if opened[h]), default=0)
            while any(opened[k] and opened[k][-1].depth > held for k in kinds):
                leave(max((opened[k][-1] for k in kinds if opened[k]), key=lambda e: e.depth))
        number += 1
        inner = _element(tag, found[3], here, number)
        if tag in RAW and not found[3].endswith("/"):
            done = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(html, at)
            if done is None:
                at = end
            else:
                stop = html.find(">", done.start())
                at = stop + 1 if stop >= 0 else end
            continue
        here = inner
        opened[tag].append(inner)
    close()
    return out


def _hops(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def features(block: Block) -> tuple[float, ...]:
    """What a block says by itself, whatever its place: the inputs of the classifier."""
    tag, size = block.home.tag, len(block.text)
    heading = tag[:1] == "h" and tag[1:].isdigit()
    return (
        1.0, math.log2(1 + size / 20), block.linked / size, float(block.text[-1] in ".!?…\"'”»。"), float(heading), float(tag == "li"),
        float(tag in ("", "body", "p")),
    )


def _own(block: Block, weights: tuple[float, ...]) -> float:
    """The classifier's log-odds, within the bound."""
    inside = block.home.main and not block.home.doubtful
    given = (*weights[:LINKS], LINKS_INSIDE if inside else weights[LINKS], *weights[LINKS + 1 :])
    return max(-BOUND, min(BOUND, sum(w * x for w, x in zip(given, features(block), strict=True))))


def _weigh(found: list[Block], weights: tuple[float, ...] = WEIGHTS) -> None:
    """Log-odds of content and smoothness edges."""
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        home = block.home
        block.odds = home.odds + _own(block, weights)
        parent = (home.parent or home).number
        joins = [(i - 1, NEXT)] if i else []
        if parent in last:
            joins.append((last[parent], SIBLING))
        last[parent] = i
        for other, weight in joins:
            weight /= 1 + _hops(found[other].home, home)
            block.edges[other] = block.edges.get(other, 0.0) + weight
            found[other].edges[i] = found[other].edges.get(i, 0.0) + weight


def labels(found: list[Block], weights: tuple[float, ...] = WEIGHTS) -> list[bool]:
    """True for content: the labels of a minimum cut."""
    _weigh(found, weights)
    odds = [b.odds for b in found]
    edges = [dict(b.edges) for b in found]
    out: list[bool | None] = [None] * len(found)
    waiting = deque(range(len(found)))
    while waiting:
        i = waiting.popleft()
        if out[i] is None and abs(odds[i]) >= sum(edges[i].values()):
            out[i] = odds[i] > 0
            for j, weight in edges[i].items():
                odds[j] += weight if out[i] else -weight
                del edges[j][i]
                waiting.append(j)
            edges[i] = {}
    left = [i for i, x in enumerate(out) if x is None]
    if left:
        for i, label in zip(left, _cut(left, odds, edges), strict=True):
            out[i] = label
    return out


def _cut(nodes: list[int], odds: list[float], edges: list[dict[int, float]]) -> list[bool]:
    """Which nodes stay with the source (content) in a minimum cut: maximum flow by blocking flows."""
    place = {n: k for k, n in enumerate(nodes)}
    source, sink = len(nodes), len(nodes) + 1
    graph: list[list[list]] = [[] for _ in range(sink + 1)]  # arcs: [to, capacity, place of the arc back]

    def join(a: int, b: int, there: float, back: float) -> None:
        graph[a].append([b, there, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for n, k in place.items():
        if odds[n] > 0:
            join(source, k, odds[n], 0.0)
        elif odds[n] < 0:
            join(k, sink, -odds[n], 0.0)
        for other, weight in edges[n].items():
            if other > n:
                join(k, place[other], weight, weight)
    least = 1e-9
    while True:
        level = [-1] * len(graph)
        level[source] = 0
        line = deque([source])
        while line:
            a = line.popleft()
            for b, room, _ in graph[a]:
                if room > least and level[b] < 0:
                    level[b] = level[a] + 1
                    line.append(b)
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(len(nodes))]
        used = [0] * len(graph)
        path: list[list] = []
        at = source
        while True:
            if at == sink:
                flow = min(arc[1] for arc in path)
                for arc in path:
                    arc[1] -= flow
                    graph[arc[0]][arc[2]][1] += flow
                path, at = [], source
                continue
            while used[at] < len(graph[at]):
                arc = graph[at][used[at]]
                if arc[1] > least and level[arc[0]] == level[at] + 1:
                    break
                used[at] += 1
            if used[at] < len(graph[at]):
                path.append(arc)
                at = arc[0]
            elif path:
                level[at] = -2
                back = path.pop()
                at = graph[back[0]][back[2]][0]
            else:
                break


def main_text(html: str, weights: tuple[float, ...] = WEIGHTS) -> tuple[str, int, int, int]:
    """The text of the blocks labelled content, how many blocks there were, how many stay, and how many the edges relabelled."""
    found = blocks(html)
    content = labels(found, weights)
    kept = [b.text for b, c in zip(found, content, strict=True) if c]
    return "\n\n".join(kept), len(found), len(kept), sum((b.odds > 0) != c for b, c in zip(found, content, strict=True))


def _placed(html: str) -> list[tuple[float, ...]]:
    """Features and label of blocks whose place says what they are: the main part, or what no article holds."""
    told = [(b, b.home.odds) for b in blocks(html)]
    rows = [(*features(b), float(odds > 0)) for b, odds in told if odds >= MAIN_ODDS or odds <= -MAIN_ODDS]
    return rows[:: max(1, -(-len(rows) // SAMPLE_BLOCKS))]


def fit(rows: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic regression, held to WEIGHTS; both labels count alike. Without rows of both labels: WEIGHTS."""
    start = np.array(WEIGHTS)
    if len(rows) == 0 or len(set(rows[:, -1])) < 2:
        return WEIGHTS
    x, y = rows[:, :-1], rows[:, -1]
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w = start.copy()
    for _ in range(25):
        odds = np.clip(x @ w, -30, 30)
        says = 1 / (1 + np.exp(-odds))
        slope = x.T @ (share * (says - y)) + HOLD * (w - start)
        bend = (x * (share * says * (1 - says))[:, None]).T @ x + HOLD * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return tuple(float(v) for v in w)


def fitted(df: DataFrame, html_col: str = "html") -> tuple[float, ...]:
    """The classifier's weights from at most 1,000 pages of up to 200,000 characters, those of the lowest hashes.

    Labels come from the places of blocks alone (articles against menus, footers, named adverts), up
    to about 300 blocks of a page. Null and empty pages teach nothing; equal pages count once;
    without blocks of both kinds the weights are WEIGHTS. Seven numbers reach the driver
    for each block of the sample.
    """
    html = df.select(F.col(html_col).alias("html")).filter(F.length("html").between(1, SAMPLE_CHARS))
    pages = html.select("html", F.xxhash64("html").alias("h"))
    lowest = [r["h"] for r in pages.select("h").distinct().orderBy("h").limit(SAMPLE_PAGES).collect()]
    if not lowest:
        return WEIGHTS
    # Only the sample's texts are moved, one of each set of equal ones out of every partition.
    sample = pages.filter(F.col("h") <= lowest[-1]).groupBy("h").agg(F.min("html").alias("html")).select("html")

    def run(batches):
        for batch in batches:
            rows = [r for x in batch.column("html") for r in _placed(x.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64()))], ["row"])

    got = sorted(tuple(r["row"]) for r in sample.mapInArrow(run, "row array<double>").collect())
    return fit(np.array(got, dtype=float).reshape(len(got), len(WEIGHTS) + 1))


def extracted(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept, n_relabelled per input row.

    text is the blocks of the main text in page order, white space inside a block as one space,
    character references decoded, blocks joined by an empty line; empty if there is none.
    n_relabelled counts the blocks whose label the edges changed. Null and empty pages have no
    blocks. Pages are read whole, however long; repeated rows give repeated results, no rows none.
    Only the three named columns are read. weights: what `fitted` gives.
    """
    arrow_rows(df.sparkSession, 300)
    source = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), whole(html_col).alias("html"))

    def run(batches):
        for batch in batches:
            found = [main_text(x.as_py(), weights) for x in batch.column("html")]
            texts = [f[0] for f in found]
            columns = [
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                *[pa.array([f[i] for f in found], pa.int64()) for i in (1, 2, 3)],
            ]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept", "n_relabelled"])

    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint, n_blocks bigint, n_kept bigint, n_relabelled bigint")
