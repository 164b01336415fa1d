"""Main text of web pages: blocks labelled by a minimum cut.

A page is cut into blocks, runs of text between block-level tags. A classifier gives each a cost of being content and one of being
boilerplate: marks of the tree around it (elements that say what they are, words in class, id and role) and, where these leave it
open, a logistic score of the block itself. Costs are capacities to two terminals. Neighbours in page order are joined by smoothness
edges, stronger inside one container; every container is a node without costs of its own, joined to its blocks and to the container
around it, so blocks that are close in the tree draw each other. The minimum cut, by maximum flow, labels the blocks.

Before flow is sent, a node whose cost outweighs all its edges is labelled (no minimum cut does otherwise) and its edges become costs
of its neighbours; that goes on until nothing is decided. Most pages end there; the rest is augmented along shortest paths.

The score's weights are learned from pages whose markup labels their blocks, of a bounded sample; it counts for ``TEXT_MOST`` at most,
less than a mark does, so that no block of an article is dropped for being short. Too few labelled blocks leave weights of zero.

Not text at all: scripts, styles, titles, controls, hidden elements, comments in markup. Character references are decoded, white space
inside a block is one space, ``<br>`` too, and blocks are joined by line feeds. Null and empty html give an empty text. A page is read
whole, however long, in time that follows its length; each row is labelled by itself, so repeated rows, pages of one host and columns
of any name need nothing. Tags left open, unknown tags and broken markup give the tree that can be read off them.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, sampled

#: Elements of HTML that stand for themselves, by what they are.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style title noscript template svg canvas iframe object audio video map button select option textarea datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that the next of their kind closes.
ALIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
CONTENT_TAGS, OTHER_TAGS = frozenset(["article", "main"]), frozenset("nav footer aside form menu dialog search fieldset".split())
#: Words in class, id and role that name what is not, or what is, the article.
OTHER_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager header masthead footer sidebar side aside rail widget widgets ad ads adbox advert adverts advertisement banner promo sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus toolbar search copyright legal disclaimer skip complementary contentinfo dialog form".split()
)
CONTENT_WORDS = frozenset("article articlebody main content post entry story text body".split())
#: Of these words an element may hold the heading and still be what they say.
OWN = frozenset("comment comments commentlist reply replies respond disqus".split())
WORD = re.compile(r"[a-z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Costs, in sixteenths: of marks, the most of a score, and of the edges.
UNIT = 16
MARKED_OTHER, MARKED_CONTENT, NAMED_CONTENT, HEADING, TEXT_MOST = -8, 4, 2, 0.5, 2
NEXT, NEXT_ELSEWHERE, INSIDE, AROUND = 1.0, 0.25, 0.5, 0.25
#: Pages that weights are learned from, and labelled blocks of each kind that must be there.
SAMPLE_PAGES, LEAST_BLOCKS = 2000, 50


class Page(HTMLParser):
    """Containers (parent, own mark, heading or main part inside) and blocks (container, text, linked characters, heading)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.named, self.dropped, self.holds = [0], [""], [0], [False], [False]
        self.stack, self.inside, self.open, self.blocks = [("", 0)], [0], Counter(), []  # inside: the containers of the stack
        self.text, self.links, self.in_link = [], 0, 0
        self.feed(html)
        self.close()
        self.end_block()

    def updatepos(self, i, j):
        return j  # lines are not counted

    def end_block(self):
        if self.text and (t := " ".join("".join(self.text).split())):
            node = self.inside[-1]
            self.blocks.append((node, t, min(len(t), self.links), self.tag[node] in ("h1", "h2", "h3", "h4", "h5", "h6")))
        self.text, self.links = [], 0

    def pop_to(self, tags: tuple[str, ...], within: tuple[str, ...] = ()):
        """Closes the innermost element of these tags, unless one of ``within`` is nearer."""
        if not self.open[tags[0]] and not (len(tags) > 1 and self.open[tags[1]]):
            return
        at = len(self.stack) - 1
        while at and self.stack[at][0] not in tags:
            if self.stack[at][0] in within:
                return
            at -= 1
        if at:
            for t, node in self.stack[at:]:
                self.open[t] -= 1
                self.in_link -= t == "a"
            if inner := sum(node is not None for _, node in self.stack[at:]):
                self.end_block()
                del self.inside[-inner:]
            del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag == "hr":
                self.end_block()
            return
        has = dict(attrs)
        words = {w for a in ("class", "id", "role") for w in WORD.findall((has.get(a) or "").lower())} if has else set()
        block, dropped = tag in BLOCKS, tag in NO_TEXT or "hidden" in has or has.get("aria-hidden") == "true" or bool(HIDDEN.search(has.get("style") or ""))
        if block:
            self.pop_to(("p",), ("table", "button"))
            if tag in ALIKE:
                self.pop_to(ALIKE[tag], ("ul", "ol", "dl", "table"))
        node = None
        if block or dropped:
            self.end_block()
            node, up = len(self.parent), self.inside[-1]
            self.inside.append(node)
            named = 0 if tag in ("body", "html") else (2 if words & OWN else 1) * -bool(words & OTHER_WORDS) or bool(words & CONTENT_WORDS)
            for column, value in ((self.parent, up), (self.tag, tag), (self.named, named), (self.dropped, dropped or self.dropped[up]), (self.holds, tag in ("h1", "main"))):
                column.append(value)
        self.stack.append((tag, node))
        self.open[tag] += 1
        self.in_link += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and tag != "a":  # the slash means nothing on others
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.pop_to((tag,))

    def handle_data(self, data):
        if not self.dropped[self.inside[-1]]:
            self.text.append(data)
            if self.in_link > 0:
                self.links += len(" ".join(data.split()))

    def marks(self) -> list[float]:
        """What each container is by itself and by those around it: boilerplate outweighs, a nearer name of content does not undo it."""
        for k in range(len(self.parent) - 1, 0, -1):
            self.holds[self.parent[k]] |= self.holds[k]
        out = [0.0]
        for k in range(1, len(self.parent)):
            up, tag = out[self.parent[k]], self.tag[k]
            other = tag in OTHER_TAGS and not self.holds[k] or tag == "header" and up <= 0 and not self.holds[k] or self.named[k] == -2 or self.named[k] == -1 and not self.holds[k]
            if other or up < 0:
                out.append(MARKED_OTHER)
            else:
                out.append(max(up, MARKED_CONTENT if tag in CONTENT_TAGS else NAMED_CONTENT if self.named[k] > 0 else 0))
        return out


def features(text: str, links: int, heading: bool) -> list[float]:
    n, words = len(text), text.count(" ") + 1
    stops = sum(map(text.count, ".!?。！？"))
    return [1.0, np.log1p(words), links / n, float(text[-1] in ".!?…。！？\"'”»"), min(1.0, stops / words), sum(map(text.count, "©®|·»›→")) > 0, float(heading)]


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression, both kinds weighing the same, by Newton's method."""
    weights = np.zeros(x.shape[1])
    if min((y == 1).sum(), (y == 0).sum()) < LEAST_BLOCKS:
        return weights
    each = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = (x * (each * p * (1 - p))[:, None]).T @ x + np.eye(len(weights))
        weights = weights + np.linalg.solve(curve, x.T @ (each * (y - p)) - weights)
    return weights


def augmented(cost: dict[int, int], edges: dict[int, dict[int, int]]) -> set[int]:
    """The nodes on the content side of a minimum cut, by blocking flows along shortest paths (-1: content, -2: boilerplate)."""
    left: dict[int, dict[int, int]] = {-1: {}, -2: {}}
    for u, c in cost.items():
        left[u] = dict(edges[u])
        left[-1][u], left[u][-1] = max(0, c), 0
        left[u][-2], left[-2][u] = max(0, -c), 0
    while True:
        level, queue = {-1: 0}, deque([-1])
        while queue:
            u = queue.popleft()
            for v, room in left[u].items():
                if room > 0 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if -2 not in level:
            return {u for u in level if u >= 0}
        rest, path = {u: list(left[u]) for u in level}, [-1]
        while path:
            u = path[-1]
            if u == -2:
                steps = list(zip(path, path[1:]))
                flow = min(left[a][b] for a, b in steps)
                for a, b in steps:
                    left[a][b] -= flow
                    left[b][a] += flow
                path = path[: 1 + next(i for i, (a, b) in enumerate(steps) if left[a][b] == 0)]
            elif rest[u]:
                v = rest[u][-1]
                if left[u][v] > 0 and level.get(v) == level[u] + 1:
                    path.append(v)
                else:
                    rest[u].pop()
            else:
                path.pop()
                if path:
                    rest[path[-1]].pop()


def minimum_cut(cost: list[int], edges: dict[int, dict[int, int]]) -> list[bool]:
    """cost: of a node's being boilerplate, less that of its being content. edges: symmetric weights, used up. True: content."""
    total = {u: sum(edges[u].values()) for u in edges}
    label, cost, waiting = {}, dict(enumerate(cost)), deque(edges)
    while waiting:
        u = waiting.popleft()
        if u in label or abs(cost[u]) < total[u]:
            continue
        label[u] = cost[u] > 0
        for v, w in edges[u].items():
            del edges[v][u]
            total[v] -= w
            cost[v] += w if label[u] else -w
            waiting.append(v)
    rest = {u: c for u, c in cost.items() if u not in label}
    content = augmented(rest, {u: edges[u] for u in rest}) if rest else set()
    return [label.get(u, u in content) for u in range(len(cost))]


def labelled(page: Page, weights: np.ndarray) -> list[bool]:
    """Which blocks are content."""
    if not page.blocks:
        return []
    marks, n = page.marks(), len(page.blocks)
    scores = np.clip(np.array([features(t, k, h) for _, t, k, h in page.blocks]) @ weights, -TEXT_MOST, TEXT_MOST)
    cost = [round(UNIT * (marks[node] + s + HEADING * h)) for (node, _, _, h), s in zip(page.blocks, scores)] + [0] * len(page.parent)
    edges: dict[int, dict[int, int]] = {u: {} for u in range(len(cost))}

    def join(u, v, weight):
        edges[u][v] = edges[v][u] = edges[u].get(v, 0) + round(UNIT * weight)

    for i, (node, *_) in enumerate(page.blocks):
        join(i, n + node, INSIDE)
        if i:
            last = page.blocks[i - 1][0]
            join(i, i - 1, NEXT if page.parent[last] == page.parent[node] or last == node else NEXT_ELSEWHERE)
    for k in range(1, len(page.parent)):
        join(n + k, n + page.parent[k], AROUND)
    return minimum_cut(cost, edges)[:n]


def main_text(html: str | None, weights: np.ndarray) -> str:
    page = Page(html or "")
    return "\n".join(b[1] for b, yes in zip(page.blocks, labelled(page, weights)) if yes)


def fit(pages: DataFrame, *, key: str = "page_id", html: str = "html", sample: int = SAMPLE_PAGES) -> np.ndarray:
    """Weights of the score, from blocks that markup labels, of about ``sample`` pages, by a hash of them."""
    bounded_batches(pages.sparkSession)

    def blocks(stream):
        for batch in stream:
            for t in batch.column(0).to_pylist():
                page = Page(t)
                marks = page.marks()
                # as many as tell something of a page, spread over it
                known = [(marks[b[0]] > 0, features(*b[1:])) for b in page.blocks if marks[b[0]] < 0 or marks[b[0]] >= MARKED_CONTENT]
                known = known[:: 1 + len(known) // 100]
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in known], pa.bool_()), pa.array([x for _, x in known], pa.list_(pa.float64()))], names=["y", "x"])

    few = sampled(pages, sample, pages.count(), key, html).where(F.col(html).isNotNull()).select(F.col(html).alias("html"))
    rows = few.mapInArrow(blocks, "y boolean, x array<double>").toArrow()  # some 100 blocks a page at most
    width = len(features("x", 0, False))
    order = sorted(zip(rows["x"].to_pylist(), rows["y"].to_pylist()))
    return fitted(np.array([x for x, _ in order]).reshape(-1, width), np.array([y for _, y in order], float))


def extract(pages: DataFrame, weights: np.ndarray, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars, its code points, of each page."""
    bounded_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)

    def batches(stream):
        for batch in stream:
            texts = [main_text(t, weights) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, url, "text", "n_chars"])

    return pages.select(key, url, html).mapInArrow(batches, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars bigint")
