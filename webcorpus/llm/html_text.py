"""Main text of HTML pages by a minimum cut over their blocks.

A page is cut into blocks of text. A classifier gives each block a log-odds of being content: the
evidence of its containers plus a logistic model of its shape, trained on blocks whose semantic
container says what they are. The log-odds are terminal capacities; neighbouring blocks and blocks
of one parent are tied by smoothness edges, stronger the closer they are in the tree. The maximum
flow gives the labelling of least cost, and the blocks on the content side are the text.
"""

from __future__ import annotations

import math
import re
import sys
from collections import defaultdict, deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.common import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 2_000  # pages whose blocks train the shape model, about
EVIDENCE = 4.0  # log-odds that a telling container gives
SOFT = 2.0  # log-odds that a class or id costs; shape and edges may outweigh them
ADVERT = 3.0  # the same for a name that says nothing but advert or consent; shape and neighbours on both sides may
MOST = 0.6  # share of a page's text from which a form or a named element is a wrapper that tells nothing
SHAPE = 1.5  # most log-odds that the shape of a block gives
ADJACENT = 0.7  # smoothness of neighbours with the same parent
KIN = 0.4  # smoothness of consecutive blocks of one parent
SHAPES = ("bias", "log_words", "link_share", "ends", "heading", "item", "word_length")
PRIOR = (-0.6, 0.6, -3.0, 0.8, 0.3, -0.6, 0.0)  # shape weights where no page teaches any

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg annotation annotation-xml".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section"
    " select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - frozenset("br body html head button option optgroup".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select menu div section article body".split())

# Containers that tell, by tag, role, or a word of the class or id.
CONTENT_TAGS = frozenset("article main".split())
REST_TAGS = frozenset("nav footer aside form menu dialog button select fieldset".split())
CONTENT_ROLES = frozenset("main article".split())
REST_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CONTENT_WORDS = frozenset("article content entry main post story".split())
REST_WORDS = frozenset(
    "ad ads adsbygoogle advert advertisement advertising adverts alert banner breadcrumb breadcrumbs byline colophon comment"
    " comments consent cookie cookies copyright dialog discussion disqus footer footnav form gdpr legal login masthead menu modal"
    " nav navbar navigation navigations newsletter notice notices notification pager pagination paywall popup privacy promo"
    " promoted promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip social"
    " sponsor sponsored subscribe subscription teaser toolbar topbar trending widget widgets".split()
)

ADVERT_WORDS = frozenset("ad ads adsbygoogle advert advertisement advertising adverts consent cookie cookies gdpr".split())

HEAD = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/<>]*))")
TURN = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
STATES = frozenset("has with no without is".split())
TOPICS = frozenset("category cat tag topic taxonomy type format status".split())
SETTINGS = frozenset("open closed enabled disabled on off active allowed".split())


def _telling(value: str) -> tuple[float, bool, bool]:
    """What class names or ids say: the cost of boilerplate words, header words, content words.

    Names of states and topics, such as has-sidebar, comments-open and category-privacy, tell nothing.
    A boilerplate word within another name costs half, and nothing beside a name for content.
    """
    cost, header, likely = 0.0, False, False
    for name in value.split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        if not parts or parts[0] in STATES or (len(parts) > 1 and (parts[0] in TOPICS or parts[-1] in SETTINGS)):
            continue
        if any(p in REST_WORDS for p in parts):
            whole = ADVERT if any(p in ADVERT_WORDS for p in parts) else SOFT
            cost = max(cost, whole if all(p in REST_WORDS for p in parts) else SOFT / 2)
        elif "header" in parts:
            header = True
        elif any(p in CONTENT_WORDS for p in parts):
            likely = True
    return (0.0 if likely and cost < SOFT else cost), header, likely


_KNOWN: dict[tuple[str, str], tuple[str, float] | None] = {}


def effect_of(tag: str, attributes: str) -> tuple[str, float] | None:
    """What an element says about the text in it, and the cost of its names; remembered in each worker."""
    key = (tag, attributes)
    if key not in _KNOWN:
        if len(_KNOWN) >= 4096:
            _KNOWN.clear()
        _KNOWN[key] = _effect_of(tag, attributes)
    return _KNOWN[key]


def _effect_of(tag: str, attributes: str) -> tuple[str, float] | None:
    names, role, hidden = [], "", False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape(values[0] or values[1] or values[2])
        if name in ("class", "id"):
            names.append(value)
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
    if hidden:
        return "hidden", 0.0
    cost, header, likely = _telling(" ".join(names)) if tag not in ("body", "html") else (0.0, False, False)
    if role in CONTENT_ROLES:
        return role, cost if cost >= SOFT else 0.0
    if tag in ("form", "fieldset") or role == "form":
        return "form", 0.0
    if role in REST_ROLES or tag in REST_TAGS:
        return "rest", 0.0
    if tag in CONTENT_TAGS:
        return tag, cost if cost >= SOFT else 0.0
    if cost:
        return "named", cost
    if tag == "header" or header:
        return "header", EVIDENCE if tag == "header" else SOFT
    return ("likely", 0.0) if likely else None


def evidence_of(effects: list[tuple[int, str, float]], texts: list[int]) -> list[float]:
    """Log-odds of content for what each telling element holds.

    ``effects`` has (the telling element around it, kind, cost) in order, the first stands for the
    page; ``texts`` has the text directly in each. What lies in boilerplate stays boilerplate, but
    main, and article where no article or main lies outside of boilerplate, start anew. A form or a
    named element around most of the text and all articles tells nothing. A header counts as
    boilerplate outside of content only.
    """
    held, articles = list(texts), [int(kind in CONTENT_TAGS) for _, kind, _ in effects]
    for k in range(len(effects) - 1, 0, -1):
        held[effects[k][0]] += held[k]
        articles[effects[k][0]] += articles[k]
    wraps = [k > 0 and held[k] >= MOST * held[0] and articles[k] == articles[0] for k in range(len(effects))]
    for anew in (False, True):
        value, gone, clean = [0.0], [False], False
        for k, (up, kind, cost) in enumerate(effects[1:], 1):
            above, lost = value[up], gone[up]
            if not lost and kind == "hidden":
                above, lost = -EVIDENCE, True
            elif lost or (kind in ("form", "named") and wraps[k]):
                pass
            elif kind == "main" or (kind == "article" and (anew or above >= 0)):
                above, clean = EVIDENCE - cost, True
            elif kind in ("rest", "form"):
                above = -EVIDENCE
            elif kind == "named":
                above = min(-cost, above)
            elif kind == "header" and above >= 0:
                above = EVIDENCE / 4 if above > 0 else -cost
            elif kind == "likely" and above >= 0:
                above = max(above, EVIDENCE / 2)
            value.append(above)
            gone.append(lost)
        if clean:
            break
    return value


class Block:
    __slots__ = ("text", "within", "evidence", "said", "depth", "close", "parent", "tag", "linked")

    def __init__(self, text: str, within: int, said: bool, depth: int, close: float, parent: int, tag: str, linked: int) -> None:
        self.text, self.within, self.evidence, self.said, self.depth = text, within, 0.0, said, depth
        self.close, self.parent, self.tag, self.linked = close, parent, tag, linked

    def shape(self) -> list[float]:
        words = self.text.split(" ")
        return [
            1.0,
            math.log1p(len(words)),
            self.linked / len(self.text),
            float(self.text[-1] in ".!?…:;\"'”»)"),
            float(self.tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
            float(self.tag in ("li", "td", "th", "option", "dt", "dd", "a")),
            min(len(self.text) / len(words), 20.0) / 10,
        ]


class Tags:
    """The tags, comments and declarations of a page, in time linear in it, whatever it holds."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.dead: set[int] = set()  # opening quotes after which no tag ends
        self.seen: tuple[int, re.Match | None] = (len(html) + 1, None)  # from where the last turn was sought, and it

    def turn(self, at: int) -> re.Match | None:
        since, turn = self.seen
        if at < since or (turn and at > turn.start()):
            turn = TURN.search(self.html, at)
            self.seen = at, turn
        return turn

    def end_of(self, at: int) -> int:
        """Behind the > that ends a tag whose attributes begin at ``at``; -1 if none does."""
        path = []
        while turn := self.turn(at):
            if turn[0] == ">":
                return turn.end()
            if turn.start() in self.dead:
                break
            path.append(turn.start())
            close = self.html.find(turn[0], turn.end())
            if close < 0:
                break
            at = close + 1
        self.dead.update(path)
        return -1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(begin, end, is it an end tag, name, attributes) of the first from ``at`` on; no name: nothing but markup."""
        html = self.html
        while head := HEAD.search(html, at):
            begin, at = head.span()
            if head[1]:
                end = html.find("-->", at)
                return begin, end + 3 if end >= 0 else len(html), False, "", ""
            if at <= self.last:
                end = html.find(">", at) + 1 if head[2] else self.end_of(at)
                if end > 0:
                    return begin, end, bool(head[3]), (head[4] or "").lower(), html[at : end - 1]
        return None


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in order. Scripts, styles, comments and markup are not text."""
    found: list[Block] = []
    effects: list[tuple[int, str, float]] = [(0, "", 0.0)]
    # (tag, id, innermost telling element, named by a semantic tag, place of the innermost block)
    stack: list[tuple[str, int, int, bool, int]] = [("", 0, 0, False, 0)]
    places: dict[str, list[int]] = defaultdict(lambda: [0])  # of the open elements of each name
    pieces: list[str] = []
    linked, links, low, serial, at = 0, 0, 0, 0, 0
    tags = Tags(html)

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = unescape(piece)
            pieces.append(piece)
            if links:
                linked += len(piece)

    def end_block() -> None:
        nonlocal linked, low
        if pieces:
            whole = " ".join("".join(pieces).split())
            if whole:
                _, _, within, said, own = stack[-1]
                tag, parent = (stack[own][0], stack[own - 1][1]) if own else ("", 0)
                depth = len(stack) - 1
                close = min(low, depth) / max(1, depth, found[-1].depth) if found else 0.0
                found.append(Block(whole, within, said, depth, close, parent, tag, min(linked, len(whole))))
                low = depth
            pieces.clear()
            linked = 0

    def pop_to(size: int) -> None:
        nonlocal low, links
        while len(stack) > size:
            name = stack.pop()[0]
            places[name].pop()
            links -= name == "a"
        low = min(low, len(stack) - 1)

    while True:
        token = tags.next(at)
        if token is None:
            text(html[at:])
            break
        begin, end, closes, name, attributes = token
        text(html[at:begin])
        at = end
        if not name:
            continue
        if name in BLOCKS:
            end_block()
        if closes:
            # An inline end tag does not close blocks around it.
            place = places[name][-1]
            if place and (name in BLOCKS or place > stack[-1][4]):
                pop_to(place)
            continue
        if name in RAW:
            if html[end - 2] != "/":
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                stop = html.find(">", close.end()) if close else -1
                at = stop + 1 if stop >= 0 else len(html)
            if name != "title":
                pieces.append(" ")
            continue
        if name in VOID:
            continue
        if name in ENDS_P and stack[stack[-1][4]][0] == "p":
            pop_to(stack[-1][4])
        if name in SIBLINGS:
            place = max(places[t][-1] for t in SIBLINGS[name])
            if place > max(places[t][-1] for t in SCOPES):
                pop_to(place)
        serial += 1
        _, _, within, said, own = stack[-1]
        effect = effect_of(name, attributes)
        if effect:
            effects.append((within, *effect))
            within = len(effects) - 1
        if name in CONTENT_TAGS or name in REST_TAGS:
            said = True
        places[name].append(len(stack))
        stack.append((name, serial, within, said, len(stack) if name in BLOCKS else own))
        links += name == "a"
    end_block()
    texts = [0] * len(effects)
    for block in found:
        texts[block.within] += len(block.text)
    evidence = evidence_of(effects, texts)
    for block in found:
        block.evidence = evidence[block.within]
        if block.evidence == EVIDENCE / 4:
            block.evidence = EVIDENCE / 2 if block.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else -EVIDENCE / 4
    return found


def least_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are content in the labelling of least cost.

    The cost is the sum of |odds| of the nodes labelled against their sign and of the weights of
    edges between different labels. A node whose odds outweigh all its edges has its label in every
    best labelling; it is settled first and its edges move into the odds of its neighbours. What is
    left is cut by the maximum flow from content to boilerplate.
    """
    odds = list(odds)
    near: list[dict[int, float]] = [defaultdict(float) for _ in odds]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] += w
            near[b][a] += w
    label: list[bool | None] = [None] * len(odds)
    queue = deque(range(len(odds)))
    while queue:
        a = queue.popleft()
        if label[a] is None and abs(odds[a]) > sum(near[a].values()):
            label[a] = odds[a] > 0
            for b, w in near[a].items():
                del near[b][a]
                if label[b] is None:
                    odds[b] += w if label[a] else -w
                    queue.append(b)
            near[a].clear()
    rest = [k for k, x in enumerate(label) if x is None]
    if rest:
        for k, side in zip(rest, _max_flow(rest, odds, near)):
            label[k] = side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], odds: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Dinic's algorithm; True for the nodes that the source still reaches."""
    place = {n: k + 2 for k, n in enumerate(nodes)}  # 0: content, 1: boilerplate
    room: list[dict[int, float]] = [{} for _ in range(len(nodes) + 2)]
    for n in nodes:
        k = place[n]
        if odds[n] > 0:
            room[0][k], room[k][0] = odds[n], 0.0
        elif odds[n] < 0:
            room[k][1], room[1][k] = -odds[n], 0.0
        for m, w in near[n].items():
            room[k][place[m]] = w
    least = 1e-12
    while True:
        level = {0: 0}
        queue = deque([0])
        while queue:
            a = queue.popleft()
            for b, w in room[a].items():
                if w > least and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if 1 not in level:
            return [place[n] in level for n in nodes]
        ways = {a: iter([b for b in room[a] if level.get(b) == level[a] + 1]) for a in level}
        path = [0]
        while path:
            a = path[-1]
            if a == 1:
                flow = min(room[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    room[x][y] -= flow
                    room[y][x] = room[y].get(x, 0.0) + flow
                cut = next(k for k, (x, y) in enumerate(zip(path, path[1:])) if room[x][y] <= least)
                del path[cut + 1 :]
                continue
            step = next((b for b in ways[a] if room[a][b] > least), None)
            if step is None:
                path.pop()
            else:
                path.append(step)


def main_text(html: str | None, weights: tuple[float, ...] = PRIOR) -> str:
    """The content blocks joined by line ends; empty for NULL and for pages without text."""
    blocks = blocks_of(html or "")
    odds, edges, last = [], [], {}
    for k, block in enumerate(blocks):
        shape = sum(w * x for w, x in zip(weights, block.shape()))
        odds.append(block.evidence + max(-SHAPE, min(SHAPE, shape)))
        if k:
            # Containers that say different things are not tied.
            tie = 1.0 if (blocks[k - 1].evidence < 0) == (block.evidence < 0) else 0.1
            edges.append((k - 1, k, ADJACENT * block.close * tie))
        if block.parent in last:
            edges.append((last[block.parent], k, KIN))
        last[block.parent] = k
    return "\n".join(b.text for b, keep in zip(blocks, least_cut(odds, edges)) if keep)


def fit_shapes(pages: DataFrame, sample: int = SAMPLE) -> tuple[float, ...]:
    """Shape weights from the blocks of about ``sample`` pages that a semantic tag declares.

    Both kinds of blocks count the same. Without blocks of both kinds the prior weights hold.
    """
    count = pages.count()
    place = F.pmod(F.xxhash64("url", "page_id"), F.lit(1_000_003)) / 1_000_003
    drawn = pages.filter(place < min(1.0, sample / max(1, count))).select("html")

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [b for page in batch.column(0) for b in blocks_of(page.as_py() or "") if b.said and b.evidence]
            yield pa.RecordBatch.from_arrays(
                [pa.array([float(b.evidence > 0) for b in own], pa.float64()), pa.array([b.shape() for b in own], pa.list_(pa.float64()))], ["label", "shape"]
            )

    rows = stored(drawn.mapInArrow(shapes, "label double, shape array<double>"))
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    n, ones = seen["n"], seen["ones"]
    if ones in (0, n):
        return PRIOR
    weight = F.when(F.col("label") > 0, n / (2 * ones)).otherwise(n / (2 * (n - ones)))
    model = LogisticRegression(regParam=0.01, maxIter=30, weightCol="weight", standardization=False).fit(
        rows.select("label", weight.alias("weight"), array_to_vector(F.slice("shape", 2, len(SHAPES) - 1)).alias("features"))
    )
    return (float(model.intercept), *(float(c) for c in model.coefficients))


def extracted(html: Column, weights: tuple[float, ...] = PRIOR) -> Column:
    @F.arrow_udf("string")
    def of(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py(), weights) for p in pages], pa.string())

    return of(html)


def op10(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; NULL and textless pages have an empty text.

    Repeated rows stay repeated; an empty table gives no rows.
    """
    weights = fit_shapes(pages.select("page_id", "url", "html"))
    found = pages.select("page_id", "url", extracted(F.col("html"), weights).alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
