"""Operator 6: main text of HTML pages by minimum-cut labelling.

A page becomes a network.  Its nodes are the text blocks, in page order, and the
elements that are marked as main text or as boilerplate, by tag (article, nav and
the like), role or class.  A linear classifier over a block's own text and the
blocks around it gives each block a cost for either label; costs are the capacities
of its edges to the two terminals.  A marked element has an edge to one terminal,
by the number of blocks that belong to it.  Smoothness edges join each block with
the marked element that it belongs to, with the block before it, and with the
nearest blocks before it under the same parent and grandparent; capacities fall with
the distance in the element tree and between blocks of different marked elements.  Maximum flow finds the cheapest labelling, and
the source side is the main text.

The classifier is a logistic regression.  Its labels come from sampled pages that
have an article or main element: whether a block belongs to it.  Its features know
nothing of marks.  It is drawn towards stated weights, which hold where no page of
the sample has such an element.

What a mark means depends on what it holds: a class that speaks of boilerplate
counts for less the more of the page's text is inside, and for nothing on a wrapper of
the page; a form counts if it has fields and little text; an article or main element
ends the marks around it, unless they are those of a small part of the page.

Defined results: null or empty html, and pages without content blocks, give the
empty text; white space inside a block becomes one space; blocks are joined by
two line feeds in page order; repeated rows are treated alike.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# --- parsing into blocks --------------------------------------------------------------------

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^>]*+>?", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
_RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "select", "title", "canvas")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas belong to the block around them.
_INLINE |= frozenset("math maction annotation annotation-xml menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
_SPACE = re.compile(r"\s+")
#: An open element of the first kind ends when one of the second opens.
_CLOSES = {
    "p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
_SCOPES = frozenset("table ul ol dl div article section main body html td th li".split())

# --- marks of elements ----------------------------------------------------------------------

#: Tags of boilerplate.  A header in an article holds its title.
_BOILER_TAGS = frozenset("nav header footer aside menu button dialog".split())
_FIELDS = frozenset("input select textarea button".split())
_BOILER_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert".split())
_BOILER_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|foot(?:er)?|header|masthead|side-?bar\w*|widget\w*|cookies?\w*|consent\w*|notices?|alert|gdpr|popup\w*|modal\w*|newsletter\w*|subscri\w*|share\w*|sharing|social\w*|related\w*|recommend\w*|breadcrumbs?|pagination|pager|login|sign-?up|search\w*|toolbar|copyright|legal|disclaimer|tags?|author-?bio|meta|skip\w*|outbrain|taboola)(?:$|[^a-z])"
)
_COMMENT_WORDS = re.compile(r"(?:^|[^a-z])(?:comments?|comment-?\w*|repl(?:y|ies)|disqus\w*|respond)(?:$|[^a-z])")
_CONTENT_WORDS = re.compile(r"(?:^|[^a-z])(?:article\w*|post-?(?:body|content|text)|entry-?(?:content|body)?|main|content|story\w*|body-?text|text)(?:$|[^a-z])")
#: A class such as has-sidebar or no-comments tells of a layout.
_LAYOUT = re.compile(r"(?:has|no|with|without|is|not|hide|show)[-_]")


@dataclass(slots=True)
class Element:
    tag: str
    number: int
    parent: Element | None
    boiler: bool = False  # by class, id or hidden
    comments: bool = False
    content: bool = False
    main: bool = False
    role: bool = False  # a role of boilerplate
    words: int = 0
    fields: int = 0


def _marks(element: Element, token: str) -> None:
    named = {k.lower(): (a or b or c).lower() for k, a, b, c in _ATTRIBUTE.findall(token)}
    role = named.get("role", "")
    element.main, element.role = element.main or role == "main", role in _BOILER_ROLES
    marks = " ".join(x for x in f"{named.get('class', '')} {named.get('id', '')} {named.get('aria-label', '') if element.tag == 'div' else ''}".split() if not _LAYOUT.match(x))
    if element.tag not in ("html", "body"):
        element.comments = bool(_COMMENT_WORDS.search(marks))
        element.boiler = element.comments or bool(_BOILER_WORDS.search(marks)) and not element.main
        element.boiler |= "hidden" in named or "display:none" in named.get("style", "").replace(" ", "")
    element.content = bool(_CONTENT_WORDS.search(marks))


@dataclass(slots=True)
class Mark:
    """What a marked element says of its blocks: positive for main text."""

    value: float
    element: Element | None = None
    by_tag: bool = False


_NONE = Mark(0.0)
CONTENT, CONTENT_WORD, BOILER = 5.0, 2.0, -5.0


def marks_of(elements: list[Element], total: int) -> list[Mark]:
    """The mark that holds inside each element, in order of numbers."""
    out: list[Mark] = []
    for e in elements:
        above = out[e.parent.number] if e.parent is not None else _NONE
        share = e.words / max(total, 1)
        fades = (0.8, 1.0) if e.comments else (0.4, 0.7)
        strength = min(1.0, max(0.0, (fades[1] - share) / (fades[1] - fades[0])))
        form = e.tag in ("form", "fieldset") and e.fields > 0 and e.words <= 30 * e.fields
        in_article = above.value == CONTENT
        if e.tag in _BOILER_TAGS and not (e.tag == "header" and in_article) or e.role:
            out.append(Mark(BOILER, e, True))
        elif (e.boiler or form) and strength > 0:
            out.append(Mark(BOILER * strength, e))
        elif e.main and not (above.value < 0 and (above.by_tag or above.value == BOILER)):
            out.append(Mark(CONTENT, e))
        elif e.content and above is _NONE:
            out.append(Mark(CONTENT_WORD, e))
        else:
            out.append(above)
    return out


# --- blocks -----------------------------------------------------------------------------------


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[int, ...]
    features: dict[str, float]
    mark: Mark = field(default_factory=lambda: _NONE)


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order; what is inside scripts, styles and the like is no text."""
    out: list[Block] = []
    owners: list[Element] = []
    elements = [Element("#", 0, None)]
    stack = [elements[0]]
    pieces: list[str] = []
    linked = total = links = 0

    def flush() -> None:
        nonlocal pieces, linked, total
        text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        if text:
            around = [e for e in stack if e.tag not in _INLINE]
            near, n = around[-1].tag, text.count(" ") + 1
            for e in stack:
                e.words += n
            owners.append(stack[-1])
            out.append(
                Block(
                    text,
                    tuple(e.number for e in around),
                    {
                        "words": min(n, 40) / 20,
                        "sentence": text[-1] in ".!?…。",
                        "link_share": min(1.0, linked / max(total, 1)),
                        "heading": near in ("h1", "h2", "h3", "h4", "h5", "h6"),
                        "paragraph": near in ("p", "blockquote", "pre", "figcaption"),
                        "list_item": near in ("li", "dt", "dd", "td", "th"),
                    },
                )
            )
        pieces, linked, total = [], 0, 0

    def pop_to(k: int) -> None:
        nonlocal links
        for e in stack[k:]:
            links -= e.tag == "a"
        del stack[k:]

    def add(text: str) -> None:
        nonlocal linked, total
        pieces.append(text)
        n = len(text.strip())
        total += n
        linked += n if links else 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        token, at = m.group(), m.end()
        if token.startswith("<![CDATA["):
            continue
        if token[1] in "!?":
            continue
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            if tag in _INLINE or tag == "br":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        pop_to(k)
                        break
                    if stack[k].tag not in _INLINE:
                        break
                if tag == "br":
                    add(" ")
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
            continue
        if tag in _FIELDS:
            for e in stack:
                e.fields += 1
        if tag in _RAW_END:
            if tag not in _INLINE:
                flush()
            if tag != "svg" or not token.endswith("/>"):  # only foreign elements may close themselves
                m = _RAW_END[tag].search(page, at)
                at = m.end() if m else end
            continue
        if tag == "br":
            add(" ")
            continue
        if tag not in _INLINE:
            flush()
            _imply_ends(stack, tag, pop_to)
        if tag in _VOID or token.endswith("/>"):
            continue
        element = Element(tag, len(elements), stack[-1], main=tag in ("article", "main"))
        if "=" in token or "hidden" in token:
            _marks(element, token)
        elements.append(element)
        stack.append(element)
        links += tag == "a"
    flush()
    marks = marks_of(elements, elements[0].words)
    for k, b in enumerate(out):
        b.mark = marks[owners[k].number]
        near = [out[j].features for j in (k - 1, k + 1) if 0 <= j < len(out)]
        b.features["words_around"] = sum(f["words"] for f in near) / max(len(near), 1)
        b.features["links_around"] = sum(f["link_share"] for f in near) / max(len(near), 1)
    return out


def _imply_ends(stack: list[Element], tag: str, pop_to) -> None:
    """End the elements whose end tag may be left out before ``tag``."""
    for k in range(len(stack) - 1, 0, -1):
        open_tag = stack[k].tag
        if tag in _CLOSES.get(open_tag, ()):
            pop_to(k)
            return
        if open_tag in _SCOPES and open_tag not in ("li", "td", "th"):
            return
        if open_tag in ("li", "td", "th") and tag not in ("li", "td", "th", "tr", "tbody", "tfoot", "thead"):
            return


# --- labelling --------------------------------------------------------------------------------


#: Where the classifier's weights start and are drawn to; positive favours main text.
WEIGHTS = {"bias": -0.8, "words": 0.7, "sentence": 0.8, "link_share": -3.0, "heading": 0.6, "paragraph": 0.8, "list_item": -0.5, "words_around": 0.4, "links_around": -0.8}
#: A block's cost is at most so much, less than the edge to its marked element.
MOST_SCORE, HOLD = 3.0, 4.0
#: Between blocks side by side, and the part of it where they belong to different marked elements.
SMOOTHNESS, ACROSS = 1.0, 0.2
#: Blocks of evidence that the stated weights count as.
STATED = 20.0


def vector(features: dict[str, float]) -> list[float]:
    return [1.0, *(float(features[k]) for k in list(WEIGHTS)[1:])]


def score(features: dict[str, float], weights: dict[str, float] = WEIGHTS) -> float:
    value = sum(w * x for w, x in zip(weights.values(), vector(features), strict=True))
    return max(-MOST_SCORE, min(MOST_SCORE, value))


def fitted(x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Weights of a logistic regression, drawn towards the stated ones; Newton steps."""
    start = np.array(list(WEIGHTS.values()))
    if not len(y) or y.all() or not y.any():
        return dict(WEIGHTS)
    w = start.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + STATED * (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + STATED * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return dict(zip(WEIGHTS, w.tolist(), strict=True))


def labelled(page: str | None) -> tuple[list[list[float]], list[bool]]:
    """Features and labels of a page's blocks, if it has an article or main element with text."""
    found = blocks(page or "")
    labels = [b.mark.value == CONTENT for b in found]
    return ([vector(b.features) for b in found], labels) if any(labels) else ([], [])


def fit(pages: DataFrame, sample: int = 500) -> dict[str, float]:
    """The classifier's weights from about ``sample`` pages, chosen by a hash of their html."""
    total = max(pages.count(), 1)
    some = pages.select("html").where("html is not null")
    if total > sample:
        some = some.where(F.pmod(F.xxhash64("html", F.lit(13)), F.lit(1 << 30)) < int((1 << 30) * sample / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0).to_pylist():
                x, y = labelled(page)
                if y:
                    yield pa.RecordBatch.from_arrays([pa.array([np.array(x).tobytes()], pa.binary()), pa.array([np.array(y, bool).tobytes()], pa.binary())], names=["x", "y"])

    rows = sorted((r["x"], r["y"]) for r in some.mapInArrow(run, "x binary, y binary").collect())  # a few numbers for each block of the sample
    if not rows:
        return dict(WEIGHTS)
    x, y = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in ((0, float), (1, bool)))
    return fitted(x.reshape(len(y), -1), y.astype(float))


class FlowNetwork:
    """Maximum flow by shortest augmenting paths with level graphs (Dinic)."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[float] = []
        self.edges: list[list[int]] = [[] for _ in range(n)]

    def join(self, a: int, b: int, forth: float, back: float = 0.0) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def _levels(self, source: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in self.edges[x]:
                if self.room[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Saturate the network; which nodes the source still reaches."""
        while True:
            level = self._levels(source)
            if level[sink] < 0:
                return [x >= 0 for x in level]
            turn = [0] * len(self.edges)
            while self._augment(source, sink, level, turn):
                pass

    def _augment(self, source: int, sink: int, level: list[int], turn: list[int]) -> bool:
        path: list[int] = []
        x = source
        while x != sink:
            edges = self.edges[x]
            while turn[x] < len(edges):
                e = edges[turn[x]]
                if self.room[e] > 1e-12 and level[self.to[e]] == level[x] + 1:
                    break
                turn[x] += 1
            if turn[x] == len(edges):
                if not path:
                    return False
                x = self.to[path.pop() ^ 1]
                turn[x] += 1
                continue
            path.append(edges[turn[x]])
            x = self.to[path[-1]]
        least = min(self.room[e] for e in path)
        for e in path:
            self.room[e] -= least
            self.room[e ^ 1] += least
        return True


def tree_distance(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return len(a) + len(b) - 2 * same


def neighbours(found: list[Block]) -> list[tuple[int, int]]:
    """Pairs of blocks with a smoothness edge: consecutive ones, and each with the
    nearest one before it that has the same parent, and that has the same grandparent,
    and belongs to the same marked element; so an advert does not part its neighbours."""
    out, last = [], {}
    for k, b in enumerate(found):
        near = {k - 1} if k else set()
        for above in (1, 2):
            if len(b.path) <= above:
                continue
            kind = above, b.path[:-above], b.mark.element and b.mark.element.number
            if kind in last:
                near.add(last[kind])
            last[kind] = k
        out += [(j, k) for j in sorted(near)]
    return out


def label(found: list[Block], weights: dict[str, float] = WEIGHTS) -> list[bool]:
    """True for main text: the minimum cut of the page's network."""
    n = len(found)
    if not n:
        return []
    marked = {b.mark.element.number: b.mark for b in found if b.mark.element is not None}
    place = {number: n + 2 + k for k, number in enumerate(marked)}
    net, source, sink = FlowNetwork(n + 2 + len(marked)), n, n + 1

    def terminal(k: int, value: float) -> None:
        net.join(source, k, max(value, 0.0))
        net.join(k, sink, max(-value, 0.0))

    members = dict.fromkeys(marked, 0)
    for k, b in enumerate(found):
        terminal(k, score(b.features, weights))
        if b.mark.element is not None:
            number = b.mark.element.number
            members[number] += 1
            hold = HOLD * min(1.0, abs(b.mark.value) / CONTENT)
            net.join(k, place[number], hold, hold)
    for number, mark in marked.items():
        terminal(place[number], mark.value * members[number])
    for j, k in neighbours(found):
        weight = SMOOTHNESS / (1 + max(0, tree_distance(found[j].path, found[k].path) - 2)) ** 2
        weight *= 1.0 if found[j].mark.element is found[k].mark.element else ACROSS
        net.join(j, k, weight, weight)
    return net.source_side(source, sink)[:n]


def main_text(page: str | None, weights: dict[str, float] = WEIGHTS) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, label(found, weights), strict=True) if keep)


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html), with
    weights fitted to a sample of them where none are given."""
    ids, urls = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    run = _extractor(weights or fit(pages))
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {ids}, url {urls}, text string, n_chars long")


def _extractor(weights: dict[str, float]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, weights) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run
