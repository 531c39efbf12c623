"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into blocks at block-level tags. A linear classifier scores each block as
content or boilerplate from its place in the document (article, navigation, footer, names of
classes), its tag, length, sentence ends and share of link text; the score becomes the capacity to
the content or the boilerplate terminal. Blocks that follow each other, and blocks that are
next under the same parent, are joined by smoothness edges, weaker the farther apart they
are in the tree. A maximum flow separates the two sides; the content side is the main text.

Defined results: a null or empty page has an empty text; scripts, styles, markup and comments
are never text, nor is what stands between both tags of the elements in ``SKIPPED`` (a tag of these that is
not closed inside its parent is passed over); character references are decoded, white space in a block becomes one space,
and blocks are joined by an empty line in page order; ids and URLs are carried, null or
repeated; rows are independent; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.llm.tables import with_columns_in_arrow

_TAG = re.compile(
    # a quote opens a value only behind an equals sign; <!--> and <!---> are whole comments
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*"|'[^']*')?)*+)>?""", re.S
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|\b(hidden)\b""")
_NAME = re.compile(r"[a-z]+")
_SENTENCE_END = re.compile(r"[.!?…](?=\s|$)")
#: Names that say what an element has beside it, or has not.
_BESIDE = re.compile(r"(?<![\w-])(?:has|no|with|without)[-_][\w-]+")

# Elements by their role in HTML.
#: Read up to their closing tag or the end of the page; elements that are skipped if they are closed.
RAW = frozenset("script style title textarea iframe xmp".split())
SKIPPED = frozenset("noscript template svg object select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul button label".split()
)
#: An opening tag ends an open element of these names, up to the nearest of the second set.
IMPLIED_END = {
    "p": (frozenset({"p"}), frozenset()),
    "li": (frozenset({"li", "p"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd", "p"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "p"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th", "p"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset()),
}
CONTENT_ELEMENTS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is no content wherever they stand, and those whose text is content inside an article only.
BOILERPLATE_ELEMENTS = frozenset("nav aside footer form menu dialog button label fieldset legend search".split())
UNSURE_ELEMENTS = frozenset(("header",))
#: Words in class, id and role. The first group speaks against an element wherever it stands.
BOILERPLATE_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner comment comments reply "
    "replies discussion disqus respond nav navbar navigation menu breadcrumb breadcrumbs footer sidebar cookie "
    "cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations trending pagination pager complementary contentinfo search".split()
)
#: Of these, names of lists whose entries may be articles of their own, next to the page's article.
LIST_NAMES = frozenset(
    "comment comments reply replies discussion disqus respond related recommended recommendations trending".split()
)
#: Of these, names that say as much as a part of a longer name: remarks of readers are often as long as an article.
REMARK_NAMES = frozenset("comment comments reply replies disqus respond".split())
UNSURE_NAMES = frozenset("header masthead widget widgets toolbar meta tags byline copyright legal topbar".split())
CONTENT_NAMES = frozenset("article content post entry story main body text".split())

#: Weights of the classifier, in units of log-odds.
W = {
    "start": -1.0, "article": 3.0, "content": 1.5, "boilerplate": -8.0, "unsure": -4.0, "unsure_in_article": -0.5,
    "doubt": -2.5, "answer": 0.5, "most_answer": 4.0, "length": 0.5, "most_length": 2.5, "sentence": 0.4, "links": -3.0,
    "p": 0.7, "blockquote": 0.7, "pre": 0.7, "h1": 1.0, "h2": 0.5, "h3": 0.5, "h4": 0.3, "li": -0.3, "td": -0.2,
}
#: Capacity of a smoothness edge between blocks under one parent, and its factor for each further step in the tree.
SMOOTH, FARTHER = 1.2, 0.6
#: Remembered attribute texts of a worker.
REMEMBERED = 20_000


def _hint(attributes: str) -> int:
    """-4 a list of other articles or remarks, -3 hidden, -2 boilerplate, -1 unsure, 1 content, 2 a doubt, 3 a doubt that an article before it settles, 0 nothing said, from the attributes of a tag."""
    said = 0
    for name, value, hidden in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if hidden or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return -3
        if name == "aria-hidden" and "true" in value.lower():
            return -3
        if name in ("class", "id", "role"):
            value = _BESIDE.sub(" ", value.lower().strip("\"'"))
            named = [_NAME.findall(w) for w in value.split()]
            # a name made of listed words alone says what one of them does
            whole = {w for words in named for w in words if len(words) == 1 or BOILERPLATE_NAMES.issuperset(words)}
            parts = {w for words in named for w in words}
            if not LIST_NAMES.isdisjoint(whole):
                said = -4
            elif not REMARK_NAMES.isdisjoint(parts) and CONTENT_NAMES.isdisjoint(whole):
                said = -4
            elif not BOILERPLATE_NAMES.isdisjoint(whole):
                said = min(said, -2)
            elif said <= -2:
                continue
            elif not UNSURE_NAMES.isdisjoint(parts):
                said = -1
            elif said == 0 and not BOILERPLATE_NAMES.isdisjoint(parts):
                # a word inside a longer name only casts doubt
                said = 2 if LIST_NAMES.isdisjoint(parts) else 3
            elif said == 0 and not CONTENT_NAMES.isdisjoint(parts):
                said = 1
    return said


class _Element:
    __slots__ = ("name", "parent", "depth", "article", "content", "bad", "unsure", "surely_bad", "doubtful")

    def __init__(self, name: str, parent: _Element | None, hint: int, after_article: bool = False):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        inherits = parent is not None
        self.article, self.content = (parent.article, parent.content) if inherits else (False, False)
        self.doubtful = inherits and parent.doubtful
        self.bad, self.unsure, self.surely_bad = (
            (parent.bad, parent.unsure, parent.surely_bad) if inherits else (False, False, False)
        )
        if name in ("html", "body"):
            return  # page-wide names say nothing about a part
        if name in CONTENT_ELEMENTS and not self.surely_bad:
            # the names of what stands around it do not count
            self.article, self.unsure, self.bad, self.doubtful = True, False, False, False
        if hint == 1:
            self.content = True
        self.doubtful |= hint in (2, 3)
        if hint == 3 and after_article and name != "main":
            self.bad = self.surely_bad = True
        if name in BOILERPLATE_ELEMENTS or hint == -3:
            self.bad = self.surely_bad = True
        if hint in (-2, -4) and name != "main":
            self.bad = True
            self.surely_bad |= hint == -4 and after_article
        if name in UNSURE_ELEMENTS or hint == -1:
            self.unsure = True


def _raw_end(page: str, name: str, at: int) -> int:
    """Where the closing tag of a raw element ends, or -1."""
    end = re.compile("</" + re.escape(name) + r"[\s/>]", re.I).search(page, at)
    return -1 if end is None else page.find(">", end.start()) + 1 or len(page)


_ANY_SKIPPED = re.compile(r"<(?:" + "|".join(sorted(SKIPPED)) + r")(?=[\s/>])", re.I)


def _skipped(page: str) -> dict[int, int]:
    """Where elements in ``SKIPPED`` that are closed inside their parent end, by where their opening tag ends."""
    found: dict[int, int] = {}
    if not _ANY_SKIPPED.search(page):
        return found
    opened: list[tuple[str, int]] = []
    count = dict.fromkeys((*BLOCKS, *SKIPPED), 0)
    at = 0
    while tag := _TAG.search(page, at):
        at = tag.end()
        name = (tag[2] or "").lower()
        alone = (tag[3] or "").rstrip().endswith("/")
        if name in RAW and not tag[1]:
            # in an image only scripts and styles are raw, and may be empty
            if count["svg"] and (alone or name not in ("script", "style")):
                continue
            at = _raw_end(page, name, at)
            if at < 0:
                break
        elif name not in count or name in VOID:
            continue
        elif not tag[1]:
            if not (name in SKIPPED and alone):
                opened.append((name, tag.end()))
                count[name] += 1
        elif count[name]:
            while opened:  # those inside it that are still open were not closed
                last, start = opened.pop()
                count[last] -= 1
                if last == name:
                    break
            if name in SKIPPED:
                found[start] = tag.end()
    return found


class Parser:
    """Blocks of a page: (text, element, characters of link text)."""

    def __init__(self):
        self._hints: dict[str, int] = {}

    def hint(self, attributes: str) -> int:
        found = self._hints.get(attributes)
        if found is None:
            if len(self._hints) >= REMEMBERED:
                self._hints.clear()
            found = self._hints[attributes] = _hint(attributes)
        return found

    def blocks(self, page: str) -> list[tuple[str, _Element, int]]:
        at, n = 0, len(page)
        here = _Element("", None, 0)
        out: list[tuple[str, _Element, int]] = []
        pieces: list[str] = []
        linked, in_link = 0, False
        skip_head = False
        skipped = _skipped(page)
        after_article = False

        def close_block() -> None:
            nonlocal linked, in_link
            if pieces:
                raw = "".join(pieces)
                text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
                if text:
                    out.append((text, here, min(linked, len(text))))
                pieces.clear()
            linked, in_link = 0, False

        search = _TAG.search
        while at < n:
            tag = search(page, at)
            start = tag.start() if tag else n
            if start > at and not skip_head:
                piece = page[at:start]
                pieces.append(piece)
                if in_link:
                    linked += len(piece)
            if tag is None:
                break
            at = tag.end()
            name = tag[2]
            if name is None:
                continue
            name = name.lower()
            if tag[1]:
                if name == "a":
                    in_link = False
                elif name in BLOCKS:
                    close_block()
                    if name == "head":
                        skip_head = False
                    up = here
                    while up is not None and up.name != name:
                        up = up.parent
                    if up is not None and up.parent is not None:
                        here = up.parent
                elif name == "br":
                    pieces.append(" ")
                continue
            if name in RAW:
                end = _raw_end(page, name, at)
                if end < 0:
                    break
                at = end
            elif name in SKIPPED:
                at = skipped.get(at, at)
            elif name == "a":
                in_link = True
            elif name == "br":
                pieces.append(" ")
            elif name in BLOCKS:
                close_block()
                if name == "head":
                    skip_head = True
                elif name != "html":
                    skip_head = False
                if name in VOID:
                    continue
                ended, until = IMPLIED_END.get(name, IMPLIED_END["p"])
                up, top = here, here
                while up.parent is not None and up.name not in until and up.name in ended:
                    up = top = up.parent
                here = _Element(name, top, self.hint(tag[3]) if tag[3] else 0, after_article)
                after_article |= name in CONTENT_ELEMENTS and not here.bad
        close_block()
        return out


def score(text: str, element: _Element, linked: int) -> float:
    """Log-odds that a block is content."""
    value = W["start"] + W.get(element.name, 0.0)
    value += min(W["most_length"], W["length"] * math.log2(1 + len(text) / 40))
    if text[-1] in ".!?\"»”…":
        value += W["sentence"]
    value += W["links"] * linked / len(text)
    if element.article:
        value += W["article"]
    if element.content:
        value += W["content"]
    if element.bad:
        value += W["boilerplate"]
    elif element.unsure:
        value += W["unsure_in_article"] if element.article else W["unsure"]
    elif element.doubtful and not element.article:
        # a heading is told by what it stands with
        value += W["doubt"] / (2 if element.name in HEADINGS else 1)
        value += min(W["most_answer"], W["answer"] * len(_SENTENCE_END.findall(text)))
    return value


def _steps(a: _Element, b: _Element) -> int:
    """Steps in the tree between the parents of two blocks."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def smoothness_edges(elements: list[_Element]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page, and between next blocks under the same parent."""
    edges, last = [], {}
    for i, element in enumerate(elements):
        parent = element.parent or element
        if i:
            steps = _steps(parent, elements[i - 1].parent or elements[i - 1])
            edges.append((i - 1, i, SMOOTH * FARTHER**steps))
        before = last.get(id(parent))
        if before is not None and before != i - 1:
            edges.append((before, i, SMOOTH / 2))
        last[id(parent)] = i
    return edges


def source_side(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: a node pays its score for the wrong side, an edge its capacity if it is cut.

    Maximum flow by shortest augmenting paths from nodes with a positive score left over to
    nodes with a negative one.
    """
    n = len(scores)
    near: list[list[int]] = [[] for _ in range(n)]
    left, room = [], list(scores)
    to: list[int] = []
    for a, b, capacity in edges:
        near[a].append(len(to))
        near[b].append(len(to) + 1)
        to += [b, a]
        left += [capacity, capacity]
    tiny = 1e-9
    while True:
        came: list[int] = [-2] * n
        queue = deque(i for i in range(n) if room[i] > tiny)
        for i in queue:
            came[i] = -1
        end = -1
        while queue and end < 0:
            i = queue.popleft()
            for e in near[i]:
                j = to[e]
                if came[j] == -2 and left[e] > tiny:
                    came[j] = e
                    if room[j] < -tiny:
                        end = j
                        break
                    queue.append(j)
        if end < 0:
            return [c != -2 for c in came]
        path, i = [], end
        while came[i] != -1:
            path.append(came[i])
            i = to[came[i] ^ 1]
        flow = min(room[i], -room[end], *[left[e] for e in path])
        room[i] -= flow
        room[end] += flow
        for e in path:
            left[e] -= flow
            left[e ^ 1] += flow


def main_text(page: str, parser: Parser) -> str:
    blocks = parser.blocks(page)
    scores = [score(*b) for b in blocks]
    kept = source_side(scores, smoothness_edges([b[1] for b in blocks]))
    return "\n\n".join(b[0] for b, keep in zip(blocks, kept, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page."""
    new = T.StructType().add("text", "string").add("n_chars", "long")

    def worker():
        parser = Parser()

        def make(columns):
            texts = [main_text(page.as_py() or "", parser) for page in columns[0]]
            return [texts, [len(t) for t in texts]]

        return make

    given = pages.select("page_id", "url", "html")
    return with_columns_in_arrow(given, [F.col("html").cast("string")], new, worker, drop=("html",))
