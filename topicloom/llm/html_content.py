"""Main text of web pages, by a tree-structured graphical model over the DOM.

Every element of a page is a node that is frame, content or furniture. How likely each is,
given what the parent is, depends on the tag; class and id words and the length of the own
text are evidence. Messages are passed from the leaves up and from the root down, and give
each node's marginal probabilities; the text of nodes that are content with a probability of
at least one half is the result.

The numbers are learned from labelled pages: those that mark their article themselves. There
a node is furniture if it lies in something that is so by its tag or its class, content if
it lies in the article otherwise, and frame if it is neither and has no text of its own.
Starting counts stand for what the pages do not show.

Bounded: about ``MOST_PAGES`` pages, chosen by a hash of the HTML, are learned from; every
page is read whole.

Defined cases: null or empty HTML gives empty text. HTML without tags is one text node. A
comment, tag or quotation that is never closed ends with the page. Repeated rows are read
each; null keys and other columns are kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the model is learned from, at most (in expectation).
MOST_PAGES = 5_000
_STEPS = 1 << 30

# Elements by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr #text".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY_SAME = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")), "option": frozenset(("option",)),
}
#: An element of these ends the search for an element to close.
SCOPES = frozenset("html body table ul ol dl article section div td th #root".split())

# Tags and class words that are furniture, and those that mark an article.
FURNITURE_TAGS = frozenset(
    "script style noscript template nav footer header aside form button select textarea input "
    "iframe svg canvas object menu dialog head title".split()
)
FURNITURE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs byline comment "
    "comments consent cookie cookies disclaimer footer gdpr header login masthead menu modal nav "
    "navbar navigation newsletter notice overlay pager pagination popup promo promoted recommended "
    "related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "widget".split()
)
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset("article articlebody content entry main post story text".split())

# What a node can be.
FRAME, CONTENT, FURNITURE = LABELS = (0, 1, 2)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


class Tree:
    """Elements of one page in page order; the text pieces refer to their element."""

    def __init__(self, page: str) -> None:
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.words: list[tuple[str, ...]] = [()]
        self.length: list[int] = [0]
        #: How many elements of each tag are open.
        self.open: Counter = Counter()
        #: (element, decoded text), and (-1, "") where a block begins or ends.
        self.pieces: list[tuple[int, str]] = []
        self._read(page)

    def _open(self, tag: str, parent: int, words: tuple[str, ...]) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.words.append(words)
        self.length.append(0)
        return len(self.tag) - 1

    def _text(self, raw: str, stack: list[int]) -> None:
        if not raw:
            return
        text = html.unescape(raw)
        node = stack[-1]
        if text.strip():
            if self.tag[node] in ("#root", "html", "body"):
                node = self._open("#text", node, ())
            self.length[node] += len(text)
        self.pieces.append((node, text))

    def _close(self, stack: list[int], tags: frozenset[str], stop: frozenset[str]) -> None:
        """Close the innermost open element of ``tags``, unless one of ``stop`` is nearer."""
        # An end tag without an open partner costs nothing, however deep the page is.
        if not any(self.open[tag] for tag in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag in tags:
                for node in stack[depth:]:
                    self.open[self.tag[node]] -= 1
                del stack[depth:]
                self.pieces.append((-1, ""))
                return
            if tag in stop:
                return

    def _read(self, page: str) -> None:
        stack, at = [0], 0
        match = _TOKEN.search(page, at)
        while match:
            self._text(page[at:match.start()], stack)
            at = match.end()
            tag = match["tag"] or match["tag2"]
            if tag:
                tag = tag.lower()
                if match["end"] or match["end2"]:
                    if tag not in VOID and tag != "p":
                        self._close(stack, frozenset((tag,)), frozenset())
                    elif tag == "p":
                        self._close(stack, frozenset(("p",)), SCOPES)
                else:
                    rest = match["rest"] if match["tag"] else match["rest2"]
                    at = self._start(tag, rest, stack, page, at)
            match = _TOKEN.search(page, at)
        self._text(page[at:], stack)

    def _start(self, tag: str, rest: str, stack: list[int], page: str, at: int) -> int:
        if tag in CLOSES_P:
            self._close(stack, frozenset(("p",)), SCOPES)
        if tag in CLOSED_BY_SAME:
            stop = SCOPES - CLOSED_BY_SAME[tag] - frozenset(("div", "article", "section"))
            self._close(stack, CLOSED_BY_SAME[tag], stop)
        words: tuple[str, ...] = ()
        if "=" in rest:
            named = " ".join("".join(m) for m in _NAMES.findall(rest)).lower()
            words = tuple(dict.fromkeys(_WORD.findall(named)))
        if tag in VOID or tag not in INLINE:
            self.pieces.append((-1, ""))
        if tag in VOID:
            return at
        node = self._open(tag, stack[-1], words)
        if tag in RAW:
            # Nothing in it is markup, up to its own end tag.
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            return end.end() if end else len(page)
        if not rest.endswith("/") or tag not in ("svg", "path"):
            stack.append(node)
            self.open[tag] += 1
        return at

    def marked(self, i: int) -> bool:
        """Whether the class words of a node alone tell what it is."""
        return any(w in FURNITURE_WORDS or w in ARTICLE_WORDS for w in self.words[i])

    def labels(self) -> list[int] | None:
        """What each node is by the page's own marks; none if it marks no article."""
        inside, furniture = [False], [False]
        for i in range(1, len(self.tag)):
            parent = self.parent[i]
            inside.append(inside[parent] or self.tag[i] == "article")
            furniture.append(furniture[parent] or self.tag[i] in FURNITURE_TAGS
                             or any(w in FURNITURE_WORDS for w in self.words[i]))
        if not any(inside):
            return None
        return [FURNITURE if f or (not a and n) else CONTENT if a else FRAME
                for a, f, n in zip(inside, furniture, self.length)]


def _size(length: int) -> str:
    """Length of a node's own text, as evidence."""
    return "none" if not length else "some" if length < LONG else "long"


#: Characters from which on a text counts as long.
LONG = 80
#: Starting values, as (frame, content, furniture): a node by its tag and what its parent is.
_START = {
    "furniture": ((0.01, 0.01, 0.98), (0.005, 0.015, 0.98), (0.005, 0.005, 0.99)),
    "article": ((0.1, 0.88, 0.02), (0.005, 0.975, 0.02), (0.02, 0.08, 0.9)),
    "text": ((0.05, 0.5, 0.45), (0.002, 0.99, 0.008), (0.005, 0.005, 0.99)),
    "other": ((0.6, 0.15, 0.25), (0.003, 0.992, 0.005), (0.01, 0.01, 0.98)),
}
#: The same for a node by its class words.
_START_WORD = {"furniture": (0.02, 0.002, 1.0), "article": (0.1, 1.0, 0.002),
               "other": (1.0, 1.0, 1.0)}
#: How well a frame fits text of its own, and the least and most that long text speaks for
#: content; the pages' own ratio lies between.
_TEXT_IN_FRAME = 0.05
_LONG_RATIO = (1.5, 4.0)
#: What a starting value weighs, in nodes.
_WEIGHT = 4
_LEAST = 1e-4
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 #text blockquote pre figure figcaption dl".split())

Three = tuple[float, float, float]


def _scaled(a: float, b: float, c: float) -> Three:
    total = a + b + c
    return a / total, b / total, c / total


@dataclass(frozen=True)
class ContentModel:
    """Counts of (what, name, label of the parent, label of the node)."""

    counts: dict[tuple[str, str, int, int], int]

    def chances(self, tag: str) -> tuple[Three, Three, Three]:
        """Probabilities of a node's labels for each label of its parent."""
        kind = ("furniture" if tag in FURNITURE_TAGS else "article" if tag in ARTICLE_TAGS
                else "text" if tag in _TEXT_TAGS else "other")
        out = []
        for above, start in enumerate(_START[kind]):
            seen = [self.counts.get(("tag", tag, above, here), 0) for here in LABELS]
            out.append(_scaled(*(max((n + _WEIGHT * s) / (sum(seen) + _WEIGHT), _LEAST)
                                 for n, s in zip(seen, start))))
        return tuple(out)

    def word(self, name: str) -> Three:
        """How well a class word fits each label."""
        kind = ("furniture" if name in FURNITURE_WORDS else "article" if name in ARTICLE_WORDS
                else "other")
        seen = [sum(self.counts.get(("word", name, above, here), 0) for above in LABELS)
                for here in LABELS]
        return _scaled(*(max(n + 20 * s, 1e-3) for n, s in zip(seen, _START_WORD[kind])))

    def long_ratio(self) -> float:
        """How much more often content has long text than furniture that has any."""

        def share(here: int) -> float:
            seen = {size: sum(self.counts.get(("size", size, above, here), 0) for above in LABELS)
                    for size in ("some", "long")}
            return (seen["long"] + 1) / (sum(seen.values()) + 4)

        low, high = _LONG_RATIO
        return min(max(share(CONTENT) / share(FURNITURE), low), high)

    def tables(self) -> "_Tables":
        return _Tables(self)


class _Tables:
    """The model's numbers, each computed when it is first needed."""

    def __init__(self, model: ContentModel) -> None:
        self.model = model
        self._chances: dict[str, tuple[Three, Three, Three]] = {}
        self._words: dict[str, Three] = {}
        self.sizes = {"none": (1.0, 1.0, 1.0), "some": (_TEXT_IN_FRAME, 1.0, 1.0),
                      "long": (_TEXT_IN_FRAME, model.long_ratio(), 1.0)}

    def chances(self, tag: str) -> tuple[Three, Three, Three]:
        found = self._chances.get(tag)
        if found is None:
            if len(self._chances) > 10_000:
                self._chances.clear()
            found = self._chances[tag] = self.model.chances(tag)
        return found

    def word(self, word: str) -> Three:
        found = self._words.get(word)
        if found is None:
            if len(self._words) > 100_000:
                self._words.clear()
            found = self._words[word] = self.model.word(word)
        return found


def content_chances(tree: Tree, tables: _Tables) -> list[float]:
    """Probability of every node to be content, by sum-product message passing.

    Upward, a node collects what its own evidence and its children say of its label, and
    tells its parent; downward, it learns what the rest of the page says. What the children
    of a node say is averaged, so that many of them do not outvote the marks of the page.
    """
    n, parent = len(tree.tag), tree.parent
    children = Counter(parent)
    up: list[Three] = []
    for i in range(n):
        x, y, z = tables.sizes[_size(tree.length[i])]
        for word in tree.words[i]:
            a, b, c = tables.word(word)
            x, y, z = _scaled(x * a, y * b, z * c)
        up.append((x, y, z))
    chances = [tables.chances(tag) for tag in tree.tag]
    message: list[Three] = [(1.0, 1.0, 1.0)] * n
    for i in range(n - 1, 0, -1):
        x, y, z = up[i]
        share = 1 / children[parent[i]]
        told = _scaled(*((a * x + b * y + c * z) ** share for a, b, c in chances[i]))
        message[i] = told
        a, b, c = up[parent[i]]
        up[parent[i]] = _scaled(a * told[0], b * told[1], c * told[2])
    down: list[Three] = [(0.98, 0.01, 0.01)] * n
    out = [0.0] * n
    for i in range(n):
        if i:
            p = parent[i]
            d, u, m = down[p], up[p], message[i]
            f = [d[k] * u[k] / m[k] for k in LABELS]
            t = chances[i]
            down[i] = _scaled(*(f[0] * t[0][k] + f[1] * t[1][k] + f[2] * t[2][k] + 1e-300
                                for k in LABELS))
        d, u = down[i], up[i]
        out[i] = _scaled(d[0] * u[0] + 1e-300, d[1] * u[1], d[2] * u[2])[CONTENT]
    return out


def main_text(page: str, tables: _Tables) -> str:
    """Text of the nodes that are content, blocks and white space joined by one space."""
    tree = Tree(page)
    chance = content_chances(tree, tables)
    text = "".join(piece if node >= 0 and chance[node] >= 0.5 else " "
                   for node, piece in tree.pieces)
    return " ".join(text.split())


def learn_content(
    pages: DataFrame, column: str = "html", most_pages: int = MOST_PAGES
) -> ContentModel:
    """Count the nodes of a bounded sample of pages that mark their article."""
    rows = pages.count()
    share = min(_STEPS, _STEPS * most_pages // max(rows, 1))
    sample = pages.select(F.col(column).alias("html")).where(
        F.pmod(F.xxhash64(F.lit("sample"), column), F.lit(_STEPS)) < share)

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column("html"):
                tree = Tree(page.as_py() or "")
                labels = tree.labels()
                for i in range(1, len(tree.tag)) if labels else ():
                    above, here = labels[tree.parent[i]], labels[i]
                    if not tree.marked(i):
                        counts["tag", tree.tag[i], above, here] += 1
                    counts["size", _size(tree.length[i]), above, here] += 1
                    for word in tree.words[i]:
                        counts["word", word, above, here] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
             pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys], pa.int32()),
             pa.array([counts[k] for k in keys], pa.int64())],
            names=["what", "name", "above", "here", "n"],
        )

    counted = sample.mapInArrow(run, "what string, name string, above int, here int, n long")
    total = counted.groupBy("what", "name", "above", "here").agg(F.sum("n").alias("n"))
    # Tags and class words of a bounded sample.
    return ContentModel({(r.what, r.name, r.above, r.here): r.n for r in total.collect()})


def extract_content(pages: DataFrame, model: ContentModel, column: str = "html") -> DataFrame:
    """Replace the HTML by ``text``, the main text, and ``n_chars``, its code points."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        tables = shared.value.tables()
        return pa.array([main_text(page.as_py() or "", tables) for page in column], pa.string())

    text = extract(F.coalesce(F.col(column), F.lit("")))
    read = pages.withColumn("text", text)
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    return read.select(*kept, "text", F.length("text").cast("long").alias("n_chars"))
