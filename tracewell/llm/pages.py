"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags.  Words score positive and tags negative, by
weights learned from labelled pages: pages whose article is marked up as such.  One
linear scan finds the contiguous stretch of the highest sum, which is the content region.
Elements inside of it that the markup names as menus, adverts and the like, by a class that
stands outside of articles on the labelled pages or by fixed words, are left out; so are the
parts that headings such as ``Comments`` begin, articles within articles, and headers, an
article's own too.  Features are the kinds of elements around a word or tag, hashed, so none is too rare to
have a weight and the model has a fixed size.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, raw_texts, small_batches

# Fixed values of HTML: names of elements by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
HIDDEN = "script style noscript template head title svg math iframe object canvas textarea select option button".split()
NOISE_ELEMENTS = frozenset(["nav", "header", "footer", "aside", "form", "menu", "dialog", *HIDDEN])
CONTENT_ELEMENTS = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = frozenset(["p", "li", "dt", "dd", *HEADINGS])
#: Elements without an end tag of their own: those that a start tag of the key ends, inside of
#: the nearest element of the last column.
ENDS = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",)),
}
#: Words of a class, id or role that name what is no content.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "outbrain pager pagination popup promo promoted promotion recommended related replies reply respond share sharing "
    "sidebar signup social sponsor sponsored subscribe taboola toolbar widget".split()
)

#: Words that may stand beside one of NOISE_WORDS in a class without changing what it names.
STRUCTURE_WORDS = frozenset("area bar block body box btn button buttons container content inner item items js left links list main outer right row section top bottom wrap wrapper".split())
#: Headings of nothing but these words, and one of NOISE_WORDS, begin a part that is no content.
HEADING_WORDS = frozenset("a add all also an and articles be first here leave latest more no of on our post posts stories story the this to view write you your".split())

OPENING = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
ATTRIBUTES = re.compile(r"(?:[^<>\"']+|\"[^\"]*\"|'[^']*')*+")
#: Start tags of raw elements may hold a ``<``.
RAW_ATTRIBUTES = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+")
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template textarea svg iframe title".split()}
#: Classes of the innermost elements that a text counts for.
NAMES = 4
CORNER = re.compile("[<>]")
NAMING = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[a-z]+")
WORDS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Params:
    """``buckets`` is the size of the model: features share weights by hash, whatever their number."""

    buckets: int = 1 << 18
    smoothing: float = 1.0
    #: Weights of features that no labelled page has, and bounds of the others.
    word: float = 1.0
    noise_word: float = -1.0
    tag: float = -0.25
    least_tag: float = -0.02
    most: float = 3.0
    #: Weight of a class, learned from what stands in and outside of marked articles, at which
    #: elements of that class are left out of an article, and words that must stand behind it.
    noise_class: float = -1.5
    least_words: int = 50


@dataclass(eq=False)
class Element:
    name: str
    kind: str
    noise: bool
    content: bool
    names: tuple[str, ...] = ()
    #: The article that it is, or lies in.
    article: Element | None = None
    #: Level of the heading that began a part without content inside of it.
    silent: int = 0


@dataclass
class Piece:
    """A run of text or a tag, with the feature that carries its weight."""

    feature: str
    words: int = 0
    text: str = ""
    block: bool = False
    noise: bool = False
    content: bool = False
    names: tuple[str, ...] = ()
    article: Element | None = None

    @property
    def labelled(self) -> bool:
        return self.content and not self.noise


@dataclass
class Page:
    pieces: list[Piece] = field(default_factory=list)
    labelled: bool = False


class Open:
    """The open elements.  Each name's places are kept, so that ending one never looks through all."""

    def __init__(self) -> None:
        self.stack = [Element("", "page", False, False)]
        self.places: dict[str, list[int]] = {}
        self.headings = 0

    def push(self, element: Element) -> None:
        self.places.setdefault(element.name, []).append(len(self.stack))
        self.stack.append(element)
        self.headings += element.name in HEADINGS

    def _last(self, names: Iterable[str]) -> int:
        return max((at[-1] for n in names if (at := self.places.get(n))), default=0)

    def end(self, names: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """End the innermost element of these names, and all that is open in it, unless one of
        ``within`` stands between."""
        at = self._last(names)
        if at and at >= self._last(within):
            while len(self.stack) > at:
                name = self.stack.pop().name
                self.places[name].pop()
                self.headings -= name in HEADINGS


def tokens(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """``(start, end, kind, name, attributes)`` of all mark-up in order; kind is ``tag``, ``end``, ``raw`` (with
    all its content) or empty (comments, declarations and what is no tag).  One pass: what a
    search has looked at is not searched again, so malformed pages take no longer than others.
    A raw element or comment that does not end goes to the page's end; a tag that does not end
    goes to the next corner bracket.
    """
    at, size, failed = 0, len(source), 0
    last = source.rfind(">")
    while (at := source.find("<", at)) >= 0:
        after, kind, name, attrs = at, "", "", ""
        m = OPENING.match(source, at)
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            after = size if end < 0 else end + 3
        elif m:
            name = m[2].lower()
            raw = not m[1] and name in RAW
            if at < last and not (raw and at < failed):
                stop = (RAW_ATTRIBUTES if raw else ATTRIBUTES).match(source, m.end()).end()
                if source.startswith(">", stop):
                    after, kind, attrs = stop + 1, "end" if m[1] else "tag", source[m.end() : stop]
                    if raw:
                        close = RAW[name].search(source, after)
                        after, kind = close.end() if close else size, "raw"
                elif raw:
                    failed = stop
            if not kind:
                corner = CORNER.search(source, at + 1)
                after = size if not corner else corner.end() if corner[0] == ">" else corner.start()
        elif source[at + 1 : at + 2] in ("!", "?", "/"):
            end = source.find(">", at + 2)
            after = size if end < 0 else end + 1
        else:  # a corner bracket of the text
            at += 1
            continue
        yield at, after, kind, name, attrs
        at = after


def names_noise(names: Iterable[str]) -> bool:
    """Whether a class, id or role names what is no content: all its parts do, or say nothing."""
    for name in names:
        parts = PARTS.findall(name)
        if not NOISE_WORDS.isdisjoint(parts) and all(w in NOISE_WORDS or w in STRUCTURE_WORDS for w in parts):
            return True
    return False


def heads_noise(text: str) -> bool:
    """Whether a heading such as ``3 Comments`` or ``Related posts`` begins a part that is no content."""
    words = [w.lower() for w in WORDS.findall(text)]
    return not NOISE_WORDS.isdisjoint(words) and all(w in NOISE_WORDS or w in HEADING_WORDS for w in words)


def read_page(source: str, noisy: Callable[[str], bool] = lambda name: False) -> Page:
    """Pieces of a page in order.  Tags that are not closed end with the element around them.
    ``noisy`` tells which further classes are no content.

    The page's article is the largest element marked as one, if it has a quarter as many words as all
    else that is no noise; other marked articles are then noise, as they are where several are
    marked and none is that large.
    """
    page, open_, at = Page(), Open(), 0
    words: dict[Element | None, int] = {}
    heading = 0

    def text(part: str) -> None:
        if part:
            top = open_.stack[-1]
            piece = Piece(f"word {top.kind}", len(part.split()), part, False, top.noise or top.silent > 0, top.article is not None, top.names, top.article)
            page.pieces.append(piece)
            if not piece.noise:
                words[top.article] = words.get(top.article, 0) + piece.words

    def headed(level: int) -> None:
        """At a heading's end: it and what follows it in its parent are noise if it says so."""
        said = page.pieces[heading:]
        if heads_noise(html.unescape("".join(x.text for x in said))):
            open_.stack[-1].silent = open_.stack[-1].silent or level
            for piece in said:
                piece.noise = True

    for start, after, kind, name, attrs in tokens(source):
        text(source[at:start])
        at = after
        if not kind:
            continue
        if kind == "raw":
            page.pieces.append(Piece(f"tag {name} {open_.stack[-1].kind}", block=True))
            continue
        inline = name in INLINE
        if name not in VOID:
            if kind == "end":
                was = open_.headings
                open_.end((name,), () if inline or name != "p" else ("div", "section", "article", "td"))
                if was > open_.headings and name in HEADINGS:
                    headed(int(name[1]))
            else:
                if not inline:
                    open_.end(("p", *HEADINGS) if name in HEADINGS else ("p",), ("div", "section", "article", "td", "li", "blockquote", "button"))
                if name in ENDS:
                    for _ in ENDS[name][0].split():
                        open_.end(tuple(ENDS[name][0].split()), ENDS[name][1])
                if name in HEADINGS:
                    heading = len(page.pieces)
                    if open_.stack[-1].silent >= int(name[1]):
                        open_.stack[-1].silent = 0
                open_.push(_element(name, attrs, open_.stack[-1], noisy))
        top = open_.stack[-1]
        page.pieces.append(Piece(f"tag {name} {top.kind}", block=not inline, noise=top.noise, content=top.article is not None, article=top.article))
    text(source[at:])
    _choose_article(page, words)
    return page


def _choose_article(page: Page, words: dict[Element | None, int]) -> None:
    articles = sorted((a for a in words if a is not None), key=lambda a: -words[a])
    main = articles[0] if articles and 4 * words[articles[0]] >= sum(words.values()) - words[articles[0]] else None
    page.labelled = main is not None
    for piece in page.pieces:
        if piece.article is not None and piece.article is not main:
            piece.content = False
            piece.noise |= main is not None or len(articles) > 1


def _element(name: str, attrs: str, parent: Element, noisy: Callable[[str], bool]) -> Element:
    given = [w for g in NAMING.findall(attrs) for w in "".join(g).lower().split()] if attrs else []
    named = sorted({w for g in given for w in PARTS.findall(g)})
    if name in HEADINGS:  # a heading's header is no page's
        named = [w for w in named if w != "header"]
        given = [g for g in given if "header" not in PARTS.findall(g)]
    inside = parent.article is not None
    noise = parent.noise or parent.silent > 0 or name in NOISE_ELEMENTS or names_noise(given) or inside and (name == "article" and parent.article.name == name or any(map(noisy, given)))
    content = inside or name in CONTENT_ELEMENTS and not noise
    special = noise or name not in INLINE and name not in LEAVES and (content or bool(named) or name in ("td", "table", "ul", "ol", "section"))
    kind = parent.kind if noise and parent.noise or not special else ".".join([name, *named[:3]])
    out = Element(name, kind, noise, content, (*given, *parent.names)[:NAMES], parent.article)
    if content and not inside:
        out.article = out
    return out


def bucket(feature: str, p: Params) -> int:
    return zlib.crc32(feature.encode()) % p.buckets


def count_features(pages: DataFrame, html_col: str, p: Params) -> DataFrame:
    """How often each feature, by bucket, stands in and outside the marked articles of labelled
    pages; ``tags`` and ``classes`` tell how often as a tag, and as a class of what stands around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, p.buckets), np.int64)
        for batch in batches:
            for raw in raw_texts(batch.column(0)):
                page = read_page(raw.decode("utf-8", "replace"))
                if page.labelled:
                    for piece in page.pieces:
                        at, n = bucket(piece.feature, p), max(1, piece.words)
                        sums[0 if piece.labelled else 1, at] += n
                        if not piece.text:
                            sums[2, at] += n
                        for name in set(piece.names):
                            at = bucket(f"class {name}", p)
                            sums[0 if piece.content else 1, at] += n
                            sums[3, at] += n
        some = np.flatnonzero(sums[0] + sums[1])
        columns = [some.astype(np.int32), *(sums[k, some] for k in range(4))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "inside", "outside", "tags", "classes"])

    small_batches(pages.sparkSession, 128)
    counted = pages.select(html_col).mapInArrow(run, "bucket int, inside long, outside long, tags long, classes long")
    return counted.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("inside", "outside", "tags", "classes")))


def fit(pages: DataFrame, html_col: str = "html", p: Params = Params()) -> dict[int, float]:
    """Weights by bucket: log odds of a feature in an article, made positive for words that may
    be content and negative for tags, and for the classes of elements.  Without labelled pages there are none, and
    :func:`extract` falls back on the fixed ones of :class:`Params`.  The driver reads at most
    ``buckets`` rows of sums."""
    rows = count_features(pages, html_col, p).toArrow()
    at, inside, outside, tags, classes = (rows[c].to_numpy() for c in rows.column_names)
    odds = np.log((inside + p.smoothing) / (inside.sum() + p.smoothing)) - np.log((outside + p.smoothing) / (outside.sum() + p.smoothing))
    tag = 2 * tags > inside + outside
    named = 2 * classes > inside + outside
    known = np.where(inside + outside >= p.least_words, odds, 0.0)
    weight = np.where(tag, np.clip(odds, -p.most, p.least_tag), np.clip(odds, p.noise_word, p.most))
    weight = np.where(named, known, weight)
    return dict(zip(at.tolist(), weight.tolist(), strict=True))


def score(piece: Piece, weights: dict[int, float], p: Params, marked: bool) -> float:
    """A piece's score; ``marked`` if the page has its article marked, outside of which no word is content."""
    at = bucket(piece.feature, p)
    if piece.text:
        if piece.noise or marked and not piece.content:
            # Inside an article it is skipped either way and must not cut the article in two.
            return 0.0 if piece.content else piece.words * min(p.noise_word, weights.get(at, p.noise_word))
        return piece.words * weights.get(at, p.word)
    return p.least_tag if piece.content else min(p.least_tag, weights.get(at, p.tag))


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch of the highest sum; of equals the first,
    and an empty one if no sum is positive."""
    best, low, high, run, start = 0.0, 0, 0, 0.0, 0
    for k, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += x
        if run > best:
            best, low, high = run, start, k + 1
    return low, high


def main_text(source: str, weights: dict[int, float], p: Params = Params()) -> str:
    """The main text of one page: blocks in order, white space as single spaces."""
    page = read_page(source, lambda name: weights.get(bucket(f"class {name}", p), 0.0) <= p.noise_class)
    pieces = page.pieces
    low, high = best_stretch([score(x, weights, p, page.labelled) for x in pieces])
    parts = []
    for piece in pieces[low:high]:
        if piece.block:
            parts.append(" ")
        elif piece.text:
            parts.append(" " if piece.noise else html.unescape(piece.text))
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, weights: dict[int, float], html_col: str = "html", also: tuple[str, ...] = (), p: Params = Params()) -> DataFrame:
    """``also`` columns with ``text`` and ``n_chars`` for every row.

    The whole page counts; a null or blank page, or one without words that score, gives the
    empty text.  Repeated rows get a row each, no rows give no rows, and columns of ``also``
    named like the two give way.  The weights are broadcast; :class:`Params` bounds their number.
    """
    spark, also = pages.sparkSession, carried(also, ("text", "n_chars"))
    sent = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            texts = [main_text(raw.decode("utf-8", "replace"), w, p) for raw in raw_texts(batch.column(0))]
            out = [*batch.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, [*also, "text", "n_chars"])

    small_batches(spark, 128)
    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in also]
    return pages.select(F.col(html_col).alias("_html"), *also).mapInArrow(
        run, ", ".join([*kinds, "text string", "n_chars long"])
    )
