"""Main text of web pages by the maximum-scoring subsequence of tags and words.

A page is a sequence of tags, which score negative, and words, which score by
the element they stand in, positive in content. The run with the greatest sum,
found by one linear scan, is the content region. The weights are log odds from
labelled pages, those that mark their content with ``article`` or ``main``
elements: how often a tag, or a word in such an element, lies inside the marked
content and outside. Elements that those pages do not have get default weights:
words straight in a ``div`` or ``span`` score negative, in paragraphs and other
elements of prose positive. What is inserted into an article, such as an advert
or readers' comments, lies within the region and is left out of it afterwards.

The weights are fitted on at most ``train_pages`` pages, those with the smallest
hashes of their ids, and are kept for the ``max_keys`` most frequent elements.

Defined cases: a null or empty page, or one without words, has empty text;
unclosed elements end with the page; unclosed comments and scripts hide the
rest, and a tag that is not closed before the next one is no tag; of regions
with equal sums the longest of the first is taken; repeated rows are read one by
one; an empty table gives an empty result; other columns are not looked at. The
time is in proportion to a page's length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import slices, table, texts_of

TRAIN_PAGES = 2_000
MAX_KEYS = 5_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|svg|math|object)\b(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.IGNORECASE | re.DOTALL,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_MARKED = frozenset(("article", "main"))
#: Elements of prose, whose words count as content where the labelled pages tell nothing.
_PROSE = frozenset("article body blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 hgroup li main p pre section td th".split())
#: Elements that are no content.
_ASIDE_TAGS = frozenset("nav aside footer form button select menu dialog head title".split())
#: Names of what is inserted into articles: adverts, comments, offers to share. A class, id or role has to be one of
#: them as a whole, or with words for whose it is and what holds it: "related-posts", but not "related-work".
_INSERTED = frozenset("ad ads advert advertisement comment comments newsletter promo related share sponsored".split())
_HOLDERS = frozenset("area article articles banner block box buttons container content form inner items links list posts reader readers section signup slot social stories unit user wrapper".split())


def _is_inserted(names: str) -> bool:
    return any((words := set(_WORDS.findall(name))) & _INSERTED and words <= _INSERTED | _HOLDERS for name in names.split())


class _Element:
    __slots__ = ("tag", "key", "aside", "marked")

    def __init__(self, tag: str, attrs: str, parent: _Element | None):
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)).lower() if attrs else ""
        words = set(_WORDS.findall(names))
        self.tag = tag
        inline = tag in _INLINE and parent is not None
        self.key = parent.key if inline and not names else f"{tag}.{names.split()[0]}" if names else tag
        marked = tag in _MARKED or "main" in words or "articlebody" in words
        self.marked = marked or (parent is not None and parent.marked)
        aside = tag in _ASIDE_TAGS or (self.marked and not marked and _is_inserted(names))
        aside = aside or (tag == "header" and not self.marked) or (parent is not None and parent.aside)
        # Of a header within the content only headings count.
        if parent is not None and parent.tag == "header" and parent.marked and not parent.aside and tag not in _HEADINGS:
            aside = True
        self.aside = aside
        if aside and not self.key.startswith("-"):
            self.key = f"-{self.key}"  # a paragraph of a menu is another element than one of the content


def events(page: str) -> Iterator[tuple[str, str, _Element]]:
    """Text and tags in order: ("text", text, element it is in) or ("tag" or "inline", key, element)."""
    root = _Element("body", "", None)
    stack = [root]
    opened: Counter[str] = Counter()  # by tag, so that what is not open is not looked for
    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            yield "text", text, stack[-1]
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        kind = "inline" if tag in _INLINE else "tag"
        if m["close"]:
            top, key = stack[-1], tag
            if opened[tag]:
                while len(stack) > 1:
                    top = stack.pop()
                    opened[top.tag] -= 1
                    if top.tag == tag:
                        break
                key = top.key if kind == "tag" else tag
            yield kind, key, top
            continue
        if kind == "tag" and tag not in _VOID and opened["p"]:
            k = len(stack) - 1
            while k > 0 and stack[k].tag in _INLINE:
                k -= 1
            if stack[k].tag == "p":  # a block ends an open paragraph
                opened.subtract(e.tag for e in stack[k:])
                del stack[k:]
        element = _Element(tag, m["attrs"] or "", stack[-1])
        yield kind, element.key if kind == "tag" else tag, element
        if tag not in _VOID and not (m["attrs"] or "").endswith("/"):
            stack.append(element)
            opened[tag] += 1


#: Weights where the labelled pages tell nothing: of words in asides, in prose and in other elements, and of tags.
_ASIDE, _CONTENT, _OTHER, _TAG = -2.0, 1.0, -1.0, -0.2


class Weights:
    """Weights of words by the element they are in, and of tags."""

    def __init__(self, words: dict[str, float], tags: dict[str, float]):
        self.words, self.tags = words, tags

    def word(self, element: _Element) -> float:
        if element.aside and element.marked:
            return 0.0  # left out later, and no reason to cut the content in two
        w = self.words.get(element.key)
        if w is None:
            return _ASIDE if element.aside else _CONTENT if element.tag in _PROSE or element.tag in _INLINE else _OTHER
        return min(w, -0.5) if element.aside else w

    def tag(self, key: str, element: _Element) -> float:
        return 0.0 if element.aside and element.marked else self.tags.get(key, _TAG)


def count_page(page: str, counts: dict) -> None:
    """Adds a labelled page: counts[(kind, key)] = [inside, outside]."""
    found = list(events(page))
    if not any(e.marked for _, _, e in found):
        return
    for kind, value, element in found:
        if element.marked and element.aside:
            continue  # weighs nothing, see Weights
        inside = element.marked
        if kind == "text":
            counts["word", element.key][not inside] += len(value.split())
        else:
            counts["tag", value][not inside] += 1


def fit(
    pages: DataFrame, id_col: str = "page_id", html_col: str = "html", train_pages: int = TRAIN_PAGES, max_keys: int = MAX_KEYS
) -> Weights:
    """Log odds from a bounded number of labelled pages, for a bounded number of element keys."""
    order = F.xxhash64(F.col(id_col).cast("string"))
    chosen = pages.select(
        F.col(id_col).alias("_id"), order.alias("_order")
    ).where("_id is not null").distinct().orderBy("_order", "_id").limit(train_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = defaultdict(lambda: [0, 0])
        for batch in batches:
            for page in texts_of(batch, html_col):
                count_page(page, counts)
        rows = [(kind, key, *n) for (kind, key), n in counts.items()]
        yield pa.RecordBatch.from_pydict(
            {k: [r[i] for r in rows] for i, k in enumerate(("kind", "key", "inside", "outside"))},
            pa.schema([("kind", pa.string()), ("key", pa.string()), ("inside", pa.int64()), ("outside", pa.int64())])
        )

    # The ids of at most train_pages pages are broadcast.
    rows = pages.select(id_col, html_col).join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select(html_col)
    counted = rows.mapInArrow(run, "kind string, key string, inside long, outside long")
    counted = counted.groupBy("kind", "key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    found = counted.orderBy(F.desc(F.col("inside") + F.col("outside")), "kind", "key").limit(max_keys).collect()
    words, tags = {}, {}
    for kind, key, inside, outside in found:
        odds = math.log((inside + 1) / (outside + 1))
        if kind == "word":
            words[key] = max(-4.0, min(4.0, odds))
        else:
            tags[key] = min(-0.05, max(-6.0, odds))
    return Weights(words, tags)


def extract(page: str, weights: Weights) -> str:
    """The text of the best region, a line pair between blocks."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    found = list(events(page))
    for k, (kind, value, element) in enumerate(found):
        if kind == "text":
            n = len(value.split())
            total += n * weights.word(element) if n else 0.0
        else:
            total += weights.tag(value, element)
        if total > best or (total == best > 0):
            best, best_at = total, (start, k + 1)
        if total <= 0:
            total, start = 0.0, k + 1
    blocks, now = [], []

    def close() -> None:
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    for kind, value, element in found[best_at[0] : best_at[1]]:
        if kind == "tag":
            close()
        elif element.aside:
            continue
        elif kind == "text":
            now.append(html.unescape(value))
        elif value == "br":
            now.append(" ")
    close()
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text)`` for each row."""
    words, tags = weights.words, weights.tags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(words, tags)
        for batch in batches:
            for part in slices(batch, 64):
                texts = [extract(x, own) for x in texts_of(part, html_col)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), part.column(url_col), pa.array(texts, pa.string())], [id_col, url_col, "text"]
                )

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract_pages(pages, fit(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
