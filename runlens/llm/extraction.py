"""Main text of HTML pages as a maximum-scoring subsequence.

A page is a sequence of tokens.  Words score positive, more so in places where labelled pages
have their content; tags score negative, more so those that stand outside of it.  One linear
scan finds the contiguous region with the highest sum, and its blocks of text are the result.
Labelled pages are those that mark their content with a single article or main element.

Fixed lists say what is no text of a page wherever it stands: elements such as nav or form, elements hidden by an
attribute, and elements whose class, id or role is named after a part such as a sidebar.  A name sets apart only what is
less than half of the page's words, as wrappers of the whole page have such names, too.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm.common import checkpointed, query, read, small_batches

MAX_LABELLED = 2000
LEAST_MET = 3

# Comments, declarations, elements with raw text, tags, text.  A quote that is never closed is an ordinary character.
_ATTRIBUTES = r"((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(script|style|textarea|title|noscript|iframe|xmp)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*){_ATTRIBUTES}>"
    r"|[^<]+|<",
    re.S | re.I,
)
# Where a tag has no end, the tags after it end before the next one begins.
SHORT_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<()()(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|[^<]+|<", re.S | re.I)
TAG_BEGINS = re.compile(r"/?[a-zA-Z]")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

CONTENT = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements that are never part of the main text.
APART = set(
    "head nav header footer aside form button select option fieldset label menu dialog template svg math canvas object audio video map".split()
)
# Names of such parts in class, id and role, what may follow them in a compound ("comment-list"), and what turns
# the meaning round before them ("has-sidebar").
APART_NAMES = set(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice alert popup modal newsletter subscribe"
    " sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer comment comments reply replies"
    " respond disqus share sharing social related recommended widget toolbar search login complementary contentinfo".split()
)
FOLLOWING = set(
    "list box area section wrapper wrap container block inner bar item items slot unit link links post posts article articles story stories"
    " form text top bottom left right main primary secondary global site page button buttons icon icons".split()
)
TURNING = set("has no not without with is hide show toggle".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
# An opening tag of the first kind ends an open element of the second.
CLOSES = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
BLOCKS_END_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def tokenised(source: str) -> Iterator[re.Match]:
    """The tokens of a page; a part that never ends is looked at once."""
    at, token = 0, TOKEN
    while at < len(source):
        m = token.match(source, at)
        if token is TOKEN and m[0] == "<" and TAG_BEGINS.match(source, at + 1):
            token = SHORT_TOKEN
            m = token.match(source, at)
        yield m
        at = m.end()


def _is_name(word: str) -> bool:
    """Whether a word of a class, id or role names a part that is set apart."""
    parts = [p for p in re.split("[_-]", word.lower()) if p]
    if not parts or parts[0] in TURNING:
        return False
    after = APART_NAMES | FOLLOWING
    return any(p in APART_NAMES and all(q in after or q.isdigit() for q in parts[i + 1 :]) for i, p in enumerate(parts))


def marks(attributes: str) -> tuple[bool, bool]:
    """Whether an element is hidden by an attribute, and whether it is named as a part that is set apart."""
    hidden = named = False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            named = named or any(map(_is_name, value.split()))
        elif name == "hidden":
            hidden = True
        elif name == "style":
            hidden = hidden or re.search(r"display\s*:\s*none", value, re.I) is not None
        elif name == "aria-hidden":
            hidden = hidden or value.strip().lower() == "true"
    return hidden, named


class Page:
    """The tokens of a page: (kind, value, place).

    ``text`` tokens have the decoded text, ``open`` and ``close`` tokens the tag's name.  The
    place of a token is the name of its nearest block element.  Text in elements set apart is
    kept as ``apart``; it scores nothing and is never part of the result.  The time is linear in the page's length.
    """

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str, str]] = []
        # Per token whether it stands in an element set apart for its kind, and the spans of those set apart by name.
        self.fixed: list[bool] = []
        self.named: list[list[int]] = []
        # Open elements: name, set apart, its span if by name, nearest block, how many elements below are left without inline ones.
        self.stack: list[tuple[str, bool, list[int] | None, str, int]] = []
        self.open: dict[str, int] = {}
        self.apart = 0
        for m in tokenised(source):
            raw, name = m[0], m[4]
            if name is None:
                if raw[0] == "<" and (len(raw) > 1 or m[1]):
                    continue
                self._add("text", entities.unescape(raw), self.stack[-1][3] if self.stack else "")
            elif m[3]:
                self._close(name.lower())
            else:
                self._open(name.lower(), m[5])
        self._cut(0)
        self._set_apart()

    def _add(self, kind: str, value: str, place: str = "") -> None:
        self.tokens.append((kind, value, place))
        self.fixed.append(self.apart > 0)

    def _cut(self, at: int) -> None:
        """Close the open elements from one on."""
        while len(self.stack) > at:
            name, flag, span, _, _ = self.stack.pop()
            self.open[name] -= 1
            self.apart -= flag
            if span:
                span.append(len(self.tokens))

    def _close(self, name: str) -> None:
        if self.open.get(name):
            at = len(self.stack) - 1
            while self.stack[at][0] != name:
                at -= 1
            self._cut(at)
        self._add("close", name)

    def _open(self, name: str, attributes: str) -> None:
        if name in CONTENT and self.apart:
            # An element set apart was never closed: content is no part of it.
            self._cut(0)
        ends = CLOSES.get(name, set()) | ({"p"} if name in BLOCKS_END_P else set())
        if any(self.open.get(e) for e in ends):
            at = len(self.stack)
            while at:
                at = self.stack[at - 1][4]
                if not at or self.stack[at - 1][0] not in ends:
                    break
                at -= 1
                self._cut(at)
        self._add("open", name)
        if name in VOID or attributes.endswith("/"):
            return
        hidden, named = marks(attributes) if attributes else (False, False)
        flag = name in APART or hidden
        span = None
        if named and not flag and name not in CONTENT | {"html", "body"}:
            span = [len(self.tokens) - 1]
            self.named.append(span)
        self.apart += flag
        inline = name in INLINE
        below = self.stack[-1] if self.stack else None
        place = (below[3] if below else "") if inline else name
        blocks = (below[4] if below else 0) if inline else len(self.stack) + 1
        self.stack.append((name, flag, span, place, blocks))
        self.open[name] = self.open.get(name, 0) + 1

    def _set_apart(self) -> None:
        """Text set apart for its element's kind, or by the name of an element with less than half of the other words."""
        words = [0]
        for (kind, value, _), fixed in zip(self.tokens, self.fixed, strict=True):
            words.append(words[-1] + (len(value.split()) if kind == "text" and not fixed else 0))
        edges = [0] * (len(self.tokens) + 1)
        for first, last in self.named:
            if 2 * (words[last] - words[first]) < words[-1]:
                edges[first] += 1
                edges[last] -= 1
        inside = 0
        for i, (kind, value, place) in enumerate(self.tokens):
            inside += edges[i]
            if kind == "text" and (inside or self.fixed[i]):
                self.tokens[i] = ("apart", value, place)

    def inside(self) -> list[bool] | None:
        """For a labelled page, whether each token lies in its content element."""
        opened = [i for i, (kind, name, _) in enumerate(self.tokens) if kind == "open" and name in CONTENT]
        if len(opened) != 1:
            return None
        name = self.tokens[opened[0]][1]
        closed = next((i for i in range(len(self.tokens) - 1, -1, -1) if self.tokens[i][:2] == ("close", name)), len(self.tokens))
        return [opened[0] <= i <= closed for i in range(len(self.tokens))]


def feature(token: tuple[str, str, str]) -> str:
    """What the weight of a token depends on: a tag's name, or the block a word stands in."""
    kind, value, place = token
    return f"word {place}" if kind == "text" else f"tag {value}" if kind in ("open", "close") else "apart"


def count_features(source: str | None) -> dict[str, tuple[int, int]]:
    """Of a labelled page: for each feature the tokens (of text: the words) inside and outside its content."""
    page = Page(source or "")
    inside = page.inside()
    found: dict[str, tuple[int, int]] = {}
    for token, content in zip(page.tokens, inside, strict=True) if inside is not None else ():
        n = len(token[1].split()) if token[0] == "text" else 1
        name = feature(token)
        a, b = found.get(name, (0, 0))
        found[name] = (a + n * content, b + n * (not content))
    return found


def weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Words: from 0.05 to 2, tags: from -12 to -0.05, by the log odds of standing inside the content."""

    def odds(inside: int, outside: int) -> float:
        return math.log((inside + 1) / (outside + 1))

    found = {}
    for name, (a, b) in counts.items():
        if name.startswith("word "):
            found[name] = min(2.0, max(0.05, 0.5 + odds(a, b) / 4))
        elif name.startswith("tag "):
            found[name] = min(-0.05, max(-12.0, -0.5 + 2 * min(0.0, odds(a, b)) + min(0.4, max(0.0, odds(a, b)) / 10)))
    return found


DEFAULT_WORD, DEFAULT_TAG = 0.5, -1.0


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last place (exclusive) of the contiguous region with the highest sum; empty if nothing is positive.

    Of equal sums the region that ends first is taken.
    """
    best = total = 0.0
    start = first = last = 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, first, last = total, start, i + 1
    return first, last


def main_text(source: str | None, learned: dict[str, float]) -> str:
    tokens = Page(source or "").tokens
    scores = []
    for token in tokens:
        kind = token[0]
        if kind == "text":
            scores.append(len(token[1].split()) * learned.get(feature(token), DEFAULT_WORD))
        elif kind == "apart":
            scores.append(0.0)
        else:
            scores.append(learned.get(feature(token), -0.05 if token[1] in INLINE else DEFAULT_TAG))
    first, last = best_region(scores)
    parts: list[str] = []
    for kind, value, _ in tokens[first:last]:
        if kind == "text":
            parts.append(value)
        elif kind != "apart" and value not in INLINE:
            parts.append(" ")
    return " ".join("".join(parts).split())


def learn(pages: DataFrame, html: str = "html", max_pages: int = MAX_LABELLED) -> dict[str, float]:
    """Weights from at most ``max_pages`` labelled pages, those with the lowest hashes of their text.

    Tasks count features, Spark sums them; the driver gets one row per tag name met ``LEAST_MET`` times, others keep the default.
    """
    labelled = pages.filter(F.col(html).rlike("(?i)<(article|main)[\\s>]"))
    digest = F.xxhash64(html)
    # Hashes only: the sample's limit is a number, so the texts are not sorted or moved.
    ranked = checkpointed(labelled.select(digest.alias("h")).orderBy("h").limit(max_pages))
    bound = ranked.agg(F.max("h")).first()[0]
    if bound is None:
        return {}
    kind = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))

    @F.pandas_udf(kind)
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"name": n, "a": a, "b": b} for n, (a, b) in count_features(t).items()] for t in texts])

    rows = labelled.filter(digest <= bound).select(F.explode(count(html)).alias("f")).groupBy("f.name")
    summed = rows.agg(F.sum("f.a").alias("a"), F.sum("f.b").alias("b")).filter(F.col("a") + F.col("b") >= LEAST_MET)
    return weights({r["name"]: (r["a"], r["b"]) for r in summed.collect()})


def text_column(learned: dict[str, float]):
    @F.pandas_udf(T.StringType())
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, learned) for p in pages], dtype=object)

    return extract


def extract_text(pages: DataFrame, html: str = "html", learned: dict[str, float] | None = None, out: Column | str = "text") -> DataFrame:
    """All columns of ``pages`` but the html, and the main text (empty if there is none), as ``out``.

    NULL is an empty page; a page without tags is one block of words.  Without labelled pages
    fixed default weights are used.  Rows given twice give the same text; none is dropped.  An empty table gives no
    rows; a page of any length is read once, from its first to its last character.
    """
    small_batches(pages.sparkSession)
    learned = learn(pages, html) if learned is None else learned
    kept = [pages[c] for c in pages.columns if c not in (html, out)]
    return pages.select(*kept, text_column(learned)(pages[html]).alias(out))


@query("op9_extraction")
def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
