"""Main text of web pages as a maximum-scoring run of tokens.

A page is read as a sequence of words and tags; only what is never shown as text (scripts, styles, controls, comments, hidden
elements) is left out from the start. Words score positive and tags negative, and one linear scan finds the contiguous run with
the largest sum: the content region. Its words, without the tags, are the text.

The weights come from labelled pages: those whose authors marked the content with one article or main element. Over about
SAMPLE of them, chosen by a hash of page_id and page, tags are counted inside the marked element, and outside where nothing else tells
an element apart. The words outside are counted for the outermost element around them that does not hold the marked one, the words inside for all elements between,
by the elements' features (name, classes, id, role). An element whose features stand outside is boilerplate: entering it costs
as much as its odds say, its words count nothing and are no part of the text, even within the region. Before any page is seen,
features that say so themselves (FURNITURE) count as seen outside PRIOR times; pages that use them for content overrule that.
A page's own header inside its article, and a boilerplate element that holds an article, or most of the page and is a form, or most of
the page and its h1 and is known by its own word alone, are content.

Blocks are joined by one blank; line breaks and block elements end a block, inline elements do not. Nulls: a null page is
empty. A page without text gives the empty string; an unclosed element ends with its parent, a broken tag at the end of a page
is dropped. Repeated pages are read each; an empty table gives no rows. A caller's columns text and n_chars come back as
page_text and page_n_chars. A very long page takes some hundred bytes for each of its tags and text runs.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinegrid.llm.common import table

#: Labelled pages that the scores are learned from, about, and tags (and features) that get a score of their own.
SAMPLE, TAGS = 2000, 50_000
#: Costs a tag at least and at most; a tag never seen; how much an even chance of lying outside counts.
LEAST, MOST, UNSEEN, STRENGTH = 0.05, 60.0, 0.2, 5.0
#: Words that a feature of FURNITURE counts as seen outside before any page; odds (log) below which an element is boilerplate.
PRIOR, OUTSIDE = 20, -1.0

UNSHOWN = set("head script style noscript template iframe object svg canvas audio video button select textarea datalist map title".split())
RAW = set("script style textarea title noscript iframe template".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
MARKS = ("article", "main")
GENERIC = ("div", "span", "section")
#: Names, roles and words of classes and ids that announce something else than content; PLACES may stand beside them.
FURNITURE = set(
    "nav header footer aside form dialog menu navigation banner contentinfo complementary search alert alertdialog menubar toolbar "
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promotions banners navbar menus breadcrumb breadcrumbs "
    "sidebar sidebars widget widgets masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments commentlist disqus respond reply replies pagination pager copyright".split()
)
PLACES = set("site page main top bottom left right box block area wrapper container list bar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<([!?])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[^a-z0-9]+")


def features(name: str, attributes: str) -> tuple[str, ...] | None:
    """What an element is known by; None if it is not shown."""
    found = []
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return None
        if key in ("class", "id", "role"):
            found += [f".{x}" for x in value.split()]
    return tuple(found) if found and name in GENERIC else (name, *found)


def announced(feature: str) -> bool:
    """Whether a feature says itself that it is no content."""
    parts = {x for x in _PART.split(feature) if x}
    return bool(parts & FURNITURE) and parts <= FURNITURE | PLACES


class Page:
    """Tokens (name or "", text or "/", element) and elements (features, parent, under a mark, holds a mark, words, holds an h1)."""

    def __init__(self, page: str):
        self.tokens: list[tuple[str, str, int]] = []
        self.features: list[tuple[str, ...]] = [()]
        self.parent, self.marked, self.holds, self.words, self.titled = [-1], [False], [False], [0], [False]
        stack: list[tuple[str, int]] = []
        unshown = at = element = 0

        def put(name: str, text: str) -> None:
            if not unshown:
                self.tokens.append((name, text, element))
                if not name:
                    self.words[element] += len(text.split())

        while at < len(page):
            m = _TOKEN.search(page, at)
            if not m:
                put("", page[at:])
                break
            if m.start() > at:
                put("", page[at : m.start()])
            at = m.end()
            name = (m[3] or m[6] or "").lower()
            if not name or m[6] and not page[at - 1 : at] == ">":
                continue
            if m[2] or m[5]:
                if any(n == name for n, _ in stack):
                    while True:
                        last, own = stack.pop()
                        if own < 0:
                            unshown -= 1
                        else:
                            element = self.parent[own]
                        if last == name:
                            break
                put(name, "/")
                continue
            if name in RAW:
                if end := re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at):
                    at = end.end()
                elif name != "title":
                    break
                continue
            attributes = m[4] if m[4] is not None else m[7] or ""
            if name in VOID or attributes.endswith("/") and name not in INLINE | {"p", "div"}:
                put(name, "")
                continue
            own = None if name in UNSHOWN else features(name, attributes)
            if own is None or unshown:
                unshown += own is None
                stack.append((name, -1 if own is None else element))
                if own is not None:  # shown, but inside something that is not
                    stack[-1] = (name, self._add(own, element, name))
                    element = stack[-1][1]
                continue
            element = self._add(own, element, name)
            stack.append((name, element))
            put(name, "")
        for k in range(len(self.parent) - 1, 0, -1):
            self.words[self.parent[k]] += self.words[k]
            self.holds[self.parent[k]] |= self.holds[k]
            self.titled[self.parent[k]] |= self.titled[k]

    def _add(self, own: tuple[str, ...], parent: int, name: str) -> int:
        self.features.append(own)
        self.parent.append(parent)
        self.marked.append(self.marked[parent] or name in MARKS)
        self.holds.append(name in MARKS)
        self.titled.append(name == "h1")
        self.words.append(0)
        return len(self.parent) - 1

    def boilerplate(self, odds: dict[str, float]) -> list[float]:
        """The odds of each element that is boilerplate or inside one, 0 for all others."""
        out = [0.0]
        for k in range(1, len(self.parent)):
            if out[up := self.parent[k]]:
                out.append(out[up])
                continue
            own = [f for f in self.features[k] if not (f == "header" and self.marked[up])]
            low = min((odds.get(f, PRIOR_ODDS if announced(f) else 0.0) for f in own), default=0.0)
            learned = any(f in odds for f in own)
            wraps = self.holds[k] or ("form" in own or self.titled[k] and not learned) and 2 * self.words[k] >= self.words[0]
            out.append(low if low < OUTSIDE and not wraps else 0.0)
        return out


PRIOR_ODDS = log(1 / (PRIOR + 1))


def is_labelled(page: str) -> bool:
    return len(re.findall(r"<(?:article|main)[\s>]", page, re.I)) == 1


def evidence(page: str) -> Counter:
    """Counts by (kind: "tag", "word" or "feature"; name; inside) of a labelled page."""
    read, seen = Page(page), Counter()
    for name, text, element in read.tokens:
        inside = read.marked[element]
        if name:
            up = read.parent[element]
            unexplained = read.features[element] == (name,) and not read.holds[element] and (up <= 0 or read.holds[up])
            if inside or unexplained and text != "/":
                seen["tag", name, inside] += 1
            continue
        if not (n := len(text.split())):
            continue
        seen["word", "", inside] += n
        top = element
        if inside:
            while read.marked[read.parent[top]]:  # all elements below the marked one
                for f in read.features[top]:
                    seen["feature", f, True] += n
                top = read.parent[top]
        elif not read.holds[top]:
            while read.parent[top] > 0 and not read.holds[read.parent[top]]:
                top = read.parent[top]
            for f in read.features[top]:
                seen["feature", f, False] += n
    return seen


def learn(pages: DataFrame, sample: int = SAMPLE, tags: int = TAGS) -> dict[tuple[str, str], float]:
    """Weights by (kind, name): costs of tags (negative), the worth of a word, odds of features. At most `tags` of each kind, the most frequent."""
    whole = pages.where("html IS NOT NULL")
    n = whole.count()
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "html"), F.lit(1 << 30)) / float(1 << 30)
    chosen = whole.where(draw < F.lit(min(1.0, sample / max(1, n)))).select("html")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                if is_labelled(page):
                    seen.update(evidence(page))
        rows = [(kind, name, n if inside else 0, 0 if inside else n) for (kind, name, inside), n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["kind", "name", "inside", "outside"])

    counts = chosen.mapInArrow(count, "kind string, name string, inside long, outside long").groupBy("kind", "name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(F.col("inside") + F.col("outside")), "name"))
    weights = {("word", ""): 1.0}
    for r in counts.withColumn("place", place).where(F.col("place") <= tags).collect():
        odds = log((r.inside + 1) / (r.outside + 1 + (PRIOR if r.kind == "feature" and announced(r.name) else 0)))
        if r.kind == "tag":
            odds = -min(MOST, max(LEAST, -STRENGTH * odds))
        weights[r.kind, r.name] = min(3.0, max(1.0, odds)) if r.kind == "word" else odds
    return weights


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the largest positive sum, as (start, stop); of equals the first that ends, from its latest start."""
    best = run = 0.0
    start = low = high = 0
    for k, score in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += score
        if run > best:
            best, low, high = run, start, k + 1
    return low, high


def main_text(page: str | None, weights: dict[tuple[str, str], float]) -> str:
    """The words of the best run, blocks joined by one blank."""
    read = Page(page or "")
    worth, odds = weights["word", ""], {name: w for (kind, name), w in weights.items() if kind == "feature"}
    out = read.boilerplate(odds)
    scores = []
    for name, text, element in read.tokens:
        if out[element]:
            enters = name and text != "/" and not out[read.parent[element]] and not read.marked[element]
            scores.append(-min(MOST, -STRENGTH * out[element]) if enters else 0.0)
        else:
            scores.append(weights.get(("tag", name), -UNSEEN) if name else worth * len(text.split()))
    low, high = best_run(scores)
    kept = [" " if name and name not in INLINE else "" if name or out[element] else html.unescape(text) for name, text, element in read.tokens[low:high]]
    return " ".join("".join(kept).split())


def extract(pages: DataFrame, weights: dict[tuple[str, str], float]) -> DataFrame:
    """pages without html, with text and n_chars."""
    names = [c for c in pages.columns if c != "html"]
    rest = pages.select("html", *[F.col(f"`{c}`").alias(f"page_{c}" if c in ("text", "n_chars") else c) for c in names])
    names = rest.columns[1:]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p.as_py(), weights) for p in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=[*names, "text", "n_chars"])

    return rest.mapInArrow(read, rest.drop("html").select("*", F.lit("").cast("string").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages.select("page_id", "url", "html"), learn(pages))


QUERIES = {"op5_html": op5_html}
