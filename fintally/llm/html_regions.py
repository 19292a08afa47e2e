"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; a linear scan finds the contiguous
region with the greatest sum. The weights come from labelled pages: for each tag, how often it stands outside against
inside of the marked article, and likewise for the words of each kind of container. Tags within menus, adverts and
the like are counted apart from the same tags in running text. Words of a marked container (by class, id or role)
that stand mostly outside score nothing. In the article (or main, if there is no article) tags cost nothing, so that no
list, table or link cuts it. Words of blocks that are links as a whole are counted apart, too: where these stand mostly
outside, a region doesn't begin or end with them, so that menus around it go and lists of links within it stay. Within the region the text of menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments is left out, and what is hidden.

A class, id or role marks an element of any name if all parts of the name between hyphens are marks or words of layout:
cookie-banner and site-header do, side-effects, search-results and article-header don't. Inside of article and main only
the marks of INNER count there.

Blocks follow page order, joined by one space; white space within a block is one space; character references are
decoded; nothing else is dropped or capped.

Cases: a null or empty page, or one without words, has the empty text; pages count whole; broken markup is read as it
stands (an unclosed container ends with its parent, an article starts afresh); equal sums go to the first and longest
region; repeated rows give repeated results; extra columns are kept, and columns named as the results are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.llm.common import slices, table

#: Labelled pages that the weights are learned from at most: those with the least hash of the id.
SAMPLE = 400
WORD, LIGHTEST, HEAVIEST = 1.0, 0.02, 8.0
#: A block is one of links if this share of its words stands in them.
LINKED = 0.9

# HTML element names by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("nav header footer aside form div section article main ul ol dl table menu figure fieldset dialog body template noscript".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog template noscript button select textarea".split())
MAIN = frozenset(("article", "main"))
#: Parts of lists and tables; like inline tags they are no sign of an end unless the labelled pages say so.
FLOW = INLINE | frozenset("ul ol li dl dt dd table caption colgroup col thead tbody tfoot tr td th p br".split())
# Words of class, id and role that mark what is not the article; of those, what marks inside of it too; words of layout.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs
    comment comments discussion reply replies disqus cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe signup
    login search share sharing social related recommended widget header footer masthead toolbar contentinfo complementary""".split()
)
INNER = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs
    comment comments disqus cookie cookies consent notice notices popup modal newsletter subscribe signup login share sharing contentinfo complementary""".split()
)
LAYOUT = frozenset("site page top bottom left right box wrapper wrap container block list bar links link area inner outer row col unit slot form buttons main primary secondary reader user posts".split())
#: A tag's attributes are disjoint alternatives, taken whole; no part of a tag passes another tag's start, so that a scan is linear.
_INSIDE = r"(?:[^<>\"']|<(?![A-Za-z/!?]))"
_QUOTED = r"\"(?:[^<\"]|<(?![A-Za-z/!?]))*+\"|'(?:[^<']|<(?![A-Za-z/!?]))*+'"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|noscript|template|svg|iframe)\b[^<>]*>.*?(?:</\1\s*>|\Z)"
    rf"|<[/!?]?[A-Za-z](?:{_INSIDE}|{_QUOTED})*+>"
    r"|<[/!?]?[A-Za-z][^<>]*>"  # with a stray quote
    r"|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
NAME = re.compile(r"</?\s*([A-Za-z][A-Za-z0-9:-]*)")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.IGNORECASE)


def marked(names: str, inside: bool) -> bool:
    """Whether a class, id or role among names marks what is no part of the article."""
    own = INNER if inside else MARKS
    for name in names.lower().split():
        parts = [x for x in re.split("[-_]+", name) if x]
        if any(x in own for x in parts) and all(x in own or x in LAYOUT for x in parts):
            return True
    return False


class Token:
    """A piece of text (words > 0 or white space) or a tag, with the kind of its container; home is 2 in an article, 1 in main.

    linked: its block is one of links.
    """

    __slots__ = ("boilerplate", "context", "home", "linked", "tag", "text", "words")

    def __init__(self, tag: str, text: str, words: int, context: str, boilerplate: bool, home: int):
        self.tag, self.text, self.words, self.context, self.boilerplate, self.home = tag, text, words, context, boilerplate, home
        self.linked = False

    @property
    def inline(self) -> bool:
        return self.tag.removeprefix("/").split(".")[0] in INLINE

    @property
    def key(self) -> str:
        """The tag as it is counted: apart if it belongs to a menu, an advert and the like."""
        return f"~{self.tag}" if self.boilerplate else self.tag


def tokens(page: str) -> list[Token]:
    out: list[Token] = []
    stack: list[tuple[str, str, bool, int]] = [("body", "body", False, 0)]  # name, kind, boilerplate, home
    opened: Counter = Counter()
    for m in TOKEN.finditer(page):
        raw = m.group()
        _, kind, plain, home = stack[-1]
        if raw[0] != "<" or raw == "<":
            text = html.unescape(raw)
            out.append(Token("", text, len(text.split()), kind, plain, home))
            continue
        if raw.startswith(("<!", "<?")):
            continue
        if m.group(1):  # its content is no text of the page
            out.append(Token(m.group(1).lower(), "", 0, kind, plain, home))
            continue
        found = NAME.match(raw)
        name = found.group(1).lower() if found else ""
        if raw[1] == "/":
            while opened[name]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    break
            out.append(Token("/" + name, "", 0, kind, plain, home))
            continue
        given = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(raw, found.end())} if found and len(raw) > found.end() + 1 else {}
        marks = " ".join(v for k, v in given.items() if k in ("class", "id", "role") and v)
        own = f"{name}.{marks.lower()}" if marks and name not in INLINE else name
        if name not in INLINE and stack[-1][0] == "p":  # a paragraph ends where the next block begins
            opened[stack.pop()[0]] -= 1
            _, kind, plain, home = stack[-1]
        outer, inside = plain, any(opened[m] for m in MAIN)
        if name not in MAIN:
            unshown = "hidden" in given or bool(UNSHOWN.search(given.get("style", "")))
            plain = plain or name in BOILERPLATE or (name == "header" and not inside) or unshown or (bool(marks) and marked(marks, inside))
        if name in CONTAINERS and not raw.endswith("/>"):
            plain = plain and name not in MAIN
            stack.append((name, own, plain, max(home, {"article": 2, "main": 1}.get(name, 0)) if not (name in MAIN and outer) else 0))
            opened[name] += 1
        elif name not in VOID and not raw.endswith("/>") and (plain != outer or opened[name]):  # a marked element, or one of its name within it
            stack.append((name, kind, plain, home))
            opened[name] += 1
        out.append(Token(own if name in CONTAINERS else name, "", 0, kind, plain, home))
    return with_links(out)


def with_links(seq: list[Token]) -> list[Token]:
    """seq with linked set on the tokens of blocks whose words stand in links by the share of LINKED or more."""
    start, depth, words, links = 0, 0, 0, 0
    for i, t in enumerate([*seq, Token("/body", "", 0, "body", False, 0)]):
        if t.tag and not t.inline:
            if links and links >= LINKED * words:
                for own in seq[start:i]:
                    own.linked = True
            start, depth, words, links = i + 1, 0, 0, 0
        elif t.tag == "a":
            depth = 1  # links don't nest
        elif t.tag == "/a":
            depth = 0
        words += t.words
        links += t.words if depth else 0
    return seq


def outside_and_inside(page: str) -> tuple[Counter, Counter]:
    """Counts of tags, and of words by container, outside and inside of the page's article element; boilerplate tags apart."""
    counts, inside = (Counter(), Counter()), 0
    for t in tokens(page):
        if t.tag == "/article":
            inside = 0
        key, n = (t.key, 1) if t.tag else (f"words in {t.context}", t.words)
        if n and (t.tag or not t.boilerplate):
            counts[inside][key] += n
        if t.linked and t.words:
            counts[inside]["words in links"] += t.words
        if t.tag.split(".")[0] == "article":
            inside = 1
    return counts


class Weights:
    """The weight of each tag, and the containers whose words score nothing."""

    def __init__(self, outside: dict[str, int], inside: dict[str, int]):
        odds = {k: math.log((outside.get(k, 0) + 0.5) / (inside.get(k, 0) + 0.5)) for k in {*outside, *inside}}
        self.tag = {k: -min(HEAVIEST, max(LIGHTEST, x)) for k, x in odds.items() if not k.startswith("words in ")}
        # an element's name alone never mutes its words
        self.mute = {k.removeprefix("words in ") for k, x in odds.items() if k.startswith("words in ") and "." in k and x > 0}
        self.mute = {k for k in self.mute if k.split(".")[0] not in MAIN}
        self.mute_links = odds.get("words in links", 1.0) > 0  # without any such block, links count as menus
        self.unseen = -0.5

    def weight(self, t: Token) -> float:
        """The weight of a tag that stands outside of the marked article."""
        name = t.tag.split(".")[0]
        known = self.tag.get(t.key, self.tag.get(f"~{name}" if t.boilerplate else name))
        if known is not None:
            return known
        return -HEAVIEST if t.boilerplate else -LIGHTEST if name.removeprefix("/") in FLOW else self.unseen

    def muted(self, t: Token) -> bool:
        return t.boilerplate or (not t.home and t.context in self.mute)

    def region(self, seq: list[Token]) -> tuple[int, int]:
        """Begin and end of the contiguous tokens with the greatest sum, by one scan."""
        best, span, total, start = 0.0, (0, 0), 0.0, 0
        home = 2 if any(t.home == 2 and t.words and not t.boilerplate for t in seq) else 1
        for i, t in enumerate(seq):
            if t.tag:
                total += self.weight(t) if t.home < home else 0.0
            elif not self.muted(t):
                total += WORD * t.words
            if total < 0:
                total, start = 0.0, i + 1
            elif total > best:
                best, span = total, (start, i + 1)
        return span

    def trimmed(self, seq: list[Token], begin: int, end: int) -> tuple[int, int]:
        """The region without blocks of links at its begin and its end, outside of the article."""
        edge = lambda t: t.tag or not t.words or self.muted(t) or (t.linked and not t.home)
        while self.mute_links and begin < end and edge(seq[begin]):
            begin += 1
        while self.mute_links and begin < end and edge(seq[end - 1]):
            end -= 1
        return begin, end

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        seq = tokens(page)
        begin, end = self.trimmed(seq, *self.region(seq))
        blocks: list[str] = []
        block: list[str] = []
        for t in seq[begin:end]:
            if t.tag:
                if t.tag.removeprefix("/").split(".")[0] not in INLINE:
                    blocks.append("".join(block))
                    block = []
            elif not self.muted(t):
                block.append(t.text)
        return " ".join(w for b in [*blocks, "".join(block)] for w in b.split())


def fit(pages: DataFrame) -> Weights:
    """Weights from pages that mark their article themselves, SAMPLE of them at most."""
    labelled = pages.select("page_id", "html").where(F.col("html").rlike("(?i)<article[ >]"))
    chosen = labelled.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outside, inside = Counter(), Counter()
        for part in slices(batches, "html"):
            for page in part.column("html").to_pylist():
                out, own = outside_and_inside(page)
                outside.update(out)
                inside.update(own)
        keys = sorted({*outside, *inside})
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([outside[k] for k in keys], pa.int64()), pa.array([inside[k] for k in keys], pa.int64())], names=["key", "outside", "inside"])

    # the sample is bounded, so it is broadcast
    counted = labelled.join(F.broadcast(chosen), "page_id").select("html").mapInArrow(count, "key string, outside long, inside long")
    rows = counted.groupBy("key").agg(F.sum("outside").alias("o"), F.sum("inside").alias("i")).collect()  # tags of SAMPLE pages
    return Weights({r["key"]: r["o"] for r in rows}, {r["key"]: r["i"] for r in rows})


def extracted(df: DataFrame, weights: Weights, *, html_col: str = "html") -> DataFrame:
    """df with text and n_chars."""
    kept = [f for f in df.schema.fields if f.name not in ("text", "n_chars")]
    schema = type(df.schema)([*kept]).add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, html_col):
            texts = [weights.extract(p) for p in part.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    pages = table(spark, sf_dir, "pages")
    return extracted(pages.select("page_id", "url", "html"), fit(pages)).select("page_id", "url", "text", "n_chars")
