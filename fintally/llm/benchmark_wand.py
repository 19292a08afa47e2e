"""Benchmark decontamination with a BM25 index of the test items, searched by block-max WAND.

The inverted index holds the test items; each training passage is a query. Impacts are BM25 weights divided by the
item's own full score, so that a score is the share of an item's weight that a passage covers, and one THRESHOLD fits
all items. Passages are windows of twice the longest item's words, half overlapping: an item lies whole in one of
them. A passage whose terms' greatest impacts stay together below the threshold, over all items and then over each short
range of items, is skipped; the others are searched with block-max WAND, which returns every item at or above the
threshold. A hit is a leak if at least OVERLAP of the
five-word windows of the item's question and of its answer stand in the passage. The answer is the item's last
sentence, the question what precedes it; a single sentence is halved.

The index is broadcast for at most ITEMS test items at once; a larger benchmark is dealt by row number and searched in
one pass for each such block. All blocks share the statistics of the whole benchmark, so that scores don't depend on it.

Cases: null or empty texts have no passages; texts count whole; items without a word are never found; an item without
an id is found as the null item; repeated items and repeated documents give repeated rows; an empty benchmark finds nothing. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.llm.common import slices, table, written

THRESHOLD, OVERLAP, WORDS = 0.5, 0.8, 5
K1, B = 1.2, 0.75
#: Postings of one block, and test items of one index.
POSTINGS, ITEMS = 32, 20_000
#: Items of one range of the bound that comes before the search.
RANGE = 4
#: Bounds of windows and ranges that are held at once.
CELLS = 1 << 21
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def windows(ws: list[str]) -> set[tuple[str, ...]]:
    """The five-word windows; fewer words are one window."""
    return {tuple(ws[i : i + WORDS]) for i in range(max(1, len(ws) - WORDS + 1))} if ws else set()


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    sentences = [w for s in _SENTENCE.split(text.strip()) if (w := words(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    whole = sentences[0] if sentences else []
    half = (len(whole) + 1) // 2
    return whole[:half], whole[half:]


class ItemIndex:
    """Inverted index of test items: postings by item number, in blocks with their greatest impact."""

    def __init__(self, items: list[tuple[int | None, str]], whole: tuple[int, int, int, dict[str, int]] | None = None):
        """whole: number of items, words and longest item of the whole benchmark, and in how many items each term is."""
        self.items = items
        counted = [Counter(words(text or "")) for _, text in items]
        sizes = [sum(c.values()) for c in counted]
        size, n_words, self.longest, df = whole or (len(items), sum(sizes), max(sizes, default=0), Counter(t for c in counted for t in c))
        mean = max(1.0, n_words / max(1, size))
        idf = {t: float(np.log1p((size - df[t] + 0.5) / (df[t] + 0.5))) for t in {t for c in counted for t in c}}
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, c in enumerate(counted):
            weight = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * sizes[i] / mean)) for t, n in c.items()}
            total = sum(weight.values())
            for t, x in weight.items():
                postings[t].append((i, x / total))
        self.number = {t: k for k, t in enumerate(postings)}
        self.docs = [[i for i, _ in p] for p in postings.values()]
        self.impacts = [[x for _, x in p] for p in postings.values()]
        self.block_max = [[max(x[k : k + POSTINGS]) for k in range(0, len(x), POSTINGS)] for x in self.impacts]
        self.greatest = np.array([max(x) for x in self.impacts] + [0.0])  # the last is for unknown words
        # each term's greatest impact within ranges of RANGE items, one list after another
        ranges = [{} for _ in self.docs]
        for own, docs, impacts in zip(ranges, self.docs, self.impacts, strict=True):
            for i, x in zip(docs, impacts, strict=True):
                own[i // RANGE] = max(x, own.get(i // RANGE, 0.0))
        self.range_count = np.array([len(own) for own in ranges] + [0])
        self.range_start = np.cumsum(self.range_count) - self.range_count
        self.range_of = np.array([r for own in ranges for r in own], np.int64)
        self.range_max = np.array([x for own in ranges for x in own.values()])
        self.ranges = len(items) // RANGE + 1
        self.parts = [parts(text or "") for _, text in items]
        self.width = max(2 * self.longest, 64)

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Every item whose impacts for the distinct terms sum to the threshold or more, by block-max WAND."""
        threshold -= 1e-9
        at, live, found = dict.fromkeys(terms, 0), list(terms), []
        docs, impacts = self.docs, self.impacts
        while live:
            live.sort(key=lambda t: docs[t][at[t]])
            bound, pivot = 0.0, None
            for p, t in enumerate(live):
                bound += self.greatest[t]
                if bound >= threshold:
                    pivot = docs[t][at[t]]
                    break
            if pivot is None:
                return found
            while p + 1 < len(live) and docs[live[p + 1]][at[live[p + 1]]] == pivot:
                p += 1
            bound, end = 0.0, len(self.items)
            for t in live[: p + 1]:
                k = bisect.bisect_left(docs[t], pivot, at[t])
                if k < len(docs[t]):
                    bound += self.block_max[t][k // POSTINGS]
                    end = min(end, docs[t][min(len(docs[t]), (k // POSTINGS + 1) * POSTINGS) - 1] + 1)
            if bound >= threshold:
                if docs[live[0]][at[live[0]]] == pivot:
                    score = sum(impacts[t][at[t]] for t in live[: p + 1])
                    if score >= threshold:
                        found.append((pivot, score))
                    goal = pivot + 1
                else:
                    goal = pivot
            else:  # no item before the nearest block end, or before the next list's item, can pass
                goal = end if p + 1 == len(live) else min(end, docs[live[p + 1]][at[live[p + 1]]])
                goal = max(goal, pivot + 1)
            for t in live[: p + 1]:
                at[t] = bisect.bisect_left(docs[t], goal, at[t])
            live = [t for t in live if at[t] < len(docs[t])]
        return found

    def leaks(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item number, score, question overlap, answer overlap) of each item that leaks into a text."""
        ws = words(text) if text else []
        if not ws or not self.items:
            return []
        get, unknown = self.number.get, len(self.docs)
        term = np.array([get(w, unknown) for w in ws])
        step = self.width // 2
        # the terms of each window count once: where the same term was last seen lies before the window
        order = np.argsort(term, kind="stable")
        before = np.full(len(term), -1)
        same = term[order][1:] == term[order][:-1]
        before[order[1:][same]] = order[:-1][same]
        gain, at = self.greatest[term], np.arange(len(term))
        n = max(1, -(-(len(ws) - self.width) // step) + 1)
        # a word lies in the window that starts in its half, and in the one before
        window = np.concatenate([at // step, at // step - 1])
        term, gain, before = np.tile(term, 2), np.tile(gain, 2), np.tile(before, 2)
        fresh = (before < window * step) & (window >= 0) & (window < n) & (term != unknown)
        window, term, gain = window[fresh], term[fresh], gain[fresh]
        likely = np.bincount(window, gain, minlength=n) >= THRESHOLD - 1e-9
        if not likely.any():
            return []
        # of those windows, the ones where a range of items can reach the threshold
        keep, place = likely[window], np.cumsum(likely) - 1
        window, term = place[window[keep]], term[keep]
        order = np.argsort(window, kind="stable")
        window, term = window[order], term[order]
        hot = np.zeros(int(likely.sum()), bool)
        # so many windows at once that their bounds stay within CELLS, and their terms' ranges too
        work = np.cumsum(np.bincount(window, self.range_count[term] + 1.0, minlength=len(hot)) + self.ranges)
        first = 0
        while first < len(hot):
            last = max(first + 1, int(np.searchsorted(work, (work[first - 1] if first else 0) + CELLS)))
            part = slice(*np.searchsorted(window, (first, last)))
            own, count = term[part], self.range_count[term[part]]
            index = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - self.range_start[own], count)
            bound = np.bincount(np.repeat(window[part] - first, count) * self.ranges + self.range_of[index], self.range_max[index], minlength=(last - first) * self.ranges)
            hot[first:last] = (bound.reshape(-1, self.ranges) >= THRESHOLD - 1e-9).any(axis=1)
            first = last
        best: dict[int, tuple[int, float, float, float]] = {}
        for k, own in zip(np.flatnonzero(likely)[hot].tolist(), np.flatnonzero(hot), strict=True):
            terms = term[slice(*np.searchsorted(window, (own, own + 1)))].tolist()
            span = slice(k * step, k * step + self.width)
            seen = None
            for i, score in self.search(terms):
                seen = windows(ws[span]) if seen is None else seen
                q, a = (self.share(part, seen, ws[span]) for part in self.parts[i])
                if q >= OVERLAP and a >= OVERLAP and (i not in best or score > best[i][1]):
                    best[i] = (i, score, q, a)
        return sorted(best.values())

    @staticmethod
    def share(part: list[str], seen: set[tuple[str, ...]], passage: list[str]) -> float:
        """The share of a part's windows in the passage; a part shorter than a window must stand there in one run."""
        if not part:
            return 1.0
        if len(part) < WORDS:
            return float(any(passage[i : i + len(part)] == part for i in range(len(passage) - len(part) + 1)))
        own = windows(part)
        return len(own & seen) / len(own)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, term, size) of the distinct terms of each item; the null term once for each item, with its words."""
    for part in slices(batches):
        blocks, terms, sizes = [], [], []
        for block, text in zip(part.column("block").to_pylist(), part.column("text").to_pylist(), strict=True):
            ws = words(text)
            own = [None, *set(ws)]
            blocks += [block] * len(own)
            terms += own
            sizes += [len(ws)] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(terms, pa.string()), pa.array(sizes, pa.int64())], names=["block", "term", "size"])


def _ordered(rows: list) -> list[tuple[int | None, str]]:
    return sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def indexes(benchmark: DataFrame) -> Iterator[ItemIndex]:
    """Indexes of at most ITEMS test items each, one at a time."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    n = items.count()
    if n <= ITEMS:
        yield ItemIndex(_ordered(items.collect()))
        return
    numbered = items.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1] // ITEMS))
    dealt = written(benchmark.sparkSession.createDataFrame(numbered, "item_id long, text string, block long"))
    terms = written(dealt.select("block", "text").mapInArrow(_counted, "block long, term string, size long").groupBy("block", "term").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.max("size").alias("longest")))
    n_words, longest = terms.where("term is null").agg(F.sum("words"), F.max("longest")).first()
    every = written(terms.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")))
    for k in range(-(-n // ITEMS)):
        df = {r[0]: r[1] for r in every.join(terms.where(F.col("block") == k).select("term"), "term").collect()}  # terms of ITEMS items
        own = _ordered(dealt.where(F.col("block") == k).select("item_id", "text").collect())
        yield ItemIndex(own, (n, n_words, longest, df))


def _passes(docs: DataFrame, benchmark: DataFrame, step) -> Iterator[DataFrame]:
    """step(docs, broadcast index) for each index; with several, each pass is written before the next index is made."""
    context, one = benchmark.sparkSession.sparkContext, benchmark.where("text is not null").limit(ITEMS + 1).count() <= ITEMS
    for index in indexes(benchmark):
        given = context.broadcast(index)
        out = step(docs, given)
        if one:
            yield out
        else:
            yield written(out)
            given.destroy()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every leak of a test item into a document."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

    def step(docs: DataFrame, given) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                rows = [(d, given.value.items[i][0], s, q, a) for d, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for i, s, q, a in given.value.leaks(text)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return docs.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, _passes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, step))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents into which a test item leaks; one pass for each index, no shuffle."""

    def step(_: DataFrame, given) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                yield part.filter(pa.array([not given.value.leaks(text) for text in part.column("text").to_pylist()], pa.bool_()))

        return kept[-1].mapInArrow(run, docs.schema)

    kept = [docs]
    for out in _passes(docs, benchmark, step):
        kept.append(out)
    return kept[-1]


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of every leak."""
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
