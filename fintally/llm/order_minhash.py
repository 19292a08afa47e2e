"""Near-duplicate classes of texts by order MinHash and banded alignment.

A text's k-mers are its windows of WORDS words (lower case, split at white space; a shorter text is one k-mer), each
labelled with its occurrence number, so that no label repeats within a text. For each of SKETCHES seeds the sketch is
the KEPT smallest hashed k-mers in text order: equal sketches are likely for texts that share k-mers in the same
order. Short texts, whose five-word windows a single edit may all break, are sketched by windows of SHORT_WORDS words.
Texts that share a sketch are candidates. A candidate pair is linked if the longest common subsequence of their words,
aligned within the band that the threshold allows, makes at least 0.8 of both together (matches / (n1 + n2 - matches)).
Classes are the connected components.

Scale: exact copies meet by digest in a partly aggregated group. Every text carries a histogram of its hashed words;
its overlap with another's is never below their alignment, so it drops pairs that cannot pass and loses none. A bucket
(the texts of one sketch) never emits all of its pairs: its texts meet one pivot, that of most of a text's buckets
first and the others only from other classes, and only buckets that are not one class then are compared further,
histogram by histogram, by sums of bins first. There the largest class of a bucket is dealt out once against
the blocks of the others. The likeliest partners of each text go first, and what their links leave apart is then
compared whole. Later links join the classes that are there, whose own links are not read again. A vertex with many links or a label with many members is no key of a shuffle: its label is broadcast.

Recall: a pair of similarity 0.8 whose edits lie at random shares no sketch with a chance of about 0.006, one of 0.85
of 0.0002. Edits at even distances break the most windows: there about a tenth of the pairs at 0.8 share none.

Cases: a null text is a class of its own; empty or white texts are exact copies of one another; texts of any length
count whole; repeated rows with one doc_id are one document, of which the least text is aligned and kept; a document with a
null id gets the class of its text, which is null if no text of the class has an id. Ties go to the smallest id. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.llm.common import bytes_of, deleted, slices, table, written

WORDS, SIMILARITY = 5, 0.8
SKETCHES, KEPT = 32, 2
#: Texts of up to SHORT words are sketched by k-mers of SHORT_WORDS words, those of SIMILARITY * SHORT or more by WORDS.
SHORT, SHORT_WORDS = 50, 2
#: Bins of the histogram of hashed words, and sums of neighbouring ones that are compared first.
BINS, COARSE = 512, 128
#: Members of one pivot that meet in one task, and texts of a bucket in one block.
PIVOT_BLOCK, BLOCK = 256, 1024
#: Blocks of up to SMALL_BUCKET texts share a task (SHARED_TASK rows in all, or so).
SMALL_BUCKET, SHARED_TASK = 64, 4000
#: Likeliest partners in other classes that a text of a block meets first.
FIRST = 3
#: Pairs that a task aligns, rows that a task compares by histogram, and bytes of links that a task joins, or more.
PAIRS, ROWS, LINKS = 256, 512, 16 << 20
#: Rows of one key above which its value is broadcast, and keys that are: of n rows n / HOT keys at most can be that frequent.
HOT, MOST_HOT = 1 << 14, 1 << 20
#: Bytes of texts that are sketched at once: their hashes stay in a core's cache.
CACHED = 1 << 18

U = np.uint64
_C1, _C2, _C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_TOP = U(0xFFFFFFFFFFFFFFFF)
#: Of n1 + n2 words this share must match.
_SHARE = SIMILARITY / (1 + SIMILARITY)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs, equal outputs, well spread."""
    x = (x ^ (x >> U(30))) * _C2
    x = (x ^ (x >> U(27))) * _C3
    return x ^ (x >> U(31))


def normalized(text: str) -> str:
    """Lower-case words with single spaces."""
    return " ".join(text.lower().split())


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed words of all normalized texts in order, and the number of each text's."""
    lists = pa.compute.split_pattern(pa.array(texts, pa.large_string()), " ")
    lengths = np.where([bool(t) for t in texts], pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    hashes = pd.util.hash_array(words.dictionary.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)
    word = hashes[words.indices.to_numpy()]
    if (lengths == 0).any():  # an empty text splits into one empty word
        word = word[np.repeat(lengths > 0, np.maximum(lengths, 1))]
    return word, lengths


def kmers(word: np.ndarray, lengths: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hashed, occurrence-labelled k-mers of all texts in order, and the number of each text's."""
    counts = np.maximum(lengths - words + 1, 1)
    ends = np.cumsum(counts)
    of = np.repeat(np.arange(len(lengths)), counts)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
    at += np.repeat(np.cumsum(lengths) - lengths, counts)
    left = np.repeat(np.minimum(lengths, words), counts)
    out = np.full(len(at), U(words), np.uint64)
    padded = np.append(word, np.zeros(words, np.uint64))
    for i in range(words):  # a short text's k-mer has the words that there are
        out = np.where(left > i, mix(out * _C1 + padded[at + i]), out)
    # occurrence labels: the rank of each k-mer among the equal ones of its text
    order = np.lexsort((out, of))
    o, f = out[order], of[order]
    new = np.append(True, (o[1:] != o[:-1]) | (f[1:] != f[:-1])) if len(o) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    rank = np.arange(len(o)) - np.repeat(starts, np.diff(np.append(starts, len(o))))
    label = np.empty(len(o), np.uint64)
    label[order] = rank.astype(np.uint64)
    return mix(out + label * _C1), counts


def sketches(word: np.ndarray, lengths: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A row of SKETCHES keys for each text."""
    hashed, counts = kmers(word, lengths, words)
    keys = np.empty((len(counts), SKETCHES), np.int64)
    if not len(counts):
        return keys
    starts = np.cumsum(counts) - counts
    position = np.arange(len(hashed), dtype=np.uint64)
    # the hash's high bits above the position: a minimum gives both
    low = U((1 << max(24, len(hashed).bit_length())) - 1)
    for seed in range(SKETCHES):
        value = (mix(hashed ^ mix(np.full(1, seed + 1, np.uint64) * _C1)) & ~low) | position
        picked = np.full((len(counts), KEPT), -1, np.int64)
        for k in range(KEPT):
            least = np.minimum.reduceat(value, starts)
            there = least != _TOP
            picked[there, k] = (least[there] & low).astype(np.int64)
            value[picked[there, k]] = _TOP
        picked.sort(axis=1)  # text order
        key = np.full(len(counts), U(seed + 1 + SKETCHES * words), np.uint64)
        for k in range(KEPT):
            key = mix(key * _C1 + np.where(picked[:, k] >= 0, hashed[picked[:, k]], U(0)))
        keys[:, seed] = key.view(np.int64)
    return keys


def histograms(word: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The histogram of each text's hashed words, as BINS unsigned counts of 8 bits, or of 16 where one needs them; empty where a count is larger."""
    flat = np.repeat(np.arange(len(lengths)), lengths) * BINS + (word % U(BINS)).astype(np.int64)
    counted = np.bincount(flat, minlength=len(lengths) * BINS).reshape(-1, BINS)
    most = counted.max(axis=1, initial=0)
    return [b"" if m > 0xFFFF else row.astype(np.uint16 if m > 0xFF else np.uint8).tobytes() for row, m in zip(counted, most, strict=True)]


def unpacked(column: list[bytes], n: np.ndarray) -> np.ndarray:
    """Rows of counts of histograms; an empty one can overlap with any of the text's n words."""
    out = np.zeros((len(column), BINS), np.int32)
    for i, h in enumerate(column):
        out[i] = np.frombuffer(h, np.uint8 if len(h) == BINS else np.uint16) if h else n[i]
    return out


def overlaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What each row of counts shares with the row of y at its place."""
    return np.minimum(x, y).sum(axis=1)


def matches(x: list[str], y: list[str], band: int) -> int:
    """The length of the longest common subsequence whose matches lie within the band, by bit-parallel rows.

    Bits stand for positions of y, and a zero bit for a match that has been won. Only bits within the band of the
    current rows are held: below them nothing changes any more, above them nothing has been touched.
    """
    won, bits, base = 0, 0, 0
    step = max(band, 64)
    for first in range(0, len(x), step):
        low, high = max(0, first - band), min(len(y), first + step + band)
        if low >= len(y):
            break
        if first == 0:
            bits, held = (1 << (high - low)) - 1, high - low
        else:
            gone = low - base
            won += gone - (bits & ((1 << gone) - 1)).bit_count()
            bits >>= gone
            kept = held - gone
            held = high - low
            bits |= ((1 << (held - kept)) - 1) << kept
        base = low
        at: dict[str, int] = {}
        for j in range(low, high):
            at[y[j]] = at.get(y[j], 0) | 1 << (j - low)
        whole = (1 << held) - 1
        for i in range(first, min(first + step, len(x))):
            m = at.get(x[i])
            if m is None:
                continue
            # matches of row i within the band only
            left = i - band - low
            if left > 0:
                m = m >> left << left
            m &= (1 << max(0, i + band + 1 - low)) - 1
            u = bits & m
            bits = ((bits + u) | (bits - u)) & whole
    return won + held - bits.bit_count() if len(x) and len(y) else 0


def aligned(x: list[str], y: list[str], similarity: float = SIMILARITY) -> float:
    """Similarity of two texts' words by banded alignment; 0.0 where it is below the threshold.

    Of n1 + n2 words the threshold s allows at most (n1 + n2) (1 - s) / (1 + s) unmatched ones; matches farther apart
    than that lie on no alignment that passes.
    """
    n = len(x) + len(y)
    if x == y:
        return 1.0
    band = int(n * (1 - similarity) / (1 + similarity) + 1e-9)
    if abs(len(x) - len(y)) > band or 2 * (Counter(x) & Counter(y)).total() < n - band:
        return 0.0
    head = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    x, y = x[head:], y[head:]
    tail = next((i for i, (a, b) in enumerate(zip(reversed(x), reversed(y), strict=False)) if a != b), min(len(x), len(y)))
    m = head + tail + matches(x[: len(x) - tail], y[: len(y) - tail], band)
    score = m / (n - m)
    return score if score >= similarity - 1e-12 else 0.0


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the words, n (words), keys and histogram of every document with a text."""
    schema = "doc_id long, digest binary, n long, keys array<long>, histogram binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=CACHED):
            texts = [normalized(t) for t in part.column("text").to_pylist()]
            word, lengths = word_hashes(texts)
            keys: list[list[int]] = [[] for _ in texts]
            for words, chosen in ((WORDS, lengths >= SIMILARITY * SHORT), (SHORT_WORDS, lengths <= SHORT)):
                for i, row in zip(np.flatnonzero(chosen), sketches(word[np.repeat(chosen, lengths)], lengths[chosen], words).tolist(), strict=True):
                    keys[i] += row
            digests = [hashlib.sha256(t.encode()).digest()[:16] for t in texts]
            columns = [part.column("doc_id"), pa.array(digests, pa.binary()), pa.array(lengths, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(histograms(word, lengths), pa.binary())], names=["doc_id", "digest", "n", "keys", "histogram"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("text is not null").mapInArrow(run, schema)


def possible(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of representatives those whose histograms overlap enough."""
    of = copies.select("rep", "n", "histogram")
    both = pairs.join(of.toDF("a", "an", "ah"), "a").join(of.toDF("b", "bn", "bh"), "b")
    both = both.where(F.least("an", "bn") >= SIMILARITY * F.greatest("an", "bn") - 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, BLOCK):
                some = part.slice(at, BLOCK)
                an, bn = some.column("an").to_numpy(), some.column("bn").to_numpy()
                shared = overlaps(unpacked(some.column("ah").to_pylist(), an), unpacked(some.column("bh").to_pylist(), bn))
                yield some.select(["a", "b"]).filter(pa.array(shared >= _SHARE * (an + bn) - 1e-6, pa.bool_()))

    return both.select("a", "b", "an", "bn", "ah", "bh").mapInArrow(run, "a long, b long")


def tasks(spark: SparkSession, most: int) -> int:
    """Tasks for few bytes with much work: as many as a shuffle has, and not more than needed."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), most))


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the distinct pairs (a, b) those whose texts align; many pairs may have the same a.

    Only texts of the pairs leave docs: their ids are written first, so that their size decides how they are joined. A
    text with many partners is dealt over blocks of them, and goes to each block once: its row comes first there.
    """
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    texts = written(texts.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIVOT_BLOCK).cast("int").alias("blocks"))
    left = blocks.join(texts.toDF("a", "text"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "text")
    right = pairs.join(blocks, "a").join(texts.toDF("b", "text"), "b").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), "b", "text")
    dealt = left.unionByName(right).repartition(tasks(pairs.sparkSession, pairs.count() // PAIRS), "a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: list[str] = []
        for part in slices(batches):
            keep = []
            for b, text in zip(part.column("b").to_pylist(), part.column("text").to_pylist(), strict=True):
                words = text.lower().split()
                if b is None:
                    mine = words
                keep.append(b is not None and aligned(mine, words) > 0)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = written(dealt.mapInArrow(run, "a long, b long"))
    deleted(ids)
    deleted(texts)
    return found


def frequent(rows: DataFrame, key: str) -> DataFrame | None:
    """The values of key in more than HOT of the rows; None where there are none. Rows of a written() table are counted from its footers."""
    if rows.count() <= HOT:
        return None
    found = written(rows.groupBy(key).count().where(F.col("count") > HOT).select(key))
    if 0 < found.count() <= MOST_HOT:
        return found
    deleted(found)  # with more than MOST_HOT of them, no single one has a large share of the rows
    return None


def looked_up(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """rows joined with values, a row for each key; those of hot keys stay where they are and meet a broadcast."""
    if hot is None:
        return rows.join(values, key)
    usual = rows.join(F.broadcast(hot), key, "left_anti").join(values, key)
    return usual.unionByName(rows.join(F.broadcast(values.join(F.broadcast(hot), key, "left_semi")), key))


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every vertex of the edges (a, b): the least id that it is connected to.

    Each round takes the least label among the neighbours, then the label of that label; few rounds for the
    star-shaped links of pivots. Rounds are written to the shared folder, and the one before is deleted. Neither the
    neighbours of a hub nor the members of a large class meet in one task: minima are combined before the shuffle, and
    the labels of hubs and of large classes are broadcast.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct())
    few = 1 + bytes_of(both) // LINKS  # small tables in few tasks
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")).coalesce(few))
    hubs = frequent(both, "b")
    while True:
        large = frequent(labels, "label")
        near = looked_up(both, labels.toDF("b", "label"), "b", hubs).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "id"), "id").select("id", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        jump = labels.toDF("label", "up")
        new = written(looked_up(step, jump, "label", large).select("id", F.least("label", "up").alias("label"), (F.least("label", "up") != F.col("old")).alias("moved")).coalesce(few))
        for each in (labels, *([] if large is None else [large])):
            deleted(each)
        labels = new.drop("moved")
        if not new.where("moved").limit(1).count():
            for each in (both, *([] if hubs is None else [hubs])):
                deleted(each)
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels of components() after more links (a, b), both written() tables: classes are joined, of whose links none is read again."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = written(labels.union(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("label"))))
    sides, used = links.select("a", "b"), [own]
    for side in ("a", "b"):
        hot = frequent(links, side)
        used += [] if hot is None else [hot]
        sides = looked_up(sides, own.toDF(side, f"{side}_label"), side, hot)
    apart = written(sides.where("a_label <> b_label").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct())
    roots, large = components(apart), frequent(own, "label")
    moved = own.select("label").distinct().join(roots.toDF("label", "root"), "label", "left")
    out = written(looked_up(own, moved, "label", large).select("id", F.coalesce("root", "label").alias("label")).coalesce(1 + bytes_of(own) // LINKS))
    for each in (*used, apart, roots, *([] if large is None else [large])):
        deleted(each)
    return out


def block_pairs(group: pd.DataFrame, first: bool) -> pd.DataFrame:
    """Pairs across classes that can pass, between the two blocks of a bucket or within its one: key, a, b.

    With `first` only the FIRST likeliest of each text; where others are held back, a row without a pair says so.
    """
    low, high = group["low"].iat[0], group["high"].iat[0]
    x, y = (group, group) if low == high else (group[group["mine"] == low], group[group["mine"] == high])
    n, m = x["n"].to_numpy(), y["n"].to_numpy()
    test = (x["label"].to_numpy()[:, None] != y["label"].to_numpy()[None]) & (np.minimum(n[:, None], m[None]) >= SIMILARITY * np.maximum(n[:, None], m[None]) - 1e-9)
    if low == high:
        test &= x["rep"].to_numpy()[:, None] < y["rep"].to_numpy()[None]
    i, j = np.nonzero(test)
    if not len(i):
        return pd.DataFrame(columns=["key", "a", "b"])
    hx, hy = unpacked(x["histogram"].tolist(), n), unpacked(y["histogram"].tolist(), m)
    if len(i) * 4 >= test.size:
        # sums of bins overlap by no less than the bins do
        cx, cy = (h.reshape(-1, COARSE, BINS // COARSE).sum(axis=2) for h in (hx, hy))
        every = np.zeros(test.shape, np.int64)
        for k in range(COARSE):
            every += np.minimum.outer(cx[:, k], cy[:, k])
        keep = every[i, j] >= _SHARE * (n[i] + m[j]) - 1e-6
        i, j = i[keep], j[keep]
    shared = np.concatenate([np.zeros(0, np.int64), *(overlaps(hx[i[k : k + BLOCK]], hy[j[k : k + BLOCK]]) for k in range(0, len(i), BLOCK))])
    share = shared / (n[i] + m[j])
    keep = share >= _SHARE - 1e-9
    i, j, share = i[keep], j[keep], share[keep]
    held = 0
    if first:
        best = np.zeros(len(i), bool)
        for side in (i, j):
            order = np.lexsort((-share, side))
            t = side[order]
            starts = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
            place = np.arange(len(t)) - np.repeat(starts, np.diff(np.append(starts, len(t))))
            best[order[place < FIRST]] = True
        held = len(i) - int(best.sum())
        i, j = i[best], j[best]
    a, b = x["rep"].to_numpy()[i], y["rep"].to_numpy()[j]
    out = pd.DataFrame({"key": group["key"].iat[0], "a": np.minimum(a, b), "b": np.maximum(a, b)})
    return pd.concat([out, pd.DataFrame({"key": [group["key"].iat[0]], "a": [None], "b": [None]})]) if held else out


def apart_pairs(members: DataFrame, labels: DataFrame, copies: DataFrame, first: bool) -> DataFrame:
    """Candidate pairs (key, a, b) across classes within the buckets that are not one class, as of block_pairs; members: key, rep.

    The largest class of a bucket has no pairs of its own: its blocks meet those of the other texts only.
    """
    known = members.join(labels.toDF("rep", "label"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    classes = known.groupBy("key", "label").agg(F.count("*").alias("size"))
    buckets = classes.groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("core"), F.max("size").alias("cores"), F.sum("size").alias("size"), F.count("*").alias("classes"))
    # with two texts, the pivot met the other one
    buckets = written(buckets.where("classes > 1 and size > 2").drop("classes"))
    full = known.join(buckets, "key").join(copies.select("rep", "n", "histogram"), "rep")
    blocks = lambda size: F.ceil(size / BLOCK).cast("int")
    full = full.withColumn("others", blocks(F.col("size") - F.col("cores"))).withColumn("all", F.col("others") + blocks(F.col("cores")))
    is_core = F.col("label") == F.col("core")
    place = F.xxhash64("rep")
    full = full.withColumn("mine", F.when(is_core, F.col("others") + F.pmod(place, F.col("all") - F.col("others"))).otherwise(F.pmod(place, F.col("others"))).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_core, F.col("others")).otherwise(F.col("all")) - 1)))
    full = full.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
    small = F.col("size") <= SMALL_BUCKET
    rows, few = buckets.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.when(small, F.col("size"))), F.lit(0))).first()
    groups = max(1, few // SHARED_TASK)
    full = full.withColumn("task", F.when(small, F.pmod(F.xxhash64("key"), F.lit(groups))).otherwise(F.xxhash64("key", "low", "high")))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([block_pairs(blocks, first) for _, blocks in group.groupby(["key", "low", "high"], sort=False)])

    full = full.select("key", "rep", "label", "n", "histogram", "mine", "low", "high", "task")
    found = written(full.repartition(tasks(full.sparkSession, rows // ROWS), "task").groupBy("task").applyInPandas(compare, "key long, a long, b long"))
    deleted(buckets)
    return found


def pivots_apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of a bucket's pivot and a text of it in another class; members: key, rep, pivot."""
    known = members.join(labels.toDF("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    own = known.where("rep = pivot").select("key", F.col("label").alias("core"))
    return known.join(own, "key").where("label <> core").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()


def text_classes(sketched: DataFrame, docs: DataFrame) -> DataFrame:
    """(digest, class_id) of every text of a sketch_table; docs has the texts. class_id is the class's least doc_id."""
    one = [F.first(c).alias(c) for c in ("n", "keys", "histogram")]
    copies = written(sketched.groupBy("digest").agg(F.min("doc_id").alias("rep"), *one).where("rep is not null"))
    rows = copies.select("rep", F.explode("keys").alias("key"))
    # each bucket of two texts or more, with its pivot
    buckets = written(rows.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).where("size > 1").select("key", "pivot"))
    members = written(rows.join(buckets, "key"))
    deleted(buckets)
    # a pivot is the least of its bucket, so a < b; each text meets the pivot of most of its buckets first
    shared = members.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    nearest = shared.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
    tested = written(possible(nearest, copies))
    edges = verified(tested, docs)
    labels = components(edges)
    used = [copies, members, tested, edges, labels]
    # then the other pivots, but for those that are in its class by now
    others = written(pivots_apart(members, labels).join(tested, ["a", "b"], "left_anti"))
    more = written(possible(others, copies))
    used += [others, more]
    if more.limit(1).count():
        links = verified(more, docs)
        tested, labels = tested.union(more), merged(labels, links)
        used += [links, labels]
    members = members.select("key", "rep")
    for first in (True, False):
        found = apart_pairs(members, labels, copies, first)
        # a pair of many buckets is one before it meets the tested ones
        once = written(found.where("a is not null").select("a", "b").distinct())
        more = written(once.join(tested, ["a", "b"], "left_anti"))
        used += [found, once, more]
        if more.limit(1).count():
            links = verified(more, docs)
            tested, labels = tested.union(more), merged(labels, links)
            used += [links, labels]
        # what was held back is compared whole, where the classes are still apart
        if not first or not found.where("a is null").limit(1).count():
            break
        members = written(members.join(found.where("a is null").select("key").distinct(), "key", "left_semi"))
        used.append(members)
    out = written(copies.select("digest", "rep").join(labels.toDF("rep", "label"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("class_id")))
    for each in used:
        deleted(each)
    return out


def classify(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id), a row for each row of docs: its near-duplicate class, named by the least doc_id."""
    sketched = written(sketch_table(docs))
    classes = text_classes(sketched, docs)
    known = written(sketched.select("doc_id", "digest").join(classes, "digest", "left").select("doc_id", "class_id"))
    deleted(sketched)
    deleted(classes)
    none = docs.where("text is null").select(F.col("doc_id").cast("long").alias("doc_id"))
    return known.union(none.withColumn("class_id", F.col("doc_id")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, that with the least doc_id; one row of it where rows are repeated.

    Of several rows with one doc_id one with the least text stays, a null text last; rows equal in both are one document.
    Only the ids that go are joined to docs, and the repeated ones if there are any.
    """
    own = F.col("doc_id").eqNullSafe(F.col("class_id")) | F.col("class_id").isNull()
    ids = written(classify(docs.select("doc_id", "text")).where("doc_id is not null").groupBy("doc_id").agg(F.count_if(own).alias("own"), F.count("*").alias("rows")).where("own = 0 or rows > 1"))
    once = docs.join(written(ids.select("doc_id")), "doc_id", "left_anti")
    repeated = written(ids.where("own > 0").select("doc_id"))
    if not repeated.limit(1).count():
        return once
    of = docs.join(repeated, "doc_id", "left_semi").select(docs.columns)
    least = of.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNull(), "text")).alias("_row"))
    return once.unionByName(least.select("_row.*"))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id of every document."""
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
