"""Collocations, from word-id suffix arrays of shards.

Texts are cut into pieces and words; a shard is a run of texts of one language of up to SHARD bytes. In a shard words
become ids, prefix doubling sorts the suffixes by their first four words, and runs of the suffix array whose longest
common prefix is n or more are the n-grams with their counts. Shard counts are merged by key. Four passes, each of
which can only shrink the next one: words; hashed pairs of words that may be frequent; phrases of two and three words of
pairs that may be; phrases of four words that begin and end with three that may be.
What may be frequent is asked of a bit array of BITS bits, set for all that is: its false positives are counted and
then dropped by their exact counts, so that its fixed size bounds the broadcast and never changes a result.

Cases: a null text is empty and gives no words; a null lang is `und`; repeated rows count as often as they stand; texts
count whole (a text above SHARD bytes is cut between pieces, so a shard is at most SHARD bytes and one piece); an empty
table gives no rows; ties go by score, then count, then phrase; other columns are not read, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fintally.llm.common import table, written

#: Bytes of text whose words share one suffix array.
SHARD = 8 << 20
#: Bits of the arrays of what may be frequent (16 MB); a power of two.
BITS = 1 << 27
MIN_COUNT, LONGEST, TOP = 30, 4, 2000
#: Sizes of phrases that are counted together, before the longest ones.
SIZES = (2, 3)
#: A phrase goes if a longer one around it has this share of its count, in percent.
COVERED = 80
#: Ranks are first taken within so many parts of a language, so that no task ranks all its phrases.
PARTS = 16

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BREAK = re.compile(rb"[.,;:!?\x0A-\x0D]")


def _parts(text: bytes, limit: int) -> Iterator[bytes]:
    """A text cut behind the first break after each limit bytes."""
    at = 0
    while len(text) - at > limit and (end := _BREAK.search(text, at + limit)):
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def shards(batches: Iterable[pa.RecordBatch], limit: int = SHARD) -> Iterator[tuple[str, bytes]]:
    """(lang, texts joined by line breaks) of up to limit bytes; all that is held is flushed at that size."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            for part in _parts((text.as_py() or "").encode(), limit):
                held.setdefault(lang, []).append(part)
                size += len(part) + 1
                if size >= limit:
                    yield from ((k, b"\n".join(v)) for k, v in held.items())
                    held, size = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def words_of(text: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Word ids in text order, the words behind the ids, and the number of each word's piece."""
    raw = np.frombuffer(text, np.uint8)
    kind = _KIND[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = kind == 0
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    data = _LOWER[raw[kind == 0]]
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.cast(pa.string()), np.cumsum(kind == 2, dtype=np.int32)[starts]


def suffix_array(ids: np.ndarray, reach: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first depth words (a power of two), and each one's common prefix with the one before it.

    reach: how many words each suffix has before its piece ends; a suffix that ends sorts before any that goes on.
    """
    rank, h = ids.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable") if depth == 1 else np.zeros(0, np.int64)
    while h < depth:
        later = np.zeros(len(rank), np.int64)
        later[:-h] = np.where(reach[:-h] > h, rank[h:], 0)
        key = rank * (rank.max(initial=0) + 1) + later
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[order] = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)])
        h *= 2
    common, same = np.zeros(len(order), np.int8), np.ones(max(0, len(order) - 1), bool)
    a, b = order[:-1], order[1:]
    for d in range(depth):
        at = np.minimum(a + d, len(ids) - 1), np.minimum(b + d, len(ids) - 1)
        same &= (reach[a] > d) & (reach[b] > d) & (ids[at[0]] == ids[at[1]])
        common[1:] += same
    return order, common


def intervals(order: np.ndarray, common: np.ndarray, reach: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A place and the count of each n-gram: the runs of the suffix array with a common prefix of n words."""
    heads = np.flatnonzero(common < n)
    counts = np.diff(np.append(heads, len(order)))
    whole = reach[order[heads]] >= n
    return order[heads[whole]], counts[whole]


def _hashes(lang: str, words: pa.Array) -> np.ndarray:
    """xxhash64(lang, word) as Spark has it."""
    seed = xxhash.xxh64_intdigest(lang, 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two words' hashes, of 48 bits: the shuffled rows are shorter."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) & np.uint64((1 << 48) - 1)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _bit_array(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of column h; at most bits / 64 rows come to the driver, whatever the number of hashes."""
    at = F.col("h").bitwiseAND(F.lit(bits - 1))
    found = hashes.select(F.shiftrightunsigned(at, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    rows = found.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bit"].to_numpy(np.int64).view(np.uint64)
    return out


def _reach(links: np.ndarray) -> np.ndarray:
    """Words up to the end of each place's chain, itself counted; links: whether the chain goes on behind each place but the last."""
    ends = np.flatnonzero(~np.append(links, False))
    return ends[np.searchsorted(ends, np.arange(len(links) + 1))] - np.arange(len(links) + 1) + 1


def _chains(ids: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and reach of the places that stand in a chain of two or more."""
    keep = np.append(links, False) | np.append(False, links)
    reach = _reach(links)[keep] if len(ids) else np.zeros(0, np.int64)
    return ids[keep[: len(ids)]], reach


def _mapped(docs: DataFrame, f: Callable[[str, bytes], Iterator[pa.RecordBatch]], schema: str, limit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in shards(batches, limit):
            yield from f(lang, text)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, schema)


def word_counts(docs: DataFrame, limit: int = 2 * SHARD) -> DataFrame:
    """lang, word, f; the row with a null word has the number of all words."""

    def run(lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        ids, words, _ = words_of(text)
        found = pa.concat_arrays([words, pa.nulls(1, pa.string())])
        counts = np.append(np.bincount(ids, minlength=len(words)), len(ids)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(found)), found, pa.array(counts)], names=["lang", "word", "f"])

    return _mapped(docs, run, "lang string, word string, f long", limit).groupBy("lang", "word").agg(F.sum("f").alias("f"))


def pair_counts(docs: DataFrame, frequent: np.ndarray, limit: int = SHARD) -> DataFrame:
    """h, f: hashes of neighbouring words that may both be frequent, with counts."""
    given = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        ids, words, piece = words_of(text)
        hashes = _hashes(lang, words)
        may = _has(given.value, hashes)[ids]
        chain, reach = _chains(ids, may[:-1] & may[1:] & (piece[:-1] == piece[1:]))
        order, common = suffix_array(chain, reach, 2)
        at, counts = intervals(order, common, reach, 2)
        h = _pairs(hashes[chain[at]], hashes[chain[at + 1]]).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(counts.astype(np.int64))], names=["h", "f"])

    return _mapped(docs, run, "h long, f long", limit).groupBy("h").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, frequent: np.ndarray, pairs: np.ndarray, sizes: tuple[int, ...], inner: np.ndarray | None = None, limit: int = SHARD) -> DataFrame:
    """lang, phrase, f of phrases of so many words whose words and neighbours may all be frequent.

    inner: also their first and their last words but one must be, by the bits of phrases one word shorter.
    """
    given = docs.sparkSession.sparkContext.broadcast((frequent, pairs, inner))

    def run(lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        frequent, pairs, inner = given.value
        ids, words, piece = words_of(text)
        hashes = _hashes(lang, words)
        may = _has(frequent, hashes)[ids]
        links = may[:-1] & may[1:] & (piece[:-1] == piece[1:])
        at = np.flatnonzero(links)
        links[at] = _has(pairs, _pairs(hashes[ids[at]], hashes[ids[at + 1]]))
        chain, reach = _chains(ids, links)
        order, common = suffix_array(chain, reach, LONGEST)
        for n in sizes:
            at, counts = intervals(order, common, reach, n)
            if inner is not None:
                parts = [_phrase_hashes([hashes[chain[at + k]] for k in range(first, first + n - 1)]) for first in (0, 1)]
                keep = _has(inner, parts[0]) & _has(inner, parts[1])
                at, counts = at[keep], counts[keep]
            phrase = pc.binary_join_element_wise(*(words.take(pa.array(chain[at + k])) for k in range(n)), " ")
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(at)), phrase, pa.array(counts.astype(np.int64))], names=["lang", "phrase", "f"])

    return _mapped(docs, run, "lang string, phrase string, f long", limit).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _phrase_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases, of the hashes of their words in order."""
    out = parts[0]
    for part in parts[1:]:
        out = _pairs(out, part)
    return out


def hashed_phrases(phrases: DataFrame) -> DataFrame:
    """h: the hashes of phrases (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = [xxhash.xxh64_intdigest(lang, 42) for lang in batch.column("lang").to_pylist()]
            words = [p.split(" ") for p in batch.column("phrase").to_pylist()]
            hashes = [_phrase_hashes([np.array([xxhash.xxh64_intdigest(w, seed)], np.uint64) for w in ws])[0] for ws, seed in zip(words, seeds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(hashes, np.uint64).view(np.int64))], names=["h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "h long")


def _joined(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def _cuts(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """The lowest-scoring cut of each phrase, the first of those that score alike."""
    words, size = F.split("phrase", " "), F.col("size")
    k = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cut = phrases.select("lang", "phrase", "size", F.col("f").alias("a"), k)
    part = F.array(F.struct(F.lit(True).alias("first"), _joined(words, F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(False).alias("first"), _joined(words, F.col("k") + 1, size - F.col("k")).alias("part")))
    parts = cut.select("lang", "phrase", "a", "k", F.inline(part)).join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    sides = [F.max(F.when((F.col("k") == n) & (F.col("first") == first), F.col("f"))).alias(f"{side}{n}") for n in range(1, LONGEST) for side, first in (("l", True), ("r", False))]
    each = parts.groupBy("lang", "phrase", "a").agg(*sides)
    # counts of trillions pass 64 bits here
    score = lambda n: F.expr(f"cast(2000000 as decimal(38,0)) * a div (l{n} + r{n})")
    options = [F.when(F.col(f"l{n}").isNotNull(), F.struct(score(n).alias("score"), F.lit(n).alias("k"), F.col(f"l{n}").alias("l"), F.col(f"r{n}").alias("r"))) for n in range(1, LONGEST)]
    return each.withColumn("cut", F.array_min(F.array_compact(F.array(*options)))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _inner(phrases: DataFrame) -> DataFrame:
    """lang, phrase, around: the highest count of a longer phrase around each shorter one."""
    words, size = F.split("phrase", " "), F.col("size")
    shorter = F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: _joined(words, at, n)))
    return phrases.where("size > 2").select("lang", F.explode(F.flatten(shorter)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first top phrases of each language."""
    words = written(word_counts(docs, 2 * shard).where(F.col("word").isNull() | (F.col("f") >= min_count)))
    totals, words = words.where("word is null").select("lang", F.col("f").alias("n")), words.where("word is not null")
    frequent = _bit_array(words.select(F.xxhash64("lang", "word").alias("h")), bits)
    pairs = _bit_array(pair_counts(docs, frequent, shard).where(F.col("f") >= min_count), bits)
    size = F.size(F.split("phrase", " ")).alias("size")
    shorter = written(phrase_counts(docs, frequent, pairs, SIZES, limit=shard).where(F.col("f") >= min_count).select("*", size))
    inner = _bit_array(hashed_phrases(shorter.where(F.col("size") == LONGEST - 1)), bits)
    longest = written(phrase_counts(docs, frequent, pairs, (LONGEST,), inner, shard).where(F.col("f") >= min_count).select("*", size))
    phrases = shorter.unionByName(longest)
    counts = words.select("lang", F.col("word").alias("phrase"), "f").unionByName(phrases.select("lang", "phrase", "f"))
    kept = _cuts(phrases, counts).join(_inner(phrases), ["lang", "phrase"], "left").where("around is null or cast(100 as decimal(38,0)) * around < cast(%d as decimal(38,0)) * a" % COVERED)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of documents."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


_WORDS = r"""words as (
  select coalesce(lang, 'und') as lang, d.doc, p.piece, list_filter(string_split(replace(p.text, chr(9), ' '), ' '), lambda x: x <> '') as w
  from (select row_number() over () as doc, lang, text from documents where text is not null) d,
       lateral (select unnest(range(len(x.s))) as piece, unnest(x.s) as text
                from (select string_split_regex(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as s) x) p)"""
ORACLE_SQL = f"""
with {_WORDS},
grams as (
  select lang, len(g) as size, array_to_string(g, ' ') as phrase, count(*) as f
  from (select lang, unnest(flatten(list_transform(range(1, 5), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])))) as g from words)
  group by all),
totals as (select lang, cast(sum(f) as bigint) as n from grams where size = 1 group by lang),
candidates as (select * from grams where size > 1 and f >= 30),
cuts as (
  select c.lang, c.phrase, c.f as a, l.f as l, r.f as r, k, (2000000::hugeint * c.f) // (l.f + r.f) as score
  from (select *, unnest(range(1, size)) as k, string_split(phrase, ' ') as w from candidates) c
  join grams l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:k], ' ')
  join grams r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (
  select b.* from best b where not exists (
    select 1 from candidates c where c.lang = b.lang and len(string_split(c.phrase, ' ')) > len(string_split(b.phrase, ' '))
    and contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') and 100 * c.f >= 80 * b.a))
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, cast(score as bigint) as score
from kept k join totals t on t.lang = k.lang
qualify rank <= 2000
"""
