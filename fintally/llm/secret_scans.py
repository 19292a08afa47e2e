"""Secret scans with Spark SQL functions only.

Base spans are the matches of three fixed patterns. Further spans come from two first-order Markov models of
characters, one of random strings and one of ordinary text and identifiers, both trained from labelled samples: digests,
identifiers, numbers, dates and repeats, and words of documents without base spans (fit). A run of key characters is cut
into pieces at / _ and -. A piece is worth its best stretch by log-likelihood ratio; each pair of neighbours counts once,
so that repeats are worth little however long they are. Neighbouring pieces that look random as a whole, or hold a
stretch above MARGIN, are a span if they are worth more than MARGIN together and have LEAST characters; ordinary text
before or behind a secret in the same run doesn't hide it. What base spans cover is cut off an added span.

Positions are code points, ends exclusive. A pattern's matches come from regexp_extract_all, the text between them
from split, and running lengths give the positions; both use one leftmost, non-overlapping scan. The cost of a run is
linear in its length.

Cases: a null or empty text has no spans; texts of any length are scanned whole; repeated rows give repeated results;
extra columns are kept and columns named as the results are replaced; without documents the models have the fixed
samples alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.llm.common import table

# The patterns and their least lengths (of group 2, or of the match).
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # a run of these characters is one match, so that a least length in the pattern equals a check afterwards
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Characters of the models; any other counts as the last.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
#: Least log-likelihood ratio, in nats, of an added span, and its least length before base spans are cut off.
MARGIN, LEAST = 12.0, 20
#: A piece of fewer characters than this belongs to random ones on both sides of it.
SHORT = 8

# Words of ordinary identifiers, for the labelled samples.
WORDS = """account address amount array balance batch buffer builder cache calendar channel client cluster column config
context controller counter customer database default document element entity error event factory field file filter
frame handler header history index instance interest invoice item iterator label ledger length library list loader
manager message method metric model module monitor network number object option order output package page parameter
parser partition password payment period policy position process product profile project property provider query
record reference region report request resource response result revenue sample schema section segment service session
setting source statement status storage stream string summary system table target task tenant test thread token total
transaction type unit update user value vector version window worker the and that with from which their have this
would there about other after first because through between should information international development""".split()


def labelled_samples(spark: SparkSession) -> DataFrame:
    """(random boolean, value string): SHA-256 digests in four alphabets; identifiers of two to four words, numbers, dates, repeats, the alphabet and UUIDs."""
    ids = spark.range(3000)
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    random = F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, base64)
    random = random.when(F.col("id") % 4 == 2, F.translate(base64, "+/", "-_")).otherwise(F.upper(F.regexp_replace(base64, "[^A-Za-z0-9]", "")))
    words = F.array(*map(F.lit, WORDS))
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    many = F.slice(F.array(*(word(k) for k in range(4))), 1, (F.col("id") % 3 + 2).cast("int"))
    letter = F.substring(F.lit(ALPHABET), (F.col("id") % len(ALPHABET) + 1).cast("int"), F.lit(1))
    kinds = [
        F.array_join(many, "_"),
        F.array_join(F.transform(many, F.initcap), ""),
        F.array_join(many, "-"),
        F.upper(F.array_join(many, "_")),
        F.concat(F.array_join(many, "/"), F.lit("/"), (F.col("id") % 2000).cast("string")),
        F.array_join(many, ""),
        F.translate(F.xxhash64("id").cast("string"), "-", ""),
        F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (F.col("id") * 5).cast("int")), "yyyy-MM-dd/yyyyMMdd"),
        F.repeat(letter, F.lit(20)),
        F.substring(F.lit(ALPHABET), (F.col("id") % 60 + 1).cast("int"), F.lit(12)),
        F.concat_ws("-", *(F.substring(F.sha2(F.concat(F.lit("u"), "id"), 256), at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
    ]
    plain = F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int"))
    return ids.select(F.lit(True).alias("random"), random.alias("value")).union(ids.select(F.lit(False), plain))


def _codes(value: Column) -> Column:
    at = lambda c: F.instr(F.lit(ALPHABET), c)
    return F.transform(F.split(value, ""), lambda c: F.when(at(c) > 0, at(c) - 1).otherwise(len(ALPHABET)))


def _pairs(value: Column) -> Column:
    """The pairs of neighbouring characters of a value, as first code * n + second code; each code is found once."""
    neighbours = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * (len(ALPHABET) + 1) + b)
    return F.when(F.length(value) > 1, once(_codes(value), neighbours)).otherwise(F.array().cast("array<int>"))


def log_ratios(samples: DataFrame, words: DataFrame | None = None) -> list[float]:
    """log P(next | character) of random strings less that of ordinary ones, for each pair of characters, smoothed.

    samples has random and value; words, if given, has value and n, ordinary strings and their counts, which together
    weigh as much as the ordinary samples.
    """
    n = len(ALPHABET) + 1
    pairs = samples.select(F.when(F.col("random"), 0).otherwise(1).alias("kind"), F.explode(_pairs(F.col("value"))).alias("pair"), F.lit(1).cast("long").alias("n"))
    if words is not None:
        pairs = pairs.union(words.select(F.lit(2), F.explode(_pairs(F.col("value"))), "n"))
    counts = {(r["kind"], r["pair"]): float(r["n"]) for r in pairs.groupBy("kind", "pair").agg(F.sum("n").alias("n")).collect()}  # at most 3 n^2 rows
    whole = [sum(c for (kind, _), c in counts.items() if kind == k) for k in range(3)]
    scale = whole[1] / whole[2] if whole[2] else 0.0
    seen = {True: lambda pair: counts.get((0, pair), 0.0), False: lambda pair: counts.get((1, pair), 0.0) + scale * counts.get((2, pair), 0.0)}
    out = []
    for a in range(n):
        total = {r: sum(seen[r](a * n + b) for b in range(n)) for r in (True, False)}
        odds = lambda r, b: (seen[r](a * n + b) + 0.5) / (total[r] + 0.5 * n)  # noqa: B023, E731
        out += [math.log(odds(True, b) / odds(False, b)) for b in range(n)]
    return out


def fit(docs: DataFrame, *, text_col: str = "text") -> list[float]:
    """The models' ratios, the ordinary one also from the words of all documents that hold no base span."""
    base = F.col(text_col).rlike("|".join(f"(?:{pattern})" for pattern, _, _ in PATTERNS.values()))
    found = F.regexp_extract_all(text_col, F.lit("[A-Za-z0-9+/_=-]{2,}"), F.lit(0))
    words = docs.where(~base).select(F.explode(found).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return log_ratios(labelled_samples(docs.sparkSession), words)


#: Elements of an array that are scanned together: the cost of an element grows with CHUNK and not with the array.
CHUNK = 256


def chunked(values: Column) -> Column:
    """An array cut into arrays of CHUNK elements; the array is computed once."""
    starts = lambda v: F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(CHUNK))
    return once(values, lambda v: F.transform(starts(v), lambda at: F.slice(v, at, CHUNK)))


def before(chunks: Column, merge, kind: str) -> Column:
    """What merge makes of zero and all elements before each one, for an array in chunks: array<kind>."""
    zero = F.lit(0).cast(kind)
    total = lambda acc, part: F.aggregate(part, acc, merge)
    heads = F.aggregate(chunks, F.array(zero), lambda acc, part: F.array_append(acc, total(F.element_at(acc, -1), part)))
    within = lambda head, part: F.transform(part, lambda _, i: total(head, F.slice(part, F.lit(1), i)))
    return F.flatten(F.zip_with(F.slice(heads, F.lit(1), F.size(chunks)), chunks, within))


def matches(text: Column, pattern: str, kind: str, keep) -> Column:
    """array<struct<start, rank, end, kind, hit>> of the matches of pattern for which keep(hit) holds."""
    rank = [*PATTERNS, "markov"].index(kind)
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind_of = "array<struct<start:int,rank:int,end:int,kind:string,hit:string>>"
    pieces = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), hit.alias("hit")))
    chunks = chunked(pieces)

    def spans(chunks: Column) -> Column:
        lengths = F.transform(chunks, lambda part: F.transform(part, lambda x: x["gap"] + x["size"]))
        return F.zip_with(before(lengths, lambda a, b: a + b, "int"), F.flatten(chunks), span)

    def span(at: Column, x: Column) -> Column:
        start = at + x["gap"]
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit"))

    found = F.filter(once(chunks, spans), lambda s: keep(s["hit"])).cast(kind_of)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind_of))


def once(value: Column, use) -> Column:
    """use(value), with the value computed once although use names it several times."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Characters of a block of a text that spans are cut from: the cost of a cut grows with the span and BLOCK, not with the text.
BLOCK_BITS = 12


def blocked(text: Column) -> Column:
    """A text as an array of blocks of 2^BLOCK_BITS characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << BLOCK_BITS}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """The text of blocks from start to end; empty where end is not behind start."""
    first = F.shiftright(start, BLOCK_BITS)
    last = F.shiftright(F.greatest(end - 1, start), BLOCK_BITS)
    return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), F.pmod(start, F.lit(1 << BLOCK_BITS)) + 1, end - start)


def scan(df: DataFrame, model: list[float] | None = None, *, text_col: str = "text") -> DataFrame:
    """df with base and spans (arrays of spans by start, then kind), n_assign, n_access, n_hex; model is that of fit."""
    model = log_ratios(labelled_samples(df.sparkSession)) if model is None else model
    ratios = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")  # one literal, folded
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = df
    for kind, (pattern, group, least) in PATTERNS.items():
        long_enough = lambda hit, p=pattern, g=group, m=least: F.length(F.regexp_extract(hit, p, g)) >= m
        found = found.withColumn(f"_{kind}", matches(text, pattern, kind, long_enough))

    found = found.withColumn("_base", F.array_sort(F.concat(*(F.col(f"_{k}") for k in PATTERNS))))
    found = found.withColumn("_runs", matches(text, CANDIDATE, "markov", lambda hit: F.lit(True)))
    parts = lambda r: once(blocked(r["hit"]), lambda blocks: F.transform(stretches(r["hit"], ratios), lambda x: _part(r, blocks, r["start"] + x["start"], r["start"] + x["end"])))
    found = found.withColumn("_markov", F.flatten(F.transform("_runs", parts)))
    apart = once(_sorted_chunks(F.col("_base")), lambda chunks: F.flatten(F.transform("_markov", lambda x: _clipped(x, chunks))))
    kept = [c for c in df.columns if c not in {"base", "spans", "n_assign", "n_access", "n_hex"}]
    sizes = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select(*kept, F.col("_base").alias("base"), F.array_sort(F.concat("_base", apart)).alias("spans"), *sizes)


def best_stretch(steps: Column) -> Column:
    """The greatest sum of neighbouring values of an array, 0 at least, by one scan."""
    state = "struct<sum:double,best:double>"
    begin = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("best")).cast(state)
    add = lambda a, x: once(F.greatest(a["sum"] + x, F.lit(0.0)), lambda s: F.struct(s.alias("sum"), F.greatest(a["best"], s).alias("best")))
    return F.aggregate(steps, begin, add, lambda a: a["best"])


def stretches(hit: Column, ratios: Column) -> Column:
    """array<struct<start, end>> of the stretches of a run that look random, ends exclusive."""

    def valued(piece: Column) -> Column:
        """A piece with its worth, and whether it looks random as a whole or holds a stretch that does."""
        ratio = lambda pairs: F.transform(pairs, lambda p: F.element_at(ratios, p + 1))
        score = lambda pairs: once(ratio(pairs), lambda x: F.struct(best_stretch(x).alias("best"), F.aggregate(x, F.lit(0.0), lambda a, b: a + b).alias("sum")))
        all_pairs = lambda pairs: F.struct(score(pairs).alias("every"), score(F.array_distinct(pairs)).alias("unlike"))
        worth = lambda s: F.struct(F.least(s["every"]["best"], s["unlike"]["best"]).alias("worth"), (s["every"]["sum"] > 0).alias("whole"))
        shape = lambda w: F.struct(piece["start"].alias("start"), piece["end"].alias("end"), w["worth"].alias("worth"), (w["whole"] | (w["worth"] > MARGIN)).alias("random"))
        return once(once(once(_pairs(piece["hit"]), all_pairs), worth), shape)

    def grouped(pieces: Column) -> Column:
        """Neighbouring pieces that look random, with what they are worth together."""
        short = lambda p: p["end"] - p["start"] < SHORT
        marks = F.array_join(F.transform(pieces, lambda p: F.when(p["random"], "1").when(short(p), "s").otherwise("0")), "")
        marks = F.regexp_replace(marks, "(?<=1)s(?=1)", "1")
        group = lambda g: once(F.slice(pieces, g["start"] + 1, g["end"] - g["start"]), joined)
        return F.transform(once(marks, lambda m: matches(m, "1+", "markov", lambda _: F.lit(True))), group)

    def joined(part: Column) -> Column:
        worth = F.aggregate(part, F.lit(0.0), lambda a, p: a + p["worth"])
        return F.struct(F.element_at(part, 1)["start"].alias("start"), F.element_at(part, -1)["end"].alias("end"), worth.alias("worth"))

    pieces = F.transform(matches(hit, "[^/_-]+", "markov", lambda _: F.lit(True)), valued)
    found = F.filter(once(pieces, grouped), lambda g: (g["worth"] > MARGIN) & (g["end"] - g["start"] >= LEAST))
    return F.transform(found, lambda g: F.struct(g["start"], g["end"]))


def _part(span: Column, blocks: Column, start: Column, end: Column) -> Column:
    """The part of a span from start to end, its text cut from the blocks of the span's."""
    hit = cut(blocks, start - span["start"], end - span["start"])
    return F.struct(start.alias("start"), span["rank"].alias("rank"), end.alias("end"), span["kind"].alias("kind"), hit.alias("hit"))


def _sorted_chunks(base: Column) -> Column:
    """Spans that are sorted by start, in chunks with the least start and the greatest end."""
    return F.transform(chunked(base), lambda part: F.struct(part.alias("spans"), F.try_element_at(part, F.lit(1))["start"].alias("low"), F.array_max(F.transform(part, lambda b: b["end"])).alias("high")))


def _clipped(span: Column, chunks: Column) -> Column:
    """The parts of a span that no base span covers; only chunks of base spans that it meets are looked through."""
    near = F.flatten(F.transform(F.filter(chunks, lambda c: (c["low"] < span["end"]) & (span["start"] < c["high"])), lambda c: c["spans"]))
    meets = F.filter(near, lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))
    kind_of = "struct<at:int,out:array<struct<start:int,rank:int,end:int,kind:string,hit:string>>>"
    begin = F.struct(span["start"].alias("at"), F.array().alias("out")).cast(kind_of)

    def parts(blocks: Column) -> Column:
        upto = lambda acc, end: F.when(end > acc["at"], F.array_append(acc["out"], _part(span, blocks, acc["at"], end))).otherwise(acc["out"])
        return F.aggregate(meets, begin, lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), upto(acc, b["start"]).alias("out")).cast(kind_of), lambda acc: upto(acc, span["end"]))

    return F.when(F.size(meets) > 0, once(blocked(span["hit"]), parts)).otherwise(F.array(span))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(df: DataFrame, model: list[float] | None = None, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span of its text replaced by mark; no row is dropped, a null text stays null. model is that of fit."""
    text = F.col(text_col)

    def replaced(blocks: Column, chunks: Column) -> Column:
        """The text between the spans and the marks; nothing for a span that begins within those before it."""
        ends = F.transform(chunks, lambda part: F.transform(part, lambda s: s["end"]))
        piece = lambda at, s: F.when(s["start"] >= at, F.concat(cut(blocks, at, s["start"]), F.lit(mark))).otherwise("")
        pieces = F.zip_with(before(ends, lambda a, b: F.greatest(a, b), "int"), F.flatten(chunks), piece)
        return F.concat(F.array_join(pieces, ""), text.substr(F.array_max(F.flatten(ends)) + 1, F.length(text)))

    clean = once(blocked(text), lambda blocks: once(chunked(F.col("spans")), lambda chunks: replaced(blocks, chunks)))
    found = scan(df, model, text_col=text_col)
    return found.withColumn(text_col, F.when(F.size("spans") > 0, clean).otherwise(text)).select(df.columns)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
