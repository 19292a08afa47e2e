"""Phrases, clusters and the mixture: brute force on small inputs, and awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fintally.llm import centroid_clusters, source_mixture, suffix_phrases

DOCS = "doc_id long, text string, lang string, source string, score double, rank string, size string"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns named as results."""
    rng = np.random.default_rng(1)
    common = ["the", "Of", "and", "new york", "new york city", "Ärger", "\t", "a b", "x\x00y"]
    text = lambda n: "".join(common[i] + " ,.\n;"[j] for i, j in zip(rng.integers(0, 9, n), rng.choice([0, 0, 0, 0, 1, 2, 3, 4], n)))
    rows = [(i, text(40), "en" if i % 3 else "de", f"s{i % 4}") for i in range(60)]
    rows += [(60, None, "en", "s0"), (61, "", None, None), (62, text(30), None, None), (63, text(3000), "en", "s1"), (64, " \n.\t", "fr", "s9"), (None, text(50), "en", "s2")]
    rows += [(65, "same words here again and again", "en", "s3")] * 7 + [(66, "one", "en", "s4"), (67, "two", "en", "s4")]
    return spark.createDataFrame([(*r, 0.5, "r", "z") for r in rows], DOCS)


# 11 phrases


def brute_phrases(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for n in range(1, 5):
                counts[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside[p[i : i + n]], a)
        best = []
        for p, a in found.items():
            if 100 * inside[p] < 80 * a:
                score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "shard", "bits"), [(5, 2000, 1 << 20, 1 << 20), (2, 15, 300, 64), (30, 5, 1000, 1 << 12)])
def test_phrases_equal_brute_force(spark, docs, least, top, shard, bits):
    want = brute_phrases([(r["text"], r["lang"]) for r in docs.collect()], least, top)
    got = suffix_phrases.collocations(docs, least, top, bits, shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want
    assert want


def test_phrases_of_nothing(spark, docs):
    assert suffix_phrases.collocations(docs.limit(0)).count() == 0
    assert suffix_phrases.collocations(docs.where("text is null or text = ''")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=8))
def test_intervals_count_all_ngrams(pieces):
    ids = np.array([x for p in pieces for x in p], np.int64)
    reach = np.array([len(p) - i for p in pieces for i in range(len(p))], np.int64)
    order, common = suffix_phrases.suffix_array(ids, reach, 4)
    for n in range(1, 5):
        at, counts = suffix_phrases.intervals(order, common, reach, n)
        want = Counter(tuple(p[i : i + n]) for p in pieces for i in range(len(p) - n + 1))
        assert dict(zip([tuple(ids[i : i + n].tolist()) for i in at], counts.tolist(), strict=True)) == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBé \t\n.,\x0b \x00", max_size=60))
def test_words_and_pieces(text):
    ids, words, piece = suffix_phrases.words_of(text.encode())
    got = defaultdict(list)
    for i, p in zip(ids, piece, strict=True):
        got[int(p)].append(words[int(i)].as_py())
    split = [re.findall("[^\x20\x09]+", x.replace("B", "b")) for x in re.split("[.,;:!?\x0a-\x0d]", text)]
    assert [got[i] for i in sorted(got)] == [x for x in split if x]


def test_long_texts_are_cut_between_pieces():
    text = b"one two three. " * 1000
    parts = list(suffix_phrases._parts(text, 100))
    assert b"".join(parts) == text and len(parts) > 100 and all(p.endswith((b".", b" ")) for p in parts)
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en"], "text": [text.decode(), None, "x" * 500]})
    assert sum(t.count(b"three") for _, t in suffix_phrases.shards([batch], 100)) == 1000


# 12 clusters


def brute_clusters(rows, k=16, rounds=3, size=64):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.clip(np.floor(64 * float(x)), -(1 << 27), 1 << 27)) for x in v]))
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [q for _, q in sorted(kept, key=key)[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        found = [near(q)[1] for _, q in kept]
        for j in range(len(centroids)):
            if own := [q for (_, q), f in zip(kept, found, strict=True) if f == j]:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [(i, *near(q)[::-1]) for i, q in kept]
    sums = Counter()
    for _, c, d in last:
        sums[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sums[c], sum(sums.values()), digest[c]) for i, c, d in last), key=str)


def embeddings(spark, n, size=64):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(5, size)) * rng.choice([0.2, 1, 5], (5, 1))
    rows = [(i, (middles[i % 5] + rng.normal(size=size) / 10).tolist(), "x") for i in range(n)]
    odd = [(n, None, "x"), (n + 1, [], "x"), (n + 2, [1.0] * (size - 1), "x"), (n + 3, [1.0] * size + [1.0], "x"), (n + 4, [None] + [1.0] * (size - 1), "x")]
    odd += [(n + 5, [float("nan")] + [1.0] * (size - 1), "x"), (n + 6, [float("-inf")] * size, "x"), (None, [0.5] * size, None)]
    odd += [(2, rows[2][1], "x")] * 3 + [(n + 7, [0.0] * size, "x")] * 2 + [(n + 8, [3e38] + [-3e38] * (size - 1), "x")]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, cluster string")


@pytest.mark.parametrize(("n", "size"), [(150, 64), (3, 64), (60, 13)])
def test_clusters_equal_brute_force(spark, n, size):
    given_rows = embeddings(spark, n, size)
    want = brute_clusters([(r["vec_id"], r["embedding"]) for r in given_rows.collect()], size=size)
    got = centroid_clusters.clustered(given_rows, size=size).drop("exact")
    assert sorted(map(tuple, got.collect()), key=str) == [(*r[:3], r[3] if r[3] < 1 << 63 else None, r[4] if r[4] < 1 << 63 else None, r[5]) for r in want]


def test_screening_prunes_and_keeps_the_nearest():
    rng = np.random.default_rng(5)
    centroids = (rng.normal(size=(16, 64)) * rng.choice([10, 200, 4000], (16, 1))).astype(np.int64)
    q = centroids[rng.integers(0, 16, 3000)] + rng.integers(-9, 9, (3000, 64))
    cluster, best, exact = centroid_clusters.nearest(q, centroid_clusters.segment_norms(q), centroids)
    full = ((q[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (best == full.min(axis=1)).all() and (cluster == full.argmin(axis=1)).all()
    assert exact.mean() < 6 and (centroid_clusters.lower_bounds(centroid_clusters.segment_norms(q), centroid_clusters.segment_norms(centroids)) <= full).all()


def test_clusters_of_nothing(spark):
    empty = centroid_clusters.clustered(embeddings(spark, 3).limit(0))
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "cluster", "distance"]


# 13 mixture


def seats(weights, caps, total):
    """Highest quotients, one seat at a time."""
    got = [0] * len(weights)
    for _ in range(min(total, sum(caps))):
        i = max((i for i in range(len(weights)) if got[i] < caps[i]), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_equals_one_seat_at_a_time(spark, seed):
    rng = np.random.default_rng(seed)
    groups = []
    for g in range(12):
        n = int(rng.integers(1, 9))
        weights, caps = rng.integers(1, 9, n).tolist(), rng.integers(0, 60, n).tolist()
        groups.append((g, weights, caps, int(rng.integers(0, sum(caps) + 5))))
    rows = [(g, i, total, w, c) for g, weights, caps, total in groups for i, (w, c) in enumerate(zip(weights, caps, strict=True))]
    df = spark.createDataFrame(rows, "g long, i long, total long, w long, c long")
    got = {(r["g"], r["i"]): r["quota"] for r in source_mixture.apportioned(df, ["g"], "i", "total", "w", "c").collect()}
    assert got == {(g, i): q for g, weights, caps, total in groups for i, q in enumerate(seats(weights, caps, total))}


def poured(sizes, weights, share=1.5, most=2):
    """Shares stop at the cap and the excess goes to the others, until none is above."""
    full = set()
    while True:
        left = share * sum(sizes) - sum(most * sizes[i] for i in full)
        level = left / sum(w for i, w in enumerate(weights) if i not in full)
        more = {i for i, w in enumerate(weights) if i not in full and w * level > most * sizes[i]}
        if not more:
            return [most * s if i in full else weights[i] * level for i, s in enumerate(sizes)]
        full |= more


@pytest.mark.parametrize(("block", "shard"), [(32, 1 << 20), (4, 200), (1, 37)])
def test_mixture(spark, docs, block, shard):
    got = rows_of(source_mixture.mixed(docs, block=block, shard=shard))
    given_rows = docs.collect()
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r["doc_id"]), count(r["text"])) for r in given_rows)
    names = sorted({r["source"] for r in given_rows} - {None}) + [None]
    sizes = [sum(count(r["text"]) for r in given_rows if r["source"] == s) for s in names]
    targets = poured(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    by = {(r["doc_id"], r["size"]): r["source_size"] for r in got}
    for r in given_rows:
        assert by[r["doc_id"], count(r["text"])] == sizes[names.index(r["source"])]
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[round(r["target"], 6), r["source_size"]] += r["taken"]
    wanted = Counter()
    for s, t in zip(sizes, targets, strict=True):
        wanted[round(t, 6), s] += t
    assert all(abs(taken[k] - t) <= 2 * block + 2 for k, t in wanted.items())
    assert Counter(map(str, got)) == Counter(map(str, rows_of(source_mixture.mixed(docs.repartition(3), block=block, shard=shard))))


def test_mixture_of_nothing_and_of_repeated_rows(spark, docs):
    assert source_mixture.mixed(docs.limit(0)).count() == 0
    assert {r["taken"] for r in rows_of(source_mixture.mixed(docs.where("text is null or text = ''")))} == {0}
    many = spark.range(2500).selectExpr("1L as doc_id", "if(id < 2400, 'a', 'b') as source", "'one two three' as text")
    got = rows_of(source_mixture.mixed(many, block=4))
    assert len(got) == 2500 and all(0 <= r["taken"] <= 6 for r in got)
    assert abs(sum(r["taken"] for r in got) - 1.5 * 7500) <= 16
