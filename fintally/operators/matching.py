"""Labels and names: fuzzy look-up without lost candidates, the mapping cascade, token scores of names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from fintally.operators.workflow import jaro_winkler

#: Labels fuzzily equal differ in at most one of so many characters of the longer one.
CHARS_PER_EDIT = 20
# Kinds of entities that are persons; legal suffixes of business names.
PERSONS = ("guarantor", "spouse", "person")
SUFFIXES = frozenset("llc inc corp corporation co ltd lp llp pllc pc pa plc company incorporated limited".split())


def _pieces(label: Column, length: Column) -> Column:
    """Number of pieces that a label of a length is cut into: one more than the edits that it may differ by."""
    longest = F.floor(length * (CHARS_PER_EDIT + 1) / CHARS_PER_EDIT) + 1
    return (F.floor(longest / CHARS_PER_EDIT) + 1).cast("int")


def fuzzy_candidates(labels: DataFrame, pool: DataFrame) -> DataFrame:
    """Distinct (label, known) of labels.label and pool.known within one edit for each CHARS_PER_EDIT characters of the longer.

    A pool label is cut into one more piece than it may have edits, so that one piece stands unchanged in a fuzzily equal
    label, moved by no more than the edits. Labels look up all their substrings that can be such a piece, by an equi-join.
    """
    known = pool.select("known").where("known is not null").distinct().withColumn("n", F.length("known")).where(F.col("n") > 0)
    known = known.withColumn("k", _pieces(F.col("known"), F.col("n"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    start = lambda n, i, k: F.floor(i * n / k).cast("int")
    cut = lambda text, n, i, k, shift: F.substring(text, start(n, i, k) + shift + 1, start(n, i + 1, k) - start(n, i, k))
    held = known.select("known", "n", "i", cut(F.col("known"), F.col("n"), F.col("i"), F.col("k"), F.lit(0)).alias("piece"))
    ask = labels.select("label").where("label is not null").distinct().withColumn("m", F.length("label")).where(F.col("m") > 0)
    edits = F.floor((F.col("m") + F.floor(F.col("m") / CHARS_PER_EDIT) + 1) / CHARS_PER_EDIT).cast("int")
    ask = ask.withColumn("e", edits).withColumn("n", F.explode(F.sequence(F.greatest(F.col("m") - F.col("e"), F.lit(1)), F.col("m") + F.col("e"))))
    ask = ask.withColumn("k", _pieces(F.col("label"), F.col("n"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    ask = ask.withColumn("shift", F.explode(F.sequence(-F.col("e"), F.col("e")))).where(start(F.col("n"), F.col("i"), F.col("k")) + F.col("shift") >= 0)
    ask = ask.select("label", "n", "i", cut(F.col("label"), F.col("n"), F.col("i"), F.col("k"), F.col("shift")).alias("piece"))
    pairs = ask.join(held, ["n", "i", "piece"]).select("label", "known").distinct()
    longer = F.greatest(F.length("label"), F.length("known"))
    return pairs.withColumn("edits", F.levenshtein("label", "known")).where(F.col("edits") * CHARS_PER_EDIT <= longer).withColumn("similarity", 1 - F.col("edits") / longer)


def map_labels(labels: DataFrame, pool: DataFrame, containers: list[str]) -> DataFrame:
    """label, node and method of each distinct (tenant_id, label): the tenant's exact, then fuzzy mapping, then the global ones.

    pool: tenant_id (null: global), known, node, position. Of equal similarities the last position wins. A label that maps
    to a container node is unmapped.
    """
    asked = labels.select("tenant_id", "label").distinct()
    near = fuzzy_candidates(asked, pool)
    # of one owner's mappings of a known label the last one wins whatever asks: the others never meet a label
    pool = pool.groupBy("tenant_id", "known").agg(F.max_by(F.struct("node", "position"), F.struct("position")).alias("m")).select("tenant_id", "known", "m.*")
    found = asked.join(near, "label").join(pool.withColumnRenamed("tenant_id", "owner"), "known").where(F.col("owner").isNull() | (F.col("owner") == F.col("tenant_id")))
    exact, own = F.col("edits") == 0, F.col("owner").isNotNull()
    method = F.when(own & exact, "exact_tenant").when(own, "fuzzy_tenant").when(exact, "exact_global").otherwise("fuzzy_global")
    place = F.when(own & exact, 3).when(own, 2).when(exact, 1).otherwise(0)
    best = found.withColumn("method", method).groupBy("tenant_id", "label").agg(F.max_by(F.struct("node", "method"), F.struct(place, "similarity", "position")).alias("m"))
    good = ~F.col("m.node").isin(containers) if containers else F.col("m.node").isNotNull()
    best = best.withColumnsRenamed({"tenant_id": "_tenant", "label": "_label"})
    out = asked.join(best, F.col("tenant_id").eqNullSafe(F.col("_tenant")) & (F.col("label") == F.col("_label")), "left")
    return out.select("tenant_id", "label", F.when(good, F.col("m.node")).alias("node"), F.when(F.coalesce(good, F.lit(False)), F.col("m.method")).otherwise("unmapped").alias("method"))


def clean(name: Column) -> Column:
    """Lower-case letters and digits with single blanks."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def token_score(a: list[str], b: list[str]) -> float:
    """Order-free alignment of name tokens: equal 1, an initial 0.78, a spelling variant its similarity from 0.8 on; each token too many costs 0.04."""
    small, large = sorted((a, b), key=len)
    if not small:
        return 0.0
    free, total = list(large), 0.0
    for token in small:
        best, at = 0.0, None
        for i, other in enumerate(free):
            if token == other:
                score = 1.0
            elif min(len(token), len(other)) == 1:
                score = 0.78 if token[0] == other[0] else 0.0
            else:
                score = jaro_winkler(token, other)
                score = score if score >= 0.8 else 0.0
            if score > best:
                best, at = score, i
        if at is not None:
            del free[at]
        total += best
    return max(0.0, total / len(small) - 0.04 * (len(large) - len(small)))


def business_forms(cleaned: str) -> list[list[str]]:
    """The names of a business, cut at `doing business as`, without legal suffixes."""
    text = f" {cleaned} ".replace(" doing business as ", " dba ").replace(" d b a ", " dba ")
    return [[t for t in part.split() if t not in SUFFIXES] for part in text.split(" dba ") if part.strip()]


@F.pandas_udf(IntegerType())
def name_points(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Score of two clean names in ten-thousandths, by kind (person or business); null where a name is."""
    for a, b, kind in batches:
        out = []
        for x, y, k in zip(a, b, kind, strict=True):
            if x is None or y is None:
                out.append(None)
            elif k != "person":
                out.append(int(10_000 * max((token_score(p, q) for p in business_forms(x) for q in business_forms(y)), default=0.0) + 0.5))
            else:
                out.append(int(10_000 * token_score(x.split(), y.split()) + 0.5))
        yield pd.Series(out, dtype="Int32")


def pick_identity(candidates: DataFrame) -> DataFrame:
    """The identity text of each document: of the first path, then of the second, the first field with three characters or more."""
    usable = candidates.where(F.length(F.trim("value_text")) >= 3)
    return usable.groupBy("document_id").agg(F.min_by(F.trim("value_text"), F.struct("path", "field_order")).alias("identity"))


def match_entities(named: DataFrame, entities: DataFrame) -> DataFrame:
    """The entity of each document by its name: of its deal's persons or of its others, as the identity is, or of all if there is none such.

    named: document_id, deal_id, kind, identity; entities: deal_id, entity_id, kind, name. Names are compared as the
    identity's kind says; the first of ties wins, and a score of zero names no entity. A deal has few entities, so that
    pairs are those within a deal; a document of a deal without any has no row.
    """
    e = entities.select("deal_id", "entity_id", F.col("kind").alias("entity_kind"), "name")
    pairs = named.join(e, "deal_id").withColumn("same", ((F.col("kind") == "person") == F.col("entity_kind").isin(*PERSONS)).cast("int"))
    fits = pairs.groupBy("document_id").agg(F.max("same").alias("any_same"))
    pairs = pairs.join(fits, "document_id").where(F.col("same") == F.col("any_same"))
    points = F.coalesce(name_points(clean(F.col("identity")), clean(F.col("name")), F.col("kind")), F.lit(0))
    scored = pairs.withColumn("points", points)
    return scored.groupBy("document_id").agg(F.min_by(F.struct("entity_id", "points"), F.struct(-F.col("points"), "entity_id")).alias("m")).select("document_id", F.when(F.col("m.points") > 0, F.col("m.entity_id")).alias("entity_id"), "m.points")


#: Characters of the names in one block, and cells of distance rows that a search holds before it is halved.
BLOCK_CHARS, MOST_CELLS = 2_000_000, 4_000_000


def nearest_names(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(a, key, points) of each distinct asked.a: the most similar of all known.n by levenshtein, as text.similarity_points has it.

    known: n, key; of equal names and of equal points the least key wins, null last. Nulls are no names. Batches of asked
    names meet blocks of known ones, which are broadcast. In a block names that begin alike share their distances: a
    search follows beginnings and leaves those that can't lead to a name as similar as the best one so far, so that the
    result is that of all pairs.
    """
    none = F.lit((1 << 63) - 1)
    known = known.where("n is not null").groupBy("n").agg(F.coalesce(F.min("key"), none).alias("key"))
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = asked.select("a").where("a is not null").repartition(parts, "a").distinct()
    blocks, batches = known.mapInPandas(_in_blocks, "names array<string>, keys array<long>"), names.mapInPandas(_in_batches, "asked array<string>")
    found = batches.crossJoin(F.broadcast(blocks)).mapInPandas(_best_in_block, "a string, key long, points int")
    best = found.groupBy("a").agg(F.min(F.struct((-F.col("points")).alias("minus"), "key")).alias("m"))
    return best.select("a", F.when(F.col("m.key") != none, F.col("m.key")).alias("key"), (-F.col("m.minus")).alias("points"))


def _in_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names and keys as lists of so many names that the longest one's length times their number is bounded."""
    names, keys, longest = [], [], 1
    for batch in batches:
        for name, key in zip(batch["n"], batch["key"], strict=True):
            if names and max(longest, len(name)) * (len(names) + 1) > BLOCK_CHARS:
                yield pd.DataFrame({"names": [names], "keys": [keys]})
                names, keys, longest = [], [], 1
            names.append(name)
            keys.append(int(key))
            longest = max(longest, len(name))
    if names:
        yield pd.DataFrame({"names": [names], "keys": [keys]})


def _in_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield pd.DataFrame({"asked": [batch["a"].tolist()]})


def _best_in_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for asked, names, keys in zip(batch["asked"], batch["names"], batch["keys"], strict=True):
            block = Beginnings(list(names), list(keys))
            by_length: dict[int, list[str]] = {}
            for name in asked:
                by_length.setdefault(len(name), []).append(name)
            for length, group in by_length.items():
                step = max(1, MOST_CELLS // (8 * (length + 1)))
                for at in range(0, len(group), step):
                    some = group[at : at + step]
                    points, key = block.nearest(some)
                    yield pd.DataFrame({"a": some, "key": key, "points": points.astype("int32")})


def _codes(names: list[str], width: int) -> np.ndarray:
    """Code points of names, a row each; -1 behind their end."""
    out = np.full((len(names), width), -1, dtype=np.int32)
    for length in {len(x) for x in names} - {0}:
        at = [i for i, x in enumerate(names) if len(x) == length]
        out[at, :length] = np.frombuffer("".join(names[i] for i in at).encode("utf-32-le", "surrogatepass"), dtype="<i4").reshape(-1, length)
    return out


class Beginnings:
    """The beginnings of sorted names: of each length the runs of names that share one, with the bounds of what follows."""

    def __init__(self, names: list[str], keys: list[int]):
        order = sorted(range(len(names)), key=names.__getitem__)
        self.names, self.keys = [names[i] for i in order], np.array([keys[i] for i in order], dtype=np.int64)
        self.size = np.array([len(x) for x in self.names], dtype=np.int32)
        self.codes = _codes(self.names, int(self.size.max()))
        # of beginnings of k characters: where each run starts, its last character, bounds, and the runs of k + 1 in it
        new = np.zeros(len(self.names), dtype=bool)
        new[0] = True
        self.starts, self.levels = [np.zeros(1, dtype=np.int64)], []
        for k in range(self.codes.shape[1]):
            new[1:] |= self.codes[1:, k] != self.codes[:-1, k]
            at = np.flatnonzero(new)
            self.starts.append(at[self.codes[at, k] >= 0])
        # names that end before k have no run there: a run's end is that of its parent's, or the next run
        for k, at in enumerate(self.starts):
            if k == 0:
                end = np.array([len(self.names)])
            else:
                parent_end = self.levels[k - 1]["end"][np.searchsorted(self.starts[k - 1], at, side="right") - 1]
                end = np.minimum(np.append(at[1:], len(self.names)), parent_end)
            pairs = np.empty(2 * len(at), dtype=np.int64)
            pairs[0::2], pairs[1::2] = at, end
            reduce = lambda f, x: f.reduceat(np.append(x, x[-1:]), pairs)[0::2]
            level = {"end": end, "short": reduce(np.minimum, self.size), "long": reduce(np.maximum, self.size), "key": reduce(np.minimum, self.keys)}
            level["first"], level["last"] = (np.searchsorted(self.starts[k + 1], x) for x in (at, end)) if k + 1 < len(self.starts) else (at * 0, at * 0)
            self.levels.append(level)

    def nearest(self, asked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Points and key of the best name for each of asked, which are of one length."""
        m, n = len(asked[0]), len(asked)
        codes, self.steps = _codes(asked, m), np.arange(m + 1, dtype=np.int32)
        best, key = np.full(n, -1, dtype=np.int64), np.full(n, np.iinfo(np.int64).max)
        start = (0, np.arange(n), np.zeros(n, dtype=np.int64), np.tile(self.steps, (n, 1)))
        # one way down for each first, where the bound is best: what it finds bounds the whole search
        todo = start
        while todo is not None:
            todo = self._down(todo, codes, best, key, narrow=True)
        stack = [start]
        while stack:
            todo = stack.pop()
            if todo[3].size > MOST_CELLS and len(todo[1]) > 1:
                half = len(todo[1]) // 2
                stack += [(todo[0], *(x[part] for x in todo[1:])) for part in (slice(half, None), slice(half))]
                continue
            todo = self._down(todo, codes, best, key)
            if todo is not None:
                stack.append(todo)
        return best, key

    def _down(self, todo: tuple, codes: np.ndarray, best: np.ndarray, key: np.ndarray, narrow: bool = False) -> tuple | None:
        """Beginnings one character longer than those of todo (length, asked, run, distances), with names that end there taken."""
        k, q, run, rows = todo
        level, m = self.levels[k], codes.shape[1]
        at = self.starts[k][run]
        ends = np.flatnonzero(self.size[at] == k)
        if len(ends):
            longer = max(m, k)
            points = (longer - rows[ends, m].astype(np.int64)) * 10_000 // longer if longer else np.full(len(ends), 10_000)
            self._take(q[ends], points, self.keys[at[ends]], best, key)
        if k + 1 >= len(self.starts):
            return None
        counts = level["last"][run] - level["first"][run]
        total = int(counts.sum())
        if not total:
            return None
        of = np.repeat(np.arange(len(run)), counts)
        child = level["first"][run][of] + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        q, old, below = q[of], rows[of], self.levels[k + 1]
        char = self.codes[self.starts[k + 1][child], k]
        new = old + 1
        np.minimum(new[:, 1:], old[:, :-1] + (codes[q] != char[:, None]), out=new[:, 1:])
        new -= self.steps
        np.minimum.accumulate(new, axis=1, out=new)
        new += self.steps
        # what remains of the asked name and of the names below costs at least the difference of their lengths
        rest = m - self.steps
        low, high = below["short"][child] - (k + 1), below["long"][child] - (k + 1)
        least = (new + np.maximum(0, np.maximum(rest - high[:, None], low[:, None] - rest))).min(axis=1).astype(np.int64)
        longer = np.maximum(m, below["long"][child]).astype(np.int64)
        bound = (longer - least) * 10_000 // longer
        if narrow:
            order = np.lexsort((below["key"][child], -bound, q))
            keep = np.sort(order[np.append(True, q[order][1:] != q[order][:-1])])
        else:
            keep = np.flatnonzero((bound > best[q]) | ((bound == best[q]) & (below["key"][child] < key[q])))
        return (k + 1, q[keep], child[keep], new[keep]) if len(keep) else None

    @staticmethod
    def _take(q: np.ndarray, points: np.ndarray, keys: np.ndarray, best: np.ndarray, key: np.ndarray) -> None:
        order = np.lexsort((keys, -points, q))
        order = order[np.append(True, q[order][1:] != q[order][:-1])]
        q, points, keys = q[order], points[order], keys[order]
        better = (points > best[q]) | ((points == best[q]) & (keys < key[q]))
        best[q[better]], key[q[better]] = points[better], keys[better]
