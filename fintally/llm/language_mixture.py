"""Language identification as multilingual mixture inference.

Each language has a likelihood over hashed byte trigrams of lower-case text, learned from a bounded sample. A document is a
mixture: expectation-maximisation estimates the proportions of the languages from all its trigrams. The language set
is chosen by penalised likelihood: languages enter in the order of their proportions as long as the likelihood gains
more than PENALTY times the log of the trigram count. The prediction is the largest proportion of the chosen set.

Cases: a null text, or one without a letter, is `und` with score 0; a text of any length counts whole; equal
proportions go to the first language in text order; without labelled rows every prediction is `und`; extra columns
are kept, and columns named as the results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fintally.llm.common import held_out, slices, table

#: Labelled documents of each language that the model learns from at most: those with the least hash of the id.
SAMPLE = 1000
#: Counts of up to so many languages are broadcast.
LANGUAGES = 10_000
BINS = 1 << 13
ROUNDS, PENALTY, SMOOTHING = 12, 2.0, 0.5
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def trigram_bins(text: str) -> np.ndarray:
    """The bins of all byte trigrams of the lower-case text, with white space at both ends."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 13)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.likelihood = smooth / smooth.sum(axis=1, keepdims=True) if len(languages) else smooth

    def mixture(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of the rows of p by expectation-maximisation for counts n, and the log-likelihood."""
        share = np.full(len(p), 1 / len(p))
        for _ in range(ROUNDS if len(p) > 1 else 0):
            joint = share[:, None] * p
            share = (joint / joint.sum(axis=0) * n).sum(axis=1) / n.sum()
        return share, float(np.log(share @ p) @ n)

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """Language, its proportion, and the proportions of the chosen set."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, {}
        n = np.bincount(trigram_bins(text), minlength=BINS)
        bins = np.flatnonzero(n)
        p, n = self.likelihood[:, bins], n[bins].astype(np.float64)
        order = np.argsort(-self.mixture(p, n)[0], kind="stable")
        chosen, cost = 1, PENALTY * np.log(n.sum() + 1)
        share, fit = self.mixture(p[order[:1]], n)
        while chosen < len(order):
            more, better = self.mixture(p[order[: chosen + 1]], n)
            if better - fit <= cost:
                break
            chosen, share, fit = chosen + 1, more, better
        best = int(np.argmax(share))
        return self.languages[order[best]], float(share[best]), {self.languages[k]: float(s) for k, s in zip(order, share, strict=False)}


def fit(docs: DataFrame) -> Model:
    """A model from the labelled documents that are not held out, SAMPLE of each language at most."""
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out("doc_id"))
    # twice the sample by a threshold of the hash first, so that no task ranks a whole language
    n = known.groupBy("lang").agg(F.count("*").alias("n"))
    if n.limit(LANGUAGES + 1).count() <= LANGUAGES:  # else Spark may deal the rows by language to join them
        n = F.broadcast(n)
    near = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(float(1 << 63)) < F.lit(2.0 * SAMPLE) / F.col("n")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 1), "doc_id"))
    chosen = known.select("doc_id", "lang").join(n, "lang").where(near).withColumn("place", place).where(F.col("place") <= SAMPLE).select("doc_id", "lang").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in slices(batches):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                total.setdefault(lang, np.zeros(BINS, np.int64))
                total[lang] += np.bincount(trigram_bins(text), minlength=BINS)
        for lang, n in total.items():
            bins = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins)), pa.array(bins), pa.array(n[bins])], names=["lang", "bin", "n"])

    # the sample is bounded, so it is broadcast
    counted = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text").mapInArrow(count, "lang string, bin long, n long")
    rows = counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()  # at most languages x BINS rows
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), BINS))
    np.add.at(counts, (np.searchsorted(languages, rows["lang"]) if len(rows) else [], rows["bin"].to_numpy()), rows["n"].to_numpy())
    return Model(languages, counts)


def identified(df: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score and proportions (a map of the chosen set)."""
    kept = [f for f in df.schema.fields if f.name not in ("lang_pred", "score", "proportions")]
    schema = type(df.schema)([*kept]).add("lang_pred", "string").add("score", "double").add("proportions", T.MapType(T.StringType(), T.DoubleType()))
    given = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            found = [given.value.predict(t) for t in part.column(text_col).to_pylist()]
            lang, score, share = zip(*found, strict=True)
            shares = pa.array([list(s.items()) for s in share], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64()), shares], names=schema.fieldNames())

    return df.select([f.name for f in kept]).mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.least(F.lit(1.0), "score").alias("score"))
