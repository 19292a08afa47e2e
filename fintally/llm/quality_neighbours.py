"""Document quality by nearest-neighbour voting in a latent-semantic space.

A text is counted whole as hashed byte trigrams, of its bytes and of its shape (letter case, digits, punctuation),
plus how much its words and lines repeat. Inverse document frequencies and the latent axes (subspace iteration, a pass
each) come from every labelled document. SAMPLE of their vectors are the points of an index, and every labelled document
counts at its nearest point; points and counts are broadcast, at most SAMPLE x (AXES + 2) floats. Every document is
compared with all points, in exact blocked cosine products, and the labels at the NEAREST vote with their similarity.

Cases: a null or empty text has the zero vector and gets the mean label; texts count whole; several labels
of one document are averaged, and of its repeated rows the least text counts; null labels are ignored; without labels
every score is 0.5. Ties between points go to the least id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.llm.common import deleted, held_out, slices, table, written

#: Points of the index at most: labelled documents with the least hash of the id. Every labelled document counts at one.
SAMPLE = 4000
RAW_BINS, SHAPE_BINS = 1024, 1024
REPEAT_BINS = 16
WIDTH = RAW_BINS + SHAPE_BINS + REPEAT_BINS
AXES, NEAREST, ITERATIONS = 48, 25, 4
#: Similarities are raised to this power in the vote.
SHARPNESS = 8
BLOCK = 256

_SHAPE = np.arange(256, dtype=np.uint32)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[128:] = ord("a")


def _trigrams(b: np.ndarray, bins: int) -> np.ndarray:
    if len(b) < 3:
        return np.zeros(bins)
    h = (b[:-2] * np.uint32(65536) + b[1:-1] * np.uint32(256) + b[2:]) * np.uint32(2654435761)
    return np.bincount(h >> np.uint32(16) & np.uint32(bins - 1), minlength=bins)


def counts(text: str | None) -> np.ndarray:
    """Feature counts of a whole text, as log(1 + n)."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    out = np.zeros(WIDTH, np.float32)
    out[:RAW_BINS] = np.log1p(_trigrams(raw.astype(np.uint32), RAW_BINS))
    out[RAW_BINS : RAW_BINS + SHAPE_BINS] = np.log1p(_trigrams(_SHAPE[raw], SHAPE_BINS))
    words = (text or "").split()
    if words:
        scale = np.log1p(len(words))
        lines = [x for x in text.split("\n") if x.strip()]
        same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
        repeated = 1 - len(set(lines)) / max(1, len(lines))
        for k, share in enumerate((same, repeated)):
            out[RAW_BINS + SHAPE_BINS + 8 * k + min(7, int(8 * share))] = scale
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _count_rows(df: DataFrame, extra: str) -> DataFrame:
    """(extra columns, counts as float32 bytes) of df's text."""
    names = [c.split()[0] for c in extra.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [counts(t).astype(np.float16).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(rows, pa.binary())], names=[*names, "counts"])

    return df.select(*names, "text").mapInArrow(run, f"{extra}, counts binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of counts of their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)


class Model:
    """Weights of the features, latent axes, and the points with the number and the sum of the labels that count there."""

    def __init__(self, weight: np.ndarray, axes: np.ndarray, mean: float):
        self.weight, self.axes, self.mean = weight.astype(np.float32), np.ascontiguousarray(axes.astype(np.float32)), mean
        self.vectors, self.n, self.sums = np.zeros((self.axes.shape[1], 0), np.float32), np.zeros(0), np.zeros(0)

    def latent(self, rows: np.ndarray) -> np.ndarray:
        return _unit(_unit(rows.astype(np.float32) * self.weight) @ self.axes)

    def counted(self, vectors: np.ndarray, n: np.ndarray, sums: np.ndarray) -> Model:
        """The model with these points, but for those where nothing counts."""
        used = n > 0
        self.vectors, self.n, self.sums = np.ascontiguousarray(vectors[used].T), n[used], sums[used]
        return self

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The vote for each row of counts."""
        if not len(self.n):
            return np.full(len(rows), self.mean)
        cosine = self.latent(rows) @ self.vectors
        k = min(NEAREST, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = (weight * self.n[near]).sum(axis=1)
        vote = (weight * self.sums[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.clip(np.where(total > 0, vote, self.mean), 0, 1)


def _axes(rows: DataFrame, weight: np.ndarray, n: int) -> np.ndarray:
    """The latent axes of all rows, by subspace iteration: each round is a pass that sums the rows' shares by column."""
    basis = np.random.default_rng(0).standard_normal((WIDTH, min(AXES, max(1, n))))
    for _ in range(ITERATIONS if n else 0):
        # a column of the product of each task, then of all
        def run(batches: Iterator[pa.RecordBatch], basis=basis.astype(np.float32)) -> Iterator[pa.RecordBatch]:
            share = np.zeros(basis.shape)
            for batch in batches:
                if batch.num_rows:
                    x = _unit(_matrix(batch.column("counts")) * weight)
                    share += x.T @ (x @ basis)
            yield pa.RecordBatch.from_arrays([pa.array(range(basis.shape[1]), pa.int32()), pa.array([c.tobytes() for c in share.T], pa.binary())], names=["at", "share"])

        def add(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"at": group["at"].iloc[:1], "share": [sum(np.frombuffer(x) for x in group["share"]).tobytes()]})

        whole = rows.select("counts").mapInArrow(run, "at int, share binary").groupBy("at").applyInPandas(add, "at int, share binary").orderBy("at").collect()
        basis, _ = np.linalg.qr(np.stack([np.frombuffer(r["share"]) for r in whole], axis=1))
    return basis


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """A model from all labelled documents that are not held out."""
    known = labels.select(F.col("doc_id"), F.col(label).cast("double").alias("label")).where("doc_id is not null and label is not null").where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.avg("label").alias("label"))
    texts = docs.select("doc_id", "text").where(~held_out("doc_id")).join(known, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = written(_count_rows(texts, "doc_id long, label double"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, found = 0, 0.0, np.zeros(WIDTH, np.int64)
        for batch in batches:
            n, total = n + batch.num_rows, total + sum(batch.column("label").to_pylist())
            found += (_matrix(batch.column("counts")) > 0).sum(axis=0)
        values = [float(n), total, *found.astype(float).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.float64())], names=["at", "value"])

    # at 0 the rows, at 1 the sum of their labels, then the rows that have each feature
    sums = rows.mapInArrow(seen, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").toArrow().column("value").to_numpy()
    n, total, found = (int(sums[0]), sums[1], sums[2:]) if len(sums) else (0, 0.0, np.zeros(WIDTH))
    weight = (np.log((1 + n) / (1 + found)) + 0.1).astype(np.float32)
    model = Model(weight, _axes(rows, weight, n), float(total / n) if n else 0.5)
    # the points are bounded by SAMPLE
    points = rows.join(F.broadcast(rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)), "doc_id").orderBy("doc_id").select("counts").toArrow()
    vectors = model.latent(_matrix(points.column("counts"))) if points.num_rows else np.zeros((0, model.axes.shape[1]), np.float32)
    given = docs.sparkSession.sparkContext.broadcast((model, np.ascontiguousarray(vectors.T)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, at = given.value
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                point = np.argmax(model.latent(_matrix(part.column("counts"))) @ at, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(point, pa.int32()), part.column("label")], names=["point", "label"])

    counted = rows.select("label", "counts").mapInArrow(nearest, "point int, label double").groupBy("point").agg(F.count("*").alias("n"), F.sum("label").alias("total")).toArrow()
    deleted(rows)
    count, sums, point = np.zeros(len(vectors)), np.zeros(len(vectors)), counted.column("point").to_numpy()
    count[point], sums[point] = counted.column("n").to_numpy(), counted.column("total").to_numpy()
    return model.counted(vectors, count, sums)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted; columns of these names are replaced."""
    kept = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    schema = type(docs.schema)([*kept]).add("score", "double").add("predicted", "integer")
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, out = part.column("text").to_pylist(), []
            for at in range(0, len(texts), BLOCK):
                out.append(given.value.score(np.array([counts(t) for t in texts[at : at + BLOCK]]).astype(np.float16)))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=schema.fieldNames())

    return docs.select([f.name for f in kept]).mapInArrow(run, schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
