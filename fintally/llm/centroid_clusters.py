"""Integer k-means with block-norm screening.

A vector's components become integers, and its compressed form is the norm of each of its SEGMENTS. By the
Cauchy-Schwarz inequality in each segment |v|^2 + |c|^2 - 2 sum(|v_s| |c_s|) is not above the squared distance of v and
c. The centroid of the least bound gets its exact distance first; of the others only those whose bound is not above it
do. The norms are computed once and written with the vectors; each round reads that table, adds up each task's vectors
by centroid in exact integers, and brings only centroids x components sums to the driver.

Cases: vectors of another length, null, or with a null or non-finite component are left out; components are held within
+-LARGEST, where a squared distance still fits 64 bits; a null vec_id is hashed as an empty one; equal hashes go by
components; repeated rows count as often as they stand and may be centroids twice; below CENTROIDS vectors there are as
many centroids as vectors; an empty table gives no rows; a distance sum beyond 64 bits is null; other columns are
dropped, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fintally.llm.common import table, written

CENTROIDS, ROUNDS, COMPONENTS, SEGMENTS, SCALE = 16, 3, 64, 8, 64
LARGEST = 1 << 27
#: Vectors whose bounds are computed at once.
BLOCK = 8192


def vectors(embeddings: DataFrame, size: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, q: the kept vectors' components as floor(scale * x)."""
    whole = F.size("embedding") == size
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return embeddings.where(whole & finite).select("vec_id", q.alias("q"))


def segment_norms(q: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Norms of the segments of each row of integers; the last segment is shorter if the length asks for it."""
    edges = np.arange(segments) * -(-q.shape[1] // segments)
    return np.sqrt(np.add.reduceat(q.astype(np.int64) ** 2, edges[edges < q.shape[1]], axis=1).astype(np.float64))


def lower_bounds(norms: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Squared distances are not below these: rows x centroids, rounding taken off."""
    square = (norms**2).sum(axis=1)[:, None] + (other**2).sum(axis=1)[None, :]
    return square - 2 * norms @ other.T - 1e-9 * square - 1


def nearest(q: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, exact squared distance and the number of exact distances of each row of q."""
    bound = lower_bounds(norms, segment_norms(centroids))
    first = bound.argmin(axis=1)
    best, cluster = ((q - centroids[first]) ** 2).sum(axis=1), first.copy()
    asked = bound <= best[:, None]
    asked[np.arange(len(q)), first] = False
    for c in range(len(centroids)):
        rows = np.flatnonzero(asked[:, c])
        # a bound that is above the distance found meanwhile needs no look
        rows = rows[bound[rows, c] <= best[rows]]
        asked[:, c] = False
        asked[rows, c] = True
        d = ((q[rows] - centroids[c]) ** 2).sum(axis=1)
        better = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        best[rows[better]], cluster[rows[better]] = d[better], c
    return cluster, best, asked.sum(axis=1) + 1


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.slice(at, BLOCK)
            n = len(part)
            q = np.frombuffer(b"".join(part.column("q").to_pylist()), np.int32).reshape(n, -1).astype(np.int64)
            yield part.column("vec_id"), q, np.frombuffer(b"".join(part.column("norms").to_pylist()), np.float64).reshape(n, -1)


def compressed(kept: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """vec_id, q and norms as bytes: 32-bit integers and 64-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = batch.column("q")
            flat = q.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(batch), -1)
            norms = segment_norms(flat, segments)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in flat], pa.binary()), pa.array([r.tobytes() for r in norms], pa.binary())], names=["vec_id", "q", "norms"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id {kind}, q binary, norms binary")


def _sums(data: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(cluster, vectors, exact sums of components) of the clusters that are not empty: at most len(centroids) rows."""
    given = data.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros(given.value.shape, np.int64), np.zeros(len(given.value), np.int64)
        for _, q, norms in _rows(batches):
            cluster, _, _ = nearest(q, norms, given.value)
            for c in np.unique(cluster):
                totals[c] += q[cluster == c].sum(axis=0)
                counts[c] += (cluster == c).sum()
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(list(totals[used]), pa.list_(pa.int64()))], names=["cluster", "n", "totals"])

    parts = data.mapInArrow(run, "cluster int, n long, totals array<long>")
    sums = [F.sum(F.element_at("totals", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    return [(r["cluster"], r["n"], [int(r[f"s{i}"]) for i in range(centroids.shape[1])]) for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect()]


def clustered(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = COMPONENTS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and exact (distances that were not pruned) of each kept vector."""
    spark = embeddings.sparkSession
    kept = vectors(embeddings, size)
    kind = kept.schema["vec_id"].dataType.simpleString()
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = [r["q"] for r in kept.select(hashed.alias("h"), "q").orderBy("h", "q").limit(k).collect()]
    if not start:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, exact int")
    data, centroids = written(compressed(kept)), np.array(start, np.int64)
    for _ in range(rounds):
        for c, n, totals in _sums(data, centroids):
            centroids[c] = [t // n for t in totals]
    given = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, q, norms in _rows(batches):
            cluster, distance, exact = nearest(q, norms, given.value)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance), pa.array(exact, pa.int32())], names=["vec_id", "cluster", "distance", "exact"])

    out = written(data.mapInArrow(run, f"vec_id {kind}, cluster int, distance long, exact int"))
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()
    total, digests = sum(r["d"] for r in sums), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    fits = lambda d: int(d) if d < 1 << 63 else None
    found = spark.createDataFrame([(r["cluster"], fits(r["d"]), fits(total), digests[r["cluster"]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # a row for each centroid
    return out.join(F.broadcast(found), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "exact")


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each embedding after three rounds."""
    return clustered(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("exact")


_ASSIGN = """a{t} as (
  select vec_id, row, arg_min(cluster, (d, cluster)) as cluster, min(d) as d from (
    select v.vec_id, v.row, c.cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::bigint as d from kept v, c{t} c)
  group by vec_id, row)"""
_MOVE = """c{t} as (
  select c.cluster, coalesce(m.q, c.q) as q from c{s} c left join (
    select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as q from (
      select a.cluster, i, sum(v.q[i])::hugeint as s, count(*) as n from a{s} a join kept v on v.row = a.row, range(1, 65) t(i) group by a.cluster, i)
    group by cluster) m on m.cluster = c.cluster)"""
ORACLE_SQL = f"""
with kept as materialized (
  select vec_id, row_number() over () as row, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (
  select row_number() over (order by h, q) - 1 as cluster, q from (select sha256('1:' || coalesce(vec_id::varchar, '')) as h, q from kept order by h, q limit 16)),
{", ".join(x.replace(" as (", " as materialized (", 1) for t in range(4) for x in ([_MOVE.format(t=t, s=t - 1)] if t else []) + [_ASSIGN.format(t=t)])}
select a.vec_id, a.cluster::int as cluster, a.d as distance, sum(a.d) over (partition by a.cluster)::bigint as cluster_inertia, sum(a.d) over ()::bigint as inertia,
       sha256(array_to_string(c.q, ',')) as centroid_sha256
from a3 a join c3 c on c.cluster = a.cluster
"""
