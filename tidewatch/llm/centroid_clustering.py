"""Exact integer k-means (Lloyd's rounds) with block-norm screening.

A vector is cut into segments, and the norms of its segments, kept as 32-bit floats, are its compressed form. By the
Cauchy-Schwarz inequality, per segment, the squared distance of a vector to a centroid is at least the squared distance of
their compressed forms. So in each round a vector first meets the centroid of the smallest bound; of the others only those
whose bound isn't above the distance found receive exact integer distances. Bounds are lowered by more than rounding can
have raised them, so what is pruned is never the nearest, nor tied with it.

A round is one pass over the table of integer vectors. A task adds up its own vectors per cluster and hands on one row per
cluster and dimension, which Spark sums; what reaches the driver are the sums of k x dims numbers, whatever the input.
Nothing is shuffled but these rows, so one huge group of equal vectors weighs no more than any other rows.

Defined results: vectors that are null, of another length than ``dims``, or hold null or non-finite components are not
kept and have no row; components and distances beyond 64 bits are held to the largest or smallest number of 64 bits (sums
are exact all the same). Rows that repeat an id are vectors of their own; the first centroids are taken in the order of
hash, then id, then components; null ids have no hash and come last. Fewer kept vectors than ``k`` give as many centroids;
none give no rows. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import only, scratch, written
from .topk_search import MOST

K, DIMS, ROUNDS, SEED, SCALE = 8, 64, 10, "3", 1024
#: Segments of a compressed vector.
SEGMENTS = 8
#: Components of at most this size have squared distances of at most 62 bits.
SMALL = 1 << 27
#: Vectors that are compared at a time.
SLICE = 4096


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component, of the vectors that are kept."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = only(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where(F.size("e") == dims)
    return rows.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def segment_norms(values: np.ndarray, segments: int) -> np.ndarray:
    """Compressed forms: the norm of each of ``segments`` runs of components."""
    squares = values.astype(np.float64) ** 2
    return np.sqrt(np.add.reduceat(squares, np.arange(segments) * values.shape[1] // segments, axis=1)).astype(np.float32)


def compressed(rows: DataFrame, dims: int, segments: int) -> DataFrame:
    """``rows`` with their compressed forms, as the arrays that rounds read."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("v").flatten().to_numpy().reshape(-1, dims)
            if len(values):
                norms = segment_norms(values, segments)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * segments, pa.array(norms.ravel()))], ["vec_id", "v", "norms"])

    return rows.mapInArrow(pack, "vec_id long, v array<long>, norms array<float>")


def squared(values: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances, as whole numbers of any size where 64 bits might not do."""
    if max(np.abs(values.astype(np.float64)).max(initial=0), np.abs(centroid.astype(np.float64)).max(initial=0)) > SMALL:
        values, centroid = values.astype(object), centroid.astype(object)
    gap = values - centroid
    return (gap * gap).sum(axis=1)


def nearest(values: np.ndarray, norms: np.ndarray, centroids: np.ndarray, centroid_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance) of each row, and how many exact distances that took."""
    n, numbers = len(values), np.arange(len(values))
    a, b = norms.astype(np.float64), centroid_norms.astype(np.float64)
    own, theirs = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
    bound = own + theirs - 2 * a @ b.T - 1e-6 * (own + theirs) - 1  # below the true bound, whatever was rounded
    best = bound.argmin(axis=1)
    distance, took = np.zeros(n, object if max(np.abs(x.astype(np.float64)).max(initial=0) for x in (values, centroids)) > SMALL else np.int64), n
    for c in range(len(centroids)):
        at = np.flatnonzero(best == c)
        distance[at] = squared(values[at], centroids[c])
    first = best.copy()
    for c in range(len(centroids)):
        at = numbers[(first != c) & (bound[:, c] <= distance.astype(np.float64))]
        took += len(at)
        d = squared(values[at], centroids[c])
        won = (d < distance[at]) | (d == distance[at]) & (c < best[at])
        best[at[won]], distance[at[won]] = c, d[won]
    return best.astype(np.int32), distance, took


def _slices(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, segments: int) -> Iterator[tuple]:
    """(ids, values, clusters, distances, exact distances taken) of some rows at a time."""
    centroid_norms = segment_norms(centroids, segments)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            some = batch.slice(at, SLICE)
            values = some.column("v").flatten().to_numpy().reshape(-1, centroids.shape[1])
            yield some.column("vec_id"), values, *nearest(values, some.column("norms").flatten().to_numpy().reshape(-1, segments), centroids, centroid_norms)


def moved(rows: DataFrame, centroids: np.ndarray, segments: int) -> np.ndarray:
    """The centroids after a round: floor of the mean of each one's vectors; one without vectors stays."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Halves of 32 bits are summed apart, so that no sum of a task leaves 64 bits.
        n, high, low = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64)
        for _, values, clusters, _, _ in _slices(batches, centroids, segments):
            for c in np.unique(clusters):
                some = values[clusters == c]
                n[c] += len(some)
                high[c] += (some >> 32).sum(axis=0)
                low[c] += (some & 0xFFFFFFFF).sum(axis=0)
        c, d = (x.ravel() for x in np.indices((k, dims)))
        there = n[c] > 0
        yield pa.RecordBatch.from_pydict({"c": c[there].astype(np.int32), "d": d[there].astype(np.int32), "n": n[c][there], "high": high.ravel()[there], "low": low.ravel()[there]})

    parts = rows.select("vec_id", "v", "norms").mapInArrow(sums, "c int, d int, n long, high long, low long")
    total = parts.groupBy("c", "d").agg(*[F.sum(F.col(x).cast("decimal(20,0)")).alias(x) for x in ("n", "high", "low")])
    out = centroids.copy()
    for r in total.collect():  # k x dims rows
        out[r.c, r.d] = ((int(r.high) << 32) + int(r.low)) // int(r.n)
    return out


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors whose ids, with the seed before, have the smallest hashes."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(h.alias("h"), "vec_id", "v").orderBy(F.asc_nulls_last("h"), "vec_id", "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


def fit(vectors: DataFrame, k: int = K, dims: int = DIMS, rounds: int = ROUNDS, seed: str = SEED, scale: int = SCALE, segments: int = SEGMENTS) -> tuple[DataFrame, np.ndarray]:
    """(the kept vectors in the form that ``assign`` takes, the final centroids)."""
    rows = written(compressed(integers(vectors, dims, scale), dims, segments), "vectors")
    centroids = first_centroids(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(rows, centroids, segments)
    return rows, centroids


def assign(rows: DataFrame, centroids: np.ndarray, segments: int = SEGMENTS) -> DataFrame:
    """vec_id, cluster, distance, and exact_distances, the number of exact distances spent on the row's slice (on its first row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, clusters, distances, took in _slices(batches, centroids, segments):
            spent = np.zeros(len(clusters), np.int64)
            spent[:1] = took
            held = pa.array([min(int(x), MOST) for x in distances] if distances.dtype == object else distances, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(clusters), held, pa.array(spent)], ["vec_id", "cluster", "distance", "exact_distances"])

    return rows.select("vec_id", "v", "norms").mapInArrow(run, "vec_id long, cluster int, distance long, exact_distances long")


def clustered(vectors: DataFrame, **parameters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept vector."""
    spark = vectors.sparkSession
    segments = parameters.get("segments", SEGMENTS)
    with scratch(spark) as keep:
        rows, centroids = fit(vectors, **parameters)
        if not len(centroids):
            return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
        found = keep(assign(rows, centroids, segments).drop("exact_distances"), "clusters")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"))
    held = lambda x: F.least(x, F.lit(MOST)).cast("long")
    sums = sums.select("cluster", held(F.col("s")).alias("cluster_inertia"), held(F.sum("s").over(Window.partitionBy(F.lit(0)))).alias("inertia"))  # k rows at most
    names = spark.createDataFrame([(c, ",".join(map(str, v))) for c, v in enumerate(centroids.tolist())], "cluster int, components string")
    known = sums.join(F.broadcast(names), "cluster").withColumn("centroid_sha256", F.sha2("components", 256)).drop("components")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the contract's clusters of ``embeddings``."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def oracle(k: int = K, dims: int = DIMS, rounds: int = ROUNDS, seed: str = SEED, scale: int = SCALE) -> str:
    """SQL with a pair of tables a round: every vector against every centroid."""
    parts = [f"""e as materialized (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) v from embeddings
      where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
      f"c0 as materialized (select (row_number() over (order by h) - 1)::int c, v from (select sha256('{seed}:' || vec_id) h, v from e order by h limit {k}))"]
    for r in range(rounds + 1):
        parts.append(f"""a{r} as materialized (select vec_id, v, c, d from (select e.vec_id, e.v, x.c, list_sum(list_transform(list_zip(e.v, x.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint d,
          from e, c{r} x) qualify row_number() over (partition by vec_id order by d, c) = 1)""")
        if r < rounds:
            parts.append(f"""c{r + 1} as materialized (select o.c, coalesce(m.v, o.v) v from c{r} o left join (select c, list((s - ((s % n) + n) % n) // n order by i) v
              from (select c, i, sum(x)::bigint s, count(*) n from (select c, unnest(v) x, generate_subscripts(v, 1) i from a{r}) group by all) group by c) m on o.c = m.c)""")
    return f"""with {", ".join(parts)} select vec_id, a.c as cluster, d as distance, sum(d) over (partition by a.c)::bigint cluster_inertia, sum(d) over ()::bigint inertia,
      sha256(array_to_string(x.v, ',')) centroid_sha256 from a{rounds} a join c{rounds} x on a.c = x.c"""
