"""Exact top-k by integer inner product with Fagin's threshold algorithm.

Candidates are dealt into blocks; a block holds, for each dimension, its rows sorted by that component (the sorted lists).
For a query the lists are read from the end its weight favours, some rows deeper each round; every new row is scored by
random access. With the components now reached, the weighted sum is the threshold: no unseen row of the block scores more.
When the k-th score so far is above it the block is done (a tie with the threshold goes on, since ties go to the smaller
id). Results of the blocks, k rows a query each, are merged by a window over the query.

Queries also come in blocks, smaller ones, and it is these that are copied to each block of candidates, whose lists are
sorted once. Each block of queries first meets one block of candidates alone: the k-th score found there is a bound with
which all others start, so most of them stop after few rows. Nothing unbounded is broadcast or collected.

Defined results: vectors that are null, or hold null or non-finite components, take no part; vectors of different lengths
are compared only with their like; a row isn't its own candidate, rows sharing its id included; null ids take no part.
Components and scores beyond 64 bits are taken as the largest or smallest number of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import only, written

K = 10
SCALE = 1024
QUERY_STEP = 100
BLOCK = 4096
DEPTH = 64
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and floor(scale * x) of each usable vector."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = only(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where(F.col("vec_id").isNotNull() & F.col("e").isNotNull())
    return rows.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("v"), F.size("e").alias("dims"))


def _blocks(rows: DataFrame, per_block: int, name: str, lists: bool = False) -> DataFrame:
    """(dims, block, ids, values, lists): rows dealt by a hash of their id into blocks of about ``per_block``.

    ``lists``: row numbers per dimension, ascending by component.
    """
    sizes = rows.groupBy("dims").count()
    rows = rows.join(sizes, "dims").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("count") / per_block).cast("long")))

    def packed(group: pa.Table) -> pa.Table:
        ids = group["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        values = group["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order].astype(np.int64)
        by = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T.astype(np.int32)).tobytes() if lists else None
        columns = [pa.array([group["dims"][0].as_py()], pa.int32()), pa.array([group["block"][0].as_py()], pa.int64()), *[pa.array([x], pa.binary()) for x in (ids[order].tobytes(), values.tobytes(), by)]]
        return pa.table(columns, names=["dims", name, f"{name}_ids", f"{name}_values", f"{name}_lists"])

    return rows.drop("count").groupBy("dims", "block").applyInArrow(packed, f"dims int, {name} long, {name}_ids binary, {name}_values binary, {name}_lists binary")


def scores(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of rows with a query, held to 64 bits."""
    if not len(values) or float(np.abs(values.astype(float)).max(initial=0)) * float(np.abs(query.astype(float)).max(initial=0)) * len(query) < 2.0**62:
        return values @ query
    return np.array([min(max(x, LEAST), MOST) for x in values.astype(object) @ query.astype(object)], np.int64)


def threshold_topk(ids: np.ndarray, values: np.ndarray, lists: np.ndarray, query_id: int, query: np.ndarray, k: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one block for one query, of those that score ``least`` or more."""
    n, dims = values.shape
    used = np.flatnonzero(query)
    seen = np.zeros(n, bool)
    seen[ids == query_id] = True
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, depth = 0, max(DEPTH, k)
    while at < n:
        stop = min(n, at + depth)
        top = np.concatenate([lists[d, n - stop : n - at] if query[d] > 0 else lists[d, at:stop] for d in used] or [np.arange(at, stop)])
        top = np.unique(top[~seen[top]])
        seen[top] = True
        best_ids, best = np.concatenate([best_ids, ids[top]]), np.concatenate([best, scores(values[top], query)])
        order = np.lexsort((best_ids, ~best))[:k]
        best_ids, best = best_ids[order], best[order]
        reached = np.array([lists[d, n - stop] if query[d] > 0 else lists[d, stop - 1] for d in used], np.int64)
        bound = int(scores(values[reached, used][None, :], query[used])[0]) if len(used) else 0
        if bound < least or len(best) == k and best[-1] > bound or seen.all():
            break
        at, depth = stop, depth * 2
    return best_ids[best >= least], best[best >= least]


def _met(row: dict, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of a block of queries against a block of candidates."""
    ids, query_ids = (np.frombuffer(row[x], np.int64) for x in ("c_ids", "q_ids"))
    values, queries = (np.frombuffer(row[x], np.int64).reshape(-1, row["dims"]) for x in ("c_values", "q_values"))
    lists = np.frombuffer(row["c_lists"], np.int32).reshape(row["dims"], -1)
    least = np.frombuffer(row["least"], np.int64) if row.get("least") else np.full(len(query_ids), LEAST)
    for q, v, x in zip(query_ids.tolist(), queries, least.tolist(), strict=True):
        yield q, *threshold_topk(ids, values, lists, q, v, k, x)


def top_k(vectors: DataFrame, k: int = K, query_step: int = QUERY_STEP, scale: int = SCALE, per_block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row whose id ``query_step`` divides."""
    spark = vectors.sparkSession
    rows = written(quantised(vectors, scale), "quantised")
    candidates = written(_blocks(rows, per_block, "c", True), "candidates")
    queries = _blocks(rows.where(F.col("vec_id") % query_step == 0), max(1, per_block // 16), "q").drop("q_lists")
    numbers = candidates.groupBy("dims").agg((F.max("c") + 1).alias("n_c"))  # a number per length of vectors
    queries = queries.join(numbers, "dims")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                least = None
                if row["c_ids"]:
                    least = np.array([s[-1] if len(s) == k else LEAST for _, _, s in _met(row, k)], np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([row["dims"]], pa.int32()), pa.array([row["n_c"]], pa.int64()), *[pa.array([x], pa.binary()) for x in (row["q_ids"], row["q_values"], least)]], ["dims", "n_c", "q_ids", "q_values", "least"])

    first = queries.withColumn("c", F.pmod("q", "n_c")).join(candidates, ["dims", "c"], "left").select("dims", "n_c", "q_ids", "q_values", "c_ids", "c_values", "c_lists")
    queries = written(first.mapInArrow(bounded, "dims int, n_c long, q_ids binary, q_values binary, least binary"), "queries")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = list(_met(row, k))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in out], [len(i) for _, i, _ in out]).astype(np.int64)), *[pa.array(np.concatenate([x[i] for x in out])) for i in (1, 2)]], ["query_id", "vec_id", "score"])

    # As many tasks as blocks, as far as the session's shuffles go: adaptive execution would put small tables in one.
    tasks = max(1, min(candidates.count(), 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    spread = queries.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_c") - 1)).alias("c")).drop("n_c")
    merged = candidates.repartition(tasks, "dims", "c").join(spread.repartition(tasks, "dims", "c"), ["dims", "c"]).mapInArrow(best, "query_id long, vec_id long, score long")
    ranked = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the contract's ten best per query."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
with e as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint score
      from e q join e c on q.vec_id % {QUERY_STEP} = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from r where rank <= {K}"""
