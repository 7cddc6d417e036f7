"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` stores the postings of every token of the training texts: a row is a segment (some consecutive documents)
with its sorted terms and, for each, the positions at which it stands. ``search`` looks up each window of 13 words of the
benchmark in each segment: the list of its rarest term gives candidate starts, and the offset-adjusted lists of its other
terms are intersected with them, rarest first, so what is left are exact phrases. ``near`` returns proximity matches from
the same index. Segments need no shuffle, and no list of a term is ever held beyond one segment, however frequent it is.

Windows are made in Spark and go to the executors in blocks of about ``WINDOWS_PER_BLOCK``; a larger benchmark is searched
in more passes. A segment looks at the windows of which it holds the term that fewest windows of the block share.

Defined results: null and empty texts have no words, no hits and aren't contaminated; rows with equal ids are judged each
by itself; null item ids and items without words are left out; columns other than the named ones are ignored.
Terms are compared by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .marks import without
from .storage import bounded_batches, only, scratch, written
from .text_blocks import ALNUM, U64, chunks, pack, unpack, words

WINDOW = 13
WINDOWS_PER_BLOCK = 1 << 20
#: Contaminated: 20 * hit words >= words.
SHARE = 20
SEGMENT = "segment long, doc_ids binary, null_ids binary, first binary, terms binary, starts binary, places binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for rows in chunks(batch):
            c = words(rows, ALNUM)
            order = np.argsort(c.hashes, kind="stable")
            terms, starts = np.unique(c.hashes[order], return_index=True)
            ids = rows.column("doc_id")
            parts = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), c.first.astype(np.int64), terms, np.append(starts, len(order)).astype(np.int32), order.astype(np.int32)]
            names = [f.split()[0] for f in SEGMENT.split(", ")][1:]
            yield pa.RecordBatch.from_pydict({"segment": pa.array([part << 32 | number])} | {n: pa.array([pack(p)], pa.binary()) for n, p in zip(names, parts, strict=True)})
            number += 1


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text): a table of segments, written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_segments, SEGMENT), "positional-index")


def _item_windows(texts: list[str], size: int) -> list[list[np.ndarray]]:
    found = []
    for rows in chunks(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})):
        c = words(rows, ALNUM)
        for a, b in zip(c.first[:-1], c.first[1:], strict=True):
            h = c.hashes[a:b]
            found.append([h[i : i + size] for i in range(max(1, len(h) - size + 1))] if len(h) else [])
    return found


def window_table(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, lengths, terms): the windows of each item, in the shared folder."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks(batch):
                found = [(i, w) for i, w in zip(rows.column("item_id").to_pylist(), _item_windows(rows.column("text").to_pylist(), size), strict=True) if w]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.string()), *[pa.array([f(w) for _, w in found], pa.binary()) for f in (lambda w: np.array([len(x) for x in w], np.int32).tobytes(), lambda w: np.concatenate(w).tobytes())]], ["item_id", "lengths", "terms"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    return written(rows.mapInArrow(made, "item_id string, lengths binary, terms binary"), "windows")


def window_blocks(windows: DataFrame, per_block: int = WINDOWS_PER_BLOCK) -> Iterator[dict]:
    """Windows in blocks of about ``per_block``: items, sorted terms, the terms of each window and the windows of each probe term, in CSR form."""
    items, lengths, terms = [], [], []

    def block() -> dict:
        size, flat = np.concatenate(lengths), np.concatenate(terms)
        known, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        ends = np.cumsum(size)
        begins = ends - size
        # Of each window the term that fewest windows hold.
        owner = np.repeat(np.arange(len(size)), size)
        probe = at[np.lexsort((times[at], owner))[begins]]
        order = np.argsort(probe, kind="stable")
        return {"items": list(items), "terms": known, "at": at, "begins": begins, "ends": ends, "windows": order, "probes": np.searchsorted(probe[order], np.arange(len(known) + 1))}

    for row in windows.toLocalIterator():
        size, flat = np.frombuffer(row["lengths"], np.int32).astype(np.int64), np.frombuffer(row["terms"], U64)
        for start in range(0, len(size), per_block):
            stop = min(len(size), start + per_block)
            items += [row["item_id"]] * (stop - start)
            lengths.append(size[start:stop]), terms.append(flat[size[:start].sum() : size[:stop].sum()])
            if len(items) >= per_block:
                yield block()
                items.clear(), lengths.clear(), terms.clear()
    if items:
        yield block()


def _ragged(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - begins
    return np.arange(size.sum()) + np.repeat(begins - (np.cumsum(size) - size), size)


def _phrases(block: dict, terms: np.ndarray, starts: np.ndarray, places: np.ndarray, doc_of: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(window, length, starts of its occurrences) within one segment."""
    if not len(terms):
        return
    near = np.minimum(np.searchsorted(block["terms"], terms), len(block["terms"]) - 1)
    mine = np.flatnonzero(block["terms"][near] == terms)
    where = np.full(len(block["terms"]), -1)
    where[near[mine]] = mine
    probes = near[mine]
    possible = block["windows"][_ragged(block["probes"][probes], block["probes"][probes + 1])]
    if not len(possible):
        return
    begins, ends = block["begins"][possible], block["ends"][possible]
    whole = np.minimum.reduceat(where[block["at"][_ragged(begins, ends)]], np.cumsum(ends - begins) - (ends - begins)) >= 0
    for w in np.sort(possible[whole]):
        at = where[block["at"][block["begins"][w] : block["ends"][w]]]
        found: np.ndarray | None = None
        for k in np.argsort(starts[at + 1] - starts[at], kind="stable"):
            listed = places[starts[at[k]] : starts[at[k] + 1]]
            if found is None:
                found = listed.astype(np.int64) - k
                found = found[(found >= 0) & (found + len(at) <= len(doc_of))]
                found = found[doc_of[found] == doc_of[found + len(at) - 1]]
            else:
                i = np.minimum(np.searchsorted(listed, found + k), len(listed) - 1)
                found = found[listed[i] == found + k]
            if not len(found):
                break
        else:
            yield int(w), len(at), found


def search(index: DataFrame, block: dict) -> DataFrame:
    """Per document of the index: doc_id, n_words, hit_words, items (those with an occurring window) of one block of windows; and segment and place of the row."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                ids, none, first, terms, starts, places = (unpack(row[k], t) for k, t in (("doc_ids", np.int64), ("null_ids", bool), ("first", np.int64), ("terms", U64), ("starts", np.int32), ("places", np.int32)))
                doc_of = np.repeat(np.arange(len(ids)), np.diff(first))
                edges, items = np.zeros(len(doc_of) + 1, np.int64), [set() for _ in ids]
                for w, size, found in _phrases(windows, terms, starts, places, doc_of):
                    np.add.at(edges, found, 1)
                    np.add.at(edges, found + size, -1)
                    for d in np.unique(doc_of[found]):
                        items[d].add(windows["items"][w])
                hit = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
                marked = [[] for _ in ids]
                for p in hit:
                    marked[doc_of[p]].append(int(p - first[doc_of[p]]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=none), pa.array(np.diff(first)), pa.array(marked, pa.list_(pa.int32())), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array([row["segment"]] * len(ids), pa.int64()), pa.array(np.arange(len(ids)))],
                    ["doc_id", "n_words", "hit_words", "items", "segment", "place"],
                )

    return index.mapInArrow(hits, "doc_id long, n_words long, hit_words array<int>, items array<string>, segment long, place long")


def near(index: DataFrame, phrases: list[tuple[str, str]], slack: int = 10) -> DataFrame:
    """Proximity matches: (doc_id, item_id) where all terms of a phrase stand within its length plus ``slack`` words."""
    wanted = [(i, np.unique(w[0]), len(w[0])) for (i, _), w in zip(phrases, _item_windows([t for _, t in phrases], 1 << 30), strict=True) if w]
    shared = index.sparkSession.sparkContext.broadcast(wanted)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, none, first, terms, starts, places = (unpack(row[k], t) for k, t in (("doc_ids", np.int64), ("null_ids", bool), ("first", np.int64), ("terms", U64), ("starts", np.int32), ("places", np.int32)))
                doc_of = np.repeat(np.arange(len(ids)), np.diff(first))
                out = []
                for item, need, length in shared.value:
                    at = np.minimum(np.searchsorted(terms, need), max(0, len(terms) - 1))
                    if not len(terms) or (terms[at] != need).any():
                        continue
                    lists = sorted((places[starts[t] : starts[t + 1]].astype(np.int64) for t in at), key=len)
                    reach = length + slack
                    for p in lists[0]:  # each window that ends at or after the rarest term and spans it
                        for begin in range(max(int(first[doc_of[p]]), int(p) - reach + 1), int(p) + 1):
                            stop = min(begin + reach, int(first[doc_of[p] + 1]))
                            if all(np.searchsorted(x, stop) > np.searchsorted(x, begin) for x in lists):
                                out.append((int(doc_of[p]), item))
                                break
                out = sorted(set(out))
                yield pa.RecordBatch.from_arrays([pa.array([None if none[d] else int(ids[d]) for d, _ in out], pa.int64()), pa.array([i for _, i in out], pa.string())], ["doc_id", "item_id"])

    return index.mapInArrow(close, "doc_id long, item_id string")


#: A block without windows.
_NOTHING = {"items": [], "terms": np.array([0], U64), "at": np.zeros(0, np.int64), "begins": np.zeros(0, np.int64), "ends": np.zeros(0, np.int64), "windows": np.zeros(0, np.int64), "probes": np.zeros(2, np.int64)}


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, per_block: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, items, contaminated per row of ``docs``; see the module's text for odd cases."""
    index = build_index(only(docs, "doc_id", "text"))
    found = [search(index, b) for b in window_blocks(window_table(benchmark, window), per_block)] or [search(index, _NOTHING)]
    out = found[0]
    if len(found) > 1:  # segments are searched once per block of windows
        for more in found[1:]:
            out = out.unionByName(more)
        out = out.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hit_words"))).alias("hit_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    out = out.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.array_sort("items").alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones; rows are known by id and a hash of the text, so null and repeated ids take no others along."""
    with scratch(docs.sparkSession) as kept:
        key = F.xxhash64(docs["doc_id"], docs["text"])
        bad = decontaminate(docs.select(key.alias("doc_id"), docs["text"]), benchmark).where("contaminated").select(F.col("doc_id").alias("_bad")).distinct()
        bad = kept(bad, "contaminated")
    return without(docs, [key], bad)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the contract's digest per document."""
    docs, benchmark = bounded_batches(spark).read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: DuckDB SQL for the rows of ``query``.
ORACLE = f"""
with d as (select doc_id, row_number() over () id, {_WORDS} w from documents),
b as (select item_id, w, len(w) n from (select item_id, {_WORDS} w from benchmark where item_id is not null) where len(w) > 0),
windows as (select distinct item_id, array_to_string(w[i:i + least(n, {WINDOW}) - 1], ' ') k, least(n, {WINDOW}) s from (select *, unnest(range(1, greatest(n - {WINDOW - 1}, 1) + 1)) i from b)),
places as (select id, i, s, array_to_string(w[i:i + s - 1], ' ') k from (select id, w, s, unnest(range(1, len(w) - s + 2)) i from d join (select distinct s from windows) on len(w) >= s)),
hits as (select id, i, s, item_id from places join windows using (k, s)),
marked as (select id, count(distinct p) n_hit from (select id, unnest(range(i, i + s)) p from hits) group by 1),
items as (select id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) l from hits group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(l, '')) items_sha256, coalesce(n_hit > 0 and {SHARE} * n_hit >= len(w), false) contaminated
from d left join marked using (id) left join items using (id)"""
