"""Scores of texts under a bigram model by deleted interpolation.

The model mixes maximum-likelihood estimates of bigrams, of words, and a uniform share. The mixture weights belong to
buckets of the context's frequency (powers of two) and are learned by expectation-maximisation on held-out counts: each
training token in turn is deleted from the counts that predict it, so a context that came s times is judged in the bucket
of s - 1. All training documents are counted, and every word is predicted as itself:

1. documents become blocks of about ``BLOCK_WORDS`` tokens: the block's distinct words and the sequence of their numbers;
2. a block asks for the counts of its distinct words, then of its distinct bigrams: sorted 64-bit keys with its own training
   counts, compressed, dealt by key range. A range adds up what its blocks bring and answers each with the totals. A key is
   one entry of a block however often it stands there, so no key is hot;
3. blocks with their answers hold all that the statistics of EM and the scores of their documents ask for.

EM runs on the driver over cells of like estimates (``CELLS`` per power of two), a bounded number, each with the means of its
bigrams' estimates: an approximation of the sum over single tokens.

Defined results: null text is empty; an empty text is scored on its end alone; without training documents all scores come
from the uniform share; rows with equal ids are scored each by itself; null ids are training documents. Words are compared
by 64-bit hashes, bigrams by hashes of at least 2 log2(tokens) + 4 bits, 64 at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .runs import expand, merge, squeeze
from .storage import bounded_batches, only, scratch, written
from .text_blocks import BLANKS, U64, chunks, mix, words

FOLDS, HELD_OUT = 7, 2
BLOCK_WORDS = 1 << 20
#: Tokens of all documents per key range of bigrams, about.
RANGE_TOKENS = 1_500_000
CELLS = 4  # cells per power of two
END, BEGIN = (int(mix(np.array([x], U64))[0]) for x in (0xE0D, 0xBE6))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass
class Totals:
    tokens: int  # of training documents
    distinct: int
    documents: int
    bits: int  # of bigram keys


@dataclass
class Block:
    """A block of documents: its distinct words, the place of each token's word in them, and the document of each token."""

    hashes: np.ndarray
    word: np.ndarray
    doc: np.ndarray
    late: np.ndarray  # per document
    context: np.ndarray  # as word; ``len(hashes)`` at the begin of a document

    @property
    def training(self) -> np.ndarray:
        return ~self.late[self.doc]

    def bigrams(self, bits: int) -> tuple[np.ndarray, ...]:
        """Sorted keys of the distinct bigrams, and of each context, word and training count; and of each token its bigram."""
        n = len(self.hashes)
        pair, at = np.unique(self.context.astype(np.int64) * n + self.word, return_inverse=True)
        context, word = pair // max(1, n), pair % max(1, n)
        keys = mix(np.append(self.hashes, U64(BEGIN))[context] * U64(0x9E3779B97F4A7C15) ^ self.hashes[word]) >> U64(64 - bits)
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[at]
        return keys[order], context[order], word[order], np.bincount(at[self.training], minlength=len(pair)), at


def _opened(row: dict) -> Block:
    hashes, late, size = np.frombuffer(row["hashes"], U64), np.frombuffer(row["late"], bool), np.frombuffer(row["sizes"], np.int64)
    word = expand(row["sequence"], np.uint32).astype(np.int64)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.cumsum(size) - size] = len(hashes)
    return Block(hashes, word, np.repeat(np.arange(len(size)), size), late, context)


_HOME = "block long, tokens long, ids binary, nulls binary, late binary, sizes binary, hashes binary, sequence binary"


def _blocks(docs: DataFrame) -> DataFrame:
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            hashes, word = np.unique(np.concatenate([h for h, *_ in held]), return_inverse=True)
            sizes, ids, nulls, late = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3, 4))
            row = [part << 32 | count, len(word), ids.tobytes(), nulls.tobytes(), late.tobytes(), sizes.tobytes(), hashes.tobytes(), squeeze(word.astype(np.uint32))]
            held.clear()
            return pa.RecordBatch.from_pylist([dict(zip([x.split()[0] for x in _HOME.split(", ")], row, strict=True))])

        for rows in (r for b in batches for r in chunks(b)):
            c = words(rows, BLANKS)
            token = np.full(len(c.hashes) + len(c.counts), END, U64)
            token[np.arange(len(c.hashes)) + c.doc] = c.hashes
            ids = rows.column("doc_id")
            held.append((token, c.counts.astype(np.int64) + 1, ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False).astype(bool), rows.column("held_out").to_numpy(zero_copy_only=False).astype(bool)))
            size += len(token)
            if size > BLOCK_WORDS:
                yield out()
                count, size = count + 1, 0
        if held:
            yield out()

    return written(docs.select("doc_id", "held_out", "text").mapInArrow(dealt, _HOME), "blocks")


def _counted(blocks: DataFrame, of, bits: int, ranges: int, name: str) -> tuple[DataFrame, int, int]:
    """The training counts that blocks ask for: (block, answer: array<struct<range, n>>), in the order of the keys that
    ``of`` gives for a block with its own counts; and the sum of all counts and the number of keys with any."""
    shift = bits - (ranges - 1).bit_length()

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            keys, n = of(_opened(row))
            cuts = np.append(np.searchsorted(keys, np.arange(ranges, dtype=U64) << U64(shift)), len(keys))
            parts = [(i, squeeze(np.diff(keys[a:b], prepend=U64(i << shift))), squeeze(n[a:b].astype(np.uint32))) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(parts), pa.int64()), *[pa.array([p[i] for p in parts], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]], ["block", "range", "keys", "n"])

    def added(group: pa.Table) -> pa.Table:
        start = U64(group["range"][0].as_py() << shift)
        keys = [np.cumsum(expand(x, U64), dtype=U64) + start for x in group["keys"].to_pylist()]
        known, total = merge(keys, [expand(x, np.uint32).astype(np.int64) for x in group["n"].to_pylist()])
        answers = [squeeze(total[np.searchsorted(known, k)].astype(np.uint64)) for k in keys]
        sums = [[int(total.sum())] + [0] * (len(keys) - 1), [int((total > 0).sum())] + [0] * (len(keys) - 1)]
        return pa.table({"block": group["block"], "range": group["range"], "n": pa.array(answers, pa.binary()), "tokens": pa.array(sums[0], pa.int64()), "distinct": pa.array(sums[1], pa.int64())})

    asks = blocks.mapInArrow(asked, "block long, range int, keys binary, n binary")
    found = written(asks.groupBy("range").applyInArrow(added, "block long, range int, n binary, tokens long, distinct long"), f"{name}-counts")
    sums = found.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    return found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "n"))).alias(name)), sums["tokens"] or 0, sums["distinct"] or 0


def _answer(parts: list[dict]) -> np.ndarray:
    return np.concatenate([expand(p["n"], np.uint64) for p in parts] or [np.zeros(0, U64)]).astype(np.float64)


def resolved(docs: DataFrame) -> tuple[DataFrame, Totals]:
    """The blocks of ``docs`` (doc_id, held_out, text), each with the counts of its words and bigrams, and the totals."""
    with scratch(docs.sparkSession) as kept:
        blocks = _blocks(docs)
        tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
        bits = min(64, max(40, 2 * tokens.bit_length() + 4))
        ranges = 1 << max(6, (tokens // RANGE_TOKENS).bit_length())
        words_, total, distinct = _counted(blocks, lambda b: (b.hashes, np.bincount(b.word[b.training], minlength=len(b.hashes))), 64, max(64, ranges // 4), "words")
        pairs, _, _ = _counted(blocks, lambda b: (lambda x: (x[0], x[3]))(b.bigrams(bits)), bits, ranges, "bigrams")
        documents = docs.where("not held_out").count()
        return kept(blocks.join(words_, "block").join(pairs, "block"), "resolved"), Totals(total, distinct, documents, bits)


def _bucket(seen: np.ndarray) -> np.ndarray:
    """0 for a context that never came, then one a power of two."""
    return np.where(seen > 0, 1 + np.floor(np.log2(np.maximum(seen, 1))), 0).astype(np.int64)


def _cells(t: Totals, times: np.ndarray, n: np.ndarray, seen: np.ndarray, of_word: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bigrams, each so many ``times``, gathered into cells of like estimates with one count deleted: cell, and sums of times and of both estimates."""
    one = np.maximum((of_word - 1) / max(1, t.tokens - 1), 1e-12)
    two = np.where(seen > 1, (n - 1) / np.maximum(seen - 1, 1), one)
    flat = t.distinct + 1.0
    i = np.where(two > 0, 1 + np.floor(CELLS * (np.log2(np.maximum(two * flat, 2.0**-40)) + 40)), 0).astype(np.int64)
    j = np.floor(CELLS * (np.log2(one * flat) + 40)).astype(np.int64)
    cell, at = np.unique((_bucket(seen - 1) << 40) | (i << 20) | j, return_inverse=True)
    return cell, *[np.bincount(at, x * times, len(cell)) for x in (1.0, two, one)]


def mixture(blocks: DataFrame, t: Totals) -> np.ndarray:
    """Weights (bigram, word, uniform) per bucket of context frequency, from ``resolved``."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            block, of_word, n = _opened(row), _answer(row["words"]), _answer(row["bigrams"])
            _, context, word, times, _ = block.bigrams(t.bits)
            own = times > 0
            found = _cells(t, times[own], n[own], np.append(of_word, t.documents)[context[own]], of_word[word[own]])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["key", "n", "two", "one"])

    stats = blocks.mapInArrow(cells, "key long, n double, two double, one double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "two", "one")]).toPandas()
    return expectation_maximisation(stats["key"].to_numpy().astype(np.int64) >> 40, stats["n"].to_numpy(), stats["two"].to_numpy(), stats["one"].to_numpy(), 1.0 / (t.distinct + 1))


def expectation_maximisation(bucket: np.ndarray, n: np.ndarray, two: np.ndarray, one: np.ndarray, uniform: float, rounds: int = 100) -> np.ndarray:
    """66 x 3 weights; cells carry their summed estimates, so their means are what is mixed. Buckets without counts take all's."""
    out = np.zeros((66, 3))

    def learned(rows: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        p = np.stack([two[rows] / n[rows], one[rows] / n[rows], np.full(rows.sum(), uniform)], 1)
        for _ in range(rounds):
            share = p * w
            share *= (n[rows] / share.sum(1))[:, None]
            new = share.sum(0) / n[rows].sum()
            done = np.abs(new - w).max() < 1e-9
            w = new
            if done:
                break
        w = np.maximum(w, 1e-6)
        return w / w.sum()

    all_ = learned(np.ones(len(n), bool)) if len(n) else np.array([0.0, 0.0, 1.0])
    for b in range(len(out)):
        rows = bucket == b
        out[b] = learned(rows) if rows.any() else all_
    return out


def probabilities(t: Totals, weights: np.ndarray, n: np.ndarray, seen: np.ndarray, of_word: np.ndarray) -> np.ndarray:
    """Of bigrams, from their counts and those of their context and word."""
    w = weights[_bucket(seen)]
    one = of_word / max(1, t.tokens)
    top = np.where(seen > 0, n / np.maximum(seen, 1), one)  # a context that never came has no estimate of its own
    return w[:, 0] * top + w[:, 1] * one + w[:, 2] / (t.distinct + 1)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs`` (doc_id, text)."""
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    blocks, t = resolved(docs)
    weights = mixture(blocks, t)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            block, of_word, n = _opened(row), _answer(row["words"]), _answer(row["bigrams"])
            _, context, word, _, at = block.bigrams(t.bits)
            logp = np.log10(probabilities(t, weights, n, np.append(of_word, t.documents)[context], of_word[word]))
            base = np.log10((of_word + 1) / (t.tokens + t.distinct + 1))
            m = len(block.late)
            size = np.frombuffer(row["sizes"], np.int64)
            known = np.bincount(block.doc[of_word[block.word] > 0], minlength=m)
            sums = [np.bincount(block.doc, x, m) for x in (base[block.word], logp[at])]
            columns = [pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["nulls"], bool)), pa.array(block.late), pa.array(size), pa.array(known.astype(np.int64)), pa.array(np.full(m, t.tokens, np.int64)), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCORES.split(", ")])

    return blocks.mapInArrow(scored, _SCORES)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the contract's scores per document."""
    return score(bounded_batches(spark).read.parquet(f"{sf_dir}/documents.parquet"))
