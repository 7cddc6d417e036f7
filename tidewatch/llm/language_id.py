"""Language identification by interpolated Kneser-Ney character models.

Per language, a 4-gram model over the letters of lower-cased words, each padded at its start and closed by an end mark.
Counts come from labelled documents: at most about ``SAMPLE`` per language (a documented bound), picked by a hash of their
id. Spark counts the n-grams and, for the lower orders, their distinct left neighbours; the model, bounded by the sample,
is laid out in sorted hash arrays: an array of keys per order with the log-probability of each n-gram under each language
(those it hasn't seen included), and one of contexts with the back-off weights.

A text goes to the language of the lowest cross-entropy per letter. The score is the softmax of the negative
cross-entropies, its sharpness fitted on sampled documents kept out of the counts; a text is rejected where its
cross-entropy lies midway from the highest of those documents to random letters, or beyond; short texts get more room. Words are scored once per chunk, then joined to their
documents by position, so whole texts are read.

Defined results: null texts and texts without a letter give ``und`` with score 0 and are rejected; ties go to the language
first in order; no labelled row at all makes every text ``und``. Label, source and id are never inputs of a prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import bounded_batches, only
from .text_blocks import U64, chunks, mix

ORDER = 4
#: Labelled documents per language that the models learn from, and that the calibration keeps.
SAMPLE, CALIBRATION = 2000, 400
FOLDS, HELD_OUT = 4, 2
#: How far from the calibration's highest cross-entropy to that of random letters the limit lies, and what short texts may
#: have besides: so much over the root of their letters.
BETWEEN, SHORT = 0.5, 8.0
PAD, END = 1, 2

_LETTER = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(1 << 16)])


@dataclass
class Model:
    languages: list[str]
    keys: list[np.ndarray]  # by order, sorted
    logp: list[np.ndarray]  # by order: n-grams x languages
    contexts: list[np.ndarray]  # by order, sorted
    weights: list[np.ndarray]
    floor: np.ndarray
    sharpness: float = 20.0
    limit: float = 1e9  # cross-entropy of a long text beyond which it is rejected


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts (other than letters: 0) and where each text begins."""
    low = [(t or "").lower() for t in texts]
    first = np.concatenate(([0], np.cumsum([len(t) for t in low]))).astype(np.int64)
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    far = codes > 0xFFFF
    out = np.where(far, 0, codes)
    out[~_LETTER[out]] = 0
    if far.any():  # beyond 16 bits: folded, letters only
        some = np.unique(codes[far])
        fold = np.array([(int(c) & 0xFFFF) | 0x8000 if unicodedata.category(chr(c))[0] == "L" else 0 for c in some], np.uint32)
        out[far] = fold[np.searchsorted(some, codes[far])]
    return out, first


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, starts, ends, and the text of each word."""
    codes, first = _letters(texts)
    inside = codes > 0
    cut = np.zeros(len(codes) + 1, bool)
    cut[first[:-1]] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    doc = np.searchsorted(first, starts, "right") - 1
    return codes, starts, ends, doc


def _distinct(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One word of each kind (its number), and for each word its kind."""
    up = np.full(len(codes) + 1, 0x9E3779B97F4A7C15, U64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    down = np.full(len(codes) + 1, pow(0x9E3779B97F4A7C15, -1, 2**64), U64)
    down[0] = 1
    down = np.multiply.accumulate(down)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(codes) * up[:-1], dtype=U64)))
    _, one, kind = np.unique((sums[ends] - sums[starts]) * down[starts], return_index=True, return_inverse=True)
    return one, kind


def _grams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four 16-bit codes in one word for each letter and end mark of the given words, and where each word begins."""
    lengths = ends - starts + 1
    begin = np.concatenate(([0], np.cumsum(lengths)))
    total = int(begin[-1])
    offset = np.arange(total) - np.repeat(begin[:-1], lengths)
    source = np.repeat(starts, lengths) + offset
    last = np.repeat(lengths, lengths) - 1
    grams = np.zeros(total, U64)
    for back in range(ORDER - 1, -1, -1):
        at = offset - back
        c = np.where(at < 0, PAD, codes[np.clip(source - back, 0, max(0, len(codes) - 1))]) if len(codes) else np.zeros(0, np.int64)
        if back == 0:
            c = np.where(offset == last, END, c)
        grams = (grams << U64(16)) | c.astype(U64)
    return grams, begin


def _counts(sample: DataFrame) -> DataFrame:
    """lang, gram (four packed codes), n of the sampled documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks(batch):
                texts = rows.column("text").to_pylist()
                here = rows.column("lang").to_pylist()
                for lang in sorted(set(here)):
                    codes, starts, ends, _ = _words([t for t, own in zip(texts, here, strict=True) if own == lang])
                    grams, _ = _grams(codes, starts, ends)
                    g, n = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return sample.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, sample: int = SAMPLE, calibration: int = CALIBRATION) -> Model | None:
    """Learn from the text and label of documents that aren't held out."""
    labelled = only(docs, "doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not totals:
        return None
    # By id and text, so that rows sharing an id don't come in together.
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, sample / n)]), F.col("lang"))
    drawn = labelled.withColumn("u", draw / share).where("u < 1.25").select("lang", "text", "u")
    # Few labelled documents are all learned from; else those beyond the sample calibrate.
    learn = _counts(drawn.where("u < 1")).cache()
    fours = learn
    tables = {ORDER: fours}
    for order in range(ORDER - 1, 0, -1):
        kept = F.col("gram").bitwiseAND((1 << (16 * order)) - 1)
        tables[order] = tables[order + 1].select("lang", kept.alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    frames = {k: t.toPandas() for k, t in tables.items()}
    learn.unpersist()
    if frames[ORDER].empty:  # labelled texts without a letter teach nothing
        return None
    model = _estimate(frames)
    kept = drawn.where("u >= 1").unionByName(drawn.where("u < 0.1")) if min(totals.values()) <= 1.25 * sample else drawn.where("u >= 1")
    return _calibrate(model, kept.orderBy("u", F.xxhash64("text"), "lang").select("lang", "text").limit(calibration * len(totals)))


def _estimate(frames: dict[int, pd.DataFrame]) -> Model:
    languages = sorted(frames[ORDER]["lang"].unique())
    index = {lang: i for i, lang in enumerate(languages)}
    keys, logp, contexts, weights = [], [], [], []
    letters = len(frames[1]["gram"].unique()) + 1
    below_keys, below = np.zeros(1, U64), np.full((1, len(languages)), 1.0 / letters)
    floor = np.log(below[0])
    for order in range(1, ORDER + 1):
        f = frames[order]
        grams, row = np.unique(f["gram"].to_numpy().astype(np.int64).view(U64), return_inverse=True)
        lang = f["lang"].map(index).to_numpy()
        n = np.zeros((len(grams), len(languages)))
        n[row, lang] = f["n"].to_numpy()
        ones, twos = (n == 1).sum(0), (n == 2).sum(0)
        discount = np.where(ones + twos > 0, ones / np.maximum(1, ones + 2 * twos), 0.5).clip(0.05, 0.95)
        ctx, at = np.unique(grams >> U64(16), return_inverse=True)
        total, kinds = np.zeros((len(ctx), len(languages))), np.zeros((len(ctx), len(languages)))
        np.add.at(total, at, n)
        np.add.at(kinds, at, n > 0)
        weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        suffix = grams & U64((1 << (16 * (order - 1))) - 1) if order > 1 else np.zeros(len(grams), U64)
        lower = below[np.searchsorted(below_keys, suffix)]
        p = np.maximum(n - discount, 0) / np.maximum(total[at], 1) + weight[at] * lower
        below_keys, below = grams, p
        hashed = mix(grams)
        order_ = np.argsort(hashed)
        keys.append(hashed[order_]), logp.append(np.log(p[order_]))
        hashed = mix(ctx)
        order_ = np.argsort(hashed)
        contexts.append(hashed[order_]), weights.append(np.log(weight[order_]))
    return Model(languages, keys, logp, contexts, weights, floor)


def _log_probability(model: Model, grams: np.ndarray) -> np.ndarray:
    """n-grams x languages: the longest known suffix's value and the back-off weights on the way to it."""
    out = np.zeros((len(grams), len(model.languages)))
    left = np.arange(len(grams))
    for order in range(ORDER, 0, -1):
        g = grams[left] & U64((1 << (16 * order)) - 1)
        h = mix(g)
        at = np.minimum(np.searchsorted(model.keys[order - 1], h), len(model.keys[order - 1]) - 1)
        hit = model.keys[order - 1][at] == h
        out[left[hit]] += model.logp[order - 1][at[hit]]
        left, g = left[~hit], g[~hit]
        if not len(left):
            return out
        h = mix(g >> U64(16))
        at = np.minimum(np.searchsorted(model.contexts[order - 1], h), len(model.contexts[order - 1]) - 1)
        seen = model.contexts[order - 1][at] == h
        out[left[seen]] += model.weights[order - 1][at[seen]]
    out[left] += model.floor
    return out


def entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Texts x languages: cross-entropy per letter (ends of words included), and how many there are."""
    n = len(texts)
    codes, starts, ends, doc = _words(texts)
    letters = np.bincount(doc, ends - starts + 1, n) if len(doc) else np.zeros(n)
    out = np.zeros((n, len(model.languages)))
    if len(doc):
        one, kind = _distinct(codes, starts, ends)
        grams, begin = _grams(codes, starts[one], ends[one])
        kinds, at = np.unique(grams, return_inverse=True)
        per_word = np.add.reduceat(_log_probability(model, kinds)[at], begin[:-1])
        for i in range(len(model.languages)):
            out[:, i] = -np.bincount(doc, per_word[kind, i], n) / np.maximum(letters, 1)
    return out, letters


def _calibrate(model: Model, rows: DataFrame) -> Model:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                h, letters = entropies(shared.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(h.tolist(), pa.list_(pa.float64())), pa.array(letters)], ["lang", "h", "letters"])

    found = [r for r in rows.mapInArrow(measured, "lang string, h array<double>, letters double").collect() if r["letters"] > 0]
    if not found:
        return model
    h = np.array([r["h"] for r in found])
    right = np.array([model.languages.index(r["lang"]) if r["lang"] in model.languages else -1 for r in found])
    known = right >= 0
    best = None
    for t in (2.0, 4.0, 8.0, 16.0, 32.0, 64.0):
        z = -t * (h[known] - h[known].min(1, keepdims=True))
        loss = -(z[np.arange(known.sum()), right[known]] - np.log(np.exp(z).sum(1))).mean() if known.any() else 0.0
        if best is None or loss < best[0]:
            best = (loss, t)
    low, letters = h.min(1), np.array([r["letters"] for r in found])
    high = float(low[letters >= np.median(letters)].max())
    model.sharpness = best[1]
    model.limit = high + BETWEEN * max(0.5, float(-model.floor.max()) - high)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` with lang_pred, score, cross_entropy and rejected; columns of these names give way."""
    docs = docs.select(*[docs[c] for c in docs.columns if c.lower() not in ("lang_pred", "score", "cross_entropy", "rejected")])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows in chunks(batch):
                texts = rows.column("text").to_pylist()
                if m is None:
                    h, letters, languages = np.zeros((len(texts), 1)), np.zeros(len(texts)), ["und"]
                else:
                    (h, letters), languages = entropies(m, texts), m.languages
                best = h.argmin(1)
                low = h[np.arange(len(texts)), best]
                score = 1 / np.exp(-(m.sharpness if m else 1.0) * (h - low[:, None])).sum(1)
                none = letters == 0
                over = low > (m.limit if m else 1e9) + SHORT / np.sqrt(np.maximum(letters, 1))
                names = ["und" if x else languages[i] for x, i in zip(none, best, strict=True)]
                new = [pa.array(names, pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(low), pa.array(none | over)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *new], [*rows.schema.names, "lang_pred", "score", "cross_entropy", "rejected"])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return docs.mapInArrow(judged, f"{plain}, lang_pred string, score double, cross_entropy double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the contract's prediction per document."""
    docs = bounded_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), fit(docs)).drop("text")
