"""BPE encoding and decoding through a distinct-word table.

``word_table`` splits the texts of all documents into words and counts them with map-side pre-aggregation. The most
frequent ``BROADCAST_WORDS`` distinct words (a fixed bound) are encoded once, in Spark, and joined by broadcast:
``encode`` splits the texts again and joins the ids back by position. The tail, rare words that shuffling with their
positions would cost more than encoding, is encoded where it stands, once per task as far as memory is bounded. ``decode`` joins the
ids to a table of id and piece, bounded by the vocabulary, and glues the pieces by position.

Texts with characters that regular-expression engines may class differently, or that hold a special token's string, go
through the library whole, which handles them by its own rules.

Defined results: null text is taken as empty; an empty text has no ids and decodes to an empty text; each row is encoded
by itself, equal ids or not.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import bounded_batches, only, written
from .text_blocks import chunks

VOCABULARY = "byte_bpe_50k.json"
BROADCAST_WORDS = 1 << 17
#: Distinct words that a task holds at once, of its counts and of the tail.
TASK_WORDS = 1 << 17
#: Characters on which all engines agree; other texts are encoded whole by the library.
AGREED = r"[\t-\r -~¡-±´-¸º»¿-ž‐-‧€]*"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _splitter():
    """Words: a run of other than white space with the space before it, or white space, as the pre-tokenizer groups it.

    A word is one pre-token or more; none crosses its ends, so its ids are the same alone as in the text.
    """
    import re

    return re.compile(r" ?[^\s]+|\s+(?!\S)|\s+").findall


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    return t


def special_strings(path: str) -> list[str]:
    return [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]


def _agreed(special: list[str]):
    import re

    plain = re.compile(AGREED)
    return lambda text: plain.fullmatch(text) is not None and not ("<|" in text and any(s in text for s in special))


def word_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Each distinct word of all texts with its count; written to the shared folder."""
    special = special_strings(path or vocabulary_path())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, agreed, seen = _splitter(), _agreed(special), Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column("text"):
                if (text := text.as_py()) and agreed(text):
                    seen.update(split(text))
                    if len(seen) > TASK_WORDS:
                        yield out()
        yield out()

    words = only(docs, "text").mapInArrow(counted, "word string, n long")
    return written(words.groupBy("word").agg(F.sum("n").alias("n")), "word-table")


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(word, ids) of a table of distinct words: each is encoded once."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            ids = [",".join(map(str, e.ids)) for e in tokenizer.encode_batch(batch.column("word").to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.string())], ["word", "ids"])

    return words.select("word").mapInArrow(encoded, "word string, ids string")


def frequent(table: DataFrame, bound: int = BROADCAST_WORDS) -> DataFrame:
    """At most ``bound`` words of the highest counts, by a histogram of the counts."""
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(16 * F.log2(F.col("n") / 1024))).cast("long")
    held, least = 0, None
    for row in sorted(table.groupBy(level.alias("level")).count().collect(), reverse=True):
        if held + row["count"] > bound:
            break
        held, least = held + row["count"], row["level"]
    return table.where(level >= least if least is not None else F.lit(False)).select("word")


def _encoder(docs: DataFrame, path: str, bound: int):
    """Batches of (doc_id, text) to batches of (doc_id, ids, n_tokens)."""
    special = special_strings(path)
    top = encoded_words(frequent(word_table(docs, path), bound), path).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, top.schema) as writer:
        writer.write_table(top)
    shared = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, agreed, tokenizer = _splitter(), _agreed(special), _tokenizer(path)
        table = pa.ipc.open_stream(shared.value).read_all()
        known = dict(zip(table["word"].to_pylist(), table["ids"].to_pylist(), strict=True))
        del table
        most = len(known) + TASK_WORDS
        tail: list[str] = []
        for batch in batches:
            for rows in chunks(batch):
                texts = [t.as_py() or "" for t in rows.column("text")]
                words = [split(t) if agreed(t) else None for t in texts]
                if missing := list(set().union(*[w for w in words if w]) - known.keys()):
                    if len(known) + len(missing) > most:  # the tail so far goes; the table stays
                        for w in tail:
                            del known[w]
                        tail.clear()
                        missing = list(set().union(*[w for w in words if w]) - known.keys())
                    known.update(zip(missing, [",".join(map(str, e.ids)) for e in tokenizer.encode_batch(missing, add_special_tokens=False)], strict=True))
                    tail += missing
                ids = [",".join(map(known.__getitem__, w)) if w is not None else ",".join(map(str, tokenizer.encode(t, add_special_tokens=False).ids)) for w, t in zip(words, texts, strict=True)]
                sizes = [s.count(",") + 1 if s else 0 for s in ids]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "ids", "n_tokens"])

    return joined


def encode(docs: DataFrame, path: str | None = None, bound: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id and ids, decimal and joined by commas, with their number, per row of ``docs`` (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]
    return only(docs, "doc_id", "text").mapInArrow(_encoder(docs, path or vocabulary_path(), bound), f"doc_id {kind}, ids string, n_tokens long")


def pieces(path: str | None = None) -> list[bytes]:
    """The bytes of each id; the byte alphabet is the tokenizer's own decoder's, read off one character at a time."""
    tokenizer = _tokenizer(path or vocabulary_path())
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = dict(zip(map(chr, printable), printable, strict=True))
    alphabet |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    added = tokenizer.get_added_tokens_decoder()
    strings = {i: s for s, i in tokenizer.get_vocab().items()}
    return [added[i].content.encode() if i in added else bytes(alphabet[c] for c in strings[i]) for i in range(len(strings))]


def _decoder(spark, path: str):
    """Batches with ids to the same with the decoded text."""
    shared = spark.sparkContext.broadcast(pieces(path))  # bounded by the vocabulary

    def glued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = {str(i): p for i, p in enumerate(shared.value)}.__getitem__
        for batch in batches:
            for rows in chunks(batch, "ids"):
                texts = [b"".join(map(piece, s.split(","))).decode("utf-8", "replace") if s else "" for s in rows.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], [*rows.schema.names, "decoded"])

    return glued


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (with ids as ``encode`` gives them) with the decoded text; bytes that aren't UTF-8 are replaced."""
    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(_decoder(encoded.sparkSession, path or vocabulary_path()), f"{schema}, decoded string")


def round_trip(docs: DataFrame, path: str | None = None, bound: int = BROADCAST_WORDS) -> DataFrame:
    """``decode(encode(docs))`` in one worker a task instead of two."""
    path = path or vocabulary_path()
    encoder, decoder, kind = _encoder(docs, path, bound), _decoder(docs.sparkSession, path), dict(docs.dtypes)["doc_id"]
    return only(docs, "doc_id", "text").mapInArrow(lambda batches: decoder(encoder(batches)), f"doc_id {kind}, ids string, n_tokens long, decoded string")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's digest columns per document."""
    return round_trip(docs).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: encode and decode every document."""
    return digest(bounded_batches(spark).read.parquet(f"{sf_dir}/documents.parquet"))
