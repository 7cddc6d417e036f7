"""Token counts with a whole-token shortcut.

Offline, ``whole_tokens`` proves which vocabulary strings the tokenizer encodes alone as one token, by encoding each. A text
is cut at white space (no pre-token spans it) and each word into pre-tokens; a pre-token in the proven set counts one
directly, and only the rest goes through the merges. Counts of words seen before come from a bounded memo of the task.
Words with characters outside ``PLAIN``, where regular-expression engines may class characters differently or normalising
may change them, and words that hold a special token's string, are counted by the library whole.

Defined results: null and empty texts have 0 bytes and 0 tokens; each row is counted by itself, equal ids or not.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import bounded_batches, only

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
MEMO_WORDS = 200_000
#: Words of these characters alone are split here: ASCII and Latin letters that NFC leaves as they are.
PLAIN = r"[!-~¡-¬®¯´-·¿-įĲ-ňŊ-ž]+"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+"
#: Characters that some engines take for white space and some not: a text with one is counted whole.
UNSURE = r"[\x1c-\x1f\x85᠎​﻿]"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_tokens(path: str) -> list[str]:
    """The pre-tokens that are vocabulary strings and that the library encodes alone as one token."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path) as f:
        suffix = json.load(f)["model"].get("end_of_word_suffix") or ""
    own = [s[: len(s) - len(suffix)] for s in tokenizer.get_vocab(with_added_tokens=False) if s.endswith(suffix)]
    own = [s for s in own if s.isascii() and s.isprintable() and s and " " not in s]
    return [s for s, e in zip(own, tokenizer.encode_batch(own, add_special_tokens=False), strict=True) if len(e.ids) == 1]


def _counter(path: str, whole: frozenset[str]):
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation(), tokenizer.no_padding()
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    plain, pieces, unsure = re.compile(PLAIN), re.compile(PIECES), re.compile(UNSURE)
    merged = lambda s: len(tokenizer.encode(s, add_special_tokens=False).ids)

    class Memo(dict):
        def __missing__(self, word: str) -> int:
            if not plain.fullmatch(word) or ("<|" in word and any(s in word for s in special)):
                n = merged(word)
            else:
                n = sum(1 if p in whole else merged(p) for p in pieces.findall(word.lower()))
            if len(self) < MEMO_WORDS:
                self[word] = n
            return n

    memo = Memo()

    def count(text: str) -> int:
        if unsure.search(text):
            return merged(text)
        return sum(map(memo.__getitem__, text.split()))

    return count


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens per row of ``docs`` (doc_id, text)."""
    path = path or vocabulary_path()
    whole = docs.sparkSession.sparkContext.broadcast(frozenset(whole_tokens(path)))  # bounded by the vocabulary

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path, whole.value)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array([count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = only(docs, "doc_id", "text").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(counts, f"doc_id {kind}, n_bytes long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the contract's counts per document."""
    return count_tokens(bounded_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
