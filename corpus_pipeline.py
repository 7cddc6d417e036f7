"""A corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

1. language ID: documents that it rejects (no letters, or unlike any language learned) go;
2. n-gram Jaccard join: of each group of near duplicates the document of the smallest id stays;
3. benchmark decontamination: contaminated documents go;
4. secret scans: secrets are replaced by the name of their kind, documents stay;
5. BPE encoding and decoding: the digest of each document's ids and of the text they decode to.

Rows with a null id or text: null text is rejected by the first stage; null ids pass and are never taken for copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.llm import bpe_codec, decontamination, language_id, ngram_join, secret_scans
from tidewatch.llm.storage import bounded_batches, deleted, saved, scratch


def identify(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    # The row travels in one column, so that none of its names meets one of the prediction's.
    rows = docs.select(docs["text"], F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return language_id.predict(rows, language_id.fit(docs)).where("not rejected").select("row.*")


def deduplicate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secret_scans.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else out


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.digest(docs)


STAGES = [("language ID", identify), ("n-gram Jaccard join", deduplicate), ("benchmark decontamination", decontaminate), ("secret scans", redact), ("BPE encoding and decoding", encode)]

#: SQL can express neither the language models nor the merges of a tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages; a stage's documents are deleted once the next one's are written, so two of them stand at a time."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs, path = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            deleted(spark, before)
        before = path
    return docs
