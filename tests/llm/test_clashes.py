"""Columns whose names the operators use themselves, labels without letters, and what the pipeline leaves behind."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import decontamination, language_id, ngram_join
from tidewatch.llm.storage import shared_dir

TEXT = "a text of words enough to be taken for one of the copies that stand here more than once in all"
NAMES = ["score", "lang_pred", "rejected", "cross_entropy", "row", "_word", "_bit", "_bits", "_marked", "_key0", "_id", "_h", "word", "kinds", "spans"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, TEXT if i < 4 else f"{TEXT[::-1]} {i} " * (i % 3 + 1) + f"other words of document {i} " * 9, "en", "s", 1) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def clashing(df):
    return df.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES})


def test_stages_with_clashing_names(spark, docs, tmp_path):
    spark.createDataFrame([(1, "none of these words stands in any of the documents that are here at all now")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    some, plain = clashing(docs), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        some, plain = stage(spark, some, str(tmp_path)), stage(spark, plain, str(tmp_path))
        got = some.collect()
        assert some.columns == clashing(docs).columns, name
        assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, r.text) for r in plain.collect()) and got, name
        assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in NAMES), name


def test_copies_and_contaminated_rows_with_clashing_names(spark, docs):
    rows = clashing(docs.unionByName(docs.where("doc_id = 0")))
    kept = [r.doc_id for r in ngram_join.one_of_each(rows).collect()]
    assert kept.count(0) == 1 and not {1, 2, 3} & set(kept)
    benchmark = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    assert {0, 1, 2, 3}.isdisjoint(r.doc_id for r in decontamination.clean(clashing(docs), benchmark).collect())


def test_redaction_without_a_length(spark, docs):
    some = docs.drop("n_chars").withColumn("text", F.lit("password=abcdef012345 and more"))
    assert {r.text for r in corpus_pipeline.redact(spark, some, "").collect()} == {"[assign] and more"}


def test_labels_without_letters(spark):
    rows = spark.createDataFrame([(i, "12 34 !", "en") for i in range(5)] + [(9, "", "pt"), (9, None, "pt")], "doc_id long, text string, lang string")
    model = language_id.fit(rows)
    assert model is None and {r.lang_pred for r in language_id.predict(rows, model).collect()} == {"und"}
    assert language_id.predict(rows.limit(0), language_id.fit(rows.limit(0))).count() == 0


def test_pipeline_leaves_its_result_alone(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, TEXT[5:])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(os.listdir(at)) - before) == 1 and found.count() > 0
