"""What a row costs: a part that is named often is computed once."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch import registry
from tidewatch.functions import money, text
from tidewatch.operators import identity

DATA = "/root/testdata/sf0.001"


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxPlanStringLength", str(10**8))
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_references_and_amounts_read_a_text_once(spark):
    rows = spark.createDataFrame([("Aviso n.º 3/2026, 1,5 milhões",), ("sem nada",), ("",), (None,)], "s string")
    out = rows.select(text.legal_reference(F.col("s")).alias("r"), money.amount(F.col("s")).cast("string").alias("a"))
    assert plan(out).count("regexp_extract(") <= 3  # a kind, the digits of a body, a number
    assert out.collect() == [("AVISO 03/2026", "3000000.00"), (None, None), (None, None), (None, None)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_a_batch_parses_an_answer_once(spark):
    assert plan(registry.QUERIES["model_batch"](spark, DATA)).count("from_json(") == 1


def test_candidates_move_once_to_be_judged(spark):
    rows = spark.createDataFrame([(1, "url", "a", 70, "8"), (1, "titulo", "b", 30, "9"), (2, "url", "c", 70, None)], "cand_id long, tipo string, valor string, forca int, fund_id string")
    out = identity._outcome(rows, False)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((r.cand_id, r.resultado, r.nomeados) for r in out.collect()) == [(1, "conflito", ["8", "9"]), (2, "novo", [])]
