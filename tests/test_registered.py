"""Functions by their names in SQL give what the Columns give, without a Python worker."""

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import registered

TEXTS = [None, "", "Aviso n.º 3/C13-i01/2024 — 1.500,25 € até 30 de setembro de 2026, às 18h30", "2 milhões; NORTE2030-2026-7 e norte2030-2026-7", "http://WWW.Exemplo.pt/a/?b=2&a=1#x", "a | b|c", '```json {"a": 1}```', "85 %", "1.º trimestre de 2026", "it's <b> \\d \"q\" `x` = and(or"]


@pytest.fixture(scope="module")
def rows(spark):
    registered.registered(spark)
    df = spark.createDataFrame([(i, s) for i, s in enumerate(TEXTS)], "i int, t string")
    df.createOrReplaceTempView("texts")
    return df


def column(kind):
    return {"string": F.col("t"), "long": F.col("i").cast("long") + 2020, "int": F.col("i"), "double": F.col("i") * 1000.5, "boolean": F.col("i") % 2 == 0, "timestamp": F.timestamp_seconds(F.col("i") * 10_000_000)}[kind]



SQL = {"string": "t", "long": "cast(i as bigint) + 2020", "int": "i", "double": "i * 1000.5d", "boolean": "i % 2 = 0", "timestamp": "timestamp_seconds(i * 10000000)"}


@pytest.mark.parametrize("name", sorted(registered.FUNCTIONS))
def test_sql_equals_column(spark, rows, name):
    arguments, build = registered.FUNCTIONS[name]
    kinds = [a.split()[1] for a in arguments.split(", ")]
    # dates are read from text by functions that refuse what is none
    some = rows.where("i < 1") if name == "tw_lisbon_to_utc" else rows
    want = [r[0] for r in some.orderBy("i").select(build(*[column(k) for k in kinds])).collect()]
    found = spark.sql(f"select {name}({', '.join(SQL[k] for k in kinds)}) x from texts {'where i < 1' if name == 'tw_lisbon_to_utc' else ''} order by i")
    assert [r.x for r in found.collect()] == want
    assert "Python" not in found._jdf.queryExecution().toString()


def test_links_as_a_table(spark, rows):
    spark.createDataFrame([(1, '<a href="x">y <i>z</i></a><a href="w"></a>'), (2, None), (3, "none")], "p int, html string").createOrReplaceTempView("some_pages")
    got = spark.sql("select p, l.* from some_pages, lateral listing_links(html) l order by p, posicao").collect()
    assert [tuple(r) for r in got] == [(1, 0, "x", "y z"), (1, 1, "w", "")]
    assert spark.sql("select tw_excel_date(60d) a, tw_excel_date(61d) b").first() == spark.range(1).select(registered.dates.excel_date(F.lit(60.0)).alias("a"), registered.dates.excel_date(F.lit(61.0)).alias("b")).first()
