"""Keyed hashes against the standard library, dates around links, amounts that can't be read, places in the catalogue."""

import base64
import hashlib
import hmac
import random

from pyspark.sql import functions as F

from tidewatch.functions import keyed, money
from tidewatch.operators import accounts, catalogue
from tidewatch.sources import pages


def test_hmac_of_random_rows(spark):
    r = random.Random(2)
    rows = [(i, bytearray(r.randbytes(r.choice([0, 1, 63, 64, 65, 500])))) for i in range(40)]
    df = spark.createDataFrame([*rows, (99, None)], "i int, m binary")
    for key in (b"", b"k", r.randbytes(64), r.randbytes(65), r.randbytes(200)):
        out = df.select("i", keyed.hmac_sha256(key, F.col("m")).alias("d"))
        got = {x.i: x.d for x in out.collect()}
        assert got.pop(99) is None and got == {i: hmac.new(key, bytes(m), hashlib.sha256).digest() for i, m in rows}
        assert "Python" not in out._jdf.queryExecution().toString()


def test_tokens_and_calls(spark):
    pairs = spark.createDataFrame([(1, "sol"), (1, None), (11, ""), (2, "sol")], "user_id long, medida string")
    issued = spark.createDataFrame([(1, None, "old")], "user_id long, medida string, token string")
    got = {(x.user_id, x.medida): x.token for x in accounts.tokens_for(pairs, issued, b"s").collect()}
    assert got[1, None] == "old" and len(set(got.values())) == 4 and {len(t) for k, t in got.items() if k != (1, None)} == {32} and not set("+/=") & set("".join(got.values()))
    assert got == {(x.user_id, x.medida): x.token for x in accounts.tokens_for(pairs, issued, b"s").collect()}
    secret, body = b"0123456789abcdef", "{}"
    mac = base64.b64encode(hmac.new(secret, f"id.1000.{body}".encode(), hashlib.sha256).digest()).decode()
    calls = [("1000", f"v1,{mac}"), ("1000", f"v1,x v1,{mac}"), ("1000", mac), ("1000", ""), ("1000", None), ("999", f"v1,{mac}"), ("x", f"v1,{mac}"), (None, f"v1,{mac}"), ("nan", f"v1,{mac}")]
    df = spark.createDataFrame([(i, "id", s, body, h) for i, (s, h) in enumerate(calls)], "n int, id string, carimbo string, corpo string, assinatura string")
    at = lambda s: [x.aceite for x in accounts.received(df, "whsec_" + base64.b64encode(secret).decode(), F.timestamp_seconds(F.lit(s))).orderBy("n").collect()]
    assert at(1300) == [True, True, *[False] * 7] and at(1301) == [False] * 9 and at(700)[:2] == [True, True]


def test_dates_around_links(spark):
    listing = '<body>1/1/2001 <ul><li><a href="a">Um aviso</a> até 30/09/2026 e 1/10/2026</li><li>2 de março de 2026: <a href="b"><b>Dois</b></a><br><li><p><a href="c">três</a></p> 5/5/2025</li></ul><a href="d">fim</a><a>sem</a>'
    rows = spark.createDataFrame([("https://x.pt/", listing), ("n", None), ("t", 'antes 3-4-25 <a href="z">x')], "url string, html string")
    got = {(x.url, x.href): (x.texto, x.data) for x in pages.dated_links(rows).collect()}
    assert got == {("https://x.pt/", "a"): ("Um aviso", "30/09/2026"), ("https://x.pt/", "b"): ("Dois", "2 de março de 2026"), ("https://x.pt/", "c"): ("três", None), ("https://x.pt/", "d"): ("fim", "1/1/2001"), ("t", "z"): ("x", "3-4-25")}
    found = pages.candidates(pages.dated_links(rows), "^/[ab]$", least_title=4)
    assert [(x.titulo, x.data) for x in found.orderBy("posicao").collect()] == [("Um aviso", "30/09/2026"), ("Dois", "2 de março de 2026")]


def test_many_links_in_one_element(spark):
    page = "<div>" + "".join(f'<a href="{i}">x</a> ' for i in range(30_000)) + "1/2/2026</div>"
    rows = pages.dated_links(spark.createDataFrame([("u", page)], "url string, html string"))
    assert rows.where("data = '1/2/2026'").count() == 30_000


def test_amounts_that_are_none(spark):
    texts = {"30.09.2026": None, "1.2.3": None, "1.500.00": None, "1,2,5": None, "1.500,5,5": None, "1,500.5.5": None, "1.500": 1500, "1.500.000": 1_500_000, "1,5": 1.5, "1.500,25": 1500.25, "1,500.25": 1500.25, "1,500": 1500, "1,500 mil": 1500, "12": 12, "": None, "sem": None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", money.amount(F.col("t")).alias("v")).collect()
    assert {x.t: None if x.v is None else float(x.v) for x in got} == texts


def test_places(spark):
    rows = [(i, ["aberto", "desconhecido", "encerrado", "suspenso", "previsto"][i % 5], None, ["Zé", "Água", "agua", "b"][i % 4]) for i in range(40)]
    df = spark.createDataFrame(rows, "fund_id int, estado string, fecha_em timestamp, titulo string").repartition(5)
    got = catalogue.placed(df).orderBy("lugar").collect()
    assert [x.lugar for x in got] == list(range(1, 41)) and {x.total for x in got} == {40}
    assert [x.fund_id for x in got] == [x.fund_id for x in catalogue.ordered(df).collect()]
    assert [x.estado for x in got][::8] == ["aberto", "previsto", "suspenso", "desconhecido", "encerrado"] and [x.titulo for x in got][:8:2] == ["agua", "Água", "b", "Zé"]
