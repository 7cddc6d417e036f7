"""Golden values of the scalar functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import dates, html, money, text, urls


def values(spark, column, inputs, kind="string"):
    rows = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, s {kind}").orderBy("i").select(column(F.col("s"))).collect()]
    return rows


def test_text(spark):
    assert values(spark, text.strip_accents, ["março Município É", "café", None]) == ["marco Municipio E", "cafe", None]
    assert values(spark, text.squeeze, [" a  b​\n c "]) == ["a b c"]
    assert values(spark, text.comparable, ["  ÁGUA  e\tSol"]) == ["agua e sol"]
    assert values(spark, text.escape_html, ['<a href="x">&', None]) == ["&lt;a href=&quot;x&quot;&gt;&amp;", ""]
    assert values(spark, text.title_key, ["Apoio à Eficiência dos Edifícios (Segunda Republicação)", "Retificação: o Sol"]) == ["apoio-eficiencia-edificios", "sol"]
    assert values(spark, text.split_list, ["a | b||c "]) == [["a", "b", "c"]]
    assert values(spark, text.json_of_reply, ["x {\"a\":{}} y", "none"]) == ['{"a":{}}', None]


@pytest.mark.parametrize("s,want", [("Aviso n.º 03/C13-i01/2024", "AVISO 03/C13-I01/2024"), ("AVISO No 3/C13-I01/2024", "AVISO 03/C13-I01/2024"), ("aviso nº 03/c13-i01/2024", "AVISO 03/C13-I01/2024"), ("AVISO-CONVITE 02/C08-I05.02/2022", "AVISO-CONVITE 02/C08-I05.02/2022"), ("NORTE2030-2026-23", "NORTE2030-2026-23"), ("sem nada", None), ("", None)])
def test_references(spark, s, want):
    assert values(spark, text.legal_reference, [s]) == [want]


def test_lost_prefix_and_codes(spark):
    rows = spark.createDataFrame([("2030-2026-23", "ver NORTE-2030-2026-23 aqui"), ("9-1", "nada")], "r string, t string")
    assert [r[0] for r in rows.select(text.lost_prefix(F.col("r"), F.col("t"))).collect()] == ["NORTE-", None]
    assert values(spark, text.notice_codes, ["A-2026-1 a-2026-1 B-2025-2", None]) == [["A-2026-1", "B-2025-2"], []]
    assert values(spark, text.notice_codes, ["MPr-2026-1 NORTE2030-2026-12345 norte-2026-1 x-NORTE2030-2026-12 Centro2030-2026-7 CENTRO2030-2026-7 2A-2026-1"]) == [["MPr-2026-1", "NORTE2030-2026-12", "Centro2030-2026-7"]]


def test_amounts(spark):
    given = ["1.500.000,00 €", "€ 15.000", "15 000 EUR", "15000", "até 15.000,00€", "2 milhões de euros", "1,5 M€", "850,50 €", "12 mil euros", "nada", "", None]
    got = [None if x is None else float(x) for x in values(spark, money.amount, given)]
    assert got == [1500000.0, 15000.0, 15000.0, 15000.0, 15000.0, 2000000.0, 1500000.0, 850.5, 12000.0, None, None, None]
    assert values(spark, money.percentage, ["85%", "até 85 %", "85 por cento", "x", "250%", "7,5%"]) == [85.0, 85.0, 85.0, None, None, 7.5]
    assert values(spark, money.euros, [1234.5], "double") == ["1.234,50 €"]
    row = spark.range(1).select(money.call_cost(*[F.lit(1_000_000)] * 4)).first()
    assert row[0] == 36.75


@pytest.mark.parametrize(
    "s,closing,at,kind",
    [
        ("até às 18:00 do dia 30 de setembro de 2026", True, "2026-09-30 17:00:00", "minuto"),
        ("30 de setembro de 2026", True, "2026-09-30 22:59:59", "dia"),
        ("31/12/2025", True, "2025-12-31 23:59:59", "dia"),
        ("31-12-25", True, "2025-12-31 23:59:59", "dia"),
        ("2026-03-15", False, "2026-03-15 00:00:00", "dia"),
        ("30 set. 2026", True, "2026-09-30 22:59:59", "dia"),
        ("durante o mês de outubro de 2026", True, "2026-10-31 23:59:59", "mes"),
        ("outubro de 2026", False, "2026-09-30 23:00:00", "mes"),
        ("10/2026", True, "2026-10-31 23:59:59", "mes"),
        ("2026-03-29", True, "2026-03-29 22:59:59", "dia"),
        ("31/02/2026", False, "2026-03-03 00:00:00", "dia"),
        ("1.º trimestre de 2026", True, "2026-03-31 22:59:59", "mes"),
        ("2.º quadrimestre de 2026", False, "2026-04-30 23:00:00", "mes"),
        ("4.º quadrimestre de 2026", True, None, "desconhecida"),
        ("a definir", True, None, "desconhecida"),
    ],
)
def test_dates(spark, s, closing, at, kind):
    p = spark.createDataFrame([(s,)], "s string").select(dates.parse_date(F.col("s"), closing).alias("p")).select(F.date_format("p.at", "yyyy-MM-dd HH:mm:ss"), "p.precisao").first()
    assert tuple(p) == (at, kind)


def test_clock_functions(spark):
    assert values(spark, dates.excel_date, [60, 61, 46023], "int") == [dt.date(1900, 2, 29 - 1) + dt.timedelta(1), dt.date(1900, 3, 1), dt.date(2026, 1, 1)]
    row = lambda c: spark.range(1).select(c).first()[0]
    at = lambda s: F.lit(s).cast("timestamp")
    send = lambda f, u, s: row(F.date_format(dates.next_send(F.lit(f), F.lit(u), at(s)), "yyyy-MM-dd HH:mm"))
    assert send("diaria", False, "2026-07-01 06:00:00") == "2026-07-01 07:00" and send("diaria", False, "2026-07-01 07:00:00") == "2026-07-02 07:00"
    assert send("semanal", False, "2026-01-05 06:00:00") == "2026-01-12 08:00" and send("semanal", True, "2026-01-05 06:00:00") == "2026-01-05 06:00"
    assert row(dates.days_until(at("2026-01-02 00:00:00"), at("2026-01-01 12:00:00"))) == 0 and row(dates.days_until(at("2026-01-01 00:00:00"), at("2026-01-01 12:00:00"))) == -1


def test_urls(spark):
    same = ["https://www.Exemplo.pt/a/b/?b=2&a=1&utm_source=x#f", "http://exemplo.pt/a/b?a=1&b=2", "HTTPS://exemplo.pt/a/b/?fbclid=9&a=1&b=2"]
    assert values(spark, urls.canonical_url, same) == ["https://exemplo.pt/a/b?a=1&b=2"] * 3
    assert values(spark, urls.canonical_url, [" Not A Url ", "https://a.pt/"]) == ["not a url", "https://a.pt"]
    rows = spark.createDataFrame([(h,) for h in ["/x", "y.html", "https://www.a.pt/z", "https://b.pt/", "mailto:a@b", "#top", None]], "h string")
    assert [r[0] for r in rows.select(urls.resolve(F.lit("https://a.pt/d/e"), F.col("h"))).collect()] == ["https://a.pt/x", "https://a.pt/d/y.html", "https://www.a.pt/z", None, None, None, None]


def test_page_hash_ignores_what_is_volatile(spark):
    a = '<input type="hidden" name="__VIEWSTATE" value="aaa"><script nonce="1">var s=1</script><a href="/x?v=1234567">t</a> <b id="k1">z</b>'
    b = '<input  name="__VIEWSTATE" value="bbb"/><script nonce="2">var s=2</script><a href="/x?v=7654321">t</a>\n<b id="k2">z</b>'
    c = a.replace("/x?", "/y?")
    x, y, z = values(spark, html.content_hash, [a, b, c])
    assert x == y != z
    assert values(spark, html.visible_text, ["<p>A&ccedil;&atilde;o &#233; &amp;lt; &middot;</p><script>no</script>"]) == ["Ação é &lt; &middot;"]
    assert values(spark, html.soft_404, ["<title>Erro 404</title>", "<title>Bem</title>", None]) == [True, False, False]


def test_a_title_with_404_in_a_longer_number_is_no_error(spark):
    title = lambda x: f"<title>{x}</title>"
    good = [title(x) for x in ("as +1 (483) 555-6404 er", "anor 4045720305701718 ouha", "ananst +1 (404) 555-9676 ontio", "+1 555 404-1234", "10.404.7.1", "Caminho de ferro", "terror", "x404y")]
    assert values(spark, html.soft_404, good) == [False] * len(good)
    bad = [title(x) for x in ("404", "Página inexistente (404)", "404 - Portal", "Portal | 404 Page", "Ocorreu um erro", "Erros", "Error 500", "Errors", "Página não encontrada")] + ["<Error><Code>x"]
    assert values(spark, html.soft_404, bad) == [True] * len(bad)
