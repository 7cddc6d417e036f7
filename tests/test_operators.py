"""Scenarios of the notice engine's operators, sources and streams."""

import datetime as dt
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import urls
from tidewatch.operators import catalogue, gate, identity, matching, store, sweep
from tidewatch.sources import files, pages, registry
from tidewatch.streaming import event_log

FUND = "fund_id long, estado string, abre_em timestamp, fecha_em timestamp, precisao string, publicado boolean, alertavel boolean, dotacao_esgotada boolean, admite string, dotacao double"


def fund(i=1, estado="aberto", fecha="2026-09-30 23:59:59", precisao="dia", **more):
    base = dict(fund_id=i, estado=estado, abre_em=dt.datetime(2026, 3, 1), fecha_em=fecha and dt.datetime.fromisoformat(fecha), precisao=precisao, publicado=True, alertavel=True, dotacao_esgotada=False, admite="sim", dotacao=100.0)
    return base | more


def at(s):
    return F.lit(s).cast("timestamp")


def test_thirty_days_of_sweeps_give_four_closing_alerts(spark):
    rows = spark.createDataFrame([fund()], FUND)
    seen = set()
    for back in range(30, -1, -1):
        now = dt.datetime(2026, 9, 30, 12) - dt.timedelta(days=back)
        seen |= {r.impressao for r in sweep.closing_tightest(rows, at(str(now))).collect()}
    assert len(seen) == 4


def test_vague_or_exhausted_funds_are_silent(spark):
    rows = spark.createDataFrame([fund(1, precisao="mes"), fund(2, dotacao_esgotada=True), fund(3, fecha=None)], FUND)
    assert sweep.closing_tightest(rows, at("2026-09-29 00:00:00")).count() == 0
    both = spark.createDataFrame([fund(4)], FUND)
    assert sweep.closing_each(both, at("2026-09-30 12:00:00")).count() == 4 and sweep.closing_tightest(both, at("2026-09-30 12:00:00")).count() == 1


@pytest.mark.parametrize(
    "before,after,kinds",
    [
        (None, {}, ["programa_novo"]),
        (None, {"estado": "encerrado"}, []),
        ({"estado": "previsto"}, {}, ["abriu"]),
        ({"estado": "encerrado"}, {}, ["reaberto"]),
        ({}, {"estado": "encerrado"}, ["encerrou"]),
        ({}, {"fecha": "2026-10-15 23:59:59"}, ["prazo_alterado"]),
        ({"precisao": "mes"}, {"precisao": "mes", "fecha": "2026-10-31 23:59:59"}, []),
        ({}, {"dotacao_esgotada": True}, ["dotacao_esgotada"]),
        ({}, {"dotacao": 150.0}, ["reforco_dotacao"]),
        ({}, {"dotacao": 50.0}, []),
        ({"admite": "nao"}, {}, ["elegibilidade_alterada"]),
        ({}, {"admite": "desconhecido"}, ["elegibilidade_alterada"]),
        ({"dotacao": None}, {}, []),
        ({}, {}, []),
    ],
)
def test_diff(spark, before, after, kinds):
    old = spark.createDataFrame([fund(**before)] if before is not None else [], FUND)
    got = gate.diff(old, spark.createDataFrame([fund(**after)], FUND)).collect()
    assert [r.tipo for r in got] == kinds
    if kinds == ["abriu"]:
        assert got[0].impressao == spark.range(1).select(urls.fingerprint(F.lit(1), F.lit("abriu"), F.lit('{"de":"previsto"}'))).first()[0]


EXTRACTION = "id long, recusa boolean, e_aviso boolean, provas_falhadas array<string>, conf_estado string, conf_encerramento string, conf_admite string, ocr_ma boolean, admite string, condominio boolean, estado string, prazo timestamp"


def test_gate(spark):
    fine = (1, False, True, [], "alta", "alta", "alta", False, "sim", False, "aberto", dt.datetime(2026, 9, 30))
    edit = lambda **k: tuple(k.get(n.split()[0], x) for n, x in zip(EXTRACTION.split(", "), fine, strict=True))
    rows = [fine, edit(id=2, recusa=True), edit(id=3, provas_falhadas=["estado"]), edit(id=4, admite="desconhecido"), edit(id=5, admite="nao", condominio=True), edit(id=6, estado="encerrado"), edit(id=7, estado="encerrado", prazo=dt.datetime(2026, 1, 1), recusa=True), edit(id=8, conf_estado="baixa"), edit(id=9, estado="encerrado", prazo=None, recusa=True)]
    got = {r.id: r for r in gate.decide(spark.createDataFrame(rows, EXTRACTION), at("2026-06-01 00:00:00")).collect()}
    flags = lambda r: (r.publicado, r.alertavel, r.needs_review)
    assert flags(got[1]) == (True, True, False) and flags(got[2]) == (False, False, True) and flags(got[3]) == (True, False, True)
    assert got[3].motivos == ["prova_falhou:estado"] and got[4].motivos == ["admite_particulares:desconhecido"] and flags(got[5]) == (True, True, False)
    assert got[6].motivos == ["estado_incoerente:encerrado_com_prazo_2026-09-30"] and flags(got[7])[0] and not flags(got[8])[0] and not flags(got[9])[0]


def test_quotes(spark):
    rows = spark.createDataFrame([("O prazo é\n30 de Março", "prazo e 30 de marco"), ("texto", "inventado"), ("texto", ""), (None, "x")], "d string, q string")
    assert [r[0] for r in rows.select(gate.quoted(F.col("d"), F.col("q"))).collect()] == [True, False, True, False]


def keys(spark, *rows):
    return spark.createDataFrame(list(rows), "cand_id long, tipo string, valor string, forca int")


def test_identity(spark):
    known = spark.createDataFrame([("referencia", "r1", 10), ("url", "u1", 10), ("titulo", "t1", 10), ("url", "u2", 20)], "tipo string, valor string, fund_id long")
    cands = keys(spark, (1, "url", "u9", 70), (2, "url", "u1", 70), (2, "referencia", "r2", 100), (3, "referencia", "r1", 100), (3, "url", "u2", 70), (4, "titulo", "t1", 30), (4, "url", "u8", 70))
    got = {r.cand_id: (r.resultado, r.fund_id) for r in identity.resolve(cands, known).collect()}
    assert got == {1: ("novo", None), 2: ("existente", 10), 3: ("conflito", 10), 4: ("existente", 10)}
    assert {r.cand_id: r.resultado for r in identity.resolve(cands, known, dataset=True).collect()}[4] == "novo"


def test_identity_within_a_batch(spark):
    known = spark.createDataFrame([], "tipo string, valor string, fund_id long")
    cands = keys(spark, (1, "url", "a", 70), (2, "url", "a", 70), (2, "titulo", "t", 30), (3, "titulo", "t", 30), (4, "url", "z", 70))
    found, added = identity.resolve_batch(cands, known)
    got = {r.cand_id: (r.resultado, r.fund_id) for r in found.collect()}
    assert {c: r for c, (r, _) in got.items()} == {1: "novo", 2: "existente", 3: "existente", 4: "novo"} and got[1][1] == got[2][1] == got[3][1] != got[4][1]
    assert sorted(r.valor for r in added.collect()) == ["a", "t", "z"]


def test_store_is_idempotent(spark):
    batch = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n long, k string")
    new = store.new_rows(batch, batch.limit(0), ["k"], "n")
    assert sorted((r.n, r.k) for r in new.collect()) == [(1, "a"), (3, "b")] and store.new_rows(batch, new, ["k"], "n").count() == 0
    old = spark.createDataFrame([(1, "s1", "x"), (2, "s2", "y")], "id long, slug string, v string")
    merged = store.upsert(old, spark.createDataFrame([(2, "other", "z"), (3, "s3", "w")], "id long, slug string, v string"), "id", ["slug"])
    assert sorted(map(tuple, merged.collect())) == [(1, "s1", "x"), (2, "s2", "z"), (3, "s3", "w")]
    gate_ = store.changed(spark.createDataFrame([("u", "h2"), ("w", "h"), ("n", "h")], "url string, hash string"), spark.createDataFrame([("u", "h1"), ("w", "h")], "url string, hash string"), "url", "hash")
    assert sorted(r.url for r in gate_.collect()) == ["n", "u"]


def test_pages_that_share_an_url_are_each_compared_with_their_own_capture(spark, tmp_path):
    from tidewatch import registry

    spark.createDataFrame([(1, "u", "<p>a</p>"), (2, "u", "<p>b</p>"), (7, "u", "<p>c</p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in registry.QUERIES["latest_snapshot_gate"](spark, str(tmp_path)).collect()] == [(7, "u")]


def test_confirmation_and_unsubscribing(spark):
    box = spark.createDataFrame([(i, "a_enviar", t, i) for i, t in enumerate([1, 1, 1, 5, 1])], "id long, estado string, tentativas int, pedido_id long")
    answers = spark.createDataFrame([(0, 200), (1, 400), (2, 503), (3, 503), (4, None)], "id long, status_code int")
    got = {r.id: (r.estado, r.espera_min) for r in matching.confirmed(box, answers).collect()}
    assert got[0] == ("enviado", None) and got[1][0] == "falhou" and got[2][0] == "pendente" and 15 <= got[2][1] < 25 and got[3][0] == "falhou" and got[4][1] >= 15
    assert {r.id: r.espera_min for r in matching.confirmed(box, answers, strict_null=True).collect()}[4] == 0


def test_filters_round_trip():
    f = catalogue.Filters.parse("estados=encerrado&beneficiarios=&medidas=a,b&medidas=c")
    assert f.estados == ["encerrado"] and f.beneficiarios == [] and f.medidas == ["a", "b", "c"] and catalogue.Filters.parse(f.serialise()) == f
    assert catalogue.Filters.parse("") == catalogue.Filters() and catalogue.Filters().toggled("medidas", "x").medidas == ["x"]


def test_health(spark):
    schema = "run_id string, candidatos long, erro string, falhas_antes long, base double, com_data long, horas_sem_mudanca long, adiadas long, falhadas long, chamadas long, extraccoes_ok long, extraccoes_revisao long, provas_falhadas long, cache_lida long"
    rows = [("ok", 30, None, 0, 30.0, 5, 1, 0, 0, 0, 5, 0, 0, 9), ("zero", 0, None, 0, 30.0, 0, 1, 0, 0, 0, 0, 0, 0, 0), ("few", 3, None, 0, 0.0, 1, 1, 0, 0, 0, 0, 0, 0, 0), ("drop", 25, None, 0, 90.0, 1, 600, 0, 34, 34, 0, 0, 0, 0), ("err", 0, "x", 1, 30.0, 0, 1, 1, 0, 0, 0, 0, 0, 0)]
    got: dict = {}
    for r in gate.health(spark.createDataFrame(rows, schema)).collect():
        got.setdefault(r.run_id, {})[r.regra] = r.gravidade
    assert "ok" not in got and got["zero"] == {"zero_candidatos": "critico"} and got["few"] == {"abaixo_do_minimo": "critico"}
    assert got["drop"] == {"queda_de_candidatos": "aviso", "conteudo_congelado": "aviso", "extraccoes_falhadas": "critico", "cache_nao_lida": "aviso"} and set(got["err"]) == {"falhas_consecutivas", "tecto_de_custo_atingido"}


def test_budget_stops_after_it_is_passed(spark):
    calls = spark.createDataFrame([(1, i, c) for i, c in enumerate([0.6, 0.6, 0.6, None, 0.1])], "g int, i int, c double")
    assert [r.i for r in gate.within_budget(calls, "g", "i", "c", 1.0).orderBy("i").collect()] == [0, 1]
    assert gate.batch_size(10, 1.0, 0.3) == 3 and gate.batch_size(10, 1.0, None) == 0


def test_links_and_candidates(spark):
    body = '<a href="/avisos/1">Aviso n.º 3/2026 de apoio</a><a href="/avisos/1?utm_source=x">Again the same one</a><a href="/outra">Other page here</a><a href="/f.xlsx">aqui</a><a href="mailto:a@b">Write to us please</a>'
    found = pages.links(spark.createDataFrame([("https://a.pt/l", body), ("https://a.pt/m", None)], "url string, html string"))
    assert found.count() == 5
    got = pages.candidates(found, r"^/avisos/\d+$").collect()
    assert [(r.chave, r.referencia) for r in got] == [("https://a.pt/avisos/1", "AVISO 03/2026")]
    assert [r.titulo for r in pages.spreadsheets(found).collect()] == ["f.xlsx"]
    assert registry.sources(spark, active_only=True).count() == 5 and registry.pages_to_read(230, 5, 200) == list(range(46))


def test_notices_of_json(spark):
    body = '{"status":1,"avisos":[{"aviso":{"codigoAviso":"A-1","designacaoPT":"T"},"estrutura":[{"dotacao":1.5,"marca":"N"},{"dotacao":2,"marca":"N"}],"calendario":{"dataInicio":"2026-01-02T00:00","dataFim":"2026-02-01","dataFimAtual":"2026-03-01"},"documentos":[{"tipoDocumentoDesignacao":"Aviso","path":"a.PDF"},{"tipoDocumentoDesignacao":"Aviso","path":"a.xlsx"}]},{"aviso":{"codigoAviso":" ","designacaoPT":"x"}},{"aviso":{"codigoAviso":"B","designacaoPT":"U"},"estrutura":[{"dotacao":0}]}]}'
    got = {r.codigo: r for r in files.notices(spark.createDataFrame([(body,), ("not json",)], "body string")).collect()}
    assert set(got) == {"A-1", "B"} and got["A-1"].dotacao == 3.5 and got["A-1"].marcas == ["N"] and str(got["A-1"].fecha) == "2026-03-01" and got["A-1"].documento == "a.PDF" and got["B"].dotacao is None


def test_spreadsheet_and_pdf(spark):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Designação do Aviso</t></si><si><t>Apoio</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="inlineStr"><is><t>Plano</t></is></c></row><row><c r="A2" t="inlineStr"><is><t>ID</t></is></c><c r="C2" t="s"><v>0</v></c></row><row><c r="A3"><v>7</v></c><c r="C3" t="s"><v>1</v></c></row><row/></sheetData></worksheet>')
    got = files.sheet_rows(spark.createDataFrame([(bytearray(buffer.getvalue()),)], "content binary")).collect()
    assert [r.valores for r in got] == [{"ID": "7", "Designação do Aviso": "Apoio"}]
    stream = zlib.compress(b"BT [(Ol\\341) -200 (mun) 10 (do)] TJ T* (Fim\\)) Tj ET")
    pdf = b"%PDF-1.4\n<< /CreationDate (D:20260102030405+01'00') >>\nstream\n" + stream + b"\nendstream"
    row = spark.createDataFrame([(bytearray(pdf),), (bytearray(b"<html>"),)], "c binary").select(files.pdf_text(F.col("c")).alias("t"), files.pdf_date(F.col("c")).alias("d"), files.is_pdf(F.col("c")).alias("p")).collect()
    assert (row[0].t, row[0].d, row[0].p) == ("Olá mundo\nFim)", "2026-01-02T03:04:05", True) and (row[1].t, row[1].p) == (None, False)


def test_stream_appends_each_event_once(spark, tmp_path):
    schema = "impressao string, criado_em timestamp, user_id long"
    source, target = str(tmp_path / "in"), str(tmp_path / "log")
    rows = spark.createDataFrame([("a", dt.datetime(2026, 1, 1), 1), ("a", dt.datetime(2026, 1, 2), 1), ("b", dt.datetime(2026, 1, 1), 2)], schema)
    rows.write.parquet(source)
    for _ in range(2):
        events = event_log.unique_events(spark.readStream.schema(schema).parquet(source))
        q = events.writeStream.foreachBatch(event_log.appender(spark, target, ["impressao"], "criado_em")).option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r.impressao for r in spark.read.parquet(target).collect()) == ["a", "b"]
    claim = event_log.claim_then_queue(spark, str(tmp_path / "ledger"), str(tmp_path / "outbox"))
    for batch in (0, 0, 1):
        claim(rows.select("user_id", "impressao"), batch)
    assert spark.read.parquet(str(tmp_path / "outbox" / "lote=0")).count() == 2 and spark.read.parquet(str(tmp_path / "outbox" / "lote=1")).count() == 0


def test_a_batch_reads_its_own_days(spark, tmp_path):
    import shutil

    path = str(tmp_path / "log")
    append = event_log.appender(spark, path, ["impressao"], "event_id", "dia")
    rows = lambda *x: spark.createDataFrame(list(x), "event_id long, impressao string, dia string")
    append(rows((1, "a", "2024-01-01"), (2, "b", "2024-01-02")), 0)
    append(rows((3, "b", "2024-01-02"), (4, "c", "2024-01-02")), 1)
    assert sorted(r.impressao for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    for f in (tmp_path / "log" / "dia=2024-01-01").iterdir():  # a day that can't be read any more
        f.write_bytes(b"broken") if f.suffix == ".parquet" else f.unlink()
    append(rows((5, "c", "2024-01-02"), (6, "d", "2024-01-03")), 2)
    shutil.rmtree(tmp_path / "log" / "dia=2024-01-01")
    assert sorted(r.impressao for r in spark.read.parquet(path).collect()) == ["b", "c", "d"]
