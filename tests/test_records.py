"""Runs, whole extractions, stored funds, identities that are written, letters and the scoped scans of archives."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidewatch.functions import dates, urls
from tidewatch.operators import extraction, gate, identity, matching, model_calls, records, runs
from tidewatch.plans.run_queries import whole_extraction
from tidewatch.sources import files, pages, registry

def now():
    return F.lit("2026-03-01 12:00:00").cast("timestamp")


def at(day, hour=0):
    return dt.datetime(2026, 3, day, hour)


def test_runs_open_and_close(spark):
    table = runs.opened(spark.createDataFrame([("a", "s1"), ("b", None)], "run_id string, git_sha string"), now())
    done = runs.closed(table, spark.createDataFrame([("a", "ok", "{}"), ("z", "ok", "{}")], "run_id string, estado string, resumo string"), now())
    assert {r.run_id: (r.estado, r.resumo, r.terminado_em is not None) for r in done.collect()} == {"a": ("ok", "{}", True), "b": ("a_correr", None, False)} and done.columns == table.columns


def test_captures_are_marked_by_content(spark):
    rows = spark.createDataFrame([("u", "h1", None), ("u", "h2", False), ("w", "h1", True)], "url string, hash string, processado boolean")
    assert sorted((r.url, r.hash, r.processado) for r in runs.processed(rows, rows.where("url = 'u' and hash = 'h1'")).collect()) == [("u", "h1", True), ("u", "h2", False), ("w", "h1", True)]


def test_audit_rows_are_appended_as_they_are(spark, tmp_path):
    rows = spark.range(1).select(*[F.lit(None).cast("string").alias(c) for c in runs.AUDIT], F.lit(1).alias("more"))
    for _ in range(2):
        runs.appended(rows, runs.AUDIT, str(tmp_path / "audit"))
    kept = spark.read.parquet(str(tmp_path / "audit"))
    assert kept.count() == 2 and kept.columns == runs.AUDIT
    got = {r.instrucao: r.linhas for r in runs.affected({"a": kept, "b": spark.range(3), "c": spark.range(0)}).collect()}
    assert got == {"a": 2, "b": 3, "c": 0, None: 5}


def test_metrics_of_a_source_that_found_nothing(spark):
    fetch = spark.createDataFrame([("s", 1, 200, 10, 5, None), ("s", 2, 503, 0, 5, "503")], "source_id string, ordem int, http_status int, bytes long, duracao_ms long, erro string")
    none = spark.createDataFrame([], "source_id string, ignorado boolean, com_data boolean, adiado boolean, nao_pdf boolean, mudado boolean")
    calls = spark.createDataFrame([], "source_id string, erro string, needs_review boolean, provas_falhadas int, tokens_cache_lidos long, custo_usd double")
    (r,) = runs.metrics(fetch, none, calls).collect()
    assert (r.http_status, r.bytes, r.erro, r.candidatos, r.chamadas_modelo, r.custo_usd, r.erros_extraccao) == (503, 10, "503", 0, 0, 0.0, []) and len(r) == 19


def test_alarms_are_raised_once(spark):
    summary = json.dumps({"fontes": [{"fonte": "b", "conflitos": ["x"]}, {"fonte": "a", "conflitos": ["y", "z"]}, {"fonte": "c"}]})
    table = spark.createDataFrame([("ok", at(1), "{}"), ("ok", at(2), summary), ("falhou", at(3), "{}"), ("ok", None, None)], "estado string, terminado_em timestamp, resumo string")
    raised = lambda *rows: spark.createDataFrame(list(rows), "tipo string, criado_em timestamp, resolvido_em timestamp")
    (r,) = runs.conflict_alarm(table, raised(("conflitos_de_identidade", at(1, 5), at(1, 6)), ("outro", at(9), None))).collect()
    assert (r.conflitos, r.mensagem) == (3, "a: y\na: z\nb: x")
    assert runs.conflict_alarm(table, raised(("conflitos_de_identidade", at(2), at(2)))).count() == 0 and runs.conflict_alarm(table.limit(1), raised()).count() == 0
    late = F.lit("2026-03-09 00:00:00").cast("timestamp")
    assert gate.watchdog(table, late, alarms=raised(("ingestao_parada", at(8), None))).count() == 0 and gate.watchdog(table, late, alarms=raised(("ingestao_parada", at(8), at(8)))).count() == 1


def test_extraction_is_validated_trimmed_and_checked(spark):
    fine = whole_extraction()
    claim = {"valor": "aberto", "confianca": "certa", "evidencia": "x" * 500}
    bad = whole_extraction(estado=claim, documentos=[{"titulo": "t", "url": "u", "tipo": "aviso"}] * 31)
    del bad["dotacao_esgotada"]
    rows = spark.createDataFrame([(0, json.dumps(fine)), (1, json.dumps(bad)), (2, "no json"), (3, None)], "i int, s string").withColumn("e", extraction.parse(F.col("s")))
    got = {r.i: r for r in rows.select("i", extraction.problems(F.col("e")).alias("p"), extraction.problems(F.col("e"), ["lua"], ["particular"]).alias("q"), extraction.trimmed(F.col("e"))["aparados"].alias("a")).collect()}
    assert got[0].p == [] and got[0].q == ["medidas.valor"] and got[0].a == []
    assert got[1].p == ["documentos", "dotacao_esgotada.confianca", "dotacao_esgotada.evidencia", "estado.confianca", "estado.evidencia"] and got[1].a == ["estado.evidencia"]
    assert "identificacao.titulo" in got[2].p and got[3].p == got[2].p
    claims = extraction.evidence(F.col("e"))
    assert [r[0] for r in rows.where("i = 0").select(F.explode(F.transform(claims, lambda c: c["caminho"]))).collect()] == records.EVIDENCE
    quotes = spark.createDataFrame([("O Prazo é 30", [("a", "alta", "prazo e 30"), ("b", "media", " "), ("c", "alta", "falso"), ("d", "alta", None)]), (None, [("a", "alta", "x")])], "d string, q array<struct<caminho:string,confianca:string,evidencia:string>>")
    first, second = extraction.verified(quotes, "q", "d").collect()
    assert (first.provas_falhadas, first.sem_prova, first.confianca_efectiva) == (["c"], ["b", "d"], {"a": "alta", "b": "media", "c": "baixa", "d": "alta"}) and second.provas_falhadas == ["a"]
    fund = extraction.fund(rows.where("i = 0")).collect()[0]
    assert str(fund.fecha_em) == "2026-09-30 22:59:59" and fund.abre_em_precisao == "desconhecida" and fund.medidas == ["sol"] and fund.entidade_gestora is None and fund.dotacao_esgotada is False and fund.detalhe_apoios[1].unidade == "por kWp"


def test_stored_funds_fail_closed(spark):
    row = records.stored_fund(spark.createDataFrame([("1", "talvez", None, "[]", "no json")], "id string, admite_particulares string, publicado boolean, detalhe_apoios string, documentos string"))
    (r,) = row.collect()
    assert (r.admite_particulares, r.publicado, r.needs_review, r.estado, r.confianca_global, r.documentos, r.medidas) == ("desconhecido", False, True, "desconhecido", "baixa", [], []) and row.columns == list(records.FUND)
    assert not set(records.OWNED) & set(records.fund_row(row).columns)
    changes = spark.createDataFrame([("s", at(1), "x"), ("s", at(2), "x"), ("s", at(3), None), ("s", at(4), None)], "g string, em timestamp, h string")
    assert [r.horas_sem_mudanca for r in records.hours_unchanged(changes, "g", "em", "h").orderBy("em").collect()] == [0, 24, 0, 24]


def test_conflicts_are_held_and_get_no_keys(spark):
    known = spark.createDataFrame([("url", "u1", 10), ("url", "u2", 20)], "tipo string, valor string, fund_id long")
    found = spark.createDataFrame([(1, "url", "u1", 70), (1, "titulo", "t1", 30), (2, "referencia", "r", 100), (3, "url", "u1", 70), (3, "url", "u2", 70), (3, "titulo", "t3", 30), (4, "titulo", "t1", 30)], "cand_id long, tipo string, valor string, forca int")
    rows = spark.createDataFrame([(i, f"T{i}", False, True, None) for i in range(1, 5)], "cand_id long, titulo string, needs_review boolean, alertavel boolean, motivo_revisao array<string>")
    funds, keys, conflicts = identity.persisted(rows, found, known)
    got = {r.cand_id: r for r in funds.collect()}
    assert (got[3].resultado, got[3].fund_id, got[3].needs_review, got[3].alertavel, got[3].motivo_revisao) == ("conflito", "10", True, False, ["conflito_identidade"])
    assert got[1].fund_id == "10" and got[1].alertavel and got[2].resultado == "novo" and len(got[2].fund_id) == 64
    assert sorted((r.tipo, r.valor, r.fund_id) for r in keys.collect()) == [("referencia", "r", got[2].fund_id), ("titulo", "t1", "10")]
    assert [r.conflito for r in conflicts.collect()] == ["T3: chaves apontam para 10, 20"]


def test_letters_and_dispatch(spark):
    found = spark.createDataFrame([(1, 7, 1, "abriu"), (1, 7, 2, "abriu"), (1, 8, 3, "abriu"), (2, 8, 3, "abriu")], "user_id long, fund_id long, event_id long, tipo string")
    funds = spark.createDataFrame([(7, "s7", "A & B", dt.datetime(2026, 9, 30, 22, 59)), (8, "s8", "C", None)], "fund_id long, slug string, titulo string, fecha_em timestamp")
    sent = matching.letters(found, funds, spark.createDataFrame([(1, "tok"), (2, "kot")], "user_id long, token string"), "https://x.pt")
    got = {r.user_id: r for r in sent.collect()}
    assert got[1].assunto == "Abriram 2 apoios a que se pode candidatar" and "A &amp; B</a> Candidaturas até 30/09/2026." in got[1].html and "- A & B\n  https://x.pt/apoios/s7\n" in got[1].texto and got[1].cancelar_url == "https://x.pt/cancelar/tok"
    assert got[2].assunto == "Abriu um apoio a que se pode candidatar" and "Sem prazo" in got[2].html
    box = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 3, 1)], "id long, user_id long, tentativas int")
    out = matching.dispatched(box, spark.createDataFrame([(1, "a@x.pt"), (2, None), (3, "c@x.pt")], "user_id long, email string"), sent)
    assert {r.id: (r.estado, r.ultimo_erro, r.tentativas) for r in out.collect()} == {1: ("a_enviar", None, 1), 2: ("falhou", "utilizador sem email", 1), 3: ("falhou", "nenhum apoio publicado entre os eventos", 2)}


def test_archive_scan_is_scoped(spark):
    body = (
        '<a href="/2026/01/02/sidebar-post/">A long sidebar title</a><article class="et post"><a href="/2026/01/03/x/"><img></a><h2 class="entry-title"><a href="/2026/01/03/x/">Aviso de apoio x</a></h2>'
        '<span class="published">Ago 10, 2026</span></article><article class="post"><a href="/2026/01/04/0/">Pages that follow</a></article><article class="other"><a href="/2026/01/05/y/">Not of the archive</a></article>'
    )
    found = pages.articles(spark.createDataFrame([("https://a.pt/l", body), ("https://a.pt/m", None)], "url string, html string"), "post", "entry-title", "published")
    assert [(r.texto, r.publicado) for r in found.orderBy("posicao").collect()] == [("Aviso de apoio x", "Ago 10, 2026"), ("Pages that follow", "")]
    got = pages.candidates(found, r"^/\d{4}/\d{2}/\d{2}/[^/]+/?$", refuse_names=r"^\d+$").select("titulo", pages.published(F.col("publicado")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("Aviso de apoio x", "Ago 10, 2026")]


def test_replay_honours_etags_and_entries(spark):
    manifest = spark.createDataFrame([("u1", "f1", "e1"), ("u2", "f2", "e2"), ("u3", "f1", None)], "url string, ficheiro string, etag string")
    bodies = spark.createDataFrame([("x/f1", bytearray(b"1")), ("x/f2", bytearray(b"2"))], "path string, content binary")
    got = files.replay(manifest, bodies, spark.createDataFrame([("u1", "e1"), ("u2", "old"), ("u3", None)], "url string, etag string"))
    assert {r.url: (r.estado, r.content and bytes(r.content)) for r in got.collect()} == {"u1": (304, None), "u2": (200, b"2"), "u3": (200, b"1")}
    config = spark.createDataFrame([("noticias", "https://a.pt/n", None), ("avisos-json", "https://a.pt/q", "POST")], "id string, url string, metodo string")
    assert sorted((r.id, r.metodo) for r in registry.entries(registry.sources(spark, True), config).collect()) == [("avisos-json", "POST"), ("noticias", "GET")]
    assert registry.source(spark, "noticias").count() == 1 and registry.source(spark, "none").count() == 0


def test_small_functions(spark):
    one = spark.range(1)
    cell = lambda c: one.select(c).collect()[0][0]
    assert cell(urls.canonical_json(F.lit('{"b": 1, "a": {"d": null, "c": [2, 1]}}'))) == cell(urls.canonical_json(F.lit('{"a":{"c":[2,1],"d":null},"b":1}'))) == '{"a":{"c":[2,1],"d":null},"b":1}' and cell(urls.canonical_json(F.lit("{"))) is None
    assert cell(urls.capture_name(F.lit("https://a.pt/x/apoios 2026.aspx?q=1"), F.lit(".html"))).startswith("apoios-2026-") and cell(urls.capture_name(F.lit("https://a.pt"), F.lit(".html"))).startswith("pagina-")
    assert [cell(dates.precision_label(F.lit(p))) for p in ("mes", "desconhecida", "dia")] == ["data aproximada", "por confirmar", None]
    assert cell(F.length(model_calls.error_line(F.lit(500), F.lit("x" * 900)))) == 500
    (r,) = model_calls.failed(one, F.lit("boom")).collect()
    assert (r.custo_usd, r.tokens_saida, r.resposta, r.erro) == (0.0, 0, None, "boom")
