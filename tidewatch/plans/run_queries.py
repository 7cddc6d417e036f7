"""Queries over runs, whole extractions, stored funds, identities that are written and messages handed over, each with SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import extraction, gate, identity, matching, records, runs
from . import views as v
from .scalar_queries import _GATE, _KEYS, _comparable, _docs, _extractions

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("select event_id, exists (select 1 from events b where b.event_id % 4 = 0 and b.user_id = a.user_id and b.event_id % 5 = a.event_id % 5) processado from events a")
def processed_marks(spark, d):
    e = F.col("event_id")
    rows = v.table(spark, d, "events").select(e, F.col("user_id").cast("string").alias("url"), (e % 5).cast("string").alias("hash"), F.lit(False).alias("processado"))
    return runs.processed(rows, rows.where("event_id % 4 = 0")).select("event_id", "processado")


@query(_GATE + """ select count(*) lidos, count(*) filter (p is not null and (p is distinct from sp or a is distinct from sa)) alterados, count(*) filter (p and not sp) publicados_agora,
  count(*) filter (not p and sp) despublicados_agora, count(*) filter (p is null) ilegiveis
  from (select case when id % 37 <> 0 then not (estrito and not historia) end p, len(m) = 0 and not estrito a, id % 10 <> 0 sp, id % 3 <> 0 sa from y)""")
def redecision_report(spark, d):
    k = F.col("o_orderkey")
    stored = v.table(spark, d, "orders").select(k.alias("id"), (k % 10 != 0).alias("publicado"), (k % 3 != 0).alias("alertavel"))
    decided = gate.decide(_extractions(spark, d), v.as_of()).withColumn("publicado", F.when(F.col("id") % 37 != 0, F.col("publicado")))
    return runs.redecision(stored, decided, "id")


@query(f"""select doc_id, item_id, concat_ws(',', case when not a then 'estado' end, case when not b then 'prazos.encerramento' end) falhadas, 'medidas' sem, case when a then 'alta' else 'baixa' end confianca
  from (select doc_id, item_id, coalesce(contains({_comparable("d.text")}, {_comparable("b.text")}), false) a, coalesce(contains({_comparable("d.text")}, 'inventado ' || item_id), false) b from documents d join benchmark b on b.item_id = d.doc_id % 40 where trim(b.text) <> '')""")
def evidence_partition(spark, d):
    items = v.table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote")).where("trim(quote) <> ''")
    rows = _docs(spark, d).join(items, F.col("doc_id") % 40 == F.col("item_id"))
    claim = lambda path, sure, quote: F.struct(F.lit(path).alias("caminho"), F.lit(sure).alias("confianca"), quote.alias("evidencia"))
    rows = rows.withColumn("claims", F.array(claim("estado", "alta", F.col("quote")), claim("medidas", "media", F.lit(" ")), claim("prazos.encerramento", "alta", F.concat(F.lit("Inventado "), F.col("item_id").cast("string")))))
    out = extraction.verified(rows, "claims", "text")
    return out.select("doc_id", "item_id", F.array_join("provas_falhadas", ",").alias("falhadas"), F.array_join("sem_prova", ",").alias("sem"), F.col("confianca_efectiva")["estado"].alias("confianca"))


def _persisted(spark, d):
    k = F.col("o_orderkey")
    key = lambda t, val, f: F.struct(F.lit(t).alias("tipo"), val.alias("valor"), F.lit(f).alias("forca"))
    orders = v.table(spark, d, "orders")
    found = orders.select(k.alias("cand_id"), F.explode(F.array(
        key("referencia", F.concat(F.lit("r"), F.col("o_custkey").cast("string")), 100), key("url", F.concat(F.lit("u"), (k % 4001).cast("string")), 70), key("titulo", F.concat(F.lit("t"), (k % 97).cast("string")), 30),
    )).alias("c")).select("cand_id", "c.*")
    known = found.where("cand_id % 5 = 0").groupBy("tipo", "valor").agg(F.min("cand_id").alias("fund_id"))
    rows = orders.where("o_orderkey % 5 <> 0").select(k.alias("cand_id"), F.concat(F.lit("T"), k.cast("string")).alias("titulo"), (k % 4 == 0).alias("needs_review"), (k % 3 != 0).alias("alertavel"), F.when(k % 4 == 0, F.array(F.lit("ocr_ma"))).alias("motivo_revisao"))
    return identity.persisted(rows, found.where("cand_id % 5 <> 0"), known)


_OUTCOMES = f"""k as {_KEYS}, known as (select tipo, valor, min(cand_id) fund_id from k where cand_id % 5 = 0 group by all), c as (select * from k where cand_id % 5 <> 0),
  j as (select c.*, fund_id from c left join known using (tipo, valor)),
  a as (select cand_id, count(distinct fund_id) n, max_by(fund_id, forca::bigint * 100000000 - fund_id) filter (fund_id is not null) f, max(valor) filter (tipo = 'referencia') r from j group by 1),
  o as (select *, case when n = 0 then sha256('referencia:' || r) else f::varchar end id from a)"""


@query(f"""with {_OUTCOMES} select cand_id, id fund_id, case when n = 0 then 'novo' when n > 1 then 'conflito' else 'existente' end resultado, n > 1 or cand_id % 4 = 0 needs_review, n <= 1 and cand_id % 3 <> 0 alertavel,
  concat_ws(',', case when cand_id % 4 = 0 then 'ocr_ma' end, case when n > 1 then 'conflito_identidade' end) motivos from o""")
def identity_persist(spark, d):
    return _persisted(spark, d)[0].select("cand_id", "fund_id", "resultado", "needs_review", "alertavel", F.coalesce(F.array_join("motivo_revisao", ","), F.lit("")).alias("motivos"))


@query(f"with {_OUTCOMES} select tipo, valor, min_by(id, cand_id) fund_id, min_by(forca, cand_id) forca from j join o using (cand_id) where j.fund_id is null and n <= 1 group by all")
def identity_new_keys(spark, d):
    return _persisted(spark, d)[1]


@query(f"""with {_OUTCOMES} select cand_id, 'T' || cand_id || ': chaves apontam para ' || string_agg(distinct j.fund_id::varchar, ', ' order by j.fund_id::varchar) conflito from j join o using (cand_id) where n > 1 and j.fund_id is not null group by cand_id""")
def identity_conflicts(spark, d):
    return _persisted(spark, d)[2]


_IN_ORDER = """with recursive k as (select o_orderkey cand_id, o_custkey cust, unnest([{'v': 'r' || o_custkey || '-' || o_orderkey % 3, 'w': 100}, {'v': 'u' || o_custkey || '-' || o_orderkey % 7, 'w': 70}, {'v': 't' || o_custkey || '-' || o_orderkey % 2, 'w': 30}]) x from orders),
  known as (select cust, x.v v, any_value(x.w) w, min(cand_id)::varchar f from k where cand_id % 5 = 0 group by 1, 2),
  c as materialized (select cand_id, cust, list(x order by x.w desc) ks, row_number() over (partition by cust order by cand_id) n from k where cand_id % 5 <> 0 group by 1, 2),
  s as (select cust, 0::bigint n, (select coalesce(list({'v': v, 'w': w, 'f': f}), []) from known where known.cust = o.cust) st, null::bigint cand_id, ''::varchar resultado, ''::varchar fund_id, 0::bigint chaves_novas, ''::varchar nomeados from (select distinct cust from c) o
    union all
    select cust, n, case when len(funds) > 1 then st else st || list_transform(lacking, lambda x: {'v': x.v, 'w': x.w, 'f': fund}) end, cand_id, case len(funds) when 0 then 'novo' when 1 then 'existente' else 'conflito' end, fund, len(lacking)::bigint, array_to_string(funds, ',')
    from (select *, case when len(found) > 0 then list_sort(list_transform(found, lambda x: {'w': -x.w, 'f': x.f}))[1].f else sha256('referencia:' || ks[1].v) end fund, list_sort(list_distinct(list_transform(found, lambda x: x.f))) funds
      from (select s.cust, c.n, s.st, c.cand_id, c.ks, list_filter(s.st, lambda x: list_contains(list_transform(c.ks, lambda y: y.v), x.v)) found, list_filter(c.ks, lambda y: not list_contains(list_transform(s.st, lambda x: x.v), y.v)) lacking
        from s join c on c.cust = s.cust and c.n = s.n + 1)))"""


@query(_IN_ORDER + " select cand_id, resultado, fund_id, chaves_novas, nomeados from s where cand_id is not null")
def identity_batch(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    key = lambda kind, n, w: F.struct(F.lit(kind).alias("tipo"), F.concat(F.lit(kind[0]), c, F.lit("-"), (k % n).cast("string")).alias("valor"), F.lit(w).alias("forca"))
    rows = v.table(spark, d, "orders").select(k.alias("cand_id"), F.explode(F.array(key("referencia", 3, 100), key("url", 7, 70), key("titulo", 2, 30))).alias("x")).select("cand_id", "x.*")
    known = rows.where("cand_id % 5 = 0").groupBy("tipo", "valor").agg(F.min("cand_id").alias("fund_id"))
    found, _ = identity.resolve_batch(rows.where("cand_id % 5 <> 0"), known)
    return found.withColumn("nomeados", F.array_join("nomeados", ","))


@query("""select event_id id, user_id, case when user_id % 6 = 0 or user_id % 5 = 0 then 'falhou' else 'a_enviar' end estado, case when user_id % 6 = 0 then 'utilizador sem email' when user_id % 5 = 0 then 'nenhum apoio publicado entre os eventos' end ultimo_erro, event_id % 3 + 1 tentativas from events""")
def dispatch_outcome(spark, d):
    rows = v.table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 3).alias("tentativas"))
    users = rows.select("user_id").distinct()
    people = users.select("user_id", F.when(F.col("user_id") % 6 != 0, "a@x.pt").alias("email"))
    return matching.dispatched(rows, people, users.where("user_id % 5 <> 0"))


@query("""select event_type source_id, 200 + max(event_id) % 2 http_status, sum(event_id % 1000)::bigint bytes, count(*) candidatos, count(*) filter (event_id % 3 = 0) candidatos_ignorados, count(*) filter (event_id % 2 = 0) candidatos_com_data, count(*) filter (event_id % 5 = 0) documentos_mudados,
  count(*) filter (event_id % 7 <> 0 and event_id % 4 <> 0) extraccoes_ok, count(*) filter (event_id % 7 <> 0 and event_id % 4 = 0) extraccoes_revisao, count(*) filter (event_id % 7 = 0) extraccoes_falhadas, 'falhou' erros, sum(event_id % 2)::bigint provas_falhadas, sum(event_id % 8)::double / 8 custo_usd from events group by 1""")
def source_metrics(spark, d):
    e = F.col("event_id")
    rows = v.table(spark, d, "events").select(F.col("event_type").alias("source_id"), e)
    fetches = rows.select("source_id", e.alias("ordem"), (200 + e % 2).alias("http_status"), (e % 1000).alias("bytes"), F.lit(1).alias("duracao_ms"), F.lit(None).cast("string").alias("erro"))
    found = rows.select("source_id", (e % 3 == 0).alias("ignorado"), (e % 2 == 0).alias("com_data"), F.lit(False).alias("adiado"), F.lit(False).alias("nao_pdf"), (e % 5 == 0).alias("mudado"))
    calls = rows.select("source_id", F.when(e % 7 == 0, F.concat(F.lit("falhou, request_id="), e.cast("string"))).alias("erro"), (e % 4 == 0).alias("needs_review"), (e % 2).alias("provas_falhadas"), F.lit(0).alias("tokens_cache_lidos"), ((e % 8) / 8).alias("custo_usd"))
    names = ["source_id", "http_status", "bytes", "candidatos", "candidatos_ignorados", "candidatos_com_data", "documentos_mudados", "extraccoes_ok", "extraccoes_revisao", "extraccoes_falhadas", "provas_falhadas", "custo_usd"]
    return runs.metrics(fetches, found, calls).select(*names, F.array_join("erros_extraccao", ",").alias("erros"))


@query("""select event_id, '{"a":{"c":"x","d":[1,2]},"b":' || event_id || '}' j from events""")
def canonical_json(spark, d):
    return v.table(spark, d, "events").select("event_id", urls.canonical_json(F.format_string('{"b": %d, "a": {"d": [1, 2], "c": "x"}}', "event_id")).alias("j"))


@query(v.sql(v.FUNDS, body="""select titulo, case when estado = 'previsto' then 'desconhecido' else estado end estado, case when fund_id % 7 = 0 then 'desconhecido' else admite end admite_particulares, true needs_review, 'baixa' confianca_global,
  '[{"titulo":"d' || fund_id || '","url":"u","tipo":"aviso"}]' documentos, len(beneficiarios) beneficiarios, 30 colunas from funds"""))
def fund_round_trip(spark, d):
    k = F.col("fund_id")
    rows = v.funds(spark, d).select(
        k.cast("string").alias("id"), "slug", "titulo", F.nullif("estado", F.lit("previsto")).alias("estado"), F.when(k % 7 == 0, "talvez").otherwise(F.col("admite")).alias("admite_particulares"), "beneficiarios",
        F.format_string('[{"titulo": "d%d", "url": "u", "tipo": "aviso"}]', k).alias("documentos"),
    )
    out = records.fund_row(records.stored_fund(rows))
    return out.select("titulo", "estado", "admite_particulares", "needs_review", "confianca_global", "documentos", F.size("beneficiarios").cast("long").alias("beneficiarios"), F.lit(len(out.columns)).alias("colunas"))


def whole_extraction(**changes) -> dict:
    """An extraction with all its fields, as a model returns it."""
    claim = lambda value: {"valor": value, "confianca": "alta", "evidencia": ""}
    day = lambda text: {"texto_fonte": text, "data_iso": "", "precisao": "dia"}
    return {
        "schema_version": "1", "identificacao": {"titulo": "Apoio", "referencia_legal": claim("Aviso n.º 3/2026"), "programa_pai": "", "entidade_gestora": " ", "resumo_pt": "r"}, "estado": claim("aberto"), "dotacao_esgotada": claim(None),
        "prazos": {"abertura": claim(day("")), "encerramento": claim(day("30 de setembro de 2026"))}, "beneficiarios": {"tipos": claim(["particular"]), "admite_particulares": claim("sim"), "restricoes_texto": ""},
        "ambito": {"nivel": "nacional", "municipios": [], "observacoes": ""}, "medidas": claim([{"medida": "sol", "percentagem_apoio": 85, "valor_max_eur": 10, "unidade": ""}, {"medida": "sol", "percentagem_apoio": None, "valor_max_eur": 30, "unidade": "por kWp"}]),
        "medidas_nao_classificadas": [], "dotacao": {"total_texto": "1,5 milhões de euros", "total_eur": None, "apoio_max_por_beneficiario_eur": None}, "candidatura": {"url": "", "plataforma": ""}, "documentos": [], "avisos_importantes": [],
        "auto_avaliacao": {"documento_e_aviso_de_apoio": True, "qualidade_ocr": "boa", "notas": ""},
    } | changes


@query("""select o_orderkey id, case when o_orderkey % 9 = 0 then 'estado.valor' else '' end problemas, case when o_orderkey % 8 = 0 then 'identificacao.resumo_pt' else '' end aparados, case when o_orderkey % 8 = 0 then 600 else 1 end resumo, 'AVISO 03/2026' referencia_legal,
  floor(epoch(timezone('Europe/Lisbon', timestamp '2026-09-30 23:59:59')))::bigint fecha, 'sol' medidas, 1500000::double dotacao, 30::double maximo, entidade from orders left join (select null::varchar entidade) on true""")
def extraction_whole(spark, d):
    k = F.col("o_orderkey")
    reply = F.lit(json.dumps(whole_extraction(), ensure_ascii=False))
    reply = F.when(k % 9 == 0, F.replace(reply, F.lit('"aberto"'), F.lit('"talvez"'))).otherwise(reply)
    reply = F.when(k % 8 == 0, F.replace(reply, F.lit('"resumo_pt": "r"'), F.lit(f'"resumo_pt": "{"r" * 700}"'))).otherwise(reply)
    rows = v.table(spark, d, "orders").select(k.alias("id"), extraction.parse(F.concat(F.lit("```json\n"), reply)).alias("e")).select("id", extraction.trimmed(F.col("e")).alias("t")).select("id", "t.*")
    out = extraction.fund(rows.withColumn("problemas", F.array_join(extraction.problems(F.col("e"), ["sol"], ["particular"]), ",")))
    return out.select("id", "problemas", F.array_join("aparados", ",").alias("aparados"), F.length("resumo").alias("resumo"), "referencia_legal", F.unix_timestamp("fecha_em").alias("fecha"), F.array_join("medidas", ",").alias("medidas"), F.col("dotacao_total_eur").alias("dotacao"), F.col("apoio_max_eur").alias("maximo"), F.col("entidade_gestora").alias("entidade"))


@query("""with c as (select event_type fonte, 'u' || user_id || '-' || event_id c from events where event_id % 50 = 0 and strftime(ts, '%Y-%m-%d') = (select max(strftime(ts, '%Y-%m-%d')) from events))
  select 'conflitos_de_identidade' tipo, count(*) conflitos, string_agg(fonte || ': ' || c, chr(10) order by fonte, c) mensagem from c having count(*) > 0""")
def last_run_conflicts(spark, d):
    """A run a day, whose summary names its sources and their conflicts; the alarm of the last one, older ones having been told."""
    rows = v.table(spark, d, "events").withColumn("dia", F.date_format("ts", "yyyy-MM-dd"))
    told = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_id").cast("string")))
    sources = rows.groupBy("dia", F.col("event_type").alias("fonte")).agg(F.max("ts").alias("fim"), F.array_sort(F.collect_list(told)).alias("conflitos"))
    table = sources.groupBy("dia").agg(F.max("fim").alias("terminado_em"), F.to_json(F.struct(F.collect_list(F.struct("fonte", "conflitos")).alias("fontes"))).alias("resumo")).withColumn("estado", F.lit("ok"))
    alarms = table.select(F.lit("conflitos_de_identidade").alias("tipo"), (F.col("terminado_em") - F.expr("interval 1 day")).alias("criado_em"))
    return runs.conflict_alarm(table, alarms)
