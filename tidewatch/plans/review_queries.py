"""Queries over confidences, batches of model answers, pages of the catalogue, own preferences and updates from a join, each with SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import accounts, catalogue, gate, model_calls, store
from . import views as v
from .catalogue_queries import _DEFAULT, ORACLES as _CATALOGUE, QUERIES as _CATALOGUE_QUERIES
from .run_queries import whole_extraction

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_LEVEL = lambda n, m: f"['alta', 'media', 'baixa'][({n} // {m} % 3)::int + 1]"


@query(f"""select o_orderkey id, case when list_contains(l, 'baixa') then 'baixa' when list_contains(l, 'media') then 'media' else 'alta' end confianca_global
  from (select o_orderkey, case when o_orderkey % 10 = 0 then [] when o_orderkey % 10 < 4 then [{_LEVEL("o_orderkey", 1)}] else [{_LEVEL("o_orderkey", 1)}, {_LEVEL("o_orderkey", 3)}, {_LEVEL("o_orderkey", 9)}] end l from orders)""")
def global_confidence(spark, d):
    """Maps of none, one or three paths beside the one that doesn't count, whose confidence is low in every other row."""
    k = F.col("o_orderkey")
    level = lambda m: F.element_at(F.array(*map(F.lit, ("alta", "media", "baixa"))), (F.expr(f"o_orderkey div {m}") % 3 + 1).cast("int"))
    apart = F.create_map(F.lit("dotacao_esgotada"), F.when(k % 2 == 0, "baixa").otherwise("alta"))
    one = F.create_map(F.lit("estado"), level(1))
    more = F.create_map(F.lit("prazos.encerramento"), level(3), F.lit("medidas"), level(9))
    levels = F.when(k % 10 == 0, apart).when(k % 10 < 4, F.map_concat(apart, one)).otherwise(F.map_concat(apart, one, more))
    return v.table(spark, d, "orders").select(k.alias("id"), gate.overall(levels).alias("confianca_global"))


_ERRORS = "[null, 'recusa do modelo', 'resposta cortada', 'resposta vazia', 'resposta sem JSON', 'esquema: estado.valor', 'esquema: ambito.nivel, dotacao_esgotada.confianca', 'lote: overloaded_error — ' || event_type, 'lote: pedido cancelado', 'lote: pedido expirou sem resposta', 'lote: resultado de tipo desconhecido', 'lote: documento não está no lote']"


@query(f"""select event_id, {_ERRORS}[(event_id % 12)::int + 1] erro, case when event_id % 12 = 0 then 'Apoio ' || event_id end titulo, case when event_id % 12 < 7 then (event_id % 1000 * 5.0 + user_id * 25.0)::double else 0 end custo_milionesimos from events""")
def model_batch(spark, d):
    """One answer of each kind that a batch may hold, and documents that aren't in it."""
    e = F.col("event_id")
    good = json.dumps(whole_extraction(), ensure_ascii=False)
    reply = F.replace(F.lit(good), F.lit('"titulo": "Apoio"'), F.concat(F.lit('"titulo": "Apoio '), e.cast("string"), F.lit('"')))
    bad = good.replace('"aberto"', '"talvez"')
    worse = json.dumps(whole_extraction(ambito={"nivel": "lua", "municipios": [], "observacoes": ""}, dotacao_esgotada={"valor": None, "confianca": "certa", "evidencia": ""}), ensure_ascii=False)
    kind = lambda n, *values: F.element_at(F.array(*[F.lit(x) for x in values]), (n + 1).cast("int"))
    k = (e % 12).cast("int")
    rows = v.table(spark, d, "events").select(
        "event_id", kind(k, *["succeeded"] * 7, "errored", "canceled", "expired", "novo", None).alias("tipo"), F.when(k == 1, "refusal").when(k == 2, "max_tokens").otherwise("end_turn").alias("fim"),
        F.when(k == 3, " ").when(k == 4, "não sei").when(k == 5, bad).when(k == 6, worse).otherwise(reply).alias("resposta"), F.when(k == 7, "overloaded_error").alias("erro_tipo"), F.when(k == 7, F.col("event_type")).alias("erro_mensagem"),
        (e % 1000 * 2).alias("tokens_entrada"), (F.col("user_id") * 2).alias("tokens_saida"), F.lit(0).alias("tokens_cache_escritos"), F.lit(None).cast("long").alias("tokens_cache_lidos"),
    )
    out = model_calls.interpreted(rows, ["sol"], ["particular"])
    return out.select("event_id", "erro", F.col("e.identificacao.titulo").alias("titulo"), F.round(model_calls.batch_cost() * 1_000_000).alias("custo_milionesimos"))


@query("select event_id lote, case when event_id % 4 = 0 then 'terminado' when ts < timestamp '2024-01-20 10:00:00' then 'demorado' else 'a_processar' end estado from events where ts < timestamp '2024-01-20 12:00:00'")
def batch_states(spark, d):
    e = F.col("event_id")
    rows = v.table(spark, d, "events").where("ts < timestamp_ntz '2024-01-20 12:00:00'").select(e.alias("lote"), F.when(e % 4 == 0, "ended").when(e % 4 == 1, "canceling").when(e % 4 == 2, "in_progress").alias("processing_status"), F.col("ts").alias("criado_em"))
    return model_calls.batch_states(rows, v.as_of("2024-01-20 12:00:00")).select("lote", "estado")


@query(v.sql(v.FUNDS, body=f"""select row_number() over (order by case estado when 'aberto' then 0 else 1 end, fecha_em, fund_id) lugar, fund_id, titulo, count(*) over () total from funds where {_DEFAULT}"""))
def catalogue_page(spark, d):
    return catalogue.page(v.funds(spark, d), catalogue.Filters()).select("lugar", "fund_id", "titulo", "total")


@query(v.sql(v.PROFILES, v.SUBSCRIPTIONS, body="""select user_id, array_to_string(list_sort(tipos), ',') tipos, frequencia, coalesce((select string_agg(distinct medida, ',' order by medida) from subscriptions s where s.user_id = p.user_id and activa), '') medidas from profiles p where user_id = 42"""))
def own_preferences(spark, d):
    out = accounts.preferences(v.profiles(spark, d), v.subscriptions(spark, d), F.lit(42))
    return out.select("user_id", F.array_join(F.array_sort("tipos"), ",").alias("tipos"), "frequencia", F.array_join("medidas", ",").alias("medidas"))


@query("""select event_id id, case when event_id % 5 < 2 and event_id % 3 <> 1 then (case when event_id % 5 = 0 then 'enviado' else 'falhou' end) else 'a_enviar' end estado, case when event_id % 5 < 2 and event_id % 3 <> 1 then event_id % 6 + 1 else event_id % 6 end tentativas from events""")
def outbox_update_from(spark, d):
    """Messages in flight after the answers that came, of which some are for messages that were sent already."""
    e = F.col("event_id")
    box = v.table(spark, d, "events").select(e.alias("id"), F.lit("a_enviar").alias("estado"), (e % 6).alias("tentativas"))
    answers = box.where("id % 5 < 2").select("id", F.when(F.col("id") % 5 == 0, 200).otherwise(400).alias("codigo"), (F.col("id") % 3 != 1).alias("vale"))
    changes = {"estado": F.when(F.col("s_codigo") < 300, "enviado").otherwise("falhou"), "tentativas": F.col("tentativas") + 1}
    return store.update_from(box, answers, ["id"], changes, F.col("s_vale"))


@query("select o_orderkey, case when q between 1 and 3 then q * 4 - 3 end::int primeiro, case when q between 1 and 3 then q * 4 end::int ultimo from (select o_orderkey, nullif(o_orderkey % 6, 5) - 1 q from orders)")
def four_month_periods(spark, d):
    """Periods of four months, of which there are three: those below, above and null have no months."""
    months = dates.quarter_months(F.nullif(F.col("o_orderkey") % 6, F.lit(5)) - 1)
    return v.table(spark, d, "orders").select("o_orderkey", months["first"].alias("primeiro"), months["last"].alias("ultimo"))


_DIFF = _CATALOGUE["diff_events"]


@query(f"""with d as ({_DIFF}), p as (select *, 0 i from d where fund_id % 3 = 0 union all select *, 1 from d where fund_id % 2 = 0 union all select *, 2 from d where fund_id % 7 <> 0)
  select impressao, fund_id, tipo, definidor, alerta, ['dataset', 'folha', 'modelo'][min(i) + 1] caminho from p group by impressao, fund_id, tipo, definidor, alerta""")
def events_of_all_paths(spark, d):
    """The events that a dataset, a sheet and the model's answers tell of, where these overlap."""
    rows = _CATALOGUE_QUERIES["diff_events"](spark, d)
    k = F.col("fund_id")
    return gate.gathered({"dataset": rows.where(k % 3 == 0), "folha": rows.where(k % 2 == 0), "modelo": rows.where(k % 7 != 0)})
