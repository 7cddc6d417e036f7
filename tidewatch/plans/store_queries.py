"""Queries over what is written and read again: versions, inserts that return, claims, each with SQL for comparison."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F

from .. import tables
from ..operators import alerts, store, versions
from ..sources import captures
from . import views as v
from .catalogue_queries import _CAND

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@contextmanager
def _folder(spark, name: str) -> Iterator[str]:
    """A folder that goes when the query's rows are saved."""
    path = f"{tables.shared(spark)}/{name}-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        tables.deleted(spark, path)


def _kept(df: DataFrame, name: str) -> DataFrame:
    return tables.saved(df, name)


_FUND_VERSIONS = v.sql(v.FUNDS, """first_ as (select fund_id, slug, titulo, dotacao, timestamp '1998-01-01 00:00:00' p, timestamp '1998-01-01 00:00:00' u from funds where fund_id % 5 <> 0)""", body="""
  select 1::bigint versao, fund_id, slug, titulo, round(dotacao, 2) dotacao, strftime(p, '%Y-%m-%d') primeira, strftime(u, '%Y-%m-%d') actualizado from first_ union all
  select 2, f.fund_id, f.slug, case when f.fund_id % 3 = 0 or f.fund_id % 5 = 0 then 'novo ' || f.titulo else f.titulo end, round(case when f.fund_id % 3 = 0 or f.fund_id % 5 = 0 then f.dotacao + 1 else f.dotacao end, 2),
    case when f.fund_id % 5 = 0 then '1998-08-02' else '1998-01-01' end, case when f.fund_id % 3 = 0 or f.fund_id % 5 = 0 then '1998-08-02' else '1998-01-01' end from funds f""")  # fmt: skip


@query(_FUND_VERSIONS)
def fund_versions(spark, d):
    """Two versions of the store: the funds first seen, then an update of some and the rest as new; slugs are frozen."""
    k = F.col("fund_id")
    begun = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    stamps = ["visto_pela_primeira_vez", "visto_pela_ultima_vez", "actualizado_em"]
    all_ = v.funds(spark, d).select("fund_id", "slug", "titulo", "dotacao")
    with _folder(spark, "fundos") as root:
        versions.publish(all_.where(k % 5 != 0).withColumns({c: begun for c in stamps}), root)
        changed = all_.where((k % 3 == 0) | (k % 5 == 0)).select("fund_id", F.when(k % 5 == 0, F.col("slug")).otherwise("outra").alias("slug"), F.concat(F.lit("novo "), "titulo").alias("titulo"), (F.col("dotacao") + 1).alias("dotacao"))
        versions.publish(store.updated(versions.read(spark, root), changed, "fund_id", v.as_of()), root)
        both = [versions.read(spark, root, n).withColumn("versao", F.lit(n).cast("long")) for n in (1, 2)]
        day = lambda c: F.date_format(c, "yyyy-MM-dd")
        return _kept(both[0].unionByName(both[1]).select("versao", "fund_id", "slug", "titulo", F.round("dotacao", 2).alias("dotacao"), day(stamps[0]).alias("primeira"), day(stamps[2]).alias("actualizado")), "fund-versions")


_EARLY, _LATE = "2024-01-20 00:00:00", v.EVENTS_AS_OF


def _cand(name: str, now: str) -> str:
    """The candidates of an instant, without a ledger."""
    text = _CAND.replace(f"timestamp '{v.EVENTS_AS_OF}'", f"timestamp '{now}'").replace("cand as", f"{name} as materialized", 1)
    return text[: text.index("and not exists")] + ")"


_CHAIN = v.sql(v.FUNDS, v.FUND_MEASURES, v.PROFILES, v.SUBSCRIPTIONS, v.FUND_EVENTS, _cand("a", _EARLY), _cand("b", _LATE),
  "c as (select user_id, impressao, 0 lote, min_by(event_id, event_id) event_id, min_by(tipo, event_id) tipo, any_value(frequencia) frequencia from a group by 1, 2 union all select user_id, impressao, 1, min_by(event_id, event_id), min_by(tipo, event_id), any_value(frequencia) from b where not exists (select 1 from a where a.user_id = b.user_id and a.impressao = b.impressao) group by 1, 2)",
  body="""select lote::bigint lote, user_id, count(*) n, min(event_id) primeiro, max(event_id) ultimo, bool_or(tipo in ('dotacao_esgotada', 'prazo_alterado', 'fecha_em_breve')) urgente from c group by 1, 2""")


@query(_CHAIN)
def alert_chain(spark, d):
    """Two runs of the chain, the second one twice as after a crash: what each queued."""
    given = [f(spark, d) for f in (v.fund_events, v.funds, v.fund_measures, v.subscriptions, v.profiles)]
    with _folder(spark, "ledger") as ledger, _folder(spark, "box") as box:
        for batch, now in ((0, _EARLY), (1, _LATE), (1, _LATE)):
            alerts.run(*given, F.lit(now).cast("timestamp"), ledger, box, batch)
        told = alerts.of_groups(versions.read(spark, ledger)).groupBy("grupo").agg(F.count("*").alias("n"), F.min("event_id").alias("primeiro"), F.max("event_id").alias("ultimo"))
        return _kept(versions.read(spark, box).join(told, "grupo").select("lote", "user_id", "n", "primeiro", "ultimo", "urgente"), "alert-chain")


@query("""with b as (select event_id id, ts + to_minutes((event_id % 600)::int) em from events where event_id % 3 = 0), r as (select id, row_number() over (order by em, id) n from b where em <= timestamp '2024-01-20 00:00:00')
  select id, 'a' quem, 1::bigint vez from r where n <= 20 union all select id, 'b', 2 from r where n between 21 and 40 union all select id, 'c', 3 from r where n <= 20""")
def outbox_claims(spark, d):
    """Two dispatchers claim one after the other; a third comes when the first two's leases, of different lengths, are partly over."""
    e = F.col("event_id")
    box = v.table(spark, d, "events").select(e.alias("id"), (F.col("ts") + F.make_dt_interval(mins=(e % 600).cast("int"))).alias("agendado_para"), F.when(e % 3 == 0, "pendente").otherwise("enviado").alias("estado"))
    at = v.as_of("2024-01-20 00:00:00")
    with _folder(spark, "claims") as root:
        turns = [(at, "interval 5 minutes", "a"), (at, "interval 60 minutes", "b"), (at + F.expr("interval 10 minutes"), "interval 5 minutes", "c")]
        due = box.where(F.col("agendado_para") <= at)
        taken = [versions.claim(due, root, now, lease, who).select("id", "quem", F.lit(i).cast("long").alias("vez")) for i, (now, lease, who) in enumerate(turns, 1)]
        return _kept(taken[0].unionByName(taken[1]).unionByName(taken[2]), "outbox-claims")


@query("""select 'n' || (o_orderkey // 100) || '.json' ficheiro, o_orderkey::varchar codigo, 'Aviso ' || o_orderkey titulo, case when o_orderkey % 6 <> 0 then round(o_totalprice, 2) + 1 end dotacao, strftime(o_orderdate, '%Y-%m-%d') fecha, case when o_orderkey % 4 = 0 then 'a' || o_orderkey || '.pdf' end documento
  from orders where o_orderkey % 7 <> 0 and starts_with('n' || (o_orderkey // 100) || '.json', 'n1')""")
def capture_notices(spark, d):
    """Answers of a hundred notices each, captured, some refused; then those whose file name begins with n1 are read."""
    session, k = captures.registered(spark), F.col("o_orderkey")
    part = lambda v_: F.struct(v_.alias("dotacao"), F.lit("m").alias("marca"))
    paper = F.struct(F.lit("Aviso").alias("tipoDocumentoDesignacao"), F.concat(F.lit("a"), k.cast("string"), F.lit(".pdf")).alias("path"))
    notice = F.struct(
        F.struct(k.cast("string").alias("codigoAviso"), F.when(k % 7 != 0, F.concat(F.lit(" Aviso  "), k.cast("string"))).alias("designacaoPT")).alias("aviso"),
        F.when(k % 6 != 0, F.array(part(F.round("o_totalprice", 2)), part(F.lit(1.0)))).alias("estrutura"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T00:00:00'").alias("dataFim")).alias("calendario"), F.when(k % 4 == 0, F.array(paper)).alias("documentos"),
    )
    files = v.table(spark, d, "orders").groupBy(F.expr("o_orderkey div 100").cast("string").alias("n")).agg(F.to_json(F.struct(F.collect_list(notice).alias("avisos"))).alias("body"))
    good = files.select(F.concat(F.lit("https://x.pt/"), "n").alias("url"), F.concat(F.lit("n"), "n", F.lit(".json")).alias("ficheiro"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("etag"), F.encode("body", "UTF-8").alias("content"))
    bad = good.select("url", F.concat(F.lit("n1-"), "ficheiro").alias("ficheiro"), F.lit(503).alias("status"), "etag", "content")
    with _folder(spark, "captures") as root:
        good.unionByName(bad).write.format("notices").option("path", root).mode("append").save()
        rows = session.read.format("notices").option("path", root).option("kind", "json").load().where(F.col("ficheiro").startswith("n1"))
        return _kept(rows.select("ficheiro", "codigo", "titulo", "dotacao", F.date_format("fecha", "yyyy-MM-dd").alias("fecha"), "documento"), "capture-notices")
