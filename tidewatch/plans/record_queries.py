"""Queries over records, model calls, accounts and run histories, each with SQL for comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts, model_calls, records
from ..sources import pages
from . import views as v

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(v.sql(v.FUNDS, body="select fund_id, case when fund_id % 7 = 0 then 'desconhecido' else admite end admite, case when fund_id % 11 = 0 then true else needs_review end needs_review, case when fund_id % 13 = 0 then false else alertavel end alertavel from funds"))
def record_fail_closed(spark, d):
    k = F.col("fund_id")
    rows = v.funds(spark, d).withColumns({"admite": F.when(k % 7 == 0, "talvez").otherwise(F.col("admite")), "needs_review": F.when(k % 11 != 0, F.col("needs_review")), "alertavel": F.when(k % 13 != 0, F.col("alertavel"))})
    return records.read_closed(rows).select("fund_id", "admite", "needs_review", "alertavel")


@query("""select o_orderkey id, o_orderkey % 9 <> 0 valida, case when o_orderkey % 9 <> 0 then 'Apoio ' || o_orderkey end titulo, case when o_orderkey % 9 <> 0 then 'AVISO ' || lpad((o_orderkey % 90)::varchar, 2, '0') || '/2026' end referencia,
  case when o_orderkey % 9 <> 0 then floor(epoch(timezone('Europe/Lisbon', date_trunc('day', o_orderdate) + interval '23:59:59')))::bigint end fecha, case when o_orderkey % 9 <> 0 then 'luz,sol' end medidas, case when o_orderkey % 9 <> 0 then (o_orderkey % 5000)::double + 1 end maximo from orders""")
def extraction_to_fund(spark, d):
    k = F.col("o_orderkey")
    s = F.when(k % 9 == 0, "no json").otherwise(F.format_string(
        '```json {"e_aviso":true,"titulo":"Apoio  %d","referencia":"Aviso n.º %d/2026","estado":{"valor":"aberto","confianca":"alta","evidencia":"x"},"encerramento":{"data_iso":"%s","texto":"","confianca":"alta","evidencia":""},"admite":{"valor":"sim","confianca":"alta","evidencia":""},"medidas":[{"medida":"sol","valor_max_eur":%d},{"medida":"luz","valor_max_eur":%d},{"medida":"sol"}]} ```',
        k, k % 90, F.date_format("o_orderdate", "yyyy-MM-dd"), k % 5000, k % 5000 + 1,
    ))
    rows = v.table(spark, d, "orders").select(k.alias("id"), records.parse_extraction(s).alias("e"))
    out = records.fund_of_extraction(rows)
    return out.select("id", F.col("e").isNotNull().alias("valida"), "titulo", F.col("referencia_legal").alias("referencia"), F.unix_timestamp("fecha_em").alias("fecha"), F.array_join("medidas", ",").alias("medidas"), F.col("apoio_max_eur").alias("maximo"))


@query("""select o_orderkey::varchar codigo, 'Plano ' || o_orderkey titulo, 'previsto' estado, floor(epoch(timezone('Europe/Lisbon', date '1899-12-30' + (o_orderkey % 15000 + 30000)::int + interval '23:59:59')))::bigint fecha,
  case when o_orderkey % 2 = 0 then 'entidade_publica,municipio' else 'empresa' end quem, 'Norte,Centro' regioes, 'P. F' resumo from orders""")
def plan_to_fund(spark, d):
    k = F.col("o_orderkey")
    values = F.create_map(*[x for p in (("ID", k.cast("string")), ("Designacao do Aviso", F.concat(F.lit(" Plano  "), k.cast("string"))), ("Programa", F.lit("P")), ("Fundo", F.lit("F")), ("Data Fim Prevista", (k % 15000 + 30000).cast("string")), ("NUTS II", F.lit("Norte | Centro")), ("Tipo Ent. Beneficiária", F.when(k % 2 == 0, "Pública").otherwise("Privada"))) for x in (F.lit(p[0]), p[1])])
    out = records.fund_of_plan(v.table(spark, d, "orders").select(values.alias("valores")))
    return out.select("codigo", "titulo", "estado", F.unix_timestamp("fecha_em").alias("fecha"), F.array_join("beneficiarios", ",").alias("quem"), F.array_join("regioes", ",").alias("regioes"), "resumo")


@query("""with t as (select event_id, user_id, 'doc ' || user_id % 50 doc from events) select event_id, case when user_id % 50 >= 40 then 'sem_registo' when user_id % 50 % 4 = 0 then 'recusa' when user_id % 50 % 4 = 1 then 'cortada' else 'ok' end resultado,
  substr(sha256('m|p1|s3|' || sha256(doc)), 1, 32) chave from t""")
def model_replay(spark, d):
    docs = v.table(spark, d, "events").select("event_id", F.concat(F.lit("doc "), (F.col("user_id") % 50).cast("string")).alias("text"))
    n = F.regexp_extract("text", r"(\d+)", 1).cast("int")
    recorded = model_calls.requests(docs, "m", "p1", "s3").where(n < 40).select("chave", F.lit("{}").alias("resposta"), F.when(n % 4 == 0, "refusal").when(n % 4 == 1, "max_tokens").otherwise("end").alias("fim"))
    return model_calls.answered(docs, recorded, "m", "p1", "s3").select("event_id", "resultado", "chave")


@query("select distinct 'falhou ' || event_type erro from events")
def error_summary(spark, d):
    rows = v.table(spark, d, "events").select(F.concat(F.lit("falhou "), "event_type", F.lit(", request_id="), F.col("event_id").cast("string")).alias("erro"))
    return model_calls.unseen_errors(rows)


@query(v.sql(v.SUBSCRIPTIONS, body="""select user_id, medida, case when user_id % 3 = 0 then medida = 'PROMO' else activa end activa from subscriptions
  union all select c_custkey, 'PROMO', true from customer where c_custkey % 3 = 0 and not exists (select 1 from subscriptions where user_id = c_custkey and medida = 'PROMO')"""))
def preferences_update(spark, d):
    wanted = v.profiles(spark, d).where("user_id % 3 = 0").select("user_id", accounts.known_measures(F.array(F.lit("PROMO"), F.lit("invented")), ["PROMO", "ECONOMY"]).alias("medidas"))
    return accounts.subscriptions_after(v.subscriptions(spark, d), wanted)


@query("select c_custkey, case when c_custkey % 2 = 0 then 'a@x.pt' else '' end aceites from customer")
def recipient_allow_list(spark, d):
    to = F.array(F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" <A@x.pt>"))).otherwise("z@x.pt"), F.lit("other@y.pt"))
    return v.table(spark, d, "customer").select("c_custkey", F.array_join(accounts.allowed_recipients(to, ["a@x.pt", "b@x.pt"]), ",").alias("aceites"))


@query("""with r as (select event_type, strftime(ts, '%Y-%m-%d') dia, count(*) n, min(event_id) % 3 = 0 erro from events group by all),
  w as (select *, median(n) over (partition by event_type order by dia rows between 7 preceding and 1 preceding) base, coalesce(sum(case when erro then 0 else 1 end) over (partition by event_type order by dia rows between unbounded preceding and 1 preceding), 0) g from r)
  select event_type, dia, coalesce(base, 0)::double base, coalesce(sum(case when erro then 1 else 0 end) over (partition by event_type, g order by dia rows between unbounded preceding and 1 preceding), 0)::bigint falhas_antes from w""")
def trailing_history(spark, d):
    runs = v.table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("dia")).agg(F.count("*").alias("candidatos"), F.when(F.min("event_id") % 3 == 0, "x").alias("erro"))
    return records.history(runs, "event_type", "dia").select("event_type", "dia", "base", "falhas_antes")


@query(r"""select page_id, count(*) n, sum(length(href))::bigint tamanho from (select page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) href from pages) group by 1""")
def page_links(spark, d):
    rows = v.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    return pages.links(rows).groupBy(F.col("url").cast("long").alias("page_id")).agg(F.count("*").alias("n"), F.sum(F.length("href")).alias("tamanho"))


@query(v.sql(v.FUNDS, body=f"select fund_id, d between 0 and 14 urgente from (select fund_id, floor((epoch_us(fecha_em) - epoch_us(timestamp '{v.AS_OF}')) / 86400000000) d from funds)"))
def urgent_cards(spark, d):
    from ..functions import dates

    return v.funds(spark, d).select("fund_id", dates.days_until(F.col("fecha_em"), v.as_of()).between(0, 14).alias("urgente"))


@query("""select event_type, count(*) lidos, count(*) filter (event_id % 5 = 0) mudados, count(*) filter (event_id % 5 = 0 and event_id % 2 = 0) publicados, round(sum(value), 2) custo from events group by 1""")
def run_metrics(spark, d):
    e = F.col("event_id")
    return v.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("lidos"), F.count_if(e % 5 == 0).alias("mudados"), F.count_if((e % 5 == 0) & (e % 2 == 0)).alias("publicados"), F.round(F.sum("value"), 2).alias("custo"))


@query("""select l_orderkey, nullif(round(sum(l_extendedprice), 2), 0) dotacao, string_agg(distinct l_returnflag, ',' order by l_returnflag) marcas from lineitem group by 1""")
def notice_budget(spark, d):
    rows = v.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"), F.array_sort(F.collect_set("l_returnflag")).alias("m"))
    return rows.select("l_orderkey", F.nullif(F.round("s", 2), F.lit(0.0)).alias("dotacao"), F.array_join("m", ",").alias("marcas"))
