"""Queries in the text of SQL over registered functions, keyed hashes, collation and the dates of listings, each with SQL for comparison."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from ..functions import keyed, money, registered
from ..operators import accounts, catalogue
from ..sources import pages
from . import scalar_queries, views as v
from .record_queries import ORACLES as _RECORDS

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _view(spark, d: str, name: str) -> None:
    v.table(spark, d, name).createOrReplaceTempView(name)


@query(scalar_queries.ORACLES["canonical_url"])
def sql_canonical_url(spark, d):
    session = registered.registered(spark.newSession())
    _view(session, d, "pages")
    return session.sql("select page_id, tw_canonical_url(url || case when contains(url, '#') then '' when contains(url, '?') then '&utm_source=x&fbclid=1' else '?utm_source=x' end) u from pages")


@query("""select o_orderkey, floor(epoch(timezone('Europe/Lisbon', date_trunc('day', o_orderdate) + interval '23:59:59')))::bigint fecha, 'dia' precisao, (o_orderkey % 900 + 1) * 1000::decimal(18, 2) valor, 'AVISO ' || lpad((o_orderkey % 90)::varchar, 2, '0') || '/2026' referencia from orders""")
def sql_notice_fields(spark, d):
    """The fields of a notice's text by functions of their names in SQL."""
    session = registered.registered(spark.newSession())
    _view(session, d, "orders")
    return session.sql("""with t as (select o_orderkey, date_format(o_orderdate, 'dd/MM/yyyy') dia, (o_orderkey % 900 + 1) || ' mil euros' montante, 'Aviso n.º ' || o_orderkey % 90 || '/2026' titulo from orders)
      select o_orderkey, unix_timestamp(tw_closing(dia).at) fecha, tw_closing(dia).precisao precisao, tw_amount(montante) valor, tw_legal_reference(titulo) referencia from t""")


@query(_RECORDS["page_links"])
def sql_listing_links(spark, d):
    session = registered.registered(spark.newSession())
    _view(session, d, "pages")
    return session.sql("select page_id, count(*) n, sum(length(href)) tamanho from pages, lateral listing_links(html) group by page_id")


@query("""select o_orderkey, case o_orderkey % 8 when 4 then (o_orderkey % 1000)::decimal(18, 2) + 1000.5 when 5 then (o_orderkey % 900 + 100) * 1000 + 234 when 6 then (o_orderkey % 90 + 0.25) * 1000000 end::decimal(18, 2) v from orders""")
def amount_refused(spark, d):
    """Texts with more decimal marks than a number has, a date among them, and such as look alike and are amounts."""
    k = F.col("o_orderkey")
    n = lambda m, add=0: (k % m + add).cast("string")
    texts = [
        F.date_format("o_orderdate", "dd.MM.yyyy"), F.concat(n(9, 1), F.lit(".500.00")), F.concat(n(9), F.lit(".2.3")), F.concat(n(90), F.lit(",25,5 milhões")),
        F.concat(F.lit("1."), F.lpad(n(1000), 3, "0"), F.lit(",50 €")), F.concat(n(900, 100), F.lit(",234 euros")), F.concat(n(90), F.lit(",250 M€")), F.lit("por anunciar"),
    ]
    text = texts[-1]
    for i, t in enumerate(texts[:-1]):
        text = F.when(k % 8 == i, t).otherwise(text)
    return v.table(spark, d, "orders").select("o_orderkey", money.amount(text).alias("v"))


_SECRET = b"tidewatch-segredo"
_pad = lambda x: "from_hex('" + bytes(b ^ x for b in _SECRET.ljust(keyed.BLOCK, b"\0")).hex() + "')"
_hmac = lambda message: f"unhex(sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode({message})))))"


@query(v.sql(v.SUBSCRIPTIONS, body=f"""select user_id, medida, case when user_id % 9 = 0 then 'emitido-' || user_id else replace(replace(base64({_hmac("user_id || coalesce(chr(31) || medida, '')")}[1:24]), '+', '-'), '/', '_') end token
  from (select user_id, medida from subscriptions union all select distinct user_id, null from subscriptions)"""))
def alert_tokens(spark, d):
    pairs = v.subscriptions(spark, d).select("user_id", "medida")
    pairs = pairs.unionByName(pairs.select("user_id", F.lit(None).cast("string").alias("medida")).distinct())
    issued = pairs.where("user_id % 9 = 0").select("user_id", "medida", F.concat(F.lit("emitido-"), F.col("user_id").cast("string")).alias("token"))
    return accounts.tokens_for(pairs, issued, _SECRET)


@query(f"""with c as (select event_id, 'm' || event_id id, case when event_id % 11 = 0 then 'x' else (1706659200 - event_id % 700)::varchar end carimbo, event_type || ' ' || user_id corpo from events),
  h as (select *, base64({_hmac("id || '.' || carimbo || '.' || corpo")}) mac from c),
  r as (select *, coalesce(abs(1706659200 - try_cast(carimbo as double)) <= 300, false) fresco, event_id % 3 <> 0 assinado from h)
  select event_id, fresco and assinado aceite, case when not fresco then 'carimbo_fora_da_janela' when not assinado then 'assinatura_invalida' end motivo, mac from r""")
def webhook_checks(spark, d):
    """Calls of which a third is signed for another body, some are older than the window, and some have no time."""
    e = F.col("event_id")
    calls = v.table(spark, d, "events").select(e, F.concat(F.lit("m"), e.cast("string")).alias("id"), F.when(e % 11 == 0, "x").otherwise((F.lit(1706659200) - e % 700).cast("string")).alias("carimbo"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("corpo"))
    mac = lambda body: F.base64(keyed.hmac_sha256(_SECRET, F.encode(F.concat_ws(".", "id", "carimbo", body), "UTF-8")))
    calls = calls.withColumn("mac", mac(F.col("corpo"))).withColumn("assinatura", F.concat(F.lit("v1,curta v1,"), F.when(e % 3 == 0, mac(F.concat("corpo", F.lit("!")))).otherwise(F.col("mac"))))
    secret = "whsec_" + base64.b64encode(_SECRET).decode()
    return accounts.received(calls, secret, F.timestamp_seconds(F.lit(1706659200))).select("event_id", "aceite", "motivo", "mac")


_TITLES = ["Água", "agua", "Aguá", "Zé", "zebra", "Ábaco", "abaco", "Ça", "ca", "a-b", "ab"]


@query(v.sql(v.FUNDS, f"""t as (select fund_id, case fund_id % 5 when 0 then 'desconhecido' when 1 then 'suspenso' else estado end estado, case when fund_id % 3 = 0 then fecha_em end fecha_em, [{", ".join(f"'{x}'" for x in _TITLES)}][(fund_id % {len(_TITLES)})::int + 1] || ' ' || fund_id % 50 titulo from funds where publicado)""", body="""select row_number() over (order by r, fecha_em nulls last, case when fecha_em is null then titulo end collate pt, fund_id) lugar, fund_id, titulo
  from (select *, case estado when 'aberto' then 0 when 'previsto' then 1 when 'suspenso' then 2 when 'desconhecido' then 3 else 4 end r from t)"""))
def catalogue_collated(spark, d):
    """Published funds in the catalogue's order, titles by the Portuguese alphabet, each with its place."""
    k = F.col("fund_id")
    title = F.concat(F.element_at(F.array(*map(F.lit, _TITLES)), (k % len(_TITLES) + 1).cast("int")), F.lit(" "), (k % 50).cast("string"))
    rows = v.funds(spark, d).where("publicado").select(k, F.when(k % 5 == 0, "desconhecido").when(k % 5 == 1, "suspenso").otherwise(F.col("estado")).alias("estado"), F.when(k % 3 == 0, F.col("fecha_em")).alias("fecha_em"), title.alias("titulo"))
    return catalogue.placed(rows).select("lugar", "fund_id", "titulo")


@query("""select 'https://x.pt/' || o_custkey pagina, '/aviso/' || o_orderkey href, 'Aviso para ' || o_orderkey texto, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%d/%m/%Y') when 1 then strftime(o_orderdate, '%-d') || ' de maio de ' || year(o_orderdate) when 2 then strftime(o_orderdate, '%d-%m-%y') end data from orders""")
def listing_dates(spark, d):
    """A listing a customer: items with a link and, before or after it, a date of one form or another, or none."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    date = F.when(k % 4 == 0, F.date_format(day, "dd/MM/yyyy")).when(k % 4 == 1, F.concat(F.dayofmonth(day).cast("string"), F.lit(" de maio de "), F.year(day).cast("string"))).when(k % 4 == 2, F.date_format(day, "dd-MM-yy")).otherwise("em breve")
    link = F.concat(F.lit('<a href="/aviso/'), k.cast("string"), F.lit('"><b>Aviso</b>\n para '), k.cast("string"), F.lit("</a>"))
    item = F.concat(F.lit("<li><img src=x>"), F.when(k % 2 == 0, F.concat(F.lit("<i>até "), date, F.lit("</i> "), link)).otherwise(F.concat(link, F.lit("<br>prazo: "), date)), F.lit("</li>"))
    listing = v.table(spark, d, "orders").groupBy(F.concat(F.lit("https://x.pt/"), F.col("o_custkey").cast("string")).alias("url")).agg(F.concat(F.lit("<p>1/1/2001</p><ul>"), F.array_join(F.collect_list(item), "\n"), F.lit("</ul>")).alias("html"))
    return pages.dated_links(listing).select(F.col("url").alias("pagina"), "href", "texto", "data")
