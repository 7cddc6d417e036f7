"""Notice tables derived from the star schema, once in DataFrames and once in SQL for the comparison.

Every derived flag is a rule on the key, so both sides agree; clocks are given, never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

AS_OF = "1998-08-02 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"
MEASURES = "p_type"


def as_of(at: str = AS_OF):
    return F.lit(at).cast("timestamp_ntz")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key, *values):
    out = F.lit(values[-1])
    for i, v in list(enumerate(values))[-2::-1]:
        out = F.when(F.pmod(key, F.lit(len(values))) == i, v).otherwise(out)
    return out


def funds(spark, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        k.alias("fund_id"),
        F.concat(F.lit("aviso-"), k.cast("string")).alias("slug"),
        F.concat_ws(" ", "o_orderpriority", k.cast("string")).alias("titulo"),
        F.when(F.col("o_orderstatus") == "O", "aberto").when(F.col("o_orderstatus") == "P", "previsto").otherwise("encerrado").alias("estado"),
        F.col("o_orderdate").alias("abre_em"),
        (F.col("o_orderdate") + F.make_dt_interval((k % 120).cast("int"))).alias("fecha_em"),
        _pick(k, "minuto", "dia", "mes", "desconhecida").alias("precisao"),
        (k % 10 != 0).alias("publicado"),
        (k % 3 != 0).alias("alertavel"),
        (k % 5 == 0).alias("needs_review"),
        (k % 7 == 0).alias("dotacao_esgotada"),
        _pick(k, "sim", "nao", "desconhecido").alias("admite"),
        F.col("o_totalprice").alias("dotacao"),
        F.when(F.col("n_regionkey") == 0, "nacional").otherwise("municipio").alias("ambito"),
        F.col("n_name").alias("concelho"),
        F.array_distinct(F.array("c_mktsegment", _pick(k, "particular", "condominio", "empresa"))).alias("beneficiarios"),
    )


FUNDS = """funds as (select o_orderkey fund_id, 'aviso-' || o_orderkey slug, o_orderpriority || ' ' || o_orderkey titulo,
  case o_orderstatus when 'O' then 'aberto' when 'P' then 'previsto' else 'encerrado' end estado,
  o_orderdate abre_em, o_orderdate + to_days((o_orderkey % 120)::int) fecha_em,
  ['minuto', 'dia', 'mes', 'desconhecida'][(o_orderkey % 4)::int + 1] precisao,
  o_orderkey % 10 <> 0 publicado, o_orderkey % 3 <> 0 alertavel, o_orderkey % 5 = 0 needs_review, o_orderkey % 7 = 0 dotacao_esgotada,
  ['sim', 'nao', 'desconhecido'][(o_orderkey % 3)::int + 1] admite, o_totalprice dotacao,
  case when n_regionkey = 0 then 'nacional' else 'municipio' end ambito, n_name concelho,
  [c_mktsegment, ['particular', 'condominio', 'empresa'][(o_orderkey % 3)::int + 1]] beneficiarios
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def fund_measures(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return rows.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("fund_id"), F.col("p_type").alias("medida")).distinct()


FUND_MEASURES = "fund_measures as (select distinct l_orderkey fund_id, p_type medida from lineitem join part on l_partkey = p_partkey)"


def profiles(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        k.alias("user_id"),
        F.col("c_name").alias("nome"),
        F.col("n_name").alias("concelho"),
        F.array_distinct(F.array("c_mktsegment", _pick(k, "particular", "condominio"))).alias("tipos"),
        _pick(k, "imediata", "diaria", "semanal").alias("frequencia"),
        (k % 11 == 0).alias("cancelou"),
    )


PROFILES = """profiles as (select c_custkey user_id, c_name nome, n_name concelho, [c_mktsegment, ['particular', 'condominio'][(c_custkey % 2)::int + 1]] tipos,
  ['imediata', 'diaria', 'semanal'][(c_custkey % 3)::int + 1] frequencia, c_custkey % 11 = 0 cancelou from customer join nation on c_nationkey = n_nationkey)"""


def subscriptions(spark, sf_dir: str) -> DataFrame:
    """Each user follows up to two measures, those of the parts with keys next to the user's."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("user_id"), F.explode(F.array(k, k + 7)).alias("p_partkey"))
    return rows.join(table(spark, sf_dir, "part"), "p_partkey").select("user_id", F.col("p_type").alias("medida"), (F.col("p_partkey") % 13 != 0).alias("activa")).groupBy("user_id", "medida").agg(F.bool_or("activa").alias("activa"))


SUBSCRIPTIONS = """subscriptions as (select user_id, p_type medida, bool_or(p_partkey % 13 <> 0) activa
  from (select c_custkey user_id, unnest([c_custkey, c_custkey + 7]) k from customer) join part on p_partkey = k group by all)"""


def fund_events(spark, sf_dir: str) -> DataFrame:
    """The event table as an event log of funds."""
    e = F.col("event_id")
    orders = table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("m"))
    kinds = ("programa_novo", "abriu", "fecha_em_breve", "prazo_alterado", "dotacao_esgotada", "elegibilidade_alterada", "encerrou")
    rows = table(spark, sf_dir, "events").crossJoin(orders)  # one row: the largest key
    return rows.select(e.alias("event_id"), (F.pmod(e * 37 + F.col("user_id"), F.col("m")) + 1).alias("fund_id"), _pick(e, *kinds).alias("tipo"), F.col("ts").alias("criado_em"), (e % 4 != 0).alias("alertavel"), F.concat(F.lit("i"), F.pmod(e, F.lit(9000)).cast("string")).alias("impressao"))


FUND_EVENTS = """fund_events as (select event_id, (event_id * 37 + user_id) % (select max(o_orderkey) from orders) + 1 fund_id,
  ['programa_novo', 'abriu', 'fecha_em_breve', 'prazo_alterado', 'dotacao_esgotada', 'elegibilidade_alterada', 'encerrou'][(event_id % 7)::int + 1] tipo,
  ts criado_em, event_id % 4 <> 0 alertavel, 'i' || event_id % 9000 impressao from events)"""


def snapshots(spark, sf_dir: str) -> DataFrame:
    """Two captures a page: even pages change only what is volatile in the second, every seventh changes its text."""
    p = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    first = pages.select("page_id", "url", "html", F.lit(1).alias("captura"))
    second = pages.select("page_id", "url", F.when(p % 7 == 0, F.concat("html", F.lit("<p>novo</p>"))).when(p % 2 == 0, F.regexp_replace("html", "track[(][0-9]+[)]", "track(0)")).otherwise(F.col("html")).alias("html"), F.lit(2).alias("captura"))
    return first.unionByName(second)


SNAPSHOTS = r"""snapshots as (select page_id, url, html, 1 captura from pages union all
  select page_id, url, case when page_id % 7 = 0 then html || '<p>novo</p>' when page_id % 2 = 0 then regexp_replace(html, 'track[(][0-9]+[)]', 'track(0)', 'g') else html end, 2 from pages)"""


def sql(*views: str, body: str) -> str:
    return f"with {', '.join(views)} {body}" if views else body
