"""Queries over the scalar functions, evidence, gate, identity and health, each with SQL for comparison.

Notations are written from known values, so the SQL of a parser is the value itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, html, money, text, urls
from ..operators import gate, identity, records
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


_WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def _comparable(x: str) -> str:
    return f"lower({_squeeze(f'strip_accents({x})')})"


def _docs(spark, d):
    return v.table(spark, d, "documents")


@query(f"select doc_id, length(t) n, sha256(t) h from (select doc_id, {_squeeze('text')} t from documents)")
def norm_spaces(spark, d):
    return _docs(spark, d).select("doc_id", text.squeeze(F.col("text")).alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("h"))


@query("select doc_id, sha256(strip_accents(text)) h from documents")
def strip_accents(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(text.strip_accents(F.col("text")), 256).alias("h"))


@query(f"select doc_id, sha256({_comparable('text')}) h from documents")
def comparable_form(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(text.comparable(F.col("text")), 256).alias("h"))


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TITLE_KEY = (
    r"array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(" + _comparable(f"{_TITLE} || ' Segunda Republicação'")
    + r", '\b(?:primeira|segunda|terceira|quarta|quinta)?\s*republicacao\b', ' ', 'g'), '[^a-z0-9\s/-]', ' ', 'g'), '\s+'), lambda w: w <> '' and w not in (" + _STOP + ")), '-') || ':' || 2020 + page_id % 7"
)


@query(f"select page_id, {_TITLE_KEY} chave from pages")
def title_key(spark, d):
    t = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" Segunda Republicação"))
    return v.table(spark, d, "pages").select("page_id", text.title_key(t, F.col("page_id") % 7 + 2020).alias("chave"))


@query("""select o_orderkey, case o_orderkey % 3 when 0 then 'AVISO ' || lpad((o_orderkey % 50)::varchar, 2, '0') || '/C13-I01/2024' when 1 then 'NORTE2030-2026-' || o_orderkey % 90
  else null end ref from orders""")
def legal_ref(spark, d):
    k = F.col("o_orderkey")
    s = F.when(k % 3 == 0, F.concat(F.lit("Aviso n.º "), (k % 50).cast("string"), F.lit("/C13-i01/2024"))).when(k % 3 == 1, F.concat(F.lit("ver norte2030-2026-"), (k % 90).cast("string"))).otherwise("sem referência, só AVISO-CONVITE")
    return v.table(spark, d, "orders").select("o_orderkey", text.legal_reference(s).alias("ref"))


@query("select o_orderkey, concat_ws(',', case when length(o_orderkey::varchar) <= 4 then 'NORTE2030-2026-' || o_orderkey end, 'CENTRO2030-2025-7') codigos from orders")
def notice_codes(spark, d):
    k = F.col("o_orderkey").cast("string")
    s = F.concat(F.lit("ver NORTE2030-2026-"), k, F.lit(" e norte2030-2026-"), k, F.lit("; CENTRO2030-2025-7."))
    return v.table(spark, d, "orders").select("o_orderkey", F.array_join(text.notice_codes(s), ",").alias("codigos"))


@query("""with t as (select p_partkey, '  ' || lower(p_name) || ' ' a, '  ' || lower(p_brand || p_type) || ' ' b from part),
  g as (select p_partkey, list_distinct(list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3))) a, list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) b from t)
  select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 9) s from g""")
def trigram_similarity(spark, d):
    return v.table(spark, d, "part").select("p_partkey", F.round(text.similarity(F.col("p_name"), F.concat("p_brand", "p_type")), 9).alias("s"))


_ESCAPED = """replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')"""


@query(f"select page_id, sha256({_ESCAPED}) h from pages")
def escape_html(spark, d):
    return v.table(spark, d, "pages").select("page_id", F.sha2(text.escape_html(F.col("html")), 256).alias("h"))


_NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '([?&](?:v|ver|version|_|cb|t)=)\d{6,}', '\1[removido]', 'gi'),
  '<script\b[^>]*>.*?</script>', '<script>[removido]</script>', 'gis'), '<style\b[^>]*>.*?</style>', '<style>[removido]</style>', 'gis'),
  '\b(id|for)\s*=\s*["''][^"'']*["'']', '\1="[removido]"', 'gi'), '\s+', ' ', 'g'))"""


@query(f"select page_id, sha256({_NORMAL}) h from pages")
def html_normalise_hash(spark, d):
    return v.table(spark, d, "pages").select("page_id", html.content_hash(F.col("html")).alias("h"))


@query(rf"""select page_id, length(t) n, sha256(t) h from (select page_id, {_squeeze("replace(replace(regexp_replace(regexp_replace(" + _NORMAL + ", '<script>[^<]*</script>|<style>[^<]*</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&quot;', '" + '"' + "'), '&amp;', '&')")} t from pages)""")
def visible_text(spark, d):
    rows = v.table(spark, d, "pages").select("page_id", html.visible_text(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n"), F.sha2("t", 256).alias("h"))


@query("select page_id, page_id % 5 = 0 erro from pages")
def soft_404(spark, d):
    p = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("<title>Erro 404</title>"), "html")).otherwise(F.col("html"))
    return v.table(spark, d, "pages").select("page_id", html.soft_404(p).alias("erro"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^(?i:https?)://([^/?#]+)', 1)), '^www\.', '')"
_PATH = r"regexp_replace(regexp_extract(url, '^[^?#]*?://[^/?#]+([^?#]*)', 1), '/$', '')"
_QUERY = r"array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(split_part(p, '=', 1), '(?i)^(?:utm_.*|fbclid|gclid|mc_.*|sessionid|jsessionid|phpsessid|aspxauth)$'))), '&')"
_CANONICAL = f"'https://' || {_HOST} || {_PATH} || case when {_QUERY} = '' then '' else '?' || {_QUERY} end"
_TRACKED = "url || case when contains(url, '#') then '' when contains(url, '?') then '&utm_source=x&fbclid=1' else '?utm_source=x' end"


@query(f"select page_id, {_CANONICAL} u from (select page_id, {_TRACKED} url from pages)")
def canonical_url(spark, d):
    u = F.col("url")
    tracked = F.concat(u, F.when(u.contains("#"), "").when(u.contains("?"), "&utm_source=x&fbclid=1").otherwise("?utm_source=x"))
    return v.table(spark, d, "pages").select("page_id", urls.canonical_url(tracked).alias("u"))


@query(f"select page_id, 'fonte:' || sha256({_CANONICAL}) chave, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') guardado from pages")
def url_key(spark, d):
    return v.table(spark, d, "pages").select("page_id", urls.url_key(F.lit("fonte"), F.col("url")).alias("chave"), urls.storage_url(F.col("url")).alias("guardado"))


@query("""select o_orderkey, case o_orderkey % 6 when 0 then 'pdf' when 1 then 'folha' when 2 then 'zip' when 3 then 'csv' when 4 then 'json' else 'html' end tipo from orders""")
def classify_content(spark, d):
    k = F.col("o_orderkey")
    kind = F.when(k % 6 == 0, "application/pdf").when(k % 6 == 4, "application/json; charset=utf-8").when(k % 6 == 5, "text/html")
    ending = F.when(k % 6 == 1, ".XLSX?x=1").when(k % 6 == 2, ".zip").when(k % 6 == 3, ".csv#a").otherwise("")
    return v.table(spark, d, "orders").select("o_orderkey", urls.classify(kind, F.concat(F.lit("https://a.pt/f"), k.cast("string"), ending)).alias("tipo"))


@query("select o_orderkey, case o_orderkey % 4 when 0 then round(o_totalprice, 2) when 1 then floor(o_totalprice) * 1000 when 2 then (o_orderkey % 90 + 1) * 1000000 else (o_orderkey % 90 + 1.5) * 1000000 end::decimal(18, 2) v from orders")
def parse_amount(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    whole = F.replace(F.format_number(F.floor(p) * 1000, 0), F.lit(","), F.lit("."))
    s = F.when(k % 4 == 0, money.euros(F.round(p, 2))).when(k % 4 == 1, F.concat(F.lit("até "), whole, F.lit(" EUR"))).when(k % 4 == 2, F.concat((k % 90 + 1).cast("string"), F.lit(" milhões de euros"))).otherwise(F.concat((k % 90 + 1).cast("string"), F.lit(",5 M€")))
    return v.table(spark, d, "orders").select("o_orderkey", money.amount(s).alias("v"))


@query("select o_orderkey, case when o_orderkey % 150 <= 100 then (o_orderkey % 150)::double end v from orders")
def parse_percentage(spark, d):
    n = (F.col("o_orderkey") % 150).cast("string")
    s = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("até "), n, F.lit(" %"))).otherwise(F.concat(n, F.lit(" por cento")))
    return v.table(spark, d, "orders").select("o_orderkey", money.percentage(s).alias("v"))


@query("select l_orderkey, l_linenumber, replace(replace(replace(format('{:,.2f}', l_extendedprice), ',', 'x'), '.', ','), 'x', '.') || ' €' s from lineitem")
def euro_format(spark, d):
    return v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", money.euros(F.col("l_extendedprice")).alias("s"))


_EPOCH = "floor(epoch(timezone('Europe/Lisbon', {})))::bigint"
_DAYEND = _EPOCH.format("date_trunc('day', o_orderdate) + interval '23 hours 59 minutes 59 seconds'")


@query(f"select o_orderkey, {_DAYEND} momento, 'dia' precisao from orders")
def parse_date_numeric(spark, d):
    s = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    p = dates.parse_date(s, closing=True)
    return v.table(spark, d, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", F.unix_timestamp("p.at").alias("momento"), "p.precisao")


_MONTHS = "[" + ", ".join(f"'{m}'" for m in dates.LABELS) + "]"


@query(f"""select o_orderkey, case when o_orderkey % 2 = 0 then {_EPOCH.format("date_trunc('day', o_orderdate) + interval 18 hours")}
  else {_EPOCH.format("date_trunc('day', last_day(o_orderdate)) + interval '23 hours 59 minutes 59 seconds'")} end momento, case when o_orderkey % 2 = 0 then 'minuto' else 'mes' end precisao from orders""")
def parse_date_written(spark, d):
    o = F.col("o_orderdate")
    month = F.element_at(F.array(*map(F.lit, dates.LABELS)), F.month(o))
    s = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("até às 18:00 do dia "), F.dayofmonth(o).cast("string"), F.lit(" de "), month, F.lit(" de "), F.year(o).cast("string"))).otherwise(F.concat(F.lit("durante o mês de "), month, F.lit(" de "), F.year(o).cast("string")))
    return v.table(spark, d, "orders").select("o_orderkey", dates.parse_date(s, closing=True).alias("p")).select("o_orderkey", F.unix_timestamp("p.at").alias("momento"), "p.precisao")


@query(f"select event_id, {_EPOCH.format('ts')} momento from events")
def lisbon_to_utc(spark, d):
    return v.table(spark, d, "events").select("event_id", F.unix_timestamp(dates.lisbon_to_utc(F.col("ts"))).alias("momento"))


@query(f"select o_orderkey, floor((epoch_us(o_orderdate) - epoch_us(timestamp '{v.AS_OF}')) / 86400000000)::bigint dias from orders")
def days_until(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", dates.days_until(F.col("o_orderdate"), v.as_of()).cast("long").alias("dias"))


@query("select o_orderkey, strftime(case when n >= 61 then date '1899-12-30' else date '1899-12-31' end + n, '%Y-%m-%d') dia from (select o_orderkey, (o_orderkey % 50000 + 1)::int n from orders)")
def excel_serial(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", F.date_format(dates.excel_date(F.col("o_orderkey") % 50000 + 1), "yyyy-MM-dd").alias("dia"))


_CIVIL = "timezone('Europe/Lisbon', timezone('UTC', ts))"


@query(f"""select event_id, case when event_id % 5 = 0 or event_id % 3 = 0 then floor(epoch(ts))::bigint
  when event_id % 3 = 2 then {_EPOCH.format("date_trunc('week', c) + interval 7 days + interval 8 hours")}
  when c < date_trunc('day', c) + interval 8 hours then {_EPOCH.format("date_trunc('day', c) + interval 8 hours")} else {_EPOCH.format("date_trunc('day', c) + interval 32 hours")} end em
  from (select event_id, ts, {_CIVIL} c from events)""")
def next_send(spark, d):
    e = F.col("event_id")
    freq = F.when(e % 3 == 0, "imediata").when(e % 3 == 1, "diaria").otherwise("semanal")
    return v.table(spark, d, "events").select("event_id", F.unix_timestamp(dates.next_send(freq, e % 5 == 0, F.col("ts").cast("timestamp"))).alias("em"))


@query(f"""select o_orderkey, case o_orderkey % 4 when 0 then 'Prazo por confirmar' when 1 then {_MONTHS}[month(c)] || ' de ' || year(c) when 2 then day(c) || ' de ' || {_MONTHS}[month(c)] || ' de ' || year(c)
  else day(c) || ' de ' || {_MONTHS}[month(c)] || ' de ' || year(c) || ', ' || strftime(c, '%H:%M') end s from (select o_orderkey, timezone('Europe/Lisbon', timezone('UTC', o_orderdate)) c from orders)""")
def deadline_label(spark, d):
    k = F.col("o_orderkey")
    p = F.when(k % 4 == 0, "desconhecida").when(k % 4 == 1, "mes").when(k % 4 == 2, "dia").otherwise("minuto")
    return v.table(spark, d, "orders").select("o_orderkey", dates.deadline_label(F.col("o_orderdate"), p).alias("s"))


@query("select event_id, sha256(user_id || ' ' || event_type || ' ' || '{\"limiarDias\":' || event_id % 14 || '}') impressao from events")
def fingerprint(spark, d):
    definer = F.concat(F.lit('{"limiarDias":'), (F.col("event_id") % 14).cast("string"), F.lit("}"))
    return v.table(spark, d, "events").select("event_id", urls.fingerprint(F.col("user_id"), F.col("event_type"), definer).alias("impressao"))


@query("select event_id, round(((event_id % 9000) * 5.0 + user_id * 25.0 + (event_id % 70) * 6.25 + (event_id % 11) * 0.5)::double * case when event_id % 2 = 0 then 0.5 else 1 end::double) / 1000000 custo from events")
def model_cost(spark, d):
    e = F.col("event_id")
    return v.table(spark, d, "events").select("event_id", money.call_cost(e % 9000, F.col("user_id"), e % 70, e % 11, e % 2 == 0).alias("custo"))


@query("select event_id, '{\"a\": ' || event_id || ', \"b\": {}}' json from events")
def json_reply(spark, d):
    s = F.concat(F.lit('Here:\n```json\n{"a": '), F.col("event_id").cast("string"), F.lit(', "b": {}}\n```\nDone.'))
    return v.table(spark, d, "events").select("event_id", text.json_of_reply(s).alias("json"))


@query("select o_orderkey, case o_orderkey % 3 when 0 then 'entidade_publica,municipio' when 1 then 'empresa' else 'entidade_publica,municipio,empresa' end tipos, case o_orderkey % 3 when 0 then 'nao' else 'desconhecido' end admite from orders")
def plan_beneficiaries(spark, d):
    k = F.col("o_orderkey")
    s = F.when(k % 3 == 0, "Entidades Públicas").when(k % 3 == 1, "Setor privado").otherwise("Público e Privado")
    return v.table(spark, d, "orders").select("o_orderkey", text.beneficiary_of_plan(s).alias("b")).select("o_orderkey", F.array_join("b.tipos", ",").alias("tipos"), "b.admite")


@query(f"select doc_id, item_id, coalesce(contains({_comparable('d.text')}, {_comparable('b.text')}), false) presente from documents d join benchmark b on b.item_id = d.doc_id % 40 where b.text is not null")
def evidence_check(spark, d):
    b = v.table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote")).where("quote is not null")
    rows = _docs(spark, d).join(b, F.col("doc_id") % 40 == F.col("item_id"))
    return rows.select("doc_id", "item_id", gate.quoted(F.col("text"), F.col("quote")).alias("presente"))


def _extractions(spark, d):
    k = F.col("o_orderkey")
    level = lambda m: F.when(k % m == 0, "baixa").when(k % m == 1, "media").otherwise("alta")
    return v.table(spark, d, "orders").select(
        k.alias("id"), (k % 31 == 0).alias("recusa"), (k % 29 != 0).alias("e_aviso"), F.when(k % 13 == 0, F.array(F.lit("estado"), F.lit("medidas"))).otherwise(F.array().cast("array<string>")).alias("provas_falhadas"),
        level(11).alias("conf_estado"), level(17).alias("conf_encerramento"), level(19).alias("conf_admite"), (k % 23 == 0).alias("ocr_ma"), v._pick(k, "sim", "nao", "desconhecido").alias("admite"), (k % 4 == 1).alias("condominio"),
        F.when(F.col("o_orderstatus") == "F", "encerrado").otherwise("aberto").alias("estado"), F.col("o_orderdate").alias("prazo"),
    )


def _level(m: int) -> str:
    return f"case o_orderkey % {m} when 0 then 1 when 1 then 2 else 3 end"


_GATE = f"""with x as (select o_orderkey id, o_orderkey % 31 = 0 recusa, o_orderkey % 29 <> 0 e_aviso, o_orderkey % 13 = 0 falhou, {_level(11)} ce, {_level(17)} cp, {_level(19)} ca, o_orderkey % 23 = 0 ocr,
  ['sim', 'nao', 'desconhecido'][(o_orderkey % 3)::int + 1] admite, o_orderkey % 4 = 1 cond, o_orderstatus = 'F' fechado, o_orderdate prazo from orders),
y as (select *, list_filter([case when recusa then 'recusa_do_modelo' end, case when not e_aviso then 'nao_e_aviso_de_apoio' end, case when falhou then 'prova_falhou:estado,medidas' end,
  case when least(ce, cp, ca) < 3 then 'confianca_insuficiente:' || array_to_string(list_filter([case when ce < 3 then 'estado' end, case when cp < 3 then 'prazos.encerramento' end, case when ca < 3 then 'beneficiarios.admite_particulares' end], lambda z: z is not null), ',') end,
  case when ocr then 'ocr_ma' end, case when not (admite = 'sim' or (admite = 'nao' and cond)) then 'admite_particulares:' || admite end,
  case when fechado and prazo > timestamp '{v.AS_OF}' then 'estado_incoerente:encerrado_com_prazo_' || strftime(prazo, '%Y-%m-%d') end], lambda z: z is not null) m,
  recusa or not e_aviso or least(ce, cp, ca) = 1 estrito, fechado and ce <> 1 and cp = 3 and prazo <= timestamp '{v.AS_OF}' historia from x)"""


@query(_GATE + " select id, array_to_string(m, ';') motivos, ['baixa', 'media', 'alta'][least(ce, cp, ca)] confianca, not (estrito and not historia) publicado, len(m) = 0 and not estrito alertavel, len(m) > 0 needs_review from y")
def gate_decide(spark, d):
    return gate.decide(_extractions(spark, d), v.as_of()).select("id", F.array_join("motivos", ";").alias("motivos"), F.col("confianca_global").alias("confianca"), "publicado", "alertavel", "needs_review")


@query(_GATE + " select id, p publicado, a alertavel from (select id, not (estrito and not historia) p, len(m) = 0 and not estrito a from y) where p is distinct from (id % 10 <> 0) or a is distinct from (id % 3 <> 0)")
def gate_redecide(spark, d):
    stored = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 10 != 0).alias("publicado"), (F.col("o_orderkey") % 3 != 0).alias("alertavel"))
    return gate.changed_decisions(stored, gate.decide(_extractions(spark, d), v.as_of()), "id")


@query(f"""select page_id, tipo, valor, forca from (select page_id, 'url' tipo, 'f' || page_id % 3 || ':' || sha256({_CANONICAL}) valor, 70 forca from pages
  union all select page_id, 'titulo', 'f' || page_id % 3 || ':' || {_TITLE_KEY}, 30 from pages union all select page_id, 'referencia', 'f' || page_id % 3 || ':AVISO ' || lpad((page_id % 90)::varchar, 2, '0') || '/2026', 100 from pages where page_id % 2 = 0)""")
def identity_keys(spark, d):
    p = F.col("page_id")
    ref = F.when(p % 2 == 0, F.concat(F.lit("Aviso nº "), (p % 90).cast("string"), F.lit("/2026")))
    title = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" Segunda Republicação"))
    rows = v.table(spark, d, "pages").withColumn("fonte", F.concat(F.lit("f"), (p % 3).cast("string")))
    return identity.keys(rows, F.col("fonte"), ref, F.col("url"), title, p % 7 + 2020).select("page_id", "tipo", "valor", "forca")


_KEYS = "(select o_orderkey cand_id, unnest([{'tipo': 'referencia', 'valor': 'r' || o_custkey, 'forca': 100}, {'tipo': 'url', 'valor': 'u' || o_orderkey % 4001, 'forca': 70}, {'tipo': 'titulo', 'valor': 't' || o_orderkey % 97, 'forca': 30}], recursive := true) from orders)"


@query(f"""with k as {_KEYS}, known as (select tipo, valor, min(cand_id) fund_id from k where cand_id % 5 = 0 group by all),
  j as (select k.*, fund_id from (select * from k where cand_id % 5 <> 0) k left join known using (tipo, valor)),
  a as (select cand_id, count(distinct fund_id) n, max_by(fund_id, forca::bigint * 100000000 - fund_id) filter (fund_id is not null) f, count(*) filter (fund_id is null) novas from j group by 1)
  select cand_id, case when n = 0 then 'novo' when n > 1 then 'conflito' else 'existente' end resultado, case when n > 0 then f end fund_id, novas chaves_novas from a""")
def identity_resolve(spark, d):
    k = F.col("o_orderkey")
    key = lambda t, val, f: F.struct(F.lit(t).alias("tipo"), val.alias("valor"), F.lit(f).alias("forca"))
    rows = v.table(spark, d, "orders").select(k.alias("cand_id"), F.explode(F.array(
        key("referencia", F.concat(F.lit("r"), F.col("o_custkey").cast("string")), 100), key("url", F.concat(F.lit("u"), (k % 4001).cast("string")), 70), key("titulo", F.concat(F.lit("t"), (k % 97).cast("string")), 30),
    )).alias("c")).select("cand_id", "c.*")
    known = rows.where("cand_id % 5 = 0").groupBy("tipo", "valor").agg(F.min("cand_id").alias("fund_id"))
    return identity.resolve(rows.where("cand_id % 5 <> 0"), known)


def _runs(spark, d):
    """A run per hour and kind of event, with metrics from its events."""
    e = F.col("event_id")
    rows = v.table(spark, d, "events").groupBy(F.concat_ws(":", "event_type", F.date_format("ts", "yyyy-MM-dd HH")).alias("run_id")).agg(F.count("*").alias("candidatos"), F.sum(e % 7).alias("s"), F.min(e).alias("m"))
    s, m = F.col("s"), F.col("m")
    return rows.select(
        "run_id", "candidatos", F.when(m % 11 == 0, "timeout").alias("erro"), (m % 3).alias("falhas_antes"), F.lit(8.0).alias("base"), (m % 4).alias("com_data"), (m % 700).alias("horas_sem_mudanca"), (s % 5 == 0).cast("long").alias("adiadas"),
        (s % 3).alias("falhadas"), (s % 4).alias("chamadas"), (s % 6).alias("extraccoes_ok"), (s % 5).alias("extraccoes_revisao"), (s % 2).alias("provas_falhadas"), (m % 2).alias("cache_lida"),
    )


_RUNS = """r as (select event_type || ':' || strftime(ts, '%Y-%m-%d %H') run_id, count(*) c, sum(event_id % 7)::bigint s, min(event_id) m from events group by 1),
a as (select run_id, m % 11 = 0 erro, unnest(list_filter([
  case when m % 11 = 0 and m % 3 >= 1 then 'falhas_consecutivas|critico' end,
  case when m % 11 <> 0 then case when c = 0 then 'zero_candidatos|critico' when c < 6 then 'abaixo_do_minimo|critico' when c < 3.2 then 'queda_de_candidatos|aviso' end end,
  case when m % 11 <> 0 and c > 0 and m % 4 = 0 then 'sem_datas|aviso' end, case when m % 700 > 504 then 'conteudo_congelado|aviso' end, case when s % 5 = 0 then 'tecto_de_custo_atingido|aviso' end,
  case when s % 3 > 0 then 'extraccoes_falhadas|' || case when s % 3 = s % 4 then 'critico' else 'aviso' end end,
  case when s % 6 + s % 5 > 0 and s % 5 > 0.4 * (s % 6 + s % 5) then 'muitas_revisoes|aviso' end, case when s % 6 + s % 5 > 0 and s % 2 > 0.2 * (s % 6 + s % 5) then 'provas_falhadas|critico' end,
  case when s % 4 > 1 and m % 2 = 0 then 'cache_nao_lida|aviso' end], lambda z: z is not null)) x from r)"""


@query(f"with {_RUNS} select run_id, split_part(x, '|', 1) regra, split_part(x, '|', 2) gravidade from a")
def health_alarms(spark, d):
    return gate.health(_runs(spark, d), minimum=6)


@query(f"with {_RUNS}, w as (select run_id, bool_or(contains(x, 'critico')) grave from a group by 1) select r.run_id, case when coalesce(grave, false) then 'falhou' when m % 11 = 0 then 'parcial' else 'ok' end estado from r left join w using (run_id)")
def run_status(spark, d):
    runs = _runs(spark, d)
    return gate.run_status(gate.health(runs, minimum=6), runs)


@query("select event_type, median(n)::double mediana from (select event_type, date_trunc('day', ts) dia, count(*) n from events group by all) group by 1")
def median_candidates(spark, d):
    days = v.table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("dia")).agg(F.count("*").alias("n"))
    return records.medians(days, "event_type", "n")


@query("select event_type, 'ingestao_parada' tipo from events group by 1 having count(*) filter (ts > timestamp '2024-02-01 10:00:00' - interval 36 hours and event_id % 2 = 0) = 0 union all select 'todas', 'ingestao_parada' where (select count(*) from events where ts > timestamp '2024-03-01 00:00:00') = 0")
def watchdog_36h(spark, d):
    runs = v.table(spark, d, "events").select("event_type", F.col("ts").alias("terminado_em"), F.when(F.col("event_id") % 2 == 0, "ok").otherwise("falhou").alias("estado"))
    late = gate.watchdog(runs, v.as_of("2024-03-02 12:00:00")).select(F.lit("todas").alias("event_type"), "tipo")
    now = F.lit("2024-02-01 10:00:00").cast("timestamp_ntz")
    quiet = runs.groupBy("event_type").agg(F.count_if((F.col("estado") == "ok") & (F.col("terminado_em") > now - F.expr("interval 36 hours"))).alias("n")).where("n = 0").select("event_type", F.lit("ingestao_parada").alias("tipo"))
    return quiet.unionByName(late)


@query("select dia, sum(n)::bigint conflitos, string_agg(user_id || ' x' || n, chr(10) order by user_id) mensagem from (select strftime(ts, '%Y-%m-%d') dia, user_id, count(*) n from events group by all having count(*) >= 3) group by 1")
def conflict_alarm(spark, d):
    rows = v.table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("dia"), "user_id").agg(F.count("*").alias("n")).where("n >= 3")
    lines = F.sort_array(F.collect_list(F.struct("user_id", F.concat(F.col("user_id").cast("string"), F.lit(" x"), F.col("n").cast("string")).alias("l"))))
    return rows.groupBy("dia").agg(F.sum("n").alias("conflitos"), F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("mensagem"))


@query("""select event_id, user_id, round(coalesce(g, 0), 6) gasto_antes from (select event_id, user_id, sum(c) over w g, coalesce(bool_or(c is null) over w, false) u from
  (select event_id, user_id, case when event_id % 97 <> 0 then (event_id % 40)::double / 8 end c from events) window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding))
  where coalesce(g, 0) < 12 and not u""")
def budget_cutoff(spark, d):
    e = F.col("event_id")
    calls = v.table(spark, d, "events").select("event_id", "user_id", F.when(e % 97 != 0, (e % 40).cast("double") / 8).alias("custo"))
    return gate.within_budget(calls, "user_id", "event_id", "custo", 12.0).select("event_id", "user_id", F.round("gasto_antes", 6).alias("gasto_antes"))
