"""Records: fail-closed reading, and normalising extractions, plan rows and open notices into funds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import dates, text

#: Closed vocabularies of a record.
STATES = ["previsto", "aberto", "suspenso", "encerrado"]
TRI_STATE = ["sim", "nao", "desconhecido"]
LEVELS = ["alta", "media", "baixa"]
EVIDENCE = ["identificacao.referencia_legal", "estado", "dotacao_esgotada", "prazos.abertura", "prazos.encerramento", "beneficiarios.tipos", "beneficiarios.admite_particulares", "medidas"]
EXTRACTION = """struct<e_aviso:boolean, titulo:string, referencia:string, estado:struct<valor:string,confianca:string,evidencia:string>,
  encerramento:struct<data_iso:string,texto:string,confianca:string,evidencia:string>, admite:struct<valor:string,confianca:string,evidencia:string>,
  medidas:array<struct<medida:string,valor_max_eur:double>>>"""


#: The columns of a stored fund.
FUND = {
    "id": "string", "slug": "string", "source_id": "string", "titulo": "string", "resumo": "string", "programa_pai": "string", "entidade_gestora": "string", "referencia_legal": "string", "estado": "string", "dotacao_esgotada": "boolean",
    "abre_em": "timestamp", "abre_em_precisao": "string", "fecha_em": "timestamp", "fecha_em_precisao": "string", "beneficiarios": "array<string>", "admite_particulares": "string", "restricoes_beneficiario": "string", "ambito": "string",
    "municipios": "array<string>", "medidas": "array<string>", "medidas_por_classificar": "array<string>", "detalhe_apoios": "array<struct<medida:string,percentagem_apoio:double,valor_max_eur:double,unidade:string>>",
    "dotacao_total_eur": "double", "apoio_max_eur": "double", "url_oficial": "string", "url_candidatura": "string", "documentos": "array<struct<titulo:string,url:string,tipo:string>>", "needs_review": "boolean", "motivo_revisao": "array<string>",
    "confianca_global": "string", "publicado": "boolean", "alertavel": "boolean", "visto_pela_primeira_vez": "timestamp", "visto_pela_ultima_vez": "timestamp", "actualizado_em": "timestamp",
}
#: Columns that the store gives and an update never writes.
OWNED = ["id", "slug", "visto_pela_primeira_vez", "visto_pela_ultima_vez", "actualizado_em"]
_JSON = ["detalhe_apoios", "documentos"]


def one_of(value: Column, domain: list[str], default: str) -> Column:
    return F.when(F.coalesce(value.isin(domain), F.lit(False)), value).otherwise(default)


def read_closed(rows: DataFrame) -> DataFrame:
    """Stored rows with what is unknown read as the safe value: unknown tri-state, review needed unless it is plainly not."""
    return rows.withColumns({
        "admite": one_of(F.col("admite"), TRI_STATE, "desconhecido"),
        "needs_review": ~F.coalesce(F.col("needs_review") == F.lit(False), F.lit(False)),
        "alertavel": F.coalesce("alertavel", F.lit(False)),
        "publicado": F.coalesce("publicado", F.lit(False)),
        "beneficiarios": F.coalesce("beneficiarios", F.array().cast("array<string>")),
    })


def stored_fund(rows: DataFrame) -> DataFrame:
    """Rows of the store as funds of all columns, lists of objects read from JSON; what is missing or unknown is the safe value."""
    types = dict(rows.dtypes)

    def read(c: str) -> Column:
        if c not in types:
            return F.lit(None).cast(FUND[c])
        return F.from_json(c, FUND[c]) if c in _JSON and types[c] == "string" else F.col(c).cast(FUND[c])

    out = {c: read(c) for c in FUND}
    out |= {c: F.coalesce(out[c], F.array().cast(t)) for c, t in FUND.items() if t.startswith("array")}
    out |= {c: F.coalesce(out[c], F.lit(False)) for c in ("dotacao_esgotada", "publicado", "alertavel")}
    safe = {"estado": "desconhecido", "ambito": "desconhecido", "abre_em_precisao": "desconhecida", "fecha_em_precisao": "desconhecida", "confianca_global": "baixa"}
    out |= {c: F.coalesce(out[c], F.lit(v)) for c, v in safe.items()}
    out |= {"admite_particulares": one_of(out["admite_particulares"], ["sim", "nao"], "desconhecido"), "needs_review": F.coalesce(out["needs_review"], F.lit(True))}
    return rows.select(*[v.alias(c) for c, v in out.items()])


def fund_row(funds: DataFrame) -> DataFrame:
    """Funds as rows to write: without the columns that the store owns, lists of objects as JSON."""
    return funds.select(*[F.to_json(c).alias(c) if c in _JSON else F.col(c) for c in FUND if c not in OWNED])


def parse_extraction(reply: Column) -> Column:
    """The typed extraction of a model's reply, or null where it is no JSON or breaks the vocabularies."""
    e = F.from_json(text.json_of_reply(reply), EXTRACTION)
    fine = e["e_aviso"].isNotNull() & e["titulo"].isNotNull() & e["estado"]["valor"].isin(STATES) & e["admite"]["valor"].isin(TRI_STATE) & e["estado"]["confianca"].isin(LEVELS) & e["admite"]["confianca"].isin(LEVELS)
    return F.when(F.coalesce(fine, F.lit(False)), e)


def evidence(e: Column) -> Column:
    """array<struct<caminho, confianca, evidencia>> of an extraction."""
    row = lambda path, x: F.struct(F.lit(path).alias("caminho"), x["confianca"].alias("confianca"), x["evidencia"].alias("evidencia"))
    return F.array(row("estado", e["estado"]), row("prazos.encerramento", e["encerramento"]), row("beneficiarios.admite_particulares", e["admite"]))


def fund_of_extraction(rows: DataFrame, extraction: str = "e") -> DataFrame:
    """Extractions as funds: our own reading of the date's text first, the model's ISO date second, never more precise."""
    e = F.col(extraction)
    ours = dates.parse_date(e["encerramento"]["texto"], closing=True)
    theirs = dates.parse_date(e["encerramento"]["data_iso"], closing=True)
    known = F.when(ours["at"].isNotNull(), ours).when(theirs["at"].isNotNull(), theirs)
    return rows.withColumn("_d", known).select(
        "*", text.squeeze(e["titulo"]).alias("titulo"), text.legal_reference(e["referencia"]).alias("referencia_legal"), e["estado"]["valor"].alias("estado"), F.col("_d.at").alias("fecha_em"), F.coalesce("_d.precisao", F.lit("desconhecida")).alias("fecha_em_precisao"),
        e["admite"]["valor"].alias("admite"), F.array_sort(F.array_distinct(F.transform(e["medidas"], lambda m: m["medida"]))).alias("medidas"), F.array_max(F.transform(e["medidas"], lambda m: m["valor_max_eur"])).alias("apoio_max_eur"),
    ).drop("_d")


def fund_of_plan(rows: DataFrame) -> DataFrame:
    """Plan rows (map ``valores``) as planned funds that never alert; a deadline is the end of its day."""
    v = lambda k: text.blank_to_null(F.col("valores")[k])
    who = text.beneficiary_of_plan(F.coalesce(v("Tipo Ent. Beneficiária"), F.lit("")))
    day = lambda k: dates.excel_date(v(k).try_cast("double"))
    end = dates.lisbon_to_utc(F.concat(F.date_format(day("Data Fim Prevista"), "yyyy-MM-dd"), F.lit(" 23:59:59")))
    return rows.select(
        v("ID").alias("codigo"), text.squeeze(v("Designacao do Aviso")).alias("titulo"), F.lit("previsto").alias("estado"), F.lit(False).alias("alertavel"), dates.lisbon_to_utc(day("Data Inicio Prevista")).alias("abre_em"), end.alias("fecha_em"),
        who["tipos"].alias("beneficiarios"), who["admite"].alias("admite"), text.split_list(F.coalesce(v("NUTS II"), F.lit(""))).alias("regioes"), text.summary(v("Programa"), v("Objetivo Especifico"), v("Fundo")).alias("resumo"),
    ).where("titulo is not null")


def fund_of_notice(rows: DataFrame, base_url: str) -> DataFrame:
    """Open notices of the JSON source as open funds without measures, each with a url of its own."""
    end = dates.lisbon_to_utc(F.concat(F.date_format("fecha", "yyyy-MM-dd"), F.lit(" 23:59:59")))
    return rows.select("codigo", "titulo", F.lit("aberto").alias("estado"), F.lit(False).alias("alertavel"), F.col("dotacao").alias("dotacao_total_eur"), end.alias("fecha_em"), F.array().cast("array<string>").alias("medidas"), F.concat(F.lit(f"{base_url}?aviso="), F.url_encode("codigo")).alias("url_oficial"))


def review_marks(rows: DataFrame, reference: str, document: str) -> DataFrame:
    """Drops a reference that lost its prefix in the document, and marks documents that hold several notices."""
    lost = text.lost_prefix(F.col(reference), F.col(document))
    codes = F.size(text.notice_codes(F.col(document)))
    return rows.withColumn("motivo", F.when(codes > 1, F.concat(F.lit("avisos_por_capturar:"), codes.cast("string")))).withColumn(reference, F.when(lost.isNull(), F.col(reference)))


def medians(runs: DataFrame, group: str, counts: str = "candidatos") -> DataFrame:
    """(group, mediana) of the counts of its runs: the middle one, or the mean of the two in the middle."""
    return runs.groupBy(group).agg(F.median(counts).cast("double").alias("mediana"))


def history(runs: DataFrame, group: str, order: str, size: int = 7) -> DataFrame:
    """Per run: median of the counts before it, failures in a row before it."""
    w = Window.partitionBy(group).orderBy(order)
    before = w.rowsBetween(-size, -1)
    rows = runs.withColumn("base", F.array_sort(F.collect_list("candidatos").over(before)))
    n = F.size("base")
    middle = lambda i: F.get("base", F.floor(i).cast("int"))
    rows = rows.withColumn("base", F.when(n > 0, (middle((n - 1) / 2) + middle(n / 2)) / 2).otherwise(0.0))
    good = F.sum(F.when(F.col("erro").isNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_run", F.coalesce(good, F.lit(0)))
    failed = F.sum(F.when(F.col("erro").isNotNull(), 1).otherwise(0)).over(Window.partitionBy(group, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("falhas_antes", F.coalesce(failed, F.lit(0))).drop("_run")


def slug(title: Column, key: Column) -> Column:
    return F.concat(F.regexp_replace(text.title_key(title), "[^a-z0-9-]", ""), F.lit("-"), F.substring(F.sha2(key, 256), 1, 8))


def natural_id(*parts: Column) -> Column:
    """A stable identifier from a natural key, so that retries agree."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)



def hours_unchanged(runs: DataFrame, group: str, at: str, digest: str) -> DataFrame:
    """``runs`` with horas_sem_mudanca: hours since the content last differed from that of the run before, or was first seen."""
    w = Window.partitionBy(group).orderBy(at)
    moved = ~F.col(digest).eqNullSafe(F.lag(digest).over(w)) | (F.row_number().over(w) == 1)
    since = F.last(F.when(F.col("_moved"), F.col(at)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("_moved", moved).withColumn("horas_sem_mudanca", (F.unix_timestamp(at) - F.unix_timestamp(since)) / 3600).drop("_moved")
