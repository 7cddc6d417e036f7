"""The whole extraction that a model returns: its type, its validation, trimming, evidence, and the fund it describes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, money, text
from .records import EVIDENCE, LEVELS, STATES, TRI_STATE


def _claim(kind: str) -> str:
    return f"struct<valor:{kind}, confianca:string, evidencia:string>"


_DATE = "struct<texto_fonte:string, data_iso:string, precisao:string>"
#: The fields of an extraction. Absent text is empty, absent numbers and truth values are null.
SCHEMA = f"""struct<schema_version:string,
  identificacao:struct<titulo:string, referencia_legal:{_claim("string")}, programa_pai:string, entidade_gestora:string, resumo_pt:string>,
  estado:{_claim("string")}, dotacao_esgotada:{_claim("boolean")}, prazos:struct<abertura:{_claim(_DATE)}, encerramento:{_claim(_DATE)}>,
  beneficiarios:struct<tipos:{_claim("array<string>")}, admite_particulares:{_claim("string")}, restricoes_texto:string>,
  ambito:struct<nivel:string, municipios:array<string>, observacoes:string>,
  medidas:{_claim("array<struct<medida:string, percentagem_apoio:double, valor_max_eur:double, unidade:string>>")}, medidas_nao_classificadas:array<string>,
  dotacao:struct<total_texto:string, total_eur:double, apoio_max_por_beneficiario_eur:double>, candidatura:struct<url:string, plataforma:string>,
  documentos:array<struct<titulo:string, url:string, tipo:string>>, avisos_importantes:array<string>,
  auto_avaliacao:struct<documento_e_aviso_de_apoio:boolean, qualidade_ocr:string, notas:string>>"""
#: The closed vocabularies, and how long texts and lists may be.
PRECISIONS = ["minuto", "dia", "mes", "desconhecida"]
DOMAINS = {
    "estado.valor": [*STATES, "desconhecido"], "prazos.abertura.valor.precisao": PRECISIONS, "prazos.encerramento.valor.precisao": PRECISIONS, "beneficiarios.admite_particulares.valor": TRI_STATE,
    "ambito.nivel": ["nacional", "continente", "regiao_autonoma", "nuts", "distrito", "municipio", "desconhecido"], "auto_avaliacao.qualidade_ocr": ["boa", "media", "ma", "nao_aplicavel"],
}
LONGEST = {"identificacao.resumo_pt": 600} | {f"{p}.evidencia": 400 for p in EVIDENCE}
MOST = {"beneficiarios.tipos.valor": 11, "ambito.municipios": 308, "medidas.valor": 40, "medidas_nao_classificadas": 20, "documentos": 30, "avisos_importantes": 10}
REQUIRED = ["identificacao.titulo", "auto_avaliacao.documento_e_aviso_de_apoio", *LONGEST, *MOST, *DOMAINS]


def at(e: Column, path: str) -> Column:
    return reduce(lambda c, name: c[name], path.split("."), e)


def parse(reply: Column) -> Column:
    """The typed extraction of a model's reply; null where it holds no JSON object."""
    return F.from_json(text.json_of_reply(reply), SCHEMA)


def _cut(c: Column, limits: dict[str, int]) -> Column:
    """A struct with texts cut to limits by path; every part is read from the struct itself, so the expression stays small."""
    out = c
    for name in dict.fromkeys(p.split(".")[0] for p in limits):
        inner = {p.partition(".")[2]: n for p, n in limits.items() if p.split(".")[0] == name}
        out = out.withField(name, F.substring(c[name], 1, inner[""]) if "" in inner else _cut(c[name], inner))
    return out


def trimmed(e: Column) -> Column:
    """struct<e, aparados>: texts that are too long cut to their limit, and the paths of those; nothing else is mended."""
    return F.struct(_cut(e, LONGEST).alias("e"), F.array_compact(F.array(*[F.when(F.length(at(e, p)) > n, F.lit(p)) for p, n in LONGEST.items()])).alias("aparados"))


def problems(e: Column, measures: list[str] | None = None, kinds: list[str] | None = None) -> Column:
    """The paths of an extraction that are missing or break a vocabulary or limit, sorted; empty where it is valid.

    ``measures`` and ``kinds`` are the vocabularies of measures and beneficiaries, where they are to be held to.
    """
    outside = lambda values, domain: F.exists(values, lambda x: F.coalesce(~x.isin(domain), F.lit(True)))
    found = [F.when(at(e, p).isNull(), F.lit(p)) for p in REQUIRED]
    found += [F.when(F.coalesce(~at(e, f"{p}.confianca").isin(LEVELS), F.lit(True)), F.lit(f"{p}.confianca")) for p in EVIDENCE]
    found += [F.when(~at(e, p).isin(d), F.lit(p)) for p, d in DOMAINS.items()]
    found += [F.when(F.length(at(e, p)) > n, F.lit(p)) for p, n in LONGEST.items()] + [F.when(F.size(at(e, p)) > n, F.lit(p)) for p, n in MOST.items()]
    if measures is not None:
        found.append(F.when(outside(F.transform(e["medidas"]["valor"], lambda m: m["medida"]), measures), F.lit("medidas.valor")))
    if kinds is not None:
        found.append(F.when(outside(e["beneficiarios"]["tipos"]["valor"], kinds), F.lit("beneficiarios.tipos.valor")))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def evidence(e: Column) -> Column:
    """array<struct<caminho, confianca, evidencia>>: the claims of an extraction that carry a quote."""
    return F.array(*[F.struct(F.lit(p).alias("caminho"), at(e, p)["confianca"].alias("confianca"), at(e, p)["evidencia"].alias("evidencia")) for p in EVIDENCE])


def verified(rows: DataFrame, claims: str, document: str) -> DataFrame:
    """``rows`` with provas_falhadas (paths whose quote the document lacks), sem_prova (paths without a quote) and confianca_efectiva.

    The last maps each path to its confidence, which is ``baixa`` where the quote failed; no quote is no failure.
    """
    source = text.comparable(F.coalesce(document, F.lit("")))
    blank = lambda c: F.coalesce(F.trim(c["evidencia"]) == "", F.lit(True))
    judged = F.transform(claims, lambda c: F.struct(c["caminho"].alias("p"), c["confianca"].alias("c"), blank(c).alias("blank"), (~blank(c) & ~F.col("_source").contains(text.comparable(c["evidencia"]))).alias("failed")))
    rows = rows.withColumn("_source", source).withColumn("_judged", judged)
    paths = lambda flag: F.transform(F.filter("_judged", lambda x: x[flag]), lambda x: x["p"])
    sure = F.map_from_entries(F.transform("_judged", lambda x: F.struct(x["p"], F.when(x["failed"], "baixa").otherwise(x["c"]))))
    return rows.withColumns({"provas_falhadas": paths("failed"), "sem_prova": paths("blank"), "confianca_efectiva": sure}).drop("_source", "_judged")


def _date(d: Column, closing: bool) -> Column:
    """struct<at, precisao>: our own reading of the text first; else the model's day, no more precise than the model says it is."""
    given = lambda at_, kind: F.struct(at_.alias("at"), kind.alias("precisao"))
    kind = lambda t: F.when(t["at"].isNull(), "desconhecida").when(d["precisao"] == "desconhecida", t["precisao"]).otherwise(d["precisao"])
    theirs = text.let(dates.parse_date(d["data_iso"], closing), lambda t: given(t["at"], kind(t)))
    return text.let(dates.parse_date(d["texto_fonte"], closing), lambda t: F.when(t["at"].isNotNull(), given(t["at"], t["precisao"])).otherwise(theirs))


def fund(rows: DataFrame, extraction: str = "e") -> DataFrame:
    """``rows`` with the columns of a fund that a valid extraction gives."""
    e = F.col(extraction)
    rows = rows.withColumns({"_abre": _date(e["prazos"]["abertura"]["valor"], False), "_fecha": _date(e["prazos"]["encerramento"]["valor"], True)})
    who, total = e["identificacao"], e["dotacao"]
    measures = e["medidas"]["valor"]
    detail = F.transform(measures, lambda m: F.struct(m["medida"].alias("medida"), m["percentagem_apoio"].alias("percentagem_apoio"), m["valor_max_eur"].alias("valor_max_eur"), text.blank_to_null(m["unidade"]).alias("unidade")))
    return rows.withColumns({
        "titulo": who["titulo"], "resumo": who["resumo_pt"], "programa_pai": text.blank_to_null(who["programa_pai"]), "entidade_gestora": text.blank_to_null(who["entidade_gestora"]),
        "referencia_legal": text.legal_reference(text.blank_to_null(who["referencia_legal"]["valor"])), "estado": e["estado"]["valor"], "dotacao_esgotada": F.coalesce(e["dotacao_esgotada"]["valor"], F.lit(False)),
        "abre_em": F.col("_abre.at"), "abre_em_precisao": F.col("_abre.precisao"), "fecha_em": F.col("_fecha.at"), "fecha_em_precisao": F.col("_fecha.precisao"),
        "beneficiarios": e["beneficiarios"]["tipos"]["valor"], "admite_particulares": e["beneficiarios"]["admite_particulares"]["valor"], "restricoes_beneficiario": text.blank_to_null(e["beneficiarios"]["restricoes_texto"]),
        "ambito": e["ambito"]["nivel"], "municipios": e["ambito"]["municipios"], "medidas": F.array_distinct(F.transform(measures, lambda m: m["medida"])), "medidas_por_classificar": e["medidas_nao_classificadas"], "detalhe_apoios": detail,
        "dotacao_total_eur": F.coalesce(total["total_eur"], money.amount(total["total_texto"]).cast("double")), "apoio_max_eur": F.coalesce(total["apoio_max_por_beneficiario_eur"], F.array_max(F.transform(measures, lambda m: m["valor_max_eur"]))),
        "url_candidatura": text.blank_to_null(e["candidatura"]["url"]), "documentos": e["documentos"],
    }).drop("_abre", "_fecha")
