"""Evidence, the publication gate, the differ of versions, health rules, watchdogs and cost ceilings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text, urls

CRITICAL = ["estado", "prazos.encerramento", "beneficiarios.admite_particulares"]
LEVELS = ["baixa", "media", "alta"]


def quoted(document: Column, quote: Column) -> Column:
    """Whether a document holds a quote word for word, accents, case and spaces aside; an empty quote doesn't fail."""
    q = text.comparable(F.coalesce(quote, F.lit("")))
    return (q == "") | F.coalesce(text.comparable(document).contains(q), F.lit(False))


def lowest(*levels: Column) -> Column:
    rank = lambda c: F.array_position(F.array(*map(F.lit, LEVELS)), c)
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.least(*[rank(c).cast("int") for c in levels]))


#: Fields whose confidence doesn't count for the whole.
APART = ["dotacao_esgotada"]


def overall(levels: Column) -> Column:
    """The lowest of a map of confidences by path, those ``APART`` left out; ``alta`` where none is left, as unknown levels say nothing."""
    counted = F.map_values(F.map_filter(levels, lambda path, _: ~path.isin(APART)))
    return F.when(F.array_contains(counted, "baixa"), "baixa").when(F.array_contains(counted, "media"), "media").otherwise("alta")


def decide(rows: DataFrame, now: Column) -> DataFrame:
    """publicado, alertavel, needs_review, motivos and global confidence from an extraction.

    Needs: recusa, e_aviso, provas_falhadas (array), conf_estado, conf_encerramento, conf_admite, ocr_ma, admite, condominio,
    estado, prazo (date or null; an empty text counts as null). With confianca_efectiva, a map of all paths, the global
    confidence is that of all of them, else of the three fields.
    """
    doubtful = F.array_compact(F.array(*[F.when(F.col(c) != "alta", F.lit(n)) for c, n in zip(("conf_estado", "conf_encerramento", "conf_admite"), CRITICAL, strict=True)]))
    door = (F.col("admite") == "sim") | (F.col("admite") == "nao") & F.col("condominio")
    incoherent = (F.col("estado") == "encerrado") & (F.col("prazo") > now)
    whole = overall(F.col("confianca_efectiva")) if "confianca_efectiva" in rows.columns else lowest(F.col("conf_estado"), F.col("conf_encerramento"), F.col("conf_admite"))
    reasons = F.array_compact(F.array(
        F.when(F.col("recusa"), "recusa_do_modelo"),
        F.when(~F.col("e_aviso"), "nao_e_aviso_de_apoio"),
        F.when(F.size("provas_falhadas") > 0, F.concat(F.lit("prova_falhou:"), F.array_join("provas_falhadas", ","))),
        F.when(F.size(doubtful) > 0, F.concat(F.lit("confianca_insuficiente:"), F.array_join(doubtful, ","))),
        F.when(F.col("ocr_ma"), "ocr_ma"),
        F.when(~door, F.concat(F.lit("admite_particulares:"), F.col("admite"))),
        F.when(incoherent, F.concat(F.lit("estado_incoerente:encerrado_com_prazo_"), F.date_format("prazo", "yyyy-MM-dd"))),
    ))
    strict = F.col("recusa") | ~F.col("e_aviso") | (whole == "baixa")
    history = F.coalesce((F.col("estado") == "encerrado") & (F.col("conf_estado") != "baixa") & (F.col("conf_encerramento") == "alta") & (F.col("prazo") <= now), F.lit(False))
    return rows.withColumn("motivos", reasons).withColumn("confianca_global", whole).withColumn("publicado", ~(strict & ~history)).withColumn("alertavel", (F.size("motivos") == 0) & ~strict).withColumn("needs_review", F.size("motivos") > 0)


def changed_decisions(stored: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """Rows of ``decided`` that differ from what is stored; unreadable ones (no decision) are left alone."""
    new = decided.select(key, *[F.col(c).alias(f"n_{c}") for c in ("publicado", "alertavel")])
    rows = stored.join(new, key).where("n_publicado is not null")
    return rows.where(~(F.col("publicado").eqNullSafe(F.col("n_publicado")) & F.col("alertavel").eqNullSafe(F.col("n_alertavel")))).select(key, F.col("n_publicado").alias("publicado"), F.col("n_alertavel").alias("alertavel"))


def gathered(paths: dict[str, DataFrame]) -> DataFrame:
    """The events of all paths, in the order given, with ``caminho``: an event that several paths tell of is the first one's."""
    parts = [events.select("*", F.lit(name).alias("caminho"), F.lit(i).alias("_i")) for i, (name, events) in enumerate(paths.items())]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    names = [c for c in rows.columns if c not in ("impressao", "_i")]
    first = rows.groupBy("impressao").agg(F.min_by(F.struct(*names), "_i").alias("_e"))
    return first.select("impressao", "_e.*")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events between two versions of funds, each with its fingerprint; a new fund has no row in ``before``.

    A budget or deadline that was null before is no event, nor is a change of wording.
    """
    old = before.select("fund_id", *[F.col(c).alias(f"o_{c}") for c in before.columns if c != "fund_id"])
    rows = after.join(old, "fund_id", "left")
    fresh, was, now = F.col("o_estado").isNull(), F.col("o_estado"), F.col("estado")
    precise = F.col("precisao").isin("minuto", "dia") & F.col("o_precisao").isin("minuto", "dia")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    event = lambda test, kind, definer, alert: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("tipo"), definer.alias("definidor"), alert.alias("alerta")))
    own, yes, no = F.col("alertavel"), F.lit(True), F.lit(False)
    found = F.array_compact(F.array(
        event(fresh & (now != "encerrado"), "programa_novo", F.lit("{}"), own),
        event((was == "previsto") & (now == "aberto"), "abriu", F.lit('{"de":"previsto"}'), own),
        event((was == "encerrado") & (now == "aberto"), "reaberto", F.lit('{"de":"encerrado"}'), own),
        event((was == "aberto") & (now == "encerrado"), "encerrou", F.lit('{"de":"aberto"}'), no),
        event(precise & (F.col("fecha_em") != F.col("o_fecha_em")), "prazo_alterado", F.format_string('{"de":"%s","para":"%s","prolongado":%s}', day("o_fecha_em"), day("fecha_em"), (F.col("fecha_em") > F.col("o_fecha_em")).cast("string")), own),
        event(~F.col("o_dotacao_esgotada") & F.col("dotacao_esgotada"), "dotacao_esgotada", F.lit("{}"), yes),
        event(F.col("dotacao") > F.col("o_dotacao"), "reforco_dotacao", F.lit("{}"), own),
        event((F.col("o_admite") != "sim") & (F.col("admite") == "sim"), "elegibilidade_alterada", F.lit('{"abriuAParticulares":true}'), yes),
        event((F.col("o_admite") == "sim") & (F.col("admite") != "sim"), "elegibilidade_alterada", F.lit('{"abriuAParticulares":false}'), no),
    ))
    return rows.select("fund_id", F.explode(found).alias("e")).select("fund_id", "e.*").withColumn("impressao", urls.fingerprint(F.col("fund_id"), F.col("tipo"), F.col("definidor")))


def health(runs: DataFrame, minimum: int = 20, cadence_hours: int = 24) -> DataFrame:
    """One row per alarm of a run. Needs the run's metrics and its history: median (``base``), failures before, hours unchanged."""
    c = F.col
    fine = c("erro").isNull()
    total = c("extraccoes_ok") + c("extraccoes_revisao")
    rule = lambda test, name, grave: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("regra"), grave.alias("gravidade")))
    bad, warn = F.lit("critico"), F.lit("aviso")
    none, few, drop = (c("candidatos") == 0) & (c("base") > 0), c("candidatos") < minimum, (c("base") > 0) & (c("candidatos") < c("base") * 0.4)
    found = F.array_compact(F.array(
        rule(~fine & (c("falhas_antes") >= 1), "falhas_consecutivas", bad),
        rule(fine & none, "zero_candidatos", bad),
        rule(fine & ~none & few, "abaixo_do_minimo", bad),
        rule(fine & ~none & ~few & drop, "queda_de_candidatos", warn),
        rule(fine & (c("candidatos") > 0) & (c("com_data") == 0), "sem_datas", warn),
        rule(c("horas_sem_mudanca") > 21 * cadence_hours, "conteudo_congelado", warn),
        rule(c("adiadas") > 0, "tecto_de_custo_atingido", warn),
        rule(c("falhadas") > 0, "extraccoes_falhadas", F.when(c("falhadas") == c("chamadas"), "critico").otherwise("aviso")),
        rule((total > 0) & (c("extraccoes_revisao") > 0.4 * total), "muitas_revisoes", warn),
        rule((total > 0) & (c("provas_falhadas") > 0.2 * total), "provas_falhadas", bad),
        rule((c("chamadas") > 1) & (c("cache_lida") == 0), "cache_nao_lida", warn),
    ))
    return runs.select("run_id", F.explode(found).alias("a")).select("run_id", "a.*")


def run_status(alarms: DataFrame, runs: DataFrame) -> DataFrame:
    """falhou on a critical alarm, parcial on an error of a source, else ok."""
    worst = alarms.groupBy("run_id").agg(F.bool_or(F.col("gravidade") == "critico").alias("critico"))
    return runs.join(worst, "run_id", "left").select("run_id", F.when(F.coalesce("critico", F.lit(False)), "falhou").when(F.col("erro").isNotNull(), "parcial").otherwise("ok").alias("estado"))


def watchdog(runs: DataFrame, now: Column, hours: int = 36, alarms: DataFrame | None = None) -> DataFrame:
    """One alarm where no run ended well in the last hours; none else, nor while one of ``alarms`` (tipo, resolvido_em) is open."""
    good = runs.where((F.col("estado") == "ok") & (F.col("terminado_em") > now - F.expr(f"interval {hours} hours")))
    raised = good.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("ingestao_parada").alias("tipo"))
    return raised if alarms is None else raised.join(alarms.where("resolvido_em is null").select("tipo"), "tipo", "left_anti")


def within_budget(calls: DataFrame, group: str, order: str, cost: str, ceiling: float) -> DataFrame:
    """Calls made in order while the sum so far is under the ceiling: the last one may overshoot. Unpriced calls stop it."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(cost).over(w), F.lit(0.0))
    unknown = F.coalesce(F.bool_or(F.col(cost).isNull()).over(w), F.lit(False))
    return calls.withColumn("gasto_antes", spent).withColumn("_u", unknown).where((F.col("gasto_antes") < ceiling) & ~F.col("_u")).drop("_u")


def batch_size(documents: int, ceiling: float, expected: float | None) -> int:
    return min(documents, int(ceiling // expected)) if expected and expected > 0 else 0
