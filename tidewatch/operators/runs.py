"""Runs and what they leave behind: opening and closing, processed captures, audit and health rows, metrics, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .model_calls import without_request

#: The columns of an audit row of a model call and of a health row of a source.
AUDIT = ["fund_id", "modelo", "versao_prompt", "versao_esquema", "bruto", "confianca_campos", "evidencia_falhou", "tokens_entrada", "tokens_saida", "tokens_cache_lidos", "tokens_cache_escritos", "custo_usd", "stop_reason"]
HEALTH = ["run_id", "source_id", "http_status", "bytes", "duracao_ms", "candidatos", "candidatos_ignorados", "candidatos_com_data", "extraccoes_ok", "extraccoes_revisao", "provas_falhadas", "tokens_cache_lidos", "erro"]


def opened(starts: DataFrame, now: Column) -> DataFrame:
    """Rows of the run table for runs that begin (run_id, git_sha): at work, without end and summary."""
    return starts.select("run_id", "git_sha", F.lit("a_correr").alias("estado"), now.alias("iniciado_em"), F.lit(None).cast("timestamp").alias("terminado_em"), F.lit(None).cast("string").alias("resumo"))


def closed(runs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The run table once runs ended (run_id, estado, resumo); others stay, and an outcome of no known run adds none."""
    ended = outcomes.select("run_id", F.col("estado").alias("_estado"), F.col("resumo").alias("_resumo"), F.lit(True).alias("_fim"))
    pick = lambda new, old: F.when(F.col("_fim"), new).otherwise(F.col(old)).alias(old)
    values = {"estado": F.col("_estado"), "resumo": F.col("_resumo"), "terminado_em": now}
    return runs.join(ended, "run_id", "left").select(*[pick(values[c], c) if c in values else F.col(c) for c in runs.columns])


def processed(snapshots: DataFrame, done: DataFrame) -> DataFrame:
    """The capture table with ``processado`` set where exactly this url and content were read, whatever is newest."""
    keys = done.select("url", "hash").distinct().withColumn("_feito", F.lit(True))
    flag = F.coalesce("processado", F.lit(False)) | F.coalesce("_feito", F.lit(False))
    return snapshots.join(keys, ["url", "hash"], "left").select(*[flag.alias(c) if c == "processado" else F.col(c) for c in snapshots.columns])


def appended(rows: DataFrame, columns: list[str], path: str) -> None:
    """Appends audit or health rows as they are: equal rows are different calls and both stay."""
    rows.select(*columns).write.mode("append").parquet(path)


def affected(statements: dict[str, DataFrame]) -> DataFrame:
    """(instrucao, linhas): how many rows each statement writes, and under null all of them."""
    counts = [rows.agg(F.count("*").alias("linhas")).select(F.lit(name).alias("instrucao"), "linhas") for name, rows in statements.items()]
    return reduce(DataFrame.unionByName, counts).rollup("instrucao").agg(F.sum("linhas").alias("linhas"))


def metrics(fetches: DataFrame, candidates: DataFrame, calls: DataFrame) -> DataFrame:
    """One row a source of ``fetches``, from what it read, found and had extracted.

    ``fetches``: source_id, ordem, http_status, bytes, duracao_ms, erro (the last status and error count). ``candidates``:
    source_id and the flags ignorado, com_data, adiado, nao_pdf, mudado. ``calls``: source_id, erro, needs_review,
    provas_falhadas, tokens_cache_lidos, custo_usd; a call of unknown price adds nothing.
    """
    read = fetches.groupBy("source_id").agg(F.max_by("http_status", "ordem").alias("http_status"), F.sum("bytes").alias("bytes"), F.sum("duracao_ms").alias("duracao_ms"), F.max_by("erro", "ordem").alias("erro"))
    found = candidates.groupBy("source_id").agg(
        F.count("*").alias("candidatos"), F.count_if("ignorado").alias("candidatos_ignorados"), F.count_if("com_data").alias("candidatos_com_data"), F.count_if("adiado").alias("extraccoes_adiadas_por_tecto"),
        F.count_if("nao_pdf").alias("documentos_que_nao_sao_pdf"), F.count_if("mudado").alias("documentos_mudados"),
    )
    fine, review = F.col("erro").isNull(), F.coalesce("needs_review", F.lit(True))
    said = calls.groupBy("source_id").agg(
        F.count("*").alias("chamadas_modelo"), F.count_if(fine & ~review).alias("extraccoes_ok"), F.count_if(fine & review).alias("extraccoes_revisao"), F.count_if(~fine).alias("extraccoes_falhadas"),
        F.array_sort(F.collect_set(without_request(F.col("erro")))).alias("erros_extraccao"), F.sum("provas_falhadas").alias("provas_falhadas"), F.sum("tokens_cache_lidos").alias("tokens_cache_lidos"), F.sum("custo_usd").alias("custo_usd"),
    )
    rows = read.join(found, "source_id", "left").join(said, "source_id", "left")
    numbers = [c for c in (*found.columns, *said.columns) if c not in ("source_id", "erros_extraccao")]
    return rows.fillna(0, numbers).withColumn("erros_extraccao", F.coalesce("erros_extraccao", F.array().cast("array<string>")))


def redecision(stored: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """One row: how many decisions were read, would change, would publish or hide a fund, and couldn't be read.

    ``decided`` has a row for each fund that was read, with nulls where its extraction is unreadable.
    """
    new = decided.select(key, F.col("publicado").alias("_p"), F.col("alertavel").alias("_a"))
    legible = F.col("_p").isNotNull()
    moved = legible & ~(F.col("publicado").eqNullSafe(F.col("_p")) & F.col("alertavel").eqNullSafe(F.col("_a")))
    was = F.coalesce("publicado", F.lit(False))
    return stored.select(key, "publicado", "alertavel").join(new, key).agg(
        F.count("*").alias("lidos"), F.count_if(moved).alias("alterados"), F.count_if(moved & F.col("_p") & ~was).alias("publicados_agora"),
        F.count_if(moved & ~F.col("_p") & was).alias("despublicados_agora"), F.count_if(~legible).alias("ilegiveis"),
    )


def conflict_alarm(runs: DataFrame, alarms: DataFrame) -> DataFrame:
    """The alarm of the last good run (terminado_em, resumo JSON) that names identity conflicts, at most one row.

    None where an alarm of this kind is as young as the run: what was resolved by hand isn't raised again for the same run.
    """
    kind = "conflitos_de_identidade"
    last = runs.where("estado = 'ok' and terminado_em is not null").orderBy(F.desc("terminado_em")).limit(1)
    told = alarms.where(F.col("tipo") == kind).groupBy("tipo").agg(F.max("criado_em").alias("_dito"))
    summary = F.from_json("resumo", "struct<fontes:array<struct<fonte:string,conflitos:array<string>>>>")
    rows = last.select("terminado_em", F.lit(kind).alias("tipo"), F.filter(summary["fontes"], lambda f: F.size(F.coalesce(f["conflitos"], F.array().cast("array<string>"))) > 0).alias("fontes"))
    rows = rows.join(told, "tipo", "left").where(F.col("_dito").isNull() | (F.col("_dito") < F.col("terminado_em")))
    lines = F.flatten(F.transform(F.array_sort("fontes"), lambda f: F.transform(f["conflitos"], lambda c: F.concat(f["fonte"], F.lit(": "), c))))
    return rows.select("tipo", F.size(lines).cast("long").alias("conflitos"), F.array_join(lines, "\n").alias("mensagem")).where("conflitos > 0")
