"""Model calls as joins with recorded results: one request per distinct document, every document answered, costs by rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import money, urls
from . import extraction


def request_key(model: str, prompt: str, schema: str, document: Column) -> Column:
    """32 hex characters of model, prompt version, schema version and the document's hash."""
    return urls.cassette_key(F.lit(model), F.lit(prompt), F.lit(schema), F.sha2(document, 256))


def requests(documents: DataFrame, model: str, prompt: str, schema: str, document: str = "text") -> DataFrame:
    """(chave, text) with one row a key: equal documents are asked once."""
    return documents.select(request_key(model, prompt, schema, F.col(document)).alias("chave"), F.col(document)).dropDuplicates(["chave"])


def answered(documents: DataFrame, recorded: DataFrame, model: str, prompt: str, schema: str, document: str = "text") -> DataFrame:
    """Each document with its recorded answer and an outcome; a missing record is an error row of no cost, never a gap."""
    keyed = documents.withColumn("chave", request_key(model, prompt, schema, F.col(document)))
    rows = keyed.join(recorded.select("chave", "resposta", "fim"), "chave", "left")
    outcome = F.when(F.col("fim").isNull(), "sem_registo").when(F.col("fim") == "refusal", "recusa").when(F.col("fim") == "max_tokens", "cortada").when(F.col("resposta").isNull(), "vazia").otherwise("ok")
    return rows.withColumn("resultado", outcome)


#: How long a batch is waited for, and what becomes of a request that wasn't answered.
WAIT = "interval 2 hours"
UNANSWERED = {"canceled": "lote: pedido cancelado", "expired": "lote: pedido expirou sem resposta"}


def batch_states(batches: DataFrame, now: Column) -> DataFrame:
    """Batches (lote, processing_status, criado_em) with ``estado``: terminado, a_processar, or demorado where they are waited for too long."""
    ended = F.coalesce(F.col("processing_status") == "ended", F.lit(False))
    return batches.withColumn("estado", F.when(ended, "terminado").when(F.col("criado_em") + F.expr(WAIT) < now, "demorado").otherwise("a_processar"))


def interpreted(rows: DataFrame, measures: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Answers (fim, resposta, tipo, erro_tipo, erro_mensagem) with e (the extraction), aparados, problemas and erro, the reason why there is none.

    ``tipo`` is the kind of a batch's row: only ``succeeded`` holds an answer; a kind that isn't known counts as a failure, and
    no row at all (null) as one that isn't in the batch. Too long texts are cut; any other breach of the schema fails.
    """
    reply = F.when(F.col("tipo") == "succeeded", F.col("resposta"))
    # The reply is parsed in a column of its own, read once however many parts of it are named.
    rows = rows.withColumn("_e", extraction.parse(reply)).withColumn("_t", extraction.trimmed(F.col("_e")))
    rows = rows.withColumn("problemas", F.when(F.col("_t.e").isNotNull(), extraction.problems(F.col("_t.e"), measures, kinds)))
    unanswered = F.create_map(*[F.lit(x) for pair in UNANSWERED.items() for x in pair])
    reason = (
        F.when(F.col("tipo").isNull(), "lote: documento não está no lote")
        .when(F.col("tipo") == "errored", F.concat(F.lit("lote: "), F.concat_ws(" — ", "erro_tipo", "erro_mensagem")))
        .when(F.col("tipo") != "succeeded", F.coalesce(F.try_element_at(unanswered, F.col("tipo")), F.lit("lote: resultado de tipo desconhecido")))
        .when(F.col("fim") == "refusal", "recusa do modelo").when(F.col("fim") == "max_tokens", "resposta cortada").when(F.coalesce(F.trim("resposta"), F.lit("")) == "", "resposta vazia")
        .when(F.col("_t.e").isNull(), "resposta sem JSON").when(F.size("problemas") > 0, F.concat(F.lit("esquema: "), F.array_join("problemas", ", ")))
    )
    rows = rows.withColumn("erro", reason)
    return rows.withColumns({"e": F.when(F.col("erro").isNull(), F.col("_t.e")), "aparados": F.when(F.col("erro").isNull(), F.col("_t.aparados"))}).drop("_e", "_t")


def batch_cost() -> Column:
    """Dollars of an answered request of a batch, at half price; of one that failed without an answer none."""
    used = [F.coalesce(F.col(c), F.lit(0)) for c in ("tokens_entrada", "tokens_saida", "tokens_cache_escritos", "tokens_cache_lidos")]
    return F.when(F.col("tipo") == "succeeded", money.call_cost(*used, batched=F.lit(True))).otherwise(F.lit(0.0))


def without_request(error: Column) -> Column:
    """An error message once the number of the request is taken out."""
    return F.regexp_replace(error, r"[,; ]*request_id[=:]\s*\S+", "")


def error_line(status: Column, message: Column, most: int = 500) -> Column:
    """Status and message of a failed request in one text of bounded length."""
    return F.substring(F.concat_ws(": ", status.cast("string"), message), 1, most)


def failed(documents: DataFrame, error: Column) -> DataFrame:
    """Calls that gave nothing, as results: no tokens, and a cost of zero, which unlike an unknown price is known."""
    none = {c: F.lit(0).cast("long") for c in ("tokens_entrada", "tokens_saida", "tokens_cache_lidos", "tokens_cache_escritos")}
    return documents.withColumns(none | {"resposta": F.lit(None).cast("string"), "fim": F.lit(None).cast("string"), "custo_usd": F.lit(0.0), "erro": error})


def unseen_errors(errors: DataFrame, column: str = "erro") -> DataFrame:
    """Distinct error messages once the number of the request is taken out."""
    return errors.where(F.col(column).isNotNull()).select(without_request(F.col(column)).alias(column)).distinct()
