"""The clock-driven sweep: closing-soon, opened and closed events, the state flip, incoherent states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, urls

#: Days before a deadline at which subscribers hear of it.
THRESHOLDS = [1, 3, 7, 14]


def _event(rows: DataFrame, kind: str, definer: Column) -> DataFrame:
    return rows.select("fund_id", F.lit(kind).alias("tipo"), definer.alias("definidor"), urls.fingerprint(F.col("fund_id"), F.lit(kind), definer).alias("impressao"), "alertavel")


def _countdown(funds: DataFrame) -> DataFrame:
    return funds.where(dates.countdown_allowed(F.col("fecha_em"), F.col("precisao")))


def closing_tightest(funds: DataFrame, now: Column) -> DataFrame:
    """One event a fund: the tightest threshold that its whole days left are within."""
    left = dates.days_until(F.col("fecha_em"), now)
    rows = _countdown(funds).where((F.col("estado") == "aberto") & ~F.col("dotacao_esgotada") & (F.col("fecha_em") > now))
    rows = rows.withColumn("limiar", F.array_min(F.filter(F.array(*map(F.lit, THRESHOLDS)), lambda t: left <= t))).where("limiar is not null")
    return _event(rows, "fecha_em_breve", F.format_string('{"limiarDias":%d}', F.col("limiar")))


def closing_each(funds: DataFrame, now: Column) -> DataFrame:
    """One event for every threshold crossed."""
    rows = _countdown(funds).where((F.col("estado") == "aberto") & ~F.col("dotacao_esgotada") & F.col("publicado") & (F.col("fecha_em") > now) & (F.col("fecha_em") <= now + F.expr(f"interval {max(THRESHOLDS)} days")))
    rows = rows.withColumn("limiar", F.explode(F.array(*map(F.lit, THRESHOLDS)))).where(F.col("fecha_em") <= now + F.make_dt_interval(F.col("limiar")))
    return _event(rows, "fecha_em_breve", F.format_string('{"limiarDias":%d}', F.col("limiar")))


def opened(funds: DataFrame, now: Column) -> DataFrame:
    rows = funds.where((F.col("estado") == "previsto") & F.col("publicado") & F.col("precisao").isin("minuto", "dia") & (F.col("abre_em") <= now))
    return _event(rows, "abriu", F.lit('{"de":"previsto"}'))


def closed(funds: DataFrame, now: Column) -> DataFrame:
    rows = _countdown(funds).where((F.col("estado") == "aberto") & F.col("publicado") & (F.col("fecha_em") < now)).withColumn("alertavel", F.lit(False))
    return _event(rows, "encerrou", F.lit('{"de":"aberto"}'))


def clock(funds: DataFrame, now: Column) -> DataFrame:
    """All events of one sweep."""
    return closing_tightest(funds, now).unionByName(opened(funds, now)).unionByName(closed(funds, now))


def state_flip(funds: DataFrame, now: Column) -> DataFrame:
    """Open funds past a precise deadline become closed, published or not; planned ones that have opened become open."""
    past = dates.countdown_allowed(F.col("fecha_em"), F.col("precisao")) & (F.col("fecha_em") < now)
    opened_ = (F.col("estado") == "previsto") & F.col("precisao").isin("minuto", "dia") & (F.col("abre_em") <= now)
    return funds.withColumn("estado", F.when((F.col("estado") == "aberto") & past, "encerrado").when(opened_, "aberto").otherwise(F.col("estado")))


def incoherent(funds: DataFrame, now: Column) -> DataFrame:
    """Closed funds with a deadline to come: marked for review, not alertable; the mark is added once."""
    bad = (F.col("estado") == "encerrado") & (F.col("fecha_em") > now)
    mark = F.concat(F.lit("estado_incoerente:encerrado_com_prazo_"), F.date_format("fecha_em", "yyyy-MM-dd"), F.lit("_futuro"))
    return funds.where(bad).select("fund_id", F.lit(True).alias("needs_review"), F.lit(False).alias("alertavel"), F.array_sort(F.array_union(F.coalesce("motivo_revisao", F.array().cast("array<string>")), F.array(mark))).alias("motivo_revisao"))
