"""Append-only tables without duplicates, latest rows, change gates and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def new_rows(incoming: DataFrame, stored: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows to append: unknown keys, of each the first; appending the same batch again adds nothing."""
    first = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    rows = incoming.withColumn("_n", first).where("_n = 1").drop("_n")
    return rows.join(stored.select(*key).distinct(), key, "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Copy-on-write: incoming values win but for the ``kept`` columns (a slug, a first sight) of known rows."""
    a, b = stored.alias("a"), incoming.alias("b")
    value = lambda c: F.coalesce(f"a.{c}", f"b.{c}") if c in kept or c == key else F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*[value(c).alias(c) for c in stored.columns])


def updated(stored: DataFrame, incoming: DataFrame, key: str, now: Column, frozen: tuple[str, ...] = ("slug",)) -> DataFrame:
    """The stored funds after an update that stamps what it writes: all values of a known fund but its key and the ``frozen``
    ones, ``visto_pela_ultima_vez`` and ``actualizado_em``; a new fund is also first seen now. Others stay as they are."""
    stamps = ["visto_pela_primeira_vez", "visto_pela_ultima_vez", "actualizado_em"]
    fresh = incoming.withColumns({c: now for c in stamps}).select(*stored.columns)
    return upsert(stored, fresh, key, [*frozen, stamps[0]])


def update_from(target: DataFrame, source: DataFrame, on: list[str], changes: dict[str, Column], where: Column | None = None) -> DataFrame:
    """``target`` with ``changes`` in the rows that have one of ``source``, and meet ``where``; others stay, none is added.

    Source columns are named ``s_<name>`` in ``changes`` and ``where``. ``source`` has one row a key.
    """
    other = source.select(*[F.col(c).alias(c if c in on else f"s_{c}") for c in source.columns], F.lit(True).alias("s_there"))
    hit = F.coalesce(F.col("s_there") & (F.lit(True) if where is None else where), F.lit(False))
    rows = target.join(other, on, "left")
    return rows.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in target.columns])


def latest(rows: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """The latest row per key; ties go to the larger ``tie``."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def changed(current: DataFrame, processed: DataFrame, key: str | list[str], digest: str) -> DataFrame:
    """The change gate: rows whose digest isn't that of the last processed capture; it stands before anything costly.

    ``processed`` has one row a ``key``: where pages share an url, the key names the page too.
    """
    old = processed.select(*([key] if isinstance(key, str) else key), F.col(digest).alias("_old"))
    return current.join(old, key, "left").where(~F.col(digest).eqNullSafe(F.col("_old"))).drop("_old")


def host_hits(hits: DataFrame, host: Column, day: Column, allowed: list[str] | None = None) -> DataFrame:
    """Hits a day and host; unknown hosts aren't counted where a list is given."""
    rows = hits.select(day.alias("dia"), host.alias("host"))
    if allowed is not None:
        rows = rows.where(F.col("host").isin(allowed))
    return rows.groupBy("dia", "host").agg(F.count("*").alias("contagem"))
