"""Accounts: profile and subscription updates, tokens, the recipient list, signed inbound calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keyed


def subscriptions_after(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(user_id, medida, activa) after users chose anew (user_id, medidas): what isn't chosen is switched off, never deleted."""
    chosen = wanted.select("user_id", F.explode("medidas").alias("medida")).distinct().withColumn("_c", F.lit(True))
    asked = wanted.select("user_id").distinct().withColumn("_a", F.lit(True))
    rows = stored.select("user_id", "medida", "activa").join(chosen, ["user_id", "medida"], "full").join(asked, "user_id", "left")
    return rows.select("user_id", "medida", F.when(F.col("_a").isNull(), F.col("activa")).otherwise(F.coalesce("_c", F.lit(False))).alias("activa"))


def preferences(profiles: DataFrame, subscriptions: DataFrame, user: Column) -> DataFrame:
    """(user_id, tipos, frequencia, medidas): what a user may read, the own row with the active measures in order; none for no such user."""
    own = subscriptions.where(F.col("activa") & (F.col("user_id") == user)).groupBy("user_id").agg(F.array_sort(F.collect_set("medida")).alias("medidas"))
    rows = profiles.where(F.col("user_id") == user).select("user_id", "tipos", "frequencia").join(own, "user_id", "left")
    return rows.withColumn("medidas", F.coalesce("medidas", F.array().cast("array<string>")))


def known_measures(given: Column, taxonomy: list[str]) -> Column:
    return F.array_intersect(given, F.array(*map(F.lit, taxonomy)))


def allowed_recipients(addresses: Column, allowed: list[str]) -> Column:
    """Of "Name <addr>" or bare addresses those in the list, lower-cased, in order."""
    bare = F.transform(addresses, lambda a: F.lower(F.trim(F.coalesce(F.nullif(F.regexp_extract(a, "<([^<>]+)>", 1), F.lit("")), a))))
    return F.filter(bare, lambda a: a.isin(allowed))


def tokens_for(pairs: DataFrame, issued: DataFrame, secret: bytes) -> DataFrame:
    """(user_id, medida, token): the issued token of a pair again, null measures included, else the one that the secret gives it."""
    old = issued.select(F.col("user_id").alias("_u"), F.col("medida").alias("_m"), "token")
    rows = pairs.join(old, (F.col("user_id") == F.col("_u")) & F.col("medida").eqNullSafe(F.col("_m")), "left")
    return rows.select("user_id", "medida", F.coalesce("token", keyed.token(secret, F.col("user_id"), F.col("medida"))).alias("token"))


def received(calls: DataFrame, secret: str, now: Column) -> DataFrame:
    """Inbound calls (id, carimbo, corpo, assinatura) with ``aceite`` and, where not, ``motivo``: first the window, then the signature."""
    args = [F.col(c) for c in ("id", "carimbo", "corpo", "assinatura")]
    fresh, good = keyed.recent(args[1], now), keyed.signed(*args, secret)
    return calls.withColumns({"aceite": fresh & good, "motivo": F.when(~fresh, "carimbo_fora_da_janela").when(~good, "assinatura_invalida")})
