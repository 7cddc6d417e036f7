"""Queries that run streams over all of a table, each with SQL for comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import tables
from ..streaming import alert_state

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("""with a as (select user_id, 'e' || event_id impressao, event_id, event_id % 4 k, ts from events)
  select user_id, impressao, event_id, accao, tentativa, strftime(quando, '%Y-%m-%d %H:%M:%S') quando from (
    select *, 'enviar' accao, 1 tentativa, ts quando from a union all select *, case k when 0 then 'enviado' else 'falhou' end, 1, ts + interval 1 minute from a where k < 2
    union all select *, 'enviar', 2, ts + interval 16 minutes from a where k >= 2 and ts + interval 16 minutes <= (select max(ts) + interval 5 minutes from events))""")
def alert_state_stream(spark, d):
    """Every event is alerted, told of twice and answered once: well, for good badly, badly for now, or not at all."""
    session = alert_state.stateful(spark.newSession())
    path = f"{d}/events.parquet"  # a stream takes a folder or a pattern, not a file
    rows = session.readStream.schema(session.read.parquet(path).schema).parquet(f"{d}/events.parque[t]").select("user_id", F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("impressao"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    ladder, k = [15, 60], F.col("event_id") % 4
    turn = lambda minutes: F.col("ts") + F.make_dt_interval(mins=F.lit(minutes))
    first = alert_state.alerts(rows.withColumn("quando", F.explode(F.array(turn(0), turn(5)))), ladder)
    said = alert_state.responses(rows.select("*", F.when(k == 0, 200).when(k == 1, 404).when(k == 2, 503).alias("status_code"), turn(1).alias("quando")))
    at = f"{tables.shared(spark)}/alert-state-{uuid.uuid4().hex}"
    alert_state.write_batches(alert_state.actions(first.unionByName(said), "0 seconds"), f"{at}/out", f"{at}/check").awaitTermination()
    out = spark.read.parquet(f"{at}/out").select("user_id", "impressao", "event_id", "accao", "tentativa", F.date_format("quando", "yyyy-MM-dd HH:mm:ss").alias("quando"))
    out = tables.saved(out, "alert-state")
    tables.deleted(spark, at)
    return out
