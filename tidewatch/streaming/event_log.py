"""The event log and the alert ledger as streams: micro-batches that append what is new, exactly once by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import store


def unique_events(events: DataFrame, horizon: str = "30 days") -> DataFrame:
    """A stream of events without repeats of a fingerprint; later than the horizon they are dropped."""
    stamped = events.withColumn("criado_em", F.col("criado_em").cast("timestamp"))
    return stamped.withWatermark("criado_em", horizon).dropDuplicatesWithinWatermark(["impressao"])


def appender(spark: SparkSession, path: str, key: list[str], order: str, day: str | None = None):
    """A ``foreachBatch`` function that appends unknown keys to a table; a replayed batch adds nothing.

    With ``day``, a column that rows of one key share, the table is kept by day and a batch reads the days that it has rows
    of, as many as the stream's horizon at most; without, all of the table.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        there = target.getFileSystem(conf).exists(target)
        stored = spark.read.schema(batch.schema).parquet(path) if there else batch.limit(0)
        if day is not None:
            stored = stored.where(F.col(day).isin([r[0] for r in batch.select(day).distinct().collect()]))
        out = store.new_rows(batch, stored, key, order).write.mode("append")
        (out if day is None else out.partitionBy(day)).parquet(path)

    return append


def claim_then_queue(spark: SparkSession, ledger: str, outbox: str):
    """Claims (user, fingerprint) in the ledger before the message is queued: a crash between loses, never repeats."""

    def run(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.persist()
        appender(spark, ledger, ["user_id", "impressao"], "impressao")(fresh.withColumn("lote", F.lit(batch_id)), batch_id)
        mine = spark.read.parquet(ledger).where(F.col("lote") == batch_id).select("user_id", "impressao")
        fresh.join(mine, ["user_id", "impressao"], "left_semi").dropDuplicates(["user_id", "impressao"]).withColumn("lote", F.lit(batch_id)).write.mode("overwrite").parquet(f"{outbox}/lote={batch_id}")
        fresh.unpersist()

    return run
