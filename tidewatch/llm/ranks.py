"""Exact ranks within groups, without a sort of a group: histograms of the digits of a number, refined where they are full.

Rows of a group of more than ``LIMIT`` are counted by the leading bits of their number, as many as make buckets of a quarter
of ``LIMIT`` on average; what stands before a bucket is added up over a hierarchy of digits of those bits, so no step holds
more than a digit's worth of counts. A bucket that is still too full is a group of the next round, with its own smallest and
largest number; where all its numbers are equal, the next number of the rows takes over. What is left is sorted in buckets
of at most ``LIMIT`` rows. Only a maximum and the count of rounds reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .components import FEW
from .storage import written

LIMIT = 4096
#: Bits of a digit of the hierarchy of counts.
DIGIT = 6


def _joined(rows: DataFrame, table: DataFrame, on: list[str], few: bool) -> DataFrame:
    return rows.join(F.broadcast(table) if few else table, on)


def _offsets(counts: DataFrame, key: list[str], largest: int) -> DataFrame:
    """``counts`` (key, bucket, m) with ``before``: the sum of m of the key's buckets of smaller numbers, digit by digit."""
    up = [counts]
    while largest >> DIGIT * (len(up) - 1):
        up.append(up[-1].groupBy(*key, F.shiftright("bucket", DIGIT).alias("bucket")).agg(F.sum("m").alias("m")))
    before = up[-1].select(*key, "bucket", "m", F.lit(0).cast("long").alias("before"))
    for level in up[-2::-1]:
        w = Window.partitionBy(*key, "_up").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        own = level.withColumn("_up", F.shiftright("bucket", DIGIT)).withColumn("_own", F.coalesce(F.sum("m").over(w), F.lit(0)))
        above = before.select(*key, F.col("bucket").alias("_up"), F.col("before").alias("_above"))
        before = own.join(above, [*key, "_up"]).select(*key, "bucket", "m", (F.col("_own") + F.col("_above")).alias("before"))
    return before


def ranked(rows: DataFrame, group: str, number: Callable[[Column], Column], order: list[Column], limit: int = LIMIT) -> DataFrame:
    """``rows`` with ``rank``, from 0 within ``group`` (a column without nulls), and ``n``, the rows of the group.

    ``number`` gives the i-th number (64 bits) of a row, null before all others; ``order`` sorts a bucket, by the same rule
    and to the end: rows must be told apart by their numbers or, ``limit`` rows at most, by ``order``.
    """
    key = [group, "_at", "_k"]
    state, done = rows.withColumns({"_at": F.lit(0).cast("long"), "_k": F.lit(0), "_n": F.lit(None).cast("long")}), []
    while True:
        numbered = state.withColumn("_v", number(F.col("_k")))
        groups = written(numbered.groupBy(*key).agg(F.count("*").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_known")), "groups")
        size = groups.agg(F.count("*").alias("n"), F.max("_rows").alias("most")).first()
        bits = F.ceil(F.log2(F.col("_hi").cast("double") - F.col("_lo").cast("double") + 2)) + 1
        width = F.ceil(F.log2(F.col("_rows") / limit)) + 2
        alike = (F.col("_known") == 0) | (F.col("_known") == F.col("_rows")) & (F.col("_lo") == F.col("_hi"))
        shift = F.least(F.lit(63), F.greatest(F.lit(0), bits - width)).cast("int")
        groups = groups.select(*key, "_rows", "_lo", F.coalesce(shift, F.lit(0)).alias("_shift"), alike.alias("_alike"))
        known = _joined(numbered, groups, key, size.n <= FEW).withColumn("_n", F.coalesce("_n", "_rows"))
        names = [*rows.columns, "_at", "_n"]
        done.append(known.where(F.col("_rows") <= limit).select(*names))
        if not size.n or size.most <= limit:
            break
        right = lambda x: F.call_function("shiftright", F.col(x), F.col("_shift"))
        bucket = F.when(F.col("_alike") | F.col("_v").isNull(), 0).otherwise(right("_v") - right("_lo") + 1).cast("long")
        full = known.where(F.col("_rows") > limit).withColumn("bucket", bucket)
        counts = written(full.groupBy(*key, "bucket").agg(F.count("*").alias("m")), "counts")
        seen = counts.agg(F.count("*").alias("n"), F.max("bucket").alias("largest"), F.max("m").alias("most")).first()
        placed = _joined(full, _offsets(counts, key, seen.largest), [*key, "bucket"], seen.n <= FEW)
        placed = placed.withColumn("_at", F.col("_at") + F.col("before")).withColumn("_k", F.col("_k") + F.col("_alike").cast("int"))
        done.append(placed.where(F.col("m") <= limit).select(*names))
        if seen.most <= limit:
            break
        state = written(placed.where(F.col("m") > limit).select(*rows.columns, "_at", "_k", "_n"), "full")
    w = Window.partitionBy(group, "_at").orderBy(*order)
    out = reduce(DataFrame.unionByName, done).withColumn("rank", F.col("_at") + F.row_number().over(w) - 1)
    return out.select(*rows.columns, "rank", F.col("_n").alias("n"))
