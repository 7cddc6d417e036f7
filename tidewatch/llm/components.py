"""Connected components by minimum labels and pointer jumping, in joins alone.

Tables of at most ``FEW`` rows, counted first, are joined by broadcast and kept in few partitions; larger ones are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import written

#: Rows of two ids that may be broadcast: some 30 MB at most.
FEW = 1 << 18


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``links`` (a, b): label is the smallest node reachable. Each round is written."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    rows = both.count()
    tasks = 2 * links.sparkSession.sparkContext.defaultParallelism

    def kept(df: DataFrame) -> DataFrame:
        return written(df.coalesce(tasks) if rows <= FEW else df, "labels")

    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while rows:
        known = F.broadcast(labels) if rows <= FEW else labels  # there are no more nodes than rows
        near = both.join(known, both["b"] == known["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        better = near.join(known, "node").select("node", F.least("label", "near").alias("step"), "label")
        up = known.select(F.col("node").alias("step"), F.col("label").alias("jump"))
        new = better.join(F.broadcast(up) if rows <= FEW else up, "step", "left").select("node", F.least("step", F.coalesce("jump", "step")).alias("label"), F.col("label").alias("old"))
        new = kept(new)
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
    return labels
