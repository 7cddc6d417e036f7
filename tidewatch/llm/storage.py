"""Where intermediate tables go, how lineage is cut, and when the tables are deleted."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables of each open ``scratch``, the innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> SparkSession:
    """Arrow batches of few rows, where the session hasn't chosen a size: texts are long, and workers hold some batches at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))
    return spark


def _saved(df: DataFrame, name: str, paths: list[str] | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if paths is not None:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like ``written``, but it stays whatever scratch ends; gives its path too, for ``deleted``."""
    paths: list[str] = []
    return _saved(df, name, paths), paths[0]


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    return _saved(df, name, _open[-1] if _open else None)


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder for files that tasks write; it goes with the scratch around it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of jobs that are done: it does so once the driver collects their plans."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes what is ``written`` inside at its end. It gives a function that writes a table which stays, until the scratch
    around this one ends."""
    mine: list[str] = []
    outer = _open[-1] if _open else None
    _open.append(mine)
    try:
        yield lambda df, name: _saved(df, name, outer)
    finally:
        _open.remove(mine)
        for path in mine:
            deleted(spark, path)
        released(spark)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns with clashing names never reach an operator."""
    return df.select(*[df[c] for c in columns])
