"""The registry of sources as a table: entry, cadence, floor of candidates, whether it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

COLUMNS = "id string, leitor string, cadencia_horas int, candidatos_min int, activa boolean"
#: Kind of reader, hours between reads, and the fewest candidates a healthy read gives.
ROWS = [
    ("listagem-avisos", "paginas", 24, 20, True),
    ("noticias", "paginas", 12, 2, True),
    ("candidaturas", "nenhum", 24, 0, False),
    ("arquivo-artigos", "paginas", 24, 3, True),
    ("avisos-json", "json", 24, 50, True),
    ("plano-anual", "folha", 168, 1, True),
]


def sources(spark, active_only: bool = False) -> DataFrame:
    rows = spark.createDataFrame(ROWS, COLUMNS)
    return rows.where("activa") if active_only else rows


def source(spark, id_: str) -> DataFrame:
    """The source of an id; no row where there is none."""
    return sources(spark).where(F.col("id") == id_)


def entries(rows: DataFrame, urls: DataFrame) -> DataFrame:
    """(id, leitor, url, metodo): what is fetched first of each source; ``urls`` (id, url, and metodo, GET where it is null) are configuration."""
    return rows.join(urls, "id").select("id", "leitor", "url", F.coalesce("metodo", F.lit("GET")).alias("metodo"))


def pages_to_read(total: int, per_page: int, cap: int) -> list[int]:
    """Page numbers from 0, never beyond the cap."""
    return list(range(min(cap, -(-total // per_page)))) if total > 0 else []
