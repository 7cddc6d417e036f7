"""The catalogue: its filter, order, counts, banner, lookups and visibility."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import tables

#: States in the order the catalogue shows them.
STATES = ["aberto", "previsto", "suspenso", "desconhecido", "encerrado"]
TERMINAL = {"encerrado"}


@dataclass(frozen=True)
class Filters:
    """An empty list is no constraint."""

    estados: list[str] = field(default_factory=lambda: ["aberto", "previsto"])
    beneficiarios: list[str] = field(default_factory=lambda: ["particular", "condominio"])
    medidas: list[str] = field(default_factory=list)
    concelho: str | None = None
    com_revisao: bool = False

    @classmethod
    def parse(cls, query: str) -> Filters:
        """From a query string: an absent list keeps its default, a present empty one is cleared; repeats and commas add up."""
        given: dict[str, list[str]] = {}
        for k, v in parse_qsl(query.lstrip("?"), keep_blank_values=True):
            given.setdefault(k, []).extend(x for x in v.split(",") if x)
        base = cls()
        lists = {k: given.get(k, getattr(base, k)) for k in ("estados", "beneficiarios", "medidas")}
        return cls(**lists, concelho=(given.get("concelho") or [None])[0], com_revisao=given.get("revisao") == ["1"])

    def serialise(self) -> str:
        base, out = Filters(), []
        for k in ("estados", "beneficiarios", "medidas"):
            if getattr(self, k) != getattr(base, k):
                out.append((k, ",".join(getattr(self, k))))
        out += [("concelho", self.concelho)] * bool(self.concelho) + [("revisao", "1")] * self.com_revisao
        return urlencode(out)

    def toggled(self, name: str, value: str) -> Filters:
        have = getattr(self, name)
        return Filters(**{**self.__dict__, name: [x for x in have if x != value] if value in have else [*have, value]})


def overlaps(column: str, values: list[str]) -> Column:
    """Whether two arrays meet; never null."""
    return F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, values))), F.lit(False)) if values else F.lit(True)


def predicate(f: Filters) -> Column:
    only_terminal = bool(f.estados) and set(f.estados) <= TERMINAL
    out = F.coalesce("publicado", F.lit(False))
    if not (f.com_revisao or only_terminal):
        out = out & ~F.coalesce("needs_review", F.lit(True))
    if f.estados:
        out = out & F.col("estado").isin(f.estados)
    out = out & overlaps("beneficiarios", f.beneficiarios)
    if f.medidas:
        out = out & overlaps("medidas", f.medidas)
    if f.concelho:
        out = out & (F.col("ambito").isin("nacional", "continente") | (F.col("concelho") == f.concelho))
    return out


def rank(state: Column) -> Column:
    out = F.lit(len(STATES))
    for i, s in enumerate(STATES):
        out = F.when(state == s, i).otherwise(out)
    return out


def _order() -> list[Column]:
    return [rank(F.col("estado")).asc(), F.col("fecha_em").asc_nulls_last(), F.when(F.col("fecha_em").isNull(), F.collate("titulo", "pt")).asc(), F.col("fund_id").asc()]


def ordered(funds: DataFrame) -> DataFrame:
    """State, then deadline with none last, then title in Portuguese order where there is no deadline, then id."""
    return funds.orderBy(*_order())


def placed(funds: DataFrame) -> DataFrame:
    """``funds`` with ``lugar``, the place of each in the order, from 1, and ``total``.

    Rows are sorted over all partitions and written with their place within each; what goes before a partition is a sum over
    as many rows as there are partitions. No state, however many funds it has, is numbered in one task.
    """
    rows = tables.saved(ordered(funds).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}), "lugares")
    size = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    every = Window.partitionBy(F.lit(0))
    before = size.select("_p", F.coalesce(F.sum("_n").over(every.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_antes"), F.sum("_n").over(every).alias("total"))
    place = F.col("_antes") + F.col("_i").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(before), "_p").withColumn("lugar", place).drop("_p", "_i", "_antes")


def page(funds: DataFrame, filters: Filters) -> DataFrame:
    """The list of a catalogue page: the funds that pass, each with its place, and how many pass."""
    return placed(funds.where(predicate(filters)))


def count_by_measure(funds: DataFrame, measures: DataFrame, current_only: bool = False) -> DataFrame:
    """Funds per measure; ``current_only`` also asks for a published fund in an open or planned state."""
    rows = funds.where(~F.coalesce("needs_review", F.lit(True)))
    if current_only:
        rows = rows.where(F.col("publicado") & F.col("estado").isin("aberto", "previsto"))
    return rows.select("fund_id").join(measures, "fund_id").groupBy("medida").agg(F.count("*").alias("n"))


def banner(admits: Column, beneficiaries: Column) -> Column:
    """How a fund is shown to private people: by the tri-state and whether condominiums are named."""
    named = F.coalesce(F.array_contains(beneficiaries, "condominio"), F.lit(False))
    return F.when(admits == "sim", "aberto_a_particulares").when((admits == "nao") & named, "so_condominios").when(admits == "nao", "fechado_a_particulares").otherwise("por_confirmar")


def by_slug(funds: DataFrame, slug: str) -> DataFrame:
    return funds.where(F.col("slug") == slug)


def visible(rows: DataFrame, funds: DataFrame) -> DataFrame:
    """Rows whose fund is published."""
    return rows.join(funds.where("publicado").select("fund_id"), "fund_id", "left_semi")


def first_candidates(rows: DataFrame, group: str, position: str, limit: int) -> DataFrame:
    """The first ``limit`` candidates of each source, and how many were left out: a safety rail that tells."""
    w = Window.partitionBy(group)
    return rows.withColumn("ordem", F.row_number().over(w.orderBy(position))).withColumn("ignorados", F.greatest(F.count("*").over(w) - limit, F.lit(0))).where(F.col("ordem") <= limit)
