"""Identity keys of records and their resolution against known funds."""

from __future__ import annotations

import itertools
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .. import tables
from ..functions import text, urls
from . import graph

#: How far a kind of key may be trusted.
STRENGTH = {"referencia": 100, "url": 70, "titulo": 30}


def keys(rows: DataFrame, source: Column, reference: Column, url: Column, title: Column, year: Column) -> DataFrame:
    """The rows with one key each: reference, canonical url and title, named apart by source."""
    ref = text.legal_reference(reference)
    struct = lambda kind, value: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("tipo"), value.alias("valor"), F.lit(STRENGTH[kind]).alias("forca")))
    found = F.array_compact(F.array(struct("referencia", F.concat(source, F.lit(":"), ref)), struct("url", urls.url_key(source, url)), struct("titulo", F.concat(source, F.lit(":"), text.title_key(title, year)))))
    return rows.select("*", F.explode(found).alias("chave")).select("*", "chave.*").drop("chave")


def _outcome(rows: DataFrame, dataset: bool, *same: str) -> DataFrame:
    """Per candidate of ``rows`` (a row a key, with the fund that holds it or null): result, fund of the strongest key, new keys, funds.

    Columns ``same``, alike in all rows of a candidate, are kept.
    """
    out = rows.groupBy("cand_id").agg(
        F.min_by("fund_id", F.when(F.col("fund_id").isNotNull(), F.struct((-F.col("forca")).alias("f"), "fund_id"))).alias("fund_id"),
        F.max(F.when(F.col("fund_id").isNotNull(), F.col("forca"))).alias("maior"),
        F.bool_or((F.col("tipo") == "url") & F.col("fund_id").isNull()).alias("url_nova"),
        F.sum(F.when(F.col("fund_id").isNull(), 1).otherwise(0)).alias("chaves_novas"),
        F.array_sort(F.collect_set("fund_id")).alias("nomeados"),
        *[F.any_value(c).alias(c) for c in same],
    ).withColumn("fundos", F.size("nomeados"))
    weak = F.coalesce((F.col("maior") == STRENGTH["titulo"]) & (F.col("fundos") == 1) & F.col("url_nova"), F.lit(False)) if dataset else F.lit(False)
    new = (F.col("fundos") == 0) | weak
    return out.select("cand_id", F.when(new, "novo").when(F.col("fundos") > 1, "conflito").otherwise("existente").alias("resultado"), F.when(~new, F.col("fund_id")).alias("fund_id"), F.col("chaves_novas").cast("long").alias("chaves_novas"), "nomeados", *same)


def resolve(candidates: DataFrame, known: DataFrame, dataset: bool = False) -> DataFrame:
    """Per candidate: ``novo``, ``existente`` or ``conflito``, the fund of its strongest key, and the keys it lacks.

    With ``dataset`` a title alone doesn't merge a candidate whose url key is new.
    """
    return _outcome(candidates.join(known.select("tipo", "valor", "fund_id"), ["tipo", "valor"], "left"), dataset).drop("nomeados")


_FREE = "cand_id long, ordem long, tipo string, valor string, forca int, fund_id string, novo_id string"
_ADDED = "tipo string, valor string, forca int, fund_id string, ordem long"


def _writes(rows: DataFrame, dataset: bool) -> DataFrame:
    """What candidates that wait for nobody write: the keys that no fund holds, for the fund that the others name, or a new one."""
    outcome = _outcome(rows, dataset).select("cand_id", "resultado", F.col("fund_id").alias("_fundo"))
    free = rows.where("fund_id is null").join(outcome.where("resultado <> 'conflito'"), "cand_id")
    return free.select("tipo", "valor", "forca", F.coalesce("_fundo", "novo_id").alias("fund_id"), "ordem")


#: Candidates that are walked through at a time, if no component has more.
TOGETHER = 4096


def _replayed(rows: DataFrame, dataset: bool, walks: int) -> DataFrame:
    """The writes of whole components (``label``), each walked through in order in one task; small ones share one of ``walks``, as they share no key."""

    def walk(part: pa.Table) -> pa.Table:
        held: dict[tuple[str, str], str] = {}
        out: list[tuple] = []
        found = sorted(zip(*[part[c].to_pylist() for c in ("ordem", "tipo", "valor", "forca", "fund_id", "novo_id")], strict=True), key=lambda r: r[:3])
        for ordem, group in itertools.groupby(found, lambda r: r[0]):
            own = [(tipo, valor, forca, fund if fund is not None else held.get((tipo, valor)), new) for _, tipo, valor, forca, fund, new in group]
            funds = {fund for *_, fund, _ in own if fund is not None}
            if len(funds) > 1:  # a conflict writes no key
                continue
            title_alone = all(tipo == "titulo" for tipo, *_, fund, _ in own if fund is not None) and any(tipo == "url" and fund is None for tipo, *_, fund, _ in own)
            name = own[0][-1] if not funds or dataset and title_alone else next(iter(funds))
            for tipo, valor, forca, fund, _ in own:
                if fund is None:
                    held[tipo, valor] = name
                    out.append((tipo, valor, forca, name, ordem))
        return pa.table([pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [[]] * 5, [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64()], strict=True)], names=["tipo", "valor", "forca", "fund_id", "ordem"])

    return rows.groupBy(F.pmod(F.xxhash64("label"), F.lit(walks))).applyInArrow(walk, _ADDED)


def resolve_batch(candidates: DataFrame, known: DataFrame, position: str = "cand_id", dataset: bool = False, most: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Candidates of one batch resolved as if one by one, by ascending ``position`` (no two alike): what one writes, later ones see.

    Gives (cand_id, resultado, fund_id, chaves_novas, nomeados) and the keys that are written (tipo, valor, forca, fund_id);
    a new fund's id comes from its candidate's strongest key, and ``nomeados`` are the funds that a candidate's keys lead to.

    Only keys that no fund holds yet make a candidate wait for another. One that comes first on all of these waits for
    nobody: such candidates write at once, and what waited for them alone is free. What still waits falls into components by
    shared keys; each of at most ``most`` candidates is walked through in order in a task of its own. In larger ones further
    rounds free those that come first, so a key of very many candidates is soon held by the fund of its first and ties
    nobody; there is no last round before all is resolved. Candidates with conflicts from what is known write nothing,
    whatever comes before, so nobody waits for them.
    """
    spark = candidates.sparkSession
    made: list[str] = []
    try:
        save = lambda df, name: tables.saved(df, name, made)
        named = candidates.where("cand_id is not null").select("cand_id", F.col(position).cast("long").alias("ordem"), F.struct("tipo", "valor", F.col("forca").cast("int").alias("forca")).alias("k"))
        rows = named.groupBy("cand_id").agg(F.min("ordem").alias("ordem"), F.sort_array(F.collect_set("k")).alias("ks"))
        # Equal keys stand side by side; the last, of the greatest strength, stays. A candidate's rows move once for all of this.
        other = lambda x, y: y.isNull() | ~(x["tipo"].eqNullSafe(y["tipo"]) & x["valor"].eqNullSafe(y["valor"]))
        own = F.filter("ks", lambda x, i: other(x, F.get(F.col("ks"), i + 1)))
        strongest = F.array_max(F.transform("ks", lambda x: F.struct(x["forca"], x["tipo"], x["valor"])))
        rows = rows.select("cand_id", "ordem", F.sha2(F.concat_ws(":", strongest["tipo"], strongest["valor"]), 256).alias("novo_id"), F.explode(own).alias("k")).select("cand_id", "ordem", "novo_id", "k.*")
        rows = rows.join(known.select("tipo", "valor", F.col("fund_id").cast("string").alias("fund_id")), ["tipo", "valor"], "left")
        rows = save(rows.select(*[c.split()[0] for c in _FREE.split(", ")]), "candidatos")
        open_, written = rows, []
        while True:
            stuck = open_.groupBy("cand_id").agg(F.min("fund_id").alias("a"), F.max("fund_id").alias("b")).where("a <> b").select("cand_id")
            open_ = save(open_.join(stuck, "cand_id", "left_anti"), "livres")
            unheld = open_.where("fund_id is null")
            first = unheld.groupBy("tipo", "valor").agg(F.min("ordem").alias("primeiro"))
            waiting = save(unheld.join(first, ["tipo", "valor"]).where("ordem > primeiro").select("cand_id").distinct(), "espera")
            written.append(save(_writes(open_.join(waiting, "cand_id", "left_anti"), dataset), "escritas"))
            left = open_.join(waiting, "cand_id", "left_semi").join(written[-1].select("tipo", "valor", F.col("fund_id").alias("_novo")), ["tipo", "valor"], "left")
            open_ = save(left.select(*[F.coalesce("fund_id", "_novo").alias(c) if c == "fund_id" else F.col(c) for c in rows.columns]), "livres")
            shared = open_.where("fund_id is null")
            centre = shared.groupBy("tipo", "valor").agg(F.min("ordem").alias("b"))
            label = save(graph.components(shared.join(centre, ["tipo", "valor"]).select(F.col("ordem").alias("a"), "b"), save), "grupos")
            size = label.groupBy("label").agg(F.count("*").alias("n"))
            tagged = open_.join(label, open_["ordem"] == label["node"], "left").withColumn("label", F.coalesce("label", "ordem")).drop("node").join(size, "label", "left")
            walks = int(open_.agg(F.ceil(F.countDistinct("ordem") / TOGETHER)).first()[0] or 1)
            written.append(save(_replayed(tagged.where(F.coalesce("n", F.lit(1)) <= most), dataset, walks), "escritas"))
            open_ = save(tagged.where(F.col("n") > most).drop("label", "n"), "livres")
            if open_.isEmpty():
                break
        added = reduce(DataFrame.unionByName, written)
        seen = rows.join(added.select("tipo", "valor", F.col("fund_id").alias("_novo"), F.col("ordem").alias("_quando")), ["tipo", "valor"], "left")
        seen = seen.withColumn("fund_id", F.coalesce("fund_id", F.when(F.col("_quando") < F.col("ordem"), F.col("_novo"))))
        out = _outcome(seen, dataset, "novo_id").withColumn("fund_id", F.coalesce("fund_id", "novo_id")).drop("novo_id")
        return tables.saved(out, "resolvidos"), tables.saved(added.drop("ordem"), "chaves")
    finally:
        for path in made:
            tables.deleted(spark, path)


def persisted(rows: DataFrame, found: DataFrame, known: DataFrame, dataset: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What candidates (cand_id, titulo, needs_review, alertavel, motivo_revisao and more) write, by outcome.

    Gives the funds (with resultado and fund_id; a new one's id comes from its strongest key), the keys to add (first writer
    wins) and the conflicts. A conflict never merges: the fund of its strongest key is held for review, doesn't alert and
    gets no key, and its message names all funds that its keys lead to. Of outcome ``conflito`` no events are to be drawn.
    """
    outcome = resolve(found, known, dataset).select("cand_id", "resultado", "fund_id")
    strongest = found.groupBy("cand_id").agg(F.max_by(F.concat_ws(":", "tipo", "valor"), F.struct("forca", "tipo", "valor")).alias("_chave"))
    funds = rows.join(outcome, "cand_id").join(strongest, "cand_id").withColumn("fund_id", F.coalesce(F.col("fund_id").cast("string"), F.sha2("_chave", 256))).drop("_chave")
    blocked = F.col("resultado") == "conflito"
    reasons = F.array_append(F.coalesce("motivo_revisao", F.array().cast("array<string>")), F.lit("conflito_identidade"))
    funds = funds.withColumns({"needs_review": blocked | F.col("needs_review"), "alertavel": ~blocked & F.col("alertavel"), "motivo_revisao": F.when(blocked, reasons).otherwise(F.col("motivo_revisao"))})
    fresh = found.join(known.select("tipo", "valor"), ["tipo", "valor"], "left_anti").join(funds.where(~blocked).select("cand_id", "fund_id"), "cand_id")
    keys_ = fresh.groupBy("tipo", "valor").agg(F.min_by(F.struct("fund_id", "forca"), "cand_id").alias("_k")).select("tipo", "valor", "_k.*")
    named = found.join(known.select("tipo", "valor", "fund_id"), ["tipo", "valor"]).groupBy("cand_id").agg(F.array_sort(F.collect_set(F.col("fund_id").cast("string"))).alias("_f"))
    conflicts = funds.where(blocked).select("cand_id", "titulo").join(named, "cand_id").select("cand_id", F.concat("titulo", F.lit(": chaves apontam para "), F.array_join("_f", ", ")).alias("conflito"))
    return funds, keys_, conflicts
