"""A Merkle manifest of a corpus: a root over all sources, a root a source, and a proof of membership for every document.

The tree over the documents of a source is a trie of ranks. A document's rank among its source's ids is exact without a sort
of the source (``ranks``: histograms of digits of the id), and its digits in base ``fanout`` are its key: the nodes above it
are the prefixes of that key. Nodes are reduced by the longest prefix first, ``depth`` digits in one step: a step gathers the
at most ``fanout ** depth`` nodes that share a prefix, so a source of any size is spread over many tasks and the number of
shuffles is the logarithm to that base. The sources' roots are leaves of a tree of the same kind, ranked by name.

Proofs come back down the same steps: the block under a prefix gets the siblings above it, once, and its nodes add their own.

Defined results: null fields count as ``-``; a null id is decimal-less, so it is never tampered with, and comes before all
others; rows of one id are ordered by leaf, and equal rows are leaves of their own, each with its own proof. The null source
is a source, before all others. No documents, no rows. Extra columns don't matter. Text and the other fields of a row
together stay below 2 GB, as a string of Spark must.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .ranks import ranked
from .storage import only, scratch, written

FANOUT = 3
#: Digits of a key that are reduced in one step: blocks of at most 729 nodes.
DEPTH = 6
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
PATH = "g string, i long, left array<binary>, right array<binary>, inner int"


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field's length in bytes and value, or ``-``."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*[part(c.cast("string")) for c in fields]), 256))


def leaves(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """g (the source, told apart from null), source, doc_id, leaf, other (the leaf with ``altered`` for the text, where it differs), row."""
    rows = only(docs, *FIELDS)
    own = [F.col(c) for c in FIELDS]
    other = F.lit(None).cast("binary") if altered is None else F.when(~altered.eqNullSafe(F.col("text")), leaf([*own[:-1], altered]))
    return rows.select(F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf(own).alias("leaf"), other.alias("other"), F.monotonically_increasing_id().alias("row"))


def _up(x: list[bytes], fanout: int) -> list[bytes]:
    return [sha256(b"".join(y.hex().encode() for y in x[i : i + fanout])).digest() for i in range(0, len(x), fanout)]


def _levels(x: list[bytes], n: int, fanout: int, depth: int) -> list[list[bytes]]:
    """The nodes of a block and of each level above it, up to one node: ``depth`` steps, or fewer if this is all of the group's ``n`` nodes."""
    out = [x]
    while len(out[-1]) > 1 if n <= fanout**depth else len(out) <= depth:
        out.append(_up(out[-1], fanout))
    return out


def _siblings(levels: list[list[bytes]], at: int, fanout: int) -> list[tuple[bytes, bytes]]:
    """Of each level, the digests that stand before and after the one of node ``at`` in its run."""
    out = []
    for nodes in levels[:-1]:
        run = at - at % fanout
        out.append((b"".join(nodes[run:at]), b"".join(nodes[at + 1 : run + fanout])))
        at //= fanout
    return out


def folded(digest: bytes, siblings: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a digest and its siblings lead to."""
    for left, right in siblings:
        digest = sha256((left.hex() + digest.hex() + right.hex()).encode()).digest()
    return digest


def grown(nodes: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> list[DataFrame]:
    """Tables of nodes (g, i, n, h), by steps: of each group (n nodes numbered i from 0) until one node is left."""
    size = fanout**depth

    def root(block: pa.Table) -> pa.Table:
        rows = sorted(zip(block["i"].to_pylist(), block["h"].to_pylist(), strict=True))
        n = block["n"][0].as_py()
        top = _levels([h for _, h in rows], n, fanout, depth)[-1]
        return pa.table({"g": [block["g"][0].as_py()], "i": pa.array([rows[0][0] // size], pa.int64()), "n": pa.array([-(-n // size)], pa.int64()), "h": pa.array(top, pa.binary())})

    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        rows = out[-1].where("n > 1").select("g", "i", "n", "h").withColumn("block", F.expr(f"i div {size}"))
        out.append(written(rows.groupBy("g", "block").applyInArrow(root, "g string, i long, n long, h binary"), "nodes"))
        most = -(-most // size)
    return out


def _roots(levels: list[DataFrame]) -> list[DataFrame]:
    """Of each step the groups that end there: g, h."""
    return [t.where("n = 1").select("g", "h") for t in levels]


def _blocked(nodes: DataFrame, above: DataFrame, run, schema: str, fanout: int, depth: int) -> DataFrame:
    rows = nodes.withColumn("block", F.when(F.col("n") == 1, F.lit(0)).otherwise(F.expr(f"i div {fanout**depth}")))
    above = above.select(*[F.col(c).alias(c) for c in above.columns])  # columns of its own: both sides come from the same tables
    return rows.groupBy("g", "block").cogroup(above.groupBy("g", "i")).applyInArrow(run, schema)


def _path(above: pa.Table) -> tuple[list[tuple[bytes, bytes]], int]:
    return list(zip(above["left"][0].as_py(), above["right"][0].as_py(), strict=True)), above["inner"][0].as_py()


def _above(step: int, below: DataFrame | None, ends: list[DataFrame], outer: DataFrame) -> DataFrame:
    """The paths of the nodes one step up, and from outside those of groups that end at this step."""
    own = ends[step].select("g").join(outer, "g").select("g", F.lit(0).cast("long").alias("i"), "left", "right", F.lit(0).alias("inner"))
    return own if below is None else below.unionByName(own)


def paths(levels: list[DataFrame], outer: DataFrame, fanout: int = FANOUT, depth: int = DEPTH, down_to: int = 0) -> DataFrame | None:
    """The siblings from the nodes of step ``down_to`` to the root, nearest first. ``outer``: those of each group's root (g, left, right)."""

    def add(nodes: pa.Table, above: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return pa.table({"g": pa.array([], pa.string()), "i": pa.array([], pa.int64()), "left": pa.array([], pa.list_(pa.binary())), "right": pa.array([], pa.list_(pa.binary())), "inner": pa.array([], pa.int32())})
        rows = sorted(zip(nodes["i"].to_pylist(), nodes["h"].to_pylist(), strict=True))
        all_, (rest, inner) = _levels([h for _, h in rows], nodes["n"][0].as_py(), fanout, depth), _path(above)
        found = [_siblings(all_, at, fanout) + rest for at in range(len(rows))]
        sides = [pa.array([[x[k] for x in f] for f in found], pa.list_(pa.binary())) for k in (0, 1)]
        return pa.table({"g": pa.array([nodes["g"][0].as_py()] * len(rows)), "i": pa.array([i for i, _ in rows], pa.int64()), "left": sides[0], "right": sides[1], "inner": pa.array([inner + len(all_) - 1] * len(rows), pa.int32())})

    found, ends = None, _roots(levels)
    for step in range(len(levels) - 1, down_to - 1, -1):
        found = written(_blocked(levels[step].select("g", "i", "n", "h"), _above(step, found, ends, outer), add, PATH, fanout, depth), "paths")
    return found


@dataclass
class Manifest:
    """Tables of nodes by steps: ``documents`` (of step 0, with doc_id and other) within sources, ``sources`` over their roots."""

    documents: list[DataFrame]
    sources: list[DataFrame]
    fanout: int
    depth: int

    def root(self) -> str | None:
        """The digest of the whole corpus; None for no documents."""
        found = self.sources[-1].where("n = 1").select(F.lower(F.hex("h"))).first()
        return found and found[0]

    def subroots(self) -> DataFrame:
        """(source, rank, subroot)."""
        return self.sources[0].select(F.when(F.col("source") != "0", F.substring("source", 2, 1 << 30)).alias("source"), F.col("i").alias("rank"), F.lower(F.hex("h")).alias("subroot"))


def build(docs: DataFrame, fanout: int = FANOUT, depth: int = DEPTH, altered: Column | None = None, limit: int | None = None) -> Manifest:
    """The manifest of ``docs``; each table of nodes is written."""
    how = {"limit": limit} if limit else {}
    rows = written(leaves(docs, altered), "leaves")
    head = F.conv(F.substring(F.hex("leaf"), 1, 15), 16, 10).cast("long")
    number = lambda k: F.when(k == 0, F.col("doc_id")).when(k == 1, head).otherwise(F.col("row"))
    rows = ranked(rows, "g", number, [F.asc_nulls_first("doc_id"), F.col("leaf"), F.col("row")], **how)
    first = written(rows.select("g", F.col("rank").alias("i"), "n", F.col("leaf").alias("h"), "doc_id", "other"), "ranked")
    documents = grown(first, fanout, depth)
    roots = None
    for t in _roots(documents):
        roots = t if roots is None else roots.unionByName(t)
    top = roots.select(F.lit("").alias("g"), F.col("g").alias("source"), "h")
    b = F.encode(F.col("source"), "UTF-8")
    piece = lambda k: F.hex(b.substr(k * 7 + 1, F.lit(7)))  # noqa: E731  seven bytes are a number
    by_name = lambda k: F.when(F.length(piece(k)) > 0, F.conv(F.rpad(piece(k), 14, "0"), 16, 10).cast("long"))
    top = ranked(written(top, "roots"), "g", by_name, [F.col("source")], **how)
    return Manifest(documents, grown(written(top.select("g", F.col("rank").alias("i"), "n", "h", "source"), "sources"), fanout, depth), fanout, depth)


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified: whether the document as it is now leads to the root."""
    fanout, depth = manifest.fanout, manifest.depth
    nothing = F.array().cast("array<binary>")
    start = manifest.sources[-1].where("n = 1").select("g", nothing.alias("left"), nothing.alias("right"))
    sides = paths(manifest.sources, start, fanout, depth)
    outer = sides.join(manifest.sources[0].select("i", "source"), "i").select(F.col("source").alias("g"), "left", "right")
    below = paths(manifest.documents, outer, fanout, depth, 1) if len(manifest.documents) > 1 else None

    def prove(nodes: pa.Table, above: pa.Table) -> pa.Table:
        rows = sorted(zip(*[nodes[c].to_pylist() for c in ("i", "h", "other", "doc_id")], strict=True)) if nodes.num_rows else []
        out = []
        if rows:
            all_, (rest, inner) = _levels([r[1] for r in rows], nodes["n"][0].as_py(), fanout, depth), _path(above)
            subroot = folded(all_[-1][0], rest[:inner])
            root = folded(subroot, rest[inner:])
            tail = "".join(left.hex() + right.hex() for left, right in rest)
            for at, (_, h, other, doc_id) in enumerate(rows):
                own = _siblings(all_, at, fanout)
                found = folded(other or h, own + rest)
                proof = sha256(("".join(left.hex() + right.hex() for left, right in own) + tail).encode()).hexdigest()
                out.append((doc_id, h.hex(), subroot.hex(), root.hex(), proof, found.hex(), found == root))
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        return pa.table([pa.array(x, t) for x, t in zip(columns, [pa.int64(), *[pa.string()] * 5, pa.bool_()], strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return _blocked(manifest.documents[0], _above(0, below, _roots(manifest.documents), outer), prove, OUT, fanout, depth)


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the contract's manifest of ``documents``, with line feeds taken from the texts of every document of an even checksum."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    with scratch(spark) as keep:
        return keep(proofs(build(docs, altered=altered)), "proofs")



def _tree(name: str, leaves_: str, fanout: int) -> str:
    """SQL: ``name`` (g, i, n, h, lvl), all nodes over ``leaves_``, and ``name``_near (g, lvl, i, l, r), the siblings of each."""
    side = lambda rows: f"coalesce(string_agg(h, '') over (partition by g, lvl, i // {fanout} order by i rows between {rows}), '')"
    return f"""{name} as (select g, i, n, h, 0 lvl from {leaves_} union all
        select g, i // {fanout}, (min(n) + {fanout - 1}) // {fanout}, sha256(string_agg(h, '' order by i)), lvl + 1 from {name} where n > 1 group by g, lvl, i // {fanout}),
      {name}_near as materialized (select g, lvl, i, {side("unbounded preceding and 1 preceding")} l, {side("1 following and unbounded following")} r from {name} where n > 1)"""


def _folds(name: str, start: str, tree: str, fanout: int) -> str:
    """SQL: ``start`` (id, g, i, n, h, p) taken up ``tree``: h the digest, p the siblings passed."""
    return f"""{name} as (select id, g, i, n, h, p, 0 lvl from {start} union all
        select id, f.g, f.i // {fanout}, (n + {fanout - 1}) // {fanout}, sha256(l || h || r), p || l || r, f.lvl + 1 from {name} f join {tree}_near s on f.g = s.g and f.lvl = s.lvl and f.i = s.i where n > 1)"""


def oracle(fanout: int = FANOUT) -> str:
    """SQL by recursion; the lowest bit of the checksum is computed bit by bit."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}, '-')"
    digest = lambda text: "sha256(" + " || ".join([*map(field, FIELDS[:-1]), field(text)]) + ")"
    bits = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda d: list_transform(range(8), lambda k: (ascii(d) >> k) & 1)))"
    crc = f"list_reduce({bits}, lambda c, b: xor(c >> 1, case when xor(c, b) & 1 = 1 then 3988292384 else 0 end), 4294967295)"
    return f"""with recursive d as materialized (select row_number() over () id, doc_id, coalesce('1' || source, '0') g, {digest("text")} leaf,
        case when {crc} & 1 = 1 then {digest("replace(text, chr(10), '')")} else {digest("text")} end other from documents),
      ranked as materialized (select *, leaf h, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by g) n from d),
      {_tree("t", "ranked", fanout)},
      tops as materialized (select '' g, g source, h, row_number() over (order by g) - 1 i, count(*) over () n from t where n = 1),
      {_tree("u", "tops", fanout)},
      start as (select id, g, i, n, other h, '' p from ranked), {_folds("f", "start", "t", fanout)},
      mid as (select f.id, '' g, tops.i, tops.n, f.h, p from f join tops on f.g = tops.source where f.n = 1), {_folds("e", "mid", "u", fanout)}
      select doc_id, leaf, tops.h subroot, u.h root, sha256(p) proof_sha256, e.h folded_root, e.h = u.h verified
      from e join ranked using (id) join tops on tops.source = ranked.g, u where e.n = 1 and u.n = 1"""
