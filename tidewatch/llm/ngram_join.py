"""Exact Jaccard self-join on word shingles with token-combination prefixes.

Texts with equal shingle sets form a class, known by a 128-bit fingerprint. The tokens (shingles) of a class are ordered by
how frequent they are, rare first, from a sketch of fixed size that counts all documents; the order is the same for all,
so results don't depend on the sketch's accuracy.

Index. A set is cut into parts of ``PART`` tokens by their hash, in as many as its size asks for. Of two sets with Jaccard t
or more some part has Jaccard t or more too, and ordered alike the two share k tokens within the first
|x| - ceil(t |x|) + k of it: the extended prefix. Where the prefix for k = 1 is all rare, its tokens are indexed alone;
elsewhere it is extended to k = 2, its rare tokens are indexed alone and its frequent ones as combinations of two. So parts
keep the number of combinations in proportion to the set. A set near the bound of a size class is cut both ways.

Groups. Classes that agree in some of eight minimum hashes, and whose parity bitmaps allow some likeness, join the group of a
pivot. Groups only cut the number of pairs: the index lists hold groups, and of two groups that meet in a list the pair is kept
where sizes and bitmaps allow a link (bitmaps are a metric, so a group's radius around its pivot bounds its members).

Verification. Each group with itself, and with all groups that its kept pairs name, becomes cells of about ``BLOCK`` classes a
side, in which all pairs are compared on whole sets. A cell gives the links of each class as a number, and as edges a spanning forest, so
what it returns grows with its classes and not with its pairs, while every link is found and counted once. ``links`` lists
them as pairs instead.

Defined results: null, empty and blank texts have no shingles and are linked with nothing; texts of fewer words than a
shingle have one, the whole; rows are judged each by itself, whether or not others have their id; null ids stay alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .marks import free, marked, without
from .runs import Tally, expand, squeeze
from .storage import bounded_batches, only, released, scratch, written
from .text_blocks import BLANKS, U64, Chunk, chunks, mix, words

WORDS, PERCENT = 5, 80
SKETCH_BITS, SKETCH_PARTS = 24, 64
#: Tokens that the sketch counts this often at least are frequent, or four times its mean where that is more.
FREQUENT = 256
#: Tokens a part of a set, at most on average.
PART = 256
LONGS = 16
#: For a class to join a pivot's group the bitmaps must allow so much likeness, in percent, and one of eight minima must agree;
#: so many of them where a set has more than ``DENSE`` tokens, of which bitmaps tell little.
GROUPED, AGREE, DENSE = 33, 3, 384
#: Classes a side of a cell of verification, at most about, and bytes of sets that a task verifies at once, about.
BLOCK, BUCKET = 512, 8 << 20


def shingles(c: Chunk, size: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct shingles of each row of a chunk, sorted."""
    h = c.hashes
    n = max(0, len(h) - size + 1)
    whole = np.zeros(n, U64)
    for i in range(size):
        whole = whole * U64(0xD6E8FEB86659FD93) + h[i : i + n]
    whole = mix(whole)
    for a, b in zip(c.first[:-1].tolist(), c.first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(whole[a : b - size + 1])
        elif b > a:
            short = np.zeros(1, U64)
            for x in h[a:b]:
                short = short * U64(0xD6E8FEB86659FD93) + x
            yield mix(short + U64(b - a))
        else:
            yield np.zeros(0, U64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """The parity of the tokens per bit: two sets differ in at least as many tokens as their bitmaps in bits."""
    odd = np.bincount((s >> U64(40) & U64(64 * LONGS - 1)).astype(np.int64), minlength=64 * LONGS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def fingerprint(s: np.ndarray) -> bytes:
    return np.array([np.add.reduce(mix(s)), np.add.reduce(mix(s ^ U64(0xA5A5A5A5A5A5A5A5))) ^ U64(len(s))], U64).tobytes()


def minima(s: np.ndarray) -> list[int]:
    """Eight hashes of a set, each of which two sets share with a probability of their Jaccard similarity."""
    out = [s[0], s[-1]]
    for odd in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        other = s * U64(odd)
        out += [other.min(), other.max()]
    return np.array(out, U64).view(np.int64).tolist()


_ROW = "doc_id long, h long, n long, fp binary, bits array<long>, minima array<long>, part int, cells binary, counts binary"


def surveyed(docs: DataFrame) -> DataFrame:
    """A row for each of ``docs`` (doc_id, h, n, fp; a task gives bitmap and minima of a class once), and the parts of the sketch."""
    cells = 1 << SKETCH_BITS
    width = cells // SKETCH_PARTS
    names = [x.split()[0] for x in _ROW.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.binary()]

    def batch(m: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[n], t) if n in columns else pa.nulls(m, t) for n, t in zip(names, types, strict=True)], names)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        tally = Tally()

        def sketched() -> pa.RecordBatch:
            k, n = tally.taken()
            cuts = np.searchsorted(k, np.arange(SKETCH_PARTS + 1, dtype=U64) * U64(width))
            rows = [(i, squeeze(np.diff(k[a:b], prepend=U64(i * width)).astype(np.uint32)), squeeze(n[a:b].astype(np.uint32))) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            return batch(len(rows), part=[r[0] for r in rows], cells=[r[1] for r in rows], counts=[r[2] for r in rows])

        for rows in (r for b in batches for r in chunks(b)):
            n, fp, bits, least, tokens = [], [], [], [], []
            for s in shingles(words(rows, BLANKS)):
                f = fingerprint(s) if len(s) else None
                n.append(len(s)), fp.append(f), tokens.append(s)
                new = f is not None and f not in seen
                if new and len(seen) < 1 << 20:
                    seen.add(f)
                bits.append(bitmap(s) if new else None), least.append(minima(s) if new else None)
            yield batch(len(n), doc_id=rows.column("doc_id"), h=rows.column("h"), n=n, fp=fp, bits=bits, minima=least)
            tally.add(np.concatenate(tokens) & U64(cells - 1))
            if tally.full():
                yield sketched()
        yield sketched()

    return written(docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(made, _ROW), "survey")


def sketch(survey: DataFrame) -> tuple[np.ndarray, int]:
    """The power of two of the count per cell of 2**24, over the shingles of all documents, and the least frequent one."""
    width = (1 << SKETCH_BITS) // SKETCH_PARTS

    def added(group: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for c, n in zip(group["cells"].to_pylist(), group["counts"].to_pylist(), strict=True):
            total[np.cumsum(expand(c, np.uint32))] += expand(n, np.uint32)
        level = np.log2(total + 1.0).astype(np.uint8)
        return pa.table({"part": [group["part"][0].as_py()], "level": [level.tobytes()], "total": [int(total.sum())]}, schema=pa.schema([("part", pa.int32()), ("level", pa.binary()), ("total", pa.int64())]))

    rows = survey.where("part is not null").select("part", "cells", "counts").groupBy("part").applyInArrow(added, "part int, level binary, total long").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in rows:
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["level"], np.uint8)
    return out, int(np.log2(max(FREQUENT, 4 * sum(r["total"] for r in rows) >> SKETCH_BITS)))


def _cut(m: np.ndarray) -> np.ndarray:
    """Into how many parts sets of ``m`` tokens are cut, as a power of two: 1, 4, 16 and so on."""
    return np.minimum(2 * np.ceil(np.log2((m - 1) // PART + 1.0) / 2), 12).astype(np.int64)


def signatures(tokens: np.ndarray, sizes: np.ndarray, levels: np.ndarray, least: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """What sets are indexed by, and the number of the set each belongs to. ``tokens``: the sets one after another, each sorted.

    Sets of one token have none: their like is of the same class.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    level = levels[(tokens & U64(len(levels) - 1)).astype(np.int64)].astype(np.int64)
    first = _cut(sizes)
    last = _cut(sizes * 100 // percent)
    sigs, owners = [], []
    for more in range(0, int((last - first).max(initial=0)) + 1, 2):
        bits = first + more
        chosen = ((bits <= last) & (sizes > 1))[owner]
        s, own, lev = tokens[chosen], owner[chosen], level[chosen]
        part = (s >> U64(50)).astype(np.int64) & ((1 << bits[own]) - 1)
        order = np.argsort(((own << 12 | part) << 6) | lev, kind="stable")  # of equal levels the smaller token first
        s, own, lev, part = s[order], own[order], lev[order], part[order]
        if not len(s):
            continue
        segment = np.cumsum(np.concatenate(([True], (own[1:] != own[:-1]) | (part[1:] != part[:-1])))) - 1
        count = np.bincount(segment)
        needed = -(-percent * count // 100)
        place = np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)
        one, two = place < (count - needed + 1)[segment], place < (count - needed + 2)[segment]
        often = lev >= least
        mixed = np.bincount(segment, one & often) > 0
        alone = np.where(often, one & (needed < 2)[segment], one | two & mixed[segment])
        named = s ^ mix(bits[own].astype(U64) + U64(1))
        sigs.append(mix(named[alone]) & ~U64(1)), owners.append(own[alone])
        at = np.flatnonzero(often & two & mixed[segment])
        if len(at):  # each with all before it in its part
            run = np.concatenate(([True], segment[at][1:] != segment[at][:-1]))
            before = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            right = np.repeat(np.arange(len(at)), before)
            left = right - 1 - (np.arange(len(right)) - np.repeat(np.cumsum(before) - before, before))
            sigs.append(mix(named[at[left]] * U64(0xD6E8FEB86659FD93) ^ named[at[right]]) | U64(1)), owners.append(own[at[right]])
    sig, own = np.concatenate(sigs or [np.zeros(0, U64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
    order = np.argsort(own, kind="stable")
    return sig[order], own[order]


def indexed(docs: DataFrame, levels: np.ndarray, least: int, percent: int = PERCENT) -> DataFrame:
    """(fp, signatures) per class, once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for rows in (r for b in batches for r in chunks(b)):
            sets, fps = [], []
            for s in shingles(words(rows, BLANKS)):
                if len(s) > 1 and (f := fingerprint(s)) not in seen:
                    sets.append(s), fps.append(f)
                    if len(seen) < 1 << 20:
                        seen.add(f)
            if sets:
                sig, own = signatures(np.concatenate(sets), np.array([len(s) for s in sets]), shared.value, least, percent)
                ends = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(sets)))))
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sig.view(np.int64)))], ["fp", "signatures"])

    return docs.select("text").mapInArrow(made, "fp binary, signatures array<long>")


def distance(x: str, y: str):
    """The bits in which two bitmaps differ."""
    return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(LONGS)), F.lit(0))


def members(survey: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(fp, doc_id, w, n, bits, pivot, g, c): the classes, how many rows each has, the group it is in, and a hash of it."""
    rows = survey.where("fp is not null and doc_id is not null")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("w"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("minima").alias("minima")), "classes")
    # Of a bucket the class of most rows is the pivot: edited texts are more like what they were made from than each other.
    rank = F.struct((-F.col("w")).alias("w"), "fp").alias("rank")
    keyed = classes.select(rank, F.posexplode("minima").alias("i", "m")).select("rank", F.xxhash64("i", "m").alias("key")).repartition("key")
    buckets = keyed.groupBy("key").agg(F.min("rank").alias("pivot"), F.count("*").alias("size")).where("size > 1").select("key", "pivot")
    near = keyed.join(buckets, "key").where("rank.fp <> pivot.fp").groupBy("rank", "pivot").agg(F.count("*").alias("times"))
    near = written(near.select("rank.fp", F.col("pivot.w").alias("w"), F.col("pivot.fp").alias("pivot"), "times"), "agreeing")
    ends = near.select("fp").unionByName(near.select(F.col("pivot").alias("fp")))
    some = written(marked(classes.select("fp", "n", "bits"), [F.col("fp")], ends, [F.col("fp")]).where("_marked").drop("_marked"), "ends")
    other = some.select(F.col("fp").alias("pivot"), F.col("n").alias("n_p"), F.col("bits").alias("bits_p"))
    least, most = F.least("n", "n_p"), F.greatest("n", "n_p")
    near = near.join(some, "fp").join(other, "pivot").where((F.col("times") >= F.when(most > DENSE, AGREE).otherwise(1)) & allowed(least, most, distance("bits", "bits_p"), F.col("n") + F.col("n_p"), min(percent, GROUPED)))
    near = written(near.groupBy("fp").agg(F.min(F.struct("w", "pivot")).alias("best")).select("fp", F.col("best.pivot").alias("pivot")), "near")
    stars = near.join(near.select(F.col("fp").alias("pivot")), "pivot", "left_anti")  # a pivot is in no other's group
    out = classes.drop("minima").join(stars, "fp", "left").withColumn("pivot", F.coalesce("pivot", "fp"))
    return out.withColumn("g", F.xxhash64("pivot")).withColumn("c", F.xxhash64("fp"))


def allowed(small, large, differ, both, percent: int):
    """Whether sets of such sizes may be similar enough, where they differ in at least so many tokens."""
    return (100 * small >= percent * large) & (differ * (100 + percent) <= both * (100 - percent))


def groups(classes: DataFrame) -> DataFrame:
    """(g, lo, hi, bits, radius): sizes of the least and largest set of a group, bitmap of its pivot, and how far its members' are from that."""
    # Should two pivots share a hash, their groups are one, around the smaller pivot.
    sums = classes.groupBy("g").agg(F.min("pivot").alias("pivot"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    pivots = sums.join(classes.select(F.col("fp").alias("pivot"), F.col("bits").alias("bits_p")), "pivot")
    wide = classes.select("g", "bits").join(pivots, "g")
    return written(wide.groupBy("g").agg(F.max(distance("bits", "bits_p")).alias("radius"), F.first("bits_p").alias("bits"), F.first("lo").alias("lo"), F.first("hi").alias("hi")), "groups")


def meetings(index: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b), a < b: the groups that meet in an index list and may hold a link."""
    list_ = Window.partitionBy("sig")
    posted = index.select(F.xxhash64("fp").alias("c"), F.explode("signatures").alias("sig")).repartition("sig")
    posted = posted.select("sig", "c", F.min("c").over(list_).alias("low"), F.max("c").over(list_).alias("high")).where("low <> high")
    posted = written(posted.select("sig", "c"), "posted")
    released(posted.sparkSession)  # its shuffle files are the join's largest
    lists = posted.join(classes.select("c", "g"), "c").select("sig", "g").repartition("sig").distinct()
    lists = lists.select("sig", "g", F.count("*").over(list_).alias("size"), F.min("g").over(list_).alias("low"), F.bit_xor(F.xxhash64("g", F.lit(1))).over(list_).alias("sum"))
    lists = written(lists.where("size > 1"), "lists")
    # Of the lists that hold the same groups, as those of a passage that many texts share do, one stays.
    one = lists.where("g = low").groupBy("size", "low", "sum").agg(F.min("sig").alias("sig")).select("sig")
    rows = lists.select("sig", "g").join(one, "sig", "left_semi")
    pairs = written(rows.withColumnRenamed("g", "a").join(rows.withColumnRenamed("g", "b"), "sig").where("a < b").select("a", "b").distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("g")).unionByName(pairs.select(F.col("b").alias("g")))
    some = marked(classes.select("fp", "n", "bits", "pivot", "g"), [F.col("g")], ends, [F.col("g")]).where("_marked").drop("_marked")
    of = groups(written(some, "ends"))
    sides = [of.select(*[F.col(c).alias(x if c == "g" else f"{c}_{x}") for c in ("g", "lo", "hi", "bits", "radius")]) for x in "ab"]
    wide = F.greatest(F.lit(0), distance("bits_a", "bits_b") - F.col("radius_a") - F.col("radius_b"))
    # Sizes that may meet: the least of either group's against the largest of the other's.
    close = (100 * F.col("hi_a") >= percent * F.col("lo_b")) & (100 * F.col("hi_b") >= percent * F.col("lo_a"))
    may = close & (wide * (100 + percent) <= (F.col("hi_a") + F.col("hi_b")) * (100 - percent))
    return pairs.join(sides[0], "a").join(sides[1], "b").where(may).select("a", "b")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, s): whole sets, those of the documents in ``wanted`` (doc_id) among them, some more than once."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (r for b in batches for r in chunks(b)):
            found = [s for s in shingles(words(rows, BLANKS)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["fp", "s"])

    return marked(docs, [docs["doc_id"]], wanted, [wanted["doc_id"]]).where("_marked").select("text").mapInArrow(made, "fp binary, s binary")


def cells(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, own, i, j, side, fp, w, n): what cells hold. Of a pair of groups the larger is the anchor a.

    Cell (i, j) of an anchor has block i of its classes (side 0) and block j of those of all groups paired with it (1); where
    ``own``, block j of its own classes, and for i = j these alone (side 0).
    """
    sizes = written(classes.groupBy("g").agg(F.count("*").alias("size")), "sizes")
    both = pairs.join(sizes.select(F.col("g").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("g").alias("b"), F.col("size").alias("size_b")), "b")
    first = (F.col("size_a") > F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("a") < F.col("b")))
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    met = written(both.select(pick("a", "b").alias("a"), pick("size_a", "size_b").alias("size"), pick("b", "a").alias("b"), pick("size_b", "size_a").alias("others")), "anchors")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    block = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    anchors = met.groupBy("a").agg(F.ceil(F.first("size") / BLOCK).cast("int").alias("blocks"), F.ceil(F.sum("others") / BLOCK).cast("int").alias("chunks"))
    member = classes.select("g", "fp", "w", "n")
    kept = ["a", "own", "i", "j", "side", "fp", "w", "n"]
    own = F.lit(False).alias("own")
    left = anchors.join(member, F.col("a") == F.col("g")).select("*", block("blocks").alias("i"), own, F.lit(0).alias("side")).select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
    right = met.select("a", "b").join(member, F.col("b") == F.col("g")).join(anchors, "a").select("*", block("chunks").alias("j"), own, F.lit(1).alias("side")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    inner = sizes.where("size > 1").select(F.col("g").alias("a"), blocks("size").alias("blocks")).join(member, F.col("a") == F.col("g")).select("*", block("blocks").alias("at"), F.lit(True).alias("own"))
    upper = inner.select("*", F.col("at").alias("i"), F.lit(0).alias("side"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("j"))
    lower = inner.where("at > 0").select("*", F.col("at").alias("j"), F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("at") - 1)).alias("i"))
    out = left.select(kept)
    for more in (right, upper, lower):
        out = out.unionByName(more.select(kept))
    return written(out, "cells")


def common(sets: list[np.ndarray], columns: int = 1 << 22) -> np.ndarray:
    """The intersections of all pairs of sets: sums of products of 0/1 matrices over some tokens at a time."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    keep = shared[token]
    token, row = (np.cumsum(shared) - 1)[token[keep]], row[keep]
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    out = np.zeros((n, n), np.float32)
    width = max(1, columns // n)
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(token, (low, low + width))
        held = np.zeros((n, width), np.float32)
        held[row[a:b], token[a:b] - low] = 1
        out += held @ held.T
    return out


def linked(sets: list[np.ndarray], left: int, percent: int) -> np.ndarray:
    """The links among sets, those of the first ``left`` with the others; of all where ``left`` is their number."""
    n, size = len(sets), np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        yes = 100 * both >= percent * (size.sum() - both)
        return np.array([[False, yes], [yes, False]])
    both = common(sets)
    yes = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(yes, False)
    if left < n:
        yes[:left, :left] = yes[left:, left:] = False
    return yes


def forest(yes: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what the links join, at most one a node."""
    left, out = np.ones(len(yes), bool), []
    for root in np.flatnonzero(yes.any(1)):
        if left[root]:
            left[root] = False
            stack = [root]
            while stack:
                node = stack.pop()
                new = np.flatnonzero(yes[node] & left)
                left[new] = False
                out += [(node, x) for x in new]
                stack += new.tolist()
    return out


def verified(rows: DataFrame, sets: DataFrame, percent: int = PERCENT, pairs: bool = False) -> DataFrame:
    """(fp, other, classes, docs) from ``cells``: edges of a forest (classes null) and per class how many it is linked with, and rows of these.

    ``pairs``: all links as edges instead.
    """
    found = rows.agg(F.sum(8 * F.col("n"))).first()[0] or 0
    bucket = F.pmod(F.xxhash64("a", "own", "i", "j"), F.lit(1 + found // BUCKET)).alias("bucket")
    rows = rows.join(sets, "fp").select(bucket, "a", F.col("own").cast("int").alias("own"), "i", "j", "side", "fp", "w", "s")

    def judged(group: pa.Table) -> pa.Table:
        own = np.stack([group[c].to_numpy() for c in ("a", "own", "i", "j", "side")])
        order = np.lexsort(own[::-1])
        own, w = own[:, order], group["w"].to_numpy()[order]
        starts = np.flatnonzero(np.concatenate(([True], (own[:4, 1:] != own[:4, :-1]).any(0))))
        fps, raw = group["fp"].take(order).to_pylist(), group["s"].combine_chunks()
        ends, edges, counts = [*starts[1:], len(order)], [], []
        for begin, end in zip(starts, ends, strict=True):
            once = {(own[4, x], fps[x]): x for x in range(begin, end)}  # a set comes again where a row is repeated or marked by chance
            at = np.array(sorted(once.values()))
            left = int((own[4, at] == 0).sum())
            if len(at) < 2 or left == 0 or left == len(at) and not (own[1, begin] and own[2, begin] == own[3, begin]):
                continue
            yes = linked([np.frombuffer(raw[int(x)].as_buffer(), U64) for x in order[at]], left, percent)
            if yes.any():
                here = [fps[x] for x in at]
                edges += [(here[x], here[y]) for x, y in (np.argwhere(np.triu(yes)) if pairs else forest(yes))]
                many, docs = yes.sum(1), yes @ w[at]
                counts += [(here[x], int(many[x]), int(docs[x])) for x in np.flatnonzero(many)]
        counts = [] if pairs else counts
        return pa.table({
            "fp": pa.array([x for x, _ in edges] + [x for x, _, _ in counts], pa.binary()), "other": pa.array([x for _, x in edges] + [None] * len(counts), pa.binary()),
            "classes": pa.array([None] * len(edges) + [x for _, x, _ in counts], pa.int64()), "docs": pa.array([None] * len(edges) + [x for _, _, x in counts], pa.int64()),
        })

    return rows.groupBy("bucket").applyInArrow(judged, "fp binary, other binary, classes long, docs long")


def _joined(docs: DataFrame, percent: int, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, h, n, fp) per row, the classes and what ``verified`` gives."""
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession) as kept:  # bitmaps, minima and the sketch go before the index is made
        survey = surveyed(docs)
        levels = sketch(survey)
        classes = kept(members(survey, percent), "members")
        survey = kept(survey.where("part is null").select("doc_id", "h", "n", "fp"), "rows")
    with scratch(docs.sparkSession) as kept:  # the index is the largest: it goes before sets are moved
        met = kept(meetings(indexed(docs, *levels, percent), classes, percent), "meetings")
    rows = cells(met, classes)
    wanted = written(rows.select("fp").distinct().join(classes.select("fp", "doc_id"), "fp").select("doc_id"), "wanted")
    return survey, classes, verified(rows, sets_of(docs, wanted), percent, pairs)


def links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """doc_id, n_shingles and class (fp) per row of ``docs``, and all links between classes, (a, b), a < b, each once.

    A group of n near copies has links that grow with the square of n; ``join`` doesn't write them out.
    """
    with scratch(docs.sparkSession) as kept:
        survey, _, found = _joined(docs, percent, True)
        table = kept(survey.select("doc_id", F.col("n").alias("n_shingles"), "fp"), "classes")
        return table, kept(found.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")), "links")


def join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, h, n_shingles, fp, class_id, component, component_id, n_links per row of ``docs``.

    ``h``: hash of the text; ``class_id``: the smallest id of a row with the same set; ``component``: the class that stands
    for all that links reach, and ``component_id`` the smallest id of it; ``n_links``: how many other rows the row is linked
    with, those of its own class included.
    """
    with scratch(docs.sparkSession) as kept:
        survey, classes, found = _joined(docs, percent, False)
        found = written(found, "links")
        counts = found.where("classes is not null").groupBy("fp").agg(F.sum("docs").alias("docs"))
        labels = components(found.where("classes is null").select(F.col("fp").alias("a"), F.col("other").alias("b")))
        named = classes.select("fp", "doc_id").join(labels.withColumnRenamed("node", "fp"), "fp").join(counts, "fp")
        least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        named = written(named.join(least, "label").select("fp", F.col("label").alias("component"), "component_id", "docs"), "components")
        classes = classes.select("fp", F.col("doc_id").alias("class_id"), "w").join(named, "fp", "left")
        rows = survey.select("doc_id", "h", F.col("n").alias("n_shingles"), "fp").join(classes, "fp", "left")
        known = F.col("doc_id").isNotNull() & F.col("class_id").isNotNull()
        rows = rows.select(
            "doc_id", "h", "n_shingles", "fp", F.when(known, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(known, F.coalesce("component", "fp")).alias("component"),
            F.when(known, F.coalesce("component_id", "class_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.when(known, F.col("w") - 1 + F.coalesce("docs", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        )
        return kept(rows, "joined")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, doc_id, n_shingles, component_id, and class_id and n_links, per row of ``docs``."""
    return join(docs).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: of the smallest id, of several such texts one; rows with null ids all stay.

    Only rows whose id and text may be those of a row that goes are shuffled.
    """
    with scratch(docs.sparkSession) as kept:
        rows = join(docs).where("component is not null").select("component", "component_id", F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
        stay = rows.where("_id = component_id").groupBy("component").agg(F.min("_h").alias("stays"))
        keys = rows.join(stay, "component").groupBy("_id", "_h").agg(F.count("*").alias("times"), F.first((F.col("_id") == F.col("component_id")) & (F.col("_h") == F.col("stays"))).alias("stays"))
        gone = kept(keys.where("not stays").select("_id", "_h"), "copies")
        again = kept(keys.where("stays and times > 1").select("_id", "_h"), "repeated")
    key = [docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))]
    out = without(docs, key, gone)
    if again.isEmpty():
        return out
    flag, *own = free(docs.columns, "_marked", "_id", "_h")
    again = again.toDF(*own)
    repeated = marked(docs, key, again, [again[c] for c in own], flag).where(F.col(flag)).select(*docs.columns, *[k.alias(c) for k, c in zip(key, own, strict=True)]).join(again, own, "left_semi")
    return without(out, [out["doc_id"].cast("long"), F.xxhash64(out["text"].cast("string"))], again).unionByName(repeated.dropDuplicates(own).select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: component, class and links of every document."""
    return digest(bounded_batches(spark).read.parquet(f"{sf_dir}/documents.parquet"))
