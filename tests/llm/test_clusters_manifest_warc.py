"""Clusters, manifests and archives against plain Python, with nulls, ties, repeats, empty tables and clashing columns."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import centroid_clustering, merkle_manifest, ranks, warc

VECTORS = "vec_id long, embedding array<float>, v string, cluster string"


def lloyd(rows, k, dims, rounds):
    """Every vector against every centroid, in whole numbers of any size."""
    kept = []
    for i, e, *_ in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e):
            held = lambda x: min(max(math.floor(1024 * float(np.float32(x))), -(1 << 63)), (1 << 63) - 1)
            kept.append((i, [held(x) for x in e]))
    h = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", i or 0)
    centroids = [v for _, v in sorted(kept, key=lambda r: (h(r[0]), r[1]))[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    pick = lambda v: min((away(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [pick(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), c in zip(kept, of, strict=True) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    most = (1 << 63) - 1
    out = [(i, pick(v)[1], min(pick(v)[0], most)) for i, v in kept]
    total = {c: min(sum(d for _, x, d in out if x == c), most) for c in range(k)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(map(str, [(i, c, d, total[c], min(sum(x for *_, x in out), most), digest[c]) for i, c, d in out]))


def clusters(spark, rows, **how):
    found = centroid_clustering.clustered(spark.createDataFrame(rows, VECTORS), **how)
    return sorted(str(tuple(r)) for r in found.collect())


@pytest.mark.parametrize("scale", [1.0, 1e12])
def test_clusters(spark, scale):
    r = random.Random(7)
    middle = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [scale * float(np.float32(x + r.gauss(0, 0.2))) for x in r.choice(middle)], "clash", "clash") for i in range(120)]
    rows += [(5, rows[5][1], "", ""), (5, rows[6][1], "", ""), (None, rows[7][1], "", ""), (200, None, "", ""), (201, [1.0] * 5, "", ""), (202, [None] + [1.0] * 5, "", ""), (203, [math.nan] * 6, "", ""), (204, [math.inf] * 6, "", ""), (205, [0.0] * 6, "", "")]
    rows += [(300 + i, [0.5, -0.25, 0.0, 1.0, 0.0, 0.0], "", "") for i in range(60)]  # a third are copies
    assert clusters(spark, rows, k=5, dims=6, rounds=6, segments=3) == lloyd(rows, 5, 6, 6)


def test_clusters_of_few_and_none(spark):
    rows = [(1, [1.0, 2.0], "", ""), (2, [1.0, 2.0], "", "")]
    assert clusters(spark, rows, k=8, dims=2, rounds=3, segments=2) == lloyd(rows, 8, 2, 3)
    assert clusters(spark, [(1, None, "", "")], k=8, dims=2, segments=1) == [] and clusters(spark, [], dims=2, segments=1) == []
    assert clusters(spark, [(1, [3e38, -3e38], "", ""), (2, [0.0, 0.0], "", "")], k=1, dims=2, rounds=2, segments=2) == lloyd([(1, [3e38, -3e38]), (2, [0.0, 0.0])], 1, 2, 2)


def test_screening_spares_distances_and_loses_none():
    r = np.random.default_rng(5)
    middle = r.integers(-4000, 4000, (8, 64))
    values = (middle[r.integers(0, 8, 2000)] + r.integers(-300, 300, (2000, 64))).astype(np.int64)
    best, distance, took = centroid_clustering.nearest(values, centroid_clustering.segment_norms(values, 8), middle, centroid_clustering.segment_norms(middle, 8))
    all_ = ((values[:, None, :] - middle[None]) ** 2).sum(2)
    assert (best == all_.argmin(1)).all() and (distance == all_.min(1)).all() and took < 0.5 * all_.size


DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, h string"


def digest(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return hashlib.sha256("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values).encode()).hexdigest()


def joined(hashes):
    return hashlib.sha256("".join(hashes).encode()).hexdigest()


def climb(leaves):
    """(root, the siblings of each leaf by levels)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([joined(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for i in range(len(leaves)):
        path, at = [], i
        for nodes in levels[:-1]:
            run = at // 3 * 3
            path.append((nodes[run:at], nodes[at + 1 : run + 3]))
            at //= 3
        paths.append(path)
    return levels[-1][0], paths


def manifest(rows):
    by = {}
    for row in rows:
        by.setdefault(row[3], []).append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, digest(r, r[1])))
        trees[s] = (own, *climb([digest(r, r[1]) for r in own]))
    root, above = climb([trees[s][1] for s in names])
    out = []
    for s, top in zip(names, above, strict=True):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths, strict=True):
            text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            now = digest(r, text)
            for left, right in path + top:
                now = joined([*left, now, *right])
            out.append(str((r[0], digest(r, r[1]), subroot, root, joined([h for left, right in path + top for h in left + right]), now, now == root)))
    return sorted(out)


def altered():
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


@pytest.mark.parametrize("depth,limit", [(1, 2), (2, 5), (6, 4096)])
def test_manifest(spark, depth, limit):
    r = random.Random(3)
    text = lambda: r.choice([None, "", "a\nb", "x" * 20_000, "é\n", "line\n" * 3, "plain"])
    ids = [*range(60), *[r.randrange(-(1 << 63), 1 << 63) for _ in range(30)], (1 << 63) - 1, -(1 << 63)]
    rows = [(i, text(), r.choice(["en", None]), r.choice(["big", "big", "s", "", None, "é"]), r.choice([1, None]), "clash", "clash") for i in ids]
    rows += [(7, "same\n", "en", "big", 1, "", "")] * 9 + [(7, f"t{i}\n", "en", "big", 1, "", "") for i in range(9)] + [(None, f"n{i}", "en", "big", 1, "", "") for i in range(7)] + [(1, "alone\n", "en", "only", 1, "", "")]
    rows += [(1000 + i, "\n", None, f"www.a.example/{i:03}", 2, "", "") for i in range(40)]  # names that share more than seven bytes
    built = merkle_manifest.build(spark.createDataFrame(rows, DOCS), depth=depth, altered=altered(), limit=limit)
    found = merkle_manifest.proofs(built)
    assert sorted(str(tuple(x)) for x in found.collect()) == manifest(rows)
    assert built.root() == found.first().root and built.subroots().count() == len({x[3] for x in rows})


def test_manifest_of_one_and_none(spark):
    one = [(3, "a\n", "en", "s", 1, "", "")]
    assert sorted(str(tuple(x)) for x in merkle_manifest.proofs(merkle_manifest.build(spark.createDataFrame(one, DOCS), altered=altered())).collect()) == manifest(one)
    none = merkle_manifest.build(spark.createDataFrame([], DOCS))
    assert none.root() is None and merkle_manifest.proofs(none).collect() == []


def test_ranks_of_crowded_groups(spark):
    r = random.Random(1)
    rows = [("big", r.choice([None, 5, 5, 6, 1 << 40, *range(100, 400)]), i) for i in range(1500)] + [(f"g{i % 7}", r.randrange(50), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, x long, row long")
    number = lambda k: F.when(k == 0, F.col("x")).otherwise(F.col("row"))
    got = {(x.g, x.row): (x["rank"], x.n) for x in ranks.ranked(df, "g", number, [F.asc_nulls_first("x"), F.col("row")], limit=8).collect()}
    for g in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [got[g, x[2]] for x in own] == [(i, len(own)) for i in range(len(own))]


PAGES = "page_id long, url string, html string, digest string, frame string"


def pages():
    r = random.Random(4)
    rows = [(i, f"http://h{i}.example/a b\n{i}", r.choice([None, "", "é" * 50, "copy", f"<p>{i}</p>", "x" * 30_000]), "clash", "clash") for i in range(80)]
    return rows + [(90 + i, None, "hot", "", "") for i in range(40)] + [(129, "http://x", "hot", "", ""), (None, "u", "hot", "", ""), (None, "u", "alone", "", ""), (95, None, "95", "", ""), (95, None, "95", "", "")]


def archived(rows, least=0):
    top = {}
    for i, _, html, *_ in rows:
        top[html or ""] = max(top.get(html or "", -1), -1 if i is None else i)
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        first = len(data) < least or (-1 if i is None else i) == top[html or ""]
        out.append(str((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else top[html or ""], True)))
    return sorted(out)


@pytest.mark.parametrize("least,frame,bundle", [(0, 1 << 20, 1 << 28), (5, 500, 2000)])
def test_archives_round_trip(spark, tmp_path, least, frame, bundle):
    rows = pages()
    index = warc.write(spark.createDataFrame(rows, PAGES).repartition(3), f"file://{tmp_path}/w", least=least, frame_bytes=frame, bundle_bytes=bundle)
    back = warc.read(index)
    got = warc.resolved(back).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
    assert sorted(str(tuple(x)) for x in got.collect()) == archived(rows, least)
    whole = {x.record_id: x.payload for x in back.collect()}
    kept = {(html or "", i, u) for i, u, html, *_ in rows if of_type(i, html, rows, least) == "response"}
    assert sorted(bytes(p).decode() for p in whole.values() if p is not None) == sorted(html for html, *_ in kept)
    some = spark.createDataFrame([(k,) for k in list(whole)[::5]] + [("urn:uuid:none",)], "record_id string")
    assert {x.record_id: x.payload for x in warc.fetch(index, some).collect()} == {k: whole[k] for k in list(whole)[::5]}


def of_type(page_id, html, rows, least):
    top = max([-1 if i is None else i for i, _, other, *_ in rows if (other or "") == (html or "")])
    return "response" if len((html or "").encode()) < least or (-1 if page_id is None else page_id) == top else "revisit"


def test_any_reader_reads_a_bundle(spark, tmp_path):
    import zstandard

    index = warc.write(spark.createDataFrame(pages(), PAGES).coalesce(1), f"file://{tmp_path}/w", frame_bytes=2000)
    path = index.first().bundle.removeprefix("file://")
    with open(path, "rb") as file:
        text = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert text.count(b"WARC/1.1\r\n") == len(pages()) and index.select("frame").distinct().count() > 5
    raw = open(path, "rb").read()
    for r in index.collect():
        start, stored, size = warc.frames(index).where(f"frame = {r.frame}").first()[2:] if r.frame < 2 else (None, None, None)
        if start is not None:
            assert zstandard.ZstdDecompressor().decompress(raw[start : start + stored], max_output_size=size)[r.at :][:10] == b"WARC/1.1\r\n"
    text = text[text.index(b"WARC/1.1\r\nWARC-Type: response") :]
    cut = warc.parsed(memoryview(text), 0)[0]
    assert cut["intact"] and not warc.parsed(memoryview(text.replace(b"sha1:" + cut["payload_digest"].encode(), b"sha1:" + b"A" * 32, 1)), 0)[0]["intact"]


def test_archive_of_nothing(spark, tmp_path):
    index = warc.write(spark.createDataFrame([], PAGES), f"file://{tmp_path}/w")
    assert index.count() == 0 and warc.resolved(warc.read(index)).count() == 0
