"""The training-data operators against brute force, and on nulls, empties, repeats, clashing columns and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import bpe_codec, components, decontamination, html_extraction, language_id, lm_scoring, ngram_join, runs, secret_scans, text_blocks, token_counts, topk_search, url_filters

LOW = {i: i + 32 for i in range(65, 91)}
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [None, "", " \t\n", "a", "É!", "x" * 50_000, "naïve café ½ 中文   é", "a\x1cb\x85c", "<|endoftext|> and <|startoftext|>", "it's  two   spaces\n\n\n end ", "A\x00b"]


def words(pattern, text):
    return pattern.findall((text or "").translate(LOW))


def frame(spark, texts, extra=False, lang="en"):
    rows = [(i, t, lang, "s", 1, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, word string")
    return df if extra else df.drop("word")


def prose(n, seed=1, vocabulary=60, length=40):
    r = random.Random(seed)
    base = ["".join(r.choices("aeiourstnl", k=r.randint(2, 7))) for _ in range(vocabulary)]
    return [" ".join(r.choices(base, k=r.randint(1, length))) for _ in range(n)]


def copies(seed=2):
    """Texts with exact and near copies, chains of them, and a shared passage."""
    r = random.Random(seed)
    base = prose(25, seed, 400, 90)
    passage = " ".join(prose(1, 99, 400, 60))
    out = list(base) + [t + " " + passage for t in base[:8]] + base[:6]
    for t in base[:10]:
        for _ in range(6):
            w = t.split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "changed%d" % r.randint(0, 9)
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("pattern,table", [(BLANKS, text_blocks.BLANKS), (ALNUM, text_blocks.ALNUM)])
def test_words_match_the_expression(pattern, table):
    texts = ODD + prose(20)
    seen = {}
    for rows in text_blocks.chunks(pa.RecordBatch.from_pydict({"text": pa.array(texts)}), limit=3000):
        c = text_blocks.words(rows, table)
        for i, t in enumerate(rows.column("text").to_pylist()):
            own = c.hashes[c.first[i] : c.first[i + 1]].tolist()
            expected = words(pattern, t)
            assert len(own) == len(expected)
            for h, w in zip(own, expected, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_url_rules_and_odd_urls(spark):
    urls = ["http://a.com/x", "http://com/", "http://com", "https://EXAMPLE.com/en/1", "https://www.example.com/en/2?q#f", "http://sub.www.example.com/en/", "http://x.net/es/a", "http://notnet/es/", "http://x.net/de/", None, "", "no scheme", "http://x.net/fr", "http://x.net/fr/://b"]
    rows = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(rows).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1] == ("com", "/", "com/", "allow") and got[2] == ("com", "", None, "allow")
    assert got[3] == ("example.com", "/en/1", "example.com/en/", "block") and got[4] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert got[5][2:] == ("www.example.com/en/", "allow") and got[6][2:] == ("net/es/", "block") and got[7][2] is None
    assert got[9] == got[10] == got[11] == ("", "", None, "allow") and got[12][2] is None and got[13][:3] == ("x.net", "/fr/://b", "net/fr/")
    assert url_filters.judge(rows.limit(0)).count() == 0


def test_distrust_runs_against_links(spark):
    page = lambda i, host, path, *links: (i, f"http://{host}{path}", "".join(f'<a class="x" href="http://{h}/">l</a>' for h in links))
    rows = [page(0, "bad.net", "/es/1"), page(1, "bad.net", "/es/2"), page(2, "links.org", "/", "bad.net"), page(3, "good.com", "/", "fine.org"), page(4, "fine.org", "/"), page(5, "fine.org", "/2", "good.com"), page(6, "bad.net", "/en/")]
    got = {r.page_id: r.verdict for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "block" and got[6] == "block" and got[4] == got[5] == "allow"


def test_a_farm_of_hosts_on_a_blocked_host(spark):
    page = lambda i, host, path, *links: (i, f"http://{host}{path}", "".join(f'<a href="http://{h}/">l</a>' for h in links))
    rows = [page(i, f"farm{i}.org", "/", "bad.net") for i in range(20)] + [page(20, "bad.net", "/es/1"), page(21, "mixed.org", "/", "bad.net", "a.org", "b.org", "c.org"), page(22, "a.org", "/")]
    got = {r.page_id: r.verdict for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(21)} == {"block"} and got[21] == got[22] == "allow"


def test_propagate_matches_a_matrix(spark):
    r = random.Random(3)
    hosts = [f"h{i}" for i in range(8)]
    links = {(a, b): r.randint(1, 3) for a in hosts for b in r.sample(hosts, 3) if a != b}
    seeds = {h: r.random() for h in hosts[:3]}
    edges = spark.createDataFrame([(a, b, n) for (a, b), n in links.items()], "source string, target string, n long")
    got = {x.host: x.score for x in url_filters.propagate(spark.createDataFrame(list(seeds.items()), "host string, seed double"), edges, rounds=60).collect()}
    m = np.zeros((8, 8))
    for (a, b), n in links.items():
        m[hosts.index(b), hosts.index(a)] = n
    m = m / np.maximum(m.sum(0), 1)
    want = np.linalg.solve(np.eye(8) - 0.85 * m, 0.15 * np.array([seeds.get(h, 0) for h in hosts]))
    assert all(abs(got.get(h, 0) - w) < 1e-4 for h, w in zip(hosts, want, strict=True))


def test_scores_sum_and_base(spark):
    texts = prose(120) + [None, "", "unseen words only here"]
    got = {r.doc_id: r for r in lm_scoring.score(frame(spark, texts, True)).collect()}
    tokens = {i: words(BLANKS, t) + [0] for i, t in enumerate(texts)}
    late = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(w for i, t in tokens.items() if not late[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (late[i], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) < 1e-6 and r.score < 0


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_model_scores_against_direct_mixture(spark, monkeypatch, block):
    monkeypatch.setattr(lm_scoring, "BLOCK_WORDS", block)
    texts = prose(80, 5) + ["unseen words only here", None] + prose(3, 5)
    df = frame(spark, texts).select("doc_id", "text")
    late = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    one, two, bigrams = collections.Counter(), collections.Counter(), []
    for i, t in enumerate(texts):
        w = [1, *words(BLANKS, t), 0]
        if not late[i]:
            one.update(w), two.update(zip(w, w[1:], strict=False))
            bigrams += zip(w, w[1:], strict=False)
    total, distinct = sum(n for w, n in one.items() if w != 1), len(one) - 1
    bucket = lambda seen: 1 + int(math.log2(seen)) if seen else 0
    # Deleted estimates of each training token, and EM over single tokens instead of cells.
    rows = collections.defaultdict(list)
    for h, x in bigrams:
        p = (one[x] - 1) / (total - 1)
        rows[bucket(one[h] - 1)].append(((two[h, x] - 1) / (one[h] - 1) if one[h] > 1 else p, p, 1 / (distinct + 1)))
    direct = {}
    for k, found in rows.items():
        p, w = np.array(found), np.full(3, 1 / 3)
        for _ in range(100):
            share = p * w
            w = (share / share.sum(1, keepdims=True)).mean(0)
        direct[k] = w
    blocks, t = lm_scoring.resolved(df.select("doc_id", lm_scoring.held_out().alias("held_out"), "text"))
    weights = lm_scoring.mixture(blocks, t)
    assert (t.tokens, t.distinct) == (total, distinct) and np.allclose(weights.sum(1), 1)
    assert all(np.abs(weights[k] - w).max() < 0.08 for k, w in direct.items() if len(rows[k]) > 50 and k)
    for r in lm_scoring.score(df).collect():
        w, want = [1, *words(BLANKS, texts[r.doc_id]), 0], 0.0
        for h, x in zip(w, w[1:], strict=False):
            a, p = weights[bucket(one[h])], one[x] / total
            want += math.log10(a[0] * (two[h, x] / one[h] if one[h] else p) + a[1] * p + a[2] / (distinct + 1))
        assert abs(want - r.score) < 1e-6


def test_scores_of_odd_tables(spark):
    df = frame(spark, ODD + ODD, True)
    assert lm_scoring.score(df).count() == 2 * len(ODD) and lm_scoring.score(df.limit(0)).count() == 0
    only_late = df.where(lm_scoring.held_out())
    assert all(abs(r.score - r.n_tokens * math.log10(1.0)) < 1e-6 or r.score <= 0 for r in lm_scoring.score(only_late).collect())
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in lm_scoring.score(nulls).collect()) == [("1", 2), ("None", 3), ("None", 3)]


def test_deleted_interpolation_prefers_what_holds_out():
    bucket = np.zeros(2, int)
    w = lm_scoring.expectation_maximisation(bucket, np.array([90.0, 10.0]), np.array([90 * 0.5, 0.0]), np.array([90 * 0.01, 10 * 0.01]), 1e-4)
    assert w[0, 0] > 0.8 and w[0, 2] < w[0, 1]


def test_squeeze_round_trip():
    a = np.array([0, 1, 5, 2**40, 2**63], np.uint64)
    assert (runs.expand(runs.squeeze(a), np.uint64) == a).all() and len(runs.expand(b"", np.uint64)) == 0


def test_languages(spark):
    r = random.Random(4)
    kinds = {"aa": "the and ing tion er of to".split(), "bb": "der und ung keit sch ein ß".split(), "cc": "que ción los ñe ado ía".split()}
    rows = []
    for i in range(240):
        lang = list(kinds)[i % 3]
        rows.append((i, " ".join("".join(r.choices(kinds[lang], k=r.randint(1, 3))) for _ in range(30)), lang, "clash"))
    rows += [(900, None, "aa", ""), (901, "123 !!", "aa", ""), (902, "", None, ""), (903, "The AND ing", None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language_id.fit(df)
    got = {x.doc_id: x for x in language_id.predict(df.drop("score"), model).collect()}
    late = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert late and all(got[i].lang_pred == rows[i][2] and not got[i].rejected for i in late)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902)) and got[903].lang_pred == "aa"
    assert all(0 <= x.score <= 1 for x in got.values())
    none = language_id.fit(df.where("lang is null"))
    assert none is None and {x.lang_pred for x in language_id.predict(df.drop("score"), none).collect()} == {"und"}


def test_kneser_ney_sums_to_one(spark):
    df = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(prose(60))], "doc_id long, text string, lang string")
    m = language_id.fit(df)
    letters = sorted({c for t in prose(60) for c in t if c != " "})
    for context in ("ae", "zz", "s"):
        codes = [language_id.PAD] * (3 - len(context)) + [ord(c) for c in context]
        grams = np.array([(codes[0] << 48) | (codes[1] << 32) | (codes[2] << 16) | x for x in [*map(ord, letters), language_id.END]], np.uint64)
        total = np.exp(language_id._log_probability(m, grams)[:, 0]).sum()
        assert 0.9 < total <= 1.0 + 1e-6


def hits(texts, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(ALNUM, t)
        for k in range(max(1, len(w) - 12)):
            if w and i is not None:
                windows[tuple(w[k : k + 13])].add(str(i))
    out = []
    for t in texts:
        w, hit, found = words(ALNUM, t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        out.append((len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("per_block", [1 << 20, 7])
def test_decontamination(spark, per_block):
    base = prose(30, 7, 50, 60)
    items = [(1, base[0]), (2, base[1][:60]), (10, "one two"), (11, "solo"), (12, ""), (13, None), (None, base[2]), (14, base[0])]
    texts = base + ["x " + base[0] + " y", "ONE, two! solo one two", None, "", "one\ntwo"] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(decontamination.decontaminate(frame(spark, texts, True), bench, per_block=per_block).collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in got] == hits(texts, items)
    assert decontamination.decontaminate(frame(spark, texts).limit(0), bench).count() == 0
    clean = decontamination.decontaminate(frame(spark, texts), bench.limit(0)).collect()
    assert len(clean) == len(texts) and not any(r.contaminated for r in clean)


def test_cleaning_judges_rows_of_null_and_repeated_ids(spark):
    bad, bench = prose(1, 12, 300, 60)[0], "doc_id long, text string"
    rows = [(None, bad), (None, "clean text"), (None, None), (1, bad), (1, "another clean text"), (1, bad), (2, "clean text")]
    left = decontamination.clean(spark.createDataFrame(rows, bench), spark.createDataFrame([(1, bad)], "item_id long, text string"))
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(tuple, left.collect()), key=key) == sorted([r for r in rows if r[1] != bad], key=key)


def test_proximity(spark):
    index = decontamination.build_index(frame(spark, ["alpha x x beta", "beta " + "x " * 40 + "alpha", "alpha"]))
    assert decontamination.near(index, [("p", "alpha beta")], slack=4).collect() == [(0, "p")]


def joined(texts):
    sets = {}
    for d, t in enumerate(texts):
        w = words(BLANKS, t)
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize("frequent,part,block", [(48, 64, 512), (2, 8, 3), (1, 5, 2)])
def test_jaccard_join(spark, monkeypatch, frequent, part, block):
    for name, value in (("FREQUENT", frequent), ("PART", part), ("BLOCK", block)):
        monkeypatch.setattr(ngram_join, name, value)
    texts = copies() + ODD + ["a b c", "A  b\tc", "a b"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.digest(frame(spark, texts, True)).collect()}
    assert got == joined(texts)


def test_a_rare_and_a_frequent_token_make_a_candidate(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    passage = "p1 p2 p3 p4 p5 p6 p7"
    texts = ["w0 " + passage, "w0 " + passage + " w9"] + [" ".join(f"z{i}x{j}" for j in range(40)) + " " + passage for i in range(6)]
    want = joined(texts)
    assert want[1] == (5, 0)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.digest(frame(spark, texts)).collect()} == want


@pytest.mark.parametrize("percent", [50, 80, 95])
@pytest.mark.parametrize("least", [0, 3, 60])
def test_similar_sets_share_a_signature(percent, least):
    r = np.random.default_rng(percent + least)
    levels = r.integers(0, 8, 1 << 10).astype(np.uint8)
    tried = 0
    for _ in range(300):
        union = np.unique(r.integers(0, 2**63, r.integers(2, 400)).astype(np.uint64))
        kind = r.choice(3, len(union), p=[percent / 100, (1 - percent / 100) / 2, (1 - percent / 100) / 2])
        x, y = union[kind != 1], union[kind != 2]
        if 100 * (kind == 0).sum() >= percent * len(union) and len(x) > 1 and len(y) > 1:
            sig, own = ngram_join.signatures(np.concatenate([x, y]), np.array([len(x), len(y)]), levels, least, percent)
            assert np.intersect1d(sig[own == 0], sig[own == 1]).size
            tried += 1
    assert tried > 20


def test_signatures_of_frequent_tokens_grow_with_the_set():
    levels = np.full(1 << 10, 9, np.uint8)
    for m in (1000, 20_000):
        s = np.unique(np.random.default_rng(m).integers(0, 2**63, m).astype(np.uint64))
        assert len(ngram_join.signatures(s, np.array([len(s)]), levels, 1)[0]) < 8 * m


@pytest.mark.parametrize("block", [512, 4])
def test_all_links_are_returned(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    texts = copies() + [" ".join(f"n{j}" if j != 3 * i else f"m{i}" for j in range(120)) for i in range(14)] + ODD
    sets = [frozenset(zip(*[words(BLANKS, t)[k:] for k in range(5)], strict=False)) for t in texts]
    table, found = ngram_join.links(frame(spark, texts))
    of = {r.doc_id: r.fp for r in table.collect()}
    linked = lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y)
    want = {tuple(sorted((bytes(of[i]), bytes(of[j])))) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if x != y and linked(x, y)}
    got = [(bytes(r.a), bytes(r.b)) for r in found.collect()]
    assert len(got) == len(want) >= 91 and set(got) == want
    for r in ngram_join.digest(frame(spark, texts)).collect():
        x = sets[r.doc_id]
        if len(words(BLANKS, texts[r.doc_id])) >= 5:
            assert r.n_links == sum(bool(linked(x, y)) for y in sets) - 1 and r.class_id == sets.index(x)


def test_jaccard_join_of_nothing_null_and_repeated_ids(spark):
    t, other = "a b c d e f", "g h i j k l m"
    df = spark.createDataFrame([(None, t), (3, t), (4, t), (None, None), (3, other), (7, other), (7, other)], "doc_id long, text string")
    got = sorted(tuple(map(str, (r.doc_id, r.component_id, r.n_links))) for r in ngram_join.digest(df).collect())
    assert got == [("3", "3", "1"), ("3", "3", "2"), ("4", "3", "1"), ("7", "3", "2"), ("7", "3", "2"), ("None", "None", "0"), ("None", "None", "0")]
    assert ngram_join.digest(df.limit(0)).count() == 0 and ngram_join.one_of_each(df.limit(0)).count() == 0


def test_one_of_each_keeps_a_row_of_every_component(spark):
    t, u, v = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(3, t, "k"), (5, t, "k"), (5, u, "k"), (None, t, "k"), (None, None, "k"), (8, v, "k"), (8, v, "l"), (8, v.upper(), "k"), (9, v + " w", "k"), (10, None, "k"), (10, None, "k"), (11, "", "k")]
    left = [tuple(r) for r in ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()]
    last = [r for r in left if r[0] in (8, 9)]
    assert len(last) == 1 and last[0][0] == 8
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([r for r in left if r[0] not in (8, 9)], key=key) == sorted([rows[i] for i in (0, 2, 3, 4, 9, 10, 11)], key=key)


def test_bitmaps_bound_differences():
    r = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 400, r.integers(1, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in ngram_join.bitmap(a) ^ ngram_join.bitmap(b))
        assert differ <= len(np.setxor1d(a, b))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert set(got[i] for i in range(41)) == {0} and got[101] == 100


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_components_by_shuffles_and_by_broadcasts(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    got = components.components(spark.createDataFrame([(5, 6), (6, 7), (2, 3), (30, 31), (3, 7), (7, 3)], "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == {2: 2, 3: 2, 5: 2, 6: 2, 7: 2, 30: 30, 31: 30}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scratch_tables_are_deleted(spark):
    import os

    from tidewatch.llm.storage import scratch, shared_dir, written

    with scratch(spark) as kept:
        gone, stays = written(spark.range(3), "gone"), kept(spark.range(4), "stays")
        paths = [f.removeprefix("file://") for f in gone.inputFiles()]
        assert gone.count() == 3
    assert stays.count() == 4 and not any(map(os.path.exists, paths)) and shared_dir(spark)


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k(spark, block):
    r = np.random.default_rng(5)
    vectors = [(i, r.normal(size=6).round(1).tolist()) for i in range(120)] + [(200, [0.5] * 6), (201, [0.5] * 6), (300, None), (301, [float("nan")] * 6), (302, [None] + [1.0] * 5), (400, [float("inf")] * 6), (500, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, score int")
    good = {i: [math.floor(1024 * x) for x in v] for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in good:
        if q % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(good[q], good[c], strict=True)), c) for c in good if c != q))[:10]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(tuple(x) for x in topk_search.top_k(df, query_step=20, per_block=block).collect()) == sorted(want)
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_top_k_holds_scores_to_64_bits(spark):
    rows = spark.createDataFrame([(100, [1e16, 1.0]), (1, [1e16, 1.0]), (2, [-1e16, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk_search.top_k(rows, k=3).orderBy("rank").collect()] == [(1, (1 << 63) - 1), (3, 1 << 20), (2, -(1 << 63))]


def secrets(text):
    rules = [("assign", re.compile(r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6), ("access", re.compile(r"()(AKIA[A-Z0-9]+)"), 20), ("hex", re.compile(r"()([0-9a-f]+)"), 24)]
    return sorted((m.start(), i, k, m.end()) for i, (k, p, n) in enumerate(rules) for m in p.finditer(text or "") if len(m[2]) >= n)


def test_secret_scans(spark):
    texts = ODD + ["password=abc secret : 'abcdef' x", "é token=token=abcdef1 API_KEY\"=zzzzzz9", "secret=token :abcdef", "AKIA" + "A" * 16 + " xAKIAAKIA" + "0" * 12, "f" * 24 + "g" + "0" * 23, "\x01\x02password=\x03secret=abcdef\x01", "ghp_" + "a1" * 18, "apikey='" + "f0" * 16 + "' " * 3] * 2
    got = {r.doc_id: r for r in secret_scans.digest(secret_scans.scan(frame(spark, texts, True))).collect()}
    for i, t in enumerate(texts):
        want = secrets(t)
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        kinds = collections.Counter(k for _, _, k, _ in want)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == (kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(line.encode()).hexdigest()), t
        assert set(filter(None, line.split(","))) <= set(got[i].spans.split(","))
    assert "forge:0:40" in got[texts.index("ghp_" + "a1" * 18)].spans
    assert secret_scans.scan(frame(spark, texts).limit(0)).count() == 0


def test_trigram_queries_hold_for_matches():
    samples = {"assign": ["Password = abcdefgh", 'api_key":"zzzzzz', "APIKEY=123456"], "access": ["AKIA" + "Z" * 16], "forge": ["ghp_" + "x" * 36], "pem": ["-----BEGIN RSA PRIVATE KEY-----"], "chat": ["xoxb-1234567890"]}
    holds = lambda q, t: True if q is True else q in t if isinstance(q, str) else (all if q[0] == "and" else any)(holds(x, t) for x in q[1])
    for rule in secret_scans.RULES:
        q = secret_scans.trigram_query(rule.prefix + rule.secret)
        for s in samples.get(rule.kind, []):
            assert re.search(rule.prefix + rule.secret, s) and q is not True and holds(q, s.lower())
    assert secret_scans.trigram_query("[0-9a-f]{24,}") is True and secret_scans.trigram_query("abc|xyz") == ("or", ("abc", "xyz"))


def test_redaction(spark):
    df = frame(spark, ["x password=abcdef0123 y", "plain", None], True)
    assert [r.text for r in secret_scans.redact(df).orderBy("doc_id").collect()] == ["x [assign] y", "plain", None]


def test_html_extraction(spark):
    body = "<p>First paragraph of the story, long enough to count as text.</p><p>Short.</p><ul><li>One &amp; two</li></ul><p>Another <b>bold</b> line that goes on for a while &eacute;&#33;</p>"
    pages = [
        f"<html><head><title>T</title><style>p{{}}</style></head><body><header>Site</header><nav><a>Menu</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Head</h1>{body}<div id='comments'><p>Reader says a lot of things here, at length.</p></div></article><aside>Side</aside><form>Name <input></form><footer>Foot</footer></body></html>",
        f"<body><div class='menu'><a>a</a><a>b</a></div><div class='content'>{body}</div><div class=sidebar>Links</div></body>",
        None, "", "<article>cut off <b>here", "no tags at all", "<script>x</script>",
    ]
    rows = spark.createDataFrame([(i, "u", h, 9) for i, h in enumerate(pages)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_extraction.extract(rows).collect()}
    main = "First paragraph of the story, long enough to count as text. Short. One & two Another bold line that goes on for a while é!"
    assert got[0].text == "Head " + main and got[1].text == main
    assert [got[i].text for i in range(2, 7)] == ["", "", "cut off here", "no tags at all", ""] and got[0].n_chars == len(got[0].text)


def test_html_of_deep_pages_comments_and_names():
    deep = "<article>" + "<div>" * 3000 + "<p>Text that lies deep within the page.</p>" + "</div>" * 3000 + "</article>"
    assert html_extraction.main_text(deep) == "Text that lies deep within the page."
    page = "<body><article><p>The story itself, of some length to be read.</p><article class='comment'><p>A reader says what readers say here.</p></article></article></body>"
    assert html_extraction.main_text(page) == "The story itself, of some length to be read."
    named = "<body><nav>Menu</nav><div class='search-story'><p>The story itself, of some length to be read.</p></div><div class='story-comments'><p>A reader says what readers say.</p></div></body>"
    assert html_extraction.main_text(named) == "The story itself, of some length to be read."


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.vocabulary_path())
    texts = ODD + prose(30) + ["Don't STOP they'll we've I'm", "a.b,c!!! 123 4½", "x" * 300, "ÀÉÎõ ß İ ſ K"]
    for r in token_counts.count_tokens(frame(spark, texts, True)).collect():
        s = texts[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes) == (len(t.encode(s, add_special_tokens=False).ids), len(s.encode())), s[:60]
    whole = token_counts.whole_tokens(token_counts.vocabulary_path())
    assert len(whole) > 10_000 and all(len(t.encode(w, add_special_tokens=False).ids) == 1 for w in whole[:200])


@pytest.mark.parametrize("bound", [1 << 17, 3])
def test_codec(spark, bound, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe_codec, "TASK_WORDS", 50)
    t = Tokenizer.from_file(bpe_codec.vocabulary_path())
    texts = ODD + prose(30) + ["Don't  stop\n\n  they'll\t\tgo", " lead", "trail ", "a\n b\r\n\tc  ", "12 345½"]
    for r in bpe_codec.decode(bpe_codec.encode(frame(spark, texts, True), bound=bound)).collect():
        s = texts[r.doc_id] or ""
        ids = t.encode(s, add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == (",".join(map(str, ids)), len(ids), t.decode(ids, skip_special_tokens=False)), s[:60]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    texts = [f"{t} {t}" for t in prose(60, 8, 300, 60)] + ["12 34", None] + ["copy of this text with words enough to be compared as one of the two"] * 2
    secret = "here is a password=abcdef012345 within " + prose(1, 11, 300, 50)[0]
    bad = "the benchmark passage of more than thirteen words that stands in this document whole and entire"
    df = frame(spark, [*texts, secret, bad])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns, name
    left = {r.doc_id: r.text for r in docs.collect()}
    assert {60, 61, 63, 65}.isdisjoint(left) and 62 in left and left[64].startswith("here is a [assign] within")
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in final.collect()) == sorted(left) and final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
