"""Resolution within a batch against a plain loop over the candidates in order."""

import hashlib
import random

import pytest

from tidewatch.operators import graph, identity
from tidewatch.tables import workspace

KINDS = [("referencia", 100), ("url", 70), ("titulo", 30)]


def loop(candidates, known, dataset):
    """One by one: look the keys up, decide, write."""
    held, out = dict(known), []
    for cand, keys in candidates:
        found = {}
        for tipo, valor, forca in sorted(keys, key=lambda k: -k[2]):
            if (tipo, valor) in held:
                found.setdefault(held[tipo, valor], []).append((tipo, forca))
        lacking = [k for k in keys if (k[0], k[1]) not in held]
        only_title = dataset and len(found) == 1 and all(t == "titulo" for own in found.values() for t, _ in own) and any(k[0] == "url" for k in lacking)
        if not found or only_title:
            top = max(keys, key=lambda k: (k[2], k[0], k[1]))
            result, fund = "novo", hashlib.sha256(f"{top[0]}:{top[1]}".encode()).hexdigest()
        elif len(found) == 1:
            result, fund = "existente", next(iter(found))
        else:
            result, fund = "conflito", min(found, key=lambda f: (-max(x for _, x in found[f]), f))
        if result != "conflito":
            for tipo, valor, _ in lacking:
                held[tipo, valor] = fund
        out.append((cand, result, fund, len(lacking), sorted(found)))
    return out, {k: v for k, v in held.items() if k not in known}


def batch(seed, n, spread):
    r = random.Random(seed)
    known = {(t, f"{t[0]}{r.randrange(spread)}"): str(r.randrange(6)) for t, _ in KINDS for _ in range(spread // 8)}
    pick = lambda t: f"{t[0]}{int(spread * r.random() ** 2)}"  # noqa: E731  some keys are of many
    return [(i, [(t, pick(t), f) for t, f in KINDS if r.random() < 0.75] or [("titulo", pick("titulo"), 30)]) for i in range(n)], known


def chain(n):
    """Each shares a key with the one before: the same fund from end to end, or the other way round."""
    up = [(i, [("url", f"c{i}", 70), ("referencia", f"c{i - 1}" if i else "start", 100), ("titulo", f"x{i}", 30)] + ([("url", f"c{i - 1}", 70)] if i else [])) for i in range(n)]
    return up


def run(spark, candidates, known, **how):
    rows = [(c, t, v, f, "clash") for c, keys in candidates for t, v, f in keys]
    found, added = identity.resolve_batch(spark.createDataFrame(rows, "cand_id long, tipo string, valor string, forca int, fund_id string"), spark.createDataFrame([(t, v, f) for (t, v), f in known.items()], "tipo string, valor string, fund_id string"), **how)
    return sorted((r.cand_id, r.resultado, r.fund_id, r.chaves_novas, r.nomeados) for r in found.collect()), {(r.tipo, r.valor): r.fund_id for r in added.collect()}


@pytest.mark.parametrize("seed,n,spread,most,dataset", [(1, 60, 40, 1000, False), (2, 120, 60, 4, False), (3, 120, 90, 1000, True), (4, 80, 30, 1, True)])
def test_batches_as_one_by_one(spark, seed, n, spread, most, dataset):
    candidates, known = batch(seed, n, spread)
    # one key of a third of all
    candidates = [(c, keys + [("titulo", "everywhere", 30)] if c % 3 == 0 else keys) for c, keys in candidates]
    got, want = run(spark, candidates, known, dataset=dataset, most=most), loop(candidates, known, dataset)
    assert [(a, b) for a, b in zip(got[0], want[0], strict=True) if a != b] == [] and got[1] == want[1]


def test_a_long_chain(spark):
    candidates = chain(150)
    assert run(spark, candidates, {("url", "c70"): "9"}) == loop(candidates, {("url", "c70"): "9"}, False)
    assert run(spark, [(149 - c, keys) for c, keys in candidates], {}) == (lambda x: (sorted(x[0]), x[1]))(loop(sorted((149 - c, keys) for c, keys in candidates), {}, False))


def test_no_candidates(spark):
    assert run(spark, [], {("url", "a"): "1"}) == ([], {})


def test_components(spark):
    r = random.Random(6)
    links = [(i, i + 1) for i in range(1000, 1200)] + [(r.randrange(300), r.randrange(300)) for _ in range(120)] + [(5000, 6000 + i) for i in range(300)] + [(1, 1)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    with workspace(spark) as save:
        got = {x.node: x.label for x in graph.components(spark.createDataFrame(links, "a long, b long"), save).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
