"""Near vectors against all pairs."""

import math

import numpy as np

from siftwell.llm import spherical

from .test_jaccard import union_find


def brute(rows, threshold=0.93):
    good = [(i, np.array(v, np.float64) / max(map(abs, v)), a) for i, v, a in rows if v and a is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {}
    edges = []
    for p in range(len(good)):
        for q in range(p):
            (i, x, a), (k, y, b) = good[p], good[q]
            if a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                edges.append((p, q))
                links[p] = links.get(p, 0) + 1
                links[q] = links.get(q, 0) + 1
    top = union_find(range(len(good)), edges)
    return good, links, top


def test_near_vectors_brute(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        if rows and rng.random() < 0.6:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.standard_normal(16) * rng.choice([0, 0.05, 0.1, 0.2])
        else:
            v = rng.standard_normal(16)
        rows.append((int(i * 7 % 300), [float(x) for x in v], int(rng.integers(3)) if rng.random() < 0.95 else None))
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 16, 1), (303, [None] * 16, 1), (304, [float("nan")] * 16, 1), (305, [float("inf")] + [1.0] * 15, 1), (306, [1e300] * 16, 1), (307, [1e-300] * 16, 1), (308, [1.0] * 15, 1), (309, [-0.0] + [1.0] * 15, 1), (310, [0.0] + [1.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "vec_id long, embedding array<double>, label int, n_links string").repartition(3)
    got = {r.vec_id: r for r in spherical.near_vectors(df, spherical.Caps(block=16)).collect()}
    assert len(got) == len(rows)
    good, links, top = brute(rows)
    ids = [g[0] for g in good]
    want = {i: (0, i) for i, *_ in rows}
    low = {}
    for p, i in enumerate(ids):
        low[top[p]] = min(low.get(top[p], i), i)
    for p, i in enumerate(ids):
        want[i] = (links.get(p, 0), low[top[p]])
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert sum(links.values()) > 100


def test_repeats_and_empty(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (5, [2.0, -1.0], 1), (5, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in spherical.near_vectors(df).collect()), key=str)
    assert got == sorted([(0, 4, None, False), (1, 4, 1, True), (1, 4, 1, True), (2, 4, 1, False), (5, 4, 1, False), (5, 0, 1, False)], key=str)
    assert spherical.near_vectors(df.limit(0)).count() == 0
    assert {r.n_links for r in spherical.near_vectors(df.drop("label"), label_col=None).collect()} == {4, 0}


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.standard_normal((2000, 64)))
    z = rng.standard_normal((2000, 64))
    y = 0.931 * x + math.sqrt(1 - 0.931**2) * unit(z - (z * x).sum(1, keepdims=True) * x)
    caps = spherical.Caps()
    for words in (32, 128):
        hit, rows = np.zeros(2000, bool), 0
        for k in range(caps.rotations):
            code = spherical.ProductCode(64, words, caps, k)
            sets = []
            for v in (x, y):
                row, c = code.decode(v)
                rows += len(row)
                cuts = np.searchsorted(row, np.arange(2001))
                sets.append([set(c[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            hit |= np.array([bool(a & b) for a, b in zip(*sets, strict=True)])
        assert hit.mean() > 0.998
        assert rows / 4000 < 60


def test_op2_brute(spark):
    from siftwell.llm.registry import queries

    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    good, links, top = brute(rows)
    ids = [g[0] for g in good]
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries()["op2_embedding_near_dedup"](spark, d).collect()}
    want = {i: (0, i) for i, *_ in rows}
    low = {}
    for p, i in enumerate(ids):
        low[top[p]] = min(low.get(top[p], i), i)
    for p, i in enumerate(ids):
        want[i] = (links.get(p, 0), low[top[p]])
    assert got == want
