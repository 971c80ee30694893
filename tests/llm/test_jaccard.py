"""The similarity join against all pairs, and connected components."""

import random

import pytest

from siftwell.llm import graph, jaccard


def union_find(nodes, edges):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def shingles(text, n):
    w = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute(rows, j):
    sets = [(d, shingles(x, j.words)) for d, x in rows]
    edges = []
    for a in range(len(sets)):
        for b in range(a):
            (p, x), (q, y) = sets[a], sets[b]
            if x and y and p is not None and q is not None:
                both = len(x & y)
                if j.den * both >= j.num * (len(x) + len(y) - both):
                    edges.append((p, q))
    return union_find([d for d, _ in rows if d is not None], edges), sets


def made_up(seed, n=220):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(vocab, k=60))
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 3, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words)
        else:
            text = " ".join(rng.choices(vocab, k=rng.choice([1, 2, 3, 9, 20, 60, 150])))
            if rng.random() < 0.3:
                text += " " + passage
        rows.append((i * 7 % n, text))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "A b"), (n + 4, "a\x0bB"), (None, rows[0][1]), (3, "other text of row three " * 5), (3, rows[5][1])]


@pytest.mark.parametrize("j", [jaccard.Join(words=3, num=90), jaccard.Join(), jaccard.Join(words=2, num=70, frequent_words=20, block=8, fragments=3, block_grams=400)])
def test_join_brute(spark, j):
    rows = made_up(j.num)
    df = spark.createDataFrame([(d, x, "k") for d, x in rows], "doc_id long, text string, n string").repartition(3)
    got = jaccard.similar_documents(df, j).collect()
    want, sets = brute(rows, j)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id), r.doc_id
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles) for r in got) == sorted((-1 if d is None else d, len(s)) for d, s in sets)


@pytest.mark.parametrize("j", [jaccard.Join(words=3, num=90), jaccard.Join(block=10, block_grams=5000)])
def test_long_texts_brute(spark, j):
    """Sets so long that they are cut into several fragments, near the threshold and near the sizes where the cut changes."""
    rng = random.Random(4)
    rows, vocab = [], [f"w{i}" for i in range(3000)]
    for n in (380, 420, 800, 900, 1700, 2500):
        for _ in range(2):
            base = rng.choices(vocab, k=n)
            for k in range(12):
                words = list(base)
                for _ in range(k * n // (8 * j.words * 10)):
                    words[rng.randrange(len(words))] = rng.choice(vocab)
                rows.append((len(rows), " ".join(words[: n - rng.randrange(1 + n * k // 90)])))
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), j).collect()}
    assert got == brute(rows, j)[0]


def test_large_group(spark):
    """900 texts around one, some of which link with few: no step gives rows by the square."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(900):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2, 2, 3])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    j = jaccard.Join(words=3, num=90, block=300, block_grams=50_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in jaccard.similar_documents(df, j).collect()} == brute(rows, j)[0]
    made = []
    real = jaccard.store

    def counted(d, name, *more):
        out, path = real(d, name, *more)
        made.append((name, out.count()))
        return out, path

    jaccard.store = counted
    try:
        jaccard.similar_documents(df, j).count()
    finally:
        jaccard.store = real
    assert max(n for _, n in made) < 40 * len(rows), made


def test_join_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.similar_documents(df).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.similar_documents(one).collect()] == [(1, 0, 1, 1)]


def test_op7_brute(spark, sf_dir):
    from siftwell.llm.registry import queries

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, sets = brute(rows, jaccard.Join(words=3, num=90))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries()["op7_ngram_jaccard_join"](spark, sf_dir).collect()}
    assert got == {d: (len(s), want[d]) for d, s in sets}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (7, 7)]
    df = spark.createDataFrame(edges + edges[:5], "a long, b long")
    got = {r.node: r.component for r in graph.components(df).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == union_find({x for e in real for x in e}, real)
    assert graph.components(df.limit(0)).count() == 0
