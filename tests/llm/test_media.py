"""Copies of images: crops, edits, halved sizes; and the query's rows."""

import time

import numpy as np
import pytest
import pyarrow as pa

from siftwell.llm import media


def texture(seed, h=150, w=150):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, (h // 3, w // 3)).repeat(3, 0).repeat(3, 1)
    return a.astype(np.uint8)


def test_copies(spark):
    base = [texture(s) for s in range(12)]
    rows = [(i, media.write_pgm(b)) for i, b in enumerate(base)]
    rows.append((100, media.write_pgm(base[0])))  # equal
    rows.append((101, media.write_pgm(base[1][30:, 20:])))  # cropped
    edited = base[2].copy()
    edited[40:70, 40:90] = 9
    rows.append((102, media.write_pgm(edited)))
    rows.append((103, media.write_pgm(base[3][10:120, 6:130])))
    brighter = np.clip(base[4].astype(int) // 2 + 60, 0, 255).astype(np.uint8)
    rows.append((104, media.write_pgm(brighter)))
    half = base[5].reshape(75, 2, 75, 2).mean(axis=(1, 3)).astype(np.uint8)
    rows.append((105, media.write_pgm(half)))
    rows += [(106, media.write_pgm(np.rot90(base[6]))), (200, None), (201, b"no image"), (202, media.write_pgm(np.zeros((3, 3)))), (203, media.write_pgm(np.zeros((3, 3)))), (None, media.write_pgm(base[7]))]
    df = spark.createDataFrame([(i, None if b is None else bytearray(b), "k") for i, b in rows], "image_id long, image binary, kept string").repartition(3)
    got = {r.id: r for r in media.image_copies(df).collect()}
    assert len(got) == len(rows)
    want = {100: 0, 101: 1, 102: 2, 103: 3, 104: 4, 200: 200, 201: 201, 202: 202, 203: 202, None: None}
    for i, c in want.items():
        assert got[i].component_id == c, i
    assert all(got[i].component_id == i and got[i].kept for i in range(12))
    assert got[105].component_id in (5, 105)


def test_large_groups(spark):
    base = texture(50, 90, 120)
    rows = []
    for i in range(150):
        x = base.copy()
        x[(i * 7) % 60 : (i * 7) % 60 + 12, (i * 5) % 90 : (i * 5) % 90 + 12] = i
        rows.append((i, bytearray(media.write_pgm(x))))
    rows += [(1000 + i, bytearray(media.write_pgm(texture(60 + i, 90, 120)))) for i in range(10)]
    got = media.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()
    assert {r.component_id for r in got if r.id < 150} == {0}
    assert {r.component_id for r in got if r.id >= 1000} == {1000 + i for i in range(10)}


def test_whole_lists(spark):
    base = texture(50, 90, 120)
    rows = []
    for i in range(60):
        x = base.copy()
        x[(i * 7) % 60 : (i * 7) % 60 + 12, (i * 5) % 90 : (i * 5) % 90 + 12] = i
        rows.append((i, bytearray(media.write_pgm(x))))
    got = media.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()
    assert {r.n_copies for r in got} == {59}  # each with each other


@pytest.mark.parametrize("unit", [1, 3000, 256 << 10])
def test_units(spark, unit):
    """Two groups and a chain, cut into blocks of any size: the same pairs, an image once for each unit."""
    m = media.Match(unit=unit)
    corners = {}
    for k in range(3):
        base = media._corners(texture(70 + k, 90, 120), m)
        for i in range(14):
            corners[100 * k + i] = base if k < 2 else base[max(0, len(base) * i // 28) : len(base) * (i + 14) // 28]
    met = [(a, b) for a in corners for b in corners if a < b and (a // 100 == b // 100 < 2 or a // 100 == b // 100 and b - a < 4 and a >= 205)]
    want = {(a, b) for a, b in met if media._most(corners[a], corners[b], m) >= max(m.votes, m.share * min(len(corners[a]), len(corners[b])))}
    images = {x for p in met for x in p}
    held = spark.createDataFrame([(i, bytearray(corners[i].tobytes())) for i in images], "image long, corners binary")
    units = media._units(spark.createDataFrame(met, "a long, b long"), held, m)
    assert sorted((r.a, r.b) for r in units.where("b is not null").collect()) == sorted(met)
    shown = [(r.component, r.u, r.v, r.a) for r in units.where("b is null").collect()]
    assert len(shown) == len(set(shown)) <= 2 * len(met)
    if unit > 3000:
        assert len(shown) == len(images)  # not once for each of its pairs
    got = [(r.a, r.b) for r in units.mapInArrow(media._verified(m), "a long, b long").collect()]
    assert len(got) == len(want) and set(got) == want and 180 < len(want)


def test_pairs_with_too_few_matches_are_not_compared(spark):
    m = media.Match()
    full = spark.createDataFrame([(i, bytearray(np.zeros(n, media._CORNER).tobytes())) for i, n in ((1, 100), (2, 100), (3, 10), (4, 41), (4, 41))], "image long, corners binary")
    met = spark.createDataFrame([(1, 2, 19), (1, 3, 6), (2, 3, 5), (1, 4, 8), (2, 4, 9)], "a long, b long, n long")
    assert sorted(map(tuple, media._enough(met, full, m).collect())) == [(1, 3), (2, 4)]  # 20, 6, 6, 8.2 and 8.2 are needed


def test_pairs_are_whole():
    key = np.sort(np.random.default_rng(0).integers(0, 9, 300))
    for most in (1, 1000, 10**6):
        got = [x for i, j in media._pairs(key, most) for x in zip(i.tolist(), j.tolist(), strict=True)]
        assert sorted(got) == [(i, j) for i in range(300) for j in range(i + 1, 300) if key[i] == key[j]]


def test_repeated_descriptors(spark):
    tile = texture(80, 24, 24)
    rows = []
    for i in range(8):
        x = np.concatenate([np.tile(tile, (4, 5)), texture(81, 60, 120)])
        x[100:110, 12 * i : 12 * i + 10] = i
        rows.append((i, bytearray(media.write_pgm(x))))
    got = media.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()
    assert {(r.n_copies, r.component_id) for r in got} == {(7, 0)}


def test_share_of_corners(spark):
    passage = texture(90, 60, 120)
    long = [np.concatenate([texture(91 + i, 150 * (2 + i), 120), passage, texture(95 + i, 300, 120)]) for i in range(2)]
    base = texture(98, 240, 240)
    half = base.reshape(120, 2, 120, 2).mean(axis=(1, 3)).astype(np.uint8)
    images = [*long, base, half, np.rot90(base)]
    m = media.Match()
    c = [media._corners(x, m) for x in images]
    shared = media._most(c[0], c[1], m)
    assert m.votes <= shared < m.share * min(len(c[0]), len(c[1]))  # a shared passage has votes, but too few
    rows = [(i, bytearray(media.write_pgm(x))) for i, x in enumerate(images)]
    got = {r.id: (r.n_copies, r.component_id) for r in media.image_copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    # matches of a turned image agree on no shift
    assert got == {0: (0, 0), 1: (0, 1), 2: (1, 2), 3: (1, 2), 4: (0, 4)}


def test_neighbour_bins():
    m = media.Match()
    p = np.zeros(8, media._CORNER)
    p["bits"] = np.random.default_rng(3).integers(0, 2**63, 8)
    q = p.copy()
    p["x"], p["y"] = 500, 500
    q["x"] = 500 + np.arange(8) % 2 * 12
    q["y"] = 500 + np.arange(8) // 4 * 12
    assert media._most(p, q, m) == 8


def test_tables_meet_all():
    m = media.Match()
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k % 7, replace=False).astype(np.uint64)) if k % 7 else np.uint64(0) for k in range(1200)]
    bits = np.unique(np.r_[bits, np.resize(bits, 1200) ^ np.array(flips, np.uint64)])
    apart = np.bitwise_count(bits[:, None] ^ bits)
    want = [(i, j) for i, j in zip(*np.nonzero(apart <= m.distance), strict=True) if i < j]
    # as they are dealt: each table's lists hold equal bands
    got = [(min(x), max(x)) for t in range(m.distance + 1) for i, j in media._near(bits, t, m) for x in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(want) > 500 and sorted(got) == want  # each once
    image = lambda b, name: (name, np.array([(0, 0, 0, x) for x in b], media._CORNER).tobytes())
    flipped = bits[:40] ^ np.uint64(0x8000_0100_0001_0001)  # two bits in each half
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(image(bits[:40], 1), image(flipped, 2), strict=True)], ["image", "corners"])
    met = [r for b in media._candidates(m)(media._dealt(m)(iter([batch]))) for r in b.to_pylist()]
    want = int((np.bitwise_count(bits[:40, None] ^ flipped) <= m.distance).sum())
    assert want >= 40 and {(r["a"], r["b"]) for r in met} == {(1, 2)} and sum(r["n"] for r in met) == want


def test_crossed():
    start, size = np.array([0, 3, 4]), np.array([3, 1, 2])
    for most in (1, 2, 100):
        got = [x for i, j in media._crossed(start, size, np.array([0, 1]), np.array([2, 2]), most) for x in zip(i.tolist(), j.tolist(), strict=True)]
        assert sorted(got) == [(i, j) for i in range(4) for j in (4, 5)]


def test_pages(spark, sf_dir):
    from siftwell.llm.registry import queries

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    rows = queries()["op4_image_copies"](spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(p.page_id for p in pages)
    assert media.draw_page(None).shape == (3, 128) and media.draw_page("a" * 1000).shape[0] == 48
    p = max(pages, key=lambda p: len(p.html))
    some = spark.createDataFrame([(1, p.html), (2, p.html.replace("</h1>", " extra words</h1>", 1)), (3, p.html[: len(p.html) * 2 // 3]), (4, pages[1].html), (5, None), (6, "")], "page_id long, html string")
    got = {r.id: r.component_id for r in media.image_copies(some, id_col="page_id", image_col="html", load=media.draw_page).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    assert media.image_copies(some.limit(0), id_col="page_id", image_col="html", load=media.draw_page).count() == 0


def test_described_together_as_alone():
    images = [texture(s, 60 + 7 * s, 90 + 30 * (s % 3)) for s in range(9)] + [None, np.zeros((4, 90), np.uint8), np.zeros((0, 0), np.uint8)]
    m = media.Match()
    together = media.describe(images, m)
    assert together[9] is None and not len(together[10]) and not len(together[11])
    for image, got in zip(images[:9], together, strict=False):
        assert len(got) and got.tolist() == media.describe([image], m)[0].tolist()
    crop = media.describe([images[8][20:, 11:]], m)[0]
    whole = {(x, y, b) for x, y, s, b in together[8].tolist() if not s}
    inner = [(x + 11, y + 20, b) for x, y, s, b in crop.tolist() if not s and x > 20 and y > 20 and x < 80 and y < 60]
    assert inner and all(c in whole for c in inner)  # a corner's descriptor doesn't depend on where it stands


def test_copies_as_all_with_all():
    """Equal descriptors, then bands, decide as comparing all corners with all does."""
    m = media.Match()
    rng = np.random.default_rng(6)
    base = texture(110, 300, 300)
    noisy = np.clip(base.astype(int) + rng.integers(-6, 7, base.shape), 0, 255).astype(np.uint8)
    half = base.reshape(150, 2, 150, 2).mean(axis=(1, 3)).astype(np.uint8)
    images = [base, noisy, base[90:, 33:], half, np.tile(texture(111, 24, 24), (9, 9)), np.tile(texture(111, 24, 24), (4, 5)), texture(112, 300, 300), np.concatenate([texture(113, 60, 300), base[:60]]), base[:36, :60]]
    corners = [media._corners(x, m) for x in images] + [np.empty(0, media._CORNER)]
    assert max(len(c) for c in corners) ** 2 > 30_000
    got, want = [], []
    for p in corners:
        for q in corners:
            want.append(media._most(p, q, m) >= max(m.votes, m.share * min(len(p), len(q))))
            got.append(media._copies(media._Sorted(p), media._Sorted(q), m))
    assert got == want and 12 < sum(want) < len(want) - 30
    assert all(media._whole(media._thin(c.tobytes())).tolist() == c.tolist() for c in corners)


def test_counts_of_pairs():
    """Counts that are written by part come back summed."""
    m = media.Match(pairs=50)
    rng = np.random.default_rng(7)
    a, b, n = rng.integers(0, 30, 900), rng.integers(0, 1 << 40, 30)[rng.integers(0, 30, 900)], rng.integers(1, 4, 900)
    want = {}
    for x, y, k in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
        want[x, y] = want.get((x, y), 0) + k
    batches = [pa.RecordBatch.from_arrays([pa.array(c[at : at + 90]) for c in (a, b, n)], ["a", "b", "n"]) for at in range(0, 900, 90)]
    written = list(media._counts(m, 7)(iter(batches)))
    assert len(written) > 1
    got = {(r["a"], r["b"]): r["n"] for t in media._totals(m)(iter(written)) for r in t.to_pylist()}
    assert got == {p: k for p, k in want.items() if k >= m.votes} and got


def test_one_table_at_a_time_on_disk(spark):
    """A table is dealt alone, and the shuffle files of a step go when it ends."""
    m = media.Match()
    corners = media._corners(texture(120, 90, 120), m)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([corners.tobytes()], pa.binary())], ["image", "corners"])
    for t in range(m.distance + 1):
        buckets = [b for r in media._dealt(m, range(t, t + 1))(iter([batch])) for b in r.column(0).to_pylist()]
        assert buckets and {b // media._each(m) for b in buckets} == {t}
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    out, path = media.store(spark.range(1000).repartition(3, "id"), "released", release=True)
    until = time.time() + 20  # they are removed in the background
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and out.count() == 1000
    media.remove(spark, path)
