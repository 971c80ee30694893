"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction; a vector belongs to it if its cosine with the direction exceeds a bound.
The directions form a structured random product code: the vectors are rotated at random and cut
into halves, each half has its own random code words, and a direction is one word of each half.  So
``words ** 2`` directions need only ``2 * words`` products, and a list decoder finds all that exceed
the bound: a word of the first half is given up when the best word of the second can't lift it over.
Vectors near no direction take their nearest ones instead, so that each is in some filters.  The
code is drawn anew for each of a few rotations.

Vectors are joined on their filters and verified in double precision.  A pair is counted only in the
first filter that both are in, so each link is counted once.  Equal vectors are one vector with a
weight.  Long lists are cut into blocks, and each pair of blocks is a job; a job gives sums and a
forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import tidied
from .common import remove, store, table
from .graph import components


@dataclass(frozen=True)
class Caps:
    """``expected``: in how many filters of a rotation a random vector is on average, ``least``: in how
    many it is at least.  ``load``: how many vectors a filter has on average, which with the number
    of vectors gives the number of code words.  More words lose more: at cosine 0.932 in 64 dimensions
    the defaults lost 0 of 3,000 pairs at 2**18 vectors of a label, 5 of 6,000 at 2**21 and 18 of 4,000
    at 2**24."""

    threshold: float = 0.93
    rotations: int = 3
    expected: float = 12.0
    least: int = 8
    load: float = 40.0
    block: int = 2048
    seed: int = 7

    def words(self, n: int) -> int:
        """Code words of a half, for n vectors that are compared; a power of two."""
        need = (max(1, n) * self.expected / self.load) ** 0.5
        return int(max(32, 2 ** np.ceil(np.log2(need))))


class ProductCode:
    """The directions of one rotation, and the list decoder."""

    def __init__(self, dim: int, words: int, caps: Caps, rotation: int = 0):
        rng = np.random.default_rng([caps.seed, dim, words, rotation])
        half = max(1, -(-dim // 2))
        q, r = np.linalg.qr(rng.standard_normal((2 * half, 2 * half)))
        self.turn = (q * np.sign(np.diag(r)))[:dim]
        code = rng.standard_normal((2, words, half))
        self.code = code / np.linalg.norm(code, axis=2, keepdims=True) / np.sqrt(2)
        self.words, self.least = words, min(caps.least, words * words)
        # the bound over which random unit vectors have the expected number of directions
        sample = rng.standard_normal((500, 2 * half))
        one, two = self._scores(sample / np.linalg.norm(sample, axis=1, keepdims=True))
        two.sort(axis=1)
        low, high = 0.0, 1.0
        for _ in range(30):
            mid = (low + high) / 2
            over = sum(words * words - np.searchsorted(t, mid - o, side="right").sum() for o, t in zip(one, two, strict=True))
            low, high = (mid, high) if over > caps.expected * len(one) else (low, mid)
        self.bound = high

    def _scores(self, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.code.shape[2]
        return turned[:, :half] @ self.code[0].T, turned[:, half:] @ self.code[1].T

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for every direction over the bound, and the nearest ones of rows that have
        few, by row and filter."""
        one, two = self._scores(unit @ self.turn)
        row, word = np.nonzero(one > (self.bound - two.max(axis=1))[:, None])
        at, other = np.nonzero(one[row, word][:, None] + two[row] > self.bound)
        row, code = row[at], word[at] * self.words + other
        few = np.flatnonzero(np.bincount(row, minlength=len(unit)) < self.least)
        if len(few):
            m = min(self.least, self.words)
            a, b = (np.argpartition(-s[few], m - 1, axis=1)[:, :m] for s in (one, two))
            sums = (np.take_along_axis(one[few], a, 1)[:, :, None] + np.take_along_axis(two[few], b, 1)[:, None, :]).reshape(len(few), -1)
            top = np.argpartition(-sums, m - 1, axis=1)[:, :m]
            near = np.take_along_axis(a, top // m, 1) * self.words + np.take_along_axis(b, top % m, 1)
            gone = np.isin(row, few)
            row, code = np.r_[row[~gone], np.repeat(few, m)], np.r_[code[~gone], near.ravel()]
        order = np.lexsort((code, row))
        return row[order], code[order]


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep vectors of finite components that aren't zero."""
    for batch in batches:
        keep, norm, raw = [], [], []
        for i, v in enumerate(batch.column("vec")):
            if not v.is_valid:
                continue
            values = v.values
            if values.null_count or not len(values):
                continue
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)
            big = np.abs(x).max()
            if not np.isfinite(big) or big == 0:
                continue
            keep.append(i)
            wide = not pa.types.is_float32(values.type)
            raw.append((x + 0.0).astype("<f8" if wide else "<f4").tobytes())
            norm.append(len(x))
        some = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([some.column("id"), some.column("label"), pa.array(norm, pa.int32()), pa.array(raw, pa.binary())], ["id", "label", "dim", "raw"])


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision; the bytes are those of the column's own type."""
    x = np.stack([np.frombuffer(r, "<f8" if len(r) == 8 * dim else "<f4") for r in raw]).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither over- nor underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(caps: Caps):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple, list[ProductCode]] = {}
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for i, (d, n) in enumerate(zip(batch.column("dim").to_pylist(), batch.column("size").to_pylist(), strict=True)):
                groups.setdefault((d, caps.words(1 << n)), []).append(i)
            for (d, w), at in groups.items():
                if (d, w) not in codes:
                    codes[(d, w)] = [ProductCode(d, w, caps, k) for k in range(caps.rotations)]
                for a in range(0, len(at), 512):
                    some = batch.take(pa.array(at[a : a + 512]))
                    x = _unit(some.column("raw").to_pylist(), d)
                    found = [(row, code + k * w * w) for k, (row, code) in enumerate(c.decode(x) for c in codes[(d, w)])]
                    row, code = (np.concatenate(z) for z in zip(*found, strict=True))
                    order = np.lexsort((code, row))
                    row, code = row[order], code[order].astype(np.uint32)
                    cuts = np.searchsorted(row, np.arange(some.num_rows + 1))
                    lists = [code[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                    got = some.take(pa.array(row))
                    cols = [got.column(c) for c in ("uid", "label", "dim", "weight", "raw")]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(code.astype(np.int64)), pa.array([lists[r] for r in row], pa.binary())], ["uid", "label", "dim", "weight", "raw", "filter", "filters"])

    return run


_LINK = "kind int, a long, b long, n long"


def _earlier(flat: np.ndarray, ends: np.ndarray, here: int) -> np.ndarray:
    """For each list of filters, the ones before ``here`` as bits, in a numbering of the group's own."""
    row = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    keep = flat < here
    names, at = np.unique(flat[keep], return_inverse=True)
    bits = np.zeros((len(ends), max(1, len(names))), bool)
    bits[row[keep], at] = True
    return np.packbits(bits, axis=1)


def _links(caps: Caps, t: pa.RecordBatch, s: int, e: int, buffers: tuple) -> tuple | None:
    """Counts and a forest of links of the rows s to e, which are one job."""
    (raw_at, raw), (list_at, lists), block, lo, hi, uid, weight, dim, filters = buffers
    if e - s < 2:
        return None
    rows, others = (np.flatnonzero(block[s:e] == x) for x in (lo[s], hi[s]))
    if not len(rows) or not len(others):
        return None
    size = int(raw_at[s + 1] - raw_at[s])
    x = raw[raw_at[s] : raw_at[e]].view("<f8" if size == 8 * dim[s] else "<f4").reshape(e - s, -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # neither over- nor underflow
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    earlier = None
    n, tree, edges = np.zeros(e - s, np.int64), list(range(e - s)), []
    w = weight[s:e]

    def find(i: int) -> int:
        while tree[i] != i:
            tree[i] = tree[tree[i]]
            i = tree[i]
        return i

    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        ok = x[part] @ x[others].T >= caps.threshold
        if lo[s] == hi[s]:
            ok &= part[:, None] < others[None, :]
        p, q = np.nonzero(ok)
        if not len(p):
            continue
        p, q = part[p], others[q]
        if earlier is None:
            earlier = _earlier(lists[list_at[s] : list_at[e]].view("<u4"), (list_at[s + 1 : e + 1] - list_at[s]) // 4, int(filters[s]))
        first = np.concatenate([~(earlier[p[c : c + 50_000]] & earlier[q[c : c + 50_000]]).any(axis=1) for c in range(0, len(p), 50_000)])
        p, q = p[first], q[first]
        np.add.at(n, p, w[q])
        np.add.at(n, q, w[p])
        for i, k in zip(p.tolist(), q.tolist(), strict=True):
            a, b = find(i), find(k)
            if a != b:
                tree[max(a, b)] = min(a, b)
                edges.append((i, k))
    who = np.flatnonzero(n)
    if not len(who):
        return None
    f = np.array(edges, np.int64).reshape(-1, 2) + s
    return who + s, n[who], f[:, 0], f[:, 1]


def _jobs(caps: Caps):
    """Counts of links (kind 0: a has n) and forests of links (kind 1: a, b), job by job."""

    def work(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        num = {c: t.column(c).to_numpy() for c in ("group", "filter", "lo", "hi", "block", "uid", "weight", "dim")}

        def blob(c: str) -> tuple[np.ndarray, np.ndarray]:
            x = t.column(c)
            return np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64), np.frombuffer(x.buffers()[2], np.uint8)

        buffers = (blob("raw"), blob("filters"), num["block"], num["lo"], num["hi"], num["uid"], num["weight"], num["dim"], num["filter"])
        cuts = [*_starts(num), t.num_rows]
        found = [r for s, e in zip(cuts[:-1], cuts[1:], strict=True) if (r := _links(caps, t, s, e, buffers)) is not None]
        if found:
            who, n, a, b = (np.concatenate(z) for z in zip(*found, strict=True))
            uid, zeros = num["uid"], np.zeros(len(who), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[zeros, np.ones(len(a), np.int64)].astype(np.int32)), pa.array(np.r_[uid[who], uid[a]]), pa.array(np.r_[zeros, uid[b]]), pa.array(np.r_[n, np.zeros(len(a), np.int64)])], ["kind", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = {c: batch.column(c).to_numpy() for c in ("group", "filter", "lo", "hi")}
            if held and any(held[-1].column(c)[-1].as_py() != k[0] for c, k in keys.items()):
                yield from work(pa.concat_batches(held))
                held = []
            cut = int(_starts(keys)[-1])
            if cut:
                yield from work(pa.concat_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from work(pa.concat_batches(held))

    return run


def _starts(keys: dict[str, np.ndarray]) -> np.ndarray:
    """Where a new job begins."""
    change = np.zeros(len(keys["group"]), bool)
    change[0] = True
    for c in ("group", "filter", "lo", "hi"):
        change[1:] |= keys[c][1:] != keys[c][:-1]
    return np.flatnonzero(change)


def near_vectors(vectors: DataFrame, caps: Caps = Caps(), *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label") -> DataFrame:  # noqa: B008
    """``vec_id, n_links, component_id, kept``, one row for each row of ``vectors``.

    Vectors are compared when their labels (all, if ``label_col`` is None) are equal and not null and
    their lengths are equal.  Vectors that are null, empty, zero, or hold null or non-finite
    components have no links.  Repeated rows are vectors of their own and link with each other;
    rows with a null id count for others and have a null component.  A list of two or more vectors
    in a filter is verified whole, so what may be lost are only pairs without a common filter.
    """
    spark = vectors.sparkSession
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).alias("vec")).where("label is not null")
    good = rows.mapInArrow(tidied(_clean), "id long, label string, dim int, raw binary")
    one = good.groupBy("label", "dim", "raw").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("first"))
    reps, reps_path = store(one.select(F.monotonically_increasing_id().alias("uid"), "*"), "vectors")
    # how many vectors each label has, in powers of two, so equal labels get equal codes
    size = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label", "dim", F.ceil(F.log2("n")).cast("int").alias("size"))
    listed = reps.join(size, ["label", "dim"]).mapInArrow(tidied(_filters(caps)), "uid long, label string, dim int, weight long, raw binary, filter long, filters binary")
    listed, listed_path = store(listed.select("*", F.expr(f"int(pmod(xxhash64(uid), {1 << 30}))").alias("deal")), "filters", "lz4")
    keys = ["label", "dim", "filter"]
    long = listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > caps.block).select(*keys, F.ceil(F.col("m") / caps.block).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    at = listed.join(long, keys, "left").withColumn("block", F.col("deal") % blocks).withColumn("to", F.explode(F.sequence(F.lit(0), blocks - 1)))
    jobs = at.select(F.xxhash64("label", "dim").alias("group"), "dim", "filter", F.least("block", "to").alias("lo"), F.greatest("block", "to").alias("hi"), "block", "uid", "weight", "raw", "filters")
    order = ["group", "filter", "lo", "hi"]
    found, found_path = store(jobs.repartition(*order).sortWithinPartitions(*order).mapInArrow(tidied(_jobs(caps)), _LINK), "links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("n"))
    name = reps.select("uid", "first")
    edges = found.where("kind = 1").join(name.select(F.col("uid").alias("a"), F.col("first").alias("ra")), "a").join(name.select(F.col("uid").alias("b"), F.col("first").alias("rb")), "b")
    # an id in two classes of vectors ties them together
    held = good.where("id is not null").select("id", "label", "dim", "raw").join(reps.select("label", "dim", "raw", "first"), ["label", "dim", "raw"]).select("id", "first").distinct()
    several = held.groupBy("id").agg(F.min("first").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1")
    ties = held.join(several, "id").select("a", F.col("first").alias("b"))
    comp = components(edges.select(F.col("ra").alias("a"), F.col("rb").alias("b")).union(ties))
    known = reps.join(links, "uid", "left").join(comp, F.col("first") == F.col("node"), "left")
    known = known.select("label", "dim", "raw", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    known, _ = store(known, "vector-classes")
    remove(spark, listed_path, found_path, reps_path)
    every = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).alias("vec"))
    tagged = every.mapInArrow(tidied(_tag), "id long, label string, dim int, raw binary")
    out = tagged.join(known, ["label", "dim", "raw"], "left")
    comp_id = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(False)).alias("kept"))


def _tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows, with the bytes that ``_clean`` gives, or null."""
    for batch in batches:
        got = next(_clean(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("label"), batch.column("vec")], ["id", "label", "vec"])])))
        raw, dim = [None] * batch.num_rows, [None] * batch.num_rows
        for i, d, r in zip(*(got.column(c).to_pylist() for c in ("id", "dim", "raw")), strict=True):
            raw[i], dim[i] = r, d
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(dim, pa.int32()), pa.array(raw, pa.binary())], ["id", "label", "dim", "raw"])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
