"""Best-fit packing of token sequences.

Only lengths decide where a piece goes, and there are at most ``capacity`` of them.  So pieces are
ranked within their length in parallel, the histogram of lengths (at most ``capacity`` rows, however
large the corpus) is packed on the driver into bin patterns with multiplicities, and every piece
looks its place up by length and rank.

Packing: pieces above a third of the capacity go at most two to a bin, matched greedily from the
largest with the largest that fits beside it; smaller pieces, by falling length, go into the bin
with the smallest gap that holds them, or else into new bins.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import tidied
from .common import store, table
from .tokens import word_tokenizer


@dataclass
class Pattern:
    """``times`` bins that hold the same lengths: ``items`` is [(length, how often)]."""

    times: int
    gap: int
    items: list[tuple[int, int]]


def pack_lengths(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns for a histogram of lengths from 1 to ``capacity``."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 1 <= n <= capacity for n in left):
        raise ValueError("lengths must lie between 1 and the capacity")
    large = sorted(n for n in left if 3 * n > capacity)
    small = sorted((n for n in left if 3 * n <= capacity), reverse=True)
    open_bins: dict[int, list[Pattern]] = {}
    gaps: list[int] = []  # sorted keys of open_bins
    done: list[Pattern] = []

    def put(p: Pattern) -> None:
        if not p.gap:
            done.append(p)
            return
        if p.gap not in open_bins:
            open_bins[p.gap] = []
            insort(gaps, p.gap)
        open_bins[p.gap].append(p)

    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1  # the largest that fits beside a
        if at < 0:
            put(Pattern(left.pop(a), capacity - a, [(a, 1)]))
            large.pop()
            continue
        b = large[at]
        if a == b:
            if left[a] > 1:
                put(Pattern(left[a] // 2, capacity - 2 * a, [(a, 2)]))
            left[a] %= 2
            if left[a]:  # the odd one may still go beside a shorter one
                lower = large[at - 1] if at else None
                if lower is None:
                    put(Pattern(1, capacity - a, [(a, 1)]))
                else:
                    put(Pattern(1, capacity - a - lower, [(a, 1), (lower, 1)]))
                    left[lower] -= 1
                    if not left[lower]:
                        large.remove(lower)
            large.remove(a)
            continue
        times = min(left[a], left[b])
        put(Pattern(times, capacity - a - b, [(a, 1), (b, 1)]))
        for n in (a, b):
            left[n] -= times
            if not left[n]:
                large.remove(n)
    for n in small:
        count = left[n]
        while count:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                per = capacity // n
                if count >= per:
                    put(Pattern(count // per, capacity - per * n, [(n, per)]))
                if count % per:
                    put(Pattern(1, capacity - count % per * n, [(n, count % per)]))
                break
            gap = gaps[at]
            per = gap // n
            p = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
                gaps.pop(at)
            whole = min(p.times, count // per)
            if whole:
                put(Pattern(whole, gap - per * n, [*p.items, (n, per)]))
                count -= whole * per
            rest = p.times - whole
            if rest and count and count < per:
                put(Pattern(1, gap - count * n, [*p.items, (n, count)]))
                count, rest = 0, rest - 1
            if rest:
                put(Pattern(rest, gap, p.items))
    return done + [p for g in gaps for p in open_bins[g]]


def layout(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length its runs, by rank: first rank, pieces in each bin, first bin, first offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    base = 0
    for p in patterns:
        offset = 0
        for n, k in p.items:
            runs.setdefault(n, []).append((ranks.get(n, 0), k, base, offset))
            ranks[n] = ranks.get(n, 0) + p.times * k
            offset += n * k
        base += p.times
    return {n: np.array(r, np.int64) for n, r in runs.items()}


def _pieces(path: str, end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], tok.dtype)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * keep_ids
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * keep_ids
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for d, raw in zip(batch.column(0).to_pylist(), tok.encode_batch(batch.column(1)), strict=True):
                ids = np.concatenate([np.frombuffer(raw, tok.dtype), end]).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    one = ids[at : at + capacity]
                    rows.append((d, k, at, len(one), zlib.crc32(one), part, int(seen[len(one)])) + ((one.tobytes(),) if keep_ids else ()))
                    seen[len(one)] += 1
                    size += 4 * len(one) * keep_ids
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _place(runs: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            seq, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                n, r = int(length[some[0]]), rank[some]
                first, per, base, off = runs[n][np.searchsorted(runs[n][:, 0], r, side="right") - 1].T
                q, j = np.divmod(r - first, per)
                seq[some], offset[some] = base + q, off + j * n
            cols = [batch.column(c) for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(offset)], [c for c in batch.schema.names if c != "_rank"] + ["sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, *, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row for each piece: ``doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset``.

    A document is its ids and ``end_id``; only longer ones are cut, into pieces of ``capacity``.
    Null and empty texts are a piece with the end id alone.  Repeated rows and null ids are packed
    like others.  An empty table gives no rows.  ``assemble`` makes the sequences from the result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * keep_ids
    # written, so that a piece's place among those of its length stays what it is
    pieces, _ = store(rows.mapInArrow(tidied(_pieces(tokenizer, end_id, capacity, keep_ids)), schema), "pieces")
    here = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    hist = {r.length: r.n for r in here.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = layout(pack_lengths(hist, capacity))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    ranked = pieces.join(here.select("length", "part", before.alias("_before")), ["length", "part"]).withColumn("_rank", F.col("_before") + F.col("nth"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return ranked.select(*cols, "_rank").mapInArrow(tidied(_place(runs)), out)


def assemble(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, offsets``: each sequence's ids (little-endian 32-bit) and its pieces.

    A group is one sequence, so at most the capacity in ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    one = packed.groupBy("sequence_id").agg(parts.alias("_p"))
    join = F.aggregate("_p", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return one.select("sequence_id", join.alias("ids"), F.col("_p.doc_id").alias("doc_ids"), F.col("_p.offset").alias("offsets"))


def packed_digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"))
