"""Token ids on disk: a static range asymmetric numeral system.

One frequency table, counted over all tokens, is shared by all blocks.  A block holds up to 65,536
ids of a shard, dealt over 128 interleaved coder states, and can be decoded alone; a checkpoint
every 256 steps holds the states and the place in the block's words, so parts of a block can be
decoded side by side too.  Every block and every shard has a CRC32, and a shard names the CRC32 of
the table it was written with.

A shard is one binary value: header, index of documents (id, null flag, length), blocks.  Shards
are the rows of a Parquet table beside a table with the frequencies, so any Hadoop file system can
hold them, half-written files are never seen and a lost task is simply run again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import tidied
from .common import remove, scratch, store, table
from .tokens import word_tokenizer

LANES, BLOCK, MARK = 128, 1 << 16, 256  # states, ids in a block, steps from one checkpoint to the next
MAGIC = b"SWRANS01"
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_HEAD = struct.Struct("<8sIIQIIQ")  # magic, table crc, documents, tokens, blocks, body crc, start
_BLOCK = struct.Struct("<IIII")  # ids, words, checkpoints, crc


class FrequencyTable:
    """Symbol frequencies that add up to a power of two, every symbol that occurs at least 1."""

    def __init__(self, freq: np.ndarray):
        self.freq = np.asarray(freq, np.uint32)
        total = int(self.freq.sum())
        self.bits = total.bit_length() - 1
        if total != 1 << self.bits:
            raise ValueError("frequencies must add up to a power of two")
        self.cum = (np.cumsum(self.freq, dtype=np.uint64) - self.freq).astype(np.uint32)
        self.crc = zlib.crc32(self.freq.astype("<u4").tobytes())
        self._slots: np.ndarray | None = None

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> FrequencyTable:
        """Scale counts; three bits more than the symbols that occur need, 12 at least."""
        counts = np.asarray(counts, np.float64)
        present = counts > 0
        n = int(present.sum())
        if not n:
            counts, present, n = np.ones(1), np.ones(1, bool), 1
        size = 1 << min(24, max(12, n.bit_length() + 3))
        freq = np.zeros(len(counts), np.int64)
        freq[present] = np.maximum(1, np.floor(counts[present] * (size / counts.sum()))).astype(np.int64)
        by_size = np.argsort(-freq, kind="stable")
        over = int(freq.sum()) - size
        if over < 0:
            freq[by_size[0]] -= over
        for i in by_size:
            if over <= 0:
                break
            cut = min(over, int(freq[i]) - 1)
            freq[i] -= cut
            over -= cut
        return cls(freq)

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq)
        return self._slots


_LANE = np.arange(LANES)


def _encode_beside(parts: list[np.ndarray], t: FrequencyTable) -> list[bytes]:
    """A block for each array of ids, coded side by side; the longest come first."""
    n = np.array([len(p) for p in parts])
    steps = -(-n // LANES)
    padded = np.zeros((len(parts), int(steps.max()) * LANES), parts[0].dtype)
    for row, ids in zip(padded, parts, strict=True):
        row[: len(ids)] = ids
    by_step = np.ascontiguousarray(padded.reshape(len(parts), -1, LANES).transpose(1, 0, 2))
    freq, cum = t.freq.astype(np.uint64), t.cum.astype(np.uint64)
    bits, room = np.uint64(t.bits), np.uint64(63 - t.bits)
    states = np.full((len(parts), LANES), _LOW, np.uint64)
    words = np.empty(by_step.shape, np.uint32)
    out = np.zeros(by_step.shape, bool)
    marks = {}
    for s in range(len(by_step) - 1, -1, -1):
        k = int(np.searchsorted(-steps, -s, side="left"))  # blocks with more than s steps
        state, sym = states[:k], by_step[s, :k]
        f, c = freq[sym], cum[sym]
        full = state >= f << room
        ends = n[:k] < (s + 1) * LANES
        idle = (n[:k] - s * LANES)[:, None] <= _LANE if ends.any() else None
        if idle is not None:
            f[idle] = 1
            full &= ~idle
        out[s, :k] = full
        words[s, :k] = state.astype(np.uint32)  # the low half
        x = np.where(full, state >> _32, state)
        q = x // f
        x = (q << bits) + (x - q * f) + c
        states[:k] = x if idle is None else np.where(idle, state, x)
        if s % MARK == 0:
            marks[s] = states[:k].copy()
    at_marks = sorted(marks)
    counts = out.sum(axis=2, dtype=np.int64)  # (steps, blocks)
    before = np.zeros((len(by_step) + 1, len(parts)), np.int64)
    np.cumsum(counts, axis=0, out=before[1:])
    blocks = []
    for b in range(len(parts)):
        stream = words[:, b][out[:, b]].astype("<u4").tobytes()
        own = [s for s in at_marks if s < steps[b]]
        points = b"".join(struct.pack("<I", int(before[s, b])) + marks[s][b].astype("<u8").tobytes() for s in own)
        body = points + stream
        blocks.append(_BLOCK.pack(int(n[b]), len(stream) // 4, len(own), zlib.crc32(body)) + body)
    return blocks


#: Blocks that are coded, and parts of blocks that are decoded, side by side.
BESIDE = 16


def encode_many(arrays: list[np.ndarray], t: FrequencyTable) -> list[list[bytes]]:
    """For each array of ids its blocks in order."""
    cuts = [[a[at : at + BLOCK] for at in range(0, len(a), BLOCK)] for a in arrays]
    places = sorted(((i, k) for i, c in enumerate(cuts) for k in range(len(c))), key=lambda p: -len(cuts[p[0]][p[1]]))
    out = [[b""] * len(c) for c in cuts]
    for at in range(0, len(places), BESIDE):
        some = places[at : at + BESIDE]
        for (i, k), block in zip(some, _encode_beside([cuts[i][k] for i, k in some], t), strict=True):
            out[i][k] = block
    return out


def encode_ids(ids: np.ndarray, t: FrequencyTable) -> list[bytes]:
    """Blocks for ids in order."""
    return encode_many([ids], t)[0]


def _decode_beside(parts: list[tuple[np.ndarray, np.ndarray, int]], t: FrequencyTable) -> list[np.ndarray]:
    """Decode parts (states, words, ids) side by side; the longest come first."""
    n = np.array([p[2] for p in parts])
    steps = -(-n // LANES)
    states = np.stack([p[0] for p in parts])
    stream = np.concatenate([p[1] for p in parts] + [np.zeros(1, np.uint32)]).astype(np.uint64)
    at = np.cumsum([0] + [len(p[1]) for p in parts[:-1]])[:, None]
    freq, cum, slots = t.freq.astype(np.uint64), t.cum.astype(np.uint64), t.slots
    bits, low = np.uint64(t.bits), np.uint64((1 << t.bits) - 1)
    out = np.empty((int(steps.max()), len(parts), LANES), np.uint32)
    for s in range(len(out)):
        k = int(np.searchsorted(-steps, -s, side="left"))
        state = states[:k]
        slot = state & low
        sym = slots[slot]
        out[s, :k] = sym
        x = freq[sym] * (state >> bits) + slot - cum[sym]
        need = x < _LOW
        ends = n[:k] < (s + 1) * LANES
        idle = (n[:k] - s * LANES)[:, None] <= _LANE if ends.any() else None
        if idle is not None:
            need &= ~idle
        place = at[:k] + np.cumsum(need, axis=1)
        x = np.where(need, (x << _32) | stream[np.where(need, place - 1, 0)], x)
        states[:k] = x if idle is None else np.where(idle, state, x)
        at[:k] = place[:, -1:]
    return [out[:, i].reshape(-1)[: n[i]] for i in range(len(parts))]


def _block_parts(data: memoryview, n_blocks: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """What stands between two checkpoints of a run of blocks: states, words and number of ids.
    Raises ValueError where a checksum doesn't hold."""
    parts, place = [], 0
    for b in range(n_blocks):
        n, n_words, n_marks, crc = _BLOCK.unpack_from(data, place)
        place += _BLOCK.size
        size = n_marks * (4 + 8 * LANES) + 4 * n_words
        body = data[place : place + size]
        if len(body) != size or zlib.crc32(body) != crc:
            raise ValueError(f"block {b}: checksum doesn't hold")
        place += size
        words = np.frombuffer(body, "<u4", n_words, n_marks * (4 + 8 * LANES))
        starts = [struct.unpack_from("<I", body, k * (4 + 8 * LANES))[0] for k in range(n_marks)] + [n_words]
        for k in range(n_marks):
            states = np.frombuffer(body, "<u8", LANES, k * (4 + 8 * LANES) + 4).astype(np.uint64)
            parts.append((states, words[starts[k] : starts[k + 1]], min(MARK * LANES, n - k * MARK * LANES)))
    return parts


def decode_many(runs: list[tuple[memoryview, int]], t: FrequencyTable) -> list[np.ndarray]:
    """All ids of each run of blocks."""
    parts = [_block_parts(*r) for r in runs]
    places = sorted(((i, k) for i, c in enumerate(parts) for k in range(len(c))), key=lambda p: -parts[p[0]][p[1]][2])
    found = [[np.empty(0, np.uint32)] * len(c) for c in parts]
    for at in range(0, len(places), 2 * BESIDE):
        some = places[at : at + 2 * BESIDE]
        for (i, k), ids in zip(some, _decode_beside([parts[i][k] for i, k in some], t), strict=True):
            found[i][k] = ids
    return [np.concatenate(f) if f else np.empty(0, np.uint32) for f in found]


def decode_blocks(data: memoryview, n_blocks: int, t: FrequencyTable) -> np.ndarray:
    """All ids of a run of blocks; raises ValueError where a checksum doesn't hold."""
    return decode_many([(data, n_blocks)], t)[0]


def pack_shards(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]], t: FrequencyTable) -> list[bytes]:
    """A binary value for each (doc_ids, null flags, lengths, ids, start)."""
    out = []
    for (doc_ids, nulls, lengths, ids, start), blocks in zip(shards, encode_many([s[3] for s in shards], t), strict=True):
        body = doc_ids.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + lengths.astype("<u4").tobytes() + b"".join(blocks)
        out.append(_HEAD.pack(MAGIC, t.crc, len(doc_ids), len(ids), len(blocks), zlib.crc32(body), start) + body)
    return out


def pack_shard(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray, start: int, t: FrequencyTable) -> bytes:
    return pack_shards([(doc_ids, nulls, lengths, ids, start)], t)[0]


def unpack_shards(data: list, t: FrequencyTable) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """doc_ids, null flags, lengths, ids and start of each shard."""
    heads, bodies = [_HEAD.unpack_from(d) for d in data], [memoryview(d)[_HEAD.size :] for d in data]
    for (magic, crc, _, _, _, body_crc, _), body in zip(heads, bodies, strict=True):
        if magic != MAGIC or crc != t.crc or zlib.crc32(body) != body_crc:
            raise ValueError("not a shard of this table, or damaged")
    out = []
    for (_, _, n_docs, n_ids, _, _, start), body, ids in zip(heads, bodies, decode_many([(b[13 * h[2] :], h[4]) for h, b in zip(heads, bodies, strict=True)], t), strict=True):
        if len(ids) != n_ids:
            raise ValueError("a shard lacks ids")
        out.append((np.frombuffer(body, "<i8", n_docs), np.frombuffer(body, "u1", n_docs, 8 * n_docs), np.frombuffer(body, "<u4", n_docs, 9 * n_docs), ids, start))
    return out


def unpack_shard(data: bytes, t: FrequencyTable) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    return unpack_shards([data], t)[0]


#: Ids in a shard, as long as its documents are shorter.  Small, so that no value is a large object for the JVM.
SHARD_IDS = 1 << 17
#: Bytes of the input in a range of ids that is sorted in one task, and how many ranges there are at most.
RANGE_BYTES, MOST_RANGES = 128 << 20, 20_000
#: Shards that a task codes together.
TOGETHER = 8


def _tokenise(path: str, end_id: int, bounds: list[int]):
    edges = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(path)
        end = np.array([end_id], tok.dtype).tobytes()
        for batch in batches:
            keys = batch.column(0)
            null = keys.is_null().to_numpy(zero_copy_only=False)
            bucket = np.where(null, 0, np.searchsorted(edges, keys.fill_null(0).to_numpy(), side="left")).astype(np.int32)
            held, size, since = [], 0, 0
            for i, raw in enumerate(tok.encode_batch(batch.column(1))):
                held.append(raw + end)
                size += len(raw)
                if size > 4 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[since : i + 1]), keys.slice(since, i + 1 - since), pa.array(held, pa.binary())], ["bucket", "doc_id", "raw"])
                    held, size, since = [], 0, i + 1

    return run


def _shards(dtype: str):
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "before", "n_tokens", "docs", "nulls", "lengths", "raw"]
        bucket, before, docs, raws, size = None, 0, [], [], 0

        def flush():
            nonlocal before, docs, raws, size
            lengths = np.array([len(r) // width for r in raws], "<u4")
            row = [bucket, before, int(lengths.sum()), np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is None for d in docs], "u1").tobytes(), lengths.tobytes(), b"".join(raws)]
            types = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            before += row[2]
            docs, raws, size = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, types, strict=True)], names)

        for batch in batches:
            for b, d, r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if docs and (b != bucket or size + len(r) > SHARD_IDS * width):
                    yield flush()
                if b != bucket:
                    bucket, before = b, 0
                docs.append(d)
                raws.append(r)
                size += len(r)
        if docs:
            yield flush()

    return run


def _count(dtype: str, n_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype), minlength=n_ids)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["id", "n"])

    return run


def _write(freq: np.ndarray, starts: dict[int, int], dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = FrequencyTable(freq)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                bucket, before, _, docs, nulls, lengths, raw = (c.to_pylist() for c in batch.slice(at, TOGETHER).columns)
                first = [starts[b] + k for b, k in zip(bucket, before, strict=True)]
                shards = [(np.frombuffer(d, "<i8"), np.frombuffer(z, "u1"), np.frombuffer(n, "<u4"), np.frombuffer(r, dtype), s) for d, z, n, r, s in zip(docs, nulls, lengths, raw, first, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(pack_shards(shards, t), pa.binary())], ["start", "shard"])

    return run


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, by ascending id, as a directory of shards and a table.

    Null texts are empty; every document ends with ``end_id``.  Documents without an id come first;
    rows with equal ids all stay, in any order among themselves.  An empty table gives a directory
    without shards.  Only the frequency table (one number for each id of the vocabulary) and one
    start for each range of documents go through the driver.
    """
    spark = docs.sparkSession
    tok = word_tokenizer(tokenizer)
    dtype, n_ids = tok.dtype.str, max(tok.n_ids, end_id + 1)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, size // RANGE_BYTES))
    cuts = docs.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 20 * n).alias("q")).first().q if n > 1 else []
    bounds = sorted(set(cuts or []))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    raw = rows.mapInArrow(tidied(_tokenise(tokenizer, end_id, bounds)), "bucket int, doc_id long, raw binary")
    dealt = raw.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "doc_id")
    shards, tmp = store(dealt.mapInArrow(tidied(_shards(dtype)), "bucket int, before long, n_tokens long, docs binary, nulls binary, lengths binary, raw binary"), "ids", "lz4")
    counts = np.zeros(n_ids, np.int64)
    for r in shards.select("raw").mapInArrow(tidied(_count(dtype, n_ids)), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    freq = FrequencyTable.from_counts(counts).freq
    starts, total = {}, 0
    for r in sorted(shards.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r.bucket):
        starts[r.bucket] = total
        total += r.n
    spark.range(1).select(F.lit(bytearray(freq.astype("<u4").tobytes())).alias("freq")).write.parquet(f"{path}/table")
    shards.mapInArrow(tidied(_write(freq, starts, dtype)), "start long, shard binary").write.option("compression", "uncompressed").parquet(f"{path}/shards")
    remove(spark, tmp)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, ids`` (ids as little-endian 32-bit numbers) from a directory of token files."""
    freq = np.frombuffer(spark.read.parquet(f"{path}/table").first().freq, "<u4").copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = FrequencyTable(freq)
        for batch in batches:
            for first in range(0, batch.num_rows, TOGETHER):
                for docs, nulls, lengths, ids, start in unpack_shards([x.as_buffer() for x in batch.column(0)[first : first + TOGETHER]], t):
                    raw = ids.astype("<u4").tobytes()
                    ends = np.cumsum(lengths, dtype=np.int64)
                    begins = ends - lengths
                    for at in range(0, len(docs), 1000):
                        part = slice(at, at + 1000)
                        cuts = 4 * np.r_[begins[part], ends[part][-1]]
                        # views of a buffer in pa.array are never freed, so the array is made from its buffers
                        held = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts - cuts[0]).astype(np.int32).tobytes()), pa.py_buffer(raw[cuts[0] : cuts[-1]])])
                        yield pa.RecordBatch.from_arrays([pa.array(docs[part], mask=nulls[part].astype(bool)), pa.array(begins[part] + start), held], ["doc_id", "start", "ids"])

    return spark.read.schema("start long, shard binary").parquet(f"{path}/shards").select("shard").mapInArrow(tidied(run), "doc_id long, start long, ids binary")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    ids = read_token_files(spark, path)
    return ids.select("doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
