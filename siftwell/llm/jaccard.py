"""N-gram Jaccard join by vertical partitioning.

All n-grams stand in one global order: first by the leading bits of their hash, which cut the order
into fragments, and within a fragment those with a rare word first, then by hash.  Sets that are equal
are joined through a digest; what follows works on one set of each class.

1. Lists.  If two sets link, there is a fragment in which they differ by no more than their share of
   the whole difference, so there they share one of the first n-grams of each.  The longer a set, the
   more fragments it is cut into, so that each allows a few dozen differences.  Sets that share such an
   n-gram are compared by parity sketches of the fragment, of 256 bits at most: bits that differ are a
   lower bound of the difference, so what they rule out is ruled out for sure.
2. Families are the components of what is left.  Each set belongs to one, and its n-grams go there
   once, a row for each fragment.
3. In a family, partial overlaps are counted fragment by fragment and summed for each pair, up to the
   fragment where the threshold is out of reach.  Only edges of a spanning forest leave the task.

So no step gives all pairs of a group.  A list or family that is larger than a block is dealt to
blocks that overlap in a few members; when their components are known, the members outside the main
one are compared with all blocks, in chunks, so no link between different components is lost.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import tidied
from .common import fresh, remove, store, table
from .graph import components

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Join:
    """Sets of ``words``-grams link when ``den * |intersection| >= num * |union|``.

    ``frequent_words`` is how many of the most frequent words have their counts in the order; it
    bounds what is broadcast (2 MB) and changes the order only, never the result.  ``fragments`` is
    in how many the order is cut for counting; ``block`` is how many members of a list, and
    ``block_grams`` how many n-grams of a family, one task compares with each other at once."""

    words: int = 5
    num: int = 80
    den: int = 100
    frequent_words: int = 150_000
    fragments: int = 8
    block: int = 4096
    block_grams: int = 4_000_000

    def most_apart(self, total: np.ndarray | int) -> np.ndarray | int:
        """The largest symmetric difference of a linked pair whose sizes add up to ``total``."""
        return total * (self.den - self.num) // (self.den + self.num)

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def largest(self, n: int) -> int:
        """The size of the largest set that can link with one of size ``n``."""
        return n * self.den // self.num

    def cut(self, n: int) -> int:
        """Into how many fragments, as a power of two, the larger of two sets of size ``n`` cuts both."""
        apart, k = self.most_apart(n + self.largest(n)), 0
        while apart >> k > SKETCHED[-1][0]:
            k += 1
        return k

    def fits(self, less: np.ndarray, more: np.ndarray) -> np.ndarray:
        return self.den * less >= self.num * more


#: (differences, words): up to so many differences are told from unlike sets by a sketch of so many 64-bit words.
SKETCHED = ((12, 1), (35, 2), (88, 4))
_PART = struct.Struct("<BBxxI")  # power of two of fragments, words of the sketch, n-grams


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words: A-Z lower-cased, cut at ASCII white space."""
    of = xxhash.xxh3_64_intdigest
    return np.array([of(w) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()], np.uint64)


def ngrams(words: np.ndarray, n: int, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Hashes of the distinct n-grams, ascending, and the least of ``kind`` over the words of each."""
    if not len(words):
        return words, kind
    if len(words) < n:
        h = np.array([len(words)], np.uint64)
        for w in words:
            h = _mix(h + w)
        return h, None if kind is None else kind.min(keepdims=True)
    size = len(words) - n + 1
    h = np.full(size, n, np.uint64)
    for k in range(n):
        h = _mix(h + words[k : k + size])
    if kind is None:
        return np.unique(h), None
    least = kind[:size]
    for k in range(1, n):
        least = np.minimum(least, kind[k : k + size])
    h, at = np.unique(h, return_index=True)
    return h, least[at]


def _rows(values: list, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(values, types, strict=True)], names)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush():
        word, n = np.unique(np.concatenate(held), return_counts=True)
        return _rows([word.view(np.int64), n], [pa.int64(), pa.int64()], ["word", "n"])

    for batch in batches:
        for x in batch.column(0):
            held.append(np.unique(word_hashes(x.as_py())))
            size += len(held[-1])
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _edges(k: int) -> np.ndarray:
    """Where hashes are cut into 2**k fragments."""
    return np.arange(1, 1 << k, dtype=np.uint64) << np.uint64(64 - k) if k else np.empty(0, np.uint64)


def _parts(j: Join, h: np.ndarray, least: np.ndarray) -> bytes:
    """For each way to cut the set and each fragment: the sketch and the keys of the lists it is in."""
    n, out = len(h), []
    for k in sorted({j.cut(n), j.cut(j.largest(n))}):
        apart = j.most_apart(n + j.largest(n)) >> k
        words = next((w for most, w in SKETCHED if apart <= most), SKETCHED[-1][1])
        cuts = [0, *np.searchsorted(h, _edges(k)).tolist(), n]
        for f, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            part = h[a:b]
            p = j.prefix(n) if k == 0 else apart + 1
            order = (least[a:b].astype(np.uint64) << np.uint64(56)) | (part >> np.uint64(8))
            keys = (part[np.argpartition(order, p)[:p]] if p < len(part) else part) ^ _mix(np.array([k], np.uint64))
            if k and len(part) <= apart:  # two parts as small as this may be near and share nothing
                keys = np.r_[keys, _mix(np.array([(k << 32) + f], np.uint64))]
            bits = np.bincount((part & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
            out += [_PART.pack(k, words, len(keys)), np.packbits(bits.astype(np.uint8)).tobytes(), keys.tobytes()]
    return b"".join(out)


def _read_parts(data: memoryview) -> Iterator[tuple[int, bytes, np.ndarray]]:
    at = 0
    while at < len(data):
        k, words, n = _PART.unpack_from(data, at)
        at += _PART.size
        yield k, bytes(data[at : at + 8 * words]), np.frombuffer(data, np.int64, n, at + 8 * words)
        at += 8 * (words + n)


def _digest(h: np.ndarray) -> bytes | None:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None


def _sets(j: Join, frequent: np.ndarray, level: np.ndarray):
    """doc -> size, digest, sketches and keys of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, names = [pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["doc_id", "n", "digest", "lists"]
        for batch in batches:
            rows, size = [], 0
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = word_hashes(x.as_py())
                at = np.minimum(np.searchsorted(frequent, w), len(frequent) - 1)
                kind = np.where(frequent[at] == w, level[at], 0).astype(np.uint8) if len(frequent) else np.zeros(len(w), np.uint8)
                h, least = ngrams(w, j.words, kind)
                # sets so small that only equal ones link are in no list
                rows.append((d, len(h), _digest(h), _parts(j, h, least) if len(h) * (j.den - j.num) >= j.num else b""))
                size += len(rows[-1][-1])
                if size > 4 << 20:
                    yield _rows(list(zip(*rows, strict=True)), types, names)
                    rows, size = [], 0
            if rows:
                yield _rows(list(zip(*rows, strict=True)), types, names)

    return run


def _heavy(least: int = 16, flush: int = 1_000_000):
    """Keys found ``least`` times or more in ``flush`` of a task's, and how often; a list that is in no
    such stretch holds at most ``least`` in ``flush`` of all entries, and stays in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return _rows([key[n >= least], n[n >= least]], [pa.int64(), pa.int64()], ["key", "n"])

        for batch in batches:
            for x in batch.column(0):
                for _, _, keys in _read_parts(memoryview(x.as_buffer())):
                    held.append(keys)
                    size += len(keys)
                if size > flush:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    return run


_LIST = "key long, size long, uid long, sketch binary"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each entry of a list; ``size`` is 64 times the size of the set and the power of two of fragments."""

    def flush(held: list) -> pa.RecordBatch:
        keys, sizes, uids, sketches = zip(*held, strict=True)
        each = np.array([len(k) for k in keys])
        ends = np.r_[0, np.cumsum(np.repeat([len(s) for s in sketches], each))].astype(np.int32)
        data = b"".join([s * int(m) for s, m in zip(sketches, each, strict=True)])
        blob = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
        return _rows([np.concatenate(keys), np.repeat(np.array(sizes, np.int64), each), np.repeat(np.array(uids, np.int64), each), blob], [*[pa.int64()] * 3, pa.binary()], ["key", "size", "uid", "sketch"])

    for batch in batches:
        held, n_held = [], 0
        for uid, n, x in zip(batch.column("uid").to_pylist(), batch.column("n").to_pylist(), batch.column("lists"), strict=True):
            for k, sketch, keys in _read_parts(memoryview(x.as_buffer())):
                held.append((keys, 64 * n + k, uid, sketch))
                n_held += len(keys)
            if n_held > 50_000:
                yield flush(held)
                held, n_held = [], 0
        if held:
            yield flush(held)


class _Sketches:
    """Members of lists: sizes and sketches, also folded to shorter ones."""

    def __init__(self, j: Join, t: pa.Table | pa.RecordBatch):
        self.j, self.uid = j, t.column("uid").to_numpy()
        size = t.column("size").to_numpy()
        self.n, self.cut = size >> 6, size & 63
        blob = t.column("sketch")
        blob = blob.combine_chunks() if isinstance(blob, pa.ChunkedArray) else blob
        at = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64)
        data = np.frombuffer(blob.buffers()[2], np.uint8) if len(blob) else np.empty(0, np.uint8)
        self.words = np.diff(at) // 8
        self.bits = {w: np.zeros((len(blob), w), np.uint64) for w in (4, 2, 1)}
        for w in (4, 2, 1):
            i = np.flatnonzero(self.words == w)
            if len(i):
                got = data[at[i][:, None] + np.arange(8 * w)].view(np.uint64)
                self.bits[w][i] = got
                while w > 1:
                    w //= 2
                    got = got[:, :w] ^ got[:, w:]
                    self.bits[w][i] = got

    def near(self, a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
        """Whether members a[i] and b[i], or a and b[i], may link."""
        a = np.broadcast_to(a, b.shape)
        less, more = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
        ok = self.j.fits(less, more) & (self.uid[a] != self.uid[b])
        most = self.j.most_apart(less + more) >> self.cut[a]
        words = np.minimum(self.words[a], self.words[b])
        for w, bits in self.bits.items():
            i = np.flatnonzero(ok & (words == w))
            for at in range(0, len(i), 100_000):
                c = i[at : at + 100_000]
                ok[c] = np.bitwise_count(bits[a[c]] ^ bits[b[c]]).sum(axis=1) <= most[c]
        return ok


def _trees(near: Callable[[int, np.ndarray], np.ndarray], m: int) -> np.ndarray:
    """A label for each of m members, the same for those that ``near`` holds together."""
    label = np.full(m, -1)
    for i in range(m):
        if label[i] < 0:
            label[i] = i
            rest = np.flatnonzero(label < 0)
            label[rest[near(i, rest)]] = i
    names, n = np.unique(label, return_counts=True)
    if len(names) > 1:  # all pairs of different trees: one of each pair isn't in the largest
        for i in np.flatnonzero(label != names[n.argmax()]):
            others = np.flatnonzero(label != label[i])
            for other in np.unique(label[others[near(i, others)]]):
                label[label == other] = label[i]
    return label


def _star(uid: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For labelled members: the least uid of each label with each other uid of it."""
    order = np.lexsort((uid, label))
    uid, label = uid[order], label[order]
    first = np.maximum.accumulate(np.where(np.r_[True, label[1:] != label[:-1]], np.arange(len(uid)), 0))
    other = uid[first] != uid
    return uid[first][other], uid[other]


_PAIR = "a long, b long"


def _pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return _rows([a, b], [pa.int64()] * 2, ["a", "b"])


#: Lists up to this long are done together, the others one by one.
SHORT = 24


def _forest(j: Join):
    """A spanning forest of what may link, over each block of a list.  Rows come by list, block and size."""

    def work(t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        key, block, size = (t.column(c).to_numpy() for c in ("key", "block", "size"))
        n = size >> 6
        # sizes ascend, so where neighbours are too unlike, so are all before and after
        run = (key[1:] == key[:-1]) & (block[1:] == block[:-1]) & j.fits(n[:-1], n[1:])
        some = np.flatnonzero(np.r_[False, run] | np.r_[run, False])
        if not len(some):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        first = ~np.r_[False, run][some]
        group = np.cumsum(first) - 1
        s = _Sketches(j, t.take(pa.array(some)))
        start = np.flatnonzero(first)
        many = np.diff(np.r_[start, len(some)])
        label = np.arange(len(some))
        i, d, pairs = np.flatnonzero(many[group] <= SHORT), 0, []
        while len(i):
            d += 1
            i = i[i + d < len(some)]
            i = i[group[i + d] == group[i]]
            ok = s.near(i, i + d)
            pairs.append((i[ok], i[ok] + d))
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            while True:
                low = np.minimum(label[a], label[b])
                if (label[a] == label[b]).all():
                    break
                np.minimum.at(label, a, low)
                np.minimum.at(label, b, low)
        for g in np.flatnonzero(many > SHORT):
            at = start[g]
            label[at : at + many[g]] = at + _trees(lambda i, others, at=at: s.near(at + i, at + others), int(many[g]))
        return _star(s.uid, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        found, size = [], 0

        def edges(rows: list[pa.RecordBatch]) -> None:
            nonlocal size
            a, b = work(pa.concat_batches(rows))
            if len(a):
                found.append((a, b))
                size += len(a)

        def once() -> pa.RecordBatch:
            pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], axis=1), axis=0)
            return _pair_rows(pairs[:, 0], pairs[:, 1])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, block = batch.column("key").to_numpy(), batch.column("block").to_numpy()
            change = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            if held:
                last = held[-1]
                if (last.column("key")[-1].as_py(), last.column("block")[-1].as_py()) != (key[0], block[0]):
                    edges(held)
                    held = []
            if len(change):
                cut = int(change[-1])
                edges([*held, batch.slice(0, cut)])
                held = [batch.slice(cut)]
            else:
                held.append(batch)
            if size > 500_000:
                yield once()
                found, size = [], 0
        if held:
            edges(held)
        if size:
            yield once()

    return run


def in_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable, schema: str) -> DataFrame:
    """Call ``fn(rows)`` for the rows of each key, a pyarrow table, one group in memory at a time."""
    names = list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(names.index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(c[a] for c in cols)
                if held and here != key:
                    yield from fn(pa.Table.from_batches(held).combine_chunks())
                    held = []
                key = here
                held.append(batch.slice(a, b - a))
        if held:
            yield from fn(pa.Table.from_batches(held).combine_chunks())

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(tidied(run), schema)


def _fragments(j: Join):
    """doc -> digest, size and a row for each fragment of the order that has n-grams of it."""
    k = (j.fragments - 1).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, names = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary()], ["doc_id", "digest", "n", "fragment", "grams"]
        for batch in batches:
            rows, size = [], 0
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h, _ = ngrams(word_hashes(x.as_py()), j.words)
                if not len(h):
                    continue
                digest = _digest(h)
                cuts = [0, *np.searchsorted(h, _edges(k)).tolist(), len(h)]
                rows += [(d, digest, len(h), f, h[a:b].tobytes()) for f, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
                size += h.nbytes
                if size > 4 << 20:
                    yield _rows(list(zip(*rows, strict=True)), types, names)
                    rows, size = [], 0
            if rows:
                yield _rows(list(zip(*rows, strict=True)), types, names)

    return run


class _Overlaps:
    """Members of a family with their n-grams by fragment."""

    def __init__(self, j: Join, t: pa.Table):
        self.j = j
        uid, fragment = t.column("uid").to_numpy(), t.column("fragment").to_numpy()
        self.uid, at, who = np.unique(uid, return_index=True, return_inverse=True)
        self.n = t.column("n").to_numpy()[at]
        grams = t.column("grams")
        self.parts = []
        for f in np.unique(fragment):
            rows = np.flatnonzero(fragment == f)
            _, once = np.unique(who[rows], return_index=True)  # a document that is there twice gives a fragment twice
            rows = rows[once]
            blobs = [np.frombuffer(grams[int(r)].as_buffer(), np.uint64) for r in rows]
            many = np.zeros(len(self.uid), np.int64)
            many[who[rows]] = [len(b) for b in blobs]
            _, code = np.unique(np.concatenate(blobs), return_inverse=True)
            self.parts.append((code.astype(np.int32), np.r_[0, np.cumsum(many)], np.zeros(int(code.max()) + 1, np.int8)))

    def near(self, a: int, others: np.ndarray) -> np.ndarray:
        """Whether member a links with each of the others: partial overlaps by fragment, summed."""
        less, more = np.minimum(self.n[a], self.n[others]), np.maximum(self.n[a], self.n[others])
        left = np.flatnonzero(self.j.fits(less, more))
        # the most n-grams of a that may be missing in the other
        spare = self.n[a] - -(-self.j.num * (less + more)[left] // (self.j.den + self.j.num))
        who = others[left]
        for code, start, mark in self.parts:
            if not len(left):
                break
            mine = code[start[a] : start[a + 1]]
            if len(mine):
                mark[mine] = 1
                if 4 * len(who) > len(start):
                    total = np.r_[0, np.cumsum(mark[code], dtype=np.int64)]
                    both = total[start[who + 1]] - total[start[who]]
                else:
                    each = start[who + 1] - start[who]
                    place = np.repeat(start[who] - np.cumsum(each) + each, each) + np.arange(each.sum())
                    total = np.r_[0, np.cumsum(mark[code[place]], dtype=np.int64)]
                    ends = np.cumsum(each)
                    both = total[ends] - total[ends - each]
                mark[mine] = 0
                spare = spare - (len(mine) - both)
                ok = spare >= 0
                left, who, spare = left[ok], who[ok], spare[ok]
        out = np.zeros(len(others), bool)
        out[left] = True
        return out


def _within(j: Join):
    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        s = _Overlaps(j, t)
        if len(s.uid) > 1:
            yield _pair_rows(*_star(s.uid, _trees(s.near, len(s.uid))))

    return run


def _across(j: Join, of: type):
    """Edges between members (kind 0) and others of the group (kind 1) whose labels differ."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        s = of(j, t)
        who = np.searchsorted(s.uid, t.column("uid").to_numpy()) if of is _Overlaps else np.arange(t.num_rows)
        label, kind = np.empty(len(s.uid), np.int64), t.column("kind").to_numpy()
        label[who] = t.column("label").to_numpy()
        asks, told = np.zeros(len(label), bool), np.zeros(len(label), bool)
        asks[who[kind == 1]], told[who[kind == 0]] = True, True
        a, b = [], []
        for i in np.flatnonzero(asks):
            others = np.flatnonzero(told & (label != label[i]))
            hit = others[s.near(i, others)] if len(others) else others
            if len(hit):
                for other, k in zip(*np.unique(label[hit], return_index=True), strict=True):
                    a.append(s.uid[i])
                    b.append(s.uid[hit[k]])
                    label[label == other] = label[i]
        if a:
            yield _pair_rows(np.array(a), np.array(b))

    return run


def _blocked(blocks: Column, uid: str = "uid") -> Column:
    """The blocks of a member: its own and, for one in 32, the next, so that blocks hang together."""
    own = F.pmod(F.xxhash64(uid), blocks).cast("int")
    twice = (blocks > 1) & (F.pmod(F.xxhash64(uid, F.lit(7)), F.lit(32)) == 0)
    return F.when(twice, F.array(own, F.pmod(own + 1, blocks).cast("int"))).otherwise(F.array(own))


def _between_blocks(rows: DataFrame, edges: DataFrame, j: Join, of: type, weight: str, most: int) -> tuple[DataFrame, str]:
    """Edges between different components of ``edges`` in groups of several blocks.

    ``rows``: group, blocks, uid, what ``of`` reads.  Members outside a group's largest component are
    cut into chunks of ``most`` by ``weight``; each chunk meets each block."""
    comp = components(edges).select(F.col("node").alias("uid"), F.col("component").alias("label"))
    label, path = store(rows.join(comp, "uid", "left").withColumn("label", F.coalesce("label", "uid")), "members", "lz4")
    per = label.groupBy("group", "label").agg(F.sum(weight).alias("w"))
    per = per.groupBy("group").agg(F.max(F.struct("w", "label")).alias("m"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("k")).where("k > 1")
    mixed = per.select("group", F.col("m.label").alias("main"), F.ceil((F.col("w") - F.col("m.w")) / most).cast("int").alias("chunks"))
    both = label.join(mixed, "group")
    own = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    told = both.withColumn("block", own).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("kind", F.lit(0))
    asks = both.where("label <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("chunk", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int")).withColumn("kind", F.lit(1))
    jobs = told.unionByName(asks.select(*told.columns)).drop("main", "chunks", "blocks")
    more, more_path = store(in_groups(jobs, ["group", "block", "chunk"], ["kind", "uid"], _across(j, of), _PAIR), "edges")
    remove(edges.sparkSession, path)
    return more, more_path


#: Up to so many rows (at most 56 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 250_000


def _small(df: DataFrame) -> DataFrame:
    """``df``, a stored table, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _may_link(sets: DataFrame, reps: DataFrame, j: Join) -> tuple[DataFrame, list[str]]:
    """Edges of a forest whose components hold together all that may link."""
    listed = sets.where("length(lists) > 0").select("uid", "n", "lists")
    heavy, heavy_path = store(listed.select("lists").mapInArrow(tidied(_heavy()), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > j.block).select("key", F.ceil(F.col("n") / j.block).cast("int").alias("blocks")), "heavy")
    entries = listed.join(reps.select("uid").hint("merge"), "uid", "left_semi").mapInArrow(tidied(_entries), _LIST)
    long = not heavy.isEmpty()
    if long:
        entries = entries.join(_small(heavy), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = entries.withColumn("block", F.explode(_blocked(F.col("blocks"))))
    else:
        dealt = entries.withColumn("block", F.lit(0))
    dealt = dealt.select("key", "block", "size", "uid", "sketch").repartition("key", "block").sortWithinPartitions("key", "block", "size")
    edges, path = store(dealt.mapInArrow(tidied(_forest(j)), _PAIR).distinct(), "edges")
    paths = [heavy_path, path]
    if long:
        rows = entries.where("blocks > 1").select(F.col("key").alias("group"), "blocks", "uid", "size", "sketch").withColumn("one", F.lit(1))
        more, path = _between_blocks(rows, edges, j, _Sketches, "one", j.block)
        edges = edges.union(more)
        paths.append(path)
    return edges, paths


def _links(docs: DataFrame, reps: DataFrame, edges: DataFrame, j: Join) -> tuple[DataFrame, list[str]]:
    """Edges of a forest whose components hold together all that links, from those that may."""
    spark = docs.sparkSession
    family = components(edges).select(F.col("node").alias("uid"), F.col("component").alias("family"))
    of = reps.join(family, "uid").select("uid", F.col("rep").alias("doc_id"), "digest", "n", "family")
    size = of.groupBy("family").agg(F.ceil(F.sum("n") / j.block_grams).cast("int").alias("blocks"))
    need, need_path = store(of.drop("n").join(size, "family"), "families")
    few = _small(need)
    keys = few.select(F.col("doc_id").alias("_need")).distinct()
    some = docs.join(F.broadcast(keys) if few is not need else keys, F.col("doc_id") == F.col("_need"), "left_semi")
    parts = some.mapInArrow(tidied(_fragments(j)), "doc_id long, digest binary, n long, fragment int, grams binary").join(few, ["doc_id", "digest"]).drop("doc_id", "digest")
    dealt = parts.withColumn("block", F.explode(_blocked(F.col("blocks")))).select("family", "block", "uid", "n", "fragment", "grams")
    links, path = store(in_groups(dealt, ["family", "block"], ["uid", "fragment"], _within(j), _PAIR), "links")
    paths = [need_path, path]
    if not need.where("blocks > 1").isEmpty():
        rows = parts.where("blocks > 1").select(F.col("family").alias("group"), "blocks", "uid", "n", "fragment", "grams").withColumn("weight", F.length("grams") / 8)
        more, path = _between_blocks(rows, links, j, _Overlaps, "weight", j.block_grams)
        links = links.union(more)
        paths.append(path)
    return links, paths


def _frequent(texts: DataFrame, j: Join) -> tuple[np.ndarray, np.ndarray, str]:
    """The most frequent words, ascending, and their levels (eighths of a power of two of documents).
    Whole levels are taken as long as there are no more than ``frequent_words``; only those reach the driver."""
    counts = texts.mapInArrow(tidied(_count_words), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words, path = store(counts.select("word", F.least(F.lit(255), F.floor(8 * F.log2("n"))).cast("int").alias("level")), "words", "lz4")
    least, total = 256, 0
    for r in sorted(words.groupBy("level").count().collect(), key=lambda r: -r.level):
        total += r["count"]
        if total > j.frequent_words:
            break
        least = r.level
    top = words.where(F.col("level") >= least).toPandas()
    top = top.assign(word=top["word"].to_numpy(np.int64).view(np.uint64)).sort_values("word")
    return top["word"].to_numpy(np.uint64), top["level"].to_numpy(np.uint8), path


def similar_documents(docs: DataFrame, j: Join = Join(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """``doc_id, n_shingles, class_id, component_id``, one row for each row of ``docs``.

    ``class_id`` is the smallest id with an equal set, ``component_id`` the smallest id reachable
    by links.  A text with fewer words than an n-gram has is one n-gram.  Texts without words and
    null texts have no n-grams, link with nothing and are their own class and component.  Rows with
    a null id have null classes.  Rows with equal ids are one node.  Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frequent, level, words_path = _frequent(rows.select("text"), j)
    made = rows.mapInArrow(tidied(_sets(j, frequent, level)), "doc_id long, n long, digest binary, lists binary")
    sets, sets_path = store(made.select(F.monotonically_increasing_id().alias("uid"), "*"), "sets", "lz4")
    first = sets.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "uid", "n")).alias("m"))
    reps, reps_path = store(first.select("digest", F.col("m.doc_id").alias("rep"), F.col("m.uid").alias("uid"), F.col("m.n").alias("n")), "classes")
    edges, edges_paths = _may_link(sets, reps, j)
    links, links_paths = _links(rows, reps, edges, j)
    remove(spark, *edges_paths)
    name = reps.select("uid", "rep")
    by_rep = links.join(name.withColumnRenamed("uid", "a").withColumnRenamed("rep", "ra"), "a").join(name.withColumnRenamed("uid", "b").withColumnRenamed("rep", "rb"), "b")
    # rows that share an id are one node: their classes hang together
    held = sets.where("n > 0 and doc_id is not null").select("doc_id", "digest").join(reps.select("digest", "rep"), "digest").select("doc_id", "rep").distinct()
    several = held.groupBy("doc_id").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1")
    same_id = held.join(several, "doc_id").select("a", F.col("rep").alias("b"))
    ids = by_rep.select(F.col("ra").alias("a"), F.col("rb").alias("b")).union(same_id)
    final = components(ids)
    classes, classes_path = store(reps.join(final, F.col("rep") == F.col("node"), "left").select("digest", "rep", F.coalesce("component", "rep").alias("component")), "components")
    remove(spark, *links_paths, reps_path)
    out = sets.select("doc_id", "n", "digest").join(classes, "digest", "left")
    named = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    result, _ = store(out.select("doc_id", F.col("n").alias("n_shingles"), named("rep").alias("class_id"), named("component").alias("component_id")), "similar")
    remove(spark, sets_path, classes_path, words_path)
    return result


def keep_representatives(docs: DataFrame, j: Join = Join(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """``docs`` without the rows whose id isn't the smallest of its component; rows without an id stay."""
    found = similar_documents(docs, j, id_col=id_col, text_col=text_col)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct().toDF(fresh(docs, "gone"))
    few = gone.count() <= 4 * BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, F.col(id_col) == gone[0], "left_anti")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similar_documents(table(spark, sf_dir, "documents"), Join(words=3, num=90, den=100))
    return out.select("doc_id", "n_shingles", "component_id")
