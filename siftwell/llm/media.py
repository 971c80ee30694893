"""Copies of images by local descriptors.

Corners are found at several scales (a structure-tensor measure, maxima of their neighbourhood), each
gets the direction of its patch's brightness centroid, and 64 brightness comparisons turned by that
direction make a descriptor.  Descriptors are joined through Hamming tables, one for each of
distance + 1 bands of the bits: two descriptors within the distance have a band in common.  In a
table's list, the other bits are cut into distance + 1 parts of which they have one in common too,
so lists are compared part by part; then the whole distance is checked.  Each pair counts once, in
its first common band and part.  That counts the matches of two images, and where there are enough, all descriptors
of the two are compared, block by block of images that hang together.  Matches vote for a shift and a scale, and images with enough votes
in one bin are copies, be they cropped or edited.

Equal images count once.  In a list of one table entry an image with a repeated descriptor is there
once, with its number.  A list gives all its pairs of images, however long it is, so a group of m
copies costs m²/2 pairs for each corner they share.

Images are grey: binary PGM (``P5``).  There is no table of images among the test tables, so the
query draws each web page's whole text as a picture, a cell of 2 x 3 grey values for a character.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import tidied
from .common import remove, store, table
from .graph import components

RADIUS = 7  # of a patch
_CORNER = np.dtype([("x", "<i4"), ("y", "<i4"), ("scale", "u1"), ("bits", "<u8")])


@dataclass(frozen=True)
class Match:
    """``spacing``: a corner is the strongest within this radius.  ``distance``: the most bits that
    matching descriptors differ in.  ``votes``: matches in one bin of ``bin`` pixels and its right and
    lower neighbours that make two images copies, ``share`` how many of the corners of the image with fewer they must be.
    ``pairs``: so many pairs are held before they are counted, which bounds memory only.
    ``unit``: bytes of corners in a block of images that are compared in one place."""

    scales: int = 2
    spacing: int = 6
    distance: int = 4
    votes: int = 6
    share: float = 0.2
    bin: int = 12
    pairs: int = 1_000_000
    buckets: int = 256
    unit: int = 256 << 10


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """A grey image, or None for what isn't a whole 8-bit binary PGM."""
    m = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not m or int(m[3]) > 255:
        return None
    w, h = int(m[1]), int(m[2])
    body = data[m.end() :]
    if not w or not h or len(body) < w * h:
        return None
    return np.frombuffer(body, np.uint8, w * h).reshape(h, w)


def write_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


_rng = np.random.default_rng(11)
_GLYPHS = _rng.integers(0, 200, (256, 3, 2)).astype(np.uint8)
_GLYPHS[32] = 255
_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def draw_page(source: str | None, columns: int = 64) -> np.ndarray:
    """The visible text of a page, all of it, wrapped at ``columns``; an empty page is one blank line."""
    text = " ".join(html.unescape(_HIDDEN.sub(" ", source or "")).split())
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    codes = np.where(codes < 256, codes, codes * 31 % 223 + 33).astype(np.uint8)
    lines = max(1, -(-len(codes) // columns))
    grid = np.full(lines * columns, 32, np.uint8)
    grid[: len(codes)] = codes
    return _GLYPHS[grid].reshape(lines, columns, 3, 2).transpose(0, 2, 1, 3).reshape(3 * lines, 2 * columns)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2r+1, exact, by windows that double; where a square leaves the array it counts what is inside."""
    for axis in (0, 1):
        shape = list(a.shape)
        shape[axis] += 2 * r
        p = np.zeros(shape, a.dtype)
        part = lambda x, at, k, axis=axis: x[at : at + k] if axis == 0 else x[:, at : at + k]
        n = a.shape[axis]
        part(p, r, n)[...] = a
        out, done, size = None, 0, 1
        while True:  # windows of 1, 2, 4 ... that make up 2r + 1
            if (2 * r + 1) & size:
                out = part(p, done, n).copy() if out is None else np.add(out, part(p, done, n), out)
                done += size
            if done == 2 * r + 1:
                break
            k = p.shape[axis] - size
            p, size = part(p, 0, k) + part(p, size, k), 2 * size
        a = out
    return a


def _highest(a: np.ndarray, r: int) -> np.ndarray:
    """Maxima over squares of side 2r+1, by windows that double."""
    for axis in (0, 1):
        n = a.shape[axis]
        edge = [(r, r) if k == axis else (0, 0) for k in (0, 1)]
        p, size = np.pad(a, edge, constant_values=-np.inf), 1
        part = lambda x, at, k, axis=axis: x[at : at + k] if axis == 0 else x[:, at : at + k]
        while 2 * size <= 2 * r + 1:
            k = p.shape[axis] - size
            p, size = np.maximum(part(p, 0, k), part(p, size, k)), 2 * size
        a = np.maximum(part(p, 0, n), part(p, 2 * r + 1 - size, n))
    return a


def _pattern(turns: int = 32) -> np.ndarray:
    """(turns, 64, 2 points, 2): offsets of the compared pixels for each direction."""
    points = np.clip(np.random.default_rng(5).normal(0, RADIUS / 2, (64, 2, 2)), -RADIUS + 2, RADIUS - 2)
    out = []
    for k in range(turns):
        c, s = np.cos(2 * np.pi * k / turns), np.sin(2 * np.pi * k / turns)
        out.append(points @ np.array([[c, s], [-s, c]]))
    return np.rint(np.clip(out, -RADIUS, RADIUS)).astype(np.int64)


_TURNED = _pattern()
_DISC = np.argwhere(np.hypot(*np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]) <= RADIUS) - RADIUS  # (dy, dx)
_GAP = RADIUS + 1  # rows between images that are described together, and columns at their edges that hold no corner


def _described_beside(levels: list[np.ndarray], scale: int, m: Match) -> list[np.ndarray]:
    """Corners of images of one width, set under each other.  All sums are of whole numbers, so a
    corner's descriptor doesn't depend on where the image stands."""
    heights = np.array([len(v) for v in levels])
    starts = _GAP + np.r_[0, np.cumsum(heights + _GAP)]
    wide = levels[0].shape[1]
    a = np.zeros((int(starts[-1]), wide), np.int32)
    inside = np.zeros(len(a), bool)
    for at, v in zip(starts, levels, strict=False):
        a[at : at + len(v)] = v
        a[at - 1], a[at + len(v)] = v[0], v[-1]
        inside[at : at + len(v)] = True
    gx, gy = np.zeros_like(a), np.zeros_like(a)
    gx[:, 1:-1] = a[:, 2:] - a[:, :-2]
    gy[1:-1] = a[2:] - a[:-2]
    gx[~inside], gy[~inside] = 0, 0
    xx, yy, xy = (_box(g, 2).astype(np.float64) for g in (gx * gx, gy * gy, gx * gy))
    both = xx + yy
    both *= both
    both *= 0.05
    xx *= yy
    xy *= xy
    xx -= xy
    xx -= both
    xx /= 1.6e6 * 4.0 ** (4 * scale)
    strength = np.rint(xx, xx).astype(np.float32)  # whole numbers below 2^24
    strength[~inside] = -np.inf
    peak = (strength == _highest(strength, m.spacing)) & (strength > 1)
    peak[:, :_GAP], peak[:, -_GAP:] = False, False
    y, x = np.divmod(np.flatnonzero(peak), wide)
    who = np.searchsorted(starts, y, side="right") - 1
    top = y - starts[who]
    ok = (top >= _GAP) & (top < heights[who] - _GAP)
    y, x, who, top = y[ok], x[ok], who[ok], top[ok]
    smooth = _box(a, 1).ravel()
    base = y * wide + x
    disc = smooth[base[:, None] + (_DISC[:, 0] * wide + _DISC[:, 1])].astype(np.float64)
    angle = np.arctan2(disc @ _DISC[:, 0], disc @ _DISC[:, 1])
    turn = np.rint(angle / (2 * np.pi) * len(_TURNED)).astype(np.int64) % len(_TURNED)
    v = smooth[base[:, None, None] + (_TURNED[..., 1] * wide + _TURNED[..., 0])[turn]]
    r = np.empty(len(y), _CORNER)
    r["x"], r["y"], r["scale"] = x << scale, top << scale, scale
    r["bits"] = np.packbits(v[:, :, 0] < v[:, :, 1], axis=1).view(np.uint64)[:, 0] if len(y) else 0
    return np.split(r, np.searchsorted(who, np.arange(1, len(levels))))


def _halved(v: np.ndarray) -> np.ndarray:
    """Sums of squares of 2 x 2."""
    rows = v[::2] + v[1::2]
    return rows[:, ::2] + rows[:, 1::2]


#: Pixels that are described together, unless a single image has more; so few that they stay in the cache of a core.
PIXELS = 1 << 16


def describe(images: list[np.ndarray | None], m: Match) -> list[np.ndarray | None]:
    """The corners of each image, scale by scale, in its own pixels, with their descriptors; None for
    None.  Images of one width are described together."""
    out = [None if x is None else [np.empty(0, _CORNER)] for x in images]
    levels = [(i, x.astype(np.int32)) for i, x in enumerate(images) if x is not None]
    for scale in range(m.scales):
        if scale:
            halves = [(i, v.shape[0] // 2, v.shape[1] // 2, v) for i, v in levels]
            levels = [(i, _halved(v[: 2 * h, : 2 * w])) for i, h, w, v in halves if h and w]
        levels = [(i, v) for i, v in levels if min(v.shape) >= 2 * RADIUS + 3]
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, v in sorted(levels, key=lambda p: p[1].shape[1]):
            if held and (held[0][1].shape[1] != v.shape[1] or size + v.size > PIXELS):
                for (at, _), r in zip(held, _described_beside([x for _, x in held], scale, m), strict=True):
                    out[at].append(r)
                held, size = [], 0
            held.append((i, v))
            size += v.size
        if held:
            for (at, _), r in zip(held, _described_beside([x for _, x in held], scale, m), strict=True):
                out[at].append(r)
    return [None if parts is None else np.concatenate(parts) for parts in out]


def _corners(image: np.ndarray, m: Match) -> np.ndarray:
    return describe([image], m)[0]


def _name(image: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(np.ascontiguousarray(image).tobytes(), seed=image.shape[1]) >> 1


def _described(load, m: Match):
    """id, name of the pixels and corners of each image, how many corners there are, and the row's place in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                images = [load(v.as_py()) for v in part.column(1)]
                names = pa.array([None if x is None else _name(x) for x in images], pa.int64())
                corners = describe(images, m)
                blobs = pa.array([None if r is None else r.tobytes() for r in corners], pa.binary())
                sizes = pa.array([0 if r is None else len(r) for r in corners], pa.int32())
                tasks, places = pa.array([task] * len(names), pa.int32()), pa.array(range(place, place + len(names)), pa.int64())
                place += len(names)
                yield pa.RecordBatch.from_arrays([part.column(0), names, blobs, sizes, tasks, places], ["id", "image", "corners", "size", "task", "place"])

    return run


def _cut(n: int, parts: int) -> list[tuple[int, int]]:
    """(first, number) of each of ``parts`` runs of n bits."""
    ends = [n * k // parts for k in range(parts + 1)]
    return [(x, y - x) for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _field(bits: np.ndarray, at: tuple[int, int]) -> np.ndarray:
    return bits >> np.uint64(at[0]) & np.uint64((1 << at[1]) - 1)


def _each(m: Match, descriptors: int = 0) -> int:
    """The buckets of a table: more where there are many descriptors, as one place holds a bucket whole."""
    return max(1, m.buckets // (m.distance + 1), min(1 << 64 // (m.distance + 1), descriptors // 250_000))


def _dealt(m: Match, tables: range | None = None, each: int = 0):
    """(image, descriptor, how often) dealt to buckets by the key of each of ``tables``, many in one value."""
    each = each or _each(m)

    def pack(held: list[np.ndarray], names: list[int]) -> Iterator[pa.RecordBatch]:
        bits = np.concatenate(held)
        image = np.repeat(np.array(names, np.uint64), [len(h) for h in held])
        order = np.lexsort((bits, image))
        bits, image = bits[order], image[order]
        first = np.flatnonzero(np.r_[True, (bits[1:] != bits[:-1]) | (image[1:] != image[:-1])])
        n = np.diff(np.r_[first, len(bits)]).astype(np.uint32)
        bits, image = bits[first], image[first]
        for t in range(m.distance + 1) if tables is None else tables:
            at = _cut(64, m.distance + 1)[t]
            bucket = (_field(bits, at) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(each)
            order = np.argsort(bucket, kind="stable")
            there, cut = np.unique(bucket[order], return_index=True)
            parts = [order[a:b] for a, b in zip(cut, [*cut[1:], len(order)], strict=True)]
            blobs = [pa.compress(b"".join(c[i].tobytes() for c in (image, bits, n)), "zstd", asbytes=True) for i in parts]
            yield pa.RecordBatch.from_arrays([pa.array((t * each + there).astype(np.int32)), pa.array([len(i) for i in parts], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "n", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, size = [], [], 0
        for batch in batches:
            for name, blob in zip(batch.column(0), batch.column(1), strict=True):
                held.append(np.frombuffer(blob.as_py(), _CORNER)["bits"])
                names.append(name.as_py())
                size += len(held[-1])
                if size > 400_000:
                    yield from pack(held, names)
                    held, names, size = [], [], 0
        if size:
            yield from pack(held, names)

    return run


def _pairs(key: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places of sorted ``key`` whose keys are equal, about ``most`` at a time."""
    i, d, held, n = np.arange(len(key)), 0, [], 0
    while len(i):
        d += 1
        i = i[: np.searchsorted(i, len(key) - d)]
        i = i[key[i + d] == key[i]]  # sorted: what isn't equal d further isn't equal later
        held.append((i, i + d))
        n += len(i)
        if n > most or not len(i):
            yield tuple(np.concatenate(z) for z in zip(*held, strict=True))
            held, n = [], 0


def _near(bits: np.ndarray, t: int, m: Match) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different ``bits`` within the distance that meet in table t and in none before."""
    bands = _cut(64, m.distance + 1)
    low, wide = bands[t]
    band = _field(bits, bands[t])
    rest = bits & np.uint64((1 << low) - 1) | (bits >> np.uint64(low) >> np.uint64(wide) << np.uint64(low) if low + wide < 64 else np.uint64(0))
    parts = _cut(64 - wide, m.distance + 1)
    for k, part in enumerate(parts):
        key = band << np.uint64(part[1]) | _field(rest, part)
        order = np.argsort(key, kind="stable")
        sorted_bits = bits[order]
        for i, j in _pairs(key[order], m.pairs):
            off = sorted_bits[i] ^ sorted_bits[j]
            ok = np.flatnonzero(np.bitwise_count(off) <= m.distance)
            i, j, off = order[i[ok]], order[j[ok]], off[ok]
            other = rest[i] ^ rest[j]
            ok = np.ones(len(i), bool)
            for at in bands[:t]:
                ok &= _field(off, at) != 0
            for at in parts[:k]:
                ok &= _field(other, at) != 0
            yield i[ok], j[ok]


def _crossed(start: np.ndarray, size: np.ndarray, u: np.ndarray, v: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a member of list u and a member of list v, about ``most`` at a time."""

    def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())

    i, other = spread(start[u], size[u]), np.repeat(v, size[u])
    ends = np.cumsum(size[other])
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + most, most), side="right")) if len(ends) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield np.repeat(i[a:b], size[other[a:b]]), spread(start[other[a:b]], size[other[a:b]])


def _candidates(m: Match, each: int = 0):
    """Images a < b of one bucket and in how many matches they meet there."""
    each = each or _each(m)

    def meet(t: int, image: np.ndarray, bits: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if t == 0:  # equal descriptors meet in all tables
            yield from _pairs(bits, m.pairs)
        start = np.flatnonzero(np.r_[True, bits[1:] != bits[:-1]])
        size = np.diff(np.r_[start, len(bits)])
        for u, v in _near(bits[start], t, m):
            yield from _crossed(start, size, u, v, m.pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, k, r in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                blobs.setdefault(b, []).append(pa.decompress(r, decompressed_size=20 * k, codec="zstd", asbytes=True))
        for bucket, parts in blobs.items():
            cols = [(np.frombuffer(p, "<u8", len(p) // 20), np.frombuffer(p, "<u8", len(p) // 20, len(p) // 20 * 8), np.frombuffer(p, "<u4", -1, len(p) // 20 * 16)) for p in parts]
            image, bits, n = (np.concatenate(z) for z in zip(*cols, strict=True))
            order = np.lexsort((image, bits))
            image, bits, n = image[order], bits[order], n[order].astype(np.int64)
            once = np.r_[True, (image[1:] != image[:-1]) | (bits[1:] != bits[:-1])]  # equal images have equal descriptors
            image, bits, n = image[once], bits[once], n[once]
            names, image = np.unique(image, return_inverse=True)
            held, size = [], 0

            def counted(held: list) -> pa.RecordBatch:
                code, n = (np.concatenate(z) for z in zip(*held, strict=True))
                code, at = np.unique(code, return_inverse=True)
                total = np.bincount(at, n).astype(np.int64)
                a, b = (names[c].astype(np.int64) for c in np.divmod(code, len(names)))  # noqa: B023
                return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total)], ["a", "b", "n"])

            for i, j in meet(bucket // each, image, bits, n):
                ok = image[i] != image[j]
                i, j = i[ok], j[ok]
                if len(i):
                    held.append((np.minimum(image[i], image[j]) * len(names) + np.maximum(image[i], image[j]), n[i] * n[j]))
                    size += len(i)
                if size > m.pairs:
                    yield counted(held)
                    held, size = [], 0
            if held:
                yield counted(held)

    return run


def _written(columns: Iterable[np.ndarray]) -> bytes:
    """Columns of whole numbers; bytes of one weight stand together, so those of small numbers take little."""
    return pa.compress(b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), "zstd", asbytes=True)


def _read(data: bytes, columns: int, k: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * columns * k, codec="zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(c.T).view("<i8").ravel() for c in raw.reshape(columns, 8, k)]


def _summed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs in order, each once, with the sum of n."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
    return a[first], b[first], np.add.reduceat(n, first) if len(a) else n


def _counts(m: Match, parts: int):
    """``part, k, counts``: pairs of numbered images and their matches, those of many buckets summed and
    written together.  The pairs of an image a are in part a mod ``parts``."""

    def pack(held: list) -> Iterator[pa.RecordBatch]:
        a, b, n = _summed(*(np.concatenate(z) for z in zip(*held, strict=True)))
        order = np.argsort(a % parts, kind="stable")
        a, b, n = a[order], b[order], n[order]
        there, cut = np.unique(a % parts, return_index=True)
        blobs, sizes = [], []
        for x, y in zip(cut, [*cut[1:], len(a)], strict=True):
            step = np.diff(a[x:y], prepend=0)
            blobs.append(_written([step, np.where(step == 0, np.diff(b[x:y], prepend=0), b[x:y]), n[x:y]]))
            sizes.append(y - x)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())], ["part", "k", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size > 2 * m.pairs:
                yield from pack(held)
                held, size = [], 0
        if size:
            yield from pack(held)

    return run


def _totals(m: Match):
    """The pairs of a part with all their matches, where there are as many as votes are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for part, k, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blobs.setdefault(part, []).append((k, data))
        for held in blobs.values():
            found = []
            for k, data in held:
                step, b, n = _read(data, 3, k)
                start = np.flatnonzero((step != 0) | (np.arange(k) == 0))
                total = np.cumsum(b)
                b = total - np.repeat(total[start] - b[start], np.diff(np.r_[start, k]))
                found.append((np.cumsum(step), b, n))
            a, b, n = _summed(*(np.concatenate(z) for z in zip(*found, strict=True)))
            ok = n >= m.votes
            yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in (a, b, n)], ["a", "b", "n"])

    return run


class _Votes:
    """Votes for corners p and q of two images, in bins of shifts and scales."""

    def __init__(self, p: np.ndarray, q: np.ndarray, m: Match):
        self.m, self.codes, self.counts = m, [], []
        self.p, self.q = ([np.ascontiguousarray(r[c]) for c in ("x", "y", "scale")] for r in (p, q))
        self.far = [int(max(u.max(), v.max())) * 2 ** (m.scales - 1) // m.bin + 2 for u, v in zip(self.p[:2], self.q[:2], strict=True)]
        self.wide = 2 * self.far[0] + 1
        self.cells = (2 * m.scales - 1) * (2 * self.far[1] + 1) * self.wide

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """The matches of corners p[i] with q[j]."""
        (px, py, ps), (qx, qy, qs), m = self.p, self.q, self.m
        scale = ps[i].astype(np.int64) - qs[j]
        by = 2.0**-scale  # q's image is so much larger
        dx, dy = np.rint((px[i] * by - qx[j]) / m.bin), np.rint((py[i] * by - qy[j]) / m.bin)
        code = (scale + m.scales - 1) * ((2 * self.far[1] + 1) * self.wide) + ((dy + self.far[1]) * self.wide + dx + self.far[0]).astype(np.int64)
        if self.cells > 16 * len(code) + 4096:
            code, n = np.unique(code, return_counts=True)
        else:
            n = np.bincount(code)
            code = np.flatnonzero(n)
            n = n[code]
        self.codes.append(code)
        self.counts.append(n)

    def most(self) -> int:
        """Votes in the fullest bin with its right and lower neighbours, so that a shift near an edge of bins isn't cut in two."""
        code, n = np.concatenate(self.codes), np.concatenate(self.counts)
        code, at = np.unique(np.concatenate([code - d for d in (0, 1, self.wide, self.wide + 1)]), return_inverse=True)  # no bin is at an edge of the grid
        return int(np.bincount(at, np.tile(n, 4)).max(initial=0))


def _most(p: np.ndarray, q: np.ndarray, m: Match) -> int:
    """Votes for corners p and q in the fullest bin, all corners compared with all."""
    if not len(p) or not len(q):
        return 0
    votes, pb, qb = _Votes(p, q, m), np.ascontiguousarray(p["bits"]), np.ascontiguousarray(q["bits"])
    step = max(1, m.pairs // len(q))
    for at in range(0, len(p), step):
        i, j = np.nonzero(np.bitwise_count(pb[at : at + step, None] ^ qb) <= m.distance)
        votes.add(i + at, j)
    return votes.most()


class _Sorted:
    """Corners of an image, and in order of each of several keys of their descriptors when they are asked for."""

    def __init__(self, corners: np.ndarray):
        self.corners, self.bits, self.by = corners, np.ascontiguousarray(corners["bits"]), {}

    def order(self, at: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
        if at not in self.by:
            key = self.bits if at is None else _field(self.bits, at)
            order = np.argsort(key)
            self.by[at] = order, key[order]
        return self.by[at]


def _joined(p: _Sorted, q: _Sorted, at: tuple[int, int] | None, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Corners of p and q with one key; None if there are more than ``most`` pairs."""
    (p_order, p_key), (q_order, q_key) = p.order(at), q.order(at)
    first = np.searchsorted(q_key, p_key)
    n = np.searchsorted(q_key, p_key, side="right") - first
    ends = np.cumsum(n)
    if ends[-1] > most:
        return None
    return np.repeat(p_order, n), q_order[np.repeat(first - ends + n, n) + np.arange(ends[-1])]


def _copies(p: _Sorted, q: _Sorted, m: Match) -> bool:
    """Whether two images are copies: as many votes as they need, be it by equal descriptors alone.  Where
    those don't do, all descriptors are compared that share a band, or all with all if that is less work."""
    if not len(p.bits) or not len(q.bits):
        return False
    need = max(m.votes, m.share * min(len(p.bits), len(q.bits)))
    same = _joined(p, q, None, m.pairs)
    if same is not None and len(same[0]) >= need:
        votes = _Votes(p.corners, q.corners, m)
        votes.add(*same)
        if votes.most() >= need:
            return True
    if len(p.bits) * len(q.bits) > 30_000:
        bands, found = _cut(64, m.distance + 1), []
        for t, at in enumerate(bands):
            pairs = _joined(p, q, at, min(m.pairs, len(p.bits) * len(q.bits) // 8))
            if pairs is None:
                break
            i, j = pairs
            off = p.bits[i] ^ q.bits[j]
            ok = np.bitwise_count(off) <= m.distance
            for before in bands[:t]:
                ok &= _field(off, before) != 0
            found.append((i[ok], j[ok]))
        else:
            i, j = (np.concatenate(z) for z in zip(*found, strict=True))
            if len(i) < need:
                return False
            votes = _Votes(p.corners, q.corners, m)
            votes.add(i, j)
            return votes.most() >= need
    return _most(p.corners, q.corners, m) >= need


def _verified(m: Match):
    """The pairs that are copies.  Rows come by unit: first the corners of its images, then its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, corners = None, {}
        for batch in batches:
            keep = []
            columns = [c.to_pylist() for c in batch.columns[:5]]
            for i, (*at, a, b) in enumerate(zip(*columns, strict=True)):
                if at != unit:
                    unit, corners = at, {}
                if b is None:
                    corners[a] = _Sorted(_whole(batch.column(5)[i].as_py()))
                elif _copies(corners[a], corners[b], m):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _enough(met: DataFrame, full: DataFrame, m: Match) -> DataFrame:
    """The pairs that meet in as many matches as the fullest bin must have: fewer can't fill it."""
    sizes = full.select("image", F.expr(f"length(corners) div {_CORNER.itemsize}").alias("size")).distinct()
    of = lambda c: sizes.select(F.col("image").alias(c), F.col("size").alias(f"{c}_size"))
    some = met.where(F.col("n") >= m.votes).join(of("a"), "a").join(of("b"), "b")
    return some.where(F.col("n") >= m.share * F.least("a_size", "b_size")).select("a", "b")


def _thin(corners: bytes) -> bytes:
    """Corners for the way to another task: descriptors, then what is left of rows that differ little from the last."""
    r = np.frombuffer(corners, _CORNER)
    return np.uint32(len(r)).tobytes() + r["bits"].tobytes() + _written([r["x"], np.diff(r["y"], prepend=0), r["scale"]])


def _whole(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    r = np.empty(n, _CORNER)
    r["bits"] = np.frombuffer(data, "<u8", n, 4)
    r["x"], y, r["scale"] = _read(data[4 + 8 * n :], 3, n)
    r["y"] = np.cumsum(y)
    return r


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        corners = batch.column(1).to_pylist()
        columns = [batch.column(0), pa.array([_thin(x) for x in corners], pa.binary()), pa.array([len(x) for x in corners], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["image", "thin", "size"])


def _thinner(full: DataFrame) -> DataFrame:
    return full.select("image", "corners").mapInArrow(tidied(_thinned), "image long, thin binary, size long")


def _blocks(met: DataFrame, held: DataFrame, m: Match) -> tuple[DataFrame, DataFrame]:
    """``component, u, v, a, b``: the unit of each pair of ``met``, and ``component, u, v, image, size``:
    the images that each unit needs and their bytes.

    What hangs together is cut into blocks of about ``m.unit`` bytes of corners, and a unit is two
    blocks, or one, that have a pair.  So an image goes out once for each unit that has a pair of it,
    not once for each pair.
    """
    parts = components(met, release=True).join(held.select(F.col("image").alias("node"), "size"), "node")
    blocks = parts.groupBy("component").agg(F.ceil(F.sum("size") / m.unit).alias("blocks"))
    place = parts.join(blocks, "component").select("node", "component", "size", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    first = place.select(F.col("node").alias("a"), "component", F.col("block").alias("a_block"))
    second = place.select(F.col("node").alias("b"), F.col("block").alias("b_block"))
    dealt = met.join(first, "a").join(second, "b").select("component", F.least("a_block", "b_block").alias("u"), F.greatest("a_block", "b_block").alias("v"), "a", "b")
    need = dealt.select("component", "u", "v", F.col("a").alias("image")).union(dealt.select("component", "u", "v", "b")).distinct()
    return dealt, need.join(place.select(F.col("node").alias("image"), "size"), "image")


def _sent(dealt: DataFrame, need: DataFrame, held: DataFrame) -> DataFrame:
    """``component, u, v, a, b, corners``: the pairs and, with no b, the images that they need, unit by unit."""
    need = need.join(held.select("image", F.col("thin").alias("corners")), "image").select("component", "u", "v", F.col("image").alias("a"), F.lit(None).cast("long").alias("b"), "corners")
    n = 4 * held.sparkSession.sparkContext.defaultParallelism
    both = need.union(dealt.select("component", "u", "v", "a", "b", F.lit(None).cast("binary").alias("corners")))
    return both.repartition(n, "component", "u", "v").sortWithinPartitions("component", "u", "v", F.col("b").asc_nulls_first())


def _units(met: DataFrame, held: DataFrame, m: Match) -> DataFrame:
    """The units of all pairs with their images, ``image, corners``."""
    held = _thinner(held)
    return _sent(*_blocks(met, held, m), held)


def _compared(met: DataFrame, held: DataFrame, m: Match) -> tuple[DataFrame, list[str]]:
    """The pairs of ``met`` that are copies, and the paths where they are.

    Units go out in half as many rounds as an image is in units on the average, and each round's files
    are removed when it ends, so what is on disk at once is about twice as much as the images themselves.
    """
    dealt, need = _blocks(met, held, m)
    dealt, dealt_path = store(dealt, "pairs", release=True)
    need, need_path = store(need, "unit-images", release=True)
    sent = need.agg(F.sum("size")).first()[0] or 0
    once = need.select("image", "size").distinct().agg(F.sum("size")).first()[0] or 0
    rounds = -(-sent // (2 * once)) if once else 1
    links, paths = None, []
    for k in range(rounds):
        mine = F.pmod(F.xxhash64("component", "u", "v"), F.lit(rounds)) == k
        part, path = store(_sent(dealt.where(mine), need.where(mine), held).mapInArrow(tidied(_verified(m)), "a long, b long"), "copies", release=True)
        links, paths = part if links is None else links.union(part), [*paths, path]
    remove(held.sparkSession, dealt_path, need_path)
    return links, paths


def image_copies(images: DataFrame, m: Match = Match(), *, id_col: str = "image_id", image_col: str = "image", load=read_pgm) -> DataFrame:  # noqa: B008
    """``id, image, n_copies, component_id, kept``, one row for each row of ``images``.

    ``load`` turns a value of ``image_col`` into a grey array or None.  ``image`` names the pixels (null
    where there are none); equal images have equal names and are one component.  ``n_copies`` is in
    how many matched pairs the image is.  ``component_id`` is the smallest id reachable by matches
    and equal images.  Null, damaged and very small images match equal ones only.  Rows with a null
    id have a null component.  Other columns are ignored.
    """
    spark = images.sparkSession
    rows = images.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).alias("v"))

    columns = "id long, image long, corners binary, size int, task int, place long"
    named, named_path = store(rows.mapInArrow(tidied(_described(load, m)), columns), "images")
    tasks = named.groupBy("task").agg(F.count(F.lit(1)), F.sum("size")).orderBy("task").collect()
    starts = np.r_[0, np.cumsum([n for _, n, _ in tasks])].tolist()
    starts = spark.createDataFrame([(task, at) for (task, _, _), at in zip(tasks, starts, strict=False)], "task int, start long")
    # small numbers take less room than names
    named = named.join(F.broadcast(starts), "task").select("id", "image", "corners", "size", (F.col("start") + F.col("place")).alias("number"))
    low = named.where("size > 0").groupBy("image").agg(F.min("number").alias("low"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again, again_path = store(named.where("size > 0").select("image", "number").join(low, "image").where("number > low").select("number"), "images-again", release=True)
    full = named.where("size > 0").join(again, "number", "left_anti").select(F.col("number").alias("image"), "corners")

    each, parallel = _each(m, sum(n or 0 for _, _, n in tasks)), 4 * spark.sparkContext.defaultParallelism
    count = lambda batches: _counts(m, each)(_candidates(m, each)(batches))
    met, met_paths = None, []
    for t in range(m.distance + 1):  # one after the other, so that only one table is on disk
        dealt = full.mapInArrow(tidied(_dealt(m, range(t, t + 1), each)), "bucket int, n int, records binary").repartition(parallel, "bucket")
        part, path = store(dealt.mapInArrow(tidied(count), "part int, k int, counts binary"), f"met-{t}", release=True)
        met, met_paths = part if met is None else met.union(part), [*met_paths, path]
    met = met.repartition(parallel, "part").mapInArrow(tidied(_totals(m)), "a long, b long, n long")
    met, met_path = store(_enough(met, full, m), "met", release=True)
    remove(spark, *met_paths)
    some = met.select(F.col("a").alias("image")).union(met.select("b")).distinct()
    held, held_path = store(_thinner(full.join(some, "image", "left_semi")), "met-images", release=True)
    named, number_path = store(named.select("id", "image", "number"), "image-numbers", release=True)
    remove(spark, named_path, again_path)  # all that is left to compare is held
    links, links_paths = _compared(met, held, m)
    remove(spark, met_path, held_path)
    per = links.select(F.col("a").alias("number")).union(links.select("b")).groupBy("number").agg(F.count(F.lit(1)).alias("n_copies"))
    comp = components(links, release=True).withColumnRenamed("node", "number")
    first = named.where("image is not null").groupBy("image").agg(F.min("id").alias("first"), F.min("number").alias("number")).where("first is not null")
    known = first.join(comp, "number", "left").select("image", "number", "first", F.coalesce("component", "number").alias("part"))
    low = known.groupBy("part").agg(F.min("first").alias("component_id"))
    known, _ = store(known.join(low, "part").join(per, "number", "left").select("image", "component_id", F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies")), "image-classes", release=True)
    out = named.join(known, "image", "left").select("id", "image", F.coalesce("n_copies", F.lit(0)).cast("long").alias("n_copies"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    result, _ = store(out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))), "media", release=True)
    remove(spark, number_path, *links_paths)
    return result


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = image_copies(table(spark, sf_dir, "pages"), id_col="page_id", image_col="html", load=draw_page)
    return out.withColumnRenamed("id", "page_id")
