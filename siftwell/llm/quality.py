"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal.

Features of a text are its word unigrams and bigrams and the unigrams, bigrams and trigrams of its
words' shapes (classes of characters in a row; whether a word repeats the one before it is part of
its shape), hashed into 2**20 places.  Counts go in as log(1 + n), scaled to length 1.  A score is
the sigmoid of a sparse dot product.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import Recent, tidied
from .common import remove, store, table

BITS = 20
CACHE_WORDS = 150_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") for i in range(8)], np.uint64)
_CLASSES = ((re.compile(r"[A-Z]+"), "A"), (re.compile(r"[a-z]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"[^\W\d_A-Za-z]+"), "ä"))


def shape(word: str) -> str:
    """Runs of upper-case, lower-case, digits and other letters as one sign each; the rest as it is."""
    for pattern, sign in _CLASSES:
        word = pattern.sub(sign, word)
    return word.replace("ä", "a").replace("aa", "a").replace("aa", "a")


class Features:
    """Turns texts into (places, values); words are hashed once."""

    def __init__(self, bits: int = BITS):
        self.shift = np.uint64(64 - bits)
        self._known = Recent(self._hash, CACHE_WORDS)

    def _hash(self, word: str) -> bytes:
        """Hashes of the word, in lower case, and of its shape."""
        d = hashlib.blake2b(word.lower().encode("utf-8", "replace"), digest_size=8).digest()
        s = hashlib.blake2b(shape(word).encode("utf-8", "replace"), digest_size=8).digest()
        return d + s

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        parts = [_SALTS[:1]]  # the bias
        if words:
            both = np.frombuffer(b"".join(map(self._known.__getitem__, words)), "<u8").reshape(-1, 2)
            w, s = both[:, 0], both[:, 1].copy()
            again = np.flatnonzero(w[1:] == w[:-1]) + 1
            s[again] ^= _SALTS[7]
            s2 = s[:-1] * _MUL + s[1:]
            parts += [w ^ _SALTS[1], (w[:-1] * _MUL + w[1:]) ^ _SALTS[2], s ^ _SALTS[3], s2 ^ _SALTS[4], (s2[:-1] * _MUL + s[2:]) ^ _SALTS[5]]
        at, n = np.unique((np.concatenate(parts) * _MUL) >> self.shift, return_counts=True)
        value = np.log1p(n)
        return at.astype(np.int32), (value / np.sqrt((value * value).sum())).astype(np.float32)


class FTRL:
    """Per-coordinate follow-the-regularised-leader."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - y) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def sigmoid(v: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(v, -40, 40))))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn a label from: crc32 of the id as text, mod 3, is 1; a null id counts
    as the empty text, so it isn't held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 12_000, epochs: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights learnt from at most ``max_rows`` labelled rows that aren't held out.

    The bound is a parameter; the rows taken are those whose hashed ids come first, so the sample
    doesn't depend on the layout.  A document with several labels has the lowest; null labels don't
    count.  Without labelled rows all weights are 0 and every score is 0.5.
    """
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    chosen = one.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    # the chosen ids are at most max_rows pairs of numbers
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_text", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for batch in batches:
            got = [f(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.tobytes() for a, _ in got], pa.binary()), pa.array([v.tobytes() for _, v in got], pa.binary())], ["id", "y", "at", "value"])

    model = FTRL()
    spark = docs.sparkSession
    sample, path = store(rows.mapInArrow(tidied(run), f"id {dict(rows.dtypes)['_id']}, y int, at binary, value binary").select(F.xxhash64("id").alias("h"), "*", F.md5("at").alias("tie")), "sample", "lz4")
    if sample.count() > max_rows:  # rows that share an id
        sample = sample.orderBy("h", "id", "tie").limit(max_rows)
    # a part of the table at a time reaches the driver
    data = sorted(((r.h, r.id, r.tie, np.frombuffer(r.at, np.int32), np.frombuffer(r.value, np.float32), r.y) for r in sample.toLocalIterator()), key=lambda r: r[:3])
    data = [r[3:] for r in data]
    remove(spark, path)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            model.update(*data[i])
    return model.weights().astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1) added; columns of that name are replaced.

    Null and empty texts have the bias alone.  Each row is scored by its text only."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 MB, whatever the corpus

    @F.pandas_udf("double")
    def dot(texts):
        import pandas as pd

        f, w = _features(), shared.value
        out = np.empty(len(texts))
        for i, x in enumerate(texts):
            at, v = f(x)
            out[i] = sigmoid(float(w[at] @ v))
        return pd.Series(out)

    return docs.drop(*[c for c in docs.columns if c.lower() == "score"]).withColumn("score", dot(F.col(text_col)))


_loaded: list[Features] = []


def _features() -> Features:
    if not _loaded:
        _loaded.append(Features())
    return _loaded[0]


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
