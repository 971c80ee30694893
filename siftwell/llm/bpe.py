"""Byte-level BPE, encoded by a priority queue over a doubly linked list of symbols.

A word's symbols are nodes of a linked list.  The queue holds (rank, position) of adjacent pairs
that have a merge; a popped entry whose pair has changed since is stale and skipped.  A word is
merged once and then looked up.  Decoding concatenates the vocabulary's byte strings.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import Recent, tidied
from .common import table
from .tokens import byte_letters

#: How byte-level vocabularies of this family cut a text into words (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and chunks in each generation of a worker's caches.
CACHE_WORDS = 150_000


class ByteBPE:
    """``encode`` and ``decode`` of a byte-level BPE file (vocabulary, merges, added tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        to_bytes = lambda s: bytes(byte_of[c] for c in s)
        self.strings: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for s, i in vocab.items():
            self.strings[i] = to_bytes(s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self.ids_of_bytes = [vocab[c] for c in byte_letters()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self._word = regex.compile(PATTERN)
        self._odd = regex.compile(r"\s (?=\s)")
        self._cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._words = Recent(lambda w: np.array(self.merge(w.encode()), "<u4").tobytes(), CACHE_WORDS)
        self._chunks = Recent(lambda w: self._of_words(" " + w), CACHE_WORDS)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        sym = [self.ids_of_bytes[b] for b in word]
        n = len(sym)
        if n < 2:
            return sym
        merges = self.merges
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            m = merges.get((sym[i], sym[i + 1]))
            if m:
                queue.append((m[0], i, m[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, new = heapq.heappop(queue)
            j = after[i] if sym[i] >= 0 else -1
            if j < 0:
                continue  # stale: the node is gone or last
            m = merges.get((sym[i], sym[j]))
            if m is None or m[0] != rank:
                continue  # stale: the pair has changed
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((new, sym[k])):
                    heapq.heappush(queue, (m[0], i, m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((sym[h], new))):
                heapq.heappush(queue, (m[0], h, m[1]))
        return [s for s in sym if s >= 0]

    def _of_words(self, text: str) -> bytes:
        return b"".join(map(self._words.__getitem__, self._word.findall(text)))

    def _plain(self, text: str) -> bytes:
        """A text without special tokens.  A space before a non-space always begins a word, so a text
        without runs of white space is cut there and its chunks are looked up."""
        if self._odd.search(text) or "  " in text:
            return self._of_words(text)
        first, *rest = text.split(" ")
        return self._of_words(first) + b"".join(map(self._chunks.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers; special tokens in the text are taken as such."""
        if self._cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in self._cut.split(text) if p)

    def decode(self, ids: np.ndarray) -> str:
        """Special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        strings = self.strings
        return b"".join([strings[i] for i in ids.tolist()]).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def byte_bpe(path: str) -> ByteBPE:
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (little-endian 32-bit).  Null texts are empty; each row gives one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            held, size, since = [], 0, 0
            for i, x in enumerate(batch.column(1)):
                held.append(bpe.encode(x.as_py() or ""))
                size += len(held[-1])
                if size > 8 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(since, i + 1 - since), pa.array(held, pa.binary())], ["doc_id", "ids"])
                    held, size, since = [], 0, i + 1

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), "doc_id long, ids binary")


def decode_documents(ids: DataFrame, *, tokenizer: str) -> DataFrame:
    """``doc_id, ids, text`` for rows ``doc_id, ids``; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(tokenizer)
        for batch in batches:
            held, size, since = [], 0, 0
            for i, x in enumerate(batch.column(1)):
                held.append(bpe.decode(np.frombuffer(x.as_buffer(), "<u4")) if x.is_valid else "")
                size += len(held[-1])
                if size > 8 << 20 or i == batch.num_rows - 1:
                    part = batch.slice(since, i + 1 - since)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(held, pa.string())], ["doc_id", "ids", "text"])
                    held, size, since = [], 0, i + 1

    return ids.select("doc_id", "ids").mapInArrow(tidied(run), "doc_id long, ids binary, text string")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = decode_documents(encode_documents(table(spark, sf_dir, "documents"), tokenizer=path), tokenizer=path)
    return out.select("doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
