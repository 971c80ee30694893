"""Token files, BPE and packing against the tokenizers library and brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwell.llm import bpe, packing, rans, tokens

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "a", "A!? b", "don't DON'T 're", "x<|endoftext|>y <|startoftext|>", "<|endoftext|> ", "\x1c\x1d a\x85b\xa0c d　e", "é́ É.", "ΑΣ ΑΣ. Σ", "İI ǅ ﬁ", "a  b   c \n\n d\t\te \n", "12 1234 ½ ²", "日本語 テスト。", "\U0001f600\U0001f469‍\U0001f680 x", "__a_b__", "$$$ %%% ###", "a\r\nb\x0bc\x0cd", "a̸ ; ;", "́x ́", "word,.;: word!!", "﻿bom", "\x00\x01", "l’eau d'été"]


@pytest.fixture(scope="module")
def word_lib():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte_lib():
    return Tokenizer.from_file(BYTE)


def brute_ids(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


def test_word_tokenizer_is_the_library(word_lib):
    tok = tokens.WordTokenizer(WORD)
    for x, raw in zip(ODD, tok.encode_batch(ODD), strict=True):
        assert np.frombuffer(raw, tok.dtype).tolist() == brute_ids(word_lib, x), repr(x)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r'.,!<|>_aAbBéÉ1²$́\xa0\x85 \x1c"), st.characters(max_codepoint=0x2FFF, exclude_categories=["Cs", "Cn"])), max_size=40))
def test_tokenizers_on_any_text(text):
    lib, tok = _both()
    assert np.frombuffer(next(tok[0].encode_batch([text])), tok[0].dtype).tolist() == brute_ids(lib[0], text)
    ids = np.frombuffer(tok[1].encode(text), "<u4")
    assert ids.tolist() == brute_ids(lib[1], text)
    assert tok[1].decode(ids) == lib[1].decode(ids.tolist(), skip_special_tokens=False)


_made = []


def _both():
    if not _made:
        _made.append(((Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)), (tokens.WordTokenizer(WORD), bpe.ByteBPE(BYTE))))
    return _made[0]


def test_words_are_taken_together(word_lib, monkeypatch):
    """Each different word once, whatever is before or behind it, and words of letters never one by one."""
    import pyarrow as pa

    tok = tokens.WordTokenizer(WORD)
    asked = []
    make, model = tok._words.make, tok.library.model

    class Counted:
        def tokenize(self, stem):
            asked.append(stem)
            return model.tokenize(stem)

    tok._model = Counted()
    tok._words.make = lambda w: asked.append(w) or make(w)
    text = "Árbol, ÁRBOL!! casa Casa'. casa\nx1 (casa) 'casa"
    assert [np.frombuffer(r, tok.dtype).tolist() for r in tok.encode_batch([text, None, text])] == [brute_ids(word_lib, text), [], brute_ids(word_lib, text)]
    assert sorted(asked) == sorted(["casa", "".join(tok._letters[b] for b in "árbol".encode()), "x1", "(casa)", "'casa", ""])
    assert list(tok.encode_batch([])) == []
    monkeypatch.setattr(tokens, "TEXT_BYTES", 16)
    monkeypatch.setattr(tokens, "WORDS", 3)
    texts = [*ODD, None, "a b c d e f g h, I! " * 5, *ODD]
    for kind in (pa.string(), pa.large_string()):
        col = pa.array(["not in the slice", *texts], kind).slice(1)
        assert [np.frombuffer(r, tok.dtype).tolist() for r in tok.encode_batch(col)] == [brute_ids(word_lib, x) for x in texts]


def test_byte_bpe_is_the_library(byte_lib):
    own = bpe.ByteBPE(BYTE)
    for x in ODD + [" ".join(ODD), "ab" * 500, "   " * 100]:
        ids = np.frombuffer(own.encode(x), "<u4")
        assert ids.tolist() == brute_ids(byte_lib, x), repr(x)
        assert own.decode(ids) == byte_lib.decode(ids.tolist(), skip_special_tokens=False)
    assert own.decode(np.array([own.ids_of_bytes[0xC3]])) == "�"


def test_caches_start_anew(word_lib, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    tok, own = tokens.WordTokenizer(WORD), bpe.ByteBPE(BYTE)
    lib = Tokenizer.from_file(BYTE)
    for x in ["a b c d e f", "g h a b c", "a a a", "b", "a b c d e f g h", "a b c d e f g h", "h g"]:
        assert np.frombuffer(next(tok.encode_batch([x])), tok.dtype).tolist() == brute_ids(word_lib, x)
        assert np.frombuffer(own.encode(x), "<u4").tolist() == brute_ids(lib, x)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 65535, 65536, 65537, 300_001])
@pytest.mark.parametrize("kind", ["one", "flat", "steep"])
def test_rans_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"one": np.full(n, 7), "flat": rng.integers(0, 49408, n), "steep": np.minimum(rng.zipf(1.3, n), 49407)}[kind].astype(np.uint16)
    t = rans.FrequencyTable.from_counts(np.bincount(ids, minlength=49408))
    blocks = rans.encode_ids(ids, t)
    assert rans.decode_blocks(memoryview(b"".join(blocks)), len(blocks), t).tolist() == ids.tolist()
    if n > 200_000 and kind == "steep":
        p = np.bincount(ids) / n
        bits = -(p[p > 0] * np.log2(p[p > 0])).sum() * n
        assert sum(map(len, blocks)) * 8 < 1.08 * bits  # near the entropy


def test_rans_damage_is_found():
    ids = np.arange(5000, dtype=np.uint16)
    t = rans.FrequencyTable.from_counts(np.bincount(ids))
    data = rans.pack_shard(np.array([1]), np.array([0]), np.array([5000]), ids, 0, t)
    assert rans.unpack_shard(data, t)[3].tolist() == ids.tolist()
    bad = bytearray(data)
    bad[-3] ^= 1
    with pytest.raises(ValueError):
        rans.unpack_shard(bytes(bad), t)
    with pytest.raises(ValueError):
        rans.unpack_shard(data, rans.FrequencyTable.from_counts(np.ones(4)))


ROWS = [(5, "b b b", 1), (1, None, 1), (None, "null id", 2), (3, "", 3), (9, "word " * 7000, 3), (2, "Same text, same.", 4), (4, "Same text, same.", 4), (4, "Same text, same.", 4), (-8, "x", 0)]
SCHEMA = "doc_id long, text string, start int"


def test_token_files(spark, word_lib):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    path = rans.scratch(spark, "test")
    rans.write_token_files(df, path, tokenizer=WORD)
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rans.read_token_files(spark, path).orderBy("start").collect()]
    start = 0
    for d, at, ids in got:
        assert at == start
        start += len(ids)
    assert [g[0] for g in got] == sorted((r[0] for r in ROWS), key=lambda x: (x is not None, x or 0))
    assert Counter((d, tuple(i)) for d, _, i in got) == Counter((d, (*brute_ids(word_lib, x), 1)) for d, x, _ in ROWS)
    empty = rans.scratch(spark, "test")
    rans.write_token_files(df.limit(0), empty, tokenizer=WORD)
    assert rans.read_token_files(spark, empty).count() == 0
    rans.remove(spark, path, empty)


def test_op1_brute(spark, sf_dir, word_lib):
    from siftwell.llm.registry import queries

    want, start = {}, 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array([*brute_ids(word_lib, r.text), 1], "<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries()["op1_token_files"](spark, sf_dir).collect()} == want


def test_op3_brute(spark, sf_dir, byte_lib):
    from siftwell.llm.registry import queries

    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op3_byte_bpe"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = brute_ids(byte_lib, r.text)
        text = byte_lib.decode(ids, skip_special_tokens=False)
        assert got.pop(r.doc_id) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert not got


def test_bpe_nulls(spark):
    df = spark.createDataFrame([(1, None, 0), (None, "a", 0), (None, "a", 0)], "doc_id long, text string, ids int")
    out = bpe.decode_documents(bpe.encode_documents(df, tokenizer=BYTE), tokenizer=BYTE).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out) == [(0, "a"), (0, "a"), (1, "")]
    assert bpe.encode_documents(df.limit(0), tokenizer=BYTE).count() == 0


def check_packing(rows, capacity):
    """rows: sequence, offset, length.  No overlap, no gap, nothing over the capacity."""
    by = {}
    for s, o, n in rows:
        by.setdefault(s, []).append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return by


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), max_size=30))
def test_pack_lengths(counts):
    patterns = packing.pack_lengths(counts, 60)
    got = Counter()
    for p in patterns:
        assert sum(n * k for n, k in p.items) + p.gap == 60
        assert sum(k for n, k in p.items if 3 * n > 60) <= 2
        for n, k in p.items:
            got[n] += k * p.times
    assert got == Counter(counts)
    bins = sum(p.times for p in patterns)
    items = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
    assert bins <= 1.25 * first_fit(items, 60) + 1
    assert bins >= -(-sum(items) // 60)


def first_fit(items, capacity):
    bins = []
    for n in items:
        for i, g in enumerate(bins):
            if g >= n:
                bins[i] -= n
                break
        else:
            bins.append(capacity - n)
    return len(bins)


def test_packing_rows(spark, word_lib):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    rows = packing.pack_documents(df, tokenizer=WORD, capacity=50).collect()
    check_packing([(r.sequence_id, r.offset, r.length) for r in rows], 50)
    want = Counter()
    for d, x, _ in ROWS:
        ids = [*brute_ids(word_lib, x), 0]
        for k, at in enumerate(range(0, len(ids), 50)):
            want[(d, k, at, tuple(ids[at : at + 50]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    assert packing.pack_documents(df.limit(0), tokenizer=WORD).count() == 0


def test_assemble(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    packed = packing.pack_documents(df, tokenizer=WORD, capacity=50)
    packed, _ = packing.store(packed, "test")
    sequences = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in packing.assemble(packed).collect()}
    for r in packed.collect():
        assert sequences[r.sequence_id][r.offset : r.offset + r.length].tolist() == np.frombuffer(r.ids, "<u4").tolist()


def test_op6_brute(spark, sf_dir, word_lib):
    from siftwell.llm.registry import queries

    rows = queries()["op6_best_fit_packing"](spark, sf_dir).collect()
    by = check_packing([(r.sequence_id, r.offset, r.length) for r in rows], 2048)
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    lengths = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = np.array([*brute_ids(word_lib, r.text), 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            one = ids[at : at + 2048]
            lengths.append(len(one))
            assert got.pop((r.doc_id, k)) == (at, len(one), zlib.crc32(one.tobytes()))
    assert not got
    assert len(by) <= first_fit(sorted(lengths, reverse=True), 2048)


