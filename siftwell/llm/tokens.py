"""Encoding with the tokenizers library, each word once and all of its places by arrays."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .cache import Recent


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others for the letters from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


#: Other words and parts of words in each generation of a worker's caches, and half the stems of Latin-1 letters (some 120 MB if all are full).
CACHE_WORDS = 150_000
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of texts that are cut into words together, unless one text has more, and words whose ids are put together.
TEXT_BYTES, WORDS = 8 << 20, 1 << 19
#: Words of Latin-1 letters alone, with ASCII punctuation behind them.
_LATIN = "^(?P<stem>[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+)(?P<tail>[!-/:-@\\[-`{-~]*)$"


def _in_a_row(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``which`` of those that lie in ``flat`` with these sizes, in a row, and the size of each."""
    n = size[which]
    first = (np.cumsum(size) - size)[which] - np.cumsum(n) + n
    return flat[np.repeat(first, n) + np.arange(n.sum())], n


class WordTokenizer:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, for tokenizers that
    drop white space before they look for words.

    With such a tokenizer no token reaches over a space or a line feed, so a text's ids are its
    words' ids in a row.  ASCII punctuation behind a letter or digit is always a token of its own
    there, so it is cut off first; that and lower-casing make more words alike.  Texts are cut, and
    their different words found, many at a time; what is left of those goes through the library once
    and is then looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._model = self.library.model
        self.n_ids = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.n_ids <= 1 << 16 else "<u4")
        self._special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # then a special token can't hide in letters followed by punctuation
        self._plain = all(not t[:1].isalnum() and not t[-1:].isalnum() and any(c.isalnum() for c in t) for t in self._special)
        self._letters = byte_letters()
        probe = "Ab!? c\nd"
        if self.library.encode(probe, add_special_tokens=False).ids != [i for w in ("ab", "!?", "c", "d") for i in self.library.encode(w, add_special_tokens=False).ids]:
            raise ValueError(f"{path}: not a tokenizer of lower-case words")
        self._words, self._stems, self._latin = Recent(self._word, CACHE_WORDS), Recent(self._stem, CACHE_WORDS), Recent(self._of_latin, 2 * CACHE_WORDS)

    def _of_latin(self, stem: str) -> bytes:
        """The ids of lower-case Latin-1 letters.  They are what the library's normaliser leaves alone
        and its splitter leaves whole, so they go straight to its model."""
        if not stem.isascii():
            stem = "".join([self._letters[b] for b in stem.encode()])
        return array(self.dtype.char, [t.id for t in self._model.tokenize(stem)]).tobytes()

    def _stem(self, stem: str) -> bytes:
        """The ids of a part of a word, by the library."""
        return array(self.dtype.char, self.library.encode(stem, add_special_tokens=False).ids if stem else []).tobytes()

    def _word(self, w: str) -> bytes:
        """The ids of a word that isn't of Latin-1 letters alone."""
        of, stem = self._stems, w.rstrip(_TAIL)
        if stem == w or not self._plain and any(s in w for s in self._special):
            return of[w]
        if not stem.isalpha() and (not stem or not stem[-1].isalnum() or any(s in w for s in self._special)):
            return of[w]
        return of[stem] + of[w[len(stem) :]]

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, and how many each word has."""
        coded = words.dictionary_encode()
        which, words = coded.indices.to_numpy(), coded.dictionary
        cut = pc.extract_regex(words, _LATIN) if self._plain else pa.nulls(len(words), pa.struct([("stem", words.type), ("tail", words.type)]))
        latin = cut.is_valid()
        stem, tail = (x.dictionary_encode() for x in (pc.utf8_lower(cut.field("stem").filter(latin)), cut.field("tail").filter(latin)))
        other = words.filter(pc.invert(latin))
        asked = zip((self._latin, self._stems, self._words), (stem.dictionary, tail.dictionary, other), strict=True)
        parts = [ids for of, x in asked for ids in map(of.__getitem__, x.to_numpy(zero_copy_only=False).tolist())] + [b""]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        two = np.full((len(words), 2), len(parts) - 1, np.int64)  # the last is empty
        latin = latin.to_numpy(zero_copy_only=False)
        two[latin, 0] = stem.indices.to_numpy()
        two[latin, 1] = len(stem.dictionary) + tail.indices.to_numpy()
        two[~latin, 0] = len(parts) - 1 - len(other) + np.arange(len(other))
        flat, n = _in_a_row(np.frombuffer(b"".join(parts), self.dtype), size, two.ravel())
        return _in_a_row(flat, n[::2] + n[1::2], which)

    def encode_batch(self, texts: Iterable[str | None] | pa.Array) -> Iterator[bytes]:
        """The ids of each text (null: empty), as little-endian numbers of ``dtype``."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(texts):
            past = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, past + TEXT_BYTES, side="right")))
            words = pc.split_pattern(pc.replace_substring(texts.slice(at, to - at), "\n", " "), " ")
            flat = words.flatten()
            ids, sizes = zip(*(self._ids(flat.slice(k, WORDS)) for k in range(0, len(flat), WORDS)), strict=True)
            raw = np.concatenate(ids).tobytes()
            cuts = np.r_[0, np.cumsum(np.concatenate(sizes))][np.r_[0, np.cumsum(pc.list_value_length(words).to_numpy())]] * self.dtype.itemsize
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield raw[a:b]
            at = to


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker; the vocabulary file is read where the code runs."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
