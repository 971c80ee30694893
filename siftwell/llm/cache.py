"""Results by word, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

#: Longer words are made anew each time, so that the number of words bounds the bytes too.
LONGEST = 64


class Recent(dict):
    """``make(word)`` by word, made when a word is first asked for.

    There are two generations of at most ``most`` words: when the young one is full it becomes the old
    one, and words that are asked for again move back, so frequent words stay.
    """

    __slots__ = ("make", "most", "old")

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str):
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(word) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


def tidied(run: Callable) -> Callable:
    """``run``, a function for ``mapInArrow``, that gives what it has freed back to the system at its end.

    Python workers live on from task to task, and the allocators of C and Arrow keep freed memory."""

    def tidy(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
            if trim:
                trim(0)

    return tidy
