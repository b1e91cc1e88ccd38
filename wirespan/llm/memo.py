"""Word-wise memos for tokenizers whose results never depend on what lies beyond a space."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Characters worked on at a time, so that long texts do not add up in a task's memory.
SLICE_CHARS = 1_000_000


#: The memos of this worker.
_memos: weakref.WeakSet = weakref.WeakSet()


class Memo:
    """What ``encode_many`` gives for each word; a worker keeps words, none longer than LONGEST_WORD, up to ``limit`` bytes."""

    #: Longer words are runs without spaces, which hardly come again.
    LONGEST_WORD = 64
    #: Bytes of a dictionary's entry and of the heads of its key and value.
    ENTRY = 200

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = 32 << 20):
        self.encode_many, self.limit, self.known, self.held = encode_many, limit, {}, 0
        _memos.add(self)

    def forget(self) -> None:
        self.known, self.held = {}, 0

    def join(self, texts: list[list[str]]) -> list[bytes]:
        """The concatenated results of each text's words."""
        known = self.known
        missing = list(set().union(*texts).difference(known))
        known.update(zip(missing, self.encode_many(missing), strict=True))
        out = [b"".join(map(known.__getitem__, words)) for words in texts]
        for word in missing:
            size = self.ENTRY + 4 * len(word) + len(known[word])
            if len(word) > self.LONGEST_WORD or self.held + size > self.limit:
                del known[word]
            else:
                self.held += size
        return out


def slices(column: pa.Array | list[str], most: int = SLICE_CHARS) -> Iterator[tuple[slice, list[str]]]:
    """Runs of texts with about ``most`` characters, null as the empty text; a longer text is a run of its own."""
    column = pa.array(column, pa.string()) if isinstance(column, list) else column
    begin = chars = 0
    part = lambda a, b: (slice(a, b), [x or "" for x in column.slice(a, b - a).to_pylist()])
    for i, n in enumerate(pc.fill_null(pc.utf8_length(column), 0).to_pylist()):
        if i > begin and chars + n > most:
            yield part(begin, i)
            begin, chars = i, 0
        chars += n
    if begin < len(column):
        yield part(begin, len(column))


def trimmed(run: Callable) -> Callable:
    """run (for mapInArrow), before and after which the worker gives memory back to the machine: what the memos of other
    stages hold, and what is freed.

    Workers are kept for later tasks, and beside those of an earlier stage the JVM may need the memory.
    """

    @functools.wraps(run)
    def each(batches):
        if any(memo.held for memo in _memos):
            for memo in _memos:
                memo.forget()
            _release()
        yield from run(batches)
        _release()

    return each


def _release() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)
