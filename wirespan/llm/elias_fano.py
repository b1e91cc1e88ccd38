"""Elias-Fano sequences and the n-gram trie made of them, as arrays in one block of bytes that can be memory-mapped."""

from __future__ import annotations

import json

import numpy as np


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits each, one after another in 64-bit words, with a spare word at the end."""
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
    word, shift = (at >> np.uint64(6)).astype(np.intp), at & np.uint64(63)
    np.bitwise_or.at(out, word, values << shift)
    over = shift + np.uint64(width) > np.uint64(64)
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


class EliasFano:
    """A non-decreasing sequence of n numbers below 2 ** 64: their low bits as they are, their high bits in unary.

    ``ones`` counts the set bits before each word of ``high``, so that the i-th set bit is found by a search there.
    """

    FIELDS = ("low", "high", "ones")

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones
        self._clear: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, int(values[-1] // n).bit_length() - 1) if n else 0
        low = pack_bits(values & np.uint64((1 << width) - 1), width) if width else np.zeros(2, np.uint64)
        at = (values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
        high = np.zeros(int(at[-1]) // 64 + 2 if n else 1, np.uint64)  # a clear bit follows the last set one
        np.bitwise_or.at(high, (at >> np.uint64(6)).astype(np.intp), np.uint64(1) << (at & np.uint64(63)))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))]).astype(np.uint32)
        return cls(n, width, low, high, ones)

    @staticmethod
    def _within(word: np.ndarray, bits: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Places of the left-th set bits of some words, by halving them."""
        place = word.astype(np.int64) * 64
        for step in (32, 16, 8, 4, 2, 1):
            here = np.bitwise_count(bits & np.uint64((1 << step) - 1)).astype(np.int64)
            beyond = left >= here
            left = left - here * beyond
            bits = bits >> (beyond * np.uint64(step))
            place += beyond * step
        return place

    def select(self, i: np.ndarray) -> np.ndarray:
        """Places of the i-th set bits."""
        word = np.searchsorted(self.ones, i.astype(np.uint32), side="right") - 1
        return self._within(word, self.high[word], i - self.ones[word].astype(np.int64))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.select(i) - i).astype(np.uint64) << np.uint64(self.width)) | self._lows(i)

    def _zeros(self, i: np.ndarray) -> np.ndarray:
        """Places of the i-th clear bits; one beyond the sequence where there are fewer."""
        clear = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones if self._clear is None else self._clear
        self._clear = clear
        word = np.minimum(np.searchsorted(clear, i, side="right") - 1, len(self.high) - 1)
        return self._within(word, ~self.high[word], i - clear[word])

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.intp), at & np.uint64(63)
        low = self.low[word] >> shift | np.where(shift > np.uint64(0), self.low[word + 1] << (np.uint64(64) - shift & np.uint64(63)), np.uint64(0))
        return low & np.uint64((1 << self.width) - 1)

    def find(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of each value, -1 where it is not, if given between the indices first (with it) and last (without it).

        A value's high bits name a run of the sequence; where that overlaps the indices asked for, its low bits are searched.
        """
        out = np.full(len(values), -1)
        if not self.n:
            return out
        high, low = np.minimum(values >> np.uint64(self.width), np.uint64(1 << 62)).astype(np.int64), values & np.uint64((1 << self.width) - 1)
        most = len(self.high) * 64 - int(self.ones[-1])  # clear bits; beyond the last set one every run is empty
        ask = np.flatnonzero(high < most)
        high, low = high[ask], low[ask]
        hi = np.minimum(self._zeros(high) - high, self.n)
        lo = np.where(high > 0, self._zeros(np.maximum(high - 1, 0)) + 1 - high, 0)
        if first is not None:
            lo, hi = np.maximum(lo, first[ask]), np.minimum(hi, last[ask])
        end = hi.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) >> 1
            less = self._lows(middle) < low[open_]
            lo[open_] = np.where(less, middle + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], middle)
        within = np.flatnonzero(lo < end)
        hit = within[self._lows(lo[within]) == low[within]]
        out[ask[hit]] = lo[hit]
        return out


class Codebook:
    """Numbers as 8-bit codes: of at most 256 different ones, or of as many equal steps between the least and the largest."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.codes, self.values = codes, values

    @classmethod
    def of(cls, numbers: np.ndarray) -> Codebook:
        if not len(numbers):
            return cls(np.zeros(0, np.uint8), np.zeros(1))
        values, codes = np.unique(numbers, return_inverse=True)
        if len(values) > 256:
            codes = ((numbers - values[0]) / (values[-1] - values[0]) * 255.999).astype(np.intp)
            values = np.bincount(codes, numbers, 256) / np.maximum(np.bincount(codes, minlength=256), 1)
        return cls(codes.astype(np.uint8), values)

    def get(self, i: np.ndarray) -> np.ndarray:
        return self.values[self.codes[i]]


class Trie:
    """The n-grams (u, v, w) of some words v, by levels whose monotone pointers lead from one to the next.

    ``tops`` holds the words v, sorted, with how often each was seen (``counts``) and what it leaves to shorter contexts
    (``back``); ``words`` the codes of all u and w. For the i-th v, ``after`` holds i * W + w for each successor w, from
    ``after_at[i]`` to ``after_at[i + 1]``, and ``before`` i * W + u for each context (u, v), with its own weight. For the
    j-th context, ``third`` holds j * R + r for each w that follows it, where r is the place of w among the successors of
    v: an identifier relative to the shorter context. Probabilities and weights are logarithms (base 10) of 8 bits.
    """

    SEQUENCES = ("tops", "words", "after", "after_at", "before", "before_at", "third", "third_at")
    BOOKS = ("after_log", "third_log", "back", "before_back")
    #: Pairs looked up at a time, so that what is in between stays small.
    SCORED = 1 << 17

    @classmethod
    def of(cls, tops: np.ndarray, words: np.ndarray, grams: tuple[np.ndarray, ...], whole: tuple[np.ndarray, ...], discount: float) -> Trie:
        """From trigrams (i, u, w, n), as places in ``tops`` and ``words`` and counts, each perhaps in several parts.

        ``whole`` has all bigrams (i, w, n) of those v whose trigrams are not all here.
        """
        self, (i, u, w, n) = cls(), grams
        self.size = len(words)
        (context_of, w_of), n = _summed(i * self.size + u, w, n)
        split = np.isin(np.arange(len(tops)), whole[0])[context_of // self.size] if len(tops) else np.zeros(0, bool)
        bigram = np.concatenate([(context_of // self.size * self.size + w_of)[~split], whole[0] * self.size + whole[1]])
        after, back_to = np.unique(bigram, return_inverse=True)
        after_n = np.bincount(back_to, np.concatenate([n[~split], whole[2]]), len(after))
        after_at = np.searchsorted(after // self.size, np.arange(len(tops) + 1)) if len(after) else np.zeros(len(tops) + 1, np.int64)
        before, j = np.unique(context_of, return_inverse=True)
        before_at = np.searchsorted(before // self.size, np.arange(len(tops) + 1)) if len(before) else np.zeros(len(tops) + 1, np.int64)
        v_of = context_of // self.size
        place = np.searchsorted(after, v_of * self.size + w_of) - after_at[v_of]
        self.reach = int(np.diff(after_at).max(initial=0)) + 1
        third = j * self.reach + place
        third_at = np.searchsorted(j, np.arange(len(before) + 1))
        self.counts = np.bincount(np.repeat(np.arange(len(tops)), np.diff(after_at)), after_n, len(tops)).astype(np.int64)
        context_n = np.bincount(j, n, len(before))
        with np.errstate(divide="ignore"):
            self.after_log = Codebook.of(np.log10((after_n - discount) / self.counts[after // max(1, self.size)]))
            self.third_log = Codebook.of(np.log10((n - discount) / context_n[j]))
            self.back = Codebook.of(np.log10(discount * np.diff(after_at) / np.maximum(self.counts, 1)))
            self.before_back = Codebook.of(np.log10(discount * np.diff(third_at) / np.maximum(context_n, 1)))
        for name, values in (("tops", tops), ("words", words), ("after", after), ("after_at", after_at), ("before", before), ("before_at", before_at), ("third", third), ("third_at", third_at)):
            setattr(self, name, EliasFano.of(values.astype(np.uint64)))
        return self

    def seen(self, v: np.ndarray) -> np.ndarray:
        """How often words were seen in training."""
        i = self.tops.find(v)
        return np.where(i >= 0, self.counts[i] if len(self.counts) else 0, 0)

    def score(self, v: np.ndarray, times: np.ndarray, words: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each w's probability after (u, v), and whether neither context knows it: then it lacks that of w alone.

        Each v has the next ``times`` pairs of u and w, which are places in ``words`` and sorted by u; so each v, context
        and word is looked up once. SCORED pairs are looked up at a time.
        """
        if not self.tops.n or not len(u):
            return np.zeros(len(u)), np.ones(len(u), bool)
        known_words = self.words.find(words.astype(np.uint64))
        run, out = np.repeat(np.arange(len(v)), times), []
        for a in range(0, len(u), self.SCORED):
            part = slice(a, a + self.SCORED)
            here = run[part]
            out.append(self._score(v[here[0] : here[-1] + 1], here - here[0], known_words, u[part], w[part]))
        value, open_ = zip(*out, strict=True)
        return np.concatenate(value), np.concatenate(open_)

    def _score(self, v: np.ndarray, run: np.ndarray, known_words: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """score() of some pairs; ``run`` tells the place in v, ``known_words`` where the trie has each word, or -1."""
        top = self.tops.find(v)
        first, last = self._run(self.after_at, top)
        word = known_words[w]
        i = top[run]
        found = np.where((i >= 0) & (word >= 0), i * self.size + word, 0).astype(np.uint64)
        after = self.after.find(found, first[run], last[run])
        after[(i < 0) | (word < 0)] = -1
        pair = np.concatenate([[True], (u[1:] != u[:-1]) | (run[1:] != run[:-1])])
        top, word = i[pair], known_words[u[pair]]
        begin = first
        first, last = self._run(self.before_at, top)
        before = self.before.find(np.where((top >= 0) & (word >= 0), top * self.size + word, 0).astype(np.uint64), first, last)
        before[(top < 0) | (word < 0)] = -1
        first, last = self._run(self.third_at, before)
        each = np.cumsum(pair) - 1
        j = before[each]
        relative = after - begin[run]
        known = (j >= 0) & (after >= 0)
        third = self.third.find(np.where(known, j * self.reach + relative, 0).astype(np.uint64), first[each], last[each])
        third[~known] = -1
        value = np.where(j >= 0, self.before_back.get(np.maximum(j, 0)) if self.before.n else 0.0, 0.0)
        value += np.where(after >= 0, self.after_log.get(np.maximum(after, 0)) if self.after.n else 0.0, np.where(i >= 0, self.back.get(np.maximum(i, 0)), 0.0))
        if self.third.n:
            value = np.where(third >= 0, self.third_log.get(np.maximum(third, 0)), value)
        return value, after < 0

    @staticmethod
    def _run(pointers: EliasFano, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the children of the i-th begin and end; nowhere for -1."""
        has = i >= 0
        first = np.where(has, pointers.get(np.where(has, i, 0)).astype(np.int64), 0)
        return first, np.where(has, pointers.get(np.where(has, i + 1, 0)).astype(np.int64), 0)

    def to_bytes(self) -> bytes:
        sequences, books = {k: getattr(self, k) for k in self.SEQUENCES}, {k: getattr(self, k) for k in self.BOOKS}
        arrays = {f"{k}.{f}": getattr(x, f) for k, x in sequences.items() for f in EliasFano.FIELDS} | {"counts": self.counts}
        arrays |= {f"{k}.{f}": getattr(x, f) for k, x in books.items() for f in ("codes", "values")}
        head = json.dumps({"size": self.size, "reach": self.reach, "n": {k: [x.n, x.width] for k, x in sequences.items()}, "arrays": {k: [str(a.dtype), len(a)] for k, a in arrays.items()}}).encode()
        parts = [len(head).to_bytes(8, "little"), head + b" " * (-len(head) % 8)]
        for a in arrays.values():
            raw = a.tobytes()
            parts.append(raw + b"\0" * (-len(raw) % 8))
        return b"".join(parts)

    @classmethod
    def from_buffer(cls, buffer: np.ndarray) -> Trie:
        """From the bytes of to_bytes(), for example mapped from a file; nothing is copied."""
        self, size = cls(), int.from_bytes(buffer[:8].tobytes(), "little")
        head, at, arrays = json.loads(buffer[8 : 8 + size].tobytes()), 8 + size + -size % 8, {}
        for k, (kind, n) in head["arrays"].items():
            raw = np.dtype(kind).itemsize * n
            arrays[k] = buffer[at : at + raw].view(kind)
            at += raw + -raw % 8
        self.size, self.reach, self.counts = head["size"], head["reach"], arrays["counts"]
        for k in cls.SEQUENCES:
            setattr(self, k, EliasFano(*head["n"][k], *(arrays[f"{k}.{f}"] for f in EliasFano.FIELDS)))
        for k in cls.BOOKS:
            setattr(self, k, Codebook(arrays[f"{k}.codes"], arrays[f"{k}.values"]))
        return self


def _summed(major: np.ndarray, minor: np.ndarray, n: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The distinct pairs in order, with their sums of n; pairs that are so already stay as they are."""
    if ((major[1:] > major[:-1]) | ((major[1:] == major[:-1]) & (minor[1:] > minor[:-1]))).all():
        return (major, minor), n
    order = np.lexsort((minor, major))
    major, minor, n = major[order], minor[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])])) if len(major) else np.zeros(0, np.intp)
    return (major[new], minor[new]), np.add.reduceat(n, new) if len(new) else n
