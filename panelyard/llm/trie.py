"""A two-level n-gram trie in Elias-Fano code: word pairs by context, with quantised log probabilities.

Levels are plain arrays in anonymous memory maps: pages outside the process's heap that go back to the system with
the trie, and no files in a local folder. A monotone sequence keeps the low bits of each value packed
and the high bits in unary, about two bits and the low part per value. Contexts, the pointers to where their
successors begin, and the successors are such sequences. Successors are stored relative to their context: each is
added to the last value of the context before, so the whole level is monotone, and a lookup is a search for one value
between two pointers.
"""

from __future__ import annotations

import mmap

import numpy as np

U64 = np.uint64
#: Log10 probabilities are kept in steps of this size; code 0 is for pairs that are not in the trie.
STEP = 5e-4
DEEPEST = 65535


def quantise(log_probability: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log_probability / STEP) + 1, 1, DEEPEST).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.float64) - 1) * -STEP


def mapped(a: np.ndarray) -> np.ndarray:
    """A read-only copy in a memory map of its own."""
    if not a.nbytes:
        return a
    pages = mmap.mmap(-1, a.nbytes)
    out = np.frombuffer(pages, a.dtype)
    out[:] = a
    out.flags.writeable = False
    return out


class EliasFano:
    """A strictly or weakly monotone sequence of unsigned integers with random access and search."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, n: int, width: int):
        self.low, self.high, self.ones, self.n, self.width = low, high, ones, n, width

    @classmethod
    def write(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1) if n else 0
        low = np.zeros(n * width // 64 + 2, U64)
        if width:
            part = values & U64((1 << width) - 1)
            at = np.arange(n, dtype=np.int64) * width
            word, shift = at >> 6, (at & 63).astype(U64)
            np.bitwise_or.at(low, word, part << shift)
            spill = shift + U64(width) > U64(64)
            np.bitwise_or.at(low, word[spill] + 1, part[spill] >> (U64(64) - shift[spill]))
        place = (values >> U64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(place[-1]) if n else 0) // 64 + 1, U64)
        np.bitwise_or.at(high, place >> 6, U64(1) << (place & 63).astype(U64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return cls(mapped(low), mapped(high), mapped(ones), n, width)

    def _select(self, rank: np.ndarray, ones: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the bit with this rank among ones (or zeros): a word by its directory, then by halving."""
        word = np.searchsorted(ones, rank, "right") - 1
        bits = self.high[np.minimum(word, len(self.high) - 1)]
        if flip:
            bits = ~bits
        left = (rank - ones[word]).astype(np.int64)
        place = np.zeros(len(rank), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count((bits >> place.astype(U64)) & U64((1 << half) - 1)).astype(np.int64)
            more = left >= count
            left -= np.where(more, count, 0)
            place += np.where(more, half, 0)
        return word * 64 + place

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.empty(0, U64)
        high = (self._select(i, self.ones, False) - i).astype(U64) << U64(self.width)
        return high | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(U64)
        value = self.low[word] >> shift
        spill = shift + U64(self.width) > U64(64)
        value[spill] |= self.low[word[spill] + 1] << (U64(64) - shift[spill])
        return value & U64((1 << self.width) - 1)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Position of each value, or -1. Values that share their high bits are neighbours; the search among them is
        over low bits alone."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        zeros = np.arange(len(self.high) + 1, dtype=np.int64) * 64 - self.ones
        high = (x >> U64(self.width)).astype(np.int64)
        ok = np.flatnonzero(high <= int(self.get(np.array([self.n - 1]))[0]) >> self.width)
        h = high[ok]
        # The h-th run of ones lies between two zeros of the unary part.
        begin = np.where(h > 0, self._select(np.maximum(h - 1, 0), zeros, True) - h + 1, 0)
        last = h >= zeros[-1]
        end = np.where(last, self.n, self._select(np.minimum(h, zeros[-1] - 1), zeros, True) - h)
        end = np.minimum(end, self.n)
        low = x[ok] & U64((1 << self.width) - 1) if self.width else np.zeros(len(ok), U64)
        a, b = begin.copy(), end.copy()
        while (open_ := a < b).any():
            at = np.flatnonzero(open_)
            mid = (a[at] + b[at]) >> 1
            less = self._low(mid) < low[at]
            a[at[less]] = mid[less] + 1
            b[at[~less]] = mid[~less]
        inside = np.flatnonzero(a < end)
        hit = inside[self._low(a[inside]) == low[inside]]
        out[ok[hit]] = a[hit]
        return out


class PairTrie:
    """Contexts, pointers, successors, codes."""

    def __init__(self, context: np.ndarray, word: np.ndarray, codes: np.ndarray):
        """From pairs sorted by context and word, without repeats."""
        begin = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.empty(0, np.int64)
        ends = np.r_[begin[1:], len(context)].astype(np.int64)[: len(begin)]
        # Each context's values start behind the last one of the context before it.
        base = np.cumsum(np.r_[0, word[ends - 1].astype(np.int64) + 1])[:-1] if len(begin) else np.empty(0, np.int64)
        relative = word + np.repeat(base.astype(U64), ends - begin)
        self.contexts = EliasFano.write(context[begin])
        self.pointers = EliasFano.write(np.r_[begin, len(context)].astype(U64))
        self.successors = EliasFano.write(relative)
        self.codes = mapped(codes)

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of pairs sorted by context; 0 where a pair is absent."""
        out = np.zeros(len(context), np.uint16)
        if not len(context) or not self.contexts.n:
            return out
        own = np.r_[True, context[1:] != context[:-1]]
        which = np.cumsum(own) - 1
        at = self.contexts.find(context[own])
        known = np.flatnonzero(at >= 0)
        k = at[known]
        begin, end = self.pointers.get(k).astype(np.int64), self.pointers.get(k + 1).astype(np.int64)
        base, top = np.zeros(len(at), U64), np.zeros(len(at), U64)
        later = begin > 0
        base[known[later]] = self.successors.get(begin[later] - 1) + U64(1)
        top[known] = self.successors.get(end - 1)
        value = base[which] + word
        inside = np.flatnonzero((at[which] >= 0) & (value <= top[which]))
        place = self.successors.find(value[inside])
        hit = place >= 0
        out[inside[hit]] = self.codes[place[hit]]
        return out
