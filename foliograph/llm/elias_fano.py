"""Elias-Fano sequences and a level of an n-gram trie over them, in memory-mapped files."""

from __future__ import annotations

import numpy as np

_GROUP, _CHUNK = 8, 1 << 16  # words of the unary part for each count of ones; queries that are worked on at once


class EliasFano:
    """A non-decreasing sequence of integers below 2**64. The low bits are packed without gaps, the high parts lie in a unary bit vector
    with a count of ones for each 512 bits. `folder/name.*` hold the arrays, which are read through memory maps."""

    def __init__(self, folder: str, name: str, values: np.ndarray, universe: int) -> None:
        v, n = values.astype(np.uint64), values.size
        self.n, self.width = n, max(0, (universe // max(1, n)).bit_length() - 1)
        self.shift, self.mask = np.uint64(self.width), np.uint64((1 << self.width) - 1)
        high = (v >> self.shift).astype(np.int64)
        self.buckets = int(high[-1]) + 1 if n else 0
        unary = np.zeros(-(-(n + self.buckets + 1) // (64 * _GROUP)) * 64 * _GROUP, bool)
        unary[high + np.arange(n)] = True
        words = np.packbits(unary, bitorder="little").view(np.uint64)
        ones = np.append(0, np.cumsum(np.bitwise_count(words).astype(np.int64)))[::_GROUP].astype(np.uint32)
        self.low, self.words, self.ones = (self._mapped(f"{folder}/{name}.{k}", a) for k, a in (("low", self._packed(v & self.mask)), ("high", words), ("ones", ones)))

    def _packed(self, low: np.ndarray) -> np.ndarray:
        """The low bits one after the other in 64-bit words, and one word more."""
        steps = np.arange(self.width, dtype=np.uint64)
        rows = 64 * max(1, _CHUNK // 64)  # a multiple of 64, so that each part fills whole bytes
        parts = [np.packbits(((low[i : i + rows, None] >> steps) & np.uint64(1)).astype(np.uint8), bitorder="little") for i in range(0, low.size, rows)] if self.width else []
        raw = np.concatenate([*parts, np.zeros(16, np.uint8)])
        return raw[: raw.size // 8 * 8].view(np.uint64)

    @staticmethod
    def _mapped(path: str, a: np.ndarray) -> np.ndarray:
        np.save(path, a)
        return np.load(path + ".npy", mmap_mode="r" if a.size else None)

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th (from 0) one or zero of the unary part."""
        out = np.empty(k.size, np.int64)
        ones = self.ones.astype(np.int64)
        before = ones if bit else np.arange(ones.size) * 64 * _GROUP - ones
        groups = self.words.reshape(-1, _GROUP)
        for at in range(0, k.size, _CHUNK):
            part = k[at : at + _CHUNK]
            g = np.searchsorted(before, part, side="right") - 1
            words = groups[g] if bit else ~groups[g]
            rest = part - before[g]
            sums = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
            w = (sums <= rest[:, None]).sum(axis=1)
            rest -= np.where(w > 0, np.take_along_axis(sums, np.maximum(w - 1, 0)[:, None], 1)[:, 0], 0)
            bits = np.unpackbits(np.take_along_axis(words, w[:, None], 1).astype("<u8").view(np.uint8), axis=1, bitorder="little")
            out[at : at + _CHUNK] = (g * _GROUP + w) * 64 + (np.cumsum(bits, axis=1, dtype=np.uint8) == (rest + 1)[:, None]).argmax(axis=1)
        return out

    def _start(self, bucket: np.ndarray) -> np.ndarray:
        """Index of the first element whose high part is at least `bucket`."""
        out = np.zeros(bucket.size, np.int64)
        out[bucket >= self.buckets] = self.n
        at = np.flatnonzero((bucket > 0) & (bucket < self.buckets))
        out[at] = self._select(bucket[at] - 1, 0) - (bucket[at] - 1)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(i.size, np.uint64)
        bit = i.astype(np.uint64) * self.shift
        word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        over = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (self.low[word] >> off | over) & self.mask

    def get(self, i: np.ndarray) -> np.ndarray:
        """Elements at the given indexes."""
        return ((self._select(i, 1) - i).astype(np.uint64) << self.shift) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the index of the first element not below it within [first, last), and whether it equals x."""
        high = (x >> self.shift).astype(np.int64)
        some, at = np.unique(high, return_inverse=True)
        a, b = np.maximum(first, self._start(some)[at]), np.minimum(last, self._start(some + 1)[at])
        b = np.maximum(a, b)
        want, end = x & self.mask, b.copy()
        live = np.flatnonzero(a < b)
        while live.size:
            mid = (a[live] + b[live]) >> 1
            below = self._low(mid) < want[live]
            a[live] = np.where(below, mid + 1, a[live])
            b[live] = np.where(below, b[live], mid)
            live = live[a[live] < b[live]]
        equal = np.zeros(x.size, bool)
        inside = np.flatnonzero(a < end)
        equal[inside] = self._low(a[inside]) == want[inside]
        return a, equal


class Level:
    """The successors of numbered contexts, with one byte for each. Monotone pointers lead from a context to its successors; their numbers,
    which count from 0 in every context, are made monotone by the sum of the spans of the contexts before."""

    def __init__(self, folder: str, context: np.ndarray, word: np.ndarray, code: np.ndarray, spans: np.ndarray) -> None:
        """context, word: numbers of each n-gram, sorted by both; word is below the span of its context."""
        self.base = np.append(0, np.cumsum(spans))
        self.first = np.append(0, np.cumsum(np.bincount(context, minlength=spans.size)))
        self.pointers = EliasFano(folder, "pointers", self.first, context.size + 1)
        self.offsets = EliasFano(folder, "offsets", self.base, int(self.base[-1]) + 1)
        self.keys = EliasFano(folder, "keys", self.base[context] + word, max(1, int(self.base[-1])))
        self.code = EliasFano._mapped(f"{folder}/codes", code)
        del self.base, self.first

    def begin(self, context: np.ndarray) -> np.ndarray:
        """Index of the first successor of each context."""
        return self.pointers.get(context).astype(np.int64)

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and code of n-grams; code 0 where there is none."""
        out = np.zeros(context.size, np.uint8)
        if not self.keys.n:
            return out.astype(np.int64), out
        some, at = np.unique(context, return_inverse=True)
        first, last, base = self.begin(some)[at], self.begin(some + 1)[at], self.offsets.get(some)[at]
        i, found = self.keys.successor(base + word.astype(np.uint64), first, last)
        out[found] = self.code[i[found]]
        return i, out
