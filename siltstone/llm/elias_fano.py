"""Elias-Fano coding of monotone sequences over memory-mapped words, with searches over many keys at once.

Selects inside a word are done on whole arrays of words: counts of bits of every byte by additions within the word, the
byte by a comparison of all eight at once, the bit by a table.
"""

from __future__ import annotations

import numpy as np

from siltstone.llm.shared import atomic_write

_U = np.uint64
#: Values that are encoded at once.
_AT_ONCE = 1 << 16
_STEP, _TOP = _U(0x0101010101010101), _U(0x8080808080808080)
_PAIRS, _NIBBLES, _BYTES = _U(0x5555555555555555), _U(0x3333333333333333), _U(0x0F0F0F0F0F0F0F0F)


def _places() -> np.ndarray:
    """Place of the k-th set bit of byte b, at k << 8 | b."""
    out = np.zeros((8, 256), np.uint8)
    for b in range(256):
        for k, i in enumerate(i for i in range(8) if b >> i & 1):
            out[k, b] = i
    return out.ravel()


_PLACE = _places()


def select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit, from 0, of each word that has so many."""
    sums = words - (words >> _U(1) & _PAIRS)
    sums = (sums & _NIBBLES) + (sums >> _U(2) & _NIBBLES)
    sums = (sums + (sums >> _U(4)) & _BYTES) * _STEP
    shift = np.bitwise_count(((k * _STEP | _TOP) - sums) & _TOP).astype(np.uint64) << _U(3)
    left = k - ((sums << _U(8)) >> shift & _U(255))
    return (shift + _PLACE[words >> shift & _U(255) | left << _U(8)]).astype(np.int64)


def encode(values: np.ndarray, universe: int) -> list[np.ndarray]:
    """Four uint64 arrays for values in order below `universe`: head (count, low bits, universe, low words), low words,
    high words, and zeros before each high word."""
    n = len(values)
    values = values.astype(np.uint64, copy=False)
    bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
    size = (int(values[-1] >> _U(bits)) if n else 0) + n + 2
    marks = np.zeros((size + 63) // 64 * 64, np.uint8)
    for a in range(0, n, _AT_ONCE):
        own = values[a : a + _AT_ONCE]
        if bits:
            part = own & _U((1 << bits) - 1)
            at = np.arange(a, a + len(own), dtype=np.uint64) * _U(bits)
            word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + _U(bits) > _U(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (_U(64) - shift[over]))
        marks[(own >> _U(bits)).astype(np.int64) + np.arange(a, a + len(own))] = 1
    high = np.packbits(marks, bitorder="little").view(np.uint64)
    zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))]).astype(np.uint64)
    return [np.array([n, bits, universe & (1 << 64) - 1, len(low)], np.uint64), low, high, zeros]


class Sequence:
    """A sequence that encode() made; the arrays may be memory-mapped."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits = int(head[0]), int(head[1])
        self.low_words, self.high, self.zeros = low, high, zeros
        self.ones: np.ndarray | None = None

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * _U(self.bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        got = self.low_words[word] >> shift
        got |= (self.low_words[word + 1] << _U(1)) << (_U(63) - shift)
        return got & _U((1 << self.bits) - 1)

    def select0(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits, from 0; the end where there are fewer."""
        k = k.astype(np.uint64)
        word = np.searchsorted(self.zeros, k, "right") - 1
        last = len(self.high) - 1
        if len(word) and word.max() > last:
            return np.where(word > last, (last + 1) * 64, self.select0(np.minimum(k, self.zeros[-1] - _U(1)))) if self.zeros[-1] else np.full(len(k), (last + 1) * 64)
        return word * 64 + select(~self.high[word], k - self.zeros[word])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1. Keys in order are found fastest."""
        out = np.full(len(keys), -1, np.int64)
        if not self.n or not len(keys):
            return out
        keys = keys.astype(np.uint64)
        top = (keys >> _U(self.bits)).astype(np.int64)
        some = np.flatnonzero(top < len(self.high) * 64)
        if len(some) < len(keys):
            keys, top = keys[some], top[some]
        low = keys & _U((1 << self.bits) - 1) if self.bits else np.zeros(len(keys), np.uint64)
        at = np.where(top > 0, self.select0(np.maximum(top - 1, 0)) + 1, 0)  # where the ones of these high bits begin
        begin = at - top
        # How many ones follow: from the 64 bits from here on; where they are all ones, by another select.
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        inside = word < len(self.high)
        word = np.where(inside, word, 0)
        bits = np.where(inside, self.high[word], _U(0)) >> shift
        bits |= np.where(word + 1 < len(self.high), self.high[np.minimum(word + 1, len(self.high) - 1)], _U(0)) << _U(1) << (_U(63) - shift)
        run = np.bitwise_count(bits ^ (bits + _U(1))).astype(np.int64) - 1
        long = np.flatnonzero(run >= 63)
        end = begin + run
        if len(long):
            end[long] = self.select0(top[long]) - top[long]
        end = np.minimum(end, self.n)
        open_ = np.flatnonzero(begin < end)
        lo, hi, low = begin[open_], end[open_], low[open_]
        # Successor search among the few values that share a key's high bits, by halves.
        while len(open_):
            mid = (lo + hi) >> 1
            got = self.low(mid)
            hit = got == low
            out[some[open_[hit]]] = mid[hit]
            less = got < low
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            more = np.flatnonzero(~hit & (lo < hi))
            open_, lo, hi, low = open_[more], lo[more], hi[more], low[more]
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        if self.ones is None:
            self.ones = np.arange(len(self.high), dtype=np.uint64) * _U(64) - self.zeros[:-1]
        k = i.astype(np.uint64)
        word = np.searchsorted(self.ones, k, "right") - 1
        place = word * 64 + select(self.high[word], k - self.ones[word])
        return ((place - i).astype(np.uint64) << _U(self.bits)) | self.low(i)


def sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts[order], starts)


def save(path: str, arrays: list[np.ndarray]) -> None:
    """Arrays as 8-byte words in one file, behind a table of their places."""
    packed = [np.ascontiguousarray(a).tobytes() for a in arrays]
    packed = [p + bytes(-len(p) % 8) for p in packed]
    starts = np.cumsum([0, *(len(p) for p in packed)])[:-1] // 8
    head = np.array([len(arrays), *(x for s, a in zip(starts, arrays, strict=True) for x in (s, a.size, a.dtype.itemsize))], "<u8")
    atomic_write(path, [head.tobytes(), *packed])


def load(path: str) -> list[np.ndarray]:
    """Memory-mapped arrays of unsigned integers of a file that save() wrote."""
    words = np.memmap(path, "<u8", "r").view(np.ndarray)  # a plain view of the mapping
    n = int(words[0])
    out = []
    for k in range(n):
        start, size, width = (int(x) for x in words[1 + 3 * k : 4 + 3 * k])
        start += 1 + 3 * n
        out.append(words[start : start + (size * width + 7) // 8].view(f"<u{width}")[:size])
    return out
