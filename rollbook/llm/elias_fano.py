"""Elias-Fano sequences in NumPy: compact increasing integers with vectorised access and successor search."""

from __future__ import annotations

import numpy as np


def _get_bits(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """`width` bits (up to 63) from each bit position; the array has a spare word behind."""
    if width == 0:
        return np.zeros(len(at), np.uint64)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    low = words[word] >> shift
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (low | high) & np.uint64((1 << width) - 1)


def _select(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the `rank`-th (from 1) set bit of each word."""
    rest, place, left = rank.astype(np.int64), np.zeros(len(words), np.int64), words.copy()
    for width in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(left & np.uint64((1 << width) - 1)).astype(np.int64)
        beyond = rest > ones
        rest -= np.where(beyond, ones, 0)
        place += np.where(beyond, width, 0)
        left = np.where(beyond, left >> np.uint64(width), left)
    return place


class EliasFano:
    """An increasing sequence: low bits packed, high bits in unary with a directory of zeros and ones per word."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = ""):
        self.size, self.width, self.top = (int(v) for v in arrays[f"{prefix}shape"])
        self.low, self.high, self.ones = (arrays[f"{prefix}{name}"] for name in ("low", "high", "ones"))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def build(values: np.ndarray, prefix: str = "") -> dict[str, np.ndarray]:
        """Arrays of a non-decreasing sequence of non-negative integers."""
        values = values.astype(np.uint64)
        count = len(values)
        top = int(values[-1]) if count else 0
        width = max(0, (top // max(count, 1)).bit_length() - 1)
        low_words = np.zeros(count * width // 64 + 2, np.uint64)
        if width:
            low = values & np.uint64((1 << width) - 1)
            at = np.arange(count, dtype=np.int64) * width
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low_words, word, low << shift)
            over = (shift + np.uint64(width)) > 64
            np.bitwise_or.at(low_words, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        bits = (values >> np.uint64(width)).astype(np.int64) + np.arange(count)
        total = (top >> width) + count + 1
        high = np.zeros(total // 64 + 1, np.uint64)
        np.bitwise_or.at(high, bits >> 6, np.uint64(1) << (bits & 63).astype(np.uint64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high).astype(np.int64))])
        shape = np.array([count, width, top], np.int64)
        return {f"{prefix}shape": shape, f"{prefix}low": low_words, f"{prefix}high": high, f"{prefix}ones": ones}

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        index = np.asarray(index, np.int64)
        word = np.searchsorted(self.ones, index, "right") - 1
        place = _select(self.high[word], index + 1 - self.ones[word])
        high = (word * 64 + place - index).astype(np.uint64)
        return (high << np.uint64(self.width)) | _get_bits(self.low, index * self.width, self.width)

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        """Bit position of the `rank`-th zero, from 1."""
        word = np.searchsorted(self.zeros, rank, "left") - 1
        return word * 64 + _select(~self.high[word], rank - self.zeros[word])

    def successor(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first value not below each target (size if none), and whether it equals the target."""
        targets = np.asarray(targets, np.uint64)
        place, same = np.full(len(targets), self.size, np.int64), np.zeros(len(targets), bool)
        inside = np.flatnonzero(targets <= np.uint64(self.top)) if self.size else np.zeros(0, np.int64)
        if not len(inside):
            return place, same
        wanted = targets[inside]
        bucket = (wanted >> np.uint64(self.width)).astype(np.int64)
        low = wanted & np.uint64((1 << self.width) - 1)
        begin = np.zeros(len(wanted), np.int64)
        later = bucket > 0
        begin[later] = self._zero(bucket[later]) + 1 - bucket[later]
        end = self._zero(bucket + 1) - bucket
        first, last = begin.copy(), end.copy()
        active = np.flatnonzero(first < last)
        while len(active):
            middle = (first[active] + last[active]) >> 1
            less = _get_bits(self.low, middle * self.width, self.width) < low[active]
            first[active] = np.where(less, middle + 1, first[active])
            last[active] = np.where(less, last[active], middle)
            active = active[first[active] < last[active]]
        held = np.flatnonzero(first < end)
        equal = np.zeros(len(wanted), bool)
        equal[held] = _get_bits(self.low, first[held] * self.width, self.width) == low[held]
        place[inside], same[inside] = first, equal
        return place, same
