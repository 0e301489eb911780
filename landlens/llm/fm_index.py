"""Compressed FM-index over integer symbols: a wavelet matrix of packed bits under the Burrows-Wheeler transform.

Searches run for many patterns side by side: each round takes one backward step for every pattern that is not done.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


class BitVector:
    """Packed bits with a running count per 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        self.words = np.packbits(np.pad(bits, (0, 64 - n % 64)), bitorder="little").view(np.uint64)
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)])
        self.zeros = n - int(self.counts[-1])

    def rank1(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (ONE << (at & 63).astype(np.uint64)) - ONE
        return self.counts[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Rank of any symbol before any place, one bit level at a time."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels = []
        self.shifts = list(range(max(1, int(size - 1).bit_length()) - 1, -1, -1))
        for shift in self.shifts:
            bits = (symbols >> shift) & 1
            self.levels.append(BitVector(bits.astype(bool)))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, level in zip(self.shifts, self.levels, strict=True):
            ones = level.rank1(at)
            at = np.where((symbol >> shift) & 1, level.zeros + ones, at - ones)
        return at


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order of their first ``depth`` symbols at least, and the ranks by 1, 2, 4, ... symbols."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    ranks, reach = [rank], 1
    order = np.argsort(rank, kind="stable")
    while reach < depth:
        after = np.zeros(n, np.int64)
        after[: n - reach] = rank[reach:] + 1
        both = rank * (n + 1) + after
        order = np.argsort(both, kind="stable")
        sorted_ = both[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_[1:] != sorted_[:-1]]))
        reach *= 2
        ranks.append(rank)
    return order, ranks


class FMIndex:
    """Index of a text in which 0 separates the strings; answers patterns of at most ``depth`` symbols."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int) -> None:
        order, ranks = suffix_order(text, depth)
        self.size = len(text)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.tree = WaveletMatrix(text[order - 1], symbols)
        self.origin = self.tree.walk(np.arange(symbols), np.zeros(symbols, np.int64))
        # common prefixes of neighbours, from the ranks by ever fewer symbols
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for power in range(len(ranks) - 1, -1, -1):
            inside = np.maximum(a, b) < self.size
            same = inside & (ranks[power][np.minimum(a, self.size - 1)] == ranks[power][np.minimum(b, self.size - 1)])
            step = same.astype(np.int64) << power
            a, b, common = a + step, b + step, common + step
        self.common = np.concatenate([[0], np.minimum(common, 255), [0]]).astype(np.uint8)
        self.least = [self.common]
        while (1 << len(self.least)) <= len(self.common):
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the suffixes that start with the symbol and go on as those in [low, high)."""
        n = len(symbol)
        ends = self.tree.walk(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.starts[symbol] - self.origin[symbol]
        return ends[:n] + base, ends[n:] + base

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest larger interval, of fewer common symbols, and how many these are."""
        depth = np.maximum(self.common[low], self.common[high])
        for power in range(len(self.least) - 1, -1, -1):
            row, span = self.least[power], 1 << power
            # to the left while everything passed over is at least as deep
            at = low - span + 1
            ok = (at >= 0) & (row[np.clip(at, 0, len(row) - 1)] >= depth) & (depth > 0)
            low = np.where(ok, low - span, low)
            ok = (high + span <= len(self.common)) & (row[np.clip(high, 0, len(row) - 1)] >= depth) & (depth > 0)
            high = np.where(ok, high + span, high)
        whole = depth == 0
        return np.where(whole, 0, np.maximum(low, 0)), np.where(whole, self.size, np.minimum(high, self.size)), depth.astype(np.int64)

    def matching_statistics(self, patterns: np.ndarray, start: np.ndarray, size: np.ndarray, times: int) -> np.ndarray:
        """For each place of each pattern the length of the longest string from there that the text has ``times`` times.

        Pattern i is ``patterns[start[i] : start[i] + size[i]]``; the result is laid out like ``patterns``.
        """
        out = np.zeros(len(patterns), np.int64)
        at = start + size - 1
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.size, np.int64)
        length = np.zeros(len(start), np.int64)
        first = start.copy()
        live = size > 0
        at, low, high, length, first = at[live], low[live], high[live], length[live], first[live]
        while len(at):
            new_low, new_high = self.extend(patterns[at], low, high)
            ok = new_high - new_low >= times
            none = ~ok & (length == 0)
            shrink = ~ok & ~none
            low, high = np.where(ok, new_low, low), np.where(ok, new_high, high)
            length = length + ok
            done = ok | none
            out[at[done]] = length[done]
            at = at - done
            if shrink.any():
                low[shrink], high[shrink], length[shrink] = self.parent(low[shrink], high[shrink])
            live = at >= first
            if not live.all():
                at, low, high, length, first = at[live], low[live], high[live], length[live], first[live]
        return out
