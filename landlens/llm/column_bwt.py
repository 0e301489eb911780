"""Burrows-Wheeler transform and common prefixes of a string collection, column by column.

All strings are right-aligned. Round t puts, for each string, the suffix of t + 1 symbols into the sorted list of the suffixes
so far; only three lists are kept, as sequential files that each round reads and rewrites from front to back: the symbol before
each suffix (the transform), the common prefix with the suffix before it, and which suffix it is. Where a suffix goes
follows from the transform alone; its common prefix is one more than the least over the stretch between it and the previous
occurrence of its first symbol.
"""

from __future__ import annotations

import numpy as np

#: In a mark, the suffix length takes this many bits.
LENGTH_BITS = 9


#: Least values are kept for stretches of up to 2 ** this many places; longer ones go through blocks of that many.
LEVELS = 6


def least_between(common: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(common[low .. high]) for each pair."""
    if not len(low):
        return np.zeros(0, common.dtype)
    span = high - low + 1
    block = 1 << LEVELS
    # the largest power of two in each span; spans of two blocks and more look at their two ends and the blocks between
    power = np.minimum(np.frexp(span.astype(np.float64))[1] - 1, LEVELS + 1)
    order = np.argsort(power.astype(np.uint8), kind="stable")
    edges = np.searchsorted(power[order], np.arange(LEVELS + 3))
    out = np.empty(len(low), common.dtype)
    row = common
    for p in range(int(power.max()) + 1):
        if 0 < p <= LEVELS:
            half = 1 << (p - 1)
            row = np.minimum(row[:-half], row[half:])
        mine = order[edges[p] : edges[p + 1]]
        if len(mine):
            width = min(1 << p, block)
            out[mine] = np.minimum(row[low[mine]], row[high[mine] - width + 1])
            if p > LEVELS:
                between = least_between(row[::block], -(-low[mine] // block), (high[mine] + 1) // block - 1)
                out[mine] = np.minimum(out[mine], between)
    return out


def collection_bwt(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, common prefix with the predecessor) of all suffixes in order.

    ``flat``: the strings one after another, uint16 symbols from 1 (0 stands for the start of a string); none is empty.
    """
    n = len(size)
    last = np.cumsum(size) - 1
    before = flat[last]
    common = np.zeros(n, np.uint8 if int(size.max()) < 250 else np.uint16)
    if int(size.max()) >= 1 << LENGTH_BITS:
        raise ValueError("a string is too long for this collection")
    marks = np.arange(n, dtype=np.int32 if n < 1 << (31 - LENGTH_BITS) else np.int64) << LENGTH_BITS
    place = np.arange(n)
    live = np.arange(n)
    for t in range(int(size.max())):
        order = np.argsort(before, kind="stable")
        order = order[np.searchsorted(before[order[: n + 1]], 0, side="right") :]
        new = np.zeros(len(before), bool)
        new[place] = True
        put = np.flatnonzero(new[order])
        here = order[put]
        symbol = before[here]

        previous = order[np.maximum(put - 1, 0)]
        follows = (put > 0) & (before[previous] == symbol)
        end = put + 1 == len(order)
        following = order[np.minimum(put + 1, len(order) - 1)]
        leads = ~end & (before[following] == symbol)
        least = 1 + least_between(
            common, np.concatenate([previous[follows], here[leads]]) + 1, np.concatenate([here[follows], following[leads]])
        )
        own, after = np.zeros(len(put), common.dtype), np.zeros(len(put), common.dtype)
        own[follows], after[leads] = least[: follows.sum()], least[follows.sum() :]

        string = marks[here] >> LENGTH_BITS
        target = n + put
        old = np.ones(len(before) + len(put), bool)
        old[target] = False
        at = last[string] - t - 1
        ahead = np.where(size[string] > t + 1, flat[np.maximum(at, 0)], 0).astype(flat.dtype)
        # everything between two insertions moves by as many places as came before it
        rewritten = []
        for now, fresh in ((before, ahead), (common, own), (marks, marks[here] + 1)):
            file = np.empty(len(old), now.dtype)
            file[old], file[target] = now, fresh
            rewritten.append(file)
        before, common, marks = rewritten
        inner = ~end
        common[target[inner] + 1] = after[inner]
        live = size[string] > t + 1
        place = target[live]
        if not len(place):
            break
    return marks >> LENGTH_BITS, marks & ((1 << LENGTH_BITS) - 1), common
