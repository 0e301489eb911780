"""Substring dedup by word windows with a compressed FM-index per shard.

Documents are streamed through the shards that can hold their windows (``anchors``). Each shard indexes its distinct strings;
backward search over the wavelet matrix gives, for every place of every string, the longest match that occurs at least
twice, and windows whose matching statistic reaches the threshold are reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from landlens.llm.anchors import Block, Scale, Sent, Windows, judge, ranges
from landlens.llm.fm_index import FMIndex

WINDOW = 35
GRAM = 12
#: Words per index; strings with one key always meet in one index.
INDEX_WORDS = 1 << 18


def occurrences(sent: Sent, ids: np.ndarray) -> np.ndarray:
    """How often each distinct run occurs in the chunk, 2 standing for more."""
    return np.minimum(np.bincount(sent.which, minlength=len(sent.windows)), 2).astype(np.int64)


def repeated_windows(strings: list[list[bytes]], times: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string, which of its windows occur twice or more among all of them (``times`` occurrences each)."""
    ids: dict[bytes, int] = {}
    flat = np.array([ids.setdefault(w, len(ids) + 1) for s in strings for w in s], np.int64)
    size = np.array([len(s) for s in strings], np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    # a string that occurs more than once is in the text twice, each copy closed by a separator
    copies = np.repeat(np.arange(len(strings)), np.minimum(times, 2))
    text = np.zeros(int(size[copies].sum() + len(copies)), np.int64)
    place = np.concatenate([[0], np.cumsum(size[copies] + 1)[:-1]])
    text[ranges(place, size[copies])] = flat[ranges(start[copies], size[copies])]
    index = FMIndex(text, len(ids) + 1, 2 * window)
    found = index.matching_statistics(flat, start, size, 2) >= window
    return [found[a : a + n - window + 1] for a, n in zip(start, size, strict=True)]


def index_shard(table: pa.Table) -> list[tuple[bytes, bytes]]:
    """Bits of the windows of each question, in the order in which the strings were sent."""
    strings, keys, times, owner = [], [], [], []
    numbers: dict[tuple[int, bytes], int] = {}
    data, extra, key = (table.column(c).to_pylist() for c in ("data", "extra", "keys"))
    for d, x, k in zip(data, extra, key, strict=True):
        mine = []
        for s, n, own in zip(d.split(b"\n"), np.frombuffer(x, np.int64), np.frombuffer(k, np.uint64).tolist(), strict=True):
            at = numbers.setdefault((own, s), len(strings))
            if at == len(strings):
                strings.append(s), keys.append(own), times.append(0)
            times[at] += int(n)
            mine.append(at)
        owner.append(mine)
    result: list[np.ndarray] = [np.zeros(0, bool)] * len(strings)
    order = np.argsort(np.array(keys, np.uint64), kind="stable")
    ranked = np.array(keys, np.uint64)[order]
    edge = np.concatenate([[True], ranked[1:] != ranked[:-1], [True]])
    rest = []
    for i, alone in zip(order.tolist(), edge[1:] & edge[:-1], strict=False):
        # a window that has its key for itself occurs as often as it was sent
        if alone and strings[i].count(b" ") + 1 == WINDOW:
            result[i] = np.array([times[i] > 1])
        else:
            rest.append(i)
    batch: list[int] = []
    words = 0
    for k, i in enumerate(rest):
        batch.append(i)
        words += strings[i].count(b" ") + 1
        closing = k + 1 == len(rest) or keys[rest[k + 1]] != keys[i]
        if closing and (words >= INDEX_WORDS or k + 1 == len(rest)):
            split = [strings[j].split(b" ") for j in batch]
            for j, bits in zip(batch, repeated_windows(split, np.array([times[j] for j in batch]), WINDOW), strict=True):
                result[j] = bits
            batch, words = [], 0
    return [(np.packbits(np.concatenate([result[i] for i in mine])).tobytes(), b"") for mine in owner]


def cut_words(table: pa.Table, texts: list[bytes], found: list[Block], sent: Sent, answers: list[dict]) -> pa.Table:
    """The documents of a chunk without the words that a repeated window covers."""
    edges = np.concatenate([[0], np.cumsum(sent.windows)])
    flags = np.zeros(int(edges[-1]), bool)
    bounds = np.searchsorted(sent.shard, [a["part"] for a in answers]), np.searchsorted(sent.shard, [a["part"] for a in answers], "right")
    for a, lo, hi in zip(answers, *bounds, strict=True):
        n = int(edges[hi] - edges[lo])
        flags[edges[lo] : edges[hi]] = np.unpackbits(np.frombuffer(a["answer"], np.uint8), count=n).astype(bool)
    covered = cover(found, sent, flags[ranges(edges[sent.which], sent.windows[sent.which])], WINDOW, len(texts))
    kept, n_words, n_removed, spans = [], [], [], []
    for row, text in enumerate(texts):
        words = text.split()
        gone = np.zeros(len(words), bool)
        for base, bits in covered.get(row, ()):
            gone[base : base + len(bits)] |= bits
        cuts = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        left, at = [], 0
        for a, b in zip(cuts[::2].tolist(), cuts[1::2].tolist(), strict=True):
            left += words[at:a]
            at = b
        left += words[at:]
        kept.append(b" ".join(left).decode("utf-8", "replace"))
        n_words.append(len(words)), n_removed.append(int(gone.sum())), spans.append(cuts.astype(np.int64))
    return pa.table({
        "doc_id": table.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
        "removed": pa.array(spans, pa.list_(pa.int64())), "kept": pa.array(kept, pa.string()),
    })


def cover(found: list[Block], sent: Sent, hit: np.ndarray, window: int, rows: int) -> dict[int, list[tuple[int, np.ndarray]]]:
    """Covered symbols by row: pairs (first symbol of a part, bits). ``hit``: per window of each occurrence."""
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    count = sent.windows[sent.which]
    ends = np.cumsum(count)
    for number, b in enumerate(found):
        mine = np.flatnonzero(sent.block == number)
        if not len(mine):
            continue
        starts = ranges(sent.start[mine], count[mine])[hit[ranges(ends[mine] - count[mine], count[mine])]]
        if not len(starts):
            continue
        change = np.zeros(int(b.size.sum()) + 1, np.int32)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + window, -1)
        bits = np.cumsum(change)[:-1] > 0
        edges = np.concatenate([[0], np.cumsum(b.size)])
        for part in np.unique(b.part_of(starts)):
            out.setdefault(int(b.rows[part]), []).append((int(b.base[part]), bits[edges[part] : edges[part + 1]]))
    return out


def substring_dedup(docs: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Each document without the words that lie in a window of 35 words which occurs anywhere else, itself included.

    Columns used: doc_id (integer), text; others are ignored. ``docs`` must give the same rows when read again. Null text: no
    words. Repeated rows are documents of their own, so their windows repeat; a null doc_id is an id like any other. Texts
    shorter than a window are kept whole. Empty input gives no rows.
    Returns doc_id, n_words, n_removed, removed (word numbers: start, end, start, end, ...), kept (text).
    """
    return judge(
        docs, Windows("word", WINDOW, GRAM, 1), occurrences, index_shard, cut_words,
        "doc_id long, n_words long, n_removed long, removed array<long>, kept string",
        scale,
    )
