"""Content-defined shards: brings equal windows of all documents together without moving whole texts to every shard.

Each window of ``window`` symbols (bytes or words) has an anchor: the leftmost smallest of its ``gram``-symbol hashes. Equal
windows have equal anchors, so

1. every chunk of documents asks which of its anchors occur again anywhere (hashes only; most do not),
2. runs of windows around a repeated anchor are sent, once per chunk and content, to the shard of that anchor,
3. the shard, which holds all windows with its anchors, answers for each window, and
4. the chunk applies the answers to its documents.

An anchor met by very many different runs is split: its windows are grouped by the place of the anchor in the window and
sharded by what all windows of such a group contain. Chunks, hash buckets and shards follow the size of the input, and
the 32-bit anchor prints within a bucket can only add candidates, which the shards then compare by content.
``suffix_dedup`` takes anchors and runs from here and has steps of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlens.llm.common import text_bytes
from landlens.session import cut_lineage

MASK24 = np.uint64((1 << 24) - 1)
#: Symbols per block of hashing; a longer document is hashed in overlapping blocks.
BLOCK = 1 << 17
#: Windows per group where an anchor is split.
GROUP = 4
NO_DOC = np.iinfo(np.int64).max

_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_HASH = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_MUL, _INV)):
            with np.errstate(over="ignore"):
                _powers[i] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base)]), dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Running polynomial sums, from which the hash of any stretch follows."""
    up, _ = powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=sums[1:])
    return sums


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start])


def gram_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all stretches of one size, in one reused array."""
    x = sums[size:] - sums[:-size]
    x *= powers(len(sums))[1][: len(x)]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers start[i] .. start[i] + count[i] - 1, one after another."""
    if not len(count):
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(ends[-1]) - np.repeat(ends - count - start, count)


@dataclass(frozen=True)
class Windows:
    """``unit``: "byte" or "word" (runs of characters other than space and 9 to 13)."""

    unit: str
    window: int
    gram: int
    #: Windows per group where an anchor is split. With one, all strings of a group are equal and travel once per chunk.
    group: int = GROUP

    @property
    def width(self) -> int:
        return self.window - self.gram + 1


@dataclass(frozen=True)
class Scale:
    """Bytes of text per chunk of documents, per bucket of anchors and per shard; occurrences from which an anchor is split."""

    chunk: int = 4 << 20
    bucket: int = 4 << 20
    shard: int = 4 << 20
    hot: int = 200


@dataclass
class Block:
    """Symbols of some documents, one after another, and the runs of windows with one anchor."""

    rows: np.ndarray  # row of each part, its first symbol within the document, its size
    base: np.ndarray
    size: np.ndarray
    sums: np.ndarray
    start: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    anchor: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    key: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    text: object = None  # bytes, or the list of words

    def part_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.cumsum(self.size), at, side="right")


def word_hashes(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    return stretch(prefix(BYTE_HASH[b]), start, end) if len(start) else np.zeros(0, np.uint64)


def find_runs(block: Block, how: Windows) -> Block:
    n = len(block.sums) - 1
    if n < how.window:
        return block
    grams = gram_hashes(block.sums, how.gram)
    ranked = grams & ~MASK24
    ranked |= np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(ranked, how.width)
    anchor = (least & MASK24).astype(np.int64)
    ends = np.cumsum(block.size)
    # windows that cross the end of a document belong to none; a run ends before them
    low = np.maximum(ends - how.window + 1, ends - block.size)
    bad = ranges(low, ends - low)
    good = np.ones(len(anchor) + how.window, bool)
    good[bad] = False
    good = good[: len(anchor)]
    turn = np.ones(len(anchor) + 1, bool)
    np.not_equal(anchor[1:], anchor[:-1], out=turn[1:-1])
    turn[1:-1] |= good[1:] != good[:-1]
    edge = np.flatnonzero(turn)
    start, count = edge[:-1], np.diff(edge)
    start, count = start[good[start]], count[good[start]]
    block.start, block.count = start, count
    block.anchor = anchor[start]
    block.key = grams[block.anchor]
    return block


def blocks(texts: list[bytes], how: Windows, keep_text: bool) -> Iterator[Block]:
    """The documents of a chunk in blocks of bounded size."""
    rows, base, size, parts, kept, total = [], [], [], [], [], 0

    def flush() -> Iterator[Block]:
        nonlocal rows, base, size, parts, kept, total
        if rows:
            with np.errstate(over="ignore"):
                sums = prefix(np.concatenate(parts))
            text = None if not keep_text else b"".join(kept) if how.unit == "byte" else [w for x in kept for w in x]
            yield find_runs(Block(np.array(rows), np.array(base), np.array(size), sums, text=text), how)
        rows, base, size, parts, kept, total = [], [], [], [], [], 0

    for row, text in enumerate(texts):
        if how.unit == "byte":
            symbols, words = BYTE_HASH[np.frombuffer(text, np.uint8)], text
        else:
            with np.errstate(over="ignore"):
                symbols = word_hashes(text)
            words = text.split() if keep_text else None
        at = 0
        while at == 0 or at + how.window <= len(symbols):
            part = symbols[at : at + BLOCK + how.window - 1]
            if total + len(part) > BLOCK:
                yield from flush()
            rows.append(row), base.append(at), size.append(len(part)), parts.append(part)
            if keep_text:
                kept.append(words[at : at + len(part)])
            total += len(part)
            at += BLOCK
    yield from flush()


@dataclass
class Asked:
    """Distinct anchors of a chunk, in the order that questions and answers share."""

    bucket: np.ndarray
    prints: np.ndarray
    counts: np.ndarray
    which: np.ndarray  # for each run of each block, one after another: its anchor's number


def ask(all_blocks: list[Block], buckets: int) -> Asked:
    keys = np.concatenate([b.key for b in all_blocks] or [np.zeros(0, np.uint64)])
    packed = (((keys >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
    distinct, which, counts = np.unique(packed, return_inverse=True, return_counts=True)
    return Asked((distinct >> np.uint64(32)).astype(np.int64), (distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts, which)


def by_group(group: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of equal values of a sorted array."""
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(group[a]), slice(int(a), int(b))


def count_anchors(table: pa.Table, hot: int) -> pa.Table:
    """For each question: 0 an anchor met once, 1 met again, 2 met so often that it is split."""
    prints = [np.frombuffer(x, np.uint32) for x in table.column("prints").to_pylist()]
    counts = [np.frombuffer(x, np.uint16) for x in table.column("counts").to_pylist()]
    distinct, which = np.unique(np.concatenate(prints), return_inverse=True)
    total = np.bincount(which, weights=np.concatenate(counts), minlength=len(distinct))
    kind = ((total >= 2).astype(np.uint8) + (total >= hot))[which]
    edges = np.cumsum([0, *map(len, prints)])
    return pa.table({
        "chunk": table.column("chunk"), "part": table.column("bucket"),
        "answer": pa.array([kind[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary()),
        "runs": pa.nulls(len(prints), pa.binary()),
    })


@dataclass
class Sent:
    """Distinct runs of a chunk in canonical order, and every occurrence."""

    shard: np.ndarray
    key: np.ndarray
    windows: np.ndarray
    left: np.ndarray  # symbols before the anchor
    text: list[bytes]
    which: np.ndarray  # per occurrence: number of its run
    block: np.ndarray
    start: np.ndarray
    row: np.ndarray


def runs_to_send(all_blocks: list[Block], asked: Asked, kinds: np.ndarray, how: Windows, shards: int, texts: bool) -> Sent:
    kind = kinds[asked.which] if len(asked.which) else np.zeros(0, np.uint8)
    cols: list[tuple[np.ndarray, ...]] = []
    at = 0
    for number, b in enumerate(all_blocks):
        mine = kind[at : at + len(b.key)]
        at += len(b.key)
        plain = np.flatnonzero(mine == 1)
        start, count, anchor, key = (x[plain] for x in (b.start, b.count, b.anchor, b.key))
        hot = np.flatnonzero(mine == 2)
        if len(hot):
            starts = ranges(b.start[hot], b.count[hot])
            of = np.repeat(hot, b.count[hot])
            group = (b.anchor[of] - starts) // how.group
            edge = np.concatenate([[True], (group[1:] != group[:-1]) | (of[1:] != of[:-1])])
            heads = np.flatnonzero(edge)
            sizes = np.diff(np.append(heads, len(starts)))
            owner, g = of[heads], group[heads]
            lo = b.anchor[owner] - how.group * g
            # what every window of the group holds, whether or not all of them exist in this document
            with np.errstate(over="ignore"):
                core = stretch(b.sums, lo, lo - how.group + 1 + how.window) + b.key[owner] + g.astype(np.uint64)
            start, count = np.concatenate([start, starts[heads]]), np.concatenate([count, sizes])
            anchor, key = np.concatenate([anchor, b.anchor[owner]]), np.concatenate([key, mixed(core)])
        with np.errstate(over="ignore"):
            content = stretch(b.sums, start, start + count + how.window - 1)
        cols.append((np.full(len(start), number), start, count, anchor - start, key, content))
    block, start, count, left, key, content = (np.concatenate(c) for c in zip(*cols, strict=True)) if cols else [np.zeros(0, np.int64)] * 6
    shard = (mixed(key.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((count, left, content, key, shard))
    same = np.ones(len(order), bool)
    same[:1] = False
    for x in (shard, key, content, left, count):
        same[1:] &= x[order][1:] == x[order][:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(~same) - 1 if len(order) else 0
    lead = order[~same]
    text = []
    if texts:
        for i in lead:
            b, a, e = all_blocks[block[i]], int(start[i]), int(start[i] + count[i] + how.window - 1)
            text.append(b.text[a:e] if how.unit == "byte" else b" ".join(b.text[a:e]))
    row = np.zeros(len(start), np.int64)
    for number, b in enumerate(all_blocks):
        mine = block == number
        row[mine] = b.rows[b.part_of(start[mine])]
    return Sent(shard[lead], key[lead], count[lead], left[lead], text, which, block, start, row)


def answers_by_part(table: pa.Table, kind: str) -> list[dict]:
    return [r for r in sorted(table.to_pylist(), key=lambda r: r["part"]) if (r["runs"] is None) == (kind == "anchors")]


def texts_of(table: pa.Table) -> list[bytes]:
    return [x or b"" for x in table.column("text").cast(pa.large_binary()).to_pylist()]


def ids_of(table: pa.Table) -> np.ndarray:
    """Document ids; null counts as larger than any."""
    return table.column("doc_id").cast(pa.int64()).fill_null(NO_DOC).to_numpy()


def judge(
    docs: DataFrame,
    how: Windows,
    extra: Callable[[Sent, np.ndarray], np.ndarray],
    shard_answer: Callable[[pa.Table], list[tuple[bytes, bytes]]],
    finish: Callable[[pa.Table, list[bytes], list[Block], Sent, list[dict]], pa.Table],
    schema: str,
    scale: Scale,
) -> DataFrame:
    """Runs the four steps; ``docs`` has doc_id and text and must give the same rows when read again (a table).

    ``extra``: an int64 per distinct run of a chunk; ``shard_answer``: answers for the questions of one shard, a pair of
    binaries per question; ``finish``: the result rows of a chunk.
    """
    total = text_bytes(docs)
    chunks, buckets, shards = (max(1, total // x) for x in (scale.chunk, scale.bucket, scale.shard))
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).alias("chunk")
    )

    def question(key: tuple, table: pa.Table) -> pa.Table:
        asked = ask(list(blocks(texts_of(table), how, False)), buckets)
        rows = [
            (bucket, asked.prints[s].tobytes(), np.minimum(asked.counts[s], 65535).astype(np.uint16).tobytes())
            for bucket, s in by_group(asked.bucket)
        ]
        return pa.table({
            "bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()),
            "prints": pa.array([r[1] for r in rows], pa.binary()), "counts": pa.array([r[2] for r in rows], pa.binary()),
        })

    def count(key: tuple, table: pa.Table) -> pa.Table:
        return count_anchors(table, scale.hot)

    def prepared(table: pa.Table, answers: pa.Table, keep: bool) -> tuple[list[bytes], list[Block], Sent]:
        texts = texts_of(table)
        found = list(blocks(texts, how, keep))
        asked = ask(found, buckets)
        parts = answers_by_part(answers, "anchors")
        kinds = np.frombuffer(b"".join(p["answer"] for p in parts), np.uint8)
        return texts, found, runs_to_send(found, asked, kinds, how, shards, keep)

    def send(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        _, _, sent = prepared(table, answers, True)
        more = extra(sent, ids_of(table))
        rows = [
            (
                shard, b"\n".join(sent.text[s]) if how.unit == "word" else b"".join(sent.text[s]),
                sent.windows[s].astype(np.uint16).tobytes(), sent.left[s].astype(np.uint16).tobytes(), sent.key[s].tobytes(), more[s].tobytes(),
            )
            for shard, s in by_group(sent.shard)
        ]
        names = ("shard", "data", "windows", "left", "keys", "extra")
        out = {n: pa.array([r[i] for r in rows], pa.binary() if i else pa.int64()) for i, n in enumerate(names)}
        return pa.table(out | {"chunk": pa.array([key[0].as_py()] * len(rows), pa.int64())})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        got = shard_answer(table)
        return pa.table({
            "chunk": table.column("chunk"), "part": table.column("shard"),
            "answer": pa.array([g[0] for g in got], pa.binary()), "runs": pa.array([g[1] for g in got], pa.binary()),
        })

    def apply(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        texts, found, sent = prepared(table, answers, False)
        return finish(table, texts, found, sent, answers_by_part(answers, "runs"))

    reply = "chunk long, part long, answer binary, runs binary"
    by_chunk = dealt.groupBy("chunk")
    anchors = cut_lineage(
        by_chunk.applyInArrow(question, "bucket long, chunk long, prints binary, counts binary")
        .groupBy("bucket")
        .applyInArrow(count, reply)
    )
    sends = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(
        send, "shard long, data binary, windows binary, left binary, keys binary, extra binary, chunk long"
    )
    judged = sends.groupBy("shard").applyInArrow(answer, reply)
    return by_chunk.cogroup(anchors.union(judged).groupBy("chunk")).applyInArrow(apply, schema)
