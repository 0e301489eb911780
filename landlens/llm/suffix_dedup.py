"""Suffix-array dedup of byte strings by column-wise multi-document construction.

Windows of 50 bytes meet in content-defined shards; the anchors of windows and their runs are those of ``anchors``. A run's
text travels only where hashes cannot settle it, so that neither copies nor anchors that meet by chance cost more than their
hashes:

1. every chunk of documents sends, per distinct run, its anchor's print, a 64-bit hash of its content and its smallest document,
2. a bucket answers per run: another chunk has it in a smaller document, or its anchor meets no other run, or it must be judged,
3. the chunk with the smallest document of a run that must be judged sends the text to the shard of the anchor,
4. the shard answers one bit per window: whether a smaller document than the one sent has it, and
5. the chunk applies the answers to its documents.

An anchor met by very many different runs is split: its windows are grouped by the place of the anchor in the window and
sharded by what all windows of such a group contain. In a shard, halves of runs that share what all windows of such a half
contain form a collection whose Burrows-Wheeler transform and common prefixes grow by one symbol per string and round
(``column_bwt``). Stretches of the sorted suffixes that share a window form a class, and the smallest document of the class
keeps the window.

The strings of a shard are bounded, so the sequential files of a construction are buffers of the task: nothing is written to
a folder of one machine. The bytes that all windows of a half contain, equal in all strings with that key, count as one symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlens.llm.anchors import (
    BLOCK, BYTE_HASH, GROUP, NO_DOC, Block, Scale, Windows, blocks, by_group, ids_of, mixed, prefix, ranges, stretch, texts_of,
)
from landlens.llm.column_bwt import collection_bwt
from landlens.llm.common import text_bytes
from landlens.session import cut_lineage, shuffles_removed

WINDOW = 50
GRAM = 16
HOW = Windows("byte", WINDOW, GRAM)
#: Windows whose anchor lies at least so many bytes behind their start form the left half of a run, the others the right half.
HALF = HOW.width // 2
#: Symbols per collection, and keys at most (their numbers follow the 256 bytes); strings with one key stay together.
COLLECTION = 1 << 18
KEYS = 65_000
#: So many buckets and shards of ``Scale`` are one here: their messages are as many as chunks times buckets.
TOGETHER = 4
#: What a bucket says of a run: its windows are its own, to be judged by run or by group, or a smaller document has them.
OWN, JUDGE, SPLIT, GONE = range(4)
GONE_DOC = np.iinfo(np.int64).min


def distinct(content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first place of each value in that order, number of each value's class): equal values side by side, ascending."""
    order = np.argsort(content)
    ranked = content[order]
    head = np.ones(len(order), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=head[1:])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(head) - 1
    return order, np.flatnonzero(head), which


def least_of(values: np.ndarray, order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values[order], heads) if len(heads) else values[:0]


def times(keys: np.ndarray) -> np.ndarray:
    """How often each element's value occurs."""
    _, heads, which = distinct(keys)
    return np.diff(np.append(heads, len(keys)))[which]


@dataclass
class Runs:
    """Distinct runs of a chunk in the order that questions and answers share, and every occurrence."""

    part: np.ndarray  # bucket; of a run in a bucket of its content, not of its anchor: see aside
    aside: np.ndarray  # its anchor meets very many runs within the chunk alone
    content: np.ndarray
    doc: np.ndarray  # smallest document of the chunk
    lead: np.ndarray  # an occurrence
    which: np.ndarray  # per occurrence: number of its run
    block: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    own: np.ndarray  # its document


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def runs_of(found: list[Block], ids: np.ndarray, buckets: int, heavy: int) -> Runs:
    start, count, anchor, key = (np.concatenate([getattr(b, n) for b in found]) for n in ("start", "count", "anchor", "key"))
    block = np.repeat(np.arange(len(found)), [len(b.start) for b in found])
    own = np.concatenate([ids[b.rows[b.part_of(b.start)]] for b in found])
    with np.errstate(over="ignore"):
        content = np.concatenate([stretch(b.sums, b.start, b.start + b.count + WINDOW - 1) for b in found])
    order, heads, which = distinct(content)
    lead = order[heads]
    aside = times(key[lead]) >= heavy
    part = bucket_of(np.where(aside, content[lead], key[lead]), buckets)
    turn = np.argsort(part * 2 + aside, kind="stable")
    back = np.empty(len(turn), np.int64)
    back[turn] = np.arange(len(turn))
    lead = lead[turn]
    return Runs(
        part[turn], aside[turn], content[lead], least_of(own, order, heads)[turn], lead, back[which], block, start, count,
        anchor, key, own,
    )


def packed_docs(docs: np.ndarray) -> bytes:
    """The least one, then the others' distances from it in 4 or 8 bytes."""
    least = docs.min()
    with np.errstate(over="ignore"):
        far = docs.astype(np.uint64) - least.astype(np.uint64)
    return least.tobytes() + far.astype(np.uint32 if int(far.max()) < 1 << 32 else np.uint64).tobytes()


def unpacked_docs(data: bytes, n: int) -> np.ndarray:
    far = np.frombuffer(data, np.uint32 if len(data) == 8 + 4 * n else np.uint64, offset=8).astype(np.uint64)
    with np.errstate(over="ignore"):
        return (far + np.frombuffer(data, np.uint64, 1)).astype(np.int64)


def questions(runs: Runs, buckets: int) -> list[tuple]:
    """(bucket, prints, contents, documents, heavy prints) for each bucket; runs set aside come last and have no print."""
    prints = runs.key[runs.lead].astype(np.uint32)
    rows = []
    for part, s in by_group(runs.part):
        plain = prints[s][~runs.aside[s]]
        rows.append((part, plain.tobytes(), runs.content[s].tobytes(), packed_docs(runs.doc[s]), b""))
    heavy = np.unique(runs.key[runs.lead[runs.aside]])
    part = bucket_of(heavy, buckets)
    turn = np.argsort(part, kind="stable")
    for p, s in by_group(part[turn]):
        rows.append((p, b"", b"", b"", heavy[turn][s].astype(np.uint32).tobytes()))
    return rows


def weigh(table: pa.Table, hot: int) -> list[bytes | None]:
    """For each question, what is to be done with each of its runs; none for those that only name heavy prints."""
    data = [table.column(c).to_pylist() for c in ("prints", "contents", "docs", "heavy")]
    contents = [np.frombuffer(x, np.uint64) for x in data[1]]
    prints = [np.frombuffer(x, np.uint32) for x in data[0]]
    size = np.array([len(x) for x in contents], np.int64)
    content = np.concatenate(contents)
    doc = np.concatenate([unpacked_docs(x, n) for x, n in zip(data[2], size.tolist(), strict=True) if n] or [np.zeros(0, np.int64)])
    heavy = np.unique(np.frombuffer(b"".join(data[3]), np.uint32))
    order, heads, which = distinct(content)
    base = np.cumsum(size) - size
    plain = ranges(base, np.array([len(x) for x in prints], np.int64))
    # one print for each different content that came with one
    mark = np.zeros(len(heads), np.uint32)
    mark[which[plain]] = np.concatenate(prints)
    met = np.zeros(len(heads), bool)
    met[which[plain]] = True
    number = times(mark[met])
    told = np.full(len(heads), SPLIT, np.uint8)
    told[met] = np.where((number >= hot) | np.isin(mark[met], heavy), SPLIT, np.where(number > 1, JUDGE, OWN))
    kind = np.full(len(content), SPLIT, np.uint8)
    kind[plain] = told[which[plain]]
    kind[doc > least_of(doc, order, heads)[which]] = GONE
    return [kind[a : a + n].tobytes() if n else None for a, n in zip(base.tolist(), size.tolist(), strict=True)]


@dataclass
class Strings:
    """Distinct strings that a chunk sends, in the order that questions and answers share, and the pieces of runs they stand for."""

    shard: np.ndarray
    key: np.ndarray
    windows: np.ndarray
    left: np.ndarray  # bytes before the anchor
    doc: np.ndarray
    block: np.ndarray
    start: np.ndarray
    which: np.ndarray  # per piece: number of its string
    run: np.ndarray  # its run, first window within the run, and windows
    first: np.ndarray
    size: np.ndarray


def strings_of(found: list[Block], runs: Runs, kinds: np.ndarray, shards: int) -> Strings:
    run = np.flatnonzero(kinds == JUDGE)
    at = runs.lead[run]
    first, size, key, content = np.zeros(len(run), np.int64), runs.count[at], runs.key[at], runs.content[run]
    hot = np.flatnonzero(kinds == SPLIT)
    if len(hot):
        many = runs.count[runs.lead[hot]]
        of = np.repeat(hot, many)
        starts = ranges(runs.start[runs.lead[hot]], many)
        group = (runs.anchor[runs.lead[of]] - starts) // GROUP
        heads = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (of[1:] != of[:-1])]))
        owner, sizes, begin = of[heads], np.diff(np.append(heads, len(of))), starts[heads]
        place = runs.lead[owner]
        core, whole = np.empty(len(heads), np.uint64), np.empty(len(heads), np.uint64)
        low = runs.anchor[place] - GROUP * group[heads]
        turn = np.argsort(runs.block[place], kind="stable")
        with np.errstate(over="ignore"):
            for number, s in by_group(runs.block[place][turn]):
                mine, sums = turn[s], found[number].sums
                # what every window of the group holds, whether or not all of them exist in this document
                core[mine] = stretch(sums, low[mine], low[mine] - GROUP + 1 + WINDOW)
                whole[mine] = stretch(sums, begin[mine], begin[mine] + sizes[mine] + WINDOW - 1)
            core = mixed(core + runs.key[place] + group[heads].astype(np.uint64))
        run, at = np.concatenate([run, owner]), np.concatenate([at, place])
        first, size = np.concatenate([first, begin - runs.start[place]]), np.concatenate([size, sizes])
        key, content = np.concatenate([key, core]), np.concatenate([content, whole])
    order, heads, which = distinct(content)
    lead = order[heads]
    shard = (mixed(key[lead]) % np.uint64(shards)).astype(np.int64)
    turn = np.argsort(shard, kind="stable")
    back = np.empty(len(turn), np.int64)
    back[turn] = np.arange(len(turn))
    lead = lead[turn]
    start = runs.start[at] + first
    return Strings(
        shard[turn], key[lead], size[lead], (runs.anchor[at] - start)[lead], least_of(runs.doc[run], order, heads)[turn], runs.block[at][lead], start[lead],
        back[which], run, first, size,
    )


def messages(found: list[Block], strings: Strings) -> list[tuple]:
    """(shard, texts, windows, left, keys, documents) for each shard."""
    end = strings.start + strings.windows + WINDOW - 1
    text = [found[b].text[a:e] for b, a, e in zip(strings.block.tolist(), strings.start.tolist(), end.tolist(), strict=True)]
    return [
        (
            shard, b"".join(text[s]), strings.windows[s].astype(np.uint16).tobytes(), strings.left[s].astype(np.uint16).tobytes(),
            strings.key[s].tobytes(), packed_docs(strings.doc[s]),
        )
        for shard, s in by_group(strings.shard)
    ]


def first_docs(data: np.ndarray, start: np.ndarray, size: np.ndarray, core: np.ndarray, span: int, number: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each string and each of its windows, the smallest document that has the window, one string after another.

    ``start``, ``size``: the strings within ``data``; ``core``: bytes before the ``span`` bytes that all strings of the same
    ``number`` share and that lie in all windows.
    """
    raw = data[ranges(start, size)].astype(np.uint16) + 1
    base = np.cumsum(size) - size
    raw[base + core] = (257 + number).astype(np.uint16)
    keep = np.ones(len(raw), bool)
    keep[ranges(base + core + 1, np.full(len(size), span - 1))] = False
    short = size - span + 1
    string, length, common = collection_bwt(raw[keep], short)
    width = WINDOW - span + 1
    full = length >= width
    edge = np.flatnonzero(np.concatenate([[True], common[1:] < width]))
    owner = np.where(full, docs[string], NO_DOC)
    best = np.repeat(np.minimum.reduceat(owner, edge), np.diff(np.append(edge, len(owner))))
    windows = short - width + 1
    out = np.empty(int(windows.sum()), np.int64)
    base = np.cumsum(windows) - windows
    out[(base[string] + short[string] - length)[full]] = best[full]
    return out


def judge_half(data: np.ndarray, start: np.ndarray, windows: np.ndarray, core: np.ndarray, span: int, key: np.ndarray, content: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """As :func:`first_docs`, for strings that may be equal; only different ones with one key meet in a collection."""
    order, heads, which = distinct(content)
    lead = order[heads]
    least, name = least_of(docs, order, heads), key[lead]
    # a string that has its key to itself, or that only met copies of itself, shares no window
    rest = np.flatnonzero(times(name) > 1)
    values = np.repeat(least, windows[lead])
    base = np.cumsum(windows[lead]) - windows[lead]
    rest = rest[np.argsort(name[rest], kind="stable")]
    turn = np.concatenate([[True], name[rest][1:] != name[rest][:-1]]) if len(rest) else np.zeros(0, bool)
    number = np.cumsum(turn) - 1
    symbols = np.cumsum(windows[lead[rest]] + WINDOW - span)
    edges = np.append(np.flatnonzero(turn), len(rest))
    done = np.concatenate([[0], symbols])[edges]
    a = 0
    while a + 1 < len(edges):
        b = min(max(a + 1, int(np.searchsorted(done, done[a] + COLLECTION, "right")) - 1), a + KEYS)
        some = rest[edges[a] : edges[b]]
        at = lead[some]
        values[ranges(base[some], windows[at])] = first_docs(
            data, start[at], windows[at] + WINDOW - 1, core[at], span, number[edges[a] : edges[b]] - a, least[some]
        )
        a = b
    return values[ranges(base[which], windows)]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Hashes of stretches of consecutive strings; ``parts``: starts and ends, each within the string of its number."""
    out = [np.zeros(len(start), np.uint64) for _ in parts]
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + BLOCK, "right")))
        with np.errstate(over="ignore"):
            sums = prefix(BYTE_HASH[data[start[a] : end[b - 1]]])
            for x, (low, high) in zip(out, parts, strict=True):
                x[a:b] = stretch(sums, low[a:b] - start[a], high[a:b] - start[a])
        a = b
    return out


def judge_shard(table: pa.Table) -> list[bytes]:
    """For each question, a bit per window: whether a document smaller than the string's own has it."""
    rows = table.select(["data", "windows", "left", "keys", "docs"]).to_pylist()
    data = np.frombuffer(b"".join(r["data"] for r in rows), np.uint8)
    windows, left = (np.frombuffer(b"".join(r[c] for r in rows), np.uint16).astype(np.int64) for c in ("windows", "left"))
    key = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint64)
    docs = np.concatenate([unpacked_docs(r["docs"], len(r["keys"]) // 8) for r in rows])
    end = np.cumsum(windows + WINDOW - 1)
    start = end - windows - WINDOW + 1
    anchor = start + left
    lefts = np.clip(left - HALF + 1, 0, windows)
    middle = start + lefts
    none = np.minimum(anchor, start)
    # a half without windows has no core
    low, high = np.where(lefts > 0, anchor - HALF, none), np.where(lefts > 0, anchor + GRAM, none)
    low_r, high_r = np.where(lefts < windows, anchor, none), np.where(lefts < windows, anchor + WINDOW - HALF + 1, none)
    core, core_r, content, content_r = hashes(
        data, start, end, [(low, high), (low_r, high_r), (start, np.where(lefts > 0, middle + WINDOW - 1, start)), (np.where(lefts < windows, middle, end), end)]
    )
    best = np.empty(int(windows.sum()), np.int64)
    base = np.cumsum(windows) - windows
    for begin, first, size, inner, span, name, what in (
        (start, base, lefts, anchor - HALF, HALF + GRAM, core, content),
        (middle, base + lefts, windows - lefts, anchor, WINDOW - HALF + 1, core_r, content_r),
    ):
        mine = np.flatnonzero(size)
        with np.errstate(over="ignore"):
            names = mixed(name[mine] + key[mine])
        best[ranges(first[mine], size[mine])] = judge_half(
            data, begin[mine], size[mine], inner[mine] - begin[mine], span, names, what[mine], docs[mine]
        )
    smaller = best < np.repeat(docs, windows)
    edges = np.cumsum([0, *(len(r["windows"]) // 2 for r in rows)])
    edges = np.concatenate([[0], np.cumsum(windows)])[edges]
    return [np.packbits(smaller[a:b]).tobytes() for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]


def covered_by(found: list[Block], runs: Runs, kinds: np.ndarray, strings: Strings, answers: list[dict]) -> dict[int, list[tuple[int, np.ndarray]]]:
    """Bytes that a window of a smaller document covers, by row: pairs (first byte of a part, bits)."""
    edges = np.concatenate([[0], np.cumsum(strings.windows)])
    best = np.repeat(strings.doc, strings.windows)
    parts = [a["part"] for a in answers]
    for a, lo, hi in zip(answers, np.searchsorted(strings.shard, parts), np.searchsorted(strings.shard, parts, "right"), strict=True):
        n = int(edges[hi] - edges[lo])
        best[edges[lo] : edges[hi]][np.unpackbits(np.frombuffer(a["answer"], np.uint8), count=n).astype(bool)] = GONE_DOC
    # windows of the runs that were judged, then of every occurrence
    judged = (kinds == JUDGE) | (kinds == SPLIT)
    many = np.where(judged, runs.count[runs.lead], 0)
    base = np.cumsum(many) - many
    least = np.empty(int(many.sum()), np.int64)
    least[ranges(base[strings.run] + strings.first, strings.size)] = best[ranges(edges[strings.which], strings.size)]
    kind = kinds[runs.which]
    whole = (kind == GONE) | ((kind == OWN) & (runs.own > runs.doc[runs.which]))
    some = np.flatnonzero(judged[runs.which])
    count = runs.count[some]
    hit = least[ranges(base[runs.which[some]], count)] < np.repeat(runs.own[some], count)
    block = np.repeat(runs.block[some], count)[hit]
    first = ranges(runs.start[some], count)[hit]
    after = first + WINDOW
    some = np.flatnonzero(whole)
    block = np.concatenate([block, runs.block[some]])
    first = np.concatenate([first, runs.start[some]])
    after = np.concatenate([after, runs.start[some] + runs.count[some] + WINDOW - 1])
    order = np.argsort(block, kind="stable")
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    for number, s in by_group(block[order]):
        b, mine = found[number], order[s]
        total = int(b.size.sum()) + 1
        bits = np.cumsum(np.bincount(first[mine], minlength=total) - np.bincount(after[mine], minlength=total)) > 0
        edge = np.concatenate([[0], np.cumsum(b.size)])
        for part in np.unique(b.part_of(first[mine])).tolist():
            out.setdefault(int(b.rows[part]), []).append((int(b.base[part]), bits[edge[part] : edge[part + 1]]))
    return out


def cut_bytes(table: pa.Table, texts: list[bytes], covered: dict[int, list[tuple[int, np.ndarray]]]) -> pa.Table:
    """The documents of a chunk without the bytes that a window of a smaller document covers."""
    kept, n_removed, n_spans = [], [], []
    for row, text in enumerate(texts):
        if row not in covered:
            kept.append(text), n_removed.append(0), n_spans.append(0)
            continue
        gone = np.zeros(len(text), bool)
        for base, bits in covered[row]:
            gone[base : base + len(bits)] |= bits
        kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        n_removed.append(int(gone.sum())), n_spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[0]))
    return pa.table({
        "doc_id": table.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
        "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary()),
    })


def suffix_dedup(docs: DataFrame, scale: Scale = Scale()) -> DataFrame:
    """Each document without the bytes that lie in a 50-byte string which also starts in a document with a smaller doc_id.

    Columns used: doc_id (integer), text (UTF-8); others are ignored. ``docs`` must give the same rows when read again. Null
    text: empty. A null doc_id is larger than any other; rows with equal ids do not remove each other's bytes. Texts shorter
    than a window are kept whole. Empty input gives no rows.
    Returns doc_id, n_bytes, n_removed, n_spans, kept (binary, as a cut may split a character).
    """
    total = text_bytes(docs)
    chunks, buckets, shards = (max(1, total // x) for x in (scale.chunk, scale.bucket * TOGETHER, scale.shard * TOGETHER))
    heavy = max(2, scale.hot // 8)
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).alias("chunk")
    )

    def of_chunk(names: tuple[str, ...], rows: list[tuple], key: tuple) -> pa.Table:
        out = {n: pa.array([r[i] for r in rows], pa.binary() if i else pa.int64()) for i, n in enumerate(names)}
        return pa.table(out | {"chunk": pa.array([key[0].as_py()] * len(rows), pa.int64())})

    def question(key: tuple, table: pa.Table) -> pa.Table:
        found = list(blocks(texts_of(table), HOW, False))
        return of_chunk(("bucket", "prints", "contents", "docs", "heavy"), questions(runs_of(found, ids_of(table), buckets, heavy), buckets), key)

    def reply_to(table: pa.Table, part: str, said: list[bytes | None], what: int) -> pa.Table:
        return pa.table({
            "chunk": table.column("chunk"), "part": table.column(part), "answer": pa.array(said, pa.binary()),
            "judged": pa.array([bool(what)] * len(said), pa.bool_()),
        }).filter(pa.array([x is not None for x in said], pa.bool_()))

    def prepared(table: pa.Table, answers: pa.Table, keep: bool) -> tuple:
        texts = texts_of(table)
        found = list(blocks(texts, HOW, keep))
        runs = runs_of(found, ids_of(table), buckets, heavy)
        parts = sorted(answers.to_pylist(), key=lambda r: r["part"])
        kinds = np.frombuffer(b"".join(p["answer"] for p in parts if not p["judged"]), np.uint8)
        return texts, found, runs, kinds, strings_of(found, runs, kinds, shards), [p for p in parts if p["judged"]]

    def send(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        _, found, _, _, strings, _ = prepared(table, answers, True)
        return of_chunk(("shard", "data", "windows", "left", "keys", "docs"), messages(found, strings), key)

    def apply(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        texts, *rest = prepared(table, answers, False)
        return cut_bytes(table, texts, covered_by(*rest))

    reply = "chunk long, part long, answer binary, judged boolean"
    by_chunk = dealt.groupBy("chunk")
    with shuffles_removed(docs.sparkSession):
        weighed = cut_lineage(
            by_chunk.applyInArrow(question, "bucket long, prints binary, contents binary, docs binary, heavy binary, chunk long")
            .groupBy("bucket")
            .applyInArrow(lambda t: reply_to(t, "bucket", weigh(t, scale.hot), 0), reply)
        )
    sends = by_chunk.cogroup(weighed.groupBy("chunk")).applyInArrow(
        send, "shard long, data binary, windows binary, left binary, keys binary, docs binary, chunk long"
    )
    judged = sends.groupBy("shard").applyInArrow(lambda t: reply_to(t, "shard", judge_shard(t), 1), reply)
    return by_chunk.cogroup(weighed.union(judged).groupBy("chunk")).applyInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
