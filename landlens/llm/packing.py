"""Vector best-fit packing of token sequences.

Documents are tokenised once into pieces (a longer document is cut, its first piece may be shorter). What has to be packed is
then a histogram of piece lengths, with at most ``capacity`` rows whatever the size of the corpus. Best-fit decreasing runs
over it class by class: open sequences with equal residual capacities form one group, a whole class of equal pieces is
placed into a group at a time, and the steps are kept as a table (length, ranks, first sequence, offset) in which every
piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from landlens.session import cut_lineage

CAPACITY = 2048
END = 0


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence and how residual capacities are weighed.

    ``docs`` and ``cost`` (sum of squared piece lengths, what attention within documents costs) default to bounds that the token
    capacity implies, so they refuse nothing. ``rule``: "norm" takes the sequence with the smallest weighted norm of what
    would be left, "dot" the one whose residual has the largest weighted dot-product with the piece.
    """

    tokens: int = CAPACITY
    docs: int = CAPACITY
    cost: int = CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)
    rule: str = "norm"

    def scale(self) -> np.ndarray:
        return np.array([self.tokens, self.docs, self.cost], dtype=np.float64)


def plan(counts: dict[int, int], limits: Limits) -> np.ndarray:
    """Steps (length, from rank, to rank, first sequence, pieces per sequence, offset) that place all pieces of a histogram."""
    steps: list[tuple[int, int, int, int, int, int]] = []
    left: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residual capacities: ranges of sequences
    weights, scale = np.array(limits.weights), limits.scale()
    keys = np.zeros((0, 3), dtype=np.int64)
    fresh = 0

    def store(key: tuple[int, int, int], first: int, n: int) -> None:
        nonlocal keys
        if min(key) <= 0 or not n:
            return
        if key not in left:
            left[key] = []
            keys = np.vstack([keys, [key]])
        left[key].append((first, n))

    for length in sorted(counts, reverse=True):
        need, done, total = np.array([length, 1, length * length]), 0, counts[length]
        if length > limits.tokens or length * length > limits.cost or limits.docs < 1:
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        while done < total:
            fits = np.flatnonzero((keys >= need).all(axis=1))
            if len(fits):
                rest = (keys[fits] - need) / scale * weights if limits.rule == "norm" else keys[fits] / scale * weights * (need / scale)
                score = (rest * rest).sum(axis=1) if limits.rule == "norm" else -rest.sum(axis=1)
                spot = int(fits[np.lexsort((keys[fits, 0], score))[0]])
                key = tuple(int(x) for x in keys[spot])
                first, n = left[key].pop()
                if not left[key]:
                    del left[key]
                    keys = np.delete(keys, spot, axis=0)
            else:
                key = (limits.tokens, limits.docs, limits.cost)
                first, n = fresh, None
            each = min(int(k // x) for k, x in zip(key, need, strict=True))
            whole = (total - done) // each
            n = max(1, math.ceil((total - done) / each)) if n is None else n
            fresh = max(fresh, first + n)
            used = min(n, whole)
            offset = limits.tokens - key[0]
            after = lambda m: tuple(int(k - m * x) for k, x in zip(key, need, strict=True))  # noqa: B023, E731
            if used:
                steps.append((length, done, done + used * each, first, each, offset))
                done += used * each
                store(after(each), first, used)
            rest_n = total - done
            if used < n and 0 < rest_n < each:
                steps.append((length, done, total, first + used, each, offset))
                store(after(rest_n), first + used, 1)
                done, used = total, used + 1
            if used < n:
                store(key, first + used, n - used)
    return np.array(steps, dtype=np.int64).reshape(-1, 6)


#: Distinct units whose ids a task remembers, about; beyond that it starts anew, which costs time, not results. Bytes at a time.
UNITS = 1_200_000
GROUP = 1 << 22
#: No pre-token spans a single space between two other characters, except as its first character: there a text may be cut.
UNIT = re.compile(r"(?<=\S)(?= \S)")
# Marks that no pre-token joins with letters before them (an apostrophe is one that some do).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The vocabulary's byte alphabet: printable bytes stand for themselves, the others for the letters from 256 on, in order.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in PRINTABLE)}
BREAK = ALPHABET[10]


class Encoder:
    """Ids of texts by a tokenizers file; each distinct unit (about a word with its space) is encoded once.

    The strings of special tokens are ordinary text, as nothing in a document is a special token.
    """

    def __init__(self, path: str) -> None:
        # Spark already gives every core a task: threads of the library's own would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.line_break = self.tokenizer.token_to_id(BREAK)
        # without a normalizer, letters after a space are one pre-token of the byte alphabet: the model can have it at once
        whole = self.tokenizer.normalizer is None and isinstance(self.tokenizer.pre_tokenizer, ByteLevel)
        self.model = self.tokenizer.model if whole else None
        #: Ids of units that follow a space, without it (None: not a unit, as white space touches it), and of other units.
        self.after_space: dict[str, bytes | None] = {}
        self.plain: dict[str, bytes] = {}

    def batch(self, units: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def letters(self, words: list[str], before: str) -> list[bytes]:
        """Ids of words of letters, after a space each or without one (``before``)."""
        if self.model is None:
            return self.lines(words) if before else self.batch(words)
        tokenize, space = self.model.tokenize, ALPHABET[32] if before else ""
        # letters of ASCII stand for themselves
        spelt = (space + (w if w.isascii() else w.encode().decode("latin-1").translate(ALPHABET)) for w in words)
        return [array("I", [t.id for t in tokenize(x)]).tobytes() for x in spelt]

    def lines(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space after a space each, all in one text: a line break is a token of its own there."""
        text = " " + "\n ".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.line_break) * ids.itemsize
        data = ids.tobytes()
        if len(cuts) != len(words) - 1:
            return self.batch([" " + w for w in words])
        return [data[a:b] for a, b in zip([0, *(cuts + ids.itemsize).tolist()], [*cuts.tolist(), len(data)], strict=True)]

    def learn(self, known: dict[str, bytes | None], units: Iterable[str], before: str) -> None:
        """Ids of units after a space, or without one.

        A word and the marks behind it are never in one pre-token, nor is a lone line break in one with what stands around
        it, so a word is encoded once whatever marks and lines follow it.
        """
        letters, words, marked, lined, mixed = set(), [], [], [], []
        for u in units:
            if u.isalpha():
                letters.add(u)
            elif before and (not u or u[0].isspace() or u[-1].isspace()):
                known[u] = None
            elif (word := u.rstrip(MARKS)).isalpha():
                letters.add(word)
                marked.append((u, word, u[len(word) :]))
            elif before and len(u.split()) == 1:
                words.append(u)
            elif before and "\n" in u and not any(len(x.split()) != 1 or x != x.strip() for x in u.split("\n")):
                lined.append((u, *u.split("\n")))
            else:
                mixed.append(u)
        letters = [w for w in letters if w not in known]
        known.update(zip(letters, self.letters(letters, before), strict=True))
        if words:
            known.update(zip(words, self.lines(words), strict=True))
        if mixed:
            known.update(zip(mixed, self.batch([before + u for u in mixed]), strict=True))
        self.learn_plain({marks for _, _, marks in marked if marks not in self.plain})
        for u, word, marks in marked:
            known[u] = known[word] + self.plain[marks]
        if lined:
            first = {x[1] for x in lined if x[1] not in known}
            self.learn(known, first, before)
            self.learn_plain({"\n", *(w for x in lined for w in x[2:])})
            for u, head, *rest in lined:
                known[u] = known[head] + b"".join(self.plain["\n"] + self.plain[w] for w in rest)

    def learn_plain(self, units: set[str]) -> None:
        new = units.difference(self.plain)
        if new:
            self.learn(self.plain, new, "")

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """Ids of each text. Units are split, told apart and laid out as columns; Python sees each distinct one of a call once."""
        for known in (self.plain, self.after_space):
            if len(known) > UNITS:
                known.clear()
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        split = pa.compute.split_pattern(texts, " ")
        bounds, units = split.offsets.to_numpy(), split.values
        behind = np.ones(len(units), bool)
        behind[bounds[:-1]] = False
        firsts = units.take(pa.array(bounds[:-1])).to_pylist()
        self.learn_plain(set(firsts))
        coded = units.filter(pa.array(behind)).dictionary_encode()
        # joined and split again, which is much faster than one value at a time; units hold no spaces
        whole = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), pa.scalar(" ", pa.large_string()))
        distinct = whole[0].as_py().split(" ") if len(coded.dictionary) else []
        found = list(map(self.after_space.get, distinct))
        new = [u for u in compress(distinct, map(is_, found, repeat(None))) if u not in self.after_space]
        if new:
            self.learn(self.after_space, new, " ")
            found = list(map(self.after_space.get, distinct))
        laid = pa.array(found, pa.large_binary()).take(coded.indices)
        at = np.frombuffer(laid.buffers()[1], np.int64)[: len(laid) + 1]
        ids = np.frombuffer(laid.buffers()[2] or b"", "<u4")
        odd = np.concatenate([[0], np.cumsum(laid.is_null().to_numpy(zero_copy_only=False))])
        # the units behind the first one of text i are from bounds[i] - i on, as each text before has one first unit
        ends = bounds - np.arange(len(bounds))
        out = []
        for i, (first, a, b) in enumerate(zip(firsts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if first[-1:].isspace() or (not first and b > a) or odd[b] > odd[a]:
                care = UNIT.split(texts[i].as_py())  # white space touches a space: cut with care
                self.learn_plain(set(care))
                out.append(np.frombuffer(b"".join(map(self.plain.__getitem__, care)), "<u4"))
            else:
                out.append(np.concatenate([np.frombuffer(self.plain[first], "<u4"), ids[at[a] // 4 : at[b] // 4]]))
        return out


def groups(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in groups of bounded size, in order; a longer text is a group of its own."""
    ends = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + GROUP, side="right")))
        yield texts.slice(start, end - start)
        start = end


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; a null text is an empty one and has the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            rows, out = [], ([], [], [], [])
            texts = pa.compute.fill_null(batch.column(1).cast(pa.large_string()), "")
            for row, found in enumerate(x for group in groups(texts) for x in encode(group)):
                ids = np.append(found, np.array([END], "<u4"))
                first = len(ids) % capacity or capacity
                for piece, at in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[at : first if piece == 0 else at + capacity]
                    rows.append(row)
                    for column, x in zip(out, (piece, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()),
                    pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, limits: Limits = Limits()) -> DataFrame:
    """The place of every piece; documents longer than the capacity have several.

    Columns used: doc_id, text; others are ignored. Null and empty texts pack their end id, repeated rows are packed each,
    a null doc_id is an id like any other, empty input gives no rows.
    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    cut = cut_lineage(pieces(docs, vocabulary, limits.tokens))
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(deal)))
    counts = cut_lineage(dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    # one row per length: at most ``limits.tokens`` rows reach the driver
    steps = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, limits)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut_lineage(counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("row", F.row_number().over(within) - 1).join(bases, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("row")).alias("rank"))

    order = np.lexsort((steps[:, 1], steps[:, 0]))
    steps = steps[order]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, spans = np.unique(steps[:, 0], return_index=True)
        ends = np.append(spans[1:], len(steps))
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length):
                k = int(np.searchsorted(lengths, x))
                mine = length == x
                at[mine] = spans[k] + np.searchsorted(steps[spans[k] : ends[k], 1], rank[mine], side="right") - 1
            chosen = steps[at]
            nth = rank - chosen[:, 1]
            sequence = chosen[:, 3] + nth // chosen[:, 4]
            offset = chosen[:, 5] + nth % chosen[:, 4] * length
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


QUERY_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
