"""SimHash near-dedup by tiled exact comparison.

Fingerprints within the radius agree in at least one of ``radius + 1`` bit blocks, so only fingerprints that share a block
are compared; within a shared block they form tiles by population count, and a tile meets only the tiles whose counts
differ by no more than the radius: all other tile pairs are skipped, as their fingerprints cannot be near. Tile pairs
are compared exactly, by exclusive or and bit counts in numpy, in slabs of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landlens.llm.components import components
from landlens.session import cut_lineage, discard

BITS = 64
RADIUS = 2
SEED = 42
#: Fingerprint pairs compared at a time; rows up to which a tile is compared side by side with others; rows per part.
SLAB = 1 << 20
SMALL = 64
PART = 1 << 15

xxh64 = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the word shingles, repeats included: a bit is 1 if set in over half of their hashes."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
    hashes = np.fromiter(map(xxh64, shingles), np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and its fingerprint as a signed long; one row per input row, null text like the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            prints = np.fromiter((fingerprint(t or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def near(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) of fingerprints at most ``radius`` bits apart, slab by slab."""
    if not len(b):
        return
    step = max(1, SLAB // len(b))
    for at in range(0, len(a), step):
        yield tuple(
            x + o for x, o in zip(np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius), (at, 0), strict=True)
        )


class Forest:
    """Union-find over the fingerprints of one tile group: keeps what is linked, not every link."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the pairs; whole arrays at a time, pointing at the smaller index until nothing moves."""
        up = self.up
        while len(a):
            ra, rb = up[a], up[b]
            while True:
                na, nb = up[ra], up[rb]
                if (na == ra).all() and (nb == rb).all():
                    break
                ra, rb = na, nb
            keep = ra != rb
            a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
            np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            new = up[up]
            if (new == up).all():
                return up
            up = new


def compare_tiles(table: pa.Table, radius: int) -> pa.Table:
    """Links within the tiles of one part and between them and their visitors, as a forest: at most one per fingerprint.

    Rows of one (block, value, tile) stand together. Small tiles are compared side by side, row i with row i + d for growing
    d; a tile of more than ``SMALL`` rows is compared slab by slab.
    """
    prints, of = np.unique(table.column("fp").to_numpy().view(np.uint64), return_inverse=True)
    names = [table.column(c).to_numpy() for c in ("visit", "tile", "value", "block")]
    order = np.lexsort(names)
    of, names = of[order], [x[order] for x in names]
    head = np.ones(len(of), bool)
    head[1:] = False
    for x in names[1:]:
        head[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(head)
    sizes = np.diff(np.append(starts, len(of)))
    group = np.repeat(np.arange(len(starts)), sizes)
    forest = Forest(len(prints))
    small = sizes <= SMALL
    for d in range(1, int(sizes[small].max(initial=1))):
        i = np.flatnonzero((group[d:] == group[:-d]) & small[group[d:]])
        i = i[np.bitwise_count(prints[of[i]] ^ prints[of[i + d]]) <= radius]
        forest.add(of[i], of[i + d])
    for g in np.flatnonzero(~small):
        mine = slice(starts[g], starts[g] + sizes[g])
        home = int(np.searchsorted(names[0][mine], 1))
        members = of[mine]
        for i, j in near(prints[members], prints[members[:home]], radius):
            forest.add(members[i], members[j])
    roots = forest.roots()
    linked = np.flatnonzero(roots != np.arange(len(roots)))
    return pa.table({"a": prints[linked].view(np.int64), "b": prints[roots[linked]].view(np.int64)})


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column fp, distinct) within the radius of each other.

    Tiles are dealt over parts of about ``PART`` rows by their hash, so that a task compares many tiles at a time.
    """
    blocks = radius + 1
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    value = F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))
    ])
    each = prints.select("fp", F.bit_count("fp").alias("ones"), F.explode(value).alias("k"))
    tiles = each.select(
        "fp", "k.block", "k.value", F.explode(F.sequence(F.lit(0), F.lit(radius))).alias("visit"), "ones"
    ).withColumn("tile", F.col("ones") - F.col("visit"))
    parts = max(1, prints.count() * blocks * (radius + 1) // PART)

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        return compare_tiles(table, radius)

    dealt = tiles.select("fp", "block", "value", "visit", "tile", F.pmod(F.xxhash64("block", "value", "tile"), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInArrow(compare, "a long, b long")


def simhash_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint and component of each document; one row per input row.

    Columns used: doc_id, text; others are ignored. Documents with one fingerprint are linked without comparison, whatever
    their number; distinct fingerprints are compared. Null and empty texts have fingerprint zero and are linked like others.
    Repeated rows and doc_ids are rows like any other; a null doc_id is never a representative unless it is alone.
    Empty input gives no rows. component_id is the smallest doc_id reachable.
    """
    rows = cut_lineage(fingerprints(docs))
    firsts = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = cut_lineage(near_links(firsts.select("fp"), radius))
    member = components(links).select(F.col("node").alias("fp"), "root")
    grouped = firsts.join(member, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut_lineage(grouped.join(least, "root").select("fp", "component_id"))
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The stage on documents: words per shingle, and the Jaccard similarity from which sets of shingles are near, in tenths.
STAGE_WORDS = 5
STAGE_TENTHS = 8
#: Bits by which the stage's fingerprints, of the same shingles, may differ for their texts to be compared first.
STAGE_RADIUS = 3
#: Documents whose shingles are counted to find common ones, and how many common ones are set behind the others.
SAMPLE_DOCS = 20_000
COMMON = 200_000


def shingle_set(text: bytes, width: int = STAGE_WORDS) -> np.ndarray:
    """Distinct hashes of the word shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxh64(b" ".join(words))], np.uint64)
    return np.unique(np.fromiter(map(xxh64, map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))), np.uint64))


def prefix_of(hashes: np.ndarray, common: np.ndarray) -> tuple[int, np.ndarray]:
    """How many shingles of the prefix a near set's prefix holds too at least, and the prefix.

    Sets of the stage's similarity share at least m = ceil(J n) of the n shingles of each. In one order of all shingles the
    first n - m + l of one then hold l, a tenth of n, that the other's prefix holds as well; of sets of two sizes, m - l does
    not fall with n. Any order does; with common shingles at its end few sets meet by what is in many documents.
    """
    late = np.zeros(len(hashes), bool)
    if len(common):  # sorted
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
    n = len(hashes)
    least = -(-n // 10)
    return least, np.concatenate([hashes[~late], hashes[late]])[: n + (-STAGE_TENTHS * n // 10) + least]


ARROW = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}


def mapped(rows: DataFrame, columns: list[str], make: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """``columns`` of each row and what ``make`` returns for the shingle set of its text."""
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in columns)
    target = {name: ARROW[kind] for name, kind in (field.split(" ") for field in schema.split(", "))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [make(shingle_set(t or b"")) for t in part.column(len(columns)).cast(pa.large_binary()).to_pylist()]
                more = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(target.values())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *more], [*columns, *target])

    return rows.select(*columns, "text").mapInArrow(run, kinds + schema)


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), seed=SEED) - (1 << 63)


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles that a bounded sample of documents holds again and again; they only affect the order of shingles."""
    share = max(1, texts.count() // SAMPLE_DOCS)
    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    held = mapped(sample, [], lambda h: (h.view(np.int64),), "h array<long>").select(F.explode("h").alias("h"))
    often = held.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").orderBy(F.desc("n"), "h").limit(COMMON)
    return np.sort(np.array([r.h for r in often.collect()], np.int64).view(np.uint64))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (key_a, key_b) whose whole sets have the similarity, as links (a, b)."""
    left, right = (sets.select(*[F.col(c).alias(f"{c}_{x}") for c in ("key", "h")]) for x in "ab")
    same = F.size(F.array_intersect("h_a", "h_b"))
    return (
        pairs.join(left, "key_a")
        .join(right, "key_b")
        .filter((10 + STAGE_TENTHS) * same >= STAGE_TENTHS * (F.size("h_a") + F.size("h_b")))
        .select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    )


def sets_of(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """key and whole shingle set (h) of the texts that stand in a pair (key_a, key_b)."""
    ends = pairs.select(F.col("key_a").alias("key")).union(pairs.select(F.col("key_b").alias("key"))).distinct()
    return cut_lineage(mapped(texts.join(ends, "key", "left_semi"), ["key"], lambda h: (h.view(np.int64),), "h array<long>"))


def simhash_links(texts: DataFrame, radius: int = STAGE_RADIUS) -> DataFrame:
    """Links (a, b) between set keys that their fingerprints bring together and their whole sets confirm.

    ``texts``: key and text, one row per key. Distinct fingerprints are compared in tiles (:func:`near_links`), texts of one
    fingerprint meet the first of them; pairs grow with the texts, not with the square of a group.
    """
    prints = cut_lineage(fingerprints(texts.select(F.col("key").alias("doc_id"), "text"), STAGE_WORDS))
    firsts = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    near = near_links(firsts.select("fp"), radius)
    end_a, end_b = (firsts.select(F.col("fp").alias(x), F.col("first").alias(f"key_{x}")) for x in "ab")
    across = near.join(end_a, "a").join(end_b, "b").select("key_a", "key_b")
    equal = prints.join(firsts, "fp").filter("doc_id <> first").select(F.col("first").alias("key_a"), F.col("doc_id").alias("key_b"))
    pairs = cut_lineage(across.union(equal).distinct())
    sets = sets_of(texts, pairs)
    links = cut_lineage(verified(pairs, sets))
    discard(prints, firsts, pairs, sets)
    return links


def crowded(texts: DataFrame) -> DataFrame:
    """The keys of ``texts`` (key, group, text) that can be near a text of another group: only these are compared.

    Each has as many shingles in its prefix that prefixes of other groups hold too as :func:`prefix_of` asks for.
    """
    common = common_shingles(texts)

    def posting(hashes: np.ndarray) -> tuple:
        least, prefix = prefix_of(hashes, common)
        return least, prefix.view(np.int64)

    each = mapped(texts, ["key", "group"], posting, "least long, prefix array<long>")
    each = each.select("key", "group", "least", F.explode("prefix").alias("h"))
    met = several_groups(each)
    return met.groupBy("key", "least").agg(F.count(F.lit(1)).alias("met")).filter("met >= least").select("key")


def several_groups(rows: DataFrame) -> DataFrame:
    """``rows`` of the shingles (h) that more than one group holds, and how many rows hold them (times)."""
    held = Window.partitionBy("h")
    met = rows.withColumns({"times": F.count(F.lit(1)).over(held), "_least": F.min("group").over(held), "_most": F.max("group").over(held)})
    return met.filter("_least < _most").drop("_least", "_most")


def rare_first(shared: DataFrame) -> DataFrame:
    """Postings (key, group, n, alone, at, h): the prefixes of the sets in the order by the number of sets that hold a shingle.

    ``shared``: key, group, n (size of the whole set), h and times, one row per shingle that several groups hold. The others,
    ``alone`` of a set's shingles, come first in this order and meet nothing, so that a set with many of its own has a short
    prefix left, or none. Postings stand at place ``at`` of their set.
    """
    lists = shared.groupBy("key", "group", "n").agg(F.sort_array(F.collect_list(F.struct("times", "h"))).alias("order"))
    lists = lists.withColumn("alone", F.col("n") - F.size("order"))
    room = F.expr(f"n - ({STAGE_TENTHS} * n + 9) div 10 + 1 - alone").cast("int")
    lists = lists.withColumn("room", room).filter("room > 0")
    each = lists.select("key", "group", "n", "alone", F.posexplode(F.slice("order", F.lit(1), F.col("room"))).alias("at", "x"))
    return each.select("key", "group", "n", "alone", (F.col("at") + F.col("alone")).alias("at"), "x.h")


def can_reach(n_a: Column, at_a: Column, n_b: Column, at_b: Column) -> Column:
    """Whether sets of these sizes whose first common shingle stands at these places can have the similarity.

    J >= t/10 where the sets share s of their n_a + n_b shingles: 10 s >= t (n_a + n_b - s).
    """
    return (10 + STAGE_TENTHS) * F.least(n_a - at_a, n_b - at_b) >= STAGE_TENTHS * (n_a + n_b)


def leaders(posts: DataFrame) -> DataFrame:
    """For each key one candidate of another group, as pairs (key_a < key_b): the one that it meets in most postings.

    A shingle's leader is the set with the least share of shingles of its own, an original rather than one of its copies.
    """
    far = F.expr("alone * 1000 div n").alias("far")
    best = posts.groupBy("h").agg(F.min(F.struct(far, "key", "group", "n", "at")).alias("x"))
    met = posts.join(best, "h").filter((F.col("group") != F.col("x.group")) & can_reach(F.col("n"), F.col("at"), F.col("x.n"), F.col("x.at")))
    met = met.groupBy("key", F.col("x.key").alias("lead")).agg(F.count(F.lit(1)).alias("times"))
    each = met.groupBy("key").agg(F.max(F.struct("times", "lead")).alias("x"))
    return each.select(F.least("key", "x.lead").alias("key_a"), F.greatest("key", "x.lead").alias("key_b")).distinct()


def jaccard_links(texts: DataFrame) -> DataFrame:
    """Links (a, b) between set keys whose shingle sets have a Jaccard similarity of 0.8 or more, enough of them to connect all
    that are linked by chains.

    ``texts``: key and text, one row per key. SimHash links come first; as no radius covers the similarity, the texts that
    they leave apart are then linked without misses. Of those that can be near another group at all (:func:`crowded`) candidates
    share a shingle of their prefixes, rare shingles first, and can still reach the similarity by their sizes and by what
    follows that shingle. Each is compared by its whole set with one leader; only candidates that no link connects then are made
    into pairs, in an order in which the shingles of one linked group count as its own. So copies of one text that are linked, or
    that have too many words of their own to be near each other, make no pairs, however many they are.
    """
    close = simhash_links(texts)
    known = cut_lineage(components(close).select(F.col("node").alias("key"), "root"))
    texts = texts.join(known, "key", "left").select("key", F.coalesce("root", "key").alias("group"), "text")
    busy = cut_lineage(crowded(texts))
    sets = cut_lineage(mapped(texts.join(busy, "key", "left_semi"), ["key", "group"], lambda h: (h.view(np.int64),), "h array<long>"))
    each = sets.select("key", "group", F.size("h").cast("long").alias("n"), F.explode("h").alias("h"))
    shared = cut_lineage(several_groups(each))
    posts = cut_lineage(rare_first(shared))
    nearest = cut_lineage(leaders(posts))
    first = cut_lineage(close.union(verified(nearest, sets)))
    member = cut_lineage(components(first).select(F.col("node").alias("key"), F.col("root").alias("now")))
    regrouped = shared.drop("times").join(member, "key", "left").withColumn("group", F.coalesce("now", "group")).drop("now")
    left = cut_lineage(rare_first(several_groups(regrouped)))
    discard(shared, posts, busy)
    a, b = (left.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "group", "n", "at")]) for x in "ab")
    reach = can_reach(*[F.col(c) for c in ("n_a", "at_a", "n_b", "at_b")])
    pairs = a.join(b, "h").filter((F.col("key_a") < F.col("key_b")) & (F.col("group_a") != F.col("group_b")) & reach)
    rest = cut_lineage(pairs.select("key_a", "key_b").distinct().join(nearest, ["key_a", "key_b"], "left_anti"))
    second = cut_lineage(verified(rest, sets))
    discard(close, known, sets, nearest, member, left, rest)
    return first.union(second)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each group of near copies: the smallest doc_id.

    Near copies: sets of five-word shingles (ASCII letters in lower case) with a Jaccard similarity of 0.8 or more, chains
    included. Texts without words are copies of each other. A document is a doc_id with a text: of texts under one doc_id that
    are not near copies each stays, rows that agree in both stay once. A row without doc_id stays only where no document of
    its group has one, and then one of them. Fingerprints are compared as in op9, over five-word shingles, and whole sets
    confirm what they link; no radius covers this similarity, so the exact search completes it (:func:`jaccard_links`).
    """
    hashed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    keyed = mapped(hashed, ["doc_id", "text_key"], lambda h: (set_key(h),), "key long")
    rows = cut_lineage(keyed.distinct())
    firsts = rows.groupBy("key").agg(F.min("text_key").alias("text_key"))
    texts = cut_lineage(hashed.select("text_key", "text").join(firsts, "text_key").dropDuplicates(["key"]).select("key", "text"))
    member = components(jaccard_links(texts))
    grouped = rows.join(member.select(F.col("node").alias("key"), "root"), "key", "left")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("least")
    chosen = cut_lineage(grouped.groupBy(F.coalesce("root", "key").alias("group")).agg(least)).select(
        F.col("least.doc_id").alias("_id"), F.col("least.text_key").alias("_chosen")
    )
    discard(rows, texts)
    mine = docs.withColumn("_text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = mine.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_chosen")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_text_key"]).drop("_text_key")


QUERY_COLUMNS = ("doc_id", "fingerprint", "component_id")
