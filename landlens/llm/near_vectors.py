"""Embedding near-dedup through a pivot-permutation index.

A bounded sample of vectors serves as pivots. Every vector is described by its nearest pivots in order of distance. The
inverted lists hold, for each pair of pivots, the vectors that have both among their nearest; two vectors of one list are a
candidate pair, are counted by the pivots they share, and are verified by their cosine. A candidate pair is looked at only in
the list of its two smallest shared pivots, so nothing is counted twice and no pair leaves its task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlens.llm.components import components
from landlens.llm.simhash import Forest
from landlens.session import cut_lineage

COSINE = 0.95
#: Pivots: bounded sample (by hash of the vector), and how many nearest ones describe a vector.
PIVOTS = 128
NEAREST = 8
#: Pivots that two vectors share at least before they are compared.
SHARED = 2
#: Vectors of one list compared at a time; a longer list is dealt over tile pairs.
TILE = 1024
EDGE = 1e-9


def usable(vector: np.ndarray | None) -> bool:
    return vector is not None and len(vector) > 0 and bool(np.isfinite(vector).all()) and bool((vector != 0).any())


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, first by their largest component so that squares cannot overflow."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles; null where it is null, empty, zero or holds null or non-finite components."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", F.when(F.coalesce(good, F.lit(False)), v).alias("v"))


def describe(distinct: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """gid, v, near (the nearest pivots, ascending numbers): one row per distinct vector."""
    nearest = min(nearest, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            out = np.zeros((len(sizes), nearest), dtype=np.int32)
            if len(sizes):
                starts = np.concatenate([[0], np.cumsum(sizes)])
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    block = unit(flat[starts[rows][:, None] + np.arange(size)])
                    width = min(size, pivots.shape[1])
                    close = block[:, :width] @ pivots[:, :width].T
                    out[rows] = np.sort(np.argsort(-close, axis=1, kind="stable")[:, :nearest], axis=1)
            near = pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * nearest, pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, near], ["gid", "v", "near"])

    return distinct.select("gid", "v").mapInArrow(run, "gid long, v array<double>, near array<int>")


def masks(near: np.ndarray, pivots: int) -> np.ndarray:
    bits = np.zeros((len(near), pivots), dtype=bool)
    bits[np.arange(len(near))[:, None], near] = True
    return np.packbits(np.pad(bits, ((0, 0), (0, -pivots % 64))), axis=1, bitorder="little").view(np.uint64)


def compare_list(key: tuple, table: pa.Table, pivots: int, cosine: float, shared: int) -> pa.Table:
    """Verified links within one list (or a pair of its tiles): per vector the linked rows, and a spanning forest."""
    first, second = key[0].as_py(), key[1].as_py()
    gid = table.column("gid").to_numpy()
    side = table.column("side").to_numpy()
    rows = table.column("rows").to_numpy()
    sizes = table.column("v").combine_chunks()
    size = np.diff(sizes.offsets.to_numpy())
    empty = pa.table({"gid": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    if len(gid) < 2:
        return empty
    width = int(size.max())
    block = np.zeros((len(gid), width))
    starts = np.concatenate([[0], np.cumsum(size)])
    flat = sizes.flatten().to_numpy()
    for n in np.unique(size):
        some = np.flatnonzero(size == n)
        block[some, :n] = flat[starts[some][:, None] + np.arange(n)]
    block = unit(block)
    near = table.column("near").combine_chunks()
    mask = masks(near.flatten().to_numpy().reshape(len(gid), -1), pivots)
    below = np.zeros(pivots + (-pivots % 64), dtype=bool)
    below[:second] = True
    below[first] = False
    # a pair belongs here if it shares no smaller pivot than the two of this list
    smaller = np.packbits(below, bitorder="little").view(np.uint64)
    links = np.zeros(len(gid), dtype=np.int64)
    forest = Forest(len(gid))
    same_size = size[:, None] == size[None, :] if len(np.unique(size)) > 1 else None
    for at in range(0, len(gid), 256):
        part = slice(at, at + 256)
        cos = block[part] @ block.T
        good = cos >= cosine - EDGE
        good &= np.arange(len(gid))[None, :] > np.arange(at, min(at + 256, len(gid)))[:, None]
        good &= (side[part, None] != side[None, :]) | (side[part, None] == 2)
        if same_size is not None:
            good &= same_size[part]
        i, j = np.nonzero(good)
        i += at
        both = mask[i] & mask[j]
        keep = (np.bitwise_count(both).sum(axis=1) >= shared) & ((both & smaller) == 0).all(axis=1)
        i, j = i[keep], j[keep]
        close = np.abs(cos[i - at, j] - cosine) <= EDGE
        if close.any():  # at the edge the order of additions decides: compare by exact sums
            exact = np.array([math.fsum(block[x] * block[y]) >= cosine for x, y in zip(i[close], j[close], strict=True)])
            drop = np.zeros(len(i), dtype=bool)
            drop[np.flatnonzero(close)[~exact]] = True
            i, j = i[~drop], j[~drop]
        np.add.at(links, i, rows[j])
        np.add.at(links, j, rows[i])
        forest.add(i, j)
    hit = np.flatnonzero(links)
    return pa.table({"gid": gid[hit], "links": links[hit], "root": gid[forest.roots()[hit]]})


def near_vectors(
    vectors: DataFrame, *, cosine: float = COSINE, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, tile: int = TILE
) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector; one row per input row.

    Columns used: vec_id, embedding; others are ignored. Equal vectors are one entry of the index and linked with each other
    without comparison. Null, empty, zero and non-finite vectors link with nothing and are components of their own, as are
    vectors of another length. Repeated rows are vectors like any other (n_links counts rows); a null vec_id is never
    the smallest of a component unless it is alone. Empty input gives no rows.
    """
    rows = cut_lineage(clean(vectors).withColumn("hash", F.xxhash64("v")))
    groups = cut_lineage(
        rows.filter("v IS NOT NULL").groupBy("hash", "v").agg(F.count(F.lit(1)).alias("rows"), F.min("vec_id").alias("first"))
        .withColumn("gid", F.xxhash64("v", F.lit(1)))
    )
    sample = [r["v"] for r in groups.orderBy("gid").limit(pivots).collect()]
    alone = rows.select("vec_id", "hash", "v")
    if not sample:
        return alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = max(map(len, sample))
    centre = unit(np.array([[*v, *[0.0] * (width - len(v))] for v in sample]))
    shared = min(shared, len(sample))
    described = describe(groups, centre, nearest).join(groups.select("gid", "rows"), "gid")
    pick = F.col("near")
    pairs = F.flatten(F.transform(pick, lambda a, i: F.transform(F.slice(pick, i + 2, nearest), lambda b: F.struct(a.alias("p"), b.alias("q")))))
    pairs = F.when(F.size(pick) > 1, pairs).otherwise(F.array(F.struct(F.get(pick, 0).alias("p"), F.get(pick, 0).alias("q"))))
    table = cut_lineage(described)
    postings = table.select("gid", F.explode(pairs).alias("k")).select("gid", "k.p", "k.q")
    lists = cut_lineage(
        postings.groupBy("p", "q").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("p", "q", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    )
    mine = F.pmod(F.xxhash64("gid", F.lit(2)), F.col("tiles")).cast("int")
    spread = postings.join(lists, ["p", "q"]).withColumn("mine", mine).select(
        "gid", "p", "q",
        F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(
            F.least(o, F.col("mine")).alias("a"), F.greatest(o, F.col("mine")).alias("b"),
            F.when(o == F.col("mine"), 2).when(o < F.col("mine"), 1).otherwise(0).alias("side"),
        ))).alias("t"),
    )
    full = spread.select("gid", "p", "q", "t.a", "t.b", "t.side").join(table, "gid")
    n = len(sample)
    found = cut_lineage(
        full.groupBy("p", "q", "a", "b").applyInArrow(
            lambda key, t: compare_list(key, t, n, cosine, shared), "gid long, links long, root long"
        )
    )
    counts = found.groupBy("gid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("gid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("gid"), "root")
    grouped = groups.select("hash", "v", "gid", "rows", "first").join(counts, "gid", "left").join(roots, "gid", "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "gid"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component"))
    classes = cut_lineage(
        grouped.join(least, "root").select(
            F.col("gid").alias("_gid"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("links"), "component"
        )
    )
    return (
        rows.select("vec_id", F.when(F.col("v").isNotNull(), F.xxhash64("v", F.lit(1))).alias("gid"))
        .join(classes, F.col("gid") == F.col("_gid"), "left")
        .select(
            "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


QUERY_COLUMNS = ("vec_id", "n_links", "component_id", "kept")
