"""Hard-negative mining by threshold joins over an inverted index with norm bounds.

Anchors meet all rows in blocks. A task holds one block of rows as an inverted index: per dimension the rows and their values.
Where the norm of a row's last dimensions, times the anchors' norm there, stays below the lowest threshold asked for, these
dimensions are left out of the lists, as no row can reach a threshold by them alone. Partial scores are accumulated list by
list; a row whose partial score plus the product of the remaining norms stays below the anchor's threshold is dropped, and
what is left is scored exactly.

The positives of an anchor start from the threshold that one block of its label proves. The windows of negatives start from a
high threshold, which is lowered, for the anchors with unfilled windows only, until it reaches the windows' lower ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from landlens.session import cut_lineage

POSITIVES = 5
NEGATIVES = 5
#: Anchors are the rows whose vec_id is divisible by this.
EVERY = 100
#: A component c counts as the whole number floor(SCALE c).
SCALE = 256
#: A negative's score lies between LOW / HIGH of the positive's score and the positive's score.
LOW, HIGH = 80, 100
#: Thresholds of the rounds, in hundredths of the positive's score; the last round goes down to LOW.
STARTS = (95, 88)
#: Rows and anchors that meet in one task.
ROWS = 8_192
QUERIES = 8_192
#: Dimensions between two looks at the bounds.
STEP = 8
#: Components of this size or more are not exact here; their rows take no part, like those with non-finite ones.
LIMIT = 2.0**18
UNBOUNDED = np.iinfo(np.int64).min


def whole_rows(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, x (whole components), h (hash of label and x) of the rows that take part, one per vec_id."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT))
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(scale))))
    rows = vectors.filter(good & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    one = rows.groupBy("vec_id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), x.alias("x"))).alias("r"))
    return one.select("vec_id", "r.label", "r.x", F.xxhash64("r.label", "r.x").alias("h"))


def matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter ones are filled up with zeros."""
    lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), place] = lists.flatten().to_numpy()
    return out


def width_of(*columns: pa.ChunkedArray) -> int:
    return max([0, *(int(np.diff(c.combine_chunks().offsets.to_numpy()).max(initial=0)) for c in columns if len(c))])


class Index:
    """An inverted index over one block of rows for anchors whose thresholds are at least ``lowest``."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray, lowest: float) -> None:
        self.rows, self.anchors = rows, anchors
        d = rows.shape[1]
        # dimensions with much weight first, so that what remains shrinks fast
        by_weight = np.argsort(-(rows.astype(float) ** 2).sum(axis=0), kind="stable")
        b, self.a = rows[:, by_weight].astype(float), anchors[:, by_weight].astype(float)
        self.cuts = [*range(0, d, STEP), d]
        tail = lambda m: np.sqrt(np.array([(m[:, c:] ** 2).sum(axis=1) for c in self.cuts]))
        rest, self.rest_a = tail(b), tail(self.a)
        # a row's lists end where all that follows cannot make up the lowest threshold
        strong = rest * self.rest_a.max(axis=1, initial=0.0)[:, None] * (1 + 1e-9) >= lowest
        parts = strong.sum(axis=0) if lowest > 0 else np.full(len(b), len(self.cuts) - 1)
        parts = np.minimum(parts, len(self.cuts) - 1)
        self.order = np.argsort(-parts, kind="stable")
        self.parts = parts[self.order]
        self.rest = rest[:, self.order]
        self.lists = np.ascontiguousarray(b[self.order].T)
        self.listed = [int(np.searchsorted(-self.parts, -k, side="left")) for k in range(len(self.cuts) - 1)]

    def reaching(self, q: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and exact scores of all rows whose score with anchor ``q`` is at least the threshold."""
        a, n = self.a[q], len(self.order)
        if threshold == UNBOUNDED:
            return np.arange(n), self.rows @ self.anchors[q]
        slack = 1e-9 * (1 + self.rest_a[0, q] * self.rest[0].max(initial=0.0))
        partial, live = np.zeros(n), np.arange(n)
        for k, (start, end) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            listed = self.listed[k]
            if len(live) > n // 4:  # along the lists
                partial[:listed] += a[start:end] @ self.lists[start:end, :listed]
            else:  # of the few that are left
                some = live[live < listed]
                partial[some] += a[start:end] @ self.lists[start:end, some]
            # what is not accumulated yet: all after this part, or all after the row's own lists
            at = np.minimum(k + 1, self.parts[live])
            left = self.rest[at, live] * self.rest_a[at, q]
            live = live[partial[live] + left + slack >= threshold]
            if not len(live):
                break
        places = self.order[live]
        scores = self.rows[places] @ self.anchors[q]
        good = scores >= threshold
        return places[good], scores[good]


def first(places: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the first k by falling score, ties by smaller id."""
    if len(places) > 4 * k:
        good = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        places, scores = places[good], scores[good]
    best = np.lexsort((ids[places], -scores))[:k]
    return ids[places[best]], scores[best]


def longs(names: tuple, columns: list[list[np.ndarray]]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate([*c, np.zeros(0, np.int64)]), pa.int64()) for n, c in zip(names, columns, strict=True)})


def close_positives(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """Per anchor the first k rows of the block (all of one label) that reach its threshold."""
    width = width_of(rows.column("x"), anchors.column("x"))
    ids = rows.column("vec_id").to_numpy()
    limits = anchors.column("threshold").to_numpy()
    index = Index(matrix(rows.column("x"), width), matrix(anchors.column("x"), width), float(limits.min(initial=np.iinfo(np.int64).max)))
    out = [[], [], []]
    for q, qid in enumerate(anchors.column("qid").to_numpy()):
        best, scores = first(*index.reaching(q, limits[q]), ids, k)
        out[0].append(np.full(len(best), qid))
        out[1].append(best)
        out[2].append(scores)
    return longs(("qid", "id", "score"), out)


def close_negatives(rows: pa.Table, anchors: pa.Table, k: int) -> pa.Table:
    """Per anchor and window the first k rows of other labels whose score is in the window and reaches its threshold."""
    width = width_of(rows.column("x"), anchors.column("x"))
    ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
    windows = anchors.column("windows").to_pylist()
    limits = np.array([min(w["threshold"] for w in ws) for ws in windows], dtype=np.int64)
    index = Index(matrix(rows.column("x"), width), matrix(anchors.column("x"), width), float(limits.min(initial=np.iinfo(np.int64).max)))
    mine = anchors.column("label").to_numpy()
    out = [[], [], [], []]
    for q, qid in enumerate(anchors.column("qid").to_numpy()):
        places, scores = index.reaching(q, limits[q])
        other = labels[places] != mine[q]
        places, scores = places[other], scores[other]
        for w in windows[q]:
            inside = (scores >= w["threshold"]) & (scores <= w["top"])
            best, found = first(places[inside], scores[inside], ids, k)
            out[0].append(np.full(len(best), qid))
            out[1].append(np.full(len(best), w["top"]))
            out[2].append(best)
            out[3].append(found)
    return longs(("qid", "top", "id", "score"), out)


def tile(key: Column, tiles: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), tiles).cast("int")


def meet(rows: DataFrame, anchors: DataFrame, how, schema: str, *, only_home: bool = False) -> DataFrame:
    """``how`` on every block of rows with every block of anchors of the same ``part``; only with one block if so wished.

    Both sides carry ``part`` and the numbers of blocks of their part: ``row_tiles`` and ``anchor_tiles``.
    """
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    columns = [c for c in anchors.columns if c not in {"row_tiles", "anchor_tiles"}]
    at = tile(F.col("qid"), F.col("anchor_tiles"), 1).alias("at")
    met = F.explode(F.array(tile(F.col("qid"), F.col("row_tiles"), 2)) if only_home else every("row_tiles")).alias("rt")
    left = rows.select("part", "vec_id", "label", "x", tile(F.col("vec_id"), F.col("row_tiles"), 3).alias("rt"),
                       F.explode(every("anchor_tiles")).alias("at"))
    right = anchors.select(*columns, at, met)

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return how(a, b)

    return left.groupBy("part", "rt", "at").cogroup(right.groupBy("part", "rt", "at")).applyInArrow(run, schema)


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def tiles(frame: DataFrame, size: int, name: str) -> DataFrame:
    return frame.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))


def find_positives(base: DataFrame, classes: DataFrame, k: int, rows: int, queries: int) -> DataFrame:
    """qid, id, score, rank: the first k rows of each anchor's label."""
    base, classes = base.withColumn("part", F.col("label")), classes.withColumn("part", F.col("label"))
    sizes = cut_lineage(tiles(base, rows, "row_tiles").join(tiles(classes, queries, "anchor_tiles"), "part"))
    base, classes = base.join(sizes, "part"), classes.join(sizes, "part")
    schema = "qid long, id long, score long"
    search = lambda a, b: close_positives(a, b, k)
    home = meet(base, classes.withColumn("threshold", F.lit(UNBOUNDED)), search, schema, only_home=True)
    proven = home.groupBy("qid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    threshold = F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(UNBOUNDED))
    proven = cut_lineage(proven.select("qid", threshold.alias("threshold")))
    asked = classes.join(proven, "qid", "left").withColumn("threshold", F.coalesce("threshold", F.lit(UNBOUNDED)))
    return ranked(meet(base, asked, search, schema), ["qid"], k)


def whole_share(percent: int) -> Column:
    """The smallest whole number that is at least ``percent`` hundredths of the window's upper end, which is not negative."""
    return F.expr(f"({percent} * top + {HIGH - 1}) div {HIGH}")


def find_negatives(base: DataFrame, classes: DataFrame, tops: DataFrame, k: int, rows: int, queries: int) -> DataFrame:
    """qid, top, id, score, rank: the first k rows of other labels in each window; ``tops``: qid and the window's upper end.

    A window is full with k rows above its threshold, as no row below can come before them; the others are asked again.
    """
    tiled = lambda frame, size, name: frame.withColumns(
        {"part": F.lit(0).cast("long"), name: F.lit(max(1, -(-frame.count() // size)))}
    )
    base = tiled(base, rows, "row_tiles")
    row_tiles = base.select("row_tiles").first()
    low, waiting, done = whole_share(LOW), tops, None
    for share in (*STARTS, LOW):
        start = F.greatest(whole_share(share), low)
        windows = waiting.groupBy("qid").agg(F.collect_list(F.struct("top", start.alias("threshold"))).alias("windows"))
        asked = tiled(cut_lineage(classes.join(windows, "qid")), queries, "anchor_tiles")
        anchor_tiles = asked.select("anchor_tiles").first()
        if anchor_tiles is None or row_tiles is None:
            break
        found = meet(
            base.withColumn("anchor_tiles", F.lit(anchor_tiles[0])), asked.withColumn("row_tiles", F.lit(row_tiles[0])),
            lambda a, b: close_negatives(a, b, k), "qid long, top long, id long, score long",
        )
        best = cut_lineage(ranked(found, ["qid", "top"], k))
        filled = best.groupBy("qid", "top").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        waiting = cut_lineage(waiting.filter(start > low).join(filled, ["qid", "top"], "left_anti"))
        settled = best.join(waiting, ["qid", "top"], "left_anti")
        done = settled if done is None else done.union(settled)
        if waiting.isEmpty():
            break
    return done


def hard_negatives(
    vectors: DataFrame, *, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE,
    rows: int = ROWS, queries: int = QUERIES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: one row per anchor, positive and negative.

    Columns used: vec_id, label (a whole number), embedding; others are ignored. Rows with a null vec_id, label or vector, or
    with null, non-finite or huge (2^18) components take no part. Of rows with one vec_id one takes part (the smallest by label
    and components). A shorter vector counts as filled up with zeros, an empty one scores zero with all. Of equal
    vectors of one label only the first by vec_id can be among an anchor's first few rows, so only these are compared; equal
    anchors of one label are searched for once. Tables without rows or anchors give no rows.
    """
    all_rows = cut_lineage(whole_rows(vectors, scale))
    copies = Window.partitionBy("h", "label", "x").orderBy("vec_id")
    base = all_rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= max(positives + 1, negatives))
    base = cut_lineage(base.select("vec_id", "label", "x"))
    anchors = all_rows.filter(F.col("vec_id") % every == 0)
    classes = cut_lineage(anchors.groupBy("h", "label", "x").agg(F.min("vec_id").alias("qid")))
    named = anchors.join(classes, ["h", "label", "x"]).select(F.col("vec_id").alias("anchor_id"), "qid")
    classes = classes.select("qid", "label", "x")
    # one more than wanted, as an anchor is among the rows of its own label
    near = cut_lineage(find_positives(base, classes, positives + 1, rows, queries))
    tops = near.filter("score >= 0").select("qid", F.col("score").alias("top")).distinct()
    far = find_negatives(base, classes, tops, negatives, rows, queries)
    kind = "array<struct<rank:int,id:long,score:long>>"
    if far is None:
        far = near.sparkSession.createDataFrame([], "qid long, top long, id long, score long, rank int")
    windows = far.groupBy("qid", "top").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("negatives"))
    pairs = near.join(windows.withColumnRenamed("top", "score"), ["qid", "score"], "left")
    pair = F.struct("rank", "id", "score", F.coalesce("negatives", F.array().cast(kind)).alias("negatives"))
    mined = pairs.groupBy("qid").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    others = F.slice(F.filter("pairs", lambda p: p["id"] != F.col("anchor_id")), 1, positives)
    each = named.join(mined, "qid").select("anchor_id", F.explode(others).alias("p"))
    return each.select("anchor_id", "p.id", "p.score", F.explode("p.negatives").alias("n")).select(
        "anchor_id", F.col("id").alias("positive_id"), F.col("n.rank").alias("rank"), F.col("n.id").alias("negative_id"),
        F.col("score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )


def moved_labels(vectors: DataFrame) -> DataFrame:
    """The table that the registered query mines: every seventh row moves to the next of ten labels."""
    label = F.col("label").cast("long")
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


QUERY_COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same,
         CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), r AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (
           PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
"""
