"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every document gets a 60-bit hash. Per source, a histogram of the tokens by the leading hash bits shows in which bucket the
budget is reached; only that bucket is divided further, until single hashes are told apart. The threshold found this way
keeps the documents with a smaller hash, so nothing is sorted and thresholds of growing budgets are nested.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landlens.llm.common import count_words
from landlens.session import cut_lineage

HASH_BITS = 60
LEVEL_BITS = 12
FAN = 1 << LEVEL_BITS


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key's text (null: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Targets by source: ``share`` of all tokens dealt by weight, none above ``cap`` times its source.

    ``sizes`` has source and source_size, one row each. The excess of a capped source goes to the others by weight; with
    the sources in ascending order of cap / weight the capped ones are a prefix, so one pass of running sums settles it.
    The running sums see one row per source.
    """
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order - 1) % len(weights) + 1)
    capped = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    everything = Window.partitionBy()
    level = (
        F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = capped.withColumn("level", level)
    # the level rises over the capped sources and falls once an uncapped one is treated as capped
    return levels.withColumn("free", F.max("level").over(everything)).select(
        "source", "source_size", F.least("cap", F.col("free") * F.col("weight")).alias("target")
    )


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the hash threshold below which the sizes add up nearest to the budget.

    ``sized``: source, size, hash; ``budgets``: source, budget. One pass per level over the rows of the boundary buckets;
    each histogram has at most 4096 rows per source.
    """
    state = budgets.withColumn("prefix", F.lit(0).cast("long")).withColumn("next", F.lit(None).cast("long"))
    for level in range(HASH_BITS // LEVEL_BITS):
        above = HASH_BITS - LEVEL_BITS * level
        here = state.select(F.col("source").alias("_source"), "prefix")
        histogram = (
            sized.join(here, F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("hash", above) == F.col("prefix")))
            .groupBy("source", (F.shiftright("hash", above - LEVEL_BITS) % FAN).alias("bucket"))
            .agg(F.sum("size").alias("size"))
        )
        running = Window.partitionBy("source").orderBy("bucket")
        summed = histogram.withColumn("upto", F.sum("size").over(running)).select(
            F.col("source").alias("_source"), "bucket", "size", "upto"
        )
        over = (
            summed.join(state.select("source", "budget"), F.col("source").eqNullSafe(F.col("_source")))
            .groupBy("source")
            .agg(
                F.min(F.when(F.col("upto") > F.col("budget"), F.col("bucket"))).alias("bucket"),
                F.min(F.when(F.col("upto") > F.col("budget"), F.col("upto") - F.col("size"))).alias("below"),
                F.min_by("size", F.when(F.col("upto") > F.col("budget"), F.col("bucket"))).alias("next"),
            )
            .select(F.col("source").alias("_source"), "bucket", "below", F.when(F.col("bucket").isNotNull(), F.col("next")).alias("next"))
        )
        fits = F.lit(FAN) if level == 0 else F.lit(0)
        state = cut_lineage(
            state.drop("next").join(over, F.col("source").eqNullSafe(F.col("_source")), "left").select(
                "source",
                (F.col("budget") - F.coalesce("below", F.lit(0))).alias("budget"),
                (F.col("prefix") * FAN + F.coalesce(F.col("bucket"), fits)).alias("prefix"),
                "next",
            )
        )
    # the boundary hash itself goes in where that comes nearer to the budget
    nearer = F.coalesce(F.col("next") < 2 * F.col("budget"), F.lit(False))
    return state.select("source", (F.col("prefix") + nearer.cast("long")).alias("threshold"))


def decide(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Per source (column _source): source_size, target, how often it is taken whole, and the threshold for one time more."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, share, cap))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    planned = cut_lineage(targets.withColumn("times", times))
    budgets = planned.select("source", (F.col("target") - F.col("times") * F.col("source_size")).alias("budget"))
    limit = thresholds(sized, budgets).select(F.col("source").alias("_limited"), "threshold")
    return cut_lineage(
        planned.join(limit, F.col("source").eqNullSafe(F.col("_limited"))).select(
            F.col("source").alias("_source"), "source_size", "target", F.col("times").alias("_times"), F.col("threshold").alias("_threshold")
        )
    )


def with_size(docs: DataFrame, size: Column | None) -> DataFrame:
    size = count_words(F.col("text")) if size is None else size
    return cut_lineage(docs.select("doc_id", "source", size.cast("long").alias("size"), hash60(F.col("doc_id")).alias("hash")))


def mix(
    docs: DataFrame,
    *,
    size: Column | None = None,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """How many tokens of each document the mix takes; one row per input row.

    Columns used: doc_id, source and, unless ``size`` is given, text (its words are the tokens). Sources are taken in order
    of their code points, null last, and get the ``weights`` in turn. A source whose target exceeds its size is taken whole
    as often as it fits; the rest goes to documents under the hash threshold, so no document exceeds ``cap`` rounded up
    times its size and a source misses its target by at most half a document (or group of rows with one doc_id).
    Null text: size 0. Null doc_id: one more hash. Repeated rows are taken or left together. Empty input: no rows.
    Other columns are ignored. Returns doc_id, source, size, source_size, target, taken.
    """
    sized = with_size(docs, size)
    chosen = decide(sized, weights, share, cap)
    extra = (F.col("hash") < F.col("_threshold")).cast("long")
    return sized.join(chosen, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("_times") + extra)).alias("taken")
    )


def resample(
    docs: DataFrame,
    *,
    size: Column | None = None,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    cap: float = 2.0,
) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it; rules and edge cases as for ``mix``."""
    chosen = decide(with_size(docs, size), weights, share, cap)
    copies = F.col("_times") + (hash60(F.col("doc_id")) < F.col("_threshold")).cast("long")
    return (
        docs.join(chosen, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_copies", copies)
        .filter("_copies > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
        .select(*[docs[c] for c in docs.columns])
    )


QUERY_COLUMNS = ("doc_id", "size", "source_size", "target", "taken")

SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
capped AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight,
         2e0 * source_size AS cap FROM sizes),
levels AS (
  SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0e0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0e0)) AS level
  FROM capped WINDOW b AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels),
planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM targets),
running AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.times, p.target - p.times * p.source_size AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.hash) AS together
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (times + CASE WHEN upto <= budget OR upto - together <= budget AND together < 2 * (budget - (upto - together)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""
