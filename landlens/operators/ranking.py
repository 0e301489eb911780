"""Ranks and order statistics that do not gather a group in one task: rows are split by the order itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landlens.session import cut_lineage, parallelism


def ordered_parts(
    df: DataFrame, keys: list[str], order: list[Column], weight: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_part``, sizes): rows split into ranges of (keys, order), and per key and part its size ``_n`` and how many
    rows come ``_before`` it, or their summed weights.

    A key that holds most rows is spread over many parts, as the order splits it; the parts are about equal because Spark
    samples the order first. The split is written, so that counts and rows agree whatever is computed again.
    """
    dealt = df.repartitionByRange(parallelism(df.sparkSession), *keys, *order).withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    sizes = dealt.groupBy(*keys, "_part").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return dealt, before


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be NULL; the right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on).drop(*[f"_r_{k}" for k in keys])


def ordered_rank(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Rank of each row within its key, from 1; ``order`` must be total, or equal rows get their ranks in any order."""
    dealt, before = ordered_parts(df, keys, order)
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    ranked = dealt.withColumn("_row", F.row_number().over(within))
    joined = null_safe(ranked, before.drop("_n"), [*keys, "_part"])
    return joined.withColumn(name, (F.col("_row") + F.col("_before")).cast("int")).drop("_row", "_before", "_part")


def ordered_slice(df: DataFrame, order: list[Column], start: int, stop: int) -> tuple[DataFrame, Column]:
    """(rows at the places start to stop - 1 of a total order, number of all rows); only the ranges that hold them are sorted."""
    dealt, before = ordered_parts(df, [], order)
    before = cut_lineage(before)
    within = Window.partitionBy("_part").orderBy(*order)
    wanted = before.filter((F.col("_before") < stop) & (F.col("_before") + F.col("_n") > start))
    rows = dealt.join(wanted, "_part").withColumn("_at", F.row_number().over(within) - 1 + F.col("_before"))
    return rows.filter(F.col("_at").between(start, stop - 1)).drop("_part", "_n", "_before", "_at"), before.agg(F.coalesce(F.sum("_n"), F.lit(0))).scalar()
