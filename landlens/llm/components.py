"""Connected components of a link table by alternating star steps; no group is gathered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlens.session import cut_lineage, discard


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b): root is the smallest node it reaches, itself included.

    Large-star and small-star steps in turn keep the components, point every node at ever smaller neighbours and end when
    nothing changes, after a number of rounds that grows with the logarithm of the longest path. Each round is written
    to the shared folder. Nulls and loops are ignored; repeated links count once.
    """
    pairs = cut_lineage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    size = pairs.count()
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        stars = small.union(low.select("u", F.col("m").alias("v"))).select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        before, pairs = pairs, cut_lineage(stars.distinct())
        last, size = size, pairs.count()
        settled = size == last and pairs.join(before, ["u", "v"], "left_anti").isEmpty()
        discard(before)
        if settled:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
