"""Listings as a stream: gates, decisions and a static join with the town table.

Everything here is stateless, so late data and watermarks play no part; a restart continues from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from landlens.functions.labels import comparison_label
from landlens.functions.text import normalize_town
from landlens.operators.market import finite, policy_gates


def assess_stream(listings: DataFrame, towns: DataFrame) -> DataFrame:
    """Assessed listings with the aggregate of their exact town (a stream cannot take the containment match's
    distinct texts; batch uses :func:`landlens.plans.listings.assess_listings`)."""
    keyed = policy_gates(listings).withColumn("town_key", normalize_town(F.col("town")))
    joined = keyed.join(towns, "town_key", "left")
    pct = F.try_divide(finite(F.col("total")) - F.col("median_total"), F.col("median_total"))
    return joined.withColumn("difference_pct", pct).withColumn("comparison", comparison_label(pct))


def write_assessments(assessed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append assessed listings as parquet; processes what is available and stops."""
    return (
        assessed.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
