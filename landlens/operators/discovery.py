"""Stratified sample research: lens join, summaries, correlation, queues, paging and stratified picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landlens.functions.labels import CANDIDATE, CAUTION, terrain_label
from landlens.operators.profile import NO_INDEX
from landlens.operators.ranking import ordered_rank, ordered_slice
from landlens.session import cut_lineage, lookup_join

UNKNOWN = "UNKNOWN"
QUEUES = ("convergence", "contradiction", "counterexample", "uncertainty")
QUEUE_LIMITS = {"convergence": 30, "contradiction": 30, "counterexample": 30, "uncertainty": 60}
DEFAULT_PAGE, MAX_PAGE = 20, 50

# Reasons in order.
REASON_WATER = "正確な水形状が未閉鎖"
REASON_SPLIT = "水形状に敏感な反証・不確実地点"
REASON_CATALOG = "凍結カタログが完全接続ではない"
REASON_MOISTURE = "水・湿気の地点レコードがない"
REASON_ENVIRONMENT = "環境の地点レコードがない"
REASON_PLACES = "当該セルに索引候補なし。不存在や安全を意味しない"
REASON_STAGED = "未接続の研究層は別の成熟度を保ったまま追加接続する"
SPLIT_RISK = "HIGH_EXACT_WATER_REQUIRED"


def catalog_class(title: Column) -> Column:
    """Class of a frozen-catalogue title."""
    candidate, caution = (F.lit(t) for t in ("イヤシロチ候補", "ケガレチ候補"))
    return (
        F.when(F.contains(title, candidate), "CANDIDATE")
        .when(F.contains(title, caution), "CAUTION")
        .when(F.coalesce(title, F.lit("")) != "", "ORDINARY_OR_WEAK")
        .otherwise(UNKNOWN)
    )


def catalog_class_of_code(code: Column) -> Column:
    """The same from the label code."""
    return (
        F.when(code == CANDIDATE, "CANDIDATE")
        .when(code == CAUTION, "CAUTION")
        .when(code.isNotNull(), "ORDINARY_OR_WEAK")
        .otherwise(UNKNOWN)
    )


def lens_join(
    samples: DataFrame, catalog: DataFrame, moisture: DataFrame, environment: DataFrame, places: DataFrame
) -> DataFrame:
    """Samples with four per-cell lenses; a sample is never dropped, absent lenses read UNKNOWN or default.

    Each lens has one row per cell; of several, the largest by its columns in order counts, whole. The lenses are stacked
    and folded into one row per cell with a single shuffle, and the samples meet that table in one join.
    """
    parts = {
        "catalog": (catalog, {"catalog_label": "label_code", "catalog_detail": "detail_score"}),
        "moisture": (moisture, {"attention_class": "attention_class", "moisture_confidence": "confidence"}),
        "environment": (
            environment,
            {
                "aggregate_state": "aggregate_state", "robust_candidate": "robust_candidate",
                "share_300m": "share_300m", "share_500m": "share_500m",
            },
        ),
        "places": (places, {"total_links": "total_links", "index_status": "index_status"}),
    }
    stacked = None
    for name, (lens, columns) in parts.items():
        part = lens.select("cell_id", F.struct(*[F.col(c).alias(n) for n, c in columns.items()]).alias(name))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    folded = stacked.groupBy("cell_id").agg(*[F.max(name).alias(name) for name in parts])
    lenses = folded.select("cell_id", *[F.col(f"{name}.{n}") for name, (_, columns) in parts.items() for n in columns])
    joined = lookup_join(samples, lenses, ["cell_id"])
    return joined.select(
        *samples.columns,
        catalog_class_of_code(F.col("catalog_label")).alias("catalog_class"),
        terrain_label(F.col("catalog_label")).alias("catalog_title"),
        "catalog_detail",
        F.coalesce("attention_class", F.lit(UNKNOWN)).alias("moisture_class"),
        F.coalesce("moisture_confidence", F.lit(UNKNOWN)).alias("moisture_confidence"),
        F.coalesce("aggregate_state", F.lit(UNKNOWN)).alias("environment_state"),
        F.coalesce("robust_candidate", F.lit(False)).alias("environment_robust"),
        "share_300m",
        "share_500m",
        F.coalesce("total_links", F.lit(0)).alias("place_links"),
        F.coalesce("index_status", F.lit(NO_INDEX)).alias("place_status"),
        F.lit(False).alias("absence_claim_allowed"),
    )


def stratum_summary(lensed: DataFrame) -> DataFrame:
    """Per stratum: samples, means over known values, robust and indexed counts."""
    return lensed.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg("lens_score").alias("lens_mean"),
        F.avg("catalog_detail").alias("catalog_detail_mean"),
        F.count(F.when(F.col("environment_robust"), 1)).alias("robust_count"),
        F.avg("share_300m").alias("share_300m_mean"),
        F.avg("share_500m").alias("share_500m_mean"),
        F.count(F.when(F.col("place_links") > 0, 1)).alias("indexed_count"),
    )


HISTOGRAMS = ("catalog_class", "moisture_class", "environment_state")


def class_histograms(lensed: DataFrame) -> DataFrame:
    """Class counts per stratum and lens in long form; blank classes count as UNKNOWN."""
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("lens"), F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(UNKNOWN)).alias("class")
            )
            for c in HISTOGRAMS
        ]
    )
    long = lensed.select("stratum", F.explode(entries).alias("e")).select("stratum", "e.*")
    return long.groupBy("stratum", "lens", "class").agg(F.count(F.lit(1)).alias("n"))


def histogram_maps(histograms: DataFrame) -> DataFrame:
    """Long-form histograms to one map per stratum and lens (a few classes each)."""
    entry = F.struct("class", "n")
    return histograms.groupBy("stratum", "lens").agg(F.map_from_entries(F.collect_list(entry)).alias("counts"))


def pearson(df: DataFrame, pairs: list[tuple[str, str]], keys: list[str] | None = None) -> DataFrame:
    """Pearson correlation of column pairs over rows where both are known: (keys, x, y, n, pearson).

    NULL for fewer than three rows or no variance. All pairs and groups come out of one pass of mergeable central
    moments, so the input is read once and a large group is combined before the shuffle.
    """
    keys = keys or []
    moments, rows = [], []
    for i, (x, y) in enumerate(pairs):
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        vx, vy = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
        moments += [
            F.count(vx).alias(f"_n{i}"),
            F.covar_pop(vx, vy).alias(f"_c{i}"),
            F.sqrt(F.var_pop(vx) * F.var_pop(vy)).alias(f"_s{i}"),
        ]
        known = (F.col(f"_n{i}") >= 3) & (F.col(f"_s{i}") != 0)
        rows.append(
            F.struct(
                F.lit(x).alias("x"),
                F.lit(y).alias("y"),
                F.col(f"_n{i}").alias("n"),
                F.when(known, F.try_divide(F.col(f"_c{i}"), F.col(f"_s{i}"))).alias("pearson"),
            )
        )
    return df.groupBy(*keys).agg(*moments).select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, "_r.*")


def frame_counts(lensed: DataFrame) -> DataFrame:
    """One row: samples, municipalities, scored samples, controls and how many samples each lens covers."""
    known = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    return lensed.agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_distinct("municipality").alias("municipalities"),
        F.count("lens_score").alias("eligible"),
        known(F.col("lens_score").isNull(), "controls"),
        known(F.col("catalog_title").isNotNull(), "catalog_available"),
        known(F.col("moisture_class") != UNKNOWN, "moisture_available"),
        known(F.col("environment_state") != UNKNOWN, "environment_available"),
        known(F.col("place_links") > 0, "places_indexed"),
        known(F.col("place_links") <= 0, "places_not_indexed"),
    )


def _queue_flags() -> dict[str, Column]:
    stratum = F.substring("stratum", 1, 2)
    high, low = stratum.isin("A_", "B_"), stratum == "E_"
    candidate, caution = F.col("catalog_class") == "CANDIDATE", F.col("catalog_class") == "CAUTION"
    positive = F.col("environment_robust") | (F.col("environment_state") == "CANDIDATE")
    attention = ~F.col("moisture_class").isin("low", "LOW")
    return {
        "convergence": high & candidate & positive & ~attention,
        "contradiction": high & (caution | (F.col("environment_state") == "CAUTION") | attention),
        "counterexample": low & (candidate | positive),
        "uncertainty": stratum.isin("D_", "F_"),
    }


def research_queues(lensed: DataFrame) -> DataFrame:
    """One row per sample and queue it belongs to; a sample may be in several. Strata go by their leading letter.

    An unknown moisture class counts as attention, because only "low" does not.
    """
    flags = _queue_flags()
    entries = F.array_compact(F.array(*[F.when(flags[q], q) for q in QUEUES]))
    return lensed.withColumn("queue", F.explode(entries))


def queue_items(queued: DataFrame, order: str = "sample_id", limits: dict[str, int] | None = QUEUE_LIMITS) -> DataFrame:
    """First items of each queue in sample order, with the queue's full count; a queue without a limit is an error.

    ``limits=None`` gives all items of all queues, without positions.
    The rank filter limits every input partition before the shuffle, so a long queue never gathers in one task;
    counts are aggregated separately.
    """
    if limits is None:
        return lookup_join(queued, queued.groupBy("queue").agg(F.count(F.lit(1)).alias("queue_count")), ["queue"])
    unknown = F.raise_error(F.concat(F.lit("no limit for the queue "), F.coalesce("queue", F.lit("NULL"))))
    queued = queued.withColumn("queue", F.when(F.col("queue").isin(*limits), F.col("queue")).otherwise(unknown))
    counts = queued.groupBy("queue").agg(F.count(F.lit(1)).alias("queue_count"))
    top = max(limits.values())
    ranked = queued.withColumn("position", F.row_number().over(Window.partitionBy("queue").orderBy(order))).filter(
        F.col("position") <= top
    )
    limit = F
    for name, k in limits.items():
        limit = limit.when(F.col("queue") == name, k)
    return ranked.filter(F.col("position") <= limit).join(counts, "queue")


def queue_reasons(lensed: DataFrame) -> DataFrame:
    """Ordered reasons why a sample needs research."""
    steps = (
        (~F.coalesce("exact_water_closed", F.lit(False)), REASON_WATER),
        (F.coalesce(F.col("split_risk") == SPLIT_RISK, F.lit(False)), REASON_SPLIT),
        (F.col("catalog_title").isNull(), REASON_CATALOG),
        (F.col("moisture_class") == UNKNOWN, REASON_MOISTURE),
        (F.col("environment_state") == UNKNOWN, REASON_ENVIRONMENT),
        (F.col("place_status") == NO_INDEX, REASON_PLACES),
        (F.lit(True), REASON_STAGED),
    )
    reasons = F.array_compact(F.array(*[F.when(cond, text) for cond, text in steps]))
    return lensed.withColumn("reasons", reasons)


def distinct_values(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(municipalities in Japanese order, strata)."""
    towns = samples.select("municipality").distinct().orderBy(F.collate(F.col("municipality"), "ja"))
    return towns, samples.select("stratum").distinct()


def page(df: DataFrame, order: str, offset: int = 0, limit: int = DEFAULT_PAGE) -> DataFrame:
    """One page with ``filtered`` (all rows) and ``next_offset`` (NULL on the last page).

    The rows are split into ranges of the order; the range sizes tell which of them hold the page, and only those are
    sorted, however deep the page lies. Paging happens before any lens is joined: pass the samples first and enrich the page.
    """
    if not 0 <= offset:
        raise ValueError("offset must not be negative")
    _check_limit(limit)
    rows, total = ordered_slice(df, [F.asc(order)], offset, offset + limit)
    shown = F.least(F.lit(offset + limit).cast("bigint"), F.col("filtered"))
    return rows.withColumn("filtered", total).withColumn(
        "next_offset", F.when(shown < F.col("filtered"), shown)
    )


def _check_limit(limit: int) -> None:
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be 1..{MAX_PAGE}")


def page_after(df: DataFrame, order: str, after=None, limit: int = DEFAULT_PAGE) -> DataFrame:
    """The page behind a cursor (the last ``order`` value seen, None: the first page), with ``next_after`` for the next one.

    The comparison reaches the scan, so files and row groups that lie before the cursor are not read, and each task keeps
    ``limit + 1`` rows at most. ``next_after`` is NULL on the last page. ``order`` must be unique and not NULL.
    """
    _check_limit(limit)
    behind = df.filter(F.col(order).isNotNull() if after is None else F.col(order) > F.lit(after))
    rows = cut_lineage(behind.orderBy(order).limit(limit + 1))
    place = rows.withColumn("_at", F.row_number().over(Window.orderBy(order)))
    last = rows.agg(F.when(F.count(F.lit(1)) > limit, F.lit(True)).otherwise(F.lit(False))).scalar()
    shown = place.filter(F.col("_at") <= limit)
    cursor = F.when(last, F.max(order).over(Window.partitionBy()))
    return shown.withColumn("next_after", cursor).drop("_at")


def group_ranks(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """Rank (0-based, highest score first, then smallest ``tie``) and group size without sorting a group in one task.

    Rows are split by (group, score, tie), so neither a group nor a score that most rows have ends up in one task.
    """
    totals = df.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    ranked = ordered_rank(df, [group], [F.desc(score), F.asc(tie)], "rank")
    return lookup_join(ranked.withColumn("rank", F.col("rank") - 1), totals, [group])


def stratified_pick(zones: DataFrame) -> DataFrame:
    """Per municipality five zones: top, upper quartile, median, bottom by score, and the most uncertain one.

    ``zones``: municipality, zone_id, score, uncertainty. Positions are floor(n/4) and floor(n/2) in rank order; the
    uncertain pick is the highest uncertainty (ties: smallest id) and may repeat a ranked one. Small municipalities
    can fill several strata with one zone.
    """
    ranked = group_ranks(zones, "municipality", "score", "zone_id")
    n, r = F.col("group_size"), F.col("rank")
    strata = F.array_compact(
        F.array(
            F.when(r == 0, "A_LOCAL_TOP"),
            F.when(r == F.floor(n / 4), "B_UPPER_QUARTILE"),
            F.when(r == F.floor(n / 2), "C_LOCAL_MEDIAN"),
            F.when(r == n - 1, "E_LOCAL_BOTTOM_CONTROL"),
        )
    )
    by_rank = ranked.withColumn("stratum", F.explode(strata)).select("municipality", "zone_id", "score", "stratum")
    doubtful = (
        zones.groupBy("municipality")
        .agg(F.max_by(F.struct("zone_id", "score"), F.struct("uncertainty", -F.col("zone_id"))).alias("_z"))
        .select("municipality", "_z.zone_id", "_z.score", F.lit("D_UNCERTAINTY_REVIEW").alias("stratum"))
    )
    return by_rank.unionByName(doubtful)


def link_rollup(links: DataFrame) -> DataFrame:
    """Links per cell by lane: the counts of the sparse index."""
    lane = lambda name: F.count(F.when(F.col("index_lane") == name, 1))
    has_feature = F.coalesce(F.col("global_feature_id"), F.lit("")) != ""
    return links.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("total_links"),
        F.count(F.when(has_feature, 1)).alias("global_feature_links"),
        lane("PARENT_SITE_COMPONENT").alias("parent_site_component_links"),
        lane("SOURCE_OBSERVATION").alias("source_observation_links"),
        lane("CURRENT_ANCHOR").alias("current_anchor_links"),
        lane("REFERENCE_CONTEXT").alias("reference_context_links"),
        lane("DUPLICATE_SUPPRESSION").alias("duplicate_suppression_links"),
        lane("OPEN_IDENTITY").alias("open_identity_links"),
        F.count(F.when(F.col("query_status") == "FEATURE_LINK_QUERYABLE", 1)).alias("feature_queryable_links"),
        F.count(F.when(~F.coalesce(F.upper("positive_claim") == "YES", F.lit(False)), 1)).alias("non_positive_links"),
    )
