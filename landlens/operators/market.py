"""Rental listings: policy gates and decisions, town aggregates, town context and macro benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landlens.functions.labels import comparison_label
from landlens.functions.text import normalize_town, trimmed
from landlens.operators.ranking import null_safe, ordered_parts
from landlens.session import cut_lineage, lookup_join, spread

# Policy limits and sample-quality limits.
MAX_TOTAL = 170_000.0
MIN_AREA = 15.0
FLOORS = (1.0, 2.0, 3.0)
ROBUST_UNITS, ROBUST_BUILDINGS = 15, 8
REVIEW_UNITS, REVIEW_BUILDINGS = 5, 3
TARGET_UNITS, TARGET_BUILDINGS = 30, 15

# Gates in order (id, label, threshold text, pass text, fail text, hard).
GATES = (
    ("monthly_total", "月の固定費", "170,000円以下", "家賃と管理費などの固定費が上限内です。", "月の固定費が17万円を超えています。", True),
    ("area", "広さ", "15㎡以上", "最低面積を満たしています。", "15㎡未満です。", True),
    ("floor", "階数", "1階・2階・3階", "希望する階数です。", "1〜3階ではありません。", True),
    ("fixed_per_sqm", "固定費の㎡単価", "参考表示のみ", "比較用の参考値です。V3では除外条件に使いません。", "比較用の参考値です。", False),
)
HARD_UNKNOWN = "値が未入力のため判定できません。"
SOFT_UNKNOWN = "値が未入力のため参考値を計算できません。"

# Next actions in order.
ACTION_INPUT = "家賃・管理費・広さ・階数の不足項目を埋める"
ACTION_ADDRESS = "住所または町丁目を入れ、内部募集サンプルと外部公式統計を確認する"
ACTION_NO_SAMPLE = "この町丁目は内部標本がないため、外部公式統計と追加掲載から相場を補う"
ACTION_THIN = "町丁目標本が薄いため、周辺地域・外部公式統計・追加掲載を併用する"
ACTION_IDENTITY = "建物名・住所・号室が同じ部屋を指しているか確認する"
ACTION_CURRENT = "現在も募集されているか、申込み可能かを確認する"
ACTION_LAND = "住所を100mセルへつなぎ、土地研究の未調査・注意事項を確認する"
ACTION_COST = "総初期費用・契約条件・入居可能日を確認する"
ACTION_KEEP = "条件外として保管し、市場や地域研究の参考データにだけ使う"

# Market notes.
NOTE_THIN = "標本が薄いため、この町丁目だけで高い・安いを断定しません。"
NOTE_REVIEW = "方向感には使えますが、追加掲載と外部公式統計で補強します。"

OUTSIDE, NEEDS_INPUT = "OUTSIDE_POLICY", "NEEDS_INPUT"
RECHECK, READY = "POLICY_PASS_RECHECK_REQUIRED", "READY_FOR_LAND_CHECK"


def finite(value: Column) -> Column:
    """NaN and infinities count as unknown."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def market_key(town: Column, matched_address: Column, address: Column) -> Column:
    """Text that names the town: the town itself, else the matched address, else the address."""
    return F.coalesce(trimmed(town), trimmed(matched_address), trimmed(address))


def policy_gates(listings: DataFrame) -> DataFrame:
    """Add per-square-metre price, the gate statuses, ``decision_state`` and the hard-gate summary.

    Listings carry ``total, area, floor_no`` and optionally ``currentness, identity_state``. Row-wise only, so the
    same call serves batch and streaming.
    """
    total, area, floor = finite(F.col("total")), finite(F.col("area")), finite(F.col("floor_no"))
    per_sqm = F.when(area > 0, F.try_divide(total, area))
    status = lambda value, ok: F.when(value.isNull(), "unknown").when(ok, "pass").otherwise("fail")
    out = listings.select(
        "*",
        per_sqm.alias("per_sqm"),
        status(total, total <= MAX_TOTAL).alias("gate_total"),
        status(area, area >= MIN_AREA).alias("gate_area"),
        status(floor, floor.isin(*FLOORS)).alias("gate_floor"),
        status(per_sqm, F.lit(True)).alias("gate_per_sqm"),
    )
    hard = ("gate_total", "gate_area", "gate_floor")
    any_of = lambda what: F.greatest(*[F.col(g) == what for g in hard])
    out = out.withColumn("any_fail", any_of("fail")).withColumn("any_unknown", any_of("unknown"))
    ready = (F.coalesce("currentness", F.lit("unknown")) == "confirmed") & (
        F.coalesce("identity_state", F.lit("unknown")) == "exact"
    )
    return out.withColumn(
        "decision_state",
        F.when(F.col("any_fail"), OUTSIDE).when(F.col("any_unknown"), NEEDS_INPUT).when(ready, READY).otherwise(RECHECK),
    ).withColumn("policy_pass", ~F.col("any_fail") & ~F.col("any_unknown"))


def gate_rows(assessed: DataFrame, key: str = "listing_id") -> DataFrame:
    """Gates in long form with threshold and explanation."""
    columns = ("gate_total", "gate_area", "gate_floor", "gate_per_sqm")
    values = ("total", "area", "floor_no", "per_sqm")
    gates = F.array(
        *[
            F.struct(
                F.lit(i).alias("gate_order"),
                F.lit(gate).alias("gate_id"),
                F.lit(label).alias("gate_label"),
                F.col(column).alias("status"),
                F.lit(hard).alias("hard_gate"),
                finite(F.col(value)).alias("value"),
                F.lit(threshold).alias("threshold"),
                F.when(F.col(column) == "pass", good)
                .when(F.col(column) == "fail", bad)
                .otherwise(HARD_UNKNOWN if hard else SOFT_UNKNOWN)
                .alias("explanation"),
            )
            for i, ((gate, label, threshold, good, bad, hard), column, value) in enumerate(
                zip(GATES, columns, values)
            )
        ]
    )
    return assessed.select(key, F.explode(gates).alias("g")).select(key, "g.*")


def next_actions(has_key: Column, has_market: Column, quality: Column, has_address: Column) -> Column:
    """Ordered to-do texts of an assessed listing (columns of :func:`policy_gates`).

    ``has_key``: a town or address was entered, whether or not anything of it is left as a key.
    """
    passed, identity = F.col("policy_pass"), F.coalesce("identity_state", F.lit("unknown")) == "exact"
    current = F.coalesce("currentness", F.lit("unknown")) == "confirmed"
    steps = (
        (F.col("any_unknown"), ACTION_INPUT),
        (finite(F.col("total")).isNotNull() & ~has_key, ACTION_ADDRESS),
        (has_key & ~has_market, ACTION_NO_SAMPLE),
        (F.coalesce(quality == "THIN", F.lit(False)), ACTION_THIN),
        (passed & ~identity, ACTION_IDENTITY),
        (passed & ~current, ACTION_CURRENT),
        (has_address, ACTION_LAND),
        (passed & current & identity, ACTION_COST),
        (F.col("any_fail"), ACTION_KEEP),
    )
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in steps]))


def policy_funnel(assessed: DataFrame) -> DataFrame:
    """Listings by decision state."""
    return assessed.groupBy("decision_state").agg(F.count(F.lit(1)).alias("n"))


def sample_quality(units: Column, buildings: Column) -> Column:
    return (
        F.when((units >= ROBUST_UNITS) & (buildings >= ROBUST_BUILDINGS), "ROBUST")
        .when((units >= REVIEW_UNITS) & (buildings >= REVIEW_BUILDINGS), "REVIEW")
        .otherwise("THIN")
    )


def value_counts(df: DataFrame, keys: list[str], numbers: list[str], identities: list[str]) -> DataFrame:
    """Distinct values per group of several columns at once: (keys, metric, number, identity, n).

    One scan and one shuffle of already counted values serve every quantile and distinct count of a group.
    """
    entries = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("number"), F.lit(None).cast("string").alias("identity"))
        for c in numbers
    ] + [
        F.struct(F.lit(c).alias("metric"), F.lit(None).cast("double").alias("number"), F.col(c).cast("string").alias("identity"))
        for c in identities
    ]
    rows = df.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.*")
    known = rows.filter(F.col("number").isNotNull() | F.col("identity").isNotNull())
    return known.groupBy(*keys, "metric", "number", "identity").agg(F.count(F.lit(1)).alias("n"))


def quantiles_of(counted: DataFrame, keys: list[str], probs: dict[str, tuple[str, float]]) -> DataFrame:
    """Linear-interpolated quantiles from :func:`value_counts`; ``probs``: output name to (metric, probability).

    The distinct values of all groups are split into ranges by (group, value), which also splits a group that holds
    most of the data. A small table of range sizes tells which ranges hold a wanted rank; only those are looked into.
    """
    numeric = counted.filter(F.col("number").isNotNull()).select(*keys, "metric", "number", "n")
    groups = [*keys, "metric"]
    dealt, before = ordered_parts(numeric, groups, [F.asc("number")], F.col("n"))
    before = cut_lineage(before)
    total = before.groupBy(*groups).agg(F.sum("_n").alias("_total"))
    asked = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("of"), F.lit(p).alias("p")) for n, (m, p) in probs.items()])
    picks = total.withColumn("_q", F.explode(asked)).filter(F.col("_q.of") == F.col("metric"))
    position = (F.col("_total") - 1) * F.col("_q.p")
    share = position - F.floor(position)
    sides = F.array(
        F.struct(F.floor(position).alias("rank"), (F.lit(1.0) - share).alias("share")),
        F.struct(F.ceil(position).alias("rank"), share.alias("share")),
    )
    ranks = picks.select(*groups, F.col("_q.name").alias("_name"), F.explode(sides).alias("_s")).select(*groups, "_name", "_s.*")
    held = null_safe(ranks, before, groups).filter((F.col("_before") <= F.col("rank")) & (F.col("rank") < F.col("_before") + F.col("_n")))
    held = cut_lineage(held.drop("_n"))
    parts = held.select(*groups, "_part", "_before").distinct()
    within = Window.partitionBy(*groups, "_part").orderBy("number")
    rows = null_safe(dealt, parts, [*groups, "_part"])
    running = rows.withColumn("_end", F.sum("n").over(within) + F.col("_before")).withColumn("_start", F.col("_end") - F.col("n"))
    found = null_safe(running.drop("_before"), held.drop("_before"), [*groups, "_part"])
    found = found.filter((F.col("_start") <= F.col("rank")) & (F.col("rank") < F.col("_end")))
    low_high = lambda name, f: f(F.when(F.col("_name") == name, F.col("number")))
    high_share = lambda name: F.max(F.when((F.col("_name") == name), F.struct("rank", "share")))["share"]
    out = []
    for name in probs:
        low, high = low_high(name, F.min), low_high(name, F.max)
        out.append((low + (high - low) * high_share(name)).alias(name))
    return found.groupBy(*keys).agg(*out)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles of one column per group."""
    return quantiles_of(value_counts(df, keys, [value], []), keys, {n: (value, p) for n, p in probs.items()})


def town_market(listings: DataFrame) -> DataFrame:
    """Per town of listings with a known total: units, buildings, total quartiles, median price per m² and quality.

    ``listings``: town_key, building_id, total, area.
    """
    known = listings.filter(finite(F.col("total")).isNotNull() & (F.col("town_key") != ""))
    priced = known.withColumn("per_sqm", F.when(F.col("area") > 0, F.try_divide(F.col("total"), F.col("area"))))
    counted = value_counts(priced, ["town_key"], ["total", "per_sqm"], ["building_id"])
    counts = counted.groupBy("town_key").agg(
        F.sum(F.when(F.col("metric") == "total", F.col("n"))).alias("n"),
        F.count(F.when(F.col("metric") == "building_id", 1)).alias("unique_buildings"),
    )
    quantiles = quantiles_of(
        counted,
        ["town_key"],
        {
            "p25_total": ("total", 0.25),
            "median_total": ("total", 0.5),
            "p75_total": ("total", 0.75),
            "median_per_sqm": ("per_sqm", 0.5),
        },
    )
    return counts.join(quantiles, "town_key", "left").withColumn(
        "sample_quality", sample_quality(F.col("n"), F.col("unique_buildings"))
    )


def market_coverage(towns: DataFrame) -> DataFrame:
    """One row over all towns: towns, units, median units per town and towns with fewer than five units.

    Towns are counted by size first; the last step sees one row per distinct size.
    """
    sizes = towns.groupBy("n").agg(F.count(F.lit(1)).alias("_towns"))
    return sizes.agg(
        F.sum("_towns").alias("towns"),
        F.sum(F.col("n") * F.col("_towns")).alias("units"),
        F.coalesce(F.sum(F.when(F.col("n") < 5, F.col("_towns"))), F.lit(0)).alias("towns_below_five"),
        F.percentile(F.col("n"), F.lit(0.5), F.col("_towns")).alias("median_units"),
    )


def town_match(texts: DataFrame, towns: DataFrame) -> DataFrame:
    """Town of each text: equal key first, else the longest town key contained in it (ties: table order).

    ``texts``: text_key (distinct normalised texts); ``towns``: town_key, town_order. Containment is an equi join
    too: a text offers its substrings, but only of lengths that town keys have, so no text meets every town.
    """
    exact = texts.join(
        towns.groupBy("town_key").agg(F.min("town_order").alias("town_order")),
        texts.text_key == F.col("town_key"),
    ).select("text_key", "town_key")
    rest = texts.join(exact.select("text_key"), "text_key", "left_anti").filter(F.length("text_key") > 0)
    lengths = towns.agg(F.sort_array(F.collect_set(F.length("town_key")))).scalar()
    size = F.length("text_key")
    cuts = F.flatten(
        F.transform(
            F.filter(F.col("_lengths"), lambda n: (n > 0) & (n <= size)),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col("text_key"), i, n)),
        )
    )
    pieces = (
        rest.withColumn("_lengths", lengths)
        .select("text_key", F.explode(F.array_distinct(cuts)).alias("town_key"))
        .join(towns, "town_key")
    )
    contained = pieces.groupBy("text_key").agg(
        F.max_by("town_key", F.struct(F.length("town_key"), -F.col("town_order"))).alias("town_key")
    )
    return exact.unionByName(contained)


def key_texts(df: DataFrame, text: str) -> DataFrame:
    """Distinct raw texts of a column with their town key (``text_key``), written once.

    Texts repeat far more often than they differ, so the costly normalisation runs per distinct text. Writing the result
    also keeps later filters on the key from being pushed down and evaluated again for every input row.
    """
    distinct = df.select(text).filter(F.col(text).isNotNull()).distinct()
    return cut_lineage(spread(distinct, text).withColumn("text_key", normalize_town(F.col(text))))


def with_town_key(listings: DataFrame, text: str = "town") -> DataFrame:
    """Listings with ``town_key`` of a text column; no text gives an empty key."""
    keys = key_texts(listings, text).withColumnRenamed("text_key", "town_key")
    joined = lookup_join(listings, keys, [text])
    return joined.withColumn("town_key", F.coalesce("town_key", F.lit("")))


def market_context(listings: DataFrame, towns: DataFrame, text: str = "market_text") -> DataFrame:
    """Listings with their town's aggregate, difference from the median and comparison label.

    ``text`` names the column with the town or address; ``towns``: output of :func:`town_market` plus ``town_order``.
    Matching happens once per distinct text. Listings without a town stay, with NULLs; ``text_key`` is empty without text.
    """
    texts = key_texts(listings, text)
    keys = texts.select("text_key").filter(F.col("text_key") != "").distinct()
    matched = town_match(keys, towns.select("town_key", "town_order")).join(towns.drop("town_order"), "town_key")
    joined = lookup_join(listings, texts.join(matched, "text_key", "left"), [text])
    difference = finite(F.col("total")) - F.col("median_total")
    out = joined.withColumn("text_key", F.coalesce("text_key", F.lit(""))).withColumn("difference", difference)
    out = out.withColumn("difference_pct", F.try_divide(F.col("difference"), F.col("median_total")))
    return out.withColumn("comparison", comparison_label(F.col("difference_pct"))).withColumn(
        "market_note",
        F.when(F.col("sample_quality") == "THIN", NOTE_THIN).when(F.col("sample_quality") == "REVIEW", NOTE_REVIEW),
    )


def benchmark_compare(towns: DataFrame, benchmarks: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """Each town beside each external macro benchmark (id, asking, inquiry), in separate columns, never blended.

    The published benchmarks are a short fixed list and become an array expression per row.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("benchmark_id"),
                F.lit(asking).cast("double").alias("asking"),
                F.lit(inquiry).cast("double").alias("inquiry"),
            )
            for name, asking, inquiry in benchmarks
        ]
    )
    return towns.select("*", F.explode(rows).alias("_b")).select("*", "_b.*").drop("_b")


def area_summary(areas: DataFrame) -> DataFrame:
    """Counts by readiness, priority and market readiness in long form (dimension, value, n)."""
    sets = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), F.col(name).alias("value"))
            for name in ("readiness", "priority", "market_readiness")
        ]
    )
    long = areas.select(F.explode(sets).alias("d")).select("d.*")
    return long.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def area_shortfall(areas: DataFrame) -> DataFrame:
    """How many units and buildings each area still lacks."""
    gap = lambda target, c: F.greatest(F.lit(0), F.lit(target) - F.col(c))
    return areas.select(
        "*",
        gap(TARGET_UNITS, "known_rent_units").alias("units_missing"),
        gap(TARGET_BUILDINGS, "distinct_buildings").alias("buildings_missing"),
    )
