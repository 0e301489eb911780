"""Hazard items, land risk and the combination with the terrain score. Unknown is never read as safe."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.functions.geo import METERS_PER_DEGREE, global_pixel, pixel_positions, pixel_reach
from landlens.functions.labels import INSUFFICIENT, combined_label, risk_label, slope_score
from landlens.functions.numeric import clamp, half_up
from landlens.operators import windows as win
from landlens.operators.lookups import ground_lookup
from landlens.session import lookup_join
from landlens.sources.pixels import color_distance

# Flood depth colours (rgb, score, label), alpha and distance limits.
WATER_PALETTE = (
    ((247, 245, 169), 20, "0.5m未満相当"),
    ((255, 216, 192), 55, "0.5〜3m相当"),
    ((255, 183, 183), 80, "3〜5m相当"),
    ((255, 145, 145), 95, "5〜10m相当"),
    ((242, 133, 201), 100, "10〜20m相当"),
    ((220, 122, 220), 100, "20m以上相当"),
)
MIN_ALPHA = 8
MAX_DISTANCE = 115.0
SLOPE_STEP_M = 35.0

# Items in report order (key, label, group) and their texts.
ITEMS = (
    ("flood", "洪水浸水", "water"),
    ("innerWater", "内水浸水", "water"),
    ("highTide", "高潮", "water"),
    ("tsunami", "津波", "water"),
    ("landslide", "土砂災害", "slope"),
    ("slope", "傾斜", "slope"),
    ("ground", "地盤・微地形", "ground"),
    ("wetland", "明治期の低湿地", "ground"),
)
WATER_KEYS = ("flood", "innerWater", "highTide", "tsunami")
UNCOLOURED = "未着色（区域外または未整備の区別不可）"
NO_WETLAND = "該当着色なし、またはデータ範囲外"
WETLAND_FOUND = "低湿地の着色あり（位置誤差を含む）"
SPECIAL_ALERT, ALERT = "特別警戒相当の着色あり", "警戒相当の着色あり"
NO_ELEVATION = "標高データ不足"
NO_GROUND = "J-SHISデータを取得できませんでした"

# What unknown groups count as in the final blend.
IMPUTED = {"water": 50, "slope": 40, "ground": 50}


def nearest_palette(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Nearest palette entry as (distance, entry, score, label); NULL when transparent or too far.

    The palette is a handful of fixed colours, so it is an array expression; the first of equals wins.
    """
    entries = F.array(
        *[
            F.struct(
                color_distance(r, g, b, color).alias("distance"),
                F.lit(i).alias("entry"),
                F.lit(score).alias("score"),
                F.lit(label).alias("label"),
            )
            for i, (color, score, label) in enumerate(WATER_PALETTE)
        ]
    )
    best = F.array_min(entries)
    return F.when((a >= MIN_ALPHA) & (best["distance"] <= MAX_DISTANCE), best)


def item_struct(key: str, score: Column, detail: Column, status: Column) -> Column:
    order, label = next((i, text) for i, (k, text, _) in enumerate(ITEMS) if k == key)
    return F.struct(
        F.lit(order).alias("item_order"),
        F.lit(key).alias("item_key"),
        F.lit(label).alias("item_label"),
        score.cast("int").alias("score"),
        detail.alias("detail"),
        status.alias("status"),
    )


def water_item(key: str, pixel: str) -> Column:
    """Item from a pixel struct column (r, g, b, a), NULL struct when there is no tile."""
    p = F.col(pixel)
    best = nearest_palette(p["r"], p["g"], p["b"], p["a"])
    return item_struct(
        key, best["score"], F.coalesce(best["label"], F.lit(UNCOLOURED)),
        F.when(best.isNotNull(), "known").otherwise("unknown"),
    )


def zone_item(key: str, pixel: str) -> Column:
    """Landslide or wetland item from a pixel struct column."""
    p = F.col(pixel)
    coloured = F.coalesce(p["a"] >= MIN_ALPHA, F.lit(False))
    if key == "wetland":
        score, found, missing = F.lit(65), F.lit(WETLAND_FOUND), NO_WETLAND
    else:
        special = (p["r"] > 180) & (p["g"] < 120)
        score, missing = F.when(special, 100).otherwise(80), UNCOLOURED
        found = F.when(special, SPECIAL_ALERT).otherwise(ALERT)
    return item_struct(
        key, F.when(coloured, score), F.when(coloured, found).otherwise(missing),
        F.when(coloured, "known").otherwise("unknown"),
    )


def slope_degrees(places: DataFrame, dem: DataFrame, zoom: int = 14) -> DataFrame:
    """Slope at distinct places (lat, lng) from four samples 35 m away, read inside a task; NULL if any is unknown."""
    schema = "lat double, lng double, slope_deg double"

    def compute(window: win.Window, asked: pa.Table) -> pa.Table:
        lat, lng = win.numbers(asked, "lat"), win.numbers(asked, "lng")
        narrow = METERS_PER_DEGREE * np.maximum(0.2, np.cos(np.radians(lat)))

        def at(east: float, north: float) -> np.ndarray:
            row, col = pixel_positions(lat + north / METERS_PER_DEGREE, lng + east / narrow, zoom)
            return window.at("elevation", np.floor(row).astype(np.int64), np.floor(col).astype(np.int64))

        d, run = SLOPE_STEP_M, 2.0 * SLOPE_STEP_M
        dx, dy = (at(d, 0.0) - at(-d, 0.0)) / run, (at(0.0, d) - at(0.0, -d)) / run
        slope = np.degrees(np.arctan(np.sqrt(dx * dx + dy * dy)))
        return pa.table({"lat": pa.array(lat), "lng": pa.array(lng), "slope_deg": pa.array(slope, mask=np.isnan(slope))})

    reach = pixel_reach(F.col("lat"), F.col("lng"), SLOPE_STEP_M, zoom)
    return win.at_places(places.select("lat", "lng"), dem, reach, compute, schema, row="gy", col="gx", values=("elevation",))


def slope_item(degrees: str = "slope_deg") -> Column:
    d = F.col(degrees)
    text = F.concat(_plain_number(half_up(d, 1)), F.lit("°"))
    return item_struct(
        "slope", slope_score(d), F.coalesce(text, F.lit(NO_ELEVATION)),
        F.when(d.isNotNull(), "known").otherwise("unknown"),
    )


def _plain_number(value: Column) -> Column:
    """A number as text without a trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def ground_item() -> Column:
    """Item from the columns of :func:`landlens.operators.lookups.ground_lookup`."""
    hit = F.col("ground_status") == "known"
    amplification = F.coalesce(_plain_number(half_up(F.col("amplification"), 2)), F.lit("不明"))
    name = F.coalesce("landform_name", F.concat(F.lit("区分"), F.col("landform_code").cast("string")))
    text = F.concat(name, F.lit("／増幅率 "), amplification)
    return item_struct("ground", F.col("ground_score"), F.when(hit, text).otherwise(NO_GROUND), F.col("ground_status"))


def hazard_pixels(points: DataFrame, hazards: DataFrame, zoom: int = 15) -> DataFrame:
    """One pixel struct column per layer. ``hazards``: layer, gy, gx, r, g, b, a.

    The layers are folded into one row per pixel first, so points meet the rasters in a single join, and only the
    pixels that some point needs are folded. Colours travel as one number, which keeps the folding a plain hash
    aggregate.
    """
    gy, gx = global_pixel(F.col("lat"), F.col("lng"), zoom)
    placed = points.withColumn("gy", gy).withColumn("gx", gx)
    needed = placed.select("gy", "gx").distinct()
    layers = [*WATER_KEYS, "landslide", "wetland"]
    code = F.lit(0).cast("bigint")
    for band in "rgba":
        code = code * 256 + F.col(band)
    wide = (
        hazards.join(needed, ["gy", "gx"], "left_semi")
        .select("gy", "gx", "layer", code.alias("_code"))
        .groupBy("gy", "gx")
        .agg(*[F.max(F.when(F.col("layer") == k, F.col("_code"))).alias(k) for k in layers])
    )
    joined = lookup_join(placed, wide, ["gy", "gx"])
    return joined.select(*points.columns, *[_unpacked(F.col(k)).alias(k) for k in layers])


def _unpacked(code: Column) -> Column:
    """Pixel struct of a colour code."""
    band = lambda shift: F.shiftright(code, shift).bitwiseAND(F.lit(255)).cast("int")
    pixel = F.struct(*[band(s).alias(n) for n, s in zip("rgba", (24, 16, 8, 0))])
    return F.when(code.isNotNull(), pixel)


def risk_items(
    points: DataFrame,
    hazards: DataFrame,
    dem: DataFrame,
    mesh: DataFrame,
    *,
    hazard_zoom: int = 15,
    dem_zoom: int = 14,
) -> DataFrame:
    """Points with ``items``: the eight risk items in report order."""
    df = hazard_pixels(points, hazards, hazard_zoom)
    df = lookup_join(df, slope_degrees(points.select("lat", "lng").distinct(), dem, dem_zoom), ["lat", "lng"])
    df = ground_lookup(df, mesh)
    items = F.array(
        *[water_item(k, k) for k in WATER_KEYS],
        zone_item("landslide", "landslide"),
        slope_item(),
        ground_item(),
        zone_item("wetland", "wetland"),
    )
    return df.select(*points.columns, items.alias("items"))


def item_rows(df: DataFrame, key: str = "point_id") -> DataFrame:
    """Items in long form."""
    return df.select(key, F.explode("items").alias("i")).select(key, "i.*")


def group_of(item_key: Column) -> Column:
    rungs = F
    for key, _, group in ITEMS:
        rungs = rungs.when(item_key == key, group)
    return rungs


def group_risk(items: DataFrame, key: str = "point_id") -> DataFrame:
    """Long-form items to the highest known score per group, NULL when nothing is known there."""
    group = group_of(F.col("item_key"))
    return items.groupBy(key).agg(
        *[F.max(F.when(group == g, F.col("score"))).alias(f"{g}_risk") for g in ("water", "slope", "ground")],
        F.count(F.when(F.col("score").isNull(), 1)).alias("unknown_items"),
    )


def array_group_risk(items: str = "items") -> list[Column]:
    """The same from the item array of a row, without a shuffle."""
    out = []
    for g in ("water", "slope", "ground"):
        keys = [k for k, _, group in ITEMS if group == g]
        scores = F.transform(F.filter(items, lambda i: i["item_key"].isin(keys)), lambda i: i["score"])  # noqa: B023
        out.append(F.array_max(scores).alias(f"{g}_risk"))
    unknown = F.size(F.filter(items, lambda i: i["score"].isNull()))
    return [*out, unknown.alias("unknown_items")]


def land_risk(df: DataFrame) -> DataFrame:
    """Blend of the three group risks, with completeness and a provisional mark.

    Unknown groups count as 50 / 40 / 50 in the blend only, so an unknown group does cost points.
    """
    risks = [F.col(f"{g}_risk") for g in ("water", "slope", "ground")]
    known = sum((r.isNotNull().cast("int") for r in risks), F.lit(0))
    completeness = half_up(known / F.lit(3.0) * 100.0).cast("int")
    w, s, g = (F.coalesce(r, F.lit(IMPUTED[n])) for r, n in zip(risks, ("water", "slope", "ground")))
    blend = F.greatest(w * 0.5 + s * 0.25 + g * 0.25, w * 0.9, s * 0.9, g * 0.7)
    risk = half_up(blend).cast("int")
    out = df.withColumn("land_risk", risk).withColumn("completeness", completeness)
    score = clamp(F.lit(100) - F.col("land_risk"), 0, 100)
    return (
        out.withColumn("modern_score", score)
        .withColumn("modern_label", risk_label(F.col("modern_score")))
        .withColumn("provisional", (F.col("completeness") < 60) | (F.col("unknown_items") > 0))
    )


def top_reasons(items: Column, k: int = 3) -> Column:
    """``label: detail`` of the k highest known items (report order among equals), then a note on unknown ones."""
    ranked = F.sort_array(
        F.transform(
            F.filter(items, lambda i: i["score"].isNotNull()),
            lambda i: F.struct(
                (-i["score"]).alias("rank"),
                i["item_order"].alias("item_order"),
                F.concat(i["item_label"], F.lit(": "), i["detail"]).alias("text"),
            ),
        )
    )
    best = F.transform(F.slice(ranked, 1, k), lambda x: x["text"])
    unknown = F.size(F.filter(items, lambda i: i["score"].isNull()))
    note = F.concat(F.lit("未判定データ "), unknown.cast("string"), F.lit("項目（安全扱いしていません）"))
    return F.when(unknown > 0, F.array_append(best, note)).otherwise(best)


def modern_risk(points: DataFrame, hazards: DataFrame, dem: DataFrame, mesh: DataFrame, **zooms) -> DataFrame:
    """Points with group risks, land risk, score, label and reasons; no shuffle beyond the three lookups."""
    df = risk_items(points, hazards, dem, mesh, **zooms)
    df = df.select("*", *array_group_risk())
    return land_risk(df).withColumn("modern_reasons", top_reasons(F.col("items")))


def combine_scores(df: DataFrame) -> DataFrame:
    """Weigh the terrain score (label_code, confidence, score) against the modern score; severe water or slope risk
    caps the result at 39."""
    usable = (F.col("label_code") != INSUFFICIENT) & (F.col("confidence") >= 30)
    weight = F.when(usable, F.col("confidence") / F.lit(100.0) * 0.35).otherwise(0.0)
    capped = (F.coalesce("water_risk", F.lit(0)) >= 80) | (F.coalesce("slope_risk", F.lit(0)) >= 80)
    out = df.withColumn("_w", weight).withColumn("capped", capped)
    raw = F.col("_w") * F.col("score") + (F.lit(1.0) - F.col("_w")) * F.col("modern_score")
    raw = F.when(F.col("capped"), F.least(raw, F.lit(39.0))).otherwise(raw)
    percent = lambda v: half_up(v * 100.0).cast("int")
    return (
        out.withColumn("combined_score", half_up(clamp(raw, 0.0, 100.0)).cast("int"))
        .withColumn("combined_label", combined_label(F.col("combined_score")))
        .withColumn("theory_weight", half_up(F.col("_w"), 3))
        .withColumn(
            "combined_reasons",
            F.array(
                F.format_string(
                    "現代的土地条件を %d%%、イヤシロ仮説を %d%%で反映", percent(F.lit(1.0) - F.col("_w")), percent(F.col("_w"))
                ),
                F.when(F.col("capped"), "重大な水害・斜面リスクがあるため総合点を上限39に制限").otherwise(
                    "重大リスクによる上限制限なし"
                ),
                F.when(F.col("provisional"), "未判定データがあるため暫定評価").otherwise("主要データが取得できた評価"),
            ),
        )
        .drop("_w")
    )
