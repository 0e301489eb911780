"""Hazard items, land risk and combined scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from landlens.catalog.base import query, six, up
from landlens.catalog.inputs import DEM_PIXELS, HAZARDS, LIVE_POINTS, MESH, ZOOM
from landlens.catalog.raster_queries import palette_sql, rounded
from landlens.catalog.terrain_queries import PIXELS, THEORY
from landlens.operators import lookups, risk
from landlens.plans.diagnose import diagnose

PI = "3.141592653589793"


def pixel_sql(lat: str, lng: str) -> str:
    return (
        f"CAST(floor((1e0 - asinh(tan(radians({lat}))) / {PI}) / 2e0 * {PIXELS}) AS INTEGER) AS gy, "
        f"CAST(floor(({lng} + 180e0) / 360e0 * {PIXELS}) AS INTEGER) AS gx"
    )


JCODE = ", ".join(f"({c}, {s})" for c, s in lookups.LANDFORM_RISK.items())
GROUND_SQL = f"""(SELECT p.point_id, m.mesh_row IS NOT NULL AS hit, m.landform_name, m.landform_code, m.amplification,
   CASE WHEN m.mesh_row IS NOT NULL THEN greatest(coalesce(j.score, 50), {up("0.9e0 * CASE WHEN amplification IS NULL THEN 50 WHEN amplification < 1e0 THEN 0 WHEN amplification < 1.4e0 THEN 20 WHEN amplification < 1.6e0 THEN 40 WHEN amplification < 2e0 THEN 65 ELSE 85 END")}) END AS ground_score
 FROM {LIVE_POINTS.sql} p LEFT JOIN {MESH.sql} m ON m.mesh_row = CAST(floor(p.lat * 480e0) AS INTEGER) AND m.mesh_col = CAST(floor(p.lng * 320e0) AS INTEGER)
 LEFT JOIN (VALUES {JCODE}) j(code, score) ON m.landform_code = j.code)"""


@query(
    "ground_lookup",
    f"SELECT point_id, ground_score, CASE WHEN hit THEN 'known' ELSE 'error' END AS ground_status FROM {GROUND_SQL}",
)
def ground_lookup(spark, sf_dir):
    out = lookups.ground_lookup(LIVE_POINTS.frame(spark, sf_dir), MESH.frame(spark, sf_dir))
    return out.select("point_id", "ground_score", "ground_status")




def _slope_sql() -> str:
    scale = "(111320e0 * greatest(0.2e0, cos(radians(lat))))"
    at = {
        "n": ("lat + 35e0 / 111320e0", "lng + 0e0"), "s": ("lat + -35e0 / 111320e0", "lng + 0e0"),
        "e": ("lat + 0e0", f"lng + 35e0 / {scale}"), "w": ("lat + 0e0", f"lng + -35e0 / {scale}"),
    }
    rows = " UNION ALL ".join(
        f"SELECT point_id, '{k}' AS k, {pixel_sql(a, b)} FROM {LIVE_POINTS.sql}" for k, (a, b) in at.items()
    )
    z = lambda k: f"max(CASE WHEN k = '{k}' THEN elevation END)"
    return f"""(SELECT point_id, degrees(atan(sqrt(pow(({z("e")} - {z("w")}) / 70e0, 2) + pow(({z("n")} - {z("s")}) / 70e0, 2)))) AS deg
  FROM ({rows}) LEFT JOIN {DEM_PIXELS.sql} USING (gy, gx) GROUP BY 1)"""


SLOPE_SQL = _slope_sql()


@query("slope_degrees", f"SELECT point_id, {six('deg')} AS slope_deg FROM {SLOPE_SQL}")
def slope_degrees(spark, sf_dir):
    points = LIVE_POINTS.frame(spark, sf_dir)
    out = risk.slope_degrees(points.select("lat", "lng").distinct(), DEM_PIXELS.frame(spark, sf_dir), ZOOM)
    return rounded(points.join(out, ["lat", "lng"], "left").select("point_id", "slope_deg"), "slope_deg")


def number_text(value: str) -> str:
    return f"regexp_replace(CAST({value} AS VARCHAR), '\\.0$', '')"


def _items_sql() -> str:
    parts = []
    px = f"(SELECT point_id, h.* FROM (SELECT point_id, {pixel_sql('lat', 'lng')} FROM {LIVE_POINTS.sql}) JOIN {HAZARDS.sql} h USING (gy, gx))"
    for i, (key, label, _) in enumerate(risk.ITEMS):
        head = f"SELECT p.point_id, {i} AS item_order, '{key}' AS item_key, '{label}' AS item_label"
        layer = f"(SELECT * FROM {px} WHERE layer = '{key}')"
        if key in risk.WATER_KEYS:
            parts.append(
                f"""{head}, q.score, coalesce(q.label, '{risk.UNCOLOURED}') AS detail, CASE WHEN q.score IS NULL THEN 'unknown' ELSE 'known' END AS status
  FROM {LIVE_POINTS.sql} p LEFT JOIN {palette_sql(layer, "point_id")} q ON p.point_id = q.point_id"""
            )
        elif key == "slope":
            parts.append(
                f"""{head}, CAST(CASE WHEN deg >= 40 THEN 80 WHEN deg >= 30 THEN 60 WHEN deg >= 15 THEN 35 WHEN deg >= 5 THEN 10 WHEN deg IS NOT NULL THEN 0 END AS INTEGER),
  coalesce(concat({number_text("floor(deg * 10e0 + 0.5e0) / 10e0")}, CASE WHEN deg IS NOT NULL THEN '°' END), '{risk.NO_ELEVATION}'), CASE WHEN deg IS NULL THEN 'unknown' ELSE 'known' END FROM {SLOPE_SQL} p"""
            )
            parts[-1] = parts[-1].replace(
                f"coalesce(concat({number_text('floor(deg * 10e0 + 0.5e0) / 10e0')}, CASE WHEN deg IS NOT NULL THEN '°' END), '{risk.NO_ELEVATION}')",
                f"CASE WHEN deg IS NULL THEN '{risk.NO_ELEVATION}' ELSE concat({number_text('floor(deg * 10e0 + 0.5e0) / 10e0')}, '°') END",
            )
        elif key == "ground":
            parts.append(
                f"""{head}, ground_score, CASE WHEN hit THEN concat(coalesce(landform_name, '区分' || landform_code), '／増幅率 ',
    coalesce({number_text("floor(amplification * 100e0 + 0.5e0) / 100e0")}, '不明')) ELSE '{risk.NO_GROUND}' END, CASE WHEN hit THEN 'known' ELSE 'error' END FROM {GROUND_SQL} p"""
            )
        else:
            score = "65" if key == "wetland" else "CASE WHEN r > 180 AND g < 120 THEN 100 ELSE 80 END"
            found = f"'{risk.WETLAND_FOUND}'" if key == "wetland" else f"CASE WHEN r > 180 AND g < 120 THEN '{risk.SPECIAL_ALERT}' ELSE '{risk.ALERT}' END"
            missing = risk.NO_WETLAND if key == "wetland" else risk.UNCOLOURED
            parts.append(
                f"""{head}, CASE WHEN a >= 8 THEN {score} END, CASE WHEN a >= 8 THEN {found} ELSE '{missing}' END, CASE WHEN a >= 8 THEN 'known' ELSE 'unknown' END
  FROM {LIVE_POINTS.sql} p LEFT JOIN {layer} x ON p.point_id = x.point_id"""
            )
    return "(" + " UNION ALL ".join(parts) + ")"


ITEMS_SQL = _items_sql()


def inputs(spark, sf_dir):
    return HAZARDS.frame(spark, sf_dir), DEM_PIXELS.frame(spark, sf_dir), MESH.frame(spark, sf_dir)


@query("hazard_items", f"SELECT * FROM {ITEMS_SQL}")
def hazard_items(spark, sf_dir):
    points = LIVE_POINTS.frame(spark, sf_dir)
    items = risk.risk_items(points, *inputs(spark, sf_dir), hazard_zoom=ZOOM, dem_zoom=ZOOM)
    return risk.item_rows(items)


GROUP_SQL = f"""(SELECT point_id, max(CASE WHEN item_key IN ('flood', 'innerWater', 'highTide', 'tsunami') THEN score END) AS water_risk,
   max(CASE WHEN item_key IN ('slope', 'landslide') THEN score END) AS slope_risk, max(CASE WHEN item_key IN ('ground', 'wetland') THEN score END) AS ground_risk,
   count(*) - count(score) AS unknown_items FROM {ITEMS_SQL} GROUP BY 1)"""


@query("group_risk", f"SELECT * FROM {GROUP_SQL}")
def group_risk(spark, sf_dir):
    """Group risks from items in long form."""
    points = LIVE_POINTS.frame(spark, sf_dir)
    items = risk.risk_items(points, *inputs(spark, sf_dir), hazard_zoom=ZOOM, dem_zoom=ZOOM)
    return risk.group_risk(risk.item_rows(items))


LAND_SQL = f"""(SELECT *, 100 - land_risk AS modern_score, CASE WHEN 100 - land_risk >= 80 THEN '低リスク' WHEN 100 - land_risk >= 60 THEN '低〜中リスク'
     WHEN 100 - land_risk >= 40 THEN '要確認' WHEN 100 - land_risk >= 20 THEN '高リスク' ELSE '非常に高リスク' END AS modern_label,
   completeness < 60 OR unknown_items > 0 AS provisional FROM (
  SELECT *, {up("greatest(0.5e0 * w + 0.25e0 * s + 0.25e0 * g, 0.9e0 * w, 0.9e0 * s, 0.7e0 * g)")} AS land_risk,
    {up("100e0 * (CAST(water_risk IS NOT NULL AS INTEGER) + CAST(slope_risk IS NOT NULL AS INTEGER) + CAST(ground_risk IS NOT NULL AS INTEGER)) / 3e0")} AS completeness
  FROM (SELECT *, coalesce(water_risk, 50) AS w, coalesce(slope_risk, 40) AS s, coalesce(ground_risk, 50) AS g FROM {GROUP_SQL})))"""
REASONS_SQL = f"""(SELECT point_id, concat(coalesce(string_agg(CASE WHEN k <= 3 AND score IS NOT NULL THEN concat(item_label, ': ', detail) END, '|' ORDER BY k), ''),
   CASE WHEN count(score) < 8 THEN concat(CASE WHEN count(score) > 0 THEN '|' ELSE '' END, '未判定データ ', 8 - count(score), '項目（安全扱いしていません）') ELSE '' END) AS reasons
 FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY CASE WHEN score IS NULL THEN 1 ELSE 0 END, score DESC, item_order) AS k FROM {ITEMS_SQL}) GROUP BY 1)"""


@query(
    "land_risk",
    f"""SELECT point_id, water_risk, slope_risk, ground_risk, land_risk, completeness, modern_score, modern_label, provisional, reasons
FROM {LAND_SQL} JOIN {REASONS_SQL} USING (point_id)""",
)
def land_risk(spark, sf_dir):
    points = LIVE_POINTS.frame(spark, sf_dir)
    out = risk.modern_risk(points, *inputs(spark, sf_dir), hazard_zoom=ZOOM, dem_zoom=ZOOM)
    return out.select(
        "point_id", "water_risk", "slope_risk", "ground_risk", "land_risk", "completeness", "modern_score", "modern_label",
        "provisional", F.array_join("modern_reasons", "|").alias("reasons"),
    )


WEIGHT = "CASE WHEN label_code <> 0 AND confidence >= 30 THEN 0.35e0 * (confidence / 100e0) ELSE 0e0 END"


@query(
    "combined_score",
    f"""{THEORY}, both_ AS (SELECT point_id, t.detail_score, t.label_code, t.confidence, m.*, {WEIGHT} AS wt,
    coalesce(m.water_risk, 0) >= 80 OR coalesce(m.slope_risk, 0) >= 80 AS capped
  FROM {LIVE_POINTS.sql} p JOIN theory t USING (lat, lng) JOIN (SELECT * EXCLUDE (point_id), point_id AS pid FROM {LAND_SQL}) m ON p.point_id = m.pid),
scored2 AS (SELECT *, {up("least(CASE WHEN capped THEN 39e0 ELSE 100e0 END, wt * detail_score + (1e0 - wt) * modern_score)")} AS combined_score FROM both_)
SELECT point_id, detail_score AS theory_score, modern_score, combined_score, floor(wt * 1e3 + 0.5e0) / 1e3 AS theory_weight, capped,
  CASE WHEN combined_score >= 80 THEN '住みやすさ候補' WHEN combined_score >= 65 THEN '概ね良好' WHEN combined_score >= 45 THEN '要確認'
       WHEN combined_score >= 25 THEN '慎重に確認' ELSE '優先度低め' END AS combined_label,
  concat('現代的土地条件を ', {up("100e0 * (1e0 - wt)")}, '%、イヤシロ仮説を ', {up("100e0 * wt")}, '%で反映|',
    CASE WHEN capped THEN '重大な水害・斜面リスクがあるため総合点を上限39に制限' ELSE '重大リスクによる上限制限なし' END, '|',
    CASE WHEN provisional THEN '未判定データがあるため暫定評価' ELSE '主要データが取得できた評価' END) AS reasons FROM scored2""",
)
def combined_score(spark, sf_dir):
    """Whole diagnosis of points without precomputed cells: live terrain, hazards and their combination."""
    hazards, dem, mesh = inputs(spark, sf_dir)
    out = diagnose(LIVE_POINTS.frame(spark, sf_dir), dem, hazards, mesh, dem_zoom=ZOOM, slope_zoom=ZOOM, hazard_zoom=ZOOM)
    return out.select(
        "point_id", F.col("score").alias("theory_score"), "modern_score", "combined_score", "theory_weight", "capped",
        "combined_label", F.array_join("combined_reasons", "|").alias("reasons"),
    )


