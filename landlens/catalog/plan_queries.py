"""Whole plans over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from landlens.catalog import raster_sql as rq
from landlens.catalog.base import View, query, up
from landlens.catalog.geo_queries import CELL_SQL
from landlens.catalog.inputs import DEM_PIXELS, HAZARDS, HOTSPOTS, LIVE_POINTS, MESH, NEAR_POINTS, ORIGIN, POINTS, REGIONS, ZOOM
from landlens.catalog.raster_queries import HOTSPOTS_SQL, dem, extent
from landlens.catalog.risk_queries import LAND_SQL, WEIGHT, inputs
from landlens.catalog.spatial_queries import (
    CODES_SQL, LATITUDE, NEAREST_SQL, SCOPE_SQL, municipality_codes, theory_cells, theory_sql,
)
from landlens.catalog.terrain_queries import CENTRE, GRID, GRID_LABEL, MPP, THEORY
from landlens.operators.grid_terrain import viewport_grid
from landlens.operators.lookups import theory_from_cell
from landlens.operators.spatial import nearest_cell
from landlens.plans.diagnose import Precomputed, diagnose, diagnose_viewports, resolve_theory
from landlens.plans.grid_build import build_cells, load_grid, save_grid
from landlens.session import cut_lineage, shared_folder

LIVE_PLACES = f"SELECT DISTINCT lat, lng FROM {LIVE_POINTS.sql}"
MISSES = f"(SELECT point_id, lat, lng FROM {NEAREST_SQL} WHERE cell_index IS NULL)"


def precomputed(spark, sf_dir):
    return Precomputed(
        theory_cells(spark, sf_dir).drop("lat", "lng").join(
            View("""SELECT o_orderkey AS cell_index, 35.8396478620176e0 - (o_orderkey % 125) * 0.00089831117499e0 AS lat,
                    139.43e0 + floor(o_orderkey / 125e0) * 0.00110424522183e0 AS lng FROM {orders}""").frame(spark, sf_dir),
            "cell_index",
        ),
        HOTSPOTS.frame(spark, sf_dir),
        REGIONS.frame(spark, sf_dir),
        max_lat=LATITUDE,
    )


@query(
    "resolve_theory",
    THEORY.replace(LIVE_PLACES, f"SELECT DISTINCT lat, lng FROM {MISSES}")
    + f""" SELECT point_id, detail_score AS score, label_code, original_score, confidence, 'live-analysis' AS source_mode, reasons FROM {MISSES} JOIN theory USING (lat, lng)
UNION ALL SELECT point_id, score, label_code, original_score, confidence, 'precomputed-100m', reasons FROM {theory_sql()}""",
)
def resolve_theory_query(spark, sf_dir):
    """Points near a precomputed cell take its record, the others go through the live analysis."""
    out = resolve_theory(
        NEAR_POINTS.frame(spark, sf_dir), DEM_PIXELS.frame(spark, sf_dir), precomputed(spark, sf_dir), ZOOM
    )
    return out.select(
        "point_id", "score", "label_code", "original_score", "confidence", "source_mode",
        F.array_join("reasons", "|").alias("reasons"),
    )


NEAR_LAND_SQL = LAND_SQL.replace(LIVE_POINTS.sql, NEAR_POINTS.sql)
LABEL = """CASE WHEN combined_score >= 80 THEN '住みやすさ候補' WHEN combined_score >= 65 THEN '概ね良好' WHEN combined_score >= 45 THEN '要確認'
       WHEN combined_score >= 25 THEN '慎重に確認' ELSE '優先度低め' END"""
COMBINED = up("least(CASE WHEN capped THEN 39e0 ELSE 100e0 END, wt * score + (1e0 - wt) * modern_score)")


@query(
    "diagnosis",
    THEORY.replace(LIVE_PLACES, f"SELECT DISTINCT lat, lng FROM {MISSES}")
    + f""", rt AS (SELECT point_id, detail_score AS score, label_code, confidence, 'live-analysis' AS source_mode FROM {MISSES} JOIN theory USING (lat, lng)
  UNION ALL SELECT point_id, score, label_code, confidence, 'precomputed-100m' FROM {theory_sql()}),
dj AS (SELECT rt.*, p.lat, p.lng, m.modern_score, {WEIGHT.replace("confidence", "rt.confidence").replace("label_code", "rt.label_code")} AS wt,
    coalesce(m.water_risk, 0) >= 80 OR coalesce(m.slope_risk, 0) >= 80 AS capped FROM rt JOIN {NEAR_POINTS.sql} p USING (point_id) JOIN {NEAR_LAND_SQL} m USING (point_id)),
dc AS (SELECT *, {COMBINED} AS combined_score FROM dj)
SELECT point_id, printf('%.6f, %.6f', lat, lng) AS coordinate, source_mode, score, modern_score, combined_score, {LABEL} AS combined_label, capped FROM dc""",
)
def diagnosis(spark, sf_dir):
    """The whole diagnosis with precomputed cells."""
    hazards, pixels, mesh = inputs(spark, sf_dir)
    out = diagnose(
        NEAR_POINTS.frame(spark, sf_dir), pixels, hazards, mesh, precomputed=precomputed(spark, sf_dir),
        dem_zoom=ZOOM, slope_zoom=ZOOM, hazard_zoom=ZOOM,
    )
    return out.select(
        "point_id", "coordinate", "source_mode", "score", "modern_score", "combined_score", "combined_label", "capped"
    )


#: Columns that the rasters move east for the viewports, into the supported area.
EAST = 170


def moved_east(text: str) -> str:
    return text.replace(str(ORIGIN[1]), str(ORIGIN[1] + EAST))


#: Viewports on the moved lattice; every seventh is too wide, every eleventh turned around.
VIEWS = View(
    """SELECT s_suppkey AS view_id, 139.545e0 + (s_suppkey % 40) / 1e3 AS west, 35.775e0 + (s_suppkey % 23) / 1e3 AS south,
       139.545e0 + (s_suppkey % 40) / 1e3 + CASE WHEN s_suppkey % 7 = 0 THEN 0.3e0 WHEN s_suppkey % 11 = 0 THEN -0.01e0 ELSE 0.03e0 END AS east,
       35.775e0 + (s_suppkey % 23) / 1e3 + 0.04e0 AS north, CAST(s_suppkey % 6 AS DOUBLE) AS cols, CAST(s_suppkey % 5 AS DOUBLE) AS rows_asked
FROM {supplier}"""
)
GOOD_VIEW = "east > west AND north > south AND east - west <= 0.25e0 AND north - south <= 0.2e0"
VIEW_CELLS_SQL = f"""(SELECT view_id * 100 + k AS point_id, view_id, CAST(k AS INTEGER) AS cell, lat, lng FROM (
  SELECT view_id, k, south + (k // nc) * ((north - south) / nr) + (north - south) / nr / 2e0 AS lat, west + (k % nc) * ((east - west) / nc) + (east - west) / nc / 2e0 AS lng
  FROM (SELECT *, unnest(range(0, nc * nr)) AS k FROM (SELECT *, {up("least(5e0, greatest(2e0, CASE WHEN cols = 0 THEN 4e0 ELSE cols END))")} AS nc,
    {up("least(4e0, greatest(2e0, CASE WHEN rows_asked = 0 THEN 3e0 ELSE rows_asked END))")} AS nr FROM {VIEWS.sql} WHERE {GOOD_VIEW}))) WHERE {SCOPE_SQL})"""
VIEW_CODES_SQL = CODES_SQL.replace(POINTS.sql, VIEW_CELLS_SQL)
VIEW_SCOPE_SQL = f"""(SELECT p.*, CASE WHEN coalesce(NOT c.failed, false) THEN c5 BETWEEN '13101' AND '13123' OR c5 BETWEEN '14100' AND '14118' OR c5 BETWEEN '14130' AND '14137' ELSE true END AS supported
  FROM (SELECT *, concat('g', {CELL_SQL[0]}, '-', {CELL_SQL[1]}) AS cell_id FROM {VIEW_CELLS_SQL}) p JOIN (SELECT *, substring(admin_code, 1, 5) AS c5 FROM {VIEW_CODES_SQL}) c ON p.cell_id = c.cell_id)"""
VIEW_POINTS_SQL = f"(SELECT point_id, lat, lng FROM {VIEW_SCOPE_SQL} WHERE supported)"


@query(
    "viewport_diagnosis",
    moved_east(THEORY.replace(LIVE_PLACES, f"SELECT DISTINCT lat, lng FROM {VIEW_POINTS_SQL}"))
    + moved_east(f""", vj AS (SELECT p.point_id, t.detail_score AS score, m.modern_score, {WEIGHT} AS wt, coalesce(m.water_risk, 0) >= 80 OR coalesce(m.slope_risk, 0) >= 80 AS capped
  FROM {VIEW_POINTS_SQL} p JOIN theory t USING (lat, lng) JOIN (SELECT * EXCLUDE (point_id), point_id AS pid FROM {LAND_SQL.replace(LIVE_POINTS.sql, VIEW_POINTS_SQL)}) m ON p.point_id = m.pid),
vc AS (SELECT *, {COMBINED} AS combined_score FROM vj)
SELECT v.view_id, v.cell, CASE WHEN v.supported THEN NULL ELSE 'out_of_scope' END AS error_code, c.score, c.modern_score, c.combined_score
FROM {VIEW_SCOPE_SQL} v LEFT JOIN vc c USING (point_id)
UNION ALL SELECT view_id, NULL, 'invalid_bounds', NULL, NULL, NULL FROM {VIEWS.sql} WHERE NOT ({GOOD_VIEW})"""),
)
def viewport_diagnosis(spark, sf_dir):
    """Diagnosis of the cells of all viewports, with the cells and the viewports that are refused."""
    views = VIEWS.frame(spark, sf_dir)
    good = views.filter(GOOD_VIEW)
    cells = viewport_grid(good, F.col("cols"), F.col("rows_asked"))
    codes = municipality_codes(cells.select((F.col("view_id") * 100 + F.col("cell")).alias("point_id"), "lat", "lng"))
    hazards, pixels = (View(moved_east(v.text)).frame(spark, sf_dir) for v in (HAZARDS, DEM_PIXELS))
    mesh = MESH.frame(spark, sf_dir)
    out = diagnose_viewports(
        views, F.col("cols"), F.col("rows_asked"), "view_id", codes, pixels, hazards, mesh, dem_zoom=ZOOM, slope_zoom=ZOOM, hazard_zoom=ZOOM
    )
    none = lambda name: F.lit(None).cast("int").alias(name)
    missing = [none(n) for n in ("score", "modern_score", "combined_score")]
    found = out.cells.select("view_id", "cell", F.lit(None).cast("string").alias("error_code"), "score", "modern_score", "combined_score")
    failed = out.failures.select("view_id", "cell", "error_code", *missing)
    refused = out.rejected.select("view_id", none("cell"), "error_code", *missing)
    return found.unionByName(failed).unionByName(refused)


#: A lattice of cells 40 rows tall, one cell per customer.
LATTICE = View(
    """SELECT c_custkey AS site_id, 0 AS region_id, CAST(c_custkey % 40 AS INT) AS grid_row,
       CAST(floor(c_custkey / 40e0) AS INT) AS grid_col, 2000e0 + floor(c_custkey / 40e0) * 100e0 AS east,
       0e0 - 1500e0 - (c_custkey % 40) * 100e0 AS north
FROM {customer}"""
)


def _built_sql() -> str:
    """CTEs ending in ``built`` (scored cells), ``gb_n`` (neighbourhood) and ``spots`` (hotspots)."""
    sites = f"sites AS (SELECT point_id AS site_id, (lng - {CENTRE[1]}e0) * (111320e0 * cos(radians({CENTRE[0]}e0))) AS east, (lat - {CENTRE[0]}e0) * 111320e0 AS north FROM {LIVE_POINTS.sql})"
    scored = GRID.replace(sites, f"sites AS (SELECT site_id, east, north FROM {LATTICE.sql})")
    assert scored != GRID
    built = f"""built AS (SELECT l.*, r.original_score, r.confidence, CAST(round_even(0.8e0 * original_score + 0.2e0 * auxiliary_score, 0) AS INTEGER) AS detail_score,
    {GRID_LABEL} AS label_code FROM {LATTICE.sql} l JOIN raw r USING (site_id)),
bd AS (SELECT grid_row AS "row", grid_col AS col, CAST(detail_score AS DOUBLE) AS value FROM built)"""
    around = rq.gauss("gb_n", "bd", 2.5, rows="max(40)", cols="max((SELECT max(grid_col) + 1 FROM built))")
    candidates = """(WITH k AS (SELECT region_id, grid_row, grid_col, detail_score FROM built WHERE label_code = 1 AND confidence >= 48)
 SELECT * FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE abs(b.grid_row - a.grid_row) <= 2 AND abs(b.grid_col - a.grid_col) <= 2 AND b.detail_score > a.detail_score))"""
    walk = HOTSPOTS_SQL.format(source=candidates).replace("WITH RECURSIVE ", "", 1)
    return f"{scored.replace('WITH ', 'WITH RECURSIVE ', 1)},\n{built},\n{around},\n{walk}"


BUILT_SQL = _built_sql()


def built(spark, sf_dir):
    lattice, pixels = LATTICE.frame(spark, sf_dir), dem(spark, sf_dir)
    return build_cells(
        lattice, pixels, centre=CENTRE, zoom=ZOOM, origin=ORIGIN, mpp=MPP, **extent(pixels),
        grid_rows=40, grid_cols=lattice.agg(F.max("grid_col") + 1).scalar(),
    )


@query(
    "grid_build",
    f"""{BUILT_SQL}, hs AS (SELECT s.hotspot_index, s.detail_score, b.east, b.north FROM spots s JOIN built b USING (region_id, grid_row, grid_col)),
nb AS (SELECT site_id, hotspot_index, d, row_number() OVER (PARTITION BY site_id ORDER BY detail_score DESC, d, hotspot_index DESC) AS k FROM (
  SELECT b.site_id, h.hotspot_index, h.detail_score, sqrt(pow(b.east - h.east, 2) + pow(b.north - h.north, 2)) AS d FROM built b, hs h) WHERE d <= 1000e0)
SELECT b.site_id, b.label_code, b.original_score, b.detail_score, CAST(round_even(CASE WHEN g.w > 0.02e0 THEN g.v / g.w END, 0) AS INTEGER) AS neighborhood_score, b.confidence,
  coalesce(n.hotspot_index, -1) AS nearby_best_index, CAST(round_even(n.d, 0) AS INTEGER) AS nearby_best_distance
FROM built b LEFT JOIN gb_n g ON g."row" = b.grid_row AND g.col = b.grid_col LEFT JOIN nb n ON n.site_id = b.site_id AND n.k = 1""",
)
def grid_build(spark, sf_dir):
    """Scores, neighbourhood, hotspots and nearby best of a lattice."""
    cells, _ = built(spark, sf_dir)
    return cells.select(
        "site_id", "label_code", "original_score", "detail_score", "neighborhood_score", "confidence",
        "nearby_best_index", "nearby_best_distance",
    )


@query(
    "grid_build_hotspots",
    f"""{BUILT_SQL} SELECT s.region_id, s.hotspot_index, b.east, b.north, s.detail_score, b.original_score, b.confidence FROM spots s JOIN built b USING (region_id, grid_row, grid_col)""",
)
def grid_build_hotspots(spark, sf_dir):
    """The hotspots of the same lattice, with the scores of their cells."""
    return built(spark, sf_dir)[1].drop("lat", "lng")


@query(
    "grid_round_trip",
    f"""{BUILT_SQL} SELECT b.site_id, b.site_id AS cell_index, b.detail_score AS score, b.label_code, b.original_score, b.confidence, 'precomputed-100m' AS source_mode FROM built b""",
)
def grid_round_trip(spark, sf_dir):
    """A built grid is written, read back and answers for points a few metres off its cells."""
    cells, hotspots = built(spark, sf_dir)
    cells = cut_lineage(cells)
    path = f"{shared_folder(spark)}/grid-{uuid.uuid4().hex}"
    regions = cells.select("region_id").distinct().select("region_id", F.lit(0).alias("region_order"), F.concat(F.lit("R"), "region_id").alias("region_name"))
    save_grid(cells, hotspots, regions, path)
    grid = load_grid(spark, path)
    points = cells.select(F.col("site_id").alias("point_id"), (F.col("lat") + 1e-5).alias("lat"), (F.col("lng") - 1e-5).alias("lng"))
    near = nearest_cell(
        points, grid.cells.select("region_id", "cell_index", "lat", "lng"), grid.regions, max_step_m=grid.max_step_m, max_lat=LATITUDE
    )
    near = cut_lineage(near)
    found = theory_from_cell(near, grid.cells, grid.hotspots, grid.regions)
    at = near.select("point_id", "cell_index")
    return found.join(at, "point_id").select(
        F.col("point_id").alias("site_id"), "cell_index", "score", "label_code", "original_score", "confidence", "source_mode"
    )
