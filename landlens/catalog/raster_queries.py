"""Pixels, elevation, smoothing, sampling, slope, overview and colours."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from landlens.catalog import raster_sql as rq
from landlens.catalog.base import query, six, table
from landlens.catalog.inputs import (
    DEM, ENCODED, GRID_CELLS, HAZARD_PIXELS, LAT0, LIVE_POINTS, LNG0, ORIGIN, PIXEL_LAT, PIXEL_LNG, ZOOM,
)
from landlens.functions.numeric import half_up
from landlens.operators import grid_terrain, lookups, overview, raster, risk
from landlens.sources import pixels

DEM_SQL = f'(SELECT grid_row AS "row", grid_col AS col, elevation AS value FROM {DEM.sql})'


def dem(spark, sf_dir):
    return DEM.frame(spark, sf_dir).selectExpr("grid_row AS row", "grid_col AS col", "elevation AS value")


def extent(pixels):
    """Rows and columns of the given raster."""
    return {"rows": pixels.agg(F.max("row") + 1).scalar(), "cols": pixels.agg(F.max("col") + 1).scalar()}


def rounded(df, *names):
    return df.select(*[half_up(F.col(c), 6).alias(c) if c in names else c for c in df.columns])


ELEVATION_SQL = "CASE WHEN a <> 0 AND u <> 8388608 THEN (CASE WHEN u < 8388608 THEN u ELSE u - 16777216 END) * 0.01e0 END"
DECODED_SQL = f"(SELECT x, y, px, py, priority, {ELEVATION_SQL} AS elevation FROM (SELECT *, r * 65536 + g * 256 + b AS u FROM {ENCODED.sql}))"


@query("decode_elevation", f"SELECT x, y, px, py, priority, {six('elevation')} AS elevation FROM {DECODED_SQL}")
def decode_elevation(spark, sf_dir):
    return rounded(pixels.decode_elevation(ENCODED.frame(spark, sf_dir)), "elevation")


@query(
    "dem_mosaic",
    f"""SELECT x, y, px, py, {six("arg_min(elevation, priority)")} AS elevation FROM {DECODED_SQL}
WHERE elevation IS NOT NULL GROUP BY ALL""",
)
def dem_mosaic(spark, sf_dir):
    return rounded(lookups.dem_mosaic(ENCODED.frame(spark, sf_dir)), "elevation")


def tile_sql(zoom: int) -> str:
    size = f"{float(2**zoom)!r}e0"
    fx = f"((lng + 180e0) / 360e0 * {size})"
    fy = f"((1e0 - asinh(tan(radians(lat))) / {math.pi!r}) / 2e0 * {size})"
    inner = lambda f: f"CAST(floor(({f} - floor({f})) * 256e0) AS INTEGER)"
    return f"CAST(floor({fx}) AS INTEGER) AS x, CAST(floor({fy}) AS INTEGER) AS y, {inner(fx)} AS px, {inner(fy)} AS py"


@query(
    "dem_fallback",
    f"""WITH m AS (SELECT x, y, px, py, arg_min(elevation, priority) AS elevation FROM {DECODED_SQL} WHERE elevation IS NOT NULL GROUP BY ALL)
SELECT point_id, {six("elevation")} AS elevation FROM (SELECT point_id, {tile_sql(ZOOM)} FROM {LIVE_POINTS.sql}) LEFT JOIN m USING (x, y, px, py)""",
)
def dem_fallback(spark, sf_dir):
    out = lookups.dem_fallback(LIVE_POINTS.frame(spark, sf_dir), ENCODED.frame(spark, sf_dir), ZOOM)
    return rounded(out.select("point_id", "elevation"), "elevation")


@query(
    "raster_lookup",
    f"""SELECT point_id, r, g, b, a FROM (SELECT point_id, {tile_sql(ZOOM)} FROM {LIVE_POINTS.sql})
LEFT JOIN (SELECT * FROM {ENCODED.sql} WHERE priority = 2) USING (x, y, px, py)""",
)
def raster_lookup(spark, sf_dir):
    layer = ENCODED.frame(spark, sf_dir).filter("priority = 2").drop("priority")
    return lookups.raster_lookup(LIVE_POINTS.frame(spark, sf_dir), layer, ZOOM).drop("lat", "lng")


RAW_PIXELS = """SELECT o_orderkey, CAST(1 + o_orderkey % 4 AS INT) AS channels, CASE WHEN o_orderkey % 3 = 0 THEN 16 ELSE 8 END AS depth,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey * 7919) % 65536 ELSE (o_orderkey * 37) % 256 END AS INT) AS s0,
  CAST((o_orderkey * 91) % 256 AS INT) AS s1, CAST(CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE (o_orderkey * 53) % 256 END AS INT) AS s2,
  CAST((o_orderkey * 17) % 256 AS INT) AS s3"""


def _level(c: str) -> str:
    return f"CAST(floor(coalesce({c}, 0) / (CASE WHEN depth = 16 THEN 65535e0 ELSE 255e0 END) * 255e0 + 0.5e0) AS INTEGER)"


@query(
    "normalize_pixel",
    f"""SELECT o_orderkey, {_level("s0")} AS r, CASE WHEN channels <= 2 THEN {_level("s0")} ELSE {_level("s1")} END AS g,
  CASE WHEN channels <= 2 THEN {_level("s0")} ELSE {_level("s2")} END AS b,
  CASE channels WHEN 2 THEN {_level("s1")} WHEN 4 THEN {_level("s3")} ELSE 255 END AS a FROM ({RAW_PIXELS} FROM orders)""",
)
def normalize_pixel(spark, sf_dir):
    raw = spark.sql(RAW_PIXELS + " FROM {orders}", orders=table(spark, sf_dir, "orders"))
    return pixels.normalize_pixel(raw)


def _pick(table_: dict[int, int], other: int) -> str:
    return "CASE label_code " + " ".join(f"WHEN {k} THEN {v}" for k, v in table_.items()) + f" ELSE {other} END"


def _colour_sql(scheme: str) -> str:
    cells = f"(SELECT cell_index, original_score AS score, label_code, confidence / 100e0 AS confidence FROM {GRID_CELLS.sql})"
    mix = lambda a, b, t: f"({a} + ({b} - {a}) * ({t}))"
    cols = []
    for i, n in enumerate("rgb"):
        if scheme == "grid":
            base = _pick({k: c[i] for k, c in enumerate(pixels.GRID_COLORS)}, 0)
            v = f"round_even(242e0 + ({base} - 242e0) * (0.58e0 + 0.42e0 * (abs(score - 50e0) / 50e0)), 0)"
            alpha = "least(230, round_even(130e0 + 100e0 * confidence, 0))"
        elif scheme == "theory":
            low, mid, high = (float(c[i]) for c in (pixels.THEORY_LOW, pixels.THEORY_MIDDLE, pixels.THEORY_HIGH))
            v = f"round_even(CASE WHEN score < 50 THEN {mix(f'{low}e0', f'{mid}e0', 'score / 50e0')} ELSE {mix(f'{mid}e0', f'{high}e0', '(score - 50e0) / 50e0')} END, 0)"
            alpha = "CASE WHEN cell_index % 9 <> 0 THEN round_even(92e0 + 115e0 * confidence, 0) ELSE 0 END"
        elif scheme == "screen":
            t = "0.42e0 + 0.58e0 * (abs(score - 50e0) / 50e0)"
            ramp = lambda ends: f"floor({mix(f'{float(ends[0][i])}e0', f'{float(ends[1][i])}e0', t)} + 0.5e0)"  # noqa: B023, E731
            flat = _pick({k: c[i] for k, c in pixels.SCREEN_FLAT.items()}, pixels.SCREEN_OTHER[i])
            v = f"CASE label_code WHEN 1 THEN {ramp(pixels.SCREEN_CANDIDATE)} WHEN 2 THEN {ramp(pixels.SCREEN_CAUTION)} ELSE {flat} END"
            alpha = "255"
        else:
            red, amber, green = (float(c[i]) for c in (pixels.SAFETY_RED, pixels.SAFETY_AMBER, pixels.SAFETY_GREEN))
            v = f"floor((CASE WHEN score < 50 THEN {mix(f'{red}e0', f'{amber}e0', 'score / 50e0')} ELSE {mix(f'{amber}e0', f'{green}e0', '(score - 50e0) / 50e0')} END) + 0.5e0)"
            alpha = "255"
        cols.append(f"CAST({v} AS INTEGER) AS {n}")
    return f"SELECT cell_index, {', '.join(cols)}, CAST({alpha} AS INTEGER) AS a FROM {cells}"


def _colours(scheme: str):
    def run(spark, sf_dir):
        cells = GRID_CELLS.frame(spark, sf_dir).selectExpr(
            "cell_index", "original_score AS score", "label_code", "confidence / 100e0 AS confidence",
            "cell_index % 9 <> 0 AS masked",
        )
        return pixels.colorize_cells(cells, scheme).select("cell_index", "r", "g", "b", "a")

    return run


for _scheme in ("grid", "theory", "screen", "safety"):
    query(f"colorize_{_scheme}", _colour_sql(_scheme))(_colours(_scheme))


def palette_sql(pixels_: str, key: str) -> str:
    rows = ", ".join(
        f"({i}, {c[0]}, {c[1]}, {c[2]}, {s}, '{t}')" for i, (c, s, t) in enumerate(risk.WATER_PALETTE)
    )
    return f"""(SELECT {key}, score, label FROM (SELECT {key}, score, label, d, row_number() OVER (PARTITION BY {key} ORDER BY d, i) AS k
  FROM (SELECT {key}, i, q.score, q.label, sqrt(pow(r - cr, 2) + pow(g - cg, 2) + pow(b - cb, 2)) AS d FROM {pixels_},
        (VALUES {rows}) q(i, cr, cg, cb, score, label) WHERE a >= 8)) WHERE k = 1 AND d <= 115)"""


@query(
    "nearest_palette",
    f"""SELECT p.point_id, n.score, n.label FROM {HAZARD_PIXELS.sql} p
LEFT JOIN {palette_sql(HAZARD_PIXELS.sql, "point_id")} n ON p.point_id = n.point_id""",
)
def nearest_palette(spark, sf_dir):
    px = HAZARD_PIXELS.frame(spark, sf_dir)
    best = risk.nearest_palette(*[F.col(c) for c in "rgba"])
    return px.select("point_id", best.alias("n")).select("point_id", "n.score", "n.label")


@query(
    "gaussian_small",
    f"""WITH d AS {DEM_SQL}, {rq.gauss("g", "d", 1.5)}
SELECT CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, {six("v / w")} AS value FROM g WHERE w > 0.35e0""",
)
def gaussian_small(spark, sf_dir):
    return rounded(raster.normalized_gaussian(dem(spark, sf_dir), 1.5), "value")


@query(
    "gaussian_wide",
    f"""WITH d AS {DEM_SQL}, {rq.gauss("g", "d", 12.0)}
SELECT CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, {six("v / w")} AS value FROM g WHERE w > 0.35e0""",
)
def gaussian_wide(spark, sf_dir):
    return rounded(raster.normalized_gaussian(dem(spark, sf_dir), 12.0), "value")


SIGMAS = raster.tpi_sigmas(300, 62.0)


@query(
    "tpi_surface",
    f"""WITH d AS {DEM_SQL}, {rq.gauss("i", "d", SIGMAS[0])}, {rq.gauss("o", "d", SIGMAS[1])}
SELECT CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, {six("i.v / i.w - o.v / o.w")} AS value
FROM i JOIN o USING ("row", col) WHERE i.w > 0.35e0 AND o.w > 0.35e0""",
)
def tpi_surface(spark, sf_dir):
    return rounded(raster.tpi_surface(dem(spark, sf_dir), 300, 62.0), "value")


@query(
    "gradient_slope",
    f"""WITH d AS {DEM_SQL}, s_grid AS (SELECT "row", col, value FROM d), k AS (SELECT * FROM d WHERE value IS NOT NULL), {rq.slope("s", "k", 62.0)}
SELECT CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, {six("value")} AS value FROM s""",
)
def gradient_slope(spark, sf_dir):
    out = raster.gradient_slope(dem(spark, sf_dir), 62.0)
    return rounded(out.withColumn("row", F.col("row").cast("bigint")).withColumn("col", F.col("col").cast("bigint")), "value")


SAMPLE_AT = f"""SELECT point_id, ({LAT0}e0 - lat) / {PIXEL_LAT}e0 AS r, (lng - {LNG0}e0) / {PIXEL_LNG}e0 AS c FROM {LIVE_POINTS.sql}"""


@query(
    "bilinear_sample",
    f"WITH d AS {DEM_SQL}, p AS ({SAMPLE_AT}) SELECT point_id, {six('value')} AS value FROM {rq.bilinear('p', 'd', 'point_id')}",
)
def bilinear_sample(spark, sf_dir):
    samples = LIVE_POINTS.frame(spark, sf_dir).selectExpr(
        "point_id", f"({LAT0}e0 - lat) / {PIXEL_LAT}e0 AS r", f"(lng - {LNG0}e0) / {PIXEL_LNG}e0 AS c"
    )
    return rounded(raster.bilinear_sample(dem(spark, sf_dir), samples, ["point_id"], ["value"]), "value")


def overview_sql(mpp: float) -> str:
    """CTEs ending in ``ov`` (row, col, score, confidence)."""
    parts, joins, columns = [f"d AS {DEM_SQL}"], [], []
    for m, threshold in overview.SCALES:
        radius = overview._steps(m / mpp)[0]
        parts.append(rq.gauss(f"q{m}", "d", max(0.8, radius * 0.1)))
        parts.append(f'f{m} AS (SELECT "row", col, v / w AS value FROM q{m} WHERE w > 0.45e0)')
        cells = [(0, 0), *overview._neighbours(m / mpp)]
        for k, (dr, dc) in enumerate(cells):
            joins.append(f'LEFT JOIN f{m} v{m}_{k} ON v{m}_{k}."row" = z."row" - ({dr}) AND v{m}_{k}.col = z.col - ({dc})')
        n = [f"v{m}_{k}.value" for k in range(9)]
        valid = [f"({n[0]} IS NOT NULL AND {n[1 + 2 * i]} IS NOT NULL AND {n[2 + 2 * i]} IS NOT NULL)" for i in range(4)]
        t3, t8 = f"{threshold * 3.0!r}e0", f"{threshold * 8.0!r}e0"
        level = lambda ok, a, b: f"CASE WHEN {ok} THEN greatest(0e0, least(1e0, least({a}, {b}) / {t3})) ELSE 0e0 END"  # noqa: B023, E731
        high = [level(ok, f"{n[0]} - {n[1 + 2 * i]}", f"{n[0]} - {n[2 + 2 * i]}") for i, ok in enumerate(valid)]
        low = [level(ok, f"{n[1 + 2 * i]} - {n[0]}", f"{n[2 + 2 * i]} - {n[0]}") for i, ok in enumerate(valid)]
        relief = f"CASE WHEN coalesce({', '.join(n[1:])}) IS NOT NULL THEN least(1e0, (greatest({', '.join(n[1:])}) - least({', '.join(n[1:])})) / {t8}) END"
        second = lambda x: f"sqrt(list_sort([{', '.join(x)}])[4] * list_sort([{', '.join(x)}])[3])"
        columns += [
            f"{second(high)} * {relief} AS high_{m}", f"{second(low)} * {relief} AS low_{m}",
            f"({' + '.join(f'CAST({ok} AS INTEGER)' for ok in valid)}) / 4e0 AS cov_{m}",
        ]
    ms = [m for m, _ in overview.SCALES]
    parts.append(f'e AS (SELECT z."row", z.col, {", ".join(columns)} FROM d z {" ".join(joins)})')
    union = lambda k: "1e0 - " + " * ".join(f"(1e0 - 0.72e0 * {k}_{m})" for m in ms)
    active = " + ".join(f"CASE WHEN greatest(high_{m}, low_{m}) >= 0.25e0 THEN 1e0 ELSE 0e0 END" for m in ms)
    parts.append(
        f"""u AS (SELECT *, {union("high")} AS high, {union("low")} AS low, ({" + ".join(f"cov_{m}" for m in ms)}) / 3e0 AS coverage, ({active}) / 3e0 AS active FROM e),
ov AS (SELECT "row", col, CASE WHEN high IS NOT NULL AND low IS NOT NULL THEN round_even(50e0 + (high - low) * 50e0, 0) END AS score,
  CASE WHEN high IS NOT NULL AND low IS NOT NULL THEN least(1e0, 0.35e0 * coverage + 0.4e0 * greatest(high, low) + 0.25e0 * active) END AS confidence FROM u)"""
    )
    return "WITH " + ",\n".join(parts)


OVERVIEW_MPP = 62.0


@query(
    "overview_surface",
    overview_sql(OVERVIEW_MPP)
    + f' SELECT CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col, score, {six("confidence")} AS confidence FROM ov',
)
def overview_surface(spark, sf_dir):
    return rounded(overview.overview_surface(dem(spark, sf_dir), OVERVIEW_MPP), "confidence")


def surface(spark, sf_dir):
    """A masked score surface on the lattice, from the grid cells."""
    return GRID_CELLS.frame(spark, sf_dir).selectExpr(
        "grid_row AS row", "grid_col AS col", "CAST(original_score AS DOUBLE) AS score",
        "confidence / 100e0 AS confidence", "label_code <> 3 AS masked",
    )


SURFACE_SQL = f'(SELECT grid_row AS "row", grid_col AS col, CASE WHEN label_code <> 3 THEN original_score - 50e0 END AS s, CASE WHEN label_code <> 3 THEN confidence / 100e0 END AS c FROM {GRID_CELLS.sql})'


@query(
    "smooth_preview",
    f"""WITH d AS {SURFACE_SQL}, {rq.gauss("a", "d", 4.2, "s")}, {rq.gauss("b", "d", 4.2, "c")}
SELECT CAST("row" AS BIGINT) AS "row", CAST(col AS BIGINT) AS col,
  {six("least(100e0, greatest(0e0, 50e0 + 1.15e0 * CASE WHEN a.w > 0.03e0 THEN a.v / a.w ELSE 0e0 END))")} AS score,
  {six("least(1e0, greatest(0e0, CASE WHEN b.w > 0.03e0 THEN b.v / b.w ELSE 0e0 END))")} AS confidence FROM a JOIN b USING ("row", col)""",
)
def smooth_preview(spark, sf_dir):
    return rounded(overview.smooth_preview(surface(spark, sf_dir)), "score", "confidence")


REPORT_R, REPORT_C = rq.position("lat", "lng", ZOOM, ORIGIN)


@query(
    "sample_report",
    f"""SELECT point_id, original_score AS score, confidence FROM (SELECT point_id, CAST(round_even({REPORT_R}, 0) AS INTEGER) AS grid_row,
  CAST(round_even({REPORT_C}, 0) AS INTEGER) AS grid_col FROM {LIVE_POINTS.sql}) JOIN {GRID_CELLS.sql} USING (grid_row, grid_col)""",
)
def sample_report(spark, sf_dir):
    grid = surface(spark, sf_dir).select("row", "col", "score", "confidence")
    return overview.sample_report(grid, LIVE_POINTS.frame(spark, sf_dir), ZOOM, ORIGIN).drop("lat", "lng")


#: Both regions of the lattice with rows of their own: they overlap in row and column, and each has its own extent.
REGION_ROW = "CASE WHEN region_id = 1 THEN grid_row - 62 ELSE grid_row END"


def region_sql(region: int) -> str:
    return f'(SELECT {REGION_ROW} AS "row", grid_col AS col, CAST(detail_score AS DOUBLE) AS value FROM {GRID_CELLS.sql} WHERE region_id = {region})'


@query(
    "neighborhood_score",
    f"""WITH d0 AS {region_sql(0)}, d1 AS {region_sql(1)}, {rq.gauss("g", "d0", 2.5, rows="max(62)", cols=f"max((SELECT max(grid_col) + 3 FROM {GRID_CELLS.sql}))")},
{rq.gauss("h", "d1", 2.5, rows="max(66)", cols=f"max((SELECT max(grid_col) + 3 FROM {GRID_CELLS.sql}))")},
b AS (SELECT 0 AS region_id, * FROM g UNION ALL SELECT 1, * FROM h)
SELECT cell_index, CAST(round_even(b.v / b.w, 0) AS INTEGER) AS neighborhood_score
FROM {GRID_CELLS.sql} c JOIN b ON c.region_id = b.region_id AND {REGION_ROW.replace("region_id", "c.region_id")} = b."row" AND c.grid_col = b.col AND b.w > 0.02e0""",
)
def neighborhood_score(spark, sf_dir):
    cells = GRID_CELLS.frame(spark, sf_dir).select("cell_index", "region_id", "grid_row", "grid_col", "detail_score")
    last = cells.agg(F.max("grid_col")).scalar()
    rows = F.when(F.col("region_id") == 0, 62).otherwise(66)
    apart = cells.withColumn("grid_row", F.expr(REGION_ROW))
    return grid_terrain.neighborhood_score(apart, rows=rows, cols=last + 3).select("cell_index", "neighborhood_score")


MAXIMA_SQL = f"""(WITH k AS (SELECT cell_index, region_id, grid_row, grid_col, detail_score FROM {GRID_CELLS.sql} WHERE label_code = 1 AND confidence >= 48)
 SELECT * FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.region_id = a.region_id AND abs(b.grid_row - a.grid_row) <= 2
   AND abs(b.grid_col - a.grid_col) <= 2 AND b.detail_score > a.detail_score))"""


@query("local_maxima", f"SELECT cell_index, region_id, detail_score FROM {MAXIMA_SQL}")
def local_maxima(spark, sf_dir):
    return grid_terrain.local_maxima(GRID_CELLS.frame(spark, sf_dir)).select("cell_index", "region_id", "detail_score")


HOTSPOTS_SQL = f"""WITH RECURSIVE ranked AS (SELECT region_id, grid_row, grid_col, detail_score,
   row_number() OVER (PARTITION BY region_id ORDER BY detail_score DESC, grid_row DESC, grid_col DESC) AS k FROM {{source}}),
walk AS (
  SELECT region_id, k, [{{{{'r': grid_row, 'c': grid_col, 's': detail_score}}}}] AS kept FROM ranked WHERE k = 1
  UNION ALL
  SELECT r.region_id, r.k, CASE WHEN len(list_filter(w.kept, lambda q: (q.r - r.grid_row) * (q.r - r.grid_row) + (q.c - r.grid_col) * (q.c - r.grid_col) < 12.25e0)) = 0
    THEN list_append(w.kept, {{{{'r': r.grid_row, 'c': r.grid_col, 's': r.detail_score}}}}) ELSE w.kept END
  FROM walk w JOIN ranked r ON r.region_id = w.region_id AND r.k = w.k + 1 WHERE len(w.kept) < 60),
spots AS (SELECT region_id, q.r AS grid_row, q.c AS grid_col, q.s AS detail_score, CAST(i - 1 AS INTEGER) AS hotspot_index FROM (
  SELECT region_id, unnest(kept) AS q, generate_subscripts(kept, 1) AS i FROM (SELECT region_id, arg_max(kept, k) AS kept FROM walk GROUP BY 1)))"""


@query("hotspots", HOTSPOTS_SQL.format(source=MAXIMA_SQL) + " SELECT * FROM spots")
def hotspots(spark, sf_dir):
    """Greedy suppression of the best cells, at most sixty a region."""
    return grid_terrain.suppress(grid_terrain.local_maxima(GRID_CELLS.frame(spark, sf_dir)))


@query(
    "grid_report",
    f"""SELECT label_code, count(*) AS n, min(original_score) AS original_min, max(original_score) AS original_max, min(detail_score) AS detail_min,
  max(detail_score) AS detail_max, min(confidence) AS confidence_min, max(confidence) AS confidence_max FROM {GRID_CELLS.sql} GROUP BY 1""",
)
def grid_report(spark, sf_dir):
    return grid_terrain.run_report(GRID_CELLS.frame(spark, sf_dir))
