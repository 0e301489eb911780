"""Nearest and range joins, masks, grids, gazetteer and municipality lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from landlens.catalog.base import query, six, table, up
from landlens.catalog.geo_queries import CELL_SQL, SCOPE_SQL
from landlens.catalog.inputs import GRID_CELLS, HOTSPOTS, NEAR_POINTS, POINTS, REGIONS
from landlens.functions import geo
from landlens.functions.numeric import half_up
from landlens.operators import filters, grid_terrain, lookups, spatial
from landlens.operators.lookups import theory_from_cell
from landlens.sources import grids

#: The latticed fixtures lie below this latitude, which keeps buckets tight.
LATITUDE = 36.0

# Stations of the corridor, in line order.
STATIONS = [
    ("渋谷", 35.659939, 139.699738),
    ("池尻大橋", 35.650869, 139.684594),
    ("三軒茶屋", 35.643726, 139.671962),
    ("駒沢大学", 35.633193, 139.661156),
    ("桜新町", 35.631724, 139.645369),
    ("用賀", 35.626437, 139.633264),
    ("二子玉川", 35.611387, 139.629109),
]


@query(
    "cells_in_bounds",
    f"SELECT cell_index, region_id, lat, lng FROM {GRID_CELLS.sql} WHERE lng BETWEEN 139.44e0 AND 139.5e0 AND lat BETWEEN 35.75e0 AND 35.8e0",
)
def cells_in_bounds(spark, sf_dir):
    cells = GRID_CELLS.frame(spark, sf_dir).select("cell_index", "region_id", "lat", "lng")
    return filters.cells_in_bounds(cells, 139.44, 35.75, 139.5, 35.8)


@query(
    "read_cells",
    f"""SELECT CAST(grid_col AS VARCHAR) AS region_id, CAST(grid_row AS INTEGER) AS cell_index, lat, lng, label_code, original_score, confidence, lat - 0.0005e0 AS south
FROM {GRID_CELLS.sql}""",
)
def read_cells(spark, sf_dir):
    """Nested grid documents (one per lattice column, 125 cells each) to flat cells."""
    rows = GRID_CELLS.frame(spark, sf_dir)
    value = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    types = {f.name: f.dataType for f in grids.GRID_SCHEMA["cells"].dataType.elementType}
    corner = F.array(F.array(F.col("lat") - 0.0005, F.col("lng")), F.array(F.col("lat"), F.col("lng")))
    cell = F.struct(
        "grid_row",
        F.struct(
            *[value(new).cast(types[old]).alias(old) for old, new in grids.CELL_NAMES], corner.alias("bounds")
        ).alias("cell"),
    )
    docs = rows.groupBy(F.col("grid_col").cast("string").alias("region_id")).agg(
        F.transform(F.sort_array(F.collect_list(cell)), lambda x: x["cell"]).alias("cells")
    )
    return grids.grid_cells(docs).select(
        "region_id", "cell_index", "lat", "lng", "label_code", "original_score", "confidence", "south"
    )


@query(
    "region_meta",
    f"""SELECT r.region_id, r.region_name, r.step_m, {six("r.south")} AS south, {six("r.east")} AS east, count(cell_index) AS cell_count
FROM {REGIONS.sql} r LEFT JOIN {GRID_CELLS.sql} c ON r.region_id = c.region_id GROUP BY ALL""",
)
def region_meta(spark, sf_dir):
    meta = grids.region_meta(GRID_CELLS.frame(spark, sf_dir), REGIONS.frame(spark, sf_dir))
    return meta.select(
        "region_id", "region_name", "step_m", half_up(F.col("south"), 6).alias("south"),
        half_up(F.col("east"), 6).alias("east"), "cell_count",
    )


PAIR_DIST = (
    "sqrt(pow((p.lat - c.lat) * 111320e0, 2) + pow((p.lng - c.lng) * 111320e0 * "
    "greatest(0.2e0, cos(radians((p.lat + c.lat) / 2e0))), 2))"
)
NEAREST_SQL = f"""(SELECT n.point_id, n.lat, n.lng, region_id, cell_index, d AS distance_m FROM {NEAR_POINTS.sql} n LEFT JOIN (
     SELECT p.point_id, c.region_id, c.cell_index, {PAIR_DIST} AS d,
            row_number() OVER (PARTITION BY p.point_id ORDER BY {PAIR_DIST}, c.region_id, c.cell_index) AS k
     FROM {NEAR_POINTS.sql} p JOIN {GRID_CELLS.sql} c ON abs(p.lat - c.lat) <= 0.002e0 AND abs(p.lng - c.lng) <= 0.002e0
     JOIN {REGIONS.sql} r ON c.region_id = r.region_id
      AND p.lat BETWEEN r.south AND r.north AND p.lng BETWEEN r.west AND r.east) b
   ON n.point_id = b.point_id AND k = 1 AND d <= 100e0)"""


def nearest(spark, sf_dir):
    cells = GRID_CELLS.frame(spark, sf_dir).select("region_id", "cell_index", "lat", "lng")
    return spatial.nearest_cell(
        NEAR_POINTS.frame(spark, sf_dir), cells, REGIONS.frame(spark, sf_dir), max_lat=LATITUDE
    )


@query("nearest_cell", f"SELECT point_id, region_id, cell_index, {six('distance_m')} AS distance_m FROM {NEAREST_SQL}")
def nearest_cell(spark, sf_dir):
    out = nearest(spark, sf_dir)
    return out.select("point_id", "region_id", "cell_index", half_up(F.col("distance_m"), 6).alias("distance_m"))


NEARBY_SQL = f"""(SELECT c.cell_index, c.region_id, coalesce(b.hotspot_index, -1) AS nearby_best_index,
   CAST(round_even(b.d, 0) AS INTEGER) AS nearby_best_distance
 FROM {GRID_CELLS.sql} c LEFT JOIN (
   SELECT cell_index, hotspot_index, d, row_number() OVER (PARTITION BY cell_index ORDER BY detail_score DESC, d, hotspot_index DESC) AS k
   FROM (SELECT c.cell_index, h.hotspot_index, h.detail_score, sqrt(pow(c.east - h.east, 2) + pow(c.north - h.north, 2)) AS d
         FROM {GRID_CELLS.sql} c JOIN {HOTSPOTS.sql} h ON c.region_id = h.region_id AND abs(c.east - h.east) <= 1000e0
          AND abs(c.north - h.north) <= 1000e0) WHERE d <= 1000e0) b ON c.cell_index = b.cell_index AND b.k = 1)"""


@query("nearby_best", f"SELECT * FROM {NEARBY_SQL}")
def nearby_best(spark, sf_dir):
    cells = GRID_CELLS.frame(spark, sf_dir).select("cell_index", "region_id", "east", "north")
    out = spatial.nearby_best(cells, HOTSPOTS.frame(spark, sf_dir))
    return out.drop("east", "north")


STATION_VALUES = ", ".join(f"('{n}', {a}e0, {b}e0)" for n, a, b in STATIONS)
STATION_DIST = (
    "sqrt(pow((lat - s_lat) * 111320e0, 2) + pow((lng - s_lng) * 111320e0 * cos(radians((lat + s_lat) / 2e0)), 2))"
)


@query(
    "nearest_station",
    f"""SELECT point_id, name AS nearest_station, CAST(round_even(d, 0) AS INTEGER) AS station_distance FROM (
  SELECT point_id, name, {STATION_DIST} AS d, row_number() OVER (PARTITION BY point_id ORDER BY {STATION_DIST}, name) AS k
  FROM {POINTS.sql}, (VALUES {STATION_VALUES}) s(name, s_lat, s_lng)) WHERE k = 1""",
)
def nearest_station(spark, sf_dir):
    return spatial.nearest_station(POINTS.frame(spark, sf_dir), STATIONS).drop("lat", "lng")


CORRIDOR_CENTRE = (35.635663, 139.664424)


def _route() -> list[tuple[float, float]]:
    import math

    scale = geo.METERS_PER_DEGREE * math.cos(math.radians(CORRIDOR_CENTRE[0]))
    return [((g - CORRIDOR_CENTRE[1]) * scale, (a - CORRIDOR_CENTRE[0]) * geo.METERS_PER_DEGREE) for _, a, g in STATIONS]


#: Positions around the corridor in whole metres, one per order.
NEAR_ROUTE = "SELECT o_orderkey, CAST((o_orderkey * 7919) % 9001 - 4500 AS DOUBLE) AS east, CAST((o_orderkey * 104729) % 9001 - 4500 AS DOUBLE) AS north"


def _segments() -> str:
    r = _route()
    return ", ".join(f"({a!r}e0, {b!r}e0, {c!r}e0, {d!r}e0)" for (a, b), (c, d) in zip(r[:-1], r[1:]))


@query(
    "corridor_mask",
    f"""SELECT o_orderkey, min(sqrt(pow(east - (e0 + t * (e1 - e0)), 2) + pow(north - (n0 + t * (n1 - n0)), 2))) <= 1001e0 AS in_corridor,
       any_value(east * east + north * north <= 4500e0 * 4500e0 + 1e0) AS in_circle
FROM (SELECT *, least(1e0, greatest(0e0, ((east - e0) * (e1 - e0) + (north - n0) * (n1 - n0)) / (pow(e1 - e0, 2) + pow(n1 - n0, 2)))) AS t
      FROM ({NEAR_ROUTE} FROM orders), (VALUES {_segments()}) s(e0, n0, e1, n1)) GROUP BY 1""",
)
def corridor_mask(spark, sf_dir):
    rows = spark.sql(NEAR_ROUTE + " FROM {orders}", orders=table(spark, sf_dir, "orders"))
    east, north = F.col("east"), F.col("north")
    return rows.select(
        "o_orderkey",
        filters.corridor_mask(east, north, _route(), 1000.0).alias("in_corridor"),
        filters.circle_mask(east, north, 4500.0).alias("in_circle"),
    )


#: One polygon per supplier: a diamond with a square hole, as ring vertices in order.
CORNERS = (
    (0, 0, 0.030, 0.000), (0, 1, 0.000, 0.020), (0, 2, -0.030, 0.000), (0, 3, 0.000, -0.020), (0, 4, 0.030, 0.000),
    (1, 0, 0.005, 0.005), (1, 1, -0.005, 0.005), (1, 2, -0.005, -0.005), (1, 3, 0.005, -0.005), (1, 4, 0.005, 0.005),
)
POLYGON_AT = "SELECT s_suppkey AS polygon_id, 139.4313e0 + (s_suppkey * 5077 % 5100) / 1e4 AS clng, 35.2817e0 + (s_suppkey * 3911 % 5600) / 1e4 AS clat"


def _corner_rows() -> str:
    return ", ".join(f"({r}, {s}, {x}e0, {y}e0)" for r, s, x, y in CORNERS)


@query(
    "polygon_mask",
    f"""WITH v AS (SELECT polygon_id, ring_id, seq, clng + dx AS lng, clat + dy AS lat
             FROM ({POLYGON_AT} FROM supplier), (VALUES {_corner_rows()}) c(ring_id, seq, dx, dy)),
e AS (SELECT polygon_id, lng AS x1, lat AS y1, lead(lng) OVER w AS x2, lead(lat) OVER w AS y2 FROM v
      WINDOW w AS (PARTITION BY polygon_id, ring_id ORDER BY seq)),
i AS (SELECT p.point_id FROM {POINTS.sql} p JOIN e ON (y1 > p.lat) <> (y2 > p.lat)
      AND p.lng < CASE WHEN y2 <> y1 THEN x1 + (x2 - x1) * (p.lat - y1) / (y2 - y1) END
      WHERE x2 IS NOT NULL GROUP BY p.point_id, e.polygon_id HAVING count(*) % 2 = 1)
SELECT point_id, point_id IN (SELECT point_id FROM i) AS inside FROM {POINTS.sql}""",
)
def polygon_mask(spark, sf_dir):
    at = spark.sql(POLYGON_AT + " FROM {supplier}", supplier=table(spark, sf_dir, "supplier"))
    corners = F.array(
        *[
            F.struct(F.lit(r).alias("ring_id"), F.lit(s).alias("seq"), F.lit(x).alias("dx"), F.lit(y).alias("dy"))
            for r, s, x, y in CORNERS
        ]
    )
    vertices = at.withColumn("c", F.explode(corners)).select(
        "polygon_id", "c.ring_id", "c.seq", (F.col("clng") + F.col("c.dx")).alias("lng"),
        (F.col("clat") + F.col("c.dy")).alias("lat"),
    )
    return spatial.polygon_mask(POINTS.frame(spark, sf_dir), vertices).select("point_id", "inside")


FEATURES = "CAST(13090 + o_orderkey % 1060 AS STRING) AS admin_code"


@query(
    "filter_boundaries",
    f"""SELECT o_orderkey, admin_code FROM (SELECT o_orderkey, {FEATURES.replace('STRING', 'VARCHAR')} FROM orders)
WHERE admin_code BETWEEN '13101' AND '13123' OR admin_code BETWEEN '14101' AND '14118' OR admin_code BETWEEN '14131' AND '14137'""",
)
def filter_boundaries(spark, sf_dir):
    features = table(spark, sf_dir, "orders").selectExpr("o_orderkey", FEATURES)
    return grids.filter_boundaries(features)


@query(
    "make_grid",
    """WITH r AS (SELECT s_suppkey AS region_id, 500e0 + 100e0 * (s_suppkey % 8) AS extent_m FROM supplier),
g AS (SELECT *, unnest(range(0, CAST(floor(extent_m * 2 / 100) AS BIGINT) + 1)) AS i FROM r),
h AS (SELECT *, unnest(range(0, CAST(floor(extent_m * 2 / 100) AS BIGINT) + 1)) AS j FROM g)
SELECT region_id, CAST(i AS INTEGER) AS grid_row, CAST(j AS INTEGER) AS grid_col, j * 100e0 - extent_m AS east, extent_m - i * 100e0 AS north
FROM h WHERE pow(j * 100e0 - extent_m, 2) + pow(extent_m - i * 100e0, 2) <= 640000e0 + 1e0""",
)
def make_grid(spark, sf_dir):
    regions = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS region_id", "500e0 + 100e0 * (s_suppkey % 8) AS extent_m"
    )
    lattice = grid_terrain.make_grid(regions)
    masked = lattice.filter(filters.circle_mask(F.col("east"), F.col("north"), 800.0))
    return masked.select("region_id", "grid_row", "grid_col", "east", "north")


VIEWS = "SELECT s_suppkey AS view_id, 139.4e0 + (s_suppkey % 50) / 100e0 AS west, 35.3e0 + (s_suppkey % 47) / 100e0 AS south, CAST(s_suppkey % 9 AS DOUBLE) AS cols, CAST(s_suppkey % 7 AS DOUBLE) AS rows_asked"
VIEW_GRID_SQL = f"""WITH v AS (SELECT *, west + 0.2e0 AS east, south + 0.1e0 AS north,
  {up("least(5e0, greatest(2e0, CASE WHEN cols = 0 THEN 4e0 ELSE cols END))")} AS nc,
  {up("least(4e0, greatest(2e0, CASE WHEN rows_asked = 0 THEN 3e0 ELSE rows_asked END))")} AS nr FROM ({VIEWS} FROM supplier)),
g AS (SELECT *, unnest(range(0, nc * nr)) AS k FROM v),
p AS (SELECT view_id, CAST(k AS INTEGER) AS cell, south + (k // nc) * ((north - south) / nr) + (north - south) / nr / 2e0 AS lat,
        west + (k % nc) * ((east - west) / nc) + (east - west) / nc / 2e0 AS lng FROM g)
SELECT view_id, cell, {six("lat")} AS lat, {six("lng")} AS lng FROM p WHERE {SCOPE_SQL}"""


@query("viewport_grid", VIEW_GRID_SQL)
def viewport_grid(spark, sf_dir):
    views = spark.sql(VIEWS + " FROM {supplier}", supplier=table(spark, sf_dir, "supplier"))
    views = views.withColumn("east", F.col("west") + 0.2).withColumn("north", F.col("south") + 0.1)
    cells = grid_terrain.viewport_grid(views, F.col("cols"), F.col("rows_asked"))
    return cells.select("view_id", "cell", half_up(F.col("lat"), 6).alias("lat"), half_up(F.col("lng"), 6).alias("lng"))


@query(
    "cell_bounds",
    "SELECT cell_index, "
    + ", ".join(
        f"round_even({expr}, 6) AS {name}"
        for name, expr in (
            ("south", "35.8e0 + (north - 50e0) / 111320e0"),
            ("west", "139.43e0 + (east - 50e0) / (111320e0 * cos(radians(35.8e0)))"),
            ("north_edge", "35.8e0 + (north + 50e0) / 111320e0"),
            ("east_edge", "139.43e0 + (east + 50e0) / (111320e0 * cos(radians(35.8e0)))"),
        )
    )
    + f" FROM {GRID_CELLS.sql}",
)
def cell_bounds(spark, sf_dir):
    cells = GRID_CELLS.frame(spark, sf_dir).select("cell_index", "east", "north")
    return grid_terrain.cell_bounds(cells, (35.8, 139.43)).drop("east", "north")


THEORY_CELL = """o_orderkey AS cell_index, CASE WHEN o_orderkey % 125 < 62 THEN 0 ELSE 1 END AS region_id,
  CAST((o_orderkey * 7) % 6 AS INT) AS label_code, CAST((o_orderkey * 53) % 101 AS INT) AS original_score,
  CAST((o_orderkey * 3) % 101 AS INT) AS original_fit, (o_orderkey % 1000) / 1e3 AS high_evidence,
  (o_orderkey * 3 % 1000) / 1e3 AS low_evidence, (o_orderkey * 7 % 1000) / 1e3 AS ordinary_evidence,
  CAST((o_orderkey * 29) % 101 AS INT) AS auxiliary_score, CAST((o_orderkey * 41) % 101 AS INT) AS detail_score,
  CAST((o_orderkey * 43) % 101 AS INT) AS neighborhood_score, CAST((o_orderkey * 11) % 101 AS INT) AS confidence,
  CAST(o_custkey % 300 - 10 AS BIGINT) AS nearby_best_index, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 900 AS INT) END AS nearby_best_distance"""


def theory_sql() -> str:
    pct = lambda c: up(f"{c} * 100e0")
    return f"""(SELECT p.point_id, detail_score AS score, label_code, original_score, confidence,
   CASE WHEN nearby_best_index >= 0 AND nearby_best_distance IS NOT NULL THEN h.hot_score END AS best_score,
   CASE WHEN h.hotspot_index IS NOT NULL THEN nearby_best_distance END AS nearby_best_distance,
   concat('原典交会：高位×高位 ', {pct("high_evidence")}, '／低位×低位 ', {pct("low_evidence")}, '／高位×低位 ', {pct("ordinary_evidence")},
     '|原典ロジック点 ', original_score, '／補助地形点 ', auxiliary_score, '|原典80%＋補助地形20%で地点詳細点 ', detail_score,
     '|半径500mの周辺点 ', neighborhood_score, '|', region_name, 'を100m間隔で事前計算') AS reasons
 FROM {NEAREST_SQL} p JOIN (SELECT {THEORY_CELL} FROM orders) c ON p.region_id = c.region_id AND p.cell_index = c.cell_index
 LEFT JOIN (SELECT region_id, hotspot_index, detail_score AS hot_score FROM {HOTSPOTS.sql}) h ON c.region_id = h.region_id AND c.nearby_best_index = h.hotspot_index
 JOIN (SELECT region_id, region_name FROM {REGIONS.sql}) r ON r.region_id = c.region_id)"""


def theory_cells(spark, sf_dir):
    return spark.sql(
        f"SELECT {THEORY_CELL}, 0e0 AS lat, 0e0 AS lng, 0e0 AS south, 0e0 AS west, 0e0 AS north, 0e0 AS east FROM {{orders}}",
        orders=table(spark, sf_dir, "orders"),
    )


@query("theory_from_cell", f"SELECT * FROM {theory_sql()}")
def theory_from_cell_query(spark, sf_dir):
    hits = nearest(spark, sf_dir).filter(F.col("cell_index").isNotNull())
    out = theory_from_cell(
        hits, theory_cells(spark, sf_dir), HOTSPOTS.frame(spark, sf_dir), REGIONS.frame(spark, sf_dir)
    )
    return out.select(
        "point_id", "score", "label_code", "original_score", "confidence",
        F.col("nearby_best.detail_score").alias("best_score"), "nearby_best_distance",
        F.array_join("reasons", "|").alias("reasons"),
    )


#: Gazetteer: each part is one entry of the name its brand asks for; some labels are empty or out of scope.
GAZETTEER = """SELECT concat('q', CAST(p_partkey % 150 AS STRING)) AS query, p_partkey AS source_order,
  CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN concat('大阪府', p_name) WHEN p_partkey % 3 = 0 THEN concat('横浜市', p_brand)
       ELSE concat('東京都目黒区', p_brand) END AS label,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 35e0 + p_size / 100e0 END AS lat, 139e0 + p_size / 90e0 AS lng"""
ASKED = "SELECT c_custkey AS query_id, CASE WHEN c_custkey % 40 = 0 THEN 'q' ELSE concat(' q', CAST(c_custkey % 170 AS STRING), ' ') END AS query"


@query(
    "geocode_candidates",
    f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY source_order) AS k FROM ({GAZETTEER.replace("STRING", "VARCHAR")} FROM part)
  WHERE label <> '' AND lat IS NOT NULL AND NOT contains(label, '大阪府'))
SELECT query_id, trim(a.query) AS query, CAST(k AS INTEGER) AS rank, label, lat, lng
FROM ({ASKED.replace("STRING", "VARCHAR")} FROM customer) a JOIN g ON trim(a.query) = g.query WHERE k <= 5 AND length(trim(a.query)) >= 2""",
)
def geocode_candidates(spark, sf_dir):
    asked = spark.sql(ASKED + " FROM {customer}", customer=table(spark, sf_dir, "customer"))
    gazetteer = spark.sql(GAZETTEER + " FROM {part}", part=table(spark, sf_dir, "part"))
    return lookups.geocode_candidates(asked, gazetteer).select("query_id", "query", "rank", "label", "lat", "lng")


#: Cell to municipality code, one row per cell that some point of the table falls in; a few lookups failed.
CODES_AT = """concat(CAST(13098 + point_id % 1050 AS STRING), '0') AS admin_code, concat('町', CAST(point_id % 90 AS STRING)) AS address, point_id % 13 = 0 AS failed"""
CODES_SQL = f"""(SELECT concat('g', {CELL_SQL[0]}, '-', {CELL_SQL[1]}) AS cell_id, {CODES_AT.replace("STRING", "VARCHAR")} FROM {POINTS.sql}
 QUALIFY row_number() OVER (PARTITION BY concat('g', {CELL_SQL[0]}, '-', {CELL_SQL[1]}) ORDER BY point_id) = 1)"""


@query(
    "municipality_of",
    f"""WITH p AS (SELECT *, ({SCOPE_SQL}) AS inside, concat('g', {CELL_SQL[0]}, '-', {CELL_SQL[1]}) AS cell FROM {POINTS.sql}),
j AS (SELECT p.*, c.*, coalesce(NOT failed, false) AND inside AS hit, substring(admin_code, 1, 5) AS c5 FROM p LEFT JOIN {CODES_SQL} c ON p.inside AND p.cell = c.cell_id)
SELECT point_id, CASE WHEN inside THEN cell END AS cell_id,
  CASE WHEN NOT inside THEN false WHEN NOT hit THEN true ELSE c5 BETWEEN '13101' AND '13123' OR c5 BETWEEN '14100' AND '14118' OR c5 BETWEEN '14130' AND '14137' END AS supported,
  CASE WHEN NOT inside THEN '対象範囲外' WHEN NOT hit THEN '対象範囲（境界照合は暫定）' WHEN c5 BETWEEN '13101' AND '13123' THEN '東京23区'
       WHEN c5 BETWEEN '14100' AND '14118' THEN '横浜市' WHEN c5 BETWEEN '14130' AND '14137' THEN '川崎市' ELSE '対象範囲外' END AS scope_name,
  CASE WHEN hit THEN c5 END AS municipality_code, CASE WHEN hit THEN address END AS address,
  CASE WHEN hit THEN 'reverse-lookup' ELSE 'rough-bounds' END AS scope_source FROM j""",
)
def municipality_of(spark, sf_dir):
    points = POINTS.frame(spark, sf_dir)
    return lookups.municipality_of(points, municipality_codes(points)).drop("lat", "lng")


def municipality_codes(points):
    cell = geo.canonical_cell(F.col("lat"), F.col("lng"))
    rows = points.withColumn("cell_id", cell.cell_id)
    entry = F.struct(
        F.expr("concat(CAST(13098 + point_id % 1050 AS STRING), '0')").alias("admin_code"),
        F.expr("concat('町', CAST(point_id % 90 AS STRING))").alias("address"),
        F.expr("point_id % 13 = 0").alias("failed"),
    )
    return rows.groupBy("cell_id").agg(F.min_by(entry, "point_id").alias("e")).select("cell_id", "e.*")
