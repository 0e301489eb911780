"""Inputs of the registered queries, derived from the given tables so that work grows with them.

Lattices grow in their columns only (rows stay 125 or 462 wide), which keeps every place on the map plausible at any
scale.
"""

from __future__ import annotations

from landlens.catalog.base import View

#: Zoom of the derived rasters: 62 m pixels at this latitude, so 125 rows span the terrain scales.
ZOOM = 11
#: Global pixel (row, col) of the lattice's first pixel: the pixel that holds (35.84, 139.43).
ORIGIN = (206168, 465203)
LAT0, LNG0 = 35.84, 139.43
PIXEL_LAT, PIXEL_LNG = 0.000557, 0.00068664

POINTS = View(
    """SELECT c_custkey AS point_id,
       35.28e0 + ((c_custkey * 7919) % 5600) / 1e4 AS lat,
       139.43e0 + ((c_custkey * 104729) % 5100) / 1e4 AS lng
FROM {customer}"""
)

NEAR_POINTS = View(
    """SELECT c_custkey AS point_id,
       35.8396478620176e0 - ((c_custkey * 7919) % 1400) / 10e0 * 0.00089831117499e0 AS lat,
       139.43e0 + (c_custkey * 0.08e0 + ((c_custkey * 104729) % 97) / 10e0) * 0.00110424522183e0 AS lng
FROM {customer}"""
)

LIVE_POINTS = View(
    f"""SELECT c_custkey AS point_id,
       {LAT0}e0 - ((c_custkey * 7919) % 1250) / 10e0 * {PIXEL_LAT}e0 AS lat,
       {LNG0}e0 + (c_custkey * 0.08e0 + ((c_custkey * 104729) % 97) / 100e0) * {PIXEL_LNG}e0 AS lng
FROM {{customer}}"""
)

DEM = View(
    """SELECT CAST(o_orderkey % 125 AS INT) AS grid_row,
       CAST(floor(o_orderkey / 125e0) AS INT) AS grid_col,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL
            ELSE floor(100e0 * (20e0 + 15e0 * sin(floor(o_orderkey / 125e0) / 9e0)
                 + 12e0 * cos((o_orderkey % 125) / 7e0) + (o_custkey % 100) / 50e0) + 0.5e0) / 100e0 END AS elevation
FROM {orders}"""
)

DEM_PIXELS = View(
    f"""SELECT CAST({ORIGIN[0]} + o_orderkey % 125 AS INT) AS gy,
       CAST({ORIGIN[1]} + floor(o_orderkey / 125e0) AS INT) AS gx,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL
            ELSE floor(100e0 * (20e0 + 15e0 * sin(floor(o_orderkey / 125e0) / 9e0)
                 + 12e0 * cos((o_orderkey % 125) / 7e0) + (o_custkey % 100) / 50e0) + 0.5e0) / 100e0 END AS elevation
FROM {{orders}}"""
)

#: Encoded elevation pixels of two prioritised sources; each misses some pixels, some are transparent or no data.
ENCODED = View(
    f"""SELECT CAST(floor(({ORIGIN[1]} + floor(o_orderkey / 125e0)) / 256e0) AS INT) AS x,
       CAST(floor(({ORIGIN[0]} + o_orderkey % 125) / 256e0) AS INT) AS y,
       CAST(({ORIGIN[1]} + floor(o_orderkey / 125e0)) % 256 AS INT) AS px,
       CAST(({ORIGIN[0]} + o_orderkey % 125) % 256 AS INT) AS py,
       priority,
       CAST(CASE WHEN (o_orderkey + priority) % 17 = 0 THEN 128 ELSE (o_orderkey * 37 + priority) % 256 END AS INT) AS r,
       CAST(CASE WHEN (o_orderkey + priority) % 17 = 0 THEN 0 ELSE (o_orderkey * 91) % 256 END AS INT) AS g,
       CAST(CASE WHEN (o_orderkey + priority) % 17 = 0 THEN 0 ELSE (o_orderkey * 53) % 256 END AS INT) AS b,
       CASE WHEN (o_orderkey + 2 * priority) % 5 = 0 THEN 0 ELSE 255 END AS a
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS priority FROM {{orders}}
      UNION ALL
      SELECT o_orderkey, 2 AS priority FROM {{orders}} WHERE o_orderstatus <> 'P')"""
)

HAZARDS = View(
    f"""SELECT CASE l_linenumber WHEN 1 THEN 'flood' WHEN 2 THEN 'innerWater' WHEN 3 THEN 'highTide'
            WHEN 4 THEN 'tsunami' WHEN 5 THEN 'landslide' ELSE 'wetland' END AS layer,
       CAST({ORIGIN[0]} + l_orderkey % 125 AS INT) AS gy,
       CAST({ORIGIN[1]} + floor(l_orderkey / 125e0) AS INT) AS gx,
       CAST(max(160 + (l_orderkey * 37) % 96) AS INT) AS r, CAST(max(60 + (l_orderkey * 91 + l_linenumber) % 196) AS INT) AS g,
       CAST(max(120 + (l_orderkey * 53 + l_linenumber) % 136) AS INT) AS b,
       CAST(max(CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 255 END) AS INT) AS a
FROM {{lineitem}}
GROUP BY 1, 2, 3"""
)

MESH = View(
    """SELECT CAST(17203 - p_partkey % 40 AS INT) AS mesh_row,
       CAST(44617 + floor(p_partkey / 40e0) AS INT) AS mesh_col,
       CAST((p_partkey * 7) % 30 AS INT) AS landform_code,
       CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_brand END AS landform_name,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 0.5e0 + (p_partkey * 11) % 200 / 100e0 END AS amplification
FROM {part}"""
)

HAZARD_PIXELS = View(
    """SELECT p_partkey AS point_id, CAST((p_partkey * 37) % 256 AS INT) AS r, CAST((p_partkey * 91) % 256 AS INT) AS g,
       CAST((p_partkey * 53) % 256 AS INT) AS b, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 255 END AS a
FROM {part}"""
)

LISTINGS = View(
    """SELECT o_orderkey AS listing_id, o_custkey AS building_id,
       concat(CASE n_nationkey % 3 WHEN 0 THEN '東京都目黒区東が丘' WHEN 1 THEN '世田谷区北沢' ELSE '横浜市青葉台' END,
              CAST(n_nationkey + 1 AS STRING), '丁目') AS town,
       CASE WHEN o_orderkey % 3 = 0 THEN concat(n_name, ' ', CAST(o_custkey AS STRING)) END AS address,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 60000e0 + floor(o_totalprice / 2.5e0) END AS total,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(10 + o_orderkey % 40 AS DOUBLE) END AS area,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(1 + o_orderkey % 6 AS DOUBLE) END AS floor_no,
       CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'stale' ELSE 'unknown' END AS currentness,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'exact'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'partial' ELSE 'unknown' END AS identity_state
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""
)

#: Small towns: one per group of buildings, so all sample qualities occur.
SMALL_TOWNS = View(
    """SELECT concat('町', CAST(floor(sqrt(CAST(o_custkey AS DOUBLE))) AS BIGINT)) AS town_key, o_custkey AS building_id,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 60000e0 + floor(o_totalprice / 2.5e0) END AS total,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(10 + o_orderkey % 40 AS DOUBLE) END AS area
FROM {orders}"""
)

#: Cells are numbered row by row, 462 to a row; sample cells are every second one and reach beyond the lens tables.
CELL = "concat('g', CAST(CAST(floor(({k}) / 462e0) AS BIGINT) AS STRING), '-', CAST(({k}) % 462 AS STRING))"


def cell(key: str) -> str:
    return CELL.replace("{k}", key)


SAMPLES = View(
    f"""SELECT c_custkey AS sample_id, n_name AS municipality, {cell("2 * c_custkey")} AS cell_id,
       CASE WHEN n_nationkey = 24 THEN NULL ELSE 40e0 + (c_custkey * 7) % 400 / 10e0 END AS lens_score,
       CASE WHEN n_nationkey = 24 THEN 'F_NO_ELIGIBLE_ZONE_CONTROL' ELSE
            CASE c_custkey % 5 WHEN 0 THEN 'A_LOCAL_TOP' WHEN 1 THEN 'B_UPPER_QUARTILE' WHEN 2 THEN 'C_LOCAL_MEDIAN'
                 WHEN 3 THEN 'D_UNCERTAINTY_REVIEW' ELSE 'E_LOCAL_BOTTOM_CONTROL' END END AS stratum,
       c_custkey % 4 = 0 AS exact_water_closed,
       CASE WHEN c_custkey % 6 = 0 THEN 'HIGH_EXACT_WATER_REQUIRED' ELSE 'LOW_NO_BOUNDED_SPLIT_SIGNAL' END AS split_risk
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey"""
)

CATALOG_RAW = View(
    f"""SELECT {cell("p_partkey")} AS cell_id, CAST(floor(p_partkey / 462e0) AS INT) AS grid_row,
       CAST(p_partkey % 462 AS INT) AS grid_col,
       CAST(CASE WHEN p_partkey % 19 = 0 THEN 255 ELSE p_size % 6 END AS INT) AS label_code,
       CAST(CASE WHEN p_partkey % 19 = 0 THEN 255 ELSE (p_partkey * 7) % 101 END AS INT) AS detail_score,
       CAST(CASE WHEN p_partkey % 23 = 0 THEN 255 ELSE (p_partkey * 3) % 101 END AS INT) AS original_score
FROM {{part}}"""
)

MOISTURE_RAW = View(
    f"""SELECT {cell("p_partkey")} AS cell_id,
       CASE WHEN p_partkey % 29 = 0 THEN 0 ELSE CAST(1 + (p_partkey * 13) % 5600 AS INT) END AS stored
FROM {{part}}"""
)

ENVIRONMENT_RAW = View(
    f"""SELECT {cell("p_partkey")} AS cell_id,
       CAST((CASE WHEN p_partkey % 31 = 0 THEN 0 ELSE 1 END) + 2 * (p_partkey % 2) + 4 * (p_partkey % 3 % 2)
            + 8 * (p_partkey % 4 % 2) + 16 * (1 + p_partkey % 5) + 128 * (p_partkey % 7 % 2) AS INT) AS b0,
       CAST(1 + p_partkey % 5 + 8 * (p_partkey % 5) AS INT) AS b1,
       CAST(p_partkey % 3 + 8 * (p_partkey % 3) + 64 * (1 + p_partkey % 3) AS INT) AS b2,
       CAST((p_partkey * 3) % 101 AS INT) AS b3, CAST((p_partkey * 5) % 101 AS INT) AS b4,
       CAST((p_partkey * 11) % 256 AS INT) AS b5, CAST(p_partkey % 4 AS INT) AS b6
FROM {{part}}"""
)

#: Links from line items; the same line may occur twice, so the order of links also uses the price.
LINKS = View(
    f"""SELECT {cell("CAST(floor(l_orderkey / 10e0) AS BIGINT)")} AS cell_id,
       concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-',
              CAST(l_suppkey AS STRING)) AS intake_id,
       CASE WHEN l_partkey % 3 = 0 THEN CAST(l_partkey AS STRING) END AS global_feature_id,
       CASE WHEN l_partkey % 3 = 1 THEN concat('G', CAST(l_suppkey AS STRING)) ELSE '' END AS independence_group,
       CAST(NULL AS STRING) AS canonical_source_identity,
       CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity * 10e0 END AS distance_m,
       CASE l_returnflag WHEN 'A' THEN 'YES' WHEN 'N' THEN 'no' ELSE NULL END AS public_eligible,
       CASE WHEN l_linestatus = 'F' THEN 'CONFIRMED'
            WHEN l_suppkey % 3 = 0 THEN 'source_review' WHEN l_suppkey % 3 = 1 THEN 'crosscheck' END AS evidence_status,
       CASE WHEN l_partkey % 11 = 0 THEN 'Identity_Conflict' END AS identity_decision,
       CASE l_linenumber WHEN 1 THEN 'REFERENCE_CONTEXT' WHEN 2 THEN 'DUPLICATE_SUPPRESSION' WHEN 3 THEN 'OPEN_IDENTITY'
            WHEN 4 THEN 'CURRENT_ANCHOR' WHEN 5 THEN 'SOURCE_OBSERVATION' WHEN 6 THEN 'PARENT_SITE_COMPONENT'
            ELSE 'GLOBAL_FEATURE' END AS index_lane,
       CASE WHEN l_suppkey % 5 = 0 THEN concat('stage_s', CAST(l_linenumber AS STRING)) END AS geometry_stage,
       CASE WHEN l_suppkey % 4 = 0 THEN 'FEATURE_LINK_QUERYABLE' ELSE 'CANDIDATE_ONLY' END AS query_status,
       '' AS final_disposition,
       CASE WHEN l_partkey % 13 = 0 THEN 'true' WHEN l_partkey % 13 = 1 THEN ' Yes ' ELSE 'false' END AS intersects,
       CASE WHEN l_partkey % 17 = 0 THEN 'Within_Buffer' ELSE 'near' END AS relation_type,
       CASE WHEN l_suppkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS positive_claim,
       concat('src:', CAST(l_suppkey AS STRING)) AS source_pointer,
       concat('P', CAST(l_suppkey % 4 AS STRING)) AS source_project,
       concat('T', CAST(l_partkey AS STRING)) AS source_title,
       concat(CAST(l_orderkey AS STRING), '|', CAST(l_linenumber AS STRING), '|', CAST(l_partkey AS STRING), '|',
              CAST(l_suppkey AS STRING), '|', CAST(l_quantity AS STRING)) AS link_order
FROM {{lineitem}}"""
)

#: 125 rows of cells on the canonical steps, split into two regions by row.
GRID_CELLS = View(
    """SELECT o_orderkey AS cell_index, CASE WHEN o_orderkey % 125 < 62 THEN 0 ELSE 1 END AS region_id,
       CAST(o_orderkey % 125 AS INT) AS grid_row, CAST(floor(o_orderkey / 125e0) AS INT) AS grid_col,
       35.8396478620176e0 - (o_orderkey % 125) * 0.00089831117499e0 AS lat,
       139.43e0 + floor(o_orderkey / 125e0) * 0.00110424522183e0 AS lng,
       floor(o_orderkey / 125e0) * 100e0 AS east, 0e0 - (o_orderkey % 125) * 100e0 AS north,
       CAST((o_orderkey * 53) % 101 AS INT) AS original_score, CAST((o_orderkey * 29) % 101 AS INT) AS aux_score,
       CAST((o_orderkey * 41) % 101 AS INT) AS detail_score,
       CAST((o_orderkey * 7) % 6 AS INT) AS label_code, CAST((o_orderkey * 11) % 101 AS INT) AS confidence
FROM {orders}"""
)

#: Hotspots: one per customer, on the same local metres as the cells.
HOTSPOTS = View(
    """SELECT CASE WHEN (c_custkey * 7919) % 125 < 62 THEN 0 ELSE 1 END AS region_id, c_custkey AS hotspot_index,
       CAST((c_custkey * 37) % 101 AS INT) AS detail_score,
       c_custkey * 8e0 + (c_custkey % 7) * 3e0 AS east, 0e0 - ((c_custkey * 7919) % 125) * 100e0 AS north
FROM {customer}"""
)

#: Region boxes of the grid, from the smallest and largest lattice row of each region.
REGIONS = View(
    """SELECT CASE WHEN o_orderkey % 125 < 62 THEN 0 ELSE 1 END AS region_id,
       CASE WHEN o_orderkey % 125 < 62 THEN 0 ELSE 1 END AS region_order,
       concat('R', CAST(CASE WHEN o_orderkey % 125 < 62 THEN 0 ELSE 1 END AS STRING)) AS region_name,
       100e0 AS step_m,
       35.8396478620176e0 - (max(o_orderkey % 125) + 0.5e0) * 0.00089831117499e0 AS south,
       139.43e0 - 0.5e0 * 0.00110424522183e0 AS west,
       35.8396478620176e0 - (min(o_orderkey % 125) - 0.5e0) * 0.00089831117499e0 AS north,
       139.43e0 + (max(floor(o_orderkey / 125e0)) + 0.5e0) * 0.00110424522183e0 AS east
FROM {orders} GROUP BY 1, 2, 3"""
)

#: Points a little off the centres of the sample cells; every third one came from an address.
PROFILE_POINTS = View(
    """SELECT c_custkey AS point_id,
       35.8396478620176e0 - (floor(2 * c_custkey / 462e0) + 0.2e0) * 0.00089831117499e0 AS lat,
       139.43e0 + ((2 * c_custkey) % 462 + 0.3e0) * 0.00110424522183e0 AS lng,
       CASE WHEN c_custkey % 3 = 0 THEN c_name END AS matched_address
FROM {customer}"""
)

FEATURES = View(
    """SELECT CAST(p_partkey AS STRING) AS feature_id, p_name AS canonical_name, p_type AS feature_type FROM {part}"""
)

GEOMETRIES = View(
    """SELECT CAST(o_custkey AS STRING) AS feature_id, o_orderkey AS seq, o_orderpriority AS geometry_role,
       o_orderstatus AS location_precision FROM {orders}"""
)
