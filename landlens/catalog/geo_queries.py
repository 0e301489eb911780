"""Coordinates, scope, text rules and request validation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from landlens.catalog.base import query, six, table, up
from landlens.catalog.inputs import LISTINGS, POINTS
from landlens.functions import geo, labels, numeric, text
from landlens.operators import filters

PI = repr(math.pi)


@query(
    "geo_offsets",
    f"""SELECT point_id, {six("lat + n / 111320e0")} AS lat_off,
       {six("lng + e / (111320e0 * greatest(0.2e0, cos(radians(lat))))")} AS lng_off,
       {six("lat + cos(radians(b)) * d / 111320e0")} AS lat_at,
       {six("lng + sin(radians(b)) * d / (111320e0 * greatest(0.2e0, cos(radians(lat))))")} AS lng_at,
       printf('%.6f, %.6f', lat, lng) AS coordinate
FROM (SELECT *, CAST(point_id % 900 AS DOUBLE) AS e, CAST(point_id % 700 AS DOUBLE) AS n,
             CAST(point_id % 360 AS DOUBLE) AS b, CAST(point_id % 3000 AS DOUBLE) AS d FROM {POINTS.sql})""",
)
def geo_offsets(spark, sf_dir):
    p = POINTS.frame(spark, sf_dir)
    by = lambda m: (F.col("point_id") % m).cast("double")
    off = geo.offset_point(F.col("lat"), F.col("lng"), by(900), by(700))
    at = geo.point_at(F.col("lat"), F.col("lng"), by(3000), by(360))
    r = lambda v: numeric.half_up(v, 6)
    return p.select(
        "point_id", r(off.lat).alias("lat_off"), r(off.lng).alias("lng_off"), r(at.lat).alias("lat_at"),
        r(at.lng).alias("lng_at"), geo.format_coordinate(F.col("lat"), F.col("lng")).alias("coordinate"),
    )


@query(
    "tile_pixel",
    f"""WITH p AS (
  SELECT point_id, (lng + 180e0) / 360e0 * 32768e0 AS fx,
         (1e0 - asinh(tan(radians(greatest(-85.05112878e0, least(85.05112878e0, lat))))) / {PI}) / 2e0 * 32768e0 AS fy
  FROM {POINTS.sql})
SELECT point_id, CAST(floor(fx) AS INTEGER) AS x, CAST(floor(fy) AS INTEGER) AS y,
       CAST(least(255, greatest(0, floor((fx - floor(fx)) * 256))) AS INTEGER) AS px,
       CAST(least(255, greatest(0, floor((fy - floor(fy)) * 256))) AS INTEGER) AS py,
       {six("fx * 256e0")} AS world_x, {six("fy * 256e0")} AS world_y
FROM p""",
)
def tile_pixel(spark, sf_dir):
    p = POINTS.frame(spark, sf_dir)
    t = geo.tile_pixel(F.col("lat"), F.col("lng"), 15)
    x, y = geo.world_pixel(F.col("lat"), F.col("lng"), 15)
    return p.select(
        "point_id", t.x.alias("x"), t.y.alias("y"), t.px.alias("px"), t.py.alias("py"),
        numeric.half_up(x, 6).alias("world_x"), numeric.half_up(y, 6).alias("world_y"),
    )


CENTRE = (35.667228, 139.759732)


@query(
    "local_offsets",
    f"""WITH p AS (SELECT point_id, (lng - {CENTRE[1]}e0) * 111320e0 * cos(radians({CENTRE[0]}e0)) AS e,
                          (lat - {CENTRE[0]}e0) * 111320e0 AS n FROM {POINTS.sql})
SELECT point_id, {six("e")} AS east, {six("n")} AS north, {six(f"{CENTRE[0]}e0 + n / 111320e0")} AS lat_back,
       {six(f"{CENTRE[1]}e0 + e / (111320e0 * cos(radians({CENTRE[0]}e0)))")} AS lng_back FROM p""",
)
def local_offsets(spark, sf_dir):
    east, north = geo.local_offsets(F.col("lat"), F.col("lng"), CENTRE)
    back = geo.offset_coordinates(east, north, CENTRE)
    r = lambda v, n: numeric.half_up(v, 6).alias(n)
    return POINTS.frame(spark, sf_dir).select(
        "point_id", r(east, "east"), r(north, "north"), r(back.lat, "lat_back"), r(back.lng, "lng_back")
    )


DIST = (
    "sqrt(pow((lat - {a}) * 111320e0, 2) + pow((lng - {b}) * 111320e0 * "
    "greatest(0.2e0, cos(radians((lat + {a}) / 2e0))), 2))"
)


@query(
    "point_distance",
    f"""SELECT point_id, {six(DIST.format(a=f"{CENTRE[0]}e0", b=f"{CENTRE[1]}e0"))} AS distance_m
FROM {POINTS.sql}""",
)
def point_distance(spark, sf_dir):
    d = geo.planar_distance(F.col("lat"), F.col("lng"), F.lit(CENTRE[0]), F.lit(CENTRE[1]))
    return POINTS.frame(spark, sf_dir).select("point_id", numeric.half_up(d, 6).alias("distance_m"))


CELL_SQL = (
    up("(35.8396478620176e0 - lat) / 0.00089831117499e0"),
    up("(lng - 139.43e0) / 0.00110424522183e0"),
)


@query(
    "canonical_cell",
    f"""WITH c AS (SELECT point_id, {CELL_SQL[0]} AS grid_row, {CELL_SQL[1]} AS grid_col FROM {POINTS.sql})
SELECT point_id, grid_row, grid_col, concat('g', grid_row, '-', grid_col) AS cell_id,
       {six("35.8396478620176e0 - grid_row * 0.00089831117499e0")} AS center_lat,
       {six("139.43e0 + grid_col * 0.00110424522183e0")} AS center_lng FROM c""",
)
def canonical_cell(spark, sf_dir):
    c = geo.canonical_cell(F.col("lat"), F.col("lng"))
    return POINTS.frame(spark, sf_dir).select(
        "point_id", c.row.alias("grid_row"), c.col.alias("grid_col"), c.cell_id.alias("cell_id"),
        numeric.half_up(c.lat, 6).alias("center_lat"), numeric.half_up(c.lng, 6).alias("center_lng"),
    )


BROKEN_IDS = "CASE WHEN p_partkey % 7 = 0 THEN concat('x', p_name) ELSE concat('g', p_partkey, '-', p_size) END"


@query(
    "parse_cell_id",
    f"""SELECT p_partkey, CASE WHEN regexp_full_match(id, 'g[0-9]+-[0-9]+') THEN CAST(regexp_extract(id, 'g([0-9]+)-', 1) AS INTEGER) END AS grid_row,
       CASE WHEN regexp_full_match(id, 'g[0-9]+-[0-9]+') THEN CAST(regexp_extract(id, '-([0-9]+)$', 1) AS INTEGER) END AS grid_col,
       CASE WHEN NOT regexp_full_match(id, 'g[0-9]+-[0-9]+') THEN 'malformed_cell_id' END AS error_code
FROM (SELECT p_partkey, {BROKEN_IDS} AS id FROM part)""",
)
def parse_cell_id(spark, sf_dir):
    ids = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{BROKEN_IDS} AS id")
    row, col, error = geo.parse_cell_id(F.col("id"))
    return ids.select("p_partkey", row.alias("grid_row"), col.alias("grid_col"), error.alias("error_code"))


SCOPE_SQL = " OR ".join(
    f"(lat BETWEEN {s}e0 AND {n}e0 AND lng BETWEEN {w}e0 AND {e}e0)" for s, n, w, e in geo.SCOPE_BOXES
)


@query("rough_scope", f"SELECT point_id, lat, lng FROM {POINTS.sql} WHERE {SCOPE_SQL}")
def rough_scope(spark, sf_dir):
    return filters.in_rough_scope(POINTS.frame(spark, sf_dir))


CODES = "concat(CAST(13095 + o_orderkey % 1100 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE '' END)"


@query(
    "scope_from_code",
    f"""WITH c AS (SELECT o_orderkey, substring({CODES.replace("STRING", "VARCHAR")}, 1, 5) AS code5 FROM orders)
SELECT o_orderkey, code5, CASE WHEN code5 BETWEEN '13101' AND '13123' THEN '東京23区'
         WHEN code5 BETWEEN '14100' AND '14118' THEN '横浜市' WHEN code5 BETWEEN '14130' AND '14137' THEN '川崎市'
         ELSE '対象範囲外' END AS scope_name,
       code5 BETWEEN '13101' AND '13123' OR code5 BETWEEN '14100' AND '14118'
         OR code5 BETWEEN '14130' AND '14137' AS supported FROM c""",
)
def scope_from_code(spark, sf_dir):
    codes = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{CODES} AS code")
    code5, name, supported = geo.scope_from_code(F.col("code"))
    return codes.select("o_orderkey", code5.alias("code5"), name.alias("scope_name"), supported.alias("supported"))


ADDRESSES = (
    "concat(CASE o_orderkey % 6 WHEN 0 THEN '東京都目黒区' WHEN 1 THEN '目黒区' WHEN 2 THEN '神奈川県横浜市' "
    "WHEN 3 THEN '川崎市中原区' WHEN 4 THEN '東京都町田市' ELSE '大阪市北区' END, CAST(o_custkey AS STRING))"
)


@query(
    "address_in_scope",
    f"""SELECT o_orderkey, regexp_matches(a, '東京都({"|".join(geo.WARDS)})|横浜市|川崎市') AS in_scope
FROM (SELECT o_orderkey, {ADDRESSES.replace("STRING", "VARCHAR")} AS a FROM orders)""",
)
def address_in_scope(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{ADDRESSES} AS a")
    return rows.select("o_orderkey", geo.address_in_scope(F.col("a")).alias("in_scope"))


@query(
    "in_circle",
    f"""SELECT point_id, lat, lng FROM {POINTS.sql}
WHERE {DIST.format(a=f"{CENTRE[0]}e0", b=f"{CENTRE[1]}e0")} <= 4600e0""",
)
def in_circle(spark, sf_dir):
    return filters.in_circle(POINTS.frame(spark, sf_dir), CENTRE, 4500.0)


@query(
    "validate_requests",
    """WITH r AS (SELECT c_custkey, c_acctbal / 50e0 AS lat, c_acctbal / 30e0 AS lng,
                  (c_custkey % 100) / 400e0 AS dx, (c_custkey % 70) / 300e0 - 0.01e0 AS dy FROM customer)
SELECT c_custkey, CASE WHEN NOT (lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180) THEN 'invalid_coordinate' END AS point_error,
       CASE WHEN NOT ((139.5e0 + dx) > 139.5e0 AND (35.5e0 + dy) > 35.5e0 AND (139.5e0 + dx) - 139.5e0 <= 0.25e0
                      AND (35.5e0 + dy) - 35.5e0 <= 0.2e0) THEN 'invalid_bounds' END AS bounds_error FROM r""",
)
def validate_requests(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_acctbal / 50e0 AS lat", "c_acctbal / 30e0 AS lng",
        "139.5e0 + (c_custkey % 100) / 400e0 AS east", "35.5e0 + ((c_custkey % 70) / 300e0 - 0.01e0) AS north",
    )
    return rows.select(
        "c_custkey",
        filters.coordinate_error(F.col("lat"), F.col("lng")).alias("point_error"),
        filters.bounds_error(F.lit(139.5), F.lit(35.5), F.col("east"), F.col("north")).alias("bounds_error"),
    )


@query(
    "numeric_rules",
    f"""WITH v AS (SELECT o_orderkey, (o_orderkey % 401 - 200) / 8e0 AS x, CAST(o_orderkey % 360 AS DOUBLE) AS a,
                          CAST((o_orderkey * 7) % 360 AS DOUBLE) AS b, (o_orderkey % 11) / 11e0 AS p,
                          (o_custkey % 7) / 7e0 AS q FROM orders)
SELECT o_orderkey, least(10e0, greatest(-5e0, x)) AS clamped, CAST(floor(x + 0.5e0) AS BIGINT) AS rounded_up,
       floor(x * 10e0 + 0.5e0) / 10e0 AS rounded_up_1, {six("1e0 - (1e0 - p) * (1e0 - q) * 0.5e0")} AS union_prob,
       least(abs(a - b) % 180e0, 180e0 - abs(a - b) % 180e0) AS axis_angle,
       CASE WHEN x - floor(x) = 0.5e0 THEN 2e0 * floor(x / 2e0 + 0.5e0) ELSE floor(x + 0.5e0) END AS rounded_even
FROM v""",
)
def numeric_rules(spark, sf_dir):
    v = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "(o_orderkey % 401 - 200) / 8e0 AS x", "CAST(o_orderkey % 360 AS DOUBLE) AS a",
        "CAST((o_orderkey * 7) % 360 AS DOUBLE) AS b", "(o_orderkey % 11) / 11e0 AS p", "(o_custkey % 7) / 7e0 AS q",
    )
    x = F.col("x")
    return v.select(
        "o_orderkey",
        numeric.clamp(x, -5.0, 10.0).alias("clamped"),
        numeric.half_up(x).alias("rounded_up"),
        numeric.half_up(x, 1).alias("rounded_up_1"),
        numeric.half_up(numeric.union_prob(F.array("p", "q", F.lit(0.5))), 6).alias("union_prob"),
        numeric.axis_angle(F.col("a"), F.col("b")).alias("axis_angle"),
        numeric.half_even(x).alias("rounded_even"),
    )


@query(
    "array_statistics",
    f"""WITH g AS (SELECT l_orderkey, median(l_quantity) AS med, avg(l_quantity) AS mean FROM lineitem GROUP BY 1)
SELECT l_orderkey, {six("any_value(mean)")} AS mean, any_value(med) AS median, median(abs(l_quantity - med)) AS mad
FROM lineitem JOIN g USING (l_orderkey) GROUP BY l_orderkey""",
)
def array_statistics(spark, sf_dir):
    """Mean, median and deviation of the few line quantities of each order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return lines.select(
        "l_orderkey",
        numeric.half_up(numeric.array_mean(F.col("q")), 6).alias("mean"),
        numeric.array_median(F.col("q")).alias("median"),
        numeric.array_mad(F.col("q")).alias("mad"),
    )


def _ladder(value: str, rungs, lowest, op: str = ">=") -> str:
    whens = " ".join(f"WHEN {value} {op} {bound} THEN '{label}'" for bound, label in rungs)
    return f"CASE {whens} ELSE '{lowest}' END"


def _scores(value: str, rungs, last, op: str) -> str:
    whens = " ".join(f"WHEN {value} {op} {float(bound)}e0 THEN {score}" for bound, score in rungs)
    return f"CAST(CASE {whens} ELSE {last} END AS INTEGER)"


@query(
    "label_ladders",
    f"""WITH v AS (SELECT o_orderkey, CAST(o_orderkey % 101 AS INTEGER) AS s, (o_orderkey % 500) / 10e0 AS d,
                  (o_orderkey % 250) / 100e0 AS arv, (o_orderkey % 41 - 20) / 100e0 AS pct,
                  (o_orderkey % 97) / 96e0 AS h, (o_orderkey % 89) / 88e0 AS l, (o_orderkey % 83) / 82e0 AS o FROM orders)
SELECT o_orderkey, {_ladder("s", labels.RISK_LADDER, labels.RISK_LOWEST)} AS risk_label,
       {_ladder("s", labels.COMBINED_LADDER, labels.COMBINED_LOWEST)} AS combined_label,
       {_scores("d", labels.SLOPE_LADDER, 0, ">=")} AS slope_score,
       {_scores("arv", labels.AMPLIFICATION_LADDER, labels.AMPLIFICATION_HIGHEST, "<")} AS arv_score,
       CASE WHEN pct <= -0.15e0 THEN '内部サンプル中央値よりかなり低い' WHEN pct <= -0.05e0 THEN '内部サンプル中央値よりやや低い'
            WHEN pct < 0.05e0 THEN '内部サンプル中央値付近' WHEN pct < 0.15e0 THEN '内部サンプル中央値よりやや高い'
            ELSE '内部サンプル中央値よりかなり高い' END AS comparison,
       CASE WHEN h >= 0.42e0 AND h - l >= 0.12e0 AND h >= o - 0.03e0 THEN 1
            WHEN l >= 0.42e0 AND h - l <= -0.12e0 AND l >= o - 0.03e0 THEN 2
            WHEN o >= 0.38e0 AND o >= greatest(h, l) - 0.05e0 THEN 3
            WHEN h >= 0.32e0 AND l >= 0.32e0 AND abs(h - l) < 0.12e0 THEN 4
            WHEN greatest(h, l, o) >= 0.25e0 THEN 5 ELSE 0 END AS live_code,
       CASE WHEN greatest(h, l, o) < 0.11e0 THEN 0
            WHEN h >= 0.19e0 AND h >= l + 0.045e0 AND h >= o - 0.015e0 THEN 1
            WHEN l >= 0.19e0 AND l >= h + 0.045e0 AND l >= o - 0.015e0 THEN 2
            WHEN o >= 0.18e0 AND o >= greatest(h, l) - 0.025e0 THEN 3
            WHEN h >= 0.15e0 AND l >= 0.15e0 AND abs(h - l) < 0.055e0 THEN 4 ELSE 5 END AS grid_code
FROM v""",
)
def label_ladders(spark, sf_dir):
    v = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "CAST(o_orderkey % 101 AS INT) AS s", "(o_orderkey % 500) / 10e0 AS d",
        "(o_orderkey % 250) / 100e0 AS arv", "(o_orderkey % 41 - 20) / 100e0 AS pct",
        "(o_orderkey % 97) / 96e0 AS h", "(o_orderkey % 89) / 88e0 AS l", "(o_orderkey % 83) / 82e0 AS o",
    )
    h, low, o = F.col("h"), F.col("l"), F.col("o")
    return v.select(
        "o_orderkey",
        labels.risk_label(F.col("s")).alias("risk_label"),
        labels.combined_label(F.col("s")).alias("combined_label"),
        labels.slope_score(F.col("d")).alias("slope_score"),
        labels.amplification_score(F.col("arv")).alias("arv_score"),
        labels.comparison_label(F.col("pct")).alias("comparison"),
        labels.live_label_code(h, low, o).alias("live_code"),
        labels.grid_label_code(h, low, o).alias("grid_code"),
    )


DIGITS = text.KANJI_DIGITS
KANJI_SQL = (
    "CASE WHEN {n} < 10 THEN substr('" + DIGITS + "', {n} + 1, 1) WHEN {n} >= 100 THEN CAST({n} AS VARCHAR) "
    "ELSE concat(CASE WHEN {n} // 10 > 1 THEN substr('" + DIGITS + "', {n} // 10 + 1, 1) ELSE '' END, '十', "
    "CASE WHEN {n} % 10 > 0 THEN substr('" + DIGITS + "', {n} % 10 + 1, 1) ELSE '' END) END"
)


@query(
    "kanji_number",
    f"""SELECT o_orderkey, {KANJI_SQL.format(n="n")} AS kanji
FROM (SELECT o_orderkey, CAST(o_orderkey % 130 AS INTEGER) AS n FROM orders)""",
)
def kanji_number(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CAST(o_orderkey % 130 AS INT) AS n")
    return rows.select("o_orderkey", text.kanji_number(F.col("n")).alias("kanji"))


def town_sql(raw: str) -> str:
    """DuckDB text of the town key for names with at most one numeral of one or two digits before 丁目."""
    plain = f"translate(translate({raw}, '０１２３４５６７８９', '0123456789'), ' 　', '')"
    bare = f"regexp_replace(regexp_replace({plain}, '^東京都', ''), '^.+?[区市](.)', '\\1')"
    digits = f"regexp_extract({bare}, '([0-9]+)丁目', 1)"
    number = f"TRY_CAST({digits} AS INTEGER)"
    kanji = KANJI_SQL.format(n=number)
    return f"CASE WHEN {digits} <> '' THEN regexp_replace({bare}, '[0-9]+丁目', concat({kanji}, '丁目')) ELSE {bare} END"


WIDE_TOWN = (
    "CASE WHEN listing_id % 4 = 0 THEN translate(concat(' ', town), '0123456789', '０１２３４５６７８９') ELSE town END"
)


@query("town_normalize", f"SELECT listing_id, {town_sql('raw')} AS town_key FROM (SELECT listing_id, {WIDE_TOWN} AS raw FROM {LISTINGS.sql})")
def town_normalize(spark, sf_dir):
    rows = LISTINGS.frame(spark, sf_dir).selectExpr("listing_id", f"{WIDE_TOWN} AS raw")
    return rows.select("listing_id", text.normalize_town(F.col("raw")).alias("town_key"))


#: Texts that need complete compatibility normalisation, or are edge cases, and their keys.
SPECIAL_TOWNS = (
    ("ｶﾅｶﾞﾜ市ﾕﾒ町", "ユメ町"),
    ("目黒区東が丘①丁目", "東が丘一丁目"),
    ("東京都", ""),
    ("ＡＢＣ１２丁目", "ABC十二丁目"),
    ("㈱北沢", "(株)北沢"),
    ("  　 ", ""),
    ("", ""),
)
SPECIAL_VALUES = ", ".join(f"({i}, '{raw}', '{key}')" for i, (raw, key) in enumerate(SPECIAL_TOWNS))


@query(
    "town_normalize_nfkc",
    f"""SELECT listing_id, coalesce(t.key, '') AS town_key FROM {LISTINGS.sql}
LEFT JOIN (VALUES {SPECIAL_VALUES}) t(i, raw, key) ON listing_id % 8 = t.i""",
)
def town_normalize_nfkc(spark, sf_dir):
    """Half-width kana, circled digits and the like, the bare prefecture, blank and NULL texts."""
    raw = F.get(F.array(*[F.lit(raw) for raw, _ in SPECIAL_TOWNS]), (F.col("listing_id") % 8).cast("int"))
    rows = LISTINGS.frame(spark, sf_dir).select("listing_id", raw.alias("raw"))
    return rows.select("listing_id", text.normalize_town(F.col("raw")).alias("town_key"))


RAW_FIELDS = """CASE WHEN c_custkey % 5 = 0 THEN '  ' WHEN c_custkey % 5 = 1 THEN concat(' ', c_name, ' ') ELSE concat(c_name, c_mktsegment, c_name) END AS name,
       CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 6 = 1 THEN 'n/a' WHEN c_custkey % 6 = 2 THEN ' 12.5 ' ELSE CAST(c_custkey AS STRING) END AS amount,
       CASE c_nationkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'stale' WHEN 2 THEN 'CONFIRMED' END AS currentness,
       CASE c_nationkey % 5 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'yes' WHEN 2 THEN '1' WHEN 3 THEN 'no' END AS flag"""


@query(
    "clean_fields",
    f"""WITH r AS (SELECT c_custkey, {RAW_FIELDS.replace("STRING", "VARCHAR")} FROM customer)
SELECT c_custkey, CASE WHEN length(trim(name)) <= 40 THEN nullif(trim(name), '') END AS name,
       CASE WHEN length(trim(name)) > 40 THEN 'text_too_long' END AS name_error,
       TRY_CAST(trim(amount) AS DOUBLE) AS amount,
       CASE WHEN trim(amount) <> '' AND TRY_CAST(trim(amount) AS DOUBLE) IS NULL THEN 'not_a_number' END AS amount_error,
       CASE WHEN currentness IN ('confirmed', 'stale') THEN currentness ELSE 'unknown' END AS currentness,
       coalesce(lower(trim(flag)) IN ('true', 'yes', '1'), false) AS flag FROM r""",
)
def clean_fields(spark, sf_dir):
    r = table(spark, sf_dir, "customer").selectExpr("c_custkey", *[e.strip() for e in RAW_FIELDS.split(",\n")])
    name, name_error = text.clean_text(F.col("name"), 40)
    amount, amount_error = text.parse_optional_number(F.col("amount"))
    return r.select(
        "c_custkey", name.alias("name"), name_error.alias("name_error"), amount.alias("amount"),
        amount_error.alias("amount_error"),
        text.normalize_enum(F.col("currentness"), ("confirmed", "stale")).alias("currentness"),
        text.bool_like(F.col("flag")).alias("flag"),
    )


AREAS = """SELECT s_suppkey AS area_id, CASE s_suppkey % 3 WHEN 0 THEN 'P0' WHEN 1 THEN 'P1' ELSE 'P2' END AS priority,
       CASE s_suppkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE 'D' END AS readiness,
       n_name AS ward, s_name AS town, concat('Unknown ', CAST(s_suppkey % 10 AS STRING)) AS primary_unknown,
       'Close the POINT' AS next_action, CAST(s_suppkey % 45 AS INT) AS known_rent_units,
       CAST(s_suppkey % 21 AS INT) AS distinct_buildings,
       CASE WHEN s_suppkey % 5 = 0 THEN 'REFERENCE' ELSE 'THIN' END AS market_readiness"""


def areas(spark, sf_dir):
    rows = spark.sql(
        AREAS + " FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey",
        supplier=table(spark, sf_dir, "supplier"),
        nation=table(spark, sf_dir, "nation"),
    )
    return rows.withColumn("signals", F.array(F.concat(F.lit("signal "), F.col("readiness")), F.lit("cell fixed")))


AREAS_SQL = "(" + AREAS.replace("STRING", "VARCHAR") + " FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(
    "area_filter",
    f"""SELECT area_id, priority, readiness FROM {AREAS_SQL} WHERE priority = 'P1'
AND contains(lower(concat(ward, town, primary_unknown, next_action, concat('signal ', readiness, ' cell fixed'))), 'signal a')""",
)
def area_filter(spark, sf_dir):
    found = filters.area_filter(areas(spark, sf_dir), priority="P1", needle=" Signal A ")
    return found.select("area_id", "priority", "readiness")

