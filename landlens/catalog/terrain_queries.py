"""Per-point terrain analysis and grid scoring, end to end over the derived elevation lattice."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from landlens.catalog import raster_sql as rq
from landlens.catalog.base import query, six, up
from landlens.catalog.inputs import DEM_PIXELS, LAT0, LIVE_POINTS, LNG0, ORIGIN, ZOOM
from landlens.catalog.raster_queries import DEM_SQL, dem, extent, rounded
from landlens.operators import grid_terrain, live_terrain, raster

PLACE = "lat, lng"
RING = ", ".join(
    ["(0, 0e0, 'c')"]
    + [f"({1 + i}, {a}e0, 'i')" for i, a in enumerate(live_terrain.RING)]
    + [f"({9 + i}, {a}e0, 'o')" for i, a in enumerate(live_terrain.RING)]
)
SCALES = ", ".join(f"({m}, {t}e0, {w}e0)" for m, t, w in live_terrain.SCALES)
PIXELS = f"{float(2**ZOOM * 256)!r}e0"


def moved(lat: str, lng: str, distance: str, bearing: str) -> tuple[str, str]:
    return (
        f"{lat} + cos(radians({bearing})) * {distance} / 111320e0",
        f"{lng} + sin(radians({bearing})) * {distance} / (111320e0 * greatest(0.2e0, cos(radians({lat}))))",
    )


def terrain_sql(name: str, source: str, keys: str) -> str:
    """CTEs ending in ``name`` (keys, tpi, mad, relief, coverage) for positions (keys, at_lat, at_lng)."""
    lat, lng = moved("at_lat", "at_lng", "dist", "bearing")
    return f"""{name}_p AS (SELECT p.*, slot, bearing, CASE kind WHEN 'c' THEN 0e0 WHEN 'i' THEN greatest(35e0, scale / 6e0) ELSE scale / 2e0 END AS dist
  FROM {source} p, ring),
{name}_s AS (SELECT {keys}, slot, {lat} AS s_lat, {lng} AS s_lng FROM {name}_p),
{name}_g AS (SELECT {keys}, slot, CAST(floor((1e0 - asinh(tan(radians(s_lat))) / {math.pi!r}) / 2e0 * {PIXELS}) AS INTEGER) AS gy,
  CAST(floor((s_lng + 180e0) / 360e0 * {PIXELS}) AS INTEGER) AS gx FROM {name}_s),
{name}_a AS (SELECT {keys}, max(CASE WHEN slot = 0 THEN elevation END) AS c, avg(elevation) FILTER (slot BETWEEN 1 AND 8) AS i,
  count(elevation) FILTER (slot BETWEEN 1 AND 8) AS ni, avg(elevation) FILTER (slot >= 9) AS o, count(elevation) FILTER (slot >= 9) AS no,
  count(elevation) AS n, max(elevation) - min(elevation) AS span, mad(elevation) FILTER (slot >= 9) AS m
  FROM {name}_g LEFT JOIN dem USING (gy, gx) GROUP BY {keys}),
{name} AS (SELECT {keys}, CASE WHEN ok THEN (c + i) / 2e0 - o END AS tpi, CASE WHEN ok THEN m ELSE 0e0 END AS mad,
  CASE WHEN ok THEN span ELSE 0e0 END AS relief, n / 17e0 AS coverage FROM (SELECT *, c IS NOT NULL AND ni >= 5 AND no >= 5 AS ok FROM {name}_a))"""


BASE = f"""WITH RECURSIVE dem AS {DEM_PIXELS.sql}, ring(slot, bearing, kind) AS (VALUES {RING}), scales(scale, threshold, weight) AS (VALUES {SCALES}),
places AS (SELECT DISTINCT lat, lng FROM {LIVE_POINTS.sql}),
centres AS (SELECT lat, lng, scale, lat AS at_lat, lng AS at_lng FROM places, scales),
{terrain_sql("centre", "centres", "lat, lng, scale")}"""

AXES = ", ".join(f"({i}, {a}e0)" for i, a in enumerate(live_terrain.AXES))
OFFSETS = ", ".join(f"({o}e0)" for o in live_terrain.OFFSETS)
ANCHOR_LAT, ANCHOR_LNG = moved("lat", "lng", "(abs(off) * scale)", "(CASE WHEN off < 0 THEN angle + 180e0 ELSE angle END)")

LINES = f"""{BASE},
axes(axis, angle) AS (VALUES {AXES}), offsets(off) AS (VALUES {OFFSETS}),
good AS (SELECT lat, lng, scale FROM centre WHERE tpi IS NOT NULL AND relief >= 3 AND coverage >= 0.7e0),
anchors AS (SELECT lat, lng, scale, axis, off, {ANCHOR_LAT} AS at_lat, {ANCHOR_LNG} AS at_lng FROM good, axes, offsets),
{terrain_sql("anchor", "anchors", "lat, lng, scale, axis, off")},
judged AS (SELECT a.*, kind, greatest(s.threshold * 0.35e0, 0.15e0 * greatest(0.5e0, mad)) AS t FROM anchor a JOIN scales s USING (scale), (VALUES ('high'), ('low')) k(kind)),
chosen AS (SELECT *, least(1e0, abs(tpi) / (t * 2e0)) AS prom FROM judged WHERE tpi IS NOT NULL AND relief >= 3 AND coverage >= 0.65e0
  AND CASE kind WHEN 'high' THEN tpi >= t ELSE tpi <= -t END),
lines AS (SELECT lat, lng, scale, axis, kind, least(1e0, 0.25e0 * (count(*) / 4e0) + 0.3e0
    + 0.2e0 * (CASE WHEN bool_or(off = -1.5e0) AND bool_or(off = 1.5e0) THEN 1e0 ELSE 0.75e0 END) + 0.25e0 * avg(prom)) AS quality
  FROM chosen GROUP BY ALL HAVING count(*) >= 3 AND bool_or(off < 0) AND bool_or(off > 0))"""

ANGLE = "least(abs(a.axis - b.axis) * 15e0 % 180e0, 180e0 - abs(a.axis - b.axis) * 15e0 % 180e0)"
PAIR = f"sqrt(a.quality * b.quality) * sin(radians({ANGLE}))"

EVIDENCE = f"""{LINES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY lat, lng, scale, kind ORDER BY quality DESC, axis) AS k FROM lines),
greedy AS (SELECT lat, lng, scale, kind, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS mask FROM ranked WHERE k = 1
  UNION ALL SELECT g.lat, g.lng, g.scale, g.kind, g.k + 1, CASE WHEN g.mask & ((1 << ((r.axis + 1) % 12)) | (1 << ((r.axis + 11) % 12))) = 0
      THEN g.mask | (1 << r.axis) ELSE g.mask END
  FROM greedy g JOIN ranked r ON g.lat = r.lat AND g.lng = r.lng AND g.scale = r.scale AND g.kind = r.kind AND r.k = g.k + 1),
masks AS (SELECT lat, lng, scale, kind, arg_max(mask, k) AS mask FROM greedy GROUP BY ALL),
merged AS (SELECT l.* FROM lines l JOIN masks m USING (lat, lng, scale, kind) WHERE m.mask & (1 << l.axis) <> 0),
pairs AS (SELECT a.lat, a.lng, a.scale, a.kind AS what, {PAIR} AS v FROM merged a JOIN merged b ON a.lat = b.lat AND a.lng = b.lng AND a.scale = b.scale
    AND a.kind = b.kind AND a.axis < b.axis WHERE {ANGLE} >= 25e0
  UNION ALL SELECT a.lat, a.lng, a.scale, 'ordinary', {PAIR} FROM lines a JOIN lines b ON a.lat = b.lat AND a.lng = b.lng AND a.scale = b.scale
    AND a.kind = 'high' AND b.kind = 'low' WHERE {ANGLE} >= 25e0),
top AS (SELECT lat, lng, scale, what, least(1e0, greatest(0e0, 1e0 - product(1e0 - v))) AS e FROM (
  SELECT *, row_number() OVER (PARTITION BY lat, lng, scale, what ORDER BY v DESC) AS k FROM pairs) WHERE k <= 3 GROUP BY ALL),
counts AS (SELECT lat, lng, scale, kind, bit_count(mask) AS n FROM masks),
evidence AS (SELECT c.lat, c.lng, c.scale, c.tpi, c.relief, c.coverage,
    coalesce((SELECT e FROM top t WHERE t.lat = c.lat AND t.lng = c.lng AND t.scale = c.scale AND what = 'high'), 0e0) AS high_cross,
    coalesce((SELECT e FROM top t WHERE t.lat = c.lat AND t.lng = c.lng AND t.scale = c.scale AND what = 'low'), 0e0) AS low_cross,
    coalesce((SELECT e FROM top t WHERE t.lat = c.lat AND t.lng = c.lng AND t.scale = c.scale AND what = 'ordinary'), 0e0) AS ordinary_cross,
    CAST(coalesce((SELECT n FROM counts t WHERE t.lat = c.lat AND t.lng = c.lng AND t.scale = c.scale AND kind = 'high'), 0) AS INTEGER) AS high_lines,
    CAST(coalesce((SELECT n FROM counts t WHERE t.lat = c.lat AND t.lng = c.lng AND t.scale = c.scale AND kind = 'low'), 0) AS INTEGER) AS low_lines
  FROM centre c)"""

UNION_OF = "least(1e0, 1e0 - product(1e0 - 0.72e0 * {c}))"
THEORY = f"""{EVIDENCE},
base AS (SELECT lat, lng, {UNION_OF.format(c="high_cross")} AS h, {UNION_OF.format(c="low_cross")} AS l, {UNION_OF.format(c="ordinary_cross")} AS o,
  avg(coverage) AS cov, avg(relief) AS rel, count(*) FILTER (greatest(high_cross, low_cross, ordinary_cross) >= 0.25e0) / 3e0 AS active,
  sum(CASE WHEN tpi IS NULL THEN 0e0 ELSE s.weight * least(1e0, greatest(-1e0, tpi / greatest(1e0, relief * 0.22e0))) END) AS relative,
  sum(high_lines) AS high_lines, sum(low_lines) AS low_lines FROM evidence JOIN scales s USING (scale) GROUP BY ALL),
scored AS (SELECT *, least(100, greatest(0, {up("50e0 + 50e0 * (h - l) * (1e0 - 0.38e0 * o)")})) AS original_score,
  least(100, greatest(0, {up("0.8e0 * least(100e0, greatest(0e0, 50e0 + 45e0 * relative)) + 0.2e0 * least(96e0, greatest(20e0, 92e0 - greatest(0e0, rel - 45e0)))")})) AS auxiliary_score FROM base),
theory AS (SELECT lat, lng, {up("0.8e0 * original_score + 0.2e0 * auxiliary_score")} AS detail_score, original_score, auxiliary_score,
  CASE WHEN h >= 0.42e0 AND h - l >= 0.12e0 AND h >= o - 0.03e0 THEN 1 WHEN l >= 0.42e0 AND h - l <= -0.12e0 AND l >= o - 0.03e0 THEN 2
       WHEN o >= 0.38e0 AND o >= greatest(h, l) - 0.05e0 THEN 3 WHEN h >= 0.32e0 AND l >= 0.32e0 AND abs(h - l) < 0.12e0 THEN 4
       WHEN greatest(h, l, o) >= 0.25e0 THEN 5 ELSE 0 END AS label_code,
  {up("100e0 * greatest(h, l, o)")} AS original_fit, {up("100e0 * least(1e0, greatest(0e0, 0.35e0 * cov + 0.4e0 * greatest(h, l, o) + 0.25e0 * active))")} AS confidence,
  floor(h * 1e3 + 0.5e0) / 1e3 AS high_evidence, floor(l * 1e3 + 0.5e0) / 1e3 AS low_evidence, floor(o * 1e3 + 0.5e0) / 1e3 AS ordinary_evidence,
  concat('高位×高位 ', {up("h * 100e0")}, '／低位×低位 ', {up("l * 100e0")}, '／高位×低位 ', {up("o * 100e0")},
    '|3縮尺で高位線候補 ', CAST(high_lines AS BIGINT), '本、低位線候補 ', CAST(low_lines AS BIGINT), '本|原典ロジック80%＋補助地形20%で地点詳細点 ',
    {up("0.8e0 * original_score + 0.2e0 * auxiliary_score")}, '|標高データ充足率 ', {up("cov * 100e0")}, '%') AS reasons FROM scored)"""


def dem_pixels(spark, sf_dir):
    return DEM_PIXELS.frame(spark, sf_dir)


@query(
    "ring_samples",
    f"""{BASE} SELECT DISTINCT {six("s_lat")} AS s_lat, {six("s_lng")} AS s_lng FROM centre_s""",
)
def ring_samples(spark, sf_dir):
    """Distinct sample positions of the centre rings at six decimals."""
    places = LIVE_POINTS.frame(spark, sf_dir).select("lat", "lng").distinct()
    positions = places.select(
        "lat", "lng", F.col("lat").alias("at_lat"), F.col("lng").alias("at_lng"),
        F.explode(F.array(*[F.lit(s) for s, _, _ in live_terrain.SCALES])).alias("scale"),
    )
    return live_terrain.dedupe_samples(live_terrain.ring_samples(positions))


@query(
    "local_terrain",
    f"""{BASE} SELECT {six("lat")} AS lat, {six("lng")} AS lng, CAST(scale AS INTEGER) AS scale, {rq.rounded("tpi", "mad", "relief", "coverage")} FROM centre""",
)
def local_terrain(spark, sf_dir):
    places = LIVE_POINTS.frame(spark, sf_dir).select("lat", "lng").distinct()
    out = live_terrain.centre_terrain(places, dem_pixels(spark, sf_dir), ZOOM)
    return rounded(out, "lat", "lng", "tpi", "mad", "relief", "coverage")


def evidence(spark, sf_dir):
    return live_terrain.scale_evidence(LIVE_POINTS.frame(spark, sf_dir), dem_pixels(spark, sf_dir), ZOOM)


@query(
    "scale_evidence",
    f"""{EVIDENCE} SELECT {six("lat")} AS lat, {six("lng")} AS lng, CAST(scale AS INTEGER) AS scale,
  {rq.rounded("high_cross", "low_cross", "ordinary_cross")}, high_lines, low_lines, {six("tpi")} AS centre_tpi FROM evidence""",
)
def scale_evidence(spark, sf_dir):
    out = evidence(spark, sf_dir).drop("relief", "coverage")
    return rounded(out, "lat", "lng", "high_cross", "low_cross", "ordinary_cross", "centre_tpi")


THEORY_COLUMNS = (
    "detail_score", "original_score", "auxiliary_score", "label_code", "original_fit", "confidence", "high_evidence",
    "low_evidence", "ordinary_evidence",
)


@query(
    "theory_score",
    f"""{THEORY} SELECT point_id, {", ".join(THEORY_COLUMNS)}, reasons FROM {LIVE_POINTS.sql} JOIN theory USING (lat, lng)""",
)
def theory_score(spark, sf_dir):
    out = live_terrain.analyze_theory(LIVE_POINTS.frame(spark, sf_dir), dem_pixels(spark, sf_dir), ZOOM)
    return out.select("point_id", *THEORY_COLUMNS, F.array_join("reasons", "|").alias("reasons"))


CENTRE = (LAT0, LNG0)
MPP = 62.0
COS = f"cos(radians({LAT0}e0))"


def _grid_sql() -> str:
    parts = [
        f"d AS {DEM_SQL}",
        f"""sites AS (SELECT point_id AS site_id, (lng - {LNG0}e0) * (111320e0 * {COS}) AS east, (lat - {LAT0}e0) * 111320e0 AS north FROM {LIVE_POINTS.sql})""",
        f"gscales(scale, threshold, weight) AS (VALUES {', '.join(f'({s}, {t}e0, {w}e0)' for s, t, w in grid_terrain.SCALES)})",
        rq.gauss("sm", "d", max(0.8, grid_terrain.SLOPE_SIGMA_M / MPP)),
        'smooth AS (SELECT "row", col, v / w AS value FROM sm WHERE w > 0.35e0)',
        's_grid AS (SELECT d."row", d.col, smooth.value FROM d LEFT JOIN smooth USING ("row", col))',
        rq.slope("s", "smooth", MPP),
    ]
    tpis, covs = [], []
    for scale, _, _ in grid_terrain.SCALES:
        inner, outer = raster.tpi_sigmas(scale, MPP)
        parts += [
            rq.gauss(f"i{scale}", "d", inner),
            rq.gauss(f"o{scale}", "d", outer),
            rq.gauss(f"c{scale}", "d", max(1.0, scale / MPP / 4.0)),
            f"""t{scale} AS (SELECT "row", col, i.v / i.w - o.v / o.w AS value FROM i{scale} i JOIN o{scale} o USING ("row", col) WHERE i.w > 0.35e0 AND o.w > 0.35e0)""",
            f'k{scale} AS (SELECT "row", col, w AS value FROM c{scale})',
        ]
    lat, lng = "{lat}", "{lng}"
    r, c = rq.position(lat, lng, ZOOM, ORIGIN)
    at_lat, at_lng = f"({LAT0}e0 + n / 111320e0)", f"({LNG0}e0 + e / (111320e0 * {COS}))"
    place = f"{r.format(lat=at_lat, lng=at_lng)} AS r, {c.format(lat=at_lat, lng=at_lng)} AS c"
    axes = ", ".join(f"({i}, {a}e0)" for i, a in enumerate(grid_terrain.AXES))
    factors = ", ".join(f"({k}, {f}e0)" for k, f in enumerate(grid_terrain.FACTORS))
    parts.append(f"gaxes(axis, angle) AS (VALUES {axes}), factors(slot, f) AS (VALUES {factors})")
    sampled = []
    for scale, _, _ in grid_terrain.SCALES:
        parts.append(
            f"""p{scale} AS (SELECT site_id, axis, slot, {place} FROM (SELECT site_id, axis, slot, east + f * {scale} * sin(radians(angle)) AS e,
  north + f * {scale} * cos(radians(angle)) AS n FROM sites, gaxes, factors))"""
        )
        sampled.append(f"SELECT site_id, {scale} AS scale, axis, slot, value FROM {rq.bilinear(f'p{scale}', f't{scale}', 'site_id, axis, slot')}")
    parts.append("sampled AS (" + " UNION ALL ".join(sampled) + ")")
    level = lambda sign: f"least(1e0, greatest(0e0, ({sign} value - 0.18e0 * threshold) / (1.55e0 * threshold)))"
    parts.append(f"levels AS (SELECT site_id, scale, axis, slot, CASE WHEN value IS NOT NULL THEN {level('')} END AS h, CASE WHEN value IS NOT NULL THEN {level('-')} END AS l FROM sampled JOIN gscales USING (scale))")
    slot = lambda n, k: f"max(CASE WHEN slot = {k} THEN {n} END)"
    strength = lambda n: (
        f"CASE WHEN count({n}) = 4 THEN least(1e0, sqrt((0.62e0 * {slot(n, 1)} + 0.38e0 * {slot(n, 0)}) * (0.62e0 * {slot(n, 2)} + 0.38e0 * {slot(n, 3)})) * (0.68e0 + 0.32e0 * avg({n}))) END"
    )
    parts.append(f"axisv AS (SELECT site_id, scale, axis, {strength('h')} AS high, {strength('l')} AS low FROM levels GROUP BY ALL)")
    angle = "least(abs(a.axis - b.axis) * 22.5e0 % 180e0, 180e0 - abs(a.axis - b.axis) * 22.5e0 % 180e0)"
    joined = f"FROM axisv a JOIN axisv b ON a.site_id = b.site_id AND a.scale = b.scale WHERE {angle} >= 22e0"
    parts.append(
        f"""gpairs AS (SELECT a.site_id, a.scale, 'high' AS what, sqrt(a.high * b.high) * sin(radians({angle})) AS v {joined} AND a.axis < b.axis
  UNION ALL SELECT a.site_id, a.scale, 'low', sqrt(a.low * b.low) * sin(radians({angle})) {joined} AND a.axis < b.axis
  UNION ALL SELECT a.site_id, a.scale, 'ordinary', sqrt(a.high * b.low) * sin(radians({angle})) {joined}),
gtop AS (SELECT site_id, scale, what, count(*) = count(v) AS known, max(v) AS first, max(CASE WHEN k = 2 THEN v END) AS second FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id, scale, what ORDER BY v DESC) AS k FROM gpairs) GROUP BY ALL),
crossing AS (SELECT site_id, scale, what, CASE WHEN known THEN least(1e0, greatest(0e0, 1e0 - (1e0 - first) * (1e0 - CASE what WHEN 'ordinary' THEN 0.35e0 ELSE 0.45e0 END * second))) ELSE 0e0 END AS v FROM gtop),
wide AS (SELECT site_id, scale, max(CASE WHEN what = 'high' THEN v END) AS high, max(CASE WHEN what = 'low' THEN v END) AS low,
  max(CASE WHEN what = 'ordinary' THEN v END) AS ordinary FROM crossing GROUP BY ALL)"""
    )
    blend = lambda n: f"least(1e0, 0.62e0 * sum(weight * {n}) + 0.38e0 * max({n}))"
    parts.append(f"combined AS (SELECT site_id, {blend('high')} AS high, {blend('low')} AS low, {blend('ordinary')} AS ordinary FROM wide JOIN gscales USING (scale) GROUP BY ALL)")
    parts.append(f"here AS (SELECT site_id, {place} FROM (SELECT site_id, east AS e, north AS n FROM sites))")
    for scale, t, w in grid_terrain.SCALES:
        tpis.append(f"{w}e0 * tanh(coalesce(x{scale}.value, 0e0) / (1.7e0 * {t}e0))")
        covs.append(f"{w}e0 * least(1e0, coalesce(y{scale}.value, 0e0))")
    joins = " ".join(
        f"JOIN {rq.bilinear('here', f't{s}', 'site_id')} x{s} USING (site_id) JOIN {rq.bilinear('here', f'k{s}', 'site_id')} y{s} USING (site_id)"
        for s, _, _ in grid_terrain.SCALES
    )
    winner = lambda h, l, o: f"CASE WHEN {h} >= {l} AND {h} >= {o} THEN 0 WHEN {l} >= {o} THEN 1 ELSE 2 END"  # noqa: E741, E731
    parts.append(
        f"""here_v AS (SELECT site_id, {" + ".join(tpis)} AS ti, {" + ".join(covs)} AS cov, coalesce(z.value, 30e0) AS slope FROM here {joins}
  JOIN {rq.bilinear("here", "s", "site_id")} z USING (site_id)),
agree AS (SELECT site_id, avg(CASE WHEN {winner("w.high", "w.low", "w.ordinary")} = {winner("c.high", "c.low", "c.ordinary")} THEN 1e0 ELSE 0e0 END) AS agreement,
  avg(CASE WHEN greatest(w.high, w.low, w.ordinary) >= 0.12e0 THEN 1e0 ELSE 0e0 END) AS active FROM wide w JOIN combined c USING (site_id) GROUP BY ALL),
raw AS (SELECT *, CAST(round_even(least(100e0, greatest(0e0, 50e0 + 50e0 * (high - low) * (1e0 - 0.38e0 * ordinary))), 0) AS INTEGER) AS original_score,
  CAST(round_even(0.48e0 * least(100e0, greatest(0e0, 50e0 + 45e0 * ti)) + 0.32e0 * least(100e0, greatest(0e0, 50e0 + 40e0 * ti - 18e0 * low))
    + 0.20e0 * least(100e0, greatest(0e0, CASE WHEN slope <= 8e0 THEN 92e0 - 1.2e0 * abs(slope - 4e0) ELSE 92e0 - 4e0 * (slope - 8e0) END)), 0) AS INTEGER) AS auxiliary_score,
  CAST(round_even(100e0 * greatest(high, low, ordinary), 0) AS INTEGER) AS original_fit,
  CAST(round_even(100e0 * least(1e0, 0.38e0 * cov + 0.34e0 * greatest(high, low, ordinary) + 0.18e0 * agreement + 0.10e0 * active), 0) AS INTEGER) AS confidence
  FROM combined JOIN here_v USING (site_id) JOIN agree USING (site_id))"""
    )
    return "WITH " + ",\n".join(parts)


GRID = _grid_sql()
GRID_LABEL = """CASE WHEN greatest(high, low, ordinary) < 0.11e0 THEN 0 WHEN high >= 0.19e0 AND high >= low + 0.045e0 AND high >= ordinary - 0.015e0 THEN 1
    WHEN low >= 0.19e0 AND low >= high + 0.045e0 AND low >= ordinary - 0.015e0 THEN 2 WHEN ordinary >= 0.18e0 AND ordinary >= greatest(high, low) - 0.025e0 THEN 3
    WHEN high >= 0.15e0 AND low >= 0.15e0 AND abs(high - low) < 0.055e0 THEN 4 ELSE 5 END"""


def sites(spark, sf_dir):
    points = LIVE_POINTS.frame(spark, sf_dir).withColumnRenamed("point_id", "site_id")
    return grid_terrain.with_local_offsets(points, CENTRE).select("site_id", "east", "north")


@query(
    "grid_crossings",
    f"""{GRID} SELECT site_id, CAST(scale AS INTEGER) AS scale, {rq.rounded("high", "low", "ordinary")} FROM wide""",
)
def grid_crossings(spark, sf_dir):
    terrain = grid_terrain.site_terrain(
        dem(spark, sf_dir), sites(spark, sf_dir), centre=CENTRE, zoom=ZOOM, origin=ORIGIN, mpp=MPP
    )
    out = grid_terrain.axis_crossings(grid_terrain.line_axes(terrain)).drop("tpi", "cov", "slope")
    return rounded(out, "high", "low", "ordinary")


@query(
    "grid_scores",
    f"""{GRID} SELECT site_id, {rq.rounded("high", "low", "ordinary")}, original_score, original_fit, auxiliary_score,
  CAST(round_even(0.8e0 * original_score + 0.2e0 * auxiliary_score, 0) AS INTEGER) AS detail_score, confidence,
  {GRID_LABEL} AS label_code FROM raw""",
)
def grid_scores(spark, sf_dir):
    pixels = dem(spark, sf_dir)
    out = grid_terrain.score_sites(
        pixels, sites(spark, sf_dir), centre=CENTRE, zoom=ZOOM, origin=ORIGIN, mpp=MPP, **extent(pixels)
    )
    return rounded(out, "high", "low", "ordinary")


