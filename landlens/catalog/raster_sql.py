"""DuckDB text of the raster operators, written as plain joins over dense grids."""

from __future__ import annotations

from landlens.catalog.base import six
from landlens.operators.raster import kernel



def _number(x: float) -> str:
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def gauss(name: str, source: str, sigma: float, value: str = "value", rows: str = 'max("row") + 1', cols: str = "max(col) + 1") -> str:
    """CTEs ending in ``name`` (row, col, v, w): smoothed known values and smoothed known share."""
    taps = kernel(sigma)
    radius = len(taps) // 2
    values = ", ".join(f"({i - radius}, {_number(w)})" for i, w in enumerate(taps))
    return f"""{name}_k(k, f) AS (VALUES {values}),
{name}_s AS (SELECT {rows} - 1 AS mr, {cols} - 1 AS mc FROM {source}),
{name}_r AS (SELECT unnest(range(0, mr + 1)) AS "row" FROM {name}_s),
{name}_c AS (SELECT unnest(range(0, mc + 1)) AS col FROM {name}_s),
{name}_x AS (SELECT c.col, least(mc, greatest(0, c.col + k)) AS src, f FROM {name}_c c, {name}_k, {name}_s),
{name}_y AS (SELECT r."row", least(mr, greatest(0, r."row" + k)) AS src, f FROM {name}_r r, {name}_k, {name}_s),
{name}_h AS (SELECT g."row", x.col, sum(f * coalesce({value}, 0e0)) AS v, sum(CASE WHEN {value} IS NULL THEN 0e0 ELSE f END) AS w
  FROM {source} g JOIN {name}_x x ON g.col = x.src GROUP BY ALL),
{name} AS (SELECT y."row", h.col, sum(f * v) AS v, sum(f * w) AS w FROM {name}_h h JOIN {name}_y y ON h."row" = y.src GROUP BY ALL)"""


def smooth(name: str, min_weight: float) -> str:
    """Expression of the normalised value over a ``gauss`` CTE."""
    return f"CASE WHEN {name}.w > {_number(min_weight)} THEN {name}.v / {name}.w END"


def bilinear(samples: str, surface: str, keys: str, value: str = "value") -> str:
    """Subquery (keys, value) of a surface CTE sampled at fractional ``r, c``."""
    return f"""(SELECT {keys}, CASE WHEN count({value}) = 4 THEN sum(w * {value}) END AS {value} FROM (
  SELECT {keys}, g.{value}, (CASE WHEN dr = 1 THEN r - floor(r) ELSE 1e0 - (r - floor(r)) END)
     * (CASE WHEN dc = 1 THEN c - floor(c) ELSE 1e0 - (c - floor(c)) END) AS w
  FROM {samples} p CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc)
  LEFT JOIN {surface} g ON g."row" = CAST(floor(r) AS BIGINT) + dr AND g.col = CAST(floor(c) AS BIGINT) + dc) GROUP BY ALL)"""


def position(lat: str, lng: str, zoom: int, origin: tuple[int, int]) -> tuple[str, str]:
    """Fractional (row, col) of a place in a mosaic."""
    import math

    size = float(2**zoom * 256)
    r = f"(1e0 - asinh(tan(radians({lat}))) / {math.pi!r}) / 2e0 * {size!r}e0 - {origin[0]}"
    c = f"({lng} + 180e0) / 360e0 * {size!r}e0 - {origin[1]}"
    return r, c


def slope(name: str, source: str, mpp: float) -> str:
    """CTE ``name`` (row, col, value): slope in degrees of a surface CTE (row, col, value)."""
    m = _number(mpp)
    return f"""{name}_s AS (SELECT max("row") AS mr, max(col) AS mc FROM {source}),
{name} AS (SELECT "row", col, degrees(atan(sqrt(gx * gx + gy * gy))) AS value FROM (
  SELECT z."row", z.col,
    CASE WHEN z."row" = 0 THEN (d.value - z.value) / {m} WHEN z."row" = mr THEN (z.value - u.value) / {m} ELSE (d.value - u.value) / (2e0 * {m}) END AS gy,
    CASE WHEN z.col = 0 THEN (e.value - z.value) / {m} WHEN z.col = mc THEN (z.value - w.value) / {m} ELSE (e.value - w.value) / (2e0 * {m}) END AS gx
  FROM {name}_s, {name}_grid z LEFT JOIN {source} u ON u."row" = z."row" - 1 AND u.col = z.col
  LEFT JOIN {source} d ON d."row" = z."row" + 1 AND d.col = z.col LEFT JOIN {source} w ON w."row" = z."row" AND w.col = z.col - 1
  LEFT JOIN {source} e ON e."row" = z."row" AND e.col = z.col + 1) WHERE gx IS NOT NULL AND gy IS NOT NULL)"""


def rounded(*columns: str) -> str:
    return ", ".join(f"{six(c)} AS {c}" for c in columns)
