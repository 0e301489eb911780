"""Row filters and request validation. Rejected rows keep an ``error_code``; nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.functions.geo import planar_distance, rough_scope
from landlens.functions.text import bool_like, contains_text

ALL = "ALL"


def cells_in_bounds(cells: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Cells whose centre lies in a viewport; plain comparisons, so they reach the parquet scan."""
    return cells.filter(F.col("lng").between(west, east) & F.col("lat").between(south, north))


def in_circle(points: DataFrame, centre: tuple[float, float], radius_m: float, step_m: float = 100.0) -> DataFrame:
    """Points within radius + one step of a centre."""
    distance = planar_distance(F.col("lat"), F.col("lng"), F.lit(centre[0]), F.lit(centre[1]))
    return points.filter(distance <= radius_m + step_m)


def in_rough_scope(points: DataFrame) -> DataFrame:
    return points.filter(rough_scope(F.col("lat"), F.col("lng")))


def circle_mask(east: Column, north: Column, radius_m: float) -> Column:
    """Grid position inside a circle (with the one square metre of slack of the grid builder)."""
    return east * east + north * north <= F.lit(radius_m * radius_m + 1.0)


def segment_distance(east: Column, north: Column, route: list[tuple[float, float]]) -> Column:
    """Shortest distance to a polyline given as (east, north) vertices, one expression per segment."""
    distances = []
    for (e0, n0), (e1, n1) in zip(route[:-1], route[1:]):
        de, dn = e1 - e0, n1 - n0
        along = ((east - F.lit(e0)) * F.lit(de) + (north - F.lit(n0)) * F.lit(dn)) / F.lit(de * de + dn * dn)
        along = F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))
        distances.append(F.hypot(east - (F.lit(e0) + along * F.lit(de)), north - (F.lit(n0) + along * F.lit(dn))))
    return distances[0] if len(distances) == 1 else F.least(*distances)


def corridor_mask(east: Column, north: Column, route: list[tuple[float, float]], buffer_m: float) -> Column:
    return segment_distance(east, north, route) <= F.lit(buffer_m + 1.0)


def sample_filter(samples: DataFrame, municipality: str = "", stratum: str = "") -> DataFrame:
    """Equality filters; an empty value keeps everything."""
    if municipality.strip():
        samples = samples.filter(F.col("municipality") == municipality.strip())
    if stratum.strip():
        samples = samples.filter(F.col("stratum") == stratum.strip())
    return samples


def area_filter(areas: DataFrame, priority: str = ALL, readiness: str = ALL, needle: str = "") -> DataFrame:
    if priority != ALL:
        areas = areas.filter(F.col("priority") == priority)
    if readiness != ALL:
        areas = areas.filter(F.col("readiness") == readiness)
    if not needle.strip():
        return areas
    text = contains_text(
        needle,
        F.col("ward"),
        F.col("town"),
        F.col("primary_unknown"),
        F.col("next_action"),
        F.array_join("signals", " "),
    )
    return areas.filter(text)


def coordinate_error(lat: Column, lng: Column) -> Column:
    """Error code of a point request, NULL when it is usable."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    good = finite(lat) & finite(lng) & lat.between(-90.0, 90.0) & lng.between(-180.0, 180.0)
    return F.when(~F.coalesce(good, F.lit(False)), F.lit("invalid_coordinate"))


def bounds_error(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Error code of a viewport request: ordered and at most 0.25 by 0.2 degrees."""
    good = (east > west) & (north > south) & (east - west <= 0.25) & (north - south <= 0.2)
    return F.when(~F.coalesce(good, F.lit(False)), F.lit("invalid_bounds"))


def split_errors(df: DataFrame, error: str = "error_code") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected)."""
    return df.filter(F.col(error).isNull()).drop(error), df.filter(F.col(error).isNotNull())


def visible_links(links: DataFrame, audience: str) -> DataFrame:
    """Links that an audience may see: the owner all of them, the public only the eligible ones."""
    if audience == "owner":
        return links
    return links.filter(bool_like(F.col("public_eligible")))


def hidden_counts(links: DataFrame, audience: str) -> DataFrame:
    """Per cell: all links and how many of them are withheld from the audience."""
    hidden = F.lit(0) if audience == "owner" else F.when(bool_like(F.col("public_eligible")), 0).otherwise(1)
    return links.groupBy("cell_id").agg(
        F.count(F.lit(1)).alias("raw_link_count"),
        F.sum(hidden).cast("bigint").alias("hidden_count"),
    )
