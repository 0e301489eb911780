"""Coordinates, web-mercator pixels, the canonical 100 m grid and the supported area."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from landlens.functions.numeric import half_up

# Metres per degree, mercator limit, canonical grid origin and steps.
METERS_PER_DEGREE = 111_320.0
MERCATOR_LIMIT = 85.05112878
EQUATOR_METERS_PER_PIXEL = 156543.03392
GRID_NORTH = 35.8396478620176
GRID_WEST = 139.43
GRID_LAT_STEP = 0.00089831117499
GRID_LNG_STEP = 0.00110424522183
GRID_COLUMNS = 462
GRID_ROWS = 587

# Rough scope boxes (south, north, west, east) and municipality code ranges.
SCOPE_BOXES = (
    (35.51, 35.84, 139.54, 139.94),
    (35.28, 35.61, 139.43, 139.76),
    (35.47, 35.65, 139.43, 139.84),
)
TOKYO, YOKOHAMA, KAWASAKI = "東京23区", "横浜市", "川崎市"
OUT_OF_SCOPE = "対象範囲外"
PROVISIONAL_SCOPE = "対象範囲（境界照合は暫定）"
WARDS = (
    "千代田区", "中央区", "港区", "新宿区", "文京区", "台東区", "墨田区", "江東区", "品川区", "目黒区", "大田区", "世田谷区",
    "渋谷区", "中野区", "杉並区", "豊島区", "北区", "荒川区", "板橋区", "練馬区", "足立区", "葛飾区", "江戸川区",
)


class LatLng(NamedTuple):
    lat: Column
    lng: Column


class TilePixel(NamedTuple):
    x: Column
    y: Column
    px: Column
    py: Column


class Cell(NamedTuple):
    row: Column
    col: Column
    cell_id: Column
    lat: Column
    lng: Column


def _floored_cos(lat: Column) -> Column:
    return F.greatest(F.lit(0.2), F.cos(F.radians(lat)))


def offset_point(lat: Column, lng: Column, east: Column, north: Column) -> LatLng:
    """Move by metres east and north; the longitude scale never drops below cos = 0.2."""
    return LatLng(
        lat + north / F.lit(METERS_PER_DEGREE),
        lng + east / (F.lit(METERS_PER_DEGREE) * _floored_cos(lat)),
    )


def point_at(lat: Column, lng: Column, distance: Column, bearing: Column) -> LatLng:
    """Move a distance along a compass bearing."""
    angle = F.radians(bearing)
    return offset_point(lat, lng, F.sin(angle) * distance, F.cos(angle) * distance)


def _mercator_y(lat: Column) -> Column:
    safe = F.least(F.lit(MERCATOR_LIMIT), F.greatest(F.lit(-MERCATOR_LIMIT), lat))
    return (F.lit(1.0) - F.asinh(F.tan(F.radians(safe))) / F.lit(math.pi)) / F.lit(2.0)


def tile_pixel(lat: Column, lng: Column, zoom: int) -> TilePixel:
    """Web-mercator tile and the pixel inside it."""
    size = float(2**zoom)
    fx = (lng + F.lit(180.0)) / F.lit(360.0) * F.lit(size)
    fy = _mercator_y(lat) * F.lit(size)

    def inner(value: Column) -> Column:
        pixel = F.floor((value - F.floor(value)) * F.lit(256.0))
        return F.least(F.lit(255), F.greatest(F.lit(0), pixel)).cast("int")

    return TilePixel(F.floor(fx).cast("int"), F.floor(fy).cast("int"), inner(fx), inner(fy))


def world_pixel(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional global pixel (x, y)."""
    size = float(2**zoom * 256)
    return (lng + F.lit(180.0)) / F.lit(360.0) * F.lit(size), _mercator_y(lat) * F.lit(size)


def global_pixel(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Whole global pixel (row, col): one compact key for tile and pixel together (tile * 256 + pixel)."""
    x, y = world_pixel(lat, lng, zoom)
    return F.floor(y).cast("int"), F.floor(x).cast("int")


def pixel_positions(lat: np.ndarray, lng: np.ndarray, zoom: int) -> tuple[np.ndarray, np.ndarray]:
    """Fractional global pixels (row, col) of arrays, for work on raster windows."""
    size = float(2**zoom * 256)
    safe = np.clip(lat, -MERCATOR_LIMIT, MERCATOR_LIMIT)
    return (1.0 - np.arcsinh(np.tan(np.radians(safe))) / math.pi) / 2.0 * size, (lng + 180.0) / 360.0 * size


def pixel_reach(lat: Column, lng: Column, metres: float, zoom: int) -> tuple[Column, Column, Column, Column]:
    """First and last row, first and last column of the pixels that moves of so many metres can end in."""
    away = F.lit(metres / METERS_PER_DEGREE)
    narrow = F.greatest(F.lit(0.2), F.least(*[F.cos(F.radians(lat + sign * away)) for sign in (-1, 0, 1)]))
    top, left = global_pixel(lat + away, lng - away / narrow, zoom)
    bottom, right = global_pixel(lat - away, lng + away / narrow, zoom)
    return top - 1, bottom + 1, left - 1, right + 1


def meters_per_pixel(lat: float, zoom: int) -> float:
    return EQUATOR_METERS_PER_PIXEL * math.cos(math.radians(lat)) / 2**zoom


def local_offsets(lat: Column, lng: Column, centre: tuple[float, float]) -> tuple[Column, Column]:
    """Metres (east, north) from a centre, without the cosine floor."""
    scale = METERS_PER_DEGREE * math.cos(math.radians(centre[0]))
    return (lng - F.lit(centre[1])) * F.lit(scale), (lat - F.lit(centre[0])) * F.lit(METERS_PER_DEGREE)


def offset_coordinates(east: Column, north: Column, centre: tuple[float, float]) -> LatLng:
    """Inverse of :func:`local_offsets`."""
    scale = METERS_PER_DEGREE * math.cos(math.radians(centre[0]))
    return LatLng(F.lit(centre[0]) + north / F.lit(METERS_PER_DEGREE), F.lit(centre[1]) + east / F.lit(scale))


def planar_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column, cos_floor: bool = True) -> Column:
    """Equirectangular distance in metres at the mean latitude."""
    mean_lat = (lat1 + lat2) / F.lit(2.0)
    scale = _floored_cos(mean_lat) if cos_floor else F.cos(F.radians(mean_lat))
    north = (lat1 - lat2) * F.lit(METERS_PER_DEGREE)
    east = (lng1 - lng2) * F.lit(METERS_PER_DEGREE) * scale
    return F.hypot(north, east)


def cell_name(row: Column, col: Column) -> Column:
    return F.concat(F.lit("g"), row.cast("string"), F.lit("-"), col.cast("string"))


def canonical_cell(lat: Column, lng: Column) -> Cell:
    """Row, column, id and centre of the ~100 m cell that holds a point."""
    row = half_up((F.lit(GRID_NORTH) - lat) / F.lit(GRID_LAT_STEP)).cast("int")
    col = half_up((lng - F.lit(GRID_WEST)) / F.lit(GRID_LNG_STEP)).cast("int")
    return Cell(
        row,
        col,
        cell_name(row, col),
        F.lit(GRID_NORTH) - row * F.lit(GRID_LAT_STEP),
        F.lit(GRID_WEST) + col * F.lit(GRID_LNG_STEP),
    )


CELL_PATTERN = r"^g([0-9]+)-([0-9]+)$"


def parse_cell_id(cell_id: Column) -> tuple[Column, Column, Column]:
    """(row, col, error): a malformed id gives NULL parts and an error code instead of an exception."""
    good = cell_id.rlike(CELL_PATTERN)
    part = lambda i: F.when(good, F.regexp_extract(cell_id, CELL_PATTERN, i).cast("int"))
    error = F.when(F.coalesce(good, F.lit(False)), F.lit(None).cast("string")).otherwise("malformed_cell_id")
    return part(1), part(2), error


def rough_scope(lat: Column, lng: Column) -> Column:
    """Inside any of the three rough boxes."""
    hit = F.lit(False)
    for south, north, west, east in SCOPE_BOXES:
        hit = hit | (lat.between(south, north) & lng.between(west, east))
    return hit


def scope_from_code(code: Column) -> tuple[Column, Column, Column]:
    """(code5, name, supported) from an administrative code."""
    code5 = F.when(code != "", F.substring(code, 1, 5))
    tokyo = code5.isin([str(c) for c in range(13101, 13124)])
    yokohama = code5.isin([str(c) for c in [14100, *range(14101, 14119)]])
    kawasaki = code5.isin([str(c) for c in [14130, *range(14131, 14138)]])
    name = F.when(tokyo, TOKYO).when(yokohama, YOKOHAMA).when(kawasaki, KAWASAKI).otherwise(OUT_OF_SCOPE)
    return code5, name, F.coalesce(tokyo | yokohama | kawasaki, F.lit(False))


def address_in_scope(label: Column) -> Column:
    """The label names one of the 23 wards (after 東京都), 横浜市 or 川崎市."""
    return label.rlike("東京都(" + "|".join(WARDS) + f")|{YOKOHAMA}|{KAWASAKI}")


def format_coordinate(lat: Column, lng: Column) -> Column:
    return F.format_string("%.6f, %.6f", lat, lng)


def mesh_250m(lat: Column, lng: Column) -> tuple[Column, Column]:
    """(row, col) of the quarter regional mesh: 7.5 by 11.25 arc seconds."""
    return F.floor(lat * F.lit(480.0)).cast("int"), F.floor(lng * F.lit(320.0)).cast("int")
