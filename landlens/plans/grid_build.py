"""Batch grid build: lattice, scores, neighbourhood, hotspots, nearby best and the written dataset."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landlens.functions.geo import METERS_PER_DEGREE, meters_per_pixel, offset_coordinates
from landlens.functions.labels import terrain_label
from landlens.functions.numeric import half_even
from landlens.operators import grid_terrain as gt
from landlens.operators.filters import circle_mask, corridor_mask
from landlens.operators.raster import mosaic_origin
from landlens.operators.spatial import nearby_best, nearest_station
from landlens.plans.diagnose import Precomputed
from landlens.session import cut_lineage
from landlens.sources.grids import grid_cells, grid_hotspots, grid_regions, read_cells, write_cells

#: Raster margin around a region, in metres.
MARGIN_M = 4_800.0

#: Engine description stored with every written dataset.
ENGINE = {
    "name": "directional-line-crossing-v2",
    "original_weight": "0.80",
    "auxiliary_weight": "0.20",
    "scales_m": "300,1000,3000",
    "thresholds_m": "0.499,1.2,2.8",
    "neighborhood_m": "500",
    "nearby_best_m": "1000",
}


class Region(NamedTuple):
    """A circle (``radius_m``) or a corridor along stations (``buffer_m``)."""

    region_id: str
    name: str
    centre: tuple[float, float]
    extent_m: float = 4_500.0
    radius_m: float | None = 4_500.0
    buffer_m: float | None = None
    stations: tuple[tuple[str, float, float], ...] = ()


def route_metres(region: Region) -> list[tuple[float, float]]:
    """Stations as (east, north) metres from the centre."""
    scale = METERS_PER_DEGREE * math.cos(math.radians(region.centre[0]))
    return [
        ((lng - region.centre[1]) * scale, (lat - region.centre[0]) * METERS_PER_DEGREE)
        for _, lat, lng in region.stations
    ]


def lattice_side(region: Region) -> int:
    """Rows, and columns, of the whole lattice before masking."""
    return int(region.extent_m * 2 / gt.STEP_M) + 1


def region_lattice(spark, region: Region) -> DataFrame:
    """Masked lattice positions of one region (region_id, grid_row, grid_col, east, north, site_id)."""
    header = spark.range(1).select(F.lit(region.region_id).alias("region_id"), F.lit(region.extent_m).alias("extent_m"))
    lattice = gt.make_grid(header)
    east, north = F.col("east"), F.col("north")
    if region.buffer_m is not None:
        lattice = lattice.filter(corridor_mask(east, north, route_metres(region), region.buffer_m))
    elif region.radius_m is not None:
        lattice = lattice.filter(circle_mask(east, north, region.radius_m))
    site = F.col("grid_row").cast("bigint") * lattice_side(region) + F.col("grid_col")
    return lattice.drop("extent_m").withColumn("site_id", site)


def build_cells(
    lattice: DataFrame,
    dem: DataFrame,
    *,
    centre: tuple[float, float],
    zoom: int,
    origin: tuple[int, int],
    mpp: float,
    rows: int | Column,
    cols: int | Column,
    grid_rows: int | Column,
    grid_cols: int | Column,
) -> tuple[DataFrame, DataFrame]:
    """(cells, hotspots) of a lattice (region_id, grid_row, grid_col, east, north, site_id) over one raster.

    ``rows`` and ``cols`` are the extent of the raster, ``grid_rows`` and ``grid_cols`` that of the lattice. All regions of
    the lattice share the raster and the local metres around ``centre``; a site is known by its region and site_id.
    The scored lattice is read by four later steps, so it is written out once.
    """
    site = F.concat_ws(":", "region_id", "site_id")
    scores = gt.score_sites(
        dem, lattice.select(site.alias("site_id"), "east", "north"), centre=centre, zoom=zoom, origin=origin, mpp=mpp, rows=rows, cols=cols
    ).withColumnRenamed("site_id", "_site")
    scored = cut_lineage(lattice.withColumn("_site", site).join(scores, "_site").drop("_site"))
    best = gt.suppress(gt.local_maxima(scored))
    at = offset_coordinates(F.col("east"), F.col("north"), centre)
    place = ["region_id", "grid_row", "grid_col"]
    hotspots = best.join(
        scored.select(*place, "east", "north", "original_score", "confidence"), place
    ).select(
        "region_id",
        "hotspot_index",
        half_even(at.lat, 6).alias("lat"),
        half_even(at.lng, 6).alias("lng"),
        "east",
        "north",
        "detail_score",
        "original_score",
        "confidence",
    )
    around = gt.neighborhood_score(scored, rows=grid_rows, cols=grid_cols)
    cells = nearby_best(around, hotspots.select("region_id", "hotspot_index", "detail_score", "east", "north"), key=("region_id", "site_id"))
    return (
        cells.withColumn("label", terrain_label(F.col("label_code")))
        .withColumn("lat", half_even(at.lat, 6))
        .withColumn("lng", half_even(at.lng, 6))
        .withColumnRenamed("high", "high_evidence")
        .withColumnRenamed("low", "low_evidence")
        .withColumnRenamed("ordinary", "ordinary_evidence"),
        hotspots,
    )


def build_grid(spark, dem_pixels: DataFrame, region: Region, zoom: int = 14) -> tuple[DataFrame, DataFrame]:
    """(cells with bounds, hotspots) of one region. ``dem_pixels``: gy, gx, elevation at ``zoom``.

    Only the pixels of the region and its margin are read; the filter reaches the scan.
    """
    lat, lng = region.centre
    reach = region.extent_m + MARGIN_M
    dlat = reach / METERS_PER_DEGREE
    dlng = reach / (METERS_PER_DEGREE * math.cos(math.radians(lat)))
    row0, col0 = mosaic_origin(lat + dlat, lng - dlng, zoom)
    row1, col1 = mosaic_origin(lat - dlat, lng + dlng, zoom)
    dem = dem_pixels.filter(
        F.col("gy").between(row0, row1 + 255) & F.col("gx").between(col0, col1 + 255)
    ).select((F.col("gy") - row0).alias("row"), (F.col("gx") - col0).alias("col"), F.col("elevation").alias("value"))
    side = lattice_side(region)
    cells, hotspots = build_cells(
        region_lattice(spark, region), dem, centre=region.centre, zoom=zoom, origin=(row0, col0),
        mpp=meters_per_pixel(lat, zoom), rows=row1 + 256 - row0, cols=col1 + 256 - col0, grid_rows=side, grid_cols=side,
    )
    if region.stations:
        hotspots = nearest_station(hotspots, list(region.stations))
    return gt.cell_bounds(cells, region.centre), hotspots


def region_header(regions: DataFrame, cells: DataFrame, step_m: float = gt.STEP_M) -> DataFrame:
    """Headers of regions (region_id, region_order, region_name): the step and the box of their cells, half a step around."""
    half = F.lit(step_m / 2.0 / METERS_PER_DEGREE)
    narrow = half / F.cos(F.radians(F.greatest(F.abs("_s"), F.abs("_n"))))
    box = cells.groupBy("region_id").agg(
        F.min("lat").alias("_s"), F.min("lng").alias("_w"), F.max("lat").alias("_n"), F.max("lng").alias("_e"), F.count(F.lit(1)).alias("cell_count")
    )
    return regions.join(box, "region_id").select(
        *regions.columns, F.lit(float(step_m)).alias("step_m"), (F.col("_s") - half).alias("south"), (F.col("_w") - narrow).alias("west"),
        (F.col("_n") + half).alias("north"), (F.col("_e") + narrow).alias("east"), "cell_count",
    )


def save_grid(cells: DataFrame, hotspots: DataFrame, regions: DataFrame, path: str) -> None:
    """Write cells as a dataset partitioned by region, hotspots and region headers as small tables, with the engine's description.

    ``cells`` need a cell_index (or site_id, which becomes it); ``regions`` (region_id, region_order, region_name) are completed
    by :func:`region_header`.
    """
    if "cell_index" not in cells.columns:
        cells = cells.withColumnRenamed("site_id", "cell_index")
    write_cells(cells.drop("east", "north"), f"{path}/cells", engine=ENGINE)
    engine = {f"engine_{name}": F.lit(value) for name, value in ENGINE.items()}
    for name, table in (("hotspots", hotspots), ("regions", region_header(regions, cells))):
        table.withColumns(engine).write.mode("overwrite").parquet(f"{path}/{name}")


def load_grid(spark: SparkSession, path: str) -> Precomputed:
    """The tables of :func:`save_grid` as a diagnosis reads them."""
    cells, hotspots, regions = (read_cells(spark, f"{path}/{name}") for name in ("cells", "hotspots", "regions"))
    plain = lambda frame: frame.select(*[c for c in frame.columns if not c.startswith("engine_")])
    widest = regions.agg(F.max("step_m")).first()[0]
    return Precomputed(plain(cells), plain(hotspots), plain(regions), max_step_m=widest or gt.STEP_M)


def precomputed_of(docs: DataFrame) -> Precomputed:
    """Grid documents (:func:`landlens.sources.grids.read_grids`) as a diagnosis reads them."""
    regions = grid_regions(docs)
    widest = regions.agg(F.max("step_m")).first()[0]
    return Precomputed(grid_cells(docs), grid_hotspots(docs), regions, max_step_m=widest or gt.STEP_M)
