"""Point to diagnosis: validation, scope, terrain (precomputed or live), hazards and the combined score."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.functions.geo import format_coordinate
from landlens.operators.filters import coordinate_error, split_errors
from landlens.operators.grid_terrain import viewport_grid
from landlens.operators.live_terrain import analyze_theory
from landlens.operators.lookups import municipality_of, theory_from_cell
from landlens.operators.risk import combine_scores, modern_risk
from landlens.operators.spatial import MAX_LATITUDE, nearest_cell
from landlens.session import cut_lineage, lookup_join

THEORY_COLUMNS = (
    "score", "label_code", "original_score", "original_fit", "auxiliary_score", "detail_score", "neighborhood_score",
    "confidence", "high_evidence", "low_evidence", "ordinary_evidence", "source_mode", "reasons",
)


class Precomputed(NamedTuple):
    """Tables of the precomputed grids."""

    cells: DataFrame
    hotspots: DataFrame
    regions: DataFrame
    max_step_m: float = 100.0
    max_lat: float = MAX_LATITUDE


def resolve_theory(points: DataFrame, dem: DataFrame, precomputed: Precomputed | None, zoom: int = 13) -> DataFrame:
    """Theory of each point: from a precomputed cell where one is near, else from live analysis.

    Only the points without a cell reach the live chain, whose rows multiply; the split keeps the others out of it.
    Both halves read the nearest-cell result, so it is written out once.
    """
    if precomputed is None:
        return analyze_theory(points, dem, zoom)
    near = nearest_cell(
        points, precomputed.cells.select("region_id", "cell_index", "lat", "lng"), precomputed.regions,
        max_step_m=precomputed.max_step_m, max_lat=precomputed.max_lat,
    )
    near = cut_lineage(near)
    hits = near.filter(F.col("cell_index").isNotNull())
    misses = near.filter(F.col("cell_index").isNull()).select(*points.columns)
    known = theory_from_cell(hits, precomputed.cells, precomputed.hotspots, precomputed.regions)
    live = analyze_theory(misses, dem, zoom)
    columns = [*points.columns, *THEORY_COLUMNS]
    spots = ["nearby_best", "nearby_best_distance"]
    return known.select(*columns, *spots).unionByName(live.select(*columns), allowMissingColumns=True)


def diagnose(
    points: DataFrame,
    dem: DataFrame,
    hazards: DataFrame,
    mesh: DataFrame,
    *,
    precomputed: Precomputed | None = None,
    dem_zoom: int = 13,
    slope_zoom: int = 14,
    hazard_zoom: int = 15,
    slope_dem: DataFrame | None = None,
) -> DataFrame:
    """Diagnosis of valid, supported points (point_id, lat, lng).

    ``dem``: gy, gx, elevation at ``dem_zoom`` (``slope_dem`` at ``slope_zoom`` when that differs);
    ``hazards``: layer, gy, gx, r, g, b, a; ``mesh``: ground attributes by 250 m mesh.
    """
    theory = resolve_theory(points, dem, precomputed, dem_zoom)
    modern = modern_risk(
        points.select("point_id", "lat", "lng"), hazards, dem if slope_dem is None else slope_dem, mesh,
        hazard_zoom=hazard_zoom, dem_zoom=slope_zoom,
    )
    both = lookup_join(theory, modern.drop("lat", "lng"), ["point_id"])
    return combine_scores(both).withColumn("coordinate", format_coordinate(F.col("lat"), F.col("lng")))


def split_requests(points: DataFrame, cell_codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(supported points with their scope, rejected points with an error code)."""
    checked = points.withColumn("error_code", coordinate_error(F.col("lat"), F.col("lng")))
    valid, invalid = split_errors(checked)
    scoped = municipality_of(valid, cell_codes)
    outside = scoped.filter(~F.col("supported")).select(*points.columns, F.lit("out_of_scope").alias("error_code"))
    return scoped.filter("supported"), invalid.unionByName(outside)


class Diagnoses(NamedTuple):
    """``diagnoses``: one row per supported point with its scope; ``rejected``: the other points with an ``error_code``."""

    diagnoses: DataFrame
    rejected: DataFrame


def diagnose_requests(points: DataFrame, cell_codes: DataFrame, *tables: DataFrame, **options) -> Diagnoses:
    """Diagnosis behind the scope gate: points with bad coordinates or out of scope are rejected before anything is sampled.

    ``points`` (point_id, lat, lng) may be any; ``cell_codes`` as in :func:`municipality_of`; the rest goes to :func:`diagnose`.
    """
    supported, rejected = split_requests(points, cell_codes)
    supported = cut_lineage(supported)
    scope = ("scope_name", "municipality_code", "address", "scope_source")
    found = diagnose(supported.select(*points.columns), *tables, **options)
    return Diagnoses(lookup_join(found, supported.select("point_id", *scope), ["point_id"]), rejected)


#: Widest viewport in degrees (longitude, latitude).
MAX_VIEW = (0.25, 0.2)


class Viewports(NamedTuple):
    """``cells``: diagnosed cells; ``failures``: cells without a diagnosis, with ``error_code``; ``rejected``: refused viewports."""

    cells: DataFrame
    failures: DataFrame
    rejected: DataFrame


def diagnose_viewports(
    views: DataFrame, columns: Column, rows: Column, view_key: str, cell_codes: DataFrame, *tables: DataFrame, **options
) -> Viewports:
    """Diagnosis of the equal cells of all viewports (west, south, east, north) in one plan.

    A viewport without finite, rising bounds or wider than ``MAX_VIEW`` is refused as a whole. Cells outside the rough
    scope are left out, as the map shows none there; a cell that the scope gate refuses is a failure row of its own.
    """
    bounds = [F.col(c) for c in ("west", "south", "east", "north")]
    finite = [b.isNotNull() & ~F.isnan(b) & (F.abs(b) < float("inf")) for b in bounds]
    west, south, east, north = bounds
    good = (east > west) & (north > south) & (east - west <= MAX_VIEW[0]) & (north - south <= MAX_VIEW[1])
    for f in reversed(finite):
        good = f & good
    checked = views.withColumn("_good", F.coalesce(good, F.lit(False)))
    cells = viewport_grid(checked.filter("_good").drop("_good"), columns, rows)
    cells = cut_lineage(cells.withColumn("point_id", F.concat_ws("-", view_key, "cell")))
    found = diagnose_requests(cells.select("point_id", "lat", "lng"), cell_codes, *tables, **options)
    shape = [c for c in cells.columns if c not in {"lat", "lng"}]
    place = lambda frame: lookup_join(frame, cells.select(*shape), ["point_id"])
    rejected = checked.filter(~F.col("_good")).drop("_good").withColumn("error_code", F.lit("invalid_bounds"))
    return Viewports(place(found.diagnoses), place(found.rejected), rejected)
