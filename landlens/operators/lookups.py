"""Equi joins against rasters, meshes, gazetteers and per-cell layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landlens.functions import geo
from landlens.functions.labels import amplification_score
from landlens.functions.numeric import half_up
from landlens.functions.text import trimmed
from landlens.session import lookup_join
from landlens.sources.pixels import elevation

PIXEL_KEY = ["x", "y", "px", "py"]

# Micro-landform risk by code.
LANDFORM_RISK = {
    0: 100, 1: 5, 2: 10, 3: 10, 4: 10, 5: 10, 6: 10, 7: 10, 8: 15, 9: 15, 10: 55, 11: 35, 12: 35, 13: 75, 14: 90,
    15: 75, 16: 50, 17: 50, 18: 70, 19: 85, 20: 90, 21: 15, 22: 100, 23: 100, 24: 100,
}
UNKNOWN_GROUND = 50


def with_tile_pixel(points: DataFrame, zoom: int) -> DataFrame:
    pixel = geo.tile_pixel(F.col("lat"), F.col("lng"), zoom)
    return points.select("*", *[getattr(pixel, k).alias(k) for k in PIXEL_KEY])


def raster_lookup(points: DataFrame, raster: DataFrame, zoom: int) -> DataFrame:
    """Raster columns at each point's pixel; a missing tile gives NULLs.

    ``raster`` holds one layer at one zoom, keyed by tile and pixel. Keeping it partitioned or bucketed by (x, y)
    makes the join local to tiles.
    """
    return lookup_join(with_tile_pixel(points, zoom), raster, PIXEL_KEY).drop(*PIXEL_KEY)


def dem_mosaic(rasters: DataFrame, keys: list[str] = PIXEL_KEY) -> DataFrame:
    """Elevation per pixel from the first source (lowest ``priority``) that has a value there.

    One aggregation over all sources replaces one join per source; pixels without any value disappear.
    """
    decoded = rasters.select(*keys, "priority", elevation(*[F.col(c) for c in "rgba"]).alias("v"))
    return (
        decoded.filter(F.col("v").isNotNull())
        .groupBy(*keys)
        .agg(F.min_by("v", "priority").alias("elevation"))
    )


def dem_fallback(points: DataFrame, rasters: DataFrame, zoom: int) -> DataFrame:
    """Elevation at each point from prioritised sources.

    Only the pixels that some point needs are decoded and merged: the needed pixels are reduced to distinct keys
    first, so a place asked for by very many points costs one lookup.
    """
    placed = with_tile_pixel(points, zoom)
    needed = placed.select(*PIXEL_KEY).distinct()
    values = dem_mosaic(rasters.join(needed, PIXEL_KEY, "left_semi"))
    return lookup_join(placed, values, PIXEL_KEY).drop(*PIXEL_KEY)


def landform_risk(code: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in LANDFORM_RISK.items() for v in pair])
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit(UNKNOWN_GROUND))


def ground_risk(landform: Column, amplification: Column) -> Column:
    finite = amplification.isNotNull() & ~F.isnan(amplification) & (F.abs(amplification) < F.lit(float("inf")))
    shaking = F.when(finite, amplification_score(amplification)).otherwise(UNKNOWN_GROUND)
    return F.greatest(landform_risk(landform), half_up(shaking * F.lit(0.9)).cast("int"))


def ground_lookup(points: DataFrame, mesh: DataFrame) -> DataFrame:
    """Ground attributes of the 250 m mesh (mesh_row, mesh_col, landform_code, landform_name, amplification).

    Adds ``ground_score`` and ``ground_status``: a point outside the mesh is an error item without a score.
    """
    row, col = geo.mesh_250m(F.col("lat"), F.col("lng"))
    known = mesh.withColumn("_hit", F.lit(True))
    joined = lookup_join(
        points.withColumn("mesh_row", row).withColumn("mesh_col", col), known, ["mesh_row", "mesh_col"]
    )
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return (
        joined.withColumn("ground_score", F.when(hit, ground_risk(F.col("landform_code"), F.col("amplification"))))
        .withColumn("ground_status", F.when(hit, "known").otherwise("error"))
        .drop("_hit", "mesh_row", "mesh_col")
    )


def geocode_candidates(queries: DataFrame, gazetteer: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` usable gazetteer rows per query in source order, with ``rank`` 1..k.

    ``queries``: query_id, query; ``gazetteer``: query, source_order, label, lat, lng. Queries of fewer than 2 or
    more than 120 characters match nothing. The rank filter lets Spark limit each group before the shuffle.
    """
    asked = queries.withColumn("query", trimmed(F.col("query"))).filter(F.length("query").between(2, 120))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    usable = gazetteer.filter((F.col("label") != "") & finite("lat") & finite("lng")).filter(
        geo.address_in_scope(F.col("label"))
    )
    best = (
        usable.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("source_order")))
        .filter(F.col("rank") <= k)
        .select("query", "rank", "label", "lat", "lng")
    )
    return asked.join(best, "query")


def municipality_of(points: DataFrame, cell_codes: DataFrame) -> DataFrame:
    """Scope of each point from a cell-to-code table (cell_id, admin_code, address, failed).

    Outside the rough boxes nothing is looked up; a failed or missing lookup is provisionally supported.
    """
    cell = geo.canonical_cell(F.col("lat"), F.col("lng"))
    inside = geo.rough_scope(F.col("lat"), F.col("lng"))
    asked = points.withColumn("_inside", inside).withColumn("cell_id", F.when(inside, cell.cell_id))
    joined = lookup_join(asked, cell_codes.withColumn("_hit", ~F.col("failed")).drop("failed"), ["cell_id"])
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    code5, name, supported = geo.scope_from_code(F.col("admin_code"))
    return joined.select(
        *points.columns,
        "cell_id",
        F.when(F.col("_inside"), F.when(hit, supported).otherwise(True)).otherwise(False).alias("supported"),
        F.when(~F.col("_inside"), geo.OUT_OF_SCOPE)
        .when(hit, name)
        .otherwise(geo.PROVISIONAL_SCOPE)
        .alias("scope_name"),
        F.when(hit, code5).alias("municipality_code"),
        F.when(hit, F.col("address")).alias("address"),
        F.when(hit, "reverse-lookup").otherwise("rough-bounds").alias("scope_source"),
    )


def first_geometry(geometries: DataFrame) -> DataFrame:
    """Primary geometry per feature: the first in table order."""
    rest = [c for c in geometries.columns if c not in {"feature_id", "seq"}]
    return geometries.groupBy("feature_id").agg(F.min_by(F.struct(*rest), "seq").alias("geometry"))


def feature_join(links: DataFrame, features: DataFrame, geometries: DataFrame) -> DataFrame:
    """Links with their feature and primary geometry; links without a feature id stay, with NULLs.

    Links that carry no feature id would all hash to one partition, so they skip the join.
    """
    known = features.join(first_geometry(geometries), "feature_id", "left").withColumnRenamed(
        "feature_id", "global_feature_id"
    )
    with_id = links.filter(F.col("global_feature_id").isNotNull())
    without = links.filter(F.col("global_feature_id").isNull())
    return lookup_join(with_id, known, ["global_feature_id"]).unionByName(without, allowMissingColumns=True)


def core_zone_flag(cells: DataFrame, zones: DataFrame, min_cells: int = 3) -> DataFrame:
    """Mark cells of zones with at least ``min_cells`` core cells."""
    core = (
        zones.filter(F.col("is_zone") & (F.col("core_cell_count") >= min_cells))
        .select("zone_id")
        .distinct()
        .withColumn("_core", F.lit(True))
    )
    with_zone = cells.filter(F.col("zone_id").isNotNull())
    without = cells.filter(F.col("zone_id").isNull()).withColumn("core_zone", F.lit(False))
    flagged = lookup_join(with_zone, core, ["zone_id"])
    flagged = flagged.withColumn("core_zone", F.coalesce(F.col("_core"), F.lit(False))).drop("_core")
    return flagged.unionByName(without)


def theory_from_cell(hits: DataFrame, cells: DataFrame, hotspots: DataFrame, regions: DataFrame) -> DataFrame:
    """Theory record of points that hit a precomputed cell; index -1 or an unknown distance means no best spot.

    ``hits`` comes from :func:`landlens.operators.spatial.nearest_cell` with region_id and cell_index set.
    """
    spots = hotspots.select(
        "region_id",
        F.col("hotspot_index").alias("nearby_best_index"),
        F.struct(*[c for c in hotspots.columns if c not in {"region_id", "hotspot_index"}]).alias("_spot"),
    )
    cell = cells.drop("lat", "lng", "south", "west", "north", "east")
    joined = lookup_join(hits.drop("distance_m"), cell, ["region_id", "cell_index"])
    joined = lookup_join(joined, spots, ["region_id", "nearby_best_index"])
    joined = joined.join(regions.select("region_id", "region_name"), "region_id", "left")
    percent = lambda c: half_up(F.col(c) * 100.0).cast("string")
    return joined.select(
        *[c for c in hits.columns if c not in {"region_id", "cell_index", "distance_m"}],
        F.col("detail_score").alias("score"),
        "label_code",
        "original_score",
        "original_fit",
        "auxiliary_score",
        "detail_score",
        "neighborhood_score",
        "confidence",
        "high_evidence",
        "low_evidence",
        "ordinary_evidence",
        F.when(
            (F.col("nearby_best_index") >= 0) & F.col("nearby_best_distance").isNotNull(), F.col("_spot")
        ).alias("nearby_best"),
        F.when(F.col("_spot").isNotNull(), F.col("nearby_best_distance")).alias("nearby_best_distance"),
        F.lit("precomputed-100m").alias("source_mode"),
        F.array(
            F.concat(
                F.lit("原典交会：高位×高位 "), percent("high_evidence"),
                F.lit("／低位×低位 "), percent("low_evidence"),
                F.lit("／高位×低位 "), percent("ordinary_evidence"),
            ),
            F.format_string("原典ロジック点 %d／補助地形点 %d", "original_score", "auxiliary_score"),
            F.format_string("原典80%%＋補助地形20%%で地点詳細点 %d", "detail_score"),
            F.format_string("半径500mの周辺点 %d", "neighborhood_score"),
            F.concat(F.col("region_name"), F.lit("を100m間隔で事前計算")),
        ).alias("reasons"),
    )
