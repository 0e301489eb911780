"""Point to location profile: cell, layers, findings, sources, facts, coverage, diagnosis and scope."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.functions.geo import GRID_COLUMNS
from landlens.operators import profile as pf
from landlens.operators.lookups import municipality_of
from landlens.session import cut_lineage, lookup_join


class Profile(NamedTuple):
    """``points``: one row per point; ``findings`` and ``sources``: long tables keyed by cell, as a cell may have very many."""

    points: DataFrame
    findings: DataFrame
    sources: DataFrame


#: What the profile takes over from a diagnosis (:func:`landlens.plans.diagnose.diagnose`).
DIAGNOSIS_COLUMNS = (
    "source_mode", "score", "label_code", "confidence", "modern_score", "modern_label", "completeness", "combined_score",
    "combined_label", "capped", "provisional",
)


def build_profile(
    points: DataFrame,
    *,
    environment: DataFrame,
    moisture: DataFrame,
    catalog: DataFrame,
    catalog_rows: int | Column,
    index: DataFrame,
    links: DataFrame,
    features: DataFrame,
    geometries: DataFrame,
    staged: list[tuple[str, str, str, str]],
    audience: str,
    catalog_columns: int = GRID_COLUMNS,
    explicit_sources: DataFrame | None = None,
    cell_codes: DataFrame | None = None,
    diagnosis: DataFrame | None = None,
    names: tuple[pf.LayerNames, ...] = (pf.PLACES, pf.CATALOG, pf.MOISTURE, pf.ENVIRONMENT),
) -> Profile:
    """Profiles of points (point_id, lat, lng, ...). Layers never score and are never averaged.

    Layers, findings, sources and counts are made once per cell, whatever the number of its points, and joined to the points
    once. ``cell_codes`` adds scope and municipality, ``diagnosis`` (one row per point_id) the scores; a point without a
    diagnosis, as one out of scope, keeps its profile with NULL scores. ``names``: places, catalog, moisture, environment.
    """
    places, catalogued, damp, surroundings = names
    placed = pf.with_cell(points)
    cells = placed.select("cell_id", "grid_row", "grid_col").distinct().withColumn("point_id", F.col("cell_id"))
    keyed = lambda layer: layer.withColumnRenamed("point_id", "cell_id")
    here = cells.select("cell_id")
    near = links.join(here, "cell_id", "left_semi")
    spots = cut_lineage(pf.place_records(near, features, geometries, audience, places))
    place = cut_lineage(keyed(pf.place_layer(cells, index, near, audience, places, findings=spots)))
    layers = cut_lineage(
        pf.layer_rows(
            place,
            keyed(pf.catalog_layer(cells, catalog, catalog_rows, catalog_columns, catalogued)),
            keyed(pf.moisture_layer(cells, moisture, damp)),
            keyed(pf.environment_layer(cells, environment, surroundings)),
            keyed(pf.staged_layers(cells, staged)),
            key="cell_id",
        )
    )
    own = pf.cell_findings(layers, names)
    findings = spots.unionByName(own.withColumn("finding_key", F.lit(None).cast("string")))
    explicit = None if explicit_sources is None else explicit_sources.join(here, "cell_id", "left_semi")
    sources = cut_lineage(pf.profile_sources(findings, near, audience, names, explicit, places))
    composed = pf.compose_cells(layers, place, findings, sources)
    out = placed
    if cell_codes is not None:
        scoped = municipality_of(placed.withColumnRenamed("cell_id", "_cell"), cell_codes)
        out = scoped.drop("cell_id", "scope_source").withColumnRenamed("_cell", "cell_id")
    if diagnosis is not None:
        out = lookup_join(out, diagnosis.select("point_id", *DIAGNOSIS_COLUMNS), ["point_id"])
    return Profile(lookup_join(out, composed, ["cell_id"]), findings.drop("finding_key"), sources)
