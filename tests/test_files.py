"""Readers, writers and the stream, over files written by the test."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from landlens.operators.spatial import nearest_cell
from landlens.plans.grid_build import ENGINE, Region, build_grid, load_grid, precomputed_of, region_lattice, save_grid
from landlens.plans.listings import town_table
from landlens.sources import grids, packed
from landlens.streaming.listings import assess_stream, write_assessments

CELL = {
    "lat": 35.6, "lng": 139.7, "bounds": [[35.5, 139.6], [35.7, 139.8]], "label": "普通地", "labelCode": 3, "originalScore": 50,
    "originalFit": 10, "highEvidence": 0.1, "lowEvidence": 0.2, "ordinaryEvidence": 0.3, "auxiliaryTerrainScore": 60, "detailScore": 52,
    "neighborhoodScore": 51, "confidence": 70, "nearbyBestIndex": -1, "nearbyBestDistanceMeters": None,
}


def test_grid_documents(spark, tmp_path):
    for name, cells in (("one", 3), ("two", 0)):
        doc = {
            "generatedAt": "2026-01-01", "center": {"lat": 35.6, "lng": 139.7, "name": name, "stepMeters": 100},
            "region": {"id": name, "name": name.upper()}, "bounds": [[35.5, 139.6], [35.7, 139.8]], "cells": [CELL] * cells,
            "hotspots": [{"lat": 35.6, "lng": 139.7, "detailScore": 80, "originalScore": 81, "confidence": 60, "label": "x"}],
        }
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, ensure_ascii=False), encoding="utf-8")
    docs = grids.read_grids(spark, str(tmp_path))
    cells, regions = grids.grid_cells(docs), grids.grid_regions(docs)
    assert cells.count() == 3 and cells.first().west == 139.6 and cells.first().label == "普通地"
    assert grids.grid_hotspots(docs).count() == 2
    meta = {r.region_id: (r.region_name, r.cell_count, r.radius_m) for r in grids.region_meta(cells, regions).collect()}
    assert meta == {"one": ("ONE", 3, 4500.0), "two": ("TWO", 0, 4500.0)}
    assert {r.region_id: r.region_order for r in regions.collect()} == {"one": 0, "two": 1}
    turned = grids.grid_regions(grids.read_grids(spark, [str(tmp_path / "two.json"), str(tmp_path / "one.json")]))
    assert {r.region_id: r.region_order for r in turned.collect()} == {"two": 0, "one": 1}
    points = spark.createDataFrame([(1, 35.6001, 139.7), (2, 35.9, 139.7)], "point_id int, lat double, lng double")
    grid = precomputed_of(docs)
    near = nearest_cell(points, grid.cells.select("region_id", "cell_index", "lat", "lng"), grid.regions, max_step_m=grid.max_step_m)
    assert {r.point_id: (r.region_id, r.cell_index) for r in near.collect()} == {1: ("one", 0), 2: (None, None)}
    grids.write_cells(cells, str(tmp_path / "out"), engine=ENGINE)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 3 and back.first().engine_name == ENGINE["name"]


def test_environment_csv_with_mark(spark, tmp_path):
    names = [f.name for f in packed.ENVIRONMENT_CSV]
    line = "g1-2,1,2,True,false,TRUE,HRZ00007,CANDIDATE,NO_CURRENT_BUILDINGS,4,2,1,PASS,0.25,0.5"
    empty = "g1-3,1,3,False,true,no,,NEUTRAL,A_BUILT_UP_CONTINUITY,4,2,1,PASS,0,1"
    with gzip.open(tmp_path / "cells.csv.gz", "wt", encoding="utf-8-sig") as f:
        f.write("\n".join([",".join(names), line, empty]) + "\n")
    rows = packed.read_environment_csv(spark, str(tmp_path / "cells.csv.gz")).orderBy("cell_id").collect()
    assert [r.cell_id for r in rows] == ["g1-2", "g1-3"]
    assert rows[0].robust_candidate and not rows[0].threshold_stable and rows[0].zone_id == "HRZ00007"
    assert rows[1].zone_id is None and rows[1].share_500m == 1.0


def test_sparse_index(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps([["g1-1", *range(10), "OK"], ["g2-2", *range(10, 20), "OPEN"]]))
    rows = packed.read_sparse_index(spark, str(tmp_path / "index.json")).orderBy("cell_id").collect()
    assert (rows[0].total_links, rows[0].non_positive_links, rows[1].index_status) == (0, 9, "OPEN")


def test_boundaries(spark, tmp_path):
    square = [[0, 0], [1, 0], [1, 1], [0, 0]]
    doc = {
        "features": [
            {"properties": {"N03_007": "13101"}, "geometry": {"type": "Polygon", "coordinates": [square]}},
            {"properties": {"N03_007": "14101"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square], [square, square]]}},
            {"properties": {"N03_007": "27100"}, "geometry": {"type": "Polygon", "coordinates": [square]}},
            {"properties": {"N03_007": "13102"}, "geometry": {"type": "Point", "coordinates": [0, 0]}},
        ]
    }
    (tmp_path / "b.geojson").write_text(json.dumps(doc))
    features = grids.filter_boundaries(grids.read_boundary_features(spark, str(tmp_path / "b.geojson")))
    vertices = grids.boundary_vertices(features)
    got = {(r.admin_code, r.polygon_id): r.n for r in vertices.groupBy("admin_code", "polygon_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {("13101", "0/0"): 4, ("14101", "1/0"): 4, ("14101", "1/1"): 8}


def test_lattice_sizes(spark):
    """The two published regions: a 4.5 km circle has 6,361 cells."""
    circle = Region("circle", "Circle", (35.667228, 139.759732))
    assert region_lattice(spark, circle).count() == 6361
    from landlens.catalog.spatial_queries import CORRIDOR_CENTRE, STATIONS

    corridor = Region("corridor", "Corridor", CORRIDOR_CENTRE, radius_m=None, buffer_m=1000.0, stations=tuple(STATIONS))
    assert region_lattice(spark, corridor).count() == 2109


def test_built_grid_feeds_a_diagnosis(spark, tmp_path):
    """build_grid, save_grid, load_grid and diagnose in one chain, over a hilly raster at a coarse zoom."""
    from landlens.functions.geo import METERS_PER_DEGREE
    from landlens.operators.raster import mosaic_origin
    from landlens.plans.diagnose import resolve_theory

    region = Region("7", "Seven", (35.6, 139.7), extent_m=600.0, radius_m=600.0)
    row0, col0 = mosaic_origin(35.6 + 0.06, 139.7 - 0.08, 11)
    dem = spark.range(512 * 768).select(
        (F.floor(F.col("id") / 768) + row0).cast("int").alias("gy"), (F.col("id") % 768 + col0).cast("int").alias("gx")
    )
    dem = dem.withColumn("elevation", 30 + 20 * F.sin(F.col("gy") / 9.0) + 14 * F.cos(F.col("gx") / 6.0))
    cells, hotspots = build_grid(spark, dem, region, zoom=11)
    header = spark.createDataFrame([("7", 0, "Seven")], "region_id string, region_order int, region_name string")
    save_grid(cells, hotspots, header, str(tmp_path / "grid"))
    grid = load_grid(spark, str(tmp_path / "grid"))
    assert dict(grid.cells.dtypes)["region_id"] == "string" and grid.regions.first().cell_count == grid.cells.count() > 100
    on_cell = grid.cells.orderBy("cell_index").limit(3).select(F.col("cell_index").cast("int").alias("point_id"), "lat", "lng")
    outside = spark.createDataFrame([(-1, 35.6 + 900 / METERS_PER_DEGREE, 139.7)], "point_id int, lat double, lng double")
    got = {r.point_id: r for r in resolve_theory(on_cell.union(outside), dem, grid, 11).collect()}
    want = {r.cell_index: r for r in grid.cells.collect()}
    assert got[-1].source_mode == "live-analysis"
    for i, r in got.items():
        if i >= 0:
            assert (r.source_mode, r.detail_score, r.confidence) == ("precomputed-100m", want[i].detail_score, want[i].confidence)
            assert r.reasons[-1].startswith("Seven")


def test_stream_matches_batch(spark, tmp_path):
    rows = [(i, i % 3, f"町{i % 4}", 60000.0 + 5000 * i, 20.0, float(i % 5), "confirmed", "exact") for i in range(40)]
    listings = spark.createDataFrame(
        rows, "listing_id int, building_id int, town string, total double, area double, floor_no double, currentness string, identity_state string"
    )
    listings.write.parquet(str(tmp_path / "in"))
    towns = town_table(listings)
    stream = spark.readStream.schema(listings.schema).parquet(str(tmp_path / "in"))
    write_assessments(assess_stream(stream, towns), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    key = lambda df: sorted((r.listing_id, r.decision_state, r.comparison) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(assess_stream(listings, towns))


def test_broken_documents_fail(spark, tmp_path):
    (tmp_path / "grids").mkdir()
    (tmp_path / "grids" / "a.json").write_text('{"cells": [')
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        grids.read_grids(spark, str(tmp_path / "grids")).collect()
    (tmp_path / "index.json").write_text('[["C1", 1,\n 2]]')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        packed.read_sparse_index(spark, str(tmp_path / "index.json")).collect()


def test_environment_csv_goes_by_name(spark, tmp_path):
    names = [f.name for f in packed.ENVIRONMENT_CSV]
    values = {f.name: "1" if f.dataType.simpleString() in ("int", "double") else "x" for f in packed.ENVIRONMENT_CSV}
    values |= {"robustCandidate": "true", "thresholdStable": "false"}
    shuffled = ["extra", *reversed(names)]
    path = tmp_path / "cells.csv"
    path.write_text("\ufeff" + ",".join(shuffled) + "\n" + ",".join(values.get(n, "z") for n in shuffled) + "\n")
    row = packed.read_environment_csv(spark, str(path)).first()
    assert row.robust_candidate is True and row.threshold_stable is False and row.grid_row == 1
    path.write_text(",".join(names[1:]) + "\n")
    with pytest.raises(ValueError, match=names[0]):
        packed.read_environment_csv(spark, str(path))
