"""Known places, listings, quartiles and scores."""

from pyspark.sql import functions as F

from landlens.functions import geo, numeric, text
from landlens.operators import discovery, market, quality, risk
from landlens.plans.listings import assess_listings, clean_listings, town_table


def test_canonical_cells(spark):
    df = spark.createDataFrame([(35.723007, 139.694672), (35.74891843334531, 139.7270419646649)], "lat double, lng double")
    cell = geo.canonical_cell(F.col("lat"), F.col("lng"))
    assert [r[0] for r in df.select(cell.cell_id).collect()] == ["g130-240", "g101-269"]


def test_rounding_rules(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (0.5,), (1.005,)], "x double")
    rows = df.select(
        numeric.half_up(F.col("x")), numeric.half_up(F.col("x"), 2), numeric.half_even(F.col("x"))
    ).collect()
    assert [r[0] for r in rows] == [-2, 3, 1, 1]
    assert rows[3][1] == 1.0
    assert [r[2] for r in rows] == [-2.0, 2.0, 0.0, 1.0]


def test_town_keys(spark):
    raw = ["東京都目黒区東が丘1丁目18-20", "東が丘一丁目", "　目黒区 東が丘１２丁目", "世田谷区北沢100丁目", "区", None, "渋谷区上原20丁目代々木3丁目"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string").orderBy("i")
    wanted = ["東が丘一丁目18-20", "東が丘一丁目", "東が丘十二丁目", "北沢100丁目", "区", "", "上原二十丁目代々木三丁目"]
    assert [r[0] for r in df.select(text.normalize_town(F.col("raw"))).collect()] == wanted


def listing(spark, rows):
    return spark.createDataFrame(
        rows,
        "listing_id int, building_id int, town string, address string, total double, area double, floor_no double, "
        "currentness string, identity_state string",
    )


def test_policy_and_market(spark):
    towns = town_table(
        listing(
            spark,
            [
                (1, 1, "一番町", None, 142000.0, 30.0, 1.0, None, None),
                (2, 1, "一番町", None, 143000.0, 31.0, 1.0, None, None),
                (3, 2, "東が丘一丁目", None, 100000.0, 25.0, 2.0, None, None),
                (4, 3, "東が丘", None, 90000.0, 25.0, 2.0, None, None),
            ],
        )
    )
    row = towns.filter("town_key = '一番町'").first()
    assert (row.n, row.unique_buildings, row.p25_total, row.median_total, row.p75_total) == (2, 1, 142250, 142500, 142750)
    assert row.sample_quality == "THIN"
    asked = listing(
        spark,
        [
            (1, 9, "東が丘一丁目", None, 155000.0, 20.0, 1.0, "confirmed", "exact"),
            (2, 9, None, None, 171000.0, 14.0, 4.0, "unknown", "exact"),
            (3, 9, None, "東京都目黒区東が丘1丁目18-20", 98000.0, 28.71, 2.0, "stale", "partial"),
            (4, 9, "どこか", None, None, 0.0, 2.0, None, None),
            (5, 9, "X東が丘2丁目", None, 90000.0, 20.0, 2.0, "confirmed", "exact"),
        ],
    )
    got = {r.listing_id: r for r in assess_listings(asked, towns).collect()}
    assert got[1].decision_state == "READY_FOR_LAND_CHECK" and got[1].town_key == "東が丘一丁目"
    assert got[1].comparison == "内部サンプル中央値よりかなり高い"
    assert got[2].decision_state == "OUTSIDE_POLICY"
    assert [got[2][g] for g in ("gate_total", "gate_area", "gate_floor")] == ["fail"] * 3
    assert got[3].town_key == "東が丘一丁目" and got[3].decision_state == "POLICY_PASS_RECHECK_REQUIRED"
    assert market.ACTION_LAND in got[3].next_actions and market.ACTION_THIN in got[3].next_actions
    assert got[4].decision_state == "OUTSIDE_POLICY" and got[4].per_sqm is None and got[4].town_key is None
    assert got[5].town_key == "東が丘"
    assert len(got) == 5


def test_rejected_listings(spark):
    raw = spark.createDataFrame(
        [(1, "x" * 81, "1", "2", "3", "confirmed", "exact"), (2, " a ", "", "1e5", "abc", "no", None), (3, "b", "9", " ", "1", "stale", "partial")],
        "listing_id int, town string, total string, area string, floor_no string, currentness string, identity_state string",
    )
    good, bad = clean_listings(raw)
    assert {r.listing_id: r.error_code for r in bad.collect()} == {1: "town:text_too_long", 2: "floor_no:not_a_number"}
    row = good.first()
    assert (row.listing_id, row.total, row.area, row.currentness) == (3, 9.0, None, "stale")


def test_combined_golden(spark):
    df = spark.createDataFrame(
        [(50, 0, 80, 75, None, None, False), (90, 1, 100, 60, 80, None, True), (90, 1, 100, 60, None, None, False)],
        "score int, label_code int, confidence int, modern_score int, water_risk int, slope_risk int, provisional boolean",
    )
    rows = risk.combine_scores(df).collect()
    assert [r.combined_score for r in rows] == [75, 39, 71]
    assert rows[0].combined_label == "概ね良好" and rows[1].capped


def test_unknown_groups_cost_points(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, 0), (None, 0, 0, 1), (None, None, None, 8)],
        "water_risk int, slope_risk int, ground_risk int, unknown_items int",
    )
    rows = risk.land_risk(df).collect()
    assert [r.land_risk for r in rows] == [0, 45, 48]
    assert [r.completeness for r in rows] == [100, 67, 0]
    assert [r.provisional for r in rows] == [False, True, True]


def test_pearson_edges(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 3.0, 6.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 2.0), ("c", 2.0, None)],
        "k string, x double, y double",
    )
    got = {r.k: (r.n, r.pearson) for r in discovery.pearson(df, [("x", "y")], ["k"]).collect()}
    assert got["a"][0] == 3 and abs(got["a"][1] - 1.0) < 1e-12
    assert got["b"] == (3, None) and got["c"] == (1, None)


def test_assert_counts(spark):
    import pytest

    df = spark.range(10)
    quality.assert_counts(df, {"even": F.col("id") % 2 == 0}, {"even": 5})
    with pytest.raises(quality.ContractError):
        quality.assert_counts(df, {"even": F.col("id") % 2 == 0}, {"even": 4})


def test_split_requests(spark):
    from landlens.plans.diagnose import split_requests

    points = spark.createDataFrame(
        [(1, 35.681236, 139.767125), (2, 95.0, 139.7), (3, 43.0, 141.3), (4, 35.6, 139.7), (5, 35.5, 139.6)],
        "point_id int, lat double, lng double",
    )
    cell = lambda lat, lng: geo.canonical_cell(F.lit(lat), F.lit(lng)).cell_id
    codes = spark.range(1).select(F.explode(F.array(
        F.struct(cell(35.681236, 139.767125).alias("cell_id"), F.lit("131010").alias("admin_code"), F.lit("丸の内").alias("address"), F.lit(False).alias("failed")),
        F.struct(cell(35.5, 139.6).alias("cell_id"), F.lit("271000").alias("admin_code"), F.lit("x").alias("address"), F.lit(False).alias("failed")),
    )).alias("c")).select("c.*")
    good, bad = split_requests(points, codes)
    assert {r.point_id: (r.scope_name, r.address) for r in good.collect()} == {
        1: ("東京23区", "丸の内"), 4: ("対象範囲（境界照合は暫定）", None),
    }
    assert {r.point_id: r.error_code for r in bad.collect()} == {2: "invalid_coordinate", 3: "out_of_scope", 5: "out_of_scope"}


def test_viewport_diagnosis(spark):
    from landlens.catalog.inputs import DEM_PIXELS, HAZARDS, MESH, ZOOM
    from landlens.operators.grid_terrain import viewport_grid
    from landlens.plans.diagnose import diagnose_viewports

    sf_dir = "/root/testdata/sf0.001"
    views = spark.createDataFrame(
        [("in", 139.55, 35.80, 139.58, 35.83, 3.0, 0.0), ("out", 141.0, 43.0, 141.1, 43.1, 4.0, 3.0)],
        "view_id string, west double, south double, east double, north double, cols double, rows_asked double",
    )
    asked = views, F.col("cols"), F.col("rows_asked")
    assert viewport_grid(*asked).groupBy("view_id").count().collect() == [("in", 9)]
    codes = spark.createDataFrame([], "cell_id string, admin_code string, address string, failed boolean")
    out = diagnose_viewports(
        *asked, "view_id", codes, DEM_PIXELS.frame(spark, sf_dir), HAZARDS.frame(spark, sf_dir), MESH.frame(spark, sf_dir),
        dem_zoom=ZOOM, slope_zoom=ZOOM, hazard_zoom=ZOOM,
    )
    cells = out.cells.collect()
    assert sorted(r.point_id for r in cells) == [f"in-{i}" for i in range(9)]
    assert all(r.combined_score == r.modern_score or r.capped for r in cells)
    assert out.failures.count() == 0 and out.rejected.count() == 0
