"""Operators against brute force on small inputs, and invariants."""

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landlens import session
from landlens.functions import text
from landlens.operators import discovery, grid_terrain, lookups, market, raster, risk, spatial
from landlens.session import cut_lineage
from landlens.sources import packed


def test_lookup_join_with_a_hot_key(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(1, "hot"), (950, "cold"), (5000, "none")], "k bigint, t string")
    got = {r.v: r.t for r in session.lookup_join(left, right, ["k"]).collect()}
    assert got == {v: "hot" if v < 900 else "cold" if v == 950 else None for v in range(1000)}


def test_lookup_join_keeps_null_keys(spark):
    left = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    right = spark.createDataFrame([(1, "x")], "k int, t string")
    out = session.lookup_join(left, right, ["k"])
    assert sorted((r.v, r.t) for r in out.collect()) == [(1, None), (2, "x")]


def test_contains_text_with_a_null_column(spark):
    df = spark.createDataFrame([("Harbour", None), (None, "x"), (None, None)], "a string, b string")
    assert [r.a for r in df.filter(text.contains_text("harb", F.col("a"), F.col("b"))).collect()] == ["Harbour"]


def test_exact_quantiles(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(rng.randint(0, 40))) for _ in range(501)] + [("c", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 0.9}
    got = {r.k: r for r in market.exact_quantiles(df, ["k"], "x", probs).collect()}
    for k in "abc":
        values = [x for kk, x in rows if kk == k]
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(values, p))
    assert "d" not in got


def nms_brute(cells, radius, step):
    kept = []
    for r in sorted(cells, reverse=True):
        if all(math.hypot(r[1] - k[1], r[2] - k[2]) * step >= radius for k in kept):
            kept.append(r)
    return kept


def test_suppress_is_greedy(spark):
    rng = random.Random(3)
    cells = sorted({(rng.randint(0, 25), rng.randint(0, 30)) for _ in range(300)})
    rows = [(1, r, c, rng.randint(50, 60)) for r, c in cells]
    df = spark.createDataFrame(rows, "region_id int, grid_row int, grid_col int, detail_score int")
    got = [(r.detail_score, r.grid_row, r.grid_col) for r in grid_terrain.suppress(df).orderBy("hotspot_index").collect()]
    assert got == nms_brute([(s, r, c) for _, r, c, s in rows], 350.0, 100.0)[:60]
    for i, a in enumerate(got):
        for b in got[:i]:
            assert math.hypot(a[1] - b[1], a[2] - b[2]) * 100 >= 350
    few = grid_terrain.suppress(df, keep=5)
    assert few.count() == 5
    assert grid_terrain.suppress(df.limit(0)).count() == 0
    every = [(r.detail_score, r.grid_row, r.grid_col) for r in grid_terrain.suppress(df, keep=None).orderBy("hotspot_index").collect()]
    assert every == nms_brute([(s, r, c) for _, r, c, s in rows], 350.0, 100.0)


def test_suppress_ramp_and_regions(spark):
    """A long descending chain, in two regions, with repeated cells."""
    rows = [(g, 0, c, 1000 - c - g) for g in (1, 2) for c in range(90)] * 2
    df = spark.createDataFrame(rows, "region_id int, grid_row int, grid_col int, detail_score int")
    for region in (1, 2):
        got = grid_terrain.suppress(df, keep=7).filter(F.col("region_id") == region).orderBy("hotspot_index").collect()
        assert [r.grid_col for r in got] == [4 * i for i in range(7)]
        assert [r.hotspot_index for r in got] == list(range(7))


def test_suppress_all_settles_a_ramp_by_squares(spark):
    """One chain of ever worse neighbours over the whole lattice: rounds follow the squares it crosses, not its cells."""
    rows = [(1, r, c, 10_000 - 40 * r - c) for r in range(60) for c in range(40)]
    df = spark.createDataFrame(rows, "region_id int, grid_row int, grid_col int, detail_score int")
    near = grid_terrain._within(350.0, 100.0)
    want = set(nms_brute([(s, r, c) for _, r, c, s in rows], 350.0, 100.0))
    for square in (16, 256):
        written = []
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(grid_terrain, "cut_lineage", lambda f: written.append(1) or cut_lineage(f))  # noqa: B023
            got = {(r.detail_score, r.grid_row, r.grid_col) for r in grid_terrain.suppress_all(df, near, square).collect()}
        assert got == want
        assert len(written) <= (2 if square == 256 else 40)


def test_ranks_of_one_hot_group(spark):
    """A group with nine tenths of the rows, most of them with one score, and a group without a name."""
    from landlens.operators.discovery import group_ranks, page, page_after
    from landlens.operators.market import exact_quantiles
    from landlens.operators.ranking import ordered_rank

    rng = random.Random(2)
    rows = [("hot", 5.0 if rng.random() < 0.8 else float(rng.randrange(100)), i) for i in range(3000)]
    rows += [("cold", float(i % 7), 4000 + i) for i in range(50)] + [(None, 1.0, 9000 + i) for i in range(5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, score double, id int")
    want = {}
    for g in ("hot", "cold", None):
        for k, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            want[i] = k
    ranked = ordered_rank(df, ["g"], [F.desc("score"), F.asc("id")], "rank").collect()
    assert {r.id: r["rank"] - 1 for r in ranked} == want
    named = group_ranks(df.filter("g IS NOT NULL"), "g", "score", "id").collect()
    assert {r.id: (r["rank"], r.group_size) for r in named} == {i: (want[i], 3000 if i < 4000 else 50) for i in want if i < 9000}
    got = {r.g: (r.a, r.b, r.c) for r in exact_quantiles(df, ["g"], "score", {"a": 0.0, "b": 0.25, "c": 0.97}).collect()}
    for g in ("hot", "cold", None):
        assert got[g] == pytest.approx(tuple(np.quantile([r[1] for r in rows if r[0] == g], q) for q in (0.0, 0.25, 0.97)))
    ids = sorted(r[2] for r in rows)
    deep = page(df, "id", 3020, 20).collect()
    assert sorted(r.id for r in deep) == ids[3020:3040] and {(r.filtered, r.next_offset) for r in deep} == {(3055, 3040)}
    assert {r.next_offset for r in page(df, "id", 3040, 20).collect()} == {None}
    seen, cursor = [], None
    for _ in range(4):
        part = sorted(page_after(df.filter("id < 130"), "id", cursor, 50).collect(), key=lambda r: r.id)
        if not part:
            break
        seen += [r.id for r in part]
        cursor = part[0].next_after
        if cursor is None:
            break
    assert seen == [i for i in ids if i < 130]


def test_polygon_of_many_vertices(spark):
    """A coast of 200,000 vertices: arrays stay bounded and the masks agree with the rule."""
    rng = np.random.default_rng(5)
    n = 200_000
    angle = np.linspace(0, 2 * math.pi, n, endpoint=False)
    radius = 0.3 + 0.02 * np.sin(40 * angle) + 0.004 * rng.random(n)
    x, y = 139.7 + radius * np.cos(angle), 35.6 + radius * np.sin(angle)
    x, y = np.append(x, x[0]), np.append(y, y[0])
    ring = pd.DataFrame({"polygon_id": 1, "ring_id": 0, "seq": np.arange(n + 1), "lng": x, "lat": y})
    square = pd.DataFrame({"polygon_id": 2, "ring_id": 0, "seq": range(5), "lng": [139.0, 139.1, 139.1, 139.0, 139.0], "lat": [35.0, 35.0, 35.1, 35.1, 35.0]})
    at = np.column_stack([rng.uniform(35.2, 36.0, 300), rng.uniform(139.3, 140.1, 300)])
    at[:20] = np.column_stack([rng.uniform(34.9, 35.2, 20), rng.uniform(138.9, 139.2, 20)])
    points = spark.createDataFrame(pd.DataFrame({"point_id": range(300), "lat": at[:, 0], "lng": at[:, 1]}))
    got = {r.point_id: r.inside for r in spatial.polygon_mask(points, spark.createDataFrame(pd.concat([ring, square]))).collect()}
    for i, (lat, lng) in enumerate(at):
        spans = (y[:-1] > lat) != (y[1:] > lat)
        cut = x[:-1][spans] + (x[1:] - x[:-1])[spans] * (lat - y[:-1][spans]) / (y[1:] - y[:-1])[spans]
        inside = (lng < cut).sum() % 2 == 1 or (35.0 < lat < 35.1 and 139.0 < lng < 139.1)
        assert got[i] == inside, i
    assert 30 < sum(got.values()) < 270


def test_windows_across_squares(spark):
    """Stencils and places read the same pixels whatever the square they fall in."""
    from landlens.operators import windows as win

    rng = np.random.default_rng(3)
    values = rng.normal(size=(300, 600))
    values[rng.random(values.shape) < 0.05] = np.nan
    r, c = np.nonzero(~np.isnan(values))
    pixels = spark.createDataFrame(pd.DataFrame({"row": r, "col": c, "value": values[r, c]}))
    at = pd.DataFrame({"id": range(400), "r": rng.integers(-20, 320, 400), "c": rng.integers(-20, 620, 400)})
    places = spark.createDataFrame(at)

    def compute(window, asked):
        rows, cols = win.numbers(asked, "r").astype(int), win.numbers(asked, "c").astype(int)
        seen = window.at("value", rows + 7, cols - 9) + window.at("value", rows - 3, cols)
        return pa.table({"id": asked.column("id"), "v": pa.array(seen, from_pandas=True)})

    reach = (F.col("r") - 3, F.col("r") + 7, F.col("c") - 9, F.col("c") + 0)
    out = win.at_places(places, pixels, reach, compute, "id bigint, v double").collect()
    look = lambda i, j: values[i, j] if 0 <= i < 300 and 0 <= j < 600 else np.nan
    for row in out:
        want = look(at.r[row.id] + 7, at.c[row.id] - 9) + look(at.r[row.id] - 3, at.c[row.id])
        assert (row.v is None and np.isnan(want)) or row.v == want
    assert len(out) == 400


def test_neighborhood_keeps_regions_apart(spark):
    """Constant scores of two regions on the same positions stay what they are; the stated extent counts as unknown."""
    rows = [(g, r, c, 10 if g == "a" else 90) for g in "ab" for r in range(12) for c in range(9)]
    df = spark.createDataFrame(rows, "region_id string, grid_row int, grid_col int, detail_score int")
    out = grid_terrain.neighborhood_score(df, rows=20, cols=F.when(F.col("region_id") == "a", 9).otherwise(15))
    assert {(r.region_id, r.neighborhood_score) for r in out.collect()} == {("a", 10), ("b", 90)}
    assert out.count() == len(rows)
    step = spark.createDataFrame([("a", r, 0, 0 if r < 5 else 100) for r in range(6)], "region_id string, grid_row int, grid_col int, detail_score int")
    at = lambda n: grid_terrain.neighborhood_score(step, rows=n, cols=1).filter("grid_row = 5").first().neighborhood_score
    taps = raster.kernel(2.5)
    near, far = sum(taps[5:10]), taps[10]
    assert at(40) == round(100 * far / (near + far))
    assert at(6) == round(100 * (far + sum(taps[11:])))


def blur_brute(values, sigma, threshold):
    taps = raster.kernel(sigma)
    radius = len(taps) // 2
    rows, cols = values.shape
    known = np.isfinite(values)
    v, w = np.where(known, values, 0.0), known.astype(float)

    def smooth(a):
        a = sum(t * a[:, np.clip(np.arange(cols) + k, 0, cols - 1)] for k, t in zip(range(-radius, radius + 1), taps))
        return sum(t * a[np.clip(np.arange(rows) + k, 0, rows - 1), :] for k, t in zip(range(-radius, radius + 1), taps))

    num, den = smooth(v), smooth(w)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(den > threshold, num / den, np.nan)


@pytest.mark.parametrize("sigma", [0.7, 3.0, 30.0])
def test_gaussian_blocks(spark, sigma):
    """More lines than a band and more columns than a segment, with holes and missing rows."""
    rng = np.random.default_rng(5)
    values = rng.normal(size=(70, 1100))
    values[rng.random(values.shape) < 0.2] = np.nan
    values[10:40, 200:700] = np.nan
    rows = [(int(r), int(c), float(values[r, c])) for r, c in zip(*np.where(np.isfinite(values)))]
    df = spark.createDataFrame(rows, "row int, col int, value double")
    got = raster.normalized_gaussian(df, sigma, 0.35, rows=70, cols=1100).toPandas()
    wanted = blur_brute(values, sigma, 0.35)
    assert len(got) == np.isfinite(wanted).sum()
    assert np.allclose(got["value"], wanted[got["row"], got["col"]], atol=1e-9)


def test_weight_surface_of_full_raster_is_one(spark):
    df = spark.createDataFrame([(r, c, 1.0) for r in range(9) for c in range(9)], "row int, col int, value double")
    out = raster.gaussian_surfaces(df, [raster.Surface("w", 2.0, weight_only=True), raster.Surface("v", 2.0)])
    assert all(abs(r.w - 1) < 1e-9 and abs(r.v - 1) < 1e-9 for r in out.collect())


def test_gradient_matches_numpy(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(12, 17)) * 10
    df = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(12) for c in range(17)], "row int, col int, value double")
    got = raster.gradient_slope(df, 7.0).toPandas()
    gy, gx = np.gradient(z, 7.0, 7.0)
    wanted = np.degrees(np.arctan(np.hypot(gx, gy)))
    assert len(got) == z.size
    assert np.allclose(got["value"], wanted[got["row"], got["col"]])


def test_polygon_mask_brute(spark):
    rng = random.Random(11)
    polygons = []
    for p in range(12):
        cx, cy = rng.uniform(139.4, 139.9), rng.uniform(35.3, 35.8)
        ring = [(cx + rng.uniform(0.02, 0.12) * math.cos(a), cy + rng.uniform(0.02, 0.12) * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 9)[:-1]]
        hole = [(cx + 0.01 * math.cos(a), cy + 0.01 * math.sin(a)) for a in np.linspace(0, 2 * math.pi, 5)[:-1]]
        polygons.append([ring + ring[:1], hole + hole[:1]])
    vertices = [
        (p, k, i, x, y) for p, rings in enumerate(polygons) for k, ring in enumerate(rings) for i, (x, y) in enumerate(ring)
    ]
    points = [(i, rng.uniform(35.2, 35.9), rng.uniform(139.3, 140.0)) for i in range(600)]

    def inside(lat, lng):
        for rings in polygons:
            crossings = 0
            for ring in rings:
                for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
                    if (y1 > lat) != (y2 > lat) and lng < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                        crossings += 1
            if crossings % 2:
                return True
        return False

    out = spatial.polygon_mask(
        spark.createDataFrame(points, "point_id int, lat double, lng double"),
        spark.createDataFrame(vertices, "polygon_id int, ring_id int, seq int, lng double, lat double"),
    )
    got = {r.point_id: r.inside for r in out.collect()}
    assert got == {i: inside(lat, lng) for i, lat, lng in points}
    assert 0 < sum(got.values()) < 600


def test_polygon_mask_in_halved_cells(spark, monkeypatch):
    rng = random.Random(12)
    vertices = []
    for p in range(60):  # boxes with a hole, triangles, and a few rings that do not close
        x, y, w, h = 139.5 + rng.uniform(0, 0.1), 35.5 + rng.uniform(0, 0.1), rng.uniform(0.01, 0.06), rng.uniform(0.01, 0.06)
        rings = [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], [(x + w / 3, y + h / 3), (x + w / 2, y + h / 3), (x + w / 2, y + h / 2), (x + w / 3, y + h / 3)]]
        rings = [[(x, y), (x + w, y + h / 4), (x, y + h), (x, y)]] if p % 3 == 0 else [rings[0][:4]] if p % 7 == 0 else rings
        vertices += [(p, k, i, a, b) for k, ring in enumerate(rings) for i, (a, b) in enumerate(ring)]
    points = [(i, 35.48 + rng.uniform(0, 0.2), 139.48 + rng.uniform(0, 0.2)) for i in range(1500)]
    points += [points[0], points[1], points[1], (None, *points[2][1:]), (5000, *points[3][1:]), (5001, None, 139.5)]

    boxes = {}
    level = {(p, k, i): b for p, k, i, _, b in vertices}
    slanted = [v for v in vertices if any(level.get((v[0], v[1], v[2] + d), v[4]) != v[4] for d in (-1, 1))]
    for p, _, _, a, b in slanted:
        w, s, e, n = boxes.get(p, (a, b, a, b))
        boxes[p] = min(w, a), min(s, b), max(e, a), max(n, b)

    def inside(lat, lng):
        crossings = {}
        for (p, k, i, x1, y1), (q, m, j, x2, y2) in zip(vertices, vertices[1:]):
            west, south, east, north = boxes[p]
            if not (west <= lng <= east and south <= lat <= north):  # a ring that does not close still has its box
                continue
            if (p, k) == (q, m) and (y1 > lat) != (y2 > lat) and lng < x1 + (x2 - x1) * (lat - y1) / (y2 - y1):
                crossings[p] = crossings.get(p, 0) + 1
        return any(n % 2 for n in crossings.values())

    frames = (
        spark.createDataFrame(points, "point_id int, lat double, lng double"),
        spark.createDataFrame(vertices, "polygon_id int, ring_id int, seq int, lng double, lat double"),
    )
    plain = sorted(spatial.polygon_mask(*frames).collect(), key=str)
    monkeypatch.setattr(spatial, "PLACE_PAIRS", 0)
    touched, asked = spatial._touched, []
    monkeypatch.setattr(spatial, "_touched", lambda pairs, *rest: asked.append(pairs.count()) or touched(pairs, *rest))
    halved = sorted(spatial.polygon_mask(*frames).collect(), key=str)
    assert halved == plain and len(asked) == spatial.HALVINGS
    copies = {row: points.count(row) for row in points}
    assert {tuple(r)[:3]: r.inside for r in halved} == {
        row: row[0] is not None and row[1] is not None and n % 2 == 1 and inside(*row[1:]) for row, n in copies.items()
    }


def test_nearby_best_leaves_out_lower_spots(spark):
    rng = random.Random(3)
    spots = [(r, i, rng.choice([None, 1, 2, 3, 50]), rng.uniform(0, 3000), rng.uniform(0, 3000)) for i in range(400) for r in [i % 2]]
    spots += [(0, 900 + i, None, 9000.0 + i, 9000.0) for i in range(3)]
    cells = [(i % 2, i // 2, rng.uniform(-900, 3900), rng.uniform(-900, 3900)) for i in range(600)]
    cells += [(0, 1000, 9500.0, 9500.0), (0, None, 1500.0, 1500.0), (1, 1001, None, 5.0), cells[0]]

    def best(region, east, north):
        near = [
            (-1 if s is None else s, -math.sqrt((east - e) ** 2 + (north - n) ** 2), i)
            for r, i, s, e, n in spots
            if r == region and (east - e) * (east - e) + (north - n) * (north - n) <= 1e6
        ]
        return (max(near)[2], round(-max(near)[1])) if near else (-1, None)

    out = spatial.nearby_best(
        spark.createDataFrame(cells, "region_id int, cell_index int, east double, north double"),
        spark.createDataFrame(spots, "region_id int, hotspot_index int, detail_score int, east double, north double"),
    )
    got = {(r.region_id, r.cell_index): (r.nearby_best_index, r.nearby_best_distance) for r in out.collect()}
    assert got == {(r, i): best(r, e, n) if None not in (i, e) else (-1, None) for r, i, e, n in cells}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_least" in plan and "explode(_near" not in plan


def test_nearest_cell_ties_and_copies(spark):
    regions = spark.createDataFrame(
        [("b", 1, 100.0, 35.0, 139.0, 36.0, 140.0), ("a", 0, 100.0, 35.0, 139.0, 36.0, 140.0)],
        "region_id string, region_order int, step_m double, south double, west double, north double, east double",
    )
    cells = spark.createDataFrame(
        [("b", 0, 35.5, 139.5), ("a", 7, 35.5, 139.5), ("a", 3, 35.5, 139.5), ("a", 1, 35.9, 139.9)] + [("a", 100 + i, 35.5, 139.5) for i in range(50)],
        "region_id string, cell_index int, lat double, lng double",
    )
    points = spark.createDataFrame([(1, 35.5001, 139.5), (2, 35.7, 139.7), (3, 34.0, 139.5)], "point_id int, lat double, lng double")
    got = {r.point_id: (r.region_id, r.cell_index) for r in spatial.nearest_cell(points, cells, regions).collect()}
    assert got == {1: ("a", 3), 2: (None, None), 3: (None, None)}


def test_town_match_brute(spark):
    rng = random.Random(4)
    towns = list(dict.fromkeys("".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(1, 4))) for _ in range(40)))
    texts = list(dict.fromkeys("".join(rng.choice("甲乙丙丁戊") for _ in range(rng.randint(1, 9))) for _ in range(200)))

    def best(text):
        if text in towns:
            return text
        inside = [t for t in towns if t in text]
        return max(inside, key=lambda t: (len(t), -towns.index(t))) if inside else None

    got = market.town_match(
        spark.createDataFrame([(t,) for t in texts], "text_key string"),
        spark.createDataFrame([(t, i) for i, t in enumerate(towns)], "town_key string, town_order int"),
    )
    assert {r.text_key: r.town_key for r in got.collect()} == {t: best(t) for t in texts if best(t)}


def test_pack_unpack_identity(spark):
    rng = random.Random(8)
    rows = [
        (f"g{i}-1", rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.5, rng.choice(packed.AGGREGATE_STATES[1:]), rng.random() < 0.5,
         rng.choice(packed.RESIDENTIAL_TIERS[1:]), rng.randint(0, 7), rng.randint(0, 7), rng.randint(0, 7), rng.choice(packed.PLATEAU_STATUSES[1:]),
         rng.randint(0, 100) / 100, rng.randint(0, 100) / 100, rng.choice([None, f"HRZ{rng.randint(1, 65535):05d}"]))
        for i in range(200)
    ]
    schema = (
        "cell_id string, robust_candidate boolean, threshold_stable boolean, robust_residential boolean, aggregate_state string, core_zone boolean, "
        "residential_tier string, known_pillars int, favorable_pillars int, caution_pillars int, plateau_status string, share_300m double, share_500m double, zone_id string"
    )
    df = spark.createDataFrame(rows, schema)
    back = packed.unpack_bits(packed.pack_bits(df)).select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows) if all(r[-1] for r in rows) else {tuple(r) for r in back.collect()} == set(rows)


def test_more_knowledge_never_lowers_a_group(spark):
    items = [(p, k, s) for p in range(20) for k, s in (("flood", p), ("tsunami", None), ("slope", 10), ("ground", None))]
    more = items + [(p, "highTide", 7) for p in range(20)]
    schema = "point_id int, item_key string, score int"
    before = {r.point_id: r for r in risk.group_risk(spark.createDataFrame(items, schema)).collect()}
    after = {r.point_id: r for r in risk.group_risk(spark.createDataFrame(more, schema)).collect()}
    assert all((after[p].water_risk or 0) >= (before[p].water_risk or 0) for p in before)
    assert all(before[p].ground_risk is None for p in before)


def test_group_ranks_with_one_hot_group(spark):
    rng = random.Random(6)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, float(rng.randint(0, 30)) / 10, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "municipality string, zone_id int, score double, uncertainty int")
    got = discovery.group_ranks(df, "municipality", "score", "zone_id")
    groups = {}
    for m, z, s, _ in rows:
        groups.setdefault(m, []).append((-s, z))
    wanted = {z: i for g in groups.values() for i, (_, z) in enumerate(sorted(g))}
    assert {r.zone_id: r["rank"] for r in got.collect()} == wanted


def test_dem_mosaic_takes_first_known_source(spark):
    rows = [(0, 0, 1, 1, 2, 0, 0, 100, 255), (0, 0, 1, 1, 1, 0, 0, 50, 0), (0, 0, 1, 1, 3, 0, 0, 9, 255), (0, 0, 2, 2, 1, 128, 0, 0, 255), (0, 0, 3, 3, 1, 255, 255, 255, 255)]
    df = spark.createDataFrame(rows, "x int, y int, px int, py int, priority int, r int, g int, b int, a int")
    got = {r.px: r.elevation for r in lookups.dem_mosaic(df).collect()}
    assert got == {1: pytest.approx(1.0), 3: pytest.approx(-0.01)}


def test_queue_without_a_limit_is_an_error(spark):
    queued = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "queue string, sample_id int")
    assert [r.sample_id for r in discovery.queue_items(queued, limits={"a": 1, "b": 5}).orderBy("sample_id").collect()] == [1, 3]
    assert {(r.sample_id, r.queue_count) for r in discovery.queue_items(queued, limits=None).collect()} == {(1, 2), (2, 2), (3, 1)}
    with pytest.raises(Exception, match="no limit for the queue b"):
        discovery.queue_items(queued, limits={"a": 1}).collect()


def test_axes_and_crossings_run_on_batches(spark, capsys):
    """No expression per axis pair is evaluated row by row; values follow the written rule, unknown ones included."""
    import math
    import random

    from landlens.operators import grid_terrain as gt

    rng = random.Random(4)
    rows = [(i, (300, 1000, 3000)[i % 3], [rng.uniform(-4, 12) for _ in range(32)]) for i in range(60)]
    rows += [(60, 300, [None, *[5.0] * 31]), (61, 300, None), (62, 300, [9.0] * 30), (63, 77, [9.0] * 32), (64, None, [9.0] * 32), (65, 300, [0.0] * 32)]
    terrain = spark.createDataFrame(rows, "site_id long, scale int, samples array<double>")
    axes = gt.line_axes(terrain)
    crossed = gt.axis_crossings(axes)
    crossed.explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 2 and "transform(" not in plan
    assert axes.columns == ["site_id", "scale", "axes"] and crossed.columns == ["site_id", "scale", "high", "low", "ordinary"]

    def side(samples, threshold, sign):
        if threshold is None or samples is None or len(samples) < 4 or None in samples:
            return None
        v = [min(1.0, max(0.0, (sign * x - 0.18 * threshold) / (1.55 * threshold))) for x in samples]
        ends = (v[1] * 0.62 + v[0] * 0.38) * (v[2] * 0.62 + v[3] * 0.38)
        return min(1.0, max(0.0, math.sqrt(ends) * (0.68 + sum(v) / 4.0 * 0.32)))

    limits = {s: t for s, t, _ in gt.SCALES}
    got = {r.site_id: r.axes for r in axes.collect()}
    want = {}
    for i, scale, samples in rows:
        four = [samples and samples[4 * k : 4 * k + 4] for k in range(8)]
        want[i] = [(k, side(x, limits.get(scale), 1), side(x, limits.get(scale), -1)) for k, x in enumerate(four)]
        for x, y in zip(got[i], want[i], strict=True):
            assert tuple(x)[0] == y[0] and all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-12) for a, b in zip(x[1:], y[1:], strict=True))

    def best(pairs, a, b, share):
        first, second = sorted((math.sqrt(a[i] * b[j]) * q for i, j, q in pairs), reverse=True)[:2]
        return 1 - (1 - first) * (1 - second * share)

    same = gt._pair_quality([(i, j) for i in range(8) for j in range(i + 1, 8)])
    cross = gt._pair_quality([(i, j) for i in range(8) for j in range(8)])
    for r in crossed.collect():
        high, low = ([x[k] for x in want[r.site_id]] for k in (1, 2))
        expected = (0, 0, 0) if None in high else (best(same, high, high, 0.45), best(same, low, low, 0.45), best(cross, high, low, 0.35))
        assert all(abs(a - b) < 1e-12 for a, b in zip((r.high, r.low, r.ordinary), expected, strict=True)), r
    kind = "site_id long, axes array<struct<axis: int, high: double, low: double>>"
    odd = [(1, None), (2, [None] + [(k, 0.5, 0.5) for k in range(1, 8)]), (3, [(0, 0.5, 0.5)]), (4, []), (5, [(k, 0.5, None) for k in range(8)])]
    found = {r.site_id: (r.high, r.low, r.ordinary) for r in gt.axis_crossings(spark.createDataFrame(odd, kind)).collect()}
    assert found[1] == found[2] == (0, 0, 0) and found[3] == found[4] == (None, None, None)
    assert found[5][0] is not None and found[5][1:] == (None, None)
