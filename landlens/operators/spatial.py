"""Nearest and range joins, polygon tests and nearest-of-a-short-list.

All distance joins work on square buckets whose side is at least the search radius, so every partner lies in the
3 x 3 neighbourhood. The side that does not grow per bucket (lattice cells, hotspots) is copied to its nine
buckets and kept as one array per bucket; the other side is shuffled as it is, and candidates are only unfolded inside
the task that compares them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.functions.geo import METERS_PER_DEGREE, planar_distance
from landlens.functions.numeric import half_even
from landlens.session import cut_lineage, discard, lookup_join, widen

#: Latitude up to which bucket widths are exact; the cosine floor of the distance makes 0.2 always safe.
MAX_LATITUDE = 78.0


def bucket_columns(lat: Column, lng: Column, radius_m: float, max_lat: float) -> tuple[Column, Column]:
    """Bucket (row, col) of a point. ``max_lat`` bounds |lat| of the data; smaller values give tighter buckets."""
    import math

    lat_side = radius_m / METERS_PER_DEGREE
    lng_side = radius_m / (METERS_PER_DEGREE * max(0.2, math.cos(math.radians(min(max_lat, 90.0)))))
    return F.floor(lat / F.lit(lat_side)).cast("bigint"), F.floor(lng / F.lit(lng_side)).cast("bigint")


def with_neighbours(df: DataFrame, row: str, col: str) -> DataFrame:
    """Copy each row to the nine buckets around it."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return (
        df.withColumn("_s", F.explode(steps))
        .withColumn(row, F.col(row) + F.col("_s.i"))
        .withColumn(col, F.col(col) + F.col("_s.j"))
        .drop("_s")
    )


def nearest_cell(
    points: DataFrame,
    cells: DataFrame,
    regions: DataFrame,
    *,
    point_key: str = "point_id",
    max_step_m: float = 100.0,
    max_lat: float = MAX_LATITUDE,
) -> DataFrame:
    """Each point's nearest cell among the regions whose box holds the point, if within that region's step.

    ``regions`` carries region_id, region_order, step_m and the box. Ties go to the first region, then the first
    cell, so copies of a cell are first reduced to their lowest index. ``max_step_m`` must be at least every step.
    Per bucket only a lattice-bounded handful of distinct cells exists, so they are kept as one array per bucket:
    points meet at most one row and need no second shuffle.
    Points without a hit stay, with NULL cell columns.
    """
    boxes = regions.select(
        "region_id", "region_order", "step_m", *[F.col(c).alias(f"_{c}") for c in ("south", "west", "north", "east")]
    )
    entry = F.struct(
        F.col("lat"), F.col("lng"), F.col("region_id"), F.col("region_order"), F.col("cell_index"), F.col("step_m"),
        F.col("_south"), F.col("_west"), F.col("_north"), F.col("_east"),
    )
    row, col = bucket_columns(F.col("lat"), F.col("lng"), max_step_m, max_lat)
    distinct = cells.groupBy("region_id", "lat", "lng").agg(F.min("cell_index").alias("cell_index"))
    by_bucket = (
        with_neighbours(distinct.join(boxes, "region_id").withColumn("_br", row).withColumn("_bc", col), "_br", "_bc")
        .groupBy("_br", "_bc")
        .agg(F.collect_list(entry).alias("_near"))
    )
    placed = widen(points).withColumn("_br", row).withColumn("_bc", col)
    joined = lookup_join(placed, by_bucket, ["_br", "_bc"]).drop("_br", "_bc")
    lat, lng = F.col("lat"), F.col("lng")
    inside = F.filter(
        F.col("_near"), lambda c: lat.between(c["_south"], c["_north"]) & lng.between(c["_west"], c["_east"])
    )
    ranked = F.transform(
        inside,
        lambda c: F.struct(
            planar_distance(lat, lng, c["lat"], c["lng"]).alias("distance_m"),
            c["region_order"].alias("region_order"),
            c["cell_index"].alias("cell_index"),
            c["region_id"].alias("region_id"),
            c["step_m"].alias("step_m"),
        ),
    )
    best = joined.withColumn("_best", F.array_min(ranked)).drop("_near")
    hit = F.col("_best.distance_m") <= F.col("_best.step_m")
    return best.select(
        *points.columns,
        F.when(hit, F.col("_best.region_id")).alias("region_id"),
        F.when(hit, F.col("_best.cell_index")).alias("cell_index"),
        F.when(hit, F.col("_best.distance_m")).alias("distance_m"),
    )


def nearby_best(
    cells: DataFrame, hotspots: DataFrame, radius_m: float = 1000.0, key: tuple[str, ...] = ("region_id", "cell_index")
) -> DataFrame:
    """Per cell the best hotspot of its region within a radius: highest score, then nearest, then highest index.

    Both sides carry region_id and local metres ``east``/``north``; ``key`` identifies a cell. Cells with no hotspot get
    index -1 and a NULL distance. Copies at one place are reduced to their best first and hotspots are spaced apart, so
    a bucket's array stays small whatever the number of cells. Spots that are below one in reach of the
    whole bucket are left out of it. A cell's candidates, sorted by score, are compared within its row: only its best one is
    shuffled.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(radius_m)).cast("bigint")
    distinct = (
        hotspots.groupBy("region_id", "east", "north")
        .agg(F.max(F.struct("detail_score", "hotspot_index")).alias("_top"))
        .select("region_id", "east", "north", "_top.*")
    )
    spots = with_neighbours(
        distinct.withColumn("_br", bucket("north")).withColumn("_bc", bucket("east")), "_br", "_bc"
    )
    by_bucket = spots.groupBy("region_id", "_br", "_bc").agg(
        F.sort_array(F.collect_list(F.struct("detail_score", "hotspot_index", "east", "north")), asc=False).alias("_near")
    )
    # a spot in reach of the bucket's farthest corner is in reach of all its cells: they need no lower score
    far = lambda v, b: F.greatest(v - F.col(b) * radius_m, (F.col(b) + 1) * radius_m - v)
    from_corner = lambda h: far(h["east"], "_bc") * far(h["east"], "_bc") + far(h["north"], "_br") * far(h["north"], "_br")
    everywhere = F.filter("_near", lambda h: from_corner(h) <= radius_m * radius_m * (1 - 1e-9))
    by_bucket = by_bucket.withColumn("_least", F.get(everywhere, F.lit(0))["detail_score"])
    by_bucket = by_bucket.withColumn("_near", F.filter("_near", lambda h: F.col("_least").isNull() | (h["detail_score"] >= F.col("_least")))).drop("_least")
    placed = widen(cells.select(*{*key, "region_id", "east", "north"}))
    placed = placed.withColumn("_br", bucket("north")).withColumn("_bc", bucket("east"))
    joined = lookup_join(placed, by_bucket, ["region_id", "_br", "_bc"])
    away = lambda h: (F.col("east") - h["east"]) * (F.col("east") - h["east"]) + (F.col("north") - h["north"]) * (F.col("north") - h["north"])
    rank = lambda h: F.struct(
        h["detail_score"].alias("detail_score"), (-F.sqrt(away(h))).alias("closeness"), h["hotspot_index"].alias("hotspot_index")
    )
    inside = joined.select(*{*key, "east", "north"}, F.filter("_near", lambda h: away(h) <= radius_m * radius_m).alias("_inside"))
    top = F.get("_inside", F.lit(0))["detail_score"]
    first = F.array_max(F.transform(F.filter("_inside", lambda h: h["detail_score"].eqNullSafe(top)), rank))
    best = inside.select(*key, first.alias("_best")).groupBy(*key).agg(F.max("_best").alias("_best"))
    return lookup_join(cells, best, list(key)).select(
        *cells.columns,
        F.coalesce(F.col("_best.hotspot_index"), F.lit(-1)).alias("nearby_best_index"),
        half_even(-F.col("_best.closeness")).cast("int").alias("nearby_best_distance"),
    )


def nearest_station(points: DataFrame, stations: list[tuple[str, float, float]]) -> DataFrame:
    """Nearest of a short fixed list (name, lat, lng); ties by name, distance rounded half to even.

    The list becomes one expression per station: no join and no shuffle. Tables of stations go through
    :func:`nearest_cell` instead.
    """
    options = F.array(
        *[
            F.struct(
                planar_distance(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng), cos_floor=False).alias("d"),
                F.lit(name).alias("name"),
            )
            for name, lat, lng in stations
        ]
    )
    return (
        points.withColumn("_near", F.array_min(options))
        .withColumn("nearest_station", F.col("_near.name"))
        .withColumn("station_distance", half_even(F.col("_near.d")).cast("int"))
        .drop("_near")
    )


#: Edges that a band of a polygon holds on average at most, and edges of one array.
BAND_EDGES = 64
CHUNK_EDGES = 512
#: Pairs of a place and a polygon, for each place, up to which cells stay as they are; how often cells are halved otherwise.
PLACE_PAIRS = 16
HALVINGS = 6
#: Degrees by which a cell is widened before an edge is said to miss it; coordinates up to which rounding stays far below.
CELL_MARGIN = 1e-9
COORDINATES = 1e4


def polygon_mask(
    points: DataFrame,
    vertices: DataFrame,
    *,
    point_key: str = "point_id",
    cell_deg: float = 0.02,
) -> DataFrame:
    """Points with ``inside``: even-odd rule per polygon (closed rings; holes are inner rings), any polygon counts.

    A polygon is cut into as many bands of latitude as its number of edges asks for, so a coast of a million vertices has
    thousands of thin bands and a square has one. A band's edges form arrays of bounded size; where a band holds more,
    its arrays are rows of their own, whose crossings add up. Points meet the polygons whose box holds them through
    square cells, and then the arrays of their band only: a ray to the east meets edges of no other band.

    Where many polygons lie over each other, the cells that hold points are halved first, step by step. A cell that no edge of a
    polygon touches is inside or outside as a whole: if inside, its points are settled, if outside, they never meet the
    polygon. So points are compared one by one only with polygons whose outline passes by.
    """
    from pyspark.sql import Window

    ring = Window.partitionBy("polygon_id", "ring_id").orderBy("seq")
    edges = (
        vertices.withColumn("x2", F.lead("lng").over(ring))
        .withColumn("y2", F.lead("lat").over(ring))
        .filter(F.col("x2").isNotNull() & F.col("y2").isNotNull())
        .select("polygon_id", F.col("lng").alias("x1"), F.col("lat").alias("y1"), "x2", "y2")
    )
    slanted = lambda c: F.when(F.col("y1") != F.col("y2"), c)
    ends = lambda f, g, c: f(slanted(g(f"{c}1", f"{c}2")))
    # every corner begins as many edges as it ends: then the inside changes nowhere but at edges
    corners = [F.bit_xor(F.xxhash64(x, y)) for x, y in (("x1", "y1"), ("x2", "y2"))]
    sound = F.coalesce(F.greatest(*[F.abs(c) for c in ("x1", "y1", "x2", "y2")]) < COORDINATES, F.lit(False))
    known = F.col("x1").isNotNull() & F.col("y1").isNotNull()
    boxes = edges.groupBy("polygon_id").agg(
        ends(F.min, F.least, "x").alias("_west"), ends(F.max, F.greatest, "x").alias("_east"),
        ends(F.min, F.least, "y").alias("_south"), ends(F.max, F.greatest, "y").alias("_north"),
        F.ceil(F.count(slanted(F.lit(1))) / BAND_EDGES).cast("bigint").alias("_bands"),
        ((corners[0] == corners[1]) & F.bool_and(sound & known)).alias("_closed"),
    )
    boxes = cut_lineage(boxes.filter("_bands > 0"))

    def band(y: Column) -> Column:
        """Rises with the latitude, so an edge is in the bands from that of its lower to that of its upper end."""
        at = F.floor((y - F.col("_south")) / (F.col("_north") - F.col("_south")) * F.col("_bands"))
        return F.greatest(F.lit(0), F.least(F.col("_bands") - 1, at))

    filed = edges.filter(F.col("y1").isNotNull()).join(boxes, "polygon_id").select(
        "polygon_id", "x1", "y1", "x2", "y2", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))).alias("_band")
    )
    held = filed.groupBy("polygon_id", "_band").agg(F.ceil(F.count(F.lit(1)) / CHUNK_EDGES).alias("_chunks"))
    chunk = F.pmod(F.xxhash64("x1", "y1", "x2", "y2"), F.col("_chunks"))
    arrays = cut_lineage(
        filed.join(held, ["polygon_id", "_band"])
        .groupBy("polygon_id", "_band", chunk.alias("_chunk"))
        .agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"))
    )
    py, px = F.col("lat"), F.col("lng")

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > py) != (e["y2"] > py)
        at = e["x1"] + F.try_divide((e["x2"] - e["x1"]) * (py - e["y1"]), e["y2"] - e["y1"])
        return spans & (px < at)

    place = ["lat", "lng"]
    cell = ["_r", "_c"]
    index = lambda v, side: F.floor(v / F.lit(side)).cast("bigint")
    at_side = lambda frame, side: frame.withColumns({"_r": index(py, side), "_c": index(px, side)})
    side = cell_deg
    squares = boxes.withColumn("_r", F.explode(F.sequence(index(F.col("_south"), side), index(F.col("_north"), side))))
    squares = squares.withColumn("_c", F.explode(F.sequence(index(F.col("_west"), side), index(F.col("_east"), side))))
    places = cut_lineage(points.filter(F.col(point_key).isNotNull()).select(*place).distinct())
    pairs = cut_lineage(squares.join(at_side(places, side).select(*cell).distinct(), cell, "left_semi"))
    settled = []
    for _ in range(HALVINGS):
        counts = at_side(places, side).groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
        met = pairs.groupBy(*cell).agg(F.count(F.lit(1)).alias("_m")).join(counts, cell).agg(F.sum(F.col("_m") * F.col("_n"))).first()[0]
        if (met or 0) <= PLACE_PAIRS * places.count():
            break
        side /= 2
        smaller = at_side(places, side).select(*cell).distinct().withColumns({f"_up{x}": F.shiftright(x, 1) for x in cell})
        inner = _touched(smaller.join(pairs.withColumnsRenamed({x: f"_up{x}" for x in cell}), [f"_up{x}" for x in cell]), arrays, side, band, crosses)
        judged = cut_lineage(inner)
        covered = judged.filter("_closed AND NOT _touched AND _odd").select(*cell).distinct()
        here = at_side(places, side)
        settled.append(cut_lineage(here.join(covered, cell, "left_semi").select(*place)))
        left = judged.filter("_touched OR NOT _closed").join(covered, cell, "left_anti")
        before, gone = places, pairs
        places = cut_lineage(here.join(covered, cell, "left_anti").select(*place))
        pairs = cut_lineage(left.select(*cell, "polygon_id").join(boxes, "polygon_id"))
        discard(before, gone, judged)
    near = at_side(places, side).join(pairs, cell).filter(py.between(F.col("_south"), F.col("_north")) & px.between(F.col("_west"), F.col("_east")))
    met = near.select(*place, "polygon_id", band(py).alias("_band")).join(arrays, ["polygon_id", "_band"])
    crossings = met.select(*place, "polygon_id", F.size(F.filter("_edges", crosses)).alias("_n"))
    odd = crossings.groupBy(*place, "polygon_id").agg((F.sum("_n") % 2).alias("_odd"))
    inside = odd.groupBy(*place).agg((F.max("_odd") == 1).alias("inside"))
    for more in settled:
        inside = inside.union(more.withColumn("inside", F.lit(True)))
    # crossings of a row that occurs an even number of times add up to an even number
    named = points.groupBy(point_key, *place).agg(F.count(F.lit(1)).alias("_n")).filter("_n % 2 = 1").drop("_n").join(inside, place)
    found = lookup_join(points, named, [point_key, *place]).withColumn("inside", F.coalesce("inside", F.lit(False)))
    return found.select(*points.columns, "inside")


def _touched(
    pairs: DataFrame, arrays: DataFrame, side: float, band: Callable[[Column], Column], crosses: Callable[[Column], Column]
) -> DataFrame:
    """Pairs of a cell (_r, _c) and a polygon with the polygon's box: whether an edge touches the cell, whether its centre is inside.

    Boxes that miss the cell drop their pairs. A cell meets the arrays of all bands that it reaches into; crossings are counted
    in the band of its centre.
    """
    half = side / 2 + CELL_MARGIN
    lat, lng = ((F.col(x) + 0.5) * side for x in ("_r", "_c"))
    cells = pairs.withColumns({"lat": lat, "lng": lng}).filter(
        F.col("lat").between(F.col("_south") - half, F.col("_north") + half) & F.col("lng").between(F.col("_west") - half, F.col("_east") + half)
    )

    def touches(e: Column) -> Column:
        """The edge's box meets the cell and the corners of the cell are not all on one side of its line."""
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        boxes = (
            (F.abs(F.col("lng") * 2 - e["x1"] - e["x2"]) <= F.abs(dx) + 2 * half) & (F.abs(F.col("lat") * 2 - e["y1"] - e["y2"]) <= F.abs(dy) + 2 * half)
        )
        return boxes & (F.abs((F.col("lng") - e["x1"]) * dy - (F.col("lat") - e["y1"]) * dx) <= half * (F.abs(dx) + F.abs(dy)))

    reach = F.explode(F.sequence(band(F.col("lat") - half), band(F.col("lat") + half)))
    rows = cells.select("_r", "_c", "lat", "lng", "polygon_id", "_closed", band(F.col("lat")).alias("_home"), reach.alias("_band"))
    met = rows.join(arrays, ["polygon_id", "_band"], "left")
    crossed = F.when(F.col("_band") == F.col("_home"), F.size(F.filter("_edges", crosses))).otherwise(0)
    return (
        met.select("_r", "_c", "polygon_id", "_closed", F.coalesce(F.exists("_edges", touches), F.lit(False)).alias("_t"), crossed.alias("_n"))
        .groupBy("_r", "_c", "polygon_id", "_closed")
        .agg(F.max("_t").alias("_touched"), (F.sum(F.coalesce("_n", F.lit(0))) % 2 == 1).alias("_odd"))
    )
