"""Terrain scores on the regular grid: eight axes, three scales, scores, confidence and hotspots."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from landlens.functions.geo import METERS_PER_DEGREE, local_offsets, offset_coordinates, pixel_positions, rough_scope
from landlens.functions.labels import CANDIDATE, grid_label_code
from landlens.functions.numeric import clamp, half_even, half_up
from landlens.operators import raster as rs
from landlens.operators import windows as win
from landlens.operators.ranking import ordered_rank
from landlens.session import cut_lineage, discard, spread

# Calibration of the grid builder.
SCALES = ((300, 0.499, 0.45), (1_000, 1.20, 0.35), (3_000, 2.80, 0.20))  # metres, locked threshold, weight
AXES = tuple(22.5 * i for i in range(8))
FACTORS = (-1.5, -0.5, 0.5, 1.5)
MIN_AXIS_ANGLE = 22.0
SLOPE_SIGMA_M = 35.0
STEP_M = 100.0
NEIGHBORHOOD_SIGMA_CELLS = 2.5
SUPPRESSION_M = 350.0
MAX_HOTSPOTS = 60


def make_grid(regions: DataFrame, step_m: float = STEP_M) -> DataFrame:
    """Lattice positions of each region (region_id, extent_m): rows run north to south, columns west to east."""
    n = F.floor(F.col("extent_m") * 2.0 / step_m).cast("int")
    rows = spread(regions.withColumn("grid_row", F.explode(F.sequence(F.lit(0), n))), "region_id", "grid_row")
    return (
        rows.withColumn("grid_col", F.explode(F.sequence(F.lit(0), n)))
        .withColumn("east", F.col("grid_col") * F.lit(step_m) - F.col("extent_m"))
        .withColumn("north", F.col("extent_m") - F.col("grid_row") * F.lit(step_m))
    )


def scale_surfaces(scale: float, mpp: float) -> list[rs.Surface]:
    """The smoothed surfaces of one scale: relative elevation is fine less coarse, and the known share."""
    inner, outer = rs.tpi_sigmas(scale, mpp)
    return [
        rs.Surface(f"inner_{scale}", inner),
        rs.Surface(f"outer_{scale}", outer),
        rs.Surface(f"cov_{scale}", max(1.0, scale / mpp / 4.0), weight_only=True),
    ]


def site_terrain(
    dem: DataFrame,
    sites: DataFrame,
    *,
    centre: tuple[float, float],
    zoom: int,
    origin: tuple[int, int],
    mpp: float,
    rows: int | Column | None = None,
    cols: int | Column | None = None,
    scales=SCALES,
) -> DataFrame:
    """One row per site and scale: ``samples`` (relative elevation at 8 axes x 4 factors, NULL unknown), ``tpi`` and ``cov`` at
    the site, and ``slope`` there with the first scale.

    ``sites``: site_id, east, north (metres from ``centre``, at most two degrees away); ``dem``: row, col, value. The first
    smoothing pass of all scales is written once. Per scale the second pass holds a square of the smoothed raster with the
    margin of the axes and evaluates their constant offsets for the sites of the square there.
    """
    slope_surface = rs.Surface("smooth", max(0.8, SLOPE_SIGMA_M / mpp))
    wanted = {scale: scale_surfaces(scale, mpp) + ([slope_surface] if i == 0 else []) for i, (scale, _, _) in enumerate(scales)}
    across, pairs = rs.first_pass(dem, [x for s in wanted.values() for x in s], rows, cols)
    across = cut_lineage(across)
    at = offset_coordinates(F.col("east"), F.col("north"), centre)
    r, c = rs.raster_position(at.lat, at.lng, zoom, origin)
    extent = [rs.extent_of(dem, rows, "row").cast("bigint").alias("_rows"), rs.extent_of(dem, cols, "col").cast("bigint").alias("_cols")]
    placed = cut_lineage(sites.select("site_id", "east", "north", r.alias("r"), c.alias("c"), *extent))
    kind = sites.schema["site_id"].dataType.simpleString()
    schema = f"site_id {kind}, scale int, samples array<double>, tpi double, cov double, slope double"
    finest = METERS_PER_DEGREE * 360.0 / (256 * 2**zoom) * math.cos(math.radians(min(89.0, abs(centre[0]) + 2.0)))
    out = None
    for scale, surfaces in wanted.items():
        names = {f"_{kind_}_{s.name}" for s in surfaces for kind_ in ("v", "w")}
        part = rs.smoothed_at(
            across, [p for p in pairs if p[1] in names], surfaces, placed, math.ceil(max(FACTORS) * scale / finest) + 2,
            _site_samples(scale, centre, zoom, origin, mpp), schema,
        )
        out = part if out is None else out.union(part)
    return out


def _site_samples(scale: float, centre: tuple[float, float], zoom: int, origin: tuple[int, int], mpp: float):
    """What :func:`site_terrain` reads from the window of a square for its sites."""
    turns = np.array([(f * scale * math.sin(math.radians(a)), f * scale * math.cos(math.radians(a))) for a in AXES for f in FACTORS])
    east_m = METERS_PER_DEGREE * math.cos(math.radians(centre[0]))

    def position(east: np.ndarray, north: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, col = pixel_positions(centre[0] + north / METERS_PER_DEGREE, centre[1] + east / east_m, zoom)
        return row - origin[0], col - origin[1]

    def compute(window: win.Window, asked: pa.Table, extent: tuple[int, int]) -> pa.Table:
        layers = {"tpi": window.layers[f"inner_{scale}"] - window.layers[f"outer_{scale}"], "cov": window.layers[f"cov_{scale}"]}
        if "smooth" in window.layers:
            height, width = window.layers["smooth"].shape
            rows, cols = np.meshgrid(np.arange(height) + window.top, np.arange(width) + window.left, indexing="ij")
            layers["slope"] = rs.slope_of(window, "smooth", rows, cols, mpp, extent)
        seen = win.Window(window.top, window.left, layers)
        east, north = win.numbers(asked, "east"), win.numbers(asked, "north")
        here = position(east, north)
        samples = seen.bilinear("tpi", *position(east[:, None] + turns[:, 0], north[:, None] + turns[:, 1])).ravel()
        unknown = np.full(len(asked), np.nan)
        at_site = {n: seen.bilinear(n, *here) if n in layers else unknown for n in ("tpi", "cov", "slope")}
        ends = np.arange(len(asked) + 1, dtype=np.int32) * len(turns)
        return pa.table(
            {
                "site_id": asked.column("site_id"), "scale": pa.array(np.full(len(asked), scale, np.int32)),
                "samples": pa.ListArray.from_arrays(ends, pa.array(samples, mask=np.isnan(samples))),
                **{n: pa.array(v, mask=np.isnan(v)) for n, v in at_site.items()},
            }
        )

    return compute


def _wide(column: pa.ListArray, values: pa.Array, width: int) -> np.ndarray:
    """Elements of each list (``values``, one after another) as rows of ``width`` numbers; unknown or missing ones are masked."""
    sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.ma.masked_all((len(sizes), width))
    kept = (at < width) & values.is_valid().to_numpy(zero_copy_only=False)
    out[row[kept], at[kept]] = values.to_numpy(zero_copy_only=False)[kept]
    return out


def _share(x: np.ndarray) -> np.ndarray:
    """Limits to 0..1 as :func:`clamp` does, to which NaN is the largest number."""
    return np.where(np.isnan(x), 1.0, np.clip(x, 0.0, 1.0))


def _with_columns(df: DataFrame, used: str, added: str, compute) -> DataFrame:
    """``df`` with column ``used`` replaced by the arrays that ``compute`` makes of a batch, behind the others."""
    kept = [f for f in df.schema.fields if f.name != used]
    schema = StructType([*kept, *StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *compute(batch)], names=schema.names)

    return df.mapInArrow(run, schema)


def line_axes(terrain: DataFrame, scales=SCALES) -> DataFrame:
    """Rows of :func:`site_terrain` with ``axes``: high and low line strength per axis, NULL as soon as one of the four samples
    is unknown."""
    limits = {scale: float(t) for scale, t, _ in scales}

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column("samples")
        samples = _wide(column, column.flatten(), len(AXES) * len(FACTORS))
        limit = np.array([limits.get(x, np.nan) for x in batch.column("scale").to_pylist()])
        known = ~np.ma.getmaskarray(samples).reshape(-1, len(AXES), len(FACTORS)).any(axis=2) & ~np.isnan(limit)[:, None]
        values, threshold = samples.filled(0.0).reshape(-1, len(AXES), len(FACTORS)), limit[:, None, None]

        def strength(sign: int) -> pa.Array:
            v = _share((sign * values - 0.18 * threshold) / (1.55 * threshold))
            back, ahead = v[..., 1] * 0.62 + v[..., 0] * 0.38, v[..., 2] * 0.62 + v[..., 3] * 0.38
            continuity = (v[..., 0] + v[..., 1] + v[..., 2] + v[..., 3]) / 4.0
            along = _share(np.sqrt(back * ahead) * (0.68 + continuity * 0.32))
            return pa.array(along.ravel(), mask=~known.ravel())

        axis = pa.array(np.tile(np.arange(len(AXES), dtype=np.int32), len(batch)))
        each = pa.StructArray.from_arrays([axis, strength(1), strength(-1)], ["axis", "high", "low"])
        return [pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * len(AXES), each)]

    return _with_columns(terrain, "samples", "axes array<struct<axis: int, high: double, low: double>>", compute)


def _pair_quality(pairs: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    out = []
    for i, j in pairs:
        raw = abs(AXES[i] - AXES[j]) % 180.0
        angle = min(raw, 180.0 - raw)
        if angle >= MIN_AXIS_ANGLE:
            out.append((i, j, math.sin(math.radians(angle))))
    return out


def _top_two(strengths: np.ndarray, second_share: float) -> np.ma.MaskedArray:
    """The two strongest of each row blended; unknown without two known ones."""
    ordered = np.sort(strengths.filled(-np.inf), axis=1)
    first, second = ordered[:, -1], ordered[:, -2]
    return np.ma.array(_share(1.0 - (1.0 - first) * (1.0 - second * second_share)), mask=np.isneginf(second))


def axis_crossings(axes: DataFrame) -> DataFrame:
    """High x high, low x low and high x low crossing per site and scale; unknown anywhere counts as 0."""
    n = len(AXES)
    same = _pair_quality([(i, j) for i in range(n) for j in range(i + 1, n)])
    cross = _pair_quality([(i, j) for i in range(n) for j in range(n)])

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column("axes")
        each = column.flatten()
        sides = dict(zip((f.name for f in each.type), each.flatten(), strict=True))
        high, low = (_wide(column, sides[name], n) for name in ("high", "low"))
        row = np.repeat(np.arange(len(batch)), pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
        unknown = np.bincount(row[sides["high"].is_null().to_numpy(zero_copy_only=False)], minlength=len(batch)) > 0
        unknown |= column.is_null().to_numpy(zero_copy_only=False)

        def crossing(table, first, second, share: float) -> pa.Array:
            i, j, q = (np.array(x) for x in zip(*table))
            with np.errstate(invalid="ignore"):
                product = first[:, i].filled(0.0) * second[:, j].filled(0.0)
                strengths = np.ma.array(np.sqrt(product) * q, mask=np.ma.getmaskarray(first)[:, i] | np.ma.getmaskarray(second)[:, j])
            value = _top_two(strengths, share)
            return pa.array(np.where(unknown, 0.0, value.data), mask=~unknown & np.ma.getmaskarray(value))

        return [crossing(same, high, high, 0.45), crossing(same, low, low, 0.45), crossing(cross, high, low, 0.35)]

    return _with_columns(axes, "axes", "high double, low double, ordinary double", compute)


def weight_of(scales=SCALES) -> Column:
    weight = F
    for scale, _, w in scales:
        weight = weight.when(F.col("scale") == scale, w)
    return weight


def combine_scales(crossings: DataFrame, scales=SCALES) -> DataFrame:
    """Per site: weighted mean and peak over scales for the three evidences, with the per-scale values kept as an
    array for the confidence, and the terrain at the site (``tpi_<scale>``, ``cov_<scale>``, ``slope``)."""
    total = sum(w for _, _, w in scales)

    def blend(name: str) -> Column:
        mean = F.sum(weight_of(scales) * F.col(name)) / F.lit(total)
        return clamp(mean * 0.62 + F.max(name) * 0.38, 0.0, 1.0).alias(name)

    at = [F.max(F.when(F.col("scale") == s, F.col(n))).alias(f"{n}_{s}") for n in ("tpi", "cov") for s, _, _ in scales]
    return crossings.groupBy("site_id").agg(
        *[blend(n) for n in ("high", "low", "ordinary")],
        F.collect_list(F.struct("high", "low", "ordinary")).alias("by_scale"),
        *at,
        F.max("slope").alias("slope"),
    )


def _winner(high: Column, low: Column, ordinary: Column) -> Column:
    """0 high, 1 low, 2 ordinary; the first of equals wins."""
    best = F.greatest(high, low, ordinary)
    return F.when(high == best, 0).when(low == best, 1).otherwise(2)


def grid_scores(combined: DataFrame, scales=SCALES) -> DataFrame:
    """Original, auxiliary and detail score, confidence and label per site from :func:`combine_scales`."""
    df = combined
    total = sum(w for _, _, w in scales)
    index, coverage = F.lit(0.0), F.lit(0.0)
    for scale, t, w in scales:
        index = index + F.tanh(F.coalesce(F.col(f"tpi_{scale}"), F.lit(0.0)) / F.lit(1.7 * t)) * F.lit(w)
        coverage = coverage + clamp(F.coalesce(F.col(f"cov_{scale}"), F.lit(0.0)), 0.0, 1.0) * F.lit(w)
    high, low, ordinary = F.col("high"), F.col("low"), F.col("ordinary")
    df = df.withColumn("tpi_index", index / F.lit(total)).withColumn("coverage", coverage / F.lit(total))
    slope = F.coalesce(F.col("slope"), F.lit(30.0))
    slope_score = clamp(
        F.when(slope <= 8.0, F.lit(92.0) - F.abs(slope - 4.0) * 1.2).otherwise(F.lit(92.0) - (slope - 8.0) * 4.0),
        0.0,
        100.0,
    )
    relative = clamp(F.lit(50.0) + F.col("tpi_index") * 45.0, 0.0, 100.0)
    drainage = clamp(F.lit(50.0) + F.col("tpi_index") * 40.0 - low * 18.0, 0.0, 100.0)
    original = half_even(
        clamp(F.lit(50.0) + (high - low) * 50.0 * (F.lit(1.0) - ordinary * 0.38), 0.0, 100.0)
    ).cast("int")
    auxiliary = half_even(relative * 0.48 + drainage * 0.32 + slope_score * 0.20).cast("int")
    df = df.withColumn("original_score", original).withColumn("auxiliary_score", auxiliary)
    strongest = F.greatest(high, low, ordinary)
    main = _winner(high, low, ordinary)
    agreeing = F.size(
        F.filter("by_scale", lambda s: _winner(s["high"], s["low"], s["ordinary"]) == main)
    ) / F.size("by_scale")
    active = F.size(
        F.filter("by_scale", lambda s: F.greatest(s["high"], s["low"], s["ordinary"]) >= 0.12)
    ) / F.size("by_scale")
    share = clamp(F.col("coverage") * 0.38 + strongest * 0.34 + agreeing * 0.18 + active * 0.10, 0.0, 1.0)
    return df.select(
        "site_id",
        "high",
        "low",
        "ordinary",
        grid_label_code(high, low, ordinary).alias("label_code"),
        "original_score",
        half_even(strongest * 100.0).cast("int").alias("original_fit"),
        "auxiliary_score",
        half_even(F.col("original_score") * 0.8 + F.col("auxiliary_score") * 0.2).cast("int").alias("detail_score"),
        half_even(share * 100.0).cast("int").alias("confidence"),
    )


def score_sites(dem: DataFrame, sites: DataFrame, *, scales=SCALES, **place) -> DataFrame:
    """Whole grid scoring for sites (site_id, east, north) over one elevation raster (row, col, value).

    ``place``: centre, zoom, origin, mpp, rows and cols as in :func:`site_terrain`; ``rows`` and ``cols`` are the extent of
    the raster: missing pixels inside it count as unknown, wherever they lie.
    """
    terrain = site_terrain(dem, sites, scales=scales, **place)
    return grid_scores(combine_scales(axis_crossings(line_axes(terrain, scales)), scales), scales)


def neighborhood_score(cells: DataFrame, *, rows: int | Column, cols: int | Column) -> DataFrame:
    """Smoothed detail score of the cells around each cell within its region (grid_row, grid_col, detail_score), 0..100.

    ``rows`` and ``cols`` are the lattice's whole extent, numbers or columns of ``cells`` that are constant within a
    region: lattice positions without a cell are unknown.
    """
    raster = cells.select(
        "region_id", F.lit(rows).alias("_r"), F.lit(cols).alias("_c"),
        F.col("grid_row").alias("row"), F.col("grid_col").alias("col"), F.col("detail_score").cast("double").alias("value"),
    )
    smooth = rs.normalized_gaussian(
        raster, NEIGHBORHOOD_SIGMA_CELLS, 0.02, rows=F.col("_r"), cols=F.col("_c"), within=("region_id",)
    )
    values = smooth.select(
        "region_id",
        F.col("row").alias("grid_row"),
        F.col("col").alias("grid_col"),
        half_even(F.col("value")).cast("int").alias("neighborhood_score"),
    )
    return cells.join(values, ["region_id", "grid_row", "grid_col"], "left")


def local_maxima(cells: DataFrame, min_confidence: int = 48) -> DataFrame:
    """Candidate cells that no candidate within two rows and columns beats (equals count as maxima).

    Only candidates take part: each is handed to the 25 positions it can beat and positions are reduced by ``max``
    before the shuffle.
    """
    candidates = cells.filter((F.col("label_code") == CANDIDATE) & (F.col("confidence") >= min_confidence))
    shifts = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)]
    )
    reach = (
        candidates.select("region_id", "grid_row", "grid_col", "detail_score", F.explode(shifts).alias("s"))
        .groupBy(
            "region_id",
            (F.col("grid_row") + F.col("s.i")).alias("grid_row"),
            (F.col("grid_col") + F.col("s.j")).alias("grid_col"),
        )
        .agg(F.max("detail_score").alias("_best"))
    )
    joined = candidates.join(reach, ["region_id", "grid_row", "grid_col"])
    return joined.filter(F.col("detail_score") == F.col("_best")).drop("_best")


def suppress(
    candidates: DataFrame, radius_m: float = SUPPRESSION_M, keep: int | None = MAX_HOTSPOTS, step_m: float = STEP_M
) -> DataFrame:
    """Greedy non-maximum suppression on the lattice, best score first, at most ``keep`` per region (None: all).

    The order is total: score, then row, then column, all descending (equal scores need a rule). A kept cell removes
    at most the lattice positions within the radius, so the first ``keep`` survivors lie among the first
    keep x positions candidates of their region: only those are gathered, a number that the parameters bound, and are
    walked through in order. With ``keep=None`` rounds settle all candidates, see :func:`suppress_all`.
    Output: region_id, grid_row, grid_col, detail_score and ``hotspot_index`` from 0 in that order.
    """
    near = _within(radius_m, step_m)
    place = ["region_id", "grid_row", "grid_col"]
    distinct = candidates.groupBy(*place).agg(F.max("detail_score").alias("detail_score"))
    order = Window.partitionBy("region_id").orderBy(F.desc("detail_score"), F.desc("grid_row"), F.desc("grid_col"))
    if keep is None:
        ranked = ordered_rank(suppress_all(distinct, near), ["region_id"], [F.desc("detail_score"), F.desc("grid_row"), F.desc("grid_col")], "_rank")
        return ranked.withColumn("hotspot_index", F.col("_rank") - 1).drop("_rank")
    first = distinct.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep * len(near)).drop("_n")
    cell = F.struct("detail_score", "grid_row", "grid_col")
    ranked = first.groupBy("region_id").agg(F.sort_array(F.collect_list(cell), asc=False).alias("_all"))

    def close(a: Column, b: Column) -> Column:
        down, right = a["grid_row"] - b["grid_row"], a["grid_col"] - b["grid_col"]
        return F.sqrt((down * down + right * right).cast("double")) * step_m < radius_m

    def walk(kept: Column, x: Column) -> Column:
        free = (F.size(kept) < keep) & ~F.exists(kept, lambda k: close(k, x))
        return F.when(free, F.concat(kept, F.array(x))).otherwise(kept)

    kind = ranked.schema["_all"].dataType
    chosen = ranked.select("region_id", F.posexplode(F.aggregate("_all", F.array().cast(kind), walk)).alias("hotspot_index", "_c"))
    return chosen.select("region_id", "_c.grid_row", "_c.grid_col", "_c.detail_score", "hotspot_index")


def _within(radius_m: float, step_m: float) -> list[tuple[int, int]]:
    """Lattice offsets nearer than the radius, the cell itself included."""
    reach = int(math.ceil(radius_m / step_m))
    steps = range(-reach, reach + 1)
    return [(i, j) for i in steps for j in steps if math.hypot(i, j) * step_m < radius_m]


#: Lattice cells per side of the squares in which suppression without a limit is settled.
SQUARE = 256


def suppress_all(candidates: DataFrame, near: list[tuple[int, int]], square: int = SQUARE) -> DataFrame:
    """All survivors of the greedy suppression, settled square by square.

    A task holds a square with the margin that the radius reaches and walks through its candidates in order: one with a kept
    cell near is dropped, one whose better neighbours are all dropped is kept, and one that still has an undecided better
    neighbour waits. Only chains of ever worse neighbours that cross squares wait, for the next round: rounds grow with the
    squares along such a chain, not with its cells. Each round is written.
    """
    reach = max(max(abs(i), abs(j)) for i, j in near)
    disk = np.zeros((2 * reach + 1, 2 * reach + 1), bool)
    for i, j in near:
        disk[i + reach, j + reach] = True
    kind = candidates.schema["region_id"].dataType.simpleString()
    score_kind = candidates.schema["detail_score"].dataType.simpleString()
    zone = lambda c, move: F.floor((F.col(c) + move) / square).cast("int")
    around = lambda c: F.sequence(zone(c, -reach), zone(c, reach))

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        zone_row, zone_col = (k.as_py() for k in key[1:])
        row, col = (win.numbers(table, c).astype(np.int64) for c in ("grid_row", "grid_col"))
        score, kept = win.numbers(table, "detail_score"), win.numbers(table, "kept").astype(bool)
        top, left = zone_row * square - 2 * reach, zone_col * square - 2 * reach
        side = square + 4 * reach
        order = np.lexsort((-col, -row, -score))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rank = np.full((side, side), len(order), np.int64)
        state = np.zeros((side, side), np.int8)  # 0 none or dropped, 1 undecided, 2 kept
        r, c = row - top, col - left
        rank[r, c], state[r, c] = place, np.where(kept, 2, 1)
        own = (row // square == zone_row) & (col // square == zone_col)
        for k in order[(own & ~kept)[order]]:
            around_k = (slice(r[k] - reach, r[k] + reach + 1), slice(c[k] - reach, c[k] + reach + 1))
            better = state[around_k][disk & (rank[around_k] < place[k])]
            if (better == 2).any():
                state[r[k], c[k]] = 0
            elif not (better == 1).any():
                state[r[k], c[k]] = 2
        found = state[r, c]
        left_over = np.flatnonzero(own & (found > 0))
        return table.select(["region_id", "grid_row", "grid_col", "detail_score"]).take(left_over).append_column(
            "kept", pa.array(found[left_over] == 2)
        )

    schema = f"region_id {kind}, grid_row int, grid_col int, detail_score {score_kind}, kept boolean"
    place = ["region_id", F.col("grid_row").cast("int").alias("grid_row"), F.col("grid_col").cast("int").alias("grid_col"), "detail_score"]
    state = cut_lineage(candidates.select(*place, F.lit(False).alias("kept")))
    while not state.filter(~F.col("kept")).isEmpty():
        sent = state.withColumn("_zr", F.explode(around("grid_row"))).withColumn("_zc", F.explode(around("grid_col")))
        before, state = state, cut_lineage(sent.groupBy("region_id", "_zr", "_zc").applyInArrow(settle, schema))
        discard(before)
    return state.drop("kept")


def viewport_grid(views: DataFrame, columns: Column, rows: Column) -> DataFrame:
    """Equal cells of each viewport (west, south, east, north) with their centres, those in rough scope only.

    Asked-for counts are limited to 2..5 columns and 2..4 rows; 0 means the default 4 by 3. The result feeds the
    diagnosis as points.
    """
    whole = lambda v, default, top: half_up(
        clamp(F.coalesce(F.nullif(v.cast("double"), F.lit(0.0)), F.lit(float(default))), 2.0, float(top))
    ).cast("int")
    sized = views.withColumn("_nc", whole(columns, 4, 5)).withColumn("_nr", whole(rows, 3, 4))
    cells = sized.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("_nc") * F.col("_nr") - 1)))
    width = (F.col("east") - F.col("west")) / F.col("_nc")
    height = (F.col("north") - F.col("south")) / F.col("_nr")
    left = F.col("west") + F.pmod("cell", "_nc") * width
    bottom = F.col("south") + F.floor(F.col("cell") / F.col("_nc")) * height
    out = cells.select(
        *[c for c in views.columns if c not in {"west", "south", "east", "north"}],
        "cell",
        (bottom + height / 2.0).alias("lat"),
        (left + width / 2.0).alias("lng"),
        left.alias("cell_west"),
        bottom.alias("cell_south"),
        (left + width).alias("cell_east"),
        (bottom + height).alias("cell_north"),
    )
    return out.filter(rough_scope(F.col("lat"), F.col("lng")))


def cell_bounds(cells: DataFrame, centre: tuple[float, float], step_m: float = STEP_M) -> DataFrame:
    """South, west, north, east of each cell around its local (east, north) position, 6 decimals."""
    half = F.lit(step_m / 2.0)
    low = offset_coordinates(F.col("east") - half, F.col("north") - half, centre)
    high = offset_coordinates(F.col("east") + half, F.col("north") + half, centre)
    six = lambda v: half_even(v, 6)
    return cells.select(
        "*",
        six(low.lat).alias("south"),
        six(low.lng).alias("west"),
        six(high.lat).alias("north_edge"),
        six(high.lng).alias("east_edge"),
    )


def run_report(cells: DataFrame) -> DataFrame:
    """Cells per label with the range of each score."""
    ranges = (("original_score", "original"), ("detail_score", "detail"), ("confidence", "confidence"))
    return cells.groupBy("label_code").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(c).alias(f"{name}_{end}") for c, name in ranges for f, end in ((F.min, "min"), (F.max, "max"))],
    )


def with_local_offsets(df: DataFrame, centre: tuple[float, float]) -> DataFrame:
    east, north = local_offsets(F.col("lat"), F.col("lng"), centre)
    return df.withColumn("east", east).withColumn("north", north)
