"""Quick overview surface: four axes of opposite neighbours at three scales, smoothed preview, named samples."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.functions.numeric import clamp, half_even, let, union_prob
from landlens.operators import raster as rs
from landlens.operators import windows as win

# Calibration of the overview.
SCALES = ((300, 0.7), (1_000, 1.75), (3_000, 3.5))  # metres, threshold
SCALE_SHARE = 0.72
PREVIEW_SIGMA = 4.2
PREVIEW_GAIN = 1.15


def _steps(distance_px: float) -> tuple[int, int]:
    radius = max(2, round(distance_px))
    return radius, max(1, round(radius / math.sqrt(2.0)))


def _neighbours(distance_px: float) -> list[tuple[int, int]]:
    """Offsets (row, col) of the pixel seen from each target, in opposite pairs: a, b, a, b, ..."""
    r, d = _steps(distance_px)
    return [(r, 0), (-r, 0), (0, r), (0, -r), (d, d), (-d, -d), (d, -d), (-d, d)]


def overview_evidence(dem: DataFrame, mpp: float, scales=SCALES, *, rows=None, cols=None) -> DataFrame:
    """High, low and coverage per pixel and scale as columns ``high_<s>``, ``low_<s>``, ``cov_<s>``.

    The second smoothing pass holds a square of pixels with the margin its neighbours lie in, so each pixel reads them there
    and no pixel is sent to those that look at it. High is how far the centre stands above both ends of an axis;
    the second strongest axis counts, damped where the surroundings are flat.
    """
    surfaces = [
        rs.Surface(f"s_{m}", max(0.8, _steps(m / mpp)[0] * 0.1), 0.45) for m, _ in scales
    ]
    views = {f"v_{m}_{k}": (f"s_{m}", dr, dc) for m, _ in scales for k, (dr, dc) in enumerate([(0, 0), *_neighbours(m / mpp)])}
    reach = max(max(abs(dr), abs(dc)) for _, dr, dc in views.values())

    def compute(window, at_rows, at_cols, extent):
        seen = {name: window.at(layer, at_rows - dr, at_cols - dc) for name, (layer, dr, dc) in views.items()}
        known = ~np.all([np.isnan(v) for v in seen.values()], axis=0)
        return win.as_table(at_rows, at_cols, seen, known)

    schema = "row bigint, col bigint, " + ", ".join(f"{name} double" for name in views)
    seen = rs.smoothed_stencil(dem, surfaces, reach, compute, schema, rows=rows, cols=cols, min_sigma=0.0)
    columns = []
    for m, threshold in scales:
        columns += _crossing(m, threshold)
    return seen.select("row", "col", *columns)


def _crossing(m: int, threshold: float) -> list[Column]:
    v = [F.col(f"v_{m}_{k}") for k in range(9)]
    centre, ends = v[0], [(v[1 + 2 * i], v[2 + 2 * i]) for i in range(4)]
    valid = [centre.isNotNull() & a.isNotNull() & b.isNotNull() for a, b in ends]
    level = lambda ok, x: F.when(ok, clamp(x / F.lit(threshold * 3.0), 0.0, 1.0)).otherwise(0.0)
    highs = [level(ok, F.least(centre - a, centre - b)) for ok, (a, b) in zip(valid, ends)]
    lows = [level(ok, F.least(a - centre, b - centre)) for ok, (a, b) in zip(valid, ends)]

    def second(axes: list[Column]) -> Column:
        return let(F.sort_array(F.array(*axes)), lambda x: F.sqrt(F.get(x, F.lit(3)) * F.get(x, F.lit(2))))

    relief = clamp((F.greatest(*v[1:]) - F.least(*v[1:])) / F.lit(threshold * 8.0), 0.0, 1.0)
    coverage = sum((F.when(ok, 1.0).otherwise(0.0) for ok in valid), F.lit(0.0)) / F.lit(4.0)
    return [
        (second(highs) * relief).alias(f"high_{m}"),
        (second(lows) * relief).alias(f"low_{m}"),
        coverage.alias(f"cov_{m}"),
    ]


def overview_surface(dem: DataFrame, mpp: float, scales=SCALES, **extent) -> DataFrame:
    """Score 0..100 and confidence 0..1 per pixel; NULL where some scale sees no neighbour at all."""
    evidence = overview_evidence(dem, mpp, scales, **extent)
    names = [m for m, _ in scales]
    union = lambda kind: clamp(
        union_prob(F.array(*[F.col(f"{kind}_{m}") * F.lit(SCALE_SHARE) for m in names])), 0.0, 1.0
    )
    high, low = union("high"), union("low")
    n = float(len(names))
    coverage = sum((F.col(f"cov_{m}") for m in names), F.lit(0.0)) / F.lit(n)
    active = sum(
        (F.when(F.greatest(f"high_{m}", f"low_{m}") >= 0.25, 1.0).otherwise(0.0) for m in names), F.lit(0.0)
    ) / F.lit(n)
    known = high.isNotNull() & low.isNotNull()
    return evidence.select(
        "row",
        "col",
        F.when(known, half_even(F.lit(50.0) + (high - low) * 50.0)).alias("score"),
        F.when(known, clamp(coverage * 0.35 + F.greatest(high, low) * 0.4 + active * 0.25, 0.0, 1.0)).alias(
            "confidence"
        ),
    )


def smooth_preview(surface: DataFrame, **extent) -> DataFrame:
    """Smoothed score and confidence over the masked pixels (row, col, score, confidence, masked)."""
    ok = F.col("masked") & F.col("score").isNotNull()
    base = surface.select(
        "row",
        "col",
        F.when(ok, F.col("score") - 50.0).alias("score"),
        F.when(ok, F.coalesce(F.col("confidence"), F.lit(0.0))).alias("confidence"),
    )
    blurred = rs.gaussian_surfaces(
        base,
        [
            rs.Surface("s", PREVIEW_SIGMA, 0.03, source="score"),
            rs.Surface("c", PREVIEW_SIGMA, 0.03, source="confidence"),
        ],
        min_sigma=0.0,
        **extent,
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return blurred.select(
        "row",
        "col",
        clamp(F.lit(50.0) + zero("s") * PREVIEW_GAIN, 0.0, 100.0).alias("score"),
        clamp(zero("c"), 0.0, 1.0).alias("confidence"),
    )


def sample_report(surface: DataFrame, named: DataFrame, zoom: int, origin: tuple[float, float]) -> DataFrame:
    """Score and confidence of the pixel nearest to each named point; points off the surface are left out."""
    r, c = rs.raster_position(F.col("lat"), F.col("lng"), zoom, origin)
    at = named.withColumn("row", half_even(r).cast("bigint")).withColumn("col", half_even(c).cast("bigint"))
    return at.join(surface, ["row", "col"]).select(
        *named.columns,
        half_even(F.col("score")).cast("int").alias("score"),
        half_even(F.col("confidence") * 100.0).cast("int").alias("confidence"),
    )
