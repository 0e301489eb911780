"""Raster surfaces: NaN-aware Gaussian smoothing, relative elevation, bilinear sampling and slope.

A raster is a DataFrame ``row, col, value``; absent rows and NULL values both mean no data. Smoothing runs in two
passes over blocks of bounded size (a band of lines times a segment with its margin), so neither a long raster line
nor a large kernel ever ends up in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.operators import windows as win

#: Kernel cut-off in standard deviations.
TRUNCATE = 4.0
#: Lines handled together by one Python call.
BAND = 64
#: Sites that one smoothed window is made for.
SITES = 4_096


class Surface(NamedTuple):
    """One smoothed output: ``min_weight`` is the share of known input a pixel needs; with ``weight_only`` the
    smoothed share itself is the output."""

    name: str
    sigma: float
    min_weight: float = 0.35
    weight_only: bool = False
    source: str = "value"


def kernel(sigma: float) -> np.ndarray:
    radius = int(TRUNCATE * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return taps / taps.sum()


def _smooth_lines(block: np.ndarray, taps: np.ndarray, margin: int, length: int) -> np.ndarray:
    """Convolve each line of a block whose wanted part starts at ``margin``."""
    radius = len(taps) // 2
    out = np.zeros((block.shape[0], length))
    for k, weight in enumerate(taps):
        start = margin - radius + k
        out += weight * block[:, start : start + length]
    return out


def _pass(df: DataFrame, along: str, across: str, size: str, keys: list[str], pairs: list[tuple[str, str, float]]) -> DataFrame:
    """Smooth columns along one axis of ``size`` pixels. ``pairs``: (input column, output column, sigma).

    ``keys`` (region, extent) are handed on; blocks never reach from one key to another.
    """
    taps = [kernel(sigma) for _, _, sigma in pairs]
    margin = max(len(t) // 2 for t in taps)
    segment = max(512, 4 * margin)
    inputs = sorted({source for source, _, _ in pairs})
    outputs = [name for _, name, _ in pairs]

    def smooth(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part, size_ = int(key[-1]), int(pdf[size].iat[0])
        first = part * segment
        length = min(segment, size_ - first)
        lines = np.unique(pdf[across].to_numpy())
        low = max(0, first - margin)
        width = min(size_, first + length + margin) - low
        at = (np.searchsorted(lines, pdf[across].to_numpy()), pdf[along].to_numpy() - low)
        spread = np.clip(np.arange(first - margin, first + length + margin), 0, size_ - 1) - low
        padded = {}
        for name in inputs:
            block = np.zeros((len(lines), width))
            block[at] = pdf[name].to_numpy()
            padded[name] = block[:, spread]
        data = {
            **dict(zip(keys, key)),
            across: np.repeat(lines, length),
            along: np.tile(np.arange(first, first + length, dtype="int64"), len(lines)),
        }
        for (source, name, _), t in zip(pairs, taps):
            data[name] = _smooth_lines(padded[source], t, margin, length).ravel()
        return pd.DataFrame(data)

    last = F.floor((F.col(size) - 1) / F.lit(segment))
    parts = F.sequence(
        F.greatest(F.lit(0), F.floor((F.col(along) - margin) / F.lit(segment))),
        F.least(last, F.floor((F.col(along) + margin) / F.lit(segment))),
    )
    blocks = df.select(
        *keys,
        F.floor(F.col(across) / F.lit(BAND)).alias("_band"),
        F.explode(parts).alias("_part"),
        across,
        along,
        *inputs,
    )
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"{across} bigint, {along} bigint", *(f"{n} double" for n in outputs)])
    return blocks.groupBy(*keys, "_band", "_part").applyInPandas(smooth, schema)


def extent_of(raster: DataFrame, given: int | Column | None, axis: str) -> Column:
    return raster.agg(F.max(axis) + 1).scalar() if given is None else F.lit(given)


def first_pass(
    raster: DataFrame, surfaces: list[Surface], rows: int | Column | None = None, cols: int | Column | None = None,
    min_sigma: float = 0.6, within: tuple[str, ...] = (),
) -> tuple[DataFrame, list[tuple[str, str, float]]]:
    """First pass: known values and known shares smoothed along the rows, and (input, output, sigma) of each."""
    sources = sorted({s.source for s in surfaces})
    base = raster.select(
        *within,
        extent_of(raster, rows, "row").cast("bigint").alias("_rows"),
        extent_of(raster, cols, "col").cast("bigint").alias("_cols"),
        F.col("row").cast("bigint").alias("row"),
        F.col("col").cast("bigint").alias("col"),
        *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(f"v_{n}") for n in sources],
        *[F.when(F.col(n).isNotNull(), 1.0).otherwise(0.0).alias(f"w_{n}") for n in sources],
    )
    pairs = []
    for s in surfaces:
        sigma = max(min_sigma, s.sigma)
        if not s.weight_only:
            pairs.append((f"v_{s.source}", f"_v_{s.name}", sigma))
        pairs.append((f"w_{s.source}", f"_w_{s.name}", sigma))
    return _pass(base, "col", "row", "_cols", [*within, "_rows", "_cols"], pairs), pairs


def _window(
    table: pa.Table, zone: tuple[int, int], extent: tuple[int, int], reach: int, surfaces: list[Surface], pairs: list
) -> win.Window:
    """Second pass inside one task: the smoothed surfaces of a square and its margin, from rows smoothed by the first."""
    (top, bottom), (left, right) = (win.bounds_of(z, reach, n) for z, n in zip(zone, extent, strict=True))
    shape = max(0, bottom - top), max(0, right - left)
    if 0 in shape:
        return win.Window(0, 0, {s.name: np.zeros((0, 0)) for s in surfaces})
    taps = {name: kernel(sigma) for _, name, sigma in pairs}
    margin = max(len(t) // 2 for t in taps.values())
    first, last = max(0, top - margin), min(extent[0], bottom + margin)
    row, col = win.numbers(table, "row"), win.numbers(table, "col")
    known = (row >= first) & (row < last) & (col >= left) & (col < right)
    place = (row[known].astype(np.int64) - first, col[known].astype(np.int64) - left)

    def smoothed(name: str) -> np.ndarray:
        block = np.zeros((last - first, shape[1]))
        block[place] = win.numbers(table, name)[known]
        radius = len(taps[name]) // 2
        spread = np.clip(np.arange(top - radius, bottom + radius), 0, extent[0] - 1) - first
        block = block[spread]
        out = np.zeros(shape)
        for k, weight in enumerate(taps[name]):
            out += weight * block[k : k + shape[0]]
        return out

    layers = {}
    for s in surfaces:
        weight = smoothed(f"_w_{s.name}")
        if s.weight_only:
            layers[s.name] = weight
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                layers[s.name] = np.where(weight > s.min_weight, smoothed(f"_v_{s.name}") / weight, np.nan)
    return win.Window(top, left, layers)


def smoothed_stencil(
    raster: DataFrame, surfaces: list[Surface], reach: int, compute: Callable, schema: str, *,
    rows: int | Column | None = None, cols: int | Column | None = None, min_sigma: float = 0.6,
) -> DataFrame:
    """``compute(window, rows, cols, extent)`` on every square of the smoothed surfaces, with a margin of ``reach`` pixels.

    The second smoothing pass and the neighbours share one shuffle: no pixel is handed to those that look at it.
    """
    across, pairs = first_pass(raster, surfaces, rows, cols, min_sigma)
    margin = max(len(kernel(sigma)) // 2 for _, _, sigma in pairs)
    sent = across.withColumn("_zr", F.explode(win.zones("row", reach + margin, F.col("_rows"))))
    sent = sent.withColumn("_zc", F.explode(win.zones("col", reach, F.col("_cols"))))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        zone = tuple(k.as_py() for k in key)
        extent = int(table.column("_rows")[0].as_py()), int(table.column("_cols")[0].as_py())
        return compute(_window(table, zone, extent, reach, surfaces, pairs), *win.inner(*zone, extent), extent)

    return win.keyed(sent, "_zr", "_zc").groupBy("_zr", "_zc").applyInArrow(run, schema)


def smoothed_at(
    across: DataFrame, pairs: list, surfaces: list[Surface], places: DataFrame, reach: int, compute: Callable, schema: str
) -> DataFrame:
    """``compute(window, places, extent)`` on the places of every square of the smoothed surfaces.

    ``across`` and ``pairs`` come from the first pass; ``places`` carry r and c (positions on the raster), ``_rows`` and
    ``_cols``. Squares without places are not computed; places without a position see an empty window.
    """
    margin = max(len(kernel(sigma)) // 2 for _, _, sigma in pairs)
    key = ["_zr", "_zc", "_part"]
    dealt = win.dealt_places(places, F.col("r"), F.col("c"), SITES)
    tasks = dealt.select(*[F.col(k).alias(k[1:]) for k in key]).distinct()
    sent = across.select("row", "col", *[name for _, name, _ in pairs])
    sent = sent.withColumn("zr", F.explode(win.zones("row", reach + margin))).withColumn("zc", F.explode(win.zones("col", reach)))
    sent = sent.join(tasks, ["zr", "zc"])

    def run(group: tuple, table: pa.Table, asked: pa.Table) -> pa.Table:
        if len(asked) == 0:
            return compute(win.Window(0, 0, {s.name: np.zeros((0, 0)) for s in surfaces}), asked, (0, 0))
        extent = int(asked.column("_rows")[0].as_py()), int(asked.column("_cols")[0].as_py())
        return compute(_window(table, tuple(k.as_py() for k in group[:2]), extent, reach, surfaces, pairs), asked, extent)

    sent, dealt = win.keyed(sent, "zr", "zc", "part"), win.keyed(dealt, *key)
    return sent.groupBy("zr", "zc", "part").cogroup(dealt.groupBy(*key)).applyInArrow(run, schema)


def gaussian_surfaces(
    raster: DataFrame,
    surfaces: list[Surface],
    *,
    rows: int | Column | None = None,
    cols: int | Column | None = None,
    min_sigma: float = 0.6,
    within: tuple[str, ...] = (),
) -> DataFrame:
    """Smooth a raster with several kernels at once: ``row, col`` and one column per surface.

    Value = smoothed known values / smoothed known share where that share exceeds ``min_weight``. Edges repeat
    the border pixel. All kernels share the two shuffles. ``within`` names columns (a region) that keep rasters apart
    and come out again; they are never NULL. ``rows``/``cols`` give the extent, as numbers or columns that are constant
    within a region; without them it is the largest index in the whole data. Copies of a pixel must be removed beforehand.
    """
    keys = [*within, "_rows", "_cols"]
    across, pairs = first_pass(raster, surfaces, rows, cols, min_sigma, within)
    both = _pass(across, "row", "col", "_rows", keys, [(name, name, sigma) for _, name, sigma in pairs])
    outputs = []
    for s in surfaces:
        weight = F.col(f"_w_{s.name}")
        if s.weight_only:
            outputs.append(weight.alias(s.name))
        else:
            outputs.append(F.when(weight > s.min_weight, F.col(f"_v_{s.name}") / weight).alias(s.name))
    return both.select(*within, "row", "col", *outputs)


def normalized_gaussian(raster: DataFrame, sigma: float, min_weight: float = 0.35, **extent) -> DataFrame:
    """``row, col, value`` of one smoothed surface, pixels with too little known input left out."""
    out = gaussian_surfaces(raster, [Surface("value", sigma, min_weight)], **extent)
    return out.filter(F.col("value").isNotNull())


def tpi_sigmas(scale_m: float, mpp: float) -> tuple[float, float]:
    """Standard deviations in pixels of the inner and outer smoothing of one scale."""
    return max(0.8, scale_m / mpp / 10.0), max(1.2, scale_m / mpp / 2.2)


def tpi_surface(raster: DataFrame, scale_m: float, mpp: float, **extent) -> DataFrame:
    """Relative elevation: fine minus coarse smoothing."""
    inner, outer = tpi_sigmas(scale_m, mpp)
    out = gaussian_surfaces(raster, [Surface("inner", inner), Surface("outer", outer)], **extent)
    return out.select("row", "col", (F.col("inner") - F.col("outer")).alias("value")).filter("value IS NOT NULL")


def bilinear_corners(samples: DataFrame, r: str = "r", c: str = "c") -> DataFrame:
    """Four weighted corner pixels (row, col, w) per sample position."""
    r0, c0 = F.floor(F.col(r)), F.floor(F.col(c))
    fr, fc = F.col(r) - r0, F.col(c) - c0
    corner = lambda dr, dc: F.struct(
        (r0 + dr).alias("row"),
        (c0 + dc).alias("col"),
        ((fr if dr else F.lit(1.0) - fr) * (fc if dc else F.lit(1.0) - fc)).alias("w"),
    )
    corners = F.array(*[corner(dr, dc) for dr in (0, 1) for dc in (0, 1)])
    return samples.withColumn("_k", F.explode(corners)).select("*", "_k.row", "_k.col", "_k.w").drop("_k", r, c)


def bilinear_sample(raster: DataFrame, samples: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Interpolate raster columns at fractional positions ``r, c``; any missing neighbour makes the result NULL.

    ``keys`` identify a sample. Output: keys and one column per value.
    """
    joined = bilinear_corners(samples.select(*keys, "r", "c")).join(
        raster.select("row", "col", *values), ["row", "col"], "left"
    )
    return joined.groupBy(*keys).agg(
        *[
            F.when(F.count(v) == 4, F.sum(F.col("w") * F.col(v))).alias(v)
            for v in values
        ]
    )


def slope_of(window: win.Window, layer: str, rows: np.ndarray, cols: np.ndarray, mpp: float, extent: tuple[int, int]) -> np.ndarray:
    """Slope in degrees at whole pixels: central differences, one-sided at the raster's border, NaN beside missing pixels."""
    middle = window.at(layer, rows, cols)

    def gradient(index: np.ndarray, last: int, dr: int, dc: int) -> np.ndarray:
        before, after = window.at(layer, rows - dr, cols - dc), window.at(layer, rows + dr, cols + dc)
        central = (after - before) / (2.0 * mpp)
        return np.where(index == 0, (after - middle) / mpp, np.where(index == last, (middle - before) / mpp, central))

    return np.degrees(np.arctan(np.hypot(gradient(rows, extent[0] - 1, 1, 0), gradient(cols, extent[1] - 1, 0, 1))))


def gradient_slope(raster: DataFrame, mpp: float, *, rows=None, cols=None) -> DataFrame:
    """Slope in degrees of a raster (row, col, value), pixels beside missing ones left out.

    Squares of pixels with a margin of one pixel are sent once; the neighbours are read inside the task.
    """

    def compute(window: win.Window, at_rows: np.ndarray, at_cols: np.ndarray, extent: tuple[int, int]) -> pa.Table:
        slope = slope_of(window, "value", at_rows, at_cols, mpp, extent)
        return win.as_table(at_rows, at_cols, {"value": slope}, ~np.isnan(slope))

    sizes = {"rows": extent_of(raster, rows, "row"), "cols": extent_of(raster, cols, "col")}
    return win.stencil(raster, 1, compute, "row bigint, col bigint, value double", **sizes)


def raster_position(lat: Column, lng: Column, zoom: int, origin: tuple[int, int]) -> tuple[Column, Column]:
    """Fractional (row, col) inside a mosaic whose first pixel is the global pixel ``origin`` (row, col)."""
    from landlens.functions.geo import world_pixel

    x, y = world_pixel(lat, lng, zoom)
    return y - F.lit(origin[0]), x - F.lit(origin[1])


def mosaic_origin(north: float, west: float, zoom: int) -> tuple[int, int]:
    """Global pixel (row, col) of the first pixel of the tile that holds a north-west corner."""
    size = 2.0**zoom
    x = (west + 180.0) / 360.0 * size
    y = (1.0 - math.asinh(math.tan(math.radians(north))) / math.pi) / 2.0 * size
    return math.floor(y) * 256, math.floor(x) * 256
