"""Raster windows inside tasks: a task holds a square of pixels with the margin its work reaches into.

Neighbours, rings and axes around a place are read from the window, so no row per sample or per neighbour is ever made.
Squares are ``ZONE`` pixels wide; only those that hold places (or pixels, for stencils) become tasks, and a square with very
many places is dealt over several tasks, each with the window of its own places.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.session import cut_lineage, parallelism

#: Pixels per side of a stored block and of a task's square, and places that one window is made for.
BLOCK = 64
ZONE = 256
PLACES = 512
NOWHERE = -(1 << 31)


class Window(NamedTuple):
    """Layers of pixels from global row ``top`` and column ``left`` on; NaN is unknown or outside the raster."""

    top: int
    left: int
    layers: dict[str, np.ndarray]

    def at(self, layer: str, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Values of whole pixels."""
        pixels = self.layers[layer]
        r, c = rows - self.top, cols - self.left
        inside = (r >= 0) & (r < pixels.shape[0]) & (c >= 0) & (c < pixels.shape[1])
        out = np.full(np.shape(r), np.nan)
        out[inside] = pixels[r[inside], c[inside]]
        return out

    def bilinear(self, layer: str, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Values between pixels; NaN as soon as one of the four corners is unknown, whatever its weight."""
        r0, c0 = np.floor(r), np.floor(c)
        fr, fc = r - r0, c - c0
        r0, c0 = r0.astype(np.int64), c0.astype(np.int64)
        corner = lambda dr, dc: (fr if dr else 1.0 - fr) * (fc if dc else 1.0 - fc) * self.at(layer, r0 + dr, c0 + dc)
        return corner(0, 0) + corner(0, 1) + corner(1, 0) + corner(1, 1)


def raster_blocks(pixels: DataFrame, row: str = "row", col: str = "col", values: tuple[str, ...] = ("value",)) -> DataFrame:
    """One row per block of 64 x 64 pixels: block_row, block_col, ``at`` (places of its pixels) and an array per value.

    Pixels without any value are left out. A pixel must not occur twice.
    """
    local = F.pmod(F.col(row), F.lit(BLOCK)) * BLOCK + F.pmod(F.col(col), F.lit(BLOCK))
    known = pixels.filter(F.coalesce(*values).isNotNull())
    grouped = known.groupBy(
        F.floor(F.col(row) / BLOCK).cast("int").alias("block_row"), F.floor(F.col(col) / BLOCK).cast("int").alias("block_col")
    ).agg(F.collect_list(F.struct(local.cast("int").alias("at"), *[F.col(v).cast("double").alias(v) for v in values])).alias("_p"))
    return grouped.select("block_row", "block_col", *[F.transform("_p", lambda p: p[n]).alias(n) for n in ("at", *values)])  # noqa: B023


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(length of each list, all elements; NULL elements as NaN)."""
    whole = column.combine_chunks()
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0)
    flat = whole.flatten()
    return np.diff(whole.offsets.to_numpy()), flat.to_numpy(zero_copy_only=False)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column as numbers; NULL as NaN."""
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False) if len(table) else np.zeros(0)


def _assembled(table: pa.Table, bounds: tuple[int, int, int, int], values: tuple[str, ...]) -> Window:
    top, bottom, left, right = bounds
    sizes, at = lists(table.column("at"))
    rows = np.repeat(numbers(table, "block_row").astype(np.int64) * BLOCK, sizes) + at // BLOCK - top
    cols = np.repeat(numbers(table, "block_col").astype(np.int64) * BLOCK, sizes) + at % BLOCK - left
    rows, cols = rows.astype(np.int64), cols.astype(np.int64)
    inside = (rows >= 0) & (rows <= bottom - top) & (cols >= 0) & (cols <= right - left)
    layers = {}
    for name in values:
        pixels = np.full((bottom - top + 1, right - left + 1), np.nan)
        pixels[rows[inside], cols[inside]] = lists(table.column(name))[1][inside]
        layers[name] = pixels
    return Window(top, left, layers)


def empty(schema: str) -> pa.Table:
    """A table without rows; ``schema`` as text, of doubles, whole numbers and arrays of doubles."""
    kinds = {"double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "array<double>": pa.list_(pa.float64())}
    columns = [c.rsplit(" ", 1) for c in schema.split(", ")]
    return pa.table({n: pa.array([], kinds[k]) for n, k in columns})


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by the keys over all tasks: adaptive execution would pack the few bytes before costly work into one task."""
    return df.repartition(parallelism(df.sparkSession), *keys)


def dealt_places(places: DataFrame, row: Column, col: Column, per_task: int = PLACES) -> DataFrame:
    """Places with their square and, where it holds very many, the number of the task within it; unplaced ones share a square."""
    zone = lambda c: F.coalesce(F.floor(c / ZONE).cast("int"), F.lit(NOWHERE))
    zoned = places.withColumns({"_zr": zone(row), "_zc": zone(col)})
    crowd = zoned.groupBy("_zr", "_zc").agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias("_tasks"))
    part = F.pmod(F.xxhash64(*places.columns), F.col("_tasks")).cast("int")
    return zoned.join(crowd, ["_zr", "_zc"]).withColumn("_part", part)


def at_places(
    places: DataFrame,
    pixels: DataFrame,
    reach: tuple[Column, Column, Column, Column],
    compute: Callable[[Window, pa.Table], pa.Table],
    schema: str,
    *,
    row: str = "row",
    col: str = "col",
    values: tuple[str, ...] = ("value",),
) -> DataFrame:
    """``compute`` on every place, with a window that covers what it reaches.

    ``reach``: first row, last row, first column and last column (columns of ``places``, whole numbers). Places with a NULL
    reach see an empty window. Only the blocks that some place reaches are made and sent.
    """
    names, kept = ["_top", "_bottom", "_left", "_right"], places.columns
    bounded = places.withColumns({n: c.cast("bigint") for n, c in zip(names, reach, strict=True)})
    middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    dealt = cut_lineage(dealt_places(bounded, middle("_top", "_bottom"), middle("_left", "_right")))
    key = ["_zr", "_zc", "_part"]
    windows = dealt.groupBy(*[F.col(k).alias(k[1:]) for k in key]).agg(
        F.min("_top").alias("t"), F.max("_bottom").alias("b"), F.min("_left").alias("l"), F.max("_right").alias("r")
    )
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    wanted = windows.withColumn("block_row", F.explode(F.sequence(block("t"), block("b"))))
    wanted = wanted.withColumn("block_col", F.explode(F.sequence(block("l"), block("r")))).select(
        "zr", "zc", "part", "block_row", "block_col"
    )
    at = [F.floor(F.col(c) / BLOCK).cast("int") for c in (row, col)]
    near = pixels.withColumns({"block_row": at[0], "block_col": at[1]})
    near = near.join(wanted.select("block_row", "block_col").distinct(), ["block_row", "block_col"], "left_semi")
    blocks = raster_blocks(near, row, col, values)
    sent = blocks.join(wanted, ["block_row", "block_col"])

    def run(_: tuple, found: pa.Table, asked: pa.Table) -> pa.Table:
        bounds = [asked.column(n).combine_chunks().drop_null().to_numpy() for n in names]
        if len(asked) == 0 or len(bounds[0]) == 0:
            window = Window(0, 0, {v: np.zeros((0, 0)) for v in values})
        else:
            window = _assembled(found, (bounds[0].min(), bounds[1].max(), bounds[2].min(), bounds[3].max()), values)
        return compute(window, asked.select(kept))

    sent, dealt = keyed(sent, "zr", "zc", "part"), keyed(dealt, *key)
    return sent.groupBy("zr", "zc", "part").cogroup(dealt.groupBy(*key)).applyInArrow(run, schema)


def zones(index: str, reach: int, size: Column | None = None) -> Column:
    """Numbers of the squares whose window, ``reach`` wide, holds a row or column; of those on the raster if given its size."""
    number = lambda c: F.floor(c / F.lit(ZONE)).cast("int")
    low, high = number(F.col(index) - reach), number(F.col(index) + reach)
    if size is not None:
        low, high = F.greatest(F.lit(0), low), F.least(number(size - 1), high)
    return F.sequence(low, high)


def bounds_of(zone: int, reach: int, size: int) -> tuple[int, int]:
    """First row (or column) of a square's window and the one behind its last."""
    return max(0, zone * ZONE - reach), min(size, (zone + 1) * ZONE + reach)


def inner(zone_row: int, zone_col: int, size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the square itself, as a grid."""
    rows, cols = (np.arange(*bounds_of(z, 0, n)) for z, n in ((zone_row, size[0]), (zone_col, size[1])))
    return np.meshgrid(rows, cols, indexing="ij")


def as_table(rows: np.ndarray, cols: np.ndarray, columns: dict[str, np.ndarray], keep: np.ndarray | None = None) -> pa.Table:
    """row, col and columns of a grid of pixels; NaN as NULL, only the pixels in ``keep``."""
    keep = np.ones(rows.shape, bool) if keep is None else keep
    data = {"row": pa.array(rows[keep]), "col": pa.array(cols[keep])}
    for name, values in columns.items():
        data[name] = pa.array(values[keep], from_pandas=True)
    return pa.table(data)


def stencil(
    raster: DataFrame, reach: int, compute: Callable[[Window, np.ndarray, np.ndarray, tuple[int, int]], pa.Table], schema: str,
    *, rows: Column, cols: Column, values: tuple[str, ...] = ("value",),
) -> DataFrame:
    """``compute(window, rows, cols, extent)`` on every square of a raster, in one shuffle of its pixels.

    A pixel travels once, and again only where it lies in the margin of neighbouring squares.
    """
    size = raster.select(
        rows.cast("bigint").alias("_rows"), cols.cast("bigint").alias("_cols"),
        F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), *[F.col(v).cast("double").alias(v) for v in values],
    )
    inside = F.col("row").between(0, F.col("_rows") - 1) & F.col("col").between(0, F.col("_cols") - 1)
    sent = size.filter(inside).withColumn("_zr", F.explode(zones("row", reach, F.col("_rows"))))
    sent = sent.withColumn("_zc", F.explode(zones("col", reach, F.col("_cols"))))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        zone_row, zone_col = (k.as_py() for k in key)
        extent = int(table.column("_rows")[0].as_py()), int(table.column("_cols")[0].as_py())
        (top, bottom), (left, right) = bounds_of(zone_row, reach, extent[0]), bounds_of(zone_col, reach, extent[1])
        at = numbers(table, "row") - top, numbers(table, "col") - left
        layers = {}
        for name in values:
            layers[name] = np.full((bottom - top, right - left), np.nan)
            layers[name][at] = numbers(table, name)
        window = Window(top, left, layers)
        return compute(window, *inner(zone_row, zone_col, extent), extent)

    return keyed(sent, "_zr", "_zc").groupBy("_zr", "_zc").applyInArrow(run, schema)
