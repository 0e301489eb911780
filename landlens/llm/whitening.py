"""Embedding whitening by contour integration of the covariance (FEAST).

Three passes over the vectors, none of which moves a vector: exact integer sums, the exact integer scatter around a whole
origin next to the mean, and the projection. The passes leave one small row per task, which Spark adds up; only the
covariance, whose size is the square of the dimension, reaches the driver.

Inertia counts (signs of the pivots of V - s I) cut the spectrum from above into intervals of a few eigenvalues. Each
interval is a task of its own: a quadrature over the circle around it solves complex shifted systems, which projects a block
of vectors onto the interval's eigenspace, and Rayleigh-Ritz steps extract its components until as many have converged as the
inertia counts say there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landlens.session import cut_lineage

COMPONENTS = 32
#: A component c becomes the whole number floor(SCALE c) + SHIFT.
SCALE = 64
SHIFT = 1_000_000
#: Entries of this size or more have no exact whole number here; their vectors count as non-finite.
LIMIT = 2.0**40
#: Eigenvalues per interval, nodes on the half circle, refinements of a subspace.
PER_INTERVAL = 8
NODES = 8
ROUNDS = 40
EPS = float(np.finfo(float).eps)


def vector_rows(vectors: DataFrame) -> DataFrame:
    """The vectors as single or double precision numbers and their vec_id."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    return vectors.select(v.alias("v"), "vec_id").filter("v IS NOT NULL")


def blocks(lists: pa.ListArray, d: int, scale: int, shift: int, rows: int = 2_048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, whole numbers as a matrix) of the usable vectors of length ``d``, some at a time.

    Usable: not empty, every entry present, finite and below the limit.
    """
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < LIMIT))])
    good = np.flatnonzero((sizes == d) & (bad[ends] == bad[ends - sizes]))
    for at in range(0, len(good), rows):
        some = good[at : at + rows]
        values = flat[(ends[some] - d)[:, None] + np.arange(d)]
        yield some, np.floor(values * scale).astype(np.int64) + shift


def added(parts: DataFrame, *names: str) -> dict[tuple, int]:
    """What the tasks found (``values``: whole numbers as text), added up exactly by the named keys and the place in the list."""
    each = parts.select(*names, F.posexplode("values").alias("at", "value"))
    total = each.groupBy(*names, "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    return {tuple(r)[:-1]: int(r.total) for r in total.collect()}


def sums(rows: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    """The number of usable vectors and their exact sums per dimension, for the length that most vectors have (the larger one of
    equally frequent lengths)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            for d in np.unique(np.diff(batch.column(0).offsets.to_numpy())):
                for _, x in blocks(batch.column(0), int(d), scale, shift) if d else ():
                    mine = found.setdefault(int(d), [0, np.zeros(d, dtype=object)])
                    mine[0] += len(x)
                    mine[1] = mine[1] + x.sum(axis=0).astype(object)
        for d, (n, total) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n]), pa.array([[str(v) for v in total]])], ["d", "n", "values"])

    parts = cut_lineage(rows.select("v").mapInArrow(run, "d int, n long, values array<string>"))
    most = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return 0, []
    got = added(parts.filter(F.col("d") == most.d).select("values"))
    return most.n, [got[(i,)] for i in range(most.d)]


def exact_gram(y: np.ndarray) -> np.ndarray:
    """Exact sum of outer products of whole rows, as Python integers."""
    top = int(np.abs(y).max(initial=0))
    out = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    if top >= 1 << 26:  # a product may exceed what a double holds exactly
        big = y.astype(object)
        return out + big.T @ big
    step = max(1, (1 << 53) // max(1, top * top))
    for at in range(0, len(y), step):
        part = y[at : at + step].astype(float)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def covariance(rows: DataFrame, n: int, total: list[int], origin: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """Covariance (divisor n), each entry rounded once: exact products around the origin, corrected by the mean's distance."""
    d = len(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d), dtype=object)
        for batch in batches:
            for _, x in blocks(batch.column(0), d, scale, shift):
                gram = gram + exact_gram(x - origin)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([[str(v) for v in gram[i, : i + 1]] for i in range(d)])], ["i", "values"]
        )

    got = added(rows.select("v").mapInArrow(run, "i int, values array<string>"), "i")
    rest = [s - n * int(o) for s, o in zip(total, origin, strict=True)]
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i + 1):
            v[i, j] = v[j, i] = (n * got[i, j] - rest[i] * rest[j]) / (n * n)
    return v


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed the shift: positive pivots of a symmetric elimination (blocks of one or two rows)."""
    a = v - shift * np.eye(len(v))
    n, k, positive = len(a), 0, 0

    def swap(i: int, j: int) -> None:
        a[[i, j], :] = a[[j, i], :]
        a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        rest = np.abs(a[k:, k:])
        diagonal = rest.diagonal().copy()
        np.fill_diagonal(rest, 0.0)
        one, (r, s) = int(diagonal.argmax()), divmod(int(rest.argmax()), n - k)
        if diagonal[one] >= 0.6404 * rest[r, s]:
            if diagonal[one] == 0.0:
                break
            swap(k, k + one)
            positive += a[k, k] > 0
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :]) / a[k, k]
            k += 1
        else:  # a block of two rows has one positive and one negative eigenvalue
            r, s = min(r, s), max(r, s)
            swap(k, k + r)
            swap(k + 1, k + s)
            positive += 1
            if k + 2 < n:
                a[k + 2 :, k + 2 :] -= a[k + 2 :, k : k + 2] @ np.linalg.solve(a[k : k + 2, k : k + 2], a[k : k + 2, k + 2 :])
            k += 2
    return int(positive)


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(from, to, eigenvalues inside) from the top of the spectrum down to the ``wanted``-th eigenvalue at least.

    Eigenvalues that rounding cannot tell from zero are left out.
    """
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)
    if not top > 0:
        return []
    floor = top * len(v) * EPS * 4
    most = above(v, floor)
    out: list[tuple[float, float, int]] = []
    upper, seen = top, 0
    while seen < min(wanted, most):
        target = min(seen + PER_INTERVAL, wanted, most)
        low, high = floor, upper
        cut, held = floor, most
        while high - low > 1e-10 * top:
            middle = (low + high) / 2
            count = above(v, middle)
            if count < target:
                high = middle
                continue
            low, cut, held = middle, middle, count
            if count <= target + 2 and above(v, cut - 1e-9 * top) == count == above(v, cut + 1e-9 * top):
                break
        out.append((cut, upper, held - seen))
        upper, seen = cut, held
    return out


def contour(v: np.ndarray, low: float, high: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues between low and high and their unit vectors; exactly ``inside`` of them, or an error."""
    d = len(v)
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turns = radius * np.exp(-0.5j * np.pi * (points - 1))
    scale = float(np.abs(v).sum(axis=1).max())
    for width in dict.fromkeys((min(d, inside + inside // 2 + 4), min(d, 3 * inside + 8), d)):
        block = np.random.default_rng(7).standard_normal((d, width))
        for _ in range(ROUNDS):
            projected = np.zeros((d, block.shape[1]))
            for turn, weight in zip(turns, weights, strict=True):
                solved = np.linalg.solve((centre + turn) * np.eye(d) - v, block.astype(complex))
                projected += 0.5 * weight * (turn * solved).real
            basis, size, _ = np.linalg.svd(projected, full_matrices=False)
            basis = basis[:, size > size[0] * 1e-13]
            values, turned = np.linalg.eigh(basis.T @ v @ basis)
            block = basis @ turned
            error = np.linalg.norm(v @ block - block * values, axis=0)
            found = (values > low) & (values < high) & (error <= 8 * d * EPS * scale)
            if found.sum() == inside:
                return values[found], block[:, found]
    raise RuntimeError(f"{found.sum()} of {inside} components between {low} and {high} converged")


def principal(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns; every interval is solved in a task of its own."""
    cuts = intervals(v, wanted)
    if not cuts:
        return np.zeros(0), np.zeros((len(v), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values, vectors = contour(v, row["low"], row["high"], row["inside"])
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], ["e", "u"])

    tasks = spark.createDataFrame(cuts, "low double, high double, inside int").repartitionByRange(len(cuts), "low")
    got = tasks.mapInArrow(run, "e double, u array<double>").collect()
    basis, _ = np.linalg.qr(np.array([r.u for r in sorted(got, key=lambda r: -r.e)]).T)
    values, turned = np.linalg.eigh(basis.T @ v @ basis)
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = basis @ turned[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values[order], vectors * signs


def identity_error(rows: DataFrame, whitened: Callable, n: int, k: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, _, w in whitened(batch.column(0)):
                first += w.sum(axis=0)
                second += w.T @ w
        values = pa.array([first.tolist(), *second.tolist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), values], ["i", "values"])

    parts = rows.select("v").mapInArrow(run, "i int, values array<double>").select("i", F.posexplode("values").alias("at", "value"))
    got = {(r.i, r["at"]): r.total for r in parts.groupBy("i", "at").agg(F.sum("value").alias("total")).collect()}
    mean = np.array([got[0, j] for j in range(k)]) / n  # the vectors are centred already; what is left is rounding
    second = np.array([[got[i + 1, j] for j in range(k)] for i in range(k)]) / n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def deviations(y: np.ndarray, n: int, rest: np.ndarray) -> np.ndarray:
    """Sum over dimensions of (n y - rest)^2, exact; -1 where a long cannot hold it."""
    top = n * int(np.abs(y).max(initial=0)) + n
    if top * top * y.shape[1] < 1 << 63:
        each = n * y - rest.astype(np.int64)
        return (each * each).sum(axis=1)
    each = n * y.astype(object) - rest
    return np.array([v if v < 1 << 63 else -1 for v in (each * each).sum(axis=1)], dtype=np.int64)


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component (from 1, falling eigenvalue), n, deviation, whitened, explained, identity_error: one row per vector
    and component.

    Columns used: vec_id, embedding; others are ignored. Vectors that are null or empty, that hold null, non-finite or huge
    (2^40) entries, or that are not of the length most vectors have, are left out. Repeated rows and null ids are rows like any
    other. Components whose eigenvalue rounding cannot tell from zero have no whitened form and are left out, so a table of
    equal vectors, of one vector or of none gives no rows. ``deviation`` is null where a long cannot hold it.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    empty = spark.createDataFrame([], f"vec_id {kind}, {SCHEMA}")
    rows = vector_rows(vectors)
    n, total = sums(rows, scale, shift)
    if n == 0:
        return empty
    d = len(total)
    origin = np.array([(2 * s + n) // (2 * n) for s in total], dtype=np.int64)
    rest = np.array([s - n * int(o) for s, o in zip(total, origin, strict=True)], dtype=object)
    v = covariance(rows, n, total, origin, scale, shift)
    values, directions = principal(spark, v, components)
    k = len(values)
    if k == 0:
        return empty
    offset = np.array([int(r) / n for r in rest])
    turn = directions / np.sqrt(values)
    explained = values / math.fsum(np.diag(v))

    def whitened(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places, whole numbers around the origin and whitened vectors."""
        for places, x in blocks(lists, d, scale, shift):
            yield places, x - origin, ((x - origin).astype(float) - offset) @ turn

    error = identity_error(rows, whitened, n, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, y, w in whitened(batch.column(0)):
                size = len(places)
                far = np.repeat(deviations(y, n, rest), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).take(pa.array(np.repeat(places, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * k, n)), pa.array(far, mask=far < 0), pa.array(w.ravel()),
                        pa.array(np.tile(explained, size)), pa.array(np.full(size * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, f"vec_id {kind}, {SCHEMA}")


QUERY_COLUMNS = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
