"""Per-point terrain analysis: ring samples, lines along twelve axes, crossings and the final scores.

A place has up to 2,499 samples. They are read inside one task, from the window of elevation blocks around the places of a
square of the map, and summarised there per position; what leaves the task is one row per place and scale. Places are
made distinct first, poor scales stop before the axes are sampled, and all that follows works within the row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.functions.geo import METERS_PER_DEGREE, pixel_positions, pixel_reach
from landlens.functions.labels import live_label_code
from landlens.functions.numeric import axis_angle, clamp, half_up, let, union_prob
from landlens.operators import windows as win
from landlens.session import lookup_join

# Calibration of the per-point analysis.
SCALES = ((300, 2.0, 0.45), (1_000, 5.0, 0.35), (3_000, 10.0, 0.20))  # metres, threshold, weight
AXES = tuple(15.0 * i for i in range(12))
RING = tuple(45.0 * i for i in range(8))
OFFSETS = (-1.5, -0.5, 0.5, 1.5)
SAMPLES = 17
MIN_RING = 5
SCALE_SHARE = 0.72
MERGE_ANGLE = 18.0
MIN_ANGLE = 25.0
PLACE = ["lat", "lng"]


def _units(bearing: float) -> tuple[float, float]:
    """East and north share of one metre along a bearing."""
    return math.sin(math.radians(bearing)), math.cos(math.radians(bearing))


#: Sample slots around a position: centre (0), eight inner (1-8) and eight outer (9-16), as constants of the plan.
SLOTS = [(0, 0, 0.0, 0.0)] + [
    (base + i, ring, *_units(a)) for base, ring in ((1, 1), (9, 2)) for i, a in enumerate(RING)
]


def ring_samples(positions: DataFrame) -> DataFrame:
    """Centre (slot 0), inner (1-8) and outer (9-16) sample points around each position.

    ``positions`` carries ``at_lat``, ``at_lng`` and ``scale``; the samples replace the first two. What depends on the
    position only is computed before its row is multiplied.
    """
    scale = F.col("scale").cast("double")
    slots = F.array(
        *[
            F.struct(F.lit(s).alias("slot"), F.lit(r).alias("ring"), F.lit(e).alias("east"), F.lit(n).alias("north"))
            for s, r, e, n in SLOTS
        ]
    )
    keys = [c for c in positions.columns if c not in {"at_lat", "at_lng"}]
    rows = positions.select(
        *keys,
        "at_lat",
        "at_lng",
        F.greatest(F.lit(35.0), scale / 6.0).alias("_inner"),
        (scale / 2.0).alias("_outer"),
        (F.lit(METERS_PER_DEGREE) * F.greatest(F.lit(0.2), F.cos(F.radians("at_lat")))).alias("_lng_m"),
        F.explode(slots).alias("_s"),
    )
    distance = F.when(F.col("_s.ring") == 2, F.col("_outer")).otherwise(F.col("_inner"))
    return rows.select(
        *keys,
        F.col("_s.slot").alias("slot"),
        (F.col("at_lat") + F.col("_s.north") * distance / F.lit(METERS_PER_DEGREE)).alias("s_lat"),
        (F.col("at_lng") + F.col("_s.east") * distance / F.col("_lng_m")).alias("s_lng"),
    )


def dedupe_samples(samples: DataFrame) -> DataFrame:
    """Distinct sample positions at six decimals."""
    six = lambda c: half_up(F.col(c), 6)
    return samples.select(six("s_lat").alias("s_lat"), six("s_lng").alias("s_lng")).distinct()


def local_terrain(v: np.ndarray) -> dict[str, np.ndarray]:
    """tpi, mad, relief and coverage of positions from their samples (last axis: slots 0 to 16, NaN unknown).

    Without a centre or with fewer than five values on a ring: tpi is unknown, mad and relief are 0.
    """
    known = ~np.isnan(v)
    inner, outer = v[..., 1:9], v[..., 9:]
    n_inner, n_outer = known[..., 1:9].sum(axis=-1), known[..., 9:].sum(axis=-1)
    usable = known[..., 0] & (n_inner >= MIN_RING) & (n_outer >= MIN_RING)

    def median(values: np.ndarray) -> np.ndarray:
        """Over the known ones, which sorting puts first."""
        ordered = np.sort(values, axis=-1)
        pick = lambda at: np.take_along_axis(ordered, np.maximum(at, 0)[..., None], axis=-1)[..., 0]
        return (pick((n_outer - 1) >> 1) + pick(np.minimum(n_outer >> 1, outer.shape[-1] - 1))) / 2.0

    with np.errstate(invalid="ignore", divide="ignore"):
        near, far = np.nansum(inner, axis=-1) / n_inner, np.nansum(outer, axis=-1) / n_outer
        tpi = (v[..., 0] + near) / 2.0 - far
        mad = median(np.abs(outer - median(outer)[..., None]))
        span = np.where(known, v, -np.inf).max(axis=-1) - np.where(known, v, np.inf).min(axis=-1)
    return {
        "tpi": np.where(usable, tpi, np.nan), "mad": np.where(usable, mad, 0.0), "relief": np.where(usable, span, 0.0),
        "coverage": known.sum(axis=-1) / float(SAMPLES),
    }


#: Shares of one metre (east, north) and the ring of each sample slot, and of each anchor in scales: 4 * axis + offset position.
SLOT_TABLE = np.array([(r, e, n) for _, r, e, n in SLOTS])
ANCHOR_TABLE = np.array([(o * _units(a)[0], o * _units(a)[1]) for a in AXES for o in OFFSETS])


def _cosine(lat: np.ndarray) -> np.ndarray:
    return np.maximum(0.2, np.cos(np.radians(lat)))


def _sampled(window: win.Window, lat: np.ndarray, lng: np.ndarray, scale: float, zoom: int) -> dict[str, np.ndarray]:
    """Terrain of positions at one scale from the elevations of their samples."""
    ring, east, north = SLOT_TABLE.T
    distance = np.where(ring == 2, scale / 2.0, max(35.0, scale / 6.0))
    s_lat = lat[..., None] + north * distance / METERS_PER_DEGREE
    s_lng = lng[..., None] + east * distance / (METERS_PER_DEGREE * _cosine(lat))[..., None]
    row, col = pixel_positions(s_lat, s_lng, zoom)
    return local_terrain(window.at("elevation", np.floor(row).astype(np.int64), np.floor(col).astype(np.int64)))


def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=np.isnan(values))


TERRAIN = ("tpi", "mad", "relief", "coverage")
TERRAIN_SCHEMA = "lat double, lng double, scale int, " + ", ".join(
    [*(f"{n} double" for n in TERRAIN), *(f"anchor_{n} array<double>" for n in TERRAIN)]
)


def place_terrain(places: DataFrame, dem: DataFrame, zoom: int, scales=SCALES, *, anchors: bool = True) -> DataFrame:
    """Terrain of each distinct place at every scale and, where the scale is worth it, of its 48 anchors (``anchor_*`` arrays).

    ``dem``: gy, gx, elevation, one row per pixel. Where the gate fails, or without ``anchors``, the arrays are NULL.
    """
    metres = max(1.5 * s + max(s / 2.0, 35.0) for s, _, _ in scales)
    levels = [s for s, _, _ in scales]

    def compute(window: win.Window, asked: pa.Table) -> pa.Table:
        parts = []
        for at in range(0, len(asked), 256):
            lat, lng = (win.numbers(asked.slice(at, 256), c) for c in PLACE)
            for scale in levels:
                centre = _sampled(window, lat, lng, scale, zoom)
                data = {"lat": pa.array(lat), "lng": pa.array(lng), "scale": pa.array(np.full(len(lat), scale, np.int32))}
                data |= {n: _nullable(centre[n]) for n in TERRAIN}
                good = ~np.isnan(centre["tpi"]) & (centre["relief"] >= 3.0) & (centre["coverage"] >= 0.7) & anchors
                east, north = (ANCHOR_TABLE * scale).T
                a_lat = lat[good][:, None] + north / METERS_PER_DEGREE
                a_lng = lng[good][:, None] + east / (METERS_PER_DEGREE * _cosine(lat[good]))[:, None]
                found = _sampled(window, a_lat, a_lng, scale, zoom)
                ends = np.concatenate([[0], np.cumsum(good) * len(ANCHOR_TABLE)]).astype(np.int32)
                for n in TERRAIN:
                    offsets = pa.array(ends, mask=np.append(~good, False))
                    data[f"anchor_{n}"] = pa.ListArray.from_arrays(offsets, _nullable(found[n].ravel()))
                parts.append(pa.table(data))
        return pa.concat_tables(parts) if parts else win.empty(TERRAIN_SCHEMA)

    reach = pixel_reach(F.col("lat"), F.col("lng"), metres, zoom)
    distinct = places.select(*PLACE).distinct()
    return win.at_places(distinct, dem, reach, compute, TERRAIN_SCHEMA, row="gy", col="gx", values=("elevation",))


def centre_terrain(places: DataFrame, dem: DataFrame, zoom: int, scales=SCALES) -> DataFrame:
    """Terrain of each distinct place at every scale."""
    return place_terrain(places, dem, zoom, scales, anchors=False).select(*PLACE, "scale", *TERRAIN)


def anchor_marks(scales=SCALES) -> Column:
    """Per anchor: high (stands out upwards), low, and by how much, from the ``anchor_*`` arrays of a row."""
    floor = F
    for scale, threshold, _ in scales:
        floor = floor.when(F.col("scale") == scale, threshold * 0.35)

    def mark(a: Column) -> Column:
        threshold = F.greatest(floor, F.greatest(F.lit(0.5), a["anchor_mad"]) * 0.15)
        tpi = a["anchor_tpi"]
        good = tpi.isNotNull() & (a["anchor_relief"] >= 3.0) & (a["anchor_coverage"] >= 0.65)
        return F.struct(
            (good & (tpi >= threshold)).alias("high"),
            (good & (tpi <= -threshold)).alias("low"),
            clamp(F.abs(tpi) / (threshold * 2.0), 0.0, 1.0).alias("prominence"),
        )

    return F.transform(F.arrays_zip(*[f"anchor_{n}" for n in TERRAIN]), mark)


def line_quality(marks: Column) -> Column:
    """Per axis: angle and the quality of the high and of the low line, NULL where there is no line."""

    def quality(at: list[Column], kind: str) -> Column:
        on = [F.coalesce(a[kind], F.lit(False)) for a in at]
        n = sum((o.cast("int") for o in on), F.lit(0))
        p = sum((F.when(o, a["prominence"]).otherwise(0.0) for o, a in zip(on, at)), F.lit(0.0))
        value = (
            n / F.lit(4.0) * 0.25
            + 0.3
            + F.when(on[0] & on[3], 1.0).otherwise(0.75) * 0.2
            + F.try_divide(p, n) * 0.25
        )
        line = (n >= 3) & (on[0] | on[1]) & (on[2] | on[3]) & (value >= 0.55)
        return F.when(line, clamp(value, 0.0, 1.0)).alias(kind)

    def axis(i: Column) -> Column:
        at = [F.get(marks, i * len(OFFSETS) + k) for k in range(len(OFFSETS))]
        return F.struct((i * F.lit(AXES[1])).alias("angle"), quality(at, "high"), quality(at, "low"))

    return F.transform(F.sequence(F.lit(0), F.lit(len(AXES) - 1)), axis)


def merge_lines(lines: Column) -> Column:
    """Greedy choice by quality (ties: smaller angle first): a line stays if it is over 18 degrees from all kept.

    ``lines``: array of (angle, quality), at most one per axis.
    """
    ranked = F.sort_array(
        F.transform(lines, lambda x: F.struct((-x["quality"]).alias("rank"), x["angle"].alias("angle")))
    )
    empty = F.slice(ranked, 1, 0)
    return F.aggregate(
        ranked,
        empty,
        lambda kept, x: F.when(
            F.forall(kept, lambda k: axis_angle(k["angle"], x["angle"]) > MERGE_ANGLE), F.array_append(kept, x)
        ).otherwise(kept),
    )


def _evidence(pairs: Column) -> Column:
    top = F.slice(F.sort_array(F.filter(pairs, lambda p: p.isNotNull()), asc=False), 1, 3)
    return let(union_prob(top), lambda u: clamp(u, 0.0, 1.0))


def _pair(angle_a: Column, quality_a: Column, angle_b: Column, quality_b: Column) -> Column:
    return let(
        axis_angle(angle_a, angle_b),
        lambda angle: F.when(angle >= MIN_ANGLE, F.sqrt(quality_a * quality_b) * F.sin(F.radians(angle))),
    )


def crossing(merged: Column) -> Column:
    """Evidence of one kind of line crossing itself, from merged lines (rank, angle)."""
    pairs = F.flatten(
        F.transform(
            merged,
            lambda a, i: F.transform(
                F.slice(merged, i + 2, F.lit(len(AXES))),
                lambda b: _pair(a["angle"], -a["rank"], b["angle"], -b["rank"]),
            ),
        )
    )
    return _evidence(pairs)


def crossing_between(high: Column, low: Column) -> Column:
    """Evidence of high lines crossing low lines; here the lines are not merged."""
    pairs = F.flatten(
        F.transform(
            high,
            lambda a: F.transform(low, lambda b: _pair(a["angle"], a["quality"], b["angle"], b["quality"])),
        )
    )
    return _evidence(pairs)


def scale_crossings(terrain: DataFrame, scales=SCALES) -> DataFrame:
    """Rows of :func:`place_terrain` with the evidences and line counts of their scale; without anchors all are 0."""
    lines = lambda kind: F.transform(
        F.filter("_axes", lambda a: a[kind].isNotNull()),
        lambda a: F.struct(a["angle"].alias("angle"), a[kind].alias("quality")),
    )
    marked = terrain.withColumn("_marks", anchor_marks(scales)).withColumn("_axes", line_quality(F.col("_marks")))
    found = marked.withColumns({"_high": lines("high"), "_low": lines("low")})
    merged = found.withColumns({"_high_merged": merge_lines(F.col("_high")), "_low_merged": merge_lines(F.col("_low"))})
    known = F.col("_marks").isNotNull()
    value = lambda v: F.when(known, v).otherwise(0.0)
    return merged.select(
        *PLACE,
        "scale",
        value(crossing(F.col("_high_merged"))).alias("high_cross"),
        value(crossing(F.col("_low_merged"))).alias("low_cross"),
        value(crossing_between(F.col("_high"), F.col("_low"))).alias("ordinary_cross"),
        *[F.when(known, F.size(f"_{k}_merged")).otherwise(0).alias(f"{k}_lines") for k in ("high", "low")],
        F.col("tpi").alias("centre_tpi"),
        "relief",
        "coverage",
    )


def scale_evidence(points: DataFrame, dem: DataFrame, zoom: int = 13, scales=SCALES) -> DataFrame:
    """One row per distinct place and scale: evidences, line counts, centre tpi, relief and coverage."""
    return scale_crossings(place_terrain(points, dem, zoom, scales), scales)


def theory_score(evidence: DataFrame, scales=SCALES) -> DataFrame:
    """Scores, label and confidence per place from its rows per scale."""
    at = lambda c, s: F.max(F.when(F.col("scale") == s, F.col(c)))
    levels = [s for s, _, _ in scales]
    n = float(len(levels))
    union = lambda c: clamp(
        union_prob(F.array(*[at(c, s) * F.lit(SCALE_SHARE) for s in levels])), 0.0, 1.0
    )
    relative = F.lit(0.0)
    for s, _, w in scales:
        share = clamp(at("centre_tpi", s) / F.greatest(F.lit(1.0), at("relief", s) * 0.22), -1.0, 1.0)
        relative = relative + F.coalesce(share, F.lit(0.0)) * F.lit(w)
    strongest = F.greatest("high_cross", "low_cross", "ordinary_cross")
    base = evidence.groupBy(*PLACE).agg(
        union("high_cross").alias("high"),
        union("low_cross").alias("low"),
        union("ordinary_cross").alias("ordinary"),
        (F.sum("coverage") / F.lit(n)).alias("coverage"),
        (F.sum("relief") / F.lit(n)).alias("relief"),
        (F.count(F.when(strongest >= 0.25, 1)) / F.lit(n)).alias("active"),
        relative.alias("relative"),
        F.sum("high_lines").alias("high_lines"),
        F.sum("low_lines").alias("low_lines"),
    )
    high, low, ordinary = F.col("high"), F.col("low"), F.col("ordinary")
    best = F.greatest(high, low, ordinary)
    whole = lambda v: half_up(v).cast("int")
    original = clamp(whole(F.lit(50.0) + (high - low) * 50.0 * (F.lit(1.0) - ordinary * 0.38)), 0, 100)
    suitability = clamp(F.lit(92.0) - F.greatest(F.lit(0.0), F.col("relief") - 45.0), 20.0, 96.0)
    auxiliary = clamp(
        whole(clamp(F.lit(50.0) + F.col("relative") * 45.0, 0.0, 100.0) * 0.8 + suitability * 0.2), 0, 100
    )
    confidence = whole(clamp(F.col("coverage") * 0.35 + best * 0.4 + F.col("active") * 0.25, 0.0, 1.0) * 100.0)
    scored = base.withColumn("original_score", original).withColumn("auxiliary_score", auxiliary)
    detail = clamp(whole(F.col("original_score") * 0.8 + F.col("auxiliary_score") * 0.2), 0, 100)
    return scored.select(
        *PLACE,
        detail.alias("score"),
        live_label_code(high, low, ordinary).alias("label_code"),
        "original_score",
        whole(best * 100.0).alias("original_fit"),
        "auxiliary_score",
        detail.alias("detail_score"),
        F.lit(None).cast("int").alias("neighborhood_score"),
        confidence.alias("confidence"),
        half_up(high, 3).alias("high_evidence"),
        half_up(low, 3).alias("low_evidence"),
        half_up(ordinary, 3).alias("ordinary_evidence"),
        F.lit("live-analysis").alias("source_mode"),
        F.array(
            F.format_string(
                "高位×高位 %d／低位×低位 %d／高位×低位 %d", whole(high * 100.0), whole(low * 100.0), whole(ordinary * 100.0)
            ),
            F.format_string("3縮尺で高位線候補 %d本、低位線候補 %d本", "high_lines", "low_lines"),
            F.format_string("原典ロジック80%%＋補助地形20%%で地点詳細点 %d", detail),
            F.format_string("標高データ充足率 %d%%", whole(F.col("coverage") * 100.0)),
        ).alias("reasons"),
    )


def scale_report(evidence: DataFrame) -> DataFrame:
    """Per-scale evidence rounded for display."""
    return evidence.select(
        *PLACE,
        "scale",
        *[half_up(F.col(c), 3).alias(c) for c in ("high_cross", "low_cross", "ordinary_cross")],
        "high_lines",
        "low_lines",
        half_up(F.col("centre_tpi"), 2).alias("centre_tpi"),
        half_up(F.col("relief"), 1).alias("relief"),
        half_up(F.col("coverage"), 3).alias("coverage"),
    )


def analyze_theory(points: DataFrame, dem: DataFrame, zoom: int = 13) -> DataFrame:
    """Points with their live terrain analysis; places shared by many points are analysed once."""
    return lookup_join(points, theory_score(scale_evidence(points, dem, zoom)), PLACE)

