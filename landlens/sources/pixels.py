"""Raster pixels: channel normalisation, elevation decoding and cell colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.functions.labels import CANDIDATE, CAUTION, INSUFFICIENT, MIXED, ORDINARY
from landlens.functions.numeric import half_even, half_up

# 24-bit elevation encoding in centimetres.
NO_DATA = 8_388_608
WRAP = 16_777_216

# Colours of the three drawing schemes.
GRID_COLORS = ((148, 151, 146), (11, 126, 105), (137, 34, 71), (184, 141, 35), (104, 91, 142), (130, 132, 127))
THEORY_LOW, THEORY_MIDDLE, THEORY_HIGH = (127, 29, 78), (168, 165, 155), (15, 138, 120)
SCREEN_CANDIDATE = ((0xD7, 0xEB, 0xE6), (0x0B, 0x7E, 0x69))
SCREEN_CAUTION = ((0xEA, 0xD6, 0xDE), (0x89, 0x22, 0x47))
SCREEN_FLAT = {ORDINARY: (0xC4, 0x9A, 0x35), MIXED: (0x6D, 0x5E, 0x94), INSUFFICIENT: (0xB9, 0xBC, 0xB8)}
SCREEN_OTHER = (0x90, 0x94, 0x8F)
SAFETY_RED, SAFETY_AMBER, SAFETY_GREEN = (0x99, 0x1B, 0x1B), (0xD9, 0x77, 0x06), (0x16, 0x84, 0x5B)

RGB = ("r", "g", "b")


def elevation(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Metres from an encoded pixel; transparent or the no-data code is unknown."""
    code = r * F.lit(65_536) + g * F.lit(256) + b
    signed = F.when(code < NO_DATA, code).otherwise(code - F.lit(WRAP))
    return F.when((a != 0) & (code != NO_DATA), signed * F.lit(0.01))


def decode_elevation(raster: DataFrame) -> DataFrame:
    keys = [c for c in raster.columns if c not in {"r", "g", "b", "a"}]
    return raster.select(*keys, elevation(*[F.col(c) for c in "rgba"]).alias("elevation"))


def normalize_pixel(df: DataFrame) -> DataFrame:
    """Raw samples ``s0..s3`` with ``channels`` and ``depth`` to 0..255 RGBA."""
    top = F.when(F.col("depth") == 16, 65_535.0).otherwise(255.0)
    level = lambda c: half_up(F.coalesce(F.col(c), F.lit(0)) / top * F.lit(255.0)).cast("int")
    grey = F.col("channels") <= 2
    alpha = (
        F.when(F.col("channels") == 2, level("s1")).when(F.col("channels") >= 4, level("s3")).otherwise(F.lit(255))
    )
    keys = [c for c in df.columns if c not in {"channels", "depth", "s0", "s1", "s2", "s3"}]
    return df.select(
        *keys,
        level("s0").alias("r"),
        F.when(grey, level("s0")).otherwise(level("s1")).alias("g"),
        F.when(grey, level("s0")).otherwise(level("s2")).alias("b"),
        alias_int(alpha, "a"),
    )


def alias_int(value: Column, name: str) -> Column:
    return value.cast("int").alias(name)


def _pick(code: Column, table: dict[int, int], other: int) -> Column:
    rungs = F
    for key, value in table.items():
        rungs = rungs.when(code == key, float(value))
    return rungs.otherwise(float(other))


def _mix(first: Column, second: Column, ratio: Column) -> Column:
    return first + (second - first) * ratio


def colorize_cells(df: DataFrame, scheme: str) -> DataFrame:
    """Add ``r, g, b, a``. Schemes: ``grid`` (label and strength), ``theory`` (score ramp by confidence),
    ``screen`` (label ramp, opaque) and ``safety`` (red, amber, green, opaque).

    ``grid`` and ``theory`` expect ``confidence`` as a share 0..1.
    """
    score = F.col("score").cast("double")
    if scheme == "grid":
        saturation = F.lit(0.58) + F.lit(0.42) * F.abs(score - 50.0) / F.lit(50.0)
        code = F.col("label_code")
        rgb = [
            half_even(_mix(F.lit(242.0), _pick(code, {k: c[i] for k, c in enumerate(GRID_COLORS)}, 0), saturation))
            for i in range(3)
        ]
        alpha = F.least(F.lit(230.0), half_even(F.lit(130.0) + F.lit(100.0) * F.col("confidence")))
    elif scheme == "theory":
        known, confidence = F.coalesce(score, F.lit(50.0)), F.coalesce(F.col("confidence"), F.lit(0.0))
        unit = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
        rgb = [
            half_even(
                F.when(known < 50, _mix(F.lit(float(low)), F.lit(float(mid)), unit(known / 50.0))).otherwise(
                    _mix(F.lit(float(mid)), F.lit(float(high)), unit((known - 50.0) / 50.0))
                )
            )
            for low, mid, high in zip(THEORY_LOW, THEORY_MIDDLE, THEORY_HIGH)
        ]
        alpha = F.when(F.col("masked"), half_even(F.lit(92.0) + F.lit(115.0) * confidence)).otherwise(0.0)
    elif scheme == "screen":
        code = F.col("label_code")
        strength = F.lit(0.42) + F.lit(0.58) * (F.abs(score - 50.0) / F.lit(50.0))
        ramp = lambda ends, i: half_up(_mix(F.lit(float(ends[0][i])), F.lit(float(ends[1][i])), strength))
        rgb = [
            F.when(code == CANDIDATE, ramp(SCREEN_CANDIDATE, i).cast("double"))
            .when(code == CAUTION, ramp(SCREEN_CAUTION, i).cast("double"))
            .otherwise(_pick(code, {k: c[i] for k, c in SCREEN_FLAT.items()}, SCREEN_OTHER[i]))
            for i in range(3)
        ]
        alpha = F.lit(255.0)
    elif scheme == "safety":
        rgb = [
            half_up(
                F.when(score < 50, _mix(F.lit(float(red)), F.lit(float(amber)), score / 50.0)).otherwise(
                    _mix(F.lit(float(amber)), F.lit(float(green)), (score - 50.0) / 50.0)
                )
            )
            for red, amber, green in zip(SAFETY_RED, SAFETY_AMBER, SAFETY_GREEN)
        ]
        alpha = F.lit(255.0)
    else:
        raise ValueError(f"unknown colour scheme: {scheme}")
    return df.select("*", *[alias_int(v, n) for n, v in zip(RGB, rgb)], alias_int(alpha, "a"))


def color_distance(r: Column, g: Column, b: Column, color: tuple[int, int, int]) -> Column:
    return F.sqrt(
        F.pow(r - F.lit(color[0]), F.lit(2.0))
        + F.pow(g - F.lit(color[1]), F.lit(2.0))
        + F.pow(b - F.lit(color[2]), F.lit(2.0))
    )
