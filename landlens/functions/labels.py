"""Label ladders. Order matters in each: the first rung that holds wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terrain labels by code.
TERRAIN_LABELS = ("判定材料不足", "イヤシロチ候補", "ケガレチ候補", "普通地", "高低混在", "通常・弱い傾向")
INSUFFICIENT, CANDIDATE, CAUTION, ORDINARY, MIXED, WEAK = range(6)

# Other ladders (lower bound, label), highest first.
RISK_LADDER = ((80, "低リスク"), (60, "低〜中リスク"), (40, "要確認"), (20, "高リスク"))
RISK_LOWEST = "非常に高リスク"
COMBINED_LADDER = ((80, "住みやすさ候補"), (65, "概ね良好"), (45, "要確認"), (25, "慎重に確認"))
COMBINED_LOWEST = "優先度低め"
SLOPE_LADDER = ((40.0, 80), (30.0, 60), (15.0, 35), (5.0, 10))
AMPLIFICATION_LADDER = ((1.0, 0), (1.4, 20), (1.6, 40), (2.0, 65))
AMPLIFICATION_HIGHEST = 85
COMPARISON_BELOW = ((-0.15, "内部サンプル中央値よりかなり低い"), (-0.05, "内部サンプル中央値よりやや低い"))
COMPARISON_UNDER = ((0.05, "内部サンプル中央値付近"), (0.15, "内部サンプル中央値よりやや高い"))
COMPARISON_HIGHEST = "内部サンプル中央値よりかなり高い"


def _at_least(value: Column, ladder, lowest) -> Column:
    rungs = F
    for bound, label in ladder:
        rungs = rungs.when(value >= bound, label)
    return rungs.otherwise(lowest)


def terrain_label(code: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in TERRAIN_LABELS]), code)


def live_label_code(high: Column, low: Column, ordinary: Column) -> Column:
    """Calibration of the per-point analysis."""
    gap = high - low
    return (
        F.when((high >= 0.42) & (gap >= 0.12) & (high >= ordinary - 0.03), CANDIDATE)
        .when((low >= 0.42) & (gap <= -0.12) & (low >= ordinary - 0.03), CAUTION)
        .when((ordinary >= 0.38) & (ordinary >= F.greatest(high, low) - 0.05), ORDINARY)
        .when((high >= 0.32) & (low >= 0.32) & (F.abs(gap) < 0.12), MIXED)
        .when(F.greatest(high, low, ordinary) >= 0.25, WEAK)
        .otherwise(INSUFFICIENT)
    )


def grid_label_code(high: Column, low: Column, ordinary: Column) -> Column:
    """Calibration of the 100 m grid: insufficient evidence is decided first here."""
    return (
        F.when(F.greatest(high, low, ordinary) < 0.11, INSUFFICIENT)
        .when((high >= 0.19) & (high >= low + 0.045) & (high >= ordinary - 0.015), CANDIDATE)
        .when((low >= 0.19) & (low >= high + 0.045) & (low >= ordinary - 0.015), CAUTION)
        .when((ordinary >= 0.18) & (ordinary >= F.greatest(high, low) - 0.025), ORDINARY)
        .when((high >= 0.15) & (low >= 0.15) & (F.abs(high - low) < 0.055), MIXED)
        .otherwise(WEAK)
    )


def risk_label(score: Column) -> Column:
    return _at_least(score, RISK_LADDER, RISK_LOWEST)


def combined_label(score: Column) -> Column:
    return _at_least(score, COMBINED_LADDER, COMBINED_LOWEST)


def slope_score(degrees: Column) -> Column:
    return F.when(degrees.isNotNull(), _at_least(degrees, SLOPE_LADDER, 0))


def amplification_score(arv: Column) -> Column:
    """Risk of the ground amplification factor; NULL in, NULL out."""
    rungs = F
    for bound, score in AMPLIFICATION_LADDER:
        rungs = rungs.when(arv < bound, score)
    return F.when(arv.isNotNull(), rungs.otherwise(AMPLIFICATION_HIGHEST))


def comparison_label(pct: Column) -> Column:
    """Where a price stands against the town median; the first two bounds are inclusive, the last two not."""
    rungs = F
    for bound, label in COMPARISON_BELOW:
        rungs = rungs.when(pct <= bound, label)
    for bound, label in COMPARISON_UNDER:
        rungs = rungs.when(pct < bound, label)
    return F.when(pct.isNotNull(), rungs.otherwise(COMPARISON_HIGHEST))
