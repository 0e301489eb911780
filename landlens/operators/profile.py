"""Location profile: per-layer records for each point, findings, sources and the composed result.

Layer and project identifiers are metadata the caller supplies (:class:`LayerNames`); the rules do not depend on them.
Findings and sources stay in long form, so a cell with very many links is never packed into one row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.functions.geo import canonical_cell, format_coordinate
from landlens.functions.labels import terrain_label
from landlens.functions.numeric import half_up
from landlens.functions.text import bool_like
from landlens.operators.filters import hidden_counts, visible_links
from landlens.operators.lookups import feature_join
from landlens.operators.ranking import ordered_rank
from landlens.session import lookup_join

# Availability, coverage and default status.
AVAILABLE, PARTIAL, NOT_AVAILABLE, NOT_APPLICABLE = "available", "partial", "not_available", "not_applicable"
COMPLETE, PARTIAL_SOURCES, SOURCE_LIMITED, UNKNOWN = (
    "complete_for_defined_sources", "partial_known_sources", "source_limited", "unknown",
)
NO_INDEX = "NO_INDEXED_CANDIDATE_SOURCE_LIMITED"
NO_EFFECT = "none"

# Texts of the environment layer.
STATE_TEXT = {
    "INVALID": "不明",
    "NEUTRAL": "中立",
    "CAUTION": "注意条件が優勢",
    "CANDIDATE": "候補",
    "STRONG": "強い候補",
    "MIXED": "好条件と注意条件が混在",
}
TIER_TEXT = {
    "INVALID": "不明",
    "A_BUILT_UP_CONTINUITY": "現況住宅地として連続性あり",
    "B_CURRENT_BUILDINGS_HISTORIC_REVIEW": "現況建物あり・土地履歴を確認",
    "NO_CURRENT_BUILDINGS": "現況建物なし",
    "HISTORIC_NONRESIDENTIAL_REVIEW": "過去の非住宅利用を確認",
    "UNKNOWN_PLATEAU_SOURCE_HOLE": "PLATEAU資料穴のため不明",
}
CORE_CANDIDATE, SPOT_CANDIDATE = "頑健な住宅候補・3セル以上の連続ゾーン", "頑健な住宅候補・局所spot"
PLATEAU_HOLE = "都市開放性はPLATEAU資料穴のためUNKNOWNで、悪条件として扱いません。"
PLATEAU_EMPTY = "PLATEAU上は交差建物なしとして明示されています。物件存在の否定ではありません。"
PLATEAU_CONNECTED = "PLATEAU実用Level B近似が接続済みです。"
ENVIRONMENT_ONLY, NOT_ROBUST = "環境候補だが住宅候補ゲートは未通過", "頑健な環境候補には非該当"

# Texts of the moisture layer.
ATTENTION_TEXT = {
    "insufficient": "資料不足",
    "historical_water_attention_model_unavailable": "歴史的な水の文脈あり・地下水モデル値なし",
    "low": "低め",
    "low_to_moderate": "低〜中程度",
    "moderate": "中程度",
    "elevated": "やや高め",
    "high_attention": "重点確認",
    "reference_only": "参考情報のみ",
}
GROUNDWATER_TEXT = {
    "unavailable": "モデル値なし",
    "upland_5m_model": "台地・丘陵地 5m設定モデル",
    "other_materialized_model": "その他の公開モデル区分",
    "shallow_model": "浅いモデル区分",
    "very_shallow_model": "非常に浅いモデル区分",
    "moderately_shallow_model": "やや浅いモデル区分",
    "moderate_model": "中程度のモデル区分",
}
WATER_TEXT = {
    "defined_sources_no_direct_water_signal": "定義済み資料では直接の水シグナルなし",
    "wet_context_only": "水・湿地の文脈あり",
    "within_family_historical_water_convergence": "同一資料系列内で歴史的水文脈が重なる",
    "old_water_geomorph_candidate": "旧水系・地形候補",
    "historical_water_landuse_candidate": "歴史的な水系土地利用候補",
}
PENDING_NOTE = (
    "このセルの公開Evidenceはremote source pendingを含むため、詳細断定を避けてcontextとして表示します。"
)

MATURITIES = ("S7", "S6", "S5", "S4", "S3", "S2", "S1", "S0")


class LayerNames(NamedTuple):
    """What one layer is called in the output, and what its findings and warnings say of themselves.

    ``sources``: (pointer, title, version) of each finding; ``warnings``: of every record; ``outside``: of a cell without one.
    """

    layer_id: str
    project: str
    dataset_version: str | None = None
    category: str | None = None
    independence_group: str | None = None
    sources: tuple[tuple[str, str, str | None], ...] = ()
    warnings: tuple[str, ...] = ()
    outside: str | None = None


NOT_A_VERDICT = "A record shows context of its 100 m cell. Neither it nor its absence proves safety or danger."
NO_RECORD = "This position has no record here. Unknown is not turned into safe or unsafe."
ENVIRONMENT = LayerNames(
    "environment", "ENVIRONMENT", None, "environmental_and_residential_candidate_context", "ENVIRONMENT_CELLS",
    (("environment-cells", "Environment cells", None),), (NOT_A_VERDICT,), NO_RECORD,
)
MOISTURE = LayerNames(
    "moisture", "MOISTURE", None, "underground_water_moisture_context", "MOISTURE_CELLS",
    (("moisture-cells", "Moisture cells", None), ("moisture-registry", "Moisture source registry", "v1")), (NOT_A_VERDICT,), NO_RECORD,
)
CATALOG = LayerNames(
    "catalog", "CATALOG", None, "terrain_hypothesis_context", "FROZEN_CATALOG",
    (("catalog-cells", "Frozen grid catalog", None),), (NOT_A_VERDICT,), "The query falls outside the frozen grid.",
)
PLACES = LayerNames("places", "PLACES")
NOT_A_TARGET = "This grid position is not a valid target cell; no safety or absence inference is allowed."


def named(table: dict[str, str], key: Column) -> Column:
    """Text of a code; a code without text stands for itself."""
    lookup = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    return F.coalesce(F.try_element_at(lookup, key), key)


def percent(value: Column) -> Column:
    return F.concat(half_up(value * 100.0).cast("string"), F.lit("%"))


def _texts(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _layer(names: LayerNames, availability: Column, coverage: Column) -> list[Column]:
    return [
        F.lit(names.layer_id).alias("layer_id"),
        F.lit(names.project).alias("project"),
        availability.alias("availability"),
        coverage.alias("coverage_status"),
        F.lit(NO_EFFECT).alias("scoring_effect"),
        F.lit(names.dataset_version).cast("string").alias("dataset_version"),
    ]


def _warnings(names: LayerNames, known: Column, *more: Column) -> Column:
    """Warnings of a record, with those of ``more`` that hold, or the one of a cell without a record."""
    missing = _texts(() if names.outside is None else (names.outside,))
    return F.when(known, F.concat(_texts(names.warnings), F.array_compact(F.array(*more).cast("array<string>")))).otherwise(missing).alias("warnings")


def _finding_id(names: LayerNames) -> Column:
    return F.concat(F.lit(f"{names.project}-CELL-"), F.regexp_replace("cell_id", "^g", ""))


def with_cell(points: DataFrame) -> DataFrame:
    cell = canonical_cell(F.col("lat"), F.col("lng"))
    return points.select(
        "*", cell.row.alias("grid_row"), cell.col.alias("grid_col"), cell.cell_id.alias("cell_id"),
        cell.lat.alias("center_lat"), cell.lng.alias("center_lng"),
    )


def environment_layer(points: DataFrame, cells: DataFrame, names: LayerNames = ENVIRONMENT) -> DataFrame:
    """Environment record per point (point_id, cell_id); a cell without a record is not applicable."""
    joined = lookup_join(points.select("point_id", "cell_id"), cells, ["cell_id"])
    known = F.col("aggregate_state").isNotNull()
    hole = F.col("plateau_status") == "UNKNOWN_SOURCE_TILE_404"
    zone = F.coalesce(F.col("zone_id"), F.lit(""))
    tagged = lambda text: F.trim(F.concat(F.lit(text + " "), zone))
    candidate = (
        F.when(F.col("robust_residential") & F.col("core_zone"), tagged(CORE_CANDIDATE))
        .when(F.col("robust_residential"), tagged(SPOT_CANDIDATE))
        .when(F.col("robust_candidate"), ENVIRONMENT_ONLY)
        .otherwise(NOT_ROBUST)
    )
    explanation = F.concat_ws(
        " ",
        F.concat(
            F.lit("P25判定は「"), named(STATE_TEXT, F.col("aggregate_state")), F.lit("」。好条件"),
            F.col("favorable_pillars").cast("string"), F.lit("、注意"), F.col("caution_pillars").cast("string"),
            F.lit("、判明"), F.col("known_pillars").cast("string"), F.lit("/4柱。"),
        ),
        F.concat(candidate, F.lit("。")),
        F.concat(
            F.lit("周囲の頑健候補比率は300m "), percent(F.col("share_300m")), F.lit("、500m "),
            percent(F.col("share_500m")), F.lit("。"),
        ),
        F.concat(F.lit("住宅文脈は「"), named(TIER_TEXT, F.col("residential_tier")), F.lit("」。")),
        F.when(hole, PLATEAU_HOLE)
        .when(F.col("plateau_status") == "EXPLICIT_NO_BUILDINGS", PLATEAU_EMPTY)
        .otherwise(PLATEAU_CONNECTED),
    )
    return joined.select(
        "point_id",
        *_layer(
            names,
            F.when(~known, NOT_APPLICABLE).when(hole, PARTIAL).otherwise(AVAILABLE),
            F.when(~known, UNKNOWN).when(hole, PARTIAL_SOURCES).otherwise(COMPLETE),
        ),
        F.when(known, _finding_id(names)).alias("finding_id"),
        F.when(
            known, F.when(F.col("robust_residential") | F.col("robust_candidate"), "candidate").otherwise("context")
        ).alias("finding_status"),
        F.when(
            known,
            F.concat(F.lit(f"{names.project}環境・住宅候補: "), named(STATE_TEXT, F.col("aggregate_state"))),
        ).alias("title"),
        F.when(known, explanation).alias("explanation"),
        _warnings(names, known),
    )


def moisture_coverage(status: Column) -> Column:
    return (
        F.when(status == "full_single_class", COMPLETE)
        .when(status == "outside_jurisdiction_adapter_coverage", SOURCE_LIMITED)
        .otherwise(PARTIAL_SOURCES)
    )


def moisture_layer(points: DataFrame, cells: DataFrame, names: LayerNames = MOISTURE) -> DataFrame:
    """Moisture record per point, with a warning while its public evidence is pending."""
    joined = lookup_join(
        points.select("point_id", "cell_id"), cells.withColumnRenamed("coverage_status", "_coverage"), ["cell_id"]
    )
    known = F.col("attention_class").isNotNull()
    outside = F.col("_coverage") == "outside_jurisdiction_adapter_coverage"
    explanation = F.concat(
        F.lit("水・湿気の確認目安は「"), named(ATTENTION_TEXT, F.col("attention_class")),
        F.lit("」。地域地下水は「"), named(GROUNDWATER_TEXT, F.col("groundwater_band")),
        F.lit("」、歴史水・地形の文脈は「"), named(WATER_TEXT, F.col("historical_water_context")),
        F.lit("」。これは100mセルの居住確認用contextで、地下水モデル値を敷地直下の実測水位とは扱いません。"),
    )
    return joined.select(
        "point_id",
        *_layer(
            names,
            F.when(~known, NOT_APPLICABLE).when(outside, PARTIAL).otherwise(AVAILABLE),
            F.when(~known, UNKNOWN).otherwise(moisture_coverage(F.col("_coverage"))),
        ),
        F.when(known, _finding_id(names)).alias("finding_id"),
        F.when(known, F.lit("context")).alias("finding_status"),
        F.when(
            known,
            F.concat(F.lit(f"{names.project} 水・湿気カード: "), named(ATTENTION_TEXT, F.col("attention_class"))),
        ).alias("title"),
        F.when(known, explanation).alias("explanation"),
        F.when(known & (F.col("public_evidence_status") != "materialized"), PENDING_NOTE).alias("warning"),
        _warnings(names, known, F.when(F.col("public_evidence_status") != "materialized", PENDING_NOTE)),
    )


def catalog_layer(
    points: DataFrame, cells: DataFrame, rows: int | Column, columns: int | Column, names: LayerNames = CATALOG
) -> DataFrame:
    """Frozen grid record per point (point_id, cell_id, grid_row, grid_col): outside the grid it does not apply,
    an unknown label is partial, else available."""
    joined = lookup_join(points.select("point_id", "cell_id", "grid_row", "grid_col"),
                         cells.drop("grid_row", "grid_col", "grid_index"), ["cell_id"])
    limit = lambda v: F.lit(v) if isinstance(v, int) else v
    inside = (F.col("grid_row").between(0, limit(rows) - 1)) & (F.col("grid_col").between(0, limit(columns) - 1))
    known = inside & F.col("label_code").isNotNull()
    label = F.coalesce(
        terrain_label(F.col("label_code")), F.concat(F.lit("label-"), F.col("label_code").cast("string"))
    )
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—")) if c in cells.columns else F.lit("—")
    explanation = F.concat(
        F.lit("原典判定 "), text("original_score"), F.lit("、原典適合 "), text("original_fit"),
        F.lit("、補助地形 "), text("auxiliary_score"), F.lit("、詳細 "), text("detail_score"),
        F.lit("、周辺 "), text("neighborhood_score"), F.lit("、信頼度 "), text("confidence"),
        F.lit(f"。{names.project}は独立レンズとして表示し、他ProjectのFactと平均・加算しません。"),
    )
    return joined.select(
        "point_id",
        *_layer(
            names,
            F.when(~inside, NOT_APPLICABLE).when(known, AVAILABLE).otherwise(PARTIAL),
            F.when(~inside, UNKNOWN).when(known, COMPLETE).otherwise(SOURCE_LIMITED),
        ),
        F.when(known, _finding_id(names)).alias("finding_id"),
        F.when(known, F.lit("context")).alias("finding_status"),
        F.when(known, F.concat(F.lit(f"{names.project}凍結セル判定: "), label)).alias("title"),
        F.when(known, explanation).alias("explanation"),
        F.when(inside & ~known, _texts((NOT_A_TARGET,))).otherwise(_warnings(names, known)).alias("warnings"),
    )


def map_evidence() -> Column:
    """Finding status of a link (columns evidence_status, identity_decision, index_lane)."""
    evidence = F.lower(F.coalesce("evidence_status", F.lit("")))
    identity = F.lower(F.coalesce("identity_decision", F.lit("")))
    lane = F.col("index_lane")
    return (
        F.when(F.contains(identity, F.lit("conflict")), "conflict")
        .when(evidence.isin("confirmed", "confirmed_positive"), "confirmed")
        .when(F.contains(evidence, F.lit("review")), "source_backed_review")
        .when(F.contains(evidence, F.lit("context")) | F.contains(evidence, F.lit("crosscheck")), "context")
        .when(lane == "REFERENCE_CONTEXT", "context")
        .when(lane == "DUPLICATE_SUPPRESSION", "excluded")
        .otherwise("candidate")
    )


def map_maturity() -> Column:
    """Highest maturity named in a link's stage texts, else by lane."""
    text = F.upper(
        F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("geometry_stage", "query_status", "final_disposition")])
    )
    rungs = F
    for stage in MATURITIES:
        rungs = rungs.when(F.contains(text, F.lit(stage)), stage)
    return (
        rungs.when(F.col("index_lane") == "CURRENT_ANCHOR", "current_only")
        .when(
            F.col("index_lane").isin("REFERENCE_CONTEXT", "SOURCE_OBSERVATION", "PARENT_SITE_COMPONENT"), "context_only"
        )
        .otherwise("unknown")
    )


def map_relation() -> Column:
    """Spatial relation of a link: intersection, buffer, lane context, then distance."""
    relation = F.lower(F.coalesce("relation_type", F.lit("")))
    distance = F.col("distance_m")
    return (
        F.when(bool_like(F.col("intersects")), "intersects")
        .when(F.contains(relation, F.lit("buffer")), "buffer_intersects")
        .when(F.col("index_lane") == "REFERENCE_CONTEXT", "reference_context")
        .when(F.col("index_lane").isin("PARENT_SITE_COMPONENT", "SOURCE_OBSERVATION"), "area_context")
        .when(distance <= 100, "within_100m")
        .when(distance <= 300, "within_300m")
        .when(distance <= 500, "within_500m")
        .when(F.coalesce(F.col("cell_id"), F.lit("")) != "", "cell_context")
        .otherwise("unknown")
    )


def finding_key() -> Column:
    """First non-empty of feature, independence group, source identity and intake id."""
    names = ("global_feature_id", "independence_group", "canonical_source_identity", "intake_id")
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in names])


def overlay_metadata(links: DataFrame, order: str = "link_order") -> DataFrame:
    """cell_id, finding_key and ``metadata``: the maps of all links of a finding laid over each other, the last link wins per key.

    Entries are combined by key before the shuffle, so no finding gathers the maps of its links. A NULL value that is last wins
    like any other; links without a map, or with an empty one, add nothing.
    """
    entries = links.withColumn("finding_key", finding_key()).select("cell_id", "finding_key", order, F.explode("metadata").alias("_k", "_v"))
    last = entries.groupBy("cell_id", "finding_key", "_k").agg(F.max_by("_v", order).alias("_v"))
    laid = F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v"))))
    return last.groupBy("cell_id", "finding_key").agg(laid.alias("metadata"))


def merge_findings(links: DataFrame, payload: list[str], order: str = "link_order") -> DataFrame:
    """One finding per cell and key: the nearest link's columns (unknown distance is infinitely far, the first of
    equals wins), the overlay of all links' metadata and the number of merged links.

    Only algebraic aggregates, so a key that holds a large part of all links is combined before the shuffle.
    Sources are a table of their own, see :func:`finding_sources`.
    """
    far = F.coalesce(F.col("distance_m"), F.lit(float("inf")))
    merged = (
        links.withColumn("finding_key", finding_key())
        .groupBy("cell_id", "finding_key")
        .agg(
            F.min_by(F.struct("distance_m", *payload), F.struct(far, F.col(order))).alias("_n"),
            F.count(F.lit(1)).alias("merged_links"),
        )
        .select("*", "_n.*")
        .drop("_n")
    )
    if "metadata" not in links.columns:
        return merged
    return merged.join(overlay_metadata(links, order), ["cell_id", "finding_key"], "left")


def finding_sources(links: DataFrame, order: str = "link_order") -> DataFrame:
    """Distinct sources per cell and finding; of copies the last title wins. Links without a pointer add nothing."""
    return (
        links.filter(F.coalesce(F.col("source_pointer"), F.lit("")) != "")
        .withColumn("finding_key", finding_key())
        .groupBy("cell_id", "finding_key", "source_project", "source_pointer")
        .agg(F.max_by("source_title", order).alias("source_title"))
    )


def place_findings(links: DataFrame, audience: str, payload: list[str], order: str = "link_order") -> DataFrame:
    """Findings an audience may see, with their classifications."""
    seen = visible_links(links, audience).select(
        "*", map_evidence().alias("status"), map_maturity().alias("maturity"), map_relation().alias("relation")
    )
    return merge_findings(seen, ["status", "maturity", "relation", *payload], order)


def rank_findings(findings: DataFrame) -> DataFrame:
    """Position of each finding in its cell: by distance (unknown last), then by title in Japanese order.

    A cell may hold a large part of all findings: its rows are split by the order itself, see :func:`ordered_rank`.
    """
    keyed = findings.withColumn("_t", F.collate(F.col("title"), "ja"))
    order = [F.asc_nulls_last("distance_m"), F.asc("_t"), F.asc("finding_key")]
    return ordered_rank(keyed, ["cell_id"], order, "position").drop("_t")


QUERYABLE = "FEATURE_LINK_QUERYABLE"
INDEXED_RELATION = (
    "An indexed relation exists for this cell. Feature evidence and geometry maturity remain source-owned and time-scoped."
)
CANDIDATE_RELATION = "Kept as candidate or context. It is not a confirmed local historical positive."

#: Columns of a link that a finding shows; a link table may lack some.
LINK_COLUMNS = (
    "intake_id", "global_feature_id", "external_local_id", "source_title", "feature_class", "index_lane", "geometry_role",
    "uncertainty_m", "location_precision", "independence_group", "canonical_source_identity", "query_status",
)
FINDING_COLUMNS = (
    "cell_id", "layer_id", "finding_id", "position", "project", "global_feature_id", "local_pointer", "title", "category", "status",
    "maturity", "geometry_role", "relation", "distance_m", "uncertainty_m", "valid_from", "valid_to", "public_precision",
    "independence_group", "source_identity", "explanation",
)


def with_columns(frame: DataFrame, names: tuple[str, ...], kind: str = "string") -> DataFrame:
    """The frame with those of the columns that it lacks, as NULLs."""
    return frame.withColumns({n: F.lit(None).cast(kind) for n in names if n not in frame.columns})


def place_records(
    links: DataFrame, features: DataFrame, geometries: DataFrame, audience: str, names: LayerNames = PLACES
) -> DataFrame:
    """Place findings of each cell in the reference's form and order: the nearest link of a finding with its feature and the
    feature's first geometry.

    The title is the feature's name, else the link's source title, local id or intake id. ``finding_key`` comes along.
    """
    known = with_columns(links, LINK_COLUMNS)
    merged = place_findings(known, audience, list(LINK_COLUMNS))
    wide = with_columns(geometries, ("geometry_role", "location_precision", "valid_from", "valid_to"))
    joined = feature_join(merged, features, wide.select("feature_id", "seq", "geometry_role", "location_precision", "valid_from", "valid_to"))
    shape = lambda c: F.col(f"geometry.{c}")
    records = joined.select(
        "cell_id", "finding_key", F.lit(names.layer_id).alias("layer_id"),
        F.concat(F.lit(f"{names.layer_id}:"), "finding_key").alias("finding_id"), F.lit(names.project).alias("project"),
        "global_feature_id", F.coalesce("external_local_id", "intake_id").alias("local_pointer"),
        F.coalesce("canonical_name", "source_title", "external_local_id", "intake_id").alias("title"),
        F.coalesce("feature_type", "feature_class", "index_lane").alias("category"), "status", "maturity",
        F.coalesce(shape("geometry_role"), "geometry_role").alias("geometry_role"), "relation", "distance_m",
        F.col("uncertainty_m").cast("double").alias("uncertainty_m"), shape("valid_from").alias("valid_from"),
        shape("valid_to").alias("valid_to"), F.coalesce(shape("location_precision"), "location_precision").alias("public_precision"),
        "independence_group", F.col("canonical_source_identity").alias("source_identity"),
        F.when(F.col("query_status") == QUERYABLE, INDEXED_RELATION).otherwise(CANDIDATE_RELATION).alias("explanation"),
    )
    return rank_findings(records).select("finding_key", *FINDING_COLUMNS)


def cell_findings(layers: DataFrame, names: tuple[LayerNames, ...]) -> DataFrame:
    """The findings of cell layers (rows of :func:`layer_rows` keyed by cell) in the same form as those of places."""
    by_layer = lambda value, kind="string": F.coalesce(
        *[F.when(F.col("layer_id") == n.layer_id, F.lit(value(n)).cast(kind)) for n in names]
    )
    text = lambda value: F.lit(value).cast("string")
    pointer = by_layer(lambda n: n.sources[0][0] if n.sources else n.layer_id)
    version = F.coalesce("dataset_version", F.lit("current"))
    rows = layers.filter(F.col("finding_id").isNotNull())
    return rows.select(
        "cell_id", "layer_id", "finding_id", F.lit(1).alias("position"), "project", text(None).alias("global_feature_id"),
        F.concat(pointer, F.lit(":"), "cell_id").alias("local_pointer"), "title", by_layer(lambda n: n.category).alias("category"),
        F.col("finding_status").alias("status"), text("context_only").alias("maturity"), text("canonical_100m_cell").alias("geometry_role"),
        text("cell_context").alias("relation"), F.lit(0.0).alias("distance_m"), F.lit(100.0).alias("uncertainty_m"),
        text(None).alias("valid_from"), text(None).alias("valid_to"), text("100m_cell").alias("public_precision"),
        by_layer(lambda n: n.independence_group).alias("independence_group"),
        F.concat("project", F.lit(":"), version, F.lit(":"), "cell_id").alias("source_identity"), "explanation",
    )


def profile_sources(
    findings: DataFrame, links: DataFrame, audience: str, names: tuple[LayerNames, ...], explicit: DataFrame | None = None,
    places: LayerNames = PLACES,
) -> DataFrame:
    """Distinct sources of each cell: explicit ones, then those of its findings in the order of layers and positions; of copies
    (project, pointer, version) the last title stays.

    ``findings``: rows with FINDING_COLUMNS and, for places, ``finding_key``; ``names``: the layers in order.
    """
    order = {n.layer_id: i for i, n in enumerate(names)}
    place = lambda layer: F.coalesce(*[F.when(F.col("layer_id") == k, i) for k, i in order.items()], F.lit(len(order)))
    ord_ = lambda at: F.struct(place("layer_id").alias("layer"), F.col("position").cast("long").alias("position"), at.cast("long").alias("at"))
    text = lambda value: F.lit(value).cast("string")
    own = F.array(
        *[
            F.struct(F.lit(n.layer_id).alias("layer"), F.lit(i).alias("at"), text(p).alias("pointer"), text(t).alias("title"), text(v).alias("version"))
            for n in names
            for i, (p, t, v) in enumerate(n.sources)
        ]
    )
    cells = findings.filter(F.col("layer_id") != places.layer_id).withColumn("s", F.explode(own)).filter(F.col("s.layer") == F.col("layer_id"))
    fixed = cells.select("cell_id", "project", "s.pointer", "s.version", "s.title", ord_(F.col("s.at")).alias("ord"))
    linked = finding_sources(visible_links(links, audience))
    spots = findings.filter(F.col("layer_id") == places.layer_id).select("cell_id", "finding_key", "layer_id", "position")
    found = linked.join(spots, ["cell_id", "finding_key"]).select(
        "cell_id", F.col("source_project").alias("project"), F.col("source_pointer").alias("pointer"), text(None).alias("version"),
        F.col("source_title").alias("title"), ord_(F.lit(0)).alias("ord"),
    )
    every = fixed.unionByName(found)
    if explicit is None:
        explicit = every.limit(0)
    else:
        explicit = explicit.withColumn("ord", F.struct(F.lit(0).alias("layer"), F.lit(0).cast("long").alias("position"), F.col("ord").cast("long").alias("at")))
    return dedupe_sources(explicit, every, key="cell_id")


def place_layer(
    points: DataFrame, index: DataFrame, links: DataFrame, audience: str, names: LayerNames = PLACES, *,
    findings: DataFrame | None = None,
) -> DataFrame:
    """Place record per point (point_id, cell_id): link and finding counts, withheld count, closure status.

    ``findings``: the place findings of the cells, where they are at hand already. Cells absent from the sparse index keep a row
    with the default status; nothing there proves absence.
    """
    counts = hidden_counts(links, audience)
    findings = place_findings(links, audience, []) if findings is None else findings
    merged = findings.groupBy("cell_id").agg(F.count(F.lit(1)).alias("finding_count"))
    per_cell = (
        points.select("cell_id").distinct()
        .join(index.select("cell_id", "index_status", "total_links"), "cell_id", "left")
        .join(counts, "cell_id", "left")
        .join(merged, "cell_id", "left")
        .fillna(0, ["raw_link_count", "hidden_count", "finding_count"])
    )
    joined = lookup_join(points.select("point_id", "cell_id"), per_cell, ["cell_id"])
    missing = F.col("index_status").isNull()
    notes = F.array_compact(
        F.array(
            F.when(
                missing,
                "No indexed relation is currently attached to this cell. Source coverage is partial, so this is not "
                "an absence or safety claim.",
            ),
            F.when(
                F.col("hidden_count") > 0,
                F.concat(
                    F.col("hidden_count").cast("string"),
                    F.lit(" finding(s) are withheld by the public-eligibility policy."),
                ),
            ),
        )
    )
    return joined.select(
        "point_id",
        *_layer(names, F.lit(PARTIAL), F.lit(PARTIAL_SOURCES)),
        F.coalesce("index_status", F.lit(NO_INDEX)).alias("cell_closure_status"),
        F.lit(False).alias("absence_claim_allowed"),
        "raw_link_count",
        "hidden_count",
        "finding_count",
        F.coalesce("total_links", F.lit(0)).alias("indexed_links"),
        F.array_join(notes, " ").alias("warning"),
        notes.alias("warnings"),
    )


def staged_layers(points: DataFrame, staged: list[tuple[str, str, str, str]]) -> DataFrame:
    """Placeholder rows for layers that are not connected yet: (layer_id, project, availability, note)."""
    rows = F.array(
        *[
            F.struct(
                F.lit(layer).alias("layer_id"),
                F.lit(project).alias("project"),
                F.lit(state).alias("availability"),
                F.lit(SOURCE_LIMITED if state == PARTIAL else UNKNOWN).alias("coverage_status"),
                F.lit(NO_EFFECT).alias("scoring_effect"),
                F.lit(None).cast("string").alias("dataset_version"),
                F.lit(note).alias("warning"),
                _texts((note,)).alias("warnings"),
                F.lit("ADAPTER_STAGED" if state == PARTIAL else "FORMAL_RELEASE_PENDING").alias("integration_state"),
            )
            for layer, project, state, note in staged
        ]
    )
    return points.select("point_id", F.explode(rows).alias("l")).select("point_id", "l.*")


def query_anchor(points: DataFrame) -> DataFrame:
    """How each query was anchored: by a matched address or by bare coordinates."""
    matched = F.col("matched_address").isNotNull()
    cell = canonical_cell(F.col("lat"), F.col("lng"))
    return points.select(
        "point_id",
        F.concat(F.lit("query:"), F.replace(format_coordinate(F.col("lat"), F.col("lng")), F.lit(", "), F.lit(","))).alias(
            "anchor_id"
        ),
        F.when(matched, "address_point").otherwise("representative_point").alias("anchor_type"),
        "lat",
        "lng",
        F.when(matched, "GSI_ADDRESS_POINT").otherwise("COORDINATE_INPUT").alias("precision_class"),
        F.when(matched, 100).alias("uncertainty_m"),
        F.when(matched, "GSI_ADDRESS_SEARCH").otherwise("USER_COORDINATE").alias("anchor_source"),
        "matched_address",
        cell.cell_id.alias("cell_id"),
    )


FACT_BUCKETS = ("confirmed", "review", "context", "conflict", "unknown", "not_scanned")


def fact_bucket(status: Column) -> Column:
    return (
        F.when(status.isin("confirmed", "conflict", "not_scanned"), status)
        .when(status.isin("source_backed_review", "candidate"), "review")
        .when(status.isin("context", "excluded"), "context")
        .otherwise("unknown")
    )


def fact_summary(findings: DataFrame, layers: DataFrame, key: str = "point_id") -> DataFrame:
    """Findings per bucket and key; a layer that was not scanned counts as one more not-scanned fact.

    Every key of ``layers`` gets a row.
    """
    facts = findings.select(key, fact_bucket(F.col("status")).alias("bucket"))
    scans = layers.select(key, F.when(F.col("coverage_status") == "not_scanned", "not_scanned").alias("bucket"))
    counts = [F.count(F.when(F.col("bucket") == b, 1)).alias(b) for b in FACT_BUCKETS]
    return facts.unionByName(scans).groupBy(key).agg(*counts)


def dedupe_sources(explicit: DataFrame, found: DataFrame, key: str = "point_id") -> DataFrame:
    """Sources per key, one per project, pointer and version; later ones win and findings come after explicit ones.

    Both sides: key, project, pointer, version, title, ord. Output has ``source_key`` to sort by.
    """
    both = explicit.withColumn("_side", F.lit(0)).unionByName(found.withColumn("_side", F.lit(1)))
    return (
        both.groupBy(key, "project", "pointer", F.coalesce("version", F.lit("")).alias("_v"))
        .agg(F.max_by(F.struct("version", "title"), F.struct("_side", "ord")).alias("_s"))
        .select(
            key, "project", "pointer", "_s.version", "_s.title",
            F.concat_ws("::", "project", "pointer", "_v").alias("source_key"),
        )
    )


LAYER_COLUMNS = (
    "layer_id", "project", "availability", "coverage_status", "scoring_effect", "dataset_version", "finding_id",
    "finding_status", "title", "explanation", "warning", "warnings",
)


def layer_rows(*layers: DataFrame, key: str = "point_id") -> DataFrame:
    """All layers of all points (or cells) in long form with common columns."""
    rows = None
    for layer in layers:
        kind = lambda c: "array<string>" if c == "warnings" else "string"
        columns = [F.col(c) if c in layer.columns else F.lit(None).cast(kind(c)).alias(c) for c in LAYER_COLUMNS]
        part = layer.select(key, *columns)
        rows = part if rows is None else rows.unionByName(part)
    return rows


def compose_cells(layers: DataFrame, place: DataFrame, findings: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per cell: its layers (a fixed handful), coverage, fact counts and the number of findings and sources.

    ``layers`` (a cell's rows of :func:`layer_rows`), ``place`` (:func:`place_layer`), ``findings`` and ``sources`` are all keyed
    by cell_id. Every finding of every layer counts as a fact, and so does every layer that was not scanned.
    """
    per_cell = layers.groupBy("cell_id").agg(
        F.sort_array(F.collect_list(F.struct(*LAYER_COLUMNS))).alias("layers"),
    )
    facts = fact_summary(findings, layers, key="cell_id")
    counted = sources.groupBy("cell_id").agg(F.count(F.lit(1)).alias("source_count"))
    coverage = place.select("cell_id", "cell_closure_status", "absence_claim_allowed", "raw_link_count", "hidden_count", "finding_count")
    both = per_cell.join(facts, "cell_id", "left").join(coverage, "cell_id", "left").join(counted, "cell_id", "left")
    return both.fillna(0, [*FACT_BUCKETS, "source_count"]).withColumn("source_coverage_ceiling", F.lit("PARTIAL_KNOWN_SOURCES"))
