"""Links, findings, layers and the composed location profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from landlens.catalog.base import View, query, up
from landlens.catalog.cell_queries import (
    CATALOG_SQL, ENVIRONMENT_SQL, MOISTURE_SQL, SPARSE_SQL, catalog, environment, moisture, sparse_index,
)
from landlens.catalog.geo_queries import CELL_SQL
from landlens.catalog.inputs import FEATURES, GEOMETRIES, LINKS, LIVE_POINTS, PROFILE_POINTS, ZOOM
from landlens.catalog.inputs import POINTS as SCOPED_POINTS
from landlens.catalog.risk_queries import LAND_SQL, WEIGHT
from landlens.catalog.risk_queries import inputs as risk_inputs
from landlens.catalog.spatial_queries import CODES_SQL, SCOPE_SQL, municipality_codes
from landlens.catalog.terrain_queries import THEORY
from landlens.operators import filters, lookups, profile, quality
from landlens.plans.diagnose import diagnose_requests
from landlens.plans.profile import build_profile

VISIBLE = "lower(trim(public_eligible)) IN ('true', 'yes', '1')"


@query(
    "visible_links",
    f"""SELECT cell_id, count(*) AS raw_link_count, count(*) FILTER (NOT coalesce({VISIBLE}, false)) AS hidden_count FROM {LINKS.sql} GROUP BY 1""",
)
def visible_links(spark, sf_dir):
    return filters.hidden_counts(LINKS.frame(spark, sf_dir), "public")


@query(
    "feature_join",
    f"""SELECT l.intake_id, l.link_order, f.canonical_name, f.feature_type, g.geometry_role, g.location_precision FROM {LINKS.sql} l
LEFT JOIN {FEATURES.sql} f ON l.global_feature_id = f.feature_id LEFT JOIN (
  SELECT feature_id, arg_min(geometry_role, seq) AS geometry_role, arg_min(location_precision, seq) AS location_precision FROM {GEOMETRIES.sql} GROUP BY 1) g
ON f.feature_id = g.feature_id""",
)
def feature_join(spark, sf_dir):
    links = LINKS.frame(spark, sf_dir).select("intake_id", "link_order", "global_feature_id")
    out = lookups.feature_join(links, FEATURES.frame(spark, sf_dir), GEOMETRIES.frame(spark, sf_dir))
    return out.select("intake_id", "link_order", "canonical_name", "feature_type", "geometry.*")


CLASSES = """CASE WHEN contains(lower(coalesce(identity_decision, '')), 'conflict') THEN 'conflict'
    WHEN lower(coalesce(evidence_status, '')) IN ('confirmed', 'confirmed_positive') THEN 'confirmed'
    WHEN contains(lower(coalesce(evidence_status, '')), 'review') THEN 'source_backed_review'
    WHEN contains(lower(coalesce(evidence_status, '')), 'context') OR contains(lower(coalesce(evidence_status, '')), 'crosscheck') THEN 'context'
    WHEN index_lane = 'REFERENCE_CONTEXT' THEN 'context' WHEN index_lane = 'DUPLICATE_SUPPRESSION' THEN 'excluded' ELSE 'candidate' END AS status,
  CASE """ + " ".join(
    f"WHEN contains(upper(concat_ws(' ', geometry_stage, query_status, final_disposition)), '{s}') THEN '{s}'" for s in profile.MATURITIES
) + """ WHEN index_lane = 'CURRENT_ANCHOR' THEN 'current_only'
    WHEN index_lane IN ('REFERENCE_CONTEXT', 'SOURCE_OBSERVATION', 'PARENT_SITE_COMPONENT') THEN 'context_only' ELSE 'unknown' END AS maturity,
  CASE WHEN lower(trim(intersects)) IN ('true', 'yes', '1') THEN 'intersects' WHEN contains(lower(relation_type), 'buffer') THEN 'buffer_intersects'
    WHEN index_lane = 'REFERENCE_CONTEXT' THEN 'reference_context' WHEN index_lane IN ('PARENT_SITE_COMPONENT', 'SOURCE_OBSERVATION') THEN 'area_context'
    WHEN distance_m <= 100 THEN 'within_100m' WHEN distance_m <= 300 THEN 'within_300m' WHEN distance_m <= 500 THEN 'within_500m' ELSE 'cell_context' END AS relation"""


@query("link_classes", f"SELECT intake_id, {CLASSES} FROM {LINKS.sql}")
def link_classes(spark, sf_dir):
    return LINKS.frame(spark, sf_dir).select(
        "intake_id", profile.map_evidence().alias("status"), profile.map_maturity().alias("maturity"),
        profile.map_relation().alias("relation"),
    )


KEY = "coalesce(nullif(global_feature_id, ''), nullif(independence_group, ''), nullif(canonical_source_identity, ''), nullif(intake_id, ''))"
FINDINGS_SQL = f"""(SELECT cell_id, finding_key, distance_m, status, maturity, relation, source_title AS title, merged_links FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_id, finding_key ORDER BY coalesce(distance_m, 'inf'::DOUBLE), link_order) AS k,
         count(*) OVER (PARTITION BY cell_id, finding_key) AS merged_links
  FROM (SELECT *, {KEY} AS finding_key, {CLASSES} FROM {LINKS.sql} WHERE coalesce({VISIBLE}, false))) WHERE k = 1)"""


def findings(spark, sf_dir):
    out = profile.place_findings(LINKS.frame(spark, sf_dir), "public", ["source_title"])
    return out.withColumnRenamed("source_title", "title")


@query("merge_findings", f"SELECT * FROM {FINDINGS_SQL}")
def merge_findings(spark, sf_dir):
    return findings(spark, sf_dir)


@query(
    "rank_findings",
    f"""SELECT cell_id, finding_key, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY distance_m NULLS LAST, title, finding_key) AS INTEGER) AS position
FROM {FINDINGS_SQL}""",
)
def rank_findings(spark, sf_dir):
    return profile.rank_findings(findings(spark, sf_dir)).select("cell_id", "finding_key", "position")


@query(
    "finding_sources",
    f"""SELECT cell_id, {KEY} AS finding_key, source_project, source_pointer, arg_max(source_title, link_order) AS source_title
FROM {LINKS.sql} WHERE coalesce(source_pointer, '') <> '' GROUP BY 1, 2, 3, 4""",
)
def finding_sources(spark, sf_dir):
    return profile.finding_sources(LINKS.frame(spark, sf_dir))


SCANS_SQL = f"(SELECT cell_id, CASE WHEN total_links % 3 = 0 THEN 'not_scanned' ELSE 'partial_known_sources' END AS coverage_status FROM {SPARSE_SQL})"


@query(
    "fact_summary",
    f"""WITH b AS (SELECT cell_id, CASE WHEN status IN ('confirmed', 'conflict', 'not_scanned') THEN status WHEN status IN ('source_backed_review', 'candidate') THEN 'review'
    WHEN status IN ('context', 'excluded') THEN 'context' ELSE 'unknown' END AS bucket FROM {FINDINGS_SQL}
  UNION ALL SELECT cell_id, CASE WHEN coverage_status = 'not_scanned' THEN 'not_scanned' END FROM {SCANS_SQL})
SELECT cell_id, {", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in profile.FACT_BUCKETS)} FROM b GROUP BY 1""",
)
def fact_summary(spark, sf_dir):
    scans = sparse_index(spark, sf_dir).select(
        "cell_id",
        F.when(F.col("total_links") % 3 == 0, "not_scanned").otherwise("partial_known_sources").alias("coverage_status"),
    )
    return profile.fact_summary(findings(spark, sf_dir), scans, key="cell_id")


SOURCE_COLUMNS = "cell_id, source_project AS project, source_pointer AS pointer, CASE WHEN l % 2 = 0 THEN 'v1' END AS version, source_title AS title, link_order AS ord"
SOURCES = f"SELECT {SOURCE_COLUMNS} FROM (SELECT *, length(intake_id) AS l FROM {{links}})"


#: Explicit sources name documents by the title's length, which meets some of the links' pointers.
EXPLICIT = "cell_id, project, concat('src:', CAST(length(title) AS STRING)) AS pointer, version, concat('explicit ', title) AS title, ord"


@query(
    "dedupe_sources",
    f"""WITH f AS ({SOURCES.replace("{links}", LINKS.sql)}), e AS (SELECT {EXPLICIT.replace("STRING", "VARCHAR")} FROM f)
SELECT cell_id, project, pointer, version, title, concat_ws('::', project, pointer, coalesce(version, '')) AS source_key FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_id, project, pointer, version ORDER BY side DESC, ord DESC) AS k
  FROM (SELECT *, 0 AS side FROM e UNION ALL BY NAME SELECT *, 1 AS side FROM f)) WHERE k = 1""",
)
def dedupe_sources(spark, sf_dir):
    rows = spark.sql(SOURCES, links=LINKS.frame(spark, sf_dir))
    explicit = spark.sql(f"SELECT {EXPLICIT} FROM {{rows}}", rows=rows)
    return profile.dedupe_sources(explicit, rows, key="cell_id")


def text_case(table: dict[str, str], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {column} END"


POINTS_SQL = f"""(SELECT *, concat('g', grid_row, '-', grid_col) AS cell_id FROM (SELECT *, {CELL_SQL[0]} AS grid_row, {CELL_SQL[1]} AS grid_col FROM {PROFILE_POINTS.sql}))"""


def points(spark, sf_dir):
    return profile.with_cell(PROFILE_POINTS.frame(spark, sf_dir))


def pct(c: str) -> str:
    return f"concat(CAST(floor({c} * 100e0 + 0.5e0) AS BIGINT), '%')"


ENV_LAYER_SQL = f"""(SELECT p.point_id, CASE WHEN e.cell_id IS NULL THEN 'not_applicable' WHEN plateau_status = 'UNKNOWN_SOURCE_TILE_404' THEN 'partial' ELSE 'available' END AS availability,
  CASE WHEN e.cell_id IS NULL THEN 'unknown' WHEN plateau_status = 'UNKNOWN_SOURCE_TILE_404' THEN 'partial_known_sources' ELSE 'complete_for_defined_sources' END AS coverage_status,
  CASE WHEN e.cell_id IS NOT NULL THEN concat('ENVIRONMENT-CELL-', substr(e.cell_id, 2)) END AS finding_id,
  CASE WHEN e.cell_id IS NOT NULL THEN CASE WHEN robust_residential OR robust_candidate THEN 'candidate' ELSE 'context' END END AS finding_status,
  CASE WHEN e.cell_id IS NOT NULL THEN concat('P25判定は「', {text_case(profile.STATE_TEXT, "aggregate_state")}, '」。好条件', favorable_pillars, '、注意', caution_pillars, '、判明', known_pillars, '/4柱。 ',
    CASE WHEN robust_residential AND core_zone THEN trim(concat('{profile.CORE_CANDIDATE} ', coalesce(zone_id, ''))) WHEN robust_residential THEN trim(concat('{profile.SPOT_CANDIDATE} ', coalesce(zone_id, '')))
         WHEN robust_candidate THEN '{profile.ENVIRONMENT_ONLY}' ELSE '{profile.NOT_ROBUST}' END, '。 周囲の頑健候補比率は300m ', {pct("share_300m")}, '、500m ', {pct("share_500m")}, '。 住宅文脈は「',
    {text_case(profile.TIER_TEXT, "residential_tier")}, '」。 ', CASE plateau_status WHEN 'UNKNOWN_SOURCE_TILE_404' THEN '{profile.PLATEAU_HOLE}' WHEN 'EXPLICIT_NO_BUILDINGS' THEN '{profile.PLATEAU_EMPTY}' ELSE '{profile.PLATEAU_CONNECTED}' END) END AS explanation
 FROM {POINTS_SQL} p LEFT JOIN {ENVIRONMENT_SQL} e ON p.cell_id = e.cell_id)"""
LAYER = ("point_id", "availability", "coverage_status", "finding_id", "finding_status", "explanation")


@query("environment_layer", f"SELECT * FROM {ENV_LAYER_SQL}")
def environment_layer(spark, sf_dir):
    return profile.environment_layer(points(spark, sf_dir), environment(spark, sf_dir)).select(*LAYER)


MOISTURE_LAYER_SQL = f"""(SELECT p.point_id, CASE WHEN m.cell_id IS NULL THEN 'not_applicable' WHEN m.coverage_status = 'outside_jurisdiction_adapter_coverage' THEN 'partial' ELSE 'available' END AS availability,
  CASE WHEN m.cell_id IS NULL THEN 'unknown' WHEN m.coverage_status = 'full_single_class' THEN 'complete_for_defined_sources' WHEN m.coverage_status = 'outside_jurisdiction_adapter_coverage' THEN 'source_limited' ELSE 'partial_known_sources' END AS coverage_status,
  CASE WHEN m.cell_id IS NOT NULL THEN concat('MOISTURE-CELL-', substr(m.cell_id, 2)) END AS finding_id, CASE WHEN m.cell_id IS NOT NULL THEN 'context' END AS finding_status,
  CASE WHEN m.cell_id IS NOT NULL THEN concat('水・湿気の確認目安は「', {text_case(profile.ATTENTION_TEXT, "attention_class")}, '」。地域地下水は「', {text_case(profile.GROUNDWATER_TEXT, "groundwater_band")},
    '」、歴史水・地形の文脈は「', {text_case(profile.WATER_TEXT, "historical_water_context")}, '」。これは100mセルの居住確認用contextで、地下水モデル値を敷地直下の実測水位とは扱いません。') END AS explanation,
  CASE WHEN public_evidence_status <> 'materialized' THEN '{profile.PENDING_NOTE}' END AS warning
 FROM {POINTS_SQL} p LEFT JOIN {MOISTURE_SQL} m ON p.cell_id = m.cell_id)"""


@query("moisture_layer", f"SELECT * FROM {MOISTURE_LAYER_SQL}")
def moisture_layer(spark, sf_dir):
    return profile.moisture_layer(points(spark, sf_dir), moisture(spark, sf_dir)).select(*LAYER, "warning")


GRID_ROWS_SQL = f"(SELECT max(grid_row) + 1 FROM {CATALOG_SQL})"
LABELS = "['判定材料不足', 'イヤシロチ候補', 'ケガレチ候補', '普通地', '高低混在', '通常・弱い傾向']"
CATALOG_LAYER_SQL = f"""(SELECT point_id, CASE WHEN NOT inside THEN 'not_applicable' WHEN known THEN 'available' ELSE 'partial' END AS availability,
  CASE WHEN NOT inside THEN 'unknown' WHEN known THEN 'complete_for_defined_sources' ELSE 'source_limited' END AS coverage_status,
  CASE WHEN known THEN concat('CATALOG-CELL-', substr(cell_id, 2)) END AS finding_id, CASE WHEN known THEN 'context' END AS finding_status,
  CASE WHEN known THEN concat('CATALOG凍結セル判定: ', {LABELS}[label_code + 1]) END AS title,
  CASE WHEN known THEN concat('原典判定 ', coalesce(CAST(original_score AS VARCHAR), '—'), '、原典適合 —、補助地形 —、詳細 ', coalesce(CAST(detail_score AS VARCHAR), '—'),
    '、周辺 —、信頼度 —。CATALOGは独立レンズとして表示し、他ProjectのFactと平均・加算しません。') END AS explanation
 FROM (SELECT p.*, v.label_code, v.detail_score, v.original_score, p.grid_row < {GRID_ROWS_SQL} AS inside,
    p.grid_row < {GRID_ROWS_SQL} AND v.label_code IS NOT NULL AS known FROM {POINTS_SQL} p LEFT JOIN {CATALOG_SQL} v ON p.cell_id = v.cell_id))"""


def catalog_rows(spark, sf_dir):
    cells = catalog(spark, sf_dir)
    rows = cells.agg(F.max("grid_row") + 1).scalar()
    return profile.catalog_layer(points(spark, sf_dir), cells, rows, 462)


@query("catalog_layer", f"SELECT * FROM {CATALOG_LAYER_SQL}")
def catalog_layer(spark, sf_dir):
    return catalog_rows(spark, sf_dir).select(*LAYER, "title")


PLACE_SQL = f"""(SELECT p.point_id, coalesce(i.index_status, 'NO_INDEXED_CANDIDATE_SOURCE_LIMITED') AS cell_closure_status, false AS absence_claim_allowed,
  coalesce(c.raw_link_count, 0) AS raw_link_count, coalesce(c.hidden_count, 0) AS hidden_count, coalesce(f.finding_count, 0) AS finding_count,
  coalesce(i.total_links, 0) AS indexed_links FROM {POINTS_SQL} p LEFT JOIN {SPARSE_SQL} i ON p.cell_id = i.cell_id
 LEFT JOIN (SELECT cell_id, count(*) AS raw_link_count, count(*) FILTER (NOT coalesce({VISIBLE}, false)) AS hidden_count FROM {LINKS.sql} GROUP BY 1) c ON p.cell_id = c.cell_id
 LEFT JOIN (SELECT cell_id, count(*) AS finding_count FROM {FINDINGS_SQL} GROUP BY 1) f ON p.cell_id = f.cell_id)"""


def place_rows(spark, sf_dir):
    return profile.place_layer(points(spark, sf_dir), sparse_index(spark, sf_dir), LINKS.frame(spark, sf_dir), "public")


@query("place_layer", f"SELECT * FROM {PLACE_SQL}")
def place_layer(spark, sf_dir):
    return place_rows(spark, sf_dir).select(
        "point_id", "cell_closure_status", "absence_claim_allowed", "raw_link_count", "hidden_count", "finding_count",
        "indexed_links",
    )


STAGED = [
    ("terrain_history", "TERRAIN", "partial", "Contracts are staged; missing evidence remains unknown."),
    ("folklore", "FOLKLORE", "partial", "Partial, cohort-backed."),
    ("boundary", "BOUNDARY", "not_available", "Release pending."),
]
STAGED_VALUES = ", ".join(
    f"('{a}', '{b}', '{s}', '{n}', '{'source_limited' if s == 'partial' else 'unknown'}', '{'ADAPTER_STAGED' if s == 'partial' else 'FORMAL_RELEASE_PENDING'}')"
    for a, b, s, n in STAGED
)


@query(
    "staged_layers",
    f"""SELECT point_id, s.*, 'none' AS scoring_effect FROM {PROFILE_POINTS.sql},
(VALUES {STAGED_VALUES}) s(layer_id, project, availability, warning, coverage_status, integration_state)""",
)
def staged_layers(spark, sf_dir):
    return profile.staged_layers(points(spark, sf_dir), STAGED).drop("dataset_version", "warnings")


@query(
    "query_anchor",
    f"""SELECT point_id, printf('query:%.6f,%.6f', lat, lng) AS anchor_id, CASE WHEN m THEN 'address_point' ELSE 'representative_point' END AS anchor_type,
  CASE WHEN m THEN 'GSI_ADDRESS_POINT' ELSE 'COORDINATE_INPUT' END AS precision_class, CASE WHEN m THEN 100 END AS uncertainty_m,
  CASE WHEN m THEN 'GSI_ADDRESS_SEARCH' ELSE 'USER_COORDINATE' END AS anchor_source, matched_address, cell_id FROM (SELECT *, matched_address IS NOT NULL AS m FROM {POINTS_SQL})""",
)
def query_anchor(spark, sf_dir):
    return profile.query_anchor(PROFILE_POINTS.frame(spark, sf_dir)).drop("lat", "lng")


#: Metadata of links: one entry for all, one for some, one whose name depends on the link; values may be NULL.
def metadata_of():
    entry = lambda k, v: F.create_map(k, v)
    some = F.length("intake_id") % 3 != 0
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.map_concat(
        entry(F.lit("lane"), F.col("index_lane")),
        F.when(some, entry(F.lit("evidence"), F.col("evidence_status"))).otherwise(nothing),
        entry(F.concat(F.lit("query_"), F.col("source_project")), F.col("query_status")),
    )


@query(
    "finding_metadata",
    f"""WITH l AS (SELECT *, {KEY} AS finding_key FROM {LINKS.sql} WHERE coalesce({VISIBLE}, false)),
e AS (SELECT cell_id, finding_key, link_order, 'lane' AS name, index_lane AS value FROM l
  UNION ALL SELECT cell_id, finding_key, link_order, 'evidence', evidence_status FROM l WHERE length(intake_id) % 3 <> 0
  UNION ALL SELECT cell_id, finding_key, link_order, concat('query_', source_project), query_status FROM l)
SELECT cell_id, finding_key, name, value FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, finding_key, name ORDER BY link_order DESC) AS k FROM e) WHERE k = 1""",
)
def finding_metadata(spark, sf_dir):
    """Metadata of merged findings: the maps of all links laid over each other."""
    links = LINKS.frame(spark, sf_dir).withColumn("metadata", metadata_of())
    out = profile.place_findings(links, "public", [])
    return out.select("cell_id", "finding_key", F.explode("metadata").alias("name", "value"))


CELLS_SQL = f"(SELECT DISTINCT cell_id FROM {POINTS_SQL})"
PLACE_RECORDS_SQL = f"""(SELECT cell_id, finding_key, 'places' AS layer_id, concat('places:', finding_key) AS finding_id,
  CAST(row_number() OVER (PARTITION BY cell_id ORDER BY distance_m NULLS LAST, lower(title), finding_key) AS INTEGER) AS position, 'PLACES' AS project, intake_id AS local_pointer,
  title, category, status, maturity, geometry_role, relation, distance_m, CAST(NULL AS DOUBLE) AS uncertainty_m, location_precision AS public_precision, independence_group, CAST(NULL AS VARCHAR) AS source_identity,
  CASE WHEN query_status = 'FEATURE_LINK_QUERYABLE' THEN '{profile.INDEXED_RELATION}' ELSE '{profile.CANDIDATE_RELATION}' END AS explanation
 FROM (SELECT n.*, coalesce(f.canonical_name, n.source_title, n.intake_id) AS title, coalesce(f.feature_type, n.index_lane) AS category, g.geometry_role, g.location_precision FROM (
   SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, finding_key ORDER BY coalesce(distance_m, 'inf'::DOUBLE), link_order) AS k
     FROM (SELECT *, {KEY} AS finding_key, {CLASSES} FROM {LINKS.sql} WHERE coalesce({VISIBLE}, false) AND cell_id IN (SELECT cell_id FROM {CELLS_SQL}))) WHERE k = 1) n
  LEFT JOIN {FEATURES.sql} f ON n.global_feature_id = f.feature_id LEFT JOIN (SELECT feature_id, arg_min(geometry_role, seq) AS geometry_role, arg_min(location_precision, seq) AS location_precision
   FROM {GEOMETRIES.sql} GROUP BY 1) g ON f.feature_id = g.feature_id))"""


def _cell_findings_sql(layer: str, project: str, source: str, title: str, status: str, explanation: str, group: str, category: str) -> str:
    return f"""SELECT c.cell_id, CAST(NULL AS VARCHAR) AS finding_key, '{layer}' AS layer_id, concat('{project}-CELL-', substr(c.cell_id, 2)) AS finding_id, 1 AS position, '{project}' AS project,
  concat('{source}:', c.cell_id) AS local_pointer, {title} AS title, '{category}' AS category, {status} AS status, 'context_only' AS maturity, 'canonical_100m_cell' AS geometry_role,
  'cell_context' AS relation, 0e0 AS distance_m, 100e0 AS uncertainty_m, '100m_cell' AS public_precision, '{group}' AS independence_group, concat('{project}:current:', c.cell_id) AS source_identity, {explanation} AS explanation"""


ALL_FINDINGS_SQL = f"""(SELECT * FROM {PLACE_RECORDS_SQL}
UNION ALL BY NAME {_cell_findings_sql("environment", "ENVIRONMENT", "environment-cells", f"concat('ENVIRONMENT環境・住宅候補: ', {text_case(profile.STATE_TEXT, 'aggregate_state')})",
  "CASE WHEN robust_residential OR robust_candidate THEN 'candidate' ELSE 'context' END", "l.explanation", "ENVIRONMENT_CELLS", "environmental_and_residential_candidate_context")}
 FROM {CELLS_SQL} c JOIN {ENVIRONMENT_SQL} e ON c.cell_id = e.cell_id JOIN (SELECT p.cell_id, any_value(explanation) AS explanation FROM {ENV_LAYER_SQL} JOIN {POINTS_SQL} p USING (point_id) GROUP BY 1) l ON l.cell_id = c.cell_id
UNION ALL BY NAME {_cell_findings_sql("moisture", "MOISTURE", "moisture-cells", f"concat('MOISTURE 水・湿気カード: ', {text_case(profile.ATTENTION_TEXT, 'attention_class')})", "'context'", "l.explanation", "MOISTURE_CELLS", "underground_water_moisture_context")}
 FROM {CELLS_SQL} c JOIN {MOISTURE_SQL} m ON c.cell_id = m.cell_id JOIN (SELECT p.cell_id, any_value(explanation) AS explanation FROM {MOISTURE_LAYER_SQL} JOIN {POINTS_SQL} p USING (point_id) GROUP BY 1) l ON l.cell_id = c.cell_id
UNION ALL BY NAME {_cell_findings_sql("catalog", "CATALOG", "catalog-cells", "l.title", "'context'", "l.explanation", "FROZEN_CATALOG", "terrain_hypothesis_context")}
 FROM {CELLS_SQL} c JOIN (SELECT p.cell_id, any_value(explanation) AS explanation, any_value(title) AS title FROM {CATALOG_LAYER_SQL} JOIN {POINTS_SQL} p USING (point_id) WHERE finding_id IS NOT NULL GROUP BY 1) l ON l.cell_id = c.cell_id)"""

#: Sources that callers name themselves; some are the links' own and give way to them.
EXPLICIT_SOURCES = "cell_id, concat('P', CAST(total_links % 4 AS STRING)) AS project, concat('src:', CAST(total_links AS STRING)) AS pointer, CAST(NULL AS STRING) AS version, 'explicit' AS title, 0 AS ord"
FIXED_SOURCES = ", ".join(
    f"('{n.layer_id}', '{n.project}', '{p}', '{t}', {'NULL' if v is None else repr(v)}, {i})"
    for n in (profile.CATALOG, profile.MOISTURE, profile.ENVIRONMENT)
    for i, (p, t, v) in enumerate(n.sources)
)
ALL_SOURCES_SQL = f"""(WITH a AS MATERIALIZED (SELECT * FROM {ALL_FINDINGS_SQL}),
linked AS (SELECT cell_id, {KEY} AS finding_key, source_project AS project, source_pointer AS pointer, arg_max(source_title, link_order) AS title
  FROM {LINKS.sql} WHERE coalesce(source_pointer, '') <> '' AND coalesce({VISIBLE}, false) GROUP BY 1, 2, 3, 4),
s AS (SELECT {EXPLICIT_SOURCES.replace("STRING", "VARCHAR")}, 0 AS side, 0 AS place FROM {SPARSE_SQL} WHERE cell_id IN (SELECT cell_id FROM {CELLS_SQL})
  UNION ALL BY NAME SELECT a.cell_id, f.project, f.pointer, f.version, f.title, f.i AS ord, 1 AS side, 1 AS place FROM a JOIN (VALUES {FIXED_SOURCES}) f(layer_id, project, pointer, title, version, i) ON a.layer_id = f.layer_id
  UNION ALL BY NAME SELECT l.cell_id, l.project, l.pointer, NULL AS version, l.title, 0 AS ord, 1 AS side, a.position AS place FROM linked l JOIN a ON a.layer_id = 'places' AND a.cell_id = l.cell_id AND a.finding_key = l.finding_key)
SELECT cell_id, project, pointer, version, title, concat_ws('::', project, pointer, coalesce(version, '')) AS source_key FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_id, project, pointer, version ORDER BY side DESC, place DESC, ord DESC) AS k FROM s) WHERE k = 1)"""


def whole_profile(spark, sf_dir, **more):
    cells = catalog(spark, sf_dir)
    index = sparse_index(spark, sf_dir)
    return build_profile(
        PROFILE_POINTS.frame(spark, sf_dir),
        environment=environment(spark, sf_dir),
        moisture=moisture(spark, sf_dir),
        catalog=cells,
        catalog_rows=cells.agg(F.max("grid_row") + 1).scalar(),
        index=index,
        links=LINKS.frame(spark, sf_dir),
        features=FEATURES.frame(spark, sf_dir),
        geometries=GEOMETRIES.frame(spark, sf_dir),
        staged=STAGED,
        audience="public",
        explicit_sources=index.selectExpr(*_split(EXPLICIT_SOURCES)),
        **more,
    )


def _split(columns: str) -> list[str]:
    """The columns of a select list whose expressions hold no commas outside parentheses."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(columns + ","):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(columns[start:i].strip())
            start = i + 1
    return out


FINDING_SHOWN = (
    "cell_id", "layer_id", "finding_id", "position", "project", "local_pointer", "title", "category", "status", "maturity",
    "geometry_role", "relation", "distance_m", "uncertainty_m", "public_precision", "independence_group", "source_identity",
    "explanation",
)


@query("profile_findings", f"SELECT {', '.join(FINDING_SHOWN)} FROM {ALL_FINDINGS_SQL}")
def profile_findings(spark, sf_dir):
    """Every finding of every layer of the points' cells: places with feature, geometry and title, and cell records."""
    return whole_profile(spark, sf_dir).findings.select(*FINDING_SHOWN)


@query("profile_sources", f"SELECT * FROM {ALL_SOURCES_SQL}")
def profile_sources(spark, sf_dir):
    """Distinct sources of each cell, explicit ones and those of all findings."""
    return whole_profile(spark, sf_dir).sources


COUNTED = ("confirmed", "review", "context", "conflict", "unknown")
BUCKETS_SQL = """count(*) FILTER ({status} = 'confirmed') AS confirmed, count(*) FILTER ({status} IN ('source_backed_review', 'candidate')) AS review,
  count(*) FILTER ({status} IN ('context', 'excluded')) AS context, count(*) FILTER ({status} = 'conflict') AS conflict,
  count(*) FILTER ({status} NOT IN ('confirmed', 'source_backed_review', 'candidate', 'context', 'excluded', 'conflict', 'not_scanned')) AS unknown"""
PROFILE_CODES_SQL = CODES_SQL.replace(SCOPED_POINTS.sql, PROFILE_POINTS.sql)
PROFILE_SCOPE_SQL = f"""(SELECT point_id, lat, lng, CASE WHEN NOT inside THEN false WHEN NOT hit THEN true
    ELSE c5 BETWEEN '13101' AND '13123' OR c5 BETWEEN '14100' AND '14118' OR c5 BETWEEN '14130' AND '14137' END AS supported,
  CASE WHEN hit THEN c5 END AS municipality_code, CASE WHEN hit THEN address END AS address FROM (
  SELECT p.*, c.admin_code, c.address, coalesce(NOT c.failed, false) AND inside AS hit, substring(c.admin_code, 1, 5) AS c5 FROM (SELECT *, ({SCOPE_SQL}) AS inside FROM {POINTS_SQL}) p
  LEFT JOIN {PROFILE_CODES_SQL} c ON p.inside AND p.cell_id = c.cell_id))"""
DIAGNOSED_SQL = f"(SELECT point_id, lat, lng FROM {PROFILE_SCOPE_SQL} WHERE supported)"
PROFILE_THEORY = THEORY.replace(f"SELECT DISTINCT lat, lng FROM {LIVE_POINTS.sql}", f"SELECT DISTINCT lat, lng FROM {DIAGNOSED_SQL}")
PROFILE_LAND_SQL = LAND_SQL.replace(LIVE_POINTS.sql, DIAGNOSED_SQL)


@query(
    "location_profile",
    f"""{PROFILE_THEORY}, l AS (
  SELECT point_id, 'environment' AS layer_id, availability, coverage_status FROM {ENV_LAYER_SQL}
  UNION ALL SELECT point_id, 'moisture', availability, coverage_status FROM {MOISTURE_LAYER_SQL}
  UNION ALL SELECT point_id, 'catalog', availability, coverage_status FROM {CATALOG_LAYER_SQL}
  UNION ALL SELECT point_id, 'places', 'partial', 'partial_known_sources' FROM {PLACE_SQL}
  UNION ALL SELECT point_id, s.layer_id, s.availability, s.coverage_status FROM {PROFILE_POINTS.sql}, (VALUES {STAGED_VALUES}) s(layer_id, project, availability, warning, coverage_status, integration_state)),
la AS (SELECT point_id, string_agg(concat(layer_id, '=', availability, '/', coverage_status), '|' ORDER BY layer_id) AS layers FROM l GROUP BY 1),
fa AS MATERIALIZED (SELECT * FROM {ALL_FINDINGS_SQL}),
fc AS (SELECT cell_id, {BUCKETS_SQL.format(status="status")} FROM fa GROUP BY 1),
sc AS (SELECT cell_id, count(*) AS source_count FROM {ALL_SOURCES_SQL} GROUP BY 1),
dg AS (SELECT point_id, t.detail_score AS score, m.modern_score, {WEIGHT} AS wt, coalesce(m.water_risk, 0) >= 80 OR coalesce(m.slope_risk, 0) >= 80 AS capped
  FROM {DIAGNOSED_SQL} p JOIN theory t USING (lat, lng) JOIN (SELECT * EXCLUDE (point_id), point_id AS pid FROM {PROFILE_LAND_SQL}) m ON p.point_id = m.pid),
ds AS (SELECT *, {up("least(CASE WHEN capped THEN 39e0 ELSE 100e0 END, wt * score + (1e0 - wt) * modern_score)")} AS combined_score FROM dg)
SELECT p.point_id, p.cell_id, la.layers, {", ".join(f"coalesce(fc.{b}, 0) AS {b}" for b in COUNTED)}, k.cell_closure_status, k.finding_count, coalesce(sc.source_count, 0) AS source_count,
  'PARTIAL_KNOWN_SOURCES' AS source_coverage_ceiling, o.supported, o.municipality_code, o.address, ds.score, ds.modern_score, ds.combined_score, ds.capped
FROM {POINTS_SQL} p JOIN la USING (point_id) JOIN {PLACE_SQL} k USING (point_id) JOIN {PROFILE_SCOPE_SQL} o USING (point_id)
LEFT JOIN fc ON fc.cell_id = p.cell_id LEFT JOIN sc ON sc.cell_id = p.cell_id LEFT JOIN ds ON ds.point_id = p.point_id""",
)
def location_profile(spark, sf_dir):
    """Whole profile plan: cell, four connected layers, staged layers, facts, sources, coverage, scope and diagnosis per point."""
    points_ = PROFILE_POINTS.frame(spark, sf_dir)
    codes = municipality_codes(points_.select("point_id", "lat", "lng"))
    hazards, pixels, mesh = risk_inputs(spark, sf_dir)
    found = diagnose_requests(
        points_.select("point_id", "lat", "lng"), codes, pixels, hazards, mesh, dem_zoom=ZOOM, slope_zoom=ZOOM, hazard_zoom=ZOOM
    )
    out = whole_profile(spark, sf_dir, cell_codes=codes, diagnosis=found.diagnoses).points
    brief = F.transform(
        "layers", lambda x: F.concat(x["layer_id"], F.lit("="), x["availability"], F.lit("/"), x["coverage_status"])
    )
    return out.select(
        "point_id", "cell_id", F.array_join(brief, "|").alias("layers"), *COUNTED, "cell_closure_status",
        "finding_count", "source_count", "source_coverage_ceiling", "supported", "municipality_code", "address", "score",
        "modern_score", "combined_score", "capped",
    )


#: Layers and findings with deliberate breaks of the contract.
BROKEN_LAYERS = "SELECT o_custkey AS point_id, CONCAT('L', CAST(o_orderkey % 40 AS STRING)) AS layer_id, CASE WHEN o_orderkey % 101 = 0 THEN 'score' ELSE 'none' END AS scoring_effect FROM {orders}"
BROKEN_FINDINGS = "SELECT o_custkey AS point_id, 'L1' AS layer_id, CASE WHEN o_orderkey % 89 = 0 THEN '' ELSE CONCAT('F', CAST(o_orderkey % 60 AS STRING)) END AS finding_id FROM {orders}"
BROKEN_POINTS = "SELECT c_custkey AS point_id, c_acctbal / 50e0 AS lat, 139e0 AS lng, CONCAT('g', CAST(c_custkey % 9 AS STRING)) AS anchor_cell_id, CONCAT('g', CAST(c_custkey % 7 AS STRING)) AS cell_id FROM {customer}"


def duck(text: str) -> str:
    return "(" + text.replace("{", "").replace("}", "").replace("STRING", "VARCHAR") + ")"


@query(
    "profile_violations",
    f"""SELECT 'duplicate_layer' AS rule, concat_ws('::', point_id, layer_id) AS subject, count(*) AS n FROM {duck(BROKEN_LAYERS)} GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'duplicate_finding', concat_ws('::', point_id, layer_id, finding_id), count(*) FROM {duck(BROKEN_FINDINGS)} WHERE finding_id <> '' GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'empty_finding_id', concat_ws('::', point_id, layer_id), 1 FROM {duck(BROKEN_FINDINGS)} WHERE finding_id = ''
UNION ALL SELECT 'scoring_layer', concat_ws('::', point_id, layer_id), 1 FROM {duck(BROKEN_LAYERS)} WHERE scoring_effect <> 'none'
UNION ALL SELECT 'cell_mismatch', CAST(point_id AS VARCHAR), 1 FROM {duck(BROKEN_POINTS)} WHERE anchor_cell_id <> cell_id
UNION ALL SELECT 'bad_coordinate', CAST(point_id AS VARCHAR), 1 FROM {duck(BROKEN_POINTS)} WHERE lat NOT BETWEEN -90 AND 90""",
)
def profile_violations(spark, sf_dir):
    frame = lambda text: View(text).frame(spark, sf_dir)
    return quality.profile_violations(frame(BROKEN_POINTS), frame(BROKEN_LAYERS), frame(BROKEN_FINDINGS))


