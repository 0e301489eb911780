"""Packed cell records, lens joins, discovery summaries and data contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from landlens.catalog.base import query, six, table
from landlens.catalog.inputs import CATALOG_RAW, ENVIRONMENT_RAW, GRID_CELLS, LINKS, MOISTURE_RAW, SAMPLES, cell
from landlens.functions.numeric import half_up
from landlens.operators import discovery, filters, lookups, quality
from landlens.operators.profile import NO_INDEX
from landlens.plans import discovery as plan
from landlens.session import cut_lineage
from landlens.sources import packed


def names(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


ENVIRONMENT_SQL = f"""(SELECT * FROM (
  SELECT cell_id, (b0 >> 1) & 1 = 1 AS robust_candidate, (b0 >> 2) & 1 = 1 AS threshold_stable,
    (b0 >> 3) & 1 = 1 AS robust_residential, {names(packed.AGGREGATE_STATES)}[((b0 >> 4) & 7) + 1] AS aggregate_state,
    (b0 >> 7) & 1 = 1 AS core_zone, {names(packed.RESIDENTIAL_TIERS)}[(b1 & 7) + 1] AS residential_tier,
    (b1 >> 3) & 7 AS known_pillars, b2 & 7 AS favorable_pillars, (b2 >> 3) & 7 AS caution_pillars,
    {names(packed.PLATEAU_STATUSES)}[((b2 >> 6) & 3) + 1] AS plateau_status, b3 / 100e0 AS share_300m, b4 / 100e0 AS share_500m,
    CASE WHEN b5 + 256 * b6 > 0 THEN concat('HRZ', lpad(CAST(b5 + 256 * b6 AS VARCHAR), 5, '0')) END AS zone_id
  FROM {ENVIRONMENT_RAW.sql} WHERE b0 & 1 = 1)
 WHERE aggregate_state <> 'INVALID' AND residential_tier <> 'INVALID' AND plateau_status <> 'INVALID')"""


def environment(spark, sf_dir):
    return packed.unpack_bits(ENVIRONMENT_RAW.frame(spark, sf_dir))


@query("unpack_bits", f"SELECT * FROM {ENVIRONMENT_SQL}")
def unpack_bits(spark, sf_dir):
    return environment(spark, sf_dir)


@query(
    "pack_bits",
    f"SELECT cell_id, b0, b1, b2, b3, b4, b5, b6 FROM {ENVIRONMENT_RAW.sql} WHERE cell_id IN (SELECT cell_id FROM {ENVIRONMENT_SQL})",
)
def pack_bits(spark, sf_dir):
    """Unpacking and packing again gives the stored bytes back."""
    return packed.pack_bits(environment(spark, sf_dir))


@query("unpack_record", f"SELECT cell_id, b0, b1, b2, b3, b4, b5, b6 FROM {ENVIRONMENT_RAW.sql}")
def unpack_record(spark, sf_dir):
    """Binary seven-byte records split into byte columns."""
    raw = ENVIRONMENT_RAW.frame(spark, sf_dir)
    byte = lambda c: F.lpad(F.hex(F.col(c)), 2, "0")
    record = F.unhex(F.concat(*[byte(f"b{i}") for i in range(7)]))
    return packed.split_record(raw.select("cell_id", record.alias("record")))


MOISTURE_SQL = f"""(SELECT cell_id, {names(packed.PUBLIC_EVIDENCE)}[c % 2 + 1] AS public_evidence_status,
   {names(packed.HISTORICAL_WATER)}[c // 2 % 5 + 1] AS historical_water_context,
   {names(packed.GROUNDWATER_BANDS)}[c // 10 % 7 + 1] AS groundwater_band,
   {names(packed.MOISTURE_COVERAGE)}[c // 70 % 5 + 1] AS coverage_status,
   {names(packed.MOISTURE_CONFIDENCE)}[c // 350 % 2 + 1] AS confidence,
   {names(packed.MOISTURE_ATTENTION)}[c // 700 + 1] AS attention_class
 FROM (SELECT cell_id, stored - 1 AS c FROM {MOISTURE_RAW.sql} WHERE stored > 0))"""


def moisture(spark, sf_dir):
    return packed.unpack_mixed_radix(MOISTURE_RAW.frame(spark, sf_dir))


@query("unpack_radix", f"SELECT * FROM {MOISTURE_SQL}")
def unpack_radix(spark, sf_dir):
    return moisture(spark, sf_dir)


CATALOG_SQL = f"""(SELECT cell_id, grid_row, grid_col, nullif(label_code, 255) AS label_code,
   nullif(detail_score, 255) AS detail_score, nullif(original_score, 255) AS original_score FROM {CATALOG_RAW.sql})"""


def catalog(spark, sf_dir):
    raw = CATALOG_RAW.frame(spark, sf_dir)
    scores = ("label_code", "detail_score", "original_score")
    return raw.select("cell_id", "grid_row", "grid_col", *[packed.unknown_byte(F.col(c)).alias(c) for c in scores])


@query(
    "unpack_soa",
    f"SELECT CAST(grid_row * 462 + grid_col AS BIGINT) AS grid_index, grid_row, grid_col, cell_id, label_code, detail_score FROM {CATALOG_SQL}",
)
def unpack_soa(spark, sf_dir):
    """Parallel arrays, one slice of 462 cells per row, to one row per cell."""
    raw = CATALOG_RAW.frame(spark, sf_dir)
    slices = raw.groupBy("grid_row").agg(
        F.array_sort(F.collect_list(F.struct("grid_col", "label_code", "detail_score"))).alias("s")
    )
    arrays = slices.select(
        (F.col("grid_row").cast("bigint") * 462).alias("first_index"),
        F.col("s.label_code").alias("label_code"),
        F.col("s.detail_score").alias("detail_score"),
    )
    return packed.unpack_soa(arrays, fields=("label_code", "detail_score"))


SPARSE_SQL = f"""(SELECT cell_id, CAST(count(*) AS INTEGER) AS total_links,
   CASE WHEN count(*) > 35 THEN 'INDEXED_DENSE' ELSE 'INDEXED' END AS index_status FROM {LINKS.sql} GROUP BY 1)"""


@query(
    "read_sparse_index",
    f"""SELECT cell_id, total_links, {", ".join(f"CAST(total_links + {i} AS INTEGER) AS {c}" for i, c in enumerate(packed.SPARSE_COUNTS) if i)},
       index_status FROM {SPARSE_SQL}""",
)
def read_sparse_index(spark, sf_dir):
    """JSON tuples written per cell and parsed back."""
    rollup = sparse_index(spark, sf_dir)
    counts = [(F.col("total_links") + i).cast("string") for i in range(len(packed.SPARSE_COUNTS))]
    tuples = F.to_json(F.array(F.array(F.col("cell_id"), *counts, F.col("index_status"))))
    return packed.parse_sparse_tuples(rollup.select(tuples.alias("line")), "line")


def sparse_index(spark, sf_dir):
    return (
        LINKS.frame(spark, sf_dir)
        .groupBy("cell_id")
        .agg(F.count(F.lit(1)).cast("int").alias("total_links"))
        .withColumn("index_status", F.when(F.col("total_links") > 35, "INDEXED_DENSE").otherwise("INDEXED"))
    )


@query(
    "link_rollup",
    f"""SELECT cell_id, count(*) AS total_links, count(*) FILTER (coalesce(global_feature_id, '') <> '') AS global_feature_links,
       count(*) FILTER (index_lane = 'PARENT_SITE_COMPONENT') AS parent_site_component_links,
       count(*) FILTER (index_lane = 'SOURCE_OBSERVATION') AS source_observation_links,
       count(*) FILTER (index_lane = 'CURRENT_ANCHOR') AS current_anchor_links,
       count(*) FILTER (index_lane = 'REFERENCE_CONTEXT') AS reference_context_links,
       count(*) FILTER (index_lane = 'DUPLICATE_SUPPRESSION') AS duplicate_suppression_links,
       count(*) FILTER (index_lane = 'OPEN_IDENTITY') AS open_identity_links,
       count(*) FILTER (query_status = 'FEATURE_LINK_QUERYABLE') AS feature_queryable_links,
       count(*) FILTER (positive_claim <> 'YES') AS non_positive_links FROM {LINKS.sql} GROUP BY 1""",
)
def link_rollup(spark, sf_dir):
    return discovery.link_rollup(LINKS.frame(spark, sf_dir))


ZONES = "concat('HRZ', lpad(CAST(s_suppkey * 11 % 1000 AS STRING), 5, '0')) AS zone_id, s_suppkey % 3 <> 0 AS is_zone, CAST(s_suppkey % 7 AS INT) AS core_cell_count"
ZONES_SQL = f"(SELECT {ZONES.replace('STRING', 'VARCHAR')} FROM supplier)"


@query(
    "core_zone",
    f"""SELECT cell_id, zone_id, coalesce(zone_id IN (SELECT zone_id FROM {ZONES_SQL} WHERE is_zone AND core_cell_count >= 3), false) AS core_zone
FROM {ENVIRONMENT_SQL}""",
)
def core_zone(spark, sf_dir):
    zones = spark.sql(f"SELECT {ZONES} FROM {{supplier}}", supplier=table(spark, sf_dir, "supplier"))
    return lookups.core_zone_flag(environment(spark, sf_dir).select("cell_id", "zone_id"), zones)


LENS_SQL = f"""(SELECT s.*, CASE WHEN v.label_code IS NULL THEN 'UNKNOWN' WHEN v.label_code = 1 THEN 'CANDIDATE'
     WHEN v.label_code = 2 THEN 'CAUTION' ELSE 'ORDINARY_OR_WEAK' END AS catalog_class,
   ['判定材料不足', 'イヤシロチ候補', 'ケガレチ候補', '普通地', '高低混在', '通常・弱い傾向'][v.label_code + 1] AS catalog_title,
   v.detail_score AS catalog_detail, coalesce(m.attention_class, 'UNKNOWN') AS moisture_class,
   coalesce(m.confidence, 'UNKNOWN') AS moisture_confidence, coalesce(e.aggregate_state, 'UNKNOWN') AS environment_state,
   coalesce(e.robust_candidate, false) AS environment_robust, e.share_300m, e.share_500m,
   coalesce(p.total_links, 0) AS place_links, coalesce(p.index_status, '{NO_INDEX}') AS place_status,
   false AS absence_claim_allowed
 FROM {SAMPLES.sql} s LEFT JOIN {CATALOG_SQL} v ON s.cell_id = v.cell_id LEFT JOIN {MOISTURE_SQL} m ON s.cell_id = m.cell_id
 LEFT JOIN {ENVIRONMENT_SQL} e ON s.cell_id = e.cell_id LEFT JOIN {SPARSE_SQL} p ON s.cell_id = p.cell_id)"""


def lensed(spark, sf_dir):
    return discovery.lens_join(
        SAMPLES.frame(spark, sf_dir), catalog(spark, sf_dir), moisture(spark, sf_dir), environment(spark, sf_dir),
        sparse_index(spark, sf_dir),
    )


@query("lens_join", f"SELECT * FROM {LENS_SQL}")
def lens_join(spark, sf_dir):
    return lensed(spark, sf_dir)


MEANS = ("lens_mean", "catalog_detail_mean", "share_300m_mean", "share_500m_mean")


@query(
    "stratum_summary",
    f"""SELECT stratum, count(*) AS samples, {six("avg(lens_score)")} AS lens_mean, {six("avg(catalog_detail)")} AS catalog_detail_mean,
       count(*) FILTER (environment_robust) AS robust_count, {six("avg(share_300m)")} AS share_300m_mean,
       {six("avg(share_500m)")} AS share_500m_mean, count(*) FILTER (place_links > 0) AS indexed_count FROM {LENS_SQL} GROUP BY 1""",
)
def stratum_summary(spark, sf_dir):
    out = discovery.stratum_summary(lensed(spark, sf_dir))
    return out.select(*[half_up(F.col(c), 6).alias(c) if c in MEANS else c for c in out.columns])


@query(
    "class_histograms",
    " UNION ALL ".join(
        f"SELECT stratum, '{c}' AS lens, coalesce(nullif(trim({c}), ''), 'UNKNOWN') AS class, count(*) AS n FROM {LENS_SQL} GROUP BY 1, 3"
        for c in discovery.HISTOGRAMS
    ),
)
def class_histograms(spark, sf_dir):
    return discovery.class_histograms(lensed(spark, sf_dir))


PEARSON_SQL = """SELECT '{name}' AS pair, count(*) AS n, {value} AS pearson FROM (
  SELECT lens_score - avg(lens_score) OVER () AS x, {y} - avg({y}) OVER () AS y FROM {lens}
  WHERE lens_score IS NOT NULL AND {y} IS NOT NULL)"""
PEARSON_VALUE = "CASE WHEN count(*) >= 3 THEN " + six("sum(x * y) / nullif(sqrt(sum(x * x) * sum(y * y)), 0)") + " END"


@query(
    "pearson",
    " UNION ALL ".join(
        PEARSON_SQL.format(name=c, y=c, lens=LENS_SQL, value=PEARSON_VALUE) for c in ("catalog_detail", "share_300m")
    ),
)
def pearson(spark, sf_dir):
    out = discovery.pearson(
        lensed(spark, sf_dir), [("lens_score", "catalog_detail"), ("lens_score", "share_300m")]
    )
    return out.select(F.col("y").alias("pair"), "n", half_up(F.col("pearson"), 6).alias("pearson"))


@query(
    "pearson_by_stratum",
    f"""SELECT stratum, count(*) AS n, {PEARSON_VALUE} AS pearson FROM (
  SELECT stratum, lens_score - avg(lens_score) OVER (PARTITION BY stratum) AS x,
         catalog_detail - avg(catalog_detail) OVER (PARTITION BY stratum) AS y
  FROM {LENS_SQL} WHERE lens_score IS NOT NULL AND catalog_detail IS NOT NULL) GROUP BY 1""",
)
def pearson_by_stratum(spark, sf_dir):
    known = lensed(spark, sf_dir).filter(F.col("lens_score").isNotNull() & F.col("catalog_detail").isNotNull())
    out = discovery.pearson(known, [("lens_score", "catalog_detail")], ["stratum"])
    return out.select("stratum", "n", half_up(F.col("pearson"), 6).alias("pearson"))


@query(
    "frame_counts",
    f"""SELECT count(*) AS samples, count(DISTINCT municipality) AS municipalities, count(lens_score) AS eligible,
       count(*) - count(lens_score) AS controls, count(catalog_title) AS catalog_available,
       count(*) FILTER (moisture_class <> 'UNKNOWN') AS moisture_available,
       count(*) FILTER (environment_state <> 'UNKNOWN') AS environment_available,
       count(*) FILTER (place_links > 0) AS places_indexed, count(*) FILTER (place_links <= 0) AS places_not_indexed
FROM {LENS_SQL}""",
)
def frame_counts(spark, sf_dir):
    return discovery.frame_counts(lensed(spark, sf_dir))


QUEUE_SQL = f"""(WITH l AS (SELECT *, left(stratum, 2) IN ('A_', 'B_') AS high, left(stratum, 2) = 'E_' AS low,
    environment_robust OR environment_state = 'CANDIDATE' AS positive, moisture_class NOT IN ('low', 'LOW') AS attention FROM {LENS_SQL})
 SELECT 'convergence' AS queue, * FROM l WHERE high AND catalog_class = 'CANDIDATE' AND positive AND NOT attention
 UNION ALL SELECT 'contradiction', * FROM l WHERE high AND (catalog_class = 'CAUTION' OR environment_state = 'CAUTION' OR attention)
 UNION ALL SELECT 'counterexample', * FROM l WHERE low AND (catalog_class = 'CANDIDATE' OR positive)
 UNION ALL SELECT 'uncertainty', * FROM l WHERE left(stratum, 2) IN ('D_', 'F_'))"""


@query("research_queues", f"SELECT queue, sample_id FROM {QUEUE_SQL}")
def research_queues(spark, sf_dir):
    return discovery.research_queues(lensed(spark, sf_dir)).select("queue", "sample_id")


@query(
    "queue_items",
    f"""SELECT queue, sample_id, position, queue_count FROM (SELECT queue, sample_id,
  CAST(row_number() OVER (PARTITION BY queue ORDER BY sample_id) AS INTEGER) AS position,
  count(*) OVER (PARTITION BY queue) AS queue_count FROM {QUEUE_SQL})
WHERE position <= CASE queue WHEN 'uncertainty' THEN 60 ELSE 30 END""",
)
def queue_items(spark, sf_dir):
    queued = discovery.research_queues(lensed(spark, sf_dir)).select("queue", "sample_id")
    return discovery.queue_items(cut_lineage(queued))


@query(
    "queue_reasons",
    f"""SELECT sample_id, concat_ws('|', CASE WHEN NOT exact_water_closed THEN '{discovery.REASON_WATER}' END,
  CASE WHEN split_risk = '{discovery.SPLIT_RISK}' THEN '{discovery.REASON_SPLIT}' END,
  CASE WHEN catalog_title IS NULL THEN '{discovery.REASON_CATALOG}' END,
  CASE WHEN moisture_class = 'UNKNOWN' THEN '{discovery.REASON_MOISTURE}' END,
  CASE WHEN environment_state = 'UNKNOWN' THEN '{discovery.REASON_ENVIRONMENT}' END,
  CASE WHEN place_status = '{NO_INDEX}' THEN '{discovery.REASON_PLACES}' END, '{discovery.REASON_STAGED}') AS reasons FROM {LENS_SQL}""",
)
def queue_reasons(spark, sf_dir):
    out = discovery.queue_reasons(lensed(spark, sf_dir))
    return out.select("sample_id", F.array_join("reasons", "|").alias("reasons"))


FRAME_NAMES = (
    "samples", "municipalities", "eligible", "controls", "catalog_available", "moisture_available", "environment_available",
    "places_indexed", "places_not_indexed",
)


def _summary_sql() -> str:
    """All parts of the summary in long form: part, group, name, value."""
    text = lambda v: f"CAST({v} AS VARCHAR)"
    lens = f"ls AS MATERIALIZED (SELECT * FROM {LENS_SQL})"
    frame = f"""fr AS (SELECT count(*) AS samples, count(DISTINCT municipality) AS municipalities, count(lens_score) AS eligible, count(*) - count(lens_score) AS controls,
  count(catalog_title) AS catalog_available, count(*) FILTER (moisture_class <> 'UNKNOWN') AS moisture_available, count(*) FILTER (environment_state <> 'UNKNOWN') AS environment_available,
  count(*) FILTER (place_links > 0) AS places_indexed, count(*) FILTER (place_links <= 0) AS places_not_indexed FROM ls)"""
    parts = [f"SELECT 'frame' AS part, 'all' AS grouping, '{n}' AS name, {text(n)} AS value FROM fr" for n in FRAME_NAMES]
    parts += [
        f"SELECT 'strata', stratum, '{name}', {text(value)} FROM ls GROUP BY stratum"
        for name, value in (("samples", "count(*)"), ("robust_count", "count(*) FILTER (environment_robust)"), ("indexed_count", "count(*) FILTER (place_links > 0)"))
    ]
    parts += [
        f"SELECT 'histograms', concat(stratum, '/{c}'), coalesce(nullif(trim({c}), ''), 'UNKNOWN'), {text('count(*)')} FROM ls GROUP BY stratum, 3"
        for c in discovery.HISTOGRAMS
    ]
    parts += [
        f"SELECT 'correlations', 'all', '{c}', {text('count(*)')} FROM ls WHERE lens_score IS NOT NULL AND {c} IS NOT NULL" for c in ("catalog_detail", "share_300m")
    ]
    queues = QUEUE_SQL.replace(LENS_SQL, "ls")
    parts.append(
        f"""SELECT 'queues', queue, {text("sample_id")}, {text("position")} FROM (SELECT queue, sample_id, row_number() OVER (PARTITION BY queue ORDER BY sample_id) AS position FROM {queues})
  WHERE position <= CASE queue WHEN 'uncertainty' THEN 60 ELSE 30 END"""
    )
    return f"WITH {lens}, {frame} " + " UNION ALL ".join(parts)


@query("discovery_summary", _summary_sql())
def discovery_summary(spark, sf_dir):
    """The whole summary plan, its parts stacked in long form."""
    parts = plan.discovery_summary(
        SAMPLES.frame(spark, sf_dir), catalog(spark, sf_dir), moisture(spark, sf_dir), environment(spark, sf_dir), sparse_index(spark, sf_dir)
    )
    text = lambda c: F.col(c).cast("string")

    def long(frame, part, group, names_):
        pairs = F.array(*[F.struct(F.lit(n).alias("name"), text(n).alias("value")) for n in names_])
        return frame.select(F.lit(part).alias("part"), group.alias("grouping"), F.explode(pairs).alias("p")).select("part", "grouping", "p.*")

    row = lambda frame, part, group, name, value: frame.select(
        F.lit(part).alias("part"), group.alias("grouping"), name.alias("name"), value.alias("value")
    )
    out = long(parts["frame"], "frame", F.lit("all"), FRAME_NAMES)
    out = out.union(long(parts["strata"], "strata", F.col("stratum"), ("samples", "robust_count", "indexed_count")))
    out = out.union(row(parts["histograms"], "histograms", F.concat_ws("/", "stratum", "lens"), F.col("class"), text("n")))
    out = out.union(row(parts["correlations"], "correlations", F.lit("all"), F.col("y"), text("n")))
    return out.union(row(parts["queues"], "queues", F.col("queue"), text("sample_id"), text("position")))


@query(
    "discovery_page",
    f"""WITH p AS (SELECT sample_id FROM {SAMPLES.sql} ORDER BY sample_id LIMIT 20 OFFSET 40), n AS (SELECT count(*) AS filtered FROM {SAMPLES.sql})
SELECT sample_id, catalog_class, moisture_class, environment_state, place_status, concat_ws('|', CASE WHEN NOT exact_water_closed THEN '{discovery.REASON_WATER}' END,
  CASE WHEN split_risk = '{discovery.SPLIT_RISK}' THEN '{discovery.REASON_SPLIT}' END, CASE WHEN catalog_title IS NULL THEN '{discovery.REASON_CATALOG}' END,
  CASE WHEN moisture_class = 'UNKNOWN' THEN '{discovery.REASON_MOISTURE}' END, CASE WHEN environment_state = 'UNKNOWN' THEN '{discovery.REASON_ENVIRONMENT}' END,
  CASE WHEN place_status = '{NO_INDEX}' THEN '{discovery.REASON_PLACES}' END, '{discovery.REASON_STAGED}') AS reasons, filtered, CASE WHEN filtered > 60 THEN CAST(60 AS BIGINT) END AS next_offset
FROM {LENS_SQL} JOIN p USING (sample_id), n""",
)
def discovery_page(spark, sf_dir):
    """The page plan: the page is cut first and enriched then."""
    out = plan.discovery_page(
        SAMPLES.frame(spark, sf_dir), catalog(spark, sf_dir), moisture(spark, sf_dir), environment(spark, sf_dir),
        sparse_index(spark, sf_dir), 40, 20,
    )
    return out.select(
        "sample_id", "catalog_class", "moisture_class", "environment_state", "place_status", F.array_join("reasons", "|").alias("reasons"),
        "filtered", "next_offset",
    )


@query(
    "sample_page",
    f"""WITH f AS (SELECT sample_id, municipality, stratum FROM {SAMPLES.sql} WHERE stratum = 'B_UPPER_QUARTILE')
SELECT *, (SELECT count(*) FROM f) AS filtered,
       CASE WHEN (SELECT count(*) FROM f) > 60 THEN CAST(60 AS BIGINT) END AS next_offset FROM f ORDER BY sample_id LIMIT 20 OFFSET 40""",
)
def sample_page(spark, sf_dir):
    samples = filters.sample_filter(SAMPLES.frame(spark, sf_dir), stratum="B_UPPER_QUARTILE")
    return discovery.page(samples.select("sample_id", "municipality", "stratum"), "sample_id", 40, 20)


@query(
    "distinct_values",
    f"""SELECT DISTINCT 'municipality' AS filter, municipality AS value FROM {SAMPLES.sql}
UNION ALL SELECT DISTINCT 'stratum', stratum FROM {SAMPLES.sql}""",
)
def distinct_values(spark, sf_dir):
    """Both filters of the sample list."""
    towns, strata = discovery.distinct_values(SAMPLES.frame(spark, sf_dir))
    named = lambda frame, name: frame.select(F.lit(name).alias("filter"), F.col(name).alias("value"))
    return named(towns, "municipality").union(named(strata, "stratum"))


@query(
    "sample_page_after",
    f"""WITH f AS (SELECT sample_id, municipality, stratum FROM {SAMPLES.sql} WHERE stratum = 'B_UPPER_QUARTILE' AND sample_id > 60),
p AS (SELECT * FROM f ORDER BY sample_id LIMIT 20)
SELECT *, CASE WHEN (SELECT count(*) FROM f) > 20 THEN (SELECT max(sample_id) FROM p) END AS next_after FROM p""",
)
def sample_page_after(spark, sf_dir):
    """The page behind a cursor."""
    samples = filters.sample_filter(SAMPLES.frame(spark, sf_dir), stratum="B_UPPER_QUARTILE")
    return discovery.page_after(samples.select("sample_id", "municipality", "stratum"), "sample_id", 60, 20)


#: Zones: one per order, grouped by the customer's nation; the score has many ties.
ZONE_SQL = "SELECT n_name AS municipality, o_orderkey AS zone_id, floor(o_totalprice / 500e0) / 10e0 AS score, CAST((o_orderkey * 31) % 1009 AS INT) AS uncertainty"


@query(
    "stratified_pick",
    f"""WITH z AS ({ZONE_SQL} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY municipality ORDER BY score DESC, zone_id) - 1 AS k,
        count(*) OVER (PARTITION BY municipality) AS n,
        row_number() OVER (PARTITION BY municipality ORDER BY uncertainty DESC, zone_id) AS u FROM z)
SELECT municipality, zone_id, score, 'A_LOCAL_TOP' AS stratum FROM r WHERE k = 0
UNION ALL SELECT municipality, zone_id, score, 'B_UPPER_QUARTILE' FROM r WHERE k = n // 4
UNION ALL SELECT municipality, zone_id, score, 'C_LOCAL_MEDIAN' FROM r WHERE k = n // 2
UNION ALL SELECT municipality, zone_id, score, 'D_UNCERTAINTY_REVIEW' FROM r WHERE u = 1
UNION ALL SELECT municipality, zone_id, score, 'E_LOCAL_BOTTOM_CONTROL' FROM r WHERE k = n - 1""",
)
def stratified_pick(spark, sf_dir):
    zones = spark.sql(
        ZONE_SQL + " FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey",
        **{t: table(spark, sf_dir, t) for t in ("orders", "customer", "nation")},
    )
    return discovery.stratified_pick(zones)


@query(
    "assert_counts",
    f"""SELECT count(*) AS "rows", count(*) FILTER (robust_candidate) AS robust, count(*) FILTER (threshold_stable) AS stable,
       count(*) FILTER (robust_residential) AS residential, count(*) FILTER (plateau_status = 'UNKNOWN_SOURCE_TILE_404') AS unknown_tiles
FROM {ENVIRONMENT_SQL}""",
)
def assert_counts(spark, sf_dir):
    return quality.count_checks(
        environment(spark, sf_dir),
        {
            "rows": F.lit(True),
            "robust": F.col("robust_candidate"),
            "stable": F.col("threshold_stable"),
            "residential": F.col("robust_residential"),
            "unknown_tiles": F.col("plateau_status") == "UNKNOWN_SOURCE_TILE_404",
        },
    )


DOMAIN_INPUT = "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN p_brand ELSE 'CANDIDATE' END AS state, CASE WHEN p_partkey % 14 = 0 THEN NULL WHEN p_partkey % 15 = 0 THEN 'BAD' ELSE 'PASS' END AS plateau"


@query(
    "domain_violations",
    f"""WITH r AS ({DOMAIN_INPUT} FROM part)
SELECT p_partkey, 'state' AS column_name, state AS value FROM r WHERE state NOT IN ('NEUTRAL', 'CANDIDATE')
UNION ALL SELECT p_partkey, 'plateau', plateau FROM r WHERE plateau NOT IN ('PASS')""",
)
def domain_violations(spark, sf_dir):
    rows = spark.sql(DOMAIN_INPUT + " FROM {part}", part=table(spark, sf_dir, "part"))
    return quality.domain_violations(rows, "p_partkey", {"state": ("NEUTRAL", "CANDIDATE"), "plateau": ("PASS",)})


@query(
    "grid_range_violations",
    f"SELECT cell_id, grid_row, grid_col FROM {CATALOG_SQL} WHERE grid_row NOT BETWEEN 0 AND 1 OR grid_col NOT BETWEEN 0 AND 460",
)
def grid_range_violations(spark, sf_dir):
    cells = catalog(spark, sf_dir).select("cell_id", "grid_row", "grid_col")
    return quality.grid_range_violations(cells, 2, 461)


@query(
    "score_identity",
    f"""SELECT cell_index, detail_score, CAST(floor(0.8e0 * original_score + 0.2e0 * aux_score + 0.5e0) AS INTEGER) AS expected_score
FROM {GRID_CELLS.sql} WHERE detail_score <> CAST(floor(0.8e0 * original_score + 0.2e0 * aux_score + 0.5e0) AS INTEGER)""",
)
def score_identity(spark, sf_dir):
    cells = GRID_CELLS.frame(spark, sf_dir).withColumnRenamed("aux_score", "auxiliary_score")
    return quality.score_identity_violations(cells).select("cell_index", "detail_score", "expected_score")


@query(
    "catalog_class",
    f"""SELECT sample_id, CASE WHEN title IS NULL THEN 'UNKNOWN' WHEN contains(title, 'イヤシロチ候補') THEN 'CANDIDATE'
  WHEN contains(title, 'ケガレチ候補') THEN 'CAUTION' ELSE 'ORDINARY_OR_WEAK' END AS class
FROM (SELECT sample_id, 'セル判定: ' || catalog_title AS title FROM {LENS_SQL})""",
)
def catalog_class(spark, sf_dir):
    titled = lensed(spark, sf_dir).select("sample_id", F.concat(F.lit("セル判定: "), "catalog_title").alias("title"))
    return titled.select("sample_id", discovery.catalog_class(F.col("title")).alias("class"))


CSV_INPUT = f"""SELECT {cell("p_partkey")} AS canonicalCellId, CAST(floor(p_partkey / 462e0) AS INT) AS gridRow,
   CAST(p_partkey % 462 AS INT) AS gridColumn, CASE WHEN p_partkey % 2 = 0 THEN 'True' ELSE 'false' END AS robustCandidate,
   CASE WHEN p_partkey % 3 = 0 THEN 'TRUE' ELSE 'no' END AS thresholdStable, CAST(NULL AS STRING) AS robustResidentialCandidate,
   CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('HRZ', lpad(CAST(p_partkey AS STRING), 5, '0')) END AS residentialRobustZoneId,
   'NEUTRAL' AS aggregateState_P25, 'NO_CURRENT_BUILDINGS' AS residentialPlausibilityTier, CAST(p_size % 5 AS INT) AS knownPillars_P25,
   CAST(p_size % 3 AS INT) AS favorablePillars_P25, CAST(p_size % 2 AS INT) AS cautionPillars_P25, 'PASS' AS plateauStatus,
   (p_partkey % 101) / 100e0 AS robustCandidateShare_300m, (p_partkey % 91) / 100e0 AS robustCandidateShare_500m"""


@query(
    "environment_columns",
    f"""SELECT canonicalCellId AS cell_id, gridRow AS grid_row, gridColumn AS grid_col, lower(robustCandidate) = 'true' AS robust_candidate,
       lower(thresholdStable) = 'true' AS threshold_stable, false AS robust_residential, aggregateState_P25 AS aggregate_state,
       residentialPlausibilityTier AS residential_tier, knownPillars_P25 AS known_pillars, favorablePillars_P25 AS favorable_pillars,
       cautionPillars_P25 AS caution_pillars, plateauStatus AS plateau_status, robustCandidateShare_300m AS share_300m,
       robustCandidateShare_500m AS share_500m, nullif(residentialRobustZoneId, '') AS zone_id
FROM ({CSV_INPUT.replace("STRING", "VARCHAR")} FROM part)""",
)
def environment_columns(spark, sf_dir):
    """The CSV reader's column rules over rows derived from parts (files are covered by the tests)."""
    raw = spark.sql(CSV_INPUT + " FROM {part}", part=table(spark, sf_dir, "part"))
    return packed.environment_columns(raw)
