"""Listings, towns and areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from landlens.catalog.base import query, six
from landlens.catalog.geo_queries import AREAS_SQL, areas, town_sql
from landlens.catalog.inputs import LISTINGS, SMALL_TOWNS
from landlens.functions.numeric import half_up
from landlens.functions.text import trimmed
from landlens.operators import market
from landlens.session import cut_lineage

GATES_SQL = f"""(SELECT *, CASE WHEN area > 0 THEN total / area END AS per_sqm,
   CASE WHEN total IS NULL THEN 'unknown' WHEN total <= 170000 THEN 'pass' ELSE 'fail' END AS gate_total,
   CASE WHEN area IS NULL THEN 'unknown' WHEN area >= 15 THEN 'pass' ELSE 'fail' END AS gate_area,
   CASE WHEN floor_no IS NULL THEN 'unknown' WHEN floor_no IN (1, 2, 3) THEN 'pass' ELSE 'fail' END AS gate_floor
 FROM {LISTINGS.sql})"""
STATE_SQL = """CASE WHEN 'fail' IN (gate_total, gate_area, gate_floor) THEN 'OUTSIDE_POLICY'
     WHEN 'unknown' IN (gate_total, gate_area, gate_floor) THEN 'NEEDS_INPUT'
     WHEN currentness = 'confirmed' AND identity_state = 'exact' THEN 'READY_FOR_LAND_CHECK'
     ELSE 'POLICY_PASS_RECHECK_REQUIRED' END"""


@query(
    "listing_policy",
    f"""SELECT listing_id, {six("per_sqm")} AS per_sqm, gate_total, gate_area, gate_floor,
       CASE WHEN per_sqm IS NULL THEN 'unknown' ELSE 'pass' END AS gate_per_sqm, {STATE_SQL} AS decision_state
FROM {GATES_SQL}""",
)
def listing_policy(spark, sf_dir):
    out = market.policy_gates(LISTINGS.frame(spark, sf_dir))
    return out.select(
        "listing_id", half_up(F.col("per_sqm"), 6).alias("per_sqm"), "gate_total", "gate_area", "gate_floor",
        "gate_per_sqm", "decision_state",
    )


def _gate_row(order: int, column: str, value: str) -> str:
    gate, label, threshold, good, bad, hard = market.GATES[order]
    unknown = market.HARD_UNKNOWN if hard else market.SOFT_UNKNOWN
    return f"""SELECT listing_id, {order} AS gate_order, '{gate}' AS gate_id, '{label}' AS gate_label, {column} AS status,
  {str(hard).lower()} AS hard_gate, {six(value)} AS value, '{threshold}' AS threshold,
  CASE {column} WHEN 'pass' THEN '{good}' WHEN 'fail' THEN '{bad}' ELSE '{unknown}' END AS explanation FROM g"""


@query(
    "policy_gate_rows",
    f"WITH g AS (SELECT *, CASE WHEN per_sqm IS NULL THEN 'unknown' ELSE 'pass' END AS gate_per_sqm FROM {GATES_SQL}) "
    + " UNION ALL ".join(
        _gate_row(i, c, v)
        for i, (c, v) in enumerate(
            (("gate_total", "total"), ("gate_area", "area"), ("gate_floor", "floor_no"), ("gate_per_sqm", "per_sqm"))
        )
    ),
)
def policy_gate_rows(spark, sf_dir):
    rows = market.gate_rows(market.policy_gates(LISTINGS.frame(spark, sf_dir)))
    return rows.withColumn("value", half_up(F.col("value"), 6))


@query("policy_funnel", f"SELECT decision_state, count(*) AS n FROM (SELECT {STATE_SQL} AS decision_state FROM {GATES_SQL}) GROUP BY 1")
def policy_funnel(spark, sf_dir):
    return market.policy_funnel(market.policy_gates(LISTINGS.frame(spark, sf_dir)))


TOWN_SQL = """(SELECT town_key, count(*) AS n, count(DISTINCT building_id) AS unique_buildings,
   quantile_cont(total, 0.25) AS p25_total, quantile_cont(total, 0.5) AS median_total,
   quantile_cont(total, 0.75) AS p75_total,
   quantile_cont(CASE WHEN area > 0 THEN total / area END, 0.5) AS median_per_sqm,
   CASE WHEN count(*) >= 15 AND count(DISTINCT building_id) >= 8 THEN 'ROBUST'
        WHEN count(*) >= 5 AND count(DISTINCT building_id) >= 3 THEN 'REVIEW' ELSE 'THIN' END AS sample_quality
 FROM {source} WHERE total IS NOT NULL GROUP BY 1)"""
TOWN_COLUMNS = ("p25_total", "median_total", "p75_total", "median_per_sqm")


def rounded(df, *names):
    return df.select(*[half_up(F.col(c), 6).alias(c) if c in names else c for c in df.columns])


KEYED_SQL = f"(SELECT *, {town_sql('town')} AS town_key FROM {LISTINGS.sql})"


def keyed_listings(spark, sf_dir):
    return market.with_town_key(LISTINGS.frame(spark, sf_dir))


def _town_select(source: str) -> str:
    cols = ", ".join(f"{six(c)} AS {c}" for c in TOWN_COLUMNS)
    return f"SELECT town_key, n, unique_buildings, {cols}, sample_quality FROM {TOWN_SQL.format(source=source)}"


@query("town_market", _town_select(KEYED_SQL))
def town_market(spark, sf_dir):
    return rounded(market.town_market(keyed_listings(spark, sf_dir)), *TOWN_COLUMNS)


@query("town_market_small", _town_select(SMALL_TOWNS.sql))
def town_market_small(spark, sf_dir):
    return rounded(market.town_market(SMALL_TOWNS.frame(spark, sf_dir)), *TOWN_COLUMNS)


@query(
    "market_coverage",
    f"""SELECT count(*) AS towns, CAST(sum(n) AS BIGINT) AS units, count(*) FILTER (n < 5) AS towns_below_five,
       CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median_units FROM {TOWN_SQL.format(source=SMALL_TOWNS.sql)}""",
)
def market_coverage(spark, sf_dir):
    return market.market_coverage(market.town_market(SMALL_TOWNS.frame(spark, sf_dir)))


#: Texts to match: bare town keys, full addresses that contain one, some that match nothing, a bare prefecture and blanks.
TEXT = (
    "CASE WHEN listing_id % 23 = 0 THEN '東京都' WHEN listing_id % 29 = 0 THEN '  ' WHEN listing_id % 5 = 0 THEN concat(town, '18-20') WHEN listing_id % 5 = 1 THEN concat('建物', town) "
    "WHEN listing_id % 5 = 2 THEN address ELSE town END"
)
MATCH_SQL = f"""WITH l AS (SELECT *, {TEXT} AS market_text, coalesce({town_sql(TEXT)}, '') AS text_key FROM {LISTINGS.sql}),
t AS (SELECT *, row_number() OVER (ORDER BY town_key) AS town_order FROM {TOWN_SQL.format(source=KEYED_SQL)}),
d AS (SELECT DISTINCT text_key FROM l WHERE text_key <> ''),
m AS (SELECT text_key, town_key FROM (
  SELECT d.text_key, t.town_key, row_number() OVER (PARTITION BY d.text_key
    ORDER BY CASE WHEN d.text_key = t.town_key THEN 0 ELSE 1 END, length(t.town_key) DESC, t.town_order) AS k
  FROM d JOIN t ON contains(d.text_key, t.town_key)) WHERE k = 1)"""


def with_text(spark, sf_dir):
    return LISTINGS.frame(spark, sf_dir).withColumn("market_text", F.expr(TEXT))


def towns_with_order(spark, sf_dir):
    """Town table, computed once and written out because the match and the context read it several times.

    Keys are unique, so no order among towns is needed beyond their length.
    """
    return cut_lineage(market.town_market(keyed_listings(spark, sf_dir))).withColumn("town_order", F.lit(0))


@query("town_match", MATCH_SQL + " SELECT text_key, town_key FROM m")
def town_match(spark, sf_dir):
    texts = market.key_texts(with_text(spark, sf_dir), "market_text").filter("text_key <> ''")
    texts = texts.select("text_key").distinct()
    return market.town_match(texts, towns_with_order(spark, sf_dir).select("town_key", "town_order"))


CONTEXT_SQL = (
    MATCH_SQL
    + f""" SELECT l.listing_id, m.town_key, n AS sample_count, sample_quality, {six("total - median_total")} AS difference,
  {six("(total - median_total) / median_total")} AS difference_pct,
  CASE WHEN (total - median_total) / median_total <= -0.15e0 THEN '内部サンプル中央値よりかなり低い'
       WHEN (total - median_total) / median_total <= -0.05e0 THEN '内部サンプル中央値よりやや低い'
       WHEN (total - median_total) / median_total < 0.05e0 THEN '内部サンプル中央値付近'
       WHEN (total - median_total) / median_total < 0.15e0 THEN '内部サンプル中央値よりやや高い'
       WHEN (total - median_total) / median_total >= 0.15e0 THEN '内部サンプル中央値よりかなり高い' END AS comparison
FROM l LEFT JOIN m ON l.text_key = m.text_key LEFT JOIN t ON t.town_key = m.town_key"""
)


def context(spark, sf_dir):
    return market.market_context(with_text(spark, sf_dir), towns_with_order(spark, sf_dir))


@query("market_context", CONTEXT_SQL)
def market_context(spark, sf_dir):
    out = rounded(context(spark, sf_dir), "difference", "difference_pct")
    return out.select(
        "listing_id", "town_key", F.col("n").alias("sample_count"), "sample_quality", "difference", "difference_pct",
        "comparison",
    )


ACTIONS_SQL = (
    MATCH_SQL
    + f""", g AS (SELECT * FROM {GATES_SQL}),
s AS (SELECT listing_id, 'fail' IN (gate_total, gate_area, gate_floor) AS any_fail,
        'unknown' IN (gate_total, gate_area, gate_floor) AS any_unknown, g.total, g.currentness, g.identity_state,
        coalesce(trim(l.market_text), '') <> '' AS has_key, m.town_key IS NOT NULL AS has_market, coalesce(t.sample_quality, '') AS quality,
        nullif(trim(g.address), '') IS NOT NULL AS has_address, {STATE_SQL} AS decision_state
      FROM g JOIN (SELECT listing_id, text_key, market_text FROM l) l USING (listing_id) LEFT JOIN m ON l.text_key = m.text_key LEFT JOIN t ON t.town_key = m.town_key)
SELECT listing_id, decision_state, concat_ws('|',
  CASE WHEN any_unknown THEN '{market.ACTION_INPUT}' END,
  CASE WHEN total IS NOT NULL AND NOT has_key THEN '{market.ACTION_ADDRESS}' END,
  CASE WHEN has_key AND NOT has_market THEN '{market.ACTION_NO_SAMPLE}' END,
  CASE WHEN quality = 'THIN' THEN '{market.ACTION_THIN}' END,
  CASE WHEN NOT any_fail AND NOT any_unknown AND identity_state <> 'exact' THEN '{market.ACTION_IDENTITY}' END,
  CASE WHEN NOT any_fail AND NOT any_unknown AND currentness <> 'confirmed' THEN '{market.ACTION_CURRENT}' END,
  CASE WHEN has_address THEN '{market.ACTION_LAND}' END,
  CASE WHEN NOT any_fail AND NOT any_unknown AND currentness = 'confirmed' AND identity_state = 'exact' THEN '{market.ACTION_COST}' END,
  CASE WHEN any_fail THEN '{market.ACTION_KEEP}' END) AS next_actions FROM s"""
)


@query("listing_market", ACTIONS_SQL)
def listing_market(spark, sf_dir):
    """Every listing with its decision and next actions, given its town's market."""
    out = market.policy_gates(context(spark, sf_dir))
    has_address = F.coalesce(F.trim("address"), F.lit("")) != ""
    actions = market.next_actions(
        trimmed(F.col("market_text")).isNotNull(), F.col("town_key").isNotNull(), F.col("sample_quality"), has_address
    )
    return out.select("listing_id", "decision_state", F.array_join(actions, "|").alias("next_actions"))


#: External benchmarks as published: identifier, asking and inquiry rent.
BENCHMARKS = [("MACRO_2026_07_SINGLE", 136_075.0, 100_457.0), ("DEFINITION_2026_06", None, None)]


@query(
    "benchmark_compare",
    f"""SELECT town_key, {six("median_total")} AS median_total, benchmark_id, asking, inquiry
FROM {TOWN_SQL.format(source=SMALL_TOWNS.sql)},
 (VALUES ('MACRO_2026_07_SINGLE', 136075e0, 100457e0), ('DEFINITION_2026_06', NULL, NULL)) b(benchmark_id, asking, inquiry)""",
)
def benchmark_compare(spark, sf_dir):
    towns = market.town_market(SMALL_TOWNS.frame(spark, sf_dir)).select("town_key", "median_total")
    return rounded(market.benchmark_compare(towns, BENCHMARKS), "median_total")


@query(
    "market_key",
    f"""SELECT listing_id, coalesce(nullif(trim(t), ''), nullif(trim(a), '')) AS market_key
FROM (SELECT listing_id, CASE WHEN listing_id % 3 = 0 THEN '  ' WHEN listing_id % 3 = 1 THEN town END AS t, address AS a FROM {LISTINGS.sql})""",
)
def market_key(spark, sf_dir):
    rows = LISTINGS.frame(spark, sf_dir).withColumn(
        "t", F.expr("CASE WHEN listing_id % 3 = 0 THEN '  ' WHEN listing_id % 3 = 1 THEN town END")
    )
    key = market.market_key(F.col("t"), F.lit(None).cast("string"), F.col("address"))
    return rows.select("listing_id", key.alias("market_key"))


@query(
    "area_summary",
    f"""SELECT 'readiness' AS dimension, readiness AS value, count(*) AS n FROM {AREAS_SQL} GROUP BY 2
UNION ALL SELECT 'priority', priority, count(*) FROM {AREAS_SQL} GROUP BY 2
UNION ALL SELECT 'market_readiness', market_readiness, count(*) FROM {AREAS_SQL} GROUP BY 2""",
)
def area_summary(spark, sf_dir):
    return market.area_summary(areas(spark, sf_dir))


@query(
    "area_shortfall",
    f"""SELECT area_id, greatest(0, 30 - known_rent_units) AS units_missing,
       greatest(0, 15 - distinct_buildings) AS buildings_missing FROM {AREAS_SQL}""",
)
def area_shortfall(spark, sf_dir):
    return market.area_shortfall(areas(spark, sf_dir)).select("area_id", "units_missing", "buildings_missing")
