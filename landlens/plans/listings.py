"""Raw listings to policy assessment with town market context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landlens.functions.text import clean_text, normalize_enum, parse_optional_number, trimmed
from landlens.operators import market
from landlens.operators.filters import split_errors
from landlens.session import cut_lineage

#: Longest accepted text per field.
TEXT_LIMITS = {"property_name": 120, "address": 160, "town": 80, "source_url": 500}
NUMBERS = ("total", "area", "floor_no")


def clean_listings(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) listings from raw text fields; every rejected row names its first error."""
    columns, errors = [], []
    for name, limit in TEXT_LIMITS.items():
        if name in raw.columns:
            text, error = clean_text(F.col(name), limit)
            columns.append(text.alias(name))
            errors.append(F.concat(F.lit(f"{name}:"), error))
    for name in NUMBERS:
        number, error = parse_optional_number(F.col(name))
        columns.append(number.alias(name))
        errors.append(F.concat(F.lit(f"{name}:"), error))
    columns.append(normalize_enum(F.col("currentness"), ("confirmed", "stale")).alias("currentness"))
    columns.append(normalize_enum(F.col("identity_state"), ("exact", "partial")).alias("identity_state"))
    replaced = {*TEXT_LIMITS, *NUMBERS, "currentness", "identity_state"}
    kept = [c for c in raw.columns if c not in replaced]
    return split_errors(raw.select(*kept, *columns, F.coalesce(*errors).alias("error_code")))


def town_table(listings: DataFrame) -> DataFrame:
    """Town aggregates of listings (town, building_id, total, area), computed once and written out."""
    return cut_lineage(market.town_market(market.with_town_key(listings)))


def assess_listings(listings: DataFrame, towns: DataFrame) -> DataFrame:
    """Listings with gates, decision, market context and next actions.

    ``towns``: output of :func:`town_table`; town keys are unique, so only their length decides between matches.
    """
    key = market.market_key(F.col("town"), F.lit(None).cast("string"), F.col("address"))
    placed = market.market_context(
        listings.withColumn("market_text", key), towns.withColumn("town_order", F.lit(0))
    )
    assessed = market.policy_gates(placed)
    actions = market.next_actions(
        trimmed(F.col("market_text")).isNotNull(),
        F.col("town_key").isNotNull(),
        F.col("sample_quality"),
        trimmed(F.col("address")).isNotNull(),
    )
    return assessed.withColumn("next_actions", actions)
