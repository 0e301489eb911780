"""Packed cell records: bit fields, mixed-radix codes, parallel arrays and sparse tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landlens.functions.geo import GRID_COLUMNS, GRID_ROWS, cell_name
from landlens.functions.numeric import half_even

# Code tables of the environment record; position is the stored code, 0 is invalid.
AGGREGATE_STATES = ("INVALID", "NEUTRAL", "CAUTION", "CANDIDATE", "STRONG", "MIXED")
RESIDENTIAL_TIERS = (
    "INVALID",
    "A_BUILT_UP_CONTINUITY",
    "B_CURRENT_BUILDINGS_HISTORIC_REVIEW",
    "NO_CURRENT_BUILDINGS",
    "HISTORIC_NONRESIDENTIAL_REVIEW",
    "UNKNOWN_PLATEAU_SOURCE_HOLE",
)
PLATEAU_STATUSES = ("INVALID", "PASS", "EXPLICIT_NO_BUILDINGS", "UNKNOWN_SOURCE_TILE_404")

# Code tables of the moisture record, least significant digit last.
MOISTURE_ATTENTION = (
    "insufficient",
    "historical_water_attention_model_unavailable",
    "low",
    "moderate",
    "elevated",
    "high_attention",
    "reference_only",
    "low_to_moderate",
)
MOISTURE_CONFIDENCE = ("reference", "practical")
MOISTURE_COVERAGE = (
    "outside_jurisdiction_adapter_coverage",
    "full_single_class",
    "boundary_sensitive_or_partial_coverage",
    "overlap_center_resolved_by_official_fixed_rule__cell_mixed_or_boundary_sensitive",
    "source_overlap_conflict_interpolated_classes",
)
GROUNDWATER_BANDS = (
    "unavailable",
    "upland_5m_model",
    "other_materialized_model",
    "shallow_model",
    "very_shallow_model",
    "moderately_shallow_model",
    "moderate_model",
)
HISTORICAL_WATER = (
    "defined_sources_no_direct_water_signal",
    "wet_context_only",
    "within_family_historical_water_convergence",
    "old_water_geomorph_candidate",
    "historical_water_landuse_candidate",
)
PUBLIC_EVIDENCE = ("materialized", "remote_public_source_pending")

#: Mixed-radix digits in the order they are peeled off the code.
MOISTURE_DIGITS = (
    ("public_evidence_status", PUBLIC_EVIDENCE),
    ("historical_water_context", HISTORICAL_WATER),
    ("groundwater_band", GROUNDWATER_BANDS),
    ("coverage_status", MOISTURE_COVERAGE),
    ("confidence", MOISTURE_CONFIDENCE),
    ("attention_class", MOISTURE_ATTENTION),
)

CATALOG_FIELDS = (
    "label_code",
    "original_score",
    "original_fit",
    "auxiliary_score",
    "detail_score",
    "neighborhood_score",
    "confidence",
)
UNKNOWN_BYTE = 255

SPARSE_COUNTS = (
    "total_links",
    "global_feature_links",
    "parent_site_component_links",
    "source_observation_links",
    "current_anchor_links",
    "reference_context_links",
    "duplicate_suppression_links",
    "open_identity_links",
    "feature_queryable_links",
    "non_positive_links",
)


def lookup(values: tuple[str, ...], index: Column) -> Column:
    """Code to name; NULL when the code is outside the table."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def code_of(values: tuple[str, ...], name: Column) -> Column:
    """Name to code; NULL when the name is not in the table."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), name), F.lit(0)).cast("int") - 1


def bits(value: Column, shift: int, mask: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND(F.lit(mask))


def split_record(df: DataFrame, record: str = "record", width: int = 7) -> DataFrame:
    """BINARY record column to INT columns b0..b{n-1}."""
    byte = lambda i: F.conv(F.hex(F.substring(F.col(record), i + 1, 1)), 16, 10).cast("int")
    return df.select("*", *[byte(i).alias(f"b{i}") for i in range(width)]).drop(record)


def unpack_bits(df: DataFrame) -> DataFrame:
    """Seven byte columns ``b0..b6`` per cell to typed columns; rows without the valid bit or with an invalid
    enumeration code are not records and disappear."""
    b = [F.col(f"b{i}") for i in range(7)]
    zone = b[5].bitwiseOR(F.shiftleft(b[6], 8))
    passthrough = [c for c in df.columns if c not in {f"b{i}" for i in range(7)}]
    out = df.filter(b[0].bitwiseAND(F.lit(1)) == 1).select(
        *passthrough,
        (bits(b[0], 1, 1) == 1).alias("robust_candidate"),
        (bits(b[0], 2, 1) == 1).alias("threshold_stable"),
        (bits(b[0], 3, 1) == 1).alias("robust_residential"),
        lookup(AGGREGATE_STATES, bits(b[0], 4, 7)).alias("aggregate_state"),
        (bits(b[0], 7, 1) == 1).alias("core_zone"),
        lookup(RESIDENTIAL_TIERS, bits(b[1], 0, 7)).alias("residential_tier"),
        bits(b[1], 3, 7).alias("known_pillars"),
        bits(b[2], 0, 7).alias("favorable_pillars"),
        bits(b[2], 3, 7).alias("caution_pillars"),
        lookup(PLATEAU_STATUSES, bits(b[2], 6, 3)).alias("plateau_status"),
        (b[3] / F.lit(100.0)).alias("share_300m"),
        (b[4] / F.lit(100.0)).alias("share_500m"),
        F.when(zone > 0, F.format_string("HRZ%05d", zone)).alias("zone_id"),
    )
    enums = ("aggregate_state", "residential_tier", "plateau_status")
    valid = F.lit(True)
    for name in enums:
        valid = valid & F.coalesce(F.col(name) != "INVALID", F.lit(False))
    return out.filter(valid)


def pack_bits(df: DataFrame) -> DataFrame:
    """Inverse of :func:`unpack_bits`: typed columns to ``b0..b6``."""
    flag = lambda c, shift: F.shiftleft(F.col(c).cast("int"), shift)
    zone = F.coalesce(F.substring(F.col("zone_id"), 4, 5).cast("int"), F.lit(0))
    share = lambda c: half_even(F.col(c) * F.lit(100.0)).cast("int")
    typed = {
        "robust_candidate", "threshold_stable", "robust_residential", "aggregate_state", "core_zone",
        "residential_tier", "known_pillars", "favorable_pillars", "caution_pillars", "plateau_status",
        "share_300m", "share_500m", "zone_id",
    }
    return df.select(
        *[c for c in df.columns if c not in typed],
        F.lit(1)
        .bitwiseOR(flag("robust_candidate", 1))
        .bitwiseOR(flag("threshold_stable", 2))
        .bitwiseOR(flag("robust_residential", 3))
        .bitwiseOR(F.shiftleft(code_of(AGGREGATE_STATES, F.col("aggregate_state")), 4))
        .bitwiseOR(flag("core_zone", 7))
        .alias("b0"),
        code_of(RESIDENTIAL_TIERS, F.col("residential_tier"))
        .bitwiseOR(F.shiftleft(F.col("known_pillars"), 3))
        .alias("b1"),
        F.col("favorable_pillars")
        .bitwiseOR(F.shiftleft(F.col("caution_pillars"), 3))
        .bitwiseOR(F.shiftleft(code_of(PLATEAU_STATUSES, F.col("plateau_status")), 6))
        .alias("b2"),
        share("share_300m").alias("b3"),
        share("share_500m").alias("b4"),
        zone.bitwiseAND(F.lit(255)).alias("b5"),
        F.shiftright(zone, 8).alias("b6"),
    )


def unpack_mixed_radix(df: DataFrame, stored: str = "stored") -> DataFrame:
    """``stored`` code to six enumerations: 0 is absent, otherwise code = stored - 1 in a mixed-radix system."""
    code = F.col(stored).cast("int") - 1
    columns, divisor = [], 1
    for position, (name, values) in enumerate(MOISTURE_DIGITS):
        digit = F.floor(code / F.lit(divisor)).cast("int")
        if position < len(MOISTURE_DIGITS) - 1:
            digit = F.pmod(digit, F.lit(len(values)))
        columns.append(lookup(values, digit).alias(name))
        divisor *= len(values)
    out = df.filter(F.col(stored) > 0).select(*[c for c in df.columns if c != stored], *columns)
    return out.filter(F.col("attention_class").isNotNull())


def unpack_soa(df: DataFrame, columns: int = GRID_COLUMNS, fields: tuple[str, ...] = CATALOG_FIELDS) -> DataFrame:
    """Parallel arrays (one per field, one entry per cell) to one row per cell; 255 is unknown.

    Each input row may hold a slice of the catalogue that starts at cell ``first_index``, so no task ever has to
    hold the whole grid.
    """
    zipped = F.arrays_zip(*[F.col(f) for f in fields])
    out = df.select("first_index", F.posexplode(zipped).alias("_pos", "_cell"))
    index = F.col("first_index") + F.col("_pos")
    row, col = F.floor(index / F.lit(columns)).cast("int"), F.pmod(index, F.lit(columns)).cast("int")
    return out.select(
        index.alias("grid_index"),
        row.alias("grid_row"),
        col.alias("grid_col"),
        cell_name(row, col).alias("cell_id"),
        *[unknown_byte(F.col(f"_cell.{f}")).alias(f) for f in fields],
    )


def unknown_byte(value: Column) -> Column:
    return F.nullif(value.cast("int"), F.lit(UNKNOWN_BYTE))


def read_sparse_index(spark: SparkSession, path: str) -> DataFrame:
    """JSON file(s) of 12-tuples, one array of tuples per line, to named columns; a malformed line fails the read."""
    lines = spark.read.text(path)
    return parse_sparse_tuples(lines, "value")


def parse_sparse_tuples(df: DataFrame, column: str) -> DataFrame:
    """Column of JSON text ``[[cell, n1..n10, status], ...]`` to one row per tuple."""
    tuples = F.from_json(F.col(column), T.ArrayType(T.ArrayType(T.StringType())), {"mode": "FAILFAST"})
    rows = df.select(F.explode(tuples).alias("t"))
    return rows.select(
        F.get("t", F.lit(0)).alias("cell_id"),
        *[F.get("t", F.lit(i + 1)).cast("int").alias(name) for i, name in enumerate(SPARSE_COUNTS)],
        F.get("t", F.lit(11)).alias("index_status"),
    )


ENVIRONMENT_CSV = T.StructType(
    [
        T.StructField("canonicalCellId", T.StringType()),
        T.StructField("gridRow", T.IntegerType()),
        T.StructField("gridColumn", T.IntegerType()),
        T.StructField("robustCandidate", T.StringType()),
        T.StructField("thresholdStable", T.StringType()),
        T.StructField("robustResidentialCandidate", T.StringType()),
        T.StructField("residentialRobustZoneId", T.StringType()),
        T.StructField("aggregateState_P25", T.StringType()),
        T.StructField("residentialPlausibilityTier", T.StringType()),
        T.StructField("knownPillars_P25", T.IntegerType()),
        T.StructField("favorablePillars_P25", T.IntegerType()),
        T.StructField("cautionPillars_P25", T.IntegerType()),
        T.StructField("plateauStatus", T.StringType()),
        T.StructField("robustCandidateShare_300m", T.DoubleType()),
        T.StructField("robustCandidateShare_500m", T.DoubleType()),
    ]
)


def read_environment_csv(spark: SparkSession, path: str, schema: T.StructType = ENVIRONMENT_CSV) -> DataFrame:
    """(gzip) CSV with header and optional byte-order mark; columns are found by their name in the header.

    Further columns and any order are fine, a missing one is an error, and so is a value that its type cannot hold.
    """
    raw = spark.read.csv(path, header=True, encoding="UTF-8", mode="FAILFAST")
    raw = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"columns missing in the header: {', '.join(missing)}")
    return environment_columns(raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]))


def true_text(value: Column) -> Column:
    """'true' in any case is true, everything else is false."""
    return F.coalesce(F.lower(value) == "true", F.lit(False))


def environment_columns(raw: DataFrame) -> DataFrame:
    """CSV columns to the typed columns of :func:`pack_bits` (without ``core_zone``)."""
    return raw.select(
        F.col("canonicalCellId").alias("cell_id"),
        F.col("gridRow").alias("grid_row"),
        F.col("gridColumn").alias("grid_col"),
        true_text(F.col("robustCandidate")).alias("robust_candidate"),
        true_text(F.col("thresholdStable")).alias("threshold_stable"),
        true_text(F.col("robustResidentialCandidate")).alias("robust_residential"),
        F.col("aggregateState_P25").alias("aggregate_state"),
        F.col("residentialPlausibilityTier").alias("residential_tier"),
        F.col("knownPillars_P25").alias("known_pillars"),
        F.col("favorablePillars_P25").alias("favorable_pillars"),
        F.col("cautionPillars_P25").alias("caution_pillars"),
        F.col("plateauStatus").alias("plateau_status"),
        F.col("robustCandidateShare_300m").alias("share_300m"),
        F.col("robustCandidateShare_500m").alias("share_500m"),
        F.nullif(F.col("residentialRobustZoneId"), F.lit("")).alias("zone_id"),
    )


def in_formal_grid(row: Column, col: Column, rows: int = GRID_ROWS, columns: int = GRID_COLUMNS) -> Column:
    return row.between(0, rows - 1) & col.between(0, columns - 1)
