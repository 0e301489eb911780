"""Data contracts: expected counts, uniqueness, domains and score identities as violation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landlens.functions.numeric import half_up
from landlens.operators.filters import coordinate_error


class ContractError(RuntimeError):
    """A dataset breaks its contract."""


def count_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row with the number of rows for which each condition holds."""
    return df.agg(*[F.count(F.when(cond, 1)).alias(name) for name, cond in checks.items()])


def assert_counts(df: DataFrame, checks: dict[str, Column], expected: dict[str, int]) -> None:
    """Raise unless every count is as expected; one aggregate over the data, one row to the driver."""
    found = count_checks(df, checks).first().asDict()
    wrong = {k: (found[k], v) for k, v in expected.items() if found[k] != v}
    if wrong:
        raise ContractError(f"count mismatch (found, expected): {wrong}")


def duplicate_keys(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys that occur more than once."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .select(F.lit(rule).alias("rule"), F.concat_ws("::", *keys).alias("subject"), "n")
    )


def profile_violations(points: DataFrame, layers: DataFrame, findings: DataFrame) -> DataFrame:
    """Everything that breaks the profile contract: (rule, subject, n).

    Duplicate layers per point, duplicate or empty finding ids per layer, layers that try to score, anchors whose
    cell differs from the context's, and unusable coordinates.
    """
    single = lambda df, rule, subject: df.select(
        F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), F.lit(1).cast("bigint").alias("n")
    )
    empty = findings.filter(F.coalesce("finding_id", F.lit("")) == "")
    parts = [
        duplicate_keys(layers, ["point_id", "layer_id"], "duplicate_layer"),
        duplicate_keys(
            findings.filter(F.coalesce("finding_id", F.lit("")) != ""),
            ["point_id", "layer_id", "finding_id"],
            "duplicate_finding",
        ),
        single(empty, "empty_finding_id", F.concat_ws("::", "point_id", "layer_id")),
        single(
            layers.filter(~F.coalesce(F.col("scoring_effect") == "none", F.lit(False))),
            "scoring_layer",
            F.concat_ws("::", "point_id", "layer_id"),
        ),
        single(points.filter(F.col("anchor_cell_id") != F.col("cell_id")), "cell_mismatch", F.col("point_id")),
        single(
            points.filter(coordinate_error(F.col("lat"), F.col("lng")).isNotNull()), "bad_coordinate", F.col("point_id")
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def domain_violations(df: DataFrame, key: str, domains: dict[str, tuple[str, ...]]) -> DataFrame:
    """Values outside their enumeration: (key, column, value)."""
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(c).isNotNull() & ~F.col(c).isin(*allowed),
                    F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")),
                )
                for c, allowed in domains.items()
            ]
        )
    )
    return df.select(key, F.explode(entries).alias("e")).select(key, "e.*")


def grid_range_violations(df: DataFrame, rows: int, columns: int) -> DataFrame:
    """Cells outside the formal grid."""
    return df.filter(~(F.col("grid_row").between(0, rows - 1) & F.col("grid_col").between(0, columns - 1)))


def score_identity_violations(cells: DataFrame) -> DataFrame:
    """Cells whose detail score is not 80 % original plus 20 % auxiliary, rounded."""
    expected = half_up(F.col("original_score") * 0.8 + F.col("auxiliary_score") * 0.2).cast("int")
    return cells.withColumn("expected_score", expected).filter(F.col("detail_score") != F.col("expected_score"))
