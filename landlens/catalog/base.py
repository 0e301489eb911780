"""Query registry: each query pairs a Spark callable with its DuckDB SQL over the same derived inputs."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, "Query"] = {}


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class View(NamedTuple):
    """An input derived from the given tables by one SELECT that reads the same on Spark and DuckDB.

    Tables are written ``{orders}``. Double literals carry an exponent so that neither engine makes decimals of them.
    """

    text: str

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        names = set(re.findall(r"\{(\w+)\}", self.text))
        return spark.sql(self.text, **{n: table(spark, sf_dir, n) for n in names})

    @property
    def sql(self) -> str:
        return "(" + re.sub(r"\{(\w+)\}", r"\1", self.text) + ")"


def query(name: str, sql: str | None = None):
    """Register the decorated ``(spark, sf_dir) -> DataFrame`` under a name."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Query(run, sql)
        return run

    return add


def six(expression: str) -> str:
    """DuckDB text that rounds ties up at six decimals."""
    return f"floor(({expression}) * 1e6 + 0.5e0) / 1e6"


def up(expression: str) -> str:
    """DuckDB text that rounds ties up to a whole number."""
    return f"CAST(floor(({expression}) + 0.5e0) AS INTEGER)"
