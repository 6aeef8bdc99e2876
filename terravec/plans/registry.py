"""All queries of the library over the given tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terravec.plans import base, q_functions, q_io, q_joins, q_points, q_saliency, q_sae, q_splice  # noqa: F401  (the modules register their queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first concepts of each label: read, normalise, centre, decompose, aggregate, rank."""
    return base.QUERIES["W4_top_concepts"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return base.QUERIES


def oracle_sql() -> dict[str, str]:
    return base.ORACLES
