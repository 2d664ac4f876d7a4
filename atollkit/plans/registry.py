"""All registered queries of the planning library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from atollkit.plans import q_features, q_grids, q_projects, q_rasters, q_results, q_scalars, q_sources, q_spatial  # noqa: F401
from atollkit.plans.domain import REGISTERED, SQL, Tables


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature amounts held by each solver run against the features' targets."""
    return REGISTERED["rs5_evaluate_features"](Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, fn=fn: fn(Tables(spark, sf_dir))) for name, fn in REGISTERED.items()}


def oracles() -> dict[str, str]:
    return dict(SQL)
