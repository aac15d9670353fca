"""All queries of the retrieval engine by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shotline.plans import answers, evaluation, ingestion, joins, moments, retrieval, scalars, wording  # noqa: F401
from shotline.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-to-frame search: vector top-k by two models, fused, hydrated, the best twenty."""
    return retrieval.entry_search(spark, sf_dir)
