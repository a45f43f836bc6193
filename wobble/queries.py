"""Registry of the engine's queries and of the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import analytics, answers, audits, heads, metrics, records, sources
from .plans.registry import Query

PARTS = (metrics.query, analytics.query, records.query, audits.query, heads.query, sources.query, answers.query)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, curve area, intraclass correlation and premium of each cell."""
    return metrics.input_metrics(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for part in PARTS for name, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.sql.items()}
