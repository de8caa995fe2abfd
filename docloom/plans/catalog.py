"""The registry of the engine's queries and of the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.plans import documents, kernels, relational

_MODULES = (kernels, documents, relational)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classify, extract and score every document."""
    from docloom.operators.response import process
    from docloom.plans.views import card_documents

    return process(card_documents(spark, sf_dir)).drop("fields")


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
