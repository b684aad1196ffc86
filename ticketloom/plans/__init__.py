"""The registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticketloom.plans import (  # noqa: F401
    label_queries,
    model_queries,
    report_queries,
    source_queries,
    text_queries,
    vector_queries,
)
from ticketloom.plans.registry import ORACLES, QUERIES, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["message_category_distribution"](spark, sf_dir)
