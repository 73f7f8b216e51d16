"""The registry of queries over the driver's tables: name -> (Spark query, equivalent SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import ship
from . import audit_queries, compare_queries, fit_queries, label_queries, metric_queries, report_queries, resample_queries, sampling_queries

_MODULES = (metric_queries, audit_queries, label_queries, sampling_queries, resample_queries, compare_queries, report_queries, fit_queries)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired change of calibration error of each variant and policy."""
    return metric_queries.paired_delta_ece(spark, sf_dir)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship.to_executors(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(query) for m in _MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
