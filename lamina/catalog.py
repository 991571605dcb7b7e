"""Registered queries over the driver's tables, with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .operators import search
from .plans import tables
from .plans.registry import QUERIES

for _part in ("filters", "distances", "graphs", "evaluation", "walks", "indexes", "more"):
    import_module(f".plans.{_part}", __package__)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors whose label sets contain the query's."""
    return search.filtered_knn(tables.base(spark, sf_dir), tables.queries(spark, sf_dir), tables.K, "containment")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
