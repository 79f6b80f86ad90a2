"""Registered queries of the library and the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagweave.plans import aggregates, graphs, learning, metrics, normal, relations, scans  # noqa: F401  (they register)
from tagweave.plans.registry import QUERIES, SQL, Tables

SMALLEST = "/root/testdata/sf0.001"

__all__ = ["QUERIES", "SQL", "Tables", "entry"]


def entry(spark: SparkSession, sf_dir: str = SMALLEST) -> DataFrame:
    """Top user-level tag pairs with their mutual information."""
    return QUERIES["n01_pair_mutual_information"](spark, sf_dir)
