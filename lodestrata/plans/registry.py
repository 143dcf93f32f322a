"""Registry of the engine's queries and of the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.plans import (
    arrangement_queries,
    contract_queries,
    history_queries,
    inventory_queries,
    matching_queries,
    nearest_queries,
    packet_queries,
    product_queries,
    profile_queries,
    recompute_queries,
    review_queries,
    spatial_queries,
)

FAMILIES = (
    profile_queries, history_queries, spatial_queries, product_queries, matching_queries, review_queries,
    arrangement_queries, recompute_queries, contract_queries, nearest_queries, packet_queries, inventory_queries,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _family in FAMILIES:
    QUERIES |= _family.R.queries
    ORACLES |= _family.R.oracles


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key patterns between orders and lines."""
    return QUERIES["join_cardinality"](spark, sf_dir)
