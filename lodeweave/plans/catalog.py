"""The queries of the core, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeweave.plans import drift_queries, kg_oracles, kg_queries, nested_queries, text_queries

MODULES = (nested_queries, drift_queries, text_queries, kg_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in getattr(m, "ORACLE_SQL", {}).items()} | kg_oracles.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline end to end: documents to a graph of the terms in them."""
    return QUERIES["document_graph"](spark, sf_dir)
