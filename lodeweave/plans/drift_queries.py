"""Queries over export files whose schemas drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.drift import changes, one_table
from lodeweave.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a file against the one of the same feed written just before."""
    return changes(table(spark, sf_dir, "raw_export_lines"))


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All export lines in one consistent table."""
    return one_table(table(spark, sf_dir, "raw_export_lines")).withColumns({"record": F.to_json("record"), "unfitted": F.to_json("unfitted")})


QUERIES = {"p4_found": p4_found, "p4_table": p4_table}
ORACLE_SQL: dict[str, str] = {}
