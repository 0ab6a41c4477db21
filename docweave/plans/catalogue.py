"""Every query of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from docweave.plans import audit_queries, commit_queries, compare_queries, document_queries, file_queries, history_queries, package_queries, store_queries, versions, working_copy_queries

ALL = compare_queries.QUERIES | store_queries.QUERIES | document_queries.QUERIES | history_queries.QUERIES | working_copy_queries.QUERIES | commit_queries.QUERIES | audit_queries.QUERIES | file_queries.QUERIES | package_queries.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change between the paired versions of the documents."""
    return versions.comparison(spark, sf_dir).changes.select("pair", "change_id", "kind", "b_node", "c_node", "b_text", "c_text", "confidence")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
