"""Sinks: per-user JSON documents, canonical JSON and review files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_json(row: Column) -> Column:
    """Compact JSON in the struct's own key order, nulls kept."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def write_user_documents(docs: DataFrame, path: str) -> None:
    """One JSON document for each row (column doc), as text."""
    docs.select("doc").write.text(path)


def write_review(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def read_review(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
