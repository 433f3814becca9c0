"""One row of each group: the first, the last, the preferred, the primary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group; Spark prunes to k for each task before the shuffle."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")


def prefer_non_null(rows: DataFrame, keys: list[str], preferred: str, key: str) -> DataFrame:
    """Rows with a value win over those without; then the lowest key."""
    return top_k(rows, keys, [F.col(preferred).isNull(), F.asc(key)])


def unique_only(rows: DataFrame, keys: list[str], carried: list[str] | None = None) -> DataFrame:
    """Rows whose key no other row has; null keys drop out. carried names the other columns.

    One aggregate, combined before the shuffle: of a key with one row the
    smallest value of each column is that row's.
    """
    carried = [c for c in rows.columns if c not in keys] if carried is None else carried
    one = rows.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in carried])
    return one.filter("_n = 1").drop("_n")


def episode_order(season: Column, number: Column) -> list[Column]:
    """Season 0 last, then by season, copied (negative) numbers last, by number."""
    return [(season == 0).asc(), season.asc_nulls_last(), (number < 0).asc(), number.asc_nulls_last()]
