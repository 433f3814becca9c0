"""Semi-joins, relational division, exclusions, edges and diffs of snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def having_all(links: DataFrame, key: str, value: str, wanted: list[str]) -> DataFrame:
    """Keys linked to every wanted value (repeats in the request count once; an empty request selects nothing)."""
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return links.select(key).limit(0)
    return links.filter(F.col(value).isin(wanted)).groupBy(key).agg(F.countDistinct(value).alias("_n")).filter(F.col("_n") == len(wanted)).select(key)


def union_keys(sources: list[DataFrame]) -> DataFrame:
    """Distinct non-null keys of one-column sources."""
    return reduce(DataFrame.unionAll, sources).dropna().distinct()


def exclude(rows: DataFrame, key: str, sources: list[DataFrame]) -> DataFrame:
    """Rows whose key none of the one-column sources has."""
    return rows.join(union_keys([s.toDF(key) for s in sources]), key, "left_anti")


def symmetrise(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of each undirected edge, as (me, other, ...)."""
    rest = [c for c in edges.columns if c not in (a, b)]
    return edges.select(F.col(a).alias("me"), F.col(b).alias("other"), *rest).unionByName(edges.select(F.col(b).alias("me"), F.col(a).alias("other"), *rest))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value differs, with both values (0 for a missing row) and the signed change; null keys match null keys."""
    x = before.groupBy(*keys).agg(F.sum(value).alias("before"))
    y = after.groupBy(*keys).agg(F.sum(value).alias("after"))
    zero = F.lit(0).cast("long")
    tagged = x.withColumn("after", zero).unionByName(y.withColumn("before", zero))  # one shuffle and null-safe keys, where a full outer join would need neither
    both = tagged.groupBy(*keys).agg(F.sum("before").alias("before"), F.sum("after").alias("after"))
    return both.filter("before <> after").withColumn("delta", F.col("after") - F.col("before"))


def gone_and_back(mirror: DataFrame, feed: DataFrame, key: str, deleted: str) -> DataFrame:
    """(key, change): live rows that the feed lacks are gone, deleted ones that it has are resurrected."""
    fed = feed.select(key).distinct().withColumn("_fed", F.lit(True))
    state = mirror.join(fed, key, "left").select(key, F.col(deleted).alias("_deleted"), F.coalesce("_fed", F.lit(False)).alias("_fed"))
    change = F.when(F.col("_deleted") & F.col("_fed"), "resurrected").when(~F.col("_deleted") & ~F.col("_fed"), "gone")
    return state.withColumn("change", change).filter("change IS NOT NULL").select(key, "change")
