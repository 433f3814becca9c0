"""Table maintenance as pure functions: (old table, batch) gives the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import top_k


def upsert_last_wins(old: DataFrame, batch: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Batch rows replace old ones by key; of several in the batch the last by position."""
    latest = top_k(batch, keys, [F.desc(position)]).drop(position)
    return old.join(latest.select(keys), keys, "left_anti").unionByName(latest)


def insert_first_wins(old: DataFrame, batch: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Old rows stay; new keys come from their first batch row."""
    first = top_k(batch, keys, [F.asc(position)]).drop(position)
    return old.unionByName(first.join(old.select(keys), keys, "left_anti"))


def upsert_coalesce(old: DataFrame, batch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Batch values replace old ones but where they are null."""
    new = batch.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = old.join(new, old[key] == new["_key"], "full_outer")
    return both.select(F.coalesce(key, "_key").alias(key), *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def replace_children(old: DataFrame, batch: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """All rows of the given parents give way to the batch's; other parents' rows stay. A parent without batch rows is cleared."""
    return old.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(batch)


def prune_missing(old: DataFrame, payload: DataFrame, keys: list[str], upstream: str) -> DataFrame:
    """Rows that the payload lacks go, but for those without an upstream id."""
    own = old.filter(F.col(upstream).isNull())
    return own.unionByName(old.filter(F.col(upstream).isNotNull()).join(payload.select(keys).distinct(), keys, "left_semi"))


def guarded_delete(rows: DataFrame, doomed: DataFrame, references: list[DataFrame], key: str) -> DataFrame:
    """rows without the doomed keys that nothing refers to."""
    for r in references:
        doomed = doomed.join(r.toDF(key).distinct(), key, "left_anti")
    return rows.join(doomed.select(key).distinct(), key, "left_anti")


def update_from_feed(old: DataFrame, feed: DataFrame, key: str, column: str) -> DataFrame:
    """old with the feed's values, and changed; rows that the feed lacks keep theirs."""
    new = feed.select(key, F.col(column).alias("_new"))
    both = old.join(new, key, "left")
    value = F.coalesce("_new", column)
    return both.withColumn("changed", ~value.eqNullSafe(F.col(column))).withColumn(column, value).drop("_new")


def repoint(facts: DataFrame, mapping: DataFrame, owner: str, target: str) -> DataFrame:
    """Facts move from old to new targets, unless their owner has the new one already or another of the owner's facts moves there first (lowest old target).

    mapping has (old, new), one row for each old. moved tells which did.
    """
    joined = facts.join(mapping, F.col(target) == F.col("old"), "left")
    held = facts.select(F.col(owner).alias("_owner"), F.col(target).alias("_held")).distinct()
    joined = joined.join(held, (F.col(owner) == F.col("_owner")) & (F.col("new") == F.col("_held")), "left")
    wants = F.col("new").isNotNull() & F.col("_held").isNull()
    # rows with nothing to move are each a group of their own, so an owner with many of them isn't one task
    first = F.row_number().over(Window.partitionBy(owner, F.when(wants, F.col("new")), F.when(~wants, F.col(target))).orderBy("old", target)) == 1
    return joined.withColumn("moved", wants & first).withColumn(target, F.when(F.col("moved"), F.col("new")).otherwise(F.col(target))).drop("old", "new", "_owner", "_held")


def latest_event(events: DataFrame, keys: list[str], ts: str, event_id: str) -> DataFrame:
    """The last event of each key; null key parts are equal to each other."""
    return top_k(events, keys, [F.desc(ts), F.desc(event_id)])


def project_dates(rows: DataFrame, specific: DataFrame, default: DataFrame, show: str, season: str, date: str) -> DataFrame:
    """corrected and raw dates by the season's offset, else the show's; raw only where it differs from corrected."""
    both = rows.join(specific.withColumnRenamed("days", "_s"), [show, season], "left").join(default.withColumnRenamed("days", "_d"), show, "left")
    days = F.coalesce("_s", "_d", F.lit(0))
    corrected = F.date_add(F.col(date), days)
    return both.withColumn("corrected", corrected).withColumn("raw", F.when(days != 0, F.col(date))).drop("_s", "_d")


def present(flag: Column, new: Column, old: Column) -> Column:
    """The new value, null included, where the payload has the key; else the old one."""
    return F.when(flag, new).otherwise(old)
