"""Gap-and-island rollups of an event stream and keyset pages of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(events: DataFrame, keys: list[str], ts: str, event_id: str, is_member: Column, window_minutes: int) -> DataFrame:
    """events with _member and _group: members that follow any event of their key by less than the window go on with the group before.

    The gap is to the previous event of any kind, so other events bridge gaps;
    an event exactly the window later opens a group. Groups count members only.

    Rows are dealt by key and day, so a key with a third of all events is as
    many tasks' work as it has days. What the days before a day hold (the last
    event, the groups opened) comes from one row for each key and day. Null keys
    are equal to each other.
    """
    day = [*keys, "_day"]
    within = Window.partitionBy(*day).orderBy(ts, event_id)
    through = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("_day", F.to_date(ts)).withColumn("_member", F.coalesce(is_member, F.lit(False)))
    last = e.groupBy(*day).agg(F.max(ts).alias("_last")).withColumn("_last", F.max("_last").over(through))
    e = _beside(e, last, day)
    before = F.coalesce(F.lag(ts).over(within), F.col("_last"))
    joins = F.coalesce(before > F.col(ts) - F.expr(f"INTERVAL {window_minutes} MINUTES"), F.lit(False))
    e = e.withColumn("_opens", F.when(F.col("_member") & ~joins, 1).otherwise(0)).drop("_last")
    opened = e.groupBy(*day).agg(F.sum("_opens").alias("_earlier")).withColumn("_earlier", F.coalesce(F.sum("_earlier").over(through), F.lit(0)))
    e = _beside(e, opened, day)
    count = F.sum("_opens").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("_group", F.col("_earlier") + count).drop("_opens", "_earlier", "_day")


def _beside(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of more, which has one row for each key; null keys match."""
    named = more.select(*[F.col(k).alias(f"_{i}_k") for i, k in enumerate(keys)], *[c for c in more.columns if c not in keys])
    on = [rows[k].eqNullSafe(named[f"_{i}_k"]) for i, k in enumerate(keys)]
    return rows.join(named, on, "left").drop(*[f"_{i}_k" for i in range(len(keys))])


def activity_rollup(events: DataFrame, member_type: str = "view", window_minutes: int = 360) -> DataFrame:
    """Runs of the member type (kind run), single ones and all other events (kind single, other), newest first when sorted by occurred_at, sort_id."""
    e = islands(events, ["user_id"], "ts", "event_id", F.col("event_type") == member_type, window_minutes)
    members = e.filter("_member").groupBy("user_id", "_group").agg(F.count("*").alias("n"), F.max("ts").alias("occurred_at"), F.min_by("event_id", F.struct("ts", "event_id")).alias("sort_id"))
    runs = members.select(
        F.when(F.col("n") > 1, "run").otherwise("single").alias("kind"),
        F.concat(F.when(F.col("n") > 1, "r:").otherwise(""), F.col("sort_id").cast("string")).alias("item_id"),
        "user_id", F.lit(member_type).alias("event_type"), "n", "occurred_at", "sort_id", F.lit(None).cast("double").alias("stars"),
    )
    others = e.filter("NOT _member").select(
        F.lit("other").alias("kind"), F.col("event_id").cast("string").alias("item_id"), "user_id", "event_type", F.lit(1).cast("long").alias("n"),
        F.col("ts").alias("occurred_at"), F.col("event_id").alias("sort_id"), F.get_json_object("props", "$.k").cast("double").alias("stars"),
    )
    return runs.unionByName(others)


def keyset_page(rows: DataFrame, ts: str, key: str, limit: int, after: tuple[str, int] | None = None) -> DataFrame:
    """The next rows after a (timestamp text, key) cursor in descending order of both."""
    if after:
        at = F.lit(after[0]).cast("timestamp_ntz")
        rows = rows.filter((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < after[1])))
    return rows.orderBy(F.desc_nulls_last(ts), F.desc_nulls_last(key)).limit(limit)
