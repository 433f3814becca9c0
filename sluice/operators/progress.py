"""Progress of users through shows: counts, next episodes, status and taste in one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import top_k

#: Fixed values of the taste ladder.
LIKED_STARS, DISLIKED_STARS, LIKED_PCT, IDLE_DAYS = 3.5, 2.0, 50, 180


def progress(lines: DataFrame, keys: list[str], date: str, watched: str, as_of: Column) -> DataFrame:
    """total, aired, watched (aired and seen), first and last watch, last air date: one pass for each key."""
    aired = F.col(date) <= as_of
    return lines.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(aired).alias("aired"),
        F.count_if(aired & F.col(watched).isNotNull()).alias("watched"),
        F.min(F.when(aired, F.col(watched))).alias("first_watched"),
        F.max(F.when(aired, F.col(watched))).alias("last_watched"),
        F.max(F.when(aired, F.col(date))).alias("latest_aired"),
    )


def next_unwatched(lines: DataFrame, keys: list[str], watched: str, order: list[Column], among: Column) -> DataFrame:
    """The first line of each key among those that qualify and are unwatched."""
    return top_k(lines.filter(among & F.col(watched).isNull()), keys, order)


def watched_status(aired: Column, watched: Column, ended: Column) -> Column:
    """finished or in_progress; null where nothing is watched."""
    return F.when(watched > 0, F.when((aired > 0) & (watched >= aired) & ended, "finished").otherwise("in_progress"))


def taste(stars: Column, pct: Column, started: Column, last_watched: Column, in_list: Column, as_of: Column) -> Column:
    """liked, not_liked, interested or null, by the first rule that applies."""
    return (
        F.when(stars >= LIKED_STARS, "liked")
        .when(stars <= DISLIKED_STARS, "not_liked")
        .when(pct >= LIKED_PCT, "liked")
        .when(started & (F.datediff(as_of, F.to_date(last_watched)) >= IDLE_DAYS), "not_liked")
        .when(in_list & started, "liked")
        .when(in_list, "interested")
    )
