"""Friends, engagement, credits and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import top_k
from .sets import symmetrise


def friends_of(edges: DataFrame, a: str, b: str, state: str, accepted: str, users: DataFrame, user: str, enabled: Column) -> DataFrame:
    """(me, other): accepted edges in both directions, towards enabled users only."""
    both = symmetrise(edges.filter(F.col(state) == accepted).select(a, b), a, b)
    return both.join(users.filter(enabled).select(F.col(user).alias("other")), "other", "left_semi").select("me", "other").distinct()


def filmography(kinds: dict[str, DataFrame]) -> DataFrame:
    """Credits of all kinds with a kind column; columns that a kind lacks are null."""
    out = None
    for kind, rows in kinds.items():
        tagged = rows.withColumn("kind", F.lit(kind))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def current_set(sets: DataFrame, user: str, status: Column, when: str, set_id: str) -> DataFrame:
    """Each user's newest succeeded set."""
    return top_k(sets.filter(status), [user], [F.desc(when), F.desc(set_id)])


def current_recommendations(sets: DataFrame, rows: DataFrame, excluded: DataFrame, live: DataFrame, user: str, set_id: str, show: str, rank: str, most: int = 12) -> DataFrame:
    """Rows of the current sets, without the user's excluded shows and without shows that aren't live; the first by rank after that."""
    mine = rows.join(sets.select(user, set_id), set_id).join(live.select(show), show, "left_semi").join(excluded.select(user, show).distinct(), [user, show], "left_anti")
    return top_k(mine, [user], [F.asc(rank)], most)


#: Labels of gender codes.
GENDERS = {1: "Female", 2: "Male", 3: "Non-Binary"}


def search_users(users: DataFrame, blocks: DataFrame, asked: str, me: int, most: int = 20, shortest: int = 2) -> DataFrame:
    """Verified users (id, name, handle, email, verified) with the text in name or handle, or with it as their address; exact tells the handle's owner, who comes first.

    Not oneself, nor whom one has blocked or is blocked by (a, b). Texts shorter than two characters find nobody.
    """
    asked = asked.strip().lower()
    if len(asked) < shortest:
        return users.withColumn("exact", F.lit(False)).limit(0)
    hidden = symmetrise(blocks, "a", "b").filter(F.col("me") == me).select(F.col("other").alias("id"))
    like = F.contains(F.lower("name"), F.lit(asked)) | F.contains(F.lower("handle"), F.lit(asked)) | (F.lower("email") == asked)
    hits = users.filter(F.col("verified") & like & (F.col("id") != me)).join(hidden, "id", "left_anti")
    return hits.withColumn("exact", F.lower("handle") == asked).orderBy(F.desc("exact"), "name", "id").limit(most)


#: Titles from which an answer is judged, and the shares of unresolved and of excluded ones that it may have.
JUDGED, UNRESOLVED, EXCLUDED = 4, 0.5, 0.9


def believable(unresolved: Column, excluded: Column, named: Column) -> Column:
    """Whether an answer may be stored: one that names few titles is not judged; else at most half unresolved and nine tenths excluded."""
    return (named < JUDGED) | ((unresolved <= named * UNRESOLVED) & (excluded <= named * EXCLUDED))
