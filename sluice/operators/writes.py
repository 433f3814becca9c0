"""Writes as pure functions, continued: payload upserts, swaps, verdicts, events, imports, handles. (old table, batch) gives the new one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import top_k


class Aborted(ValueError):
    """A batch whose counts don't add up and that must not be applied."""


def key_map(table: DataFrame, natural: str, key: str, batch: DataFrame) -> DataFrame:
    """(natural, key) of the batch's natural keys, as an upsert returns them; keys that come twice come once."""
    return table.select(natural, key).join(batch.select(natural).distinct(), natural, "left_semi")


def upsert_present(old: DataFrame, batch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Batch values replace old ones, nulls too, where the payload has the column: has_<column>; else the old value stays."""
    new = batch.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns], *[F.col(f"has_{c}").alias(f"_has_{c}") for c in columns])
    both = old.join(new, old[key] == new["_key"], "full_outer")
    return both.select(F.coalesce(key, "_key").alias(key), *[F.when(F.coalesce(f"_has_{c}", F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def replace_namespace(old: DataFrame, payload: DataFrame, parent: str, entries: str, fields: list[str]) -> DataFrame:
    """Children of each parent whose payload has the namespace give way to its entries; a null namespace leaves them alone, an empty one clears them."""
    given = payload.filter(F.col(entries).isNotNull())
    new = given.select(parent, F.explode(entries).alias("_e")).select(parent, *[F.col(f"_e.{f}").alias(f) for f in fields]).distinct()
    return old.select(parent, *fields).join(given.select(parent), parent, "left_anti").unionByName(new)


def season_ids(episodes: DataFrame, seasons: DataFrame, show: str, number: str, key: str) -> DataFrame:
    """episodes with the id of their season by number; of several seasons with a number the highest id counts."""
    best = seasons.groupBy(show, number).agg(F.max(key).alias(key))
    return episodes.join(best, [show, number], "left")


def swap_snapshot(old: DataFrame, ranked: DataFrame, known: DataFrame, upstream: str, key: str, rank: str) -> DataFrame:
    """(key, rank): the new snapshot's entries that are known, each once at its best rank; the old snapshot where none is."""
    found = ranked.join(known, upstream)
    return old.select(key, rank) if found.isEmpty() else found.groupBy(key).agg(F.min(rank).alias(rank)).select(key, rank)


def apply_verdicts(offsets: DataFrame, verdicts: DataFrame, show: str, season: str, days: str) -> DataFrame:
    """Offsets after verdicts: a shift is written, no shift (0) retracts the season's, a refusal (null) leaves it; rows without a season are an operator's and stay."""
    given = verdicts.filter(F.col(days).isNotNull() & F.col(season).isNotNull())
    kept = offsets.join(given.select(show, season), [show, season], "left_anti")
    return kept.unionByName(given.filter(F.col(days) != 0).select(offsets.columns))


def reconciled_delete(rows: DataFrame, doomed: DataFrame, references: Sequence[DataFrame], key: str) -> DataFrame:
    """rows without the doomed keys; raises Aborted if anything still refers to one of them, or if the counts don't add up."""
    wanted = doomed.select(key).distinct()
    blocked = [r.toDF(key).join(wanted, key, "left_semi") for r in references]
    if blocked and not reduce(DataFrame.unionAll, blocked).isEmpty():
        raise Aborted("something refers to a row that is to go")
    left = rows.join(wanted, key, "left_anti")
    # an aggregate of one row over the tagged rows, so that nothing is counted from two reads
    counts = rows.join(wanted.withColumn("_doomed", F.lit(1)), key, "left").agg(F.count("_doomed").alias("gone"), F.countDistinct(F.when(F.col("_doomed") == 1, F.col(key))).alias("keys")).first()
    if counts.keys != wanted.count():
        raise Aborted(f"{counts.keys} of the doomed keys are there")
    return left


def collapse_events(events: DataFrame, marks: DataFrame, episodes: DataFrame, covered: Column) -> DataFrame:
    """Events without those of episodes that a mark covers. marks has (actor, show, season or null), episodes (episode, show, season); covered tells which episodes a mark speaks for.

    Each (actor, episode) that has events looks up its season and then its
    actor's marks; what else a mark covers is not spelled out.
    """
    watched = events.filter("verb = 'watched_episode'")
    owned = episodes.filter(covered).select(F.col("episode").alias("target"), "show", F.explode(F.array("season", F.lit(None))).alias("_season")).distinct()
    m = marks.select("actor", "show", F.col("season").alias("_marked")).distinct().alias("m")
    asked = watched.select("actor", "target").distinct().join(owned, "target").alias("a")
    on = (F.col("a.actor") == F.col("m.actor")) & (F.col("a.show") == F.col("m.show")) & F.col("a._season").eqNullSafe(F.col("m._marked"))
    gone = asked.join(m, on, "left_semi").select("actor", "target").distinct()
    single = watched.join(gone, ["actor", "target"], "left_anti").select(events.columns)
    return events.filter("verb <> 'watched_episode'").unionByName(single)


def cancel_events(events: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Events without those that a state change takes back: same actor, verb and target, null seasons equal."""
    keys = ["actor", "verb", "target"]
    c = cancelled.select(*[F.col(k).alias(f"_{k}") for k in (*keys, "season")])
    on = reduce(lambda x, k: x & (events[k] == c[f"_{k}"]), keys, events["season"].eqNullSafe(c["_season"]))
    return events.join(c, on, "left_anti")


def unmark(watched: DataFrame, user: str, episode: str, episodes: DataFrame, marks: DataFrame) -> DataFrame:
    """watched without all episodes of the users' shows, specials too (marking leaves those out). marks has (user, show), episodes (episode, show)."""
    gone = episodes.join(marks, "show").select(user, episode).distinct()
    return watched.join(gone, [user, episode], "left_anti")


def ranked_set(rows: DataFrame, set_id: str, shows: str) -> DataFrame:
    """(set_id, rank, show): the rows of a set, ranked from 1 in their order, each show at its first place."""
    each = rows.select(set_id, F.posexplode(shows).alias("_pos", "show"))
    first = each.groupBy(set_id, "show").agg(F.min("_pos").alias("_pos"))
    return first.select(set_id, F.row_number().over(Window.partitionBy(set_id).orderBy("_pos")).alias("rank"), "show")


def run_state(runs: DataFrame, deltas: DataFrame, run: str, stale_after: Column, now: Column) -> DataFrame:
    """Runs with their deltas added up; a running one that nothing has touched for too long is cancelled, finished ones stay as they are."""
    sums = deltas.groupBy(run).agg(F.sum("processed").alias("_p"), F.sum("failed").alias("_f"), F.max("at").alias("_at"))
    both = runs.join(sums, run, "left")
    touched = F.greatest(F.col("touched"), F.col("_at"))
    stale = (F.col("status") == "running") & (touched < now - stale_after)
    status = F.when(stale, "cancelled").otherwise(F.col("status"))
    return both.select(run, status.alias("status"), (F.col("processed") + F.coalesce("_p", F.lit(0))).alias("processed"), (F.col("failed") + F.coalesce("_f", F.lit(0))).alias("failed"))


def staged_import(watched: DataFrame, staged: DataFrame, user: str, episode: str) -> tuple[DataFrame, DataFrame]:
    """(watched, counts) after staged rows (user, episode, outcome, at) that are ok go in where there is no such row yet; counts has before, after, inserted, skipped."""
    ok = staged.filter("outcome = 'ok'").groupBy(user, episode).agg(F.min("at").alias("at"))
    new = ok.join(watched.select(user, episode), [user, episode], "left_anti")
    out = watched.select(user, episode, "at").unionByName(new)
    tagged = watched.select(F.lit("before").alias("k")).unionAll(new.select(F.lit("inserted").alias("k"))).unionAll(staged.select(F.lit("staged").alias("k")))
    counts = tagged.agg(*[F.count_if(F.col("k") == x).alias(x) for x in ("before", "inserted", "staged")])
    counts = counts.select("before", "inserted", (F.col("before") + F.col("inserted")).alias("after"), (F.col("staged") - F.col("inserted")).alias("skipped"))
    return out, counts


def resolutions(automatic: DataFrame, manual: DataFrame, key: str) -> DataFrame:
    """One resolution for each key; a manual one wins."""
    both = manual.withColumn("_by", F.lit(0)).unionByName(automatic.withColumn("_by", F.lit(1)))
    return top_k(both, [key], [F.asc("_by")]).drop("_by")


def collision_verdicts(claims: DataFrame, key: str, claimant: str, exact: str) -> DataFrame:
    """claims with a verdict: of several claimants of a key the one exact claim keeps it and guesses are retracted; several exact ones are a conflict; guesses alone are all retracted."""
    w = Window.partitionBy(key)
    exacts, all_ = F.count_if(F.col(exact)).over(w), F.count(claimant).over(w)
    verdict = F.when(all_ == 1, "keep").when(F.col(exact) & (exacts == 1), "keep").when(F.col(exact), "conflict").otherwise("retract")
    return claims.withColumn("verdict", verdict)


def claimable(wanted: DataFrame, live: DataFrame, released: DataFrame, handle: str, user: str) -> DataFrame:
    """wanted (user, handle) with ok: nobody else holds the handle, and nobody else (a deleted account is nobody's self) has released it."""
    held = live.select(handle, F.col(user).alias("_holder"))
    let = released.select(handle, F.col(user).alias("_former"), F.lit(True).alias("_gone"))
    both = wanted.join(held, handle, "left").join(let, handle, "left")
    free = F.col("_holder").isNull() | (F.col("_holder") == F.col(user))
    never = F.col("_gone").isNull() | F.coalesce(F.col("_former") == F.col(user), F.lit(False))
    return both.select(user, handle, (free & never).alias("ok"))


def touched_at_most_every(last: Column, now: Column, seconds: int = 60) -> Column:
    """The new time of a throttled touch: now, unless the last one is too recent."""
    return F.when(last.isNull() | (now - last >= F.expr(f"INTERVAL {seconds} SECONDS")), now).otherwise(last)


def watched_at(mode: str, airdate: Column, signup: Column, now: Column) -> Column:
    """When an imported watch counts as watched: now, on the air date, or there but not before the account."""
    aired = F.coalesce(airdate, now)
    if mode == "airdate":
        return aired
    return F.greatest(aired, signup) if mode == "airdate_floor" else now


def bucket_tokens(capacity: float, tokens: Column, elapsed: Column, rate: float) -> Column:
    """Tokens of a bucket that fills at a rate up to its capacity."""
    return F.least(F.lit(capacity), tokens + elapsed * rate)
