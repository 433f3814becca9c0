"""Browsing a catalog: search over names and aliases, sorts, pages, credits and projections."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, strip_article, tokens


def search(shows: DataFrame, akas: DataFrame | None, query: str, key: str, name: str, title: str = "title") -> DataFrame:
    """shows whose name or aliases have every token of the query; different aliases may have different tokens.

    A query without a token that is more than punctuation finds nothing. One
    pass over the aliases serves all tokens.
    """
    wanted = tokens(query)
    if not wanted:
        return shows.limit(0)
    has = lambda text, k: F.contains(text, fold(F.lit(wanted[k])))
    own = [has(fold(F.col(name)), k) for k in range(len(wanted))]
    if akas is None:
        return shows.filter(reduce(and_, own))
    flags = akas.groupBy(F.col(key).alias("_key")).agg(*[F.bool_or(has(fold(F.col(title)), k)).alias(f"_t{k}") for k in range(len(wanted))])
    every = reduce(and_, [own[k] | F.coalesce(f"_t{k}", F.lit(False)) for k in range(len(wanted))])
    return shows.join(flags, shows[key] == flags["_key"], "left").filter(every).select([shows[c] for c in shows.columns])


def matched_alias(shows: DataFrame, akas: DataFrame, query: str, key: str, name: str, title: str = "title") -> DataFrame:
    """(key, matched_alias): the shortest alias (then the lowest) that has all tokens; null where the name has them itself, or no alias does."""
    wanted = tokens(query)
    if not wanted:
        return shows.select(key, F.lit(None).cast("string").alias("matched_alias"))
    every = lambda c: reduce(and_, [F.contains(fold(F.col(c)), fold(F.lit(t))) for t in wanted])
    best = akas.filter(every(title)).groupBy(key).agg(F.min_by(title, F.struct(F.length(title), title)).alias("_best"))
    return shows.join(best, key, "left").select(key, F.when(~every(name), F.col("_best")).alias("matched_alias"))


def browse_order(sort: str, name: str, premiered: str, updated: str, last_aired: str, key: str) -> list[Column]:
    """The order of one of the eight sorts: a key, or -key for the other way; dates that are missing come last; the id decides ties."""
    down, by = sort.startswith("-"), sort.lstrip("-")
    exprs = {"name": strip_article(F.col(name)), "premiered": F.col(premiered), "updated": F.col(updated), "last_aired": F.col(last_aired)}
    if by not in exprs:
        raise ValueError(f"no sort {sort}")
    return [exprs[by].desc_nulls_last() if down else exprs[by].asc_nulls_last(), F.asc(key)]


BROWSE_SORTS = [f"{sign}{by}" for by in ("name", "premiered", "updated", "last_aired") for sign in ("", "-")]


def page(rows: DataFrame, order: list[Column], number: int, per_page: int) -> DataFrame:
    """A page (from 1); pages go to 1,000 and have 100 rows at most."""
    number, per_page = min(max(number, 1), 1000), min(max(per_page, 1), 100)
    return rows.orderBy(*order).offset((number - 1) * per_page).limit(per_page)


def credit_order(count: str, place: str, key: str) -> list[Column]:
    """Most present first, then by billing (missing last), then by id."""
    return [F.coalesce(count, F.lit(0)).desc(), F.coalesce(place, F.lit(2**31 - 1)).asc(), F.asc(key)]


def credits_of(credits: DataFrame, people: DataFrame, roles: DataFrame, person: str, role: str) -> DataFrame:
    """Credits with person and role; a credit without a role drops out, as its join is inner. Both are looked up by key."""
    return credits.join(people, person).join(roles, role)


#: The sorts of each list: (key, whether it goes down, what stands for a missing value). A sort that goes down takes the name down with it.
_LOW, _HIGH, _EPOCH = "0001-01-01", "9999-12-31", "1970-01-01"
LIST_SORTS: dict[str, dict[str, tuple[str | None, bool, str | None]]] = {
    "my_shows": {"name_asc": (None, False, None), "name_desc": (None, True, None), "added": ("added_at", True, None), "recent_activity": ("last_aired", True, _EPOCH)},
    "watch_next": {"airdate_asc": ("airdate", False, _LOW), "unwatched_airdate_desc": ("airdate", True, _LOW), "name_asc": (None, False, None), "name_desc": (None, True, None), "airdate_desc": ("last_aired", True, _LOW)},
    "upcoming": {"airdate_desc": ("airdate", True, _LOW), "added_desc": ("added_at", True, _EPOCH), "name_asc": (None, False, None), "name_desc": (None, True, None), "airdate_asc": ("airdate", False, _LOW)},
    "upcoming_seasons": {"airdate_desc": ("airdate", True, _LOW), "added_desc": ("added_at", True, _EPOCH), "name_asc": (None, False, None), "name_desc": (None, True, None), "airdate_asc": ("airdate", False, _HIGH)},
    "watched": {"name_asc": (None, False, None), "last_aired_desc": ("last_aired", True, _EPOCH), "premiered_asc": ("premiered", False, _HIGH), "premiered_desc": ("premiered", True, _EPOCH), "first_watched_desc": ("first_watched", True, _EPOCH), "last_watched_desc": ("last_watched", True, _EPOCH)},
}


def list_order(kind: str, sort: str, name: str, key: str, stars: str = "stars") -> list[Column]:
    """The order of a list by one of its sorts. Missing dates have the sort's own stand-in; the id decides what is left."""
    by_name = strip_article(F.col(name))
    if kind == "my_shows" and sort in ("my_rating_desc", "my_rating_asc"):  # rated ones first; the name goes up either way
        rated = F.col(stars).desc_nulls_last() if sort.endswith("desc") else F.col(stars).asc_nulls_last()
        return [rated, by_name.asc(), F.asc(key)]
    column, down, missing = LIST_SORTS[kind][sort]
    if column is None:
        return [by_name.desc() if down else by_name.asc(), F.asc(key)]
    value = F.col(column) if missing is None else F.coalesce(F.col(column), F.lit(missing).cast("date"))
    if column == "added_at" and kind == "my_shows":
        return [value.desc(), F.asc(key)]
    return [value.desc(), by_name.desc(), F.asc(key)] if down else [value.asc(), by_name.asc(), F.asc(key)]


def public_number(number: Column) -> Column:
    """An episode number for readers: null for a copied special, whose negative number is made up."""
    return F.when(number >= 0, number)


def special(season: Column, number: Column) -> Column:
    """Season 0, or a copied special."""
    return (season == 0) | (number < 0)
