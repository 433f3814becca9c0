"""Nested series payloads: seasons under dynamic keys, offers, ranked lists, credits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import top_k

OFFER_TYPES = ["flatrate", "rent", "buy", "free", "ads"]
_OFFER = "array<struct<provider_id:long,provider_name:string,display_priority:int>>"
PROVIDERS = f"map<string,struct<link:string,{','.join(f'{t}:{_OFFER}' for t in OFFER_TYPES)}>>"
EPISODE = "struct<id:long,season_number:int,episode_number:int,name:string,air_date:string,runtime:int,guest_stars:array<struct<id:long,name:string,character:string,credit_id:string,`order`:int>>,crew:array<struct<id:long,name:string,department:string,job:string,credit_id:string>>>"
SEASON = f"struct<_id:string,season_number:int,name:string,episodes:array<{EPISODE}>>"
AGGREGATE = "struct<cast:array<struct<id:long,name:string,`order`:int,roles:array<struct<credit_id:string,`character`:string,episode_count:int>>>>,crew:array<struct<id:long,name:string,department:string,jobs:array<struct<credit_id:string,job:string,episode_count:int>>>>>"


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def appended_seasons(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """(key, season_number, season): the season/N members of a JSON document, whatever N are there."""
    members = F.map_filter(F.from_json(body, "map<string,string>"), lambda k, _: k.startswith("season/"))
    each = payloads.select(key, F.explode(members).alias("name", "season_body"))
    return each.select(key, F.substring_index("name", "/", -1).try_cast("int").alias("season_number"), F.from_json("season_body", SEASON).alias("season"))


def merged_seasons(appended: DataFrame, overflow: DataFrame, key: str) -> DataFrame:
    """One season for each number; an overflow one replaces an appended one."""
    both = appended.withColumn("_last", F.lit(0)).unionByName(overflow.withColumn("_last", F.lit(1)))
    return top_k(both, [key, "season_number"], [F.desc("_last")]).drop("_last")


def offers(payloads: DataFrame, key: str, providers: Column) -> DataFrame:
    """(key, country, offer_type, provider_id, provider_name, display_priority) from a country map."""
    per_country = payloads.select(key, F.explode(providers).alias("country", "o"))
    typed = F.explode(F.array(*[F.struct(F.lit(t).alias("offer_type"), F.col(f"o.{t}").alias("list")) for t in OFFER_TYPES]))
    each = per_country.select(key, "country", typed.alias("t")).select(key, "country", "t.offer_type", F.explode("t.list").alias("p"))
    return each.select(key, "country", "offer_type", "p.provider_id", "p.provider_name", "p.display_priority")


def ranked_ids(payloads: DataFrame, key: str, body: str, most: int | None = None) -> DataFrame:
    """(key, rank, id): places in a results list, from 1; entries without a whole-number id leave a gap."""
    variant = F.try_variant_get(F.try_parse_json(body), "$.results", "array<variant>")
    each = payloads.select(key, F.posexplode(variant).alias("pos", "r"))
    whole = F.schema_of_variant(F.try_variant_get("r", "$.id", "variant")).isin("BIGINT", "INT")
    out = each.filter(whole).select(key, (F.col("pos") + 1).alias("rank"), F.try_variant_get("r", "$.id", "long").alias("id"))
    return out.filter(F.col("rank") <= most) if most else out


def recommendation_edges(ranked: DataFrame, live: DataFrame, source: str) -> DataFrame:
    """(source, rank, target): ranked ids that are live shows, without self and repeats; ranks keep their gaps. live has (id, target)."""
    found = ranked.join(live, "id").filter(F.col("target") != F.col(source))
    return top_k(found, [source, "target"], [F.asc("rank")]).select(source, "rank", "target")


def flatten_credits(payloads: DataFrame, key: str, credits: Column) -> tuple[DataFrame, DataFrame]:
    """(cast, crew): a row for each role or job; roles without a name keep a null one, crew without department or job drops out."""
    cast = payloads.select(key, F.explode(credits["cast"]).alias("p")).select(key, F.col("p.id").alias("person_id"), "p.name", F.col("p.order").alias("place"), F.explode("p.roles").alias("r"))
    cast = cast.select(key, "person_id", "name", "place", "r.credit_id", F.nullif(F.trim("r.character"), F.lit("")).alias("character"), "r.episode_count")
    crew = payloads.select(key, F.explode(credits["crew"]).alias("p")).select(key, F.col("p.id").alias("person_id"), "p.name", "p.department", F.explode("p.jobs").alias("j"))
    crew = crew.select(key, "person_id", "name", "department", "j.credit_id", "j.job", "j.episode_count")
    return cast, crew.filter("department <> '' AND job <> ''")


def credit_scope(episodes: DataFrame, key: str, entries: str, usable: Column) -> DataFrame:
    """Episodes whose credits a payload refreshes: null entries are left alone, an empty list clears, a list without a usable entry is left alone."""
    some = F.exists(entries, lambda x: F.coalesce(usable(x), F.lit(False)))
    return episodes.filter(F.col(entries).isNotNull() & ((F.size(entries) == 0) | some)).select(key)


# --- a whole series document ---

_COMPANY = "struct<id:long,name:string,logo_path:string,origin_country:string>"
_NAMED = "array<struct<id:long,name:string>>"
_TITLED = "struct<results:array<struct<iso_3166_1:string,title:string,type:string>>>"
#: A null namespace is absent from the document, an empty list in it is an authoritative nothing.
SERIES = f"""struct<id:long,name:string,original_name:string,original_language:string,overview:string,tagline:string,status:string,type:string,homepage:string,
 first_air_date:string,last_air_date:string,in_production:boolean,adult:boolean,popularity:double,vote_average:double,vote_count:int,number_of_seasons:int,number_of_episodes:int,poster_path:string,backdrop_path:string,
 episode_run_time:array<int>,origin_country:array<string>,languages:array<string>,genres:{_NAMED},networks:array<{_COMPANY}>,production_companies:array<{_COMPANY}>,
 created_by:array<struct<id:long,name:string,credit_id:string>>,production_countries:array<struct<iso_3166_1:string,name:string>>,spoken_languages:array<struct<iso_639_1:string,name:string>>,
 last_episode_to_air:struct<id:long,season_number:int,episode_number:int,air_date:string>,next_episode_to_air:struct<id:long,season_number:int,episode_number:int,air_date:string>,
 seasons:array<struct<id:long,season_number:int,name:string,air_date:string,episode_count:int,vote_average:double,poster_path:string>>,
 external_ids:struct<imdb_id:string,tvdb_id:long>,alternative_titles:{_TITLED},content_ratings:struct<results:array<struct<iso_3166_1:string,rating:string>>>,
 translations:struct<translations:array<struct<iso_3166_1:string,iso_639_1:string,data:struct<name:string,overview:string>>>>,images:struct<posters:array<struct<file_path:string,vote_average:double>>,backdrops:array<struct<file_path:string,vote_average:double>>>,
 videos:struct<results:array<struct<id:string,key:string,site:string,type:string>>>,keywords:struct<results:{_NAMED}>,episode_groups:struct<results:array<struct<id:string,name:string,type:int>>>,
 recommendations:struct<results:array<struct<id:long,name:string>>>,aggregate_credits:{AGGREGATE},`watch/providers`:struct<results:{PROVIDERS}>>"""
_TEXTS = ["name", "original_name", "original_language", "overview", "tagline", "status", "type", "homepage", "poster_path", "backdrop_path"]
_DATES = ["first_air_date", "last_air_date"]


def series(payloads: DataFrame, key: str, body: str) -> DataFrame:
    """(key, s): whole series documents. Keys that the schema lacks are ignored, empty texts are null, and dates are dates; season/N members are for appended_seasons()."""
    s = F.from_json(body, SERIES.replace("\n", ""))
    out = payloads.select(key, s.alias("s")).filter("s.id IS NOT NULL")
    for c in _TEXTS:
        out = out.withColumn("s", F.col("s").withField(c, empty_to_null(F.col(f"s.{c}"))))
    for c in _DATES:
        out = out.withColumn("s", F.col("s").withField(c, F.to_date(empty_to_null(F.col(f"s.{c}")))))
    pointers = ["last_episode_to_air", "next_episode_to_air"]
    for c in pointers:
        moved = F.col(f"s.{c}").withField("air_date", F.to_date(empty_to_null(F.col(f"s.{c}.air_date"))))
        out = out.withColumn("s", F.col("s").withField(c, F.when(F.col(f"s.{c}").isNotNull(), moved)))
    return out
