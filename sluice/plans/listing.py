"""Browse pages, searches, credits and sorted lists.

Parts stand for shows, an order's priority for an alias of its parts, customers
for people. A line gives a credit of its customer in its part, and an episode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold_sql, strip_article, tokens
from ..operators import catalog
from ..operators.dedup import episode_order, top_k
from ..tables import table
from .registry import query

_SHOWS = """shows AS (SELECT p_partkey AS id, p_name AS name, p_type AS kind, p_size > 45 AS deleted, CASE WHEN p_size % 10 = 0 THEN NULL ELSE DATE '1990-01-01' + p_size * 30 END AS premiered, p_retailprice AS updated FROM part),
aired AS (SELECT l_partkey AS id, max(CAST(l_shipdate AS DATE)) AS last_aired FROM lineitem WHERE l_shipdate <= TIMESTAMP '1996-01-01' GROUP BY 1), s AS (SELECT shows.*, last_aired FROM shows LEFT JOIN aired USING (id))"""
_AKAS = "akas AS (SELECT DISTINCT l_partkey AS id, o_orderpriority AS title FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _shows(spark: SparkSession, d: str) -> DataFrame:
    premiered = F.when(F.col("p_size") % 10 != 0, F.expr("date_add(DATE '1990-01-01', p_size * 30)"))
    columns = [F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), (F.col("p_size") > 45).alias("deleted"), premiered.alias("premiered"), F.col("p_retailprice").alias("updated")]
    return table(spark, d, "part").select(columns)


def _with_aired(spark: SparkSession, d: str, shows: DataFrame) -> DataFrame:
    lines = table(spark, d, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1996-01-01'")
    return shows.join(lines.groupBy(F.col("l_partkey").alias("id")).agg(F.to_date(F.max("l_shipdate")).alias("last_aired")), "id", "left")


def _akas(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("title"))
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("id")).join(o, "l_orderkey").select("id", "title").distinct()


_NAME = "regexp_replace(lower(name), '^(the|a|an) +', '')"
_KEYS = {"name": _NAME, "premiered": "premiered", "updated": "updated", "last_aired": "last_aired"}


def _browse_sql(sort: str) -> str:
    down = "DESC" if sort.startswith("-") else "ASC"
    return f"SELECT '{sort}' AS sort, id, row_number() OVER (ORDER BY {_KEYS[sort.lstrip('-')]} {down} NULLS LAST, id) AS place FROM s WHERE NOT deleted QUALIFY place BETWEEN 8 AND 14"


@query(f"WITH {_SHOWS} " + " UNION ALL ".join(_browse_sql(s) for s in catalog.BROWSE_SORTS))
def o1_browse_sorts(spark: SparkSession, d: str) -> DataFrame:
    """The second page of seven rows by each of the eight sorts."""
    rows = _with_aired(spark, d, _shows(spark, d).filter("NOT deleted"))
    pages = []
    for sort in catalog.BROWSE_SORTS:
        order = catalog.browse_order(sort, "name", "premiered", "updated", "last_aired", "id")
        place = F.row_number().over(Window.partitionBy("sort").orderBy(*order)) + 7
        pages.append(catalog.page(rows, order, 2, 7).withColumn("sort", F.lit(sort)).select("sort", "id", place.alias("place")))
    return reduce(DataFrame.unionByName, pages)


_ASKED = "red URG!"


def _search_sql(asked: str, name: str = "name") -> str:
    has = lambda c, t: f"contains({fold_sql(c)}, {fold_sql(repr(t))})"
    return " AND ".join(f"({has(name, t)} OR EXISTS (SELECT 1 FROM akas a WHERE a.id = s.id AND {has('a.title', t)}))" for t in tokens(asked))


@query(f"WITH {_SHOWS}, {_AKAS} SELECT id FROM s WHERE {_search_sql('small urgent 1-')}")
def p2_alias_search(spark: SparkSession, d: str) -> DataFrame:
    """Each token in the name or in some alias, not all in the same one."""
    return catalog.search(_shows(spark, d), _akas(spark, d), "small urgent 1-", "id", "name").select("id")


@query(f"""WITH {_SHOWS}, {_AKAS}, f AS (SELECT * FROM s WHERE NOT deleted AND kind IN ('PROMO', 'ECONOMY', 'STANDARD') AND {_search_sql(_ASKED)}
 AND id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 10) AND id IN (SELECT l_partkey FROM lineitem WHERE l_suppkey % 3 = 1))
SELECT id, name, premiered, (SELECT count(*) FROM f) AS total FROM f ORDER BY premiered DESC NULLS LAST, id LIMIT 5 OFFSET 5""")
def a11_browse_page_with_total(spark: SparkSession, d: str) -> DataFrame:
    """Search, genre, network, type and tombstone filters composed, one page and the number of all rows; the count is asked for before the page, as a page's reader needs both."""
    li = table(spark, d, "lineitem")
    rows = _shows(spark, d).filter("NOT deleted AND kind IN ('PROMO', 'ECONOMY', 'STANDARD')")
    rows = catalog.search(rows, _akas(spark, d), _ASKED, "id", "name")
    for genre in (li.filter("l_returnflag = 'R' AND l_quantity > 10"), li.filter("l_suppkey % 3 = 1")):
        rows = rows.join(genre.select(F.col("l_partkey").alias("id")), "id", "left_semi")
    order = catalog.browse_order("-premiered", "name", "premiered", "updated", "updated", "id")
    return catalog.page(rows, order, 2, 5).select("id", "name", "premiered", F.lit(rows.count()).cast("long").alias("total"))


@query(f"""WITH {_SHOWS}, {_AKAS}, m AS (SELECT id, first(title ORDER BY length(title), title) AS best FROM akas WHERE contains({fold_sql('title')}, 'e') AND contains({fold_sql('title')}, 'i') GROUP BY id)
SELECT s.id, CASE WHEN NOT (contains({fold_sql('name')}, 'e') AND contains({fold_sql('name')}, 'i')) THEN best END AS matched_alias FROM s LEFT JOIN m ON m.id = s.id""")
def p4_matched_alias(spark: SparkSession, d: str) -> DataFrame:
    return catalog.matched_alias(_shows(spark, d).select("id", "name"), _akas(spark, d), "E !! i", "id", "name")


@query(f"""SELECT c_custkey AS id FROM customer WHERE contains({fold_sql('c_name')}, 'customer0') AND contains({fold_sql('c_name')}, '00012')""")
def p3_person_search(spark: SparkSession, d: str) -> DataFrame:
    """The token rule on names alone; a query of marks finds nobody."""
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return catalog.search(people, None, "CUSTOMER#0 ?? 00-012", "id", "name").select("id").unionByName(catalog.search(people, None, " !! ", "id", "name").select("id"))


_CREDITS = """credits AS (SELECT l_partkey AS part, o_custkey AS person, CASE WHEN l_suppkey % 10 <> 0 THEN l_suppkey END AS role, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS n, nullif(l_linenumber, 3) AS billing,
  l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS air FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
_ID = "l_orderkey, l_linenumber, l_suppkey, l_extendedprice"


def _credits(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("person"))
    rows = table(spark, d, "lineitem").join(o, "l_orderkey")
    role, n, billing = F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey")), F.when(F.col("l_linenumber") != 7, F.col("l_quantity")), F.nullif("l_linenumber", F.lit(3))
    rows = rows.select(F.col("l_partkey").alias("part"), "person", role.alias("role"), n.alias("n"), billing.alias("billing"), *_ID.split(", "), "l_returnflag", "l_linestatus", F.to_date("l_shipdate").alias("air"))
    return rows.withColumn("credit", F.struct(*_ID.split(", ")))


@query(f"""WITH {_CREDITS} SELECT part, c_name AS actor, s_name AS figure, row_number() OVER (PARTITION BY part ORDER BY coalesce(n, 0) DESC, coalesce(billing, 2147483647), {_ID}) AS place
FROM credits JOIN customer ON c_custkey = person JOIN supplier ON s_suppkey = role""")
def j1_show_cast(spark: SparkSession, d: str) -> DataFrame:
    """A credit without a character drops out."""
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("actor"))
    roles = table(spark, d, "supplier").select(F.col("s_suppkey").alias("role"), F.col("s_name").alias("figure"))
    rows = catalog.credits_of(_credits(spark, d), people, roles, "person", "role")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*catalog.credit_order("n", "billing", "credit")))
    return rows.select("part", "actor", "figure", place.alias("place"))


@query(f"""WITH {_CREDITS}, jobs AS (SELECT DISTINCT l_returnflag, l_linestatus, l_returnflag || '-' || l_linestatus AS job FROM lineitem)
SELECT part, c_name AS member, job, row_number() OVER (PARTITION BY part ORDER BY coalesce(n, 0) DESC, job, {_ID}) AS place FROM credits JOIN customer ON c_custkey = person JOIN jobs USING (l_returnflag, l_linestatus)""")
def j2_show_crew(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("member"))
    rows = _credits(spark, d).join(people, "person").withColumn("job", F.concat_ws("-", "l_returnflag", "l_linestatus"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.coalesce("n", F.lit(0)).desc(), F.asc("job"), F.asc("credit")))
    return rows.select("part", "member", "job", place.alias("place"))


@query(f"""WITH {_CREDITS} SELECT l_orderkey AS episode, c_name AS guest, s_name AS figure, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(billing, 2147483647), {_ID}) AS place
FROM credits JOIN customer ON c_custkey = person JOIN supplier ON s_suppkey = role WHERE l_returnflag = 'N'""")
def j3_episode_guests(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("guest"))
    roles = table(spark, d, "supplier").select(F.col("s_suppkey").alias("role"), F.col("s_name").alias("figure"))
    rows = catalog.credits_of(_credits(spark, d).filter("l_returnflag = 'N'"), people, roles, "person", "role")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.coalesce("billing", F.lit(2**31 - 1)), "credit"))
    return rows.select(F.col("l_orderkey").alias("episode"), "guest", "figure", place.alias("place"))


@query(f"""WITH {_CREDITS} SELECT person, part, air, l_returnflag AS job FROM credits JOIN customer ON c_custkey = person JOIN part ON p_partkey = part WHERE l_returnflag <> 'N' AND p_size <= 45
QUALIFY row_number() OVER (PARTITION BY person ORDER BY air DESC NULLS LAST, {_ID}) <= 10""")
def j5_person_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Person, credit, episode and show: each person's latest ten."""
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person"))
    shows = table(spark, d, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("part"))
    rows = _credits(spark, d).filter("l_returnflag <> 'N'").join(people, "person").join(shows, "part")
    return top_k(rows, ["person"], [F.desc_nulls_last("air"), F.asc("credit")], 10).select("person", "part", "air", F.col("l_returnflag").alias("job"))


@query("""WITH k AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'episode' ELSE 'show' END AS target, o_custkey FROM orders),
e AS (SELECT l_orderkey, min(l_partkey) AS part FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey)
SELECT o_orderkey, target, CASE WHEN target = 'show' THEN o_custkey ELSE part END AS of_part, p_name FROM k LEFT JOIN e ON target = 'episode' AND l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = CASE WHEN target = 'show' THEN o_custkey ELSE part END""")
def j9_conditional_left_join(spark: SparkSession, d: str) -> DataFrame:
    """The key that the second join goes by is a column first, so both stay equi-joins."""
    k = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "episode").otherwise("show").alias("target"), "o_custkey")
    e = table(spark, d, "lineitem").filter("l_linenumber <= 3").groupBy("l_orderkey").agg(F.min("l_partkey").alias("part"))
    rows = k.join(e, (F.col("target") == "episode") & (F.col("l_orderkey") == F.col("o_orderkey")), "left")
    rows = rows.withColumn("of_part", F.when(F.col("target") == "show", F.col("o_custkey")).otherwise(F.col("part")))
    shows = table(spark, d, "part").select(F.col("p_partkey").alias("of_part"), "p_name")
    return rows.join(shows, "of_part", "left").select("o_orderkey", "target", "of_part", "p_name")


_ENTRIES = """entries AS (SELECT o_custkey AS cust, l_partkey AS part, min(CAST(o_orderdate AS DATE)) AS added_at, max(CAST(l_shipdate AS DATE)) FILTER (l_linenumber <= 4) AS last_aired, min(CAST(l_shipdate AS DATE)) FILTER (l_linenumber >= 3) AS airdate,
  min(CAST(o_orderdate AS DATE)) FILTER (l_quantity > 25) AS first_watched, max(CAST(o_orderdate AS DATE)) FILTER (l_quantity > 25) AS last_watched, max(l_quantity) FILTER (l_quantity > 30) AS stars FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
e AS (SELECT entries.*, p_name AS name, CASE WHEN p_size % 10 = 0 THEN NULL ELSE DATE '1990-01-01' + p_size * 30 END AS premiered FROM entries JOIN part ON p_partkey = part)"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """One aggregate for all that the lists sort by."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("day"))
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part"), "l_linenumber", "l_quantity", F.to_date("l_shipdate").alias("air")).join(o, "l_orderkey")
    some = lambda cond, c: F.when(F.expr(cond), F.col(c))
    e = li.groupBy("cust", "part").agg(
        F.min("day").alias("added_at"), F.max(some("l_linenumber <= 4", "air")).alias("last_aired"), F.min(some("l_linenumber >= 3", "air")).alias("airdate"),
        F.min(some("l_quantity > 25", "day")).alias("first_watched"), F.max(some("l_quantity > 25", "day")).alias("last_watched"), F.max(some("l_quantity > 30", "l_quantity")).alias("stars"),
    )
    return e.join(_shows(spark, d).select(F.col("id").alias("part"), "name", "premiered"), "part")


def _list_sql(kind: str) -> str:
    places = []
    for sort in _sorts(kind):
        if sort.startswith("my_rating"):
            order = f"stars {'DESC' if sort.endswith('desc') else 'ASC'} NULLS LAST, {_NAME}"
        else:
            column, down, missing = catalog.LIST_SORTS[kind][sort]
            way = "DESC" if down else "ASC"
            value = f"coalesce({column}, DATE '{missing}')" if missing else column
            order = f"{_NAME} {way}" if column is None else f"{value} {way}" + ("" if sort == "added" else f", {_NAME} {way}")
        places.append(f"CAST(row_number() OVER (PARTITION BY cust ORDER BY {order}, part) AS INTEGER) AS {sort}")
    return f"WITH {_ENTRIES} SELECT cust, part, {', '.join(places)} FROM e"


def _sorts(kind: str) -> list[str]:
    return [*catalog.LIST_SORTS[kind], *(("my_rating_desc", "my_rating_asc") if kind == "my_shows" else ())]


def _list(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Each entry's place in its user's list by every sort; all windows have one partitioning, so one shuffle."""
    w = Window.partitionBy("cust")
    return _entries(spark, d).select("cust", "part", *[F.row_number().over(w.orderBy(*catalog.list_order(kind, s, "name", "part"))).alias(s) for s in _sorts(kind)])


@query(_list_sql("my_shows"))
def o9_my_shows_sorts(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, "my_shows")


@query(_list_sql("watch_next"))
def o10_watch_next_sorts(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, "watch_next")


@query(_list_sql("upcoming"))
def o11_upcoming_sorts(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, "upcoming")


@query(_list_sql("upcoming_seasons"))
def o11_upcoming_season_sorts(spark: SparkSession, d: str) -> DataFrame:
    """Dates that aren't known come last either way."""
    return _list(spark, d, "upcoming_seasons")


@query(_list_sql("watched"))
def o12_watched_sorts(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, "watched")


@query("SELECT l_partkey, l_linenumber % 4 AS season, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber % 4 = 0, l_linenumber % 4) AS INTEGER) AS place FROM lineitem GROUP BY 1, 2")
def o7_season_order(spark: SparkSession, d: str) -> DataFrame:
    """Regular seasons by number, then the specials."""
    seasons = table(spark, d, "lineitem").select("l_partkey", (F.col("l_linenumber") % 4).alias("season")).distinct()
    return seasons.withColumn("place", F.row_number().over(Window.partitionBy("l_partkey").orderBy(F.col("season") == 0, "season")))


@query("SELECT 'type' AS list, p_type AS name FROM part UNION SELECT 'brand', p_brand FROM part UNION SELECT 'network', s_name FROM supplier")
def o17_vocabularies(spark: SparkSession, d: str) -> DataFrame:
    """Flat lists of names; ordering is the reader's, by (list, name)."""
    p = table(spark, d, "part")
    lists = [p.select(F.lit("type").alias("list"), F.col("p_type").alias("name")), p.select(F.lit("brand").alias("list"), F.col("p_brand").alias("name")), table(spark, d, "supplier").select(F.lit("network").alias("list"), F.col("s_name").alias("name"))]
    return reduce(DataFrame.unionByName, [x.distinct() for x in lists])


@query("SELECT p_partkey FROM part WHERE p_partkey > 17 AND p_size <= 45 ORDER BY p_partkey LIMIT 25")
def o4_keyset_by_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_partkey > 17 AND p_size <= 45").select("p_partkey").orderBy("p_partkey").limit(25)


@query("""WITH q AS (SELECT p_partkey, coalesce(nullif(CAST(p_size AS DOUBLE), 50), -1) AS popularity FROM part) SELECT p_partkey, popularity FROM q WHERE popularity < 44 OR (popularity = 44 AND p_partkey < 90) ORDER BY popularity DESC, p_partkey DESC LIMIT 25""")
def o5_keyset_by_popularity(spark: SparkSession, d: str) -> DataFrame:
    """Missing popularity counts as -1, so the last pages have those."""
    q = table(spark, d, "part").select("p_partkey", F.coalesce(F.nullif(F.col("p_size").cast("double"), F.lit(50.0)), F.lit(-1.0)).alias("popularity"))
    return q.filter("popularity < 44 OR (popularity = 44 AND p_partkey < 90)").orderBy(F.desc("popularity"), F.desc("p_partkey")).limit(25)


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_linenumber % 3 = 0 OR l_linenumber - 2 < 0 AS special, l_linenumber - 2 < 0 AS copied, CASE WHEN l_linenumber - 2 >= 0 THEN l_linenumber - 2 END AS shown,
 CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber % 3 = 0, l_linenumber % 3, l_linenumber - 2 < 0, l_linenumber - 2, l_orderkey, l_suppkey, l_extendedprice) AS INTEGER) AS place FROM lineitem""")
def p5_specials(spark: SparkSession, d: str) -> DataFrame:
    season, number = F.col("l_linenumber") % 3, F.col("l_linenumber") - 2
    order = [*episode_order(season, number), F.asc("l_orderkey"), F.asc("l_suppkey"), F.asc("l_extendedprice")]
    place = F.row_number().over(Window.partitionBy("l_partkey").orderBy(*order))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", catalog.special(season, number).alias("special"), (number < 0).alias("copied"), catalog.public_number(number).alias("shown"), place.alias("place"))


@query(f"""WITH {_SHOWS}, g AS (SELECT l_partkey AS id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS genres, first(l_suppkey ORDER BY s_name, l_suppkey) AS network FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1),
r AS (SELECT l_partkey AS id, CAST(round_even(avg(CAST(l_discount * 100 AS INTEGER)), 1) AS DOUBLE) AS rating FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey < 400 GROUP BY 1),
page AS (SELECT * FROM s WHERE NOT deleted ORDER BY {_NAME}, id LIMIT 20) SELECT page.id, name, coalesce(genres, '') AS genres, network, rating FROM page LEFT JOIN g USING (id) LEFT JOIN r USING (id)""")
def r8_hydrated_page(spark: SparkSession, d: str) -> DataFrame:
    """Genres, network and rating are looked up for the rows of the page only."""
    rows = catalog.page(_shows(spark, d).filter("NOT deleted"), [strip_article(F.col("name")).asc_nulls_last(), F.asc("id")], 1, 20)
    on_page = F.broadcast(rows.select("id"))  # at most 100 rows
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), "l_suppkey", "l_orderkey", "l_returnflag", "l_discount").join(on_page, "id")
    named = li.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    refs = named.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("genres"), F.min(F.struct("s_name", "l_suppkey")).alias("first"))
    own = table(spark, d, "orders").filter("o_custkey < 400").select(F.col("o_orderkey").alias("l_orderkey"))
    ratings = li.join(own, "l_orderkey", "left_semi").groupBy("id").agg(F.bround(F.avg(F.rint(F.col("l_discount") * 100)), 1).alias("rating"))
    return rows.join(refs, "id", "left").join(ratings, "id", "left").select("id", "name", F.coalesce("genres", F.lit("")).alias("genres"), F.col("first.l_suppkey").alias("network"), "rating")


@query("""WITH q AS (SELECT o_custkey AS me, l_partkey AS part, o_orderkey, l_quantity AS stars, CAST(o_orderdate AS DATE) AS rated, l_linenumber, l_suppkey, l_extendedprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT DISTINCT c_custkey AS me FROM customer WHERE c_nationkey = 3) SELECT part, me, stars, rated FROM q JOIN f USING (me) QUALIFY row_number() OVER (PARTITION BY part ORDER BY rated DESC, me, o_orderkey, l_linenumber, l_suppkey, l_extendedprice) <= 3""")
def p18_friends_ratings(spark: SparkSession, d: str) -> DataFrame:
    """Each show's newest ratings by a set of users."""
    friends = table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, d, "orders").join(friends, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("me"), F.to_date("o_orderdate").alias("rated"))
    rows = table(spark, d, "lineitem").join(o, "l_orderkey").withColumnRenamed("l_partkey", "part")
    first = top_k(rows, ["part"], [F.desc("rated"), F.asc("me"), *[F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]], 3)
    return first.select("part", "me", F.col("l_quantity").alias("stars"), "rated")
