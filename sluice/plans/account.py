"""A user's view: search for people, memberships, sessions, upcoming lists, exports and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import completion_pct
from ..functions.text import fold, fold_sql
from ..operators import people
from ..operators.catalog import special
from ..operators.dedup import top_k
from ..operators.sets import snapshot_diff, symmetrise
from ..sources.sinks import canonical_json
from ..tables import table
from .registry import query

_USERS = "users AS (SELECT c_custkey AS id, c_name AS name, 'u_' || c_custkey AS handle, lower(c_mktsegment) || c_custkey || '@mail.org' AS email, c_acctbal >= 0 AS verified FROM customer)"
_BLOCKS = "blocks AS (SELECT DISTINCT o_custkey AS a, (o_custkey + o_orderkey) % 150 AS b FROM orders WHERE o_orderstatus = 'P')"


def _users(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("u_"), k).alias("handle"), F.concat(F.lower("c_mktsegment"), k, F.lit("@mail.org")).alias("email"), (F.col("c_acctbal") >= 0).alias("verified"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") + F.col("o_orderkey")) % 150).alias("b")).distinct()


@query(f"""WITH {_USERS}, {_BLOCKS}, hid AS (SELECT 5 AS id UNION SELECT b FROM blocks WHERE a = 5 UNION SELECT a FROM blocks WHERE b = 5)
SELECT id, handle, handle = 'u_1' AS exact FROM users WHERE verified AND (contains(lower(name), 'u_1') OR contains(lower(handle), 'u_1') OR lower(email) = 'u_1') AND id NOT IN (SELECT id FROM hid) ORDER BY exact DESC, name, id LIMIT 20""")
def p7_user_search_route(spark: SparkSession, d: str) -> DataFrame:
    """By part of a name or handle, or a whole address; not oneself, nor anyone blocked either way. Marks of LIKE stand for themselves."""
    return people.search_users(_users(spark, d), _blocks(spark, d), "U_1", 5).select("id", "handle", "exact")


@query(f"WITH {_USERS} SELECT id, handle, false AS exact FROM users WHERE verified AND email = 'machinery1@mail.org'")
def p6_search_by_address(spark: SparkSession, d: str) -> DataFrame:
    out = people.search_users(_users(spark, d), _blocks(spark, d), " Machinery1@mail.org ", -1).select("id", "handle", "exact")
    return out.unionByName(people.search_users(_users(spark, d), _blocks(spark, d), "u", -1).select("id", "handle", "exact"))  # too short: nobody


@query("""SELECT max(ts) FILTER (ts >= TIMESTAMP '2024-01-24') AS captured_at, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS n, max(ts) FILTER (ts >= TIMESTAMP '2030-01-01') AS none_captured FROM events WHERE event_type = 'signup'""")
def p9_captured_at(spark: SparkSession, d: str) -> DataFrame:
    """When a snapshot was captured is null exactly where nothing of it is fresh."""
    at = lambda day: F.max(F.when(F.expr(f"ts >= TIMESTAMP_NTZ '{day}'"), F.col("ts")))
    e = table(spark, d, "events").filter("event_type = 'signup'")
    return e.agg(at("2024-01-24").alias("captured_at"), F.count_if(F.expr("ts >= TIMESTAMP_NTZ '2024-01-24'")).alias("n"), at("2030-01-01").alias("none_captured"))


@query("""WITH ids AS (SELECT p_partkey AS id FROM part WHERE p_size = 7), t AS (SELECT l_partkey AS id, bool_or(o_custkey < 100) AS tracked, bool_or(l_quantity > 45) AS watched, bool_or(l_linestatus = 'F') AS hidden FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT id, coalesce(tracked, false) AS tracked, coalesce(watched, false) AS watched, coalesce(hidden, false) AS hidden FROM ids LEFT JOIN t USING (id)""")
def p11_membership_flags(spark: SparkSession, d: str) -> DataFrame:
    """Which of a set of ids are tracked, watched or hidden: one look at the lines of these ids."""
    ids = table(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("id"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), "l_orderkey", "l_quantity", "l_linestatus").join(ids, "id", "left_semi").join(o, "l_orderkey")
    flags = li.groupBy("id").agg(F.bool_or(F.col("o_custkey") < 100).alias("tracked"), F.bool_or(F.col("l_quantity") > 45).alias("watched"), F.bool_or(F.col("l_linestatus") == "F").alias("hidden"))
    return ids.join(flags, "id", "left").na.fill(False)


@query("""SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type = 'click' AND ts + INTERVAL 10 DAYS > TIMESTAMP '2024-01-31'""")
def p12_active_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that haven't expired, the latest activity first."""
    e = table(spark, d, "events").filter("event_type = 'click' AND ts + INTERVAL 10 DAYS > TIMESTAMP_NTZ '2024-01-31'")
    return e.select("user_id", "event_id", "ts", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).alias("place"))


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS DISTINCT FROM '1-URGENT'")
def p14_not_human(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose method isn't the given one; those without a method count."""
    method = F.nullif("o_orderpriority", F.lit("5-LOW"))
    return table(spark, d, "orders").filter(~method.eqNullSafe(F.lit("1-URGENT"))).select("o_orderkey")


@query("SELECT c_custkey, CASE c_nationkey % 5 WHEN 1 THEN 'Female' WHEN 2 THEN 'Male' WHEN 3 THEN 'Non-Binary' END AS gender FROM customer")
def f26_gender_labels(spark: SparkSession, d: str) -> DataFrame:
    """Codes without a label, 0 among them, are null."""
    labels = F.create_map(*[F.lit(x) for kv in people.GENDERS.items() for x in kv])
    return table(spark, d, "customer").select("c_custkey", labels[F.col("c_nationkey") % 5].alias("gender"))


@query("""SELECT l_partkey, l_linenumber % 4 AS season, count(*) AS aired FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-01-01' AND CAST(l_quantity AS INTEGER) % 6 - 1 >= 0 GROUP BY 1, 2""")
def a4_aired_per_season(spark: SparkSession, d: str) -> DataFrame:
    """Copied specials aren't counted, season 0 is."""
    li = table(spark, d, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '2000-01-01' AND CAST(l_quantity AS INT) % 6 - 1 >= 0")
    return li.groupBy("l_partkey", (F.col("l_linenumber") % 4).alias("season")).agg(F.count("*").alias("aired"))


_WATCHED = "w AS (SELECT o_custkey AS usr, l_partkey AS part, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 25)"


def _watched(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("usr"))
    return table(spark, d, "lineitem").filter("l_quantity > 25").join(o, "l_orderkey").select("usr", F.col("l_partkey").alias("part"), "l_linenumber")


@query(f"WITH {_WATCHED} SELECT part, count(DISTINCT usr) AS users, count(DISTINCT usr) FILTER (usr < 50) AS friends FROM w GROUP BY part")
def a7_watchers(spark: SparkSession, d: str) -> DataFrame:
    """Shows with a watch at all, and how many users, and friends, watched them."""
    return _watched(spark, d).groupBy("part").agg(F.countDistinct("usr").alias("users"), F.countDistinct(F.when(F.col("usr") < 50, F.col("usr"))).alias("friends"))


@query(f"""WITH {_WATCHED}, a AS (SELECT part, count(*) AS watches FROM w GROUP BY 1), r AS (SELECT l_partkey AS part, count(*) AS ratings FROM lineitem WHERE l_discount >= 0.09 GROUP BY 1)
SELECT p_partkey, coalesce(watches, 0) AS watches, coalesce(ratings, 0) AS ratings FROM part LEFT JOIN a ON a.part = p_partkey LEFT JOIN r ON r.part = p_partkey WHERE p_size > 45 AND (watches > 0 OR ratings > 0) ORDER BY watches + ratings DESC, p_partkey LIMIT 50""")
def a17_unmapped_touched(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an upstream id that users touched, the most touched first."""
    open_ = table(spark, d, "part").filter("p_size > 45").select("p_partkey")
    li = table(spark, d, "lineitem").filter("l_quantity > 25 OR l_discount >= 0.09").join(open_, F.col("l_partkey") == F.col("p_partkey"))
    # both counts from one pass over the lines
    n = li.groupBy("p_partkey").agg(F.count_if(F.col("l_quantity") > 25).alias("watches"), F.count_if(F.col("l_discount") >= 0.09).alias("ratings"))
    return n.orderBy(F.desc(F.col("watches") + F.col("ratings")), "p_partkey").limit(50)


@query("""WITH a AS (SELECT l_partkey, string_agg(l_suppkey, ',' ORDER BY l_suppkey) AS ids, min_by(l_suppkey, l_extendedprice * 100000 + l_suppkey) AS first_id FROM (SELECT DISTINCT l_partkey, l_suppkey, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40) GROUP BY 1)
SELECT p_partkey, coalesce(ids, '') AS ids, first_id FROM part LEFT JOIN a ON l_partkey = p_partkey""")
def a19_ordered_arrays(spark: SparkSession, d: str) -> DataFrame:
    """An ordered array of each show, empty where there is nothing, and the first by another order."""
    li = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").select("l_partkey", "l_suppkey", "l_extendedprice").distinct()
    a = li.groupBy("l_partkey").agg(F.array_sort(F.collect_list("l_suppkey")).alias("ids"), F.min_by("l_suppkey", F.col("l_extendedprice") * 100000 + F.col("l_suppkey")).alias("first_id"))
    ids = F.coalesce("ids", F.array().cast("array<bigint>"))
    return table(spark, d, "part").join(a, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"), "first_id")


@query(f"WITH {_WATCHED}, s AS (SELECT DISTINCT usr FROM w) SELECT usr, p_partkey AS part FROM s JOIN part ON p_size = 3 WHERE (usr, p_partkey) NOT IN (SELECT (usr, part) FROM w) AND usr IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)")
def j11_unwatched(spark: SparkSession, d: str) -> DataFrame:
    """What the users of a nation have not watched of a short list, by an anti-join; the list goes to every user as an array."""
    users = table(spark, d, "customer").filter("c_nationkey = 4").select(F.col("c_custkey").alias("usr"))
    watched = _watched(spark, d).select("usr", "part")
    wanted = [r.p_partkey for r in table(spark, d, "part").filter("p_size = 3").select("p_partkey").collect()]
    each = watched.select("usr").distinct().join(users, "usr", "left_semi").select("usr", F.explode(F.array(*[F.lit(k).cast("long") for k in wanted])).alias("part"))
    return each.join(watched, ["usr", "part"], "left_anti")


_DAY = "DATE '2000-01-01'"
_EPISODES = "ep AS (SELECT l_partkey AS part, l_linenumber % 4 AS season, CAST(l_quantity AS INTEGER) % 6 - 1 AS number, CAST(l_shipdate AS DATE) AS air, l_orderkey FROM lineitem)"


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_linenumber") % 4).alias("season"), (F.col("l_quantity").cast("int") % 6 - 1).alias("number"), F.to_date("l_shipdate").alias("air"), "l_orderkey")


@query(f"WITH {_EPISODES} SELECT part, season, number, air, l_orderkey FROM ep WHERE air > {_DAY} AND season <> 0 AND number >= 0 QUALIFY row_number() OVER (PARTITION BY part ORDER BY air, season, number, l_orderkey) = 1")
def r4_upcoming_episodes(spark: SparkSession, d: str) -> DataFrame:
    future = _episodes(spark, d).filter((F.col("air") > F.expr(_DAY)) & ~special(F.col("season"), F.col("number")))
    return top_k(future, ["part"], [F.asc("air"), F.asc("season"), F.asc("number"), F.asc("l_orderkey")])


@query(f"WITH {_EPISODES}, n AS (SELECT part, count(*) FILTER (air <= DATE '1996-01-01' AND season <> 0 AND number >= 0) AS aired, min(air) AS first_air FROM ep GROUP BY part) SELECT part, first_air FROM n WHERE aired = 0")
def r4_upcoming_shows(spark: SparkSession, d: str) -> DataFrame:
    """Shows of which no regular episode has aired."""
    regular = ~special(F.col("season"), F.col("number"))
    n = _episodes(spark, d).groupBy("part").agg(F.count_if((F.col("air") <= F.expr("DATE '1996-01-01'")) & regular).alias("aired"), F.min("air").alias("first_air"))
    return n.filter("aired = 0").select("part", "first_air")


_MINE = f"""l AS (SELECT o_custkey AS cust, l_partkey AS part, l_linenumber % 4 AS season, CAST(l_quantity AS INTEGER) % 6 - 1 AS number, CAST(l_shipdate AS DATE) AS air, CASE WHEN l_quantity > 25 THEN CAST(o_orderdate AS DATE) END AS seen, CAST(l_discount * 100 AS INTEGER) AS stars, CAST(o_orderdate AS DATE) AS added, l_orderkey, l_suppkey, l_extendedprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
m AS (SELECT cust, part, count(*) FILTER (season <> 0 AND number >= 0) AS total, count(*) FILTER (season <> 0 AND number >= 0 AND air <= {_DAY}) AS aired, count(*) FILTER (season <> 0 AND number >= 0 AND air <= {_DAY} AND seen IS NOT NULL) AS watched, min(seen) AS first_seen, max(seen) AS last_seen, max(air) FILTER (air <= {_DAY}) AS last_aired,
  min(added) AS added, CAST(round_even(avg(stars), 1) AS DOUBLE) AS stars, min(air) FILTER (air > {_DAY}) AS next_air FROM l GROUP BY 1, 2),
n AS (SELECT cust, part, season AS next_season, number AS next_number FROM l WHERE air <= {_DAY} AND seen IS NULL AND season <> 0 AND number >= 0 QUALIFY row_number() OVER (PARTITION BY cust, part ORDER BY season, number, l_orderkey, l_suppkey, air, l_extendedprice) = 1)"""


@query(f"""WITH {_MINE} SELECT m.cust, m.part, total, aired, watched, first_seen, last_seen, last_aired, added, stars, next_air, next_season, next_number, CASE WHEN watched <= 0 OR aired <= 0 THEN 0 WHEN watched >= aired THEN 100 ELSE greatest(1, CAST(floor(watched * 100 / aired) AS INTEGER)) END AS pct
FROM m LEFT JOIN n ON n.cust = m.cust AND n.part = m.part""")
def r2_my_shows_page(spark: SparkSession, d: str) -> DataFrame:
    """All that a list of one's shows tells of each: one aggregate; the next episode is its smallest struct, not a window of its own."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("added"))
    li = table(spark, d, "lineitem").join(o, "l_orderkey")
    rows = li.select(
        "cust", F.col("l_partkey").alias("part"), (F.col("l_linenumber") % 4).alias("season"), (F.col("l_quantity").cast("int") % 6 - 1).alias("number"), F.to_date("l_shipdate").alias("air"),
        F.when(F.col("l_quantity") > 25, F.col("added")).alias("seen"), F.rint(F.col("l_discount") * 100).alias("stars"), "added", "l_orderkey", "l_suppkey", "l_extendedprice",
    )
    regular, aired = ~special(F.col("season"), F.col("number")), F.col("air") <= F.expr(_DAY)
    order = F.struct("season", "number", "l_orderkey", "l_suppkey", "air", "l_extendedprice")
    m = rows.groupBy("cust", "part").agg(
        F.count_if(regular).alias("total"), F.count_if(regular & aired).alias("aired"), F.count_if(regular & aired & F.col("seen").isNotNull()).alias("watched"),
        F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.max(F.when(aired, F.col("air"))).alias("last_aired"), F.min("added").alias("added"), F.bround(F.avg("stars"), 1).alias("stars"),
        F.min(F.when(~aired, F.col("air"))).alias("next_air"), F.min(F.when(regular & aired & F.col("seen").isNull(), order)).alias("next"),
    )
    return m.select(*[c for c in m.columns if c != "next"], F.col("next.season").alias("next_season"), F.col("next.number").alias("next_number"), completion_pct(F.col("watched"), F.col("aired")).alias("pct"))


@query("""WITH s AS (SELECT o_custkey AS id, string_agg('{"show":' || o_orderkey || ',"added":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}', ',' ORDER BY o_orderdate, o_orderkey) AS shows FROM orders GROUP BY 1),
h AS (SELECT user_id AS id, string_agg('{"episode":' || event_id || ',"at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"}', ',' ORDER BY ts, event_id) AS history FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT c_custkey AS id, '{"account":{"name":"' || c_name || '","segment":"' || c_mktsegment || '"},"my_shows":[' || coalesce(shows, '') || '],"history":[' || coalesce(history, '') || ']}' AS doc FROM customer LEFT JOIN s ON s.id = c_custkey LEFT JOIN h ON h.id = c_custkey""")
def k1_account_export(spark: SparkSession, d: str) -> DataFrame:
    """Account, shows by when they were added and history by when it was watched: a document for each user, bounded by Spark's 2 GB for a value."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.struct("o_orderdate", "o_orderkey").alias("o"))
    shows = o.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("o")), lambda x: F.struct(x["o_orderkey"].alias("show"), F.date_format(x["o_orderdate"], "yyyy-MM-dd").alias("added"))).alias("my_shows"))
    e = table(spark, d, "events").filter("event_type = 'view'").select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("e"))
    history = e.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda x: F.struct(x["event_id"].alias("episode"), F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm:ss").alias("at"))).alias("history"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("account"))
    rows = c.join(shows, "id", "left").join(history, "id", "left")
    lists = [F.coalesce("my_shows", F.array().cast("array<struct<show:bigint,added:string>>")).alias("my_shows"), F.coalesce("history", F.array().cast("array<struct<episode:bigint,at:string>>")).alias("history")]
    return rows.select("id", canonical_json(F.struct("account", *lists)).alias("doc"))


_KEY = "nullif(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10, 0)"


@query(f"""WITH m AS (SELECT user_id, {_KEY} AS k, count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY 1, 2)
SELECT user_id, '{{"user":' || user_id || ',"shows":[' || string_agg('{{"show":' || coalesce(CAST(k AS VARCHAR), 'null') || ',"views":' || v || ',"clicks":' || c || '}}', ',' ORDER BY k NULLS LAST) || ']}}' AS doc FROM m GROUP BY user_id""")
def k2_snapshot_documents(spark: SparkSession, d: str) -> DataFrame:
    """A line of the snapshot artifact for each user: shows in order, the null one last, metrics filled with zeros."""
    k = F.nullif(F.get_json_object("props", "$.k").cast("int") % 10, F.lit(0))
    m = table(spark, d, "events").groupBy("user_id", k.alias("k")).agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    entry = F.struct(F.col("k").isNull().alias("last"), F.struct(F.col("k").alias("show"), "views", "clicks").alias("m"))
    docs = m.groupBy(F.col("user_id").alias("user")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["m"]).alias("shows"))
    return docs.select(F.col("user").alias("user_id"), canonical_json(F.struct("user", "shows")).alias("doc"))


_HALF = "TIMESTAMP '2024-01-15'"


@query(f"""WITH b AS (SELECT user_id, {_KEY} AS k, count(*) AS n FROM events WHERE ts < {_HALF} AND event_type <> 'signup' GROUP BY 1, 2), a AS (SELECT user_id, {_KEY} AS k, count(*) AS n FROM events WHERE ts >= {_HALF} GROUP BY 1, 2),
x AS (SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.k, a.k) AS k, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN a ON b.user_id = a.user_id AND b.k IS NOT DISTINCT FROM a.k),
lost AS (SELECT user_id FROM b EXCEPT SELECT user_id FROM a), come AS (SELECT user_id FROM a EXCEPT SELECT user_id FROM b)
SELECT 'metric' AS kind, user_id, k, delta, CAST(row_number() OVER (ORDER BY delta, user_id, k NULLS LAST) AS INTEGER) AS place FROM x WHERE delta <> 0 QUALIFY place <= 60 UNION ALL SELECT 'gone', user_id, NULL, NULL, NULL FROM lost UNION ALL SELECT 'new', user_id, NULL, NULL, NULL FROM come""")
def r23_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """The sixty worst differences, most lost first and the null show last, and the accounts on one side only."""
    k = F.nullif(F.get_json_object("props", "$.k").cast("int") % 10, F.lit(0))
    e = table(spark, d, "events").select("user_id", k.alias("k"), "ts", "event_type", F.lit(1).cast("long").alias("n"))
    half = "TIMESTAMP_NTZ '2024-01-15'"
    before, after = e.filter(f"ts < {half} AND event_type <> 'signup'"), e.filter(f"ts >= {half}")
    order = [F.asc("delta"), F.asc("user_id"), F.asc_nulls_last("k")]
    worst = snapshot_diff(before, after, ["user_id", "k"], "n").orderBy(*order).limit(60)
    worst = worst.select(F.lit("metric").alias("kind"), "user_id", "k", "delta", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).alias("place"))  # of sixty rows
    sides = before.select("user_id", F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(after.select("user_id", F.lit(0).alias("b"), F.lit(1).alias("a"))).groupBy("user_id").agg(F.max("b").alias("b"), F.max("a").alias("a"))
    accounts = sides.filter("a <> b").select(F.when(F.col("b") == 1, "gone").otherwise("new").alias("kind"), "user_id")
    return worst.unionByName(accounts, allowMissingColumns=True)


@query(f"""WITH x AS (SELECT o_custkey AS cust, l_partkey AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_discount >= 0.08 UNION SELECT o_custkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P')
SELECT cust, sha256(string_agg({fold_sql("p_name")} || ':' || part, ',' ORDER BY {fold_sql("p_name")}, part)) AS hash, count(*) AS n FROM x JOIN part ON p_partkey = part GROUP BY cust""")
def r10_exclude_group(spark: SparkSession, d: str) -> DataFrame:
    """What must not be recommended, in the payload's total order."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust"), "o_orderstatus")
    x = table(spark, d, "lineitem").join(o, "l_orderkey").filter("l_discount >= 0.08 OR o_orderstatus = 'P'").select("cust", F.col("l_partkey").alias("part")).distinct()
    named = x.join(table(spark, d, "part").select(F.col("p_partkey").alias("part"), fold(F.col("p_name")).alias("f")), "part")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "part"))), lambda r: F.concat_ws(":", r["f"], r["part"].cast("string"))), ",")
    return named.groupBy("cust").agg(F.sha2(body, 256).alias("hash"), F.count("*").alias("n"))


@query(f"WITH {_BLOCKS}, s AS (SELECT a AS me, b AS other FROM blocks UNION SELECT b, a FROM blocks) SELECT me, count(*) AS hidden FROM s WHERE me <> other GROUP BY me")
def p7_blocked_either_way(spark: SparkSession, d: str) -> DataFrame:
    both = symmetrise(_blocks(spark, d), "a", "b").filter("me <> other").select("me", "other").distinct()
    return both.groupBy("me").agg(F.count("*").alias("hidden"))
