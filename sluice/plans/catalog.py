"""Feeds, people, recommendations, interning, decisions and passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import completion_pct
from ..operators import people
from ..operators.dedup import unique_only
from ..operators.merge import present
from ..operators.sessions import activity_rollup, keyset_page
from ..operators.sets import union_keys
from ..tables import table
from .activity import _ROLLUP
from .library import _DAY, _LINES, _PROGRESS, _lines, a1_progress_fused
from .registry import query

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_FRIENDS = f"SELECT CASE WHEN user_id = 3 THEN {_K} ELSE user_id END AS other FROM events WHERE event_type = 'purchase' AND (user_id = 3 OR {_K} = 3) AND user_id <> {_K}"


@query(_ROLLUP.replace("FROM events", f"FROM (SELECT * FROM events WHERE user_id IN ({_FRIENDS}) AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))") + "SELECT * FROM feed ORDER BY occurred_at DESC, sort_id DESC LIMIT 50")
def r1_activity_feed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    edges = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("a"), k.alias("b"), F.lit("accepted").alias("state")).filter("a <> b")
    # a user without a customer row counts as enabled, so the gate is an anti-join beside the friends
    users = edges.select(F.col("a").alias("u")).union(edges.select("b"))
    friends = people.friends_of(edges.filter("a = 3 OR b = 3"), "a", "b", "state", "accepted", users, "u", F.lit(True)).filter("me = 3").select(F.col("other").alias("user_id"))
    hidden = table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    seen = e.join(friends, "user_id", "left_semi").join(hidden, "user_id", "left_anti")
    return keyset_page(activity_rollup(seen), "occurred_at", "sort_id", 50)


@query(f"""WITH {_LINES}, p AS ({_PROGRESS}), s AS (SELECT cust, part, round(avg(CAST(l_discount * 500 AS INTEGER)) / 100, 4) AS stars FROM lines GROUP BY cust, part)
SELECT p.cust, p.part, p_name, total, aired, watched, CASE WHEN watched <= 0 OR aired <= 0 THEN 0 WHEN watched >= aired THEN 100 ELSE greatest(1, CAST(floor(watched * 100 / aired) AS INTEGER)) END AS pct, stars,
 row_number() OVER (PARTITION BY p.cust ORDER BY stars IS NULL, stars DESC, lower(p_name), p.part) AS place FROM p JOIN s USING (cust, part) JOIN part ON p_partkey = p.part""")
def r2_my_shows(spark: SparkSession, d: str) -> DataFrame:
    stars = _lines(spark, d).groupBy("cust", "part").agg(F.round(F.avg(F.rint(F.col("l_discount") * 500)) / 100, 4).alias("stars"))
    rows = a1_progress_fused(spark, d).join(stars, ["cust", "part"]).join(table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_name"), "part")
    place = F.row_number().over(Window.partitionBy("cust").orderBy(F.desc_nulls_last("stars"), F.lower("p_name"), "part"))
    return rows.select("cust", "part", "p_name", "total", "aired", "watched", completion_pct(F.col("watched"), F.col("aired")).alias("pct"), "stars", place.alias("place"))


@query("""SELECT c_custkey AS person, o_orderkey AS show, CAST(NULL AS INTEGER) AS episode, 'cast' AS kind FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
UNION ALL SELECT c_custkey, o_orderkey, NULL, 'crew' FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O'
UNION ALL SELECT c_custkey, o_orderkey, l_linenumber, 'guest' FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""")
def p17_filmography(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("person")), F.col("o_custkey") == F.col("person")).select("person", F.col("o_orderkey").alias("show"), "o_orderstatus")
    guest = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("show"), F.col("l_linenumber").alias("episode"))
    kinds = {"cast": o.filter("o_orderstatus = 'F'"), "crew": o.filter("o_orderstatus = 'O'"), "guest": o.join(guest, "show")}
    return people.filmography({k: x.drop("o_orderstatus") for k, x in kinds.items()}).select("person", "show", "episode", "kind")


@query("""SELECT o_orderkey, a.c_name AS reporter, b.c_name AS reported FROM orders JOIN customer a ON a.c_custkey = o_custkey JOIN customer b ON b.c_custkey = (o_custkey * 7 + o_orderkey) % 150 ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25""")
def j18_two_aliases(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    a, b = c.select(F.col("c_custkey").alias("ka"), F.col("c_name").alias("reporter")), c.select(F.col("c_custkey").alias("kb"), F.col("c_name").alias("reported"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % 150).alias("kb"))
    rows = o.join(a, F.col("o_custkey") == F.col("ka")).join(b, "kb")
    return rows.orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").offset(25).limit(25).select("o_orderkey", "reporter", "reported")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE (l_partkey, l_linenumber) IN (SELECT p_partkey, CAST(1 + p_size % 7 AS INTEGER) FROM part WHERE p_size < 20)""")
def j20_row_valued_in(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "part").filter("p_size < 20").select(F.col("p_partkey").alias("l_partkey"), (1 + F.col("p_size") % 7).cast("int").alias("l_linenumber"))
    return table(spark, d, "lineitem").join(keys, ["l_partkey", "l_linenumber"], "left_semi").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'special' WHEN c_custkey IS NULL THEN 'no_show' WHEN l_orderkey IS NULL THEN 'no_episode' ELSE 'matched' END AS outcome
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 3) ON l_orderkey = o_orderkey AND o_custkey % 5 <> 0""")
def j22_classified_match(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey")
    li = table(spark, d, "lineitem").filter("l_linenumber = 3").select("l_orderkey").distinct()
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    j = o.join(c, F.col("c_custkey") == F.col("o_custkey"), "left").join(li, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("o_custkey") % 5 != 0), "left")
    outcome = F.when(F.col("o_custkey") % 5 == 0, "special").when(F.col("c_custkey").isNull(), "no_show").when(F.col("l_orderkey").isNull(), "no_episode").otherwise("matched")
    return j.select("o_orderkey", outcome.alias("outcome"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS local FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2 HAVING count(*) = 1), b AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS upstream FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2 HAVING count(*) = 1)
SELECT l_orderkey, l_linenumber, local, upstream FROM a JOIN b USING (l_orderkey, l_linenumber)""")
def j25_uncontested_keys(spark: SparkSession, d: str) -> DataFrame:
    li, keys = table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    side = lambda flag, name: unique_only(li.filter(F.col("l_returnflag") == flag).select(*keys, F.col("l_suppkey").alias(name)), keys)
    return side("A", "local").join(side("N", "upstream"), keys)


@query("""WITH m AS (SELECT l_partkey, count(*) AS mappable, count(*) FILTER (l_returnflag = 'A' AND l_quantity > 45) AS mapped FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, mappable, users FROM m LEFT JOIN (SELECT l_partkey AS k, count(DISTINCT o_custkey) AS users FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) ON k = l_partkey WHERE mappable > 0 AND mapped = 0""")
def a16_systematic_miss(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_quantity")
    m = li.groupBy("l_partkey").agg(F.count("*").alias("mappable"), F.count_if((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45)).alias("mapped")).filter("mappable > 0 AND mapped = 0").drop("mapped")
    users = li.join(m.select("l_partkey"), "l_partkey", "left_semi").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey").agg(F.countDistinct("o_custkey").alias("users"))
    return m.join(users, "l_partkey", "left")


@query("""WITH t AS (SELECT o_custkey, count(*) AS total FROM orders GROUP BY o_custkey), c AS (SELECT o_custkey, o_orderpriority, count(*) AS covered FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, covered, total FROM c JOIN t USING (o_custkey)""")
def a27_mark_coverage(spark: SparkSession, d: str) -> DataFrame:
    # totals from the same aggregate by a window over its few rows, not by a second scan
    c = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count_if(F.col("o_orderstatus") != "P").alias("covered"), F.count("*").alias("n"))
    return c.withColumn("total", F.sum("n").over(Window.partitionBy("o_custkey"))).filter("covered > 0").drop("n")


_SETS = "SELECT o_custkey AS cust, o_orderkey AS set_id, o_orderdate AS generated FROM orders WHERE o_orderstatus = 'F'"


@query(f"SELECT cust, set_id FROM ({_SETS}) QUALIFY row_number() OVER (PARTITION BY cust ORDER BY generated DESC, set_id DESC) = 1")
def o13_current_set(spark: SparkSession, d: str) -> DataFrame:
    return people.current_set(table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus") == "F", "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("set_id"))


@query(f"""WITH s AS (SELECT cust, set_id FROM ({_SETS}) QUALIFY row_number() OVER (PARTITION BY cust ORDER BY generated DESC, set_id DESC) = 1),
r AS (SELECT l_orderkey AS set_id, l_partkey AS part, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice) AS INTEGER) AS rank FROM lineitem),
x AS (SELECT DISTINCT o_custkey AS cust, l_partkey AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_discount >= 0.09),
m AS (SELECT cust, part, rank FROM r JOIN s USING (set_id) JOIN part ON p_partkey = part WHERE p_size <= 45 AND NOT EXISTS (SELECT 1 FROM x WHERE x.cust = s.cust AND x.part = r.part))
SELECT cust, part, rank FROM m QUALIFY row_number() OVER (PARTITION BY cust ORDER BY rank) <= 3""")
def p8_current_recommendations(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"))
    rows = li.select(F.col("l_orderkey").alias("set_id"), F.col("l_partkey").alias("part"), rank.alias("rank"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust"))
    excluded = li.filter("l_discount >= 0.09").join(o, "l_orderkey").select("cust", F.col("l_partkey").alias("part"))
    live = table(spark, d, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("part"))
    return people.current_recommendations(o13_current_set(spark, d), rows, excluded, live, "cust", "set_id", "part", "rank", 3).select("cust", "part", "rank")


@query("""WITH t AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS) SELECT event_id, user_id FROM t WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def p9_fresh_snapshot(spark: SparkSession, d: str) -> DataFrame:
    fresh = table(spark, d, "events").filter("event_type = 'signup' AND ts >= TIMESTAMP_NTZ '2024-01-24'")
    hidden = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return fresh.join(hidden, "user_id", "left_anti").select("event_id", "user_id")


@query("""SELECT user_id AS id FROM events WHERE event_type = 'view' UNION SELECT o_custkey FROM orders WHERE o_totalprice > 490000 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9900""")
def u9_known_ids(spark: SparkSession, d: str) -> DataFrame:
    return union_keys([table(spark, d, "events").filter("event_type = 'view'").select(F.col("user_id").alias("id")), table(spark, d, "orders").filter("o_totalprice > 490000").select("o_custkey"), table(spark, d, "customer").filter("c_acctbal > 9900").select("c_custkey")])


@query("SELECT l_partkey, min(l_orderkey) AS first_seen FROM lineitem GROUP BY l_partkey")
def u8_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("first_seen"))


@query("""WITH v AS (SELECT DISTINCT p_brand AS department, p_type AS job FROM part), o AS (SELECT DISTINCT p_brand AS department, p_type AS job FROM part WHERE p_partkey % 2 = 0)
SELECT department, job, EXISTS (SELECT 1 FROM o WHERE o.department = v.department AND o.job = v.job) AS known FROM v""")
def m8_intern_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("department"), F.col("p_type").alias("job"), (F.col("p_partkey") % 2 == 0).alias("old"))
    return p.groupBy("department", "job").agg(F.bool_or("old").alias("known"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_custkey + 1 END ELSE o_custkey END AS pointer FROM orders""")
def m12_pointers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    new = F.when(k % 2 != 0, F.col("o_custkey") + 1)
    return table(spark, d, "orders").select("o_orderkey", present(k % 3 == 1, new, F.col("o_custkey")).alias("pointer"))


@query("""WITH f AS (SELECT user_id, event_type, min(ts) AS first_ts, max(ts) AS last_ts, first(event_id ORDER BY ts, event_id) AS first_id, first(value ORDER BY ts DESC, event_id DESC) AS last_value FROM events GROUP BY 1, 2) SELECT * FROM f""")
def m23_first_and_last_wins(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("event_id", at).alias("first_id"), F.max_by("value", at).alias("last_value"))


@query("""WITH m AS (SELECT o_custkey AS cust, l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber <> 7 AND l_shipdate <= TIMESTAMP '2000-01-01'),
u AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') SELECT cust, l_orderkey, l_linenumber, l_suppkey FROM m WHERE l_orderkey NOT IN (SELECT o_orderkey FROM u)""")
def m24_bulk_mark(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust"))
    li = table(spark, d, "lineitem").filter("l_linenumber <> 7 AND l_shipdate <= TIMESTAMP_NTZ '2000-01-01'").select("l_orderkey", "l_linenumber", "l_suppkey")
    return li.join(o, "l_orderkey").select("cust", "l_orderkey", "l_linenumber", "l_suppkey")


@query("""WITH d AS (SELECT c_custkey AS show_id, CAST(floor(c_acctbal) AS BIGINT) AS wanted, c_mktsegment = 'BUILDING' AS exact FROM customer), h AS (SELECT DISTINCT wanted FROM d WHERE exact)
SELECT show_id, CASE WHEN exact THEN 'exact' WHEN wanted IN (SELECT wanted FROM h) THEN 'held' ELSE 'human' END AS outcome FROM d""")
def m32_human_decisions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("show_id"), F.floor("c_acctbal").alias("wanted"), (F.col("c_mktsegment") == "BUILDING").alias("exact"))
    held = c.filter("exact").select("wanted", F.lit(True).alias("held")).distinct()
    outcome = F.when(F.col("exact"), "exact").when(F.col("held"), "held").otherwise("human")
    return c.join(held, "wanted", "left").select("show_id", outcome.alias("outcome"))


@query("""WITH q AS (SELECT user_id, count(*) AS named, count(*) FILTER (event_type = 'error') AS unresolved, count(*) FILTER (event_type = 'click') AS excluded FROM events GROUP BY user_id)
SELECT user_id, named < 4 OR (unresolved * 2 <= named AND excluded * 10 <= named * 9) AS believable FROM q""")
def r12_believability(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("named"), F.count_if(F.col("event_type") == "error").alias("unresolved"), F.count_if(F.col("event_type") == "click").alias("excluded"))
    return q.select("user_id", people.believable(F.col("unresolved"), F.col("excluded"), F.col("named")).alias("believable"))


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS title, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 50 + 1980 END AS year FROM events) SELECT event_id, title, year FROM s WHERE title IS NOT NULL AND year IS NOT NULL""")
def r13_suggestion_contract(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    title = F.when(k % 4 == 0, F.lit("7")).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    year = F.when(k % 5 == 0, F.lit("true")).otherwise((k % 50 + 1980).cast("string"))
    doc = F.try_parse_json(F.concat(F.lit('{"title":'), title, F.lit(',"release_year":'), year, F.lit("}")))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    ok = (kind("$.title") == "STRING") & kind("$.release_year").isin("BIGINT", "INT")
    return table(spark, d, "events").filter(ok).select("event_id", F.try_variant_get(doc, "$.title", "string").alias("title"), F.try_variant_get(doc, "$.release_year", "long").alias("year"))


@query("""WITH e AS (SELECT o_custkey AS me, (o_custkey + o_orderkey) % 150 AS other FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT me, other FROM e WHERE me <> other UNION SELECT other, me FROM e WHERE me <> other),
g AS (SELECT f.me, c_custkey, c_name FROM f JOIN customer ON c_custkey = f.other WHERE c_acctbal >= 0) SELECT me, count(*) AS n, string_agg(c_name, ',' ORDER BY lower(c_name), c_custkey) AS names FROM g GROUP BY me""")
def r7_friend_briefs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") + F.col("o_orderkey")) % 150).alias("b"), "o_orderstatus").filter("a <> b")
    c = table(spark, d, "customer")
    friends = people.friends_of(e, "a", "b", "o_orderstatus", "F", c, "c_custkey", F.col("c_acctbal") >= 0)
    named = friends.join(c.select(F.col("c_custkey").alias("other"), "c_name"), "other")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.lower("c_name").alias("l"), "other", "c_name"))), lambda x: x["c_name"])
    return named.groupBy("me").agg(F.count("*").alias("n"), F.array_join(ordered, ",").alias("names"))


@query("""WITH h AS (SELECT o_custkey AS cust, count(*) AS weight, max(o_orderkey) AS hash FROM orders GROUP BY 1), p AS (SELECT o_custkey AS cust, max(o_orderkey) AS hash FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1)
SELECT cust, CASE WHEN weight < 10 THEN 'below_floor' WHEN h.hash IS NOT DISTINCT FROM p.hash THEN 'unchanged' ELSE 'generate' END AS action FROM h LEFT JOIN p USING (cust)""")
def r27_weekly_pass(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(F.count("*").alias("weight"), F.max("o_orderkey").alias("now"), F.max(F.when(F.col("o_orderstatus") != "O", F.col("o_orderkey"))).alias("before"))
    return h.select("cust", F.when(F.col("weight") < 10, "below_floor").when(F.col("now").eqNullSafe(F.col("before")), "unchanged").otherwise("generate").alias("action"))


@query(f"""WITH {_LINES}, t AS (SELECT part, count(DISTINCT cust) AS users, count(*) AS touches FROM lines WHERE watched IS NOT NULL GROUP BY part)
SELECT p_partkey, users, touches FROM part JOIN t ON part = p_partkey WHERE p_size > 25 AND p_type <> 'PROMO' ORDER BY users DESC, touches DESC, p_partkey LIMIT 40""")
def r20_review_queue(spark: SparkSession, d: str) -> DataFrame:
    open_ = table(spark, d, "part").filter("p_size > 25 AND p_type <> 'PROMO'").select("p_partkey")
    t = _lines(spark, d).filter("watched IS NOT NULL").join(open_, F.col("part") == F.col("p_partkey")).groupBy("p_partkey").agg(F.countDistinct("cust").alias("users"), F.count("*").alias("touches"))
    return t.orderBy(F.desc("users"), F.desc("touches"), "p_partkey").limit(40)


@query("SELECT s_suppkey AS id, 'supplier' AS kind, s_name AS name FROM supplier WHERE contains(lower(s_name), '0000001') UNION ALL SELECT c_custkey, 'customer', c_name FROM customer WHERE contains(lower(c_name), '0000001')")
def p3_people_search(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").filter(F.contains(F.lower("s_name"), F.lit("0000001"))).select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"), F.col("s_name").alias("name"))
    c = table(spark, d, "customer").filter(F.contains(F.lower("c_name"), F.lit("0000001"))).select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"), F.col("c_name").alias("name"))
    return s.unionByName(c)


@query(f"""WITH {_LINES}, t AS (SELECT cust, part, count(*) FILTER (watched IS NOT NULL) AS w, max(watched) AS last, min(air) FILTER (air > {_DAY}) AS next FROM lines GROUP BY cust, part)
SELECT cust, part, CAST(row_number() OVER (PARTITION BY cust ORDER BY coalesce(last, DATE '1970-01-01') DESC, p_name DESC, part DESC) AS INTEGER) AS by_recent, CAST(row_number() OVER (PARTITION BY cust ORDER BY coalesce(next, DATE '9999-12-31'), p_name, part) AS INTEGER) AS by_next FROM t JOIN part ON p_partkey = part""")
def o9_library_sorts(spark: SparkSession, d: str) -> DataFrame:
    t = _lines(spark, d).groupBy("cust", "part").agg(F.max("watched").alias("last"), F.min(F.when(F.col("air") > F.expr(_DAY), F.col("air"))).alias("next"))
    t = t.join(table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_name"), "part")
    w = Window.partitionBy("cust")  # both sorts have one partitioning, so one shuffle
    recent = w.orderBy(F.coalesce("last", F.expr("DATE '1970-01-01'")).desc(), F.desc("p_name"), F.desc("part"))
    upcoming = w.orderBy(F.coalesce("next", F.expr("DATE '9999-12-31'")), "p_name", "part")
    return t.select("cust", "part", F.row_number().over(recent).alias("by_recent"), F.row_number().over(upcoming).alias("by_next"))
