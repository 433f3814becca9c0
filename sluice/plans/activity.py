"""The activity feed, ledgers, edges and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_cursor, encode_cursor
from ..operators.dedup import top_k
from ..operators.merge import latest_event
from ..operators.sessions import activity_rollup, keyset_page
from ..operators.sets import symmetrise
from ..tables import table
from .registry import query

_ROLLUP = """
WITH g AS (
  SELECT *, CASE WHEN event_type = 'view' AND coalesce(lag(ts) OVER w > ts - INTERVAL 360 MINUTES, false) THEN 0 ELSE 1 END AS opens
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), v AS (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM g WHERE event_type = 'view'
), r AS (
  SELECT user_id, grp, count(*) AS n, max(ts) AS occurred_at, first(event_id ORDER BY ts, event_id) AS sort_id FROM v GROUP BY user_id, grp
), feed AS (
  SELECT CASE WHEN n > 1 THEN 'run' ELSE 'single' END AS kind, CASE WHEN n > 1 THEN 'r:' ELSE '' END || CAST(sort_id AS VARCHAR) AS item_id, user_id, 'view' AS event_type, n, occurred_at, sort_id, CAST(NULL AS DOUBLE) AS stars FROM r
  UNION ALL
  SELECT 'other', CAST(event_id AS VARCHAR), user_id, event_type, CAST(1 AS BIGINT), ts, event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events WHERE event_type <> 'view'
)
"""


@query(_ROLLUP + "SELECT * FROM feed")
def w1_activity_rollup(spark: SparkSession, d: str) -> DataFrame:
    return activity_rollup(table(spark, d, "events"))


_CURSOR = ("2024-01-20 12:00:00", 5000)


@query(_ROLLUP + f"SELECT * FROM feed WHERE occurred_at < TIMESTAMP '{_CURSOR[0]}' OR (occurred_at = TIMESTAMP '{_CURSOR[0]}' AND sort_id < {_CURSOR[1]}) ORDER BY occurred_at DESC, sort_id DESC LIMIT 50")
def o3_activity_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    return keyset_page(activity_rollup(table(spark, d, "events")), "occurred_at", "sort_id", 50, _CURSOR)


@query("SELECT event_type, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS avg_k, count(*) AS n FROM events GROUP BY event_type")
def f12_event_json_k(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(k), 6).alias("avg_k"), F.count("*").alias("n"))


@query("""
SELECT e.event_id, e.k, g.n FROM (SELECT event_id, nullif(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events) e
JOIN (SELECT nullif(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) g ON e.k IS NOT DISTINCT FROM g.k
""")
def j10_nullsafe_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.nullif(F.get_json_object("props", "$.k").cast("int"), F.lit(0)))
    g = e.filter("event_type = 'view'").groupBy(F.col("k").alias("gk")).agg(F.count("*").alias("n"))
    return e.join(g, e.k.eqNullSafe(g.gk)).select("event_id", "k", "n")


@query("""
WITH c AS (
  SELECT user_id, count(*) FILTER (event_type = 'purchase') AS accepted,
    count(*) FILTER (event_type = 'error' OR (event_type = 'signup' AND ts < TIMESTAMP '2024-01-15')) AS adverse
  FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY user_id)
SELECT user_id, accepted, adverse, CASE WHEN accepted + adverse >= 10 AND adverse * 100 >= (accepted + adverse) * 60 THEN 'floor' ELSE 'default' END AS ceiling FROM c
""")
def a9_reputation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("ts >= TIMESTAMP_NTZ '2024-01-05'")
    adverse = (F.col("event_type") == "error") | ((F.col("event_type") == "signup") & F.expr("ts < TIMESTAMP_NTZ '2024-01-15'"))
    c = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("accepted"), F.count_if(adverse).alias("adverse"))
    sample = F.col("accepted") + F.col("adverse")
    return c.withColumn("ceiling", F.when((sample >= 10) & (F.col("adverse") * 100 >= sample * 60), "floor").otherwise("default"))


@query("""
SELECT user_id, event_type, k, event_id, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type, k ORDER BY ts DESC, event_id DESC) AS rn
  FROM (SELECT *, nullif(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events)) WHERE rn = 1
""")
def m22_event_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.nullif(F.get_json_object("props", "$.k").cast("int"), F.lit(0)))
    return latest_event(e, ["user_id", "event_type", "k"], "ts", "event_id").select("user_id", "event_type", "k", "event_id", "ts")


@query("""
WITH c AS (SELECT least(user_id, CAST(json_extract_string(props, '$.k') AS BIGINT)) AS a, greatest(user_id, CAST(json_extract_string(props, '$.k') AS BIGINT)) AS b, user_id AS actor, event_type, ts, event_id FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY a, b) AS n FROM c WHERE a <> b)
SELECT a, b, actor, n, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'blocked' WHEN 'click' THEN 'declined' ELSE 'cancelled' END AS state FROM l WHERE rn = 1
""")
def m31_edge_state(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    c = table(spark, d, "events").select(F.least("user_id", k).alias("a"), F.greatest("user_id", k).alias("b"), F.col("user_id").alias("actor"), "event_type", "ts", "event_id").filter("a <> b")
    state = F.create_map(*[F.lit(x) for x in ("signup", "pending", "purchase", "accepted", "error", "blocked", "click", "declined", "view", "cancelled")])
    # one aggregate instead of a window and a count: last by (ts, id) and the number together
    last = F.max_by(F.struct("actor", "event_type"), F.struct("ts", "event_id"))
    return c.groupBy("a", "b").agg(last.alias("l"), F.count("*").alias("n")).select("a", "b", "l.actor", "n", state[F.col("l.event_type")].alias("state"))


@query("""
WITH e AS (SELECT x.c_custkey AS a, y.c_custkey AS b, x.c_mktsegment = y.c_mktsegment AS blocked FROM customer x JOIN customer y ON x.c_nationkey = y.c_nationkey AND x.c_custkey + 25 = y.c_custkey),
s AS (SELECT a AS me, b AS other, blocked FROM e UNION ALL SELECT b, a, blocked FROM e)
SELECT me, other FROM s WHERE NOT blocked
""")
def j17_undirected_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    x, y = c.alias("x"), c.alias("y")
    same = (F.col("x.c_nationkey") == F.col("y.c_nationkey")) & (F.col("x.c_custkey") + 25 == F.col("y.c_custkey"))
    e = x.join(y, same).select(F.col("x.c_custkey").alias("a"), F.col("y.c_custkey").alias("b"), (F.col("x.c_mktsegment") == F.col("y.c_mktsegment")).alias("blocked"))
    return symmetrise(e, "a", "b").filter("NOT blocked").select("me", "other")


@query("""
SELECT c_custkey, c_name, c_name = 'Customer#000000012' AS exact FROM customer
WHERE c_name ILIKE '%#00000001%' ESCAPE '\\' AND c_mktsegment <> 'BUILDING' ORDER BY exact DESC, c_name, c_custkey LIMIT 20
""")
def p6_user_search(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    hits = c.filter(F.contains(F.lower("c_name"), F.lit("#00000001")))
    hits = hits.join(c.filter("c_mktsegment = 'BUILDING'").select("c_custkey"), "c_custkey", "left_anti")
    return hits.select("c_custkey", "c_name", (F.col("c_name") == "Customer#000000012").alias("exact")).orderBy(F.desc("exact"), "c_name", "c_custkey").limit(20)


@query("""
SELECT o_custkey AS c_custkey, '{"orders":[' || string_agg('{"id":' || o_orderkey || ',"date":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}', ',' ORDER BY o_orderdate, o_orderkey) || ']}' AS doc
FROM orders GROUP BY o_custkey
""")
def k1_user_export(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("o"))
    ordered = F.transform(F.array_sort(F.collect_list("o")), lambda x: F.struct(x["o_orderkey"].alias("id"), F.date_format(x["o_orderdate"], "yyyy-MM-dd").alias("date")))
    return o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_json(F.struct(ordered.alias("orders"))).alias("doc"))


@query("""
SELECT event_id, replace(replace(rtrim(base64(CAST(event_type || '|' || CAST(event_id AS VARCHAR) AS BLOB)), '='), '+', '-'), '/', '_') AS cursor, event_type AS part_1, CAST(event_id AS VARCHAR) AS part_2 FROM events
""")
def f13_cursor_codec(spark: SparkSession, d: str) -> DataFrame:
    coded = table(spark, d, "events").select("event_id", encode_cursor(F.col("event_type"), F.col("event_id").cast("string")).alias("cursor"))
    parts = decode_cursor(F.col("cursor"))
    return coded.select("event_id", "cursor", parts[0].alias("part_1"), parts[1].alias("part_2"))


@query("""
WITH c AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS cursor_at, min(ts) AS first_at, max(event_id) FILTER (event_type = 'error') AS last_error FROM events GROUP BY user_id)
SELECT user_id, coalesce(cursor_at, first_at) AS resume_at, last_error FROM c
""")
def a22_resume_cursor(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda t: F.col("event_type") == t
    c = table(spark, d, "events").groupBy("user_id").agg(F.max(F.when(is_("purchase"), F.col("ts"))).alias("cursor_at"), F.min("ts").alias("first_at"), F.max(F.when(is_("error"), F.col("event_id"))).alias("last_error"))
    return c.select("user_id", F.coalesce("cursor_at", "first_at").alias("resume_at"), "last_error")


@query("""
SELECT conv_id, turn, role, n_chars FROM (SELECT conv_id, turn, role, length(text) AS n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS rn FROM conversations WHERE role = 'user') WHERE rn = 1
""")
def w10_distinct_on(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))
    return top_k(c, ["conv_id"], [F.desc("turn"), F.asc("role")])


@query("""
WITH e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup')
SELECT user_id, count(*) AS n_all, count(*) FILTER (ts > TIMESTAMP '2024-01-20') AS n_after, count(*) FILTER (ts >= TIMESTAMP '2024-01-10') AS n_since, bool_or(ts >= TIMESTAMP '2024-01-25') AS cooling FROM e GROUP BY user_id
""")
def a10_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type = 'signup'")
    after = lambda op, day: F.expr(f"ts {op} TIMESTAMP_NTZ '{day}'")
    return e.groupBy("user_id").agg(F.count("*").alias("n_all"), F.count_if(after(">", "2024-01-20")).alias("n_after"), F.count_if(after(">=", "2024-01-10")).alias("n_since"), F.bool_or(after(">=", "2024-01-25")).alias("cooling"))
