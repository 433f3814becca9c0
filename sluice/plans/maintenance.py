"""Dashboards, snapshots, table maintenance and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import sweep_due
from ..functions.text import fold, fold_sql
from ..operators import merge
from ..operators.dedup import unique_only
from ..operators.match import tiered_match, trust_verdicts, vote_tally
from ..operators.sets import gone_and_back, snapshot_diff, union_keys
from ..tables import table
from .registry import query


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j12_orders_without_lines(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'error') OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) OR c_acctbal < 0""")
def j13_touched_any(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    touched = union_keys([
        table(spark, d, "events").filter("event_type = 'error'").select(F.col("user_id").alias("c_custkey")),
        table(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")),
        c.filter("c_acctbal < 0").select("c_custkey"),
    ])
    return c.select("c_custkey").join(touched, "c_custkey", "left_semi")


@query("""
WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS survivors, min(l_suppkey) FILTER (l_returnflag = 'A') AS survivor FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey AS copy, k.survivor, CASE WHEN survivors = 1 THEN 'twin' WHEN survivors = 0 THEN 'alone' ELSE 'ambiguous' END AS bucket
FROM lineitem l JOIN k ON l.l_orderkey = k.l_orderkey AND l.l_linenumber = k.l_linenumber WHERE l.l_returnflag = 'R' AND k.n > 1
""")
def j14_unique_twin(spark: SparkSession, d: str) -> DataFrame:
    # a window instead of an aggregate and a join back: one shuffle of the keys
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    key = Window.partitionBy("l_orderkey", "l_linenumber")
    live = F.when(F.col("l_returnflag") == "A", F.col("l_suppkey"))
    w = li.withColumn("n", F.count("*").over(key)).withColumn("survivors", F.count(live).over(key)).withColumn("survivor", F.min(live).over(key))
    bucket = F.when(F.col("survivors") == 1, "twin").when(F.col("survivors") == 0, "alone").otherwise("ambiguous")
    return w.filter("l_returnflag = 'R' AND n > 1").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("copy"), "survivor", bucket.alias("bucket"))


@query("""
WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'), q AS (SELECT o_orderkey, CAST(1 + o_custkey % 7 AS INTEGER) AS wanted FROM orders)
SELECT o_orderkey, wanted, max(l_linenumber) AS target FROM q JOIN x ON l_orderkey = o_orderkey AND l_linenumber <= wanted GROUP BY o_orderkey, wanted
""")
def j27_asof_collapse(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "orders").select("o_orderkey", (1 + F.col("o_custkey") % 7).cast("int").alias("wanted"))
    x = table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return q.join(x, "o_orderkey").filter("l_linenumber <= wanted").groupBy("o_orderkey", "wanted").agg(F.max("l_linenumber").alias("target"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, bool_or(l_linestatus = 'O') AS any_open FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 2 AND bool_or(l_linestatus = 'O')")
def a14_having_bool_or(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber")
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.bool_or(F.col("l_linestatus") == "O").alias("any_open")).filter("n > 2 AND any_open")


@query("""SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS finished, (SELECT count(*) FROM lineitem) AS lines, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS returned,
 (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS indebted, (SELECT count(*) FROM events) AS events, (SELECT count(DISTINCT user_id) FROM events) AS users""")
def a15_dashboard_counts(spark: SparkSession, d: str) -> DataFrame:
    # one pass for each table; the one-row results are put side by side by a pivot of tagged rows, not by joins
    one = lambda name, **c: table(spark, d, name).agg(*[x.alias(k) for k, x in c.items()])
    rows = [
        one("orders", orders=F.count("*"), finished=F.count_if(F.col("o_orderstatus") == "F")), one("lineitem", lines=F.count("*"), returned=F.count_if(F.col("l_returnflag") == "R")),
        one("customer", indebted=F.count_if(F.col("c_acctbal") < 0)), one("events", events=F.count("*"), users=F.countDistinct("user_id")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


@query("""WITH t AS (SELECT l_partkey, count(DISTINCT o_custkey) AS users FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey)
SELECT l_partkey, users FROM t WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10) ORDER BY users DESC, l_partkey LIMIT 50""")
def a18_touched_lacking(spark: SparkSession, d: str) -> DataFrame:
    lacking = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_anti")
    users = lacking.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey").agg(F.countDistinct("o_custkey").alias("users"))
    return users.orderBy(F.desc("users"), "l_partkey").limit(50)


@query("""SELECT user_id, nullif(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10, 0) AS k, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
 count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1, 2""")
def a20_metric_snapshot(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.nullif(F.get_json_object("props", "$.k").cast("int") % 10, F.lit(0)))
    return e.groupBy("user_id", "k").pivot("event_type", ["view", "click", "error", "signup", "purchase"]).count().na.fill(0, ["view", "click", "error", "signup", "purchase"])


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ROLLUP (user_id, event_type)) SELECT coalesce(CAST(user_id AS VARCHAR), 'all') AS who, coalesce(event_type, 'total') AS metric, n FROM s""")
def a21_rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").rollup("user_id", "event_type").agg(F.count("*").alias("n"))
    return s.select(F.coalesce(F.col("user_id").cast("string"), F.lit("all")).alias("who"), F.coalesce("event_type", F.lit("total")).alias("metric"), "n")


_HALF = "TIMESTAMP '2024-01-15'"


@query(f"""WITH b AS (SELECT user_id, nullif(CAST(json_extract_string(props, '$.k') AS INTEGER) % 4, 0) AS k, count(*) AS n FROM events WHERE ts < {_HALF} GROUP BY 1, 2), a AS (SELECT user_id, nullif(CAST(json_extract_string(props, '$.k') AS INTEGER) % 4, 0) AS k, count(*) AS n FROM events WHERE ts >= {_HALF} GROUP BY 1, 2)
SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.k, a.k) AS k, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN a ON b.user_id = a.user_id AND b.k IS NOT DISTINCT FROM a.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def u7_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.nullif(F.get_json_object("props", "$.k").cast("int") % 4, F.lit(0)).alias("k"), "ts", F.lit(1).cast("long").alias("n"))
    half = "TIMESTAMP_NTZ '2024-01-15'"
    return snapshot_diff(e.filter(f"ts < {half}"), e.filter(f"ts >= {half}"), ["user_id", "k"], "n")


@query("SELECT p_partkey, CASE WHEN p_size > 45 THEN 'resurrected' ELSE 'gone' END AS change FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey < 50) ON p_partkey = l_partkey WHERE (p_size > 45) = (l_partkey IS NOT NULL)")
def u6_tombstone_sets(spark: SparkSession, d: str) -> DataFrame:
    mirror = table(spark, d, "part").select("p_partkey", (F.col("p_size") > 45).alias("deleted"))
    feed = table(spark, d, "lineitem").filter("l_suppkey < 50").select(F.col("l_partkey").alias("p_partkey"))
    return gone_and_back(mirror, feed, "p_partkey", "deleted")


@query("""WITH c AS (SELECT l_orderkey AS title, l_suppkey, count(*) FILTER (l_quantity > 20) AS marks, count(*) AS total FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY marks DESC, l_suppkey) AS rn, count(*) OVER (PARTITION BY title, marks) AS ties FROM c)
SELECT title, l_suppkey, marks, total FROM r WHERE rn = 1 AND ties = 1 AND marks > 0""")
def w5_strict_winner(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("title"), "l_suppkey").agg(F.count_if(F.col("l_quantity") > 20).alias("marks"), F.count("*").alias("total"))
    w = Window.partitionBy("title")
    ranked = c.withColumn("rn", F.row_number().over(w.orderBy(F.desc("marks"), "l_suppkey"))).withColumn("next", F.lead("marks").over(w.orderBy(F.desc("marks"), "l_suppkey")))
    return ranked.filter("rn = 1 AND marks > 0 AND (next IS NULL OR next < marks)").select("title", "l_suppkey", "marks", "total")


@query("""WITH o AS (SELECT l_partkey, l_linenumber, l_orderkey, CAST(l_shipdate AS DATE) AS air FROM lineitem),
u AS (SELECT l_partkey, l_linenumber, l_orderkey, min(air) AS air FROM o GROUP BY ALL HAVING count(*) = 1),
v AS (SELECT l_partkey, l_linenumber, count(*) AS n, min(l_linenumber % 4 - 1) AS lo, min(CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN l_orderkey % 97 = 0 THEN 1 ELSE 0 END) AS b FROM u GROUP BY 1, 2),
s AS (SELECT DISTINCT l_partkey, l_linenumber FROM u),
j AS (SELECT s.l_partkey, s.l_linenumber, coalesce(n, 0) AS compared, lo + a AS lo, lo + b AS hi FROM s LEFT JOIN v USING (l_partkey, l_linenumber)),
r AS (SELECT *, CASE WHEN compared = 0 THEN 'no_overlap' WHEN compared < 2 THEN 'too_few' WHEN lo <> hi THEN 'inconsistent' WHEN abs(lo) > 1 THEN 'out_of_range' END AS reason FROM j)
SELECT l_partkey, l_linenumber, CASE WHEN reason IS NULL THEN lo END AS offset_days, compared, reason FROM r""")
def r14_trust_rule(spark: SparkSession, d: str) -> DataFrame:
    ours = table(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_orderkey", F.to_date("l_shipdate").alias("air"))
    shift = F.col("l_linenumber") % 4 - 1 + F.when(F.col("l_orderkey") % 97 == 0, 1).otherwise(0)
    theirs = ours.withColumn("air", F.date_add("air", shift))
    return trust_verdicts(ours, theirs, "l_partkey", "l_linenumber", "l_orderkey", "air")


_BATCH = "SELECT o_orderkey, o_custkey, o_orderstatus || '!' AS o_orderstatus, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos FROM orders WHERE o_orderkey % 3 = 0"


@query("""WITH b AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderkey % 2 = 1), o AS (SELECT o_custkey, min(o_orderpriority) AS pr FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey),
l AS (SELECT o_custkey, first(o_orderpriority ORDER BY o_orderkey DESC) AS pr FROM b GROUP BY o_custkey)
SELECT coalesce(l.o_custkey, o.o_custkey) AS o_custkey, coalesce(l.pr, o.pr) AS pr FROM o FULL JOIN l ON o.o_custkey = l.o_custkey""")
def m1_upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("pr"))
    old = o.filter("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.min("pr").alias("pr"))
    return merge.upsert_last_wins(old, o.filter("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query("""SELECT coalesce(x.c_custkey, y.c_custkey) AS c_custkey, coalesce(y.c_name, x.c_name) AS c_name, coalesce(y.seg, x.seg) AS seg FROM (SELECT c_custkey, c_name, c_mktsegment AS seg FROM customer WHERE c_custkey % 5 <> 0) x
FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name || '*' END AS c_name, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer WHERE c_custkey % 2 = 0) y ON x.c_custkey = y.c_custkey""")
def m2_upsert_coalesce(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("seg"))
    batch = c.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("*"))).alias("c_name"), F.nullif("seg", F.lit("BUILDING")).alias("seg"))
    return merge.upsert_coalesce(c.filter("c_custkey % 5 <> 0"), batch, "c_custkey", ["c_name", "seg"])


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND l_linenumber <= 3
UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey + 1000, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND l_linenumber <= 2""")
def m5_replace_children(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    parents = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    batch = li.filter("l_linenumber <= 2").join(parents, "l_orderkey", "left_semi").withColumn("l_suppkey", F.col("l_suppkey") + 1000)
    return merge.replace_children(li.filter("l_linenumber <= 3"), batch, parents, "l_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, nullif(l_suppkey % 5, 0) AS upstream FROM lineitem WHERE l_suppkey % 5 = 0 OR EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O')""")
def m7_prune_missing(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.nullif(F.col("l_suppkey") % 5, F.lit(0)).alias("upstream"))
    payload = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return merge.prune_missing(li, payload, ["l_orderkey"], "upstream")


@query("""SELECT p_partkey, coalesce(n, p_retailprice) AS p_retailprice, coalesce(n, p_retailprice) IS DISTINCT FROM p_retailprice AS changed FROM part LEFT JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice ELSE p_retailprice + 1 END AS n FROM part WHERE p_partkey % 2 = 0) ON k = p_partkey""")
def m15_update_from_feed(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    feed = p.filter("p_partkey % 2 = 0").withColumn("p_retailprice", F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice")).otherwise(F.col("p_retailprice") + 1))
    return merge.update_from_feed(p, feed, "p_partkey", "p_retailprice")


@query("""WITH r AS (SELECT l_partkey, l_linenumber, l_orderkey, CAST(l_shipdate AS DATE) AS air, CASE WHEN l_partkey % 4 = 0 AND l_linenumber = 2 THEN -1 WHEN l_partkey % 6 = 0 THEN 1 ELSE 0 END AS days FROM lineitem)
SELECT l_partkey, l_linenumber, l_orderkey, CAST(air + days AS DATE) AS corrected, CASE WHEN days <> 0 THEN air END AS raw FROM r""")
def m18_project_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_orderkey", F.to_date("l_shipdate").alias("air"))
    parts = table(spark, d, "part")
    specific = parts.filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("l_partkey"), F.lit(2).alias("l_linenumber"), F.lit(-1).alias("days"))
    default = parts.filter("p_partkey % 6 = 0").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("days"))
    return merge.project_dates(rows, specific, default, "l_partkey", "l_linenumber", "air").select("l_partkey", "l_linenumber", "l_orderkey", "corrected", "raw")


@query("""WITH f AS (SELECT DISTINCT o_custkey AS cust, l_partkey AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey), j AS (SELECT f.*, CASE WHEN part % 10 IN (1, 2) THEN part - part % 10 END AS new FROM f),
h AS (SELECT j.*, f.part IS NOT NULL AS held FROM j LEFT JOIN f ON f.cust = j.cust AND f.part = j.new), m AS (SELECT *, new IS NOT NULL AND NOT held AS wants FROM h),
r AS (SELECT *, wants AND row_number() OVER (PARTITION BY cust, new, wants ORDER BY part) = 1 AS moved FROM m)
SELECT cust, CASE WHEN moved THEN new ELSE part END AS part, moved FROM r""")
def m20_repoint(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    facts = facts.select(F.col("o_custkey").alias("cust"), F.col("l_partkey").alias("part")).distinct()
    mapping = table(spark, d, "part").filter("p_partkey % 10 IN (1, 2)").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") - F.col("p_partkey") % 10).alias("new"))
    return merge.repoint(facts, mapping, "cust", "part").select("cust", "part", "moved")


@query("""SELECT p_partkey FROM part WHERE NOT (p_size > 30 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount >= 0.1 AND l_suppkey < 50))""")
def m21_guarded_delete(spark: SparkSession, d: str) -> DataFrame:
    p, li = table(spark, d, "part").select("p_partkey", "p_size"), table(spark, d, "lineitem")
    references = [li.filter("l_quantity > 48").select("l_partkey"), li.filter("l_discount >= 0.1 AND l_suppkey < 50").select("l_partkey")]
    return merge.guarded_delete(p, p.filter("p_size > 30"), references, "p_partkey").select("p_partkey")


@query("""WITH s AS (SELECT c_custkey, max(o_orderdate) AS last, bool_or(o_orderstatus = 'O') AS airing, count(o_orderkey) FILTER (o_orderdate >= TIMESTAMP '2001-06-01') AS recent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'F' GROUP BY c_custkey),
f AS (SELECT c_custkey, last IS NULL AS never, recent > 0 AS changed, coalesce(airing, false) AS airing, c_custkey % 7 = (DATE '2000-01-01' - DATE '1970-01-01') % 7 AS swept FROM s)
SELECT * FROM f WHERE never OR changed OR airing OR swept""")
def r15_due_list(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderdate").alias("last"), F.bool_or(F.col("o_orderstatus") == "O").alias("airing"), F.count_if(F.expr("o_orderdate >= TIMESTAMP_NTZ '2001-06-01'")).alias("recent"))
    s = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    flags = s.select("c_custkey", F.col("last").isNull().alias("never"), F.coalesce(F.col("recent") > 0, F.lit(False)).alias("changed"), F.coalesce("airing", F.lit(False)).alias("airing"), sweep_due(F.col("c_custkey"), F.expr("DATE '2000-01-01'")).alias("swept"))
    return flags.filter("never OR changed OR airing OR swept")


_SIDES = """l AS (SELECT l_orderkey * 10 + l_linenumber AS lid, l_orderkey AS k, l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'A' QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey) = 1),
r AS (SELECT l_orderkey * 10 + l_linenumber AS rid, l_orderkey AS k, l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey) = 1)"""


def _tier_sql(n: int, keys: str) -> str:
    """Candidates of a tier, unique on both sides, and those of them that earlier tiers leave free."""
    side = lambda name, own: f"SELECT {keys}, min({own}) AS {own} FROM {name} GROUP BY {keys} HAVING count(*) = 1"
    free = "".join(f" AND lid NOT IN (SELECT lid FROM t{i}) AND rid NOT IN (SELECT rid FROM t{i})" for i in range(n))
    return f"t{n} AS (SELECT lid, rid FROM ({side('l', 'lid')}) JOIN ({side('r', 'rid')}) USING ({keys}) WHERE true{free})"


@query(
    f"WITH {_SIDES}, {_tier_sql(0, 'k, s')}, {_tier_sql(1, 'k')}, {_tier_sql(2, 'p')} "
    "SELECT lid, rid, 'order_and_supplier' AS tier FROM t0 UNION ALL SELECT lid, rid, 'order' FROM t1 UNION ALL SELECT lid, rid, 'part' FROM t2"
)
def r18_tiered_match(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")

    def side(flag: str, name: str) -> DataFrame:
        first = F.min(F.struct(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"))).alias("f")
        g = li.filter(F.col("l_returnflag") == flag).groupBy("l_orderkey", "l_linenumber").agg(first)
        return g.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias(name), F.col("l_orderkey").alias("k"), "f.s", "f.p")

    return tiered_match(side("A", "lid"), side("R", "rid"), "lid", "rid", [("order_and_supplier", [F.col("k"), F.col("s")]), ("order", [F.col("k")]), ("part", [F.col("p")])])


@query("SELECT o_orderstatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM orders GROUP BY o_orderstatus")
def a28_percent_of_total(spark: SparkSession, d: str) -> DataFrame:
    # the window runs over one row for each status
    g = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return g.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query(f"""WITH w AS (SELECT DISTINCT p_brand AS owner, {fold_sql("p_name")} AS title FROM part WHERE p_size <= 25), e AS (SELECT p_brand AS other, {fold_sql("p_name")} AS title FROM part WHERE p_size > 40),
h AS (SELECT title, other, count(*) AS times FROM e WHERE title <> '' GROUP BY 1, 2), m AS (SELECT owner, count(DISTINCT title) AS matched FROM w JOIN h USING (title) GROUP BY owner),
v AS (SELECT owner, other, count(*) AS votes FROM w JOIN h USING (title) WHERE times = 1 AND other <> owner GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY owner ORDER BY votes DESC) AS rk, count(*) OVER (PARTITION BY owner, votes) AS level FROM v)
SELECT owner, other, votes FROM r JOIN m USING (owner) WHERE rk = 1 AND level = 1 AND votes >= 2 AND votes * 10 >= matched""")
def a24_vote_tally(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the titles is enough here: a brand's titles are spread over all brands."""
    p = table(spark, d, "part").select("p_brand", "p_size", fold(F.col("p_name")).alias("title"))
    wanted = p.filter("p_size <= 25").select(F.col("p_brand").alias("owner"), "title")
    elsewhere = p.filter("p_size > 40").select(F.col("p_brand").alias("other"), "title")
    return vote_tally(wanted, elsewhere, "owner", "title", "other", share=0.1)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def a29_uniqueness_violations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("""WITH a AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2 HAVING count(*) = 1), b AS (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2 HAVING count(*) = 1),
p AS (SELECT l_orderkey, b.n - a.n AS delta, count(*) AS n FROM a JOIN b USING (l_orderkey, l_suppkey) GROUP BY 1, 2) SELECT l_orderkey, first(delta ORDER BY n DESC, delta) AS modal FROM p GROUP BY l_orderkey""")
def w11_modal_offset(spark: SparkSession, d: str) -> DataFrame:
    """Evidence pairs are one to one (a supplier that stands once on either side), so no order makes all its pairs."""
    keys = ["l_orderkey", "l_suppkey"]
    li = table(spark, d, "lineitem").select(*keys, "l_linenumber", (F.col("l_returnflag") == "A").alias("left"))
    side = lambda rows, name: unique_only(rows.select(*keys, F.col("l_linenumber").alias(name)), keys)
    pairs = side(li.filter("left"), "a").join(side(li.filter("NOT left"), "b"), keys)
    n = pairs.groupBy("l_orderkey", (F.col("b") - F.col("a")).alias("delta")).agg(F.count("*").alias("n"))
    return n.groupBy("l_orderkey").agg(F.min_by("delta", F.struct(-F.col("n"), "delta")).alias("modal"))
