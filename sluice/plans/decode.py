"""Decoders over JSON made from rows, and the import of titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import exports, payload, titles
from ..tables import table
from .registry import query


@query("""SELECT p_partkey, country, 'buy' AS offer_type, p_size AS provider_id, p_brand AS provider_name FROM part, (VALUES ('US'), ('GB')) c(country) WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, 'US', 'flatrate', p_size + 100, p_type FROM part WHERE p_partkey % 3 <> 0""")
def s7_explode_map(spark: SparkSession, d: str) -> DataFrame:
    offer = lambda k, name: F.array(F.struct(k.cast("long").alias("provider_id"), name.alias("provider_name"), F.lit(1).alias("display_priority")))
    buy = offer(F.col("p_size"), F.col("p_brand")).alias("buy")
    us = F.struct(buy, offer(F.col("p_size") + 100, F.col("p_type")).alias("flatrate"))
    doc = F.when(F.col("p_partkey") % 3 != 0, F.to_json(F.struct(us.alias("US"), F.struct(buy).alias("GB")))).otherwise("{}")
    out = payload.offers(table(spark, d, "part").withColumn("doc", doc), "p_partkey", F.from_json("doc", payload.PROVIDERS))
    return out.select("p_partkey", "country", "offer_type", F.col("provider_id").cast("int").alias("provider_id"), "provider_name")


@query("""WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS rank FROM events)
SELECT user_id, rank, id FROM e WHERE id % 5 <> 0 AND rank <= 20""")
def s8_posexplode_rank(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    entry = F.when(k % 5 == 0, F.lit('{"id":true}')).otherwise(F.concat(F.lit('{"id":'), k.cast("string"), F.lit("}")))
    lists = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", entry.alias("e")))).alias("l"))
    docs = lists.select("user_id", F.concat(F.lit('{"results":['), F.array_join(F.transform("l", lambda x: x["e"]), ","), F.lit("]}")).alias("body"))
    return payload.ranked_ids(docs, "user_id", "body", 20)


@query("""SELECT o_orderkey AS show, l_linenumber AS person_id, l_returnflag AS department, 'job' || CAST(l_suppkey AS VARCHAR) AS job FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linestatus <> 'F'""")
def m9_flatten_nested(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    job = F.concat(F.lit("job"), F.col("l_suppkey").cast("string"))
    jobs = F.array(F.struct(F.when(F.col("l_linestatus") != "F", job).otherwise("").alias("job"), F.lit("x").alias("credit_id")))
    person = F.struct(F.col("l_linenumber").cast("long").alias("id"), F.col("l_returnflag").alias("department"), jobs.alias("jobs"))
    docs = li.groupBy(F.col("l_orderkey").alias("show")).agg(F.to_json(F.struct(F.collect_list(person).alias("crew"))).alias("doc"))
    _, crew = payload.flatten_credits(docs, "show", F.from_json("doc", payload.AGGREGATE))
    return crew.select("show", F.col("person_id").cast("int").alias("person_id"), "department", "job")


@query("""SELECT l_orderkey AS show, l_linenumber AS season_number, CAST(count(*) AS INTEGER) AS episodes FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def s5_appended_seasons(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    season = li.groupBy("l_orderkey", "l_linenumber").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("l_suppkey").alias("id"))).alias("episodes"))).alias("body"))
    member = F.concat(F.lit('"season/'), F.col("l_linenumber").cast("string"), F.lit('":'), F.col("body"))
    docs = season.groupBy(F.col("l_orderkey").alias("show")).agg(F.concat(F.lit('{"name":"x",'), F.array_join(F.collect_list(member), ","), F.lit("}")).alias("doc"))
    return payload.appended_seasons(docs, "show", "doc").select("show", "season_number", F.size("season.episodes").alias("episodes"))


@query("""SELECT p_partkey AS position, CASE p_partkey % 9 WHEN 1 THEN NULL WHEN 2 THEN 1 WHEN 6 THEN NULL ELSE p_partkey END AS id, CASE WHEN p_partkey % 9 = 1 THEN NULL ELSE p_name END AS name,
CASE WHEN p_partkey % 9 IN (1, 3, 4) THEN NULL ELSE p_retailprice END AS popularity, CASE p_partkey % 9 WHEN 1 THEN 'unparseable' WHEN 6 THEN 'no_id' END AS fault FROM part WHERE p_partkey % 9 <> 0""")
def s1_id_export(spark: SparkSession, d: str) -> DataFrame:
    k, text = F.col("p_partkey"), lambda c: F.col(c).cast("string")
    whole = lambda i, p: F.concat(F.lit('{"id":'), i, F.lit(',"original_name":"'), F.col("p_name"), F.lit('","popularity":'), p, F.lit("}"))
    line = (
        F.when(k % 9 == 0, "  ").when(k % 9 == 1, F.lit('{"id": 5, "orig')).when(k % 9 == 2, whole(F.lit("true"), text("p_retailprice")))
        .when(k % 9 == 3, whole(text("p_partkey"), F.lit("true"))).when(k % 9 == 4, whole(text("p_partkey"), F.lit('"high"')))
        .when(k % 9 == 5, whole(F.concat(F.lit('" '), text("p_partkey"), F.lit('"')), text("p_retailprice"))).when(k % 9 == 6, whole(F.lit('"x7"'), text("p_retailprice")))
        .when(k % 9 == 7, whole(F.concat(text("p_partkey"), F.lit(".75")), text("p_retailprice"))).otherwise(whole(text("p_partkey"), text("p_retailprice")))
    )
    return exports.decode_export(table(spark, d, "part").select(k.alias("position"), line.alias("value")))


@query("""WITH g AS (SELECT o_custkey AS cust, min(CAST(o_orderdate AS DATE)) AS a, min(CAST(o_orderdate AS DATE)) + CAST(o_custkey % 45 AS INTEGER) AS b FROM orders GROUP BY o_custkey),
w AS (SELECT cust, a, b, unnest(range(0, CAST(b - a AS BIGINT), 14)) AS k FROM g)
SELECT cust, CAST(a + CAST(k AS INTEGER) AS DATE) AS window_start, CAST(least(a + CAST(k AS INTEGER) + 14, b) AS DATE) AS window_end FROM w""")
def s10_gap_windows(spark: SparkSession, d: str) -> DataFrame:
    a = F.to_date(F.min("o_orderdate"))
    gaps = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cust")).agg(a.alias("a")).withColumn("b", F.date_add("a", (F.col("cust") % 45).cast("int")))
    return exports.windows(gaps, "a", "b").select("cust", "window_start", "window_end")


_TITLE = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' (' || CAST(1990 + p_size AS VARCHAR) || ')' WHEN 1 THEN p_name || CASE WHEN p_partkey % 8 = 1 THEN ' (US)' ELSE ' (uk)' END WHEN 2 THEN upper(p_name) ELSE p_brand END"


@query(f"""WITH t AS (SELECT p_partkey, {_TITLE} AS raw FROM part), n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(raw, '\\s*\\(\\d{{4}}\\)\\s*$', ''), '(?i)\\s*\\((?:US|UK|AU|CA|NZ)\\)\\s*$', '')) AS name, TRY_CAST(nullif(regexp_extract(raw, '\\((\\d{{4}})\\)\\s*$', 1), '') AS INTEGER) AS year FROM t),
s AS (SELECT n.p_partkey AS title, p.p_partkey AS show_id FROM n JOIN part p ON lower(n.name) = lower(p.p_name) AND (n.year IS NULL OR n.year = 1990 + p.p_size)),
k AS (SELECT n.p_partkey AS title, p.p_partkey AS show_id FROM n JOIN part p ON lower(n.name) = lower(p.p_brand) AND (n.year IS NULL OR n.year = 1990 + p.p_size) WHERE n.p_partkey NOT IN (SELECT title FROM s)),
u AS (SELECT DISTINCT *, 'strict' AS method FROM s UNION ALL SELECT DISTINCT *, 'aka' FROM k)
SELECT n.p_partkey AS title, count(DISTINCT show_id) AS n_candidates, CASE WHEN count(DISTINCT show_id) = 1 THEN min(show_id) END AS show_id, min(method) AS method FROM n LEFT JOIN u ON title = n.p_partkey GROUP BY n.p_partkey""")
def j21_title_import(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    t = part.select(F.col("p_partkey").alias("title"), F.expr(_TITLE.replace("VARCHAR", "STRING")).alias("raw"))
    t = t.select("title", titles.bare_title(F.col("raw")).alias("name"), titles.title_year(F.col("raw")).alias("year"))
    shows = part.select(F.col("p_partkey").alias("show_id"), F.col("p_name").alias("name"), (1990 + F.col("p_size")).alias("year"))
    akas = part.select(F.col("p_partkey").alias("show_id"), F.col("p_brand").alias("name"), (1990 + F.col("p_size")).alias("year"))
    return titles.resolved(t, shows, akas)


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_suppkey % 9 IN (0, 1) THEN NULL ELSE l_linenumber END AS season, CASE WHEN l_suppkey % 9 <= 3 THEN NULL ELSE CAST(l_suppkey AS INTEGER) END AS number FROM lineitem""")
def s11_parse_marks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_suppkey")
    season = F.concat(F.col("l_linenumber").cast("string"), F.lit("x"))
    mark = F.when(k % 9 == 0, "x12").when(k % 9 == 1, season).when(k % 9 == 2, F.concat(season, F.lit("Special"))).when(k % 9 == 3, F.concat(season, k.cast("string"), F.lit("b"))).otherwise(F.concat(season, k.cast("string")))
    m = titles.parse_mark(mark)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", m["season"].alias("season"), m["number"].alias("number"))
