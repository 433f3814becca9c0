"""Progress, what comes next, taste and payloads. A line counts as watched if its quantity is over 25."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import completion_pct
from ..functions.text import fold, fold_sql
from ..operators import progress as p
from ..operators.dedup import episode_order, top_k
from ..operators.sets import exclude
from ..tables import table
from .registry import query

_LINES = """
lines AS (SELECT o_custkey AS cust, l_partkey AS part, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, CAST(l_shipdate AS DATE) AS air, CASE WHEN l_quantity > 25 THEN CAST(o_orderdate AS DATE) END AS watched,
  l_discount, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_DAY = "DATE '2000-01-01'"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("cust"), F.col("l_partkey").alias("part"), "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", F.to_date("l_shipdate").alias("air"),
        F.when(F.col("l_quantity") > 25, F.to_date("o_orderdate")).alias("watched"), "l_discount", "o_orderstatus",
    )


def _day():
    return F.expr(_DAY)


_PROGRESS = f"""SELECT cust, part, count(*) AS total, count(*) FILTER (air <= {_DAY}) AS aired, count(*) FILTER (air <= {_DAY} AND watched IS NOT NULL) AS watched,
  min(watched) FILTER (air <= {_DAY}) AS first_watched, max(watched) FILTER (air <= {_DAY}) AS last_watched, max(air) FILTER (air <= {_DAY}) AS latest_aired FROM lines GROUP BY cust, part"""


@query(f"WITH {_LINES} {_PROGRESS}")
def a1_progress_fused(spark: SparkSession, d: str) -> DataFrame:
    return p.progress(_lines(spark, d), ["cust", "part"], "air", "watched", _day())


_ORDER = "l_linenumber = 7, l_linenumber, l_orderkey, l_suppkey, air, l_extendedprice"


def _order():
    # line number 7 stands for season 0, which comes last
    return [F.asc(F.col("l_linenumber") == 7), F.asc("l_linenumber"), F.asc("l_orderkey"), F.asc("l_suppkey"), F.asc("air"), F.asc("l_extendedprice")]


@query(f"WITH {_LINES} SELECT cust, part, l_orderkey, l_linenumber, air FROM (SELECT *, row_number() OVER (PARTITION BY cust, part ORDER BY {_ORDER}) AS rn FROM lines WHERE air <= {_DAY} AND watched IS NULL) WHERE rn = 1")
def w2_next_unwatched(spark: SparkSession, d: str) -> DataFrame:
    return p.next_unwatched(_lines(spark, d), ["cust", "part"], "watched", _order(), F.col("air") <= _day()).select("cust", "part", "l_orderkey", "l_linenumber", "air")


@query(f"WITH {_LINES} SELECT part, cust, l_orderkey, l_linenumber, air FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY air, {_ORDER}, cust) AS rn FROM lines WHERE air > {_DAY}) WHERE rn = 1")
def w3_next_upcoming(spark: SparkSession, d: str) -> DataFrame:
    future = _lines(spark, d).filter(F.col("air") > _day())
    return top_k(future, ["part"], [F.asc("air"), *_order(), F.asc("cust")]).select("part", "cust", "l_orderkey", "l_linenumber", "air")


@query(f"""WITH {_LINES}, p AS ({_PROGRESS}), e AS (SELECT p_partkey AS part, p_size > 25 AS ended FROM part)
SELECT cust, part, aired, watched, CASE WHEN aired > 0 AND watched >= aired AND ended THEN 'finished' ELSE 'in_progress' END AS status FROM p JOIN e USING (part) WHERE watched > 0""")
def r5_watched_status(spark: SparkSession, d: str) -> DataFrame:
    ended = table(spark, d, "part").select(F.col("p_partkey").alias("part"), (F.col("p_size") > 25).alias("ended"))
    status = p.watched_status(F.col("aired"), F.col("watched"), F.col("ended")).alias("status")
    return a1_progress_fused(spark, d).filter("watched > 0").join(ended, "part").select("cust", "part", "aired", "watched", status)


_PCT = "CASE WHEN watched <= 0 OR aired <= 0 THEN 0 WHEN watched >= aired THEN 100 ELSE greatest(1, CAST(floor(watched * 100 / aired) AS INTEGER)) END"
_TASTE = f"""{_LINES}, p AS ({_PROGRESS}), s AS (SELECT cust, part, CAST(round_even(avg(CAST(l_discount * 500 AS INTEGER)) / 10, 1) AS DOUBLE) AS stars FROM lines WHERE o_orderstatus = 'F' GROUP BY cust, part),
m AS (SELECT DISTINCT cust, part FROM lines WHERE o_orderstatus = 'O'), t AS (SELECT p.cust, p.part, {_PCT} AS pct, stars, m.cust IS NOT NULL AS in_list, watched > 0 AS started, last_watched
  FROM p LEFT JOIN s ON p.cust = s.cust AND p.part = s.part LEFT JOIN m ON p.cust = m.cust AND p.part = m.part),
c AS (SELECT *, CASE WHEN stars >= 3.5 THEN 'liked' WHEN stars <= 2.0 THEN 'not_liked' WHEN pct >= 50 THEN 'liked' WHEN started AND {_DAY} - last_watched >= 180 THEN 'not_liked' WHEN in_list AND started THEN 'liked' WHEN in_list THEN 'interested' END AS taste FROM t)"""


def _taste(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    # one aggregate for progress, stars and membership: all three have the same key
    aired = F.col("air") <= _day()
    rated = F.when(F.col("o_orderstatus") == "F", F.rint(F.col("l_discount") * 500))
    t = lines.groupBy("cust", "part").agg(
        F.count_if(aired).alias("aired"), F.count_if(aired & F.col("watched").isNotNull()).alias("watched"), F.max(F.when(aired, F.col("watched"))).alias("last_watched"),
        F.bround(F.avg(rated) / 10, 1).alias("stars"), F.bool_or(F.col("o_orderstatus") == "O").alias("in_list"),
    )
    pct = completion_pct(F.col("watched"), F.col("aired"))
    label = p.taste(F.col("stars"), F.col("pct"), F.col("started"), F.col("last_watched"), F.col("in_list"), _day())
    return t.select("cust", "part", pct.alias("pct"), "stars", "in_list", (F.col("watched") > 0).alias("started"), "last_watched").withColumn("taste", label)


@query(f"WITH {_TASTE} SELECT cust, part, pct, stars, taste FROM c WHERE taste IS NOT NULL")
def r9_taste_ladder(spark: SparkSession, d: str) -> DataFrame:
    return _taste(spark, d).filter("taste IS NOT NULL").select("cust", "part", "pct", "stars", "taste")


@query(f"""WITH {_TASTE},
k AS (SELECT *, row_number() OVER (PARTITION BY cust, taste ORDER BY last_watched DESC NULLS LAST, part) AS rn FROM c WHERE taste IS NOT NULL),
j AS (SELECT cust, string_agg('{{"id":' || part || ',"taste":"' || taste || '","title":"' || p_name || '"}}', ',' ORDER BY {fold_sql("p_name")}, part) AS body, count(*) AS n,
  2 * count(*) FILTER (taste = 'liked') + count(*) FILTER (taste = 'interested') AS weight FROM k JOIN part ON part = p_partkey WHERE taste <> 'interested' OR rn <= 50 GROUP BY cust)
SELECT cust, n, weight >= 10 AS enough, sha256('v1' || chr(10) || 'model' || chr(10) || '[' || body || ']') AS hash FROM j""")
def r10_payload_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = _taste(spark, d).filter("taste IS NOT NULL")
    # one numbering that begins with the interested rows: the branch to cap and the rest are never read apart
    order = Window.partitionBy("cust").orderBy(F.col("taste") != "interested", F.desc_nulls_last("last_watched"), "part")
    capped = rows.withColumn("rn", F.row_number().over(order)).filter("taste <> 'interested' OR rn <= 50")
    titled = capped.join(table(spark, d, "part").select(F.col("p_partkey").alias("part"), "p_name"), "part")
    row = F.struct(fold(F.col("p_name")).alias("f"), "part", "taste", "p_name")
    body = F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["part"].alias("id"), x["taste"].alias("taste"), x["p_name"].alias("title"))))
    weight = 2 * F.count_if(F.col("taste") == "liked") + F.count_if(F.col("taste") == "interested")
    return titled.groupBy("cust").agg(F.count("*").alias("n"), (weight >= 10).alias("enough"), F.sha2(F.concat_ws("\n", F.lit("v1"), F.lit("model"), body), 256).alias("hash"))


@query(f"""WITH {_LINES}
SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT part FROM lines WHERE cust = 7 UNION ALL SELECT part FROM lines WHERE o_orderstatus = 'F' AND cust = 8
  UNION ALL SELECT part FROM lines WHERE l_discount >= 0.1 AND cust < 20 UNION ALL SELECT p_partkey FROM part WHERE p_size > 45 UNION ALL SELECT part FROM lines WHERE air < DATE '1995-02-01')""")
def u1_never_recommend(spark: SparkSession, d: str) -> DataFrame:
    lines, parts = _lines(spark, d), table(spark, d, "part")
    # the branches over lines are one scan with a disjunction instead of four
    excluded = lines.filter("cust = 7 OR (o_orderstatus = 'F' AND cust = 8) OR (l_discount >= 0.1 AND cust < 20) OR air < DATE '1995-02-01'").select("part")
    return exclude(parts.select("p_partkey"), "p_partkey", [excluded, parts.filter("p_size > 45").select("p_partkey")])


@query(f"WITH {_LINES} SELECT cust, l_linenumber AS season, count(*) FILTER (air <= {_DAY}) AS aired, count(*) FILTER (air <= {_DAY} AND watched IS NOT NULL) AS watched FROM lines GROUP BY cust, l_linenumber HAVING count(*) FILTER (air <= {_DAY}) > 0")
def r6_season_progress(spark: SparkSession, d: str) -> DataFrame:
    out = p.progress(_lines(spark, d).withColumnRenamed("l_linenumber", "season"), ["cust", "season"], "air", "watched", _day())
    return out.filter("aired > 0").select("cust", "season", "aired", "watched")


@query(f"""WITH {_LINES}, s AS (SELECT part, l_linenumber AS season, min(air) AS first_air FROM lines WHERE l_linenumber <> 7 GROUP BY part, l_linenumber HAVING min(air) > {_DAY})
SELECT part, min(season) AS season, first(first_air ORDER BY season) AS first_air FROM s GROUP BY part""")
def r4_upcoming_seasons(spark: SparkSession, d: str) -> DataFrame:
    seasons = _lines(spark, d).filter("l_linenumber <> 7").groupBy("part", F.col("l_linenumber").alias("season")).agg(F.min("air").alias("first_air")).filter(F.col("first_air") > _day())
    return seasons.groupBy("part").agg(F.min("season").alias("season"), F.min_by("first_air", "season").alias("first_air"))


@query("SELECT p_brand, CAST(round_even(median(p_size), 0) AS BIGINT) AS runtime FROM part WHERE p_size > 0 GROUP BY p_brand")
def a12_median_half_even(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter("p_size > 0").groupBy("p_brand").agg(F.rint(F.percentile("p_size", F.lit(0.5))).cast("long").alias("runtime"))


@query("SELECT l_suppkey, CAST(round_even(avg(CAST(l_discount * 100 AS INTEGER)) / 2, 1) AS DOUBLE) AS stars, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def a13_group_avg_banker(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.bround(F.avg(F.rint(F.col("l_discount") * 100)) / 2, 1).alias("stars"), F.count("*").alias("n"))


def _episode_sample(spark: SparkSession, d: str) -> DataFrame:
    return top_k(table(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_orderkey", "l_suppkey", "l_extendedprice"), ["l_partkey"], [*episode_order(F.col("l_linenumber") % 3, F.col("l_linenumber") - 2), F.asc("l_orderkey"), F.asc("l_suppkey"), F.asc("l_extendedprice")], 2)


@query("""SELECT l_partkey, l_linenumber, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber % 3 = 0, l_linenumber % 3, l_linenumber - 2 < 0, l_linenumber - 2, l_orderkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn <= 2""")
def o6_episode_order(spark: SparkSession, d: str) -> DataFrame:
    return _episode_sample(spark, d).select("l_partkey", "l_linenumber", "l_orderkey")


@query("SELECT l_partkey, first(l_linenumber ORDER BY l_shipdate DESC, l_linenumber DESC) AS season, max(CAST(l_shipdate AS DATE)) AS last_date FROM lineitem GROUP BY l_partkey")
def a23_last_dated_season(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max_by("l_linenumber", F.struct("l_shipdate", "l_linenumber")).alias("season"), F.to_date(F.max("l_shipdate")).alias("last_date"))
