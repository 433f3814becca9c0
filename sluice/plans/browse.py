"""Browsing, searching and resolving titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import email_shaped, fold, fold_sql, handle_stem, handle_stem_sql, image_url, quoted_candidate, rewrite_email_shaped, strip_article, tokens
from ..operators.dedup import prefer_non_null, top_k
from ..operators.match import resolve_titles
from ..operators.sets import having_all
from ..tables import table
from .registry import query


def browse(parts: DataFrame, page: int, per_page: int, kind: str | None = None, most_size: int | None = None, suppliers: DataFrame | None = None) -> DataFrame:
    """A page of parts, by name without its article; filters that are None don't apply."""
    if kind is not None:
        parts = parts.filter(F.col("p_type") == kind)
    if most_size is not None:
        parts = parts.filter(F.col("p_size") <= most_size)
    if suppliers is not None:
        parts = parts.join(suppliers, "p_partkey", "left_semi")
    return parts.orderBy(strip_article(F.col("p_name")).asc_nulls_last(), "p_partkey").offset((page - 1) * per_page).limit(per_page)


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_type = 'PROMO' AND p_size <= 40 ORDER BY regexp_replace(lower(p_name), '^(the|a|an) +', '') NULLS LAST, p_partkey LIMIT 20 OFFSET 40")
def p1_browse_filtered(spark: SparkSession, d: str) -> DataFrame:
    return browse(table(spark, d, "part"), 3, 20, "PROMO", 40).select("p_partkey", "p_name", "p_size")


_SEARCH = "que, src1 !! ÉT"


@query("SELECT doc_id FROM documents WHERE " + " AND ".join(f"(contains({fold_sql('text')}, {fold_sql(repr(t))}) OR contains({fold_sql('source')}, {fold_sql(repr(t))}))" for t in tokens(_SEARCH)))
def p2_token_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", fold(F.col("text")).alias("t"), fold(F.col("source")).alias("s"))
    wanted = tokens(_SEARCH)
    if not wanted:
        return docs.select("doc_id").limit(0)
    for token in wanted:
        docs = docs.filter(F.contains("t", fold(F.lit(token))) | F.contains("s", fold(F.lit(token))))
    return docs.select("doc_id")


@query(f"WITH f AS (SELECT doc_id, {fold_sql('text')} AS folded FROM documents) SELECT doc_id, md5(folded) AS folded_md5, length(folded) AS n FROM f")
def f1_fold_text(spark: SparkSession, d: str) -> DataFrame:
    folded = table(spark, d, "documents").select("doc_id", fold(F.col("text")).alias("folded"))
    return folded.select("doc_id", F.md5("folded").alias("folded_md5"), F.length("folded").cast("long").alias("n"))


@query("""
WITH a AS (SELECT p_brand, p_name AS title FROM part GROUP BY ALL),
m AS (SELECT p_brand, first(title ORDER BY length(title), title) AS alias FROM a WHERE contains(title, 'i') AND contains(title, 'e') GROUP BY p_brand)
SELECT p_partkey, CASE WHEN contains(p_name, 'i') AND contains(p_name, 'e') THEN NULL ELSE alias END AS matched_alias FROM part LEFT JOIN m USING (p_brand)
""")
def p4_best_alias(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    matches = lambda c: F.contains(c, F.lit("i")) & F.contains(c, F.lit("e"))
    best = parts.filter(matches("p_name")).groupBy("p_brand").agg(F.min_by("p_name", F.struct(F.length("p_name"), "p_name")).alias("alias"))
    return parts.join(best, "p_brand", "left").select("p_partkey", F.when(~matches("p_name"), F.col("alias")).alias("matched_alias"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderdate < TIMESTAMP '2000-12-31' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 24")
def p10_anticipated(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderdate >= TIMESTAMP_NTZ '2000-01-01' AND o_orderdate < TIMESTAMP_NTZ '2000-12-31'")
    return o.select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(24)


@query("""
WITH f AS (SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber AS rank, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 45)
SELECT src, dst, rank FROM f WHERE place <= 4
""")
def j6_ranked_edges_capped(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines stand for the ranked edges of a show; ranks keep their gaps, and shows that aren't live go before the cap."""
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("rank"), "l_suppkey")
    live = table(spark, d, "part").filter("p_size <= 45").select(F.col("p_partkey").alias("dst"))
    return top_k(edges.join(live, "dst"), ["src"], [F.asc("rank"), F.asc("dst"), F.asc("l_suppkey")], 4).select("src", "dst", "rank")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey IN (1, 2, 3))")
def j7_any_supplier(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").filter(F.col("l_suppkey").isin(1, 2, 3)).select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(lines, "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("""
SELECT l_partkey AS p_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST') GROUP BY l_partkey HAVING count(DISTINCT r_name) = 5
""")
def j8_all_regions(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    of = table(spark, d, "supplier").join(regions, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "r_name")
    links = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").join(of, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("p_partkey"), "r_name")
    return having_all(links, "p_partkey", "r_name", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "ASIA"])


_TITLES = [(1, "Red Plate", 20), (2, "the hot ring!", 5), (3, "Brand#7", None), (4, "no such thing", 3), (5, "small-widget", None), (6, "BRAND 11", 30), (7, "!!!", None)]
_VALUES = ", ".join(f"({k}, '{t}', {y if y is not None else 'CAST(NULL AS INTEGER)'})" for k, t, y in _TITLES)


@query(f"""
WITH q(k, title, y) AS (VALUES {_VALUES}),
c AS (SELECT q.k, p.p_partkey, p.p_retailprice, 0 AS tier FROM q JOIN part p ON {fold_sql('p.p_name')} = {fold_sql('q.title')} AND {fold_sql('q.title')} <> '' AND (q.y IS NULL OR abs(p.p_size - q.y) <= 1)
  UNION ALL SELECT q.k, p.p_partkey, p.p_retailprice, 1 FROM q JOIN part p ON {fold_sql('p.p_brand')} = {fold_sql('q.title')} AND {fold_sql('q.title')} <> '' AND (q.y IS NULL OR abs(p.p_size - q.y) <= 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, p_retailprice DESC NULLS LAST, p_partkey) AS rn FROM c)
SELECT CAST(k AS INTEGER) AS k, p_partkey, CAST(tier AS INTEGER) AS tier FROM r WHERE rn = 1
""")
def j23_resolve_title_year(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame(_TITLES, "k int, title string, y int")
    return resolve_titles(wanted, table(spark, d, "part"), "k", "title", "y", "p_partkey", "p_name", "p_brand", "p_size", "p_retailprice").select("k", "p_partkey", "tier")


@query(f"""
WITH s AS (SELECT c_custkey, {handle_stem_sql("left(c_name, 8) || c_mktsegment", "c_custkey")} AS stem FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY c_custkey) AS rn FROM s)
SELECT c_custkey, CASE WHEN rn = 1 THEN stem ELSE substr(stem, 1, 24) || '_' || CAST(rn AS VARCHAR) END AS handle FROM r
""")
def w6_handle_stem(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = table(spark, d, "customer").select("c_custkey", handle_stem(F.concat(F.left("c_name", F.lit(8)), "c_mktsegment"), F.col("c_custkey")).alias("stem"))
    rn = F.row_number().over(Window.partitionBy("stem").orderBy("c_custkey"))
    return s.withColumn("rn", rn).select("c_custkey", F.when(F.col("rn") == 1, F.col("stem")).otherwise(F.concat(F.substring("stem", 1, 24), F.lit("_"), F.col("rn").cast("string"))).alias("handle"))


@query(f"SELECT doc_id, {handle_stem_sql('text', 'doc_id')} AS handle FROM documents")
def f19_text_handles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", handle_stem(F.col("text"), F.col("doc_id")).alias("handle"))


@query("""
SELECT p_brand, p_type, p_partkey, size FROM (SELECT p_brand, p_type, p_partkey, nullif(p_size, 10) AS size, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY nullif(p_size, 10) IS NULL, p_partkey) AS rn FROM part) WHERE rn = 1
""")
def w7_prefer_dedup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_type", "p_partkey", F.nullif("p_size", F.lit(10)).alias("size"))
    return prefer_non_null(p, ["p_brand", "p_type"], "size", "p_partkey")


@query("SELECT l_partkey, first(s_suppkey ORDER BY s_name, s_suppkey) AS s_suppkey, min(s_name) AS s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey")
def w8_primary_supplier(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_partkey", F.col("l_suppkey").alias("s_suppkey"))
    first = lines.join(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey").groupBy("l_partkey").agg(F.min(F.struct("s_name", "s_suppkey")).alias("m"))
    return first.select("l_partkey", "m.s_suppkey", "m.s_name")


_EMAILS = "CASE WHEN regexp_matches(name, '[^\\s@]@[^\\s@]*\\.[^\\s@]') THEN CASE WHEN trim(split_part(name, '@', 1)) <> '' THEN trim(split_part(name, '@', 1)) ELSE 'User ' || substr(md5(CAST(k AS VARCHAR)), 1, 8) END ELSE name END"
_NAMES = "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) || '@x' || CAST(c_custkey AS VARCHAR) || '.org' WHEN c_custkey % 7 = 0 THEN ' @mail.org' ELSE c_name END AS name FROM customer"


@query(f"SELECT k, regexp_matches(name, '[^\\s@]@[^\\s@]*\\.[^\\s@]') AS shaped FROM ({_NAMES})")
def f21_email_shape(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("k", email_shaped(F.col("name")).alias("shaped"))


@query(f"SELECT k, {_EMAILS} AS display_name FROM ({_NAMES})")
def f22_email_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("k", rewrite_email_shaped(F.col("name"), F.col("k")).alias("display_name"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lower("c_mktsegment"), F.lit("@x"), k.cast("string"), F.lit(".org"))).when(k % 7 == 0, F.lit(" @mail.org")).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select(k.alias("k"), name.alias("name"))


@query("""
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 4 THEN p_name || '’s ' || p_brand WHEN 5 THEN p_brand END AS candidate FROM part
""")
def f16_quoted_candidate(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    title = (
        F.when(k % 7 == 0, F.concat(F.lit('The "'), "p_name", F.lit('" show'))).when(k % 7 == 1, F.concat("p_brand", F.lit(": “ "), "p_name", F.lit(" ”")))
        .when(k % 7 == 2, F.concat("p_name", F.lit(" “x"))).when(k % 7 == 3, F.concat("p_name", F.lit("’s best"))).when(k % 7 == 4, F.concat(F.lit("Try ‘"), "p_name", F.lit("’s "), "p_brand", F.lit("’")))
        .when(k % 7 == 5, F.concat("p_name", F.lit("' '"), "p_brand", F.lit("'"))).otherwise(F.col("p_name"))
    )
    return table(spark, d, "part").select("p_partkey", quoted_candidate(title).alias("candidate"))


@query("SELECT page_id, CASE WHEN trim(path) <> '' THEN 'https://images.example/t/p/w342/' || ltrim(trim(path), '/') END AS poster FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '  ' WHEN page_id % 5 = 1 THEN NULL ELSE '//' || split_part(url, '/', 4) || '.jpg ' END AS path FROM pages)")
def p16_image_urls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    path = F.when(k % 5 == 0, F.lit("  ")).when(k % 5 != 1, F.concat(F.lit("//"), F.split_part("url", F.lit("/"), F.lit(4)), F.lit(".jpg ")))
    return table(spark, d, "pages").select("page_id", image_url(path, "w342").alias("poster"))
