"""Queries on tables made for them: keys as larger tables have them, and groups whose pairs nothing may spell out."""

import os

import oracle
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from sluice.plans import QUERIES, SQL
from sluice.sources import titles


def made(spark, folder, **tables):
    """A folder with DATA's tables, some of them replaced."""
    for name in os.listdir(DATA):
        if name.removesuffix(".parquet") not in tables:
            os.symlink(f"{DATA}/{name}", f"{folder}/{name}")
    for name, rows in tables.items():
        rows.toPandas().to_parquet(f"{folder}/{name}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    return str(folder)


def same(spark, folder, name):
    got, want = oracle.compare(spark, oracle.connection(folder), folder, QUERIES[name], SQL[name])
    assert got == want
    return got


def test_part_keys_beyond_a_million_take_no_supplier_seasons(spark, tmp_path):
    part, li = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("part", "lineitem"))
    d = made(spark, tmp_path, part=part.withColumn("p_partkey", F.col("p_partkey") + 1000000), lineitem=li.withColumn("l_partkey", F.col("l_partkey") + 1000000))
    same(spark, d, "m14_payload_batch")


def most_rows(df):
    """The most rows that any node of the executed plan gave."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return most


@pytest.mark.parametrize("name", ["j21_title_import", "m22_collapse_events", "r11_resolution"])
def test_rows_of_a_name_or_show_are_not_paired(spark, tmp_path, name):
    part = spark.read.parquet(f"{DATA}/part.parquet")
    times = 8000 // part.count()
    many = part.crossJoin(spark.range(times)).withColumn("p_partkey", F.col("p_partkey") + 100000 * F.col("id")).drop("id")
    d = made(spark, tmp_path, part=many)
    same(spark, d, name)
    assert most_rows(QUERIES[name](spark, d)) <= 5 * many.count()


def test_titles_with_several_names_count_each_show_once(spark):
    rows = spark.createDataFrame([(1, "Ring", None), (1, "ring", 1999), (2, "Ring", 1999), (2, "Ring", 1999), (3, "Ring", 2001), (4, "circle", None), (5, "none", None), (None, "Ring", None)], "title int, name string, year int")
    shows = spark.createDataFrame([(10, "RING", 1999), (11, "ring", 2000), (12, "Wheel", None)], "show_id int, name string, year int")
    akas = spark.createDataFrame([(11, "ring", 2001), (12, "Circle", None), (12, "circle", None)], "show_id int, name string, year int")
    got = {r.title: tuple(r)[1:] for r in titles.resolved(rows, shows, akas).collect()}
    assert got == {1: (2, None, "strict"), 2: (1, 10, "strict"), 3: (1, 11, "aka"), 4: (1, 12, "aka"), 5: (0, None, None), None: (0, None, None)}
