"""Writes: payloads, snapshots, verdicts, events, imports and handles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import writes as op
from ..tables import table
from .registry import query

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _k():
    return F.get_json_object("props", "$.k").cast("long")


@query("SELECT p_name AS name, min(p_partkey) AS id FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size > 40) GROUP BY p_name")
def m1_key_map(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), "p_size")
    return op.key_map(p.groupBy("name").agg(F.min("id").alias("id")), "name", "id", p.filter("p_size > 40"))


@query("""SELECT coalesce(x.c_custkey, y.c_custkey) AS c_custkey, CASE WHEN y.c_custkey IS NOT NULL THEN y.c_name ELSE x.c_name END AS c_name, CASE WHEN y.c_nationkey < 10 THEN y.seg ELSE x.seg END AS seg
FROM (SELECT c_custkey, c_name, c_mktsegment AS seg FROM customer WHERE c_acctbal > 0) x FULL JOIN (SELECT c_custkey, nullif(c_name || '!', 'Customer#000000001!') AS c_name, nullif(c_mktsegment, 'BUILDING') AS seg, c_nationkey FROM customer WHERE c_acctbal < 5000) y ON x.c_custkey = y.c_custkey""")
def m3_upsert_present(spark: SparkSession, d: str) -> DataFrame:
    """A payload without the segment leaves it; one whose segment is null clears it."""
    c = table(spark, d, "customer")
    old = c.filter("c_acctbal > 0").select("c_custkey", "c_name", F.col("c_mktsegment").alias("seg"))
    name, seg = F.nullif(F.concat("c_name", F.lit("!")), F.lit("Customer#000000001!")), F.nullif("c_mktsegment", F.lit("BUILDING"))
    batch = c.filter("c_acctbal < 5000").select("c_custkey", name.alias("c_name"), seg.alias("seg"), F.lit(True).alias("has_c_name"), (F.col("c_nationkey") < 10).alias("has_seg"))
    return op.upsert_present(old, batch, "c_custkey", ["c_name", "seg"])


@query("""WITH s AS (SELECT l_partkey, l_linenumber, max(l_orderkey) AS season_id FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), f AS (SELECT p_partkey AS l_partkey, CASE WHEN p_size > 40 THEN 1 WHEN p_size < 5 THEN -1 ELSE 0 END AS days FROM part)
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_partkey, season_id, CAST(CAST(l_shipdate AS DATE) + days AS DATE) AS aired, CASE WHEN days <> 0 THEN CAST(l_shipdate AS DATE) END AS raw
FROM lineitem l LEFT JOIN s ON s.l_partkey = l.l_partkey AND s.l_linenumber = l.l_linenumber JOIN f ON f.l_partkey = l.l_partkey WHERE l_returnflag <> 'A'""")
def m4_upsert_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Season ids by number, the highest; dates moved by the show's offset, with the raw one beside where it differs."""
    li = table(spark, d, "lineitem")
    seasons = li.filter("l_returnflag = 'A'").select("l_partkey", "l_linenumber", F.col("l_orderkey").alias("season_id"))
    days = F.when(F.col("p_size") > 40, 1).when(F.col("p_size") < 5, -1).otherwise(0)
    offsets = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), days.alias("days"))
    rows = li.filter("l_returnflag <> 'A'").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.to_date("l_shipdate").alias("air"))
    rows = op.season_ids(rows, seasons, "l_partkey", "l_linenumber", "season_id").join(offsets, "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "season_id", F.date_add("air", F.col("days")).alias("aired"), F.when(F.col("days") != 0, F.col("air")).alias("raw"))


@query("""WITH old AS (SELECT DISTINCT l_orderkey AS show_id, l_suppkey AS id FROM lineitem WHERE l_linenumber <= 3), new AS (SELECT DISTINCT l_orderkey AS show_id, l_suppkey AS id FROM lineitem WHERE l_linenumber > 3),
p AS (SELECT o_orderkey AS show_id, o_orderstatus AS st FROM orders) SELECT show_id, id FROM old WHERE show_id NOT IN (SELECT show_id FROM p WHERE st IN ('F', 'P')) UNION ALL SELECT show_id, id FROM new JOIN p USING (show_id) WHERE st = 'F'""")
def m6_replace_namespace(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders have the namespace, pending ones an empty one, open ones none."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("show_id"), F.col("l_suppkey").alias("id"), "l_linenumber")
    entries = li.filter("l_linenumber > 3").groupBy("show_id").agg(F.collect_set(F.struct("id")).alias("e"))
    status = table(spark, d, "orders").select(F.col("o_orderkey").alias("show_id"), "o_orderstatus").join(entries, "show_id", "left")
    empty = F.array().cast("array<struct<id:bigint>>")
    given = F.when(F.col("o_orderstatus") == "F", F.coalesce("e", empty)).when(F.col("o_orderstatus") == "P", empty)
    return op.replace_namespace(li.filter("l_linenumber <= 3").select("show_id", "id").distinct(), status.select("show_id", given.alias("keywords")), "show_id", "keywords", ["id"])


@query("""WITH s AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS synced, max(ts) FILTER (event_type = 'click') AS credited FROM events GROUP BY user_id)
SELECT user_id, synced, credited, synced IS NOT NULL AND credited IS NULL AS needs_credits, synced IS NOT NULL AND (credited IS NULL OR credited < synced) AS behind FROM s""")
def m13_watermarks(spark: SparkSession, d: str) -> DataFrame:
    """Stamps, and the work lists that follow from them (also P13)."""
    at = lambda t: F.max(F.when(F.col("event_type") == t, F.col("ts")))
    s = table(spark, d, "events").groupBy("user_id").agg(at("purchase").alias("synced"), at("click").alias("credited"))
    synced, missing = F.col("synced").isNotNull(), F.col("credited").isNull()
    return s.select("user_id", "synced", "credited", (synced & missing).alias("needs_credits"), (synced & F.coalesce(missing | (F.col("credited") < F.col("synced")), F.lit(False))).alias("behind"))


@query("""WITH r AS (SELECT p_partkey AS id, CAST(min(user_id) AS INTEGER) AS rank FROM events JOIN part ON p_partkey = CAST(json_extract_string(props, '$.k') AS BIGINT) WHERE event_type = 'purchase' AND p_size <= 45 GROUP BY 1),
o AS (SELECT p_partkey AS id, p_size AS rank FROM part WHERE p_size <= 3)
SELECT 'swapped' AS kind, id, rank FROM r UNION ALL SELECT 'kept', id, rank FROM o""")
def m17_trending_swap(spark: SparkSession, d: str) -> DataFrame:
    """A feed that resolves replaces the snapshot; one of which nothing resolves leaves it."""
    ranked = table(spark, d, "events").filter("event_type = 'purchase'").select(_k().alias("upstream"), F.col("user_id").cast("int").alias("rank"))
    p = table(spark, d, "part")
    known = p.filter("p_size <= 45").select(F.col("p_partkey").alias("upstream"), F.col("p_partkey").alias("id"))
    old = p.filter("p_size <= 3").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("rank"))
    kinds = {"swapped": ranked, "kept": ranked.withColumn("upstream", -1 - F.col("upstream"))}
    out = [op.swap_snapshot(old, rows, known, "upstream", "id", "rank").withColumn("kind", F.lit(kind)) for kind, rows in kinds.items()]
    return out[0].unionByName(out[1]).select("kind", "id", "rank")


@query("""WITH e AS (SELECT p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_size % 4 END AS season, CASE WHEN p_size > 25 THEN 1 ELSE -1 END AS days FROM part), v AS (SELECT p_partkey, p_size % 4 AS season, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE p_size % 3 - 1 END AS days FROM part)
SELECT * FROM e WHERE season IS NULL OR NOT EXISTS (SELECT 1 FROM v WHERE v.p_partkey = e.p_partkey AND v.season = e.season AND v.days IS NOT NULL) UNION ALL SELECT * FROM v WHERE days <> 0""")
def m19_offset_verdicts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    size = F.col("p_size")
    offsets = p.select("p_partkey", F.when(size % 3 != 0, size % 4).alias("season"), F.when(size > 25, 1).otherwise(-1).alias("days"))
    verdicts = p.select("p_partkey", (size % 4).alias("season"), F.when(size % 5 == 0, None).when(size % 5 == 1, 0).otherwise(size % 3 - 1).cast("int").alias("days"))
    return op.apply_verdicts(offsets, verdicts, "p_partkey", "season", "days")


@query("""SELECT p_partkey FROM part WHERE NOT (p_size > 30 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48))""")
def m21_reconciled_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is referred to is left out beforehand here, so the guard holds; tests make it fail."""
    p, held = table(spark, d, "part").select("p_partkey", "p_size"), table(spark, d, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return op.reconciled_delete(p, p.filter("p_size > 30").join(held, "p_partkey", "left_anti"), [held], "p_partkey").select("p_partkey")


_EVENTS = f"""ev AS (SELECT event_id, user_id AS actor, CASE event_type WHEN 'view' THEN 'watched_episode' WHEN 'click' THEN 'rated_show' ELSE 'added_show' END AS verb, {_K} AS target, CASE WHEN event_type = 'click' THEN user_id % 3 END AS season FROM events)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    verb = F.when(F.col("event_type") == "view", "watched_episode").when(F.col("event_type") == "click", "rated_show").otherwise("added_show")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("actor"), verb.alias("verb"), _k().alias("target"), F.when(F.col("event_type") == "click", F.col("user_id") % 3).alias("season"))


@query(f"""WITH {_EVENTS}, ep AS (SELECT p_partkey AS episode, p_size % 7 AS sh, p_size % 3 AS season, p_size % 10 = 9 AS copied FROM part), m AS (SELECT o_custkey AS actor, o_orderkey % 7 AS sh, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 3 END AS season FROM orders WHERE o_orderstatus <> 'P'),
g AS (SELECT DISTINCT actor, episode FROM ep JOIN m ON m.sh = ep.sh AND (m.season IS NULL OR m.season = ep.season) WHERE NOT copied)
SELECT event_id, actor, verb, target, season FROM ev WHERE NOT (verb = 'watched_episode' AND (actor, target) IN (SELECT (actor, episode) FROM g))""")
def m22_collapse_events(spark: SparkSession, d: str) -> DataFrame:
    """A season's or show's mark stands for the episodes that it covers; a copied special's event stays."""
    size = F.col("p_size")
    episodes = table(spark, d, "part").select(F.col("p_partkey").alias("episode"), (size % 7).cast("long").alias("show"), (size % 3).cast("long").alias("season"), (size % 10 == 9).alias("copied"))
    marks = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("actor"), (F.col("o_orderkey") % 7).alias("show"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 3).alias("season")).distinct()
    return op.collapse_events(_events(spark, d), marks, episodes, ~F.col("copied"))


@query(f"""WITH {_EVENTS}, c AS (SELECT DISTINCT user_id AS actor, 'added_show' AS verb, {_K} AS target, CAST(NULL AS BIGINT) AS season FROM events WHERE event_type = 'signup') SELECT * FROM ev WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.actor = ev.actor AND c.verb = ev.verb AND c.target = ev.target AND c.season IS NOT DISTINCT FROM ev.season)""")
def m22_cancel_events(spark: SparkSession, d: str) -> DataFrame:
    """A signup takes back what its user has added; null seasons equal each other."""
    back = table(spark, d, "events").filter("event_type = 'signup'").select(F.col("user_id").alias("actor"), F.lit("added_show").alias("verb"), _k().alias("target"), F.lit(None).cast("long").alias("season"))
    return op.cancel_events(_events(spark, d), back.distinct())


@query(f"""WITH {_EVENTS}, l AS (SELECT actor, target, max_by(verb, event_id) AS verb, max(event_id) AS event_id, count(*) AS n FROM ev WHERE verb <> 'watched_episode' GROUP BY 1, 2)
SELECT actor, target, CASE verb WHEN 'added_show' THEN 'emit' ELSE 'cancel' END AS action, event_id FROM l""")
def m34_emitted_events(spark: SparkSession, d: str) -> DataFrame:
    """The last state of a (user, show) decides whether its event stands or is taken back."""
    ev = _events(spark, d).filter("verb <> 'watched_episode'")
    last = ev.groupBy("actor", "target").agg(F.max_by("verb", "event_id").alias("verb"), F.max("event_id").alias("event_id"))
    return last.select("actor", "target", F.when(F.col("verb") == "added_show", "emit").otherwise("cancel").alias("action"), "event_id")


@query("""WITH w AS (SELECT DISTINCT o_custkey AS usr, l_partkey AS episode FROM lineitem JOIN orders ON o_orderkey = l_orderkey), g AS (SELECT DISTINCT c_custkey AS usr, p_partkey AS episode FROM customer JOIN part ON p_size = c_nationkey WHERE c_mktsegment = 'BUILDING')
SELECT usr, episode FROM w WHERE (usr, episode) NOT IN (SELECT (usr, episode) FROM g)""")
def m24_unmark(spark: SparkSession, d: str) -> DataFrame:
    """Unmarking a show takes all its episodes, specials too."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("usr"))
    watched = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("episode")).join(o, "l_orderkey").select("usr", "episode").distinct()
    episodes = table(spark, d, "part").select(F.col("p_partkey").alias("episode"), F.col("p_size").alias("show"))
    marks = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("usr"), F.col("c_nationkey").alias("show"))
    # keyed by (user, show): a watched episode looks its show up, and no user's marks are spelled out
    shown = watched.join(episodes, "episode")
    return shown.join(marks, ["usr", "show"], "left_anti").select("usr", "episode")


@query("""WITH r AS (SELECT l_orderkey AS set_id, l_partkey AS sh, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2) SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY pos, sh) AS INTEGER) AS rank, sh FROM r""")
def m25_ranked_set(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("set_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    return op.ranked_set(lists.select("set_id", F.transform("l", lambda x: x["l_partkey"]).alias("shows")), "set_id", "shows").select("set_id", "rank", F.col("show").alias("sh"))


@query("""WITH r AS (SELECT c_custkey AS run, CASE WHEN c_nationkey < 12 THEN 'running' ELSE 'succeeded' END AS status, TIMESTAMP '2024-01-01' AS touched FROM customer), dl AS (SELECT user_id AS run, sum(CAST(value AS INTEGER)) AS p, count(*) FILTER (event_type = 'error') AS f, max(ts) AS at_ FROM events GROUP BY 1)
SELECT run, CASE WHEN status = 'running' AND greatest(touched, at_) < TIMESTAMP '2024-01-30' - INTERVAL 12 HOURS THEN 'cancelled' ELSE status END AS status, CAST(5 + coalesce(p, 0) AS BIGINT) AS processed, coalesce(f, 0) AS failed FROM r LEFT JOIN dl USING (run)""")
def m26_run_state(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("c_nationkey") < 12, "running").otherwise("succeeded")
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("run"), status.alias("status"), F.expr("TIMESTAMP_NTZ '2024-01-01'").alias("touched"), F.lit(5).cast("long").alias("processed"), F.lit(0).cast("long").alias("failed"))
    deltas = table(spark, d, "events").select(F.col("user_id").alias("run"), F.rint("value").cast("int").alias("processed"), (F.col("event_type") == "error").cast("int").alias("failed"), F.col("ts").alias("at"))
    return op.run_state(runs, deltas, "run", F.expr("INTERVAL 12 HOURS"), F.expr("TIMESTAMP_NTZ '2024-01-30'"))


_STAGED = f"st AS (SELECT user_id AS usr, {_K} AS episode, CASE event_type WHEN 'error' THEN 'no_episode' ELSE 'ok' END AS outcome, ts AS \"at\" FROM events), w AS (SELECT DISTINCT o_custkey AS usr, o_orderkey % 100 AS episode, TIMESTAMP '2000-01-01' AS \"at\" FROM orders)"


def _staged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    outcome = F.when(F.col("event_type") == "error", "no_episode").otherwise("ok")
    staged = table(spark, d, "events").select(F.col("user_id").alias("usr"), _k().alias("episode"), outcome.alias("outcome"), F.col("ts").alias("at"))
    held = table(spark, d, "orders").select(F.col("o_custkey").alias("usr"), (F.col("o_orderkey") % 100).alias("episode"), F.expr("TIMESTAMP_NTZ '2000-01-01'").alias("at")).distinct()
    return held, staged


@query(f"WITH {_STAGED} SELECT usr, episode, \"at\" FROM w UNION ALL SELECT usr, episode, min(\"at\") FROM st WHERE outcome = 'ok' AND (usr, episode) NOT IN (SELECT (usr, episode) FROM w) GROUP BY 1, 2")
def m27_staged_import(spark: SparkSession, d: str) -> DataFrame:
    held, staged = _staged(spark, d)
    return op.staged_import(held, staged, "usr", "episode")[0]


@query(f"""WITH {_STAGED}, n AS (SELECT DISTINCT usr, episode FROM st WHERE outcome = 'ok' AND (usr, episode) NOT IN (SELECT (usr, episode) FROM w))
SELECT (SELECT count(*) FROM w) AS before, (SELECT count(*) FROM n) AS inserted, (SELECT count(*) FROM w) + (SELECT count(*) FROM n) AS after, (SELECT count(*) FROM st) - (SELECT count(*) FROM n) AS skipped""")
def m27_import_counts(spark: SparkSession, d: str) -> DataFrame:
    held, staged = _staged(spark, d)
    return op.staged_import(held, staged, "usr", "episode")[1]


@query("""SELECT p_brand AS title, CASE WHEN max(p_size) > 49 THEN -max(p_partkey) ELSE min(p_partkey) END AS show_id, CASE WHEN max(p_size) > 49 THEN 'manual' ELSE 'coverage' END AS method FROM part GROUP BY p_brand""")
def m28_resolutions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("title")).agg(F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"), F.max("p_size").alias("size"))
    automatic = p.select("title", F.col("lo").alias("show_id"), F.lit("coverage").alias("method"))
    manual = p.filter("size > 49").select("title", (-F.col("hi")).alias("show_id"), F.lit("manual").alias("method"))
    return op.resolutions(automatic, manual, "title")


@query("""WITH c AS (SELECT p_partkey AS claimant, p_name || p_size AS key_, p_type = 'PROMO' AS exact FROM part), n AS (SELECT *, count(*) FILTER (exact) OVER (PARTITION BY key_) AS e, count(*) OVER (PARTITION BY key_) AS a FROM c)
SELECT claimant, key_, CASE WHEN a = 1 OR (exact AND e = 1) THEN 'keep' WHEN exact THEN 'conflict' ELSE 'retract' END AS verdict FROM n""")
def m29_collision_verdicts(spark: SparkSession, d: str) -> DataFrame:
    claims = table(spark, d, "part").select(F.col("p_partkey").alias("claimant"), F.concat("p_name", F.col("p_size").cast("string")).alias("key_"), (F.col("p_type") == "PROMO").alias("exact"))
    return op.collision_verdicts(claims, "key_", "claimant", "exact").select("claimant", "key_", "verdict")


@query("""WITH f AS (SELECT DISTINCT o_custkey AS owner, l_partkey AS part FROM lineitem JOIN orders ON l_orderkey = o_orderkey), m AS (SELECT p_partkey AS old, p_partkey + 1 AS new FROM part WHERE p_size = 13 AND (p_partkey + 1) NOT IN (SELECT p_partkey FROM part WHERE p_size = 13)),
j AS (SELECT f.*, new, new IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f x WHERE x.owner = f.owner AND x.part = new) AS moved FROM f LEFT JOIN m ON old = part)
SELECT owner, CASE WHEN moved THEN new ELSE part END AS part, moved FROM j""")
def m30_move_touched_rows(spark: SparkSession, d: str) -> DataFrame:
    """A user's rows go from one show to another unless the user has the other already."""
    from ..operators.merge import repoint

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("owner"))
    facts = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part")).join(o, "l_orderkey").select("owner", "part").distinct()
    p = table(spark, d, "part").filter("p_size = 13").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1).alias("new"))
    mapping = p.join(p.select(F.col("old").alias("new")), "new", "left_anti").select("old", "new")
    return repoint(facts, mapping, "owner", "part").select("owner", "part", "moved")


@query("""WITH live AS (SELECT c_custkey AS usr, c_mktsegment || c_nationkey || c_custkey % 7 AS handle FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment || c_nationkey || c_custkey % 7 ORDER BY c_custkey) = 1),
rel AS (SELECT DISTINCT 'BUILDING' || c_nationkey || c_custkey % 7 AS handle, CASE WHEN c_nationkey < 20 THEN min(c_custkey) OVER (PARTITION BY c_nationkey, c_custkey % 7) END AS usr FROM customer WHERE c_nationkey > 5),
want AS (SELECT c_custkey AS usr, 'BUILDING' || c_nationkey || c_custkey % 7 AS handle FROM customer)
SELECT want.usr, want.handle, (live.usr IS NULL OR live.usr = want.usr) AND (rel.handle IS NULL OR coalesce(rel.usr = want.usr, false)) AS ok FROM want LEFT JOIN live ON live.handle = want.handle LEFT JOIN rel ON rel.handle = want.handle""")
def m33_claimable_handles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    tail = F.concat(F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 7).cast("string"))
    live = c.select("c_custkey", F.concat("c_mktsegment", tail).alias("handle")).groupBy("handle").agg(F.min("c_custkey").alias("usr"))
    wanted = c.select(F.col("c_custkey").alias("usr"), F.concat(F.lit("BUILDING"), tail).alias("handle"), "c_nationkey")
    released = wanted.filter("c_nationkey > 5").groupBy("handle", "c_nationkey").agg(F.min("usr").alias("usr")).select("handle", F.when(F.col("c_nationkey") < 20, F.col("usr")).alias("usr"))
    return op.claimable(wanted.select("usr", "handle"), live, released, "handle", "usr")


@query("""WITH s AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) SELECT event_id, CASE WHEN last IS NULL OR ts - last >= INTERVAL 3600 SECONDS THEN ts ELSE last END AS touched FROM s""")
def m35_throttled_touch(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    last = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("event_id", "ts", last.alias("last")).select("event_id", op.touched_at_most_every(F.col("last"), F.col("ts"), 3600).alias("touched"))


_NOW = "TIMESTAMP '2000-06-01'"


@query(f"""SELECT p_partkey, {_NOW} AS as_now, coalesce(a, {_NOW}) AS as_aired, greatest(coalesce(a, {_NOW}), TIMESTAMP '1992-01-01') AS as_floor FROM (SELECT p_partkey, CAST(CASE WHEN p_size % 10 = 0 THEN NULL ELSE DATE '1990-01-01' + p_size * 30 END AS TIMESTAMP) AS a FROM part)""")
def f23_watched_at(spark: SparkSession, d: str) -> DataFrame:
    aired = F.when(F.col("p_size") % 10 != 0, F.expr("CAST(date_add(DATE '1990-01-01', p_size * 30) AS TIMESTAMP_NTZ)"))
    now, signup = F.expr("TIMESTAMP_NTZ '2000-06-01'"), F.expr("TIMESTAMP_NTZ '1992-01-01'")
    modes = {"as_now": "now", "as_aired": "airdate", "as_floor": "airdate_floor"}
    return table(spark, d, "part").select("p_partkey", *[op.watched_at(m, aired, signup, now).alias(n) for n, m in modes.items()])


@query("SELECT event_id, least(50.0, value + user_id * 0.5) AS tokens, CAST(floor(least(50.0, value + user_id * 0.5)) AS BIGINT) AS whole FROM events")
def f25_bucket_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = op.bucket_tokens(50.0, F.col("value"), F.col("user_id"), 0.5)
    return table(spark, d, "events").select("event_id", tokens.alias("tokens"), F.floor(tokens).alias("whole"))
