"""Operators on small hand-built tables, edge cases included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sluice.functions import numbers, text
from sluice.operators import dedup, match, merge, people, progress, sessions, sets
from sluice.sources import exports, payload, titles
from sluice.streaming import feed

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()) or "x long"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


def events(spark, rows):
    return spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m), u, t, 0.0, '{"k": 1}') for k, (m, u, t) in enumerate(rows)], EVENTS)


def feed_rows(df):
    return sorted((r.user_id, r.kind, r.n, r.item_id) for r in df.collect())


def test_rollup_breaks_at_the_window_and_is_bridged_by_other_events(spark):
    e = events(spark, [(0, 1, "view"), (5, 1, "view"), (10, 1, "view")])
    assert feed_rows(sessions.activity_rollup(e, window_minutes=30)) == [(1, "run", 3, "r:0")]
    e = events(spark, [(0, 1, "view"), (30, 1, "view")])  # exactly the window: two
    assert feed_rows(sessions.activity_rollup(e, window_minutes=30)) == [(1, "single", 1, "0"), (1, "single", 1, "1")]
    e = events(spark, [(0, 1, "view"), (29, 1, "click"), (50, 1, "view")])
    assert feed_rows(sessions.activity_rollup(e, window_minutes=30)) == [(1, "other", 1, "1"), (1, "run", 2, "r:0")]
    e = events(spark, [(0, 1, "view"), (1, 2, "view"), (2, None, "view"), (3, None, "view")])  # null users are one user
    assert feed_rows(sessions.activity_rollup(e, window_minutes=30).fillna(-1)) == [(-1, "run", 2, "r:2"), (1, "single", 1, "0"), (2, "single", 1, "1")]


def test_rollup_keeps_every_view(spark):
    e = events(spark, [(k * 17 % 400, k % 3, "view" if k % 4 else "click") for k in range(60)])
    out = sessions.activity_rollup(e, window_minutes=20)
    assert out.filter("event_type = 'view'").agg(F.sum("n")).first()[0] == e.filter("event_type = 'view'").count()


def test_keyset_pages_cover_all_rows_once(spark):
    rows = sessions.activity_rollup(events(spark, [(k // 2, k % 2, "click") for k in range(11)]))
    seen, after = [], None
    while True:
        page = sessions.keyset_page(rows, "occurred_at", "sort_id", 4, after).collect()
        if not page:
            break
        seen += [r.sort_id for r in page]
        after = (page[-1].occurred_at.isoformat(sep=" "), page[-1].sort_id)
    assert sorted(seen) == list(range(11)) and len(seen) == 11


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("Shōgun", "Shogun", True), ("Spider-Man", "Spiderman", True), ("The Office (US)", "the office us", True), ("Æon Flux", "Aeon Flux", True), ("Łódź", "Lodz", True), ("Smørrebrød", "Smorrebrod", True), ("The Office", "The Office UK", False), ("Việt Nam", "viet nam", True), ("Ǻrhus", "Arhus", True), ("Đặng", "Dang", True), ("Ελλάς", "ελλας", True), ("Ёлки", "елки", True), ("йод", "иод", False), ("ﬁlm", "film", True), ("Nguye\u0302\u0303n", "Nguyen", True), ("Ḧ ẘ ṩ", "hws", True), ("Shogun", "Shoguns", False), ("", "x", False), ("!!!", "???", False), ("", "", False)],
)
def test_fold(spark, a, b, same):
    assert one(spark, text.folded_equal(F.col("a"), F.col("b")), a=a, b=b) is same


def test_text_functions(spark):
    assert one(spark, text.strip_article(F.col("x")), x="The  Wire") == "wire"
    assert one(spark, text.strip_article(F.col("x")), x="Theory") == "theory"
    assert text.tokens(" a  !! b-c ") == ["a", "b-c"]
    assert one(spark, text.quoted_candidate(F.col("x")), x="Watch “Dark”") == "Dark"
    assert one(spark, text.quoted_candidate(F.col("x")), x="Watch “Dark” (2017)") == "Dark"
    quoted = lambda x: one(spark, text.quoted_candidate(F.col("x")), x=x)
    assert quoted("no quotes") is None and quoted("The Leftovers' 'Manhunt: Unabomber'") == "Manhunt: Unabomber"
    assert quoted("Try ‘Grey’s Anatomy’") == "Grey’s Anatomy" and quoted("Grey’s Anatomy") is None  # a possessive opens nothing
    assert quoted("Try “Dark") is None and quoted("'  '") is None and quoted("say \"it's\"") == "it's" and quoted("«Dark»") is None
    assert one(spark, text.quoted_candidate(F.col("x")), x=None) is None
    assert one(spark, text.handle_stem(F.col("x"), F.lit(1)), x="Jörg Müller!") == "jorg_muller"
    assert one(spark, text.handle_stem(F.col("x"), F.lit(1)), x="admin").startswith("user_")
    assert one(spark, text.rewrite_email_shaped(F.col("x"), F.lit(1)), x="ann@mail.org") == "ann"
    assert one(spark, text.image_url(F.col("x"), "w92"), x="/a.jpg").endswith("/w92/a.jpg")
    assert one(spark, text.image_url(F.col("x"), "w92"), x=None) is None
    assert one(spark, text.valid_handle(F.col("x")), x="@abc_1") and not one(spark, text.valid_handle(F.col("x")), x="1abc")
    assert one(spark, text.decode_cursor(text.encode_cursor(F.col("x"), F.lit("7"))), x="2024-01-01T00:00:00?>") == ["2024-01-01T00:00:00?>", "7"]
    assert text.escape_like("a_b%") == "a\\_b\\%"
    assert not one(spark, text.valid_handle(F.col("x")), x="Admin") and one(spark, text.valid_handle(F.col("x"), reserved=[]), x="Admin")
    assert one(spark, text.handle_stem(F.col("x"), F.lit(1), reserved=["ann_lee"]), x="Ann Lee").startswith("user_")


def test_numbers(spark):
    pct = lambda w, a: one(spark, numbers.completion_pct(F.col("w"), F.col("a")), w=w, a=a)
    assert [pct(0, 5), pct(1, 300), pct(5, 5), pct(6, 5), pct(1, 3), pct(1, 0)] == [0, 1, 100, 100, 33, 0]
    assert str(one(spark, numbers.exact_decimal(F.col("x")), x=8.9)) == "8.900"
    assert one(spark, numbers.half_star(F.col("x")), x=4.5) and not one(spark, numbers.half_star(F.col("x")), x=4.2)


def test_relational_division(spark):
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "b"), (None, "a")], "k long, v string")
    keys = lambda wanted: sorted(r.k for r in sets.having_all(links, "k", "v", wanted).collect() if r.k)
    assert keys(["a", "b"]) == [1] and keys(["a", "a"]) == [1, 2] and keys([]) == [] and keys(["z"]) == []


def test_snapshot_diff_matches_null_keys(spark):
    a = spark.createDataFrame([(1, None, 2), (1, 5, 1)], "u long, k long, n long")
    b = spark.createDataFrame([(1, None, 3), (2, 5, 1), (1, 5, 1)], "u long, k long, n long")
    assert sorted(map(tuple, sets.snapshot_diff(a, b, ["u", "k"], "n").collect()), key=repr) == [(1, None, 2, 3, 1), (2, 5, 0, 1, 1)]
    assert sets.snapshot_diff(a.limit(0), b.limit(0), ["u", "k"], "n").count() == 0


def test_merges(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    batch = spark.createDataFrame([(2, "x", 0), (2, "y", 1), (3, None, 2)], "k long, v string, pos long")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(merge.upsert_last_wins(old, batch, ["k"], "pos")) == [(1, "a"), (2, "y"), (3, None)]
    assert rows(merge.insert_first_wins(old, batch, ["k"], "pos")) == [(1, "a"), (2, "b"), (3, None)]
    assert rows(merge.upsert_coalesce(old, batch.filter("pos > 0").drop("pos"), "k", ["v"])) == [(1, "a"), (2, "y"), (3, None)]
    parents = spark.createDataFrame([(2,)], "k long")
    assert rows(merge.replace_children(old, old.limit(0), parents, "k")) == [(1, "a")]
    assert rows(merge.guarded_delete(old, old.select("k"), [parents], "k")) == [(2, "b")]
    up = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "k long, up long")
    assert rows(merge.prune_missing(up, spark.createDataFrame([(3,)], "k long"), ["k"], "up")) == [(2, None), (3, 30)]


def test_repoint_keeps_owners_rows_unique(spark):
    facts = spark.createDataFrame([(1, 11), (1, 12), (2, 11), (2, 10), (3, 12)], "u long, t long")
    mapping = spark.createDataFrame([(11, 10), (12, 10)], "old long, new long")
    out = merge.repoint(facts, mapping, "u", "t")
    assert sorted((r.u, r.t, r.moved) for r in out.collect()) == [(1, 10, True), (1, 12, False), (2, 10, False), (2, 11, False), (3, 10, True)]


def test_trust_rule(spark):
    day = lambda k: dt.date(2020, 1, k)
    schema = "show long, season int, number int, air date"
    ours, theirs = [], []

    def season(s, pairs):
        for k, (a, b) in enumerate(pairs, 1):
            ours.append((1, s, k, day(a)))
            if b:
                theirs.append((1, s, k, day(b)))

    season(1, [(1, 2), (8, 9)])
    season(2, [(1, 1), (8, 8)])
    season(3, [(1, 2)])
    season(4, [(1, 2), (8, 8)])
    season(5, [(1, 8), (8, 15)])
    season(6, [(1, None), (8, None)])
    ours += [(1, 8, 1, day(1)), (1, 8, 1, day(2)), (1, 9, 0, day(1)), (1, 9, 1, day(8)), (1, 10, None, day(1)), (1, 11, 1, None)]
    theirs += [(1, 8, 1, day(1)), (1, 9, 0, day(2)), (1, 9, 1, day(9))]  # number 0 counts; season 8 has nothing that does
    ours += [(1, 7, -1, day(1)), (1, 7, 1, day(2)), (1, 7, 1, day(3)), (1, 7, 2, day(4))]
    theirs += [(1, 7, 1, day(3)), (1, 7, 2, day(5))]
    got = match.trust_verdicts(spark.createDataFrame(ours, schema), spark.createDataFrame(theirs, schema), "show", "season", "number", "air")
    assert sorted((r.season, r.offset_days, r.compared, r.reason) for r in got.collect()) == [(1, 1, 2, None), (2, 0, 2, None), (3, None, 1, "too_few"), (4, None, 2, "inconsistent"), (5, None, 2, "out_of_range"), (6, None, 0, "no_overlap"), (7, None, 1, "too_few"), (9, 1, 2, None)]


def test_believable(spark):
    judge = lambda u, e, n: spark.range(1).select(people.believable(F.lit(u), F.lit(e), F.lit(n)).alias("r")).first().r
    assert judge(2, 0, 2) and judge(3, 3, 3)  # few titles aren't judged
    assert judge(2, 0, 4) and not judge(3, 0, 4) and judge(0, 9, 10) and not judge(0, 10, 10)


def test_vote_tally(spark):
    wanted = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "a"), (1, ""), (2, "a"), (3, "a"), (3, "b"), (4, "d"), (4, "e"), (4, "f"), (4, "g"), (4, "h")], "owner long, title string")
    held = [(10, "a"), (10, "b"), (10, "c"), (10, "c"), (11, "a"), (1, "a"), (1, "b"), (12, "d"), (12, "e"), (13, "f"), (14, "g"), (15, "h")]
    got = match.vote_tally(wanted, spark.createDataFrame(held, "show long, title string"), "owner", "title", "show")
    # 1: show 10 has a and b once (c twice), 2 of 3 titles; 2: one vote; 3: shows 1 and 10 are level; 4: 2 of 5 is under a half
    assert sorted(map(tuple, got.collect())) == [(1, 10, 2)]
    assert match.vote_tally(wanted.limit(0), spark.createDataFrame(held, "show long, title string"), "owner", "title", "show").count() == 0


def test_rollup_is_the_same_when_days_part_it(spark):
    """A busy user over many days, against one pass in order."""
    import random

    rng = random.Random(3)
    rows, at = [], 0
    for k in range(400):
        at += rng.choice([1, 10, 29, 30, 31, 600, 1500, 4000])
        rows.append((at, 1 if k % 9 else None, "view" if rng.random() < 0.7 else "click"))
    want, last, run = [], {}, {}
    for k, (m, u, t) in enumerate(rows):
        if t == "view":
            if u in run and m - last[u] < 30:
                run[u][1] += 1
            else:
                run[u] = [k, 1]
                want.append((u, run[u]))
        last[u] = m
    got = sessions.activity_rollup(events(spark, rows), window_minutes=30).filter("event_type = 'view'")
    assert sorted(((r.user_id, r.sort_id, r.n) for r in got.collect()), key=repr) == sorted(((u, k, n) for u, (k, n) in want), key=repr)


def test_tiers_claim_once(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "z"), (4, None, "w")], "l long, k string, t string")
    right = spark.createDataFrame([(10, "a", "q"), (11, "c", "x"), (12, "c", "z"), (13, None, "w")], "r long, k string, t string")
    out = match.tiered_match(left, right, "l", "r", [("key", [F.col("k")]), ("title", [F.col("t")])])
    assert sorted(map(tuple, out.collect())) == [(1, 10, "key"), (3, 12, "title"), (4, 13, "title")]  # x stands twice on the left
    # 1 and 20 share a key; 2 has 20's title, but 20 is taken, so 2 goes on to the next tier
    left = spark.createDataFrame([(1, "a", None, None), (2, "b", "t", "n")], "l long, k string, t string, u string")
    right = spark.createDataFrame([(20, "a", "t", None), (21, "c", None, "n")], "r long, k string, t string, u string")
    out = match.tiered_match(left, right, "l", "r", [("key", [F.col("k")]), ("title", [F.col("t")]), ("last", [F.col("u")])])
    assert sorted(map(tuple, out.collect())) == [(1, 20, "key"), (2, 21, "last")]
    assert match.tiered_match(left.limit(0), right, "l", "r", [("key", [F.col("k")])]).count() == 0


def test_taste_ladder(spark):
    label = lambda stars, pct, started, last, in_list: spark.range(1).select(progress.taste(F.lit(stars).cast("double"), F.lit(pct), F.lit(started), F.lit(last), F.lit(in_list), F.lit(dt.date(2020, 7, 1))).alias("r")).first().r
    old, new = dt.date(2020, 1, 1), dt.date(2020, 6, 30)
    assert [label(4.0, 0, False, None, False), label(2.0, 90, True, new, True), label(None, 50, True, old, False), label(None, 10, True, old, True), label(3.0, 10, True, new, True), label(None, 0, False, None, True), label(None, 10, True, new, False)] == ["liked", "not_liked", "liked", "not_liked", "liked", "interested", None]


def test_export_decoding(spark, tmp_path):
    import gzip

    path = str(tmp_path / "ids.json.gz")
    with gzip.open(path, "wt") as f:
        f.write('{"id":1,"original_name":"a","popularity":2.5}\n\n{"id":true}\nnot json\n{"id":2,"popularity":true}\n{"id":"3"}\n{"id":4,"popularity":7}\n')
    got = exports.read_export(spark, path)
    assert [(r.id, r.popularity, r.fault) for r in got.orderBy("position").collect()] == [(1, 2.5, None), (1, None, None), (None, None, "unparseable"), (2, None, None), (3, None, None), (4, 7.0, None)]
    lines = spark.createDataFrame(list(enumerate(['{"id":3.7}', '{"id":" 12 "}', '{"id":"x"}', '{"id":null}', "{}", "[1]", '{"id":-4}', '{"id":false}'])), "position long, value string")
    assert [r.id for r in exports.decode_export(lines).orderBy("position").collect()] == [3, 12, None, None, None, None, -4, 0]
    with gzip.open(path, "wt") as f:
        f.write('{"id":null}\n\n')
    with pytest.raises(exports.EmptyExport):
        exports.read_export(spark, path)
    whole = gzip.compress(b'{"id":1}\n' * 5000)
    (tmp_path / "cut.json.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(Exception):  # noqa: B017
        exports.read_export(spark, str(tmp_path / "cut.json.gz")).collect()
    day = dt.date(2024, 3, 5)
    base = str(tmp_path)
    assert exports.newest_export(spark, base, day) is None
    older = exports.export_path(base, day - dt.timedelta(days=2))
    with open(older, "wb") as f:
        f.write(whole)
    assert exports.newest_export(spark, base, day, declared={older: len(whole)}) == older
    assert exports.newest_export(spark, base, day + dt.timedelta(days=1)) is None
    with pytest.raises(ValueError, match="bytes"):
        exports.newest_export(spark, base, day, declared={older: 7})
    assert exports.implausible(10, 0) and exports.implausible(200_000, 300_000) and exports.implausible(240_000, 240_000) is None


def test_windows_and_changes(spark):
    gaps = spark.createDataFrame([(1, dt.date(2024, 1, 1), dt.date(2024, 2, 1)), (2, dt.date(2024, 1, 1), dt.date(2024, 1, 1))], "k long, a date, b date")
    assert [(r.window_start.day, r.window_end.day) for r in exports.windows(gaps, "a", "b").orderBy("window_start").collect()] == [(1, 15), (15, 29), (29, 1)]
    pages = spark.createDataFrame([(0, 1, '{"results":[{"id":5},{"id":3}]}'), (0, 2, '{"results":[{"id":5},{"id":9},{}]}')], "window int, page int, body string")
    assert [r.id for r in exports.changed_ids(pages).collect()] == [5, 3, 9]
    assert exports.changed_ids(spark.createDataFrame([(0, 1, '{"results":[{"id":true},{"id":"7"},8,{"id":2}]}'), (0, 2, "not json"), (1, 1, "{}")], "window int, page int, body string")).first().id == 2
    w = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 1, 15), 501), (dt.date(2024, 1, 1), dt.date(2024, 1, 2), 900), (dt.date(2024, 1, 1), dt.date(2024, 1, 15), 500)], "a date, b date, pages int")
    got = sorted((r.a.day, r.b.day, r.too_long) for r in exports.halves(w, "a", "b", "pages").collect())
    assert got == [(1, 2, True), (1, 8, False), (8, 15, False)]


def test_payload_rules(spark):
    docs = spark.createDataFrame([(1, '{"results":[{"id":7},{"id":"x"},{"id":true},{"id":9}]}'), (2, "{}"), (3, None)], "k long, body string")
    assert sorted(map(tuple, payload.ranked_ids(docs, "k", "body").collect())) == [(1, 1, 7), (1, 4, 9)]
    eps = spark.createDataFrame([(1, None), (2, []), (3, [(None,)]), (4, [(5,)])], "k long, crew array<struct<id:long>>")
    assert sorted(r.k for r in payload.credit_scope(eps, "k", "crew", lambda x: x["id"].isNotNull()).collect()) == [2, 4]
    ranked = spark.createDataFrame([(1, 1, 10), (1, 3, 11), (1, 5, 10), (1, 7, 99)], "src long, rank int, id long")
    live = spark.createDataFrame([(10, 2), (11, 1)], "id long, target long")
    assert sorted(map(tuple, payload.recommendation_edges(ranked, live, "src").collect())) == [(1, 1, 2)]


def test_titles(spark):
    assert one(spark, titles.bare_title(F.col("x")), x="Dark (US) (2017)") == "Dark"
    assert one(spark, titles.title_year(F.col("x")), x="Dark (2017)") == 2017
    assert one(spark, titles.bare_title(F.col("x")), x="Dark (us)") == "Dark"
    mark = lambda x: one(spark, titles.parse_mark(F.col("x")), x=x)
    assert tuple(mark("9x11")) == (9, 11) and tuple(mark("48xSpecial")) == (48, None) and tuple(mark("2x1b")) == (2, None)
    assert mark("3x") is None and mark("x3") is None and mark("12") is None and mark(None) is None
    assert one(spark, titles.strip_trailer(F.col("x")), x='{"a":1}<img>') == '{"a":1}'


def test_dedup(spark):
    rows = spark.createDataFrame([(1, None, 1), (1, 5, 3), (1, 6, 2), (2, None, 4)], "g long, up long, id long")
    assert sorted((r.g, r.id) for r in dedup.prefer_non_null(rows, ["g"], "up", "id").collect()) == [(1, 2), (2, 4)]
    assert sorted((r.g, r.id) for r in dedup.unique_only(rows, ["g"]).collect()) == [(2, 4)]


def test_stream_gives_the_batch_result(spark, tmp_path):
    e = events(spark, [(k * 7 % 100, k % 3, "view" if k % 5 else "click") for k in range(30)])
    source = str(tmp_path / "in")
    e.filter("event_id % 2 = 0").write.parquet(source)
    store, mark, seen = str(tmp_path / "store"), str(tmp_path / "mark"), []

    def go():
        stream = spark.readStream.schema(EVENTS).parquet(source)
        feed.follow(spark, stream, store, mark, lambda df, k: seen.append(df.count()), once=True).awaitTermination(120)

    go()
    e.filter("event_id % 2 = 1").write.mode("append").parquet(source)  # late events between those that are there
    go()
    want = feed_rows(sessions.activity_rollup(e))
    assert feed_rows(feed.current_feed(spark, store)) == want and len(seen) == 2
    two = spark.createDataFrame([(2,), (2,)], "user_id long")
    assert feed_rows(feed.current_feed(spark, store, two)) == [r for r in want if r[0] == 2]
    for _ in range(2):  # again, as after a crash
        feed.compact(spark, store, 1)
        assert feed_rows(feed.current_feed(spark, store)) == want and feed._folders(spark, store)[1] == []
    feed.apply_batch(spark, store, e.filter("event_id < 4"), 2)  # repeats
    assert feed_rows(feed.current_feed(spark, store)) == want
    assert [f.rsplit("/", 1)[1] for f in feed._folders(spark, store)[0]] == ["base=1", "batch=2"]
