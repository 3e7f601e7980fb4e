"""Semantics that the provided tables don't show, on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import text as tx
from tidewheel.functions import timeutil as tm
from tidewheel.operators import merge as mg
from tidewheel.operators import pages as pg
from tidewheel.operators import relational as rel
from tidewheel.plans import feeds, groups, ingest, parse
from tidewheel.sources import readers, schemas
from tidewheel.sources.keyed import KeyedTable
from tidewheel.streaming import ingest as stream

T = dt.datetime
AS_OF = "2024-03-10 12:00:00"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def posts(spark, rows):
    full = [(n, m, f"name-{m}", "", n, title, body, when, views, False, when) for n, m, title, body, when, views in rows]
    return spark.createDataFrame(full, schemas.POSTS)


def slots(spark, rows):
    return spark.createDataFrame([(i, m, f"name-{m}", p, s, None, d, raw, s) for i, m, p, s, d, raw in rows], schemas.SCHEDULES)


def members(spark):
    rows = [("10", "Ada", "red", True, 1), ("b", "Bo", "red", False, 2), ("c", "Cy", None, True, 3), ("d", "Bo", "blue", True, 4), ("e", "", "blue", True, 5)]
    return readers.roster(spark, rows)


def test_broadcast_day_bounds(spark):
    for ts, day in ((T(2024, 3, 9, 20, 59, 59), dt.date(2024, 3, 9)), (T(2024, 3, 9, 21, 0, 0), dt.date(2024, 3, 10))):
        assert one(spark, tm.broadcast_day(F.lit(ts).cast("timestamp_ntz"))) == day
    start, end = tm.day_bounds(AS_OF, 1)
    assert one(spark, start) == T(2024, 3, 10, 21) and one(spark, end) == T(2024, 3, 11, 21)
    assert one(spark, tm.day_label(F.lit("2024-03-10").cast("date")))["day_name"] == "일"


def test_times(spark):
    s = lambda c: one(spark, c)
    assert s(tm.parse_iso(F.lit("2024-01-01T13:00:00.9+09:00"))) == T(2024, 1, 1, 4)
    assert s(tm.parse_iso(F.lit("nope"))) is None and s(tm.parse_iso(F.lit(""))) is None
    assert s(tm.compose_local(F.lit("2024-01-01"), F.lit("08:30"))) == T(2023, 12, 31, 23, 30)
    assert s(tm.compose_local(F.lit("2024-01-01"), F.lit(""))) is None
    assert [s(tm.day_offset(F.lit(x))) for x in ("3abc", "-2", "", "x")] == [3, -2, 0, 0]
    ages = [(30, "방금"), (59 * 60 + 59, "59분 전"), (3600, "1시간 전"), (86400 * 2, "2일 전")]
    for seconds, text in ages:
        ts = F.lit(T(2024, 3, 10, 12) - dt.timedelta(seconds=seconds)).cast("timestamp_ntz")
        assert s(tm.time_ago(ts, AS_OF)) == text
    assert s(tm.is_fresh(F.lit(T(2024, 3, 10, 9)).cast("timestamp_ntz"), AS_OF)) is False


def test_html(spark):
    s = lambda f, x: one(spark, f(F.lit(x)))
    assert s(tx.strip_html, "<p>a&amp;lt;b</p> 　<br>c﻿&nbsp;") == "a<b c"
    assert s(tx.strip_html, None) == "" and s(tx.strip_html, " plain  text ") == "plain text"
    html = '<img src="http://a/1"><IMG alt=x src=\'https://b/2\'><img src="/local">' + '<img src="http://a/1">' * 5
    assert s(tx.image_urls, html) == ["http://a/1", "https://b/2"] + ["http://a/1"] * 3
    bad = '<script>x\n</script><b onclick="y()" ONLOAD=z>t</b><a href="javascript:void(0)">l</a><img src="data:text/html,x"><img src="data:image/png;x">'
    assert s(tx.sanitize_html, bad) == '<b>t</b><a href="#">l</a><img src=""><img src="data:image/png;x">'
    assert s(tx.sanitize_html, "<iframe src=x>y</iframe><form>q</form><input type=a/><p style=\"color:red;background:url(x)\">k</p>") == "<p >k</p>"
    assert s(tx.sanitize_html, None) == ""
    assert s(tx.escape_html, '<a href="x">&') == "&lt;a href=&quot;x&quot;&gt;&amp;"


def test_numbers_and_lists(spark):
    s = lambda c: one(spark, c)
    assert [s(tx.to_int(F.lit(x))) for x in ("12abc", " -7", "x", "")] == [12, -7, None, None]
    assert s(tx.grouped_int(F.lit("1,234"))) == 1234 and s(tx.grouped(F.lit(1234567))) == "1,234,567"
    assert s(tx.tokens(F.lit("a,,b,c"), 2)) == ["a", "b"] and s(tx.media_type(F.lit("image/png; q=1"))) == "image/png"
    assert s(tx.filled(F.lit(""), F.lit("b"))) == "b" and s(tx.url("/x/{id}", id=F.lit(5))) == "/x/5"
    for bad in ("", None, "{", '{"date":"d"}'):
        assert s(F.size(tx.parse_items(F.lit(bad).cast("string")))) == 0
    assert s(tx.has_keyword(F.lit(None).cast("string"), F.lit("on Air"), ["ON"])) is False


def test_feeds(spark):
    p = posts(spark, [(1, "10", "t1", "", T(2024, 3, 10), 1000), (2, "b", "", "", T(2024, 3, 10), 5000), (3, "c", "t3", "", T(2024, 3, 9), 999)])
    s = slots(
        spark,
        [
            (1, "10", 1, T(2024, 3, 9, 20, 59, 59), "early", "r"), (2, "10", 1, T(2024, 3, 9, 21), "", "raw"), (3, "10", 1, T(2024, 3, 10, 5), "later", "r"), (4, "b", 2, T(2024, 3, 10, 20, 59, 59), "x", "r"),
            (5, "c", 3, T(2024, 3, 10, 7), "few views", "r"), (6, "b", 2, T(2024, 3, 10, 21), "next day", "r"), (7, "c", 9, T(2024, 3, 10, 8), "no post", "r"), (8, "c", 4, T(2024, 3, 10, 8), "s", schemas.SENTINEL),
            (9, "c", 5, T(2024, 3, 10, 8), "null raw", None), (10, "manual", 1709999999999, T(2024, 3, 10, 8), "by hand", "r"),
        ],
    )
    hot = feeds.hot_notices(s, p, AS_OF).collect()
    assert [(r["post_id"], r["description"]) for r in hot] == [(1, ""), (2, "x")]
    day = feeds.schedules(s, p, members(spark), AS_OF)
    assert [(r["post_id"], r["member_name"], r["description"], r["posted_at"] is None) for r in day.collect()] == [(1, "Ada", "raw", False), (3, "Cy", "few views", False), (9, "Cy", "no post", True)]
    response = feeds.day_response(day, AS_OF).first()
    assert (response["date"], response["day_name"], len(response["slots"])) == ("2024-03-10", "일", 3)
    assert [r["post_id"] for r in feeds.notices(p, members(spark), 2).collect()] == [2, 1]
    assert [r["id"] for r in feeds.Admin.list_schedules(s, AS_OF).collect()][0] == 6
    with pytest.raises(ValueError):
        feeds.notice_content(p, 0)
    assert feeds.notice_content(p, 77).count() == 0


def test_admin_and_merge(spark):
    s = slots(spark, [(1, "10", 1, T(2024, 3, 10), "a", "r"), (2, "b", 2, T(2024, 3, 10), "b", "r")])
    added = feeds.Admin.add_schedule(s, "Zed", "2024-03-10 10:00:00", AS_OF)
    assert added.where("member_id = 'manual'").first()["post_id"] == 1710072000000
    assert feeds.Admin.delete_schedule(s, 1).count() == 1
    edited = feeds.Admin.edit_schedule(s, 2, description="new", member_name="").orderBy("id").collect()
    assert [(r["description"], r["member_name"]) for r in edited] == [("a", "name-10"), ("new", "name-b")]
    with pytest.raises(ValueError):
        feeds.Admin.edit_schedule(s, 2, description="")
    p = posts(spark, [(1, "a", "old", "body", T(2024, 1, 1), 1), (2, "a", "keep", "body2", T(2024, 1, 1), 1)])
    fresh = posts(spark, [(1, "z", "new", None, T(2024, 1, 2), 5), (3, "c", "first", "x", T(2024, 1, 2), 5), (3, "d", "last", "y", T(2024, 1, 3), 6)]).withColumn("o", F.col("views") * 10 + F.length("title"))
    done = mg.upsert_posts(p, fresh, "o")
    rows = {r["post_id"]: (r["member_id"], r["title"], r["body_html"], r["views"]) for r in done.collect()}
    assert rows == {1: ("a", "new", "body", 5), 2: ("a", "keep", "body2", 1), 3: ("c", "last", "y", 6)}
    again = mg.upsert_posts(done, fresh, "o")
    assert sorted(map(str, again.collect())) == sorted(map(str, done.collect()))
    assert mg.insert_ignore(p, fresh.drop("o"), ["post_id"], "posted_at").where("post_id = 3").first()["title"] == "first"


def test_ingest(spark, tmp_path):
    lists = [
        {"member_id": "10", "boards": [{"title_no": 1, "title_name": None, "reg_date": "2024-03-01 10:00:00", "count": None, "is_pin": True, "is_notice": True}, {"title_no": 2, "title_name": "two", "reg_date": "2024-03-02 10:00:00", "count": {"read_cnt": 7}}]},
        {"member_id": "b"},
        {"member_id": "zz", "boards": [{"title_no": 9, "title_name": "stranger"}]},
    ]
    (tmp_path / "lists.json").write_text("\n".join(map(json.dumps, lists)) + "\nnot json\n")
    (tmp_path / "bodies.json").write_text(json.dumps({"member_id": "10", "title_no": 2, "content": {"content": "<p>hi</p>"}}))
    rows, bodies = readers.read_posts(spark, str(tmp_path / "lists.json")), readers.read_bodies(spark, str(tmp_path / "bodies.json"))
    target = posts(spark, [(1, "10", "one", "kept", T(2024, 3, 1), 3)])
    after = ingest.ingest(rows, bodies, target, members(spark), "popular", AS_OF)
    got = {r["post_id"]: (r["title"], r["body_html"], r["views"], r["is_pinned"]) for r in after.collect()}
    assert got == {1: ("", "kept", 0, True), 2: ("two", "<p>hi</p>", 7, False)}
    twice = ingest.ingest(rows, bodies, after, members(spark), "popular", AS_OF)
    assert {r["post_id"]: r["body_html"] for r in twice.collect()} == {1: "kept", 2: "<p>hi</p>"}
    assert ingest.ingest(rows, bodies, target, members(spark), "rest", AS_OF).count() == 1
    counts = ingest.metrics(ingest.incoming(rows, bodies, target, members(spark), "all", AS_OF)).first()
    assert tuple(counts) == (2, 1, 1)
    assert readers.read_posts(spark, str(tmp_path / "lists.json"), only_notices=True).count() == 1
    copied, check = ingest.migrate(target, target, ["post_id"])
    assert copied.count() == 1 and check.first()["equal"]
    table = KeyedTable(spark, str(tmp_path / "table"), schemas.POSTS, ["post_id"], 4)
    feed = stream.landed_posts(spark, str(tmp_path / "lists*"), files=1)
    step = lambda t, b: ingest.ingest(b, bodies, t, members(spark), "all", AS_OF)
    for _ in range(2):
        stream.merge_stream(feed, table, step, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r["post_id"] for r in table.rows().collect()) == [1, 2]


def test_parse(spark):
    p = posts(
        spark,
        [
            (1, "10", "오늘 방송", "<p>저녁에 봐요 여러분</p>", T(2024, 3, 10, 9), 5000), (2, "b", "x", "<p>no word here</p>", T(2024, 3, 10), 5000), (3, "c", "방송", "<p>hi</p>", T(2024, 3, 10), 5000),
            (4, "d", "내일 방송", "<p>글이 충분히 길다</p>", T(2024, 3, 9), 1000), (5, "c", "방송", "<p>글이 충분히 길다</p>", T(2024, 3, 1), 9000), (6, "e", "시작", "<p>글이 충분히 길다</p>", T(2024, 3, 9), 2000),
        ],
    )
    old = slots(spark, [(1, "wrong", 2, T(2024, 3, 1), "d", "r"), (2, "b", 77, T(2024, 3, 1), "kept", "r")])
    items = [{"date": "2024-03-11", "start_time": "20:00", "end_time": "", "description": "", "mentioned_bjs": ["Bo", "Ada", "Nobody", "Cy"]}, {"date": "2024-03-12", "description": "no start"}]
    results = spark.createDataFrame([(1, "ok", json.dumps(items)), (4, "ok", "[]"), (6, "failed", "")], schemas.PARSE_RESULT)
    found = parse.candidates(p, old, AS_OF)
    assert sorted(r["post_id"] for r in found.collect()) == [1, 4, 6]
    after = parse.parse(p, old, results, members(spark), AS_OF)
    got = {(r["post_id"], r["starts_at"]): (r["member_id"], r["description"], r["raw_text"]) for r in after.collect()}
    start = T(2024, 3, 11, 11)
    assert got == {
        (77, T(2024, 3, 1)): ("b", "kept", "r"),
        (1, start): ("10", "오늘 방송", "오늘 방송: 20:00~?"),
        (2, start): ("b", "name-10 합방: ", "합방(name-10): 20:00~?"),
        (3, start): ("c", "name-10 합방: ", "합방(name-10): 20:00~?"),
        (4, T(2024, 3, 8, 15)): ("d", "", schemas.SENTINEL),
    }
    again = parse.parse(p, after.withColumn("id", F.xxhash64("post_id", "starts_at")), results, members(spark), AS_OF)
    assert again.count() == after.count()
    assert parse.parse(p, old, results, members(spark), AS_OF, strict_reference=True).where("post_id = 6").count() == 1
    assert tuple(parse.metrics(p, old, results, AS_OF).first()) == (2, 1, 1, 1)


def test_groups_and_snapshots(spark, tmp_path):
    pad = lambda cells, width: ",".join(cells + [""] * (width - len(cells)))
    lines = ["head", pad(["", "G", "job", '"Ada, ""A"""', "s", "12abc", "3", "", "", "4", "5", "6"], 12), pad(["", "alias", "", "Bo"], 12), pad(["", "G", "j2", '"Ada, ""A"""'], 12), pad(["", "평균", "", "x"], 12), pad(["", "", "", "y"], 12)]
    (tmp_path / "stats.csv").write_text("\n".join(lines))
    stats = readers.read_stats(spark, str(tmp_path / "stats.csv"), {"alias": "H"}, {"Bo": "Beau"})
    assert {(r["group"], r["member"]): (r["job"], r["level"]) for r in stats.collect()} == {("G", 'Ada, "A"'): ("j2", None), ("H", "Beau"): (None, None)}
    rank = ["head"] + [",".join([""] * 17 + [g, "", n, v]) for g, n, v in (("G", "Cy", '"1,234"'), ("G", "Di", "none"))]
    (tmp_path / "rank.csv").write_text("\n".join(rank))
    ranking = readers.read_ranking(spark, str(tmp_path / "rank.csv"), {}, {})
    made = groups.groups(spark.createDataFrame([("G", "red", [("1", "Cy", True), ("2", "Ada, \"A\"", False)]), ("E", "blue", [])], schemas.GROUPS), stats, ranking)
    rows = {r["name"]: [(m["name"], m["job"], m["power"]) for m in r["members"]] for r in made.collect()}
    assert rows == {"G": [("Cy", None, 1234), ('Ada, "A"', "j2", None)], "E": []}
    p = posts(spark, [(1, "10", "t", "", T(2024, 1, 1), 1), (2, "10", "u", "", T(2024, 1, 2), 1), (3, "b", "v", "", T(2024, 1, 3), 1)])
    bodies = p.select("member_id", "post_id", F.lit("B").alias("body_html"))
    before, now = (groups.snapshot(x.drop("body_html"), bodies, members(spark)) for x in (p.where("post_id = 1"), p))
    assert [r["post_id"] for r in groups.feed(now).collect()] == [3, 2, 1]
    assert [r["post_id"] for r in groups.feed(now, "favorites", ["10"]).collect()] == [2, 1]
    assert groups.feed(now, "tag:blue").count() == 0
    flat = groups.listed(p.drop("body_html"), bodies, members(spark))
    assert flat.columns == groups.exploded(now).columns and groups.feed(flat).collect() == groups.feed(now).collect()
    assert groups.feed(flat, "favorites", ["10"]).collect() == groups.feed(now, "favorites", ["10"]).collect()
    assert groups.new_count(before, now).first()[0] == 1
    assert [r["tag"] for r in groups.tags(members(spark)).collect()] == ["red", "blue"]


def test_lookups_and_pages(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(10)], "post_id long, k long")
    assert [r["post_id"] for r in pg.paginate(rows, 99, 4, F.asc("post_id")).collect()] == [8, 9]
    assert [r["post_id"] for r in pg.paginate(rows, -1, 4, F.asc("post_id")).collect()] == [0, 1, 2, 3]
    assert pg.paginate(rows.where("false"), 0, 4, F.asc("post_id")).count() == 0
    assert one(spark, rel.alias_of(F.lit("x"), {"x": "y"})) == "y" and one(spark, rel.alias_of(F.lit("q"), {"x": "y"})) == "q"
    status = spark.createDataFrame([("a", True, True), ("b", False, True)], schemas.STATUS)
    asked = ",".join(["a", "b", "c"] + [f"x{i}" for i in range(60)])
    live = feeds.live_check(status, asked).orderBy("place").collect()
    assert len(live) == 50 and [r["live"] for r in live[:3]] == [True, False, False]
    with pytest.raises(ValueError):
        rel.split_group(rows, rows, "post_id", "none")


def test_table_in_ranges_of_a_key(spark):
    """A database table, here one in memory, is read in parallel ranges of its key, whole."""
    from tidewheel.sources.readers import jdbc_table

    url = "jdbc:derby:memory:ranges;create=true"
    rows = spark.range(1, 101).selectExpr("id AS K", "id * 2 AS V")
    rows.write.format("jdbc").options(url=url, dbtable="T", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    read = jdbc_table(spark, url, "T", "K", 1, 101, 4)
    assert read.rdd.getNumPartitions() == 4
    assert sorted((r["K"], r["V"]) for r in read.collect()) == [(i, 2 * i) for i in range(1, 101)]
