"""Stored tables, page indexes, landed pages, rosters, pictures and extraction on small fixtures."""

import base64
import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import text as tx
from tidewheel.functions import timeutil as tm
from tidewheel.operators import relational as rel
from tidewheel.operators.pages import PageIndex
from tidewheel.plans import catalog_stored, extract, groups, ingest, parse
from tidewheel.sources import keyed, paged, readers, schemas
from tidewheel.streaming import ingest as stream

T = dt.datetime


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def files(path):
    """Every data file below a path, and when it was written."""
    found = {}
    for folder, _, names in os.walk(path):
        found |= {os.path.join(folder, n): os.stat(os.path.join(folder, n)).st_mtime_ns for n in names if n.endswith(".parquet")}
    return found


def last(rows, batch):
    return rel.last_by(rows.unionByName(batch), ["k"], "v")


def test_writes_touch_their_buckets_only(spark, tmp_path):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k long, v int", ["k"], 8)
    assert table.rows().count() == 0 and table.sums().count() == 0
    table.replace(spark.range(100).selectExpr("id AS k", "0 AS v"))
    before = files(f"{table.path}/rows")
    touched = table.write(spark.createDataFrame([(5, 1), (5, 2), (1000, 3)], "k long, v int"), last)
    after = files(f"{table.path}/rows")
    of = lambda p: int(p.split("__bucket=")[1].split("/")[0])
    assert 1 <= len(touched) <= 2
    assert {p for p in before if of(p) not in touched} == {p for p in after if of(p) not in touched}
    assert all(before[p] == after[p] for p in before if of(p) not in touched) and not any(p in after for p in before if of(p) in touched)
    assert {(r["k"], r["v"]) for r in table.rows().collect()} == {(k, 2 if k == 5 else 0) for k in range(100)} | {(1000, 3)}
    assert not os.path.exists(f"{table.path}/aside") and table.write(spark.createDataFrame([], "k long, v int"), last) == []
    # buckets that lose all rows
    held = table.rows(touched).count()
    gone = table.write(spark.createDataFrame([(5, 9), (1000, 9)], "k long, v int"), lambda rows, batch: rows.where("false"))
    assert gone == touched and held and table.rows().count() == 101 - held and table.rows(gone).count() == 0
    assert table.sums().where(F.col("bucket").isin(gone)).count() == 0 and table.sums().agg(F.sum("rows")).first()[0] == 101 - held


def test_a_write_that_was_cut_short_is_ended(spark, tmp_path, monkeypatch):
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k long, v int", ["k"], 4)
    table.replace(spark.range(20).selectExpr("id AS k", "0 AS v"))
    real = keyed.KeyedTable.recover
    calls = []

    def lost(self):
        calls.append(1)
        if len(calls) > 2 and self._has("aside/_SUCCESS"):
            raise RuntimeError("lost")
        real(self)

    monkeypatch.setattr(keyed.KeyedTable, "recover", lost)
    with pytest.raises(RuntimeError):
        table.write(spark.createDataFrame([(k, 7) for k in range(10)], "k long, v int"), last)
    monkeypatch.setattr(keyed.KeyedTable, "recover", real)
    again = keyed.KeyedTable(spark, table.path, "k long, v int", ["k"], 4)
    assert {(r["k"], r["v"]) for r in again.rows().collect()} == {(k, 7 if k < 10 else 0) for k in range(20)}
    assert again.sums().agg(F.sum("rows")).first()[0] == 20


def test_stream_in_three_batches(spark, tmp_path):
    seen = []

    def step(rows, batch):
        seen.append(1)
        return last(rows, batch)

    rows = lambda low, v: spark.range(low, low + 50).selectExpr("id AS k", f"{v} AS v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for low, v in ((0, 1), (25, 2), (50, 3)):
        rows(low, v)
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), "k long, v int", ["k"], 4)
    feed = spark.readStream.schema("k long, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: stream.merge_stream(feed, table, step, str(tmp_path / "c")).awaitTermination()
    run()
    assert len(seen) == 3
    want = {k: 3 if k >= 50 else 2 if k >= 25 else 1 for k in range(100)}
    assert {r["k"]: r["v"] for r in table.rows().collect()} == want
    run()
    assert len(seen) == 3
    rows(0, 9)
    run()
    assert len(seen) == 4 and {r["k"]: r["v"] for r in table.rows().collect()} == {k: 9 if k < 50 else want[k] for k in want}


@pytest.mark.parametrize("name, batches", [("keyed_writes", 4), ("unseen_posts", 5)])
def test_landings_have_the_files_of_their_scan(spark, tmp_path, monkeypatch, name, batches):
    """Each landing is one micro-batch, and as many tasks write and read it as read the orders."""
    monkeypatch.setattr(catalog_stored, "shared_folder", lambda spark, name: str(tmp_path / "shared"))
    orders = "id as o_orderkey, id % 7 as o_custkey, 'F' as o_orderstatus, 1.0D as o_totalprice, timestamp_ntz'2024-01-01' as o_orderdate, 'p' as o_orderpriority"
    for part in range(4):
        spark.range(part * 40, part * 40 + 40).selectExpr(*orders.split(", ")).coalesce(1).write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    assert getattr(catalog_stored, name)(spark, str(tmp_path)).count() == 160
    assert sorted(x for x in os.listdir(tmp_path / "shared" / "checkpoint" / "commits") if not x.startswith(".")) == [str(i) for i in range(batches)]
    assert len(files(tmp_path / "shared" / "landed")) == 4 * batches


def test_unseen_keys_of_a_stream(spark, tmp_path):
    def land(keys):
        spark.createDataFrame([(k,) for k in keys], "k long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    for keys in ([1, 2, 2], [2, 3], [1, 3], [4, 1]):
        land(keys)
    feed = spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: stream.unseen(feed, ["k"], str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    run()
    land([4, 5, 1])
    run()
    assert {(r["k"], r["batch"]) for r in stream.first_seen(spark, str(tmp_path / "out"), "k long").collect()} >= {(1, 0), (2, 0), (3, 1), (4, 3)}
    assert sorted(r["k"] for r in stream.first_seen(spark, str(tmp_path / "out"), "k long").collect()) == [1, 2, 3, 4, 5]


def test_refresh_reads_differing_buckets_only(spark, tmp_path):
    rows = [(f"m{i}", n) for i in range(40) for n in range(5)]
    more = [("m7", 100), ("m7", 101), ("m9", 102), ("stranger", 1)]
    old = groups.stored_snapshot(spark.createDataFrame(rows, "member_id string, post_id long"), str(tmp_path / "a"), 16)
    new = groups.stored_snapshot(spark.createDataFrame(rows + more, "member_id string, post_id long"), str(tmp_path / "b"), 16)
    buckets = keyed.differing(old, new)
    assert 1 <= len(buckets) <= 3 and keyed.differing(old, old) == []
    assert sorted(tuple(r) for r in groups.refreshed(old, new).collect()) == [("m7", 100), ("m7", 101), ("m9", 102)]
    assert new.rows(buckets).count() < 70 < new.rows().count()
    plan = groups.refreshed(old, new)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters" in plan and "__bucket" in plan
    with pytest.raises(ValueError):
        keyed.differing(old, groups.stored_snapshot(spark.createDataFrame(rows, "member_id string, post_id long"), str(tmp_path / "c"), 8))


def test_pages(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 7) for i in range(103)], "n long, k long")
    want = [r["n"] for r in rows.orderBy("k", F.desc("n")).collect()]
    index = PageIndex.build(rows.repartition(5), F.asc("k"), F.desc("n"), path=str(tmp_path / "p"))
    assert index.count() == 103 and PageIndex(spark, str(tmp_path / "p")).count() == 103
    for page in (-1, 0, 3, 24, 25, 99):
        at = min(max(page, 0), 25) * 4
        assert [r["n"] for r in index.page(page, 4).collect()] == want[at : at + 4]
    assert [r["n"] for r in PageIndex(spark, str(tmp_path / "p")).slice(90, 100).collect()] == want[90:]
    assert [r["n"] for r in index.placed().orderBy("place").collect()] == want
    plan = index.page(20, 4)._jdf.queryExecution().toString()
    assert "Offset" not in plan and "__range" in plan
    empty = PageIndex.build(rows.where("false"), F.asc("k"))
    assert empty.count() == 0 and empty.page(3, 4).collect() == [] and empty.placed().collect() == []


def test_rosters(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"b": {"name": "B"}, "10": {"name": "ten", "tag": "t"}, "2": {}, "07": {"name": "seven"}, "b": {"name": "last", "tag": "x"}, "4294967295": {"name": "big"}, "4294967294": {"name": "top"}, "z": "no object"}\nnot json\n{"0": {"name": "zero"}, "a": {"name": null}}\n')
    popular = spark.createDataFrame([("2",), ("a",), ("2",)], "member_id string")
    got = [tuple(r) for r in readers.read_roster(spark, str(tmp_path / "r.json"), popular).orderBy("ordinal").collect()]
    assert got == [
        ("0", "zero", None, False, 1), ("2", None, None, True, 2), ("10", "ten", "t", False, 3), ("4294967294", "top", None, False, 4), ("b", "last", "x", False, 5), ("07", "seven", None, False, 6),
        ("4294967295", "big", None, False, 7), ("z", None, None, False, 8), ("a", None, None, True, 9),
    ]
    (tmp_path / "w.json").write_text(json.dumps({"x": {"name": "X"}, "1": {"name": "one"}}, indent=2))
    assert [r["member_id"] for r in readers.read_roster(spark, str(tmp_path / "w.json"), whole=True).orderBy("ordinal").collect()] == ["1", "x"]


def test_paged_source(spark, tmp_path):
    rows = spark.range(1, 1001).selectExpr("id AS k", "id * 2 AS v").where("k % 10 <> 3")
    path = str(tmp_path / "pages")
    paged.land(rows, "k", path, width=300, page=50)
    read = lambda **how: sorted(tuple(r) for r in paged.read_pages(spark, path, "k long, v long", "k", 50, **how).collect())
    want = sorted(tuple(r) for r in rows.collect())
    assert read() == want and paged.read_pages(spark, path, "k long, v long", "k", 50).rdd.getNumPartitions() == 4
    for after in (0, 49, 299, 300, 555, 1000, 5000):
        assert read(after=after) == [r for r in want if r[0] > after]
    # What lies behind a short page is of an older, longer dump.
    spark.createDataFrame([(299, 0)], "k long, v long").coalesce(1).write.parquet(f"{path}/range=0/first=299")
    short = len([r for r in want if r[0] < 300]) % 50
    assert short and read() == want
    assert sorted(r["v"] for r in paged.read_pages(spark, str(tmp_path / "none"), "k long, v long", "k").collect()) == []


def test_paged_stream_goes_on(spark, tmp_path):
    path = str(tmp_path / "pages")
    got = []
    sink = lambda batch, n: got.append(sorted(r["k"] for r in batch.collect()))
    for low in (0, 100, 200):
        paged.land(spark.range(low, low + 60).selectExpr("id AS k", "id AS v"), "k", f"{path}-{low}", width=100, page=25)
        os.makedirs(path, exist_ok=True)
        os.rename(f"{path}-{low}/range={low // 100}", f"{path}/range={low // 100}")
        feed = paged.stream_pages(spark, path, "k long, v long", "k", 25)
        feed.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [x for x in got if x] == [list(range(low, low + 60)) for low in (0, 100, 200)]


def test_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.PNG", b"\x00\x01"), ("b", b"jpg"), ("c.gif", b"")):
        (tmp_path / "in" / name).write_bytes(data)
    images = readers.read_images(spark, str(tmp_path / "in"))
    assert {r["name"]: (r["media"], base64.b64decode(r["data"])) for r in images.collect()} == {"a.PNG": ("image/png", b"\x00\x01"), "b": ("image/jpeg", b"jpg")}
    rows = spark.createDataFrame([(1, ["http://x/b", "http://x/gone", "http://x/a.PNG", "http://x/b"]), (2, []), (3, None), (4, ["http://x/c.gif"])], "post_id long, images array<string>")
    got = {r["post_id"]: [x["media"] for x in r["parts"]] for r in readers.images_of(rows, images, F.substring_index("url", "/", -1)).collect()}
    assert got == {1: ["image/jpeg", "image/png", "image/jpeg"], 2: [], 3: [], 4: []}


def test_packs(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for name, data in (("a.PNG", b"\x00\x01" * 100), ("b", b"jpg"), ("c.gif", b"")):
        (tmp_path / "in" / name).write_bytes(data)
    loose, packs = readers.read_images(spark, str(tmp_path / "in")), str(tmp_path / "packs")
    readers.write_packs(loose, packs)
    readers.write_packs(spark.createDataFrame([("d.gif", ""), ("e.gif", None), ("f.gif", "AA==")], "name string, data string"), packs)
    assert sorted(tuple(r) for r in readers.read_packs(spark, packs).collect()) == sorted([*[tuple(r) for r in loose.collect()], ("f.gif", "image/gif", "AA==")])
    # files do not grow with the pictures
    for n in (30, 300):
        spark.range(n).selectExpr("id AS doc_id", "concat('a\nb', id) AS text").coalesce(2).write.parquet(str(tmp_path / f"{n}" / "documents.parquet"))
    landed = []
    for n in (30, 300):
        monkeypatch.setattr(catalog_stored, "shared_folder", lambda spark, name, n=n: str(tmp_path / f"{name}-{n}"))
        met = catalog_stored.landed_images(spark, str(tmp_path / f"{n}")).collect()
        assert {r["post_id"]: (r["n"], base64.b64decode(r["data"])) for r in met} == {k: (1 + (k % 3 > 0) + k % 2, f"a\nb{k}\n".encode() if k % 3 else b"common\n") for k in range(n)}
        landed.append(sum(not x.startswith((".", "_")) for _, _, names in os.walk(tmp_path / f"pictures-{n}") for x in names))
    assert max(landed) <= 6


CASES = [
    # posted on Wednesday 2024-03-13
    ("20:00", "방송", "오늘 8시", [("2024-03-13", "20:00", None)]),
    ("03:00", "방송", "내일 저녁 7시 30분", [("2024-03-13", "19:30", None)]),
    ("06:00", "방송", "내일 7시반", [("2024-03-14", "19:30", None)]),
    ("12:00", "금일 방송", "새벽 2시", [("2024-03-13", "02:00", None)]),
    ("12:00", "t", "수요일 오전 11시, 목요일 12시, 화요일 밤 12시", [("2024-03-13", "11:00", None), ("2024-03-14", "12:00", None), ("2024-03-20", "00:00", None)]),
    ("12:00", "t", "3/15 20:30~23:00", [("2024-03-15", "20:30", "23:00")]),
    ("12:00", "t", "2024-12-31 24시", [("2025-01-01", "00:00", None)]),
    ("12:00", "t", "1월 2일 오전 9시부터 10시", [("2024-01-02", "09:00", "10:00")]),
    ("12:00", "t", "밤 11시~1시", [("2024-03-13", "23:00", "01:00")]),
    ("12:00", "t", "2월 30일 오후 1 시 5 분", [("2024-03-13", "13:05", None)]),
    ("12:34", "t", "바로 킵니다", [("2024-03-13", "12:34", None)]),
    ("12:34", "t", "곧 알려드릴게요", [("2024-03-13", None, None)]),
    ("12:34", "t", "오늘 8시 휴방", []),
    ("12:34", "t", "2시간 뒤 99:99 1:234", [("2024-03-13", None, None)]),
    ("12:34", None, None, [("2024-03-13", None, None)]),
]


def test_extraction(spark):
    rows = spark.createDataFrame([(i, T.fromisoformat(f"2024-03-13 {h}"), title, text) for i, (h, title, text, _) in enumerate(CASES)], "post_id int, posted_at timestamp_ntz, title string, text string")
    read = rows.select("post_id", extract.items(F.col("title"), F.col("text"), F.col("posted_at"), ["Ada"]).alias("x"))
    got = {r["post_id"]: [(i["date"], i["start_time"], i["end_time"]) for i in r["x"]] for r in read.collect()}
    assert got == {i: case[3] for i, case in enumerate(CASES)}
    told = rows.where("post_id = 0").select(extract.items(F.lit("합방 " + "x" * 30), F.lit("오늘 8시 Ada와 Bo"), F.col("posted_at"), ["Ada", "Bo", "Cy"]).alias("x")).first()["x"][0]
    assert (told["description"], told["mentioned_bjs"]) == ("합방 " + "x" * 17, ["Ada", "Bo"])
    nan = extract.results(rows, []).where("post_id = 12").first()
    assert (nan["status"], nan["json"]) == ("ok", "[]")


def test_job_with_rules_and_attempts(spark):
    """Candidates read by rules give the job's results; a post that failed before waits."""
    post = lambda n, m, title, body: (n, m, f"n-{m}", "", n, title, body, T(2024, 3, 10, 9), 5000, False, T(2024, 3, 10))
    p = spark.createDataFrame([post(1, "a", "오늘 합방", "<p>8시 Bo 랑 방송해요</p>"), post(2, "b", "공지", "<p>방송 얘기는 없습니다</p>"), post(3, "c", "내일 방송", "<p>오전 11시부터 1시까지</p>")], schemas.POSTS)
    roster = readers.roster(spark, [("a", "Ada", None, True, 1), ("b", "Bo", None, True, 2), ("c", "Cy", None, True, 3)])
    none = spark.createDataFrame([], schemas.SCHEDULES)
    waiting = spark.createDataFrame([(3, 1, T(2024, 3, 10, 12, 5))], schemas.ATTEMPTS)
    as_of = "2024-03-10 12:00:00"
    found = parse.candidates(p, none, as_of, attempts=waiting)
    after = parse.parse(p, none, extract.results(found, ["Ada", "Bo", "Cy"]), roster, as_of, attempts=waiting)
    got = {(r["post_id"], r["starts_at"]): (r["member_id"], r["raw_text"]) for r in after.collect()}
    assert got == {(1, T(2024, 3, 10, 11)): ("a", "오늘 합방: 20:00~?"), (2, T(2024, 3, 10, 11)): ("b", "합방(n-a): 20:00~?"), (2, T(2024, 3, 9, 15)): ("b", schemas.SENTINEL)}
    later = parse.candidates(p, after, "2024-03-10 12:05:00", attempts=waiting)
    assert [r["post_id"] for r in later.collect()] == [3]
    read = extract.results(later, []).select(extract.F.from_json("json", tx.PARSED)[0].alias("x")).first()["x"]
    assert (read["date"], read["start_time"], read["end_time"]) == ("2024-03-11", "11:00", "13:00")


def test_attempts(spark):
    none = spark.createDataFrame([], schemas.ATTEMPTS)
    results = lambda *rows: spark.createDataFrame([(p, s, "") for p, s in rows], schemas.PARSE_RESULT)
    at = lambda m: f"2024-01-01 10:{m:02}:00"
    shown = lambda df: {r["post_id"]: (r["tries"], r["next_at"].strftime("%H:%M")) for r in df.collect()}
    first = parse.attempted(none, results((1, "failed"), (2, None), (3, "ok"), (3, "failed"), (None, "failed")), at(0))
    assert shown(first) == {1: (1, "10:05"), 2: (1, "10:05")}
    second = parse.attempted(first, results((1, "failed")), at(5))
    assert shown(second) == {1: (2, "10:15"), 2: (1, "10:05")}
    third = parse.attempted(second, results((1, "ok"), (2, "failed")), at(20), most=7)
    assert shown(third) == {2: (2, "10:27")}
    posts = spark.createDataFrame([(1,), (2,), (3,)], "post_id long")
    assert sorted(r["post_id"] for r in parse.due(posts, second, at(5)).collect()) == [2, 3]
    long = parse.attempted(spark.createDataFrame([(9, 60, None)], schemas.ATTEMPTS), results((9, "failed")), at(0))
    assert long.first()["next_at"] == T(2024, 1, 2, 10, 0)


def test_counters_of_a_write(spark, tmp_path):
    full = [(n, "m", "name", "", n, "t", None, T(2024, 1, n), 1, False, T(2024, 1, 1)) for n in (1, 2)]
    table = keyed.KeyedTable(spark, str(tmp_path / "t"), schemas.POSTS, ["post_id"], 4)
    table.replace(spark.createDataFrame(full, schemas.POSTS))
    fetched = spark.createDataFrame([("m", 2, "new", T(2024, 1, 2), 5, True), ("m", 3, "third", T(2024, 1, 3), 6, False), ("x", 4, "stranger", T(2024, 1, 3), 6, False)], "member_id string, post_id long, title string, posted_at timestamp_ntz, views int, is_pinned boolean")
    bodies = spark.createDataFrame([("m", 3, "body")], "member_id string, post_id long, body_html string")
    roster = readers.roster(spark, [("m", "Em", None, True, 1)])
    assert ingest.run(table, fetched, bodies, roster, "all", "2024-02-01") == {"upserted": 2, "new": 1, "with_body": 1}
    assert {r["post_id"]: (r["title"], r["body_html"]) for r in table.rows().collect()} == {1: ("t", None), 2: ("new", None), 3: ("third", "body")}
    assert ingest.run(table, fetched, bodies, roster, "all", "2024-02-01") == {"upserted": 2, "new": 0, "with_body": 0}


@pytest.mark.parametrize("blank", [" ", "　", "﻿", " ", "\t", "\x0b"])
def test_blanks_of_all_kinds(spark, blank):
    s = lambda x: one(spark, tx.sanitize_html(F.lit(x)))
    assert s(f"<img{blank}onerror=alert(1)>") == "<img>" and s(f"<b{blank}onclick{blank}={blank}'x'{blank}id=1>") == f"<b{blank}id=1>"
    assert s(f'<a href{blank}={blank}"javascript:x">') == '<a href="#">' and s(f"<img src{blank}='data:text/html,x'>") == '<img src="">'
    assert s(f"expression{blank}(x)") == "" and s(f"<p style{blank}={blank}'a:url{blank}(x)'>") == "<p >"
    assert [one(spark, f(F.lit(f"{blank}{blank}12ab"))) for f in (tx.to_int, tx.grouped_int, tm.day_offset)] == [12, 12, 12]
    assert one(spark, tx.strip_html(F.lit(f"a{blank}{blank}b"))) == "a b"
