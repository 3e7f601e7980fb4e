"""Queries of the jobs, feeds, keyed writes and landed files, over the provided tables as in `catalog`; importing it adds them there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import timeutil as tm
from ..operators import merge as mg
from ..operators import relational as rel
from ..sources import readers
from ..sources.paths import shared_folder
from ..sources.schemas import BY_HAND, CATEGORY, SENTINEL
from . import catalog as c
from . import feeds, ingest
from . import groups as gr
from . import parse as pr
from .catalog import query


# Landed files: the tables are written as the files that the readers take.


def _landed(df: DataFrame, name: str, kind: str = "json", **options) -> str:
    path = shared_folder(df.sparkSession, name)
    df.write.options(**options).format(kind).save(path)
    return path


def _lists(spark: SparkSession, d: str) -> str:
    """Lists of posts by member; every seventh member's has no boards."""
    o = c._read(spark, d, "orders")
    board = F.struct(
        F.col("o_orderkey").alias("title_no"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("title_name"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("reg_date"),
        F.when(F.col("o_orderkey") % 3 > 0, F.struct(F.floor("o_totalprice").cast("int").alias("read_cnt"))).alias("count"), F.when(F.col("o_orderstatus") == "F", True).alias("is_pin"),
        (F.col("o_orderkey") % 2 == 0).alias("is_notice"),
    )
    lists = o.groupBy(F.col("o_custkey").cast("string").alias("member_id")).agg(F.collect_list(board).alias("boards"))
    return _landed(lists.withColumn("boards", F.when(F.col("member_id").cast("long") % 7 > 0, F.col("boards"))), "lists")


_LANDED = "SELECT o_custkey::VARCHAR AS member_id, o_orderkey AS post_id, coalesce(nullif(o_orderpriority, '1-URGENT'), '') AS title, o_orderdate AS posted_at, CASE WHEN o_orderkey % 3 > 0 THEN floor(o_totalprice)::INT ELSE 0 END AS views, o_orderstatus = 'F' AS is_pinned FROM orders WHERE o_custkey % 7 > 0"


@query(_LANDED)
def landed_posts(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_posts(spark, _lists(spark, d))


@query(_LANDED + " AND o_orderkey % 2 = 0")
def landed_notices(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_posts(spark, _lists(spark, d), only_notices=True)


@query("SELECT source AS member_id, doc_id AS post_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS body_html FROM documents")
def landed_bodies(spark: SparkSession, d: str) -> DataFrame:
    docs = c._read(spark, d, "documents")
    rows = docs.select(F.col("source").alias("member_id"), F.col("doc_id").alias("title_no"), F.when(F.col("doc_id") % 4 > 0, F.struct(F.col("text").alias("content"))).alias("content"))
    return readers.read_bodies(spark, _landed(rows, "bodies"))


@query(f"""SELECT doc_id AS post_id, CASE WHEN doc_id % 5 = 1 THEN '{SENTINEL}' ELSE source || ': 20:30~?' END AS raw_text FROM documents WHERE doc_id % 3 > 0""")
def landed_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of which some failed and some are malformed; the latter count as read."""
    docs = c._read(spark, d, "documents")
    good = F.lit('[{"date":"2024-01-14","start_time":"20:30"}]')
    rows = docs.select(F.col("doc_id").alias("post_id"), F.when(F.col("doc_id") % 3 == 0, "error").otherwise("ok").alias("status"), F.when(F.col("doc_id") % 5 == 1, F.substring(good, 1, 20)).otherwise(good).alias("json"))
    found = docs.select(
        F.col("doc_id").alias("post_id"), F.col("source").alias("member_id"), F.col("source").alias("member_name"), F.col("source").alias("title"),
        F.lit("2024-01-15 00:00:00").cast("timestamp_ntz").alias("posted_at"), tm.local_date(c.AS_OF).alias("today"),
    )
    return pr.own_rows(pr.items(found, readers.read_parse_results(spark, _landed(rows, "results"))), c.AS_OF).select("post_id", "raw_text")


def _grid(spark: SparkSession, d: str, cells: dict[int, F.Column], width: int) -> str:
    """Three CSV files of part's rows, each with a first line of names."""
    part = c._read(spark, d, "part")
    line = [cells.get(i, F.lit("x")).cast("string").alias(f"h{i}") for i in range(width)]
    return _landed(part.repartition(3, "p_partkey").select(*line), "grid", "csv", header=True, escape='"')


@query("""SELECT CASE WHEN p_brand = 'Brand#11' THEN 'first' ELSE p_brand END AS "group", p_partkey::VARCHAR AS member, p_type || ', "own"' AS job, NULL::VARCHAR AS skill, p_size AS level, p_partkey::INT AS weapon, NULL::INT AS armor, 0 AS pants, 7 AS boots
FROM part WHERE p_brand <> 'Brand#12' AND p_partkey % 10 > 0""")
def stats_grid(spark: SparkSession, d: str) -> DataFrame:
    cells = {
        1: F.col("p_brand"), 2: F.concat("p_type", F.lit(', "own"')), 3: F.when(F.col("p_partkey") % 10 > 0, F.concat(F.lit("m"), F.col("p_partkey"))).otherwise(""), 4: F.lit(""), 5: F.concat("p_size", F.lit("lv")),
        6: F.col("p_partkey"), 9: F.lit("none"), 10: F.lit("0"), 11: F.lit("7"),
    }
    read = readers.read_stats(spark, _grid(spark, d, cells, 12), {"Brand#11": "first"}, {}, average="Brand#12")
    return read.withColumn("member", F.replace("member", F.lit("m"), F.lit("")))


@query("""SELECT CASE WHEN p_brand = 'Brand#11' THEN 'first' ELSE p_brand END AS "group", CASE WHEN p_partkey = 7 THEN 'seven' ELSE p_partkey::VARCHAR END AS member, (p_partkey * 1000)::INT AS power FROM part WHERE p_size > 5""")
def ranking_grid(spark: SparkSession, d: str) -> DataFrame:
    cells = {17: F.col("p_brand"), 19: F.col("p_partkey"), 20: F.when(F.col("p_size") > 5, F.format_number(F.col("p_partkey") * 1000, 0)).otherwise("-")}
    return readers.read_ranking(spark, _grid(spark, d, cells, 21), {"Brand#11": "first"}, {"7": "seven"})


# Jobs.


def _incoming(spark: SparkSession, d: str, group: str = "all") -> DataFrame:
    """Posts as fetched, of members on the roster; those of even numbers are known, and every fourth has a body."""
    p = c.posts(spark, d)
    bodies = p.where("post_id % 4 = 0").select("member_id", "post_id", F.concat(F.lit("b"), F.col("post_id")).alias("body_html"))
    return ingest.incoming(p.select("member_id", "post_id", "title", "posted_at", "views", "is_pinned"), bodies, p.where("post_id % 3 = 0"), c.members(spark, d), group, c.AS_OF)


_INCOMING = f"""(SELECT p.member_id, coalesce(nullif(m.name, ''), p.member_id) AS member_name, '' AS member_tag, p.post_id, p.title, CASE WHEN p.post_id % 3 > 0 THEN CASE WHEN p.post_id % 4 = 0 THEN 'b' || p.post_id ELSE '' END END AS body_html,
p.posted_at, trunc(p.views)::INT AS views, p.is_pinned, TIMESTAMP '{c.AS_OF}' AS updated_at, p.post_id % 3 > 0 AS is_new, m.is_popular FROM {c._POSTS} p JOIN {c._MEMBERS} m USING (member_id))"""


@query(f"SELECT * EXCLUDE (is_popular) FROM {_INCOMING} WHERE is_popular")
def ingest_rows(spark: SparkSession, d: str) -> DataFrame:
    return _incoming(spark, d, "popular")


@query(f"SELECT count(*) AS upserted, count(*) FILTER (is_new) AS new, count(*) FILTER (body_html <> '') AS with_body FROM {_INCOMING}")
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    return ingest.metrics(_incoming(spark, d))


@query(f"SELECT post_id, member_id, title, body_html FROM {_INCOMING} WHERE is_new UNION ALL SELECT post_id, member_id, title, 'old' FROM {c._POSTS} WHERE post_id % 3 = 0")
def ingest_again(spark: SparkSession, d: str) -> DataFrame:
    """The job, run twice on the same input."""
    p = c.posts(spark, d).withColumn("views", F.col("views").cast("int"))
    target, fetched = p.where("post_id % 3 = 0").withColumn("body_html", F.lit("old")), p.select("member_id", "post_id", "title", "posted_at", "views", "is_pinned")
    bodies = p.where("post_id % 4 = 0").select("member_id", "post_id", F.concat(F.lit("b"), F.col("post_id")).alias("body_html"))
    for _ in range(2):
        target = ingest.ingest(fetched, bodies, target, c.members(spark, d), "all", c.AS_OF)
    return target.select("post_id", "member_id", "title", "body_html")


@query("SELECT o_orderkey AS post_id, 'x' AS title FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1")
def migrated(spark: SparkSession, d: str) -> DataFrame:
    p = c.posts(spark, d).select("post_id", "title")
    return ingest.migrate(p, p.where("post_id % 2 = 0").withColumn("title", F.lit("x")), ["post_id"])[0]


def _docs_as_posts(spark: SparkSession, d: str) -> DataFrame:
    return c._read(spark, d, "documents").select(
        "doc_id", F.col("doc_id").alias("post_id"), F.col("source").alias("member_id"), F.concat(F.lit("n"), F.col("source")).alias("member_name"), F.col("lang").alias("title"), F.col("text").alias("body_html"),
        (F.lit("2024-01-15 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), (F.col("doc_id") % 9000).cast("int"))).alias("posted_at"), F.col("n_chars").alias("views"),
    )


_DOCS = "(SELECT doc_id AS post_id, source AS member_id, 'n' || source AS member_name, lang AS title, text, TIMESTAMP '2024-01-15 00:00:00' - to_minutes(doc_id % 9000) AS posted_at, n_chars AS views FROM documents)"
_STRIPPED = c.SQL["strip_html"].split(" AS text FROM")[0].removeprefix("SELECT page_id, ").replace("html", "text")


@query(f"""SELECT post_id, member_id, member_name, title, text, 0 AS n_images, posted_at, DATE '2024-01-15' AS today FROM (
SELECT post_id, member_id, member_name, title, {_STRIPPED} AS text, posted_at FROM (SELECT * FROM {_DOCS} WHERE posted_at >= TIMESTAMP '{c.AS_OF}' - INTERVAL 3 DAY AND views >= 1000 ORDER BY posted_at DESC, post_id DESC LIMIT 300)
WHERE post_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity < 10)) WHERE length(text) >= 5 AND (contains(title || ' ' || text, 'License') OR contains(title || ' ' || text, 'and'))""")
def parse_candidates(spark: SparkSession, d: str) -> DataFrame:
    read = c._read(spark, d, "lineitem").where("l_quantity < 10").select(F.col("l_orderkey").alias("post_id"))
    found = pr.candidates(_docs_as_posts(spark, d), read, c.AS_OF, words=["License", "and"])
    return found.withColumn("n_images", F.size("images")).drop("images")


def _results(docs: DataFrame) -> DataFrame:
    json = F.concat(F.lit('[{"date":"2024-01-16","start_time":"21:00","end_time":"'), F.when(F.col("post_id") % 2 == 0, "23:00").otherwise(""), F.lit('","description":"go","mentioned_bjs":["'), F.col("title"), F.lit('","","nobody"]}]'))
    return docs.select("post_id", F.lit("ok").alias("status"), json.alias("json"))


def _mentions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items that mention members by name, the posts, and a roster on which a name stands twice."""
    docs = _docs_as_posts(spark, d)
    names = docs.groupBy(F.col("title").alias("name")).agg(F.min("member_id").alias("member_id"), F.max("member_id").alias("last"))
    roster = names.select("name", "member_id", F.lit(1).alias("ordinal")).unionByName(names.select("name", F.col("last").alias("member_id"), F.lit(2).alias("ordinal")))
    return pr.items(docs.withColumn("today", tm.local_date(c.AS_OF)), _results(docs)), docs, roster


_SHARED = f"""SELECT r.member_id, p.title AS member_name, l.post_id, TIMESTAMP '2024-01-16 12:00:00' AS starts_at, CASE WHEN p.post_id % 2 = 0 THEN TIMESTAMP '2024-01-16 14:00:00' END AS ends_at, p.member_name || ' {pr.JOINT}: go' AS description,
'{pr.JOINT}(' || p.member_name || '): 21:00~' || CASE WHEN p.post_id % 2 = 0 THEN '23:00' ELSE '?' END AS raw_text
FROM {_DOCS} p JOIN (SELECT lang AS name, min(source) AS member_id FROM documents GROUP BY 1) r ON r.name = p.title JOIN (SELECT member_id, max_by(post_id, (posted_at, post_id)) AS post_id FROM {_DOCS} WHERE posted_at >= TIMESTAMP '{c.AS_OF}' - INTERVAL 3 DAY GROUP BY 1) l ON l.member_id = r.member_id
WHERE r.member_id <> p.member_id"""


@query(_SHARED)
def shared_schedules(spark: SparkSession, d: str) -> DataFrame:
    return pr.shared_rows(*_mentions(spark, d), c.AS_OF).drop("parsed_at", "__order")


@query(f"""SELECT member_id, post_id, raw_text FROM ({_SHARED}) UNION ALL SELECT member_id, post_id, title || ': 21:00~' || CASE WHEN post_id % 2 = 0 THEN '23:00' ELSE '?' END FROM {_DOCS}""")
def own_and_shared(spark: SparkSession, d: str) -> DataFrame:
    read, posts, roster = _mentions(spark, d)
    return pr.own_rows(read, c.AS_OF).unionByName(pr.shared_rows(read, posts, roster, c.AS_OF)).select("member_id", "post_id", "raw_text")


# Keyed writes.


def _slot_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = rel.first_by(c.slots(spark, d), ["post_id", "starts_at"], F.asc("id"))
    return s.where("id % 3 < 2"), s.where("id % 3 > 0").withColumns({"member_id": F.lit("other"), "description": F.lit("new")})


def _slot_sql(member: str) -> str:
    one = f"(SELECT * FROM {c._SLOTS} QUALIFY row_number() OVER (PARTITION BY post_id, starts_at ORDER BY id) = 1)"
    return f"SELECT id, post_id, starts_at, {member} AS member_id, CASE WHEN id % 3 > 0 THEN 'new' ELSE description END AS description FROM {one}"


@query(_slot_sql("CASE WHEN id % 3 = 2 THEN 'other' ELSE member_id END"))
def upsert_slots(spark: SparkSession, d: str) -> DataFrame:
    return mg.upsert_schedules(*_slot_tables(spark, d)).select("id", "post_id", "starts_at", "member_id", "description")


@query(_slot_sql("CASE WHEN id % 3 > 0 THEN 'other' ELSE member_id END"))
def upsert_slots_of_members(spark: SparkSession, d: str) -> DataFrame:
    return mg.upsert_schedules(*_slot_tables(spark, d), overwrite_member=True).select("id", "post_id", "starts_at", "member_id", "description")


@query(f"""WITH s AS (SELECT post_id, title, views, k FROM {c._POSTS}, (VALUES (0), (1), (2)) t(k) WHERE k <= post_id % 3)
SELECT post_id, max_by(title || k, (CASE WHEN k = 1 THEN 0 ELSE 1 END, k)) AS title, coalesce(max('body1') FILTER (k = 1), 'old') AS body_html FROM s GROUP BY post_id""")
def upsert_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Several rows of a post in one fetch, of which one has a body: rows without one come after it."""
    p = c.posts(spark, d).withColumn("body_html", F.lit("old"))
    k = F.explode(F.sequence(F.lit(0), (F.col("post_id") % 3).cast("int"))).alias("k")
    source = p.select("*", k).withColumns({"title": F.concat("title", F.col("k")), "body_html": F.when(F.col("k") == 1, "body1").otherwise("")})
    return mg.upsert_posts(p, source, "k").select("post_id", "title", "body_html")


@query(f"""SELECT o_orderpriority AS title, 'c' AS content, '{CATEGORY}' AS category, o_orderdate AS created_at FROM orders WHERE o_orderkey <> 2 UNION ALL SELECT 'hello', 'text', '{CATEGORY}', TIMESTAMP '{c.AS_OF}'""")
def edited_updates(spark: SparkSession, d: str) -> DataFrame:
    rows = c.posts(spark, d).select("id", "title", F.lit("c").alias("content"), F.lit(CATEGORY).alias("category"), F.col("posted_at").alias("created_at"))
    return feeds.Admin.delete_update(feeds.Admin.add_update(rows, "hello", "text", c.AS_OF), 2).drop("id")


@query(f"""SELECT post_id, starts_at, CASE WHEN id = (SELECT max(id) FROM {c._SLOTS}) THEN 'edited' ELSE description END AS description, raw_text FROM {c._SLOTS} WHERE id <> (SELECT min(id) FROM {c._SLOTS})
UNION ALL SELECT epoch_ms(TIMESTAMP '{c.AS_OF}'), TIMESTAMP '2024-01-16 10:00:00', 'd', '{BY_HAND}'""")
def administered_slots(spark: SparkSession, d: str) -> DataFrame:
    """A schedule is added by hand, one is changed and one is deleted."""
    s = c.slots(spark, d).withColumn("raw_text", F.when(F.col("raw_text") == SENTINEL, "none").otherwise(F.col("raw_text")))
    low, high = s.agg(F.min("id"), F.max("id")).first()
    added = feeds.Admin.add_schedule(s, "by hand", "2024-01-16 10:00:00", c.AS_OF, description="d")
    return feeds.Admin.delete_schedule(feeds.Admin.edit_schedule(added, high, description="edited"), low).select("post_id", "starts_at", "description", "raw_text")


@query("SELECT o_orderkey AS post_id FROM orders WHERE o_orderkey <> 100")
def administered_posts(spark: SparkSession, d: str) -> DataFrame:
    return feeds.Admin.delete_notice(c.posts(spark, d), 100).select("post_id")


@query(f"SELECT event_id AS id, event_type AS subject, 'b' AS body, ts AS created_at FROM events UNION ALL SELECT NULL, 'new', 'text', TIMESTAMP '{c.AS_OF}'")
def added_feedback(spark: SparkSession, d: str) -> DataFrame:
    rows = c._read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("subject"), F.lit("b").alias("body"), F.col("ts").alias("created_at"))
    return feeds.add_feedback(rows, "new", "text", c.AS_OF)


# Feeds and small functions.


@query(f"SELECT '1998-01-01' AS date, '목' AS day_name, count(*) AS n, min_by(post_id, (start, post_id)) AS first, sum(views) AS views FROM ({c.SQL['hot_list'].replace('1998-12-31', '1998-01-01')})")
def day_of_slots(spark: SparkSession, d: str) -> DataFrame:
    rows = feeds.hot_notices(c.slots(spark, d), c.posts(spark, d), "1998-01-01 00:00:00", least=100_000)
    made = feeds.day_response(rows, "1998-01-01 00:00:00")
    views = F.aggregate("slots", F.lit(0.0), lambda s, x: s + x["views"])
    return made.select("date", "day_name", F.size("slots").cast("long").alias("n"), F.get("slots", F.lit(0))["post_id"].alias("first"), F.when(F.size("slots") > 0, views).alias("views"))


@query("""SELECT t.place, t.id AS member_id, coalesce((SELECT bool_or(event_type = 'purchase') FROM events WHERE user_id::VARCHAR = t.id AND user_id % 2 = 1), false) AS live FROM (VALUES (0, '1'), (1, '2'), (2, '999999'), (3, '3')) t(place, id)""")
def live_of_ids(spark: SparkSession, d: str) -> DataFrame:
    e = c._read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("member_id")).agg(F.bool_or(F.col("event_type") == "purchase").alias("live"))
    return feeds.live_check(e.withColumn("http_ok", F.col("member_id").cast("long") % 2 == 1), "1,2,,999999,3,4", most=4)


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = c.posts(spark, d)
    bodies = p.select("member_id", "post_id", "body_html")
    old, new = (gr.snapshot(x.drop("body_html"), bodies, c.members(spark, d)) for x in (p.where("posted_at < '1996-01-01'"), p))
    return old, new


@query("SELECT count(*) AS new_notices FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01') AND o_custkey IN (SELECT c_custkey FROM customer)")
def new_notice_count(spark: SparkSession, d: str) -> DataFrame:
    return gr.new_count(*_snapshots(spark, d))


@query("SELECT o_custkey::VARCHAR AS member_id, o_orderkey AS post_id, o_orderdate AS posted_at FROM orders WHERE o_custkey IN (1, 4, 10) AND o_custkey IN (SELECT c_custkey FROM customer)")
def favourite_feed(spark: SparkSession, d: str) -> DataFrame:
    p = c.posts(spark, d)
    rows = gr.listed(p.drop("body_html"), p.select("member_id", "post_id", "body_html"), c.members(spark, d))
    return gr.feed(rows, "favorites", ["1", "4", "10"]).select("member_id", "post_id", "posted_at")


@query("""SELECT doc_id, source || ': ' || lang || '~' || CASE WHEN doc_id % 2 = 0 THEN text ELSE '?' END AS raw, trim(split_part(source || ' ; a;b', ';', 1)) AS media, 'https://x/' || doc_id || '?s=' || source AS url, len(list_filter(string_split(text, ','), lambda x: x <> '')) AS n_tokens FROM documents""")
def text_parts(spark: SparkSession, d: str) -> DataFrame:
    raw = tx.span_text(F.col("source"), F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(""))
    return c._read(spark, d, "documents").select(
        "doc_id", raw.alias("raw"), tx.media_type(F.concat("source", F.lit(" ; a;b"))).alias("media"), tx.url("https://x/{id}?s={s}", id=F.col("doc_id"), s=F.col("source")).alias("url"),
        F.size(tx.tokens(F.col("text"))).cast("long").alias("n_tokens"),
    )


@query(f"""SELECT event_id, ts + INTERVAL 9 HOUR AS local, epoch_ms(TIMESTAMP '{c.AS_OF}') AS key, CASE event_type WHEN 'click' THEN 'tap' ELSE event_type END AS kind FROM events""")
def clock(spark: SparkSession, d: str) -> DataFrame:
    return c._read(spark, d, "events").select("event_id", tm.to_local(F.col("ts")).alias("local"), tm.synthetic_key(c.AS_OF).alias("key"), rel.alias_of(F.col("event_type"), {"click": "tap"}).alias("kind"))
