"""Queries over the provided tables, each with the SQL that gives the same rows.

Orders stand for posts (customers are their members), line items for schedules (the return flag N stands for the sentinel), customers for
the roster, events for times, pages for HTML, documents for text. All run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import timeutil as tm
from ..operators import merge as mg
from ..operators import pages as pg
from ..operators import relational as rel
from ..sources.keyed import KeyedTable
from ..sources.paths import shared_folder
from ..sources.readers import csv_cells
from ..sources.schemas import SENTINEL
from ..streaming import ingest as stream
from . import feeds
from . import groups as gr
from . import parse as pr

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2024-01-15 10:00:00"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def posts(spark: SparkSession, d: str) -> DataFrame:
    o = _read(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("member_id"), F.concat(F.lit("m"), F.col("o_custkey")).alias("member_name"), F.lit("").alias("member_tag"),
        F.col("o_orderkey").alias("post_id"), F.col("o_orderpriority").alias("title"), F.lit(None).cast("string").alias("body_html"), F.col("o_orderdate").alias("posted_at"),
        F.col("o_totalprice").alias("views"), (F.col("o_orderstatus") == "F").alias("is_pinned"), F.col("o_orderdate").alias("updated_at"),
    )


def slots(spark: SparkSession, d: str) -> DataFrame:
    line = _read(spark, d, "lineitem")
    return line.select(
        (F.col("l_partkey") * 10_000_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").cast("string").alias("member_id"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("member_name"), F.col("l_orderkey").alias("post_id"), F.col("l_shipdate").alias("starts_at"),
        F.lit(None).cast("timestamp_ntz").alias("ends_at"), F.nullif("l_linestatus", F.lit("O")).alias("description"),
        F.when(F.col("l_returnflag") == "N", SENTINEL).otherwise(F.col("l_returnflag")).alias("raw_text"), F.col("l_shipdate").alias("parsed_at"),
    )


def members(spark: SparkSession, d: str) -> DataFrame:
    c = _read(spark, d, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("member_id"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("tag"),
        (F.col("c_acctbal") > 5000).alias("is_popular"), F.col("c_custkey").cast("int").alias("ordinal"),
    )


_POSTS = "(SELECT o_orderkey AS id, o_custkey::VARCHAR AS member_id, 'm' || o_custkey AS member_name, o_orderkey AS post_id, o_orderpriority AS title, o_orderdate AS posted_at, o_totalprice AS views, o_orderstatus = 'F' AS is_pinned FROM orders)"
_SLOTS = "(SELECT l_partkey * 10000000 + l_suppkey * 10 + l_linenumber AS id, l_suppkey::VARCHAR AS member_id, 's' || l_suppkey AS member_name, l_orderkey AS post_id, l_shipdate AS starts_at, nullif(l_linestatus, 'O') AS description, CASE WHEN l_returnflag = 'N' THEN 'none' ELSE l_returnflag END AS raw_text FROM lineitem)"
_MEMBERS = "(SELECT c_custkey::VARCHAR AS member_id, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS name, c_mktsegment AS tag, c_acctbal > 5000 AS is_popular, c_custkey AS ordinal FROM customer)"
_FIRST = "QUALIFY row_number() OVER (PARTITION BY s.post_id ORDER BY s.starts_at, s.id) = 1"


@query(f"""SELECT s.member_id, s.member_name, s.post_id, s.starts_at AS start, s.description, p.title, p.views, p.posted_at FROM {_SLOTS} s JOIN {_POSTS} p USING (post_id)
WHERE s.starts_at >= TIMESTAMP '1997-12-31 21:00:00' AND s.starts_at < TIMESTAMP '1998-12-31 21:00:00' AND s.raw_text <> 'none' AND p.views >= 100000 {_FIRST}""")
def hot_list(spark: SparkSession, d: str) -> DataFrame:
    return feeds.hot_notices(slots(spark, d), posts(spark, d), "1998-01-01 00:00:00", least=100_000, days=365)


@query(f"""SELECT s.member_id, coalesce(nullif(m.name, ''), s.member_name) AS member_name, s.starts_at AS start, NULL::TIMESTAMP AS "end", s.post_id, coalesce(s.description, s.raw_text) AS description, p.posted_at
FROM {_SLOTS} s JOIN (SELECT * FROM {_MEMBERS} WHERE is_popular) m ON m.member_id = s.member_id LEFT JOIN (SELECT * FROM {_POSTS} WHERE views < 200000) p ON p.post_id = s.post_id
WHERE s.starts_at >= TIMESTAMP '1997-12-31 21:00:00' AND s.starts_at < TIMESTAMP '1998-12-31 21:00:00' AND s.raw_text <> 'none' {_FIRST}""")
def calendar(spark: SparkSession, d: str) -> DataFrame:
    return feeds.schedules(slots(spark, d), posts(spark, d).where("views < 200000"), members(spark, d), "1998-01-01 00:00:00", days=365)


@query("""SELECT event_id, strftime((ts + INTERVAL 3 HOUR)::DATE, '%Y-%m-%d') AS day, list_extract(['일','월','화','수','목','금','토'], (dayofweek((ts + INTERVAL 3 HOUR)::DATE) + 1)::INT) AS day_name FROM events""")
def broadcast_day_label(spark: SparkSession, d: str) -> DataFrame:
    label = tm.day_label(tm.broadcast_day(F.col("ts")))
    return _read(spark, d, "events").select("event_id", label["date"].alias("day"), label["day_name"].alias("day_name"))


@query("""SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-16 21:00:00' AND ts < TIMESTAMP '2024-01-17 21:00:00'""")
def day_bounds_filter(spark: SparkSession, d: str) -> DataFrame:
    start, end = tm.day_bounds(AS_OF, 2)
    return _read(spark, d, "events").where((F.col("ts") >= start) & (F.col("ts") < end)).select("event_id", "ts")


@query("""SELECT (ts + INTERVAL 3 HOUR)::DATE::TIMESTAMP - INTERVAL 3 HOUR AS start, (ts + INTERVAL 3 HOUR)::DATE::TIMESTAMP + INTERVAL 21 HOUR AS "end", count(*) AS n FROM events GROUP BY ALL""")
def day_tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    days = stream.daily(_read(spark, d, "events"))
    return days.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(f"""SELECT p.post_id, p.member_id, p.title, p.posted_at, p.views FROM {_POSTS} p WHERE p.member_id IN (SELECT member_id FROM {_MEMBERS} WHERE is_popular) ORDER BY posted_at DESC, post_id DESC LIMIT 3000""")
def latest_posts(spark: SparkSession, d: str) -> DataFrame:
    popular = members(spark, d).where("is_popular")
    return feeds.notices(posts(spark, d), popular).select("post_id", "member_id", "title", "posted_at", "views")


@query("""SELECT o_orderkey AS id, o_orderpriority AS title, o_orderdate AS created_at FROM orders ORDER BY created_at DESC, id DESC LIMIT 50""")
def latest_updates(spark: SparkSession, d: str) -> DataFrame:
    rows = posts(spark, d).select("id", "title", F.col("posted_at").alias("created_at"))
    return feeds.updates(rows)


@query("""SELECT event_id AS id, event_type AS subject, ts AS created_at FROM events""")
def all_feedback(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("subject"), F.col("ts").alias("created_at"))
    return feeds.feedback(rows)


@query(f"""SELECT id, post_id, starts_at FROM {_SLOTS} WHERE starts_at >= TIMESTAMP '1998-11-01 00:00:00' - INTERVAL 3 DAY ORDER BY starts_at DESC, id DESC LIMIT 100""")
def admin_schedules(spark: SparkSession, d: str) -> DataFrame:
    return feeds.Admin.list_schedules(slots(spark, d).select("id", "post_id", "starts_at"), "1998-11-01 00:00:00")


@query("""SELECT o_orderkey AS post_id, o_orderpriority AS title FROM orders WHERE o_orderkey = 100""")
def post_lookup(spark: SparkSession, d: str) -> DataFrame:
    return feeds.notice_content(posts(spark, d), 100).select("post_id", "title")


def _group(name: str, condition: str):
    @query(f"SELECT post_id, member_id FROM {_POSTS} {condition}")
    def split(spark: SparkSession, d: str, group: str = name) -> DataFrame:
        return rel.split_group(posts(spark, d), members(spark, d).where("is_popular"), "member_id", group).select("post_id", "member_id")

    for table in (QUERIES, SQL):
        table[f"posts_of_{name}"] = table.pop("split")


_IN = f"IN (SELECT member_id FROM {_MEMBERS} WHERE is_popular)"
_group("popular", f"WHERE member_id {_IN}")
_group("rest", f"WHERE member_id NOT {_IN}")
_group("all", "")


@query("""SELECT o_orderkey AS post_id, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS is_new FROM orders""")
def new_vs_existing(spark: SparkSession, d: str) -> DataFrame:
    return rel.flag_new(posts(spark, d).select("post_id"), slots(spark, d), "post_id")


@query("""SELECT o_orderkey AS post_id, o_orderdate AS posted_at FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def unparsed_posts(spark: SparkSession, d: str) -> DataFrame:
    return pr.unread(posts(spark, d), slots(spark, d)).select("post_id", "posted_at")


@query("""SELECT o_custkey::VARCHAR AS member_id, o_orderkey AS post_id, o_orderdate AS posted_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_member(spark: SparkSession, d: str) -> DataFrame:
    return pr.latest_per_member(posts(spark, d).select("member_id", "post_id", "posted_at"))


def _owned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    line, order = slots(spark, d), posts(spark, d)
    last = lambda c: F.substring(c, -1, 1)
    return line.withColumn("member_id", last(F.col("member_id"))), order.where("views < 300000").withColumn("member_id", last(F.col("member_id")))


_OWNED = f"(SELECT s.id, s.post_id, s.starts_at, right(s.member_id, 1) AS member_id, (SELECT right(p.member_id, 1) FROM {_POSTS} p WHERE p.post_id = s.post_id AND p.views < 300000) AS owner FROM {_SLOTS} s)"


@query(f"SELECT id, post_id, starts_at, member_id FROM {_OWNED} WHERE owner <> member_id")
def owner_mismatch(spark: SparkSession, d: str) -> DataFrame:
    return pr.mismatched(*_owned(spark, d)).select("id", "post_id", "starts_at", "member_id")


@query(f"SELECT id, post_id, starts_at, member_id FROM {_OWNED} WHERE id NOT IN (SELECT id FROM {_OWNED} WHERE owner <> member_id)")
def owner_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return pr.cleaned(*_owned(spark, d)).select("id", "post_id", "starts_at", "member_id")


@query("""SELECT c_mktsegment AS tag, min(c_custkey) AS first FROM customer GROUP BY 1""")
def distinct_tags(spark: SparkSession, d: str) -> DataFrame:
    return gr.tags(members(spark, d))


@query("""SELECT DISTINCT l_orderkey AS post_id FROM lineitem""")
def parsed_post_ids(spark: SparkSession, d: str) -> DataFrame:
    return slots(spark, d).select("post_id").distinct()


@query("""SELECT count(*) AS n FROM orders""")
def count_all(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM customer) AS target_rows, (SELECT count(*) FROM orders) = (SELECT count(*) FROM customer) AS equal""")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    return rel.reconcile(_read(spark, d, "orders"), _read(spark, d, "customer"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '[\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g')) AS text FROM pages""")
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").select("page_id", tx.strip_html(F.col("html")).alias("text"))


@query("""SELECT doc_id, contains(coalesce(source, '') || ' ' || coalesce(text, ''), 'License') OR contains(coalesce(source, '') || ' ' || coalesce(text, ''), 'token') OR contains(coalesce(source, '') || ' ' || coalesce(text, ''), 'src1') AS hit, length(text) >= 5 AS long_enough FROM documents""")
def keyword_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    return docs.select("doc_id", tx.has_keyword(F.col("source"), F.col("text"), ["License", "token", "src1"]).alias("hit"), tx.long_enough(F.col("text")).alias("long_enough"))


@query("""SELECT doc_id, replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM documents""")
def escape_html(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", tx.escape_html(F.col("text")).alias("escaped"))


@query("""SELECT doc_id, source || ': ' || lang || '~' || coalesce(nullif(substr(text, 1, 0), ''), '?') AS raw, coalesce(nullif(source, 'src1'), lang) AS filled FROM documents""")
def template_text(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    raw = tx.span_text(F.col("source"), F.col("lang"), F.substring("text", 1, 0))
    return docs.select("doc_id", raw.alias("raw"), tx.filled(F.when(F.col("source") == "src1", "").otherwise(F.col("source")), F.col("lang")).alias("filled"))


@query("""SELECT page_id, len(u) AS n, coalesce(u[1], '') AS first FROM (SELECT page_id, list_slice(list_filter(regexp_extract_all(coalesce(html, ''), '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1), lambda x: starts_with(x, 'http')), 1, 5) AS u FROM pages)""")
def image_urls(spark: SparkSession, d: str) -> DataFrame:
    found = _read(spark, d, "pages").select("page_id", tx.image_urls(F.col("html")).alias("u"))
    return found.select("page_id", F.size("u").cast("long").alias("n"), F.coalesce(F.get("u", F.lit(0)), F.lit("")).alias("first"))


_PAIRED = ["object", "embed", "form", "input", "button", "textarea", "select"]


def _sanitised_sql() -> str:
    sql = "coalesce(html, '')"
    steps = [(r"<script[\s\S]*?</script>", ""), (r"""\s+on\w+\s*=\s*("[^"]*"|''[^'']*''|[^\s>]*)""", ""), (r"""href\s*=\s*["'']javascript:[^"'']*["'']""", 'href="#"')]
    # RE2 has no look-ahead: sources of data: whose type does not begin with image/ are told apart letter by letter.
    word, other = "image/", []
    for i in range(len(word)):
        other.append(rf"{word[:i]}[^{word[i]}{word[i].upper()}\"''][^\"'']*".replace('\\"', '"'))
        other.append(word[:i])
    steps.append((r"""src\s*=\s*["'']data:(""" + "|".join(other) + r""")["'']""", 'src=""'))
    steps.append((r"<iframe[\s\S]*?</iframe>", ""))
    steps.append(("|".join(rf"<{t}[\s\S]*?</{t}>" for t in _PAIRED), ""))
    steps += [(rf"<({'|'.join(_PAIRED)})[^>]*/?>", ""), (r"expression\s*\([^)]*\)", ""), (r"""style\s*=\s*["''][^"'']*url\s*\([^)]*\)[^"'']*["'']""", "")]
    for pattern, new in steps:
        sql = f"regexp_replace({sql}, '{pattern}', '{new}', 'gi')"
    return f"SELECT page_id, {sql} AS clean FROM pages"


@query(_sanitised_sql())
def sanitize_html(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "pages").select("page_id", tx.sanitize_html(F.col("html")).alias("clean"))


@query("""SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS INT), 0) AS k FROM events""")
def parse_json_props(spark: SparkSession, d: str) -> DataFrame:
    parsed = F.from_json("props", "struct<k:int>")
    return _read(spark, d, "events").select("event_id", F.coalesce(parsed["k"], F.lit(0)).alias("k"))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS word FROM documents), r AS (SELECT lang, min(doc_id) AS id FROM documents GROUP BY 1)
SELECT doc_id, r.id FROM w JOIN r ON w.word = r.lang WHERE r.id <> w.doc_id""")
def explode_mentions(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    names = docs.groupBy("lang").agg(F.min("doc_id").alias("id"))
    return words.join(names, F.col("word") == F.col("lang")).where(F.col("id") != F.col("doc_id")).select("doc_id", "id")


@query("""SELECT p_partkey, try_cast(regexp_extract(replace(p_brand, 'Brand#', ''), '^\\s*([+-]?\\d+)', 1) AS INT) AS brand, try_cast(replace(p_size || ',000', ',', '') AS INT) AS grouped, format('{:,}', p_partkey) AS shown FROM part""")
def prefix_int(spark: SparkSession, d: str) -> DataFrame:
    part = _read(spark, d, "part")
    brand = tx.to_int(F.concat(F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit("x")))
    return part.select("p_partkey", brand.alias("brand"), tx.grouped_int(F.concat(F.col("p_size"), F.lit(",000"))).alias("grouped"), tx.grouped(F.col("p_partkey")).alias("shown"))


@query("""SELECT event_id, CASE WHEN m < 1 THEN '방금' WHEN m < 60 THEN m || '분 전' WHEN m < 1440 THEN (m // 60) || '시간 전' ELSE (m // 1440) || '일 전' END AS age, ts > TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 3 HOUR AS fresh
FROM (SELECT event_id, ts, floor(date_sub('second', ts, TIMESTAMP '2024-02-01 00:00:00') / 60)::BIGINT AS m FROM events)""")
def time_ago(spark: SparkSession, d: str) -> DataFrame:
    as_of = "2024-02-01 00:00:00"
    return _read(spark, d, "events").select("event_id", tm.time_ago(F.col("ts"), as_of).alias("age"), tm.is_fresh(F.col("ts"), as_of).alias("fresh"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, date_trunc('second', ts) AS read, strftime(ts + INTERVAL 9 HOUR, '%m.%d %H:%M') AS short, (ts + INTERVAL 9 HOUR)::DATE AS local_day, date_trunc('minute', ts) - INTERVAL 9 HOUR AS composed FROM events""")
def time_formats(spark: SparkSession, d: str) -> DataFrame:
    ts, local = F.col("ts"), F.col("ts")
    composed = tm.compose_local(F.date_format(local, "yyyy-MM-dd"), F.date_format(local, "HH:mm"))
    return _read(spark, d, "events").select(
        "event_id", tm.to_iso(ts).alias("iso"), tm.parse_iso(tm.to_iso(ts)).alias("read"), tm.short_date(ts, "Asia/Seoul").alias("short"), tm.local_date(ts).alias("local_day"), composed.alias("composed")
    )


@query("""SELECT o_orderkey AS post_id, o_orderdate AS posted_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 4 OFFSET 8""")
def paginate(spark: SparkSession, d: str) -> DataFrame:
    return pg.paginate(posts(spark, d).select("post_id", "posted_at"), 2, 4, F.desc("posted_at"), F.desc("post_id"))


@query("""SELECT o_orderkey AS post_id, (row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) - 1) // 4 AS page FROM orders""")
def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    return pg.page_numbers(posts(spark, d).select("post_id", "posted_at"), 4, F.desc("posted_at"), F.desc("post_id")).select("post_id", "page")


@query("""SELECT r_name AS name, count(n_name) AS members, min_by(n_name, n_nationkey) AS first, count(s.n) AS with_stats FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT DISTINCT s_nationkey AS n FROM supplier) s ON s.n = n_nationkey GROUP BY r_name""")
def re_nest(spark: SparkSession, d: str) -> DataFrame:
    nation, supplier = _read(spark, d, "nation"), _read(spark, d, "supplier")
    member = F.struct(F.col("n_nationkey").alias("place"), F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), F.lit(False).alias("leader")).alias("m"))
    lists = nation.groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(member)), lambda x: x["m"]).alias("members"))
    nested = _read(spark, d, "region").join(lists, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_name").alias("name"), F.lit("").alias("color"), "members")
    stats = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(_read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    stats = stats.groupBy(F.col("r_name").alias("group"), F.col("n_name").alias("member")).agg(F.count(F.lit(1)).cast("int").alias("level"))
    stats = stats.select("group", "member", F.lit("j").alias("job"), F.lit("s").alias("skill"), "level", *[F.lit(1).alias(c) for c in ("weapon", "armor", "pants", "boots")])
    ranking = stats.select("group", "member", F.col("level").alias("power"))
    made = gr.groups(nested, stats, ranking)
    return made.select("name", F.size("members").cast("long").alias("members"), F.get("members", F.lit(0))["name"].alias("first"), F.size(F.filter("members", lambda m: m["power"].isNotNull())).cast("long").alias("with_stats"))


@query("""SELECT l_orderkey AS post_id, max_by(l_partkey, (l_shipdate, l_partkey, l_suppkey, l_linenumber)) AS part, max(l_shipdate) AS starts_at FROM lineitem GROUP BY 1""")
def last_by_key(spark: SparkSession, d: str) -> DataFrame:
    line = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("post_id"), F.col("l_shipdate").alias("starts_at"), F.col("l_partkey").alias("part"), "l_suppkey", "l_linenumber")
    return rel.last_by(line, ["post_id"], "starts_at", "part", "l_suppkey", "l_linenumber").select("post_id", "part", "starts_at")


_PREV, _CUR = "(SELECT user_id AS member_id, event_id AS post_id FROM events WHERE ts < TIMESTAMP '2024-01-12')", "(SELECT user_id AS member_id, event_id AS post_id FROM events WHERE ts >= TIMESTAMP '2024-01-05')"


@query(f"SELECT member_id, post_id FROM {_CUR} WHERE (member_id, post_id) NOT IN (SELECT member_id, post_id FROM {_PREV}) AND member_id IN (SELECT member_id FROM {_PREV})")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "events").select(F.col("user_id").alias("member_id"), F.col("event_id").alias("post_id"), "ts")
    return rel.snapshot_diff(e.where("ts < '2024-01-12'").drop("ts"), e.where("ts >= '2024-01-05'").drop("ts"))


def _merge_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = posts(spark, d).withColumn("body_html", F.concat(F.lit("old"), F.col("post_id")))
    target = base.where("views < 250000")
    source = base.where("views >= 150000").withColumns({"title": F.lit("changed"), "member_id": F.lit("other"), "views": F.col("views") + 1})
    return target, source


_T = "(SELECT post_id, member_id, title, views, 'old' || post_id AS body_html FROM {p} WHERE views < 250000)".format(p=_POSTS)
_S = "(SELECT post_id, 'other' AS member_id, 'changed' AS title, views + 1 AS views, {b} AS body_html FROM {p} WHERE views >= 150000)"


def _upserted(body: str, kept: str) -> str:
    source = _S.format(p=_POSTS, b=body)
    return f"SELECT coalesce(t.post_id, s.post_id) AS post_id, coalesce(t.member_id, s.member_id) AS member_id, coalesce(s.title, t.title) AS title, coalesce(s.views, t.views) AS views, {kept} AS body_html FROM {_T} t FULL JOIN {source} s ON t.post_id = s.post_id"


@query(_upserted("'new'", "coalesce(s.body_html, t.body_html)"))
def upsert_new(spark: SparkSession, d: str) -> DataFrame:
    target, source = _merge_tables(spark, d)
    done = mg.upsert_posts(target, source.withColumn("body_html", F.lit("new")))
    return done.select("post_id", "member_id", "title", "views", "body_html")


@query(_upserted("NULL::VARCHAR", "t.body_html"))
def upsert_meta(spark: SparkSession, d: str) -> DataFrame:
    target, source = _merge_tables(spark, d)
    done = mg.upsert_posts(target, source.withColumn("body_html", F.lit(None).cast("string")))
    return done.select("post_id", "member_id", "title", "views", "body_html")


@query(f"SELECT post_id, title FROM {_T} UNION ALL SELECT post_id, title FROM {_S.format(p=_POSTS, b='NULL')} s WHERE post_id NOT IN (SELECT post_id FROM {_T})")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    target, source = _merge_tables(spark, d)
    return mg.insert_ignore(target, source, ["post_id"]).select("post_id", "title")


@query("""SELECT o_orderkey AS post_id, CASE WHEN o_custkey = 10 THEN 'edited' ELSE o_orderpriority END AS title, o_totalprice AS views FROM orders""")
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    return mg.partial_update(posts(spark, d), "member_id", "10", title="edited", member_name="").select("post_id", "title", "views")


@query("""SELECT o_orderkey AS post_id FROM orders WHERE o_custkey <> 10""")
def delete_by_key(spark: SparkSession, d: str) -> DataFrame:
    return mg.delete_key(posts(spark, d), "member_id", "10").select("post_id")


@query("""SELECT c_custkey::VARCHAR AS member_id, coalesce(e.live, false) AS live FROM customer LEFT JOIN (SELECT user_id, bool_or(event_type = 'purchase') AS live FROM events GROUP BY 1) e ON e.user_id = c_custkey""")
def live_status(spark: SparkSession, d: str) -> DataFrame:
    status = _read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("member_id")).agg(F.bool_or(F.col("event_type") == "purchase").alias("live"))
    return feeds.live_of(members(spark, d).select("member_id"), status.withColumn("http_ok", F.lit(True)))


@query("""SELECT o_custkey::VARCHAR AS member_id, c_mktsegment AS tag, o_orderkey AS post_id, o_orderdate AS posted_at FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'""")
def tag_feed(spark: SparkSession, d: str) -> DataFrame:
    notices = posts(spark, d)
    bodies = notices.select("member_id", "post_id", "body_html")
    rows = gr.listed(notices.drop("body_html"), bodies, members(spark, d))
    return gr.feed(rows, "tag:BUILDING").select("member_id", "tag", "post_id", "posted_at")


_JSON = """'[{"date":"2024-01-' || lpad((1 + doc_id % 28)::VARCHAR, 2, '0') || '","start_time":"' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '20:30' END || '","mentioned_bjs":["' || lang || '"]}]'"""


@query(f"""WITH r AS (SELECT doc_id, source, json_extract_string(j, '$[0].date') AS day, json_extract_string(j, '$[0].start_time') AS t, json_extract_string(j, '$[0].mentioned_bjs[0]') AS who FROM (SELECT doc_id, source, {_JSON} AS j FROM documents))
SELECT doc_id AS post_id, 'm' || source AS member_id, CASE WHEN t <> '' THEN (day || ' ' || t || ':00')::TIMESTAMP - INTERVAL 9 HOUR ELSE TIMESTAMP '2024-01-14 15:00:00' END AS starts_at, CASE WHEN t <> '' THEN source || ': ' || t || '~?' ELSE '{SENTINEL}' END AS raw_text FROM r""")
def parse_pipeline(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents")
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    json = F.concat(F.lit('[{"date":"'), day, F.lit('","start_time":"'), F.when(F.col("doc_id") % 3 == 0, "").otherwise("20:30"), F.lit('","mentioned_bjs":["'), F.col("lang"), F.lit('"]}]'))
    results = docs.select(F.col("doc_id").alias("post_id"), F.lit("ok").alias("status"), json.alias("json"))
    found = docs.select(
        F.col("doc_id").alias("post_id"), F.concat(F.lit("m"), F.col("source")).alias("member_id"), F.col("source").alias("member_name"), F.col("source").alias("title"),
        F.lit("2024-01-15 00:00:00").cast("timestamp_ntz").alias("posted_at"), tm.local_date(AS_OF).alias("today"),
    )
    return pr.own_rows(pr.items(found, results), AS_OF).select("post_id", "member_id", "starts_at", "raw_text")


@query("""SELECT doc_id, trim(source) AS c0, lang || ',"' || lang AS c1 FROM documents""")
def csv_tokenise(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit(" "), F.col("source"), F.lit(' ,"'), F.col("lang"), F.lit(',""'), F.col("lang"), F.lit('"'))
    lines = _read(spark, d, "documents").select("doc_id", line.alias("line"))
    return lines.select("doc_id", csv_cells(F.col("line"), 2).alias("c")).select("doc_id", "c.*")


@query("""SELECT user_id AS member_id, max_by(event_id, (ts, event_id)) AS post_id, max(ts) AS posted_at FROM events GROUP BY 1""")
def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of micro-batches, four landings of four files, merged by member into a stored table: the last event of each member stays."""
    where, events = shared_folder(spark, "stream"), _read(spark, d, "events")
    for part in range(4):
        events.where(F.pmod("event_id", F.lit(4)) == part).repartition(4).write.mode("append").parquet(f"{where}/landed")
    table = KeyedTable(spark, f"{where}/table", "member_id long, post_id long, posted_at timestamp_ntz", ["member_id"], 16)
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{where}/landed")
    rows = rows.select(F.col("user_id").alias("member_id"), F.col("event_id").alias("post_id"), F.col("ts").alias("posted_at"))

    def latest(target: DataFrame, batch: DataFrame) -> DataFrame:
        return rel.last_by(target.unionByName(batch), ["member_id"], "posted_at", "post_id")

    stream.merge_stream(rows, table, latest, f"{where}/checkpoint").awaitTermination()
    return table.rows()
