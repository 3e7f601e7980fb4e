"""The reading job: posts that may hold a schedule, and schedules from landed parse results.

Own rows and rows of mentioned members come from one pass over the results, as a set: of several rows of one key the last in order of
(post, item) gives the columns that an upsert overwrites, and the first gives the member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, filled, has_keyword, image_urls, long_enough, parse_items, span_text, strip_html, truthy
from ..functions.timeutil import compose_local, local_date, within
from ..operators.merge import delete_set, upsert_schedules
from ..operators.relational import first_by, top_n
from ..sources.schemas import SENTINEL

# Words that announce a schedule, and the word for a joint broadcast.
KEYWORDS = [
    "시", "방송", "오늘", "내일", "오방공", "생방", "시작", "킵니다", "킬게", "갑니다", "ON", "합방", "좌표", "경매", "대회", "대전", "시간", "오후",
    "오전", "저녁", "새벽", "점심", "뵙겠", "출격", "예정", "콜라보", "월요일", "화요일", "수요일", "목요일", "금요일", "토요일", "일요일",
]
JOINT = "합방"


def mismatched(schedules: DataFrame, posts: DataFrame) -> DataFrame:
    """Schedules whose member isn't their post's; schedules without a post are not among them."""
    owners = posts.select("post_id", F.col("member_id").alias("__owner"))
    return schedules.join(owners, "post_id").where(F.col("member_id") != F.col("__owner")).drop("__owner")


def cleaned(schedules: DataFrame, posts: DataFrame) -> DataFrame:
    return delete_set(schedules, mismatched(schedules, posts), ["id"])


def candidates(posts: DataFrame, schedules: DataFrame, as_of, words: list[str] | None = None, least: int = 1000, days: int = 3, limit: int = 300, attempts: DataFrame | None = None) -> DataFrame:
    """Posts to read: recent and much viewed, not read before, with enough text and one of the words, and, by `attempts`, not to be tried later. The cheap
    filters reach the scan; text is stripped only of the latest `limit`."""
    recent = top_n(posts.where(within(F.col("posted_at"), as_of, days) & (F.col("views") >= least)), limit, F.desc("posted_at"), F.desc("post_id"))
    todo = unread(recent, schedules)
    todo = (todo if attempts is None else due(todo, attempts, as_of)).withColumn("text", strip_html(F.col("body_html")))
    kept = todo.where(long_enough(F.col("text")) & has_keyword(F.col("title"), F.col("text"), KEYWORDS if words is None else words))
    return kept.select("post_id", "member_id", "member_name", "title", "text", image_urls(F.col("body_html")).alias("images"), "posted_at", local_date(as_of).alias("today"))


def items(found: DataFrame, results: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Items of the candidates' results that have a date and a start, with their place, and one row without an item where
    there is none: `item` is null there. A failed result is left out, to be tried again; with strict_reference it counts as read."""
    taken = results if strict_reference else results.where(F.col("status") == "ok")
    met = found.join(taken.select("post_id", "json"), "post_id")
    valid = F.filter(parse_items(F.col("json")), lambda i: truthy(i["date"]) & truthy(i["start_time"]))
    return met.withColumn("valid", valid).select("*", F.posexplode_outer("valid").alias("place", "item")).drop("valid", "json")


def unread(posts: DataFrame, schedules: DataFrame) -> DataFrame:
    """posts without a schedule, be it the sentinel."""
    return posts.join(schedules.select("post_id").distinct(), "post_id", "left_anti")


def due(posts: DataFrame, attempts: DataFrame, as_of) -> DataFrame:
    """posts without those whose next attempt is after as_of."""
    return posts.join(attempts.where(F.col("next_at") > F.lit(as_of).cast("timestamp_ntz")).select("post_id"), "post_id", "left_anti")


def attempted(attempts: DataFrame, results: DataFrame, as_of, wait: int = 5, most: int = 1440) -> DataFrame:
    """attempts, a row a post that failed, after a run's results: a post whose results all failed has one more try, and waits for `wait` minutes,
    twice as long after each further try, `most` minutes at most; a post that was read is forgotten; the others stay."""
    status = results.where("post_id is not null").groupBy("post_id").agg(F.bool_or(F.coalesce(F.col("status") == "ok", F.lit(False))).alias("__read"))
    met = attempts.join(status, "post_id", "full_outer").where(~F.coalesce("__read", F.lit(False)))
    tried, tries = F.col("__read").isNotNull(), F.coalesce("tries", F.lit(0))
    minutes = F.least(F.lit(most), wait * F.pow(F.lit(2.0), F.least(tries, F.lit(30)))).cast("int")
    again = F.lit(as_of).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return met.select("post_id", F.when(tried, tries + 1).otherwise(tries).cast("int").alias("tries"), F.when(tried, again).otherwise(F.col("next_at")).alias("next_at"))


def _row(member: Column, name: Column, post: Column, start: Column, end: Column, description: Column, raw: Column, as_of, order: Column) -> list[Column]:
    return [
        member.alias("member_id"), name.alias("member_name"), post.alias("post_id"), start.alias("starts_at"), end.alias("ends_at"), description.alias("description"),
        raw.alias("raw_text"), F.lit(as_of).cast("timestamp_ntz").alias("parsed_at"), order.alias("__order"),
    ]


def own_rows(read: DataFrame, as_of) -> DataFrame:
    """A schedule for each item, and the sentinel for posts without one; the sentinel starts at midnight, UTC+9, of the post's day, or
    of today. Items whose time can't be read give no row."""
    item, none = F.col("item"), F.col("item").isNull()
    order = F.struct(F.col("posted_at").alias("p"), F.col("post_id").alias("n"), F.coalesce("place", F.lit(-1)).alias("i"), F.lit(0).alias("k"), F.lit("").alias("m"))
    midnight = F.coalesce(F.col("posted_at").cast("date"), F.col("today")).cast("timestamp_ntz") - F.expr("INTERVAL 9 HOURS")
    return read.select(
        *_row(
            F.col("member_id"), F.col("member_name"), F.col("post_id"),
            F.when(none, midnight).otherwise(compose_local(item["date"], item["start_time"])), compose_local(item["date"], item["end_time"]),
            F.when(none, F.lit("")).otherwise(filled(item["description"], F.col("title"), F.lit(""))),
            F.when(none, F.lit(SENTINEL)).otherwise(span_text(F.coalesce("title", F.lit("")), item["start_time"], item["end_time"])), as_of, order,
        )
    ).where("starts_at is not null")


def shared_rows(read: DataFrame, posts: DataFrame, roster: DataFrame, as_of, days: int = 3) -> DataFrame:
    """A schedule for each mentioned member under that member's own latest post: names are looked up on the roster, the
    first member of a name counts; unknown names, the author, and members without a recent post are left out."""
    named = roster.groupBy(F.col("name").alias("__name")).agg(F.min_by("member_id", "ordinal").alias("__member"))
    latest = latest_per_member(posts.where(within(F.col("posted_at"), as_of, days)))
    latest = latest.select(F.col("member_id").alias("__owner"), F.col("post_id").alias("__post"))
    told = read.where("item is not null").select("*", F.explode(compact(F.col("item.mentioned_bjs"))).alias("__mention"))
    met = told.join(named, F.col("__mention") == F.col("__name")).where(F.col("__member") != F.col("member_id"))
    met = met.join(latest, F.col("__member") == F.col("__owner"))
    item = F.col("item")
    order = F.struct(F.col("posted_at").alias("p"), F.col("post_id").alias("n"), F.col("place").alias("i"), F.lit(1).alias("k"), F.col("__member").alias("m"))
    described = F.concat(F.col("member_name"), F.lit(f" {JOINT}: "), F.coalesce(item["description"], F.lit("")))
    raw = span_text(F.concat(F.lit(f"{JOINT}("), F.col("member_name"), F.lit(")")), item["start_time"], item["end_time"])
    start, end = compose_local(item["date"], item["start_time"]), compose_local(item["date"], item["end_time"])
    return met.select(*_row(F.col("__member"), F.col("__mention"), F.col("__post"), start, end, described, raw, as_of, order)).where("starts_at is not null")


def latest_per_member(posts: DataFrame) -> DataFrame:
    return first_by(posts, ["member_id"], F.desc("posted_at"), F.desc("post_id"))


def parse(posts: DataFrame, schedules: DataFrame, results: DataFrame, roster: DataFrame, as_of, strict_reference: bool = False, **how) -> DataFrame:
    """schedules after the job. Mentioned members' rows stand under their own posts, which then count as read."""
    kept = cleaned(schedules, posts)
    read = items(candidates(posts, kept, as_of, **how), results, strict_reference)
    rows = own_rows(read, as_of).unionByName(shared_rows(read, posts, roster, as_of))
    return upsert_schedules(kept, rows, "__order")


def metrics(posts: DataFrame, schedules: DataFrame, results: DataFrame, as_of, **how) -> DataFrame:
    """One row of counters: posts checked, read with a schedule, and without one."""
    read = items(candidates(posts, schedules, as_of, **how), results)
    one = read.groupBy("post_id").agg(F.count("item").alias("n"))
    return one.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("n") > 0).alias("parsed"), F.count_if(F.col("n") == 0).alias("skipped"), F.coalesce(F.sum("n"), F.lit(0)).alias("upserted"))


