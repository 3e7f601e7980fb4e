"""Read queries: lists of posts, the day calendar, the hot list, updates, feedback, live status, and the administration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled, tokens
from ..functions.timeutil import broadcast_day, day_bounds, day_label, synthetic_key, within
from ..operators import merge
from ..operators.relational import first_by, lookup, top_n
from ..sources.schemas import BY_HAND, CATEGORY, SENTINEL


def notices(posts: DataFrame, roster: DataFrame, limit: int = 3000) -> DataFrame:
    """The latest posts of members on the roster."""
    mine = posts.join(roster.select("member_id").distinct(), "member_id", "left_semi")
    return top_n(mine, limit, F.desc("posted_at"), F.desc("post_id"))


def notice_content(posts: DataFrame, post_id: int | None) -> DataFrame:
    """A post's body; no number, or 0, is an error, an unknown one gives no row."""
    if not post_id:
        raise ValueError("post_id is required")
    return posts.where(F.col("post_id") == post_id).select("post_id", "title", "body_html").limit(1)


def _of_day(schedules: DataFrame, as_of, offset: int, days: int = 1) -> DataFrame:
    start, end = day_bounds(as_of, offset)[0], day_bounds(as_of, offset + days - 1)[1]
    return schedules.where((F.col("starts_at") >= start) & (F.col("starts_at") < end) & (F.col("raw_text") != SENTINEL))


def schedules(schedules: DataFrame, posts: DataFrame, roster: DataFrame, as_of, offset: int = 0, days: int = 1) -> DataFrame:
    """The calendar of a broadcast day, or of several: popular members only, the first schedule of each post, in order of start. Filters
    come before the join; the name is the roster's, or the row's own."""
    popular = roster.where("is_popular").select("member_id").distinct()
    day = _of_day(schedules, as_of, offset, days).join(popular, "member_id", "left_semi")
    day = first_by(day, ["post_id"], F.asc("starts_at"), F.asc("id"))
    met = day.join(posts.select("post_id", "title", "views", "posted_at"), "post_id", "left")
    named = lookup(met, roster, "member_id", "member_id", "name", "__name", F.col("member_name"))
    shown = named.select(
        "member_id", F.col("__name").alias("member_name"), F.col("starts_at").alias("start"), F.col("ends_at").alias("end"), "post_id",
        filled(F.col("description"), F.col("raw_text")).alias("description"), "posted_at",
    )
    return shown.orderBy("start", "post_id")


def hot_notices(schedules: DataFrame, posts: DataFrame, as_of, offset: int = 0, least: int = 1000, days: int = 1) -> DataFrame:
    """The hot list of a broadcast day, or of several: posts with at least `least` views, of all members, the first schedule of each post."""
    read = posts.where(F.col("views") >= least).select("post_id", "title", "views", "posted_at")
    met = _of_day(schedules, as_of, offset, days).join(read, "post_id")
    first = first_by(met, ["post_id"], F.asc("starts_at"), F.asc("id"))
    shown = first.select(
        "member_id", "member_name", "post_id", F.col("starts_at").alias("start"), "description", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("views", F.lit(0)).alias("views"), "posted_at"
    )
    return shown.orderBy("start", "post_id")


def day_response(rows: DataFrame, as_of, offset: int = 0) -> DataFrame:
    """One row {date, day_name, slots}: a day's rows, which a screen shows, in order of start."""
    label = day_label(F.date_add(broadcast_day(F.lit(as_of).cast("timestamp_ntz")), offset))
    slots = F.sort_array(F.collect_list(F.struct("start", "post_id", *[c for c in rows.columns if c not in ("start", "post_id")])))
    return rows.agg(slots.alias("slots")).select(label["date"].alias("date"), label["day_name"].alias("day_name"), "slots")


def updates(updates: DataFrame, limit: int = 50) -> DataFrame:
    return top_n(updates, limit, F.desc("created_at"), F.desc("id"))


def feedback(feedback: DataFrame) -> DataFrame:
    return feedback.orderBy(F.desc("created_at"), F.desc("id"))


def add_feedback(feedback: DataFrame, subject: str, body: str, as_of) -> DataFrame:
    if not subject or not body:
        raise ValueError("subject and body are required")
    row = feedback.sparkSession.range(1).select(F.lit(None).cast("long").alias("id"), F.lit(subject).alias("subject"), F.lit(body).alias("body"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"))
    return merge.append(feedback, row)


def live_check(status: DataFrame, ids: str, most: int = 50) -> DataFrame:
    """The live status of up to `most` ids of a comma list; unknown ids and failed fetches are not live."""
    asked = status.sparkSession.range(1).select(F.posexplode(tokens(F.lit(ids), most)).alias("place", "member_id"))
    return live_of(asked, status)


def live_of(asked: DataFrame, status: DataFrame) -> DataFrame:
    """asked, rows with a member_id, with `live`: false for members without a status that was fetched."""
    known = status.where(F.coalesce("http_ok", F.lit(False))).select(F.col("member_id").alias("__id"), "live")
    met = asked.join(known, F.col("member_id") == F.col("__id"), "left").drop("__id")
    return met.withColumn("live", F.coalesce("live", F.lit(False)))


class Admin:
    """Administration of schedules, posts and updates; each action returns the table as it is afterwards."""

    @staticmethod
    def delete_notice(posts: DataFrame, post_id: int | None) -> DataFrame:
        return merge.delete_key(posts, "post_id", _required(post_id, "post_id"))

    @staticmethod
    def delete_schedule(schedules: DataFrame, id: int | None) -> DataFrame:
        return merge.delete_key(schedules, "id", _required(id, "id"))

    @staticmethod
    def add_schedule(schedules: DataFrame, name: str, start, as_of, end=None, description: str = "") -> DataFrame:
        """A schedule by hand: member `manual`, and the time in milliseconds as its post; so only list_schedules shows it."""
        _required(name, "name"), _required(start, "start")
        row = schedules.sparkSession.range(1).select(
            F.lit("manual").alias("member_id"), F.lit(name).alias("member_name"), synthetic_key(as_of).alias("post_id"), F.lit(start).cast("timestamp_ntz").alias("starts_at"),
            F.lit(end).cast("timestamp_ntz").alias("ends_at"), F.lit(description).alias("description"), F.lit(BY_HAND).alias("raw_text"), F.lit(as_of).cast("timestamp_ntz").alias("parsed_at"),
        )
        return merge.append(schedules, row)

    @staticmethod
    def edit_schedule(schedules: DataFrame, id: int | None, **fields) -> DataFrame:
        return merge.partial_update(schedules, "id", _required(id, "id"), **fields)

    @staticmethod
    def list_schedules(schedules: DataFrame, as_of, days: int = 3, limit: int = 100) -> DataFrame:
        return top_n(schedules.where(within(F.col("starts_at"), as_of, days)), limit, F.desc("starts_at"), F.desc("id"))

    @staticmethod
    def list_updates(rows: DataFrame) -> DataFrame:
        return updates(rows)

    @staticmethod
    def add_update(rows: DataFrame, title: str, content: str, as_of, category: str = CATEGORY) -> DataFrame:
        _required(title, "title"), _required(content, "content")
        row = rows.sparkSession.range(1).select(F.lit(title).alias("title"), F.lit(content).alias("content"), F.lit(category).alias("category"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"))
        return merge.append(rows, row)

    @staticmethod
    def delete_update(rows: DataFrame, id: int | None) -> DataFrame:
        return merge.delete_key(rows, "id", _required(id, "id"))


def _required(value, name: str):
    if value in (None, "", 0):
        raise ValueError(f"{name} is required")
    return value
