"""The ingest job: landed lists of posts and bodies become rows of posts, written by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import filled
from ..operators.merge import insert_ignore, upsert_posts
from ..operators.relational import flag_new, reconcile, split_group
from ..sources.keyed import KeyedTable


def incoming(posts: DataFrame, bodies: DataFrame, target: DataFrame, roster: DataFrame, group: str, as_of) -> DataFrame:
    """Rows to write, with `is_new`. Only posts that target lacks get a body, '' where none was landed. A roster's
    popular members, the rest, or all are taken; the name is the roster's, or the member's id."""
    popular = roster.where("is_popular").select("member_id")
    mine = split_group(posts.join(roster.select("member_id").distinct(), "member_id", "left_semi"), popular, "member_id", group)
    flagged = flag_new(mine, target, "post_id")
    names = roster.groupBy("member_id").agg(F.min_by("name", "ordinal").alias("member_name"))
    known = bodies.groupBy("member_id", "post_id").agg(F.max("body_html").alias("__body"))
    fetched = flagged.join(names, "member_id", "left").join(known, ["member_id", "post_id"], "left")
    return fetched.select(
        "member_id",
        filled(F.col("member_name"), F.col("member_id")).alias("member_name"),
        F.lit("").alias("member_tag"),
        "post_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.when(F.col("is_new"), F.coalesce("__body", F.lit(""))).alias("body_html"),
        "posted_at",
        F.col("views").cast("int").alias("views"),
        "is_pinned",
        F.lit(as_of).cast("timestamp_ntz").alias("updated_at"),
        "is_new",
    )


def ingest(posts: DataFrame, bodies: DataFrame, target: DataFrame, roster: DataFrame, group: str, as_of) -> DataFrame:
    """target after the job: running it again with the same input changes nothing."""
    return upsert_posts(target, _ordered(incoming(posts, bodies, target, roster, group, as_of)), "__order")


def run(table: KeyedTable, posts: DataFrame, bodies: DataFrame, roster: DataFrame, group: str, as_of) -> dict[str, int]:
    """The job on a stored table, of which it rewrites the buckets of the posts that were fetched; returns the counters of the rows written, which are
    counted as they are written."""
    counted, seen = observed(_ordered(incoming(posts, bodies, table.rows(), roster, group, as_of)))
    table.write(counted, lambda rows, batch: upsert_posts(rows, batch, "__order"))
    return seen.get


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__order", F.struct("posted_at", "title"))


def _counters() -> list[Column]:
    return [F.count(F.lit(1)).alias("upserted"), F.count_if("is_new").alias("new"), F.count_if(F.coalesce("body_html", F.lit("")) != "").alias("with_body")]


def metrics(rows: DataFrame) -> DataFrame:
    """One row of counters of `incoming`."""
    return rows.agg(*_counters())


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """rows of `incoming`, and their counters, known once the rows have been written: nothing is computed again for them."""
    seen = Observation()
    return rows.observe(seen, *_counters()), seen


def migrate(source: DataFrame, target: DataFrame, keys: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A bulk copy that keeps what is there: target after it, and one row with both counts."""
    after = insert_ignore(target, source, keys, order)
    return after, reconcile(source, after)
