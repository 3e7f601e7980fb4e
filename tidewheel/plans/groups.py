"""Groups with their members' stats, and snapshots of posts by member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tag_of
from ..operators.relational import snapshot_diff
from ..sources.keyed import KeyedTable, differing


def groups(groups: DataFrame, stats: DataFrame, ranking: DataFrame) -> DataFrame:
    """Groups with `members`, each with the stats and the ranking of its (group, name), in their order; members without either keep
    their own fields."""
    rows = groups.select(F.col("name").alias("group"), "color", F.posexplode_outer("members").alias("place", "m"))
    s = stats.select(F.col("group").alias("__g"), F.col("member").alias("__m"), "job", "skill", "level", "weapon", "armor", "pants", "boots")
    r = ranking.select(F.col("group").alias("__g2"), F.col("member").alias("__m2"), "power")
    met = rows.join(s, (F.col("group") == F.col("__g")) & (F.col("m.name") == F.col("__m")), "left")
    met = met.join(r, (F.col("group") == F.col("__g2")) & (F.col("m.name") == F.col("__m2")), "left")
    member = F.struct("place", "m.id", "m.name", "m.leader", "job", "skill", "level", "weapon", "armor", "pants", "boots", "power")
    nested = F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), member)))
    return met.groupBy(F.col("group").alias("name"), "color").agg(F.transform(nested, lambda x: x.dropFields("place")).alias("members"))


def _notices(posts: DataFrame, bodies: DataFrame) -> DataFrame:
    known = bodies.select("member_id", "post_id", "body_html")
    return posts.join(known, ["member_id", "post_id"], "left").withColumn("body_html", F.coalesce("body_html", F.lit("")))


def listed(posts: DataFrame, bodies: DataFrame, roster: DataFrame) -> DataFrame:
    """One row a notice of a member of the roster: what `exploded` gives of a snapshot, without a member's notices ever being in one row."""
    mine = _notices(posts, bodies).join(roster.select("member_id", "name", "tag"), "member_id")
    return mine.select("member_id", "name", "tag", "posted_at", "post_id", "title", "body_html", "views", "is_pinned")


def snapshot(posts: DataFrame, bodies: DataFrame, roster: DataFrame) -> DataFrame:
    """One row a member of the roster: its notices, latest first, as a screen takes them; use `listed` for members of very many notices."""
    notice = F.struct("posted_at", "post_id", "title", "body_html", "views", "is_pinned")
    lists = _notices(posts, bodies).groupBy("member_id").agg(F.sort_array(F.collect_list(notice), asc=False).alias("notices"))
    empty = F.array().cast(lists.schema["notices"].dataType)
    return roster.select("member_id", "name", "tag").join(lists, "member_id", "left").withColumn("notices", F.coalesce("notices", empty))


def exploded(snapshot: DataFrame) -> DataFrame:
    return snapshot.select("member_id", "name", "tag", F.explode("notices").alias("n")).select("member_id", "name", "tag", "n.*")


def feed(rows: DataFrame, choice: str = "all", favourites: list[str] | None = None) -> DataFrame:
    """Notices, of `listed` or of a snapshot, latest first: all, favourites, or `tag:X`."""
    rows, tag = exploded(rows) if "notices" in rows.columns else rows, tag_of(choice)
    if tag is not None:
        rows = rows.where(F.col("tag") == tag)
    elif choice == "favorites":
        rows = rows.where(F.array_contains(F.array(*map(F.lit, favourites or [""])), F.col("member_id")))
    elif choice != "all":
        raise ValueError(f"unknown choice: {choice}")
    return rows.orderBy(F.desc("posted_at"), F.desc("post_id"))


def new_notices(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Notices of current that previous lacks, of members that had any before."""
    return snapshot_diff(exploded(previous), exploded(current))


def new_count(previous: DataFrame, current: DataFrame) -> DataFrame:
    return new_notices(previous, current).agg(F.count(F.lit(1)).alias("new_notices"))


def stored_snapshot(posts: DataFrame, path: str, buckets: int = 64) -> KeyedTable:
    """The members' posts of a time, stored in buckets by member with checksums, to be compared with a later one."""
    ids = posts.select(F.col("member_id").cast("string").alias("member_id"), F.col("post_id").cast("long").alias("post_id"))
    table = KeyedTable(posts.sparkSession, path, "member_id string, post_id long", ["member_id"], buckets)
    table.replace(ids)
    return table


def refreshed(previous: KeyedTable, current: KeyedTable) -> DataFrame:
    """The posts of current that previous lacks, of members that had any before. Buckets whose checksums agree are not read; those that
    differ are joined."""
    buckets = differing(previous, current)
    return snapshot_diff(previous.rows(buckets), current.rows(buckets))


def tags(roster: DataFrame) -> DataFrame:
    """Different tags, in the order they first appear."""
    first: Column = F.min("ordinal").alias("first")
    return roster.where(F.col("tag").isNotNull()).groupBy("tag").agg(first).orderBy("first", "tag")
