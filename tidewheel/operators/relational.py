"""First and last rows, top rows, lookups and differences. Every order is made total by tie-breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order. Ranks are limited before the shuffle."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") == 1).drop("__rank")


def last_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the given columns: a maximum that is summed up before the shuffle, so one
    hot key does no harm."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__top"))
    return top.select(*[F.col(c) if c in keys else F.col(f"__top.{c}").alias(c) for c in df.columns])


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows: each task keeps n, and one merges them."""
    return df.orderBy(*order).limit(n)


def lookup(df: DataFrame, names: DataFrame, on: str, key: str, name: str, out: str, default: Column) -> DataFrame:
    """df with `out`: the name of its key in a table of unique keys, or the default where that is missing or empty."""
    small = names.select(F.col(key).alias("__key"), F.col(name).alias("__found"))
    return df.join(small, F.col(on) == F.col("__key"), "left").withColumn(out, F.coalesce(F.nullif(F.col("__found"), F.lit("")), default)).drop("__key", "__found")


def alias_of(value: Column, aliases: dict[str, str], strict: bool = False) -> Column:
    """The canonical form of a value, or the value itself; with strict, null."""
    if not aliases:
        return F.lit(None).cast("string") if strict else value
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.try_element_at(table, value) if strict else F.coalesce(F.try_element_at(table, value), value)


def flag_new(source: DataFrame, target: DataFrame, key: str, out: str = "is_new") -> DataFrame:
    """source with whether its key is absent from target."""
    known = target.select(F.col(key).alias("__key")).distinct().withColumn("__known", F.lit(True))
    return source.join(known, F.col(key) == F.col("__key"), "left").withColumn(out, F.col("__known").isNull()).drop("__key", "__known")


def split_group(df: DataFrame, popular: DataFrame, key: str, group: str) -> DataFrame:
    """Rows of popular members, of the rest, or all."""
    if group == "all":
        return df
    if group not in ("popular", "rest"):
        raise ValueError(f"unknown group: {group}")
    return df.join(popular.select(key).distinct(), key, "left_semi" if group == "popular" else "left_anti")


def snapshot_diff(previous: DataFrame, current: DataFrame, member: str = "member_id", key: str = "post_id") -> DataFrame:
    """Rows of current that previous lacks, of members that previous has."""
    fresh = current.join(previous.select(member, key).distinct(), [member, key], "left_anti")
    return fresh.join(previous.select(member).distinct(), member, "left_semi")


def reconcile(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: both row counts, and whether they agree."""
    rows = source.select(F.lit(1).alias("s"), F.lit(0).alias("t")).unionAll(target.select(F.lit(0), F.lit(1)))
    counts = rows.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("source_rows"), F.coalesce(F.sum("t"), F.lit(0)).alias("target_rows"))
    return counts.withColumn("equal", F.col("source_rows") == F.col("target_rows"))
