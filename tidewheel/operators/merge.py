"""Keyed writes as pure functions: what a table holds after an upsert, insert, update or delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truthy


def merge(target: DataFrame, source: DataFrame, keys: list[str], update: list[str], order: str | None = None, filled_only: tuple[str, ...] = ()) -> DataFrame:
    """target after an upsert of source. Rows with a known key get source's `update` columns and keep the others; rows with a
    new key are added, with null in columns that source lacks. Of several source rows of one key the one with the last `order` wins for
    updated columns, and the first gives the others. Null keys match nothing. Columns of `filled_only` are updated where source's is neither
    null nor empty.

    One full outer join on the keys; the source is made unique by a pre-aggregated maximum and minimum."""
    given = [c for c in target.columns if c in source.columns]
    if order:
        later, fixed = [c for c in given if c in update], [c for c in given if c not in update and c not in keys]
        grouped = source.groupBy(*keys).agg(F.max(F.struct(order, *later)).alias("__l"), F.min(F.struct(order, *fixed)).alias("__f"))
        source = grouped.select(*keys, *[F.col(f"__l.{c}").alias(c) for c in later], *[F.col(f"__f.{c}").alias(c) for c in fixed])
    new = source.select(*[F.col(c).alias(f"__s_{c}") for c in given], F.lit(True).alias("__in_source"))
    old = target.withColumn("__in_target", F.lit(True))
    met = old.join(new, [F.col(k) == F.col(f"__s_{k}") for k in keys], "full_outer")
    here, there = F.col("__in_target").isNotNull(), F.col("__in_source").isNotNull()

    def value(c: str) -> Column:
        if c not in given:
            return F.col(c)
        if c in filled_only:
            return F.when(truthy(F.col(f"__s_{c}")) | ~here, F.col(f"__s_{c}")).otherwise(F.col(c))
        if c in update and c not in keys:
            return F.when(there, F.col(f"__s_{c}")).otherwise(F.col(c))
        return F.when(here, F.col(c)).otherwise(F.col(f"__s_{c}"))

    return met.select(*[value(c).alias(c) for c in target.columns])


def insert_ignore(target: DataFrame, source: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """target and the rows of source whose key it lacks; of several the one with the first `order`."""
    fresh = source.join(target.select(*keys), keys, "left_anti")
    if order:
        rest = [c for c in source.columns if c not in keys and c != order]
        fresh = fresh.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("__x")).select(*keys, "__x.*")
    else:
        fresh = fresh.dropDuplicates(keys)
    return target.unionByName(fresh.select(*target.columns))


def append(target: DataFrame, source: DataFrame) -> DataFrame:
    return target.unionByName(source, allowMissingColumns=True).select(*target.columns)


def delete_key(target: DataFrame, key: str, value) -> DataFrame:
    """target without rows of one key; rows of a null key stay."""
    return target.where(~F.coalesce(F.col(key) == F.lit(value), F.lit(False)))


def delete_set(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone.select(*keys).distinct(), keys, "left_anti")


def partial_update(target: DataFrame, key: str, value, **fields) -> DataFrame:
    """target with the fields that are neither null nor empty set in the rows of one key; no such field is an error."""
    set_to = {c: v for c, v in fields.items() if v not in (None, "")}
    if not set_to:
        raise ValueError("nothing to update")
    hit = F.coalesce(F.col(key) == F.lit(value), F.lit(False))
    return target.withColumns({c: F.when(hit, F.lit(v).cast(target.schema[c].dataType)).otherwise(F.col(c)) for c, v in set_to.items()})


def upsert_posts(target: DataFrame, source: DataFrame, order: str | None = None, overwrite_member: bool = False) -> DataFrame:
    """Posts after a fetch. Posts with a body overwrite all but their member and number; posts without one keep
    the body that is known. With overwrite_member the member is overwritten as well. Of several rows of a post those without a body
    come after the others, each in the given order, as if they were written after them. One aggregate and one join."""
    change = ["member_name", "member_tag", "title", "views", "is_pinned", "posted_at", "updated_at"]
    change += ["member_id"] if overwrite_member else []
    given = [c for c in target.columns if c in source.columns and c not in ("post_id", "body_html")]
    later, fixed = [c for c in given if c in change], [c for c in given if c not in change]
    bodied = truthy(F.col("body_html"))
    place = F.struct((~bodied).alias("bare"), *([F.col(order).alias("order")] if order else []))
    ranked = source.withColumn("__place", place)
    one = ranked.groupBy("post_id").agg(
        F.max(F.struct("__place", *later)).alias("__l"), F.min(F.struct("__place", *fixed, "body_html")).alias("__f"), F.max(F.when(bodied, F.struct("__place", "body_html"))).alias("__b")
    )
    body = F.coalesce("__b.body_html", "__f.body_html").alias("body_html")
    one = one.select("post_id", *[F.col(f"__l.{c}").alias(c) for c in later], *[F.col(f"__f.{c}").alias(c) for c in fixed], body)
    return merge(target, one, ["post_id"], change, filled_only=("body_html",))


def upsert_schedules(target: DataFrame, source: DataFrame, order: str | None = None, overwrite_member: bool = False) -> DataFrame:
    change = ["member_name", "ends_at", "description", "raw_text", "parsed_at", *(["member_id"] if overwrite_member else [])]
    return merge(target, source, ["post_id", "starts_at"], change, order)
