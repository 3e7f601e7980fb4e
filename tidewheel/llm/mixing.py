"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a hash-random key. Within a source, rows are sorted by ranges of the key: a range is the key's high
bits, ranges hold about RANGE_ROWS rows each, and a source of any size is spread over as many ranges, so that no task
sorts a whole source. The sum of words before a row is the sum of its source's earlier ranges plus the sum
within its own range. A source's budget of target words is met by whole epochs and by the rows whose words
still fit in the last one; the row at the budget's edge gives only its first words.

Texts are read and hashed once, unless the mixed texts are wanted; (source, key, size) is written, and only that is shuffled. Its outcome is one
cut a source, and rows meet the cuts where they are: cuts are broadcast while their counted number is at most BROADCAST_SOURCES,
beyond it they are joined by shuffle. Targets are worked out over one row a source, and ranges over one row for each RANGE_ROWS rows of a
source, each in one task.

Defined results: a null or empty text has size 0 and takes 0 words; null is a source of its own, last in order. Rows that are
equal in key and text have one key and share what is left for them alike, each the whole part of its share. A source of no words
has target 0. An empty table gives no rows. Runs agree, as the key is a hash of the row. Columns of the outputs' names
are replaced; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 2000
BROADCAST_SOURCES = 100_000
EPOCHS = 2
KEY_BITS = 60


def size_of(text: Column) -> Column:
    """The number of words, long; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(docs: DataFrame, keep: list[str], key: str, text: str, source: str, seed: int) -> DataFrame:
    """The row's columns `keep` as a struct, its source, size and key: the first KEY_BITS bits of the MD5 of seed, key and text."""
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.col(text)).cast("binary"))
    number = F.conv(F.substring(hashed, 1, KEY_BITS // 4), 16, 10).cast("long")
    own = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__own")
    return docs.select(own, F.col(source).alias("__source"), size_of(F.col(text)).alias("__size"), number.alias("__key"))


def targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = EPOCHS) -> DataFrame:
    """Adds `target` to rows (__source, __total). Weights go to sources by code point, null last, in turn. Targets
    stop at `most` times a source's words, and what is over goes to the others by weight.

    A source is full at a common level t if weight * t reaches its limit; sources in order of limit / weight fill up one by one, so the
    level follows from running sums over the sources, which are as few rows as there are sources."""
    place = F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1
    weighted = totals.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    limited = weighted.withColumns({"__limit": F.col("__total") * float(most), "__fill": F.col("__total") * float(most) / F.col("__w")})
    everything = Window.partitionBy()
    before = Window.orderBy("__fill", F.col("__source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sums = limited.withColumns(
        {
            "__budget": F.sum("__total").over(everything) * share,
            "__full": F.coalesce(F.sum("__limit").over(before), F.lit(0.0)),
            "__open": F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)),
        }
    ).withColumn("__level", (F.col("__budget") - F.col("__full")) / F.col("__open"))
    # The first source, by fill, that its level does not fill gives the common level; with none, all are full.
    level = F.min(F.when(F.col("__level") < F.col("__fill"), F.struct("__fill", "__level"))).over(everything)["__level"]
    target = F.when(level.isNull() | (F.col("__w") * level >= F.col("__limit")), F.col("__limit")).otherwise(F.col("__w") * level)
    return sums.select("__source", "__total", target.alias("__target"))


def cuts(keyed: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """One row a source of `_keyed` rows: its words, target, whole epochs, the key at the edge, and the words left for each row there."""
    narrow = keyed.select("__source", "__key", "__size")
    ties = narrow.groupBy("__source", "__key").agg(F.sum("__size").alias("__size"), F.count(F.lit(1)).alias("__rows"))
    ties = stored(ties, "mixing")  # (source, key, size, rows): some 30 bytes a row, read twice below
    totals = ties.groupBy("__source").agg(F.sum("__size").alias("__total"), F.sum("__rows").alias("__count"))
    aims = targets(totals, weights, share).join(totals.select(F.col("__source").alias("__s"), "__count"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
    aims = aims.withColumns(
        {
            "__words": F.floor("__target").cast("long"),
            "__bits": F.least(F.lit(30), F.greatest(F.lit(0), F.ceil(F.log2(F.col("__count") / RANGE_ROWS)))).cast("int"),
        }
    ).withColumns(
        {
            "__epochs": F.when(F.col("__total") > 0, F.floor(F.col("__words") / F.col("__total"))).otherwise(0).cast("long"),
        }
    )
    aims = aims.withColumn("__left", F.col("__words") - F.col("__epochs") * F.col("__total"))
    few = aims.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    held = F.broadcast(aims) if few else aims
    named = held.select(F.col("__source").alias("__s"), "__bits", "__left", "__epochs", "__words", "__target", "__total")
    sized = ties.join(named, F.col("__source").eqNullSafe(F.col("__s")))
    sized = sized.withColumn("__range", F.floor(F.col("__key") / F.pow(F.lit(2.0), KEY_BITS - F.col("__bits"))).cast("long"))
    ranges = sized.groupBy("__source", "__range").agg(F.sum("__size").alias("__in_range"))
    earlier = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("__source", F.col("__range").alias("__r"), F.coalesce(F.sum("__in_range").over(earlier), F.lit(0)).alias("__offset"))
    ranges = ranges.withColumnRenamed("__source", "__s2")
    within = Window.partitionBy("__source", "__range").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    summed = sized.withColumn("__inner", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    summed = summed.join(ranges, F.col("__source").eqNullSafe(F.col("__s2")) & (F.col("__range") == F.col("__r")))
    summed = summed.withColumn("__before", F.col("__offset") + F.col("__inner"))
    # The edge is the last key that has words left when it is its turn.
    edge = F.max(F.when((F.col("__before") < F.col("__left")) & (F.col("__size") > 0), F.struct("__key", "__before", "__rows", "__size")))
    per = summed.groupBy("__source").agg(edge.alias("__edge"), *(F.first(c).alias(c) for c in ("__left", "__epochs", "__target", "__total")))
    left = F.least(F.col("__left") - F.col("__edge.__before"), F.col("__edge.__size"))
    return per.select("__source", "__total", "__target", "__epochs", F.col("__edge.__key").alias("__cut"), F.floor(left / F.col("__edge.__rows")).cast("long").alias("__rest"))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """docs without their text, written with its size and key for `shared`."""
    return stored(_keyed(docs, [c for c in docs.columns if c != text], key, text, source, seed), "mixing-sizes")


def shared(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """Rows of `sized` with `size`, `source_size`, `target`, `taken` (words, repeats counted) and `epochs` (whole repeats)."""
    return _met(rows, stored(cuts(rows, weights, share), "mixing-cuts"))


def taken(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, seed: int = 0, keep: list[str] | None = None
) -> DataFrame:
    """docs with their text and what `shared` adds; the texts are read again for that. Only the columns `keep`, if they are named."""
    rows = _keyed(docs, keep or docs.columns, key, text, source, seed)
    return _met(rows, stored(cuts(stored(rows.select("__source", "__key", "__size"), "mixing-sizes"), weights, share), "mixing-cuts"))


def _met(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`_keyed` rows with what `cuts` gives them."""
    few = found.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    named = found.withColumnRenamed("__source", "__s")
    joined = rows.join(F.broadcast(named) if few else named, F.col("__source").eqNullSafe(F.col("__s")))
    last = F.when(F.col("__key") < F.col("__cut"), F.col("__size")).when(F.col("__key") == F.col("__cut"), F.least(F.col("__rest"), F.col("__size"))).otherwise(0)
    out = {
        "size": F.col("__size"),
        "source_size": F.col("__total"),
        "target": F.col("__target"),
        "taken": (F.col("__epochs") * F.col("__size") + F.coalesce(last, F.lit(0))).cast("long"),
        "epochs": F.col("__epochs"),
    }
    own = [c for c in rows.schema["__own"].dataType.names if c not in out]
    return joined.select(*[F.col(f"__own.`{c}`").alias(c) for c in own], *[v.alias(c) for c, v in out.items()])


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", chars: str | None = "n_chars", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, seed: int = 0
) -> DataFrame:
    """The mixed documents, with the columns of docs: each row as often as it is taken, the edge's rows cut after their last
    word that is taken. A row without words is kept once, as it costs nothing. `chars`, if docs have it, follows the cut text."""
    columns = docs.columns
    row, at_key, at_text, at_source = "__row", "__k", "__t", "__s"
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(row), F.col(key).alias(at_key), F.col(text).alias(at_text), F.col(source).alias(at_source))
    rows = taken(packed, at_key, at_text, at_source, weights, share, seed, [row])
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    copies = F.concat(F.when(whole > 0, F.array_repeat(F.lit(-1), whole)).otherwise(F.array().cast("array<int>")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    out = rows.select("__row", F.explode(copies).alias("__words"))
    pieces = F.regexp_extract_all(F.col(f"__row.`{text}`"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))  # words with the space before them
    cut = F.when(F.col("__words") < 0, F.col(f"__row.`{text}`")).otherwise(F.array_join(F.slice(pieces, F.lit(1), F.col("__words")), ""))
    fields = {c: F.col(f"__row.`{c}`") for c in columns} | {text: cut}
    if chars in columns:
        fields[chars] = F.when(F.col("__words") < 0, F.col(f"__row.`{chars}`")).otherwise(F.length(cut)).cast(docs.schema[chars].dataType)
    return out.select(*[v.alias(c) for c, v in fields.items()])
