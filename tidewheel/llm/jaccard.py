"""Similarity join of texts on the Jaccard coefficient of their word n-grams, by MinHash banding.

1. Every text becomes its set of n-gram hashes (runs of N words; a shorter text is one n-gram). Texts with equal sets are
   one class; only one of them goes on.
2. `plan` chooses the bands and rows with the least number of hash functions whose recall at the threshold is at
   least the target. Band hashes are shuffled, and those that two or more classes share are buckets. Buckets with the same
   members, as the bands of a close pair, are kept once.
3. Members' full sets go to their buckets, a larger bucket (by members or by their sets' bytes) in pairs of blocks, and every pair of a bucket is verified
   on its full sets. A pair that shares several buckets counts in the one with the smallest name only. A task gives the
   number of links of each member, and a spanning forest of the links instead of all pairs.
4. Components of the forests are the groups.

Defined results: two texts without words have no n-grams and are linked only as members of one class; a null text is in no
class, its group is its own key and it has no links. A group's name is the smallest key in it. Repeated rows are separate members of a
class: each counts as a link of the others. Keys are whole numbers, and may be null or repeated; a class of null keys only has a null name. Extra columns
stay, columns of the outputs' names are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .scratch import stored, unused

N, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Hash functions at most.
HASHES = 128
#: Members of a block, and bytes of its members' sets, on average: two blocks meet in a task.
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: Columns of the membership matrix that a verification holds at a time.
COLUMNS = 1 << 14


@lru_cache(maxsize=16)
def plan(threshold: float = THRESHOLD, recall: float = RECALL, most: int = HASHES) -> tuple[int, int]:
    """(bands, rows). Recall of a pair at the threshold t is 1 - (1 - t^rows)^bands. Of the numbers that reach the target with at
    most `most` hashes, those with the most rows are taken: they give the fewest false candidates."""
    for rows in range(16, 0, -1):
        bands = max(1, int(np.ceil(np.log(1 - recall) / np.log1p(-(threshold**rows))))) if threshold < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("the recall can't be reached with so few hashes")


def _sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different n-gram hashes of each text, sorted, and where each text's begin and end."""
    found, docs = tk.shingles(tk.words(texts), len(texts), n)
    order = np.lexsort((found, docs))
    found, docs = found[order], docs[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (docs[1:] != docs[:-1])
    found, docs = found[new], docs[new]
    return found, np.searchsorted(docs, np.arange(len(texts) + 1))


def signed(text: Column, n: int, bands: int, rows: int) -> Column:
    """struct<size, low, high, bands> of each text: its set's size, two 64-bit names of the set, and its band hashes. Null for null."""
    salts = tk.mix64(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    kind = pa.struct([("size", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<size:long,low:long,high:long,bands:array<long>>")
    @tk.lean
    def made(column: pa.Array) -> pa.Array:
        texts = tk.as_bytes(column)
        sizes, names, hashed = [], [], []
        for a, b in tk.slices(texts):
            found, at = _sets(texts[a:b], n)
            size = np.diff(at)
            name = np.zeros((b - a, 2), dtype=np.uint64)
            own = np.zeros((b - a, bands), dtype=np.uint64)
            full = np.flatnonzero(size)
            if len(full):
                start = at[full]
                name[full, 0] = np.add.reduceat(tk.mix64(found), start)
                name[full, 1] = np.add.reduceat(tk.mix64(found ^ np.uint64(0x5851F42D4C957F2D)), start)
                for band in range(bands):
                    value = np.full(len(full), np.uint64(band + 1))
                    for salt in salts[band * rows : (band + 1) * rows]:
                        mixed = found * salt
                        mixed ^= mixed >> np.uint64(32)
                        mixed *= np.uint64(0xD6E8FEB86659FD93)
                        value = tk.mix64(value ^ np.minimum.reduceat(mixed, start))
                    own[full, band] = value
            sizes.append(size)
            names.append(name)
            hashed.append(own)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        name = (np.concatenate(names) if names else np.zeros((0, 2), np.uint64)).view(np.int64)
        own = (np.concatenate(hashed) if hashed else np.zeros((0, bands), np.uint64)).view(np.int64)
        ends = np.concatenate(([0], np.cumsum(np.where(size > 0, bands, 0)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(own[size > 0].ravel()))
        parts = [pa.array(size), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy()), lists]
        return pa.StructArray.from_arrays(parts, fields=list(kind), mask=pa.array(np.asarray(column.is_null())))

    return made(text)


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets have in common: products of membership matrices, COLUMNS values at a time."""
    m, flat = len(sets), np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often > 1
    place = np.cumsum(shared) - 1
    kept = shared[column]
    owner, column = owner[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common, total = np.zeros((m, m)), int(shared.sum())
    for low in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((m, min(COLUMNS, total - low)), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    return common


def verified(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets (sorted, without repeats) have a Jaccard coefficient of the threshold or more, as a matrix."""
    m, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    if m == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2, dtype=np.float64)
        common[1, 0] = common[0, 1]
    else:
        common = _common(sets)
    near = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(near, False)
    return near & (common > 0)


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the same members as all links do, fewer than members."""
    left, out = set(range(len(near))), []
    while left:
        todo = [left.pop()]
        while todo:
            i = todo.pop()
            for j in [j for j in np.flatnonzero(near[i]).tolist() if j in left]:
                left.discard(j)
                out.append((i, j))
                todo.append(j)
    return out


def _task(group: pa.Table, threshold: float) -> pa.Table:
    """Links between members of a task: the first block's among themselves, or those between two blocks."""
    name = group["bucket"][0].as_py()
    i, j = group["i"][0].as_py(), group["j"][0].as_py()
    classes, copies = group["class"].to_numpy(), group["copies"].to_numpy()
    blocks = group["block"].to_numpy()
    sets = [np.frombuffer(x, dtype=np.uint64) for x in group["set"].to_pylist()]
    near = verified(sets, threshold) if len(sets) > 1 else np.zeros((len(sets), len(sets)), dtype=bool)
    if i != j:
        near &= blocks[:, None] != blocks[None, :]
    buckets = [np.array(x, dtype=np.int64) for x in group["buckets"].to_pylist()]
    earlier = [b[b < name] for b in buckets]
    near &= _common(earlier) == 0
    links = near @ copies
    tree = _forest(near)
    has = np.flatnonzero(links)
    return pa.table(
        {
            "a": pa.array(np.concatenate((classes[has], classes[[x for x, _ in tree]] if tree else classes[:0]))),
            "b": pa.array([None] * len(has) + classes[[y for _, y in tree]].tolist(), pa.int64()),
            "links": pa.array(np.concatenate((links[has], np.zeros(len(tree), np.int64))).astype(np.int64)),
        }
    )


def _spread(n: int):
    """Gives each member's set to the tasks of its buckets: one task for each pair of blocks."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        names = ["bucket", "i", "j", "block", "class", "copies", "set", "buckets"]
        for batch in batches:
            texts, held = tk.as_bytes(batch.column("text")), batch.select(["class", "copies", "in"]).to_pylist()
            for a, b in tk.slices(texts, tk.SLICE_BYTES // 4):
                found, at = _sets(texts[a:b], n)
                out = []
                for i, row in enumerate(held[a:b]):
                    data, buckets = found[at[i] : at[i + 1]].tobytes(), sorted(x["bucket"] for x in row["in"])
                    for x in row["in"]:
                        blocks = x["blocks"]
                        own = int(tk.mix64(np.array([row["class"] ^ x["bucket"]], dtype=np.int64).view(np.uint64))[0] % np.uint64(blocks))
                        out += ((x["bucket"], min(own, k), max(own, k), own, row["class"], row["copies"], data, buckets) for k in range(blocks))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 8, kinds)], names=names)
        tk.released()

    return spread


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row for each row of docs: `key`, `text_name` (a hash of the text), `class_id` (the smallest key of its group), `n_links`
    (the number of other rows that are similar to it), and `first` (whether it has the key and the text that its group is named by)."""
    bands, rows = plan(threshold, recall)
    named = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_name"))
    marked = named.withColumn("s", signed(F.col("text"), n, bands, rows))
    # A class is named by a hash of its set's two 64-bit names and its size.
    name = F.when(F.col("s").isNotNull(), F.xxhash64("s.low", "s.high", "s.size"))
    marked = stored(marked.select("key", "text_name", name.alias("class"), F.col("s.size").alias("size"), F.col("s.bands").alias("bands")), "jaccard")
    first = F.struct(F.col("key").isNull().alias("none"), "key", "text_name")
    classes = marked.where("class is not null").groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min(first).alias("first"), F.min("size").alias("size"), F.min("bands").alias("bands"))
    classes = stored(classes, "jaccard-classes")

    member = classes.select("class", "size", F.posexplode("bands").alias("band", "hash"))
    bucket = member.groupBy("band", "hash").agg(
        F.count(F.lit(1)).alias("m"), F.sum("size").alias("grams"), F.sum(F.xxhash64("class").cast("decimal(38,0)")).alias("sum"), F.min("class").alias("low"), F.max("class").alias("high")
    )
    bucket = bucket.where("m > 1").withColumn("same", F.xxhash64("m", "sum", "low", "high"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("grams") * 8 / BLOCK_BYTES)).cast("int")
    one = bucket.groupBy("same").agg(F.min(F.struct("band", "hash")).alias("x"), F.min("m").alias("m"), F.max("grams").alias("grams")).select("x.band", "x.hash", "same", blocks.alias("blocks"))
    inside = member.join(one, ["band", "hash"]).groupBy("class").agg(F.collect_list(F.struct(F.col("same").alias("bucket"), "blocks")).alias("in"))
    wanted = classes.join(inside, "class").select("class", "copies", "in", F.col("first.key").alias("want_key"), F.col("first.text_name").alias("want_text"))

    # The text of one row of each class that shares a bucket.
    met = named.join(wanted, F.col("key").eqNullSafe(F.col("want_key")) & (F.col("text_name") == F.col("want_text")))
    if repeated(marked):
        met = met.dropDuplicates(["class"])
    kind = "bucket long, i int, j int, block int, class long, copies long, set binary, buckets array<long>"
    tasks = met.select("text", "class", "copies", "in").mapInArrow(_spread(n), kind)
    found = stored(tasks.groupBy("bucket", "i", "j").applyInArrow(lambda group: _task(group, threshold), "a long, b long, links long"), "jaccard-links")

    counted = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "class")
    parts = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "class")
    grouped = classes.select("class", "copies", "first").join(counted, "class", "left").join(parts, "class", "left")
    grouped = stored(grouped.withColumn("component", F.coalesce("component", "class")), "jaccard-groups")
    heads = grouped.groupBy("component").agg(F.min("first").alias("head"))
    answer = grouped.join(heads, "component").select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "head")
    joined = marked.select("key", "text_name", "class").join(answer, "class", "left")
    head = F.col("head.key").eqNullSafe(F.col("key")) & (F.col("head.text_name") == F.col("text_name"))
    alone = F.col("class").isNull()
    return joined.select(
        "key", "text_name", F.when(alone, F.col("key")).otherwise(F.col("head.key")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | head).alias("first")
    )


def repeated(marked: DataFrame) -> bool:
    """Whether two rows with a text agree in key and text."""
    return not marked.where("class is not null").groupBy("key", "text_name").count().where("count > 1").isEmpty()


def unique(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one row of each group: a row of the group's smallest key. Rows with a null text all stay."""
    found, (own_key, own_text) = stored(links(docs, key, text, **how), "jaccard-rows"), unused(docs.columns, "key", "text")
    gone = found.where("not first").select(F.col("key").alias(own_key), F.col("text_name").alias(own_text)).distinct()
    same = F.col(key).cast("long").eqNullSafe(F.col(own_key)) & (F.xxhash64(F.col(text)) == F.col(own_text)) & F.col(text).isNotNull()
    kept = docs.join(gone, same, "left_anti")
    again = found.where("first").groupBy("key", "text_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if again.isEmpty():
        return kept
    full = kept.where(F.col(text).isNotNull()).dropDuplicates([key, text])
    return full.unionByName(kept.where(F.col(text).isNull()))
