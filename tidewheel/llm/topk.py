"""Exact search for the largest inner products, by buckets of vectors of like length.

Candidates are grouped by length into buckets of at most BUCKET rows, longest first. For a query q with a known lower bound t
of its k-th score, a bucket whose longest vector has length l can hold a better one only at a cosine of at least
c = t / (|q| l):

* c > 1: the bucket is left out;
* c >= COORDINATE: coordinate pruning: of a unit vector at that cosine, coordinate f lies within
  q_f c -+ sqrt((1 - q_f^2)(1 - c^2)); of the query's FOCUS largest coordinates, the one whose range holds the fewest vectors of the
  bucket gives the vectors to verify;
* else length pruning: only the bucket's vectors of length t / |q| or more are verified.

Products are verified in whole numbers, and ties go to the smaller identifier, so a score equal to t still counts. Bounds in floating point are
widened by a relative SLACK.

How it is distributed. Every vector is shuffled once, to its bucket, which is written as one row. Queries are broadcast, at most CHUNK bytes
of them at a time, and tasks go through the buckets where they are, in waves: first the bucket of the longest vectors, and then each time
GROWTH times as many as have been seen. After each wave the k best of each query so far give the bounds of the next one, which also rise within a
task from bucket to bucket; only scores that reach them are shuffled. Of vectors that come in no order of score, as those of equal length may,
a wave lets through some k GROWTH rows of a query, however many tasks it has, and waves are as many as the logarithm of the buckets. So the shuffle
grows with the vectors, and with the queries times that logarithm; the work grows with the queries times the vectors, less what is pruned.

Vectors are integers: every component x becomes floor(SCALE * x). A component, or one of the best scores, of 2**63 or more is an error, as it is no whole
number of 64 bits; none is ever returned wrong. Defined results: a vector that is null, or has a null or
non-finite component, takes no part, nor does a null identifier; vectors of another dimension than the query score over
the components that both have; zero vectors score 0 and take part. Identifiers are whole numbers. Repeated identifiers are separate rows, and a
query meets no row of its own identifier. An empty table gives no rows; fewer than k candidates give all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import dropped, place, stored

SCALE = 64
#: Vectors of a bucket, queries that a task takes together, and bytes of queries that are broadcast together.
BUCKET, BLOCK, CHUNK = 4096, 512, 32 << 20
#: Buckets of a wave for each one that was seen before it.
GROWTH = 3
COORDINATE, FOCUS, SLACK = 0.8, 4, 1e-6
#: Somewhat below 2**63, as products are compared with it in floating point.
LIMIT = 2.0**63 * (1 - 1e-9)
#: What stands for a product beyond 64 bits until it is known whether it is among the best.
ENDS = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole(vector: Column, scale: int = SCALE) -> Column:
    """Components as floor(scale * x), array<long>; null for a vector that takes no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    wide = F.exists(vector, lambda x: F.abs(F.floor(x.cast("double") * scale)) >= LIMIT)
    whole = F.when(wide, F.raise_error(F.lit("a component of a vector needs more than 64 bits")).cast("array<long>")).otherwise(F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))
    return F.when(vector.isNotNull() & ~bad, whole)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, filled up with zeros."""
    values = column.values.to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()
    sizes = np.diff(starts)
    if len(sizes) and (sizes == sizes[0]).all():
        return values[starts[0] : starts[-1]].reshape(len(sizes), -1)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        out[i, : b - a] = values[a:b]
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers: through floating point where that is exact, else in 64 bits."""
    width = min(queries.shape[1], rows.shape[1])
    a, b = queries[:, :width], rows[:, :width]
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(width, 1)
    about = a.astype(np.float64) @ b.astype(np.float64).T
    if largest < 2**53:
        return about.astype(np.int64)
    exact = a @ b.T  # partial sums may wrap around, but not the whole
    return exact if largest < LIMIT else np.where(np.abs(about) < LIMIT, exact, np.where(about > 0, *ENDS[::-1]))


class Bucket:
    """Vectors of one bucket, longest first, with what pruning needs."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        lengths = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.rows, self.lengths = ids[order], rows[order], lengths[order]
        self.units = self.rows / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.sorted:
            order = np.argsort(self.units[:, f], kind="stable")
            self.sorted[f] = order, self.units[order, f]
        return self.sorted[f]

    def candidates(self, query: np.ndarray, bound: float) -> np.ndarray | None:
        """Places of the vectors that may score `bound` or more; None: the first so many by length, see `reach`."""
        length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        if bound <= 0 or length == 0 or not len(self.ids) or self.lengths[0] == 0:
            return np.arange(len(self.ids))
        cosine = bound / (length * self.lengths[0]) * (1 - SLACK)
        if cosine > 1:
            return np.arange(0)
        if cosine >= COORDINATE:
            unit, few = query / length, None
            for f in np.argsort(-np.abs(unit[: self.units.shape[1]]), kind="stable")[:FOCUS]:
                wide = np.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - cosine**2))) + SLACK
                order, values = self._coordinate(int(f))
                low = -1.0 if unit[f] < -cosine else unit[f] * cosine - wide
                high = 1.0 if unit[f] > cosine else unit[f] * cosine + wide
                a, b = np.searchsorted(values, low - SLACK, side="left"), np.searchsorted(values, high + SLACK, side="right")
                if few is None or b - a < len(few):
                    few = order[a:b]
            return few
        return np.arange(np.searchsorted(-self.lengths, -bound / length * (1 - SLACK), side="right"))


class Best:
    """The k best rows of each of a block of queries so far, and the score from which another counts."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, bounds: np.ndarray, k: int):
        self.ids, self.rows, self.bounds, self.k = ids, rows, bounds.copy(), k
        self.lengths = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))
        self.query, self.found, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def meet(self, bucket: Bucket) -> None:
        """Takes the bucket's rows that reach the bounds."""
        longest = bucket.lengths[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where((self.bounds > 0) & (self.lengths > 0) & (longest > 0), self.bounds / (self.lengths * longest) * (1 - SLACK), 0.0)
        news: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero((cosine >= COORDINATE) & (cosine <= 1)).tolist():
            places = bucket.candidates(self.rows[i], self.bounds[i])
            news.append((np.full(len(places), i), places, products(self.rows[i : i + 1], bucket.rows[places])[0]))
        some = np.flatnonzero(cosine < COORDINATE)
        if len(some):
            # By length: of each query's rows the longest ones, together for all queries as far as the farthest goes.
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(cosine[some] > 0, self.bounds[some] / self.lengths[some] * (1 - SLACK), -1.0)
            reach = np.searchsorted(-bucket.lengths, -least, side="right")
            scores = products(self.rows[some], bucket.rows[: int(reach.max())])
            counts = np.arange(scores.shape[1]) < reach[:, None]
            counts &= bucket.ids[None, : scores.shape[1]] != self.ids[some][:, None]
            floor = self.bounds[some].copy()
            if scores.shape[1] > 4 * self.k:
                for j in np.flatnonzero(np.isneginf(floor)).tolist():
                    own = scores[j, counts[j]]
                    floor[j] = np.partition(own, len(own) - self.k)[len(own) - self.k] if len(own) >= self.k else -np.inf
            query, place = np.nonzero(counts & (scores >= floor[:, None]))
            news.append((some[query], place, scores[query, place]))
        if news:
            query, place, score = (np.concatenate(x) for x in zip(*news))
            found = bucket.ids[place]
            kept = (score >= self.bounds[query]) & (found != self.ids[query])
            self._keep(query[kept], found[kept], score[kept])

    def _keep(self, query: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        query, found, score = np.concatenate((self.query, query)), np.concatenate((self.found, found)), np.concatenate((self.score, score))
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        begin = np.searchsorted(query, np.arange(len(self.ids)))
        kept = np.arange(len(query)) - begin[query] < self.k
        self.query, self.found, self.score = query[kept], found[kept], score[kept]
        if np.isin(self.score, ENDS).any():
            raise OverflowError("a score needs more than 64 bits")
        last = np.searchsorted(self.query, np.arange(len(self.ids)), side="right") - 1
        full = np.flatnonzero(np.bincount(self.query, minlength=len(self.ids)) == self.k)
        self.bounds[full] = np.maximum(self.bounds[full], self.score[last[full]])


_FOUND = "query_id long, vec_id long, score long"


def _met(queries: DataFrame, buckets: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    """The k best rows of the buckets for each of a bounded number of queries (query_id, v, bound), as each task finds them, and the queries' broadcast."""
    table = queries.toArrow()
    bounds = table["bound"].cast(pa.float64()).fill_null(-np.inf).to_numpy()
    held = queries.sparkSession.sparkContext.broadcast((table["query_id"].to_numpy(), _matrix(table["v"].combine_chunks()), bounds))

    def gone_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, bounds = held.value
        blocks = [Best(ids[a : a + BLOCK], rows[a : a + BLOCK], bounds[a : a + BLOCK], k) for a in range(0, len(ids), BLOCK)]
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column("ids")[i].as_buffer(), dtype=np.int64)
                bucket = Bucket(own, np.frombuffer(batch.column("rows")[i].as_buffer(), dtype=np.int64).reshape(len(own), -1))
                for block in blocks:
                    block.meet(bucket)
        for block in blocks:
            columns = (block.ids[block.query], block.found, block.score)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])
        tk.released()

    return buckets.select("ids", "rows").mapInArrow(gone_through, _FOUND), held


def _packed(group: pa.Table) -> pa.Table:
    """A bucket's vectors as one row."""
    ids, rows = group["vec_id"].to_numpy(), _matrix(group["v"].combine_chunks())
    return pa.table({"place": group["place"][:1].cast(pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "rows": pa.array([rows.astype(np.int64).tobytes()], pa.binary())})


def _top(rows: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """For each row that is_query marks, its k best others: query_id, rank, vec_id, score. is_query is a condition on
    columns of vectors."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), whole(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.where("vec_id is not null and v is not null").withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))
    rows, spark = stored(rows, "topk-rows"), vectors.sparkSession
    n = rows.count()
    count = max(1, -(-n // BUCKET))
    # Buckets are ranges of the length between approximate quantiles; a range with more rows, as of equal lengths, is cut by a hash.
    steps = [1 - i / count for i in range(1, count)]
    bounds = sorted(set(rows.approxQuantile("length", steps, 0.1 / count)), reverse=True) if steps else []

    @F.arrow_udf("int")
    def range_of(lengths: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(-np.array(bounds), -lengths.to_numpy(zero_copy_only=False), side="left").astype(np.int32))

    ranged = rows.withColumn("range", range_of("length")) if bounds else rows.withColumn("range", F.lit(0))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    cut = sizes.select("range", F.ceil(F.col("rows") / (2 * BUCKET)).cast("int").alias("parts"))
    before = F.coalesce(F.sum("parts").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = stored(cut.withColumn("before", before), "topk-cuts")  # a row a range
    placed = ranged.join(F.broadcast(cut) if count <= 100_000 else cut, "range")
    placed = placed.withColumn("place", F.col("before") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")))
    packed = placed.select("place", "vec_id", "v").groupBy("place").applyInArrow(_packed, "place long, ids binary, rows binary")
    buckets = stored(packed, "topk-buckets")
    queries = rows.where("query").select(F.col("vec_id").alias("query_id"), "v")
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not n or not size["n"]:
        return _top(spark.createDataFrame([], _FOUND), k).select("query_id", "rank", "vec_id", "score")
    total, waves = cut.agg(F.sum("parts")).first()[0], [0, 1]
    while waves[-1] < total:
        waves.append(waves[-1] * (1 + GROWTH))
    chunks = -(-size["n"] * 8 * max(1, size["width"]) // CHUNK)
    where = place(spark, "topk-found")
    for i in range(chunks):  # a job a wave for each CHUNK bytes of queries; all chunks' rows go to one table
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == i)
        best, known = None, own.withColumn("bound", F.lit(None).cast("long"))
        for low, high in zip(waves, waves[1:]):
            wave = buckets.where((F.col("place") >= low) & (F.col("place") < high))
            found, held = _met(known, wave, k)
            new = _top(found if best is None else found.unionByName(best), k).select("query_id", "vec_id", "score", "rank")
            last = high >= total
            if last and chunks == 1:
                best = new
                break
            if last:
                new.write.mode("append").parquet(where)
            else:
                new = stored(new.drop("rank"), "topk-best")
                full = new.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
                known = own.join(full.select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("bound")), "query_id", "left")
            held.destroy()
            if best is not None:
                dropped(best)
            best = new
    out = spark.read.schema(best.schema).parquet(where) if chunks > 1 else best
    return out.select("query_id", "rank", "vec_id", "score")
