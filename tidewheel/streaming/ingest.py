"""The ingest job as a stream: each micro-batch of landed lists is merged by key into a stored table; and keys not seen before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import schemas
from ..sources.keyed import KeyedTable
from ..sources.readers import posts_of


def daily(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Counts of each broadcast day: a tumbling window of a day that starts at 21:00 UTC."""
    window = F.window(F.col(ts).cast("timestamp"), "1 day", "1 day", "21 hours")
    return events.groupBy(window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _run(source: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool, every: str) -> StreamingQuery:
    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def merge_stream(source: DataFrame, table: KeyedTable, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, once: bool = True, every: str = "5 minutes") -> StreamingQuery:
    """Puts merge(rows, batch) of every micro-batch into the table, whose other buckets stay as they are; `once` takes what is there and ends. A
    batch that runs again changes nothing, if merging a batch twice is as merging it once."""
    return _run(source, lambda batch, _: table.write(batch, merge) and None, checkpoint, once, every)


def landed_posts(spark: SparkSession, path: str, files: int = 30) -> DataFrame:
    """A stream of landed lists, `files` a batch, as rows of posts."""
    rows = spark.readStream.schema(schemas.POST_LIST).option("maxFilesPerTrigger", files).json(path)
    return posts_of(rows.select("member_id", F.explode("boards").alias("b")))


def unseen(source: DataFrame, keys: list[str], path: str, checkpoint: str, once: bool = True, every: str = "5 minutes") -> StreamingQuery:
    """Writes the keys of a stream that no earlier micro-batch had, with the number of their batch, to `path`; see `first_seen`.

    The keys that were seen are kept in Spark's state store, in partitions by key, so a batch is shuffled by its own keys only and no stored table
    is read; what was known before goes in as the stream's first files. A batch that runs again writes the same folder again."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return _run(source.select(*keys).dropDuplicates(keys), step, checkpoint, once, every)


def first_seen(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """What `unseen` wrote: the keys, of schema `kind`, and `batch`, the number of the micro-batch that had each first."""
    return spark.read.schema(kind + ", batch long").option("basePath", path).parquet(f"{path}/batch=*")
