"""Stored tables that are written by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .paths import shared_folder

BUCKETS = 64


class KeyedTable:
    """A table in Parquet whose rows lie in buckets by a hash of columns; a write reads and rewrites only the buckets that it touches.

    `by` are key columns, or some of them: all rows of a key lie in one bucket. A bucket should be what one task can sort; `files` cuts larger ones
    in several files. Of a batch the numbers of its buckets, at most `buckets`, come to the driver.

    A write first puts the new rows of its buckets aside, whole, and then overwrites these partitions. If the driver is lost in between, the next
    use does the second step again from the rows that were put aside, so no bucket is ever half written or missing. One writer at a time. With each
    bucket its number of rows and a checksum of them are kept, which tell the buckets that differ between two tables without reading rows."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: list[str], buckets: int = BUCKETS, files: int = 1):
        self.spark, self.path, self.by, self.buckets, self.files = spark, path.rstrip("/"), by, buckets, files
        self.empty = spark.createDataFrame([], schema)
        self.columns = self.empty.columns
        jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = jvm.Path
        self._fs = jvm.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _has(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def _drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def _listed(self, name: str) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/{name}"))] if self._has(name) else []

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int").alias("__bucket")

    def _stored(self, name: str, like: DataFrame) -> DataFrame:
        """What is stored under a name, with the bucket; an empty table if there is nothing."""
        kind = like.withColumn("__bucket", F.lit(0))
        return self.spark.read.schema(kind.schema).parquet(f"{self.path}/{name}") if self._has(name) else kind.limit(0)

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, of which only their files are read."""
        self.recover()
        held = self._stored("rows", self.empty)
        return (held if buckets is None else held.where(F.col("__bucket").isin(*buckets))).select(self.columns)

    def sums(self) -> DataFrame:
        """(bucket, rows, checksum) of the buckets that are not empty."""
        self.recover()
        held = self._stored("sums", self.spark.createDataFrame([], "rows long, checksum decimal(38,0)"))
        return held.select(F.col("__bucket").alias("bucket"), "rows", "checksum")

    def write(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Puts merge(rows, batch) in place of the rows, where rows are those of the batch's buckets; returns the buckets. merge must leave
        keys alone whose rows it isn't given."""
        self.recover()
        landed = shared_folder(self.spark, "batch")
        batch.withColumn("__bucket", self.bucket()).write.parquet(landed)
        held = self.spark.read.parquet(landed)
        touched = sorted(r[0] for r in held.select("__bucket").distinct().collect())
        if not touched:
            return []
        after = merge(self.rows(touched), held.drop("__bucket")).select(self.columns)
        self._replace(after, touched)
        self._fs.delete(self._path(landed), True)
        return touched

    def replace(self, rows: DataFrame) -> None:
        """Puts rows in place of the whole table."""
        self.recover()
        self._replace(rows.select(self.columns), list(range(self.buckets)))

    def _replace(self, rows: DataFrame, touched: list[int]) -> None:
        cut = [F.pmod(F.xxhash64(F.lit("file"), *self.columns), F.lit(self.files))] if self.files > 1 else []
        dealt = rows.withColumn("__bucket", self.bucket()).repartition("__bucket", *cut)
        for bucket in touched:
            self._fs.mkdirs(self._path(f"{self.path}/touched/__bucket={bucket}"))
        dealt.write.mode("overwrite").partitionBy("__bucket").parquet(f"{self.path}/aside")
        self.recover()

    def recover(self) -> None:
        """Ends a write whose rows were put aside; forgets one whose rows were not."""
        if self._has("aside/_SUCCESS"):
            aside = self._stored("aside", self.empty)
            summed = aside.groupBy("__bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*self.columns).cast("decimal(38,0)")).alias("checksum"))
            for name, new in (("rows", aside), ("sums", summed.coalesce(1))):  # a file of those aside is of one bucket
                new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(f"{self.path}/{name}")
            for bucket in set(self._listed("touched")) - set(self._listed("aside")):  # those that have no row any more
                self._drop(f"rows/{bucket}")
                self._drop(f"sums/{bucket}")
        if self._has("aside") or self._has("touched"):
            self._drop("aside")
            self._drop("touched")


def differing(a: KeyedTable, b: KeyedTable) -> list[int]:
    """The buckets whose rows differ between two tables of one layout, by their kept counts and checksums; no row is read."""
    if (a.by, a.buckets, a.columns) != (b.by, b.buckets, b.columns):
        raise ValueError("tables of different layouts")
    left, right = a.sums().withColumn("side", F.lit(1)), b.sums().withColumn("side", F.lit(2))
    alike = left.unionByName(right).groupBy("bucket", "rows", "checksum").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r[0] for r in alike.where("n = 1").select("bucket").distinct().collect())
