"""Places and pages of a sorted table, from a kept index of ranges and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.paths import shared_folder

_PLACE = (1 << 33) - 1


class PageIndex:
    """A table in order, written once as ranges of the order, with the number of rows before each range.

    A page is read from the one or two ranges that hold it, whatever its number; the rows before it are neither read nor sorted again. The table is
    sorted by Spark's range partitioning, so no task holds more than a range, and places come from counts of ranges, not from one task. There
    is a row of counts for each range, and as many ranges as the sort has partitions."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows, self.ranges = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/ranges")

    @classmethod
    def build(cls, df: DataFrame, *order: Column, path: str | None = None) -> PageIndex:
        """Sorts df, whose order must be total, into `path`, by default a new shared folder."""
        spark, path = df.sparkSession, path or shared_folder(df.sparkSession, "pages")
        placed = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
        placed = placed.withColumns({"__range": F.shiftright("__id", 33), "__place": F.col("__id").bitwiseAND(_PLACE)}).drop("__id")
        placed.write.partitionBy("__range").parquet(f"{path}/rows")
        counts = spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
        before = F.coalesce(F.sum("__rows").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts.withColumn("__before", before).write.parquet(f"{path}/ranges")
        return cls._of(spark, path, placed)

    @classmethod
    def _of(cls, spark: SparkSession, path: str, placed: DataFrame) -> PageIndex:
        index = cls.__new__(cls)
        index.rows, index.ranges = spark.read.schema(placed.schema).parquet(f"{path}/rows"), spark.read.parquet(f"{path}/ranges")
        return index

    def count(self) -> int:
        return self.ranges.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]

    def slice(self, first: int, rows: int) -> DataFrame:
        """Up to `rows` rows from the place `first` on, in order."""
        held = self.ranges.where((F.col("__before") < first + rows) & (F.col("__before") + F.col("__rows") > first) & (F.col("__rows") > 0))
        ranges = {r["__range"]: r["__before"] for r in held.select("__range", "__before").collect()}  # at most one for each row of the page
        if not ranges:
            return self.rows.where(F.lit(False)).drop("__range", "__place")
        wanted = F.lit(False)
        for at, before in sorted(ranges.items()):
            wanted = wanted | ((F.col("__range") == at) & F.col("__place").between(max(0, first - before), first + rows - before - 1))
        return self.rows.where(F.col("__range").isin(*ranges) & wanted).orderBy("__range", "__place").drop("__range", "__place")

    def page(self, number: int, per_page: int) -> DataFrame:
        """A page, numbered from 0; a number beyond either end is moved to it."""
        pages = max(1, -(-self.count() // per_page))
        return self.slice(min(max(number, 0), pages - 1) * per_page, per_page)

    def placed(self, out: str = "place") -> DataFrame:
        """All rows with their place, from 0."""
        starts = F.broadcast(self.ranges.select(F.col("__range").alias("__r"), "__before"))  # a row a range
        met = self.rows.join(starts, F.col("__range") == F.col("__r"))
        return met.withColumn(out, F.col("__before") + F.col("__place")).drop("__range", "__place", "__r", "__before", "__rows")


def paginate(df: DataFrame, page: int, per_page: int, *order: Column) -> DataFrame:
    """One page of a table that has no index yet; keep the index for more of them."""
    return PageIndex.build(df, *order).page(page, per_page)


def page_numbers(df: DataFrame, per_page: int, *order: Column) -> DataFrame:
    """Adds `page`, numbered from 0."""
    return PageIndex.build(df, *order).placed("__at").withColumn("page", F.floor(F.col("__at") / per_page)).drop("__at")
