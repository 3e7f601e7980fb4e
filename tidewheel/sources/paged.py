"""A data source of landed pages: ordered pages of rows by a growing key, read range by range until a short page."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PAGE = 1000


class Range(InputPartition):
    """A range of keys: the folder of its pages, and the keys that are asked for, above `after` and up to `upto`."""

    def __init__(self, folder: str, after: int | None, upto: int | None = None):
        self.folder, self.after, self.upto = folder, after, upto


class _Pages:
    """Pages lie in folders `range=R/first=K`, K being the first key of the page; a page's files may be several."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.key, self.page = options["key"], int(options.get("page", PAGE))
        self.after = int(options["after"]) if options.get("after") else None
        self.where, self.kind = options["path"].rstrip("/"), to_arrow_schema(schema)

    def _files(self, path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        system, base = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        return system, system.get_file_info(fs.FileSelector(base, allow_not_found=True))

    def ranges(self) -> list[str]:
        return sorted(f"{self.where}/{f.base_name}" for f in self._files(self.where)[1] if f.base_name.startswith("range="))

    def pages(self, folder: str) -> list[tuple[int, str, fs.FileSystem]]:
        system, found = self._files(folder)
        return sorted(((int(f.base_name[6:]), f.path, system) for f in found if f.base_name.startswith("first=")), key=lambda x: x[0])

    def rows(self, of: Range) -> Iterator[pa.RecordBatch]:
        """A range's rows in order of the key; the first page with fewer rows than a full one is the last."""
        pages = self.pages(of.folder)
        for i, (first, path, system) in enumerate(pages):
            if of.upto is not None and first > of.upto:
                return
            if of.after is not None and i + 1 < len(pages) and pages[i + 1][0] <= of.after + 1:
                continue  # all its keys are known
            page = ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=False).to_table(columns=self.kind.names).cast(self.kind).sort_by(self.key)
            full = page.num_rows >= self.page
            keys = page[self.key].to_numpy()
            low = 0 if of.after is None else int(keys.searchsorted(of.after, side="right"))
            high = len(keys) if of.upto is None else int(keys.searchsorted(of.upto, side="right"))
            yield from page.slice(low, max(0, high - low)).combine_chunks().to_batches()
            if not full:
                return


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [Range(f, self.after) for f in self.ranges()] or [Range(f"{self.where}/range=none", self.after)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class _StreamReader(_Pages, DataSourceStreamReader):
    """Offsets are keys: a batch has the rows above the last batch's largest key."""

    def initialOffset(self) -> dict:
        return {"after": self.after}

    def latestOffset(self) -> dict:
        tops = []
        for folder in self.ranges():
            for _, path, system in self.pages(folder)[-1:]:
                keys = ds.dataset(path, filesystem=system, format="parquet", exclude_invalid_files=False).to_table(columns=[self.key])[self.key]
                tops += [max(keys.to_pylist())] if len(keys) else []
        return {"after": max(tops, default=self.after)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(f, start["after"], end["after"]) for f in self.ranges()] or [Range(f"{self.where}/range=none", None)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class LandedPages(DataSource):
    """Options: path; key, a column of whole numbers; page, the rows of a full page; after, a key beyond which reading goes on."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> StructType:
        raise ValueError("landed pages need a schema")

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes format("landed_pages") known; the code goes along with the plan, so executors need not have it."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(LandedPages)


def land(rows: DataFrame, key: str, path: str, width: int, page: int = PAGE) -> None:
    """Writes rows as pages: ranges of `width` keys, and in each range pages of `page` rows in order of the key."""
    from ..operators.pages import PageIndex

    ranged = rows.withColumn("range", F.floor(F.col(key) / width))
    placed = PageIndex.build(ranged, F.asc("range"), F.asc(key)).placed("__at")
    starts = placed.groupBy("range").agg(F.min("__at").alias("__from"))
    paged = placed.join(starts, "range").withColumn("__page", F.floor((F.col("__at") - F.col("__from")) / page))
    first: Column = F.min(key).alias("first")
    named = paged.join(paged.groupBy("range", "__page").agg(first), ["range", "__page"]).drop("__at", "__from", "__page")
    named.repartition("range", "first").write.partitionBy("range", "first").parquet(path)


def read_pages(spark: SparkSession, path: str, schema: str, key: str, page: int = PAGE, after: int | None = None) -> DataFrame:
    """The rows of landed pages, a task for each range; only those above the key `after`, if it is given."""
    register(spark)
    options = {"path": path, "key": key, "page": str(page)} | ({} if after is None else {"after": str(after)})
    return spark.read.format("landed_pages").schema(schema).options(**options).load()


def stream_pages(spark: SparkSession, path: str, schema: str, key: str, page: int = PAGE) -> DataFrame:
    """The rows of landed pages as a stream, which goes on after the largest key of its checkpoint."""
    register(spark)
    return spark.readStream.format("landed_pages").schema(schema).options(path=path, key=key, page=str(page)).load()
