"""Readers of landed JSON, of CSV grids by position, and of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import grouped_int, to_int
from ..operators.pages import PageIndex
from ..operators.relational import alias_of, last_by
from . import schemas


def table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; unused columns are pruned by the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table in ranges of its key, read in parallel instead of page by page."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def read_posts(spark: SparkSession, path: str, only_notices: bool = False) -> DataFrame:
    """Posts of landed lists, one row each; a list without boards, or unreadable, gives none."""
    rows = spark.read.schema(schemas.POST_LIST).json(path).select("member_id", F.explode("boards").alias("b"))
    return posts_of(rows.where(F.coalesce("b.is_notice", F.lit(False))) if only_notices else rows)


def posts_of(rows: DataFrame) -> DataFrame:
    """(member_id, b) as columns of posts."""
    return rows.select(
        "member_id",
        F.col("b.title_no").alias("post_id"),
        F.coalesce("b.title_name", F.lit("")).alias("title"),
        F.date_trunc("second", F.try_to_timestamp("b.reg_date")).cast("timestamp_ntz").alias("posted_at"),
        F.coalesce("b.count.read_cnt", F.lit(0)).alias("views"),
        F.coalesce("b.is_pin", F.lit(False)).alias("is_pinned"),
    )


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.POST_BODY).json(path)
    return rows.select("member_id", F.col("title_no").alias("post_id"), F.coalesce("content.content", F.lit("")).alias("body_html"))


def read_parse_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PARSE_RESULT).json(path)


_CELLS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "mode": "PERMISSIVE"}


def csv_cells(line: Column, width: int) -> Column:
    """The first cells of a CSV line as struct<c0,c1,...>: quotes, doubled quotes within them, cells trimmed."""
    cells = ", ".join(f"c{i} string" for i in range(width))
    return F.from_csv(line, cells, {k: str(v) for k, v in _CELLS.items()})


def _grid(spark: SparkSession, path: str, width: int) -> DataFrame:
    """A CSV grid by position, with each line's place: its file, block and number in it. The first line of every file that isn't empty is skipped."""
    lines = spark.read.schema(", ".join(f"c{i} string" for i in range(width))).csv(path, header=True, enforceSchema=True, **_CELLS)
    return lines.select(_place().alias("__line"), *[f"c{i}" for i in range(width)])


def _place() -> Column:
    """The place of a line: files come in order of their paths."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_stats(spark: SparkSession, path: str, group_aliases: dict[str, str], member_aliases: dict[str, str], average: str = "평균") -> DataFrame:
    """The stats grid: group, job, member, skill, level, weapon, armor, pants and boots by position. Rows without a group or a member, and the
    average's, are left out; of a repeated (group, member) the last line counts."""
    g = _grid(spark, path, 12)
    blank: Column = (F.coalesce("c1", F.lit("")) == "") | (F.coalesce("c3", F.lit("")) == "") | (F.col("c1") == average)
    rows = g.where(~blank).select(
        "__line",
        alias_of(F.col("c1"), group_aliases).alias("group"),
        alias_of(F.col("c3"), member_aliases).alias("member"),
        F.nullif("c2", F.lit("")).alias("job"),
        F.nullif("c4", F.lit("")).alias("skill"),
        *[to_int(F.col(c)).alias(n) for c, n in (("c5", "level"), ("c6", "weapon"), ("c9", "armor"), ("c10", "pants"), ("c11", "boots"))],
    )
    return last_by(rows, ["group", "member"], "__line").drop("__line")


def read_ranking(spark: SparkSession, path: str, group_aliases: dict[str, str], member_aliases: dict[str, str]) -> DataFrame:
    """The ranking grid: group, member and score by position; rows without a score are left out, the last of a key counts."""
    g = _grid(spark, path, 21)
    rows = g.select("__line", alias_of(F.col("c17"), group_aliases).alias("group"), alias_of(F.col("c19"), member_aliases).alias("member"), grouped_int(F.col("c20")).alias("power"))
    rows = rows.where((F.coalesce("group", F.lit("")) != "") & (F.coalesce("member", F.lit("")) != "") & F.col("power").isNotNull())
    return last_by(rows, ["group", "member"], "__line").drop("__line")


def roster(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schemas.ROSTER)


def read_roster(spark: SparkSession, path: str, popular: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """A roster from JSON objects {id: {name, tag}, ...}, one a line, or one a file with `whole`; popular has the member_id of popular members.

    `ordinal` numbers members, from 1, in the order in which the callers' language goes through the keys of one object: keys that are whole numbers
    below 2**32 - 1, without leading zeros, come first, in ascending order; the others as they were first written. Of a repeated key the last
    value counts, at the place of the first. A line that can't be read gives no members, a value that is no object no name."""
    lines = spark.read.text(path, wholetext=whole).select(_place().alias("line"), F.from_json("value", "map<string,string>").alias("members"))
    entries = lines.select("line", F.posexplode("members").alias("at", "member_id", "value"))
    entries = entries.select("member_id", F.struct("line", "at").alias("place"), F.from_json("value", schemas.ROSTER_VALUE).alias("info"))
    one = entries.groupBy("member_id").agg(F.min("place").alias("place"), F.max(F.struct("place", "info"))["info"].alias("info"))
    number = F.when(F.rlike("member_id", F.lit("^(0|[1-9][0-9]{0,9})$")) & (F.col("member_id").cast("long") < 2**32 - 1), F.col("member_id").cast("long"))
    placed = PageIndex.build(one.withColumn("number", number), F.asc_nulls_last("number"), F.asc("place")).placed("ordinal")
    rows = placed.select("member_id", "info.name", "info.tag", (F.col("ordinal") + 1).cast("int").alias("ordinal"))
    known = rows.limit(0).select("member_id") if popular is None else popular.select("member_id").distinct()
    marked = rows.join(known.withColumn("popular", F.lit(True)), "member_id", "left")
    return marked.select("member_id", "name", "tag", F.coalesce("popular", F.lit(False)).alias("is_popular"), "ordinal")


def read_images(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """Landed image files, one row each: `name`, by default the path below `path`, else as given of column `path`; `media`, the media type by the name's
    ending, else image/jpeg; `data`, the file in base64. Empty files give no row. Contents are read only where `data` is asked for.

    The driver lists the files and every file is opened by itself, so this suits folders of some 10,000 files; more belong in packs."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    below = F.substring_index(F.col("path"), path.rstrip("/").rsplit("/", 1)[-1] + "/", -1) if name is None else name
    return _pictures(files.select(below.alias("name"), base64_of(F.col("content")).alias("data")))


def base64_of(content: Column) -> Column:
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def _pictures(named: DataFrame) -> DataFrame:
    """(name, data) with the media type."""
    ending = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    return named.select("name", F.coalesce(alias_of(ending, schemas.MEDIA, strict=True), F.lit("image/jpeg")).alias("media"), "data")


def write_packs(images: DataFrame, path: str) -> None:
    """Appends images, of which `name` and `data` count, to packs: JSON lines, many pictures to a file, one file a task, so that the number of files does
    not grow with that of pictures. Rows are read one at a time, so a batch of large pictures is never held; one of 75 MB or more can't be read."""
    images.select("name", "data").write.mode("append").json(path)


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """Pictures of packs, as from `read_images`; those without contents give no row."""
    return _pictures(spark.read.schema(schemas.PACK).json(path).where("data <> ''"))


def images_of(rows: DataFrame, images: DataFrame, landed: Column, key: str = "post_id", urls: str = "images", out: str = "parts") -> DataFrame:
    """rows, each with its own key, with `out`: of each address in `urls`, in order, {media, data} of its landed file, without those that are
    missing. `landed` gives the file's name for the address in column `url`; a file that several rows name is read once."""
    each = rows.select(F.col(key).alias("__key"), F.posexplode(urls).alias("at", "url")).withColumn("name", landed)
    met = each.join(images, "name").groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("at", "media", "data"))).alias("__found"))
    parts = F.transform("__found", lambda x: F.struct(x["media"].alias("media"), x["data"].alias("data")))
    whole = rows.join(met, F.col(key) == F.col("__key"), "left")
    return whole.withColumn(out, F.coalesce(parts, F.array().cast("array<struct<media:string,data:string>>"))).drop("__key", "__found")
