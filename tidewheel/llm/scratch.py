"""Where intermediate tables go: the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only where none is set and the master is local, as in tests, one is made."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tidewheel-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/tidewheel/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes tables that `stored` wrote, once nothing reads them any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(conf).delete(path, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, made longer where a column has one of them; case doesn't count."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


#: Bytes of a batch of rows that a Python worker is given, where the session has not set it: a worker holds some copies of a batch.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a Spark context: for drivers whose executors have it not installed. Bounds workers' batches."""
    context = spark.sparkContext
    if BATCH[0] not in dict(context.getConf().getAll()):
        spark.conf.set(BATCH[0], str(BATCH[1]))
    if getattr(context, "_tidewheel_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    where = Path(tempfile.mkdtemp(prefix="tidewheel-")) / "tidewheel.zip"
    with zipfile.ZipFile(where, "w") as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, file.relative_to(top.parent))
    context.addPyFile(str(where))  # from the driver's own folder to every executor
    context._tidewheel_shipped = True
