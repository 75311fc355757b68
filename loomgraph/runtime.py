"""Session settings, the shared folder, and cutting lineage by written tables."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Session settings for own sessions; a given session is never changed.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with this library's settings, for tests, the bench and the command line."""
    builder = SparkSession.builder.master(master).appName("loomgraph")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(partitions), **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers of a session, wherever it was started from. Once per session; an installed package needs it not."""
    home = os.path.dirname(os.path.abspath(__file__))
    if getattr(spark.sparkContext, "_loomgraph_shipped", None) == home:
        return
    folder = tempfile.mkdtemp(prefix="loomgraph-code-")  # on the driver alone; Spark hands the archive on
    path = os.path.join(folder, "loomgraph.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, dirs, files in os.walk(home):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                z.write(os.path.join(base, f), os.path.join("loomgraph", os.path.relpath(os.path.join(base, f), home)))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._loomgraph_shipped = home


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset and the master is local, a temporary folder is made once and set; on a cluster
    that is an error, since a machine's own folder dies with the machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomgraph-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame, tag: str, watch: Observation | None = None, *figures, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there. Figures (aggregates) are observed while writing.

    With `by` the table is parted by that column, so that a filter on it reads its part alone.

    The table outlives lost executors. It is removed by release(), or when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{tag}"
    out = df.observe(watch, *figures) if watch is not None else df
    writer = out.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    jpath, fs = _path(spark, path)
    fs.deleteOnExit(jpath)
    back = spark.read.schema(df.schema).parquet(path)
    back.loom_path = path
    return back


def release(df: DataFrame) -> None:
    """Remove the table behind a result of cut() that nothing will read again."""
    path = getattr(df, "loom_path", None)
    if path:
        jpath, fs = _path(df.sparkSession, path)
        fs.delete(jpath, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system Spark can use; none where there is no such folder."""
    jpath, fs = _path(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(jpath)] if fs.exists(jpath) else []


def remove(spark: SparkSession, path: str) -> None:
    jpath, fs = _path(spark, path)
    fs.delete(jpath, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that are over; else they stay until the driver happens to collect its garbage."""
    spark.sql("SELECT 1").collect()  # no job, but the listeners hold the last query they heard of, and with it its shuffle
    gc.collect()
    spark._jvm.System.gc()


def local(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """A few rows of the driver as a table that is planned and read without a Python worker."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow), kind)


def sweep(spark: SparkSession, hours: float = 48.0) -> list[str]:
    """Remove what sessions that broke off left in the shared folder: tables of other applications not touched for so many hours. Their application ids."""
    base, gone = f"{shared_dir(spark)}/loomgraph", []
    for name in children(spark, base):
        jpath, fs = _path(spark, f"{base}/{name}")
        idle = time.time() - fs.getFileStatus(jpath).getModificationTime() / 1000
        if name != spark.sparkContext.applicationId and idle > hours * 3600:
            fs.delete(jpath, True)
            gone.append(name)
    return gone


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
