"""Keeping intermediate tables where driver and executors both see them."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many narrow rows may be broadcast.
BROADCAST_ROWS = 400_000
#: So many keys are looked up by a filter (Spark's Parquet reader takes a longer list as its least and largest value).
HANDFUL = 10


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or what setCheckpointDir was given.

    Only a local session with neither gets a temporary folder; on a cluster a RuntimeError is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            found = jdir.get()
        elif spark.sparkContext.master.startswith("local"):
            found = Path(tempfile.mkdtemp(prefix="heaploom-")).as_uri()
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows once and cut their lineage, so iterations neither recompute nor grow plans."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once as Parquet in the shared folder and read them from there: later readers read only the columns and row groups they need."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one job as Parquet in the shared folder, deleted together when the job is over.

    ``with Scratch(spark, "name") as work: kept = work.keep(df)`` writes the rows once and cuts their lineage; later readers read only the
    columns they need, and Spark knows the table's size.  What outlives the block has to be kept elsewhere (see :func:`cut`).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.number = spark, fresh_path(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        fs, path = filesystem(self.spark, self.root)
        fs.delete(path, True)

    def path(self) -> str:
        self.number += 1
        return f"{self.root}/{self.number}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file if there is none of that path; False if there is.  Of several writers exactly one succeeds.

    Local files are created exclusively; for others the file system's create without overwriting decides, as object stores and HDFS do it.
    """
    fs, hpath = filesystem(spark, path)
    fs.mkdirs(hpath.getParent())
    if fs.getUri().getScheme() == "file":
        try:
            with Path(hpath.toUri().getPath()).open("x", encoding="utf-8") as out:
                out.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(hpath, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getSimpleName() or fs.exists(hpath):
            return False
        raise
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return True


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, hpath = filesystem(spark, path)
    stream = fs.open(hpath)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint to broadcast a kept table if it is proven small; otherwise leave the join to shuffle."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def looked_up(df: DataFrame, key: str, among: DataFrame, rows: int) -> DataFrame:
    """The rows of ``df`` whose key is among those of a kept table of so many rows, joined with it.

    A handful of keys is a filter too, which Parquet's statistics answer without reading most of a table that is stored by the key; of more keys that
    may be broadcast, the least and the largest are.
    """
    if rows <= HANDFUL:
        df = df.where(F.col(key).isin([r[0] for r in among.select(key).distinct().collect()]))
    elif rows <= BROADCAST_ROWS:
        df = df.where(F.col(key).between(*among.agg(F.min(key), F.max(key)).first()))
    return df.join(sized(among, rows), key)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath
