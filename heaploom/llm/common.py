"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text whose A-Z were lower-cased, as UTF-8 bytes (bytes from 0x80 on are word bytes).
WORD_BYTES = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same over characters, for Java's regular expressions, before lower-casing.
WORD_JAVA = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Tables of at most so many numbers and short keys (some 20 MB) are broadcast; larger ones shuffle.
BROADCAST_CELLS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what setCheckpointDir was given.

    Where neither is set, a local session gets a temporary folder; on a cluster a RuntimeError is raised, as no
    folder of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            found = jdir.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            found = Path(tempfile.mkdtemp(prefix="heaploom-")).as_uri()
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once and cut their lineage."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def hinted(df: DataFrame) -> DataFrame:
    """Hint to broadcast a kept table of narrow columns if it is proven small."""
    return F.broadcast(df) if df.count() * len(df.columns) <= BROADCAST_CELLS else df


def sized(df: DataFrame) -> DataFrame:
    """Cut a table of narrow columns, and hint to broadcast it if it is proven small."""
    return hinted(cut(df))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def content_key(column) -> F.Column:
    """128 bits that stand for a text: equal texts, equal keys (null counts as empty)."""
    return F.unhex(F.substring(F.sha2(F.coalesce(column, F.lit("")), 256), 1, 32))


class Workspace:
    """Tables of one job as compressed Parquet in the shared folder, deleted together when the job is over.

    ``with Workspace(spark, "name") as work: kept = work.keep(df)`` writes the rows once and cuts their lineage; a
    later reader reads only the columns that it needs.  What outlives the block has to be kept elsewhere (see :func:`cut`).
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.number = spark, fresh_path(spark, name), 0

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self.number += 1
        path = f"{self.root}/{self.number}"
        cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(cleanup, "false")
        try:
            # Once the rows are written, nobody reads the shuffle files again.
            self.spark.conf.set(cleanup, "true")
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(cleanup, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def sized(self, df: DataFrame) -> DataFrame:
        """Keep a table of narrow columns, and hint to broadcast it if it is proven small."""
        return hinted(self.keep(df))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand at most so many rows at once to Python: whole texts and lists weigh much more than Spark's default expects."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Hand at most so many rows at once to Python within the block, whose jobs have to end in it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work, after which a Python worker gives its memory back: it idles while other stages need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run
