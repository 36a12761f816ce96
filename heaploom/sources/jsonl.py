"""Reading and writing JSON-lines dumps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import Scratch, fresh_path, sized
from ..schema import RAW, REQUIRED
from .archive import archive_lines

_READ = T.StructType([*RAW.fields, T.StructField("_corrupt", T.StringType())])
#: Which line of a file is last: columns of lines that are not told apart yet.
ORDER = ["_file", "_line"]
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


class BadRecord(ValueError):
    """A line that is no record; the whole import is refused."""


def _parsed(lines: DataFrame) -> DataFrame:
    """Lines (column value, and order columns) to records, not yet checked."""
    record = F.from_json("value", _READ, _OPTIONS).alias("r")
    others = [c for c in lines.columns if c != "value"]
    return lines.where(F.trim("value") != "").select(*others, F.col("value").alias("_text"), record).select(*others, "_text", "r.*")


def _why() -> F.Column:
    """What is wrong with a parsed record; null if nothing is."""
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED], F.when(F.exists("references", lambda x: x.isNull()), F.lit("references")))
    return F.when(F.col("_corrupt").isNotNull(), F.lit("malformed")).when(missing.isNotNull(), F.concat(F.lit("missing "), missing))


def validate(records: DataFrame) -> DataFrame:
    """The same records; the first bad line stops the job that reads them with an error.

    Bad are malformed lines (also ids of 2**63 and more) and those without id, type, references or size,
    or with a null among the references.
    """
    why = _why()
    text = F.concat(F.lit("bad record ("), why, F.lit("): "), F.coalesce("_text", F.lit("")))
    checked = F.when(why.isNotNull(), F.raise_error(F.substring(text, 1, 500)).cast("long")).otherwise(F.col("id"))
    return records.withColumn("id", checked).drop("_corrupt", "_text")


def last_wins(records: DataFrame, order: list[str]) -> DataFrame:
    """One record per id: that of the last line."""
    newest = Window.partitionBy("id").orderBy(*[F.desc(c) for c in order])
    return records.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", *order)


def newest(work: Scratch, records: DataFrame, order: list[str]) -> DataFrame:
    """The rows of :func:`last_wins` of a kept table, kept: all ids are shuffled, but of the records only those whose id is repeated."""
    repeated = work.keep(records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    n = repeated.count()
    if not n:
        return records.drop(*order)
    again = sized(repeated, n)
    last = last_wins(records.join(again, "id", "left_semi"), order)
    return work.keep(records.join(again, "id", "left_anti").drop(*order).unionByName(last))


def parse_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of JSON-lines files, checked, with their ORDER; an id may have several.  Blank lines are skipped, compressed files are read by their suffix."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_line"))
    return validate(_parsed(lines))


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of JSON-lines files, checked, one per id (the last line of the last file wins).  Blank lines are skipped."""
    return last_wins(parse_jsonl(spark, path), ORDER)


def read_lines(spark: SparkSession, lines: Iterable[bytes]) -> DataFrame:
    """Records of lines held in memory (bytes), checked, one per id."""
    rows = []
    for n, line in enumerate(lines):
        if not isinstance(line, bytes | bytearray):
            raise TypeError("lines must be bytes")
        rows.append((bytes(line).decode("utf-8"), n))
    return last_wins(validate(_parsed(spark.createDataFrame(rows, "value string, _line long"))), ["_line"])


def archive_problems(spark: SparkSession, path: str) -> DataFrame:
    """(archive, dump_name, problem): what :func:`read_archive` skips, with the first problem of each member (a null name: of an archive before any)."""
    lines = archive_lines(spark, path)
    broken = lines.where("problem IS NOT NULL").select("archive", "dump_name", "_line", "problem")
    bad = _parsed(lines.where("problem IS NULL").drop("problem")).withColumn("problem", _why()).where("problem IS NOT NULL").select("archive", "dump_name", "_line", F.concat(F.lit("bad record: "), "problem").alias("problem"))
    return broken.unionByName(bad).groupBy("archive", "dump_name").agg(F.min_by("problem", "_line").alias("problem"))


def read_archive(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records of archives of dumps, with dump_name: the file name of each member without its suffix.

    An archive is one stream: one task reads it from front to end and holds a batch of lines at a time, however large it is.  With ``strict``, a bad record, an
    undecodable line or a damaged archive stops the job; without, such members are left out as a whole (see :func:`archive_problems`).  Members that are no
    .jsonl files are passed over.  Of members of one name in several archives, later archives (by path) win record by record.
    """
    lines = archive_lines(spark, path)
    if strict:
        problem = F.raise_error(F.concat(F.lit("bad archive "), "archive", F.lit(": "), "problem")).cast("string")
        lines = lines.withColumn("value", F.when(F.col("problem").isNotNull(), problem).otherwise(F.col("value")))
    else:
        lines = lines.where("problem IS NULL").join(archive_problems(spark, path).select("archive", "dump_name"), ["archive", "dump_name"], "left_anti")
    records = validate(_parsed(lines.drop("problem")))
    newest = Window.partitionBy("dump_name", "id").orderBy(F.desc("archive"), F.desc("_line"))
    return records.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_line", "archive")


def write_jsonl(records: DataFrame, path: str | None = None, compression: str = "none") -> str:
    """Write records as JSON lines (absent values stay absent); Spark's committer publishes all files or none.

    ``compression``: also gzip and what else Spark writes texts with; a compressed file is read by one task.
    """
    path = path or fresh_path(records.sparkSession, "jsonl")
    records.write.option("ignoreNullFields", "true").option("compression", compression).json(path)
    return path
