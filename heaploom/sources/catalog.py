"""Dumps stored as Parquet below one folder of any file system that Spark reads."""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dump import HeapDump
from ..operators.dag import GraphIndex
from ..plans.storage import Scratch, create_once, filesystem, read_small
from ..schema import Precision
from .jsonl import ORDER, newest, parse_jsonl

#: Columns of the tables that dumps are stored in.
TABLES = {
    "objects": "id long, type string, value string, size long, subtree_size long, is_skip boolean",
    "refs": "src long, pos int, dst long",
    "referrers": "dst long, src long",
}


class DumpExists(ValueError):
    """A dump of that name is there already."""


def _quoted(name: str) -> str:
    """A name as part of a path, as Spark writes values of partitions."""
    return re.sub(r"""[\x00-\x1F"#%'*/:=?\\\x7F{\[\]^]""", lambda m: f"%{ord(m.group()):02X}", name)


class Catalog:
    """<root>/<table>/dump_name=<name>/version=<version> for each table, and a pointer <root>/_names/<name> for each dump.

    Tables of all dumps are one table each, partitioned by dump_name.  An import writes a version of its own and then creates the pointer, which only one of several
    writers can: until then nobody sees the version, and no folder is ever renamed.

    objects are sorted by type and id, with a Bloom filter for look-ups by id alone; refs by source; referrers are the refs by target, once each.  So Parquet's
    statistics let listings and look-ups in either direction skip most row groups.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- names ---------------------------------------------------------------------

    def _pointer(self, name: str) -> dict | None:
        """What the pointer of a dump holds; None without one, or while it is being written."""
        path = f"{self.root}/_names/{_quoted(name)}"
        fs, hpath = filesystem(self.spark, path)
        if not fs.exists(hpath):
            return None
        text = read_small(self.spark, path)
        return json.loads(text) if text.endswith("\n") else None

    def _exists(self, name: str) -> bool:
        fs, path = filesystem(self.spark, f"{self.root}/_names/{_quoted(name)}")
        return fs.exists(path)

    def list_dumps(self) -> list[str]:
        fs, path = filesystem(self.spark, f"{self.root}/_names")
        if not fs.exists(path):
            return []
        found = (unquote(s.getPath().getName()) for s in fs.listStatus(path) if not s.getPath().getName().startswith("."))
        return sorted(n for n in found if self._pointer(n))

    def _check(self, name: str) -> None:
        if not name or "/" in name or "\\" in name or name.startswith("."):
            raise ValueError(f"{name!r} is no name for a dump")
        if self._exists(name):
            raise DumpExists(f"there is a dump named {name!r}")

    def default_name(self, path: str | None = None) -> str:
        """The file's name without its last ending; without a file (or for a hidden one) the next number."""
        file = (path or "").rstrip("/").rpartition("/")[2]
        stem = file.rpartition(".")[0] or file
        return stem if stem and not stem.startswith(".") else f"heap_dump_{len(self.list_dumps()) + 1}"

    # -- imports -------------------------------------------------------------------

    def _folder(self, table: str, name: str, version: str) -> str:
        return f"{self.root}/{table}/dump_name={_quoted(name)}/version={version}"

    def import_records(self, records: DataFrame, name: str, precision: Precision | str = Precision.MEDIUM, source: str | None = None, kept: bool = False, single: bool = False) -> HeapDump:
        """Derive the tables and publish them under the name: readers see all or nothing, and of several writers of a name one wins, the others get DumpExists.

        ``source`` is noted with the dump and read back by :meth:`source_of`.  ``kept``: the records are read from a stored table, and are not stored again.
        ``single``: no id has several records, so links that are told apart within their record need not be told apart again.
        """
        self._check(name)
        version, published = uuid.uuid4().hex, False
        try:
            with Scratch(self.spark, "records") as work:
                records = records if kept else work.keep(records)
                dump = HeapDump.from_records(records, precision, index_path=self._folder("_index", name, version), kept=True)
                objects = dump.objects.repartitionByRange("type", "id").sortWithinPartitions("type", "id")
                objects.write.option("compression", "zstd").option("parquet.bloom.filter.enabled#id", "true").parquet(self._folder("objects", name, version))
                # References are dealt out and sorted record by record, before there is a row for each.
                sources = records.select(F.col("id").alias("src"), "references").where("size(references) > 0").repartitionByRange("src").sortWithinPartitions("src")
                sources.select("src", F.posexplode("references").alias("pos", "dst")).write.option("compression", "zstd").parquet(self._folder("refs", name, version))
                # Equal links of a range are in one partition, so they need no shuffle of their own.
                back = records.select(F.explode(F.array_distinct("references")).alias("dst"), F.col("id").alias("src")).repartitionByRange("dst", "src")
                back = back if single else back.distinct()
                back.sortWithinPartitions("dst", "src").write.parquet(self._folder("referrers", name, version))
            published = create_once(self.spark, f"{self.root}/_names/{_quoted(name)}", json.dumps({"version": version, "source": source}) + "\n")
            if not published:
                raise DumpExists(f"there is a dump named {name!r}")
        finally:
            if not published:
                for table in (*TABLES, "_index"):
                    fs, path = filesystem(self.spark, self._folder(table, name, version))
                    fs.delete(path, True)
        return self.open(name)

    def source_of(self, name: str) -> str | None:
        """The file that a dump was imported from, if that was noted."""
        return (self._pointer(name) or {}).get("source")

    def import_once(self, records: DataFrame, source: str, precision: Precision | str = Precision.MEDIUM) -> str:
        """Import a file under its default name unless that was done before; returns the name.

        Where another file has the name, the next free one of name_2, name_3, ... is taken.
        """
        base = name = self.default_name(source)
        number = 1
        while self._exists(name):
            if self.source_of(name) == source:
                return name
            number += 1
            name = f"{base}_{number}"
        self.import_records(records, name, precision, source)
        return name

    def import_dump(self, path: str, name: str | None = None, precision: Precision | str = Precision.MEDIUM) -> HeapDump:
        """Import JSON-lines files.  Unknown precisions mean medium; the name defaults to that of the file."""
        name = name or self.default_name(path)
        self._check(name)
        with Scratch(self.spark, "lines") as work:
            records = newest(work, work.keep(parse_jsonl(self.spark, path)), ORDER)
            return self.import_records(records, name, precision, path, kept=True, single=True)

    # -- reading -------------------------------------------------------------------

    def open(self, name: str) -> HeapDump:
        pointer = self._pointer(name)
        if pointer is None:
            raise KeyError(name)
        read = {t: self.spark.read.schema(c).parquet(self._folder(t, name, pointer["version"])) for t, c in TABLES.items()}
        index = self._folder("_index", name, pointer["version"])
        fs, path = filesystem(self.spark, f"{index}/sizes")
        return HeapDump(read["objects"], read["refs"], GraphIndex(self.spark, index) if fs.exists(path) else None, read["referrers"])

    def table(self, table: str = "objects") -> DataFrame:
        """objects, refs or referrers of all dumps, with dump_name: filters on it read only the dumps they name."""
        schema = T.StructType([*T.StructType.fromDDL(TABLES[table]).fields, T.StructField("dump_name", T.StringType()), T.StructField("version", T.StringType())])
        paths = [self._folder(table, n, self._pointer(n)["version"]) for n in self.list_dumps()]
        if not paths:
            return self.spark.createDataFrame([], schema).drop("version")
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths).drop("version")

    def compare(self, first: str, second: str) -> DataFrame:
        """(type, count_first, count_second, size_first, size_second, growth): objects and bytes of two dumps by type; KeyError for unknown ones."""
        for name in (first, second):
            if not self._exists(name):
                raise KeyError(name)
        both = self.table("objects").where(F.col("dump_name").isin(first, second))
        per = both.groupBy("type").agg(
            *[F.count_if(F.col("dump_name") == n).alias(f"count_{k}") for k, n in (("first", first), ("second", second))],
            *[F.coalesce(F.sum(F.when(F.col("dump_name") == n, F.col("size"))), F.lit(0)).cast("long").alias(f"size_{k}") for k, n in (("first", first), ("second", second))],
        )
        return per.withColumn("growth", F.col("size_second") - F.col("size_first"))
