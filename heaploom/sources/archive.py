"""Archives (.tar, .tar.gz, ...) of dumps as a Python data source that streams them from where they lie."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Lines and bytes of a batch that the reader hands on.
BATCH_LINES, BATCH_BYTES = 10_000, 8 << 20
_COLUMNS = ("archive", "dump_name", "value", "_line", "problem")


@dataclass
class Archive(InputPartition):
    path: str


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def archives_at(path: str) -> list[str]:
    """The files of a folder, of a pattern (* and ? in the last part), or the file itself."""
    fs, inner = _opened(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    folder, _, last = inner.rpartition("/")
    if "*" in last or "?" in last:
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(folder)) if f.is_file and fnmatch(f.base_name, last)]
    elif fs.get_file_info(inner).type == pafs.FileType.Directory:
        found = [f.path for f in fs.get_file_info(pafs.FileSelector(inner)) if f.is_file and not f.base_name.startswith((".", "_"))]
    elif fs.get_file_info(inner).is_file:
        found = [inner]
    else:
        raise FileNotFoundError(path)
    return sorted(prefix + f for f in found)


def lines_of(path: str) -> Iterator[tuple[str | None, str | None, int, str | None]]:
    """(dump_name, line, number, problem) of an archive, read from front to end; a problem has no line.

    Members that are no .jsonl files are passed over.  What cannot be decoded spoils its member, and a damaged archive its last member.
    """
    fs, inner = _opened(path)
    name, number = None, 0
    try:
        with fs.open_input_stream(inner, compression=None) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
            for member in tar:
                if not member.isfile() or not member.name.endswith(".jsonl"):
                    continue
                name, number = PurePosixPath(member.name).stem, 0
                for raw in tar.extractfile(member):
                    try:
                        yield name, raw.decode("utf-8").rstrip("\r\n"), number, None
                    except UnicodeDecodeError as e:
                        yield name, None, number, f"line {number} is not UTF-8: {e.reason}"
                    number += 1
    except (tarfile.TarError, EOFError, OSError, ValueError) as e:
        yield name, None, number, f"damaged archive: {type(e).__name__}: {e}"


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [Archive(p) for p in archives_at(self.path)]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=list(_COLUMNS))

        for name, line, number, problem in lines_of(partition.path):
            held.append((partition.path, name, line, number, problem))
            size += len(line or "")
            if len(held) >= BATCH_LINES or size >= BATCH_BYTES:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class ArchiveSource(DataSource):
    """``spark.read.format("dump_archive").load(path)``: the lines of all dumps in archives, each archive streamed by one task."""

    @classmethod
    def name(cls) -> str:
        return "dump_archive"

    def schema(self) -> str:
        return "archive string, dump_name string, value string, _line long, problem string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (archive, dump_name, value, _line, problem) of archives: a file, a folder or a pattern, on any file system that pyarrow opens."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("dump_archive").load(path)
