"""Import of JSON lines, bad records, archives, the catalog and arrivals."""

import io
import json
import tarfile
import threading
import tracemalloc
from concurrent.futures import ThreadPoolExecutor

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from heaploom.functions.rules import bytes_value, is_skip, module_value, truncate_value, type_name
from heaploom.schema import Precision
from heaploom.sources.archive import Archive, ArchiveReader
from heaploom.sources.catalog import Catalog, DumpExists
from heaploom.sources.jsonl import archive_problems, read_archive, read_jsonl, read_lines
from heaploom.streaming.arrivals import import_arrivals

GOOD = {"id": 1, "type": "a.B", "references": [2, 2], "size": 3, "value": "x"}


def rows(spark, *records):
    return read_lines(spark, [r if isinstance(r, bytes) else json.dumps(r).encode() for r in records]).collect()


def test_defaults_and_last_line_wins(spark):
    found = rows(spark, GOOD, b"", {"id": 2, "type": "c", "references": [], "size": 0, "extra": 1}, {**GOOD, "type": "later"})
    assert {r["id"]: (r["type"], r["references"], r["value"]) for r in found} == {1: ("later", [2, 2], "x"), 2: ("c", [], None)}
    assert rows(spark, {**GOOD, "value": 42})[0]["value"] == "42"


@pytest.mark.parametrize("bad", [b"{nonsense", {k: v for k, v in GOOD.items() if k != "references"}, {**GOOD, "id": 2**63}, {**GOOD, "references": [None]}])
def test_bad_records_stop_the_import(spark, bad):
    with pytest.raises(Exception, match="bad record"):
        rows(spark, GOOD, bad)


def test_lines_must_be_bytes(spark):
    with pytest.raises(TypeError):
        read_lines(spark, ["{}"])


def test_files_and_empty_file(spark, tmp_path):
    (tmp_path / "one.jsonl").write_text(json.dumps(GOOD) + "\n")
    (tmp_path / "two.jsonl").write_text("")
    assert read_jsonl(spark, str(tmp_path / "one.jsonl")).count() == 1
    assert read_jsonl(spark, str(tmp_path / "two.jsonl")).count() == 0


def test_archive(spark, tmp_path):
    with tarfile.open(tmp_path / "dumps.tar.gz", "w:gz") as tar:
        for pid, text in ((7, json.dumps(GOOD) + "\n"), (8, json.dumps({**GOOD, "id": 5}) + "\n" + json.dumps(GOOD) + "\n")):
            info = tarfile.TarInfo(f"dump_{pid}.jsonl")
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    found = read_archive(spark, str(tmp_path / "dumps.tar.gz")).collect()
    assert sorted((r["dump_name"], r["id"]) for r in found) == [("dump_7", 1), ("dump_8", 1), ("dump_8", 5)]


def archive(path, members):
    with tarfile.open(path, "w:gz") as tar:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text))


def test_bad_members_of_archives_are_reported_and_skipped(spark, tmp_path):
    good, other = json.dumps(GOOD).encode() + b"\n", json.dumps({**GOOD, "id": 5}).encode() + b"\n"
    folder = tmp_path / "in"
    folder.mkdir()
    archive(folder / "a.tar.gz", {"good.jsonl": good, "garbled.jsonl": other + b"\xff\xfe\n", "broken.jsonl": other + b"{", "notes.txt": b"no dump"})
    archive(folder / "b.tar.gz", {"good.jsonl": other, "late.jsonl": good * 30_000})
    whole = (folder / "b.tar.gz").read_bytes()
    (folder / "c.tar.gz").write_bytes(whole[: len(whole) * 2 // 3])
    (folder / "d.tar.gz").write_bytes(b"nothing of the kind")
    found = {(r["dump_name"], r["id"]) for r in read_archive(spark, str(folder), strict=False).collect()}
    assert found == {("good", 1), ("good", 5), ("late", 1)}
    problems = {(r["archive"].rpartition("/")[2], r["dump_name"]): r["problem"] for r in archive_problems(spark, str(folder)).collect()}
    assert set(problems) == {("a.tar.gz", "garbled"), ("a.tar.gz", "broken"), ("c.tar.gz", "late"), ("d.tar.gz", None)}
    assert "not UTF-8" in problems["a.tar.gz", "garbled"] and "malformed" in problems["a.tar.gz", "broken"] and "damaged" in problems["c.tar.gz", "late"]
    with pytest.raises(Exception, match="bad archive"):
        read_archive(spark, str(folder / "c.*")).count()
    with pytest.raises(Exception, match="nowhere"):
        read_archive(spark, str(tmp_path / "nowhere.tar.gz")).count()
    assert read_archive(spark, (folder / "b.tar.gz").as_uri()).count() == 2


def test_archives_are_streamed(tmp_path):
    # 300 MB of lines in an archive of some 300 KB: the reader holds a batch at a time.
    line = json.dumps({**GOOD, "value": "x" * 1000}).encode() + b"\n"
    archive(tmp_path / "large.tar.gz", {"large.jsonl": line * 280_000})
    tracemalloc.start()
    lines = sum(b.num_rows for b in ArchiveReader("").read(Archive(str(tmp_path / "large.tar.gz"))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lines == 280_000 and peak < 100e6


def test_one_of_two_writers_wins(spark, tmp_path):
    catalog = Catalog(spark, (tmp_path / "dumps").as_uri())
    both = threading.Barrier(2)

    class Late(Catalog):
        def _check(self, name):
            super()._check(name)
            both.wait(60)

    def write(k):
        records = read_lines(spark, [json.dumps({**GOOD, "id": k, "references": []}).encode()])
        try:
            Late(spark, catalog.root).import_records(records, "app", "none")
        except DumpExists:
            return None
        return k

    with ThreadPoolExecutor(2) as pool:
        won = [k for k in pool.map(write, (1, 2)) if k]
    assert len(won) == 1 and [r["id"] for r in catalog.open("app").objects.collect()] == won
    # The loser's tables are gone, and a version without a pointer is seen by nobody.
    assert len(list((tmp_path / "dumps" / "objects" / "dump_name=app").iterdir())) == 1
    (tmp_path / "dumps" / "_names" / "app").unlink()
    assert catalog.list_dumps() == [] and catalog.table().count() == 0
    (tmp_path / "dumps" / "_names" / "app").write_text('{"version": "half')
    assert catalog.list_dumps() == []
    with pytest.raises(KeyError):
        catalog.open("app")


def test_one_table_over_dumps(spark, tmp_path):
    catalog = Catalog(spark, (tmp_path / "dumps").as_uri())
    first = [GOOD, {**GOOD, "id": 2, "type": "gone", "references": []}]
    second = [{**GOOD, "size": 30}, {**GOOD, "id": 3, "type": "new", "size": 5}, {**GOOD, "id": 4, "type": "new", "size": 6}]
    for name, records in (("a b=1", first), ("2024", second), ("third", first)):
        catalog.import_records(read_lines(spark, [json.dumps(r).encode() for r in records]), name, "none")
    assert catalog.list_dumps() == ["2024", "a b=1", "third"]
    counts = {r["dump_name"]: r["count"] for r in catalog.table().groupBy("dump_name").count().collect()}
    assert counts == {"2024": 3, "a b=1": 2, "third": 2}
    one = catalog.table("refs").where("dump_name = '2024'")
    assert one.count() == 6 and "PartitionFilters: [isnotnull(dump_name" in one._jdf.queryExecution().toString()
    found = {r["type"]: tuple(r)[1:] for r in catalog.compare("a b=1", "2024").collect()}
    assert found == {"a.B": (1, 1, 3, 30, 27), "gone": (1, 0, 3, 0, -3), "new": (0, 2, 0, 11, 11)}
    with pytest.raises(KeyError):
        catalog.compare("a b=1", "none")


def test_look_ups_read_few_row_groups(spark, tmp_path):
    n = 40_000
    records = spark.range(n).select("id", F.concat(F.lit("t"), F.col("id") % 50).alias("type"), F.array((F.col("id") * 7919) % n, F.lit(5).cast("long")).alias("references"), F.lit(None).cast("string").alias("value"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("long").alias("subtree_size"))
    spark.conf.set("parquet.block.size", 16 * 1024)
    spark.conf.set("parquet.page.row.count.limit", 500)
    try:
        dump = Catalog(spark, (tmp_path / "dumps").as_uri()).import_records(records, "app", "none")
    finally:
        spark.conf.unset("parquet.block.size")
        spark.conf.unset("parquet.page.row.count.limit")
    groups = [pq.ParquetFile(f).metadata.row_group(k) for f in (tmp_path / "dumps" / "referrers").rglob("*.parquet") for k in range(pq.ParquetFile(f).metadata.num_row_groups)]
    holding = [g for g in groups if g.column(0).statistics.min <= 777 <= g.column(0).statistics.max]
    assert len(groups) > 20 and len(holding) <= 2
    blooms = [pq.ParquetFile(f).metadata.row_group(0) for f in (tmp_path / "dumps" / "objects").rglob("*.parquet")]
    assert blooms and len(blooms) == sum(b"id" in f.read_bytes() for f in (tmp_path / "dumps" / "objects").rglob("*.parquet"))

    def rows_read(df):
        df.collect()
        nodes, total = [df._jdf.queryExecution().executedPlan()], 0
        while nodes:
            node = nodes.pop()
            nodes += [node.children().apply(k) for k in range(node.children().size())]
            if node.getClass().getSimpleName() == "FileSourceScanExec":
                total += node.metrics().apply("numOutputRows").value()
        return total

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert rows_read(dump.referrers.where("dst = 777")) <= 2 * max(g.num_rows for g in groups) < n
        assert rows_read(dump.objects.where("id = 777")) < n / 4
        assert rows_read(dump.objects.where("id = -1")) < n / 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    detail = dump.object(5).first()
    assert len(detail["referrers"]) == n and [r["id"] for r in detail["references"]] == [5 * 7919 % n, 5]


def test_catalog(spark, tmp_path):
    (tmp_path / "first.jsonl").write_text("\n".join(json.dumps(r) for r in (GOOD, {**GOOD, "id": 2, "references": []})))
    catalog = Catalog(spark, (tmp_path / "dumps").as_uri())
    assert catalog.list_dumps() == [] and catalog.default_name() == "heap_dump_1"
    names = {"/in/app.jsonl": "app", "/in/app.v1.jsonl": "app.v1", "plain": "plain", "/in/.hidden.jsonl": "heap_dump_1"}
    assert {p: catalog.default_name(p) for p in names} == names
    dump = catalog.import_dump(str(tmp_path / "first.jsonl"), precision="exact")
    assert catalog.list_dumps() == ["first"]
    assert {r["id"]: r["subtree_size"] for r in dump.objects.collect()} == {1: 6, 2: 3}
    assert [r["id"] for r in dump.object(1).first()["references"]] == [2, 2]
    with pytest.raises(DumpExists):
        catalog.import_dump(str(tmp_path / "first.jsonl"))
    for name in ("a/b", "a\\b", ".a"):
        with pytest.raises(ValueError, match="no name"):
            catalog.import_dump(str(tmp_path / "first.jsonl"), name)
    with pytest.raises(KeyError):
        catalog.open("none")
    (tmp_path / "bad.jsonl").write_text("{")
    with pytest.raises(Exception, match="bad record"):
        catalog.import_dump(str(tmp_path / "bad.jsonl"))
    assert catalog.list_dumps() == ["first"] and not list((tmp_path / "dumps").rglob("dump_name=bad/version*"))
    # The condensed graph is stored, too, and serves later questions.
    again = catalog.open("first")
    assert again._index is not None and [r["id"] for r in again.largest_common_reachable(1, 1).collect()] == [1]


def test_strict_object(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text(json.dumps(GOOD))
    dump = Catalog(spark, (tmp_path / "c").as_uri()).import_dump(str(tmp_path / "d.jsonl"), precision=Precision.NONE)
    with pytest.raises(LookupError):
        dump.object(1)
    assert dump.object(1, strict=False).first()["references"] == []
    assert [(r["src"], r["dst"]) for r in dump.dangling_references().collect()] == [(1, 2), (1, 2)]


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p1.jsonl").write_text(json.dumps(GOOD))
    catalog = Catalog(spark, (tmp_path / "dumps").as_uri())
    for expected in (["p1"], ["p1", "p2"]):
        import_arrivals(spark, str(tmp_path / "in"), catalog, str(tmp_path / "state"), "none").awaitTermination()
        assert catalog.list_dumps() == expected
        (tmp_path / "in" / "p2.jsonl").write_text(json.dumps({**GOOD, "id": 9}))
    # Another file of a name that is taken gets a number; the same file, met again by a new stream, is not imported twice.
    other = tmp_path / "other"
    other.mkdir()
    (other / "p1.jsonl").write_text(json.dumps({**GOOD, "id": 5}))
    for state in ("state2", "state3"):
        import_arrivals(spark, str(other), catalog, str(tmp_path / state), "none").awaitTermination()
        assert catalog.list_dumps() == ["p1", "p1_2", "p2"]
    assert [r["id"] for r in catalog.open("p1_2").objects.collect()] == [5]


def test_rules(spark):
    cases = [
        ("builtins.module", None, True),
        ("builtins.module\n", None, False),
        ("builtinsXmodule", None, True),
        ("builtins.modules", None, False),
        ("typing.Any", None, True),
        ("builtins.function", "typing.x", True),
        ("builtins.function", "app.x", False),
        ("builtins.function", None, False),
        ("abcd", None, False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, type string, value string, expected boolean")
    assert df.where(is_skip(F.col("type"), F.col("value")) != F.col("expected")).count() == 0
    df = spark.createDataFrame([("a" * 1001, b"\x00'", "m", "C.d")], "s string, b binary, m string, q string")
    row = df.select(truncate_value(F.col("s")).alias("t"), bytes_value("b").alias("b"), type_name(F.col("m"), F.col("q")).alias("n"), module_value(F.col("m")).alias("v")).first()
    assert row["t"] == "a" * 1000 + "...<truncated>" and row["b"] == repr(b"\x00'") and row["n"] == "m.C.d" and row["v"] == "module m"
