"""References are dealt out as records, and referrers without a shuffle to tell them apart."""

import gzip
from datetime import datetime

from pyspark.sql import functions as F

from heaploom.dump import HeapDump
from heaploom.plans import fixture
from heaploom.schema import Precision
from heaploom.sources import jsonl
from heaploom.sources.catalog import Catalog
from heaploom.sources.jsonl import read_lines


def test_records_are_stored_once_and_links_once_each(spark, tmp_path, monkeypatch):
    asked, given = [], HeapDump.from_records.__func__
    monkeypatch.setattr(HeapDump, "from_records", classmethod(lambda cls, *a, **k: asked.append(k.get("kept")) or given(cls, *a, **k)))
    lines = [b'{"id": %d, "type": "t", "references": [%s], "size": 1}' % (i, b"7, 3, 7" if i % 2 else b"") for i in range(1, 60)]
    dump = Catalog(spark, tmp_path.as_uri()).import_records(read_lines(spark, lines), "d", Precision.NONE)
    assert asked == [True]
    odd = range(1, 60, 2)
    assert sorted(tuple(r) for r in dump.refs.collect()) == sorted((i, p, d) for i in odd for p, d in enumerate((7, 3, 7)))
    assert sorted(tuple(r) for r in dump.referrers.collect()) == sorted((d, i) for i in odd for d in (3, 7))
    # Each file of references is a range of sources, in order.
    files = dump.refs.groupBy(F.input_file_name().alias("f")).agg(F.min("src").alias("a"), F.max("src").alias("b")).orderBy("a").collect()
    assert all(x["b"] < y["a"] for x, y in zip(files, files[1:]))


def test_only_records_of_repeated_ids_are_told_apart(spark, tmp_path, monkeypatch):
    """Of 60 records in two files, plain and compressed, two are repeated: those alone are shuffled as records."""
    line = '{"id": %d, "type": "%s", "references": [%d, %d], "size": 1}\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("".join(line % (i, "first", 7, 7) for i in range(40)) + "\n" + line % (3, "again", 8, 9))
    with gzip.open(tmp_path / "in" / "b.jsonl.gz", "wt") as out:
        out.write("".join(line % (i, "second", 5, 7) for i in range(39, 60)))
    asked, given = [], jsonl.last_wins
    monkeypatch.setattr(jsonl, "last_wins", lambda records, order: asked.append(records.count()) or given(records, order))
    dump = Catalog(spark, (tmp_path / "dumps").as_uri()).import_dump((tmp_path / "in").as_uri(), "d", Precision.NONE)
    assert asked == [4]
    types = {r["id"]: r["type"] for r in dump.objects.collect()}
    assert types == {i: "again" if i == 3 else "first" if i < 39 else "second" for i in range(60)} and dump.objects.count() == 60
    assert sorted(tuple(r) for r in dump.refs.where("src IN (3, 4, 39)").collect()) == [(3, 0, 8), (3, 1, 9), (4, 0, 7), (4, 1, 7), (39, 0, 5), (39, 1, 7)]
    assert sorted(tuple(r) for r in dump.referrers.where("src IN (3, 4, 39)").collect()) == [(5, 39), (7, 4), (7, 39), (8, 3), (9, 3)]


def test_records_hold_the_objects_and_their_links(spark, tmp_path):
    """Rows of a line are in order, a first event has no event before it, a region without nations has no links; nothing is joined by id."""
    tables = {
        "region": [("r_regionkey int", [(0,), (1,)])],
        "nation": [("n_nationkey int, n_regionkey int", [(4, 0), (2, 0)])],
        "customer": [("c_custkey long, c_nationkey int", [(1, 4)])],
        "supplier": [("s_suppkey long, s_name string, s_nationkey int", [(10, "s", 2), (11, "s", 4)])],
        "part": [("p_partkey long, p_name string", [(1, "nut"), (2, None)])],
        "orders": [("o_orderkey long, o_custkey long", [(5, 1), (6, 9)])],
        "lineitem": [("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int", [(5, 2, 10, 1), (5, 1, 11, 1), (5, 1, 10, 1), (5, 1, 10, 1), (5, 2, 10, 2), (6, 1, 11, 1)])],
        "events": [("event_id long, ts timestamp, user_id long, event_type string", [(k, datetime(2024, 1, d), u, t) for k, d, u, t in ((1, 2, 1, "click"), (2, 1, 1, "click"), (3, 1, 2, "buy"), (4, 3, 1, "error"))])],
        "documents": [("doc_id long, text string", [(1, "x" * 1001), (2, None)])],
    }
    for name, [(schema, rows)] in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path.as_uri()}/{name}.parquet")
    found = fixture.records(spark, tmp_path.as_uri()).collect()
    assert sorted(map(str, (r[:4] for r in found))) == sorted(str(tuple(r)) for r in fixture.objects(spark, tmp_path.as_uri()).select("id", "type", "value", "size").collect())
    links = [(r["id"], x["pos"], x["dst"]) for r in found for x in r["links"]]
    assert sorted(links) == sorted(tuple(r) for r in fixture.refs(spark, tmp_path.as_uri()).collect())
    assert all([x["pos"] for x in r["links"]] == sorted(x["pos"] for x in r["links"]) for r in found)
