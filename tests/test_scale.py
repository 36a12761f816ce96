"""What large dumps need: links are read where they are wanted, and only nodes that hand something on go the long way."""

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from heaploom.dump import HeapDump
from heaploom.functions.sketch import _merged_batches, merge_sketches
from heaploom.operators import graph, listing, paths
from heaploom.operators.dag import GraphIndex
from heaploom.operators.paths import find_path
from heaploom.operators.sizes import exact_sizes
from heaploom.plans import fixture, queries
from heaploom.plans.storage import Scratch


def dump(spark):
    """Roots 1 to 3 over the shared 10 and 11, which both reach 20; 30 is skipped; 2 is the root of the tree 12, 13."""
    rows = [(i, "t", None, i, i, i == 30) for i in (1, 2, 3, 10, 11, 12, 13, 20, 30)]
    objects = spark.createDataFrame(rows, "id long, type string, value string, size long, subtree_size long, is_skip boolean")
    links = [(1, 10), (1, 11), (2, 10), (2, 12), (12, 13), (13, 11), (3, 11), (10, 20), (11, 20), (3, 30)]
    return objects, spark.createDataFrame([(a, 0, b) for a, b in links], "src long, pos long, dst long")


def test_no_link_is_read_for_an_end_that_is_never_entered(spark):
    objects, refs = dump(spark)
    broken = refs.withColumn("dst", F.raise_error(F.lit("links were read")).cast("long"))
    assert find_path(objects, broken, 3, 30).count() == 0
    assert find_path(objects, broken, 1, 20, avoiding=[20]).count() == 0


def test_only_inner_nodes_are_sources_of_exits(spark):
    objects, refs = dump(spark)
    edges = graph.usable_refs(objects, refs)
    index = GraphIndex.build(objects, edges)
    assert {(r["src"], r["dst"]) for r in index.exits.collect()} == {(2, 10), (13, 11), (10, 20), (11, 20)}
    found = index.exits_of(spark.createDataFrame([(1,), (3,), (13,)], "src long"))
    assert {(r["src"], r["dst"]) for r in found.collect()} == {(1, 10), (1, 11), (3, 11), (13, 11)}
    sizes = {r["id"]: r["subtree_size"] for r in exact_sizes(objects, edges, index=index).collect()}
    assert sizes == {1: 42, 2: 68, 3: 34, 10: 30, 11: 31, 12: 56, 13: 44, 20: 20, 30: 30}


def test_missing_targets_are_looked_up_once_each(spark):
    objects, refs = dump(spark)
    more = refs.unionByName(spark.createDataFrame([(1, 5, 99), (2, 6, 99), (2, 7, None)], refs.schema))
    assert [r["dst"] for r in graph.barred_targets(objects, more.where("dst IS NOT NULL")).collect()] == [99]
    assert {(r["src"], r["pos"], r["dst"]) for r in listing.dangling_references(objects, more).collect()} == {(1, 5, 99), (2, 6, 99), (2, 7, None)}


def test_sizes_are_worked_out_for_what_both_reach_alone(spark):
    """4 links lie in what both reach; no object has a size, and no other link is ever part of a graph of sizes."""
    objects = spark.range(1, 1001).selectExpr("id", "'t' AS type", "CAST(NULL AS STRING) AS value", "id AS size", "CAST(NULL AS BIGINT) AS subtree_size", "id = 995 AS is_skip")
    refs = spark.range(1, 1000).selectExpr("id AS src", "0 AS pos", "id + 1 AS dst").where("src >= 990 OR src = 1").unionByName(spark.createDataFrame([(3, 0, 990), (2, 0, 990)], "src long, pos int, dst long"))
    asked, given = [], paths.exact_sizes
    paths.exact_sizes = lambda own, edges: asked.append((own.count(), edges.count())) or given(own, edges)
    try:
        top = paths.largest_common_exact(objects, refs, 1, 3).collect()
        assert paths.largest_common_exact(objects, refs, 4, 3).count() == 0
    finally:
        paths.exact_sizes = given
    assert [(r["id"], r["subtree_size"]) for r in top] == [(990, 990 + 991 + 992 + 993 + 994)]
    assert asked == [(5, 4)]
    assert paths.largest_common_exact(objects, refs, 995, 995).first()["subtree_size"] == sum(range(995, 1001))


def test_sketches_are_merged_within_tasks_first(spark):
    """A batch of 1,000 rows of two groups leaves two rows; nulls, numbers that are none and other lengths do no harm."""
    batch = pa.RecordBatch.from_pydict({"a": [None if i % 2 else "x" for i in range(1000)], "b": [i % 2 for i in range(1000)], "_sketch": pa.array([[float(i), float(-i)] for i in range(1000)], pa.list_(pa.float32()))})
    (left,) = _merged_batches([batch])
    assert sorted(left.to_pylist(), key=lambda r: r["b"]) == [{"a": "x", "b": 0, "_sketch": [998.0, 0.0]}, {"a": None, "b": 1, "_sketch": [999.0, -1.0]}]
    nan = float("nan")
    rows = [("x", [1.0, 5.0]), ("x", [2.0, 3.0]), ("y", None), ("z", [1.0, None]), ("z", [0.5, 2.0]), (None, [4.0]), (None, [3.0, 7.0]), ("n", [nan]), ("n", [1.0])]
    found = merge_sketches(spark.createDataFrame(rows, "k string, sketch array<float>"), ["k"]).collect()
    assert {r["k"]: str(r["sketch"]) for r in found} == {"x": "[2.0, 5.0]", "z": "[1.0, 2.0]", None: "[4.0, 7.0]", "n": "[nan]"}


def test_component_links_need_no_levels(spark, monkeypatch):
    """Links 1-2 go round, so 3 leads to 1 once; the index with its trees and levels is not built."""
    objects = spark.range(1, 4).selectExpr("id", "id AS size")
    monkeypatch.setattr(fixture, "_objects", lambda *_: objects)
    monkeypatch.setattr(fixture, "edges", lambda *_: spark.createDataFrame([(1, 2), (2, 1), (3, 1), (3, 2)], "src long, dst long"))
    monkeypatch.setattr(GraphIndex, "build", None)
    assert [tuple(r) for r in fixture.component_links(spark, "nowhere").collect()] == [(3, 1)]


def lines_and_regions(spark):
    """Lines 1 and 2 of type app.LineItem over customers, which lead to regions 1 and 2; 10 other objects that no line reaches."""
    base = 7000000000000
    rows = [(base + 1, "app.LineItem"), (base + 2, "app.LineItem"), (31, "app.Customer"), (32, "app.Customer"), (33, "builtins.module")]
    rows += [(queries.ORIGIN + k, "builtins.dict") for k in range(5)] + [(i, "t") for i in range(100, 110)]
    objects = spark.createDataFrame([(i, t, None, 10, None, t == "builtins.module") for i, t in rows], "id long, type string, value string, size long, subtree_size long, is_skip boolean")
    links = [(base + 1, 0, 31), (base + 1, 1, 32), (base + 2, 0, 33), (base + 2, 1, 31), (31, 0, queries.ORIGIN + 1), (32, 0, queries.ORIGIN + 1), (32, 1, queries.ORIGIN + 2), (33, 0, queries.ORIGIN + 2)]
    links += [(i, 0, i + 1) for i in range(100, 109)] + [(109, 0, 100), (109, 1, base + 1)]
    return HeapDump(objects, spark.createDataFrame(links, "src long, pos long, dst long"))


def counted(monkeypatch):
    """How many objects and links sizes are worked out for, call by call."""
    asked, given = [], paths.exact_sizes
    monkeypatch.setattr(paths, "exact_sizes", lambda own, edges: asked.append((own.count(), edges.count())) or given(own, edges))
    return asked


def test_pruned_paths_need_sizes_of_what_the_starts_reach_alone(spark, monkeypatch):
    """The query makes no sizes and no index of the whole graph; region 2 is not reached from line 2, as a module is not entered."""
    monkeypatch.setattr(fixture, "plain", lambda *_: lines_and_regions(spark))
    for name in ("dump", "exact_sizes", "index"):
        monkeypatch.setattr(fixture, name, None)
    asked = counted(monkeypatch)
    found = queries.paths_of_many_pruned(spark, "nowhere").orderBy("request", "step").collect()
    assert [tuple(r) for r in found] == [(7000000000001, 0, 7000000000001), (7000000000001, 1, 31), (7000000000001, 2, queries.ORIGIN + 1)]
    assert asked == [(6, 6)]
    dump = lines_and_regions(spark)
    requests = spark.createDataFrame([("a", 109, 109), ("b", 100, 32), ("c", 32, 100), ("d", 7000000000001, 33), ("e", 100, 31)], "request string, start long, end long")
    exact = dump.find_paths_exact(requests, spark.createDataFrame([("e", 105)], "request string, id long")).collect()
    assert {(r["request"], r["step"], r["id"]) for r in exact} == {("a", 0, 109), ("b", 11, 32), ("b", 10, 7000000000001), *(("b", k, 100 + k) for k in range(10))}
    assert dump.find_paths_exact(requests.limit(0)).count() == 0
    with pytest.raises(LookupError):
        dump.find_paths_exact(spark.createDataFrame([(1, 100, 7)], "request long, start long, end long"))


def test_common_report_needs_sizes_of_what_either_reaches_alone(spark, monkeypatch):
    line, event, given = 7000000000001, 8000000000009, lines_and_regions(spark)
    objects = given.objects.unionByName(spark.createDataFrame([(event, "app.click", None, 5, None, False)], given.objects.schema))
    dump = HeapDump(objects, given.refs.unionByName(spark.createDataFrame([(event, 0, 32), (event, 1, 33)], given.refs.schema)))
    monkeypatch.setattr(fixture, "plain", lambda *_: dump)
    for name in ("dump", "exact_sizes", "index"):
        monkeypatch.setattr(fixture, name, None)
    asked = counted(monkeypatch)
    found = queries.common_report(spark, "nowhere").select("origin", "step", "id", "subtree_size").collect()
    assert sorted(tuple(r) for r in found) == [(line, 0, line, 50), (line, 1, 32, 30), (event, 0, event, 35), (event, 1, 32, 30)]
    assert asked == [(6, 6)]
    with pytest.raises(LookupError, match="object 7 is"):
        dump.common_report_exact(event, 7)


def test_chains_are_followed_without_a_table_a_hop(spark, monkeypatch):
    """A chain of 12, then 8 branches, of which one leads back and one is skipped; any bound for the driver gives the same."""
    objects = spark.range(1, 22).selectExpr("id", "id = 21 AS is_skip")
    links = [(i, i + 1) for i in range(1, 12)] + [(12, i) for i in range(13, 22)] + [(20, 1), (21, 99), (5, None)]
    refs = spark.createDataFrame(links, "src long, dst long")
    kept, given = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: kept.append(df) or given(self, df))
    for bound, most in ((1000, 2), (2, 40), (0, 60)):
        monkeypatch.setattr(paths, "WALKED", bound)
        kept.clear()
        with Scratch(spark, "walk") as work:
            starts = work.keep(spark.createDataFrame([(1, 0), (12, 1)], "id long, side int"))
            found = {tuple(r) for r in paths._reached(work, objects, refs, starts).collect()}
        assert found == {(i, s) for s in (0, 1) for i in range(1, 21)} and len(kept) <= most
