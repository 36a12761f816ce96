"""Sizes by sets of units: what nothing enters is set apart, trees are one unit each, and large sets go by chunks."""

import pytest
from pyspark.sql import functions as F

from heaploom.operators import graph, listing, sizes
from heaploom.plans import fixture

SMALL = "/root/testdata/sf0.001"


def tables(spark, links, weights):
    return spark.createDataFrame(list(weights.items()), "id long, size long"), spark.createDataFrame(list(links), "src long, dst long")


def expected(links, weights):
    def reach(x):
        seen, todo = {x}, [x]
        while todo:
            at = todo.pop()
            fresh = {b for a, b in links if a == at} - seen
            seen |= fresh
            todo += fresh
        return seen

    return {x: sum(weights[y] for y in reach(x)) for x in weights}


def test_trees_cycles_and_roots_by_sets(spark, monkeypatch):
    """A cycle that nothing enters (1 to 3) with a tree, a tree whose exit leads back to its root (10 to 14), two units on a cycle (20, 22), a loop, a lone node."""
    monkeypatch.setattr(sizes, "_exact_by_chunks", None)
    links = {(1, 2), (2, 3), (3, 1), (2, 4), (4, 20), (9, 10), (8, 10), (10, 11), (11, 12), (11, 13), (13, 14), (12, 10), (14, 20), (20, 21), (21, 22), (22, 20), (7, 22), (7, 14), (6, 6), (6, 13)}
    weights = {i: 2**i for i in [*range(1, 5), *range(6, 15), 20, 21, 22, 30]}
    objects, edges = tables(spark, links, weights)
    assert {r["id"]: r["subtree_size"] for r in sizes.exact_sizes(objects, edges).collect()} == expected(links, weights)


def test_large_sets_go_by_chunks(spark, monkeypatch):
    """2 reaches 1,100 units, more than a set that travels may hold."""
    asked, given = [], sizes._exact_by_chunks
    monkeypatch.setattr(sizes, "_exact_by_chunks", lambda *a: asked.append(1) or given(*a))
    links = {(1, 2)} | {(a, b) for a in (2, 3) for b in range(10, 1110)}
    weights = {1: 5, 2: 7, 3: 11} | {b: b for b in range(10, 1110)}
    found = {r["id"]: r["subtree_size"] for r in sizes.exact_sizes(*tables(spark, links, weights)).collect()}
    all_ = sum(range(10, 1110))
    assert asked and found == {b: b for b in range(10, 1110)} | {1: all_ + 12, 2: all_ + 7, 3: all_ + 11}


def test_links_are_the_refs_without_places(spark):
    links = fixture.links(spark, SMALL).where("dst IS NOT NULL").distinct()
    refs = fixture.refs(spark, SMALL).select("src", "dst").distinct()
    assert links.exceptAll(refs).isEmpty() and refs.exceptAll(links).isEmpty()


def test_usable_links_have_both_ends(spark):
    objects = spark.createDataFrame([(1, False), (2, False), (3, True)], "id long, is_skip boolean")
    refs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (1, 9), (9, 2), (3, 1), (None, 2), (2, None)], "src long, dst long")
    assert sorted((r["src"], r["dst"]) for r in graph.usable_refs(objects, refs).collect()) == [(1, 2), (3, 1)]


@pytest.mark.parametrize("page", [0, 2])
def test_pages_by_subtree_size_read_their_objects_alone(spark, page):
    objects = spark.range(2500).selectExpr("id", "'t' AS type", "CAST(id AS STRING) AS value", "id AS size")
    found = spark.range(2500).select("id", F.when(F.col("id") > 0, F.col("id") % 7).alias("subtree_size"))
    whole = listing.objects_of_type(objects.join(found, "id"), sort="subtree_size", page=page).collect()
    assert listing.page_by_subtree_size(objects, found, page).collect() == whole and len(whole) == (1000, 0, 499)[page]


def test_sketches_need_no_index(spark, monkeypatch):
    """Sets of three elements at most are exact in what they hold: a node that reaches one object has that one's estimate."""
    monkeypatch.setattr(sizes, "GraphIndex", None)
    objects, edges = tables(spark, {(1, 3), (2, 3), (3, 4), (5, 3)}, {i: 10 * i for i in range(1, 7)})
    found = {r["id"]: r["subtree_size"] for r in sizes.sketch_sizes(objects, edges, 7).collect()}
    alone = {r["id"]: r["subtree_size"] for r in sizes.sketch_sizes(objects, edges.limit(0), 7).collect()}
    assert set(found) == set(alone) == set(range(1, 7)) and all(found[i] == alone[i] for i in (4, 6)) and all(found[i] >= alone[i] for i in (1, 2, 3, 5))
