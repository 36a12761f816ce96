"""A dump of seven objects, a graph of two cycles and random graphs, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from heaploom.dump import HeapDump
from heaploom.functions.sketch import estimate, lanes_of, merge_sketches, merged
from heaploom.operators import components, graph, sizes
from heaploom.operators.dag import GraphIndex, condense, levels
from heaploom.operators.paths import find_path, find_paths, largest_common_reachable
from heaploom.plans.storage import Scratch
from heaploom.schema import ALL_TYPES, Precision
from heaploom.sources.jsonl import read_lines

SEVEN = [
    {"id": 10, "type": "app.Cache", "references": [20, 30, 60], "size": 7},
    {"id": 20, "type": "builtins.tuple", "references": [40], "size": 11},
    {"id": 30, "type": "app.Node", "references": [50, 40], "size": 13},
    {"id": 40, "type": "app.Leaf", "references": [50], "size": 17},
    {"id": 50, "type": "builtins.bytes", "references": [], "size": 19},
    {"id": 60, "type": "builtins.type", "references": [50], "size": 500},
    {"id": 70, "type": "builtins.tuple", "references": [70], "size": 5},
]


def lines(records):
    return [json.dumps(r).encode() for r in records]


@pytest.fixture(scope="module")
def seven(spark):
    return HeapDump.from_records(read_lines(spark, lines(SEVEN)), Precision.EXACT)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_exact_sizes(seven):
    assert {r["id"]: r["subtree_size"] for r in seven.objects.collect()} == {10: 67, 20: 47, 30: 49, 40: 36, 50: 19, 60: 519, 70: 5}


@pytest.mark.parametrize(("precision", "lanes"), [("low", 7), ("medium", 31), ("high", 127)])
def test_sketch_within_three_deviations(spark, seven, precision, lanes):
    assert Precision(precision).lanes == lanes
    sizes_ = sizes.sketch_sizes(seven.objects, seven.usable_refs(), lanes, seven.index())
    found = sizes_.where("id = 10").first()["subtree_size"]
    assert abs(found - 67) <= 3 * 67 / lanes**0.5


def test_sketches_on_import(spark):
    dump = HeapDump.from_records(read_lines(spark, lines(SEVEN)), "unknown means medium")
    found = dump.objects.where("id = 10").first()["subtree_size"]
    assert abs(found - 67) <= 3 * 67 / 31**0.5


def test_no_estimates(spark):
    dump = HeapDump.from_records(read_lines(spark, lines(SEVEN)), Precision.NONE)
    assert dump.objects.where("subtree_size IS NOT NULL").count() == 0
    assert dump.objects_of_type(sort="subtree_size").count() == 0
    with pytest.raises(ValueError, match="no subtree size"):
        dump.largest_common_reachable(20, 30)


def test_object(seven):
    cache = seven.object(10).first()
    assert [r["id"] for r in cache["references"]] == [20, 30, 60] and cache["referrers"] == []
    assert [r["id"] for r in seven.object(50).first()["referrers"]] == [30, 40, 60]
    assert [r["id"] for r in seven.object(70).first()["referrers"]] == [70]
    assert seven.object(99).count() == 0


def test_paths(seven):
    assert ids(seven.find_path(10, 50)) == [10, 30, 50]
    assert ids(seven.find_path(10, 50, {30})) == [10, 20, 40, 50]
    assert ids(seven.find_path(10, 40)) == [10, 20, 40]
    assert ids(seven.find_path(10, 40, {10, 20})) == [10, 30, 40]
    assert ids(seven.find_path(10, 40, {20, 30})) == []
    assert ids(seven.find_path(10, 60)) == []
    assert ids(seven.find_path(60, 50)) == [60, 50]
    assert ids(seven.find_path(70, 70)) == [70]
    with pytest.raises(LookupError):
        seven.find_path(10, 99)


def test_counts_and_listings(seven):
    assert (seven.count("builtins.tuple"), seven.count(ALL_TYPES), seven.count("nothing")) == (2, 7, 0)
    assert (seven.page_count(), seven.page_count("nothing")) == (1, 0)
    summaries = {r["type"]: (r["count"], r["total_size"]) for r in seven.type_summaries().collect()}
    assert len(summaries) == 7 and summaries["builtins.tuple"] == (2, 16) and summaries[ALL_TYPES] == (7, 572)
    assert ids(seven.objects_of_type("builtins.tuple", "size")) == [20, 70]
    assert ids(seven.objects_of_type("app.Leaf")) == [40]
    assert ids(seven.objects_of_type(sort="subtree_size", page=0)) == [60, 10, 30, 20, 40, 50, 70]
    assert ids(seven.objects_of_type(page=1)) == []
    # Where pages are counted from 1, page 0 is the first one, too.
    pages = {p: ids(seven.objects_of_type(page=p, first_page=1)) for p in (0, 1, 2)}
    assert pages == {0: [10, 20, 30, 40, 50, 60, 70], 1: [10, 20, 30, 40, 50, 60, 70], 2: []}
    assert [r["type"] for r in seven.type_summaries("count").collect()][:2] == [ALL_TYPES, "builtins.tuple"]


def test_common(seven):
    assert ids(seven.largest_common_reachable(20, 30)) == [40]
    assert ids(seven.largest_common_reachable(10, 30)) == [30]
    assert ids(seven.largest_common_reachable(20, 70)) == []
    assert [(r["origin"], r["id"]) for r in seven.common_report(20, 30).collect()] == [(20, 20), (20, 40), (30, 30), (30, 40)]
    assert seven.common_report(20, 70).count() == 0


def test_exact_sizes_have_a_budget(spark):
    with pytest.raises(graph.ClosureTooLarge):
        HeapDump.from_records(read_lines(spark, lines(SEVEN)), Precision.EXACT, max_pairs=5)


def test_views(seven, spark):
    seven.register_views("seven_")
    assert spark.sql("SELECT count(*) AS n FROM seven_refs").first()["n"] == 9


def test_sketches_in_sql(seven, spark):
    seven.register_views("seven_")
    found = spark.sql(
        "SELECT type, sketch_estimate(array_agg(v)) AS e FROM (SELECT type, lane, max(v) AS v FROM (SELECT type, size_sketch(31, id, size) AS s FROM seven_objects) LATERAL VIEW posexplode(s) p AS lane, v GROUP BY type, lane) GROUP BY type"
    )
    direct = seven.objects.select("type", *lanes_of(31, F.col("id"), F.col("size"))).groupBy("type").agg(*merged(31)).select("type", estimate(31).alias("e"))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in direct.collect()}
    one = spark.sql("SELECT sketch_merge(size_sketch(7, 1, 10), NULL) = size_sketch(7, 1, 10) AS a, sketch_merge(size_sketch(7, 1, 10), size_sketch(7, 1, 10)) = size_sketch(7, 1, 10) AS b, sketch_estimate(sketch_merge(size_sketch(7, 1, 10), size_sketch(7, 2, 20))) AS c, sketch_estimate(NULL) AS d").first()
    pair = spark.createDataFrame([(1, 10), (2, 20)], "id long, w long").select(*lanes_of(7, F.col("id"), F.col("w"))).agg(*merged(7)).select(estimate(7).alias("e")).first()["e"]
    assert (one["a"], one["b"], one["c"], one["d"]) == (True, True, pair, None)
    rows = seven.objects.select(F.lit("all").alias("k"), F.expr("size_sketch(7, id, size)").alias("sketch"))
    rows = rows.unionByName(rows).unionByName(spark.sql("SELECT 'none' AS k, CAST(NULL AS ARRAY<FLOAT>) AS sketch"))
    whole = seven.objects.select(*lanes_of(7, F.col("id"), F.col("size"))).agg(*merged(7)).select(estimate(7).alias("e")).first()["e"]
    assert [tuple(r) for r in merge_sketches(rows, ["k"]).select("k", F.expr("sketch_estimate(sketch)")).collect()] == [("all", whole)]


def test_strong_components(spark):
    links = [(101, 102), (102, 101), (102, 103), (103, 104), (104, 105), (105, 106), (106, 103), (104, 106), (107, 107), (107, 101), (108, 109), (109, 110), (110, 104)]
    members = components.strong_components(spark.createDataFrame([*links, *links, (None, 101), (101, None)], "src long, dst long"))
    assert {r["id"]: r["scc_id"] for r in members.collect()} == {101: 101, 102: 101, 103: 103, 104: 103, 105: 103, 106: 103}
    objects = spark.range(101, 111).select("id", (F.col("id") - 100).alias("size"))
    assert {tuple(r) for r in components.component_sizes(objects, members).collect()} == {(101, 2, 3), (103, 4, 18)}
    assert components.strong_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def plain_reach(nodes, out, start):
    seen, todo = {start}, [start]
    while todo:
        for v in out[todo.pop()]:
            if v not in seen:
                seen.add(v)
                todo.append(v)
    return seen


def plain_path(out, start, end, avoid):
    parent, level = {start: None}, [start]
    while level:
        if end in parent:
            path = [end]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            return path[::-1]
        following = []
        for u in level:
            for v in out[u]:
                if v not in parent and v not in avoid:
                    parent[v] = u
                    following.append(v)
        level = following
    return []


class Many:
    """Many random graphs side by side: sparse and dense ones, with chains, loops, skipped and dangling targets."""

    def __init__(self, spark, seed, graphs=40):
        draw = random.Random(seed)
        self.nodes, self.refs, self.skip, self.weight = [], [], set(), {}
        for g in range(graphs):
            n, base = draw.choice([2, 5, 9, 25]), 1000 * g
            nodes = range(base + 1, base + n + 1)
            links = [(draw.choice(nodes), draw.choice(nodes)) for _ in range(int(n * draw.choice([0.5, 1, 1.5, 2.5])))]
            links += [(v, v + 1) for v in nodes[:-1]] if g % 3 == 0 else []
            links += [(draw.choice(nodes), base + 999)]
            draw.shuffle(links)
            self.refs += [(u, sum(1 for x, _ in links[:k] if x == u), v) for k, (u, v) in enumerate(links)]
            self.nodes += nodes
            self.skip |= {v for v in nodes if draw.random() < 0.08}
        self.weight = {v: draw.randint(0, 50) for v in self.nodes}
        self.out = {v: [] for v in self.nodes}
        for u, _, v in sorted(self.refs):
            if v in self.out and v not in self.skip:
                self.out[u].append(v)
        self.reach = {v: plain_reach(self.nodes, self.out, v) for v in self.nodes}
        self.size = {v: sum(self.weight[x] for x in self.reach[v]) for v in self.nodes}
        self.scc = {v: min(x for x in self.reach[v] if v in self.reach[x]) for v in self.nodes}
        rows = [(v, "t", None, self.weight[v], self.size[v], v in self.skip) for v in self.nodes]
        self.objects = spark.createDataFrame(rows, "id long, type string, value string, size long, subtree_size long, is_skip boolean").repartition(3)
        self.links = spark.createDataFrame(self.refs, "src long, pos int, dst long").repartition(3)
        self.edges = graph.usable_refs(self.objects, self.links)


@pytest.fixture(scope="module")
def many(spark):
    return Many(spark, 7)


@pytest.fixture(scope="module")
def many_index(many):
    return GraphIndex.build(many.objects, many.edges)


def test_components_of_random_graphs(many):
    several = {v for v in many.nodes if sum(many.scc[x] == many.scc[v] for x in many.reach[v]) > 1}
    assert {r["id"]: r["scc_id"] for r in components.strong_components(many.edges).collect()} == {v: many.scc[v] for v in several}


def test_condensed_graph_and_levels(spark, many):
    with Scratch(spark, "test") as work:
        dag = condense(work, many.objects, many.edges)
        nodes = {r["comp"]: (r["size"], r["members"]) for r in dag.nodes.collect()}
        links = {tuple(r) for r in dag.links.collect()}
        found, depth = levels(work, dag.nodes.select(F.col("comp").alias("id")), dag.links)
        found = {r["id"]: r["level"] for r in found.collect()}
        with pytest.raises(ValueError, match="cycle"):
            levels(work, spark.range(1, 4), spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long"))
    members = {}
    for v, c in many.scc.items():
        members.setdefault(c, []).append(v)
    assert nodes == {c: (sum(many.weight[v] for v in of), len(of)) for c, of in members.items()}
    assert links == {(many.scc[u], many.scc[v]) for u in many.nodes for v in many.out[u] if many.scc[u] != many.scc[v]}
    below = {c: [] for c in members}
    for a, b in links:
        below[a].append(b)

    def level(c):
        return 1 + max((level(x) for x in below[c]), default=-1)

    assert found == {c: level(c) for c in members} and depth == 1 + max(found.values())


def test_sizes_of_random_graphs(spark, many, many_index):
    assert {r["id"]: r["subtree_size"] for r in sizes.exact_sizes(many.objects, many.edges).collect()} == many.size
    again = sizes.exact_sizes(many.objects.withColumn("size", F.lit(1).cast("long")), many.edges, index=many_index)
    assert {r["id"]: r["subtree_size"] for r in again.collect()} == {v: len(r) for v, r in many.reach.items()}
    pairs = spark.createDataFrame([(v, x, many.weight[x]) for v, r in many.reach.items() for x in r], "id long, x long, w long")
    direct = pairs.select("id", *lanes_of(7, F.col("x"), F.col("w"))).groupBy("id").agg(*merged(7)).select("id", estimate(7).alias("e"))
    assert {tuple(r) for r in sizes.sketch_sizes(many.objects, many.edges, 7, many_index).collect()} == {tuple(r) for r in direct.collect()}


def test_deep_graphs(spark):
    n = 20_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    tail = spark.range(n).select((F.col("id") + n).alias("src"), F.when(F.col("id") == 0, 0).otherwise(F.col("id") + n - 1).alias("dst"))
    edges = ring.unionByName(tail)
    found = components.strong_components(edges)
    assert found.agg(F.count("id"), F.min("id"), F.max("id"), F.max("scc_id")).first() == (n, 0, n - 1, 0)
    objects = spark.range(2 * n).select("id", F.lit(1).cast("long").alias("size"))
    reached = sizes.exact_sizes(objects, edges)
    assert reached.where((F.col("id") < n) & (F.col("subtree_size") != n)).count() == 0
    assert reached.where((F.col("id") >= n) & (F.col("subtree_size") != F.col("id") + 1)).count() == 0


def test_paths_in_random_graphs(spark, many):
    draw = random.Random(11)
    pairs = [(k, a, draw.choice([v for v in many.nodes if v // 1000 == a // 1000])) for k, a in enumerate(draw.choices(many.nodes, k=150))]
    avoid = {k: {draw.choice(many.nodes[:60])} for k, *_ in pairs}
    want = {k: plain_path(many.out, a, b, avoid[k]) if a != b else [a] for k, a, b in pairs}
    requests = spark.createDataFrame([*pairs, *pairs, (None, 1, 1)], "request long, start long, end long")
    avoiding = spark.createDataFrame([(k, v) for k, of in avoid.items() for v in of], "request long, id long")
    for prune in (True, False):
        found = {}
        for r in find_paths(many.objects, many.links, requests, avoiding, prune).orderBy("request", "step").collect():
            found.setdefault(r["request"], []).append(r["id"])
        assert found == {k: p for k, p in want.items() if p}
    for k, a, b in pairs[:3]:
        assert ids(find_path(many.objects, many.links, a, b, avoid[k])) == want[k]
    assert find_paths(many.objects, many.links, requests.limit(0)).count() == 0
    with pytest.raises(LookupError):
        find_paths(many.objects, many.links, spark.createDataFrame([(1, 1, 999)], "request long, start long, end long"))


def test_common_in_random_graphs(many, many_index):
    draw = random.Random(5)
    wide = [v for v in many.nodes if len(many.reach[v]) > 4]
    for a in draw.sample(wide, 8):
        b = draw.choice([v for v in many.nodes if v // 1000 == a // 1000])
        both = many.reach[a] & many.reach[b]
        best = [min(both, key=lambda v: (-many.size[v], v))] if both else []
        assert ids(largest_common_reachable(many.objects, many.links, a, b, many_index)) == best


def test_sketches_merge_and_ignore_repetition(spark):
    rows = spark.range(4).select(F.col("id"), ((F.col("id") + 1) * 10).alias("w"))
    once = rows.select(*lanes_of(31, F.col("id"), F.col("w"))).agg(*merged(31)).select(estimate(31).alias("e")).first()["e"]
    twice = rows.unionByName(rows).select(*lanes_of(31, F.col("id"), F.col("w"))).agg(*merged(31)).select(estimate(31).alias("e")).first()["e"]
    assert once == twice


@pytest.mark.parametrize(("lanes", "margin"), [(7, 60), (31, 30), (127, 15)])
def test_sketch_accuracy_over_many_sets(spark, lanes, margin):
    # Five elements that weigh 100 in all, other ones in each set.
    rows = spark.range(1000).select(F.col("id").alias("i"), F.explode(F.array(*map(F.lit, (6, 12, 20, 27, 35)))).alias("w"))
    rows = rows.select("i", *lanes_of(lanes, F.col("i") * 64 + F.col("w"), F.col("w")))
    found = rows.groupBy("i").agg(*merged(lanes)).select(estimate(lanes).alias("e"))
    assert found.where(F.abs(F.col("e") - 100) < margin).count() > 800


def test_sketch_sizes_grow_along_links(spark):
    draw = random.Random(3)
    refs = [(u, draw.randint(1, 30)) for u in range(1, 31) for _ in range(2)]
    objects = spark.range(1, 31).select("id", (F.col("id") % 7 + 1).alias("size"))
    edges = spark.createDataFrame(refs, "src long, dst long").distinct()
    found = {r["id"]: r["subtree_size"] for r in sizes.sketch_sizes(objects, edges, 7).collect()}
    assert all(found[s] >= found[d] for s, d in refs)
