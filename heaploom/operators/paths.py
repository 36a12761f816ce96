"""Shortest reference paths and what two objects both reach."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Scratch, cut, looked_up, sized
from ..schema import SUMMARY
from .dag import GraphIndex
from .forest import below
from .graph import usable_refs
from .sizes import exact_sizes


#: The driver follows links while a hop has at most so many.
WALKED = 1_000


def _summaries(objects: DataFrame, ids: list[int]) -> dict[int, object]:
    return {r["id"]: r for r in objects.where(F.col("id").isin(ids)).select(*SUMMARY).collect()}


def find_path(objects: DataFrame, refs: DataFrame, start: int, end: int, avoiding: Iterable[int] = (), prune: bool = True) -> DataFrame:
    """The shortest path of links from start to end: (step, summary...); no rows if there is none.

    Of several shortest ones it is that whose links come first, compared from the start on.  Skipped
    and avoided objects are not entered (the start is never tested).  With ``prune``, objects that reach less
    than the end does are left out: sizes grow along links, so no path to the end leads through them.
    Unknown ends raise LookupError.  Links to missing objects are not followed.

    Each round reads the links of the frontier and then what is known of their targets; neither links nor objects are shuffled while the counted frontier
    may be broadcast.  Its rank keeps the order of the links: per new object the least (rank of the source, position).  Only numbers of rows and the path's
    ids reach the driver.
    """
    spark = objects.sparkSession
    known = {r["id"]: r for r in objects.where(F.col("id").isin([start, end])).select("id", "subtree_size", "is_skip").collect()}
    for id_ in (start, end):
        if id_ not in known:
            raise LookupError(f"object {id_} is not in the dump")
    least, avoiding = known[end]["subtree_size"], set(avoiding)
    nothing = spark.createDataFrame([], "step int").join(objects.select(*SUMMARY).limit(0), F.lit(True))
    # What is never entered has no path to it, however much else the start reaches.
    if start != end and (known[end]["is_skip"] or end in avoiding):
        return nothing
    fit = ~F.col("is_skip") & ~F.col("id").isin(list(avoiding) or [-1])
    if prune and least is not None:
        fit &= F.col("subtree_size").isNull() | (F.col("subtree_size") >= least)
    nodes, links = objects.where(fit).select("id"), refs.select("src", "pos", "dst")
    levels = [F.broadcast(spark.createDataFrame([(start, None, 0)], "id long, parent long, rank long"))]
    seen, total, n = levels[0].select("id"), 1, 1
    while start != end:
        met = looked_up(links, "src", levels[-1].select(F.col("id").alias("src"), "rank"), n).select("dst", F.struct("rank", "pos", "src").alias("via"))
        met = cut(met.groupBy(F.col("dst").alias("id")).agg(F.min("via").alias("via")).join(sized(seen, total), "id", "left_anti"))
        fresh = looked_up(nodes, "id", met, met.count())
        # Sorted over all partitions; the ids of the rows grow with the partitions, so they keep the order without one task for all.
        fresh = cut(fresh.orderBy("via.rank", "via.pos").select("id", F.col("via.src").alias("parent"), F.monotonically_increasing_id().alias("rank")))
        n = fresh.count()
        if not n:
            return nothing
        levels.append(fresh)
        if fresh.where(F.col("id") == end).count():
            break
        seen, total = cut(seen.unionByName(fresh.select("id"))), total + n
    path = [end]
    for level in reversed(levels[1:]):
        path.append(level.where(F.col("id") == path[-1]).first()["parent"])
    steps = spark.createDataFrame(list(enumerate(reversed(path))), "step int, id long")
    return F.broadcast(steps).join(objects.select(*SUMMARY), "id").select("step", *SUMMARY).orderBy("step")


def find_paths(objects: DataFrame, refs: DataFrame, requests: DataFrame, avoiding: DataFrame | None = None, prune: bool = True) -> DataFrame:
    """The shortest paths of many requests at once: (request, step, summary...), no rows for a request without a path.

    ``requests``: request (a key), start, end.  ``avoiding``: request, id.  Each path is that of :func:`find_path`: skipped and avoided objects are not entered, ``prune``
    leaves out what reaches less than the end does, ties follow the order of the links.  One join a hop serves all requests; a request leaves as soon as its end is
    met.  Requests of unknown objects raise LookupError.  Repeated rows count once; null keys or ends are no requests.
    """
    with Scratch(objects.sparkSession, "paths") as work:
        asked = _asked(work, objects, requests)
        nodes = objects.where(~F.col("is_skip")).select("id", F.col("subtree_size").alias("weight"))
        links = refs.select("src", "pos", "dst")
        goals = asked.select("request", "end", "least")
        frontier = work.keep(asked.select("request", F.col("start").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("rank")))
        levels, seen = [frontier], frontier.select("request", "id")
        n = frontier.count()
        arrived = [work.keep(asked.where("start = end").select("request", F.col("end").alias("id")))]
        open_ = work.keep(goals.join(arrived[0].select("request"), "request", "left_anti"))
        while n and not open_.isEmpty():
            front = work.keep(levels[-1].join(sized(open_).select("request").distinct(), "request", "left_semi").select("request", F.col("id").alias("src"), "rank"))
            met = looked_up(links, "src", front, front.count()).groupBy("request", F.col("dst").alias("id")).agg(F.min(F.struct("rank", "pos", "src")).alias("via"))
            met = work.keep(met.join(seen, ["request", "id"], "left_anti"))
            # Targets are looked up for what was met alone: links and objects are read each hop, and shuffled only where the frontier is too large to broadcast.
            fresh = looked_up(nodes, "id", met, met.count())
            if prune:
                # A request whose ends differ in size keeps what any of them allows.
                allowed = work.keep(open_.groupBy("request").agg(F.expr("CASE WHEN count(least) = count(*) THEN min(least) END").alias("least")))
                fresh = fresh.join(sized(allowed), "request").where("weight IS NULL OR least IS NULL OR weight >= least")
            if avoiding is not None:
                fresh = fresh.join(avoiding.select("request", "id"), ["request", "id"], "left_anti")
            # Sorted over all partitions: within each request the numbers of the rows keep the order.
            fresh = work.keep(fresh.orderBy("via.rank", "via.pos").select("request", "id", F.col("via.src").alias("parent"), F.monotonically_increasing_id().alias("rank")))
            n = fresh.count()
            levels.append(fresh)
            there = work.keep(fresh.select("request", "id").join(open_.select("request", F.col("end").alias("id")), ["request", "id"], "left_semi"))
            arrived.append(there)
            open_ = work.keep(open_.join(there.select("request"), "request", "left_anti"))
            seen = work.keep(seen.unionByName(fresh.select("request", "id")).join(open_.select("request"), "request", "left_semi"))
        steps, now = [], None
        for k in range(len(levels) - 1, -1, -1):
            here = arrived[k] if now is None else arrived[k].unionByName(now)
            placed = work.keep(levels[k].join(here, ["request", "id"], "left_semi").select("request", F.lit(k).alias("step"), "id", "parent"))
            steps.append(placed.select("request", "step", "id"))
            now = placed.where("parent IS NOT NULL").select("request", F.col("parent").alias("id"))
        found = steps[0]
        for more in steps[1:]:
            found = found.unionByName(more)
        found = work.keep(found)
        return cut(looked_up(objects.select(*SUMMARY), "id", found, found.count()).select("request", "step", *SUMMARY))


def _asked(work: Scratch, objects: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, start, end, least): the requests, once each, with the size of the end, kept; LookupError if an object is unknown.  Objects are read, not shuffled."""
    asked = work.keep(requests.select("request", "start", "end").where("request IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL").distinct())
    ends = work.keep(asked.select(F.explode(F.array("start", "end")).alias("id")).distinct())
    known = work.keep(looked_up(objects.select("id", "subtree_size"), "id", ends, ends.count()))
    if missing := ends.join(known.select("id"), "id", "left_anti").first():
        raise LookupError(f"object {missing['id']} is not in the dump")
    return work.keep(asked.join(known.select(F.col("id").alias("end"), F.col("subtree_size").alias("least")), "end").select("request", "start", "end", "least"))


def find_paths_exact(objects: DataFrame, refs: DataFrame, requests: DataFrame, avoiding: DataFrame | None = None) -> DataFrame:
    """The paths of :func:`find_paths`, pruned by exact sizes, for a dump of which no sizes are known.

    What the starts reach holds all that any of it reaches, so sizes are worked out for that alone, and the search reads nothing else.  An end that is not
    among it has no path.
    """
    with Scratch(objects.sparkSession, "paths") as work:
        asked = _asked(work, objects, requests)
        starts = work.keep(asked.select(F.col("start").alias("id")).distinct())
        own, inside = _weighed(work, objects, refs, _reached(work, objects, refs, starts))
        return find_paths(own, inside, asked.join(own.select(F.col("id").alias("end")), "end", "left_semi"), avoiding)


def _sides(work: Scratch, objects: DataFrame, graph: GraphIndex, first: int, second: int) -> DataFrame:
    """(id, side): the components that each of both objects reaches and that can still hold the largest that both do.

    The nodes below an origin in its own tree are met in as many rounds as the logarithm of their depth.  From then on a round follows the exits of all
    that was met last, to shared nodes and their whole trees.  Sizes shrink along links, so what is smaller than the largest object that both sides have met is not
    entered any more, and the search ends when nothing else is left.
    """
    spark = objects.sparkSession
    starts = graph.component_of(spark.createDataFrame([(first, 0), (second, 1)], "id long, side int")).select(F.col("comp").alias("id"), "side").distinct()
    sizes = objects.select("id", "subtree_size")
    met = below(work, work.keep(starts), graph.ups, ["side"])
    seen, best = met, None
    while True:
        both = seen.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("id")
        found = sizes.join(sized(work.keep(both)), "id").agg(F.max("subtree_size").alias("best")).first()["best"]
        best = found if best is None else max(best, found)
        fresh = work.keep(graph.exits_of(sized(met.withColumnRenamed("id", "src"), met.count())).select(F.col("dst").alias("id"), "side").distinct().join(seen, ["id", "side"], "left_anti"))
        if best is not None:
            fresh = work.keep(sizes.join(sized(fresh), "id").where(F.col("subtree_size") >= best).select("id", "side"))
        if fresh.isEmpty():
            return seen
        trees = graph.tops.join(sized(fresh.withColumnRenamed("id", "top")), "top").select("id", "side")
        met = work.keep(fresh.unionByName(trees))
        seen = work.keep(seen.unionByName(met))


def largest_common_reachable(objects: DataFrame, refs: DataFrame, first: int, second: int, index: GraphIndex | None = None) -> DataFrame:
    """The object of the largest subtree size that both can reach (the least id of several), as one summary row.

    No row if they share nothing.  Unknown ids raise LookupError; sizes that were never worked out ValueError.  ``index``: the condensed graph, if it was made before.
    """
    known = _summaries(objects, [first, second])
    for id_ in (first, second):
        if id_ not in known:
            raise LookupError(f"object {id_} is not in the dump")
        if known[id_]["subtree_size"] is None:
            raise ValueError(f"no subtree size in object {id_}")
    with Scratch(objects.sparkSession, "common") as work:
        graph = index or GraphIndex.build(objects, usable_refs(objects, refs), work.path())
        sides = _sides(work, objects, graph, first, second)
        both = sides.groupBy(F.col("id").alias("comp")).agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("comp")
        found = graph.component_of(objects.select(*SUMMARY)).join(sized(work.keep(both)), "comp", "left_semi")
        return cut(found.orderBy(F.desc("subtree_size"), "id").limit(1).select(*SUMMARY))


def largest_common_exact(objects: DataFrame, refs: DataFrame, first: int, second: int) -> DataFrame:
    """The row of :func:`largest_common_reachable` by exact sizes, for a dump of which no sizes are known; no row if they share nothing.

    What both reach holds all that any of it reaches, so sizes are worked out for that alone.
    """
    known = _summaries(objects, [first, second])
    for id_ in (first, second):
        if id_ not in known:
            raise LookupError(f"object {id_} is not in the dump")
    with Scratch(objects.sparkSession, "common") as work:
        both = work.keep(_both(_reached(work, objects, refs, _two(work, first, second))))
        own, _ = _weighed(work, objects, refs, both)
        return cut(own.orderBy(F.desc("subtree_size"), "id").limit(1).select(*SUMMARY))


def _two(work: Scratch, first: int, second: int) -> DataFrame:
    return work.keep(work.spark.createDataFrame([(first, 0), (second, 1)], "id long, side int"))


def _both(sides: DataFrame) -> DataFrame:
    """(id): what both sides hold."""
    return sides.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("id")


def _reached(work: Scratch, objects: DataFrame, refs: DataFrame, starts: DataFrame) -> DataFrame:
    """All that the starts (id, and maybe a column that tells groups of them apart; distinct, kept) reach by links that count, themselves included; kept.

    A hop reads the links of what was met last.  While that is few, as along a chain, no table is written for it (see :func:`_walked`).
    """
    columns = starts.columns
    nodes, links = objects.where(~F.col("is_skip")).select("id"), refs.select("src", "dst")
    fresh = seen = starts
    total = n = starts.count()
    while n:
        if n <= WALKED:
            met, last = _walked(nodes, links, seen, total, [tuple(r) for r in fresh.collect()])
            if met:
                seen, total = work.keep(seen.unionByName(work.spark.createDataFrame(met, starts.schema))), total + len(met)
            if not last:
                break
            fresh, n = work.keep(work.spark.createDataFrame(last, starts.schema)), len(last)
        told = looked_up(links, "src", fresh.withColumnRenamed("id", "src"), n).withColumnRenamed("dst", "id").select(*columns).distinct()
        told = work.keep(told.join(sized(seen, total), columns, "left_anti"))
        fresh = work.keep(looked_up(nodes, "id", told, told.count()).select(*columns))
        n = fresh.count()
        if n:
            seen, total = work.keep(seen.unionByName(fresh)), total + n
    return seen


def _walked(nodes: DataFrame, links: DataFrame, seen: DataFrame, total: int, fresh: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """What is met from few (id, ...), and those of it whose links are still to be followed (none: all is met).

    The driver follows links while a hop has at most WALKED of them, and at most WALKED hops: two or three jobs each.
    """
    known = {tuple(r) for r in seen.collect()} if total <= WALKED else None
    met, columns = [], seen.columns
    for _ in range(WALKED):
        if not 0 < len(fresh) <= WALKED:
            break
        # The limit is taken before rows are collected, and in one job.
        found = links.where(F.col("src").isin(list({r[0] for r in fresh}))).limit(WALKED + 1).agg(F.collect_list(F.struct("src", "dst"))).collect()[0][0]
        if len(found) > WALKED:
            break
        targets = {}
        for src, dst in found:
            targets.setdefault(src, set()).add(dst)
        told = {(dst, *r[1:]) for r in fresh for dst in targets.get(r[0], ()) if dst is not None}.difference(met, known or ())
        ids = list({r[0] for r in told})
        if ids and known is None:
            told.difference_update(tuple(r) for r in seen.where(F.col("id").isin(ids)).select(*columns).collect())
        entered = {r["id"] for r in nodes.where(F.col("id").isin(ids)).collect()} if told else ()
        fresh = [r for r in told if r[0] in entered]
        met += fresh
    return met, fresh


def _weighed(work: Scratch, objects: DataFrame, refs: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The objects, with exact sizes, and the refs of a kept set (id) that holds all that any of it reaches; both kept."""
    n = whole.count()
    own = work.keep(looked_up(objects, "id", whole, n))
    inside = work.keep(looked_up(refs, "src", whole.withColumnRenamed("id", "src"), n))
    found = exact_sizes(own, work.keep(usable_refs(own, inside))) if n else own.select("id", "subtree_size")
    return work.keep(own.drop("subtree_size").join(found, "id").select(*objects.columns)), inside


def common_report(objects: DataFrame, refs: DataFrame, first: int, second: int, index: GraphIndex | None = None) -> DataFrame:
    """(origin, step, summary...): the paths from both objects to what they share; no rows if nothing."""
    return _paths_to(objects, refs, first, second, largest_common_reachable(objects, refs, first, second, index).first())


def common_report_exact(objects: DataFrame, refs: DataFrame, first: int, second: int) -> DataFrame:
    """The rows of :func:`common_report` by exact sizes, for a dump of which no sizes are known.

    What either reaches holds all that any of it reaches, so sizes are worked out for that alone, and the paths are searched there.
    """
    if missing := {first, second} - _summaries(objects, [first, second]).keys():
        raise LookupError(f"object {min(missing)} is not in the dump")
    with Scratch(objects.sparkSession, "common") as work:
        sides = _reached(work, objects, refs, _two(work, first, second))
        own, inside = _weighed(work, objects, refs, work.keep(sides.select("id").distinct()))
        top = own.join(_both(sides), "id", "left_semi").orderBy(F.desc("subtree_size"), "id").first()
        return cut(_paths_to(own, inside, first, second, top))


def _paths_to(objects: DataFrame, refs: DataFrame, first: int, second: int, top) -> DataFrame:
    if top is None:
        return find_path(objects, refs, first, first).limit(0).select(F.lit(first).cast("long").alias("origin"), "step", *SUMMARY)
    one, two = (find_path(objects, refs, a, top["id"]).select(F.lit(a).cast("long").alias("origin"), "step", *SUMMARY) for a in (first, second))
    return one.unionByName(two)
