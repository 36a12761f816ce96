"""How many bytes each object can reach: exactly, or by a sketch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sets import estimated, estimates, known_of_trees, merge_sets, own_sets, summed, sums, sums_of_trees
from ..plans.storage import Scratch, cut, sized
from ..schema import Precision
from .dag import GraphIndex, accumulate
from .forest import gather
from .graph import ClosureTooLarge
from .units import reached, units_of

#: Exact sizes give up beyond so many chunks of reachable sets, unless told otherwise.
MAX_PAIRS = 10_000_000_000
#: Bits of a chunk (a power of two, at most 64).
CHUNK = 64
#: Trees of at most so many nodes are gathered within a task.
TREE = 50_000


def exact_sizes(objects: DataFrame, edges: DataFrame, max_pairs: int | None = MAX_PAIRS, index: GraphIndex | None = None) -> DataFrame:
    """(id, subtree_size): sizes summed over the distinct objects that each one reaches, itself included.  ``edges`` are links of objects, kept.

    Units (see :mod:`.units`) are elements that weigh as much as their trees, and sets of them travel as they are while they are small.  Where a set or a
    tree is too large for that, or the sets have more than ``max_pairs`` elements, all is done in chunks of 64 bits over the condensed graph (``index``, if it
    was made before); ClosureTooLarge is raised if the sets take more than ``max_pairs`` chunks (None: no bound).
    """
    found = _exact_by_sets(objects, edges, max_pairs)
    return _exact_by_chunks(objects, edges, max_pairs, index) if found is None else found


def _exact_by_sets(objects: DataFrame, edges: DataFrame, max_pairs: int | None) -> DataFrame | None:
    """Exact sizes by sets of units; None where sets or trees are too large."""
    with Scratch(objects.sparkSession, "sizes") as work:
        units = units_of(work, edges)
        trees = units.component(units.nodes.where("id <> top"))
        if not trees.groupBy("comp").agg(F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") > TREE).isEmpty():
            return None
        far, placed = units.placed(objects.select("id", "size"), "id")
        placed = work.keep(placed)
        apart = far.unionByName(placed.where("top IS NULL").select("id", "size"))
        inner = units.component(placed.where("top IS NOT NULL"))
        weights = inner.groupBy(F.col("comp").alias("id")).agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("weight")).withColumn("element", F.col("id"))
        of_comps = reached(work, units, own_sets(weights), lambda rows: merge_sets(rows, 0))
        if not of_comps.where(F.col("n") < 0).isEmpty():
            return None
        of_units = units.of_units(of_comps)
        brought = of_units.withColumnRenamed("id", "dst")
        lone = own_sets(apart.select("id", F.col("id").alias("element"), F.col("size").alias("weight")))
        others = summed(lone.unionByName(units.outer.join(brought, "dst").select(F.col("src").alias("id"), "n", "s")))
        nothing = [F.lit(0).alias("n"), F.lit(b"").alias("s")]
        own = inner.where("id <> top").select(F.col("comp").alias("top"), "parent", "id", F.coalesce("size", F.lit(0)).cast("long").alias("weight"), *nothing)
        told = units.component(units.exits.where("src <> top")).join(brought, "dst")
        told = told.select(F.col("comp").alias("top"), F.lit(None).cast("long").alias("parent"), F.col("src").alias("id"), F.lit(0).cast("long").alias("weight"), "n", "s")
        found = cut(others.unionByName(sums(of_units)).unionByName(sums_of_trees(own.unionByName(told))))
        lost, elements = found.agg(F.count_if(F.col("subtree_size").isNull()), F.sum("n")).first()
        if lost or (max_pairs is not None and (elements or 0) > max_pairs):
            return None
        return found.select("id", "subtree_size")


def _exact_by_chunks(objects: DataFrame, edges: DataFrame, max_pairs: int | None, index: GraphIndex | None) -> DataFrame:
    """Exact sizes of any graph.

    Over the acyclic graph of strong components (``index``, if it was made before).  Shared nodes are numbered, and sets of them are chunks of 64 bits, merged
    by OR.  A shared node weighs as much as its whole tree, which whoever reaches it reaches, too.  What a node reaches is its own tree, and the union of what
    the exits of that tree reach; no node of the tree is among that.  Raises ClosureTooLarge if the sets take more than ``max_pairs`` chunks (None: no bound).
    """
    with Scratch(objects.sparkSession, "sizes") as work:
        graph = index or GraphIndex.build(objects, edges)
        weights = objects.join(graph.members, "id", "left").groupBy(F.coalesce("comp", "id").alias("id")).agg(F.sum("size").cast("long").alias("size"))
        weights = work.keep(graph.up_trees(work, work.keep(weights), [], [F.sum("size").cast("long").alias("size")]))
        numbered = work.keep(graph.shared.withColumn("at", F.monotonically_increasing_id()))
        word, bit = F.expr(f"at div {CHUNK}").alias("word"), F.expr(f"shiftleft(1L, cast(at % {CHUNK} as int))").alias("bits")
        items = work.keep(numbered.select("id", word, bit))
        merge = [F.bit_or("bits").alias("bits")]
        of_core = accumulate(work, items, graph.core, graph.levelled, graph.depth, ["word"], merge)
        # One row a word, so each chunk meets one row: the sizes of its bits are picked from an array.
        words = items.join(weights, "id").groupBy("word").agg(F.collect_list(F.struct(F.col("bits").alias("bit"), "size")).alias("sizes"))
        far = F.aggregate("sizes", F.lit(0).cast("long"), lambda sum_, one: sum_ + F.when(F.col("bits").bitwiseAND(one["bit"]) != 0, one["size"]).otherwise(F.lit(0).cast("long")))
        words = work.keep(words)

        def priced(sets: DataFrame) -> DataFrame:
            return sets.join(words, "word").select("id", "word", "bits", far.alias("far"))

        of_core = work.keep(priced(of_core))
        inside, outer = graph.told(of_core)
        inside = work.keep(inside.groupBy("id", "word").agg(*merge))
        inside = graph.up_trees(work, inside, ["word"], merge)
        # Others take chunks as they are: where one chunk of a word holds all the bits, its price is known; only unions are priced anew.
        outer = outer.groupBy("id", "word").agg(*merge, F.max(F.struct(F.bit_count("bits").alias("n"), "bits", "far")).alias("most"))
        outer = work.keep(outer.select("id", "word", "bits", F.when(F.col("bits") == F.col("most.bits"), F.col("most.far")).alias("far")))
        parts = outer.where("far IS NOT NULL").unionByName(priced(outer.where("far IS NULL").select("id", "word", "bits").unionByName(inside)))
        summed = parts.groupBy("id").agg(F.sum("far").alias("far"), F.count(F.lit(1)).alias("chunks"))
        found = weights.join(summed, "id", "left").select(F.col("id").alias("comp"), (F.col("size") + F.coalesce("far", F.lit(0))).cast("long").alias("subtree_size"), "chunks")
        found = work.keep(found)
        if max_pairs is not None and (chunks := items.count() + (found.agg(F.sum("chunks")).first()[0] or 0)) > max_pairs:
            raise ClosureTooLarge(f"{chunks} chunks of reachable sets; use a sketch precision or raise max_pairs above {max_pairs}")
        found = found.drop("chunks")
        return _of_objects(objects.select("id"), graph, found, index is None)


def _of_objects(objects: DataFrame, graph: GraphIndex, found: DataFrame, passing: bool) -> DataFrame:
    """(id, subtree_size): each object has its component's.  A passing index is dropped."""
    out = cut(graph.component_of(objects).join(found, "comp").select("id", "subtree_size"))
    if passing:
        graph.drop()
    return out


def sketch_sizes(objects: DataFrame, edges: DataFrame, lanes: int, index: GraphIndex | None = None) -> DataFrame:
    """(id, subtree_size) estimated with so many lanes.  ``edges`` are links of objects, kept; an ``index`` is not needed.

    The sketch of what a node reaches is that of a set of objects, which is handed on as it is while it is small, and as lanes else (see :mod:`..functions.sets`).
    Sets of units (see :mod:`.units`) hold their trees.  Nodes of trees are gathered tree by tree, and those that nothing enters are done with one shuffle of what they are told.
    """
    with Scratch(objects.sparkSession, "sketches") as work:
        units = units_of(work, edges)
        far, placed = units.placed(objects.select("id", "size"), "id")
        placed = work.keep(placed)
        apart = far.unionByName(placed.where("top IS NULL").select("id", "size"))
        inner = units.component(placed.where("top IS NOT NULL"))
        own = own_sets(inner.select(F.col("comp").alias("id"), F.col("id").alias("element"), F.col("size").alias("weight")))
        of_units = units.of_units(reached(work, units, own, lambda rows: merge_sets(rows, lanes)))
        brought = of_units.withColumnRenamed("id", "dst")
        lone = own_sets(apart.select("id", F.col("id").alias("element"), F.col("size").alias("weight")))
        outer = lone.unionByName(units.outer.join(brought, "dst").select(F.col("src").alias("id"), "n", "s"))
        nodes = work.keep(inner.where("id <> top").select("id", F.col("comp").alias("top"), "parent", "size"))
        of_nodes = own_sets(nodes.withColumn("element", F.col("id")).withColumnRenamed("size", "weight"), "top", "parent")
        told = units.component(units.exits.where("src <> top")).join(brought, "dst")
        told = told.select(F.col("src").alias("id"), "n", "s", F.col("comp").alias("top"), F.lit(None).cast("long").alias("parent")).unionByName(of_nodes)
        # Trees that are too large for a task are climbed in rounds.
        large = work.keep(nodes.groupBy("top").agg(F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") > TREE).select("top"))
        if n_large := large.count():
            wide = sized(large, n_large)
            far = merge_sets(told.join(wide, "top", "left_semi").select("id", "n", "s"), lanes)
            inside = work.keep(nodes.join(wide, "top", "left_semi").select("id"))
            ups = [up.join(inside, "id", "left_semi").join(inside.withColumnRenamed("id", "top"), "top", "left_semi").select("id", "top") for up in units.ups]
            outer = outer.unionByName(gather(work, work.keep(far), ups, [], lambda rows: merge_sets(rows, lanes)))
            told = told.join(wide, "top", "left_anti")
        return cut(estimated(outer, lanes).unionByName(estimates(of_units, lanes)).unionByName(estimates(known_of_trees(told, lanes), lanes)))


def subtree_sizes(objects: DataFrame, edges: DataFrame, precision: Precision, max_pairs: int | None = MAX_PAIRS, index: GraphIndex | None = None) -> DataFrame:
    """(id, subtree_size) at a precision; null sizes for none.  ``max_pairs`` bounds the exact one."""
    if precision is Precision.NONE:
        return objects.select("id", F.lit(None).cast("long").alias("subtree_size"))
    if precision is Precision.EXACT:
        return exact_sizes(objects, edges, max_pairs, index)
    return sketch_sizes(objects, edges, precision.lanes, index)
