"""Strong components from links alone, and the acyclic graph of components with its levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Scratch, cut, sized
from .forest import Forest, ancestors, climb, only_entries

#: Trimming goes on while a pass removes so much of the links; then trees are contracted or labels sent round.
WORTH = 0.2


@dataclass
class _Contraction:
    """What one contraction did: the links before it, and the trees and cycles that became one node each."""

    edges: DataFrame
    forest: Forest
    names: DataFrame  # id, name: the node that stands for it from now on
    cycles: DataFrame  # id, name: nodes on cycles of single entries


def _trimmed(work: Scratch, edges: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Without links of nodes that nothing enters or leaves, pass by pass, as long as it is worth it."""
    while n:
        # Nodes with links both in and out.  The first join shuffles all links, the second and the rest only what it left.
        sources, targets = edges.select(F.col("src").alias("id")).distinct(), edges.select(F.col("dst").alias("id")).distinct()
        inner = work.keep(sources.join(targets, "id", "left_semi"))
        few = inner.count()
        kept = edges
        for end in ("src", "dst"):
            kept = kept.join(sized(inner.withColumnRenamed("id", end), few), end, "left_semi")
        kept = work.keep(kept.select("src", "dst").distinct())
        before, n = n, kept.count()
        edges = kept
        if n > (1 - WORTH) * before:
            break
    return edges, n


def _contract(work: Scratch, edges: DataFrame) -> _Contraction | None:
    """Trees of single entries become their roots, and cycles of single entries their least node."""
    entries = work.keep(only_entries(edges))
    if entries.isEmpty():
        return None
    forest = climb(work, entries)
    if not forest.cyclic:
        return _Contraction(edges, forest, work.keep(forest.tops.select("id", F.col("top").alias("name"))), entries.limit(0).select("id", F.col("top").alias("name")))
    # Ways that never end have reached their cycle: their ends are on it, and an end's own way went round it.
    endless = forest.tops.where("full")
    ends = endless.select(F.col("top").alias("id")).distinct()
    cycles = work.keep(endless.join(ends, "id", "left_semi").select("id", F.col("low").alias("name")))
    of_end = cycles.select(F.col("id").alias("top"), "name")
    names = forest.tops.join(of_end, "top", "left").select("id", F.coalesce("name", "top").alias("name"))
    return _Contraction(edges, forest, work.keep(names), cycles)


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """The links between the nodes that stand for others, without loops."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(names.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name")), end, "left").withColumn(end, F.coalesce(f"{end}_name", end)).drop(f"{end}_name")
    return out.where("src <> dst").select("src", "dst").distinct()


def _labelled(work: Scratch, edges: DataFrame) -> DataFrame:
    """(id, label) of the components that hold the least node that reaches each of their nodes.

    Forward, every node takes the least label of those before it, until none changes; backward from the nodes that kept their own, what
    lies under the same label is one component.  Only nodes whose label fell in the last round speak in the next.
    """
    labels = work.keep(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().select("id", F.col("id").alias("label")))
    fresh = labels
    while not fresh.isEmpty():
        told = fresh.join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("told"))
        met = work.keep(labels.join(told, "id", "left"))
        fresh = work.keep(met.where("told < label").select("id", F.col("told").alias("label")))
        labels = met.select("id", F.least("label", F.coalesce("told", "label")).alias("label"))
    labels = work.keep(labels)
    inner = edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    inner = work.keep(inner.where("a = b").select("src", "dst"))
    found = work.keep(labels.where("id = label"))
    fresh = found
    while True:
        back = inner.join(fresh.select(F.col("id").alias("dst"), "label"), "dst").select(F.col("src").alias("id"), "label").distinct()
        fresh = work.keep(back.join(found, "id", "left_anti"))
        if fresh.isEmpty():
            return found
        found = work.keep(found.unionByName(fresh))


def _expanded(work: Scratch, step: _Contraction, labels: DataFrame) -> DataFrame:
    """Labels (id, label; others are components of their own) of the nodes that a contraction had, from those it left.

    A node of a tree is in its root's component if something below it leads back into that component.
    """
    stands = step.names.select("id", "name")
    named = labels.select(F.col("id").alias("name"), "label")
    # Links out of trees, whose target no tree holds, or that lead back to a root.
    exits = step.edges.join(step.forest.pointers[0].select(F.col("id").alias("dst")), "dst", "left_anti")
    met = exits.join(stands.select(F.col("id").alias("src"), F.col("name").alias("root")), "src")
    met = met.join(named.select(F.col("name").alias("root"), F.col("label").alias("own")), "root", "left").join(named.select(F.col("name").alias("dst"), F.col("label").alias("other")), "dst", "left")
    marked = work.keep(met.where(F.coalesce("own", "root") == F.coalesce("other", "dst")).select(F.col("src").alias("id")).distinct())
    if marked.isEmpty() and not step.forest.cyclic:
        return labels
    inside = ancestors(work, marked, step.forest).join(stands, "id").select("id", "name")
    whole = inside.unionByName(step.cycles).distinct()
    grown = whole.join(named, "name", "left").select("id", F.coalesce("label", "name").alias("label"))
    roots = whole.select(F.col("name").alias("id")).distinct().join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    return work.keep(grown.unionByName(roots).unionByName(labels).distinct())


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, scc_id) of the nodes on cycles of several nodes; scc_id is the least id of the component.

    From the links alone; no reachable pairs are made.  Nodes that nothing enters or leaves are trimmed.  Where that removes little (long
    chains), trees of nodes with a single link into them become one node, in as many rounds as the logarithm of their depth, and so do cycles of such nodes.  What
    neither makes smaller is split by labels sent forward and back, in as many rounds as its longest shortest way.

    ``edges``: src, dst; repeated links, loops and nulls do no harm.  No links: no rows.  Only counts reach the driver.
    """
    with Scratch(edges.sparkSession, "components") as work:
        now = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst")
        n, steps, found = now.count(), [], []
        while n:
            now, n = _trimmed(work, now, n)
            if not n:
                break
            step = _contract(work, now)
            smaller, m = None, n
            if step is not None:
                smaller = work.keep(_renamed(now, step.names))
                m = smaller.count()
                steps.append(step)
            if m <= (1 - WORTH) * n:
                now, n = smaller, m
                found.append(None)
                continue
            now = now if smaller is None else smaller
            labels = _labelled(work, now)
            found.append(labels)
            if step is None:
                steps.append(None)
            done = labels.select(F.col("id").alias("src"))
            now = work.keep(now.join(done, "src", "left_anti").join(done.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))
            n = now.count()
        labels = work.keep(edges.select(F.col("src").alias("id"), F.col("src").alias("label")).limit(0))
        for step, own in zip(reversed(steps), reversed(found), strict=True):
            if own is not None:
                labels = work.keep(labels.unionByName(own))
            if step is not None:
                labels = _expanded(work, step, labels)
        sizes = labels.groupBy("label").agg(F.min("id").alias("scc_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
        return cut(labels.join(sizes, "label").select("id", "scc_id"))


def component_sizes(objects: DataFrame, members: DataFrame) -> DataFrame:
    """(scc_id, members, size): objects and bytes of each component of :func:`strong_components`."""
    return (
        members.join(objects.select("id", "size"), "id")
        .groupBy("scc_id")
        .agg(F.count(F.lit(1)).alias("members"), F.sum("size").cast("long").alias("size"))
    )
