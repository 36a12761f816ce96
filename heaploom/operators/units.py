"""What sizes need of a graph: nodes that nothing enters set apart, trees of single entries as one unit each, and the links between units."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Scratch, sized
from .components import strong_components
from .dag import accumulate, levels
from .forest import climb, entered

#: So many ids (as bits) are told apart by their range; ranges without any entered node hold sources that nothing enters.
RANGE_BITS = 16


@dataclass
class Units:
    """Nodes that nothing enters are part of nothing but themselves: most links are theirs, and are used once, at the end.

    Of the others, a node that one link alone enters, from a node that is entered itself, belongs to the tree of that node; all others are units, the roots of those
    trees.  Every link but those of trees leads to a unit, and who reaches a unit reaches its whole tree.

    near: (range) of ids that hold entered nodes.  nodes: (id, top, parent) of all that links enter: the unit, and the link's source within a tree (null: the unit is next).  ups: see :class:`.forest.Forest`.
    outer: (src, dst) links of nodes that nothing enters.  exits: (src, top, dst) links of others into units.  members: (id, comp) of units on cycles of units.
    core: (src, dst) between components of units, without cycles.
    """

    near: DataFrame
    nodes: DataFrame
    ups: list[DataFrame]
    outer: DataFrame
    exits: DataFrame
    members: DataFrame
    n_members: int
    core: DataFrame

    def placed(self, rows: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
        """Rows whose id lies in a range without entered nodes, as they are; and the others with top and parent (null: nothing enters it)."""
        return _placed(rows, id_, self.near, self.nodes)

    def component(self, rows: DataFrame, unit: str = "top") -> DataFrame:
        """Rows with the component (comp) of a unit; null stays null."""
        if not self.n_members:
            return rows.withColumn("comp", F.col(unit))
        return rows.join(sized(self.members, self.n_members).withColumnRenamed("id", unit), unit, "left").withColumn("comp", F.coalesce("comp", unit))

    def of_units(self, sets: DataFrame) -> DataFrame:
        """What components have (id, more columns) for each of their units."""
        if not self.n_members:
            return sets
        named = sized(self.members, self.n_members).select(F.col("comp").alias("id"), F.col("id").alias("unit"))
        return sets.join(named, "id", "left").withColumn("id", F.coalesce("unit", "id")).select(*sets.columns)


def _placed(rows: DataFrame, id_: str, near: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    ranged = rows.withColumn("range", F.shiftright(F.col(id_), RANGE_BITS))
    far = ranged.join(near, "range", "left_anti").select(*rows.columns)
    return far, ranged.join(near, "range", "left_semi").join(nodes.withColumnRenamed("id", id_), id_, "left").select(*rows.columns, "top", "parent")


def units_of(work: Scratch, edges: DataFrame) -> Units:
    """``edges``: distinct (src, dst), kept."""
    links = edges.select("src", "dst").where("src <> dst")
    met = work.keep(entered(links))
    entries = met.where("top = other").select("id", "top").join(met.select(F.col("id").alias("top")), "top", "left_semi").select("id", "top")
    forest = climb(work, work.keep(entries))
    tree = forest.pointers[0].select("id", "top")
    if forest.cyclic:
        # A cycle of single entries is cut at its least node, which becomes a unit.
        endless = forest.tops.where("full")
        heads = endless.join(endless.select(F.col("top").alias("id")).distinct(), "id", "left_semi").select(F.col("low").alias("id")).distinct()
        forest = climb(work, work.keep(tree.join(heads, "id", "left_anti")))
        tree = forest.pointers[0].select("id", "top")
    placed = forest.tops.select("id", "top").join(tree.select("id", F.col("top").alias("parent")), "id").select("id", "top", F.expr("nullif(parent, top)").alias("parent"))
    nodes = work.keep(met.select("id").join(placed, "id", "left").select("id", F.coalesce("top", "id").alias("top"), "parent"))
    # Sources in ranges that hold no entered node are told apart without a look-up.
    ranges = work.keep(met.select(F.shiftright(F.col("id"), RANGE_BITS).alias("range")).distinct())
    near = sized(ranges)
    far, asked = _placed(links, "src", near, nodes)
    asked = work.keep(asked.select("src", "dst", "top"))
    outer = far.unionByName(asked.where("top IS NULL").select("src", "dst"))
    exits = work.keep(asked.where("top IS NOT NULL").join(tree.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "top", "dst"))
    core = work.keep(exits.where("top <> dst").select(F.col("top").alias("src"), "dst").distinct())
    members = work.keep(strong_components(core).select("id", F.col("scc_id").alias("comp")))
    few = members.count()
    if few:
        for end in ("src", "dst"):
            core = core.join(sized(members, few).select(F.col("id").alias(end), F.col("comp").alias(f"{end}_comp")), end, "left").withColumn(end, F.coalesce(f"{end}_comp", end)).drop(f"{end}_comp")
        core = work.keep(core.where("src <> dst").select("src", "dst").distinct())
    return Units(near, nodes, forest.ups, outer, exits, members, few, core)


def reached(work: Scratch, units: Units, own: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The sets of components (rows of id and more, as in ``own``) merged with those of all that they reach; ``merge`` makes one row of an id's rows.

    Components that no other leads to hand nothing on: only the others go by level, and those are done with one step.
    """
    ends = work.keep(units.core.select(F.col("dst").alias("id")).distinct())
    sources = ends.withColumnRenamed("id", "src")
    between = work.keep(units.core.join(sources, "src", "left_semi").select("src", "dst"))
    levelled, depth = levels(work, ends, between)
    below = accumulate(work, merge(own.join(ends, "id", "left_semi").select(*own.columns)), between, levelled, depth, [], merge)
    told = units.core.join(sources, "src", "left_anti").join(below.withColumnRenamed("id", "dst"), "dst").withColumnRenamed("src", "id").select(*own.columns)
    above = merge(own.join(ends, "id", "left_anti").select(*own.columns).unionByName(told))
    return work.keep(below.select(*own.columns).unionByName(above))
