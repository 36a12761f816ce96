"""Trees of nodes that one link alone enters: pointers that double, and values carried up the trees.

Where a node has a single link into it, whatever reaches the node from outside reaches the link's source first.  Such links form
trees (and cycles that nothing enters), and a tree of any depth is climbed in as many rounds as the logarithm of its depth.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Scratch


def only_entries(edges: DataFrame) -> DataFrame:
    """(id, top): nodes with links from a single source into them, and that source.  ``edges``: (src, dst), no loops."""
    return entered(edges).where("top = other").select("id", "top")


def entered(edges: DataFrame) -> DataFrame:
    """(id, top, other): nodes that links enter, and the least and the largest of their sources."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("top"), F.max("src").alias("other"))


@dataclass
class Forest:
    """Pointers (id, top, full, low) of each round k: top lies 2**k links up if ``full``, else it is where the way up ends.

    cyclic: there are ways that never end, as they lead into a cycle; then there is low, too, the least node met on the way so far.
    """

    pointers: list[DataFrame]
    cyclic: bool

    @property
    def tops(self) -> DataFrame:
        """Where each node's way up ends; ways that never end are ``full``."""
        return self.pointers[-1]

    @property
    def ups(self) -> list[DataFrame]:
        """(id, top) for each k: exactly 2**k links up, where there are so many."""
        return [p.where("full").select("id", "top") for p in self.pointers]


def climb(work: Scratch, entries: DataFrame, lows: bool = False) -> Forest:
    """Double the pointers until every way up has ended, or must be on a cycle as it is longer than there are nodes.

    Ways that have ended are not looked up again.  The least nodes of ways (``lows``) are only worked out, from the start, where there are cycles.
    """
    low = [F.least("id", "top").alias("low")] if lows else []
    now = work.keep(entries.select("id", "top", F.lit(True).alias("full"), *low))
    pointers, size, reach = [now], now.count(), 1
    while size and now.where("full").count():
        if reach > size:
            return Forest(pointers, True) if lows else climb(work, entries, True)
        on = now.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("full").alias("on"), *(F.col("low").alias("low_on") for _ in low))
        met = now.where("full").join(on, "top", "left")
        least = [F.least("low", F.coalesce("low_on", "low")).alias("low")] if lows else []
        further = met.select("id", F.coalesce("next", "top").alias("top"), F.coalesce("on", F.lit(False)).alias("full"), *least)
        now = work.keep(further.unionByName(now.where("NOT full")))
        pointers.append(now)
        reach *= 2
    return Forest(pointers, False)


#: Aggregates named like the values, or what merges rows by id (without keys).
Merge = list[Column] | Callable[[DataFrame], DataFrame]


def grouped(rows: DataFrame, keys: list[str], merge: Merge) -> DataFrame:
    """The values of each id (and keys) merged."""
    return merge(rows) if callable(merge) else rows.groupBy("id", *keys).agg(*merge)


def gather(work: Scratch, rows: DataFrame, ups: list[DataFrame], keys: list[str], merge: Merge) -> DataFrame:
    """Merge the values of each node with those of all nodes below it in its tree.

    ``rows``: id, keys and values; ``ups``: see :class:`Forest`.  In round k a node hands what it has
    of its nearest 2**k levels to its ancestor 2**k links up, so each value reaches each ancestor once, and sums are right, too.
    """
    for up in ups:
        moved = rows.join(up, "id").drop("id").withColumnRenamed("top", "id")
        rows = work.keep(grouped(rows.unionByName(moved), keys, merge))
    return rows


def below(work: Scratch, nodes: DataFrame, ups: list[DataFrame], keys: list[str]) -> DataFrame:
    """(id, keys): the nodes and everything below them in their trees."""
    for up in ups:
        found = up.join(nodes.withColumnRenamed("id", "top"), "top").select("id", *keys)
        nodes = work.keep(nodes.select("id", *keys).unionByName(found).distinct())
    return nodes


def ancestors(work: Scratch, nodes: DataFrame, forest: Forest) -> DataFrame:
    """(id): the nodes and everything above them in their trees."""
    for pointer in forest.pointers:
        nodes = work.keep(nodes.unionByName(nodes.join(pointer, "id").select(F.col("top").alias("id"))).distinct())
    return nodes
