"""The acyclic graph of strong components: its nodes, links and levels, and values merged along its links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import Scratch, filesystem, fresh_path, sized
from .components import strong_components
from .forest import Merge, climb, entered, gather, grouped


@dataclass
class Condensed:
    """nodes: comp, size, members.  links: distinct (src, dst) between components.  members: id, comp of components of several objects."""

    nodes: DataFrame
    links: DataFrame
    members: DataFrame


def condense(work: Scratch, objects: DataFrame, edges: DataFrame, members: DataFrame | None = None) -> Condensed:
    """Contract each strong component to one node, named by its least id, of the size of all its members.

    ``edges``: distinct (src, dst).  ``members``: id, scc_id of the components of several objects (see :func:`strong_components`, which makes them if not given).
    nodes and links are not kept.  Only what touches a component of several objects is grouped anew; the rest is as it was.
    """
    known = work.keep((strong_components(edges) if members is None else members).select("id", F.col("scc_id").alias("comp")))
    near = sized(known)
    weighed = objects.select("id", "size").join(near, "id", "left")
    alone = weighed.where("comp IS NULL").select(F.col("id").alias("comp"), F.col("size").cast("long").alias("size"), F.lit(1).cast("long").alias("members"))
    grouped = weighed.where("comp IS NOT NULL").groupBy("comp").agg(F.sum("size").cast("long").alias("size"), F.count(F.lit(1)).alias("members"))
    links = edges.select("src", "dst")
    for end in ("src", "dst"):
        links = links.join(near.select(F.col("id").alias(end), F.col("comp").alias(f"{end}_comp")), end, "left")
    moved = F.col("src_comp").isNotNull() | F.col("dst_comp").isNotNull()
    renamed = links.where(moved).select(F.coalesce("src_comp", "src").alias("src"), F.coalesce("dst_comp", "dst").alias("dst")).distinct()
    return Condensed(alone.unionByName(grouped), links.where(~moved).select("src", "dst").unionByName(renamed).where("src <> dst"), known)


def levels(work: Scratch, nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """(id, level) and the number of levels: 0 for what has no links out, else one more than the highest target.

    One round for each level: what has no links left is peeled off, and so are the links into it.  Links that go round in a cycle raise ValueError.
    """
    path, left, level = work.path(), nodes.select("id"), 0
    while not left.isEmpty():
        waiting = links.select(F.col("src").alias("id")).distinct()
        ready = work.keep(left.join(waiting, "id", "left_anti"))
        ready.withColumn("level", F.lit(level)).write.mode("append").parquet(path)
        if ready.isEmpty():
            raise ValueError("the links go round in a cycle")
        left = work.keep(left.join(waiting, "id", "left_semi"))
        links = work.keep(links.join(ready.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
        level += 1
    schema = f"id {nodes.schema['id'].dataType.simpleString()}, level int"
    return (work.spark.read.schema(schema).parquet(path) if level else work.spark.createDataFrame([], schema)), level


def accumulate(work: Scratch, own: DataFrame, links: DataFrame, levelled: DataFrame, depth: int, keys: list[str], merge: Merge) -> DataFrame:
    """Merge the values of each node with those of all nodes that it reaches: rows of id, keys and values, as in ``own``.

    Level by level from below.  Each link is used once: when a node's values are complete, they are sent to its
    sources, filed under the level at which those read them.
    """
    inbox, done = work.path(), work.path()
    schema = own.schema
    of_source = levelled.select(F.col("id").alias("src"), F.col("level").alias("reads"))
    sent = work.keep(links.join(of_source, "src").join(levelled.select(F.col("id").alias("dst"), "level"), "dst").select("src", "dst", "level", "reads"))
    placed = work.keep(own.join(levelled, "id"))
    for level in range(depth):
        now = placed.where(F.col("level") == level).drop("level")
        if level:
            now = now.unionByName(work.spark.read.schema(schema).parquet(f"{inbox}/reads={level}"))
        grouped(now, keys, merge).select(*schema.names).write.parquet(f"{done}/level={level}")
        now = work.spark.read.schema(schema).parquet(f"{done}/level={level}")
        if level + 1 < depth:
            told = now.withColumnRenamed("id", "dst").join(sent.where(F.col("level") == level).select("src", "dst", "reads"), "dst").drop("dst").withColumnRenamed("src", "id")
            told.write.mode("append").partitionBy("reads").parquet(inbox)
    return work.spark.read.schema(schema).parquet(*[f"{done}/level={k}" for k in range(depth)]) if depth else own.limit(0)


class GraphIndex:
    """The condensed graph of a dump as Parquet tables, on which sizes and searches work.

    nodes: comp, size, members.  links: (src, dst) between components.  members: (id, comp) of components of several objects.
    tops: (id, top) of nodes that a single link enters: the root of their tree.  ups: for each k, (id, top) exactly 2**k links up.
    shared: (id) nodes that several links enter; they alone are parts of what several others reach.  In links, ``inner`` marks sources that are shared, in a
    tree or its root; of the others nothing is ever handed on.  exits: (src, dst) links of inner nodes into shared ones.
    core: (src, dst) from shared nodes, by any exit of their trees, to shared nodes.  levelled: (id, level) of shared nodes; depth: how many levels.
    """

    TABLES = ("nodes", "links", "members", "tops", "shared", "exits", "core", "levelled")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        sizes = spark.read.json(f"{path}/sizes").first()
        self.rounds, self.depth = sizes["rounds"], sizes["depth"]
        for name in self.TABLES:
            setattr(self, name, spark.read.parquet(f"{path}/{name}"))
        self.ups = [spark.read.parquet(f"{path}/ups/{k}") for k in range(self.rounds)]

    @classmethod
    def build(cls, objects: DataFrame, edges: DataFrame, path: str | None = None, members: DataFrame | None = None) -> GraphIndex:
        """Condense the graph, contract its trees and level what is left; ``path`` is where the tables are kept (None: the shared folder)."""
        spark = objects.sparkSession
        path = path or fresh_path(spark, "graph-index")

        def keep(name: str, df: DataFrame) -> DataFrame:
            df.write.parquet(f"{path}/{name}")
            return spark.read.schema(df.schema).parquet(f"{path}/{name}")

        with Scratch(spark, "index") as work:
            dag = condense(work, objects, edges, members)
            keep("nodes", dag.nodes)
            keep("members", dag.members)
            sources = work.keep(entered(dag.links))
            forest = climb(work, work.keep(sources.where("top = other").select("id", "top")))
            tops = keep("tops", forest.tops.select("id", "top"))
            # The last round has no node that is so deep.
            ups = forest.ups[:-1]
            for k, up in enumerate(ups):
                keep(f"ups/{k}", up)
            shared = keep("shared", sources.where("top <> other").select("id"))
            inner = work.keep(tops.select("id").unionByName(tops.select(F.col("top").alias("id"))).unionByName(shared).distinct())
            marks = sized(inner.select(F.col("id").alias("src"), F.lit(True).alias("mark")), inner.count())
            links = keep("links", dag.links.join(marks, "src", "left").select("src", "dst", F.coalesce("mark", F.lit(False)).alias("inner")))
            exits = keep("exits", links.where("inner").join(shared.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"))
            outer = exits.join(tops.withColumnRenamed("id", "src"), "src", "left").select(F.coalesce("top", "src").alias("src"), "dst").distinct()
            core = keep("core", outer.join(shared.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst"))
            levelled, depth = levels(work, shared, core)
            keep("levelled", levelled)
        spark.createDataFrame([(len(ups), depth)], "rounds int, depth int").coalesce(1).write.json(f"{path}/sizes")
        return cls(spark, path)

    def drop(self) -> None:
        fs, path = filesystem(self.spark, self.path)
        fs.delete(path, True)

    def component_of(self, objects: DataFrame) -> DataFrame:
        """The objects with the component (comp) of each."""
        return objects.join(self.members, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def exits_of(self, found: DataFrame) -> DataFrame:
        """Links into shared nodes of the sources that ``found`` (src, more columns) names: its rows with dst."""
        outer = self.links.where("NOT inner").select("src", "dst").join(found, "src").join(self.shared.select(F.col("id").alias("dst")), "dst", "left_semi")
        return self.exits.join(found, "src").unionByName(outer)

    def up_trees(self, work: Scratch, rows: DataFrame, keys: list[str], merge: list[Column]) -> DataFrame:
        """Values (id, keys, values) merged with those of all nodes below in the trees; nodes that are in no tree keep their own."""
        if not self.rounds:
            return rows
        inside = work.keep(self.ups[0].select("id").unionByName(self.ups[0].select(F.col("top").alias("id"))).distinct())
        climbed = gather(work, work.keep(rows.join(inside, "id", "left_semi")), self.ups, keys, merge)
        return climbed.unionByName(rows.join(inside, "id", "left_anti"))

    def told(self, of_core: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What links into shared nodes bring of what those have (id, more columns): to inner nodes, and to the others."""
        brought = of_core.withColumnRenamed("id", "dst")
        return tuple(links.join(brought, "dst").drop("dst").withColumnRenamed("src", "id") for links in (self.exits, self.links.where("NOT inner").select("src", "dst")))
