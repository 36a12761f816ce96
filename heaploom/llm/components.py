"""Connected components of a graph that no machine holds, by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, cut, lean


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes reaches over edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of edges as stars around the least node that each reaches within the batch."""
    for batch in batches:
        nodes, at = np.unique(np.concatenate([batch.column("a").to_numpy(), batch.column("b").to_numpy()]), return_inverse=True)
        half = batch.num_rows
        root = nodes[roots(len(nodes), at[:half], at[half:])]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != root]), pa.array(root[nodes != root])], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the least one: the larger neighbours (large star), or all smaller ones and u."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    out = met.where("v > u") if large else met
    pairs = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        pairs = pairs.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return pairs.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node with an edge can reach.

    ``edges``: columns a and b (numbers), in any direction, repeated or not; loops are ignored.  First each task contracts
    the edges it holds, batch by batch.  Each round then is two aggregates (combined before they shuffle) and two joins; at a node of very
    many edges these are split by AQE.  The number of rounds grows with the logarithm of the nodes.  Only
    counts reach the driver.  Null ends are ignored.  No edges: no rows.
    """
    with Workspace(edges.sparkSession, "components") as work:
        now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
        now = work.keep(now.mapInArrow(lean(_contract), "a long, b long").distinct())
        sign = F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).alias("sign")
        before = None
        while (state := tuple(now.agg(sign).first()["sign"])) != before and state[0]:
            before = state
            now = work.keep(_star(work.keep(_star(now, True)), False))
        nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        return cut(nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
