"""Contiguous shards of near-equal size from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 24,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 8,
) -> DataFrame:
    """Deal all rows, in order of id, into ``shards`` contiguous shards of near-equal bytes.

    A row's size is the UTF-8 length of its text plus ``overhead``.  The rows are reduced to
    (id, size, checksum), ordered by range over the cluster and kept; each partition's total
    gives the global offset at which the next one starts, and a row goes to the shard in whose
    equal part of the total its middle byte lies.  So a shard differs from the mean by less
    than the largest row.  Only one total per partition, and one count per partition and shard
    that meet, reach the driver.

    Returns doc_id, size, text_crc32, shard, slot (0, 1, ... within each shard).

    Null text: size ``overhead``, checksum 0.  Null ids sort first.  Rows that are equal in all
    these columns are kept and told apart by their place in the input, so repeated rows, even
    a third of the table, spread over partitions.  Empty table: no rows.  Other columns of the
    input, whatever their names, are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(overhead)).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["doc_id", "text_crc32", "size", "tie"]
    ordered = cut(
        rows.repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
        .select("doc_id", "size", "text_crc32", F.spark_partition_id().alias("part"))
    )

    totals = ordered.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect()
    start, before = {}, 0
    for row in totals:
        start[row["part"]], before = before, before + row["size"]
    total = before

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            size = batch.column("size").to_numpy()
            at = start[part] if at is None else at
            ends = at + np.cumsum(size)
            middle = 2 * (ends - size) + size
            # Python's integers: the product can pass 64 bits.
            step = 2 * total
            shard = [min(shards - 1, int(m) * shards // step) for m in middle[[0, -1]]]
            if shard[0] == shard[1]:
                shard = np.full(len(size), shard[0], dtype=np.int32)
            else:
                shard = np.array([min(shards - 1, m * shards // step) for m in middle.tolist()], dtype=np.int32)
            at = int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), batch.column("text_crc32"), batch.column("part"), pa.array(shard)],
                names=["doc_id", "size", "text_crc32", "part", "shard"],
            )

    id_type = ordered.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, size long, text_crc32 long, part int, shard int"
    placed = ordered.mapInArrow(place, schema)

    first, seen = {}, {}
    for row in placed.groupBy("part", "shard").count().orderBy("part", "shard").collect():
        first[row["part"], row["shard"]] = seen.get(row["shard"], 0)
        seen[row["shard"]] = seen.get(row["shard"], 0) + row["count"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nxt: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            shard = batch.column("shard").to_numpy()
            slot = np.empty(len(shard), dtype=np.int64)
            edges = np.flatnonzero(np.diff(shard)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(shard)], strict=True):
                s = int(shard[lo])
                at = nxt.get(s, first[part, s])
                slot[lo:hi] = np.arange(at, at + hi - lo)
                nxt[s] = at + hi - lo
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "size", "text_crc32", "shard")] + [pa.array(slot)],
                names=["doc_id", "size", "text_crc32", "shard", "slot"],
            )

    return placed.mapInArrow(number, f"doc_id {id_type}, size long, text_crc32 long, shard int, slot long")
