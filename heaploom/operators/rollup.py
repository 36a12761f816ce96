"""Objects and bytes by type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ALL_TYPES, PAGE_SIZE


def type_summaries(objects: DataFrame, sort_by: str | None = None) -> DataFrame:
    """(type, is_total, count, total_size) with a total row; no rows for no objects.

    sort_by: "count" (also for unknown names) or "size", descending, or "type"; ties by type.  None: no order.
    """
    out = (
        objects.groupingSets([[F.col("type")], []], "type")
        .agg(F.grouping("type").cast("boolean").alias("is_total"), F.count(F.lit(1)).alias("count"), F.sum("size").cast("long").alias("total_size"))
        .where("count > 0")
        .select(F.when(F.col("is_total"), F.lit(ALL_TYPES)).otherwise(F.col("type")).alias("type"), "is_total", "count", "total_size")
    )
    if sort_by is None:
        return out
    keys = {"type": [], "size": [F.desc("total_size")]}.get(sort_by, [F.desc("count")])
    return out.orderBy(*keys, "type", "is_total")


def of_type(objects: DataFrame, type_: str) -> DataFrame:
    return objects if type_ == ALL_TYPES else objects.where(F.col("type") == type_)


def type_count(objects: DataFrame, type_: str) -> DataFrame:
    """One row: how many objects of the type there are (0 for an unknown one), and their pages."""
    counted = of_type(objects, type_).agg(F.count(F.lit(1)).alias("count"))
    return counted.select("count", F.expr(f"(count + {PAGE_SIZE - 1}) div {PAGE_SIZE}").alias("pages"))
