"""The links that count: present targets that are not skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut, sized


class ClosureTooLarge(RuntimeError):
    """The reachable sets pass the budget; a sketch precision needs none of them."""


def usable_refs(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """Distinct (src, dst) whose source and target are objects and whose target is not skipped.

    Skipped targets, which many links may lead to, are left out first; then the links are shuffled once, by target, and stay dealt out so: who groups them by target
    next has all links of one together.  Missing sources are found among the distinct ones, which are fewer than the links.
    """
    skipped = cut(objects.where("is_skip").select(F.col("id").alias("dst")))
    links = refs.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").join(sized(skipped), "dst", "left_anti")
    present = links.join(objects.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    lost = cut(refs.where("src IS NOT NULL").select("src").distinct().join(objects.select(F.col("id").alias("src")), "src", "left_anti"))
    return present.join(sized(lost), "src", "left_anti").select("src", "dst")


def barred_targets(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """(dst): what links lead to that is not among the objects, once each, kept; null if there are links to null."""
    return cut(refs.select("dst").distinct().join(objects.select(F.col("id").alias("dst")), "dst", "left_anti"))
