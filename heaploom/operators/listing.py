"""Pages of objects, and one object with its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut, sized
from ..schema import ALL_TYPES, PAGE_SIZE, SUMMARY
from .graph import barred_targets
from .rollup import of_type

#: So many objects are looked up by a filter.
FEW = 1_000


def objects_of_type(objects: DataFrame, type_: str = ALL_TYPES, sort: str = "id", page: int | None = None, first_page: int = 0) -> DataFrame:
    """Summaries of a type by id, or by size or subtree_size, largest first and then by id.

    Pages start at ``first_page`` (lower numbers mean the first one, too) and have PAGE_SIZE rows; None: all.  A page is a top-k, not a full sort.  The order by
    subtree_size lists only objects that have one.  Unknown orders mean id.
    """
    found = of_type(objects, type_).select(*SUMMARY)
    if sort == "subtree_size":
        found = found.where("subtree_size IS NOT NULL")
    keys = [F.desc(sort)] if sort in ("size", "subtree_size") else []
    found = found.orderBy(*keys, "id")
    return found if page is None else found.offset(max(0, page - first_page) * PAGE_SIZE).limit(PAGE_SIZE)


def page_by_subtree_size(objects: DataFrame, sizes: DataFrame, page: int, first_page: int = 0) -> DataFrame:
    """The same page by subtree_size where sizes (id, subtree_size) are a stored table of their own: only the page's objects are read, none are joined for the order."""
    place = max(0, page - first_page) * PAGE_SIZE
    listed = cut(sizes.where("subtree_size IS NOT NULL").select("id", "subtree_size").orderBy(F.desc("subtree_size"), "id").offset(place).limit(PAGE_SIZE))
    ids = [r[0] for r in listed.select("id").collect()]
    found = objects.where(F.col("id").isin(ids)).join(F.broadcast(listed), "id")
    return found.select(*SUMMARY).orderBy(F.desc("subtree_size"), "id")


def references_of(objects: DataFrame, refs: DataFrame, ids: list[int]) -> DataFrame:
    """(src, pos, then the summary of the target): out-links in order, repeated ones included."""
    return _linked(objects, cut(refs.where(F.col("src").isin(ids))))


def _linked(objects: DataFrame, links: DataFrame) -> DataFrame:
    return links.join(_named(objects, links, "dst"), F.col("dst") == F.col("id")).select("src", "pos", *SUMMARY)


def _named(objects: DataFrame, links: DataFrame, end: str) -> DataFrame:
    """Summaries of objects, among them all that kept links name; of few names only those, so that the filter reaches the tables before anything is grouped or shuffled."""
    names = [r[0] for r in links.where(F.col(end).isNotNull()).select(end).distinct().limit(FEW + 1).collect()]
    found = objects.select(*SUMMARY)
    return found.where(F.col("id").isin(names)) if len(names) <= FEW else found


def referrers_of(objects: DataFrame, refs: DataFrame, ids: list[int]) -> DataFrame:
    """(dst, then the summary of the source): each object that refers to it, once.  ``refs`` may be stored by target."""
    links = cut(refs.where(F.col("dst").isin(ids)).select("dst", "src").distinct())
    return links.join(_named(objects, links, "src"), F.col("src") == F.col("id")).select("dst", *SUMMARY)


def object_detail(objects: DataFrame, refs: DataFrame, id_: int, strict: bool = True, referrers: DataFrame | None = None) -> DataFrame:
    """One row: the summary, references (array in order) and referrers (array by id); no row for an unknown id.

    ``referrers``: (dst, src), the refs stored by target, which then serve the way back.

    With ``strict`` a link to an object that is missing raises LookupError; without, it is left out.
    """
    links = cut(refs.where(F.col("src") == id_))
    if strict:
        missing = links.join(_named(objects, links, "dst").select(F.col("id").alias("dst")), "dst", "left_anti").select("dst").first()
        if missing:
            raise LookupError(f"object {id_} refers to {missing['dst']}, which is not in the dump")
    summary = F.struct(*SUMMARY)
    out = _linked(objects, links).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("pos", summary.alias("o")))).alias("links"))
    back = referrers_of(objects, refs if referrers is None else referrers, [id_]).groupBy("dst").agg(F.sort_array(F.collect_list(summary)).alias("referrers"))
    one = objects.where(F.col("id") == id_).select(*SUMMARY)
    none = F.array().cast(back.schema["referrers"].dataType)
    return (
        one.join(out, F.col("src") == F.col("id"), "left")
        .join(back, F.col("dst") == one["id"], "left")
        .select(*SUMMARY, F.coalesce(F.transform("links", lambda x: x["o"]), none).alias("references"), F.coalesce("referrers", none).alias("referrers"))
    )


def dangling_references(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """Links (src, pos, dst) to objects that are missing.

    The distinct targets, fewer than the links, are looked up first; the links are shuffled only where too many of those are missing to broadcast them.
    """
    missing = sized(barred_targets(objects, refs).select(F.col("dst").alias("missing")))
    return refs.join(missing, refs["dst"].eqNullSafe(F.col("missing")), "left_semi").select("src", "pos", "dst")
