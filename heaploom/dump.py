"""One dump: its tables and the questions one asks of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rules import is_skip
from .functions.sketch import register_sketch_functions
from .operators import graph, listing, paths, rollup, sizes
from .operators.dag import GraphIndex
from .plans.storage import cut
from .schema import ALL_TYPES, Precision


class HeapDump:
    """objects (id, type, value, size, subtree_size, is_skip) and refs (src, pos, dst) of one dump."""

    def __init__(self, objects: DataFrame, refs: DataFrame, index: GraphIndex | None = None, referrers: DataFrame | None = None):
        """``referrers``: (dst, src), the refs once each, if they are stored by target."""
        self.objects, self.refs, self._index, self.referrers = objects, refs, index, referrers
        self.spark: SparkSession = objects.sparkSession

    @classmethod
    def from_records(cls, records: DataFrame, precision: Precision | str = Precision.MEDIUM, trust_input_sizes: bool = False, max_pairs: int | None = sizes.MAX_PAIRS, index_path: str | None = None, kept: bool = False) -> HeapDump:
        """Derive the tables from raw records.  Sizes in the input are ignored unless trusted (and precision is none).

        ``max_pairs`` bounds the chunks of reachable sets that exact sizes may take (None: no bound).  The condensed graph, which sizes need, is kept in
        ``index_path`` (None: the shared folder) for later questions.  ``kept``: the records are a stored table, and are not stored again.
        """
        precision = Precision.parse(precision)
        records = records if kept else cut(records)
        refs = records.select(F.col("id").alias("src"), F.posexplode("references").alias("pos", "dst"))
        objects = records.select("id", "type", "value", "size", is_skip(F.col("type"), F.col("value")).alias("is_skip"), F.col("subtree_size").alias("given"))
        if precision is Precision.NONE:
            size = F.col("given") if trust_input_sizes else F.lit(None).cast("long")
            return cls(objects.select("id", "type", "value", "size", size.alias("subtree_size"), "is_skip"), refs)
        edges = cut(graph.usable_refs(objects, refs))
        index = GraphIndex.build(objects, edges, index_path)
        found = sizes.subtree_sizes(objects, edges, precision, max_pairs=max_pairs, index=index)
        return cls(objects.join(found, "id", "left").select("id", "type", "value", "size", "subtree_size", "is_skip"), refs, index)

    def register_views(self, prefix: str = "") -> None:
        """objects, refs and type_summaries as temporary views, and the functions of sketches, for any SQL."""
        register_sketch_functions(self.spark)
        self.objects.createOrReplaceTempView(f"{prefix}objects")
        self.refs.createOrReplaceTempView(f"{prefix}refs")
        self.type_summaries().createOrReplaceTempView(f"{prefix}type_summaries")

    def type_summaries(self, sort_by: str | None = None) -> DataFrame:
        return rollup.type_summaries(self.objects, sort_by)

    def count(self, type_: str = ALL_TYPES) -> int:
        return rollup.type_count(self.objects, type_).first()["count"]

    def page_count(self, type_: str = ALL_TYPES) -> int:
        return rollup.type_count(self.objects, type_).first()["pages"]

    def objects_of_type(self, type_: str = ALL_TYPES, sort: str = "id", page: int | None = None, first_page: int = 0) -> DataFrame:
        return listing.objects_of_type(self.objects, type_, sort, page, first_page)

    def object(self, id_: int, strict: bool = True) -> DataFrame:
        return listing.object_detail(self.objects, self.refs, id_, strict, self.referrers)

    def index(self) -> GraphIndex:
        """The condensed graph, made by the first question that needs it."""
        if self._index is None:
            self._index = GraphIndex.build(self.objects, cut(self.usable_refs()))
        return self._index

    def usable_refs(self) -> DataFrame:
        return graph.usable_refs(self.objects, self.refs)

    def dangling_references(self) -> DataFrame:
        return listing.dangling_references(self.objects, self.refs)

    def find_path(self, start: int, end: int, avoiding: Iterable[int] = ()) -> DataFrame:
        return paths.find_path(self.objects, self.refs, start, end, avoiding)

    def find_paths(self, requests: DataFrame, avoiding: DataFrame | None = None, prune: bool = True) -> DataFrame:
        return paths.find_paths(self.objects, self.refs, requests, avoiding, prune)

    def find_paths_exact(self, requests: DataFrame, avoiding: DataFrame | None = None) -> DataFrame:
        """The same, pruned by exact sizes, which are worked out for what the starts reach alone."""
        return paths.find_paths_exact(self.objects, self.refs, requests, avoiding)

    def largest_common_reachable(self, first: int, second: int) -> DataFrame:
        return paths.largest_common_reachable(self.objects, self.refs, first, second, self._sized_index(first, second))

    def largest_common_exact(self, first: int, second: int) -> DataFrame:
        """The same by exact sizes, which are worked out for what both reach alone."""
        return paths.largest_common_exact(self.objects, self.refs, first, second)

    def common_report(self, first: int, second: int) -> DataFrame:
        return paths.common_report(self.objects, self.refs, first, second, self._sized_index(first, second))

    def common_report_exact(self, first: int, second: int) -> DataFrame:
        """The same by exact sizes, which are worked out for what either reaches alone."""
        return paths.common_report_exact(self.objects, self.refs, first, second)

    def _sized_index(self, *ids: int) -> GraphIndex | None:
        """The index, unless the question will fail for want of sizes."""
        if self._index is None and self.objects.where(F.col("id").isin(list(ids)) & F.col("subtree_size").isNull()).count():
            return None
        return self.index()
