"""Repeated passages: lines met by MinHash bands and verified by Jaccard similarity, and equal windows of words anywhere in a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, cut, lean, small_batches
from .components import connected_components
from .near_dup import OUT_ROWS, SIMILARITY, K, _powers, byte_words, kmers, link_buckets, mix

#: Paragraphs of fewer words (headings, licence lines, bylines) are no passages.
MIN_WORDS = 20
#: Hashes of a signature and the share of pairs at the threshold that the bands must catch.
HASHES, RECALL = 64, 0.998
#: Of so many windows of MIN_WORDS words in a row the one of least hash counts, so two texts that share a
#: run of MIN_WORDS + STEP - 1 words (30) anywhere share a window.
STEP = 11
#: Words that are worked on at once.
BLOCK_WORDS = 50_000
_LINE = re.compile(r"[^\r\n\u2028\u2029]+")
_BREAKS = str.maketrans("\u2028\u2029", "\n\n")


def tune_bands(least: float = SIMILARITY, hashes: int = HASHES, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): the longest rows, hence the fewest chance meetings, that reach the recall, and no more bands than it takes."""
    for rows in range(hashes, 0, -1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - least**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("no banding of so few hashes reaches this recall")


def placed_words(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text hashes, starts and ends (code points) of all words; none crosses the end of a line."""
    raw = [(t.translate(_BREAKS) if "\u2028" in t or "\u2029" in t else t).encode() for t in texts]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    h, first, end = byte_words(data)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    start = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    cuts = np.searchsorted(first, start)
    first, end, start = points[first], points[end], points[np.minimum(start, len(data))]
    return [(h[i:j], first[i:j] - at, end[i:j] - at) for i, j, at in zip(cuts[:-1].tolist(), cuts[1:].tolist(), start.tolist(), strict=False)]


def window_hashes(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of every ``words`` consecutive words, from differences of prefix sums."""
    power, back = _powers(len(h))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h) * power[: len(h)])])
    return mix((sums[words:] - sums[:-words]) * back[: len(h) - words + 1])


def windows(h: np.ndarray, words: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the windows of ``words`` words that are least among ``step`` windows in a row."""
    if len(h) < words:
        return h[:0], np.zeros(0, np.int64)
    s = window_hashes(h, words)
    view = np.lib.stride_tricks.sliding_window_view(s, min(step, len(s)))
    at = np.unique(view.argmin(1) + np.arange(len(view)))
    return s[at], at


def describe(hashes: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, ...]:
    """For paragraphs given as word hashes: two content keys, the band values, and the different 5-mers with their number.

    All paragraphs of a block are worked on as one array, with minima and sums taken between their borders.
    """
    h = np.concatenate(hashes)
    length = np.array([len(x) for x in hashes])
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    place = (np.arange(len(h)) - np.repeat(start, length) + 1).astype(np.uint64)
    keys = [np.add.reduceat(mix(h * np.uint64(c) + place), start).view(np.int64) for c in (3, 7)]

    s = kmers(h)
    owner = np.repeat(np.arange(len(hashes)), length)[: len(s)]
    inside = np.arange(len(s)) + K <= (start + length)[owner]
    s, owner = s[inside], owner[inside]
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])])
    s, owner = s[new], owner[new]
    first = np.searchsorted(owner, np.arange(len(hashes)))

    value = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(hashes), 1))
    for band in range(bands):
        for row in range(rows):
            t = band * rows + row
            ranked = (s ^ np.uint64((t + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64((2 * t + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1 | 1)
            value[:, band] = mix(value[:, band] * np.uint64(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(ranked, first))
    size = np.diff(np.concatenate([first, [len(s)]]))
    return *keys, value.view(np.int64), s, size


def jaccard(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Jaccard similarity of two sets of numbers of at least ``least``."""
    both = len(np.intersect1d(a, b))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def repeated_passages(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, min_words: int = MIN_WORDS, step: int = STEP, hashes: int = HASHES, recall: float = RECALL
) -> DataFrame:
    """Passages of at least ``min_words`` words that stand, alike to ``least`` or more, in several documents.

    Lines.  Those of equal words become one class.  Classes get MinHash signatures of
    their word 5-mers, in bands tuned to catch ``recall`` of the pairs at the threshold; what meets in a
    band is verified by the Jaccard similarity of the sets of 5-mers (told apart by 32 bits of their hash), and clusters are the
    components (see :func:`near_dup.link_buckets` for buckets of any size).  In each cluster the first line
    (least doc_id, then place) stays and the others are removals.

    Anywhere else.  Lines say nothing about a passage inside a longer line, or one that is wrapped differently.  So
    windows of ``min_words`` words (see :func:`windows`) are compared over whole texts, whatever their lines, by
    64-bit hashes: every run of ``min_words`` + ``step`` - 1 words that stands in two documents has one in common.
    Windows that overlap make a span, so its ends lie at most ``step`` - 1 words inside the run.  Of each window one occurrence
    stays (in lines that stay if there is one, else the first outside of removed lines); spans are cut where occurrences that
    stay meet others, so all words of a removed span also stand elsewhere.  Spans with fewer than ``min_words`` words
    outside of repeated lines are not listed.  Spans and lines that share windows are one cluster.

    Returns doc_id, paragraph (number of the line, or of the line in which a span starts), start and end (code
    points), n_words, cluster_id (a number), n_docs (documents with a paragraph of the cluster) and removed.
    Clusters within one document only are left out.

    Null and empty texts have no paragraphs.  Repeated rows are different documents.  Null ids come last
    in their cluster.  Empty table: no rows.  Other columns are ignored.
    """
    if min_words < K:
        raise ValueError(f"passages have at least {K} words, as they are compared by {K}-mers")
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bands, width = tune_bands(least, hashes, recall)
    lists = {"sketches": pa.int64(), "hashes": pa.int64(), "ats": pa.int32(), "starts": pa.int32(), "ends": pa.int32(), "lines": pa.int32()}
    kinds = {"paragraph": pa.int32(), "first_word": pa.int32(), "start": pa.int32(), "end": pa.int32(), "n_words": pa.int32(), "c1": pa.int64(), "c2": pa.int64(), "sequence": pa.binary()}
    kinds |= {name: pa.list_(kind) for name, kind in lists.items()}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per line, and one without a line number per text, which holds its windows."""
        def block(batch: pa.RecordBatch, at: list[int], **given) -> pa.RecordBatch:
            of = pa.array(at, pa.int64())
            columns = [pa.array(given[name], kind) if name in given else pa.nulls(len(at), kind) for name, kind in kinds.items()]
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in ("row", "doc_id")), *columns], names=["row", "doc_id", *kinds])

        for batch in (whole.slice(lo, OUT_ROWS) for whole in batches for lo in range(0, whole.num_rows, OUT_ROWS)):
            at, places, hashes, held, texts, found = [], [], [], 0, [], []
            every = batch.column("text").to_pylist()
            for k, (text, (h, starts, ends)) in enumerate(zip(every, placed_words(every), strict=True)):
                lines = np.array([m.span() for m in _LINE.finditer(text)], np.int64).reshape(-1, 2)
                lo, hi = np.searchsorted(starts, lines[:, 0]), np.searchsorted(starts, lines[:, 1])
                for number in np.flatnonzero(hi - lo >= min_words).tolist():
                    at.append(k)
                    places.append((number, int(lo[number]), *lines[number].tolist()))
                    hashes.append(h[lo[number] : hi[number]])
                value, first = windows(h, min_words, step)
                if len(value):
                    texts.append(k)
                    found.append((value.view(np.int64), first, starts[first], ends[first + min_words - 1], np.searchsorted(lines[:, 0], starts[first], "right") - 1))
                held += len(h)
                if held >= BLOCK_WORDS or k + 1 == batch.num_rows:
                    if hashes:
                        c1, c2, sketches, s, size = describe(hashes, bands, width)
                        number, first, start, end = (list(c) for c in zip(*places, strict=True))
                        given = {"paragraph": number, "first_word": first, "start": start, "end": end, "n_words": [len(h) for h in hashes], "c1": c1, "c2": c2}
                        given["sketches"] = pa.ListArray.from_arrays(np.arange(0, sketches.size + 1, bands, dtype=np.int32), sketches.ravel())
                        given["sequence"] = [x.astype(np.uint32).tobytes() for x in np.split(s, np.cumsum(size)[:-1])]
                        yield block(batch, at, **given)
                    if texts:
                        offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
                        columns = (np.concatenate(c) for c in zip(*found, strict=True))
                        names = ("hashes", "ats", "starts", "ends", "lines")
                        yield block(batch, texts, **{n: pa.ListArray.from_arrays(offsets, pa.array(c, lists[n])) for n, c in zip(names, columns, strict=True)})
                    at, places, hashes, held, texts, found = [], [], [], 0, [], []

    schema = "paragraph int, first_word int, start int, end int, n_words int, c1 long, c2 long, sequence binary, sketches array<long>"
    schema += ", hashes array<long>, ats array<int>, starts array<int>, ends array<int>, lines array<int>"
    with Workspace(spark, "passages") as work:
        # Numbers of kept rows: they stay the same however often the table is read.
        everything = work.keep(rows.mapInArrow(lean(split), f"row long, doc_id {id_type}, {schema}").withColumn("number", F.monotonically_increasing_id()))
        found = everything.where("paragraph IS NOT NULL")
        copies = work.keep(found.groupBy("c1", "c2").agg(F.min("number").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
        named = work.keep(found.select("number", "c1", "c2").join(copies, ["c1", "c2"]).select("number", "node"))
        later = work.sized(named.where("number <> node").select("number"))
        classes = found.select(F.col("number").alias("node"), "sketches").join(later.withColumnRenamed("number", "node"), "node", "left_anti")
        component = link_buckets(work, classes, found.select(F.col("number").alias("node"), "sequence"), least=least, test=lambda a, b: jaccard(a, b, least))
        # Lines without a copy or a link stand in one document.
        lines = named.join(component, "node", "left").select("number", F.coalesce("component", "node").alias("cluster_id"))
        lines = lines.unionByName(component.join(copies.select("node"), "node", "left_anti").select(F.col("node").alias("number"), F.col("component").alias("cluster_id")))
        place = ("number", "row", "doc_id", "paragraph", "first_word", "start", "end", "n_words")
        placed = work.keep(found.select(*place).join(work.sized(lines), "number"))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "paragraph")
        clusters = placed.groupBy("cluster_id").agg(F.min(order).alias("first"), F.min("row").alias("one"), F.max("row").alias("other")).where("one < other")
        repeated = placed.join(work.sized(clusters.select("cluster_id", F.col("first.row").alias("first_row"), F.col("first.paragraph").alias("first_line"))), "cluster_id")
        keep = (F.col("row") == F.col("first_row")) & (F.col("paragraph") == F.col("first_line"))
        repeated = work.keep(repeated.select("row", "doc_id", "paragraph", "first_word", "start", "end", "n_words", "cluster_id", (~keep).alias("removed")))
        return cut(_with_spans(work, everything.where("paragraph IS NULL").select("row", "doc_id", "hashes", "ats", "starts", "ends", "lines"), repeated, min_words))


def lines_of_windows(ats: np.ndarray, words: int, first: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows of ``words`` words the indexes of the first and last line (of ordered, disjoint ones) of those that hold all its words, or -1."""
    if not len(first):
        return np.full(len(ats), -1), np.full(len(ats), -1)
    before = np.concatenate([[0], np.cumsum(n_words)[:-1]])

    def covered(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The line that begins at or before a place, and the words before it that lie in lines."""
        line = np.searchsorted(first, place, "right") - 1
        return line, np.where(line < 0, 0, before[line] + np.minimum(place - first[line], n_words[line]))

    (one, low), (_, high) = covered(ats), covered(ats + words)
    last = np.searchsorted(first, ats + words - 1, "right") - 1
    inside = high - low == words
    return np.where(inside, one, -1), np.where(inside, last, -1)


def _with_spans(work: Workspace, texts: DataFrame, lines: DataFrame, words: int) -> DataFrame:
    """The repeated ``lines``, and the spans of windows that several ``texts`` hold, in common clusters."""
    of_row = lines.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words", "cluster_id", "removed"))).alias("within"))
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds to each window all of whose words stand in repeated lines the cluster of the first (else null), and whether any of them goes."""
        for batch in batches:
            clusters, removed = [], []
            for ats, within in zip(batch.column("ats"), batch.column("within"), strict=True):
                some = within.values if within.is_valid else pa.array([], batch.schema.field("within").type.value_type)
                first, size, cluster, goes = (some.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                line, last = lines_of_windows(ats.values.to_numpy(), words, first, size)
                outside = line < 0
                gone = np.concatenate([[0], np.cumsum(goes.astype(bool))])
                clusters.append(pa.array(np.append(cluster, 0)[line], pa.int64(), mask=outside))
                removed.append(pa.array(gone[last + 1] > gone[np.maximum(line, 0)], pa.bool_(), mask=outside))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in clusters])]).astype(np.int32))
            flat = lambda parts, kind: pa.ListArray.from_arrays(offsets, pa.concat_arrays(parts) if parts else pa.array([], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], flat(clusters, pa.int64()), flat(removed, pa.bool_())], names=[*batch.schema.names[:-1], "clusters", "goes"])

    names = ("hashes", "ats", "starts", "ends", "lines")
    schema = f"row long, doc_id {id_type}, hashes array<long>, ats array<int>, starts array<int>, ends array<int>, lines array<int>"
    placed = texts.select("row", "doc_id", *names).join(of_row, "row", "left").mapInArrow(lean(place), f"{schema}, clusters array<long>, goes array<boolean>")
    placed = work.keep(placed)
    # Windows that several documents hold, one of them with words outside of repeated lines.
    each = placed.select("row", F.explode(F.arrays_zip("hashes", "clusters")).alias("w")).select("row", F.col("w.hashes").alias("hash"), F.col("w.clusters").isNull().cast("int").alias("outside"))
    shared = each.groupBy("hash").agg(F.min("row").alias("one"), F.max("row").alias("other"), F.max("outside").alias("outside")).where("one < other AND outside = 1").select("hash")
    every = placed.select("row", "doc_id", F.explode(F.arrays_zip(*names, "clusters", "goes")).alias("w"))
    met = every.select("row", "doc_id", F.col("w.hashes").alias("hash"), F.col("w.ats").alias("at"), F.col("w.starts").alias("start"), F.col("w.ends").alias("end"), F.col("w.lines").alias("line"), F.col("w.clusters").alias("cluster_id"), F.col("w.goes").alias("goes"))
    met = work.keep(met.join(work.sized(shared), "hash"))
    # Occurrences in lines that stay come first, those in removed lines last.
    rank = F.when(F.col("cluster_id").isNull(), 1).when(F.col("goes"), 2).otherwise(0)
    stays = met.groupBy("hash").agg(F.min(F.struct(rank.alias("rank"), F.col("doc_id").isNull().alias("none"), "doc_id", "row", "at")).alias("s"))
    stays = work.sized(stays.select("hash", F.col("s.row").alias("row_s"), F.col("s.at").alias("at_s")))
    outside = met.where("cluster_id IS NULL").join(stays, "hash").withColumn("removed", (F.col("row") != F.col("row_s")) | (F.col("at") != F.col("at_s")))
    order = Window.partitionBy("row").orderBy("at")
    fresh = (F.col("at") >= F.lag("at").over(order) + words) | (F.col("removed") != F.lag("removed").over(order))
    outside = outside.select("hash", "row", "doc_id", "at", "start", "end", "line", "removed", F.coalesce(fresh, F.lit(True)).cast("int").alias("fresh"))
    outside = work.keep(outside.withColumn("span", F.sum("fresh").over(order)))
    spans = outside.groupBy("row", "span").agg(
        F.first("doc_id").alias("doc_id"), F.min("line").alias("paragraph"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.min("at").alias("at"), (F.max("at") - F.min("at") + words).alias("n_words"), F.first("removed").alias("removed"),
    )
    common = F.transform("within", lambda x: F.greatest(F.lit(0), F.least(F.col("at") + F.col("n_words"), x["first_word"] + x["n_words"]) - F.greatest(F.col("at"), x["first_word"])))
    alone = F.col("n_words") - F.coalesce(F.aggregate(common, F.lit(0), lambda a, b: a + b), F.lit(0))
    spans = spans.join(of_row, "row", "left").withColumn("listed", alone >= words).drop("within", "at")
    # Numbers below zero: those of lines lie above.
    spans = work.keep(spans.withColumn("node", -1 - F.monotonically_increasing_id()))
    # Each window ties all its spans and lines to the least of them.
    held = outside.select("hash", "row", "span").join(spans.select("row", "span", "node"), ["row", "span"]).select("hash", "node")
    held = work.keep(held.unionByName(met.where("cluster_id IS NOT NULL").select("hash", F.col("cluster_id").alias("node"))).distinct())
    heads = held.groupBy("hash").agg(F.min("node").alias("a"))
    component = work.sized(connected_components(held.join(heads, "hash").select("a", F.col("node").alias("b"))))
    names = ("row", "doc_id", "paragraph", "start", "end", "n_words", "removed", "listed", "node")
    both = lines.withColumn("listed", F.lit(True)).withColumnRenamed("cluster_id", "node").select(*names).unionByName(spans.select(*names))
    both = work.keep(both.join(component, "node", "left").withColumn("cluster_id", F.coalesce("component", "node")).drop("component", "node"))
    several = both.groupBy("cluster_id").agg(F.countDistinct("row").alias("n_docs")).where("n_docs > 1")
    longs = [F.col(c).cast("long").alias(c) for c in ("start", "end", "n_words")]
    return both.where("listed").join(work.sized(several), "cluster_id").select("doc_id", "paragraph", *longs, "cluster_id", "n_docs", "removed")
