"""Ranked lexical search: TPUT (three-phase uniform threshold) over postings that are partitioned by term."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, batch_rows, cut, hinted, lean

#: Results per query.
TOP = 50
#: Queries are answered together as long as they have so many terms in all; more of them are answered in several rounds.
#: It bounds what the driver and every task hold of the queries, and has no effect on results.
QUERY_TERMS = 500_000
#: Documents whose postings are inverted at once, and postings of a list that are stored under one key.
BLOCK_DOCS, LIST_SHARD = 8192, 1_000_000
#: Impacts lie below 10**6; a block holds those that agree in all but the lowest bits.
LEVEL_BITS = 16
#: Bytes to what terms are made of: A-Z lower-cased, other ASCII that is neither letter nor digit to a blank.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8; null has none."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def norm(n: np.ndarray, rows: int, length: int) -> np.ndarray:
    """m = 100 - 50 + (50 n N) div L of documents of n terms: exact, also where the product passes 64 bits."""
    if len(n) and int(n.max()) * 50 * rows >= 1 << 63:
        return np.array([50 + 50 * int(x) * rows // length for x in n.tolist()], np.int64)
    return 50 + 50 * n.astype(np.int64) * rows // max(1, length)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score, before its weight."""
    return 1_000_000_000 * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 20 * m)


def weight(rows: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * rows + 2) / (2 * df + 1)))


def _forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): how many terms each document has, and which ones of the vocabulary (numbers, ascending) how often."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = known.value
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                found = sorted((numbers[w], c) for w, c in Counter(words).items() if w in numbers)
                n.append(len(words))
                pair = np.array(found, np.int32).reshape(-1, 2)
                terms.append(pair[:, 0].tobytes())
                tfs.append(pair[:, 1].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(lean(count), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, terms binary, tfs binary")


def _document_counts(forward: DataFrame, size: int) -> np.ndarray:
    """df of each term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["term", "df"])

    found = forward.select("terms").mapInArrow(lean(count), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return df


def _postings(forward: DataFrame, rows: int, length: int, df: np.ndarray) -> DataFrame:
    """Blocks of the inverted lists: term, shard, docs, level, top, low, n, and places and impacts, the largest impacts first.

    A block holds postings of one term in BLOCK_DOCS consecutive documents (row = docs * BLOCK_DOCS + place) whose impacts agree in their upper bits, so
    lists are read from their heads down to a threshold without looking at what lies below it.
    """
    shards = np.maximum(1, -(-df // LIST_SHARD))

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            row, n, terms, tfs = zip(*held, strict=True)
            terms, tfs = [np.frombuffer(x, np.int32) for x in terms], [np.frombuffer(x, np.int32) for x in tfs]
            sizes = [len(x) for x in terms]
            term, tf, place = np.concatenate(terms), np.concatenate(tfs), np.repeat(np.array(row, np.int64) % BLOCK_DOCS, sizes).astype(np.uint16)
            impact = impacts(tf, np.repeat(norm(np.array(n, np.int64), rows, length), sizes))
            order = np.lexsort((-impact, term))
            term, place, impact = term[order], place[order], impact[order]
            level = impact >> LEVEL_BITS
            first = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(level) != 0)])) if len(term) else np.zeros(0, int)
            end = np.append(first[1:], len(term))
            docs = np.full(len(first), row[0] // BLOCK_DOCS)
            columns = [term[first], (docs * 0x9E3779B1 >> 7) % shards[term[first]], docs, level[first], impact[first], impact[end - 1] if len(first) else first, end[: len(first)] - first]
            spans = list(zip(first.tolist(), end.tolist(), strict=False))
            lists = [[place[a:b].tobytes() for a, b in spans], [impact[a:b].astype(np.int32).tobytes() for a, b in spans]]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns] + [pa.array(c, pa.binary()) for c in lists], names=names)

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("row", "n", "terms", "tfs")), strict=True):
                if held and held[0][0] // BLOCK_DOCS != x[0] // BLOCK_DOCS:
                    yield block()
                    held = []
                held.append(x)
        if held:
            yield block()

    names = ["term", "shard", "docs", "level", "top", "low", "n", "places", "impacts"]
    schema = ", ".join(f"{c} long" for c in names[:7]) + ", places binary, impacts binary"
    blocks = forward.select("row", "n", "terms", "tfs").mapInArrow(lean(invert), schema)
    return blocks.repartition("term", "shard").sortWithinPartitions("term", F.desc("top"))


def _heads(postings: DataFrame, k: int) -> DataFrame:
    """(term, row, impact): the k largest impacts of each list."""
    per_level = postings.groupBy("term", "level").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(Window.partitionBy("term").orderBy(F.desc("level"))) - F.col("n")
    needed = hinted(cut(per_level.withColumn("above", above).where(F.col("above") < k).select("term", "level")))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, np.uint16)[:k].astype(np.int64) + d * BLOCK_DOCS for d, x in zip(batch.column("docs").to_pylist(), batch.column("places").to_pylist(), strict=True)]
            some = [np.frombuffer(x, np.int32)[:k].astype(np.int64) for x in batch.column("impacts").to_pylist()]
            term = np.repeat(batch.column("term").to_numpy(), [len(x) for x in rows])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (term, *(np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, some)))], names=["term", "row", "impact"])

    unpacked = postings.join(needed, ["term", "level"]).select("term", "docs", "places", "impacts").mapInArrow(lean(first), "term long, row long, impact long")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "row"))
    return unpacked.withColumn("place", place).where(F.col("place") <= k).select("term", "row", "impact")


def _kth(sums: DataFrame, k: int, items: int) -> np.ndarray:
    """The k-th largest sum of each item, 0 where there are fewer."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("sum")))
    found = sums.select("item", "sum").withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select("item", "sum").toArrow()
    out = np.zeros(items, np.int64)
    out[found.column("item").to_numpy()] = found.column("sum").to_numpy()
    return out


def uniform_threshold(heads: np.ndarray, bound: int) -> int:
    """The largest T such that values below T in every list add up to less than ``bound``; heads: the largest value of each list.

    A list whose head lies below T adds no more than its head, so T is the bound divided by the number of lists, or more.
    """
    left, lists = bound, len(heads)
    for head in np.sort(heads).tolist():
        # All of the lists left have this head or a higher one: sum of what is below T < (heads so far) + lists * T.
        if left <= lists * head:
            return max(0, -(-left // lists))
        left, lists = left - head, lists - 1
    return int(heads.max()) + 1 if len(heads) and left > 0 else 0


def _candidates(postings: DataFrame, queries: list[tuple[np.ndarray, ...]], floors: dict[int, int], bound: np.ndarray) -> DataFrame:
    """(row, items): the documents that can still reach the bound of a query, after all lists were read down to the thresholds.

    ``queries``: terms, weights, thresholds of each, and what each term can still add where its list did not show it.  The blocks of the same documents meet in one task, which adds
    up what each query has of them; each block is sent once, however many queries want it.
    """
    spark = postings.sparkSession
    known = spark.sparkContext.broadcast(queries)
    least = spark.createDataFrame(sorted(floors.items()), "term long, least long")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        docs = None

        def close() -> pa.RecordBatch:
            lists = {t: tuple(np.concatenate(c) for c in zip(*parts, strict=True)) for t, parts in held.items()}
            row, item = [], []
            for q, (terms, weights, floor, slack) in enumerate(known.value):
                total = np.full(BLOCK_DOCS, int(slack.sum()))
                seen = np.zeros(BLOCK_DOCS, bool)
                for t, w, f, u in zip(terms.tolist(), weights.tolist(), floor.tolist(), slack.tolist(), strict=True):
                    if t in lists:
                        place, impact = lists[t]
                        if f > 1:
                            over = impact >= f
                            place, impact = place[over], impact[over]
                        total[place] += w * impact - u
                        seen[place] = True
                found = np.flatnonzero(seen & (total >= bound[q]))
                row.append(found)
                item.append(np.full(len(found), q))
            row, item = np.concatenate(row), np.concatenate(item)
            order = np.argsort(row, kind="stable")
            row, item = row[order], item[order]
            each, at = np.unique(row, return_index=True)
            items = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)), pa.int32()), pa.array(item, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(each + docs * BLOCK_DOCS, pa.int64()), items], names=["row", "items"])

        for batch in batches:
            for d, t, places, some in zip(*(batch.column(c).to_pylist() for c in ("docs", "term", "places", "impacts")), strict=True):
                if held and d != docs:
                    yield close()
                    held = {}
                docs = d
                held.setdefault(t, []).append((np.frombuffer(places, np.uint16), np.frombuffer(some, np.int32).astype(np.int64)))
        if held:
            yield close()

    # As many rows as the vocabulary of one round, which is bounded.
    met = postings.join(F.broadcast(least), "term").where("top >= least").select("docs", "term", "places", "impacts")
    return met.repartition("docs").sortWithinPartitions("docs").mapInArrow(lean(add), "row long, items array<long>")


def _exact(forward: DataFrame, candidates: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], rows: int, length: int) -> DataFrame:
    """(item, doc_id, row, score) of candidates (row, items), looked up in the documents' own terms."""
    known = forward.sparkSession.sparkContext.broadcast(queries)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, item, total = [], [], []
            m = norm(batch.column("n").to_numpy(), rows, length)
            for i, (terms, tfs, items) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("terms", "tfs", "items")), strict=True)):
                term, tf = np.frombuffer(terms, np.int32), np.frombuffer(tfs, np.int32)
                impact = impacts(tf, m[i])
                for q in items:
                    wanted, w = known.value[q]
                    place = np.minimum(np.searchsorted(term, wanted), len(term) - 1)
                    total.append(int((w * impact[place])[term[place] == wanted].sum()))
                    item.append(q)
                    at.append(i)
            taken = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "row")]
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), *taken, pa.array(total, pa.int64())], names=["item", "doc_id", "row", "score"])

    met = forward.join(candidates, "row").select("row", "doc_id", "n", "terms", "tfs", "items")
    return met.mapInArrow(lean(score), f"item long, doc_id {forward.schema['doc_id'].dataType.simpleString()}, row long, score long")


def _search(work: Workspace, docs: DataFrame, queries: list[list[bytes]], k: int) -> DataFrame:
    """(item, rank, doc_id, score) for queries (lists of distinct terms) that are few enough to be held; item is their number."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for q in queries for w in q}))}
    forward = work.keep(_forward(docs, vocabulary))
    forward = work.keep(forward.where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    totals = forward.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("length")).first()
    rows, length, spark = totals["rows"], totals["length"] or 0, docs.sparkSession
    df = _document_counts(forward, len(vocabulary))
    weights = np.array([weight(rows, int(x)) if x else 0 for x in df], np.int64)
    numbers = [np.array(sorted(vocabulary[w] for w in q), np.int64) for q in queries]
    numbers = [q[weights[q] > 0] for q in numbers]
    scored = [(q, weights[q]) for q in numbers]
    postings = work.keep(_postings(forward, rows, length, df))

    # Phase 1: the documents at the heads of the lists, scored exactly, give each query a lower bound.
    of_term = spark.createDataFrame([(i, int(t)) for i, q in enumerate(numbers) for t in q], "item long, term long")
    seen = _heads(postings, k).select("term", "row").join(F.broadcast(of_term), "term").groupBy("row").agg(F.collect_set("item").alias("items"))
    bound = _kth(_exact(forward, seen, scored, rows, length).select("item", F.col("score").alias("sum")), k, len(queries))

    # Phase 2: one threshold for all lists of a query.  Whoever stays below it everywhere stays below the bound.
    ends = postings.groupBy("term").agg(F.max("top").alias("top"), F.min("low").alias("low")).toArrow()
    top, low = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    top[ends.column("term").to_numpy()], low[ends.column("term").to_numpy()] = ends.column("top").to_numpy(), ends.column("low").to_numpy()
    limited, floors = [], {}
    for i, (q, w) in enumerate(scored):
        least = np.maximum(1, -(-uniform_threshold(w * top[q], int(bound[i])) // w))
        # What a term can still add where its list did not show it.
        limited.append((q, w, least, np.where(low[q] >= least, 0, w * np.minimum(least - 1, top[q]))))
        for t, f in zip(q.tolist(), least.tolist(), strict=True):
            if f <= top[t]:
                floors[t] = min(f, floors.get(t, f))

    # Phase 3: exact scores of all who can still reach the bound.
    open_ = work.keep(_candidates(postings, limited, floors, bound))
    exact = _exact(forward, open_, scored, rows, length).where("score > 0")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, queries: DataFrame, *, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """The k documents of the highest score for each query: (item_id, rank, doc_id, score).

    Terms, weights and scores are those of a saturating term frequency over length-normalised documents, all in whole numbers:
    w = floor(1000 ln((2N + 2) / (2df + 1))), m = 50 + 50nN div L, and each term of the query adds w (10**9 tf div (1000 tf + 20 m)), once.
    Equal scores are ordered by doc_id (null ids last, then rows as they lie); scores of 0 are left out.

    1. One reading of the texts counts, for each document, the terms that any query has; N, L and df cover all documents.
    2. The inverted lists are stored by term, in blocks of falling impact; a long list is cut into shards.
    3. The documents of the k largest impacts of each list are scored; the k-th best score of a query is a lower bound of its results.
    4. All lists of a query are read down to one threshold: values below it in every list add up to less than the bound.  Documents that no list has shown are out.
       Those whose sum plus what unread parts of lists could add reaches the bound are candidates, however many.
    5. Candidates are looked up exactly.

    Queries are held by the driver and tasks, ``query_terms`` terms at once; more queries take several rounds.  Neither postings nor candidates
    are held in one place.  Null and empty texts have no terms: such queries give no rows, such documents are not counted in N.  Repeated rows, of
    queries or documents, are ranked each.  Empty tables: no rows.  Other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = cut(queries.select(F.monotonically_increasing_id().alias("at"), F.col(query_id).alias("item_id"), F.col(query_text).alias("text")).where("text IS NOT NULL"))
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    rounds = max(1, math.ceil(total / (4 * query_terms)))  # four characters a term at least, on the average, blanks included
    parts = []
    for r in range(rounds):
        some = asked.where(F.pmod(F.xxhash64("at"), F.lit(rounds)) == r)
        held = [(x["at"], sorted(set(terms_of(x["text"])))) for x in some.select("at", "text").collect()]
        held = [x for x in held if x[1]]
        if not held:
            continue
        with batch_rows(spark), Workspace(spark, "search") as work:
            found = _search(work, texts, [q for _, q in held], k)
            names = spark.createDataFrame([(i, at) for i, (at, _) in enumerate(held)], "item long, at long")
            parts.append(cut(found.join(F.broadcast(names), "item").select("at", "rank", "doc_id", "score")))
    if not parts:
        kind = docs.schema[id_col].dataType.simpleString()
        parts = [spark.createDataFrame([], f"at long, rank int, doc_id {kind}, score long")]
    return reduce(DataFrame.unionByName, parts).join(asked.select("at", "item_id"), "at").select("item_id", "rank", "doc_id", "score")
