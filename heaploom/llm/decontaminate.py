"""Benchmark decontamination with a distributed positional inverted index.  DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_JAVA, content_key, cut, fresh_path, remove

WINDOW = 10
#: Vocabularies and anchor lists of at most so many rows are broadcast (each row is a term and
#: three numbers, so this is some tens of MB); larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column: Column) -> Column:
    return F.translate(column, _UPPER, _LOWER)


def raw_words(column: Column) -> Column:
    """Words of a text, not yet lower-cased; null has none."""
    return F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(WORD_JAVA), F.lit(0))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass
class PositionalIndex:
    """Postings of the vocabulary of some queries in a corpus, as Parquet in the shared folder.

    postings: row (of the corpus), term, pos.  docs: row, doc_id, n_words.  terms: word, term, places.
    """

    path: str
    terms: DataFrame
    spark: object

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(self.path).where("term > 0").select("row", "term", "pos")

    @property
    def docs(self) -> DataFrame:
        return self.spark.read.parquet(self.path).where("term = 0").select("row", "doc_id", "n_words")

    def drop(self) -> None:
        remove(self.spark, self.path)


def query_words(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id and words (lower-cased) of each query text that has words; null and empty texts have none."""
    words = F.transform(raw_words(F.col(text_col)), ascii_lower)
    return queries.select(F.col(id_col).alias("item_id"), words.alias("words")).where(F.size("words") > 0)


def build_index(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> PositionalIndex:
    """Store where the words of ``items`` (see :func:`query_words`) stand in ``docs``.

    One pass: texts are split and exploded, words that no query has are dropped by a join with
    the vocabulary, and the rest is written as (row, term, pos), which Parquet packs into a few
    bytes.  Nothing is shuffled unless the vocabulary is too large to broadcast.  Each row of the
    corpus also stores one entry with its id and number of words, under term 0, so rows without
    any query word are kept.
    """
    spark = docs.sparkSession
    # Numbers from 1 on; the table is written, so they stay as they are.
    vocabulary = cut(items.select(F.explode("words").alias("word")).distinct().select("word", (F.monotonically_increasing_id() + 1).alias("term")))
    size = vocabulary.count()
    keyed = vocabulary.select("word", "term", F.lower("word").alias("key"))
    corpus = (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), raw_words(F.col(text_col)).alias("words"))
        .select("row", "doc_id", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("at", "seen"))
        .select("row", "doc_id", "n_words", (F.col("at") - 1).alias("pos"), "seen", F.lower("seen").alias("key"))
    )
    marks = keyed.unionByName(spark.sql("SELECT '' AS word, 0L AS term, '' AS key"))
    same = (F.col("seen") == F.col("word")) | (ascii_lower(F.col("seen")) == F.col("word"))
    mark = F.col("term") == 0
    path = fresh_path(spark, "postings")
    (
        corpus.join(_sized(marks, size), "key")
        .where(same)
        .select("row", "term", "pos", F.when(mark, F.col("doc_id")).alias("doc_id"), F.when(mark, F.col("n_words")).alias("n_words"))
        .write.parquet(path)
    )
    places = spark.read.parquet(path).where("term > 0").groupBy("term").agg(F.count(F.lit(1)).alias("places"))
    return PositionalIndex(path, cut(vocabulary.join(places, "term", "left").na.fill({"places": 0})), spark)


def windows_of(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, window): every ``width`` consecutive words of an item; shorter items are one window."""
    last = F.greatest(F.size("words") - width, F.lit(0))
    starts = items.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("start"))
    return starts.select("item_id", F.slice("words", F.col("start") + 1, F.lit(width)).alias("window")).distinct()


def phrase_matches(index: PositionalIndex, phrases: DataFrame) -> DataFrame:
    """Exact places of phrases: (phrase, row, start).  ``phrases``: phrase (a key), window (its words).

    Terms of a phrase are ranked by how many postings they have.  The lists of the two rarest,
    each shifted by its offset in the phrase, are intersected; only where both agree are the
    other terms looked up, each at the one place where it would have to stand.
    """
    terms = phrases.select("phrase", F.posexplode("window").alias("offset", "word")).join(index.terms, "word", "left")
    rank = F.row_number().over(Window.partitionBy("phrase").orderBy("places", "offset"))
    whole = F.min(F.coalesce("places", F.lit(0))).over(Window.partitionBy("phrase"))
    ranked = cut(terms.select("phrase", "offset", "term", whole.alias("least"), rank.alias("rank")).where("least > 0").drop("least"))
    sizes = ranked.groupBy("phrase").agg(F.max("rank").alias("length"))
    n_phrases = sizes.count()

    def shifted(number: int) -> DataFrame:
        some = ranked.where(F.col("rank") == number).select("phrase", "offset", "term")
        found = index.postings.join(_sized(some, n_phrases), "term")
        return found.select("phrase", "row", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")

    first = shifted(1).join(_sized(sizes, n_phrases), "phrase")
    both = first.where("length > 1").join(shifted(2), ["phrase", "row", "start"])
    near = cut(both.unionByName(first.where("length = 1")))

    rest = near.where("length > 2").join(_sized(ranked.where("rank > 2"), n_phrases * 8), "phrase")
    needed = rest.select("phrase", "row", "start", "length", "term", (F.col("start") + F.col("offset")).alias("pos"))
    rows = near.where("length > 2").select("row").distinct()
    held = index.postings.join(_sized(rows, rows.count()), "row", "left_semi")
    full = (
        needed.join(held, ["row", "term", "pos"])
        .groupBy("phrase", "row", "start", "length")
        .agg(F.count(F.lit(1)).alias("found"))
        .where("found = length - 2")
        .select("phrase", "row", "start", "length")
    )
    return near.where("length <= 2").select("phrase", "row", "start", "length").unionByName(full)


def proximity_matches(index: PositionalIndex, groups: DataFrame, within: int) -> DataFrame:
    """Places where all words of a group stand near its rarest one: (phrase, row, pos).

    ``groups``: phrase (a key), window (its words).  pos is a place of the rarest word such that
    each other distinct word stands at most ``within`` words away from it.
    """
    terms = groups.select("phrase", F.explode("window").alias("word")).distinct().join(index.terms, "word", "left")
    rank = F.row_number().over(Window.partitionBy("phrase").orderBy("places", "term"))
    least = F.min(F.coalesce("places", F.lit(0))).over(Window.partitionBy("phrase"))
    ranked = cut(terms.select("phrase", "term", rank.alias("rank"), least.alias("least"), F.count(F.lit(1)).over(Window.partitionBy("phrase")).alias("length")).where("least > 0"))
    n = ranked.count()
    anchors = index.postings.join(_sized(ranked.where("rank = 1").select("phrase", "term", "length"), n), "term").select("phrase", "row", "pos", "length")
    wanted = anchors.where("length > 1").join(_sized(ranked.where("rank > 1").select("phrase", "term"), n), "phrase")
    # Blocks of `within` places turn the range into equality on three neighbouring blocks.
    wide = max(1, within)
    wanted = wanted.withColumn("block", F.explode(F.array(*[F.floor(F.col("pos") / wide) + k for k in (-1, 0, 1)])))
    held = index.postings.select("row", "term", F.col("pos").alias("other"), F.floor(F.col("pos") / wide).alias("block"))
    met = wanted.join(held, ["row", "term", "block"]).where(F.abs(F.col("pos") - F.col("other")) <= within)
    all_met = (
        met.groupBy("phrase", "row", "pos", "length").agg(F.countDistinct("term").alias("found")).where("found = length - 1").select("phrase", "row", "pos")
    )
    return anchors.where("length = 1").select("phrase", "row", "pos").unionByName(all_met)


def contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """How much of each document stands in benchmark items.

    Words, windows and hits: a document word inside any occurrence of a window of ``width``
    consecutive words of an item (of the whole item, if it is shorter) is hit.  Returns row (a
    number of the input row), doc_id, n_words, n_hit and items: the ids, as sorted strings, of items
    with an occurring window.

    Null and empty texts have no words.  Repeated documents are each measured; repeated items
    and windows count once; items without words or id name no item (windows of items without an
    id still hit).  Empty tables: no rows, or no hits.  Other columns are ignored.
    """
    items = cut(query_words(benchmark, item_col, item_text))
    index = build_index(docs, items, id_col=id_col, text_col=text_col)
    of_items = cut(windows_of(items, width))
    phrases = cut(of_items.select("window").distinct().select("window", F.monotonically_increasing_id().alias("phrase")))
    hits = cut(phrase_matches(index, phrases))

    words = hits.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    n_hit = words.groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    names = of_items.where("item_id IS NOT NULL").join(phrases, "window").select("phrase", "item_id")
    found = hits.select("row", "phrase").distinct().join(names, "phrase").select("row", F.col("item_id").cast("string").alias("item"))
    n_items = found.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = (
        index.docs.join(n_hit, "row", "left")
        .join(n_items, "row", "left")
        .select(
            "row", "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
        )
    )
    out = cut(out)
    index.drop()
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, without a word in a benchmark window.

    Null and empty texts stay.  Of repeated texts all stay or none.  Empty tables: no rows, or all of ``docs``.
    """
    # All columns travel as one struct, so no name of theirs meets one of the operator's.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    text = F.col("document").getField(text_col)
    keyed = packed.select("document", content_key(text).alias("content"))
    # Decisions follow the text, so they come back by its content: a second reading may deal rows differently.
    found = contamination(packed.select(content_key(text).alias("content"), text.alias("text")), benchmark, id_col="content", **options)
    hit = cut(found.where("n_hit > 0").select(F.col("doc_id").alias("content")).distinct())
    return keyed.join(_sized(hit, hit.count()), "content", "left_anti").select("document.*")
