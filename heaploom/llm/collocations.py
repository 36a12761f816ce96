"""Phrase collocations: n-grams exploded into rows, counted by language, scored exactly, without those that longer ones explain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, batch_rows, cut, lean
from .near_dup import _BYTE_VALUES, _powers, mix

#: Longest phrase, least count of a candidate, rows per language.
MAX_WORDS, LEAST, TOP = 4, 30, 2000
#: A longer candidate of at least so many hundredths of a phrase's count explains it.
EXPLAINED = 80
#: Bits of a filter for frequent n-grams (a fixed size: 16 MB).  More n-grams than it tells apart cost time, never rows.
FILTER_BITS = 27
#: Words that a task counts at once, bytes that it splits at once.
BATCH_WORDS, PIECE_BYTES = 400_000, 1 << 20
#: Parts of a language that are ranked each before the whole.
PARTS = 16
#: What a language that is null is called (fixed value).
NO_LANG = "und"
_BLANK, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Words:
    """All words of some texts: their hashes and bytes, and the number of the piece that each stands in."""

    def __init__(self, lang: str, texts: list[bytes]):
        #: Texts are joined by a line break, so no piece spans two of them.
        self.data = b"\n".join(texts)
        data = np.frombuffer(self.data, np.uint8)
        parts, lo, pieces = [], 0, 0
        while lo < len(data):
            hi = min(len(data), lo + PIECE_BYTES)
            while hi < len(data) and not (_BLANK[data[hi - 1]] or _BREAK[data[hi - 1]]):
                hi += 1
            some = data[lo:hi]
            ends_piece = _BREAK[some]
            edges = np.flatnonzero(np.diff((~(_BLANK[some] | ends_piece)).view(np.int8), prepend=0, append=0)).reshape(-1, 2)
            power, back = _powers(len(some))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[some] * power[: len(some)])])
            piece = np.cumsum(ends_piece)
            parts.append((mix((sums[edges[:, 1]] - sums[edges[:, 0]]) * back[edges[:, 0]]), edges[:, 0] + lo, edges[:, 1] + lo, pieces + piece[edges[:, 0]]))
            pieces += int(piece[-1])
            lo = hi
        kinds = (np.uint64, np.int64, np.int64, np.int64)
        self.hash, self.first, self.end, self.piece = (np.concatenate([np.zeros(0, t), *c]) for t, c in zip(kinds, zip(*parts, strict=True) if parts else [()] * 4, strict=True))
        # One filter serves all languages: a word of another one has another hash.
        seed = sum(b * 0x100000001B3**i for i, b in enumerate(lang.encode(), 1)) & (1 << 64) - 1
        self.hash = mix(self.hash + np.uint64(seed))

    def phrases(self, n: int, below: np.ndarray | None, above: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the n-grams within pieces; ``below`` marks the (n-1)-grams (by start) that may be part of one."""
        size = max(0, len(self.hash) - n + 1)
        ok = self.piece[:size] == self.piece[n - 1 :][:size]
        if below is not None:
            ok &= below[:size] & below[1:][:size]
        at = np.flatnonzero(ok)
        key = np.zeros(len(at), np.uint64)
        for j in range(n):
            key = (key ^ self.hash[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        key = mix(key + np.uint64(n))
        if above is not None:
            slot = key & np.uint64(8 * len(above) - 1)
            kept = (above[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
            at, key = at[kept], key[kept]
        return at, key


def _by_language(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[tuple[str, _Words]]:
    """The words of the texts of a task by language, some ``number`` at once."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, []).append(raw := text.encode())
            size[lang] = size.get(lang, 0) + len(raw)
            if size[lang] > 6 * number:
                yield lang, _Words(lang, held.pop(lang))
                size[lang] = 0
    for lang, texts in held.items():
        yield lang, _Words(lang, texts)


def _frequent(work: Workspace, docs: DataFrame, n: int, filters: list[Broadcast], least: int) -> Broadcast:
    """A filter of fixed size that holds every n-gram (by hash) of at least ``least`` occurrences in its language, and few others.

    Only n-grams whose parts passed the filters before are exploded: no phrase is more frequent than its parts.
    """
    number = BATCH_WORDS

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _by_language(batches, number):
            below = None
            for k in range(1, n + 1):
                at, key = words.phrases(k, below, filters[k - 1].value if k < n else None)
                below = np.zeros(len(words.hash) + 1, bool)
                below[at] = True
            keys, times = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(times)], names=["key", "n"])

    counted = docs.mapInArrow(lean(explode), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    slot = F.col("key").bitwiseAND((1 << FILTER_BITS) - 1)
    word, bit = F.shiftright(slot, 5).alias("word"), F.expr(f"shiftleft(1L, cast((key & {(1 << FILTER_BITS) - 1}) % 32 as int))").alias("bit")
    # At most 2 ** (FILTER_BITS - 5) rows, however many n-grams there are.  Kept first, so that the shuffle files go at once.
    rows = work.keep(counted.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits"))).toArrow()
    filled = np.zeros(1 << FILTER_BITS - 5, "<u4")
    filled[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return docs.sparkSession.sparkContext.broadcast(filled.view(np.uint8))


def _counts(docs: DataFrame, filters: list[Broadcast], max_words: int, least: int) -> DataFrame:
    """(lang, words, phrase, n): exact counts of all phrases of at least ``least`` occurrences; of 0 words: all words of the language."""
    number = BATCH_WORDS

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _by_language(batches, number):
            # The row of no words is the language's total.
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([len(words.hash)], pa.int64())], names=["lang", "words", "phrase", "n"])
            # With one blank between words, every phrase is a slice.
            text = words.data.translate(_LOWER)
            plain = b" ".join([text[a:b] for a, b in zip(words.first.tolist(), words.end.tolist(), strict=True)])
            end = np.cumsum(words.end - words.first + 1) - 1
            first = end - (words.end - words.first)
            below = None
            for n in range(1, max_words + 1):
                at, key = words.phrases(n, below, filters[n - 1].value if n <= len(filters) else None)
                below = np.zeros(len(words.hash) + 1, bool)
                below[at] = True
                # Combined by hash first, which is exact unless two phrases of a batch share 64 bits: those are told apart by their bytes.
                order = np.argsort(key, kind="stable")
                key, at = key[order], at[order]
                spans = [(plain[a:b]) for a, b in zip(first[at].tolist(), end[at + n - 1].tolist(), strict=True)]
                new = np.ones(len(spans), bool)
                new[1:] = [x != y for x, y in zip(spans[1:], spans, strict=False)]
                start = np.flatnonzero(new)
                times = np.diff(np.append(start, len(spans)))
                phrase = pa.array([spans[i] for i in start.tolist()], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(start), pa.string()), pa.array(np.full(len(start), n, np.int32)), phrase, pa.array(times)], names=["lang", "words", "phrase", "n"])

    rows = docs.mapInArrow(lean(explode), "lang string, words int, phrase string, n long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def collocations(
    docs: DataFrame, *, max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP, explained: int = EXPLAINED, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The best phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    A-Z are lower-cased; texts are split into pieces at . , ; : ! ? and line breaks, and those into words at blanks and tabs.  a counts a
    phrase's occurrences within pieces, n all words of the language.  Cut after its first k words, a phrase scores floor(2000000 a / (l + r)), l and r
    being the counts of both parts; its lowest-scoring cut counts (the first of several).  Candidates have 2 to ``max_words`` words and a >= ``least``; one
    whose words lie inside a longer candidate of at least ``explained`` hundredths of its count is left out.  Ranked by score and a, descending,
    then by phrase in byte order.

    1. n-grams are exploded within tasks, by hash, combined, and counted by a shuffle; those of ``least`` occurrences set bits in a filter of fixed
       size.  Longer ones are exploded only where both their parts pass, as no phrase is more frequent than its parts.  Filters cover n = 1 and 2.
    2. All 1- to ``max_words``-grams that pass are exploded as text and counted exactly; what the filters let through by chance falls here.
    3. Parts are joined by equality, scores are decimals of 38 digits, and one-word extensions are an anti join: whatever a still longer phrase explains, the
       extension in between explains, too.

    Null texts count as empty; a null language is ``und``.  Repeated rows count each.  Empty table: no rows.  Other columns are ignored.
    """
    plain = docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text")).where("text IS NOT NULL AND text <> ''")
    with batch_rows(docs.sparkSession), Workspace(docs.sparkSession, "collocations") as work:
        filters: list[Broadcast] = []
        for n in range(1, min(2, max_words) + 1):
            filters.append(_frequent(work, plain, n, filters, least))
        counted = work.keep(_counts(plain, filters, max_words, least))
        for f in filters:
            f.destroy()
        candidates = counted.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
        split = F.split("phrase", " ")
        cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        cuts = cuts.withColumn("left", F.array_join(F.slice(split, 1, F.col("k")), " ")).withColumn("right", F.array_join(F.slice(split, F.col("k") + 1, F.col("words") - F.col("k")), " "))
        known = counted.where("words > 0").select("lang", "phrase", "n")
        cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
        cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
        score = F.expr("cast((cast(a as decimal(20,0)) * 2000000bd) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
        best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
        scored = cuts.groupBy("lang", "words", "phrase", "a").agg(best)
        # A candidate's own one-word-shorter parts, and how often it occurs.
        longer = candidates.where("words > 2").select("lang", F.col("a").alias("b"), F.explode(F.array(F.array_join(F.slice(split, 1, F.col("words") - 1), " "), F.array_join(F.slice(split, 2, F.col("words") - 1), " "))).alias("phrase"))
        longer = longer.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
        covered = F.expr(f"cast(b as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {explained}")
        left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("b").isNull() | ~covered)
        order = (F.desc("best.score"), F.desc("a"), "phrase")
        # A language's best are among the best of each of its parts, so no task ranks a whole language.
        dealt = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
        dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        first = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
        out = first.join(counted.where("words = 0").select("lang", F.col("n").alias("all")), "lang").withColumnRenamed("all", "n")
        return cut(out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score")))

