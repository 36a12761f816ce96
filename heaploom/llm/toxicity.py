"""Toxicity from class-conditional Kneser-Ney models with shared backoff counts.

Both classes are modelled by Kneser-Ney continuation counts: a word counts once for each different
word before it in texts of the class, so copied texts and repeated lines count once.  A discount
takes the mass of rare words away from both class models and gives it to one distribution that
they share, so an expression that is rare anywhere says little about the class.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, Workspace, cut, lean, small_batches

_WORDS = re.compile(WORD_BYTES)
#: What each continuation count gives to the shared distribution.
DISCOUNT = 3.0
#: Words of which the most toxic stretch of a text is made.
STRETCH = 24
#: Log-ratios count as excess above this.
MARGIN = 2.0
#: Only words of more continuation counts than DISCOUNT in a class have a ratio of their own.  Up to so many of them (12 bytes
#: each) are handed to every task; more are joined to the words of the texts by shuffle.
MODEL_WORDS = 4_000_000
#: The calibration curve is fitted on at most so many labelled rows, those of least hash.
CALIBRATION_ROWS = 20_000
#: Labels of at most so many rows are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_LABELS = 2_000_000
#: A task sends its different pairs whenever it has seen so many, remembers the hashes of so many words
#: and works on so many rows at once.
FLUSH_PAIRS, TABLE_WORDS, STEP_ROWS = 500_000, 100_000, 500
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: bytes) -> int:
    return zlib.crc32(word) << 32 | zlib.adler32(word)


class Remembered(dict):
    """What a function gives for a word, worked out once per word and task; emptied when it gets large."""

    def __init__(self, work: Callable[[bytes], float]):
        self.work = work

    def __missing__(self, word: bytes) -> float:
        if len(self) > TABLE_WORDS:
            self.clear()
        value = self[word] = self.work(word)
        return value


def words_of(text: str) -> list[bytes]:
    return _WORDS.findall(text.encode().lower())


def pair_keys(h: np.ndarray) -> np.ndarray:
    """Each word with the one before it (0 before the first), as one 64-bit key."""
    before = np.concatenate([np.zeros(min(1, len(h)), np.uint64), h[:-1]])
    x = before * np.uint64(0xC2B2AE3D27D4EB4F) ^ h * _MIX
    return x ^ x >> np.uint64(29)


def text_features(r: np.ndarray) -> tuple[float, float, float, float]:
    """From the log-ratios of a text's words: their mean (the length-normalised difference of both log-likelihoods), the mean of its most toxic stretch, the largest, and the mean excess."""
    if not len(r):
        return 0.0, 0.0, 0.0, 0.0
    sums = np.concatenate([[0.0], np.cumsum(r)])
    size = min(STRETCH, len(r))
    return float(r.mean()), float((sums[size:] - sums[:-size]).max() / size), float(r.max()), float(np.maximum(r - MARGIN, 0).mean())


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method: (means, scales, weights with the intercept last)."""
    if not len(y):
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    pull = np.full(len(w), ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - pull * w
        w = w + np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), slope)
    return mean, scale, w


class ToxicityModel:
    """What scoring needs: log-ratios of words, that of all other words, and the calibration curve.

    ``ratios`` is a kept table (word: its hash, ratio).  ``held`` are the same as sorted arrays, where they are few enough.  ``judges``: there were labels of both
    classes, without which nothing can be rejected.
    """

    def __init__(self, ratios: DataFrame, default: float, held: tuple[np.ndarray, np.ndarray] | None, curve: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, judges: bool = True):
        self.ratios, self.default, self.held, self.curve, self.judges = ratios, default, held, curve, judges

    def lookup(self, spark):
        """A function for tasks: the log-ratio of a word."""
        words, values = (spark.sparkContext.broadcast(x) for x in self.held)
        default = self.default

        def ratio(word: bytes) -> float:
            h = np.uint64(word_hash(word))
            at = int(np.searchsorted(words.value, h))
            return float(values.value[at]) if at < len(words.value) and words.value[at] == h else default

        return ratio

    def score(self, features: list[Column]) -> Column:
        mean, scale, w = self.curve
        z = F.lit(float(w[-1]))
        for k, f in enumerate(features):
            z = z + (f - float(mean[k])) / float(scale[k]) * float(w[k])
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut small, so that what is derived from one never weighs much."""
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP_ROWS):
            yield batch.slice(lo, STEP_ROWS)


def fold(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 4: fold 2 is held out, 3 calibrates, 0 and 1 give the counts."""
    return F.crc32(id_column.cast("string")) % 4


_FEATURES = "f0 double, f1 double, f2 double, f3 double"


def _feature_batch(found: list[tuple[float, float, float, float]], columns: list, names: list[str]) -> pa.RecordBatch:
    table = np.array(found, dtype=np.float64).reshape(-1, 4)
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(table[:, k]) for k in range(4))], names=[*names, "f0", "f1", "f2", "f3"])


def _features(docs: DataFrame, model: ToxicityModel, rest: list[str]) -> DataFrame:
    """The columns ``rest`` and four features of each row's text (column text, not null)."""
    fields = {f.name: f.dataType for f in docs.schema.fields}
    given = "".join(f"`{c}` {fields[c].simpleString()}, " for c in rest)
    if model.held is not None:
        ratio = model.lookup(docs.sparkSession)

        def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = Remembered(ratio)
            for batch in _steps(batches):
                found = [text_features(np.array([table[w] for w in words_of(t.as_py())], dtype=np.float64)) for t in batch.column("text")]
                yield _feature_batch(found, [batch.column(c) for c in rest], rest)

        return docs.select(*rest, "text").mapInArrow(lean(featurise), given + _FEATURES)

    # More words than a task should hold: every word of the texts meets its ratio by shuffle, and a text's ratios come back in order.
    numbered = cut(docs.select(*rest, "text").withColumn("number", F.monotonically_increasing_id()))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Remembered(word_hash)
        for batch in _steps(batches):
            hashes = [np.array([table[w] for w in words_of(t.as_py())], dtype=np.uint64).view(np.int64) for t in batch.column("text")]
            size = [len(h) for h in hashes]
            number = np.repeat(batch.column("number").to_numpy(), size)
            place = np.concatenate([np.arange(n) for n in size]) if size else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(place.astype(np.int32)), pa.array(np.concatenate(hashes) if size else number)], names=["number", "at", "word"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(r.values.to_numpy()) for r in batch.column("ratios")]
            yield _feature_batch(found, [batch.column("number")], ["number"])

    each = numbered.select("number", "text").mapInArrow(lean(spell), "number long, at int, word long").join(model.ratios, "word", "left")
    lists = each.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("ratio", F.lit(model.default)).alias("r")))).alias("r")).select("number", F.col("r.r").alias("ratios"))
    found = lists.mapInArrow(lean(gather), f"number long, {_FEATURES}")
    empty = [F.coalesce(f"f{k}", F.lit(0.0)).alias(f"f{k}") for k in range(4)]
    return numbered.drop("text").join(found, "number", "left").select(*rest, *empty)


def learn(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", calibration_rows: int = CALIBRATION_ROWS, model_words: int = MODEL_WORDS
) -> ToxicityModel:
    """Count all labelled training documents and calibrate.

    Folds 0 and 1 of :func:`fold` give the counts: tasks send the different word pairs of each class, the cluster removes
    repetitions and counts the pairs of each word, so the table grows with the words of the corpus and no two words
    share a count (but for equal 64-bit hashes).  Where neither class counts a word more than DISCOUNT times, both models give it
    the mass they freed times the same shared probability, so all such words have one ratio and need no row.
    Sums reach the driver, and the other words' ratios if they are at most ``model_words``; more are joined by shuffle.
    Fold 3, which the counts have not seen, fits the curve from features to probability, on at most
    ``calibration_rows`` rows, those of least hash.  Fold 2 is never looked at.

    Rows without an id or label are no labels; of several labels of an id the largest counts.  Null and empty texts have no
    words, repeated texts count once.  Empty tables: every score is 0.5.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    truth = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(F.col(id_col)) != 2))
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    )
    truth = F.broadcast(truth) if truth.count() <= BROADCAST_LABELS else truth
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(fold(F.col("doc_id")) != 2)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Remembered(word_hash)
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for toxic, parts in enumerate(held):
                if parts:
                    words = np.concatenate(parts)
                    keys = np.concatenate([pair_keys(h) for h in parts])
                    keys, at = np.unique(keys, return_index=True)
                    for lo in range(0, len(keys), 200_000):
                        some = at[lo : lo + 200_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[lo : lo + 200_000].view(np.int64)), pa.array(words[some].view(np.int64)), pa.array(np.full(len(some), 1 << toxic, np.int32))], names=["pair", "word", "classes"]
                        )
                    parts.clear()

        for batch in _steps(batches):
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                h = np.array([table[w] for w in words_of(text.as_py())], dtype=np.uint64)
                if len(h):
                    held[int(toxic > 0)].append(h)
                    size += len(h)
                if size >= FLUSH_PAIRS:
                    yield from flush()
                    size = 0
        yield from flush()

    labelled = texts.where(fold(F.col("doc_id")).isin(0, 1)).join(truth, "doc_id").select("text", "toxic")
    with Workspace(spark, "toxicity") as work:
        counts = work.keep(
            labelled.mapInArrow(lean(pairs), "pair long, word long, classes int")
            .groupBy("pair", "word")
            .agg(F.bit_or("classes").alias("classes"))
            .groupBy("word")
            .agg(F.sum((F.col("classes").bitwiseAND(1) > 0).cast("long")).alias("ordinary"), F.sum((F.col("classes").bitwiseAND(2) > 0).cast("long")).alias("toxic"), F.count(F.lit(1)).alias("shared"))
        )
        ratios, default = _ratios(counts)
        ratios = cut(ratios)
    few = ratios.count() <= model_words
    held = ratios.toArrow() if few else None
    if few:
        words = held["word"].to_numpy().view(np.uint64)
        order = np.argsort(words)
        held = words[order], held["ratio"].to_numpy()[order]
    seen = truth.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("ordinary")).first()
    model = ToxicityModel(ratios, default, held, judges=bool(seen["toxic"] and seen["ordinary"]))
    chosen = truth.where(fold(F.col("doc_id")) == 3).orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_rows)
    rows = _features(texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), model, ["toxic"]).toArrow()
    x = np.stack([rows[f"f{k}"].to_numpy() for k in range(4)], 1)
    model.curve = fit_curve(x, (rows["toxic"].to_numpy() > 0).astype(float))
    return model


def _ratios(counts: DataFrame, discount: float = DISCOUNT) -> tuple[DataFrame, float]:
    """(word, ratio) of the words that a class counts more than ``discount`` times, and the ratio of all others.

    Kneser-Ney: each class takes the discount from each of its continuation counts and gives what it freed to the shared distribution.
    """
    spared = [F.sum(F.least(F.col(c).cast("double"), F.lit(discount))) for c in ("ordinary", "toxic")]
    total = counts.agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"), F.sum("shared").alias("shared"), F.count(F.lit(1)).alias("words"), spared[0].alias("freed_ordinary"), spared[1].alias("freed_toxic")).first()
    freed, p = {}, {}
    base = (F.col("shared") + 0.1) / F.lit((total["shared"] or 0) + 0.1 * max(1, total["words"]))
    for c in ("ordinary", "toxic"):
        n = total[c] or 0
        freed[c] = total[f"freed_{c}"] / n if n else 1.0
        p[c] = F.greatest(F.col(c) - discount, F.lit(0.0)) / F.lit(float(max(n, 1))) + F.lit(freed[c]) * base
    clipped = lambda x: F.least(F.lit(12.0), F.greatest(F.lit(-12.0), x))
    own = counts.where(F.greatest("ordinary", "toxic") > discount).select("word", clipped(F.log(p["toxic"]) - F.log(p["ordinary"])).alias("ratio"))
    return own, float(np.clip(np.log(freed["toxic"]) - np.log(freed["ordinary"]), -12, 12))


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every whole text.

    Without a shuffle, unless the model has more words than a task should hold.  Null and empty texts score like a text without any
    evidence.  Rows with a null id are not held out.  Repeated rows score alike.  Empty table: no rows.  Other columns are ignored.
    Without labels every score is 0.5; without labels of both classes it is near the class there is.
    """
    small_batches(docs.sparkSession)
    found = _features(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), model, ["doc_id"])
    score = model.score([F.col(f"f{k}") for k in range(4)])
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, whose text scores below ``threshold``.

    Nulls, empty and repeated texts and empty tables as in :func:`score_toxicity`.  A model without labels of both classes rejects nothing.
    """
    if not model.judges:
        return docs
    small_batches(docs.sparkSession)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    found = _features(docs.select(whole).select("document", F.coalesce(F.col("document").getField(text_col), F.lit("")).alias("text")), model, ["document"])
    return found.where(model.score([F.col(f"f{k}") for k in range(4)]) < threshold).select("document.*")
