"""Near-duplicate documents by Order MinHash and banded alignment."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, Workspace, content_key, cut, hinted, lean, sized, small_batches
from .components import connected_components

#: Words of a shingle (k-mer) and the similarity from which documents link.
K, SIMILARITY = 5, 0.8
#: Sketches per document, k-mers in each.  A pair of similarity 0.8 agrees in a sketch with
#: probability 0.8 ** 3, so it meets in none of 12 with probability 0.0002.
SKETCHES, SAMPLED = 12, 3
#: Buckets of more classes, or of more k-mers, are cut into blocks; a task compares one block, or two.
BLOCK_ROWS, BLOCK_KMERS = 512, 4_000_000
#: Up to so many sequences are compared pair by pair, more by one matrix of what they share.
FEW, COLUMNS = 8, 4096
#: Rows that a task works on at once, and bytes.
OUT_ROWS, PIECE_BYTES = 250, 1 << 20
#: What hashes are built from: an odd number, so its powers can be divided by.
_BASE = 0x9E3779B97F4A7C15
_IN_WORD = np.array([re.fullmatch(WORD_BYTES, bytes([b]).lower()) is not None for b in range(256)])
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ x >> np.uint64(33)) * _M1
    x = (x ^ x >> np.uint64(33)) * _M2
    return x ^ x >> np.uint64(33)


#: A number for each byte, the same for a letter in either case.
_BYTE_VALUES = mix(np.array([bytes([b]).lower()[0] + 1 for b in range(256)], np.uint64))


def byte_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in UTF-8 bytes, with A-Z lower-cased, and their first and end bytes.

    A word's hash is the sum of a number for each byte times a power of _BASE for its place in the word: a difference of prefix
    sums, so there is no loop over words.
    """
    parts, lo = [], 0
    while lo < len(data):
        hi = min(len(data), lo + PIECE_BYTES)
        while hi < len(data) and _IN_WORD[data[hi - 1]] and _IN_WORD[data[hi]]:
            hi += 1
        some = data[lo:hi]
        edges = np.flatnonzero(np.diff(_IN_WORD[some].view(np.int8), prepend=0, append=0)).reshape(-1, 2)
        power, back = _powers(len(some))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[some] * power[: len(some)])])
        parts.append((mix((sums[edges[:, 1]] - sums[edges[:, 0]]) * back[edges[:, 0]]), edges[:, 0] + lo, edges[:, 1] + lo))
        lo = hi
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, first, end = (np.concatenate(c) for c in zip(*parts, strict=True))
    return h, first, end


def _powers(n: int, held: list = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of _BASE and of its inverse modulo 2**64, of at least n places; the longest so far are kept."""
    if not held or len(held[0]) < n:
        size = max(n, 1 << 16)
        held[:] = (np.cumprod(np.full(size, b, np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return held[0], held[1]


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the words of each text, in order."""
    raw = [t.encode() for t in texts]
    h, first, _ = byte_words(np.frombuffer(b"\n".join(raw), np.uint8))
    return np.split(h, np.searchsorted(first, np.cumsum([len(r) + 1 for r in raw])[:-1])) if raw else []


def kmers(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of every k consecutive words; a shorter text is one k-mer, one without words none."""
    if not len(h):
        return h
    k = min(k, len(h))
    h = mix(h)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    return mix(out)


def labelled(s: np.ndarray) -> np.ndarray:
    """K-mers told apart by their occurrence: the second one of a kind differs from the first."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, int)
    run = np.diff(np.concatenate([first, [len(t)]]))
    number = np.arange(len(t)) - np.repeat(first, run)
    out = np.empty_like(s)
    out[order] = number.astype(np.uint64)
    return mix(s + out * np.uint64(0xD6E8FEB86659FD93))


def sketches(x: np.ndarray, number: int = SKETCHES, sampled: int = SAMPLED) -> np.ndarray:
    """For each of ``number`` orders, the ``sampled`` least labelled k-mers, in text order, as one hash."""
    if not len(x):
        return x
    at = np.empty((number, min(sampled, len(x))), dtype=np.int64)
    for t in range(number):
        rank = (x ^ np.uint64((t + 1) * 0x5851F42D4C957F2D & (1 << 64) - 1)) * _M2
        rank ^= rank >> np.uint64(32)
        rank *= _M1
        at[t] = np.argpartition(rank, sampled - 1)[:sampled] if len(x) > sampled else np.arange(len(x))
    chosen = x[np.sort(at, axis=1)]
    value = np.arange(1, number + 1, dtype=np.uint64)
    for k in range(chosen.shape[1]):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) ^ chosen[:, k])
    return value


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The most words that two texts share in the same order, none shifted by more than ``band``: a longest common subsequence.

    Bit-parallel: one whole number holds a row of the alignment's table, a bit for each word of ``b``, and each word of ``a`` takes four operations on it.
    """
    places: dict[int, int] = {}
    for j, w in enumerate(b.tolist()):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    wide = (1 << 2 * band + 1) - 1
    row = full
    for i, w in enumerate(a.tolist()):
        near = wide << i - band if i >= band else wide >> band - i
        if hit := row & places.get(w, 0) & near:
            row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def numbered(words: np.ndarray) -> np.ndarray:
    """Words told apart by their occurrence, in 32 bits: what two texts have in common of these bounds any alignment from above."""
    return labelled(words.astype(np.uint64)).astype(np.uint32)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the words shared in order are at least ``least`` of all words of both texts.

    m shared words leave n1 + n2 - 2 m insertions and deletions, so similarity ``least`` bounds these, and with
    them the band: a word that is shifted further cannot belong to such an alignment.
    """
    n = len(a) + len(b)
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    need = least * n / (1 + least)
    if len(np.intersect1d(numbered(a), numbered(b))) < need - 1e-9:
        return False
    # The same words at both ends are part of a longest alignment.
    m = min(len(a), len(b))
    head = int((a[:m] == b[:m]).argmin()) if (a[:m] != b[:m]).any() else m
    m -= head
    back = a[::-1][:m] == b[::-1][:m]
    tail = int(back.argmin()) if not back.all() else m
    return head + tail + aligned(a[head : len(a) - tail], b[head : len(b) - tail], int(n - 2 * need) + 1) >= need - 1e-9


def shared_counts(sequences: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two of the sequences (without repetition) have in common."""
    owner = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
    _, at, held = np.unique(np.concatenate(sequences), return_inverse=True, return_counts=True)
    several = held[at] > 1
    owner, at = owner[several], (np.cumsum(held > 1) - 1)[at[several]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(sequences), len(sequences)), np.float32)
    columns = int(at[-1]) + 1 if len(at) else 0
    for lo in range(0, columns, COLUMNS):
        i, j = np.searchsorted(at, [lo, lo + COLUMNS])
        some = np.zeros((len(sequences), min(COLUMNS, columns - lo)), np.float32)
        some[owner[i:j], at[i:j] - lo] = 1
        out += some @ some.T
    return out


def links_within(
    sequences: list[np.ndarray], label: np.ndarray, side: np.ndarray, least: float, test: Callable[[np.ndarray, np.ndarray], bool] | None, whole: list[np.ndarray] | None = None
) -> list[tuple[int, int]]:
    """Links (i, j) that connect all sequences of a block that are alike to ``least``, without those inside what is connected.

    Sequences of one ``label`` count as connected before; where there are two sides, only pairs of one of each
    are compared.  m shared of n numbers in all are a similarity of m / (n - m), so ``least`` bounds m from
    below, exactly; ``test`` then decides on the pairs that reach the bound (None: they are alike), given ``whole`` if that is not what is compared.
    """
    given = sequences if whole is None else whole
    size = np.array([len(s) for s in sequences])
    place = np.unique(label, return_inverse=True)[1].tolist()
    parent = list(range(len(sequences)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    mixed = bool(side.min() != side.max())
    if len(sequences) <= FEW:
        pairs = ((i, j) for i in range(len(sequences)) for j in range(i + 1, len(sequences)))
        pairs = ((i, j) for i, j in pairs if min(size[i], size[j]) >= least * max(size[i], size[j]) and not (mixed and side[i] == side[j]))
        test = test or (lambda a, b: len(np.intersect1d(a, b, assume_unique=True)) >= least / (1 + least) * (len(a) + len(b)) - 1e-9)
    else:
        both = shared_counts(sequences)
        ok = np.triu(both >= least / (1 + least) * np.add.outer(size, size) - 1e-3, 1)
        if mixed:
            ok &= side[:, None] != side[None, :]
        i, j = np.nonzero(ok)
        order = np.argsort(-both[i, j] / np.minimum(size[i], size[j]), kind="stable")
        pairs = zip(i[order].tolist(), j[order].tolist(), strict=True)
    out = []
    for i, j in pairs:
        x, y = find(place[i]), find(place[j])
        if x != y and (test is None or test(given[i], given[j])):
            parent[x] = y
            out.append((i, j))
    return out


def _compare(groups: DataFrame, least: float, test: Callable[[np.ndarray, np.ndarray], bool] | None, unique: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    """Links (a, b) within groups of rows (key, part, block, side, node, label, sequence), each group in one task.

    ``unique`` makes numbers without repetition of a sequence, where it may have any.
    """
    keys = ("key", "part", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def close() -> pa.RecordBatch:
            node, label, side, sequences = (list(c) for c in zip(*held, strict=True))
            found = links_within(sequences if unique is None else [unique(s) for s in sequences], np.array(label), np.array(side), least, test, sequences)
            return pa.RecordBatch.from_arrays([pa.array([node[p[k]] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(c).to_numpy() for c in keys])
            edges = [0, *(np.flatnonzero((np.diff(at) != 0).any(0)) + 1).tolist(), batch.num_rows]
            node, label, side = (batch.column(c).to_pylist() for c in ("node", "label", "side"))
            sequence = batch.column("sequence")
            for lo, hi in itertools.pairwise(edges):
                now = tuple(at[:, lo].tolist())
                if held and now != last:
                    yield close()
                    held = []
                last = now
                # Copies of the bytes: a group outlives the batch.
                held += [(node[k], label[k], side[k], np.frombuffer(sequence[k].as_py(), np.uint32)) for k in range(lo, hi)]
        if held:
            yield close()

    return groups.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(lean(compare), "a long, b long")


def link_buckets(work: Workspace, classes: DataFrame, sequences: DataFrame, *, least: float, test: Callable[[np.ndarray, np.ndarray], bool] | None = None, unique: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(node, component) of the classes that link, from buckets of any size.  No pair that shares a bucket is left undecided.

    ``classes``: node and sketches (an array of numbers); classes that have a number in common share a bucket.  Buckets of the
    same members count once.  ``sequences``: node, sequence (bytes of 32-bit numbers, none twice unless ``unique`` makes them so) of at least these classes.

    1. A bucket of at most BLOCK_ROWS classes is one block, a longer one is cut into several.  Each block is compared
       as a whole where it lies (see :func:`links_within`), and only a forest of links leaves it, so neither pairs nor
       links of a group are ever written.
    2. Where a bucket of several blocks still holds several components, the members outside of its largest one meet
       all its blocks.  Members of the largest component need no comparison with each other.
    """
    members = classes.select("node", F.explode("sketches").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head"), F.bit_xor(F.xxhash64("node")).alias("sign")).where("n > 1")
    buckets = work.sized(shared.groupBy("n", "head", "sign").agg(F.min("key").alias("key")).select("key"))
    belongs = work.keep(members.join(buckets, "key").select("key", "node"))
    several = belongs.select("node").distinct()
    needed = work.sized(several)
    wanted = work.keep(sequences.join(needed, "node", "left_semi").select("node", "sequence", F.length("sequence").alias("bytes")))
    weights = belongs.join(wanted.select("node", "bytes"), "node").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("bytes") / (4 * BLOCK_KMERS))).cast("int")
    placed = belongs.join(work.sized(weights.select("key", blocks.alias("blocks"))), "key")
    placed = work.keep(placed.select("key", "node", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    spelled = wanted.select("node", "sequence").join(hinted(placed), "node")
    alone = spelled.select("key", F.lit(0).alias("part"), "block", F.lit(0).alias("side"), "node", F.col("node").alias("label"), "sequence")
    links = work.keep(_compare(alone, least, test, unique))
    component = connected_components(links)
    long = placed.where("blocks > 1")
    if long.isEmpty():
        return component
    known = work.keep(long.join(component, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"))
    parts = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    open_ = parts.groupBy("key").agg(F.max_by("label", "n").alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    rest = F.ceil((F.col("n") - F.col("most")) / F.col("n") * F.col("blocks")).cast("int")
    known = work.keep(known.join(work.sized(open_), "key").withColumn("parts", rest))
    if known.isEmpty():
        return component
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    minor = known.where("label <> main").select("key", own.alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("side"), "node", "label")
    every = known.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", F.lit(1).alias("side"), "node", "label")
    more = _compare(wanted.select("node", "sequence").join(minor.unionByName(every), "node"), least, test, unique)
    stars = component.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return connected_components(work.keep(stars.unionByName(more)))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, number: int = SKETCHES, sampled: int = SAMPLED) -> DataFrame:
    """Group documents that are equal, or alike to ``least`` or more by alignment of their words.

    1. Texts of equal content become one class, so copies cost one row each, however many.
    2. Each class has ``number`` Order-MinHash sketches: the ``sampled`` least occurrence-labelled 5-mers,
       kept in text order.  Classes of one sketch share a bucket.
    3. Whatever shares a bucket is compared (see :func:`link_buckets`) by a banded alignment of both whole texts: the words shared in order, of all words of
       both.  What two texts have in common of words told apart by their occurrence is an upper bound, which leaves most pairs out.  Words are told apart by 32 bits of
       their hash.  An edit changes one word here, where it would change five 5-mers: of texts alike to 0.9, some 0.6 of the 5-mers agree.
    4. Components of the links are the groups.

    Returns doc_id, content (a key of the text), cluster_id (the least doc_id of the group) and kept (true for
    exactly one row per group, of the least doc_id).

    Null texts count as empty.  Texts of fewer than five words are one 5-mer; those without words
    equal only exact copies.  Null ids come after all others and are kept only in groups without
    any other.  Repeated rows are copies.  Empty table: no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(lo, OUT_ROWS)
                values, offsets, spelled = [np.zeros(0, np.uint64)], [0], []
                for h in word_hashes(batch.column("text").to_pylist()):
                    x = labelled(kmers(h))
                    values.append(sketches(x, number, sampled))
                    spelled.append(h.astype(np.uint32).tobytes())
                    offsets.append(offsets[-1] + len(values[-1]))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), lists, pa.array(spelled, pa.binary())], names=["doc_id", "content", "sketches", "sequence"])

    with Workspace(spark, "near-duplicates") as work:
        sketched = rows.withColumn("content", content_key(F.col("text"))).mapInArrow(lean(sketch), f"doc_id {id_type}, content binary, sketches array<long>, sequence binary")
        # Numbers of kept rows: they stay the same however often the table is read.
        sketched = work.keep(sketched.withColumn("row", F.monotonically_increasing_id()))
        copies = work.sized(sketched.groupBy("content").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
        known = sketched.join(copies, "content", "left").withColumn("node", F.coalesce("node", "row"))
        classes = known.where("node = row").select("node", "sketches")
        component = work.sized(link_buckets(work, classes, sketched.select(F.col("row").alias("node"), "sequence"), least=least, test=lambda a, b: similar(a, b, least), unique=numbered))
        found = known.select("row", "doc_id", "content", "node").join(component, "node", "left").withColumn("cluster", F.coalesce("component", "node"))
        found = work.keep(found.select("row", "doc_id", "content", "cluster"))
        least_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
        several = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster")
        heads = found.join(work.sized(several), "cluster", "left_semi").groupBy("cluster").agg(least_row)
        heads = work.sized(heads.select("cluster", F.col("first.doc_id").alias("head_id"), F.col("first.row").alias("head_row")))
        named = found.join(heads, "cluster", "left")
        alone = F.col("head_row").isNull()
        return cut(named.select("doc_id", "content", F.when(alone, F.col("doc_id")).otherwise(F.col("head_id")).alias("cluster_id"), (alone | (F.col("row") == F.col("head_row"))).alias("kept")))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group of :func:`near_duplicates`, with all its columns, whatever their names.

    Rows of the kept id and text stay; where there are several such rows, one of them.  Nulls, empty and repeated texts
    and empty tables as there.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    pairs = found.groupBy("doc_id", "content").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    changed = sized(pairs.where("NOT kept OR n > 1").select(F.col("doc_id").alias("id"), F.col("content").alias("of"), "kept"))
    # All columns travel as one struct, so no name of theirs meets one of the operator's.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    keyed = packed.select("document", F.col("document").getField(id_col).alias("doc_id"), content_key(F.col("document").getField(text_col)).alias("content"))
    met = keyed.join(changed, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("content") == F.col("of")), "left")
    once = met.where("kept IS NULL")
    several = met.where("kept").dropDuplicates(["doc_id", "content"])
    return once.unionByName(several).select("document.*")
