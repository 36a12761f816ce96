"""Byte-level BPE by tree concatenation: halves in parallel, then windows around each join.

Exactness rests on two facts.

* Between pre-tokens: a letter followed by a non-letter, a number followed by a non-number and
  a non-space followed by white space always end a pre-token, and no alternative of the
  splitting pattern looks behind.  Both sides of such a place encode independently, so a
  window that starts and ends at such places can be encoded anew by itself, and is compared
  with the tokens that both sides had at its ends before it replaces what stood between.
* Inside one pre-token: a sequence of tokens is the encoding of its bytes if and only if each
  neighbouring pair is.  If the window's new encoding starts with the left side's token and
  ends with the right side's, every pair of the joined sequence is known to be an encoding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

#: How byte-level pre-tokenisation splits text (fixed by the tokenizer's format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Places that always end a pre-token.
SAFE = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=\s)")
LEAF_CHARS = 1 << 14
#: A window reaches so many characters to each side of a join at first.
WINDOW_CHARS = 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others are numbered on from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TreeBpe:
    """Encoder and decoder for one tokenizer file (byte-level BPE, no normaliser)."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, window_chars: int = WINDOW_CHARS):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files are supported")
        self.special = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that strip or need word ends are not supported")
            self.special[t["content"]] = t["id"]
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        order = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(order, order[1:], strict=False)):
            raise ValueError("ids must follow the order of the merges")
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.lengths = [len(b) for b in self.table]
        self.core = tiktoken.Encoding("tree", pat_str=SPLIT, mergeable_ranks=vocab, special_tokens={})
        self.split = regex.compile(SPLIT)
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.leaf = max(8, leaf_chars)
        self.window = max(1, window_chars)
        #: How many windows were encoded or found too narrow: one for each join, and one more each time that a window grew.
        self.tried = 0

    # -- inside one pre-token ------------------------------------------------

    def unsplit(self, piece: bytes) -> list[int]:
        """Encode bytes that pre-tokenisation keeps together, by halves."""
        if len(piece) <= self.leaf:
            return self.core._encode_single_piece(piece)
        half = len(piece) // 2
        return self.join_unsplit(self.unsplit(piece[:half]), self.unsplit(piece[half:]))

    def join_unsplit(self, left: list[int], right: list[int]) -> list[int]:
        """Join two encodings within a pre-token: the window grows until both of its ends agree."""
        k = 2
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = self.core._encode_single_piece(b"".join(self.table[t] for t in left[i:] + right[:j]))
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            k *= 2

    # -- between pre-tokens --------------------------------------------------

    def leaf_ids(self, text: str) -> list[int]:
        """Encode a text that fits a leaf, or a window whose pre-tokens may be long."""
        if len(text) <= 2 * self.leaf:
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for m in self.split.finditer(text):
            out += self.unsplit(m.group().encode())
        return out

    def join_texts(self, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
        """Join neighbouring texts: the window around the join is encoded anew, and grows until it agrees with both sides.

        It begins and ends at safe places, and agrees with a side if its tokens equal that side's between its outermost two
        safe places there.  A window that takes in a whole side has nothing to agree with on it.
        """
        (a, x), (b, y) = left, right
        w = self.window
        while True:
            self.tried += 1
            begin, one = self._outer_left(a, w)
            end, two = self._outer_right(b, w)
            if one is not None and two is not None:
                ids = self.leaf_ids(a[begin:] + b[:end])
                i, j = self._back(x, len(a[begin:].encode())), self._forth(y, len(b[:end].encode()))
                n = self._forth(x[i:], len(a[begin:one].encode())) if begin else 0
                m = len(y[:j]) - self._back(y[:j], len(b[two:end].encode())) if end < len(b) else 0
                if ids[:n] == x[i : i + n] and ids[len(ids) - m :] == y[j - m : j]:
                    return a + b, x[:i] + ids + y[j:]
            w *= 2

    @staticmethod
    def _outer_left(a: str, w: int) -> tuple[int, int | None]:
        """The first two safe places within the last w characters; None for the second if there are no two."""
        if w >= len(a):
            return 0, 0
        places = (m.start() for m in SAFE.finditer(a, len(a) - w))
        return next(places, 0), next(places, None)

    @staticmethod
    def _outer_right(b: str, w: int) -> tuple[int, int | None]:
        """The last safe place within the first w characters and the one before it; None for that if there are no two."""
        if w >= len(b):
            return len(b), len(b)
        places = [m.start() for m in SAFE.finditer(b, 1, w)]
        return (places[-1], places[-2]) if len(places) > 1 else (len(b), None)

    def _back(self, ids: list[int], n: int) -> int:
        """The index of the token at which the last n bytes begin."""
        i = len(ids)
        while n > 0:
            i -= 1
            n -= self.lengths[ids[i]]
        if n:
            raise AssertionError("a safe place must be a token boundary")
        return i

    def _forth(self, ids: list[int], n: int) -> int:
        j = 0
        while n > 0:
            n -= self.lengths[ids[j]]
            j += 1
        if n:
            raise AssertionError("a safe place must be a token boundary")
        return j

    def tree(self, parts: list[tuple[str, list[int]]]) -> list[int]:
        """Concatenate encoded neighbours pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join_texts(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0][1] if parts else []

    def sections(self, text: str) -> list[tuple[str, int]]:
        """(text, -1) or (special, id) in order; special tokens split whatever stands around them."""
        if self.special_at is None:
            return [(text, -1)] if text else []
        return [(s, self.special.get(s, -1)) for s in self.special_at.split(text) if s]

    def leaves(self, text: str) -> list[str]:
        """Halve until every piece fits a leaf."""
        if len(text) <= self.leaf:
            return [text]
        half = len(text) // 2
        return self.leaves(text[:half]) + self.leaves(text[half:])

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.sections(text):
            out += [special] if special >= 0 else self.tree([(s, self.leaf_ids(s)) for s in self.leaves(part)])
        return out

    def decode(self, ids) -> str:
        table = self.table
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _id_lists(lists: list[list[int]]) -> pa.Array:
    offsets, flat = [0], []
    for x in lists:
        flat += x
        offsets.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


#: Rows go back to Spark once their texts reach so many bytes.
OUT_BYTES = 4 << 20


def encode(docs: DataFrame, *, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Encode whole texts; returns doc_id and ids (array of int), one row per row of ``docs``.

    Texts of at most ``leaf_chars`` characters are encoded where they are read.  Longer ones are
    halved into leaves, which are dealt over the cluster, encoded in parallel and joined as a
    tree in one task per document: only long documents are shuffled, and one task never holds
    more than one of them.  The ids equal those of the tokenizers library for the whole text
    without added special tokens; special strings in a text become their own ids, as there.

    Null text: as empty, no ids.  Repeated ids or rows are encoded each by itself.  Empty table: no
    rows.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or default_path()
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBpe(path, leaf_chars)
        for batch in batches:
            texts, lo, held, out = batch.column("text"), 0, 0, []
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                out.append(bpe.encode(text))
                held += len(text)
                if held >= OUT_BYTES or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, k + 1 - lo), _id_lists(out)], names=["doc_id", "ids"])
                    lo, held, out = k + 1, 0, []

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBpe(path, leaf_chars)
        names = ["row", "doc_id", "section", "leaf", "special", "piece"]
        for batch in batches:
            for k in range(batch.num_rows):
                pieces = []
                for s, (part, special) in enumerate(bpe.sections(batch.column("text")[k].as_py())):
                    pieces += [(s, i, special, x) for i, x in enumerate([part] if special >= 0 else bpe.leaves(part))]
                n = len(pieces)
                columns = zip(*pieces, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array([k] * n)), batch.column("doc_id").take(pa.array([k] * n))]
                    + [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)],
                    names=names,
                )

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBpe(path, leaf_chars)
        for batch in batches:
            ids = [[s] if s >= 0 else bpe.leaf_ids(x) for s, x in zip(batch.column("special").to_pylist(), batch.column("piece").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, _id_lists(ids)], names=[*batch.schema.names, "ids"])

    def concatenate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by row, section and leaf; a document may span batches."""
        bpe = TreeBpe(path, leaf_chars)
        row, doc, parts, section, done = None, None, [], None, []
        names = ["doc_id", "ids"]
        kind = None

        def close():
            return done + bpe.tree(parts)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            data = [batch.column(c) for c in ("row", "doc_id", "section", "piece", "ids")]
            for k in range(batch.num_rows):
                r, d, s, piece, ids = (c[k].as_py() for c in data)
                if r != row:
                    if row is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([doc], kind), _id_lists([close()])], names=names)
                    row, doc, parts, section, done = r, d, [], s, []
                elif s != section:
                    done, parts, section = close(), [], s
                parts.append((piece, ids))
        if row is not None:
            yield pa.RecordBatch.from_arrays([pa.array([doc], kind), _id_lists([close()])], names=names)

    is_long = F.length("text") > leaf_chars
    schema = f"doc_id {id_type}, ids array<int>"
    short_ids = rows.where(~is_long).mapInArrow(lean(whole), schema)
    leaves = (
        rows.where(is_long)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        .mapInArrow(lean(halve), f"row long, doc_id {id_type}, section int, leaf int, special int, piece string")
        .repartition(F.xxhash64("row", "section", "leaf"))
        .mapInArrow(lean(leaf), f"row long, doc_id {id_type}, section int, leaf int, special int, piece string, ids array<int>")
    )
    long_ids = leaves.repartition("row").sortWithinPartitions("row", "section", "leaf").mapInArrow(lean(concatenate), schema)
    return short_ids.unionByName(long_ids)


def decode(encoded: DataFrame, *, tokenizer: str | None = None) -> DataFrame:
    """Decode ids; returns doc_id, ids and text.  Null or empty ids: empty text.

    Bytes that are no UTF-8 become U+FFFD, special ids their strings, as in the tokenizers library.
    """
    small_batches(encoded.sparkSession)
    path = tokenizer or default_path()
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBpe(path)
        for batch in batches:
            texts, lo, held = [], 0, 0
            lists = batch.column("ids")
            for k in range(batch.num_rows):
                ids = lists[k]
                texts.append(bpe.decode(ids.values.to_numpy().tolist() if ids.is_valid else []))
                held += len(texts[-1])
                if held >= OUT_BYTES or k + 1 == batch.num_rows:
                    part = batch.slice(lo, k + 1 - lo)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
                    lo, held, texts = k + 1, 0, []

    return encoded.select("doc_id", "ids").mapInArrow(lean(back), f"doc_id {id_type}, ids array<int>, text string")
