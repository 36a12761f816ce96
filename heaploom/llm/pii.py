"""Personal data: fixed patterns and a skip-chain conditional random field."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

#: Kinds of the fixed patterns, and what the field alone finds: keys and tokens that grant access.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELS = ("other", *KINDS)

#: The right-hand side of an address, from the @ on.
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]")
#: A match never begins inside a run of digits: what fails from its first digit fails from the others.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: Tokens that can be personal data: runs of non-spaces with a digit, an @ or a plus sign.
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@+]*+[0-9@+]\S*+")
#: What stands before a secret, a name and its value in one token, and public formats of keys (fixed values).
_NAMES = r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth|credentials?|bearer)"
_BEFORE = re.compile(rf"{_NAMES}[\"']?(?:\s{{0,3}}[=:]|\s+is)?\s{{0,3}}[\"'(<]?$", re.IGNORECASE)
_ASSIGNED = re.compile(rf"[\"']?[\w.-]*{_NAMES}[\w-]*[\"']?[=:][\"']?(?=\S)", re.IGNORECASE)
_KNOWN_KEY = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.")
_KEY = re.compile(r"[A-Za-z0-9_+/=.~-]{16,}")
_HEX = re.compile(r"[0-9a-fA-F]{32,}")
_TRIM = ".,;:!?\"'()[]{}<>*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind; (kind, start, end) in order of kind and start.

    Time is linear in the text: an address is found from its @, to the left as far as its letters
    and the end of the last address allow.
    """
    spans: list[tuple[str, int, int]] = []
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and _EMAIL_HEAD.match(text[start - 1]):
            start -= 1
        tail = _EMAIL_TAIL.match(text, at) if start < at else None
        if tail:
            spans.append(("email", start, tail.end()))
        after = tail.end() if tail else at + 1
        at = text.find("@", after)
    if not _DIGITS.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isascii() and c.isdigit() for c in m.group()) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return spans


def list_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


# -- the random field -----------------------------------------------------------

FEATURES = 19
#: Bits of a shape: a value after a name of secrets, and a public format of keys.
_NAMED, _FORMAT = 1 << 17, 1 << 18


def features(token: str, before: str = "") -> int:
    """The shape of a token as bits, and whether what stands ``before`` it names a secret.  So there are few shapes, however many tokens."""
    digits = sum("0" <= c <= "9" for c in token)
    head, at, tail = token.partition("@")
    parts = token.split(".")
    four = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    bits = [
        at != "" and "@" not in tail,
        at != "" and "." in tail and head != "",
        four,
        four and all(int(p[-4:]) <= 255 and len(p) <= 3 for p in parts),
        token[:1] == "+",
        "(" in token or ")" in token,
        "-" in token,
        any(c.isalpha() for c in token),
        13 <= digits <= 19,
        13 <= digits <= 19 and luhn("".join(c for c in token if "0" <= c <= "9")),
        digits == 4 and len(token) == 4,
        9 <= digits <= 15,
    ]
    size = min(7, digits.bit_length())
    shape = sum(b << k for k, b in enumerate(bits)) | size << 12
    if len(token) >= 16 and _KEY.fullmatch(token):
        if any(c.isalpha() for c in token):
            # How many digits a key happens to have says nothing.
            shape = 1 << 15 | (_HEX.fullmatch(token) is not None) << 16
            if before and _BEFORE.search(before):
                shape |= _NAMED
        if _KNOWN_KEY.match(token):
            shape |= _FORMAT
    return shape


def tokens_of(text: str) -> list[tuple[int, int, str, int]]:
    """Candidate tokens without the punctuation around them: (start, end, token, shape).  Of a name and its value in one token the value is one."""
    out = []
    for m in _TOKEN.finditer(text):
        raw, skipped = m.group(), 0
        if len(raw) >= 16 and (named := _ASSIGNED.match(raw)):
            skipped = named.end()
        left = raw[skipped:].lstrip(_TRIM)
        token = left.rstrip(_TRIM)
        if token:
            start = m.start() + len(raw) - len(left)
            out.append((start, start + len(token), token, features(token, text[max(0, start - 40) : start])))
    return out


def similar_keys(token: str) -> list[str]:
    """Tokens that share one of these are linked: equal but for case, or of equal seven digits and more."""
    keys = ["=" + token.lower()]
    digits = "".join(c for c in token if "0" <= c <= "9")
    return [*keys, "#" + digits] if len(digits) >= 7 else keys


def graph_of(text: str) -> tuple[list[tuple[int, int, str, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Tokens, chain edges (only spaces between) and skip edges (each to the first similar token).

    Plain words, which can be no personal data by any shape, hold the label other and send no
    message, so they need no node.  The first token of a kind is the hub of all similar ones: any two are two edges apart, however far
    they stand from each other, and edges stay linear in the text.
    """
    tokens = tokens_of(text)
    chain = [(k, k + 1) for k in range(len(tokens) - 1) if text[tokens[k][1] : tokens[k + 1][0]].strip(" " + _TRIM) == ""]
    hub: dict[str, int] = {}
    skip = set()
    for k, (_, _, token, _) in enumerate(tokens):
        for key in similar_keys(token):
            if (first := hub.setdefault(key, k)) != k:
                skip.add((first, k))
    return tokens, chain, sorted(skip)


def silver_labels(tokens: list[tuple[int, int, str, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    """Labels from the fixed patterns: the kind of a span that overlaps the token (both are in order); else secret, where a name or a public format says so."""
    out = [LABELS.index("secret") if shape & (_NAMED | _FORMAT) else 0 for *_, shape in tokens]
    for number, kind in reversed(list(enumerate(BASE_KINDS, 1))):
        own = [s for s in spans if s[0] == kind]
        j = 0
        for k, (a, b, *_) in enumerate(tokens):
            while j < len(own) and own[j][2] <= a:
                j += 1
            if j < len(own) and own[j][1] < b:
                out[k] = number
    return out


class SkipChain:
    """Log-potentials of the field: by shape and label, for neighbours, and for similar tokens."""

    def __init__(self, unary: dict[int, np.ndarray], prior: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.prior, self.chain, self.skip = unary, prior, chain, skip

    @classmethod
    def fit(cls, rows: list[tuple[str, int, int, int]], smooth: float = 0.5) -> SkipChain:
        """Piecewise estimates from counts (which, a, b, n): 'shape' (shape, label), 'chain' and 'skip' (label, label).

        A shape's potential is its smoothed log posterior; the potentials of edges are pointwise mutual
        informations, so that labels which the pieces say already are not counted twice.
        """
        size = len(LABELS)
        shapes: dict[int, np.ndarray] = {}
        edges = {"chain": np.full((size, size), smooth), "skip": np.full((size, size), smooth)}
        for which, a, b, n in rows:
            if which == "shape":
                shapes.setdefault(a, np.zeros(size))[b] += n
            else:
                edges[which][a, b] += n
        total = sum(shapes.values(), np.full(size, smooth))
        prior = total / total.sum()
        unary = {s: np.log((c + smooth * prior) / (c.sum() + smooth)) for s, c in shapes.items()}

        def information(counts: np.ndarray) -> np.ndarray:
            joint = (counts + counts.T) / (2 * counts.sum())
            side = joint.sum(1)
            return np.clip(np.log(joint / np.outer(side, side)), -4, 4)

        return cls(unary, np.log(prior), information(edges["chain"]), information(edges["skip"]))

    def beliefs(self, shapes: list[int], chain: list[tuple[int, int]], skip: list[tuple[int, int]], rounds: int = 200, damp: float = 0.5, close: float = 1e-6) -> np.ndarray:
        """Marginals by loopy sum-product over any number of documents at once, until no message changes by more than ``close``."""
        node = np.array([self.unary.get(s, self.prior) for s in shapes]).reshape(-1, len(LABELS))
        edges = np.array([*chain, *skip], dtype=np.int64).reshape(-1, 2)
        if not len(edges):
            return np.exp(node - node.max(1, keepdims=True))
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        kind = np.tile(np.r_[np.zeros(len(chain), int), np.ones(len(skip), int)], 2)
        potential = np.exp(np.stack([self.chain, self.skip]))[kind]
        message = np.zeros((len(source), len(LABELS)))
        for _ in range(rounds):
            at = node + self._gather(target, message, len(node))
            out = at[source] - message[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.einsum("ei,eij->ej", out, potential))
            new -= new.max(1, keepdims=True)
            message, before = damp * message + (1 - damp) * new, message
            if np.abs(message - before).max() < close:
                break
        at = node + self._gather(target, message, len(node))
        at = np.exp(at - at.max(1, keepdims=True))
        return at

    @staticmethod
    def _gather(target: np.ndarray, message: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(target, message[:, k], n) for k in range(message.shape[1])], 1)


def _counts(batch_texts: list[str]) -> dict[tuple[str, int, int], int]:
    counts: dict[tuple[str, int, int], int] = {}
    for text in batch_texts:
        tokens, chain, skip = graph_of(text)
        if not tokens:
            continue
        labels = silver_labels(tokens, base_spans(text))
        keys = [("shape", shape, y) for (*_, shape), y in zip(tokens, labels, strict=True)]
        keys += [("chain", labels[a], labels[b]) for a, b in chain] + [("skip", labels[a], labels[b]) for a, b in skip]
        for key in keys:
            counts[key] = counts.get(key, 0) + 1
    return counts


def learn(docs: DataFrame, *, text_col: str = "text") -> SkipChain:
    """Fit the field on all documents; their fixed patterns stand in for labels.

    Tasks send counts by shape and label and by pairs of labels.  There are at most 2**19 shapes
    and 6 labels, so what reaches the driver is bounded whatever the corpus.  Null and empty texts hold no
    tokens, repeated texts count each time; an empty table gives a field that adds nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int, int], int] = {}
        for batch in batches:
            for key, n in _counts(batch.column("text").to_pylist()).items():
                total[key] = total.get(key, 0) + n
        columns = [[k[0] for k in total], [k[1] for k in total], [k[2] for k in total], list(total.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["which", "a", "b", "n"])

    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@+]"))
    rows = texts.mapInArrow(lean(count), "which string, a int, b int, n long").groupBy("which", "a", "b").agg(F.sum("n").alias("n")).collect()
    return SkipChain.fit([(r["which"], r["a"], r["b"], r["n"]) for r in rows])


def _covered(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Where spans lie, as starts and ends of stretches that do not overlap."""
    firsts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            firsts.append(a)
            ends.append(b)
    return firsts, ends


def added_spans(model: SkipChain, texts: list[str], bases: list[list[tuple[str, int, int]]], min_belief: float) -> list[list[tuple[str, int, int]]]:
    """What the field finds beside the base spans, for a batch of texts at once."""
    shapes, chain, skip, owners, placed = [], [], [], [], []
    for number, text in enumerate(texts):
        tokens, c, s = graph_of(text)
        n = len(shapes)
        shapes += [shape for *_, shape in tokens]
        chain += [(a + n, b + n) for a, b in c]
        skip += [(a + n, b + n) for a, b in s]
        owners += [number] * len(tokens)
        placed += [(a, b) for a, b, *_ in tokens]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not shapes:
        return out
    belief = model.beliefs(shapes, chain, skip)
    belief /= belief.sum(1, keepdims=True)
    best = belief.argmax(1)
    neighbours = {a for a, b in chain if b == a + 1}
    sure = np.flatnonzero((best > 0) & (belief.max(1) >= min_belief)).tolist()
    taken = [_covered(base) for base in bases]
    before = -2
    for k in sure:
        start, end = placed[k]
        firsts, ends = taken[owners[k]]
        at = bisect_left(firsts, end)  # the last covered stretch that begins before the token ends
        if at and ends[at - 1] > start:
            continue
        kind = LABELS[best[k]]
        own = out[owners[k]]
        if before == k - 1 and before in neighbours and own and own[-1][0] == kind and kind in ("card", "phone"):
            own[-1] = (kind, own[-1][1], end)
        else:
            own.append((kind, start, end))
        before = k
    return out


def find_pii(docs: DataFrame, *, model: SkipChain | None = None, id_col: str = "doc_id", text_col: str = "text", min_belief: float = 0.9) -> DataFrame:
    """Personal data in every whole text: spans of the fixed patterns and what the field adds.

    The field (see :func:`learn`) has a node for each token with a digit, an @ or a plus sign,
    edges between neighbours and from each token to the first similar one of the document; loopy
    message passing makes labels agree over a document.  A token that it labels with at least
    ``min_belief`` and that no base span overlaps is added.

    Secrets are found by the field alone: names of secrets before a value and public formats of keys label the tokens that it learns from, and a key that recurs
    without its name is met by its skip edge.

    Returns doc_id, base and added: arrays of (kind, start, end) in code points, end exclusive, in
    order of kind and start.  Null or empty text: no spans.  Repeated rows are each searched.
    Empty table: no rows.  Other columns are ignored.
    """
    model = model or learn(docs, text_col=text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column("text").to_pylist()
                bases = [base_spans(t) for t in texts]
                added = added_spans(model, texts, bases, min_belief)
                rows = lambda lists: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in sorted(x, key=lambda s: (KINDS.index(s[0]), s[1]))] for x in lists], span)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows(bases), rows(added)], names=["doc_id", "base", "added"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(lean(find), f"doc_id {id_type}, base {spans}, added {spans}")


def redact(docs: DataFrame, *, model: SkipChain | None = None, text_col: str = "text", min_belief: float = 0.9) -> DataFrame:
    """All rows and columns, with each span of personal data in ``text_col`` replaced by its kind, as [EMAIL].

    Overlapping spans become one, named after the first.  Null stays null.  Repeated rows are each redacted.  Empty table: no rows.
    """
    model = model or learn(docs, text_col=text_col)
    schema = docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.schema.get_field_index(text_col)
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(column).to_pylist()
                filled = [t or "" for t in texts]
                bases = [base_spans(t) for t in filled]
                out = []
                for text, base, added in zip(texts, bases, added_spans(model, filled, bases, min_belief), strict=True):
                    if text is None or not (base or added):
                        out.append(text)
                        continue
                    pieces, at = [], 0
                    for kind, a, b in sorted([*base, *added], key=lambda s: (s[1], -s[2])):
                        if a >= at:
                            pieces += [text[at:a], f"[{kind.upper()}]"]
                        at = max(at, b)
                    out.append("".join([*pieces, text[at:]]))
                columns = list(part.columns)
                columns[column] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(lean(clean), schema)
