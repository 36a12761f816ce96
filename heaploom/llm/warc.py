"""WARC archives: one gzip member per record, written and read back sequentially."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_path, sized

MIN_REVISIT_BYTES = 100
#: An archive that has reached this many bytes is closed and the next one begun.
ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 16
MAX_HEADER_BYTES = 1 << 20


class WarcError(ValueError):
    """The archive is not framed as WARC, or a digest does not fit."""


def plan_records(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES
) -> DataFrame:
    """Decide for each page whether its record is a response or a revisit of an equal payload.

    Among pages of equal payload of at least ``min_bytes`` bytes, that with the smallest id is the
    response (all rows of that id, if it is repeated); the others refer to it.  Null ids never
    are referred to unless no other id has the payload.  Null payload: empty.  Other columns
    are ignored.  The smallest id per payload is found by a map-side combined aggregate and only
    payloads that occur twice come back: broadcast if they are proven few, so that no page moves.
    """
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.col(body_col), F.lit("")).alias("html"),
    ).withColumns({"payload_digest": F.sha2("html", 256), "payload_bytes": F.octet_length("html").cast("long")})
    shared = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy(F.col("payload_digest").alias("shared_digest"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )
    shared = sized(shared.select("shared_digest", "first_id"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(shared, F.col("payload_digest") == F.col("shared_digest"), "left").select(
        "page_id", "url", "html", "payload_digest", "payload_bytes", F.when(revisit, F.col("first_id")).alias("refers_to")
    )


def _header_value(text: str) -> str:
    """Header values stay on one line."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id, url: str, html: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record.  A revisit carries no payload, only its digest and length."""
    revisit = refers_to is not None
    block = b"" if revisit else html
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_header_value(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Length: {len(html)}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_archives(records: DataFrame, folder: str, *, archive_bytes: int = ARCHIVE_BYTES, level: int = 1) -> DataFrame:
    """Write records (of :func:`plan_records`) as .warc.gz files below ``folder``, a URI all share.

    Each task streams its rows into files of its own, named by a random id, so a task that is
    run again leaves no half-written file in the result: only files of the attempt that ended
    well are listed.  Returns (path, records), already computed.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(folder)
        fs.create_dir(root, recursive=True)
        out, path, count, size, done = None, "", 0, 0, []
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload_digest", "refers_to")]
            html = batch.column("html").cast(pa.binary())
            for i in range(batch.num_rows):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, count, size = fs.open_output_stream(path, compression=None), 0, 0
                page_id, url, digest, refers = (c[i].as_py() for c in cols)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(page_id, url, html[i].as_py(), digest, refers)) + packer.flush()
                out.write(member)
                count, size = count + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"]
        )

    return cut(records.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(write, "path string, records long"))


class Member:
    """One gzip member, decompressed only as far as it is asked for."""

    def __init__(self, stream, data: bytes, chunk: int):
        self._stream, self._data, self._chunk = stream, data, chunk
        self._unpack, self._plain = zlib.decompressobj(31), b""

    def _more(self) -> bool:
        """Decompress a further piece of at most READ_BYTES; False at the end of the member."""
        while not self._unpack.eof:
            last = False
            if not self._data:
                self._data = self._stream.read(self._chunk)
                last = not self._data
            piece = self._unpack.decompress(self._data, READ_BYTES)
            self._data = self._unpack.unused_data if self._unpack.eof else self._unpack.unconsumed_tail
            if piece:
                self._plain += piece
                return True
            if last and not self._unpack.eof:
                raise WarcError("the last gzip member is cut off")
        return False

    def head(self) -> bytes:
        """What stands before the first empty line, which is taken too."""
        while (end := self._plain.find(b"\r\n\r\n")) < 0:
            if len(self._plain) > MAX_HEADER_BYTES or not self._more():
                raise WarcError("no WARC header")
        out, self._plain = self._plain[:end], self._plain[end + 4 :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self._plain and not self._more():
                raise WarcError("Content-Length does not fit the record")
            piece, self._plain = self._plain[:n], self._plain[n:]
            n -= len(piece)
            yield piece

    def finish(self) -> bytes:
        """Check that the record ends here; what the stream has given of the next member."""
        while len(self._plain) <= 4 and self._more():
            pass
        if self._plain != b"\r\n\r\n":
            raise WarcError("Content-Length does not fit the record")
        return self._data


def _headers(raw: bytes) -> dict[str, str]:
    """Header lines by name in lower case; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    name = None
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] = f"{out[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"bad header line {line[:80]!r}")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def digest_fits(labelled: str | None, content: bytes) -> bool | None:
    """Whether ``algorithm:digest``, in hexadecimal or base32, is that of the bytes; None if there is none to check."""
    algorithm, colon, value = (labelled or "").partition(":")
    try:
        found = hashlib.new(algorithm.strip().lower().replace("-", "")) if colon else None
    except ValueError:
        found = None
    if found is None:
        return None
    found.update(content)
    value = value.strip()
    return value.lower() == found.hexdigest() or value.upper().rstrip("=") == base64.b32encode(found.digest()).decode().rstrip("=")


def read_records(stream, chunk: int = READ_BYTES) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of an archive's records, one gzip member each, in the order of the file.

    The header is bounded, the block is framed by its Content-Length while the member is decompressed, and
    block and payload digests are verified where they are given in an algorithm that hashlib has.  The payload
    of an HTTP message is its body as it was sent; of all other records it is the block.
    """
    data = stream.read(chunk)
    while data:
        member = Member(stream, data, chunk)
        head = member.head()
        if not head.startswith(b"WARC/"):
            raise WarcError("no WARC header")
        headers = _headers(head)
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError):
            raise WarcError("no usable Content-Length") from None
        if length < 0:
            raise WarcError("no usable Content-Length")
        block = b"".join(member.take(length))
        data = member.finish() or stream.read(chunk)
        if digest_fits(headers.get("warc-block-digest"), block) is False:
            raise WarcError("block digest does not fit")
        payload = block
        if headers.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        # The digest of a revisit is that of the payload it leaves out.
        if headers.get("warc-type") != "revisit" and digest_fits(headers.get("warc-payload-digest"), payload) is False:
            raise WarcError("payload digest does not fit")
        yield headers, payload


def _page_of(urn: str) -> str:
    return urn[len("<urn:page:") : -1] if urn.startswith("<urn:page:") else urn


def read_archives(paths: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """Read the listed archives back, one row per record.

    One task streams one file at a time in pieces of 64 KB and holds one record.  A file that
    is cut off, misframed or of a wrong digest raises :class:`WarcError`.  Archives of other
    writers are read as well: records of every type, HTTP messages, digests of other algorithms and missing ones.

    Returns page_id (as text; the record's id where it is not one of ours, null if empty), url (null if none),
    record_type, payload_bytes (of a revisit null if not stated), payload_digest (bare SHA-256 of the payload; of a revisit
    as stated there, with its algorithm if that is another), refers_to (as text, null if none) and, if asked
    for, payload (null for revisits).  No files: no rows.
    """

    schema = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string"
    schema += ", payload binary" if with_payload else ""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _open_fs(folder)
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
        rows, held = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_stream(path, compression=None) as stream:
                    for headers, payload in read_records(stream):
                        kind = headers.get("warc-type")
                        revisit = kind == "revisit"
                        stated = headers.get("warc-payload-length")
                        row = [
                            _page_of(headers.get("warc-record-id", "")) or None,
                            headers.get("warc-target-uri"),
                            kind,
                            (int(stated) if stated else None) if revisit else len(payload),
                            headers.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
                            _page_of(headers["warc-refers-to"]) if "warc-refers-to" in headers else None,
                        ]
                        rows.append(row + ([None if revisit else payload] if with_payload else []))
                        held += len(payload) if with_payload else 0
                        if len(rows) >= 10_000 or held > 32 << 20:
                            yield pack()
                            rows, held = [], 0
        if rows:
            yield pack()

    n = max(1, paths.count())
    return paths.select("path").repartition(n).mapInArrow(read, schema)


def round_trip(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write every page as a WARC record and return what a reader finds in the archives.

    Empty table: no archives, no rows.  See :func:`plan_records` for nulls, copies and ties.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    id_type = pages.schema[columns.get("id_col", "page_id")].dataType.simpleString()
    back = read_archives(write_archives(plan_records(pages, **columns), folder), folder)
    return back.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})
