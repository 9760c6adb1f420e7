"""WARC archives: written by tasks, read back by a sequential reader.

An archive is a file of gzip members, one per record. Each writing task fills
archives up to a size and reports them; only the archives that successful
tasks report are read, so a lost or repeated task leaves at most an unused
file. The reader feeds fixed chunks to one zlib decompressor per member,
frames each block by its Content-Length and checks block and payload digests
while the bytes pass, so a record of any size needs the memory of a chunk
(and of the payload only if the caller wants it).

Of pages with equal payloads of at least ``min_bytes``, the one of the largest page id
is a response and the others are revisits that name it; rows that repeat both
page id and payload are responses each. A null html is an empty payload, a
null page id sorts below all others and is left out of the record. Header
values are percent-encoded, so no url can break a record. Extra columns are
not archived. An empty table has no archives and no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from riskframe.llm.common import col, materialize
from riskframe.session import checkpoint_path

ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_uri(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def _field(value: str) -> str:
    """A header value: printable ASCII but blank and percent as it is, all else percent-encoded."""
    return quote(value, safe="!\"#$&'()*+,/:;<=>?@[]^_`{|}~-.")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One whole record as a gzip member. A revisit has the HTTP head without the payload."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = head if refers_to is not None else head + payload
    lines = [VERSION, f"WARC-Type: {RESPONSE if refers_to is None else REVISIT}",
             f"WARC-Record-ID: {f'<urn:uuid:{uuid.uuid4()}>' if page_id is None else record_uri(page_id)}",
             f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_field(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(hashlib.sha1(payload).digest())}",
              f"WARC-Block-Digest: sha1:{base32_sha1(hashlib.sha1(block).digest())}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Record(NamedTuple):
    headers: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


class WarcError(ValueError):
    """A record that is cut short, badly framed or does not match its digest."""


class _Members:
    """The decompressed bytes of a stream's gzip members, one member at a time."""

    def __init__(self, stream):
        self.stream, self.rest = stream, b""

    def open(self) -> bool:
        """Starts the next member; False at the end of the file."""
        if not self.rest:
            self.rest = self.stream.read(CHUNK)
        self.unpacker, self.plain = zlib.decompressobj(31), b""
        return bool(self.rest)

    def more(self) -> bytes:
        """Some more bytes of this member, or b'' at its end."""
        while not self.unpacker.eof:
            data = self.unpacker.unconsumed_tail or self.rest or self.stream.read(CHUNK)
            if data is self.rest:
                self.rest = b""
            if not data:
                raise WarcError("a gzip member is cut short")
            try:
                got = self.unpacker.decompress(data, CHUNK)
            except zlib.error as e:
                raise WarcError(f"not a gzip member: {e}") from None
            if self.unpacker.eof:
                self.rest = self.unpacker.unused_data + self.rest
            if got:
                return got
        return b""

    def until(self, mark: bytes) -> bytes:
        """The bytes up to and with ``mark``."""
        while (at := self.plain.find(mark)) < 0:
            got = self.more()
            if not got:
                raise WarcError("a record head is cut short")
            self.plain += got
        out, self.plain = self.plain[:at + len(mark)], self.plain[at + len(mark):]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in chunks."""
        while n:
            if not self.plain:
                self.plain = self.more()
                if not self.plain:
                    raise WarcError("a block is shorter than its Content-Length")
            out, self.plain = self.plain[:n], self.plain[n:]
            n -= len(out)
            yield out


def read_records(stream, with_payload: bool = False) -> Iterator[Record]:
    """The records of an archive in order. Raises WarcError for a bad one."""
    members = _Members(stream)
    while members.open():
        lines = members.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError(f"not a record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        yield _read_block(members, headers, with_payload)
        if b"".join(members.take(4)) != b"\r\n\r\n" or members.more():
            raise WarcError("a record is longer than its Content-Length")


def _read_block(members: _Members, headers: dict[str, str], with_payload: bool) -> Record:
    whole, body, size, kept, head = hashlib.sha1(), hashlib.sha1(), 0, [], b""
    inside = False  # past the HTTP head
    try:
        length = int(headers["content-length"])
    except (KeyError, ValueError):
        raise WarcError("a record without Content-Length") from None
    for chunk in members.take(length):
        whole.update(chunk)
        if not inside:
            head += chunk
            at = head.find(b"\r\n\r\n")
            if at < 0:
                continue
            inside, chunk, head = True, head[at + 4:], head[:at]
        body.update(chunk)
        size += len(chunk)
        if with_payload:
            kept.append(chunk)
    if headers.get("warc-block-digest", "").removeprefix("sha1:") != base32_sha1(whole.digest()):
        raise WarcError("a block does not match its digest")
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers.get("warc-type") == REVISIT:
        for line in head.decode("latin-1").split("\r\n"):
            name, _, value = line.partition(":")
            if name.lower() == "content-length":
                size = int(value)
        return Record(headers, size, stated, None)
    if stated != base32_sha1(body.digest()):
        raise WarcError("a payload does not match its digest")
    return Record(headers, size, stated, b"".join(kept) if with_payload else None)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is null for responses. Payloads
    that repeat are counted by digest before anything is joined."""
    p = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"),
                     F.coalesce(col(html_col).cast("string"), F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= min_bytes, F.sha1(F.col("html").cast("binary")))
    copies = (p.select(digest.alias("digest"), "page_id").groupBy("digest")
              .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last"))
    joined = p.withColumn("digest", digest).join(copies, "digest", "left")
    return joined.select("page_id", "url", "html",
                         F.when(F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
                         .alias("refers_to"))


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes (page_id, url, html, refers_to) rows as archives in ``folder``, which
    all executors must reach, and returns (path, records, bytes) of each one
    written by a successful task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        out, done, count, size = None, [], 0, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*batch.columns, strict=True):
                if out is None:
                    store.create_dir(root)
                    path = f"{root}/{name}-{len(done):04d}.warc.gz"
                    # Compression is the record's own; the name must not add another.
                    out = store.open_output_stream(path, compression=None)
                data = record_bytes(page_id.as_py(), url.as_py(), html.as_py(), refers_to.as_py(), date)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((f"{folder}/{path.rpartition('/')[2]}", count, size))
                    out, count, size = None, 0, 0
        if out is not None:
            out.close()
            done.append((f"{folder}/{path.rpartition('/')[2]}", count, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                          pa.array([d[1] for d in done], pa.int64()),
                                          pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    rows = records.select("page_id", "url", F.col("html").cast("binary").alias("html"), "refers_to")
    return materialize(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


READ = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
        "payload binary")


def read_archives(archives: DataFrame, with_payload: bool = False, rows_at_once: int = 256) -> DataFrame:
    """One row per record of the archives named in column ``path``. Each archive is read by one task, in order."""

    def page_of(uri: str | None) -> int | None:
        return int(uri[10:-1]) if uri and uri.startswith("<urn:page:") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(place, compression=None) as stream:
                    for r in read_records(stream, with_payload):
                        url = r.headers.get("warc-target-uri")
                        rows.append((page_of(r.headers.get("warc-record-id")), None if url is None else unquote(url),
                                     r.headers.get("warc-type"), page_of(r.headers.get("warc-refers-to")),
                                     r.payload_bytes, r.payload_digest, r.payload))
                        held += len(r.payload or b"")
                        if len(rows) >= rows_at_once or held >= 16 * CHUNK:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return archives.select("path").mapInArrow(run, READ)


def archive_round_trip(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Writes every page as a record and reads the archives back: (page_id,
    payload_bytes, payload_digest, record_type, refers_to, url)."""
    folder = checkpoint_path(spark, f"llm-{uuid.uuid4().hex}/warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    archives = write_archives(mark_revisits(pages), folder)
    # One archive a task: the list of archives is short rows, dealt out evenly.
    back = read_archives(archives.repartition(max(1, archives.count()), "path"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
