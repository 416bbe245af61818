"""WARC archives by way of a chunked record table: payloads travel as rows of (record, chunk number, bytes), never whole.

Writing: payloads are cut into chunks inside the scan; a pass over the chunk rows carries the running digests of each record, so
that its last chunk knows the digests and the size of the whole. Grouping these last rows by digest decides which record holds a
payload and which ones revisit it. One shuffle brings each record's decision and its chunks together in order, and every task
streams them into archive files (one gzip member a record), which a manifest lists.

Reading: every archive is streamed by one task, header by header, into the same kind of table, digests again carried along.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.common import bound_batches, stored
from footfall.session import scratch_path

#: Bytes of one chunk, of an archive after which the next one is begun, and of the longest header block that is read.
CHUNK_BYTES, ARCHIVE_BYTES, HEADER_BYTES = 64 << 10, 256 << 20, 1 << 20
#: Chunks that one task hands on at once.
BATCH_CHUNKS = 64
DATE = "2024-01-01T00:00:00Z"

# fixed values of the WARC 1.1 and HTTP formats
VERSION, BREAK = b"WARC/1.1", b"\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"

CHUNKS = "row long, id long, url string, chunk long, last boolean, bytes binary, total long, sha1 string, sha256 string"
RECORDS = ("archive string, offset long, record_id string, record_type string, url string, id long, refers_to long, refers_to_record string, "
           "chunk long, last boolean, bytes binary, total long, digest string, stated_digest string, payload_bytes long")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(f.split() for f in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _batched(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_CHUNKS:
            yield _table(held, schema)
            held = []
    yield _table(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time; the bytes of one are out of use when the next is asked for."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(names)}


# --- writing


def chunk_rows(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of a table of pages, stored: row, id, url, chunk, last, bytes, total, sha1, sha256.

    ``total`` and the digests are those of the payload up to and including the chunk, so the last chunk carries the whole's; a
    null payload is an empty one and has one empty chunk. Every row of ``pages``, repeated ones too, is a record of its own.
    """
    bound_batches(pages.sparkSession)
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    size = F.octet_length("payload")
    pages = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    last = F.greatest(F.ceil(size / chunk_bytes) - 1, F.lit(0))
    cut = pages.select("*", last.alias("last_chunk"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    cut = cut.select("row", "id", "url", "chunk", (F.col("chunk") == F.col("last_chunk")).alias("last"),
                     F.substring("payload", F.col("chunk").cast("int") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("bytes"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            total, sha1, sha256 = 0, hashlib.sha1(), hashlib.sha256()
            for r in _rows(batches):
                if r["chunk"] == 0:
                    total, sha1, sha256 = 0, hashlib.sha1(), hashlib.sha256()
                total += len(r["bytes"])
                sha1.update(r["bytes"])
                sha256.update(r["bytes"])
                # digest() leaves the running state as it is
                yield (r["row"], r["id"], r["url"], r["chunk"], r["last"], r["bytes"], total, base32(sha1.digest()), sha256.hexdigest())
        return _batched(rows(), CHUNKS)

    return stored(cut.mapInArrow(digested, CHUNKS), "chunks", "zstd")


def _order() -> Column:
    """Least id first, null ids last, then the row."""
    return F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))


def decisions(chunks: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(row, first_row, first_id, first_url) of every record whose payload another record holds.

    Payloads are equal if their SHA-256 and size are. Of equal ones of ``least_bytes`` or more the record with the smallest id
    holds the payload (null ids after all others, among equal ids the first row).
    """
    whole = chunks.filter("last").select("row", "id", "url", "total", "sha256").filter(F.col("total") >= least_bytes)
    # grouped and stored before the join back: a payload with very many copies meets partial sums and a table that can be split
    groups = whole.groupBy("sha256", "total").agg(F.count("*").alias("n"), F.min_by(F.struct("row", "id", "url"), _order()).alias("first"))
    groups = stored(groups.filter("n > 1").select("sha256", "total", "first"), "equal_payloads")
    return (whole.drop("id", "url").join(groups, ["sha256", "total"]).filter(F.col("row") != F.col("first.row"))
            .select("row", F.col("first.row").alias("first_row"), F.col("first.id").alias("first_id"), F.col("first.url").alias("first_url")))


def _clean(value: str) -> str:
    """A header value on one line: control characters and spaces of a target are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _target(url: str | None, row: int) -> str:
    return _clean(url) if url else f"urn:row:{row}"


@dataclass
class Archive:
    """Archive files of one task, begun anew beyond a size. Names hold a random part, so another attempt never writes into them."""

    folder: str
    run: str
    limit: int
    number: int = 0
    done: list[tuple[str, int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.files, self.base = pa.fs.FileSystem.from_uri(self.folder)
        self.attempt, self.sink, self.records = uuid.uuid4().hex, None, 0

    def begin(self) -> None:
        if self.sink is not None and self.sink.tell() >= self.limit:
            self.close()
        if self.sink is None:
            self.name = f"{self.folder}/{self.attempt}-{self.number:05d}.warc.gz"
            self.sink = self.files.open_output_stream(f"{self.base}/{self.attempt}-{self.number:05d}.warc.gz", compression=None)
            self.number += 1
            self.member(_header({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields", "Content-Length": "29"}))
            self.write(b"format: WARC File Format 1.1\n")
            self.end()

    def member(self, data: bytes) -> None:
        self.packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        self.write(data)

    def write(self, data: bytes) -> None:
        self.sink.write(self.packer.compress(data))

    def end(self) -> None:
        self.write(BREAK + BREAK)
        self.sink.write(self.packer.flush())

    def close(self) -> None:
        if self.sink is not None:
            self.done.append((self.name, self.sink.tell(), self.records))
            self.sink.close()
            self.sink, self.records = None, 0


def _header(fields: dict[str, str | None]) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields.items() if v is not None)]
    return BREAK.join(lines) + BREAK + BREAK


def _record_id(run: str, row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(uuid.UUID(run).int >> 64 << 64) | row)}>"


def _begin_record(archive: Archive, r: dict) -> bool:
    """Write the headers of a record, whose size and digest its decision row carries; true if its payload follows."""
    http = BREAK.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % r["total"]]) + BREAK + BREAK
    held = r["first_row"] is None
    fields = {"WARC-Type": "response" if held else "revisit", "WARC-Record-ID": _record_id(archive.run, r["row"]), "WARC-Date": DATE,
              "WARC-Target-URI": _target(r["url"], r["row"]), "WARC-Payload-Digest": f"sha1:{r['sha1']}", "Content-Type": HTTP_TYPE,
              "Page-Id": None if r["id"] is None else str(r["id"])}
    if not held:
        fields |= {"WARC-Profile": IDENTICAL, "WARC-Refers-To": _record_id(archive.run, r["first_row"]),
                   "WARC-Refers-To-Target-URI": _target(r["first_url"], r["first_row"]), "WARC-Refers-To-Date": DATE,
                   "Refers-To-Page-Id": None if r["first_id"] is None else str(r["first_id"])}
    fields["Content-Length"] = str(len(http) + (r["total"] if held else 0))
    archive.begin()
    archive.records += 1
    archive.member(_header(fields) + http)
    return held


def write_archives(pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html",
                   least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every row of ``pages`` as a WARC record and return the manifest: archive, bytes, records.

    Of records with equal payloads of ``least_bytes`` or more one is a response and the others are revisits of it
    (``decisions``); smaller ones are all responses. ``folder`` is a place every executor can write to, by default one in the
    shared folder. Only archives in the manifest count: files of attempts that were lost or repeated are not listed there.
    Null payloads are empty, null URLs become ``urn:row:`` names, null ids leave out their header field; other columns, whatever
    their names, are not written. An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    folder, run = (folder or scratch_path(spark, "archives")).rstrip("/"), uuid.uuid4().hex
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    chunks = chunk_rows(pages, id_column, url_column, payload_column, chunk_bytes)
    known = stored(chunks.filter("last").select("row", "id", "url", "total", "sha1").join(decisions(chunks, least_bytes), "row", "left"), "decisions")
    # a record's decision sorts before its chunks; the writer passes over payloads that others hold
    heads = known.select("row", F.lit(-1).cast("long").alias("chunk"), "id", "url", "total", "sha1", "first_row", "first_id", "first_url", F.lit(None).cast("binary").alias("bytes"))
    bodies = chunks.select("row", "chunk", "bytes")
    parts = heads.unionByName(bodies, allowMissingColumns=True).repartition("row").sortWithinPartitions("row", "chunk")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, open_record, held = Archive(folder, run, archive_bytes), False, False
        archive.files.create_dir(archive.base, recursive=True)
        for r in _rows(batches):
            if r["chunk"] < 0:
                if open_record:
                    archive.end()
                held, open_record = _begin_record(archive, r), True
            elif held:
                archive.write(r["bytes"])
        if open_record:
            archive.end()
        archive.close()
        yield _table(archive.done, "archive string, bytes long, records long")

    return stored(parts.mapInArrow(write, "archive string, bytes long, records long"), "manifest")


# --- reading


class _Stream:
    """A plain or gzip-compressed archive, read forward in bounded steps."""

    def __init__(self, raw):
        self.raw = io.BufferedReader(raw, 1 << 20) if isinstance(raw, io.RawIOBase) else raw
        start = self.raw.peek(2)[:2]
        self.data = gzip.GzipFile(fileobj=self.raw) if start == b"\x1f\x8b" else self.raw
        self.offset = 0

    def line(self) -> bytes:
        line = self.data.readline(HEADER_BYTES)
        self.offset += len(line)
        return line

    def read(self, n: int) -> bytes:
        got = self.data.read(n)
        self.offset += len(got)
        return got


class _Raw(io.RawIOBase):
    """An Arrow input stream as a raw Python stream."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self):
        return True

    def readinto(self, buffer):
        got = self.stream.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)


def _fields(stream: _Stream, where: str) -> dict[str, str]:
    """Header fields up to the empty line, names in lower case; folded lines are joined."""
    found, name, size = {}, None, 0
    while True:
        line = stream.line()
        size += len(line)
        if not line or size > HEADER_BYTES:
            raise ValueError(f"{where}: the header does not end")
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if not text:
            return found
        if text[0] in " \t" and name:
            found[name] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()


def _payload_start(stream: _Stream, left: int) -> tuple[dict[str, str], bytes, int]:
    """Skip the HTTP header of a block: (its fields, bytes that turned out to be payload, bytes left). Blocks without one are all payload."""
    head, fields = b"", {}
    while left:
        line = stream.data.readline(min(left, HEADER_BYTES))
        stream.offset += len(line)
        left -= len(line)
        if not line:
            break
        head += line
        if not head.startswith(b"HTTP/"):
            return {}, head, left
        if line in (b"\r\n", b"\n"):
            return fields, b"", left
        if len(head) > HEADER_BYTES:
            return {}, head, left
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, b"", left


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def records(raw, name: str, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """The chunk rows (``RECORDS``) of one archive, held a chunk at a time. ``offset`` counts uncompressed bytes."""
    stream = _Stream(raw)
    while True:
        offset, line = stream.offset, stream.line()
        if not line:
            return
        if not line.strip():
            continue
        where = f"{name} at {offset}"
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{where}: no record begins here")
        h = _fields(stream, where)
        left = _number(h.get("content-length"))
        if left is None or left < 0:
            raise ValueError(f"{where}: no length")
        kind, stated = h.get("warc-type", ""), h.get("warc-payload-digest", "").rpartition(":")[2] or None
        http, pending = {}, b""
        if h.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
            http, pending, left = _payload_start(stream, left)
        fixed = (name, offset, h.get("warc-record-id"), kind, h.get("warc-target-uri"), _number(h.get("page-id")), _number(h.get("refers-to-page-id")), h.get("warc-refers-to"))
        size = _number(http.get("content-length")) if kind == "revisit" else None
        chunk, total, sha1 = 0, 0, hashlib.sha1()
        while True:
            while left and len(pending) < chunk_bytes:
                got = stream.read(min(left, chunk_bytes - len(pending)))
                if not got:
                    raise ValueError(f"{where}: the archive ends inside a record")
                left -= len(got)
                pending += got
            part, pending = pending[:chunk_bytes], pending[chunk_bytes:]
            last = not left and not pending
            total += len(part)
            sha1.update(part)
            yield (*fixed, chunk, last, part, total, base32(sha1.digest()), stated, (size if kind == "revisit" else total) if last else None)
            if last:
                break
            chunk += 1


def read_archives(spark: SparkSession, archives: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives named in the column ``archive``, plain or gzip-compressed, of any writer.

    One row per chunk (``RECORDS``); ``digest`` and ``total`` are those of the payload up to and including the chunk, and
    ``payload_bytes``, on the last chunk, is the size of the whole payload (that of a revisit as its HTTP header tells it, null
    without one). The payload of an HTTP block is what follows its header, that of any other record its whole block. Records of
    all types come through; an empty one has one empty chunk. A broken archive raises an error that names file and place.
    """
    bound_batches(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for r in _rows(batches):
                files, path = pa.fs.FileSystem.from_uri(r["archive"])
                with files.open_input_stream(path, compression=None) as raw:
                    yield from records(_Raw(raw), r["archive"], chunk_bytes)
        return _batched(rows(), RECORDS)

    # archives are large: one a task, however few bytes their names are
    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(read, RECORDS)


def digest(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write pages as archives, read these back and give one row per page: id, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is that of the payload as read; a revisit holds none, so its digest is the stated one.
    """
    spark = pages.sparkSession
    found = read_archives(spark, write_archives(pages, None, id_column, url_column, payload_column, least_bytes))
    found = found.filter("last").filter(F.col("record_type").isin("response", "revisit"))
    return found.select(F.col("id").alias(id_column), "payload_bytes",
                        F.when(F.col("record_type") == "response", F.col("digest")).otherwise(F.col("stated_digest")).alias("payload_digest"),
                        "record_type", "refers_to")
