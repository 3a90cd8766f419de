"""WARC archives as a chunked record table: pages are written to archives, and archives are read back, in chunks.

A payload is never held whole outside the row that it comes from: it travels as rows (record, chunk number,
data) of at most CHUNK bytes, and every chunk row that is read carries the number of bytes and the digest
of its payload so far. The last chunk of a record has both for the whole payload.

Writing: equal payloads of at least ``least_bytes`` bytes are found by length, SHA-1 and SHA-256; that with the
smallest id becomes a response, the others revisit it and carry no payload. A group of copies is counted before
it is shuffled, and the rows meet their group's first id in a plain join, which AQE broadcasts or splits by
size. Each task streams its rows into archives of its own, one gzip member a record, and returns one manifest row for each
file that it closed, so files of lost attempts are never listed. Reading deals the listed files to tasks.

Archives are written and read by the workers through ``pyarrow.fs``, as Spark has no sink for raw bytes: ``folder`` must be
shared and of a kind that it knows (file, hdfs, s3, gs, abfs).

Defined cases: a null payload is empty; records of rows that repeat the least id of a group are all responses; a null id
comes after all others, and is read back as null; a null uri is written as the record's id; an
empty table gives no archives and no records; other columns are ignored. A record that ends early, or whose
payload doesn't match its digest, is read with ``intact`` false.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.ragged import map_batches
from lamina.session import stage, staging_dir

CHUNK = 1 << 18
FILE_BYTES = 1 << 30
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
URN, NO_ID = "urn:row:", "urn:row-without-id"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Batches of chunk rows stay within this many rows, and so within this many CHUNKs.
BATCH_ROWS = 64

MANIFEST = "file string, records long, payload_bytes long"
CHUNKS = (
    "file string, record long, record_id string, record_type string, uri string, refers_to string, "
    "declared_digest string, chunk long, data binary, bytes_so_far long, digest_so_far string, last boolean, intact boolean"
)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for archives in the staging folder."""
    return f"{staging_dir(spark)}/lamina/warc-{uuid.uuid4().hex}"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_plan(pages: DataFrame, payload: str, id_col: str, uri: str, least_bytes: int) -> DataFrame:
    """(_id, _uri, _data, _bytes, _sha1, _refers, _revisit) of every row; revisits have no data."""
    rows = pages.select(
        F.col(id_col).alias("_id"),
        F.col(uri).cast("string").alias("_uri"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("_data"),
    ).select("*", F.length("_data").cast("long").alias("_bytes"), F.sha1("_data").alias("_sha1"), F.sha2("_data", 256).alias("_sha256"))
    keys = ["_bytes", "_sha1", "_sha256"]
    groups = (
        rows.where(F.col("_bytes") >= least_bytes)
        .groupBy(keys)
        .agg(F.count("*").alias("_many"), F.min("_id").alias("_refers"))
        .where("_many > 1")
    )
    joined = rows.join(stage(groups.drop("_many"), "warc-groups"), keys, "left")
    revisit = F.col("_refers").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_refers"))
    return joined.withColumn("_revisit", revisit).withColumn("_data", F.when(revisit, F.lit(b"")).otherwise(F.col("_data")))


def chunked(rows: DataFrame, data: str = "_data", size: int = CHUNK) -> DataFrame:
    """A row for each chunk of ``data``, in order and side by side, with its number and whether it is the last."""
    last = F.greatest(F.floor((F.length(data) - 1) / size), F.lit(0))
    numbered = rows.withColumn("_last", last).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), "_last")))
    piece = F.substring(F.col(data), (F.col("_chunk") * size + 1).cast("int"), F.lit(size))
    return numbered.withColumns({data: piece, "_last": F.col("_chunk") == F.col("_last")})


def _named(id_: object) -> str:
    return f"<{NO_ID}>" if id_ is None else f"<{URN}{quote(str(id_), safe='')}>"


class _Writer:
    """Archives of one task; each record is a gzip member."""

    def __init__(self, folder: str, file_bytes: int):
        self.store, self.at = fs.FileSystem.from_uri(folder)
        self.folder, self.file_bytes = folder.rstrip("/"), file_bytes
        self.out, self.digest, self.closed = None, None, []

    def _open(self) -> None:
        self.store.create_dir(self.at, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.out = self.store.open_output_stream(f"{self.at}/{self.name}", compression=None)
        self.records = self.bytes = 0
        info = b"software: lamina\r\nformat: WARC File Format 1.1\r\n"
        self._begin({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"}, b"", len(info))
        self.chunk(info, True)
        self.records = 0

    def _begin(self, fields: dict[str, str], http: bytes, length: int) -> None:
        head = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "WARC-Date": DATE, "Content-Length": len(http) + length}.items())
        self.gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.out.write(self.gz.compress(f"WARC/1.1\r\n{head}\r\n".encode() + http))
        self.digest = hashlib.sha1()
        self.records += 1

    def begin(self, id_: object, uri: str | None, length: int, sha1: str, revisit: bool, refers: object) -> None:
        if self.out is None:
            self._open()
        named = _named(id_)
        fields = {
            "WARC-Type": "revisit" if revisit else "response",
            "WARC-Record-ID": named,
            "WARC-Target-URI": named[1:-1] if uri is None else quote(uri, safe="%/:=&?~#+!$,;'@()*[]"),
            "WARC-Payload-Digest": "sha1:" + base32(bytes.fromhex(sha1)),
            "Content-Type": "application/http; msgtype=response",
        }
        if revisit:
            self._begin({**fields, "WARC-Profile": PROFILE, "WARC-Refers-To": _named(refers)}, b"", 0)
            self.due = None
        else:
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n"
            self._begin(fields, http.encode(), length)
            self.due = sha1

    def chunk(self, data: bytes, last: bool) -> None:
        self.digest.update(data)
        self.bytes += len(data)
        self.out.write(self.gz.compress(data))
        if last:
            self.out.write(self.gz.compress(b"\r\n\r\n") + self.gz.flush())
            if getattr(self, "due", None) not in (None, self.digest.hexdigest()):
                raise ValueError("chunks of a record don't make up its payload")
            if self.out.tell() >= self.file_bytes:
                self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.closed.append((f"{self.folder}/{self.name}", self.records, self.bytes))
            self.out = self.due = None


def write(
    pages: DataFrame, folder: str, payload: str = "html", id_col: str = "page_id", uri: str = "url",
    least_bytes: int = 0, chunk_bytes: int = CHUNK, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record for each row to archives in ``folder``; the manifest (file, records, payload_bytes)."""
    rows = chunked(record_plan(pages, payload, id_col, uri, least_bytes), size=chunk_bytes)
    rows = rows.select("_id", "_uri", "_bytes", "_sha1", "_revisit", "_refers", "_chunk", "_data", "_last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, file_bytes)
        for batch in batches:
            fields = batch.columns
            for some in range(0, batch.num_rows, BATCH_ROWS):  # as Python values, some at a time
                part = [c.slice(some, BATCH_ROWS).to_pylist() for c in fields]
                for id_, uri_, size, sha1, revisit, refers, number, data, last in zip(*part, strict=True):
                    if number == 0:
                        writer.begin(id_, uri_, size, sha1, revisit, refers)
                    writer.chunk(data, last)
        writer.close()
        if writer.closed:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*writer.closed, strict=True)], ["file", "records", "payload_bytes"])

    return stage(map_batches(rows, run, MANIFEST), "warc-manifest")


def _head(source: io.BufferedReader) -> dict[str, str] | None:
    """Fields of the next record, by lower-case name; None at the end."""
    line = source.readline()
    while line in (b"\r\n", b"\n"):
        line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins at {line[:40]!r}")
    fields, name = {}, ""
    while (line := source.readline()) not in (b"\r\n", b"\n", b""):
        if line[:1] in b" \t" and name:
            fields[name] += " " + line.strip().decode("utf-8", "replace")
        else:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def _http_head(source: io.BufferedReader, length: int) -> int:
    """Skip the head of an http message; its bytes."""
    used = 0
    while used < length:
        line = source.readline(length - used)
        used += len(line)
        if line in (b"\r\n", b"\n", b""):
            break
    return used


def _records(name: str, source: io.BufferedReader, chunk_bytes: int, payload: bool) -> Iterator[tuple]:
    """Chunk rows of one archive."""
    number = 0
    while (fields := _head(source)) is not None:
        left = int(fields.get("content-length", 0))
        kind = fields.get("warc-type", "")
        if kind == "response" and fields.get("content-type", "").startswith("application/http"):
            left -= _http_head(source, left)
        declared = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        fixed = (
            name, number, fields.get("warc-record-id", "").strip("<>"), kind, fields.get("warc-target-uri"),
            fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, declared,
        )
        digest, done, chunk, complete = hashlib.sha1(), 0, 0, True
        while True:
            data = source.read(min(left - done, chunk_bytes)) if left > done else b""
            complete = bool(data) or left == done
            digest.update(data)
            done += len(data)
            last = done == left or not complete
            so_far = base32(digest.digest())
            sound = complete and (kind != "response" or declared in (None, so_far)) if last else None
            if payload or last:
                yield (*fixed, chunk, data if payload else None, done, so_far, last, sound)
            chunk += 1
            if last:
                break
        number += 1


def _opened(file: str) -> io.BufferedReader:
    store, at = fs.FileSystem.from_uri(file)
    raw = store.open_input_stream(at, compression=None)
    held = io.BufferedReader(raw, 1 << 20)
    return io.BufferedReader(gzip.GzipFile(fileobj=held), 1 << 18) if held.peek(2)[:2] == b"\x1f\x8b" else held


def read(files: DataFrame, chunk_bytes: int = CHUNK, payload: bool = True) -> DataFrame:
    """Chunk rows of the archives named by ``files.file``, plain or in gzip members; a task reads some files.

    Without ``payload``, only the last chunk of each record is given, without its data.
    """
    names = files.sparkSession.createDataFrame([], CHUNKS).columns
    schema = pa.schema([(n, t) for n, t in zip(names, _ARROW, strict=True)])
    most = BATCH_ROWS if payload else 4096

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with _opened(name) as source:
                    held: list[tuple] = []
                    for row in _records(name, source, chunk_bytes, payload):
                        held.append(row)
                        if len(held) == most:
                            yield _batch(held, schema)
                            held = []
                    if held:
                        yield _batch(held, schema)

    listed = files.select("file")
    spread = listed.repartition(max(1, listed.count()))  # by number: tiny rows that stand for large files
    return map_batches(spread, run, CHUNKS)


_ARROW = [
    pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(),
    pa.int64(), pa.string(), pa.bool_(), pa.bool_(),
]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _id_of(urn: str, kind: str) -> Column:
    given = F.when(F.col(urn).startswith(URN), F.url_decode(F.substring(F.col(urn), F.lit(len(URN) + 1), F.length(urn))))
    return given.cast(kind)


def records(chunks: DataFrame, id_type: str = "long") -> DataFrame:
    """(id, record_type, uri, refers_to, payload_bytes, payload_digest, intact) of responses and revisits.

    Length and digest of a revisit are those of the full payload: its digest is declared, its length is that of the record
    it refers to (null where that is in none of the archives).
    """
    whole = stage(chunks.where("last and record_type in ('response', 'revisit')").drop("data"), "warc-records")
    revisit = F.col("record_type") == "revisit"
    full = whole.where(~revisit).groupBy(F.col("record_id").alias("refers_to")).agg(F.max("bytes_so_far").alias("_full"))
    return whole.join(full, "refers_to", "left").select(
        _id_of("record_id", id_type).alias("id"),
        "record_type",
        "uri",
        _id_of("refers_to", id_type).alias("refers_to"),
        F.when(revisit, F.col("_full")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "intact",
    )
