"""Deterministic sharded WARC writer, and a reader of what it writes.

Records are sorted by page id over deterministic shards (``sharded_files``).
Within a shard a file is closed once its compressed size passes the limit.
Every record is a gzip member of its own; headers, record ids and digests are
made anew from the row.  Files are committed through temporary names and a
manifest, so those of lost or repeated attempts never count.

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the one of
the smallest page id is written in full and the others as revisits.  Who
revisits whom is found on (id, digest) rows alone; those marks are merged
into the sorted stream, so the payloads are shuffled once.

Defined cases: a null payload is empty; a null page id is written without one,
sorts first, is never referred to, and revisits only a page that has an id; a
row that repeats id and payload revisits its twin; a null url is left out; an
empty table gives no file and an empty manifest.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import joined
from .common import cut
from .sharded_files import STAGED, Output, bounds, by_file, dealt, manifest, publish, staged, store

LEAST_REVISIT = 100
FILE_BYTES = 32 << 20
LEVEL = 5
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}|{digest}'.encode()).hexdigest()[:32])}>"


def lines(*fields: tuple[str, object]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\n" + lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))) + b"\r\n"
    block = http if revisit else http + payload
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    head = lines(
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("X-Page-Id", page_id),
        ("X-Refers-To-Page-Id", refers_to if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    )
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Archive(Output):
    """An open archive; it starts with a warcinfo record."""

    def __init__(self, uri: str, shard: int, seq: int):
        super().__init__(uri, shard, seq, "warc.gz")
        info = lines(("software", "tessella"), ("format", "WARC File Format 1.1"))
        head = lines(("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info)))
        self.write(member(b"WARC/1.1\r\n" + head + b"\r\n" + info + b"\r\n\r\n"))

    def add(self, data: bytes) -> None:
        self.write(member(data))
        self.n_records += 1


def write(pages: DataFrame, uri: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``uri``; returns the manifest."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    ids = cut(pages.select("page_id", F.unhex(F.sha2("payload", 256)).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes")))
    first = ids.where(F.col("n_bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    # a payload that many pages share comes by a broadcast
    marks = joined(ids.where(F.col("n_bytes") >= LEAST_REVISIT), cut(first), "digest", "n", "page_id").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    none = lambda kind: F.lit(None).cast(kind)
    both = pages.select("page_id", F.unhex(F.sha2("payload", 256)).alias("digest"), F.lit(1).alias("kind"), none("long").alias("refers_to"), "url", "payload").unionByName(
        marks.select("page_id", "digest", F.lit(0).alias("kind"), "refers_to", none("string").alias("url"), none("binary").alias("payload")).distinct()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        archive: Archive | None = None
        mark, before = None, None
        for batch in batches:
            for page_id, digest, kind, refers_to, url, data, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    mark = (page_id, digest, refers_to)
                    continue
                if archive is None or archive.shard != shard or archive.size >= FILE_BYTES:
                    if archive:
                        done.append(archive.close())
                    archive = Archive(uri, shard, archive.seq + 1 if archive and archive.shard == shard else 0)
                to = mark[2] if mark and mark[:2] == (page_id, digest) else None
                if to is None and page_id is not None and before == (page_id, digest) and len(data) >= LEAST_REVISIT:
                    to = page_id
                before = (page_id, digest)
                archive.add(record(page_id, url, data, digest.hex(), to, to is not None))
        if archive:
            done.append(archive.close())
        if done:
            yield staged(done)

    return publish(dealt(both, "page_id", bounds(ids, "page_id"), "digest", "kind", "url").mapInArrow(run, STAGED), uri)


def members(stream) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, read in bounded pieces."""
    z, parts, chunk = zlib.decompressobj(31), [], b""
    while True:
        if not chunk and not (chunk := stream.read(1 << 20)):
            break
        parts.append(z.decompress(chunk))
        chunk = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
    if parts:
        raise OSError("an archive ends inside a record")


def parsed(data: bytes) -> dict | None:
    """The fields of a response or revisit record, checked against its digests; None for others."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "revisit"
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:") or not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise OSError(f"{fields['WARC-Record-ID']}: its digest is wrong")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"), "payload": None if revisit else payload}


def read(spark: SparkSession, uri: str, payloads: bool = False) -> DataFrame:
    """The records of the manifest's archives, each file by one task; payloads only where asked for."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(uri)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held: list[dict] = []
                size = 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        if row := parsed(data):
                            held.append({k: row[k] for k in kinds})
                            size += len(data) * payloads + 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=pa.schema(kinds.items()))
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=pa.schema(kinds.items()))

    return by_file(manifest(spark, uri).select("name")).mapInArrow(run, schema)
