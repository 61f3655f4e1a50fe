"""Token-id output in files of range-coded blocks, and reading them back.

Documents are dealt to shards by their id and sorted; a shard is one file.  It
is a sequence of sections, each with its kind, length and checksum: segments of
ids (blocks of ``range_coder``, each reset, decodable alone and with a checksum
of its ids) and, after each segment, the documents that ended in it with their ids and
lengths.  Tasks hold one segment at a time, however large the shard.

A document's start, the number of ids before it, is its place in the file plus
the ids of the files before, a running sum over the manifest.

Defined cases: null and empty texts have the end id only; a null doc_id sorts
first; rows that repeat an id follow each other in order of their texts; an
empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import range_coder
from .common import cut, slices
from .sharded_files import STAGED, Output, bounds, by_file, dealt, manifest, publish, staged, store
from .tokens import Encoder

MAGIC = b"tessella token ids 2\n"
SECTION = struct.Struct("<cQI")  # kind, length, crc32
NO_ID = -(1 << 63)
KEPT_PARTS = 1_200_000  # a worker keeps the ids of so many parts of texts


class Writer:
    """A token file: ids are added by document, full segments go out."""

    def __init__(self, uri: str, shard: int):
        self.file = Output(uri, shard, 0, "ids")
        self.file.write(MAGIC)
        self.parts: list[bytes] = []
        self.held = 0  # ids held back
        self.docs: list[tuple[int, int, int]] = []  # (doc_id, length, where it ends among the ids held)

    def section(self, kind: bytes, data: bytes) -> None:
        self.file.write(SECTION.pack(kind, len(data), zlib.crc32(data)) + data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids) // 4
        self.file.n_records += len(ids) // 4
        self.docs.append((NO_ID if doc_id is None else doc_id, len(ids) // 4, self.held))
        while self.held >= range_coder.LANES * range_coder.BLOCK:
            self.segment()

    def segment(self) -> None:
        ids = np.frombuffer(b"".join(self.parts), dtype="<u4")
        n = range_coder.segment_length(ids)
        self.section(b"S", range_coder.encode_segment(ids[:n]))
        self.parts, self.held = [ids[n:].tobytes()], self.held - n
        ended = [d for d in self.docs if d[2] <= n]
        self.docs = [(i, length, end - n) for i, length, end in self.docs[len(ended) :]]
        self.section(b"D", zlib.compress(np.array([d[0] for d in ended], dtype="<i8").tobytes() + np.array([d[1] for d in ended], dtype="<i8").tobytes()))

    def close(self) -> tuple:
        while self.held:
            self.segment()
        return self.file.close()


def write(docs: DataFrame, uri: str, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the ids of every text and ``end_id`` under ``uri``; returns the manifest (n_records: ids)."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sizes = cut(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes")))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, done, writer = Encoder.of(tokenizer, KEPT_PARTS), [], None
        for batch in slices(batches):
            doc_ids, texts, shards = (c.to_pylist() for c in batch.columns)
            for doc_id, ids, shard in zip(doc_ids, encoder.encoded(texts), shards, strict=True):
                if writer is None or writer.file.shard != shard:
                    if writer:
                        done.append(writer.close())
                    writer = Writer(uri, shard)
                writer.add(doc_id, ids + end)
        if writer:
            done.append(writer.close())
        if done:
            yield staged(done)

    return publish(dealt(docs, "doc_id", bounds(sizes, "doc_id"), "text").mapInArrow(run, STAGED), uri)


def sections(stream) -> Iterator[tuple[bytes, bytes]]:
    if stream.read(len(MAGIC)) != MAGIC:
        raise OSError("this is no token file")
    while head := stream.read(SECTION.size):
        kind, length, crc = SECTION.unpack(head)
        data = stream.read(length)
        if len(data) != length or zlib.crc32(data) != crc:
            raise OSError("a section of a token file is damaged")
        yield kind, data


def documents(stream) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the file, ids) of every document of a token file."""
    held, start = np.empty(0, dtype="<u4"), 0
    for kind, data in sections(stream):
        if kind == b"S":
            held = np.concatenate([held, range_coder.decode_segment(data)])
            continue
        doc_ids, lengths = np.frombuffer(zlib.decompress(data), dtype="<i8").reshape(2, -1)
        at = 0
        for doc_id, length in zip(doc_ids.tolist(), lengths.tolist(), strict=True):
            yield (None if doc_id == NO_ID else doc_id), start, held[at : at + length]
            at, start = at + length, start + length
        held = held[at:]
    if len(held):
        raise OSError("a token file ends inside a document")


def read(spark: SparkSession, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``uri``."""
    before = F.coalesce(F.sum("n_records").over(Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = by_file(cut(manifest(spark, uri).select("name", before.alias("before"))))  # a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(uri)
        for batch in batches:
            for name, so_far in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows = [(i, so_far + start, len(ids), zlib.crc32(ids.tobytes())) for i, start, ids in documents(stream)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
