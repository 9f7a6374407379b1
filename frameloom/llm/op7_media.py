"""Media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, zero padded to a positive multiple of 64, are stored as the 8-bit samples of a grey PNG. Payloads are
addressed by their SHA-256. Each task writes tar shards of the payloads that it reads, closing one at ``SHARD_BYTES`` or
``SHARD_ROWS``, each payload once a shard; rows carry digest, shard, offset and length. Where several shards hold one payload,
all rows point to the copy of the first shard by name, so that equal payloads share one place; payloads are never shuffled,
which costs at most one unused copy a shard. What a task holds is bounded by one shard's rows and one payload. Metadata (width,
height, depth) comes from range reads of the first 33 bytes; whole payloads are read back by range as well.

Shards lie in the shared folder and are written and read through pyarrow's file systems, so any store it knows serves. A
shard is written under a name of its own attempt and renamed when whole; the index row names the shard that its own attempt
wrote, so a repeated or lost task leaves no row that points at a part.

Defined results: null counts as empty; empty texts store 64 zero bytes. Very long texts are one payload, in rows of at most
2^20 samples where the size divides so. Equal texts share one payload, also across ties of doc_id. Repeated rows each get a
row. Extra columns of any name are ignored. An empty table writes no shard.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import slices, staged, work_dir

UNIT, MAX_WIDTH, LEVEL, HEADER = 64, 1 << 20, 6, 33
SHARD_BYTES, SHARD_ROWS = 1 << 28, 100_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: bytes | None) -> bytes:
    data = text or b""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Rows as long as the size allows up to MAX_WIDTH, as each starts with a filter byte, which is 0."""
    units, height = len(payload) // UNIT, 1
    while units % height or len(payload) // height > MAX_WIDTH and height < units:
        height += 1
    lines = np.zeros((height, len(payload) // height + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, -1)
    head = struct.pack(">IIBBBBB", len(payload) // height, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, LEVEL)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """width, height and depth from the first 33 bytes."""
    if len(data) < HEADER or not data.startswith(_SIGNATURE) or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, depth = struct.unpack(">IIB", data[16:25])
    return width, height, depth


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, parts = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:].tobytes()


ROWS = "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"


class _Shard:
    """One tar shard in writing, and the rows that point into it."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/shard-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.tar"
        self.files, self.path = pafs.FileSystem.from_uri(self.uri)
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.at = self.files.open_output_stream(self.path + ".part"), 0
        self.places: dict[bytes, tuple[int, int]] = {}
        self.rows: list[tuple] = []

    def add(self, doc: int | None, data: bytes) -> None:
        payload = payload_of(data)
        digest = hashlib.sha256(payload).digest()
        if digest not in self.places:
            media = to_png(payload)
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.places[digest] = self.at + len(head), len(media)
            self.out.write(head + media + bytes(-len(media) % 512))
            self.at += len(head) + len(media) + -len(media) % 512
        self.rows.append((doc, len(data), digest, self.uri, *self.places[digest]))

    def full(self, most_bytes: int, most_rows: int) -> bool:
        return self.at >= most_bytes or len(self.rows) >= most_rows

    def close(self) -> Iterator[pa.RecordBatch]:
        """The rows, once the shard is whole."""
        self.out.write(bytes(1024))
        self.out.close()
        self.files.move(self.path + ".part", self.path)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
        for i in range(0, len(self.rows), 4096):
            part = self.rows[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds, strict=True)], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])


def _pack(folder: str, most_bytes: int, most_rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write the task's payloads to shards; yields a row a document."""
    shard = None
    for batch in slices(batches):
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            shard = shard or _Shard(folder)
            shard.add(doc, text.as_buffer().to_pybytes() if text.is_valid else b"")
            if shard.full(most_bytes, most_rows):
                yield from shard.close()
                shard = None
    if shard:
        yield from shard.close()


class Ranges:
    """Range reads of shards; one shard is open at a time."""

    def __init__(self) -> None:
        self.shard, self.file = None, None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.shard:
            files, path = pafs.FileSystem.from_uri(shard)
            self.shard, self.file = shard, files.open_input_file(path)
        return self.file.read_at(length, offset)


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = Ranges()
    for batch in slices(batches, 1024):
        found = [png_header(ranges.read(*r)) for r in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), [HEADER] * batch.num_rows, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[i] for f in found], pa.int32()) for i in range(3))], [*batch.schema.names, "width", "height", "depth"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = Ranges()
    for batch in slices(batches):
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for place in zip(batch["shard"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True):
            media = ranges.read(*place)
            payload = from_png(media)
            x = np.frombuffer(payload, np.uint8)
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-64:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(f"{len(x)} samples min={x.min()} max={x.max()} sum={x.sum(dtype=np.int64)}")
        kinds = [pa.string() if isinstance(k, str) and ("sha" in k or k == "feature") else pa.int64() for k in out]
        header = ["digest", "width", "height", "depth"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in header), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], [*header, *out])


INDEX = "digest binary, shard string, offset long, length long"


def stored(spark: SparkSession, docs: DataFrame, folder: str, most_bytes: int = SHARD_BYTES, most_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """Write the payloads of docs to tar shards under folder. Returns doc_id, n_bytes, digest, one row a row of docs, and the
    media table: digest, shard, offset, length and header metadata, one row a distinct payload."""
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_pack, f"{folder}/shards", most_bytes, most_rows), ROWS), f"{folder}/rows")
    place = F.min(F.struct("shard", "offset", "length")).alias("x")
    index = rows.groupBy("digest").agg(place).select("digest", "x.shard", "x.offset", "x.length").sort("shard", "offset")
    media = staged(index.mapInArrow(_headers, INDEX + ", width int, height int, depth int"), f"{folder}/media")
    return rows.select("doc_id", "n_bytes", "digest"), media


def media_column(rows: DataFrame, media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length, width, height, depth, one row a document."""
    return rows.join(media.hint("merge"), "digest")


def features(media: DataFrame) -> DataFrame:
    """Header metadata, and features of payloads read back by range, one row a digest."""
    return media.mapInArrow(_features, "digest binary, width int, height int, depth int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_dir(spark, "media")
    rows, media = stored(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    read = staged(features(media), f"{folder}/features")
    found = rows.join(read.hint("merge"), "digest")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth")
