"""Token ids in binary files: one zstandard frame a document, with a shared dictionary and an offset index.

Ids are serialized as little-endian unsigned 16-bit integers (32-bit for vocabularies of over 65,536 ids) and each document
is compressed by itself with a dictionary trained on the serialized id arrays of a bounded sample: at most ``sample_docs``
documents, those of the least hash of id and text, whole, in pieces of ``PIECE`` bytes, and a dictionary of an eighth of these
bytes at most. A sample too small to train on is a dictionary itself, as it is. A file holds a header, the frames in ascending
doc_id order, and an index: doc_id, offset, length and number of ids of every document, with the dictionary's hash. One
document is read with one read of the index and one of its frame.

Files are numbered by ranges of doc_id. Document starts within a file come from its index; the sums over files before it
come from one running sum over the list of files. Files are written under a name of their attempt and renamed when whole.

Tokenizing: the pre-tokenizer never joins a visible character to white space after it, so a text is the concatenation of
its pieces, each led by the white space before it. The library encodes each piece; a worker keeps the results of short pieces
after a single space or line feed (at most ``CACHE``), as words repeat. Texts with other white space go to the library whole.

Defined results: null counts as empty, whose only id is the end id. Ties of doc_id stand by a hash of the text, and repeated rows
follow each other. Very long texts are one frame, which a task holds as a whole. Extra columns of any name are ignored; an
empty table writes no file.
"""

from __future__ import annotations

import hashlib
import os
import re
import string
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.llm.common import kept_by_worker, out_dir, parallel, release, remove, sampled, slices, staged

END_ID, SAMPLE_DOCS, DICT_BYTES, PIECE, CACHE, LEVEL = 0, 1000, 1 << 16, 1 << 16, 500_000, 3
MAGIC = b"FLTOK001"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if resize := getattr(tokenizer.model, "_resize_cache", None):
        resize(0)  # pieces are kept here already
    return tokenizer


_ODD = re.compile(r"[^\S \n]|[\x1c-\x1f]")  # white space other than spaces and line feeds
_RUNS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")


# how byte-level models write bytes: visible Latin-1 characters stand for themselves, the others for letters from 256 on
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
_SPACE = _BYTE_LETTERS[32]


class _Pieces(dict):
    """Serialized ids of pieces that follow a single space, or a line feed that they hold; short ones are kept."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tails: dict[str, bytes] = {}
        self.tokenizer, self.kind = _tokenizer(path), "HI"[_code(path) == "<u4"]
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        # a byte-level model alone: words of letters go straight to it, one pre-token each
        self.direct = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and not any(t.isalpha() for t in added)

    def whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.kind, ids)
        if sys.byteorder != "little":
            out.byteswap()
        return out.tobytes()

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece == "\n" or _ODD.search(piece):
            raise ValueError("a run of white space")
        letters = piece.rstrip(string.punctuation)
        if letters != piece and letters.isalpha():  # letters and marks after them are never joined
            tail = piece[len(letters) :]
            if tail not in self.tails:
                self.tails[tail] = self.whole(tail)
            out = self[letters] + self.tails[tail]
        elif self.direct and letters.isalpha():
            letters = _SPACE + piece if piece.isascii() else (" " + piece).encode().decode("latin-1").translate(_BYTE_LETTERS)
            out = self.packed([t.id for t in self.model.tokenize(letters)])
        else:
            out = self.whole(piece if piece[0] == "\n" else " " + piece)
        if len(self) < CACHE and len(piece) < 64:
            self[piece] = out
        return out


def serialized(text: str, path: str) -> bytes:
    """The serialized ids of a text, as the library encodes it, without special tokens."""
    pieces = kept_by_worker(("pieces", path), lambda: _Pieces(path))
    first, *rest = text.replace("\n", " \n").split(" ")
    try:
        if first and first[-1] not in "\n" and not _ODD.search(first):
            return pieces.whole(first) + b"".join(map(pieces.__getitem__, rest))
    except ValueError:
        pass
    if _ODD.search(text):
        return pieces.whole(text)
    return b"".join(map(pieces.whole, _RUNS.findall(text)))


def _code(path: str) -> str:
    return "<u2" if _tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def _encode(path: str, dictionary: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code = _code(path)
    end, width = np.array([END_ID], code).tobytes(), np.dtype(code).itemsize
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_dict_id=False)
    for batch in slices(batches):
        counts, frames = [], []
        for text in batch["text"].to_pylist():
            data = serialized(text or "", path) + end
            counts.append(len(data) // width)
            frames.append(packer.compress(data))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "th", "n_tokens", "frame"])


def _serialized(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The serialized ids of every text, in pieces."""
    for batch in slices(batches, 16):
        found = [serialized(t or "", path) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[a : a + PIECE] for x in found for a in range(0, len(x), PIECE)], pa.binary())], ["ids"])


def trained_dictionary(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, size: int = DICT_BYTES) -> bytes:
    """A dictionary from at most sample_docs documents; the last bytes of the sample if that is too small to train on."""
    some = sampled(docs.select("doc_id", "text", F.lit(0).alias("by")), sample_docs).select("text")
    samples = sorted(r[0] for r in some.mapInArrow(partial(_serialized, path), "ids binary").toLocalIterator())
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _write(folder: str, code: str, dictionary: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file of the task's documents, which arrive in order."""
    number = TaskContext.get().partitionId()
    name = f"{folder}/tokens-{number:05d}-{uuid.uuid4().hex[:8]}.bin"
    out, at, total = None, 0, 0
    index: list[np.ndarray] = []
    first = None
    for batch in slices(batches, 2048):
        if out is None:
            files, path = pafs.FileSystem.from_uri(name)
            files.create_dir(path.rpartition("/")[0], recursive=True)
            out = files.open_output_stream(path + ".part")
            head = MAGIC + code.encode().ljust(8) + bytes.fromhex(dictionary)
            out.write(head)
            at, first = len(head), batch["doc_id"][0].as_py()
        frames = batch["frame"].to_pylist()
        sizes = np.array([len(x) for x in frames], np.int64)
        ids = np.array([-(1 << 63) if x is None else x for x in batch["doc_id"].to_pylist()], np.int64)
        counts = batch["n_tokens"].to_numpy()
        index.append(np.stack([ids, at + np.cumsum(sizes) - sizes, sizes, counts], axis=1))
        out.write(b"".join(frames))
        at += int(sizes.sum())
        total += int(counts.sum())
    if out is not None:
        table = np.concatenate(index).astype("<i8")
        out.write(table.tobytes())
        out.write(struct.pack("<QQ", at, len(table)) + MAGIC)
        out.close()
        files.move(path + ".part", path)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([name]), pa.array([first], pa.int64()), pa.array([len(table)], pa.int64()), pa.array([total], pa.int64())], ["number", "file", "first_doc", "documents", "tokens"])


class Reader:
    """Reads one token file: the index, then any document by its place in it."""

    def __init__(self, uri: str, dictionary: bytes) -> None:
        files, path = pafs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        at, rows, magic = struct.unpack("<QQ8s", self.file.read_at(24, size - 24))
        head = self.file.read_at(48, 0)
        if magic != MAGIC or head[:8] != MAGIC:
            raise ValueError("not a token file")
        if head[16:48] != hashlib.sha256(dictionary).digest():
            raise ValueError("another dictionary")
        self.code = head[8:16].decode().strip()
        self.index = np.frombuffer(self.file.read_at(rows * 32, at), "<i8").reshape(rows, 4)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.unpacker = zstandard.ZstdDecompressor(dict_data=shared)

    def ids(self, row: int) -> np.ndarray:
        _, offset, length, count = (int(x) for x in self.index[row])
        out = np.frombuffer(self.unpacker.decompress(self.file.read_at(length, offset)), self.code)
        if len(out) != count:
            raise ValueError("the index and the frame disagree")
        return out


def _read(dictionary: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch["file"].to_pylist(), batch["start"].to_pylist(), strict=True):
            reader = Reader(uri, dictionary)
            for at in range(0, len(reader.index), 2048):
                part = reader.index[at : at + 2048]
                crc = [zlib.crc32(reader.ids(at + i).astype("<u4").tobytes()) for i in range(len(part))]
                starts = start + np.cumsum(part[:, 3]) - part[:, 3]
                start += int(part[:, 3].sum())
                ids = pa.array(part[:, 0], pa.int64(), mask=part[:, 0] == -(1 << 63))
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int64()), pa.array(part[:, 3], pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


FILES = "number int, file string, first_doc long, documents long, tokens long"


def written(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str | None = None, sample_docs: int = SAMPLE_DOCS) -> tuple[DataFrame, bytes]:
    """Write the token files of docs (doc_id, text) under folder, which is the caller's to keep or remove: the list of files with the place of each one's first id,
    and the dictionary, which is also written beside them."""
    path = vocabulary or default_vocabulary()
    dictionary = trained_dictionary(docs, path, sample_docs)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    frames = staged(own.mapInArrow(partial(_encode, path, dictionary), "doc_id long, th long, n_tokens long, frame binary"), f"{folder}/frames")
    order = [F.col("doc_id").asc_nulls_first(), F.col("th")]
    dealt = frames.repartitionByRange(parallel(docs), *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "frame")
    files = staged(dealt.mapInArrow(partial(_write, f"{folder}/files", _code(path), hashlib.sha256(dictionary).hexdigest()), FILES), f"{folder}/list")
    remove(spark, f"{folder}/frames")
    release(spark)
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("start", before), dictionary


def documents_of(files: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    return files.select("file", "start").repartition(parallel(files), "file").mapInArrow(partial(_read, dictionary), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(*written(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), out_dir(spark, "tokens")))
