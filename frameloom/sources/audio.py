"""WAV files: 16-bit mono PCM as rows, and back."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples / 32767 of a RIFF file; walks its chunks and refuses other than one channel of 16-bit integers."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, body = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", data[at + 8 : at + 24])
        elif name == b"data":
            body = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or body is None:
        raise ValueError("a chunk is missing")
    if form[0] != 1 or form[1] != 1 or form[5] != 16:
        raise ValueError("only 16-bit mono PCM")
    return form[2], np.frombuffer(body[: len(body) // 2 * 2], "<i2") / 32767.0


def encode(samples, rate: int) -> bytes:
    """Clamped to [-1, 1] and cut to 16 bits towards zero."""
    body = np.trunc(np.clip(np.asarray(samples, np.float64), -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def decoded(rows: DataFrame, content: str = "content") -> DataFrame:
    """Adds rate, samples and error; a file that cannot be read has its error instead of samples."""

    @F.pandas_udf("struct<rate: int, samples: array<float>, error: string>")
    def one(content: pd.Series) -> pd.DataFrame:
        out = []
        for data in content:
            try:
                rate, x = decode(data)
                out.append((rate, x.astype(np.float32).tolist(), None))
            except (ValueError, struct.error) as e:
                out.append((None, None, str(e)))
        return pd.DataFrame(out, columns=["rate", "samples", "error"])

    kept = [c for c in rows.columns if c != content]
    return rows.select(*kept, one(content).alias("__x")).select(*kept, "__x.*")


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, samples, error of every file. A file is a row, of at most 2 GB."""
    return decoded(spark.read.format("binaryFile").load(path).select("path", "content"))


def encoded(rate: int):
    """A function of samples that gives a file's bytes."""

    @F.pandas_udf("binary")
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: encode(x, rate) if x is not None else None)

    return run


def write(rows: DataFrame, folder: str, rate: int) -> DataFrame:
    """name, path, bytes of the files that were written, one a row of rows (name, samples), under ``folder`` in shared storage. A
    file is written under the name of its attempt and renamed when whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for name, samples in zip(batch["name"].to_pylist(), batch["samples"].to_pylist(), strict=True):
                data, path = encode(samples or [], rate), f"{root}/{name}.wav"
                part = f"{path}.{uuid.uuid4().hex[:8]}"
                with files.open_output_stream(part) as out:
                    out.write(data)
                files.move(part, path)
                paths.append(path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch["name"], pa.array(paths), pa.array(sizes, pa.int64())], ["name", "path", "bytes"])

    return rows.select("name", "samples").mapInArrow(run, "name string, path string, bytes long")
