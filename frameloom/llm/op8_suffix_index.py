"""Suffix-array dedup with a logarithmic index family.

Documents come in batches. A batch's suffix array holds its suffixes at anchors (``repeats``), one row for each distinct
passage that an anchor stands in, with its count. It is sorted alphabetically by the suffixes' first four bytes, then by a hash
of the first ``gram``, then by a hash of the passage, and lies in ``parts`` files by a hash of that key, each sorted. Any string
of ``window`` bytes holds an anchor at a place that its bytes fix, so two equal strings start two suffixes that are neighbours
in this order.

A new batch's array is merge-scanned, file by file, against itself and every level of the family: keys met twice can start long
matches. Then it joins the family: two arrays of one level merge into one of the next, by merging their sorted files, so b
batches leave at most log2(b) + 1 levels and each suffix is rewritten at most log2(b) times. The family persists in its
folder: opened again, it takes further batches. The passages around keys met twice then get full alphabetical suffix
arrays of all their suffixes (``suffixes``), key by key, where neighbours with a common prefix of ``window`` bytes are the long
matches; every byte in one is cut. Over ``group_limit`` distinct passages under one key are not sorted together; their windows
are counted by hash over many tasks.

Merging reads each file in pieces, so a task's memory does not grow with a level. A task that is lost and run again writes files
of a new name, and the list of a level's files is written when all are whole.

Defined results: null counts as empty. Matches never cross documents. Repeated rows, ties in doc_id among them, repeat each
other. Texts under ``window`` bytes are never touched; very long texts are indexed in overlapping parts of 2^20 bytes. A cut may
split a character, so what is kept is binary. Extra columns of any name are ignored; empty tables and batches give no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import keyed, parallel, release, slices, staged, work_dir
from frameloom.llm.repeats import ENTRY, Spec, covered, entries, marks, with_marks

WINDOW, GRAM, BATCHES, PIECE = 200, 50, 4, 1 << 16
ROW = pa.schema([("ah", pa.int64()), ("ph", pa.int64()), ("n", pa.int64())])
FILES = "part int, file string"


class _Writer:
    """Sorted files of arrays, one a part, of rows that arrive part by part."""

    def __init__(self, folder: str) -> None:
        self.folder, self.part, self.out, self.made = folder, None, None, []

    def write(self, part: int, rows: dict[str, np.ndarray]) -> None:
        if part != self.part:
            self.close()
            self.part, self.uri = part, f"{self.folder}/part-{part:05d}-{uuid.uuid4().hex[:8]}.parquet"
            files, path = pafs.FileSystem.from_uri(self.uri)
            files.create_dir(path.rpartition("/")[0], recursive=True)
            self.out = pq.ParquetWriter(path, ROW, filesystem=files, compression="zstd", use_dictionary=False, column_encoding={"ah": "DELTA_BINARY_PACKED", "n": "DELTA_BINARY_PACKED"})
        if len(rows["ah"]):
            self.out.write_table(pa.table([pa.array(rows[c]) for c in ROW.names], schema=ROW), row_group_size=PIECE)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.made.append((self.part, self.uri))
            self.out = None

    def rows(self) -> pa.RecordBatch:
        self.close()
        return pa.RecordBatch.from_arrays([pa.array([m[0] for m in self.made], pa.int32()), pa.array([m[1] for m in self.made], pa.string())], ["part", "file"])


def _array(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write rows (part, ah, ph, n), sorted by these, as files."""
    out = _Writer(folder)
    for batch in batches:
        part = batch["part"].to_numpy()
        for at in [0, *(np.flatnonzero(np.diff(part)) + 1).tolist()] if len(part) else []:
            end = int(np.searchsorted(part, part[at], "right"))
            out.write(int(part[at]), {c: batch[c].to_numpy()[at:end] for c in ROW.names})
    yield out.rows()


def _pieces(uri: str) -> Iterator[dict[str, np.ndarray]]:
    files, path = pafs.FileSystem.from_uri(uri)
    with files.open_input_file(path) as file:
        for batch in pq.ParquetFile(file).iter_batches(PIECE):
            if batch.num_rows:
                yield {c: batch[c].to_numpy() for c in ROW.names}


def merged(streams: list[Iterator[dict[str, np.ndarray]]]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Sorted streams as one, in pieces: rows, and the number of the stream that each comes from. Of each stream no more
    is held than a piece, and equal (ah, ph) of different streams are in one piece."""
    held = [next(s, None) for s in streams]
    while any(h is not None for h in held):
        fence = min((h["ah"][-1], h["ph"][-1]) for h in held if h is not None)
        take, source = [], []
        for i, h in enumerate(held):
            if h is None:
                continue
            # rows up to the fence are a prefix
            end = int(np.count_nonzero((h["ah"] < fence[0]) | ((h["ah"] == fence[0]) & (h["ph"] <= fence[1]))))
            take.append({c: x[:end] for c, x in h.items()})
            source.append(np.full(end, i))
            held[i] = {c: x[end:] for c, x in h.items()} if end < len(h["ah"]) else next(streams[i], None)
        rows, which = {c: np.concatenate([t[c] for t in take]) for c in ROW.names}, np.concatenate(source)
        order = np.lexsort((rows["ph"], rows["ah"]))
        yield {c: x[order] for c, x in rows.items()}, which[order]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, new, old) of files: the keys of the new array that stand twice in it or also in an old one."""
    for batch in batches:
        for new, old in zip(batch["new"].to_pylist(), batch["old"].to_pylist(), strict=True):
            key, total, fresh = None, 0, 0  # of the key that the last piece ended with
            for rows, source in merged([_pieces(new), *map(_pieces, old)]):
                ah, first = np.unique(rows["ah"], return_index=True)
                sums = np.add.reduceat(rows["n"], first)
                own = np.add.reduceat(np.where(source == 0, rows["n"], 0), first)
                if key is not None and ah[0] == key:
                    sums[0] += total
                    own[0] += fresh
                elif key is not None and total > 1 and fresh:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64())], ["ah"])
                key, total, fresh = ah[-1], sums[-1], own[-1]
                yield pa.RecordBatch.from_arrays([pa.array(ah[:-1][(sums[:-1] > 1) & (own[:-1] > 0)], pa.int64())], ["ah"])
            if key is not None and total > 1 and fresh:
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64())], ["ah"])


def _merge(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, files): one sorted file a part, in which equal passages are one row."""
    out = _Writer(folder)
    for batch in batches:
        for part, uris in zip(batch["part"].to_pylist(), batch["files"].to_pylist(), strict=True):
            for rows, _ in merged(list(map(_pieces, uris))):
                new = np.flatnonzero(np.append(True, (np.diff(rows["ah"]) != 0) | (np.diff(rows["ph"]) != 0)))
                out.write(part, {"ah": rows["ah"][new], "ph": rows["ph"][new], "n": np.add.reduceat(rows["n"], new)})
    yield out.rows()


class IndexFamily:
    """Suffix arrays in levels; level i holds 2**i batches. All of it lies in a folder in shared storage, which a later
    session can open again; parts and spec are those that it was begun with."""

    def __init__(self, spark: SparkSession, folder: str, spec: Spec) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files, self.path = pafs.FileSystem.from_uri(self.folder)
        self.state = self._opened() or {"spec": [spec.window, spec.gram], "parts": parallel(spark.range(1)), "batches": 0, "levels": {}}
        if self.state["spec"] != [spec.window, spec.gram]:
            raise ValueError("the family was begun with another window or gram")
        self.spec = spec

    def _opened(self) -> dict | None:
        found = [f.path for f in self.files.get_file_info(pafs.FileSelector(self.path, allow_not_found=True)) if f.base_name.startswith("family-")]
        if not found:
            return None
        with self.files.open_input_stream(max(found)) as file:
            return json.loads(file.read())

    def _close(self) -> None:
        """Write the state under the number of its batches; older states stay until the new one is whole."""
        name = f"{self.path}/family-{self.state['batches']:08d}.json"
        self.files.create_dir(self.path, recursive=True)
        with self.files.open_output_stream(name + ".part") as out:
            out.write(json.dumps(self.state).encode())
        self.files.move(name + ".part", name)

    @property
    def levels(self) -> dict[int, dict[int, str]]:
        """Of each level, the file of each part."""
        return {int(k): {int(p): f for p, f in v.items()} for k, v in self.state["levels"].items()}

    def _tasks(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema).repartition(max(1, len(rows)), "part")

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch (doc_id, th, text); returns the keys (ah) that it shares with itself or an earlier batch."""
        number, parts = self.state["batches"] + 1, self.state["parts"]
        found = staged(entries(docs, self.spec), f"{self.folder}/entries-{number}")
        rows = found.groupBy("ah", "ph").agg(F.count("*").alias("n")).withColumn("part", F.pmod(F.xxhash64("ah"), F.lit(parts)).cast("int"))
        rows = rows.repartition(parts, "part").sortWithinPartitions("part", "ah", "ph").select("part", "ah", "ph", "n")
        array = {r.part: r.file for r in staged(rows.mapInArrow(partial(_array, f"{self.folder}/array-{number}"), FILES), f"{self.folder}/list-{number}").collect()}
        release(self.spark)
        levels = self.levels
        scan = self._tasks([(p, f, [v[p] for v in levels.values() if p in v]) for p, f in sorted(array.items())], "part int, new string, old array<string>")
        shared = staged(scan.mapInArrow(_scanned, "ah long"), f"{self.folder}/found-{number}")
        height, gone = 0, []
        while height in levels:
            other = levels.pop(height)
            both = [(p, [v[p] for v in (other, array) if p in v]) for p in sorted({*other, *array})]
            made = self._tasks(both, "part int, files array<string>").mapInArrow(partial(_merge, f"{self.folder}/level-{number}-{height + 1}"), FILES)
            gone += [*other.values(), *array.values()]
            array, height = {r.part: r.file for r in staged(made, f"{self.folder}/merged-{number}-{height + 1}").collect()}, height + 1
        levels[height] = array
        self.state |= {"batches": number, "levels": {str(k): {str(p): f for p, f in v.items()} for k, v in levels.items()}}
        self._close()
        for uri in gone:
            files, path = pafs.FileSystem.from_uri(uri)
            files.delete_file(path)
        return shared

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{name}-{b}" for b in range(1, self.state["batches"] + 1)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        return self._read("entries", ENTRY)

    def repeated(self) -> DataFrame:
        return self._read("found", "ah long").distinct()

    def marks(self, docs: DataFrame, work: str) -> DataFrame:
        """The repeated windows (see ``repeats.marks``) of docs, which are all documents that were added (doc_id, th, text)."""
        return marks(self.spark, docs, self.spec, work, self.entries(), staged(self.repeated(), f"{work}/anchors"))


def _spans(spec: Spec, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(rows):
        out = []
        for text, runs in zip(batch["text"], batch["runs"].to_pylist(), strict=True):
            hit = covered(text.as_buffer().size if text.is_valid else 0, runs, spec) if runs else np.zeros(0, bool)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
            out.append([{"start": a, "length": b - a} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"].cast(pa.string()), pa.array(out, kind)], ["doc_id", "text", "spans"])


def spans_of(family: IndexFamily, docs: DataFrame, work: str) -> DataFrame:
    """Every row of docs (doc_id, text), which are all documents of the family, as doc_id, text, spans (start, length in bytes)."""
    own = keyed(docs)
    marked = with_marks(own, family.marks(own, work))
    return marked.select("doc_id", "text", "runs").mapInArrow(partial(_spans, family.spec), "doc_id long, text string, spans array<struct<start: long, length: long>>")


def _family(spark: SparkSession, docs: DataFrame, window: int, gram: int, batches: int, group_limit: int) -> tuple[DataFrame, IndexFamily, str]:
    """docs in ``batches`` batches in a new family."""
    own, work = keyed(docs), work_dir(spark, "suffixes")
    family = IndexFamily(spark, f"{work}/family", Spec(window, gram, "bytes", group_limit=group_limit))
    for b in range(batches):
        family.add(own.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b))
    return own, family, work


def spans(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, group_limit: int = 4096) -> DataFrame:
    """``spans_of`` docs, which are added to a new family in ``batches`` batches."""
    _, family, work = _family(spark, docs, window, gram, batches, group_limit)
    return spans_of(family, docs, work)


def _kept(spec: Spec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        size, found, kept = [], [], []
        for text, runs in zip(batch["text"], batch["runs"].to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            hit = covered(len(data), runs, spec) if runs else np.zeros(len(data), bool)
            size.append(len(data))
            found.append(int(np.count_nonzero(hit[1:] & ~hit[:-1])) + bool(len(hit) and hit[0]))
            kept.append(np.frombuffer(data, np.uint8)[~hit].tobytes() if runs else data)
        removed = [a - len(b) for a, b in zip(size, kept, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.int64()) for x in (size, removed, found)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, group_limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    own, family, work = _family(spark, docs, window, gram, batches, group_limit)
    marked = with_marks(own, family.marks(own, work))
    return marked.select("doc_id", "text", "runs").mapInArrow(partial(_kept, family.spec), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
