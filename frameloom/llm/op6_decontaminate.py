"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every substring of the normalised items as words. Training words stream through it; at each word its
state and the length of the longest match that ends there are known. A match of ``window`` words, or of a whole shorter
item, is a hit, and the state of its last words names the items that hold them.

Most words of a document are in no item, so word pairs are looked up first, all at once; the automaton runs over the runs
of words whose neighbouring pairs all occur in items, as outside them its match is no longer than one word.

Items are dealt to blocks of about ``block_words`` words by a hash, longer items in parts that overlap by a window less one
word. Each block's automaton is built in a task and written as a file to the shared folder, so that neither the driver nor a
broadcast holds the benchmark; the driver has the list of files. Documents are scanned once: a task takes some documents at a time,
``AT_ONCE`` bytes where there are several blocks, and lets every block's automaton run over them, one in memory after the other.

Defined results: null, empty and symbols-only texts have no words and no hits. Very long texts are scanned whole. An item
without words has no window, and an empty benchmark hits nothing. Repeated documents are judged alike; equal items under several
ids are all named; a null item_id is written as an empty string. Extra columns of any name are ignored here and kept by
``clean``; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import filtered, kept_by_worker, slices, staged, together, work_dir

WINDOW, BLOCK_WORDS, SHARE, AT_ONCE = 13, 100_000, 20, 1 << 25
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalised(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of every window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window, self.words = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        for _, ids in numbered:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.holds: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for name, ids in numbered:
            n = min(window, len(ids))
            state = 0
            for p, w in enumerate(ids):
                state = self.next[state][w]
                if p + 1 >= n:
                    if n == window:
                        self.holds.setdefault(self._cut(state, n), set()).add(name)
                    else:
                        self.short.setdefault(self._cut(state, n), []).append((n, name))
        self.least = min([min(window, len(ids)) for _, ids in numbered], default=0)
        self.near = self._nearest() if self.short else []
        self.pairs = np.zeros(1 << 22, bool)
        for _, ids in numbered:
            x = np.array(ids, np.uint64)
            self.pairs[self._pair(x[:-1], x[1:])] = True

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(42)).astype(np.int64)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _cut(self, state: int, n: int) -> int:
        """The state of the last n words of a match."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _nearest(self) -> list[int]:
        """For every state, the first on its way of links, itself included, that ends a short item; 0 if none does."""
        near = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            near[state] = state if state in self.short else near[self.link[state]]
        return near

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items with occurring windows."""
        hit, items = np.zeros(len(words) + 1, np.int64), set()
        if not self.least or len(words) < self.least:
            return hit[:-1] > 0, items
        get = self.words.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if self.least > 1:
            x = ids.view(np.uint64)
            good = (ids[:-1] >= 0) & (ids[1:] >= 0)
            good[good] = self.pairs[self._pair(x[:-1][good], x[1:][good])]
            need = self.least - 1
        else:
            good, need = ids >= 0, 1
        edge = np.flatnonzero(np.diff(np.concatenate(([0], good.astype(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= need:
                self._run(ids[a : b + (self.least > 1)].tolist(), a, hit, items)
        return np.cumsum(hit[:-1]) > 0, items

    def _run(self, ids: list[int], at: int, hit: np.ndarray, items: set[str]) -> None:
        state = size = 0
        for p, w in enumerate(ids, at):
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                size += 1
            if size >= self.window:
                held = self.holds.get(self._cut(state, self.window))
                if held:
                    items |= held
                    hit[p - self.window + 1] += 1
                    hit[p + 1] -= 1
            end = self.near[state] if self.short else 0
            while end:
                for n, name in self.short[end]:
                    if n <= size:
                        items.add(name)
                        hit[p - n + 1] += 1
                        hit[p + 1] -= 1
                end = self.near[self.link[end]]


SCHEMA = "doc_id long, th long, n_words long, spans array<struct<start: long, length: long>>, items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _parts(window: int, block_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as words, long ones in parts; every window lies in one part."""
    step = max(1, block_words - window + 1)
    for batch in slices(batches):
        rows = []
        for item, text in zip(batch["item"].to_pylist(), batch["text"], strict=True):
            words = normalised(text.as_buffer().to_pybytes()) if text.is_valid else []
            rows += [(item, b" ".join(part), len(part)) for a in range(0, max(1, len(words) - window + 1), step) if (part := words[a : a + step + window - 1])]
        columns = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.int64()), strict=True)], ["item", "words", "n"])


def _build(folder: str, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts arrive sorted by block; each block's automaton becomes a file."""
    block, items = None, []

    def written() -> pa.RecordBatch:
        uri = f"{folder}/automaton-{block:06d}-{uuid.uuid4().hex[:8]}"
        files, path = pafs.FileSystem.from_uri(uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(path) as out:
            out.write(zlib.compress(pickle.dumps(Automaton(items, window)), 1))
        return pa.RecordBatch.from_arrays([pa.array([uri])], ["file"])

    for batch in batches:
        for b, item, words in zip(*(batch[c].to_pylist() for c in ("block", "item", "words")), strict=True):
            if b != block:
                if items:
                    yield written()
                block, items = b, []
            items.append((item, words.split()))
    if items:
        yield written()


def automata(spark: SparkSession, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[str]:
    """The files of the automata of all items, about two for every ``block_words`` words."""
    work = work_dir(spark, "automata")
    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    parts = staged(own.mapInArrow(partial(_parts, window, block_words), "item string, words binary, n long").groupBy("item", "words").agg(F.first("n").alias("n")), f"{work}/parts")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = 1 if total <= block_words else -(-2 * total // block_words)
    dealt = parts.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks))).repartition(min(blocks, 512), "block").sortWithinPartitions("block", "item", "words")
    return sorted(r[0] for r in staged(dealt.mapInArrow(partial(_build, f"{work}/files", window), "file string"), f"{work}/list").collect())


def _loaded(uri: str) -> Automaton:
    files, path = pafs.FileSystem.from_uri(uri)
    with files.open_input_stream(path) as file:
        return pickle.loads(zlib.decompress(file.read()))


def _matches(uris: list[str], texts: list[bytes]) -> list[tuple[int, np.ndarray, set[str]]]:
    """For every text the number of its words, which of them are hit, and the items."""
    out: list[tuple[int, np.ndarray, set[str]]] = []
    for uri in uris:
        automaton = kept_by_worker(("automaton", uri), lambda uri=uri: _loaded(uri))
        for i, text in enumerate(texts):
            words = normalised(text)
            hit, items = automaton.match(words)
            if i == len(out):
                out.append((len(words), hit, items))
            elif items:
                out[i] = (len(words), out[i][1] | hit, out[i][2] | items)
    return out or [(len(w := normalised(t)), np.zeros(len(w), bool), set()) for t in texts]


def _bytes(texts: pa.ChunkedArray) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts]


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, th, n_words, spans of hit words (start, length), items, one row a row of docs. Nothing is shuffled."""
    uris = automata(spark, benchmark, window, block_words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in together(batches, AT_ONCE if len(uris) > 1 else 0):
            counts, spans, items = [], [], []
            for n, hit, names in _matches(uris, _bytes(table["text"])):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))) if names else []
                counts.append(n)
                spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
                items.append(sorted(names))
            ids, th = (table[c].combine_chunks() for c in ("doc_id", "th"))
            yield pa.RecordBatch.from_arrays([ids, th, pa.array(counts, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))], ["doc_id", "th", "n_words", "spans", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(scan, SCHEMA)


def judged(found: DataFrame, share: int = SHARE) -> DataFrame:
    """With n_hit and contaminated: some word is hit, and one in ``share`` or more."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return found.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that are not contaminated; columns as in docs. Nothing is shuffled."""
    uris = automata(spark, benchmark, window, block_words)

    def judge(texts: pa.ChunkedArray) -> list[bool]:
        return [not (n_hit := int(hit.sum())) or n_hit * share < n for n, hit, _ in _matches(uris, _bytes(texts))]

    return filtered(docs, judge, AT_ONCE if len(uris) > 1 else 0)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged(found).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join(F.array_sort("items"), ","), "utf-8"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS s
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
), m AS (
  SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
