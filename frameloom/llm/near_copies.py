"""Near copies: pairs whose SimHash fingerprints are linked as in ``op1_simhash``, and pairs whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more, which fingerprints of 64 bits within 2 cannot find.

Fingerprints go through op1's covering tables, buckets and components. Shingle sets go through min-hash bands:

1. Equal shingle sets collapse. Every distinct set gets 128 min-hashes, in 32 bands of four: a pair at similarity 0.8 shares
   no band in 5 of 10**8 cases.
2. Sets that share a band are compared by one byte of each min-hash. 77 equal bytes of 128 make a *likely* pair, which a
   pair at 0.8 misses about as rarely. Each band leaves a spanning forest of its likely pairs, never all pairs.
3. Components of likely pairs go to one task each with their whole shingle sets, which are compared exactly. A set leaves the
   comparison once it is reached, so that the links are a spanning forest again and groups of close copies take linear time.

Components of sets that hold fingerprints of one component are one: neither kind of link is lost where the other begins.

Defined results: words are split at ASCII white space and lowered as in ``op1_simhash``. A text under five words is one shingle.
Null, empty and white-space texts are copies of each other. Hashes of 64 bits stand for shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import NAME, keyed, named, one_each, release, slices, staged, work_dir
from frameloom.llm.components import components
from frameloom.llm.op1_simhash import rooted, simhash
from frameloom.llm.repeats import mix, symbols, window_hashes

SHINGLE, BANDS, ROWS, LIKELY = 5, 32, 4, 77
_RNG = np.random.Generator(np.random.PCG64(42))
_FLIP = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_ROW = _RNG.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)


def shingles(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    s = symbols((text or b"").lower(), "words")
    return np.unique(window_hashes(s, min(n, len(s)))) if len(s) else s


def min_hashes(found: np.ndarray) -> np.ndarray:
    least = np.full(len(_FLIP), ~np.uint64(0))
    for at in range(0, len(found), 1024):
        least = np.minimum(least, ((found[at : at + 1024] ^ _FLIP) * _TIMES).min(axis=1))
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """A key for each band, which holds the band's number."""
    return mix((least.reshape(BANDS, ROWS) * _ROW).sum(axis=1, dtype=np.uint64) ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64)))


def _prints(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1024):
        sets, keys, bytes_, fps = [], [], [], []
        for t in batch["text"]:
            text = t.as_buffer().to_pybytes() if t.is_valid else None
            fps.append(simhash(text))
            found = shingles(text, n)
            least = min_hashes(found)
            sets.append(xxhash.xxh3_64_intdigest(found.tobytes()))
            keys.append(bands(least).view(np.int64))
            bytes_.append(least.astype(np.uint8).tobytes())
        arrays = [batch["doc_id"], batch["th"], pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(bytes_, pa.binary()), pa.array(fps, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "sh", "keys", "sig", "fp"])


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those of 0..n-1 reached from i): a spanning forest of the pairs that near(i, others) is true for."""
    left = np.arange(n)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            if hit.any():
                yield i, left[hit]
                queue += left[hit].tolist()
                left = left[~hit]


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found) if found else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = []
        for members in batch["members"]:
            sh = members.values.field("sh").to_numpy()
            sig = np.frombuffer(b"".join(members.values.field("sig").to_pylist()), np.uint8).reshape(len(sh), -1)
            for i, new in _forest(len(sh), lambda i, others: np.count_nonzero(sig[others] == sig[i], axis=1) >= LIKELY):
                found.append((np.full(len(new), sh[i]), sh[new]))
        yield _edges(found)


def _alike(sets: list[np.ndarray], size: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Which of the others have similarity 0.8 or more with set i."""
    hit = np.zeros(len(others), bool)
    fits = np.flatnonzero((5 * size[others] >= 4 * size[i]) & (5 * size[i] >= 4 * size[others]))
    if not size[i]:
        return hit
    for at in range(0, len(fits), 1024):
        part = others[fits[at : at + 1024]]
        s = np.concatenate([sets[j] for j in part])
        same = sets[i][np.minimum(np.searchsorted(sets[i], s), size[i] - 1)] == s
        common = np.add.reduceat(same.astype(np.int64), np.concatenate(([0], np.cumsum(size[part])[:-1])))
        hit[fits[at : at + 1024]] = 5 * common >= 4 * (size[i] + size[part] - common)
    return hit


def _exact(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by root; the sets of one root are held at a time."""
    root, sh, sets = None, [], []

    def found() -> pa.RecordBatch:
        ids, size = np.array(sh, np.int64), np.array([len(x) for x in sets], np.int64)
        return _edges([(np.full(len(new), ids[i]), ids[new]) for i, new in _forest(len(sets), partial(_alike, sets, size))])

    for batch in slices(batches):
        for r, h, text in zip(batch["root"].to_pylist(), batch["sh"].to_pylist(), batch["text"], strict=True):
            if r != root:
                if len(sets) > 1:
                    yield found()
                root, sh, sets = r, [], []
            sh.append(h)
            sets.append(shingles(text.as_buffer().to_pybytes() if text.is_valid else None, n))
    if len(sets) > 1:
        yield found()


def _joined(spark: SparkSession, prints: DataFrame, own: DataFrame, work: str) -> DataFrame:
    """sh, root from own (sh, root), where roots whose sets hold fingerprints of one component of op1's links are one."""
    near = rooted(spark, prints, f"{work}/simhash").select("fp", F.col("root").alias("near"))
    met = prints.select("sh", "fp").distinct().join(own.hint("merge"), "sh").join(near.hint("merge"), "fp").select("near", "root").distinct()
    met = staged(met, f"{work}/met")
    least = staged(met.groupBy("near").agg(F.min("root").alias("least")), f"{work}/least")
    edges = met.join(least.hint("merge"), "near").select(F.col("root").alias("a"), F.col("least").alias("b"))
    last = components(spark, edges, f"{work}/joined").select(F.col("node").alias("root"), F.col("root").alias("last"))
    return own.join(last.hint("merge"), "root", "left").select("sh", F.coalesce("last", "root").alias("root"))


def copies(spark: SparkSession, docs: DataFrame, work: str, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (text hash), root of every row; rows of one root are linked by near copies."""
    prints = staged(keyed(docs).mapInArrow(partial(_prints, shingle), "doc_id long, th long, sh long, keys array<long>, sig binary, fp long"), f"{work}/prints")
    least = F.min_by(F.struct("doc_id", "th", "keys", "sig"), F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("x")
    sets = staged(prints.groupBy("sh").agg(least).select("sh", "x.*"), f"{work}/sets")
    dealt = sets.select("sh", F.explode("keys").alias("key"))
    buckets = staged(dealt.groupBy("key").agg(F.array_sort(F.collect_list("sh")).alias("all")).where("size(all) > 1").select("all").distinct(), f"{work}/buckets")
    release(spark)
    met = buckets.select(F.xxhash64("all").alias("bucket"), F.explode("all").alias("sh")).join(sets.select("sh", "sig").hint("merge"), "sh")
    members = met.groupBy("bucket").agg(F.collect_list(F.struct("sh", "sig")).alias("members")).select("members")
    likely = components(spark, members.mapInArrow(_likely, "a long, b long"), f"{work}/likely").withColumnRenamed("node", "sh")
    wanted = staged(named(sets.select("sh", "doc_id", "th").join(likely.hint("merge"), "sh")).select(*NAME, "sh", "root"), f"{work}/wanted")
    texts = named(keyed(docs)).select(*NAME, "text").join(wanted.hint("merge"), NAME).groupBy(*NAME, "sh", "root").agg(F.first("text").alias("text"))
    texts = staged(texts.select("root", "sh", "text"), f"{work}/texts")
    release(spark)
    exact = texts.repartition("root").sortWithinPartitions("root").mapInArrow(partial(_exact, shingle), "a long, b long")
    root = components(spark, exact, f"{work}/exact").withColumnRenamed("node", "sh")
    own = staged(sets.select("sh").join(root.hint("merge"), "sh", "left").select("sh", F.coalesce("root", "sh").alias("root")), f"{work}/own")
    release(spark)
    root = _joined(spark, prints, own, work)
    found = staged(prints.select("doc_id", "th", "sh").join(root.hint("merge"), "sh").select("doc_id", "th", "root"), f"{work}/rooted")
    release(spark)
    return found


def deduplicated(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of docs for each component of near copies; columns as in docs."""
    work = work_dir(spark, "copies")
    return one_each(docs, copies(spark, docs, work, shingle), work)
