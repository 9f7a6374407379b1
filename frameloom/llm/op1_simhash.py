"""SimHash near-dedup with covering locality-sensitive hashing.

Every fingerprint bit i gets a vector m(i) in {0,1}^(r+1), and every nonzero v in {0,1}^(r+1) a mask of the bits with
<m(i), v> = 1. Two fingerprints that differ in at most r bits span at most r vectors, so some v is orthogonal to all of
them: the pair agrees on that mask. 2^(r+1) - 1 tables thus hold every pair within the radius.

Copies collapse first: the tables hold distinct fingerprints. Buckets of up to ``bucket_limit`` fingerprints are compared in
one task and leave a spanning forest, never all pairs. What lies in one larger bucket agrees on its mask, so it is dealt again
by the same construction over the bits that the mask leaves open: of n open bits a new mask fixes about four sevenths (radius
2), every pair within the radius still meets in some bucket, and after three rounds a bucket cannot hold over 2^5 distinct
fingerprints. Buckets of tables with 9 open bits or fewer hold 512 at most and are always compared.

Defined results: null, empty and white-space texts have fingerprint zero and are linked like any other. Very long texts are
read whole, 65,536 shingles at a time. Repeated rows share a fingerprint, and ties in doc_id fall to the least text hash. Null
doc_ids never name a component that holds another id. Extra columns of any name are ignored, and kept by ``deduplicated``; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import keyed, one_each, release, slices, staged, work_dir
from frameloom.llm.components import components

RADIUS, SHINGLE, SEED, BUCKET_LIMIT = 2, 3, 42, 512


def simhash(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint of a text."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    first = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(first)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = [digest(joined[a:b], seed) for a, b in zip(first[at : at + 65536], ends[k - 1 + at : k - 1 + at + 65536].tolist(), strict=True)]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1024):
        found = [simhash(t.as_buffer().to_pybytes() if t.is_valid else None, shingle) for t in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(found, pa.int64())], ["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, th (text hash), fp (signed long)."""
    return keyed(docs).mapInArrow(partial(_fingerprints, shingle), "doc_id long, th long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int = RADIUS, bits: list[int] | None = None) -> list[int]:
    """Signed masks over the given bits, one a table: two values that differ in at most ``radius`` of these bits agree on one."""
    bits, whole = list(range(64)) if bits is None else bits, 2 ** (radius + 1)
    vectors = [i % (whole - 1) + 1 for i in range(len(bits))]
    return [_signed(sum(1 << b for b, m in zip(bits, vectors, strict=True) if (m & v).bit_count() % 2)) for v in range(1, whole)]


def _forest(radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket, edges that join the fingerprints within the radius of each other, one less than a component has."""
    for batch in slices(batches):
        a, b = [], []
        for bucket in batch["fps"].to_pylist():
            x = np.array(bucket, np.int64).view(np.uint64)
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
            left = np.ones(len(x), bool)
            for i in range(len(x)):
                if not left[i]:
                    continue
                queue = [i]
                left[i] = False
                while queue:
                    j = queue.pop()
                    new = np.flatnonzero(near[j] & left)
                    left[new] = False
                    queue += new.tolist()
                    a += [int(x[j].view(np.int64))] * len(new)
                    b += x[new].view(np.int64).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(fps: DataFrame, work: str, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints within the radius."""
    if not 1 <= radius <= 4:
        raise ValueError("radius: 1 to 4")
    spark = fps.sparkSession
    tables = {0: 0}  # the signed mask of each table of this round, before its bits are dealt out
    large, edges, step = fps.select(F.lit(0).alias("t"), "fp"), None, 0
    while True:
        new = []
        for t, mask in tables.items():
            open_bits = [b for b in range(64) if not mask >> b & 1]
            new += [(t, len(new) + i, mask | m) for i, m in enumerate(masks(radius, open_bits))]
        tables = {i: m for _, i, m in new}
        deal = F.broadcast(spark.createDataFrame(new, "t int, i int, mask long"))  # 7, 49 or 343 rows at radius 2
        dealt = staged(large.join(deal, "t").select(F.col("i").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"), f"{work}/tables-{step}")
        full = staged(dealt.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), f"{work}/buckets-{step}")
        met = dealt.join(full.hint("merge"), ["t", "key"])
        few = [i for i, m in tables.items() if 64 - (m % (1 << 64)).bit_count() <= 9]
        small = (F.col("n") <= bucket_limit) | F.col("t").isin(few)
        found = met.where(small).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(partial(_forest, radius), "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        if not full.where(~small).limit(1).count():
            return edges
        large, step = met.where(~small).select("t", "fp"), step + 1


def rooted(spark: SparkSession, prints: DataFrame, work: str, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """fp, lo (smallest doc_id under it), root (least fingerprint that links reach)."""
    fps = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("lo")), f"{work}/distinct")
    root = components(spark, links(fps, work, radius, bucket_limit), work)
    release(spark)
    return staged(fps.join(root.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "lo", F.coalesce("root", "fp").alias("root")), f"{work}/rooted")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach), one row a row of docs."""
    work = work_dir(spark, "simhash")
    prints = staged(fingerprints(docs, shingle), f"{work}/fingerprints")
    roots = rooted(spark, prints, work, radius, bucket_limit)
    least = staged(roots.groupBy("root").agg(F.min("lo").alias("component_id")), f"{work}/least")
    named = staged(roots.join(least.hint("merge"), "root").select("fp", "component_id"), f"{work}/named")
    return prints.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def deduplicated(spark: SparkSession, docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each component; columns as in docs."""
    work = work_dir(spark, "simhash")
    prints = staged(fingerprints(docs, shingle), f"{work}/fingerprints")
    roots = rooted(spark, prints, work, radius)
    return one_each(docs, prints.join(roots.select("fp", "root").hint("merge"), "fp"), work)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
