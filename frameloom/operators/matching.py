"""Matching vectors against pools and cohorts.

Reference rows (anchors, cohorts) are sent to the tasks in blocks of at most ``block_rows`` rows, so the size of a broadcast is
bounded. One block, which holds any pool of enrolments, is one scan of the probes without a shuffle. With more blocks each has a
scan of its own, whose result is merged into a checkpoint of what the blocks so far gave; then its broadcast is destroyed, so
that one block is alive at a time. Dot products are matrix products over Arrow batches, and what a probe keeps of a block (a
best group, its own group, the k largest) is found inside the batch.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS, TOP = 20_000, 20


def _blocks(rows: DataFrame, block_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, groups) of the reference rows (grp, vec)."""
    vecs, groups = [], []
    for r in rows.select(F.col("grp").cast("long"), "vec").toLocalIterator():
        vecs.append(r[1])
        groups.append(r[0])
        if len(vecs) == block_rows:
            yield np.array(vecs, np.float64), np.array(groups, np.int64)
            vecs, groups = [], []
    if vecs:
        yield np.array(vecs, np.float64), np.array(groups, np.int64)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch[name]
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _checkpointed(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="frameloom-"))
    return df.checkpoint()


class _Groups:
    """A block of unit vectors sorted by group, and the cosines of probes with it."""

    def __init__(self, vectors: np.ndarray, groups: np.ndarray) -> None:
        order = np.argsort(groups, kind="stable")
        self.names, self.heads = np.unique(groups[order], return_index=True)
        self.table = _unit(vectors)[order].T

    def best(self, batch: pa.RecordBatch) -> np.ndarray:
        """By probe and group, the largest cosine."""
        return np.maximum.reduceat(_unit(_matrix(batch, "vec")) @ self.table, self.heads, axis=1)


def _scans(probes: DataFrame, rows: DataFrame, block_rows: int, prepare: Callable, keep: Callable, schema: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """keep(prepare(block), batch of probes) gives arrays of the schema's columns; merge joins those of several blocks."""
    spark, names = probes.sparkSession, [part.split()[0] for part in schema.split(", ")]
    blocks, so_far = _blocks(rows, block_rows), None
    block = next(blocks, None)
    while block is not None:
        following = next(blocks, None)
        sent = spark.sparkContext.broadcast(prepare(*block))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    yield pa.RecordBatch.from_arrays(keep(sent.value, batch.slice(at, 1024)), names)

        found = probes.mapInArrow(run, schema)
        if so_far is None and following is None:
            return found
        so_far = _checkpointed(merge(found if so_far is None else so_far.unionByName(found)))
        sent.destroy()
        block = following
    return so_far


def _probes(probes: DataFrame, key: str, vec: str, **more: str) -> DataFrame:
    return probes.select(F.col(key).cast("long").alias("key"), F.col(vec).alias("vec"), *(F.col(c).cast("double" if n == "raw" else "long").alias(n) for n, c in more.items()))


def best_by_group(probes: DataFrame, rows: DataFrame, key: str = "vec_id", vec: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, grp, cos: the largest cosine of each probe with each group of reference rows (grp, vec), a row a pair; a zero vector
    has 0. ``best_profile`` and ``own_profile`` leave a row a probe."""
    own = _probes(probes, key, vec)

    def keep(block: _Groups, batch: pa.RecordBatch) -> list[pa.Array]:
        best, ids = block.best(batch), batch["key"].to_numpy(zero_copy_only=False)
        return [pa.array(np.repeat(ids, len(block.names)), pa.int64()), pa.array(np.tile(block.names, len(ids))), pa.array(best.ravel())]

    found = _scans(own, rows, block_rows, _Groups, keep, "key long, grp long, cos double", lambda x: x.groupBy("key", "grp").agg(F.max("cos").alias("cos")))
    return own.select("key", F.lit(None).cast("long").alias("grp"), F.lit(None).cast("double").alias("cos")).limit(0) if found is None else found


def best_profile(probes: DataFrame, rows: DataFrame, key: str = "vec_id", vec: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, grp, score of the best group of reference rows; the score is floored at 0, the smallest group wins ties. One row a
    probe leaves each batch."""
    own = _probes(probes, key, vec)

    def keep(block: _Groups, batch: pa.RecordBatch) -> list[pa.Array]:
        best = block.best(batch)
        at = best.argmax(axis=1)  # the first, which is the smallest group
        return [batch["key"], pa.array(block.names[at]), pa.array(best[np.arange(len(at)), at])]

    def merge(parts: DataFrame) -> DataFrame:
        top = parts.groupBy("key").agg(F.max(F.struct("cos", (-F.col("grp")).alias("g"))).alias("x"))
        return top.select("key", (-F.col("x.g")).alias("grp"), "x.cos")

    found = _scans(own, rows, block_rows, _Groups, keep, "key long, grp long, cos double", merge)
    if found is None:
        return own.select("key", F.lit(None).cast("long").alias("grp"), F.lit(0.0).alias("score")).limit(0)
    return found.select("key", "grp", F.greatest("cos", F.lit(0.0)).alias("score"))


def own_profile(probes: DataFrame, rows: DataFrame, key: str = "vec_id", vec: str = "embedding", own: str = "grp", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, vec, grp, raw: the largest cosine of each probe with its own group of reference rows, floored at 0; probes of a
    group without rows are left out."""
    mine = _probes(probes, key, vec, grp=own)

    def keep(block: _Groups, batch: pa.RecordBatch) -> list[pa.Array]:
        best, grp = block.best(batch), batch["grp"].to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(block.names, grp), len(block.names) - 1)
        known = block.names[at] == grp
        raw = np.maximum(best[np.arange(len(at)), at], 0.0)
        return [x.filter(pa.array(known)) for x in (batch["key"], batch["vec"], batch["grp"], pa.array(raw))]

    kind = mine.schema["vec"].dataType.simpleString()
    found = _scans(mine, rows, block_rows, _Groups, keep, f"key long, vec {kind}, grp long, raw double", lambda x: x.groupBy("key", "grp").agg(F.first("vec").alias("vec"), F.max("raw").alias("raw")).select("key", "vec", "grp", "raw"))
    return mine.withColumn("raw", F.lit(0.0)).limit(0) if found is None else found


def as_norm(probes: DataFrame, cohort: DataFrame, k: int = TOP, key: str = "vec_id", vec: str = "embedding", raw: str = "raw", own: str = "grp", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, raw, score: raw less the mean of the k largest dot products of the unit probe with cohort rows (grp, vec) of other
    groups, over their population deviation. An empty cohort, k = 0 or a zero probe gives raw; no deviation gives raw - mean."""
    mine = _probes(probes, key, vec, raw=raw, grp=own)

    def keep(block: tuple[np.ndarray, np.ndarray], batch: pa.RecordBatch) -> list[pa.Array]:
        table, groups = block
        unit = _unit(_matrix(batch, "vec"))
        dots = np.where(groups[None, :] == batch["grp"].to_numpy(zero_copy_only=False)[:, None], -np.inf, unit @ table)
        n = min(k, dots.shape[1])
        top = np.partition(dots, -n, axis=1)[:, -n:]
        some = (np.abs(unit).sum(1) > 0)[:, None] & np.isfinite(top)
        return [batch["key"], batch["raw"], pa.array([row[x].tolist() for row, x in zip(top, some, strict=True)], pa.list_(pa.float64()))]

    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy("key", "raw").agg(F.slice(F.sort_array(F.flatten(F.collect_list("top")), False), 1, k).alias("top"))

    parts = _scans(mine, cohort, block_rows, lambda v, g: (v.T, g), keep, "key long, raw double, top array<double>", merge) if k > 0 else None
    if parts is None:
        return mine.select("key", "raw", F.col("raw").alias("score"))
    return parts.select("key", "raw", normed(F.col("raw"), F.col("top")).alias("score"))


def normed(raw, top):
    """raw against the mean and population deviation of an array of cohort scores."""
    n = F.size(top)
    mean = F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / n
    square = F.aggregate(F.transform(top, lambda x: x - mean), F.lit(0.0), lambda s, x: s + x * x)
    sigma = F.sqrt(square / n)
    return F.when(n == 0, raw).when(sigma < 1e-12, raw - mean).otherwise((raw - mean) / sigma)


def match_score(probes: DataFrame, conditions: DataFrame, adapted: DataFrame, key: str = "vec_id", vec: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, grp, score: how well each probe matches each profile, the largest cosine with a condition mean (grp, centroid) or the
    adapted vector (grp, adapted; null if nothing was learned), floored at 0."""
    known = conditions.select("grp", F.col("centroid").cast("array<double>").alias("vec"))
    known = known.unionByName(adapted.where(F.col("adapted").isNotNull()).select("grp", F.col("adapted").cast("array<double>").alias("vec")))
    return best_by_group(probes, known, key, vec, block_rows).select("key", "grp", F.greatest("cos", F.lit(0.0)).alias("score"))
