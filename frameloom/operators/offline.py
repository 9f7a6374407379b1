"""Whole recordings at once: enrolment and processing, from samples to a profile or to gains."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameloom.functions import dsp
from frameloom.operators import profiles, runs
from frameloom.operators.gate import sequential
from frameloom.operators.session import Session

RATE, WINDOW, HOP, LEAST, FRAME = 16_000, 48_000, 24_000, 16_000, 512


def decision_view(samples: np.ndarray, rate: int, decision_rate: int = RATE) -> np.ndarray:
    """The signal at the decision rate; the very one it was given if that is its rate."""
    if rate <= 0:
        raise ValueError("the rate must be positive")
    return samples if rate == decision_rate else dsp.resample(samples, decision_rate, rate)


def windows(x: np.ndarray) -> list[np.ndarray]:
    """Three seconds each, half of that apart; a shorter recording is one window, if it holds a second."""
    if len(x) < WINDOW:
        return [x] if len(x) >= LEAST else []
    return [x[a : a + WINDOW] for a in range(0, len(x) - WINDOW + 1, HOP)]


def enrolled(recordings: DataFrame, key: str, encode: Callable[[np.ndarray], np.ndarray], clean: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """key, n, median_cos, accepted, anchors, f0_mu, f0_sigma of recordings (key, rate, samples), one or several a key.

    A recording is cleaned at its own rate first, then brought to the decision rate, cut into windows, and each window's log-mel
    frames are encoded. One recording is in memory at a time; anchors and pitch meet by key."""
    kind = recordings.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("idx", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("f0", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x, rate = np.asarray(row["samples"].flatten().to_numpy(zero_copy_only=False), float), row["rate"][0].as_py()
                x = decision_view(clean(x) if clean else x, rate)
                parts = windows(x)
                vecs = [np.asarray(encode(dsp.log_mel(part)), float).tolist() for part in parts]
                pitch = [[p for p in dsp.pitch_track(x) if p is not None]] + [[]] * (len(parts) - 1) if parts else []
                yield pa.RecordBatch.from_arrays([pa.array([row[key][0].as_py()] * len(parts), batch[key].type), pa.array([(i << 32) + k for k in range(len(parts))], pa.int64()), pa.array(vecs, pa.list_(pa.float64())), pa.array(pitch, pa.list_(pa.float64()))], [key, "idx", "vec", "f0"])

    found = recordings.select(key, "rate", "samples").mapInArrow(run, schema)
    rows = found.select(F.col(key).alias("grp"), F.row_number().over(profiles.Window.partitionBy(key).orderBy("idx", "vec")).alias("idx"), "vec")
    anchors = rows.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "vec"))), lambda s: s["vec"]).alias("anchors"))
    pitch = profiles.f0_statistics(found.select(key, F.explode_outer("f0").alias("f0")), key, "f0").withColumnRenamed(key, "grp")
    return profiles.consistency(rows).join(anchors, "grp").join(pitch, "grp").withColumnRenamed("grp", key)


def processed(frames: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[], Session], audio_rate: int = 48_000, pre_roll_ms: float = 0.0, release_ms: float = 100.0) -> tuple[DataFrame, DataFrame]:
    """Sessions of frames (columns: speech, vector, pitch, as ``Session.step`` takes them) from first to last frame: the frames with
    decision, score, cosine, pitch match, event and level, and the runs (key, start, is_on) in samples of the audio.

    A refresh takes its frames of latency here too, so the result is what a live session would have given."""
    if audio_rate < RATE:
        raise ValueError("the audio's rate is at least the decision rate")

    def begin():
        return start().step

    decided = sequential(frames, key, order, columns, "is_on boolean, score double, cos double, f0_match double, event string", begin)
    turned = runs.runs(decided, key, order).select(key, (F.col("start") * FRAME).alias("start"), "is_on")
    if pre_roll_ms:
        turned = runs.preroll(turned, key, int(pre_roll_ms * RATE / 1000))
    return runs.levels(decided, key, order, FRAME, release_ms=release_ms), runs.rescaled(turned, key, audio_rate, RATE)
