"""Choosing one of two separated streams by voice, and levelling it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions.vectors import dot, rms

SILENCE, LEVEL, MOST_GAIN = 1e-5, 0.08, 100.0


def normalised(samples: Column, level: float = LEVEL) -> Column:
    """Brought to one level by a gain of 0.01 to 100, then clamped to [-1, 1]."""
    size = rms(samples)
    gain = F.when(size == 0, MOST_GAIN).otherwise(F.greatest(F.lit(0.01), F.least(F.lit(MOST_GAIN), F.lit(level) / size)))
    return F.transform(samples, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * gain)))


def audible(samples: Column) -> Column:
    return rms(samples) >= SILENCE


def stream_gain(chosen: Column, other: Column, mixture: Column) -> Column:
    """One gain for both streams that gives them the mixture's energy, at most 100; negative if the chosen stream runs against
    the mixture."""
    apart = F.sqrt(rms(chosen) * rms(chosen) + rms(other) * rms(other))
    gain = F.least(rms(mixture) / F.greatest(apart, F.lit(1e-9)), F.lit(MOST_GAIN))
    return F.when(dot(chosen, mixture) < 0, -gain).otherwise(gain)


def picked(scores: DataFrame, block: str, floor: float = 0.0) -> DataFrame:
    """block, stream, score, accepted from scores (block, stream, score): the stream of the largest score, the first on ties.
    A stream that is missing or null is silent and scores 0; below ``floor`` the block is rejected."""
    s = F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0))
    both = scores.groupBy(block).agg(*(F.coalesce(F.max(F.when(F.col("stream") == i, s)), F.lit(0.0)).alias(f"s{i}") for i in (0, 1)))
    second = F.col("s1") > F.col("s0")
    best = F.greatest("s0", "s1")
    return both.select(block, F.when(second, 1).otherwise(0).alias("stream"), best.alias("score"), (best >= floor).alias("accepted"))


def survival(samples: DataFrame, tag: str, before: str, after: str) -> DataFrame:
    """tag, rms_in, rms_out, ratio: how much of each speaker's level passes the gate."""
    out = samples.groupBy(tag).agg(*(F.sqrt(F.avg(F.col(c) * F.col(c))).alias(n) for c, n in ((before, "rms_in"), (after, "rms_out"))))
    return out.withColumn("ratio", F.when(F.col("rms_in") > 0, F.col("rms_out") / F.col("rms_in")).otherwise(0.0))
