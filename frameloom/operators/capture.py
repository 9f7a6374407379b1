"""Quality of recordings and of overlap windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quality(samples: DataFrame, key: str, frame: int = 320) -> DataFrame:
    """key, n, rms_dbfs, peak, dc, clipped_ratio, active_ratio, verdict of samples (key, i, x); the verdict is the first check
    that fails, or 'ok'. Frames shorter than half are not counted."""
    x = F.col("x").cast("double")
    per = samples.groupBy(key, F.floor(F.col("i") / frame).alias("f")).agg(
        F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.max(F.abs(x)).alias("p"), F.count_if(F.abs(x) >= 0.995).alias("c"), F.count_if(F.isnan(x) | (F.abs(x) == float("inf"))).alias("bad")
    )
    counted = F.col("n") >= frame // 2
    out = per.groupBy(key).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("p").alias("peak"), F.sum("c").alias("c"), F.sum("bad").alias("bad"),
        F.count_if(counted).alias("frames"), F.count_if(counted & (F.sqrt(F.col("q") / F.col("n")) >= 0.006)).alias("active"),
    )
    out = out.withColumn("rms_dbfs", 20 * F.log10(F.greatest(F.sqrt(F.col("q") / F.col("n")), F.lit(1e-9)))).withColumn("dc", F.abs(F.col("s") / F.col("n")))
    out = out.withColumn("clipped_ratio", F.col("c") / F.col("n")).withColumn("active_ratio", F.col("active") / F.greatest(F.col("frames"), F.lit(1)))
    verdict = (
        F.when(F.col("bad") > 0, "broken")
        .when((F.col("rms_dbfs") < -42) | (F.col("peak") < 0.025), "quiet")
        .when(F.col("clipped_ratio") > 0.003, "clipped")
        .when(F.col("dc") > 0.05, "offset")
        .when(F.col("active_ratio") < 0.45, "inactive")
        .otherwise("ok")
    )
    return out.select(key, "n", "rms_dbfs", "peak", "dc", "clipped_ratio", "active_ratio", verdict.alias("verdict"))


def overlap_summary(frames: DataFrame, key: str, logits: str = "logits") -> DataFrame:
    """key, mean_prob, max_prob, overlap_frames, total_frames, fraction from 7 class logits a frame, the last 3 of which are
    overlaps: the sum of their sigmoids, and frames whose largest class is one of them."""
    p = F.aggregate(F.transform(F.slice(logits, 5, 3), lambda x: 1 / (1 + F.exp(-x.cast("double")))), F.lit(0.0), lambda s, x: s + x)
    top = F.array_position(F.col(logits), F.array_max(logits)) >= 5
    out = frames.groupBy(key).agg(F.avg(p).alias("mean_prob"), F.max(p).alias("max_prob"), F.count_if(top).alias("overlap_frames"), F.count("*").alias("total_frames"))
    return out.withColumn("fraction", F.col("overlap_frames") / F.greatest("total_frames", F.lit(1)))
