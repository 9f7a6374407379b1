"""Frames, blocks and windows of ordered samples or frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def framed(rows: DataFrame, key: str, order: list[str], value: str, size: int, pad: bool = True) -> DataFrame:
    """key, block, n, samples: consecutive blocks of ``size`` values. The last one is filled up with zeros, or left out if
    ``pad`` is false, as an unfinished frame is until the end is known. A block is the unit of grouping, so a long session
    is never one group."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    placed = rows.select(key, at.alias("i"), F.col(value).cast("double").alias("x"))
    found = placed.groupBy(key, F.floor(F.col("i") / size).alias("block")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    filled = F.concat(F.transform("s", lambda s: s["x"]), F.array_repeat(F.lit(0.0), F.lit(size) - F.col("n").cast("int")))
    out = found.select(key, "block", "n", filled.alias("samples"))
    return out if pad else out.where(F.col("n") == size)


def window_starts(n: Column, size: int, hop: int, least: int) -> Column:
    """Starts of the whole windows of ``size`` in n samples, ``hop`` apart; a single one at 0 where n holds none but has
    ``least`` samples; null where there are fewer."""
    whole = F.sequence(F.lit(0).cast("long"), (n - size).cast("long"), F.lit(hop).cast("long"))
    return F.when(n >= size, whole).when(n >= least, F.array(F.lit(0).cast("long")))


def evenly_spaced(rows: DataFrame, key: str, order: list[str], most: int = 8) -> DataFrame:
    """At most ``most`` rows a key, at places i * n div wanted: adds place and n."""
    w = Window.partitionBy(key)
    out = rows.withColumn("place", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w))
    wanted = F.least(F.lit(most), F.col("n"))
    # place = i * n div wanted for the smallest i with i * n >= place * wanted
    i = F.ceil(F.col("place") * wanted / F.col("n"))
    return out.where((i < wanted) & (F.floor(i * F.col("n") / wanted) == F.col("place")))


def ahead(frames: DataFrame, key: str, order: list[str], value: str, name: str, by: int = 2, default: object = 0.0) -> DataFrame:
    """Adds the value of the frame ``by`` places later, the default past the end: a spectrum with features that look ahead."""
    return frames.withColumn(name, F.lead(value, by, default).over(Window.partitionBy(key).orderBy(*order)))


def behind(frames: DataFrame, key: str, order: list[str], value: str, name: str, by: int = 3) -> DataFrame:
    """Adds the values of the ``by`` frames before each frame, oldest first: the lookback that is put before an onset."""
    return frames.withColumn(name, F.collect_list(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(-by, -1)))


def speech_window(frames: DataFrame, key: str, order: list[str], speech: Column, value: str, size: int) -> DataFrame:
    """The speech frames with window_mean and window_n of the last ``size`` speech frames; pauses are not in the window."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - size, 0)
    return frames.where(speech).withColumn("window_mean", F.avg(value).over(w)).withColumn("window_n", F.count("*").over(w))


def rolling(frames: DataFrame, key: str, order: list[str], value: str, size: int, every: int) -> DataFrame:
    """Every ``every``-th frame once ``size`` frames are there, with window_mean and window_max of the last ``size``."""
    w = Window.partitionBy(key).orderBy(*order)
    last, rn = w.rowsBetween(1 - size, 0), F.row_number().over(w)
    out = frames.withColumn("__rn", rn).withColumn("window_mean", F.avg(value).over(last)).withColumn("window_max", F.max(value).over(last))
    return out.where((F.col("__rn") >= size) & (F.col("__rn") % every == 0)).drop("__rn")


def counter_deltas(rows: DataFrame, key: str, tick: str, counters: list[str]) -> DataFrame:
    """Adds d_<name>, the growth of each running total since the last tick; a total that went back counts as no growth."""
    w = Window.partitionBy(key).orderBy(tick)
    return rows.select("*", *(F.greatest(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)), F.lit(0)).alias(f"d_{c}") for c in counters))


def applied(gain: Column, raw: Column, processed: Column, dry: Column) -> Column:
    """Queued gains on processed samples with a share of the raw ones, all three by position; what one lacks is left out."""
    least = F.least(F.size(gain), F.size(raw), F.size(processed))
    zipped = F.arrays_zip(*(F.slice(x, F.lit(1), least).alias(n) for x, n in ((gain, "gain"), (raw, "raw"), (processed, "processed"))))
    return F.transform(zipped, lambda s: s["gain"] * (s["processed"] * (1 - dry) + s["raw"] * dry))
