"""Run-length decisions: runs, pre-roll, rate scaling and envelopes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions.signal import scale_index
from frameloom.operators.gate import sequential


def runs(frames: DataFrame, key: str, order: list[str], on: str = "is_on") -> DataFrame:
    """key, start, end (frame numbers from 0, end open), is_on of every maximal run."""
    w = Window.partitionBy(key).orderBy(*order)
    out = frames.withColumn("__i", F.row_number().over(w) - 1).withColumn("__new", ~F.col(on).eqNullSafe(F.lag(on).over(w)) | (F.col("__i") == 0))
    out = out.withColumn("__n", F.count("*").over(Window.partitionBy(key))).where("__new")
    end = F.coalesce(F.lead("__i").over(Window.partitionBy(key).orderBy("__i")), F.col("__n"))
    return out.select(key, F.col("__i").cast("long").alias("start"), end.cast("long").alias("end"), F.col(on).alias("is_on"))


def preroll(rows: DataFrame, key: str, shift: int) -> DataFrame:
    """Starts of on-runs move back by shift, not past the previous start; of equal starts the later stays. The first start
    stays. Ends are dropped: a run lasts to the next start."""
    w = Window.partitionBy(key).orderBy("start")
    before = F.lag("start").over(w)
    moved = F.when(F.col("is_on") & before.isNotNull(), F.greatest(F.col("start") - shift, before)).otherwise(F.col("start"))
    out = rows.withColumn("__new", moved).withColumn("__next", F.lead(moved).over(w))
    out = out.where("__next is null or __next <> __new")
    return out.select(key, F.col("__new").cast("long").alias("start"), "is_on")


def rescaled(rows: DataFrame, key: str, to_rate: int, from_rate: int) -> DataFrame:
    """Starts at another rate; of equal starts the first stays."""
    w = Window.partitionBy(key).orderBy("start")
    out = rows.withColumn("__new", scale_index(F.col("start"), to_rate, from_rate))
    out = out.withColumn("__before", F.lag("__new").over(w)).where("__before is null or __before <> __new")
    return out.select(key, F.col("__new").alias("start"), "is_on")


def coefficient(ms: float, rate: int) -> float:
    return 1.0 if ms <= 0 else 1 - math.exp(-1000.0 / (ms * rate))


def levels(frames: DataFrame, key: str, order: list[str], hop: int, rate: int = 16_000, attack_ms: float = 15.0, release_ms: float = 100.0, carried: float = 0.0, on: str = "is_on") -> DataFrame:
    """Adds start (of the run that covers the frame) and level, the envelope at the frame's last sample; a frame has ``hop``
    samples. Attack and release go on from the level that the run before reached, the first from ``carried``.

    Runs partition the axis, so the run of a frame is the last start so far, a running window instead of a range join. The
    level at which a run begins depends on all runs before it: a fold over runs, a row a run. Frames meet it by (session,
    start), which spreads a long session over tasks."""
    w = Window.partitionBy(key).orderBy(*order)
    at = frames.withColumn("__i", F.row_number().over(w) - 1).withColumn("__new", ~F.col(on).eqNullSafe(F.lag(on).over(w)))
    at = at.withColumn("start", F.last(F.when(F.col("__new") | (F.col("__i") == 0), F.col("__i")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lasting = at.groupBy(key, "start").agg(F.first(on).alias("__on"), (F.count("*") * hop).alias("__n"))
    keep = {True: 1 - coefficient(attack_ms, rate), False: 1 - coefficient(release_ms, rate)}

    def begin():
        now = carried

        def step(turned: bool, n: int) -> tuple[float]:
            nonlocal now
            entry, now = now, float(turned) + (now - float(turned)) * keep[turned] ** n
            return (entry,)

        return step

    entry = sequential(lasting, key, ["start"], ["__on", "__n"], "entry double", begin)
    target = F.col(on).cast("double")
    kept = F.pow(F.when(F.col(on), keep[True]).otherwise(keep[False]), (F.col("__i") - F.col("start") + 1) * float(hop))
    return at.join(entry, [key, "start"]).withColumn("level", target + (F.col("entry") - target) * kept).drop("__i", "__new", "entry")


def envelope(rows: list[tuple[int, bool]], n: int, rate: int = 16_000, attack_ms: float = 15.0, release_ms: float = 100.0, start: float = 0.0):
    """The gain of each of n samples under runs (start, is_on); the first must start at 0. Starts that do not grow are skipped."""
    import numpy as np

    if not rows or rows[0][0] != 0:
        raise ValueError("the first run must start at 0")
    out, value = np.empty(n), start
    ordered = [rows[0]]
    for r in rows[1:]:
        if ordered[-1][0] < r[0]:
            ordered.append(r)
    for (a, on), b in zip(ordered, [*(r[0] for r in ordered[1:]), n], strict=True):
        b = min(b, n)
        if a >= b:
            continue
        c, target = coefficient(attack_ms if on else release_ms, rate), float(on)
        out[a:b] = target + (value - target) * (1 - c) ** np.arange(1, b - a + 1)
        value = out[b - 1]
    return out
