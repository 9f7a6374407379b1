"""Queries on blocks of samples, with DuckDB counterparts: a vector of ``embeddings`` stands for a block of 64 samples, the
scores of a user of ``events`` in order for a longer signal."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions import dsp, signal, vectors
from frameloom.operators import framing, gate, separation, stages
from frameloom.sources import audio, settings
from frameloom.sources import profiles as documents


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("label").cast("long").alias("grp"), F.col("embedding").cast("array<double>").alias("x"))


def _spread(rows: DataFrame, samples, digits: int = 6, key: str = "vec_id") -> DataFrame:
    """A row a sample: key, pos (from 0), x."""
    return rows.select(key, F.posexplode(samples).alias("pos", "x")).select(key, F.col("pos").cast("long").alias("pos"), (F.round(F.col("x").cast("double"), digits) + F.lit(0.0)).alias("x"))


def downmixed(spark, sf):
    """Blocks as four interleaved channels, as their mean."""
    return _spread(_blocks(spark, sf), signal.downmix(F.col("x"), 4))


def wet_dry_mix(spark, sf):
    """A block mixed with its reverse."""
    return _spread(_blocks(spark, sf), signal.mix(F.col("x"), F.reverse("x"), F.lit(0.3)))


def dithered_blocks(spark, sf):
    return _spread(_blocks(spark, sf), signal.dithered(F.col("x")), 9)


def faded_blocks(spark, sf):
    """Blocks of 64 brought to 80 samples, faded over 12."""
    return _spread(_blocks(spark, sf), signal.edge_faded(signal.force_length(F.col("x"), 80), 12))


def levelled_blocks(spark, sf):
    return _blocks(spark, sf).select("vec_id", F.round(vectors.rms(separation.normalised(F.col("x"))), 6).alias("level"), separation.audible(F.col("x")).alias("audible"))


def stream_gains(spark, sf):
    """Two streams, a block and its reverse, against a mixture."""
    both = F.zip_with("x", F.reverse("x"), lambda a, b: a - b / 2)
    return _blocks(spark, sf).select("vec_id", F.round(separation.stream_gain(F.col("x"), F.reverse("x"), both), 6).alias("gain"))


def gain_zip(spark, sf):
    """Queued gains with raw and processed samples by position."""
    rows = _blocks(spark, sf).select("vec_id", F.transform("x", lambda x, i: i / 64.0).alias("gain"), F.col("x").alias("raw"), F.reverse("x").alias("processed"))
    return _spread(rows, framing.applied(F.col("gain"), F.col("raw"), F.col("processed"), F.lit(0.25)))


def lag_difference(spark, sf):
    return _spread(_blocks(spark, sf), dsp.difference_udf(16)("x"))


def normalised_difference(spark, sf):
    return _spread(_blocks(spark, sf), dsp.normalised_udf(16)("x"))


def resampled_blocks(spark, sf):
    return _spread(_blocks(spark, sf), dsp.resample_udf(24_000, 16_000)("x"))


def log_mel_blocks(spark, sf):
    """Blocks of 64 samples have one frame of 80 bands."""
    return _spread(_blocks(spark, sf).withColumn("mel", F.element_at(dsp.log_mel_udf("x"), 1)), F.col("mel"), 2)


def wav_round_trip(spark, sf):
    """Blocks written as files and read again, as 16-bit numbers."""
    found = audio.decoded(_blocks(spark, sf).select("vec_id", audio.encoded(16_000)("x").alias("content")))
    return _spread(found, F.transform("samples", lambda x: x.cast("double") * 32767), 0)


def profile_round_trip(spark, sf):
    """Profiles written as JSON and read again: the sums of their anchors and evidence."""
    by = _blocks(spark, sf).groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x"))), lambda s: s["x"]).alias("anchors"), F.max_by("x", "vec_id").alias("evidence"))
    rows = documents.rendered(by.withColumns({"f0_mu": F.lit(120.0), "f0_sigma": F.col("grp") + 1.0})).select("grp", "value")
    total = F.aggregate("anchors", F.lit(0.0), lambda s, a: s + F.element_at(a, 1))
    return documents.parsed(rows).select("grp", F.size("anchors").cast("long").alias("n"), F.round(total, 6).alias("total"), F.round(F.element_at("evidence", 64), 6).alias("last"), "f0_mu", "f0_sigma")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("score", F.least(F.col("value") / 100, F.lit(1.0)))


def makeup_gains(spark, sf):
    return _events(spark, sf).select("event_id", F.round(signal.makeup_gain(F.lit(0.5), F.col("value") / 1000, 3.0), 6).alias("gain"))


def crossfaded_gains(spark, sf):
    return _events(spark, sf).select("event_id", F.round(signal.crossfade(F.lit(2.0), F.lit(0.5), F.col("value") * 100 / 7), 6).alias("gain"))


def fused_scores(spark, sf):
    match = gate.pitch_match(F.col("value"), F.lit(90.0), F.lit(40.0))
    return _events(spark, sf).select("event_id", F.round(gate.fused(F.col("score"), match, 0.2, 0.5), 6).alias("score"))


def settings_text(spark, sf):
    """Whole values as settings of both versions and of neither."""
    text = F.concat_ws(" ", F.element_at(F.array(F.lit("v2"), F.lit(None).cast("string"), F.lit("v3")), (F.col("event_id") % 3 + 1).cast("int")), (F.floor("value") / 100).cast("string"), F.lit("300"), F.lit("5000"))
    found = _events(spark, sf).select("event_id", settings.gate_settings(text).alias("s"), settings.separator_threshold((F.floor("value") / 100).cast("string")).alias("separator"))
    return found.select("event_id", "s.threshold", "s.hangover_ms", "s.release_ms", "separator")


def resampled_sessions(spark, sf):
    """A user's scores at three halves of their rate, taken ten at a time and given out in sevens."""
    found = stages.through(_events(spark, sf), "user_id", ["ts", "event_id"], "score", lambda: stages.Resampler(3, 2, fixed_out=7, fixed_in=10), 16)
    return found.select("user_id", "block", F.posexplode("samples").alias("i", "x")).select("user_id", (F.col("block") * 7 + F.col("i")).alias("pos"), F.round("x", 6).alias("x"))


def separator_blocks(spark, sf):
    """Blocks of ten scores through a stand-in for a separator; the last one is as short as it came."""
    found = stages.through(_events(spark, sf), "user_id", ["ts", "event_id"], "score", lambda: stages.Blocks(10, lambda x: x / max(float(np.sqrt(np.mean(x * x))), 1e-9)), 16)
    return found.select("user_id", "block", F.posexplode("samples").alias("i", "x")).select("user_id", (F.col("block") * 10 + F.col("i")).alias("pos"), F.round("x", 6).alias("x"))


def ring_levels(spark, sf):
    """The level of the last 20 scores, once every five."""
    found = stages.through(_events(spark, sf), "user_id", ["ts", "event_id"], "score", lambda: stages.Ring(20, lambda x: float(np.sqrt(np.mean(x * x)))), 5)
    return found.where(F.size("samples") > 0).select("user_id", "block", F.round(F.element_at("samples", 1), 6).alias("level"))


QUERIES: dict = {f.__name__: f for f in (
    downmixed, wet_dry_mix, dithered_blocks, faded_blocks, levelled_blocks, stream_gains, gain_zip, lag_difference, normalised_difference, resampled_blocks, log_mel_blocks, wav_round_trip,
    profile_round_trip, makeup_gains, crossfaded_gains, fused_scores, settings_text, resampled_sessions, separator_blocks, ring_levels,
)}

_V = "WITH v AS (SELECT vec_id, CAST(label AS BIGINT) AS grp, embedding::DOUBLE[] AS v FROM embeddings)"
_S = _V + ", s AS (SELECT vec_id, i, v[i + 1] AS x, v[64 - i] AS y FROM (SELECT vec_id, v, unnest(range(64)) AS i FROM v))"
_E = "SELECT *, least(value / 100, 1e0) AS score, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events"
_SINC = """taps AS (SELECT *, CASE WHEN t = 0 THEN 1e0 ELSE sin(pi() * t) / (pi() * t) END * CASE WHEN abs(t) < 16 THEN 5e-1 + 5e-1 * cos(pi() * t / 16) ELSE 0 END AS w
  FROM (SELECT {0}, k, i, k * 2 / 3e0 - i AS t FROM (SELECT {0}, k, unnest(range(k * 2 // 3 - 15, k * 2 // 3 + 17)) AS i FROM outs)))
SELECT taps.{0}, k AS pos, round(sum(w * coalesce(x, 0)) / sum(w), 6) AS x FROM taps LEFT JOIN sig ON sig.{0} = taps.{0} AND sig.i = taps.i GROUP BY 1, 2"""

ORACLES: dict = {
    "downmixed": _S + " SELECT vec_id, CAST(i // 4 AS BIGINT) AS pos, round(sum(x) / 4, 6) AS x FROM s GROUP BY 1, 2",
    "wet_dry_mix": _S + " SELECT vec_id, i AS pos, round(x * 3e-1 + y * (1 - 3e-1), 6) AS x FROM s",
    "dithered_blocks": _S + " SELECT vec_id, i AS pos, round(x + CASE WHEN i % 2 = 0 THEN 1e-7 ELSE -1e-7 END, 9) AS x FROM s",
    "faded_blocks": _V + """, s AS (SELECT vec_id, v, unnest(range(80)) AS i FROM v)
SELECT vec_id, i AS pos, round(greatest(-1e0, least(1e0, CASE WHEN i < 64 THEN v[i + 1] ELSE 0e0 END * CASE WHEN i < 12 THEN i / 12e0 WHEN i > 67 THEN (79 - i) / 12e0 ELSE 1 END)), 6) + 0e0 AS x FROM s""",
    "levelled_blocks": _S + """, r AS (SELECT vec_id, sqrt(avg(x * x)) AS r FROM s GROUP BY 1), g AS (SELECT *, CASE WHEN r = 0 THEN 100 ELSE greatest(1e-2, least(1e2, 8e-2 / r)) END AS g FROM r)
SELECT vec_id, round(sqrt(avg(greatest(-1e0, least(1e0, x * g)) * greatest(-1e0, least(1e0, x * g)))), 6) AS level, any_value(r) >= 1e-5 AS audible FROM s JOIN g USING (vec_id) GROUP BY 1""",
    "stream_gains": _S + """ SELECT vec_id, round(CASE WHEN sum(x * (x - y / 2)) < 0 THEN -1 ELSE 1 END * least(sqrt(avg((x - y / 2) * (x - y / 2))) / greatest(sqrt(avg(x * x) + avg(y * y)), 1e-9), 1e2), 6) AS gain FROM s GROUP BY 1""",
    "gain_zip": _S + " SELECT vec_id, i AS pos, round(i / 64e0 * (y * (1 - 25e-2) + x * 25e-2), 6) + 0e0 AS x FROM s",
    "lag_difference": _S + """, d AS (SELECT a.vec_id, b.i - a.i AS pos, sum((a.x - b.x) * (a.x - b.x)) AS d FROM s a JOIN s b ON a.vec_id = b.vec_id AND b.i >= a.i AND b.i - a.i < 16 GROUP BY 1, 2)
SELECT vec_id, pos, round(d, 6) AS x FROM d""",
    "normalised_difference": _S + """, d AS (SELECT a.vec_id, b.i - a.i AS pos, sum((a.x - b.x) * (a.x - b.x)) AS d FROM s a JOIN s b ON a.vec_id = b.vec_id AND b.i >= a.i AND b.i - a.i < 16 GROUP BY 1, 2),
r AS (SELECT *, sum(d) OVER (PARTITION BY vec_id ORDER BY pos) AS run FROM d WHERE pos > 0)
SELECT vec_id, pos, round(CASE WHEN run > 0 THEN d * pos / run ELSE 1 END, 6) AS x FROM r UNION ALL SELECT vec_id, 0, 1e0 FROM v""",
    "resampled_blocks": _S + ", sig AS (SELECT vec_id, i, x FROM s), outs AS (SELECT vec_id, unnest(range(96)) AS k FROM v), " + _SINC.format("vec_id"),
    "log_mel_blocks": _S + """, f AS (SELECT unnest(range(201)) AS k),
p AS (SELECT vec_id, k, sum(x * w * cos(2 * pi() * k * n / 400)) AS re, sum(x * w * sin(2 * pi() * k * n / 400)) AS im
  FROM (SELECT vec_id, x, i + 200 AS n, 54e-2 - 46e-2 * cos(2 * pi() * (i + 200) / 400) AS w FROM s) CROSS JOIN f GROUP BY 1, 2),
e AS (SELECT m, 700 * (pow(10e0, 2595 * log10(1 + 8000 / 700e0) * m / 81 / 2595) - 1) AS hz FROM (SELECT unnest(range(82)) AS m)),
b AS (SELECT lo.m, lo.hz AS lo, mid.hz AS mid, hi.hz AS hi FROM e lo JOIN e mid ON mid.m = lo.m + 1 JOIN e hi ON hi.m = lo.m + 2),
y AS (SELECT vec_id, m, 10 * log10(greatest(sum((re * re + im * im) * greatest(0, least((k * 40 - lo) / (mid - lo), (hi - k * 40) / (hi - mid)))), 1e-10)) AS db FROM p CROSS JOIN b GROUP BY 1, 2)
SELECT vec_id, m AS pos, round(greatest(db, max(db) OVER (PARTITION BY vec_id) - 80), 2) + 0e0 AS x FROM y""",
    "wav_round_trip": _S + " SELECT vec_id, i AS pos, trunc(greatest(-1e0, least(1e0, x)) * 32767) + 0e0 AS x FROM s",
    "profile_round_trip": _V + " SELECT grp, count(*) AS n, round(sum(v[1]), 6) AS total, round(arg_max(v[64], vec_id), 6) AS last, 12e1 AS f0_mu, grp + 1e0 AS f0_sigma FROM v GROUP BY 1",
    "makeup_gains": "SELECT event_id, round(pow(10e0, 3 / 20e0) * least(5e-1 / greatest(value / 1000, 1e-9), 10e0), 6) AS gain FROM events",
    "crossfaded_gains": "SELECT event_id, round(2e0 + (5e-1 - 2e0) * least(1e0, greatest(0e0, value * 100 / 7 / 9600e0)), 6) AS gain FROM events",
    "fused_scores": "SELECT event_id, round(least(value / 100, 1e0) + 2e-1 * (exp(-5e-1 * ((value - 90) / 40) * ((value - 90) / 40)) - 5e-1), 6) AS score FROM events",
    "settings_text": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN least(95e-2, greatest(5e-2, t)) WHEN 1 THEN least(95e-2, greatest(45e-2, t)) END AS threshold,
  CASE WHEN event_id % 3 < 2 THEN 3e2 END AS hangover_ms, CASE WHEN event_id % 3 < 2 THEN 2e3 END AS release_ms, CASE WHEN t BETWEEN 5e-2 AND 95e-2 THEN t ELSE 45e-2 END AS separator FROM (SELECT event_id, floor(value) / 100 AS t FROM events)""",
    "resampled_sessions": f"WITH e AS ({_E}), sig AS (SELECT user_id, rn - 1 AS i, score AS x FROM e), outs AS (SELECT user_id, unnest(range((count(*) * 3 + 1) // 2)) AS k FROM e GROUP BY 1), " + _SINC.format("user_id"),
    "separator_blocks": f"WITH e AS ({_E}) SELECT user_id, rn - 1 AS pos, round(score / greatest(sqrt(sum(score * score) OVER (PARTITION BY user_id, (rn - 1) // 10) / 10), 1e-9), 6) AS x FROM e",
    "ring_levels": f"""WITH e AS ({_E}), w AS (SELECT *, sqrt(avg(score * score) OVER (PARTITION BY user_id ORDER BY rn ROWS 19 PRECEDING)) AS level, count(*) OVER (PARTITION BY user_id) AS n FROM e)
SELECT user_id, (rn - 1) // 5 AS block, round(level, 6) AS level FROM w WHERE rn >= 20 AND (rn % 5 = 0 OR rn = n)""",
}
