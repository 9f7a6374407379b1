"""Diagnostics of a session as one JSON document (version 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rendered(frames: DataFrame, runs: DataFrame, key: str, rate: int = 16_000, audio_rate: int = 48_000, frame: int = 512) -> DataFrame:
    """key, value: per-frame arrays, runs as [start, on] and learning events.

    frames: key, frame_idx, is_on, score, cos, f0_match, event (null if none); runs: key, start, is_on. A document holds its
    whole session, so one session is one row by the format's nature.
    """
    row = F.struct("frame_idx", "is_on", "score", "cos", "f0_match", "event")
    per = frames.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("f"))
    turned = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "is_on"))).alias("r"))
    events = F.transform(F.filter("f", lambda x: x["event"].isNotNull()), lambda x: F.struct(x["frame_idx"].alias("frame_idx"), x["event"].alias("kind"), x["score"].alias("score"), x["f0_match"].alias("f0_match")))
    # JSON arrays of mixed types are put together as text
    pairs = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("r", F.array().cast("array<struct<start: long, is_on: boolean>>")), lambda x: F.concat(F.lit("["), x["start"].cast("string"), F.lit(","), x["is_on"].cast("string"), F.lit("]"))), ","), F.lit("]"))
    parts = {
        "gate_per_frame": F.to_json(F.transform("f", lambda x: x["is_on"])), "score_per_frame": F.to_json(F.transform("f", lambda x: x["score"])),
        "cos_sim_max_per_frame": F.to_json(F.transform("f", lambda x: x["cos"])), "f0_match_per_frame": F.to_json(F.transform("f", lambda x: x["f0_match"])),
        "gate_decisions": pairs, "auto_learn_events": F.to_json(events),
    }
    head = f'{{"version":1,"sample_rate":{rate},"audio_sample_rate":{audio_rate},"vad_frame_samples":{frame}'
    body = [x for name, part in parts.items() for x in (F.lit(f',"{name}":'), part)]
    return per.join(turned, key, "left").select(key, F.concat(F.lit(head), *body, F.lit("}")).alias("value"))
