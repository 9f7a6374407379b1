"""The gate over a stream of frames, with the same step as the batch fold."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frameloom.operators.gate import Gate, GateConfig

OUT = "session long, seq long, is_on boolean, theta double, smoothed double"


def gated(frames: DataFrame, config: GateConfig) -> DataFrame:
    """frames: session, seq, score, other, speech, each session's rows in order of seq across micro-batches. One row a frame.
    State is a few numbers a session, so chunking does not matter."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = Gate(config, **json.loads(state.get[0])) if state.exists else Gate(config)
        rows = pd.concat(list(parts)).sort_values("seq")
        found = [gate.step(float(r.score), float(r.other), bool(r.speech)) for r in rows.itertuples()]
        kept = asdict(gate)
        kept.pop("config")
        state.update((json.dumps(kept),))
        yield pd.DataFrame({"session": key[0], "seq": rows["seq"].to_numpy(), "is_on": [f[0] for f in found], "theta": [f[1] for f in found], "smoothed": [f[2] for f in found]})

    return frames.groupBy("session").applyInPandasWithState(run, OUT, "gate string", "append", GroupStateTimeout.NoTimeout)
