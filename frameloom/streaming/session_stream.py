"""Whole sessions over a stream of frames, with the batch fold's ``Session``."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from frameloom.operators.session import Session

OUT = "session long, seq long, is_on boolean, score double, cos double, f0_match double, event string"


def sessions(frames: DataFrame, start: Callable[[], Session]) -> DataFrame:
    """frames: session, seq, speech, vec, f0, reset (drop the session's state before this frame; the pool stays), each session's
    rows in order of seq across micro-batches. State is one window of vectors and a few numbers a session. With a column
    ``last``, refreshes still in flight are applied after a session's last frame, whose event they give if it has none."""
    ends = "last" in frames.columns

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = pickle.loads(state.get[0]) if state.exists else start()
        rows, out = pd.concat(list(parts)).sort_values("seq"), []
        for r in rows.itertuples():
            if r.reset:
                now.reset()
            f0 = None if r.f0 is None or pd.isna(r.f0) else float(r.f0)
            out.append((key[0], r.seq, *now.step(float(r.speech), r.vec, f0)))
            if ends and r.last and (events := now.flush()):
                out[-1] = (*out[-1][:-1], out[-1][-1] or events[-1])
        state.update((pickle.dumps(now),))
        yield pd.DataFrame(out, columns=["session", "seq", "is_on", "score", "cos", "f0_match", "event"])

    return frames.groupBy("session").applyInPandasWithState(run, OUT, "state binary", "append", GroupStateTimeout.NoTimeout)
