"""A stage of ``operators.stages`` over a stream of samples."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def staged(pieces: DataFrame, start: Callable[[], object]) -> DataFrame:
    """session, block, samples. pieces: session, seq, samples, last (flush after this piece and forget the session), each
    session's rows in order of seq across micro-batches. State is the stage."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stage, number = pickle.loads(state.get[0]) if state.exists else (start(), 0)
        out = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples():
            out += stage.push(np.asarray(r.samples, float))
            if r.last:
                out += stage.flush()
        rows = pd.DataFrame({"session": key[0], "block": range(number, number + len(out)), "samples": out})
        if r.last:
            state.remove()
        else:
            state.update((pickle.dumps((stage, number + len(out))),))
        yield rows

    return pieces.groupBy("session").applyInPandasWithState(run, "session long, block long, samples array<double>", "state binary", "append", GroupStateTimeout.NoTimeout)
