"""Stages that take samples in pieces of any size and give whole blocks: resampling, blocks through a model, rings.

A stage has ``push(samples)`` and ``flush()``, which both return a list of arrays, and ``reset()``. ``through`` runs a stage over every
session of a table; ``streaming.stage_stream`` runs it over a stream. What a stage holds is bounded by its block or ring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from frameloom.functions import dsp
from frameloom.operators.gate import dealt


class Blocks:
    """Whole blocks of ``size`` samples, each through ``work``. A block whose work fails is gone; the samples behind it stay.
    The last, short block is filled with zeros, and only as many samples come back as it had."""

    def __init__(self, size: int, work: Callable[[np.ndarray], np.ndarray] = np.array) -> None:
        if size < 1:
            raise ValueError("a block has at least one sample")
        self.size, self.work = size, work
        self.reset()

    def reset(self) -> None:
        self.held = np.empty(0)

    def push(self, samples: np.ndarray) -> list[np.ndarray]:
        self.held, out = np.concatenate([self.held, samples]), []
        while len(self.held) >= self.size:
            block, self.held = self.held[: self.size], self.held[self.size :]
            out.append(np.asarray(self.work(block), float))
        return out

    def flush(self) -> list[np.ndarray]:
        n, block = len(self.held), np.pad(self.held, (0, self.size - len(self.held)))
        self.reset()
        return [np.asarray(self.work(block), float)[:n]] if n else []


class Resampler:
    """Windowed-sinc resampling of a signal that arrives in pieces, equal to ``dsp.resample`` of the whole. With ``fixed_out``
    samples come in blocks of that size (the last one shorter); with ``fixed_in`` input is taken in blocks of that size and
    the residue is kept, without padding."""

    def __init__(self, to_rate: int, from_rate: int, fixed_out: int = 0, fixed_in: int = 0) -> None:
        self.kernel = dsp.Sinc(to_rate, from_rate)
        self.fixed_out, self.fixed_in = fixed_out, fixed_in
        self.reset()

    def reset(self) -> None:
        self.waiting, self.held, self.first = np.empty(0), np.empty(0), 0  # not yet taken; taken, from input place ``first`` on
        self.made, self.ready = 0, np.empty(0)

    def _taken(self, last: bool) -> np.ndarray:
        """What can now be made of the input taken so far; at the end, with zeros behind it."""
        seen = self.first + len(self.held)
        stop = self.kernel.length(seen) if last else max(self.made, self.kernel.known(seen))
        out = self.kernel(self.held, self.first, self.made, stop)
        self.made = stop
        keep = max(self.first, self.kernel.reaches_back(stop))
        self.held, self.first = self.held[keep - self.first :], keep
        return out

    def _cut(self, last: bool) -> list[np.ndarray]:
        if not self.fixed_out:
            out, self.ready = self.ready, np.empty(0)
            return [out] if len(out) else []
        n = len(self.ready) if last else len(self.ready) // self.fixed_out * self.fixed_out
        out, self.ready = self.ready[:n], self.ready[n:]
        return [out[i : i + self.fixed_out] for i in range(0, n, self.fixed_out)]

    def push(self, samples: np.ndarray) -> list[np.ndarray]:
        self.waiting = np.concatenate([self.waiting, samples])
        n = len(self.waiting) // self.fixed_in * self.fixed_in if self.fixed_in else len(self.waiting)
        self.held, self.waiting = np.concatenate([self.held, self.waiting[:n]]), self.waiting[n:]
        self.ready = np.concatenate([self.ready, self._taken(False)])
        return self._cut(False)

    def flush(self) -> list[np.ndarray]:
        self.held, self.waiting = np.concatenate([self.held, self.waiting]), np.empty(0)
        self.ready = np.concatenate([self.ready, self._taken(True)])
        return self._cut(True)


class Ring:
    """What ``measure`` finds in the last ``size`` samples, once after each piece as soon as they are there."""

    def __init__(self, size: int, measure: Callable[[np.ndarray], float | None]) -> None:
        self.size, self.measure = size, measure
        self.reset()

    def reset(self) -> None:
        self.held = np.empty(0)

    def push(self, samples: np.ndarray) -> list[np.ndarray]:
        self.held = np.concatenate([self.held, samples])[-self.size :]
        found = self.measure(self.held) if len(self.held) == self.size else None
        return [np.empty(0) if found is None else np.array([found])]

    def flush(self) -> list[np.ndarray]:
        return []


def pitch_ring(rate: int = 16_000, size: int = 2048) -> Ring:
    """The pitch of the last 2048 samples, nothing while they are too few or unvoiced."""
    return Ring(size, lambda x: dsp.pitch(x, rate))


def through(frames: DataFrame, key: str, order: list[str], value: str, start: Callable[[], object], piece: int = 1024) -> DataFrame:
    """key, block, samples: every session's values, in order and in pieces of ``piece``, through a new stage of ``start()``, and what
    its flush gives. Sessions stream through tasks in sorted order; memory holds a piece and a stage."""
    rows_in_order = dealt(frames, key, order).select(key, value)
    schema = T.StructType([frames.schema[key], T.StructField("block", T.LongType()), T.StructField("samples", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stage, held, number = None, None, [], 0

        def out(found: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
            nonlocal number
            number += len(found)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(found), kind), pa.array(range(number - len(found), number), pa.int64()), pa.array([x.tolist() for x in found], pa.list_(pa.float64()))], [key, "block", "samples"])

        for batch in batches:
            kind = batch[key].type
            for k, x in zip(batch[key].to_pylist(), batch[value].to_pylist(), strict=True):
                if stage is None or k != now:
                    if stage is not None:
                        yield out([*(stage.push(np.array(held, float)) if held else ()), *stage.flush()], kind)
                    now, stage, held, number = k, start(), [], 0
                held.append(x)
                if len(held) == piece:
                    yield out(stage.push(np.array(held, float)), kind)
                    held = []
        if stage is not None:
            yield out([*(stage.push(np.array(held, float)) if held else ()), *stage.flush()], kind)

    return rows_in_order.mapInArrow(run, schema)
