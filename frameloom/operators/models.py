"""Places for trained models: each takes any callable in the model's stead and holds the contract around it, so that shapes,
carried state and guards are the same whether weights are at hand or not."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from frameloom.operators.stages import Blocks


def local_model(name: str, variable: str, cache: str) -> str:
    """The path of a model file: that of an environment variable, else the one in the cache; nothing is fetched."""
    path = os.environ.get(variable) or os.path.join(cache, name)
    if not os.path.isfile(path):
        raise FileNotFoundError(f"{name}: set {variable}, or put the file into {cache}")
    return path


def _shaped(x, shape: tuple, what: str) -> np.ndarray:
    x = np.asarray(x, float)
    if len(x.shape) != len(shape) or any(want not in (None, have) for want, have in zip(shape, x.shape)):
        raise ValueError(f"{what} has shape {x.shape}, not {shape}")
    return x


class VoiceActivity:
    """model(64 samples of context and 512 new ones, state) -> (probability, state)."""

    def __init__(self, model: Callable, chunk: int = 512, context: int = 64) -> None:
        self.model, self.chunk, self.width = model, chunk, context
        self.reset()

    def reset(self) -> None:
        self.context, self.state = np.zeros(self.width), None

    def __call__(self, samples) -> float:
        samples = _shaped(samples, (self.chunk,), "a chunk")
        probability, self.state = self.model(np.concatenate([self.context, samples]), self.state)
        self.context = samples[-self.width :]
        return float(probability)


class Encoder:
    """model(log-mel frames x 80) -> 192 values; ``pool`` makes a split encoder's frame features one vector."""

    def __init__(self, model: Callable, mels: int = 80, size: int = 192, pool: Callable | None = None) -> None:
        self.model, self.mels, self.size, self.pool = model, mels, size, pool

    def __call__(self, features) -> np.ndarray:
        features = _shaped(features, (None, self.mels), "features")
        if not len(features):
            raise ValueError("no frames")
        found = self.model(features)
        return _shaped(self.pool(found) if self.pool else found, (self.size,), "a speaker vector")

    def parts(self) -> tuple[Callable, Callable]:
        if self.pool is None:
            raise ValueError("the encoder is not split")
        return self.model, self.pool


def _with_state(model: Callable, tensors: int, silent: bool):
    """A chunk through model(chunk, state) -> (chunk, state); an all-silent chunk gives zeros and leaves the state."""
    state: list = [None] * tensors

    def run(chunk: np.ndarray) -> np.ndarray:
        nonlocal state
        if silent and not chunk.any():
            return np.zeros(len(chunk))
        out, new = model(chunk, state)
        if len(new) != tensors:
            raise ValueError(f"{len(new)} state tensors, not {tensors}")
        state = new
        return _shaped(out, (len(chunk),), "a chunk")

    return run


def extractor(model: Callable, chunk: int = 480, tensors: int = 89) -> Blocks:
    """A conditioned extractor over chunks."""
    return Blocks(chunk, _with_state(model, tensors, True))


def denoiser(model: Callable, hop: int = 480) -> Blocks:
    """model(frame, state) -> (frame, state), frame by frame."""
    return Blocks(hop, _with_state(model, 1, False))


def two_streams(model: Callable, size: int = 8000) -> Callable[[np.ndarray], np.ndarray]:
    """model(8000 samples) -> two streams of them, all finite."""

    def run(mixture) -> np.ndarray:
        out = _shaped(model(_shaped(mixture, (size,), "a block")), (2, size), "the streams")
        if not np.isfinite(out).all():
            raise ValueError("a stream is not finite")
        return out

    return run


class Overlap:
    """model(last second) -> frames x 7 classes, asked once every ``cadence_ms``."""

    def __init__(self, model: Callable, rate: int = 16_000, cadence_ms: int = 250) -> None:
        self.model, self.rate = model, rate
        self.set_cadence(cadence_ms)
        self.reset()

    def set_cadence(self, ms: int) -> None:
        if ms <= 0:
            raise ValueError("the cadence must be positive")
        self.cadence_ms = ms

    def reset(self) -> None:
        self.held, self.since = np.empty(0), 0

    def push(self, samples) -> np.ndarray | None:
        self.held, self.since = np.concatenate([self.held, samples])[-self.rate :], self.since + len(samples)
        if len(self.held) < self.rate or self.since * 1000 < self.cadence_ms * self.rate:
            return None
        self.since = 0
        return _shaped(self.model(self.held), (None, 7), "classes")


def conditioning(anchors, evidence=None, size: int = 192) -> np.ndarray:
    """What an extractor is conditioned on: the adapted vector, or the mean of the anchors."""
    from frameloom.operators.session import Pool

    pool = Pool(anchors, evidence=None if evidence is None else np.asarray(evidence, float))
    if not pool.anchors:
        raise ValueError("an empty pool conditions nothing")
    return _shaped(np.mean(pool.anchors, axis=0) if pool.adapted is None else pool.adapted, (size,), "a condition")


def calibrated(anchors: list, calibration: list, least: int = 4, most: int = 8) -> list:
    """The pool in a separator's domain: the anchors and at most eight calibration ones, of which four are needed."""
    if len(calibration) < least:
        raise ValueError(f"calibration needs {least} anchors")
    return [*anchors, *calibration[:most]]
