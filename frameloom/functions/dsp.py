"""Numpy kernels for spectra, pitch and resampling, and their Arrow-backed functions."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE, FFT, HOP, MELS = 16_000, 400, 160, 80


@lru_cache(8)
def mel_matrix(rate: int = RATE, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters on the 2595 * log10(1 + f / 700) scale, (fft / 2 + 1) x mels."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, fft // 2 + 1)[:, None]
    up = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


def log_mel(audio: np.ndarray, rate: int = RATE) -> np.ndarray:
    """1 + n / HOP frames of dB, floored 80 dB under the largest value of the call."""
    x = np.pad(np.asarray(audio, np.float64), FFT // 2)
    frames = np.lib.stride_tricks.sliding_window_view(x, FFT)[::HOP][: 1 + len(audio) // HOP]
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(FFT) / FFT)
    power = np.abs(np.fft.rfft(frames * window)) ** 2
    db = 10 * np.log10(np.maximum(power @ mel_matrix(rate), 1e-10))
    return np.maximum(db, db.max() - 80)


def difference(x: np.ndarray, longest: int) -> np.ndarray:
    """Squared difference of the frame with itself at each lag, by one transform."""
    n = len(x)
    size = 1 << int(2 * n - 1).bit_length()
    energy = np.concatenate(([0.0], np.cumsum(x * x)))
    cross = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[:longest]
    lag = np.arange(longest)
    return np.maximum(energy[n - lag] + energy[n] - energy[lag] - 2 * cross, 0)


def normalised(d: np.ndarray) -> np.ndarray:
    """The difference at each lag over its mean at the lags up to it; 1 at lag 0 and while the sum is 0."""
    out, total = np.ones(len(d)), np.cumsum(d[1:])
    out[1:] = np.where(total > 0, d[1:] * np.arange(1, len(d)) / np.maximum(total, 1e-300), 1.0)
    return out


def _dip(norm: np.ndarray, first: int, stop: int, threshold: float) -> int | None:
    """The first lag below the threshold, followed down to its local minimum."""
    below = np.flatnonzero(norm[first:stop] < threshold)
    if not len(below):
        return None
    t = first + int(below[0])
    rises = np.flatnonzero(np.diff(norm[t:stop]) >= 0)
    return t + int(rises[0]) if len(rises) else stop - 1


def pitch(x: np.ndarray, rate: int, low: float = 50, high: float = 500, threshold: float = 0.1, hint: float | None = None) -> float | None:
    """The frame's pitch in Hz by the cumulative mean normalised difference; None if unvoiced or under 64 samples. With a hint
    in Hz the lags from 0.7 to 1.4 of its own are tried before all others."""
    x = np.asarray(x, np.float64)
    if len(x) < 64:
        return None
    least, most = max(2, int(rate / high)), min(len(x) // 2, int(rate / low))
    if most <= least:
        return None
    norm = normalised(difference(x, most + 1))
    t, near = None, int(rate / hint) if hint and math.isfinite(hint) and hint > 0 else 0
    if least <= near <= most:
        first, stop = max(least, int(near * 0.7)), min(most, int(near * 1.4))
        t = _dip(norm, first, stop, threshold) if stop > first + 1 else None
    t = _dip(norm, least, most, threshold) if t is None else t
    if t is None:
        return None
    bend = norm[t - 1] - 2 * norm[t] + norm[t + 1] if t + 1 < most else 0.0
    lag = t + (0.5 * (norm[t - 1] - norm[t + 1]) / bend if bend else 0.0)
    return float(rate / lag) if lag > 0 else None


def pitch_track(audio: np.ndarray, rate: int = RATE, frame: int = 2048, hop: int = 512, low: float = 50, high: float = 500) -> list[float | None]:
    """The pitch of every whole frame; the last voiced one is the next frame's hint."""
    out: list[float | None] = []
    hint = None
    for i in range(0, len(audio) - frame + 1, hop):
        out.append(pitch(audio[i : i + frame], rate, low, high, hint=hint))
        hint = hint if out[-1] is None else out[-1]
    return out


class Sinc:
    """A windowed-sinc kernel between two rates. Output k stands at input k * from_rate / to_rate."""

    def __init__(self, to_rate: int, from_rate: int, half: int = 16) -> None:
        if min(to_rate, from_rate) <= 0:
            raise ValueError("rates must be positive")
        self.to_rate, self.from_rate = to_rate, from_rate
        self.cut = min(1.0, to_rate / from_rate)
        self.reach = math.ceil(half / self.cut)

    def length(self, n: int) -> int:
        """Outputs of a whole signal of n samples."""
        return (n * self.to_rate + self.from_rate // 2) // self.from_rate

    def known(self, n: int) -> int:
        """Outputs that need none but the first n samples."""
        return max(0, -(-(n - self.reach) * self.to_rate // self.from_rate)) if n > self.reach else 0

    def reaches_back(self, k: int) -> int:
        """The first sample that output k and later ones need."""
        return max(0, k * self.from_rate // self.to_rate - self.reach + 1)

    def __call__(self, x: np.ndarray, first: int, start: int, stop: int, at_once: int = 1 << 14) -> np.ndarray:
        """Outputs start to stop of a signal of which x holds the samples from place ``first`` on; others count as 0."""
        out = np.empty(stop - start)
        for a in range(start, stop, at_once):
            k = np.arange(a, min(a + at_once, stop))
            whole, part = np.divmod(k * self.from_rate, self.to_rate)
            index = whole[:, None] + np.arange(-self.reach + 1, self.reach + 1)
            t = (whole - index.T).T + (part / self.to_rate)[:, None]
            taps = np.sinc(self.cut * t) * np.where(np.abs(t) < self.reach, 0.5 + 0.5 * np.cos(np.pi * t / self.reach), 0)
            taps /= taps.sum(1, keepdims=True)
            here = index - first
            held = np.where((here >= 0) & (here < len(x)), x[np.clip(here, 0, max(len(x) - 1, 0))], 0) if len(x) else np.zeros(here.shape)
            out[a - start : a - start + len(k)] = (held * taps).sum(1)
        return out


def resample(audio: np.ndarray, to_rate: int, from_rate: int) -> np.ndarray:
    """Windowed-sinc resampling of a whole signal, some thousand outputs at a time; equal rates copy, empty stays empty."""
    x = np.asarray(audio, np.float64)
    if to_rate == from_rate or not len(x):
        return x.copy()
    kernel = Sinc(to_rate, from_rate)
    return kernel(x, 0, 0, kernel.length(len(x)))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def log_mel_udf(samples: pd.Series) -> pd.Series:
    return samples.map(lambda x: log_mel(x).tolist() if x is not None else None)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def pitch_track_udf(samples: pd.Series) -> pd.Series:
    return samples.map(lambda x: pitch_track(np.asarray(x)) if x is not None else None)


def resample_udf(to_rate: int, from_rate: int):
    @F.pandas_udf("array<double>")
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: resample(x, to_rate, from_rate).tolist() if x is not None else None)

    return run


def difference_udf(longest: int):
    @F.pandas_udf("array<double>")
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: difference(np.asarray(x, float), longest).tolist() if x is not None else None)

    return run


def normalised_udf(longest: int):
    @F.pandas_udf("array<double>")
    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: normalised(difference(np.asarray(x, float), longest)).tolist() if x is not None else None)

    return run
