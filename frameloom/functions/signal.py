"""Sample arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KNEE = 0.95


def db_to_linear(db: Column) -> Column:
    """0 dB is exactly 1."""
    return F.when(db == 0, 1.0).otherwise(F.pow(F.lit(10.0), db / 20.0))


def soft_limit(x: Column) -> Column:
    """The identity up to the knee, then a tanh that meets it in value and slope."""
    room = 1 - KNEE
    return F.when(F.abs(x) <= KNEE, x).otherwise(F.signum(x) * (KNEE + room * F.tanh((F.abs(x) - KNEE) / room)))


def finite(x: Column) -> Column:
    """0 in place of NaN and infinities."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(x)


def scale_index(i: Column, to_rate: int, from_rate: int) -> Column:
    """A sample index at another rate, rounded half up in whole numbers."""
    x = i.cast("long") * to_rate + from_rate // 2
    return ((x - F.pmod(x, F.lit(from_rate))) / from_rate).cast("long")


def mix(wet: Column, dry: Column, share: Column) -> Column:
    return F.zip_with(wet, dry, lambda w, d: w * share + d * (1 - share))


def dithered(samples: Column, size: float = 1e-7) -> Column:
    return F.transform(samples, lambda x, i: x + F.when(i % 2 == 0, size).otherwise(-size))


def force_length(samples: Column, n: int) -> Column:
    """Cut, or padded with zeros at the end."""
    cut = F.slice(samples, 1, n)
    return F.concat(cut, F.array_repeat(F.lit(0.0), F.lit(n) - F.size(cut)))


def downmix(interleaved: Column, channels: int, channel: int | None = None) -> Column:
    """The mean of the channels of each whole frame, or one channel; a channel that isn't there means the mean."""
    if channels <= 1:
        return interleaved
    frames = F.floor(F.size(interleaved) / channels).cast("int")
    index = F.when(frames > 0, F.sequence(F.lit(0), frames - 1)).otherwise(F.array().cast("array<int>"))
    if channel is not None and 0 <= channel < channels:
        return F.transform(index, lambda i: F.element_at(interleaved, i * channels + channel + 1))
    return F.transform(index, lambda i: F.aggregate(F.slice(interleaved, i * channels + 1, channels), F.lit(0.0), lambda s, x: s + x) / channels)


def edge_faded(samples: Column, n: int = 240) -> Column:
    """Linear fades from and to 0 over n samples (half of them, if fewer) at both ends, then clamped to [-1, 1]."""
    last = F.size(samples) - 1
    fade = F.least(F.lit(n), F.floor(F.size(samples) / 2)).cast("double")

    def at(x: Column, i: Column) -> Column:
        gain = F.when(i < fade, i / fade).when(i > last - fade, (last - i) / fade).otherwise(1.0)
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x * gain))

    return F.transform(samples, at)


def makeup_gain(target_rms: Column, out_rms: Column, static_db: float, cap_db: float = 20.0) -> Column:
    """Static gain times the ratio of levels, capped."""
    ratio = F.greatest(target_rms, F.lit(1e-9)) / F.greatest(out_rms, F.lit(1e-9))
    return db_to_linear(F.lit(static_db)) * F.least(ratio, db_to_linear(F.lit(cap_db)))


def crossfade(old: Column, new: Column, since: Column, n: int = 9600) -> Column:
    """From old to new, linearly over n samples."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), since / F.lit(float(n))))
    return old + (new - old) * t
