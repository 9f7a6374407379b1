"""The speaker gate over ordered frames: closed forms as windows, and the sequential core that batch and stream share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FRAME_MS = 32.0
ADAPT_RATE, ADAPT_MARGIN, ADAPT_LOW, ADAPT_HIGH, ADAPT_FRAMES = 0.05, 1.0, 0.5, 1.5, 30


@dataclass(frozen=True)
class GateConfig:
    theta: float = 0.30
    hangover_ms: float = 300.0
    margin: float = 0.0
    floor_frac: float = 0.0
    adaptive: bool = False
    alpha: float = 1.0
    dt_ms: float = FRAME_MS
    as_norm: bool = False  # scores are normalised by a cohort
    theta_as_norm: float = 2.25

    @property
    def fixed(self) -> float:
        """The threshold on the scale of the scores, before any adaptation."""
        return self.theta_as_norm if self.as_norm else self.theta

    def __post_init__(self) -> None:
        if not (math.isfinite(self.margin) and self.margin >= 0):
            raise ValueError("the margin must be finite and not negative")
        if self.margin > 0 and (self.adaptive or self.as_norm):
            raise ValueError("a margin needs a fixed threshold on raw cosines")


def hangover_gate(frames: DataFrame, key: str, order: list[str], config: GateConfig) -> DataFrame:
    """Adds is_on for a fixed threshold: on since the last pass, unless a collapse or a better other came after it or the
    hangover has run out. One running window per session, no state in Python."""
    if config.adaptive:
        raise ValueError("an adaptive threshold needs sequential()")
    w = Window.partitionBy(key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    wins = F.col("score") - F.col("other") >= config.margin
    ok = (F.col("score") >= config.fixed) & wins
    kill = ~ok & ((F.col("score") < config.fixed * config.floor_frac) | ~wins)
    out = frames.withColumn("__rn", F.row_number().over(w))
    out = out.withColumn("__lp", F.max(F.when(ok, F.col("__rn"))).over(upto)).withColumn("__lk", F.max(F.when(kill, F.col("__rn"))).over(upto))
    on = F.col("__lp").isNotNull() & (F.col("__lk").isNull() | (F.col("__lp") > F.col("__lk"))) & ((F.col("__rn") - F.col("__lp")) * config.dt_ms < config.hangover_ms)
    return out.withColumn("is_on", on).drop("__rn", "__lp", "__lk")


def islands(frames: DataFrame, key: str, order: list[str], speech: Column, dt_ms: float = FRAME_MS) -> DataFrame:
    """Adds speech_ms (length of the current speech run) and silence_ms (time since speech, or since the session began)."""
    w = Window.partitionBy(key).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    out = frames.withColumn("__rn", F.row_number().over(w)).withColumn("__speech", speech)
    last_off = F.coalesce(F.max(F.when(~F.col("__speech"), F.col("__rn"))).over(upto), F.lit(0))
    last_on = F.coalesce(F.max(F.when(F.col("__speech"), F.col("__rn"))).over(upto), F.lit(0))
    out = out.withColumn("speech_ms", (F.col("__rn") - last_off) * dt_ms).withColumn("silence_ms", (F.col("__rn") - last_on) * dt_ms)
    return out.drop("__rn", "__speech")


def carried(frames: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the last value that is not null, up to and with the row: what a late result leaves on later frames."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn(name, F.last(value, ignorenulls=True).over(w))


def final_gate(overlap: Column, bypass: bool, speech: Column, silence_ms: Column, hangover_ms: float, scored: Column, silence_off: Column, turn_off: Column, change_off: Column) -> Column:
    """The last word on a frame: a change shuts it; in overlap with bypass speech and its hangover decide; else the score."""
    held = speech | (silence_ms < hangover_ms)
    return ~change_off & F.when(overlap & F.lit(bypass), held & ~silence_off).otherwise(scored & ~silence_off & ~turn_off)


def admitted(score: Column, match: Column, run_ms: Column, theta: float = 0.80, theta_match: float = 0.7, least_s: float = 1.0) -> Column:
    """Whether a window may be learned from; every bound is inclusive."""
    return (score >= theta) & (match >= theta_match) & (run_ms >= least_s * 1000)


def pitch_match(f0: Column, mean: Column, sigma: Column) -> Column:
    """exp(-z^2 / 2); 1 where the deviation is not positive or a value is not finite."""
    z = (f0 - mean) / sigma
    bad = f0.isNull() | F.isnan(f0) | mean.isNull() | F.isnan(mean) | sigma.isNull() | F.isnan(sigma) | (sigma <= 0)
    return F.when(bad, 1.0).otherwise(F.exp(-0.5 * z * z))


def fused(score: Column, match: Column, weight: float, neutral: float) -> Column:
    return score + weight * (match - neutral)


def smoothed(last: float, new: float, alpha: float) -> float:
    """alpha * new + (1 - alpha) * last; the new value where alpha is outside [0, 1) or the last value is exactly 0."""
    return new if not 0.0 <= alpha < 1.0 or last == 0.0 else alpha * new + (1 - alpha) * last


@dataclass
class Follower:
    """Exponential mean and variance of the speech scores, and the threshold that follows them."""

    mean: float = 0.0
    var: float = 0.0
    seen: int = 0

    def hear(self, score: float) -> None:
        rate, apart = ADAPT_RATE if self.seen else 1.0, score - self.mean
        self.mean += rate * apart
        self.var = (1 - rate) * (self.var + rate * apart * apart)
        self.seen += 1

    def threshold(self, fixed: float) -> float:
        """One deviation under the mean, within a band around the fixed threshold, which holds until enough was heard."""
        wanted = self.mean - ADAPT_MARGIN * math.sqrt(max(self.var, 0.0))
        return float(np.clip(wanted, fixed * ADAPT_LOW, fixed * ADAPT_HIGH)) if self.seen >= ADAPT_FRAMES else fixed


@dataclass
class Gate:
    """One session's sequential gate: it is open while the last pass is less than a hangover ago, unless it collapsed since."""

    config: GateConfig
    score: float = 0.0
    since: float = math.inf  # milliseconds since the last pass, infinite while shut
    speech: Follower = field(default_factory=Follower)

    def __post_init__(self) -> None:
        if isinstance(self.speech, dict):  # from a state store
            self.speech = Follower(**self.speech)

    @property
    def is_on(self) -> bool:
        return self.since < math.inf

    def theta(self) -> float:
        c = self.config
        return self.speech.threshold(c.fixed) if c.adaptive else c.fixed

    def step(self, score: float, other: float = 0.0, speech: bool = True) -> tuple[bool, float, float]:
        """(is_on, threshold, smoothed score) of the next frame."""
        c = self.config
        self.score = smoothed(self.score, score, c.alpha)
        if c.adaptive and speech:
            self.speech.hear(self.score)
        theta, ahead = self.theta(), self.score - other >= c.margin
        waited = self.since + c.dt_ms
        holds = ahead and self.score >= theta * c.floor_frac and waited < c.hangover_ms
        self.since = 0.0 if ahead and self.score >= theta else waited if holds else math.inf
        return self.is_on, theta, self.score


@dataclass
class Hysteresis:
    """Solo and overlap modes with hold times."""

    threshold: float = 0.10
    hold_on_ms: float = 500.0
    hold_off_ms: float = 500.0
    cadence_ms: float = 250.0
    overlap: bool = False
    above: float = 0.0
    below: float = 0.0

    def step(self, probability: float) -> bool:
        if probability >= self.threshold:
            self.above, self.below = self.above + self.cadence_ms, 0.0
        else:
            self.above, self.below = 0.0, self.below + self.cadence_ms
        if not self.overlap and self.above >= self.hold_on_ms or self.overlap and self.below >= self.hold_off_ms:
            self.overlap, self.above, self.below = not self.overlap, 0.0, 0.0
        return self.overlap


#: state: (the signal that ends it, the state that follows)
TURNS = {"steady": ("starts", "shrunk"), "shrunk": ("settled", "regrowing"), "regrowing": ("always", "steady")}
NEAR = 0.1  # fast and slow mean are one again


@dataclass
class TurnDetector:
    """Looks for a change of speaker in the pitch match: a fast mean that falls away from its slow baseline. The states follow
    each other in a ring (``TURNS``); each frame's signals say whether the present one ends."""

    drop: float = 0.25
    stable_frames: int = 10
    fail_closed: bool = True
    state: str = "steady"
    fast: float = 0.0
    slow: float = 0.0
    calm: int = 0  # voiced frames in a row with both means near each other
    refreshed: bool = False
    dipped: bool = False  # the match fell while the gate was shut
    closed: bool = False

    def refresh_done(self) -> None:
        if self.state == "shrunk":
            self.refreshed, self.closed = True, False

    def _follow(self, match: float, gate_on: bool) -> None:
        rates = (0.3, 0.02 * gate_on) if self.fast or self.slow else (1.0, 1.0)
        self.fast, self.slow = (x + r * (match - x) for x, r in zip((self.fast, self.slow), rates, strict=True))

    def step(self, match: float | None, gate_on: bool) -> bool:
        """Whether this frame starts a turn."""
        voiced = match is not None
        if voiced:
            self._follow(match, gate_on)
        away, based = voiced and self.fast < self.slow - self.drop, self.slow > 0
        self.dipped |= away and based and not gate_on
        self.calm = (self.calm + 1) * (voiced and abs(self.fast - self.slow) <= NEAR)
        leaves = away and gate_on
        returns = voiced and not gate_on and self.dipped and based and self.fast >= self.slow - NEAR
        signals = {"starts": leaves or returns, "settled": self.refreshed and self.calm >= self.stable_frames, "always": True}
        ends, following = TURNS[self.state]
        if not signals[ends]:
            return False
        self.state, self.calm = following, 0
        if following == "shrunk":
            self.refreshed = self.dipped = False
            self.closed |= leaves and self.fail_closed
        return following == "shrunk"


class OtherSpeakers:
    """Who else spoke in the session, as rows of one matrix of centres; windows are scored before they are learned from.

    A window that the profile rejects is a proposal: to move the centre it is like, or, with the one waiting before it, to
    be a new centre. Every proposal passes one guard, that the profile rejects the proposed centre as well. A centre that alone
    keeps refusing a speaker whom the profile accepts is blamed; blame grows by 2 a refusal and shrinks by 1 a window
    without one, and at its limit the centre goes.
    """

    def __init__(self, seed_ceiling: float = 1.0, guard: float = 0.85, min_run: int = 2, agree: float = 0.45, merge: float = 0.45, rate: float = 0.2, most: int = 6, forget_after: int = 3) -> None:
        self.seed_ceiling, self.guard, self.min_run, self.agree = seed_ceiling, guard, min_run, agree
        self.merge, self.rate, self.most, self.limit = merge, rate, most, 2 * max(forget_after, 1)
        self.reset()

    def reset(self) -> None:
        self.centres, self.weights = np.empty((0, 0)), np.empty(0, int)
        self.rejected, self.waiting = 0, None  # rejected windows in a row, the one that waits for a like one
        self.acquit()

    def acquit(self) -> None:
        """Blame names a row, so it ends whenever rows move."""
        self.blamed, self.blame = -1, 0

    def __len__(self) -> int:
        return len(self.weights)

    def _similar(self, vec: np.ndarray) -> np.ndarray:
        """The cosine with every centre."""
        size = np.linalg.norm(self.centres, axis=1) * np.linalg.norm(vec) if len(self) else np.empty(0)
        return np.divide(self.centres @ vec if len(self) else size, size, out=np.zeros(len(self)), where=size > 0)

    @staticmethod
    def _last_largest(x: np.ndarray) -> int:
        return len(x) - 1 - int(x[::-1].argmax())

    def _remove(self, row: int) -> None:
        self.centres, self.weights = np.delete(self.centres, row, axis=0), np.delete(self.weights, row)
        self.acquit()

    def score(self, vec: np.ndarray, own: float, theta: float, margin: float) -> float:
        """The largest cosine with a centre, floored at 0, after a centre that has used up its credit is gone."""
        near = self._similar(vec)
        if not len(near):
            self.acquit()
            return 0.0
        row = self._last_largest(near)
        refuses = theta <= own < near[row] + margin
        if refuses:
            self.blamed, self.blame = row, 2 + self.blame * (self.blamed == row)
        else:
            self.blame = max(0, self.blame - 1)
            self.blamed = self.blamed if self.blame else -1
        if refuses and self.blame >= self.limit:
            self._remove(row)
            near = self._similar(vec)
        return float(near.max(initial=0.0))

    def _proposed(self, vec: np.ndarray) -> tuple[int, np.ndarray] | None:
        """(row or -1 for a new one, centre) that a rejected window argues for."""
        near = self._similar(vec)
        row = self._last_largest(near) if len(near) else -1
        if row >= 0 and near[row] >= self.merge:
            return row, self.centres[row] + self.rate * (vec - self.centres[row])
        if self.rejected < self.min_run:
            return None
        partner, self.waiting = self.waiting, vec
        if partner is None or _cos(partner, vec) < self.agree:
            return None
        self.waiting = None
        return -1, (partner + vec) / 2

    def learn(self, vec: np.ndarray, own: float, theta: float, profile: Callable[[np.ndarray], float]) -> None:
        if not self.most or own >= theta * self.seed_ceiling:
            self.rejected, self.waiting = 0, None
            return
        self.rejected += 1
        proposal = self._proposed(vec)
        if proposal is None or profile(proposal[1]) >= theta * self.guard:
            return
        row, centre = proposal
        if row < 0:
            if len(self) >= self.most:
                self._remove(int(self.weights.argmin()))
            self.centres = np.vstack([self.centres, centre]) if len(self) else centre[None, :]
            self.weights = np.append(self.weights, 2)
        else:
            self.centres[row], self.weights[row] = centre, self.weights[row] + 1


def _cos(a: np.ndarray, b: np.ndarray) -> float:
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / size if size else 0.0


def dealt(frames: DataFrame, key: str, order: list[str]) -> DataFrame:
    """frames with each session whole in one task, in order.

    The exchange is by a hash of the key: one by the key itself falls away behind a join on the key, and a join that turns into a
    broadcast at run time then reads its side by file, which spreads a session over tasks.
    """
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frames.repartition(n, F.xxhash64(key)).sortWithinPartitions(key, *order)


def sequential(frames: DataFrame, key: str, order: list[str], columns: list[str], made: str, start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Fold each session in order: ``start()`` gives a new session's step, called with the columns' values of each row.

    Rows of a session stream through one task in sorted order, so memory holds one state, not a session. made: name and type of
    each value that the step returns; the rows are key, the order columns and these.
    """
    rows_in_order = dealt(frames, key, order).select(key, *order, *columns)
    head = [key, *order]
    names, types = zip(*(part.split() for part in made.split(",")), strict=True)
    known = {"boolean": (pa.bool_(), T.BooleanType()), "double": (pa.float64(), T.DoubleType()), "int": (pa.int32(), T.IntegerType()), "string": (pa.string(), T.StringType())}
    kinds = [known[t][0] for t in types]
    schema = T.StructType([frames.schema[c] for c in head] + [T.StructField(name, known[t][1]) for name, t in zip(names, types, strict=True)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step, begun = None, None, False
        for batch in batches:
            rows = []
            for k, *values in zip(*(batch[c].to_pylist() for c in [key, *columns]), strict=True):
                if not begun or k != now:
                    now, step, begun = k, start(), True
                rows.append(step(*values))
            out = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in head), *out], [*head, *names])

    return rows_in_order.mapInArrow(fold, schema)
