"""A whole session, frame by frame: speech, identity window, refreshes, learning, other speakers and the final gate.

The frame is the clock, so windows and cadences are counted in frames. The encoder is a function of the window's frame
vectors (their mean unless another is given, as no weights are at hand). One ``Session`` serves the batch fold
(``gate.sequential``) and the stream (``streaming.session_stream``).
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np

from frameloom.operators.gate import Gate, GateConfig, Hysteresis, OtherSpeakers, TurnDetector, smoothed
from frameloom.operators.profiles import BLEND, GUARD, condition_means, evidence_step

SEED_SIGMA, TOP = 40.0, 20


def _cos(a: np.ndarray, b: np.ndarray) -> float:
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / size if size else 0.0


def pitch_match(f0: float, mean: float, sigma: float) -> float:
    if sigma <= 0 or not all(map(math.isfinite, (f0, mean, sigma))):
        return 1.0
    return math.exp(-0.5 * ((f0 - mean) / sigma) ** 2)


def as_norm(vec: np.ndarray, raw: float, cohort: np.ndarray, k: int = TOP) -> float:
    """raw against the mean and deviation of the k largest dot products of the unit vector with the cohort's rows."""
    size = float(np.linalg.norm(vec))
    if not size or not len(cohort) or k < 1:
        return raw
    top = np.sort(cohort @ vec / size)[-k:]
    apart, sigma = raw - float(top.mean()), float(top.std())
    return apart / sigma if sigma >= 1e-12 else apart


@dataclass
class Pool:
    """A speaker's anchors, their condition means, and what was learned since."""

    anchors: list = field(default_factory=list)
    f0_mean: float = 0.0
    f0_sigma: float = 0.0
    evidence: np.ndarray | None = None
    conditions: list = field(default_factory=list)
    adapted: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.anchors = [np.asarray(a, float) for a in self.anchors]
        self._derive()

    def _derive(self) -> None:
        self.conditions = condition_means(np.array(self.anchors)) if self.anchors else []
        if self.evidence is None:
            self.adapted = None
        else:
            self.adapted = BLEND * np.mean(self.anchors, axis=0) + (1 - BLEND) * self.evidence if self.anchors else self.evidence

    def add(self, anchors: Iterable) -> None:
        self.anchors += [np.asarray(a, float) for a in anchors]
        self._derive()

    def __len__(self) -> int:
        return len(self.anchors) + (self.adapted is not None)

    def __iter__(self):
        """The anchors, then what was adapted from them."""
        yield from self.anchors
        if self.adapted is not None:
            yield self.adapted

    def set_f0(self, mean: float, sigma: float) -> None:
        self.f0_mean, self.f0_sigma = mean, sigma

    def score(self, vec: np.ndarray) -> float:
        """The largest cosine with a condition mean or the adapted vector, floored at 0."""
        known = [*self.conditions, *([] if self.adapted is None else [self.adapted])]
        return max([0.0, *(_cos(vec, r) for r in known)])

    def adapt(self, vec: np.ndarray) -> bool:
        """Learn from a vector near an anchor."""
        if not self.anchors or 1 - max(_cos(vec, a) for a in self.anchors) > GUARD:
            return False
        self.evidence = evidence_step(self.evidence, vec)
        self._derive()
        return True

    def seed(self, vec: np.ndarray, f0: float) -> None:
        self.set_f0(f0, SEED_SIGMA)
        self.add([vec])


@dataclass(frozen=True)
class SessionConfig:
    """Frames of 32 ms: the defaults are about 1 s, 0.5 s, 0.5 s, 0.25 s and 0.1 s. latency: frames that a refresh takes; 0 is
    inline. Only late results may seed an empty pool."""

    gate: GateConfig = field(default_factory=lambda: GateConfig(alpha=0.8))
    speech_above: float = 0.5
    window: int = 31
    update: int = 15
    reopen: int = 15
    after_silence: int = 7
    pre_roll: int = 3
    latency: int = 0
    silence_off_ms: float = 0.0
    turn_silence_ms: float = 0.0
    learn: bool = True
    bootstrap: bool = False
    theta_learn: float = 0.80
    theta_learn_as_norm: float = 3.25
    theta_match: float = 0.7
    least_s: float = 1.0
    turns: bool = False
    turn_window: int = 15
    turn_update: int = 4
    routing: bool = False  # between a solo and an overlap mode, by the overlap probability
    bypass: bool = True  # in overlap speech and its hangover decide, not the score

    def __post_init__(self) -> None:
        if min(self.window, self.update, self.reopen, self.turn_window, self.turn_update) < 1 or min(self.pre_roll, self.latency, self.after_silence) < 0:
            raise ValueError("windows and cadences are at least one frame, delays not negative")


def mean_vector(window: list) -> np.ndarray:
    return np.mean(window, axis=0)


class Session:
    """State of one session; ``step`` takes a frame and returns what diagnostics hold of it."""

    def __init__(self, config: SessionConfig, pool: Pool, encode: Callable[[list], np.ndarray] = mean_vector, cohort: Iterable = ()) -> None:
        self.config, self.pool, self.encode = config, pool, encode
        self.cohort = np.array([np.asarray(v, float) for v in cohort])
        self.reset()

    def reset(self) -> None:
        """Forget the session and what is in flight; the pool stays."""
        c = self.config
        self.frame, self.gate, self.others = 0, Gate(GateConfig(**{**c.gate.__dict__, "alpha": 1.0})), OtherSpeakers()
        self.turn, self.mode, self.heard = TurnDetector(), Hysteresis(), 0.0
        self.window: deque = deque()
        self.ring: deque = deque(maxlen=c.pre_roll)
        self.spoke, self.speech_ms, self.silence_ms = False, 0.0, 0.0
        self.since, self.paused, self.fresh = 0, False, 0
        self.awaiting: int | None = None
        self.applied: int | None = None
        self.flying: tuple | None = None
        self.pending: tuple | None = None
        self.last, self.cos, self.match, self.other = 0.0, 0.0, 0.0, 0.0

    def configure(self, gate: GateConfig) -> None:
        """Another gate from the next frame on, with the state as it is."""
        self.gate.config = GateConfig(**{**gate.__dict__, "alpha": 1.0})

    def _apply(self, vec: np.ndarray, f0: float, trigger: int) -> str | None:
        c, g = self.config, self.gate.config
        self.cos, self.match, self.applied = self.pool.score(vec), pitch_match(f0, self.pool.f0_mean, self.pool.f0_sigma), trigger
        new = as_norm(vec, self.cos, self.cohort) if g.as_norm else self.cos
        self.last = smoothed(self.last, new, c.gate.alpha)
        if g.margin > 0:
            self.other = self.others.score(vec, self.cos, g.theta, g.margin)
            self.others.learn(vec, self.cos, g.theta, self.pool.score)
        if not c.learn:
            return None
        if not self.pool.anchors and c.bootstrap and c.latency:
            if self.speech_ms >= c.least_s * 1000 and math.isfinite(f0) and f0 > 0:
                self.pool.seed(vec, f0)
                return "BootstrapSeed"
            return None
        if self.last >= (c.theta_learn_as_norm if g.as_norm else c.theta_learn) and self.match >= c.theta_match and self.speech_ms >= c.least_s * 1000:
            return "Admit" if self.pool.adapt(vec) else "RejectAnchorDistance"
        return None

    def _hear(self, vec: np.ndarray, f0: float, size: int) -> None:
        self.window.append((vec, f0))
        while len(self.window) > size:
            self.window.popleft()

    def flush(self) -> list[str]:
        """The session is over: refreshes that are in flight or wait for one are applied now; their learning events."""
        jobs = [job for job in (self.flying and self.flying[1:], self.pending) if job]
        self.flying = self.pending = None
        return [event for job in jobs if (event := self._apply(*job))]

    def _overlapped(self, probability: float | None) -> bool:
        """The mode after this frame; a probability counts once a cadence."""
        self.heard += self.config.gate.dt_ms
        if probability is not None and self.heard >= self.mode.cadence_ms:
            self.heard = 0.0
            self.mode.step(probability)
        return self.mode.overlap

    def step(self, speech: float, vec: Iterable, f0: float | None = None, overlap: float | None = None) -> tuple[bool, float, float, float, str | None]:
        """(is_on, score, cosine, pitch match, learning event) of the next frame; f0 is null where unvoiced, overlap where no
        probability is known."""
        c, now = self.config, speech > self.config.speech_above
        shrunk = c.turns and self.turn.state == "shrunk"
        size, cadence = (c.turn_window, c.turn_update) if shrunk else (c.window, c.update)
        pitch, vec = math.nan if f0 is None else float(f0), np.asarray(vec, float)
        entered = False
        if c.turns and now:
            voiced = None if math.isnan(pitch) else pitch_match(pitch, self.pool.f0_mean, self.pool.f0_sigma)
            entered = self.turn.step(voiced, self.gate.is_on)
        if now:
            if not self.spoke:
                for old in self.ring:
                    self._hear(*old, size)
            self._hear(vec, pitch, size)
            self.speech_ms += c.gate.dt_ms
            self.silence_ms = 0.0
            self.fresh += self.paused
        else:
            self.speech_ms = 0.0
            if self.spoke:
                self.paused, self.fresh = True, 0
            self.silence_ms += c.gate.dt_ms
            if 0 < c.turn_silence_ms <= self.silence_ms and len(self.others) and self.window:
                self.window.clear()
                self.ring.clear()
                self.since, self.awaiting = 0, self.frame
        self.spoke = now
        self.since += 1
        self.ring.append((vec, pitch))
        least = max(1, min(c.reopen, size)) if self.awaiting is not None else size
        due = self.since >= cadence or (self.paused and now and self.fresh >= c.after_silence) or entered
        event = None
        if due and len(self.window) >= least:
            self.since, self.paused, self.fresh = 0, False, 0
            voiced = [p for _, p in self.window if math.isfinite(p)]
            job = (self.encode([v for v, _ in self.window]), float(np.mean(voiced)) if voiced else 0.0, self.frame)
            if not c.latency:
                event = self._apply(*job)
            elif self.flying is None:
                self.flying = (self.frame + c.latency, *job)
            else:
                self.pending = job  # the latest wins
            if shrunk:
                self.turn.refresh_done()
        if self.flying and self.frame >= self.flying[0]:
            event = self._apply(*self.flying[1:])
            self.flying = (self.frame + c.latency, *self.pending) if self.pending else None
            self.pending = None
        scored = self.gate.step(self.last, self.other, now)[0]
        if self.awaiting is not None and self.applied is not None and self.applied >= self.awaiting:
            self.awaiting = None
        quiet = 0 < c.silence_off_ms <= self.silence_ms
        if c.routing and self._overlapped(overlap) and c.bypass:
            on = (now or self.silence_ms < c.gate.hangover_ms) and not quiet
        else:
            on = scored and not quiet and not (c.turns and self.turn.closed)
        on = on and self.awaiting is None
        self.frame += 1
        return on, self.last, self.cos, self.match, event
