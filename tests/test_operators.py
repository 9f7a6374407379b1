"""Literal cases of the operators: boundaries, ties and degenerate inputs."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import dsp, signal, vectors
from frameloom.operators import capture, framing, gate, matching, models, offline, profiles, runs, separation, session, stages
from frameloom.sources import audio, diagnostics, settings
from frameloom.sources import profiles as documents


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_cosine(spark):
    assert one(spark, vectors.cosine(arr(1, 0), arr(1, 0))) == 1
    assert one(spark, vectors.cosine(arr(1, 0), arr(0, 1))) == 0
    assert one(spark, vectors.cosine(arr(1, 0), arr(-1, 0))) == -1
    assert one(spark, vectors.cosine(arr(0, 0), arr(1, 0))) == 0


def test_pool_maximum_and_blocks(spark):
    probes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [-1.0, -1.0])], "vec_id long, embedding array<float>")
    pool = spark.createDataFrame([(7, [0.5, 0.5]), (7, [0.99, 0.01]), (8, [0.0, 1.0])], "grp long, vec array<float>")
    for block in (1, 100):
        best = {r.key: (r.grp, r.score) for r in matching.best_profile(probes, pool, block_rows=block).collect()}
        assert best[1][0] == 7 and 0.99 < best[1][1] <= 1
        assert best[2] == (7, 0.0) and best[3][1] == 0.0
        every = {(r.key, r.grp): r.cos for r in matching.best_by_group(probes, pool, block_rows=block).collect()}
        assert len(every) == 6 and every[1, 7] == best[1][1] and every[3, 8] < 0
        own = {(r.key, r.grp): r.raw for r in matching.own_profile(probes.selectExpr("*", "if(vec_id = 3, 9, 8) as grp"), pool, block_rows=block).collect()}
        assert own == {(1, 8): 0.0, (2, 8): 0.0}
    assert matching.best_by_group(probes, pool.limit(0)).count() == 0 and matching.best_profile(probes, pool.limit(0)).count() == 0


def normed(spark, cohort, raw, k):
    probe = spark.createDataFrame([(1, [1.0, 0.0, 0.0], raw, -1)], "vec_id long, embedding array<float>, raw double, grp long")
    rows = spark.createDataFrame([(0, v) for v in cohort], "grp long, vec array<float>")
    got = {round(matching.as_norm(probe, rows, k, block_rows=b).first().score, 5) for b in (2, 100)}
    assert len(got) == 1
    return got.pop()


def test_as_norm(spark):
    rows = [[d, math.sqrt(1 - d * d), 0.0] for d in (0.4, 0.5, 0.6, 0.7, 0.0)]
    assert normed(spark, rows, 0.8, 4) == pytest.approx(2.236068, abs=1e-4)
    assert normed(spark, [[1.0, 0.0, 0.0]] * 4, 0.9, 4) == pytest.approx(-0.1, abs=1e-6)
    assert normed(spark, np.eye(3).tolist(), 0.5, 99) == pytest.approx(0.353553, abs=1e-4)
    assert normed(spark, [], 0.5, 20) == 0.5
    assert normed(spark, np.eye(3).tolist(), 0.5, 0) == 0.5


def test_match_score(spark):
    probes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    conditions = spark.createDataFrame([(7, [0.0, 1.0]), (8, [0.0, 1.0])], "grp long, centroid array<double>")
    adapted = spark.createDataFrame([(7, [1.0, 1.0]), (8, None)], "grp long, adapted array<double>")
    got = {(r.key, r.grp): r.score for r in matching.match_score(probes, conditions, adapted).collect()}
    assert got == {(1, 7): pytest.approx(0.5**0.5), (1, 8): 0.0, (2, 7): 0.0, (2, 8): 0.0}


def test_profiles(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 3.0, -1.0]), (1, 2, [3.0, 1.0, 1.0])], "grp long, idx int, vec array<float>")
    assert profiles.centroids(rows).first().centroid == [2, 2, 0]
    assert profiles.consistency(rows.where("idx = 1")).first().median_cos == 0
    e = profiles.evidence_step(None, np.array([0.0, 1.0]), 0.5)
    assert profiles.evidence_step(e, np.array([1.0, 1.0]), 0.5).tolist() == [0.5, 1.0]
    same = np.ones((12, 8)) + np.eye(12, 8) * 0.01
    assert len(profiles.condition_means(same)) <= 4
    assert len(profiles.condition_means(np.eye(8))) == 4
    two = np.concatenate([np.tile(np.eye(4)[0], (6, 1)), np.tile(np.eye(4)[1], (6, 1))])
    assert 2 <= len(profiles.condition_means(two)) <= 4
    assert len(profiles.condition_means(np.ones((1, 3)))) == 1


def test_profile_documents(spark):
    rows = spark.createDataFrame(
        [('{"version":1,"anchors":[[1,2]],"auto_learn":[[0,2],[0,4]]}',), ('{"version":2,"anchors":[[1,2]],"evidence":[5,6],"metadata":{"f0_mu":120,"f0_sigma":10}}',), ('{"version":3}',)], "value string"
    )
    old, new, bad = documents.parsed(rows).collect()
    assert old.evidence == [0, 3] and old.f0_mu == 0 and new.evidence == [5, 6] and new.f0_sigma == 10 and bad.error
    kept = documents.parsed(rows).where("error is null").drop("value", "version", "error")
    again = documents.parsed(documents.rendered(kept).select("value")).collect()
    assert [r.evidence for r in again] == [[0, 3], [5, 6]] and {r.version for r in again} == {2}


def test_hangover_and_margin():
    g = gate.Gate(gate.GateConfig(theta=0.5, hangover_ms=200))
    seen = []
    for score, dt in ((0.9, 20), (0, 100), (0, 99), (0, 10)):
        g.config = gate.GateConfig(theta=0.5, hangover_ms=200, dt_ms=dt)
        seen.append(g.step(score)[0])
    assert seen == [True, True, True, False]
    assert not gate.Gate(gate.GateConfig(theta=0.45, margin=0.08)).step(0.50, 0.72)[0]
    assert gate.Gate(gate.GateConfig(theta=0.45, margin=0.08)).step(0.50, 0.30)[0]
    g = gate.Gate(gate.GateConfig(theta=0.45, margin=0.08))
    assert [g.step(0.7, 0.2)[0], g.step(0.5, 0.8)[0]] == [True, False]
    g = gate.Gate(gate.GateConfig(theta=0.6, floor_frac=0.6))
    assert [g.step(s)[0] for s in (0.70, 0.40, 0.10)] == [True, True, False]
    with pytest.raises(ValueError):
        gate.GateConfig(margin=0.1, adaptive=True)
    with pytest.raises(ValueError):
        gate.GateConfig(margin=float("nan"))


def test_adaptive_threshold_clamps():
    g = gate.Gate(gate.GateConfig(theta=0.30, adaptive=True))
    for _ in range(200):
        g.step(0.9)
    assert g.theta() == pytest.approx(0.45)


def test_smoothing_replaces_at_zero():
    assert gate.smoothed(0.0, 0.8, 0.4) == 0.8
    assert gate.smoothed(0.5, 0.8, 1.0) == 0.8
    assert gate.smoothed(0.5, 1.0, 0.4) == pytest.approx(0.7)


def test_closed_form_equals_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i, float(rng.random()), float(rng.choice([0.0, 0.4]))) for s in range(40) for i in range(60)]
    frames = spark.createDataFrame(rows, "session long, i long, score double, other double")
    config = gate.GateConfig(theta=0.5, hangover_ms=100, margin=0.08, floor_frac=0.6)
    closed = {(r.session, r.i): r.is_on for r in gate.hangover_gate(frames, "session", ["i"], config).collect()}

    def start():
        g = gate.Gate(config)
        return lambda score, other: (g.step(score, other)[0],)

    folded = gate.sequential(frames, "session", ["i"], ["score", "other"], "is_on boolean", start).collect()
    assert {(r.session, r.i): r.is_on for r in folded} == closed and len(closed) == 2400


def test_sessions_stay_whole_behind_a_join(spark):
    """A join on the session that turns into a broadcast while it runs reads the frames by file."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "4KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        frames = spark.range(0, 4000, numPartitions=8).select((F.col("id") % 5).alias("session"), F.col("id").alias("i"), F.lit(1.0).alias("x"))
        frames = frames.join(spark.range(5).select(F.col("id").alias("session")), "session")

        def start():
            seen = 0

            def step(x):
                nonlocal seen
                seen += 1
                return (seen,)

            return step

        folded = gate.sequential(frames, "session", ["i"], ["x"], "n int", start).collect()
        assert sorted((r.session, r.i, r.n) for r in folded) == sorted((i % 5, i, i // 5 + 1) for i in range(4000))
        blocks = stages.through(frames, "session", ["i"], "x", lambda: stages.Blocks(100, lambda b: b)).collect()
        assert sorted((r.session, r.block, len(r.samples)) for r in blocks) == [(s, b, 100) for s in range(5) for b in range(8)]
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_admission_and_pitch_match(spark):
    def admit(s, m, r):
        return one(spark, gate.admitted(F.lit(s), F.lit(m), F.lit(r)))

    assert admit(0.80, 0.7, 1000.0)
    assert not admit(0.79, 0.7, 1000.0) and not admit(0.80, 0.69, 1000.0) and not admit(0.80, 0.7, 999.0)
    cases = [(120.0, 120.0, 10.0, 1), (130.0, 120.0, 10.0, math.exp(-0.5)), (130.0, 120.0, 0.0, 1)]
    for f0, mu, sd, want in cases:
        assert one(spark, gate.pitch_match(F.lit(f0), F.lit(mu), F.lit(sd))) == pytest.approx(want)


def test_other_speakers():
    def own(v):
        return 0.0

    def fed(vecs, scores, **options):
        o = gate.OtherSpeakers(**options)
        for v, s in zip(vecs, scores):
            o.learn(np.array(v, float), s, 0.5, own)
        return o

    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    assert len(fed([a] * 6, [0.1] * 6)) == 1
    assert not len(fed([a] * 6, [0.9] * 6))
    assert not len(fed([a, b] * 4, [0.1] * 8))
    assert len(fed([a] * 4 + [b] * 4, [0.1] * 8)) == 2
    o = fed([a] * 4 + [b] * 2 + [[0, 0, 1.0]] * 4, [0.1] * 10, most=2)
    assert len(o) == 2 and o.centres[:, 1].max() == 0  # the one least reinforced went
    o = fed([a] * 4, [0.1] * 4)
    scores = [o.score(np.array([0.5, 0.1, 0]), 0.55, 0.5, 0.08) for _ in range(12)]
    assert scores[0] > 0.9 and scores[2] == 0 and not len(o)  # three refusals in a row
    o = fed([a] * 4, [0.1] * 4)
    for owner in [0.55, 0.1, 0.55, 0.1] * 2:  # refusals and others by turns: 2 1 3 2 4 3 5 4
        o.score(np.array(a), owner, 0.5, 0.08)
    assert len(o) == 1 and o.blame == 4
    assert o.score(np.array(a), 0.55, 0.5, 0.08) == 0 and not len(o) and o.blame == 0


def test_blame_changes_sides():
    o = gate.OtherSpeakers()
    a, b = np.eye(2)
    for v in (a, a, a, b, b, b):
        o.learn(v, 0.0, 0.5, lambda _: 0.0)
    assert len(o) == 2
    for v in (a, a, b, a, a):
        o.score(v, 0.9, 0.5, 1.0)
    assert o.blamed == 0 and o.blame == 4 and len(o) == 2
    o.score(np.array([1.0, 1.0]), 0.9, 0.5, 1.0)  # a tie is the last one's
    assert o.blamed == 1 and o.blame == 2


def test_turns_and_hysteresis():
    t = gate.TurnDetector(stable_frames=2)
    assert not any(t.step(0.9, True) for _ in range(10))
    assert any(t.step(0.1, True) for _ in range(4)) and t.state == "shrunk" and t.closed
    t.refresh_done()
    for _ in range(200):
        t.step(0.9, True)
    assert t.state == "steady" and not t.closed
    h = gate.Hysteresis(threshold=0.1, hold_on_ms=500, hold_off_ms=500)
    assert [h.step(p) for p in (0.2, 0.2, 0.0, 0.0)] == [False, True, True, False]


def test_runs(spark):
    rows = spark.createDataFrame([(1, 0, False), (1, 1000, True), (1, 2000, False)], "s long, start long, is_on boolean")
    assert [(r.start, r.is_on) for r in runs.preroll(rows, "s", 300).sort("start").collect()] == [(0, False), (700, True), (2000, False)]
    assert one(spark, signal.scale_index(F.lit(8000), 48_000, 16_000)) == 24_000
    assert [one(spark, signal.scale_index(F.lit(x), 44_100, 16_000)) for x in (1, 100)] == [3, 276]
    frames = spark.createDataFrame([(1, i, i in (2, 3, 5)) for i in range(7)], "s long, i long, is_on boolean")
    got = [(r.start, r.end, r.is_on) for r in runs.runs(frames, "s", ["i"]).sort("start").collect()]
    assert got == [(0, 2, False), (2, 4, True), (4, 5, False), (5, 6, True), (6, 7, False)]
    with pytest.raises(ValueError):
        runs.envelope([(5, True)], 10)
    with pytest.raises(ValueError):
        runs.envelope([], 10)
    gain, value, c = runs.envelope([(0, True), (40, False)], 80), 0.0, runs.coefficient(15.0, 16_000)
    for i in range(40):
        value += c * (1 - value)
        assert gain[i] == pytest.approx(value)
    assert gain[79] < gain[39]


@pytest.mark.parametrize("hz", [120, 220, 330])
def test_pitch_of_a_tone(hz):
    t = np.arange(2048) / 16_000
    tone = 0.5 * np.sin(2 * np.pi * hz * t) + 0.25 * np.sin(4 * np.pi * hz * t)
    assert dsp.pitch(tone, 16_000) == pytest.approx(hz, rel=0.05)
    assert dsp.pitch(tone[:63], 16_000) is None


def test_spectra_and_resampling():
    tone = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    mel = dsp.log_mel(tone)
    assert mel.shape == (101, 80) and mel.max() - mel.min() <= 80 + 1e-9
    up = dsp.resample(tone, 48_000, 16_000)
    assert len(up) == 48_000 and np.abs(up[300:-300] - np.sin(2 * np.pi * 440 * np.arange(48_000) / 48_000)[300:-300]).max() < 1e-2
    assert len(dsp.resample([], 8, 16)) == 0 and (dsp.resample(tone, 16_000, 16_000) == tone).all()


def test_samples(spark):
    assert one(spark, signal.downmix(arr(1, 3, 2, 4, 9), 2)) == [2, 3]
    assert one(spark, signal.downmix(arr(1, 3, 2, 4), 2, 1)) == [3, 4]
    assert one(spark, signal.downmix(arr(1, 3, 2, 4), 2, 5)) == [2, 3]
    assert one(spark, signal.db_to_linear(F.lit(0.0))) == 1 and one(spark, signal.db_to_linear(F.lit(20.0))) == 10
    assert one(spark, signal.soft_limit(F.lit(0.5))) == 0.5 and 0.95 < one(spark, signal.soft_limit(F.lit(2.0))) <= 1
    assert one(spark, signal.finite(F.lit(float("nan")))) == 0 and one(spark, signal.finite(F.lit(float("-inf")))) == 0
    assert one(spark, signal.force_length(arr(1, 2), 3)) == [1, 2, 0] and one(spark, signal.force_length(arr(1, 2), 1)) == [1]
    assert one(spark, vectors.rms(F.array().cast("array<double>"))) == 0


def test_wav(spark, tmp_path):
    data = audio.encode([0.0, 0.5, -2.0], 16_000)
    rate, x = audio.decode(data)
    assert rate == 16_000 and x.tolist() == [0.0, 16383 / 32767, -1.0]
    (tmp_path / "a.wav").write_bytes(data)
    (tmp_path / "b.wav").write_bytes(b"RIFFxxxx")
    good, bad = audio.read(spark, str(tmp_path)).sort("path").collect()
    assert good.rate == 16_000 and len(good.samples) == 3 and bad.samples is None and bad.error


def test_settings(spark):
    rows = spark.createDataFrame([("v2 0.2 300 100",), ("0.2 300 100",), ("v3 1 2 3",), ("v2 x 1 2",), ("v2 9 1 2",)], "t string")
    got = [r[0] for r in rows.select(settings.gate_settings(F.col("t"))).collect()]
    assert got[0].threshold == 0.2 and got[1].threshold == 0.45 and got[2] is None and got[3] is None and got[4].threshold == 0.95


def test_capture_and_overlap(spark):
    t = np.arange(16_000) / 16_000
    kinds = {1: 0.3 * np.sin(2 * np.pi * 200 * t), 2: 0.001 * np.sin(2 * np.pi * 200 * t), 3: np.clip(3 * np.sin(2 * np.pi * 200 * t), -1, 1), 4: 0.3 * np.sin(2 * np.pi * 200 * t) + 0.2}
    rows = spark.createDataFrame([(k, i, float(x)) for k, s in kinds.items() for i, x in enumerate(s)], "k long, i long, x double")
    assert {r.k: r.verdict for r in capture.quality(rows, "k").collect()} == {1: "ok", 2: "quiet", 3: "clipped", 4: "offset"}
    frames = spark.createDataFrame([(1, [9.0, 0.0, 0.0, 0.0, -9.0, -9.0, -9.0]), (1, [0.0, 0.0, 0.0, 0.0, 9.0, -9.0, -9.0])], "s long, logits array<double>")
    r = capture.overlap_summary(frames, "s").first()
    assert r.overlap_frames == 1 and r.total_frames == 2 and r.fraction == 0.5 and r.max_prob > 0.99


def test_stream_equals_batch(spark, tmp_path):
    from frameloom.streaming.gate_stream import gated

    rng = np.random.default_rng(1)
    rows = [(s, i, float(rng.random()), 0.0, True) for i in range(40) for s in range(3)]
    schema = "session long, seq long, score double, other double, speech boolean"
    for n in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 10 == n], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    config = gate.GateConfig(theta=0.4, adaptive=True, alpha=0.5)
    q = gated(source, config).writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.session, r.seq): r.is_on for r in spark.table("gated").collect()}
    want = {}
    for s in range(3):
        g = gate.Gate(config)
        for r in sorted(r for r in rows if r[0] == s):
            want[s, r[1]] = g.step(r[2], r[3], r[4])[0]
    assert got == want


def test_edges_fade_to_zero(spark):
    got = spark.createDataFrame([([1.0] * 10,), ([2.0] * 3,), ([1.0],)], "x array<double>").select(signal.edge_faded(F.col("x"), 4)).collect()
    assert got[0][0] == [0.0, 0.25, 0.5, 0.75, 1.0, 1.0, 0.75, 0.5, 0.25, 0.0]
    assert got[1][0] == [0.0, 1.0, 0.0] and got[2][0] == [1.0]


def test_adapted_needs_evidence(spark):
    rows = spark.createDataFrame([([1.0, 1.0], None), (None, [3.0]), ([1.0], [2.0]), (None, None)], "centroid array<double>, evidence array<double>")
    got = [r.adapted for r in profiles.adapted(rows).collect()]
    assert got[0] is None and got[1] == [3.0] and got[2] == pytest.approx([1.9]) and got[3] is None


def test_blocks_and_places(spark):
    rows = spark.createDataFrame([(k, i, float(i)) for k, n in ((1, 7), (2, 3), (3, 40)) for i in range(n)], "k long, i long, x double")
    got = {(r.k, r.block): (r.n, r.samples) for r in framing.framed(rows, "k", ["i"], "x", 3).collect()}
    assert got[1, 2] == (1, [6.0, 0.0, 0.0]) and got[2, 0] == (3, [0.0, 1.0, 2.0])
    assert framing.framed(rows, "k", ["i"], "x", 3, pad=False).count() == 2 + 1 + 13
    for most in (1, 3, 8, 100):
        places = sorted((r.k, r.place) for r in framing.evenly_spaced(rows, "k", ["i"], most).collect())
        assert places == sorted((k, i * n // min(n, most)) for k, n in ((1, 7), (2, 3), (3, 40)) for i in range(min(n, most)))
    starts = spark.createDataFrame([(n,) for n in (0, 9, 10, 29, 30, 60, 61)], "n long").select(framing.window_starts(F.col("n"), 30, 15, 10)).collect()
    assert [r[0] for r in starts] == [None, None, [0], [0], [0], [0, 15, 30], [0, 15, 30]]


def test_streams_are_picked(spark):
    rows = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.1), (2, 1, 0.3), (3, 1, None), (4, 1, 0.9)], "b long, stream int, score double")
    got = {r.b: (r.stream, r.score, r.accepted) for r in separation.picked(rows, "b", 0.4).collect()}
    assert got == {1: (0, 0.5, True), 2: (1, 0.3, False), 3: (0, 0.0, False), 4: (1, 0.9, True)}
    rows = spark.createDataFrame([([0.3, -0.3], [0.0, 0.0], [-0.6, 0.6]), ([0.0, 0.0], [0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>, m array<double>")
    got = [tuple(r) for r in rows.select(separation.stream_gain(F.col("a"), F.col("b"), F.col("m")), separation.audible(F.col("a")), vectors.rms(separation.normalised(F.col("a")))).collect()]
    assert got[0] == (pytest.approx(-2.0), True, pytest.approx(0.08)) and got[1] == (100.0, False, 0.0)


OWN, OTHER = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
QUICK = dict(window=2, update=1, reopen=1, after_silence=1, pre_roll=0)


def _play(config, frames, pool=None):
    s = session.Session(config, session.Pool([OWN]) if pool is None else pool)
    return s, [s.step(*f) for f in frames]


def test_session_waits_for_a_full_window():
    config = session.SessionConfig(gate=gate.GateConfig(theta=0.45, hangover_ms=64), **(QUICK | dict(window=3)))
    _, got = _play(config, [(0.9, OWN)] * 4 + [(0.1, OTHER)] * 2)
    assert [g[0] for g in got] == [False, False, True, True, True, True]  # a pause keeps the last score
    assert [g[1] for g in got][:3] == [0.0, 0.0, 1.0]


def test_session_silence_and_latency():
    config = session.SessionConfig(gate=gate.GateConfig(theta=0.45), latency=2, silence_off_ms=64, **QUICK)
    _, got = _play(config, [(0.9, OWN)] * 6 + [(0.1, OTHER)] * 3 + [(0.9, OWN)])
    assert [g[0] for g in got] == [False, False, False, True, True, True, True, False, False, True]


def test_session_learns_and_seeds():
    config = session.SessionConfig(gate=gate.GateConfig(theta=0.45), least_s=0.064, bootstrap=True, latency=1, **QUICK)
    s, got = _play(config, [(0.9, OWN, 120.0)] * 8, session.Pool())
    events = [g[4] for g in got if g[4]]
    assert events[0] == "BootstrapSeed" and set(events[1:]) == {"Admit"} and s.pool.f0_mean == 120 and s.pool.f0_sigma == 40
    s, got = _play(session.SessionConfig(gate=gate.GateConfig(theta=0.45), least_s=0.064, bootstrap=True, **QUICK), [(0.9, OWN, 120.0)] * 8, session.Pool())
    assert not s.pool.anchors  # only late results seed
    s.pool.add([OWN])
    s.reset()
    assert s.pool.anchors and s.frame == 0 and s.last == 0.0


def test_session_turn_boundary_shuts_the_gate():
    config = session.SessionConfig(gate=gate.GateConfig(theta=0.45, margin=0.08, hangover_ms=2000), latency=1, turn_silence_ms=64, learn=False, **QUICK)
    frames = [(0.9, OTHER)] * 8 + [(0.9, OWN)] * 6 + [(0.1, OWN)] * 3 + [(0.9, OTHER)] * 3
    s, got = _play(config, frames)
    on = [g[0] for g in got]
    assert len(s.others) and on[13] and on[14] and not any(on[15:])
    late = session.Session(config, session.Pool([OWN]))
    late.awaiting, late.flying, late.frame = 5, (6, np.array(OWN), 0.0, 4), 6
    late.step(0.1, OWN)
    assert late.applied == 4 and late.awaiting == 5  # a result from before the change does not release it


def test_session_stream_equals_batch(spark, tmp_path):
    from frameloom.streaming.session_stream import sessions

    rng = np.random.default_rng(2)
    rows = [(k, i, float(rng.random() > 0.2), rng.normal(size=3).tolist(), float(rng.integers(90, 150)) if rng.random() > 0.3 else None, i == 25) for i in range(40) for k in range(3)]
    schema = "session long, seq long, speech double, vec array<double>, f0 double, reset boolean"
    for n in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 10 == n], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    config = session.SessionConfig(gate=gate.GateConfig(theta=0.3, margin=0.05, alpha=0.8), latency=1, least_s=0.032, theta_learn=0.3, **QUICK)

    def start():
        return session.Session(config, session.Pool([OWN, OTHER], f0_mean=120, f0_sigma=20))

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = sessions(source, start).writeStream.format("memory").queryName("played").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.session, r.seq): (r.is_on, r.score, r.cos, r.f0_match, r.event) for r in spark.table("played").collect()}
    want = {}
    for k in range(3):
        s = start()
        for r in (r for r in rows if r[0] == k):
            if r[5]:
                s.reset()
            want[k, r[1]] = s.step(r[2], r[3], r[4])
    assert got == want and len({w[0] for w in want.values()}) == 2


def test_diagnostics(spark):
    frames = spark.createDataFrame([(1, 0, False, 0.25, 0.25, 1.0, None), (1, 1, True, 0.5, 0.5, 1.0, "Admit")], "k long, frame_idx long, is_on boolean, score double, cos double, f0_match double, event string")
    turned = spark.createDataFrame([(1, 0, False), (1, 512, True)], "k long, start long, is_on boolean")
    got = json.loads(diagnostics.rendered(frames, turned, "k").first().value)
    assert got["version"] == 1 and got["gate_per_frame"] == [False, True] and got["gate_decisions"] == [[0, False], [512, True]]
    assert got["score_per_frame"] == [0.25, 0.5] and got["auto_learn_events"] == [{"frame_idx": 1, "kind": "Admit", "score": 0.5, "f0_match": 1.0}]


def test_pitch_statistics(spark):
    rows = spark.createDataFrame([(1, 100.0), (1, 140.0), (1, float("nan")), (1, None), (2, None), (3, float("inf")), (4, 90.0)], "k long, f0 double")
    got = {r.k: (r.f0_mu, r.f0_sigma) for r in profiles.f0_statistics(rows, "k", "f0").collect()}
    assert got == {1: (120.0, 20.0), 2: (0.0, 0.0), 3: (0.0, 0.0), 4: (90.0, 0.0)}


def test_pitch_hint():
    t = np.arange(2048) / 16_000
    x = 0.5 * np.sin(2 * np.pi * 220 * t) + 0.25 * np.sin(2 * np.pi * 440 * t)
    assert dsp.pitch(x, 16_000, hint=110.0) == pytest.approx(110, rel=0.05)  # twice the period repeats as well
    for hint in (None, 220.0, 3.0, float("nan"), 9000.0):
        assert dsp.pitch(x, 16_000, hint=hint) == pytest.approx(220, rel=0.05)
    noise = np.random.default_rng(0).normal(size=2048)
    assert dsp.pitch_track(np.concatenate([x, noise, x]))[0] == pytest.approx(220, rel=0.05) and dsp.pitch(noise, 16_000, hint=220.0) is None
    assert dsp.pitch_track(x[:100]) == []


def test_stages_take_any_pieces():
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    for to, from_ in ((48, 16), (16, 48), (441, 160), (5, 5)):
        want = dsp.Sinc(to, from_)(x, 0, 0, dsp.Sinc(to, from_).length(len(x)))
        for options in ({}, {"fixed_out": 512}, {"fixed_in": 1024}):
            stage, out, at = stages.Resampler(to, from_, **options), [], 0
            while at < len(x):
                n = int(rng.integers(1, 400))
                out += stage.push(x[at : at + n])
                at += n
            if "fixed_out" in options:
                assert {len(o) for o in out} == {512}
            out += stage.flush()
            assert np.array_equal(np.concatenate(out), want)

    def fails(block):
        if block[0] == 3:
            raise RuntimeError("a block")
        return block

    stage = stages.Blocks(3, fails)
    assert not stage.push(np.arange(2.0))
    with pytest.raises(RuntimeError):
        stage.push(np.arange(2.0, 8.0))
    assert [b.tolist() for b in stage.push(np.array([8.0]))] == [[6.0, 7.0, 8.0]]  # the block that failed is gone
    stage.push(np.array([9.0]))
    assert [b.tolist() for b in stage.flush()] == [[9.0]] and not stage.flush()
    ring = stages.pitch_ring()
    t = np.arange(4096) / 16_000
    found = [ring.push(np.sin(2 * np.pi * 200 * t[i : i + 512]))[0] for i in range(0, 4096, 512)]
    assert [len(f) for f in found] == [0, 0, 0, 1, 1, 1, 1, 1] and found[-1][0] == pytest.approx(200, rel=0.05)


def test_stage_stream_equals_whole(spark, tmp_path):
    from frameloom.streaming.stage_stream import staged

    rng = np.random.default_rng(4)
    signals = {k: rng.normal(size=120) for k in range(3)}
    rows = [(k, i, x[i * 12 : (i + 1) * 12].tolist(), i == 9) for k, x in signals.items() for i in range(10)]
    schema = "session long, seq long, samples array<double>, last boolean"
    for n in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 5 == n], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = staged(source, lambda: stages.Resampler(3, 2, fixed_out=16)).writeStream.format("memory").queryName("resampled").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    for k, x in signals.items():
        got = [v for r in spark.table("resampled").where(f"session = {k}").sort("block").collect() for v in r.samples]
        assert got == pytest.approx(dsp.resample(x, 3, 2).tolist())


def test_models_hold_their_contracts(tmp_path, monkeypatch):
    seen = []
    vad = models.VoiceActivity(lambda x, state: (seen.append(x) or 0.7, (state or 0) + 1))
    assert vad(np.ones(512)) == 0.7 and vad(np.zeros(512)) == 0.7 and vad.state == 2
    assert seen[0][:64].sum() == 0 and seen[1][:64].sum() == 64
    with pytest.raises(ValueError):
        vad(np.ones(511))
    encoder = models.Encoder(lambda f: f, pool=lambda f: np.full(192, f.mean()))
    assert encoder(np.ones((5, 80))).shape == (192,) and encoder.parts()[0] is encoder.model
    for bad in (np.ones((5, 79)), np.ones((0, 80))):
        with pytest.raises(ValueError):
            encoder(bad)
    with pytest.raises(ValueError):
        models.Encoder(lambda f: f.mean(0))(np.ones((3, 80)))
    with pytest.raises(ValueError):
        models.Encoder(lambda f: np.ones(192)).parts()
    calls = []
    stage = models.extractor(lambda x, s: (calls.append(1) or x * 2, s), chunk=4, tensors=3)
    assert [b.tolist() for b in stage.push(np.array([0.0, 0, 0, 0, 1, 1, 1, 1]))] == [[0] * 4, [2] * 4] and len(calls) == 1
    with pytest.raises(ValueError):
        models.extractor(lambda x, s: (x, s[1:]), chunk=2).push(np.ones(2))
    assert models.denoiser(lambda x, s: (x, s), hop=2).push(np.ones(5))[1].tolist() == [1, 1]
    apart = models.two_streams(lambda x: np.stack([x, -x]))
    assert apart(np.ones(8000)).shape == (2, 8000)
    with pytest.raises(ValueError):
        models.two_streams(lambda x: np.stack([x, x * np.nan]))(np.ones(8000))
    overlap = models.Overlap(lambda x: np.zeros((3, 7)), rate=8, cadence_ms=500)
    assert [overlap.push(np.ones(2)) is not None for _ in range(8)] == [False, False, False, True, False, True, False, True]
    assert models.conditioning([[1.0] * 192, [3.0] * 192])[0] == 2 and models.conditioning([[1.0] * 192], [2.0] * 192)[0] == pytest.approx(1.9)
    assert len(models.calibrated([1], list(range(9)))) == 9
    for call in (lambda: models.conditioning([]), lambda: models.calibrated([1], [1, 2, 3])):
        with pytest.raises(ValueError):
            call()
    monkeypatch.delenv("SOME_MODEL", raising=False)
    with pytest.raises(FileNotFoundError):
        models.local_model("m.onnx", "SOME_MODEL", str(tmp_path))
    (tmp_path / "m.onnx").write_bytes(b"x")
    assert models.local_model("m.onnx", "SOME_MODEL", str(tmp_path)) == str(tmp_path / "m.onnx")


def test_session_with_a_cohort_flush_and_routing():
    assert session.as_norm(np.array([1.0, 0, 0]), 0.8, np.array([[d, 0, 0] for d in (0.4, 0.5, 0.6, 0.7, 0.0)]), 4) == pytest.approx(2.236068, abs=1e-5)
    assert session.as_norm(np.array([1.0, 0]), 0.9, np.array([[1.0, 0]] * 4), 4) == pytest.approx(-0.1) and session.as_norm(np.zeros(2), 0.4, np.eye(2)) == 0.4
    config = session.SessionConfig(gate=gate.GateConfig(as_norm=True), **QUICK)
    s = session.Session(config, session.Pool([OWN]), cohort=[[0.1, 1, 0], [0.0, 0, 1], [0.2, 0, 0.9]])
    assert [s.step(0.9, OWN)[0] for _ in range(2)] == [False, True] and s.last > 2.25
    s.step(0.9, OTHER)
    assert not s.step(0.9, OTHER)[0] or s.gate.is_on
    with pytest.raises(ValueError):
        gate.GateConfig(margin=0.1, as_norm=True)
    late = session.Session(session.SessionConfig(gate=gate.GateConfig(theta=0.45), latency=5, least_s=0.032, theta_learn=0.3, **QUICK), session.Pool([OWN], 120.0, 20.0))
    assert [late.step(0.9, OWN, 120.0)[4] for _ in range(4)] == [None] * 4 and late.last == 0.0
    assert late.flush() == ["Admit", "Admit"] and late.last == 1.0 and not late.flush()
    routed = session.Session(session.SessionConfig(gate=gate.GateConfig(theta=0.45, hangover_ms=64, dt_ms=250.0), routing=True, **QUICK), session.Pool([OWN]))
    got = [routed.step(0.9, OTHER, None, p)[0] for p in (0.9, 0.9, 0.9, 0.0, 0.0, 0.0)]
    assert got == [False, True, True, True, False, False]  # in overlap speech decides


def test_empty_beginnings_may_be_written(spark):
    schema = "k long, anchors array<array<double>>"
    before = spark.createDataFrame([(1, [[1.0]]), (2, [])], schema)
    after = spark.createDataFrame([(1, [[1.0], [2.0]]), (2, [[3.0]]), (3, [[4.0]]), (4, [])], schema)
    assert sorted(r.k for r in documents.begun_empty(before, after, "k").collect()) == [2, 3]


def test_wav_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", [0.0, 0.5]), ("b", None)], "name string, samples array<double>")
    assert sorted((r.name, r.bytes) for r in audio.write(rows, "file://" + str(tmp_path / "w"), 16_000).collect()) == [("a", 48), ("b", 44)]
    assert sorted(len(r.samples) for r in audio.read(spark, str(tmp_path / "w")).collect()) == [0, 2]


def test_levels_equal_the_envelope(spark):
    rng = np.random.default_rng(5)
    on = [bool(v) for v in rng.random(60) > 0.5]
    rows = spark.createDataFrame([(k, i, v) for k in (1, 2) for i, v in enumerate(on)], "k long, i long, is_on boolean")
    starts = [(i * 32, v) for i, v in enumerate(on) if i == 0 or on[i - 1] != v]
    for carried in (0.0, 0.7):
        want = runs.envelope(starts, 60 * 32, start=carried)[31::32]
        got = {(r.k, r.i): r.level for r in runs.levels(rows, "k", ["i"], 32, carried=carried).collect()}
        assert [got[2, i] for i in range(60)] == pytest.approx(want.tolist()) and len(got) == 120


def test_recordings_are_enrolled_and_processed(spark):
    t = np.arange(16_000 * 9) / 16_000
    tone = 0.3 * np.sin(2 * np.pi * 150 * t) + 0.2 * np.sin(2 * np.pi * 300 * t)
    rows = spark.createDataFrame([(1, 16_000, tone.tolist()), (2, 16_000, tone[:15_999].tolist()), (3, 16_000, tone[:20_000].tolist()), (1, 32_000, np.repeat(tone[:80_000], 2).tolist())], "k long, rate int, samples array<double>")
    got = {r.k: r for r in offline.enrolled(rows, "k", lambda f: f.mean(0) + 100).collect()}
    assert sorted(got) == [1, 3] and got[1].n == 5 + 2 and got[3].n == 1 and not got[3].accepted
    assert got[1].accepted and len(got[1].anchors) == 7 and got[1].median_cos > 0.9 and got[1].f0_mu == pytest.approx(150, rel=0.02)
    x = np.ones(5)
    assert offline.decision_view(x, 16_000) is x and len(offline.decision_view(x, 8_000)) == 10
    config = session.SessionConfig(gate=gate.GateConfig(theta=0.45, hangover_ms=64), **QUICK)
    voice = [OTHER] * 4 + [OWN] * 6 + [OTHER] * 6
    frames = spark.createDataFrame([(k, i, 0.9, v, 120.0) for k in (1, 2) for i, v in enumerate(voice)], "k long, i long, speech double, vec array<double>, f0 double")
    decided, turned = offline.processed(frames, "k", ["i"], ["speech", "vec", "f0"], lambda: session.Session(config, session.Pool([OWN])), pre_roll_ms=32)
    _, want = _play(config, [(0.9, v, 120.0) for v in voice])
    rows = decided.where("k = 2").sort("i").collect()
    assert [r.is_on for r in rows] == [w[0] for w in want] and rows[3].level == 0 and rows[9].level > 0.9
    first = next(i for i, w in enumerate(want) if w[0])
    starts = [(r.start, r.is_on) for r in turned.where("k = 1").sort("start").collect()]
    assert starts[:2] == [(0, False), ((first * 512 - 512) * 3, True)]
    pool = session.Pool([OWN, OTHER])
    assert len(pool) == 2 and pool.adapt(np.array(OWN)) and [v.tolist() for v in pool][:2] == [OWN, OTHER] and len(pool) == 3
