"""Registered queries by name, with DuckDB counterparts.

Profiles are the labels of ``embeddings``; their anchors are the 12 smallest vec_id of a label, the other vectors are probes.
Sessions are the users of ``events`` in order of (ts, event_id); a row is a 32 ms frame with score least(value / 100, 1), and
errors carry a rival's score of 0.4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions import signal, vectors
from frameloom.operators import capture, framing, gate, matching, profiles, runs, separation, session
from frameloom.plans import relational, samples
from frameloom.sources import diagnostics

ANCHORS = 12
GATE = gate.GateConfig(theta=0.45, hangover_ms=100.0, margin=0.08, floor_frac=0.6)
ORDER = ["ts", "event_id"]


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """anchors (grp, idx, vec) and probes (vec_id, grp, embedding)."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", F.col("label").cast("long").alias("grp"))
    firsts = rows.select("grp", "vec_id").withColumn("idx", F.row_number().over(Window.partitionBy("grp").orderBy("vec_id"))).where(F.col("idx") <= ANCHORS)
    anchors = rows.join(firsts, ["grp", "vec_id"]).select("grp", "idx", F.col("embedding").alias("vec"), "vec_id")
    return anchors, rows.join(firsts.select("vec_id"), "vec_id", "left_anti")


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    other = F.when(F.col("event_type") == "error", 0.4).otherwise(0.0)
    return e.select("user_id", "ts", "event_id", "event_type", "value", F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), other.alias("other"))


def _six(name: str):
    return F.round(F.col(name), 6).alias(name)


def cosine_pairs(spark, sf):
    anchors, _ = _vectors(spark, sf)
    a, b = anchors.alias("a"), anchors.alias("b")
    pairs = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.idx") < F.col("b.idx")))
    return pairs.select("a.grp", F.col("a.vec_id").alias("left_id"), F.col("b.vec_id").alias("right_id"), F.round(vectors.cosine(F.col("a.vec"), F.col("b.vec")), 6).alias("cos"))


def pool_match_score(spark, sf):
    anchors, probes = _vectors(spark, sf)
    found = matching.best_by_group(probes, anchors)
    return found.select(F.col("key").alias("vec_id"), "grp", F.round(F.greatest("cos", F.lit(0.0)), 6).alias("score"))


def best_profile_match(spark, sf):
    anchors, probes = _vectors(spark, sf)
    found = matching.best_profile(probes, anchors)
    return found.select(F.col("key").alias("vec_id"), "grp", _six("score"))


def anchor_distance_guard(spark, sf):
    anchors, probes = _vectors(spark, sf)
    found = profiles.within_guard(matching.best_by_group(probes, anchors), 0.75)
    return found.select(F.col("key").alias("vec_id"), "grp", _six("distance"), (F.round("distance", 6) <= 0.75).alias("admitted"))


def as_norm_top20(spark, sf):
    """The probe's largest cosine with its own profile, against the anchors of the others."""
    anchors, probes = _vectors(spark, sf)
    raw = matching.own_profile(probes, anchors)
    return matching.as_norm(raw, anchors, key="key", vec="vec").select(F.col("key").alias("vec_id"), _six("raw"), _six("score"))


def profile_centroids(spark, sf):
    """Of all vectors of a label."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("label").cast("long").alias("grp"), F.col("embedding").alias("vec"))
    return profiles.centroids(rows).select("grp", F.posexplode("centroid").alias("pos", "x")).select("grp", F.col("pos").cast("long").alias("pos"), _six("x"))


def _adapted(anchors, probes):
    """Profiles that were enrolled with the anchors and learned from all probes of their own, in order."""
    learned = profiles.evidence(probes.withColumnRenamed("embedding", "vec"), ["vec_id"])
    return profiles.adapted(profiles.centroids(anchors).join(learned, "grp"))


def adapted_blend(spark, sf):
    out = _adapted(*_vectors(spark, sf))
    return out.select("grp", F.posexplode("adapted").alias("pos", "x")).select("grp", F.col("pos").cast("long").alias("pos"), _six("x"))


def match_scores(spark, sf):
    """Every probe against every profile: one condition each, and what was learned."""
    anchors, probes = _vectors(spark, sf)
    found = matching.match_score(probes, profiles.centroids(anchors), _adapted(anchors, probes))
    return found.select(F.col("key").alias("vec_id"), "grp", _six("score"))


def enrollment_consistency(spark, sf):
    anchors, _ = _vectors(spark, sf)
    found = profiles.consistency(anchors, floor=0.0)
    return found.select("grp", "n", _six("median_cos"), (F.col("accepted")).alias("accepted"))


def condition_groups(spark, sf):
    anchors, _ = _vectors(spark, sf)
    return profiles.condition_groups(anchors).select("grp", "condition", F.posexplode("centroid").alias("pos", "x")).select("grp", "condition", "pos", _six("x"))


def pooled_f0_merge(spark, sf):
    """Clicks and views of a user as two enrolments, pooled."""
    e = spark.read.parquet(f"{sf}/events.parquet").where("event_type in ('click', 'view')")
    click = F.col("event_type") == "click"
    stats = [F.count_if(c).alias(f"n{i}") for i, c in ((1, click), (2, ~click))]
    stats += [f(F.when(c, F.col("value"))).alias(f"{n}{i}") for i, c in ((1, click), (2, ~click)) for n, f in (("m", F.avg), ("v", F.var_pop))]
    by = e.groupBy("user_id").agg(*stats).where("n1 > 0 and n2 > 0")
    mean, var = profiles.pooled(*(F.col(c) for c in ("n1", "m1", "v1", "n2", "m2", "v2")))
    return by.select("user_id", F.round(mean, 6).alias("mean"), F.round(var, 4).alias("variance"))


def gate_hangover(spark, sf):
    found = gate.hangover_gate(_frames(spark, sf).withColumn("other", F.lit(0.0)), "user_id", ORDER, gate.GateConfig(theta=0.45, hangover_ms=100.0))
    return found.select("user_id", "event_id", "is_on")


def _gated(spark, sf):
    return gate.hangover_gate(_frames(spark, sf), "user_id", ORDER, GATE)


def gate_margin_floor(spark, sf):
    return _gated(spark, sf).select("user_id", "event_id", "is_on")


def gate_runs(spark, sf):
    found = runs.runs(_gated(spark, sf), "user_id", ORDER)
    return found.select("user_id", F.col("start").alias("run_start"), F.col("end").alias("run_end"), "is_on")


def gate_duty_cycle(spark, sf):
    on = F.count_if("is_on")
    return _gated(spark, sf).groupBy("user_id").agg(F.expr("count_if(is_on) * 100 div greatest(count(*), 1)").alias("percent"), on.alias("frames_on"))


def consecutive_runs(spark, sf):
    found = gate.islands(_frames(spark, sf), "user_id", ORDER, F.col("score") > 0.3)
    return found.select("user_id", "event_id", F.round("speech_ms", 3).alias("speech_ms"), F.round("silence_ms", 3).alias("silence_ms"))


def silence_force_off(spark, sf):
    found = gate.islands(_gated(spark, sf), "user_id", ORDER, F.col("score") > 0.3)
    off = F.col("silence_ms") >= 64
    no = F.lit(False)
    is_on = gate.final_gate(no, False, F.col("score") > 0.3, F.col("silence_ms"), 100.0, F.col("is_on"), off, no, no)
    return found.select("user_id", "event_id", is_on.alias("is_on"))


def preroll_lookback(spark, sf):
    found = runs.preroll(runs.runs(_gated(spark, sf), "user_id", ORDER), "user_id", 3)
    return found.select("user_id", F.col("start").alias("run_start"), "is_on")


def rate_scale(spark, sf):
    found = runs.rescaled(runs.runs(_gated(spark, sf), "user_id", ORDER).withColumn("start", F.col("start") * 512), "user_id", 44_100, 16_000)
    return found.select("user_id", F.col("start").alias("sample"), "is_on")


def score_asof_forward_fill(spark, sf):
    """Purchases are refreshes; every later frame carries the last one's score."""
    frames = _frames(spark, sf).withColumn("refreshed", F.when(F.col("event_type") == "purchase", F.col("score")))
    return gate.carried(frames, "user_id", ORDER, "refreshed", "carried").select("user_id", "event_id", _six("carried"))


def auto_learn_admission(spark, sf):
    found = gate.islands(_frames(spark, sf), "user_id", ORDER, F.col("score") > 0.1)
    match = gate.pitch_match(F.col("value"), F.lit(90.0), F.lit(40.0))
    return found.select("user_id", "event_id", F.round(match, 6).alias("f0_match"), gate.admitted(F.col("score"), match, F.col("speech_ms"), theta=0.5, least_s=0.064).alias("admitted"))


def soft_limit(spark, sf):
    x = F.col("value") / 50 - 1
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.round(signal.soft_limit(x), 6).alias("limited"))


def db_gain(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.round(signal.db_to_linear(F.col("value") / 10 - 6), 6).alias("gain"))


def envelope_range_join(spark, sf):
    """Every frame with the run that covers it and the gain at its end: attack, release, and what the last run left."""
    found = runs.levels(_gated(spark, sf).select("user_id", *ORDER, "is_on"), "user_id", ORDER, 512)
    return found.select("user_id", "event_id", F.col("start").cast("long").alias("run_start"), _six("level"))


def score_ema(spark, sf):
    def start():
        g = gate.Gate(gate.GateConfig(alpha=0.4))
        return lambda score: (g.step(score)[2],)

    found = gate.sequential(_frames(spark, sf), "user_id", ORDER, ["score"], "smoothed double", start)
    return found.select("user_id", "event_id", _six("smoothed"))


def adaptive_theta_gate(spark, sf):
    def start():
        g = gate.Gate(gate.GateConfig(theta=0.30, adaptive=True))
        return lambda score: g.step(score)[:2]

    found = gate.sequential(_frames(spark, sf), "user_id", ORDER, ["score"], "is_on boolean, theta double", start)
    return found.select("user_id", "event_id", "is_on", _six("theta"))


def overlap_hysteresis(spark, sf):
    def start():
        h = gate.Hysteresis(threshold=0.35)
        return lambda score: (h.step(score),)

    found = gate.sequential(_frames(spark, sf), "user_id", ORDER, ["score"], "overlap boolean", start)
    return found.select("user_id", "event_id", "overlap")


def turn_detector(spark, sf):
    def start():
        t = gate.TurnDetector(stable_frames=3)

        def step(score, is_on):
            entered = t.step(score if score > 0.1 else None, is_on)
            t.refresh_done()
            return t.state, entered

        return step

    found = gate.sequential(_gated(spark, sf), "user_id", ORDER, ["score", "is_on"], "state string, entered boolean", start)
    return found.select("user_id", "event_id", "state", "entered")


def other_speaker_fold(spark, sf):
    """Probes of a label as one session in order of vec_id, against the label's own centroid."""
    import numpy as np

    anchors, probes = _vectors(spark, sf)
    rows = probes.join(profiles.centroids(anchors), "grp")

    def start():
        others = gate.OtherSpeakers(agree=0.1, merge=0.3, guard=1.5)

        def step(vec, centroid):
            vec, centroid = np.array(vec, float), np.array(centroid, float)

            def own(v):
                size = float(np.linalg.norm(v) * np.linalg.norm(centroid))
                return float(v @ centroid) / size if size else 0.0

            score = own(vec)
            rival = others.score(vec, score, 0.25, 0.08)
            others.learn(vec, score, 0.25, own)
            return rival, len(others)

        return step

    found = gate.sequential(rows, "grp", ["vec_id"], ["embedding", "centroid"], "rival double, clusters int", start)
    return found.select("grp", "vec_id", _six("rival"), "clusters")


def capture_quality(spark, sf):
    """A user's scores less 0.2 as samples, 4 of which are a 20 ms frame."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy(*ORDER)) - 1
    samples = _frames(spark, sf).select("user_id", i.alias("i"), (F.col("score") - 0.2).alias("x"))
    found = capture.quality(samples, "user_id", frame=4)
    return found.select("user_id", "n", _six("rms_dbfs"), _six("peak"), F.round("dc", 10).alias("dc"), _six("clipped_ratio"), _six("active_ratio"), "verdict")


def overlap_summary(spark, sf):
    """The first 7 places of a vector, times 8, as a frame's class logits; labels are windows."""
    frames = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("label").cast("long").alias("grp"), F.transform(F.slice("embedding", 1, 7), lambda x: x.cast("double") * 8).alias("logits"))
    found = capture.overlap_summary(frames, "grp")
    return found.select("grp", _six("mean_prob"), _six("max_prob"), "overlap_frames", "total_frames", _six("fraction"))


def separator_pick(spark, sf):
    """Even and odd vec_id of a pair are two streams, matched with the raw anchors of profile 0."""
    anchors, probes = _vectors(spark, sf)
    found = matching.best_by_group(probes, anchors.where("grp = 0"))
    scores = found.select(F.expr("key div 2").alias("block"), F.expr("key % 2").alias("stream"), F.col("cos").alias("score"))
    return separation.picked(scores, "block", 0.2).select("block", F.col("stream").cast("long").alias("stream"), _six("score"), "accepted")


def block_levels(spark, sf):
    """Blocks of 10 scores, the last filled up with zeros, and their levels."""
    found = framing.framed(_frames(spark, sf), "user_id", ORDER, "score", 10)
    return found.select("user_id", "block", "n", F.round(vectors.rms(F.col("samples")), 6).alias("rms"))


def enrolment_windows(spark, sf):
    """Starts of windows of 30 frames, 15 apart, in every user's events."""
    counts = spark.read.parquet(f"{sf}/events.parquet").where("event_type <> 'view'").groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", F.explode(framing.window_starts(F.col("n"), 30, 15, 10)).alias("window_start"))


def evenly_spaced_blocks(spark, sf):
    found = framing.evenly_spaced(_frames(spark, sf).select("user_id", *ORDER), "user_id", ORDER)
    return found.select("user_id", "event_id", F.col("place").cast("long").alias("place"))


def lookahead_pairs(spark, sf):
    """A frame's score with that of two frames later, 0 past the end."""
    return framing.ahead(_frames(spark, sf), "user_id", ORDER, "score", "later").select("user_id", "event_id", _six("score"), _six("later"))


def onset_lookback(spark, sf):
    """The three scores before each onset of speech."""
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    speech = F.col("score") > 0.3
    found = framing.behind(_frames(spark, sf), "user_id", ORDER, "score", "before").withColumn("onset", speech & ~F.coalesce(F.lag(speech).over(w), F.lit(False)))
    return found.where("onset").select("user_id", "event_id", F.size("before").cast("long").alias("n_before"), F.round(F.aggregate("before", F.lit(0.0), lambda s, x: s + x), 6).alias("sum_before"))


def identity_windows(spark, sf):
    """Mean score of the last 5 speech frames."""
    found = framing.speech_window(_frames(spark, sf), "user_id", ORDER, F.col("score") > 0.3, "score", 5)
    return found.select("user_id", "event_id", _six("window_mean"), "window_n")


def f0_statistics(spark, sf):
    """Values as pitch; purchases count as unvoiced."""
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("f0", F.when(F.col("event_type") == "purchase", float("nan")).otherwise(F.col("value")))
    return profiles.f0_statistics(e, "user_id", "f0").select("user_id", _six("f0_mu"), _six("f0_sigma"))


def rolling_windows(spark, sf):
    """Mean and largest score of the last 7 frames, at every second frame."""
    found = framing.rolling(_frames(spark, sf), "user_id", ORDER, "score", 7, 2)
    return found.select("user_id", "event_id", _six("window_mean"), _six("window_max"))


def counter_deltas(spark, sf):
    """Running totals a user and day, and their growth."""
    by_day = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    totals = by_day.select("user_id", "day", F.sum("n").over(w).alias("frames"), F.sum("bad").over(w).alias("errors"))
    found = framing.counter_deltas(totals, "user_id", "day", ["frames", "errors"])
    return found.select("user_id", F.col("day").cast("string").alias("day"), "frames", "errors", "d_frames", "d_errors")


def survival_ratio(spark, sf):
    """What the gate leaves of the level of each event type."""
    found = _gated(spark, sf).withColumn("after", F.when(F.col("is_on"), F.col("score")).otherwise(0.0))
    return separation.survival(found, "event_type", "score", "after").select("event_type", _six("rms_in"), _six("rms_out"), _six("ratio"))


def _sessions(spark, sf):
    """Probes of a label as one session in order of vec_id: speech but for every seventh frame, against the label's own profile."""
    anchors, probes = _vectors(spark, sf)
    own = anchors.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "vec"))), lambda s: s["vec"]).alias("anchors"))
    frames = probes.join(own, "grp").withColumn("speech", F.when(F.col("vec_id") % 7 == 0, 0.1).otherwise(0.9))
    config = session.SessionConfig(gate=gate.GateConfig(theta=0.15, hangover_ms=100.0, margin=0.02, alpha=0.8), window=2, update=1, reopen=1, after_silence=1, latency=1, silence_off_ms=64.0, turn_silence_ms=32.0, theta_learn=0.3, least_s=0.064)

    def start():
        now = None

        def step(speech, vec, pool):
            nonlocal now
            now = now or session.Session(config, session.Pool(pool))
            return now.step(speech, vec)

        return step

    return gate.sequential(frames, "grp", ["vec_id"], ["speech", "embedding", "anchors"], "is_on boolean, score double, cos double, f0_match double, event string", start)


def session_fold(spark, sf):
    return _sessions(spark, sf).select("grp", "vec_id", "is_on", _six("score"), _six("cos"), "event")


def session_diagnostics(spark, sf):
    """The sessions of ``session_fold`` as JSON documents."""
    frames = _sessions(spark, sf).withColumn("frame_idx", F.row_number().over(Window.partitionBy("grp").orderBy("vec_id")) - 1)
    return diagnostics.rendered(frames, runs.runs(frames, "grp", ["vec_id"]), "grp")


def _named(*functions) -> dict:
    return {f.__name__: f for f in functions}


QUERIES: dict = _named(
    cosine_pairs, pool_match_score, best_profile_match, anchor_distance_guard, as_norm_top20, match_scores, profile_centroids, adapted_blend, enrollment_consistency, condition_groups, pooled_f0_merge,
    gate_hangover, gate_margin_floor, gate_runs, gate_duty_cycle, consecutive_runs, silence_force_off, preroll_lookback, rate_scale, score_asof_forward_fill, auto_learn_admission,
    soft_limit, db_gain, envelope_range_join, score_ema, adaptive_theta_gate, overlap_hysteresis, turn_detector, other_speaker_fold,
    capture_quality, overlap_summary, separator_pick, block_levels, enrolment_windows, evenly_spaced_blocks, lookahead_pairs, onset_lookback, identity_windows, counter_deltas, survival_ratio, f0_statistics, rolling_windows,
    session_fold, session_diagnostics,
) | samples.QUERIES | relational.QUERIES

_V = """WITH r AS (SELECT vec_id, CAST(label AS BIGINT) AS grp, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS idx FROM embeddings),
a AS (SELECT * FROM r WHERE idx <= 12), p AS (SELECT * FROM r WHERE idx > 12)"""
_SCORES = _V + ", s AS (SELECT p.vec_id, p.grp AS own, a.grp, max(list_cosine_similarity(p.v, a.v)) AS cos FROM p CROSS JOIN a GROUP BY 1, 2, 3)"
_LEARNED = _V + """, c AS (SELECT grp, pos, avg(x) AS x FROM (SELECT grp, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a) GROUP BY 1, 2),
k AS (SELECT grp, v, pow(7e-1, count(*) OVER (PARTITION BY grp) - idx + 12) * CASE WHEN idx = 13 THEN 1 ELSE 3e-1 END AS w FROM p),
d AS (SELECT grp, pos, 1e-1 * any_value(c.x) + 9e-1 * sum(w * y) AS x FROM (SELECT grp, w, unnest(v) AS y, generate_subscripts(v, 1) AS pos FROM k) JOIN c USING (grp, pos) GROUP BY 1, 2)"""
_E = "SELECT *, least(value / 100, 1e0) AS score, CASE WHEN event_type = 'error' THEN 4e-1 ELSE 0e0 END AS other, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def _gate_sql(theta: str, margin: str, floor: str, hangover: str, other: str = "other") -> str:
    return f"""e AS ({_E}),
k AS (SELECT *, score >= {theta} AND score - {other} >= {margin} AS ok, score - {other} >= {margin} AS wins FROM e),
l AS (SELECT *, max(CASE WHEN ok THEN rn END) OVER u AS lp, max(CASE WHEN NOT ok AND (score < {theta} * {floor} OR NOT wins) THEN rn END) OVER u AS lk
  FROM k WINDOW u AS (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, lp IS NOT NULL AND (lk IS NULL OR lp > lk) AND (rn - lp) * 32e0 < {hangover} AS is_on FROM l)"""


_GATED = "WITH " + _gate_sql("45e-2", "8e-2", "6e-1", "100")
_RUNS = _GATED + """, b AS (SELECT *, lag(is_on) OVER (PARTITION BY user_id ORDER BY rn) AS before, count(*) OVER (PARTITION BY user_id) AS n FROM g),
h AS (SELECT user_id, rn - 1 AS run_start, is_on, n FROM b WHERE before IS NULL OR before <> is_on),
runs AS (SELECT user_id, run_start, coalesce(lead(run_start) OVER (PARTITION BY user_id ORDER BY run_start), n) AS run_end, is_on FROM h)"""
_ISLANDS = """i AS (SELECT *, rn - coalesce(max(CASE WHEN NOT speech THEN rn END) OVER u, 0) AS sp, rn - coalesce(max(CASE WHEN speech THEN rn END) OVER u, 0) AS si
  FROM (SELECT *, score > {0} AS speech FROM {1}) WINDOW u AS (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING))"""

def _cosine(a: str, b: str) -> str:
    """In sums of products, as lists may be null."""
    dot = "list_sum(list_transform(range(1, 65), lambda d: {}[d] * {}[d]))"
    return f"({dot.format(a, b)} / sqrt({dot.format(a, a)} * {dot.format(b, b)}))"


ORACLES: dict = {
    "cosine_pairs": _V + " SELECT x.grp, x.vec_id AS left_id, y.vec_id AS right_id, round(list_cosine_similarity(x.v, y.v), 6) AS cos FROM a x JOIN a y ON x.grp = y.grp AND x.idx < y.idx",
    "pool_match_score": _SCORES + " SELECT vec_id, grp, round(greatest(cos, 0e0), 6) AS score FROM s",
    "best_profile_match": _SCORES + " SELECT vec_id, arg_max(grp, cos) AS grp, round(greatest(max(cos), 0e0), 6) AS score FROM s GROUP BY 1",
    "anchor_distance_guard": _SCORES + " SELECT vec_id, grp, round(1 - cos, 6) AS distance, round(1 - cos, 6) <= 75e-2 AS admitted FROM s",
    "as_norm_top20": _SCORES + """, o AS (SELECT vec_id, greatest(cos, 0e0) AS raw FROM s WHERE own = grp),
d AS (SELECT p.vec_id, list_dot_product(p.v, a.v) / sqrt(list_dot_product(p.v, p.v)) AS d FROM p CROSS JOIN a WHERE p.grp <> a.grp),
t AS (SELECT vec_id, avg(d) AS m, stddev_pop(d) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d DESC) AS rk FROM d) WHERE rk <= 20 GROUP BY 1)
SELECT o.vec_id, round(raw, 6) AS raw, round((raw - m) / sd, 6) AS score FROM o JOIN t USING (vec_id)""",
    "profile_centroids": "SELECT CAST(label AS BIGINT) AS grp, CAST(pos - 1 AS BIGINT) AS pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2",
    "adapted_blend": _LEARNED + " SELECT grp, CAST(pos - 1 AS BIGINT) AS pos, round(x, 6) AS x FROM d",
    "match_scores": _LEARNED + """, m AS (SELECT grp, list(x ORDER BY pos) AS v FROM c GROUP BY 1 UNION ALL SELECT grp, list(x ORDER BY pos) FROM d GROUP BY 1)
SELECT p.vec_id, m.grp, round(greatest(max(list_cosine_similarity(p.v, m.v)), 0e0), 6) AS score FROM p CROSS JOIN m GROUP BY 1, 2""",
    "condition_groups": _V.replace("WITH", "WITH RECURSIVE", 1) + """, b AS (SELECT grp, list(v ORDER BY idx) AS m, list(1 ORDER BY idx) AS s FROM a GROUP BY 1), x AS (
SELECT grp, m, s, 0 AS step, len(m) AS n, greatest(1, least(4, len(m) // 4)) AS budget, false AS done FROM b
UNION ALL SELECT grp, CASE WHEN stop THEN m ELSE list_transform(list_filter(range(1, n + 1), lambda k: k <> p.j),
    lambda k: CASE WHEN k = p.i THEN list_transform(range(1, len(m[p.i]) + 1), lambda d: (m[p.i][d] * s[p.i] + m[p.j][d] * s[p.j]) / (s[p.i] + s[p.j])) ELSE m[k] END) END,
  CASE WHEN stop THEN s ELSE list_transform(list_filter(range(1, n + 1), lambda k: k <> p.j), lambda k: CASE WHEN k = p.i THEN s[p.i] + s[p.j] ELSE s[k] END) END,
  step + 1, CASE WHEN stop THEN n ELSE n - 1 END, budget, stop FROM (
  SELECT *, n <= budget OR (p.c < 7e-1 AND n <= 4) AS stop FROM (
    SELECT *, list_filter(pairs, lambda q: q.c = list_max(list_transform(pairs, lambda r: r.c)))[1] AS p FROM (
      SELECT *, flatten(list_transform(range(1, n), lambda i: list_transform(range(i + 1, n + 1), lambda j: {'i': i, 'j': j, 'c': list_cosine_similarity(m[i], m[j])}))) AS pairs FROM x WHERE NOT done)))),
f AS (SELECT grp, m, n FROM x WHERE done), g AS (SELECT grp, m, unnest(range(n)) AS condition FROM f)
SELECT grp, CAST(condition AS INT) AS condition, CAST(pos - 1 AS INT) AS pos, round(x, 6) AS x FROM (SELECT grp, condition, unnest(m[condition + 1]) AS x, generate_subscripts(m[condition + 1], 1) AS pos FROM g)""",
    "other_speaker_fold": _V.replace("WITH", "WITH RECURSIVE", 1) + """, c AS (SELECT grp, list(x ORDER BY pos) AS c FROM (SELECT grp, pos, avg(x) AS x FROM (SELECT grp, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a) GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT p.grp, p.vec_id, p.v, c.c, p.idx - 12 AS k, list_cosine_similarity(p.v, c.c) AS own FROM p JOIN c USING (grp)), x AS (
SELECT grp, vec_id, k, 0e0 AS rival, CAST([] AS DOUBLE[][]) AS ctr, CAST([] AS INT[]) AS wt, CASE WHEN own < 25e-2 THEN 1 ELSE 0 END AS rej, CAST(NULL AS DOUBLE[]) AS wait, 0 AS blamed, 0 AS blame FROM h WHERE k = 1
UNION ALL SELECT grp, vec_id, k, rival,
  CASE WHEN NOT good THEN ctr WHEN known THEN list_transform(range(1, len(ctr) + 1), lambda i: CASE WHEN i = row2 THEN cand ELSE ctr[i] END) ELSE list_append(CASE WHEN gone > 0 THEN list_transform(list_filter(range(1, len(ctr) + 1), lambda i: i <> gone), lambda i: ctr[i]) ELSE ctr END, cand) END,
  CASE WHEN NOT good THEN wt WHEN known THEN list_transform(range(1, len(wt) + 1), lambda i: wt[i] + CASE WHEN i = row2 THEN 1 ELSE 0 END) ELSE list_append(CASE WHEN gone > 0 THEN list_transform(list_filter(range(1, len(wt) + 1), lambda i: i <> gone), lambda i: wt[i]) ELSE wt END, 2) END,
  rej, CASE WHEN NOT reject THEN NULL WHEN known OR rej < 2 THEN wait WHEN paired THEN NULL ELSE v END, CASE WHEN good AND gone > 0 THEN 0 ELSE blamed END, CASE WHEN good AND gone > 0 THEN 0 ELSE blame END FROM (
  SELECT *, coalesce(""" + _cosine("cand", "c") + """ < 25e-2 * 15e-1, false) AS good, CASE WHEN NOT known AND len(ctr) >= 6 THEN list_position(wt, list_min(wt)) ELSE 0 END AS gone FROM (
    SELECT *, CASE WHEN NOT reject THEN NULL WHEN known THEN list_transform(range(1, len(v) + 1), lambda d: ctr[row2][d] + 2e-1 * (v[d] - ctr[row2][d])) WHEN paired THEN list_transform(range(1, len(v) + 1), lambda d: (wait[d] + v[d]) / 2) END AS cand FROM (
      SELECT *, reject AND len(near2) > 0 AND coalesce(near2[row2] >= 3e-1, false) AS known, reject AND rej >= 2 AND NOT (len(near2) > 0 AND coalesce(near2[row2] >= 3e-1, false)) AND coalesce(""" + _cosine("wait", "v") + """ >= 1e-1, false) AS paired FROM (
        SELECT * EXCLUDE (rej), own < 25e-2 AS reject, CASE WHEN own < 25e-2 THEN rej + 1 ELSE 0 END AS rej, greatest(0e0, coalesce(list_max(near2), 0e0)) AS rival, len(near2) + 1 - list_position(list_reverse(near2), list_max(near2)) AS row2 FROM (
          SELECT * EXCLUDE (ctr, wt, blamed, blame), CASE WHEN dropped THEN list_transform(list_filter(range(1, n + 1), lambda i: i <> row1), lambda i: ctr[i]) ELSE ctr END AS ctr,
            CASE WHEN dropped THEN list_transform(list_filter(range(1, n + 1), lambda i: i <> row1), lambda i: wt[i]) ELSE wt END AS wt,
            CASE WHEN dropped THEN list_transform(list_filter(range(1, n + 1), lambda i: i <> row1), lambda i: near[i]) ELSE near END AS near2,
            CASE WHEN dropped OR blame = 0 THEN 0 ELSE blamed END AS blamed, CASE WHEN dropped THEN 0 ELSE blame END AS blame FROM (
            SELECT *, refuses AND blame >= 6 AS dropped FROM (
              SELECT * EXCLUDE (blamed, blame), CASE WHEN refuses THEN row1 ELSE blamed END AS blamed, CASE WHEN n = 0 THEN 0 WHEN refuses THEN 2 + CASE WHEN blamed = row1 THEN blame ELSE 0 END ELSE greatest(0, blame - 1) END AS blame FROM (
                SELECT *, n > 0 AND own >= 25e-2 AND coalesce(own < near[row1] + 8e-2, false) AS refuses FROM (
                  SELECT *, len(near) + 1 - list_position(list_reverse(near), list_max(near)) AS row1 FROM (
                    SELECT h.grp, h.vec_id, h.v, h.c, h.k, h.own, x.ctr, x.wt, x.rej, x.wait, x.blamed, x.blame, len(x.ctr) AS n, list_transform(x.ctr, lambda q: """ + _cosine("h.v", "q") + """) AS near
                    FROM x JOIN h ON h.grp = x.grp AND h.k = x.k + 1)))))))))))
SELECT grp, vec_id, round(rival, 6) AS rival, CAST(len(ctr) AS INT) AS clusters FROM x""",
    "enrollment_consistency": _V + """, q AS (SELECT x.grp, list_sort(list(list_cosine_similarity(x.v, y.v))) AS l FROM a x JOIN a y ON x.grp = y.grp AND x.idx < y.idx GROUP BY 1)
SELECT grp, n, round(coalesce(l[len(l) // 2 + 1], 0), 6) AS median_cos, n >= 6 AND coalesce(l[len(l) // 2 + 1], 0) >= 0 AS accepted FROM (SELECT grp, count(*) AS n FROM a GROUP BY 1) LEFT JOIN q USING (grp)""",
    "pooled_f0_merge": """SELECT user_id, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events WHERE event_type IN ('click', 'view')
GROUP BY 1 HAVING count(DISTINCT event_type) = 2""",
    "gate_hangover": "WITH " + _gate_sql("45e-2", "0", "0", "100", "0") + " SELECT user_id, event_id, is_on FROM g",
    "gate_margin_floor": _GATED + " SELECT user_id, event_id, is_on FROM g",
    "gate_runs": _RUNS + " SELECT user_id, run_start, run_end, is_on FROM runs",
    "gate_duty_cycle": _GATED + " SELECT user_id, count(*) FILTER (WHERE is_on) * 100 // greatest(count(*), 1) AS percent, count(*) FILTER (WHERE is_on) AS frames_on FROM g GROUP BY 1",
    "consecutive_runs": f"WITH e AS ({_E}), " + _ISLANDS.format("3e-1", "e") + " SELECT user_id, event_id, sp * 32e0 AS speech_ms, si * 32e0 AS silence_ms FROM i",
    "silence_force_off": _GATED + ", " + _ISLANDS.format("3e-1", "g") + " SELECT user_id, event_id, is_on AND NOT si * 32e0 >= 64 AS is_on FROM i",
    "preroll_lookback": _RUNS + """, m AS (SELECT *, CASE WHEN is_on AND lag(run_start) OVER w IS NOT NULL THEN greatest(run_start - 3, lag(run_start) OVER w) ELSE run_start END AS moved FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY run_start))
SELECT user_id, moved AS run_start, is_on FROM (SELECT *, lead(moved) OVER (PARTITION BY user_id ORDER BY run_start) AS nxt FROM m) WHERE nxt IS NULL OR nxt <> moved""",
    "rate_scale": _RUNS + " SELECT user_id, (run_start * 512 * 44100 + 8000) // 16000 AS sample, is_on FROM runs",
    "score_asof_forward_fill": f"WITH e AS ({_E}) SELECT user_id, event_id, round(last_value(CASE WHEN event_type = 'purchase' THEN score END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING), 6) AS carried FROM e",
    "auto_learn_admission": f"WITH e AS ({_E}), " + _ISLANDS.format("1e-1", "e") + """ SELECT user_id, event_id, round(m, 6) AS f0_match, score >= 5e-1 AND m >= 7e-1 AND sp * 32e0 >= 64 AS admitted
FROM (SELECT *, exp(-5e-1 * ((value - 90) / 40) * ((value - 90) / 40)) AS m FROM i)""",
    "soft_limit": "SELECT event_id, round(CASE WHEN abs(x) <= 95e-2 THEN x ELSE sign(x) * (95e-2 + 5e-2 * tanh((abs(x) - 95e-2) / 5e-2)) END, 6) AS limited FROM (SELECT event_id, value / 50 - 1 AS x FROM events)",
    "db_gain": "SELECT event_id, round(pow(10e0, (value / 10 - 6) / 20), 6) AS gain FROM events",
    "envelope_range_join": _RUNS.replace("WITH", "WITH RECURSIVE", 1) + """, q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY run_start) AS k,
  exp(-1000e0 / ((CASE WHEN is_on THEN 15e0 ELSE 100e0 END) * 16000)) AS keep, CASE WHEN is_on THEN 1e0 ELSE 0e0 END AS target FROM runs),
v AS (SELECT user_id, k, 0e0 AS entry FROM q WHERE k = 1
  UNION ALL SELECT q.user_id, q.k + 1, target + (entry - target) * pow(keep, (run_end - run_start) * 512e0) FROM v JOIN q ON q.user_id = v.user_id AND q.k = v.k)
SELECT g.user_id, g.event_id, q.run_start, round(target + (entry - target) * pow(keep, (g.rn - q.run_start) * 512e0), 6) AS level
FROM g JOIN q ON g.user_id = q.user_id AND g.rn - 1 >= q.run_start AND g.rn - 1 < q.run_end JOIN v ON v.user_id = q.user_id AND v.k = q.k""",
    "capture_quality": f"""WITH e AS ({_E}), f AS (SELECT user_id, (rn - 1) // 4 AS f, count(*) AS n, sum(score - 2e-1) AS s, sum((score - 2e-1) * (score - 2e-1)) AS q, max(abs(score - 2e-1)) AS p, count(*) FILTER (WHERE abs(score - 2e-1) >= 995e-3) AS c FROM e GROUP BY 1, 2),
t AS (SELECT user_id, sum(n) AS n, sum(s) AS s, sum(q) AS q, max(p) AS peak, sum(c) AS c, count(*) FILTER (WHERE n >= 2) AS frames, count(*) FILTER (WHERE n >= 2 AND sqrt(q / n) >= 6e-3) AS active FROM f GROUP BY 1),
r AS (SELECT user_id, CAST(n AS BIGINT) AS n, 20 * log10(greatest(sqrt(q / n), 1e-9)) AS db, peak, abs(s / n) AS dc, c / n AS cr, active / greatest(frames, 1) AS ar FROM t)
SELECT user_id, n, round(db, 6) AS rms_dbfs, round(peak, 6) AS peak, round(dc, 10) AS dc, round(cr, 6) AS clipped_ratio, round(ar, 6) AS active_ratio,
  CASE WHEN db < -42 OR peak < 25e-3 THEN 'quiet' WHEN cr > 3e-3 THEN 'clipped' WHEN dc > 5e-2 THEN 'offset' WHEN ar < 45e-2 THEN 'inactive' ELSE 'ok' END AS verdict FROM r""",
    "overlap_summary": """WITH f AS (SELECT CAST(label AS BIGINT) AS grp, list_transform(embedding[1:7]::DOUBLE[], lambda x: x * 8) AS l FROM embeddings),
p AS (SELECT grp, 1 / (1 + exp(-l[5])) + 1 / (1 + exp(-l[6])) + 1 / (1 + exp(-l[7])) AS p, list_position(l, list_max(l)) >= 5 AS o FROM f)
SELECT grp, round(avg(p), 6) AS mean_prob, round(max(p), 6) AS max_prob, count(*) FILTER (WHERE o) AS overlap_frames, count(*) AS total_frames, round(count(*) FILTER (WHERE o) / count(*), 6) AS fraction FROM p GROUP BY 1""",
    "separator_pick": _SCORES + """, b AS (SELECT vec_id // 2 AS block, coalesce(max(greatest(cos, 0e0)) FILTER (WHERE vec_id % 2 = 0), 0) AS s0, coalesce(max(greatest(cos, 0e0)) FILTER (WHERE vec_id % 2 = 1), 0) AS s1 FROM s WHERE grp = 0 GROUP BY 1)
SELECT block, CAST(s1 > s0 AS BIGINT) AS stream, round(greatest(s0, s1), 6) AS score, greatest(s0, s1) >= 2e-1 AS accepted FROM b""",
    "block_levels": f"WITH e AS ({_E}) SELECT user_id, (rn - 1) // 10 AS block, count(*) AS n, round(sqrt(sum(score * score) / 10), 6) AS rms FROM e GROUP BY 1, 2",
    "enrolment_windows": """WITH c AS (SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1)
SELECT user_id, unnest(CASE WHEN n >= 30 THEN range(0, n - 29, 15) WHEN n >= 10 THEN [CAST(0 AS BIGINT)] END) AS window_start FROM c""",
    "evenly_spaced_blocks": f"""WITH e AS ({_E}), c AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1), w AS (SELECT user_id, n, unnest(range(least(8, n))) AS i FROM c)
SELECT e.user_id, event_id, rn - 1 AS place FROM e JOIN w ON e.user_id = w.user_id AND rn - 1 = i * n // least(8, n)""",
    "lookahead_pairs": f"WITH e AS ({_E}) SELECT user_id, event_id, round(score, 6) AS score, round(lead(score, 2, 0e0) OVER (PARTITION BY user_id ORDER BY rn), 6) AS later FROM e",
    "onset_lookback": f"""WITH e AS ({_E}), b AS (SELECT *, lag(score) OVER w AS prev, count(*) OVER l AS n_before, coalesce(sum(score) OVER l, 0) AS s FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY rn), l AS (PARTITION BY user_id ORDER BY rn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, n_before, round(s, 6) AS sum_before FROM b WHERE score > 3e-1 AND NOT coalesce(prev > 3e-1, false)""",
    "identity_windows": f"WITH e AS ({_E}) SELECT user_id, event_id, round(avg(score) OVER w, 6) AS window_mean, count(*) OVER w AS window_n FROM e WHERE score > 3e-1 WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS 4 PRECEDING)",
    "f0_statistics": """SELECT user_id, round(coalesce(avg(value) FILTER (WHERE event_type <> 'purchase'), 0), 6) AS f0_mu,
  round(coalesce(stddev_pop(value) FILTER (WHERE event_type <> 'purchase'), 0), 6) AS f0_sigma FROM events GROUP BY 1""",
    "rolling_windows": f"""WITH e AS ({_E}), r AS (SELECT *, avg(score) OVER w AS m, max(score) OVER w AS x FROM e WINDOW w AS (PARTITION BY user_id ORDER BY rn ROWS 6 PRECEDING))
SELECT user_id, event_id, round(m, 6) AS window_mean, round(x, 6) AS window_max FROM r WHERE rn >= 7 AND rn % 2 = 0""",
    "counter_deltas": """WITH d AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS d_frames, count(*) FILTER (WHERE event_type = 'error') AS d_errors FROM events GROUP BY 1, 2)
SELECT user_id, day, CAST(sum(d_frames) OVER w AS BIGINT) AS frames, CAST(sum(d_errors) OVER w AS BIGINT) AS errors, d_frames, d_errors FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)""",
    "survival_ratio": _GATED + """, r AS (SELECT event_type, sqrt(avg(score * score)) AS i, sqrt(avg(CASE WHEN is_on THEN score * score ELSE 0 END)) AS o FROM g GROUP BY 1)
SELECT event_type, round(i, 6) AS rms_in, round(o, 6) AS rms_out, round(o / i, 6) AS ratio FROM r""",
    "score_ema": f"""WITH RECURSIVE e AS ({_E}), x AS (
SELECT user_id, event_id, rn, score AS smoothed FROM e WHERE rn = 1
UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN x.smoothed = 0 THEN e.score ELSE 4e-1 * e.score + 6e-1 * x.smoothed END FROM x JOIN e ON e.user_id = x.user_id AND e.rn = x.rn + 1)
SELECT user_id, event_id, round(smoothed, 6) AS smoothed FROM x""",
    "overlap_hysteresis": f"""WITH RECURSIVE e AS ({_E}), x AS (
SELECT user_id, event_id, rn, false AS o, CASE WHEN score >= 35e-2 THEN 1 ELSE 0 END AS a, CASE WHEN score >= 35e-2 THEN 0 ELSE 1 END AS b FROM e WHERE rn = 1
UNION ALL SELECT user_id, event_id, rn, o <> flip, CASE WHEN flip THEN 0 ELSE a END, CASE WHEN flip THEN 0 ELSE b END FROM (
  SELECT *, (NOT o AND a >= 2) OR (o AND b >= 2) AS flip FROM (
    SELECT e.user_id, e.event_id, e.rn, x.o, CASE WHEN e.score >= 35e-2 THEN x.a + 1 ELSE 0 END AS a, CASE WHEN e.score >= 35e-2 THEN 0 ELSE x.b + 1 END AS b FROM x JOIN e ON e.user_id = x.user_id AND e.rn = x.rn + 1)))
SELECT user_id, event_id, o AS overlap FROM x""",
    "adaptive_theta_gate": f"""WITH RECURSIVE e AS ({_E}), x AS (
SELECT user_id, event_id, rn, score, score AS m, 0e0 AS v, 3e-1 AS theta, CASE WHEN score >= 3e-1 THEN 0e0 END AS since FROM e WHERE rn = 1
UNION ALL SELECT user_id, event_id, rn, score, m, v, theta, CASE WHEN score >= theta THEN 0 WHEN since + 32 < 300 AND score >= 0 THEN since + 32 END FROM (
  SELECT *, CASE WHEN rn < 30 THEN 3e-1 ELSE least(greatest(m - sqrt(greatest(v, 0)), 15e-2), 45e-2) END AS theta FROM (
    SELECT e.user_id, e.event_id, e.rn, e.score, x.since, x.m + 5e-2 * (e.score - x.m) AS m, 95e-2 * (x.v + 5e-2 * (e.score - x.m) * (e.score - x.m)) AS v
    FROM x JOIN e ON e.user_id = x.user_id AND e.rn = x.rn + 1)))
SELECT user_id, event_id, since IS NOT NULL AS is_on, round(theta, 6) AS theta FROM x""",
    "turn_detector": _GATED.replace("WITH", "WITH RECURSIVE", 1) + """, h AS (SELECT *, score > 1e-1 AS voiced FROM g), x AS (
SELECT user_id, event_id, rn, 'steady' AS state, false AS entered, CASE WHEN voiced THEN score ELSE 0e0 END AS fast, CASE WHEN voiced THEN score ELSE 0e0 END AS slow,
  0 AS calm, false AS refreshed, false AS dipped FROM h WHERE rn = 1
UNION ALL SELECT user_id, event_id, rn, next, next = 'shrunk' AND state <> 'shrunk', fast, slow, CASE WHEN next = state THEN calm ELSE 0 END,
  next = 'shrunk', dipped AND NOT (next = 'shrunk' AND state <> 'shrunk') FROM (
  SELECT *, CASE WHEN state = 'steady' AND ((away AND is_on) OR (voiced AND NOT is_on AND dipped AND slow > 0 AND fast >= slow - 1e-1)) THEN 'shrunk'
    WHEN state = 'shrunk' AND refreshed AND calm >= 3 THEN 'regrowing' WHEN state = 'regrowing' THEN 'steady' ELSE state END AS next FROM (
    SELECT * EXCLUDE (dipped, calm), dipped OR (away AND slow > 0 AND NOT is_on) AS dipped, CASE WHEN voiced AND abs(fast - slow) <= 1e-1 THEN calm + 1 ELSE 0 END AS calm FROM (
      SELECT *, voiced AND fast < slow - 25e-2 AS away FROM (
        SELECT h.user_id, h.event_id, h.rn, h.voiced, h.is_on, x.state, x.calm, x.refreshed, x.dipped,
          CASE WHEN NOT h.voiced THEN x.fast WHEN x.fast = 0 AND x.slow = 0 THEN h.score ELSE x.fast + 3e-1 * (h.score - x.fast) END AS fast,
          CASE WHEN NOT h.voiced THEN x.slow WHEN x.fast = 0 AND x.slow = 0 THEN h.score WHEN h.is_on THEN x.slow + 2e-2 * (h.score - x.slow) ELSE x.slow END AS slow
        FROM x JOIN h ON h.user_id = x.user_id AND h.rn = x.rn + 1)))))
SELECT user_id, event_id, state, entered FROM x""",
} | samples.ORACLES | relational.ORACLES
