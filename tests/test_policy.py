"""Bandit state and scores, decisions, replay, metrics, state tables and the binary format."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrace.constants import CHECKPOINT_BYTES, EngineConfig
from kestrace.operators import bandit as B
from kestrace.operators import evaluate as E
from kestrace.operators import features as X
from kestrace.operators import state as K
from kestrace.plans import decide as D

REWARD = "sidecar string, arm_index int, x0 double, x1 double, x2 double, x3 double, reward double, seq long"
X_, E_ = (0.5, 0.0, 0.1, 0.8), (0.5, 1.0, 0.1, 0.8)


def rewards(spark, *events):
    return spark.createDataFrame([("s", arm, *x, float(r), i) for i, (arm, x, r) in enumerate(events)], REWARD)


def score(spark, state, x, alpha=1.0, arm=1):
    row = spark.createDataFrame([("s", arm, *x)], "sidecar string, arm_index int, x0 double, x1 double, x2 double, x3 double")
    return B.ucb_scores(B.with_policy(row, state), alpha).first().ucb


def test_scores(spark):
    none = B.arm_state(spark.createDataFrame([], REWARD))
    assert abs(score(spark, none, X_) - 0.948683) < 1e-6
    assert abs(score(spark, B.arm_state(rewards(spark, *[(1, X_, 1)] * 50)), X_, 0.1) - 0.992248) < 1e-4
    assert abs(score(spark, B.arm_state(rewards(spark, *[(1, X_, 0)] * 50)), X_, 0.1) - 0.013988) < 1e-4
    both = B.arm_state(rewards(spark, *[(1, E_, 1), (1, X_, 0.1)] * 20))
    assert abs(score(spark, both, E_, 0.5) - 1.067980) < 1e-4 and abs(score(spark, both, X_, 0.5) - 0.240260) < 1e-4
    assert abs(score(spark, B.arm_state(rewards(spark, *[(1, E_, 0.9)] * 20)), E_) - 1.097645) < 1e-4


def test_score_equals_numpy(spark):
    rng = np.random.default_rng(1)
    events = [(1, tuple(map(float, rng.random(4))), float(rng.random())) for _ in range(60)]
    a, b = np.eye(4), np.zeros(4)
    for _, x, r in events:
        a += np.outer(x, x)
        b += r * np.array(x)
    x = rng.random(4)
    inverse = np.linalg.inv(a)
    want = x @ inverse @ b + 0.7 * np.sqrt(x @ inverse @ x)
    assert abs(score(spark, B.arm_state(rewards(spark, *events)), tuple(map(float, x)), 0.7) - want) < 1e-9


def test_thompson_state_and_arms_apart(spark):
    s = {r.arm_index: r for r in B.arm_state(rewards(spark, *[(3, X_, 1)] * 50, (4, X_, 0))).collect()}
    assert (s[3].alpha, s[3].beta, s[4].alpha, s[4].beta) == (51, 1, 1, 2)
    stats = {r.arm_index: r for r in B.arm_stats(B.arm_state(rewards(spark, *[(3, X_, 1)] * 50))).collect()}
    assert stats[3].confident and stats[3].observations == 50 and abs(stats[3].thompson_mean - 51 / 52) < 1e-12


def test_observations_of_many_rewards(spark):
    """Tenths, whose plain sums drift, in an order that no partial sum evens out."""
    reward = F.element_at(F.array(*[F.lit(x) for x in (0.9, 0.2, 0.8, 0.4, 0.1)]), (F.col("id") % 5 + 1).cast("int"))
    rows = spark.range(0, 200_000, 1, 3).select(F.lit("s").alias("sidecar"), F.lit(1).alias("arm_index"), *[F.lit(0.5).alias(f"x{i}") for i in range(4)], reward.alias("reward"))
    got = B.arm_stats(B.arm_state(rows)).first()
    assert (got.n, got.observations) == (200_000, 200_000)
    assert abs(got.alpha - 96_001) < 1e-9 and abs(got.beta - 104_001) < 1e-9


def test_draws_follow_their_prior(spark):
    base = spark.range(2000).select(F.lit("s").alias("sidecar"), F.col("id").cast("string").alias("trace_id"))
    for alpha, beta, low, high in ((1.0, 1.0, 0.45, 0.55), (101.0, 1.0, 0.98, 1.0), (1.0, 101.0, 0.0, 0.02), (30.0, 10.0, 0.99, 1.0), (5.0, 5.0, 0.44, 0.56)):
        rows = base.withColumns({"arm_index": F.lit(1), "alpha": F.lit(alpha), "beta": F.lit(beta)})
        drawn = B.general_draws(rows, "7", "trace_id", "arm_index")
        got = drawn.agg(F.avg((F.col("draw") >= 0.5).cast("int")), F.avg("draw")).first()
        assert low <= got[0] <= high and abs(got[1] - alpha / (alpha + beta)) < 0.02


def test_merge_of_learners(spark):
    events = [(1, X_, 0.5)] * 4 + [(1, E_, 1.0)] * 3
    whole = B.arm_state(rewards(spark, *events)).first()
    parts = B.arm_state(rewards(spark, *events[:4])).unionByName(B.arm_state(rewards(spark, *events[4:])))
    merged = B.merge_states(parts, ["sidecar", "arm_index"]).first()
    assert all(abs(whole[c] - merged[c]) < 1e-12 for c in merged.asDict() if c not in ("sidecar", "arm_index"))


SPAN = "sidecar string, trace_id string, seq long, service_name string, duration_us long, status_code int, error_attribute string, http_status int, parent_services array<string>, is_error boolean"


def spans(spark, *items):
    return spark.createDataFrame([("frontend", f"t{t}", i, "frontend", us, status, None, 200, [], wide) for i, (t, us, status, wide) in enumerate(items)], SPAN)


def empty_policy(spark):
    return B.arm_state(spark.createDataFrame([], REWARD)), spark.createDataFrame([], "sidecar string, row int, col int, cnt long")


def test_errors_are_forced(spark):
    got = D.decide(spans(spark, (1, 10, 2, False), (2, 10, 0, True), (3, 10, 0, False)), *empty_policy(spark)).orderBy("seq").collect()
    assert [(r.method, r.score) for r in got[:2]] == [("forced", 1.0)] * 2 and got[2].method == "thompson" and got[2].score == got[2].u
    off = D.decide(spans(spark, (1, 10, 2, False)), *empty_policy(spark), EngineConfig(force_errors=False)).first()
    assert off.method == "thompson"


def test_threshold_is_inclusive_and_monotone(spark):
    many = spans(spark, *[(i, 10, 0, False) for i in range(300)])
    rates = [D.decide(many, *empty_policy(spark), EngineConfig(threshold=t)).where("sampled").count() for t in (0.2, 0.5, 0.8)]
    assert rates[0] > rates[1] > rates[2]
    exact = D.judged(spark.createDataFrame([(0.5, 0.1, 20, 0, False)], "ucb double, draw double, n int, has_error int, is_error boolean"), EngineConfig())
    assert exact.first().sampled


def test_verdict_holds_for_the_trace(spark):
    rows = spans(spark, (1, 10, 0, False), (1, 10, 2, True), (2, 10, 2, True), (2, 10, 0, False))
    decisions = X.features(D.first_spans(rows)).withColumn("sampled", F.col("trace_id") == "t2")
    assert [r.sampled for r in D.verdicts(rows, decisions).orderBy("seq").collect()] == [False, False, True, True]
    assert [r.sampled for r in D.verdicts(rows, decisions, True).orderBy("seq").collect()] == [False, True, True, True]


def test_replay_learns(spark):
    """Cold start, then the learned policy from the tenth reward on; the last state is the batch state."""
    many = spans(spark, *[(i, 10, 0, False) for i in range(40)])
    events = rewards(spark, *[(0, (0.0, 0.0, 0.0, 0.5), 1.0)] * 20).withColumn("sidecar", F.lit("frontend"))
    got = D.replay(many, events).orderBy("seq").collect()
    assert [r.method for r in got[:10]] == ["thompson"] * 10 and {r.method for r in got[10:]} == {"linucb"}
    assert [r.n for r in got[:22]] == [*range(21), 20]
    end, batch = got[-1], B.arm_state(events).first()
    assert abs(end.a33 - batch.a33) < 1e-12 and end.alpha == batch.alpha
    assert got[0].novelty == 1.0 and got[1].estimate == 1


def test_queue_keeps_the_newest(spark):
    q = spark.createDataFrame([("s", i) for i in range(20)], "sidecar string, seq long")
    got = D.queue_survivors(q, 10)
    assert sorted(r.seq for r in got.collect()) == list(range(10, 20)) and got.first().dropped == 10


def test_recent_wants_a_positive_limit(spark):
    with pytest.raises(ValueError):
        D.recent(spark.range(1), 0)


def test_metrics(spark):
    d = spark.createDataFrame([("a", "forced", True), ("a", "thompson", False), ("a", "linucb", True), ("a", "thompson", True)], "sidecar string, method string, sampled boolean")
    r = E.sampler_metrics(d, rewards=spark.createDataFrame([("a", 0.8), ("a", 0.6)], "sidecar string, reward double")).first()
    assert (r.total_spans, r.sampled_spans, r.dropped_spans, r.thompson_decisions, r.linucb_decisions, r.forced_samples, r.sample_rate, r.rewards_received) == (4, 3, 1, 2, 1, 1, 0.75, 2)
    assert abs(r.avg_reward - 0.7) < 1e-12


def test_cluster_counts_what_is_down(spark):
    snap = spark.createDataFrame([("a", 10, 4, 6, 5, 4, 1, 2, 0.5), ("b", 30, 6, 24, 20, 8, 2, 6, 0.9)], "sidecar string, total_spans long, sampled_spans long, dropped_spans long, thompson_decisions long, linucb_decisions long, forced_samples long, rewards_received long, avg_reward double")
    r = E.cluster_metrics(snap, spark.createDataFrame([("a",), ("b",), ("c",)], "sidecar string")).first()
    assert (r.sidecars, r.alive, r.total_spans, r.sample_rate) == (3, 2, 40, 0.25) and abs(r.avg_reward - 0.8) < 1e-12


def test_latency_ranks(spark):
    r = E.latency_stats(spark.range(500).select(F.lit("x").alias("k"), F.col("id").alias("v")), "v", "k").first()
    assert (r.p50, r.p95, r.p99, r.grade) == (250, 475, 495, "excellent")


def test_random_sampling(spark):
    classes = spark.createDataFrame([(f"t{i}", "error" if i % 4 == 0 else "routine", 1.0 if i % 4 == 0 else 0.1) for i in range(400)], "trace_id string, class string, value double")
    r = E.random_sampling(classes, 0.3, 40).first()
    assert abs(r.avg_error_capture - 0.3) < 0.03 and r.avg_slow_capture == 1.0 and abs(r.avg_value_capture - 0.3) < 0.03
    again = E.random_sampling(classes.repartition(7), 0.3, 40).first()
    assert abs(again.avg_error_capture - r.avg_error_capture) < 1e-12


def test_convergence(spark):
    stats = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.54), ("a", 2, 0.1), ("b", 2, 0.9), ("a", 3, 0.4)], "sidecar string, arm_index int, thompson_mean double")
    got = {r.arm_index: (r.similar, r.converged) for r in E.arm_convergence(stats).collect()}
    assert got == {1: (True, True), 2: (False, False)}
    assert E.convergence_verdict(E.arm_convergence(stats)).first().verdict == "few"


def test_state_versions(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "a int"
    assert K.load_state(spark, path, schema).count() == 0
    for v in (1, 2):
        K.save_state(spark.createDataFrame([(v,)], schema), path, v)
    (tmp_path / "state" / "version=0000000003").mkdir()  # begun, never finished
    assert K.load_state(spark, path, schema).first().a == 2 and K.versions(spark, path) == [1, 2]
    assert K.checkpoint_stats(spark, path).first().saves == 2


def test_checkpoint_blob():
    cells = [(0, 3, 7), (3, 511, 2**32 - 1)]
    arms = {5: {"n": 3, "a00": 2.5, "b1": 0.25, "alpha": 3.5, "beta": 1.5}}
    blob = K.encode_checkpoint(cells, arms, 12.5)
    assert len(blob) == CHECKPOINT_BYTES
    got = K.decode_checkpoint(blob)
    assert got[0] == cells and got[2] == 12.5 and got[1][5]["a00"] == 2.5 and got[1][5]["alpha"] == 3.5 and list(got[1]) == [5]
    assert K.decode_checkpoint(blob[:1000]) is None and K.decode_checkpoint(b"xxxx" + blob[4:]) is None


def test_config(monkeypatch):
    monkeypatch.setenv("THRESHOLD", "0.2")
    monkeypatch.setenv("FORCE_ERRORS", "false")
    c = EngineConfig.from_environment()
    assert (c.threshold, c.force_errors, c.alpha) == (0.2, False, 1.0)
    monkeypatch.setenv("KESTRACE_THRESHOLD", "0.7")
    monkeypatch.setenv("KESTRACE_METRICS_INTERVAL_S", "2.5")
    c = EngineConfig.from_environment()
    assert (c.threshold, c.metrics_interval_s, c.checkpoint_dir) == (0.7, 2.5, "")


def test_snapshots_and_dashboard(spark, tmp_path):
    from kestrace.sources.metrics import as_json, read_metrics, write_report

    (tmp_path / "m.json").write_text('{"sidecar": "a", "total_spans": 10, "sampled_spans": 5, "uptime_seconds": 61}\n{broken\n{"sidecar": "b", "total_spans": 5, "sampled_spans": 0, "uptime_seconds": 1}\n')
    rows = read_metrics(spark, str(tmp_path / "m.json"))
    lines = [r.line for r in E.dashboard(rows, 4).collect()]
    assert len(lines) == 2 and "████" in lines[0] and " 50.0% 1m 1s" in lines[0] and "██░░" in lines[1]
    write_report(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2 and '"sidecar":"a"' in as_json(rows).orderBy("body").first().body


def test_draws_invert_the_beta_distribution(spark):
    """Against the distribution function, summed on a grid a hundred times as fine."""
    rows = spark.range(300).select(F.lit("s").alias("sidecar"), F.col("id").cast("string").alias("trace_id"), F.lit(1).alias("arm_index"), (F.lit(1.5) + F.col("id") % 5).alias("alpha"), (F.lit(1.2) + F.col("id") % 3).alias("beta"), F.lit(3).alias("n"))
    fine = (np.arange(200_000) + 0.5) / 200_000
    for r in B.general_draws(rows, "0", "trace_id", "arm_index").collect():
        mass = fine ** (r.alpha - 1) * (1 - fine) ** (r.beta - 1)
        assert abs(mass[fine <= r.draw].sum() / mass.sum() - r.u) < 2e-3
    none = B.general_draws(rows, "0", "trace_id", "arm_index", confidence=3)
    assert none.where("draw is not null").count() == 0  # learned arms need no draw


def test_histories_that_are_cut_carry_on(spark):
    many = spans(spark, *[(i, i % 7, 2 if i % 5 == 0 else 0, False) for i in range(60)])
    events = rewards(spark, *[(i % 3 * 32, (0.1 * (i % 3), 0.0, 0.1, 0.5), (i % 10) / 10) for i in range(50)]).withColumn("sidecar", F.lit("frontend"))
    whole = {r.seq: r for r in D.replay(many, events).collect()}
    for span in (1, 7, 1000):
        for r in D.replay(many, events, span=span).collect():
            w = whole[r.seq]
            assert (r.n, r.method, r.estimate, r.sampled) == (w.n, w.method, w.estimate, w.sampled) and abs(r.score - w.score) < 1e-9


def test_replay_draws_from_two_sided_priors(spark):
    many = spans(spark, *[(i, 10, 0, False) for i in range(30)])
    arm = X.features(many).first().arm_index
    events = rewards(spark, *[(arm, (0.0, 0.0, 0.0, 0.5), 0.5)] * 4).withColumn("sidecar", F.lit("frontend"))
    late = [r.score for r in D.replay(many, events).where("seq > 5").collect()]
    assert len(set(late)) == len(late) and all(0 < x < 1 for x in late)


def test_checkpoint_age_is_a_moment(spark, tmp_path):
    path = str(tmp_path / "state")
    assert K.checkpoint_stats(spark, path).first().saves == 0
    K.save_state(spark.createDataFrame([(1,)], "a int"), path, 5)
    (tmp_path / "state" / "version=0000000009").mkdir()
    r = K.checkpoint_stats(spark, path).first()
    assert (r.saves, r.failed, r.newest) == (1, 1, 5) and r.bytes > 0 and 0 <= r.age_seconds < 60


def test_report_names_everything(spark):
    state = B.arm_state(rewards(spark, *[(i % 12, X_, 0.5) for i in range(40)]))
    state = state.unionByName(state.withColumn("sidecar", F.lit("t")))
    d = spark.createDataFrame([("s", "forced", True), ("t", "linucb", False)], "sidecar string, method string, sampled boolean")
    snapshots = E.sampler_metrics(d, state, spark.createDataFrame([("s", 0.8)], "sidecar string, reward double"))
    classes = spark.createDataFrame([("t1", "error", 1.0), ("t2", "routine", 0.1)], "trace_id string, class string, value double")
    metrics = E.cluster_metrics(snapshots)
    from kestrace.operators import traces as T

    got = {(r.section, r.metric): r.value for r in E.report(metrics, T.class_distribution(classes), E.compare_policies(classes, metrics, E.random_sampling(classes, metrics)), state, snapshots).collect()}
    assert got["cluster", "sample_rate"] == 0.5 and got["classes", "error.share"] == 0.5 and got["convergence", "shared"] == 12
    assert sum(s == "arms" and m.endswith(".n") for s, m in got) == E.REPORT_ARMS and got["sidecars", "s.sampled_spans"] == 1


def test_random_sampling_takes_the_rate_of_a_policy(spark):
    classes = spark.createDataFrame([(f"t{i}", "routine", 0.1) for i in range(300)], "trace_id string, class string, value double")
    row = spark.createDataFrame([(0.25,)], "sample_rate double")
    a, b = E.random_sampling(classes, row).first(), E.random_sampling(classes, 0.25).first()
    assert a == b and abs(a.avg_actual_rate - 0.25) < 0.01


def test_busiest_arms_of_each_sidecar(spark):
    stats = spark.createDataFrame([(s, i, 100 - i, 0.5) for s in "ab" for i in range(60)], "sidecar string, arm_index int, n long, thompson_mean double")
    got = E.busiest_arms(stats).collect()
    assert len(got) == 100 and all(r.arm_index < 50 for r in got)
