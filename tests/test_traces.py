"""Stored traces: error tags by type, roll-up, both scales, routing."""

import json

import pytest

from kestrace.operators import traces as T
from kestrace.sources import spans as I

NAMES = ["frontend", "cartservice", "adservice", "emailservice"]


def trace(tid, ms, services=1, tags=()):
    procs = {f"p{i}": {"serviceName": NAMES[i]} for i in range(services)}
    spans = [{"spanID": str(i), "operationName": "op", "startTime": 10, "duration": int(ms * 1000) if i == 0 else 10, "processID": f"p{i}", "tags": [{"key": k, "value": v} for k, v in tags] if i == 0 else []} for i in range(services)]
    return {"traceID": tid, "spans": spans, "processes": procs}


def load(spark, tmp_path, *traces):
    (tmp_path / "t.json").write_text("\n".join(map(json.dumps, traces)))
    return I.read_traces(spark, str(tmp_path))


@pytest.mark.parametrize(
    "ms,services,tags,reward,reason,value,name",
    [
        (5000, 1, [("error", True)], 1.0, "error", 1.0, "error"), (2000.001, 1, [], 0.9, "extreme_slow", 0.8, "very_slow"), (2000, 1, [], 0.8, "very_slow", 0.8, "very_slow"), (500, 1, [], 0.5, "slow", 0.5, "slow"),
        (200, 4, [], 0.4, "complex", 0.4, "complex"), (200, 3, [], 0.2, "moderate", 0.2, "moderate"), (50, 3, [], 0.0, "routine", 0.1, "routine"),
        (1, 1, [("error", "true")], 0.0, "routine", 0.1, "routine"), (1, 1, [("http.status_code", "503")], 0.0, "routine", 0.1, "routine"), (1, 1, [("http.status_code", 503)], 1.0, "error", 1.0, "error"),
        (1, 1, [("otel.status_code", "ERROR")], 1.0, "error", 1.0, "error"), (1, 1, [("error", 1)], 0.0, "routine", 0.1, "routine"),
    ],
)
def test_scales(spark, tmp_path, ms, services, tags, reward, reason, value, name):
    rolled = T.rollup(I.flatten_traces(load(spark, tmp_path, trace("a", ms, services, tags))))
    r, c = T.rewarded(rolled).first(), T.classified(rolled).first()
    assert (r.reward, r.reason, c.value, c["class"]) == (reward, reason, value, name)


def test_two_tags_count_twice(spark, tmp_path):
    rolled = T.rollup(I.flatten_traces(load(spark, tmp_path, trace("a", 1, 1, [("error", True), ("http.status_code", 500)]))))
    assert rolled.first().error_count == 2


def test_arm_entries_and_routing(spark, tmp_path):
    spans = I.flatten_traces(load(spark, tmp_path, trace("a", 300, 2), trace("b", 1, 1)))
    got = {(r.trace_id, r.service_name): r for r in T.arm_entries(spans).collect()}
    assert got["a", "frontend"].arm_index == 5 << 5 and got["a", "cartservice"].arm_index == 2 << 2 and got["a", "frontend"].reward == 0.5 and got["a", "frontend"].x3 == 0.5
    assert {(r.trace_id, r.sidecar) for r in T.routed(T.arm_entries(spans)).collect()} == {("a", "frontend"), ("a", "cartservice"), ("b", "frontend")}
    routes = spark.createDataFrame([("frontend", "one")], "service_name string, sidecar string")
    assert {r.sidecar for r in T.routed(T.arm_entries(spans), routes).collect()} == {"one"}


def test_fetch_union_and_services(spark, tmp_path):
    rows = load(spark, tmp_path, trace("a", 1, 2), trace("b", 1, 1), trace("", 1, 1))
    one, two = I.fetch_traces(rows, "cartservice", 5), I.fetch_traces(rows, "frontend", 5)
    assert [r.traceID for r in one.collect()] == ["a"] and two.count() == 3
    both = I.union_traces(one.select("traceID"), two.select("traceID"))
    assert sorted(r.traceID for r in both.collect()) == ["a", "b"]
    assert {r.service for r in I.services_of(rows).collect()} == {"frontend", "cartservice"}
    assert I.fetch_traces(rows, "frontend", 5, since_us=11).count() == 0


def test_empty_traces(spark):
    rolled = spark.createDataFrame([("a", 0, False, 0, 0, 0)], "trace_id string, duration_us long, has_error boolean, error_count long, num_services long, num_spans long")
    assert T.classified(rolled).count() == 0 and T.classified(rolled, "unknown").first().value == 0.0 and T.rewarded(rolled).count() == 0


def test_recorded_distribution(spark):
    """377 routine, 76 error, 3 moderate, 1 very slow have a mean value of 0.252."""
    counts = {"routine": (1, 377), "moderate": (60, 3), "very_slow": (900, 1)}
    rows = [(f"{k}{i}", ms * 1000, False, 0, 1, 1) for k, (ms, n) in counts.items() for i in range(n)] + [(f"e{i}", 1, True, 1, 1, 1) for i in range(76)]
    classes = T.classified(spark.createDataFrame(rows, "trace_id string, duration_us long, has_error boolean, error_count long, num_services long, num_spans long"))
    assert abs(T.baseline_summary(classes).first().avg_value - 115.1 / 457) < 1e-9
    assert {r["class"]: r.traces for r in T.class_distribution(classes).collect()} == {"routine": 377, "error": 76, "moderate": 3, "very_slow": 1}
