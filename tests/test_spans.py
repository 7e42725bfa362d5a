"""Buckets, flags, keys, sketch cells and novelty against fixed values."""

import json
import math

import pytest
from pyspark.sql import functions as F

from kestrace.functions import spans as S
from kestrace.operators import features as X
from kestrace.plans.decide import first_spans
from kestrace.sources import spans as I

SPAN = "sidecar string, trace_id string, seq long, service_name string, duration_us long, status_code int, error_attribute string, http_status string, parent_services array<string>"


def span(service="frontend", us=500, status=0, attribute=None, http="200", parents=(), trace="t", seq=1):
    return (service, trace, seq, service, us, status, attribute, http, list(parents))


def rows(spark, *spans):
    return X.features(spark.createDataFrame(list(spans), SPAN))


@pytest.mark.parametrize("us,bucket", [(500, 0), (999, 0), (1000, 1), (3000, 1), (10000, 2), (30000, 3), (100000, 4), (300000, 5), (1000000, 6), (1999999, 6), (2000000, 7), (5000000, 7), (None, 0)])
def test_latency_bucket(spark, us, bucket):
    assert rows(spark, span(us=us)).first().latency_bucket == bucket


@pytest.mark.parametrize(
    "service,us,status,parents,expected",
    [
        ("frontend", 500, 0, [], (0, 0, 0, 0, 0, 0)),
        ("frontend", 5000, 0, [], (2, 0, 0, 0, 32, 64)),
        ("paymentservice", 1000, 2, [], (1, 1, 5, 0, 1424, 52)),
        ("checkoutservice", 1000, 0, ["frontend", "checkoutservice"], (1, 0, 4, 4752, 311428112, 48)),
        ("checkoutservice", 1000, 0, ["frontend", "cartservice", "checkoutservice"], (1, 0, 4, 64391, 4219929616, 51)),
        ("unknown-x", 3000000, 0, [], (7, 0, 255, 0, 65392, 252)),
        ("adservice", 300000, 0, [], (5, 0, 9, 0, 2384, 164)),
        ("recommendationservice", 10000, 0, [], (2, 0, 8, 0, 2080, 64)),
    ],
)
def test_keys(spark, service, us, status, parents, expected):
    r = rows(spark, span(service, us, status, parents=parents)).first()
    assert (r.latency_bucket, r.has_error, r.svc_id, r.topo_hash, r.packed_key, r.arm_index) == expected


@pytest.mark.parametrize("status,attribute,http,flag", [(0, None, "499", 0), (0, None, "500", 1), (2, None, None, 1), (1, None, None, 0), (0, "false", None, 1), (0, "", None, 0), (0, None, "x5", 0), (None, None, None, 0)])
def test_narrow_error(spark, status, attribute, http, flag):
    assert rows(spark, span(status=status, attribute=attribute, http=http)).first().has_error == flag


def test_wide_error(spark):
    cases = [
        (2, 0, None, None, None, [], True), (0, 5, None, None, None, [], True), (0, 0, True, None, None, [], True), (0, 0, False, "ERROR", None, [], True), (0, 0, None, None, 500, [], True), (0, 0, None, None, 499, [], False),
        (0, 0, None, None, None, ["Exception"], True), (0, 0, None, None, None, ["an eRRor"], True), (0, 0, None, "OK", None, ["fine", None], False), (None, None, None, None, None, None, False),
    ]
    df = spark.createDataFrame(cases, "s int, g int, e boolean, o string, h int, ev array<string>, want boolean")
    bad = df.where(S.wide_error(*[F.col(c) for c in ("s", "g", "e", "o", "h", "ev")]) != F.col("want"))
    assert bad.count() == 0


@pytest.mark.parametrize("key,cols", [(0, [0, 0, 0, 0]), (1, [390, 203, 332, 291]), (2, [268, 407, 152, 70]), (42, [19, 113, 406, 323]), (99, [7, 251, 319, 213]), (999999, [234, 340, 417, 333]), (1280, [96, 200, 195, 422]), (4294967280, [120, 163, 253, 205])])
def test_sketch_columns(spark, key, cols):
    got = spark.range(1).select(*[S.sketch_column(F.lit(key).cast("long"), r) for r in range(4)]).first()
    assert list(got) == cols


@pytest.mark.parametrize("n,value", [(0, 1.0), (1, 0.590616), (10, 0.294300), (100, 0.178091), (1000, 0.126442)])
def test_novelty(spark, n, value):
    assert abs(spark.range(1).select(S.novelty(F.lit(n))).first()[0] - value) < 1e-6


def keys(spark, *pairs):
    return spark.createDataFrame([(s, k, i) for i, (s, k) in enumerate(pairs)], "sidecar string, packed_key long, seq long")


def test_estimates_never_undercount(spark):
    stream = keys(spark, *[("a", (i * i) % 700) for i in range(3000)])
    true = {r.packed_key: r["count"] for r in stream.groupBy("packed_key").count().collect()}
    got = X.estimate(stream.select("sidecar", "packed_key").distinct(), X.build_sketch(stream)).collect()
    assert len(got) == len(true) and all(r.estimate >= true[r.packed_key] for r in got)


def test_estimate_of_unseen(spark):
    r = X.estimate(keys(spark, ("b", 5)), X.build_sketch(keys(spark, ("a", 5)))).first()
    assert r.estimate == 0


def test_merge_is_max_or_sum(spark):
    one, two = X.build_sketch(keys(spark, *[("a", 1)] * 10)), X.build_sketch(keys(spark, *[("b", 1)] * 20))
    for how, n in (("max", 20), ("sum", 30)):
        cells = X.merge_sketches(one.unionByName(two), [], how).withColumn("sidecar", F.lit("m"))
        assert X.estimate(keys(spark, ("m", 1)), cells).first().estimate == n


def test_decay_truncates(spark):
    cells = spark.createDataFrame([("a", 0, 0, 1000)], "sidecar string, row int, col int, cnt long")
    seen = []
    for _ in range(10):
        cells = X.decay(cells, 0.9)
        seen.append(cells.first().cnt)
    assert seen == [900, 810, 729, 656, 590, 531, 477, 429, 386, 347]


def test_decayed_epochs_equal_a_loop(spark):
    events = [("a", i % 3, e) for e in (0, 1, 4) for i in range(50)]
    df = spark.createDataFrame(events, "sidecar string, packed_key long, epoch long")
    got = {(r.row, r.col): r.cnt for r in X.decayed_sketch(df, 0.9).collect()}
    cells: dict = {}
    place = {k: [tuple(c) for c in spark.range(1).select(S.sketch_cells(F.lit(k).cast("long"))).first()[0]] for k in range(3)}
    for epoch in range(5):
        for _, k, e in events:
            if e == epoch:
                for c in place[k]:
                    cells[c] = cells.get(c, 0) + 1
        cells = {c: math.floor(n * 0.9) for c, n in cells.items()}
    assert got == cells


def test_replay_equals_a_loop(spark):
    stream = [("a" if i % 2 else "b", (i * 7) % 13 * 16) for i in range(400)]
    df = keys(spark, *stream)
    got = {r.seq: r.estimate for r in X.replay_estimates(df).collect()}
    place = {k: [tuple(c) for c in spark.range(1).select(S.sketch_cells(F.lit(k).cast("long"))).first()[0]] for k in {k for _, k in stream}}
    seen: dict = {}
    for i, (s, k) in enumerate(stream):
        assert got[i] == min(seen.get((s, c), 0) for c in place[k])
        for c in place[k]:
            seen[s, c] = seen.get((s, c), 0) + 1


def test_first_span_wins_and_empty_ids_share(spark):
    df = spark.createDataFrame([span(trace="", seq=3), span(trace="", seq=2), span(trace="x", seq=9)], SPAN)
    assert sorted(r.seq for r in first_spans(df).collect()) == [2, 9]


def _request(**kw):
    attrs = [{"key": k, "value": v} for k, v in kw.get("attributes", [])]
    return {"resource_spans": [{"resource": {"attributes": kw.get("resource", [])}, "scope_spans": [{"scope": {"name": "s", "version": "1"}, "spans": [] if kw.get("empty") else [{
        "trace_id": kw.get("trace"), "span_id": "1", "name": "op", "start_time_unix_nano": 5_000_000, "end_time_unix_nano": kw.get("end", 7_500_999), "status": {"code": 0}, "attributes": attrs, "events": []}]}]}]}


def test_flatten_requests(spark, tmp_path):
    name = [{"key": "service.name", "value": {"string_value": "cartservice"}}]
    body = [
        _request(trace="AB", resource=name, attributes=[("http.status_code", {"int_value": 503}), ("z", {"int_value": 0}), ("a", {"string_value": "1"}), ("a", {"string_value": "2"})]),
        _request(end=1, attributes=[("error", {"bool_value": True})]), _request(empty=True),
    ]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, body)))
    got = sorted(I.flatten_requests(I.read_requests(spark, str(tmp_path))).collect(), key=lambda r: r.service_name)
    assert len(got) == 2
    one, two = got
    assert (one.service_name, one.trace_id, one.duration_us, one.http_status, one.attributes) == ("cartservice", "ab", 2500, 503, {"http.status_code": "503", "a": "2"})
    assert (two.service_name, two.trace_id, two.duration_us, two.error_flag) == ("unknown", "", 0, True)
    kept = I.flatten_requests(I.read_requests(spark, str(tmp_path)), keep_falsy=True).where("service_name = 'cartservice'").first()
    assert kept.attributes["z"] == "0"


def test_reward_intake(spark):
    bodies = ['{"arm_index": 300, "context": [1, 0, 0, 0.5], "reward": 1}', '{"arm_index": 1, "context": [1], "reward": 1}', '{"arm_index": 1, "context": [1,1,1,1], "reward": 1.1}', '{"context": [1,1,1,1], "reward": 1}', '{"arm_index": 1, "context": [1,1,1,1], "reward": "x"}', "{"]
    good, bad = I.reward_events(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert [r.arm_index for r in good.collect()] == [44] and bad.count() == 5


def test_synthetic_traffic(spark):
    n = I.synthetic_spans(spark, 4000).groupBy("operation_name").count().collect()
    assert {r.operation_name for r in n} == {"browse", "cart", "checkout", "bad_checkout", "currency", "slow", "empty"}


def test_sql_vocabulary(spark):
    S.register_sql_functions(spark)
    assert list(spark.sql("SELECT latency_bucket(5000), service_cluster('adservice'), service_cluster('x'), novelty_score(0)").first()) == [2, 9, 255, 1.0]


def test_texts(spark):
    r = spark.range(1).select(S.span_uptime(F.lit(125.7)), S.text_bar(F.lit(3), F.lit(10), 10), S.text_bar(F.lit(3), F.lit(0), 4)).first()
    assert list(r) == ["2m 5s", "███░░░░░░░", "░░░░"]


def test_one_span_requests(spark):
    rows = I.flatten_requests(I.make_span(spark, "cartservice", "add", 12.5, True, 3)).collect()
    assert len(rows) == 3 and len({r.trace_id for r in rows}) == 3
    assert {(r.service_name, r.operation_name, r.duration_us, r.status_code) for r in rows} == {("cartservice", "add", 12500, 2)}


def test_phases_of_traffic_follow_in_turn(spark):
    rows = I.timed_mix(spark, 2000, [("normal", 30), ("error_burst", 10)])
    got = {(r.phase, r.s // 40, r.s % 40 >= 30) for r in rows.selectExpr("phase", "cast(floor(seq / 10) as int) as s").distinct().collect()}
    assert rows.count() == 2000 and {(p, late) for p, _, late in got} == {("normal", False), ("error_burst", True)}
    assert rows.where("phase = 'normal' and operation_name = 'bad_checkout'").count() == 0
