"""Streams give what batches give."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from kestrace.constants import EngineConfig
from kestrace.operators import bandit as B
from kestrace.operators import features as X
from kestrace.operators import traces as T
from kestrace.plans import decide as D
from kestrace.sources import spans as I
from kestrace.streaming import pipeline as P
from kestrace.streaming import windows as W

DIR = "/root/testdata/sf0.001"


def spans(spark):
    return D.by_sidecar(I.spans_from_events(spark.read.parquet(f"{DIR}/events.parquet"))).withColumn("is_error", F.col("status_code") == 2)


def stream(spark, df, path, files=3):
    """df as a stream whose batches follow seq: one file after another, of rising age."""
    low, high = df.agg(F.min("seq"), F.max("seq")).first()
    for i in range(files):
        at = (F.col("seq") - low) * files / (high - low + 1)
        df.where((at >= i) & (at < i + 1)).coalesce(1).write.mode("append").parquet(path)
    order = {f: df.sparkSession.read.parquet(str(f)).agg(F.min("seq")).first()[0] for f in Path(path).glob("*.parquet")}
    for i, f in enumerate(sorted(order, key=order.get)):
        os.utime(f, (1_700_000_000 + 10 * i,) * 2)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_verdicts(spark, tmp_path):
    rows = spans(spark)
    state, cells = B.arm_state(T.routed(T.arm_entries(rows.withColumn("error_tags", F.col("is_error").cast("int"))))), X.build_sketch(X.features(rows))
    scored = lambda x: P.scored_spans(x, state, cells, EngineConfig())
    out = P.verdict_stream(scored(W.late_after(stream(spark, rows, str(tmp_path / "in")), "1 day")))
    P.write_sampled(out, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r.span_id for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = scored(rows)
    want = {r.span_id for r in D.verdicts(rows, D.first_spans(whole)).where("sampled").collect()}
    assert got == want and len(got) > 100
    assert P.renest(rows.where("sidecar = 'frontend'").drop("parent_services")).count() > 0


def test_sketch_folds(spark, tmp_path):
    rows = X.features(spans(spark))
    src = stream(spark, rows.select("sidecar", "packed_key", "ts", "seq"), str(tmp_path / "in"))
    P.fold_sketch(src, str(tmp_path / "cells"), str(tmp_path / "check"), EngineConfig(decay_factor=1.0)).awaitTermination()
    from kestrace.operators.state import load_state

    got = {(r.sidecar, r.row, r.col): r.cnt for r in load_state(spark, str(tmp_path / "cells"), P.CELLS).collect()}
    assert got == {(r.sidecar, r.row, r.col): r.cnt for r in X.build_sketch(rows).collect()}


def test_rewards_fold(spark, tmp_path):
    rows = spans(spark).withColumn("error_tags", F.col("is_error").cast("int"))
    whole = rows.select("trace_id").distinct().withColumn("part", F.pmod(F.xxhash64("trace_id"), F.lit(3)))
    path = str(tmp_path / "in")
    rows.join(whole, "trace_id").select("trace_id", "service_name", "duration_us", "error_tags", "seq", "part").repartition(3, "part").sortWithinPartitions("part").write.parquet(path)
    src = spark.readStream.schema("trace_id string, service_name string, duration_us long, error_tags int, seq long").option("maxFilesPerTrigger", 1).parquet(path)
    P.learn_rewards(src, str(tmp_path / "arms"), str(tmp_path / "check")).awaitTermination()
    got = {(r.sidecar, r.arm_index): (r.n, round(r.a00, 6), round(r.alpha, 6)) for r in P.current_arms(spark, str(tmp_path / "arms")).collect()}
    assert got == {(r.sidecar, r.arm_index): (r.n, round(r.a00, 6), round(r.alpha, 6)) for r in B.arm_state(T.routed(T.arm_entries(rows))).collect()}


def test_windows(spark, tmp_path):
    rows = spans(spark).select("trace_id", "ts", "is_error", "seq")
    src = W.windowed(W.late_after(stream(spark, rows, str(tmp_path / "in"), 1), "1 day"), "1 hour")
    src.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {(r.start, r.spans, r.errors) for r in spark.table("hours").collect()}
    assert got == {(r.start, r.spans, r.errors) for r in W.windowed(rows, "1 hour").collect()}


def test_listener_keeps_the_last():
    log = P.MetricsLog(keep=2)
    assert log.lines == []


def epochs(*rows):
    """(epoch, key, count) as rows (sidecar, packed_key, ts, seq), in order."""
    out = []
    for epoch, key, n in rows:
        out += [("a", key, epoch * 300 + i % 300, len(out) + i) for i in range(n)]
    return out


def as_keys(spark, rows):
    return spark.createDataFrame(rows, "sidecar string, packed_key long, s long, seq long").select("sidecar", "packed_key", F.timestamp_seconds("s").alias("ts"), "seq")


def test_sketch_decays_as_the_batch_does(spark, tmp_path):
    from kestrace.operators.state import load_state

    rows = as_keys(spark, epochs((0, 7, 100), (1, 7, 100), (2, 7, 100), (2, 9, 30), (5, 7, 100)))
    path, config = str(tmp_path / "cells"), EngineConfig()
    P.fold_sketch(stream(spark, rows, str(tmp_path / "in"), 4), path, str(tmp_path / "check"), config).awaitTermination()
    batch = X.decayed_sketch(rows.withColumn("epoch", F.floor(F.unix_timestamp("ts") / 300)), 0.9)
    want = {(r.row, r.col): r.cnt for r in batch.collect() if r.cnt}
    closed = P.sketch_at(spark, path, F.timestamp_seconds(F.lit(6 * 300)), config)
    assert {(r.row, r.col): r.cnt for r in closed.collect()} == want
    open_ = max(r.cnt for r in load_state(spark, path, P.CELLS).collect())
    assert open_ > max(want.values())
    idle = P.sketch_at(spark, path, F.timestamp_seconds(F.lit(300 * 300)), config)
    assert idle.count() == 0  # decayed away while nothing came


def test_late_keys_count_in_the_open_epoch(spark, tmp_path):
    path, check, src = str(tmp_path / "cells"), str(tmp_path / "check"), str(tmp_path / "in")
    schema = "sidecar string, packed_key long, ts timestamp, seq long"
    for batch in (epochs((3, 7, 100)), epochs((1, 7, 50))):
        as_keys(spark, batch).coalesce(1).write.mode("append").parquet(src)
        P.fold_sketch(spark.readStream.schema(schema).parquet(src), path, check).awaitTermination()
    from kestrace.operators.state import load_state

    assert {r.cnt for r in load_state(spark, path, P.CELLS).collect()} == {150}


def test_a_trace_that_comes_again_counts_once(spark, tmp_path):
    schema = "trace_id string, service_name string, duration_us long, error_tags int, seq long"
    span = lambda t, s=1: (t, "frontend", 3_000_000, 0, s)
    path, check, src = str(tmp_path / "arms"), str(tmp_path / "check"), str(tmp_path / "in")
    for batch in ([span("t1"), span("t2"), span("t1")], [span("t1"), span("t3")], [span("t2"), span("t1")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        P.learn_rewards(spark.readStream.schema(schema).parquet(src), path, check).awaitTermination()
    assert [r.n for r in P.current_arms(spark, path).collect()] == [3]
    assert sorted(r.trace_id for r in P.marked(spark, path).collect()) == ["t1", "t2", "t3"]


def test_bodies_are_bounded_and_keep_scopes(spark):
    import json

    rows = spark.range(400).select(F.lit("frontend").alias("service_name"), (F.col("id") / 2).cast("long").cast("string").alias("trace_id"), F.col("id").cast("string").alias("span_id"), F.struct(F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("name"), F.lit("1").alias("version")).alias("scope"))
    bodies = [json.loads(r.body) for r in P.renest(rows, 50).collect()]
    sizes = [sum(len(s["spans"]) for s in b["scope_spans"]) for b in bodies]
    assert sum(sizes) == 400 and len(bodies) >= 6 and max(sizes) < 120
    assert {s["scope"]["name"] for b in bodies for s in b["scope_spans"]} == {"s0", "s1"}


def test_health_and_end(spark, tmp_path):
    q = spark.readStream.format("rate").load().writeStream.format("noop").queryName("pulse").option("checkpointLocation", str(tmp_path / "c")).start()
    assert [(r.name, r.status) for r in P.health([q]).collect()] == [("pulse", "ok")]
    assert P.finish([q], 1.0).first().status == "stopped" and not q.isActive
