"""Metrics of a sampler, comparison with random sampling, convergence of independent learners, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import BANDIT_BYTES, SKETCH_BYTES, THOMPSON_BYTES
from ..functions.spans import span_uptime, text_bar


def ratio(a, b):
    """a / b, 0 where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0)) > 0, a / b).otherwise(0.0)


def sampler_metrics(decisions: DataFrame, state: DataFrame | None = None, rewards: DataFrame | None = None, by: str = "sidecar", confidence: int = 10) -> DataFrame:
    """One row for each sidecar; decisions has method (forced, linucb, thompson) and sampled."""
    when = lambda c: F.sum(c.cast("int")).cast("long")
    method = F.col("method")
    out = decisions.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_spans"), when(F.col("sampled")).alias("sampled_spans"), when(~F.col("sampled")).alias("dropped_spans"),
        when(method == "thompson").alias("thompson_decisions"), when(method == "linucb").alias("linucb_decisions"), when(method == "forced").alias("forced_samples"),
    ).withColumn("sample_rate", ratio(F.col("sampled_spans"), F.col("total_spans")))
    if rewards is not None:
        out = out.join(rewards.groupBy(by).agg(F.count(F.lit(1)).alias("rewards_received"), F.avg("reward").alias("avg_reward")), by, "left").fillna(0, ["rewards_received", "avg_reward"])
    if state is not None:
        arms = state.groupBy(by).agg(when(F.col("n") > 0).alias("active_arms"), when(F.col("n") >= confidence).alias("confident_arms"))
        out = out.join(arms, by, "left").fillna(0, ["active_arms", "confident_arms"])
    sizes = {"sketch_memory_bytes": SKETCH_BYTES, "bandit_memory_bytes": BANDIT_BYTES, "thompson_memory_bytes": THOMPSON_BYTES}
    return out.withColumns({k: F.lit(v) for k, v in sizes.items()})


def service_stats(spans: DataFrame) -> DataFrame:
    """In, out and cache figures of each sidecar; spans has trace_id, first (its trace's first) and sampled."""
    when = lambda c: F.sum(c.cast("int")).cast("long")
    return spans.groupBy("sidecar").agg(
        F.count(F.lit(1)).alias("total_spans_in"), when(F.col("sampled")).alias("total_spans_out"), when(~F.col("sampled")).alias("spans_dropped"),
        when(F.col("first")).alias("cache_misses"), when(~F.col("first")).alias("cache_hits"),
    )


def cluster_metrics(snapshots: DataFrame, sidecars: DataFrame | None = None) -> DataFrame:
    """Totals over sidecars, rewards averaged by their counts; sidecars without a snapshot count as down."""
    if sidecars is not None:
        snapshots = sidecars.join(snapshots.withColumn("up", F.lit(True)), "sidecar", "left")
    else:
        snapshots = snapshots.withColumn("up", F.lit(True))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    counts = ["total_spans", "sampled_spans", "dropped_spans", "thompson_decisions", "linucb_decisions", "forced_samples", "rewards_received"]
    out = snapshots.agg(F.count(F.lit(1)).alias("sidecars"), F.count("up").alias("alive"), *map(total, counts), F.sum(F.col("rewards_received") * F.col("avg_reward")).alias("reward_sum"))
    return out.withColumn("sample_rate", ratio(F.col("sampled_spans"), F.col("total_spans"))).withColumn("avg_reward", ratio(F.col("reward_sum"), F.col("rewards_received"))).drop("reward_sum")


#: Draws that one md5 gives: its 128 bits are four numbers of 32.
DRAWS_A_HASH = 4


def random_sampling(classes: DataFrame, rate: float | DataFrame, repeats: int = 200, seed: str = "0") -> DataFrame:
    """What sampling traces at rate would capture, averaged over seeded repeats.

    rate: a number, or one row with sample_rate, such as a policy's totals. Each trace is
    drawn once for each repeat; totals are summed before the rates, and rates without
    anything to capture are 1 (errors, slow traces) or 0 (value).
    """
    slow = F.col("class").isin("very_slow", "slow")
    rows = classes.select("trace_id", "class", "value")
    rows = rows.withColumn("rate", F.lit(float(rate))) if not isinstance(rate, DataFrame) else rows.crossJoin(F.broadcast(rate.select(F.col("sample_rate").alias("rate"))))
    block = F.explode(F.sequence(F.lit(0), F.lit(-(-repeats // DRAWS_A_HASH) - 1))).alias("block")
    hashed = rows.select("*", block).withColumn("h", F.md5(F.concat_ws("|", "trace_id", F.col("block").cast("string"), F.lit(seed)).cast("binary")))
    draw = lambda i: F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long") / 4294967296.0
    sims = F.array(*[F.struct((F.col("block") * DRAWS_A_HASH + i).alias("sim"), (draw(i) < F.col("rate")).alias("hit")) for i in range(DRAWS_A_HASH)])
    drawn = hashed.select("class", "value", F.inline(sims)).where(F.col("sim") < repeats)
    part = lambda c: F.sum(F.when(F.col("hit"), c).otherwise(0.0))
    error = (F.col("class") == "error").cast("double")
    by = drawn.groupBy("sim").agg(
        part(F.lit(1.0)).alias("n"), F.count(F.lit(1)).alias("of"), part(error).alias("errors"), F.sum(error).alias("all_errors"), part(slow.cast("double")).alias("slow"), F.sum(slow.cast("double")).alias("all_slow"), part(F.col("value")).alias("v"), F.sum("value").alias("all_v"),
    )
    rate_of = lambda a, b, none: F.avg(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(none))
    return by.agg(
        F.avg("n").alias("avg_sample_count"), F.avg(F.col("n") / F.col("of")).alias("avg_actual_rate"), rate_of("errors", "all_errors", 1.0).alias("avg_error_capture"), rate_of("slow", "all_slow", 1.0).alias("avg_slow_capture"), rate_of("v", "all_v", 0.0).alias("avg_value_capture"),
    )


def compare_policies(stored: DataFrame, metrics: DataFrame, random: DataFrame) -> DataFrame:
    """The report's three comparisons and its verdict, one row.

    stored: the classified traces that a policy kept; metrics: its cluster totals; random:
    random_sampling at its rate. As in the report, the policy's error capture is 1 when
    anything was forced, its slow figure is a share of stored traces, and its value figure a
    mean; true capture rates are capture_rates.
    """
    one = stored.agg(
        F.count(F.lit(1)).alias("traces"), F.sum((F.col("class") == "error").cast("int")).alias("errors"), F.sum(F.col("class").isin("very_slow", "slow").cast("int")).alias("slow"), F.sum("value").alias("v"),
    )
    row = one.crossJoin(metrics.select("forced_samples", "sample_rate")).crossJoin(random.select("avg_error_capture", "avg_slow_capture", "avg_value_capture"))
    error = F.when(F.col("forced_samples") > 0, 1.0).when(F.col("errors") > 0, ratio(F.col("errors"), F.col("traces"))).otherwise(1.0)
    row = row.select(error.alias("error_rate"), F.col("avg_error_capture").alias("random_error_rate"), ratio(F.col("slow"), F.col("traces")).alias("slow_rate"), F.col("avg_slow_capture").alias("random_slow_rate"), ratio(F.col("v"), F.col("traces")).alias("value_per_trace"), F.col("avg_value_capture").alias("random_value_rate"), (1 - F.col("sample_rate")).alias("volume_reduction"))
    wins = sum((F.col(a) >= F.col(b)).cast("int") for a, b in (("error_rate", "random_error_rate"), ("slow_rate", "random_slow_rate"), ("value_per_trace", "random_value_rate")))
    return row.withColumn("wins", wins).withColumn("outperforms", F.col("wins") >= 2)


def capture_rates(classes: DataFrame, kept: DataFrame) -> DataFrame:
    """What share of all errors, slow traces and value the kept traces hold."""
    rows = classes.join(kept.select("trace_id").distinct().withColumn("hit", F.lit(True)), "trace_id", "left")
    hit = F.coalesce("hit", F.lit(False)).cast("int")
    slow = F.col("class").isin("very_slow", "slow").cast("int")
    error = (F.col("class") == "error").cast("int")
    return rows.agg(
        F.avg(hit).alias("trace_rate"), ratio(F.sum(hit * error), F.sum(error)).alias("error_capture"), ratio(F.sum(hit * slow), F.sum(slow)).alias("slow_capture"), ratio(F.sum(hit * F.col("value")), F.sum("value")).alias("value_capture"),
    )


def arm_convergence(stats: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Arms that several sidecars know: their mean reward, its spread, and two tests of agreement."""
    by = stats.groupBy("arm_index").agg(F.count(F.lit(1)).alias("sidecars"), F.avg("thompson_mean").alias("mean"), F.stddev_pop("thompson_mean").alias("spread"), F.max("thompson_mean").alias("high"), F.min("thompson_mean").alias("low"))
    far = F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low"))
    shared = by.where("sidecars > 1")
    return shared.select("arm_index", "sidecars", "mean", "spread", (F.col("spread") < tolerance).alias("similar"), ((F.col("mean") != 0) & (far < tolerance)).alias("converged"))


def convergence_verdict(arms: DataFrame) -> DataFrame:
    n = arms.agg(F.count(F.lit(1)).alias("shared"), F.coalesce(F.sum(F.col("converged").cast("int")), F.lit(0)).alias("converged"))
    verdict = F.when(F.col("converged") == F.col("shared"), "all").when(F.col("converged") > F.col("shared") * 0.7, "most").otherwise("few")
    return n.withColumn("verdict", verdict)


def latency_stats(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Mean, bounds and percentiles by rank floor(n p), with a grade of the median.

    Ranks come from a window over counts of equal values, so equal values travel once and no
    list of all values is built.
    """
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(by).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col(value)))
    out = ranked.groupBy(by).agg(
        F.max("n").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.max("n")).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"),
    )
    return out.withColumn("grade", F.when(F.col("p50") < 5000, "excellent").when(F.col("p50") < 10000, "good").otherwise("high"))


def interpretation(mean):
    return F.when(mean > 0.6, "high value").when(mean > 0.3, "moderate value").otherwise("low value")


def active_arms(stats: DataFrame, limit: int = 50) -> DataFrame:
    """Arms with observations, most first, ties by arm."""
    return stats.where("n > 0").withColumn("interpretation", interpretation(F.col("thompson_mean"))).orderBy(F.desc("n"), "arm_index").limit(limit)


def busiest_arms(stats: DataFrame, limit: int = 50) -> DataFrame:
    """Of each sidecar, its arms with most observations, ties by arm."""
    rank = Window.partitionBy("sidecar").orderBy(F.desc("n"), "arm_index")
    return stats.where("n > 0").withColumn("place", F.row_number().over(rank)).where(F.col("place") <= limit).drop("place").withColumn("interpretation", interpretation(F.col("thompson_mean")))


def merged_arms(state: DataFrame, limit: int = 6) -> DataFrame:
    """The cluster's arms: observations added, the mean of the added priors, confident from 10 on."""
    by = state.groupBy("arm_index").agg(F.sum("n").alias("n"), (F.sum("alpha") / (F.sum("alpha") + F.sum("beta"))).alias("thompson_mean"))
    return by.where("n > 0").withColumn("confident", F.col("n") >= 10).orderBy(F.desc("n"), "arm_index").limit(limit)


def arm_listing(state: DataFrame) -> DataFrame:
    """All arms that learned, sidecar by sidecar and arm by arm."""
    return state.where("n > 0").orderBy("sidecar", "arm_index")


#: Arms that the report names.
REPORT_ARMS = 8


def report(metrics: DataFrame, distribution: DataFrame, comparison: DataFrame, state: DataFrame | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """All figures as (section, metric, value), ready to be written as JSON or printed; truth is 1 or 0.

    state adds the REPORT_ARMS busiest arms of the cluster and the convergence of its
    sidecars; snapshots adds each sidecar's own metrics.
    """

    def long(rows: DataFrame, section: str, *key: str) -> DataFrame:
        names = [c for c, kind in rows.dtypes if c not in key and kind != "string"]
        name = lambda c: F.concat_ws(".", *[F.col(k).cast("string") for k in key], F.lit(c))
        pairs = F.array(*[F.struct(name(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
        return rows.select(F.lit(section).alias("section"), F.inline(pairs))

    out = long(metrics, "cluster").unionByName(long(distribution, "classes", "class")).unionByName(long(comparison, "comparison"))
    if state is not None:
        means = state.withColumn("thompson_mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))
        out = out.unionByName(long(merged_arms(state, REPORT_ARMS), "arms", "arm_index")).unionByName(long(convergence_verdict(arm_convergence(means)), "convergence"))
    return out if snapshots is None else out.unionByName(long(snapshots, "sidecars", "sidecar"))


def dashboard(snapshots: DataFrame, width: int = 30) -> DataFrame:
    """(sidecar, line): a line of text for each sidecar, with its spans as a bar against the busiest one's."""
    most = snapshots.agg(F.max("total_spans").alias("most"))
    bar = text_bar(F.col("total_spans"), F.col("most"), width)
    rate = F.format_string("%5.1f%%", 100 * ratio(F.col("sampled_spans"), F.col("total_spans")))
    up = span_uptime(F.col("uptime_seconds"))
    return snapshots.crossJoin(most).select("sidecar", F.concat_ws(" ", F.rpad("sidecar", 24, " "), bar, F.lpad(F.col("total_spans").cast("string"), 9, " "), rate, up).alias("line")).orderBy("sidecar")
