"""Traces rolled up from spans, classified, and turned into rewards for the arms that saw them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import COMPLEX_SERVICES, REWARDS, SERVICE_IDS, SLOW_MS, VALUES
from ..functions import spans as S
from .features import with_context


def rollup(spans: DataFrame) -> DataFrame:
    """One row for each trace: duration, errors, services, spans, and the service of the longest span.

    spans: trace_id, service_name, duration_us, error_tags, seq (order of ties), as
    flatten_traces gives. Spans of no known service count, but not as a service.
    """
    named = F.when(~F.coalesce("service_name", F.lit("")).isin("", "unknown"), F.col("service_name"))
    return spans.groupBy("trace_id").agg(
        F.max("duration_us").alias("duration_us"),
        (F.sum("error_tags") > 0).alias("has_error"),
        F.sum("error_tags").cast("long").alias("error_count"),
        F.count_distinct(named).alias("num_services"),
        F.count(F.lit(1)).alias("num_spans"),
        F.max_by(F.coalesce("service_name", F.lit("unknown")), F.struct(F.col("duration_us"), -F.col("seq"))).alias("root_service"),
    )


def trace_services(spans: DataFrame) -> DataFrame:
    """Sorted service list of each trace."""
    return spans.where(~F.coalesce("service_name", F.lit("")).isin("", "unknown")).groupBy("trace_id").agg(F.array_sort(F.collect_set("service_name")).alias("services"))


def _ladder(extreme: bool) -> Column:
    ms = F.col("duration_us") / 1000.0
    out = F.when(F.col("has_error"), "error")
    if extreme:
        out = out.when(ms > SLOW_MS["extreme_slow"], "extreme_slow")
    out = out.when(ms > SLOW_MS["very_slow"], "very_slow").when(ms > SLOW_MS["slow"], "slow")
    return out.when(F.col("num_services") >= COMPLEX_SERVICES, "complex").when(ms > SLOW_MS["moderate"], "moderate").otherwise("routine")


def _scale(name: Column, scale: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in scale.items() for x in kv]), name)


def rewarded(traces: DataFrame) -> DataFrame:
    """traces with reason and reward; traces of no known service go."""
    return traces.where("num_services > 0").withColumn("reason", _ladder(True)).withColumn("reward", _scale(F.col("reason"), REWARDS))


def classified(traces: DataFrame, empty: str = "skip") -> DataFrame:
    """traces with class and value; empty says what becomes of those without spans: skip or unknown."""
    if empty not in ("skip", "unknown"):
        raise ValueError(empty)
    none = F.col("num_spans") == 0
    out = traces if empty == "unknown" else traces.where(~none)
    out = out.withColumn("class", F.when(none, "unknown").otherwise(_ladder(False)))
    return out.withColumn("value", _scale(F.col("class"), VALUES))


def service_durations(spans: DataFrame) -> DataFrame:
    """The longest span of each service in each trace."""
    known = spans.where(~F.coalesce("service_name", F.lit("")).isin("", "unknown"))
    return known.groupBy("trace_id", "service_name").agg(F.max("duration_us").alias("duration_us"))


def arm_entries(spans: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """A row for each service of each rewarded trace: the arm and context that its sidecar would have used."""
    graded = rewarded(rollup(spans) if traces is None else traces).select("trace_id", F.col("has_error").cast("int").alias("has_error"), "reward", "reason")
    rows = service_durations(spans).join(graded, "trace_id")
    rows = rows.withColumn("latency_bucket", S.latency_bucket(F.col("duration_us"))).withColumn("svc_id", S.service_id(F.col("service_name")))
    rows = rows.withColumn("arm_index", S.arm_index(F.col("latency_bucket"), F.col("svc_id"), F.lit(0)))
    return with_context(rows).select("trace_id", "service_name", "svc_id", "latency_bucket", "has_error", "arm_index", "x0", "x1", "x2", "x3", "reward", "reason")


def routed(entries: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """entries at the sidecar of their service, found back from the context's third number.

    Services without an id of their own have no sidecar. routes (service_name, sidecar)
    restricts and renames; without it a service's sidecar has its name.
    """
    spark = entries.sparkSession
    names = spark.createDataFrame([(i, n) for n, i in SERVICE_IDS.items()], "route_id int, owner string")
    found = entries.join(names, F.floor(F.col("x2") * 255).cast("int") == F.col("route_id")).where("owner = service_name").drop("route_id")
    if routes is None:
        return found.withColumnRenamed("owner", "sidecar")
    return found.join(routes.select(F.col("service_name").alias("owner"), "sidecar"), "owner").drop("owner")


def broadcast_to_all(entries: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Every entry at every sidecar; the list of sidecars is the few that are configured.

    Where only sums are asked for, sum first and give them to all.
    """
    return entries.crossJoin(sidecars.select("sidecar"))


def not_processed(traces: DataFrame, processed: DataFrame) -> DataFrame:
    return traces.join(processed.select("trace_id").distinct(), "trace_id", "left_anti")


def class_distribution(classes: DataFrame) -> DataFrame:
    """Count, value and share of each class."""
    by = classes.groupBy("class").agg(F.count(F.lit(1)).alias("traces"), F.sum("value").alias("total_value"))
    return by.withColumn("share", F.col("traces") / F.sum("traces").over(Window.partitionBy()))  # a row a class


def baseline_summary(classes: DataFrame) -> DataFrame:
    """Spans, duration and value a trace, and shares of the classes that matter."""
    share = lambda *names: (F.sum(F.col("class").isin(*names).cast("int")) / F.count(F.lit(1)))
    return classes.agg(
        F.count(F.lit(1)).alias("traces"), F.sum("num_spans").alias("spans"), F.avg("num_spans").alias("spans_per_trace"), F.avg(F.col("duration_us") / 1000.0).alias("avg_duration_ms"),
        F.sum("value").alias("total_value"), F.avg("value").alias("avg_value"), share("error").alias("error_share"), share("very_slow", "slow").alias("slow_share"), share("routine").alias("routine_share"),
    )


def reward_breakdown(rewards: DataFrame) -> DataFrame:
    return rewards.groupBy("reason").agg(F.count(F.lit(1)).alias("traces"), F.sum("reward").alias("reward"))
