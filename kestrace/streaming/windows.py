"""Span counts over event time; the same plans run on tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late_after(spans: DataFrame, delay: str) -> DataFrame:
    return spans.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def windowed(spans: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Spans and errors of tumbling windows, or of sliding ones."""
    by = spans.groupBy(F.window("ts", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("is_error").cast("long")).alias("errors"))
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "spans", "errors")


def sessions(spans: DataFrame, gap: str) -> DataFrame:
    """Bursts of a trace's spans that no gap parts."""
    by = spans.groupBy("trace_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("spans"))
    return by.select("trace_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "spans")
