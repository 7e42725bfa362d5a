"""Metrics snapshots and reports as JSON: read from sidecars' files, written for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOT = (
    "sidecar STRING, uptime_seconds DOUBLE, total_spans BIGINT, sampled_spans BIGINT, dropped_spans BIGINT, thompson_decisions BIGINT, linucb_decisions BIGINT, "
    "forced_samples BIGINT, rewards_received BIGINT, avg_reward DOUBLE, active_arms BIGINT, confident_arms BIGINT"
)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots as JSON lines; lines that cannot be read, or name no sidecar, are left out."""
    return spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").json(path).where("sidecar is not null")


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text for each row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("body"))


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
