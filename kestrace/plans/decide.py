"""Sampling decisions: with a frozen policy, and replayed event by event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import EngineConfig
from ..functions import spans as S
from ..operators import bandit as B
from ..operators.features import estimate, features, replayed_novelty, with_context


def by_sidecar(spans: DataFrame) -> DataFrame:
    """spans with the sidecar that sees them: the one of their service."""
    return spans.withColumn("sidecar", F.col("service_name"))


def first_spans(spans: DataFrame) -> DataFrame:
    """The span that decides for its trace at its sidecar: the first in order. Traces without id share one verdict."""
    whole = F.struct(*[F.col(c) for c in spans.columns])
    # Each map task keeps one span of a trace, so a group as large as that of the empty id is one row a task.
    return spans.groupBy("sidecar", "trace_id").agg(F.min_by(whole, "seq").alias("one")).select("one.*")


def judged(rows: DataFrame, config: EngineConfig) -> DataFrame:
    """rows (ucb, draw, n, has_error, is_error) with method, score and sampled."""
    forced = F.lit(config.force_errors) & (F.coalesce("is_error", F.lit(False)) | (F.col("has_error") == 1))
    learned = F.col("n") >= config.confidence
    method = F.when(forced, "forced").when(learned, "linucb").otherwise("thompson")
    score = F.when(forced, 1.0).when(learned, F.col("ucb")).otherwise(F.col("draw"))
    return rows.select("*", method.alias("method"), score.alias("score"), (score >= config.threshold).alias("sampled"))


def decide(spans: DataFrame, state: DataFrame, cells: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Decisions for the first span of each trace, all against one state of arms and sketch.

    spans: sidecar, seq, trace_id and what features needs; is_error is optional.
    """
    config = config or EngineConfig()
    spans = spans if "is_error" in spans.columns else spans.withColumn("is_error", F.lit(False))
    rows = features(first_spans(spans))
    rows = estimate(rows, cells).withColumn("novelty", S.novelty(F.col("estimate")))
    rows = B.ucb_scores(B.with_policy(with_context(rows, F.col("novelty")), state), config.alpha)
    rows = B.general_draws(rows, config.seed, "trace_id", "arm_index", confidence=config.confidence)
    return judged(rows, config)


def verdicts(spans: DataFrame, decisions: DataFrame, error_override: bool = False) -> DataFrame:
    """All spans with the verdict of their trace's first span.

    error_override also keeps error spans of dropped traces, which the first-span rule drops.
    """
    found = decisions.select("sidecar", "trace_id", F.col("sampled").alias("verdict"), F.col("seq").alias("decided_at"))
    out = spans.join(found, ["sidecar", "trace_id"])
    sampled = F.col("verdict") | F.coalesce("is_error", F.lit(False)) if error_override else F.col("verdict")
    return out.withColumn("first", F.col("seq") == F.col("decided_at")).withColumn("sampled", sampled).drop("verdict", "decided_at")


def replay_states(decisions: DataFrame, rewards: DataFrame, span: int | None = None) -> DataFrame:
    """decisions with the arm state that all earlier rewards give (n, a.., b.., alpha, beta).

    rewards: sidecar, arm_index, x0..x3, reward and seq, the moment they arrive; one that
    arrives with a decision's number counts after it. One running sum replaces a loop.
    span: histories are cut at every so many numbers, summed apart and carried on, so that
    no task holds the whole history of an arm that dominates.
    """
    parts = B.sums(F.col("reward"))
    key = ["sidecar", "arm_index"]
    whole = F.struct(*[F.col(c) for c in decisions.columns if c not in (*key, "seq")])
    asked = decisions.select(*key, "seq", F.lit(0).alias("kind"), *[F.lit(0.0).alias(k) for k in parts], whole.alias("decision"))
    kind = asked.schema["decision"].dataType
    events = rewards.select(*key, "seq", F.lit(1).alias("kind"), *[c.cast("double").alias(k) for k, c in parts.items()], F.lit(None).cast(kind).alias("decision"))
    line = events.unionByName(asked).withColumn("part", F.lit(0) if span is None else F.floor(F.col("seq") / span))
    before = Window.partitionBy(*key, "part").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = line.select(*key, "seq", "kind", "part", "decision", *[F.sum(k).over(before).alias(k) for k in parts]).where("kind = 0")
    if span is not None:
        past = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        totals = line.groupBy(*key, "part").agg(*[F.sum(k).alias(k) for k in parts])
        carried = totals.select(*key, "part", *[F.coalesce(F.sum(k).over(past), F.lit(0.0)).alias(f"{k}_before") for k in parts])
        found = found.join(carried, [*key, "part"]).withColumns({k: F.col(k) + F.col(f"{k}_before") for k in parts})
    return B.as_state(found, [*key, "seq", "decision"]).select("*", "decision.*").drop("decision")


def replay(spans: DataFrame, rewards: DataFrame, config: EngineConfig | None = None, span: int | None = None) -> DataFrame:
    """Every decision as it would have been taken at its moment: novelty and arms as of then, no decay. span as in replay_states."""
    config = config or EngineConfig()
    spans = spans if "is_error" in spans.columns else spans.withColumn("is_error", F.lit(False))
    rows = replayed_novelty(features(first_spans(spans)), span=span).withColumn("novelty", S.novelty(F.col("estimate")))
    rows = replay_states(with_context(rows, F.col("novelty")), rewards, span)
    rows = B.ucb_scores(B.factorised(rows), config.alpha)
    return judged(B.general_draws(rows, config.seed, "trace_id", "arm_index", confidence=config.confidence), config)


def recent(decisions: DataFrame, limit: int) -> DataFrame:
    """The last decisions as the log shows them; limit must be 1 to 200."""
    if not 1 <= limit:
        raise ValueError("limit must be positive")
    rows = decisions.orderBy(F.desc("seq"), "sidecar").limit(min(limit, 200))
    return rows.select("seq", "sidecar", F.substring("trace_id", 1, 16).alias("trace_id"), F.crc32(F.col("trace_id").cast("binary")).alias("trace_hash"), "arm_index", "packed_key", "method", "score", "sampled")


def queue_survivors(records: DataFrame, capacity: int, by: str = "sidecar") -> DataFrame:
    """What a full queue that evicts its oldest still holds: the last capacity records, and how many were dropped."""
    pushed = records.groupBy(by).agg(F.count(F.lit(1)).alias("pushed"))
    newest = Window.partitionBy(by).orderBy(F.desc("seq"))
    # The bound on the rank reaches the window, so each map task sends at most capacity records a queue.
    last = records.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= capacity).drop("place")
    return last.join(pushed, by).withColumn("dropped", F.greatest(F.col("pushed") - capacity, F.lit(0))).drop("pushed")
