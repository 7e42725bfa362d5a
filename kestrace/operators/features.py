"""Feature rows of spans, and the sketch that estimates how often a pattern was seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import REWARD_NOVELTY, SKETCH_COLUMNS, SKETCH_SEEDS
from ..functions import spans as S


def features(spans: DataFrame) -> DataFrame:
    """spans with latency_bucket, has_error, svc_id, topo_hash, packed_key and arm_index."""
    return (
        spans.withColumn("latency_bucket", S.latency_bucket(F.col("duration_us")))
        .withColumn("has_error", S.narrow_error(F.col("status_code"), F.col("error_attribute"), F.col("http_status")))
        .withColumn("svc_id", S.service_id(F.col("service_name")))
        .withColumn("topo_hash", S.topo_hash(F.col("parent_services")))
        .withColumn("packed_key", S.packed_key(F.col("latency_bucket"), F.col("has_error"), F.col("svc_id"), F.col("topo_hash")))
        .withColumn("arm_index", S.arm_index(F.col("latency_bucket"), F.col("svc_id"), F.col("topo_hash")))
    )


def with_context(rows: DataFrame, novelty: Column | None = None) -> DataFrame:
    """Adds x0 to x3; the novelty of rewards is fixed."""
    novelty = F.lit(REWARD_NOVELTY) if novelty is None else novelty
    return rows.select("*", *S.bandit_context(F.col("latency_bucket"), F.col("has_error"), F.col("svc_id"), novelty))


def build_sketch(keys: DataFrame, by: str = "sidecar") -> DataFrame:
    """(by, row, col, cnt): cell counts of the keys' occurrences; at most 2048 rows for each value of by."""
    once = keys.groupBy(by, "packed_key").agg(F.count(F.lit(1)).alias("cnt"))
    return once.select(by, "cnt", F.inline(S.sketch_cells(F.col("packed_key")))).groupBy(by, "row", "col").agg(F.sum("cnt").alias("cnt"))


def estimate(keys: DataFrame, cells: DataFrame, by: str = "sidecar") -> DataFrame:
    """keys with estimate: the smallest of a key's cells.

    A sketch is one array of 2048 numbers, joined on by; keys are neither multiplied nor
    shuffled once for each row of the sketch.
    """
    at = F.col("row") * SKETCH_COLUMNS + F.col("col")
    arrays = cells.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("at"), "cnt"))).alias("cells"))  # at most 2048 entries
    dense = arrays.select(by, F.transform(F.sequence(F.lit(0), F.lit(len(SKETCH_SEEDS) * SKETCH_COLUMNS - 1)), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0).cast("long"))).alias("cells"))
    joined = keys.join(dense, by, "left")
    found = [F.get("cells", F.lit(r * SKETCH_COLUMNS) + S.sketch_column(F.col("packed_key"), r)) for r in range(len(SKETCH_SEEDS))]
    return joined.withColumn("estimate", F.coalesce(F.least(*found), F.lit(0).cast("long"))).drop("cells")


def merge_sketches(cells: DataFrame, by: list[str], how: str = "max") -> DataFrame:
    """Cells of several sketches as one, by the larger count or, for disjoint streams, the sum."""
    if how not in ("max", "sum"):
        raise ValueError(how)
    total = F.max("cnt") if how == "max" else F.sum("cnt")
    return cells.groupBy(*by, "row", "col").agg(total.alias("cnt"))


def decay(cells: DataFrame, factor: float) -> DataFrame:
    """Counts times factor, cut down to whole numbers; empty cells go."""
    return cells.withColumn("cnt", F.floor(F.col("cnt") * factor).cast("long")).where("cnt > 0")


def folded(history: str, first: str, last: str, factor: float) -> Column:
    """A cell's count in epoch last, which is still open, from a map of its counts by epoch.

    At the end of each epoch before it the count is cut down to a whole number of count
    times factor, also where no key came.
    """
    step = lambda a, e: F.floor(a * F.when(e > F.col(first), factor).otherwise(1.0)).cast("long") + F.coalesce(F.try_element_at(history, e), F.lit(0).cast("long"))
    return F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), step)


def closed(count: Column, epochs: Column, factor: float) -> Column:
    """A count after so many more ends of epochs without keys."""
    return F.aggregate(F.sequence(F.lit(0).cast("long"), epochs), count, lambda a, i: F.floor(a * F.when(i > 0, factor).otherwise(1.0)).cast("long"))


def decayed_sketch(keys: DataFrame, factor: float, by: str = "sidecar", epoch: str = "epoch") -> DataFrame:
    """(by, row, col, cnt) after the last epoch that has keys: decayed at its end and at that of each epoch before.

    The streaming fold leaves its last epoch open; closed at its end it is the same table.
    """
    once = keys.groupBy(by, epoch, "packed_key").agg(F.count(F.lit(1)).alias("n"))
    cells = once.select(by, epoch, "n", F.inline(S.sketch_cells(F.col("packed_key")))).groupBy(by, "row", "col", epoch).agg(F.sum("n").alias("n"))
    last = keys.groupBy(by).agg(F.max(epoch).alias("last"))
    history = cells.groupBy(by, "row", "col").agg(F.map_from_entries(F.collect_list(F.struct(epoch, "n"))).alias("h"), F.min(epoch).alias("first")).join(last, by)
    return history.select(by, "row", "col", closed(folded("h", "first", "last", factor), F.lit(1).cast("long"), factor).alias("cnt"))


def replay_estimates(keys: DataFrame, by: str = "sidecar", seq: str = "seq") -> DataFrame:
    """(by, seq, estimate): for each key in order, the estimate from all keys before it."""
    return replayed_novelty(keys.select(by, seq, "packed_key"), by, seq).select(by, seq, "estimate")


def replayed_novelty(rows: DataFrame, by: str = "sidecar", seq: str = "seq", span: int | None = None) -> DataFrame:
    """rows (packed_key) with estimate: what a sketch of all rows before each one gives for it.

    A row travels once for each cell of its key; the first copy carries it whole, so that
    no join is needed. span: as in replay_states, histories are cut and carried on.
    """
    whole = F.struct(*[F.col(c) for c in rows.columns if c not in (by, seq)])
    cells = rows.select(by, seq, F.inline(S.sketch_cells(F.col("packed_key"))), whole.alias("whole"))
    cells = cells.withColumn("whole", F.when(F.col("row") == 0, F.col("whole"))).withColumn("part", F.lit(0) if span is None else F.floor(F.col(seq) / span))
    before = Window.partitionBy(by, "row", "col", "part").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumn("n", F.count(F.lit(1)).over(before))
    if span is not None:
        past = Window.partitionBy(by, "row", "col").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        totals = cells.groupBy(by, "row", "col", "part").agg(F.count(F.lit(1)).alias("all"))
        carried = totals.select(by, "row", "col", "part", F.coalesce(F.sum("all").over(past), F.lit(0)).alias("before"))
        counted = counted.join(carried, [by, "row", "col", "part"]).withColumn("n", F.col("n") + F.col("before"))
    once = counted.groupBy(by, seq).agg(F.min("n").alias("estimate"), F.max_by("whole", -F.col("row")).alias("whole"))
    return once.select(by, seq, "estimate", "whole.*")
