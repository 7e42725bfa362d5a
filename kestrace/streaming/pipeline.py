"""The continuous form: verdicts for a span stream, sketch and rewards folded into versioned state.

Each query keeps its own checkpoint; state tables are written once for each batch number,
so a batch that runs again writes the same version.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import MapType

from ..constants import EngineConfig
from ..functions import spans as S
from ..operators import bandit as B
from ..operators import features as X
from ..operators import traces as T
from ..operators.state import load_state, save_state
from ..plans.decide import judged

ARM_STATE = "sidecar string, arm_index int, n long, " + ", ".join(f"a{i}{j} double" for i, j in B.PAIRS) + ", b0 double, b1 double, b2 double, b3 double, alpha double, beta double"
CELLS = "sidecar string, row int, col int, cnt long, epoch long"
VERDICT = "sidecar string, trace_id string, span_id string, seq long, sampled boolean, first boolean, method string, score double, packed_key long"


VERDICT_COLUMNS = [c.split()[0] for c in VERDICT.split(", ")]


def scored_spans(spans: DataFrame, state: DataFrame, cells: DataFrame, config: EngineConfig) -> DataFrame:
    """Every span with the verdict that it would give as its trace's first, against one state."""
    rows = X.estimate(X.features(spans), cells).withColumn("novelty", S.novelty(F.col("estimate")))
    rows = B.ucb_scores(B.with_policy(X.with_context(rows, F.col("novelty")), state), config.alpha)
    return judged(B.general_draws(rows, config.seed, "trace_id", "arm_index", confidence=config.confidence), config)


def _first_wins(ttl_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        known = state.exists
        verdict = state.get[0] if known else bool(rows["sampled"].iloc[0])
        if not known:
            state.update((verdict,))
        latest = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + ttl_ms)
        first = [not known and i == 0 for i in range(len(rows))]
        yield rows.assign(sampled=verdict, first=first)[VERDICT_COLUMNS]

    return step


def verdict_stream(scored: DataFrame, ttl_ms: int = 86_400_000) -> DataFrame:
    """One verdict for all spans of a trace at a sidecar, kept in event time for ttl after its last span.

    scored has ts with a watermark.
    """
    rows = scored.withColumn("first", F.lit(False)).select(*VERDICT_COLUMNS, "ts")
    return rows.groupBy("sidecar", "trace_id").applyInPandasWithState(_first_wins(ttl_ms), VERDICT, "verdict boolean", "append", GroupStateTimeout.EventTimeTimeout)


def renest(spans: DataFrame, most: int = 512) -> DataFrame:
    """Surviving spans put back into request bodies: a resource's spans by scope, at most about most spans a body.

    spans may have scope; services without survivors have no body. A service's spans are
    dealt to bodies by a hash of the trace, as many bodies as its spans need, so that no row
    grows with the service; a trace's spans stay together. A body may hold more than most
    where one trace does.
    """
    spans = spans if "scope" in spans.columns else spans.withColumn("scope", F.lit(None).cast("struct<name: string, version: string>"))
    bodies = spans.groupBy("service_name").agg(F.ceil(F.count(F.lit(1)) / most).alias("bodies"))
    row = F.struct(*[F.col(c) for c in spans.columns if c not in ("service_name", "scope")])
    dealt = spans.join(bodies, "service_name").withColumn("part", F.pmod(F.xxhash64("trace_id"), F.col("bodies")))
    scopes = dealt.groupBy("service_name", "part", "scope").agg(F.collect_list(row).alias("spans"))
    whole = scopes.groupBy("service_name", "part").agg(F.collect_list(F.struct("scope", "spans")).alias("scope_spans"))
    return whole.select("service_name", F.to_json(F.struct("service_name", "scope_spans")).alias("body"))


def write_sampled(verdicts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Sampled spans as Parquet files, exactly once by the file sink's log."""
    return verdicts.where("sampled").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def fold_sketch(keys: DataFrame, path: str, checkpoint: str, config: EngineConfig | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Folds each batch's keys into the sketch, which decays once at each event-time epoch's end.

    keys: sidecar, packed_key, ts.
    """
    config = config or EngineConfig()

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        epoch = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / config.decay_interval_s)
        held = load_before(spark, path, CELLS, number)
        fresh = batch.withColumn("epoch", epoch.cast("long"))
        new = fresh.select("sidecar", "epoch", F.inline(S.sketch_cells(F.col("packed_key")))).groupBy("sidecar", "row", "col", "epoch").agg(F.count(F.lit(1)).alias("cnt"))
        # Late keys count in the epoch that is open: what was cut down is not opened again.
        now = held.groupBy("sidecar").agg(F.max("epoch").alias("now"))
        both = _summed(held, new.join(now, "sidecar", "left").withColumn("epoch", F.greatest("epoch", "now")).drop("now"))
        last = both.groupBy("sidecar").agg(F.max("epoch").alias("last"))
        cells = both.groupBy("sidecar", "row", "col").agg(F.map_from_entries(F.collect_list(F.struct("epoch", "cnt"))).alias("h"), F.min("epoch").alias("first")).join(last, "sidecar")
        past = X.folded("h", "first", "last", config.decay_factor)
        save_state(cells.select("sidecar", "row", "col", past.alias("cnt"), F.col("last").alias("epoch")).where("cnt > 0"), path, number)

    return keys.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sketch_at(spark: SparkSession, path: str, moment: Column, config: EngineConfig | None = None) -> DataFrame:
    """The newest sketch as of a moment: decayed once for each epoch that ended since its last key, also when nothing came."""
    config = config or EngineConfig()
    epoch = F.floor(F.unix_timestamp(moment.cast("timestamp")) / config.decay_interval_s).cast("long")
    ended = F.greatest(epoch - F.col("epoch"), F.lit(0).cast("long"))
    return load_state(spark, path, CELLS).withColumn("cnt", X.closed(F.col("cnt"), ended, config.decay_factor)).where("cnt > 0")


def _summed(held: DataFrame, new: DataFrame) -> DataFrame:
    return held.unionByName(new).groupBy("sidecar", "row", "col", "epoch").agg(F.sum("cnt").alias("cnt"))


def load_before(spark: SparkSession, path: str, schema: str, number: int) -> DataFrame:
    """The newest complete version under number, so that a repeated batch starts from the same state."""
    from ..operators.state import versions

    found = [v for v in versions(spark, path) if v < number]
    return spark.read.schema(schema).parquet(f"{path}/version={found[-1]:010d}") if found else spark.createDataFrame([], schema)


MARKS = "trace_id string"


def learn_rewards(trace_spans: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Grades the traces of each batch that no batch before graded, and adds their rewards to the arms' state.

    trace_spans: what rollup needs. A batch should hold whole traces, as a store of finished
    traces gives them. Each batch marks its traces as processed in a table of its own, so a
    trace that the store gives again, in the same batch (equal spans) or a later one, counts once;
    a batch that runs again overwrites its own marks and state.
    """

    def learn(batch: DataFrame, number: int) -> None:
        spark, marks = batch.sparkSession, f"{path}/processed"
        done = marked(spark, path, number)
        new = batch.dropDuplicates([c for c in batch.columns if not isinstance(batch.schema[c].dataType, MapType)])
        new = T.not_processed(new, done)
        save_state(new.select("trace_id").distinct(), marks, number)
        # The marks were written first; the state follows from the same batch and marks.
        arms = B.arm_state(T.routed(T.arm_entries(new)))
        held = load_before(spark, path, ARM_STATE, number)
        save_state(B.merge_states(held.unionByName(arms.select(held.columns)), ["sidecar", "arm_index"]), path, number)

    return trace_spans.writeStream.foreachBatch(learn).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def marked(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Ids of the traces that batches under before have processed."""
    from ..operators.state import versions

    found = [f"{path}/processed/version={v:010d}" for v in versions(spark, f"{path}/processed") if before is None or v < before]
    return spark.read.schema(MARKS).parquet(*found) if found else spark.createDataFrame([], MARKS)


def finish(queries: list[StreamingQuery], seconds: float = 5.0) -> DataFrame | None:
    """Ends queries: lets each process what has arrived for up to seconds in all, then stops it.

    Progress and state are on disk after each batch, so a query that is stopped goes on from
    its last batch. Gives health afterwards; None without queries.
    """
    until = time.monotonic() + seconds
    for q in queries:
        while q.isActive and q.status["isDataAvailable"] and time.monotonic() < until:
            time.sleep(0.1)
        q.stop()
    for q in queries:
        q.awaitTermination(max(0.1, until - time.monotonic()))
    return health(queries) if queries else None


def health(queries: list[StreamingQuery]) -> DataFrame:
    """(name, status, batch, message): ok while a query is active, else stopped, or failed with its error."""
    spark = SparkSession.active()
    rows = []
    for q in queries:
        error = None if q.isActive else q.exception()
        last = q.lastProgress
        rows.append((q.name or str(q.id), "ok" if q.isActive else "failed" if error else "stopped", last.batchId if last else None, str(error) if error else q.status["message"]))
    return spark.createDataFrame(rows, "name string, status string, batch long, message string")


def current_arms(spark: SparkSession, path: str) -> DataFrame:
    return load_state(spark, path, ARM_STATE)


class MetricsLog(StreamingQueryListener):
    """Keeps a line for each batch: rows in, rows a second, state rows."""

    def __init__(self, keep: int = 1000):
        self.lines: list[dict] = []
        self.keep = keep

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        line = {"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)}
        self.lines = [*self.lines, line][-self.keep :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
