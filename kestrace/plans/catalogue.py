"""The registered queries over the test tables, each with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import LATENCY_BOUNDS_US, SERVICE_IDS, SKETCH_SEEDS, UNKNOWN_SERVICE_ID
from ..functions import spans as S
from ..operators import bandit as B
from ..operators import evaluate as E
from ..operators import features as X
from ..operators import traces as T
from ..sources import spans as I
from ..streaming import windows as W
from . import decide as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {', '.join(CTE)} {sql}" if not sql.lstrip().startswith("WITH") else sql
        return f

    return add


# ---- The same derivations in SQL, as common table expressions. ----
_names = ", ".join(f"'{n}'" for n in [*SERVICE_IDS, "mysteryservice"])
_bucket = lambda c: "CASE " + " ".join(f"WHEN coalesce({c}, 0) < {b} THEN {i}" for i, b in enumerate(LATENCY_BOUNDS_US)) + " ELSE 7 END"
_svc = lambda c: "CASE " + " ".join(f"WHEN {c} = '{n}' THEN {i}" for n, i in SERVICE_IDS.items()) + f" ELSE {UNKNOWN_SERVICE_ID} END"


def _col(key: str, seed: str) -> str:
    h = f"(((((({key}) >> 16) * {seed}) & 65535) * 65536 + (({key}) & 65535) * {seed}) & 4294967295)"
    return f"CAST(xor({h} >> 16, {h} & 65535) % 512 AS INT)"


_u = lambda parts: f"(CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8)) AS BIGINT) / 4294967296.0)"
_sum4 = lambda a, b: " + ".join(f"{a}{i} * {b}{i}" for i in range(4))


def _solve(rows: str, name: str, keep: str) -> str:
    """Factors of an arm table (a.., b..) as a chain of tables ending in name."""
    steps = [
        "sqrt(a00) AS l00",
        "a01 / l00 AS l10, a02 / l00 AS l20, a03 / l00 AS l30",
        "sqrt(a11 - l10 * l10) AS l11",
        "(a12 - l20 * l10) / l11 AS l21, (a13 - l30 * l10) / l11 AS l31",
        "sqrt(a22 - l20 * l20 - l21 * l21) AS l22",
        "(a23 - l30 * l20 - l31 * l21) / l22 AS l32",
        "sqrt(a33 - l30 * l30 - l31 * l31 - l32 * l32) AS l33",
        "b0 / l00 AS w0",
        "(b1 - l10 * w0) / l11 AS w1",
        "(b2 - l20 * w0 - l21 * w1) / l22 AS w2",
        "(b3 - l30 * w0 - l31 * w1 - l32 * w2) / l33 AS w3",
    ]
    out = rows
    for s in steps:
        out = f"(SELECT *, {s} FROM {out})"
    return f"{name} AS (SELECT {keep} FROM {out})"


def _ucb(rows: str, alpha: float = 1.0) -> str:
    steps = ["x0 / l00 AS z0", "(x1 - l10 * z0) / l11 AS z1", "(x2 - l20 * z0 - l21 * z1) / l22 AS z2", "(x3 - l30 * z0 - l31 * z1 - l32 * z2) / l33 AS z3"]
    out = rows
    for s in steps:
        out = f"(SELECT *, {s} FROM {out})"
    return f"(SELECT *, {_sum4('z', 'w')} + {alpha} * sqrt({_sum4('z', 'z')}) AS ucb FROM {out})"


_sums = ", ".join([f"sum(x{i} * x{j}) AS s{i}{j}" for i, j in B.PAIRS] + [f"sum(reward * x{i}) AS t{i}" for i in range(4)] + ["count(*) AS n", "sum(reward) AS good", "sum(1 - reward) AS bad"])
_state = ", ".join([f"coalesce(s{i}{j}, 0) + {int(i == j)} AS a{i}{j}" for i, j in B.PAIRS] + [f"coalesce(t{i}, 0) AS b{i}" for i in range(4)] + ["CAST(coalesce(n, 0) AS BIGINT) AS n", "1 + coalesce(good, 0) AS alpha", "1 + coalesce(bad, 0) AS beta"])
_factors = ", ".join(B.FACTORS)
_prior = ", ".join(f"coalesce({f}, {1.0 if f[0] == 'l' and f[1] == f[2] else 0.0}) AS {f}" for f in B.FACTORS)
_ladder = lambda extreme: "CASE WHEN has_error THEN 'error' " + ("WHEN duration_us / 1000.0 > 2000 THEN 'extreme_slow' " if extreme else "") + "WHEN duration_us / 1000.0 > 500 THEN 'very_slow' WHEN duration_us / 1000.0 > 200 THEN 'slow' WHEN num_services >= 4 THEN 'complex' WHEN duration_us / 1000.0 > 50 THEN 'moderate' ELSE 'routine' END"

CTE = [
    f"""raw AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS trace_id, CAST(event_id AS VARCHAR) AS span_id, ([{_names}])[CAST(event_id % 12 AS INT) + 1] AS service_name,
        event_type AS operation_name, CAST(floor(value * value * 10) AS BIGINT) AS duration_us, CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS status_code, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, ts FROM events)""",
    """spans AS (SELECT *, CASE WHEN k % 50 = 0 THEN 503 ELSE 200 END AS http_status, CASE WHEN k % 40 = 1 THEN 5 ELSE 0 END AS grpc_status, CASE WHEN k % 45 = 2 THEN 'ERROR' END AS otel_status, CASE WHEN k % 60 = 3 THEN 'true' END AS error_attribute FROM raw)""",
    f"""feat AS (SELECT *, service_name AS sidecar, {_bucket("duration_us")} AS latency_bucket, CASE WHEN status_code = 2 OR length(coalesce(error_attribute, '')) > 0 OR http_status >= 500 THEN 1 ELSE 0 END AS has_error, {_svc("service_name")} AS svc_id,
        (status_code = 2 OR grpc_status > 0 OR coalesce(error_attribute = 'true', false) OR coalesce(otel_status = 'ERROR', false) OR http_status >= 500) AS is_error FROM spans)""",
    """keyed AS (SELECT *, CAST(svc_id * 256 + has_error * 128 + latency_bucket * 16 AS BIGINT) AS packed_key, CAST((latency_bucket * 32 + (svc_id & 7) * 4) & 255 AS INT) AS arm_index FROM feat)""",
    f"""cellmap AS (SELECT sidecar, seq, r.row AS "row", r.col AS col FROM (SELECT sidecar, seq, unnest([{", ".join(f"{{'row': {i}, 'col': {_col('packed_key', str(s))}}}" for i, s in enumerate(SKETCH_SEEDS))}]) AS r FROM keyed))""",
    """cells AS (SELECT sidecar, "row", col, count(*) AS cnt FROM cellmap GROUP BY ALL)""",
    """firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sidecar, trace_id ORDER BY seq) AS place FROM keyed) WHERE place = 1)""",
    """roll AS (SELECT trace_id, max(duration_us) AS duration_us, bool_or(is_error) AS has_error, CAST(sum(CAST(is_error AS INT)) AS BIGINT) AS error_count, count(DISTINCT service_name) AS num_services, count(*) AS num_spans FROM keyed GROUP BY trace_id)""",
    f"""graded AS (SELECT *, CASE reason WHEN 'error' THEN 1.0 WHEN 'extreme_slow' THEN 0.9 WHEN 'very_slow' THEN 0.8 WHEN 'slow' THEN 0.5 WHEN 'complex' THEN 0.4 WHEN 'moderate' THEN 0.2 ELSE 0.0 END AS reward FROM (SELECT *, {_ladder(True)} AS reason FROM roll))""",
    f"""classes AS (SELECT *, CASE class WHEN 'error' THEN 1.0 WHEN 'very_slow' THEN 0.8 WHEN 'slow' THEN 0.5 WHEN 'complex' THEN 0.4 WHEN 'moderate' THEN 0.2 ELSE 0.1 END AS value FROM (SELECT *, {_ladder(False)} AS class FROM roll))""",
    """svcdur AS (SELECT trace_id, service_name, max(duration_us) AS duration_us FROM keyed GROUP BY ALL)""",
    f"""entries AS (SELECT s.trace_id, s.service_name, {_svc("s.service_name")} AS svc_id, {_bucket("s.duration_us")} AS latency_bucket, CAST(g.has_error AS INT) AS has_error, g.reward, g.reason FROM svcdur s JOIN graded g USING (trace_id))""",
    """entered AS (SELECT *, CAST((latency_bucket * 32 + (svc_id & 7) * 4) & 255 AS INT) AS arm_index, latency_bucket / 7.0::DOUBLE AS x0, CAST(has_error AS DOUBLE) AS x1, svc_id / 255.0::DOUBLE AS x2, 0.5::DOUBLE AS x3 FROM entries)""",
    """routedx AS (SELECT *, service_name AS sidecar FROM entered WHERE svc_id < 255)""",
    f"""sums AS (SELECT sidecar, arm_index, {_sums} FROM routedx GROUP BY ALL)""",
    f"""state AS (SELECT sidecar, arm_index, {_state} FROM sums)""",
    _solve("state", "policy", f"sidecar, arm_index, n, alpha, beta, {_factors}"),
    f"""sofar AS (SELECT sidecar, seq, min(n) AS est FROM (SELECT *, count(*) OVER (PARTITION BY sidecar, "row", col ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n
        FROM (SELECT sidecar, seq, r.row AS "row", r.col AS col FROM (SELECT sidecar, seq, unnest([{", ".join(f"{{'row': {i}, 'col': {_col('packed_key', str(s))}}}" for i, s in enumerate(SKETCH_SEEDS))}]) AS r FROM firsts))) GROUP BY ALL)""",
]


# ---- The same derivations as DataFrames. ----
def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.by_sidecar(I.spans_from_events(_table(spark, sf_dir, "events")))
    wide = S.wide_error(F.col("status_code"), F.col("grpc_status"), F.col("error_attribute") == "true", F.col("otel_status"), F.col("http_status"), F.array().cast("array<string>"))
    return rows.withColumn("is_error", wide)


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.features(_spans(spark, sf_dir))


def _trace_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).withColumn("error_tags", F.col("is_error").cast("int"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.arm_entries(_trace_spans(spark, sf_dir))


def _rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.routed(_entries(spark, sf_dir))


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.arm_state(_rewards(spark, sf_dir))


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.classified(T.rollup(_trace_spans(spark, sf_dir)))


def _r(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


def _rs(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# ---- Scalars ----
@query("SELECT latency_bucket, count(*) AS spans, avg(has_error) AS error_rate FROM keyed GROUP BY latency_bucket")
def latency_bucket_hist(spark, d):
    return _keyed(spark, d).groupBy("latency_bucket").agg(F.count(F.lit(1)).alias("spans"), F.avg("has_error").alias("error_rate"))


@query("SELECT span_id, has_error FROM keyed")
def error_flag_narrow(spark, d):
    return _keyed(spark, d).select("span_id", "has_error")


@query("SELECT span_id, is_error FROM keyed")
def error_flag_wide(spark, d):
    return _spans(spark, d).select("span_id", "is_error")


@query("SELECT service_name, svc_id, count(*) AS spans FROM keyed GROUP BY ALL")
def service_dim_lookup(spark, d):
    return _keyed(spark, d).groupBy("service_name", "svc_id").agg(F.count(F.lit(1)).alias("spans"))


_topo = f"""topo AS (SELECT *, CASE WHEN len(p) = 0 THEN 0 ELSE CAST(('0x' || substr(md5(array_to_string(list_transform(p, lambda s: {_svc("s")}), '|')), 1, 4)) AS INT) END AS topo_hash
    FROM (SELECT *, coalesce(list(service_name) OVER (PARTITION BY trace_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS p FROM keyed))"""


def _topology(spark, d):
    return X.features(I.spans_from_events(_table(spark, d, "events"), topology=True))


@query(f"WITH {', '.join([*CTE, _topo])} SELECT span_id, topo_hash FROM topo")
def topo_hash(spark, d):
    return _topology(spark, d).select("span_id", "topo_hash")


@query(f"WITH {', '.join([*CTE, _topo])} SELECT span_id, packed_key + CAST(topo_hash AS BIGINT) * 65536 AS packed_key, CAST(arm_index + (topo_hash >> 14) AS INT) AS arm_index FROM topo")
def packed_key_arm(spark, d):
    return _topology(spark, d).select("span_id", "packed_key", "arm_index")


@query("SELECT span_id, latency_bucket / 7.0::DOUBLE AS x0, CAST(has_error AS DOUBLE) AS x1, svc_id / 255.0::DOUBLE AS x2, 0.5::DOUBLE AS x3 FROM keyed")
def bandit_context(spark, d):
    return X.with_context(_keyed(spark, d)).select("span_id", "x0", "x1", "x2", "x3")


# ---- Sketch ----
@query('SELECT sidecar, seq, CAST("row" AS INT) AS "row", col FROM cellmap')
def cms_hash_cells(spark, d):
    return _keyed(spark, d).select("sidecar", "seq", F.inline(S.sketch_cells(F.col("packed_key"))))


@query('SELECT sidecar, CAST("row" AS INT) AS "row", col, cnt FROM cells')
def cms_build(spark, d):
    return X.build_sketch(_keyed(spark, d))


@query("""SELECT k.sidecar, k.packed_key, min(c.cnt) AS estimate, round(1 / (1 + ln(min(c.cnt) + 1)), 9) AS novelty FROM (SELECT DISTINCT sidecar, packed_key, seq FROM keyed) k JOIN cellmap m ON k.sidecar = m.sidecar AND k.seq = m.seq
    JOIN cells c ON c.sidecar = m.sidecar AND c."row" = m."row" AND c.col = m.col GROUP BY k.sidecar, k.packed_key""")
def cms_estimate_novelty(spark, d):
    keyed = _keyed(spark, d)
    rows = X.estimate(keyed.select("sidecar", "packed_key").distinct(), X.build_sketch(keyed))
    return rows.select("sidecar", "packed_key", "estimate", F.round(S.novelty(F.col("estimate")), 9).alias("novelty"))


@query('SELECT CAST("row" AS INT) AS "row", col, max(cnt) AS cnt FROM cells GROUP BY ALL')
def cms_merge_max(spark, d):
    return X.merge_sketches(X.build_sketch(_keyed(spark, d)), [])


@query('SELECT CAST("row" AS INT) AS "row", col, CAST(sum(cnt) AS BIGINT) AS cnt FROM cells GROUP BY ALL')
def cms_merge_sum(spark, d):
    return X.merge_sketches(X.build_sketch(_keyed(spark, d)), [], "sum")


@query("""SELECT sidecar, CAST("row" AS INT) AS "row", col, list_reduce(list_prepend(0::BIGINT, list_transform(range(first, last + 1), lambda e: coalesce(h[e], 0)::BIGINT)), lambda a, x: CAST(floor((a + x) * 0.9::DOUBLE) AS BIGINT)) AS cnt
    FROM (SELECT sidecar, "row", col, map_from_entries(list((epoch, n))) AS h, min(epoch) AS first FROM (SELECT m.sidecar, m."row", m.col, m.seq // 500 AS epoch, count(*) AS n FROM cellmap m GROUP BY ALL) GROUP BY ALL) JOIN (SELECT sidecar, max(seq // 500) AS last FROM keyed GROUP BY sidecar) USING (sidecar)""")
def cms_decay_epochs(spark, d):
    return X.decayed_sketch(_keyed(spark, d).withColumn("epoch", F.floor(F.col("seq") / 500).cast("long")), 0.9)


# ---- Traces ----
@query("SELECT trace_id, duration_us, has_error, error_count, num_services, num_spans FROM roll")
def trace_rollup(spark, d):
    return T.rollup(_trace_spans(spark, d)).drop("root_service")


@query("SELECT trace_id, reason, CAST(reward AS DOUBLE) AS reward FROM graded")
def trace_reward(spark, d):
    return T.rewarded(T.rollup(_trace_spans(spark, d))).select("trace_id", "reason", "reward")


@query("SELECT trace_id, class, CAST(value AS DOUBLE) AS value FROM classes")
def trace_class_value(spark, d):
    return _classes(spark, d).select("trace_id", "class", "value")


@query("SELECT trace_id, arg_max(service_name, duration_us * 100000000 - seq) AS root_service FROM keyed GROUP BY trace_id")
def trace_root_service(spark, d):
    return T.rollup(_trace_spans(spark, d)).select("trace_id", "root_service")


@query("SELECT trace_id, service_name, duration_us FROM svcdur")
def trace_service_durations(spark, d):
    return T.service_durations(_spans(spark, d))


@query("SELECT trace_id, array_to_string(list_sort(list(DISTINCT service_name)), ',') AS services FROM keyed GROUP BY trace_id")
def trace_services(spark, d):
    return T.trace_services(_spans(spark, d)).select("trace_id", F.array_join("services", ",").alias("services"))


@query("SELECT trace_id, CAST(sum(CAST(is_error AS INT)) AS BIGINT) AS error_count FROM keyed GROUP BY trace_id")
def tag_error_count(spark, d):
    return T.rollup(_trace_spans(spark, d)).select("trace_id", "error_count")


@query("SELECT reason, count(*) AS traces, round(sum(reward), 6)::DOUBLE AS reward FROM graded GROUP BY reason")
def reward_breakdown(spark, d):
    return T.reward_breakdown(T.rewarded(T.rollup(_trace_spans(spark, d)))).select("reason", "traces", *_r("reward"))


@query("SELECT trace_id, service_name, arm_index, x0, x1, x2, x3, CAST(reward AS DOUBLE) AS reward FROM entered")
def arm_entries(spark, d):
    return _entries(spark, d).select("trace_id", "service_name", "arm_index", "x0", "x1", "x2", "x3", "reward")


@query("SELECT trace_id, sidecar, arm_index, CAST(reward AS DOUBLE) AS reward FROM routedx")
def reward_routing_selective(spark, d):
    return _rewards(spark, d).select("trace_id", "sidecar", "arm_index", "reward")


@query("SELECT s.sidecar, count(*) AS rewards, round(sum(e.reward), 6)::DOUBLE AS reward FROM entered e CROSS JOIN (SELECT DISTINCT service_name AS sidecar FROM keyed) s GROUP BY s.sidecar")
def reward_broadcast_all(spark, d):
    # Summed first: every sidecar gets the same entries.
    total = _entries(spark, d).agg(F.count(F.lit(1)).alias("rewards"), F.round(F.sum("reward"), 6).alias("reward"))
    return T.broadcast_to_all(total, _spans(spark, d).select("sidecar").distinct())


@query("""SELECT CASE WHEN event_id % 7 = 0 THEN 'reward outside 0 to 1' WHEN event_id % 11 = 0 THEN 'context is not of 4 numbers' WHEN event_id % 13 = 0 THEN 'missing or not a number' WHEN event_id % 17 = 0 THEN 'not JSON' ELSE 'valid' END AS verdict, count(*) AS n FROM events GROUP BY ALL""")
def reward_validation_split(spark, d):
    e = F.col("event_id")
    body = (
        F.when(e % 7 == 0, F.format_string('{"arm_index": %d, "context": [0.1, 0, 0.2, 0.5], "reward": 1.5}', e % 256))
        .when(e % 11 == 0, F.format_string('{"arm_index": %d, "context": [0.1, 0], "reward": 0.5}', e % 256))
        .when(e % 13 == 0, F.lit('{"arm_index": 3, "reward": 0.5}'))
        .when(e % 17 == 0, F.lit("{arm"))
        .otherwise(F.format_string('{"arm_index": %d, "context": [0.1, 0, 0.2, 0.5], "reward": 0.5}', e % 256))
    )
    good, bad = I.reward_events(_table(spark, d, "events").select(body.alias("body")))
    both = good.select(F.lit("valid").alias("verdict")).unionAll(bad.select(F.col("reason").alias("verdict")))
    return both.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT trace_id, reason FROM graded WHERE trace_id NOT IN (SELECT trace_id FROM keyed WHERE service_name = 'frontend')")
def processed_anti_join(spark, d):
    spans = _trace_spans(spark, d)
    return T.not_processed(T.rewarded(T.rollup(spans)), spans.where("service_name = 'frontend'")).select("trace_id", "reason")


@query("""SELECT trace_id, min(CASE service_name WHEN 'frontend' THEN 0 WHEN 'checkoutservice' THEN 1 ELSE 2 END) AS source FROM keyed WHERE service_name IN ('frontend', 'checkoutservice', 'cartservice') GROUP BY trace_id""")
def trace_union_dedupe(spark, d):
    spans = _spans(spark, d)
    lists = [spans.where(F.col("service_name") == s).select(F.col("trace_id").alias("traceID")).distinct().withColumn("source", F.lit(i)) for i, s in enumerate(("frontend", "checkoutservice", "cartservice"))]
    return I.union_traces(*lists).select(F.col("traceID").alias("trace_id"), "source")


@query("SELECT class, count(*) AS traces, round(sum(value), 6)::DOUBLE AS total_value, count(*) / sum(count(*)) OVER () AS share FROM classes GROUP BY class")
def class_distribution(spark, d):
    return T.class_distribution(_classes(spark, d)).select("class", "traces", *_r("total_value"), "share")


@query("""SELECT count(*) AS traces, CAST(sum(num_spans) AS BIGINT) AS spans, round(avg(num_spans), 6) AS spans_per_trace, round(avg(duration_us / 1000.0), 6) AS avg_duration_ms, round(sum(value), 6)::DOUBLE AS total_value, round(avg(value), 6)::DOUBLE AS avg_value,
    round(avg(CAST(class = 'error' AS INT)), 6) AS error_share, round(avg(CAST(class IN ('very_slow', 'slow') AS INT)), 6) AS slow_share, round(avg(CAST(class = 'routine' AS INT)), 6) AS routine_share FROM classes""")
def baseline_summary(spark, d):
    return T.baseline_summary(_classes(spark, d)).select("traces", "spans", *_r("spans_per_trace", "avg_duration_ms", "total_value", "avg_value", "error_share", "slow_share", "routine_share"))


# ---- Bandit ----
_numbers = [f"a{i}{j}" for i, j in B.PAIRS] + [f"b{i}" for i in range(4)]


@query(f"SELECT sidecar, arm_index, n, {_rs(*_numbers)} FROM state")
def linucb_state(spark, d):
    return _arms(spark, d).select("sidecar", "arm_index", "n", *_r(*_numbers))


_scored = f"scored AS (SELECT k.*, {_prior}, coalesce(p.n, 0) AS n, coalesce(p.alpha, 1) AS alpha, coalesce(p.beta, 1) AS beta FROM (SELECT *, latency_bucket / 7.0::DOUBLE AS x0, CAST(has_error AS DOUBLE) AS x1, svc_id / 255.0::DOUBLE AS x2, 0.5::DOUBLE AS x3 FROM firsts) k LEFT JOIN policy p ON k.sidecar = p.sidecar AND k.arm_index = p.arm_index)"


def _scored_rows(spark, d):
    rows = X.with_context(X.features(D.first_spans(_spans(spark, d))))
    return B.ucb_scores(B.with_policy(rows, _arms(spark, d)))


@query(f"WITH {', '.join([*CTE, _scored])} SELECT span_id, round(ucb, 6) AS ucb FROM {_ucb('scored')}")
def linucb_score(spark, d):
    return _scored_rows(spark, d).select("span_id", *_r("ucb"))


@query(f"WITH {', '.join([*CTE, _scored])} SELECT span_id, n >= 10 AS confident, ucb >= 0.5 AS sampled FROM {_ucb('scored')}")
def linucb_decision(spark, d):
    return _scored_rows(spark, d).select("span_id", (F.col("n") >= 10).alias("confident"), (F.col("ucb") >= 0.5).alias("sampled"))


@query("SELECT sidecar, arm_index, round(alpha, 6)::DOUBLE AS alpha, round(beta, 6)::DOUBLE AS beta, round(alpha / (alpha + beta), 6)::DOUBLE AS mean FROM state")
def thompson_state(spark, d):
    return _arms(spark, d).withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta"))).select("sidecar", "arm_index", *_r("alpha", "beta", "mean"))


@query(f"SELECT span_id, {_u('trace_id, CAST(arm_index AS VARCHAR), ' + chr(39) + '0' + chr(39))} AS draw, {_u('trace_id, CAST(arm_index AS VARCHAR), ' + chr(39) + '0' + chr(39))} >= 0.5 AS sampled FROM firsts")
def thompson_cold_start(spark, d):
    rows = X.features(D.first_spans(_spans(spark, d))).withColumns({"alpha": F.lit(1.0), "beta": F.lit(1.0)})
    return B.thompson_draws(rows, "0", "trace_id", "arm_index").select("span_id", "draw", (F.col("draw") >= 0.5).alias("sampled"))


@query("SELECT sidecar, arm_index, n, n >= 10 AS confident, round(sqrt(b0 * b0 + b1 * b1 + b2 * b2 + b3 * b3), 6) AS b_norm, CAST(floor(alpha + beta - 2 + 1e-9) AS BIGINT) AS observations FROM state")
def arm_stats(spark, d):
    return B.arm_stats(_arms(spark, d)).select("sidecar", "arm_index", "n", "confident", *_r("b_norm"), "observations")


@query("SELECT sidecar, count(*) AS forced FROM firsts WHERE is_error OR has_error = 1 GROUP BY sidecar")
def force_sample_errors(spark, d):
    rows = X.features(D.first_spans(_spans(spark, d)))
    return rows.where("is_error or has_error = 1").groupBy("sidecar").agg(F.count(F.lit(1)).alias("forced"))


# ---- Decisions ----
@query("SELECT sidecar, trace_id, seq, arm_index FROM firsts")
def first_span_verdict(spark, d):
    return X.features(D.first_spans(_spans(spark, d))).select("sidecar", "trace_id", "seq", "arm_index")


_u0 = _u("trace_id, CAST(arm_index AS VARCHAR), '0'")


def _drawn(rows: str, name: str) -> str:
    """rows (alpha, beta, trace_id, arm_index) with u and draw, as a chain of tables ending in name."""
    grid = B.BETA_GRID
    return f"""{name}_u AS (SELECT *, {_u0} AS u FROM {rows}),
    {name}_l AS (SELECT a, b, i, (i + 0.5::DOUBLE) / {grid} AS x, (a - 1) * ln((i + 0.5::DOUBLE) / {grid}) + (b - 1) * ln(1 - (i + 0.5::DOUBLE) / {grid}) AS l FROM (SELECT DISTINCT alpha AS a, beta AS b FROM {name}_u WHERE alpha <> 1 AND beta <> 1), range({grid}) t(i)),
    {name}_m AS (SELECT a, b, i, x, sum(exp(l - top)) OVER (PARTITION BY a, b ORDER BY i) AS mass FROM (SELECT *, max(l) OVER (PARTITION BY a, b) AS top FROM {name}_l)),
    {name}_g AS (SELECT a, b, x AS x1, mass AS m1, coalesce(lag(x) OVER w, 0) AS x0, coalesce(lag(mass) OVER w, 0) AS m0, max(mass) OVER (PARTITION BY a, b) AS whole FROM {name}_m WINDOW w AS (PARTITION BY a, b ORDER BY i)),
    {name}_q AS (SELECT r.sidecar, r.seq, g.x0 + (r.u * g.whole - g.m0) / (g.m1 - g.m0) * (g.x1 - g.x0) AS q FROM {name}_u r JOIN {name}_g g ON r.alpha = g.a AND r.beta = g.b AND r.u * g.whole >= g.m0 AND r.u * g.whole < g.m1),
    {name} AS (SELECT r.*, CASE WHEN alpha = 1 AND beta = 1 THEN u WHEN beta = 1 THEN pow(u, 1 / alpha) WHEN alpha = 1 THEN 1 - pow(1 - u, 1 / beta) ELSE q END AS draw FROM {name}_u r LEFT JOIN {name}_q USING (sidecar, seq))"""


_judged = "*, CASE WHEN is_error OR has_error = 1 THEN 'forced' WHEN n >= 10 THEN 'linucb' ELSE 'thompson' END AS method, CASE WHEN is_error OR has_error = 1 THEN 1.0 WHEN n >= 10 THEN ucb ELSE draw END::DOUBLE AS score"
_frozen = f"""novel AS (SELECT k.sidecar, k.seq, min(c.cnt) AS est FROM firsts k JOIN cellmap m USING (sidecar, seq) JOIN cells c ON c.sidecar = m.sidecar AND c."row" = m."row" AND c.col = m.col GROUP BY ALL),
    ready AS (SELECT k.*, {_prior}, coalesce(p.n, 0) AS n, coalesce(p.alpha, 1)::DOUBLE AS alpha, coalesce(p.beta, 1)::DOUBLE AS beta FROM (SELECT f.*, latency_bucket / 7.0::DOUBLE AS x0, CAST(has_error AS DOUBLE) AS x1, svc_id / 255.0::DOUBLE AS x2, 1 / (1 + ln(v.est + 1)) AS x3 FROM firsts f JOIN novel v USING (sidecar, seq)) k LEFT JOIN policy p ON k.sidecar = p.sidecar AND k.arm_index = p.arm_index),
    {_drawn("ready", "drawn")},
    frozen AS (SELECT *, score >= 0.5 AS sampled FROM (SELECT {_judged} FROM {_ucb("drawn")}))"""


def _decided(spark, d, config=None):
    """What the trained sampler decides: arms and sketch of the whole table, for each trace's first span."""
    keyed = _keyed(spark, d)
    return D.decide(_spans(spark, d), _arms(spark, d), X.build_sketch(keyed), config)


@query(f"WITH {', '.join([*CTE, _frozen])} SELECT span_id, arm_index, method, round(score, 6) AS score, sampled FROM frozen")
def decide_frozen(spark, d):
    return _decided(spark, d).select("span_id", "arm_index", "method", *_r("score"), "sampled")


@query(f"WITH {', '.join([*CTE, _frozen])} SELECT method, count(*) AS decisions, count(*) / sum(count(*)) OVER () AS share FROM frozen GROUP BY method")
def method_mix(spark, d):
    by = _decided(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("decisions"))
    return by.withColumn("share", F.col("decisions") / F.sum("decisions").over(Window.partitionBy()))  # a row a method


@query(f"WITH {', '.join([*CTE, _frozen])} SELECT k.span_id, k.seq = c.seq AS first, c.sampled FROM keyed k JOIN frozen c USING (sidecar, trace_id)")
def verdict_propagation(spark, d):
    return D.verdicts(_spans(spark, d), _decided(spark, d)).select("span_id", "first", "sampled")


@query("SELECT f.span_id, a.est AS estimate, round(1 / (1 + ln(a.est + 1)), 9) AS novelty FROM firsts f JOIN sofar a USING (sidecar, seq)")
def novelty_replay(spark, d):
    rows = X.features(D.first_spans(_spans(spark, d)))
    return X.replayed_novelty(rows, span=SPAN).select("span_id", "estimate", F.round(S.novelty(F.col("estimate")), 9).alias("novelty"))


#: Events of a part of a history in the replays that are cut.
SPAN = 1 << 16


def _timed_rewards(spark, d):
    last = _spans(spark, d).groupBy("trace_id").agg(F.max("seq").alias("seq"))
    return _rewards(spark, d).join(last, "trace_id")


_running = [f"s{i}{j}" for i, j in B.PAIRS] + [f"t{i}" for i in range(4)] + ["n", "good", "bad"]
_summands = [f"x{i} * x{j}" for i, j in B.PAIRS] + [f"reward * x{i}" for i in range(4)] + ["1", "reward", "1 - reward"]
_line = f"""timed AS (SELECT r.*, m.seq FROM routedx r JOIN (SELECT trace_id, max(seq) AS seq FROM keyed GROUP BY trace_id) m USING (trace_id)),
    line AS (SELECT sidecar, arm_index, seq, 1 AS kind, {", ".join(f"CAST({e} AS DOUBLE) AS {n}" for e, n in zip(_summands, _running, strict=True))} FROM timed UNION ALL SELECT sidecar, arm_index, seq, 0, {", ".join("0.0" for _ in _running)} FROM firsts),
    run AS (SELECT sidecar, arm_index, seq, kind, {", ".join(f"sum({n}) OVER w AS {n}" for n in _running)} FROM line WINDOW w AS (PARTITION BY sidecar, arm_index ORDER BY seq, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    moment AS (SELECT sidecar, arm_index, seq, {_state} FROM run WHERE kind = 0)"""


@query(f"WITH {', '.join([*CTE, _line])} SELECT sidecar, arm_index, seq, n, {_rs(*_numbers)}, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM moment")
def bandit_state_replay(spark, d):
    rows = X.features(D.first_spans(_spans(spark, d)))
    # Histories are cut every SPAN events and carried on, as for a period that no task could hold.
    return D.replay_states(rows, _timed_rewards(spark, d), SPAN).select("sidecar", "arm_index", "seq", "n", *_r(*_numbers, "alpha", "beta"))


_replay = [_line, _solve("moment", "asfactors", f"sidecar, arm_index, seq, n, alpha, beta, {_factors}"), "lined AS (SELECT f.*, latency_bucket / 7.0::DOUBLE AS x0, CAST(has_error AS DOUBLE) AS x1, svc_id / 255.0::DOUBLE AS x2, 1 / (1 + ln(a.est + 1)) AS x3 FROM firsts f JOIN sofar a USING (sidecar, seq))", f"replayed AS (SELECT l.*, g.n, g.alpha, g.beta, {', '.join('g.' + f for f in B.FACTORS)} FROM lined l JOIN asfactors g USING (sidecar, arm_index, seq))"]


@query(f"""WITH {", ".join([*CTE, *_replay, "early AS (SELECT * FROM replayed WHERE n < 10)", _drawn("early", "redrawn")])} SELECT span_id, method, round(score, 6) AS score, score >= 0.5 AS sampled FROM (SELECT {_judged} FROM (SELECT r.*, w.draw FROM {_ucb("replayed")} r LEFT JOIN redrawn w USING (sidecar, seq)))""")
def decide_replay(spark, d):
    return D.replay(_spans(spark, d), _timed_rewards(spark, d)).select("span_id", "method", *_r("score"), "sampled")


@query(f"""WITH {", ".join([*CTE, *_replay])} SELECT sidecar, coalesce(min(CASE WHEN n >= 10 THEN nth END), -1) AS first_learned, count(*) AS decisions FROM (SELECT *, row_number() OVER (PARTITION BY sidecar ORDER BY seq) AS nth FROM replayed) GROUP BY sidecar""")
def cold_start_transition(spark, d):
    rows = D.replay_states(X.features(D.first_spans(_spans(spark, d))), _timed_rewards(spark, d))
    numbered = rows.withColumn("place", F.row_number().over(Window.partitionBy("sidecar").orderBy("seq")))
    return numbered.groupBy("sidecar").agg(F.coalesce(F.min(F.when(F.col("n") >= 10, F.col("place"))), F.lit(-1)).cast("long").alias("first_learned"), F.count(F.lit(1)).alias("decisions"))


# CRC-32 (polynomial 3988292384, reflected) of an ASCII text, byte by byte and bit by bit.
_crc = lambda c: f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({c}) + 1), lambda i: ascii(substr({c}, i, 1))::BIGINT)), lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"


@query(f"WITH {', '.join([*CTE, _frozen])} SELECT seq, sidecar, substr(trace_id, 1, 16) AS trace_id, {_crc('trace_id')} AS trace_hash, arm_index, packed_key, method, round(score, 6) AS score, sampled FROM (SELECT * FROM frozen ORDER BY seq DESC LIMIT 50)")
def recent_decisions(spark, d):
    return D.recent(_decided(spark, d), 50).withColumn("score", F.round("score", 6))


@query("SELECT sidecar, seq, greatest(pushed - 100, 0) AS dropped FROM (SELECT sidecar, seq, row_number() OVER (PARTITION BY sidecar ORDER BY seq DESC) AS p, count(*) OVER (PARTITION BY sidecar) AS pushed FROM keyed) WHERE p <= 100")
def bounded_queue_survivors(spark, d):
    return D.queue_survivors(_spans(spark, d), 100).select("sidecar", "seq", "dropped")


# ---- Metrics ----
_m = "metrics AS (SELECT sidecar, count(*) AS total_spans, CAST(sum(CAST(sampled AS INT)) AS BIGINT) AS sampled_spans, CAST(sum(CAST(NOT sampled AS INT)) AS BIGINT) AS dropped_spans, CAST(sum(CAST(method = 'thompson' AS INT)) AS BIGINT) AS thompson_decisions, CAST(sum(CAST(method = 'linucb' AS INT)) AS BIGINT) AS linucb_decisions, CAST(sum(CAST(method = 'forced' AS INT)) AS BIGINT) AS forced_samples FROM frozen GROUP BY sidecar), rw AS (SELECT sidecar, count(*) AS rewards_received, avg(reward)::DOUBLE AS avg_reward FROM routedx GROUP BY sidecar), full_metrics AS (SELECT m.*, sampled_spans / total_spans AS sample_rate, coalesce(rewards_received, 0) AS rewards_received, coalesce(avg_reward, 0) AS avg_reward FROM metrics m LEFT JOIN rw USING (sidecar))"


def _metrics(spark, d):
    return E.sampler_metrics(_decided(spark, d), _arms(spark, d), _rewards(spark, d))


@query(f"WITH {', '.join([*CTE, _frozen, _m])} SELECT f.sidecar, total_spans, sampled_spans, dropped_spans, thompson_decisions, linucb_decisions, forced_samples, sample_rate, rewards_received, round(avg_reward, 6) AS avg_reward, coalesce(a.active_arms, 0) AS active_arms, coalesce(a.confident_arms, 0) AS confident_arms, 8192 AS sketch_memory_bytes, 38912 AS bandit_memory_bytes, 4096 AS thompson_memory_bytes FROM full_metrics f LEFT JOIN (SELECT sidecar, count(*) AS active_arms, CAST(sum(CAST(n >= 10 AS INT)) AS BIGINT) AS confident_arms FROM state GROUP BY sidecar) a USING (sidecar)")
def sampler_metrics(spark, d):
    cols = ["sidecar", "total_spans", "sampled_spans", "dropped_spans", "thompson_decisions", "linucb_decisions", "forced_samples", "sample_rate", "rewards_received"]
    return _metrics(spark, d).select(*cols, *_r("avg_reward"), "active_arms", "confident_arms", "sketch_memory_bytes", "bandit_memory_bytes", "thompson_memory_bytes")


@query(f"WITH {', '.join([*CTE, _frozen])} SELECT k.sidecar, count(*) AS total_spans_in, CAST(sum(CAST(c.sampled AS INT)) AS BIGINT) AS total_spans_out, CAST(sum(CAST(NOT c.sampled AS INT)) AS BIGINT) AS spans_dropped, CAST(sum(CAST(k.seq = c.seq AS INT)) AS BIGINT) AS cache_misses, CAST(sum(CAST(k.seq <> c.seq AS INT)) AS BIGINT) AS cache_hits FROM keyed k JOIN frozen c USING (sidecar, trace_id) GROUP BY k.sidecar")
def service_stats(spark, d):
    return E.service_stats(D.verdicts(_spans(spark, d), _decided(spark, d)))


@query(f"WITH {', '.join([*CTE, _frozen, _m])} SELECT count(*) AS sidecars, count(*) AS alive, CAST(sum(total_spans) AS BIGINT) AS total_spans, CAST(sum(sampled_spans) AS BIGINT) AS sampled_spans, CAST(sum(forced_samples) AS BIGINT) AS forced_samples, CAST(sum(rewards_received) AS BIGINT) AS rewards_received, round(sum(sampled_spans) / sum(total_spans), 9) AS sample_rate, round(sum(rewards_received * avg_reward) / sum(rewards_received), 6) AS avg_reward FROM full_metrics")
def cluster_metrics(spark, d):
    return E.cluster_metrics(_metrics(spark, d)).select("sidecars", "alive", "total_spans", "sampled_spans", "forced_samples", "rewards_received", F.round("sample_rate", 9).alias("sample_rate"), *_r("avg_reward"))


_worth = "CASE WHEN alpha / (alpha + beta) > 0.6 THEN 'high value' WHEN alpha / (alpha + beta) > 0.3 THEN 'moderate value' ELSE 'low value' END"


@query(f"SELECT sidecar, arm_index, n, n >= 10 AS confident, {_worth} AS interpretation FROM state WHERE sidecar = 'frontend' AND n > 0 ORDER BY n DESC, arm_index LIMIT 50")
def active_arms_topk(spark, d):
    return E.active_arms(B.arm_stats(_arms(spark, d).where("sidecar = 'frontend'"))).select("sidecar", "arm_index", "n", "confident", "interpretation")


@query(f"SELECT * EXCLUDE (place) FROM (SELECT sidecar, arm_index, n, n >= 10 AS confident, {_worth} AS interpretation, row_number() OVER (PARTITION BY sidecar ORDER BY n DESC, arm_index) AS place FROM state) WHERE place <= 50")
def arms_by_sidecar(spark, d):
    """The busiest 50 arms of every sidecar."""
    return E.busiest_arms(B.arm_stats(_arms(spark, d))).select("sidecar", "arm_index", "n", "confident", "interpretation")


@query("SELECT sidecar, arm_index, n FROM state")
def arm_listing(spark, d):
    return E.arm_listing(_arms(spark, d)).select("sidecar", "arm_index", "n")


@query("SELECT arm_index, CAST(sum(n) AS BIGINT) AS n, round(sum(alpha) / (sum(alpha) + sum(beta)), 6)::DOUBLE AS thompson_mean, sum(n) >= 10 AS confident FROM state GROUP BY arm_index ORDER BY n DESC, arm_index LIMIT 6")
def merged_arms_topk(spark, d):
    return E.merged_arms(_arms(spark, d)).select("arm_index", "n", *_r("thompson_mean"), "confident")


@query("SELECT arm_index, CAST(sum(n) AS BIGINT) AS n, round(sum(a00) - count(*) + 1, 6) AS a00, round(sum(a12), 6) AS a12, round(sum(b0), 6) AS b0, round(sum(alpha) - count(*) + 1, 6)::DOUBLE AS alpha FROM state GROUP BY arm_index")
def federated_arm_merge(spark, d):
    return B.merge_states(_arms(spark, d), ["arm_index"]).select("arm_index", "n", *_r("a00", "a12", "b0", "alpha"))


_random = f"""own AS (SELECT sum(sampled_spans) / sum(total_spans) AS r FROM metrics),
    sim AS (SELECT c.*, 4 * c.block + k.k AS sim, CAST(('0x' || substr(h, 1 + 8 * k.k, 8)) AS BIGINT) / 4294967296.0::DOUBLE < own.r AS hit FROM (SELECT c.trace_id, c.class, c.value, s.block, md5(concat_ws('|', c.trace_id, CAST(s.block AS VARCHAR), '0')) AS h FROM classes c CROSS JOIN (SELECT unnest(range(50)) AS block) s) c, own, (SELECT unnest(range(4)) AS k) k),
    per AS (SELECT sim, sum(CAST(hit AS INT)) AS n, count(*) AS c, sum(CASE WHEN hit AND class = 'error' THEN 1 ELSE 0 END) / sum(CASE WHEN class = 'error' THEN 1 ELSE 0 END) AS e, sum(CASE WHEN hit AND class IN ('very_slow', 'slow') THEN 1 ELSE 0 END) / sum(CASE WHEN class IN ('very_slow', 'slow') THEN 1 ELSE 0 END) AS s, sum(CASE WHEN hit THEN value ELSE 0 END) / sum(value) AS v FROM sim GROUP BY sim),
    rnd AS (SELECT avg(n) AS avg_sample_count, avg(n / c) AS avg_actual_rate, avg(e) AS avg_error_capture, avg(s) AS avg_slow_capture, avg(v)::DOUBLE AS avg_value_capture FROM per)"""
_rnames = ["avg_sample_count", "avg_actual_rate", "avg_error_capture", "avg_slow_capture", "avg_value_capture"]


def _own_random(spark, d, classes):
    """Random sampling of traces at the sampler's own rate."""
    return E.random_sampling(classes, E.cluster_metrics(_metrics(spark, d)))


@query(f"WITH {', '.join([*CTE, _frozen, _m, _random])} SELECT {_rs(*_rnames)} FROM rnd")
def random_sampling_sim(spark, d):
    return _own_random(spark, d, _classes(spark, d)).select(*_r(*_rnames))


_compared = """kept AS (SELECT * FROM classes WHERE trace_id IN (SELECT trace_id FROM frozen WHERE sampled)), one AS (SELECT avg(CAST(class IN ('very_slow', 'slow') AS INT)) AS slow_rate, avg(value)::DOUBLE AS value_per_trace FROM kept),
    compared AS (SELECT 1.0::DOUBLE AS error_rate, avg_error_capture AS random_error_rate, slow_rate, avg_slow_capture AS random_slow_rate, value_per_trace, avg_value_capture AS random_value_rate, 1 - t.r AS volume_reduction,
    1 + CAST(slow_rate >= avg_slow_capture AS INT) + CAST(value_per_trace >= avg_value_capture AS INT) AS wins FROM one, rnd, own t)"""
_cnames = ["error_rate", "random_error_rate", "slow_rate", "random_slow_rate", "value_per_trace", "random_value_rate", "volume_reduction"]


def _kept_classes(spark, d, classes):
    return classes.join(_decided(spark, d).where("sampled").select("trace_id").distinct(), "trace_id", "left_semi")


@query(f"""WITH {", ".join([*CTE, _frozen, _m, _random, _compared])} SELECT {_rs(*_cnames)}, wins FROM compared""")
def policy_comparison(spark, d):
    classes = _classes(spark, d)
    row = E.compare_policies(_kept_classes(spark, d, classes), E.cluster_metrics(_metrics(spark, d)), _own_random(spark, d, classes))
    return row.select(*_r(*_cnames), "wins")


@query(f"""WITH {", ".join([*CTE, _frozen])}, kept AS (SELECT DISTINCT trace_id, true AS hit FROM frozen WHERE sampled), j AS (SELECT c.*, coalesce(hit, false)::INT AS h FROM classes c LEFT JOIN kept USING (trace_id))
    SELECT round(avg(h), 6) AS trace_rate, round(sum(h * CAST(class = 'error' AS INT)) / sum(CAST(class = 'error' AS INT)), 6) AS error_capture, round(sum(h * CAST(class IN ('slow', 'very_slow') AS INT)) / sum(CAST(class IN ('slow', 'very_slow') AS INT)), 6) AS slow_capture, round(sum(h * value) / sum(value), 6)::DOUBLE AS value_capture FROM j""")
def capture_rates(spark, d):
    return E.capture_rates(_classes(spark, d), _decided(spark, d).where("sampled")).select(*_r("trace_rate", "error_capture", "slow_capture", "value_capture"))


@query("""SELECT arm_index, count(*) AS sidecars, round(avg(m), 6)::DOUBLE AS mean, round(stddev_pop(m), 6) AS spread, stddev_pop(m) < 0.05 AS similar, avg(m) <> 0 AND greatest(max(m) - avg(m), avg(m) - min(m)) < 0.05 AS converged FROM (SELECT arm_index, (alpha / (alpha + beta))::DOUBLE AS m FROM state) GROUP BY arm_index HAVING count(*) > 1""")
def arm_convergence(spark, d):
    return E.arm_convergence(B.arm_stats(_arms(spark, d))).select("arm_index", "sidecars", *_r("mean", "spread"), "similar", "converged")


_agreed = """agreed AS (SELECT count(*) AS shared, CAST(coalesce(sum(CAST(ok AS INT)), 0) AS BIGINT) AS converged FROM (SELECT avg(m) <> 0 AND greatest(max(m) - avg(m), avg(m) - min(m)) < 0.05 AS ok FROM (SELECT arm_index, (alpha / (alpha + beta))::DOUBLE AS m FROM state) GROUP BY arm_index HAVING count(*) > 1))"""


@query(f"WITH {', '.join([*CTE, _agreed])} SELECT shared, converged, CASE WHEN converged = shared THEN 'all' WHEN converged > shared * 0.7 THEN 'most' ELSE 'few' END AS verdict FROM agreed")
def convergence_verdict(spark, d):
    return E.convergence_verdict(E.arm_convergence(B.arm_stats(_arms(spark, d))))


@query("""SELECT service_name, count(*) AS n, round(avg(duration_us), 6) AS mean, min(duration_us) AS min, max(duration_us) AS max, list_sort(list(duration_us))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS p50, list_sort(list(duration_us))[CAST(floor(count(*) * 0.95::DOUBLE) AS INT) + 1] AS p95, list_sort(list(duration_us))[CAST(floor(count(*) * 0.99::DOUBLE) AS INT) + 1] AS p99, CASE WHEN p50 < 5000 THEN 'excellent' WHEN p50 < 10000 THEN 'good' ELSE 'high' END AS grade FROM spans GROUP BY service_name""")
def latency_percentiles(spark, d):
    return E.latency_stats(_spans(spark, d), "duration_us", "service_name").select("service_name", "n", *_r("mean"), "min", "max", "p50", "p95", "p99", "grade")


# ---- Windows of event time ----
@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS spans, CAST(sum(CAST(is_error AS INT)) AS BIGINT) AS errors FROM keyed GROUP BY ALL")
def span_windows_tumbling(spark, d):
    return W.windowed(_spans(spark, d), "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "spans", "errors")


@query("SELECT start, count(*) AS spans, CAST(sum(CAST(is_error AS INT)) AS BIGINT) AS errors FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, is_error FROM keyed) GROUP BY ALL")
def span_windows_sliding(spark, d):
    return W.windowed(_spans(spark, d), "1 hour", "30 minutes").select(F.col("start").cast("timestamp_ntz").alias("start"), "spans", "errors")


@query("""SELECT trace_id, min(ts) AS start, count(*) AS spans FROM (SELECT *, sum(CASE WHEN prior IS NULL OR ts >= prior + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY trace_id ORDER BY ts, seq) AS prior FROM keyed)) GROUP BY trace_id, session""")
def span_sessions(spark, d):
    return W.sessions(_spans(spark, d), "30 minutes").select("trace_id", F.col("start").cast("timestamp_ntz").alias("start"), "spans")


# ---- Draws from general priors, the report ----
_given = f"given AS (SELECT k.*, coalesce(p.alpha, 1)::DOUBLE AS alpha, coalesce(p.beta, 1)::DOUBLE AS beta FROM firsts k LEFT JOIN policy p ON k.sidecar = p.sidecar AND k.arm_index = p.arm_index)"


@query(f"WITH {', '.join([*CTE, _given, _drawn('given', 'thrown')])} SELECT span_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta, u, round(draw, 6) AS draw FROM thrown")
def thompson_general(spark, d):
    arms = _arms(spark, d)
    rows = B.with_policy(X.with_context(X.features(D.first_spans(_spans(spark, d)))), arms)
    return B.general_draws(rows, "0", "trace_id", "arm_index").select("span_id", *_r("alpha", "beta"), "u", *_r("draw"))


_long = lambda section, table, names, key=None: " UNION ALL ".join(f"SELECT '{section}' AS section, {f'concat({key}, {chr(39)}.{n}{chr(39)})' if key else chr(39) + n + chr(39)} AS metric, round(CAST({n} AS DOUBLE), 6) AS value FROM {table}" for n in names)
_counts = ["total_spans", "sampled_spans", "dropped_spans", "thompson_decisions", "linucb_decisions", "forced_samples", "rewards_received"]
_whole = f"""whole AS (SELECT *, sampled_spans / total_spans AS sample_rate, reward_sum / rewards_received AS avg_reward FROM (SELECT count(*) AS sidecars, count(*) AS alive, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _counts)}, sum(rewards_received * avg_reward) AS reward_sum FROM full_metrics)),
    spread AS (SELECT class, count(*) AS traces, sum(value) AS total_value, count(*) / sum(count(*)) OVER () AS share FROM classes GROUP BY class),
    busy AS (SELECT arm_index, CAST(sum(n) AS BIGINT) AS n, sum(alpha) / (sum(alpha) + sum(beta)) AS thompson_mean, sum(n) >= 10 AS confident FROM state GROUP BY arm_index ORDER BY n DESC, arm_index LIMIT {E.REPORT_ARMS}),
    shown AS (SELECT f.*, coalesce(a.active_arms, 0) AS active_arms, coalesce(a.confident_arms, 0) AS confident_arms, 8192 AS sketch_memory_bytes, 38912 AS bandit_memory_bytes, 4096 AS thompson_memory_bytes FROM full_metrics f LEFT JOIN (SELECT sidecar, count(*) AS active_arms, sum(CAST(n >= 10 AS INT)) AS confident_arms FROM state GROUP BY sidecar) a USING (sidecar))"""
_reported = " UNION ALL ".join([
    _long("cluster", "whole", ["sidecars", "alive", *_counts, "sample_rate", "avg_reward"]), _long("classes", "spread", ["traces", "total_value", "share"], "class"), _long("comparison", "(SELECT *, wins >= 2 AS outperforms FROM compared)", [*_cnames, "wins", "outperforms"]),
    _long("arms", "busy", ["n", "thompson_mean", "confident"], "arm_index"), _long("convergence", "agreed", ["shared", "converged"]), _long("sidecars", "shown", ["total_spans", "sampled_spans", "dropped_spans", "thompson_decisions", "linucb_decisions", "forced_samples", "sample_rate", "rewards_received", "avg_reward", "active_arms", "confident_arms", "sketch_memory_bytes", "bandit_memory_bytes", "thompson_memory_bytes"], "sidecar"),
])


@query(f"WITH {', '.join([*CTE, _frozen, _m, _random, _compared, _agreed, _whole])} {_reported}")
def evaluation_report(spark, d):
    classes, snapshots = _classes(spark, d), _metrics(spark, d)
    metrics = E.cluster_metrics(snapshots)
    compared = E.compare_policies(_kept_classes(spark, d, classes), metrics, E.random_sampling(classes, metrics))
    return E.report(metrics, T.class_distribution(classes), compared, _arms(spark, d), snapshots).withColumn("value", F.round("value", 6))


# ---- Wire requests and stored traces, built from the events and read back ----
def _pair(key: str, **value) -> Column:
    kinds = {"string_value": "string", "int_value": "long", "bool_value": "boolean", "double_value": "double"}
    return F.struct(F.lit(key).alias("key"), F.struct(*[value.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]).alias("value"))


def _requests(spark, d):
    """One export request for each event; every 23rd names no service, odd ones were retried, every 17th threw."""
    seq = F.col("seq")
    own = F.filter(F.array(_pair("service.name", string_value=F.col("service_name"))), lambda x: F.col("seq") % 23 != 0)
    attributes = F.array(
        _pair("http.status_code", int_value=F.col("http_status")), _pair("rpc.grpc.status_code", int_value=F.col("grpc_status")), _pair("otel.status_code", string_value=F.col("otel_status")),
        _pair("error", string_value=F.col("error_attribute")), _pair("retries", int_value=seq % 2),
    )
    events = F.filter(F.array(F.struct(F.lit("Some Exception").alias("name"))), lambda x: F.col("seq") % 17 == 0)
    start = seq.cast("long") * 1_000_000
    span = F.struct(
        F.upper("trace_id").alias("trace_id"), "span_id", F.col("operation_name").alias("name"), start.alias("start_time_unix_nano"), (start + F.col("duration_us") * 1000).alias("end_time_unix_nano"),
        F.struct(F.col("status_code").alias("code")).alias("status"), attributes.alias("attributes"), events.alias("events"),
    )
    scope = F.struct(F.struct(F.lit("maker").alias("name"), F.lit("1").alias("version")).alias("scope"), F.array(span).alias("spans"))
    return _spans(spark, d).select(F.array(F.struct(F.struct(own.alias("attributes")).alias("resource"), F.array(scope).alias("scope_spans"))).alias("resource_spans"))


_sent = "CAST(1 + CAST(grpc_status > 0 AS INT) + CAST(otel_status IS NOT NULL AS INT) + CAST(error_attribute IS NOT NULL AS INT) + seq % 2 AS INT)"


@query(f"SELECT trace_id, span_id, CASE WHEN seq % 23 = 0 THEN 'unknown' ELSE service_name END AS service_name, operation_name, duration_us, status_code, http_status, grpc_status, otel_status, error_attribute, {_sent} AS attributes, seq % 17 = 0 AS threw FROM spans")
def request_spans(spark, d):
    rows = I.flatten_requests(_requests(spark, d))
    return rows.select("trace_id", "span_id", "service_name", "operation_name", "duration_us", "status_code", "http_status", "grpc_status", "otel_status", "error_attribute", F.size("attributes").alias("attributes"), S.exception_event(F.col("event_names")).alias("threw"))


@query("SELECT span_id, 5 AS attributes, CAST(seq % 2 AS VARCHAR) AS retries FROM spans")
def request_spans_whole(spark, d):
    """The other way of reading requests, which keeps zero and empty attributes."""
    rows = I.flatten_requests(_requests(spark, d), keep_falsy=True)
    return rows.select("span_id", F.size("attributes").alias("attributes"), F.try_element_at("attributes", F.lit("retries")).alias("retries"))


def _stored(spark, d):
    """The events as a store gives traces: tags typed as JSON types them, services by process."""
    rows = _spans(spark, d).withColumn("us", F.unix_micros("ts"))
    tag = lambda key, text: F.struct(F.lit(key).alias("key"), F.parse_json(text).alias("value"))
    error = F.when(F.col("error_attribute").isNotNull(), "true").when(F.col("seq") % 5 == 0, '"true"').otherwise("false")
    otel = F.when(F.col("otel_status") == "ERROR", '"ERROR"').when(F.col("seq") % 7 == 0, '"OK"').otherwise("1")
    tags = F.array(tag("http.status_code", F.when(F.col("seq") % 3 == 0, F.concat(F.lit('"'), F.col("http_status"), F.lit('"'))).otherwise(F.col("http_status").cast("string"))), tag("error", error), tag("otel.status_code", otel))
    span = F.struct(F.col("span_id").alias("spanID"), F.col("operation_name").alias("operationName"), F.col("us").alias("startTime"), F.col("duration_us").alias("duration"), F.concat(F.lit("p-"), "service_name").alias("processID"), tags.alias("tags"))
    process = F.struct(F.concat(F.lit("p-"), "service_name").alias("id"), F.struct(F.col("service_name").alias("serviceName")).alias("process"))
    return rows.groupBy("trace_id").agg(F.collect_list(span).alias("spans"), F.map_from_entries(F.collect_set(process)).alias("processes")).withColumnRenamed("trace_id", "traceID")


@query("SELECT trace_id, service_name, count(*) AS spans, CAST(sum(CAST(http_status >= 500 AND seq % 3 <> 0 AS INT) + CAST(error_attribute IS NOT NULL AS INT) + CAST(otel_status IS NOT NULL AS INT)) AS BIGINT) AS error_tags, max(duration_us) AS longest FROM spans GROUP BY trace_id, service_name")
def stored_trace_errors(spark, d):
    rows = I.flatten_traces(_stored(spark, d))
    return rows.groupBy("trace_id", "service_name").agg(F.count(F.lit(1)).alias("spans"), F.sum("error_tags").cast("long").alias("error_tags"), F.max("duration_us").alias("longest"))


@query("SELECT trace_id FROM spans GROUP BY trace_id HAVING bool_or(service_name = 'frontend') AND max(ts) >= TIMESTAMP '2024-01-01' ORDER BY max(ts) DESC, trace_id LIMIT 20")
def fetched_traces(spark, d):
    return I.fetch_traces(_stored(spark, d), "frontend", 20, 1_704_067_200_000_000).select(F.col("traceID").alias("trace_id"))


@query("SELECT DISTINCT service_name AS service FROM spans")
def service_list(spark, d):
    return I.services_of(_stored(spark, d))


# ---- Volume ----
@query(f"""SELECT service_name, {_bucket("duration_us")} AS latency_bucket, count(*) AS spans, CAST(sum(err) AS BIGINT) AS errors FROM (SELECT ([{_names}])[CAST(l_suppkey % 12 AS INT) + 1] AS service_name, CAST(floor(l_extendedprice * l_quantity * 0.1::DOUBLE) AS BIGINT) AS duration_us, CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 1 ELSE 0 END AS err FROM lineitem) GROUP BY ALL""")
def lineitem_features(spark, d):
    return X.features(I.spans_from_lineitem(_table(spark, d, "lineitem"))).groupBy("service_name", "latency_bucket").agg(F.count(F.lit(1)).alias("spans"), F.sum("has_error").alias("errors"))
