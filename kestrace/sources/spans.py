"""Span sources: wire requests, stored traces, adapters for the test tables, synthetic traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import SERVICE_IDS

KEY_VALUE = "STRUCT<key: STRING, value: STRUCT<string_value: STRING, int_value: BIGINT, bool_value: BOOLEAN, double_value: DOUBLE>>"
#: One export request: resources, scopes, spans.
REQUEST = (
    f"resource_spans ARRAY<STRUCT<resource: STRUCT<attributes: ARRAY<{KEY_VALUE}>>, scope_spans: ARRAY<STRUCT<scope: STRUCT<name: STRING, version: STRING>, "
    f"spans: ARRAY<STRUCT<trace_id: STRING, span_id: STRING, name: STRING, start_time_unix_nano: BIGINT, end_time_unix_nano: BIGINT, status: STRUCT<code: INT>, "
    f"attributes: ARRAY<{KEY_VALUE}>, events: ARRAY<STRUCT<name: STRING>>>>>>>>"
)
#: A stored trace; tag values stay VARIANT, as their JSON type decides what counts as an error.
STORED_TRACE = (
    "traceID STRING, spans ARRAY<STRUCT<spanID: STRING, operationName: STRING, startTime: BIGINT, duration: BIGINT, processID: STRING, "
    "tags: ARRAY<STRUCT<key: STRING, value: VARIANT>>>>, processes MAP<STRING, STRUCT<serviceName: STRING>>"
)


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Export requests as JSON lines, from files or as a stream of files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(REQUEST).json(path)


def _attribute(attributes: Column, key: str) -> Column:
    """The last attribute of that name, as its struct; null without one."""
    return F.try_element_at(F.filter(attributes, lambda a: a["key"] == key), F.lit(-1))["value"]


def _as_text(value: Column) -> Column:
    """The value's set field as text, a false boolean or an empty or zero value as null."""
    number = lambda c: F.when(c != 0, c.cast("string"))
    return F.coalesce(F.when(F.length(value["string_value"]) > 0, value["string_value"]), number(value["int_value"]), F.when(value["bool_value"], F.lit("true")), number(value["double_value"]))


def flatten_requests(requests: DataFrame, keep_falsy: bool = False) -> DataFrame:
    """One row for each span: ids, service, times, status, promoted attributes and the attribute map.

    keep_falsy keeps zero, false and empty attributes in the map.
    """
    resources = requests.select(F.explode("resource_spans").alias("r"))
    name = _as_text(_attribute(F.col("r.resource.attributes"), "service.name"))
    scopes = resources.select(F.coalesce(name, F.lit("unknown")).alias("service_name"), F.explode("r.scope_spans").alias("s"))
    spans = scopes.select("service_name", F.col("s.scope").alias("scope"), F.explode("s.spans").alias("p"))
    a = F.coalesce(F.col("p.attributes"), F.array().cast(f"ARRAY<{KEY_VALUE}>"))
    text = lambda v: F.coalesce(v["string_value"], v["int_value"].cast("string"), v["bool_value"].cast("string"), v["double_value"].cast("string"))
    kept = a if keep_falsy else F.filter(a, lambda x: _as_text(x["value"]).isNotNull())
    last = F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda y: y["key"] == x["key"]))
    took = (F.col("p.end_time_unix_nano") - F.col("p.start_time_unix_nano")) / 1000
    return spans.select(
        F.lower(F.coalesce("p.trace_id", F.lit(""))).alias("trace_id"),
        F.coalesce("p.span_id", F.lit("")).alias("span_id"),
        "service_name",
        F.col("p.name").alias("operation_name"),
        F.greatest(F.floor(took), F.lit(0)).cast("long").alias("duration_us"),
        F.timestamp_micros(F.floor(F.col("p.start_time_unix_nano") / 1000).cast("long")).alias("ts"),
        F.coalesce("p.status.code", F.lit(0)).alias("status_code"),
        _attribute(a, "rpc.grpc.status_code")["int_value"].alias("grpc_status"),
        _attribute(a, "error")["bool_value"].alias("error_flag"),
        _as_text(_attribute(a, "error")).alias("error_attribute"),
        _attribute(a, "otel.status_code")["string_value"].alias("otel_status"),
        _attribute(a, "http.status_code")["int_value"].alias("http_status"),
        F.transform(F.coalesce("p.events", F.array().cast("ARRAY<STRUCT<name: STRING>>")), lambda e: e["name"]).alias("event_names"),
        F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], text(x["value"])))).alias("attributes"),
        F.array().cast("ARRAY<STRING>").alias("parent_services"),
        "scope",
    )


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED_TRACE).json(path)


def fetch_traces(traces: DataFrame, service: str, limit: int, since_us: int | None = None) -> DataFrame:
    """The newest traces that service took part in; limit is part of the request."""
    start = F.array_max(F.transform("spans", lambda s: s["startTime"]))
    found = traces.where(F.exists(F.map_values("processes"), lambda p: p["serviceName"] == service))
    found = found.where(start >= since_us) if since_us is not None else found
    return found.orderBy(start.desc_nulls_last(), "traceID").limit(limit)


def services_of(traces: DataFrame) -> DataFrame:
    return traces.select(F.explode(F.map_values("processes")).alias("p")).select(F.col("p.serviceName").alias("service")).where("service is not null").distinct()


def flatten_traces(traces: DataFrame) -> DataFrame:
    """One row for each span of stored traces, with the number of its error tags, strictly by tag type."""
    rows = traces.select("traceID", F.posexplode_outer("spans").alias("place", "s"), "processes")
    typed = lambda t, kind: F.schema_of_variant(t["value"]) == kind
    wrong = lambda t: (
        ((t["key"] == "error") & typed(t, "BOOLEAN") & F.coalesce(F.try_variant_get(t["value"], "$", "boolean"), F.lit(False)))
        | ((t["key"] == "otel.status_code") & typed(t, "STRING") & F.coalesce(F.try_variant_get(t["value"], "$", "string") == "ERROR", F.lit(False)))
        | ((t["key"] == "http.status_code") & typed(t, "BIGINT") & F.coalesce(F.try_variant_get(t["value"], "$", "bigint") >= 500, F.lit(False)))
    )
    return rows.select(
        F.col("traceID").alias("trace_id"),
        F.col("place").cast("long").alias("seq"),
        F.try_element_at("processes", F.col("s.processID"))["serviceName"].alias("service_name"),
        F.coalesce(F.col("s.duration"), F.lit(0)).alias("duration_us"),
        F.coalesce(F.size(F.filter(F.col("s.tags"), wrong)), F.lit(0)).alias("error_tags"),
        F.col("s").isNotNull().alias("has_span"),
    )


def union_traces(*lists: DataFrame) -> DataFrame:
    """Result lists put together; of each trace id the first in list order stays, empty ids go."""
    tagged = [x.withColumn("arrival", F.lit(i)) for i, x in enumerate(lists)]
    out = tagged[0]
    for x in tagged[1:]:
        out = out.unionByName(x)
    first = Window.partitionBy("traceID").orderBy("arrival")
    return out.where("traceID <> ''").withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "arrival")


def _service(number: Column) -> Column:
    names = F.array(*[F.lit(n) for n in [*SERVICE_IDS, "mysteryservice"]])
    return F.element_at(names, (number % (len(SERVICE_IDS) + 1)).cast("int") + 1)


def spans_from_events(events: DataFrame, topology: bool = False) -> DataFrame:
    """The events table as spans: a trace is a user's day, a service is dealt by event_id.

    topology adds parent_services, the services seen before in the trace.
    """
    code = F.regexp_extract("props", "([0-9]+)", 1).try_cast("int")
    spans = events.select(
        F.col("event_id").alias("seq"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        _service(F.col("event_id")).alias("service_name"),
        F.col("event_type").alias("operation_name"),
        F.floor(F.col("value") * F.col("value") * 10).cast("long").alias("duration_us"),
        F.when(F.col("event_type") == "error", 2).otherwise(0).alias("status_code"),
        F.when(code % 50 == 0, 503).otherwise(200).alias("http_status"),
        F.when(code % 40 == 1, 5).otherwise(0).alias("grpc_status"),
        F.when(code % 45 == 2, "ERROR").alias("otel_status"),
        F.when(code % 60 == 3, "true").alias("error_attribute"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    if not topology:
        return spans.withColumn("parent_services", F.array().cast("ARRAY<STRING>"))
    before = Window.partitionBy("trace_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("parent_services", F.collect_list("service_name").over(before))


def spans_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """The lineitem table as spans, for volume: a trace is an order, a service a supplier modulo the services."""
    return lineitem.select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("seq"),
        F.col("l_orderkey").cast("string").alias("trace_id"),
        _service(F.col("l_suppkey")).alias("service_name"),
        F.floor(F.col("l_extendedprice") * F.col("l_quantity") * 0.1).cast("long").alias("duration_us"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), 2).otherwise(0).alias("status_code"),
        F.lit(200).alias("http_status"),
        F.lit(None).cast("string").alias("error_attribute"),
        F.array().cast("ARRAY<STRING>").alias("parent_services"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )


def synthetic_spans(spark: SparkSession, n: int, mix: dict[str, float] | None = None) -> DataFrame:
    """Traffic of named patterns in given shares: browse, cart, checkout, bad_checkout, currency, slow, empty."""
    shares = mix or {"browse": 0.4, "cart": 0.15, "checkout": 0.15, "bad_checkout": 0.1, "currency": 0.1, "slow": 0.05, "empty": 0.05}
    u = (F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1_000_000)) / 1_000_000).alias("u")
    kind, at = None, 0.0
    for name, share in shares.items():
        at += share / sum(shares.values())
        kind = F.when(F.col("u") < at, name) if kind is None else kind.when(F.col("u") < at, name)
    rows = spark.range(n).withColumn("u", u).withColumn("kind", kind.otherwise(list(shares)[-1]))
    service = {"browse": "frontend", "cart": "cartservice", "checkout": "checkoutservice", "bad_checkout": "paymentservice", "currency": "currencyservice", "slow": "productcatalogservice", "empty": "emailservice"}
    pick = F.create_map(*[F.lit(x) for kv in service.items() for x in kv])
    return rows.select(
        F.col("id").alias("seq"), F.concat(F.lit("t"), (F.col("id") / 4).cast("long").cast("string")).alias("trace_id"), F.col("id").cast("string").alias("span_id"), pick[F.col("kind")].alias("service_name"), F.col("kind").alias("operation_name"),
        F.when(F.col("kind") == "slow", 2_500_000).otherwise(F.lit(1000) + F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(60_000))).cast("long").alias("duration_us"),
        F.when(F.col("kind") == "bad_checkout", 2).otherwise(0).alias("status_code"), F.lit(200).alias("http_status"), F.lit(None).cast("string").alias("error_attribute"),
        F.timestamp_seconds(F.col("id") / 10).alias("ts"), F.array().cast("ARRAY<STRING>").alias("parent_services"),
    )


def make_span(spark: SparkSession, service: str, operation: str, duration_ms: float, has_error: bool = False, n: int = 1) -> DataFrame:
    """n requests of one span each, as read_requests gives them."""
    base = 1_700_000_000_000_000_000
    rows = spark.range(n).select(
        F.array(F.struct(
            F.struct(F.expr(f"array(named_struct('key', 'service.name', 'value', named_struct('string_value', '{service}', 'int_value', cast(null as bigint), 'bool_value', cast(null as boolean), 'double_value', cast(null as double))))").alias("attributes")).alias("resource"),
            F.array(F.struct(
                F.struct(F.lit("maker").alias("name"), F.lit("1").alias("version")).alias("scope"),
                F.array(F.struct(
                    F.lower(F.lpad(F.hex("id"), 32, "0")).alias("trace_id"), F.lower(F.lpad(F.hex("id"), 16, "0")).alias("span_id"), F.lit(operation).alias("name"),
                    F.lit(base).cast("long").alias("start_time_unix_nano"), F.lit(base + int(duration_ms * 1_000_000)).cast("long").alias("end_time_unix_nano"), F.struct(F.lit(2 if has_error else 1).alias("code")).alias("status"),
                    F.expr(f"cast(array() as ARRAY<{KEY_VALUE}>)").alias("attributes"), F.expr("cast(array() as ARRAY<STRUCT<name: STRING>>)").alias("events"),
                )).alias("spans"),
            )).alias("scope_spans"),
        )).alias("resource_spans"))
    return rows


#: Named mixes of traffic; an error burst and a slow spell end, so timed mixes alternate them with the normal one.
MIXES = {
    "normal": {"browse": 0.6, "cart": 0.2, "checkout": 0.1, "currency": 0.1},
    "checkout": {"browse": 0.2, "cart": 0.2, "checkout": 0.6},
    "error_burst": {"bad_checkout": 0.8, "empty": 0.2},
    "slow": {"slow": 0.7, "browse": 0.3},
}


def timed_mix(spark: SparkSession, n: int, phases: list[tuple[str, int]]) -> DataFrame:
    """n spans, ten a second, whose mix follows phases (name of MIXES, seconds) in turn, again and again; phase names each span's."""
    total, at, out = sum(s for _, s in phases), 0, None
    second = F.pmod(F.floor(F.col("seq") / 10), F.lit(total))
    for name, seconds in phases:
        part = synthetic_spans(spark, n, MIXES[name]).where((second >= at) & (second < at + seconds)).withColumn("phase", F.lit(name))
        out, at = part if out is None else out.unionByName(part), at + seconds
    return out


def reward_events(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JSON reward posts (column body) as valid rewards and rejected ones with a reason."""
    parsed = raw.withColumn("j", F.try_parse_json("body"))
    get = lambda path, kind: F.try_variant_get("j", path, kind)
    typed = parsed.select("body", "j", get("$.arm_index", "int").alias("arm_index"), get("$.context", "array<double>").alias("context"), get("$.reward", "double").alias("reward"))
    reason = (
        F.when(F.col("j").isNull(), "not JSON")
        .when(F.col("arm_index").isNull() | F.col("context").isNull() | F.col("reward").isNull(), "missing or not a number")
        .when((F.col("reward") < 0) | (F.col("reward") > 1), "reward outside 0 to 1")
        .when(F.size("context") != 4, "context is not of 4 numbers")
    )
    judged = typed.withColumn("reason", reason)
    good = judged.where("reason is null").select(F.pmod("arm_index", F.lit(256)).alias("arm_index"), "context", "reward")
    return good, judged.where("reason is not null").select("body", "reason")


