"""Per-span expressions: buckets, error flags, keys, sketch cells, novelty. All are code-generated columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..constants import LATENCY_BOUNDS_US, SERVICE_IDS, SKETCH_COLUMNS, SKETCH_SEEDS, UNKNOWN_SERVICE_ID


def latency_bucket(duration_us: Column) -> Column:
    """0 to 7: the first bound that the duration is under, null counting as 0."""
    us = F.coalesce(duration_us, F.lit(0))
    out = F
    for i, bound in enumerate(LATENCY_BOUNDS_US):
        out = out.when(us < bound, F.lit(i))
    return out.otherwise(F.lit(len(LATENCY_BOUNDS_US)))


def service_id(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*SERVICE_IDS.items())])
    return F.coalesce(F.try_element_at(table, name), F.lit(UNKNOWN_SERVICE_ID))


def narrow_error(status_code: Column, error_attribute: Column, http_status: Column) -> Column:
    """0 or 1: error status, an error attribute that is set to something true, or HTTP 500 and over.

    error_attribute is text; any text but the empty one counts ("false" too), a boolean
    attribute false arrives as null. A status that is no number is no error.
    """
    tests = [status_code == 2, F.length(error_attribute) > 0, http_status.try_cast("int") >= 500]
    found = F.lit(False)
    for t in tests:
        found = found | F.coalesce(t, F.lit(False))
    return found.cast("int")


def exception_event(event_names: Column) -> Column:
    return F.coalesce(F.exists(event_names, lambda e: F.lower(e).rlike("exception|error")), F.lit(False))


def wide_error(status_code: Column, grpc_status: Column, error_flag: Column, otel_status: Column, http_status: Column, event_names: Column) -> Column:
    """The ingest test: status, gRPC code, a true boolean, status text, HTTP 500 and over, or an exception event."""
    tests = [status_code == 2, grpc_status > 0, error_flag, otel_status == "ERROR", http_status >= 500]
    out = exception_event(event_names)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def topo_hash(parents: Column, ordered: bool = True) -> Column:
    """16 bits of the md5 of the parents' ids joined by |; 0 without parents.

    ordered=False sorts the ids first, for callers that do not know the order.
    """
    ids = F.transform(parents, lambda s: service_id(s))
    ids = ids if ordered else F.array_sort(ids)
    text = F.concat_ws("|", F.transform(ids, lambda i: i.cast("string")))
    return F.when(F.coalesce(F.size(parents), F.lit(0)) <= 0, 0).otherwise(F.conv(F.substring(F.md5(text.cast("binary")), 1, 4), 16, 10).cast("int"))


def packed_key(bucket: Column, error: Column, svc: Column, topo: Column) -> Column:
    """Bucket 3 bits, error 1, service 8, topology 16, from bit 29 down to 0 with the topology in the high bits."""
    topo, svc, error, bucket = (c.cast("long") for c in (topo, svc, error, bucket))
    return F.shiftleft(topo.bitwiseAND(65535), 16).bitwiseOR(F.shiftleft(svc.bitwiseAND(255), 8)).bitwiseOR(F.shiftleft(error.bitwiseAND(1), 7)).bitwiseOR(F.shiftleft(bucket.bitwiseAND(7), 4))


def arm_index(bucket: Column, svc: Column, topo: Column) -> Column:
    arm = F.shiftleft(bucket, 5).bitwiseOR(F.shiftleft(svc.bitwiseAND(7), 2)).bitwiseOR(F.shiftright(topo, 14))
    return arm.bitwiseAND(255).cast("int")


def bandit_context(bucket: Column, error: Column, svc: Column, novelty: Column) -> list[Column]:
    """x0 to x3; columns rather than an array, so that products and sums stay in generated code."""
    return [(bucket / 7.0).alias("x0"), error.cast("double").alias("x1"), (svc / 255.0).alias("x2"), novelty.cast("double").alias("x3")]


def sketch_column(key: Column, row: int) -> Column:
    """Column of a key in a sketch row: multiply modulo 2^32, fold the halves, modulo the width.

    The product is split, as 32 by 32 bits overflow a signed long.
    """
    k, seed = key.cast("long"), F.lit(SKETCH_SEEDS[row]).cast("long")
    high = (F.shiftright(k, 16) * seed).bitwiseAND(65535) * 65536
    h = (high + k.bitwiseAND(65535) * seed).bitwiseAND(4294967295)
    return (F.shiftright(h, 16).bitwiseXOR(h.bitwiseAND(65535)) % SKETCH_COLUMNS).cast("int")


def sketch_cells(key: Column) -> Column:
    """Array of (row, col): the cells of a key."""
    return F.array(*[F.struct(F.lit(r).alias("row"), sketch_column(key, r).alias("col")) for r in range(len(SKETCH_SEEDS))])


def novelty(estimate: Column) -> Column:
    return 1.0 / (1.0 + F.ln(estimate + F.lit(1.0)))


def seeded_uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: 32 bits of their md5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def span_uptime(seconds: Column) -> Column:
    whole = seconds.cast("long")
    return F.format_string("%dm %ds", (whole / 60).cast("long"), whole % 60)


def text_bar(value: Column, most: Column, width: int = 30) -> Column:
    filled = F.when(most == 0, 0).otherwise(F.floor(width * value / most)).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), width - filled))


def register_sql_functions(spark: SparkSession) -> None:
    """The vocabulary for SQL users, as temporary SQL functions: latency_bucket(us), service_cluster(name)."""
    cases = " ".join(f"WHEN coalesce(us, 0) < {b} THEN {i}" for i, b in enumerate(LATENCY_BOUNDS_US))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION latency_bucket(us BIGINT) RETURNS INT RETURN CASE {cases} ELSE {len(LATENCY_BOUNDS_US)} END")
    names = " ".join(f"WHEN name = '{n}' THEN {i}" for n, i in SERVICE_IDS.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION service_cluster(name STRING) RETURNS INT RETURN CASE {names} ELSE {UNKNOWN_SERVICE_ID} END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION novelty_score(estimate DOUBLE) RETURNS DOUBLE RETURN 1 / (1 + ln(estimate + 1))")
