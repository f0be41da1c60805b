"""Figures over spans: rates, errors and durations, dependencies, funnels and searches. Detectors are in detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import floored_ranks

APDEX_MS = 500


def red(spans: DataFrame, *by: str, apdex_ms: int = APDEX_MS) -> DataFrame:
    """Spans, errors, mean and percentile durations by service (and operation); Apdex counts root spans only."""
    root = F.col("parent_span_id").isNull()
    ms = F.col("duration_ms")
    satisfied, tolerated = F.count_if(root & (ms <= apdex_ms)), F.count_if(root & (ms > apdex_ms) & (ms <= 4 * apdex_ms))
    return spans.groupBy(*by).agg(
        F.count("*").alias("spans"), F.count_if("is_error").alias("errors"), F.avg(ms).alias("avg_ms"),
        *[F.percentile(ms, p / 100).alias(f"p{p}_ms") for p in (50, 95, 99)],
        F.try_divide(satisfied + tolerated / 2, F.count_if(root)).alias("apdex"),
    )


def per_minute(spans: DataFrame, width_ms: int = 60_000) -> DataFrame:
    """Rollup per service, operation and minute."""
    return spans.groupBy("service", "operation", F.expr(f"(start_ms div {width_ms}) * {width_ms}").alias("bucket_ms")).agg(
        F.count("*").alias("spans"), F.count_if("is_error").alias("errors"), F.sum("duration_ms").alias("sum_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms")
    )


def dependencies(spans: DataFrame) -> DataFrame:
    """(caller, callee, calls, errors, avg_ms) over parent and child spans of different services."""
    parent = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("caller"))
    calls = spans.withColumnRenamed("service", "callee").join(parent, ["trace_id", "parent_span_id"]).filter("caller <> callee and caller <> '' and callee <> ''")
    return calls.groupBy("caller", "callee").agg(F.count("*").alias("calls"), F.count_if("is_error").alias("errors"), F.avg("duration_ms").alias("avg_ms"))


def trace_funnel(spans: DataFrame, operations: list[str]) -> DataFrame:
    """(step, operation, traces, conversion_pct, median_gap_ms, p95_gap_ms, of_traces): how far traces get.

    Operations follow each other at strictly later starts, each at its first. The conversion is from the step before
    (100 at the first, 0 without any), gaps are those to the step before, and of_traces counts the traces that have any
    of the operations.
    """
    own = spans.filter(F.col("operation").isin(operations))
    first = F.min(F.when(F.col("operation") == operations[0], F.col("start_ms"))).alias("at")
    state = own.groupBy("trace_id").agg(first).withColumn("depth", F.col("at").isNotNull().cast("int"))
    gaps: list[str] = []
    for i, name in enumerate(operations[1:], 1):
        later = spans.filter(F.col("operation") == name).select(F.col("trace_id").alias("t"), F.col("start_ms").alias("x"))
        met = state.join(later, (F.col("trace_id") == F.col("t")) & (F.col("depth") == i) & (F.col("x") > F.col("at")), "left").groupBy("trace_id", "at", "depth", *gaps).agg(F.min("x").alias("x"))
        state = met.select("trace_id", F.coalesce("x", "at").alias("at"), (F.col("depth") + F.col("x").isNotNull().cast("int")).alias("depth"), *gaps, (F.col("x") - F.col("at")).alias(f"gap{i}"))
        gaps.append(f"gap{i}")
    steps = [F.struct(F.lit(i).alias("step"), F.lit(name).alias("operation"), (F.col(f"gap{i - 1}") if i > 1 else F.lit(None).cast("long")).alias("gap")) for i, name in enumerate(operations, 1)]
    each = state.select("depth", F.explode(F.array(*steps)).alias("s")).select("depth", "s.*")
    counts = each.groupBy("step", "operation").agg(F.count_if(F.col("depth") >= F.col("step")).alias("traces"), F.count("*").alias("of_traces"))
    ranks = floored_ranks(each, ["step"], "gap", {"median_gap_ms": 0.5, "p95_gap_ms": 0.95})
    before = F.lag("traces").over(Window.orderBy("step"))  # a row per step
    conversion = F.when(F.col("step") == 1, F.when(F.col("traces") > 0, 100.0).otherwise(0.0)).otherwise(F.coalesce(F.try_divide(F.col("traces") * 1.0, before) * 100, F.lit(0.0)))
    shown = counts.join(F.broadcast(ranks), "step", "left")  # a row per step
    return shown.select("step", "operation", "traces", conversion.alias("conversion_pct"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("median_gap_ms", "p95_gap_ms")], "of_traces")


def trace(spans: DataFrame, trace_id: Column | int | str) -> DataFrame:
    """The spans of one trace, with their depth order left to the reader: by start and id."""
    return spans.filter(F.col("trace_id") == trace_id).orderBy("start_ms", "span_id")


def minute_percentiles(spans: DataFrame) -> DataFrame:
    """(service, operation, bucket_ms, p50_ms, p95_ms, p99_ms): the value at the floored index of the ordered durations."""
    of = spans.select("service", "operation", (F.expr("start_ms div 60000") * 60000).alias("bucket_ms"), "duration_ms")
    return floored_ranks(of, ["service", "operation", "bucket_ms"], "duration_ms", {f"p{round(q * 100)}_ms": q for q in (0.5, 0.95, 0.99)})


def with_attribute(spans: DataFrame, key: str, op: str, value: str = "") -> DataFrame:
    """Spans whose attribute map meets a test; a missing key never does, not even "neq"."""
    there = F.map_contains_key("attributes", key)
    of = F.col("attributes")[key]
    test = {"exists": F.lit(True), "eq": of == value, "neq": of != value, "contains": F.contains(of, F.lit(value))}[op]
    return spans.filter(there & test)


def traces(spans: DataFrame) -> DataFrame:
    """(trace_id, spans, start_ms, duration_ms, has_error, root_service) per trace; roots are null for orphans."""
    root = F.when(F.col("parent_span_id").isNull(), F.struct("start_ms", "span_id"))
    return spans.groupBy("trace_id").agg(
        F.count("*").alias("spans"), F.min("start_ms").alias("start_ms"), (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"), F.bool_or("is_error").alias("has_error"), F.min_by("service", root).alias("root_service")
    )


def orphans(spans: DataFrame) -> DataFrame:
    """Traces without a root span whose earliest span names a parent that is not there."""
    earliest = spans.groupBy("trace_id").agg(F.min_by("parent_span_id", F.struct("start_ms", "span_id")).alias("parent_span_id"), F.count_if(F.col("parent_span_id").isNull()).alias("roots"))
    known = spans.select("trace_id", F.col("span_id").alias("parent_span_id"))
    return earliest.filter("roots = 0").join(known, ["trace_id", "parent_span_id"], "left_anti").select("trace_id")


def errors_of_traces(spans: DataFrame, errors: DataFrame) -> DataFrame:
    """(trace_id, event_id): errors that name the trace, or name none and fall into its time.

    The second kind meets traces by the minutes they cover, an equi-join that time ranges then refine.
    """
    extent = spans.groupBy("trace_id").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    named = errors.filter("trace_id is not null").join(extent.select("trace_id"), "trace_id").select("trace_id", "event_id")
    minutes = extent.select("trace_id", "a", "b", F.explode(F.sequence(F.expr("a div 60000"), F.expr("b div 60000"))).alias("minute"))
    free = errors.filter("trace_id is null").select("event_id", "ts_ms", F.expr("ts_ms div 60000").alias("minute"))
    return named.unionByName(free.join(minutes, "minute").filter("ts_ms between a and b").select("trace_id", "event_id"))
