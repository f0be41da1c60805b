"""Telemetry payloads (OTLP JSON) flattened to rows: spans, metric points and log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The fields of the public OTLP JSON format that are read. Numbers may come as text.
VALUE = "struct<stringValue:string,intValue:string,doubleValue:string,boolValue:string,arrayValue:string,kvlistValue:string>"
ATTRIBUTES = f"array<struct<key:string,value:{VALUE}>>"
RESOURCE = f"resource:struct<attributes:{ATTRIBUTES}>,"
SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{ATTRIBUTES},status:struct<code:string,message:string>>"
RECORD = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{VALUE},attributes:{ATTRIBUTES},traceId:string,spanId:string>"
POINT = f"struct<timeUnixNano:string,asDouble:string,asInt:string,attributes:{ATTRIBUTES},sum:double,count:string,bucketCounts:array<string>,explicitBounds:array<double>>"
METRIC = f"struct<name:string,gauge:struct<dataPoints:array<{POINT}>>,sum:struct<dataPoints:array<{POINT}>,aggregationTemporality:int,isMonotonic:boolean>,histogram:struct<dataPoints:array<{POINT}>,aggregationTemporality:int>>"
# The least severity number of each level.
LEVELS = ((21, "fatal"), (17, "error"), (13, "warn"), (9, "info"), (5, "debug"), (1, "trace"))


def attribute_text(value: Column) -> Column:
    """An attribute as text: strings, numbers and booleans as they are, nested ones as JSON, no value as null."""
    return F.coalesce(*(value[k] for k in ("stringValue", "intValue", "doubleValue", "boolValue", "arrayValue", "kvlistValue")))


def attribute_map(attributes: Column) -> Column:
    """Attributes as a map; the last of equal keys stays, those without a value go."""
    set_ = F.filter(attributes, lambda a: a["key"].isNotNull() & attribute_text(a["value"]).isNotNull())
    keys = F.array_distinct(F.transform(set_, lambda a: a["key"]))
    of_key = F.transform(keys, lambda k: attribute_text(F.element_at(F.filter(set_, lambda a: a["key"] == k), -1)["value"]))
    return F.coalesce(F.map_from_arrays(keys, of_key), F.create_map().cast("map<string,string>"))


def level(text: Column, number: Column) -> Column:
    """Lower-case severity text if there is one, else the band of the number; none and zero are info."""
    band = F.when(number >= LEVELS[0][0], LEVELS[0][1])
    for least, name in LEVELS[1:]:
        band = band.when(number >= least, name)
    return F.coalesce(F.nullif(F.lower(F.trim(text)), F.lit("")), band, F.lit("info"))


def _items(payloads: DataFrame, payload: str, group: str, scopes: str, items: str, kind: str, received_ms: Column | None = None) -> DataFrame:
    """A row per item: resource attributes, scope name, receipt and the item. Payloads that are not JSON give no row."""
    scope = f"array<struct<scope:struct<name:string>,{items}:array<{kind}>>>"
    received = F.lit(None).cast("long") if received_ms is None else received_ms
    parsed = payloads.select(received.alias("received_ms"), F.from_json(payload, f"struct<{group}:array<struct<{RESOURCE}{scopes}:{scope}>>>").alias("p"))
    by_resource = parsed.select("received_ms", F.explode(f"p.{group}").alias("r")).select("received_ms", attribute_map(F.col("r.resource.attributes")).alias("resource"), F.explode(f"r.{scopes}").alias("s"))
    return by_resource.select("received_ms", "resource", F.col("s.scope.name").alias("scope"), F.explode(f"s.{items}").alias("item")).withColumn("service", F.coalesce(F.col("resource")["service.name"], F.lit("")))


def _ms(nanos: str) -> Column:
    return F.floor(F.col(nanos).cast("decimal(20,0)") / 1_000_000).cast("long")


def spans(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Spans of trace payloads; those without both ids are left out. No parent is null; status code 2 is an error."""
    rows = _items(payloads, payload, "resourceSpans", "scopeSpans", "spans", SPAN).filter("item.traceId <> '' and item.spanId <> ''")
    start, end = _ms("item.startTimeUnixNano"), _ms("item.endTimeUnixNano")
    return rows.select(
        F.col("item.traceId").alias("trace_id"), F.col("item.spanId").alias("span_id"), F.nullif("item.parentSpanId", F.lit("")).alias("parent_span_id"), "service", F.col("item.name").alias("operation"), "scope",
        start.alias("start_ms"), end.alias("end_ms"), (end - start).alias("duration_ms"), F.coalesce(F.col("item.status.code").isin("2", "STATUS_CODE_ERROR"), F.lit(False)).alias("is_error"),
        attribute_map(F.col("item.attributes")).alias("attributes"), "resource",
    )


def log_records(payloads: DataFrame, received_ms: Column, payload: str = "payload") -> DataFrame:
    """Log records; their time is the event's, else when it was observed, else received_ms of the payload."""
    rows = _items(payloads, payload, "resourceLogs", "scopeLogs", "logRecords", RECORD, received_ms)
    at = F.coalesce(F.nullif(_ms("item.timeUnixNano"), F.lit(0).cast("long")), F.nullif(_ms("item.observedTimeUnixNano"), F.lit(0).cast("long")), F.col("received_ms"))
    return rows.select(
        at.alias("ts_ms"), level(F.col("item.severityText"), F.col("item.severityNumber")).alias("level"), F.coalesce(attribute_text(F.col("item.body")), F.lit("")).alias("message"), "service",
        F.col("item.traceId").alias("trace_id"), F.col("item.spanId").alias("span_id"), attribute_map(F.col("item.attributes")).alias("attributes"), "resource",
    )


def metric_points(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Points of gauges, sums and histograms with the identity of their stream; other kinds are left out.

    A stream is a resource, scope, name, kind and set of attributes.
    """
    rows = _items(payloads, payload, "resourceMetrics", "scopeMetrics", "metrics", METRIC)
    m = F.col("item")
    kind = F.when(m["gauge"].isNotNull(), "gauge").when(m["sum"].isNotNull(), "sum").when(m["histogram"].isNotNull(), "histogram")
    points = F.coalesce(m["gauge"]["dataPoints"], m["sum"]["dataPoints"], m["histogram"]["dataPoints"])
    temporality = F.coalesce(m["sum"]["aggregationTemporality"], m["histogram"]["aggregationTemporality"])
    flat = rows.select("resource", "scope", "service", m["name"].alias("metric"), kind.alias("kind"), F.coalesce(m["sum"]["isMonotonic"], F.lit(False)).alias("is_monotonic"),
        F.when(temporality == 1, "delta").when(temporality == 2, "cumulative").alias("temporality"), F.explode(points).alias("p")).withColumn("attributes", attribute_map(F.col("p.attributes")))

    def ordered(c: str) -> Column:
        return F.to_json(F.array_sort(F.map_entries(c)))

    identity = F.sha2(F.to_json(F.struct(ordered("resource").alias("r"), F.coalesce("scope", F.lit("")).alias("s"), "metric", "kind", ordered("attributes").alias("a"))).cast("binary"), 256)
    return flat.select(
        identity.alias("stream"), "service", "metric", "kind", "is_monotonic", "temporality", F.col("p.timeUnixNano").cast("decimal(20,0)").cast("long").alias("ts_ns"),
        F.coalesce(F.col("p.asDouble").cast("double"), F.col("p.asInt").cast("double")).alias("value"), F.col("p.explicitBounds").alias("bounds"), F.col("p.bucketCounts").cast("array<long>").alias("counts"),
        F.col("p.sum").alias("sum"), F.col("p.count").cast("long").alias("count"), "attributes",
    )


def admitted(points: DataFrame, by: str, limit: int) -> DataFrame:
    """Points of the first `limit` streams of each `by`, in order of their first time."""
    seen = points.groupBy(by, "stream").agg(F.min("ts_ns").alias("first_ns"))
    first = seen.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("first_ns", "stream"))).filter(F.col("n") <= limit)
    return points.join(first.select(by, "stream"), [by, "stream"], "left_semi")
