"""Named queries of telemetry payloads and of records that change over time, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import records, telemetry
from tidemark.sources import model
from tidemark.sources.model import DAY_MS, SQL_EVENTS, SQL_SPANS

START_MS = 1_704_067_200_000
END_MS = START_MS + 30 * DAY_MS


def _attribute(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias("stringValue")).alias("value"))


def _resource(service: str) -> Column:
    return F.struct(F.array(_attribute("service.name", F.col(service))).alias("attributes")).alias("resource")


def _nanos(ms: Column) -> Column:
    return (ms * 1_000_000).cast("string")


def _scopes(items: str, item: Column, name: str) -> Column:
    return F.array(F.struct(F.struct(F.lit("test").alias("name")).alias("scope"), F.array(item).alias(items))).alias(name)


def otlp_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans packed into a trace payload per order, and flattened again."""
    span = F.struct(
        F.col("trace_id").cast("string").alias("traceId"), F.col("span_id").cast("string").alias("spanId"), F.col("parent_span_id").cast("string").alias("parentSpanId"), F.col("operation").alias("name"),
        _nanos(F.col("start_ms")).alias("startTimeUnixNano"), _nanos(F.col("end_ms")).alias("endTimeUnixNano"), F.array(_attribute("db.statement", F.col("statement"))).alias("attributes"),
        F.struct(F.when(F.col("is_error"), 2).otherwise(0).alias("code")).alias("status"),
    )
    packed = model.spans(spark, sf_dir).groupBy("trace_id").agg(F.collect_list(F.struct(_resource("service"), _scopes("spans", span, "scopeSpans"))).alias("resourceSpans"))
    flat = telemetry.spans(packed.select(F.to_json(F.struct("resourceSpans")).alias("payload")))
    return flat.select("trace_id", "span_id", "parent_span_id", "service", "operation", "start_ms", "duration_ms", "is_error", F.col("attributes")["db.statement"].alias("statement"))


def otlp_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log payload per event, flattened: levels by text, number or neither, times by event, observation or receipt."""
    n, kind = F.col("event_id"), F.col("event_type")
    record = F.struct(
        _nanos(F.when(n % 3 == 0, 0).otherwise(F.col("ts_ms"))).alias("timeUnixNano"), _nanos(F.when(n % 2 == 0, 0).otherwise(F.col("ts_ms") + 1)).alias("observedTimeUnixNano"),
        F.when(kind == "error", 17).when(kind == "click", 8).otherwise(0).alias("severityNumber"), F.when(kind == "signup", "WARN").otherwise("").alias("severityText"),
        F.struct(F.col("pathname").alias("stringValue")).alias("body"), F.array(_attribute("k", F.col("k")), _attribute("k", F.col("k") + 1)).alias("attributes"),
    )
    packed = F.to_json(F.struct(F.array(F.struct(_resource("browser"), _scopes("logRecords", record, "scopeLogs"))).alias("resourceLogs")))
    flat = telemetry.log_records(model.events(spark, sf_dir).select(packed.alias("payload"), (F.col("ts_ms") + 7).alias("received")), F.col("received"))
    return flat.select("ts_ms", "level", "message", "service", F.col("attributes")["k"].alias("k"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct(_nanos(F.col("ts_ms")).alias("timeUnixNano"), F.col("k").cast("string").alias("asInt"), F.array(_attribute("third", F.col("distinct_id").cast("long") % 3)).alias("attributes"))
    metric = F.struct(F.col("event_type").alias("name"), F.struct(F.array(point).alias("dataPoints"), F.lit(1).alias("aggregationTemporality"), F.lit(True).alias("isMonotonic")).alias("sum"))
    packed = F.to_json(F.struct(F.array(F.struct(_resource("browser"), _scopes("metrics", metric, "scopeMetrics"))).alias("resourceMetrics")))
    return telemetry.metric_points(model.events(spark, sf_dir).select(packed.alias("payload")))


def _by_metric(points: DataFrame) -> DataFrame:
    return points.groupBy("metric", "kind", "temporality").agg(F.count_distinct("stream").alias("streams"), F.count("*").alias("points"), F.sum("value").alias("total"))


def otlp_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_metric(_points(spark, sf_dir))


def admitted_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the first four streams of each metric."""
    return _by_metric(telemetry.admitted(_points(spark, sf_dir), "metric", 4))


def issue_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = model.errors(spark, sf_dir)
    decisions = errors.filter("event_id % 20 = 0").select("error_type", "ts_ms", F.when(F.col("event_id") % 40 == 0, "resolved").otherwise("ignored").alias("status"))
    return records.issue_states(errors, decisions, "error_type")


def replay_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = model.events(spark, sf_dir).groupBy(F.col("session_id").alias("replay_id"), "visit_id").agg(
        F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count_if(F.col("event_type") == "pageview").alias("navigations"), F.bool_or(F.col("event_type") == "error").alias("has_error")
    )
    return records.replays(batches)


def survey_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = model.events(spark, sf_dir).withColumn("survey", F.expr("k div 20"))
    return records.survey_stats(seen, "pageview", "purchase").withColumn("rate_pct", F.round("rate_pct", 6))


def survey_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = records.survey_shown(F.col("pathname"), F.col("browser"), F.col("referrer"), F.col("distinct_id"), key="s", prefix="/1", contains="1", on=["Chrome", "Safari"], from_host="t.co")
    return model.events(spark, sf_dir).filter(shown).select("event_id", "pathname")


def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    provenance = F.element_at(F.array(*map(F.lit, ("reported", "estimated", "legacy"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    calls = model.table(spark, sf_dir, "part").select(
        F.col("p_type").alias("model"), provenance.alias("provenance"), F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("tokens_in"),
        (F.col("p_size") * 2).cast("string").alias("tokens_out"), (F.col("p_size") / 4).cast("string").alias("cost"),
    )
    return records.model_usage(calls)


def report_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.digest(model.events(spark, sf_dir), END_MS)


def person_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = model.events(spark, sf_dir).select(F.col("distinct_id").alias("person"), F.col("event_type").alias("key"), F.col("k").alias("value"), (F.col("event_id") % 7 == 0).alias("removed"), "ts_ms", F.col("event_id").alias("id"))
    return records.properties(changes)


def maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type outside three maintenance windows, one of which was moved."""
    rows = [(1, 1, START_MS, START_MS + DAY_MS), (1, 2, START_MS + 2 * DAY_MS, START_MS + 3 * DAY_MS), (2, 1, START_MS + 10 * DAY_MS, START_MS + 12 * DAY_MS)]
    windows = spark.createDataFrame(rows, "window_id int, version int, lo long, hi long")
    return records.outside_windows(model.events(spark, sf_dir), windows, "event_id", "ts_ms", DAY_MS).groupBy("event_type").agg(F.count("*").alias("events"))


QUERIES = {
    f.__name__: f
    for f in (
        otlp_spans, otlp_logs, otlp_metrics, admitted_streams, issue_states, replay_summaries, survey_stats, survey_targets, model_usage, report_digest, person_properties, maintenance,
    )
}
_STREAMS = ", p AS (SELECT event_type AS metric, (event_type, browser, CAST(distinct_id AS BIGINT) % 3) AS stream, ts_ms, k FROM ev)"
_TOTALS = "SELECT metric, 'sum' AS kind, 'delta' AS temporality, count(DISTINCT stream) AS streams, count(*) AS points, CAST(sum(k) AS DOUBLE) AS total FROM p"
_DIGEST = ", ".join(
    f"count(*) FILTER (event_type = 'pageview' AND ts_ms >= {END_MS - d * DAY_MS}) AS pageviews_{d}d, count(DISTINCT session_id) FILTER (ts_ms >= {END_MS - d * DAY_MS}) AS visitors_{d}d, count(*) FILTER (event_type = 'error' AND ts_ms >= {END_MS - d * DAY_MS}) AS errors_{d}d"
    for d in (1, 7)
)
ORACLE_SQL = {
    "otlp_spans": f"WITH {SQL_SPANS} SELECT CAST(trace_id AS VARCHAR) AS trace_id, CAST(span_id AS VARCHAR) AS span_id, CAST(parent_span_id AS VARCHAR) AS parent_span_id, service, operation, start_ms, duration_ms, is_error, statement FROM sp",
    "otlp_logs": f"""WITH {SQL_EVENTS} SELECT CASE WHEN event_id % 3 <> 0 THEN ts_ms WHEN event_id % 2 <> 0 THEN ts_ms + 1 ELSE ts_ms + 7 END AS ts_ms,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'debug' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level, pathname AS message, browser AS service, CAST(k + 1 AS VARCHAR) AS k FROM ev""",
    "otlp_metrics": f"WITH {SQL_EVENTS}{_STREAMS} {_TOTALS} GROUP BY metric",
    "admitted_streams": f"WITH {SQL_EVENTS}{_STREAMS}, f AS (SELECT metric, stream FROM p GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY metric ORDER BY min(ts_ms)) <= 4) {_TOTALS} SEMI JOIN f USING (metric, stream) GROUP BY metric",
    "issue_states": f"""WITH {SQL_EVENTS}, er AS (SELECT event_id, ts_ms, concat('E', k // 20) AS error_type FROM ev WHERE event_type = 'error'),
  d AS (SELECT error_type, max(ts_ms) AS decided_ms, arg_max(CASE WHEN event_id % 40 = 0 THEN 'resolved' ELSE 'ignored' END, ts_ms) AS status FROM er WHERE event_id % 20 = 0 GROUP BY 1),
  i AS (SELECT error_type, count(*) AS events, max(ts_ms) AS last_ms FROM er GROUP BY 1)
SELECT error_type, events, last_ms, CASE WHEN status IS NULL THEN if(events = 1, 'new', 'open') WHEN status = 'resolved' AND last_ms > decided_ms THEN 'regressed' ELSE status END AS state FROM i LEFT JOIN d USING (error_type)""",
    "replay_summaries": f"WITH {SQL_EVENTS} SELECT session_id AS replay_id, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, max(ts_ms) - min(ts_ms) AS duration_ms, count(*) FILTER (event_type = 'pageview') AS pages, bool_or(event_type = 'error') AS has_error FROM ev GROUP BY 1",
    "survey_stats": f"""WITH {SQL_EVENTS}, s AS (SELECT k // 20 AS survey, count(DISTINCT distinct_id) FILTER (event_type = 'pageview') AS shown, count(DISTINCT distinct_id) FILTER (event_type = 'purchase') AS answered,
  count(*) FILTER (event_type = 'purchase') AS answers FROM ev GROUP BY 1) SELECT *, round(coalesce(100.0 * answered / nullif(shown, 0), 0), 6) AS rate_pct FROM s""",
    "survey_targets": f"WITH {SQL_EVENTS} SELECT event_id, pathname FROM ev WHERE starts_with(pathname, '/1') AND browser IN ('Chrome', 'Safari') AND referrer = 'https://t.co/x'",
    "model_usage": """SELECT p_type AS model, (['reported', 'estimated', 'legacy'])[p_partkey % 3 + 1] AS provenance, count(*) AS calls, CAST(sum(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size END) AS DOUBLE) AS tokens_in,
  CAST(sum(p_size * 2) AS DOUBLE) AS tokens_out, CAST(sum(p_size / 4) AS DOUBLE) AS cost FROM part GROUP BY 1, 2""",
    "report_digest": f"WITH {SQL_EVENTS} SELECT {_DIGEST} FROM ev WHERE ts_ms < {END_MS}",
    "person_properties": f"WITH {SQL_EVENTS} SELECT distinct_id AS person, event_type AS key, arg_max(k, (ts_ms, event_id)) AS value FROM ev GROUP BY 1, 2 HAVING arg_max(event_id, (ts_ms, event_id)) % 7 <> 0",
    "maintenance": f"WITH {SQL_EVENTS} SELECT event_type, count(*) AS events FROM ev WHERE NOT (ts_ms BETWEEN {START_MS + 2 * DAY_MS} AND {START_MS + 3 * DAY_MS} OR ts_ms BETWEEN {START_MS + 10 * DAY_MS} AND {START_MS + 12 * DAY_MS}) GROUP BY 1",
}
