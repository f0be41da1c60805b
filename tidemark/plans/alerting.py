"""Named queries of alert figures and of rules' states and incidents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import alerts
from tidemark.sources import model
from tidemark.sources.model import DAY_MS, SQL_EVENTS, SQL_SPANS

#: Rule (an event type): operator, threshold, least samples, minutes between notices.
RULES = {"click": ("gt", 50.0, 5, 2880), "error": ("gte", 47.0, 0, 0), "pageview": ("lt", 50.0, 1, 4320), "purchase": ("lte", 49.5, 25, 1440), "signup": ("eq", 50.0, 1, 10)}
_SILENCE = 2 * DAY_MS


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = model.events(spark, sf_dir)
    checks = ev.filter("event_type = 'click'").select((F.col("k") % 9 != 0).alias("is_up"))
    return alerts.figures(ev, model.errors(spark, sf_dir), model.spans(spark, sf_dir), model.logs(spark, sf_dir), checks).withColumn("value", F.round("value", 6))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's mean of k by event type is a value; some evaluations fail, and those of two days in seven are not made."""
    day = F.expr(f"ts_ms div {DAY_MS}")
    daily = model.events(spark, sf_dir).groupBy(F.col("event_type").alias("rule"), day.alias("day")).agg(F.avg("k").alias("value"), F.count("*").alias("samples")).filter("day % 7 not in (3, 4, 5) or rule = 'click'")
    rules = spark.createDataFrame([(r, *x) for r, x in RULES.items()], "rule string, operator string, threshold double, min_samples int, cooldown_min int")
    rows = daily.join(F.broadcast(rules), "rule").select("*", (F.col("day") * DAY_MS).alias("ts_ms")).withColumn("value", F.when(F.col("day") % 11 != 2, F.col("value")))  # five rules
    return alerts.incidents(rows, _SILENCE, 19_800 * DAY_MS).withColumn("value", F.round("value", 6))


QUERIES = {"alert_metrics": _figures, "alert_states": _states}
ORACLE_SQL = {
    "alert_metrics": f"""WITH {SQL_EVENTS}, {SQL_SPANS}, e AS (SELECT count(*) FILTER (event_type = 'pageview') AS views, count(DISTINCT session_id) AS visitors, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n,
  count(*) FILTER (event_type = 'click') AS checks, count(*) FILTER (event_type = 'click' AND k % 9 = 0) AS failures FROM ev),
  s AS (SELECT 100.0 * count(*) FILTER (is_error) / count(*) AS rate, count(*) AS n, quantile_cont(duration_ms, 0.95) FILTER (parent_span_id IS NULL) AS p95, count(*) FILTER (parent_span_id IS NULL) AS roots FROM sp)
SELECT 'pageviews' AS figure, views::DOUBLE AS value, n AS samples FROM e UNION ALL SELECT 'visitors', visitors, n FROM e UNION ALL SELECT 'error_count', errors, n FROM e UNION ALL SELECT 'error_rate', round(100.0 * errors / n, 6), n FROM e
UNION ALL SELECT 'trace_error_rate', round(rate, 6), n FROM s UNION ALL SELECT 'trace_p95_ms', round(p95), roots FROM s UNION ALL SELECT 'log_error_count', errors, n FROM e UNION ALL SELECT 'uptime_failures', failures, checks FROM e""",
    "alert_states": f"""WITH RECURSIVE {SQL_EVENTS}, r(rule, op, threshold, least, cooldown) AS (VALUES {', '.join(f"('{r}', '{o}', {t}, {max(n, 1)}, {c * 60_000})" for r, (o, t, n, c) in RULES.items())}),
  d AS (SELECT event_type AS rule, ts_ms // {DAY_MS} AS day, avg(k) AS value, count(*) AS samples FROM ev GROUP BY 1, 2),
  e AS (SELECT rule, day * {DAY_MS} AS ts_ms, CASE WHEN day % 11 <> 2 THEN value END AS value, samples, op, threshold, least, cooldown FROM d JOIN r USING (rule) WHERE day % 7 NOT IN (3, 4, 5) OR rule = 'click'),
  g AS (SELECT *, lead(ts_ms, 1, {19_800 * DAY_MS}) OVER (PARTITION BY rule ORDER BY ts_ms) AS following FROM e),
  s AS (SELECT rule, ts_ms, value, samples, cooldown, CASE WHEN value IS NULL THEN 'unavailable' WHEN samples < least THEN 'no_data'
      WHEN CASE op WHEN 'gt' THEN value > threshold WHEN 'gte' THEN value >= threshold WHEN 'lt' THEN value < threshold WHEN 'lte' THEN value <= threshold ELSE value = threshold END THEN 'firing' ELSE 'healthy' END AS state FROM e
    UNION ALL SELECT rule, ts_ms + {_SILENCE}, NULL, 0, cooldown, 'unavailable' FROM g WHERE following > ts_ms + {_SILENCE}),
  w AS (SELECT *, coalesce(lag(state) OVER x, '') AS from_state, coalesce(last_value(CASE WHEN state IN ('firing', 'healthy') THEN state END IGNORE NULLS) OVER (PARTITION BY rule ORDER BY ts_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'healthy') AS was
    FROM s WINDOW x AS (PARTITION BY rule ORDER BY ts_ms)),
  i AS (SELECT *, CASE WHEN was = 'firing' OR state = 'firing' THEN last_value(CASE WHEN state = 'firing' AND was = 'healthy' THEN ts_ms END IGNORE NULLS) OVER (PARTITION BY rule ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) END AS incident_ms FROM w),
  k AS (SELECT rule, incident_ms, incident_ms AS ts_ms FROM i WHERE ts_ms = incident_ms AND cooldown > 0
    UNION ALL SELECT rule, incident_ms, ts_ms FROM (SELECT k.rule, k.incident_ms, min(i.ts_ms) AS ts_ms FROM k JOIN i ON i.rule = k.rule AND i.incident_ms = k.incident_ms AND i.state = 'firing' AND i.ts_ms >= k.ts_ms + i.cooldown GROUP BY 1, 2, k.ts_ms))
SELECT i.rule, i.ts_ms, round(value, 6) AS value, samples, from_state, state, i.incident_ms, CASE WHEN state = 'firing' AND was = 'healthy' THEN 'incident_opened' WHEN state = 'healthy' AND was = 'firing' THEN 'incident_recovered' WHEN k.ts_ms IS NOT NULL THEN 'incident_repeat' ELSE '' END AS notice
FROM i LEFT JOIN k ON k.rule = i.rule AND k.ts_ms = i.ts_ms""",
}
