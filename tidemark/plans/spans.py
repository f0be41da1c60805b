"""Named queries of the span detectors and of trace funnels, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import detectors, tracing
from tidemark.sources import model
from tidemark.sources.model import SQL_SPANS

_BASE = f"WITH {SQL_SPANS}" + r""", db AS (
  SELECT *, CASE WHEN upper(left(statement, 6)) IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE')
    THEN trim(regexp_replace(regexp_replace(statement, '''(?:\\.|[^''\\])*''|[0-9][0-9.]*', '?', 'g'), '\s+', ' ', 'g')) ELSE '' END AS fp FROM sp WHERE statement <> ''
), sib AS (SELECT * FROM db WHERE parent_span_id IS NOT NULL),
n0 AS (SELECT *, CASE WHEN fp <> '' AND fp = lag(fp) OVER w THEN 0 ELSE 1 END AS new FROM sib WINDOW w AS (PARTITION BY trace_id, parent_span_id ORDER BY start_ms, span_id, end_ms, fp)),
n1 AS (SELECT *, sum(new) OVER (PARTITION BY trace_id, parent_span_id ORDER BY start_ms, span_id, end_ms, fp ROWS UNBOUNDED PRECEDING) AS run FROM n0),
n2 AS (SELECT trace_id, parent_span_id, run, count(*) AS n, any_value(fp) AS fp, arg_min(service, (start_ms, span_id, end_ms)) AS service, min(start_ms) AS first_ms, arg_max(end_ms, (start_ms, span_id, end_ms)) AS last_ms
  FROM n1 WHERE fp <> '' GROUP BY 1, 2, 3 HAVING count(*) >= 2),
n3 AS (SELECT * FROM n2 QUALIFY row_number() OVER (PARTITION BY trace_id, parent_span_id ORDER BY n DESC, run) = 1),
rq AS (SELECT 'n_plus_one_db' AS kind, left(sha1(concat('n_plus_one_db', chr(0), parent_span_id, chr(0), fp)), 16) AS fingerprint, trace_id, 'warning' AS severity, format('N+1 query: {} repeated DB calls', n) AS title,
  concat(service, ' — ', left(fp, 200)) AS description, first_ms, last_ms FROM n3),
s0 AS (SELECT *, CASE WHEN start_ms >= lag(end_ms) OVER w THEN 0 ELSE 1 END AS new FROM sib WINDOW w AS (PARTITION BY trace_id, parent_span_id ORDER BY start_ms, span_id, end_ms, fp)),
s1 AS (SELECT *, sum(new) OVER (PARTITION BY trace_id, parent_span_id ORDER BY start_ms, span_id, end_ms, fp ROWS UNBOUNDED PRECEDING) AS run FROM s0),
s2 AS (SELECT trace_id, parent_span_id, run, count(*) AS n, sum(duration_ms)::BIGINT AS total, string_agg(fp, '|' ORDER BY start_ms, span_id, end_ms, fp) AS fps, arg_min(service, (start_ms, span_id, end_ms)) AS service,
  min(start_ms) AS first_ms, arg_max(end_ms, (start_ms, span_id, end_ms)) AS last_ms FROM s1 GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND sum(duration_ms) >= 100),
s3 AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY trace_id, parent_span_id ORDER BY n DESC, run) = 1),
sq AS (SELECT 'consecutive_db' AS kind, left(sha1(concat('consecutive_db', chr(0), parent_span_id, chr(0), fps)), 16) AS fingerprint, trace_id, 'warning' AS severity, format('{} serial DB queries ({}ms total)', n, total) AS title,
  concat(service, ' — consider parallelizing or batching') AS description, first_ms, last_ms FROM s3),
lq AS (SELECT 'slow_db_query' AS kind, left(sha1(concat('slow_db_query', chr(0), service, chr(0), if(fp = '', operation, fp))), 16) AS fingerprint, trace_id, if(duration_ms >= 900, 'error', 'warning') AS severity,
  format('Slow DB query: {}ms', duration_ms) AS title, concat(service, ' — ', left(if(fp = '', operation, fp), 200)) AS description, start_ms AS first_ms, end_ms AS last_ms FROM db WHERE duration_ms >= 180),
hq AS (SELECT 'slow_http_call' AS kind, left(sha1(concat('slow_http_call', chr(0), service, chr(0), http_url)), 16) AS fingerprint, trace_id, if(duration_ms >= 900, 'error', 'warning') AS severity,
  format('Slow HTTP call: {}ms', duration_ms) AS title, concat(service, ' → ', left(http_url, 200)) AS description, start_ms AS first_ms, end_ms AS last_ms FROM sp WHERE kind = 'client' AND http_url <> '' AND duration_ms >= 180)
"""
_FUNNEL = f"WITH {SQL_SPANS}" + """, s1 AS (SELECT trace_id, min(start_ms) AS a FROM sp WHERE operation = 'op1' GROUP BY 1),
s2 AS (SELECT n.trace_id, min(start_ms) AS a, min(start_ms) - any_value(s1.a) AS gap FROM s1 JOIN sp n ON n.trace_id = s1.trace_id AND n.operation = 'op2' AND n.start_ms > s1.a GROUP BY 1),
s3 AS (SELECT n.trace_id, min(start_ms) AS a, min(start_ms) - any_value(s2.a) AS gap FROM s2 JOIN sp n ON n.trace_id = s2.trace_id AND n.operation = 'op3' AND n.start_ms > s2.a GROUP BY 1),
g AS (SELECT 1 AS step, 'op1' AS operation, count(*) AS traces, NULL::BIGINT[] AS gaps FROM s1 UNION ALL SELECT 2, 'op2', count(*), list_sort(list(gap)) FROM s2 UNION ALL SELECT 3, 'op3', count(*), list_sort(list(gap)) FROM s3)
SELECT step, operation, traces, CASE WHEN step > 1 THEN coalesce(traces / nullif(lag(traces) OVER (ORDER BY step), 0), 0) * 100 WHEN traces > 0 THEN 100 ELSE 0 END AS conversion_pct,
  coalesce(gaps[floor((len(gaps) - 1) * 0.5::DOUBLE)::INT + 1], 0) AS median_gap_ms, coalesce(gaps[floor((len(gaps) - 1) * 0.95::DOUBLE)::INT + 1], 0) AS p95_gap_ms,
  (SELECT count(DISTINCT trace_id) FROM sp WHERE operation IN ('op1', 'op2', 'op3')) AS of_traces FROM g"""


def _of_spans(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(model.spans(spark, sf_dir))


def _issues(sp: DataFrame) -> DataFrame:
    return detectors.performance_issues(detectors.repeated_queries(sp, 2), detectors.serial_queries(sp, 2), detectors.slow_queries(sp, 180), detectors.slow_calls(sp, 180))


QUERIES = {
    "n_plus_one": _of_spans(lambda sp: detectors.repeated_queries(sp, 2)),
    "serial_db": _of_spans(lambda sp: detectors.serial_queries(sp, 2)),
    "slow_spans": _of_spans(lambda sp: detectors.slow_queries(sp, 180)),
    "slow_calls": _of_spans(lambda sp: detectors.slow_calls(sp, 180)),
    "span_issues": _of_spans(_issues),
    "trace_funnel": _of_spans(lambda sp: tracing.trace_funnel(sp, ["op1", "op2", "op3"]).withColumn("conversion_pct", F.round("conversion_pct", 6))),
}
ORACLE_SQL = {
    "n_plus_one": _BASE + "SELECT * FROM rq",
    "serial_db": _BASE + "SELECT * FROM sq",
    "slow_spans": _BASE + "SELECT * FROM lq",
    "slow_calls": _BASE + "SELECT * FROM hq",
    "span_issues": _BASE + """, x AS (SELECT * FROM rq UNION ALL SELECT * FROM sq UNION ALL SELECT * FROM lq UNION ALL SELECT * FROM hq)
SELECT kind, fingerprint, count(*) AS events, min(first_ms) AS first_ms, max(last_ms) AS last_ms, arg_max(severity, if(severity = 'error', 2, 1)) AS severity, arg_min(trace_id, (-last_ms, trace_id, title, description)) AS trace_id,
  arg_min(title, (-last_ms, trace_id, title, description)) AS title, arg_min(description, (-last_ms, trace_id, title, description)) AS description FROM x GROUP BY 1, 2""",
    "trace_funnel": _FUNNEL.replace("END AS conversion_pct", "END AS conversion_raw").replace("SELECT step, operation", "SELECT * EXCLUDE (conversion_raw), round(conversion_raw, 6) AS conversion_pct FROM (SELECT step, operation", 1) + ")",
}
