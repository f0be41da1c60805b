"""Named queries of the log query language and of log pipelines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import logquery, logs
from tidemark.sources import model
from tidemark.sources.model import SQL_EVENTS

_LOGS = f"""WITH {SQL_EVENTS}, lg AS (
  SELECT event_id AS log_id, ts_ms, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'WARN' WHEN 'click' THEN 'debug' ELSE 'info' END AS level,
    concat('User ', distinct_id, ' visited ', pathname, ' from 10.0.0.', k) AS message, browser AS service, session_id AS trace_id, concat('s', event_id) AS span_id, k,
    CASE event_type WHEN 'error' THEN k % 5 + 500 WHEN 'click' THEN 200 END AS status, nullif(device, 'desktop') AS env FROM ev)"""

#: Query, and its condition in SQL over lg.
SEARCHES = {
    "log_query_terms": ('level:Warn "visited /1"', "level IN ('Warn', 'warn', 'WARN') AND contains(lower(message), 'visited /1')"),
    "log_query_precedence": ("user OR level:error service:Safari", "contains(lower(message), 'user') OR (level IN ('error', 'ERROR', 'Error') AND service = 'Safari')"),
    "log_query_grouped": ("(level:error OR level:debug) service:Chrome -10.0.0.7", "level IN ('error', 'ERROR', 'Error', 'debug', 'DEBUG', 'Debug') AND service = 'Chrome' AND NOT contains(message, '10.0.0.7')"),
    "log_query_attributes": ("attr.http.status:>=503 attr.k:<40", "coalesce(status >= 503, false) AND k < 40"),
    "log_query_number_spellings": ("attr.http.status:5.02e2", "coalesce(status = 502, false)"),
    "log_query_absent": ("-attr.http.status:>=500", "NOT coalesce(status >= 500, false)"),
    "log_query_not_absent_or": ("NOT (attr.env:mobile OR attr.http.status:200) NOT level:info", "NOT (coalesce(env = 'mobile', false) OR coalesce(status = 200, false)) AND level NOT IN ('info', 'INFO', 'Info')"),
    "log_query_resource": ("resource.env:tablet -NOT level:error", "coalesce(env = 'tablet', false) AND level IN ('error', 'ERROR', 'Error')"),
    "log_query_time": ("timestamp:>=2024-01-10 timestamp:<2024-01-11T12:00:00.500+01:00", "ts_ms >= 1704844800000 AND ts_ms < 1704970800500"),
    "log_query_trace": ("trace_id:7-2024-01 OR span_id:s42", "trace_id = '7-2024-01' OR span_id = 's42'"),
}

PIPELINES = [
    {"priority": "10", "rules": '[{"type": "add_prefix", "value": "app:"}, {"type": "set_field", "target": "stage", "value": "last"}]'},
    {"priority": "2", "rules": r'[{"type": "regex_extract", "pattern": "User (?P<user_id>\\d+) visited (?P<page>/\\d+)"}, {"type": "mask", "pattern": "\\d+\\.\\d+\\.\\d+\\.\\d+"}, {"type": "rename_field", "field": "k", "target": "key"}, {"type": "set_field", "target": "stage", "value": "first"}]'},
    {"priority": "3", "rules": r'[{"type": "drop", "pattern": "visited /[34] "}, {"type": "sample", "pattern": "^User \\d*[02468] ", "value": "40"}, {"type": "lowercase", "field": "env"}]'},
    {"priority": "1", "enabled": "false", "rules": '[{"type": "drop", "pattern": "."}]'},
]
_MASKED = r"regexp_replace(message, '\d+\.\d+\.\d+\.\d+', '[REDACTED]', 'g')"
_FNV = """list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, length(m) + 1), lambda i: ascii(m[i])::UBIGINT)), lambda h, b: xor(h, b) * 16777619 % 4294967296)"""


def _search(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    found = model.logs(spark, sf_dir).filter(logquery.compiled(text))
    return found.select("log_id", "ts_ms", "level", "message")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logs.pipelines(model.logs(spark, sf_dir), PIPELINES)
    return out.select("log_id", "message", *[F.col("attributes")[k].alias(k) for k in ("key", "k", "user_id", "page", "env", "stage")])


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' properties as messages in JSON; every other one as an attribute, of which one in ten is no JSON."""
    ev = model.events(spark, sf_dir)
    raw = F.when(F.col("event_id") % 10 == 3, "not json").otherwise(F.concat(F.lit('{"K":'), "k", F.lit(',"deep":{"a":[1,2]},"k":"x"}')))
    own = F.map_from_arrays(F.array(F.lit("k")), F.array(F.lit("old")))
    held = F.when(F.col("event_id") % 2 == 1, F.map_concat(own, F.map_from_arrays(F.array(F.lit("raw")), F.array(raw)))).otherwise(own)
    shown = ev.select(F.col("event_id").alias("log_id"), F.when(F.col("event_id") % 2 == 1, "text").otherwise(raw).alias("message"), held.alias("attributes"))
    out = logs.pipeline(shown, [{"type": "json_parse", "field": "raw"}])
    return out.select("log_id", *[F.col("attributes")[k].alias(name) for k, name in (("K", "upper_k"), ("k", "lower_k"), ("deep", "deep"))])


QUERIES = {name: lambda spark, sf_dir, text=text: _search(spark, sf_dir, text) for name, (text, _) in SEARCHES.items()} | {
    "log_query_newest": lambda spark, sf_dir: logs.search(model.logs(spark, sf_dir), logquery.compiled("level:error -attr.http.status:500"), 50, (1_705_000_000_000, 0)).select("log_id", "ts_ms"),
    "log_pipeline": _pipeline,
    "log_json_parse": _parsed,
}
ORACLE_SQL = {name: f"{_LOGS} SELECT log_id, ts_ms, level, message FROM lg WHERE {sql}" for name, (_, sql) in SEARCHES.items()} | {
    "log_query_newest": f"{_LOGS} SELECT log_id, ts_ms FROM lg WHERE level = 'error' AND status <> 500 AND (ts_ms, log_id) < (1705000000000, 0) ORDER BY ts_ms DESC, log_id DESC LIMIT 50",
    "log_pipeline": f"""{_LOGS}, p AS (
  SELECT *, {_MASKED} AS m FROM lg WHERE NOT regexp_matches(message, 'visited /[34] ')
)
SELECT log_id, concat('app: ', m) AS message, CAST(k AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS k, regexp_extract(message, 'User (\\d+)', 1) AS user_id,
  regexp_extract(message, 'visited (/\\d+)', 1) AS page, env, 'last' AS stage FROM p WHERE NOT regexp_matches(m, '^User \\d*[02468] ') OR {_FNV} % 100 < 40""",
    "log_json_parse": f"""WITH {SQL_EVENTS} SELECT event_id AS log_id, CASE WHEN event_id % 10 <> 3 THEN k::VARCHAR END AS upper_k, if(event_id % 10 = 3, 'old', 'x') AS lower_k,
  CASE WHEN event_id % 10 <> 3 THEN '{{"a":[1,2]}}' END AS deep FROM ev""",
}
