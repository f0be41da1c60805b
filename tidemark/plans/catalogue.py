"""Named queries of the analytics operators over the driver's tables, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.web import channel, host, stable_bucket
from tidemark.operators import cohorts, errors, experiments, logs, lookups, metrics, rollups, sequences, tracing, traffic
from tidemark.plans import admission, alerting, coverage, issues, logsearch, privacy, records, schedules, spans, views
from tidemark.sources import model
from tidemark.sources.model import DAY_MS, HOUR_MS, SQL_EVENTS, SQL_SPANS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: 2024-01-01 in epoch milliseconds: the tables' events begin there and fill thirty days.
START_MS = 1_704_067_200_000
END_MS = START_MS + 30 * DAY_MS
THREE_DAYS = 3 * DAY_MS


def query(name: str, over: str, sql: str | None = None):
    """Registers a function of one of the model's frames under a name, with its SQL."""

    def register(f: Callable[[DataFrame], DataFrame]):
        source = getattr(model, over)
        QUERIES[name] = lambda spark, sf_dir: f(source(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql.strip() if over == "table" else f"WITH {SQL_SPANS if over == 'spans' else SQL_EVENTS}{',' if sql.lstrip().startswith(',') else ''} {sql.strip().lstrip(',')}"
        return f

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# --- traffic -------------------------------------------------------------------------------------------------------

SESSIONS = """, se AS (SELECT session_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS events, count(*) FILTER (event_type = 'pageview') AS pageviews,
  arg_min(pathname, (ts_ms, event_id)) FILTER (event_type = 'pageview') AS entry_page, arg_max(pathname, (ts_ms, event_id)) FILTER (event_type = 'pageview') AS exit_page,
  arg_min(browser, (ts_ms, event_id)) AS browser, arg_min(country, (ts_ms, event_id)) AS country, count(*) <= 1 AS is_bounce, (max(ts_ms) - min(ts_ms)) / 1000 AS duration_s FROM ev GROUP BY session_id)"""


@query("overview", "events", SESSIONS + """
SELECT c.*, s.sessions, round(s.bounce_pct, 6) AS bounce_pct, round(s.mean_duration_s, 6) AS mean_duration_s FROM
  (SELECT count(*) FILTER (event_type = 'pageview') AS pageviews, count(DISTINCT session_id) FILTER (event_type = 'pageview') AS visitors, count(DISTINCT visit_id) FILTER (event_type = 'pageview') AS visits FROM ev) c,
  (SELECT count(*) AS sessions, 100 * avg(is_bounce::DOUBLE) AS bounce_pct, avg(duration_s) AS mean_duration_s FROM se) s""")
def _overview(ev: DataFrame) -> DataFrame:
    return rounded(traffic.overview(ev), bounce_pct=6, mean_duration_s=6)


@query("overview_compare", "events", f"""
SELECT count(*) FILTER (ts_ms >= {START_MS + 15 * DAY_MS}) AS pageviews, count(DISTINCT session_id) FILTER (ts_ms >= {START_MS + 15 * DAY_MS}) AS visitors,
  count(*) FILTER (ts_ms < {START_MS + 15 * DAY_MS}) AS previous_pageviews, count(DISTINCT session_id) FILTER (ts_ms < {START_MS + 15 * DAY_MS}) AS previous_visitors
FROM ev WHERE event_type = 'pageview' AND ts_ms >= {START_MS} AND ts_ms < {END_MS}""")
def _compare(ev: DataFrame) -> DataFrame:
    return traffic.compared(ev, START_MS + 15 * DAY_MS, END_MS, 15 * DAY_MS)


@query("realtime", "events", f"SELECT count(DISTINCT session_id) AS visitors FROM ev WHERE ts_ms >= {END_MS - 60 * 60_000}")
def _realtime(ev: DataFrame) -> DataFrame:
    return traffic.realtime(ev, END_MS, 60)


for _name, _width in (("hour", HOUR_MS), ("day", DAY_MS), ("week", 7 * DAY_MS), ("month", 30 * DAY_MS)):
    query(f"timeseries_{_name}", "events", f"""SELECT ts_ms // {_width} * {_width} AS bucket_ms, count(*) AS pageviews, count(DISTINCT session_id) AS visitors
FROM ev WHERE event_type = 'pageview' GROUP BY 1""")(lambda ev, w=_width: traffic.timeseries(ev, w))


@query("top_pages", "events", "SELECT pathname, count(*) AS pageviews, count(DISTINCT session_id) AS visitors FROM ev WHERE event_type = 'pageview' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _top_pages(ev: DataFrame) -> DataFrame:
    return traffic.top_pages(ev)


for _dim in ("browser", "country", "utm_source", "referrer", "release", "os", "device", "language", "screen", "utm_medium", "utm_campaign"):
    query(f"breakdown_{_dim}", "events", f"SELECT {_dim} AS name, count(DISTINCT session_id) AS visitors, count(*) AS events FROM ev WHERE {_dim} <> '' GROUP BY 1")(lambda ev, d=_dim: traffic.breakdown(ev, d))

query("filtered_timeseries", "events", f"""SELECT ts_ms // {DAY_MS} * {DAY_MS} AS bucket_ms, count(*) AS pageviews, count(DISTINCT session_id) AS visitors FROM ev
WHERE event_type = 'pageview' AND browser IN ('Chrome', 'Safari') AND country = 'DE' AND ts_ms >= {START_MS} AND ts_ms < {START_MS + 10 * DAY_MS} GROUP BY 1""")(
    lambda ev: traffic.timeseries(traffic.where(ev, {"country": "DE", "utm_source": ""}, {"browser": ["Chrome", "Safari"]}, START_MS, START_MS + 10 * DAY_MS), DAY_MS)
)
query("filter_empty_list", "events", "SELECT event_id FROM ev WHERE 1 = 0")(lambda ev: traffic.where(ev, any_of={"browser": []}).select("event_id"))

CHANNEL_SQL = """CASE WHEN utm_medium = 'cpc' THEN 'Paid' WHEN utm_medium = 'email' THEN 'Email' WHEN utm_medium = 'social' THEN 'Social' WHEN utm_medium = 'organic' THEN 'Organic Search' WHEN utm_source = 'google' THEN 'Organic Search' WHEN utm_source IN ('facebook', 'twitter') THEN 'Social' WHEN referrer = '' THEN 'Direct'
  WHEN referrer LIKE 'https://chatgpt.com%' THEN 'AI Assistant' WHEN referrer LIKE 'https://www.google.%' THEN 'Organic Search' WHEN referrer LIKE 'https://t.co/%' THEN 'Social' ELSE 'Referral' END"""
query("channels", "events", f"SELECT {CHANNEL_SQL} AS channel, count(DISTINCT session_id) AS visitors FROM ev GROUP BY 1")(traffic.channels)
query("channel_filter", "events", f"SELECT event_id FROM ev WHERE {CHANNEL_SQL} = 'AI Assistant'")(lambda ev: ev.filter(channel(F.col("utm_source"), F.col("utm_medium"), F.col("referrer")) == "AI Assistant").select("event_id"))
query("session_detail", "events", f"""SELECT event_id, ts_ms, event_type, pathname, ts_ms - min(ts_ms) OVER () AS since_ms FROM ev WHERE session_id = (SELECT min(session_id) FROM ev)""")(
    lambda ev: traffic.session_events(ev, ev.agg(F.min("session_id")).first()[0]).select("event_id", "ts_ms", "event_type", "pathname", "since_ms")
)
query("sessions_with_errors", "events", """SELECT session_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, min(ts_ms) FILTER (event_type = 'error') AS first_error_ms FROM ev GROUP BY 1 HAVING count(*) FILTER (event_type = 'error') > 0""")(traffic.sessions_with_errors)
query("page_goal", "events", """SELECT count(DISTINCT session_id) FILTER (event_type = 'pageview' AND pathname = '/4') AS conversions, count(*) FILTER (event_type = 'pageview' AND pathname = '/4') AS events,
  round(100 * count(DISTINCT session_id) FILTER (event_type = 'pageview' AND pathname = '/4') / count(DISTINCT session_id), 6) AS rate_pct, 250 * count(*) FILTER (event_type = 'pageview' AND pathname = '/4') AS value_minor FROM ev""")(
    lambda ev: rounded(traffic.page_goal(ev, "/4", 250), rate_pct=6)
)
query("bounded_scan", "events", f"SELECT event_id, ts_ms FROM ev WHERE ts_ms >= {START_MS} AND ts_ms < {START_MS + DAY_MS} ")(lambda ev: traffic.bounded(ev, START_MS, START_MS + DAY_MS, 1_000_000).select("event_id", "ts_ms"))
query("persons_count", "events", "SELECT count(DISTINCT distinct_id) AS persons FROM ev WHERE distinct_id <> ''")(lambda ev: traffic.persons(ev).agg(F.count("*").alias("persons")))
query("person_timeline", "events", "SELECT event_id, ts_ms, session_id, event_type FROM ev WHERE distinct_id = '7' ORDER BY ts_ms DESC, event_id DESC LIMIT 100")(
    lambda ev: ev.filter("distinct_id = '7'").orderBy(F.desc("ts_ms"), F.desc("event_id")).limit(100).select("event_id", "ts_ms", "session_id", "event_type")
)
query("custom_events", "events", "SELECT event_type, count(*) AS events, count(DISTINCT session_id) AS visitors FROM ev WHERE event_type <> 'pageview' GROUP BY 1")(traffic.custom_events)
query("properties", "events", "SELECT 'k' AS key, json_extract_string(props, '$.k') AS value, count(*) AS events, count(DISTINCT session_id) AS visitors FROM ev GROUP BY 2")(traffic.properties)
query("property_keys", "events", "SELECT 'k' AS key, count(*) AS events FROM ev WHERE json_extract_string(props, '$.k') IS NOT NULL")(traffic.property_keys)
query("property_values", "events", "SELECT json_extract_string(props, '$.k') AS value, count(*) AS events FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")(lambda ev: traffic.property_values(ev, "k"))


@query("goal_purchase", "events", """SELECT count(DISTINCT session_id) FILTER (event_type = 'purchase') AS conversions, count(*) FILTER (event_type = 'purchase') AS events,
  round(100 * count(DISTINCT session_id) FILTER (event_type = 'purchase') / count(DISTINCT session_id), 6) AS rate_pct, CAST(sum(round(value * 100)) FILTER (event_type = 'purchase') AS BIGINT) AS value_minor FROM ev""")
def _goal(ev: DataFrame) -> DataFrame:
    return rounded(traffic.goal(ev, "purchase"), rate_pct=6)


query("sessions", "events", SESSIONS + " SELECT * FROM se")(traffic.sessions)
for _page in ("entry_page", "exit_page"):
    query(f"{_page}s", "events", SESSIONS + f" SELECT {_page} AS page, count(*) AS sessions FROM se WHERE {_page} IS NOT NULL GROUP BY 1")(lambda ev, p=_page: traffic.session_pages(ev, p))
query("session_semi_join", "events", "SELECT count(DISTINCT session_id) AS sessions FROM ev WHERE session_id IN (SELECT session_id FROM ev WHERE event_type = 'purchase' AND country = 'US')")(
    lambda ev: ev.join(ev.filter("event_type = 'purchase' and country = 'US'").select("session_id"), "session_id", "left_semi").agg(F.count_distinct("session_id").alias("sessions"))
)
query("heatmap", "events", "SELECT CAST(k // 10 * 10 + 5 AS BIGINT) AS x, CAST(floor(value / 10) * 10 + 5 AS BIGINT) AS y, CAST(floor((event_id % 1900) / 100) * 100 AS BIGINT) AS viewport_width, count(*) AS clicks FROM ev WHERE event_type = 'click' GROUP BY 1, 2, 3")(
    lambda ev: traffic.heatmap(ev.filter("event_type = 'click'").select(F.col("k").alias("x"), F.col("value").alias("y"), (F.col("event_id") % 1900).alias("viewport_width")))
)
query("board", "events", "SELECT country AS site, count(*) FILTER (event_type = 'pageview') AS pageviews, count(DISTINCT session_id) FILTER (event_type = 'pageview') AS visitors, count(*) FILTER (event_type = 'error') AS errors, max(ts_ms) AS last_ms FROM ev GROUP BY 1")(lambda ev: traffic.board(ev, "country"))
query("newest_events", "events", f"SELECT event_id, ts_ms, event_type FROM ev WHERE (ts_ms, event_id) < ({END_MS - DAY_MS}, 0) ORDER BY ts_ms DESC, event_id DESC LIMIT 20")(lambda ev: traffic.newest(ev, 20, (END_MS - DAY_MS, 0)).select("event_id", "ts_ms", "event_type"))

PERSONS = ", pe AS (SELECT distinct_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS events, count(DISTINCT session_id) AS sessions, arg_max(country, (ts_ms, event_id)) AS country FROM ev GROUP BY 1)"
query("persons", "events", PERSONS + " SELECT * FROM pe")(traffic.persons)


def _aliases(ev: DataFrame) -> DataFrame:
    """Each person whose number ends in 1 or 2 is an alias of the one before."""
    number = F.col("distinct_id").cast("long")
    pairs = ev.select(number.alias("n")).distinct().filter("n % 10 in (1, 2)")
    return traffic.canonical(pairs.select(F.col("n").cast("string").alias("alias"), (F.col("n") - 1).cast("string").alias("target")), 2)


query("persons_folded", "events", PERSONS + """ SELECT CASE WHEN CAST(distinct_id AS BIGINT) % 10 IN (1, 2) THEN CAST(CASE WHEN CAST(distinct_id AS BIGINT) % 10 = 2 AND CAST(CAST(distinct_id AS BIGINT) - 1 AS VARCHAR) NOT IN (SELECT distinct_id FROM pe)
  THEN CAST(distinct_id AS BIGINT) - 1 ELSE CAST(distinct_id AS BIGINT) // 10 * 10 END AS VARCHAR) ELSE distinct_id END AS person,
  min(first_ms) AS first_ms, max(last_ms) AS last_ms, CAST(sum(events) AS BIGINT) AS events, CAST(sum(sessions) AS BIGINT) AS sessions FROM pe GROUP BY 1""")(lambda ev: traffic.folded(traffic.persons(ev), _aliases(ev)))

# --- sequences -----------------------------------------------------------------------------------------------------

STEPS = ("signup", "pageview", "purchase")


def _steps() -> list[Column]:
    return [F.col("event_type") == s for s in STEPS]


def _funnel_sql(entity: str, window: int | None, stop: str | None = None) -> str:
    limit = f" AND n.ts_ms <= s.t0 + {window}" if window else ""
    end = f"SELECT s.e, min((n.ts_ms, n.event_id)) AS x FROM s1 s JOIN ev n ON n.{entity} = s.e AND n.event_type = '{stop}' AND (n.ts_ms, n.event_id) > s.a GROUP BY 1" if stop else "SELECT NULL AS e, NULL AS x WHERE 1 = 0"
    sql = f", s1 AS (SELECT {entity} AS e, min((ts_ms, event_id)) AS a, min(ts_ms) AS t0 FROM ev WHERE event_type = '{STEPS[0]}' GROUP BY 1), en AS ({end})"
    for i, step in enumerate(STEPS[1:], 2):
        stopped = " AND (en.x IS NULL OR (n.ts_ms, n.event_id) < en.x)" if stop else ""
        sql += f", s{i} AS (SELECT s.e, min((n.ts_ms, n.event_id)) AS a, any_value(s.t0) AS t0 FROM s{i - 1} s {'LEFT JOIN en ON en.e = s.e ' if stop else ''}JOIN ev n ON n.{entity} = s.e AND n.event_type = '{step}' AND (n.ts_ms, n.event_id) > s.a{limit}{stopped} GROUP BY 1)"
    return sql


_COUNT_STEPS = " UNION ALL ".join(f"SELECT {i} AS step, count(*) AS entities FROM s{i}" for i in (1, 2, 3))
query("funnel", "events", _funnel_sql("distinct_id", None) + _COUNT_STEPS.replace("SELECT", " SELECT", 1))(lambda ev: sequences.funnel(ev, _steps(), entity="distinct_id"))
query("funnel_window", "events", _funnel_sql("distinct_id", THREE_DAYS) + " " + _COUNT_STEPS)(lambda ev: sequences.funnel(ev, _steps(), entity="distinct_id", window_ms=THREE_DAYS))
query("funnel_exclusion", "events", _funnel_sql("distinct_id", THREE_DAYS, "error") + " " + _COUNT_STEPS)(lambda ev: sequences.funnel(ev, _steps(), entity="distinct_id", window_ms=THREE_DAYS, exclude=F.col("event_type") == "error"))
query("funnel_breakdown", "events", _funnel_sql("distinct_id", THREE_DAYS) + """, g AS (SELECT distinct_id AS e, arg_min(browser, (ts_ms, event_id)) AS "group" FROM ev GROUP BY 1), big AS (SELECT "group" FROM g JOIN s1 USING (e) GROUP BY 1 HAVING count(*) >= 5) """
      + " UNION ALL ".join(f'SELECT b."group", {i} AS step, count(s.e) AS entities FROM big b LEFT JOIN (SELECT g."group", g.e FROM g JOIN s{i} USING (e)) s ON s."group" = b."group" GROUP BY 1' for i in (1, 2, 3)))(
    lambda ev: sequences.funnel_breakdown(ev, _steps(), "browser", entity="distinct_id", window_ms=THREE_DAYS)
)
for _name, _period in (("daily", DAY_MS), ("weekly", 7 * DAY_MS)):
    query(f"retention_{_name}", "events", f""", a AS (SELECT DISTINCT distinct_id AS e, ts_ms // {_period} AS b FROM ev), f AS (SELECT e, min(b) AS c FROM a GROUP BY 1), z AS (SELECT c, count(*) AS size FROM f GROUP BY 1),
  p AS (SELECT c, size, unnest(range(1, least(12, {END_MS} // {_period} - 1 - c) + 1)) AS period FROM z)
SELECT p.c * {_period} AS cohort_ms, p.size, p.period, count(a.e) AS retained FROM p LEFT JOIN (f JOIN a USING (e)) ON f.c = p.c AND a.b = p.c + p.period GROUP BY 1, 2, 3""")(
        lambda ev, w=_period: sequences.retention(ev, w, END_MS, entity="distinct_id")
    )
VISITS = """, v0 AS (SELECT *, lag(pathname) OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS prev FROM ev WHERE event_type = 'pageview'), v1 AS (SELECT * FROM v0 WHERE pathname IS DISTINCT FROM prev),
  v AS (SELECT * FROM v1 WHERE session_id IN (SELECT session_id FROM v1 GROUP BY 1 HAVING count(*) >= 2))"""
query("journey_edges", "events", VISITS + ", e AS (SELECT pathname AS source, lead(pathname) OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS target FROM v) SELECT source, target, count(*) AS transitions FROM e WHERE target IS NOT NULL GROUP BY 1, 2")(sequences.journey_edges)
query("journey_paths", "events", VISITS + ", n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS i FROM v), p AS (SELECT session_id, string_agg(pathname, ' > ' ORDER BY i) AS path FROM n WHERE i <= 5 GROUP BY 1) SELECT path, count(*) AS entities FROM p GROUP BY 1")(sequences.journey_paths)
for _model, _pick in (("first", "arg_min"), ("last", "arg_max")):
    query(f"attribution_{_model}", "events", f", s AS (SELECT session_id, {_pick}(utm_source, (ts_ms, event_id)) FILTER (utm_source <> '') AS source FROM ev GROUP BY 1) SELECT coalesce(source, '(direct)') AS source, CAST(count(*) AS DOUBLE) AS credit FROM s GROUP BY 1")(
        lambda ev, m=_model: sequences.attribution(ev, m)
    )
query("attribution_linear", "events", """, s AS (SELECT DISTINCT session_id, utm_source AS source FROM ev WHERE utm_source <> ''), c AS (SELECT session_id, 1.0::DOUBLE / count(*) AS credit FROM s GROUP BY 1)
SELECT source, round(sum(credit), 6) AS credit FROM (SELECT source, credit FROM s JOIN c USING (session_id) UNION ALL SELECT '(direct)', 1.0 FROM (SELECT DISTINCT session_id FROM ev) WHERE session_id NOT IN (SELECT session_id FROM s)) GROUP BY 1""")(
    lambda ev: rounded(sequences.attribution(ev, "linear"), credit=6)
)
query("correlation", "events", """, h AS (SELECT session_id, bool_or(event_type = 'purchase')::BIGINT AS hit FROM ev GROUP BY 1),
  e AS (SELECT session_id, ts_ms, event_id, unnest(['browser', 'country', 'k']) AS property, unnest([browser, country, json_extract_string(props, '$.k')]) AS value FROM ev),
  l AS (SELECT session_id, property, arg_max(value, (ts_ms, event_id)) AS value FROM e WHERE value <> '' GROUP BY 1, 2), t AS (SELECT count(*) AS n, sum(hit)::BIGINT AS k FROM h),
  g AS (SELECT property, value, count(*) AS occurrences, sum(hit)::BIGINT AS conversions FROM l JOIN h USING (session_id) GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT property, value, occurrences, conversions, round(conversions / occurrences * 100, 1) AS rate, round(k / n * 100, 1) AS baseline_rate, round(CASE WHEN k > 0 THEN (conversions / occurrences - k / n) / (k / n) * 100 ELSE 0 END, 1) AS uplift,
  occurrences >= 10 AND n >= 20 AND coalesce(abs(conversions / occurrences - (k - conversions) / nullif(n - occurrences, 0)) / nullif(sqrt(k / n * (1 - k / n) * (1 / occurrences + 1 / nullif(n - occurrences, 0))), 0) > 1.96, false) AS significant
FROM g, t ORDER BY abs(round(CASE WHEN k > 0 THEN (conversions / occurrences - k / n) / (k / n) * 100 ELSE 0 END, 1)) DESC, property, value LIMIT 20""")(lambda ev: sequences.correlation(ev, ["browser", "country"], "purchase"))

# --- cohorts -------------------------------------------------------------------------------------------------------

_BUYERS = {"type": "event", "name": "purchase", "min_count": 3}
_ERRORS = {"type": "event", "name": "error", "min_count": 3}
_SEVEN = {"type": "property", "key": "k", "value": "7", "operator": "="}
_DID = "SELECT distinct_id FROM ev WHERE event_type = '{}' GROUP BY 1 HAVING count(*) >= 3"
_HAS = "SELECT DISTINCT distinct_id FROM ev WHERE json_extract_string(props, '$.k') = '7'"
query("cohort_and", "events", f"{_DID.format('purchase')} INTERSECT {_DID.format('error')}")(lambda ev: cohorts.cohort(ev, {"op": "and", "rules": [_BUYERS, _ERRORS]}))
query("cohort_or", "events", f"{_DID.format('purchase')} UNION {_HAS}")(lambda ev: cohorts.cohort(ev, {"op": "or", "rules": [_BUYERS, _SEVEN]}))
query("cohort_not", "events", f"SELECT DISTINCT distinct_id FROM ev EXCEPT {_HAS}")(lambda ev: cohorts.cohort(ev, {"op": "not", "rules": [_SEVEN]}))
query("cohort_unequal", "events", f"SELECT DISTINCT distinct_id FROM ev EXCEPT {_HAS}")(lambda ev: cohorts.cohort(ev, _SEVEN | {"operator": "!="}))
query("cohort_tree", "events", f"({_DID.format('purchase')} INTERSECT (SELECT DISTINCT distinct_id FROM ev EXCEPT {_HAS}))")(lambda ev: cohorts.cohort(ev, {"op": "and", "rules": [_BUYERS, {"op": "not", "rules": [_SEVEN]}]}))
query("cohort_filter", "events", f"SELECT count(*) AS events FROM ev WHERE distinct_id IN ({_HAS})")(lambda ev: cohorts.within(ev, cohorts.cohort(ev, _SEVEN)).agg(F.count("*").alias("events")))
query("cohort_static", "events", "SELECT distinct_id AS entity_id FROM (SELECT distinct_id, arg_max(event_type, (ts_ms, event_id)) AS last FROM ev GROUP BY 1) WHERE last <> 'error'")(
    lambda ev: cohorts.members(ev.groupBy("distinct_id", "ts_ms").agg(F.max_by("event_type", "event_id").alias("t")).select(F.col("distinct_id").alias("entity_id"), (F.col("t") == "error").alias("removed"), F.col("ts_ms").alias("version")))
)

# --- spans ---------------------------------------------------------------------------------------------------------

_RED = """count(*) AS spans, count(*) FILTER (is_error) AS errors, round(avg(duration_ms), 6) AS avg_ms, round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms, round(quantile_cont(duration_ms, 0.99), 6) AS p99_ms,
  round((count(*) FILTER (parent_span_id IS NULL AND duration_ms <= 500) + count(*) FILTER (parent_span_id IS NULL AND duration_ms > 500 AND duration_ms <= 2000) / 2) / nullif(count(*) FILTER (parent_span_id IS NULL), 0), 6) AS apdex"""
_RED_DIGITS = dict.fromkeys(("avg_ms", "p50_ms", "p95_ms", "p99_ms", "apdex"), 6)
query("red_services", "spans", f"SELECT service, {_RED} FROM sp GROUP BY 1")(lambda sp: rounded(tracing.red(sp, "service"), **_RED_DIGITS))
query("red_operations", "spans", f"SELECT service, operation, {_RED} FROM sp GROUP BY 1, 2")(lambda sp: rounded(tracing.red(sp, "service", "operation"), **_RED_DIGITS))
query("span_minutes", "spans", "SELECT service, operation, start_ms // 60000 * 60000 AS bucket_ms, count(*) AS spans, count(*) FILTER (is_error) AS errors, CAST(sum(duration_ms) AS BIGINT) AS sum_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms FROM sp GROUP BY 1, 2, 3")(tracing.per_minute)
query("service_deps", "spans", "SELECT p.service AS caller, c.service AS callee, count(*) AS calls, count(*) FILTER (c.is_error) AS errors, round(avg(c.duration_ms), 6) AS avg_ms FROM sp c JOIN sp p ON p.trace_id = c.trace_id AND p.span_id = c.parent_span_id WHERE p.service <> c.service GROUP BY 1, 2")(lambda sp: rounded(tracing.dependencies(sp), avg_ms=6))
query("minute_percentiles", "spans", """, o AS (SELECT service, operation, start_ms // 60000 * 60000 AS bucket_ms, list_sort(list(duration_ms)) AS d FROM sp GROUP BY ALL)
SELECT service, operation, bucket_ms, d[CAST(floor((len(d) - 1) * 0.5) AS INT) + 1] AS p50_ms, d[CAST(floor((len(d) - 1) * 0.95) AS INT) + 1] AS p95_ms, d[CAST(floor((len(d) - 1) * 0.99) AS INT) + 1] AS p99_ms FROM o""")(tracing.minute_percentiles)
query("trace_detail", "spans", "SELECT span_id, parent_span_id, service, operation, start_ms, duration_ms, is_error FROM sp WHERE trace_id = 7")(lambda sp: tracing.trace(sp, 7).select("span_id", "parent_span_id", "service", "operation", "start_ms", "duration_ms", "is_error"))
query("traces", "spans", "SELECT trace_id, count(*) AS spans, min(start_ms) AS start_ms, max(end_ms) - min(start_ms) AS duration_ms, bool_or(is_error) AS has_error, arg_min(service, (start_ms, span_id, service)) FILTER (parent_span_id IS NULL) AS root_service FROM sp GROUP BY 1")(
    lambda sp: tracing.traces(sp.withColumn("span_id", F.struct("span_id", "service")))
)
query("orphans", "spans", """, e AS (SELECT trace_id, arg_min(parent_span_id, (start_ms, span_id)) AS parent_span_id FROM sp GROUP BY 1 HAVING count(*) FILTER (parent_span_id IS NULL) = 0)
SELECT trace_id FROM e WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.trace_id = e.trace_id AND sp.span_id = e.parent_span_id)""")(tracing.orphans)
query("trace_search", "spans", "SELECT trace_id, span_id, operation FROM sp WHERE operation <> 'op1' AND contains(service, 'A') ORDER BY duration_ms DESC, start_ms, span_id, operation LIMIT 50")(
    lambda sp: tracing.with_attribute(
        tracing.with_attribute(sp.withColumn("attributes", F.map_from_arrays(F.array(F.lit("op"), F.lit("service")), F.array("operation", "service"))), "op", "neq", "op1"), "service", "contains", "A"
    ).orderBy(F.desc("duration_ms"), "start_ms", "span_id", "operation").limit(50).select("trace_id", "span_id", "operation")
)

# --- metrics -------------------------------------------------------------------------------------------------------

_POINTS = ", mp AS (SELECT concat(event_type, '/', CAST(distinct_id AS BIGINT) % 3) AS stream, event_type AS metric, ts_ms, event_id, CAST(k AS DOUBLE) AS value FROM ev)"
for _how, _sql in (("avg", "round(avg(value), 6)"), ("sum", "sum(value)"), ("min", "min(value)"), ("max", "max(value)"), ("last", "arg_max(value, (ts_ms, event_id))")):
    query(f"metric_{_how}", "metric_points", f"{_POINTS} SELECT metric, ts_ms // {6 * HOUR_MS} * {6 * HOUR_MS} AS bucket_ms, {_sql} AS value FROM mp GROUP BY 1, 2")(lambda mp, h=_how: rounded(metrics.reduced(mp, h, 6 * HOUR_MS, "metric"), value=6))
query("metric_rate", "metric_points", _POINTS + f""", u AS (SELECT stream, metric, ts_ms, arg_min(value, event_id) AS value FROM mp GROUP BY 1, 2, 3), d AS (SELECT *, lag(value) OVER w AS before, lag(ts_ms) OVER w AS since FROM u WINDOW w AS (PARTITION BY stream ORDER BY ts_ms)),
  r AS (SELECT stream, metric, ts_ms // {DAY_MS} * {DAY_MS} AS bucket_ms, 1000 * sum(CASE WHEN value >= before THEN value - before ELSE value END) / (max(ts_ms) - min(since)) AS rate FROM d WHERE since IS NOT NULL GROUP BY 1, 2, 3)
SELECT metric, bucket_ms, round(sum(rate), 9) AS rate FROM r GROUP BY 1, 2""")(lambda mp: rounded(metrics.counter_rate(mp, DAY_MS, "metric"), rate=9))
query("metric_delta_rate", "metric_points", _POINTS + f" SELECT metric, ts_ms // {DAY_MS} * {DAY_MS} AS bucket_ms, round(1000 * sum(value) / {DAY_MS}, 9) AS rate FROM mp GROUP BY 1, 2")(lambda mp: rounded(metrics.delta_rate(mp, DAY_MS, "metric"), rate=9))


@query("hist_quantile", "metric_points", _POINTS + f""", c AS (SELECT ts_ms // {DAY_MS} * {DAY_MS} AS bucket_ms, CASE WHEN value <= 25 THEN 0 WHEN value <= 50 THEN 1 WHEN value <= 75 THEN 2 ELSE 3 END AS i, count(*) AS n FROM mp GROUP BY 1, 2),
  r AS (SELECT *, sum(n) OVER (PARTITION BY bucket_ms ORDER BY i) AS "to", sum(n) OVER (PARTITION BY bucket_ms) AS "all" FROM c), h AS (SELECT bucket_ms, min((i, n, "to", "all")) AS x FROM r WHERE "to" >= 0.9 * "all" GROUP BY 1)
SELECT bucket_ms, round(CASE WHEN x[1] = 0 THEN 25 WHEN x[1] = 3 THEN 75 ELSE 25 * x[1] + 25 * (0.9 * x[4] - (x[3] - x[2])) / x[2] END, 6)::DOUBLE AS value FROM h""")
def _hist(mp: DataFrame) -> DataFrame:
    place = F.when(F.col("value") <= 25, 0).when(F.col("value") <= 50, 1).when(F.col("value") <= 75, 2).otherwise(3)
    counts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (i == place).cast("long"))
    points = mp.select("stream", "ts_ms", F.array(*map(F.lit, (25.0, 50.0, 75.0))).alias("bounds"), counts.alias("counts"))
    return rounded(metrics.histogram_quantile(points, 0.9, DAY_MS, cumulative=False), value=6)


# --- logs ----------------------------------------------------------------------------------------------------------

_LOGS = """, lg AS (SELECT event_id AS log_id, ts_ms, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'WARN' WHEN 'click' THEN 'debug' ELSE 'info' END AS level,
  concat('User ', distinct_id, ' visited ', pathname, ' from 10.0.0.', k) AS message, browser AS service, k FROM ev)"""
query("log_stats", "logs", _LOGS + " SELECT lower(level) AS level, count(*) AS logs FROM lg GROUP BY 1")(logs.level_counts)
query("log_histogram", "logs", _LOGS + f" SELECT ts_ms // {DAY_MS} * {DAY_MS} AS bucket_ms, lower(level) AS level, count(*) AS logs FROM lg GROUP BY 1, 2")(lambda lg: logs.histogram(lg, DAY_MS))
query("log_search", "logs", _LOGS + " SELECT log_id, ts_ms, level, message FROM lg WHERE (level IN ('warn', 'WARN', 'Warn') OR contains(lower(message), 'user 7 ')) AND NOT k > 50 ORDER BY ts_ms DESC, log_id DESC LIMIT 200")(
    lambda lg: logs.search(lg, logs.all_of(logs.any_of(logs.level_is("warn"), logs.message_has("USER 7 ")), logs.none_of(logs.attribute("k", ">", "50")))).select("log_id", "ts_ms", "level", "message")
)
_MP = ", mp AS (SELECT concat(event_type, '/', CAST(distinct_id AS BIGINT) % 3) AS stream, event_type AS metric, CAST(CAST(distinct_id AS BIGINT) % 3 AS VARCHAR) AS shard, CASE WHEN os <> '' THEN browser END AS browser, ts_ms, event_id, k::DOUBLE AS value FROM ev)"
query("host_latest", "labelled_points", _MP + " SELECT shard, metric, arg_max(value, (ts_ms, event_id)) AS value, max(ts_ms) AS ts_ms FROM mp GROUP BY 1, 2")(lambda mp: metrics.latest(metrics.with_labels(mp, "shard"), "shard", "metric"))
query("host_history", "labelled_points", _MP + f" SELECT shard, ts_ms // {DAY_MS} * {DAY_MS} AS bucket_ms, round(avg(value), 6) AS value FROM mp WHERE shard = '1' AND metric = 'click' GROUP BY 1, 2")(
    lambda mp: rounded(metrics.reduced(metrics.with_labels(metrics.labelled(mp.filter("metric = 'click'"), {"shard": "1"}), "shard"), "avg", DAY_MS, "shard"), value=6)
)
query("metric_by_label", "labelled_points", _MP + f" SELECT browser, shard, ts_ms // {DAY_MS} * {DAY_MS} AS bucket_ms, sum(value) AS value FROM mp GROUP BY 1, 2, 3")(lambda mp: metrics.reduced(metrics.with_labels(mp, "browser", "shard"), "sum", DAY_MS, "browser", "shard"))
query("metric_label_filter", "labelled_points", _MP + f" SELECT ts_ms // {DAY_MS} * {DAY_MS} AS bucket_ms, max(value) AS value FROM mp WHERE shard = '2' AND browser IN ('Chrome', 'Edge') GROUP BY 1")(
    lambda mp: metrics.reduced(metrics.labelled(mp, {"shard": "2"}, {"browser": ["Chrome", "Edge"]}), "max", DAY_MS)
)
query("metric_list", "labelled_points", _MP + " SELECT metric, count(*) AS points, count(DISTINCT stream) AS streams, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM mp GROUP BY 1")(metrics.listed)
query("metric_labels", "labelled_points", _MP + " SELECT metric, 'browser' AS label, browser AS value, count(*) AS points FROM mp WHERE browser <> '' GROUP BY ALL UNION ALL SELECT metric, 'shard', shard, count(*) FROM mp GROUP BY ALL")(metrics.label_values)

# --- errors --------------------------------------------------------------------------------------------------------

_ERR = """, er AS (SELECT event_id, ts_ms, session_id, distinct_id, release, concat('E', k // 20) AS error_type, concat('cannot load item 1000', k, ' for user', CAST(distinct_id AS BIGINT) % 5) AS message FROM ev WHERE event_type = 'error'),
  eh AS (SELECT *, md5(concat(error_type, '|', regexp_replace(message, '\\b[0-9]{6,}\\b', '{num}', 'g'))) AS group_hash FROM er)"""
query("error_groups", "errors", _ERR + " SELECT group_hash, count(*) AS events, count(DISTINCT distinct_id) AS users, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, arg_max(message, (ts_ms, event_id)) AS message FROM eh GROUP BY 1")(errors.grouped)
query("error_days", "errors", _ERR + f" SELECT d * {DAY_MS} AS day_ms, count(er.event_id) AS events FROM range({START_MS // DAY_MS - 2}, {START_MS // DAY_MS + 33}) t(d) LEFT JOIN er ON er.ts_ms // {DAY_MS} = d GROUP BY 1")(lambda er: errors.daily(er, START_MS // DAY_MS - 2, 35))
query("error_spikes", "errors", _ERR + f", n AS (SELECT *, row_number() OVER (PARTITION BY error_type, ts_ms // 60000 ORDER BY ts_ms, event_id) AS n FROM er) SELECT event_id FROM n WHERE n <= 1 OR (n - 1) % 2 = 0")(lambda er: errors.spike_limited(er, "error_type", 1, 2).select("event_id"))
query("error_bursts", "errors", _ERR + f""", c AS (SELECT error_type, ts_ms // {6 * HOUR_MS} AS b, count(*) AS events FROM er GROUP BY 1, 2),
  m AS (SELECT *, coalesce(sum(events) OVER (PARTITION BY error_type ORDER BY b RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING), 0) / 12 AS mean FROM c),
  x AS (SELECT * FROM m WHERE events >= 3 AND events >= 1.2 * mean),
  k AS (SELECT error_type, min(b) AS b FROM x GROUP BY 1 UNION ALL SELECT error_type, b FROM (SELECT k.error_type, min(x.b) AS b FROM k JOIN x ON x.error_type = k.error_type AND x.b >= k.b + 4 GROUP BY k.error_type))
SELECT error_type, b * {6 * HOUR_MS} AS bucket_ms, events, round(mean, 6) AS mean FROM k JOIN x USING (error_type, b)""")(lambda er: rounded(errors.bursts(er, "error_type", 6 * HOUR_MS, 3, 1.2, quiet=4), mean=6))
ORACLE_SQL["error_bursts"] = ORACLE_SQL["error_bursts"].replace("WITH ", "WITH RECURSIVE ", 1)
query("issue_releases", "errors", _ERR + " SELECT group_hash, release, count(*) AS events, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM eh WHERE release <> '' GROUP BY 1, 2")(errors.releases_of)
query("issue_titles", "errors", _ERR + " SELECT DISTINCT group_hash, left(concat(error_type, ': ', message), 120) AS title FROM eh")(lambda er: er.select(errors.group_hash(F.col("error_type"), F.col("message")).alias("group_hash"), errors.title(F.col("error_type"), F.col("message")).alias("title")).distinct())


def release_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = model.events(spark, sf_dir).select("release", "session_id").distinct()
    return rounded(errors.release_health(model.errors(spark, sf_dir), visits), crash_free_pct=6, adoption_pct=6)


QUERIES["release_health"] = release_health
ORACLE_SQL["release_health"] = f"""WITH {SQL_EVENTS}{_ERR}, s AS (SELECT DISTINCT release, session_id FROM ev), b AS (SELECT release, session_id, count(*) AS errors FROM er GROUP BY 1, 2),
  h AS (SELECT release, count(*) AS sessions, count(errors) AS crashed, CAST(coalesce(sum(errors), 0) AS BIGINT) AS errors FROM s LEFT JOIN b USING (release, session_id) GROUP BY 1),
  g AS (SELECT release, count(DISTINCT group_hash) AS groups, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM eh GROUP BY 1)
SELECT release, sessions, crashed, errors, round(100 - 100 * crashed / sessions, 6) AS crash_free_pct, round(100 * sessions / sum(sessions) OVER (), 6) AS adoption_pct, coalesce(groups, 0) AS groups, first_ms, last_ms FROM h LEFT JOIN g USING (release)"""


def error_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search over error texts."""
    return errors.bm25(errors.postings(model.errors(spark, sf_dir), "event_id", F.concat_ws(": ", "error_type", "message")), ["E3", "user2"])


QUERIES["error_search"] = error_search
ORACLE_SQL["error_search"] = f"""WITH {SQL_EVENTS}{_ERR}, w AS (SELECT event_id AS doc, unnest(list_filter(string_split_regex(lower(concat(error_type, ': ', message)), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM er),
  p AS (SELECT doc, term, count(*) AS tf FROM w GROUP BY 1, 2), l AS (SELECT doc, count(*) AS length FROM w GROUP BY 1), a AS (SELECT count(*) AS docs, avg(length) AS mean FROM l), q AS (SELECT * FROM p WHERE term IN ('e3', 'user2')), f AS (SELECT term, count(*) AS df FROM q GROUP BY 1)
SELECT doc, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM q JOIN f USING (term) JOIN l USING (doc), a GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""

# --- experiments and flags -----------------------------------------------------------------------------------------

_VARIANT = "CASE WHEN ts_ms % 50 = 0 THEN 'b' WHEN CAST(distinct_id AS BIGINT) % 2 = 0 THEN 'a' ELSE 'b' END"
_EXPOSED = f""", x AS (SELECT distinct_id AS "user", {_VARIANT} AS variant, ts_ms FROM ev WHERE event_type = 'signup'), f AS (SELECT "user", arg_min(variant, ts_ms) AS variant, min(ts_ms) AS first_ms FROM x GROUP BY 1 HAVING count(DISTINCT variant) = 1)"""


def _exposures(ev: DataFrame) -> DataFrame:
    return experiments.first_exposures(ev.filter("event_type = 'signup'").select(F.col("distinct_id").alias("user"), F.expr(_VARIANT).alias("variant"), "ts_ms"))


query("exposure_first", "events", _EXPOSED + ' SELECT "user", variant, first_ms FROM f')(_exposures)
for _how, _sql in (("binary", "max(CASE WHEN inside THEN 1.0 ELSE 0.0 END)"), ("count", "count(*) FILTER (inside)"), ("sum", "coalesce(sum(v) FILTER (inside), 0)")):
    query(f"experiment_{_how}", "events", _EXPOSED + f""", j AS (SELECT f."user", variant, coalesce(e.ts_ms BETWEEN first_ms AND first_ms + {7 * DAY_MS}, false) AS inside, round(e.value * 100) AS v FROM f LEFT JOIN ev e ON e.distinct_id = f."user" AND e.event_type = 'purchase'),
  u AS (SELECT "user", variant, CAST({_sql} AS DOUBLE) AS value FROM j GROUP BY 1, 2) SELECT variant, count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance FROM u GROUP BY 1""")(
        lambda ev, h=_how: rounded(experiments.arms(experiments.user_values(_exposures(ev), ev.filter("event_type = 'purchase'").select(F.col("distinct_id").alias("user"), "ts_ms", F.round(F.col("value") * 100).alias("value")), 7 * DAY_MS, h)), mean=6, variance=4)
    )
_BUCKET = "CAST(('0x' || substr(sha256(concat('k:', distinct_id)), 1, 4)) AS INT) % 100 + 1"
query("flag_buckets", "events", f"SELECT DISTINCT distinct_id, {_BUCKET} AS bucket, {_BUCKET} <= 30 AND country = 'DE' AS enabled, CASE WHEN {_BUCKET} <= 40 THEN 'a' WHEN {_BUCKET} <= 90 THEN 'b' ELSE '' END AS variant FROM ev")(
    lambda ev: ev.select("distinct_id", "country").distinct().select(
        "distinct_id", stable_bucket(F.lit("k"), F.col("distinct_id")).alias("bucket"),
        experiments.flag([{"attribute": "country", "op": "eq", "value": "DE"}], F.create_map(F.lit("country"), F.col("country")), "k", F.col("distinct_id"), 30).alias("enabled"),
        experiments.variant_of("k", F.col("distinct_id"), {"a": 40, "b": 50}).alias("variant"),
    )
)

# --- rollups, lookups, alerts --------------------------------------------------------------------------------------

query("rollup_hourly", "events", f"SELECT ts_ms // {HOUR_MS} * {HOUR_MS} AS bucket_ms, pathname, event_type, count(*) AS events, count(DISTINCT session_id) AS sessions, count(DISTINCT visit_id) AS visits FROM ev GROUP BY 1, 2, 3")(rollups.hourly)
query("rollup_daily", "events", f"SELECT ts_ms // {DAY_MS} * {DAY_MS} AS bucket_ms, event_type, browser, country, count(*) AS events, count(DISTINCT session_id) AS sessions FROM ev GROUP BY 1, 2, 3, 4")(rollups.daily)
query("rollup_sessions", "events", f""", late AS (SELECT session_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS events, arg_min(pathname, (ts_ms, event_id)) FILTER (event_type = 'pageview') AS entry_page FROM ev WHERE ts_ms >= {START_MS + 10 * DAY_MS} GROUP BY 1),
  old AS (SELECT session_id, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, count(*) AS events, arg_min(pathname, (ts_ms, event_id)) FILTER (event_type = 'pageview') AS entry_page FROM ev WHERE ts_ms < {START_MS + 20 * DAY_MS} GROUP BY 1)
SELECT coalesce(l.session_id, o.session_id) AS session_id, least(o.first_ms, l.first_ms) AS first_ms, greatest(o.last_ms, l.last_ms) AS last_ms,
  CASE WHEN l.events IS NULL THEN o.events WHEN o.first_ms < l.first_ms THEN greatest(o.events, l.events) ELSE l.events END AS events, CASE WHEN l.events IS NULL OR o.first_ms < l.first_ms THEN o.entry_page ELSE l.entry_page END AS entry_page
FROM late l FULL JOIN old o USING (session_id)""")(
    lambda ev: rollups.session_summaries(traffic.sessions(ev.filter(F.col("ts_ms") >= START_MS + 10 * DAY_MS)), traffic.sessions(ev.filter(F.col("ts_ms") < START_MS + 20 * DAY_MS)))
)
query("retention_ttl", "events", f"SELECT count(*) AS events FROM ev WHERE ts_ms >= {END_MS - 7 * DAY_MS}")(lambda ev: rollups.expired(ev, END_MS, 7).agg(F.count("*").alias("events")))


def collapse_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each customer."""
    return rollups.latest(model.table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


def pages_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host."""
    return model.table(spark, sf_dir, "pages").groupBy(host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"), F.max_by("url", "page_id").alias("newest_url"))


def order_as_of_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line with its supplier's last line shipped before or at the order's time: an as-of join by supplier."""
    line = model.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity").groupBy("l_suppkey", "l_shipdate").agg(F.max("l_quantity").alias("l_quantity"))
    order = model.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).alias("l_suppkey"), F.col("o_orderdate").alias("l_shipdate"))
    return lookups.as_of(order, line, "l_suppkey", "l_shipdate", "l_quantity")


def prices_in_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by band of total price: a range join."""
    bands = spark.createDataFrame([(f"band{i}", i * 50_000.0, i * 50_000.0 + 49_999.99) for i in range(12)], "band string, lo double, hi double")
    return lookups.in_ranges(model.table(spark, sf_dir, "orders"), bands, "o_totalprice", 25_000).groupBy("band").agg(F.count("*").alias("orders"))


def model_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts priced by the longest prefix of their type."""
    rows = [(None, p, 0, float(len(p))) for p in ("S", "STANDARD", "ECONOMY", "E", "PROMO")] + [("Brand#11", "S", 0, 99.0), (None, "E", 10, 7.0), (None, "S", 10**15, 1.0)]
    prices = spark.createDataFrame(rows, "provider string, prefix string, valid_from_ms long, price double")
    calls = model.table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("model"), F.col("p_brand").alias("provider"))
    return lookups.price_of(calls, prices, "p_partkey", 10**13)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as journeys: transitions between roles."""
    talk = model.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("role").alias("pathname"), F.col("turn").alias("ts_ms"), F.col("turn").alias("event_id"), F.lit("pageview").alias("event_type"))
    return sequences.journey_edges(talk)


def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three customers with most orders of each market segment."""
    joined = model.table(spark, sf_dir, "orders").join(model.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return traffic.ranked(joined.groupBy("c_mktsegment", "c_custkey").agg(F.count("*").alias("orders")), "c_mktsegment", "orders", 3)


for _f in (collapse_latest, pages_by_host, order_as_of_ship, prices_in_ranges, model_prices, turns, top_customers):
    QUERIES[_f.__name__] = _f
ORACLE_SQL |= {
    "collapse_latest": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY 1",
    "pages_by_host": "SELECT regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\\.', '') AS host, count(*) AS pages, arg_max(url, page_id) AS newest_url FROM pages GROUP BY 1",
    "order_as_of_ship": "SELECT o.o_orderkey, o.o_orderkey % 10 AS l_suppkey, o.o_orderdate AS l_shipdate, l.l_quantity FROM orders o ASOF LEFT JOIN (SELECT l_suppkey, l_shipdate, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) l ON l.l_suppkey = o.o_orderkey % 10 AND o.o_orderdate >= l.l_shipdate",
    "prices_in_ranges": "SELECT concat('band', i) AS band, count(*) AS orders FROM orders JOIN range(12) t(i) ON o_totalprice BETWEEN i * 50000.0 AND i * 50000.0 + 49999.99 GROUP BY 1",
    "model_prices": """WITH p AS (SELECT * FROM (VALUES (NULL, 'S', 1.0), (NULL, 'STANDARD', 8.0), (NULL, 'ECONOMY', 7.0), (NULL, 'E', 7.0), (NULL, 'PROMO', 5.0), ('Brand#11', 'S', 99.0)) t(provider, prefix, price)),
  m AS (SELECT p_partkey, arg_max(price, (p.provider IS NOT NULL, length(prefix))) AS price FROM part JOIN p ON starts_with(p_type, prefix) AND (p.provider IS NULL OR p.provider = p_brand) GROUP BY 1)
SELECT part.p_partkey, p_type AS model, p_brand AS provider, CAST(price AS DOUBLE) AS price FROM part LEFT JOIN m USING (p_partkey)""",
    "turns": """WITH v AS (SELECT * FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE role IS DISTINCT FROM prev),
  e AS (SELECT role AS source, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM v) SELECT source, target, count(*) AS transitions FROM e WHERE target IS NOT NULL GROUP BY 1, 2""",
    "top_customers": "WITH n AS (SELECT c_mktsegment, c_custkey, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT c_mktsegment, c_custkey, orders, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY orders DESC, c_custkey) AS INT) AS rank FROM n QUALIFY rank <= 3",
}
QUERIES |= records.QUERIES | views.QUERIES | schedules.QUERIES | logsearch.QUERIES | spans.QUERIES | issues.QUERIES | alerting.QUERIES | privacy.QUERIES | admission.QUERIES | coverage.QUERIES
ORACLE_SQL |= records.ORACLE_SQL | views.ORACLE_SQL | schedules.ORACLE_SQL | logsearch.ORACLE_SQL | spans.ORACLE_SQL | issues.ORACLE_SQL | alerting.ORACLE_SQL | privacy.ORACLE_SQL | admission.ORACLE_SQL | coverage.ORACLE_SQL
