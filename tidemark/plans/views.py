"""Named queries of lists, panels and address lookups, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lookups, views
from tidemark.sources import model
from tidemark.sources.model import DAY_MS, HOUR_MS, SQL_EVENTS

START_MS = 1_704_067_200_000
LO, HI = START_MS + 5 * DAY_MS, START_MS + 15 * DAY_MS
#: Ranges that don't overlap: family, bounds, country.
RANGES = [(False, 0x0A000000, 0x0AFFFFFF, "DE"), (False, 0x0B000000, 0x0B0000FF, "FR"), (False, 0x0C010000, 0x0C02FFFF, "US"), (True, 0x20010DB800000000, 0x20010DB8000000FF, "SE"), (True, 0x2A00000000000000, 0x2A0FFFFFFFFFFFFF, "NO")]


def _replays(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A replay per visit, and error events of which some name their session and some their replay."""
    ev = model.events(spark, sf_dir)
    replays = ev.groupBy(F.col("visit_id").alias("replay_id"), "session_id", "distinct_id").agg(
        F.min("ts_ms").alias("start_ms"), (F.max("ts_ms") - F.min("ts_ms")).alias("duration_ms"), F.concat(F.lit("https://Example.org"), F.min_by("pathname", F.struct("ts_ms", "event_id"))).alias("url"),
        F.bool_or(F.col("event_id") % 50 == 0).alias("has_error"),
    )
    n = F.col("event_id")
    errors = ev.filter("event_type = 'error'").select("ts_ms", F.when(n % 4 == 0, F.col("session_id")).otherwise("").alias("session_id"), F.when(n % 3 == 0, F.col("visit_id")).otherwise("").alias("replay_id"))
    return replays, errors


def replays_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of replays with errors whose address holds a part written in another case."""
    return views.filtered_replays(*_replays(spark, sf_dir), LO, HI, url="example.ORG/1", with_errors=True, n=50, skip=5)


def replays_of_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.filtered_replays(*_replays(spark, sf_dir), START_MS, HI, person="7")


def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten groups; seven have members, some of which name no session."""
    ev = model.events(spark, sf_dir)
    groups = spark.range(10).select(F.concat(F.lit("g"), "id").alias("group_id"))
    members = ev.filter("event_id % 3 = 0").select(F.concat(F.lit("g"), F.col("distinct_id").cast("long") % 7).alias("group_id"), F.when(F.col("event_id") % 5 > 0, F.col("session_id")).otherwise("").alias("session_id"))
    return views.group_metrics(groups, members, ev, LO, HI)


def link_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as links, customers as clicks; the last nations have none."""
    links = model.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("link_id"), F.col("n_name").alias("name"))
    return views.link_clicks(links, model.table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 20).alias("link_id")))


def _panel(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return views.panel(model.events(spark, sf_dir), model.errors(spark, sf_dir), kind, LO, HI)


def panel_error_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.error_panel(model.errors(spark, sf_dir), LO, HI, "day")


def geo_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the country of an address made of user and property, in IPv4, IPv6, mapped and broken forms."""
    user, k, form = F.col("distinct_id").cast("long"), F.col("k"), F.col("event_id") % 5
    four = F.concat_ws(".", 9 + user % 4, k % 4, user % 3, k)
    six = F.when(user % 2 == 0, F.concat(F.lit("2001:DB8:0:"), F.lower(F.hex(k * 5)), F.lit("::1"))).otherwise(F.concat(F.lit("2a"), F.lpad(F.hex(k % 32), 2, "0"), F.lit("::"), k % 10))
    ip = F.when(form == 0, six).when(form == 1, F.concat(F.lit("::ffff:"), four)).when(form == 2, F.concat(four, F.lit(".1"))).otherwise(four)
    ranges = spark.createDataFrame(RANGES, "v6 boolean, lo long, hi long, country string")
    visits = model.events(spark, sf_dir).select("event_id", ip.alias("ip"))
    return lookups.country_of(visits, ranges, "ip").groupBy("country").agg(F.count("*").alias("events"))


QUERIES = {f.__name__: f for f in (replays_filtered, replays_of_person, group_metrics, link_clicks, panel_error_series, geo_countries)}
QUERIES |= {f"panel_{kind}": partial(_panel, kind=kind) for kind in ("pageviews", "visitors", "errors")}
_WITHIN = f"ts_ms >= {LO} AND ts_ms < {HI}"
_REPLAYS = f"""WITH {SQL_EVENTS}, r AS (SELECT visit_id AS replay_id, session_id, distinct_id, min(ts_ms) AS start_ms, max(ts_ms) - min(ts_ms) AS duration_ms,
    concat('https://Example.org', arg_min(pathname, (ts_ms, event_id))) AS url, bool_or(event_id % 50 = 0) AS has_error FROM ev GROUP BY 1, 2, 3),
  er AS (SELECT if(event_id % 4 = 0, session_id, '') AS session_id, if(event_id % 3 = 0, visit_id, '') AS replay_id FROM ev WHERE event_type = 'error' AND ts_ms >= {LO} AND ts_ms < {HI + HOUR_MS})
SELECT * FROM r WHERE"""
ORACLE_SQL = {
    "replays_filtered": f"""{_REPLAYS} start_ms >= {LO} AND start_ms < {HI} AND url ILIKE '%example.org/1%'
  AND (has_error OR (session_id <> '' AND session_id IN (SELECT session_id FROM er)) OR replay_id IN (SELECT replay_id FROM er WHERE replay_id <> '')) ORDER BY start_ms DESC, replay_id LIMIT 50 OFFSET 5""",
    "replays_of_person": f"{_REPLAYS} start_ms >= {START_MS} AND start_ms < {HI} AND distinct_id = '7' ORDER BY start_ms DESC, replay_id LIMIT 20",
    "group_metrics": f"""WITH {SQL_EVENTS}, m AS (SELECT DISTINCT concat('g', CAST(distinct_id AS BIGINT) % 7) AS group_id, session_id FROM ev WHERE event_id % 3 = 0 AND event_id % 5 > 0)
SELECT group_id, (SELECT count(*) FROM m WHERE m.group_id = g.group_id) AS members,
  (SELECT count(*) FROM ev WHERE {_WITHIN} AND session_id IN (SELECT session_id FROM m WHERE m.group_id = g.group_id)) AS events FROM (SELECT concat('g', i) AS group_id FROM range(10) t(i)) g""",
    "link_clicks": "SELECT n_nationkey AS link_id, n_name AS name, count(c_custkey) AS clicks FROM nation LEFT JOIN customer ON c_nationkey % 20 = n_nationkey GROUP BY 1, 2",
    "panel_pageviews": f"WITH {SQL_EVENTS} SELECT count(*) AS value FROM ev WHERE event_type = 'pageview' AND {_WITHIN}",
    "panel_visitors": f"WITH {SQL_EVENTS} SELECT count(DISTINCT session_id) AS value FROM ev WHERE {_WITHIN}",
    "panel_errors": f"WITH {SQL_EVENTS} SELECT count(*) AS value FROM ev WHERE event_type = 'error' AND {_WITHIN}",
    "panel_error_series": f"WITH {SQL_EVENTS} SELECT ts_ms // {DAY_MS} * {DAY_MS} AS bucket, count(*) AS errors FROM ev WHERE event_type = 'error' AND {_WITHIN} GROUP BY 1",
    "geo_countries": f"""WITH {SQL_EVENTS}, v AS (SELECT event_id % 5 AS form, CAST(distinct_id AS BIGINT) AS u, k FROM ev),
  c AS (SELECT CASE WHEN form = 2 THEN '' WHEN form = 0 AND u % 2 = 0 THEN if(k * 5 <= 255, 'SE', '') WHEN form = 0 THEN if(k % 32 < 16, 'NO', '')
    WHEN u % 4 = 1 THEN 'DE' WHEN u % 4 = 2 THEN if(k % 4 = 0 AND u % 3 = 0, 'FR', '') WHEN u % 4 = 3 THEN if(k % 4 IN (1, 2), 'US', '') ELSE '' END AS country FROM v)
SELECT country, count(*) AS events FROM c GROUP BY 1""",
}
