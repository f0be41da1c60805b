"""Named queries of traffic from raw, rolled-up and session tables as retention leaves them, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import rollups, tiers, traffic
from tidemark.sources import model
from tidemark.sources.model import DAY_MS, SQL_EVENTS

START_MS = 1_704_067_200_000
NOW_MS = START_MS + 30 * DAY_MS
RAW_DAYS, SESSION_DAYS = 10, 20
#: Period: days before now, and filters.
PERIODS = {"day": (1, {}), "week": (6, {}), "fortnight": (15, {}), "month": (30, {}), "month_country": (30, {"country": "DE"}), "month_page": (30, {"pathname": "/4"}), "week_page": (6, {"pathname": "/4"}), "week_browser": (6, {"browser": "Firefox"})}


def _tiers(spark: SparkSession, sf_dir: str) -> tiers.Tiers:
    ev = model.events(spark, sf_dir)
    return tiers.Tiers(rollups.expired(ev, NOW_MS, RAW_DAYS), rollups.hourly(ev), rollups.daily(ev), traffic.sessions(ev).filter(F.col("first_ms") >= NOW_MS - SESSION_DAYS * DAY_MS), RAW_DAYS, SESSION_DAYS)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per period: pageviews and visitors from whichever table answers, and what it covers."""
    of = _tiers(spark, sf_dir)
    rows = [of.pageviews(NOW_MS - d * DAY_MS, NOW_MS, f).join(F.broadcast(of.visitors(NOW_MS - d * DAY_MS, NOW_MS, NOW_MS, f))).withColumn("period", F.lit(name)) for name, (d, f) in PERIODS.items()]  # one row each
    return reduce(DataFrame.unionByName, rows)


def _row(name: str, days: int, table: str, pages: str, visitors: str, source: str, exact: bool, covered: int, note: str) -> str:
    return f"SELECT ({pages}) AS pageviews, '{table}' AS \"table\", ({visitors}) AS visitors, '{source}' AS source, {exact} AS exact, {NOW_MS - covered * DAY_MS} AS covered_from_ms, '{note}' AS note, '{name}' AS period"


def _pages(days: int, test: str = "true") -> str:
    return f"SELECT count(*) FILTER (event_type = 'pageview' AND ts_ms >= {NOW_MS - days * DAY_MS} AND ts_ms < {NOW_MS} AND {test}) FROM ev"


def _raw(days: int, test: str = "true") -> str:
    return f"SELECT count(DISTINCT session_id) FILTER (event_type = 'pageview' AND ts_ms >= {NOW_MS - days * DAY_MS} AND ts_ms < {NOW_MS} AND {test}) FROM ev"


def _began(days: int, test: str = "true") -> str:
    return f"SELECT count(*) FROM (SELECT min(ts_ms) AS first_ms, arg_min(country, (ts_ms, event_id)) AS country FROM ev GROUP BY session_id) WHERE first_ms >= {NOW_MS - days * DAY_MS} AND first_ms < {NOW_MS} AND {test}"


_LATE = "Visitor counts cover the last 20 days of this range, not all of it — per-visitor data older than that has been removed by retention. Pageviews still cover the whole range."
_FORCED = "Visitor counts cover the last 10 days of this range, not all of it — the active filter can only be applied to raw events, which retention keeps for that long."
QUERIES = {"tier_answers": _answers}
ORACLE_SQL = {
    "tier_answers": f"WITH {SQL_EVENTS} " + " UNION ALL ".join((
        _row("day", 1, "events", _pages(1), _raw(1), "events", True, 1, ""), _row("week", 6, "stats_hourly", _pages(6), _raw(6), "events", True, 6, ""), _row("fortnight", 15, "stats_daily", _pages(15), _began(15), "sessions", True, 15, ""),
        _row("month", 30, "stats_daily", _pages(30), _began(20), "sessions", False, 20, _LATE), _row("month_country", 30, "stats_daily", _pages(30, "country = 'DE'"), _began(20, "country = 'DE'"), "sessions", False, 20, _LATE),
        _row("month_page", 30, "events", _pages(10, "pathname = '/4'"), _raw(10, "pathname = '/4'"), "events", False, 10, _FORCED), _row("week_page", 6, "stats_hourly", _pages(6, "pathname = '/4'"), _raw(6, "pathname = '/4'"), "events", True, 6, ""),
        _row("week_browser", 6, "events", _pages(6, "browser = 'Firefox'"), _raw(6, "browser = 'Firefox'"), "events", True, 6, ""),
    )),
}
