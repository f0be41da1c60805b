"""Structured Streaming forms: ingest with de-duplication, rollups of closed hours and alert states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.web import browser, channel, device, is_bot, operating_system, os_version, path, utm
from tidemark.streaming.keyed import KeyedTable


def ingested(raw: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events (event_id, ts, url, referrer, agent, ..) without bots and replays, with path, campaign, channel and agent."""
    kept = raw.filter(~is_bot(F.col("agent"))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    named = {f"utm_{name}": utm(F.col("url"), name) for name in ("source", "medium", "campaign", "term", "content")}
    agent = F.col("agent")
    by = {"browser": browser(agent)["name"], "browser_version": browser(agent)["version"], "os": operating_system(agent), "os_version": os_version(agent), "device": device(agent)}
    return kept.withColumns({"pathname": path(F.col("url")), "channel": channel(named["utm_source"], named["utm_medium"], F.col("referrer"))} | named | by)


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by hour and type. In append mode an hour appears once it has closed; run rollups.hourly for open ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events"), F.approx_count_distinct("user_id").alias("users"))


def look_back(events: DataFrame, width: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """Error rate over sliding windows, for alert rules."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("samples"), F.avg((F.col("event_type") == "error").cast("double")).alias("value"))


def idle_sessions(events: DataFrame, gap: str, late: str = "2 hours") -> DataFrame:
    """Gap-based sessions of users."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("events"))


def evaluations(raw: DataFrame, window: str = "1 hour") -> DataFrame:
    """Flag evaluations (ts, site_id, flag_key, variant, user_id), one per key while the watermark is within window of it."""
    return raw.withWatermark("ts", window).dropDuplicatesWithinWatermark(["site_id", "flag_key", "variant", "user_id"])


def upsert(table: KeyedTable):
    """A foreachBatch sink that merges each micro-batch into a keyed table, once."""

    def write(batch: DataFrame, number: int) -> None:
        table.merge(batch, number)

    return write
