"""Streams over small files against their batch forms."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.streaming import jobs


def stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def finish(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def at(minute):
    return dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=minute)


def test_ingest_drops_bots_and_replays(spark, tmp_path):
    rows = [(1, at(0), "https://s.example/p/?utm_source=google", "", "Firefox"), (1, at(0), "https://s.example/p/?utm_source=google", "", "Firefox"), (2, at(1), "https://s.example/", "https://t.co/x", "Googlebot"), (3, at(2), "https://s.example/", "https://t.co/x", "Safari")]
    df = stream(spark, rows, "event_id long, ts timestamp, url string, referrer string, agent string", str(tmp_path / "in"))
    found = finish(jobs.ingested(df), "ingested").select("event_id", "pathname", "channel").collect()
    assert sorted(tuple(r) for r in found) == [(1, "/p", "Organic Search"), (3, "/", "Social")]


def test_rollups_of_closed_and_open_hours(spark, tmp_path):
    rows = [(i, at(i * 7), i % 3, "click" if i % 2 else "error") for i in range(100)]
    df = stream(spark, rows, "event_id long, ts timestamp, user_id long, event_type string", str(tmp_path / "in"))
    hours = finish(jobs.hourly(df), "hours", "complete")
    assert hours.agg(F.sum("events")).first()[0] == 100
    windows = finish(jobs.look_back(df, "30 minutes", "10 minutes"), "windows", "complete")
    assert windows.agg(F.sum("samples")).first()[0] == 300
    assert finish(jobs.idle_sessions(df, "10 minutes"), "idle").count() >= 1


def test_evaluations_are_kept_once(spark, tmp_path):
    rows = [(at(0), "s", "f", "on", "u"), (at(5), "s", "f", "on", "u"), (at(6), "s", "f", "off", "u"), (at(7), "s", "f", "on", "v"), (at(8), "s", "f", "on", "v")]
    df = stream(spark, rows, "ts timestamp, site_id string, flag_key string, variant string, user_id string", str(tmp_path / "in"))
    found = finish(jobs.evaluations(df), "evaluations").select("variant", "user_id").collect()
    assert sorted(map(tuple, found)) == [("off", "u"), ("on", "u"), ("on", "v")]
