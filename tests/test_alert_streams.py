"""The alert machine over a stream, stopped and started again, against its batch form and fixed vectors."""

import random

import pytest

from tidemark.operators import alerts
from tidemark.streaming import alerts as stream_alerts

SCHEMA = "rule string, ts_ms long, value double, samples long, operator string, threshold double, min_samples int, cooldown_min int"
MINUTE = 60_000


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def batch(spark, rows, *args):
    return [tuple(r) for r in alerts.incidents(spark.createDataFrame(rows, SCHEMA), *args).orderBy("rule", "ts_ms").collect()]


def tick(minute, value, samples=9, rule="r", operator="gt", threshold=10.0, least=1, cooldown=0):
    return (rule, minute * MINUTE, value, samples, operator, threshold, least, cooldown)


@pytest.mark.parametrize(("operator", "firing"), [("gt", [11]), ("gte", [10, 11]), ("lt", [9]), ("lte", [9, 10]), ("eq", [10]), ("ne", [])])
def test_operators(spark, operator, firing):
    rows = [tick(i, float(v), operator=operator) for i, v in enumerate((9, 10, 11))]
    assert [int(r[2]) for r in batch(spark, rows) if r[5] == "firing"] == firing


def test_silence_and_missing_data_decide_nothing(spark):
    rows = [tick(0, 5.0), tick(1, 50.0), tick(2, None), tick(3, 5.0, 0), tick(4, 50.0), tick(5, 5.0), tick(6, 5.0, 0), tick(7, 50.0)]
    out = batch(spark, rows)
    assert [(r[4], r[5], r[6], r[7]) for r in out] == [
        ("", "healthy", None, ""), ("healthy", "firing", MINUTE, "incident_opened"), ("firing", "unavailable", MINUTE, ""), ("unavailable", "no_data", MINUTE, ""), ("no_data", "firing", MINUTE, ""),
        ("firing", "healthy", MINUTE, "incident_recovered"), ("healthy", "no_data", None, ""), ("no_data", "firing", 7 * MINUTE, "incident_opened"),
    ]


def test_repeats_after_the_cooldown(spark):
    rows = [tick(i, 50.0, cooldown=3) for i in (0, 1, 2, 4, 5, 7, 11)] + [tick(12, 1.0, cooldown=3), tick(13, 50.0, cooldown=3)]
    assert [(r[1] // MINUTE, r[7]) for r in batch(spark, rows) if r[7]] == [(0, "incident_opened"), (4, "incident_repeat"), (7, "incident_repeat"), (11, "incident_repeat"), (12, "incident_recovered"), (13, "incident_opened")]
    assert [r[7] for r in batch(spark, [tick(i, 50.0, least=9) for i in range(3)])] == ["incident_opened", "", ""]
    assert batch(spark, []) == []


def test_stream_equals_batch(spark, tmp_path, rocks):
    """Seven files in three runs from one checkpoint, replayed rows included; silences come inside and between files."""
    rng = random.Random(2)
    rows, at = [], dict.fromkeys("abcd", 0)
    for _ in range(160):
        rule = rng.choice("abcd")
        at[rule] += rng.choice([1, 1, 1, 2, 7])
        rows.append(tick(at[rule], rng.choice([None, 1.0, 10.0, 20.0, 20.0, 20.0]), rng.choice([0, 3, 9]), rule, rng.choice(["gt"]), 10.0, 2, {"a": 0, "b": 2, "c": 5, "d": 9}[rule]))
    rows.sort(key=lambda r: r[1])
    end = 10_000
    files = [rows[i : i + 25] for i in range(0, len(rows), 25)]
    files[2] += files[1][-3:]
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))

    def run():
        evaluations = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        out = stream_alerts.incidents(evaluations, 5 * MINUTE, "0 seconds")
        query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination(170)
        assert query.exception() is None

    for part in (files[:3], files[3:5], files[5:] + [[tick(end, 1.0, rule="clock")]]):
        for f in part:
            spark.createDataFrame(f, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run()
    found = [tuple(r) for r in spark.read.parquet(sink).filter("rule <> 'clock'").orderBy("rule", "ts_ms").collect()]
    expected = batch(spark, rows, 5 * MINUTE, end * MINUTE)
    assert len(found) == len(set(found)) and found == expected
    assert {r[7] for r in found} == {"", "incident_opened", "incident_repeat", "incident_recovered"} and any(r[2] is None and r[3] == 0 for r in found)
