"""Telemetry payloads, keyed digests and changing records on hand-made rows."""

import hashlib
import hmac
import json

from pyspark.sql import functions as F

from tidemark.functions.digests import hmac_sha256, identity_matches
from tidemark.operators import records, telemetry


def test_hmac_equals_the_standard_one(spark):
    texts = ["", "a", "Grüße 你", "x" * 200]
    for key in (b"k", b"\xff" * 64, b"long" * 40):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select(hmac_sha256(F.col("t"), key)).collect()
        assert [r[0] for r in got] == [hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]
    signed = spark.createDataFrame([("u", hmac.new(b"k", b"u", hashlib.sha256).hexdigest()), ("u", None), (None, "x")], "p string, s string")
    assert [r[0] for r in signed.select(identity_matches(F.col("p"), F.col("s"), b"k")).collect()] == [True, False, False]


def test_chain_breaks(spark):
    rows, before = [], ""
    for n in range(6):
        digest = hmac.new(b"k", f"{before}\np{n}".encode(), hashlib.sha256).hexdigest()
        rows.append(("a", n, f"p{n}", before, digest))
        before = digest
    whole = spark.createDataFrame(rows, "log string, seq int, payload string, previous string, digest string")
    assert records.chain_breaks(whole, b"k").count() == 0
    assert [r["seq"] for r in records.chain_breaks(whole.filter("seq <> 2"), b"k").collect()] == [3]
    changed = whole.withColumn("payload", F.when(F.col("seq") == 4, "other").otherwise(F.col("payload")))
    assert [r["seq"] for r in records.chain_breaks(changed, b"k").collect()] == [4]


def test_levels(spark):
    cases = [(None, n) for n in (None, 0, 1, 4, 5, 9, 13, 17, 21, 24)] + [("WARNING", 17), (" ", 17)]
    got = spark.createDataFrame(cases, "t string, n int").select(telemetry.level(F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in got] == ["info", "info", "trace", "trace", "debug", "info", "warn", "error", "fatal", "fatal", "warning", "error"]


def test_attributes_and_bad_payloads(spark):
    attributes = [{"key": "s", "value": {"stringValue": "a"}}, {"key": "n", "value": {"intValue": "7"}}, {"key": "b", "value": {"boolValue": True}}, {"key": "none", "value": {}}, {"key": "s", "value": {"stringValue": "b"}}]
    span = {"traceId": "t", "spanId": "1", "name": "op", "startTimeUnixNano": "1704067200123456789", "endTimeUnixNano": 1704067200125000000, "attributes": attributes, "status": {"code": 2}}
    payload = {"resourceSpans": [{"scopeSpans": [{"spans": [span, {"traceId": "t"}]}]}, {}]}
    got = telemetry.spans(spark.createDataFrame([(json.dumps(payload),), ("no json",), (None,), ("{}",)], "payload string")).collect()
    assert len(got) == 1
    assert got[0]["attributes"] == {"s": "b", "n": "7", "b": "true"}
    assert (got[0]["start_ms"], got[0]["duration_ms"], got[0]["is_error"], got[0]["service"], got[0]["parent_span_id"]) == (1704067200123, 2, True, "", None)


def test_histogram_points(spark):
    point = {"timeUnixNano": "5", "count": "3", "sum": 4.5, "bucketCounts": ["1", "2"], "explicitBounds": [10]}
    metrics = [{"name": "h", "histogram": {"dataPoints": [point], "aggregationTemporality": 2}}, {"name": "s", "summary": {"dataPoints": [point]}}, {"name": "g", "gauge": {"dataPoints": [{"timeUnixNano": "6", "asDouble": 1.5}]}}]
    payload = json.dumps({"resourceMetrics": [{"resource": {}, "scopeMetrics": [{"metrics": metrics}]}]})
    got = {r["metric"]: r for r in telemetry.metric_points(spark.createDataFrame([(payload,)], "payload string")).collect()}
    assert set(got) == {"h", "g"}
    assert (got["h"]["counts"], got["h"]["bounds"], got["h"]["temporality"], got["h"]["ts_ns"]) == ([1, 2], [10.0], "cumulative", 5)
    assert (got["g"]["value"], got["g"]["temporality"]) == (1.5, None)


def test_surveys_without_values(spark):
    rows = spark.createDataFrame([("/a/b", "mobile", None, "u"), (None, "mobile", None, "u"), ("/a/b", None, None, "u")], "url string, device string, referrer string, person string")
    shown = records.survey_shown(F.col("url"), F.col("device"), F.col("referrer"), F.col("person"), key="k", prefix="/a", on=["mobile"])
    assert [r[0] for r in rows.select(shown).collect()] == [True, False, False]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "issue string, ts_ms long")
    assert records.issue_states(none, spark.createDataFrame([], "issue string, ts_ms long, status string"), "issue").count() == 0
    assert telemetry.spans(spark.createDataFrame([], "payload string")).count() == 0
