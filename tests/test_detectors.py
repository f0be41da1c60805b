"""Span detectors, ranks, bounds, release series and channels against fixed vectors."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions.web import channel
from tidemark.operators import detectors, errors, ranks, tracing, traffic
from tidemark.sources.model import DAY_MS

SPANS = "trace_id string, span_id string, parent_span_id string, service string, operation string, kind string, start_ms long, end_ms long, duration_ms long, statement string, db_system string, http_url string, http_host string"


def span(i, start, ms, statement="", parent="p1", operation="db.query", kind="internal", system="", url="", host="", trace="t1"):
    return (trace, f"s{i:03}", parent, "api", operation, kind, start, start + ms, ms, statement, system, url, host)


def test_fingerprints(spark):
    cases = {
        "SELECT * FROM users WHERE id = 12345": "SELECT * FROM users WHERE id = ?", "SELECT * FROM users WHERE name = 'tyler'": "SELECT * FROM users WHERE name = ?", "SELECT  *   FROM\tusers": "SELECT * FROM users", "random text": "", "": "",
        "select * from t0 where v2.x = 1.5": "select * from t? where v?x = ?", "  \n insert into t values ('a\\'b', 'c''d', 7)": "insert into t values (?, ??, ?)", "UPDATE t SET a = 'open \\": "UPDATE t SET a = ?", "WITH x AS (SELECT 1) SELECT 2": "",
        "REPLACE INTO t VALUES (1)": "", "DELETE FROM t WHERE a='1'AND b=2": "DELETE FROM t WHERE a=?AND b=?", "MERGE INTO t": "", "SELECT 'a\nb'\n,1": "SELECT ? ,?",
    }
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    assert {r["s"]: r["f"] for r in df.select("s", detectors.fingerprint(F.col("s")).alias("f")).collect()} == cases


def run(spark, detector, rows, *args):
    return detector(spark.createDataFrame(rows, SPANS), *args).orderBy("trace_id", "fingerprint").collect()


def test_repeated_queries(spark):
    same = [span(i, 10 * i, 5, f"SELECT * FROM users WHERE id = {i}") for i in range(4)]
    found = run(spark, detectors.repeated_queries, same)
    assert [(r["kind"], r["title"], r["description"], r["first_ms"], r["last_ms"], r["severity"]) for r in found] == [("n_plus_one_db", "N+1 query: 4 repeated DB calls", "api — SELECT * FROM users WHERE id = ?", 0, 35, "warning")]
    assert not run(spark, detectors.repeated_queries, same[:3])
    assert not run(spark, detectors.repeated_queries, [*same[:2], span(9, 15, 1, "SELECT 1"), *same[2:]])  # a run in between
    assert not run(spark, detectors.repeated_queries, [*same[:2], span(9, 15, 1, "BEGIN"), *same[2:]])  # no fingerprint ends a run
    assert len(run(spark, detectors.repeated_queries, [*same[:2], span(9, 15, 1, "x", operation="render"), *same[2:]])) == 0
    assert len(run(spark, detectors.repeated_queries, [*same[:2], span(9, 15, 1, "", operation="render"), *same[2:]])) == 1  # not a query at all
    assert not run(spark, detectors.repeated_queries, [(*r[:2], None, *r[3:]) for r in same])  # roots
    two = [span(i, 10 * i, 5, f"SELECT {i} FROM a") for i in range(5)] + [span(9, 60, 1, "SELECT x")] + [span(i, 10 * i, 5, f"SELECT {i} FROM b") for i in range(10, 15)]
    assert [r["description"] for r in run(spark, detectors.repeated_queries, two)] == ["api — SELECT ? FROM a"]  # the first of equal runs
    by_name = [span(i, i, 1, operation="SELECT * FROM t WHERE id = 7", system="pg") for i in range(4)]
    assert len(run(spark, detectors.repeated_queries, by_name)) == 1


def of_service(row, name):
    return (*row[:3], name, *row[4:])


@pytest.mark.parametrize("services", [("api", "web"), ("web", "api")])
def test_repeated_queries_alike_but_for_their_service(spark, services):
    rows = [of_service(span(1, 0, 5, "SELECT 1"), s) for s in services] + [span(2, 10, 5, "SELECT 2")]
    df = spark.createDataFrame(rows, SPANS).coalesce(1)  # in this order
    assert [(r["title"], r["description"]) for r in detectors.repeated_queries(df, 2).collect()] == [("N+1 query: 3 repeated DB calls", "api — SELECT ?")]


def test_serial_queries(spark):
    apart = [span(i, 100 * i, 60, f"SELECT {c} FROM t") for i, c in enumerate("abc")]
    found = run(spark, detectors.serial_queries, apart)
    assert [(r["title"], r["description"], r["first_ms"], r["last_ms"]) for r in found] == [("3 serial DB queries (180ms total)", "api — consider parallelizing or batching", 0, 260)]
    assert not run(spark, detectors.serial_queries, [span(i, 10 * i, 60, "SELECT 1") for i in range(3)])  # overlapping
    assert not run(spark, detectors.serial_queries, [span(i, 100 * i, 30, "SELECT 1") for i in range(3)])  # 90 ms together
    longest = apart + [span(9, 230, 500, "SELECT z")] + [span(i, 1000 + 100 * i, 90, "SELECT y") for i in range(20, 25)]
    assert [r["title"] for r in run(spark, detectors.serial_queries, longest)] == ["6 serial DB queries (950ms total)"]


@pytest.mark.parametrize("services", [("api", "web"), ("web", "api")])
def test_serial_queries_alike_but_for_their_service(spark, services):
    """The first of the two ends a run, the other one begins the longest."""
    rows = [of_service(span(1, 0, 60, "SELECT 1"), s) for s in services] + [span(2, 100, 60, "SELECT 2")]
    df = spark.createDataFrame(rows, SPANS).coalesce(1)  # in this order
    assert [(r["title"], r["description"]) for r in detectors.serial_queries(df, 2).collect()] == [("2 serial DB queries (120ms total)", "web — consider parallelizing or batching")]
    begun = [of_service(span(1, 0, 0, f"SELECT {s}"), s) for s in services] + [span(2, 0, 160, "SELECT 2")]
    df = spark.createDataFrame(begun, SPANS).coalesce(1)
    assert [(r["title"], r["description"]) for r in detectors.serial_queries(df, 2).collect()] == [("3 serial DB queries (160ms total)", "api — consider parallelizing or batching")]


def test_slow_spans(spark):
    rows = [span(1, 0, 999, "SELECT 1"), span(2, 0, 1000, "SELECT 2"), span(3, 0, 5000, "", system="pg", operation="op"), span(4, 0, 5000, operation="stripe.charge")]
    assert [(r["title"], r["severity"], r["description"]) for r in sorted(run(spark, detectors.slow_queries, rows), key=lambda r: r["title"])] == [("Slow DB query: 1000ms", "warning", "api — SELECT ?"), ("Slow DB query: 5000ms", "error", "api — op")]
    calls = [span(1, 0, 3000, operation="http.get", kind="client"), span(2, 0, 2999, kind="client", url="https://a/b"), span(3, 0, 15_000, kind="client", url="https://a/b", host="a"), span(4, 0, 9000, kind="server", url="https://a/b"), span(5, 0, 9000, kind="client", operation="x")]
    assert sorted((r["title"], r["severity"], r["description"]) for r in run(spark, detectors.slow_calls, calls)) == [("Slow HTTP call: 15000ms", "error", "api → https://a/b"), ("Slow HTTP call: 3000ms", "warning", "api → http.get")]


def test_issues_by_fingerprint(spark):
    rows = [span(1, 100, 1000, "SELECT 1", trace="b"), span(2, 100, 1000, "SELECT 2", trace="a"), span(3, 0, 5000, "SELECT 3", trace="c"), span(4, 50, 1000, "SELECT 4", trace="d")]
    found = detectors.performance_issues(detectors.slow_queries(spark.createDataFrame(rows[:2] + rows[3:], SPANS)), detectors.slow_calls(spark.createDataFrame([], SPANS))).collect()
    assert [(r["events"], r["first_ms"], r["last_ms"], r["severity"], r["trace_id"], r["title"]) for r in found] == [(3, 50, 1100, "warning", "a", "Slow DB query: 1000ms")]
    worst = detectors.performance_issues(detectors.slow_queries(spark.createDataFrame(rows, SPANS))).collect()
    assert [(r["events"], r["first_ms"], r["last_ms"], r["severity"], r["trace_id"]) for r in worst] == [(4, 0, 5000, "error", "c")]


def test_issues_of_queries_alike_but_for_their_service(spark):
    rows = [of_service(span(1, 0, 60, "SELECT 1", trace=t), s) for t, pair in (("t1", ("api", "web")), ("t2", ("web", "api"))) for s in pair] + [span(2, 100, 60, "SELECT 2", trace=t) for t in ("t1", "t2")]
    df = spark.createDataFrame(rows, SPANS).coalesce(1)  # in this order
    found = detectors.performance_issues(*[detector(of, 2) for of in (df.filter("trace_id = 't1'"), df.filter("trace_id = 't2'")) for detector in (detectors.repeated_queries, detectors.serial_queries)])
    assert sorted((r["kind"], r["events"], r["trace_id"], r["description"]) for r in found.collect()) == [
        ("consecutive_db", 2, "t1", "web — consider parallelizing or batching"), ("n_plus_one_db", 2, "t1", "api — SELECT ?"),
    ]
    each = [detectors.repeated_queries(df.filter(F.col("trace_id") == t), 2).select("description").collect() for t in ("t1", "t2")]
    assert each[0] == each[1]


def test_trace_funnel_gaps(spark):
    rows = [("A", "p", 100), ("A", "c", 500), ("A", "k", 1500), ("B", "p", 50), ("B", "c", 200), ("C", "p", 10), ("D", "c", 5), ("D", "p", 6), ("D", "c", 6), ("D", "k", 7)]
    df = spark.createDataFrame(rows, "trace_id string, operation string, start_ms long")
    out = [tuple(r) for r in tracing.trace_funnel(df, ["p", "c", "k"]).orderBy("step").collect()]
    assert out == [(1, "p", 4, 100.0, 0, 0, 4), (2, "c", 2, 50.0, 150, 150, 4), (3, "k", 1, 50.0, 1000, 1000, 4)]
    assert [r["traces"] for r in tracing.trace_funnel(df, ["z", "p"]).orderBy("step").collect()] == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 4, 20, 21, 100])
def test_floored_ranks(spark, n):
    values = [(i * 7919) % 13 for i in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("b", 5)], "g string, v long")
    found = {r["g"]: (r["lo"], r["hi"]) for r in ranks.floored_ranks(df, ["g"], "v", {"lo": 0.5, "hi": 0.95}).collect()}
    ordered = sorted(values)
    assert found == {"a": tuple(ordered[int(float(n - 1) * p)] for p in (0.5, 0.95)), "b": (5, 5)}


def test_bounded_refuses(spark):
    df = spark.createDataFrame([(i, i) for i in range(10)], "event_id long, ts_ms long")
    assert [r["event_id"] for r in traffic.bounded(df, 2, 7, 5).collect()] == [2, 3, 4, 5, 6]
    with pytest.raises(Exception, match="more than 4 rows"):
        traffic.bounded(df, 2, 7, 4).collect()
    for lo, hi in ((5, 5), (7, 2), (0, 187 * DAY_MS)):
        with pytest.raises(ValueError):
            traffic.bounded(df, lo, hi, 5)


def test_release_series(spark):
    sessions = spark.createDataFrame([("a", "1.0", 0), ("b", "1.0", 5), ("c", "1.0", DAY_MS), ("d", "2.0", 0), ("e", "1.0", 3 * DAY_MS), ("f", "1.0", 0)], "session_id string, release string, first_ms long")
    seen = spark.createDataFrame([("a", "error", 9), ("a", "fatal", 10), ("b", "warning", 9), ("c", "fatal", 2 * DAY_MS), ("d", "error", 1), ("", "error", 1), ("f", "error", 3 * DAY_MS)], "session_id string, level string, ts_ms long")
    out = errors.release_sparkline(seen, sessions, "1.0", 2 * DAY_MS + 7, 3).orderBy("day_ms").collect()
    assert [tuple(r) for r in out] == [(0, 3, 1, pytest.approx(200 / 3)), (DAY_MS, 1, 1, 0.0), (2 * DAY_MS, 0, 0, 0.0)]
    assert errors.release_sparkline(seen, sessions, "1.0", 0, 91).count() == 14


def test_counts_since_a_release(spark):
    rows = [(1, 10, "1.0", "A"), (2, 20, "1.1", "A"), (3, 20, "1.0", "A"), (4, 30, "1.1", "B"), (5, 5, "1.0", "C")]
    seen = spark.createDataFrame(rows, "event_id long, ts_ms long, release string, error_type string").withColumn("message", F.lit("m"))
    key = {r["error_type"]: r["h"] for r in seen.select("error_type", errors.group_hash(F.col("error_type"), F.col("message")).alias("h")).distinct().collect()}
    merges = spark.createDataFrame([(key["B"], key["A"])], "alias string, canonical string")
    statuses = spark.createDataFrame([(key["A"], "resolved"), (key["B"], "unresolved"), ("none", "ignored")], "issue string, status string")
    out = {r["issue"]: tuple(r)[1:] for r in errors.counted_since(seen, statuses, merges, 20, "1.1").collect()}
    assert out == {key["A"]: ("resolved", 3, 2, 30, "1.1"), "none": ("ignored", 0, 0, None, None)}


def test_channels_read_the_medium(spark):
    cases = [
        ("", "", "", "Direct"), ("https://www.google.com/search?q=x", "", "", "Organic Search"), ("https://t.co/a", "", "", "Social"), ("https://x.com/u", "", "", "Social"), ("https://someblog.com/a", "", "", "Referral"), ("https://google.com", "", "cpc", "Paid"),
        ("https://t.co/a", "", "email", "Email"), ("", "newsletter", "EMAIL", "Email"), ("", "facebook", "social", "Social"), ("", "google", "", "Organic Search"), ("https://gemini.google.com/app", "", "", "AI Assistant"), ("", "chatgpt.com", "", "AI Assistant"),
        ("https://sandbox.company/b", "", "", "Referral"), ("https://kaolin.io/p", "", "", "Referral"), ("https://redditchbeer.co.uk/", "", "", "Referral"), ("https://notaskcomedy.net/", "", "", "Referral"), ("https://google.co.uk/", "", "", "Organic Search"), ("https://old.reddit.com/", "", "unheard", "Social"),
    ]
    df = spark.createDataFrame(cases, "r string, s string, m string, want string")
    assert not df.filter(channel(F.col("s"), F.col("m"), F.col("r")) != F.col("want")).collect()


def test_titles_end_at_code_points(spark):
    cases = {("E", "m"): "E: m", ("", "x" * 120): "x" * 120, ("", "x" * 121): "x" * 117 + "...", ("", "x" * 116 + "é" + "y" * 9): "x" * 116 + "...", ("", "x" * 115 + "é" + "y" * 9): "x" * 115 + "é...", ("T", ""): "T", ("", ""): "Unknown Error"}
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "t string, m string, want string")
    assert not df.filter(errors.title(F.col("t"), F.col("m")) != F.col("want")).collect()


def test_rage_clicks_group_by_page_and_element(spark):
    rows = [("RageClick", "a", "https://x.test/p?q=1", "#buy", ""), ("RageClick", "b", "https://x.test/p#f", "#buy", ""), ("RageClick", "a", "https://x.test/p", "#sell", ""), ("E", "a", "https://x.test/p", "#buy", ""), ("RageClick", "a", "https://x.test/p", "#buy", "own")]
    df = spark.createDataFrame(rows, "t string, m string, u string, s string, c string")
    found = [r[0] for r in df.select(errors.group_hash(F.col("t"), F.col("m"), None, F.col("c"), F.col("u"), F.col("s"))).collect()]
    assert found[0] == found[1] and len(set(found)) == 4 and found[4] == "own"
    assert found[0] == hashlib.md5(b"RageClick|https://x.test/p|#buy").hexdigest() and found[3] == hashlib.md5(b"E|a").hexdigest()
    parts = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "p array<string>").select(errors.custom_fingerprint(F.col("p"))).collect()
    assert [r[0] for r in parts] == [hashlib.md5(b"a|b|").hexdigest(), "", ""]
