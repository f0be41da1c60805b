"""Small cases with known results: order, ties, windows, counter resets, quantiles and statistics."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import web
from tidemark.operators import cohorts, detectors, errors, experiments, logs, lookups, metrics, rollups, sequences, tracing, traffic
from tidemark.sources import exports

EVENTS = "ts_ms long, event_id long, session_id string, event_type string"
MINUTE = 60_000


def steps(*names):
    return [F.col("event_type") == n for n in names]


def reached(spark, rows, names, **options):
    df = spark.createDataFrame(rows, EVENTS)
    return [r["entities"] for r in sequences.funnel(df, steps(*names), **options).orderBy("step").collect()]


def test_funnel_order_and_ties(spark):
    assert reached(spark, [(5, 2, "s", "purchase"), (5, 1, "s", "signup")], ["signup", "purchase"]) == [1, 1]
    assert reached(spark, [(5, 1, "s", "purchase"), (5, 2, "s", "signup")], ["signup", "purchase"]) == [1, 0]
    assert reached(spark, [(1, 1, "s", "A")], ["A", "A"]) == [1, 0]
    assert reached(spark, [(1, 1, "s", "A"), (1, 2, "s", "A")], ["A", "A"]) == [1, 1]


@pytest.mark.parametrize(("offset", "second"), [(10 * MINUTE, 1), (10 * MINUTE + 1, 0), (10 * MINUTE - 1, 1)])
def test_funnel_window_edge(spark, offset, second):
    assert reached(spark, [(0, 1, "s", "A"), (offset, 2, "s", "B")], ["A", "B"], window_ms=10 * MINUTE) == [1, second]


def test_funnel_exclusion_ends_the_entity(spark):
    rows = [(0, 1, "s", "A"), (1, 2, "s", "X"), (2, 3, "s", "B"), (0, 4, "t", "X"), (1, 5, "t", "A"), (2, 6, "t", "B")]
    assert reached(spark, rows, ["A", "B"], exclude=F.col("event_type") == "X") == [2, 1]
    assert reached(spark, rows, ["A", "X"], exclude=F.col("event_type") == "X") == [2, 0]


def test_retention_leaves_open_periods_out(spark):
    df = spark.createDataFrame([(0, 1, "s", "A"), (10, 2, "s", "A"), (11, 3, "t", "A")], EVENTS)
    assert [tuple(r) for r in sequences.retention(df, 10, 25).collect()] == [(0, 1, 1, 1)]


@pytest.mark.parametrize(("model", "expected"), [
    ("first", {"google": 1.0, "facebook": 1.0, "(direct)": 1.0}), ("last", {"twitter": 1.0, "facebook": 1.0, "(direct)": 1.0}), ("linear", {"google": 0.5, "twitter": 0.5, "facebook": 1.0, "(direct)": 1.0}),
])
def test_attribution(spark, model, expected):
    rows = [(100, 1, "s1", "google"), (200, 2, "s1", "twitter"), (150, 3, "s2", "facebook"), (300, 4, "s3", "")]
    df = spark.createDataFrame(rows, "ts_ms long, event_id long, session_id string, utm_source string")
    assert {r["source"]: r["credit"] for r in sequences.attribution(df, model).collect()} == expected


POINTS = "stream string, ts_ms long, value double, event_id long"
RATES = [
    ([("a", 0, 0), ("a", 1, 10), ("a", 2, 30), ("a", 3, 45)], 10, {0: 15.0}),
    ([("a", 0, 0), ("a", 1, 10), ("a", 2, 30), ("a", 3, 5), ("a", 4, 15)], 10, {0: 11.25}),
    ([("a", 0, 0), ("a", 1, 10), ("a", 100, 110), ("a", 101, 120)], 60, {0: 10.0, 60: 1.1}),
    ([("a", 0, 0), ("a", 1, 100), ("a", 59, 101)], 60, {0: 1.711864406779661}),
    ([("a", 0, 0), ("a", 10, 100), ("b", 5, 0), ("b", 15, 50)], 60, {0: 15.0}),
    ([("a", 0, 100), ("a", 30, 150), ("a", 60, 10), ("a", 90, 40)], 60, {0: 1.6666666666666667, 60: 0.6666666666666666}),
    ([("a", 0, 0), ("a", 1, 10), ("a", 1, 10), ("a", 2, 30)], 10, {0: 15.0}),
]


@pytest.mark.parametrize(("points", "step", "expected"), RATES)
def test_counter_rate(spark, points, step, expected):
    df = spark.createDataFrame([(s, t * 1000, float(v), i) for i, (s, t, v) in enumerate(points)], POINTS)
    found = {r["bucket_ms"] // 1000: r["rate"] for r in metrics.counter_rate(df, step * 1000).collect()}
    assert found == pytest.approx(expected)


def test_delta_rate(spark):
    df = spark.createDataFrame([("a", 10_000, 3.0, 1), ("a", 70_000, 9.0, 2)], POINTS)
    assert {r["bucket_ms"]: r["rate"] for r in metrics.delta_rate(df, 60_000).collect()} == pytest.approx({0: 0.05, 60_000: 0.15})


WIDE, NARROW = [10.0, 50.0, 100.0], [10.0, 50.0]
QUANTILES = [
    ([("a", 0, WIDE, [5, 5, 5, 5])], False, {0.5: 50.0, 0.25: 10.0, 0.1: 10.0, 0.7: 90.0, 0.95: 100.0}),
    ([("a", 0, NARROW, [5, 5, 0]), ("a", 1, NARROW, [0, 0, 10])], False, {0.95: 50.0}),
    ([("a", 0, WIDE, [1, 1, 1, 0]), ("a", 30, WIDE, [2, 3, 4, 0])], True, {0.5: 50.0, 0.95: 95.0}),
    ([("a", 0, WIDE, [5, 5, 5, 0]), ("a", 1, WIDE, [1, 1, 1, 0])], True, {0.5: 30.0}),
    ([("a", 0, WIDE, [2, 2, 2, 0]), ("a", 1, WIDE, [3, 2, 2, 0]), ("b", 0, WIDE, [1, 1, 1, 0]), ("b", 1, WIDE, [1, 2, 1, 0])], True, {0.5: 10.0}),
]


@pytest.mark.parametrize(("points", "cumulative", "expected"), QUANTILES)
def test_histogram_quantile(spark, points, cumulative, expected):
    df = spark.createDataFrame(points, "stream string, ts_ms long, bounds array<double>, counts array<long>")
    for q, value in expected.items():
        assert metrics.histogram_quantile(df, q, MINUTE, cumulative).first()["value"] == pytest.approx(value)


def test_trace_funnel(spark):
    rows = [(t, op, ms) for t, ops in (("A", (100, 500, 1500)), ("B", (50, 200)), ("C", (10,))) for op, ms in zip(("p", "c", "k"), ops, strict=False)]
    df = spark.createDataFrame(rows, "trace_id string, operation string, start_ms long")
    assert [r["traces"] for r in tracing.trace_funnel(df, ["p", "c", "k"]).orderBy("step").collect()] == [3, 2, 1]


def test_statement_fingerprints_and_missing_attributes(spark):
    df = spark.createDataFrame([("SELECT a  FROM t WHERE x = 'it''s' AND y = 42", {"a": "1"}), ("SELECT 1", {})], "s string, attributes map<string,string>")
    assert df.select(detectors.fingerprint(F.col("s"))).first()[0] == "SELECT a FROM t WHERE x = ?? AND y = ?"
    assert tracing.with_attribute(df, "a", "neq", "2").count() == 1
    assert df.filter(logs.none_of(logs.attribute("a", ":", "1"))).count() == 1


def test_buckets(spark):
    known = {("k", ""): 71, ("k", "u1"): 79, ("k", "alice"): 96, ("k:variant", ""): 2, ("k:variant", "u1"): 47, ("k:variant", "alice"): 31, ("k:grp:half", "u1"): 14, ("k:grp:half", "alice"): 12}
    df = spark.createDataFrame(list(known), "salt string, user string")
    assert {(r[0], r[1]): r[2] for r in df.select("salt", "user", web.stable_bucket(F.col("salt"), F.col("user"))).collect()} == known


def test_flags_with_missing_attributes(spark):
    df = spark.createDataFrame([("u1", {"plan": "pro", "age": "30"}), ("u2", {})], "user string, context map<string,string>")
    cases = {"eq": ("plan", "pro", [True, False]), "neq": ("plan", "x", [True, False]), "not_set": ("plan", None, [False, True]), "gte": ("age", 30, [True, False]), "in": ("plan", ["pro"], [True, False]), "starts_with": ("plan", "p", [True, False])}
    for op, (name, value, expected) in cases.items():
        on = experiments.flag([{"attribute": name, "op": op, "value": value}], F.col("context"), "k", F.col("user"), 100)
        assert [r[0] for r in df.orderBy("user").select(on).collect()] == expected, op


def test_statistics():
    assert experiments.newcombe(40, 200, 60, 200) == pytest.approx((0.015063442559663034, 0.18316248444472888))
    assert experiments.newcombe(0, 50, 5, 50) == pytest.approx((0.008975448080590018, 0.21360231437479657))
    assert experiments.holm([0.03, 0.04, 0.1]) == pytest.approx([0.09, 0.09, 0.1])
    assert experiments.holm([0.001, 0.2, 0.3, 0.011]) == pytest.approx([0.004, 0.4, 0.4, 0.033])
    assert experiments.chi_square([(4000, 400), (4000, 480)]) == pytest.approx((7.968590398365679, 0.004759598860014404))
    assert experiments.beats_control({"a": (1000, 100), "b": (1000, 200)}, "a")["b"] > 0.99


def test_web_functions(spark):
    df = spark.createDataFrame([("https://WWW.Shop.example/a/?utm_source=x&b=1", "https://notgoogle.example/", "Mozilla/5.0 (iPhone; CPU iPhone OS 17) Version/17 Mobile Safari/604.1")], "u string, r string, a string")
    row = df.select(web.host(F.col("u")), web.path(F.col("u")), web.utm(F.col("u"), "source"), web.utm(F.col("u"), "source", F.lit("y")), web.channel(F.lit(""), F.lit(""), F.col("r")), web.browser(F.col("a")), web.operating_system(F.col("a")), web.device(F.col("a")), web.is_bot(F.lit("")), web.csv_safe(F.lit("=1"))).first()
    assert tuple(row) == ("shop.example", "/a", "x", "y", "Referral", ("Safari", "17"), "iOS", "mobile", True, "'=1")


def test_error_grouping(spark):
    df = spark.createDataFrame([("E", "user 1234567 at 10.0.0.1"), ("E", "user 7654321 at 10.9.0.1")], "t string, m string")
    assert df.select(errors.group_hash(F.col("t"), F.col("m"))).distinct().count() == 1
    assert df.select(errors.parameterized(F.col("m"))).first()[0] == "user {num} at {ip}"


def test_latest_and_members(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 2, False), ("b", 1, False)], "entity_id string, version int, removed boolean")
    assert [r[0] for r in cohorts.members(df).collect()] == ["b"]
    assert {tuple(r) for r in rollups.latest(df.filter("not removed"), ["entity_id"], ["version"]).select("entity_id", "version").collect()} == {("a", 2), ("b", 1)}


def test_monitors_and_incidents(spark):
    checks = spark.createDataFrame([("a", 10), ("b", 90)], "monitor string, ts_ms long")
    assert [r["monitor"] for r in lookups.missed(checks, 100, 20, 5).collect()] == ["a"]
    incidents = spark.createDataFrame([(1, 5), (8, None)], "opened_ms long, closed_ms long")
    assert lookups.overlapping(incidents, 6, 9).count() == 1


def test_uniques_do_not_add_but_sketches_do(spark):
    counts = {("s1", 0): 2, ("s2", 0): 3, ("s3", 0): 2, ("s1", 1): 1, ("s4", 1): 3, ("s5", 1): 2, ("s6", 1): 2}
    rows = [(b * 3_600_000, i, s, "pageview") for i, (s, b) in enumerate(k for k, n in counts.items() for _ in range(n))]
    df = spark.createDataFrame(rows, EVENTS)
    hours = traffic.timeseries(df, 3_600_000).orderBy("bucket_ms").collect()
    assert [(r["pageviews"], r["visitors"]) for r in hours] == [(7, 3), (8, 4)]
    merged = rollups.unique_sketches(df, 3_600_000).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
    assert merged.first()["n"] == 6


def test_exports_and_queries(spark, tmp_path):
    df = spark.createDataFrame([("=x", 1)], "a string, b int")
    exports.write_csv(df, str(tmp_path / "csv"))
    exports.write_ndjson(df, str(tmp_path / "json"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["a"] == "'=x"
    df.write.parquet(str(tmp_path / "t"))
    assert exports.ask(spark, "SELECT b FROM t", {"t": str(tmp_path / "t")}).first()["b"] == 1
    with pytest.raises(Exception, match="(?i)parse|syntax"):
        exports.ask(spark, "DROP VIEW t", {"t": str(tmp_path / "t")})
    own = {"t": str(tmp_path / "t")}
    assert exports.ask(spark, "WITH x AS (SELECT b, count(*) AS n FROM t GROUP BY b) SELECT sum(n) AS s FROM x WHERE b IN (SELECT b FROM t)", own).first()["s"] == 1
    for text in (
        f"SELECT * FROM parquet.`{tmp_path}/t`", "SELECT reflect('java.lang.System', 'getProperty', 'user.home') AS x FROM t", "SELECT `java_method`('java.lang.System', 'exit') FROM t", "SELECT input_file_name() FROM t",
        f"SELECT (SELECT max(b) FROM csv.`{tmp_path}/csv`) AS x FROM t", "SELECT * FROM other", "SELECT * FROM t WHERE b IN (SELECT reflect('a', 'b') FROM t)", "SELECT * FROM range(5)", "SELECT * FROM IDENTIFIER('other')",
    ):
        with pytest.raises(Exception, match="(?i)scope|parse"):
            exports.ask(spark, text, own).collect()


def test_queries_stay_in_scope(spark, tmp_path):
    """Views of all sessions and tables of the catalogue stay hidden, whatever table expressions elsewhere are called."""
    df = spark.createDataFrame([(1, "x", 2.0)], "a int, b string, c double")
    df.write.parquet(str(tmp_path / "t"))
    df.createOrReplaceGlobalTempView("secret")
    spark.sql("DROP TABLE IF EXISTS hidden")
    df.write.saveAsTable("hidden")
    own = {"t": str(tmp_path / "t")}
    for text in (
        "SELECT * FROM (WITH `global_temp.secret` AS (SELECT 1 a) SELECT * FROM `global_temp.secret`) x CROSS JOIN global_temp.secret", "SELECT * FROM (WITH hidden AS (SELECT 1 a) SELECT * FROM hidden) x CROSS JOIN hidden",
        "SELECT * FROM t WHERE a IN (WITH hidden AS (SELECT 1 a) SELECT a FROM hidden) AND a IN (SELECT a FROM hidden)", "WITH x AS (SELECT * FROM hidden), hidden AS (SELECT 1 a) SELECT * FROM x",
        "SELECT * FROM spark_catalog.default.hidden", "SELECT * FROM default.hidden", "WITH hidden AS (SELECT * FROM hidden) SELECT * FROM hidden", "SELECT (SELECT max(a) FROM hidden) m FROM t", "SELECT * FROM t VERSION AS OF 1", "TABLE hidden",
        "SELECT a FROM t UNION ALL (WITH t2 AS (SELECT a FROM t) SELECT a FROM t2) UNION ALL SELECT a FROM t2", "SELECT * FROM t LATERAL VIEW explode(array(reflect('a', 'b'))) e", "SELECT * FROM t JOIN LATERAL (SELECT * FROM hidden) y", "SELECT transform(a) USING 'cat' FROM t",
    ):
        with pytest.raises(Exception, match="(?i)scope|parse|syntax"):
            exports.ask(spark, text, own).collect()
    good = {
        "WITH x AS (SELECT a FROM t), y AS (SELECT a + 1 AS a FROM x) SELECT sum(a) FROM (SELECT * FROM x UNION ALL SELECT * FROM y)": 3, "SELECT (WITH z AS (SELECT max(a) m FROM t) SELECT m FROM z) FROM t": 1,
        "WITH t AS (SELECT 5 a) SELECT a FROM t": 5, "SELECT count(*) FROM t AS u JOIN t AS v ON u.a = v.a WHERE EXISTS (SELECT 1 FROM t WHERE t.a = u.a)": 1, "SELECT a FROM T": 1,
    }
    assert {q: exports.ask(spark, q, own).first()[0] for q in good} == good
    assert exports.ask(spark, "SELECT * FROM t", own, columns={"t": ["a", "b"]}).columns == ["a", "b"]
    with pytest.raises(Exception, match="(?i)resolved|column"):
        exports.ask(spark, "SELECT c FROM t", own, columns={"t": ["a", "b"]})
    assert "Scan parquet" in exports.explained(spark, "SELECT a FROM t", own)
    assert exports.answered(spark, "SELECT a FROM t", own)[0]["a"] == 1
    spark.range(400).write.parquet(str(tmp_path / "n"))
    with pytest.raises(Exception, match="(?i)cancel"):
        exports.answered(spark, "SELECT count(*) FROM n x, n y, n z WHERE sha2(concat(x.id, y.id, z.id), 512) = 'q'", {"n": str(tmp_path / "n")}, seconds=0.3)
    spark.sql("DROP TABLE hidden")
    spark.catalog.dropGlobalTempView("secret")


def test_log_samples_by_message(spark):
    df = spark.createDataFrame([("a",), ("foobar",), ("",)], "message string")
    assert [r[0] for r in df.select(logs.fnv1a(F.col("message"))).collect()] == [0xE40C292C, 0xBF9CF968, 0x811C9DC5]
    kept = logs.pipeline(df.withColumn("attributes", F.create_map().cast("map<string,string>")), [{"type": "sample", "pattern": "^foo", "value": "0"}])
    assert {r["message"] for r in kept.collect()} == {"a", ""}


def test_experiment_results():
    assert experiments.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert experiments.sample_size(0.1, 0.02) == 3841
    assert experiments.sample_ratio([500, 500], [1, 1]) == (0.0, 1.0) and experiments.sample_ratio([600, 400], [1, 1])[1] < 1e-6
    assert experiments.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert experiments.t_two_sided(12.706204736432095, 1) == pytest.approx(0.05)
    found = experiments.welch_test(10, 5.0, 4.0, 12, 7.0, 9.0)
    assert found["diff"] == 2.0 and found["low"] < 2.0 < found["high"] and 0 < found["p"] < 1
    clear = experiments.results([("a", 1000, 100), ("b", 1000, 160)], [1, 1])
    assert clear["winner"] == "b" and clear["test"] == "chi-square-yates" and clear["pairwise"][0]["low"] > 0
    assert experiments.results([("a", 1000, 100), ("b", 500, 80)], [1, 1])["winner"] == ""
    assert experiments.results([("a", 50, 5), ("b", 50, 25)], [1, 1])["winner"] == ""
    assert experiments.results([("a", 10, 1), ("b", 10, 8)])["test"] == "fisher-exact"
    losing = experiments.results([("a", 1000, 300), ("b", 1000, 100), ("c", 1000, 120)], [1, 1, 1])
    assert losing["winner"] == "" and losing["p"] < 1e-9 and all(x["significant"] for x in losing["pairwise"])
    mixed = experiments.results([("a", 1000, 100), ("b", 1000, 160), ("c", 100, 2)], None, 100)
    assert [x["exact"] for x in mixed["pairwise"]] == [False, False] and mixed["winner"] == "b"
    assert [x["exact"] for x in experiments.results([("a", 100, 6), ("b", 2000, 400), ("c", 60, 2)], None, 50)["pairwise"]] == [False, True]
    assert experiments.results([("a", 0, 0), ("b", 100, 10)])["pairwise"][0]["p"] == 1.0 and experiments.results([("a", 5, 1)])["test"] == "none"
    assert experiments.required_exposures(100, 500) == 500 and experiments.required_exposures(100, 500, override=True) == 100 and experiments.required_exposures(10, 0, 30, True) == 30
    means = experiments.continuous_results([("a", 200, 5.0, 4.0), ("b", 200, 5.6, 4.0), ("c", 200, 5.1, 4.0)], [200, 200, 200], [1, 1, 1], 100)
    assert means["winner"] == "b" and means["test"] == "welch-t" and means["p"] == pytest.approx(2 * means["pairwise"][0]["p"]) and not means["pairwise"][1]["significant"]
    assert experiments.continuous_results([("a", 200, 5.0, 4.0), ("b", 200, 4.0, 4.0)], [200, 200])["winner"] == "" and experiments.continuous_results([("a", 20, 5.0, 4.0), ("b", 20, 50.0, 4.0)], [20, 20], None, 5)["winner"] == ""
    constant = experiments.continuous_results([("a", 50, 1.0, 0.0), ("b", 50, 2.0, 0.0)], [50, 50], None, 40)
    assert constant["p"] == 0.0 and constant["winner"] == "b" and constant["pairwise"][0]["df"] == 98.0


def test_cycles_of_aliases_end_at_their_smallest(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "b"), ("y", "x"), ("m", "n")]
    found = {tuple(r) for r in traffic.canonical(spark.createDataFrame(links, "alias string, target string")).collect()}
    assert found == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "a"), ("y", "a"), ("m", "n")}


@pytest.mark.parametrize(("referrer", "source", "medium", "expected"), [
    ("", "", "", "Direct"), ("https://www.google.com/search?q=test", "", "", "Organic Search"), ("https://search.yahoo.com/search?p=test", "", "", "Organic Search"), ("https://t.co/abc123", "", "", "Social"),
    ("https://x.com/user/status/123", "", "", "Social"), ("https://news.ycombinator.com/item?id=123", "", "", "Referral"), ("https://google.com", "", "cpc", "Paid"), ("", "newsletter", "email", "Email"), ("", "google", "cpc", "Paid"),
    ("", "facebook", "social", "Social"), ("", "google", "", "Organic Search"), ("https://gemini.google.com/app", "", "", "AI Assistant"), ("", "chatgpt.com", "", "AI Assistant"), ("https://mail.google.com/", "", "", "Email"),
    ("https://sandbox.company/a", "", "", "Referral"), ("https://kaolin.io/", "", "", "Referral"), ("https://google.com", "newsletter", "", "Organic Search"), ("", "newsletter", "", "Direct"),
])
def test_channels(spark, referrer, source, medium, expected):
    df = spark.createDataFrame([(referrer, source, medium)], "r string, s string, m string")
    assert df.select(web.channel(F.col("s"), F.col("m"), F.col("r"))).first()[0] == expected


@pytest.mark.parametrize(("agent", "expected"), [
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.6099.109 Safari/537.36", ("Chrome", "120.0", "Windows", "desktop")),
    ("Mozilla/5.0 (Linux; Android 13; SM-X900) AppleWebKit/537.36 Chrome/119.0.0.0 Safari/537.36", ("Chrome", "119.0", "Android", "tablet")),
    ("Mozilla/5.0 (Linux; Android 13; SM-S918B) AppleWebKit/537.36 SamsungBrowser/23.0 Chrome/115.0.0.0 Mobile Safari/537.36", ("Samsung Browser", "23.0", "Android", "mobile")),
    ("Mozilla/5.0 (iPad; CPU OS 17_1 like Mac OS X) Version/17.1 Mobile/15E148 Safari/604.1", ("Safari", "17.1", "iOS", "tablet")),
    ("Mozilla/5.0 (X11; Linux x86_64) Edg/118.0.2088.46", ("Edge", "118.0", "Linux", "desktop")), ("Mozilla/5.0 (Windows NT 6.1; Trident/7.0; rv:11.0)", ("IE", "11", "Windows", "desktop")), ("", ("", "", "", "")),
])
def test_user_agents(spark, agent, expected):
    df = spark.createDataFrame([(agent,)], "a string").select(web.browser(F.col("a")).alias("b"), web.operating_system(F.col("a")).alias("o"), web.device(F.col("a")).alias("d"))
    assert tuple(df.select("b.name", "b.version", "o", "d").first()) == expected


def test_versions_of_systems(spark):
    cases = {
        "Mozilla/5.0 (Windows NT 10.0; Win64; x64)": "10", "Mozilla/5.0 (Windows NT 6.1; Trident/7.0)": "7", "x (Windows NT 7.9; y)": "7.9", "x (iPhone; CPU iPhone OS 17_2 like Mac OS X)": "17.2", "x (iPad; CPU OS 16_7_1 like Mac OS X)": "16.7.1",
        "x (Macintosh; Intel Mac OS X 14_2) y": "14.2", "x (Linux; Android 14; Pixel 8) y": "14", "x (X11; Linux x86_64)": "", "x (iPod)": "", "": "", "x (X11; CrOS x86)": "",
    }
    df = spark.createDataFrame([(a,) for a in cases], "a string")
    assert {r["a"]: r["v"] for r in df.select("a", web.os_version(F.col("a")).alias("v")).collect()} == cases


def test_absent_labels_are_not_empty_ones(spark):
    points = spark.createDataFrame([(1, {"a": ""}), (2, {}), (3, {"a": "x"})], "value int, attributes map<string,string>")
    assert [r["value"] for r in metrics.labelled(points, {"a": ""}).collect()] == [1]
    assert {r["a"]: r["n"] for r in metrics.with_labels(points, "a").groupBy("a").agg(F.count("*").alias("n")).collect()} == {"": 1, None: 1, "x": 1}


def test_aliases_and_pages(spark):
    aliases = traffic.canonical(spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "c")], "alias string, target string"), 2)
    assert {tuple(r) for r in aliases.collect()} == {("c", "a"), ("b", "a"), ("d", "a")}


@pytest.mark.parametrize(
    ("ip", "expected"),
    [
        ("1.2.3.4", (False, 0x01020304)), ("255.255.255.255", (False, 0xFFFFFFFF)), ("::ffff:1.2.3.4", (False, 0x01020304)), ("::FFFF:102:304", (False, 0x01020304)),
        ("2001:db8::1", (True, 0x20010DB800000000)), ("::1", (True, 0)), ("::", (True, 0)), ("1:2:3:4:5:6:7:8", (True, 0x0001000200030004)), ("1:2:3:4:5:6:7::", (True, 0x0001000200030004)),
        ("64:ff9b::1.2.3.4", (True, 0x0064FF9B00000000)), ("01.2.3.4", None), ("256.1.1.1", None), ("1.2.3", None), ("1:2:3:4:5:6:7", None), ("1:2:3:4::5:6:7:8", None), ("1::2::3", None), (":::", None),
        ("fe80::1%eth0", None), ("12345::", None), ("", None), ("host", None), (None, None),
    ],
)
def test_addresses(spark, ip, expected):
    from tidemark.functions.addresses import address

    found = spark.createDataFrame([(ip,)], "ip string").select(address(F.col("ip")).alias("a")).first()["a"]
    assert (found and tuple(found)) == expected
