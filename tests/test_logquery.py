"""The log query language and log pipelines: fixed vectors, errors with their positions, limits, hostile values."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import logquery, logs

SCHEMA = "log_id long, ts_ms long, level string, message string, service string, trace_id string, span_id string, attributes map<string,string>"
AT = 1_700_000_000_000
ROWS = [
    (1, AT, "error", "Payment FAILED for user", "api", "t1", "s1", {"http.status": "500", "user": "jane", "ok": "false", "nested": '{"a":1}', "ratio": "0.5", "env": ""}),
    (2, AT + 1, "Warn", "foo-bar 100% \\done a_b", "web", "t2", "s2", {"http.status": "12px", "user": "bob"}),
    (3, AT + 2, "info", "foo baz", "web", None, None, None),
    (4, AT + 3, None, None, None, None, None, {"http.status": "nan", "n": "1e3", "inf": "Infinity", "d": "5d"}),
    (5, AT + 4, "INFO", 'a "quoted" b and or not ÜNÏCODE 日本語', "api", "t1", "s5", {"n": "+1000.0", "user": "jane doe"}),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(df, query):
    return [r["log_id"] for r in df.filter(logquery.compiled(query)).orderBy("log_id").collect()]


@pytest.mark.parametrize(
    "query, expected",
    [
        ("failed", [1]), ('"for user"', [1]), ("foo baz", [3]), ("foo AND baz", [3]), ("foo OR payment failed", [1, 2, 3]), ("(foo OR payment) -baz", [1, 2]), ("-foo", [1, 4, 5]), ("NOT foo", [1, 4, 5]),
        ("NOT -foo", [2, 3]), ("level:error service:api", [1]), ("Level:ERROR", [1]), ("level:INFO", [3, 5]), ("level:warn", [2]), ("message:timeout", []), ("trace_id:t1 span_id:s5", [5]), ("-trace_id:t1", [2, 3, 4]),
        ("foo-bar", [2]), ('"a \\"quoted\\" b"', [5]), ("and or not", [5]), ("ünïcode 日本語", [5]), ("  foo\tBAZ\n", [3]), ("100%", [2]), ("a_b", [2]), ("%", [2]), ('"\\\\done"', [2]), ("50%", []),
        ("attr.user:jane", [1]), ("attr.user:JANE", []), ("-attr.user:bob", [1, 3, 4, 5]), ("attr.http.status:500", [1]), ("attr.http.status:>=500", [1]), ("attr.http.status:>500", []), ("attr.http.status:<600", [1]), ("-attr.http.status:<600", [2, 3, 4, 5]),
        ("attr.ratio:<1", [1]), ("attr.user:>1", []), ("attr.ok:false", [1]), ("attr.missing:x", []), ("-attr.missing:x", [1, 2, 3, 4, 5]), ("resource.user:jane", [1]), ('attr.user:"jane doe"', [5]), ('attr.n:>"999"', [4, 5]), ("attr.n:1000", [4, 5]),
        ("attr.inf:>0", []), ("attr.d:5", []), ("attr.nested:{", []), ("Attr.user:bob OR payment", [1, 2]), ("-(foo attr.user:bob)", [1, 3, 4, 5]), ("-(foo OR attr.user:jane)", [4, 5]),
        (f"timestamp:>={AT + 2}", [3, 4, 5]), (f"timestamp:<{AT}", []), (f"timestamp:{AT + 1}", [2]), ("timestamp:>=2023-11-14T22:13:20.003Z", [4, 5]), ("timestamp:<2023-11-15T00:13:20.001999+02:00", [1]), ("timestamp:>2023-11-15", []),
        ('level:"error"', [1]), ("foo(baz)", [3]), ('foo"baz"', [3]), ("--foo", [2, 3]), ("-(-foo)", [2, 3]),
    ],
)
def test_meaning(rows, query, expected):
    assert ids(rows, query) == expected


@pytest.mark.parametrize(
    "query, at, what",
    [
        ("", 0, "empty"), ("   ", 0, "empty"), ("foo AND", 7, "unexpected end"), ("OR foo", 0, "unexpected OR"), ("foo OR", 6, "unexpected end"), ("(foo", 0, "unclosed"), ("foo)", 3, "unmatched"), ("()", 0, "empty parentheses"),
        ('"abc', 0, "unterminated"), ('foo "abc', 4, "unterminated"), ('"a\\"', 0, "unterminated"), ("bogus:thing", 0, "unknown field"), ("foo 10:30", 4, "unknown field"), (":x", 0, "missing field"), ("level:", 0, "missing value"),
        ("level:>error", 0, "comparison operators only"), ("attr.:x", 0, "invalid key"), ("attr.a'b:x", 0, "invalid key"), ("attr.ключ:x", 0, "invalid key"), ("attr.x:>abc", 0, "numeric"), ("attr.x:>1e999", 0, "numeric"), ("timestamp:yesterday", 0, "invalid timestamp"),
        ("timestamp:2024-13-01", 0, "invalid timestamp"), ("timestamp:12345678901234567", 0, "invalid timestamp"), ("foo -", 4, "dangling"), ("foo\x00bar", 3, "control"), ("foo \x01", 4, "control"), ("\udcff", 0, "UTF-8"), ('level:""', 0, "empty value"),
        ('""', 0, "empty value"), ("foo AND AND bar", 8, "unexpected AND"), ("(foo OR )", 8, "unmatched"), ("((foo", 1, "unclosed"), ("foo NOT", 7, "unexpected end"), ("NOT OR", 4, "unexpected OR"), ("(-)", 2, "unmatched"), ("level: error", 0, "missing value"), ("attr.k:> 5", 0, "missing value"),
    ],
)
def test_errors(spark, query, at, what):
    with pytest.raises(logquery.QueryError) as error:
        logquery.compiled(query)
    assert error.value.at == at and what in error.value.what


def test_limits(spark):
    def refused(query):
        try:
            logquery.compiled(query)
        except logquery.QueryError:
            return True
        return False

    words = ("a" * 100 + " ") * 10
    cases = [
        (words + "a" * 14, words + "a" * 15), ("a " * 20, "a " * 21), ("(" * 5 + "a" + ")" * 5, "(" * 6 + "a" + ")" * 6), ("NOT " * 5 + "a", "-" * 6 + "a"),
        ("attr." + "k" * 128 + ":x", "attr." + "k" * 129 + ":x"), ("v" * 256, "v" * 257), ("é" * 256, "é" * 513), ("-(-(-(-(-a))))", "(" * 500 + "a" + ")" * 500),
    ]
    assert [(refused(a), refused(b)) for a, b in cases] == [(False, True)] * len(cases)


HOSTILE = ["' OR 1=1 --", "'; DROP TABLE logs; --", '" OR ""="', "\\", "\\\\", "\\'", "%", "_", "%_%", "100%", "a_b", "/* comment */", "--", ";", "$1", "$$", ") OR (1=1", "日本語' --", "tab\there", "\\x00", "`message`", "\\u0027", "%27", "${x}", "(?i)"]


def test_hostile_values_are_only_values(spark):
    """Each finds the one log that holds it, in every field, and nothing else."""
    held = [(i, AT, v, f"<{v}>", v, v, v, {"k": v}) for i, v in enumerate(HOSTILE)] + [(99, AT, "x", "x", "x", "x", "x", {"k": "x"})]
    df = spark.createDataFrame(held, SCHEMA)
    everyone, wanted = [*range(len(HOSTILE)), 99], {}
    for i, v in enumerate(HOSTILE):
        quoted = '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        containing = [j for j, w in enumerate(HOSTILE) if v in w]
        wanted |= {f"{name}:{quoted}": [i] for name in ("level", "service", "trace_id", "span_id", "attr.k", "resource.k")}
        wanted |= {f"{quoted} OR {quoted}": containing, f"message:{quoted}": containing, f"-{quoted}": [j for j in everyone if j not in containing]}
    held = df.select("log_id", *[logs.known(logquery.compiled(q)).alias(f"q{k}") for k, q in enumerate(wanted)]).orderBy("log_id").collect()
    assert {q: [r["log_id"] for r in held if r[f"q{k}"]] for k, q in enumerate(wanted)} == wanted


def test_terms_reach_the_scan(spark, tmp_path, rows):
    rows.write.parquet(f"{tmp_path}/logs")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = spark.read.parquet(f"{tmp_path}/logs").filter(logquery.compiled(f"level:error service:api timestamp:>={AT}"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(service,api)" in plan and f"GreaterThanOrEqual(ts_ms,{AT})" in plan and "In(level, [" in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")


# --- pipelines -----------------------------------------------------------------------------------------------------


def run(spark, message, attributes, *rules):
    df = spark.createDataFrame([(message, attributes)], "message string, attributes map<string,string>")
    out = logs.pipeline(df, list(rules)).collect()
    return (out[0]["message"], out[0]["attributes"]) if out else None


def test_rules(spark):
    assert run(spark, "token=abc x", {}, {"type": "mask", "pattern": "token=\\S+"}) == ("[REDACTED] x", {})
    assert run(spark, "secret", {}, {"type": "mask", "pattern": "("}) == ("[REDACTED]", {})
    assert run(spark, "secret", {}, {"type": "drop", "pattern": "("}, {"type": "regex_extract", "pattern": "(?P<a>("}, {"type": "sample", "pattern": "(", "value": "0"}) == ("secret", {})
    assert run(spark, "GET /x 200", {"path": "old"}, {"type": "regex_extract", "pattern": r"(\w+) (?P<path>/\S*)( (?<status>\d+))?"}) == ("GET /x 200", {"path": "/x", "status": "200"})
    assert run(spark, "GET /x", {}, {"type": "regex_extract", "pattern": r"(?P<path>/\S*)( (?P<status_code>\d+))?"}) == ("GET /x", {"path": "/x", "status_code": ""})
    assert run(spark, "none", {}, {"type": "regex_extract", "pattern": r"(?P<path>/\S*)"}) == ("none", {})
    assert run(spark, "M", {"A": "X"}, {"type": "add_prefix", "value": "svc:"}, {"type": "lowercase", "field": "A"}, {"type": "lowercase", "field": "B"}) == ("svc: M", {"A": "x"})
    assert run(spark, "ÀM", {}, {"type": "lowercase", "field": "message"}) == ("àm", {})
    assert run(spark, "m", {"a": "1", "b": "2"}, {"type": "rename_field", "field": "a", "target": "b"}, {"type": "rename_field", "field": "z", "target": "b"}) == ("m", {"b": "1"})
    assert run(spark, '{"a": 1, "b": {"c": [2]}}', {"a": "0"}, {"type": "json_parse"})[1] == {"a": "1", "b": '{"c":[2]}'}
    assert run(spark, '{"a": 1}', {"raw": '{"b": true}'}, {"type": "json_parse", "field": "raw"})[1] == {"raw": '{"b": true}', "b": "true"}
    assert run(spark, '{"a": 1}', {}, {"type": "json_parse", "field": "raw"})[1] == {"a": "1"}
    assert run(spark, "[1]", {}, {"type": "json_parse"}) == ("[1]", {})
    assert run(spark, "m", {}, {"type": "drop", "pattern": "^m$"}) is None
    assert run(spark, "m", {}, {"type": "set_field", "target": "k", "value": ""}, {"type": "set_field", "value": "x"}, {"type": "other"}, {"type": "mask"}, {"type": "drop"}) == ("m", {"k": ""})
    assert run(spark, "m", {}, {"type": "sample", "value": "0"}) is None and run(spark, "m", {}, {"type": "sample", "value": "many"}) is not None and run(spark, "m", {}, {"type": "sample", "value": "100"}) is not None


def test_pipelines_run_by_number(spark):
    stored = [{"priority": "10", "rules": '[{"type": "add_prefix", "value": "ten"}]'}, {"priority": "2", "rules": '[{"type": "add_prefix", "value": "two"}]'}, {"priority": "1", "enabled": "false", "rules": '[{"type": "drop", "pattern": "."}]'}, {"priority": "x", "rules": " "}]
    df = spark.createDataFrame([("m", {})], "message string, attributes map<string,string>")
    assert logs.pipelines(df, stored).first()["message"] == "ten two m"
    with pytest.raises(ValueError, match="invalid JSON"):
        logs.pipelines(df, [{"rules": "{"}])


def test_rule_checks(spark):
    for good in ("", " ", "[]", '[{"type": "mask", "pattern": "(?P<a>x)"}]', '[{"type": "sample", "value": "100"}, {"type": "set_field", "pattern": "("}]', '[{"type": "sample", "pattern": ""}]'):
        logs.check_rules(good)
    for bad, what in (("{", "JSON"), ('{"type": "drop"}', "JSON"), ('[{"type": 1}]', "JSON"), ('[{"type": "drop", "pattern": "("}]', r"rule 0 \(drop\)"), ('[{}, {"type": "sample", "value": "101"}]', r"rule 1 \(sample\)"), ('[{"type": "sample", "value": "-1"}]', "0-100"), ('[{"type": "sample", "value": "x"}]', "0-100")):
        with pytest.raises(ValueError, match=what):
            logs.check_rules(bad)


def test_times(spark):
    for text, expected in (("2024-02-29", datetime(2024, 2, 29, tzinfo=UTC)), ("2024-02-29T01:02:03.5-01:30", datetime(2024, 2, 29, 2, 32, 3, 500_000, tzinfo=UTC))):
        assert logquery._milliseconds(text, 0) == round(expected.timestamp() * 1000)
    assert json.dumps(logquery._milliseconds("0", 0)) == "0"


def test_unknown_messages_are_false(rows):
    assert rows.filter(logquery.compiled("foo") | F.lit(False)).count() == 2
