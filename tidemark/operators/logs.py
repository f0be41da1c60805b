"""Log searches, counts and pipelines. Searches are Columns, built from terms here or from a line of text in logquery."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def level_is(level: str) -> Column:
    """The level as given, or in lower or upper case, or with a capital."""
    return F.col("level").isin(*dict.fromkeys((level, level.lower(), level.upper(), level.capitalize())))


def message_has(text: str) -> Column:
    return F.contains(F.lower("message"), F.lit(text.lower()))


def attribute(key: str, op: str, value: str) -> Column:
    """Test of an attribute: ':' equal text, '>' '>=' '<' '<=' as numbers; a missing attribute never meets it."""
    of = F.col("attributes")[key]
    number = of.try_cast("double")
    return {":": of == value, ">": number > value, ">=": number >= value, "<": number < value, "<=": number <= value}[op]


def known(test: Column) -> Column:
    """Unknown counts as false, so that its negation is true."""
    return F.coalesce(test, F.lit(False))


def all_of(*tests: Column) -> Column:
    """All tests. Unknown ones stay unknown here, which a filter drops like false ones and a scan can evaluate."""
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def none_of(*tests: Column) -> Column:
    """None of the tests. Only here has unknown to become false first: joins of tests without negations agree on it."""
    return ~known(any_of(*tests))


def search(logs: DataFrame, test: Column, n: int = 200, before: tuple[int, int] | None = None) -> DataFrame:
    """The newest n logs that meet a test, before a cursor of (time, id)."""
    found = logs.filter(test)
    if before:
        found = found.filter(F.struct("ts_ms", "log_id") < F.struct(F.lit(before[0]).alias("ts_ms"), F.lit(before[1]).alias("log_id")))
    return found.orderBy(F.desc("ts_ms"), F.desc("log_id")).limit(n)


def level_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.lower("level").alias("level")).agg(F.count("*").alias("logs"))


def histogram(logs: DataFrame, width_ms: int = 300_000) -> DataFrame:
    return logs.groupBy(F.expr(f"(ts_ms div {width_ms}) * {width_ms}").alias("bucket_ms"), F.lower("level").alias("level")).agg(F.count("*").alias("logs"))


#: What a mask leaves.
REDACTED = "[REDACTED]"
_NAMED = re.compile(r"\(\?P?<[A-Za-z_][A-Za-z0-9_]*>")


def compiles(pattern: str) -> bool:
    """Whether Spark can match the pattern; a literal is matched on the driver."""
    try:
        SparkSession.active().sql("SELECT regexp_like('', :p)", {"p": pattern}).collect()
    except PySparkException:
        return False
    return True


def unnamed(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern with its named groups unnamed, and their numbers; no names where there are none to be told."""
    try:
        return _NAMED.sub("(", pattern), dict(re.compile(re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", pattern)).groupindex)
    except re.error:
        return _NAMED.sub("(", pattern), {}


def rules_of(text: str) -> list[dict]:
    """The rules of a JSON list, each an object of texts; blank text is a list without rules."""
    if not text.strip():
        return []
    try:
        rules = json.loads(text)
    except json.JSONDecodeError as error:
        raise ValueError(f"rules: invalid JSON: {error}") from None
    if not isinstance(rules, list) or not all(isinstance(r, dict) and all(isinstance(v, str) for v in r.values()) for r in rules):
        raise ValueError("rules: invalid JSON: a list of objects with texts is expected")
    return rules


def check_rules(text: str) -> None:
    """Refuses rules that could not take effect: patterns that don't compile and shares that aren't 0 to 100."""
    for i, rule in enumerate(rules_of(text)):
        kind, pattern, value = rule.get("type", ""), rule.get("pattern", ""), rule.get("value", "")
        if kind in ("regex_extract", "drop", "mask", "sample") and pattern and not compiles(unnamed(pattern)[0]):
            raise ValueError(f"rule {i} ({kind}): invalid regex {pattern!r}")
        if kind == "sample" and value and not (re.fullmatch(r"[+-]?[0-9]+", value) and 0 <= int(value) <= 100):
            raise ValueError(f"rule {i} (sample): value must be an integer 0-100, got {value!r}")


def pipelines(logs: DataFrame, stored: Iterable[dict]) -> DataFrame:
    """logs after all enabled pipelines (priority, enabled, rules as JSON), in numeric order of priority, ties as given."""

    def priority(p: dict) -> int:
        text = str(p.get("priority", ""))
        return int(text) if re.fullmatch(r"[+-]?[0-9]+", text) else 0

    for p in sorted((p for p in stored if str(p.get("enabled", "true")).lower() == "true"), key=priority):
        logs = pipeline(logs, rules_of(p.get("rules", "")))
    return logs


def pipeline(logs: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """logs (message, attributes) after the rules, in order. A rule whose fields are missing does nothing.

    set_field (target, value), rename_field (field, target), lowercase (field), add_prefix (value, then a blank), mask
    (pattern; one that does not compile hides the whole message), regex_extract (pattern: its named groups become
    attributes, empty where they took no part), json_parse (of the attribute field if there, else of the message: the
    members of an object become attributes), drop (pattern), sample (value: percent kept of what matches pattern, by a
    hash of the message). Rules of other types are passed over.
    """
    for rule in rules:
        name, pattern, target, value = (rule.get(k, "") for k in ("field", "pattern", "target", "value"))
        match rule.get("type"):
            case "set_field" if target:
                logs = logs.withColumn("attributes", _put(target, F.lit(value)))
            case "rename_field" if name and target:
                logs = logs.withColumn("attributes", _renamed(name, target))
            case "lowercase" if name == "message":
                logs = logs.withColumn("message", F.lower("message"))
            case "lowercase":
                logs = logs.withColumn("attributes", F.transform_values("attributes", lambda k, v: F.when(k == name, F.lower(v)).otherwise(v)))
            case "add_prefix" if value:
                logs = logs.withColumn("message", F.concat(F.lit(value + " "), "message"))
            case "mask" if pattern:
                plain = unnamed(pattern)[0]
                logs = logs.withColumn("message", F.regexp_replace("message", plain, REDACTED) if compiles(plain) else F.lit(REDACTED))
            case "regex_extract" if pattern:
                plain, groups = unnamed(pattern)
                if groups and compiles(plain):
                    pairs = F.map_from_arrays(F.array(*map(F.lit, groups)), F.array(*[F.coalesce(F.regexp_extract("message", plain, k), F.lit("")) for k in groups.values()]))
                    logs = logs.withColumn("attributes", F.when(F.col("message").rlike(plain), _with_all(pairs)).otherwise(F.col("attributes")))
            case "json_parse":
                source = F.coalesce(F.col("attributes")[name], F.col("message")) if name else F.col("message")
                logs = logs.withColumn("attributes", _with_all(F.coalesce(F.from_json(source, "map<string,string>"), F.create_map().cast("map<string,string>"))))
            case "drop" if pattern and compiles(plain := unnamed(pattern)[0]):
                logs = logs.filter(~known(F.col("message").rlike(plain)))
            case "sample" if re.fullmatch(r"[+-]?[0-9]+", value):
                plain = unnamed(pattern)[0]
                chosen = known(F.col("message").rlike(plain)) if pattern and compiles(plain) else F.lit(not pattern)
                logs = logs.filter(~chosen | (fnv1a(F.col("message")) % 100 < int(value)))
    return logs


def fnv1a(text: Column) -> Column:
    """Unsigned 32-bit FNV-1a of a text's UTF-8 bytes, each of which Latin-1 reads as one character."""
    octets = F.split(F.decode(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), "ISO-8859-1"), "")
    return F.aggregate(octets, F.lit(2166136261).cast("long"), lambda h, c: F.when(c == "", h).otherwise((h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))))


def _put(key: str, value: Column) -> Column:
    others = F.map_filter("attributes", lambda k, _: k != key)
    return F.map_concat(others, F.create_map(F.lit(key), value))


def _renamed(key: str, to: str) -> Column:
    others = F.map_filter("attributes", lambda k, _: k != to)
    return F.when(F.map_contains_key("attributes", key), F.transform_keys(others, lambda k, _: F.when(k == key, to).otherwise(k))).otherwise(F.col("attributes"))


def _with_all(pairs: Column) -> Column:
    """The attributes with all pairs, null values too, in place of those that share their keys."""
    held = F.transform_values(pairs, lambda _, v: F.struct(v.alias("v")))
    return F.map_zip_with("attributes", held, lambda _, old, new: F.when(new.isNotNull(), new["v"]).otherwise(old))
