"""Cohorts: sets of identified persons as one-column frames, combined by set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def universe(events: DataFrame) -> DataFrame:
    """All identified persons of all time; anonymous events belong to nobody."""
    return events.filter("distinct_id <> ''").select("distinct_id").distinct()


def did(events: DataFrame, event_type: str, min_count: int, since_ms: int | None = None) -> DataFrame:
    """Persons with at least min_count events of a type since a time."""
    found = events.filter((F.col("distinct_id") != "") & (F.col("event_type") == event_type))
    if since_ms is not None:
        found = found.filter(F.col("ts_ms") >= since_ms)
    return found.groupBy("distinct_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).select("distinct_id")


def has(events: DataFrame, key: str, value: str, negate: bool = False) -> DataFrame:
    """Persons with any event whose property has the value; negated, all other persons."""
    found = events.filter((F.col("distinct_id") != "") & (F.get_json_object("props", f"$.{key}") == value)).select("distinct_id").distinct()
    return universe(events).join(found, "distinct_id", "left_anti") if negate else found


def cohort(events: DataFrame, rule: dict) -> DataFrame:
    """The persons of a rule tree: {"op": "and" | "or" | "not", "rules": [...]} over event and property leaves."""
    if "op" not in rule:
        if rule["type"] == "event":
            return did(events, rule["name"], rule.get("min_count", 1), rule.get("since_ms"))
        return has(events, rule["key"], rule["value"], rule.get("operator") == "!=")
    parts = [cohort(events, r) for r in rule["rules"]]
    if rule["op"] == "and":
        return reduce(lambda a, b: a.join(b, "distinct_id", "left_semi"), parts)
    joined = reduce(lambda a, b: a.unionByName(b), parts).distinct()
    return joined if rule["op"] == "or" else universe(events).join(joined, "distinct_id", "left_anti")


def members(changes: DataFrame) -> DataFrame:
    """Static members of (entity_id, removed, version): the newest change counts, a removal wins a tie."""
    newest = changes.groupBy("entity_id").agg(F.max(F.struct("version", "removed")).alias("x"))
    return newest.filter("not x.removed").select("entity_id")


def within(events: DataFrame, persons: DataFrame) -> DataFrame:
    return events.join(persons, "distinct_id", "left_semi")
