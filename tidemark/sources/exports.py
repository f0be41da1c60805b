"""Sinks: CSV safe for spreadsheets, newline-delimited JSON, and read-only SQL over named views."""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.web import csv_safe


def guarded(df: DataFrame) -> DataFrame:
    """Text columns as csv_safe leaves them."""
    return df.select(*[csv_safe(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_csv(df: DataFrame, path: str) -> None:
    guarded(df).write.option("header", True).csv(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.json(path)


# Functions that a query may call.
FUNCTIONS = frozenset(
    """abs any any_value approx_count_distinct array array_agg array_contains array_join avg between bool_and bool_or ceil ceiling coalesce collect_list collect_set concat concat_ws contains corr count count_if
    date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth dayofweek dense_rank element_at endswith every exp explode extract filter first first_value floor from_unixtime get_json_object greatest hour if ifnull
    instr isnotnull isnull lag last last_value lead least left length like ln log lower lpad ltrim max max_by md5 mean median min min_by minute mod month nullif ntile nvl percent_rank percentile percentile_approx pmod pow
    power quarter rank regexp_extract regexp_like regexp_replace replace right rlike round row_number rpad rtrim second sha2 sign size some split sqrt startswith std stddev stddev_pop stddev_samp substr substring sum timestamp
    to_date to_timestamp transform trim try_cast try_divide unix_millis unix_timestamp upper var_pop var_samp variance week weekofyear when xxhash64 year
    and or not + - * / % = == < > <= >= <> != <=> ||""".split()
)


#: Nodes of a parsed plan that name data or code in other ways than by a plain name.
_OTHER_WAYS = frozenset(
    """UnresolvedTableValuedFunction UnresolvedTableSpec UnresolvedIdentifier PlanWithUnresolvedIdentifier ExpressionWithUnresolvedIdentifier ScriptTransformation UnresolvedInlineTable
    UnresolvedTable UnresolvedView UnresolvedTableOrView RelationTimeTravel UnresolvedTVFAliases""".split()
)


def _check(nodes: object, scope: frozenset[str]) -> None:
    """Refuses a parsed plan (nodes in pre-order, each with its number of children) that names what is not in scope.

    A table expression is in scope in the query that its WITH belongs to and in the expressions after it, nowhere else.
    Names of tables have one part, so that none reaches another catalogue or schema.
    """
    if isinstance(nodes, dict):
        nodes = [nodes] if "class" in nodes else list(nodes.values())
    if not isinstance(nodes, list):
        return
    at = 0
    while at < len(nodes):
        at = _node(nodes, at, scope) if isinstance(nodes[at], dict) and "class" in nodes[at] else _skip(nodes, at, scope)


def _skip(nodes: list, at: int, scope: frozenset[str]) -> int:
    _check(nodes[at], scope)
    return at + 1


def _node(nodes: list, at: int, scope: frozenset[str]) -> int:
    node = nodes[at]
    kind = str(node["class"]).rsplit(".", 1)[-1]
    parts = [x.strip().lower() for x in str(node.get("multipartIdentifier", node.get("nameParts", node.get("name", "")))).strip("[]").split(",")]
    if kind in _OTHER_WAYS:
        raise ValueError(f"not in scope: {kind}")
    if kind == "UnresolvedRelation" and (len(parts) > 1 or parts[0] not in scope) or kind == "UnresolvedFunction" and ".".join(parts) not in FUNCTIONS:
        raise ValueError(f"not in scope: {'.'.join(parts)}")
    for expression in node.get("cteRelations", ()):
        name = frozenset([str(expression["_1"]).lower()])
        _check(expression["_2"], scope | name if node.get("allowRecursion") else scope)
        scope |= name
    for field, value in node.items():
        if field != "cteRelations":
            _check(value, scope)
    at += 1
    for _ in range(int(node.get("num-children", 0))):
        at = _node(nodes, at, scope)
    return at


def _scoped(spark: SparkSession, query: str, tables: dict[str, str], columns: dict[str, list[str]] | None, limit: int) -> tuple[SparkSession, str]:
    """A session of its own that knows the tables only, and the query as a subquery, found to be in scope."""
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    text = f"SELECT * FROM ({query}\n) LIMIT {int(limit)}"
    _check(json.loads(own._jsparkSession.sessionState().sqlParser().parsePlan(text).toJSON()), frozenset(t.lower() for t in tables))
    for name, path in tables.items():
        shown = own.read.parquet(path)
        (shown.select(*[f"`{c}`" for c in columns[name]]) if columns and name in columns else shown).createOrReplaceTempView(name)
    return own, text


def ask(spark: SparkSession, query: str, tables: dict[str, str], limit: int = 100, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """At most limit rows of a query over Parquet tables, given by name and path, and shown with the given columns only.

    The query is wrapped as a subquery, which Spark's own parser accepts for queries alone, in a session of its own
    that reads no files by path. What the parsed query names must be among the tables, its common table expressions
    where they are in scope, and FUNCTIONS; anything else is refused before anything runs.
    """
    own, text = _scoped(spark, query, tables, columns, limit)
    return own.sql(text)


def explained(spark: SparkSession, query: str, tables: dict[str, str], limit: int = 100, columns: dict[str, list[str]] | None = None) -> str:
    """The plan of a query that ask() would run, without running it."""
    own, text = _scoped(spark, query, tables, columns, limit)
    return own.sql(f"EXPLAIN FORMATTED {text}").first()[0]


def answered(spark: SparkSession, query: str, tables: dict[str, str], limit: int = 100, columns: dict[str, list[str]] | None = None, seconds: float = 10) -> list[Row]:
    """The rows of ask(), which Spark is told to stop looking for after some seconds."""
    own, text = _scoped(spark, query, tables, columns, limit)
    jobs, tag, done = spark.sparkContext, f"ask-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        if not done.wait(seconds):
            while not done.wait(0.2):  # a query may have several jobs one after another
                jobs.cancelJobsWithTag(tag)

    jobs.addJobTag(tag)
    watch = threading.Thread(target=stop, daemon=True)
    watch.start()
    try:
        return own.sql(text).collect()
    finally:
        done.set()
        watch.join()
        jobs.removeJobTag(tag)
