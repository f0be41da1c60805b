"""Performance issues in spans: repeated and serial queries under one parent, slow queries, slow outbound calls.

A detector gives a row for each finding: kind, fingerprint, trace_id, severity, title, description, first_ms, last_ms.
Spans have trace_id, span_id, parent_span_id, service, operation, start_ms, end_ms, duration_ms and, where known, kind,
db_system, statement, http_url, http_method and http_host; a missing column counts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one run, serial queries and their milliseconds together, and milliseconds of one query and of one call.
REPEATED, SERIAL, SERIAL_MS, SLOW_QUERY_MS, SLOW_CALL_MS = 4, 3, 100, 1000, 3000
#: Code points of a statement or an address in a description.
SHOWN = 200

_BLANKS = " \t\n\r\v\f"


def _text(spans: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in spans.columns else F.lit("")


def fingerprint(statement: Column) -> Column:
    """A SELECT, INSERT, UPDATE or DELETE with its quoted texts and runs of digits as ?, blanks collapsed; else empty.

    Digits inside names count too. A backslash protects the next character of a quoted text, which may lack its end.
    """
    text = F.btrim(statement, F.lit(_BLANKS))
    bare = F.regexp_replace(text, r"(?s)'(?:\\.|[^'\\])*+\\?'?|[0-9][0-9.]*", "?")
    known = F.upper(F.substring(text, 1, 6)).isin("SELECT", "INSERT", "UPDATE", "DELETE")
    return F.when(known, F.btrim(F.regexp_replace(bare, r"[ \t\n\r]+", " "), F.lit(_BLANKS))).otherwise("")


def hashed(*parts: Column | str) -> Column:
    """Sixteen hexadecimal digits of SHA-1 over the parts, which a zero byte separates."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.substring(F.sha1(reduce(lambda a, b: F.concat(a, F.lit("\0"), b), columns)), 1, 16)


def is_query(spans: DataFrame) -> Column:
    """A span of a database: one that names a system or a statement, or whose operation begins with db. or sql."""
    operation = F.lower("operation")
    return (_text(spans, "db_system") != "") | (_text(spans, "statement") != "") | operation.startswith("db.") | operation.startswith("sql.")


def is_call(spans: DataFrame) -> Column:
    """An outbound HTTP call: a client span with an address or a method, or whose operation begins with http."""
    operation = F.lower("operation")
    return (_text(spans, "kind") == "client") & ((_text(spans, "http_url") != "") | (_text(spans, "http_method") != "") | operation.startswith("http.") | operation.startswith("http "))


def _statement(spans: DataFrame) -> Column:
    return F.coalesce(F.nullif(_text(spans, "statement"), F.lit("")), F.col("operation"))


def _siblings(spans: DataFrame) -> tuple[DataFrame, Window]:
    """Queries under a parent, with their fingerprints, and the order in which they began, of queries alike by service."""
    found = spans.filter((F.coalesce(F.col("parent_span_id").cast("string"), F.lit("")) != "") & is_query(spans))
    shown = found.select("trace_id", "parent_span_id", "span_id", "service", "start_ms", "end_ms", "duration_ms", fingerprint(_statement(spans)).alias("statement_"))
    return shown, Window.partitionBy("trace_id", "parent_span_id").orderBy("start_ms", "span_id", "end_ms", "statement_", "service")


def _runs(marked: DataFrame, order: Window) -> DataFrame:
    """marked with run: how often new was set up to here."""
    return marked.withColumn("run", F.sum(F.col("new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _severity(threshold: int) -> Column:
    return F.when(F.col("duration_ms") >= 5 * threshold, "error").otherwise("warning")


def repeated_queries(spans: DataFrame, least: int = REPEATED) -> DataFrame:
    """The longest run, of least queries, of neighbouring siblings with one fingerprint; a query without any ends a run.

    Of equal runs the first counts, of queries alike in id, times and fingerprint the smallest service. One sort per
    parent; texts are kept once a run.
    """
    siblings, order = _siblings(spans)
    marked = siblings.withColumn("new", ~F.coalesce((F.col("statement_") == F.lag("statement_").over(order)) & (F.col("statement_") != ""), F.lit(False)))
    at = F.struct("start_ms", "span_id", "end_ms", "service")
    of = _runs(marked, order).filter("statement_ <> ''").groupBy("trace_id", "parent_span_id", "run").agg(
        F.count("*").alias("n"), F.first("statement_").alias("statement_"), F.min_by("service", at).alias("service"), F.min("start_ms").alias("first_ms"), F.max_by("end_ms", at).alias("last_ms")
    )
    best = of.filter(F.col("n") >= least).groupBy("trace_id", "parent_span_id").agg(F.max_by(F.struct("n", "statement_", "service", "first_ms", "last_ms"), F.struct("n", -F.col("run"))).alias("best")).select("trace_id", "parent_span_id", "best.*")
    return best.select(
        F.lit("n_plus_one_db").alias("kind"), hashed("n_plus_one_db", F.col("parent_span_id"), F.col("statement_")).alias("fingerprint"), "trace_id", F.lit("warning").alias("severity"),
        F.format_string("N+1 query: %d repeated DB calls", "n").alias("title"), F.concat("service", F.lit(" — "), F.substring("statement_", 1, SHOWN)).alias("description"), "first_ms", "last_ms",
    )


def serial_queries(spans: DataFrame, least: int = SERIAL, least_ms: int = SERIAL_MS) -> DataFrame:
    """The longest run, of least queries and least_ms together, of siblings that begin when the one before has ended."""
    siblings, order = _siblings(spans)
    marked = siblings.withColumn("new", ~F.coalesce(F.col("start_ms") >= F.lag("end_ms").over(order), F.lit(False)))
    at = F.struct("start_ms", "span_id", "end_ms", "statement_", "service")
    of = _runs(marked, order).groupBy("trace_id", "parent_span_id", "run").agg(
        F.count("*").alias("n"), F.sum("duration_ms").alias("total"), F.min_by("service", at).alias("service"), F.min("start_ms").alias("first_ms"), F.max_by("end_ms", at).alias("last_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "span_id", "end_ms", "statement_"))), lambda x: x["statement_"]), "|").alias("statements"),
    )
    of = of.filter((F.col("n") >= least) & (F.col("total") >= least_ms))
    best = of.groupBy("trace_id", "parent_span_id").agg(F.max_by(F.struct("n", "total", "service", "first_ms", "last_ms", "statements"), F.struct("n", -F.col("run"))).alias("best")).select("trace_id", "parent_span_id", "best.*")
    return best.select(
        F.lit("consecutive_db").alias("kind"), hashed("consecutive_db", F.col("parent_span_id"), F.col("statements")).alias("fingerprint"), "trace_id", F.lit("warning").alias("severity"),
        F.format_string("%d serial DB queries (%dms total)", "n", F.col("total").cast("long")).alias("title"), F.concat("service", F.lit(" — consider parallelizing or batching")).alias("description"), "first_ms", "last_ms",
    )


def slow_queries(spans: DataFrame, least_ms: int = SLOW_QUERY_MS) -> DataFrame:
    """Queries of least_ms and more; five times as much is an error."""
    text = F.coalesce(F.nullif(fingerprint(_statement(spans)), F.lit("")), F.col("operation"))
    return _slow(spans.filter(is_query(spans)), "slow_db_query", "Slow DB query", " — ", text, least_ms)


def slow_calls(spans: DataFrame, least_ms: int = SLOW_CALL_MS) -> DataFrame:
    """Outbound calls of least_ms and more, by address, else host, else operation."""
    target = F.coalesce(F.nullif(_text(spans, "http_url"), F.lit("")), F.nullif(_text(spans, "http_host"), F.lit("")), F.col("operation"))
    return _slow(spans.filter(is_call(spans)), "slow_http_call", "Slow HTTP call", " → ", target, least_ms)


def _slow(spans: DataFrame, kind: str, title: str, arrow: str, what: Column, least_ms: int) -> DataFrame:
    return spans.filter(F.col("duration_ms") >= least_ms).select(
        F.lit(kind).alias("kind"), hashed(kind, F.col("service"), what).alias("fingerprint"), "trace_id", _severity(least_ms).alias("severity"),
        F.format_string(f"{title}: %dms", F.col("duration_ms").cast("long")).alias("title"), F.concat("service", F.lit(arrow), F.substring(what, 1, SHOWN)).alias("description"),
        F.col("start_ms").alias("first_ms"), F.col("end_ms").alias("last_ms"),
    )


def performance_issues(*found: DataFrame) -> DataFrame:
    """One row per fingerprint over the findings of detectors: count, first and last time, the greatest severity, and
    trace, title and description of the newest finding (of equally new ones that of the smallest trace)."""
    each = reduce(DataFrame.unionByName, found)
    rank = F.when(F.col("severity") == "error", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    newest = F.struct(-F.col("last_ms"), F.col("trace_id"), F.col("title"), F.col("description"))
    return each.groupBy("kind", "fingerprint").agg(
        F.count("*").alias("events"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.max_by("severity", rank).alias("severity"),
        *[F.min_by(c, newest).alias(c) for c in ("trace_id", "title", "description")],
    )
