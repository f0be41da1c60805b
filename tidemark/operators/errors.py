"""Error grouping, releases, affected users, bursts and ranked text search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scrubbing import first_bytes
from tidemark.sources.model import DAY_MS

# What a message's variable parts are replaced by, in this order.
VARIABLE_PARTS = (
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "{uuid}"),
    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "{ip}"),
    (r"\b[0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4}){7}\b", "{ipv6}"),
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "{email}"),
    (r"https?://[^\s\"'>]+", "{url}"),
    (r"\b[0-9a-fA-F]{32,}\b", "{hash}"),
    (r"\b\d{6,}\b", "{num}"),
    (r"\"[^\"]{20,}\"", '"{str}"'),
    (r"'[^']{20,}'", "'{str}'"),
)
#: Bytes of a title.
TITLE_BYTES = 120
# BM25's usual constants.
K1, B = 1.2, 0.75


def parameterized(message: Column) -> Column:
    for pattern, name in VARIABLE_PARTS:
        message = F.regexp_replace(message, pattern, name)
    return message


def _file(frame: Column) -> Column:
    """Last part of a frame's file name, without query and fragment."""
    return F.regexp_replace(F.regexp_extract(frame["filename"], r"([^/]*)/*$", 1), r"[?#].*$", "")


def group_hash(error_type: Column, message: Column, frames: Column | None = None, custom: Column | None = None, url: Column | None = None, selector: Column | None = None) -> Column:
    """Custom fingerprint, else page and element of a rage click, else type and in-app frames (filename, function,
    in_app), else type and parameterised message."""
    out = F.md5(F.concat_ws("|", error_type, parameterized(message)).cast("binary"))
    if frames is not None:
        own = F.filter(frames, lambda f: f["in_app"])
        parts = F.transform(own, lambda f: F.concat(_file(f), F.lit(":"), F.coalesce(F.nullif(f["function"], F.lit("")), F.lit("<anonymous>"))))
        out = F.when(F.size(own) > 0, F.md5(F.concat_ws("|", error_type, F.array_join(parts, "|")).cast("binary"))).otherwise(out)
    if url is not None and selector is not None:
        out = F.when(error_type == "RageClick", rage_click_hash(F.coalesce(url, F.lit("")), F.coalesce(selector, F.lit("")))).otherwise(out)
    return F.coalesce(F.nullif(custom, F.lit("")), out) if custom is not None else out


def custom_fingerprint(parts: Column) -> Column:
    """What group_hash takes as custom: a digest of the parts that a client sent, empty where it sent none."""
    joined = F.array_join(F.transform(parts, lambda p: F.concat(F.coalesce(p, F.lit("")), F.lit("|"))), "")
    return F.when(F.size(parts) > 0, F.md5(joined.cast("binary"))).otherwise("")


def rage_click_hash(url: Column, selector: Column) -> Column:
    """Group of rage clicks on one element of a page, whatever the page's query."""
    return F.md5(F.concat_ws("|", F.lit("RageClick"), F.regexp_replace(url, r"[?#].*$", ""), selector).cast("binary"))


def title(error_type: Column, message: Column) -> Column:
    """Type and message, up to TITLE_BYTES bytes; longer ones end in three dots behind their last whole code point."""
    kind, text = F.coalesce(error_type, F.lit("")), F.coalesce(message, F.lit(""))
    both = F.when(kind == "", text).when(text == "", kind).otherwise(F.concat_ws(": ", kind, text))
    return F.when(both == "", "Unknown Error").when(text == "", kind).when(F.octet_length(both) <= TITLE_BYTES, both).otherwise(F.concat(first_bytes(both, TITLE_BYTES - 3), F.lit("...")))


def culprit(frames: Column) -> Column:
    """Function and file of the first in-app frame, else of the first; empty without frames."""
    own = F.filter(frames, lambda f: f["in_app"])
    first = F.get(F.when(F.size(own) > 0, own).otherwise(frames), F.lit(0))
    base = F.regexp_extract(first["filename"], r"([^/]*)/*$", 1)
    return F.coalesce(F.when(F.coalesce(first["function"], F.lit("")) != "", F.concat_ws(" in ", first["function"], base)).otherwise(base), F.lit(""))


def grouped(errors: DataFrame) -> DataFrame:
    """One row per issue: count, users, first and last time, newest message.

    Users are distinct known persons, or distinct sessions where no person is known.
    """
    keyed = errors.withColumn("group_hash", group_hash(F.col("error_type"), F.col("message")))
    known = F.count_distinct(F.when(F.col("distinct_id") != "", F.col("distinct_id")))
    return keyed.groupBy("group_hash").agg(
        F.count("*").alias("events"), F.when(known > 0, known).otherwise(F.count_distinct("session_id")).alias("users"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
        F.max_by("message", F.struct("ts_ms", "event_id")).alias("message"),
    )


def merged(issues: DataFrame, merges: DataFrame) -> DataFrame:
    """Issue counts by the issue that each was merged into; merges is (alias, canonical), followed to the end."""
    named = issues.join(merges, F.col("group_hash") == F.col("alias"), "left").withColumn("issue", F.coalesce("canonical", "group_hash"))
    return named.groupBy("issue").agg(F.sum("events").alias("events"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


def daily(errors: DataFrame, first_day: int, days: int) -> DataFrame:
    """(day_ms, events), with zeros, for days counted from the epoch."""
    counts = errors.groupBy(F.expr(f"ts_ms div {DAY_MS}").alias("day")).agg(F.count("*").alias("events"))
    spine = errors.sparkSession.range(first_day, first_day + days).withColumnRenamed("id", "day")
    return spine.join(counts, "day", "left").select((F.col("day") * DAY_MS).alias("day_ms"), F.coalesce("events", F.lit(0)).alias("events"))


def release_health(errors: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per release: sessions, sessions with an error, share of those without, share of all sessions, errors, groups."""
    keyed = errors.withColumn("group_hash", group_hash(F.col("error_type"), F.col("message")))
    bad = keyed.groupBy("release", "session_id").agg(F.count("*").alias("errors"))
    of = sessions.join(bad, ["release", "session_id"], "left").groupBy("release").agg(F.count("*").alias("sessions"), F.count("errors").alias("crashed"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"))
    groups = keyed.groupBy("release").agg(F.count_distinct("group_hash").alias("groups"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    everything = F.sum("sessions").over(Window.partitionBy(F.lit(0)))
    return of.join(groups, "release", "left").select(
        "release", "sessions", "crashed", "errors", (100 - 100 * F.col("crashed") / F.col("sessions")).alias("crash_free_pct"), (100 * F.col("sessions") / everything).alias("adoption_pct"), F.coalesce("groups", F.lit(0)).alias("groups"), "first_ms", "last_ms"
    )


def spike_limited(errors: DataFrame, by: str, limit: int, one_in: int = 10) -> DataFrame:
    """Errors within limit a minute and group; beyond it every one_in-th is kept."""
    order = Window.partitionBy(by, F.expr("ts_ms div 60000")).orderBy("ts_ms", "event_id")
    return errors.withColumn("n", F.row_number().over(order)).filter((F.col("n") <= limit) | ((F.col("n") - limit) % one_in == 0)).drop("n")


def bursts(errors: DataFrame, by: str, width_ms: int = 300_000, least: int = 30, factor: float = 4.0, trailing: int = 12, quiet: int = 12) -> DataFrame:
    """(by, bucket_ms, events, mean): an issue's buckets with `least` events and factor times the mean of those before.

    The mean is over `trailing` buckets, empty ones included. After one that counts, the next `quiet` - 1 do not.
    """
    counts = errors.groupBy(by, F.expr(f"ts_ms div {width_ms}").alias("b")).agg(F.count("*").alias("events"))
    before = Window.partitionBy(by).orderBy("b").rangeBetween(-trailing, -1)
    marked = counts.withColumn("mean", F.coalesce(F.sum("events").over(before), F.lit(0)) / trailing)
    crossed = marked.filter((F.col("events") >= least) & (F.col("events") >= factor * F.col("mean")))
    ordered = crossed.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("b", "events", "mean"))).alias("all"))
    apart = F.aggregate("all", F.slice("all", 1, 1), lambda kept, x: F.when(x["b"] >= F.element_at(kept, -1)["b"] + quiet, F.concat(kept, F.array(x))).otherwise(kept))
    return ordered.select(by, F.explode(apart).alias("x")).select(by, (F.col("x.b") * width_ms).alias("bucket_ms"), "x.events", "x.mean")


def releases_of(errors: DataFrame) -> DataFrame:
    """(group_hash, release, events, first_ms, last_ms): the releases that each issue was seen in."""
    keyed = errors.withColumn("group_hash", group_hash(F.col("error_type"), F.col("message"))).filter("release <> ''")
    return keyed.groupBy("group_hash", "release").agg(F.count("*").alias("events"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


def counted_since(errors: DataFrame, statuses: DataFrame, merges: DataFrame, since_ms: int, release: str) -> DataFrame:
    """(issue, status, events_since, events_since_in_release, last_ms, latest_release) of the issues of statuses.

    Errors count for the issue that theirs was merged into; merges is (alias, canonical), followed to the end, statuses
    (issue, status). Last are time and release of the newest error, of equally new ones that of the smallest id; they are
    null where an issue has none.
    """
    keyed = errors.select("ts_ms", "event_id", "release", group_hash(F.col("error_type"), F.col("message")).alias("group_hash"))
    named = keyed.join(merges, F.col("group_hash") == F.col("alias"), "left").withColumn("issue", F.coalesce("canonical", "group_hash"))
    since = F.col("ts_ms") >= since_ms
    counts = named.groupBy("issue").agg(
        F.count_if(since).alias("events_since"), F.count_if(since & (F.col("release") == release)).alias("events_since_in_release"),
        F.max("ts_ms").alias("last_ms"), F.min_by("release", F.struct(-F.col("ts_ms"), F.col("event_id"))).alias("latest_release"),
    )
    targets = statuses.join(merges, F.col("issue") == F.col("alias"), "left_anti")
    shown = targets.join(counts, "issue", "left")
    return shown.select("issue", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("events_since", "events_since_in_release")], "last_ms", "latest_release")


def release_sparkline(errors: DataFrame, sessions: DataFrame, release: str, today_ms: int, days: int = 14) -> DataFrame:
    """(day_ms, sessions, crashed, crash_free_pct) of the last days of a release, today included, empty days with zeros.

    A session (session_id, release, first_ms) belongs to the day it began. It crashed if an error of level error or
    fatal names it within these days. Other numbers of days than 1 to 90 count as 14.
    """
    days = days if 0 < days <= 90 else 14
    last = today_ms // DAY_MS
    inside = lambda c: (F.col(c) >= (last - days + 1) * DAY_MS) & (F.col(c) < (last + 1) * DAY_MS)
    mine = sessions.filter((F.col("release") == release) & inside("first_ms")).select("session_id", F.expr(f"first_ms div {DAY_MS}").alias("day"))
    bad = errors.filter(F.col("level").isin("error", "fatal") & (F.col("session_id") != "") & inside("ts_ms")).select("session_id", F.lit(True).alias("crashed")).distinct()
    counts = mine.join(bad, "session_id", "left").groupBy("day").agg(F.count("*").alias("sessions"), F.count("crashed").alias("crashed"))
    spine = errors.sparkSession.range(last - days + 1, last + 1).withColumnRenamed("id", "day")
    share = F.when(F.col("sessions") > 0, (F.col("sessions") - F.col("crashed")) * 100.0 / F.col("sessions")).otherwise(0.0)
    shown = spine.join(F.broadcast(counts), "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("sessions", "crashed")])  # a row per day
    return shown.select((F.col("day") * DAY_MS).alias("day_ms"), "sessions", "crashed", share.alias("crash_free_pct"))


def postings(docs: DataFrame, doc_id: str, text: Column) -> DataFrame:
    """(doc, term, tf, length): word counts of texts, words being runs of letters and digits in lower case."""
    terms = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    words = docs.select(F.col(doc_id).alias("doc"), terms.alias("terms")).withColumn("length", F.size("terms"))
    return words.select("doc", "length", F.explode("terms").alias("term")).groupBy("doc", "term", "length").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, query: list[str], n: int = 20) -> DataFrame:
    """(doc, score) of the n best documents of an index of postings for the query's words."""
    docs = index.groupBy("doc").agg(F.max("length").alias("length")).agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    found = index.filter(F.col("term").isin([w.lower() for w in query]))
    rare = found.groupBy("term").agg(F.count("*").alias("df"))
    both = found.join(F.broadcast(rare), "term").join(F.broadcast(docs))  # a row per query word; one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return both.groupBy("doc").agg(F.round(F.sum(weight), 6).alias("score")).orderBy(F.desc("score"), "doc").limit(n)
