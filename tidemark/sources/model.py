"""The analytics model over the driver's tables: how events, spans, metric points, logs and errors are derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROWSERS = ("Chrome", "Firefox", "Safari", "Edge", "")
COUNTRIES = ("DE", "FR", "US", "")
SOURCES = ("", "google", "twitter", "facebook", "")
REFERRERS = ("", "https://www.google.com/search", "https://t.co/x", "https://news.example.org/a", "https://chatgpt.com/")
#: Further dimensions: values, and the number that picks one.
MORE = {
    "os": (("Windows", "macOS", "iOS", "Android", "Linux", ""), "user_id"), "device": (("desktop", "mobile", "tablet"), "user_id"), "language": (("de", "fr", "en", ""), "user_id"),
    "screen": (("1920x1080", "390x844", "", "820x1180"), "user_id"), "utm_medium": (("", "cpc", "email", "organic", "", "social", "newsletter"), "event_id"), "utm_campaign": (("", "spring", "launch"), "event_id"),
}
HOUR_MS, DAY_MS = 3_600_000, 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_of(values: tuple[str, ...], number: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(number), F.lit(len(values))) + 1).cast("int"))


def epoch_ms(ts: str) -> Column:
    """Milliseconds of a timestamp column; the session time zone is UTC."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: identities, time in ms, type ('view' is 'pageview'), page, dimensions and properties."""
    raw = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    session = F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyy-MM"))
    ms = epoch_ms("ts")
    return raw.select(
        "event_id", ms.alias("ts_ms"), session.alias("session_id"), F.concat_ws(":", session, F.expr("cast(unix_millis(cast(ts as timestamp)) div 3600000 as string)")).alias("visit_id"),
        F.col("user_id").cast("string").alias("distinct_id"), F.when(F.col("event_type") == "view", "pageview").otherwise(F.col("event_type")).alias("event_type"),
        F.concat(F.lit("/"), F.expr("cast(get_json_object(props, '$.k') as bigint) div 10")).alias("pathname"), k.alias("k"), "value", "props",
        one_of(BROWSERS, "user_id").alias("browser"), one_of(COUNTRIES, "user_id").alias("country"), one_of(SOURCES, "event_id").alias("utm_source"), one_of(REFERRERS, "event_id").alias("referrer"),
        F.concat(F.lit("1."), F.expr("dayofmonth(ts) div 10")).alias("release"), *[one_of(values, number).alias(name) for name, (values, number) in MORE.items()],
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: the trace is the order, line 1 its root, the quantity gives the duration, the part what it is."""
    line = table(spark, sf_dir, "lineitem")
    start = epoch_ms("l_shipdate") + F.col("l_linenumber") * 100
    duration, part = (F.col("l_quantity") * 20).cast("long"), F.col("l_partkey") % 7
    return line.select(
        F.col("l_orderkey").alias("trace_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("span_id"),
        F.when(F.col("l_linenumber") > 1, F.col("l_orderkey") * 10 + F.expr("l_linenumber div 2")).alias("parent_span_id"),
        F.concat("l_returnflag", "l_linestatus").alias("service"), F.concat(F.lit("op"), F.col("l_partkey") % 7).alias("operation"),
        start.alias("start_ms"), duration.alias("duration_ms"), (start + duration).alias("end_ms"), (F.col("l_discount") >= 0.09).alias("is_error"),
        F.when(F.col("l_linenumber") == 1, "server").when(part >= 5, "client").otherwise("internal").alias("kind"),
        F.when(part < 4, F.concat(F.lit("SELECT *\n FROM t"), F.col("l_suppkey") % 3, F.lit(" WHERE id = "), F.col("l_partkey")))
        .when(part == 4, F.concat(F.lit("update stock set note = 'it\\'s "), F.col("l_partkey"), F.lit("' where id = 1.5"))).when(part == 5, "COMMIT").otherwise("").alias("statement"),
        F.when(part == 6, F.concat(F.lit("https://api.example.org/v"), F.col("l_suppkey") % 3)).otherwise("").alias("http_url"),
    )


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of twelve streams: event type by a third of the users; the value is the property k."""
    return events(spark, sf_dir).select(F.concat_ws("/", "event_type", F.col("distinct_id").cast("long") % 3).alias("stream"), F.col("event_type").alias("metric"), "ts_ms", "event_id", F.col("k").cast("double").alias("value"))


def labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """metric_points with their labels: the third of the users as shard, and the browser where the system is known."""
    shard = (F.col("distinct_id").cast("long") % 3).cast("string")
    pairs = F.map_from_arrays(F.array(F.lit("shard"), F.lit("browser")), F.array(shard, F.when(F.col("os") != "", F.col("browser"))))
    labels = F.map_filter(pairs, lambda _, v: v.isNotNull())
    return events(spark, sf_dir).select(F.concat_ws("/", "event_type", shard).alias("stream"), F.col("event_type").alias("metric"), "ts_ms", "event_id", F.col("k").cast("double").alias("value"), labels.alias("attributes"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: its type gives the level, user and page the message, its session the trace; properties and, for
    some, a status and an environment are the attributes."""
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "WARN").when(F.col("event_type") == "click", "debug").otherwise("info")
    message = F.concat(F.lit("User "), F.col("distinct_id"), F.lit(" visited "), F.col("pathname"), F.lit(" from 10.0.0."), F.col("k"))
    status = F.when(F.col("event_type") == "error", F.col("k") % 5 + 500).when(F.col("event_type") == "click", F.lit(200)).cast("string")
    pairs = F.map_from_arrays(F.array(*map(F.lit, ("k", "http.status", "env"))), F.array(F.col("k").cast("string"), status, F.nullif("device", F.lit("desktop"))))
    return events(spark, sf_dir).select(
        F.col("event_id").alias("log_id"), "ts_ms", level.alias("level"), message.alias("message"), F.col("browser").alias("service"), F.col("session_id").alias("trace_id"),
        F.concat(F.lit("s"), "event_id").alias("span_id"), F.map_filter(pairs, lambda _, v: v.isNotNull()).alias("attributes"),
    )


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events with a type, a message that holds numbers, a release and a user."""
    found = events(spark, sf_dir).filter("event_type = 'error'")
    level = F.when(F.col("k") % 10 == 0, "fatal").when(F.col("k") % 10 < 3, "warning").otherwise("error")
    return found.select("event_id", "ts_ms", "session_id", "distinct_id", "release", level.alias("level"), F.concat(F.lit("E"), F.expr("k div 20")).alias("error_type"), F.concat(F.lit("cannot load item 1000"), F.col("k"), F.lit(" for user"), F.col("distinct_id").cast("long") % 5).alias("message"))


#: The same model in SQL, as common table expressions that the expected results start from.
SQL_EVENTS = """ev AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, concat(user_id, '-', strftime(ts, '%Y-%m')) AS session_id,
    concat(user_id, '-', strftime(ts, '%Y-%m'), ':', epoch_us(ts) // 3600000000) AS visit_id, CAST(user_id AS VARCHAR) AS distinct_id,
    CASE WHEN event_type = 'view' THEN 'pageview' ELSE event_type END AS event_type,
    concat('/', CAST(json_extract_string(props, '$.k') AS BIGINT) // 10) AS pathname, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, props,
    (['Chrome', 'Firefox', 'Safari', 'Edge', ''])[user_id % 5 + 1] AS browser, (['DE', 'FR', 'US', ''])[user_id % 4 + 1] AS country,
    (['', 'google', 'twitter', 'facebook', ''])[event_id % 5 + 1] AS utm_source,
    (['', 'https://www.google.com/search', 'https://t.co/x', 'https://news.example.org/a', 'https://chatgpt.com/'])[event_id % 5 + 1] AS referrer,
    concat('1.', day(ts) // 10) AS release, """ + ", ".join(f"({list(values)})[{number} % {len(values)} + 1] AS {name}" for name, (values, number) in MORE.items()) + """
  FROM events)"""
SQL_SPANS = """sp AS (
  SELECT l_orderkey AS trace_id, l_orderkey * 10 + l_linenumber AS span_id, CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + l_linenumber // 2 END AS parent_span_id,
    concat(l_returnflag, l_linestatus) AS service, concat('op', l_partkey % 7) AS operation, epoch_us(l_shipdate) // 1000 + l_linenumber * 100 AS start_ms,
    CAST(l_quantity * 20 AS BIGINT) AS duration_ms, epoch_us(l_shipdate) // 1000 + l_linenumber * 100 + CAST(l_quantity * 20 AS BIGINT) AS end_ms,
    l_discount >= 0.09 AS is_error, CASE WHEN l_linenumber = 1 THEN 'server' WHEN l_partkey % 7 >= 5 THEN 'client' ELSE 'internal' END AS kind,
    CASE WHEN l_partkey % 7 < 4 THEN concat('SELECT *', chr(10), ' FROM t', l_suppkey % 3, ' WHERE id = ', l_partkey) WHEN l_partkey % 7 = 4 THEN concat('update stock set note = ''it\\''s ', l_partkey, ''' where id = 1.5')
      WHEN l_partkey % 7 = 5 THEN 'COMMIT' ELSE '' END AS statement, CASE WHEN l_partkey % 7 = 6 THEN concat('https://api.example.org/v', l_suppkey % 3) ELSE '' END AS http_url
  FROM lineitem)"""
