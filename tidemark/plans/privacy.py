"""Named queries of secret scrubbing over payloads and replays, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scrubbing
from tidemark.sources import model
from tidemark.sources.model import SQL_EVENTS


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload per event, of which every seventh is cut short and no JSON."""
    ev = model.events(spark, sf_dir)
    whole = F.concat(
        F.lit('{"user":"'), "distinct_id", F.lit('","Pass-Word":"p'), "k", F.lit('","ctx":{"auth_token":'), "k", F.lit(',"tries":['), "k", F.lit(',2.50],"url":"https://x.test'), "pathname", F.lit("?ok="), "k", F.lit("&api_key=S"), "k",
        F.lit('"},"note":"pay 4111-1111-1111-1111 ref '), "k", F.lit('"}'),
    )
    text = F.when(F.col("event_id") % 7 == 3, F.concat(F.lit('{"user":"'), "distinct_id", F.lit('" token='), "k", F.lit("; Bearer abcdefgh"), "k")).otherwise(whole)
    return ev.select("event_id", scrubbing.scrubbed_json(text).alias("payload"))


def _replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = model.events(spark, sf_dir)
    opaque = F.when(F.col("k") % 2 == 0, F.concat(F.lit("abcdefghijklmnopqrstuvwxyz"), "k")).otherwise("plain-segment")
    console = F.concat(F.lit("user "), "distinct_id", F.lit(" api_key: sk_"), "k", F.lit(" from "), F.md5(F.col("pathname").cast("binary")))
    url = F.concat(F.lit("https://me:pw@a.test"), "pathname", F.lit("/"), opaque, F.lit("?q="), "k")
    return ev.select("event_id", scrubbing.console_scrubbed(console, 40).alias("console"), scrubbing.address_scrubbed(url).alias("url"))


QUERIES = {"payload_scrub": _payloads, "replay_scrub": _replays}
ORACLE_SQL = {
    "payload_scrub": f"""WITH {SQL_EVENTS} SELECT event_id, CASE WHEN event_id % 7 = 3 THEN concat('{{"user":"', distinct_id, '" token=[Filtered]; Bearer [Filtered]')
  ELSE concat('{{"Pass-Word":"[Filtered]","ctx":{{"auth_token":"[Filtered]","tries":[', k, ',2.50],"url":"https://x.test', pathname, '?ok=', k, '&api_key=[Filtered]"}},"note":"pay [Filtered] ref ', k, '","user":"', distinct_id, '"}}') END AS payload FROM ev""",
    "replay_scrub": f"""WITH {SQL_EVENTS} SELECT event_id, left(concat('user ', distinct_id, ' api_key: [redacted] from [redacted-hex]'), 40) AS console,
  concat('https://a.test', pathname, '/', if(k % 2 = 0, ':redacted', 'plain-segment')) AS url FROM ev""",
}
