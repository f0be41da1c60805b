"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are numbered once, in a written table, and dealt into blocks by a hash of their content and number, so blocks do
not change with retries and equal rows spread over all blocks. The
number of rows that block i sends to shard j is drawn from the multivariate hypergeometric distribution of a
uniformly random permutation with fixed shard sizes. Rows are permuted within their block, cut by that matrix row,
exchanged, and permuted again within their shard, which makes the whole a uniform shuffle (Sanders, 1998).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import row_key
from tidemark.storage import materialize

#: Rows of a block on average: what one task sorts at once, locally permuted. More where blocks would exceed MAX_BLOCKS,
#: so that the driver draws a matrix of bounded size.
BLOCK_ROWS = 20_000
MAX_BLOCKS = 100_000
#: Urns that numpy draws from.
NUMPY_LIMIT = 10**9
#: Standard deviations beyond which a count has no weight in double precision.
TAIL = 40


def communication_matrix(block_rows: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows that each block sends to each shard; row sums are block_rows, column sums differ by at most one."""
    total = int(block_rows.sum())
    left = np.array([total // shards + (j < total % shards) for j in range(shards)], np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((len(block_rows), shards), np.int64)
    for i, n in enumerate(block_rows):
        out[i] = multivariate_hypergeometric(rng, left, int(n))
        left -= out[i]
    return out


def multivariate_hypergeometric(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """n draws without replacement from the urn left, colour by colour."""
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for j, good in enumerate(left):
        rest -= int(good)
        out[j] = hypergeometric(rng, int(good), rest, n)
        n -= int(out[j])
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good ones among n drawn without replacement.

    Above numpy's limit by inversion: weights around the mode follow from their ratios, which are rational in
    the counts, so no factorial is needed and the draw is exact to double precision at any size.
    """
    if good + bad < NUMPY_LIMIT or not n:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    total = good + bad
    least, most = max(0, n - bad), min(n, good)
    mode = min(max((n + 1) * (good + 1) // (total + 2), least), most)
    reach = math.ceil(TAIL * (1 + math.sqrt(n * (good / total) * (bad / total))))
    down, up = min(reach, mode - least), min(reach, most - mode)
    k = mode + np.arange(up, dtype=np.float64)
    above = np.cumprod((good - k) / (k + 1) * (n - k) / (bad - n + k + 1))
    k = mode - np.arange(down, dtype=np.float64)
    below = np.cumprod(k / (good - k + 1) * (bad - n + k) / (n - k + 1))
    weights = np.concatenate((below[::-1], [1.0], above))
    return mode - down + int(min(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum()), len(weights) - 1))


def _placed(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """rows (key and others) with shard and slot."""
    spark = rows.sparkSession
    total = rows.count()
    blocks = min(MAX_BLOCKS, max(1, math.ceil(total / BLOCK_ROWS)))
    placed = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "key", "tie"), F.lit(blocks)).cast("int"))
    sent = {r["block"]: r["n"] for r in placed.groupBy("block").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix(np.array([sent.get(b, 0) for b in range(blocks)], np.int64), shards, seed)
    cuts = spark.createDataFrame([(b, [int(x) for x in np.cumsum(matrix[b])]) for b in range(blocks)], "block int, cuts array<long>")

    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "key", "tie"), "key", "tie")
    dealt = (
        placed.withColumn("place", F.row_number().over(local))
        .join(cuts, "block")
        .withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("place"))).cast("int"))
        .withColumn("mixed", F.xxhash64(F.lit(seed + 2), "key", "tie"))
        .withColumn("part", F.pmod(F.col("mixed"), F.lit(max(1, blocks // shards))).cast("int"))
        .drop("cuts", "place", "block")
    )
    dealt = materialize(dealt, "shard-dealt")
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    again = Window.partitionBy("shard", "part").orderBy("mixed", "key", "tie")
    numbered = dealt.withColumn("within", F.row_number().over(again)).join(parts, ["shard", "part"])
    return numbered.withColumn("slot", (F.col("first") + F.col("within") - 1).cast("long")).drop("first", "within", "part", "mixed")


def shard(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), law "rows": shard counts at most one apart.

    size is the text's UTF-8 bytes (null: none) plus one, text_crc32 the unsigned CRC-32 of the text (null: empty),
    slot the row's place in its shard, gapless from 0, grown_shard null. Repeated rows are dealt like any others;
    an empty table gives an empty result. The driver holds one number per block and shard, nothing per row.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    figures = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), row_key().alias("key"))
    rows = materialize(_numbered(figures), "shard-rows")
    return _placed(rows, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with tie: tells rows of equal key apart in whatever order they come."""
    return rows.withColumn("tie", F.monotonically_increasing_id())


def sharded_documents(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """All columns of docs with shard and slot (see shard); columns of those names are replaced."""
    payload = docs.select(F.struct(*docs.columns).alias("document"), row_key().alias("key"))
    rows = materialize(_numbered(payload), "shard-documents")
    placed = _placed(rows.select("key", "tie"), shards, seed).drop("key")
    kept = [F.col("document")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return rows.join(placed, "tie").select(*kept, "shard", "slot")
