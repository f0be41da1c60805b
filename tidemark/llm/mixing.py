"""Mixing sources to target weights, by fixed-length token blocks.

The words of a source are laid end to end in a pseudorandom document order and packed into blocks of BLOCK_WORDS.
Each source's number of block draws follows from its target; every draw is dealt to an output shard by a hash, so
a source's counts over shards are one multinomial draw with an exact total. Slots of (source, shard) are numbered
through and mapped to block indexes by a per-source pseudorandom permutation, pass after pass; blocks are joined
by index. Only DataFrame expressions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, row_key
from tidemark.storage import materialize

BLOCK_WORDS = 64
SHARE = 1.5
#: Weights by source in code-point order, repeating; null comes last.
WEIGHTS = (3, 1, 2)
LIMIT = 2
SHARDS = 16
ROUNDS = 12
DRAWS_PER_TASK = 1 << 16
#: Documents whose running word offsets one window computes at once, on average.
RUN_ROWS = 20_000
#: Runs of a source at least, so that one source is never one task.
LEAST_RUNS = 64


def permuted(x: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 (swap-or-not shuffle; Hoang, Morris and Rogaway, 2012)."""

    def swap(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r, F.lit("k")), n) - at, n)
        coin = F.xxhash64(key, r, F.greatest(at, partner)).bitwiseAND(F.lit(1))
        return F.when(coin == 1, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, swap)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, sid, target) of sources (source, source_size): one row per source.

    Sources share SHARE of all words by weight; none exceeds LIMIT times its size, and what it can't take is shared
    again by weight. In order of size per weight, the full sources come first, so one pass finds the water level.
    """
    listed = sizes.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighted = listed.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("sid") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    limited = weighted.withColumn("most", LIMIT * F.col("source_size").cast("double"))
    by_fill = Window.orderBy(F.col("most") / F.col("w"), "sid")
    ahead, rest, everything = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    level = (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(ahead), F.lit(0.0))) / F.sum("w").over(rest)
    filled = limited.withColumn("level", level).withColumn("full", F.col("most") <= F.col("level") * F.col("w"))
    final = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return filled.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * final)).select("source", "source_size", "sid", "target")


def _laid_out(docs: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their word offset in their source, sources with targets, blocks and draws)."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialize(
        docs.select("doc_id", "source", *keep, F.size(F.regexp_extract_all(body, F.lit(WORD), F.lit(0))).cast("long").alias("size"), row_key().alias("key"), F.monotonically_increasing_id().alias("tie")),
        "mix-rows",
    )
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS)
    draws = F.when(F.col("source_size") > 0, F.least(LIMIT * blocks, F.round(blocks * F.col("target") / F.col("source_size")).cast("long"))).otherwise(F.lit(0))
    sources = materialize(sources.withColumn("blocks", blocks).withColumn("draws", draws.cast("long")), "mix-sources")

    runs = max(LEAST_RUNS, math.ceil(rows.count() / RUN_ROWS))
    placed = rows.select("tie", "source", "size", "key", F.pmod(F.xxhash64(F.lit("run"), "key"), F.lit(runs)).alias("run"))
    placed = placed.join(sources.select("source", "sid"), placed.source.eqNullSafe(sources.source)).drop("source")
    totals = placed.groupBy("sid", "run").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    within = Window.partitionBy("sid", "run").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(totals, ["sid", "run"])
    return rows, sources, offsets.select("tie", "sid", "size", (F.col("base") + F.col("inner")).alias("offset"))


def draws(sources: DataFrame) -> DataFrame:
    """(sid, shard, pass_no, block): one row per drawn block; sources without words or draws give none.

    Spark takes the result for as small as sources, which it is not: joins with it name their kind.
    """
    some = sources.filter("draws > 0").select("sid", "draws", "blocks")
    tasks = max(1, math.ceil((some.agg(F.sum("draws")).first()[0] or 0) / DRAWS_PER_TASK))
    parts = some.select("sid", "draws", "blocks", F.explode(F.sequence(F.lit(0), F.expr(f"(draws - 1) div {DRAWS_PER_TASK}"))).alias("part"))
    spread = parts.repartition(tasks, "sid", "part")
    last = F.least(F.col("draws"), (F.col("part") + 1) * DRAWS_PER_TASK) - 1
    each = spread.select("sid", F.explode(F.sequence(F.col("part") * DRAWS_PER_TASK, last)).alias("draw"))
    counts = each.groupBy("sid", F.pmod(F.xxhash64(F.lit("shard"), "sid", "draw"), F.lit(SHARDS)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.withColumn("from", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(some.drop("draws"), "sid")
    cut = numbered.select("sid", "shard", "blocks", "n", "from", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {DRAWS_PER_TASK}"))).alias("part")).repartition(max(tasks, SHARDS), "sid", "shard", "part")
    slots = cut.select("sid", "shard", "blocks", F.explode(F.sequence(F.col("from") + F.col("part") * DRAWS_PER_TASK, F.col("from") + F.least(F.col("n"), (F.col("part") + 1) * DRAWS_PER_TASK) - 1)).alias("slot"))
    return slots.select("sid", "shard", F.expr("slot div blocks").alias("pass_no"), permuted(F.expr("slot % blocks"), F.col("blocks"), F.col("sid")).alias("block"))


def _pieces(offsets: DataFrame) -> DataFrame:
    """(tie, sid, block, first, words): the part of each block that each document fills; first counts in the document."""
    ends = F.col("offset") + F.col("size")
    spread = offsets.filter("size > 0").select("tie", "sid", "offset", "size", F.explode(F.sequence(F.expr(f"offset div {BLOCK_WORDS}"), F.expr(f"(offset + size - 1) div {BLOCK_WORDS}"))).alias("block"))
    start = F.greatest(F.col("offset"), F.col("block") * BLOCK_WORDS)
    return spread.select("tie", "sid", "block", (start - F.col("offset")).alias("first"), (F.least(ends, (F.col("block") + 1) * BLOCK_WORDS) - start).alias("words"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    size is the number of words (null text: 0), taken the words the mix takes of it, repeats counted: at most
    LIMIT times size. A source's taken words differ from its target by at most two blocks' words or so. Reruns
    agree. Null sources are one source; repeated rows count one by one; an empty table gives an empty result.
    """
    rows, sources, offsets = _laid_out(docs)
    times = draws(sources).groupBy("sid", "block").agg(F.count("*").alias("times"))
    taken = _pieces(offsets).join(times.hint("merge"), ["sid", "block"]).groupBy("tie").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    with_source = rows.join(sources.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
    return with_source.join(taken, "tie", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them, with the same columns: text holds the words taken, pass after pass.

    A document taken whole and once keeps its text as it is; one that is not taken is left out.
    """
    payload = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("document"))
    rows, sources, offsets = _laid_out(payload, "document")
    drawn = draws(sources).select("sid", "block", "pass_no")
    pieces = _pieces(offsets).join(drawn.hint("merge"), ["sid", "block"])
    taken = pieces.groupBy("tie").agg(F.array_sort(F.collect_list(F.struct("pass_no", "first", "words"))).alias("taken"), F.sum("words").alias("n"), F.max("pass_no").alias("passes"))
    text = F.col("document")["text"].cast("string")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def pieces_of(w: Column) -> Column:
        return F.array_join(F.flatten(F.transform("taken", lambda p: F.slice(w, (p["first"] + 1).cast("int"), p["words"].cast("int")))), " ")

    picked = F.transform(F.array(words), pieces_of)[0]  # one array of the words, cut into once per row
    once = (F.col("n") == F.col("size")) & (F.col("passes") == 0)
    joined = rows.join(taken, "tie").withColumn("text", F.when(once, text).otherwise(picked))
    out = {c: F.col("text") if c == "text" else F.length("text").cast("long") if c == "n_chars" else F.col("document")[c] for c in docs.columns}
    return joined.select(*[expr.alias(c) for c, expr in out.items()])
