"""SimHash near-duplicates, linked through a grid of segment bit counts.

A 64-bit fingerprint is cut into 32 two-bit segments and embedded as the vector of their bit counts. Manhattan
distance between two embeddings never exceeds the Hamming distance of the fingerprints, so it bounds the search:
with at most k differing bits, the vectors differ in at most k segments. The segments are dealt into k + 4 blocks;
two fingerprints in reach agree on at least four whole blocks, so each fingerprint enters one grid cell per choice
of four blocks and partners meet in an equal cell. Pairs of a cell are filtered by Manhattan distance, then
verified by exact Hamming distance.

Cells with more than CELL_ROWS distinct fingerprints (a large family of near copies) would make too many pairs.
Their members are linked exactly in another way: two fingerprints differ in at most two bits if and only if some
value is within one bit of both, so each member is filed under its 65 values within one bit, and all members
filed under one value (at most 65) are linked to the smallest of them.
"""

from __future__ import annotations

import math
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import beside, free_name, text_bytes
from tidemark.llm.components import connected_components
from tidemark.storage import materialize

SEED = 42
CELL_ROWS = 48
LOW_BITS = 0x5555555555555555


#: The bits of every byte value, lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats included; none for a text without a word."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    width = min(words, len(tokens))
    shingles = map(b" ".join, zip(*(tokens[i : len(tokens) - width + 1 + i] for i in range(width)), strict=True))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(tokens) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero for none."""
    n = len(hashes)
    places = hashes.astype("<u8").view(np.uint8).reshape(n, 8) + np.arange(8) * 256
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS.astype(np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, axis=1, bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words: int) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles (see fingerprints)."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the signed 64-bit SimHash of the whole text.

    A-Z are lower-cased; words are runs of non-blank characters; shingles of `words` words are joined by a space,
    repeats included. Shorter texts are one shingle; null texts and texts without a word have fingerprint zero.
    """

    def run(batches):
        for batch in batches:
            starts, data = text_bytes(batch.column(1))
            raw = data.data
            fps = np.fromiter((fingerprint(bytes(raw[starts[i] : starts[i + 1]]), words) for i in range(len(starts) - 1)), np.uint64, len(starts) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW_BITS))


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, in unary: 00, 01 or 11 for a count of 0, 1 or 2.

    In this form equal counts are equal bits and Manhattan distance is bit_count(x ^ y).
    """
    odd = F.shiftrightunsigned(fp, 1)
    return _low(fp.bitwiseOR(odd)).bitwiseOR(F.shiftleft(_low(fp.bitwiseAND(odd)), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def grid_masks(max_bits: int) -> list[int]:
    """Bit masks of every choice of four of the max_bits + 4 blocks of segments."""
    blocks = max_bits + 4
    of = [sum(3 << (2 * s) for s in range(32) if s % blocks == b) for b in range(blocks)]
    return [_signed(sum(of[b] for b in choice)) for choice in combinations(range(blocks), 4)]


def fingerprint_links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Edges (a, b) over the column fp of distinct fingerprints that connect exactly those within max_bits bits.

    The edges span the same components as all links within max_bits would (0 to 2 bits).
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the exact path for crowded cells covers 0 to 2 bits")
    vectors = distinct.select("fp", embedding(F.col("fp")).alias("v"))
    cells = F.array(*[F.xxhash64(F.lit(i), F.col("v").bitwiseAND(F.lit(mask))) for i, mask in enumerate(grid_masks(max_bits))])
    filed = vectors.select("fp", "v", F.explode(cells).alias("cell"))
    size = filed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(filed.join(size, "cell"), "cells")
    left = members.filter(F.col("n") <= CELL_ROWS).select("cell", F.col("fp").alias("a"), F.col("v").alias("va"))
    right = left.select("cell", F.col("a").alias("b"), F.col("va").alias("vb"))
    near = (
        left.join(right, "cell")
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("va").bitwiseXOR(F.col("vb"))) <= max_bits))
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        .select("a", "b")
    )
    crowded = members.filter(F.col("n") > CELL_ROWS).select("fp").distinct()
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]) if max_bits == 2 else None
    if max_bits == 2:
        spokes = crowded.select("fp", F.explode(around).alias("value"))
    elif max_bits == 1:  # each edge is filed under the one of its two ends that has the bit cleared
        cleared = F.array(F.col("fp"), *[F.col("fp").bitwiseAND(F.lit(_signed(~(1 << i) & (2**64 - 1)))) for i in range(64)])
        spokes = crowded.select("fp", F.explode(F.array_distinct(cleared)).alias("value"))
    else:
        return near
    hubs = spokes.groupBy("value").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    if max_bits == 1:
        hubs = hubs.withColumn("hub", F.col("value")).filter(F.array_contains("fps", F.col("value")))
    else:
        hubs = hubs.withColumn("hub", F.array_min("fps"))
    stars = hubs.select(F.col("hub").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return near.unionByName(stars)


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document.

    component_id is the smallest doc_id reachable over links of at most max_bits differing bits, itself included
    (null only if no document of the component has an id). Repeated rows give repeated result rows; an empty table
    gives an empty result.
    """
    base = materialize(fingerprints(docs, words), "fingerprints")
    distinct = materialize(base.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected_components(fingerprint_links(distinct, max_bits))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = rooted.join(least, "root").select("fp", "component_id")
    return base.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Wide fingerprints, for links of a given similarity: words of 64 bits, each of eight segments.
WIDE = 8
SEGMENTS = 8 * WIDE
#: Least chance that a pair at the similarity asked for meets in a cell.
RECALL = 0.999
#: Unlike fingerprints that a fingerprint meets in one grid, on average.
STRANGERS = 0.2
#: Standard deviations of the differing bits above what the similarity asked for gives; pairs within are verified.
SPREAD = 3.0
#: Members of a cell that are all compared at once; larger cells are compared in blocks of BLOCK_ROWS.
SMALL_CELL = 24
BLOCK_ROWS = 256
#: Shingles that one step of a block comparison counts.
BLOCK_SHINGLES = 4096
#: Text hashes of 16 bytes that are broadcast at most.
BROADCAST_KEYS = 1_000_000
#: Chance that two unlike segments of eight bits have equal counts.
EQUAL_COUNTS = math.comb(16, 8) / 4**8
#: What each segment multiplies hashes with, to draw its voter and to read the voter's bits.
DRAWS, READS = np.random.default_rng(SEED).integers(1, 1 << 63, (2, SEGMENTS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A count of 0 to 8 in unary, for every byte.
UNARY = ((1 << np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int64)) - 1).astype(np.uint8)
CODES, COUNTS = [f"f{k}" for k in range(WIDE)], [f"v{k}" for k in range(WIDE)]


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SEGMENTS bytes for the distinct shingle hashes of a text, zero for none.

    Each segment holds a SimHash of its own, of one voter: the shingle that comes first in the order that the segment
    draws. Two texts have the same voter with the chance of their Jaccard similarity, and half of the bits in common
    otherwise.
    """
    if not len(hashes):
        return np.zeros(SEGMENTS, np.uint8)
    least, voter = np.full(SEGMENTS, ~np.uint64(0)), np.zeros(SEGMENTS, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        drawn = (part[None, :] ^ DRAWS[:, None]) * READS[:, None]
        drawn ^= drawn >> np.uint64(32)
        drawn *= DRAWS[:, None]
        first = drawn.argmin(axis=1)
        value = drawn[np.arange(SEGMENTS), first]
        better = value < least
        least[better], voter[better] = value[better], part[first[better]]
    mixed = (voter + DRAWS) * READS
    return ((mixed ^ (mixed >> np.uint64(31))) * READS >> np.uint64(56)).astype(np.uint8)


def wide_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, k0, k1, d0, d1, f0 .., v0 ..) of every text.

    k: 128-bit hash of the text; d: of its set of shingles; f: the wide fingerprint; v: its segments' bit counts in
    unary, so that Manhattan distance is the number of differing bits.
    """

    def run(batches):
        for batch in batches:
            starts, data = text_bytes(batch.column(1))
            raw, n = data.data, batch.num_rows
            digests, codes = np.zeros((n, 2), np.int64), np.zeros((n, SEGMENTS), np.uint8)
            for i in range(n):
                h = np.unique(shingle_hashes(bytes(raw[starts[i] : starts[i + 1]]), words))
                digests[i] = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                codes[i] = wide_fingerprint(h)
            columns = [digests, codes.view(np.int64), UNARY[codes].view(np.int64)]
            flat = [pa.array(np.ascontiguousarray(c[:, k])) for c in columns for k in range(c.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *flat], names=["doc_id", "k0", "k1", "d0", "d1", *CODES, *COUNTS])

    schema = ", ".join(f"{c} long" for c in ("doc_id", "k0", "k1", "d0", "d1", *CODES, *COUNTS))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *text_key()).mapInArrow(run, schema)


def text_key() -> tuple[Column, Column]:
    """128-bit hash of the text by which its shingles are found again."""
    text = F.col("text").cast("string")
    return F.xxhash64(text).alias("k0"), F.xxhash64(F.lit(1), text).alias("k1")


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles): distinct shingle hashes of the text of each of nodes (node, k0, k1).

    Up to BROADCAST_KEYS keys travel to the texts; more are joined by a shuffle, with the same rows.
    """

    def run(batches):
        for batch in batches:
            starts, data = text_bytes(batch.column(1))
            raw = data.data
            sets = [np.unique(shingle_hashes(bytes(raw[starts[i] : starts[i + 1]]), words)).view(np.int64) for i in range(len(starts) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    few = nodes.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    texts = docs.select(*text_key(), F.col("text").cast("string").alias("text"))
    wanted = texts.join(F.broadcast(nodes) if few else nodes.hint("merge"), ["k0", "k1"])
    return wanted.groupBy("node").agg(F.min("text").alias("text")).mapInArrow(run, "node long, shingles array<long>")


def verified(open_pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of open_pairs whose shingle sets have at least that Jaccard similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = open_pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return both.filter(F.col("shared") >= similarity * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b")


def cell_plan(rows: int, similarity: float) -> list[list[int]]:
    """Per grid, the segments whose bit counts make a cell.

    Segments per grid grow with the logarithm of the rows, so that unlike fingerprints meet STRANGERS times a grid, and
    the number of grids is what RECALL needs at that similarity.
    """
    each = min(SEGMENTS // 2, max(4, math.ceil(math.log(max(rows, 2) / STRANGERS) / -math.log(EQUAL_COUNTS))))
    meet = (similarity + (1 - similarity) * EQUAL_COUNTS) ** each
    grids = math.ceil(math.log(1 - RECALL) / math.log1p(-meet))
    rng = np.random.default_rng(SEED)
    return [sorted(rng.choice(SEGMENTS, each, replace=False).tolist()) for _ in range(grids)]


def most_bits(similarity: float) -> int:
    """Differing bits up to which a pair is verified: the mean at that similarity and SPREAD deviations more."""
    other = 1 - similarity
    return math.floor(SEGMENTS * 4 * other + SPREAD * math.sqrt(SEGMENTS * (18 * other - (4 * other) ** 2)))


def _near(pairs: DataFrame, distinct: DataFrame, most: int) -> DataFrame:
    """(a, b, bits) of the pairs within most bits: first by the Manhattan distance of bit counts, then exactly."""

    def side(name: str) -> DataFrame:
        return distinct.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}{c}") for c in (*CODES, *COUNTS)])

    def distance(columns: list[str]) -> Column:
        return sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in columns), F.lit(0))

    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(distance(COUNTS) <= most)
    return both.select("a", "b", distance(CODES).alias("bits")).filter(F.col("bits") <= most)


def _ordered(left: str, right: str) -> tuple[Column, Column]:
    return F.least(left, right).alias("a"), F.greatest(left, right).alias("b")


def crowded_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between different groups in crowded cells, one per two groups and block comparison.

    members has cell, node and root, the group that known links give. In each cell all but the largest group are
    compared with all members, exactly and in blocks of BLOCK_ROWS; no task holds more than two blocks.
    """
    sizes = members.groupBy("cell", "root").agg(F.count("*").alias("n"))
    cells = sizes.groupBy("cell").agg(F.max(F.struct("n", "root")).alias("largest"), F.sum("n").alias("all"), F.count("*").alias("roots")).filter("roots > 1")
    cells = cells.select("cell", F.col("largest.root").alias("major"), F.col("largest.n").alias("majors"), (F.col("all") - F.col("largest.n")).alias("minors"))
    blocks = {c: F.expr(f"cast((n{c} + {BLOCK_ROWS - 1}) div {BLOCK_ROWS} as int)") for c in ("minor", "major")}
    each = members.join(cells.withColumnRenamed("majors", "nmajor").withColumnRenamed("minors", "nminor"), "cell").withColumn("bi", blocks["minor"]).withColumn("bj", blocks["major"])
    minor = F.col("root") != F.col("major")
    each = each.withColumn("mine", F.when(minor, F.pmod(F.xxhash64("node"), F.col("bi"))).otherwise(F.col("bi") + F.pmod(F.xxhash64("node"), F.col("bj"))).cast("int"))
    partners = F.when(minor, F.sequence(F.lit(0), F.col("bi") + F.col("bj") - 1)).otherwise(F.sequence(F.lit(0), F.col("bi") - 1))
    dealt = each.select("cell", "node", "root", "mine", F.explode(partners).alias("other")).join(sets, "node")
    dealt = dealt.select("cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "root", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        mine, node, root = (table.column(c).to_numpy() for c in ("mine", "node", "root"))
        left, right = mine == table.column("i")[0].as_py(), mine == table.column("j")[0].as_py()
        column = table.column("shingles").combine_chunks()
        sizes = np.diff(column.offsets.to_numpy())
        _, at, times = np.unique(column.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sizes)), sizes)
        often = times[at] > 1
        row, at = row[often], (np.cumsum(times > 1) - 1)[at[often]]
        order = np.argsort(at, kind="stable")
        row, at = row[order], at[order]
        shared = np.zeros((int(left.sum()), int(right.sum())), np.float32)
        for low in range(0, int(at[-1]) + 1 if len(at) else 0, BLOCK_SHINGLES):
            cut = slice(*np.searchsorted(at, [low, low + BLOCK_SHINGLES]))
            holds = np.zeros((len(sizes), BLOCK_SHINGLES), np.float32)
            holds[row[cut], at[cut] - low] = 1
            shared += holds[left] @ holds[right].T
        linked = shared >= similarity * (sizes[left][:, None] + sizes[right][None, :] - shared) - 1e-6
        a, b = np.nonzero(linked & (root[left][:, None] != root[right][None, :]))
        pairs = np.column_stack((root[left][a], root[right][b]))
        first = np.unique(np.sort(pairs, axis=1), axis=0, return_index=True)[1] if len(pairs) else np.zeros(0, np.int64)
        return pa.table({"a": node[left][a[first]], "b": node[right][b[first]]})

    return dealt.groupBy("cell", "i", "j").applyInArrow(compare, "a long, b long")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of every document; component_id is the smallest doc_id of its group.

    Documents link if the sets of their word shingles have that Jaccard similarity. Texts with equal sets are one
    node. Nodes enter one cell of bit counts per grid. In cells of up to SMALL_CELL nodes all pairs are candidates, in
    others first those with one hub. Candidates within most_bits, by Manhattan distance and then exactly, are verified
    on the sets, unless verified links already join the two; then crowded cells that still hold several groups are
    compared in full (crowded_links). A pair at exactly that similarity meets in a cell with a chance of RECALL, nearer
    ones more surely. Null texts and texts without a word form one group; an empty table gives an empty result.
    """
    base = materialize(wide_fingerprints(docs, words), "wide-fingerprints")
    distinct = base.groupBy("d0", "d1").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("k0", "k1")).alias("key"), *[F.min(c).alias(c) for c in (*CODES, *COUNTS)])
    distinct = materialize(distinct.select("d0", "d1", "first_id", "key.*", *CODES, *COUNTS, F.monotonically_increasing_id().alias("node")), "wide-distinct")

    def cell(grid: int, segments: list[int]) -> Column:
        masks = [_signed(sum(255 << 8 * (s % 8) for s in segments if s // 8 == k)) for k in range(WIDE)]
        return F.xxhash64(F.lit(grid), *[F.col(f"v{k}").bitwiseAND(F.lit(mask)) for k, mask in enumerate(masks) if mask])

    filed = distinct.select("node", F.explode(F.array(*[cell(i, s) for i, s in enumerate(cell_plan(distinct.count(), similarity))])).alias("cell"))
    shared = filed.groupBy("cell").agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter("n > 1")
    members = materialize(filed.join(shared, "cell"), "wide-cells")
    small, crowded = members.filter(F.col("n") <= SMALL_CELL).select("cell", "node"), members.filter(F.col("n") > SMALL_CELL)
    within = small.withColumnRenamed("node", "a").join(small.withColumnRenamed("node", "b"), "cell").filter("a < b").select("a", "b")
    stars = crowded.filter("node <> hub").select(*_ordered("node", "hub"))
    near = materialize(_near(within.unionByName(stars).distinct(), distinct, most_bits(similarity)), "wide-near")

    both_ways = near.select(F.col("a").alias("node"), F.col("b").alias("other"), "bits").unionByName(near.select(F.col("b").alias("node"), F.col("a").alias("other"), "bits"))
    wanted = both_ways.select("node").unionByName(crowded.select("node")).distinct()
    sets = materialize(shingle_sets(docs, distinct.select("node", "k0", "k1").join(wanted, "node"), words), "wide-shingles")
    # First two pairs of each node, with its busiest partner and its nearest; then what these leave apart.
    degrees = both_ways.groupBy("other").agg(F.count("*").alias("degree"))
    best = both_ways.join(degrees, "other").groupBy("node").agg(F.min(F.struct(-F.col("degree"), "other")).alias("busiest"), F.min(F.struct("bits", "other")).alias("nearest"))
    some = best.select("node", F.explode(F.array("busiest.other", "nearest.other")).alias("other"))
    some = some.select(*_ordered("node", "other")).distinct()
    links = materialize(verified(some, sets, similarity), "wide-links")
    grouped = materialize(connected_components(links), "wide-groups")

    def group_of(name: str) -> DataFrame:
        return grouped.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))

    apart = near.join(some, ["a", "b"], "left_anti").join(group_of("a"), "a", "left").join(group_of("b"), "b", "left")
    apart = apart.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    in_groups = crowded.select("cell", "node").join(group_of("node"), "node", "left").select("cell", "node", F.coalesce("root_node", "node").alias("root"))
    more = verified(apart, sets, similarity).unionByName(crowded_links(in_groups, sets, similarity))
    roots = connected_components(links.unionByName(more))
    rooted = distinct.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("d0", "d1", "first_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_digest = rooted.join(least, "root").select("d0", "d1", "component_id")
    return base.select("doc_id", "d0", "d1").join(by_digest, ["d0", "d1"]).select("doc_id", "component_id")


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id, and one of rows that repeat it.

    Rows without a doc_id stay.
    """
    leader = free_name(docs, "leader")
    leaders = similar_groups(docs, words, similarity).select(F.col("component_id").alias(leader)).filter(F.col(leader).isNotNull()).distinct()
    leaders = beside(materialize(leaders, "leaders"), BROADCAST_KEYS)
    kept = docs.filter("doc_id is not null").join(leaders, F.col("doc_id") == F.col(leader), "left_semi")
    return kept.dropDuplicates(["doc_id"]).unionByName(docs.filter("doc_id is null"))
