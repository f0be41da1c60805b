"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are read as lower-cased word tokens. Five-token seeds shared with an item make a
document a candidate for it. Each candidate pair is tiled by running Karp-Rabin greedy string tiling (Wise, 1993):
the longest common unmarked runs are marked again and again, so an item that appears in reordered pieces is still
covered. A pair is reported if tiles cover at least the threshold share of the item's tokens.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import beside, free_name, valid_text
from tidemark.storage import materialize

TOKEN = re.compile(r"\w+")
MIN_TILE = 5
THRESHOLD = 0.5
#: Benchmarks with more seeds or characters meet the texts by a shuffle join instead of a broadcast.
BROADCAST_SEEDS, BROADCAST_CHARS = 2_000_000, 64_000_000
#: Text hashes of 16 bytes that are broadcast at most.
BROADCAST_KEYS = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def tile(a: list[int], b: list[int], min_tile: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the greedy tiles of two token lists; negative tokens match nothing."""
    marked_a, marked_b = [x < 0 for x in a], [x < 0 for x in b]
    tiles: list[tuple[int, int, int]] = []
    search = max(min_tile, min(20, len(b)))
    while True:
        matches = _longest(a, b, marked_a, marked_b, search)
        longest = max((m[2] for m in matches), default=0)
        if longest > 2 * search:
            search = longest
            continue
        for at, to, length in sorted(matches, key=lambda m: (-m[2], m[0], m[1])):
            if any(marked_a[at : at + length]) or any(marked_b[to : to + length]):
                continue
            tiles.append((at, to, length))
            marked_a[at : at + length] = marked_b[to : to + length] = [True] * length
        if search <= min_tile:
            # what an overlap left unmarked may still hold a tile
            if not matches or not _longest(a, b, marked_a, marked_b, min_tile):
                return sorted(tiles)
            continue
        search = max(min_tile, search // 2)


def _longest(a: list[int], b: list[int], marked_a: list[bool], marked_b: list[bool], search: int) -> list[tuple[int, int, int]]:
    """Matches of at least search tokens that cannot be extended to the left, found by hashing windows of b."""
    windows: dict[int, list[int]] = defaultdict(list)
    for h, at in _windows(b, marked_b, search):
        windows[h].append(at)
    out = []
    for h, at in _windows(a, marked_a, search):
        for to in windows.get(h, ()):
            if at and to and not marked_a[at - 1] and not marked_b[to - 1] and a[at - 1] == b[to - 1]:
                continue
            length = 0
            while at + length < len(a) and to + length < len(b) and not marked_a[at + length] and not marked_b[to + length] and a[at + length] == b[to + length]:
                length += 1
            if length >= search:
                out.append((at, to, length))
    return out


def _windows(x: list[int], marked: list[bool], size: int):
    """Rolling Karp-Rabin hash of every unmarked window of size tokens."""
    base, mod = 1_000_003, (1 << 61) - 1
    high = pow(base, size, mod)
    value = run = 0
    for i, token in enumerate(x):
        if marked[i]:
            value = run = 0
            continue
        value = (value * base + token + 1) % mod
        run += 1
        if run > size:
            value = (value - high * (x[i - size] + 1)) % mod
        if run >= size:
            yield value, i - size + 1


def seed_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of size token ids."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    wide, h = ids.astype(np.uint64), np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        h = (h ^ (wide[k : len(ids) - size + 1 + k] + np.uint64(1))) * BASE
        h ^= h >> np.uint64(32)
    return h


def item_ids(words: list[str], size: int) -> list[str]:
    """The seeds of an item: its windows of size tokens, or all its tokens where it has fewer."""
    size = min(size, len(words))
    return [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if words else []


RESULT = "item_id long, item_tokens long, covered long, coverage double, n_tiles long, longest long"


class Item:
    """A benchmark item's words as numbers, and what tiling a document with it gives."""

    def __init__(self, item_id: int, text: str) -> None:
        words = tokens(text)
        self.item_id = item_id
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
        self.body = [self.ids[w] for w in words]
        self.least = min(MIN_TILE, len(words))

    def covered_by(self, words: list[str], threshold: float) -> tuple | None:
        """A row of RESULT if tiles cover the threshold share of the item."""
        if not self.body:
            return None
        tiles = tile(_near_seeds([self.ids.get(w, -1) for w in words], self.body, self.least), self.body, self.least)
        covered, n = sum(t[2] for t in tiles), len(self.body)
        return (self.item_id, n, covered, covered / n, len(tiles), max(t[2] for t in tiles)) if covered and covered >= threshold * n else None


def _rows(kept: pa.Array, of: list[int], found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    names = [x.split()[0] for x in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([kept.take(pa.array(of, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["kept", *names])


def covered_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(kept, columns of RESULT): pairs of a row of docs (kept, text) and an item that it covers to the threshold.

    Benchmarks of up to BROADCAST_SEEDS seeds travel to the texts, and each text is read and tiled once, in place.
    Larger ones meet the texts' seeds in a shuffle; then rows and items travel as numbers, and each pair is tiled for
    itself.
    """
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), valid_text().alias("text")).filter("text is not null")

    def cut(batches):
        for batch in batches:
            rows = [(i, s) for i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for s in dict.fromkeys(item_ids(tokens(t), MIN_TILE))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["item", "seed"])

    numbered = materialize(wanted.withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    seeds = materialize(numbered.select("item", "text").mapInArrow(cut, "item long, seed string"), "benchmark-seeds")
    if seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS and (numbered.agg(F.sum(F.length("text"))).first()[0] or 0) <= BROADCAST_CHARS:
        return _broadcast_pairs(docs, numbered, seeds, threshold)
    return _joined_pairs(docs, numbered, seeds, threshold)


def _broadcast_pairs(docs: DataFrame, items: DataFrame, seeds: DataFrame, threshold: float) -> DataFrame:
    owners: dict[str, list[int]] = defaultdict(list)
    for row in seeds.collect():
        owners[row["seed"]].append(row["item"])
    bodies = {r["item"]: Item(r["item_id"], r["text"]) for r in items.collect()}
    vocabulary = {w: i for i, w in enumerate(sorted({w for s in owners for w in s.split(" ")}))}
    by_length: dict[int, dict[int, list[int]]] = defaultdict(dict)
    for seed, of in owners.items():
        words = seed.split(" ")
        key = int(seed_hashes(np.array([vocabulary[w] for w in words]), len(words))[0])
        by_length[len(words)][key] = sorted({*by_length[len(words)].get(key, ()), *of})
    model = docs.sparkSession.sparkContext.broadcast((vocabulary, {n: (np.array(sorted(x), np.uint64), x) for n, x in by_length.items()}, bodies))

    def find(batches):
        vocab, tables, whole = model.value
        for batch in batches:
            of, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if not text:
                    continue
                words = TOKEN.findall(text.lower())
                ids = np.fromiter((vocab.get(w, -1) for w in words), np.int64, len(words))
                hit: set[int] = set()
                for n, (known, owned) in tables.items():
                    if len(ids) < n:
                        continue
                    full = np.flatnonzero(np.convolve(ids >= 0, np.ones(n, np.int64), "valid") == n)
                    if len(full):
                        h = seed_hashes(ids, n)[full]
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        for x in np.unique(h[known[at] == h]):
                            hit.update(owned[int(x)])
                rows = [r for k in sorted(hit) if (r := whole[k].covered_by(words, threshold))]
                of += [i] * len(rows)
                found += rows
            yield _rows(batch.column(0), of, found)

    source = docs.select("kept", "text")
    return source.mapInArrow(find, f"kept {source.schema['kept'].dataType.simpleString()}, {RESULT}")


def _joined_pairs(docs: DataFrame, items: DataFrame, seeds: DataFrame, threshold: float) -> DataFrame:
    """The same pairs by a shuffle join on seeds, for benchmarks too large to broadcast.

    Rows are numbered in a written table. A seed is looked up once per text; a row's items are then gathered, and
    texts meet them once per row.
    """
    lengths = [r["n"] for r in seeds.select(F.size(F.split("seed", " ")).alias("n")).distinct().collect()]  # at most MIN_TILE

    def cut(batches):
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(text)
                found = list({" ".join(words[i : i + n]) for n in lengths for i in range(len(words) - n + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int64()), pa.array(found, pa.string())], names=["row", "seed"])

    def tiled(batches):
        for batch in batches:
            of, found = [], []
            for i, (text, item_id, body) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                if row := Item(item_id, body).covered_by(tokens(text), threshold):
                    of.append(i)
                    found.append(row)
            yield _rows(batch.column(0), of, found)

    rows = materialize(docs.select("kept", "text").withColumn("row", F.monotonically_increasing_id()), "benchmark-texts")
    pairs = rows.select("row", "text").mapInArrow(cut, "row long, seed string").join(seeds.hint("merge"), "seed").select("row", "item").distinct()
    met = rows.join(pairs, "row").join(items.select("item", "item_id", F.col("text").alias("body")).hint("merge"), "item").select("kept", "text", "item_id", "body")
    return met.mapInArrow(tiled, f"kept {rows.schema['kept'].dataType.simpleString()}, {RESULT}")


def contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, item_tokens, covered, coverage, n_tiles, longest) of pairs covered to the threshold.

    items has item_id and text; other columns on either side are ignored. Null or empty texts on either side match
    nothing; what is not valid UTF-8 reads as U+FFFD; items shorter than MIN_TILE tokens must appear whole. Repeated document rows give repeated result rows;
    the item rows of a repeated item_id are tiled each for itself.
    """
    found = covered_items(docs.select(F.col("doc_id").cast("long").alias("kept"), valid_text().alias("text")), items, threshold)
    return found.withColumnRenamed("kept", "doc_id")


def _near_seeds(a: list[int], b: list[int], least: int) -> list[int]:
    """a cut down to the runs that tiles can lie in: tokens of shared windows, one separator between runs."""
    seeds = {tuple(b[i : i + least]) for i in range(len(b) - least + 1)}
    out: list[int] = []
    until = 0
    for i in range(len(a) - least + 1):
        if a[i] >= 0 and tuple(a[i : i + least]) in seeds:
            if i > until and out:
                out.append(-1)
            out += a[max(i, until) : i + least]
            until = i + least
    return out


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text holds a benchmark item to the threshold, whatever their id; other rows stay."""
    text = valid_text()
    key = F.struct(F.xxhash64(text).alias("k0"), F.xxhash64(F.lit(1), text).alias("k1"))
    leak = free_name(docs, "leak")
    leaks = covered_items(docs.select(key.alias("kept"), text.alias("text")), items, threshold).select(F.col("kept").alias(leak)).distinct()
    return docs.join(beside(materialize(leaks, "leaks"), BROADCAST_KEYS), key == F.col(leak), "left_anti")
