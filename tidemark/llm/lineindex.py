"""Line deduplication through a sharded index of all distinct lines.

Lines are reduced to 96 bits of a digest. Each shard of the digests' range is indexed by a minimal perfect hash over its
distinct lines, with an array of 32-bit fingerprints, one of document counts, and the first document of every line that
others hold too. Documents send the digests of their lines to the shards, which look them up in the arrays, and get back
the first document of those that repeat; lines and texts are neither joined nor sorted by line. The few lines that very
many documents hold are looked up where the documents are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.perfecthash import PerfectHash
from tidemark.storage import materialize

#: Stands for a null id: after all others.
NO_ID = 2**63 - 1
#: Lines in more documents than this, and than this share of all (document, line) pairs, are at most 1 / HOT_SHARE many:
#: 20 bytes each, they travel to the documents.
HOT_DOCS, HOT_SHARE = 2_000, 1 / 200_000
#: Shards for each shuffle partition: enough that the partitions are alike.
SHARDS_A_PARTITION = 8

_CONTINUED = bytes(range(0x80, 0xC0))


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without blanks around it, A-Z lower-cased; None where it has under min_chars code points."""
    key = line.strip().lower()  # of bytes: the six ASCII blanks, A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.translate(None, _CONTINUED)) < min_chars:
        return None
    return key


def digests(text: bytes | None, min_chars: int) -> set[bytes]:
    """16-byte digests of the distinct keys of a text."""
    keys = {line_key(x, min_chars) for x in (text or b"").split(b"\n")}
    keys.discard(None)
    return {xxhash.xxh3_128_digest(k) for k in keys}


def key_arrays(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64 bits, 32 bits) of digests."""
    each = np.frombuffer(b"".join(blobs), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(each[:, 0]), each[:, 1].astype(np.uint32)


def shard_of(k0: np.ndarray, shards: int) -> np.ndarray:
    return ((k0 >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def by_key(k0: np.ndarray, k1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that puts equal keys together, where each key begins in it)."""
    order = np.lexsort((k1, k0))
    a, b = k0[order], k1[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


@dataclass(frozen=True)
class Shard:
    """Arrays of one shard, each in the order of the perfect hash; first only has the lines with two documents or more."""

    number: PerfectHash
    fingerprint: np.ndarray
    count: np.ndarray
    first: np.ndarray
    #: The other 64 bits of the keys, where documents may ask for lines that are not in the index.
    exact: np.ndarray | None = None

    @classmethod
    def build(cls, k0: np.ndarray, k1: np.ndarray, n: np.ndarray, first: np.ndarray, exact: bool = False) -> Shard:
        number = PerfectHash.build(k0, k1)
        at = number(k0, k1)
        order = np.empty(len(at), np.int64)
        order[at] = np.arange(len(at))
        n, first = n[order], first[order]
        return cls(number, k1[order], np.minimum(n, 2**32 - 1).astype(np.uint32), first[n > 1], k0[order] if exact else None)

    def probe(self, k0: np.ndarray, k1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, first document where they are two or more, else NO_ID) of each key; 0 documents for unknown ones."""
        at = self.number(k0, k1)
        known = at >= 0
        known[known] = self.fingerprint[at[known]] == k1[known]
        if self.exact is not None:
            known[known] = self.exact[at[known]] == k0[known]
        count, first = np.zeros(len(k0), np.int64), np.full(len(k0), NO_ID)
        count[known] = self.count[at[known]]
        several = count > 1
        place = np.cumsum(self.count > 1) - 1
        first[several] = self.first[place[at[several]]]
        return count, first

    def to_row(self) -> tuple[bytes, bytes, bytes, bytes]:
        return self.number.to_bytes(), self.fingerprint.astype("<u4").tobytes(), self.count.astype("<u4").tobytes(), self.first.astype("<i8").tobytes()

    @classmethod
    def from_row(cls, number: bytes, fingerprint: bytes, count: bytes, first: bytes) -> Shard:
        return cls(PerfectHash.from_bytes(number), np.frombuffer(fingerprint, "<u4"), np.frombuffer(count, "<u4"), np.frombuffer(first, "<i8"))


@dataclass(frozen=True)
class LineIndex:
    """table: a row for each shard; hot: the keys, counts and first documents of the lines that travel."""

    table: DataFrame
    shards: int
    min_chars: int
    hot: Shard


def runs_of(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """[lo, hi) of the runs of equal neighbours."""
    edges = np.flatnonzero(np.diff(values)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True) if len(values) else ()


def build_index(docs: DataFrame, min_chars: int = 10, shards: int | None = None) -> LineIndex:
    """Index of all distinct lines of min_chars code points and more, blanks around them and case aside.

    Rows are documents; equal ids are one document as far as the first document goes, and null ids are one, after all
    others. Every line travels once for each batch of rows that holds it, so that a very common line reaches its shard
    in few rows. shards: the memory of a task is that of one shard, so their number follows spark.sql.shuffle.partitions.
    """
    spark = docs.sparkSession
    shards = shards or SHARDS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def gather(batches):
        for batch in batches:
            blobs, ids, rows = [], np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], np.int64), []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = digests(text, min_chars)
                blobs += found
                rows.append(len(found))
            k0, k1 = key_arrays(blobs)
            doc = np.repeat(ids, rows)
            order, at = by_key(k0, k1)
            n, first = np.diff(np.append(at, len(order))), np.minimum.reduceat(doc[order], at) if len(at) else doc
            a, b = k0[order[at]], k1[order[at]]
            columns = [shard_of(a, shards), a.view(np.int64), b.view(np.int32), n.astype(np.int64), first]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "k0", "k1", "n", "doc"])

    def build(batches):
        def finish(parts):
            shard, k0, k1, n, first = (np.concatenate(c) for c in zip(*parts, strict=True))
            k0, k1 = k0.view(np.uint64), k1.view(np.uint32)
            order, at = by_key(k0, k1)
            n, first = np.add.reduceat(n[order], at), np.minimum.reduceat(first[order], at)
            k0, k1 = k0[order[at]], k1[order[at]]
            hot = [{"k0": int(k0[i].view(np.int64)), "k1": int(k1[i].view(np.int32)), "n": int(n[i]), "first": int(first[i])} for i in np.flatnonzero(n > HOT_DOCS)]
            row = [int(shard[0]), int(n.sum()), *Shard.build(k0, k1, n, first).to_row(), hot]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        open_: list[tuple] = []
        for batch in batches:
            columns = [batch.column(i).to_numpy() for i in range(5)]
            for lo, hi in runs_of(columns[0]):
                if open_ and open_[0][0][0] != columns[0][lo]:
                    yield finish(open_)
                    open_ = []
                open_.append(tuple(c[lo:hi] for c in columns))
        if open_:
            yield finish(open_)

    names = ["shard", "pairs", "number", "fingerprint", "count", "first", "hot"]
    hot_type = pa.list_(pa.struct([("k0", pa.int64()), ("k1", pa.int32()), ("n", pa.int64()), ("first", pa.int64())]))
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 4, hot_type]
    seen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(gather, "shard int, k0 long, k1 int, n long, doc long")
    made = seen.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        build, "shard int, pairs long, number binary, fingerprint binary, count binary, first binary, hot array<struct<k0: long, k1: int, n: long, first: long>>"
    )
    table = materialize(made, "line-index")
    pairs = table.agg(F.sum("pairs")).first()[0] or 0
    hot = table.select(F.inline("hot")).filter(F.col("n") > max(HOT_DOCS, pairs * HOT_SHARE)).toPandas()  # at most 1 / HOT_SHARE rows
    arrays = [hot[c].to_numpy(t) for c, t in (("k0", np.int64), ("k1", np.int32), ("n", np.int64), ("first", np.int64))]
    return LineIndex(table, shards, min_chars, Shard.build(arrays[0].view(np.uint64), arrays[1].view(np.uint32), *arrays[2:], exact=True))


def repeated_lines(rows: DataFrame, index: LineIndex, min_docs: int) -> DataFrame:
    """(row, found): of rows (row, text) with any, the keys that min_docs documents hold, with the first of these.

    found: array of (k0, k1, first). Keys that travel with the index are left out.
    """
    shards, min_chars, hot = index.shards, index.min_chars, index.hot

    def send(batches):
        for batch in batches:
            found = [digests(text, min_chars) for text in batch.column(1).to_pylist()]
            k0, k1 = key_arrays([d for ds in found for d in ds])
            row = np.repeat(batch.column(0).to_numpy(), [len(ds) for ds in found])
            rare = hot.probe(k0, k1)[0] == 0
            k0, k1 = k0[rare], k1[rare]
            columns = [shard_of(k0, shards), k0.view(np.int64), k1.view(np.int32), row[rare]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "k0", "k1", "row"])

    def look_up(batches):
        arrays, shard = None, -1
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for lo, hi in runs_of(numbers):
                if numbers[lo] != shard:  # the shard's arrays come before what asks for them
                    shard, arrays = numbers[lo], Shard.from_row(*(batch.column(i)[lo].as_py() for i in range(4, 8)))
                    lo += 1
                if lo == hi:
                    continue
                k0, k1, row = (batch.column(i).slice(lo, hi - lo).to_numpy() for i in range(1, 4))
                count, first = arrays.probe(k0.view(np.uint64), k1.view(np.uint32))
                several = count >= min_docs
                yield pa.RecordBatch.from_arrays([pa.array(c[several]) for c in (row, k0, k1, first)], names=["row", "k0", "k1", "first"])

    blank = [F.lit(None).cast(t).alias(c) for c, t in (("k0", "long"), ("k1", "int"), ("row", "long"))]
    kinds = ["number", "fingerprint", "count", "first"]
    asked = rows.select("row", F.col("text").cast("binary")).mapInArrow(send, "shard int, k0 long, k1 int, row long")
    both = index.table.select("shard", *blank, *kinds).unionByName(asked.select("*", *[F.lit(None).cast("binary").alias(c) for c in kinds]))
    met = both.repartition("shard").sortWithinPartitions("shard", F.col("number").isNull())
    found = met.mapInArrow(look_up, "row long, k0 long, k1 int, first long")
    return found.groupBy("row").agg(F.collect_set(F.struct("k0", "k1", "first")).alias("found"))


def dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """All columns of docs, text without the lines that an earlier document holds, and n_lines, n_dropped.

    A line counts by its key: blanks around it removed, A-Z lower-cased. Keys of min_chars code points and more that
    min_docs documents hold lose all their lines except in the smallest doc_id holding them, which keeps all of its own.
    Rows with equal ids are one document in that they all keep what the smallest id keeps; null ids are one document
    after all others (so is the largest 64-bit id). Null and empty texts are one empty line and stay as they are.
    Texts are cut as bytes: invalid UTF-8 passes through. Columns named n_lines or n_dropped are replaced, all others
    pass through under any name.
    """
    if min_docs < 2:
        raise ValueError("min_docs must be 2 or more")
    index = build_index(docs, min_chars)
    made = ["n_lines", "n_dropped"]
    names = [c for c in docs.columns if c.lower() not in made]
    others = [c for c in names if c.lower() != "text"]
    text = F.col("text").cast("string")
    rows = docs.select(
        F.xxhash64("doc_id", text.isNull(), text).alias("row"), F.col("doc_id").cast("long").alias("doc"), text.cast("binary").alias("text"),
        *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)],
    )
    joined = rows.join(repeated_lines(rows, index, min_docs).hint("merge"), "row", "left").select("doc", "text", "found", *[f"c{k}" for k in range(len(others))])
    hot = index.hot

    def cut(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            for doc, text, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                parts = (text or b"").split(b"\n")
                own = NO_ID if doc is None else doc
                first = {(x["k0"], x["k1"]): x["first"] for x in found or ()}
                keys = [line_key(x, min_chars) for x in parts]
                some = [i for i, k in enumerate(keys) if k is not None]
                gone = set()
                if some and (first or len(hot.first)):
                    k0, k1 = key_arrays([xxhash.xxh3_128_digest(keys[i]) for i in some])
                    count, at = hot.probe(k0, k1)
                    for i, a, b, n, f in zip(some, k0.view(np.int64).tolist(), k1.view(np.int32).tolist(), count.tolist(), at.tolist(), strict=True):
                        if (f if n >= min_docs else first.get((a, b), own)) != own:
                            gone.add(i)
                texts.append(b"\n".join(x for i, x in enumerate(parts) if i not in gone) if gone else text)
                lines.append(len(parts))
                dropped.append(len(gone))
            columns = [pa.array(texts, pa.binary()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=["text", *made, *batch.schema.names[3:]])

    fields = [T.StructField("text", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in made)]
    out = joined.mapInArrow(cut, T.StructType([*fields, *joined.schema.fields[3:]]))
    back = {c: F.col(f"c{k}") for k, c in enumerate(others)}
    return out.select(*[back.get(c, F.col("text").cast("string")).alias(c) for c in names], *made)
