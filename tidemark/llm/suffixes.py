"""Exact removal of long repeated strings by a distributed merge sort of suffixes.

Sorting every suffix is not needed to find strings of `length` bytes that occur twice. Each string of that length is
owned by one suffix: the one that starts at the smallest hash of a GRAM-byte gram among its first WINDOW positions.
Equal strings have their owners at equal places, so it is enough to sort the owners (one suffix in about 128), and of
these only those whose first length - WINDOW + 1 bytes have a hash that occurs twice in the corpus.

The owners of a task are sorted into a run and cut into segments, so that suffixes with equal beginnings reach the
same part. Segments travel front-coded: for each suffix the length it shares with the one before, and the rest. A part
merges its segments with a loser tree that keeps, for each loser, the length it shares with the winner that passed it;
comparisons start behind that length, so no known prefix is compared again. The merged order comes with the lengths
shared by neighbours, and from those and the few bytes before each owner follow the repeated strings.

Digests choose what is sorted and where, and decide nothing: an owner whose beginning has a hash of its own shares no
string with another, all others are sorted and compared byte by byte. Equal stretches of a run fall together when it is
sorted and travel once, with their number, so a passage that many documents share reaches its part once a run. A
beginning that goes on in more than HOT_KINDS ways is not brought together: its owners stand for narrower ranges of
offsets, whose strings have more bytes in common, and are dealt by the hash of these; in the end each offset alone, where
what is dealt together are equal strings.

Strings of two lengths can be asked for at once. The owner of a string is that of the shorter one it begins with, so one
sorted order serves both; crowded beginnings are narrowed for each length by itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import beside, chunks, text_bytes
from tidemark.storage import materialize

LENGTH = 400
#: Bytes of a repeated passage that is counted: 51 words of sf0.1 have 314 in the median.
PASSAGE = 300
WINDOW = 256
GRAM = 32
#: Different stretches that share a beginning, above which its owners are dealt by narrower ranges of offsets.
HOT_KINDS = 50_000
#: Offsets in a range, from one split to the next.
WIDTHS = (16, 1)
#: Crowded beginnings that may travel to the rows.
SMALL_ROWS = 100_000
#: Suffixes that one part merges, on average, and bytes of suffixes that a task sorts into one run.
PART_SUFFIXES = 20_000
RUN_BYTES = 32 << 20
ODD = 0x9E3779B97F4A7C15
LOW = np.uint64(0xFFFFFFFF)


class Powers:
    """Powers of ODD and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 20)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, np.uint64))), dtype=np.uint64) for x in (ODD, pow(ODD, -1, 1 << 64)))
        return self.up, self.down


POWERS = Powers()
BYTE_CODES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def owners(data: np.ndarray, starts: np.ndarray, length: int, reach: int = 0) -> tuple[np.ndarray, ...]:
    """(text, position, least and most bytes before it, hashes of the beginning and of the whole stretch) of the owners.

    The texts are laid end to end. An owner at a owns the strings that start at a - most .. a - least, which cover its
    stretch. Positions count in data. With a reach beyond length, the stretch is what strings of that length cover, as
    far as the text goes.
    """
    n, size = len(data), np.diff(starts)
    long = np.flatnonzero(size >= length)
    if not len(long):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    codes = BYTE_CODES[data]
    h = codes
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(ODD ^ step << 1) + h[step:]
        h ^= h >> np.uint64(31)
        step *= 2
    least = (h * np.uint64(ODD)) & ~LOW
    least |= np.arange(len(least), dtype=np.uint64)
    step = 1
    while step < WINDOW:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    edge = np.zeros(n + 1, np.int8)
    edge[starts[long]] += 1
    edge[starts[long + 1] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    owner = (least[at] & LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    last = np.append(first[1:], len(owner)) - 1
    position = owner[first]
    up, down = POWERS.to(n + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * up[:n], dtype=np.uint64)))
    begin = (total[position + length - WINDOW + 1] - total[position]) * down[position]
    text = np.searchsorted(starts, position, side="right") - 1
    end = np.minimum(at[last] + max(length, reach), starts[text + 1])
    whole = (total[end] - total[at[first]]) * down[at[first]] + (position - at[first]).astype(np.uint64) * np.uint64(ODD * ODD % (1 << 64))
    return text, position, position - at[last], position - at[first], begin ^ (begin >> np.uint64(29)), whole ^ (whole >> np.uint64(31))


def shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, known to be at least at."""
    end = min(len(a), len(b))
    while at < end and a[at : at + 64] == b[at : at + 64]:
        at += 64
    if at >= end:
        return end
    x, y = a[at : min(at + 64, end)], b[at : min(at + 64, end)]
    differing = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return at + len(x) - (differing.bit_length() + 7) // 8


def front_code(ordered: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """(length shared with the one before, rests laid end to end, length of each) of sorted strings."""
    prefix = np.zeros(len(ordered), np.int16)
    rests, before = [], b""
    for i, s in enumerate(ordered):
        k = shared(before, s, 0)
        prefix[i] = k
        rests.append(s[k:])
        before = s
    return prefix, b"".join(rests), np.fromiter(map(len, ordered), np.int16, len(ordered))


class Run:
    """A front-coded segment, read in order: the current string and the length it shares with the one before."""

    def __init__(self, prefix: np.ndarray, rests: bytes, sizes: np.ndarray) -> None:
        self.prefix, self.rests, self.sizes = prefix.tolist(), rests, sizes.tolist()
        self.at, self.offset, self.now, self.lcp = -1, 0, b"", 0

    def advance(self) -> bool:
        self.at += 1
        if self.at >= len(self.prefix):
            return False
        self.lcp = self.prefix[self.at]
        end = self.offset + self.sizes[self.at] - self.lcp
        self.now = self.now[: self.lcp] + self.rests[self.offset : end]
        self.offset = end
        return True


def merge(runs: list[Run]):
    """(run, index in it, length shared with the string merged before) of all strings in order.

    A loser tree: an inner node keeps the run that lost there and the length it shares with the run that won. All
    lengths on the path of the last winner refer to that winner, so the longer of two is the smaller string, and
    only strings of equal length shared are compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    loser, length = [-1] * size, [0] * size

    def play(node: int, a: int, la: int, b: int, lb: int) -> tuple[int, int]:
        """Leaves the loser at node and returns the winner; -1 is a run that has ended."""
        if a < 0 or b >= 0 and lb > la:
            loser[node], length[node] = a, la
            return b, lb
        if b < 0 or la > lb:
            loser[node], length[node] = b, lb
            return a, la
        x, y = runs[a].now, runs[b].now
        k = shared(x, y, la)
        if x[k : k + 1] <= y[k : k + 1]:
            loser[node], length[node] = b, k
            return a, la
        loser[node], length[node] = a, k
        return b, lb

    level = [(i if i < len(runs) and runs[i].advance() else -1, 0) for i in range(size)]
    node = size
    while len(level) > 1:
        node //= 2
        level = [play(node + i, *level[2 * i], *level[2 * i + 1]) for i in range(len(level) // 2)]
    winner, lcp = level[0]
    while winner >= 0:
        yield winner, runs[winner].at, lcp
        node = (winner + size) // 2
        going = (winner, runs[winner].lcp) if runs[winner].advance() else (-1, 0)
        while node:
            going = play(node, *going, loser[node], length[node])
            node //= 2
        winner, lcp = going


def repeated_strings(lcp: np.ndarray, count: np.ndarray, size: np.ndarray, least: np.ndarray, most: np.ndarray, before: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """hits[k, i, o]: the string of lengths[k] bytes that starts o bytes before the i-th suffix occurs again among these.

    lcp: of each suffix with the one before it in order; count: how many stretches it stands for; size: its bytes;
    before[i, o]: the byte o + 1 places before suffix i.
    """
    n = len(lcp)
    offsets = np.arange(WINDOW)
    many = (count > 1)[:, None] & (least[:, None] <= offsets) & (offsets <= most[:, None])
    hits = np.stack([many & (size[:, None] >= length - offsets) for length in lengths])
    names = np.zeros(n, np.int64)
    near = np.maximum(lcp, np.append(lcp[1:], 0))
    alive = near >= min(lengths) - most
    for o in range(WINDOW):
        alive &= most >= o
        if not alive.any():
            break
        if o:
            names[alive] = np.unique(names[alive] * 256 + before[alive, o - 1], return_inverse=True)[1]
        for k, length in enumerate(lengths):
            mine = np.flatnonzero(alive & (least <= o) & (near >= length - o))
            if len(mine) < 2:
                continue
            group = np.cumsum(lcp < length - o)[mine] * n + names[mine]
            order = np.argsort(group, kind="stable")
            same = group[order][1:] == group[order][:-1]
            hits[k, mine[order[1:][same]], o] = True
            hits[k, mine[order[:-1][same]], o] = True
    return hits


def of_kind(lengths: tuple[int, ...], kind: int) -> tuple[int, ...]:
    """Lengths of the strings that items of a kind stand for: all of them (0), or one."""
    return lengths[kind - 1 : kind] if kind else lengths


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _beginnings(docs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(key, copies, doc, begins): a row for each different text, with its owners' hashes of beginning and stretch."""

    def run(batches):
        for batch in batches:
            starts, data = text_bytes(batch.column(2))
            blobs = [b""] * batch.num_rows
            for lo, hi in chunks(starts):
                base = starts[lo]
                text, _, _, _, begin, whole = owners(data[base : starts[hi]], starts[lo : hi + 1] - base, lengths[0], lengths[-1])
                cut = np.searchsorted(text, np.arange(hi - lo + 1))
                raw = np.column_stack((begin, whole)).astype("<u8").tobytes()
                blobs[lo:hi] = [raw[16 * cut[i] : 16 * cut[i + 1]] for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(blobs, pa.binary())], names=["doc", "key", "begins"])

    each = docs.select("doc", "key", "text").mapInArrow(run, "doc long, key binary, begins binary")
    return each.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "begins")).alias("one")).select("key", "copies", "one.*")


def _listed(texts: DataFrame) -> DataFrame:
    """(core, stretch, id, ordinal, kind, slot, width): the owners of the texts, by the hash of their beginning."""

    def run(batches):
        for batch in batches:
            ids, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            counts = np.fromiter((len(b) // 16 for b in blobs), np.int64, len(blobs))
            ordinal = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            hashes = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(hashes[:, 0])), pa.array(np.ascontiguousarray(hashes[:, 1])), pa.array(np.repeat(ids, counts)), pa.array(ordinal.astype(np.int32))],
                names=["core", "stretch", "id", "ordinal"],
            )

    each = texts.filter("octet_length(begins) > 0").select("id", "begins").mapInArrow(run, "core long, stretch long, id long, ordinal int")
    return each.select("*", F.lit(0).alias("kind"), F.lit(0).alias("slot"), F.lit(WINDOW).alias("width"))


def _narrowed(hot: DataFrame, width: int, lengths: tuple[int, ...]) -> DataFrame:
    """The owners of hot (id, text, items) by ranges of width offsets, with the hash of what a range's strings share.

    Each length is narrowed by itself. Slot s holds the offsets from s * width; only the slots inside an item's own range count.
    """

    def run(batches):
        for batch in batches:
            starts, data = text_bytes(batch.column("text"))
            raw, ids = data.data, batch.column("id").to_pylist()
            for r, a, shortest, most, item in _cut(batch, lengths):
                found = []
                for kind in [item["kind"]] if item["kind"] else range(1, len(lengths) + 1):
                    length = lengths[kind - 1]
                    from_o = max(shortest, a + length - int(starts[r + 1]), item["slot"] * item["width"])
                    to_o = min(most, (item["slot"] + 1) * item["width"] - 1)
                    for slot in range(from_o // width, to_o // width + 1) if from_o <= to_o else ():
                        lo, hi = slot * width, (slot + 1) * width - 1
                        core = raw[max(a - lo, 0) : a + length - hi]
                        stretch = raw[a - min(most, hi) : a + length - max(from_o, lo)]
                        found.append((_digest(core), _digest(stretch), ids[r], item["ordinal"], kind, slot, width))
                types = (pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 4)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), types, strict=True)], names=["core", "stretch", "id", "ordinal", "kind", "slot", "width"])

    return hot.select("id", "text", "items").mapInArrow(run, "core long, stretch long, id long, ordinal int, kind int, slot int, width int")


def _digest(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _items(rows: DataFrame) -> DataFrame:
    """(id, items): what is sorted of a text, in the order of its owners."""
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "slot", "width", "core"))).alias("items"))


def _shared_cores(texts: DataFrame, with_text, hot: int, lengths: tuple[int, ...]) -> DataFrame:
    """(id, items): the owners of a text that may share a string with another owner.

    with_text joins the texts to such a table. What shares a core is at most hot kinds of stretches, or equal strings.
    """
    level, sorted_ = _listed(texts), None
    for width in (*WIDTHS, None):
        twice = level.groupBy("kind", "slot", "core").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        again = materialize(level.join(twice, ["kind", "slot", "core"]), "suffix-shared")
        kinds = again.groupBy("kind", "slot", "core", "stretch").agg(F.lit(1)).groupBy("kind", "slot", "core").agg(F.count("*").alias("n"))
        crowded = materialize(kinds.filter(F.col("n") > hot).drop("n"), "suffix-crowded")
        if width is None or crowded.isEmpty():
            return _items(again if sorted_ is None else sorted_.unionByName(again))
        crowded = beside(crowded, SMALL_ROWS)
        calm = again.join(crowded, ["kind", "slot", "core"], "left_anti")
        sorted_ = calm if sorted_ is None else sorted_.unionByName(calm)
        level = materialize(_narrowed(with_text(_items(again.join(crowded, ["kind", "slot", "core"], "left_semi"))), width, lengths), "suffix-narrowed")


def _cut(batch: pa.RecordBatch, lengths: tuple[int, ...]):
    """(row, owner's byte position in the batch, least, most, item) of the listed items; columns text and items."""
    starts, data = text_bytes(batch.column("text"))
    lists = batch.column("items")
    for lo, hi in chunks(starts):
        base = starts[lo]
        text, position, least, most, _, _ = owners(data[base : starts[hi]], starts[lo : hi + 1] - base, lengths[0])
        first = np.searchsorted(text, np.arange(hi - lo))
        for row in range(lo, hi):
            for item in lists[row].as_py():
                at = first[row - lo] + item["ordinal"]
                yield row, int(base + position[at]), int(least[at]), int(most[at]), item


def _runs(candidates: DataFrame, parts: int, lengths: tuple[int, ...]) -> DataFrame:
    """(part, serial, front-coded segment, and for each different stretch the bytes before it and where it stands).

    A stretch stands for all its equals in the run: count of them, ids and places. Parts from kind * parts on are those
    of a kind.
    """
    names = ["part", "serial", "prefix", "rests", "sizes", "least", "most", "before", "count", "ids", "places"]

    def flush(found: list[tuple], serial: int):
        found.sort()
        rows, a = [], 0
        while a < len(found):
            part, strings, places = found[a][0], [], []
            while a < len(found) and found[a][0] == part:
                b = a + 1
                while b < len(found) and found[b][:5] == found[a][:5]:
                    b += 1
                strings.append((*found[a][1:5], b - a))
                places += found[a:b]
                a = b
            prefix, rests, sizes = front_code([x[0] for x in strings])
            least, most = (np.array([x[k] for x in strings], np.uint8).tobytes() for k in (1, 2))
            count = np.array([x[4] for x in strings], "<i4").tobytes()
            ids, at = (np.array([x[k] for x in places], "<i8").tobytes() for k in (5, 6))
            before = b"".join(x[3] for x in strings)
            rows.append((part, serial + len(rows), prefix.tobytes(), packed(rests), sizes.tobytes(), least, most, packed(before), count, ids, at))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 9)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        serial = TaskContext.get().partitionId() << 32
        found: list[tuple] = []
        held = 0
        for batch in batches:
            starts, data = text_bytes(batch.column("text"))
            raw, ids, starts = data.data, batch.column("id").to_pylist(), starts.tolist()
            for r, a, least, most, item in _cut(batch, lengths):
                kind, slot, width, end = item["kind"], item["slot"], item["width"], starts[r + 1]
                mine = of_kind(lengths, kind)
                least, most = max(least, slot * width, a + mine[0] - end), min(most, (slot + 1) * width - 1)
                part = (item["core"] + slot * ODD) % parts + kind * parts
                found.append((part, bytes(raw[a : min(a + mine[-1] - least, end)]), least, most, bytes(raw[a - most : a]), ids[r], a - starts[r]))
                held += mine[-1] + WINDOW
                if held > RUN_BYTES:
                    segments = flush(found, serial)
                    yield segments
                    serial += segments.num_rows
                    found, held = [], 0
        if found:
            yield flush(found, serial)

    return candidates.select("id", "text", "items").mapInArrow(run, "part int, serial long, " + ", ".join(f"{c} binary" for c in names[2:]))


def packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def unpacked(raw: bytes) -> bytes:
    return pa.decompress(raw[4:], int.from_bytes(raw[:4], "little"), codec="zstd", asbytes=True) if raw else b""


def _merged(runs: DataFrame, parts: int, lengths: tuple[int, ...]) -> DataFrame:
    """(serial, hits): of each segment, (entry, first offset, last offset, length) of strings that occur again, as integers."""

    def run(table: pa.Table) -> pa.Table:
        column = {c: table.column(c).to_pylist() for c in table.column_names}
        segments = [Run(np.frombuffer(p, np.int16), unpacked(r), np.frombuffer(s, np.int16)) for p, r, s in zip(column["prefix"], column["rests"], column["sizes"], strict=True)]
        sizes = [len(s.prefix) for s in segments]
        offset = np.concatenate(([0], np.cumsum(sizes)))
        merged = list(merge(segments))
        source = np.array([r for r, _, _ in merged], np.int64)
        entry = np.array([i for _, i, _ in merged], np.int64)
        lcp = np.array([k for _, _, k in merged], np.int64)
        order = offset[source] + entry
        count = np.frombuffer(b"".join(column["count"]), "<i4")[order]
        size = np.frombuffer(b"".join(column["sizes"]), np.int16).astype(np.int64)[order]
        least, most = (np.frombuffer(b"".join(column[c]), np.uint8).astype(np.int64) for c in ("least", "most"))
        ends = np.cumsum(most)[order]
        least, most = least[order], most[order]
        flat = np.frombuffer(b"".join(map(unpacked, column["before"])), np.uint8)
        before = np.zeros((len(order), WINDOW - 1), np.uint8)
        for o in range(WINDOW - 1):
            has = np.flatnonzero(most > o)
            before[has, o] = flat[ends[has] - 1 - o]
        mine = of_kind(lengths, column["part"][0] // parts)
        hits = repeated_strings(lcp, count, size, least, most, before, mine)
        edge = np.diff(np.pad(hits.astype(np.int8), ((0, 0), (0, 0), (1, 1))), axis=2)
        which, row, from_o = np.nonzero(edge == 1)
        _, _, to_o = np.nonzero(edge == -1)
        by = np.argsort(source[row], kind="stable")
        found = np.column_stack((entry[row], from_o, to_o - 1, np.array(mine)[which]))[by].astype("<i4")
        cut = np.searchsorted(source[row][by], np.arange(len(segments) + 1))
        some = np.flatnonzero(np.diff(cut))
        return pa.table({"serial": pa.array([column["serial"][i] for i in some], pa.int64()), "hits": pa.array([found[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())})

    return runs.select("part", "serial", "prefix", "rests", "sizes", "least", "most", "before", "count").groupBy("part").applyInArrow(run, "serial long, hits binary")


def _placed(runs: DataFrame, merged: DataFrame) -> DataFrame:
    """(id, length, start, end): bytes of a text that repeated strings of a length cover, by owner."""

    def run(batches):
        for batch in batches:
            for count, ids, places, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count = np.frombuffer(count, "<i4").astype(np.int64)
                entry, from_o, to_o, length = np.frombuffer(hits, "<i4").reshape(-1, 4).T.astype(np.int64)
                many = count[entry]
                which = np.repeat((np.cumsum(count) - count)[entry], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                place = np.frombuffer(places, "<i8")[which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(ids, "<i8")[which]), pa.array(np.repeat(length, many)), pa.array(place - np.repeat(to_o, many)), pa.array(place + np.repeat(length - from_o, many))],
                    names=["id", "length", "start", "end"],
                )

    return runs.select("serial", "count", "ids", "places").join(merged, "serial").select("count", "ids", "places", "hits").mapInArrow(run, "id long, length long, start long, end long")


def _joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of the spans; those that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _kept(candidates: DataFrame, spans: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(key, n_removed, n_spans, kept_sha256, spans, n_repeated) of the texts with covered bytes.

    Bytes that the longest strings cover are removed; n_repeated counts those that the shortest cover.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for key, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                merged, repeated = (_joined([(x["start"], x["end"]) for x in found if x["length"] == n]) for n in (lengths[-1], lengths[0]))
                raw, kept, at = text.encode(), hashlib.sha256(), 0
                for a, b in merged:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                n_removed, n_repeated = (sum(b - a for a, b in runs) for runs in (merged, repeated))
                rows.append((key, n_removed, len(merged), kept.hexdigest(), ",".join(f"{a}:{b}" for a, b in merged), n_repeated))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "n_removed", "n_spans", "kept_sha256", "spans", "n_repeated"])

    by_text = spans.groupBy("id").agg(F.collect_list(F.struct("length", "start", "end")).alias("found"))
    return candidates.select("id", "key", "text").join(by_text, "id").select("key", "text", "found").mapInArrow(run, "key binary, n_removed long, n_spans long, kept_sha256 string, spans string, n_repeated long")


def repeated_bytes(docs: DataFrame, length: int = LENGTH, hot: int = HOT_KINDS, passage: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), one row per row of docs (doc_id, text).

    Bytes covered by a string of `length` bytes that also starts anywhere else are removed: in another row, a repeated
    row included, or elsewhere in the same text. spans lists start:end of the maximal removed runs, in bytes. Null
    texts are empty; texts under `length` bytes keep everything; an empty table gives an empty result.

    With passage, at most length, n_repeated follows: the bytes covered by strings of `passage` bytes that also start
    anywhere else. They are only counted and stay in the text.
    """
    shortest = length if passage is None else passage
    if not WINDOW + GRAM <= shortest <= length < 1 << 15:
        raise ValueError(f"length and passage must be from {WINDOW + GRAM} to {(1 << 15) - 1}, passage at most length")
    lengths = (shortest, length) if shortest < length else (length,)
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), body.alias("text"))
    keyed = docs.withColumn("key", text_key(F.col("text")))
    texts = materialize(_beginnings(keyed.filter(F.octet_length("text") >= shortest), lengths), "suffix-texts")
    texts = materialize(texts.withColumn("id", F.monotonically_increasing_id()), "suffix-ids")

    def with_text(items: DataFrame) -> DataFrame:
        """items with the text of one row of each different text."""
        listed = items.join(texts.select("id", F.col("key").alias("k"), F.col("doc").alias("d"), "copies"), "id")
        return keyed.join(listed, (F.col("key") == F.col("k")) & F.col("doc").eqNullSafe(F.col("d"))).select("id", "key", "copies", "text", "items")

    candidates = materialize(with_text(_shared_cores(texts, with_text, hot, lengths)), "suffix-candidates")
    suffixes = candidates.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-suffixes // PART_SUFFIXES))
    runs = materialize(_runs(candidates, parts, lengths), "suffix-runs")
    spans = _placed(runs, _merged(runs, parts, lengths))
    changed = _kept(candidates.filter("copies = 1"), spans, lengths).withColumn("copied", F.lit(False))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("spans", "string"), ("n_repeated", "long"))]
    whole = texts.filter("copies > 1").select("key", *nothing, F.lit(True).alias("copied"))
    base = keyed.select("doc", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    joined = base.join(changed.unionByName(whole), "key", "left")
    copied = F.coalesce("copied", F.lit(False))
    gone = copied & (F.col("n_bytes") >= length)
    counted = [] if passage is None else [F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_repeated", F.lit(0))).cast("long").alias("n_repeated")]
    return joined.select(
        F.col("doc").alias("doc_id"), "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        F.when(gone, F.concat(F.lit("0:"), F.col("n_bytes"))).otherwise(F.coalesce("spans", F.lit(""))).alias("spans"), *counted,
    )
