"""Vector code compression: every vector becomes one byte for each of its parts, the number of the nearest entry.

Components are integers, floor(1024 * x), and so are entries, sums and distances, so that results do not depend on the
order of work. Each part position has a vantage-point tree over its entries, which is searched for many vectors at once
by metric branch-and-bound: bounds from rounded square roots are widened, a subtree whose bound equals the best distance
is still visited, and what decides are integer distances, ties to the lower number. Codebooks have a bounded size
(ENTRIES times the dimension) and travel; vectors stay where they are, and a round shuffles sums only.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import beside
from tidemark.storage import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are held within this, so that squared distances of up to 4096 dimensions fit 64 bits.
BOUND = 1 << 24
#: Entries of a leaf; rows searched at once; labels whose sums travel.
LEAF, ROWS, BROADCAST_LABELS = 16, 4096, 100_000
#: Far more than the rounding of a square root and of a sum of two.
SLACK = 1e-9


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries, in doubles where these hold every step."""
    most = int(max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)))
    if points.shape[1] * 4 * most * most < 2**53:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] + (e * e).sum(axis=1) - 2 * (p @ e.T)).astype(np.int64)
    return np.stack([((points - e) ** 2).sum(axis=1) for e in entries], axis=1)


@dataclass
class Node:
    """Entries (numbers, ascending) of a leaf, or a vantage point with the distances at which its two subtrees lie."""

    leaf: np.ndarray | None
    vantage: int = -1
    inner: Node | None = None
    outer: Node | None = None
    spans: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)


class VantageTree:
    """Nearest entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._grown(np.arange(len(entries)))

    def _grown(self, numbers: np.ndarray) -> Node:
        if len(numbers) <= LEAF:
            return Node(numbers)
        here = self.entries[numbers]
        outermost = int(squared(here, here[:1])[:, 0].argmax())
        vantage, rest = numbers[outermost], np.delete(numbers, outermost)
        away = squared(self.entries[rest], self.entries[[vantage]])[:, 0]
        order = np.lexsort((rest, away))
        halves = np.sort(order[: len(order) // 2]), np.sort(order[len(order) // 2 :])
        roots = [np.sqrt(away[h].astype(np.float64)) for h in halves]
        spans = tuple(x for r in roots for x in (r.min() * (1 - SLACK), r.max() * (1 + SLACK)))
        return Node(None, int(vantage), self._grown(rest[halves[0]]), self._grown(rest[halves[1]]), spans)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest entry, squared distance) of each point; ties to the lower number."""
        best, at = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(self.entries))
        for lo in range(0, len(points), ROWS):
            hi = lo + ROWS
            self._search(self.root, points[lo:hi], np.arange(min(hi, len(points)) - lo), best[lo:hi], at[lo:hi])
        return at, best

    def _search(self, node: Node, points: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        if not len(rows):
            return
        numbers = node.leaf if node.leaf is not None else np.array([node.vantage])
        found = squared(points[rows], self.entries[numbers])
        column = found.argmin(axis=1)  # the first of equals, hence the lowest number
        distance, number = found[np.arange(len(rows)), column], numbers[column]
        better = (distance < best[rows]) | (distance == best[rows]) & (number < at[rows])
        best[rows[better]], at[rows[better]] = distance[better], number[better]
        if node.leaf is not None:
            return
        away = np.sqrt(found[:, 0].astype(np.float64))
        low, high = away * (1 - SLACK), away * (1 + SLACK)
        in_lo, in_hi, out_lo, out_hi = node.spans
        bounds = np.maximum(in_lo - high, low - in_hi), np.maximum(out_lo - high, low - out_hi)
        inner_first = bounds[0] <= bounds[1]
        for near, first, second in ((inner_first, 0, 1), (~inner_first, 1, 0)):
            for k in (first, second):
                open_ = bounds[k] <= np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK)
                self._search((node.inner, node.outer)[k], points, rows[near & open_], best, at)


@dataclass(frozen=True)
class Codebooks:
    """entries: parts x entries x width integers."""

    entries: np.ndarray

    def trees(self) -> list[VantageTree]:
        return [VantageTree(e) for e in self.entries]

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """True where the vector is there and all its components are finite numbers."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(vector: Column) -> Column:
    """floor(1024 * x) of each component, held within BOUND."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-float(BOUND))), F.lit(float(BOUND)))).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


@dataclass(frozen=True)
class Vectors:
    """table: the kept rows with a column of integers named ints, written once; width: its length."""

    table: DataFrame
    ints: str
    id_column: str
    width: int


def kept_vectors(df: DataFrame, vector: str = "embedding", id_column: str = "vec_id") -> Vectors:
    """Rows of df with a usable vector. All have the length of the first by (id, components), null ids last; rows of
    another length, or of one that PARTS does not divide or that is zero, are not vectors of this table and go too."""
    ints = "ints"
    while ints.lower() in {c.lower() for c in df.columns}:
        ints += "_"
    whole = df.filter(usable(F.col(f"`{vector}`"))).withColumn(ints, integers(F.col(f"`{vector}`"))).drop(vector)
    whole = whole.filter((F.size(ints) > 0) & (F.size(ints) % PARTS == 0))
    table = materialize(whole, "vectors")
    first = table.orderBy(F.col(f"`{id_column}`").asc_nulls_last(), ints).select(F.size(ints)).first()
    width = first[0] if first else PARTS
    return Vectors(table.filter(F.size(ints) == width), ints, id_column, width)


def train(vectors: Vectors, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks that begin with the smallest ids (ties by components) and are moved to the floored means of what is
    nearest, rounds times; entries that nothing is nearest to stay."""
    ints, width = vectors.ints, vectors.width
    start = vectors.table.orderBy(F.col(f"`{vectors.id_column}`").asc_nulls_last(), ints).select(ints).limit(entries).collect()
    books = Codebooks(np.array([r[0] for r in start], np.int64).reshape(len(start), PARTS, width // PARTS).transpose(1, 0, 2))
    for _ in range(rounds if start else 0):
        moved = books.entries.copy()
        for r in sums(vectors, books).collect():  # a row for each entry and part at most
            moved[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
        books = Codebooks(moved)
    return books


def sums(vectors: Vectors, books: Codebooks) -> DataFrame:
    """(part, entry, n, sums): number and componentwise sum of the parts nearest to each entry that has any."""
    size, width, step = books.entries.shape[1], vectors.width, vectors.width // PARTS

    def partial(batches):
        trees = books.trees()
        n, total = np.zeros((PARTS, size), np.int64), np.zeros((PARTS, size, step), np.int64)
        for batch in batches:
            points = matrix(batch.column(0), width)
            for part, tree in enumerate(trees):
                own = points[:, part * step : (part + 1) * step]
                at, _ = tree.nearest(own)
                n[part] += np.bincount(at, minlength=size)
                np.add.at(total[part], at, own)
        part, entry = np.nonzero(n)
        columns = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    each = vectors.table.select(vectors.ints).mapInArrow(partial, "part int, entry int, n long, sums array<long>")
    wide = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(step)]
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).select("part", "entry", "n", F.array(*[f"s{k}" for k in range(step)]).alias("sums"))


def encode(vectors: Vectors, books: Codebooks) -> DataFrame:
    """The other columns of the kept rows with code (two hex digits a part) and error (sum of the squared distances)."""
    width, step = vectors.width, vectors.width // PARTS
    others = [c for c in vectors.table.columns if c not in (vectors.ints, "code", "error")]
    shown = vectors.table.select(F.col(vectors.ints).alias("v"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)])

    def assign(batches):
        trees = books.trees()
        for batch in batches:
            points = matrix(batch.column(0), width)
            found = [tree.nearest(points[:, k * step : (k + 1) * step]) for k, tree in enumerate(trees)]
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64()), *batch.columns[1:]], names=["code", "error", *batch.schema.names[1:]])

    fields = "code string, error long" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in shown.schema.fields[1:])
    out = shown.mapInArrow(assign, fields)
    return out.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(others)], "code", "error")


def decode(encoded: DataFrame, books: Codebooks) -> DataFrame:
    """encoded with vector: what each code stands for, the entries of its parts divided by the scale."""

    def look_up(batches):
        for batch in batches:
            codes = np.array([list(bytes.fromhex(c)) for c in batch.column(0).to_pylist()], np.int64).reshape(batch.num_rows, PARTS)
            found = np.concatenate([books.entries[k][codes[:, k]] for k in range(PARTS)], axis=1) / SCALE
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.list_(pa.float64())), *batch.columns], names=["v", *batch.schema.names])

    names = [c for c in encoded.columns if c != "vector"]
    shown = encoded.select("code", *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    fields = "v array<double>" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in shown.schema.fields)
    return shown.mapInArrow(look_up, fields).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)], F.col("v").alias("vector"))


def with_label_error(encoded: DataFrame, label: str = "label") -> DataFrame:
    """encoded (a written table) with label_error: error summed over equal labels, nulls together; null beyond 64 bits."""
    total = encoded.groupBy(F.col(f"`{label}`").alias("l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("e"))
    total = total.select("l", F.col("e").try_cast("long").alias("e"))
    shown = encoded.select(F.struct(*[F.col(f"`{c}`") for c in encoded.columns]).alias("row"), F.col(f"`{label}`").alias("own"))
    joined = shown.join(beside(total, BROADCAST_LABELS), F.col("own").eqNullSafe(F.col("l")))
    return joined.select(*[F.col("row")[c].alias(c) for c in encoded.columns if c != "label_error"], F.col("e").alias("label_error"))


def compress(df: DataFrame, vector: str = "embedding", id_column: str = "vec_id", label: str = "label") -> tuple[DataFrame, Codebooks]:
    """(kept rows of df with code, error and label_error instead of the vector, codebooks).

    Rows whose vector is null or holds null or non-finite components go; repeated rows and null ids stay, and an empty
    table gives no rows. Columns named code, error or label_error are replaced, all others pass through.
    """
    vectors = kept_vectors(df, vector, id_column)
    books = train(vectors)
    encoded = materialize(encode(vectors, books), "codes")
    return with_label_error(encoded, label), books
