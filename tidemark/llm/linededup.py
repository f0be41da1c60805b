"""Line or paragraph deduplication across all documents.

Every text is cut into units: clauses by default, or sentences, lines, paragraphs. Units are normalised (lower case,
blanks collapsed) and digested; digests are grouped globally, combined map-side, and the earliest occurrence by
(doc_id, offset) is kept. Other occurrences are removed where a run of neighbouring ones has at least run_words words:
a short phrase that recurs by itself stays, while a passage goes wherever in a line it begins. Offsets of what is
removed are reported in the original text.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import row_keys, valid_text
from tidemark.storage import materialize

#: A unit and what parts it from the next.
UNITS = {
    "clause": re.compile(r"((?:[^.!?,;:\n]|[.!?,;:](?!\s))+[.!?,;:]*)(\s*)|([.!?,;:\n]\s*)()"),
    "sentence": re.compile(r"((?:[^.!?\n]|[.!?](?!\s))+[.!?]*)(\s*)|([.!?\n]\s*)()"),
    "line": re.compile(r"([^\n]+)(\n?)|(\n)()"),
    "paragraph": re.compile(r"((?:[^\n]|\n(?!\s*\n))+)(\n\s*\n|\n?)|(\n)()"),
}
#: Least words of a run of repeated units: half of a passage of fifty words, of which the ends may be parts of units.
RUN_WORDS = 25
#: Digests in more units than this share of all, and than this number, are broadcast instead of shuffled.
HOT_SHARE, HOT_UNITS = 1 / 200_000, 5_000


def units(text: str, unit: str, min_words: int = 1):
    """(start, end, start of what follows, words, digest) of the units with min_words words, in code points."""
    for m in UNITS[unit].finditer(text):
        words = m.group(1).lower().split() if m.group(1) else ()
        if len(words) >= max(min_words, 1):
            yield m.start(1), m.end(1), m.end(), len(words), xxhash.xxh3_128_digest(" ".join(words).encode(errors="surrogatepass"))


def runs(extra: list[tuple[int, int, int, int, int]], run_words: int) -> list[tuple[int, int, int]]:
    """(start, end, start of what follows) of the runs of neighbours with run_words words; extra: (at, start, end, next, words)."""
    out, i = [], 0
    while i < len(extra):
        j = i + 1
        while j < len(extra) and extra[j][0] == extra[j - 1][0] + 1:
            j += 1
        if sum(x[4] for x in extra[i:j]) >= run_words:
            out.append((extra[i][1], extra[j - 1][2], extra[j - 1][3]))
        i = j
    return out


def cut(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text without the spans and what parts each from the next unit."""
    kept, at = [], 0
    for start, _, after in spans:
        kept.append(text[at:start])
        at = after
    return "".join([*kept, text[at:]])


def repeated_units(docs: DataFrame, unit: str, min_words: int) -> DataFrame:
    """(k0, k1, again): for each row of docs (k0, k1, doc, text) with any, the digests of its units that occur again.

    again: array of (d0, d1, own), own if the row holds the earliest occurrence. What is shuffled are digests and
    numbers of rows. Where ids are not unique, equal ids are ranked by the hash of the row.
    """

    def cut_up(batches):
        for batch in batches:
            digests = [b"".join(u[4] for u in units(t, unit, min_words)) if t else b"" for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(digests, pa.binary())], names=["id", "k0", "k1", "doc", "digests"])

    def spread(batches):
        for batch in batches:
            blobs = batch.column(0).to_pylist()
            counts = np.fromiter((len(b) // 16 for b in blobs), np.int64, len(blobs))
            row = np.repeat(np.arange(len(blobs)), counts)
            each = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 2)
            order = np.lexsort((each[:, 1], each[:, 0], row))
            row, each = row[order], each[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (each[1:] != each[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(row)))
            taken = pa.array(row[first])
            columns = [pa.array(np.ascontiguousarray(each[first, k])) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(times), *(c.take(taken) for c in batch.columns[1:])], names=["d0", "d1", "times", "id", "rank"])

    source = docs.select(F.monotonically_increasing_id().alias("id"), "k0", "k1", "doc", "text")
    cut_texts = materialize(source.mapInArrow(cut_up, "id long, k0 long, k1 long, doc long, digests binary"), "units")
    figures = cut_texts.agg(F.sum(F.octet_length("digests")) / 16).first()
    clashes = cut_texts.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1 or doc is null").limit(1).count()
    rank = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "k0", "k1") if clashes else F.col("doc")
    numbered = cut_texts.select("digests", "id", rank.alias("rank"))
    each = numbered.mapInArrow(spread, f"d0 long, d1 long, times long, id long, rank {numbered.schema['rank'].dataType.simpleString()}")
    repeated = each.groupBy("d0", "d1").agg(F.sum("times").alias("n"), F.min("rank").alias("first")).filter("n > 1")
    repeated = materialize(repeated, "repeated-units")
    # Digests of more than HOT_SHARE of all units are at most 1 / HOT_SHARE many, and travel to their units.
    hot = F.col("n") > max(HOT_UNITS, (figures[0] or 0) * HOT_SHARE)
    marked = each.join(F.broadcast(repeated.filter(hot).select("d0", "d1", F.col("first").alias("hot_first"))), ["d0", "d1"], "left")
    common = marked.filter("hot_first is not null").withColumnRenamed("hot_first", "first")
    rare = marked.filter("hot_first is null").drop("hot_first").join(repeated.filter(~hot).select("d0", "d1", "first").hint("merge"), ["d0", "d1"])
    found = common.unionByName(rare).select("id", F.struct("d0", "d1", (F.col("rank") == F.col("first")).alias("own")).alias("again"))
    return found.groupBy("id").agg(F.collect_list("again").alias("again")).join(cut_texts.select("id", "k0", "k1"), "id").drop("id")


def dedup(docs: DataFrame, unit: str = "clause", run_words: int = RUN_WORDS, min_words: int = 1) -> DataFrame:
    """All columns of docs with text replaced by what is kept, plus removed: array of (start, end) in the original.

    Ranks are (doc_id, offset), null ids last; of repeated rows one counts as the earlier. Null texts have no units
    and stay null; units under min_words words are kept and count as absent. What is not valid UTF-8 becomes U+FFFD. A
    column named removed is replaced, all others pass through under any name.
    """
    docs = docs.drop("removed")
    keyed = docs.select(*row_keys(), F.col("doc_id").cast("long").alias("doc"), valid_text().alias("text"))
    again = repeated_units(keyed, unit, min_words).dropDuplicates(["k0", "k1"])

    others = [c for c in docs.columns if c.lower() != "text"]
    rows = docs.select(*row_keys(), valid_text().alias("text"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)])
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("k0", "k1").orderBy("k0")))
    joined = rows.join(again, ["k0", "k1"], "left").select("text", "again", "copy", *[f"c{k}" for k in range(len(others))])

    def extra(text: str, again_: list[dict], copy: int) -> list[tuple[int, int, int, int, int]]:
        """(at, start, end, next, words) of the units that are not the earliest of their digest."""
        open_ = {struct.pack("<qq", x["d0"], x["d1"]): x["own"] and copy == 1 for x in again_}
        out = []
        for at, (*span, digest) in enumerate(units(text, unit, min_words)):
            if open_.get(digest):
                open_[digest] = False
            elif digest in open_:
                out.append((at, *span))
        return out

    def apply(batches):
        for batch in batches:
            texts, removed = [], []
            for text, again_, copy in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                gone = runs(extra(text, again_, copy), run_words) if again_ and text else []
                texts.append(cut(text, gone) if gone else text)
                removed.append([{"start": a, "end": b} for a, b, _ in gone])
            columns = [pa.array(texts, pa.string()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=["text", "removed", *batch.schema.names[3:]])

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [T.StructField("text", T.StringType()), T.StructField("removed", T.ArrayType(span)), *joined.schema.fields[3:]]
    out = joined.mapInArrow(apply, T.StructType(fields))
    back = {c: F.col(f"c{k}") for k, c in enumerate(others)}
    return out.select(*[back.get(c, F.col("text")).alias(c) for c in docs.columns], "removed")
