"""What the corpus operators share: reading tables, row identity and byte-level views of Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Words are runs of anything but these six ASCII blanks; bytes.split() uses exactly this set.
WORD = r"[^\x20\x09-\x0D]+"
#: Text handled at once inside a task; numpy scratch arrays are a small multiple of this.
CHUNK_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir; the workers of this session find this package where the driver found it."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Never-null 64-bit identity of a row, equal for repeated rows."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def row_keys(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Never-null 128-bit identity of a row, k0 and k1, equal for repeated rows; null and empty text differ."""
    return tuple(F.xxhash64(F.lit(i), F.col(doc_id), F.col(text).isNull(), F.col(text)).alias(f"k{i}") for i in range(2))


def valid_text(name: str = "text") -> Column:
    """The text with what is not valid UTF-8 replaced by U+FFFD, for tasks that read it as characters."""
    return F.make_valid_utf8(F.col(name).cast("string"))


def beside(df: DataFrame, rows: int) -> DataFrame:
    """df, a written table, for a join with a larger one: it travels if it has at most rows rows, else both are sorted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def free_name(df: DataFrame, name: str) -> str:
    """A column name like name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold01(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return starts, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def chunks(starts: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together hold at most limit bytes (one longer text forms a range of its own)."""
    lo, n = 0, len(starts) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)
