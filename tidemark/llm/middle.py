"""Fill-in-middle transformation: texts are cut into prefix, middle and suffix at unit boundaries and put in a new order.

While the units of a text are counted, the byte and code-point offset of every STRIDE-th unit is recorded: a sparse
index. A cut at unit u is found by binary search for the last checkpoint at or before u and a rescan of at most STRIDE
units from there, so that memory follows units / STRIDE and no text is decoded. Texts are handled as UTF-8 bytes; what
is not valid UTF-8 passes through unchanged, each byte that no other continues being one code point.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import text_bytes

#: Units from one checkpoint to the next, and bytes looked at together.
STRIDE, WINDOW = 64, 1 << 18
#: Fixed marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("line", "word", "char")

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def unit_starts(data: np.ndarray, lo: int, hi: int, unit: str) -> np.ndarray:
    """Positions in [lo, hi) at which a unit of data begins; data begins with a unit whatever it is."""
    here, before = data[lo:hi], data[lo - 1 : hi - 1] if lo else np.concatenate((data[:1], data[: hi - 1]))
    if unit == "line":
        mask = before == 10
    elif unit == "word":
        mask = _BLANK[before] & ~_BLANK[here]
    else:
        mask = (here & 0xC0) != 0x80
    mask = mask.copy()
    if lo == 0 and len(mask):
        mask[0] = True
    return np.flatnonzero(mask) + lo


class Checkpoints:
    """Unit count of a text with (unit, byte, code point) of every stride-th unit."""

    def __init__(self, data: np.ndarray, unit: str = "line", stride: int = STRIDE):
        self.data, self.unit = data, unit
        self.units: list[int] = []
        self.bytes: list[int] = []
        self.chars: list[int] = []
        self.n = self.n_chars = 0
        for lo in range(0, len(data), WINDOW):
            hi = min(lo + WINDOW, len(data))
            starts = unit_starts(data, lo, hi, unit)
            due = np.arange(-self.n % stride, len(starts), stride)
            lead = (data[lo:hi] & 0xC0) != 0x80
            before = np.concatenate(([0], np.cumsum(lead)))
            self.units += (due + self.n).tolist()
            self.bytes += starts[due].tolist()
            self.chars += (before[starts[due] - lo] + self.n_chars).tolist()
            self.n += len(starts)
            self.n_chars += int(before[-1])

    def cut(self, unit: int) -> tuple[int, int]:
        """(byte, code point) offset at which the unit begins; those of the text's end for the number of units."""
        if unit >= self.n:
            return len(self.data), self.n_chars
        k = bisect_right(self.units, unit) - 1
        ahead, at, chars = unit - self.units[k], self.bytes[k], self.chars[k]
        begin = at
        while ahead:  # the checkpoint is itself a start: number 0 of what is found from it on
            end = min(begin + WINDOW, len(self.data))
            starts = unit_starts(self.data, begin, end, self.unit)
            starts = starts[starts > at]
            if len(starts) >= ahead:
                stop = int(starts[ahead - 1])
                return stop, chars + int(np.count_nonzero((self.data[at:stop] & 0xC0) != 0x80))
            ahead -= len(starts)
            begin = end
        return at, chars


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that depend on seed and id only; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def rearranged(raw: np.ndarray, doc_id: int | None, unit: str, percent: int, spm_percent: int, seed: int) -> tuple[int, str, tuple[int, int, int] | None, bytes]:
    """(units, form, code points of prefix, middle and suffix or None, output) of one text."""
    index, text = Checkpoints(raw, unit), raw.tobytes()
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= percent or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return index.n, "plain", None, text
    (b1, c1), (b2, c2) = (index.cut(u) for u in sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
    parts = {PREFIX: text[:b1], MIDDLE: text[b1:b2], SUFFIX: text[b2:]}
    form, order = ("spm", (SUFFIX, PREFIX, MIDDLE)) if h4 % 100 < spm_percent else ("psm", (PREFIX, SUFFIX, MIDDLE))
    return index.n, form, (c1, c2 - c1, index.n_chars - c2), b"".join(m.encode() + parts[m] for m in order)


def transform(docs: DataFrame, unit: str = "line", percent: int = 100, spm_percent: int = 50, seed: int = 7) -> DataFrame:
    """docs with text rearranged, and n, form, prefix_chars, middle_chars, suffix_chars (columns so named are replaced).

    Null and empty texts have no units, are of form plain and become empty; so do, unchanged, texts that hold a mark and
    those outside the percent drawn. Draws depend on doc_id alone: repeated rows are cut alike, null ids count as one
    id. Texts of any length are cut whole. Other columns pass through under any name.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    made = ["n", "form", "prefix_chars", "middle_chars", "suffix_chars"]
    names = [c for c in docs.columns if c.lower() not in made]
    others = [c for c in names if c.lower() != "text"]
    kept = docs.select(*[f"`{c}`" for c in names])
    shown = kept.select(F.col("doc_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)])

    def cut_up(batches):
        for batch in batches:
            starts, data = text_bytes(batch.column(1))
            n, forms, sizes, outputs = [], [], [], []
            for k, i in enumerate(batch.column(0).to_pylist()):
                units, form, chars, output = rearranged(data[starts[k] : starts[k + 1]], i, unit, percent, spm_percent, seed)
                n.append(units)
                forms.append(form)
                sizes.append(chars or (None, None, None))
                outputs.append(output)
            columns = [pa.array(outputs, pa.binary()), pa.array(n, pa.int64()), pa.array(forms), *(pa.array([s[k] for s in sizes], pa.int64()) for k in range(3))]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names=["t", *made, *batch.schema.names[2:]])

    fields = [T.StructField("t", T.BinaryType()), *(T.StructField(c, T.StringType() if c == "form" else T.LongType()) for c in made)]
    out = shown.mapInArrow(cut_up, T.StructType([*fields, *shown.schema.fields[2:]]))
    back = {c: F.col(f"c{k}") for k, c in enumerate(others)}
    return out.select(*[back.get(c, F.col("t").cast("string")).alias(c) for c in names], *made)


def restored(output: Column, form: Column) -> Column:
    """The exact text from an output and its form. Marks begin with their only '<', so the first of each is the right one."""

    def after(mark: str) -> Column:
        return F.locate(mark, output) + len(mark)

    def between(mark: str, following: str) -> Column:
        return F.substr(output, after(mark), F.locate(following, output) - after(mark))

    middle = F.substr(output, after(MIDDLE))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
