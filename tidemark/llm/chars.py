"""Vectorised views of many texts as one array of code points."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidemark.llm.common import chunks, text_bytes

#: Blanks put after each text, so that n-grams up to one more never reach into the next text.
GAP = 4


def code_points(column: pa.Array, lower: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, code points of those rows, start of each text, end of each text), in bounded chunks."""
    starts, data = text_bytes(column)
    raw = data.data
    for lo, hi in chunks(starts):
        texts = [str(raw[starts[i] : starts[i + 1]], "utf-8", "replace") for i in range(lo, hi)]
        if lower:
            texts = [t.lower() for t in texts]
        joined = np.frombuffer((" " * GAP).join([*texts, ""]).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, hi - lo)
        first = np.concatenate(([0], np.cumsum(lengths + GAP)[:-1]))
        yield lo, hi, joined, first, first + lengths


@functools.cache
def letters() -> np.ndarray:
    """True for the code points in a Unicode letter category."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def segment_sums(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of values over [first, end) of each text, zero where it is empty; values may have several columns."""
    total = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return total[end] - total[first]


def inside(first: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """True at the positions that belong to a text."""
    edge = np.zeros(size + 1, np.int8)
    edge[first] += 1
    edge[end] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8) > 0
