"""Stack frames of built files traced back to their sources through source maps (version 3).

A map's mappings become a table of segments, a row for each, and frames find theirs by an as-of lookup on
(map, line, column): the segment with the greatest column not beyond the frame's.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a map that is read, path suffixes that are tried, names that are tried in all, and bytes of a file's name.
MAX_MAP, MAX_SUFFIXES, MAX_NAMES, MAX_NAME = 8 << 20, 5, 8, 2048

_DIGITS = np.full(256, -1, np.int64)
_DIGITS[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)] = np.arange(64)
_SEGMENTS = "release string, file string, line int, column int, source string, source_line int, source_column int, name string"


def numbers(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(value, its place in the segment, segment, line) of the variable-length numbers of mappings.

    A number is base-64 digits of five bits each, the sixth says that more follow, and its lowest bit is the sign.
    Commas part segments and semicolons lines; a number that one of them cuts off does not count.
    """
    raw = np.frombuffer(text, np.uint8)
    parts, lines = np.cumsum((raw == 44) | (raw == 59)), np.cumsum(raw == 59)
    used = np.flatnonzero(_DIGITS[raw] >= 0)
    digit, part, line = _DIGITS[raw[used]], parts[used], lines[used]
    if not len(used):
        return (np.zeros(0, np.int64),) * 4
    last = digit < 32
    begins = np.ones(len(used), bool)
    begins[1:] = last[:-1] | (part[1:] != part[:-1])
    first = np.flatnonzero(begins)
    end = np.append(first[1:], len(used)) - 1
    place = np.arange(len(used)) - np.repeat(first, np.diff(np.append(first, len(used))))
    value = np.add.reduceat((digit & 31) << np.minimum(5 * place, 58), first)
    value = np.where(value & 1, -(value >> 1), value >> 1)[last[end]]
    part, line = part[first][last[end]], line[first][last[end]]
    new = np.ones(len(value), bool)
    new[1:] = part[1:] != part[:-1]
    start = np.flatnonzero(new)
    return value, np.arange(len(value)) - np.repeat(start, np.diff(np.append(start, len(value)))), part, line


def decoded(document: dict) -> tuple[np.ndarray, np.ndarray, list[str | None], np.ndarray, np.ndarray, list[str | None]]:
    """(line, column, source, source line, source column, name) of the segments, lines and columns from 1; where a
    segment leads nowhere its source is None. Sources and names add up over all lines, columns within their line."""
    value, place, part, line = numbers(str(document.get("mappings") or "").encode())
    begin = np.flatnonzero(place == 0)
    fields = np.diff(np.append(begin, len(value)))
    at = [np.where(fields > k, value[np.minimum(begin + k, max(len(value) - 1, 0))] if len(value) else 0, 0) for k in range(5)]
    mapped = fields >= 4
    of_line = line[begin]
    total = np.cumsum(at[0])
    first = np.searchsorted(of_line, of_line, side="left")
    column = total - np.where(first > 0, total[first - 1], 0)
    source, source_line, source_column, name = (np.cumsum(np.where(mapped & (fields > k), at[k], 0)) for k in range(1, 5))
    files, names = list(document.get("sources") or []), list(document.get("names") or [])
    good = mapped & (source >= 0) & (source < len(files)) & (source_line >= 0) & (source_column >= 0)
    sources = [files[s] if ok else None for s, ok in zip(source.tolist(), good.tolist(), strict=True)]
    named = [names[n] if ok and 0 <= n < len(names) else None for n, ok in zip(name.tolist(), (good & (fields >= 5)).tolist(), strict=True)]
    return of_line + 1, column + 1, sources, source_line + 1, source_column + 1, named


def segments(maps: DataFrame) -> DataFrame:
    """A row per segment of maps (release, file, map); maps that are too large, no JSON or not of version 3 have none.

    Of segments at one column the last counts. A row without a source ends what the one before covers.
    """

    def cut(batches):
        for batch in batches:
            for release, file, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                document = parsed(text)
                if document is None:
                    continue
                line, column, source, source_line, source_column, name = decoded(document)
                n = len(line)
                last = np.ones(n, bool)
                last[:-1] = (line[1:] != line[:-1]) | (column[1:] != column[:-1])
                keep = pa.array(last)
                columns = [pa.array([release] * n, pa.string()), pa.array([file] * n, pa.string()), *(pa.array(c.astype(np.int32)) for c in (line, column)), pa.array(source, pa.string()), *(pa.array(c.astype(np.int32)) for c in (source_line, source_column)), pa.array(name, pa.string())]
                table = pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=[x.split()[0] for x in _SEGMENTS.split(", ")])
                for lo in range(0, table.num_rows, 1 << 16):
                    yield table.slice(lo, 1 << 16)

    return maps.select("release", "file", F.make_valid_utf8(F.col("map").cast("string"))).mapInArrow(cut, _SEGMENTS)


def parsed(text: str | None) -> dict | None:
    if text is None or len(text.encode()) > MAX_MAP:
        return None
    try:
        document = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return document if isinstance(document, dict) and document.get("version") == 3 else None


def candidates(name: Column) -> Column:
    """The names that a frame's file may be known by, the likeliest first: as it is, without query and fragment, its
    path without host and leading /, ./ and ~/, shorter ends of the path, and its last part."""
    bare = F.regexp_replace(F.btrim(name, F.lit(" \t\n\r")), r"[?#].*$", "")
    path = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+", "")
    plain = F.regexp_replace(path, r"^(?:~/|\./|/)+", "")
    parts = F.split(plain, "/")
    ends = F.transform(F.filter(F.sequence(F.lit(1), F.lit(MAX_SUFFIXES)), lambda i: i < F.size(parts)), lambda i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "/"))
    known = F.array_distinct(F.filter(F.concat(F.array(name, bare, plain), ends), lambda c: c != ""))
    all_ = F.array_distinct(F.concat(F.slice(known, 1, MAX_NAMES - 1), F.filter(F.array(F.element_at(parts, -1)), lambda c: c != "")))
    return F.when(F.octet_length(name) <= MAX_NAME, all_)


def resolved(frames: DataFrame, maps: DataFrame) -> DataFrame:
    """frames (release, file, line, column and others) with source, source_line, source_column and name.

    They are null where no map knows the file or no segment the position. Positions are looked up once each, so that a
    position in very many frames is one row of the lookup, whose sorts are bounded by the lines of built files.
    """
    places = frames.filter("release <> '' and file <> ''").select("release", "file", "line", "column").distinct()
    files = places.select("release", "file").distinct().select("release", "file", F.posexplode(candidates(F.col("file"))).alias("rank", "known"))
    held = maps.select(F.col("release").alias("r"), F.col("file").alias("f")).distinct()
    best = files.join(held, (F.col("release") == F.col("r")) & (F.col("known") == F.col("f"))).groupBy("release", "file").agg(F.min_by("known", "rank").alias("map"))
    asked = places.join(best, ["release", "file"]).select("release", F.col("map"), "line", "column", F.lit(None).cast("struct<source: string, source_line: int, source_column: int, name: string>").alias("segment"), F.lit(True).alias("asks")).distinct()
    wanted = best.select("release", F.col("map").alias("file")).distinct()
    known = segments(maps.join(wanted, ["release", "file"], "left_semi")).select("release", F.col("file").alias("map"), "line", "column", F.struct("source", "source_line", "source_column", "name").alias("segment"), F.lit(False).alias("asks"))
    order = Window.partitionBy("release", "map", "line").orderBy("column", "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = known.unionByName(asked).withColumn("segment", F.last("segment", ignorenulls=True).over(order)).filter("asks").select("release", "map", "line", "column", "segment")
    told = best.join(found, ["release", "map"]).filter("segment.source is not null").select("release", "file", "line", "column", "segment.*")
    return frames.join(told, ["release", "file", "line", "column"], "left").select(*[frames[c] for c in frames.columns], "source", "source_line", "source_column", told["name"].alias("name"))


def resolved_stacks(errors: DataFrame, maps: DataFrame) -> DataFrame:
    """(event_id, frames) of errors (event_id, release, frames: array of filename, function, lineno, colno, in_app).

    A frame that a map explains carries its source position and, where the map has one, its name, is marked resolved
    and keeps what it said in orig_filename, orig_line and orig_col; others stay as they are. A stack is gathered again,
    frame by frame.
    """
    each = errors.select("event_id", "release", F.posexplode("frames").alias("place", "frame")).select("event_id", "release", "place", "frame", F.col("frame.filename").alias("file"), F.col("frame.lineno").alias("line"), F.col("frame.colno").alias("column"))
    told = resolved(each, maps)
    hit = F.col("source").isNotNull()
    old = F.col("frame")
    frame = F.struct(
        F.coalesce("source", old["filename"]).alias("filename"), F.coalesce("name", old["function"]).alias("function"), F.coalesce("source_line", old["lineno"]).alias("lineno"), F.coalesce("source_column", old["colno"]).alias("colno"), old["in_app"].alias("in_app"),
        F.when(hit, old["filename"]).alias("orig_filename"), F.when(hit, old["lineno"]).alias("orig_line"), F.when(hit, old["colno"]).alias("orig_col"), hit.alias("resolved"),
    )
    gathered = told.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("place", frame.alias("frame")))).alias("all"))
    return gathered.select("event_id", F.transform("all", lambda x: x["frame"]).alias("frames"))
