"""Source maps: fixed vectors, a plain decoder over random maps, names of files, stacks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sourcemaps

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def lookup(spark, mappings, line, column, sources=("app.ts",), names=()):
    maps = spark.createDataFrame([("1", "a.js", json.dumps({"version": 3, "mappings": mappings, "sources": list(sources), "names": list(names)}))], "release string, file string, map string")
    frames = spark.createDataFrame([("1", "a.js", line, column)], "release string, file string, line int, column int")
    r = sourcemaps.resolved(frames, maps).first()
    return None if r["source"] is None else (r["source"], r["source_line"], r["source_column"], r["name"])


@pytest.mark.parametrize(
    ("mappings", "line", "column", "expected"),
    [
        ("AAEA;AACA", 1, 1, ("app.ts", 3, 1, None)), ("AAEA;AACA", 2, 1, ("app.ts", 4, 1, None)), ("AAAA", 5, 1, None), ("AAAA,UACA", 1, 8, ("app.ts", 1, 1, None)), ("AAAA,UACA", 1, 11, ("app.ts", 2, 1, None)), ("AAAA,UACA", 1, 1, ("app.ts", 1, 1, None)),
        ("AAAA,K,KACA", 1, 6, None), ("AAAA,K,KACA", 1, 10, None), ("AAAA,K,KACA", 1, 11, ("app.ts", 2, 1, None)), ("AAAA,K,KACA", 1, 4, ("app.ts", 1, 1, None)), ("ACAA", 1, 1, None), ("", 1, 1, None), ("EAAA", 1, 1, None), ("AAAA", 0, 1, None), ("AADA", 1, 1, None), (";;AAgBC", 3, 9, ("app.ts", 17, 2, None)),
    ],
)
def test_positions(spark, mappings, line, column, expected):
    assert lookup(spark, mappings, line, column) == expected


def test_names(spark):
    assert lookup(spark, "AAAAA", 1, 1, names=["handleClick"]) == ("app.ts", 1, 1, "handleClick")
    assert lookup(spark, "AAAAC", 1, 1, names=["one"]) == ("app.ts", 1, 1, None)


def plain(mappings, files, names, line, column):
    """One position, by walking the mappings character by character."""
    totals, out = [0, 0, 0, 0], None
    for number, text in enumerate(mappings.split(";"), 1):
        at = 0
        for segment in text.split(","):
            values, value, shift = [], 0, 0
            for c in segment:
                if c in ALPHABET:
                    d = ALPHABET.index(c)
                    value |= (d & 31) << shift
                    shift += 5
                    if d < 32:
                        values.append(-(value >> 1) if value & 1 else value >> 1)
                        value = shift = 0
            if not values:
                continue
            at += values[0]
            if len(values) >= 4:
                totals = [t + (values[k + 1] if len(values) > k + 1 else 0) for k, t in enumerate(totals)]
            if number == line and at <= column - 1:
                good = len(values) >= 4 and 0 <= totals[0] < len(files) and totals[1] >= 0 and totals[2] >= 0
                out = (files[totals[0]], totals[1] + 1, totals[2] + 1, names[totals[3]] if len(values) >= 5 and 0 <= totals[3] < len(names) else None) if good else None
    return out if line >= 1 else None


def number(n):
    value, out = (-n << 1) | 1 if n < 0 else n << 1, ""
    while True:
        value, digit = value >> 5, value & 31
        out += ALPHABET[digit | 32 if value else digit]
        if not value:
            return out


DELTAS = {1: [0, 0, 0, 0, 1, -1], 2: [0, 1, 2, 700, -1], 3: [0, 1, 40, 40, -40], 4: [0, 0, 1, -1]}


def test_random_maps(spark):
    rng = random.Random(7)
    maps, frames, expected = [], [], {}
    for m in range(25):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            lines.append(",".join("".join(number(rng.choice([0, 1, 3, 40, 3000]) if k == 0 else rng.choice(DELTAS[k])) for k in range(rng.choice([1, 4, 4, 4, 5]))) + rng.choice(["", "", "", "!", "g"]) for _ in range(rng.randrange(9))))
        mappings, files, names = ";".join(lines), ["x.ts", "y.ts"], ["f", "g", "h"]
        maps.append(("r", f"m{m}.js", json.dumps({"version": 3, "mappings": mappings, "sources": files, "names": names})))
        for _ in range(40):
            place = (f"m{m}.js", rng.randrange(0, 7), rng.choice([0, 1, 2, 5, 42, 90, 3001, 9000]))
            frames.append((len(frames), "r", *place))
            expected[len(frames) - 1] = plain(mappings, files, names, *place[1:])
    df = sourcemaps.resolved(spark.createDataFrame(frames, "id int, release string, file string, line int, column int"), spark.createDataFrame(maps, "release string, file string, map string"))
    found = {r["id"]: None if r["source"] is None else (r["source"], r["source_line"], r["source_column"], r["name"]) for r in df.collect()}
    assert found == expected and sum(x is not None for x in found.values()) > 100


def test_candidates(spark):
    cases = {
        "https://cdn.x/static/js/app.js?v=3#a": ["https://cdn.x/static/js/app.js?v=3#a", "https://cdn.x/static/js/app.js", "static/js/app.js", "js/app.js", "app.js"], "/static/app.js": ["/static/app.js", "static/app.js", "app.js"], "~/./a.js": ["~/./a.js", "a.js"],
        "a/b/c/d/e/f/g/h.js": ["a/b/c/d/e/f/g/h.js", "b/c/d/e/f/g/h.js", "c/d/e/f/g/h.js", "d/e/f/g/h.js", "e/f/g/h.js", "f/g/h.js", "h.js"], "": [], "x" * 3000: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "f string")
    assert {r["f"]: r["c"] for r in df.select("f", sourcemaps.candidates(F.col("f")).alias("c")).collect()} == cases


def test_stacks(spark):
    good = json.dumps({"version": 3, "mappings": "AAAAA", "sources": ["src/a.ts"], "names": ["run"]})
    maps = spark.createDataFrame([("1", "static/a.js", good), ("1", "bad.js", "{"), ("1", "old.js", good.replace("3", "2")), ("2", "b.js", good), ("1", "null.js", None)], "release string, file string, map string")
    frame = "array<struct<filename: string, function: string, lineno: int, colno: int, in_app: boolean>>"
    stacks = [(1, "1", [("https://x.test/static/a.js?v=1", "t", 1, 7, True), ("b.js", "u", 1, 1, False), ("static/a.js", None, 2, 1, True)]), (2, "2", [("/b.js", "v", 1, 2, True)]), (3, "", [("b.js", "w", 1, 1, True)]), (4, "1", [("bad.js", "x", 1, 1, True), ("old.js", "y", 1, 1, True), (None, "z", 1, 1, True)])]
    out = {r["event_id"]: [tuple(f) for f in r["frames"]] for r in sourcemaps.resolved_stacks(spark.createDataFrame(stacks, f"event_id int, release string, frames {frame}"), maps).collect()}
    assert out[1] == [("src/a.ts", "run", 1, 1, True, "https://x.test/static/a.js?v=1", 1, 7, True), ("b.js", "u", 1, 1, False, None, None, None, False), ("static/a.js", None, 2, 1, True, None, None, None, False)]
    assert out[2] == [("src/a.ts", "run", 1, 1, True, "/b.js", 1, 2, True)] and not out[3][0][-1] and not any(f[-1] for f in out[4])
