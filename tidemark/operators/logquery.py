"""Log query language: a line such as `level:error (timeout OR "connection refused") -attr.env:dev` as one boolean Column.

Words and "phrases" ask for messages that contain them, in any case; field:value asks for level, service, trace_id,
span_id, message, timestamp, attr.<key> or resource.<key>, the last three also with > >= < <=. Neighbours must all hold,
AND and OR (in capitals) join, OR binds less, NOT or - before a term or parenthesis negates it. Spark does all the rest:
the Column takes part in pushdown and pruning like any other. A field that a log lacks does not meet a term, and meets
its negation; as a value such a term is null, as a condition false.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.logs import all_of, any_of, level_is, message_has, none_of

#: Bytes of a query, terms, open parentheses and negations in a row, code points of a key and of a value.
MAX_BYTES, MAX_TERMS, MAX_DEPTH, MAX_KEY, MAX_VALUE = 1024, 20, 5, 128, 256
#: A finite decimal number, in queries and attributes alike.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

_TOKEN = re.compile(r'(?P<open>\()|(?P<close>\))|"(?P<text>(?:\\["\\]|[^"])*+)(?P<end>"?)|(?P<minus>-)(?=\S)|(?P<word>[^\s()"]+)')
_FIELD = re.compile(r"(?P<name>[^:]*):(?P<op>>=|<=|>|<|)(?P<value>.*)", re.DOTALL)
_KEY = re.compile(rf"[A-Za-z0-9_.\-/]{{1,{MAX_KEY}}}")
_TIME = re.compile(r"(\d{4}-\d\d-\d\d)(?:T(\d\d:\d\d:\d\d)(?:\.(\d+))?(Z|[+-]\d\d:\d\d))?")


class QueryError(ValueError):
    """What is wrong with a query, and at which character."""

    def __init__(self, at: int, what: str):
        super().__init__(f"query error at position {at}: {what}")
        self.at, self.what = at, what


@dataclass
class _Open:
    """What stands between an open parenthesis and here: alternatives of tests that must all hold."""

    at: int
    negations: int = 0
    alternatives: list[list[Column]] = field(default_factory=lambda: [[]])
    waiting: bool = True

    def take(self, test: Column) -> None:
        self.alternatives[-1].append(none_of(test) if self.negations % 2 else test)
        self.negations, self.waiting = 0, False

    def test(self) -> Column:
        return any_of(*(all_of(*tests) for tests in self.alternatives))


def compiled(query: str) -> Column:
    """The query as a Column over level, service, trace_id, span_id, message, ts_ms and attributes (a map of text)."""
    open_, terms = [_Open(0)], 0
    tokens = list(_tokens(query))
    if not tokens:
        raise QueryError(0, "empty query")
    i = 0
    while i < len(tokens):
        kind, text, at, end = tokens[i]
        here = open_[-1]
        i += 1
        if kind == "open":
            if len(open_) > MAX_DEPTH:
                raise QueryError(at, f"parentheses nested too deeply (max {MAX_DEPTH})")
            if i < len(tokens) and tokens[i][0] == "close":
                raise QueryError(at, "empty parentheses")
            open_.append(_Open(at))
        elif kind == "close":
            if here.waiting or len(open_) == 1:
                raise QueryError(at, "unmatched ')'")
            open_.pop()
            open_[-1].take(here.test())
        elif kind == "minus" or (kind == "word" and text == "NOT"):
            here.negations, here.waiting = here.negations + 1, True
            if here.negations > MAX_DEPTH:
                raise QueryError(at, f"too many stacked negations (max {MAX_DEPTH})")
        elif kind == "word" and text in ("AND", "OR"):
            if here.waiting:
                raise QueryError(at, f"unexpected {text} (quote it to search for the word)")
            here.waiting = True
            if text == "OR":
                here.alternatives.append([])
        else:
            if kind == "word" and ":" in text and text[-1] in ":<>=" and i < len(tokens) and tokens[i][0] == "text" and tokens[i][2] == end and not _FIELD.fullmatch(text)["value"]:
                test = _term(text, at, tokens[i][1])  # a quoted value right behind its field
                i += 1
            else:
                test = _contains(text, at) if kind == "text" else _term(text, at)
            terms += 1
            if terms > MAX_TERMS:
                raise QueryError(at, f"too many terms (max {MAX_TERMS})")
            here.take(test)
    if open_[-1].waiting:
        raise QueryError(len(query), "unexpected end of query")
    if len(open_) > 1:
        raise QueryError(open_[-1].at, "unclosed '('")
    return open_[0].test()


def _tokens(query: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, begin, end) of parentheses, minus signs, words and quoted texts."""
    try:
        size = len(query.encode())
    except UnicodeEncodeError:
        raise QueryError(0, "query is not valid UTF-8") from None
    if size > MAX_BYTES:
        raise QueryError(0, f"query too long ({size} bytes, max {MAX_BYTES})")
    for at, c in enumerate(query):
        if (unicodedata.category(c) == "Cc" and c not in "\t\n\r") or c == "\ufffd":
            raise QueryError(at, "control or invalid character in query")
    at = 0
    while at < len(query):
        if query[at].isspace():
            at += 1
            continue
        m = _TOKEN.match(query, at)
        kind = "text" if m["text"] is not None else m.lastgroup
        if kind == "text" and not m["end"]:
            raise QueryError(at, "unterminated quoted string")
        if kind == "word" and m["word"] == "-":
            raise QueryError(at, "dangling '-' (quote it to search for a hyphen)")
        yield kind, re.sub(r'\\(["\\])', r"\1", m["text"]) if kind == "text" else m[0], at, m.end()
        at = m.end()


def _checked(value: str, at: int) -> str:
    if not value:
        raise QueryError(at, "empty value")
    if len(value) > MAX_VALUE:
        raise QueryError(at, f"value too long (max {MAX_VALUE} characters)")
    return value


def _contains(text: str, at: int) -> Column:
    return message_has(_checked(text, at))


def _term(word: str, at: int, quoted: str | None = None) -> Column:
    """A word, or a field with a value that stands in the word or was quoted behind it."""
    parts = _FIELD.fullmatch(word)
    if not parts:
        return _contains(word, at)
    name, op, value = parts["name"], parts["op"], parts["value"] if quoted is None else quoted
    column, is_key = _column(name, at)
    if not value and quoted is None:
        raise QueryError(at, f"missing value for field {name}")
    plain = name.lower()
    if op and plain != "timestamp" and not is_key:
        raise QueryError(at, "comparison operators only apply to timestamp, attr.* and resource.* fields")
    if plain == "timestamp":
        return _compared(column, op, _milliseconds(value, at))
    number = re.fullmatch(NUMBER, value) and abs(float(value)) != float("inf")
    if is_key and op and not number:
        raise QueryError(at, "comparison needs a numeric value")
    _checked(value, at)
    if plain == "level":
        return level_is(value)
    if plain == "message":
        return message_has(value)
    if not is_key:
        return column == value
    as_number = F.when(column.rlike(NUMBER), column.try_cast("double"))
    if op:
        return _compared(as_number, op, float(value)) & (F.abs(as_number) < float("inf"))
    return (column == value) | (as_number == float(value)) if number else column == value


def _column(name: str, at: int) -> tuple[Column, bool]:
    """The column a field stands for, and whether it is a key of the attributes, which resources share."""
    plain = name.lower() if name.isascii() else name
    if not name:
        raise QueryError(at, "missing field name before ':'")
    if plain in ("level", "service", "trace_id", "span_id", "message"):
        return F.col(plain), False
    if plain == "timestamp":
        return F.col("ts_ms"), False
    space, dot, key = name.partition(".")
    if dot and space.lower() in ("attr", "resource"):
        if not _KEY.fullmatch(key):
            raise QueryError(at, f"invalid key {key[:40]!r} (allowed: letters, digits, _ . - /, max {MAX_KEY} characters)")
        return F.col("attributes")[key], True
    raise QueryError(at, f"unknown field {name[:40]!r} (quote the text to search for it literally)")


def _compared(of: Column, op: str, value: float | int) -> Column:
    return {"": of == value, ">": of > value, ">=": of >= value, "<": of < value, "<=": of <= value}[op]


def _milliseconds(text: str, at: int) -> int:
    """Of a date (its midnight), a time with zone, or a number of milliseconds."""
    m = _TIME.fullmatch(text)
    try:
        if m and m[2]:
            whole = datetime.fromisoformat(f"{m[1]}T{m[2]}{m[4].replace('Z', '+00:00')}")
            return int(whole.timestamp()) * 1000 + int(((m[3] or "") + "000")[:3])
        if m:
            return int(datetime.fromisoformat(m[1]).replace(tzinfo=UTC).timestamp()) * 1000
    except ValueError:
        pass
    if len(text) <= 16 and re.fullmatch(r"[+-]?[0-9]+", text) and int(text) >= 0:
        return int(text)
    raise QueryError(at, f"invalid timestamp {text[:40]!r} (a date, a time with zone, or milliseconds)")
