"""Texts too large for the JVM's JSON values: read token by token, so a record of any size keeps its rows.

A VARIANT holds no string over 20,000,000 characters and no more than 128 MB; parsing anything larger gives null.
Such texts are rare, so they alone go through Python, one row at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of more bytes are read here; below, every string and every text fits into a VARIANT.
LARGE = 16_000_000
_TOKEN = re.compile(
    r'[ \t\n\r]*+(?:(?P<mark>[{}\[\],:])|(?P<text>"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+")|(?P<word>-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?|true|false|null))'
)


class Malformed(ValueError):
    pass


class _Open:
    """A container that is being read."""

    __slots__ = ("above", "at", "fields", "key", "key_rows", "listed", "parent", "path", "rows", "shallow", "start", "what")

    def __init__(self, what: str, path: str, parent: str, above: str, listed: bool, start: int, rows: int):
        self.what, self.path, self.parent, self.above, self.listed, self.start, self.rows = what, path, parent, above, listed, start, rows
        self.at, self.key, self.key_rows, self.shallow, self.fields = 0, None, {}, [], 0


def walk(text: str, registries: Iterable[str], singles: Iterable[str]) -> tuple[list, list]:
    """Listed objects as (path, parent_path, json) and fields as (path, parent_path, field, json) of a text that is one JSON object.

    Raises Malformed for anything else. json of an object too large is that of its scalars alone.
    """
    registries, singles = set(registries), set(singles)
    objects: list = []
    fields: list = []
    stack: list[_Open] = []
    at, state, n = 0, "value", len(text)

    def child(what: str, start: int) -> _Open:
        """The container that begins here, with the path it has in its parent."""
        if not stack:
            return _Open(what, "", "", "", False, start, 0)
        up = stack[-1]
        if up.what == "[":
            path, listed = f"{up.path}[{up.at}]", True
        elif up.path in registries:
            path, listed = f"{up.path}{{{up.key}}}", True
        elif len(stack) == 1 and up.key in singles:
            path, listed = (f"{up.key}[0]" if what == "{" else up.key), True
        else:
            path, listed = (f"{up.path}.{up.key}" if up.path or len(stack) > 1 else up.key), False
        if listed and what == "{":
            return _Open(what, path, path, up.parent, True, start, len(objects))
        return _Open(what, path, up.parent, up.above, False, start, len(objects))

    def field(path: str, up: _Open, raw: str) -> None:
        rest = path[len(up.parent) :]
        fields.append((up.parent, up.above, rest[1:] if up.parent and rest.startswith(".") else rest, raw))

    def scalar(raw: str, start: int) -> None:
        up = stack[-1]
        field(child("", start).path, up, raw)
        if up.what == "{" and len(raw) <= LARGE:
            up.shallow.append((up.key, raw))
            up.fields += len(raw)

    while True:
        m = _TOKEN.match(text, at)
        if not m:
            raise Malformed(at)
        at, kind = m.end(), m.lastgroup
        mark = m.group("mark") if kind == "mark" else None
        if state == "key":
            if kind == "text":
                up = stack[-1]
                up.key = json.loads(m.group("text"))
                if up.key in up.key_rows:  # the last of repeated keys holds
                    a, b, c, d = up.key_rows[up.key]
                    objects[a:b] = [None] * (b - a)
                    fields[c:d] = [None] * (d - c)
                    up.shallow = [x for x in up.shallow if x[0] != up.key]
                up.key_rows[up.key] = (len(objects), len(objects), len(fields), len(fields))
                m = _TOKEN.match(text, at)
                if not m or m.group("mark") != ":":
                    raise Malformed(at)
                at, state = m.end(), "value"
                continue
            raise Malformed(at)
        if state in ("value", "value or end", "key or end"):
            if mark in ("}", "]") and state != "value":
                pass
            elif state == "key or end":
                at, state = m.start(), "key"
                continue
            elif mark in ("{", "["):
                stack.append(child(mark, m.start("mark")))
                state = "key or end" if mark == "{" else "value or end"
                continue
            elif kind in ("text", "word"):
                if not stack:
                    raise Malformed(at)
                scalar(m.group(kind), m.start(kind))
                state = "after"
                _done(stack[-1], objects, fields)
                continue
            else:
                raise Malformed(at)
        # after a value, or at the end of an empty container
        up = stack[-1]
        if mark == "," and state == "after":
            up.at += 1
            state = "key" if up.what == "{" else "value"
        elif mark == ("}" if up.what == "{" else "]"):
            stack.pop()
            if up.listed:
                raw = text[up.start : at] if at - up.start <= LARGE else "{" + ",".join(f"{json.dumps(k)}:{v}" for k, v in up.shallow) + "}"
                objects.append((up.path, up.above, raw))
            elif stack and (not up.key_rows if up.what == "{" else state == "value or end"):
                field(up.path, stack[-1], up.what + mark)
            if not stack:
                if text[at:].strip(" \t\n\r") or up.what != "{":
                    raise Malformed(at)
                return [o for o in objects if o is not None], [f for f in fields if f is not None]
            state = "after"
            _done(stack[-1], objects, fields)
        else:
            raise Malformed(at)
        if at >= n and stack:
            raise Malformed(at)


def _done(up: _Open, objects: list, fields: list) -> None:
    """The value of a key ends: its rows are known, should the key come again."""
    if up.what == "{" and up.key in up.key_rows:
        a, _, c, _ = up.key_rows[up.key]
        up.key_rows[up.key] = (a, len(objects), c, len(fields))


def one_by_one(df: DataFrame, column: str, make: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    """The other columns of df and the columns that make gives of a text, a row for each of its tuples.

    Rows pass through Python one at a time, so no batch holds many large texts.
    """
    spark = df.sparkSession
    keys = [c for c in df.columns if c != column]
    kept = [df.schema[c] for c in keys]

    def rows(r) -> Iterator[tuple]:
        own = tuple(r[c] for c in keys)
        for x in make(r[column]):
            yield (*own, *x)

    out = spark.createDataFrame([], schema).schema
    for f in reversed(kept):
        out.fields.insert(0, f)
        out.names.insert(0, f.name)
    return spark.createDataFrame(df.rdd.flatMap(rows), out, verifySchema=False)


def large(column: str):
    return F.octet_length(column) > LARGE  # known without reading the text
