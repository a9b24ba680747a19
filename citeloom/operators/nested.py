"""Deeply nested records as flat tables (problem 7).

A payload is shredded into columns, one per leaf path, each value with its repetition and definition level; the flat
tables of every repeated ancestor are rebuilt from those level sequences alone. Records without a key are left out. The payloads have no common schema,
so the paths of a record are found first and every leaf below a missing member then gets its null with the level
down to which it is defined; thereby a value's place among its siblings always follows from the repetition levels.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import DataFrame

from citeloom.runtime import widen

#: Marks a repeated step in a path.
REPEATED = "[]"
LEVELS = "path string, seq int, rep int, def int, value string"


_SPACE = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity")


def loads(text: str):
    """json.loads for payloads nested too deep for it: what is open is kept in a list instead of in calls."""
    open_: list = []  # of [container, key of the member that is being read]
    space = lambda k: _SPACE.match(text, k).end()
    at = space(0)

    def key(k: int) -> tuple[str, int]:
        if text[k : k + 1] != '"':
            raise ValueError(f"no name at {k}")
        name, k = scanstring(text, k + 1)
        k = space(k)
        if text[k : k + 1] != ":":
            raise ValueError(f"no colon at {k}")
        return name, space(k + 1)

    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            value, inside = ({} if c == "{" else []), space(at + 1)
            if text[inside : inside + 1] == ("}" if c == "{" else "]"):
                at = inside + 1
            else:
                name, at = key(inside) if c == "{" else (None, inside)
                open_.append([value, name])
                continue
        elif c == '"':
            value, at = scanstring(text, at + 1)
        else:
            m = _PLAIN.match(text, at)
            if m is None:
                raise ValueError(f"no value at {at}")
            value, at = json.loads(m.group()), m.end()
        while True:  # the value is complete; so may be what holds it
            at = space(at)
            if not open_:
                if at < len(text):
                    raise ValueError(f"more at {at}")
                return value
            holder, name = open_[-1]
            if name is None:
                holder.append(value)
            else:
                holder[name] = value
            c = text[at : at + 1]
            if c == ",":
                at = space(at + 1)
                if name is not None:
                    open_[-1][1], at = key(at)
                break
            if c != ("]" if name is None else "}"):
                raise ValueError(f"no end at {at}")
            value, at = open_.pop()[0], at + 1


def parse(payload: str | None):
    """(True, value) of a payload that is complete JSON, however deep, else (False, None). Null, blank and cut-off payloads are not."""
    if payload is None or not payload.strip():
        return False, None
    payload = payload.lstrip("\ufeff")
    try:
        try:
            return True, json.loads(payload)
        except RecursionError:
            return True, loads(payload)
    except ValueError:
        return False, None


class Branch:
    """A place in the tree of a record's paths: its steps ('.' and a member's name, '[]' an array's elements, '' a scalar) and, for a scalar, its column."""

    __slots__ = ("steps", "column")

    def __init__(self):
        self.steps: dict[str, Branch] = {}
        self.column: list[tuple] = []

    def step(self, name: str) -> Branch:
        if name not in self.steps:
            self.steps[name] = Branch()
        return self.steps[name]


def tree(value) -> Branch:
    """All the paths that a record shows. What is still to be seen is kept in a list, so that depth costs no calls."""
    root = Branch()
    todo = [(value, root)]
    while todo:
        value, at = todo.pop()
        if isinstance(value, dict):
            todo += [(member, at.step("." + name)) for name, member in value.items()][::-1]
        elif isinstance(value, list):
            below = at.step(REPEATED)
            todo += [(member, below) for member in reversed(value)]
        elif value is not None:
            at.step("")
    return root


_MISSING = object()


def shred(value) -> dict[str, list[tuple]]:
    """{leaf path: [(repetition level, definition level, value or None), ...]} of one parsed record."""
    root = tree(value)
    todo = [(value, root, 0, 0, 0)]
    while todo:
        value, at, rep, depth, level = todo.pop()
        for step, below in at.steps.items():
            if step == "":
                scalar = None if value is _MISSING or isinstance(value, (dict, list)) else value
                below.column.append((rep, level + (scalar is not None), scalar))
            elif step == REPEATED and isinstance(value, list) and value:
                # an element's place is a level, and so is an object or array in it: [null], [{}] and [] differ
                of = lambda member: level + 1 + isinstance(member, (dict, list))
                todo += [(member, below, depth + 1, depth + 1, of(member)) for member in value[:0:-1]] + [(value[0], below, rep, depth + 1, of(value[0]))]
            elif isinstance(value, dict) and step != REPEATED and value.get(step[1:]) is not None:
                todo.append((value[step[1:]], below, rep, depth, level + 1))
            else:
                todo.append((_MISSING, below, rep, depth, level))
    out: dict = {}
    paths: list = [(root, None)]  # with the steps to it, the last one first
    while paths:
        at, steps = paths.pop()
        if at.column:
            path = []
            while steps:
                path.append(steps[0])
                steps = steps[1]
            out["".join(reversed(path))] = at.column
        paths += [(below, (step, steps)) for step, below in reversed(at.steps.items())]
    return out


def places(reps: list[int], depth: int) -> list[tuple]:
    """The 0-based place at each of `depth` repeated levels, for every value of one column, from its repetition levels."""
    now, out = [0] * depth, []
    for rep in reps:
        if rep == 0:
            now = [0] * depth
        else:
            now[rep - 1] += 1
            now[rep:] = [0] * (depth - rep)
        out.append(tuple(now))
    return out


def as_text(value) -> str | None:
    """A scalar as text; half of a surrogate pair, which no table can hold, becomes a question mark."""
    if value is None:
        return None
    return (value if isinstance(value, str) else json.dumps(value)).encode("utf-8", "replace").decode()


def _records(batches: Iterator[pd.DataFrame]):
    for pdf in batches:
        for rec, payload in zip(pdf["rec"], pdf["payload"]):
            ok, value = parse(None if pd.isna(payload) else payload)
            yield rec, ok, value


def _framed(rows: Iterator[tuple], columns: list[str], size: int = 20_000) -> Iterator[pd.DataFrame]:
    chunk = []
    for row in rows:
        chunk.append(row)
        if len(chunk) >= size:
            yield pd.DataFrame(chunk, columns=columns, dtype=object)
            chunk = []
    if chunk:
        yield pd.DataFrame(chunk, columns=columns, dtype=object)


def _apply(df: DataFrame, rec: str, payload: str, rows, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]
    slim = df.select(df[rec].alias("rec"), df[payload].alias("payload")).filter("rec is not null")
    made = widen(slim, "rec").mapInPandas(lambda batches: _framed(rows(batches), columns), schema)
    return made.withColumnRenamed("rec", rec)


def shredded_levels(df: DataFrame, rec: str, payload: str) -> DataFrame:
    """(rec, path, seq, rep, def, value): every leaf column of every complete payload with its levels; seq is the place in the column."""

    def rows(batches):
        for r, ok, value in _records(batches):
            if ok:
                for path, column in shred(value).items():
                    for k, (rep, level, v) in enumerate(column):
                        yield r, as_text(path), k, rep, level, as_text(v)

    return _apply(df, rec, payload, rows, "rec long, " + LEVELS)


_NUMBER = re.compile(r"\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*")


def number(value) -> float | None:
    """A finite number, also one written as text; None for null, NaN, infinities, true, false and other text."""
    if isinstance(value, str):
        value = float(value) if _NUMBER.fullmatch(value) else None
    if value is None or isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    try:
        value = float(value)
    except OverflowError:  # a whole number beyond all doubles
        return None
    return value if math.isfinite(value) else None


def _values(columns: dict, want: re.Pattern) -> Iterator[tuple]:
    """(path, seq, parent_no, item_no, value) of the wanted columns; group 1 of the pattern is the member's array, group 2 the leaf's."""
    for path, column in columns.items():
        m = want.fullmatch(path)
        if m is None:
            continue
        upto = path[: m.end(1)].count(REPEATED) if m.group(1) else 0
        down = path[: m.end(2)].count(REPEATED) if m.group(2) else 0
        at = places([x[0] for x in column], path.count(REPEATED))
        for k, ((_, _, v), place) in enumerate(zip(column, at)):
            if v is not None and not isinstance(v, bool):
                yield as_text(path), k, place[upto - 1] if upto else 0, place[down - 1] if down else 0, as_text(v)


def _numbers(columns: dict, want: re.Pattern) -> Iterator[tuple]:
    """(path, output_no, value) of the wanted columns."""
    base = 0
    for path, column in columns.items():
        if want.fullmatch(path):
            for k, (_, _, v) in enumerate(column):
                if (x := number(v)) is not None:
                    yield as_text(path), base + k, x
            base += len(column)


def _value_path(member: str, leaf: str, inner: str) -> re.Pattern:
    return re.compile(rf"(?s)(?:.*\.)?{re.escape(member)}(\[\])?\.{re.escape(leaf)}(\[\])?(?:\.{re.escape(inner)})?")


def _number_path(member: str, leaf: str) -> re.Pattern:
    return re.compile(rf"(?s)(?:.*\.)?{re.escape(member)}(?:\[\])?(?:\..*)?\.{re.escape(leaf)}")


def repeated_values(df: DataFrame, rec: str, payload: str, member: str, leaf: str, inner: str = "tree") -> DataFrame:
    """(rec, path, seq, parent_no, item_no, value): the values `leaf` directly belonging to an entry of `member`, wherever that stands.

    `member` may be an array of entries or one entry, `leaf` an array of values, one value, or objects that hold it as `inner`.
    parent_no is the entry's place in its array and item_no the value's place in its own, both 0 for what stands alone and
    both counting null siblings; seq is the value's place in its column. Null values, and payloads that are not complete JSON, give no rows.
    """
    want = _value_path(member, leaf, inner)

    def rows(batches):
        for r, ok, value in _records(batches):
            if ok:
                yield from ((r, *x) for x in _values(shred(value), want))

    return _apply(df, rec, payload, rows, "rec long, path string, seq int, parent_no int, item_no int, value string")


def numbers_below(df: DataFrame, rec: str, payload: str, member: str, leaf: str) -> DataFrame:
    """(rec, path, output_no, value DOUBLE): each number `leaf` at any depth below `member`; output_no counts all outputs of the record from 0.

    An output without the number, or with null, NaN or other text, keeps its place and gives no row.
    """
    want = _number_path(member, leaf)

    def rows(batches):
        for r, ok, value in _records(batches):
            if ok:
                yield from ((r, *x) for x in _numbers(shred(value), want))

    return _apply(df, rec, payload, rows, "rec long, path string, output_no int, value double")


def branches(df: DataFrame, rec: str, payload: str, values: dict[str, tuple[str, str, str]], numbers: dict[str, tuple[str, str]]) -> DataFrame:
    """(rec, branch, parent_no, item_no, value, num): several repeated_values and numbers_below in one pass, so every payload is shredded once.

    values: {branch: (member, leaf, inner)} fills value; numbers: {branch: (member, leaf)} fills num, with the output's place in parent_no and item_no 0.
    """
    texts = {b: _value_path(*x) for b, x in values.items()}
    floats = {b: _number_path(*x) for b, x in numbers.items()}

    def rows(batches):
        for r, ok, value in _records(batches):
            if ok:
                columns = shred(value)
                for b, want in texts.items():
                    yield from ((r, b, p, k, v, None) for _, _, p, k, v in _values(columns, want))
                for b, want in floats.items():
                    yield from ((r, b, p, 0, None, x) for _, p, x in _numbers(columns, want))

    return _apply(df, rec, payload, rows, "rec long, branch string, parent_no int, item_no int, value string, num double")


def record_rows(df: DataFrame, rec: str, payload: str, members: dict[str, str]) -> DataFrame:
    """(rec, state, <name> ...): one row per payload; state is 'complete', 'broken' or 'empty'; each name gets the first value of its member, as text.

    members: {name: member}. A member may stand at any depth outside arrays.
    """

    def rows(batches):
        for pdf in batches:
            for r, payload_ in zip(pdf["rec"], pdf["payload"]):
                text = None if pd.isna(payload_) else payload_
                ok, value = parse(text)
                found: dict = {}
                for path, column in shred(value).items() if ok else ():
                    if REPEATED not in path:
                        found.setdefault(path.rpartition(".")[2], as_text(column[0][2]))
                state = "complete" if ok else "broken" if text and text.strip() else "empty"
                yield (r, state, *(found.get(m) for m in members.values()))

    return _apply(df, rec, payload, rows, "rec long, state string" + "".join(f", {n} string" for n in members))


def entry_rows(df: DataFrame, rec: str, payload: str, member: str, fields: dict[str, str]) -> DataFrame:
    """(rec, parent_no, <name> ...): one row per non-null entry of `member`, tied to its record; each name gets the entry's own scalar field as text."""
    want = re.compile(rf"(?s)((?:.*\.)?{re.escape(member)}(\[\])?)\.([^.\[\]]+)")

    def rows(batches):
        for r, ok, value in _records(batches):
            entries: dict = {}
            for path, column in shred(value).items() if ok else ():
                m = want.match(path)
                if m is None:
                    continue
                upto = m.group(1).count(REPEATED) if m.group(2) else 0
                base = m.group(1).count(".") + 2 * m.group(1).count(REPEATED)
                for (_, level, v), place in zip(column, places([x[0] for x in column], path.count(REPEATED))):
                    if level >= base:  # the entry itself is there
                        e = entries.setdefault((m.group(1), place[:upto]), {})
                        if path == m.group(0) and m.group(3) in fields.values() and v is not None:
                            e[m.group(3)] = as_text(v)
            for (_, place), e in entries.items():
                yield (r, place[-1] if place else 0, *(e.get(f) for f in fields.values()))

    return _apply(df, rec, payload, rows, "rec long, parent_no int" + "".join(f", {n} string" for n in fields))
