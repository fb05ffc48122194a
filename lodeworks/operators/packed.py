"""Several values packed in one field: one row per value, with its position.

A quote-aware finite-state tokenizer walks each cell once. Its states are: between
values, in a bare value, in a double-quoted or single-quoted part, and, in bracketed
cells, a nesting depth. Only separators outside quotes, escapes and nested brackets end
a value.

Scale: a scalar Arrow function and a generator; no shuffle, no state across rows.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

SEPARATORS = ",;|"
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0", "a": "\a", "v": "\v"}


def _quoted(cell: str, at: int, listed: bool) -> tuple[str, int]:
    """The text of the quoted part that opens at ``at``, and the place behind it.

    In bracketed cells the escapes of JSON and Python literals hold. Elsewhere a doubled
    quote is a quote, a backslash protects the quote and, in double quotes, itself; before
    anything else it is an ordinary character. A part that never closes runs to the end.
    """
    mark, out, i, n = cell[at], [], at + 1, len(cell)
    stop = re.compile(r"[\\" + mark + "]")
    while i < n:
        m = stop.search(cell, i)
        if not m:
            out.append(cell[i:])
            return "".join(out), n
        out.append(cell[i : m.start()])
        i = m.start()
        nxt = cell[i + 1 : i + 2]
        if cell[i] == mark:
            if nxt != mark or listed:
                return "".join(out), i + 1
            out.append(mark)
            i += 2
        elif listed:
            width = {"u": 4, "x": 2, "U": 8}.get(nxt)
            digits = cell[i + 2 : i + 2 + width] if width else ""
            if width and len(digits) == width and all(c in "0123456789abcdefABCDEF" for c in digits) and int(digits, 16) < 0x110000:
                out.append(chr(int(digits, 16)))
                i += 2 + width
            else:
                out.append(_ESCAPES.get(nxt, nxt))
                i += 2
        elif nxt == mark or (nxt == "\\" and mark == '"'):
            out.append(nxt)
            i += 2
        else:
            out.append("\\")
            i += 1
    return "".join(out), n


def _mend(text: str) -> str:
    """Surrogate pairs written as two \\u escapes become one character; lone ones a replacement mark."""
    if any("\ud800" <= c <= "\udfff" for c in text):
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return text


def _bracketed(cell: str) -> list[str] | None:
    """Elements of a list or keys of an object at depth one; None if the brackets don't close."""
    is_object, out, i, n = cell[0] == "{", [], 1, len(cell)
    depth, value, started, in_key = 1, [], False, True
    mark = 1

    def close() -> None:
        nonlocal value, started, in_key
        if started and (in_key or not is_object):
            text = _mend("".join(value)).strip()
            if text:
                out.append(text)
        value, started, in_key = [], False, True

    while i < n:
        c = cell[i]
        if c in "\"'":
            text, i = _quoted(cell, i, True)
            if depth == 1:
                value.append(text)
                started = True
        elif c in "[{(":
            if depth == 1:
                mark = i
            depth += 1
            i += 1
        elif c in "]})":
            depth -= 1
            i += 1
            if depth == 1 and not (is_object and not in_key):
                value.append(cell[mark:i])  # a nested list or object counts as its text
                started = True
            if depth == 0:
                close()
                return out if not cell[i:].strip() else None
        elif depth > 1:
            i += 1
        elif c == ",":
            close()
            i += 1
        elif c == ":" and is_object and in_key:
            text = _mend("".join(value)).strip()
            if started and text:
                out.append(text)
            value, started, in_key = [], False, False
            i += 1
        elif c.isspace():
            i += 1
        else:
            j = i
            while j < n and cell[j] not in ",:]}) \t\r\n":
                j += 1
            j = max(j, i + 1)
            word = cell[i:j]
            if word not in ("null", "None"):
                value.append(word)
                started = True
            i = j
    return None


def tokenize(cell: str | None, colon: bool = False) -> list[str]:
    """The non-empty values of a list cell in order, quoting and escaping resolved.

    Null, empty and blank cells, ``[]`` and ``{}`` have none. A cell in closed brackets is
    a list (JSON or Python notation; numbers count as their text, null is no value, a
    nested list is its text) or an object, of which the keys are the values. In any other
    cell comma, semicolon, bar and white space separate, with ``colon`` also a colon;
    repeated values stay.
    """
    if cell is None or not (text := cell.strip()):
        return []
    if text[0] in "[{" and (found := _bracketed(text)) is not None:
        return found
    special = re.compile(r"[\\\s,;|" + (":" if colon else "") + "]")
    out: list[str] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c.isspace() or c in SEPARATORS or (colon and c == ":"):
            i += 1
            continue
        value = []
        if c in "\"'":
            part, i = _quoted(text, i, False)
            value.append(part)
        while i < n:  # bare, also what follows a closing quote without a separator
            m = special.search(text, i)
            if not m:
                value.append(text[i:])
                i = n
            elif text[m.start()] == "\\" and m.end() < n:
                value.append(text[i : m.start()] + text[m.end()])
                i = m.end() + 1
            elif text[m.start()] == "\\":
                value.append(text[i:])
                i = n
            else:
                value.append(text[i : m.start()])
                i = m.start()
                break
        if done := "".join(value).strip():
            out.append(done)
    return out


def _splitter(colon: bool):
    @arrow_udf(ArrayType(StringType()))
    def split(cells: pa.Array) -> pa.Array:
        return pa.array([tokenize(c, colon) for c in cells.to_pylist()], type=pa.list_(pa.string()))

    return split


def unpack(df: DataFrame, table: str, fields: tuple[str, ...], colon_fields: tuple[str, ...] = (), row_id: str = "id") -> DataFrame:
    """entity_table, row_id, field, pos, value of every value packed in ``fields``."""
    plain, with_colon = _splitter(False), _splitter(True)
    named = F.array(*[F.struct(F.lit(f).alias("field"), (with_colon if f in colon_fields else plain)(F.col(f)).alias("values")) for f in fields])
    cells = df.select(F.col(row_id).alias("row_id"), F.inline(named))
    return cells.select(F.lit(table).alias("entity_table"), "row_id", "field", F.posexplode("values").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


def as_json(values: list[str]) -> str:
    return json.dumps(values, ensure_ascii=False)
