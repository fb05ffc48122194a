"""JSON helpers shared by the nested-record and timestamp operators (pure Python)."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_SPACE = re.compile(r"[ \t\r\n]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None}
RECORD_KEYS = ("eventVersion", "userIdentity", "eventTime", "eventSource", "eventName", "requestParameters", "responseElements")


def _deep(text: str, numbers_as_text: bool) -> object:
    """Iterative JSON parser for texts nested deeper than the standard one allows."""
    at, stack, key, done = _SPACE.match(text, 0).end(), [], None, False
    value: object = None

    def skip(i: int) -> int:
        return _SPACE.match(text, i).end()

    while True:
        ch = text[at : at + 1]
        opened = False
        if ch == "{":
            value, at, opened = {}, skip(at + 1), True
        elif ch == "[":
            value, at, opened = [], skip(at + 1), True
        elif ch == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _NUMBER.match(text, at):
            raw, at = m.group(), m.end()
            value = raw if numbers_as_text else (float(raw) if re.search("[.eE]", raw) else int(raw))
        else:
            for word, meaning in _WORDS.items():
                if text.startswith(word, at):
                    value, at = meaning, at + len(word)
                    break
            else:
                raise ValueError("not JSON")
        if opened:
            stack.append((value, key))
            close = "}" if isinstance(value, dict) else "]"
            if text[at : at + 1] != close:
                if isinstance(value, dict):
                    if text[at : at + 1] != '"':
                        raise ValueError("key expected")
                    key, at = scanstring(text, at + 1, True)
                    at = skip(at)
                    if text[at : at + 1] != ":":
                        raise ValueError("colon expected")
                    at = skip(at + 1)
                continue
            at += 1
            value, key = stack.pop()
        while True:
            at = skip(at)
            if not stack:
                done = True
                break
            holder, outer = stack[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            ch = text[at : at + 1]
            if ch == ",":
                at = skip(at + 1)
                if isinstance(holder, dict):
                    if text[at : at + 1] != '"':
                        raise ValueError("key expected")
                    key, at = scanstring(text, at + 1, True)
                    at = skip(at)
                    if text[at : at + 1] != ":":
                        raise ValueError("colon expected")
                    at = skip(at + 1)
                break
            if ch != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError("incomplete")
            at += 1
            value, key = holder, outer
            stack.pop()
        if done:
            if at != len(text):
                raise ValueError("extra data")
            return value


def parse(text: str, numbers_as_text: bool = False) -> object:
    """The JSON value of a text; ValueError if it is incomplete or no JSON."""
    text = text.lstrip("﻿")
    try:
        return json.loads(text, parse_int=str, parse_float=str) if numbers_as_text else json.loads(text)
    except RecursionError:
        return _deep(text.strip(" \t\r\n"), numbers_as_text)


def _unwrap(value: object, numbers_as_text: bool) -> list:
    """The records under any number of wrappings: each step takes one off."""
    while True:
        if isinstance(value, str):
            if value.lstrip("\ufeff \t\r\n")[:1] not in ("{", "[", '"'):
                return []
            value = parse(value, numbers_as_text)
        elif isinstance(value, list):
            envelope = lambda x: isinstance(x, dict) and not any(k in x for k in RECORD_KEYS) and isinstance(x.get("detail"), dict)
            return [x["detail"] if envelope(x) else x for x in value]
        elif isinstance(value, dict):
            if isinstance(value.get("Records"), (list, str)):
                value = value["Records"]
            elif any(k in value for k in RECORD_KEYS):
                return [value]
            elif "detail" in value:
                value = value["detail"]
            else:
                return []
        else:
            return []


def records(body: str | None, numbers_as_text: bool = False) -> list:
    """The records of a delivered body, in order; none if the body is incomplete JSON.

    Wrappings: a ``Records`` object, a bare list, one bare record, an envelope with
    ``detail``, any of these as a JSON string or one per line, with or without a byte
    order mark. Entries that are not objects keep their place.
    """
    if not body or not body.strip("﻿ \t\r\n"):
        return []
    try:
        return _unwrap(parse(body, numbers_as_text), numbers_as_text)
    except ValueError:
        pass
    lines = [x for x in body.lstrip("﻿").splitlines() if x.strip()]
    if len(lines) < 2 or not all(x.strip().startswith("{") and x.strip().endswith("}") for x in lines):
        return []
    try:
        return [r for x in lines for r in _unwrap(parse(x.strip(), numbers_as_text), numbers_as_text)]
    except ValueError:
        return []
