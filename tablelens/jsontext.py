"""JSON text of any depth, with numbers of any length.

The standard reader goes first; only where it gives up (nesting deeper than its
stack, numbers with more digits than it takes) is the text read without recursion.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from json import JSONDecodeError
from json.decoder import scanstring
from typing import Any

import pyarrow as pa

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_NAMES = {"null": None, "true": True, "false": False, "NaN": float("nan"), "Infinity": float("inf"), "-Infinity": float("-inf")}
_DIGITS = 4000


def read(text: str, parse_float: Callable[[str], Any] = float) -> Any:
    """The value of a JSON text. Whole numbers of more than 4000 digits are kept as
    text. JSONDecodeError where the text is no JSON."""
    try:
        return json.loads(text, parse_float=parse_float)
    except JSONDecodeError:
        raise
    except (RecursionError, ValueError):
        return _read_flat(text, parse_float)


def _scalar(text: str, at: int, parse_float: Callable[[str], Any]) -> tuple[Any, int]:
    if m := _NUMBER.match(text, at):
        whole, fraction, exponent = m.groups()
        if fraction or exponent:
            return parse_float(m[0]), m.end()
        return (int(whole) if len(whole) <= _DIGITS else whole), m.end()
    for name, value in _NAMES.items():
        if text.startswith(name, at):
            return value, at + len(name)
    raise JSONDecodeError("Expecting value", text, at)


def _key(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise JSONDecodeError("Expecting property name enclosed in double quotes", text, at)
    key, at = scanstring(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise JSONDecodeError("Expecting ':' delimiter", text, at)
    return key, _SPACE.match(text, at + 1).end()


def _read_flat(text: str, parse_float: Callable[[str], Any]) -> Any:
    at = _SPACE.match(text).end()
    stack: list[list[Any]] = []  # open containers, each with its pending key (None in a list)
    while True:
        c = text[at : at + 1]
        if c and c in "{[":
            box: Any = {} if c == "{" else []
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] != ("}" if c == "{" else "]"):
                key = None
                if c == "{":
                    key, at = _key(text, at)
                stack.append([box, key])
                continue
            value, at = box, at + 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            value, at = _scalar(text, at, parse_float)
        while True:  # a value is complete; close what ends with it
            at = _SPACE.match(text, at).end()
            if not stack:
                if at != len(text):
                    raise JSONDecodeError("Extra data", text, at)
                return value
            box, key = stack[-1]
            if key is None:
                box.append(value)
            else:
                box[key] = value
            c = text[at : at + 1]
            if c == ",":
                at = _SPACE.match(text, at + 1).end()
                if key is not None:
                    stack[-1][1], at = _key(text, at)
                break
            if c != ("]" if key is None else "}"):
                raise JSONDecodeError("Expecting ',' delimiter", text, at)
            value, at = stack.pop()[0], at + 1


def write(value: Any) -> str:
    """JSON text of a value of any depth."""
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[bool, Any]] = [(False, value)]  # (whether it is text already, what)
    while todo:
        done, x = todo.pop()
        if done:
            out.append(x)
        elif isinstance(x, dict):
            parts: list[tuple[bool, Any]] = [(True, "{")]
            for i, (k, v) in enumerate(x.items()):
                parts += [(True, f"{', ' if i else ''}{json.dumps(k, ensure_ascii=False)}: "), (False, v)]
            todo.extend(reversed([*parts, (True, "}")]))
        elif isinstance(x, list):
            parts = [(True, "[")]
            for i, v in enumerate(x):
                parts += [(True, ", " if i else ""), (False, v)]
            todo.extend(reversed([*parts, (True, "]")]))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


def texts(values: Iterable[str | None]) -> pa.Array:
    """An Arrow array of texts; halves of surrogate pairs, which JSON can name and
    UTF-8 cannot hold, become the replacement character."""
    values = list(values)
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([None if v is None else v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values], pa.string())
