"""The tree of fields inside a field's type, as it is written in schema rows.

A type is the name of a primitive, or the JSON text of a struct, list or map.
Keys are read in either spelling (``element-id``, ``element_id``), the type of
a struct's field under ``field_type`` or ``type``, ids as numbers or as text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import Any

from tablelens import jsontext

#: Kinds that are compared only as such, never by what is inside.
NESTED = ("struct", "list", "map")


def get(node: dict, key: str) -> Any:
    """The value of a kebab-case key, whichever way it is spelled."""
    found = node.get(key)
    return node.get(key.replace("-", "_")) if found is None else found


def as_int(value: Any, bits: int = 64) -> int | None:
    """An id given as a number or as text; None for anything else, and for numbers
    of more bits, which no column holds."""
    if isinstance(value, str):
        digits = value.strip().removeprefix("-")
        if not (digits.isascii() and digits.isdigit()) or len(digits.lstrip("0")) > 19:
            return None
        value = -int(digits.lstrip("0") or "0") if value.strip().startswith("-") else int(digits.lstrip("0") or "0")
    if isinstance(value, bool) or not isinstance(value, int):
        return None
    return value if -(1 << (bits - 1)) <= value < 1 << (bits - 1) else None


def opened(value: Any) -> Any:
    """A type with JSON text in place of an object opened."""
    if isinstance(value, str) and value.lstrip().startswith("{"):
        try:
            return jsontext.read(value)
        except ValueError:
            return value
    return value


def type_tag(value: Any) -> str | None:
    """The form in which types are compared: the kind of a nested type, else
    the name in lower case, without blanks, in one spelling of the zoned timestamp."""
    value = opened(value)
    while isinstance(value, dict):
        value = opened(value.get("type"))
    if not isinstance(value, str):
        return None
    name = "".join(value.split()).lower()
    return "timestampz" if name == "timestamptz" else name


def objects(value: Any) -> list[dict]:
    """The objects of a list; one object in place of a list is a list of one."""
    value = opened(value)
    if isinstance(value, dict):
        return [value]
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def described(value: Any) -> list[tuple[int | None, str | None, Any, dict]]:
    """(id, name, type, attributes) of the fields directly under a type; elements,
    keys and values have no name. The id is None where it can't be read."""
    value = opened(value)
    if not isinstance(value, dict):
        return []
    kind = type_tag(value)
    if kind == "struct":
        out = []
        for f in objects(value.get("fields")):
            name, inside = f.get("name"), get(f, "field-type")
            out.append((as_int(f.get("id"), 32), None if name is None else str(name), f.get("type") if inside is None else inside, f))
        return out
    if kind == "list":
        return [(as_int(get(value, "element-id"), 32), None, value.get("element"), {"required": get(value, "element-required")})]
    if kind == "map":
        return [(as_int(get(value, f"{part}-id"), 32), None, value.get(part), {"required": part == "key" or get(value, "value-required")}) for part in ("key", "value")]
    return []


def children(value: Any) -> list[tuple[int, str | None, Any]]:
    """(id, name, type) of the fields directly under a type. Fields without a
    readable id are left out with all below."""
    return [(i, n, t) for i, n, t, _ in described(value) if i is not None]


def walk(value: Any, parent: int | None = None) -> Iterator[tuple[int, int | None, str | None, str | None]]:
    """(id, id of the enclosing field, name, tag) of all fields below a type,
    depth first, without recursion, so that no depth is too deep."""
    stack = [(i, parent, n, t) for i, n, t in reversed(children(value))]
    while stack:
        field, above, name, kind = stack.pop()
        yield field, above, name, type_tag(kind)
        stack.extend((i, field, n, t) for i, n, t in reversed(children(kind)))


@lru_cache(maxsize=50_000)
def inner(text: str) -> tuple[tuple[int, int | None, str | None, str | None], ...]:
    """walk() of a type's text; types repeat from schema to schema."""
    return tuple(walk(text))


@lru_cache(maxsize=50_000)
def tag_of(text: str) -> str | None:
    return type_tag(text)
